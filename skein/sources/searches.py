"""Pages fetched directly, story search, and mailbox scans: plans of requests and parsers of replies.

Every fetch goes through an injected transport, one request a task; a request that
fails gives one error row and stops nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

Transport = Callable[[str], bytes]
_FETCHED = "ord bigint, name string, url string, body binary, error string"


def single_flight(requests: DataFrame, url: str = "url") -> DataFrame:
    """Requests, each url once: the first asks, the others share its reply."""
    return requests.groupBy(url).agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name")).select("ord", "name", url)


def fetch(requests: DataFrame, transport: Transport, tasks: int = 64) -> DataFrame:
    """(ord, name, url, body, error) of requests (ord, name, url), one row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body = error = None
                try:
                    body = transport(row["url"])
                except Exception as e:  # whatever a transport raises belongs to its request
                    error = f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_pylist([{**row, "body": body, "error": error}], pa.schema([("ord", pa.int64()), ("name", pa.string()), ("url", pa.string()), ("body", pa.binary()), ("error", pa.string())]))

    asked = requests.select(F.col("ord").cast("bigint").alias("ord"), "name", "url")
    return asked.repartition(tasks, "url").mapInArrow(run, _FETCHED)


def shared(requests: DataFrame, transport: Transport) -> DataFrame:
    """Every request with the reply of its url, fetched once."""
    replies = fetch(single_flight(requests), transport).select(F.col("url").alias("_u"), "body", "error")
    return requests.join(replies, F.col("url") == F.col("_u"), "left").drop("_u")


# Article lists of a configured page


@dataclass(frozen=True)
class ListPage:
    """Classes of a page's titles and summaries, and where its articles' links begin."""

    title_class: str
    summary_class: str = ""
    prefix: str = ""


class _ListParser(HTMLParser):
    def __init__(self, page: ListPage):
        super().__init__(convert_charrefs=True)
        self.page, self.items, self.seen = page, [], set()
        self.depth, self.inside, self.link, self.parts = 0, None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input", "hr", "meta", "link"):
            return
        named = dict(attrs)
        classes = (named.get("class") or "").split()
        if self.inside is None and self.page.title_class in classes:
            self.inside, self.depth, self.link, self.parts = "title", 0, None, []
        elif self.inside is None and self.page.summary_class and self.page.summary_class in classes and self.items:
            self.inside, self.depth, self.parts = "summary", 0, []
        if self.inside:
            self.depth += 1
            if tag == "a" and self.inside == "title" and self.link is None:
                self.link = named.get("href")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)

    def handle_endtag(self, tag):
        if not self.inside:
            return
        self.depth -= 1
        if self.depth:
            return
        text = " ".join("".join(self.parts).split())
        if self.inside == "title":
            if text and self.link and self.link.startswith(self.page.prefix) and self.link not in self.seen:
                self.seen.add(self.link)
                self.items.append([text, self.link, ""])
        elif not self.items[-1][2]:
            self.items[-1][2] = text
        self.inside = None


def configured_items(html: str | None, page: ListPage) -> list[tuple[str, str, str]]:
    """(title, link, description) of a page's articles in order, each link once."""
    parser = _ListParser(page)
    parser.feed(html or "")
    parser.close()
    return [tuple(i) for i in parser.items]


def configured_lists(pages: DataFrame, page: ListPage, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, title, link, description): a row an article of each page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *item) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, item in enumerate(configured_items(h, page))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string()))], [id, "pos", "title", "link", "description"])

    kind = dict(pages.dtypes)[id]
    return pages.select(id, html).mapInArrow(run, f"{id} {kind}, pos int, title string, link string, description string")


def direct_pages(pages: DataFrame, page: ListPage, as_of: Column, *, days: int = 3, require_date: bool = False, date_pattern: str = r"(\d{4})[/-]?(\d{2})[/-]?(\d{2})", formats: Sequence[str] = D.FORMATS) -> DataFrame:
    """Articles of directly read pages within the date window: the visible date, else that of the link.

    A row without any date stays unless `require_date`.
    """
    items = configured_lists(pages, page)
    visible = D.web_date(F.regexp_extract("description", r"(\d{4}[-./]\d{1,2}[-./]\d{1,2}|[A-Z][a-z]+ \d{1,2}, \d{4})", 1), formats)
    dated = items.withColumn("day", F.coalesce(visible, D.url_date(F.col("link"), date_pattern)))
    return dated.where(D.within_window(F.col("day"), as_of, days, keep_unknown=not require_date))


# Story search


def search_requests(spark, keywords: Sequence[str], base: str, since: int, *, most: int = 4, hits: int = 5) -> DataFrame:
    """One request a keyword, of the first `most`: newest stories since a time, `hits` a page."""
    from urllib.parse import quote

    rows = [(i, k, f"{base}?query={quote(k)}&tags=story&hitsPerPage={hits}&numericFilters=created_at_i>{since}") for i, k in enumerate(keywords[:most])]
    return spark.createDataFrame(rows, "ord bigint, name string, url string")


def search_hits(replies: DataFrame, *, hits: int = 5, limit: int = 500) -> DataFrame:
    """(ord, pos, keyword, title, link, date, description): stories of the replies, a link's first only, texts cut at `limit`."""
    schema = "hits array<struct<title:string,url:string,objectID:string,created_at:string,story_text:string>>"
    parsed = replies.where("error IS NULL").select("ord", F.col("name").alias("keyword"), F.posexplode(F.slice(F.from_json(F.decode("body", "utf-8"), schema)["hits"], 1, hits)).alias("pos", "h"))
    rows = parsed.select("ord", "pos", "keyword", F.col("h.title").alias("title"), F.coalesce(F.nullif("h.url", F.lit("")), F.concat(F.lit("item:"), "h.objectID")).alias("link"), F.col("h.created_at").alias("date"), F.left(T.clean_text(T.text_of("h.story_text")), F.lit(limit)).alias("description"))
    first = F.row_number().over(Window.partitionBy("link").orderBy("ord", "pos"))
    return rows.where(T.text_of("title") != "").withColumn("_r", first).where("_r = 1").drop("_r")


# Mailbox


def mail_query(label: str, senders: Sequence[str] = (), days: int | None = None) -> str:
    """Raw mailbox query: a label and any of the senders, quoted and escaped."""
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    parts = [f"label:{quoted(label)}"] if label else []
    if senders:
        parts.append("{" + " ".join(f"from:{quoted(s)}" for s in senders) + "}")
    return " ".join(parts + ([f"newer_than:{days}d"] if days else []))


def mailbox_scan(messages: DataFrame, senders: Sequence[str], *, newest: int = 20, each: int = 2, sender: str = "sender", at: str = "received", uid: str = "uid") -> DataFrame:
    """(uid, place): the newest messages and the newest of each required sender, in the order first seen.

    The general query comes first, then the senders in theirs; a message counts once.
    """
    order = [F.desc(at), F.desc(uid)]
    general = messages.orderBy(*order).limit(newest)
    first = general.withColumn("_n", F.row_number().over(Window.orderBy(*order))).select(uid, F.lit(-1).alias("_s"), "_n")
    wanted = F.create_map(*[F.lit(x) for i, s in enumerate(senders) for x in (s.lower(), i)]) if senders else None
    if wanted is not None:
        own = messages.withColumn("_s", wanted[F.lower(sender)]).where("_s IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).where(F.col("_n") <= each)
        first = first.unionByName(own.select(uid, "_s", "_n"))
    seen = first.groupBy(uid).agg(F.min(F.struct("_s", "_n")).alias("o"))
    # at most newest + each * senders rows
    return seen.withColumn("place", F.row_number().over(Window.orderBy("o"))).drop("o")


# Archived state and evaluation sets


def read_state(spark, path: str, schema: str) -> DataFrame:
    """JSON lines of a state file; a malformed line stops the read, as a guess would be sent on."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_objects(text: str) -> list[dict]:
    """An array of objects; NaN, infinities and anything else raise ValueError."""

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    rows = json.loads(text, parse_constant=refuse)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("an array of objects is expected")
    return rows


def load_eval_set(spark, text: str, labels: Sequence[str] = ("keep", "reject")) -> DataFrame:
    """(ord, title, description, source, label, expected_category) of a labelled set; unknown labels raise ValueError."""
    rows = load_objects(text)
    if wrong := sorted({str(r.get("label")) for r in rows} - set(labels)):
        raise ValueError(f"unknown labels: {wrong}")
    names = ("title", "description", "source", "label", "expected_category")
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], "ord bigint, title string, description string, source string, label string, expected_category string")


# Market days and indicators


def business_days(spark, first: str, last: str) -> DataFrame:
    """(ord, name, url) requests of each weekday between two days."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day").where(F.weekday("day") < 5)
    return days.select(F.unix_date("day").cast("bigint").alias("ord"), F.date_format("day", "yyyyMMdd").alias("name"), F.date_format("day", "yyyyMMdd").alias("url"))


def named_closes(replies: DataFrame, index: str, *, items: str = "items array<struct<name:string,close:string>>") -> DataFrame:
    """(key, day, value) of daily index lists: the entry of the index's name, spaces and case apart."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    rows = replies.where("error IS NULL").select(F.to_date("name", "yyyyMMdd").alias("day"), F.explode(F.from_json(F.decode("body", "utf-8"), items)["items"]).alias("i"))
    value = F.replace("i.close", F.lit(","), F.lit("")).try_cast("double")
    return rows.where(plain(F.col("i.name")) == plain(F.lit(index))).select(F.lit(index).alias("key"), "day", value.alias("value")).where("value IS NOT NULL")


def paged(read_page: Callable[[int], DataFrame], start: Column, most: int = 100) -> DataFrame:
    """Points of pages (key, day, value, page, pos) until a page reaches back to `start` or is empty."""
    out = None
    for page in range(1, most + 1):
        rows = read_page(page)
        out = rows if out is None else out.unionByName(rows)
        oldest = rows.agg(F.min("day").alias("d")).select(F.coalesce(F.col("d") <= start, F.lit(True))).first()[0]
        if oldest:
            break
    return out


def indicators(parts: Sequence[tuple[str, Callable[[], DataFrame]]], spark) -> DataFrame:
    """(ord, key, points, error): one row an indicator in the order given; one that fails is a row with its error."""
    out = None
    for i, (key, read) in enumerate(parts):
        try:
            points = read().groupBy().agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("points"))
            row = points.select(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.col("points"), F.lit(None).cast("string").alias("error"))
            row = spark.createDataFrame(row.collect(), row.schema)  # one row
        except Exception as e:  # whatever an indicator raises belongs to it
            row = spark.createDataFrame([(i, key, [], f"{type(e).__name__}: {e}"[:300])], "ord int, key string, points array<struct<day:date,value:double>>, error string")
        out = row if out is None else out.unionByName(row)
    return out


def usage(reports: DataFrame, by: str = "model") -> DataFrame:
    """Calls, failures and tokens of a judge's calls by model."""
    return reports.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
