"""Readers, parsers, sinks and streams on files of their own."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from skein.plans.judge import cache_key, cached
from skein.sources import archive, feeds, market, pages, render, searches
from skein.streaming import streams


def test_archive_versions(spark, tmp_path):
    lines = [
        '{"version": 3, "edition_date": "2024-01-10", "articles": [{"url": "https://a.com/1?utm_x=1", "title": "One"}]}',
        "{broken",
        '{"ts": "2024-01-11T20:00:00Z", "articles": [{"url": "https://a.com/1", "title": "One again"}]}',
        '{"ts": "2024-01-12T00:00:00Z", "text": "*Deals*\\n• <https://a.com/2|Two> (Paper, 24.01.12)\\nnoise"}',
    ]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines))
    got = {r.identity: (r.title, r.category, r.edition_date) for r in archive.read_archive(spark, str(path)).collect()}
    assert got == {"url:https://a.com/1": ("One again", None, "2024-01-12"), "url:https://a.com/2": ("Two", "Deals", "2024-01-12")}
    _, errors = archive.parse_lines(spark.createDataFrame(list(enumerate(lines)), "seq int, value string"))
    assert [r.seq for r in errors.collect()] == [1]


def test_append_then_read(spark, tmp_path):
    rows = spark.createDataFrame([(0, "c", "r", "T", "https://a.com/9", "s")], "ord int, category string, region string, title string, url string, source string")
    archive.append_edition(rows, str(tmp_path / "out"), "2024-01-10", "2024-01-10T00:00:00Z")
    assert archive.read_archive(spark, str(tmp_path / "out")).first().title == "T"


def test_list_pages_and_mail(spark):
    html = '<ul><li><a href="https://a.com/news/1">Short</a><a href="https://a.com/news/1">A much longer title</a><time datetime="2024-01-01"></time></li><li><a href="https://b.com/news/2">Elsewhere</a></li></ul>'
    assert pages.semantic_items(html, ["a.com"], "^/news", 3) == [("https://a.com/news/1", "A much longer title", "2024-01-01")]
    mail = EmailMessage()
    mail["Subject"], mail["From"] = "Hello", "n@x.com"
    mail.set_content("plain")
    mail.add_alternative('<p><a href="https://a.com/story">This is a long headline of a story</a></p>', subtype="html")
    parsed = pages.parse_mail(spark.createDataFrame([(1, bytearray(mail.as_bytes()))], "uid int, content binary"))
    links = pages.mail_links(parsed).collect()
    assert [(r.url, r.title) for r in links] == [("https://a.com/story", "This is a long headline of a story")]


def test_sections_and_context():
    html = "<h2>Big deal</h2><p>" + "words " * 40 + '<a href="https://a.com/x">source</a></p><h2>No link</h2><p>' + "words " * 60 + "</p>"
    assert [(h, link) for h, _, link in pages.section_stories(html)] == [("Big deal", "https://a.com/x")]
    page = '<div><div><a href="u1">Headline one</a> lead text</div><p>More of it.</p><p><a href="u2">other</a></p></div>'
    assert pages.article_context(page, {"u1": "Headline one"}) == {"u1": "Headline one lead text More of it."}


def test_long_editions_keep_their_order(spark):
    """An edition of 1,500 articles does not outrun the line after it, which tells one of them anew."""
    article = '{"url":"https://a.com/%d","title":"%s","source":"s"}'
    first = '{"version":3,"edition_date":"2024-01-10","articles":[%s]}' % ",".join(article % (i, "old") for i in range(1500))
    later = '{"version":3,"edition_date":"2024-01-11","articles":[%s]}' % (article % (1400, "new"))
    got = archive.read_lines(spark.createDataFrame([(0, first), (1, later)], "seq bigint, value string")).where("url = 'https://a.com/1400'").first()
    assert got.title == "new" and (got.seq.line, got.first_seen.line, got.first_seen.article) == (1, 0, 1400)


def test_configured_lists_and_direct_pages(spark):
    page = searches.ListPage("title", "sum", "https://x.com/")
    html = "<div class='item'><h3 class='big title'><a href='https://x.com/20240110/a'>First &amp; one</a></h3><p class=sum>Said <b>so</b></p></div><h3 class=title><a href='https://y.com/b'>Other</a></h3><h3 class=title><a href='https://x.com/20240110/a'>Again</a></h3><h3 class=title><a href='https://x.com/20231201/c'>Old one</a></h3><h3 class=title><a href='https://x.com/d'>No date</a></h3>"
    assert searches.configured_items(html, page) == [("First & one", "https://x.com/20240110/a", "Said so"), ("Old one", "https://x.com/20231201/c", ""), ("No date", "https://x.com/d", "")]
    rows = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    day = F.lit("2024-01-11").cast("date")
    assert [r.title for r in searches.direct_pages(rows, page, day).orderBy("pos").collect()] == ["First & one", "No date"]
    assert [r.title for r in searches.direct_pages(rows, page, day, require_date=True).collect()] == ["First & one"]


def test_search_fetches_each_url_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def transport(url):
        import os
        import uuid

        open(os.path.join(asked, uuid.uuid4().hex), "w").close()
        if "bad" in url:
            raise OSError("down")
        return ('{"hits":[%s]}' % ",".join('{"title":"T%d","url":"https://a.com/%d","objectID":"%d","created_at":"2024-01-01","story_text":"%s"}' % (i, i % 4, i, "x" * 600) for i in range(7))).encode()

    requests = searches.search_requests(spark, ["one", "bad", "one", "two", "five"], "https://api.test/s", 0)
    assert requests.count() == 4
    replies = searches.shared(requests, transport).cache()
    assert {(r.ord, r.error) for r in replies.collect()} == {(0, None), (1, "OSError: down"), (2, None), (3, None)}
    assert len(list(asked.iterdir())) == 3
    hits = searches.search_hits(replies).orderBy("ord", "pos").collect()
    assert [(r.ord, r.title, len(r.description)) for r in hits] == [(0, f"T{i}", 500) for i in range(4)]


def test_mailbox_scan_and_query(spark):
    mails = spark.createDataFrame([(i, "A@x.com" if i % 10 == 0 else "b@y.com", i) for i in range(60)], "uid int, sender string, received int")
    got = [r.uid for r in searches.mailbox_scan(mails, ["a@x.com", "none@z.com"], newest=5, each=3).orderBy("place").collect()]
    assert got == [59, 58, 57, 56, 55, 50, 40, 30]
    assert searches.mail_query('News "x"', ["a@x.com", "b@y.com"], 3) == 'label:"News \\"x\\"" {from:"a@x.com" from:"b@y.com"} newer_than:3d'


def test_state_and_sets_fail_closed(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"key":"a"}\n')
    bad.write_text('{"key":"a"}\n{broken\n')
    assert searches.read_state(spark, str(good), "key string").count() == 1
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        searches.read_state(spark, str(bad), "key string").collect()
    for text in ("[NaN]", "{}", "[1]", '[{"x": Infinity}]'):
        with pytest.raises(ValueError):
            searches.load_objects(text)
    with pytest.raises(ValueError, match="maybe"):
        searches.load_eval_set(spark, '[{"label":"maybe"}]')
    assert searches.load_eval_set(spark, '[{"label":"keep","title":"t"}]').first().title == "t"


def test_market_days_names_and_indicators(spark):
    days = [r.name for r in searches.business_days(spark, "2024-01-05", "2024-01-09").orderBy("ord").collect()]
    assert days == ["20240105", "20240108", "20240109"]
    replies = spark.createDataFrame([("20240105", b'{"items":[{"name":"KO SPI 200","close":"1,300.5"},{"name":"x","close":"1"}]}', None), ("20240108", None, "down")], "name string, body binary, error string")
    assert [(str(r.day), r.value) for r in searches.named_closes(replies, "kospi200").collect()] == [("2024-01-05", 1300.5)]
    point = spark.createDataFrame([("k", "2024-01-02", 1.0, 1, 0)], "key string, day string, value double, page int, pos int").withColumn("day", F.col("day").cast("date"))
    pages_read = []

    def read(page):
        pages_read.append(page)
        return point.withColumn("day", F.date_sub("day", page)).withColumn("page", F.lit(page))

    assert searches.paged(read, F.lit("2023-12-30").cast("date")).count() == 3 and pages_read == [1, 2, 3]
    rows = searches.indicators([("a", lambda: point), ("b", lambda: 1 / 0), ("c", lambda: point)], spark).orderBy("ord").collect()
    assert [(r.key, len(r.points), r.error) for r in rows] == [("a", 1, None), ("b", 0, "ZeroDivisionError: division by zero"), ("c", 1, None)]


def test_usage_bodies_and_permalinks(spark):
    calls = spark.createDataFrame([("m", None, 5, 1), ("m", "late", None, None), ("n", None, 2, 2)], "model string, error string, input_tokens int, output_tokens int")
    assert {tuple(r) for r in searches.usage(calls).collect()} == {("m", 2, 1, 5, 1), ("n", 1, 0, 2, 2)}
    body = "word " * 80
    assert pages.primary_body(f"<div class='post-body'>short</div><div class='wrap'><div class='post-body x'><p>{body}</p></div></div>", ["post-body"]) == body.strip()
    assert pages.primary_body("<div class='post-body'>short</div>", ["post-body"]) == "" == pages.primary_body(None, ["a"])
    urls = spark.createDataFrame([("https://mail.pub.com/p/the-story?x=1",), ("https://other.com/p/a",), (None,)], "u string")
    out = [r[0] for r in urls.select(pages.public_story_url(F.col("u"), "mail.pub.com", r"/p/([a-z-]+)", "https://pub.com/p/{}")).collect()]
    assert out == ["https://pub.com/p/the-story", None, None]


def test_issue_leads_and_weekly_records(spark, tmp_path):
    html = "<p>Hello</p><p>This week: " + "words " * 50 + "</p><p>more</p><p>Forwarded? tail</p><p>x</p><p>y</p>"
    (title, lead), = pages.issue_lead(html, "Letter: Big week", "Letter:", "This week", ends=("Forwarded?",))
    assert title == "Big week" and lead.startswith("This week: words") and lead.endswith("more")
    for subject, prefix, marker in (("Other", "Letter:", "This week"), ("Letter: x", "Letter:", "absent"), ("Letter:", "Letter:", "This week"), (None, "Letter:", "This week")):
        assert pages.issue_lead(html, subject, prefix, marker) == []
    assert pages.issue_lead("<p>This week</p>", "Letter: x", "Letter:", "This week") == []
    rows = spark.createDataFrame([(1, "c", "B"), (0, "c", "A")], "ord int, category string, title string")
    archive.append_weekly(rows, str(tmp_path / "w"), first="2024-01-01", last="2024-01-07", sent_at="2024-01-08", candidates=9, text="t", errors=["late"])
    out = spark.read.json(str(tmp_path / "w")).first()
    assert (out.article_count, out.candidate_count, out.market_health.complete, [a.title for a in out.articles]) == (2, 9, False, ["A", "B"])


def test_posting_falls_back_once():
    table = {"type": "table", "rows": [["h"], ["a", "b"], ["c", "d"]]}
    posted = []

    def post(payload, replies=iter(["invalid_blocks", "ok", "timeout", "invalid_blocks"])):
        posted.append(payload)
        return next(replies)

    assert render.post_once({"blocks": [table]}, post) == ("ok", True)
    assert [b["text"]["text"] for b in posted[1]["blocks"]] == ["a · b", "c · d"]
    assert render.post_once({"blocks": [table]}, post) == ("timeout", False) and render.post_once({"blocks": [{"type": "section"}]}, post) == ("invalid_blocks", False)
    assert len(posted) == 4
    with pytest.raises(ValueError, match="more than 50"):
        render.without_tables([{"type": "table", "rows": [["h"], *[["x"]] * 51]}])


def test_too_many_blocks_fail(spark):
    digests = spark.range(51).select(F.format_string("c%02d", "id").alias("category"), F.lit("x").alias("digest"))
    assert render.blocks(digests.limit(50)).first().blocks.startswith('[{"type":"section"')
    with pytest.raises(Exception, match="more than 50 blocks"):
        render.blocks(digests).collect()


def test_keys_land_once_across_batches(spark, tmp_path):
    sink = streams.deliver_batches(str(tmp_path / "out"), "k")
    batches = [[(1, "a"), (1, "a")], [(1, "b"), (2, "b")], [(2, "c"), (3, "c")]]
    for number in (0, 1, 0, 2, 1):
        sink(spark.createDataFrame(batches[number], "k int, v string"), number)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_feed_source_isolates_failures(spark, tmp_path):
    good = tmp_path / "good.xml"
    good.write_bytes(b"<rss><channel><item><title>A\x0b</title><link>https://a.com/1</link><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>")
    spark.dataSource.register(feeds.FeedSource)
    rows = spark.read.format("skein_feed").option("sources", f"bad=file:///nowhere.xml|good=file://{good}").load().orderBy("ord").collect()
    assert [(r.feed, r.title) for r in rows] == [("bad", None), ("good", "A")] and rows[0].error


def test_market_parsers(spark):
    lines = spark.createDataFrame([("observation_date,X",), ("2024-01-02,4.5",), ("2024-01-03,.",), ('2024-01-04,"1',), ("2024-01-05,",)], "value string")
    assert [(str(r.day), r.value) for r in market.csv_points(lines, F.lit("x")).collect()] == [("2024-01-02", 4.5)]
    reply = '{"StatisticSearch":{"list_total_count":2,"row":[{"STAT_CODE":"S","ITEM_CODE1":"I","UNIT_NAME":"U","TIME":"20240102","DATA_VALUE":"1,300.5"},{"STAT_CODE":"S","ITEM_CODE1":"I","UNIT_NAME":"U","TIME":"20240102","DATA_VALUE":"%s"}]}}'
    replies = spark.createDataFrame([("ok", reply % "1300.5"), ("clash", reply % "9"), ("cut", reply.replace(":2,", ":3,") % "1300.5")], "key string, value string")
    points, errors = market.statistic_points(replies, "S", "I", "U")
    assert [(r.key, r.value) for r in points.collect()] == [("ok", 1300.5)]
    assert {(r.key, r.error) for r in errors.collect()} == {("clash", "conflicting_values"), ("cut", "truncated")}


def test_packing_and_delivery(spark):
    lines = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 4, 5, 50, 1])], "g int, o int, size int")
    assert [r.message for r in render.pack_lines(lines, "g", "o", "size", 10).orderBy("o").collect()] == [1, 1, 2, 3, 4]
    rows, sent, posted = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), []
    assert render.deliver_once(rows, sent, "k", posted.extend).count() == 1 and [r.k for r in posted] == [2]


def test_replay_cache(spark):
    rows = spark.createDataFrame([(0, "p"), (1, "q")], "ord int, prompt string")
    cache = rows.where("ord = 0").select(cache_key("m", F.col("prompt")).alias("key"), F.lit("yes").alias("reply"))
    answered, missing = cached(rows, cache, "m")
    assert [r.reply for r in answered.collect()] == ["yes"] and [r.error for r in missing.collect()] == ["replay_miss"]
