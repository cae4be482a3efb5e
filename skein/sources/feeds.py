"""Python data sources for feeds and market series; the transport is injected, so tests stay offline."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def read_file(url: str) -> bytes:
    """Default transport: local files only."""
    from urllib.parse import urlsplit
    from urllib.request import url2pathname

    parts = urlsplit(url)
    if parts.scheme not in ("", "file"):
        raise OSError(f"no transport for {parts.scheme}")
    with open(url2pathname(parts.path), "rb") as f:
        return f.read()


def parse_feed(raw: bytes) -> list[dict[str, str]]:
    """Items of RSS or Atom: title, link, date, description; control characters are stripped once on failure."""
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        root = ET.fromstring(CONTROL.sub(b"", raw))
    out = []
    for item in root.iter():
        if item.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        found = {}
        for child in item:
            name = child.tag.rpartition("}")[2]
            found.setdefault(name, (child.text or child.get("href") or "").strip())
        out.append({"title": found.get("title", ""), "link": found.get("link", ""), "date": found.get("pubDate") or found.get("published") or found.get("updated", ""), "description": found.get("description") or found.get("summary", "")})
    return out


class FeedPartition(InputPartition):
    def __init__(self, ord: int, name: str, url: str):
        super().__init__(ord)
        self.ord, self.name, self.url = ord, name, url


class FeedReader(DataSourceReader):
    """One partition a source; a source that fails gives one error row, the others go on."""

    def __init__(self, sources: list[tuple[str, str]], transport: Callable[[str], bytes]):
        self.sources, self.transport = sources, transport

    def partitions(self) -> list[FeedPartition]:
        return [FeedPartition(i, name, url) for i, (name, url) in enumerate(self.sources)]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        try:
            for n, item in enumerate(parse_feed(self.transport(partition.url))):
                yield (partition.ord << 40) + n, partition.name, item["title"], item["link"], item["date"], item["description"], None
        except (OSError, ET.ParseError) as e:
            yield partition.ord << 40, partition.name, None, None, None, None, f"{type(e).__name__}: {e}"[:300]


class FeedSource(DataSource):
    """spark.read.format("skein_feed").option("sources", "name=url|name=url"): rows in the order of sources (ord: source * 2^40 + item)."""

    transport = staticmethod(read_file)

    @classmethod
    def name(cls) -> str:
        return "skein_feed"

    def schema(self) -> str:
        return "ord bigint, feed string, title string, link string, date string, description string, error string"

    def reader(self, schema) -> FeedReader:
        pairs = [p.partition("=") for p in self.options["sources"].split("|")]
        return FeedReader([(name, url) for name, _, url in pairs], self.transport)
