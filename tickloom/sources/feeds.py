"""Feed, page and record parsing with the standard library, partition by partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "feed_id string, item_id string, title string, link string, published string, summary string"


def parse_feed(text: str) -> list[tuple]:
    """Items of an RSS or Atom document: (id, title, link, published, summary); nothing for broken XML. Dates fall back
    from pubDate to published to updated to the namespaced date."""
    import xml.etree.ElementTree as ET

    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []

    def name(e) -> str:
        return e.tag.rsplit("}", 1)[-1].lower()

    out = []
    for item in root.iter():
        if name(item) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for e in item:
            value = (e.text or "").strip()
            if name(e) == "link" and not value:
                value = e.get("href", "")
            if value:
                got.setdefault(name(e), value)
        date = next((got[k] for k in ("pubdate", "published", "updated", "date") if k in got), None)
        link = got.get("link")
        out.append((got.get("guid") or got.get("id") or link, got.get("title"), link, date, got.get("description") or got.get("summary")))
    return out


def feed_items(feeds: DataFrame) -> DataFrame:
    """feeds(feed_id, xml) -> one row per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, *x) for f, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in parse_feed(xml or "")]
            names = [x.split()[0] for x in ITEM.split(", ")]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    return feeds.select(F.col("feed_id").cast("string"), F.col("xml").cast("string")).mapInArrow(run, ITEM)


def published(text: Column | str) -> Column:
    """RFC 822 or ISO time, or missing."""
    t = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3}, *", ""), " (?:GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))


def article_text(html: str | None, first: tuple[str, ...] = ("article", "main", "body")) -> str:
    """Text of the first of the given elements that is there, without scripts and styles, one line per text run."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth = dict.fromkeys(first, 0)
            self.skip, self.out = 0, {k: [] for k in first}

        def handle_starttag(self, tag, attrs):
            if tag in self.depth:
                self.depth[tag] += 1
            self.skip += tag in ("script", "style", "noscript")

        def handle_endtag(self, tag):
            if tag in self.depth and self.depth[tag]:
                self.depth[tag] -= 1
            if tag in ("script", "style", "noscript") and self.skip:
                self.skip -= 1

        def handle_data(self, data):
            for k, d in self.depth.items():
                if d and not self.skip and data.strip():
                    self.out[k].append(" ".join(data.split()))

    r = Reader()
    r.feed(html or "")
    r.close()
    return next(("\n".join(r.out[k]) for k in first if r.out[k]), "")


def article_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text)."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([article_text(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"{key} {kind}, text string")


def json_records(df: DataFrame, text: str, schema: T.StructType | str) -> DataFrame:
    """df with the records of a JSON array exploded into columns; trailing commas are tolerated."""
    fixed = F.regexp_replace(F.col(text), r",(\s*[\]}])", "$1")
    parsed = F.from_json(fixed, f"array<struct<{schema}>>" if isinstance(schema, str) else T.ArrayType(schema))
    return df.select("*", F.explode(parsed).alias("__r")).select(*df.columns, "__r.*")


def table_cells(html: Column | str) -> Column:
    """Rows of the tables in a page as arrays of cell texts."""
    h = F.col(html) if isinstance(html, str) else html
    rows = F.regexp_extract_all(h, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))))
