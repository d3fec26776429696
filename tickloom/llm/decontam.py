"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles. DataFrame
functions only.

An item of n distinct five-word shingles leaks into a document that holds at least THRESHOLD of them, that is
need = ceil(0.8 n). The item's sketch is its bottom-k MinHash sketch with k = n - need + 1: a document that holds `need`
of the shingles misses at most k - 1, so it holds at least one of the k with the smallest hashes. Recall is therefore
1, however long the document is; MinHash of the long side is never needed. Documents are partitioned by their number of
distinct shingles (powers of two). A partition's upper bound tells which items can be contained in its documents at
all, and the largest sketch hash of those items is the partition's hash bound. A bitmap of at most 2^FILTER_BITS bits
holds the sketches' hashes: only document shingles under the bound and in the bitmap are looked up.

One pass over the texts writes, for the few documents with such shingles, these hashes and all shingles that a second
bitmap, of the items' whole vocabulary, lets through. The look-up and the exact check of the shingles themselves use that
table alone: texts are neither read again nor moved.

Defined results: words are lower-cased runs without white space; a text of one to four words has itself as its only
shingle, an empty or null text has none and neither leaks nor is leaked into; repeated rows give one row per (doc_id,
item_id), with the largest overlap; null ids stay null and are grouped like any value; other columns are ignored;
an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, row_key, words

WIDTH = 5
#: Containment from which a document counts as contaminated, in tenths.
THRESHOLD = 8
#: Bytes of the benchmark's shingles up to which they are broadcast; beyond, joins shuffle and adaptive execution splits
#: popular items.
BROADCAST_BYTES = 16 << 20
#: Bits of a bitmap, as a power of two, at most; fuller bitmaps let more through to the exact check.
FILTER_BITS = 22


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _places(w: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the word shingles, one a place, from hashes of words, pairs and fours."""
    assert width == 5
    n = F.size(w)
    one = F.transform(w, lambda x: F.xxhash64(x))

    def pair(a: Column, b: Column, gap: int) -> Column:
        return F.zip_with(a, F.slice(b, gap + 1, F.greatest(F.size(b) - gap, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    def five(h: Column) -> Column:
        return _let(pair(h, h, 1), lambda two: pair(pair(two, two, 2), h, 4))

    long = F.slice(_let(one, five), 1, F.greatest(n - (width - 1), F.lit(1)))
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(n >= width, long).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def _texts(w: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves."""
    n = F.size(w)
    long = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.when(n > 0, F.array_distinct(long)).otherwise(F.array().cast("array<string>"))


def _lowered() -> Column:
    return words(F.lower(F.col("text").cast("string")))


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc_id, item_id, n_shared, n_item) of documents and the items contained in them."""
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", _lowered().alias("w")).dropDuplicates(["item"])
    items = items.select("item", "item_id", F.array_distinct(_places(F.col("w"))).alias("hashes"), _texts(F.col("w")).alias("shingles"))
    items = scratch.keep(items.where(F.size("hashes") > 0))
    size = F.aggregate("shingles", F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x) + 24)
    whole = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n = F.size("hashes")
    need = F.ceil(n * F.lit(THRESHOLD) / 10).cast("int")
    sketches = scratch.keep(items.select("item", need.alias("need"), F.explode(F.slice(F.array_sort("hashes"), 1, n - need + 1)).alias("h")))
    n_flat = sketches.count()
    # by size class of the documents (number of bits of the shingle count): the largest hash worth a look-up
    top = {r["c"]: r["h"] for r in sketches.groupBy(F.length(F.bin("need")).alias("c")).agg(F.max("h").alias("h")).collect()}  # at most 64 rows
    sketched, known = bitmap(sketches, n_flat, FILTER_BITS), bitmap(items.select(F.explode("hashes").alias("h")), whole["n"], FILTER_BITS)

    def bound(c: Column) -> Column:
        out = F.lit(None).cast("long")
        for k in sorted(top):
            out = F.when(c >= k, F.lit(max(h for x, h in top.items() if x <= k))).otherwise(out)
        return out

    def looked_up(h: Column) -> Column:
        return _let(F.array_distinct(h), lambda d: _let(bound(F.length(F.bin(F.size(d)))), lambda b: F.struct(F.size(d).alias("n"), F.filter(d, lambda x: (x <= b) & sketched(x)).alias("hits"))))

    def known_texts(w: Column, h: Column) -> Column:
        tagged = F.filter(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), lambda t: known(t["h"]))
        return F.array_distinct(F.transform(tagged, lambda t: F.array_join(F.slice(w, t["i"] + 1, WIDTH), " ")))

    def found(w: Column) -> Column:
        return _let(_places(w), lambda h: _let(looked_up(h), lambda x: F.when(F.size(x["hits"]) > 0, F.struct(x["n"].alias("n"), x["hits"].alias("hits"), known_texts(w, h).alias("theirs")))))

    passed = docs.select(row_key().alias("key"), "doc_id", _let(_lowered(), found).alias("x"))
    passed = scratch.keep(passed.where("x is not null").select("key", "doc_id", "x.n", "x.hits", "x.theirs"))
    hits = passed.select("key", "n", F.explode("hits").alias("h")).join(_small(sketches, 24 * n_flat), "h").where("n >= need")
    pairs = scratch.keep(hits.select("key", "item").distinct())
    # the exact check: what a document shares with the vocabulary of all items, against the items it may hold
    both = pairs.join(passed.select("key", "doc_id", "theirs").dropDuplicates(["key"]), "key").join(_small(items.select("item", "item_id", "shingles"), whole["bytes"]), "item")
    shared = both.select(
        "key", "doc_id", "item_id", F.size(F.array_intersect("shingles", "theirs")).cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_item")
    )
    return shared.where(F.col("n_shared") * 10 >= F.col("n_item") * THRESHOLD)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment), one row per leaked pair."""
    pairs = leaks(docs.select("doc_id", "text"), benchmark, Scratch(docs.sparkSession, "decontam"))
    most = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("x"))
    return most.select("doc_id", "item_id", "x.n_shared", "x.n_item", (F.col("x.n_shared") / F.col("x.n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    scratch = Scratch(docs.sparkSession, "decontam")
    bad = scratch.keep(leaks(docs.select("doc_id", "text"), benchmark, scratch).select("key").distinct())
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("name"))
    return rows.join(bad, F.col("name") == F.col("key"), "left_anti").select("row.*")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = """
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0),
bs as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from b, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0),
n as (select item_id, count(*) as n_item from bs group by item_id),
hit as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item, n_shared::double / n_item as containment
from hit join n using (item_id) where 10 * n_shared >= 8 * n_item"""
