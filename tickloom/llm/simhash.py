"""SimHash near-duplicate components with a covering family of bit masks.

The family: every bit position i gets a vector m(i) in F2^(r+1); table v (a non-zero vector) keeps the bits with
<m(i), v> = 1. Up to r differing positions span at most r dimensions, so some v is orthogonal to all of them and
the two fingerprints agree in table v: no pair within radius r is missed (r = 3: 15 tables of about 34 bits).

`drop_near_duplicates` can also link texts by the Jaccard similarity of their word shingles. Candidates share one of
BANDS bands of BAND_ROWS MinHash values (a pair at 0.8 shares none with a chance of 3 in 100,000). Texts of one shingle
set are looked at once. Every text points to the first one of each of its bands; within a component of these pointers,
the texts are dealt into blocks, each pair of blocks is one bounded group, and there the similarity of candidates is
computed from all their shingles' 64-bit hashes. No pair of candidates is written, only the edges of a forest.

Texts are never moved to be told apart by name: a bitmap of the candidates' (or dropped) names decides in place for nearly
all rows, and only those it lets through are looked up. Candidates move as shingle hashes, by name and by group.

Defined results: null text counts as empty; an empty text has fingerprint 0 and links like any other; repeated
doc_ids keep one row each; a component whose ids are all null has a null id; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bitmap, row_key
from .graph import components

BITS = 64
SEED = 42
#: Rows of one block of a bucket: two blocks meet in a task and are compared there.
BLOCK = 1024
#: Bands of MinHash values and values in a band; texts and shingles of a block in which similarities are computed.
BANDS, BAND_ROWS = 20, 4
TEXTS, SHINGLES = 512, 1 << 19
#: Bytes of a bitmap of names, and its bits as a power of two, at most; a fuller one lets more rows through to the look-up.
BROADCAST_BYTES, FILTER_BITS = 16 << 20, 22


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bit over the XXH64 of all word shingles of a UTF-8 text, repeats included."""
    words = text.lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """Null is the empty text."""
    for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield t.as_py() or b""


def fingerprints(docs: DataFrame, width: int = 3, sketched: int | None = None, key: Column | None = None) -> DataFrame:
    """(doc_id, fp), `key` if an expression for it is given, and, if a number of words is given for `sketched`, `shingles`
    (the name of the text's set of shingles of so many words), its `bands`, both null for a text without words, and its
    `size`. fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _sketcher() if sketched else None
        for b in batches:
            fps, sets, bands, sizes = [], [], [], []
            for t in _bytes(b.column(0)):
                fps.append(fingerprint(t, width))
                if sketch:
                    h = _shingle_hashes(t, sketched)
                    sets.append(xxhash.xxh128_digest(h.tobytes()) if len(h) else None)
                    bands.append(sketch(h) if len(h) else None)
                    sizes.append(len(h))
            out = [*b.columns[1:], pa.array(np.array(fps, dtype=np.uint64).view(np.int64))]
            if sketch:
                out += [pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.record_batch(out, names=names)

    wanted = [F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")]
    shape = {"doc_id": "long"}
    if key is not None:
        wanted.append(key.alias("key"))
        shape["key"] = "binary"
    shape["fp"] = "long"
    if sketched:
        shape |= {"shingles": "binary", "bands": "array<long>", "size": "long"}
    names = list(shape)
    return docs.select(*wanted).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in shape.items()))


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """The 2^(radius+1)-1 masks; positions are dealt evenly over the non-zero vectors."""
    n = 1 << (radius + 1)
    of = [i % (n - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(of) if (m & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges from the smallest member of each linked set of one block pair to the others."""
    rest = np.unique(fps)
    while len(rest) > 1:
        member, front = [rest[:1]], rest[:1]
        rest = rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count(front[i : i + 256, None] ^ rest[None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            member.append(front)
        all_ = np.concatenate(member)
        if len(all_) > 1:
            yield np.full(len(all_) - 1, all_[0]), all_[1:]


def links(fps: DataFrame, scratch: Scratch, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(u, v): a spanning forest, per bucket, of the distinct fingerprints within the radius.

    A bucket of k fingerprints is dealt into ceil(k / block) blocks, and each pair of blocks is one bounded group, so
    no task holds a whole hot bucket and no pair is lost. Only tree edges leave a task, never all pairs.
    """
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("t", "key"))
    # written first, so that the join reads a plain table and adaptive execution can split a hot bucket's rows
    sizes = scratch.keep(keyed.groupBy("t", "key").agg(F.count("*").alias("k")).where("k > 1"))
    full = keyed.join(sizes, ["t", "key"]).withColumn("g", F.ceil(F.col("k") / block).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    dealt = full.select("t", "key", "fp", mine.alias("b"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    groups = dealt.groupBy("t", "key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for x in b.column(0):
                for root, leaf in _forest(x.values.to_numpy().view(np.uint64), radius):
                    u.append(root)
                    v.append(leaf)
            u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (u, v))
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return groups.where(F.size("fps") > 1).select("fps").mapInArrow(run, "u long, v long").distinct()


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Distinct XXH64 of the word shingles; a text of fewer words is its only shingle, an empty one has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64))


def _sketcher():
    """A function from shingle hashes to the names of their bands."""
    rng = np.random.default_rng(SEED)
    size = BANDS * BAND_ROWS
    mult, plus = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def sketch(h: np.ndarray) -> list[int]:
        low = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(h), 4096):
            x = h[i : i + 4096, None] * mult + plus
            low = np.minimum(low, ((x ^ (x >> np.uint64(32))) * mult).min(axis=0))
        return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low.reshape(BANDS, BAND_ROWS))]

    return sketch


def _alike(bands: np.ndarray, sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Edges from the first member of each linked set of one pair of blocks to the others. A pair is linked if it shares
    a band and a share `least` of its shingles."""
    rest, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    while len(rest) > 1:
        root, front, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            a = sizes[i]
            maybe = (bands[rest] == bands[i]).any(axis=1) & (np.minimum(sizes[rest], a) >= least * np.maximum(sizes[rest], a) - 1e-9)
            near = np.zeros(len(rest), dtype=bool)
            for k in np.flatnonzero(maybe):
                j = rest[k]
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                near[k] = common >= least * (a + sizes[j] - common) - 1e-9
            for j in rest[near]:
                yield root, int(j)
                front.append(int(j))
            rest = rest[~near]


def _named(names: DataFrame):
    """A test whether a row name can be among those in the column key."""
    held = bitmap(names.select(F.xxhash64("key").alias("h")), names.count(), min(FILTER_BITS, (8 * BROADCAST_BYTES).bit_length()), apart=True)
    return lambda key: held(F.xxhash64(key))


def similar(docs: DataFrame, key: Column, marked: DataFrame, scratch: Scratch, least: float, width: int = 5, block: int = TEXTS) -> DataFrame:
    """(u, v): fingerprints of texts whose shingles have a Jaccard similarity of `least` or more, as a forest.
    marked(key, fp, shingles, bands, size): of each row of docs."""
    marked = marked.where("shingles is not null")
    one = scratch.keep(marked.groupBy("shingles").agg(F.min(F.struct("key", "fp", "bands", "size")).alias("x")).select("shingles", "x.*"))
    same = marked.select("shingles", "fp").distinct().join(one.select("shingles", F.col("fp").alias("first")), "shingles").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    # pointers from each text to the first of its bands; names that meet by chance only make a component larger
    flat = scratch.keep(one.select(F.xxhash64("key").alias("node"), F.posexplode("bands").alias("band", "value")))
    firsts = scratch.keep(flat.groupBy("band", "value").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("band", "value", "first"))
    pointers = flat.join(firsts, ["band", "value"]).where("node > first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    found = components(pointers, scratch)
    scratch.drop(flat, firsts)
    members = scratch.keep(one.join(found, F.xxhash64("key") == F.col("node")).select("key", "fp", "bands", "size", "label"))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / SHINGLES)).cast("int")
    members = scratch.keep(members.join(members.groupBy("label").agg(blocks.alias("g")), "label").select("key", "fp", "bands", "label", "g"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [_shingle_hashes(t, width).view(np.int64) for t in _bytes(x.column(1))]
            yield pa.record_batch([x.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "hashes"])

    named = _named(members)
    texts = docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).where(named(F.col("key")))
    full = texts.mapInArrow(hashed, "key binary, hashes array<long>").dropDuplicates(["key"]).join(members, "key")
    mine = F.pmod(F.xxhash64("key"), F.col("g")).cast("int")
    dealt = full.select("label", F.struct("fp", "bands", "hashes").alias("x"), mine.alias("b"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    groups = dealt.groupBy("label", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")).agg(F.collect_list("x").alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for xs in batch.column(0):
                x = xs.values
                bands = x.field(1).flatten().to_numpy().reshape(-1, BANDS)
                fps = x.field(0).to_numpy()
                for i, j in _alike(bands, [y.values.to_numpy().view(np.uint64) for y in x.field(2)], least):
                    u.append(fps[i])
                    v.append(fps[j])
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    near = groups.where(F.size("xs") > 1).select("xs").mapInArrow(run, "u long, v long").where("u <> v")
    out = scratch.keep(near.unionByName(same).distinct())
    scratch.drop(one, members)
    return out


def _labelled(fps: DataFrame, scratch: Scratch, radius: int, more: DataFrame | None = None) -> DataFrame:
    """fps(doc_id, fp, ...) with component_id. Copies meet in one fingerprint before any pair is looked at. more: links
    (u, v) besides those within the radius."""
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = links(reps, scratch, radius)
    if more is not None:
        edges = edges.unionByName(more).distinct()
    labels = scratch.keep(components(edges, scratch))
    merged = scratch.keep(reps.join(labels, F.col("fp") == F.col("node")).select("fp", "rep", "label"))
    least = scratch.keep(merged.groupBy("label").agg(F.min("rep").alias("least"), F.min("fp").alias("root")))
    merged = scratch.keep(merged.join(least, "label").select("fp", "least", "root"))
    known = reps.join(merged, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return fps.join(scratch.keep(known), "fp")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """documents -> (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most
    `radius` differing bits."""
    scratch = Scratch(docs.sparkSession, "simhash")
    return _labelled(scratch.keep(fingerprints(docs, width)), scratch, radius).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, jaccard: float | None = None) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (nulls last), with all columns. Rows are named
    by 128 bits of id and text, so repeated ids do no harm. jaccard: the similarity of five-word shingles from which texts
    are linked whatever their fingerprints."""
    scratch = Scratch(docs.sparkSession, "simhash")
    key = row_key()
    fps = scratch.keep(fingerprints(docs, width, 5 if jaccard else None, key))
    more = None if jaccard is None else similar(docs, key, fps, scratch, jaccard)
    all_ = scratch.keep(_labelled(fps, scratch, radius, more).select("doc_id", "key", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    first = scratch.keep(all_.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.key").alias("chosen")))
    dropped = all_.select("key").distinct().join(first, F.col("key") == F.col("chosen"), "left_anti")
    dropped = scratch.keep(dropped)
    # rows repeated as a whole: one of each stays
    same = all_.join(first, F.col("key") == F.col("chosen"), "left_semi").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    named = _named(scratch.keep(dropped.unionByName(same.select("key"))))
    rows = docs.withColumn("__row_key", key)
    maybe = named(F.col("__row_key"))
    looked_up = rows.where(maybe).dropDuplicates(["__row_key"]).join(dropped.select(F.col("key").alias("__dropped_key")), F.col("__row_key") == F.col("__dropped_key"), "left_anti")
    return rows.where(~maybe).unionByName(looked_up).drop("__row_key")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
