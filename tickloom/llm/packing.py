"""Packing of token pieces into sequences of a fixed size by a configuration linear program.

Only the histogram of piece lengths (at most `size` numbers) reaches the driver. The program over configurations
(multisets of lengths that fit a sequence) is solved by multiplicative weights: lengths are the experts, a length's
weight falls exponentially with the share of its demand that is covered, and a knapsack dynamic program prices the best
configuration under the current weights; the same prices give a lower bound. The fractional counts are rounded down,
what is left over is the demand of a second and a third program, and the last rest is packed by best-fit decreasing on
its histogram, which also shares the free room of the configurations. The result is a list of runs (so many sequences of one layout); every piece finds its place from its rank among the pieces of its length.

Defined results: null text counts as empty (one piece that holds only the end id); repeated rows and ids, null ids
included, are packed one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import tokenizer

SIZE = 2048
END_ID = 0
#: Rounds of multiplicative weights, the share of a length's demand that one round may cover, the rate of the weights.
ROUNDS, STEP, RATE = 500, 0.2, 6.0
#: Programs in a row, each over what the one before left over, the later ones of a quarter of the rounds.
PROGRAMS = 3
#: Shares of the fractional counts that are rounded down in turn; the packing with the fewest sequences stays. With none
#: of them the rest is everything, which is best-fit decreasing alone.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)
#: Words whose ids a worker remembers.
MEMORY = 600_000
CLOSING = frozenset(b".,;:!?")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds:
    """Token ids of whole texts, word by word: the normaliser and the pre-tokenizer of the vocabulary treat each run
    without white space by itself (white space is dropped and ends every token), so the ids of a text are those of its
    words in turn. Words are remembered as bytes of unsigned 32-bit ids. A word of Latin letters only is one piece to
    the pre-tokenizer, so after lower-casing it goes straight to the library's model; all others go through the whole
    tokenizer."""

    def __init__(self, path: str):
        self.tok, self.known, self.letters = tokenizer(path), {}, _byte_letters()
        self.model = self.tok.model

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > MEMORY:  # the words met first are the frequent ones
            self.known = dict(islice(self.known.items(), MEMORY // 2))
        get = self.known.get
        # A-Z are lower-cased by the normaliser anyway, unless they are in a special string, which begins with <|
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(get, words)) for words in split]
        new = {w for words, ids in zip(split, found, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            self._learn(new)
            known = self.known
            found = [[known[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids for words, ids in zip(split, found, strict=True)]
        return list(map(b"".join, found))

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        # one closing mark after a letter or digit is a token of its own
        closed = [w for w in new if len(w) > 1 and w[-1] in CLOSING and w[-2:-1].isalnum()]
        new.difference_update(closed)
        new.update(x for w in closed for x in (w[:-1], w[-1:]) if x not in known)
        todo = []
        for w in new:
            s = w.decode().lower()
            if not s.isalpha():
                todo.append(w)
                continue
            if not s.isascii():
                if max(s) >= "\u0250":
                    todo.append(w)
                    continue
                s = s.encode().decode("latin-1").translate(self.letters)
            known[w] = array("I", [t.id for t in self.model.tokenize(s)]).tobytes()
        for i in range(0, len(todo), 1024):
            part = todo[i : i + 1024]
            for w, e in zip(part, self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()
        for w in closed:
            known[w] = known[w[:-1]] + known[w[-1:]]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The remembered words of this Python worker, which serves many tasks."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(path), np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            texts = b.column(1).cast(pa.binary() if pa.types.is_string(b.schema.types[1]) else pa.large_binary())
            for k in range(0, b.num_rows, 256):
                names = b.column(0).slice(k, 256).to_pylist()
                for doc, x in zip(names, ids(texts.slice(k, 256).to_pylist()), strict=True):
                    x += end
                    for n, at in enumerate(range(0, len(x), 4 * size)):
                        part = x[at : at + 4 * size]
                        for column, value in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # many short lists and no cycles: collections would only scan them again and again
        try:
            yield from cut(batches)
        finally:
            gc.enable()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def price(weights: np.ndarray, lengths: np.ndarray, size: int) -> Counter:
    """The configuration of largest total weight (unbounded knapsack by dynamic programming over the room used)."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    lengths, weights = lengths[weights > 0], weights[weights > 0]
    fit = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for room in range(1, size + 1):
        n = fit[room]
        best[room] = best[room - 1]
        if n:
            value = best[room - lengths[:n]] + weights[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], last[room] = value[k], lengths[k]
    config, room = Counter(), size
    while room > 0:
        if last[room]:
            config[int(last[room])] += 1
            room -= int(last[room])
        else:
            room -= 1
    return config


def _fit_rest(rest: dict[int, int], room: dict[int, Counter], size: int) -> None:
    """Best-fit decreasing on a histogram. room: free tokens -> layouts (a sorted tuple of lengths) and their counts;
    it gets the pieces of rest, in the fullest sequence that still takes them or else in new ones."""
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            free = min((r for r, held in room.items() if r >= length and held), default=None)
            if free is None:
                each = size // length
                full, over = divmod(left, each)
                if full:
                    room.setdefault(size - each * length, Counter())[(length,) * each] += full
                if over:
                    room.setdefault(size - over * length, Counter())[(length,) * over] += 1
                break
            layout, count = next(iter(room[free].items()))
            each = min(free // length, left)
            use = min(count, left // each)
            room[free][layout] -= use
            if not room[free][layout]:
                del room[free][layout]
            room.setdefault(free - each * length, Counter())[layout + (length,) * each] += use
            left -= use * each


def program(demand: dict[int, int], size: int, rounds: int) -> tuple[Counter, float]:
    """Fractional counts of configurations, and a lower bound on the sequences that the demand needs.

    Each length is an expert whose first weight is its share of the volume, demand x length; the weight falls by
    exp(-RATE) as its demand gets covered. The price of one piece is the weight by unit of demand, and the best
    configuration under these prices gets a step. Prices scaled so that no configuration is worth more than one are
    feasible in the dual program, so the demand's worth under them is a lower bound (for whole and for fractional
    sequences)."""
    lengths = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[int(n)] for n in lengths], dtype=float)
    at = {int(n): i for i, n in enumerate(lengths)}
    first = need * lengths / size
    covered, chosen, bound = np.zeros(len(lengths)), Counter(), float(first.sum())
    for _ in range(rounds):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        prices = np.where(open_, first * np.exp(-RATE * (covered - covered.min())), 0) / need
        config = price(prices, lengths, size)
        worth = sum(prices[at[n]] * k for n, k in config.items())
        bound = max(bound, float((prices * need).sum() / worth))
        step = min(min(STEP, 1 - covered[at[n]]) * need[at[n]] / k for n, k in config.items())
        # a step covers as much of the scarcest length as it may, and at least one whole sequence
        step = max(step, min(1.0, min((1 - covered[at[n]]) * need[at[n]] / k for n, k in config.items())))
        chosen[tuple(sorted(config.elements(), reverse=True))] += step
        for n, k in config.items():
            covered[at[n]] = min(1.0, covered[at[n]] + k * step / need[at[n]])
    return chosen, bound


def _rounded(chosen: Counter, demand: dict[int, int], share: float, size: int) -> tuple[dict[int, Counter], dict[int, int]]:
    """Whole sequences: `share` of the fractional counts, rounded down. Free room -> layouts, and the demand left over."""
    room, rest = {}, dict(demand)
    for layout, x in chosen.items():
        held = Counter(layout)
        count = min(int(share * x + 1e-6), min(rest[n] // k for n, k in held.items()))
        if count > 0:
            room.setdefault(size - sum(layout), Counter())[layout] += count
            for n, k in held.items():
                rest[n] -= k * count
    return room, {n: c for n, c in rest.items() if c}


def _joined(*rooms: dict[int, Counter]) -> dict[int, Counter]:
    out: dict[int, Counter] = {}
    for room in rooms:
        for free, held in room.items():
            out.setdefault(free, Counter()).update(held)
    return out


def _used(room: dict[int, Counter]) -> int:
    return sum(sum(held.values()) for held in room.values())


def solve(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Layouts and how many sequences get each; they hold every piece of the histogram exactly once, in no more
    sequences than best-fit decreasing needs. What rounding leaves over is the demand of the next program; after the
    last, best fit packs the rest. Ends early at a packing that meets the lower bound."""
    demand = {n: c for n, c in histogram.items() if c > 0}
    done: dict[int, Counter] = {}
    if size in demand:  # a full piece is a configuration by itself
        done[0] = Counter({(size,): demand.pop(size)})
    best, least, bound = None, None, 0.0
    for turn in range(PROGRAMS):
        if not demand:
            break
        chosen, value = program(demand, size, rounds if not turn else max(1, rounds // 4))
        if not turn:
            bound = _used(done) + value
        tried = []
        for share in SHARES:
            room, rest = _rounded(chosen, demand, share, size)
            trial = _joined(done, room)
            _fit_rest(rest, trial, size)
            tried.append((_used(trial), -share, trial))
        n, _, trial = min(tried, key=lambda x: x[:2])
        if least is None or n < least:
            best, least = trial, n
        if least <= math.ceil(bound - 1e-6):
            break
        room, rest = _rounded(chosen, demand, 1.0, size)
        if not room:
            break
        # layouts with room to spare are given back: their pieces meet the others again in the next program
        full = {0: room.pop(0)} if 0 in room else {}
        back = Counter(rest)
        for held in room.values():
            for layout, count in held.items():
                for n in layout:
                    back[n] += count
        done, demand = _joined(done, full), dict(back)
        if not full:
            break
    return [(layout, count) for held in (best or done).values() for layout, count in held.items() if count]


def _runs(solution: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequences' first id, pieces of this length in a sequence, offset of the first)."""
    out, ranks, first = [], Counter(), 0
    for layout, count in solution:
        at = 0
        for n, k in sorted(Counter(layout).items(), reverse=True):
            out.append((n, ranks[n], first, k, at))
            ranks[n] += k * count
            at += k * n
        first += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """documents -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.keep(pieces(docs, path, size).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = _runs(solve(histogram, size, rounds))
    keys = (runs[:, 0] << 44) + runs[:, 1]
    # ranks: a length that many documents share is dealt into buckets, and each bucket's first rank is a running sum
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select(
        "length",
        "bucket",
        (F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    local = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = local.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            of, first, each, at = (runs[k, i] for i in range(1, 5))
            sequence = first + (rank - of) // each
            offset = at + (rank - of) % each * length
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
