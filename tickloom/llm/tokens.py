"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced where both agree.

Why a splice is right: the byte-level pre-tokenizer's pattern has no look-behind, and none of its alternatives matches
a non-space character followed by white space. A position p with a non-space character before it and a space or line
feed after it is therefore a token boundary whatever surrounds it; special strings hold no white space, so none
straddles it. Tokens left of p come from the earlier chunk (which holds the character at p), those right of p from the
later chunk (which holds the character before p). p must also be a boundary in the offsets of both encodings; where an
overlap has none (one huge word, a run of spaces), the overlap is doubled, and at last the chunk itself grows.

Defined results: null text counts as empty (0 bytes, 0 tokens); every row, repeated ids and null ids included, gives
one row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more characters are encoded in chunks; so many characters to a chunk, so many shared by neighbours.
CHUNK, OVERLAP = 1 << 15, 1 << 9
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, once per Python worker, on the worker's own thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def _ends(tok, text: str, start: int, stop: int) -> list[int]:
    """The end of every token of text[start:stop], counted in the whole text."""
    return [start + e for _, e in tok.encode(text[start:stop], add_special_tokens=False).offsets]


def _splice(text: str, ours: list[int], theirs: list[int], least: int) -> int | None:
    """The first proven boundary beyond `least` that both encodings have."""
    both = set(theirs)
    for p in ours:
        if p > least and p in both and p < len(text) and text[p] in " \n" and not text[p - 1].isspace():
            return p
    return None


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text, at no time holding the encodings of more than two neighbouring chunks."""
    total = cut = start = 0
    stop = min(len(text), chunk)
    ours = _ends(tok, text, start, stop)
    while stop < len(text):
        shared, p = overlap, None
        while p is None and stop - shared > cut:
            s = stop - shared
            t = min(len(text), s + max(chunk, 2 * shared))
            theirs = _ends(tok, text, s, t)
            p = _splice(text, [e for e in ours if s < e <= stop], theirs, max(s, cut))
            shared *= 2
        if p is None:  # no boundary since the last splice: the chunk itself grows
            stop = min(len(text), stop + 2 * (stop - cut))
            ours = _ends(tok, text, start, stop)
            continue
        total += sum(cut < e <= p for e in ours)
        cut, start, stop, ours = p, s, t, theirs
    return total + sum(e > cut for e in ours)


def count_batch(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= 2 * chunk]
    for k in range(0, len(short), 128):
        part = short[k : k + 128]
        for i, e in zip(part, tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = len(e)
    for i, t in enumerate(texts):
        if len(t) > 2 * chunk:
            out[i] = count_long(tok, t, chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_tokens, over_limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            counts: list[int] = []
            for k in range(0, b.num_rows, 512):  # so many texts as Python strings at a time
                counts += count_batch(tok, b.column(2).slice(k, 512).to_pylist(), chunk, overlap)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
