from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from tickloom.llm import pii, tokens

from . import brute
from .test_packing import check


def test_run_equals_brute_force(spark, small, small_docs):
    rows = {r["doc_id"]: r for r in small_docs.collect()}
    good = {d for d, r in rows.items() if brute.quality(r["text"])["kept"]}
    alone = set(brute.near_components([(d, rows[d]["text"]) for d in sorted(good)]))
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = sorted(d for d in alone if not any(brute.contained(rows[d]["text"], s)[2] for s in items))

    docs, seen = small_docs, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Scratch(spark, "test").keep(stage(spark, docs, small))
        if name != "pack":
            assert docs.columns == small_docs.columns
            seen.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        if name == "redact":
            redacted = docs.collect()
    assert seen == [sorted(good), sorted(alone), clean, clean]

    before = spark.createDataFrame([rows[d] for d in clean], small_docs.schema)
    spans = {r["doc_id"]: r["spans"] for r in pii.find(before).collect()}
    for r in redacted:
        assert not brute.base_spans(r["text"])
        assert (r["text"] != rows[r["doc_id"]]["text"]) == bool(spans[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])

    tok = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, small).collect()
    used, least = check(packed, [(r["doc_id"], r["text"]) for r in redacted], 2048, tok)
    assert used <= least + 2


def documents(spark, path, rows, items):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, w int, row long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_nulls_repeats_ties_long_texts_and_clashing_names(spark, tmp_path):
    text = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    row = lambda d, t: (d, t, None, "s", len(t) if t else None, "k", 1, 2)
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [row(1, None), row(2, ""), row(3, text(3)), row(3, text(3)), row(4, text(3)), row(5, text(5)), row(6, text(6) + " " + item), row(None, text(7))]
    rows += [row(8, text(8) + " mail a@b.com now"), row(9, text(9, 30_000)), row(10, "few words")]
    documents(spark, tmp_path, rows, [(1, item), (2, None), (3, "")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {3, 5, None, 8, 9}
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.Scratch(spark, name).keep(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "w", "row"]
    assert {r["doc_id"]: r["text"] for r in docs.collect()}[8].endswith(" mail [EMAIL] now")


def test_empty_tables(spark, tmp_path):
    documents(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_five_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "redact", "pack"]
