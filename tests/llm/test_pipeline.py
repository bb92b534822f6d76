"""The corpus pipeline against stages that are worked out here from their own input."""

from __future__ import annotations

import os

import corpus_pipeline
from ledgerline.llm import common
from ledgerline.llm.common import staged
from tests.llm.test_operators import brute_components, shingles


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = staged(stage(spark, docs, tables))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
            assert all(before[r["doc_id"]] == r for r in docs.collect())
    after = {name: {r["doc_id"] for r in df.collect()} for name, (_, df) in seen.items()}

    before = seen["exact dedup"][0]
    groups = {}
    for key, r in before.items():
        groups.setdefault(r["text"].translate({c: c + 32 for c in range(65, 91)}), []).append(key)
    assert after["exact dedup"] == {max(v) for v in groups.values()}

    before = seen["near dedup"][0]
    wanted = brute_components({k: shingles(r["text"]) for k, r in before.items()})
    assert after["near dedup"] == {k for k, c in wanted.items() if k == c}
    assert after["packing"] == after["near dedup"]

    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    good = [k in after["quality classifier"] for k in seen["quality classifier"][0] if truth.get(k) == 1]
    bad = [k not in after["quality classifier"] for k in seen["quality classifier"][0] if truth.get(k) == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) > 0.5
    assert len(after["language id"]) >= 0.99 * len(seen["language id"][0])


ODD = "doc_id long, text string, lang string, source string, n_chars long, row_key string, doc string, key string, score string, row string, component_id string"
SENTENCE = "The weather in the north was mild, and people walked along the river until the evening came. "


def odd(spark, rows):
    return spark.createDataFrame([(key, text, "en", "web", 1, *["x"] * 6) for key, text in rows], ODD)


def left(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)


def test_exact_dedup_decides_on_rows(spark, tables):
    docs = odd(spark, [(1, "alpha one"), (1, "beta two"), (2, "alpha one"), (None, "alpha one"), (2, "alpha one"), (None, "gamma"), (None, "gamma"), (3, None), (4, ""), (None, "")])
    got = corpus_pipeline.exact_dedup(spark, docs, tables)
    assert got.columns == docs.columns
    assert left(got) == left(odd(spark, [(2, "alpha one"), (1, "beta two"), (None, "gamma"), (4, "")]))


def test_near_dedup_decides_on_rows(spark, tables):
    long = " ".join(f"w{k}" for k in range(200))
    docs = odd(spark, [(7, long), (5, long + " end"), (None, "start " + long), (5, "another text of its own here"), (None, None), (8, " "), (8, " "), (9, ""), (None, "a nameless text alone somewhere"), (None, "A nameless text alone somewhere")])
    got = corpus_pipeline.near_dedup(spark, docs, tables)
    kept = left(got)
    assert got.columns == docs.columns
    assert [x for x in kept if x[0] is not None] == left(odd(spark, [(5, long + " end"), (5, "another text of its own here"), (8, " "), (8, " "), (9, "")]))
    assert [(x[1] or "").lower() for x in kept if x[0] is None] == ["", "a nameless text alone somewhere"] or {(x[1] or "").lower() for x in kept if x[0] is None} == {"", "a nameless text alone somewhere"}


def test_classifiers_keep_rows_whole(spark, tables):
    rows = [(k, SENTENCE * (1 + k % 5)) for k in range(40)] + [(3, SENTENCE), (None, SENTENCE), (50, None), (51, ""), (52, "12 34"), (53, SENTENCE * 3000)]
    docs = odd(spark, rows)
    for stage in (corpus_pipeline.quality, corpus_pipeline.language):
        got = stage(spark, docs, tables)
        assert got.columns == docs.columns
        assert set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
    found = left(corpus_pipeline.language(spark, docs, tables))
    assert found == left(odd(spark, [x for x in rows if x[0] not in (50, 51, 52)]))


def test_stages_of_an_empty_table(spark, tables):
    docs = odd(spark, [(1, "x")]).where("doc_id > 1")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, tables)
        assert got.count() == 0
        assert name == "packing" or got.columns == docs.columns


def test_packing_takes_every_row(spark, tables):
    got = corpus_pipeline.packing(spark, odd(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "")]), tables).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 1), (1, 3), (1, 3), (2, 1)]


def test_run_equals_its_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_run_deletes_what_it_needs_no_longer(spark, tables):
    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = corpus_pipeline.run(spark, tables)
    assert len(set(os.listdir(folder)) - before) == 1 and got.count() > 0
