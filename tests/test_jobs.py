"""Sinks, sessions, the cache replay and the streaming forms."""

from __future__ import annotations

import datetime as dt
import os
import random
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import catalog, prompts, sessions
from ledgerline.plans import filings, research
from ledgerline.sources import staging
from ledgerline.sources import tables as src
from ledgerline.sources.catalog_source import FilingCatalog
from ledgerline.streaming import sessions as streams

T0 = dt.datetime(2024, 1, 1)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_catalog_round_trip(spark, tmp_path):
    rows = [(1, "A", "10-K", dt.date(2020, 3, 1), "<p>x", "t, \"q\"\nline", None), (2, "A", "10-K", dt.date(2021, 3, 1), None, None, "m")]
    df = spark.createDataFrame(rows, src.CATALOG)
    src.write_filings(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.where("filing_year = 2020").select("accession").collect()[0][0] == 1
    for kind in ("json", "csv", "orc"):
        writer = df.write.options(header=True, escape='"') if kind == "csv" else df.write
        writer.format(kind).save(str(tmp_path / kind))
        assert sorted(map(tuple, src.read_catalog(spark, str(tmp_path / kind), kind).collect())) == sorted(rows)


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ts int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w"), ("a", 0, "no")], "k string, ts int, v string")
    assert sorted(map(tuple, src.upsert(old, new, ["k"], ["ts"]).collect())) == [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]


def test_pick_is_blind_to_case_on_both_sides(spark):
    listed = spark.createDataFrame([(1, "t1", "10-k", dt.date(2020, 1, 1)), (2, "T1", "10-K", dt.date(2021, 1, 1)), (3, None, "10-K", dt.date(2021, 1, 1))], "accession long, ticker string, form_type string, filing_date date")
    asked = spark.createDataFrame([("t1", "2020", "10-k"), ("T1", None, "10-K"), (None, "2021", "10-K"), ("t1", "2021", None)], "ticker string, year string, form_type string")
    got = sorted((str(r["ticker"]), str(r["year"]), r["accession"] or 0, r["match_kind"]) for r in catalog.pick_filing(asked, listed).collect())
    assert got == [("None", "2021", 0, "none"), ("T1", "2020", 1, "year"), ("T1", "2021", 0, "none"), ("T1", "None", 2, "latest")]


def test_pick_breaks_ties_by_accession(spark):
    listed = spark.createDataFrame([(1, "T", "10-K", dt.date(2020, 1, 1)), (2, "T", "10-K", dt.date(2020, 1, 1))], "accession long, ticker string, form_type string, filing_date date")
    asked = spark.createDataFrame([("t", "2020", "10-k"), ("t", "1999", "10-K"), ("t", "x", "10-K"), ("u", "2020", "10-K")], "ticker string, year string, form_type string")
    got = sorted((r["ticker"], r["year"], r["accession"] or 0, r["match_kind"]) for r in catalog.pick_filing(asked, listed).collect())
    assert got == [("T", "1999", 2, "latest"), ("T", "2020", 2, "year"), ("T", "x", 2, "latest"), ("U", "2020", 0, "none")]


def replayed(seconds):
    loaded, out = None, []
    for s in seconds:
        hit = loaded is not None and s - loaded < 600
        loaded = loaded if hit else s
        out.append(hit)
    return out


def test_cache_is_not_renewed_by_hits(spark):
    seconds = [0, 599, 600, 1100, 1199, 1200, 5000]
    df = spark.createDataFrame([("k", n, at(s)) for n, s in enumerate(seconds)] + [("other", 99, at(10))], "k string, request_id long, ts timestamp")
    got = {r["request_id"]: r["cached"] for r in sessions.replay_cache(df, ["k"]).collect()}
    assert [got[n] for n in range(len(seconds))] == replayed(seconds) == [False, True, False, True, True, False, False]
    assert got[99] is False


def test_cache_replay_keeps_every_request(spark):
    rows = [("k", 1, at(0), "x"), ("k", 1, at(10), "y"), ("k", None, at(20), "z"), (None, None, at(0), "n"), (None, 5, at(1), "m"), ("k", 7, None, "t"), ("", 9, at(5), "e")]
    df = spark.createDataFrame(rows, "k string, request_id long, ts timestamp, id string")
    got = {r["id"]: r["cached"] for r in sessions.replay_cache(df, ["k"]).collect()}
    assert got == {"x": False, "y": True, "z": True, "n": False, "m": True, "t": False, "e": False}
    assert sessions.replay_cache(df, ["k"]).columns == [*df.columns, "cached"]
    assert sessions.replay_cache(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("spread", [200, 3_000, 400_000])
def test_cache_replay_of_a_hot_key_in_many_ranges(spark, spread):
    rng = random.Random(spread)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(6)}", n, at(rng.randrange(spread))) for n in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame(rows, "k string, request_id long, ts timestamp")
        got = {r["request_id"]: r["cached"] for r in sessions.replay_cache(df, ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {r[0] for r in rows}:
        own = sorted((r[2], r[1]) for r in rows if r[0] == key)
        assert [got[n] for _, n in own] == replayed([(t - T0).total_seconds() for t, _ in own])


def test_steps_of_a_stretch_say_its_last_load():
    rng = random.Random(2)
    for _ in range(300):
        times = sorted(rng.randrange(60) for _ in range(rng.randint(1, 25)))
        until, exits = sessions._steps(np.array(times), 7)
        for before in range(-20, 60):
            loaded = before
            for t in times:
                loaded = t if t - loaded >= 7 else loaded
            place = int(np.searchsorted(until, before + 7))
            assert loaded == (exits[place] if place < len(until) else before)


def test_threads_keep_every_message_in_order(spark):
    df = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("s", 3, "b")], "k string, seq int, text string")
    row = sessions.threads(df, ["k"]).first()
    assert [m["text"] for m in row["messages"]] == ["a", "b", "b"]


@pytest.mark.parametrize("partitions", ["1", "23"])
def test_thread_pages_of_a_session_over_many_ranges(spark, partitions):
    rng = random.Random(1)
    rows = [("hot", n, f"m{n}") for n in range(20_000)] + [(k, n, f"{k}{n}") for k in ("a", "b", None) for n in range(rng.randint(1, 9))] + [("same", 5, "x")] * 7
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = sessions.thread_pages(spark.createDataFrame(rows, "k string, seq int, text string").repartition(6), ["k"], ["seq"], 90).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in {r[0] for r in rows}:
        wanted = sorted((seq, text) for k, seq, text in rows if k == key)
        pages = sorted((r for r in found if r["k"] == key), key=lambda r: r["page"])
        assert [(m["seq"], m["text"]) for p in pages for m in p["messages"]] == wanted
        assert [p["page"] for p in pages] == list(range(len(pages))) and [p["first"] for p in pages] == [90 * n + 1 for n in range(len(pages))]
        assert all(p["n_messages"] == 90 for p in pages[:-1])


def test_session_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], "document_html string, document_html_partial boolean, document_anchors array<struct<id string>>")
    assert tuple(sessions.with_session_defaults(df).first()) == ("", False, [])


EVENTS = "user_id long, seq long, ts timestamp, ticker string, year string, form_type string, action string, payload string"


def test_session_store_survives_a_second_run(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for n, rows in enumerate([[(1, 1, at(1), "t", "2020", "10-k", "a", "x")], [(1, 2, at(2), "T", "2020", "10-K", "a", "y"), (2, 3, at(0), "T", "2020", "10-K", "a", "z")]]):
        spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(source)
        streams.store_sessions(spark.readStream.schema(EVENTS).parquet(source), out, check).awaitTermination()
    got = sorted((r["user_id"], r["session_key"], r["payload"]) for r in streams.read_sessions(spark, out).collect())
    assert got == [(1, "session:T:2020:10-K", "y"), (2, "session:T:2020:10-K", "z")]


def test_session_store_merges_parts_and_never_loses_one(spark, tmp_path):
    out = str(tmp_path / "store")
    wanted = {}
    for n in range(9):
        rows = [(n % 4, n, at(n), "t", "2020", "10-K", "a", f"p{n}"), (7, n, at(100 - n), "t", "2020", "10-K", "a", f"q{n}")]
        streams.upsert_sessions(spark.createDataFrame(rows, EVENTS), out, fan=3, keep=1, keep_seconds=0)
        wanted |= {n % 4: f"p{n}", 7: "q0"}
        assert {r["user_id"]: r["payload"] for r in streams.read_sessions(spark, out).collect()} == wanted
        assert len(streams.session_store(spark, out)._newest()[1]["parts"]) <= 4
    assert len(os.listdir(f"{out}/parts")) < 9 + 4  # parts that no snapshot needs are gone
    streams.upsert_sessions(spark.createDataFrame([(7, 8, at(92), "t", "2020", "10-K", "a", "q8")], EVENTS), out)  # a batch that is repeated
    assert {r["user_id"]: r["payload"] for r in streams.read_sessions(spark, out).collect()} == wanted


def test_session_store_outlives_its_checkpoint(spark, tmp_path):
    source, out = (str(tmp_path / x) for x in ("in", "out"))
    for n, check in enumerate(("one", "two")):
        spark.createDataFrame([(n, 1, at(n), "t", "2020", "10-K", "a", "x")], EVENTS).write.parquet(f"{source}{n}")
        streams.store_sessions(spark.readStream.schema(EVENTS).parquet(f"{source}{n}"), out, str(tmp_path / check)).awaitTermination()
    assert {r["user_id"] for r in streams.read_sessions(spark, out).collect()} == {0, 1}


def test_empty_session_store_is_an_empty_table(spark, tmp_path):
    empty = streams.read_sessions(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns == streams.SESSIONS.names


def test_session_store_is_read_while_it_is_written(spark, tmp_path):
    out, done, failed, seen = str(tmp_path / "store"), threading.Event(), [], []

    def read():
        while not done.is_set():
            try:
                rows = streams.read_sessions(spark, out).select("user_id", "session_key", "seq").collect()
                keys = [(r["user_id"], r["session_key"]) for r in rows]
                assert len(keys) == len(set(keys))
                seen.append(max((r["seq"] for r in rows), default=-1))
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(50):
            rows = [(n % 5, n, at(n), "t", "2020", "10-K", "a", f"p{n}"), (9, n, at(n), "t", "2021", "10-K", "a", None)]
            streams.upsert_sessions(spark.createDataFrame(rows, EVENTS).coalesce(1), out, fan=3, keep=2, keep_seconds=3)
    finally:
        done.set()
        reader.join()
    assert not failed and len(seen) > 5 and seen == sorted(seen)
    assert {(r["user_id"], r["seq"], r["payload"]) for r in streams.read_sessions(spark, out).collect()} == {*((n % 5, n, f"p{n}") for n in range(45, 50)), (9, 49, "")}
    store = streams.session_store(spark, out)
    assert len(store._newest()[1]["parts"]) <= 8 and len(os.listdir(f"{out}/parts")) < 50


def test_session_store_snapshots_and_repeated_batches(spark, tmp_path):
    out = str(tmp_path / "store")
    for n in range(3):
        streams.upsert_sessions(spark.createDataFrame([(1, n, at(n), "t", "2020", "10-K", "a", f"p{n}")], EVENTS), out, stream="s", batch_id=n)
    store = streams.session_store(spark, out)
    assert store.snapshots() == [1, 2, 3] and store.read(2).first()["payload"] == "p1"
    again = spark.createDataFrame([(1, 9, at(9), "t", "2020", "10-K", "a", "never")], EVENTS)
    streams.upsert_sessions(again, out, stream="s", batch_id=2)
    assert store.snapshots() == [1, 2, 3] and store.read().first()["payload"] == "p2"
    assert not store._commit(3, {"parts": []})  # a number is taken once
    store._write(store.read(), 0)  # a writer that died before its commit
    assert store.vacuum() == 0 and store.vacuum(-60) == 1 and store.vacuum(-60) == 0
    assert store.read(3).first()["payload"] == "p2" and not [n for n in os.listdir(f"{out}/manifests") if n.startswith("_")]


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_cache_stream_of_late_requests_equals_the_batch(rocksdb, tmp_path):
    spark, rng = rocksdb, random.Random(6)
    rows = [(rng.choice(("hot", "k", None)), n, at(20 * n + rng.randrange(300))) for n in range(300)]
    rows += [("k", None, at(100)), ("k", 5, at(100)), ("k", 5, at(100)), ("hot", 900, None)]
    rows.sort(key=lambda r: (r[2] or T0) + dt.timedelta(seconds=rng.randrange(250)))  # late by less than the delay
    schema = "k string, request_id long, ts timestamp"
    for n in range(5):
        part = rows[n * 61 : (n + 1) * 61] + ([(k, 10_000, at(100_000)) for k in ("hot", "k", "other")] if n == 4 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = streams.cache_flags(source, "k").writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    flags = lambda rows: sorted((str(r[0]), str(r["request_id"]), str(r["ts"]), r["cached"]) for r in rows if r["ts"] is not None and r["request_id"] != 10_000)
    got = flags(spark.table("flags").collect())
    assert got == flags(sessions.replay_cache(spark.createDataFrame(rows, schema), ["k"]).collect())
    assert len(got) == 303 and {g[3] for g in got} == {True, False}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4  # what waits, a load and a timer of each key


def test_recents_stream_equals_the_batch_after_every_batch(rocksdb, tmp_path):
    spark, rng = rocksdb, random.Random(3)
    rows = [(rng.randrange(4), n, at(rng.randrange(400)), f"T{rng.randrange(6)}", rng.choice(("2020", "2021", None)), rng.choice(("10-K", "10-k")), "a", "x") for n in range(400)] + [(1, None, at(5), "no", "n", "n", "a", "x")]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    assert streams.read_recents(spark, out).collect() == []
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 101 * (n == 3) + 100], EVENTS).coalesce(1).write.mode("append").parquet(source)
        streams.store_recents(spark.readStream.schema(EVENTS).parquet(source), out, check, n=5).awaitTermination()
        wanted = sessions.recent_filings(spark.createDataFrame(rows[: n * 100 + 100], EVENTS), 5)
        assert sorted(map(str, streams.read_recents(spark, out).collect())) == sorted(map(str, wanted.collect()))


def test_attach_spreads_rows_without_a_key(spark):
    rows = spark.createDataFrame([(n, None if n % 3 else n) for n in range(300)], "n long, k long")
    found = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 3)] + [(None, "never")], "k long, v string")
    got = {r["n"]: r["v"] for r in catalog.attach(rows, found, "k").collect()}
    assert got == {n: None if n % 3 else f"v{n}" for n in range(300)}


def test_pack_of_an_empty_catalog_and_bodies_read_once(spark):
    asked = spark.createDataFrame([("t", "2020", "10-k"), ("t", "2020", "10-k"), ("u", "2020", "10-K")], "ticker string, year string, form_type string")
    listed = spark.createDataFrame([(1, "T", "10-K", dt.date(2020, 1, 1), 5), (2, "T", "10-K", dt.date(2019, 1, 1), 5)], "accession long, ticker string, form_type string, filing_date date, body long")
    bodies = spark.createDataFrame([(5, "<body><h1>One</h1>text</body>", None, None), (6, "x", None, None)], "body long, html string, text string, markdown string")
    got = catalog.filing_pack(asked, listed, bodies, body_key="body").collect()
    assert sorted((r["ticker"], r["accession"] or 0, r["text"] or "", [a["id"] for a in r["anchors"] or []]) for r in got) == [("T", 1, "One text", ["one"]), ("T", 1, "One text", ["one"]), ("U", 0, "", [])]
    assert catalog.filing_pack(asked, listed.where("false"), bodies, body_key="body").where("text IS NULL").count() == 3


def test_pack_reads_only_the_folders_of_its_picks(spark, tmp_path):
    rows = [(n, f"T{n % 3}", "10-K" if n % 2 else "10-q", dt.date(2010 + n % 6, 1, 1), f"<body><h1>N{n}</h1></body>", None, None) for n in range(60)]
    src.write_filings(spark.createDataFrame(rows, src.CATALOG), str(tmp_path / "p"))
    archive = spark.read.parquet(str(tmp_path / "p"))
    asked = spark.createDataFrame([("t1", "2011", "10-k"), ("t9", "2011", "10-k"), (None, None, None)], "ticker string, year string, form_type string")
    picked = catalog.pick_filing(asked, archive, ("form_type", "filing_year"))
    near = catalog.in_folders(archive, staging.staged(picked), {"filed_form_type": "form_type", "filed_filing_year": "filing_year"})
    plan = near._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    assert {(r["form_type"], r["filing_year"]) for r in near.collect()} == {("10-K", 2011)}
    got = catalog.filing_pack(asked, archive, archive, folders=("form_type", "filing_year"))
    assert sorted(got.columns) == sorted(["ticker", "year", "form_type", "accession", "filing_date", "match_kind", "text", "display_html", "html_partial", "anchors"])
    assert sorted((r["ticker"] or "", r["text"] or "", r["match_kind"]) for r in got.collect()) == [("", "", "none"), ("T1", "N55", "year"), ("T9", "", "none")]


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(n, f"T{n % 7}", ("10-K", "10-K/A", None)[n % 3], dt.date(2010 + n % 4, 1 + n % 12, 1), f"<p>{n}", None, "é") for n in range(300)]
    src.write_filings(spark.createDataFrame(rows, src.CATALOG), str(tmp_path / "archive"))
    spark.dataSource.register(FilingCatalog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield str(tmp_path / "archive")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_catalog_source_reads_what_parquet_reads(spark, archive, tmp_path):
    load = lambda: spark.read.format("filing_catalog").load(archive)
    whole = load()
    stored = spark.read.parquet(archive)
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(whole, stored) and whole.count() == 300
    for wanted in ("form_type = '10-K' AND ticker = 'T3'", "filing_year IN (2011, 2013) AND ticker IN ('T1', 'T2', 'x')", "form_type IS NULL", "form_type = 'none'", "filing_year = 2010 AND accession > 50", "ticker = 'T1' OR filing_year = 2012"):
        assert same(load().where(wanted), stored.where(wanted)), wanted
    narrow = spark.read.format("filing_catalog").option("bodies", "false").load(archive)
    assert "html" not in narrow.columns and narrow.where("ticker = 'T1'").count() == stored.where("ticker = 'T1'").count()
    plan = load().where("form_type = '10-K' AND ticker = 'T3'")._jdf.queryExecution().executedPlan().toString()
    assert "= 10-K" not in plan and "= T3" not in plan  # the source has taken them
    assert load().where("form_type = '10-K' AND filing_year = 2010").rdd.getNumPartitions() < load().rdd.getNumPartitions()
    assert spark.read.format("filing_catalog").load(str(tmp_path / "nothing")).count() == 0


def test_catalog_stream_has_new_filings_once(spark, archive, tmp_path):
    read = spark.readStream.format("filing_catalog").option("bodies", "false").load(archive)
    query = read.writeStream.format("memory").queryName("filed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert sorted(r["accession"] for r in spark.table("filed").collect()) == list(range(300))
        last = spark.read.parquet(archive).agg(F.max("filing_date")).first()[0]
        more = [(1000 + n, "T1", "10-K", last + dt.timedelta(days=n // 2), None, None, None) for n in range(6)]
        src.write_filings(spark.createDataFrame(more, src.CATALOG), str(tmp_path / "more"))
        for path in (tmp_path / "more").rglob("*.parquet"):
            (tmp_path / "archive" / path.parent.relative_to(tmp_path / "more")).mkdir(parents=True, exist_ok=True)
            path.rename(tmp_path / "archive" / path.relative_to(tmp_path / "more"))
        query.processAllAvailable()
        assert sorted(r["accession"] for r in spark.table("filed").collect()) == [*range(300), *range(1000, 1006)]
    finally:
        query.stop()


@pytest.mark.parametrize(
    ("stored", "wanted"),
    [
        ((None, None, None, None), (80_000, 60_000, False, None)), (("12k", "-3", "1", " Be brief. "), (12_000 - 7_000, 0, True, "Be brief.")), ((" +90000.5", "x", "0", "Be brief."), (90_000, 60_000, False, None)),
        (("999999999999999999999", "1e9", "maybe", "Draft"), (120_000, 1, True, "Draft")), (("", "", "true", "  "), (80_000, 60_000, True, None)), (("6000", "80001", None, "  "), (6_000, 80_000, False, None)),
    ],
)
def test_chat_settings(spark, stored, wanted):
    df = spark.createDataFrame([stored], "current_max string, additional_max string, use_custom string, prompt_draft string")
    row = prompts.chat_settings(df).first()
    assert (row["current_context_max_chars"], row["additional_context_max_chars"], row["use_custom_prompt"], row["custom_prompt"]) == wanted


def test_status_codes(spark):
    rows = [("year", "<p>", "<p>", "ok"), ("none", None, None, "ok"), ("latest", None, None, "ok"), ("latest", "<p>", "", "ok"), ("year", "<p>", "x", "custom prompt not allowed")]
    df = spark.createDataFrame(rows, "kind string, html string, part string, prompt string")
    got = [r["status_code"] for r in prompts.with_status(df, filing="kind", html="html", fragment="part", prompt="prompt").collect()]
    assert got == [200, 500, 404, 404, 403]
    drafts = spark.createDataFrame([(None,), ("  ",), ("x",)], "prompt_draft string").selectExpr("prompt_draft", "null AS current_max", "null AS additional_max", "null AS use_custom")
    shown = [r["prompt_to_edit"] for r in prompts.chat_settings(drafts, "an aide").collect()]
    assert shown[0].startswith("You are an aide.") and shown[1:] == ["  ", "x"]


def test_chat_threads_hold_records(spark):
    rows = [(1, 3, at(3), "t", "2020", "10-k", "answer", "ANSWER: yes SOURCE_QUOTE: so it is"), (1, 1, at(1), "T", "2020", "10-K", "select", "picked"), (1, 2, at(2), "T", "2020", "10-K", "ask", "why?"), (1, 4, at(4), "T", "2020", "10-K", "open", "x"), (1, 5, at(5), "T", "2020", "10-K", "answer", None)]
    found = sessions.chat_threads(spark.createDataFrame(rows, EVENTS), "select", "ask", "answer").collect()
    assert len(found) == 1 and found[0]["n_messages"] == 4
    assert [(m["role"], m["kind"], m["content"], m["source_quote"]) for m in found[0]["messages"]] == [("user", "selection", "picked", None), ("user", None, "why?", None), ("assistant", None, "yes", "so it is"), ("assistant", None, "", None)]


def test_stages_are_deleted_at_the_end_of_their_block(spark):
    with staging.stages(spark) as own:
        df = staging.staged(spark.range(5))
        kept = staging.staged(df)
        paths = [p.removeprefix("file://") for p in own]
        own.pop()
    assert [os.path.isdir(p) for p in paths] == [False, True] and kept.count() == 5


def test_core_is_registered_without_what_the_subpackage_needs():
    blocked = "import sys; sys.modules['ahocorasick'] = None; sys.modules['ledgerline.llm.queries'] = None; import __spark_entry__ as e; print(len(e.queries()), sorted(e.queries())[:1])"
    got = subprocess.run([sys.executable, "-c", blocked], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert got.stdout.split()[0] == str(len(filings.QUERIES) + len(research.QUERIES)), got.stderr
