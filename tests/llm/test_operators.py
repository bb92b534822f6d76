"""Each operator against brute force or an exact round trip, and its stated cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import public_tokenizers
from ledgerline.llm import common, components, op1_sentencepiece, op2_media, op3_packing, op4_near_dedup, op5_url_filter, op6_line_dedup, op7_exact_dedup, op8_license_scan, op9_language_id, op10_quality

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves.
ODD = "doc_id long, text string, lang string, id string, score string, digest string, row string, n_tokens string, sequence_id string, rep string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
ODD_ROWS = [
    (1, None, "en"), (2, "", None), (3, "   \n\t", "en"), (4, LONG, "en"), (5, "Same text here, five words", "en"), (6, "same TEXT here, five words", "en"),
    (6, "same TEXT here, five words", "en"), (None, "same text here, five words", "fr"), (7, "é 中文 😀 \x00 end", None), (None, None, None), (8, "123 456", "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *(["x"] * 7)) for r in ODD_ROWS], ODD)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# --- 1 -----------------------------------------------------------------------------------------------------------------


def model():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_op1_equals_the_library(spark, tables, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model())
    got = {r["doc_id"]: r for r in op1_sentencepiece.op1_sentencepiece(spark, tables).collect()}
    for key, text in texts(docs).items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert got[key]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert got[key]["n_corrected"] == 0


def test_op1_agenda_on_random_texts():
    vocab = op1_sentencepiece.MergeVocabulary(model())
    rng = random.Random(5)
    letters = " \n\t▁aeiouthnsrl<s>é中文字😀‍\x00\x1cﬁ．AB09'  "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert vocab.encode([text])[0][0] == op1_sentencepiece.pack_ids(vocab.library.encode(text, add_bos=True, add_eos=True))


def test_op1_both_forms_of_the_agenda():
    vocab = op1_sentencepiece.MergeVocabulary(model())
    rng = random.Random(6)
    for _ in range(2000):
        chunk = "▁" + "".join(rng.choice("aeiouthnsrlé,.文") for _ in range(rng.randint(0, 45)))
        assert vocab.segment_short(chunk) == vocab.segment_long(chunk) == vocab.segment(chunk)
        assert vocab.pack(vocab.segment(chunk)) == op1_sentencepiece.pack_ids(vocab.library.encode(chunk[1:])) or chunk == "▁"


def test_op1_cases(odd, nothing):
    got = op1_sentencepiece.encode_documents(odd, model())
    assert got.count() == len(ODD_ROWS)
    row = got.where("doc_id = 1").first()
    assert (row["n_tokens"], row["decoded"], bytes(row["ids"])) == (2, "", b"\x01\0\0\0\x02\0\0\0")
    assert op1_sentencepiece.encode_documents(nothing, model()).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", op2_media.KINDS)
def test_op2_formats_round_trip(kind):
    payload, _ = op2_media.payload_of("RIFF BM P6 GIF89a é" * 50)
    blob = op2_media.WRITERS[kind](payload)
    assert op2_media.media_in(blob, op2_media.automaton()) == [(kind, 0, len(blob))]
    assert op2_media.samples_of(kind, blob)[0] == payload
    assert op2_media.VALIDATORS[kind](blob[:-1], 0) is None


def test_op2_carves_and_corrects(spark):
    payload = b"x" * 192
    png, wav, gif = op2_media.write_png(payload), op2_media.write_wav(payload), b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    broken = bytearray(png)
    broken[40] ^= 1
    blob = b"junk BM RIFF" + png + b"P6 no" + wav + bytes(broken) + gif
    df = spark.createDataFrame([(1, bytearray(blob), "audio/wav"), (2, bytearray(wav), "image/png"), (3, None, None)], "doc_id long, blob binary, declared string")
    got = {r["doc_id"]: r for r in op2_media.sniff_media(df, "doc_id", "blob", "declared", contents=True).collect()}
    assert [(m["type"], bytes(m["content"])) for m in got[1]["media"]] == [("image/png", png), ("audio/wav", wav), ("image/gif", gif)]
    assert (got[1]["media_type"], got[2]["media_type"], got[2]["corrected"], got[3]["media"]) == (op2_media.UNKNOWN, "audio/wav", True, [])


def test_op2_sniffing_equals_a_scan_of_all_offsets():
    rng = random.Random(9)
    payload = b"RIFF BM P6 GIF89a" * 20
    media = [write(op2_media.payload_of(payload.decode())[0]) for write in op2_media.WRITERS.values()] + [b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"]
    found = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            one = bytearray(rng.choice(media))
            if rng.random() < 0.4:
                one[rng.randrange(len(one))] ^= 1 << rng.randrange(8)
            parts.append(bytes(one[: rng.choice((len(one), len(one), rng.randrange(len(one))))]) + rng.randbytes(rng.randint(0, 30)))
        blob, at, wanted = b"".join(parts), 0, []
        while at < len(blob):
            kind = next((k for m, k in op2_media.SIGNATURES.items() if blob.startswith(m, at) and op2_media.VALIDATORS[k](blob, at)), None)
            if kind:
                wanted.append((kind, at, op2_media.VALIDATORS[kind](blob, at)))
            at += wanted[-1][2] if kind else 1
        assert op2_media.media_in(blob, op2_media.automaton()) == wanted
        found += len(wanted)
    assert found > 60


def test_op2_reads_back_what_was_stored(spark, tables, docs):
    got = {r["doc_id"]: r for r in op2_media.op2_media_columns(spark, tables).collect()}
    for key, text in texts(docs).items():
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        row = got[key]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({r["media_type"] for r in got.values()}) == len(op2_media.KINDS)


def test_op2_cases(odd, nothing):
    got = op2_media.read_stored(op2_media.store_texts(odd))
    assert got.count() == len(ODD_ROWS)
    assert got.where("doc_id = 1").first()["payload_bytes"] == 192
    assert got.where("doc_id = 6").select("media_sha256").distinct().count() == 1
    assert op2_media.read_stored(op2_media.store_texts(nothing)).count() == 0


# --- 3 -----------------------------------------------------------------------------------------------------------------


def check_packing(rows, ids, capacity=2048):
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for key, parts in [*pieces.items(), *sequences.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        if key in pieces and parts is pieces[key]:
            assert at == len(ids[key])
        else:
            assert at <= capacity
    assert set(pieces) == set(ids)
    return len(sequences)


def test_op3_packs_every_id_once(spark, tables, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op3_packing.default_tokenizer())
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in texts(docs).items()}
    used = check_packing(op3_packing.op3_packing(spark, tables).collect(), ids)
    assert used <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_op3_ids_equal_the_tokenizers_library():
    encoder = op3_packing.ByteTokenizer(op3_packing.default_tokenizer())
    assert encoder.quick is not None
    rng = random.Random(7)
    letters = " \n\t\x1c\xa0aB9.,!é中😀'st  \n"
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    some += [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} ." for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 61 == 7)]
    some += ["a" + " " * 300_000 + "b", "x" * 10_000, " " * 5000, "\n" * 4000 + "end"]
    for at in range(0, len(some), 5000):
        for text, ids in zip(some[at : at + 5000], encoder.whole(some[at : at + 5000])):
            assert np.array_equal(encoder.encode(text), ids)


def test_op3_white_space_that_the_pattern_gives_up_on():
    encoder = op3_packing.ByteTokenizer(op3_packing.default_tokenizer())
    text = "a" + " " * 3_000_000 + "b"
    with pytest.raises(ValueError):
        encoder.quick.encode_to_numpy(text)
    assert np.array_equal(encoder.encode(text), encoder.whole([text])[0])


def test_op3_quoted_added_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op3_packing.default_tokenizer())
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>\ny <|endoftext |>"), (4, "a  <|endoftext|>\t\n b" * 900), (5, "no marker")]
    ids = {k: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in rows}
    assert ids[1].tolist() == [64, 220, 50256, 275, 1]
    check_packing(op3_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), op3_packing.default_tokenizer()).collect(), ids)
    encoder = op3_packing.ByteTokenizer(op3_packing.default_tokenizer())
    assert all(np.array_equal(encoder.encode(t), ids[k][:-1]) for k, t in rows)


@pytest.mark.parametrize("bucket_rows", [1, 40, 65_536])
def test_op3_ranks_do_not_depend_on_buckets(spark, bucket_rows):
    rng = random.Random(4)
    made = [(n, 0, rng.choice([7, 30, 30, 30, 64]), n % 3, 64) for n in range(700)]
    pieces = common.staged(spark.createDataFrame(made, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").repartition(5))
    held = {}
    for r in op3_packing.pack_pieces(pieces, 64, bucket_rows).collect():
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, held.values())) == len(made)
    for parts in held.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    counts = {}
    for m in made:
        counts[m[2]] = counts.get(m[2], 0) + 1
    assert len(held) == sum(times for _, times in op3_packing.plan_windows(counts, 64))


def best_fill(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_op3_windows_are_as_full_as_can_be():
    rng = random.Random(3)
    for _ in range(50):
        pieces = [rng.randint(1, 40) for _ in range(rng.randint(1, 14))]
        counts = {x: pieces.count(x) for x in pieces}
        taken = op3_packing.fullest(sorted(counts, reverse=True), counts, 60)
        assert all(n <= counts[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == best_fill(pieces, 60)
        plan = op3_packing.plan_windows(counts, 64)
        assert {x: sum(kind.get(x, 0) * times for kind, times in plan) for x in counts} == counts


def test_op3_cases(odd, nothing):
    got = op3_packing.pack_documents(odd, op3_packing.default_tokenizer()).collect()
    assert sorted((r["start"], r["length"]) for r in got if r["doc_id"] in (1, 2)) == [(0, 1), (0, 1)]
    assert sum(r["doc_id"] is None and r["length"] == 1 for r in got) == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 4) > 60_000
    assert op3_packing.pack_documents(nothing, op3_packing.default_tokenizer()).count() == 0


# --- 4 -----------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(sets, percent=85):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_op4_equals_brute_force(spark, tables, docs):
    sets = {k: shingles(t) for k, t in texts(docs).items()}
    got = {r["doc_id"]: r for r in op4_near_dedup.op4_near_dedup(spark, tables).collect()}
    wanted = brute_components(sets)
    assert {k: r["component_id"] for k, r in got.items()} == wanted
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert len(set(wanted.values())) < len(wanted)


@pytest.mark.parametrize(("limit", "pivots"), [(16, 4), (64, 2)])
def test_op4_large_family(spark, limit, pivots):
    """A family that no branching makes small, compared in blocks around pivots, with copies, loose members and outsiders."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for n in range(300):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(120)] = f"v{rng.randrange(400)}"
        rows.append((n, " ".join(own)))
    rows += [(1000 + n, rows[0][1].upper()) for n in range(40)] + [(2000 + n, " ".join(f"o{n}x{k}" for k in range(30))) for n in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op4_near_dedup.near_duplicates(df, limit=limit, levels=2, pivots=pivots).collect()}
    wanted = brute_components({k: shingles(t) for k, t in rows})
    assert got == wanted and len(set(wanted.values())) > 100


def test_op4_families_cost_rows_in_proportion(spark):
    rows = [(7, n, 20_000) for n in range(20_000)]
    tight = spark.createDataFrame(rows, "node long, rep long, members long")
    blocks = op4_near_dedup.pivot_blocks(tight, 2048, 64).groupBy("node").count().collect()
    assert sum(r["count"] for r in blocks) < 1.15 * len(rows) and max(r["count"] for r in blocks) < 2048
    member = spark.createDataFrame([(n, 0) for n in range(1, 19_900)], "node long, component long")
    rest = op4_near_dedup.left_over_blocks(tight, member, 2048)
    assert rest.count() < 1.2 * len(rows)
    together = rest.join(rest.where("rep >= 19900").withColumnRenamed("rep", "other"), "node").where("rep <> other").select("rep", "other").distinct().count()
    assert together == 100 * (len(rows) - 1)


def test_op4_recall_at_the_threshold(spark):
    """Pairs whose similarity is just 0.85, among texts with a common passage, so that nodes are large and branch several times."""
    rng = random.Random(12)
    common_part = [f"common{k}" for k in range(40)]
    rows = []
    for n in range(3000):
        own = [f"w{rng.getrandbits(40)}" for _ in range(64)]
        other = own[:30] + [f"w{rng.getrandbits(40)}" for _ in range(4)] + own[34:]
        rows += [(2 * n, " ".join(common_part + own)), (2 * n + 1, " ".join(common_part + other))]
    assert all(0.85 <= len(a & b) / len(a | b) < 0.853 for a, b in ((shingles(rows[k][1]), shingles(rows[k + 1][1])) for k in (0, 10, 400)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in op4_near_dedup.near_duplicates(df, limit=64, levels=2).collect()}
    assert sum(got[2 * n + 1] == 2 * n for n in range(3000)) >= 2999
    assert all(got[2 * n] == 2 * n for n in range(3000))


def test_op4_sketch_and_trees_together_give_the_recall():
    miss = op4_near_dedup.sketch_miss(85)
    assert 0 < miss < 2e-5
    trees = op4_near_dedup.trees_for(0.9999, 85)
    assert miss + (1 - op4_near_dedup.TREE_CHANCE) ** trees <= 1e-4 < miss + (1 - op4_near_dedup.TREE_CHANCE) ** (trees - 1)
    with pytest.raises(ValueError):
        op4_near_dedup.trees_for(1 - 1e-9, 85)


def test_op4_links_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = {n: np.unique(np.concatenate((rng.permutation(base)[: 400 - 3 * n], rng.integers(0, 2**64, 3 * n, dtype=np.uint64)))) for n in range(12)}
    digests = {n: op4_near_dedup.digest_of(x) for n, x in sets.items()}
    clusters = spark.createDataFrame([(5, n, len(x), bytearray(digests[n])) for n, x in sets.items()] + [(9, n, len(sets[n]), bytearray(digests[n])) for n in (0, 11)], "cluster long, rep long, n_shingles long, digest binary")
    held = spark.createDataFrame([(bytearray(digests[n]), bytearray(x.tobytes())) for n, x in sets.items()], "digest binary, shingles binary")
    wanted = brute_components({n: frozenset(x.tolist()) for n, x in sets.items()})
    for n_range in (50, 1000, 1 << 22):
        links = op4_near_dedup.confirmed_links(op4_near_dedup.in_ranges(clusters, held, n_range), 85).collect()
        assert {(r["u"], r["v"]) for r in links} == {(k, c) for k, c in wanted.items() if k != c}


def test_op4_shared_identifiers_are_one_document(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight"
    rows = [(5, a), (6, a), (6, b), (9, b), (6, ""), (9, None), (7, "by itself it is a text of its own"), (3, ""), (None, a)]
    got = op4_near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(5, 5, True), *[(6, 5, False)] * 3, *[(9, 5, False)] * 2, (7, 7, True), (3, 3, True), (None, None, True)], key=str)
    both = [(4, a), (4, b), (8, b), (2, a + " theta")]
    got = op4_near_dedup.near_duplicates(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(4, 4), (8, 4), (2, 2)}


def test_op4_cases(odd, nothing):
    got = op4_near_dedup.near_duplicates(odd)
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()]
    assert len(found) == len(ODD_ROWS)
    assert [x for x in found if x[0] in (1, 2, 3)] == [(k, 0, k, True) for k in (1, 2, 3)] or {x[0]: x[1:] for x in found if x[0] in (1, 2, 3)} == {k: (0, k, True) for k in (1, 2, 3)}
    assert {x[2] for x in found if x[0] in (5, 6)} == {5}
    assert all(x[2] is None and x[3] for x in found if x[0] is None)
    assert op4_near_dedup.near_duplicates(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}


# --- 5 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.COM/en/1?x", "a.example.com", "/en/1", "com/en/", "block"),
        ("http://example.com/en/77#y", "example.com", "/en/77", "example.com/en/7", "allow"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("http://m.example.net/de/80", "m.example.net", "/de/80", "example.net/de/8", "block"),
        ("http://x.org/fr/cheap-free", "x.org", "/fr/cheap-free", None, "block"),
        ("http://x.org/fr/cheap/cheap", "x.org", "/fr/cheap/cheap", None, "allow"),
        ("http://x.org/freedom/cheap", "x.org", "/freedom/cheap", None, "allow"),
        ("http://best-CASINO.org", "best-casino.org", "", None, "block"),
        ("casinos.org/x", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_op5_verdicts(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(None, url, "x")], "page_id long, url string, id string")
    row = op5_url_filter.judge_urls(df).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)
    assert op5_url_filter.judge_urls(df.where("false")).count() == 0


def test_op5_tables_long_urls_and_repeated_rows(spark):
    long = "https://a.b.c.example.com/" + "x" * 200_000 + "/Forbidden-Word?q=" + "soft " * 50_000
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://b.c/one.Two"), (None, None)], "page_id long, url string")
    words = spark.createDataFrame([("FORBIDDEN-word", "strict"), ("soft", "soft"), ("one", "soft"), ("two", "soft"), (None, "soft")], "term string, weight string")
    rules = spark.createDataFrame([("C", "/o", "allow"), ("b.c", "/", "block"), ("b.c", "/one", "allow")], "host string, path string, verdict string")
    got = sorted((r["page_id"] or 0, r["rule"], r["verdict"], r["strict_hits"], r["soft_hits"]) for r in op5_url_filter.judge_urls(df, vocabulary=words).collect())
    assert got == [(0, None, "allow", 0, 0), (1, None, "block", 1, 1), (1, None, "block", 1, 1), (2, None, "block", 0, 2)]
    ruled = {r["page_id"]: (r["rule"], r["verdict"]) for r in op5_url_filter.judge_urls(df, vocabulary=words, rules=rules).collect()}
    assert ruled[2] == ("b.c/one", "allow")
    assert op5_url_filter.judge_urls(df, vocabulary=(), rules=()).where("verdict = 'allow'").count() == 4


def test_op5_rules_by_suffix_equal_a_scan_of_all():
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rules = [(h, "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3))), rng.choice(("allow", "block"))) for h in hosts]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    held = op5_url_filter.Rules(rules)
    for _ in range(500):
        host, path = ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))), "/" + "".join(rng.choice("xy/") for _ in range(4))
        fit = [len(h + p) for h, p, _ in rules if path.startswith(p) and (host == h or host.endswith("." + h))]
        found = held.fitting(host, path)
        assert (len(found[0]) if found else None) == max(fit, default=None)


# --- 6 -----------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    """What op6 keeps, from all runs of two lines and all long lines of all texts at once, compared as texts."""
    holders, own = {}, {}
    for key, text in rows:
        lines = text.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip()]
        own[key] = [(k, k + 1) for k in filled if len(lines[k].split()) > 50] + [(a, b + 1) for a, b in zip(filled, filled[1:])]
        own[key] = sorted(own[key], key=lambda x: x[1])
        for first, after in own[key]:
            holders.setdefault(tuple(lines[first:after]), set()).add(key)
    out = {}
    for key, text in rows:
        lines, gone, seen = text.split("\n"), set(), set()
        for first, after in own[key]:
            window = tuple(lines[first:after])
            if window in seen or min(holders[window]) < key:
                gone.update(range(first, after))
            seen.add(window)
        out[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_op6_equals_brute_force(docs):
    got = op6_line_dedup.drop_repeated_chunks(docs).collect()
    wanted = brute_lines(sorted(texts(docs).items()))
    assert {r["doc_id"]: r["text"] for r in got} == wanted
    assert sum(r["n_removed"] for r in got) > 0


def colliding(line, key):
    """A digest under whose first two keys all lines of a length collide."""
    return bytes([key, len(line) % 256]) * 8 if key < 3 else op6_line_dedup.digest_of(line, key)


def test_op6_colliding_digests_leave_nothing_out(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(1, "aa\nbb\ncc"), (2, "bb\naa\ncc"), (3, "xx\naa\nbb\nyy")]
    try:
        got = op6_line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string"), digest=colliding).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: rows[1][1], 3: "xx\nyy"}


def test_op6_passages_are_found_when_shifted(spark):
    passage = [f"shared line number {k}" for k in range(40)]
    rows = [(1, "\n".join(["one", *passage, "end"])), (2, "\n".join(["other", "start", "here", *passage]))]
    got = {r["doc_id"]: r for r in op6_line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] > 20
    assert got[2]["text"].startswith("other")


def test_op6_cases(odd, nothing):
    got = op6_line_dedup.drop_repeated_chunks(odd)
    assert got.count() == len(ODD_ROWS)
    assert got.where("doc_id = 1").first()["text"] == ""
    assert op6_line_dedup.drop_repeated_chunks(nothing).count() == 0


def repeated_runs(rows):
    """The lines that lie in a run of two lines or more that occurred before, or are long and did; from common runs of all pairs of texts."""
    lines = [(key, text.split("\n")) for key, text in rows]
    gone = {key: set() for key, _ in rows}
    for n, (key, own) in enumerate(lines):
        for m in range(n + 1):
            other = lines[m][1]
            for i in range(len(own)):
                for j in range(i if m == n else len(other)):
                    run = 0
                    while i + run < len(own) and j + run < len(other) and own[i + run] == other[j + run]:
                        run += 1
                    if run > 1 or (run and len(own[i].split()) > 50):
                        gone[key].update(range(i, i + run))
    return {key: "\n".join(x for k, x in enumerate(own) if k not in gone[key]) for key, own in lines}


def test_op6_finds_every_planted_passage(spark):
    rng = random.Random(8)
    passages = [[f"passage {p} line {k} {rng.random()}" for k in range(2 + p % 5)] for p in range(20)]
    long = " ".join(f"word{k}" for k in range(60))
    rows, planted = [], 0
    for key in range(60):
        parts = [[f"own {key} {k} {rng.random()}"] for k in range(rng.randint(2, 9))]
        for p in rng.sample(passages, 2):
            parts.insert(rng.randint(0, len(parts)), p)
        parts.insert(rng.randint(0, len(parts)), [long] if key % 7 == 0 else ["a short line"])
        rows.append((key, "\n".join(x for part in parts for x in part)))
        planted += sum(len(p) for p in parts if len(p) > 1)
    got = {r["doc_id"]: r for r in op6_line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {k: r["text"] for k, r in got.items()} == repeated_runs(rows)
    assert sum(r["n_removed"] for r in got.values()) >= planted - sum(map(len, passages)) + 8
    kept = "\n".join(r["text"] for r in got.values()).split("\n")
    assert set(kept) == {x for _, t in rows for x in t.split("\n")} and kept.count(long) == 1


def test_op6_blank_lines_make_no_passage(spark):
    rows = [(1, "a\n\n\nb\n\nc"), (2, "x\n\n\ny\n\nb\n\nc\n"), (3, "\n\nc\n\nb")]
    got = {r["doc_id"]: r["text"] for r in op6_line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x\n\n\ny\n\n", 3: rows[2][1]}


# --- 7 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("fan_in", [2, 16])
def test_op7_equals_brute_force(spark, docs, fan_in):
    many = docs.repartition(13)
    got = op7_exact_dedup.exact_duplicates(many, fan_in=fan_in).collect()
    groups = {}
    for key, text in texts(docs).items():
        groups.setdefault(text.translate({c: c + 32 for c in range(65, 91)}), []).append(key)
    wanted = {(k, max(v), len(v), k == max(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for k in v}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == wanted
    assert len(groups) < docs.count()


def test_op7_uses_no_python(docs):
    plan = op7_exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op7_merges_sorted_runs_in_binomial_rounds(docs):
    runs = common.staged(op7_exact_dedup.digest_runs(docs.repartition(13)))
    entries, left = op7_exact_dedup.leaf_entries(runs), 13
    for number in range(1, 5):
        entries, left = op7_exact_dedup.merge_round(entries), -(-left // 2)
        plan = entries._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(run") == number
        assert len(re.findall(r"SortAggregate\(key=\[run[^\n]*functions=\[max\(kept.*\n[^\n]*Sort \[run[^\n]*\n[^\n]*Exchange", plan)) == number
        assert "HashAggregate" not in plan
        assert {r["run"] for r in entries.select("run").distinct().collect()} == set(range(left))
        order = entries.withColumn("at", F.monotonically_increasing_id()).collect()
        pieces = {}
        for r in sorted(order, key=lambda r: r["at"]):
            pieces.setdefault(r["at"] >> 33, []).append((r["run"], bytes(r["digest"])))
        assert all(p == sorted(set(p)) for p in pieces.values())
    assert left == 1


def test_op7_struct_identifiers_pick_one_row(spark):
    rows = [(1, "A"), (1, "a"), (None, "a"), (2, "b"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.struct("doc_id", "row"))
    kept = op7_exact_dedup.exact_duplicates(df, id_col="key").where("kept").select("key.doc_id").collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, None]


def test_op7_cases(odd, nothing):
    got = op7_exact_dedup.exact_duplicates(odd)
    same = got.where(F.col("text_sha256") == hashlib.sha256(b"same text here, five words").hexdigest()).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in same) == [(0, 6, 4, False), (5, 6, 4, False), (6, 6, 4, True), (6, 6, 4, True)]
    empty = got.where(F.col("text_sha256") == hashlib.sha256(b"").hexdigest()).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"]) for r in empty) == [(0, 2, 3), (1, 2, 3), (2, 2, 3)]
    assert op7_exact_dedup.exact_duplicates(nothing).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------------------------


def longest_increasing(values):
    best = [1] * len(values)
    for k, v in enumerate(values):
        best[k] = 1 + max((best[j] for j in range(k) if values[j] < v), default=0)
    return max(best, default=0)


def test_op8_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        values = rng.sample(range(100), rng.randint(0, 12))
        places = op8_license_scan.increasing(values)
        own = [values[k] for k in places]
        assert own == sorted(own) and places == sorted(places) and len(places) == longest_increasing(values)


def test_op8_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = op8_license_scan.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def brute_patience(a, b, doubts):
    """Matched pairs of a patience diff, written down recursively: ends, unique common words, gaps. doubts gets a 1 where several chains of anchors are longest."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(x + 1, y + 1) for x, y in brute_patience(a[1:], b[1:], doubts)]
    if a[-1] == b[-1]:
        return brute_patience(a[:-1], b[:-1], doubts) + [(len(a) - 1, len(b) - 1)]
    unique = [(a.index(w), b.index(w)) for w in dict.fromkeys(a) if a.count(w) == 1 == b.count(w)]
    chains = [[]]
    for pair in sorted(unique):
        chains += [c + [pair] for c in chains if not c or c[-1][1] < pair[1]]
    longest = [c for c in chains if len(c) == max(map(len, chains))]
    doubts.extend([1] * (len(longest) > 1))
    if not longest[0]:
        return []
    out, x, y = [], 0, 0
    for ax, ay in [*longest[0], (len(a), len(b))]:
        out += [(x + i, y + j) for i, j in brute_patience(a[x:ax], b[y:ay], doubts)] + [(ax, ay)]
        x, y = ax + 1, ay + 1
    return out[:-1]


def test_op8_alignment_equals_a_brute_patience_diff():
    rng = random.Random(3)
    sure = 0
    for _ in range(1000):
        a, b = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 12))] for _ in range(2))
        doubts = []
        wanted = brute_patience(a, b, doubts)
        if not doubts:
            sure += 1
            assert op8_license_scan.align(a, b) == wanted
    assert sure > 300


def test_op8_ties_go_to_the_longer_template_and_then_by_name():
    scanner = op8_license_scan.Scanner({"b": "free as in air", "a": "free as in air", "c": "free as in air and water"}, 0.8)
    assert [x[0] for x in scanner.scan("it is free as in air and water here")] == ["c", "a", "b"]


def test_op8_license_tags():
    scanner = op8_license_scan.Scanner(op8_license_scan.TEMPLATES, 0.8)
    for name in ("MIT", "GPL-2.0-only", "GPL-3.0-or-later", "Apache-2.0", "CC0-1.0"):
        assert [x[0] for x in scanner.scan(f"// SPDX-License-Identifier: {name}")] == [f"{name}-tag"]
    assert [x[0] for x in scanner.scan("SPDX-License-Identifier: Unknown-1.0")] == ["Unknown-1.0-tag"]  # whether a template knows it or not


def test_op8_finds_each_template_in_text():
    scanner = op8_license_scan.Scanner(op8_license_scan.TEMPLATES, 0.8)
    filler = " ".join(f"word{k % 50} the of" for k in range(3000))
    for name, template in op8_license_scan.TEMPLATES.items():
        found = scanner.scan(f"{filler}\n{template.upper()}\n{filler} {template}")
        assert name in [x[0] for x in found] and dict((x[0], x[1]) for x in found)[name] == 1.0
    changed = op8_license_scan.TEMPLATES["MIT-text"].replace("merge, ", "").replace("any person", "each person")
    best = scanner.scan(filler + changed)[0]
    assert best[0] == "MIT-text" and 0.9 < best[1] < 1
    assert scanner.scan("a license to think, copyright nobody") == []


def test_op8_finds_planted_lines(spark, tables, docs):
    lines = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3"}
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in op8_license_scan.op8_license_scan(spark, tables).collect()}
    assert got == {k: {n for n, line in lines.items() if line in t} for k, t in texts(docs).items()}
    assert any(got.values())


def test_op8_cases(odd, nothing):
    got = op8_license_scan.scan_licenses(odd)
    assert got.count() == got.where("license IS NULL AND coverage = 0").count() == len(ODD_ROWS)
    assert op8_license_scan.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the BSD License", None),
        ("Licensed under CC BY 4.0", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-NC 3.0", "CC-BY-NC-3.0"),
        ("available under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        ("Released under CC0 1.0", "CC0-1.0"),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0-name"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
        ("This work is licensed under the GNU General Public Licence v3.0", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
        ("This work is licensed under the GNU Library General Public License, version 3", None),
        ("Licensed under the Apache License, Version 1.1", None),
        ("Licensed under the Mozilla Public License, version 2.0", "MPL-2.0-line"),
        ("Licensed under the MIT License", "MIT"),
        ("mit der Lizenz", None),
        (op8_license_scan.TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"), "GPL-2.0-notice"),
        (op8_license_scan.TEMPLATES["GPL-3.0-notice"].replace("GNU", "GNU Lesser"), "LGPL-3.0-notice"),
        (op8_license_scan.TEMPLATES["BSD-2-Clause"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
        (op8_license_scan.TEMPLATES["BSD-2-Clause"] + " THIS SOFTWARE IS PROVIDED AS IS", "BSD-2-Clause"),
        (op8_license_scan.TEMPLATES["ISC"], "ISC"),
    ],
)
def test_op8_tells_siblings_apart(text, name):
    scanner = op8_license_scan.Scanner(op8_license_scan.TEMPLATES, 0.8)
    for around in ("{}", "this is under licensed version the {} this License of 2 and by name"):
        assert [x[0] for x in scanner.scan(around.format(text))] == ([name] if name else [])


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_op9_held_out_accuracy(spark, tables, docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = op9_language_id.op9_language_id(spark, tables).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 20 and sum(held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op9_distance_equals_its_definition():
    profiles = {"a": [int(g) for g in op9_language_id.ranked("the cat sat on the mat", 30)], "b": [int(g) for g in op9_language_id.ranked("el gato en la casa", 30)]}
    for text in ("the hat", "la gata", "zzz", "Ça va"):
        own = [int(g) for g in op9_language_id.ranked(text, 30)]
        distance = {k: sum(abs(n - p.index(g)) if g in p else 30 for n, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert op9_language_id.Profiles(profiles, 30).judge(text) == (best, pytest.approx(1 - distance[best] / (30 * len(own))))


def brute_ngrams(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    out, whole = {}, f" {' '.join(low.split())} "
    for n in (1, 2, 3):
        for k in range(len(whole) - n + 1):
            if (gram := whole[k : k + n]) != " " and whole.strip():
                out[gram] = out.get(gram, 0) + 1
    return out


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_op9_ngrams_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(op9_language_id, "PIECE", piece)
    unpack = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s)
    rng = random.Random(1)
    for text in ["1 Ab-c", "", " ", "x", *("".join(rng.choice("aB1 é-\n文") for _ in range(rng.randint(0, 25))) for _ in range(300))]:
        assert {unpack(int(g)): int(n) for g, n in zip(*op9_language_id.counted(text))} == brute_ngrams(text)


def test_op9_learns_every_language_and_ties_go_by_name(spark):
    words = {f"l{n:03d}": " ".join(chr(0x4E00 + 40 * n + k) for k in range(30)) for n in range(200)} | {"zz": "same words", "aa": "same words"}
    rows = [(n, text, lang) for n, (lang, text) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    for few in (0, 10_000):
        op9_language_id.FEW_LANGUAGES, before = few, op9_language_id.FEW_LANGUAGES
        profiles = op9_language_id.learn_profiles(df)
        op9_language_id.FEW_LANGUAGES = before
        assert set(profiles) == set(words)
    got = {r["id"]: r["lang_pred"] for r in op9_language_id.identify(df, profiles, id_col="id").collect()}
    assert all(got[n] == ("aa" if lang == "zz" else lang) for n, (_, _, lang) in enumerate(rows))


def test_op9_cases(odd, nothing):
    training = op9_language_id.training_rows(odd)
    got = op9_language_id.identify(odd, op9_language_id.learn_profiles(training))
    und = {(r["doc_id"], r["score"]) for r in got.where("lang_pred = 'und'").collect()}
    assert und == {(1, 0.0), (2, 0.0), (3, 0.0), (None, 0.0), (8, 0.0)}
    assert got.count() == len(ODD_ROWS)
    assert op9_language_id.learn_profiles(op9_language_id.training_rows(nothing)) == {}
    assert op9_language_id.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    carried = op9_language_id.identify(odd, {}, carry=True).select("row.*")
    assert carried.columns == odd.columns and carried.count() == len(ODD_ROWS)


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_op10_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op10_quality.op10_quality_classifier(spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(held) / len(held) > 0.93


def test_op10_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(4)
    width = len(op10_quality.MEASURES)
    positive = rng.normal(1, 1, (400, width))
    unlabelled = np.vstack((rng.normal(1, 1, (300, width)), rng.normal(-1, 1, (300, width))))
    model = op10_quality.fit(positive, unlabelled, 0.5)
    right = np.mean(np.concatenate((model.scores(rng.normal(1, 1, (500, width))) >= 0.5, model.scores(rng.normal(-1, 1, (500, width))) < 0.5)))
    assert right > 0.95


def test_op10_slope_is_the_gradient_of_its_risk():
    rng = np.random.default_rng(6)
    xp, xu = rng.normal(0.5, 1, (50, 6)), rng.normal(0, 1, (70, 6))

    def parts(w, prior):
        gp, gu = xp @ w, xu @ w
        return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()

    clipped = 0
    for _ in range(60):
        w, prior = rng.normal(0, 2, 6), rng.choice([0.3, 0.9])
        positive, negative = parts(w, prior)
        risk = (lambda x: sum(parts(x, prior))) if negative >= 0 else (lambda x: -parts(x, prior)[1])
        clipped += negative < 0
        numeric = [(risk(w + d) - risk(w - d)) / 2e-6 for d in np.eye(6) * 1e-6]
        assert np.allclose(op10_quality.slope(w, xp, xu, prior), numeric, atol=1e-5)
    assert 5 < clipped < 55


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_op10_prior_of_known_mixtures(prior):
    rng = np.random.default_rng(7)
    width, n = len(op10_quality.MEASURES), 4000
    good = int(n * prior)
    unlabelled = rng.permutation(np.vstack((rng.normal(1, 1, (good, width)), rng.normal(-0.5, 1, (n - good, width)))))
    assert abs(op10_quality.estimated_prior(rng.normal(1, 1, (n, width)), unlabelled) - prior) < 0.05
    assert op10_quality.estimated_prior(np.empty((0, width)), unlabelled) == 0.5


def test_op10_negatives_change_nothing(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality")).where("doc_id % 2 = 0")
    other = labels.withColumn("quality", F.when(F.col("quality") == 1, 1).otherwise(0))
    more = labels.unionByName(docs.where("doc_id % 2 = 0 AND doc_id % 3 <> 0").select("doc_id", F.lit(-5).alias("quality")))
    first = op10_quality.learn(docs, other)
    assert np.array_equal(first.weights, op10_quality.learn(docs, more).weights) and 0.01 <= first.prior <= 0.99


def test_op10_shares_ids_and_reads_texts_of_chosen_ones(spark):
    rows = [(k, f"Some words of text number {k}.") for k in range(300)] + [(3, f"hot {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 2)], "doc_id long, quality int")
    model = op10_quality.learn(df, labels, sample=40)
    assert len(model.weights) and op10_quality.score(df, model).count() == 800


def test_op10_cases(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (6, 1), (77, 1), (None, 1)], "doc_id long, quality int")
    model = op10_quality.learn(odd, labels)
    got = op10_quality.score(odd, model)
    assert got.count() == got.where("score BETWEEN 0 AND 1").count() == len(ODD_ROWS)
    blank = op10_quality.learn(nothing, labels.where("false"))
    assert {r["score"] for r in op10_quality.score(odd, blank).collect()} == {0.5}
    assert op10_quality.score(nothing, model).count() == 0


# --- shared ------------------------------------------------------------------------------------------------------------


def test_stages_are_deleted_at_the_end_of_their_block(spark):
    with common.stages(spark) as own:
        df = common.staged(spark.range(5))
        kept = common.staged(df)
        assert df.count() == 5
        paths = [p.removeprefix("file://") for p in own]
        own.pop()
    assert [os.path.isdir(p) for p in paths] == [False, True] and kept.count() == 5
    assert common.staged(spark.range(2)).count() == 2


def test_no_local_folder_on_a_cluster(monkeypatch, spark):
    class Cluster:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        common.shared_folder(Cluster)


def test_no_operator_changes_the_session(spark, tables, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    op2_media.op2_media_columns(spark, tables).count()
    op10_quality.op10_quality_classifier(spark, tables).count()
    assert spark.conf.get(name) == before


def test_words_and_shingles_equal_their_definition():
    rng = random.Random(9)
    seen = {}
    for _ in range(300):
        text = "".join(rng.choice("ab AB\t\n\x0b\xa0é") for _ in range(rng.randint(0, 40)))
        own = shingles(text)
        assert len(common.shingle_set(text)) == len(own)
        for s, h in zip(sorted(own), [None] * len(own)):
            seen[s] = h
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
        hashes = common.word_hashes(text)
        assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
