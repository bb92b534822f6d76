"""Spelling variants, conversation repair and secret scans against brute force, and their stated cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerline.llm import op8_license_scan, op11_spelling, op12_conversation_repair, op13_secret_scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


# --- 11 ----------------------------------------------------------------------------------------------------------------


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def shorter_by_one(word):
    return {word[:k] + word[k + 1 :] for k in range(len(word))}


def replaced(word):
    return {word[:k] + "\0" + word[k + 1 :] for k in range(len(word))}


def brute_variants(words):
    """(word, n, form, root, n_near, form_n) by looking up every deletion and every wildcard of a word."""
    wild = defaultdict(set)
    for w in words:
        for key in replaced(w):
            wild[key].add(w)
    near = {w: {v for key in replaced(w) for v in wild[key]} - {w} for w in words}
    for w in words:
        for v in shorter_by_one(w) & words.keys():
            near[w].add(v)
            near[v].add(w)
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, form.get(w), root(w), len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def variants(frame):
    return [tuple(r) for r in frame.select("word", "n", "form", "root", "n_near", "form_n").collect()]


def test_op11_equals_brute_force(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = variants(op11_spelling.op11_spelling_variants(spark, tables))
    wanted = brute_variants(brute_words(rows))
    assert len(got) == len(wanted) > 500
    assert set(got) == wanted
    assert any(r[2] for r in got) and any(r[3] not in (r[0], r[2]) for r in got) or len({r[3] for r in got}) > 1


def test_op11_tiles_of_a_hot_prefix_count_every_pair_once(spark, monkeypatch):
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(rng.choice((5, 6, 7)))) + rng.choice(("", "end")): rng.randint(3, 40) for _ in range(600)}
    words |= {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.randint(3, 40) for _ in range(800)}
    words |= {"chain" + "x" * k: 3 * 2**k for k in range(9)} | {"aaaaa": 5, "aaaaaa": 5, "aaaaaaa": 5}
    for block, step in ((8, 200), (512, 1 << 23)):
        monkeypatch.setattr(op11_spelling, "BLOCK", block)
        monkeypatch.setattr(op11_spelling, "STEP_BYTES", step)
        got = variants(op11_spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
        assert len(got) == len(words)
        assert set(got) == brute_variants(words)
    assert max(len(r[3]) for r in got if r[0] == "chain") == len("chain") + 8


def test_op11_tiles_return_words_not_pairs(spark):
    same = [(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}rd", 3) for k in range(676)]  # every word has 50 near ones
    words = spark.createDataFrame(same, "word string, n long")
    found = op11_spelling.tiles(words).groupBy("l", "side", "group", "first", "second").applyInPandas(op11_spelling.compare_tile, "word string, n_near long, best_n long, best string")
    assert found.count() <= 2 * 676 * 4
    assert op11_spelling.near_words(words).agg(F.sum("n_near")).first()[0] == 676 * 50


def test_op11_cases(spark):
    fields = "doc_id long, text string, word string, n string, l string, side string"
    long = "x" * 50_000
    rows = [(1, None, "a", "b", "c", "d"), (2, "", "a", "b", "c", "d"), (None, "Wordy wordy WORDY wordé " + long, "a", "b", "c", "d")] + [(5, long + " " + long[1:] + " çédille", "", "", "", "")] * 3
    frame = spark.createDataFrame(rows, fields)
    got = variants(op11_spelling.variant_groups(op11_spelling.word_counts(op11_spelling.damaged_runs(frame))))
    assert set(got) == brute_variants(brute_words([r[:2] for r in rows])) and len(got) >= 3
    assert variants(op11_spelling.variant_groups(op11_spelling.word_counts(op11_spelling.damaged_runs(frame.where("doc_id = 9"))))) == []


# --- 12 ----------------------------------------------------------------------------------------------------------------

ORDER = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def brute_repair(rows, faults):
    """The cheapest edits of rows (role, text), by trying all that cost no more than deleting every row."""
    best = [(2 * len(rows), "D" * len(rows), "", ())]
    most = 2 * len(rows)

    def go(at, cost, audit, roles, kept):
        if cost > min(most, best[0][0]):
            return
        if at == len(rows) and ORDER.fullmatch(roles):
            found = (cost, audit, roles, tuple(kept))
            best[0] = min(best[0], found, key=lambda b: b[:2])
        for c in "ua":
            go(at, cost + 5, audit + "I", roles + c, [*kept, (NAMES[c], "")])
        if at < len(rows):
            role, text = rows[at]
            extra = 5 if faults[at] == 3 else 0
            go(at + 1, cost + 2, audit + "D", roles, kept)
            if faults[at] not in (1, 2):
                go(at + 1, cost + extra, audit + "K", roles + (role[:1] or "?"), [*kept, (role, text)])
                for c in "ua":
                    go(at + 1, cost + 1 + extra, audit + "R", roles + c, [*kept, (NAMES[c], text)])

    go(0, 0, "", "", [])
    return best[0][0], best[0][1], "\n".join(f"{r}:{t}" for r, t in best[0][3])


def brute_damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        held = out[conv_id]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute_faults(rows):
    out = []
    for k, (_, role, text) in enumerate(rows):
        words = re.sub("[\x20\x09-\x0d]", "", text)
        out.append(1 if not words else 2 if any(r[1:] == (role, text) for r in rows[:k]) else 0 if words[-1] in ".!?" else 3)
    return out


def brute_conversations(rows, solve):
    out = {}
    for conv_id, held in brute_damage(rows).items():
        turns = [t for t, _, _ in held if t is not None]
        faults = brute_faults(held)
        cost, audit, text = solve([r[1:] for r in held], faults)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv_id] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations_of(frame):
    got = [(r["conv_id"], tuple(r)[1:]) for r in frame.collect()]
    assert len(got) == len({c for c, _ in got})
    return dict(got)


def forward_repair(rows, faults):
    """The cheapest edits by cost to go, and then letter by letter, the least that keeps the cost: for long conversations."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    n = len(rows)

    def moves(at, state):
        yield "I", 5, at, {2: 3}.get(state, 2), 0
        if at < n:
            extra = 5 if faults[at] == 3 else 0
            yield "D", 2, at + 1, state, 0
            if faults[at] not in (1, 2):
                if (to := step.get((state, rows[at][0][:1]))) is not None:
                    yield "K", extra, at + 1, to, 1
                yield "R", 1 + extra, at + 1, {2: 3}.get(state, 2), 2

    togo = {(n, s): 0 if s in (0, 3) else 5 if s == 2 else 10 for s in range(4)}
    for at in range(n - 1, -1, -1):
        for s in range(4):
            togo[at, s] = min(c + togo[i, t] for _, c, i, t, _ in moves(at, s) if i > at)
        for _ in range(3):
            for s in range(4):
                togo[at, s] = min(togo[at, s], 5 + togo[at, {2: 3}.get(s, 2)])
    at, state, audit, kept = 0, 0, "", []
    while not (at == n and state in (0, 3)):
        letter, _, i, t, kind = min(m for m in moves(at, state) if m[1] + togo[m[2], m[3]] == togo[at, state])
        made = {2: "user", 3: "assistant"}.get(t)
        if letter in "IR":
            kept.append((made, "" if letter == "I" else rows[at][1]))
        elif letter == "K":
            kept.append(rows[at])
        at, state, audit = i, t, audit + letter
    return togo[0, 0], audit, "\n".join(f"{r}:{x}" for r, x in kept)


def made_rows(rng, n, conv):
    texts = ("One. Two!", "cut off", "  ", "Done?", "again.", "Tab.\t")
    return [(conv, rng.choice((None, k, k, k + 3)), rng.choice(("system", "user", "assistant", "tool", "")), rng.choice(texts) + rng.choice(("", f" {k}."))) for k in range(n)]


def test_op12_weights_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        rows = [r[2:] for r in made_rows(rng, rng.randint(0, 6), 0)]
        faults = brute_faults([(0, *r) for r in rows])
        wanted = brute_repair(rows, faults)
        cost, audit = op12_conversation_repair.cheapest(tuple((r[:1], f) for (r, _), f in zip(rows, faults)))
        assert (cost, audit) == wanted[:2] == forward_repair(rows, faults)[:2]


def test_op12_equals_brute_force(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert conversations_of(op12_conversation_repair.op12_conversation_repair(spark, tables)) == brute_conversations(rows, forward_repair)


def test_op12_cases_and_long_conversations(spark):
    rng = random.Random(7)
    rows = [r for c in range(60) for r in made_rows(rng, rng.randint(1, 9), c)]
    rows += made_rows(rng, 900, 77) + made_rows(rng, 40, None) + [(88, None, None, None)] * 25 + [(None, 2, None, "x"), (99, None, "user", "Hi."), (98, 1, "a", "é 中 😀.")]
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}: ".encode()) % 20 == 0)
    rows += [(dropped, None, "user", "Gone.")] * 30  # all rows of a long conversation go
    wanted = brute_conversations(rows, forward_repair)
    assert wanted[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, place string, gone string, name string").repartition(5)
    for segment in (op12_conversation_repair.SEGMENT, 7, 1):
        assert conversations_of(op12_conversation_repair.repair_conversations(frame, segment)) == wanted
    assert conversations_of(op12_conversation_repair.repair_conversations(frame.where("conv_id = -1"))) == {}


def test_op12_a_segment_is_as_long_as_its_rows(spark):
    rows = tuple((random.Random(9).choice("sua"), k % 4) for k in range(op12_conversation_repair.SEGMENT * 2))
    cost, audit = op12_conversation_repair.cheapest(rows)
    assert sum(c != "I" for c in audit) == len(rows)


# --- 13 ----------------------------------------------------------------------------------------------------------------

NAME_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def brute_base(text):
    """(start, kind number, end) by walking the text by hand."""
    found, at = [], 0
    words = ("password", "passwd", "secret", "token", "api_key", "apikey")
    while at < len(text):
        word = next((w for w in words if low(text[at : at + len(w)]) == w), None) if text[at] in "pPsStTaA" else None
        end = None
        if word:
            k = at + len(word)
            k += text[k : k + 1] in ('"', "'") and k < len(text)
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] in (":", "="):
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                end = k
                while end < len(text) and text[end] in NAME_CHARS:
                    end += 1
                if end > k:
                    if end - k >= 8:
                        found.append((at, 0, end))
                    at = end
                    continue
        at += 1
    for kind, chars, lead, least in ((1, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 16), (2, set("0123456789abcdef"), "", 32)):
        at = 0
        while at < len(text):
            end = at + len(lead)
            if text.startswith(lead, at):
                while end < len(text) and text[end] in chars:
                    end += 1
            if end > at + len(lead):
                if end - at >= least:
                    found.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(found)


def shown(spans):
    return ",".join(f"{op13_secret_scan.KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def base_row(text):
    spans = brute_base(text or "")
    kinds = Counter(kind for _, kind, _ in spans)
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(shown(spans).encode()).hexdigest()


def test_op13_base_spans_equal_a_walk_by_hand(spark):
    tables = "/root/testdata/sf0.01"  # the smallest has no secret
    got = {r["doc_id"]: r for r in op13_secret_scan.op13_secret_scan(spark, tables).collect()}
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert (g["n_assign"], g["n_access"], g["n_hex"], g["base_sha256"]) == base_row(r["text"])
        assert g["spans"] == shown(brute_base(r["text"])) and g["n_added"] == 0  # in these texts, the rules find all that looks alike
    assert sum(g["n_assign"] for g in got.values()) > 0


def test_op13_rules_on_odd_texts():
    rng = random.Random(2)
    parts = ["password", "Api_Key", "apikey", "TOKEN", "toKen", "secret", "ſecret", "toKen", "passwd", "=", ":", " ", "  ", '"', "'", "abcd1234", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 4, "0f", "é", "\n", "x", "/_.", "AKIAAKIA"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert [(s, op13_secret_scan.KINDS.index(k), e) for s, k, e, _ in op13_secret_scan.base_spans(text)] == brute_base(text)


def test_op13_automata_recover_formats():
    rng = random.Random(4)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    keys = ["ghx_" + pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 36) for _ in range(500)]
    made = op13_secret_scan.infer(keys)
    assert len(made.step) < 60  # 500 values make a tree of some 18,000 states
    assert made.reached[0] >= 500 and made.step[0].keys() >= {"g"}
    assert made.used[0]["g"] >= 500 * 0.99
    fresh = "ghx_" + pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 36)
    other = "zzz_" + fresh[4:]
    assert made.bits(fresh) + 6 < made.bits(other)
    assert op13_secret_scan.infer([]).bits("abc") > 0 and op13_secret_scan.infer(reversed(keys)).used == made.used


def test_op13_formats_find_what_no_rule_does_and_leave_plain_tokens(spark):
    rng = random.Random(8)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda: "ghx_" + pick(chars, 36)
    syllables = ("tion", "ment", "er", "ing", "lich", "keit", "wh", "an")
    word = lambda: "".join(rng.choice(syllables) for _ in range(7))
    rows = [(k, f"plain {word()} here password = '{key()}' and card {pick('0123456789', 16)} {word()}") for k in range(400)]
    bare = {1000 + k: key() for k in range(100)}
    rows += [(k, f"é {word()} {v}, end {word()} 192.168.100.100 {pick('0123456789', 16)} some-hyphen-words-go-here") for k, v in bare.items()]
    rows += [(2000 + k, " ".join(word() for _ in range(20)) + " https/" + word() + "/" + word()) for k in range(100)]
    found = {r["doc_id"]: r["secrets"] for r in op13_secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        added = [s["value"] for s in found[k] if not s["base"]]
        assert added == ([bare[k]] if k in bare else [])
        assert all(text[s["start"] : s["end"]].endswith(s["value"]) for s in found[k])


def test_op13_cases(spark):
    rows = [(1, None), (2, ""), (3, "  "), (None, 'token="abcdefgh1"'), (None, 'token="abcdefgh1"'), (4, "w " * 200_000 + "secret: 12345678")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, spans string, tokens string")
    got = sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["secrets"]]) for r in op13_secret_scan.find_secrets(frame).collect())
    assert got == [("1", []), ("2", []), ("3", []), ("4", [("assign", 400_000, 400_016)]), ("None", [("assign", 0, 16)]), ("None", [("assign", 0, 16)])]
    assert op13_secret_scan.find_secrets(frame.where("doc_id = 9")).collect() == []


@pytest.mark.parametrize("text", ["aaaa", "tok" + "e" * 30, "=" * 100])
def test_op13_tokens_without_base_spans(text):
    assert op13_secret_scan.base_spans(text) == []
    assert list(itertools.chain(op13_secret_scan.candidates(text, []))) == ([(0, text)] if len(text) >= 16 else [])


# --- 8 -----------------------------------------------------------------------------------------------------------------


def found_in(text):
    return [f[0] for f in op8_license_scan.Scanner(op8_license_scan.TEMPLATES, 0.8).scan(text)]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)", {"MIT-tag", "GPL-2.0-only-tag"}), ("SPDX-License-Identifier: MPL-2.0 AND ISC", {"MPL-2.0-tag", "ISC-tag"}),
        ("# SPDX-License-Identifier: EUPL-1.2\ncode", {"EUPL-1.2-tag"}), ("License: MIT", {"MIT-tag"}), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", {"GPL-2.0-or-later-tag"}),
        ("License: see the file beside this one", set()), ("The License: none-2", set()), ("SPDX-License-Identifier: MIT.", {"MIT-tag"}), ("SPDX-License-Identifier:", set()),
        ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE", {"Apache-2.0-title"}), ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright", {"GPL-3.0-title"}),
        ("Mozilla Public License Version 2.0\n1. Definitions", {"MPL-2.0-title"}), ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991", {"GPL-2.0-title"}), ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", {"LGPL-3.0-title"}),
    ],
)
def test_op8_tags_are_expressions_and_whole_texts_have_titles(text, names):
    assert set(found_in(text)) == names


def test_op8_own_template_is_aligned_once_a_stretch():
    rng = random.Random(1)
    words = ["the", "of", "license", "shall", "work", *(f"w{k}" for k in range(60))]
    template = " ".join(rng.choice(words) for _ in range(300))
    scanner = op8_license_scan.Scanner({"own": template}, 0.8)
    noise = [" ".join(rng.choice(words) for _ in range(10_000)) for _ in range(2)]
    copy = template.split()
    del copy[50:70]
    aligned, align = [], op8_license_scan.Scanner.match
    op8_license_scan.Scanner.match = lambda self, *a: aligned.append(a[:2]) or align(self, *a)
    try:
        (name, coverage, first, last), *rest = scanner.scan(f"{noise[0]} {' '.join(copy)} {noise[1]}")
        assert (name, rest) == ("own", []) and 0.9 < coverage < 0.95 and 9_990 < first <= 10_000 and last - first < 300
        assert len(aligned) < 400 and scanner.scan(noise[0]) == []
    finally:
        op8_license_scan.Scanner.match = align


def test_op8_tag_scan_is_linear():
    began = time.perf_counter()
    assert found_in("\n" * 400_000 + " # * " * 100_000 + "License") == []
    assert time.perf_counter() - began < 5
