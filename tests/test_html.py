"""Goldens, worked out by hand, for the operators that parse html."""

from __future__ import annotations

import random
import re
import time
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import prompts as px
from ledgerline.functions import text as tx
from ledgerline.operators import anchors, needles, nodes, sections
from ledgerline.operators.questions import plan_comparison
from ledgerline.plans.fixtures import fixture


def outline(spark, html):
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    return [(r["id"], r["label"], r["level"], r["source"]) for r in anchors.build_outline(df).orderBy("place").collect()]


def test_no_body_has_no_anchors(spark):
    assert outline(spark, "<h1>Title</h1>") == []


def test_unclosed_tags_nest_and_end_tags_close_up():
    tree = nodes.Tree("<body><p>a<p>b</body><i>c</i>")
    assert [(e.tag, e.element_children, e.inside) for e in tree.elements] == [("body", 1, True), ("p", 1, True), ("p", 0, True), ("i", 0, False)]
    tree = nodes.Tree("<body><div><br>x</span>y</div>")
    assert [(e.tag, e.children) for e in tree.elements] == [("body", 1), ("div", 3), ("br", 0)]


def test_text_leaves_out_scripts_and_comments():
    tree = nodes.Tree("<body><p>a&amp;b<!-- c --><script>d</script> e</p></body>")
    assert tree.text(tree.body()[0], 100) == tree.text(tree.body()[0], 5) == "a&b e"
    assert tree.text(tree.body()[0], 3) == "a&b"


def test_text_joins_and_spaced_text_parts():
    tree = nodes.Tree("<body><td> one<b>two </b>  three\n<i> </i>four</td></body>")
    cell, bold = tree.body()[:2]
    assert (tree.text(cell, 99), tree.spaced_text(cell, 99), tree.spaced_text(cell, 7)) == ("onetwo three four", "one two three four", "one two")
    assert (tree.text(bold, 99), tree.short_text(cell, 16), tree.short_text(cell, 17)) == ("two", None, "onetwo three four")


@pytest.mark.parametrize("piece", ["<p>a", "<p>\n", "<p><a href='#x'>Item 1.</a>", "<table><tr id='x'><td><a href='#x'>Item 1", "<h2>Title", "x</span><p>", "<div>Item 2 y<script>", "<td id=k> Item 3. word word"])
def test_unclosed_tags_take_linear_time(piece):
    times = {}
    for n in (20_000, 80_000):
        html = f"<body>{piece * n}"
        began = time.process_time()
        assert sum(1 for _ in nodes.element_rows(html)) + sum(1 for _ in nodes.anchor_element_rows(html)) > 0
        times[n] = time.process_time() - began
    assert times[80_000] < 10 * times[20_000] + 0.5
    assert times[80_000] < 20


def test_eight_megabytes_of_unclosed_tags(spark):
    html = "<body>" + "<p>Item 1. Business" * 420_000
    assert len(html) > 7_900_000
    began = time.monotonic()
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert anchors.build_outline(df).count() == 1  # every line but the last goes on to the end of the document, so is not short
    assert time.monotonic() - began < 60


def test_last_attribute_counts():
    assert nodes.Tree("<body><p id='a' id='b' hidden>").body()[0].attrs == {"id": "b", "hidden": ""}


def test_repeated_headings_are_numbered(spark):
    got = outline(spark, "<body><h2>Part</h2><h2 id='x'>Part</h2><h3>Part</h3><h2> </h2></body>")
    assert got == [("part", "Part", 2, "heading"), ("x", "Part", 2, "heading"), ("part-2", "Part", 3, "heading")]


def test_targets_are_never_pushed(spark):
    got = outline(spark, "<body><a href='#far'>Far</a><p id='far'>Somewhere far away</p></body>")
    assert got == [("far", "Far", 2, "toc")]


def test_item_lines(spark):
    nine = "<b>x</b>" * 9
    got = outline(spark, f"<body><p>Item 1. Business</p><p>Item 2</p><div>Item 3. Long {nine}</div><span id='s'>ITEM 1B. STAFF</span></body>")
    assert got == [("sec-item-item-1-business", "Item 1. Business", 1, "item"), ("s", "ITEM 1B. STAFF", 1, "item")]


def test_bare_links_take_the_heading_of_their_target(spark):
    toc = "<a href='#A'>Item 1.</a><a href='#b'>Item 2</a><a href='#c'>Item 3</a><a href='#d'> Item 4 . </a><a href='#%65'>Item 5</a><a href='# f '>Item 6: plan</a><a href='#'>x</a>"
    body = "<table><tr><td id='a'>Item 1</td><td>Business</td></tr></table><a name=' b '></a><p id='c'><b>Item</b> 3. <i>Legal</i> Item 4. Next</p><div><div id='d'>nothing</div></div><p id='e'>Item 5 ..... 12</p>"
    got = {x[0]: x[1] for x in outline(spark, f"<body>{toc}{body}</body>") if x[3] == "toc"}
    assert got == {"A": "Item 1. Business", "b": "Item 2", "c": "Item 3. Legal", "d": "Item 4 .", "e": "Item 5 ....", "f": "Item 6: plan"}


def test_item_lines_with_ids_that_are_taken(spark):
    got = outline(spark, "<body><a href='#x'>Link</a><p id='x'>Item 1. One</p><p id='y'>Item 2. Two</p><p id='y'>Item 3. Two</p><p id=' '>Item 4. Four</p><p>Item 4. Four</p><h1 id='z'>Z</h1><p id='z'>Item 5. Five</p></body>")
    assert [(x[0], x[3]) for x in got] == [("x", "toc"), ("z", "heading"), ("y", "item"), ("sec-item-item-4-four-2", "item")]


def test_outline_is_made_in_one_pass(spark):
    plan = anchors.build_outline(spark.createDataFrame([(1, "<p>")], "doc_id long, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_outline_shuffles_once(spark):
    df = spark.createDataFrame([(1, "<body><h1>A</h1></body>")], "doc_id long, html string")
    plan = anchors.build_outline(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 + plan.count("ReusedExchange") + plan.count("BroadcastExchange") or plan.count("MapInPandas") == plan.count("Exchange hashpartitioning(doc_id")


def test_richer_label_folds_case(spark):
    rows = [(1, 1, 1, "b", "Item 1. Strasza", 1, "toc"), (1, 1, 2, "c", "Item 1. Straßex", 1, "toc")]
    df = spark.createDataFrame(rows, "doc_id long, pass int, seq int, id string, label string, level int, source string")
    assert anchors.merge_items(anchors.with_item_keys(df)).first()["id"] == "c"  # strassex comes before strasza
    assert one(spark, tx.case_folded, "ΟΔΟΣ ẞß") == "οδοσ ssss"


def test_items_are_cut_last(spark):
    got = outline(spark, "<body><p>Item 10. Tenth</p><p>Item 2. Second</p><h1>First</h1></body>")
    assert [x[0] for x in got] == ["first", "sec-item-item-2-second", "sec-item-item-10-tenth"]
    df = spark.createDataFrame([(1, "<body><p>Item 10. Tenth</p><p>Item 2. Second</p><h1>First</h1></body>")], "doc_id long, html string")
    assert anchors.build_outline(df, max_anchors=2).count() == 2


@pytest.mark.parametrize(
    ("fragment", "start"),
    [("i0", "<a name"), ("##i0", "<a name"), (" i0 ", "<a name"), ("I2", '<p id="i2"'), ("i%32", '<p id="i2"'), ("I7", "<div id='i7'"), ("", None), ("#", None), ("zzz", None)],
)
def test_fragments(spark, tables, fragment, start):
    html = fixture(spark, tables, "filing_html").where("doc_id = 0").first()["html"]
    at = sections.fragment_starts(html, [fragment])[0]
    assert at is None if start is None else html[at:].startswith(start)


def test_double_quotes_go_first_then_single_then_alike():
    html = "<p id='X '>0</p><p name=' x'>1</p><p id='x'>2</p><p data-id=\"y\">3</p><p dataid=\"x\">4</p><p dataid='z'>5</p><p ID = \"X\">6</p><p id=\"y\">7"
    starts = sections.fragment_starts(html, ["x", "y", "z", "w", "X%20"])
    assert [None if at is None else html[at : html.index("<", at + 1)][-1] for at in starts] == ["6", "3", "5", None, "0"]
    assert sections.fragment_starts("id='a'", ["a"]) == [0] and sections.fragment_starts("", ["a", ""]) == [None, None]


def by_searches(html, fragment):
    """The rule said as searches over the whole html, one after the other."""
    wanted = unquote(fragment.strip().lstrip("#"))
    if not wanted:
        return None
    for pattern in (r'\b(?:id|name)\s*=\s*"%s"', r"(?:id|name)\s*=\s*'%s'"):
        if found := re.search(pattern % re.escape(wanted), html, re.I):
            break
    else:
        found = next((m for m in re.finditer(r"""\b(?:id|name)\s*=\s*["']([^"']+)["']""", html, re.I) if m[1].strip().lower() == wanted.lower()), None)
    return None if found is None else max(html.rfind("<", 0, found.start()), -1) if html.rfind("<", 0, found.start()) >= 0 else found.start()


def test_one_scan_finds_what_searches_find():
    rng = random.Random(3)
    for _ in range(3000):
        html = "".join(rng.choice(["<p ", "id=", "name =", " ID= ", "data-id=", "xname=", '"a"', "'a'", "'A '", '"b"', "' b'", '"', "'", ">", "a", "b"]) for _ in range(rng.randint(1, 14)))
        for fragment in ("a", "B", "#a"):
            assert sections.fragment_starts(html, [fragment]) == [by_searches(html, fragment)], html


def test_slices_do_not_pass_through_python(spark):
    html = "é😀<p id='a'>x😀y</p><p id='b'>z" + "w" * 50
    pages = spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")
    wanted = spark.createDataFrame([(d, f) for d in (1, 2) for f in ("#a", "b", "no")], "doc_id long, fragment string")
    found = sections.fragment_slices(pages, wanted, max_chars=12)
    got = {(r["doc_id"], r["fragment"]): (r["start"], r["length"], r["slice"]) for r in found.collect()}
    a, b = html.index("<p id='a'"), html.index("<p id='b'")
    assert got == {(1, "#a"): (a, 12, html[a : a + 12]), (1, "b"): (b, 12, html[b : b + 12]), (1, "no"): (None,) * 3} | {(2, f): (None,) * 3 for f in ("#a", "b", "no")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "substring(html" in plan  # a worker that cut slices held its batch of html once for every fragment


def test_headings_are_matched_once(spark):
    rows = spark.createDataFrame([("x",)], "label string").select(tx.item_heading(F.col("label")).alias("h"))
    assert rows._jdf.queryExecution().analyzed().toString().count(r"\.{3,}") == 1


def test_every_unicode_space_is_collapsed(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    others = [chr(c) for c in range(1, 0x3100) if not chr(c).isspace()]
    df = spark.createDataFrame([("a" + c + "b", True) for c in spaces] + [("a" + c + "b", False) for c in others], "t string, space boolean")
    assert df.where((tx.collapsed(F.col("t")) == "a b") != F.col("space")).count() == 0


def test_second_candidate_is_the_body(spark):
    html = "<body><table><tr><td id='A'>toc</td></tr></table><p id='a'>body</p></body>"
    found = nodes.html_nodes(spark.createDataFrame([(1, html)], "doc_id long, html string"))
    row = sections.anchor_targets(found, spark.createDataFrame([(1, "#a")], "doc_id long, fragment string")).first()
    assert (row["candidates"], html[row["start"] :][:9]) == (2, "<p id='a'")


def test_section_cascade(spark):
    toc = "<table>" + "".join(f"<tr><td><a href='#s{k}' id='s{k}'>Item {k}</a></td></tr>" for k in range(1, 5)) + "</table>"
    html = f"<body>{toc}{'<p>filler text</p>' * 50}<h2>Item 2 Properties here</h2><p id='t'>Legal matters</p></body>"
    pages = spark.createDataFrame([(1, html)], "doc_id long, html string")
    wanted = spark.createDataFrame([(1, "s2", "Item 2"), (1, "t", "Legal"), (1, "s4", "Item 4"), (1, "no", "nothing like it")], "doc_id long, fragment string, label string")
    got = {r["fragment"]: (r["method"], None if r["start"] is None else html[r["start"] :][:7]) for r in sections.resolve_sections(pages, nodes.html_nodes(pages), wanted).collect()}
    assert got["s2"] == ("label", "<h2>Ite")
    assert got["t"] == ("target", "<p id='")
    assert got["s4"][0] == "toc"
    assert got["no"] == ("none", None)
    partial = {r["fragment"]: r["method"] for r in sections.resolve_sections(pages, nodes.html_nodes(pages), wanted, head_chars=100).collect()}
    assert partial == {"s2": "slice", "t": "target", "s4": "slice", "no": "none"}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("label", "heading"),
    [("Part I Item 1. Business Item 2. Properties", "Item 1. Business"), ("Item 5 ..... ", "Item 5 ...."), ("Item 1 — Business", "Item 1 —. Business"), ("ITEM 7A: Market Risk ......", "ITEM 7A. Market Risk"), ("no heading", None)],
)
def test_heading_lines(spark, label, heading):
    assert one(spark, tx.item_heading, label) == heading


@pytest.mark.parametrize(("label", "bare"), [("Item 1.", True), ("Item 1A —", True), ("Item 1. AB", True), ("Item 1. Bus", False), ("Note 1", False)])
def test_bare_labels(spark, label, bare):
    assert one(spark, tx.is_bare_item_label, label) is bare


@pytest.mark.parametrize(("label", "slug"), [("Management's \"Plan\" — 2024", "managements-plan-2024"), ("***", "section")])
def test_slugs(spark, label, slug):
    assert one(spark, tx.slugify, label) == slug


def test_unicode_space_is_space(spark):
    assert one(spark, tx.html_to_text, "<p>a b</p>　<script>x</script >c\x1c") == "a b x c"
    assert one(spark, tx.collapsed, "  a b\x1f") == "a b"


@pytest.mark.parametrize(("size", "n", "result"), [(5000, 5000, 5000), (9000, 5576, 5576), (9000, 5577, 5506)])
def test_excerpts(spark, size, n, result):
    assert len(one(spark, lambda c: px.smart_excerpt(c, F.lit(n)), "x" * size)) == result


@pytest.mark.parametrize(
    ("content", "answer", "quote"),
    [("  hi  ", "  hi  ", ""), ("ANSWER: a SOURCE_QUOTE: None", "a", ""), ("ANSWER: a ANSWER: b SOURCE_QUOTE: q1 SOURCE_QUOTE: q2", "a  b", "q1"), ("SOURCE_QUOTE:", "", "")],
)
def test_answers(spark, content, answer, quote):
    assert (one(spark, px.answer_of, content), one(spark, px.quote_of, content)) == (answer, quote)


@pytest.mark.parametrize(
    ("question", "form", "year"),
    [
        ("Compare revenue", "10-K", "2023"), ("what about 2026?", "10-K", "2026"), ("what about 2024?", None, None), ("compare with the 10 Q", "10-Q", "2024"),
        ("10-Q for the prior year", "10-Q", "2023"), ("previous year margin?", None, None), ("another filing please", "10-K", "2023"),
        ("10-Q or 10-K last year", "10-K", "2023"), ("code 20031 only", None, None),
    ],
)
def test_comparison_plan(spark, question, form, year):
    df = spark.createDataFrame([("10-K", "2024", question)], "form_type string, year string, question string")
    row = plan_comparison(df).first()
    assert (row["comparison_form"], row["comparison_year"], row["wanted"]) == (form, year, form is not None)


@pytest.mark.parametrize(("raw", "decoded"), [("50%25 %", "50% %"), ("caf%C3%A9%", "café%"), ("%zz%2", "%zz%2"), ("a%%41+b", "a%A+b"), ("%", "%"), ("%2", "%2"), ("", ""), ("%E2%82%AC+%2B", "€++"), ("100%", "100%")])
def test_decode_fragment_leaves_bad_escapes_alone(spark, raw, decoded):
    from urllib.parse import unquote

    assert unquote(raw) == decoded
    df = spark.createDataFrame([(raw,), (None,)], "f string").select(tx.decode_fragment(F.col("f")).alias("d"))
    assert [r["d"] for r in df.collect()] == [decoded, None]


def test_many_needles_in_one_document(spark):
    rng = random.Random(4)
    docs = [(d, "".join(rng.choice("abé ") for _ in range(400)) if d else None) for d in range(4)]
    asked = [(d, k, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 4))) if k % 9 else None) for d in range(5) for k in range(80)] + [(1, 900, "aa"), (1, 901, "aa"), (None, 1, "a")]
    frames = spark.createDataFrame(asked, "doc_id long, k int, source_quote string"), spark.createDataFrame(docs, "doc_id long, text string")
    wanted = sorted((d, k, m.start() + 1) for d, k, q in asked if d is not None and q and dict(docs).get(d) for m in re.finditer(re.escape(q), dict(docs)[d]))
    got = needles.quote_offsets(*frames)
    assert sorted((r["doc_id"], r["k"], r["quote_offset"]) for r in got.collect()) == wanted and len(wanted) > 1000
    lists = needles.needle_lists(frames[0], "doc_id", "source_quote", most=10).where("doc_id = 1")
    assert lists.count() > 3
    again = needles.with_hits(frames[1].where("doc_id = 1").select("doc_id", F.array(F.struct("text")).alias("texts")).join(lists, "doc_id"))
    assert again.select(F.explode("hits.needle").alias("n")).distinct().count() == len({q for d, _, q in asked if d == 1 and q and q in docs[1][1]})


def test_labels_are_found_in_one_scan(spark):
    rng = random.Random(5)
    words = ["risk", "factors", "legal", "matters", "notes", "cash"]
    body = "".join(f"<p>{' '.join(rng.choice(words) for _ in range(6))}</p>" for _ in range(60))
    pages = spark.createDataFrame([(1, f"<html><body>{body}</body></html>")], "doc_id long, html string")
    labels = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))).title() for _ in range(40)] + ["xyz", "Cash  Notes"]
    wanted = spark.createDataFrame([(1, x) for x in labels], "doc_id long, label string")
    html = pages.first()["html"]
    elements = [(m.start(), m[1]) for m in re.finditer("<p>([^<]*)</p>", html)]

    def place(label):
        needle = " ".join(label.lower().split())[:48]
        hits = [at for at, text in elements if needle in text]
        if hits and max(hits) / len(html) > 0.1:
            hits = [at for at in hits if at / len(html) > 0.06]
        return max(hits, default=None) if len(needle) >= 4 else None

    got = {r["label"]: r["start"] for r in sections.locate_sections(nodes.html_nodes(pages), wanted).collect()}
    assert got == {x: place(x) for x in labels if place(x) is not None} and len(got) > 10


def tree_rows(html, regular):
    tree = nodes.Tree(html, regular)
    shown = [(e.tag, e.attrs, e.start, e.inside, e.children, e.element_children, e.links, e.shown, e.spaced) for e in tree.elements]
    around = [tuple(x and x.start for x in (e.table, e.row, e.cell)) for e in tree.elements]
    return shown, around, tree.shown, tree.spaced, tree.has_body


def test_regular_markup_reads_like_the_lenient_parser(spark, tables):
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<DIV class='a' id=\"x\">", "</div>", "<br>", "<br/>", "<td/>", "<a href=\"#i1\" name=n1>", "</a >", "<td nowrap>", "<ix:nonFraction a.b=1>", "</ix:nonfraction>", "text &amp; more", "&lt;", "&", "&#8212;", " \n\t", "é 😀\u00a0",
              "<!-- a - b -->", "<!---->", "<!-- x -- y -->", "<!DOCTYPE html>", "<script>var a='<p>&amp;</p>';</script>", "<style>p{}</style >", "<SCRIPT src='x'></Script>", "<title>T &amp; t</title>", "<body>", "</body>", "<table>", "<tr>", "</tr>", "</table>"]
    odd = ["<", "< p>", "<p a=\"b", "<p/a>", "<p a=b/c>", "<a href=\"x?a&amp;b=1\">", "<?pi?>", "<!x>", "<!-->", "<p a='1'b='2'>", "</>", "</p x>", "<script>", "<title>a<b>c</title>", "<![CDATA[x]]>", "<p =a>", "<textarea>", "--!>", "<\x00p>", "<p \xa0 b>", "<!-- a --!> b -->"]
    for k in range(3000):
        some = pieces if k % 2 else pieces + odd
        html = "".join(rng.choice(some) for _ in range(rng.randint(1, 25)))
        assert tree_rows(html, True) == tree_rows(html, False), html
    regular = 0
    for html in [r["html"] for r in spark.read.parquet(f"{tables}/pages.parquet").select("html").collect()] + [r["html"] for r in fixture(spark, tables, "filing_html").where("doc_id % 50 <> 7").select("html").collect()]:
        assert tree_rows(html, True) == tree_rows(html, False)
        try:
            bare = nodes.Tree.__new__(nodes.Tree)
            super(nodes.Tree, bare).__init__()
            bare._begin()
            bare._read_regular(html)
            regular += 1
        except nodes.Irregular:
            pass
    assert regular > 150
