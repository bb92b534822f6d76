"""Queries over catalogs, bodies and outlines, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators import anchors, catalog, nodes, sections, sessions
from ledgerline.plans.fixtures import MANY, PARTS, fixture, item_text, part, toc_label, with_sql
from ledgerline.sources.staging import scratch, staged
from ledgerline.sources.tables import write_filings

HEAD = 2000

# DuckDB's patterns know ASCII white space only.
WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    scripts = rf"regexp_replace({x}, '(?i)<script[^>]*>[\s\S]*?</script>', ' ', 'g')"
    return collapse_sql(f"regexp_replace({scripts}, '<[^>]+>', ' ', 'g')")


def slug_sql(x: str) -> str:
    plain = f"regexp_replace(lower({trim_sql(x)}), '[''\"]', '', 'g')"
    return f"coalesce(nullif(regexp_replace(regexp_replace({plain}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section')"


KEY_SQL = r"nullif(upper(regexp_extract(label, '(?i)\bitem\s+(\d{1,2}[a-z]?)\b', 1)), '')"
RANK_SQL = r"CAST(regexp_extract(item_key, '^\d+') AS BIGINT) * 100 + CASE WHEN regexp_matches(item_key, '[A-Z]$') THEN ascii(right(item_key, 1)) - 64 ELSE 0 END"


BARE_LEAD = r"(?i)^item \d{1,2}[a-z]?\b"


def bare_sql(x: str) -> str:
    return f"(regexp_matches({x}, '{BARE_LEAD}') AND length(trim(regexp_replace(regexp_replace({x}, '{BARE_LEAD}', ''), '^[ .:;—·-]+', ''))) < 3)"


def heading_ctes(name: str, source: str, column: str) -> str:
    """CTEs that end in one called name: the rows of source with `heading`, what the first item of a column reads as."""
    return rf"""
{name}_b AS (SELECT *, regexp_extract({collapse_sql(column)}, '(?i)\bitem \d{{1,2}}[a-z]?\b.*$') AS b FROM {source}),
{name}_p AS (SELECT *, regexp_extract(b, '(?i)^item \d{{1,2}}[a-z]?\b *[.:—·-]* *') AS p FROM {name}_b),
{name}_r AS (SELECT *, trim(regexp_replace(trim(p), '[.:] *$', '')) AS head,
        trim(regexp_replace(trim(regexp_replace(trim(substr(b, length(p) + 1)), '(?i)\bitem \d{{1,2}}\b.*$', '')), ' *\.{{3,}} *$', '')) AS rest FROM {name}_p),
{name} AS (SELECT *, CASE WHEN b <> '' THEN substring(CASE WHEN length(rest) >= 2 AND regexp_matches(rest, '[A-Za-z]{{2}}')
  THEN regexp_replace(concat(head, '. ', rest), ' +\.', '.', 'g') ELSE head END, 1, 220) END AS heading FROM {name}_r)"""


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    """The derived filings, written as a table of html would be: html that is read several times is not made as often."""
    return staged(fixture(spark, sf, "filing_html").select("doc_id", "html").repartition("doc_id"))


def normalize_filing_key(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.normalize_key(fixture(spark, sf, "filing_requests")).select("request_id", "ticker", "year", "form_type")


def pick_filing(spark: SparkSession, sf: str) -> DataFrame:
    picked = catalog.pick_filing(fixture(spark, sf, "filing_requests"), fixture(spark, sf, "filing_catalog"))
    return picked.select("request_id", "year", "accession", "filing_date", "match_kind")


PICK_SQL = """
listed AS (SELECT upper(ticker) AS ticker, upper(form_type) AS form_type, filing_date, accession FROM filing_catalog), by_year AS (
  SELECT ticker, form_type, year(filing_date) AS y, max(filing_date) AS d FROM listed GROUP BY ALL
), in_year AS (
  SELECT c.ticker, c.form_type, b.y, max(c.accession) AS accession, b.d FROM by_year b JOIN listed c
  ON c.ticker = b.ticker AND c.form_type = b.form_type AND c.filing_date = b.d GROUP BY ALL
), newest AS (
  SELECT ticker, form_type, accession, d, row_number() OVER (PARTITION BY ticker, form_type ORDER BY d DESC) AS rn FROM in_year
)"""


def resolve_filing_body(spark: SparkSession, sf: str) -> DataFrame:
    found = catalog.resolve_body(fixture(spark, sf, "filing_bodies"))
    return found.select("accession", F.length("html").cast("long").alias("html_chars"), F.md5("html").alias("html_md5"), "text")


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


def html_head_slice(spark: SparkSession, sf: str) -> DataFrame:
    shown = catalog.filing_display(fixture(spark, sf, "pages"), HEAD)
    return shown.select("page_id", F.length("display_html").cast("long").alias("shown_chars"), F.md5("display_html").alias("shown_md5"), "html_partial")


def _checked_by() -> dict[str, Column]:
    """What packs are checked by, in place of whole texts."""
    return {"html_partial": F.col("html_partial"), "shown_chars": F.length("display_html").cast("long"), "text_md5": F.md5("text")}


def filing_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the outlined html filings that they pick, whole."""
    bodies = _filings(spark, sf).select("doc_id", "html", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("markdown"))
    return _shown_pack(catalog.filing_pack(fixture(spark, sf, "filing_requests"), fixture(spark, sf, "filing_catalog"), bodies, body_key="doc_id", shown_as=_checked_by()))


def archive_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The same over an archive that is partitioned by form and filing year: one filing a document, folders that no request picks unread."""
    path = scratch(spark)
    write_filings(fixture(spark, sf, "filing_archive"), path)
    archive = spark.read.parquet(path)
    return _shown_pack(catalog.filing_pack(fixture(spark, sf, "filing_requests"), archive, archive, folders=("form_type", "filing_year"), shown_as=_checked_by()))


def _shown_pack(pack: DataFrame) -> DataFrame:
    anchor_ids = F.md5(F.concat_ws(",", F.transform("anchors", lambda a: a["id"])))
    return pack.select("request_id", "ticker", "year", "form_type", "accession", "match_kind", "html_partial", "shown_chars", "text_md5", F.when(F.col("anchors").isNotNull(), anchor_ids).alias("anchor_ids"))


# Raw anchors of the filings, from the parts that they are made of and the rules of the passes, without reading html.
FILING_ANCHORS = f"""
sections AS (SELECT f.*, k FROM filing_texts f CROSS JOIN (SELECT unnest(generate_series(0, {PARTS - 1})) AS k) WHERE kind < 4),
links AS (SELECT doc_id, k AS seq, kind, concat('i', k) AS id, {collapse_sql(toc_label("k"))} AS link, CASE WHEN kind = 2 THEN {toc_label("k")} ELSE {item_text("k")} END AS target FROM sections),
{heading_ctes("targets", "links", "target")},
lines AS (
  SELECT doc_id, 2 + k AS seq, CASE kind WHEN 1 THEN concat('I', k) WHEN 2 THEN concat('i', k) END AS own, {collapse_sql(toc_label("k"))} AS line FROM sections
  UNION ALL SELECT doc_id, 1000 + 2 * k, CASE WHEN kind = 2 OR (kind = 0 AND k = 0) THEN NULL ELSE concat('i', k) END, {collapse_sql(item_text("k"))} FROM sections
  UNION ALL SELECT doc_id, 1001 + 2 * k, NULL, {collapse_sql(item_text("k"))} FROM sections WHERE kind = 2
), item_lines AS (
  SELECT *, {slug_sql("substring(line, 1, 48)")} AS base FROM lines
  WHERE length(line) BETWEEN 8 AND 350 AND regexp_matches(line, '(?i)^item\\s+\\d{{1,2}}[a-z]?\\b') AND (own IS NULL OR own NOT IN (SELECT id FROM links l WHERE l.doc_id = lines.doc_id))
), titles AS (
  SELECT doc_id, 500 + k AS seq, 1 + (doc_id + k) % 6 AS level, {collapse_sql(f"substring({part('k')}, 1, 30)")} AS label FROM sections
  UNION ALL SELECT doc_id, n AS seq, 6, 'Note' FROM filing_texts CROSS JOIN (SELECT unnest(generate_series(1, {MANY})) AS n) WHERE kind = 3
), slugs AS (SELECT *, {slug_sql("substring(label, 1, 200)")} AS base FROM titles WHERE label <> ''
), filing_anchors AS (
  SELECT doc_id, 1 AS pass, seq, id, CASE WHEN {bare_sql("link")} THEN coalesce(heading, link) ELSE link END AS label, 2 AS level, 'toc' AS source FROM targets
  UNION ALL SELECT doc_id, 2, seq, concat(base, CASE WHEN n > 1 THEN concat('-', n) ELSE '' END), label, level, 'heading' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY seq) AS n FROM slugs)
  UNION ALL SELECT doc_id, 4, seq, coalesce(own, concat('sec-item-', base, CASE WHEN n > 1 THEN concat('-', n) ELSE '' END)), substring(line, 1, 160), 1, 'item' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY seq) AS n FROM item_lines)
)"""


def request_cache_flag(spark: SparkSession, sf: str) -> DataFrame:
    asked = fixture(spark, sf, "events").select(F.col("event_id").alias("request_id"), "ts", "event_type")
    return sessions.replay_cache(asked, ["event_type"]).select("request_id", "event_type", "cached")


def html_nodes(spark: SparkSession, sf: str) -> DataFrame:
    found = nodes.html_nodes(fixture(spark, sf, "pages"), "page_id")
    return found.groupBy("page_id").agg(F.sum((F.col("tag") == "h1").cast("long")).alias("headings"), F.sum((F.col("tag") == "p").cast("long")).alias("paragraphs"), F.sum(((F.col("tag") == "a") & F.col("href").isNotNull()).cast("long")).alias("links"))


def toc_links(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.anchor_rows(_filings(spark, sf)).where("source = 'toc'")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.select("doc_id", (place - 1).cast("long").alias("seq"), "id", "label", F.col("level").cast("long").alias("level"))


def toc_elements(spark: SparkSession, sf: str) -> DataFrame:
    """How many elements, and how many in-document links, of each filing lie in a likely table of contents."""
    found = nodes.html_nodes(_filings(spark, sf)).withColumn("link", (F.col("tag") == "a") & F.col("href").startswith("#"))
    in_toc, link = F.col("in_toc").cast("long"), F.coalesce(F.col("in_toc") & F.col("link"), F.lit(False)).cast("long")
    return found.groupBy("doc_id").agg(F.sum(in_toc).alias("toc_elements"), F.sum(link).alias("toc_links"), F.count("*").alias("elements"))


def heading_anchors(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.anchor_rows(fixture(spark, sf, "pages"), "page_id").where("source = 'heading'")
    return found.select("page_id", "id", "label", F.col("level").cast("long").alias("level"))


# As in html, these entities count without their semicolon too: titles that were cut may end in one.
HEADING_TEXT = collapse_sql("""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')""")


def heading_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "raw_anchors").where("pass = 2").select("doc_id", "seq", F.when(F.col("seq") % 5 == 4, F.col("id")).alias("own_id"), "label")
    return anchors.heading_ids(rows).select("doc_id", F.col("seq").cast("long").alias("seq"), "anchor")


def anchor_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.first_wins(fixture(spark, sf, "raw_anchors"))
    return found.select("doc_id", "id", F.col("pass").cast("long").alias("pass"), F.col("seq").cast("long").alias("seq"), "label")


def first_wins_sql(source: str) -> str:
    return f"firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pass, seq) AS rn FROM {source})"


MERGED = f"""keyed AS (SELECT *, {KEY_SQL} AS item_key FROM firsts WHERE rn = 1), merged AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_key ORDER BY length({collapse_sql("label")}) DESC, regexp_matches({collapse_sql("label")}, '[a-z]') DESC, replace(replace(lower({collapse_sql("label")}), 'ß', 'ss'), 'ς', 'σ'), pass, seq) AS best,
         first_value(pass) OVER (PARTITION BY doc_id, item_key ORDER BY pass, seq) AS first_pass,
         first_value(seq) OVER (PARTITION BY doc_id, item_key ORDER BY pass, seq) AS first_seq
  FROM keyed WHERE item_key IS NOT NULL)"""
PLACED = f"""{MERGED}, every AS (
  SELECT doc_id, id, label, level, source, item_key, -1 AS item_rank, pass, seq FROM keyed WHERE item_key IS NULL
  UNION ALL SELECT doc_id, id, label, level, source, item_key, {RANK_SQL}, first_pass, first_seq FROM merged WHERE best = 1
), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_rank, pass, seq) AS place FROM every)"""
FILING_OUTLINE = f"{FILING_ANCHORS}, {first_wins_sql('filing_anchors')}, {PLACED}"


def item_anchor_merge(spark: SparkSession, sf: str) -> DataFrame:
    keyed = anchors.with_item_keys(anchors.first_wins(fixture(spark, sf, "raw_anchors")))
    found = anchors.merge_items(keyed)
    return found.select("doc_id", "item_key", "id", "label", F.col("first_pass").cast("long").alias("first_pass"), F.col("first_seq").cast("long").alias("first_seq"))


def anchor_outline(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.ordered_outline(fixture(spark, sf, "raw_anchors"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "id", "display", "item_key")


def filing_outline(spark: SparkSession, sf: str) -> DataFrame:
    found = anchors.build_outline(_filings(spark, sf))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "id", "label", F.col("level").cast("long").alias("level"), "source")


OUTLINE_SQL = f"""
{with_sql("filing_texts")}, {FILING_OUTLINE}
SELECT doc_id, place, id, label, CAST(level AS BIGINT) AS level, source FROM placed WHERE place <= {anchors.MAX_ANCHORS}
"""
PACK_SQL = f"""
{with_sql("filing_requests", "filing_catalog", "filing_html")}, {PICK_SQL}, {FILING_OUTLINE}, picked AS (
  SELECT r.request_id, upper(r.ticker) AS ticker, r.year, upper(r.form_type) AS form_type, coalesce(a.accession, n.accession) AS accession,
         CASE WHEN a.accession IS NOT NULL THEN 'year' WHEN n.accession IS NOT NULL THEN 'latest' ELSE 'none' END AS match_kind
  FROM filing_requests r LEFT JOIN in_year a ON a.ticker = upper(r.ticker) AND a.form_type = upper(r.form_type) AND a.y = try_cast(r.year AS INT)
  LEFT JOIN newest n ON n.ticker = upper(r.ticker) AND n.form_type = upper(r.form_type) AND n.rn = 1
), outlines AS (SELECT doc_id, md5(string_agg(id, ',' ORDER BY place)) AS anchor_ids FROM placed WHERE place <= {anchors.MAX_ANCHORS} GROUP BY doc_id
), shown AS (SELECT doc_id, length(html) > {catalog.HEAD_CHARS} AS html_partial, least(length(html), {catalog.HEAD_CHARS}) AS shown_chars, md5(substring({strip_sql("html")}, 1, {catalog.TEXT_CHARS})) AS text_md5 FROM filing_html)
SELECT p.*, h.html_partial, h.shown_chars, h.text_md5, o.anchor_ids
FROM picked p LEFT JOIN filing_catalog c ON c.accession = p.accession LEFT JOIN shown h ON h.doc_id = c.doc_id LEFT JOIN outlines o ON o.doc_id = c.doc_id
"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "labels_seen")


def bare_item_label(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("doc_id", "k", tx.is_bare_item_label(F.col("label")).alias("bare"))


def item_heading_line(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("doc_id", "k", tx.item_heading(F.col("label")).alias("heading"))


def item_key_rank(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _labels(spark, sf).withColumn("item_key", tx.item_key(F.col("label")))
    return keyed.select("doc_id", "k", "item_key", F.when(F.col("item_key").isNotNull(), tx.item_rank(F.col("item_key"))).cast("long").alias("item_rank"))


def slugify_heading(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("doc_id", "k", tx.slugify(F.col("label")).alias("slug"))


def decode_fragment(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("doc_id", "k", tx.decode_fragment(F.col("label")).alias("decoded"))


#: Asked fragments and labels of every filing: by id, in another case, percent-encoded, unknown; by item, by words, by nothing.
WANTED = (("#i2", "Item 3. Properties"), ("I4", "Item 5A"), ("i%35", "Item 6"), ("i6", "no such words"), ("i1", "Item 12"), ("zzz", "See Item"), ("i7", "legal matters,"))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.explode(F.array(*(F.struct(F.lit(a).alias("fragment"), F.lit(b).alias("label")) for a, b in WANTED)))
    return fixture(spark, sf, "documents").select("doc_id", asked.alias("w")).select("doc_id", "w.*")


WANTED_SQL = f"wanted AS (SELECT doc_id, unnest([{', '.join(repr(a) for a, _ in WANTED)}]) AS fragment, unnest([{', '.join(repr(b) for _, b in WANTED)}]) AS label FROM documents)"
# Where the filings have what is asked for, by looking for the tags that they are made of. by_id counts the elements of the body alone.
FOUND_SQL = f"""
asked AS (SELECT *, CASE fragment WHEN '#i2' THEN 2 WHEN 'I4' THEN 4 WHEN 'i%35' THEN 5 WHEN 'i6' THEN 6 WHEN 'i1' THEN 1 WHEN 'i7' THEN 7 END AS k FROM wanted),
met AS (
  SELECT a.*, h.html, h.kind,
    CASE WHEN k IS NULL THEN 0 WHEN h.kind = 0 AND k % 2 = 1 THEN strpos(html, concat('<div id=', chr(39), 'i', k, chr(39), '>')) WHEN h.kind = 2 THEN strpos(html, concat('<td id="i', k, '">')) ELSE strpos(html, concat('<p id="i', k, '">')) END AS exact,
    CASE WHEN k IS NOT NULL AND h.kind = 1 THEN strpos(html, concat('<td id="I', k, '">')) ELSE 0 END AS upper_id
  FROM asked a JOIN filing_html h USING (doc_id)
), titled AS (SELECT doc_id, {", ".join(f"{item_text(k)} AS t{k}" for k in range(PARTS))} FROM filing_texts),
placed_labels AS (
  SELECT m.*, CASE WHEN m.kind = 4 THEN 0
      WHEN label = 'Item 3. Properties' THEN CASE WHEN m.kind = 2 THEN strpos(html, concat('<p>', t2)) ELSE exact END
      WHEN label = 'Item 5A' THEN CASE WHEN m.kind = 2 THEN strpos(html, concat('<p>', t4)) ELSE exact END
      WHEN label = 'Item 6' THEN CASE WHEN m.kind = 2 THEN strpos(html, concat('<p>', t5)) ELSE exact END
      WHEN label = 'See Item' THEN strpos(html, '<p>See Item 10')
      WHEN label = 'legal matters,' THEN CASE WHEN m.kind = 2 THEN strpos(html, concat('<p>', t7)) ELSE exact END ELSE 0 END AS by_label
  FROM met m JOIN titled USING (doc_id))"""


def fragment_slice(spark: SparkSession, sf: str) -> DataFrame:
    found = sections.fragment_slices(_filings(spark, sf), _wanted(spark, sf).select("doc_id", "fragment"))
    return found.select("doc_id", "fragment", F.col("start").cast("long").alias("start"), F.length("slice").cast("long").alias("chars"), F.md5("slice").alias("slice_md5"))


SLICE_SQL = f"""
{with_sql("filing_html")}, {WANTED_SQL}, {FOUND_SQL}, starts AS (
  SELECT doc_id, fragment, html, CASE WHEN kind = 1 AND fragment = 'I4' THEN upper_id WHEN kind = 1 AND upper_id > 0 THEN least(exact, upper_id) ELSE exact END AS p FROM placed_labels)
SELECT doc_id, fragment, CASE WHEN p > 0 THEN p - 1 END AS start, CASE WHEN p > 0 THEN length(substr(html, p, {sections.FRAGMENT_CHARS})) END AS chars,
       CASE WHEN p > 0 THEN md5(substr(html, p, {sections.FRAGMENT_CHARS})) END AS slice_md5 FROM starts
"""


def anchor_target(spark: SparkSession, sf: str) -> DataFrame:
    named = nodes.html_nodes(_filings(spark, sf)).where("id IS NOT NULL OR name IS NOT NULL").select("doc_id", "seq", "start", "in_toc", "id", "name")
    found = sections.anchor_targets(staged(named), _wanted(spark, sf))
    return found.select("doc_id", "fragment", F.col("candidates").cast("long").alias("candidates"), F.col("start").cast("long").alias("start"), "in_toc")


def locate_section(spark: SparkSession, sf: str) -> DataFrame:
    found = sections.locate_sections(staged(nodes.html_nodes(_filings(spark, sf))), _wanted(spark, sf))
    return found.select("doc_id", "label", F.col("start").cast("long").alias("start"))


def resolve_section(spark: SparkSession, sf: str) -> DataFrame:
    html = _filings(spark, sf)
    found = sections.resolve_sections(html, staged(nodes.html_nodes(html)), _wanted(spark, sf))
    return found.select("doc_id", "fragment", "label", "method", F.col("start").cast("long").alias("start"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_filing_key, pick_filing, resolve_filing_body, html_to_text, html_head_slice, filing_pack, archive_pack, request_cache_flag, html_nodes,
        toc_links, toc_elements, heading_anchors, heading_ids, anchor_first_wins, item_anchor_merge, anchor_outline, filing_outline, bare_item_label,
        item_heading_line, item_key_rank, slugify_heading, decode_fragment, fragment_slice, anchor_target, locate_section, resolve_section,
    )
}

ORACLE_SQL = {
    "normalize_filing_key": f"{with_sql('filing_requests')} SELECT request_id, upper(ticker) AS ticker, year, upper(form_type) AS form_type FROM filing_requests",
    "pick_filing": f"""
{with_sql("filing_requests", "filing_catalog")}, {PICK_SQL}
SELECT r.request_id, r.year, coalesce(a.accession, n.accession) AS accession, coalesce(a.d, n.d) AS filing_date,
       CASE WHEN a.accession IS NOT NULL THEN 'year' WHEN n.accession IS NOT NULL THEN 'latest' ELSE 'none' END AS match_kind
FROM filing_requests r
LEFT JOIN in_year a ON a.ticker = upper(r.ticker) AND a.form_type = upper(r.form_type) AND a.y = try_cast(r.year AS INT)
LEFT JOIN newest n ON n.ticker = upper(r.ticker) AND n.form_type = upper(r.form_type) AND n.rn = 1
""",
    "resolve_filing_body": f"""
{with_sql("filing_bodies")}, b AS (
  SELECT accession, CASE WHEN {trim_sql("html")} <> '' THEN substring(html, 1, 8000000) END AS html, nullif({trim_sql("coalesce(text, '')")}, '') AS own, markdown FROM filing_bodies)
SELECT accession, length(html) AS html_chars, md5(html) AS html_md5,
       substring(coalesce(own, nullif({strip_sql("html")}, ''), {trim_sql("coalesce(markdown, '')")}), 1, 500000) AS text
FROM b
""",
    "html_to_text": f"SELECT page_id, {strip_sql('html')} AS text FROM pages",
    "html_head_slice": f"""
SELECT page_id, least(length(html), {HEAD}) AS shown_chars, md5(substring(html, 1, {HEAD})) AS shown_md5, length(html) > {HEAD} AS html_partial FROM pages
""",
    "filing_pack": PACK_SQL,
    "archive_pack": PACK_SQL.replace(with_sql("filing_catalog").removeprefix("WITH "), with_sql("archive_catalog").removeprefix("WITH ")).replace("filing_catalog", "archive_catalog"),
    "request_cache_flag": """
WITH RECURSIVE o AS (
  SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events
), r AS (
  SELECT event_id, event_type, rn, us AS loaded, false AS cached FROM o WHERE rn = 1
  UNION ALL
  SELECT o.event_id, o.event_type, o.rn, CASE WHEN o.us - r.loaded < 600000000 THEN r.loaded ELSE o.us END, o.us - r.loaded < 600000000
  FROM r JOIN o ON o.event_type = r.event_type AND o.rn = r.rn + 1
) SELECT event_id AS request_id, event_type, cached FROM r
""",
    "html_nodes": r"""
SELECT page_id, len(regexp_extract_all(b, '<h1[ >]')) AS headings, len(regexp_extract_all(b, '<p[ >]')) AS paragraphs, len(regexp_extract_all(b, '<a [^>]*href=')) AS links
FROM (SELECT page_id, regexp_replace(substr(html, strpos(html, '<body>') + 6), '<!--[\s\S]*?-->', '', 'g') AS b FROM pages)
""",
    "toc_links": f"""
{with_sql("filing_texts")}, {FILING_ANCHORS}
SELECT doc_id, seq, id, label, CAST(2 AS BIGINT) AS level FROM filing_anchors WHERE pass = 1
""",
    "toc_elements": f"""
{with_sql("filing_html")}, c AS (
  SELECT doc_id, html, strpos(html, '<table>') - 1 <= {nodes.TOC_TABLE_PLACE} * length(html) AS early, len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) - 2 AS elements FROM filing_html WHERE kind < 4)
SELECT doc_id, CASE WHEN early THEN {3 * PARTS + 1} ELSE 0 END AS toc_elements, CASE WHEN early THEN {PARTS} ELSE 0 END AS toc_links, elements FROM c
""",
    "heading_anchors": f"SELECT page_id, {slug_sql('substring(label, 1, 200)')} AS id, label, CAST(1 AS BIGINT) AS level FROM (SELECT page_id, substring({HEADING_TEXT}, 1, 220) AS label FROM pages) WHERE label <> ''",
    "heading_ids": f"""
{with_sql("raw_anchors")}, h AS (SELECT doc_id, seq, CASE WHEN seq % 5 = 4 THEN id END AS own, CASE WHEN seq % 5 <> 4 THEN {slug_sql("substring(label, 1, 200)")} END AS base FROM raw_anchors WHERE pass = 2)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE WHEN base IS NULL THEN own WHEN n = 1 THEN base ELSE concat(base, '-', n) END AS anchor
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY seq) AS n FROM h)
""",
    "anchor_first_wins": f"{with_sql('raw_anchors')}, {first_wins_sql('raw_anchors')} SELECT doc_id, id, CAST(pass AS BIGINT) AS pass, CAST(seq AS BIGINT) AS seq, label FROM firsts WHERE rn = 1",
    "item_anchor_merge": f"{with_sql('raw_anchors')}, {first_wins_sql('raw_anchors')}, {MERGED} SELECT doc_id, item_key, id, label, CAST(first_pass AS BIGINT) AS first_pass, CAST(first_seq AS BIGINT) AS first_seq FROM merged WHERE best = 1",
    "anchor_outline": f"""
{with_sql("raw_anchors")}, {first_wins_sql("raw_anchors")}, {PLACED}
SELECT doc_id, place, id, concat(repeat('  ', greatest(0, level - 1)), label) AS display, item_key FROM placed WHERE place <= {anchors.MAX_ANCHORS}
""",
    "filing_outline": OUTLINE_SQL,
    "bare_item_label": f"{with_sql('labels_seen')}, t AS (SELECT doc_id, k, {collapse_sql('label')} AS t FROM labels_seen) SELECT doc_id, k, {bare_sql('t')} AS bare FROM t",
    "item_heading_line": f"{with_sql('labels_seen')}, {heading_ctes('headed', 'labels_seen', 'label')} SELECT doc_id, k, heading FROM headed",
    "item_key_rank": f"{with_sql('labels_seen')}, keyed AS (SELECT doc_id, k, {KEY_SQL} AS item_key FROM labels_seen) SELECT doc_id, k, item_key, CASE WHEN item_key IS NOT NULL THEN {RANK_SQL} END AS item_rank FROM keyed",
    "slugify_heading": f"{with_sql('labels_seen')} SELECT doc_id, k, {slug_sql('label')} AS slug FROM labels_seen",
    "decode_fragment": f"{with_sql('labels_seen')} SELECT doc_id, k, url_decode(label) AS decoded FROM labels_seen",
    "fragment_slice": SLICE_SQL,
    "locate_section": f"""
{with_sql("filing_html")}, {WANTED_SQL}, {FOUND_SQL}
SELECT doc_id, label, by_label - 1 AS start FROM placed_labels WHERE by_label > 0
""",
    "resolve_section": f"""
{with_sql("filing_html")}, {WANTED_SQL}, {FOUND_SQL}, r AS (
  SELECT *, CASE WHEN kind = 4 THEN 0 WHEN exact = 0 THEN 0 WHEN upper_id > 0 THEN 2 ELSE 1 END AS candidates,
    CASE WHEN kind = 1 AND fragment = 'I4' THEN upper_id WHEN kind = 1 AND upper_id > 0 THEN least(exact, upper_id) ELSE exact END AS first_place FROM placed_labels)
SELECT doc_id, fragment, label, CASE WHEN candidates = 2 OR (candidates = 1 AND kind <> 2) THEN 'target' WHEN length(html) > {sections.HEAD_CHARS} AND first_place > 0 THEN 'slice'
         WHEN by_label > 0 THEN 'label' WHEN candidates = 1 THEN 'toc' ELSE 'none' END AS method,
       CASE WHEN candidates = 2 OR (candidates = 1 AND kind <> 2) THEN exact - 1 WHEN length(html) > {sections.HEAD_CHARS} AND first_place > 0 THEN first_place - 1
         WHEN by_label > 0 THEN by_label - 1 WHEN candidates = 1 THEN exact - 1 END AS start FROM r
""",
    "anchor_target": f"""
{with_sql("filing_html")}, {WANTED_SQL}, {FOUND_SQL}
SELECT doc_id, fragment, CAST(CASE WHEN upper_id > 0 THEN 2 ELSE 1 END AS BIGINT) AS candidates, exact - 1 AS start, kind = 2 AS in_toc FROM placed_labels WHERE exact > 0 AND kind < 4
""",
}
