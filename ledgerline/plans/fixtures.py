"""Inputs that queries derive from the given tables, as SQL that Spark and DuckDB both run.

Names in braces are tables or other inputs of this module. Rows are made from all rows of their tables and from whole texts; the two
engines differ in the names of explode and sequence only.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources.tables import read_table

#: Parts that a document's text is cut into, and headings of the filings that have too many for an outline.
PARTS, MANY = 8, 340


def _filing_html() -> str:
    """The html of a filing from a document's text `t`: a table of contents, then sections of a heading, an item and a part of the text.

    kind 0 has links to ids and to a link's name; 1 repeats every id in its table of contents, in upper case; 2 has ids in the table of
    contents alone; 3 has more headings than an outline takes; 4 has no body. Some filings are so long that only their head is shown.
    """
    toc = "".join(
        f"""'<tr><td', CASE kind WHEN 1 THEN ' id="I{k}"' WHEN 2 THEN ' id="i{k}"' ELSE '' END, '><a href="#i{k}">', {toc_label(k)}, '</a></td></tr>', """ for k in range(PARTS)
    )
    parts = "".join(f"{heading_html(k)}, {item_html(k)}, '<p>', {entities(part(k))}, '</p>', " for k in range(PARTS))
    return f"""concat(CASE WHEN kind = 4 THEN '<html><div>' ELSE '<html><body>' END, '<table>', {toc}'</table>',
  CASE WHEN kind = 3 THEN repeat('<h6>Note</h6>', {MANY}) ELSE '' END, {parts}
  '<p>See Item 10 below, Item 14</p><script>var x="Item 2. Nope";</script>',
  CASE WHEN doc_id % 50 = 7 THEN repeat(concat('<p>', {entities("t")}, '</p>'), CAST(ceil(520000.0 / (length(t) + 7)) AS INT)) ELSE '' END,
  CASE WHEN kind = 4 THEN '</div></html>' ELSE '</body></html>' END)"""


def part(k: int | str) -> str:
    """Part k of the text."""
    return f"substring(t, CAST(1 + {k} * size AS INT), CAST(size AS INT))"


def entities(x: str) -> str:
    """A text as it is written in html."""
    return f"replace(replace({x}, '&', '&amp;'), '<', '&lt;')"


def item_text(k: int | str) -> str:
    """The item line of section k: number, perhaps a letter, and a title."""
    return f"concat('Item ', CAST({k} + 1 AS STRING), CASE WHEN {k} % 3 = 1 THEN 'A' ELSE '' END, '. ', CASE {k} % 4 WHEN 0 THEN 'Business of ' WHEN 1 THEN 'Risk Factors ' WHEN 2 THEN 'Properties ..... ' ELSE 'Legal Matters, ' END, upper(substring(md5(t), CAST(1 + {k} AS INT), 4)))"


def toc_label(k: int | str) -> str:
    """What a link says: the item's number, or the whole line in capitals."""
    return f"CASE WHEN {k} % 2 = 0 THEN concat(substring({item_text(k)}, 1, CASE WHEN {k} % 3 = 1 THEN 7 ELSE 6 END), '.') ELSE upper({item_text(k)}) END"


def heading_html(k: int) -> str:
    level = f"CAST(1 + (doc_id + {k}) % 6 AS STRING)"
    return f"'<h', {level}, '>', {entities(f'substring({part(k)}, 1, 30)')}, '</h', {level}, '>'"


def item_html(k: int) -> str:
    named = f"""concat('<table><tr><td><a name="i{k}"></a>', {item_text(k)}, '</td></tr></table>')""" if k == 0 else f"""concat('<div id=\'\'i{k}\'\'>', {item_text(k)}, '</div>')""" if k % 2 else f"""concat('<p id="i{k}">', {item_text(k)}, '</p>')"""
    return f"""CASE kind WHEN 0 THEN {named} WHEN 2 THEN concat('<div><p>', {item_text(k)}, '</p></div>') ELSE concat('<p id="i{k}">', {item_text(k)}, '</p>') END"""


#: The catalog's columns of an archive in which every document is a filing of its own.
ARCHIVED = """doc_id AS accession, concat('T', CAST(doc_id % 50 AS STRING)) AS ticker,
       CASE doc_id % 7 WHEN 0 THEN '10-K' WHEN 1 THEN '10-q' WHEN 2 THEN '8-K' WHEN 3 THEN '20-F' WHEN 4 THEN '10-K' ELSE '6-K' END AS form_type,
       CAST('1994-01-01' AS DATE) + CAST(doc_id * 37 % 3600 AS INT) AS filing_date"""

FIXTURES = {
    "filing_catalog": """
SELECT o_orderkey AS accession, concat(CASE WHEN o_orderkey % 3 = 0 THEN 't' ELSE 'T' END, CAST(o_custkey % 50 AS STRING)) AS ticker,
       CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '8-K'
            WHEN '4-NOT SPECIFIED' THEN '20-F' ELSE '6-K' END AS form_type,
       CAST(o_orderdate AS DATE) AS filing_date, o_orderkey % (SELECT count(*) FROM {documents}) AS doc_id
FROM {orders}""",
    "archive_catalog": f"SELECT {ARCHIVED}, doc_id FROM {{documents}}",
    "filing_archive": f"SELECT {ARCHIVED}, html, CAST(NULL AS STRING) AS text, CAST(NULL AS STRING) AS markdown FROM {{filing_html}}",
    "filing_requests": """
SELECT event_id AS request_id, ts, user_id,
       concat(CASE WHEN event_id % 2 = 0 THEN 't' ELSE 'T' END, CAST(user_id % 53 AS STRING)) AS ticker,
       CASE WHEN event_id % 40 = 7 THEN 'n/a' ELSE CAST(1993 + event_id % 11 AS STRING) END AS year,
       CASE event_type WHEN 'click' THEN '10-K' WHEN 'view' THEN '10-q' WHEN 'error' THEN '8-K' WHEN 'signup' THEN '20-F'
            ELSE '10-K' END AS form_type
FROM {events}""",
    "user_texts": """
SELECT conv_id, min_by(text, turn) AS text FROM {conversations} WHERE role = 'user' GROUP BY conv_id""",
    "questions": """
SELECT request_id, ticker, year, form_type,
       CASE WHEN request_id % 3 = 0 THEN concat(coalesce(u.text, ''), ' ', asked) WHEN request_id % 7 = 1 THEN coalesce(u.text, '') ELSE asked END AS question
FROM (SELECT *, CASE request_id % 20
         WHEN 0 THEN 'Compare revenue with the filing' WHEN 1 THEN 'What changed versus 1997?'
         WHEN 2 THEN 'Show the 10 Q and the 10-K for the prior year' WHEN 3 THEN 'previous year margin?'
         WHEN 4 THEN 'revenue last year in the 8k' WHEN 5 THEN 'How did cash compare to the past 10-K?'
         WHEN 6 THEN 'margin vs peers' WHEN 7 THEN 'vs. nothing' WHEN 8 THEN 'another filing please'
         WHEN 9 THEN 'YoY growth' WHEN 10 THEN 'In FY2003 what was EPS?' WHEN 11 THEN 'code 20031 only'
         WHEN 12 THEN 'look at 1999 and 2001 20-F' WHEN 13 THEN 'relative to older numbers'
         WHEN 14 THEN 'summarise item 7' WHEN 15 THEN 'cross-year view of 20F'
         WHEN 16 THEN 'last 10 filings' WHEN 17 THEN 'comparison with 8-K' WHEN 18 THEN ''
         ELSE 'historical filing, year 2030' END AS asked FROM {filing_requests}) r
CROSS JOIN (SELECT coalesce(max(conv_id), 0) + 1 AS n FROM {conversations}) c LEFT JOIN {user_texts} u ON u.conv_id = r.request_id % c.n""",
    "llm_responses": """
SELECT conv_id, turn,
       CASE (conv_id + turn) % 6
         WHEN 0 THEN text
         WHEN 1 THEN concat('ANSWER: ', text, ' SOURCE_QUOTE: ', substring(text, 5, 20))
         WHEN 2 THEN concat('ANSWER: ', text, ' SOURCE_QUOTE: None')
         WHEN 3 THEN concat('ANSWER: a ANSWER: b SOURCE_QUOTE: q1 SOURCE_QUOTE: q2')
         WHEN 4 THEN concat('  ', text, '  ')
         ELSE 'SOURCE_QUOTE:' END AS content
FROM {conversations} WHERE role = 'assistant'""",
    "filing_texts": """
SELECT doc_id, doc_id % 5 AS kind, t, ceil(length(t) / 8.0) AS size
FROM (SELECT doc_id, coalesce(text, '') AS t FROM {documents}) d""",
    "filing_html": f"SELECT doc_id, kind, {_filing_html()} AS html FROM {{filing_texts}}",
    "session_events": """
SELECT event_id AS seq, ts, user_id,
       CASE WHEN event_id % 5 = 0 THEN 't' ELSE 'T' END || CAST(event_id % 30 AS STRING) AS ticker,
       CAST(1995 + event_id % 4 AS STRING) AS year, '10-K' AS form_type, event_type AS action, props AS payload
FROM {events}""",
    "chat_events": """
SELECT turn AS seq, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(coalesce(turn, 0) / 2 AS INT) AS ts, conv_id AS user_id,
       CASE WHEN turn % 2 = 0 THEN 't' ELSE 'T' END || CAST(turn % 3 AS STRING) AS ticker, '2023' AS year, role AS form_type, role AS action, text AS payload
FROM {conversations}""",
    "document_bodies": """
SELECT doc_id, CAST(NULL AS STRING) AS html, text, CAST(NULL AS STRING) AS markdown FROM {documents}""",
    "text_parts": """
SELECT doc_id, k, n, substring(t, CAST(1 + 200 * k AS INT), 200) AS part FROM (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) / 200 AS n, explode(sequence(0, CAST(floor(length(coalesce(text, '')) / 200) AS INT))) AS k FROM {documents}) d""",
    "labels_seen": """
SELECT doc_id, k,
       CASE (doc_id + k) % 14
         WHEN 0 THEN concat('Item ', CAST(doc_id % 17 AS STRING), '.')
         WHEN 1 THEN concat('ITEM ', CAST(doc_id % 16 AS STRING), 'A. ', part)
         WHEN 2 THEN concat('Part I Item ', CAST(doc_id % 15 AS STRING), '. ', part, ' Item 2. Properties')
         WHEN 3 THEN concat('Item 5 ..... ', substring(part, 1, CAST(doc_id % 4 AS INT))) WHEN 4 THEN concat('Item 1 — ', part) WHEN 5 THEN concat('ITEM 7A: ', part, ' ......')
         WHEN 6 THEN part WHEN 7 THEN concat('Management''s "Plan" — ', part) WHEN 8 THEN '***'
         WHEN 9 THEN concat(part, ' See Item ', CAST(doc_id % 15 AS STRING), ' below') WHEN 10 THEN concat('a%20b+c%C3%A9% ', CAST(k AS STRING), '%zz 50%25 % ', part, '%4')
         WHEN 11 THEN concat('#Item%20', CAST(k AS STRING)) WHEN 12 THEN concat('Item 1. ', substring(part, 1, CAST(k % 5 AS INT))) ELSE 'item 1A —' END AS label
FROM {text_parts}""",
    "asked_quotes": """
SELECT doc_id, k, CASE k % 5 WHEN 0 THEN substring(part, CAST(1 + doc_id % 50 AS INT), CAST(4 + k % 7 AS INT)) WHEN 1 THEN substring(part, 10, 6) WHEN 2 THEN 'anan' WHEN 3 THEN concat(substring(part, 1, 5), '~') ELSE '' END AS source_quote
FROM {text_parts}""",
    "filing_bodies": """
SELECT page_id AS accession, CASE WHEN page_id % 5 = 0 THEN '   ' ELSE html END AS html,
       CASE WHEN page_id % 3 = 0 THEN ' ' WHEN page_id % 7 = 0 THEN NULL ELSE concat('  text of ', url, ' ') END AS text,
       concat(' # ', url) AS markdown
FROM {pages}""",
    "raw_anchors": """
SELECT doc_id, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS pass, k AS seq, concat('a', CAST((doc_id + k * k) % (7 + 2 * CAST(floor(n) AS INT)) AS STRING)) AS id,
       CASE k % 4 WHEN 0 THEN concat('Item ', CAST((doc_id + k) % 23 AS STRING), CASE WHEN k % 5 = 0 THEN 'B' ELSE '' END, '. ', part)
                  WHEN 1 THEN concat('ITEM ', CAST((doc_id * k) % 9 AS STRING), ' ', substring('RISK FACTORS AND MORE', 1, CAST(5 + doc_id % 9 AS INT)))
                  WHEN 2 THEN concat('  ', part) ELSE concat('Item ', CAST((doc_id + k) % 9 AS STRING)) END AS label,
       1 + k % 3 AS level, CASE k % 3 WHEN 0 THEN 'toc' WHEN 1 THEN 'heading' ELSE 'item' END AS source
FROM {text_parts}""",
    "chat_requests": """
SELECT q.request_id, q.question, CASE WHEN q.request_id % 3 = 0 THEN 'picked words' WHEN q.request_id % 3 = 1 THEN '' END AS selected_text,
       d.text AS current_context, CASE WHEN q.request_id % 4 = 0 THEN '' ELSE concat('Additional SEC filing context:', d.text) END AS additional_context,
       CASE WHEN q.request_id % 5 = 0 THEN ' own-model ' WHEN q.request_id % 5 = 1 THEN '  ' END AS llm_model,
       CASE WHEN q.request_id % 7 = 0 THEN ' Be brief. ' WHEN q.request_id % 7 = 1 THEN ' ' END AS system_prompt,
       CASE q.request_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 6000 WHEN 2 THEN 500000 END AS current_context_max_chars,
       CASE q.request_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN -5 END AS additional_context_max_chars
FROM {questions} q CROSS JOIN (SELECT count(*) AS n FROM {documents}) s JOIN {documents} d ON d.doc_id = q.request_id % s.n""",
    "stored_settings": """
SELECT user_id, event_id,
       CASE event_id % 9 WHEN 0 THEN '90000' WHEN 1 THEN 'abc' WHEN 2 THEN '  12000px' WHEN 3 THEN '-5' WHEN 4 THEN '999999999999' WHEN 5 THEN '' WHEN 6 THEN CAST(CAST(floor(value) AS INT) AS STRING) WHEN 7 THEN '+70000.9' END AS current_max,
       CASE event_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '-1' WHEN 2 THEN '81000' WHEN 3 THEN ' 500' WHEN 4 THEN '1e5' WHEN 5 THEN event_type END AS additional_max,
       CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '0' WHEN 3 THEN 'false' WHEN 4 THEN 'yes' END AS use_custom,
       CASE event_id % 5 WHEN 0 THEN concat(' ', props, ' ') WHEN 1 THEN '   ' WHEN 2 THEN '' WHEN 3 THEN 'Be brief.' END AS prompt_draft
FROM {events}""",
    "thread_events": """
SELECT seq, ts, user_id, ticker, year, form_type, action,
       CASE WHEN action = 'purchase' AND seq % 3 = 0 THEN concat('ANSWER: ', payload, ' SOURCE_QUOTE: ', substring(payload, 2, 8)) WHEN action = 'purchase' AND seq % 3 = 1 THEN concat(payload, ' SOURCE_QUOTE: None')
            WHEN seq % 17 = 0 THEN NULL ELSE payload END AS payload
FROM {session_events}""",
    "stored_sessions": """
SELECT user_id, seq, CASE WHEN seq % 3 > 0 THEN payload END AS document_html, CASE WHEN seq % 4 > 1 THEN seq % 4 = 2 END AS document_html_partial,
       CASE WHEN seq % 5 > 0 THEN array(action, payload) END AS document_anchors
FROM {session_events}""",
    "active_keys": """
SELECT user_id, ticker, CASE WHEN action = 'error' THEN NULL ELSE year END AS year, form_type
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS place FROM {session_events}) e WHERE place = 1 AND action <> 'signup'""",
    "known_users": """
SELECT user_id FROM {events} UNION SELECT -c_custkey AS user_id FROM {customer}""",
    "quotes": """
SELECT doc_id, text, concat('<p>', text, '</p>') AS html,
       CASE doc_id % 4 WHEN 0 THEN substring(text, 11, 12) WHEN 1 THEN 'the ' WHEN 2 THEN 'not "there" <at> all' ELSE '' END AS source_quote
FROM {documents}""",
}


def needs(name: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in Formatter().parse(FIXTURES[name]) if f))


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived input, or the table of that name."""
    if name not in FIXTURES:
        return read_table(spark, folder, name)
    return spark.sql(FIXTURES[name], **{n: fixture(spark, folder, n) for n in needs(name)})


def _other_dialect(text: str) -> str:
    return text.replace("explode(sequence(", "unnest(generate_series(").replace("array(", "list_value(")


def with_sql(*names: str) -> str:
    """A WITH clause (open for more) that defines derived inputs and what they need, for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in FIXTURES and name not in order:
            for n in needs(name):
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({_other_dialect(FIXTURES[n]).format(**{x: x for x in needs(n)})})" for n in order)
