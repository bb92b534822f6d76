"""Queries over questions, prompts, answers and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import prompts as px
from ledgerline.functions import questions as qx
from ledgerline.operators import needles, prompts, questions, sessions
from ledgerline.operators.catalog import pick_filing
from ledgerline.plans.filings import PICK_SQL, trim_sql
from ledgerline.plans.fixtures import fixture, with_sql
from ledgerline.sources.staging import scratch
from ledgerline.streaming import sessions as streams


def wants_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "questions").select("request_id", qx.wants_comparison(F.col("question")).alias("wanted"))


def question_form(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "questions").select("request_id", qx.question_form(F.col("question")).alias("form"))


def question_year(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "questions").select("request_id", qx.explicit_year(F.col("question")).alias("asked_year"))


def comparison_year(spark: SparkSession, sf: str) -> DataFrame:
    asked = fixture(spark, sf, "questions")
    form = F.coalesce(F.nullif(qx.question_form(F.col("question")), F.lit("")), F.col("form_type"))
    year = qx.comparison_year(F.col("question"), F.col("year"), qx.form_key(form) == qx.form_key(F.col("form_type")))
    return asked.select("request_id", year.alias("comparison_year"))


def comparison_plan(spark: SparkSession, sf: str) -> DataFrame:
    return questions.plan_comparison(fixture(spark, sf, "questions")).select("request_id", "wanted", "comparison_form", "comparison_year")


def comparison_context(spark: SparkSession, sf: str) -> DataFrame:
    found = questions.comparison_context(fixture(spark, sf, "questions"), fixture(spark, sf, "filing_catalog"), fixture(spark, sf, "document_bodies"), body_key="doc_id")
    return found.select("request_id", F.length("additional_context").cast("long").alias("chars"), F.md5("additional_context").alias("context_md5"))


def context_caps(spark: SparkSession, sf: str) -> DataFrame:
    capped = prompts.context_caps(fixture(spark, sf, "chat_requests"))
    return capped.select("request_id", F.col("current_cap").cast("long").alias("current_cap"), F.col("additional_cap").cast("long").alias("additional_cap"))


def smart_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    part = px.smart_excerpt(F.col("text"), F.lit(6000))
    return fixture(spark, sf, "documents").select("doc_id", F.length(part).cast("long").alias("chars"), F.md5(part).alias("excerpt_md5"))


def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    made = prompts.assemble_prompts(fixture(spark, sf, "chat_requests"))
    return made.select("request_id", "model", "system_prompt", "status", F.length("user_prompt").cast("long").alias("prompt_chars"), F.md5("user_prompt").alias("prompt_md5"))


def parse_answer(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.parse_answers(fixture(spark, sf, "llm_responses")).select("conv_id", "turn", "answer", "source_quote")


def quote_in_text(spark: SparkSession, sf: str) -> DataFrame:
    found = prompts.locate_quotes(fixture(spark, sf, "quotes"))
    return found.select("doc_id", F.col("quote_count").cast("long").alias("quote_count"), F.col("quote_start").cast("long").alias("quote_start"), F.md5("marked_text").alias("marked_md5"))


def quote_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of many quotes in each document."""
    found = needles.quote_offsets(fixture(spark, sf, "asked_quotes"), fixture(spark, sf, "documents"))
    return found.select("doc_id", "k", F.col("quote_offset").cast("long").alias("quote_offset"))


def quote_in_html(spark: SparkSession, sf: str) -> DataFrame:
    found = prompts.mark_quotes_in_html(fixture(spark, sf, "quotes"))
    return found.select("doc_id", F.length("marked_html").cast("long").alias("marked_chars"), F.md5("marked_html").alias("marked_md5"))


def latest_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions.latest_sessions(fixture(spark, sf, "session_events"))
    return found.select("user_id", "session_key", "seq", "action", "payload")


def recent_filings(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions.recent_filings(fixture(spark, sf, "session_events"))
    return found.select("user_id", F.col("place").cast("long").alias("place"), "ticker", "year", "form_type")


def restore_key(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.restore_key(fixture(spark, sf, "known_users"), fixture(spark, sf, "active_keys"), fixture(spark, sf, "session_events"))


def session_defaults(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions.with_session_defaults(fixture(spark, sf, "stored_sessions"))
    return found.select("user_id", "seq", "document_html", "document_html_partial", F.size("document_anchors").cast("long").alias("anchors"))


def chat_settings(spark: SparkSession, sf: str) -> DataFrame:
    found = prompts.chat_settings(fixture(spark, sf, "stored_settings"))
    sizes = (F.col(c).cast("long").alias(c) for c in ("current_context_max_chars", "additional_context_max_chars"))
    return found.select("user_id", "event_id", *sizes, "use_custom_prompt", "custom_prompt", F.md5("prompt_to_edit").alias("edit_md5"))


def response_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status codes of the filing and the prompt of each request."""
    picked = pick_filing(fixture(spark, sf, "filing_requests"), fixture(spark, sf, "filing_catalog"))
    filings = prompts.with_status(picked, filing="match_kind").select("request_id", F.col("status_code").cast("long").alias("filing_status"))
    made = prompts.assemble_prompts(fixture(spark, sf, "chat_requests"))
    return filings.join(prompts.with_status(made, prompt="status").select("request_id", F.col("status_code").cast("long").alias("chat_status")), "request_id", "left")


def session_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Threads of records: selections (click), questions (view) and answers (purchase) of each session."""
    found = sessions.chat_threads(fixture(spark, sf, "thread_events"), "click", "view", "purchase")
    shown = F.concat_ws("|", F.transform("messages", lambda m: F.concat_ws(":", m["role"], F.coalesce(m["kind"], F.lit("-")), m["content"], F.coalesce(m["source_quote"], F.lit("-")))))
    return found.select("user_id", "session_key", "n_messages", F.md5(shown).alias("thread_md5"))


def chat_threads(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions.threads(fixture(spark, sf, "conversations"), ["conv_id"], "turn")
    texts = F.concat_ws("|", F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])))
    return found.select("conv_id", "n_messages", F.md5(texts).alias("thread_md5"))


def thread_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as pages of 20 messages."""
    found = sessions.thread_pages(fixture(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], 20)
    shown = F.concat_ws("|", F.transform("messages", lambda m: F.concat_ws(":", m["turn"], m["role"], m["text"])))
    return found.select("conv_id", F.col("page").cast("long").alias("page"), F.col("first").cast("long").alias("first"), F.col("n_messages").cast("long").alias("n_messages"), F.md5(shown).alias("page_md5"))


def session_store(spark: SparkSession, sf: str) -> DataFrame:
    """The sessions that a stream of chat events, eight files of them as micro-batches, leaves in a store."""
    source, path, events = scratch(spark), scratch(spark), fixture(spark, sf, "chat_events")
    events.repartition(8).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.store_sessions(stream, path, scratch(spark), fan=3).awaitTermination()
    return streams.read_sessions(spark, path).select("user_id", "session_key", "seq", "action", "payload")


def session_highlights(spark: SparkSession, sf: str) -> DataFrame:
    found = sessions.selection_effects(fixture(spark, sf, "session_events"), "click")
    return found.select("user_id", "session_key", "seq", "effect", "text", "kind")


def switch_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = fixture(spark, sf, "session_events")
    stored = events.where("action <> 'view'").groupBy("user_id", sessions.session_key().alias("session_key")).agg(F.max("payload").alias("document_text"), F.lit(None).cast("string").alias("document_html"), F.count("*").alias("n_messages"))
    switches = events.where("action = 'view'").groupBy("user_id", sessions.session_key().alias("session_key")).agg(F.max(F.when(F.col("seq") % 2 == 0, F.col("payload"))).alias("new_text"), F.lit("<p>").alias("new_html"))
    return sessions.switch_filing(switches, stored)


QUERIES = {
    f.__name__: f
    for f in (
        wants_comparison, question_form, question_year, comparison_year, comparison_plan, comparison_context, context_caps, smart_excerpt, chat_prompts, parse_answer,
        quote_in_text, quote_offsets, quote_in_html, latest_sessions, recent_filings, restore_key, chat_threads, session_highlights, switch_merge, session_defaults, chat_settings, session_threads, thread_pages, session_store, response_status,
    )
}

YEAR = r"\b(?:19|20)\d{2}\b"
WANTS = f"(regexp_matches(question, '{YEAR}') OR " + " OR ".join(f"contains(lower(question), '{p}')" for p in qx.PHRASES) + ")"
FORM = "CASE " + " ".join(rf"WHEN regexp_matches(lower(question), '\b{n}[\s-]?{x}\b') THEN '{f}'" for n, x, f in qx.FORMS) + " ELSE '' END"
PLAN = f"""
asked AS (
  SELECT *, {WANTS} AS wants, coalesce(nullif({FORM}, ''), form_type) AS form, nullif(regexp_extract(question, '{YEAR}'), '') AS named, try_cast(year AS INT) AS active FROM questions
), same AS (SELECT *, translate(upper(form), ' -', '') = translate(upper(form_type), ' -', '') AS same FROM asked
), yeared AS (
  SELECT *, CASE WHEN named IS NOT NULL THEN CAST(named AS INT)
       WHEN {" OR ".join(f"contains(lower(question), '{p}')" for p in qx.YEAR_BEFORE)} THEN active - 1
       WHEN same AND ({" OR ".join(f"contains(lower(question), '{p}')" for p in qx.EARLIER)} OR regexp_matches(lower(question), '{qx.COMPARING}')) THEN active - 1
       ELSE active END AS y FROM same
), clamped AS (SELECT *, CASE WHEN same AND y >= active AND named IS NULL THEN active - 1 ELSE y END AS cy FROM yeared
), plan AS (
  SELECT *, wants AND active IS NOT NULL AND y IS NOT NULL AND NOT (same AND cy = active) AS wanted FROM clamped
)"""
SESSION_KEY = "concat_ws(':', 'session', upper(ticker), year, upper(form_type))"
EXCERPT = (
    "CASE WHEN length({t}) <= {n} THEN {t} WHEN {n} - ({n} * 62) // 100 - 120 < 2000 THEN substring({t}, 1, {n}) "
    "ELSE concat(substring({t}, 1, ({n} * 62) // 100), chr(10), chr(10), '[... middle of filing omitted for length ...]', chr(10), chr(10), right({t}, {n} - ({n} * 62) // 100 - 120)) END"
)
CAPS = "greatest(2000, least(120000, coalesce(current_context_max_chars, 80000))) AS current_cap, greatest(0, least(80000, coalesce(additional_context_max_chars, 60000))) AS additional_cap"
RECENT = "recent AS (SELECT user_id, ticker, year, form_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS place FROM last_used)"
LAST_USED = "last_used AS (SELECT user_id, ticker, year, form_type, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq FROM {source} GROUP BY ALL)"

ORACLE_SQL = {
    "wants_comparison": f"{with_sql('questions')} SELECT request_id, {WANTS} AS wanted FROM questions",
    "question_form": f"{with_sql('questions')} SELECT request_id, {FORM} AS form FROM questions",
    "question_year": f"{with_sql('questions')} SELECT request_id, nullif(regexp_extract(question, '{YEAR}'), '') AS asked_year FROM questions",
    "comparison_year": f"{with_sql('questions')}, {PLAN} SELECT request_id, coalesce(CAST(y AS VARCHAR), year) AS comparison_year FROM plan",
    "comparison_plan": f"""
{with_sql("questions")}, {PLAN}
SELECT request_id, coalesce(wanted, false) AS wanted, CASE WHEN wanted THEN form END AS comparison_form, CASE WHEN wanted THEN CAST(cy AS VARCHAR) END AS comparison_year FROM plan
""",
    "comparison_context": f"""
{with_sql("questions", "filing_catalog")}, {PLAN}, {PICK_SQL}
SELECT request_id, length(c) AS chars, md5(c) AS context_md5 FROM (SELECT p.request_id, CASE WHEN p.wanted AND d.doc_id IS NOT NULL
  THEN concat('Additional SEC filing context (', p.form, ', filing_date calendar year ~', CAST(p.cy AS VARCHAR), '):', chr(10), substring({trim_sql("d.text")}, 1, {questions.COMPARISON_CHARS})) ELSE '' END AS c
FROM plan p
LEFT JOIN in_year a ON a.ticker = upper(p.ticker) AND a.form_type = upper(p.form) AND a.y = p.cy
LEFT JOIN newest n ON n.ticker = upper(p.ticker) AND n.form_type = upper(p.form) AND n.rn = 1
LEFT JOIN filing_catalog c ON c.accession = coalesce(a.accession, n.accession)
LEFT JOIN documents d ON d.doc_id = c.doc_id)
""",
    "context_caps": f"{with_sql('chat_requests')} SELECT request_id, CAST(current_cap AS BIGINT) AS current_cap, CAST(additional_cap AS BIGINT) AS additional_cap FROM (SELECT request_id, {CAPS} FROM chat_requests)",
    "smart_excerpt": f"SELECT doc_id, length(e) AS chars, md5(e) AS excerpt_md5 FROM (SELECT doc_id, {EXCERPT.format(t='text', n='6000')} AS e FROM documents)",
    "chat_prompts": f"""
{with_sql("chat_requests")}, capped AS (SELECT *, {CAPS}, nullif({trim_sql("coalesce(system_prompt, '')")}, '') AS own FROM chat_requests
), made AS (
  SELECT request_id, coalesce(nullif({trim_sql("llm_model")}, ''), '{prompts.DEFAULT_MODEL}') AS model, own IS NOT NULL AS refused,
    concat('Question:', chr(10), question, chr(10), chr(10), 'Selected text:', chr(10), coalesce(nullif(selected_text, ''), '(none)'), chr(10), chr(10),
      'Current filing context:', chr(10), {EXCERPT.format(t="coalesce(current_context, '')", n="current_cap")}, chr(10), chr(10),
      'Additional context:', chr(10), coalesce(nullif(substring(additional_context, 1, additional_cap), ''), '(none)'), chr(10), chr(10),
      'Output format:', chr(10), 'ANSWER: <answer>', chr(10), 'SOURCE_QUOTE: <quote or none>') AS user_prompt
  FROM capped)
SELECT request_id, model, CASE WHEN NOT refused THEN '{prompts.DEFAULT_SYSTEM_PROMPT.format(assistant=prompts.ASSISTANT).replace(chr(39), chr(39) * 2)}' END AS system_prompt,
       CASE WHEN refused THEN 'custom prompt not allowed' ELSE 'ok' END AS status,
       CASE WHEN NOT refused THEN length(user_prompt) END AS prompt_chars, CASE WHEN NOT refused THEN md5(user_prompt) END AS prompt_md5
FROM made
""",
    "parse_answer": f"""
{with_sql("llm_responses")}, p AS (
  SELECT *, contains(content, 'SOURCE_QUOTE:') AS quoted, {trim_sql("replace(split_part(content, 'SOURCE_QUOTE:', 1), 'ANSWER:', '')")} AS a, {trim_sql("split_part(content, 'SOURCE_QUOTE:', 2)")} AS q FROM llm_responses)
SELECT conv_id, turn, CASE WHEN quoted THEN a ELSE content END AS answer, CASE WHEN NOT quoted OR lower(q) = 'none' THEN '' ELSE q END AS source_quote FROM p
""",
    "quote_in_text": f"""
{with_sql("quotes")}
SELECT doc_id, CASE WHEN source_quote = '' THEN 0 ELSE CAST((length(text) - length(replace(text, source_quote, ''))) // length(source_quote) AS BIGINT) END AS quote_count,
       CASE WHEN source_quote = '' THEN 0 ELSE strpos(text, source_quote) END AS quote_start,
       md5(CASE WHEN source_quote = '' THEN text ELSE replace(text, source_quote, concat('<mark>', source_quote, '</mark>')) END) AS marked_md5
FROM quotes
""",
    "quote_offsets": f"""
{with_sql("asked_quotes")}, p AS (
  SELECT q.doc_id, q.k, q.source_quote, unnest(string_split(d.text, q.source_quote)) AS piece, generate_subscripts(string_split(d.text, q.source_quote), 1) AS i
  FROM asked_quotes q JOIN documents d ON d.doc_id = q.doc_id WHERE q.source_quote <> ''
), o AS (SELECT *, 1 + sum(length(piece)) OVER (PARTITION BY doc_id, k ORDER BY i) + (i - 1) * length(source_quote) AS quote_offset, max(i) OVER (PARTITION BY doc_id, k) AS n FROM p)
SELECT doc_id, k, CAST(quote_offset AS BIGINT) AS quote_offset FROM o WHERE i < n
""",
    "quote_in_html": f"""
{with_sql("quotes")}, m AS (
  SELECT doc_id, CASE WHEN source_quote <> '' AND strpos(html, source_quote) > 0 THEN concat(substr(html, 1, strpos(html, source_quote) - 1),
    '<mark id="source-quote-anchor" class="source-highlight source-quote-anchor">',
    replace(replace(replace(replace(source_quote, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '</mark>',
    substr(html, strpos(html, source_quote) + length(source_quote))) ELSE html END AS m FROM quotes)
SELECT doc_id, length(m) AS marked_chars, md5(m) AS marked_md5 FROM m
""",
    "latest_sessions": f"""
{with_sql("session_events")}, k AS (SELECT *, {SESSION_KEY} AS session_key FROM session_events)
SELECT user_id, session_key, seq, action, coalesce(payload, '') AS payload
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_key ORDER BY ts DESC, seq DESC) AS rn FROM k) WHERE rn = 1
""",
    "recent_filings": f"{with_sql('session_events')}, {LAST_USED.format(source='session_events')}, {RECENT} SELECT user_id, place, ticker, year, form_type FROM recent WHERE place <= 12",
    "restore_key": f"""
{with_sql("session_events", "active_keys", "known_users")}, {LAST_USED.format(source="session_events")}, {RECENT}
SELECT u.user_id, coalesce(a.ticker, r.ticker, '{sessions.DEFAULT_KEY[0]}') AS ticker, coalesce(a.year, r.year, '{sessions.DEFAULT_KEY[1]}') AS year,
       coalesce(a.form_type, r.form_type, '{sessions.DEFAULT_KEY[2]}') AS form_type,
       CASE WHEN a.user_id IS NOT NULL THEN 'active' WHEN r.user_id IS NOT NULL THEN 'recent' ELSE 'default' END AS origin
FROM known_users u LEFT JOIN active_keys a ON a.user_id = u.user_id AND a.year IS NOT NULL LEFT JOIN recent r ON r.user_id = u.user_id AND r.place = 1
""",
    "session_defaults": f"""
{with_sql("stored_sessions")}
SELECT user_id, seq, coalesce(document_html, '') AS document_html, coalesce(document_html_partial, false) AS document_html_partial, coalesce(len(document_anchors), 0) AS anchors FROM stored_sessions
""",
    "chat_settings": f"""
{with_sql("stored_settings")}, s AS (
  SELECT *, CAST(nullif(regexp_extract(trim(current_max), '^[+-]?[0-9]+'), '') AS DOUBLE) AS c, CAST(nullif(regexp_extract(trim(additional_max), '^[+-]?[0-9]+'), '') AS DOUBLE) AS a,
         nullif(trim(coalesce(prompt_draft, '')), '') AS draft FROM stored_settings
), t AS (SELECT *, CASE WHEN use_custom IN ('1', 'true') THEN true WHEN use_custom IN ('0', 'false') THEN false ELSE draft IS NOT NULL END AS used FROM s)
SELECT user_id, event_id, CAST(greatest(5000, least(120000, coalesce(c, 80000))) AS BIGINT) AS current_context_max_chars, CAST(greatest(0, least(80000, coalesce(a, 60000))) AS BIGINT) AS additional_context_max_chars,
       used AS use_custom_prompt, CASE WHEN used THEN draft END AS custom_prompt, md5(coalesce(prompt_draft, '{prompts.DEFAULT_SYSTEM_PROMPT.format(assistant=prompts.ASSISTANT).replace(chr(39), chr(39) * 2)}')) AS edit_md5 FROM t
""",
    "response_status": f"""
{with_sql("filing_requests", "filing_catalog", "chat_requests")}, {PICK_SQL}
SELECT r.request_id, CAST(CASE WHEN n.accession IS NULL THEN 500 ELSE 200 END AS BIGINT) AS filing_status,
       CASE WHEN c.request_id IS NOT NULL THEN CAST(CASE WHEN nullif({trim_sql("coalesce(c.system_prompt, '')")}, '') IS NOT NULL THEN 403 ELSE 200 END AS BIGINT) END AS chat_status
FROM filing_requests r LEFT JOIN newest n ON n.ticker = upper(r.ticker) AND n.form_type = upper(r.form_type) AND n.rn = 1 LEFT JOIN chat_requests c ON c.request_id = r.request_id
""",
    "session_threads": f"""
{with_sql("thread_events")}, e AS (
  SELECT *, {SESSION_KEY} AS session_key, coalesce(payload, '') AS p, contains(coalesce(payload, ''), 'SOURCE_QUOTE:') AS quoted FROM thread_events WHERE action IN ('click', 'view', 'purchase')
), m AS (
  SELECT *, CASE WHEN action = 'purchase' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN action = 'click' THEN 'selection' ELSE '-' END AS kind,
    CASE WHEN action = 'purchase' AND quoted THEN {trim_sql("replace(split_part(p, 'SOURCE_QUOTE:', 1), 'ANSWER:', '')")} ELSE p END AS content,
    CASE WHEN action = 'purchase' AND quoted AND lower({trim_sql("split_part(p, 'SOURCE_QUOTE:', 2)")}) <> 'none' THEN coalesce(nullif({trim_sql("split_part(p, 'SOURCE_QUOTE:', 2)")}, ''), '-') ELSE '-' END AS quote FROM e)
SELECT user_id, session_key, count(*) AS n_messages, md5(string_agg(concat(role, ':', kind, ':', content, ':', quote), '|' ORDER BY ts, seq)) AS thread_md5 FROM m GROUP BY ALL
""",
    "thread_pages": """
SELECT conv_id, CAST((n - 1) // 20 AS BIGINT) AS page, min(n) AS first, count(*) AS n_messages, md5(string_agg(concat_ws(':', turn, role, text), '|' ORDER BY n)) AS page_md5
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations) GROUP BY 1, 2
""",
    "chat_threads": """
SELECT conv_id, count(*) AS n_messages, md5(string_agg(concat(role, ':', text), '|' ORDER BY turn)) AS thread_md5 FROM conversations GROUP BY conv_id
""",
    "session_highlights": f"""
{with_sql("session_events")}
SELECT user_id, {SESSION_KEY} AS session_key, seq, effect, payload AS text, CASE WHEN effect = 'message' THEN 'selection' END AS kind
FROM session_events CROSS JOIN (VALUES ('highlight'), ('message'), ('selected_text')) AS e(effect) WHERE action = 'click'
""",
    "switch_merge": f"""
{with_sql("session_events")}, k AS (SELECT *, {SESSION_KEY} AS session_key FROM session_events),
stored AS (SELECT user_id, session_key, max(payload) AS document_text, count(*) AS n_messages FROM k WHERE action <> 'view' GROUP BY ALL),
switches AS (SELECT user_id, session_key, max(CASE WHEN seq % 2 = 0 THEN payload END) AS new_text FROM k WHERE action = 'view' GROUP BY ALL)
SELECT s.user_id, s.session_key, CASE WHEN coalesce(new_text, '') <> '' THEN new_text ELSE coalesce(document_text, '') END AS document_text,
       CASE WHEN coalesce(new_text, '') <> '' THEN '<p>' ELSE '' END AS document_html, '' AS selected_text, coalesce(n_messages, 0) AS n_messages
FROM switches s LEFT JOIN stored t ON t.user_id = s.user_id AND t.session_key = s.session_key
""",
}
ORACLE_SQL["session_store"] = ORACLE_SQL["latest_sessions"].replace(with_sql("session_events"), with_sql("chat_events")).replace("session_events", "chat_events")
