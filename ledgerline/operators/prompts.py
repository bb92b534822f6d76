"""Assembling bounded prompts, parsing answers, finding quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.prompts import (
    ADDITIONAL,
    ADDITIONAL_CHARS,
    CURRENT,
    CURRENT_CHARS,
    NONE,
    OUTPUT_FORMAT,
    QUESTION,
    SELECTED,
    answer_of,
    context_cap,
    mark_all,
    mark_first,
    occurrences,
    quote_of,
    size_setting,
    smart_excerpt,
)
from ledgerline.functions.text import trimmed

DEFAULT_MODEL = "default"
# Fixed value: the default system prompt; the assistant's name is a parameter.
DEFAULT_SYSTEM_PROMPT = (
    "You are {assistant}. Answer using only the excerpts below. "
    "When 'Additional context' contains another SEC filing or year, use it for comparisons or questions about that period. "
    "If an answer appears in 'Current filing context', state it and quote it; do not claim numbers are absent when they appear there. "
    "If you cannot find a figure in the excerpts (including after truncation), say it is not in the provided excerpt—not that the filing has no such data. "
    "Return one short verbatim source quote from the current filing when possible."
)
ASSISTANT = "a filing research assistant"
# Fixed values: (least, default, most) of the context sizes that a user can set.
CURRENT_SETTING, ADDITIONAL_SETTING = (5_000, 80_000, 120_000), (0, 60_000, 80_000)


# The status codes of responses.
DONE, REFUSED, NOT_FOUND, FAILED = 200, 403, 404, 500


def chat_settings(stored: DataFrame, assistant: str = ASSISTANT) -> DataFrame:
    """stored with a request's effective settings: current_context_max_chars, additional_context_max_chars, use_custom_prompt, custom_prompt.

    Reads the stored texts current_max, additional_max, use_custom and prompt_draft, null where nothing was stored. A size is the number
    that its text begins with, else the default, within its limits. A custom prompt is used if the switch says so (`1` or `true`; `0` or
    `false` means no), or, where the switch says neither, if a draft that is not blank is stored; it is the draft, or null if that is blank. What an
    editor shows, prompt_to_edit, is the draft as it was stored, blank or not, and the default prompt where none was.
    """
    draft = F.nullif(trimmed(F.coalesce("prompt_draft", F.lit(""))), F.lit(""))
    use = F.when(F.col("use_custom").isin("1", "true"), True).when(F.col("use_custom").isin("0", "false"), False).otherwise(draft.isNotNull())
    sizes = {"current_context_max_chars": size_setting(F.col("current_max"), CURRENT_SETTING), "additional_context_max_chars": size_setting(F.col("additional_max"), ADDITIONAL_SETTING)}
    shown = F.coalesce("prompt_draft", F.lit(DEFAULT_SYSTEM_PROMPT.format(assistant=assistant)))
    return stored.withColumns({**sizes, "use_custom_prompt": use, "custom_prompt": F.when(use, draft), "prompt_to_edit": shown})


def context_caps(questions: DataFrame) -> DataFrame:
    """questions with current_cap and additional_cap; 0 counts as asked for, null as not."""
    return questions.withColumns({"current_cap": context_cap(F.col("current_context_max_chars"), CURRENT_CHARS), "additional_cap": context_cap(F.col("additional_context_max_chars"), ADDITIONAL_CHARS)})


def assemble_prompts(questions: DataFrame, *, allow_custom: bool = False, system_prompt: str | None = None, default_model: str = DEFAULT_MODEL, assistant: str = ASSISTANT) -> DataFrame:
    """questions with model, system_prompt, user_prompt and status (`ok`, or `custom prompt not allowed` in place of an error).

    Reads question, selected_text, current_context, additional_context, llm_model, system_prompt and the two asked
    context sizes. The prompts are long rows: write them out, don't shuffle them.
    """
    capped = context_caps(questions)
    model = F.coalesce(F.nullif(trimmed(F.col("llm_model")), F.lit("")), F.lit(default_model))
    own = F.nullif(trimmed(F.coalesce("system_prompt", F.lit(""))), F.lit(""))
    refused = own.isNotNull() & F.lit(not allow_custom)
    fallback = (system_prompt or "").strip() or DEFAULT_SYSTEM_PROMPT.format(assistant=assistant)
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(NONE))
    user = F.concat(
        F.lit(QUESTION), F.col("question"),
        F.lit("\n\n" + SELECTED), shown(F.col("selected_text")),
        F.lit("\n\n" + CURRENT), smart_excerpt(F.coalesce("current_context", F.lit("")), F.col("current_cap")),
        F.lit("\n\n" + ADDITIONAL), shown(F.substring("additional_context", F.lit(1), F.col("additional_cap"))),
        F.lit("\n\n" + OUTPUT_FORMAT),
    )
    return capped.select(
        *(c for c in questions.columns if c not in ("system_prompt", "current_context", "additional_context")),
        model.alias("model"),
        F.when(refused, F.lit(None)).otherwise(F.coalesce(own, F.lit(fallback))).alias("system_prompt"),
        F.when(refused, F.lit(None)).otherwise(user).alias("user_prompt"),
        F.when(refused, "custom prompt not allowed").otherwise("ok").alias("status"),
    )


def with_status(rows: DataFrame, *, filing: str | None = None, html: str | None = None, fragment: str | None = None, prompt: str | None = None) -> DataFrame:
    """rows with status_code, by the columns that are named: of several faults, the first of these counts.

    A filing that was not found (match kind `none`) has failed; a fragment that is null or empty, or whose filing has no html, is not found; a
    prompt whose status is not `ok` is refused. What has no fault is done.
    """
    code = F.lit(DONE)
    if prompt:
        code = F.when(F.col(prompt) != "ok", REFUSED).otherwise(code)
    for c in (fragment, html):
        if c:
            code = F.when(F.coalesce(F.col(c), F.lit("")) == "", NOT_FOUND).otherwise(code)
    if filing:
        code = F.when(F.col(filing) == "none", FAILED).otherwise(code)
    return rows.withColumn("status_code", code)


def parse_answers(responses: DataFrame, content: str = "content") -> DataFrame:
    """responses with answer and source_quote."""
    return responses.withColumns({"answer": answer_of(F.col(content)), "source_quote": quote_of(F.col(content))})


def locate_quotes(answers: DataFrame, text: str = "text", quote: str = "source_quote") -> DataFrame:
    """answers with quote_count, quote_start (from 1, 0 if absent) and marked_text, in which every occurrence is marked."""
    t, q = F.col(text), F.col(quote)
    start = F.when(F.length(q) > 0, F.call_function("instr", t, q)).otherwise(0)
    return answers.withColumns({"quote_count": occurrences(t, q), "quote_start": start, "marked_text": mark_all(t, q)})


def mark_quotes_in_html(answers: DataFrame, html: str = "html", quote: str = "source_quote") -> DataFrame:
    """answers with marked_html, in which the first occurrence of the quote is marked."""
    return answers.withColumn("marked_html", mark_first(F.col(html), F.col(quote)))
