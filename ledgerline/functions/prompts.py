"""Column functions for prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import ltrimmed, trimmed

# Limits of the contexts, and the texts of the prompt.
CURRENT_CHARS = (2_000, 80_000, 120_000)
ADDITIONAL_CHARS = (0, 60_000, 80_000)
OMITTED = "\n\n[... middle of filing omitted for length ...]\n\n"
QUESTION, SELECTED, CURRENT, ADDITIONAL = "Question:\n", "Selected text:\n", "Current filing context:\n", "Additional context:\n"
OUTPUT_FORMAT = "Output format:\nANSWER: <answer>\nSOURCE_QUOTE: <quote or none>"
NONE = "(none)"
QUOTE_LABEL, ANSWER_LABEL = "SOURCE_QUOTE:", "ANSWER:"

MARK = "<mark>", "</mark>"
ANCHOR_MARK = '<mark id="source-quote-anchor" class="source-highlight source-quote-anchor">', "</mark>"


def context_cap(asked: Column, limits: tuple[int, int, int]) -> Column:
    """What is asked for, or the default if that is null, within (least, default, most)."""
    least, default, most = limits
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(asked, F.lit(default)))).cast("int")


def size_setting(stored: Column, limits: tuple[int, int, int]) -> Column:
    """The whole number that a stored text begins with, white space before it aside; the default if there is none; within (least, most)."""
    least, default, most = limits
    number = F.regexp_extract(ltrimmed(stored), r"^[+-]?\d+", 0).try_cast("double")
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(number, F.lit(default)))).cast("int")


def smart_excerpt(text: Column, n: Column) -> Column:
    """At most n characters: head and tail around a marker if the tail has 2,000 characters or more, else the head alone."""
    head = F.floor(n * 62 / 100).cast("int")
    tail = n - head - 120
    both = F.concat(F.substring(text, F.lit(1), head), F.lit(OMITTED), F.right(text, tail))
    return F.when(F.length(text) <= n, text).when(tail < 2000, F.substring(text, F.lit(1), n)).otherwise(both)


def answer_of(content: Column) -> Column:
    before = F.split_part(content, F.lit(QUOTE_LABEL), F.lit(1))
    return F.when(content.contains(QUOTE_LABEL), trimmed(F.replace(before, F.lit(ANSWER_LABEL), F.lit("")))).otherwise(content)


def quote_of(content: Column) -> Column:
    """What stands between the first quote label and the second; `none` in any case means no quote."""
    quote = trimmed(F.split_part(content, F.lit(QUOTE_LABEL), F.lit(2)))
    return F.when(~content.contains(QUOTE_LABEL) | (F.lower(quote) == "none"), "").otherwise(quote)


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote occurs in a text, without overlaps; 0 for an empty quote."""
    gone = F.length(text) - F.length(F.replace(text, quote, F.lit("")))
    return F.when(F.length(quote) > 0, (gone / F.length(quote)).cast("int")).otherwise(0)


def mark_all(text: Column, quote: Column) -> Column:
    """Every occurrence of a quote marked; the quote is taken literally."""
    return F.when(F.length(quote) > 0, F.replace(text, quote, F.concat(F.lit(MARK[0]), quote, F.lit(MARK[1])))).otherwise(text)


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def mark_first(html: Column, quote: Column) -> Column:
    """The first occurrence of a quote replaced by its escaped text in a mark; the quote is taken literally."""
    at = F.call_function("instr", html, quote)
    marked = F.concat(F.lit(ANCHOR_MARK[0]), escaped(quote), F.lit(ANCHOR_MARK[1]))
    before, after = F.substring(html, F.lit(1), at - 1), F.substring(html, at + F.length(quote), F.length(html))
    return F.when((F.length(quote) > 0) & (at > 0), F.concat(before, marked, after)).otherwise(html)
