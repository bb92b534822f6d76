"""Column functions that read a user's question: does it want a second filing, which form, which year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that ask for another filing.
PHRASES = (
    "compare",
    "comparison",
    "versus",
    " vs ",
    " vs. ",
    "relative to",
    "prior year",
    "last year",
    "year-ago",
    "year ago",
    "earlier filing",
    "historical filing",
    "past filing",
    "past 10",
    "earlier 10",
    "previous 10",
    "previous filing",
    "last 10",
    "year over year",
    "yoy",
    "another year",
    "another filing",
    "different year",
    "different filing",
    "other year",
    "other filing",
    "second filing",
    "cross-year",
    "cross year",
)
# Form labels by priority, words that mean the year before, and words that do so for the same form.
FORMS = (("10", "k", "10-K"), ("10", "q", "10-Q"), ("8", "k", "8-K"), ("20", "f", "20-F"))
YEAR_BEFORE = ("previous year", "prior year", "last year")
EARLIER = ("previous", "prior", "earlier", "historical", "past", "older")
COMPARING = r"\b(compare|comparison|versus|yoy|year over year)\b|\bvs\b"

YEAR = r"\b(?:19|20)\d{2}\b"


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text contains one of some plain phrases: one pattern, since a long chain of conditions is a lot of code."""
    return text.rlike("|".join(p.replace(".", r"\.") for p in parts))


def explicit_year(question: Column) -> Column:
    """The first year from 1900 to 2099 that a question names, or null."""
    found = F.regexp_extract(question, YEAR, 0)
    return F.when(found != "", found)


def wants_comparison(question: Column) -> Column:
    return question.rlike(YEAR) | _any_of(F.lower(question), PHRASES)


def question_form(question: Column) -> Column:
    """The form a question names, by priority and not by place; empty if none."""
    low = F.lower(question)
    chosen = F.lit("")
    for number, letter, label in reversed(FORMS):
        chosen = F.when(low.rlike(rf"\b{number}[\s-]?{letter}\b"), label).otherwise(chosen)
    return chosen


def form_key(form: Column) -> Column:
    """A form label for comparison: upper case, without spaces and hyphens."""
    return F.translate(F.upper(form), " -", "")


def names_year_before(question: Column) -> Column:
    """Whether a question asks for the year before, whatever the form."""
    return _any_of(F.lower(question), YEAR_BEFORE)


def comparison_year(question: Column, year: Column, same_form: Column) -> Column:
    """The year that a question asks for as text; a year that is no number stays as it is."""
    low = F.lower(question)
    before = F.coalesce((year.try_cast("int") - 1).cast("string"), year)
    earlier = same_form & (_any_of(low, EARLIER) | low.rlike(COMPARING))
    return F.coalesce(explicit_year(question), F.when(names_year_before(question) | earlier, before), year)
