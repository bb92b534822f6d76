"""From questions to the second filing that they call for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.questions import comparison_year, explicit_year, form_key, question_form, wants_comparison
from ledgerline.functions.text import first_chars
from ledgerline.operators.catalog import attach, in_folders, pick_filing, resolve_body
from ledgerline.sources.staging import staged

# Characters of a second filing's text, and the line above it.
COMPARISON_CHARS = 60_000
CONTEXT_LABEL = "Additional SEC filing context (%s, filing_date calendar year ~%s):\n"


def plan_comparison(questions: DataFrame) -> DataFrame:
    """questions with wanted, comparison_form and comparison_year (both null if no second filing is wanted).

    Without a year in the question, the same form means the year before the active one. The active filing itself, and
    years that are no numbers, are never planned.
    """
    question, active = F.col("question"), F.col("year").try_cast("int")
    form = F.coalesce(F.nullif(question_form(question), F.lit("")), F.col("form_type"))
    read = questions.withColumns({"_wants": wants_comparison(question), "_named": explicit_year(question), "_form": form, "_active": active})
    read = read.withColumn("_same", form_key(F.col("_form")) == form_key(F.col("form_type")))
    read = read.withColumn("_year", comparison_year(question, F.col("year"), F.col("_same")).try_cast("int"))
    # Without a named year, the active year or a later one is clamped to the year before for the same form.
    clamped = F.when(F.col("_same") & F.col("_named").isNull() & (F.col("_year") >= F.col("_active")), F.col("_active") - 1).otherwise(F.col("_year"))
    read = read.withColumn("_year", F.when(F.col("_active").isNotNull(), clamped))
    itself = F.col("_same") & (F.col("_year") == F.col("_active"))
    read = read.withColumn("wanted", F.coalesce(F.col("_wants") & F.col("_year").isNotNull() & ~itself, F.lit(False)))
    return read.select(*questions.columns, "wanted", F.when(F.col("wanted"), F.col("_form")).alias("comparison_form"), F.when(F.col("wanted"), F.col("_year").cast("string")).alias("comparison_year"))


def comparison_context(questions: DataFrame, catalog: DataFrame, bodies: DataFrame, chars: int = COMPARISON_CHARS, *, body_key: str = "accession", folders: tuple[str, ...] = ()) -> DataFrame:
    """questions with additional_context: label and text of the second filing, or empty.

    The plan is worked out once and staged, so that its patterns are in one small projection. Each different (ticker, form, year) is
    picked once, and each picked body is read and cut once, before the texts meet the questions. Questions that want nothing, or find nothing, pass
    that join by. body_key and folders are as in filing_pack().
    """
    columns = [*questions.columns, "wanted", "comparison_form", "comparison_year"]
    plan = staged(plan_comparison(questions).withColumns({"_ticker": F.upper("ticker"), "_form": F.upper("comparison_form")}))
    keys = plan.where("wanted").select(F.col("_ticker").alias("ticker"), F.col("_form").alias("form_type"), F.col("comparison_year").alias("year")).distinct()
    shared = () if body_key == "accession" else (body_key,)
    picked = pick_filing(keys, catalog, (*shared, *folders)).where("match_kind <> 'none'").withColumnRenamed(f"filed_{body_key}", body_key)
    filed = {f"filed_{c}": c for c in folders}
    picked = staged(picked.select(F.col("ticker").alias("_ticker"), F.col("form_type").alias("_form"), F.col("year").alias("comparison_year"), body_key, "match_kind", *filed))
    near = in_folders(bodies, picked, filed) if folders else bodies
    picked = picked.drop("match_kind", *filed)
    wanted = near.select(body_key, "html", "text", "markdown").join(picked.select(body_key).distinct(), body_key, "left_semi")
    texts = resolve_body(wanted).select(body_key, first_chars(F.col("text"), chars).alias("_text"))
    label = F.format_string(CONTEXT_LABEL, "comparison_form", "comparison_year")
    met = attach(plan.where("wanted").join(picked, ["_ticker", "_form", "comparison_year"], "left"), texts, body_key)
    context = F.when(F.col("_text").isNotNull(), F.concat(label, F.col("_text"))).otherwise("")
    return met.select(*columns, context.alias("additional_context")).unionByName(plan.where("NOT wanted").select(*columns, F.lit("").alias("additional_context")))
