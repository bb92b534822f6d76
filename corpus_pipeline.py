"""The corpus pipeline: five stages, each working on all that the stage before kept.

The first four filter and return the columns of documents; the last one packs what is left. The classifiers carry the whole
row past their decision. The dedup stages decide on rows, not on identifiers, so that texts which share an identifier, and rows without one, are
told apart: exact dedup by identifier and text, near dedup by a key that each row gets in a table written once.

Cases, for every stage: an empty table gives an empty one. Other columns of docs are carried along whatever their names.

- quality classifier: null and empty texts are scored like any other; repeated rows share one fate; rows with a null identifier never train.
- language id: null texts and texts without a letter are `und` and go; repeated rows stay or go together.
- exact dedup: of equal texts (null counts as empty) one row stays, the one with the largest identifier, a null one only if no row has
  one; of rows that repeat identifier and text, one stays.
- near dedup: of each group of linked texts the row with the smallest identifier stays, a null one only if no row has one. Texts without
  words are linked with nothing and stay.
- packing: every row is packed; null and empty texts are the end id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import op3_packing, op4_near_dedup, op7_exact_dedup, op9_language_id, op10_quality
from ledgerline.llm.common import staged, stages, table

#: Below this likeness to every profile, a text is taken for none of the languages.
LEAST_LIKENESS = 0.05


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = op10_quality.learn(docs, table(spark, sf_dir, "labels"))
    return op10_quality.score(docs, model, carry=True).where("score >= 0.5").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language."""
    profiles = op9_language_id.learn_profiles(op9_language_id.training_rows(docs))
    found = op9_language_id.identify(docs, profiles, carry=True)
    known = (F.col("lang_pred") != op9_language_id.UNDETERMINED) & (F.col("score") >= LEAST_LIKENESS)
    return found.where(known).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return op7_exact_dedup.one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    keyed = staged(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*docs.columns).alias("doc")))
    found = op4_near_dedup.near_duplicates(keyed.select("row_key", "doc.text"), id_col="row_key").select("row_key", "component_id")
    ids = keyed.select("row_key", "doc.doc_id").join(found, "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first")
    kept = staged(ids.groupBy("component_id").agg(first).select("first.row_key"))
    return keyed.join(kept.hint("merge"), "row_key", "left_semi").select("doc.*")  # kept grows with the corpus and is never broadcast


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return op3_packing.pack_documents(docs, op3_packing.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("language id", language),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("packing", packing),
]

#: SQL can express neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and what it was made from is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with stages(spark) as own:
            docs = staged(stage(spark, docs, sf_dir))
            result = own.pop()
            own.extend(before)
        before = [result]
    return docs
