"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition is a leaf run: its entries (digests, size, the identifier kept so far, number of copies), sorted by
digest. In a round, each run meets its partner of the next level (runs 2k and 2k + 1 become run k): the two are dealt by
digest over the receivers of the merged run, and each receiver sorts what it gets from all pieces of both runs into one and
merges it, so that one entry a digest is left, with the largest identifier and the summed count. There are about log2 of
the runs rounds. No receiver ever holds a whole run, and copies within a run collapse before they are sent, so a digest that
a third of all rows share sends one entry a run and round, whatever its number of copies.

Everything is built-in DataFrame functions. An entry keeps (identifier, leaf run) as one value; Spark merges such values in
sorted order (SortAggregate over a Sort of the exchanged pieces), in memory that does not grow with the run.

Two texts are equal when SHA-256, a second 64-bit digest and the byte length of their normalised forms all agree; all
three are part of the merge key at every level, so an entry is only ever merged with one that is verified against it.

Cases: a null text counts as empty, so null and empty texts are one group. Rows with a null identifier belong to
their group and count in its size; the group keeps a non-null identifier if it has any, else keep_id is null and those
rows are kept. Rows that repeat an identifier and text count each in group_size and are all marked alike. An empty
table gives an empty result. Other columns of the input are ignored, whatever their names. Identifiers may be of any type
that Spark orders, structs included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import staged, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["digest", "digest2", "n_bytes"]


def normalised(text: Column) -> Column:
    """The form in which texts are compared: A-Z lower-cased, nothing else changed, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def digests(norm: Column) -> dict[str, Column]:
    """What a normalised text is known by: the columns of KEY."""
    return {"digest": F.unhex(F.sha2(norm, 256)), "digest2": F.xxhash64(norm), "n_bytes": F.octet_length(norm)}


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: identifier, digests of the normalised text, and the run (input partition) it is in."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    return norm.select("id", *(c.alias(n) for n, c in digests(F.col("norm")).items()), F.spark_partition_id().alias("run"))


def leaf_entries(runs: DataFrame) -> DataFrame:
    """Rows of digest_runs as entries (run, *KEY, kept, group_size); kept is (id, leaf run), of which the largest stays."""
    return runs.select("run", *KEY, F.struct("id", F.col("run").alias("leaf")).alias("kept"), F.lit(1).cast("long").alias("group_size"))


def merge_round(entries: DataFrame, fan_in: int = 2) -> DataFrame:
    """One round: runs 0..fan_in-1 merge into run 0, the next fan_in into run 1, and so on."""
    met = entries.withColumn("run", F.expr(f"run div {fan_in}").cast("int"))
    return met.groupBy("run", *KEY).agg(F.max("kept").alias("kept"), F.sum("group_size").alias("group_size"))


def merge_tree(entries: DataFrame, n_runs: int, fan_in: int = 2) -> DataFrame:
    """The root run: one entry a distinct text."""
    left = max(1, n_runs)
    while True:
        entries = merge_round(entries, fan_in)
        left = -(-left // fan_in)
        if left <= 1:
            return entries


def root_run(runs: DataFrame, fan_in: int = 2) -> DataFrame:
    """(*KEY, keep_id, group_size): the root run over staged digest runs.

    Staged as well, so that a join with it has a plain shuffle on both sides, of which Spark can split the rows of a hot digest.
    """
    n_runs = (runs.agg(F.max("run").alias("last")).first()["last"] or 0) + 1
    return staged(merge_tree(leaf_entries(runs), n_runs, fan_in).select(*KEY, F.col("kept.id").alias("keep_id"), "group_size"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one of each group of equal texts: a row with the largest identifier, null only if all are.

    Rows that repeat identifier and text collapse on the map side; the texts are shuffled once.
    """
    root = root_run(staged(digest_runs(docs, id_col, text_col)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).alias("id")).alias("own"), normalised(F.col(text_col)).alias("norm"))
    single = rows.select("row", "own", *(c.alias(n) for n, c in digests(F.col("norm")).items())).dropDuplicates(["own", *KEY])
    wanted = root.select(F.struct(F.col("keep_id").alias("id")).alias("own"), *KEY)
    return single.join(wanted.hint("merge"), ["own", *KEY], "left_semi").select("row.*")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row; of equal texts the largest identifier is kept."""
    runs = staged(digest_runs(docs, id_col, text_col))
    root = root_run(runs, fan_in)
    joined = runs.drop("run").join(root, KEY)
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.expr("id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, g.text_sha256
FROM d JOIN g ON d.t = g.t
"""
