"""Line dedup by rolling windows of lines.

A window rolls over each text's lines that are not blank: a line, the next one, and the blank lines between them. Where it
stands depends on its own lines alone, so every passage of two lines or more is seen line by line, wherever it begins and
whatever surrounds it: windows are content-defined chunks with a boundary after every line. Boundaries further apart, chosen by a
rolling hash, cannot give right results on these texts: most repeated passages are shorter than two chunks (README has
figures). A window that was seen before, anywhere in the corpus, is removed; neighbouring ones merge, so a
repeated passage goes as a whole. So does a single line of more than LONG_WORDS words. The first occurrence stays: the one in the
document with the smallest identifier, and there the first. No line is lost altogether, since whatever holds the very
first copy of a line occurs there for the first time.

Repeats are found by grouping on a window's key: the digests of its two lines and the bytes between them. Bytes are compared
line by line, by grouping on digest and line together; should different lines share a digest anywhere, all lines are digested anew
under another key, until none do. So each line is shuffled once for the comparison, and copies of it collapse before; windows are
narrow rows. Each text is then shuffled once, to meet the list of what it has to lose; that list grows with the corpus and is
never broadcast.

Cases: a null text counts as empty and is returned as empty. Rows with a null identifier keep all their lines and
count for nothing. Rows that share an identifier are treated as one document: they lose the same windows. A short line
is removed only with a neighbour; blank lines are removed only between two lines of a window. Very long texts are read whole.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged, table

#: A line of more words is a passage by itself.
LONG_WORDS = 50


def digest_of(line: str, key: int) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16, key=key.to_bytes(4, "little")).digest()


def windows(lines: list[str]) -> Iterator[tuple[int, int]]:
    """(first line, line after the last) of each window and each long line."""
    before = None
    for k, line in enumerate(lines):
        words = len(line.split(None, LONG_WORDS))
        if not words:
            continue
        if words > LONG_WORDS:
            yield k, k + 1
        if before is not None:
            yield before, k + 1
        before = k


def keyed(lines: list[str], digest: Callable[[str], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Windows with their keys; the key of a long line is its digest."""
    digests = [digest(line) for line in lines]
    for first, after in windows(lines):
        between = "\n".join(["", *lines[first + 1 : after - 1], ""]).encode()
        yield first, after, digests[first] if after - first == 1 else digests[first] + between + digests[after - 1]


def window_rows(docs: DataFrame, digest: Callable[[str], bytes]) -> DataFrame:
    """(doc_id, key): the different windows of every document (id, text)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["id"].dataType), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, keys = [], []
            for k, text in enumerate(batch.column(1)):
                own = {key for _, _, key in keyed(text.as_py().split("\n"), digest)}
                row.extend([k] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(keys, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def ambiguous(docs: DataFrame, digest: Callable[[str], bytes]) -> bool:
    """Whether different lines of documents (id, text) share a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list({line for text in batch.column(1) for line in text.as_py().split("\n")})
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in lines], pa.binary()), pa.array(lines, pa.string())], names=["digest", "line"])

    return not docs.mapInArrow(run, "digest binary, line string").distinct().groupBy("digest").count().where("count > 1").isEmpty()


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[str, int], bytes] = digest_of) -> DataFrame:
    """(id, text, n_lines, n_removed) of every row; text is what remains."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = read.where("id IS NOT NULL")
    key = 1
    while ambiguous(known, named := partial(digest, key=key)):
        key += 1
    repeated = window_rows(known, named).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1")
    repeated = staged(repeated.select("key", "keeper"))  # read back, both sides of the join are plain shuffles, of which Spark can split a hot key's rows
    lost = window_rows(known, named).join(repeated, "key").where("doc_id > keeper").groupBy("doc_id").agg(F.collect_set("key").alias("lost"))
    met = known.join(lost.withColumnRenamed("doc_id", "id").hint("merge"), "id", "left").select("id", "text", "lost")
    met = met.unionByName(read.where("id IS NULL").withColumn("lost", F.lit(None).cast("array<binary>")))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, totals, removed = [], [], []
            for key, text, lost in zip(*(c.to_pylist() for c in batch.columns)):
                lines, gone, seen, lost = text.split("\n"), set(), set(), set(lost or ())
                for first, after, own in keyed(lines, named) if key is not None else ():
                    window = tuple(lines[first:after])
                    if window in seen or own in lost:
                        gone.update(range(first, after))
                    seen.add(window)
                kept.append("\n".join(line for k, line in enumerate(lines) if k not in gone))
                totals.append(len(lines))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return met.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = drop_repeated_chunks(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))
