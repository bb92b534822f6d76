"""Finding many strings in one document: one automaton over all that is asked of it, and one scan.

What is asked of a document is gathered first, in lists of at most NEEDLES different strings, so that its texts meet each list in one row and are
read once for all strings in it: time is linear in the texts and in what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that one scan looks for; a document of which more are asked is scanned once for each so many.
NEEDLES = 10_000
_HITS = "array<struct<needle: string, at: int, starts: array<int>>>"


def needle_lists(wanted: DataFrame, id_col: str, needle_col: str, most: int = NEEDLES) -> DataFrame:
    """(id, needles) of wanted (id, needle): the different strings asked of each document, in lists; empty and null ones are not looked for."""
    asked = wanted.where(F.length(needle_col) > 0).select(id_col, F.col(needle_col).alias("needle")).distinct()
    lists = asked.groupBy(id_col).agg(F.ceil(F.count("*") / most).alias("_lists"))
    dealt = asked.join(lists, id_col).withColumn("_list", F.pmod(F.xxhash64("needle"), F.col("_lists")))
    return dealt.groupBy(id_col, "_list").agg(F.collect_list("needle").alias("needles")).drop("_list")


def scan(text: str, automaton) -> dict[str, list[int]]:
    """Where each string that occurs in a text begins, from 0; occurrences of one string do not overlap, the earlier one counts."""
    found: dict[str, list[int]] = {}
    for last, needle in automaton.iter(text):
        start, starts = last - len(needle) + 1, found.setdefault(needle, [])
        if not starts or start >= starts[-1] + len(needle):
            starts.append(start)
    return found


def with_hits(rows: DataFrame) -> DataFrame:
    """rows (..., texts, needles) with hits: for each string found in a text, the string, the text's place in texts (an array of structs with `text`), and all starts.

    Only texts and needles are read in Python; the other columns pass by. Null texts hold nothing.
    """
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(f"hits {_HITS}").fields])
    kind = pa.list_(pa.struct([("needle", pa.string()), ("at", pa.int32()), ("starts", pa.list_(pa.int32()))]))
    texts_at, needles_at = rows.columns.index("texts"), rows.columns.index("needles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            out = []
            for texts, needles in zip(batch.column(texts_at), batch.column(needles_at).to_pylist()):
                automaton = ahocorasick.Automaton()
                for needle in needles:
                    automaton.add_word(needle, needle)
                automaton.make_automaton()
                found = []
                for at, text in enumerate(texts.values.field("text") if texts.is_valid else ()):
                    if needles and text.is_valid:
                        found += [{"needle": needle, "at": at, "starts": starts} for needle, starts in scan(text.as_py(), automaton).items()]
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def quote_offsets(answers: DataFrame, texts: DataFrame, id_col: str = "doc_id", quote: str = "source_quote", text: str = "text") -> DataFrame:
    """answers (..., id, quote), one row for every occurrence of the quote in its document's text, with its offset (from 1).

    Answers without a quote, or whose quote does not occur, give no row. The marked text of an answer is not written: offsets say what to mark.
    """
    lists = needle_lists(answers, id_col, quote)
    read = texts.select(id_col, F.array(F.struct(F.col(text).alias("text"))).alias("texts")).join(lists, id_col)
    hit = with_hits(read).select(id_col, F.explode("hits").alias("h"))
    found = hit.select(id_col, F.col("h.needle").alias(quote), F.col("h.starts").alias("_starts"))
    return answers.join(found, [id_col, quote]).select(*answers.columns, F.explode(F.transform("_starts", lambda x: x + 1)).alias("quote_offset"))
