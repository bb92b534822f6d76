"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams of one to three characters; a text is compared with it by
the out-of-place distance: the sum, over the text's own most frequent n-grams, of how far each one's rank is from its rank
in the profile, where an n-gram that the profile lacks counts as `profile_size` places. The least distance wins.

Profiles are learned from about `sample` labelled training texts a language, chosen by a hash of the identifier; this
is the bound of the fit; every language that occurs is learned, and n-grams are counted over the whole of the chosen texts. The
profiles are the model, `profile_size` rows a language. Every text is judged whole; its n-grams are counted in pieces of PIECE
characters, so that a very long one needs no more memory than its counts.

Cases: a text that is null or has no letter is `und` with score 0. Ties go to the first language by name. The score is one minus
the least distance over its largest possible value. Training rows need a text with letters and a lang that is not null;
without any, every text is `und`. Null identifiers are held in (never held out), never train, and are judged; repeated
rows are returned as they came; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import id_crc32, staged, table

#: N-grams in a profile, and training texts a language.
PROFILE_SIZE, SAMPLE = 400, 3000
#: Characters of a text that are worked on at a time, and languages whose shares are sent to every executor rather than joined.
PIECE, FEW_LANGUAGES = 1 << 20, 10_000
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter; made once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str, before: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in a piece of a lower-cased text, one to three characters packed into an integer each.

    Everything between letters is one space, as are both ends of the whole text. before has up to two characters that precede the
    piece (a space at the start of the text); the characters to hand on to the next piece come second.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters()[code], code, 32).astype(np.int64)
    code = np.concatenate((before, code, [32] if last else np.empty(0, np.int64)))
    keep = np.concatenate((np.full(len(before), True), (code[len(before) :] != 32) | (code[len(before) - 1 : -1] != 32)))
    code, old = code[keep], len(before)
    new = code[old:]
    two = code[old - 1 :]
    three = code[max(0, old - 2) :]
    return np.concatenate((new[new != 32], two[:-1] << 21 | two[1:], three[:-2] << 42 | three[1:-1] << 21 | three[2:])), code[-2:]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, sorted, and how often each occurs; none if it has no letter."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    low = (text or "").lower()
    held, before = none, np.array([32], np.int64)
    for at in range(0, len(low), PIECE):
        grams, before = ngrams(low[at : at + PIECE], before, at + PIECE >= len(low))
        values, counts = np.unique(grams, return_counts=True)
        held = merged([held, (values, counts)]) if at else (values, counts)
    return held if len(held[0]) and held[0][-1] > 1 << 21 else none  # a text without letters has no n-gram, not even of spaces


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several texts or pieces as one."""
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, place, np.concatenate([c for _, c in parts]))
    return values, total


def ranked(text: str | None, n: int) -> np.ndarray:
    """The n most frequent n-grams of a text, most frequent first, ties by their number."""
    values, counts = counted(text)
    return values[np.argsort(-counts, kind="stable")[:n]]


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the identifier as text leaves that remainder."""
    return F.coalesce(id_crc32(id_col) % F.lit(parts) == F.lit(part), F.lit(False))


def learn_profiles(training: DataFrame, *, profile_size: int = PROFILE_SIZE, sample: int = SAMPLE) -> dict[str, list[int]]:
    """{language: its n-grams by rank} from rows (id, text, lang). At most profile_size rows a language reach the driver."""
    labelled = training.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    sizes = staged(labelled.groupBy("lang").count().select("lang", (F.lit(float(sample)) / F.col("count")).alias("share")))
    if sizes.count() <= FEW_LANGUAGES:
        sizes = F.broadcast(sizes)
    spread = F.pmod(F.xxhash64("id", F.lit("profile")), F.lit(1_000_000_000)) / F.lit(1_000_000_000.0)
    chosen = labelled.withColumn("spread", spread).join(sizes, "lang").where("spread < share")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = found.setdefault(lang, [])
                own.append(counted(text.as_py()))
                if len(own) == 256:
                    own[:] = [merged(own)]
            for lang, parts in found.items():
                values, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=schema.names)

    totals = chosen.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = totals.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= profile_size).select("lang", "rank", "gram").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """Profiles as one table of ranks, and the comparison of a text with all of them at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.languages, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.grams), len(profiles)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.rank[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.size)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        places = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None]))
        distance = places.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (self.size * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE_SIZE, carry: bool = False) -> DataFrame:
    """(id, lang_pred, score) of every row; with carry, (row, lang_pred, score), where row holds all columns of docs."""
    head = F.struct(*docs.columns).alias("row") if carry else F.col(id_col).alias("id")
    read = docs.select(head, F.col(text_col).alias("text"))
    schema = T.StructType([read.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Profiles(*shared.value).judge
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=schema.names)

    found = read.mapInArrow(run, schema)
    return found if carry else found.withColumnRenamed("id", id_col)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, text, lang) of the rows that may be learned from: CRC-32 of the identifier modulo 4 is not 2."""
    return docs.where(~held_out(id_col, 4, 2)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_profiles(training_rows(docs)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
