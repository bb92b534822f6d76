"""Quality classifier by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled web text are all that the risk sees. With class prior p, loss l and model
g, the unbiased risk is p E+[l(g, +1)] + E_u[l(g, -1)] - p E+[l(g, -1)]; its last two terms estimate a risk over negatives,
which cannot be below zero, so the non-negative form clips them there and steps back when they fall below. The model is
logistic over standardised measures of the text and their squares; the loss is logistic, so that the score estimates a
probability.

The prior, the share of positives among the unlabelled, is estimated from positives and unlabelled alone: a first model tells
the two apart on one half of the sample; on the other half, the share of the unlabelled that score above a bound is at least
the prior times the share of the positives that do, and the bound for which this says least, sampling error included, gives the
estimate (best bin estimation). Labels other than positive are used for nothing: such rows are neither positives nor unlabelled.

Measures are taken of whole texts on the executors. The fit is on a bounded sample, at most about `sample` positives and as many
unlabelled texts, chosen by a hash of the identifier (the bound is that parameter); identifiers are chosen first, on narrow rows, and
only the texts of the chosen ones are read for it. Only their measures reach the driver. Every text is scored.

Cases: a null or empty text has the measures of an empty text and a score like any other. Labels that are null count as no
label; of several labels of a document the largest counts. Documents without labels and labels without documents are no
error; without a single positive or unlabelled text, every score is 0.5. Of rows that share an identifier one is trained on. Null identifiers are
scored and never train; repeated rows are returned as they came; an empty table gives an empty result; other columns are
ignored, whatever their names. A very long text is measured whole, for which a worker needs about 50 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import common
from ledgerline.llm.common import id_crc32, staged, table

SAMPLE = 20_000
_STEPS, _RATE, _RIDGE = 400, 0.05, 1e-4
# Kinds of characters, as bits.
LETTER, CAPITAL, SMALL, DIGIT, SPACE, PUNCTUATION, SYMBOL = (1 << k for k in range(7))
_KINDS: list[np.ndarray] = []

MEASURES = (
    "log_chars", "log_words", "word_length", "word_length_deviation", "letters", "capitals", "digits", "punctuation", "symbols",
    "exclamations", "bars", "sentence_ends", "words_a_sentence", "different_words", "top_word", "top_pair", "repeats_in_a_row",
    "short_words", "capital_words", "odd_words", "log_lines", "different_lines", "words_a_line",
)


def _kind(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return LETTER | CAPITAL * c.isupper() | SMALL * c.islower()
    if c.isalnum() or c == "_":
        return DIGIT
    return PUNCTUATION | SYMBOL * (c not in ".,;:!?'\"()-")


def _kinds() -> np.ndarray:
    """The kind of each code point; made once a worker."""
    if not _KINDS:
        _KINDS.append(np.fromiter((_kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000))
    return _KINDS[0]


def measures(text: str | None) -> list[float]:
    """The numbers that quality is judged by, one for each of MEASURES."""
    text = text or ""
    n, lines = len(text), [x for x in text.split("\n") if x.strip()]
    if not lines:
        return [0.0] * len(MEASURES)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    filled = kind != SPACE
    edge = np.diff(np.concatenate(([False], filled, [False])).astype(np.int8))
    start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    w, solid = len(start), kind[filled]
    first = np.cumsum(size) - size
    holds = lambda bit: np.add.reduceat((solid & bit) > 0, first, dtype=np.int64)
    capitals, symbols = holds(CAPITAL), holds(SYMBOL)
    words = common.word_hashes(text.lower())
    _, count = np.unique(words, return_counts=True)
    _, pairs = np.unique(common.mix64(words[:-1] * np.uint64(3) + words[1:]), return_counts=True)
    closing = (code == 46) | (code == 33) | (code == 63)
    ends = int((closing & ~np.concatenate((filled[1:], [False]))).sum())
    letters, all_capitals = int((kind & LETTER > 0).sum()), int(capitals.sum())
    return [
        np.log1p(n),
        np.log1p(w),
        size.mean(),
        size.std(),
        letters / n,
        all_capitals / max(1, letters),
        int((kind == DIGIT).sum()) / n,
        int((kind & PUNCTUATION > 0).sum()) / w,
        int(symbols.sum()) / w,
        int((code == 33).sum()) / w,
        int((code == 124).sum()) / w,
        ends / w,
        np.log1p(w / max(1, ends)),
        len(count) / w,
        int(count.max(initial=0)) / w,
        int(pairs.max(initial=0)) / w,
        int((words[1:] == words[:-1]).sum()) / w,
        int((size <= 3).sum()) / w,
        int(((capitals > 0) & (holds(SMALL) == 0) & (size > 1)).sum()) / w,
        int((symbols > 0).sum()) / w,
        np.log1p(text.count("\n") + 1),
        len(set(lines)) / len(lines),
        np.log1p(w / len(lines)),
    ]


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of docs with an array of measures of the whole text."""
    read = docs.select(*keep, F.col(text_col).alias("text"))
    schema = T.StructType([*(read.schema[c] for c in keep), T.StructField("measures", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[float(x) for x in measures(t.as_py())] for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return read.mapInArrow(run, schema)


@dataclass
class Model:
    """A logistic model over standardised measures and their squares."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.column_stack((np.ones(len(z)), z, z * z / 4))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def slope(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float, non_negative: bool = True) -> np.ndarray:
    """The step's direction at weights w: the gradient of the unbiased risk, or where its part over negatives is below zero, that part's ascent.

    With non_negative=False, the gradient of the plain risk of telling positives (with weight prior) from unlabelled.
    """
    gp, gu = xp @ w, xu @ w
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    of_positives, of_unlabelled = prior * ((sp - 1) @ xp) / len(xp), su @ xu / len(xu)
    if not non_negative:
        return of_positives + (1 - prior) * of_unlabelled
    negatives = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    rise = of_unlabelled - prior * (sp @ xp) / len(xp)
    return of_positives + rise if negatives >= 0 else -rise


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, non_negative: bool = True) -> Model:
    """Minimises the non-negative unbiased risk by full-batch steps (Adam)."""
    if not len(positives) or not len(unlabelled):
        return Model(prior, np.empty(0), np.empty(0), np.empty(0))
    everything = np.vstack((positives, unlabelled))
    model = Model(prior, everything.mean(axis=0), everything.std(axis=0) + 1e-6, np.empty(0))
    xp, xu = model.inputs(positives), model.inputs(unlabelled)
    w, m, v = np.zeros(xp.shape[1]), np.zeros(xp.shape[1]), np.zeros(xp.shape[1])
    ridge = np.full(xp.shape[1], _RIDGE)
    ridge[0] = 0
    for step in range(1, _STEPS + 1):
        gradient = slope(w, xp, xu, prior, non_negative) + ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
        w = w - _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, *, chance: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled, by best bin estimation over scores of a model of the two kinds.

    With q(c) the share that scores at least c, the prior is at most q_unlabelled(c) / q_positive(c) for every c; the c that minimises
    the ratio with its sampling error (each share is off by at most its bound with probability 1 - chance) is taken.
    """
    halves = [(x[0::2], x[1::2]) for x in (positives, unlabelled)]
    if not all(len(part) for half in halves for part in half):
        return 0.5
    model = fit(halves[0][0], halves[1][0], 0.5, non_negative=False)
    p, u = (np.sort(model.scores(half[1])) for half in halves)
    bounds = np.unique(p)
    above_p = 1 - np.searchsorted(p, bounds) / len(p)
    above_u = 1 - np.searchsorted(u, bounds) / len(u)
    error = sum(np.sqrt(np.log(4 / chance) / (2 * len(x))) for x in (p, u))
    best = int(np.argmin((above_u + (1 + slack) * error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def in_training(id_col: str = "id") -> F.Column:
    """Rows whose labels may be learned: CRC-32 of the identifier modulo 3 is not 1."""
    return F.col(id_col).isNotNull() & (id_crc32(id_col) % F.lit(3) != F.lit(1))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model from the training rows of docs and labels."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(in_training())
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(in_training() & F.col("label").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    kind = F.when(F.col("label").isNull(), "unlabelled").when(F.col("label") == 1, "positive")
    named = rows.select("id").distinct().join(label, "id", "left").select("id", kind.alias("kind")).where("kind IS NOT NULL")
    spread = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000_000)) / F.lit(1_000_000_000.0)
    named = staged(named.withColumn("spread", spread))
    counts = {r["kind"]: r["count"] for r in named.groupBy("kind").count().collect()}
    if len(counts) < 2:
        return Model(0.5, np.empty(0), np.empty(0), np.empty(0))
    share = F.when(F.col("kind") == "positive", sample / counts["positive"]).otherwise(sample / counts["unlabelled"])
    chosen = F.broadcast(named.where(F.col("spread") < share).select("id", "kind"))  # about 2 * sample identifiers at any size
    found = measured(rows.join(chosen, "id"), ["id", "kind"]).groupBy("id", "kind").agg(F.min("measures").alias("measures"))
    found = found.toArrow().sort_by([("id", "ascending")])
    x = np.array(found.column("measures").to_pylist(), float).reshape(-1, len(MEASURES))
    positive = np.array(found.column("kind").to_pylist()) == "positive"
    return fit(x[positive], x[~positive], estimated_prior(x[positive], x[~positive]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, score) of every row; with carry, (row, score), where row holds all columns of docs."""
    head = F.struct(*docs.columns).alias("row") if carry else F.col(id_col).alias("id")
    read = docs.select(head, F.col(text_col).alias("text"))
    schema = T.StructType([read.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=schema.names)

    found = read.mapInArrow(run, schema)
    return found if carry else found.withColumnRenamed("id", id_col)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_crc32("doc_id") % F.lit(3) == F.lit(1), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
