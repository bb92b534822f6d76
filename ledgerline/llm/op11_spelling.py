"""Spelling variant grouping by dense prefix-suffix tiling.

The words of a corpus are counted, and words that differ by exactly one inserted, deleted or replaced code point are near. Near
words are found in tiles: two blocks of words become padded code-point matrices, one aligned to the left and one to the right;
the common prefix and the common suffix of every pair of rows come from comparing them, and a pair is near if the two lengths reach the longer
word's length minus one.

Which blocks meet: a pair's shorter word has l code points, its longer one l or l + 1. One edit leaves the first l // 2 code points of both alike, or
else the last l - l // 2. So the words of l and l + 1 code points are dealt into groups by a hash of that prefix, and once more
by a hash of that suffix, about a block of words to each; a group that a frequent prefix makes larger is cut into blocks, and each pair
of its blocks is a tile. A pair counts on the prefix side if its common prefix is long enough and on the suffix side if it is not, so every pair
counts once. A tile returns one row for each of its words, never pairs.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least twice the word's own
count. Counts double along a chain of forms, so roots are found by a few rounds of doubling steps.

Cases: a null or empty text has no words; a null identifier is written as an empty text where the words are damaged; repeated rows count again.
An empty table gives an empty result. Other columns are ignored, whatever their names. Words of any length are compared whole: a block has fewer
of them the longer they are (TILE_BYTES). The words of one text are one array while it is read, about 12 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a word is, and which occurrences lose a code point.
RUN, LOSES_EVERY, LEAST_CHARS, LEAST_COUNT = "([A-Za-zÀ-ÿ]+)", 97, 5, 3
#: Words of a block, bytes of a block's words, and bytes of one comparison of two parts of blocks.
BLOCK, TILE_BYTES, STEP_BYTES = 512, 1 << 24, 1 << 23


def damaged_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every run of letters, A-Z lower-cased; where 97 divides the CRC-32 of `id:run`, without the code point that it picks."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % LOSES_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))


def word_counts(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; copies combine on the map side."""
    counted = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- tiles ------------------------------------------------------------------------------------------------------------


def _block_words(length: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(TILE_BYTES).cast("long") / (length * 8)).cast("int"))


def tiles(words: DataFrame) -> DataFrame:
    """(l, side, group, first, second, part, word, n): every word (word, n) in each tile that it takes part in, as of the first or second block."""
    sized = words.withColumn("chars", F.length("word"))
    lengths = sized.groupBy("chars").agg(F.count("*").alias("c"))
    classes = lengths.select(F.explode(F.array(F.col("chars"), F.col("chars") - 1)).alias("l"), "c").groupBy("l").agg(F.sum("c").alias("c"))
    classes = classes.select("l", F.ceil(F.col("c") / _block_words(F.col("l"))).alias("groups"))
    # In class l, words of l code points meet each other and those of l + 1.
    both = sized.withColumn("l", F.explode(F.array(F.col("chars"), F.col("chars") - 1))).join(classes, "l")
    half = (F.col("l") / 2).cast("int")
    sides = F.array(F.struct(F.lit("prefix").alias("side"), F.substring("word", F.lit(1), half).alias("key")), F.struct(F.lit("suffix").alias("side"), F.right("word", F.col("l") - half).alias("key")))
    dealt = both.withColumn("s", F.explode(sides)).select("l", "s.side", F.pmod(F.xxhash64("s.key"), F.col("groups")).alias("group"), "word", "n")
    size = dealt.groupBy("l", "side", "group").agg(F.count("*").alias("size"))
    blocks = size.where("size > 1").select("l", "side", "group", F.ceil(F.col("size") / (2 * _block_words(F.col("l")))).alias("blocks"))
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks"))
    met = dealt.join(blocks, ["l", "side", "group"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("l", "side", "group", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).cast("int").alias("part"), "word", "n")


def code_points(words: list[str], l: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of l or l + 1 code points as two padded matrices, aligned to the left and, read backwards, to the right, and their lengths."""
    left = np.array(words, f"<U{l + 1}").view(np.uint32).reshape(len(words), l + 1)
    if left.max(initial=0) < 256:  # a quarter of the bytes to compare
        left = left.astype(np.uint8)
    long = left[:, l] != 0
    right = np.zeros_like(left)
    right[long], right[~long, 1:] = left[long], left[~long, :-1]
    return left, np.ascontiguousarray(right[:, ::-1]), np.where(long, l + 1, l)


def _alike(a: np.ndarray, b: np.ndarray, l: int) -> np.ndarray:
    """How many of the first l code points are alike from the left, of each row of a and the same row of b."""
    differ = a[:, :l] != b[:, :l]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), l)


def _packed(part: np.ndarray) -> np.ndarray:
    """Rows of code points as rows of 64-bit numbers, equal where these are."""
    raw = np.ascontiguousarray(part).view(np.uint8).reshape(len(part), -1)
    wide = np.zeros((len(part), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view(np.uint64)


def near_pairs(a, b, l: int, side: str) -> np.ndarray:
    """Which rows of two blocks (as of code_points) are one edit apart, of the pairs that count on this side.

    All pairs are compared on the side's part of the words; common prefix and suffix are measured where it is alike.
    """
    own, need = (0, l // 2) if side == "prefix" else (1, l - l // 2)
    left, right = _packed(a[own][:, :need]), _packed(b[own][:, :need])
    alike = left[:, None, 0] == right[None, :, 0]
    for k in range(1, left.shape[1]):
        alike &= left[:, None, k] == right[None, :, k]
    alike &= (a[2][:, None] == l) | (b[2][None, :] == l)  # two longer words are of the next class
    i, j = np.nonzero(alike)
    prefix, suffix = (_alike(a[k][i], b[k][j], l) for k in (0, 1))
    near = prefix + suffix >= np.maximum(a[2][i], b[2][j]) - 1
    alike[i, j] = near if side == "prefix" else near & (prefix < l // 2)
    return alike


def compare_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best) of a tile's words that have near words there; best is the near word of largest count."""
    l, side, _, first, second = key
    rows = rows.sort_values(["n", "word"], ascending=[False, True], kind="stable")  # so that the first near row is the best
    blocks = [rows[rows["part"] == p].reset_index(drop=True) for p in ((0,) if first == second else (0, 1))]
    matrices = [code_points(list(b["word"]), l) for b in blocks]
    if len({m[0].dtype for m in matrices}) > 1:
        matrices = [(m[0].astype(np.uint32), m[1].astype(np.uint32), m[2]) for m in matrices]
    a, b = matrices[0], matrices[-1]
    step = max(1, int((STEP_BYTES / (l + 1)) ** 0.5))
    found = [(np.zeros(len(m[2]), np.int64), np.full(len(m[2]), -1)) for m in (a, b)]
    for i in range(0, len(a[2]), step):
        for j in range(0, len(b[2]), step):
            near = near_pairs(tuple(m[i : i + step] for m in a), tuple(m[j : j + step] for m in b), l, side)
            if first == second:  # a word is not near itself
                near &= np.arange(i, i + near.shape[0])[:, None] != np.arange(j, j + near.shape[1])[None, :]
            for (count, best), hits, at, other in ((found[0], near, i, j), (found[1], near.T, j, i))[: 1 if first == second else 2]:
                n = hits.sum(axis=1)
                count[at : at + len(n)] += n
                now = best[at : at + len(n)]
                now[:] = np.where((now < 0) & (n > 0), other + hits.argmax(axis=1), now)
    out = []
    for (count, best), own, other in zip(found, blocks, reversed(blocks)):
        k = np.flatnonzero(count)
        out.append(pd.DataFrame({"word": own["word"].to_numpy()[k], "n_near": count[k], "best_n": other["n"].to_numpy()[best[k]], "best": other["word"].to_numpy()[best[k]]}))
    return pd.concat(out[: len(blocks)])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words."""
    # Comparing takes long for its bytes: as many tasks as a shuffle has, not as few as its bytes would fill.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tiles(words).repartition(tasks, "l", "side", "group", "first", "second").groupBy("l", "side", "group", "first", "second").applyInPandas(compare_tile, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


# --- forms and roots --------------------------------------------------------------------------------------------------


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root) of forms (word, form): the last of each chain, by steps that double; only a count reaches the driver a round."""
    now = staged(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        stepped = now.join(further, "root", "left")
        now = staged(stepped.select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")
    raise RuntimeError("the forms make a ring")


def variant_groups(words: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of words (word, n), each once."""
    words = staged(words)
    near = staged(near_words(words))
    met = words.join(near, "word", "left").withColumn("follows", F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False)))
    formed = staged(met.select("word", "n", F.when(F.col("follows"), F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("follows"), F.col("best_n")).alias("form_n")))
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(word_counts(damaged_runs(table(spark, sf_dir, "documents"))))
