"""Packing of tokenised documents into sequences by minimum bin slack.

A document is cut into full windows and one remainder. What has to be packed is then only how many pieces there are of
each length: at most `capacity` lengths, whatever the size of the corpus. Over this histogram, windows are filled one
kind at a time: the longest length still there opens the window, and a bitset dynamic programme over the remaining
lengths finds the multiset whose sum comes closest to the capacity; backtracking through the programme's steps gives
the count of each length. A filled window is repeated as often as its lengths are there, so there are few kinds.

Full windows need no plan: each is a sequence of its own. Of the remainders, Spark counts, ranks and places: each gets its
rank among the pieces of its length (within hash buckets, as many as the length has rows for, shifted by the buckets
before, so that no length is ranked in one task), and the rank gives its window and offset.

Ids are those of the tokenizers library. Where its vocabulary file says that merges are numbered in order, the same merges are run
by tiktoken, which gives the same ids in a third of the time; texts that quote an added token, and texts that tiktoken's
patterns give up on, go to the tokenizers library itself. Tests hold both against each other.

Cases: a null or empty text is the end id alone. Added tokens that a text quotes are one id each, as the library has it by default.
Null identifiers and repeated rows are packed like any others; rows that are alike in everything are interchangeable. Very long texts are cut, never truncated. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged, table

CAPACITY, END_ID = 2048, 1
#: Remainders of a length that are ranked in one bucket, and the least number of buckets of a length.
BUCKET_ROWS, LEAST_BUCKETS = 65_536, 16
# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokenizer:
    """A byte-level merge tokenizer: ids of the tokenizers library, by tiktoken where it runs the same merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: A text that quotes one of these is encoded by the library, which takes it for one id before it cuts.
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.quick = self._quick(json.load(f))

    def _quick(self, spec: dict):
        """tiktoken with the vocabulary, if it says what tiktoken can do: plain byte-level merges, numbered in their order."""
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec["normalizer"]
        if not (plain and level):
            return None
        byte, vocabulary = byte_characters(), model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(set(merged)) < len(merged):
            return None
        ranks = {bytes(byte[c] for c in token): n for token, n in vocabulary.items() if token not in self.added}
        return tiktoken.Encoding("ledgerline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and not any(a in text for a in self.added):
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern gives up on very long runs of white space
                pass
        return self.whole([text])[0]


_LOADED: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer, read once a worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's full windows and its remainder."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), *(T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(texts):
                ids = np.concatenate((encoder.encode(text), end)).astype("<u4", copy=False)
                n = len(ids)
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    row.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=schema.names)

    return read.mapInArrow(run, schema)


# --- the windows, from the histogram of lengths ------------------------------------------------------------------------


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[l] of each l, whose sum comes closest to room without passing it.

    The reachable sums are a bitset. Each step offers k copies of a length (k in powers of two up to what is there and
    fits); the bitset before each step is kept, and walking back through the steps tells which were taken.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            taken[length] = taken.get(length, 0) + k
    return taken


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Kinds of windows as ({length: pieces in one window}, number of such windows); together they hold every piece once."""
    left = {length: n for length, n in histogram.items() if n > 0}
    plan = []
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        rest = dict(left)
        rest[first] -= 1
        kind = fullest([x for x in lengths if x <= capacity - first and rest[x]], rest, capacity - first)
        kind[first] = kind.get(first, 0) + 1
        times = min(left[length] // n for length, n in kind.items())
        plan.append((kind, times))
        for length, n in kind.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a window, first window, offset), sorted: where the pieces of each rank go.

    A kind holds at most sqrt(2 * capacity) different lengths, so the table has a fixed bound.
    """
    rows, used, window = [], {}, 0
    for kind, times in plan:
        offset = 0
        for length, n in sorted(kind.items(), reverse=True):
            rows.append((length, used.get(length, 0), n, window, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        window += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be materialised: they are counted first and placed then.

    What reaches the driver is a count for each length, and then one for each bucket of bucket_rows remainders or so.
    """
    spark = pieces.sparkSession
    rest = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}  # at most capacity rows
    buckets = [max(LEAST_BUCKETS, -(-histogram.get(n, 0) // bucket_rows)) for n in range(capacity)]
    first = np.cumsum([0, *buckets])
    own = F.element_at(F.lit(buckets), (F.col("length") + 1).cast("int"))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), own).cast("long"))
    before = np.zeros(first[-1], np.int64)
    counted = dealt.groupBy("length", "bucket").count().toArrow()
    before[first[counted.column("length").to_numpy()] + counted.column("bucket").to_numpy()] = counted.column("count").to_numpy()
    for n in range(capacity):
        part = before[first[n] : first[n + 1]]
        part[:] = np.cumsum(part) - part
    plan = plan_windows(histogram, capacity)
    shared = spark.sparkContext.broadcast((first, before, slots(plan)))

    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("rank", F.row_number().over(within).cast("long"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names, span = schema.names, 1 << 50

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, slot = shared.value
        key = slot[:, 0] * span + slot[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, bucket, rank = (batch.column(n).to_numpy() for n in ("length", "bucket", "rank"))
            rank = rank - 1 + before[first[length] + bucket]
            at = slot[np.searchsorted(key, length * span + rank, "right") - 1]
            place_in = rank - at[:, 1]
            sequence, offset = at[:, 3] + place_in // at[:, 2], at[:, 4] + place_in % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-2]), pa.array(sequence), pa.array(offset)], names=names)

    windows = sum(times for _, times in plan)
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(windows), "offset": F.lit(0).cast("long")})
    return ranked.mapInArrow(place, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and place in it; the tokens are cut once and staged."""
    packed = pack_pieces(staged(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity)), capacity)
    return packed if id_col == "doc_id" else packed.withColumnRenamed("doc_id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer())
