"""SentencePiece encoding and decoding of whole texts with a merge-type (BPE) vocabulary.

A text is normalised as the model says, cut into chunks at word marks where no piece of the vocabulary spans the cut,
and every chunk is segmented by an agenda: all adjacent symbol pairs that form a piece wait in order of the
piece's score and then of place; the best is merged and its new neighbours join the agenda. For chunks of up to SHORT_CHARS
characters the agenda is a list; for longer ones a heap, in which outdated entries are skipped, after cutting the chunk wherever no
piece holds the two characters next to each other, so that a text without spaces is not one agenda. Symbols that are no piece fall back to their bytes. A worker keeps the results of short chunks in a bounded
table. In each Arrow batch, all chunks that were segmented anew are encoded by the sentencepiece library too; if one
should differ, the library's ids are used and counted in `n_corrected`. Ids are decoded by the library, and a text
whose decoding is not the text itself is encoded whole by the library as well.

Cases: a null or empty text has the begin and end ids only and decodes to the empty text. Very long texts are read
whole; a batch is worked on in slices of about a million characters. Null identifiers and repeated rows are returned
as they came; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import table

MARK = "▁"
SLICE_CHARS = 1_000_000
#: Chunks that a worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 40
#: Chunks up to this length have their agenda in a list.
SHORT_CHARS = 32
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class MergeVocabulary:
    """The pieces of a merge-type model and the agenda that segments with them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models of normal, byte and control pieces are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep characters and white space as they are are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        by_score = sorted({proto.pieces[i].score for i in ids.values()}, reverse=True)
        place = {score: k for k, score in enumerate(by_score)}
        self.rank = {piece: place[proto.pieces[i].score] for piece, i in ids.items()}
        self.packed = {piece: i.to_bytes(4, "little") for piece, i in ids.items()}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_packed = [byte_ids[b].to_bytes(4, "little") for b in range(256)] if len(byte_ids) == 256 else None
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN).to_bytes(4, "little")
        self.begin = self.library.bos_id().to_bytes(4, "little")
        self.end = self.library.eos_id().to_bytes(4, "little")
        spans = any(re.search(f"[^{MARK}]{MARK}", piece) for piece in ids)
        self.cut = re.compile(r"(?s).+" if spans or not self.prefix else f"{MARK}*[^{MARK}]+|{MARK}+")
        #: Characters that stand next to each other in some piece: no merge spans any others.
        self.adjacent = {pair for piece in ids for pair in zip(piece, piece[1:])}
        self.seen: dict[str, bytes] = {}

    def segment(self, chunk: str) -> list[str]:
        """The agenda: merges the best-scored adjacent pair, the leftmost of equals, until no pair forms a piece."""
        if len(chunk) <= SHORT_CHARS:
            return self.segment_short(chunk)
        out, start = [], 0
        for end, pair in enumerate(zip(chunk, chunk[1:]), 1):
            if pair not in self.adjacent:
                out += self.segment_part(chunk[start:end])
                start = end
        return out + self.segment_part(chunk[start:])

    def segment_part(self, part: str) -> list[str]:
        return self.segment_short(part) if len(part) <= SHORT_CHARS else self.segment_long(part)

    def segment_short(self, chunk: str) -> list[str]:
        """The agenda as a plain list of the pairs' ranks, by place: quicker than a heap for a word."""
        rank, symbols, no = self.rank.get, list(chunk), len(self.rank)
        agenda = [rank(a + b, no) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == no:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], no)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], no)
        return symbols

    def segment_long(self, chunk: str) -> list[str]:
        """The agenda as a heap, with the symbols in a linked list."""
        rank, symbols = self.rank, list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            symbols[i] = merged = left + right
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(merged + symbols[k])
                if r is not None:
                    heappush(agenda, (r, i, k, size + len(symbols[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + merged)
                if r is not None:
                    heappush(agenda, (r, h, i, size + len(symbols[h])))
        return [s for s in symbols if s]

    def pack(self, symbols: list[str]) -> bytes:
        """Ids of symbols, as little-endian 32-bit integers; what is no piece becomes its bytes, or the unknown id."""
        out = []
        for s in symbols:
            known = self.packed.get(s)
            if known is not None:
                out.append(known)
            elif self.byte_packed is not None:
                out.extend(self.byte_packed[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return b"".join(out)

    def checked(self, chunks: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """Ids of chunks by the agenda, each held against the library, and the chunks that the library corrected."""
        own = {c: self.pack(self.segment(c)) for c in chunks}
        asked = [c for c in chunks if self.prefix and c.startswith(self.prefix) and len(c) > len(self.prefix)]
        wrong = set()
        for c, ids in zip(asked, self.library.encode([c[len(self.prefix) :] for c in asked], num_threads=1)):
            if (exact := pack_ids(ids)) != own[c]:
                own[c] = exact
                wrong.add(c)
        return own, wrong

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Packed ids of texts with begin and end, and how many chunks of each the library corrected."""
        cut = [self.cut.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list(set().union(*cut).difference(self.seen))
        fresh, wrong = self.checked(new)
        known = self.seen
        if fresh:
            known.update(fresh)
        packed = [self.begin + b"".join(map(known.__getitem__, chunks)) + self.end for chunks in cut]
        for c in fresh:
            if len(c) > REMEMBERED_CHARS or c in wrong:
                del known[c]
        return packed, [sum(c in wrong for c in chunks) if wrong else 0 for chunks in cut]

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.library.decode([memoryview(p).cast("I").tolist() for p in packed], num_threads=1)


def pack_ids(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_LOADED: dict[str, MergeVocabulary] = {}


def vocabulary(path: str) -> MergeVocabulary:
    """The vocabulary, read once a worker."""
    if path not in _LOADED:
        _LOADED[path] = MergeVocabulary(path)
    return _LOADED[path]


def slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive slices of a batch of about SLICE_CHARS characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if texts:
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, ids, decoded, n_tokens, ids_sha256, decoded_sha256, n_corrected) of every text; keep_ids=False leaves out ids and decoded."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [T.StructField("id", read.schema["id"].dataType)]
    if keep_ids:
        fields += [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_corrected", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                own = texts[part]
                packed, corrected = vocab.encode(own)
                decoded = vocab.decode(packed)
                for k, (text, back) in enumerate(zip(own, decoded)):
                    if text != back:
                        exact = pack_ids(vocab.library.encode(text, add_bos=True, add_eos=True))
                        if exact != packed[k]:
                            packed[k], decoded[k] = exact, vocab.decode([exact])[0]
                            corrected[k] += 1
                columns = [batch.column(0).slice(part.start, part.stop - part.start)]
                if keep_ids:
                    columns += [pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
                columns += [
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                    pa.array(corrected, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return read.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents"), model_path, keep_ids=False)
