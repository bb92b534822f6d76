"""Media columns: storing payloads as media, sniffing signatures, correcting declared types, carving embedded media.

One Aho-Corasick pass over a blob locates the magic bytes of all known formats. Each place is then put to the
format's validator, which walks the structure (chunks, checksums, declared sizes) and gives the length of the medium, or
nothing. A confirmed medium at offset 0 is the blob's true type, whatever was declared; the others, left to right
and not inside one another, are carved.

Cases: null blobs and texts count as empty. A blob without a confirmed medium is `application/octet-stream`. Very long
payloads are stored and read whole. Null identifiers and repeated rows are returned as they came; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import table

#: A picture's row: 64 pixels of three 8-bit samples.
ROW = 192
WIDTH = ROW // 3
UNKNOWN = "application/octet-stream"

# The formats' magic bytes and media types.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"P6": "image/x-portable-pixmap",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
}


# --- writing ---------------------------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: bytes) -> bytes:
    rows = len(samples) // ROW
    filtered = np.zeros((rows, ROW + 1), np.uint8)
    filtered[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + _chunk(b"IEND", b"")


def write_wav(samples: bytes) -> bytes:
    rate = 8000
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_bmp(samples: bytes) -> bytes:
    offset = 14 + 40
    head = b"BM" + struct.pack("<IHHI", offset + len(samples), 0, 0, offset)
    return head + struct.pack("<IiiHHIIiiII", 40, WIDTH, -(len(samples) // ROW), 1, 24, 0, len(samples), 2835, 2835, 0, 0) + samples


def write_ppm(samples: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (WIDTH, len(samples) // ROW) + samples


WRITERS = {"image/png": write_png, "audio/wav": write_wav, "image/bmp": write_bmp, "image/x-portable-pixmap": write_ppm}
KINDS = list(WRITERS)


# --- validating: the length of the medium that begins at `at`, or None ------------------------------------------------


def _png_chunks(b: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of chunks whose checksums hold."""
    at += 8
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        end = at + 8 + size
        if end + 4 > len(b) or zlib.crc32(memoryview(b)[at + 4 : end]) != struct.unpack_from(">I", b, end)[0]:
            return
        yield kind, at + 8, end
        at = end + 4


def png_length(b: bytes, at: int) -> int | None:
    data = False
    for k, (kind, start, end) in enumerate(_png_chunks(b, at)):
        if k == 0 and (kind != b"IHDR" or end - start != 13):
            return None
        data |= kind == b"IDAT"
        if kind == b"IEND":
            return end + 4 - at if data else None
    return None


def _wav_chunks(b: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    stop = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    found, at = {}, at + 12
    if stop > len(b):
        return None
    while at + 8 <= stop:
        kind, size = struct.unpack_from("<4sI", b, at)
        if at + 8 + size > stop:
            return None
        found.setdefault(kind, (at + 8, size))
        at += 8 + size + size % 2
    return found


def wav_length(b: bytes, at: int) -> int | None:
    found = _wav_chunks(b, at)
    if not found or b"data" not in found or found.get(b"fmt ", (0, 0))[1] < 16:
        return None
    return 8 + struct.unpack_from("<I", b, at + 4)[0]


def bmp_length(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, _, _, offset = struct.unpack_from("<IHHI", b, at + 2)
    head, width, height, planes, bits, packing = struct.unpack_from("<IiiHHI", b, at + 14)
    if head != 40 or planes != 1 or packing or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    needed = (width * bits + 31) // 32 * 4 * abs(height)
    return size if offset >= 54 and offset + needed <= size <= len(b) - at else None


def _ppm_header(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(width, height, where the samples begin)."""
    parts = b[at : at + 40].split(None, 4)
    if len(parts) < 4 or parts[0] != b"P6" or not all(p.isdigit() for p in parts[1:4]) or not 0 < int(parts[3]) < 256:
        return None
    start = at
    for part in parts[:4]:
        start = b.index(part, start) + len(part)
    return int(parts[1]), int(parts[2]), start + 1


def ppm_length(b: bytes, at: int) -> int | None:
    found = _ppm_header(b, at)
    if not found or not found[0] or not found[1]:
        return None
    end = found[2] + 3 * found[0] * found[1]
    return end - at if end <= len(b) else None


def gif_length(b: bytes, at: int) -> int | None:
    start, n = at, len(b)
    if at + 13 > n:
        return None
    flags = b[at + 10]
    at += 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while at < n:
        if b[at] == 0x3B:
            return at + 1 - start
        if b[at] == 0x21:
            at += 2
        elif b[at] == 0x2C and at + 10 < n:
            flags = b[at + 9]
            at += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return None
        while at < n and b[at]:
            at += 1 + b[at]
        at += 1
    return None


VALIDATORS = {"image/png": png_length, "audio/wav": wav_length, "image/bmp": bmp_length, "image/x-portable-pixmap": ppm_length, "image/gif": gif_length}


# --- sniffing --------------------------------------------------------------------------------------------------------------


def automaton():
    """Aho-Corasick over the signatures; a byte is a character of the same number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def media_in(blob: bytes, signatures) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media of a blob, left to right, none inside another."""
    out, free = [], 0
    for last, (size, kind) in signatures.iter(blob.decode("latin-1")):
        at = last + 1 - size
        if at >= free and (length := VALIDATORS[kind](blob, at)):
            out.append((kind, at, length))
            free = at + length
    return out


def samples_of(kind: str, blob: bytes) -> tuple[bytes, str]:
    """The 8-bit samples that a stored medium holds, and its shape in words."""
    if kind == "image/png":
        parts = [(k, blob[s:e]) for k, s, e in _png_chunks(blob, 0)]
        width, height = struct.unpack(">II", parts[0][1][:8])
        rows = np.frombuffer(zlib.decompress(b"".join(body for k, body in parts if k == b"IDAT")), np.uint8).reshape(height, 3 * width + 1)
        return rows[:, 1:].tobytes(), f"{width}x{height}"
    if kind == "audio/wav":
        start, size = _wav_chunks(blob, 0)[b"data"]
        return blob[start : start + size], f"{size} samples"
    if kind == "image/bmp":
        offset, (width, height) = struct.unpack_from("<I", blob, 10)[0], struct.unpack_from("<ii", blob, 18)
        return blob[offset : offset + 3 * width * abs(height)], f"{width}x{abs(height)}"
    width, height, start = _ppm_header(blob, 0)
    return blob[start : start + 3 * width * height], f"{width}x{height}"


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples' values, from their counts."""
    count = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, value = len(samples), np.arange(256)
    total, square = int((count * value).sum()), int((count * value * value).sum())
    share = count[count > 0] / n
    return f"mean={total / n:.4f};deviation={max(0.0, square / n - (total / n) ** 2) ** 0.5:.4f};entropy={-(share * np.log2(share)).sum():.4f}"


# --- DataFrames --------------------------------------------------------------------------------------------------------


def sniff_media(blobs: DataFrame, id_col: str, blob_col: str, declared_col: str, contents: bool = False) -> DataFrame:
    """(id, declared_type, media_type, corrected, media): media are the confirmed (type, offset, length[, content]) of a blob."""
    read = blobs.select(F.col(id_col).alias("id"), F.col(blob_col).alias("blob"), F.col(declared_col).alias("declared"))
    item = [T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]
    item += [T.StructField("content", T.BinaryType())] if contents else []
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField("declared_type", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("media", T.ArrayType(T.StructType(item)))])
    arrow_item = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *([("content", pa.binary())] if contents else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        for batch in batches:
            found, types = [], []
            for blob in batch.column(1).to_pylist():
                blob = blob or b""
                own = media_in(blob, signatures)
                types.append(own[0][0] if own and own[0][1] == 0 else UNKNOWN)
                found.append([{"type": k, "offset": at, "length": n} | ({"content": blob[at : at + n]} if contents else {}) for k, at, n in own])
            declared = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(types), pa.array([a != b for a, b in zip(declared, types)]), pa.array(found, pa.list_(arrow_item))], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled up with spaces to a positive multiple of a row, and their number before that."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ROW or (0 if raw else ROW)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared_type, blob): every text as a medium; the payload's checksum picks the format, and the declared type is PNG throughout."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("declared_type", T.StringType()), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [payload_of(t.as_py()) for t in batch.column(1)]
            blobs = [WRITERS[KINDS[zlib.crc32(p) % len(KINDS)]](p) for p, _ in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array(["image/png"] * len(blobs)), pa.array(blobs, pa.binary())], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def read_stored(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from stored media: type by signature, payload digests and features."""
    read = stored.select(F.col(id_col).alias("id"), "n_bytes", "declared_type", "blob")
    long, string = T.LongType(), T.StringType()
    kinds = {"n_bytes": long, "payload_bytes": long, "payload_sha256": string, "tail_crc32": long, "media_bytes": long, "media_sha256": string, "feature": string, "declared_type": string, "media_type": string}
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *(T.StructField(n, k) for n, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = automaton()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in kinds if n not in ("n_bytes", "declared_type")}
            for blob in batch.column(3).to_pylist():
                kind, at, length = next(iter(media_in(blob, signatures)), (UNKNOWN, 0, 0))
                if at or length != len(blob):
                    raise ValueError("a stored medium is not whole")
                payload, shape = samples_of(kind, blob)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), f"{kind};{shape};{features(payload)}", kind)
                for name, value in zip(out, row):
                    out[name].append(value)
            own = {"n_bytes": batch.column(1), "declared_type": batch.column(2)}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(own.get(n, None) if n in own else pa.array(out[n], pa.int64() if k == long else pa.string()) for n, k in kinds.items())], names=schema.names)

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_stored(store_texts(table(spark, sf_dir, "documents")))
