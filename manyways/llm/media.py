"""Media columns: payloads in progressive JPEG files, read back as coefficients and as full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyways.llm.common import table, trimmed
from manyways.llm.progressive import decode_coefficients, encode, pixels

UNIT = 64
TOGETHER = 1_000_000


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def store(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each padded payload: one coefficient, the format's unit, is one byte less 128."""
    return encode([(np.frombuffer(x, np.uint8).astype(np.int16) - 128).reshape(-1, UNIT) for x in payloads])


def restored(picture, size: int) -> bytes:
    """The first size bytes of a decoded file's coefficients."""
    flat = np.concatenate(picture.coefficients).reshape(-1)[:size]
    return (flat + 128).astype(np.uint8).tobytes()


def feature(tensor: np.ndarray) -> str:
    """Height x width, each channel's mean and mean square in hundredths, and its 4-bin histogram."""
    flat = tensor.reshape(-1, 3)
    n = len(flat)
    sums = flat.sum(axis=0, dtype=np.int64)
    squares = np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    bins = [np.bincount(flat[:, c] >> 6, minlength=4) for c in range(3)]
    return f"{tensor.shape[0]}x{tensor.shape[1]};" + ";".join(f"{100 * int(s) // n},{100 * int(q) // n}," + "/".join(map(str, b.tolist())) for s, q, b in zip(sums, squares, bins, strict=True))


def groups(sizes: list[int], most: int = TOGETHER):
    """Ranges of neighbours of at most so many bytes together; a larger one stands alone."""
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= most):
            total += sizes[to]
            to += 1
        yield at, to
        at = to


def images(files: DataFrame, column: str = "media") -> DataFrame:
    """files with height, width and rgb (the tensor's bytes, row by row, three a pixel); columns of these names are replaced. Null or
    undecodable media give nulls there."""

    def read(batches):
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(column)).to_pylist()
            out = []
            for a, z in groups([len(x or b"") for x in data]):
                for x in data[a:z]:
                    try:
                        t = pixels(decode_coefficients([x])[0]) if x else None
                    except Exception:  # a damaged file may fail at any place; its row has nulls
                        t = None
                    out.append((None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes()))
            extra = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "height", "width", "rgb"])

    kept = files.drop("height", "width", "rgb")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(trimmed(read), schema + ", height int, width int, rgb binary")


def stored(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media) of every row.

    A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored as a file, and all figures of the payload come
    from what the file's coefficients give back. Null text is empty; equal texts have equal values; repeated rows give repeated rows;
    other columns play no part. Files are coded in groups of about a megabyte; a longer text is a group of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in groups([len(t) for t in texts]):
                payloads = [padded(t) for t in texts[a:z]]
                files = store(payloads)
                rows = []
                for t, x, f, p in zip(texts[a:z], payloads, files, decode_coefficients(files), strict=True):
                    back = restored(p, len(x))
                    rows.append((len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature(pixels(p))))
                out = [batch.column(0).slice(a, z - a), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(files, pa.binary())] if keep_media else out, [*names, "media"] if keep_media else names)

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload")).mapInArrow(trimmed(each), schema + ", media binary" * keep_media)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
