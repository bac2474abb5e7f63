"""Packing documents into training sequences along a space-filling curve.

Each document becomes its ids (and an end id). A hashed bag of its ids is projected to a few dimensions and quantised,
and the cell's position on a Hilbert curve is the document's key: near keys are near documents. The documents are
range-sorted by that key and laid end to end in that order, cut at every sequence length, so a sequence holds
neighbours and only the last one of each range is padded.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.encoding import encoder
from timberline.sources.shared import materialise

#: Dimensions of the curve and bits of each; 63 bits in a key at most.
DIMS, BITS = 4, 15
#: Rows of the hashed bag of ids.
BAG = 4096
END_ID = 1


def projection(dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BAG, dims))


def position(ids: np.ndarray, project: np.ndarray) -> np.ndarray:
    """The document's cell: its hashed bag of ids, with unit length, projected and quantised; empty: the middle."""
    row = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BAG)
    bag = np.sqrt(np.bincount(row.astype(np.int64), minlength=BAG))
    x = bag @ project / max(1.0, float(np.sqrt((bag * bag).sum())))
    return np.clip((x / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of n x dims cells (the published transpose algorithm, by columns)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[i]
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, tokens (the number of ids), ids (little-endian, of `width` bytes each), width and curve (the Hilbert
    key) for each row of docs. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, project = encoder(tokenizer), projection()
        kind = code.dtype if end_id is None or end_id < 1 << 16 else np.dtype("<u4")
        tail = np.array([] if end_id is None else [end_id], dtype=kind)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [np.concatenate([code.ids(t.as_py()).astype(kind, copy=False), tail]) for t in part.column(1)]
                curve = hilbert(np.stack([position(i, project) for i in ids]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([kind.itemsize] * len(ids), pa.int32()), pa.array(curve)],
                    ["doc_id", "tokens", "ids", "width", "curve"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, tokens long, ids binary, width int, curve long")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` ids.

    Columns: doc_id, start (ids of its document before the piece), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset (in the sequence, gapless from 0), curve. Each id lies in exactly one piece. All
    sequences are full but the last of each range of the curve.

    Null and empty texts are the end id alone (no piece if there is none). Repeated rows are packed as often as they
    occur. Texts are whole, however long; a null doc_id is kept. An empty table gives no rows.
    """
    # written once: the range boundaries and the sort both read it, and encoding is by far the dearest step
    rows = materialise(encoded(docs, tokenizer, end_id), "encoded")
    # equal keys (copies) are dealt by a hash, so no range has to hold them all
    order = ["curve", "salt", "doc_id", "tokens"]
    ranged = rows.withColumn("salt", F.xxhash64("doc_id", "tokens", F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order, F.crc32("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, tokens, raw, width, curve in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "ids", "width", "curve")), strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                start = 0
                while start < tokens:
                    if offset == length:
                        sequence, offset = sequence + 1, 0
                    n = min(length - offset, tokens - start)
                    out.append((doc, start, n, ids[start : start + n].astype("<u4").tobytes(), tokens, sequence, offset, curve))
                    start, offset = start + n, offset + n
                if len(out) >= 2000:
                    yield pieces(out)
                    out = []
            if out:
                yield pieces(out)

    return ranged.select("doc_id", "tokens", "ids", "width", "curve").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve long")


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve"]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
