"""Product codes of vectors: each equal part of a vector becomes the number of the nearest entry of that part's codebook.

Vectors become integers, so sums are exact and codebooks do not depend on how rows are dealt. Rounds run over blocks of
vectors, stored by dimension: distances are added up one dimension after the other, sums and counts of each entry's parts
are int64 tensors of fixed size that meet in a reduction tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.shared import discarded, mapped, shuffles_dropped, written
from latticework.session import ship

#: Tasks whose tensors meet in one task of the reduction tree.
FAN_IN = 32
#: Integers beyond this might overflow sums of squares; such components are refused.
MOST = 1 << 27


@dataclass
class Codes:
    """``rows``: the vectors' own columns, codes (a byte for each part) and error; ``books``: (part, entry, component)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """Hash of all entries' components by part, entry and place, as decimal integers with commas."""
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def integers(vectors: pa.ListArray, parts: int, scale: int) -> np.ndarray:
    """(dimension, vector): floor(scale * x). Vectors must have one length, a multiple of ``parts``."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy()
    if len(flat) % max(n, 1) or len(flat) // max(n, 1) % parts or n and len(set(np.diff(vectors.offsets.to_numpy()).tolist())) > 1:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    x = np.floor(flat.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"components beyond {MOST} / {scale} are refused")
    return x.astype(np.int64).reshape(n, -1).T if n else np.zeros((0, 0), np.int64)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, vector): the nearest entry, ties to the lower, and its squared distance. ``block``: (dimension, vector)."""
    parts, entries, width = books.shape
    best, far = np.empty((parts, block.shape[1]), np.int64), np.empty((parts, block.shape[1]), np.int64)
    for p in range(parts):
        d = np.zeros((block.shape[1], entries), np.int64)
        for k in range(width):
            step = block[p * width + k][:, None] - books[p, :, k]
            d += step * step
        best[p] = d.argmin(1)
        far[p] = np.take_along_axis(d, best[p][:, None], 1)[:, 0]
    return best, far


def _added(books: np.ndarray):
    """Adds a block's parts to the sums and counts of their entries."""
    parts, _, width = books.shape

    def go(held: tuple[np.ndarray, np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = held
        best, _ = nearest(block, books)
        for p in range(parts):
            np.add.at(counts[p], best[p], 1)
            for k in range(width):
                np.add.at(sums[p, :, k], best[p], block[p * width + k])
        return sums, counts

    return go


def _both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", keep: Sequence[str] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codes:
    """Codes of all vectors whose components are all there and finite; other rows are left out.

    Codebooks start as the parts of the vectors with the ``entries`` smallest ids (nulls last, equal ids by vector; all, if
    there are fewer). Each round assigns every part and replaces each entry by the floor of its parts' mean; entries without
    parts stay. Rows: id, the columns ``keep``, codes, error (squared distances summed over parts); repeated rows each get
    theirs. Vectors of several lengths, lengths that ``parts`` does not divide, and components that could overflow raise
    ValueError. No vector gives empty rows and no codebook.
    """
    if entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.select(F.col(id).alias("id"), *(F.col(c).alias(f"keep{k}") for k, c in enumerate(keep)), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ok)
    good = good.where(F.size("v") > 0)
    first = good.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # at most ``entries`` vectors
    kinds = ", ".join(f"`{c}` {t}" for c, t in good.drop("v").dtypes)
    if not first:
        books = np.zeros((parts, 0, 0), np.int64)
    else:
        seeds = integers(pa.array([r.v for r in first], pa.list_(pa.float64())), parts, scale)
        books = np.ascontiguousarray(seeds.reshape(parts, -1, len(first)).transpose(0, 2, 1))
    width = books.shape[2]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = integers(b["v"], parts, scale)
                if len(x) != parts * width:
                    raise ValueError(f"vectors must have one length, a multiple of {parts}")
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, np.int32).tobytes()], pa.binary())], ["block"])

    if first:
        blocks = written(mapped(good.select("v"), packed, "block binary"), "vector-blocks")
        dims = parts * width
        arrays = blocks.rdd.map(lambda r: np.frombuffer(r.block, np.int32).reshape(dims, -1).astype(np.int64))
        depth = max(2, math.ceil(math.log(max(2, arrays.getNumPartitions()), FAN_IN)))
        for _ in range(rounds):
            zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
            sums, counts = arrays.treeAggregate(zero, _added(books), _both, depth)
            books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        discarded(blocks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                best, far = nearest(integers(b["v"], parts, scale), books)
                codes = pa.array([c.tobytes() for c in best.T.astype(np.uint8)], pa.binary())
                names = [c for c in b.schema.names if c != "v"]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), codes, pa.array(far.sum(0))], [*names, "codes", "error"])

    with shuffles_dropped(spark):
        rows = written(mapped(good, coded, f"{kinds}, codes binary, error long"), "vector-codes")
    return Codes(rows.select(F.col("id").alias(id), *(F.col(f"keep{k}").alias(c) for k, c in enumerate(keep)), "codes", "error"), books)


def decoded(codes: bytes, books: np.ndarray, scale: int = 256) -> np.ndarray:
    """The vector that a row's codes stand for: its entries, half a step up since components were rounded down."""
    return (books[np.arange(len(books)), np.frombuffer(codes, np.uint8)].ravel() + 0.5) / scale
