"""Benchmark decontamination: MinHash containment search over size partitions, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel as tk
from latticework.llm.minhash import signatures
from latticework.llm.shared import mapped, small, text_mark, written

#: Coordinates of a signature. One equal coordinate makes a candidate.
COORDINATES = 64
#: Items of so many shingles or fewer are found by any one of them; larger ones fall in classes that double from here.
LEAST_CLASS = 8
#: Share of a test item's shingles, in percent, that a document must hold.
CONTAINED = 75
#: Test items are sent to the executors in blocks of about so many bytes of text; more blocks mean more passes.
BLOCK_BYTES = 8 << 20
#: Ids of contaminated documents are broadcast up to so many.
MAX_BROADCAST_IDS = 500_000
FILTER_BITS = 18


class Items:
    """A block of test items: their shingle sets, and their signatures by size class."""

    def __init__(self, ids: list, texts: list):
        data, offs = tk.buffers(pa.array(texts, pa.string()))
        self.values, self.offs = tk.shingle_sets(data, offs)
        self.ids = np.array(ids, object)
        sizes = np.diff(self.offs)
        sign = signatures(self.values, self.offs, COORDINATES)
        self.classes = []
        few = np.flatnonzero((sizes > 0) & (sizes <= LEAST_CLASS))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own = np.flatnonzero(np.isin(owner, few))
        own = own[np.argsort(self.values[own], kind="stable")]
        self.few = (self.values[own], owner[own], self.marked(self.values[own]))
        half = 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for u in np.unique(half[sizes > LEAST_CLASS]).tolist():
            of = np.flatnonzero((half == u) & (sizes > LEAST_CLASS))
            keys = self.keys(sign[of]).ravel()
            order = np.argsort(keys, kind="stable")
            self.classes.append((u, keys[order], np.repeat(of, COORDINATES)[order], self.marked(keys)))

    @staticmethod
    def marked(keys: np.ndarray) -> np.ndarray:
        """Which leading bits the keys have."""
        marks = np.zeros(1 << FILTER_BITS, bool)
        marks[keys >> np.uint64(64 - FILTER_BITS)] = True
        return marks

    @staticmethod
    def keys(sign: np.ndarray) -> np.ndarray:
        """64-bit keys of coordinates, apart by their number."""
        return (sign.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)

    def found(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, common shingles) of all pairs that reach CONTAINED."""
        lowered = tk.LOWER[data]
        starts, ends, word_offs = tk.words(lowered, offs)
        sequence, cuts = tk.shingles(tk.word_hashes(lowered, starts, ends), word_offs)
        if not len(sequence):
            return
        candidates: set[tuple[int, int]] = set()

        def meet(doc: np.ndarray, key: np.ndarray, keys: np.ndarray, items: np.ndarray) -> None:
            a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for r, x, y in zip(doc[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                candidates.update((r, i) for i in items[x:y].tolist())

        keys, items, marks = self.few
        at = np.flatnonzero(marks[sequence >> np.uint64(64 - FILTER_BITS)])
        meet(np.searchsorted(cuts, at, "right") - 1, sequence[at], keys, items)
        n = np.diff(cuts)
        u = self.classes[0][0] if self.classes else 1
        blocks = -(-n // u)
        edge = np.concatenate(([0], np.cumsum(blocks)))
        inside = np.arange(edge[-1]) - np.repeat(edge[:-1], blocks)
        head = np.append(np.repeat(cuts[:-1], blocks) + inside * u, cuts[-1])
        low = signatures(sequence, head, COORDINATES) if self.classes else None
        for size, keys, items, marks in self.classes:
            while u < size:  # blocks of twice the size, document by document
                half = -(-blocks // 2)
                to = np.concatenate(([0], np.cumsum(half)))
                at = np.arange(to[-1]) - np.repeat(to[:-1], half)
                left = np.repeat(edge[:-1], half) + 2 * at
                right = np.minimum(left + 1, np.repeat(edge[1:], half) - 1)
                low, blocks, edge, u = np.minimum(low[left], low[right]), half, to, 2 * u
            doc = np.repeat(np.arange(len(blocks)), blocks)
            window = low.copy()
            same = doc[1:] == doc[:-1]
            window[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
            found = self.keys(window)
            row, col = np.nonzero(marks[found >> np.uint64(64 - FILTER_BITS)])
            meet(doc[row], found[row, col], keys, items)
        if not candidates:
            return
        sets, set_offs = tk.distinct(sequence, cuts)
        for r, i in sorted(candidates):
            have, want = sets[set_offs[r] : set_offs[r + 1]], self.values[self.offs[i] : self.offs[i + 1]]
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            common = int((have[at] == want).sum())
            if 100 * common >= CONTAINED * len(want):
                yield r, i, common


def _search(batches: Iterator[pa.RecordBatch], ids: list, texts: list) -> Iterator[pa.RecordBatch]:
    items = Items(ids, texts)
    sizes = np.diff(items.offs)
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs):
            found = list(items.found(part, part_offs))
            docs = batch.column(0).slice(a, b - a).take(pa.array([r for r, _, _ in found], pa.int64()))
            which = [i for _, i, _ in found]
            yield pa.record_batch(
                [docs, pa.array(items.ids[which].tolist(), pa.int64()), pa.array(sizes[which], pa.int64()), pa.array([c for _, _, c in found], pa.int64())],
                ["doc_id", "item_id", "item_shingles", "common"],
            )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a test item of whose 5-word shingles it holds 75 % or more.

    Returns doc_id, item_id, item_shingles, common, containment; one row per row of ``docs`` and row of ``benchmark``
    that match. Other columns are ignored. Null and empty texts match nothing; an item of under five words matches
    texts that are the same words only.

    Items fall in size classes. Those of up to 8 shingles are candidates wherever one of these occurs, so none is missed.
    For the classes of up to u = 16, 32, ... shingles a document is a row of windows of 2u shingles, one every u, so an
    item lies within a window whatever the document's length. Window and item are compared by 64 coordinates; any equal
    one makes a candidate. Candidates are verified on the whole shingle sets. A pair at 75 % is missed with a
    probability below 1e-5. Items go to the executors in blocks of BLOCK_BYTES of text, a pass each.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    passes = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        ids, texts = [r.item_id for r in rows], [r.text for r in rows]
        passes.append(mapped(slim, lambda it, ids=ids, texts=texts: _search(it, ids, texts), "doc_id long, item_id long, item_shingles long, common long"))
    return reduce(DataFrame.unionByName, passes).withColumn("containment", F.col("common") / F.col("item_shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no test item, with all their columns; rows that share a doc_id, or have none, may part."""
    marked = docs.withColumn("__text_mark", text_mark(F.col("text")))
    found = leaks(marked.select(F.col("__text_mark").alias("doc_id"), "text"), benchmark)
    found = written(found.select(F.col("doc_id").alias("__text_mark")).distinct(), "decontaminate-ids")
    return marked.join(small(found, MAX_BROADCAST_IDS), "__text_mark", "left_anti").select(*docs.columns)
