"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel as tk
from latticework.llm.shared import WORD, components, discarded, mapped, small, text_mark, written

#: 40 bands of 5 coordinates: of links at similarity 0.75 one in 50,000 shares no band.
BANDS, ROWS = 40, 5
SHIFT = np.uint32(0x9E3779B1)
U32 = np.uint32
#: Distinct shingles handled at a time, so that a pass stays in the cache.
BLOCK = 1 << 15
#: Texts left apart in a bucket are compared by two bits of so many coordinates; a pair at similarity 0.75 agrees
#: in 81 % of them, and in fewer than 76.25 % once in 40,000 times.
FINE, LEAST_AGREEMENT = 1024, 0.7625
#: Ids of documents in shared buckets are broadcast up to so many, beyond that joined by a shuffle.
MAX_BROADCAST_IDS = 500_000


def first_permutation(x: np.ndarray) -> np.ndarray:
    """Places 0 .. 2^32 - 1 of shingle hashes: a bijection of the low 32 bits."""
    x = x.astype(U32)
    x ^= x >> U32(15)
    x *= U32(0x2C1B3C6D)
    x ^= x >> U32(12)
    x *= U32(0x297A2D39)
    x ^= x >> U32(15)
    return x


def signatures(values: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """k coordinates for each non-empty document (uint32, documents x k).

    ``first_permutation`` gives each shingle a place on the circle 0 .. 2^32 - 1. A second permutation of the
    circle, turned by k * SHIFT places, gives coordinate k: the least value it has at the document's places.
    """
    out = np.zeros((len(offs) - 1, k), U32)
    places = first_permutation(values)
    full = np.flatnonzero(np.diff(offs))
    heads = offs[full]
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(heads, heads[i] + BLOCK, "right")) - 1)
        end = heads[j] if j < len(full) else offs[-1]
        block, cuts = places[heads[i] : end].copy(), heads[i:j] - heads[i]
        x, y = np.empty_like(block), np.empty_like(block)
        rows = np.empty((k, j - i), U32)
        for c in range(k):
            np.right_shift(block, U32(16), out=y)
            np.bitwise_xor(block, y, out=x)
            np.multiply(x, U32(0x7FEB352D), out=x)
            np.right_shift(x, U32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, U32(0x846CA68B), out=x)
            np.minimum.reduceat(x, cuts, out=rows[c])
            np.add(block, SHIFT, out=block)
        out[full[i:j]] = rows.T
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; bands never share keys but by chance."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    keys = (parts * tk.ORDER[:rows]).sum(2, dtype=np.uint64) + tk.stream(bands, 7)
    return tk.mix(keys)


def bit_planes(signature: np.ndarray) -> np.ndarray:
    """Bits 0 and 1 of every coordinate, packed: documents x (2 * ceil(k / 64)) words, first all of bit 0."""
    n, k = signature.shape
    wide = np.zeros((n, 2, -(-k // 64) * 64), np.uint8)
    wide[:, 0, :k], wide[:, 1, :k] = signature & 1, signature >> 1 & 1
    return np.packbits(wide, axis=2, bitorder="little").reshape(n, -1).view(np.uint64)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs):
            values, cuts = tk.shingle_sets(part, part_offs)
            n = np.diff(cuts)
            keys = band_keys(signatures(values, cuts, bands * rows), bands, rows)
            sums = []
            for salt in (11, 13):
                v = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(values + np.uint64(salt)))))
                sums.append((v[cuts[1:]] - v[cuts[:-1]]).view(np.int64))
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), *map(pa.array, sums), tk.longs(keys.ravel(), np.arange(b - a + 1) * bands)],
                ["doc_id", "mark", "n_shingles", "f1", "f2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs):
            yield pa.record_batch([batch.column(0).slice(a, b - a), tk.longs(*tk.shingle_sets(part, part_offs))], ["rep", "shingles"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = batch.column(1)
        values, cuts = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
        planes = bit_planes(signatures(values, cuts, FINE))
        yield pa.record_batch([batch.column(0), tk.longs(planes.ravel(), np.arange(len(planes) + 1) * planes.shape[1])], ["rep", "planes"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose whole shingle sets have 100 * intersection >= 75 * union."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.where(100 * F.col("common") >= 75 * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def _grouped(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, group (null for rows in none), component_id of each row; see ``near_duplicates``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_mark(F.col("text")).alias("mark"))
    signed = written(mapped(slim, lambda it: _sign(it, bands, rows), "doc_id long, mark long, n_shingles long, f1 long, f2 long, bands array<long>"), "minhash-signed")
    linkable = signed.where("n_shingles > 0 and doc_id is not null").withColumn("rep", F.xxhash64("f1", "f2", "n_shingles"))
    # a class: equal sets, which have the same bands; its first row stands for it
    classes = written(linkable.groupBy("rep").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands")), "minhash-classes")

    rows_ = classes.select("rep", "n", F.explode("bands").alias("band"))
    crowd = rows_.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    shared = written(rows_.join(crowd, "band"), "minhash-shared")
    score = shared.groupBy("rep").agg(F.sum("c").alias("score"))
    best = shared.join(score, "rep").groupBy("band").agg(F.max(F.struct("score", "rep", "n")).alias("best"))
    heads = written(best.select("band", F.col("best.rep").alias("head"), F.col("best.n").alias("m")), "minhash-heads")

    ids = written(classes.join(shared.select("rep").distinct(), "rep").select("rep", "first.*"), "minhash-ids")
    wanted = slim.join(small(ids, MAX_BROADCAST_IDS), ["doc_id", "mark"]).select("rep", "text")
    sets = written(mapped(wanted, _sets, "rep long, shingles array<long>"), "minhash-sets")
    if sets.count() > ids.count():  # rows that are there more than once
        several, sets = sets, written(sets.dropDuplicates(["rep"]), "minhash-sets")
        discarded(several)

    star = shared.join(heads, "band").where("rep <> head and 100 * least(n, m) >= 75 * greatest(n, m)")
    star = star.select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct()
    first = written(verified(star, sets), "minhash-links")
    group = components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")), "minhash-components")

    placed = shared.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    placed = placed.join(mixed, "band").join(heads.select("band", "head"), "band").where("rep <> head").drop("c")
    placed = written(placed, "minhash-mixed")
    fine = written(mapped(sets.join(placed.select("rep").distinct(), "rep", "left_semi"), _fine, "rep long, planes array<long>"), "minhash-fine")
    discarded(shared, heads)
    words = FINE // 64
    own = placed.groupBy("rep").agg(F.collect_list("band").alias("bands"))  # at most one for each band of the signature
    placed = placed.join(fine.join(own, "rep").select("rep", "bands", *(F.col("planes")[i].alias(f"p{i}_") for i in range(2 * words))), "rep")
    sides = [placed.select("band", *(F.col(c).alias(c + s) for c in ("rep", "n", "component", "bands")), *(F.col(f"p{i}_").alias(f"p{i}_{s}") for i in range(2 * words))) for s in ("1", "2")]
    left, right = sides[0].withColumnRenamed("band", "band1"), sides[1]
    apart = " + ".join(f"bit_count((p{i}_1 ^ p{i}_2) | (p{i + words}_1 ^ p{i + words}_2))" for i in range(words))
    near = F.expr(f"component1 < component2 and 100 * least(n1, n2) >= 75 * greatest(n1, n2) and {apart} <= {int(FINE * (1 - LEAST_AGREEMENT))}")
    once = F.array_min(F.array_intersect("bands1", "bands2")) == F.col("band")  # in the first of the shared buckets
    rest = left.join(right, (F.col("band1") == F.col("band")) & near & once)
    rest = rest.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()
    second = written(verified(rest, sets), "minhash-links")
    discarded(fine, sets)
    if not second.isEmpty():
        before, group = group, components(first.unionByName(second).select(F.col("a").alias("src"), F.col("b").alias("dst")), "minhash-components")
        discarded(before)

    named = group.join(classes.select(F.col("rep").alias("id"), "first.doc_id"), "id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("id").alias("rep"), "component", "component_id")
    of_class = written(classes.select("rep", F.col("first.doc_id").alias("first_id")).join(named, "rep", "left").select("rep", F.coalesce("component", "rep").alias("group"), F.coalesce("component_id", "first_id").alias("component_id")), "minhash-named")
    out = signed.withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("f1", "f2", "n_shingles"))).drop("bands", "f1", "f2")
    return out.join(of_class, "rep", "left").select("doc_id", "mark", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.75 or more of their 5-word shingle sets.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_shingles, component_id
    (smallest doc_id reachable), kept (doc_id = component_id), one row per input row.

    Documents with equal sets form one class and are compared once. In each bucket every class is compared
    with the bucket's hub, the class that shares most buckets; what these links leave apart is compared across
    components if longer signatures agree enough, so a bucket of like texts costs one comparison per text and
    texts that merely share a passage cost a few word operations. Null and empty texts, and
    rows with a null doc_id, are linked with nothing (their component is their own doc_id). Rows that share a doc_id
    are taken one by one, each by its own text, and are no link between their texts. A link is missed with the
    probability of sharing no band, about 2e-5 at similarity 0.75 and less above.
    """
    out = _grouped(docs, bands, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id, with all its columns.

    Of rows that share the smallest doc_id that with the least hash of its text stays, of equal rows any one. Rows
    without words or without doc_id are in no group and stay.
    """
    marked = docs.withColumn("__text_mark", text_mark(F.col("text")))
    found = _grouped(docs, BANDS, ROWS)
    grouped = found.where("group is not null")
    first = written(grouped.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("f")).select("f.*"), "minhash-first")
    again = grouped.where("doc_id = component_id").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__text_mark") == F.col("__mark"))
    one = marked.where(~alone).join(small(first.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), MAX_BROADCAST_IDS), same, "left_semi")
    again = written(again.join(first.select("doc_id", "mark"), ["doc_id", "mark"], "left_semi").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")), "minhash-again")
    if not again.isEmpty():
        one = one.join(again, same, "left_anti").unionByName(one.join(again, same, "left_semi").dropDuplicates(["doc_id", "__text_mark"]))
    return one.unionByName(marked.where(alone)).select(*docs.columns)
