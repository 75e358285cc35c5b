"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel as tk
from latticework.llm.shared import mapped, written

#: Cosines, width of the kernel in standard deviations, ridge, seed.
FOURIER, WIDTH, RIDGE, SEED = 128, 3.0, 1e-3, 5
#: Scores are calibrated from counts in so many bins between -0.5 and 1.5; a row's score is of a model fitted without its fold.
BINS, FOLDS = 2000, 4
STATS = (
    "log_words", "word_bytes", "word_spread", "upper", "digits", "symbols", "exclaims", "stops", "commas", "high_bytes",
    "distinct_words", "top_word", "same_next", "repeat_pairs", "dup_lines", "line_words",
)

_KIND = np.zeros((256, 6), bool)
for _i, _set in enumerate((range(65, 91), range(48, 58), b"#*$%&|<>", b"!", b".?", b",;:")):
    _KIND[list(_set), _i] = True


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """documents x STATS; an empty text has zeros."""
    docs = len(offs) - 1
    out = np.zeros((docs, len(STATS)))
    starts, ends, cuts = tk.words(data, offs)
    if not len(starts):
        return out
    n = np.diff(cuts)
    some = np.maximum(n, 1)
    doc = np.repeat(np.arange(docs), n)

    def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1), np.cumsum(values, dtype=np.float64)))
        return sums[at[1:]] - sums[at[:-1]]

    size = (ends - starts).astype(np.float64)
    mass = np.maximum(per_doc(size, cuts), 1)
    out[:, 0], out[:, 1] = np.log1p(n), mass / some
    out[:, 2] = np.sqrt(np.maximum(per_doc(size**2, cuts) / some - out[:, 1] ** 2, 0))
    for k in range(6):
        out[:, 3 + k] = per_doc(_KIND[data, k], offs) / mass
    out[:, 9] = per_doc(data >= 128, offs) / mass
    hashes = tk.word_hashes(tk.LOWER[data], starts, ends)

    def repeats(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each document, and how often its commonest occurs."""
        keys = keys.copy()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            keys[a:b].sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[at[:-1][at[:-1] < len(keys)]] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(keys)))
        where = np.searchsorted(first, at)
        full = np.diff(where) > 0
        top = np.zeros(len(at) - 1)
        if full.any():
            top[full] = np.maximum.reduceat(count, where[:-1][full])
        return np.diff(where), top

    kinds, top = repeats(hashes, cuts)
    out[:, 10], out[:, 11] = kinds / some, top / some
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    out[:, 12] = per_doc(same, cuts) / some
    pairs = hashes[:-1] * tk.ORDER[0] + hashes[1:] * tk.ORDER[1]
    inside = doc[1:] == doc[:-1]
    pair_cuts = np.searchsorted(doc[1:][inside], np.arange(docs + 1))
    out[:, 13] = 1 - repeats(pairs[inside], pair_cuts)[0] / np.maximum(np.diff(pair_cuts), 1)
    out[:, 13][n < 2] = 0
    breaks = np.concatenate((np.zeros(1, np.int64), np.cumsum(data == 10)))
    line = breaks[starts]
    head = np.ones(len(line), bool)
    head[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(head)
    place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
    powers = np.full(int(place.max()) + 1, tk.BASE)
    powers[0] = 1
    line_keys = np.add.reduceat(hashes * np.cumprod(powers)[place], first)
    line_cuts = np.searchsorted(first, cuts)
    lines = np.maximum(np.diff(line_cuts), 1)
    out[:, 14] = 1 - repeats(line_keys, line_cuts)[0] / lines
    out[:, 14][n == 0] = 0
    out[:, 15] = np.log1p(n / lines)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs):
            x = statistics(part, part_offs)
            yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(x[:, k]) for k in range(len(STATS)))], ["doc_id", *STATS])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every whole text (null: empty)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(slim, _measure, "doc_id long, " + ", ".join(f"{c} double" for c in STATS))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS], 1)


class Model:
    """Cosines of scaled statistics, weights, and the calibrated score at knots."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / WIDTH, (len(STATS), FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / FOURIER) * np.cos(scaled @ self.w + self.b), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit to shares ones / n at the ordered places (pool adjacent violators).

    Places are pooled by their shares; the pools, each with half a one in one count more, are pooled again, so that the
    levels are neither 0 nor 1 and never fall.
    """

    def pooled(blocks: list[list[float]]) -> list[list[float]]:  # weight, ones, first and last place
        out: list[list[float]] = []
        for block in blocks:
            out.append(block)
            while len(out) > 1 and out[-2][1] * out[-1][0] >= out[-1][1] * out[-2][0]:
                c, y, _, last = out.pop()
                out[-1] = [out[-1][0] + c, out[-1][1] + y, out[-1][2], last]
        return out

    blocks = pooled([[c, y, x, x] for x, c, y in zip(at.tolist(), n.tolist(), ones.tolist(), strict=True)])
    blocks = pooled([[c + 1, y + 0.5, low, high] for c, y, low, high in blocks])
    return np.array([k for b in blocks for k in b[2:]]), np.array([b[1] / b[0] for b in blocks for _ in range(2)])


def fit(stats: DataFrame, labelled: DataFrame) -> Model | None:
    """The model of ``labelled`` (doc_id, label 0/1), from the statistics of the same documents; None without labels.

    Means and spreads are of all documents. Each task adds up its normal equations, which Spark sums by entry, so the
    driver holds a small matrix for each fold; calibration counts labels in bins of the scores of models that did not see them.
    """
    moments = stats.agg(*(f(c).alias(f"{g}_{c}") for c in STATS for g, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if moments[0] is None:
        return None
    model = Model(*(np.array([moments[f"{g}_{c}"] or 0.0 for c in STATS]) for g in "ms"))
    size = FOURIER + 1
    upper = np.triu_indices(size)
    width = len(upper[0]) + size
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = written(stats.join(labelled.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("double").alias("label")), "doc_id").select("*", fold), "quality-train")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, cross = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            z, label, of = model.features(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[of == k]
                gram[k] += own.T @ own
                cross[k] += own.T @ label[of == k]
        both = np.concatenate([np.concatenate([gram[k][upper], cross[k]]) for k in range(FOLDS)])
        yield pa.record_batch([pa.array(np.arange(len(both))), pa.array(both)], ["k", "v"])

    rows = mapped(train, sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # FOLDS * width rows
    both = np.zeros(FOLDS * width)
    both[[r.k for r in rows]] = [r.v for r in rows]
    both = both.reshape(FOLDS, width)

    def solved(both: np.ndarray) -> np.ndarray:
        gram = np.zeros((size, size))
        gram[upper] = both[: len(upper[0])]
        gram = np.triu(gram) + np.triu(gram, 1).T
        return np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1.0) / FOURIER * np.eye(size), both[len(upper[0]) :])

    whole = both.sum(0)
    if not whole[len(upper[0]) - 1]:
        return None
    model.weights = solved(whole)
    others = [solved(whole - own) for own in both]  # weights that a fold's rows had no part in

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, of = model.features(_matrix(batch)), batch.column("fold").to_numpy()
            raw = np.einsum("nk,nk->n", z, np.stack(others)[of]) if len(z) else np.zeros(0)
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(np.arange(BINS)), pa.array(np.bincount(at, minlength=BINS)), pa.array(np.bincount(at, label, BINS))], ["k", "n", "ones"])

    counts = mapped(train, binned, "k long, n long, ones double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where("n > 0").orderBy("k").collect()
    at = (np.array([r.k for r in counts]) + 0.5) / BINS * 2 - 0.5
    model.knots, model.levels = isotonic(at, np.array([r.n for r in counts]), np.array([r.ones for r in counts]))
    return model


def quality_scores(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document, one row per input row.

    ``labelled`` has doc_id and label; nothing but statistics of the text enters a score. Null and empty texts are
    scored as texts without words. Without any label all scores are 0.5. Repeated labels count each; rows of
    ``labelled`` without doc_id or label are ignored.
    """
    stats = written(document_statistics(docs), "quality-stats")
    model = fit(stats, labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    return mapped(stats, scored, "doc_id long, score double")
