"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel as tk
from latticework.llm.shared import mapped, written

#: Training takes at most so many labelled documents of each class, those with the smallest hashed ids.
MAX_TRAIN = 2500
#: A word is the bag of its whole form and its character n-grams, edges marked, in 2^BITS rows of the embedding.
GRAMS, BITS, DIM = (3, 4, 5, 6), 19, 8
BUCKETS = 1 << BITS
#: Words of a bag that the softmax sees at once. A document's logit is the log mean exponential of its bags', in training of
#: growing sharpness, in scoring their largest.
BAG, SHARP, SHARPER = 2, 0.25, 1.2
EPOCHS, SEED, START = 60, 3, 0.001
RATE, DECAY = 1.0, 1e-5
#: Words whose subwords are found at a time.
CHUNK = 20_000
#: Distinct words whose scores a task keeps.
CACHE = 1 << 20


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word's subwords, and offsets: hashes of its n-grams of characters with edge marks, and of itself."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = ends - starts + 2
    head = np.concatenate(([0], np.cumsum(size)))
    total = int(head[-1])
    text = np.zeros(total, np.uint8)
    inner = np.arange(total) - np.repeat(head[:-1], size)
    edge = (inner == 0) | (inner == np.repeat(size, size) - 1)
    text[~edge] = data[np.repeat(starts - head[:-1] - 1, size)[~edge] + np.arange(total)[~edge]]
    text[head[:-1]], text[head[1:] - 1] = 2, 3
    char = np.flatnonzero((text & 0xC0) != 0x80)  # first bytes of characters; a mark is one
    owner = np.searchsorted(head, char, "right") - 1
    last = np.searchsorted(char, head[1:])  # the words' ends among the characters
    char = np.append(char, total)
    ranged = tk.ranges(text)
    keys, owners = [ranged(head[:-1] + 1, head[1:] - 1)], [np.arange(n)]
    for k in GRAMS:
        at = np.flatnonzero(np.arange(len(owner)) + k <= last[owner])
        keys.append(ranged(char[at], char[at + k]))
        owners.append(owner[at])
    key, who = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return (key[order] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(who, minlength=n))))


def distinct_words(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(hashes, return_index=True, return_inverse=True)


def bags(word_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all bags of BAG words, and each document's offset into the bags."""
    n = np.diff(word_offs)
    made = -(-n // BAG)
    cuts = np.concatenate(([0], np.cumsum(made)))
    return np.repeat(word_offs[:-1] - BAG * cuts[:-1], made) + BAG * np.arange(cuts[-1]), cuts


class Texts:
    """Labelled texts in numbers: distinct words' subword rows (rows, cuts), words in order (word), bags' first words (head), documents' first bags (first_bag)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, labels: np.ndarray):
        parts = []
        for a, b, part, part_offs in tk.slices(data, offs):
            starts, ends, word_offs = tk.words(part, part_offs)
            parts.append(((starts + offs[a]).astype(np.int32), (ends - starts).astype(np.int32), np.diff(word_offs), tk.word_hashes(part, starts, ends)))
        starts, lengths, counts, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        _, first, word = distinct_words(hashes)
        self.word, self.words = word.astype(np.int32), len(first)
        starts, lengths = starts[first].astype(np.int64), lengths[first].astype(np.int64)
        del hashes, word, first
        grams = []
        for a in range(0, self.words, CHUNK):
            rows, cuts = word_grams(data, starts[a : a + CHUNK], starts[a : a + CHUNK] + lengths[a : a + CHUNK])
            grams.append((rows.astype(np.int32), np.diff(cuts).astype(np.int32)))
        self.rows, self.size = (np.concatenate(x) for x in zip(*grams, strict=True)) if grams else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        del grams
        self.cuts = np.concatenate(([0], np.cumsum(self.size)))
        self.head, first_bag = bags(np.concatenate(([0], np.cumsum(counts))))
        self.length = np.diff(np.append(self.head, len(self.word)))
        full = np.diff(first_bag) > 0
        self.y, self.first_bag = labels[full].astype(np.float64), first_bag[:-1][full]
        self.many = np.diff(np.append(self.first_bag, len(self.head)))
        self.weight = np.where(self.y > 0, 0.5 / max(1, self.y.sum()), 0.5 / max(1, (1 - self.y).sum()))

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of distinct words whose subwords are worked on together."""
        for a in range(0, self.words, 4 * CHUNK):
            yield a, min(a + 4 * CHUNK, self.words)


class Model:
    """Embeddings E (BUCKETS x DIM) and softmax weights W (DIM x 2), b (2).

    A bag's vector is the mean of its words' vectors, a word's the mean of its subwords'; softmax(vector W + b) gives the
    classes. Of a document's bags the log mean exponential counts, log(mean(exp(sharp z))) / sharp of their logits z, which
    goes from their mean to the worst bag's as it gets sharper.
    """

    def __init__(self, buckets: int = BUCKETS) -> None:
        rng = np.random.default_rng(SEED)
        self.e = rng.normal(0, START, (buckets, DIM)).astype(np.float32)
        self.w, self.b = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)

    def subword_logits(self) -> np.ndarray:
        """What each row of the embedding adds to the logit of class 1 over class 0."""
        return self.e @ (self.w[:, 1] - self.w[:, 0]).astype(self.e.dtype)

    def logits(self, t: Texts, sharp: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the documents, and the share of each bag in its document's gradient."""
        c, s = self.subword_logits(), np.empty(t.words)
        for a, b in t.blocks():
            rows = slice(t.cuts[a], t.cuts[b])
            s[a:b] = np.add.reduceat(c[t.rows[rows]], t.cuts[a:b] - t.cuts[a]) / t.size[a:b]
        z = np.add.reduceat(s[t.word], t.head) / t.length + self.b[1] - self.b[0]
        top = np.maximum.reduceat(z, t.first_bag)
        share = np.exp(np.maximum(sharp * (z - np.repeat(top, t.many)), -50))
        whole = np.add.reduceat(share, t.first_bag)
        return top + np.log(whole / t.many) / sharp, share / np.repeat(whole, t.many)

    def loss(self, t: Texts, sharp: float) -> float:
        """Weighted cross entropy; classes weigh the same."""
        z, _ = self.logits(t, sharp)
        return float((t.weight * np.logaddexp(0, np.where(t.y > 0, -z, z))).sum())

    def gradients(self, t: Texts, sharp: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact ones of ``loss``: of the embedding rows in use (their numbers, their gradients), of w and of b."""
        z, share = self.logits(t, sharp)
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - t.y) * t.weight
        g_bag = np.repeat(g, t.many) * share / t.length
        g_word = np.bincount(t.word, np.repeat(g_bag, t.length), minlength=t.words)
        g_row = np.zeros(len(self.e))
        for a, b in t.blocks():
            g_row += np.bincount(t.rows[t.cuts[a] : t.cuts[b]], np.repeat(g_word[a:b] / t.size[a:b], t.size[a:b]), minlength=len(self.e))
        live = np.flatnonzero(g_row)
        d = self.w[:, 1] - self.w[:, 0]  # rows act through their share of class 1's logit over class 0's alone
        return live, g_row[live, None] * d, np.outer(self.e[live].T.astype(np.float64) @ g_row[live], [-1.0, 1.0]), g.sum() * np.array([-1.0, 1.0])

    def train(self, data: np.ndarray, offs: np.ndarray, labels: np.ndarray) -> None:
        """Steps along the gradients of all weights together, each weight's by the root of its squares' sum."""
        t = Texts(data, offs, labels)
        if not len(t.word):
            return
        seen_e, seen_w, seen_b = np.full(self.e.shape, 1e-8, np.float32), np.full(self.w.shape, 1e-8), np.full(2, 1e-8)
        for epoch in range(EPOCHS):
            live, g_e, g_w, g_b = self.gradients(t, SHARP * SHARPER**epoch)
            for at in range(0, len(live), 4 * CHUNK):
                row, g = live[at : at + 4 * CHUNK], g_e[at : at + 4 * CHUNK].astype(np.float32)
                seen_e[row] += g**2
                self.e[row] -= np.float32(RATE / np.sqrt(DIM)) * g / np.sqrt(seen_e[row]) + np.float32(DECAY) * self.e[row]
            del g_e
            seen_w += g_w**2
            self.w -= 0.1 * RATE * g_w / np.sqrt(seen_w)
            seen_b += g_b**2
            self.b -= RATE * g_b / np.sqrt(seen_b)


class Scorer:
    """Scores of texts from the subwords' logits; remembers the words it has met."""

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kinds, first, word = distinct_words(tk.word_hashes(data, starts, ends))
        at = np.searchsorted(self.known, kinds)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == kinds[hit]
        out = np.zeros(len(kinds))
        out[hit] = self.values[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            rows, cuts = word_grams(data, starts[first[new]], ends[first[new]])
            out[new] = np.add.reduceat(self.logits[rows], cuts[:-1]) / np.diff(cuts)
            if len(self.known) + len(new) > CACHE:
                self.known, self.values = kinds, out
            else:
                both = np.concatenate([self.known, kinds[new]])
                order = np.argsort(both, kind="stable")
                self.known, self.values = both[order], np.concatenate([self.values, out[new]])[order]
        return out[word]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        data = tk.LOWER[data]
        starts, ends, word_offs = tk.words(data, offs)
        out = np.full(len(offs) - 1, self.bias)
        if len(starts):
            head, cuts = bags(word_offs)
            z = np.add.reduceat(self.words(data, starts, ends), head) / np.diff(np.append(head, len(starts))) + self.bias
            full = np.diff(cuts) > 0
            out[full] = np.maximum.reduceat(z, cuts[:-1][full])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def sample(docs: DataFrame, labelled: DataFrame, most: int) -> tuple[list, list]:
    """Texts and labels of at most ``most`` labelled documents of each class, by hashed id."""
    marked = labelled.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    picked = [marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    ids = written(picked[0].unionByName(picked[1]), "toxicity-sample")  # at most 2 * most rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return rows["text"], rows["label"].to_numpy()


def toxicity_scores(docs: DataFrame, labelled: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document, one row per input row.

    ``labelled`` has doc_id and label; at most ``most`` documents of each class are learnt from. Words are A-Z-lowered.
    Null and empty texts get the score of no words. Without labels of both classes scores are near 0.5. Repeated rows
    are scored each; rows of ``labelled`` without doc_id or label are ignored.
    """
    texts, labels = sample(docs, labelled, most)
    model = Model()
    if len(labels):
        data, offs = tk.buffers(texts)
        model.train(tk.LOWER[data], offs, labels)
    logits, bias = model.subword_logits().astype(np.float32), float(model.b[1] - model.b[0])
    shared = docs.sparkSession.sparkContext.broadcast(logits)  # BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, bias)
        for batch in batches:
            data, offs = tk.buffers(batch.column(1))
            for a, b, part, part_offs in tk.slices(data, offs):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(scorer.scores(part, part_offs))], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(slim, score, "doc_id long, score double")
