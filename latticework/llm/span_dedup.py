"""Substring dedup: hashes of runs of consecutive sentences, joined globally; all but a run's first place are removed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel as tk
from latticework.llm.shared import mapped, written

#: A longer sentence counts as several of at most so many words.
MAX_SENTENCE = 24
#: A run has two sentences or more, and the fewest that hold so many words.
MIN_WORDS = 25
#: Passages of so many words are found wherever they begin (``remove_passages``), by their least hash of GRAM words.
PASSAGE, GRAM = 51, 16
INVERSE = np.array([pow(int(tk.BASE), -1, 1 << 64)], np.uint64)
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True


def sentences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all sentences, and each document's offset into them.

    A sentence ends with a word that ends in . ! or ?, before a line break, with the text, or after MAX_SENTENCE words.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(word_offs), np.int64)
    new = np.zeros(n, bool)
    breaks = np.cumsum(data == 10)
    new[1:] = STOPS[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1] - 1])
    heads = word_offs[:-1][np.diff(word_offs) > 0]
    new[heads] = True
    first = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    first = np.flatnonzero(place % MAX_SENTENCE == 0)
    return first, np.searchsorted(first, word_offs)


def runs(words_before: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(first, last) sentence of the shortest runs that begin with each sentence and of those that end with each.

    words_before: words ahead of each sentence, and in all. cuts: the documents' offsets into the sentences.
    A repeated passage of MIN_WORDS words or more and two sentences is covered by its runs entirely.
    """
    n = len(words_before) - 1
    i = np.arange(n)
    low, high = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
    last = np.maximum(np.searchsorted(words_before, words_before[:-1] + MIN_WORDS, "left") - 1, i + 1)
    begin = np.minimum(np.searchsorted(words_before, words_before[1:] - MIN_WORDS, "right") - 1, i - 1)
    forward, backward = np.stack([i, last], 1)[last < high], np.stack([begin, i], 1)[begin >= low]
    both = np.concatenate([forward, backward])
    code = np.unique(both[:, 0] * (n + 1) + both[:, 1])
    return np.stack([code // (n + 1), code % (n + 1)], 1)


def _layout(part: np.ndarray, part_offs: np.ndarray):
    starts, ends, word_offs = tk.words(part, part_offs)
    first, cuts = sentences(part, starts, ends, word_offs)
    return starts, ends, first, cuts


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs):
            starts, ends, first, cuts = _layout(part, part_offs)
            before = np.append(first, len(starts))
            span = runs(before, cuts)
            if not len(span):
                continue
            hashes = tk.word_hashes(part, starts, ends)
            low, high = before[span[:, 0]], before[span[:, 1] + 1]
            size = high - low
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            powers = np.full(int(size.max()), tk.BASE)
            powers[0] = 1
            powers = np.cumprod(powers)
            key = tk.mix(np.add.reduceat(hashes[np.repeat(low, size) + place] * powers[place], at) + size.astype(np.uint64))
            row = np.searchsorted(cuts, span[:, 0], "right") - 1
            mark = np.array([zlib.crc32(part[x:y]) for x, y in zip(part_offs[:-1].tolist(), part_offs[1:].tolist(), strict=True)], np.int64)
            ids = batch.column(0).slice(a, b - a).take(pa.array(row))
            yield pa.record_batch([pa.array(key.view(np.int64)), ids, pa.array(mark[row]), pa.array((span[:, 0] - cuts[row]).astype(np.int32)), pa.array((span[:, 1] - cuts[row]).astype(np.int32))], ["key", "doc_id", "mark", "i", "j"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and spans (first << 32 | last sentence) to the text without these sentences, and counts."""
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans").to_pylist()
        data, offs = tk.buffers(texts)
        out, counts, gone, words_gone = [], [], [], []
        for a, _, part, part_offs in tk.slices(data, offs):
            starts, _, first, cuts = _layout(part, part_offs)
            before = np.append(first, len(starts))
            for r in range(len(part_offs) - 1):
                low, high = int(cuts[r]), int(cuts[r + 1])
                counts.append(high - low)
                text = part[part_offs[r] : part_offs[r + 1]]
                remove = np.zeros(high - low, bool)
                for s in spans[a + r] or ():
                    remove[s >> 32 : (s & 0xFFFFFFFF) + 1] = True
                gone.append(np.flatnonzero(remove).tolist())
                words_gone.append(int((before[low + 1 : high + 1] - before[low:high])[remove].sum()))
                if not remove.any():
                    out.append(text.tobytes().decode())
                    continue
                edges = np.append(starts[first[low:high]], part_offs[r + 1]) - part_offs[r]
                edges[0] = 0
                raw = text.tobytes()
                out.append(b"".join(raw[x:y] for x, y, g in zip(edges[:-1].tolist(), edges[1:].tolist(), remove.tolist(), strict=True) if not g).decode())
        columns = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "spans")}
        columns |= {"text": pa.array(out, pa.string()), "n_sentences": pa.array(counts, pa.int64()), "removed": pa.array(gone, pa.list_(pa.int32())), "n_removed_words": pa.array(words_gone, pa.int64())}
        yield pa.RecordBatch.from_pydict(columns)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Every non-first place of a run of sentences that occurs more than once in all texts.

    Returns doc_id, mark (crc32 of the text), i, j (first and last sentence), first_doc. A run is the same words in
    the same order; its first place has the smallest doc_id, then the smallest sentence. Rows without doc_id take no part.
    """
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(mapped(slim, _runs, "key long, doc_id long, mark long, i int, j int"), "spans-runs")
    first = found.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").select("key", "first_doc")
    first = written(first, "spans-first")
    many = written(found.join(first, "key"), "spans-repeated")
    at = many.where("doc_id = first_doc").groupBy("key").agg(F.min(F.struct("i", "mark")).alias("p")).select("key", F.col("p.i").alias("first_i"), F.col("p.mark").alias("first_mark"))
    again = many.join(written(at, "spans-places"), "key").where("doc_id <> first_doc or i <> first_i or mark <> first_mark")
    return again.select("doc_id", "mark", "i", "j", "first_doc")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the sentences that a non-first place of a repeated run covers.

    Returns doc_id, text, n_sentences, removed (numbers of the removed sentences), n_removed_words, first_docs (where
    their first places are), one row per input row. Kept sentences stay as they are, white space before the next
    one included; a text without repeats is unchanged. Null and empty texts have no sentences (null becomes empty).
    Rows that share a doc_id and text count as one place and keep it.
    """
    again = repeated_spans(docs).groupBy("doc_id", "mark").agg(
        F.collect_set(F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("j").cast("long"))).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")
    )
    again = written(again, "spans-removed")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("mark", F.crc32(F.encode("text", "utf-8")))
    out = mapped(slim.join(again, ["doc_id", "mark"], "left").select("doc_id", "text", "spans", F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs")),
                 _cut, "doc_id long, first_docs array<long>, text string, n_sentences long, removed array<int>, n_removed_words long")
    return out.select("doc_id", "text", "n_sentences", "removed", "n_removed_words", "first_docs")


def _powers(base: np.ndarray, n: int) -> np.ndarray:
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


def _ranges(hashes: np.ndarray):
    """A function that hashes the words from low up to high, for arrays of both."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(tk.BASE, len(hashes))[:-1])))
    back = _powers(INVERSE, len(hashes))
    return lambda low, high: tk.mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))


def _least(x: np.ndarray, n: int, of=np.minimum) -> np.ndarray:
    """Of every n consecutive values."""
    size = 1
    while 2 * size <= n:
        x, size = of(x[:-size], x[size:]), 2 * size
    return of(x[: len(x) - (n - size)], x[n - size :])


def _marks(part: np.ndarray, part_offs: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(part[x:y]) for x, y in zip(part_offs[:-1].tolist(), part_offs[1:].tolist(), strict=True)], np.int64)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words whose windows of PASSAGE words have the same least hash of GRAM words.

    Equal windows have equal least hashes. many: whether the stretch holds that hash more than once.
    """
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs):
            starts, ends, word_offs = tk.words(part, part_offs)
            if len(starts) < PASSAGE:
                continue
            ranged = _ranges(tk.word_hashes(part, starts, ends))
            at = np.arange(len(starts) - GRAM + 1)
            gram = ranged(at, at + GRAM)
            least = _least(gram, PASSAGE - GRAM + 1)
            row = np.searchsorted(word_offs, np.arange(len(least)), "right") - 1
            whole = np.arange(len(least)) + PASSAGE <= word_offs[row + 1]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
            head = np.flatnonzero(new & whole)
            if not len(head):
                continue
            stop = np.append(np.flatnonzero(new | ~whole), len(least))
            last = stop[np.searchsorted(stop, head, "right")] - 1
            low, high, key = head, last + PASSAGE, least[head]
            grams = high - low - GRAM + 1
            first = np.concatenate(([0], np.cumsum(grams)[:-1]))
            inside = np.repeat(low - first, grams) + np.arange(int(grams.sum()))
            many = np.add.reduceat((gram[inside] == np.repeat(key, grams)).astype(np.int64), first) > 1
            row = row[head]
            ids = batch.column(0).slice(a, b - a).take(pa.array(row))
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(ranged(low, high).view(np.int64)), ids, pa.array(_marks(part, part_offs)[row]), pa.array((low - word_offs[row]).astype(np.int32)), pa.array((high - word_offs[row]).astype(np.int32)), pa.array(many)],
                ["least", "key", "doc_id", "mark", "i", "j", "many"],
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows of PASSAGE words in the stretches (first << 32 | end word) of doc_id, mark, text."""
    for batch in batches:
        spans = batch.column(3).to_pylist()
        data, offs = tk.buffers(batch.column(2))
        for a, b, part, part_offs in tk.slices(data, offs):
            starts, ends, word_offs = tk.words(part, part_offs)
            begin, row = [], []
            for r in range(b - a):
                for x in spans[a + r]:
                    begin.append(np.arange(x >> 32, (x & 0xFFFFFFFF) - PASSAGE + 1))
                    row.append(np.full(len(begin[-1]), r))
            begin, row = np.concatenate(begin), np.concatenate(row)
            low = begin + word_offs[row]
            key = _ranges(tk.word_hashes(part, starts, ends))(low, low + PASSAGE)
            take = pa.array(row)
            yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0).slice(a, b - a).take(take), batch.column(1).slice(a, b - a).take(take), pa.array(begin.astype(np.int32))], ["key", "doc_id", "mark", "i"])


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans (first << 32 | end word), first_docs to the text without these words, and counts."""
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2).to_pylist()
        data, offs = tk.buffers(texts)
        out, counts, gone = [], [], []
        for a, b, part, part_offs in tk.slices(data, offs):
            starts, _, word_offs = tk.words(part, part_offs)
            for r in range(b - a):
                low, high = int(word_offs[r]), int(word_offs[r + 1])
                raw, counts_ = part[part_offs[r] : part_offs[r + 1]].tobytes(), high - low
                remove = np.zeros(counts_ + 2, bool)
                for x in spans[a + r] or ():
                    remove[(x >> 32) + 1 : (x & 0xFFFFFFFF) + 1] = True
                counts.append(counts_)
                gone.append(int(remove.sum()))
                edges = np.concatenate((starts[low:high] - part_offs[r], [len(raw)]))
                if counts_:
                    edges[0] = 0
                turn = np.flatnonzero(remove[1:] != remove[:-1])
                cuts = [0, *edges[turn].tolist(), len(raw)] if counts_ else [0, len(raw)]
                out.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode())
        yield pa.record_batch([batch.column(0), batch.column(3), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "first_docs", "text", "n_words", "n_removed_words"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, mark, i, j, first_doc: words i up to j, which cover every window of PASSAGE words that has an earlier place.

    Stretches that recur whole are found first; windows are compared one by one only in the first places of distinct
    stretches that share their least hash with others. A window's first place is among these.
    """
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(mapped(slim, _stretches, "least long, key long, doc_id long, mark long, i int, j int, many boolean"), "passages-stretches")
    kinds = written(found.groupBy("least", "key").agg(F.min(F.struct("doc_id", "i", "mark", "j")).alias("p"), F.count("*").alias("n"), F.max("many").alias("many")), "passages-kinds")
    firsts = written(kinds.where("n > 1").select("key", "least", F.col("p.doc_id").alias("first_doc"), F.col("p.i").alias("first_i"), F.col("p.mark").alias("first_mark")), "passages-firsts")
    whole = found.join(firsts, ["least", "key"]).where("doc_id <> first_doc or i <> first_i or mark <> first_mark").select("doc_id", "mark", "i", "j", "first_doc")
    shared = written(kinds.groupBy("least").agg(F.count("*").alias("k"), F.max("many").alias("many")).where("k > 1 or many").select("least"), "passages-shared")
    spans = kinds.join(shared, "least").select("p.*").groupBy("doc_id", "mark").agg(F.collect_set(F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("j").cast("long"))).alias("spans"))
    spans = written(spans, "passages-spans")
    texts = slim.withColumn("mark", F.crc32(F.encode("text", "utf-8"))).join(spans, ["doc_id", "mark"]).select("doc_id", "mark", "text", "spans")
    each = written(mapped(texts, _windows, "key long, doc_id long, mark long, i int"), "passages-windows")
    at = each.groupBy("key").agg(F.min(F.struct("doc_id", "i", "mark")).alias("p"), F.count("*").alias("n")).where("n > 1")
    at = written(at.select("key", F.col("p.doc_id").alias("first_doc"), F.col("p.i").alias("first_i"), F.col("p.mark").alias("first_mark")), "passages-places")
    single = each.join(at, "key").where("doc_id <> first_doc or i <> first_i or mark <> first_mark").select("doc_id", "mark", "i", (F.col("i") + PASSAGE).alias("j"), "first_doc")
    return whole.unionByName(single)


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the words of passages of PASSAGE words or more whose same words have an earlier place.

    Passages may begin and end anywhere. Returns doc_id, text, n_words, n_removed_words, first_docs (documents that
    hold an earlier place), one row per input row. Rows without doc_id, and those that share a doc_id and text, are
    taken as in ``remove_repeats``.
    """
    again = repeated_passages(docs).groupBy("doc_id", "mark").agg(
        F.collect_set(F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("j").cast("long"))).alias("spans"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")
    )
    again = written(again, "passages-removed")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("mark", F.crc32(F.encode("text", "utf-8")))
    out = mapped(slim.join(again, ["doc_id", "mark"], "left").select("doc_id", "text", "spans", F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs")),
                 _cut_words, "doc_id long, first_docs array<long>, text string, n_words long, n_removed_words long")
    return out.select("doc_id", "text", "n_words", "n_removed_words", "first_docs")
