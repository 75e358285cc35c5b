"""Texts as files of token ids: ids by falling frequency, in one to four bytes each, with the lengths in separate control bytes.

A file set is a folder of three Parquet tables, which Spark commits and any store that Spark writes to can hold:
``ranks`` (rank, id), ``shards`` (shard, base: ids before it), ``segments`` (shard, first: ids before it in the shard,
docs, block). A block is opaque to Spark: b"LWT1", documents (u32), ids (u64), then doc_ids (i64), whether each is there
(u8), their numbers of ids (u32), control bytes and data bytes, little endian. A control byte has the lengths less one of
four ids, the first in its lowest two bits; the data are the ranks' bytes without leading zeros. Documents ascend by doc_id.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.shared import delete_at_exit, discarded, mapped, shared_dir, shuffles_dropped, small, written

MAGIC, HEAD = b"LWT1", "<4sIQ"
#: Ids of a segment; a longer text has a segment of its own.
SEGMENT = 1 << 16
#: Tables of shards and ranks that are broadcast when they have no more rows.
SMALL_ROWS = 100_000
#: A worker remembers the ids of so many words, then starts anew. Results do not depend on it.
REMEMBERED = 600_000

#: By control byte: the four lengths, where each begins, and all four together.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
STARTS = np.cumsum(LENGTHS, 1) - LENGTHS
TOTALS = LENGTHS.sum(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def packed(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit integers; a last control byte with fewer than four ids is filled up with zeros."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros((-(-len(v) // 4), 4), np.uint8)
    four.reshape(-1)[: len(v)] = size - 1
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of ``packed``, by tables of the control bytes."""
    c = np.frombuffer(control, np.uint8)
    at = ((np.cumsum(TOTALS[c]) - TOTALS[c])[:, None] + STARTS[c]).reshape(-1)[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    return (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24) & MASKS[LENGTHS[c].reshape(-1)[:n]]


#: The normal form and the split of word-end BPE files for which ``WordIds`` may take words apart and join them.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: A stem that ends in a letter or digit, and marks behind it, which the split takes apart.
TAIL = "^(?P<stem>.*[a-z0-9ß-öø-ÿ])(?P<tail>[.,;:!?*#$%&]+)$"
#: Words that the normal form leaves as they are and the split leaves whole.
WHOLE = "^[a-zß-öø-ÿ]+$"
#: Words that are encoded together.
JOINED = 200


class WordIds:
    """Ids of texts by a tokenizer that drops white space, word by word: each distinct word is encoded once and remembered.

    Words end at U+0020 and U+0009 to U+000D. That gives the ids of whole texts for a tokenizer whose normal form and split
    never reach over white space, as those of word-end BPE with white space dropped do. Where the file has the normal form
    and split above, fewer words are distinct: A-Z are lowered (not beside ``<``, where special tokens begin), marks behind
    a word are a word, and words of letters alone are encoded many at a time, each ending at its first word-end id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        suffix = kind["model"].get("end_of_word_suffix")
        split = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.parted = bool(suffix) and kind["normalizer"] == NORMAL and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        if self.parted:
            self.whole = Tokenizer.from_file(path)
            self.whole.normalizer = normalizers.Sequence([])
            self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.first, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.flat = np.zeros(1 << 16, np.uint32)

    def found(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words))))

    def learn(self, words: list[str]) -> None:
        """Each by itself."""
        for a in range(0, len(words), 10_000):
            got = self.tokenizer.encode_batch_fast(words[a : a + 10_000], add_special_tokens=False)
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.found(words[a : a + 10_000], np.fromiter((i for e in got for i in e.ids), np.uint32, int(size.sum())), size)

    def learn_whole(self, words: list[str]) -> None:
        """Words of letters alone, many at a time."""
        for a in range(0, len(words), 100 * JOINED):
            some = words[a : a + 100 * JOINED]
            got = self.whole.encode_batch_fast([" ".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self.found(some, ids, np.diff(ends, prepend=0))
            else:
                self.learn(some)

    def slots_of(self, words: pa.Array) -> np.ndarray:
        """Where distinct or repeated words are kept, after the new ones are learned."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        get = self.slots.get
        slot = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new = [distinct[k] for k in missing]
            if self.parted:
                whole = pc.match_substring_regex(pa.array(new), WHOLE).to_numpy(zero_copy_only=False)
                self.learn_whole([new[k] for k in np.flatnonzero(whole)])
                self.learn([new[k] for k in np.flatnonzero(~whole)])
            else:
                self.learn(new)
            slot[missing] = np.fromiter((get(w) for w in new), np.int64, len(new))
        return slot[coded.indices.to_numpy()]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and how many each has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        if len(self.slots) > REMEMBERED:
            self.forget()
        words, pieces = coded.dictionary, []
        if self.parted:
            words = pc.if_else(pc.match_substring(words, "<"), words, pc.ascii_lower(words))
            both = pc.extract_regex(words, TAIL)
            words, pieces = pc.if_else(both.is_valid(), pc.struct_field(both, "stem"), words), [pc.if_else(both.is_valid(), pc.struct_field(both, "tail"), "")]
        slot = np.stack([self.slots_of(x) for x in (words, *pieces)], 1)[coded.indices.to_numpy()].reshape(-1)
        size = self.size[slot]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        edge = np.concatenate([[0], ends])[(1 + len(pieces)) * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        return ids, np.diff(edge)


_held: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """This worker's encoder of a tokenizer file."""
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]


def width(path: str, end: int) -> str:
    """The kind of integer that holds every id of a tokenizer and ``end``."""
    return "<u2" if max(encoder(path).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): each text's ids and ``end``, as integers of ``width``. Null texts count as empty."""
    kind = width(path, end)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for b in batches:
            ids, size = words.encode(b["t"])
            edge = np.cumsum(size)
            ids = np.insert(ids.astype(kind), edge, end)  # an end behind each text
            ends = pa.array(np.concatenate([[0], ids.itemsize * (edge + 1 + np.arange(len(edge)))]), pa.int64())
            raw = pa.Array.from_buffers(pa.large_binary(), len(b), [None, ends.buffers()[1], pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([b["id"], raw.cast(pa.binary())], ["id", "ids"])

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return mapped(rows, go, "id long, ids binary")


def _counted(kind: str):
    """(token, n) of a task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b["ids"].to_pylist()), kind)
            now = np.bincount(ids, minlength=len(n))
            now[: len(n)] += n
            n = now
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n[found], pa.int64())], ["token", "n"])

    return go


def _segments(rank_of: np.ndarray, kind: str):
    """Rows (id, ids) in their order as segments."""
    each = np.dtype(kind).itemsize

    def block(ids: list, raw: list[bytes]) -> bytes:
        values = np.frombuffer(b"".join(raw), kind)
        control, data = packed(rank_of[values])
        there = np.array([i is not None for i in ids], np.uint8)
        numbers = np.array([0 if i is None else i for i in ids], "<i8")
        sizes = np.array([len(r) // each for r in raw], "<u4")
        return struct.pack(HEAD, MAGIC, len(ids), len(values)) + numbers.tobytes() + there.tobytes() + sizes.tobytes() + control + data

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, ids, raw, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([block(ids, raw)], pa.binary())],
                                              ["shard", "first", "ids", "docs", "block"])

        for b in batches:
            for i, r in zip(b["id"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if raw and held + len(r) // each > SEGMENT:
                    yield row()
                    done, ids, raw, held = done + held, [], [], 0
                ids.append(i)
                raw.append(r)
                held += len(r) // each
        if raw:
            yield row()

    return go


@dataclass
class TokenFiles:
    """The tables of a file set."""

    ranks: DataFrame
    shards: DataFrame
    segments: DataFrame

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> TokenFiles:
        """A file set that was written before, or its tables elsewhere."""
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in ("ranks", "shards", "segments")))

    def rows(self) -> DataFrame:
        """(doc_id, start, ids) of every document, from the files: ids before it, and its own as little-endian 32-bit integers.

        The ranks, one for each id of the vocabulary, go to every task.
        """
        ranked = self.ranks.orderBy("rank").toPandas()  # one row for each id that occurs: the tokenizer's vocabulary bounds it
        id_of = np.zeros(int(ranked["rank"].max()) + 1 if len(ranked) else 0, "<u4")
        id_of[ranked["rank"].to_numpy(np.int64)] = ranked["id"].to_numpy()

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, first, block in zip(b["shard"].to_pylist(), b["first"].to_pylist(), b["block"].to_pylist(), strict=True):
                    magic, docs, n = struct.unpack_from(HEAD, block)
                    if magic != MAGIC:
                        raise ValueError("not a block of token ids")
                    at = struct.calcsize(HEAD)
                    numbers = np.frombuffer(block, "<i8", docs, at)
                    there = np.frombuffer(block, np.uint8, docs, at + 8 * docs)
                    sizes = np.frombuffer(block, "<u4", docs, at + 9 * docs).astype(np.int64)
                    at += 13 * docs
                    control = -(-n // 4)
                    ids = id_of[unpacked(block[at : at + control], block[at + control :], n)]
                    edge = np.concatenate([[0], np.cumsum(sizes)])
                    raw = ids.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers, mask=there == 0), pa.array(np.full(docs, shard)), pa.array(first + edge[:-1]), pa.array([raw[4 * a : 4 * b] for a, b in zip(edge, edge[1:])], pa.binary())],
                        ["doc_id", "shard", "within", "ids"])

        rows = mapped(self.segments.select("shard", "first", "block"), go, "doc_id long, shard long, within long, ids binary")
        return rows.join(small(self.shards, SMALL_ROWS), "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "ids")


def write(docs: DataFrame, path: str, folder: str | None = None, end: int = 1, id: str = "doc_id", text: str = "text") -> TokenFiles:
    """Writes the ids of all texts in ascending doc_id order, each text's followed by ``end``, and gives the files' tables.

    ``folder`` must be new and is kept; without one a new folder in the shared folder serves until the driver ends.

    ``path`` names a tokenizer file that is there on every executor (``WordIds`` says of what kind). Null texts are empty and
    have ``end`` alone; null ids come first; rows with the same id stand in the order of a hash of their ids; other columns are
    not read; an empty table gives empty tables. Ids are counted first, then sorted by range, so that no task holds more
    than its share, and written in segments.
    """
    spark, kind = docs.sparkSession, width(path, end)
    if folder is None:
        folder = f"{shared_dir(spark)}/latticework/tokens-{uuid.uuid4().hex}"
        delete_at_exit(spark, folder)

    def put(df: DataFrame, name: str) -> DataFrame:
        with shuffles_dropped(spark):
            df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    rows = written(encoded(docs, path, end, id, text).select("*", F.xxhash64("ids").alias("mark"), F.monotonically_increasing_id().alias("tie")), "token-ids")
    with shuffles_dropped(spark):
        counts = mapped(rows.select("ids"), _counted(kind), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary
    counts = counts.sort_values(["n", "token"], ascending=[False, True])
    order = counts["token"].to_numpy(np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 0, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = put(spark.createDataFrame([(k, int(t)) for k, t in enumerate(order)], "rank long, id long"), "ranks")
    keys = [F.col("id").asc_nulls_first(), "mark", "tie"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "ids")
    segments = put(mapped(placed, _segments(rank_of, kind), "shard long, first long, ids long, docs long, block binary"), "segments")
    discarded(rows)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that wrote
    shards = segments.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return TokenFiles(ranks, put(shards, "shards"), segments)
