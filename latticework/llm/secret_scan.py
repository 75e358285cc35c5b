"""Secret scans: all rules in one byte pass of a combined automaton, over many pieces of text at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import textkernel as tk
from latticework.llm.automaton import Automaton, compiled, either_case
from latticework.llm.shared import mapped

# The rules. A match of ``loose`` is consumed, and counts if ``strict`` ends where it does.
_KEY = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_SET = _KEY + r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"


@dataclass(frozen=True)
class Rule:
    kind: str
    loose: str
    strict: str
    #: what a match that counts begins with, if that is not ``loose``; matches of a run that are shorter are runs by themselves
    start: str = ""


RULES = (
    Rule("assign", _SET + _VALUE + "+", _SET + _VALUE + "{12,}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{16,}", "[0-9a-f]{16}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
#: Texts are cut into pieces of about so many bytes, which step through the automaton together; longer ones go alone.
PIECE, ALONE, LANES = 512, 1 << 14, 8 << 20


@dataclass(frozen=True)
class Scanner:
    """starts: all rules, read from the end, accepts where matches start. ends: all rules from their starts, loose and strict."""

    starts: Automaton
    #: state after a pair of byte classes if it is the same from every state, else -1
    after: np.ndarray
    loose: Automaton
    strict: Automaton


@lru_cache
def scanner() -> Scanner:
    starts = compiled([r.start or r.loose for r in RULES], search=True, backward=True)
    t = starts.table
    after = np.full((t.shape[1], t.shape[1]), -1, np.int64)
    for c in range(t.shape[1]):  # by the first class, as the cube of all states and pairs is large
        pairs = t[t[:, c]]
        after[c] = np.where((pairs == pairs[:1]).all(0), pairs[0], -1)
    after[after >= starts.first_accept] = -1
    return Scanner(starts, after, *(compiled([getattr(r, k) for r in RULES], search=False) for k in ("loose", "strict")))


@lru_cache
def tables() -> tuple:
    """Each automaton's rows over bytes as lists, and its marks, for the places that matches are at."""
    s = scanner()
    return tuple((a.table[:, a.classes].tolist(), a.accepts.tolist(), a.dead) for a in (s.starts, s.loose, s.strict))


def hits(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """Pieces in which a match of any rule starts, in texts read from the end: first and end byte, and the state at its first.

    A piece ends with its document or where the last two bytes alone decide the state, which is the next piece's first.
    """
    s = scanner().starts
    n = len(data)
    if not n:
        return []
    cls = s.classes[data]
    begin = offs[:-1][np.diff(offs) > 0]
    state_at = np.full(n, -1, np.int16)
    if n > 2:
        state_at[2:] = scanner().after.astype(np.int16)[cls[:-2], cls[1:-1]]
    first = begin[begin + 1 < n] + 1  # a pair must not reach over the document's start
    state_at[first] = -1
    can = np.flatnonzero(state_at >= 0)
    bucket = can // PIECE
    can = can[np.concatenate(([True], bucket[1:] != bucket[:-1]))] if len(can) else can
    state_at[begin] = 0
    cuts = np.union1d(begin, can)
    ends = np.append(cuts[1:], n)
    found = [(a, b) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True) if b - a > ALONE]
    short = np.flatnonzero(ends - cuts <= ALONE)
    if len(short):
        order = short[np.argsort((cuts - ends)[short], kind="stable")]
        at, length = cuts[order], (ends - cuts)[order]
        width = s.table.shape[1]
        flat = (s.table * width).ravel()  # rows of the next state, ready to add a column
        state = state_at[at].astype(np.int32) * width
        seen = np.zeros_like(state)
        live = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        for m in live.tolist():
            here = state[:m]
            here += cls[at[:m]]
            np.take(flat, here, out=here, mode="clip")
            np.maximum(seen[:m], here, out=seen[:m])
            at[:m] += 1
        found += [(int(cuts[k]), int(ends[k])) for k in order[seen >= s.first_accept * width].tolist()]
    return sorted((a, b, int(state_at[a])) for a, b in found)


def document_spans(data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of each document that has any, as (start, kind, end) in code points, sorted.

    Matches are leftmost, longest and do not overlap within a kind. One pass over the texts, from their ends, gives every
    place where a match of a rule starts; from the first of these that is behind the last match all rules' automaton walks
    over the match. So time grows with the texts' length.
    """
    (rows, marks, _), loose, strict = tables()
    whole = len(data)
    starts: dict[int, list[tuple[int, int]]] = {}
    backward, edges = data[::-1], whole - offs[::-1]
    for a, b, state in hits(backward, edges):
        row = len(offs) - 1 - int(np.searchsorted(edges, a, "right"))
        for j, byte in enumerate(backward[a:b].tobytes(), a):
            state = rows[state][byte]
            if marks[state]:
                starts.setdefault(row, []).append((whole - 1 - j, marks[state]))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for row, places in starts.items():
        low, high = int(offs[row]), int(offs[row + 1])
        text, done, found = data[low:high].tobytes(), [low] * len(RULES), []
        for at, rules in sorted(places):
            for k in range(len(RULES)):
                if rules >> k & 1 and at >= done[k]:
                    done[k] = low + longest(loose, text, at - low, 1 << k)
                    if low + longest(strict, text, at - low, 1 << k) == done[k]:
                        found.append((at - low, k, done[k] - low))
        if found:
            points = np.concatenate(([0], np.cumsum((data[low:high] & 0xC0) != 0x80)))
            out[row] = sorted((int(points[i]), k, int(points[j])) for i, k, j in found)
    return out


def longest(automaton: tuple, text: bytes, i: int, rule: int) -> int:
    """End of the rule's longest match that begins at i, or -1."""
    rows, marks, dead = automaton
    state, end = 0, -1
    for j in range(i, len(text)):
        state = rows[state][text[j]]
        if state == dead:
            break
        if marks[state] & rule:
            end = j + 1
    return end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        data, offs = tk.buffers(batch.column(1))
        for a, b, part, part_offs in tk.slices(data, offs, LANES):
            found = document_spans(part, part_offs)
            spans = [[{"kind": RULES[k].kind, "start": i, "end": j} for i, k, j in found.get(r, ())] for r in range(b - a)]
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(spans, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """All secrets in every whole text: doc_id, spans array<struct<kind, start, end>>, one row per input row.

    Offsets are code points, end exclusive; spans are sorted by start, then in the order of RULES. Null and empty
    texts have none. Columns other than doc_id and text are ignored; repeated and null doc_ids are scanned like any.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(slim, _scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans' SHA-256 and all spans as text."""
    kinds = [r.kind for r in RULES[:BASE]]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")

    def of(*wanted: str):
        return F.filter("spans", lambda s: s.getField("kind").isin(*wanted))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(joined(of(*kinds)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
