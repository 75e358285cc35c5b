"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups' roots, and every row's authentication path.

Hashes are lowercase hex SHA-256 of their inputs one after the other, digests as hex text. A tree joins every ARITY
consecutive nodes (the last run may have fewer, even one) until one is left.

Leaves are placed by one range sort. Trees are worked in aligned blocks of ARITY^HEIGHT nodes, each in one task: a treehash
stack gives a block's root, roots are the nodes of the next table, and so on up. On the way down a block's path comes from
above, and a traversal advances one treehash for each level leaf by leaf, so that it holds two runs of nodes for each level
beside the block's leaves. No task has more than a block at a time, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.shared import discarded, mapped, small, written

ARITY, HEIGHT = 16, 2
#: Tables of task and group that are broadcast when they have no more rows.
SMALL_ROWS = 20_000
#: Rows that go back to Spark at a time.
OUT_ROWS = 1000
DIGEST = 64
_TURNS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32())]))


def field(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels(n: int) -> int:
    """How often a row of n nodes is joined until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


class Treehash:
    """Takes leaves one after the other and holds at most ARITY nodes for each level below ``top``; gathers those of ``top``."""

    def __init__(self, top: int):
        self.top = top
        self.stacks: list[list[str]] = [[] for _ in range(top + 1)]

    def push(self, node: str) -> None:
        level = 0
        self.stacks[0].append(node)
        while level < self.top and len(self.stacks[level]) == ARITY:
            self.stacks[level + 1].append(joined(self.stacks[level]))
            self.stacks[level] = []
            level += 1

    def ended(self) -> list[str]:
        """Nodes of level ``top``; runs that are not full are joined as they are."""
        for level in range(self.top):
            if self.stacks[level]:
                self.stacks[level + 1].append(joined(self.stacks[level]))
                self.stacks[level] = []
        return self.stacks[self.top]


def block_root(nodes: Sequence[str], height: int) -> str:
    tree = Treehash(height)
    for x in nodes:
        tree.push(x)
    return tree.ended()[0]


def traversed(nodes: Sequence[str], height: int) -> Iterator[list[list[str]]]:
    """For leaf after leaf its run of nodes at each level below ``height``, itself or its ancestor included.

    While a level's run serves its leaves, the treehash of that level takes one leaf of the next run at each step, so the
    next run is there when it is needed.
    """
    spans = [ARITY ** (k + 1) for k in range(height)]
    now, coming = [], [Treehash(k) for k in range(height)]
    for k, span in enumerate(spans):
        tree = Treehash(k)
        for x in nodes[:span]:
            tree.push(x)
        now.append(tree.ended())
    for i in range(len(nodes)):
        yield now
        for k, span in enumerate(spans):
            if i + span < len(nodes):
                coming[k].push(nodes[i + span])
            if (i + 1) % span == 0:
                now[k], coming[k] = coming[k].ended(), Treehash(k)


def folded(node: Column, path: Column, turns: Column) -> Column:
    """The root that a leaf and its siblings give: ``path`` has the siblings' digests, ``turns`` how many stand before and after at each level."""

    def up(state: Column, turn: Column) -> Column:
        before, after = turn["before"] * DIGEST, turn["after"] * DIGEST
        joint = F.concat(path.substr(state["at"] + 1, before), state["node"], path.substr(state["at"] + before + 1, after))
        return F.struct(F.sha2(joint, 256).alias("node"), (state["at"] + before + after).alias("at"))

    return F.aggregate(turns, F.struct(node.alias("node"), F.lit(0).alias("at")), up, lambda s: s["node"])


def indexed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes(key, tie, ...)`` with i, the place within the key in the order of ``order`` (nulls first) and tie, and n, the key's rows.

    One range sort; what tasks hold of each key is counted and added up over tasks, so no task has a whole key. tie must be
    stored, not computed: it parts equal rows, so that many of them spread.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("key", *order, "tie")]
    at = written(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    runs = at.groupBy("key", F.shiftright("at", 33).alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("key")  # a row for each task that has some of the key
    before = F.coalesce(F.sum("rows").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select("key", "task", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n")), "merkle-runs")
    placed = at.withColumn("task", F.shiftright("at", 33)).join(small(runs, SMALL_ROWS), ["key", "task"])
    out = written(placed.withColumn("i", F.col("at") + F.col("shift")).drop("task", "at", "shift", "tie"), "merkle-nodes")
    discarded(at, runs)
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "i")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks, one after the other, of batches sorted by key and block."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        key, block = rest["key"].to_numpy(), rest["block"].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield rest.slice(a, b - a)
        rest = rest.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def _lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node for each block: its root."""
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "n", "i", "node"])

    for table in _blocks(batches):
        n = table["n"][0].as_py()
        height = min(HEIGHT, levels(n))
        out.append((table["key"][0].as_py(), -(-n // ARITY**height), table["block"][0].as_py(), block_root(table["node"].to_pylist(), height)))
        if len(out) >= OUT_ROWS:
            yield batch()
            out.clear()
    if out:
        yield batch()


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their paths: a block's first row (i = -1) has what all of its nodes share from above."""
    out: list[pa.Table] = []

    def batch() -> list[pa.RecordBatch]:
        return pa.concat_tables(out).combine_chunks().to_batches()

    for table in _blocks(batches):
        rows = table.slice(1)
        m = len(rows)
        if not m:
            continue
        height = min(HEIGHT, levels(rows["n"][0].as_py()))
        above, turns = table["path"][0].as_py(), table["turns"][0].as_py()
        paths, texts = [], [""] * height
        for i, runs in enumerate(traversed(rows["node"].to_pylist(), height)):
            for k in range(height):
                if i % ARITY**k == 0:
                    at = i // ARITY**k % ARITY
                    texts[k] = "".join(runs[k][:at] + runs[k][at + 1 :])
            paths.append("".join(texts) + above)
        at = np.arange(m)
        before = [at // ARITY**k % ARITY for k in range(height)]
        after = [np.minimum(ARITY, -(-m // ARITY**k) - at // ARITY ** (k + 1) * ARITY) - 1 - before[k] for k in range(height)]
        both = [np.stack([*x, *(np.full(m, t[c]) for t in turns)], 1).astype(np.int32).ravel() if height + len(turns) else np.zeros(0, np.int32) for c, x in (("before", before), ("after", after))]
        ends = pa.array(np.arange(m + 1) * (height + len(turns)), pa.int32())
        steps = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in both], ["before", "after"]))
        for name, column in (("path", pa.array(paths, pa.string())), ("turns", steps.cast(_TURNS)), ("subroot", pa.repeat(table["subroot"][0], m))):
            rows = rows.set_column(rows.column_names.index(name), name, column)
        out.append(rows.drop_columns(["block"]))
        if sum(map(len, out)) >= OUT_ROWS:
            yield from batch()
            out.clear()
    if out:
        yield from batch()


def _climbed(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(key, n, i, node)``, and the tables of block roots above it; the last has one node for each key."""
    block = F.expr(f"i div {ARITY**HEIGHT}").alias("block")
    tables = [nodes]
    while not tables[-1].where("n > 1").isEmpty():
        rows = _dealt(tables[-1].select("key", "n", block, "i", "node"))
        tables.append(written(mapped(rows, _lifted, "key string, n long, i long, node string"), "merkle-roots"))
    return tables


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with path, turns and subroot. ``above(key, i, path, turns, subroot)``: those of the block i."""
    block = F.expr(f"i div {ARITY**HEIGHT}").alias("block")
    rows = nodes.select("*", block).unionByName(above.select("key", F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), "path", "turns", "subroot"), allowMissingColumns=True)
    rows = _dealt(rows)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop("block").dtypes)
    return mapped(rows, _descended, kinds)


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` with its leaf, its group's subroot, the root of all, and its authentication path.

    A leaf is the hash of ``columns``, each ``-`` if null, else byte count, colon and value. Leaves of a group stand in the
    order of ``order``, nulls first, equal ones by leaf; groups in the byte order of their names, the null group first.
    Returns order, group, the columns ``keep``, leaf, subroot, root, path (siblings' digests from the leaf's run up to the
    root's, left to right), turns (siblings before and after, for each level). Null and empty texts are leaves like others,
    repeated rows are leaves each, columns beyond these are not read, an empty table gives an empty result.
    """
    kept = {f"keep{k}": c for k, c in enumerate(keep)}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(
        name.alias("key"), F.col(order).alias("own"), F.col(group).alias("held"), leaf(*(F.col(c) for c in columns)).alias("node"),
        F.monotonically_increasing_id().alias("tie"), *(F.col(c).alias(k) for k, c in kept.items()),
    )
    leaves = written(leaves, "merkle-leaves")
    placed = indexed(leaves, ["own", "node"])
    discarded(leaves)
    trees = _climbed(placed)
    tops = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "node", F.lit(0).alias("tie"))
    forest = _climbed(indexed(tops, ["name"]))
    top = forest[-1].first()  # one row, or none of an empty table

    start = docs.sparkSession.createDataFrame([("", 0, "", [], None)], "key string, i long, path string, turns array<struct<before: int, after: int>>, subroot string")
    above = start
    for table in reversed(forest):
        with_path = _none_yet(table)
        above = written(_descend(with_path, above), "merkle-paths")
    above = above.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("i"), "path", "turns", F.col("node").alias("subroot"))
    for table in reversed(trees[1:]):
        above = written(_descend(_none_yet(table), above).select("key", "i", "path", "turns", "subroot"), "merkle-paths")
    out = _descend(_none_yet(placed), above)
    return out.select(
        F.col("own").alias(order), F.col("held").alias(group), *(F.col(k).alias(c) for k, c in kept.items()), F.col("node").alias("leaf"), "subroot",
        F.lit(top.node if top else None).cast("string").alias("root"), "path", "turns",
    )


def _none_yet(nodes: DataFrame) -> DataFrame:
    null = F.lit(None)
    return nodes.select("*", null.cast("string").alias("path"), null.cast("array<struct<before: int, after: int>>").alias("turns"), null.cast("string").alias("subroot"))
