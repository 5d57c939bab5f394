"""Identities of content: trees of digests whose nodes are bounded, so that a table's id needs no part of it in one place."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.scratch import written

#: Rows of a leaf, about; and children of a node.
LEAF, FAN = 1024, 16


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: each column in the order given as UTF-8 byte count, colon and text; a dash for null."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def tree_depth(n: int, leaf: int = LEAF) -> int:
    """The least depth at which ``leaf`` rows a leaf are enough for n rows."""
    depth = 0
    while leaf * FAN**depth < n:
        depth += 1
    return depth


def content_id(df: DataFrame, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """One row (n_rows, n_distinct, depth, content_id), the same however the rows are ordered or dealt.

    Equal rows become one entry with their number. Entries are dealt by the leading hexadecimal digits of their digest, as
    many as give leaves of about ``leaf`` entries; a leaf's digest is that of its entries in order, a node's
    that of its children in order, up to the root. No node gathers more than a leaf's entries or FAN children. An empty
    table has the digest of nothing.
    """
    entries = df.select(row_digest(columns).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    depth = tree_depth(entries.count(), leaf)
    text = F.concat("digest", F.lit(":"), F.col("n").cast("string"))
    return _root(entries.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ","), 256).alias("node")), depth)


def _root(nodes: DataFrame, depth: int) -> DataFrame:
    """The row of ``content_id`` from the leaves (prefix, n_rows, n_distinct, node) at ``depth``."""
    for k in range(depth - 1, -1, -1):
        child = F.concat("prefix", F.lit(":"), "node")
        nodes = nodes.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ","), 256).alias("node"))
    root = nodes.agg(F.max("n_rows").alias("n_rows"), F.max("n_distinct").alias("n_distinct"), F.max("node").alias("node"))  # one row, or none
    return root.select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.lit(depth).cast("long").alias("depth"), F.coalesce("node", F.sha2(F.lit(""), 256)).alias("content_id"))


class Leaves:
    """Leaves of the tree from a task's digests in order, at the depths that its table may have.

    ``width`` leading digits deal the digests, so leaves from that depth on are whole in a task. How many entries its first digits have
    tells the table's size within a factor of two (digests are spread evenly), which leaves one depth or two. Beside the leaves stands a
    row of depth -1 with the task's rows and entries and the depths it made. A task holds its first digits' entries, then the open leaf and a batch.
    """

    SCHEMA = "depth int, prefix string, node string, n_rows long, n_distinct long, low int, high int"

    def __init__(self, width: int, leaf: int) -> None:
        self.width, self.leaf = width, leaf

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, low, high, rows, entries = np.empty((0, 64), np.uint8), np.empty(0, np.int64), None, None, 0, 0
        for batch in batches:
            text = batch.column(0).cast(pa.string())
            if not len(text):
                continue
            begin = np.frombuffer(text.buffers()[1], np.int32)[text.offset]
            fresh = np.frombuffer(text.buffers()[2], np.uint8)[begin : begin + 64 * len(text)].reshape(-1, 64)
            rows += len(fresh)
            held, times = np.concatenate([held, fresh]), np.concatenate([times, np.ones(len(fresh), np.int64)])
            first = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)]))
            held, times = held[first], np.add.reduceat(times, first)
            if low is None:
                if (held[-1, : self.width] == held[0, : self.width]).all():
                    continue
                low, high = self._depths(held)
            done = np.flatnonzero((held[:, :low] != held[-1, :low]).any(axis=1))
            if len(done):  # all but the open leaf
                n = done[-1] + 1
                entries += n
                yield from self._told(held[:n], times[:n], low, high)
                held, times = held[n:].copy(), times[n:]
        if rows:
            if low is None:
                low, high = self._depths(held)
            yield from self._told(held, times, low, high)
            yield self._batch([(-1, None, None, rows, entries + len(held), low, high)])

    def _depths(self, held: np.ndarray) -> tuple[int, int]:
        about = int((held[:, : self.width] == held[0, : self.width]).all(axis=1).sum()) * FAN**self.width
        return max(self.width, tree_depth(about // 2, self.leaf)), max(self.width, tree_depth(2 * about, self.leaf))

    def _told(self, held: np.ndarray, times: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
        once = np.concatenate([held, np.broadcast_to(np.frombuffer(b":1,", np.uint8), (len(held), 3))], axis=1)
        for depth in range(low, high + 1):
            first = np.flatnonzero(np.concatenate([[True], (held[1:, :depth] != held[:-1, :depth]).any(axis=1)]))
            out = []
            for a, b in zip(first, [*first[1:], len(held)]):
                if (times[a:b] == 1).all():
                    text = once[a:b].tobytes()[:-1]
                else:
                    text = b",".join(held[i].tobytes() + b":%d" % times[i] for i in range(a, b))
                out.append((depth, held[a, :depth].tobytes().decode(), hashlib.sha256(text).hexdigest(), int(times[a:b].sum()), int(b - a), None, None))
            yield self._batch(out)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["depth", "prefix", "node", "n_rows", "n_distinct", "low", "high"])


def dealt_content_id(df: DataFrame, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """``content_id`` of a table that is large or dear to compute: it is computed once, its rows are dealt bare, and digests are made where they meet.

    Tables too small for leaves below the dealing digits, or that a task took for another size, go to ``content_id``.
    """
    spark, width = df.sparkSession, 1
    while FAN**width < 8 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        width += 1
    digests = df.select(*columns).repartition(F.substring(row_digest(columns), 1, width)).select(row_digest(columns).alias("digest")).sortWithinPartitions("digest")
    leaves = written(digests.mapInArrow(Leaves(width, leaf), Leaves.SCHEMA), "leaves")
    n, low, high = leaves.where("depth = -1").agg(F.sum("n_distinct"), F.max("low"), F.min("high")).first()
    depth = tree_depth(n or 0, leaf)
    if n and not low <= depth <= high:
        return content_id(df, columns, leaf)
    return _root(leaves.where(F.col("depth") == depth).select("prefix", "n_rows", "n_distinct", "node"), depth)


def canonical(config: dict) -> str:
    """A configuration as text that doesn't depend on the order of its entries."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def release_id(config: dict, inputs: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row for each input (input, n_rows, content_id) with the release's id, the digest of the configuration and of all inputs' contents.

    Names of inputs are part of the id, their order and the partitioning of their rows are not.
    """
    out = None
    for name in sorted(inputs):
        df, columns = inputs[name]
        one = dealt_content_id(df, columns).select(F.lit(name).alias("input"), "n_rows", "content_id")
        out = one if out is None else out.unionByName(one)
    every = out.groupBy().agg(F.array_join(F.array_sort(F.collect_list(F.concat("input", F.lit("="), "content_id"))), ",").alias("_all"))  # a few inputs
    return out.crossJoin(F.broadcast(every)).select("input", "n_rows", "content_id", F.sha2(F.concat(F.lit(canonical(config) + "|"), "_all"), 256).alias("release_id"))
