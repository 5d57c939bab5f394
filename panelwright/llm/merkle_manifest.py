"""Merkle manifest of a dataset: one tree for each language, one over their roots, proofs for every row.

Nodes have up to ``FAN`` children. A tree is cut into aligned blocks of ``EDGES`` levels of edges; a
block's nodes stand in van Emde Boas order, so that a node's address follows from its depth and index
alone and a path to the block's root touches neighbouring memory at every scale. Blocks are built where
their leaves meet in Spark; the roots of the blocks are the leaves of the next pass, and so on until a
tree is one block. Proofs go the other way: each block hands its children what lies above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, materialize

FAN = 8
#: Levels of edges in a block: 512 leaves, 585 nodes of 32 bytes.
EDGES = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def veb_size(levels: int) -> int:
    """Nodes of a whole tree with so many levels of nodes."""
    return (FAN**levels - 1) // (FAN - 1)


def veb_address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0: root) in the van Emde Boas order of a tree of ``levels``.

    The upper half of the levels comes first, then each subtree below it, all in the same order again.
    """
    at = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, below = depth - top, levels - top
        at += veb_size(top) + index // FAN**depth * veb_size(below)
        index, levels = index % FAN**depth, below
    return at


def digest(data: bytes) -> bytes:
    """The lowercase hexadecimal SHA-256, as bytes."""
    return hashlib.sha256(data).hexdigest().encode()


def build_block(leaves: list[bytes], edges: int) -> np.ndarray:
    """(nodes, 32) raw digests in van Emde Boas order; places without a node are zero."""
    nodes = np.zeros((veb_size(edges + 1), 32), np.uint8)
    for depth in range(edges, -1, -1):
        raw = np.frombuffer(bytes.fromhex(b"".join(leaves).decode()), np.uint8).reshape(-1, 32)
        nodes[veb_address(depth, np.arange(len(leaves)), edges + 1)] = raw
        if depth:
            leaves = [digest(b"".join(leaves[i : i + FAN])) for i in range(0, len(leaves), FAN)]
    return nodes


def block_proofs(nodes: np.ndarray, n_leaves: int, edges: int) -> list[bytes]:
    """For each leaf of a block, the digests of its siblings on the way to the block's root, in hex."""
    paths, counts = [b""] * n_leaves, n_leaves
    for depth in range(edges, 0, -1):
        hexes = nodes[veb_address(depth, np.arange(counts), edges + 1)].tobytes().hex().encode()
        step = FAN ** (edges - depth)
        for i in range(n_leaves):
            own = i // step
            begin = own - own % FAN
            end = min(begin + FAN, counts)
            paths[i] += hexes[64 * begin : 64 * own] + hexes[64 * own + 64 : 64 * end]
        counts = -(-counts // FAN)
    return paths


def fold(leaf: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that ``leaf`` and its proof give; ``places``: (rank, leaves) in each tree that the proof passes."""
    at = 0
    for rank, n in places:
        while n > 1:
            own = rank % FAN
            size = 64 * (min(FAN, n - (rank - own)) - 1)
            beside = proof[at : at + size]
            leaf = digest(beside[: 64 * own] + leaf + beside[64 * own :])
            at, rank, n = at + size, rank // FAN, -(-n // FAN)
    return leaf


def leaf_digest(text: Column) -> Column:
    """Digest of a row's fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``rank`` (from 0, within ``tree``) and ``n`` (leaves of the tree).

    ``leaves`` is a written table: it is sampled for ranges, then dealt to them, and rows are numbered
    within ranges; what the ranges before hold of a tree is added from a table of (range, tree) counts.
    No tree needs to fit one task.
    """
    keys = ["tree", *order]
    dealt = leaves.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    dealt = materialize(dealt, "manifest-dealt")
    pieces = dealt.groupBy("part", "tree").agg(F.count("*").alias("rows"), F.min("pos").alias("first"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("rows").over(of_tree.orderBy("part")) - F.col("rows")
    pieces = pieces.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    return dealt.join(pieces, ["part", "tree"]).withColumn("rank", F.col("pos") + F.col("shift")).drop("part", "pos", "shift")


def edges_of(n: int) -> int:
    """Levels of edges of a block in a tree of ``n`` leaves: fewer than EDGES only where the tree is smaller."""
    edges = 0
    while edges < EDGES and FAN**edges < n:
        edges += 1
    return edges


def _block(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("rank")
    n = int(part["n"].iloc[0])
    edges = edges_of(n)
    nodes = build_block([x.encode() for x in part["leaf"]], edges)
    return pd.DataFrame({
        "tree": part["tree"].iloc[:1], "block": part["block"].iloc[:1], "n": n, "leaves": len(part),
        "nodes": [nodes.tobytes()], "top": [nodes[0].tobytes().hex()],
    })


def build(leaves: DataFrame) -> list[DataFrame]:
    """(tree, rank, n, leaf) -> block tables (tree, block, n, leaves, nodes, top), from the leaves upwards.

    The last table's blocks are roots of their trees; a tree of one block ends in an earlier table.
    """
    levels: list[DataFrame] = []
    while True:
        dealt = leaves.select("tree", F.floor(F.col("rank") / FAN**EDGES).alias("block"), "rank", "n", "leaf")
        done = dealt.groupBy("tree", "block").applyInPandas(_block, "tree string, block long, n long, leaves long, nodes binary, top string")
        levels.append(materialize(done, "manifest-blocks"))
        more = levels[-1].where(F.col("n") > FAN**EDGES)
        if not more.head(1):
            return levels
        leaves = more.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / FAN**EDGES).alias("n"), F.col("top").alias("leaf"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, top) of every tree."""
    out = None
    for level in levels:
        own = level.where(F.col("n") <= FAN**EDGES).select("tree", "top")
        out = own if out is None else out.unionByName(own)
    return out


def _hand_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(tree, block, proof) of the children of each block."""
    for batch in batches:
        for tree, block, n, leaves, nodes, proof in zip(*[batch[c] for c in ("tree", "block", "n", "leaves", "nodes", "proof")]):
            own = block_proofs(np.frombuffer(nodes, np.uint8).reshape(-1, 32), leaves, edges_of(n))
            first = block * FAN**EDGES
            yield pd.DataFrame({"tree": tree, "block": range(first, first + leaves), "proof": [p + proof for p in own]})


def with_proofs(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks with ``proof``, the siblings above each block's root.

    ``above``: (tree, proof), what lies above the root of each tree.
    """
    handed = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        whole = level.where(F.col("n") <= FAN**EDGES).join(above, "tree")
        if handed is not None:
            whole = whole.unionByName(level.where(F.col("n") > FAN**EDGES).join(handed, ["tree", "block"]))
        if k:
            handed = whole.select("tree", "block", "n", "leaves", "nodes", "proof").mapInPandas(_hand_down, "tree string, block long, proof binary")
    return whole


@dataclass
class Manifest:
    """``leaves``: (doc_id, tree, leaf, changed, row, rank, n); ``blocks``: block tables of the languages' trees;
    ``upper``: those of the tree over their roots, whose leaves are ``subroots`` (tree, language, rank, n, leaf)."""

    leaves: DataFrame
    blocks: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]

    def root(self) -> DataFrame:
        """One row (top), none for an empty dataset."""
        return roots(self.upper).select("top")


def manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns play no part).

    Leaves of a language ascend by doc_id (null first), rows that share an id by their digest. Every row
    is a leaf, equal rows too. ``changed`` is a text to be held against the manifest later: the digests
    that it gives stand beside the leaves. An empty table gives no trees.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # null before every language
    leaves = docs.select("doc_id", tree.alias("tree"), leaf_digest(F.col("text")).alias("leaf"), (F.lit(None).cast("string") if changed is None else leaf_digest(changed)).alias("changed"))
    leaves = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    leaves = materialize(ranked(leaves, ["doc_id", "leaf", "row"]), "manifest-ranked")
    blocks = build(leaves)
    tops = materialize(roots(blocks).select(F.lit("").alias("tree"), F.col("tree").alias("language"), F.col("top").alias("leaf")), "manifest-tops")
    subroots = materialize(ranked(tops, ["language"]), "manifest-subroots")
    return Manifest(leaves, blocks, subroots, build(subroots))


def _prove(with_fold: bool):
    def run(key: tuple, leaves: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(leaves) or not len(blocks):
            return pd.DataFrame({c: [] for c in OUT})
        block, leaves = blocks.iloc[0], leaves.sort_values("rank")
        own = block_proofs(np.frombuffer(block["nodes"], np.uint8).reshape(-1, 32), len(leaves), edges_of(int(block["n"])))
        n, upper = int(block["n"]), (int(block["tree_rank"]), int(block["trees"]))
        proofs, folded = [], []
        for inner, leaf, changed, rank in zip(own, leaves["leaf"], leaves["changed"], leaves["rank"]):
            proof = inner + block["proof"]
            proofs.append(digest(proof).decode())
            folded.append(fold((changed or leaf).encode(), proof, [(int(rank), n), upper]).decode() if with_fold else None)
        out = leaves[["doc_id", "leaf"]].astype({"doc_id": "Int64"})
        return out.assign(subroot=block["subroot"], root=block["root"], proof_sha256=proofs, folded_root=folded)

    return run


OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def prove(held: Manifest, with_fold: bool = True) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root for every leaf.

    ``folded_root`` comes from the changed leaf, where there is one, else from the leaf, and the siblings
    that the manifest holds; ``with_fold`` false leaves it null.
    """
    upper = with_proofs(held.upper, _above_root(held))
    of_upper = F.floor(F.col("rank") / FAN**EDGES)
    paths = upper.select("tree", "block", "n", "leaves", "nodes", "proof").mapInPandas(_hand_down, "tree string, block long, proof binary")
    tops = held.subroots.select("language", F.col("rank").alias("block"), F.col("n").alias("trees"), F.col("leaf").alias("subroot"), of_upper.alias("upper"))
    trees = tops.join(paths.select("block", "proof"), "block").crossJoin(F.broadcast(held.root().withColumnRenamed("top", "root")))  # one row
    trees = materialize(trees.select(F.col("language").alias("tree"), F.col("block").alias("tree_rank"), "trees", "subroot", "root", "proof"), "manifest-trees")
    blocks = with_proofs(held.blocks, trees.select("tree", "proof")).select("tree", "block", "n", "nodes", "proof")
    blocks = blocks.join(trees.drop("proof"), "tree")
    leaves = held.leaves.select("doc_id", "tree", "leaf", "changed", "rank", F.floor(F.col("rank") / FAN**EDGES).alias("block"))
    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(
        _prove(with_fold), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    )


def _above_root(held: Manifest) -> DataFrame:
    return roots(held.upper).select("tree", F.lit(b"").cast("binary").alias("proof"))


def op12(docs: DataFrame) -> DataFrame:
    """Every document's proof, and whether its text, lower-cased where 3 divides crc32(doc_id), still gives the root.

    A null doc_id has the crc32 of the empty text. Null and empty texts, long texts and repeated rows are
    leaves like any other; an empty table gives no rows.
    """
    tampered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    out = prove(manifest(docs, tampered))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of the levels of trees over nodes ``{name}n0`` (g, i, h, n) and of the paths ``{name}p0`` (id, g, i, proof, cur)."""
    steps = []
    for k in range(levels):
        beside = f"list_filter(r.hs, lambda x, j: j <> p.i % {FAN} + 1)"
        swapped = f"list_transform(r.hs, lambda x, j: case when j = p.i % {FAN} + 1 then p.cur else x end)"
        steps.append(
            f"{name}r{k} as (select g, i // {FAN} i, list(h order by i) hs, any_value(n) n from {name}n{k} group by g, i // {FAN})"
            f",\n{name}n{k + 1} as (select g, i, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end h, (n + {FAN - 1}) // {FAN} n from {name}r{k})"
            f",\n{name}p{k + 1} as (select p.id, p.g, p.i // {FAN} i, p.proof || case when r.n > 1 then array_to_string({beside}, '') else '' end proof,"
            f" case when r.n > 1 then sha256(array_to_string({swapped}, '')) else p.cur end cur"
            f" from {name}p{k} p join {name}r{k} r on r.g = p.g and r.i = p.i // {FAN})"
        )
    return ",\n".join(steps)


def op12_sql(levels: int = 6) -> str:
    """The same in SQL, with so many levels of either tree written out (262,144 leaves a language, as many languages)."""
    leaf = "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in FIELDS) + ")"
    low = leaf.replace("cast(text as varchar)", f"translate(text, '{UPPER}', '{UPPER.lower()}')")
    one = "list_reduce(list_prepend(b, list_transform(range(8), lambda x: 0::bigint)), lambda a, x: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda x: ascii(x)::bigint)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])))"
    return f"""
with c as (select list({one} order by b) tab from (select unnest(range(256)) b)),
d as (select row_number() over () id, coalesce('=' || lang, '-') g, doc_id, {leaf} leaf, case when {crc} % 3 = 0 then {low} else {leaf} end cur from documents, c),
o as (select id, g, row_number() over (partition by g order by doc_id nulls first, leaf, id) - 1 i, leaf h, count(*) over (partition by g) n, cur from d),
n0 as (select g, i, h, n from o),
p0 as (select id, g, i, '' proof, cur from o),
{_tree_sql("", levels)},
un0 as (select '' g, row_number() over (order by g) - 1 i, h, count(*) over () n, g lang from n{levels}),
up0 as (select p.id, '' g, u.i, p.proof, p.cur from p{levels} p join un0 u on u.lang = p.g),
{_tree_sql("u", levels)}
select d.doc_id, d.leaf, s.h subroot, t.h root, sha256(p.proof) proof_sha256, p.cur folded_root, p.cur = t.h verified
from d join up{levels} p using (id) join n{levels} s on s.g = d.g cross join un{levels} t"""
