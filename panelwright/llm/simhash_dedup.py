"""SimHash near-duplicates: fingerprints, shards of a vantage-point tree, exact links, components.

Two fingerprints within ``radius`` bits must agree on at least one of ``radius + 1`` segments of the
64 bits. The first level of the tree therefore deals every fingerprint to one cell for each segment;
below it, levels of distance bands around vantage points split the cells. By the triangle inequality
two linked fingerprints differ by at most ``radius`` in their distance to a vantage point, so a
fingerprint is a guest in the next band only where it lies within ``radius`` of the boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import materialize
from .components import connected_components

RADIUS = 4
SHINGLE = 4
BAND = 8
#: A shard is split by pairs of blocks beyond this many fingerprints.
SHARD_ROWS = 4096


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text, as a signed integer (no words: 0)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        shingles = [digest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[: 1 - width].tolist()
        shingles = [digest(joined[a:b], 42) for a, b in zip(begins, ends[width - 1 :].tolist())]
    hashes = np.array(shingles, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(x) for x in batch], dtype="int64")


def _segments(fp: Column, radius: int) -> list[Column]:
    """Each of the radius + 1 segments as (index, bits) hashed to one long."""
    parts, at, out = radius + 1, 0, []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1))
        out.append(F.xxhash64(F.lit(k), value))
        at += size
    return out


def _shards(reps: DataFrame, radius: int, levels: int) -> DataFrame:
    """(key, fp): home and guest shards of every fingerprint."""
    out = reps.select("fp", F.explode(F.array(*_segments(F.col("fp"), radius))).alias("key"))
    for level in range(levels):
        far = F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64(F.lit(f"vantage {level}"))))
        home, guest = F.floor(far / BAND), F.floor((far + radius) / BAND)
        out = out.withColumn("band", F.explode(F.array_distinct(F.array(home, guest))))
        out = out.select("fp", F.xxhash64("key", "band").alias("key"))
    return out.distinct()


def _split_hot(shards: DataFrame, rows: int) -> DataFrame:
    """Deal the shards that are too large for one task to pairs of blocks; every pair of rows still meets."""
    hot = materialize(shards.groupBy("key").count().where(F.col("count") > rows), "hot")
    if not hot.head(1):
        return shards
    n = F.ceil(F.col("count") / (rows // 2)).cast("int")
    own = F.pmod(F.xxhash64("fp", "key"), n).cast("int")
    mates = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    keys = F.when(F.col("count").isNull(), F.array("key")).otherwise(mates)
    return shards.join(hot, "key", "left").select("fp", F.explode(keys).alias("key"))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints within ``radius`` bits of each other.

    Points are kept in order of distance to a vantage point; one point is compared only with
    unvisited points whose distance to it differs by at most ``radius``.
    """
    far = np.bitwise_count(fps ^ fps[0])
    order = np.argsort(far, kind="stable")
    left, dist, links = fps[order], far[order].astype(np.int16), []
    while len(left) > 1:
        queue = [(left[0], dist[0])]
        left, dist = left[1:], dist[1:]
        while queue and len(left):
            x, d = queue.pop()
            lo, hi = np.searchsorted(dist, (d - radius, d + radius + 1))
            near = lo + np.flatnonzero(np.bitwise_count(left[lo:hi] ^ x) <= radius)
            if len(near):
                links += [(x, y) for y in left[near]]
                queue += zip(left[near], dist[near])
                left, dist = np.delete(left, near), np.delete(dist, near)
    return links


def _link_batches(radius: int):
    def shard_links(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        found: list[tuple[int, int]] = []
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if to - at == 2:
                if int(fps[at] ^ fps[at + 1]).bit_count() <= radius:
                    found.append((fps[at], fps[at + 1]))
            elif to - at > 2:
                found += forest(fps[at:to], radius)
        links = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            keys = np.concatenate([keys, batch["key"].to_numpy(np.int64)])
            fps = np.concatenate([fps, batch["fp"].to_numpy(np.int64).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on in the next batch
            if whole:
                yield shard_links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield shard_links(keys, fps)

    return run


def fingerprint_links(reps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) that span every component of fingerprints within ``radius`` bits."""
    cells, n = 2 ** (64 // (radius + 1)), reps.count()
    levels = 1
    while n / cells / 2**levels > shard_rows / 4:
        levels += 1
    shards = materialize(_shards(reps, radius, levels), "shards")
    dealt = _split_hot(shards, shard_rows).repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInPandas(_link_batches(radius), "a long, b long")


def _rooted(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, root) of all distinct fingerprints of ``fps``; equal roots are one component."""
    reps = materialize(fps.select("fp").distinct(), "representatives")
    roots = connected_components(fingerprint_links(reps, radius, shard_rows))
    return materialize(reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """documents -> (doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    Null and word-free texts share fingerprint 0 and one component. Rows with the same text or id
    are each returned. A null doc_id gets the component of its fingerprint's group, and null where
    no member of the group has an id. An empty table gives an empty result; texts are read whole; other columns play
    no part.
    """
    prints = materialize(docs.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    rooted = _rooted(prints, radius, shard_rows)
    least = materialize(rooted.join(least, "fp"), "least")
    classes = least.join(least.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of each group of near copies, with all its columns.

    The row with the smallest doc_id stays (null last), of rows with one id the one whose text has the
    smallest hash, and of rows that repeat id and text the one whose columns have the smallest hash. Rows are told
    apart by id and text, so an id that repeats with a text of its own is judged by that text. Null
    and word-free texts are one group. An empty table stays empty; texts are read whole.
    """
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    prints = materialize(docs.select(*key, fingerprint_udf("text").alias("fp")), "fingerprints")
    keys = prints.groupBy("doc_id", "text_hash").agg(F.first("fp").alias("fp"), F.count("*").alias("n_rows"))
    members = materialize(keys.join(_rooted(prints, radius, shard_rows), "fp").select("root", "n_rows", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash").alias("who")), "members")
    kept = members.groupBy("root").agg(F.min("who").alias("kept"), F.min_by("n_rows", "who").alias("n_rows"))
    gone = members.select("root", "who").join(kept.select("root", "kept"), "root").where(~F.col("who").eqNullSafe(F.col("kept"))).select("who.*")
    rows = docs.select(F.struct("*").alias("row"), *key)

    def named(who: DataFrame):
        w = who.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
        return w, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))

    out = rows.join(*named(gone), "left_anti")
    again = materialize(kept.where("n_rows > 1").select("kept.*"), "again")
    if again.head(1):
        first = out.join(*named(again), "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.join(*named(again), "left_anti").select("row").unionByName(first.select("row"))
    return out.select("row.*")


def op7(docs: DataFrame) -> DataFrame:
    groups = simhash_groups(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
