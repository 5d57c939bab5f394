"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Vectors are quantised to integers once. A part's coarse cell, its components floored to a grid, stands
for a box; of the codebook's entries only those are kept for a cell that no other entry dominates
across the box (an entry goes where its least distance to the box exceeds the largest distance of
another). What a cell keeps is remembered, and parts are compared exactly with their cell's entries alone.
All sums are of integers, so neither partitions nor order move a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this would not leave room for sums of squares in 64 bits.
LARGEST = 1 << 27
#: Cells that a task remembers for a part before it starts anew.
MEMO = 1 << 16
#: Label totals of so many rows at most are broadcast; more are joined by salted keys.
BROADCAST_LABELS, SALTS = 100_000, 64


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, q), the vectors as written integers of 32 bits, and their number of components.

    Rows go whose vector is null or holds null or non-finite components. All vectors of a table have one
    length, a multiple of PARTS: the most frequent such length (of equally frequent ones the smallest);
    rows of another length go too.
    """
    whole = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = whole.groupBy(F.size("v").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % PARTS == 0))
    size = sizes.orderBy(F.desc("count"), "size").first()
    size = size["size"] if size else PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            q = np.floor(v * SCALE)
            if len(q) and np.abs(q).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST / SCALE:g} leave no room for exact sums")
            q = np.ascontiguousarray(q.astype("<i4"))
            packed = pa.array([row.tobytes() for row in q], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], names=["vec_id", "label", "q"])

    kinds = dict(whole.dtypes)
    kept = whole.where(F.size("v") == size).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary")
    return materialize(kept, "vectors"), size


@dataclass
class Grid:
    """Codebook of one part with its grid, and the cells seen so far: cell -> row of ``masks``."""

    book: np.ndarray
    width: int
    seen: dict[bytes, int]
    masks: np.ndarray

    @staticmethod
    def of(book: np.ndarray) -> Grid:
        """Cells about a quarter as wide as entries lie apart on one axis."""
        spread = int(np.ptp(book, axis=0).mean()) if len(book) else 0
        return Grid(book, max(1, spread // 4), {}, np.empty((0, len(book)), bool))

    def _undominated(self, cells: np.ndarray) -> np.ndarray:
        low = cells.astype(np.int64)[:, None, :] * self.width
        high, book = low + self.width - 1, self.book[None]
        least = (np.maximum(np.maximum(low - book, book - high), 0) ** 2).sum(2)
        most = (np.maximum(book - low, high - book) ** 2).sum(2)
        return least <= most.min(axis=1, keepdims=True)

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """(rows, entries): which entries may be nearest."""
        cells = np.ascontiguousarray(np.floor_divide(parts, self.width).astype(np.int32))
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[i].tobytes() for i in first]
        if len(self.seen) + len(names) > MEMO:
            self.seen, self.masks = {}, self.masks[:0]
        new = [k for k, name in enumerate(names) if name not in self.seen]
        if new:
            at = len(self.masks)
            self.masks = np.vstack([self.masks, self._undominated(cells[first[new]])])
            self.seen |= {names[k]: at + i for i, k in enumerate(new)}
        return self.masks[np.array([self.seen[name] for name in names])][inverse.ravel()]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and its squared distance."""
        if not len(parts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        row, entry = np.nonzero(self.candidates(parts))
        far = ((parts[row] - self.book[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(far, np.searchsorted(row, np.arange(len(parts))))
        hit = np.flatnonzero(far == best[row])
        hit = hit[np.r_[True, np.diff(row[hit]) > 0]]
        return entry[hit], best


def _parts(packed: pa.Array, size: int) -> np.ndarray:
    """(part, row, component) of packed vectors."""
    flat = np.frombuffer(b"".join(packed.to_pylist()), "<i4").astype(np.int64)
    return flat.reshape(-1, PARTS, size // PARTS).transpose(1, 0, 2)


def _sums(books: np.ndarray, size: int):
    """(part, entry, place, n, total): sums of the parts that each entry is nearest to, one set for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid.of(b) for b in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for p, part in enumerate(_parts(batch.column("q"), size)):
                entry, _ = grids[p].nearest(part)
                np.add.at(total[p], entry, part)
                n[p] += np.bincount(entry, minlength=books.shape[1])
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        used = np.repeat(n.ravel(), books.shape[2])
        rows = [x[used > 0] for x in (part, entry, place, used, total.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["part", "entry", "place", "n", "total"])

    return run


def codebooks(kept: DataFrame, size: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component): the parts of the smallest vec_ids, moved ``rounds`` times to the mean of what is nearest.

    Rows that share a vec_id come in the order of their packed bytes, null ids last. Fewer rows than
    ``entries`` make as many entries. Only sums of a task's parts, as many as the codebooks have
    components, leave a task.
    """
    begin = kept.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    if not begin:
        return np.empty((PARTS, 0, size // PARTS), np.int64)
    books = _parts(pa.array([bytes(r["q"]) for r in begin]), size).copy()
    for _ in range(rounds):
        sums = kept.select("q").mapInArrow(_sums(books, size), "part long, entry long, place long, n long, total long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def _codes(books: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid.of(b) for b in books]
        for batch in batches:
            found = [grids[p].nearest(part) for p, part in enumerate(_parts(batch.column("q"), size))]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            code = pa.array([row.tobytes().hex() for row in index], pa.string())
            error = pa.array(sum(d for _, d in found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, error], names=["vec_id", "label", "code", "error"])

    return run


def encode(kept: DataFrame, size: int, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every usable vector."""
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(_codes(books, size), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code) -> (vec_id, vector): the entries that a code names, in the scale of the vectors."""
    flat = books / SCALE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch["code"])), np.uint8).reshape(-1, PARTS)
            vectors = np.concatenate([flat[p][index[:, p]] for p in range(PARTS)], axis=1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": list(vectors)})

    return codes.select("vec_id", "code").mapInPandas(run, f"vec_id {dict(codes.dtypes)['vec_id']}, vector array<double>")


def with_label_error(coded: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """``coded`` (a written table) with ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    small = totals.select(F.col("label").alias("of"), "label_error")
    same = coded["label"].eqNullSafe(small["of"])
    if totals.count() <= most:
        return coded.join(F.broadcast(small), same).drop("of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    small = small.withColumn("salted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(small, salted["label"].eqNullSafe(small["of"]) & (salted["salt"] == small["salted"])).drop("of", "salt", "salted")


def op13(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Null labels are one label; rows that repeat an id or a vector are coded each by itself. An empty
    table, or one without a usable vector, gives no rows. Other columns play no part.
    """
    kept, size = usable(vectors)
    books = codebooks(kept, size)
    coded = materialize(encode(kept, size, books), "codes")
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def op13_sql() -> str:
    """The same in SQL, with the rounds written out; distances to all entries."""
    near = """{d} as (select rid, p, e, d from (
  select v.rid, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v join {b} b using (p))
  qualify row_number() over (partition by rid, p order by d, e) = 1)"""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(near.format(d=f"d{k}", b=f"b{k}"))
        if k < ROUNDS:
            steps.append(f"""s{k} as (select p, e, i, cast(floor(sum(x) / count(*)) as bigint) x from (
    select d.p, d.e, unnest(range(1, len(v.x) + 1)) i, unnest(v.x) x from d{k} d join v using (rid, p)) group by p, e, i),
m{k} as (select p, e, list(x order by i) x from s{k} group by p, e),
b{k + 1} as (select b.p, b.e, coalesce(m.x, b.x) x from b{k} b left join m{k} m using (p, e))""")
    return f"""
with w as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) q from documents_vectors),
k as (select *, row_number() over (order by vec_id, q) rid from w),
v as (select rid, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] x from k, (select unnest(range({PARTS})) p)),
b0 as (select p, rid - 1 e, x from v where rid <= {ENTRIES}),
{",".join(steps)},
c as (select rid, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from d{ROUNDS} group by rid),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256
from k join c using (rid) cross join h""".replace(
        "documents_vectors", "embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    )
