"""Benchmark decontamination: CGK embeddings, repeated bit-sampling LSH, exact edit verification.

An item of n words is leaked where consecutive words of a document, however many (n - k to n + k can
qualify), are within k = floor(0.2 n) word edits of it. CGK's random walk reads a window from its first
word on: each step gives the word it stands on, and a hash of step and word decides whether it moves on.
Two walks with the same hashes that an edit has driven apart soon meet again, so a small edit distance
becomes a small Hamming distance. The first places of the walk of an item-sized window depend on nothing
behind it; one walk from each word of a document therefore serves the windows of all lengths at once.

Each repetition draws its own walk and samples places of it; a window whose sampled places equal those
of an item, or of the item from one of its anchors on, is a candidate. Equal windows are found for
certain. For windows at the full k edits, recall grows with the repetitions (``tests/llm`` measure it
against brute force). One dynamic program over the stretch round a candidate then gives the exact
distances of all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

SIMILARITY = 0.8
#: LSH: walks, and from how many words on an item takes which samples of a walk's places (those that fit into it).
WALKS = 6
SAMPLES = (
    (20, ((0, 2, 4, 6, 8), (2, 4, 6, 8, 10), (4, 6, 8, 10, 12), (6, 8, 10, 12, 14))),
    (12, ((0, 2, 4, 6), (1, 3, 5, 7), (3, 5, 7, 9), (5, 7, 9, 11), (7, 9, 11, 13), (8, 10, 12, 14))),
    (1, ((0, 2), (1, 3), (2, 4), (0, 3), (1, 4), (3, 5))),
)
STEPS = max(p[-1] for _, samples in SAMPLES for p in samples) + 1
PLACES = max(len(p) for _, samples in SAMPLES for p in samples)
#: Words between an item's anchors.
ANCHOR_WORDS = 9
#: Items sent to the executors at once; a larger benchmark takes several passes over the documents.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 8_000_000
#: Words of a batch that are embedded together.
WORDS_AT_ONCE = 1 << 18

_CLEAN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def benchmark_words(text: str | None) -> list[bytes]:
    """Words without case (A-Z) and ASCII punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


@dataclass
class Table:
    """Keys of one repetition in order, each with its item and anchor, and which low bits of a key occur."""

    keys: np.ndarray
    item: np.ndarray
    anchor: np.ndarray
    occurs: np.ndarray


@dataclass
class Index:
    """What a task needs to find the items of one slice of the benchmark."""

    ids: list[list]  # of each distinct item: the ids that have its text
    codes: dict[bytes, int]
    items: list[np.ndarray]
    bounds: list[int]
    members: np.ndarray  # (item, low byte of a code) -> whether the item has such a word
    tables: dict[int, dict[tuple[int, ...], Table]]  # walk -> sampled places -> table


def build_index(rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, walks: int = WALKS) -> Index:
    """Items with the same words are kept once, with all their ids; items without words match nothing."""
    codes: dict[bytes, int] = {}
    same: dict[tuple[int, ...], list] = {}
    for item_id, text in rows:
        found = benchmark_words(text)
        if found:
            same.setdefault(tuple(codes.setdefault(w, len(codes)) for w in found), []).append(item_id)
    items = [np.array(item, np.int32) for item in same]
    bounds = [int((1 - similarity) * len(item) + 1e-9) for item in items]
    members = np.zeros((len(items), 256), bool)
    keys: dict[int, dict[tuple[int, ...], list[tuple[int, int, int]]]] = {}
    drawn = {walk: draws(walk, len(codes) + 1) for walk in range(walks)}
    for row, (item, k) in enumerate(zip(items, bounds)):
        n = len(item)
        members[row, item & 255] = True
        # sampled places lie within the item, so that no walk leaves its window; an exact item needs one key
        samples = [p for p in next(p for least, p in SAMPLES if n >= least) if p[-1] < n] or [tuple(range(n))]
        anchors = range(0, max(1, n - ANCHOR_WORDS), ANCHOR_WORDS) if k else (0,)
        for walk in range(walks if k else 1):
            for anchor in anchors:
                fitting = [p for p in (samples if k else samples[:1]) if anchor + p[-1] < n]
                read = cgk(item, np.array([anchor]), drawn[walk][0], max((p[-1] for p in fitting), default=0) + 1)
                for places in fitting:
                    held = int(_key([read[p] for p in places], drawn[walk][1])[0])
                    keys.setdefault(walk, {}).setdefault(places, []).append((held, row, anchor))
    tables = {walk: {places: _table(found) for places, found in of_walk.items()} for walk, of_walk in keys.items()}
    return Index(list(same.values()), codes, items, bounds, members, tables)


def _table(found: list[tuple[int, int, int]]) -> Table:
    keys, item, anchor = (np.array(column, t) for column, t in zip(zip(*sorted(found)), (np.uint32, np.int64, np.int64)))
    occurs = np.zeros(1 << max(16, min(26, len(keys).bit_length() + 4)), bool)
    occurs[keys & np.uint32(len(occurs) - 1)] = True
    return Table(keys, item, anchor, occurs)


def draws(walk: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(step, code) -> whether the walk moves on, and (place of a sample, code) -> hash; the last code is that of all words that no item has."""
    rng = np.random.default_rng((walk, 17))
    return rng.integers(0, 2, (STEPS, codes), np.int32), rng.integers(0, 1 << 32, (PLACES, codes), np.uint32)


def cgk(words: np.ndarray, starts: np.ndarray, bits: np.ndarray, steps: int) -> list[np.ndarray]:
    """For each step of the walk from each start: the word it reads. Past the end of ``words`` it reads the last."""
    at, out = starts.astype(np.int32), []
    for step in range(steps):
        sign = words.take(at, mode="clip")
        out.append(sign)
        at = at + bits[step].take(sign)
    return out


def _key(columns: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    out = hashes[0].take(columns[0])
    for place, column in enumerate(columns[1:], 1):
        out ^= hashes[place].take(column)
    return out


def candidates(words: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item, first word) of the windows of ``words`` that agree with an item in a repetition.

    Codes below 0 belong to no item, and no window begins there. Of a window within k edits of an item, at
    least n - k words are words of the item; windows round which there are fewer such words are left out at once.
    """
    unknown, found = len(index.codes), []
    starts = np.flatnonzero(words >= 0)
    low, known = (words & 255).astype(np.uint8), words >= 0
    read_words = np.where(known, words, unknown).astype(np.int32)
    sizes, bounds = np.array([len(i) for i in index.items], np.int64), np.array(index.bounds, np.int64)
    for walk, tables in index.tables.items():
        bits, hashes = draws(walk, unknown + 1)
        for at in range(0, len(starts), WORDS_AT_ONCE):
            part = starts[at : at + WORDS_AT_ONCE]
            read = cgk(read_words, part, bits, max(p[-1] for p in tables) + 1)
            for places, table in tables.items():
                held = _key([read[p] for p in places], hashes)
                hit = np.flatnonzero(table.occurs.take(held & np.uint32(len(table.occurs) - 1)))
                held = held[hit]
                lo, hi = np.searchsorted(table.keys, held), np.searchsorted(table.keys, held, "right")
                times = hi - lo
                row = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
                item, begin = table.item[row], np.repeat(part[hit], times) - table.anchor[row]
                if len(item):
                    keep = _enough_words(low, known, item, begin, index, sizes, bounds)
                    found.append(begin[keep] * len(index.items) + item[keep])
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs % max(1, len(index.items)), pairs // max(1, len(index.items))


def _enough_words(low: np.ndarray, known: np.ndarray, item: np.ndarray, begin: np.ndarray, index: Index, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether n - k words of the stretch that holds a candidate's windows can be words of its item."""
    out = np.empty(len(item), bool)
    order = np.argsort(sizes[item], kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(sizes[item[order]])) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:]):
        n, k = int(sizes[item[order[a]]]), int(bounds[item[order[a]]])
        step = max(1, 2_000_000 // (n + 2 * k))
        for at in range(a, b, step):
            rows = order[at : min(at + step, b)]
            places = begin[rows, None] + np.arange(-k, n + k)
            np.clip(places, 0, len(low) - 1, out=places)
            held = index.members[item[rows, None], low[places]] & known[places]
            out[rows] = np.count_nonzero(held, axis=1) >= n - k
    return out


def edit_distances(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of ``windows`` to the same row of ``items`` (all of one length)."""
    count, n = windows.shape
    steps = np.arange(n + 1)
    row = np.tile(steps, (count, 1))
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (items[:, i : i + 1] != windows))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


def nearest_windows(stretches: np.ndarray, items: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: least word edit distance of any window of the stretch to the item, and where the first such window begins.

    ``lead`` words of a stretch stand before the document; no window begins there. The program runs from
    the end, with the windows' ends free, so its last row holds the distance for each beginning.
    """
    (count, width), n = stretches.shape, items.shape[1]
    steps = np.arange(width + 1, dtype=np.int16 if n + width < 1 << 14 else np.int64)
    back, row = np.ascontiguousarray(stretches[:, ::-1]), np.zeros((count, width + 1), steps.dtype)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (items[:, n - 1 - i : n - i] != back), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    row = row[:, ::-1].copy()
    row[steps < lead[:, None]] = n + 1
    first = row.argmin(axis=1)
    return row[np.arange(count), first], first


def _nearest(words: np.ndarray, index: Index, rows: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, distance, first word) of the nearest windows round the beginnings ``starts`` of the items ``rows`` of one length.

    ``begins`` and ``ends`` are those of the texts, which stand in ``words`` one after the other.
    """
    n, k = len(index.items[rows[0]]), index.bounds[rows[0]]
    around, at_once = np.arange(-k, n + k), max(1, 500_000 // (n + 2 * k))
    for at in range(0, len(rows), at_once):
        part, begin = rows[at : at + at_once], starts[at : at + at_once]
        places = begin[:, None] + around
        stretches = np.where((places >= 0) & (places < ends[at : at + at_once, None]), words[np.clip(places, 0, len(words) - 1)], -1)
        lead = np.maximum(0, begins[at : at + at_once] - (begin - k))
        distances, first = nearest_windows(stretches, np.array([index.items[i] for i in part]), lead)
        for j, (d, place) in enumerate(zip(distances.tolist(), (begin + around[np.minimum(first, n + 2 * k - 1)]).tolist())):
            yield at + j, d, place


def _fixed(words: np.ndarray, index: Index, rows: np.ndarray, starts: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The same of windows of the item's length alone."""
    n, k = len(index.items[rows[0]]), index.bounds[rows[0]]
    for row in range(len(rows)):
        places = np.arange(max(begins[row], starts[row] - k), min(starts[row] + k, ends[row] - n) + 1)
        if len(places):
            distances = edit_distances(words[places[:, None] + np.arange(n)], np.tile(index.items[rows[row]], (len(places), 1)))
            best = int(distances.argmin())
            yield row, int(distances[best]), int(places[best])


def leaks(texts: list[str | None], index: Index, any_length: bool = False) -> list[list[tuple[int, int, int]]]:
    """For each text its leaked items: (item row, least distance, first window with that distance)."""
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    get, room = index.codes.get, max([3 * len(i) for i in index.items], default=0)
    pieces, begins, ends, at = [], [], [], room
    gap = np.full(room, -1, np.int32)
    for text in texts:  # texts one after the other, further apart than any window reaches
        codes = np.array([get(w, -1) for w in benchmark_words(text)], np.int32)
        pieces += [gap, codes]
        begins.append(at)
        ends.append(at + len(codes))
        at += len(codes) + room
    words, begins, ends = np.concatenate([*pieces, gap]), np.array(begins), np.array(ends)
    rows, starts = candidates(words, index)
    # a window begins in the text that holds the words it was found by
    text_of = np.clip(np.searchsorted(begins - room // 2, starts, "right") - 1, 0, len(texts) - 1)
    size = np.array([len(i) for i in index.items], np.int64)[rows]
    for n in np.unique(size):
        mine = np.flatnonzero(size == n)
        t = text_of[mine]
        for j, d, place in (_nearest if any_length else _fixed)(words, index, rows[mine], starts[mine], begins[t], ends[t]):
            item, text = int(rows[mine[j]]), int(t[j])
            if d <= index.bounds[item]:
                here = (d, int(place - begins[text]))
                found[text][item] = min(found[text].get(item, here), here)
    return [[(item, *best) for item, best in one.items()] for one in found]


def benchmark_slices(benchmark: DataFrame, items_at_once: int = ITEMS_AT_ONCE) -> Iterator[tuple[Index, list[str]]]:
    """Indexes over slices of the benchmark's different texts, each of a bounded size, and those texts.

    An index's ids are places in the list. Equal rows are grouped in Spark first, so however often a row repeats, it comes once.
    """
    texts = benchmark.select("text").where("text is not null").distinct()
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    slices = max(1, -(-size["n"] // items_at_once), -(-size["chars"] // CHARS_AT_ONCE))
    for k in range(slices):
        part = sorted(r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect())
        yield build_index(list(enumerate(part))), part


LEAK_TYPE = "array<struct<item_row:int,distance:int,first_word:long>>"


def leaks_udf(index: Index, any_length: bool = False):
    @pandas_udf(LEAK_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), 2000):
                for rows in leaks(batch[at : at + 2000].tolist(), index, any_length):
                    out.append([{"item_row": i, "distance": d, "first_word": s} for i, d, s in sorted(rows)])
            yield pd.Series(out, dtype=object)

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, any_length: bool = False) -> DataFrame:
    """documents, benchmark -> (doc_id, item_id, distance, first_word), a row for each document and leaked item.

    ``distance`` is the least word edit distance of a window to the item, ``first_word`` the first
    such window's place; windows have the item's length, or ``any_length``. Null and empty texts, and items
    without words, match nothing; a null doc_id or item_id stays null. Repeated documents and items give a
    row each, equal items the same distance. Very long texts are read whole. Empty tables give no rows;
    other columns play no part.
    """
    out = None
    for index, texts in benchmark_slices(benchmark):
        found = docs.select("doc_id", F.explode(leaks_udf(index, any_length)("text")).alias("leak"))
        found = found.select("doc_id", F.col("leak.item_row").alias("item_row"), F.col("leak.distance").alias("distance"), F.col("leak.first_word").alias("first_word"))
        # a slice has at most ITEMS_AT_ONCE different texts; the rows of a text, however many, meet its leaks in Spark
        known = docs.sparkSession.createDataFrame([(row, texts[i]) for row, held in enumerate(index.ids) for i in held], "item_row int, item_text string")
        known = benchmark.select("item_id", F.col("text").alias("item_text")).join(F.broadcast(known), "item_text")
        part = found.join(known, "item_row").select("doc_id", "item_id", "distance", "first_word")
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, any_length: bool = False) -> DataFrame:
    """The documents in which no benchmark item is leaked, with all their columns.

    Decided by each row's text alone: null and empty texts stay, rows that repeat an id or a text are judged each
    by itself. Without items nothing goes; an empty table stays empty.
    """
    for index, _ in benchmark_slices(benchmark):
        docs = docs.where(F.size(leaks_udf(index, any_length)("text")) == 0)
    return docs


def op1(spark, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_length=True)
