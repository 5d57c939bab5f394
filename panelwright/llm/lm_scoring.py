"""LM scoring: a gated recurrent language model with a class-factored softmax, and a unigram base.

Counts of every token over all training documents come first. Tokens then share the model's fixed
number of output buckets: the most frequent words and the end mark have one each, all other words fall
to buckets by their ending, within which they keep their corpus counts. A word's probability is that of
its bucket's class, of the bucket within the class, and of the word within the bucket.

The network learns from all training documents, in whole texts, by backpropagation through windows of
a few steps. The documents are dealt to slices, and those of a slice to units of about equal size; each
unit trains a copy of the network in Spark, and the copies' average begins the next slice. Scoring
carries the hidden state across windows, so each text is scored from its first token to its end mark.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, materialize

#: Output buckets: CLASSES x MEMBERS; OWN words have one of their own, bucket 0 is the end mark.
CLASSES = MEMBERS = 32
OWN = 703
TAIL = CLASSES * MEMBERS - 1 - OWN
HIDDEN, WINDOW, LANES, EPOCHS = 24, 16, 192, 5
#: Tokens of a unit (enough that its longest texts leave all lanes filled), and slices of a corpus that fills more than one unit; every slice holds more units as the corpus grows.
UNIT_TOKENS, SLICES = 2_000_000, 8
#: A corpus of fewer tokens is gone through several times, up to EPOCHS.
PASS_TOKENS = 1_250_000
#: Documents and characters that one task scores together.
CHUNK_DOCS, CHUNK_CHARS = 4096, 16_000_000
HELD_OUT = 2  # crc32(doc_id) mod 7 of the documents that the model never sees
FLUSH = 300_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_bucket(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-2:]) % TAIL


class Room(dict):
    """Memory that the windows of a run share by name: fresh arrays of this size cost more in page faults than their sums."""

    def __call__(self, name: str, *shape: int, dtype: type = np.float32) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or self[name].size < size:
            self[name] = np.empty(size, dtype)
        return self[name][:size].reshape(shape)


@dataclass
class Model:
    own: dict[bytes, int]
    mass: np.ndarray  # of each bucket: sum of (count + 1) of its words, and 1 for the unseen
    place: np.ndarray  # bucket -> place in the factored output
    wx: np.ndarray
    urz: np.ndarray
    un: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wm: np.ndarray
    bm: np.ndarray

    def forward(self, x: np.ndarray, h: np.ndarray, cuts: list, room: Room, keep: bool = True) -> tuple[np.ndarray, ...]:
        """The steps (rows of input buckets ``x``) from states ``h``: states before, gates r and z, candidates, r times state, states after.

        States stand as (unit, lane), so that every gate is one block of memory. Before a step whose cut is
        not None, the states are multiplied by it: 0 where a text begins. The arrays stand in ``room`` until
        its next window; without ``keep``, all but the states after hold the last step alone.
        """
        (steps, lanes), size = x.shape, len(h)
        rows = np.take(self.wx, x.ravel(), axis=0, out=room("rows", steps * lanes, 3 * size), mode="clip")
        gates = room("gates", steps, 3 * size, lanes)
        np.copyto(gates, rows.reshape(steps, lanes, 3 * size).transpose(0, 2, 1))
        u, un, one, kept = np.ascontiguousarray(-self.urz.T), np.ascontiguousarray(self.un.T), np.float32(1), steps if keep else 1
        prev, n, held = (room(name, kept, size, lanes) for name in ("prev", "n", "held"))
        rz, new = room("rz", kept, 2 * size, lanes), room("new", steps, size, lanes)
        with np.errstate(over="ignore"):  # an overflow gives a gate of 0
            for t in range(steps):
                k = t if keep else 0
                if cuts[t] is not None:
                    h = np.multiply(h, cuts[t], out=prev[k])
                elif keep:
                    prev[k] = h
                a = np.matmul(u, h, out=rz[k])
                a -= gates[t, : 2 * size]
                np.exp(a, out=a)
                a += one
                np.reciprocal(a, out=a)
                m = np.matmul(un, np.multiply(a[:size], h, out=held[k]), out=n[k])
                m += gates[t, 2 * size :]
                np.tanh(m, out=m)
                h = np.subtract(h, m, out=new[t])
                h *= a[size:]
                h += m
        return prev, rz, n, held, new

    def log_probability(self, h: np.ndarray, y: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Natural logarithm of the probability of bucket ``y`` (rows) in state ``h``."""
        out = self._output(h, y, room or Room())
        logs = out.classes[out.rows, out.group] + out.members[out.rows, out.member]
        for logits in (out.classes, out.members):
            logs -= np.log(np.exp(logits, out=logits) @ _ONES)
        unsorted = np.empty(len(y), np.float32)
        unsorted[out.order] = logs
        return unsorted

    def _output(self, h: np.ndarray, y: np.ndarray, room: Room) -> Output:
        """Logits of the classes, and of the members of each row's class."""
        order, cuts, group, member, rows = _by_class(self.place[y])
        ones = room("states by class", len(h), h.shape[1] + 1)  # a last column of ones meets the biases
        ones[:, :-1] = np.take(h, order, axis=0, out=room("by class", *h.shape), mode="clip")
        ones[:, -1] = 1
        classes = np.matmul(ones, np.vstack([self.wc, self.bc]), out=room("classes", len(h), CLASSES))
        members, wide = room("members", len(h), MEMBERS), np.concatenate([self.wm, self.bm[:, None]], axis=1)
        for c in range(CLASSES):
            if cuts[c + 1] > cuts[c]:
                np.matmul(ones[cuts[c] : cuts[c + 1]], wide[c], out=members[cuts[c] : cuts[c + 1]])
        return Output(order, cuts, group, member, rows, ones, _bounded(classes), _bounded(members))


@dataclass
class Output:
    """Logits of some rows, which stand by class: their order, where each class begins, class and member of the target, states and a one."""

    order: np.ndarray
    cuts: list[int]
    group: np.ndarray
    member: np.ndarray
    rows: np.ndarray
    states: np.ndarray
    classes: np.ndarray
    members: np.ndarray


_ONES = np.ones(MEMBERS, np.float32)


def _bounded(logits: np.ndarray) -> np.ndarray:
    """In place: far inside the range whose exponentials fit float32."""
    return np.clip(logits, -60, 60, out=logits)


def _by_class(at: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Rows put in order of their class: order, where each class begins, classes, members and row numbers."""
    order = np.argsort((at // MEMBERS).astype(np.int16), kind="stable")
    at = at[order]
    group = at // MEMBERS
    return order, np.searchsorted(group, np.arange(CLASSES + 1)).tolist(), group, at % MEMBERS, np.arange(len(at))


def _log_sum(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    return top + np.log(np.exp(logits - top[:, None]).sum(axis=1))


def new_model(own: dict[bytes, int], mass: np.ndarray, hidden: int = HIDDEN, seed: int = 3) -> Model:
    """Untrained model whose output starts at the buckets' corpus frequencies."""
    rng, n = np.random.default_rng(seed), CLASSES * MEMBERS
    order = np.argsort(-mass, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    share = np.log(mass[order] / mass.sum()).reshape(CLASSES, MEMBERS)
    draw = lambda *shape: rng.normal(0, hidden**-0.5, shape).astype(np.float32)
    return Model(
        own, mass, place, 0.3 * draw(n, 3 * hidden), draw(hidden, 2 * hidden), draw(hidden, hidden), 0.1 * draw(hidden, CLASSES),
        _log_sum(share).astype(np.float32), 0.1 * draw(CLASSES, hidden, MEMBERS), share.astype(np.float32),
    )


def _lanes(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, longest first."""
    load, dealt = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        k = int(load.argmin())
        dealt[k].append(int(i))
        load[k] += lengths[i]
    return dealt


def _streams(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps x lanes) input buckets, target buckets and text numbers (-1: none). A text begins after an end mark."""
    dealt = _lanes(np.array([len(t) for t in texts]), lanes)
    steps = max(sum(len(texts[i]) for i in lane) for lane in dealt)
    x, y, of = np.zeros((steps, lanes), np.int32), np.zeros((steps, lanes), np.int32), np.full((steps, lanes), -1, np.int32)
    for k, lane in enumerate(dealt):
        at = 0
        for i in lane:
            n = len(texts[i])
            y[at : at + n, k], of[at : at + n, k] = texts[i], i
            x[at + 1 : at + n, k] = texts[i][:-1]
            at += n
    return x, y, of


NAMES = ("wx", "urz", "un", "wc", "bc", "wm", "bm")


def weights(model: Model) -> np.ndarray:
    return np.concatenate([getattr(model, n).ravel() for n in NAMES])


def with_weights(model: Model, flat: np.ndarray) -> Model:
    """The model with its arrays as views of ``flat``."""
    return replace(model, **_views(model, flat))


def _views(model: Model, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in NAMES:
        shape, size = getattr(model, n).shape, getattr(model, n).size
        out[n] = flat[at : at + size].reshape(shape)
        at += size
    return out


def train(model: Model, texts: list[np.ndarray], rate: float, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Weights after one pass of Adam over windows of the lanes; states pass from window to window, gradients don't."""
    lengths = np.array([len(t) for t in texts])
    # few enough lanes that the longest text fills no more than its share, and that a small corpus still has many updates
    lanes = int(np.clip(min(lengths.sum() // lengths.max(), lengths.sum() // (200 * window)), 1, min(lanes, len(texts))))
    window = max(window, min(128, LANES * WINDOW // lanes))  # fewer lanes, longer windows
    x, y, of = _streams(texts, lanes)
    begins = np.vstack([np.ones((1, lanes), bool), of[1:] != of[:-1]])
    starts, stays = begins.any(axis=1), (~begins).astype(np.float32)
    flat = weights(model)
    model, grad = with_weights(model, flat), np.zeros_like(flat)
    first, second, grads = np.zeros_like(flat), np.zeros_like(flat), _views(model, grad)
    size, room = model.urz.shape[0], Room()
    h, one = np.zeros((size, lanes), np.float32), np.float32(1)
    for count, at in enumerate(range(0, len(x), window), 1):
        steps = min(window, len(x) - at)
        cuts = [stays[t] if starts[t] else None for t in range(at, at + steps)]
        prev, rz, n, held, states = model.forward(x[at : at + steps], h, cuts, room)
        r, z, h = rz[:, :size], rz[:, size:], states[-1].copy()  # its place is the next window's
        grad[:] = 0
        real = (of[at : at + steps].ravel() >= 0).astype(np.float32) / (steps * lanes)
        by_row, back = _output_gradient(model, _rows(states, room), y[at : at + steps].ravel(), real, grads, room), room("back by step", steps, size, lanes)
        np.copyto(back, by_row.reshape(steps, lanes, size).transpose(0, 2, 1))
        to_n, to_r, to_z, spare = (room(name, steps, size, lanes) for name in ("to n", "to r", "to z", "spare"))
        np.multiply(np.subtract(one, np.multiply(n, n, out=to_n), out=to_n), np.subtract(one, z, out=spare), out=to_n)
        np.multiply(np.multiply(np.subtract(prev, n, out=to_z), z, out=to_z), spare, out=to_z)
        np.multiply(np.multiply(prev, r, out=to_r), np.subtract(one, r, out=spare), out=to_r)
        d, gates = np.zeros((size, lanes), np.float32), room("gates", steps, 3 * size, lanes)
        dheld, drz = room("dheld", size, lanes), room("drz", size, lanes)
        for t in range(steps - 1, -1, -1):
            d += back[t]
            g = gates[t]
            np.matmul(model.un, np.multiply(d, to_n[t], out=g[2 * size :]), out=dheld)
            np.multiply(dheld, to_r[t], out=g[:size])
            np.multiply(d, to_z[t], out=g[size : 2 * size])
            d *= z[t]
            dheld *= r[t]
            d += dheld
            d += np.matmul(model.urz, g[: 2 * size], out=drz)
            if cuts[t] is not None:
                d *= cuts[t]
        grads["un"] += np.matmul(held, gates[:, 2 * size :].transpose(0, 2, 1)).sum(0)
        grads["urz"] += np.matmul(prev, gates[:, : 2 * size].transpose(0, 2, 1)).sum(0)
        held_words = x[at : at + steps].ravel()
        by_word = np.argsort(held_words.astype(np.int16), kind="stable")
        begun = np.flatnonzero(np.diff(held_words[by_word], prepend=-1))
        sorted_rows = np.take(_rows(gates, room), by_word, axis=0, out=room("by word", steps * lanes, 3 * size), mode="clip")
        grads["wx"][held_words[by_word[begun]]] += np.add.reduceat(sorted_rows, begun, axis=0)
        step, root = room("step", len(flat)), room("root", len(flat))
        first += np.multiply(np.subtract(grad, first, out=step), np.float32(0.1), out=step)
        second += np.multiply(np.subtract(np.multiply(grad, grad, out=step), second, out=step), np.float32(0.001), out=step)
        np.sqrt(np.divide(second, np.float32(1 - 0.999**count), out=root), out=root)
        root += np.float32(1e-8)
        flat -= np.divide(np.multiply(first, np.float32(rate / (1 - 0.9**count)), out=step), root, out=step)
    return flat


def _rows(states: np.ndarray, room: Room) -> np.ndarray:
    """(step, unit, lane) -> a row for each step and lane."""
    steps, size, lanes = states.shape
    out = room("rows", steps * lanes, size)
    np.copyto(out.reshape(steps, lanes, size), states.transpose(0, 2, 1))
    return out


def _output_gradient(model: Model, h: np.ndarray, y: np.ndarray, weight: np.ndarray, grads: dict, room: Room) -> np.ndarray:
    """Gradient of the weighted negative log-likelihood by the states; adds those of the output layers."""
    out = model._output(h, y, room)
    weight = weight[out.order]
    for logits, target in ((out.classes, out.group), (out.members, out.member)):  # logits become gradients
        np.exp(logits, out=logits)
        logits *= (weight / (logits @ _ONES))[:, None]
        logits[out.rows, target] -= weight
    of_classes = out.states.T @ out.classes
    grads["wc"] += of_classes[:-1]
    grads["bc"] += of_classes[-1]
    back, part = np.matmul(out.classes, model.wc.T, out=room("by class", *h.shape)), room("part", *h.shape)
    of_members = np.zeros((CLASSES, h.shape[1] + 1, MEMBERS), np.float32)
    for c in range(CLASSES):
        a, b = out.cuts[c], out.cuts[c + 1]
        if b > a:
            np.matmul(out.states[a:b].T, out.members[a:b], out=of_members[c])
            np.matmul(out.members[a:b], model.wm[c].T, out=part[a:b])
    grads["wm"] += of_members[:, :-1]
    grads["bm"] += of_members[:, -1]
    back += part
    unsorted = room("back", *h.shape)
    unsorted[out.order] = back
    return unsorted


def score_texts(model: Model, texts: list[np.ndarray], window: int = 16) -> np.ndarray:
    """Natural log-likelihood of the buckets of each text; the state runs through all its windows."""
    if not texts:
        return np.empty(0)
    lengths = np.array([len(t) for t in texts])
    lanes = int(np.clip(lengths.sum() // max(1, lengths.max()), 1, min(384, len(texts))))
    x, y, of = _streams(texts, lanes)
    begins = np.vstack([np.ones((1, lanes), bool), of[1:] != of[:-1]])
    starts, stays = begins.any(axis=1), (~begins).astype(np.float32)
    size, room = model.urz.shape[0], Room()
    out, h = np.zeros(len(texts)), np.zeros((size, lanes), np.float32)
    for at in range(0, len(x), window):
        end = min(at + window, len(x))
        states = model.forward(x[at:end], h, [stays[t] if starts[t] else None for t in range(at, end)], room, keep=False)[-1]
        h, here = states[-1].copy(), of[at:end].ravel()
        real = np.flatnonzero(here >= 0)
        of_real = np.take(_rows(states, room), real, axis=0, out=room("real", len(real), size), mode="clip")
        out += np.bincount(here[real], model.log_probability(of_real, y[at:end].ravel()[real], room), len(texts))
    return out


def _chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents with ``chunk``, and the number of chunks: neighbours by id together.

    Where ids crowd unevenly (null or equal ids among them), rows are written once with a chunk dealt by
    row, so that no chunk holds more than its share, equal rows or not. Which way it goes moves scores
    only in the digits that float32 sums of other batches move.
    """
    shape = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    chunks = max(1, -(-shape["n"] // CHUNK_DOCS), -(-shape["chars"] // CHUNK_CHARS))
    if shape["lo"] is not None:
        width = (shape["hi"] - shape["lo"]) // chunks + 1
        by_id = F.floor((F.col("doc_id") - F.lit(shape["lo"])) / width) if width < 1 << 52 else F.lit(None).cast("long")
        near = docs.withColumn("chunk", F.coalesce(by_id, F.lit(0)).cast("long"))
        fullest = near.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).agg(F.max("n").alias("n"), F.max("chars").alias("chars")).first()
        if fullest["n"] <= 3 * CHUNK_DOCS and (fullest["chars"] or 0) <= 3 * CHUNK_CHARS:
            return near, chunks
    return materialize(docs.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks))), "dealt"), chunks


def _dictionary_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(chunk, token, n): the tokens of each chunk with their count in its training documents."""
    held: dict[int, Counter] = {}
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        for chunk, counts in held.items():
            yield pd.DataFrame({"chunk": chunk, "token": list(counts), "n": list(counts.values())})
        held.clear()

    for batch in batches:
        for chunk, unseen, text in zip(batch["chunk"], batch["held_out"], batch["text"]):
            counts = held.setdefault(chunk, Counter())
            before = len(counts)
            found = tokens(text)
            if unseen:
                for w in found:
                    counts.setdefault(w, 0)
            else:
                counts.update(found)
            size += len(counts) - before
        if size > FLUSH:
            yield from flush()
            size = 0
    yield from flush()


@dataclass
class Corpus:
    """Totals of the training tokens, the end mark included."""

    n: int
    distinct: int
    n_docs: int


def count_tokens(docs: DataFrame) -> tuple[DataFrame, Corpus]:
    """Chunked documents -> (chunk, token, c, first) over all training documents, and the totals.

    A token has a row for each chunk that holds it, so a frequent token has as many rows as there are
    chunks and not as many as documents.
    """
    rows = docs.select("chunk", "held_out", "text").mapInPandas(_dictionary_batches, "chunk long, token binary, n long")
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    of_token = Window.partitionBy("token")
    rows = rows.select("chunk", "token", "n", F.sum("n").over(of_token).alias("c"), (F.min("id").over(of_token) == F.col("id")).alias("first"))
    rows = materialize(rows, "token-counts")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).first()
    n_docs = docs.where(~F.col("held_out")).count()
    return rows, Corpus(total["n"] + n_docs, total["v"] + (n_docs > 0), n_docs)


def _tail_mass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at = np.array([tail_bucket(w) for w in batch["token"]], np.int64)
        mass = np.bincount(at, batch["c"].to_numpy(np.float64) + 1, CLASSES * MEMBERS) if len(at) else np.zeros(CLASSES * MEMBERS)
        held = np.flatnonzero(mass)
        yield pd.DataFrame({"bucket": held, "mass": mass[held]})


def base_model(counts: DataFrame, corpus: Corpus) -> Model:
    """The untrained model: own words are the most frequent ones, all other words keep their counts in buckets."""
    known = counts.where("first and c > 0").select("token", "c")
    top = known.orderBy(F.desc("c"), "token").limit(OWN).collect()
    own = {bytes(r["token"]): 1 + i for i, r in enumerate(top)}
    mass = np.ones(CLASSES * MEMBERS)
    for r in known.mapInPandas(_tail_mass, "bucket long, mass double").groupBy("bucket").agg(F.sum("mass").alias("mass")).collect():
        mass[r["bucket"]] += r["mass"]
    mass[0] += corpus.n_docs + 1
    for r in top:  # own words leave the tail
        word = bytes(r["token"])
        mass[own[word]] += r["c"]
        mass[tail_bucket(word)] -= r["c"] + 1
    return new_model(own, mass)


def _unit_batches(model: Model, rate: float):
    """(unit, n, weights): the weights that a unit's texts make of the model's; a unit's rows follow each other."""

    def trained(unit: int, texts: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"unit": [unit], "n": [sum(map(len, texts))], "weights": [train(model, texts, rate).tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, texts = None, []
        for batch in batches:
            for now, codes in zip(batch["unit"], batch["codes"]):
                if now != unit and texts:
                    yield trained(unit, texts)
                    texts = []
                unit = now
                texts.append(np.frombuffer(codes, np.int16))
        if texts:
            yield trained(unit, texts)

    return run


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """The sum of the weights of a group of units, each by its tokens."""
    part, total = part.sort_values("unit"), 0
    for n, held in zip(part["n"], part["weights"]):
        total = total + n * np.frombuffer(held, np.float32).astype(np.float64)
    return pd.DataFrame({"group": [part["group"].iloc[0]], "n": [part["n"].sum()], "weights": [total.tobytes()]})


def shape_of(corpus: Corpus) -> tuple[int, int]:
    """Slices, and units of each."""
    slices = max(1, min(SLICES, -(-corpus.n // UNIT_TOKENS)))
    return slices, max(1, -(-corpus.n // (slices * UNIT_TOKENS)))


def fit_network(model: Model, coded: DataFrame, corpus: Corpus) -> Model:
    """The model after all training documents: in each pass, every text is in one slice and one unit of it.

    ``coded`` stands in a folder for each slice, which reads its own alone. Slices and units are dealt by a hash of the row
    and, for rows that are equal, of their number within a chunk, so equal rows spread over units. Sums of weights
    meet in groups, as many as the root of the units' number.
    """
    if not corpus.n_docs:
        return model
    slices, units = shape_of(corpus)
    passes = min(EPOCHS, -(-PASS_TOKENS // corpus.n))
    for k in range(passes * slices):
        part = coded.where(F.col("slice") == k % slices).select("unit", "place", "codes").repartition(4 * units, "unit").sortWithinPartitions("unit", "place")
        rate = 0.006 * 0.6 ** (EPOCHS * k / (passes * slices))
        trained = part.select("unit", "codes").mapInPandas(_unit_batches(model, rate), "unit long, n long, weights binary")
        grouped = trained.withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(int(units**0.5) + 1))).groupBy("group")
        sums = sorted(grouped.applyInPandas(_summed, "group long, n long, weights binary").collect(), key=lambda r: r["group"])
        if sums:
            total = sum(np.frombuffer(r["weights"], np.float64) for r in sums) / sum(r["n"] for r in sums)
            model = with_weights(model, total.astype(np.float32))
    return model


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, place long, codes binary"


def _code_chunk(model: Model, corpus: Corpus):
    """Texts of a chunk and the counts of its tokens -> everything that a text's score needs besides the network, and its buckets."""

    def run(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        words = counts["token"].tolist()
        place = dict(zip(words, range(len(words))))
        seen = counts["c"].to_numpy(np.float64)
        bucket = np.array(list(map(model.own.get, words, itertools.repeat(0))), np.int64)
        own = bucket > 0
        tails = np.flatnonzero(~own).tolist()
        bucket[tails] = [tail_bucket(words[i]) for i in tails]
        share = np.where(own, 0.0, np.log(seen + 1) - np.log(model.mass[bucket])) if len(words) else np.empty(0)
        log_seen, known, bucket, out = np.log10(seen + 1), seen > 0, bucket.astype(np.int16), []
        each = np.log10(corpus.n + corpus.distinct + 1)
        again: Counter = Counter()
        for doc_id, held_out, hashed, text in zip(docs["doc_id"].astype(object), docs["held_out"], docs["place"], docs["text"]):
            at = np.array([*map(place.__getitem__, tokens(text))], np.int64)
            base = log_seen[at].sum() + np.log10(corpus.n_docs + 1) - (len(at) + 1) * each
            dealt = zlib.crc32(b"%d %d" % (hashed, again[hashed]))
            again[hashed] += 1
            out.append((doc_id, held_out, len(at) + 1, int(known[at].sum()) + (corpus.n_docs > 0), base, share[at].sum(), dealt, np.append(bucket[at], np.int16(0)).tobytes()))
        out = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inner", "place", "codes"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def code_documents(docs: DataFrame, chunks: int, counts: DataFrame, model: Model, corpus: Corpus) -> DataFrame:
    """Chunked documents -> written rows of CODED with their slice (-1: held out) and unit; texts are cut to tokens here for the last time."""
    # several partitions for each chunk: few partitions get more than one or two chunks by chance
    of_chunk = counts.select("chunk", "token", "c").repartition(4 * chunks, "chunk")
    docs = docs.withColumn("place", F.xxhash64("doc_id", "text")).repartition(4 * chunks, "chunk")
    coded = docs.groupBy("chunk").cogroup(of_chunk.groupBy("chunk")).applyInPandas(_code_chunk(model, corpus), CODED)
    slices, units = shape_of(corpus)
    deal = F.col("place") % (slices * units)
    coded = coded.withColumns({"slice": F.when(F.col("held_out"), F.lit(-1)).otherwise(deal % slices).cast("int"), "unit": F.floor(deal / slices)})
    return materialize(coded, "codes", ["slice"])


def _score_batches(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [np.frombuffer(c, np.int16) for c in batch["codes"]]
            upto = np.cumsum([len(c) for c in codes]) // CHUNK_CHARS  # so many tokens at a time
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(codes)]
            scores = np.concatenate([score_texts(model, codes[a:b]) for a, b in zip(cuts, cuts[1:])])
            yield batch.drop(columns=["codes", "inner"]).assign(score=(batch["inner"].to_numpy() + scores) / np.log(10))

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end mark alone. Rows that repeat an id or a text are each scored (and
    counted, where they are training rows). An empty table gives no rows. Texts are scored whole. A corpus of fewer than PASS_TOKENS
    tokens is gone through several times, a larger one once, in at most SLICES rounds of units.
    """
    docs, chunks = _chunked(docs.select("doc_id", "text"))
    docs = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 7) == HELD_OUT)
    counts, corpus = count_tokens(docs)
    model = base_model(counts, corpus)
    coded = code_documents(docs, chunks, counts, model, corpus)
    model = fit_network(model, coded, corpus)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    rows = coded.select(*columns[:4], F.lit(corpus.n).cast("long").alias("train_tokens"), "base_score", "inner", "codes")
    return rows.mapInPandas(_score_batches(model), ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns) + ", score double")


op3 = score_documents
