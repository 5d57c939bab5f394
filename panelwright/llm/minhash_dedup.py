"""MinHash near-duplicates: one-permutation hashing, banded buckets, stars of candidates, exact links, components.

A text's set of word shingles is hashed once; the hashes are dealt to bins and each bin keeps its least
hash. An empty bin borrows from a bin that is not empty, which one a hash of (bin, attempt) decides, so
that two sets borrow alike (optimal densification). Bands of bins name buckets.

Within a bucket texts are compared with a centre, not with each other. The comparison is on full sets
and keeps what a text lacks of its centre and what it has besides. That decides the other pairs of the
bucket, since the difference of two texts follows from their differences to the centre: texts linked to
the centre are one component already, and a text without that link can reach another only through
differences that both share (see ``_through_centres``). Texts far from their centre go on to a round
with other centres. So no bucket is expanded into pairs, and no link is lost in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import materialize
from .components import connected_components

SHINGLE = 3
BANDS, ROWS = 25, 5
#: A link: 100 * intersection >= LEAST * union.
LEAST = 85
#: Distances to a centre (1 - Jaccard, in hundredths): up to NEAR a text's links are decided through it, with texts up to NEAR + 15.
NEAR = 65
#: Texts that one task compares with a centre.
BLOCK = 256
#: Texts that may remain of a bucket to be compared with each other.
REST = 64
FLUSH = 300_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[3]
    h = (h ^ (h >> np.uint64(27))) * _MIX[4]
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash, kept for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def shingles(text: str | None, words: Words, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; fewer words than ``width``: one, of all words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([words[w] for w in found], np.uint64)
    size = min(width, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total * _MIX[0] + h[k : k + len(total)])
    return np.unique(total)


def _borrowing(bins: int, attempts: int = 64) -> np.ndarray:
    """(bin, attempt) -> the bin to look at."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * _MIX[1] + np.arange(attempts, dtype=np.uint64)[None] * _MIX[2]
    return (_mixed(at) % np.uint64(bins)).astype(np.int64)


def signature(found: np.ndarray, bins: int = BANDS * ROWS, borrow: np.ndarray | None = None) -> np.ndarray:
    """The least hash of each bin of a set that is not empty; empty bins borrow."""
    borrow = _borrowing(bins) if borrow is None else borrow
    mixed = _mixed(found + _MIX[2])
    at = (mixed % np.uint64(bins)).astype(np.int64)
    least = np.full(bins, ~np.uint64(0))
    np.minimum.at(least, at, mixed)
    full = np.zeros(bins, bool)
    full[at] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = full[borrow[empty]]
        hit = tries.argmax(axis=1)
        source = borrow[empty, hit]
        lost = ~tries.any(axis=1)  # no attempt hit a full bin: the next full one
        if lost.any():
            held = np.flatnonzero(full)
            source[lost] = held[np.searchsorted(held, empty[lost]) % len(held)]
        least[empty] = least[source]
    return least


def band_keys(sign: np.ndarray, bands: int = BANDS) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) * _MIX[0]
    for column in sign.reshape(bands, -1).T:
        keys = _mixed(keys + column) * _MIX[1]
    return keys.view(np.int64)


@pandas_udf(T.StructType([T.StructField("set", T.StringType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def sketch_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    words, borrow = Words(), _borrowing(BANDS * ROWS)
    for batch in texts:
        rows = []
        for text in batch:
            found = shingles(text, words)
            rows.append((xxhash.xxh3_128_hexdigest(found.tobytes()), len(found), band_keys(signature(found, BANDS * ROWS, borrow))) if len(found) else (None, 0, None))
        yield pd.DataFrame(rows, columns=["set", "n", "bands"])


def _mask(entries: np.ndarray) -> np.ndarray:
    """256 bits, one set for each entry."""
    out = np.zeros(4, np.uint64)
    at = entries.view(np.uint64)
    np.bitwise_or.at(out, (at & np.uint64(3)).astype(np.int64), np.uint64(1) << (at >> np.uint64(2) & np.uint64(63)))
    return out.view(np.int64)


def _compare(keep_sets: bool):
    """A centre (kind 0) comes before its texts (kind 1): counts, and the entries in which each differs from the centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, own = Words(), np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for a, kind, b, text in zip(batch["a"], batch["kind"], batch["b"], batch["text"]):
                if kind == 0:
                    own = shingles(text, words)
                    continue
                other = shingles(text, words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                union = len(own) + len(other) - both
                zone = keep_sets and 100 * (union - both) <= (NEAR + 100 - LEAST) * union
                differ = np.setxor1d(own, other, assume_unique=True).view(np.int64) if zone else None
                out.append((a, b, len(other), len(own) - both, len(other) - both, 100 * both >= LEAST * union, 100 * (union - both) <= NEAR * union, differ, _mask(differ) if zone else None))
            yield pd.DataFrame(out, columns=["a", "b", "n", "n_lost", "n_added", "linked", "near", "differ", "mask"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, keep_sets: bool) -> DataFrame:
    """(a, b) -> (a, b, n, n_lost, n_added, linked, near, differ, mask), on the full sets of both texts.

    The pairs of a centre ``a`` are dealt to blocks, each of which gets the centre's text once. ``differ`` (only with
    ``keep_sets``, and not for texts far from their centre) are the shingles that one of the two has and the other lacks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = materialize(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "star-pairs")
    centres = dealt.select("a", "block").distinct().join(texts, F.col("a") == F.col("node")).select("a", "block", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("node")).select("a", "block", F.lit(1).alias("kind"), "b", "text")
    rows = centres.unionByName(others).repartition("a", "block").sortWithinPartitions("a", "block", "kind")
    done = rows.select("a", "kind", "b", "text").mapInPandas(
        _compare(keep_sets), "a long, b long, n long, n_lost long, n_added long, linked boolean, near boolean, differ array<long>, mask array<long>"
    )
    return materialize(done, "compared")


def _through_centres(marks: DataFrame) -> DataFrame:
    """Pairs (x, m, slack) of texts compared with one centre that may be linked though x is not linked to the centre; less slack is likelier.

    Let d be the entries in which a text differs from the centre and o those that x and m share; x and m
    then differ in d(x) + d(m) - 2 o shingles, and a link asks 185 * that <= 15 * (n(x) + n(m)). One of the two, x, is not
    linked to the centre, which is why that needs more than about half of m's entries. So x shares one of m's first
    d(m) - need + 1 entries, in whatever order, and the order is from the rarest: most entries stand in one text alone and meet
    nobody. Of the pairs that meet, those go whose masks show that m has more than d(m) - need entries that x lacks.
    """
    marks = marks.where("differ is not null")
    marks = marks.join(marks.where("not linked").select("a").distinct(), "a", "left_semi")
    entries = marks.select("a", "b", F.explode("differ").alias("entry"))
    common = entries.groupBy("a", "entry").agg(F.count("*").alias("often")).where("often > 1")
    shared = entries.join(common, ["a", "entry"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct(F.col("often").cast("int").alias("often"), "entry"))).alias("shared"))
    facts = ["n", (F.col("n_lost") + F.col("n_added")).alias("d"), F.abs(F.col("n_lost") - F.col("n_added")).alias("g"), "linked", "mask"]
    shared = materialize(marks.select("a", "b", *facts).join(shared, ["a", "b"]), "near-entries")

    def side(df: DataFrame, name: str, *more) -> DataFrame:
        return df.select("a", *more, *[F.col(c).alias(f"{name}_{c}") for c in ("b", "n", "d", "mask")])

    alone = F.col("d") - F.size("shared")  # entries of this text only come first
    few = F.floor(F.col("d") / 2 + F.col("g") / 20 + 2) - alone
    m = side(shared.where(few > 0).select("*", F.posexplode(F.slice("shared", F.lit(1), few.cast("int"))).alias("at", "e")).withColumn("rank", F.col("at") + 1 + alone), "m", F.col("e.entry").alias("entry"), "rank")
    x = side(shared.where("not linked").select("*", F.explode("shared").alias("e")), "x", F.col("e.entry").alias("entry"))
    need = F.ceil(((100 + LEAST) * (F.col("x_d") + F.col("m_d")) - (100 - LEAST) * (F.col("x_n") + F.col("m_n"))) / (2 * (100 + LEAST)))
    lacks = sum((F.bit_count(F.get("m_mask", F.lit(k)).bitwiseAND(F.bitwise_not(F.get("x_mask", F.lit(k))))) for k in range(1, 4)), F.bit_count(F.get("m_mask", F.lit(0)).bitwiseAND(F.bitwise_not(F.get("x_mask", F.lit(0))))))
    pairs = x.join(m, ["a", "entry"]).where((F.col("rank") <= F.col("m_d") - need + 1) & (F.col("x_b") != F.col("m_b")) & (lacks <= F.col("m_d") - need))
    pairs = pairs.groupBy(F.col("x_b").alias("x"), F.col("m_b").alias("m")).agg(F.min(lacks - F.col("m_d") + need).alias("slack"))
    return materialize(pairs, "near-through")


def _roots(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links), "near-roots")


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select("a", "b")


def _with_likely(links: DataFrame, likely: DataFrame, texts: DataFrame) -> DataFrame:
    """``links`` and those among the likely pairs, as far as components need them: each text's likeliest pair first, then all
    pairs whose ends are still apart."""
    best = likely.groupBy(F.col("x").alias("a")).agg(F.min_by("m", F.struct("slack", "m")).alias("b"))
    links = materialize(links.unionByName(_links(compare(best, texts, False))), "near-links")
    if not likely.head(1):
        return links
    roots = _roots(links)
    for end in ("x", "m"):
        likely = likely.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    apart = likely.where("x_root <> m_root").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()
    return materialize(links.unionByName(_links(compare(apart, texts, False))), "near-links")


def text_links(buckets: DataFrame, texts: DataFrame, rest: int = REST) -> DataFrame:
    """(key, node, n), a written table -> links (a, b) that span the components of the texts that share a bucket.

    Each round takes one centre a bucket, later four, sixteen and so on: first the text that shares most
    buckets with others, then any. A bucket is done when all that remains of it is one component; a remainder of at
    most ``rest`` texts is compared text by text.
    """
    counts = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    active = buckets.join(counts, "key")
    shared = active.groupBy("node").agg(F.sum("size").alias("shared"))
    active = materialize(active.join(shared, "node").select("key", "node", "n", "shared"), "near-active")
    spread, links = 0, buckets.sparkSession.createDataFrame([], "a long, b long")
    while active.head(1):
        if not spread:
            centres = active.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("shared", "node")).alias("centre"))
        else:
            sizes = active.groupBy("key").agg(F.count("*").alias("size"))
            sized = active.join(sizes, "key")
            small = sized.where(F.col("size") <= rest).select("key", "node", "n", "root")
            other = small.select("key", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("root").alias("b_root"))
            pairs = small.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("b_root")) & (100 * F.least("n", "b_n") >= LEAST * F.greatest("n", "b_n")))
            links = materialize(links.unionByName(_links(compare(pairs.select(F.col("node").alias("a"), "b").distinct(), texts, False))), "near-links")
            active = materialize(sized.where(F.col("size") > rest), "near-active")
            if not active.head(1):
                return links
            drawn = active.where(F.pmod(F.xxhash64("node", F.lit(spread)), F.ceil(F.col("size") / 4**spread)) == 0)
            centres = drawn.select("key", F.struct("node", "n").alias("centre"))
        centres = materialize(centres.select("key", F.col("centre.node").alias("c"), F.col("centre.n").alias("c_n")), "near-centres")
        zone = LEAST - NEAR  # least similarity, in hundredths, at which differences are kept
        apart = active.join(centres, "key").where((F.col("node") != F.col("c")) & (100 * F.least("n", "c_n") >= zone * F.greatest("n", "c_n")))
        marks = compare(apart.select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), texts, True)
        links = _with_likely(links.unionByName(_links(marks)), _through_centres(marks), texts)
        done = apart.join(marks.where("near").select(F.col("a").alias("c"), F.col("b").alias("node")), ["c", "node"]).select("key", "node")
        done = done.unionByName(centres.select("key", F.col("c").alias("node"))).distinct()
        left = active.select("key", "node", "n").join(done, ["key", "node"], "left_anti").join(_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = materialize(left, "near-left")
        open_keys = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        active, spread = materialize(left.join(open_keys, "key", "left_semi"), "near-active"), spread + 1
    return links


def minhash_groups(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id that a document reaches over links, itself included; ``kept``
    marks the documents whose own id that is. Null, empty and word-free texts have no shingles and are
    linked with nothing. Equal sets are one class from the start; rows that repeat an id or a text are each returned. A null doc_id gets the smallest
    id of its group, and null (and is kept) where the group has none. An empty table gives no rows; texts
    are read whole; other columns play no part.
    """
    sketched = materialize(docs.select("doc_id", "text", sketch_udf("text").alias("s")).select("doc_id", "text", "s.*"), "sketches")
    nodes = sketched.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select(F.explode("bands").alias("key"), "node", "n")
    several = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = materialize(buckets.join(several, "key"), "near-buckets")
    candidates = nodes.select("set", "node").join(buckets.select("node").distinct(), "node")
    texts = sketched.select("set", "text").join(candidates, "set").groupBy("node").agg(F.first("text").alias("text"))
    roots = _roots(text_links(buckets, materialize(texts, "near-texts")))
    rooted = materialize(nodes.select("set", "node", "least").join(roots, "node", "left").select("set", "least", F.coalesce("root", "node").alias("root")), "near-rooted")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    alone = sketched.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = sketched.where("n > 0").select("doc_id", "set", F.col("n").alias("n_shingles")).join(classes, "set").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


op11 = minhash_groups


def op11_sql() -> str:
    """The same in SQL by brute force: pairs that share a shingle, their intersections, and reachability."""
    return f"""
with w as materialized (select row_number() over () id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s0 as (select id, doc_id, case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) end s from w),
s as materialized (select id, doc_id, s, len(s) n, hash(list_sort(s)) k from s0),
k as materialized (select k, n, min(id) id, any_value(s) s from s where n > 0 group by 1, 2),
g as materialized (select id, n, unnest(s) g from k),
p as (select a.id a, b.id b from g a join g b on a.g = b.g and a.id < b.id and 100 * least(a.n, b.n) >= {LEAST} * greatest(a.n, b.n)
    group by a.id, b.id, a.n, b.n having 100 * count(*) >= {LEAST} * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p),
r as (with recursive r(a, b) as (select id, id from k union select r.a, e.b from r join e on r.b = e.a) select a, b from r),
c as (select r.a id, min(s.doc_id) c from r join k on k.id = r.b join s on s.k = k.k and s.n = k.n group by r.a)
select s.doc_id, s.n n_shingles, case when s.n = 0 then s.doc_id else c.c end component_id,
  s.doc_id is not distinct from (case when s.n = 0 then s.doc_id else c.c end) kept
from s left join k on s.n > 0 and s.k = k.k and s.n = k.n left join c on c.id = k.id"""
