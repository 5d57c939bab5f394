"""Mixing sources to target weights, in DataFrame operations alone.

The words of each source stand in one sequence (documents in a hashed order), cut to blocks of fixed
length. The mix is a row of output shards of nearly equal numbers of slots. For every shard, the counts
of the sources are drawn: each gets the whole part of its expectation, and the slots that are left over
are a multinomial draw by the fractions. These counts decide how many slots, and so words, a source has:
its ordinals run on from shard to shard, and each takes the block that a pseudorandom permutation of the
source's block numbers gives for it; ordinals beyond the last block begin a new round of the permutation.
Slots and blocks meet in a join on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16
#: Rows that one window or generator call handles.
BUCKET_DOCS, CHUNK_ROWS = 500, 1 << 14
SEED = 9
ROUNDS = 8


def word_count(text: Column) -> Column:
    """Number of words (null: 0): white-space-separated fields, less the empty ones at either end."""
    text = F.coalesce(text, F.lit(""))
    edges = text.rlike("^" + SPACE_CLASS).cast("int") + text.rlike(SPACE_CLASS + r"\z").cast("int")
    pieces = F.size(F.split(text, SPACE_CLASS))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, 0).otherwise(pieces - edges).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, size) rows -> one row a source: source_no, source, source_size, target.

    Sources in code point order, null last, take the weights in turn. All targets together are all
    words; a target stops at ``max_repeat`` times its source, and the excess is shared by weight among
    the rest. With the sources in order of cap per weight, the capped ones are a prefix, so running
    sums give the share of the rest at once. The table has a row for each source, not for each document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") - 1) % len(weights) + 1)
    totals = totals.withColumn("weight", weight.cast("double")).withColumn("cap", max_repeat * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shared = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    totals = totals.withColumn("level", rest / shared)
    totals = totals.withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return totals.select("source_no", "source", "source_size", target.alias("target"))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Image of ``x`` in [0, n) under a permutation chosen by ``key``: rounds that swap mirror images or not."""

    def swapped(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, key), n) - at, n)
        swap = F.xxhash64(r, F.lit(SEED), key, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), x, swapped)


def _tasks(df: DataFrame) -> int:
    """A given number of partitions keeps what a generator makes spread out, however small its input is."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(docs: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's sequence, and the sources with blocks and expected slots.

    Rows alike in source, id and text follow each other; they are counted before anything is sorted, so a
    bucket holds each of them once.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    base = base.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("copies"))
    base = materialize(base, "sizes")
    buckets = max(1, base.count() // BUCKET_DOCS)
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    held = F.col("size") * F.col("copies")
    sources = source_targets(base.select("source", held.alias("size")))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    sources = sources.withColumn("n_blocks", blocks)
    slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = materialize(sources.withColumn("slots", F.least(slots, (MAX_REPEAT * F.col("n_blocks")).cast("double"))), "sources")

    parts = base.groupBy("source", "bucket").agg(F.sum(held).alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "bucket", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("begin"))
    parts = parts.alias("p").join(sources.alias("s"), F.expr("p.source <=> s.source")).select("p.*", "source_no", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum(held).over(inside), F.lit(0)))
    placed = placed.alias("d").join(parts.alias("p"), F.expr("d.bucket = p.bucket and d.source <=> p.source"))
    placed = placed.select("doc_id", "d.source", "source_no", "size", "source_size", "target", (F.col("begin") + F.col("within")).alias("first"), "copies")
    # copies part in two steps, so that no row of many copies fills one task
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK_ROWS))))
    if base.where(F.col("copies") > CHUNK_ROWS).head(1):
        placed = placed.repartition(_tasks(docs), "source_no", "first", "part")
    begin = F.col("part") * CHUNK_ROWS
    copy = F.explode(F.sequence(begin, F.least(begin + CHUNK_ROWS, F.col("copies")) - 1)).alias("copy")
    placed = placed.select("doc_id", "source", "source_no", "size", "source_size", "target", "first", copy)
    # an offset of its own for every row with words; those without need none
    offset = F.col("first") + F.col("copy") * F.col("size")
    return materialize(placed.select("doc_id", "source", "source_no", "size", "source_size", "target", offset.alias("offset")), "placed"), sources


def shard_counts(sources: DataFrame) -> DataFrame:
    """(shard, source_no, n): the drawn number of slots of each source in each output shard.

    ``sources`` has a row for each source; its expectations stand in one array a size of shard (shards have one of
    two sizes), and each shard draws fewer slots than there are sources.
    """
    spark = sources.sparkSession
    total = round(sources.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0])
    shards = max(1, -(-total // SHARD_SLOTS))
    sizes = spark.range(2).select((F.col("id") + total // shards).alias("n_slots"))
    held = sources.agg(F.array_sort(F.collect_list(F.struct("source_no", "slots"))).alias("all"))
    expected = sizes.join(F.broadcast(held), how="cross")  # two rows by one row
    each = F.transform("all", lambda x: F.struct(x["source_no"].alias("source_no"), (x["slots"] / F.lit(max(total, 1)) * F.col("n_slots") + 1e-9).alias("want")))
    expected = expected.select("n_slots", each.alias("each")).select(
        "n_slots", F.transform("each", lambda x: x["source_no"]).alias("source_nos"), F.transform("each", lambda x: F.floor(x["want"])).alias("whole"),
        F.transform("each", lambda x: x["want"] - F.floor(x["want"])).alias("fraction"),
    )
    none = F.array().cast("array<double>")
    upto = F.aggregate("fraction", none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))
    left = F.col("n_slots") - F.aggregate("whole", F.lit(0).cast("long"), lambda acc, x: acc + x)
    expected = materialize(expected.select("n_slots", "source_nos", "whole", left.alias("left"), upto.alias("upto")), "expected")

    own = spark.range(shards).select(F.col("id").alias("shard"), (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).alias("n_slots"))
    drawn = own.join(F.broadcast(expected), "n_slots")  # two rows
    top = F.element_at("upto", -1)

    def draw(i: Column) -> Column:
        """Source (place in the array) of a shard's i-th draw."""
        u = F.pmod(F.xxhash64(F.lit(SEED), F.col("shard"), i), F.lit(1 << 40)) / float(1 << 40) * top
        return F.size(F.filter("upto", lambda c: c <= u))

    draws = F.when((F.col("left") > 0) & (top > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest("left", F.lit(1))), draw)).otherwise(F.array().cast("array<int>"))
    drawn = drawn.where(F.size("whole") > 0).withColumn("draws", draws)
    counts = F.transform("whole", lambda n, k: n + F.size(F.filter("draws", lambda d: d == k)))
    return drawn.select("shard", F.explode(F.arrays_zip(F.col("source_nos"), counts.alias("n"))).alias("c")).select("shard", F.col("c.source_nos").alias("source_no"), F.col("c.n").alias("n"))


def _slots(sources: DataFrame) -> DataFrame:
    """(source_no, slot, shard, block): every slot of the mix. A source's ordinals end with its last round of blocks."""
    counts = materialize(shard_counts(sources), "shard-counts")
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.join(F.broadcast(sources.select("source_no", "n_blocks")), "source_no")  # a row for each source, as in the arrays above
    last = F.least(F.col("first") + F.col("n"), MAX_REPEAT * F.col("n_blocks")) - 1
    counts = counts.withColumn("last", last).where("last >= first")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / CHUNK_ROWS))).alias("chunk")
    chunks = counts.select("source_no", "shard", "n_blocks", "first", "last", chunk).repartition(_tasks(sources), "source_no", "shard", "chunk")
    begin = F.col("first") + F.col("chunk") * CHUNK_ROWS
    slots = chunks.select("source_no", "shard", "n_blocks", F.explode(F.sequence(begin, F.least(begin + CHUNK_ROWS - 1, F.col("last")))).alias("slot"))
    block = permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.col("source_no"))
    return slots.select("source_no", "slot", "shard", block.alias("block"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """(source_no, offset, doc_id, block, first_word, words): each document's share of each block."""
    ends = F.col("offset") + F.col("size")
    out = placed.where("size > 0").select(
        "source_no", "offset", "size", "doc_id",
        F.explode(F.sequence(F.floor(F.col("offset") / block_words), F.floor((ends - 1) / block_words))).alias("block"),
    )
    begin = F.greatest(F.col("block") * block_words, F.col("offset"))
    words = F.least((F.col("block") + 1) * block_words, ends) - begin
    return out.select("source_no", "offset", "doc_id", "block", (begin - F.col("offset")).alias("first_word"), words.alias("words"))


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: (shard, source_no, slot, block, doc_id, first_word, words), a row for each piece of a slot."""
    placed, sources = _placed(docs, block_words)
    # slots and pieces come from generators, whose size Spark underrates: ask for a merge, not a broadcast
    return _slots(sources).hint("merge").join(_pieces(placed, block_words).drop("offset"), ["source_no", "block"])


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, taken (words the mix takes, with repeats).

    ``taken`` follows from the counts that the shards draw. A source's total differs from its target by its draws
    (less than one slot a shard on average, and a shard has SHARD_SLOTS of them) and its last block; no block, and
    so no document, is taken more than three times: slots beyond a source's third round stay empty. A null
    text has size 0 and a null source is a source of its own. Rows that repeat an id are documents of their own;
    equal rows may swap results. The outcome depends on the rows alone, not on their order or partitions.
    Empty input gives no rows; very long texts are counted whole; other columns play no part.
    """
    placed, sources = _placed(docs, block_words)
    times = _slots(sources).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = _pieces(placed, block_words).join(times.hint("merge"), ["source_no", "block"])
    taken = taken.groupBy("source_no", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = placed.alias("d").join(taken.hint("merge").alias("t"), F.expr("d.size > 0 and d.source_no = t.source_no and d.offset = t.offset"), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("source")
