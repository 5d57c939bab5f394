"""Line dedup by a deletion-neighbourhood join: a line goes if an equal or nearly equal line stands earlier.

Lines are compared as sequences of words (white space and the case of A-Z don't count). Two lines are
near copies if one word edit (substitution, insertion, deletion) turns one into the other. With at
least five words a line, that keeps to a similarity of 0.8; longer lines may differ by one edit only,
too. Equal lines need no such floor: ``exact_words`` says from how many words on they are compared.

Distinct lines are found first. Two lines one edit apart agree on their first or their last words, so
only lines that share such a half with another line emit their neighbourhood: the line itself and all
its variants with one word left out, as hashed keys. Equal keys are joined through aggregates (the
earliest line of each key), never as pairs, and every find is verified on the words. The joins ask for
a merge, as sizes estimated before lines are split and variants made are far too low for a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import materialize

MIN_WORDS = 5
#: A set of document keys is broadcast up to this size; beyond it, it is joined by a shuffle.
BROADCAST_KEYS = 500_000


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(data: bytes, seed: int) -> int:
    return _signed(xxhash.xxh64_intdigest(data, seed))


def split_lines(text: str | None) -> list[list[bytes]]:
    """Words of every line."""
    return [line.split() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def halves(found: list[bytes]) -> list[int]:
    """Keys of the first and last 2**p words, for 2**p at most half the line, so that lines one edit apart share one.

    Where a line one word longer or shorter would take another power, the keys of both are given.
    """
    n, keys = len(found), []
    for size in {1 << (m.bit_length() - 2) for m in (n - 1, n, n + 1) if m >= 2}:
        if 2 * size <= n + 1:
            keys.append(_hash(b" ".join(found[:size]), 2 * size))
            keys.append(_hash(b" ".join(found[n - size :]), 2 * size + 1))
    return keys


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _line_batches(min_words: int, exact_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"].astype(object), batch["doc_key"], batch["text"]):
                for no, found in enumerate(split_lines(text)):
                    if len(found) >= exact_words:
                        line = b" ".join(found)
                        rows.append((doc_id, key, no, _hash(line, 0), _hash(line, 1), halves(found) if len(found) >= min_words else []))
            out = pd.DataFrame(rows, columns=["doc_id", "doc_key", "line_no", "h1", "h2", "halves"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _chosen_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the chosen lines."""
    for batch in batches:
        rows = []
        for doc_id, key, text, chosen in zip(batch["doc_id"].astype(object), batch["doc_key"], batch["text"], batch["line_nos"]):
            found = split_lines(text)
            rows += [(doc_id, key, no, b" ".join(found[no])) for no in set(chosen)]
        out = pd.DataFrame(rows, columns=["doc_id", "doc_key", "line_no", "words"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def _variant_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, slot): slot 0 is the line itself, slot i the line without its i-th word."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part, rows = batch[at : at + 500], []
            for doc_id, doc_key, no, line in zip(part["doc_id"].astype(object), part["doc_key"], part["line_no"], part["words"]):
                rows.append((_hash(line, 3), 0, doc_id, doc_key, no))
                found, begin = line.split(b" "), 0
                for i, w in enumerate(found):
                    end = begin + len(w) + 1
                    rest = line[:begin] + line[end:] if i + 1 < len(found) else line[: begin - 1]
                    rows.append((_hash(rest, 3), i + 1, doc_id, doc_key, no))
                    begin = end
            out = pd.DataFrame(rows, columns=["key", "slot", "doc_id", "doc_key", "line_no"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


@pandas_udf(T.BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x.split(b" "), y.split(b" ")) for x, y in zip(a, b)], dtype=bool)


PLACE = ("doc_id", "doc_key", "line_no")


def _near(docs: DataFrame, forms: DataFrame) -> DataFrame:
    """First lines of their form with an earlier line one edit away: (doc_key, line_no, partner)."""
    keys = forms.select(*PLACE, F.explode(F.array_distinct("halves")).alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    chosen = keys.join(shared.hint("merge"), "half", "left_semi").groupBy("doc_key").agg(F.collect_list("line_no").alias("line_nos"))
    chosen = materialize(chosen, "chosen")
    small = chosen.agg(F.coalesce(F.sum(F.size("line_nos")), F.lit(0))).first()[0] <= BROADCAST_KEYS
    texts = docs.select("doc_id", "text", "doc_key").join(F.broadcast(chosen) if small else chosen, "doc_key")
    lines = texts.mapInPandas(_chosen_batches, "doc_id long, doc_key long, line_no int, words binary")
    lines = materialize(lines.dropDuplicates(["doc_key", "line_no"]), "lines")

    variants = lines.mapInPandas(_variant_batches, "key long, slot int, doc_id long, doc_key long, line_no int")
    several = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = materialize(variants.join(several.hint("merge"), "key", "left_semi").select("key", "slot", F.struct(*PLACE).alias("place")), "variants")
    by_slot = shared.groupBy("key", "slot").agg(F.min("place").alias("same"))
    by_key = by_slot.groupBy("key").agg(
        F.min(F.when(F.col("slot") == 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("slot") > 0, F.col("same"))).alias("shorter")
    )
    found = shared.join(by_slot.hint("merge"), ["key", "slot"]).join(by_key.hint("merge"), "key")
    partners = F.when(F.col("slot") == 0, F.array("shorter")).otherwise(F.array("same", "whole"))
    pairs = found.select("place", F.explode(partners).alias("partner")).where("partner < place").distinct()
    words = lines.select(F.col("doc_key").alias("k"), F.col("line_no").alias("no"), "words")
    pairs = pairs.join(words, (F.col("place.doc_key") == F.col("k")) & (F.col("place.line_no") == F.col("no"))).drop("k", "no")
    other = words.withColumnRenamed("words", "other")
    pairs = pairs.join(other, (F.col("partner.doc_key") == F.col("k")) & (F.col("partner.line_no") == F.col("no"))).drop("k", "no")
    return pairs.where(_verified("words", "other")).groupBy("place").agg(F.min("partner").alias("partner"))


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))


def _repeats(docs: DataFrame, min_words: int, exact_words: int | None) -> tuple[DataFrame, DataFrame]:
    """Lines to drop (place, form's first place, partner of the form), and (place, partner) of the forms that go as near copies."""
    docs = with_key(docs)
    rows = docs.select("doc_id", "doc_key", "text").mapInPandas(
        _line_batches(min_words, min_words if exact_words is None else max(1, exact_words)), "doc_id long, doc_key long, line_no int, h1 long, h2 long, halves array<long>"
    )
    rows = materialize(rows, "line-keys")
    forms = rows.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("place"), F.first("halves").alias("halves"))
    forms = materialize(forms.select("h1", "h2", "place.*", "halves"), "forms")
    near = _near(docs, forms)
    keyed = near.select(F.col("place.doc_key").alias("k"), F.col("place.line_no").alias("no"), "partner")
    firsts = forms.join(keyed, (F.col("doc_key") == F.col("k")) & (F.col("line_no") == F.col("no")), "left")
    firsts = firsts.select("h1", "h2", F.struct(*PLACE).alias("place"), "partner")
    gone = rows.select("h1", "h2", *PLACE).join(firsts.hint("merge"), ["h1", "h2"])
    later = (F.col("doc_key") != F.col("place.doc_key")) | (F.col("line_no") != F.col("place.line_no"))
    return gone.where(later | F.col("partner").isNotNull()).select(*PLACE, "place", "partner"), near


def _followed(near: DataFrame) -> DataFrame:
    """(place, partner) with each partner replaced by the line at the end of its chain, which stays.

    A partner stands before its line, so chains end; a round of this join halves what is left of each.
    """
    near = materialize(near, "chain")
    while True:
        onward = near.select(F.col("place.doc_key").alias("k"), F.col("place.line_no").alias("no"), F.col("partner").alias("onward"))
        held = (F.col("partner.doc_key") == F.col("k")) & (F.col("partner.line_no") == F.col("no"))
        step = near.select("place", "partner").join(onward, held, "left").select("place", F.coalesce("onward", "partner").alias("partner"), F.col("onward").isNotNull().alias("moved"))
        near = materialize(step, "chain")
        if not near.where("moved").head(1):
            return near.select("place", "partner")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None) -> DataFrame:
    """Lines to drop: (doc_id, doc_key, line_no, kept_doc_id, kept_line_no).

    Places are ordered by doc_id (null first), by a hash that tells rows with one id apart, and by
    line. Every place of a line but its form's first goes; the first goes too if a line one word edit
    away stands earlier, whether that one stays or goes itself. ``kept_`` names a line that stays: the one
    at the end of the chain of such earlier lines. Lines under ``min_words`` words have no near copies, and lines under
    ``exact_words`` (the same, if not given; blank lines have none) always stay. Rows that repeat both
    id and text count as one document. Null and empty texts have no lines to compare; very long texts are
    read whole; an empty table gives no rows; other columns play no part.
    """
    gone, near = _repeats(docs, min_words, exact_words)
    ends = _followed(near).select(F.col("place.doc_key").alias("k"), F.col("place.line_no").alias("no"), F.col("partner").alias("end"))
    gone = gone.join(ends, (F.col("place.doc_key") == F.col("k")) & (F.col("place.line_no") == F.col("no")), "left")
    kept = F.coalesce("end", "place")
    return gone.select(*PLACE, kept["doc_id"].alias("kept_doc_id"), kept["line_no"].alias("kept_line_no"))


@pandas_udf(T.StringType())
def _without(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch, gone in texts:
        out = []
        for text, dropped in zip(batch, gone):
            if dropped is not None and len(dropped):
                dropped = set(dropped)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in dropped)
            out.append(text)
        yield pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int | None = None, count: str | None = "n_dropped") -> DataFrame:
    """The documents with their repeated lines taken out of ``text``, and the number of lines taken as ``count`` (None: not at all).

    All rows and other columns stay, an own column named like ``count`` as ``own_<count>``; a document may be
    left with an empty text, and a null text stays null. Rows that repeat both id and text lose the same lines.
    """
    gone = _repeats(docs, min_words, exact_words)[0].groupBy("doc_key").agg(F.collect_set("line_no").alias("dropped_lines"))
    # the document's own columns stand in a struct, so none can clash with those of the join
    whole = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("doc_key"))
    joined = whole.join(gone.hint("merge"), "doc_key", "left")
    out = joined.select("row", _without("row.text", "dropped_lines").alias("_text"), F.coalesce(F.size("dropped_lines"), F.lit(0)).alias("_n"))
    own = [F.col("_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(f"own_{c}" if c == count else c) for c in docs.columns]
    return out.select(*own, *([F.col("_n").alias(count)] if count else []))


def op2(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines (of the text as given), n_dropped, and the text that remains."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    out = dedup_lines(docs.select("doc_id", "text").withColumn("n_lines", lines.cast("long")), exact_words=1)
    return out.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), "text")
