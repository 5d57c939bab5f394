"""Quality rules as a bitmask ledger, in DataFrame operations alone.

Every rule is evaluated once for every document; the ledger keeps the measurements and one failure
bit a rule. A policy is a versioned mask of the rules that count, so another policy, or what each rule
alone would cost, needs no second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Failure conditions over the measurements, by bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 16 * n_words"),
    ("upper_case", "n_upper * 2 > word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(BIT))


def _repeat_words(grams: Column) -> Column:
    """Words that lie in a window found twice or more: each counted once."""
    n = F.size(grams)
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(placed: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(placed, k - 1)["g"] == x["g"])
            return before | F.coalesce(F.get(placed, k + 1)["g"] == x["g"], F.lit(False))

        starts = F.array_sort(F.transform(F.filter(placed, twin), lambda x: x["i"]))
        # sum of each window's words that the one before it does not cover
        first = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(s - acc["at"], F.lit(WINDOW))).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    return F.when(F.size(F.array_distinct(grams)) < n, F.element_at(F.transform(F.array(placed), covered), 1)).otherwise(F.lit(0))


def ledger(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """documents -> doc_id, measurements, and ``failed``, the bitmask of the rules that a document fails.

    Null and empty texts have no words and fail ``few_words``. Every row is measured by itself, repeated ones
    too; texts are measured whole, however long. An empty table gives no rows; other columns play no part.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("words"))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    letters = F.array_join("words", "")
    out = out.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(letters).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.when(F.size("words") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("grams")).cast("long").alias("n_repeat_words"),
    )
    failed = F.lit(0)
    for k, (_, condition) in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)))
    return out.withColumn("failed", failed)


def verdicts(led: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The ledger with ``policy`` and ``kept``: no rule of the policy failed."""
    kept = F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0
    return led.withColumn("policy", F.lit(policy.version)).withColumn("kept", kept)


def ablation(led: DataFrame, policy: Policy = FULL) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone, and kept without it."""
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = []
    for name in policy.rules:
        bit = F.lit(BIT[name])
        counts += [F.count_if(masked.bitwiseAND(bit) != 0).alias(f"{name}_any"), F.count_if(masked == bit).alias(f"{name}_only")]
    row = led.agg(F.count_if(masked == 0).alias("n_kept"), *counts)
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"{r}_any").alias("n_failed"), F.col(f"{r}_only").alias("n_failed_alone")) for r in policy.rules]
    out = row.select("n_kept", F.explode(F.array(*rows)).alias("r")).select("r.*", "n_kept")
    return out.withColumn("n_kept_without", F.col("n_kept") + F.col("n_failed_alone"))


def op8(docs: DataFrame) -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0
    return verdicts(ledger(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed", "n_upper", "n_lines",
    )


def op8_sql() -> str:
    rules = " | ".join(f"(case when {condition} then {1 << k} else 0 end)" for k, (_, condition) in enumerate(RULES))
    return f"""
with t as (
  select row_number() over () rid, doc_id, coalesce(text, '') x,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) l
  from documents),
g as (select rid, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: {{'i': i, 'g': w[i:i + {WINDOW - 1}]}}), recursive := true) from t where len(w) >= {WINDOW}),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) c from g) where c > 1),
c as (select rid, count(distinct i + k) n from r, (select unnest(range(0, {WINDOW})) k) group by rid),
m as (
  select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars,
    length(x) - length(translate(x, '{SYMBOLS}', '')) n_symbols,
    length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) n_upper,
    len(l) n_lines, len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words
  from t left join c using (rid)),
f as (select *, ({rules}) failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & {BASE.mask}) <> 0 base_failed, (failed & {FULL.mask}) = 0 kept, failed, n_upper, n_lines
from f"""
