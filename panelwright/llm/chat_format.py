"""Chat formatting by prefix-target expansion: one training example for every assistant turn.

An example is the conversation up to and with one assistant turn; only that turn's text is under the
loss mask. Turns that follow the last assistant turn (or a conversation without one) make a last
example with an empty mask, so nothing of a conversation is lost.

Template: ``<s>[role]`` and a newline, the text, ``</s>`` and a newline. ``&``, ``<`` and ``[`` in
roles and texts are escaped, so no text can hold a control string of this or a like template, and
unescaping gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Control strings of the template and the escapes of the signs that they begin with.
OPEN, MIDDLE, CLOSE = "<s>[", "]\n", "</s>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
TARGET_ROLE = "assistant"
# Fixed value: the text of the contract's conversation -1.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    for sign, code in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def examples(conversations: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """conversations -> (conv_id, example, formatted, loss_begin, loss_end), offsets in characters from 0.

    Turns stand in order of turn (null first), then role and text, so equal turn numbers have a fixed
    order and repeated rows are turns of their own. Null roles and texts count as empty; rows with a
    null conv_id make one conversation. A conversation is the unit of an example, and its examples
    together are quadratic in its turns, which is what the expansion asks for; memory holds the pieces
    of a conversation once and one example at a time. Very long texts stand whole in their examples. An
    empty table gives no rows; other columns play no part.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # the turns without a number stand first, which the order of structs puts first, too
    header = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    whole = whole.select(
        "conv_id", F.transform("turns", lambda t: F.concat(header(t), escape(t["text"]), F.lit(CLOSE))).alias("pieces"),
        F.transform("turns", lambda t: F.when(t["role"] == target_role, F.length(escape(t["text"])))).alias("own_chars"),
    )
    # one example at a time leaves the generator, as a slice of the conversation's pieces
    wanted = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.get("own_chars", i - 1).isNotNull() | (i == F.size("pieces")))
    out = whole.select("conv_id", "pieces", "own_chars", F.explode(wanted).alias("example"))
    out = out.withColumn("formatted", F.array_join(F.slice("pieces", F.lit(1), F.col("example")), ""))
    end = F.length("formatted") - len(CLOSE)
    return out.select("conv_id", "example", "formatted", (end - F.coalesce(F.get("own_chars", F.col("example") - 1), F.lit(0))).alias("loss_begin"), end.alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    return F.transform(F.filter(F.split(formatted, CLOSE), lambda p: p != ""), _turn)


def _turn(piece: Column) -> Column:
    middle = F.position(F.lit(MIDDLE), piece)
    role = F.substring(piece, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
    text = F.substring(piece, middle + len(MIDDLE), F.length(piece))
    return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    loss = unescape(F.substring("formatted", F.col("loss_begin") + 1, F.col("loss_end") - F.col("loss_begin")))
    by_conv = formatted.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.count_if(F.col("loss_end") > F.col("loss_begin")).alias("n_examples"),
    )
    turns, trained = read_turns(F.col("whole")), F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = by_conv.withColumns({"turns": turns, "trained": trained})
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )


def op5(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET_ROLE).alias("role"), F.lit(PROBE).alias("text"),
    )
    return digests(examples(turns.unionByName(probe)))


def op5_sql() -> str:
    def esc(x: str) -> str:
        for sign, code in ESCAPES:
            x = f"replace({x}, '{sign}', '{code}')"
        return x

    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
o as (
  select *, row_number() over w as example, lead(1) over w is null as is_last,
    length({esc('role')}) + length({esc('txt')}) + {len(OPEN + MIDDLE + CLOSE)} as n
  from t window w as (partition by conv_id order by turn nulls first, role, txt)),
r as (select *, sum(n) over (partition by conv_id order by example) as chars from o)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' order by example)) as turns_sha256,
  coalesce(sum(length(txt)) filter (role = '{TARGET_ROLE}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(txt, '' order by example) filter (role = '{TARGET_ROLE}'), '')) as loss_sha256,
  (sum(chars) filter (role = '{TARGET_ROLE}' or is_last))::bigint as formatted_chars,
  count(*) filter (role = '{TARGET_ROLE}' and length(txt) > 0) as n_examples
from r group by conv_id"""
