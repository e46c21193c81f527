"""Multi-party perspective rotation: each speaker's view of a dialogue as training text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table

PART = 256


def rotate(turns: DataFrame, part: int = PART, context_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """One rendering of every conversation for every participant.

    In a participant's view their turns read ``<|assistant|>`` and carry the loss; the others
    read ``<|user name=...|>``. Turns of ``context_roles`` are nobody's view and read as the
    role itself. Turns stand in order of (turn, role, text). A dialogue is cut at turn numbers
    that are multiples of ``part``, so that a conversation of any length is spread over tasks;
    the parts of a view, put together, are the whole dialogue.

    A null role is the speaker ``unknown``, a null text is empty, a null turn comes first (part
    -1), a null conv_id is one conversation, repeated rows are repeated turns. A conversation of
    context turns only has no view. Other columns are ignored.

    Columns: conv_id, perspective, part, n_turns, n_own_turns, text, loss_starts and loss_lengths
    (characters of the participant's own words, counted from the start of the part).
    """
    t = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("name"),
        F.coalesce("text", F.lit("")).alias("said"))
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).cast("long"))
    parts = t.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "said"))).alias("turns"))
    people = t.filter(~F.col("name").isin(*context_roles)).select("conv_id", F.col("name").alias("perspective")).distinct()
    views = parts.join(people.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")))

    def head(x):
        return (
            F.when(x["name"] == F.col("perspective"), "<|assistant|>\n")
            .when(x["name"].isin(*context_roles), F.concat(F.lit("<|"), x["name"], F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), x["name"], F.lit("|>\n"))))

    tail = "\n<|end|>\n"
    pieces = F.transform("turns", lambda x: F.struct(
        head(x).alias("head"), x["said"].alias("said"), (x["name"] == F.col("perspective")).alias("own")))
    ends = F.aggregate(
        "pieces", F.array().cast("array<int>"),
        lambda a, x: F.concat(a, F.array(
            F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.char_length(x["head"]) + F.char_length(x["said"]) + len(tail))))
    views = views.withColumn("pieces", pieces).withColumn("_ends", ends)
    views = views.withColumn("_own", F.filter(
        F.transform("pieces", lambda x, i: F.struct(
            (F.get("_ends", i) - len(tail) - F.char_length(x["said"])).alias("at"), F.char_length(x["said"]).alias("len"), x["own"].alias("own"))),
        lambda x: x["own"]))
    return views.select(
        "conv_id", "perspective", "part", F.size("pieces").alias("n_turns"), F.size("_own").alias("n_own_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["said"], F.lit(tail))), "").alias("text"),
        F.col("_own.at").alias("loss_starts"), F.col("_own.len").alias("loss_lengths"))


_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as name, coalesce(text, '') as said,
    coalesce(cast(floor(turn / 256.0) as bigint), -1) as part
  from conversations),
v as (
  select t.conv_id, p.perspective, t.part, t.turn, t.name, t.said, t.name = p.perspective as own,
    case when t.name = p.perspective then '<|assistant|>' || chr(10)
      when t.name = 'system' then '<|system|>' || chr(10)
      else '<|user name=' || t.name || '|>' || chr(10) end as head
  from t join (select distinct conv_id, name as perspective from t where name <> 'system') p
    on t.conv_id is not distinct from p.conv_id),
o as (
  select *, sum(length(head) + length(said) + 9) over (
      partition by conv_id, perspective, part order by turn nulls first, name, said rows unbounded preceding) as upto
  from v)
select conv_id, perspective, part, cast(count(*) as int) as n_turns, cast(sum(own::int) as int) as n_own_turns,
  string_agg(head || said || chr(10) || '<|end|>' || chr(10), '' order by turn nulls first, name, said) as text,
  coalesce(string_agg(cast(upto - 9 - length(said) as varchar), ',' order by upto) filter (own), '') as loss_starts,
  coalesce(string_agg(cast(length(said) as varchar), ',' order by upto) filter (own), '') as loss_lengths
from o group by conv_id, perspective, part
"""


@query("op9_perspectives", _SQL)
def op9_perspectives(spark, folder):
    views = rotate(table(spark, folder, "conversations"))
    return views.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("loss_starts", "loss_lengths")})
