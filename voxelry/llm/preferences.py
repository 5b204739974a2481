"""Preference formatting: prompts and paired, masked completions from chosen and rejected conversations.

The longest common prefix of turns (equal role and text, in turn order) of the two conversations of a pair is rendered
once, as the prompt; what follows is rendered for each side, with the ranges (code points) that a loss may count: the
texts of the assistant's turns.

Turns are ordered by turn, then role and text; rows that repeat a turn exactly count once. A null role is
``unknown``, a null text empty, a null turn comes first; rows without a conversation id belong to none and are left
out. A pair with one side only has no prompt, and its ``status`` says which side is missing. A pair's turns meet in
one row, as they do in the result; no other row does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.quality import bound

TRAINED_ROLE = "assistant"


def render(turns: Column) -> Column:
    """Each turn as a line with the role and a line with the text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """``start:end`` of the trained texts in the rendered turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"])
        span = F.when(t["role"] == TRAINED_ROLE, F.array(F.concat_ws(":", begin, end))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), F.concat(s["out"], span).alias("out"))

    return F.aggregate(turns, start, step, lambda s: F.array_join(s["out"], ","))


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _in_order(turns: Column) -> Column:
    return F.array_distinct(F.sort_array(turns))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair of ``turns``: ``pair_id, side`` ('chosen' or 'rejected'), ``turn, role, text``."""
    side = lambda s: _in_order(F.collect_list(F.when(F.col("side") == s, _turn()))).alias(s)
    return format_sides(turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side("chosen"), side("rejected")))


def format_sides(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs``, ``pair_id`` and the arrays of turns ``chosen`` and ``rejected``, rendered."""
    a, b = F.col("chosen"), F.col("rejected")

    def shared(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce((p["role"] == q["role"]) & (p["text"] == q["text"]), F.lit(False))), F.lit(False))
        return F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int")

    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.greatest(F.size(x), F.lit(1)))
    status = F.when(F.size(a) == 0, "no chosen side").when(F.size(b) == 0, "no rejected side").otherwise("pair")
    return pairs.withColumn("n", shared(a, b)).select(
        "pair_id",
        status.alias("status"),
        F.col("n").cast("long").alias("prompt_turns"),
        render(F.slice(a, F.lit(1), F.col("n"))).alias("prompt"),
        *(f(bound(rest(s), g)).alias(f"{s}{name}") for s in ("chosen", "rejected") for name, g, f in (("", render, lambda x: x), ("_mask", mask, lambda x: x))),
    )


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation, ``pair_id`` its id: its own answers are chosen, its neighbour's rejected from some turn on.

    The chosen side is the conversation up to its last answer (the last turn of the assistant). The rejected side is the same
    with the text of the last answer of the neighbour (2 k + 1 for 2 k, and the other way round) in place of each answer
    from the one of number id mod n on, of n answers from 0. So sides part anywhere, or not at all where texts agree. Without
    an answer of its own a conversation has no chosen side, without one of its neighbour no rejected side.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    mine = lambda odd: _in_order(F.collect_list(F.when(F.pmod("conv_id", F.lit(2)) == odd, _turn())))
    half = F.floor(F.col("conv_id") / 2).cast("long").alias("half")
    turns = conversations.select("conv_id", half, F.col("turn").cast("long").alias("turn"), "role", "text").where(F.col("conv_id").isNotNull())
    both = turns.groupBy("half").agg(mine(0).alias("even"), mine(1).alias("odd"))

    def answered(t: Column) -> Column:
        """The turns up to the last answer."""
        places = F.transform(t, lambda x, k: F.when(x["role"] == TRAINED_ROLE, k + 1).otherwise(0))
        return F.when(F.size(t) > 0, F.slice(t, F.lit(1), F.array_max(places))).otherwise(t)

    cut = both.select("half", *(x for c in ("even", "odd") for x in ((F.size(c) > 0).alias(f"is_{c}"), answered(F.col(c)).alias(c))))

    def sides(mine: str, other: str, odd: int) -> Column:
        a, b = F.col(mine), F.col(other)
        answers = F.filter(F.transform(a, lambda x, k: F.when(x["role"] == TRAINED_ROLE, k)), lambda k: k.isNotNull())
        parting = F.get(answers, F.pmod(F.col("half") * 2 + odd, F.greatest(F.size(answers), F.lit(1))).cast("int"))
        answer = F.get(b, F.size(b) - 1)["text"]
        worse = lambda x, k: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), F.when((x["role"] == TRAINED_ROLE) & (k >= parting), answer).otherwise(x["text"]).alias("text"))
        rejected = F.when(F.size(b) == 0, none).when(F.size(a) == 0, b).otherwise(F.transform(a, worse))
        return F.when(F.col(f"is_{mine}"), F.struct((F.col("half") * 2 + odd).alias("pair_id"), a.alias("chosen"), rejected.alias("rejected")))

    pairs = cut.select(F.explode(F.array(sides("even", "odd", 0), sides("odd", "even", 1))).alias("p")).where("p is not null").select("p.*")
    return format_sides(pairs)


#: DuckDB's SQL for :func:`preference_pairs`.
ORACLE_SQL = f"""
with t as (select distinct conv_id::bigint as conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, role, text from t),
z as (select conv_id, coalesce(max(k) filter (where role = '{TRAINED_ROLE}'), 0) as last from o group by 1),
e as (select o.conv_id, o.text as answer from o join z on o.conv_id = z.conv_id and k = last),
chosen as (select o.conv_id as pair_id, k, role, text from o join z on o.conv_id = z.conv_id where k <= last),
near as (select z.conv_id, z.last, e.answer, y.last as other from z left join e on e.conv_id = xor(z.conv_id, 1) left join z y on y.conv_id = xor(z.conv_id, 1)),
answers as (select conv_id, k, row_number() over (partition by conv_id order by k) - 1 as number, count(*) over (partition by conv_id) as n from o where role = '{TRAINED_ROLE}'),
parting as (select conv_id, k as parting from answers where number = (conv_id % n + n) % n),
rejected as (select o.conv_id as pair_id, k, role, case when role = '{TRAINED_ROLE}' and k >= parting then answer else text end as text from o join near on o.conv_id = near.conv_id join parting on o.conv_id = parting.conv_id where k <= last and answer is not null
  union all select near.conv_id, k, role, text from near join o on o.conv_id = xor(near.conv_id, 1) where near.last = 0 and k <= other),
r as (select pair_id, 0 as side, k, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) as line from chosen
  union all select pair_id, 1, k, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) from rejected),
c as (select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.k, b.k) as k, coalesce(a.role = b.role and a.text = b.text, false) as same
  from (select * from r where side = 0) a full join (select * from r where side = 1) b on a.pair_id = b.pair_id and a.k = b.k),
n as (select conv_id as pair_id, coalesce(min(k) filter (where not same) - 1, max(k), 0) as n from z left join c on c.pair_id = z.conv_id group by 1),
m as (select r.*, n.n, sum(length(line)) over (partition by r.pair_id, side order by k) - length(line) as after from r join n on r.pair_id = n.pair_id where k > n.n),
s as (select pair_id, side, string_agg(line, '' order by k) as body,
  string_agg(case when role = '{TRAINED_ROLE}' then (after + length(role) + 5)::bigint || ':' || (after + length(role) + 5 + length(text))::bigint end, ',' order by k) as marks from m group by 1, 2),
p as (select r.pair_id, string_agg(line, '' order by k) as prompt from r join n on r.pair_id = n.pair_id where side = 0 and k <= n.n group by 1),
h as (select z.conv_id as pair_id, count(*) filter (where side = 0) as a, count(*) filter (where side = 1) as b from z left join r on r.pair_id = z.conv_id group by 1)
select n.pair_id, case when h.a = 0 then 'no chosen side' when h.b = 0 then 'no rejected side' else 'pair' end as status, n.n::bigint as prompt_turns,
 coalesce(p.prompt, '') as prompt, coalesce(x.body, '') as chosen, coalesce(x.marks, '') as chosen_mask, coalesce(y.body, '') as rejected, coalesce(y.marks, '') as rejected_mask
from n join h on n.pair_id = h.pair_id left join p on n.pair_id = p.pair_id
left join s x on x.pair_id = n.pair_id and x.side = 0 left join s y on y.pair_id = n.pair_id and y.side = 1
"""
