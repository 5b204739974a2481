"""Quality rules as a bitmask ledger.

``measure`` evaluates every rule once for each document and stores the measurements and one bit for each failed
rule. Policies are sets of rules, named by version, and are applied to the stored bits; what each rule of a policy
removes alone or with others (its ablation) comes from the bits by grouped counts, without reading a text again.

Null and empty texts have no words, fail ``few_words`` and are not kept. Repeated rows give repeated rows, and other
columns are passed on as they are (columns named like the ledger's are replaced). A table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``sql``, over the ledger's measurements, holds."""

    bit: int
    name: str
    sql: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words"),
    Rule(5, "capitals", "100 * n_capital_words > 30 * n_words"),
    Rule(6, "few_letters", "100 * n_letter_words < 70 * n_words"),
    Rule(7, "exclamations", "100 * n_exclamations > 10 * n_words"),
)
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_letter_words", "n_exclamations")

#: Rules of each version of the policy.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "capitals", "few_letters", "exclamations"),
}


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more.

    Equal windows have equal hashes, so a document whose window hashes all differ has none; only the others have
    their windows themselves sorted and compared, which leaves the count exact.
    """
    def starts():
        return F.sequence(F.lit(1), F.size(words) - F.lit(WINDOW - 1))

    hashes = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(starts(), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    some_repeat = bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def covered(windows: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(windows, k - 1)["w"] == x["w"]).otherwise(F.lit(False))
            return before | F.coalesce(F.get(windows, k + 1)["w"] == x["w"], F.lit(False))

        places = F.sort_array(F.transform(F.filter(windows, again), lambda x: x["p"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW).cast("long"), p.cast("long") - s["last"])).alias("n"), p.cast("long").alias("last")),
            lambda s: s["n"],
        )

    windows = F.sort_array(F.transform(starts(), lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("p"))))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= WINDOW, none).otherwise(F.when(some_repeat, bound(windows, covered)).otherwise(none))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the measurements and ``fail_bits``: one bit for each rule of ``RULES``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length(whole)

    def counted(pattern: str) -> Column:
        return (length - F.length(F.regexp_replace(whole, pattern, ""))).cast("long")

    def sized(a: Column) -> Column:
        return F.size(a).cast("long")

    of_words = bound(words, lambda w: F.struct(
        sized(w).alias("n_words"),
        repeated_words(w).alias("n_repeat_words"),
        sized(F.filter(w, lambda x: x.rlike(r"\p{Lu}{2}") & ~x.rlike(r"\p{Ll}"))).alias("n_capital_words"),
        sized(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
    ))
    of_lines = bound(lines, lambda s: F.struct(sized(s).alias("n_lines"), (sized(s) - sized(F.array_distinct(s))).alias("n_dup_lines")))
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), "fail_bits", *MEASUREMENTS}]
    ledger = docs.select(
        *(F.col(f"`{c}`") for c in kept),
        of_words.alias("__words"),
        of_lines.alias("__lines"),
        counted(r"[^\x20\x09-\x0D]").alias("word_chars"),
        counted("[#*$%&|<>]").alias("n_symbols"),
        counted("!").alias("n_exclamations"),
    ).select(
        *(F.col(f"`{c}`") for c in kept),
        *(F.col(c) if c in ("word_chars", "n_symbols", "n_exclamations") else F.col(f"__lines.{c}" if c in ("n_lines", "n_dup_lines") else f"__words.{c}") for c in MEASUREMENTS),
    )
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.sql), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return ledger.withColumn("fail_bits", bits)


def policy_mask(version: int) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version])


def apply_policy(ledger: DataFrame, version: int) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablation(ledger: DataFrame, version: int) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it removes, and that all other rules leave.

    The ledger is counted by its bits first, at most 2 ** rules rows; everything else works on those.
    """
    mask = policy_mask(version)
    counts = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[version]))).alias("r")
    per = counts.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return per.groupBy("rule").agg(total(fails)("n_failed"), total(F.col("bits") == F.col("bit"))("n_only"), total(rest == 0)("n_kept_without"))


def quality(docs: DataFrame, version: int = 2) -> DataFrame:
    """The digest of the ledger: base measurements, ``base_failed`` and the policy's verdict, and ``fail_bits``."""
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(1)).cast("long")) != 0
    return apply_policy(measure(docs.select("doc_id", "text")), version).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits"
    )


#: DuckDB's SQL for :func:`quality`.
ORACLE_SQL = r"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
win as (select r, unnest(range(1, len(ws) - 6)) p, ws from w where len(ws) >= 9),
win2 as (select r, p, array_to_string(list_slice(ws, p, p + 7), ' ') g from win),
dup as (select r, p from (select r, p, count(*) over (partition by r, g) n from win2) where n >= 2),
rep as (select r, sum(least(8, p - coalesce(lp, -8))) n from (select r, p, lag(p) over (partition by r order by p) lp from dup) group by r),
m as (select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{Lu}{2}') and not regexp_matches(x, '\p{Ll}'))) n_capital_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) n_letter_words,
  length(t) - length(replace(t, '!', '')) n_exclamations from w left join rep on w.r = rep.r),
b as (select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
  + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)::bigint + 16 * (word_chars < 3 * n_words or word_chars > 12 * n_words)::bigint
  + 32 * (100 * n_capital_words > 30 * n_words)::bigint + 64 * (100 * n_letter_words < 70 * n_words)::bigint
  + 128 * (100 * n_exclamations > 10 * n_words)::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 base_failed, fail_bits & 255 = 0 kept, fail_bits::bigint fail_bits from b
"""
