"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of 64 consecutive words that starts at a multiple of 32, so any 32 words in a row lie in one block
whole. A block meets a template if it holds at least the threshold's share of the template's distinct words. The
words of all templates are ordered by the number of documents that hold them, rarest first, over the whole corpus;
a block can meet a template only if it holds one of the template's first few words (prefix filter), has words enough
(length filter) and has enough of them left from the first hit on (positional filter). What passes is counted in full,
and must hold the words that name the template's license, and none that name a sister of it, so that no license is met by
the wording that it shares with others.
The templates' index is a literal of fixed size, so the join needs no shuffle; the corpus counts are one aggregation
over the templates' vocabulary.

Null texts count as empty: no words, no labels, score 0. Repeated rows give repeated rows; ties in frequency are
broken by the word. Other columns are ignored by :func:`licenses`. A table without rows gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.quality import bound

#: Phrases and labels that are always reported.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: One label and the wording of each license notice that is looked for; the words that name the license, and
#: the words that name a sister: a block without one of the former, or with one of the latter, does not meet the notice.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license version 3", "affero", ""),
    ("apache", "licensed under the apache license version 2 0", "apache", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution permitted", ""),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution", "sharealike noderivatives noderivs noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "sa nd"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial", "sharealike noderivatives noderivs"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd", ""),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons noncommercial noderivatives", ""),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa", ""),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "creative commons noncommercial sharealike", ""),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd", "nc"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons noderivatives", "noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", "nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike", "noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived copyright", ""),
    ("eupl", "licensed under the european union public licence version 1 2", "european public", ""),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license", "affero lesser"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "general public license", "affero lesser"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted", "permission granted", ""),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license", ""),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license", ""),
    ("mit", "released under the mit license", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted charge", ""),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla", ""),
    ("public-domain", "this is free and unencumbered software released into the public domain", "public domain", ""),
    ("reserved", "all rights reserved", "reserved", ""),
)
THRESHOLD = 0.8
STRIDE = 32
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text in lower case, each followed by one space, after one space."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), NOT_WORD, " ")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _, absent in templates for w in f"{t} {absent}".split()})


def word_ranks(words: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Ranks of the templates' words by the number of rows of ``words`` (a column ``words``) that hold them, rarest first.

    What comes to the driver is one count for each word of the templates.
    """
    known = vocabulary(templates)
    found = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, known)))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in found.collect()}
    return {w: k for k, w in enumerate(sorted(known, key=lambda w: (n.get(w, 0), w)))}


def template_matches(words: Column, ranks: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Every (label, block, containment) of a document's words that meets the threshold, as an array."""
    sets = [sorted({ranks[w] for w in t.split()}) for _, t, *_ in templates]
    words_of = lambda texts: F.array(*(F.array(*(F.lit(ranks[w]) for w in t.split())).cast("array<int>") for t in texts))
    names, sisters = words_of(must for *_, must, _ in templates), words_of(absent for *_, absent in templates)
    need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    entries: list[list[tuple[int, int]]] = [[] for _ in ranks]
    for k, s in enumerate(sets):
        for at, r in enumerate(s[: len(s) - need[k] + 1]):
            entries[r].append((k, at))
    word_of = {r: w for w, r in ranks.items()}
    kind = "array<array<struct<k:int,at:int,size:int,need:int>>>"
    postings = F.array(*(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("k", "at", "size", "need"), (k, at, len(sets[k]), need[k]), strict=True))) for k, at in e)) if e else F.from_json(F.lit("[]"), "array<struct<k:int,at:int,size:int,need:int>>") for e in entries)).cast(kind)
    of_template = F.array(*(F.array(*map(F.lit, s)) for s in sets))
    labels, sizes, needs = (F.array(*map(F.lit, x)) for x in ([lb for lb, *_ in templates], [len(s) for s in sets], need))
    first = F.array(*(F.lit(word_of[r]) for r, e in enumerate(entries) if e))
    known = F.array(*(F.lit(word_of[r]) for r in range(len(ranks))))

    def in_block(block: Column) -> Column:
        def met(held: Column) -> Column:
            def may(r: Column, j: Column) -> Column:
                left = lambda p: F.least(p["size"] - p["at"], F.size(held) - j)
                return F.transform(F.filter(F.get(postings, r), lambda p: (F.size(held) >= p["need"]) & (left(p) >= p["need"])), lambda p: p["k"])

            candidates = F.array_distinct(F.flatten(F.transform(held, may)))
            overlap = lambda k: F.size(F.array_intersect(held, F.get(of_template, k)))
            return F.transform(F.filter(candidates, lambda k: (overlap(k) >= F.get(needs, k)) & (F.size(F.array_except(F.get(names, k), held)) == 0) & ~F.arrays_overlap(F.get(sisters, k), held)), lambda k: F.struct(F.get(labels, k).alias("label"), (overlap(k) / F.get(sizes, k)).alias("containment")))

        return bound(F.sort_array(F.transform(F.array_intersect(block, known), lambda w: (F.array_position(known, w) - 1).cast("int"))), met)

    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(STRIDE))
    blocks = F.flatten(F.transform(starts, lambda s: bound(F.slice(words, s + 1, 2 * STRIDE), lambda b: F.when(F.arrays_overlap(b, first), F.transform(in_block(b), lambda m: F.struct((s / STRIDE).cast("int").alias("block"), m["label"].alias("label"), m["containment"].alias("containment")))).otherwise(F.array().cast("array<struct<block:int,label:string,containment:double>>")))))
    return F.when(F.arrays_overlap(words, first), blocks).otherwise(F.array().cast("array<struct<block:int,label:string,containment:double>>"))


def phrase_starts(line: Column) -> Column:
    """What lies before the first of the base phrases, and each phrase's start with what follows it, of spaced words."""
    phrases = "|".join(p for p, _ in BASE)
    return F.split(line, f"(?<= )(?=(?:{phrases}) )")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_found`` and ``matches``."""
    others = [c for c in docs.columns if c.lower() not in {text.lower(), "n_words", "n_base", "first_word", "last_word", "base_found", "matches"}]
    others = [F.col(f"`{c}`") for c in others]
    as_words = F.filter(F.split(spaced(F.col(text)), " "), lambda w: w != "")
    ranks = word_ranks(docs.select(as_words.alias("words")), templates)
    number = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))

    def found(line: Column) -> Column:
        n_words = (number(line) - 1).cast("long")

        def of_parts(parts: Column) -> Column:
            n = (F.size(parts) - 1).cast("long")
            label = lambda p: F.coalesce(*(F.when(p.startswith(f"{ph} "), F.lit(lb)) for ph, lb in BASE))
            return F.struct(
                n_words.alias("n_words"),
                n.alias("n_base"),
                F.when(n > 0, (number(F.get(parts, F.lit(0))) - 1).cast("long")).alias("first_word"),
                F.when(n > 0, n_words - number(F.element_at(parts, -1)).cast("long")).alias("last_word"),
                F.when(n > 0, F.array_sort(F.array_distinct(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), label)))).otherwise(F.array().cast("array<string>")).alias("base_found"),
                bound(F.filter(F.split(line, " "), lambda w: w != ""), lambda w: template_matches(w, ranks, templates, threshold)).alias("matches"),
            )

        return bound(phrase_starts(line), of_parts)

    return docs.select(*others, bound(spaced(F.col(text)), found).alias("__found")).select(*others, "__found.*")


def licenses(docs: DataFrame) -> DataFrame:
    """The digest of :func:`scan` for each document."""
    labels = F.array_sort(F.array_union("base_found", F.transform("matches", lambda m: m["label"])))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best)
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_found", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.size("matches").cast("long").alias("n_blocks_met")
    )


#: DuckDB's SQL for :func:`licenses`: every block against every template.
ORACLE_SQL = rf"""
with t(k, label, ws, must, sister) as (values {", ".join(f"({k}, '{lb}', list_distinct(string_split('{t}', ' ')), string_split('{must}', ' '), string_split('{sister}', ' '))" for k, (lb, t, must, sister) in enumerate(TEMPLATES))}),
b(label, phrase) as (values {", ".join(f"('{lb}', string_split('{p}', ' '))" for p, lb in BASE)}),
d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
place as (select r, ws, unnest(range(0, len(ws))) p from d),
base as (select r, p, label from place join b on ws[p + 1:p + len(phrase)] = phrase),
bases as (select r, count(*) n, min(p) lo, max(p) hi, list_sort(list_distinct(list(label))) ls from base group by r),
block as (select r, ws[s + 1:s + {2 * STRIDE}] bw from (select r, ws, unnest(range(0, len(ws), {STRIDE})) s from d)),
met as (select r, label, len(list_intersect(t.ws, list_distinct(bw))) / len(t.ws) c from block join t on len(list_intersect(t.ws, list_distinct(bw))) >= ceil({THRESHOLD} * len(t.ws) - 1e-9) and list_has_all(bw, t.must) and not list_has_any(bw, t.sister)),
mets as (select r, count(*) n, max(c) c, list(label) ls from met group by r)
select doc_id, len(d.ws)::bigint n_words, coalesce(bases.n, 0)::bigint n_base, lo::bigint first_word, hi::bigint last_word,
 coalesce(array_to_string(bases.ls, ','), '') base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.ls, []), coalesce(mets.ls, [])))), ','), '') labels,
 case when bases.n > 0 then 1.0e0 else coalesce(mets.c, 0.0e0) end score, coalesce(mets.n, 0)::bigint n_blocks_met
from d left join bases on d.r = bases.r left join mets on d.r = mets.r
"""
