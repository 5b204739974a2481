"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelry.llm import decontamination, extraction, language, licenses, neardup, packing, pii, preferences, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, slot string, id_found long, fail_bits string"
LONG = "the quick brown fox of and to in that is was for it with as his on be at by " * 5000
ROWS = [
    (1, None, None, None, None, None, "x", 5, "a"),
    (2, "", "en", "s", 0, True, None, None, None),
    (3, " \n\t ", "en", None, 4, True, None, None, None),
    (4, LONG, "en", "s", len(LONG), False, "y", 1, "b"),
    (5, "Released under the MIT license. " * 2 + "and this is for the others that it was with", "en", "s", 1, True, None, None, None),
    (5, "Released under the MIT license. " * 2 + "and this is for the others that it was with", "en", "s", 1, True, None, None, None),
    (None, "a text without an id for the reader of this and that", "en", "s", 1, True, None, None, None),
    (7, "a", "en", "s", 1, True, None, None, None),
]
BENCH = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine ten"), (None, "x y z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def folder(bench, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_licenses(docs):
    got = {(r.doc_id, r.n_words, r.labels, r.score) for r in licenses.licenses(docs).collect()}
    assert (1, 0, "", 0.0) in got and (2, 0, "", 0.0) in got and (5, 20, "mit", 1.0) in got
    assert licenses.licenses(docs).count() == len(ROWS) and licenses.licenses(docs.limit(0)).count() == 0
    scanned = licenses.scan(docs.withColumn("matches", F.lit(1)))
    assert "slot" in scanned.columns and scanned.where("get(matches, 0).label = 'mit'").count() == 2


def test_sister_licenses_are_told_apart(spark):
    work = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = {
        work.format(""): "cc-by",
        work.format("-ShareAlike"): "cc-by-sa",
        work.format("-NoDerivatives"): "cc-by-nd",
        work.format("-NonCommercial"): "cc-by-nc",
        work.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa",
        work.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        "Licensed under CC-BY-SA 4.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "This work is licensed under the GNU Lesser General Public License, version 3": "gpl,lgpl",
        "Licensed under the GNU Affero General Public License, version 3": "agpl,gpl",
        "Dual licence: released under the MIT license, or licensed under the Apache License, Version 2.0": "apache,mit",
        "A work under no license at all, of the common kind": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.licenses(docs).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())


def test_base_phrases_touch_and_repeat(spark):
    df = spark.createDataFrame([(1, "CC by CC-by, all RIGHTS reserved General public license x"), (2, "xcc by éall rights reserved")], "doc_id long, text string")
    a, b = sorted(licenses.licenses(df).collect())
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (11, 4, 0, 7, "cc-by,gpl,reserved") and a.score == 1.0
    assert (b.n_base, b.first_word, b.last_word, b.base_labels) == (0, None, None, "")


def test_packing(docs):
    got = packing.pack(docs).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert tokens[1] == [(0, 1, 1)] == tokens[2] and sum(n for _, n, _ in tokens[5]) == 2 * tokens[5][0][2] and None in tokens
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, capacity=1000)


def by_halves(df):
    """Conversations 2 k and 2 k + 1 as the sides of pair k."""
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side")
    return preferences.format_pairs(df.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side, "turn", "role", "text"))


def test_pairs(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (1, None, None, None), (1, 1, "user", "b"), (None, 1, "user", "z"), (4, 0, "user", "only"), (7, 0, "assistant", "late")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))
    got = {r.pair_id: r for r in by_halves(df).collect()}
    assert set(got) == {0, 2, 3}
    assert got[0].prompt_turns == 1 and got[0].chosen == "<|user|>\na\n" and got[0].rejected == "<|user|>\nb\n" and got[0].chosen_mask == ""
    assert got[2].status == "no rejected side" and got[3].status == "no chosen side" and got[3].rejected_mask == "14:18"
    assert got[3].rejected[14:18] == "late"
    assert by_halves(df.limit(0)).count() == 0


def test_preferences(spark):
    rows = [(8, 1, "user", "q"), (8, 2, "assistant", "good"), (8, 3, "user", "bye"), (9, 1, "user", "q2"), (9, 2, "assistant", "bad"), (9, 2, "assistant", "bad"), (None, 1, "user", "z")]
    rows += [(10, 1, "assistant", LONG), (11, None, None, None), (12, 1, "user", "u"), (14, 5, "assistant", "one"), (14, 5, "assistant", "two"), (15, 1, "assistant", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))
    got = {r.pair_id: r for r in preferences.preference_pairs(df).collect()}
    assert set(got) == {8, 9, 10, 11, 12, 14, 15}
    assert (got[8].prompt, got[8].prompt_turns) == ("<|user|>\nq\n", 1)
    assert (got[8].chosen, got[8].rejected) == ("<|assistant|>\ngood\n", "<|assistant|>\nbad\n") and (got[8].chosen_mask, got[8].rejected_mask) == ("14:18", "14:17")
    assert (got[9].prompt, got[9].chosen, got[9].rejected) == ("<|user|>\nq2\n", "<|assistant|>\nbad\n", "<|assistant|>\ngood\n")
    assert got[10].status == "no rejected side" and len(got[10].chosen) == len(LONG) + 15 and got[11].status == got[12].status == "no chosen side"
    # Turns that share a number follow by text; 14 parts at its first of two answers, the second agrees with the neighbour's.
    assert (got[14].prompt, got[14].chosen, got[14].rejected) == ("", "<|assistant|>\none\n<|assistant|>\ntwo\n", "<|assistant|>\ntwo\n" * 2)
    assert got[15].prompt == "<|assistant|>\ntwo\n" and got[15].chosen == got[15].rejected == ""
    assert preferences.preference_pairs(df.limit(0)).count() == 0


def test_sides_part_anywhere(spark, sf):
    """At other answers than the last, with several answers after."""
    got = [r for r in preferences.preference_pairs(spark.read.parquet(f"{sf}/conversations.parquet")).collect() if r.status == "pair"]
    after = [r.chosen.count("<|assistant|>") for r in got]
    assert len({r.prompt_turns for r in got}) > 2 and max(after) > 1 and all(r.chosen_mask.count(":") == n for r, n in zip(got, after, strict=True))


def test_equal_conversations_are_all_prompt(spark):
    df = spark.createDataFrame([(c, t, "user", f"t{t}") for c in (0, 1) for t in range(3)], "conv_id long, turn long, role string, text string")
    r = by_halves(df).first()
    assert (r.prompt_turns, r.chosen, r.rejected) == (3, "", "") and r.prompt.count("<|user|>") == 3


def test_sharding(docs):
    got = sharding.place(docs, "doc_id").collect()
    assert len(got) == len(ROWS) and all(0 <= r.shard < 16 for r in got)
    assert sharding.place(docs.withColumn("shard", F.lit("clash")), "doc_id").schema["shard"].dataType.simpleString() == "int"
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_language(docs, spark):
    got = {r.id: r for r in language.identify(language.document_rows(docs)).collect()}
    assert not got[1].accepted and not got[2].accepted and not got[3].accepted and got[4].accepted
    kept = language.accepted_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 5, 7]
    assert language.accepted_documents(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", "<html lang='fr'>"), (3, "http://a.de/x", "<p>der die das</p>")], "page_id long, url string, html string")
    assert language.page_languages(pages).count() == 3


def test_extraction(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav>menu</nav>"), (4, "u", "plain text & more"), (5, "u", "<p>" + LONG), (5, "u", "<p>" + LONG), (6, "u", "a < b <"), (7, "u", "<script>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in extraction.main_text(df).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[7].text) == ("", "", "", "") and got[4].text == "plain text & more"
    assert got[5].n_chars == len(LONG) - 1 and got[6].text == "a < b <"
    assert extraction.main_text(df).count() == len(rows) and extraction.main_text(df.limit(0)).count() == 0


def test_decontamination(docs, bench, spark):
    assert decontamination.find_items(docs, bench).count() == 0
    leak = spark.createDataFrame([(1, "zero ONE, two three four five six seven eight nine ten eleven"), (None, "one two three four x six seven eight nine ten")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in decontamination.find_items(leak, bench).collect())
    assert got == [(0, 3, 1), (0, 3, 1), (1, 3, 0), (1, 3, 0)]
    assert decontamination.find_items(leak.limit(0), bench).count() == 0 and decontamination.find_items(leak, bench.limit(0)).count() == 0
    assert decontamination.remove_contaminated(leak, bench).count() == 0 and decontamination.remove_contaminated(leak, bench.limit(0)).count() == 2


def test_items_in_slices(bench, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE_ITEMS", 1)
    leak = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    assert decontamination.find_items(leak, bench).count() == 2 and decontamination.remove_contaminated(leak, bench).count() == 0


def test_quality(docs):
    got = quality.quality(docs)
    assert got.count() == len(ROWS) and got.where("doc_id in (1, 2, 3) and (n_words > 0 or kept)").count() == 0
    r = got.where("doc_id = 4").first()
    assert r.n_repeat_words == r.n_words == 100_000 and r.base_failed and not r.kept
    assert quality.quality(docs.limit(0)).count() == 0
    assert quality.measure(docs).schema["fail_bits"].dataType.simpleString() == "bigint"


def test_personal_data(docs):
    got = pii.personal_data(docs)
    assert got.count() == len(ROWS) and got.where("spans <> ''").count() == 0 and pii.personal_data(docs.limit(0)).count() == 0
    assert pii.redact(docs).where("doc_id = 1").first().text is None
    for s in ("+" * 5000, "1" * 20000, "a" * 20000 + "@", "1." * 5000, "@" * 5000, "+1(" * 5000, "1 " * 9000, "A1" * 9000, "a.@" * 5000):
        assert isinstance(pii.find(s), list)


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs, 2).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True) and by[7].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), folder).count() == 0
