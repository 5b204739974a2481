"""Operators against DuckDB, brute force, exact round trips and held-out accuracy."""

import hashlib
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from voxelry.llm import decontamination, extraction, joins, language, licenses, neardup, packing, pii, quality, queries, sharding, shingles

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


def test_native_operators_run_no_python(spark, sf):
    for name in ("op1_license_scan", "op3_preferences", "op4_sharding", "op8_quality_ledger"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_packing_round_trip(spark, sf, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    got = queries.QUERIES["op2_packing"](spark, sf).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, rs in pieces.items():
        ids = [*t.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    whole = sum(r.length == 1024 for r in got)
    assert (len(got) - whole) / len(texts) < 2.5


def test_bins_hold_their_class():
    rng = random.Random(8)
    for longest in (30, 600, 3000):
        bins, rows, tokens = packing.Bins(3), [], {}
        for d in range(400):
            ids = np.arange(rng.randint(1, longest), dtype="<u4")
            tokens[d] = len(ids)
            rows += bins.add(packing.Piece(d, 0, ids, len(ids)))
            assert sum(len(p.ids) for ps in bins.open.values() for p in ps) < packing.CLASSES * 1024
        full, left = rows, list(bins.rest())
        of = {}
        for doc, start, length, _, n, sequence, offset in full:
            of.setdefault(sequence, []).append((doc, start, length, n, offset))
        for pieces in of.values():
            assert sum(p[2] for p in pieces) == 1024
            whole = [p[2] for p in pieces if p[1] + p[2] == p[3] and p[1] % 1024 == 0]
            kinds = {min(packing.CLASSES, 1024 // x) for x in whole if x < 1024}
            if len(kinds) == 1 and (k := kinds.pop()) < packing.CLASSES:
                assert len(whole) in (k, k + 1)
        for d, n in tokens.items():
            at = 0
            for _, start, length in sorted(r[:3] for r in [*full, *left] if r[0] == d):
                assert start == at
                at += length
            assert at == n


def test_both_tokenizers_agree(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    encode = packing.encoder(packing.default_tokenizer_path())
    for s in [*list(texts.values())[:80], "a<|endoftext|>b", "\x85\x1c x 你好 ㎏ 12³ Ა", "'s 'LL x\n\n  y", " " * 1500 + "x", "é" * 20000]:
        assert encode(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_shards_have_even_shares_and_move_little():
    table = sharding.fill()
    shares = np.bincount(table)
    assert shares.max() - shares.min() <= 1 and len(table) == sharding.SLOTS
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a < len(sharding.SHARDS) - 1)
    assert moved < 0.25 * len(table)
    for bad in ({"slots": 2040}, {"shards": ("a", "a")}, {"shards": ()}):
        with pytest.raises(ValueError):
            sharding.fill(**bad)


def test_text_alone_tells_held_out_languages(spark, sf):
    rows = language.document_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = language.train(rows.where("id % 2 = 0"), sample=100)
    got = language.text_evidence(rows.where("id % 2 = 1 and length(text) > 100"), model).collect()
    right = sum(language.LANGUAGES[int(np.argmax(r.likelihood))] == r.declared for r in got)
    assert right >= 0.98 * len(got)


def test_evidence_is_fused(spark):
    rows = [(k, "the and of to in that is was for it with " * 5, "en", None, "a.example.com", "com") for k in range(20)]
    rows += [(100 + k, "der die das und ist nicht ein zu von mit " * 5, "de", None, "b.example.de", "de") for k in range(20)]
    rows += [(200, "xx", None, None, "b.example.de", "de"), (201, "xx", None, None, "a.example.com", "com"), (202, "xx", None, "de", "new.example.org", "org"), (203, "die das und ist nicht ein", "en", None, "b.example.de", "de")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, address string, host string, suffix string")
    got = {r.id: r.language for r in language.identify(df).collect()}
    assert (got[200], got[201], got[202], got[203]) == ("de", "en", "de", "de")


def chances(logs):
    p = np.exp(np.array(logs) - max(logs))
    return p / p.sum()


def brute_fusion(rows, model):
    """Languages, confidences and verdicts of rows (id, text, declared, address, host, suffix) in plain Python."""
    own, n, like = {}, {}, {}
    for k, (_, text, *_) in enumerate(rows):
        h = [language.trigrams(b" " + (text or "").encode() + b" ")]
        n[k] = len(h[0])
        like[k] = model.astype(np.float32)[:, h[0]].astype(np.float64).mean(axis=1) * min(n[k], 100) if n[k] else np.zeros(4)
        own[k] = chances(like[k]) if n[k] else np.zeros(4)
    total = sum(own.values())
    whole = (total + 1) / (total.sum() + 4)
    out = {}
    for k, (i, _, declared, address, host, suffix) in enumerate(rows):
        at = lambda c, v: sum((own[j] for j, r in enumerate(rows) if (r[c] or "") == (v or "") and j != k), np.zeros(4))
        s, h = at(5, suffix), at(4, host)
        prior = (h + 10 * (s + 50 * whole) / (s.sum() + 50)) / (h.sum() + 10)
        logs = like[k] + np.log(prior)
        for given, right in ((declared, 0.85), (address, 0.7)):
            if given in language.LANGUAGES:
                logs += [np.log(right if x == given else (1 - right) / 3) for x in language.LANGUAGES]
        p = chances(logs)
        told = n[k] > 0 and like[k].max() >= -np.log(language.BUCKETS) * min(n[k], 100)
        out[i] = language.LANGUAGES[int(p.argmax())], p.max(), bool(told and p.max() >= 0.6)
    return out


def test_fusion_is_brute_force(spark, sf):
    docs = language.document_rows(spark.read.parquet(f"{sf}/documents.parquet"))
    model = language.train(docs, sample=50)
    rows = [tuple(r) for r in docs.collect()] + [(-1, None, "de", "fr", "new", "org"), (-2, "слово и дело " * 30, "en", None, "a", None), (-3, "x", None, "es", None, "es")]
    df = spark.createDataFrame(rows, docs.schema).withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "suffix")})
    got = {r.id: r for r in language.fused(language.cut(language.text_evidence(df, model))).collect()}
    expected = brute_fusion(rows, model)
    assert set(got) == set(expected) and not got[-2].accepted
    for i, (lang, p, ok) in expected.items():
        assert abs(got[i].confidence - p) < 1e-5 and (got[i].language == lang or p < 0.5) and (got[i].accepted == ok or abs(p - 0.6) < 1e-4)


def test_parts_have_the_trigrams_of_the_whole(monkeypatch):
    text = "Der Fluß und die Brücke, wie es war. " * 40
    whole = np.concatenate([language.trigrams(p) for p in language._parts(text, False)])
    monkeypatch.setattr(language, "_AT_ONCE", 7)
    assert np.array_equal(np.sort(np.concatenate([language.trigrams(p) for p in language._parts(text, False)])), np.sort(whole))


def article(page: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"<(?:/?h1|/?p|br)>", inner))
    return " ".join(p for p in parts if p)


def test_main_text_is_the_article(spark, sf):
    pages = dict(duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall())
    for r in queries.QUERIES["op6_main_text"](spark, sf).collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_main_text_of_other_layouts():
    para = "A sentence of the article, with commas, that goes on for a while. Another one follows it."
    page = f"""<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="menu"><ul><li><a href="/">Home</a></li></ul></div>
    <div id="content"><h2>The &amp; title</h2><p>{para}</p><p>{para} <a href="x">link</a>a<b>b</b>c.</p><div class="ad banner">Buy now, cheap.</div><blockquote>Quoted, yes.</blockquote></div>
    <aside>Aside text, long enough to be read. Really.</aside><form><p>Your mail, please.</p></form><div class="comments"><p>First! I like it, very much, thanks.</p></div>
    <div class="cookie-notice">We use cookies, as you know.</div><footer>&copy; us</footer></body></html>"""
    assert extraction.extract(page) == f"The & title {para} {para} linkabc. Quoted, yes."
    assert extraction.extract(f"<main><p>{para}<p>x<br>y</main><div>{para}</div>") == f"{para} x y"
    assert extraction.extract(f"<body><div><p>{para}</p></div><!-- c --><style>p{{}}</style>") == para


def test_main_text_leaves_out_links_in_an_article():
    para = "A sentence of the article, with commas, that goes on for a while. Another one follows it. " * 3
    links = '<ul><li><a href="/x">Other story</a></li></ul>'
    for tag in ("article", "main", "div id=main"):
        page = f"<body><{tag}><h1>Title</h1>{links}<p>{para}</p><p>{para}</p><div><a href=/y>Buy now</a></div><p>{para}</p><p>{para}</p>{links}</{tag.split()[0]}></body>"
        assert extraction.extract(page) == " ".join(["Title", *[para.strip()] * 4])


LONG_PARA = "A sentence of the article, with commas, that goes on for a while, as such sentences do. Another one follows it, and is as long. " * 2 + "So ends the paragraph, at last, after all that."
SHORT = "One more paragraph of the article, not as long as others, in a part of its own. It has two sentences."


@pytest.mark.parametrize(
    "more, text",
    [
        ("<div>Final words.</div>", "Final words."),
        ("<figure><img src=x></figure><div>Byline tail, last.</div>", "Byline tail, last."),
        (f"<details><summary>More</summary><p>{SHORT}</p></details>", f"More {SHORT}"),
        (f"<section><h2>S</h2><p>{SHORT}</p></section><div class=byline>By A. Writer, editor.</div>", f"S {SHORT} By A. Writer, editor."),
        ("<dl><dt>Term</dt><dd>What it means.</dd></dl><table><tr><th>Year</th><td>1999</td></tr></table>", "Term What it means. Year 1999"),
        (f'<div class="legal-history"><p>{SHORT}</p></div>', SHORT),
        (f'<section class="search-results-analysis"><p>{SHORT}</p></section>', SHORT),
        (f'<section id="history-of-social-advertising"><p>{SHORT}</p></section>', SHORT),
        ("<pre>a  b</pre><blockquote>Said so.</blockquote>", "a b Said so."),
        ("<ol><li>One</li><li>Two <a href=x>b</a></li></ol>", "One Two b"),
        (f"<div><div><div><span>{SHORT}</span></div></div></div>", SHORT),
        ("<h4>End</h4>loose text", "End loose text"),
    ],
)
@pytest.mark.parametrize("n", [1, 3, 20])
def test_main_text_keeps_all_of_an_article(more, text, n):
    nav, foot = "<nav><ul><li><a href=/>Home</a></li></ul></nav>", "<footer>Imprint, and so on.</footer><div class='cookie-banner'>We use cookies.</div>"
    away = "<div class='comment-list'><p>I like it, very much, and said so at length, thanks.</p></div><div class=share-buttons>Share it now</div><ul class=related-posts><li><a href=/z>Other</a></li></ul><div class=ad-slot>Buy, buy.</div>"
    page = f"<html><body>{nav}<article><h1>T</h1>{f'<p>{LONG_PARA}</p>' * n}{more}{away}</article>{away}{foot}</body></html>"
    assert extraction.extract(page) == " ".join(["T", *[LONG_PARA] * n, text])


def test_path_scores_equal_plain_ones():
    page = f"<body><div><h1>T!</h1><p>{LONG_PARA}<p>{SHORT} <a href=x>linked, text</a><ul><li><a href=y>Y.</a></ul><section><p>{SHORT}</section></div><article><p>x, y.</article>"
    found, paths, _ = extraction.blocks(page)
    named = [(paths.text(p), bool(places), t, linked) for p, places, t, linked, _ in found]
    assert [n[0] for n in named] == ["body/div/h1", "body/div/p", "body/div/p", "body/div/ul/li", "body/div/section/p", "body/article/p"]
    mean = lambda p, f: sum(f(t) for q, _, t, _ in named if q == p) / sum(q == p for q, *_ in named)
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    line = [(mean(p, len), 1 + mean(p, marks)) for p, *_ in named]
    wide = [line[0], *line, line[-1]]
    expected = {}
    for k, (p, placed, _, _) in enumerate(named):
        a, b = (math.sqrt(wide[k + 1][i] * (wide[k][i] / 4 + wide[k + 1][i] / 2 + wide[k + 2][i] / 4)) for i in (0, 1))
        linked, chars = (sum(x[i] if i == 3 else len(x[2]) for x in named if x[0] == p) for i in (3, 2))
        expected.setdefault(p, []).append(a * b * (1 - linked / chars) * (4 if placed else 1))
    got = {paths.text(p): s for p, s in extraction.path_scores(found).items()}
    assert got == pytest.approx({p: sum(v) / len(v) for p, v in expected.items()})


@pytest.mark.parametrize("piece", ["<script ", "<script >", "<!-- ", '<a "', "<", "<a '\"", '<a ">" ', "</", "<div>x", "<p x='", "&a", "<li>", "</b x", "<td><x-y>", "<style>", "<a<", "<p '>' \"", "<div class='a b' ", "<ul><li>x"])
def test_pages_of_open_markup_are_read_in_linear_time(piece):
    import time

    page = "<article><p>Some text, at first.</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    extraction.extract(page)
    sum(map(len, language._parts(page, True)))
    assert time.process_time() - began < 12


def test_main_text_keeps_content_beside_the_best_path():
    para = "A sentence of the article, with commas, that goes on for a while. Another one follows it. " * 3
    lead = "The lead, in its own words, is told here at first. " * 6
    page = f"<html><body><div id=content><h1>Title</h1><p>{lead}</p><section>{f'<p>{para}</p>' * 5}</section></div><div>Terms</div></body></html>"
    assert extraction.extract(page) == " ".join(["Title", lead.strip(), *[para.strip()] * 5])


def test_main_text_in_wrappers_and_beside_other_articles():
    para = "A sentence of the article, with commas, that goes on for a while. Another one follows it. " * 3
    body = f"<header><h1>Title</h1></header><p>{para}</p><p>{para}</p>"
    want = " ".join(["Title", para.strip(), para.strip()])
    foot, nav = "<footer>Imprint, and so on.</footer>", "<nav><a href=/>Home</a></nav>"
    for before, after in (("<div class=has-sidebar>", "</div>"), ("<div class=social-science>", "</div>"), ("<form id=aspnetForm>", "</form>"), ("<div class='page no-comments'>", "</div>"), ("<main>", "</main>")):
        assert extraction.extract(f"<body>{nav}{before}<article>{body}</article>{after}{foot}</body>") == want
    teaser = "<article><h2>Related</h2><p>A teaser, short as it is, of another story.</p></article>"
    assert extraction.extract(f"<body>{nav}<article>{body}</article>{teaser}{foot}</body>") == want
    assert extraction.extract(f"<body><main><article>{body}</article>{teaser}</main></body>") == want
    comments = "<div class=comments>" + "<p>I like it, very much, and said so at length, thanks.</p>" * 40 + "</div>"
    assert extraction.extract(f"<body><article>{body}{comments}</article>{comments}</body>") == want


def test_threshold_decides():
    para = "A sentence of the article, with commas, that goes on for a while. Another one follows it. " * 3
    page = f"<body><div><p>{para}</p><p>{para}</p></div><div><div><span>Some words</span></div></div><section><h6>Few</h6></section></body>"
    assert extraction.extract(page) == f"{para.strip()} {para.strip()}"
    assert "Few" in extraction.extract(page, threshold=1e-9)


def brute_distance(p, t):
    prev, best = list(range(len(p) + 1)), len(p)
    for w in t:
        cur = [0]
        for k in range(1, len(p) + 1):
            cur.append(min(prev[k] + 1, cur[-1] + 1, prev[k - 1] + (p[k - 1] != w)))
        prev, best = cur, min(best, cur[-1])
    return best


def test_edit_matching_is_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14)))) for k in range(3)]
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        w = items[0][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcx")
        text = " ".join([*text, *w, *text])
        got = sorted((k, d) for k, d, _, _ in decontamination.matcher(items, 25)(text))
        dist = {k: brute_distance(x.split(), text.split()) for k, x in items}
        assert got == sorted((k, dist[k]) for k, x in items if dist[k] <= decontamination.budget(len(x.split()), 25))


def test_decontamination_query_is_brute_force(spark, sf, texts):
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id): r.distance for r in queries.QUERIES["op7_decontamination"](spark, sf).collect()}
    expected = {}
    for k, x in items:
        p = decontamination.words_of(x)
        for d, t in texts.items():
            w = decontamination.words_of(t)
            if len(set(p) & set(w)) >= 0.5 * len(set(p)) and (e := brute_distance(p, w)) <= decontamination.budget(len(p)):
                expected[d, k] = e
    assert got == expected and got


def base_spans(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_personal_data_is_brute_force(spark, sf, texts):
    for r in queries.QUERIES["op9_personal_data"](spark, sf).collect():
        spans = base_spans(texts[r.doc_id] or "")
        coded = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(coded).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in spans) for x in pii.BASE_KINDS]
        assert set(coded) <= set(r.spans.split(","))


def test_patterns_are_the_stated_ones():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice("ab@@..-1 9+(é%") for _ in range(rng.randint(0, 24)))
        assert [(k, a, b) for k, a, b, _ in pii.find(t) if k in pii.BASE_KINDS] == base_spans(t)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = lambda t: [k for k, *_ in pii.find(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 ok") == ["iban"]
    assert kinds("his ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 555 123 4567") == ["national_phone"] and kinds("sum 555 123 4567") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == ["secret"]
    assert kinds("4111111111111111 4111111111111111") == ["card_number", "card_number"]
    assert pii.redact_text("mail a.b@c.de, +1 (743) 555-3824.") == "mail <EMAIL>, <PHONE>."


def test_long_secrets_are_found_whole():
    for n in (20, 200, 201, 5000):
        text = "token " + ("aB3dE6gH9_" * 500)[:n]
        assert pii.find(text) == [("secret", 6, 6 + n, 0.8)] and pii.redact_text(text + ".") == "token <SECRET>."


def sets_of(texts, width):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        k = min(width, len(w)) or 1
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    return out


def components(sets):
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            x, y = sets[a], sets[b]
            c = len(x & y)
            if c and 100 * c >= 80 * (len(x) + len(y) - c):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: top(d) for d in sets}


def test_near_duplicates_are_brute_force(spark, sf, texts):
    sets = sets_of(texts, 2)
    expected = components(sets)
    got = queries.QUERIES["op10_near_duplicates"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), expected[d], expected[d] == d) for d in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_several_components(spark, monkeypatch, seed):
    monkeypatch.setattr(joins, "MOST_BROADCAST", 500_000 if seed == 1 else 0)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    texts = {}
    for _ in range(5):
        base = [rng.choice(words) for _ in range(rng.choice((20, 60, 150)))]
        last = base
        for _ in range(rng.choice((3, 30, 60))):
            w = list(base if rng.random() < 0.6 else last)
            for _ in range(max(1, int(len(w) * rng.choice((0.02, 0.05, 0.07, 0.1))))):
                w[rng.randrange(len(w))] = rng.choice(words)
            last = w
            texts[len(texts)] = " ".join(w)
    shared = [rng.choice(words) for _ in range(40)]
    for _ in range(60):
        texts[len(texts)] = " ".join(shared + [rng.choice(words) for _ in range(rng.randint(5, 80))])
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 2)
    assert {r.doc_id: r.component_id for r in got.collect()} == components(sets_of(texts, 2))


def test_shingles_in_chunks(texts, monkeypatch):
    some = list(texts.values())[:60]
    whole = [s.tolist() for s in shingles.shingle_sets(some, 5)]
    assert [len(s) for s in whole] == [len(s) for s in sets_of(dict(enumerate(some)), 5).values()]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert [s.tolist() for s in shingles.shingle_sets(some, 5)] == whole


def test_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        equal = np.ones(neardup.VALUES, bool)
        equal[rng.choice(neardup.VALUES, neardup.RADIUS, replace=False)] = False
        assert any(equal[places].all() for _, places in neardup._SUBSETS)


def edited(rng, n, words=300):
    """A base and n - 1 edits of it, most of them linked with it and some not."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randint(1, max(2, words // 6))):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_rows_of_a_member_do_not_grow_with_its_group(spark):
    made = {}
    for n in (400, 2000):
        docs = spark.createDataFrame(list(enumerate(edited(random.Random(n), n, 60))), "doc_id long, text string")
        classes = neardup.signatures(docs, 2).select(F.col("doc_id").alias("id"), "hi", F.col("n_shingles").alias("n"), F.when(F.col("doc_id") % 3 > 0, 0).otherwise(F.col("doc_id")).alias("component"))
        rows = neardup.shingle_rows(docs, 2)
        made[n] = rows.count(), neardup.rare_entries(rows, classes, 80).count()
    assert made[2000][0] < 5.5 * made[400][0] and made[2000][1] < 7 * made[400][1]


def test_rare_shingles_meet_all_links(spark):
    rng = random.Random(7)
    texts = dict(enumerate([*edited(rng, 60, 80), *edited(rng, 40, 30), *edited(rng, 20, 8)]))
    sets = sets_of(texts, 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = neardup.signatures(docs, 2).select(F.col("doc_id").alias("id"), "hi", F.col("n_shingles").alias("n"), F.col("doc_id").alias("component"))
    got = {(r.a, r.b) for r in neardup.pairs_by_rare_shingles(neardup.shingle_rows(docs, 2), members, 80).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    equal = {(a, b) for a, b in linked if sets[a] == sets[b]}
    assert linked - equal <= got and len(linked) > 50


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:889], rng.integers(0, 2**63, 111, dtype=np.uint64)]))
    s = neardup.signature_rows([a, b])
    assert 0.6 < (s[0] == s[1]).mean() < 0.97


def test_policies_and_ablation(spark):
    df = spark.createDataFrame([(k, b) for k, b in enumerate([0, 0, 1, 2, 3, 4, 4, 6])], "doc_id long, fail_bits long")
    assert [r.kept for r in quality.apply_policy(df, 1).orderBy("doc_id").collect()] == [True, True, False, False, False, True, True, False]
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(df, 2).collect()}
    assert got["few_words"] == (2, 1, 3) and got["symbols"] == (3, 2, 4) and got["capitals"] == (0, 0, 2)


def test_rules_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    j = quality.quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("n_words >= 20")
    r = j.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))).first()
    assert r[0] > 0.99 and r[1] < 0.05


def test_templates_meet_themselves(spark):
    df = spark.createDataFrame([(k, "x " * 40 + t + " y" * 40) for k, (_, t, *_) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.licenses(df).collect()}
    assert all(label in got[k] for k, (label, *_) in enumerate(licenses.TEMPLATES))
    assert all(set(must.split()) <= set(t.split()) for _, t, must, _ in licenses.TEMPLATES)
    assert not any(set(absent.split()) & set(t.split()) for _, t, _, absent in licenses.TEMPLATES)


def test_sister_licenses_do_not_meet(spark):
    told = {
        "This work is licensed under the GNU General Public License, version 3": "gpl",
        "under the terms of the GNU General Public License": "gpl",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "released under the Apache license": "",
        "released under the BSD license": "",
        "licensed under the BSD license version 2 0": "",
        "Released under the MIT license.": "mit",
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    }
    df = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.licenses(df).collect()} == dict(enumerate(told.values()))


def test_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    comp = components(sets_of(texts, 5))
    items = [decontamination.words_of(x) for (x,) in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    clean = {d for d in texts if comp[d] == d and not any(" ".join(p) in " ".join(decontamination.words_of(texts[d])) for p in items)}
    assert set(left) == clean
    assert all(not pii.find(t) for t in left.values())
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == clean


def test_shuffled_joins_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = sorted(r.doc_id for r in neardup.deduplicate(docs).collect())
    langs = sorted((r.doc_id, r.lang) for r in language.accepted_documents(docs).collect())
    monkeypatch.setattr(joins, "MOST_BROADCAST", 0)
    assert few == sorted(r.doc_id for r in neardup.deduplicate(docs).collect())
    assert langs == sorted((r.doc_id, r.lang) for r in language.accepted_documents(docs).collect())


def test_language_stage_relabels_and_rejects(spark):
    german, english = "der die das und ist nicht ein zu von mit " * 5, "the and of to in that is was for it with " * 5
    rows = [(k, english, "en", "a", 1) for k in range(30)] + [(50 + k, german, "de", "b", 1) for k in range(30)]
    rows += [(100, german, "en", "b", 1), (101, english, None, "a", 1), (102, "123 !!", "en", "a", 1), (103, german, "de", None, 1)]
    out = {r.doc_id: r.lang for r in language.accepted_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert (out[100], out[101], out[103]) == ("de", "en", "de") and 102 not in out and len(out) == 63
