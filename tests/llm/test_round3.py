"""Nearest vectors, clustering and collocations against plain versions, on hard values and in all edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle import connect, same
from voxelry.llm import clustering, collocations, neighbours, queries

VEC = "vec_id long, embedding array<double>, label int, row long, cluster int, rank string"


@pytest.mark.parametrize("name", ["op11_nearest_vectors", "op12_cluster_vectors"])
def test_same_as_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], VEC)


def plain_nearest(rows, k, every):
    fit = [(n, i, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in fit:
        if i is None or i % every:
            continue
        found = []
        for m, j, w in fit:
            if m != n and len(w) == len(v):
                s = 0.0
                for x, y in zip(v, w, strict=True):
                    s += x * y
                found.append((-s, j is None, j))
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_nearest_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(1)
    vector = lambda n: [rnd.choice((rnd.gauss(0, 1), float(rnd.randint(-2, 2)), rnd.gauss(0, 1e-3))) for _ in range(n)]
    rows = [(i % 150, vector(7)) for i in range(200)] + [(i, vector(3)) for i in range(20)]
    copy = vector(7)
    near = [(1000 + i, [x + (i % 3) * 1e-15 for x in copy]) for i in range(120)]
    odd = [(0, None), (5, []), (10, [0.0] * 7), (15, [1.0, None] + [0.0] * 5), (20, [math.nan] * 7), (25, [math.inf] * 7), (None, copy), (30, [1e200] * 7), (35, [5e-324] * 7), (2000, copy), (2000, copy)]
    rows += near + odd
    for side, tile in ((8192, 1024), (64, 16)):
        monkeypatch.setattr(neighbours, "MOST_SIDE", side)
        monkeypatch.setattr(neighbours, "TILE", tile)
        got = neighbours.nearest_vectors(table(spark, rows), 9, 5)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_nearest(rows, 9, 5)


def test_nearest_of_few_or_no_vectors(spark):
    assert neighbours.nearest_vectors(table(spark, [])).count() == 0
    assert neighbours.nearest_vectors(table(spark, [(20, [1.0])])).count() == 0
    assert [tuple(r) for r in neighbours.nearest_vectors(table(spark, [(20, [2.0]), (None, [3.0]), (1, [-1.0])])).collect()] == [(20, 1, None, 6.0), (20, 2, 1, -2.0)]


@pytest.mark.parametrize("dim, spread", [(64, 1.0), (1500, 1.0), (64, 1e-5)])
def test_bounds_hold(dim, spread):
    """The error bounds enclose every product, and most pairs never come to double precision."""
    rng = np.random.default_rng(dim)
    q, c = rng.normal(size=(40, dim)), rng.normal(size=(500, dim)) * spread
    (qc, qs, qn, qr), (cc, cs, cn, cr) = neighbours.quantised(q), neighbours.quantised(c)
    near = neighbours.code_products(qc, cc) * (qs[:, None] * cs)
    error = qr[:, None] * (cn + cr) + (qn + qr)[:, None] * cr
    off = np.abs(q @ c.T - near)
    assert (off <= error * (1 + 1e-9) + 1e-12 * spread).all() and (near + error).std() > 5 * error.mean() / math.sqrt(dim)
    assert (neighbours.code_products(qc, cc) == qc.astype(int) @ cc.astype(int).T).all()


def test_grid_is_bounded():
    assert neighbours.grid(2565, 51282, 12) == (1, 16)
    n_q, n_c = neighbours.grid(10**8, 2 * 10**9, 10_000)
    assert 10**8 / n_q <= neighbours.MOST_SIDE and 2 * 10**9 / n_c <= neighbours.MOST_SIDE


def plain_lloyd(rows, k, rounds, seed, dim, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) and abs(scale * x) < clustering.BOUND for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centres = [p for _, p in sorted(((name(i), p) for i, p in kept if i is not None))[:k]]
    gap = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c, strict=True))
    nearest = lambda p: min((gap(p, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, p in kept:
            groups[nearest(p)[1]].append(p)
        centres = [tuple(sum(xs) // len(groups[n]) for xs in zip(*groups[n], strict=True)) if n in groups else c for n, c in enumerate(centres)]
    last = [(i, *nearest(p)) for i, p in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    total = sum(inertia.values())
    return sorted([(i, n, d, inertia[n], total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in last], key=repr)


@pytest.mark.parametrize("dim, k, block", [(64, 8, 1024), (2, 5, 1024), (3, 30, 50)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, dim, k, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rnd = random.Random(dim)
    middles = [[rnd.gauss(0, 5) for _ in range(dim)] for _ in range(6)]
    rows = [(i % 280, [rnd.gauss(x, 0.3) for x in rnd.choice(middles)]) for i in range(300)]
    rows += [(400 + i, list(middles[0])) for i in range(150)] + [(600 + i, [float(rnd.randint(-1, 1)) for _ in range(dim)]) for i in range(60)]
    rows += [(1, None), (2, []), (3, [1.0] * (dim + 1)), (4, [None] * dim), (5, [math.nan] * dim), (6, [math.inf] + [0.0] * (dim - 1)), (7, [1e30] * dim), (None, [0.5] * dim), (8, [1e5] * dim)]
    got = clustering.cluster_vectors(table(spark, rows), k, 6, 3, dim)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd(rows, k, 6, 3, dim, 1024)


def test_clusters_of_few_or_no_vectors(spark):
    none = clustering.cluster_vectors(table(spark, [(1, None)]))
    assert none.count() == 0 and none.columns == clustering.cluster_vectors(table(spark, [(1, [0.5] * 64)])).columns
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64)]
    assert sorted(map(tuple, clustering.cluster_vectors(table(spark, rows)).collect()), key=repr) == plain_lloyd(rows, 8, 10, 3, 64, 1024)


@pytest.mark.parametrize("kind", ["plane", "copies", "line", "one"])
def test_cover_tree_covers_and_separates(kind):
    rng = np.random.default_rng(5)
    points = {"plane": rng.integers(-900, 900, (400, 2)), "copies": np.repeat(rng.integers(0, 9, (3, 2)), 50, 0), "line": np.arange(300)[:, None] ** 2, "one": np.zeros((1, 4), int)}[kind].astype(np.int64)
    tree, order = clustering.cover_tree(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(len(points)))
    for n in range(len(tree.start)):
        a, b = tree.start[n], tree.stop[n]
        centre = tree.points[tree.centre[n]]
        gaps = np.sqrt(clustering.squared(tree.points[a:b], centre))
        assert a <= tree.centre[n] < b and gaps.max() <= tree.radius[n]
        kids = range(tree.first[n], tree.first[n] + tree.children[n])
        if kids:
            assert [tree.start[k] for k in kids] == [a, *(tree.stop[k] for k in kids)][:-1] and tree.stop[kids[-1]] == b
            assert tree.centre[kids[0]] == tree.centre[n] and max(tree.radius[k] for k in kids) <= tree.radius[n] / 2 * (1 + 1e-6)
            centres = tree.points[tree.centre[list(kids)]]
            apart = np.sqrt(clustering.squared(centres[:, None], centres[None])) + np.eye(len(kids)) * 1e18
            assert apart.min() >= tree.radius[n] / 2 * (1 - 1e-6)
        else:
            assert b - a <= clustering.LEAF or tree.radius[n] == 0


def test_whole_nodes_are_assigned_without_their_vectors():
    """On vectors in clumps, far fewer distances are taken than there are vectors."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-(10**6), 10**6, (8, 3))
    points = (middles[rng.integers(0, 8, 1024)] + rng.integers(-5, 5, (1024, 3))).astype(np.int64)
    tree, _ = clustering.cover_tree(points)
    centres, names = clustering.centroid_tree(middles[:6])
    whole, owner = clustering.assigned(tree, centres, names)
    held = sum(int((tree.stop - tree.start)[nodes].sum()) for nodes, _ in whole)
    assert held >= 900 and sum(len(nodes) for nodes, _ in whole) < 50
    assert (owner == np.argmin(clustering.squared(tree.points[:, None], middles[:6][None]), axis=1)).all()


def plain_phrases(rows, least, most, top):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, most + 1):
                f[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        inside = {(p[i : i + m], a) for p, a in frequent.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        ranked = []
        for p, a in frequent.items():
            if len(p) > 1 and (p, a) not in inside:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, total[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


TEXT = "doc_id long, text string, lang string, source string, n_chars long, phrase string, m int, word string, part int"


def texts(spark, rows):
    return spark.createDataFrame([(n, t, lang, "s", 0, "p", 1, "w", 2) for n, (lang, t) in enumerate(rows)], TEXT)


@pytest.mark.parametrize("share, held", [(0.25, 1 << 21), (0.001, 50), (100.0, 7)])
def test_phrases_equal_plain_counts(spark, monkeypatch, share, held):
    """With few and many very common words, and counts passed on early."""
    monkeypatch.setattr(collocations, "SHARE", share)
    for name in ("HELD", "SUFFIXES", "NUMBERED"):
        monkeypatch.setattr(collocations, name, held)
    monkeypatch.setattr(collocations, "PART", max(held, 20))
    monkeypatch.setattr(collocations, "BUCKET", max(held, 300))
    rnd = random.Random(7)
    words = ["the", "THE", "of", "a", "a\1b", "a\0", "\1", "Émile", "é", "x-y", "東京", "b\x1fc", *(f"w{k}" for k in range(40))]
    weights = [1 / (k + 1) for k in range(len(words))]
    line = lambda: "".join(w + rnd.choice([" "] * 8 + ["  ", "\t", ". ", "\n", "!", "\r\n", " , "]) for w in rnd.choices(words, weights, k=rnd.randint(0, 60)))
    rows = [(rnd.choice(["en", "en", "de", None, "und", ""]), line()) for _ in range(150)]
    rows += [("en", "of the a\0 b c d e f. of the a\0") for _ in range(30)] + [("en", None), ("fr", ""), ("fr", " .\n"), (None, None), ("en", "the " * 3000)]
    got = collocations.collocations(texts(spark, rows), least=5, top=300)
    assert [c for c in got.columns] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = plain_phrases(rows, 5, 5, 300)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100


def test_scores_beyond_64_bits(spark):
    """Products of 1000 a n that pass a long are exact."""
    from pyspark.sql import functions as F

    got = spark.range(1).select(*((F.lit(v).cast(f"decimal({p},0)")).alias(c) for c, v, p in (("a", 9 * 10**12 + 7, 15), ("n", 8 * 10**17 + 3, 19), ("l", 3 * 10**13 + 1, 18), ("r", 2 * 10**13 + 9, 19)))).select(F.expr("(cast(a * 1000 as decimal(18,0)) * n) div (l * r)").alias("s")).first()["s"]
    assert got == 1000 * (9 * 10**12 + 7) * (8 * 10**17 + 3) // ((3 * 10**13 + 1) * (2 * 10**13 + 9))


def test_no_phrases(spark):
    assert collocations.collocations(texts(spark, [])).count() == 0
    assert collocations.collocations(texts(spark, [("en", "one two")])).count() == 0


def test_common_words_lengthen_the_key(spark):
    """Suffixes that begin with very common words are dealt by the words after them too."""
    rows = [("en", f"the of w{k} x. the of w{k} x") for k in range(200)]
    docs = texts(spark, rows)
    words = collocations.word_counts(docs)
    every, common = collocations.bitmap(words, 1), collocations.bitmap(words, 300)
    blocks = collocations.suffixes(docs, every, common, 5, 1000).collect()
    of = lambda first: {b.bucket for b in blocks for row in collocations._wide(b.suffixes, 5) if collocations._unpacked(b.words).split(b"\0")[row[0] - 1] == first}
    assert len(of(b"the")) > 100 and len(of(b"w7")) == 1
