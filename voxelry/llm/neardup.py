"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document is its set of word shingles; its signature has 64 MinHash values of 16 bits. Two sets of similarity 0.8
agree in a value with probability 0.8, and the chance that they differ in more than ``RADIUS`` = 31 of the 64 is
below one in a million. Cut into 16 chunks of four values, two signatures that differ in at most 31 values agree in
some chunk but for one value at most (pigeonhole). So each signature is indexed under every chunk with each one of
its values left out, 64 keys in all, and every pair within the radius meets under a key.

Equal sets are one class from the start, and only class representatives are indexed. Under each key the smallest
member leads: all others are compared with it, by signature and, within the radius, by their full sets, so that a key
costs as many comparisons as it has members. The links found give components. Nearly every group of copies is one
component then, and only keys whose members lie in several components are still open: two members of such a key may
be linked though neither is linked with its leader.

The members of open keys meet by their rarest shingles, once each and not once a key. Shingles are ordered by their
frequency among open members, and only as many of the rarest as any link must share one of are kept of a set (prefix
filter). Under a shared one, members of different components whose sizes and positions allow a link are a pair, and
members of the largest component are not compared with each other. Pairs within the signatures' radius are confirmed on
full sets. So the rows of a member depend on its own size only, however large its keys are: a common shingle is left
out by its order, a rare one brings few members together. No link between components is lost, and no key's members
meet in one task or emit all their pairs.

Null and empty texts have no shingles and are linked with nothing. Documents with one id are one vertex; those without
an id are linked with nothing and kept, with a null component. Other columns are ignored by :func:`near_duplicates`
and kept by :func:`deduplicate`; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.joins import sized
from voxelry.llm.shingles import mixed, shingle_sets
from voxelry.operators.graph import connected_components
from voxelry.storage import cut, dropped

VALUES, CHUNK, ERRORS = 64, 4, 1
CHUNKS = VALUES // CHUNK
#: Signatures that differ in at most so many values meet under a key.
RADIUS = CHUNKS * (ERRORS + 1) - 1
PERCENT = 80
_FACTORS = np.random.default_rng(16).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SUBSETS = [(c, [c * CHUNK + k for k in range(CHUNK) if k not in out]) for c in range(CHUNKS) for out in combinations(range(CHUNK), ERRORS)]
_AT_ONCE = 100_000


def signature_rows(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64 values of 16 bits for each set; sets must not be empty."""
    out = np.empty((len(sets), VALUES), np.uint16)
    first = 0
    while first < len(sets):
        last, size = first + 1, len(sets[first])
        while last < len(sets) and size + len(sets[last]) <= _AT_ONCE:
            size += len(sets[last])
            last += 1
        h = np.concatenate(sets[first:last])
        at = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        for k in range(VALUES):
            least = np.minimum.reduceat(h * _FACTORS[k], at)
            out[first:last, k] = mixed(least) >> np.uint64(48)
        first = last
    return out


def signatures(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, hi, lo, signature``: set size, a 128-bit fingerprint of the set, and its MinHash values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = list(shingle_sets(batch.column(1).to_pylist(), width))
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                rows = signature_rows(full) if full else np.empty((0, VALUES), np.uint16)
                values = iter(rows)
                hi = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
                lo = np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
                coded = [next(values).tobytes() if k else None for k in n]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hi), pa.array(lo), pa.array(coded, pa.binary())], ["doc_id", "n_shingles", "hi", "lo", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(work, "doc_id long, n_shingles long, hi long, lo long, signature binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def index_keys(classes: DataFrame) -> DataFrame:
    """``key, id, n``: every class under each chunk with each choice of values left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = _matrix(batch.column(2)).astype(np.int64)
                keys = np.empty((len(_SUBSETS), len(rows)), np.int64)
                for k, (_, places) in enumerate(_SUBSETS):
                    key = np.full(len(rows), k, np.int64)
                    for p in places:
                        key = key << 16 | rows[:, p]
                    keys[k] = key
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.tile(batch.column(c).to_numpy(), len(_SUBSETS))) for c in (0, 1))], ["key", "id", "n"])

    return classes.select("id", "n", "signature").mapInArrow(work, "key long, id long, n long")


def _alike(n: str, m: str, percent: int):
    """Sizes that sets of this similarity can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def within_radius(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``RADIUS`` values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1) >= VALUES - RADIUS
                yield batch.select([0, 1]).filter(pa.array(near))

    side = lambda x: classes.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "signature_a", "signature_b").mapInArrow(work, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, of documents whose full shingle sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                new = [t for t in dict.fromkeys(texts[0] + texts[1]) if t not in sets]
                sets |= dict(zip(new, shingle_sets(new, width), strict=True))
                found = []
                for x, y in ((sets[a], sets[b]) for a, b in zip(*texts, strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    found.append(100 * common >= percent * (len(x) + len(y) - common) > 0)
                sets = {t[-1]: sets[t[-1]] for t in texts}
                yield batch.select([0, 1]).filter(pa.array(found))

    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    docs = docs.join(sized(ids), "doc_id", "left_semi")
    side = lambda x: docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")  # leaders last: Spark splits what has their many members' texts
    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def shingle_rows(docs: DataFrame, width: int) -> DataFrame:
    """``id, hi, shingle``: the distinct shingles of each document's set, whose sum is ``hi``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sets = list(shingle_sets(batch.column(1).to_pylist(), width))
                hi = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
                coded = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi), coded], ["id", "hi", "shingles"])

    sets = docs.select("doc_id", "text").mapInArrow(work, "id long, hi long, shingles array<long>")
    return sets.dropDuplicates(["id", "hi"]).select("id", "hi", F.explode("shingles").alias("shingle"))


def _enough(common, n, m, percent: int):
    """Whether sets of sizes n and m with so many shingles in common are linked."""
    return common * (100 + percent) >= (n + m) * percent


def rare_entries(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``shingle, id, n, component, rest``: the shingles of each member by which it may be linked.

    ``rows`` has ``id, hi, shingle`` and ``members`` has ``id, hi, n, component``. In order of frequency, a set linked with
    another shares one of its first shingles with it, those with at least ``percent`` of the set at or after them;
    ``rest`` is how many there are. Shingles of one member only come first and match nothing.
    """
    shared = cut(rows.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1"))
    own = Window.partitionBy("id", "hi")
    ranked = rows.join(shared, "shingle").join(members, ["id", "hi"]).select(
        "shingle", "id", "n", "component", F.count("*").over(own).alias("n_shared"), F.row_number().over(own.orderBy("f", "shingle")).alias("at")
    )
    return ranked.withColumn("rest", F.col("n_shared") - F.col("at") + 1).where(F.col("rest") * 100 >= F.col("n") * percent).select("shingle", "id", "n", "component", "rest")


def pairs_by_rare_shingles(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components that share a rare shingle and can be linked by size and position."""
    entries = cut(rare_entries(rows, members, percent))
    parts = entries.groupBy("shingle", "component").agg(F.count("*").alias("members"), F.min("n").alias("least"))
    groups = parts.groupBy("shingle").agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("parts"), F.min("least").alias("least")).where("parts > 1")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    groups = cut(groups.select("shingle", "least", F.col("top.component").alias("main")))
    met = entries.join(groups, "shingle").where(_enough(F.col("rest"), F.col("n"), smallest, percent))
    met = cut(met.select("shingle", "id", "n", "component", "rest", (F.col("component") == F.col("main")).alias("main")))
    a, b = met.where("not main").alias("a"), met.alias("b")
    can = _enough(F.least("a.rest", "b.rest"), F.col("a.n"), F.col("b.n"), percent)
    differ = (F.col("a.component") != F.col("b.component")) & (F.col("b.main") | (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & differ & can).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    found = cut(pairs.distinct())
    dropped(entries, groups, met)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(signatures(docs, width))
    group = signed.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo", F.col("n_shingles").alias("n"))
    classes = cut(group.agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")))
    keys = index_keys(classes)
    buckets = cut(keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("members")).where("members > 1").select("key", F.col("first.id").alias("leader"), F.col("first.n").alias("leader_n"), "members"))
    met = cut(keys.join(buckets, "key"))
    led = met.where("id <> leader").where(_alike("n", "leader_n", percent)).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    near = cut(within_radius(led, classes))
    links = cut(confirmed(near, docs, width, percent))
    components = cut(connected_components(links, "a", "b"))

    # Keys whose members are not all connected yet.
    placed = met.where("members > 2").join(components, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = cut(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"))
    open_ids = placed.join(several, "key").select("id", "component").distinct()
    members = cut(classes.join(open_ids, "id").select("id", "hi", "n", "component"))
    open_docs = docs.join(sized(members.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    rows = cut(shingle_rows(open_docs, width))
    candidates = pairs_by_rare_shingles(rows, members, percent)
    near2 = cut(within_radius(candidates, classes))
    more = cut(confirmed(near2, docs, width, percent))

    # Components that these links join.
    label = components.select("id", "component")
    side = lambda x: label.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    between = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    joined = cut(connected_components(between, "a", "b").select(F.col("id").alias("component_id"), F.col("component").alias("joined")))
    named = classes.join(components, "id", "left").select("hi", "lo", "n", F.coalesce("component", "id").alias("component_id"))
    named = cut(named.join(sized(joined), "component_id", "left").select("hi", "lo", "n", F.coalesce("joined", "component_id").alias("component_id")))
    dropped(classes, buckets, met, several, near, links, components, members, rows, candidates, near2, more, joined)
    on = (signed["hi"] == named["hi"]) & (signed["lo"] == named["lo"]) & (signed["n_shingles"] == named["n"])
    component = F.when(signed["doc_id"].isNotNull(), F.coalesce(named["component_id"], signed["doc_id"]))
    return signed.join(named, on, "left").select(signed["doc_id"], signed["n_shingles"], component.alias("component_id"), signed["doc_id"].eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one document of each component; of rows that repeat an id, one stays."""
    decided = cut(near_duplicates(docs, width, percent))
    again = cut(decided.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if not again.isEmpty():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = docs.join(sized(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
        docs = docs.join(sized(again), "doc_id", "left_anti").unionByName(one)
    gone = cut(decided.where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
