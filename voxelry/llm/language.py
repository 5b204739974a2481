"""Languages of texts by Bayesian fusion of evidence.

Four sources are multiplied: the likelihood of the text's byte trigrams under each language, the declared language,
a language in the address (country suffix or first path segment), and a prior for the host. Host priors come from the
text evidence of all rows, summed by host; each host is smoothed towards its address suffix and each suffix towards
the whole (grouped aggregation, combined before the shuffle, so one host may hold any share of the rows). A row's own
text is left out of its host's and its suffix's sums, so that it counts once.

The trigram model is fitted on a bounded sample of rows with a declared language, ``SAMPLE`` rows a language in
expectation, taken by a hash of the id; everything else uses every row and whole texts.

A text that uniform trigrams explain better than every language is in none of them and not accepted. Null or empty
texts, and texts without letters, give no text evidence and are not accepted. Of languages with one posterior, the
first in ``LANGUAGES`` is taken. A null declaration or
address leaves that source out; rows with a null host share one. Repeated rows count as often as they come and give
repeated rows. A table without rows gives none; without any declared language the model is flat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.joins import sized
from voxelry.llm.markup import without_markup
from voxelry.storage import cut

LANGUAGES = ("de", "en", "es", "fr")
#: Rows of each language that the trigram model is fitted on, in expectation.
SAMPLE = 2000
BUCKETS = 1 << 15
#: A text counts as at most so many independent trigrams.
EFFECTIVE = 100
#: Chances that a declaration and an address name the text's language.
DECLARED, ADDRESS = 0.85, 0.7
#: Rows' worth of smoothing of hosts by suffixes and of suffixes by the whole.
HOST_SMOOTHING, SUFFIX_SMOOTHING = 10.0, 50.0
#: Least posterior probability of an accepted row.
ACCEPT = 0.6
#: Country suffixes with one of the languages.
COUNTRIES = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "fr": "fr"}

_REFERENCE = re.compile(rb"&#?\w{1,64};")
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_AT_ONCE = 1 << 18


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams whose middle is a letter; all that is not a letter is a space."""
    b = _FOLD[np.frombuffer(text, np.uint8)]
    mid = b[1:-1]
    h = b[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + mid.astype(np.uint32) * np.uint32(0x85EBCA77) + b[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)
    return (h[mid != 0x20] >> np.uint32(17)).astype(np.int64)


def _parts(text: str | None, markup: bool) -> Iterator[bytes]:
    """The text between two spaces, in parts that overlap by two bytes: their trigrams are the text's."""
    data = (" ".join(without_markup(text or "")) if markup else text or "").encode()
    data = b" " + (_REFERENCE.sub(b" ", data) if markup else data) + b" "
    for at in range(0, len(data) - 2, _AT_ONCE):
        yield data[at : at + _AT_ONCE + 2]


def train(rows: DataFrame, languages=LANGUAGES, markup: bool = False, sample: int = SAMPLE) -> np.ndarray:
    """Log-likelihoods by language and bucket, from rows of ``id, text, declared``."""
    labelled = rows.where(F.col("declared").isin(*languages))
    share = {r["declared"]: min(1.0, sample / r["count"]) for r in labelled.groupBy("declared").count().collect()}
    if not share:
        return np.zeros((len(languages), BUCKETS))
    limit = F.element_at(F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30))))), F.col("declared"))
    taken = labelled.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) < limit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(BUCKETS, np.int64) for k in range(len(languages))}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                for part in _parts(text.as_py(), markup):
                    sums[languages.index(lang.as_py())] += np.bincount(trigrams(part), minlength=BUCKETS)
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(s[at])], ["k", "bucket", "n"])

    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in taken.select("text", "declared").mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["k"], r["bucket"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(rows: DataFrame, model: np.ndarray, markup: bool = False) -> DataFrame:
    """``rows`` with ``likelihood`` (log, by language) and ``n_trigrams`` in place of ``text``."""
    table = np.ascontiguousarray(model.T.astype(np.float32))
    others = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                sums, numbers = [], []
                for text in batch.column(0):
                    total, n = np.zeros(table.shape[1]), 0
                    for part in _parts(text.as_py(), markup):
                        h = trigrams(part)
                        total += table[h].sum(axis=0, dtype=np.float64)
                        n += len(h)
                    sums.append((total / n * min(n, EFFECTIVE) if n else total).tolist())
                    numbers.append(n)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums, pa.list_(pa.float64())), pa.array(numbers, pa.int64())], [*others, "likelihood", "n_trigrams"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)
    return rows.select("text", *others).mapInArrow(score, f"{schema}, likelihood array<double>, n_trigrams long")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _own(languages) -> Column:
    """What a row's text alone says: chances of the languages, or zeros without a text."""
    return F.when(F.col("n_trigrams") > 0, _softmax(F.col("likelihood"))).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def _without(sums: Column, own: Column, weight: float, towards: Column) -> Column:
    """Sums of all rows as chances without this row's share, smoothed."""
    left = F.zip_with(sums, own, lambda s, o: F.greatest(s - o, F.lit(0.0)))
    total = F.aggregate(left, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(left, towards, lambda x, t: (x + weight * t) / (total + weight))


def host_sums(evidence: DataFrame, languages=LANGUAGES) -> tuple[DataFrame, list[float]]:
    """``host, suffix, by_host, by_suffix``: sums of the rows' chances of the languages; and their shares in the whole."""
    names = [f"n{k}" for k in range(len(languages))]
    sums = [F.sum(n).alias(n) for n in names]
    own = _own(languages)
    by_host = cut(evidence.select("host", "suffix", *(F.get(own, F.lit(k)).alias(n) for k, n in enumerate(names))).groupBy("host", "suffix").agg(*sums))
    by_suffix = by_host.groupBy("suffix").agg(*sums)
    total = [x or 0.0 for x in by_suffix.agg(*sums).first()]
    whole = [(n + 1.0) / (sum(total) + len(names)) for n in total]
    both = by_host.select("host", "suffix", F.array(*names).alias("by_host")).join(by_suffix.select("suffix", F.array(*names).alias("by_suffix")), "suffix")
    return both, whole


def identify(rows: DataFrame, languages=LANGUAGES, markup: bool = False, sample: int = SAMPLE) -> DataFrame:
    """``id, language, confidence, declared, address, n_trigrams, accepted`` from ``id, text, declared, address, host, suffix``."""
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "suffix": F.coalesce("suffix", F.lit(""))})
    model = train(rows, languages, markup, sample)
    return fused(cut(text_evidence(rows, model, markup)), languages)


def fused(evidence: DataFrame, languages=LANGUAGES) -> DataFrame:
    """The result of :func:`identify` from the written evidence of the texts."""
    sums, whole = host_sums(evidence, languages)

    def channel(given: str, right: float) -> list[Column]:
        wrong = (1 - right) / (len(languages) - 1)
        known = F.col(given).isin(*languages)
        return [F.when(known, F.when(F.col(given) == lang, F.log(F.lit(right))).otherwise(F.log(F.lit(wrong)))).otherwise(F.lit(0.0)) for lang in languages]

    both = evidence.join(cut(sums), ["host", "suffix"]).withColumn("own", _own(languages))
    both = both.withColumn("towards", _without(F.col("by_suffix"), F.col("own"), SUFFIX_SMOOTHING, F.array(*map(F.lit, whole))))
    both = both.withColumn("prior", _without(F.col("by_host"), F.col("own"), HOST_SMOOTHING, F.col("towards")))
    logs = F.array(*(F.get("likelihood", F.lit(k)) + F.log(F.get("prior", F.lit(k))) + d + a for k, (d, a) in enumerate(zip(channel("declared", DECLARED), channel("address", ADDRESS), strict=True))))
    uniform = -math.log(BUCKETS) * F.least("n_trigrams", F.lit(EFFECTIVE))
    told = (F.col("n_trigrams") > 0) & (F.array_max("likelihood") >= uniform)
    fused = both.select("id", "declared", "address", "n_trigrams", told.alias("told"), _softmax(logs).alias("posterior"))
    best = F.array_max("posterior")
    language = F.get(F.array(*map(F.lit, languages)), (F.array_position("posterior", best) - 1).cast("int"))
    return fused.select("id", language.alias("language"), best.alias("confidence"), "declared", "address", "n_trigrams", (F.col("told") & (best >= ACCEPT)).alias("accepted"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The evidence of web pages: declared markup language, host, suffix and address language."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    segment = F.lower(F.regexp_extract("url", r"^[^:]*://[^/]*/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})\b", 1))
    country = F.element_at(F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair)), suffix)
    none = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("text"), none(declared).alias("declared"), F.coalesce(country, none(segment)).alias("address"), host.alias("host"), suffix.alias("suffix"))


def page_languages(pages: DataFrame) -> DataFrame:
    """``page_id``, the language found with its probability, the evidence, and ``kept``: the language is sure enough."""
    return identify(page_rows(pages), markup=True).withColumnsRenamed({"id": "page_id", "accepted": "kept"})


def document_rows(docs: DataFrame) -> DataFrame:
    """The evidence of documents: the stated language and, for the host, the source."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), F.col("lang").alias("declared"), none.alias("address"), F.col("source").alias("host"), none.alias("suffix"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language stays unknown, all columns; ``lang`` is the language found.

    Rows that share an id (or have none) are accepted together if one of them is, with its language. Only ids whose
    rows are rejected or change their language are joined with the documents.
    """
    found = identify(document_rows(docs)).groupBy("id").agg(
        F.max(F.struct("accepted", "confidence", "language")).alias("best"), F.max(~F.col("declared").eqNullSafe(F.col("language"))).alias("differs"), F.min("declared").alias("low"), F.max("declared").alias("high")
    )
    changes = F.col("differs") | ~F.col("best.accepted") | ~F.col("low").eqNullSafe(F.col("high"))
    odd = cut(found.where(changes).select(F.col("id").alias("id_found"), F.col("best.accepted").alias("ok"), F.col("best.language").alias("language_found")))
    columns = [F.coalesce("odd.language_found", f"docs.`{c}`").alias(c) if c == "lang" else F.col(f"docs.`{c}`") for c in docs.columns]
    both = docs.alias("docs").join(sized(odd).alias("odd"), F.col("docs.doc_id").cast("long").eqNullSafe(F.col("odd.id_found")), "left")
    return both.where(F.coalesce("odd.ok", F.lit(True))).select(*columns)
