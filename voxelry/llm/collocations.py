"""Phrases whose words stand together more often than chance has it, by suffix sorting.

1. Words are counted by language. Two bitmaps of a fixed size, over hashes of words, then say which words may reach the
   least count and which are so common that their suffixes would fill a task. They may say yes too often, never no.
2. The suffixes of each run of frequent words, cut after ``most`` words, are counted in the task and dealt by language
   and first word to buckets; while a key ends in a very common word, the next word belongs to the key too. What a task has
   for a bucket is one row: its words, and the suffixes as numbers of these words.
3. A bucket's suffixes (about ``BUCKET``) are sorted in reverse lexicographic order and all their prefixes counted with one
   stack. Prefixes of very common words only can stand in several buckets and are added up; all others are whole in one.
4. Counts of the parts are joined to the phrases, cut by cut.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each time; ties go by
the contract of :func:`phrases`; an empty table gives no rows. Texts may be of any length, and words too. Other columns
are not looked at. Scores are exact: their products are decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.llm.joins import MOST_BROADCAST
from voxelry.storage import cut

#: Bits of a bitmap of words; words that a task counts before it passes them on, and their bytes.
BITS, HELD, HELD_BYTES = 1 << 22, 300_000, 1 << 26
#: Suffixes that a task counts before it passes them on, words that it numbers, and bytes of a text split at once.
SUFFIXES, NUMBERED, PART = 1 << 21, 1 << 19, 1 << 22
#: Suffixes that a bucket has in the mean, at most. A word is very common if its own are more than this share of the mean.
BUCKET, SHARE = 1_000_000, 1.0
#: Bytes of phrases that are broadcast, at most.
MOST_BYTES = 1 << 26
#: What ends a piece, for the words alone and as line ends; Spark's own bitmaps have 32,768 bits.
_SPACES, _ENDS = bytes.maketrans(b".,;:!?", b" " * 6), bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_MAP = 1 << 15


def _lower(text: str | None) -> bytes:
    """A-Z as a-z, without the byte 0, which stands between words; told apart again by :func:`_plain`."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if b"\0" in data or b"\1" in data:
        data = data.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")
    return data


def _plain(word: bytes) -> bytes:
    return word.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in word else word


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts, cut at a space or an end of a line."""
    at = 0
    while len(data) - at > PART:
        end = at + PART
        while end < len(data) and data[end] not in b" \n":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def tokens(data: bytes) -> list[bytes]:
    """The words of a lower-cased text, with the byte 0 where a piece ends."""
    return data.translate(_ENDS).replace(b"\n", b" \0 ").split()


def _bit(lang: bytes, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(lang)) % BITS


class _Counts:
    """Counts by language and word, passed on when there are many."""

    def __init__(self):
        self.by, self.bytes = {}, 0

    def flushed(self) -> Iterator[pa.RecordBatch]:
        for lang, counts in self.by.items():
            keys = list(counts)
            columns = [pa.array([lang.decode()] * len(keys), pa.string()), pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "a"])
        self.by, self.bytes = {}, 0

    def full(self) -> bool:
        return sum(map(len, self.by.values())) > HELD or self.bytes > HELD_BYTES


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, str]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield lang.encode(), text


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, a, bit``: how often each word occurs, and its place in the bitmaps, as :func:`_bit` has it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for lang, text in _texts(batches):
            for part in _parts(_lower(text).translate(_SPACES)):
                held.by.setdefault(lang, Counter()).update(part.split())
                held.bytes += len(part)
                if held.full():
                    yield from held.flushed()
        yield from held.flushed()

    parts = docs.select("lang", "text").mapInArrow(work, "lang string, word binary, a long")
    bit = F.crc32(F.concat(F.encode("lang", "UTF-8"), F.col("word"))) % BITS
    return parts.groupBy("lang", "word").agg(F.sum("a").alias("a")).withColumn("bit", bit.cast("int"))


def bitmap(words: DataFrame, least: int) -> dict[int, bytes]:
    """The bits of words that occur ``least`` times or more: at most BITS / 8 bytes, whatever the number of words."""
    where = words.where(F.col("a") >= least).select((F.col("bit") / _MAP).cast("int").alias("part"), (F.col("bit") % _MAP).cast("long").alias("at"))
    return {r["part"]: bytes(r["bits"]) for r in where.groupBy("part").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).collect()}


class _Known:
    """Whether the bitmap has a word, remembered for the words seen last."""

    def __init__(self, bits: dict[int, bytes]):
        self.bits, self.seen = bits, {}

    def __call__(self, lang: bytes, word: bytes) -> bool:
        key = lang, word
        if (found := self.seen.get(key)) is None:
            if len(self.seen) > HELD:
                self.seen.clear()
            part, at = divmod(_bit(lang, word), _MAP)
            found = self.seen[key] = part in self.bits and bool(self.bits[part][at >> 3] >> (at & 7) & 1)
        return found


class _Words(dict):
    """Numbers of a language's words from 1; 0 is the end of a piece. For each number: may it count, is it very common, its hash."""

    def __init__(self, lang: bytes, may: _Known, common: _Known):
        super().__init__({b"\0": 0})
        self.lang, self.may, self.common = lang, may, common
        self.words, self.flags = [b"\0"], [(False, False, 0)]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.flags.append((self.may(self.lang, word), self.common(self.lang, word), zlib.crc32(word, zlib.crc32(self.lang))))
        return n


def distinct(rows: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows in lexicographic order, each once, with the sums of n (or their number)."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))) if len(rows) else np.empty(0, int)
    counts = np.add.reduceat(n[order], first) if n is not None and len(rows) else np.diff(np.append(first, len(rows)))
    return rows[first], counts


def suffix_rows(stream: np.ndarray, starts: int, most: int) -> np.ndarray:
    """The suffixes of two words or more that begin at the first ``starts`` places, as numbers of words, 0 after the end."""
    padded = np.concatenate((stream, np.zeros(most, stream.dtype)))
    rows = np.empty((starts, most), stream.dtype)
    rows[:, 0] = stream[:starts]
    for k in range(1, most):
        np.multiply(padded[k : k + starts], rows[:, k - 1] != 0, out=rows[:, k])
    return rows[rows[:, 1] != 0]


def dealt(rows: np.ndarray, common: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each suffix, by its words up to the first that isn't very common."""
    key, goes_on = hashes[rows[:, 0]], common[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        goes_on = goes_on & (rows[:, k] != 0)
        key = np.where(goes_on, (key * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[rows[:, k]], key)
        goes_on = goes_on & common[rows[:, k]]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((key ^ (key >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)


def _narrow(a: np.ndarray) -> bytes:
    """A byte for the size of the numbers, then the numbers, column by column; packed."""
    kind = np.min_scalar_type(int(a.max(initial=0)))
    return _packed(bytes((kind.itemsize,)) + a.astype(kind).tobytes("F"))


def _wide(data: bytes, columns: int) -> np.ndarray:
    data = _unpacked(data)
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32).reshape(columns, -1).T


_BLOCK = "bucket int, lang string, words binary, suffixes binary, n binary"


def suffixes(docs: DataFrame, frequent: dict[int, bytes], common: dict[int, bytes], most: int, buckets: int) -> DataFrame:
    """``bucket, lang, words, suffixes, n``: what a task has for a bucket in a language, counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, is_common = _Known(frequent), _Known(common)
        known: dict[bytes, _Words] = {}
        streams: dict[bytes, list[np.ndarray]] = {}
        held = 0

        def flushed(open_lang: bytes | None = None) -> Iterator[pa.RecordBatch]:
            """Blocks of all suffixes held; of an open text, the last words stay for the suffixes that they end."""
            nonlocal held
            for lang, parts in streams.items():
                stream = np.concatenate(parts)
                starts = max(0, len(stream) - most + 1) if lang == open_lang else len(stream)
                words = known[lang]
                allowed, very, hashes = (np.array(c) for c in zip(*words.flags, strict=True))
                rows, n = distinct(suffix_rows(np.where(allowed[stream], stream, 0), starts, most))
                parts[:] = [stream[starts:]]
                bucket = dealt(rows, very, hashes.astype(np.uint64), buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.diff(bucket[order])) + 1
                blocks = []
                seen, place, rank = np.zeros(len(words.words), bool), np.zeros(len(words.words), np.int32), np.empty(len(words.words), np.int32)
                rank[sorted(range(len(rank)), key=words.words.__getitem__)] = np.arange(len(rank))
                for own in np.split(order, ends) if len(order) else ():
                    mine = rows[own]
                    seen[:] = False
                    seen[mine] = True
                    seen[0] = False
                    used = np.flatnonzero(seen)
                    # Numbers of the words in their own order, so that like words lie side by side; 0 stays the end.
                    used = used[np.argsort(rank[used])]
                    place[used] = np.arange(1, len(used) + 1)
                    numbers = place[mine]
                    blocks.append((int(bucket[own[0]]), lang.decode(), _packed(b"\0".join([words.words[k] for k in used.tolist()])), _narrow(numbers), _narrow(n[own])))
                if blocks:
                    kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)], names=["bucket", "lang", "words", "suffixes", "n"])
            held = 0
            for lang in [x for x in streams if x != open_lang]:
                del streams[lang]
            if sum(map(len, known.values())) > NUMBERED:
                for lang in [x for x in known if x != open_lang]:
                    del known[lang]

        for lang, text in _texts(batches):
            for part in _parts(_lower(text)):
                words = known.get(lang) or known.setdefault(lang, _Words(lang, may, is_common))
                found = tokens(part)
                streams.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held > SUFFIXES:
                    yield from flushed(lang)
            streams[lang].append(np.zeros(1, np.int32))
        yield from flushed()

    return docs.select("lang", "text").mapInArrow(work, _BLOCK)


def stack_counts(rows: np.ndarray, n: np.ndarray, end: int, least: int, common: np.ndarray) -> list[tuple[int, int, int]]:
    """(row that has it, number of words, count) of the prefixes of two words or more of sorted suffixes, with one stack.

    ``end`` stands after a suffix's last word.
    ``common`` has each row's number of very common words at its beginning: prefixes of these only are given whatever their count.
    """
    lengths = (rows != end).sum(axis=1)
    same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    same = np.minimum(np.minimum(same, lengths[1:]), lengths[:-1]) if len(rows) else same
    out: list[tuple[int, int, int]] = []
    counts: list[int] = []
    for k, (length, total, after) in enumerate(zip(lengths.tolist(), n.tolist(), [*same.tolist(), 0], strict=True)):
        counts += [0] * (length - len(counts))
        counts[-1] += total
        # What the next suffix doesn't share is complete.
        while len(counts) > after:
            m, c = len(counts), counts.pop()
            if m > 1 and (c >= least or common[k] >= m):
                out.append((k, m, c))
            if counts:
                counts[-1] += c
    return out


def prefix_counts(blocks: DataFrame, least: int, common: dict[int, bytes], most: int) -> DataFrame:
    """``lang, phrase, m, a``: prefixes of two words or more of each bucket's suffixes, with the number of words.

    Those under ``least`` are left out unless other buckets can have the same prefix. Blocks must come bucket by bucket.
    """

    def counted(lang: str, blocks: list[tuple[bytes, bytes, bytes]], is_common: _Known) -> pa.RecordBatch:
        lists = [_unpacked(b[0]).split(b"\0") for b in blocks]
        # In reverse order, with the end after all words.
        words = sorted({w for x in lists for w in x}, reverse=True)
        number = {w: k for k, w in enumerate(words)}
        rows = np.concatenate([np.array([len(words), *(number[w] for w in x)], np.int32)[_wide(b[1], most)] for x, b in zip(lists, blocks, strict=True)])
        rows, n = distinct(rows, np.concatenate([_wide(b[2], 1)[:, 0] for b in blocks]).astype(np.int64))
        very = np.array([*(is_common(lang.encode(), w) for w in words), False])
        found = stack_counts(rows, n, len(words), least, np.cumprod(very[rows], axis=1).sum(axis=1))
        names = [_plain(w) for w in words]
        phrase = [b" ".join([names[w] for w in rows[k, :m].tolist()]) for k, m, _ in found]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(phrase, pa.binary()), pa.array([m for _, m, _ in found], pa.int32()), pa.array([c for _, _, c in found], pa.int64())], names=["lang", "phrase", "m", "a"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_common = _Known(common)
        now, held = None, []
        for batch in batches:
            for bucket, lang, *block in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (bucket, lang) != now:
                    if held:
                        yield counted(now[1], held, is_common)
                    now, held = (bucket, lang), []
                held.append(tuple(block))
        if held:
            yield counted(now[1], held, is_common)

    parts = blocks.select(*(c.split()[0] for c in _BLOCK.split(", "))).mapInArrow(work, "lang string, phrase binary, m int, a long")
    return parts.select("lang", F.decode("phrase", "UTF-8").alias("phrase"), "m", "a")


def _small(written: DataFrame) -> DataFrame:
    """A written table of phrases, broadcast if it has few rows and bytes; else the join is shuffled, skew split by Spark."""
    n, size = written.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    return F.broadcast(written) if n <= MOST_BROADCAST and size <= MOST_BYTES else written


def frequent_phrases(docs: DataFrame, least: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, m, a`` of all phrases of one to ``most`` words that occur ``least`` times, ``lang, n`` of all words)."""
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    words = cut(word_counts(named))
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = words.agg(F.sum("a")).first()[0] or 0
    buckets = max(tasks, -(-total // BUCKET))
    common = bitmap(words, max(1, int(SHARE * total / buckets)))
    blocks = suffixes(named, bitmap(words, least), common, most, buckets).repartition(tasks, "bucket").sortWithinPartitions("bucket", "lang")
    longer = prefix_counts(blocks, least, common, most).groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")).where(F.col("a") >= least)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_plain(w) for w in batch.column(1).to_pylist()], pa.binary()), batch.column(2)], names=["lang", "phrase", "a"])

    single = words.where(F.col("a") >= least).select("lang", "word", "a").mapInArrow(plain, "lang string, phrase binary, a long")
    single = single.select("lang", F.decode("phrase", "UTF-8").alias("phrase"), F.lit(1).alias("m"), "a")
    return cut(single.unionByName(longer)), cut(totals)


def phrases(docs: DataFrame, least: int = 100, most: int = 5) -> DataFrame:
    """``lang, phrase, m, a, l, r, n, k, score, inside`` of all candidates.

    A candidate is cut after its first ``k`` words into parts that occur ``l`` and ``r`` times; of all cuts, the one of
    least floor(1000 a n / (l r)), then least ``k``, counts. ``inside``: a longer candidate has it and occurs as often.
    """
    found, totals = frequent_phrases(docs, least, most)
    several = found.where("m > 1")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    part = _small(found.select("lang", "phrase", "a"))
    of = lambda side, n: part.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    # One row for each language: a broadcast of a few rows, unless there are very many languages.
    total = F.broadcast(totals) if totals.count() <= 10_000 else totals
    joined = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(total, "lang")
    wide = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    scored = joined.withColumns({"over": (wide("a", 15) * 1000).cast("decimal(18,0)") * wide("n", 19), "under": wide("l", 18) * wide("r", 19)}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(*(F.first(c).alias(c) for c in ("m", "a", "n")), F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "m", "a", "n", "b.*")
    # A phrase that stands inside a longer one as often does so inside one that is longer by a word.
    within = several.where("m > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase")).distinct()
    return best.join(within.withColumn("inside", F.lit(True)), ["lang", "phrase", "a"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def collocations(docs: DataFrame, least: int = 100, most: int = 5, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases by score, count and phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(docs, least, most).where("not inside").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB's SQL for :func:`collocations`: every phrase of every piece, counted.
ORACLE_SQL = r"""
with d as (select row_number() over () r, coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d)),
s as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
g as (select lang, m::int m, ws[i:i + m - 1] p from s, (select unnest(range(1, 6)) m) where i + m - 1 <= len(ws)),
total as (select lang, count(*) n from g where m = 1 group by 1),
f as materialized (select lang, m, p, count(*) a from g group by 1, 2, 3 having count(*) >= 100),
cuts as (select f.*, unnest(range(1, m)) k from f where m > 1),
parts as (select c.lang, c.m, c.p, c.a, c.k, x.a l, y.a r, n, ((1000::hugeint * c.a * n) // (x.a::hugeint * y.a))::bigint score
  from cuts c join f x on x.lang = c.lang and x.p = c.p[1:c.k] join f y on y.lang = c.lang and y.p = c.p[c.k + 1:] join total t on t.lang = c.lang),
best as (select * from parts qualify row_number() over (partition by lang, p order by score, k) = 1),
longer as (select lang, a, p[i:i + len - 1] p from (select lang, a, p, m, unnest(range(2, m)) len from f where m > 2), lateral (select unnest(range(1, m - len + 2)) i)),
left_over as (select * from best b where not exists (select 1 from longer o where o.lang = b.lang and o.p = b.p and 100 * o.a >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) "rank", array_to_string(p, ' ') phrase, a, l, r, n, score from left_over
qualify "rank" <= 2000
"""
