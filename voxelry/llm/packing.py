"""Harmonic packing of tokenized documents into sequences.

Whole sequences are cut off a document first. Its rest falls into a reciprocal-capacity class: class k holds rests
longer than 1 / (k + 1) and at most 1 / k of the capacity, and each of its bins takes exactly k of them; rests of at
most 1 / ``CLASSES`` of the capacity share one class, whose bins take rests until the next does not fit. What a bin
leaves over is filled with tokens cut from one further rest, the worker's filler, so that every full bin is full to the
last token, and only fillers are cut. Each worker fills the bins of its own rows, without looking at those of others.
What is left in a worker's open bins at its end is laid end to end and cut into whole sequences and one of each power of
two that the last tokens need, so that nothing is padded. A worker holds fewer than ``CLASSES`` * capacity open tokens
at any time, whatever the input.

Null texts count as empty and give the end token alone. Repeated rows are packed as often as they come, other columns
are ignored, a null id stays null, and a table without rows gives no sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END = 0
#: Classes 1 to this; the last takes all shorter rests.
CLASSES = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TOKENIZER = "byte_bpe_50k"
#: Code points whose classes (letter, number, space) the two libraries' regular expressions surely agree on; texts
#: with others go to the slower library.
_COMMON = ((0xA0, 0x58F), (0x2000, 0x22FF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_RARE = re.compile(r"[^\t\n\r\x20-\x7e" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _COMMON) + "]")
_LONG_RUN = re.compile(r"\s{1000}|\S{10000}")


def default_tokenizer_path(suffix: str = "json") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.{suffix}")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids of a text, those of ``tokenizers`` for the file ``path``.

    If the same vocabulary lies beside it as ranks, ``tiktoken`` gives the same ids in a quarter of the time; texts
    that it may split otherwise (rare code points, very long runs) and all texts without such a file go the plain way.
    """
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    plain = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4")

    ranks_path = re.sub(r"\.json$", ".tiktoken", path)
    if ranks_path == path or not os.path.exists(ranks_path):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    special = {t.content: i for i, t in plain.get_added_tokens_decoder().items()}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if _RARE.search(text) or _LONG_RUN.search(text):
            return slow(text)
        return quick.encode_to_numpy(text, allowed_special="all").astype("<u4")

    return encode


class Piece(NamedTuple):
    """A run of a document's ids."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:size]), self._replace(start=self.start + size, ids=self.ids[size:])


class Bins:
    """The open bins of one worker, by class; full ones leave at once, as rows of ``SCHEMA``."""

    def __init__(self, worker: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next_id, self.capacity, self.classes = worker << 33, capacity, classes
        self.open: dict[int, list[Piece]] = {}
        self.filler: Piece | None = None

    def _sealed(self, pieces: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, self.next_id, offset
            offset += len(p.ids)
        self.next_id += 1

    def add(self, document: Piece) -> Iterator[tuple]:
        """Whole sequences of a document, and the bins that its rest fills."""
        rest = document
        while len(rest.ids) >= self.capacity:
            whole, rest = rest.cut(self.capacity)
            yield from self._sealed([whole])
        if len(rest.ids):
            if self.filler is None:
                self.filler = rest
            else:
                yield from self._place(rest)

    def _place(self, rest: Piece) -> Iterator[tuple]:
        k = min(self.classes, self.capacity // len(rest.ids))
        waiting = self.open.setdefault(k, [])
        if k == self.classes and sum(len(p.ids) for p in waiting) + len(rest.ids) > self.capacity:
            yield from self._close(self.open.pop(k))
            waiting = self.open.setdefault(k, [])
        waiting.append(rest)
        if k < self.classes and len(waiting) == k:
            yield from self._close(self.open.pop(k))

    def _close(self, pieces: list[Piece]) -> Iterator[tuple]:
        """A bin with its class's rests, filled up from the filler, or from open bins where that is too short."""
        left = self.capacity - sum(len(p.ids) for p in pieces)
        while left:
            if self.filler is None:
                k = min((k for k in self.open if self.open[k]), default=None)
                if k is None:
                    break
                self.filler = self.open[k].pop()
            part, rest = self.filler.cut(left)
            self.filler = rest if len(rest.ids) else None
            pieces.append(part)
            left -= len(part.ids)
        if left:
            self.open[0] = pieces  # nothing is left to fill it with: it stays for the end
        else:
            yield from self._sealed(pieces)

    def rest(self) -> Iterator[tuple]:
        """All that is left, end to end."""
        line = [p for k in sorted(self.open) for p in self.open[k]] + ([self.filler] if self.filler else [])
        self.open, self.filler = {}, None
        total = sum(len(p.ids) for p in line)
        while total:
            size = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= size
            pieces = []
            while size:
                part, rest = line.pop(0).cut(size)
                if len(rest.ids):
                    line.insert(0, rest)
                pieces.append(part)
                size -= len(part.ids)
            yield from self._sealed(pieces)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """The pieces of all documents with their places: ``SCHEMA``. ``capacity`` is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    columns = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    schema = pa.schema([(c, pa.int64()) for c in columns])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path or default_tokenizer_path())
        bins = Bins(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.append(encode(text) if text else np.empty(0, "<u4"), np.array([END], "<u4")).astype("<u4")
                rows.extend(bins.add(Piece(doc_id.as_py(), 0, ids, len(ids))))
                if len(rows) > 20_000:
                    yield out()
                    rows = []
        rows.extend(bins.rest())
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)
