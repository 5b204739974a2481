"""Personal data: regular expressions propose spans, checks confirm them, words nearby adjust the score.

Each kind has a pattern, a check (digit counts, Luhn, mod 97, ranges) and a score. The kinds email, ip, card and
phone are always reported where pattern and check hold; the others only if their score, raised by a context word in
the 40 characters before the span, reaches the threshold.

Null texts count as empty and have no spans. Repeated rows give repeated rows, other columns are passed on, and a
table without rows gives none. Every pattern is linear in the length of the text, whatever the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order for spans that start together.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "ssn", "national_phone", "card_number", "phone_number")
#: Kinds that look inside longer runs of digits, where a base kind's one match fails; left out where it holds.
INSIDE = {"card_number": "card", "phone_number": "phone"}
THRESHOLD = 0.5
CONTEXT = 40
SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Spans are coded as text on the way from Python.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_CARD_NUMBER = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])")
_PHONE_NUMBER = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORDS = {
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "key"),
    "ssn": ("ssn", "social security", "tax"),
    "national_phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: country and check digits moved behind, letters as 10 to 35, remainder 1."""
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping: from each ``@``, back over the local part's characters and on over the domain.

    A scan by the pattern itself would try every start in a long run of such characters, in quadratic time.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _spans(pattern: re.Pattern, check: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if check(m.group()))


def _is_card(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_secret(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(set(s)) >= 8


PROPOSE = {
    "email": emails,
    "ip": _spans(_IP, _is_ip),
    "card": _spans(_CARD, _is_card),
    "phone": _spans(_PHONE, lambda s: 10 <= len(_NOT_DIGIT.sub("", s)) <= 15),
    "iban": _spans(_IBAN, mod97),
    "secret": _spans(_SECRET, _is_secret),
    "ssn": _spans(_SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"),
    "national_phone": _spans(_NATIONAL, lambda s: True),
    "card_number": _spans(_CARD_NUMBER, lambda s: s[0] in "23456" and luhn(_NOT_DIGIT.sub("", s))),
    "phone_number": _spans(_PHONE_NUMBER, lambda s: True),
}
#: Scores without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.9), "iban": (0.8, 1.0), "secret": (0.3, 0.8), "ssn": (0.3, 0.8), "national_phone": (0.3, 0.7), "card_number": (0.7, 0.9), "phone_number": (0.6, 0.9)}


def _touches(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    """Whether a span overlaps one of sorted spans that don't overlap each other."""
    k = bisect_left(spans, (span[1],))
    return k > 0 and spans[k - 1][1] > span[0]


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and kind, in code points."""
    if not text:
        return []
    found = []
    taken: dict[str, list[tuple[int, int]]] = {}
    for order, kind in enumerate(KINDS):
        spans = list(PROPOSE[kind](text))
        taken[kind] = spans
        if (base := INSIDE.get(kind)) and spans:
            spans = [x for x in spans if not _touches(x, taken[base])]
        for start, end in spans:
            near = text[max(0, start - CONTEXT) : start].lower()
            score = SCORES[kind][any(w in near for w in _WORDS.get(kind, ()))]
            if kind in BASE_KINDS or score >= threshold:
                found.append((start, order, end, score))
    return [(KINDS[k], a, b, s) for a, k, b, s in sorted(found)]


def _coded(threshold: float):
    @F.pandas_udf("array<string>")
    def coded(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{k}:{a}:{b}:{s}" for k, a, b, s in find(t, threshold)] for t in texts], dtype=object)

    return coded


def span_column(text: Column, threshold: float = THRESHOLD) -> Column:
    """The spans of a text, an array of ``SPAN``."""
    part = lambda s, k: F.get(F.split(s, ":"), F.lit(k))
    return F.transform(
        _coded(threshold)(text),
        lambda s: F.struct(part(s, 0).alias("kind"), part(s, 1).cast("int").alias("start"), part(s, 2).cast("int").alias("end"), part(s, 3).cast("double").alias("score")),
    )


def detect(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``pii_spans``, an array of ``SPAN`` by start and kind."""
    return docs.withColumn("pii_spans", span_column(F.col(f"`{text}`"), threshold))


def redact_text(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span, spans that overlap as one, replaced by its first kind in angle brackets."""
    if not text:
        return text
    out, at = [], 0
    reach, kind = -1, ""
    begun = 0
    for k, a, b, _ in find(text, threshold):
        if a < reach:
            reach = max(reach, b)
            continue
        if reach >= 0:
            out += [text[at:begun], f"<{kind.upper()}>"]
            at = reach
        begun, reach, kind = a, b, k
    if reach >= 0:
        out += [text[at:begun], f"<{kind.upper()}>"]
        at = reach
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, threshold) for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for each document."""
    spans = F.col("pii_spans")
    coded = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    number = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS)), coded), ",")
    return detect(docs.select("doc_id", "text")).select(
        "doc_id", *(number(k) for k in BASE_KINDS), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(spans, coded), ",").alias("spans")
    )
