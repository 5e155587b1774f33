r"""Secret scans: named assignments, access keys and hexadecimal strings, and what else looks drawn at random.

The first three are patterns. The rest is found by entropy: a candidate is a longest run of the characters of base64;
the narrowest class that holds all of its characters (decimal, hexadecimal, capitals and digits, letters and digits,
base64) sets the length of a window and the entropy it must have. The window slides over the candidate; the sum of
c * log2(c) over the counts c of its characters changes by two terms a step, kept in whole units of 2 ** -32, so that
places don't depend on what came before them. Windows that reach the entropy and hold both letters and digits are
joined where they overlap. Candidates on the allow-list are passed over: decimal numbers, UUIDs, digests named as such,
parts of web addresses, counted-up alphabets and placeholders, and whatever ``allow`` adds. So are spans that one of a
pattern meets.

A built-in pattern first tells which texts can hold anything; only those go to Python, and a text is scanned in linear time.

Defined results: null and empty texts have no spans; rows are independent, so repeated ids, null ids and other columns
do not matter; empty tables give empty results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: In the order of spans that start together.
KINDS = ("assign", "access", "hex", "entropy")
_NAMED = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ASSIGN = re.compile(rf"{_NAMED}\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
CANDIDATE = re.compile("[A-Za-z0-9+/_-]{16,}")
#: What the text of any span holds, for the built-in pattern.
HINT = rf"(?i:{_NAMED})|AKIA[A-Z0-9]{{16}}|[A-Za-z0-9+/_-]{{16}}"

#: (class, characters, window, bits): a window of characters drawn at random has about 3.2, 3.8, 4.0 and 4.2 bits,
#: words of a language of these lengths about 2.8, 3.3, 3.3 and 3.5.
CLASSES = (
    ("hexadecimal", re.compile("[0-9a-f]+|[0-9A-F]+"), 16, 3.0),
    ("capitals", re.compile("[0-9A-Z]+"), 20, 3.5),
    ("letters", re.compile("[0-9A-Za-z]+"), 20, 3.75),
    ("base64", re.compile("[0-9A-Za-z+/_-]+"), 24, 4.0),
)
#: Whole candidates that are no secrets.
ALLOWED = (
    re.compile(r"[\d_/+-]+"),
    re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r".*(?:example|sample|placeholder|dummy|change_?me|your_?|0123456789|abcdefghij|qwertyuiop).*", re.IGNORECASE),
)
#: What may stand before a candidate that is no secret; and, with its first two characters, an address.
DIGEST = re.compile(r"\b(?:md5|sha-?1|sha-?256|sha-?384|sha-?512)[\"']?\x20?[:=-]\x20?$", re.IGNORECASE)
ADDRESS = re.compile(r"://[^\s\"'<>]*$")
#: Characters before a candidate that are looked at for that.
BEFORE = 256

_UNIT = 1 << 32
_terms = [0, 0]


def _term(c: int) -> int:
    while len(_terms) <= c:
        _terms.append(round(len(_terms) * math.log2(len(_terms)) * _UNIT))
    return _terms[c]


def random_windows(text: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined windows of ``text`` that have both letters and digits and at least so many bits a character."""
    if len(text) < window:
        return
    most = (math.log2(window) - bits) * window * _UNIT  # the sum of c * log2(c) that is left
    counts = Counter(text[:window])
    total, digits = sum(map(_term, counts.values())), sum(x.isdigit() for x in text[:window])
    first = last = -1
    for at in range(len(text) - window + 1):
        if at:
            gone, come = text[at - 1], text[at + window - 1]
            if gone != come:
                a, b = counts[gone], counts[come]
                total += _term(a - 1) - _term(a) + _term(b + 1) - _term(b)
                counts[gone], counts[come] = a - 1, b + 1
                digits += come.isdigit() - gone.isdigit()
        if total <= most and digits and any(many and x.isalpha() for x, many in counts.items()):
            if first >= 0 and at > last:
                yield first, last
                first = -1
            first, last = at if first < 0 else first, at + window
    if first >= 0:
        yield first, last


def secret_spans(text: str, allow: tuple[re.Pattern, ...] = ()) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every span, in that order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    named, k, reach = sorted(found), 0, 0
    for m in CANDIDATE.finditer(text):
        own = m[0]
        window, bits = next((window, bits) for _, kind, window, bits in CLASSES if kind.fullmatch(own))
        before = text[max(0, m.start() - BEFORE) : m.start()]
        if len(own) < window or any(x.fullmatch(own) for x in (*ALLOWED, *allow)) or DIGEST.search(before) or ADDRESS.search(before + own[:2]):
            continue
        for a, b in random_windows(own, window, bits):
            a, b = a + m.start(), b + m.start()
            while k < len(named) and named[k][0] < b:
                reach = max(reach, named[k][2])
                k += 1
            if reach <= a:
                found.append((a, 3, b))
    return sorted(found)


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and spans (start, kind, end) of each row, by start, then kind, which is a place in ``KINDS``. ``allow`` are
    patterns of whole candidates that are no secrets."""
    kind = ArrayType(StructType([StructField("start", LongType()), StructField("kind", IntegerType()), StructField("end", LongType())]))

    @F.arrow_udf(kind)
    def scanned(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tuple(map(re.compile, allow))
        names = ["start", "kind", "end"]
        for column in columns:
            spans = [[dict(zip(names, span)) for span in secret_spans(text.as_py(), own)] if text.is_valid else [] for text in column]
            yield pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])))

    return docs.select("doc_id", scanned(F.when(F.col("text").rlike(HINT), F.col("text"))).alias("spans"))
