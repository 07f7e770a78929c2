"""Personal data: base identifiers, and disguised ones found on a normalised text and mapped back to the source.

Four patterns give the base spans. For disguises a transducer rewrites the text while it keeps, for each
character written, the range of source characters it stands for: look-alike letters and full-width forms
become ASCII, invisible characters vanish, runs of spelled digits become digits, and "at" and "dot" in
brackets (or bare, between host-like words or digits) become ``@`` and ``.``. The same patterns then run over
the rewritten text, and what they find is mapped back. A span that touches a base span adds nothing.
Spans are code points of the source, end exclusive.

Defined results: a null text counts as empty (and stays null when redacted); an empty text has no spans and the
digest of the empty string; repeated rows and rows with a null id are scanned like any other; further columns are
ignored by the scan and kept by the redaction. Spans that start together are listed by kind; texts of any length are scanned whole, in
about linear time. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.llm.common import Covered, filled, matching, steps

KINDS = ("email", "ip", "card", "phone")

# The base patterns. No look-behind changes a match: a run of digits starts at its first digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

ANY_BASE = r"@|\+[0-9][\x20().0-9-]|[0-9]\.[0-9]|[0-9]([\x20-]?[0-9]){12}"

# Letters of other scripts that look like ASCII letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
# Digits as words in the languages of the corpus.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3",
    "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "un": "1",
    "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
AT, DOT = "at|arroba|chez", "dot|punkt|punto|point"
# Blanks and hyphens that are none in ASCII, between digits.
BLANKS, HYPHENS = "\u00a0\u2007\u2009\u202f", "\u2010\u2011\u2012\u2013\u2212"
WORD_DIGITS = "|".join(sorted(SPELLED, key=len, reverse=True))
ONE = {ord(a): b for a, b in LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
SINGLE = "".join(map(chr, ONE)) + INVISIBLE
# Look-alikes are told by case: without it a dotless i would stand for every i.
RULES = re.compile(
    rf"(?P<single>(?-i:[{SINGLE}]))"
    rf"|(?P<at>\s{{0,3}}[\[({{<]\s{{0,3}}(?:{AT}|@)\s{{0,3}}[\])}}>]\s{{0,3}})"
    rf"|(?P<dot>\s{{0,3}}[\[({{<]\s{{0,3}}(?:{DOT}|\.)\s{{0,3}}[\])}}>]\s{{0,3}})"
    rf"|(?P<quad>(?<![^\W_])(?:(?:{WORD_DIGITS})[\x20-]){{0,2}}(?:{WORD_DIGITS})"
    rf"(?:\x20(?:{DOT})\x20(?:(?:{WORD_DIGITS})[\x20-]){{0,2}}(?:{WORD_DIGITS})){{3}}(?![^\W_]))"
    rf"|(?P<bare_at>(?<=[A-Za-z0-9])[\x20]{{1,3}}(?:{AT})[\x20]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:[\x20]{{1,3}}(?:{DOT})[\x20]{{1,3}}|\s?[\[({{<]\s?(?:{DOT})|\.)[A-Za-z0-9-]))"
    rf"|(?P<bare_dot>(?<=[A-Za-z0-9])[\x20]{{1,3}}(?:{DOT})[\x20]{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<ref>&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);)"
    rf"|(?P<stop>(?<=[A-Za-z0-9])[\u3002\uff61](?=[A-Za-z0-9]))"
    rf"|(?P<gap>(?<=[0-9])[{HYPHENS}{BLANKS}](?=[0-9]))"
    rf"|(?P<spelled>(?<![^\W_])(?:plus[\x20-])?(?:(?:{WORD_DIGITS})[\x20-]){{3,}}(?:{WORD_DIGITS})(?![^\W_]))",
    re.IGNORECASE,
)
SPELLED_PART = re.compile(rf"plus|{DOT}|{WORD_DIGITS}", re.IGNORECASE)
DOTS = frozenset(DOT.split("|"))

AT_REF = re.compile("64|40|commat", re.IGNORECASE)

# White space, letters and words as RULES takes them: the scans fold no dotted capital I and know ASCII white space only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ALNUM = r"[a-z0-9\x{130}]"
HOST = r"[a-z0-9\x{130}-]"
SCAN_DOT, SCAN_DIGITS = (words.replace("i", r"[i\x{130}]") for words in (DOT, WORD_DIGITS))

# Linear scans that say whether a rule can apply at all: each branch of RULES without its look-behinds.
ANY_DISGUISE = (
    rf"[{SINGLE}]|(?i:[\[({{<]{SPACE}{{0,3}}(?:{AT}|{SCAN_DOT}|@|\.){SPACE}{{0,3}}[\])}}>])"
    rf"|(?i:{ALNUM}\x20{{1,3}}(?:{AT})\x20{{1,3}}{HOST}+"
    rf"(?:\x20{{1,3}}(?:{SCAN_DOT})\x20{{1,3}}|{SPACE}?[\[({{<]{SPACE}?(?:{SCAN_DOT})|\.){HOST})"
    rf"|(?i:{ALNUM}\x20{{1,3}}(?:{SCAN_DOT})\x20{{1,3}}{ALNUM})"
    rf"|(?i:(?:(?:{SCAN_DIGITS})[\x20-]){{3}}(?:{SCAN_DIGITS}))"
    rf"|(?i:&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);)|[A-Za-z0-9][\x{{3002}}\x{{ff61}}][A-Za-z0-9]|[0-9][{HYPHENS}{BLANKS}][0-9]"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards in linear time."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of all four kinds; failing matches are dropped."""
    found = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def rewrite(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The normalised text, and for each of its characters the source range ``[start, end)`` it was made from."""
    out: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []

    def plain(a: int, b: int) -> None:
        if a < b:
            out.append(text[a:b])
            starts.append(np.arange(a, b))
            ends.append(np.arange(a + 1, b + 1))

    def made(s: str, a: int, b: int) -> None:
        if s:
            out.append(s)
            starts.append(np.array([a]))
            ends.append(np.array([b]))

    done = 0
    for m in RULES.finditer(text):
        plain(done, m.start())
        done = m.end()
        if m.lastgroup == "single":
            made(ONE.get(ord(m[0]), ""), m.start(), m.end())
        elif m.lastgroup in ("at", "bare_at"):
            made("@", m.start(), m.end())
        elif m.lastgroup in ("dot", "bare_dot"):
            made(".", m.start(), m.end())
        elif m.lastgroup == "stop":
            made(".", m.start(), m.end())
        elif m.lastgroup == "ref":
            made("@" if AT_REF.search(m[0]) else ".", m.start(), m.end())
        elif m.lastgroup == "gap":
            made(" " if m[0] in BLANKS else "-", m.start(), m.end())
        else:
            for p in SPELLED_PART.finditer(text, m.start(), m.end()):
                word = p[0].lower()
                made("." if word in DOTS else SPELLED.get(word, "+"), p.start(), p.end())
    plain(done, len(text))
    if not out:
        return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifiers of the rewritten text as source spans. Each rewriting may let another rule apply, so look-alikes go first."""
    once, s1, e1 = rewrite(text)
    twice, s2, e2 = rewrite(once)
    if twice == text:
        return []
    found, covered = [], Covered((s, e) for _, s, e in base)
    for kind, a, b in detect(twice):
        start, end = int(s1[s2[a]]), int(e1[e2[b - 1] - 1])
        if not covered.overlaps(start, end):
            found.append((kind, start, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _hits(texts: pa.Array) -> tuple[list[int], set[int]]:
    disguises = set(matching(texts, ANY_DISGUISE))
    return sorted({*matching(texts, ANY_BASE), *disguises}), disguises


def find_text(text: str, may_hide: bool) -> tuple[list, list]:
    base = sorted(detect(text))
    return base, sorted({*base, *disguised(text, base)}) if may_hide else base


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in; doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised out.

    The counts and the digest are those of the base spans.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = filled(batch.column("text"))
            n = len(texts)
            counts = np.zeros((5, n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            for a, b in steps(texts):
                part = texts.slice(a, b - a)
                hits, hidden = _hits(part)
                for i in hits:
                    base, every = find_text(part[i].as_py(), i in hidden)
                    for k, _, _ in base:
                        counts[k, a + i] += 1
                    counts[4, a + i] = len(every) - len(base)
                    digests[a + i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[a + i] = joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts[:4]), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(counts[4])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long",
    )


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans become one placeholder, named by the span that starts first."""
    out, done = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= done:
            out += text[done:start], f"[{KINDS[kind].upper()}]"
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with every span of ``column`` replaced by a placeholder; all rows and columns stay."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for a, b in steps(filled(texts)):
            part = filled(texts.slice(a, b - a))
            hits, hidden = _hits(part)
            for i in hits:
                text = part[i].as_py()
                # What is left can read as another identifier; go on until nothing is found.
                while spans := find_text(text, i in hidden)[1]:
                    text = redact_text(text, spans)
                out[a + i] = text if texts[a + i].is_valid else None
        return pa.array(out, pa.string())

    return docs.withColumn(column, redacted(column))
