"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their score.

Base kinds (email, ip, card, phone) are proposed leftmost and without overlap within their kind and stand as soon as their check
holds: at most 255 in each part of an ip, Luhn for a card, 8 to 15 digits for a phone. Further kinds need a score: what
the expression and the checksum (mod-97 for an iban) give, more if a context word stands near.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, release, spread

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "secret")
KINDS = BASE + EXTRA
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of an IBAN by country, from the registry of ISO 13616.
_IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,64}(?![A-Za-z0-9])")
_CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|sozial|sécurité|seguridad)"),
    "secret": re.compile(r"(?i)(?:token|secret|passw|api.?key|key\b|bearer)"),
}
#: What an expression with its check gives, and what a context word within NEAR characters before or behind it adds.
_PRIOR = {"iban": 0.7, "ssn": 0.3, "secret": 0.2}
_BOOST, NEAR, THRESHOLD = 0.4, 40, 0.5
_SOME = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: country and check digits moved behind, letters as numbers from 10; the rest is 1."""
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """What the expression proposes may run on into the next words. The end is that of the country's length, else the whole, else (for
    countries outside the registry) the farthest end of a word, whichever has the checksum; the search resumes behind it, or one character on."""
    m = _IBAN.search(text)
    while m:
        found, done = m.group(), m.start() + 1
        ends = [len(found), *(k for k in range(len(found) - 1, 0, -1) if found[k] == " ")]
        length = _IBAN_LENGTH.get(found[:2])
        if length:
            ends = [k for k in ends if k - found.count(" ", 0, k) == length] + ends[:1]
        for k in ends:
            if mod97(found[:k]):
                done = m.start() + k
                yield m.start(), done
                break
        m = _IBAN.search(text, done)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @; the earliest @ with a local part before and a domain behind it starts the leftmost match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, by kind and then by start; offsets in code points, end exclusive."""
    if not text or not _SOME.search(text):
        return []
    out = [("email", a, b, 1.0) for a, b in emails(text)]
    out += [("ip", m.start(), m.end(), 1.0) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end(), 1.0))
    for kind, spans in (("iban", ibans(text)), ("ssn", map(re.Match.span, _SSN.finditer(text))), ("secret", map(re.Match.span, _SECRET.finditer(text)))):
        for a, b in spans:
            if kind == "secret" and (text[a:b].isdigit() or not any(c.isdigit() for c in text[a:b])):
                continue
            near = _CONTEXT[kind].search(text, max(0, a - NEAR), a) or _CONTEXT[kind].search(text, b, b + NEAR)
            score = _PRIOR[kind] + _BOOST * bool(near)
            if score >= THRESHOLD:
                out.append((kind, a, b, round(score, 3)))
    return out


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """Each span becomes <KIND>; of overlapping spans, the earliest and then the longest names the place, which spans their union."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:
            end = max(end, b)
            continue
        out += [text[at if end < 0 else end : a], f"<{kind.upper()}>"]
        end = b
    return "".join([*out, text[end:]])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score; by kind and start) of every row's whole text.

    Null and empty texts have no spans. Repeated rows give repeated rows; a null doc_id is carried along. An empty table gives an empty
    frame. Other columns are left out, whatever their names. Time is linear in the text, also for very long runs of digits or of address characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(frugal(run), f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with spans of personal data in the text replaced by their kind and the length column renewed.

    Null texts stay null and empty ones empty; a null length stays null. Very long texts take linear time. Repeated rows stay repeated,
    an empty table gives an empty frame, and no column is added, so names can't clash.
    """

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = pa.array((redact(t, find(t)) for t in (x.as_py() for x in texts)), pa.string())
        release()
        return out

    out = spread(docs).withColumn(text, clean(F.col(text)))
    if length in docs.columns:
        out = out.select(*(F.when(F.col(length).isNotNull(), F.char_length(text)).cast(out.schema[length].dataType).alias(length) if c == length else F.col(f"`{c}`") for c in docs.columns))
    return out
