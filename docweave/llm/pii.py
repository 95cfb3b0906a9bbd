"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns and keep every match
that passes its check. The method adds kinds (iban by mod-97, ssn by its number
rules) which stay only if their score, raised or lowered by words nearby,
reaches ``THRESHOLD``. Offsets count code points, ends are exclusive.

Defined results: null text is empty and has no spans; very long texts are searched
whole, in time linear in their length; spans of equal start are ordered as the
kinds are listed; rows that repeat a document each have its result; an empty
table gives no row; other columns, whatever their names, are ignored, and
``redact_documents`` hands them on. Ids are whole numbers; others raise Spark's
cast error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import each_batch, rows_out

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
ORDER = {kind: k for k, kind in enumerate(KINDS)}
THRESHOLD = 0.6
#: Context is looked for in so many characters before and after a span.
NEAR = 40

#: Fixed patterns. The look-behinds and possessive runs only skip starts that cannot match otherwise.
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_LEAST = 15
#: Registered lengths of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    c: int(entry[:2])
    for entry in (
        "15 NO", "16 BE", "18 DK FI FK FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV", "22 BG BH CR DE GB GE IE ME RS VA",
        "23 AE GI IL IQ OM SO TL", "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST", "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HU LB NI PL SV",
        "29 BR EG PS QA UA", "30 JO KW MU YE", "31 MT SC", "32 LC", "33 RU",
    )
    for c in entry[3:].split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words nearby that make a kind likelier, and words that make any kind less so.
SUPPORT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reply)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|payment|pay)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|transfer)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|tax)\b", re.I),
}
DOUBT = re.compile(r"\b(?:example|sample|test|version|isbn|order|part|serial)\b", re.I)
#: Score of a confirmed span before its context counts.
CONFIRMED = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.5}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: moved to the end, letters as numbers, the remainder by 97 is 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each at sign: the local part is the run before it, so a failing domain fails for the whole run."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and EMAIL_LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def iban_ends(text: str, lo: int, hi: int) -> list[int]:
    """Where a candidate may end: the country's length and then the whole, or for other countries every token from the longest."""
    ends = [k for k in range(hi, lo, -1) if k == hi or text[k] == " "]
    length = {k: k - lo - text.count(" ", lo, k) for k in ends}
    known = IBAN_LENGTHS.get(text[lo : lo + 2])
    return sorted((k for k in ends if length[k] == known or k == hi), key=lambda k: length[k] != known) if known else [k for k in ends if length[k] >= IBAN_LEAST]


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A candidate takes in upper-case words and numbers that follow; where no end is confirmed, the next start may lie within it."""
    at = 0
    while m := IBAN.search(text, at):
        lo, at = m.start(), m.start() + 1
        for hi in iban_ends(text, *m.span()):
            if mod97(text[lo:hi].replace(" ", "")):
                yield lo, hi
                at = hi
                break


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, by kind and then by start."""
    for lo, hi in emails(text):
        yield "email", lo, hi
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    for lo, hi in ibans(text):
        yield "iban", lo, hi
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, lo: int, hi: int) -> float:
    before, after = text[max(0, lo - NEAR) : lo], text[hi : hi + NEAR]
    value = CONFIRMED[kind]
    if SUPPORT[kind].search(before) or SUPPORT[kind].search(after):
        value += 0.2
    if DOUBT.search(before) or DOUBT.search(after):
        value -= 0.2
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str) -> list[Span]:
    """All spans by start, then by kind as listed. Base kinds stay whatever their score."""
    spans = [Span(kind, lo, hi, score(text, kind, lo, hi)) for kind, lo, hi in proposals(text)]
    kept = [s for s in spans if s.kind in BASE_KINDS or s.score >= THRESHOLD]
    return sorted(kept, key=lambda s: (s.start, ORDER[s.kind], s.end))


def redacted(text: str, spans: list[Span]) -> str:
    """Each maximal run of overlapping spans becomes [KIND] of its first span."""
    out, done, k = [], 0, 0
    while k < len(spans):
        first, end = spans[k], spans[k].end
        while k < len(spans) and spans[k].start < end:
            end = max(end, spans[k].end)
            k += 1
        out += text[done : first.start], f"[{first.kind.upper()}]"
        done = end
    return "".join([*out, text[done:]])


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))), ("redacted", pa.string())]
)


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>>, and the redacted text where asked for. One narrow pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        spans = [find(t) if t else [] for t in texts]
        clean = [redacted(t, s) if redact and t else t if redact else None for t, s in zip(texts, spans, strict=True)]
        return rows_out({"doc_id": batch.column("doc_id"), "spans": [[s._asdict() for s in x] for x in spans], "redacted": clean}, FOUND)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        each_batch(run), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string"
    )


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts of base kinds, base_sha256 and spans by doc_id, with the mean score beside them."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    mean = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["score"]) / F.size("spans")
    return find_pii(docs).select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.when(F.size("spans") > 0, F.round(mean, 6)).alias("mean_score"),
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves with every span replaced in text; n_chars follows where there is one. Narrow: all columns ride along."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        clean = [redacted(t, find(t)) if t else t for t in texts]
        columns = list(batch.columns)
        columns[at] = pa.array(clean, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(each_batch(run), schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out
