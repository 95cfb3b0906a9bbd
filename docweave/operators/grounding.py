"""Grounded markup: label and coordinate markers with the text between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import canonical_role
from docweave.functions.vectors import once

#: Fixed values.
REF = ("<|ref|>", "<|/ref|>")
DET = ("<|det|>", "<|/det|>")
MAX_BOXES, MAX_MARKERS, MAX_TEXT = 128, 10_000, 1_048_576
SCALE = 999
#: White space may stand around numbers and marks, never within a number.
GAP = r"[ \t\n\f\r]*"
NUMBER = rf"{GAP}[0-9]+{GAP}"
BOX = rf"{GAP}\[{NUMBER},{NUMBER},{NUMBER},{NUMBER}\]{GAP}"
ONE_OR_LIST = rf"^({BOX}|{GAP}\[{BOX}(,{BOX})*\]{GAP})$"
#: Up to the first closing mark, whatever stands between.
_REF_BODY, _DET_BODY = (rf"((?:(?!<\|/{k}\|>)[\s\S])*+)<\|/{k}\|>" for k in ("ref", "det"))
#: A ref and the det that follows it, a ref alone, a det alone, or a mark that never closes, with all the rest.
TOKEN = rf"<\|ref\|>{_REF_BODY}(?:<\|det\|>{_DET_BODY}|(?!<\|det\|>))|<\|det\|>{_DET_BODY}|<\|(?:ref|det)\|>[\s\S]*+"
LABELLED = r"^([^\[]*)(\[[\s\S]*)$"


def boxes(coordinates: Column) -> Column:
    """Boxes (l, t, r, b) of a coordinate list, or null: numbers up to 999, left of right, top above bottom, at most 128 (see ``over_limit``)."""

    def read(numbers: Column) -> Column:
        fine = F.forall(_quads(numbers, MAX_BOXES), lambda b: (b["r"] <= SCALE) & (b["b"] <= SCALE) & (b["l"] < b["r"]) & (b["t"] < b["b"]))
        return F.when((F.size(numbers) <= 4 * MAX_BOXES) & fine, _quads(numbers, MAX_BOXES))

    return F.when(coordinates.rlike(ONE_OR_LIST), once(_numbers(coordinates), read))


def _quads(numbers: Column, most: int) -> Column:
    """The first so many boxes of a list of numbers."""
    at = lambda k, j: F.get(numbers, k * 4 + j)
    count = F.least(F.floor(F.size(numbers) / 4).cast("int"), F.lit(most))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(at(k, 0).alias("l"), at(k, 1).alias("t"), at(k, 2).alias("r"), at(k, 3).alias("b")))


def _numbers(coordinates: Column) -> Column:
    """Without leading zeros; what is longer than nine digits is out of range in any case and stands as such."""
    return F.transform(F.regexp_extract_all(coordinates, F.lit(r"0*([0-9]+)"), F.lit(1)), lambda n: F.when(F.length(n) > 9, F.lit(10**9)).otherwise(n.cast("bigint")))


def over_limit(coordinates: Column) -> Column:
    """Whether a list in good form is an error, not just unusable: its first 128 boxes are right and there are more."""

    def read(numbers: Column) -> Column:
        fine = F.forall(_quads(numbers, MAX_BOXES + 1), lambda b: (b["r"] <= SCALE) & (b["b"] <= SCALE) & (b["l"] < b["r"]) & (b["t"] < b["b"]))
        return (F.size(numbers) > 4 * MAX_BOXES) & fine

    # A list this long has more than 8 characters a box; shorter ones need no second look.
    return F.coalesce((F.length(coordinates) > 9 * MAX_BOXES) & coordinates.rlike(ONE_OR_LIST) & once(_numbers(coordinates), read), F.lit(False))


def scaled(box: Column, width: Column, height: Column) -> Column:
    """Thousandths to pixels, rounded down; null if nothing is left."""
    s = lambda v, side: F.floor(v * side / SCALE).cast("bigint")
    w, h = s(box["r"], width) - s(box["l"], width), s(box["b"], height) - s(box["t"], height)
    return F.when((w > 0) & (h > 0), F.struct(s(box["l"], width).alias("x"), s(box["t"], height).alias("y"), w.alias("width"), h.alias("height")))


def scanned(markup: Column) -> Column:
    """The markup's marks: text (all that is no mark), markers (label, coordinates and the text up to the next marker) and malformed.

    A ref without a det goes, with the mark, and a mark that never closes stays in
    the text with all that follows it; both count as malformed. Labels and
    coordinates are null where they are missing.
    """
    whole = F.regexp_extract_all(markup, F.lit(TOKEN), F.lit(0))
    pieces = F.split(markup, TOKEN)
    group = lambda m, k: F.regexp_extract(m, rf"^(?:{TOKEN})$", k)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))

    def read(token: Column, k: Column) -> Column:
        m, unclosed = token["m"], token["open"]
        pair, direct = m.startswith(REF[0]) & m.endswith(DET[1]) & ~unclosed, m.startswith(DET[0]) & ~unclosed
        label = F.when(pair, group(m, 1)).when(direct, F.regexp_extract(group(m, 3), LABELLED, 1))
        where = F.when(pair, group(m, 2)).when(direct, F.regexp_extract(group(m, 3), LABELLED, 2))
        after = F.coalesce(F.get(pieces, k + 1), F.lit(""))
        return F.struct((pair | direct).alias("marker"), filled(label).alias("label"), filled(where).alias("coordinates"), F.concat(F.when(unclosed, m).otherwise(F.lit("")), after).alias("text"))

    empty = F.array().cast("array<struct<marker:boolean,label:string,coordinates:string,text:string>>")

    def gather(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["marker"].alias("marker"), last["label"].alias("label"), last["coordinates"].alias("coordinates"), F.concat(last["text"], t["text"]).alias("text"))
        return F.when(t["marker"], F.concat(acc, F.array(t))).when(F.size(acc) == 0, acc).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))

    def summed(tokens: Column) -> Column:
        found = F.aggregate(tokens, empty, gather)
        said = F.concat(F.coalesce(F.get(pieces, F.lit(0)), F.lit("")), F.array_join(F.transform(tokens, lambda t: t["text"]), ""))
        return F.struct(said.alias("text"), found.alias("markers"), F.exists(tokens, lambda t: ~t["marker"]).alias("malformed"))

    opened = F.transform(whole, lambda m: F.struct(m.alias("m"), _open(m).alias("open")))
    return once(F.transform(opened, read), summed)


def _open(m: Column) -> Column:
    """A mark that never closes: a ref's or a det's opening without its end."""
    ref = m.startswith(REF[0]) & (~m.contains(REF[1]) | (F.regexp_like(m, F.lit(rf"^<\|ref\|>{_REF_BODY}<\|det\|>")) & ~F.regexp_like(m, F.lit(rf"^<\|ref\|>{_REF_BODY}<\|det\|>{_DET_BODY}"))))
    return ref | (m.startswith(DET[0]) & ~m.contains(DET[1]))


def markers(markup: Column) -> Column:
    """Markers in order: label and coordinates (null where missing), with the text after each up to the next."""
    trimmed = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.transform(scanned(markup)["markers"], lambda m: F.struct(m["label"].alias("label"), m["coordinates"].alias("coordinates"), trimmed(m["text"]).alias("text")))


def blocks(markup: Column, width: Column, height: Column) -> Column:
    """Blocks with a label, text and geometry: role, text, the union box and its parts. Images are skipped."""
    parsed = F.transform(
        markers(markup),
        lambda m: F.struct(m["label"].alias("label"), canonical_role(m["label"]).alias("role"), m["text"].alias("text"), F.transform(boxes(m["coordinates"]), lambda b: scaled(b, width, height)).alias("parts")),
    )
    usable = lambda b: (F.lower(b["label"]) != "image") & (b["text"] != "") & (F.octet_length(b["text"]) <= MAX_TEXT) & b["parts"].isNotNull() & ~F.exists(b["parts"], lambda p: p.isNull())
    return F.filter(parsed, lambda b: F.coalesce(usable(b), F.lit(False)))


def warned(markup: Column, kept: Column) -> Column:
    """Whether anything in the markup was given up: no marker at all, a marker without a block, a ref without a det, or a mark that never closes."""
    return once(scanned(markup), lambda s: s["malformed"] | (F.size(s["markers"]) == 0) | (F.size(s["markers"]) > F.size(kept)))


def limit_error(markup: Column) -> Column:
    """Code of a markup that breaks a limit, which is an error and no warning: marks, or boxes of one marker."""
    marks = F.size(F.regexp_extract_all(markup, F.lit(r"<\|/(?:ref|det)\|>"), F.lit(0)))
    return once(scanned(markup)["markers"], lambda m: F.when((marks > 2 * MAX_MARKERS) | F.exists(m, lambda x: over_limit(x["coordinates"])), F.lit("grounding_limit")))


def prompt(tokens_before: Column, image_tokens: Column, tokens_after: Column, placeholder: int) -> Column:
    """Token ids with the image's placeholder repeated, and the range that it takes."""
    ids = F.concat(tokens_before, F.array_repeat(F.lit(placeholder).cast("bigint"), image_tokens.cast("int")), tokens_after)
    lo = F.size(tokens_before).cast("bigint")
    return F.struct(ids.alias("ids"), lo.alias("lo"), (lo + image_tokens).alias("hi"))
