"""String predicates and parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed grammars.
SLOT_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
PROVIDER_ID = r"^[a-z0-9][a-z0-9._-]{0,63}$"
LABEL = r"^[A-Za-z_][A-Za-z0-9_-]{0,127}$"
SHA256_ANY = r"^[0-9A-Fa-f]{64}$"
SHA256_LOWER = r"^[0-9a-f]{64}$"
GIT_REVISION = r"^([0-9a-f]{40}|[0-9a-f]{64})$"

#: Canonical roles by normalised label; other labels are "unknown".
ROLES = {
    "title": "title",
    "doc_title": "title",
    "paragraph_title": "heading",
    "header": "header",
    "footer": "footer",
    "text": "paragraph",
    "paragraph": "paragraph",
    "list": "list",
    "list_item": "list",
    "table": "table",
    "figure": "figure",
    "image": "figure",
    "caption": "caption",
    "equation": "equation-block",
    "equation_block": "equation-block",
    "formula": "equation-block",
    "footnote": "footnote",
    "page_number": "page-number",
    "code": "code",
    "seal": "seal",
}


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def bounded_text(c: Column, max_bytes: int) -> Column:
    """Not longer than max_bytes in UTF-8 and free of control characters."""
    return (F.octet_length(c) <= max_bytes) & ~c.rlike(r"\p{Cc}")


def parse_scale(c: Column) -> Column:
    """A number, or a quotient of two; null where it is neither or divides by zero."""
    part = lambda k: F.get(F.split(c, "/"), k).try_cast("double")
    quotient = part(F.lit(0)) / F.nullif(part(F.lit(1)), F.lit(0.0))
    return F.when(F.size(F.split(c, "/")) == 2, quotient).when(F.size(F.split(c, "/")) == 1, part(F.lit(0)))


def canonical_role(label: Column) -> Column:
    key = F.translate(F.lower(label), "-", "_")
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(roles[key], F.lit("unknown"))


def normalized(c: Column, stop: str) -> Column:
    """Trimmed, trailing stop tokens stripped, and two relation signs written plainly."""
    quoted = rf"(\s*\Q{stop}\E)+\s*$"
    trimmed = F.regexp_replace(F.regexp_replace(c, quoted, ""), r"^\s+|\s+$", "")
    return F.replace(F.replace(trimmed, F.lit(r"\coloneqq"), F.lit(":=")), F.lit(r"\eqqcolon"), F.lit("=:"))


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.array_join(F.filter(F.split(c, r"\s+"), lambda w: w != ""), " ")


def span_attribute(c: Column, name: str) -> Column:
    """The number of ` name="n"`: 1 where absent, null (an error) beyond 1 to 20."""
    raw = F.regexp_extract(c, rf' {name}="([0-9]+)"', 1)
    n = F.when(raw == "", F.lit(1)).otherwise(raw.try_cast("bigint"))
    return F.when(n.between(1, 20), n)


def content_range(c: Column) -> Column:
    """first, last and total of a Content-Range header; null where it is malformed or inconsistent."""
    pattern = r"^bytes ([0-9]{1,18})-([0-9]{1,18})/([0-9]{1,18})$"
    part = lambda k: F.regexp_extract(c, pattern, k).try_cast("bigint")
    ok = (part(1) <= part(2)) & (part(2) < part(3))
    return F.when(ok, F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total")))


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def approved_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a download may go there: https, one of the hosts by its whole name, no user or port before or after it."""
    host = F.regexp_extract(url, r"^https://([^/?#]*)(?:[/?#]|$)", 1)
    return F.coalesce(F.lower(host).isin(*hosts), F.lit(False))
