"""Small text expressions shared by every column derivation. All stay in the JVM; those with `let` leave whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderflow.functions import signals as S

EMAIL_PATTERN = (
    r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9]*(-[A-Za-z0-9]+)*$"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, for values that the body reads many times."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def text(c: Column | str) -> Column:
    """The value as text, null as empty."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def trimmed(c: Column | str, chars: str = S.TRIM_CHARS) -> Column:
    return F.btrim(text(c), F.lit(chars))


def one_spaced(c: Column, flags: str = "") -> Column:
    """Every run of white space as one space. Single spaces, nearly all runs there are, are no match and cost nothing."""
    return F.regexp_replace(c, flags + r"\s{2,}|[^\S ]", " ")


def collapsed(c: Column | str) -> Column:
    """Trimmed, every run of white space (Unicode included) as one space."""
    return trimmed(one_spaced(text(c), "(?U)"))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?s)<!--.*?-->|</?[A-Za-z!?][^>]*>?", "")


def null_if_empty(c: Column | str) -> Column:
    c = col(c)
    return F.when(c != "", c)


def is_empty(c: Column | str) -> Column:
    """Null, blank text and the text 0 all count as no value."""
    return text(c).isin("", "0")


def leading_int(c: Column | str) -> Column:
    """The number at the start of a text, 0 when there is none."""
    digits = F.regexp_extract(text(c), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def whole_id(c: Column | str) -> Column:
    """A reference id: null, blank and negative all mean none, 0."""
    return F.greatest(F.coalesce(col(c).try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def distinct_words(words: list[str]) -> list[str]:
    """The words without those that hold another one, which a text with them has as well."""
    return [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]


def equals_any_case(c: Column, *words: str) -> Column:
    return F.lower(c).isin([w.lower() for w in words])


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN) & (F.char_length(c) <= 254) & (F.instr(c, "@") <= 65)


def parse_moment(c: Column | str) -> Column:
    """Time of a permissive date text, null when no known shape fits.

    Each format is only tried on texts of its shape, so no row pays for failed parses.
    """
    return let(F.regexp_replace(trimmed(c), r"\s+", " "), _moment)


def _moment(t: Column) -> Column:
    out = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), t.try_cast("timestamp"))
    for shape, fmt in S.DATE_SHAPES:
        out = out.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fmt)))
    return out


def parse_day(c: Column | str) -> Column:
    return F.to_date(parse_moment(c))


def day_of(c: Column | str, dtype: str) -> Column:
    """Calendar day of a column that holds a date, a timestamp or a date text."""
    return parse_day(c) if dtype == "string" else F.to_date(col(c))


def matches_search(search: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns; an empty search keeps every row."""
    q = search.strip().lower()
    if not q:
        return F.lit(True)
    return any_of([F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns])
