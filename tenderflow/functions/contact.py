"""Contact fields: e-mail, organization, address and phone, posting entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderflow.functions import signals as S
from tenderflow.functions.names import organization_name
from tenderflow.functions.text import collapsed, equals_any_case, is_email, let, strip_tags, text, trimmed


def first_email(c: Column | str) -> Column:
    """First valid address of a field that may list several, null when there is none."""
    s = trimmed(c)
    parts = F.filter(F.split(s, r"[\s,;|]+"), lambda p: (p != "") & is_email(p))
    return F.when(~equals_any_case(s, "not provided"), F.get(parts, 0))


def email_in_text(c: Column | str) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"), F.lit(1))
    # The pattern begins anew at every word, so it only reads texts that have what it needs.
    return F.when(text(c).contains("@"), F.get(F.filter(found, is_email), 0))


def resolve_contact_email(field: Column | str, description: Column | str) -> Column:
    return F.coalesce(first_email(field), email_in_text(description))


def comparable_email(c: Column | str) -> Column:
    s = F.lower(trimmed(strip_tags(c)))
    return F.when(~s.contains("not provided") & is_email(s), s).otherwise("")


def posting_entity(c: Column | str) -> Column:
    return let(F.lower(collapsed(c)), _posting_kind)


def _posting_kind(s: Column) -> Column:
    return (
        F.when((s == "") | s.contains("not provided"), "uncertain")
        .when(s.isin("private_company", "government", "uncertain"), s)
        .when(s.rlike(r"private[\s_-]*company|^corporate$"), "private_company")
        .when(s.rlike(r"^government$|^gov$|public sector|public agency|municipal|county "), "government")
        .otherwise("uncertain")
    )


def issuing_organization(c: Column | str) -> Column:
    return organization_name(c)


def _given(snippet: Column, limit: int | None) -> Column:
    return let(snippet, lambda s: _if_given(s, limit))


def _if_given(s: Column, limit: int | None) -> Column:
    first = F.lower(trimmed(F.element_at(F.split(s, "\n"), 1)))
    missing = (s == "") | (first == "") | first.startswith("not provided") | first.isin(S.SNIPPET_PLACEHOLDERS)
    cut = s if limit is None else F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)
    return F.when(missing, "").otherwise(cut)


def address_snippet(c: Column | str, limit: int | None = None) -> Column:
    """Address without tags, one clean line per line; empty for a placeholder. `limit` cuts longer ones."""
    lines = F.split(F.regexp_replace(strip_tags(trimmed(c)), r"\r\n|\r", "\n"), "\n")
    clean = F.transform(lines, lambda v: trimmed(F.regexp_replace(v, r"[ \t]+", " ")))
    return _given(F.array_join(F.filter(clean, lambda v: v != ""), "\n"), limit)


def phone_snippet(c: Column | str, limit: int | None = None) -> Column:
    return _given(collapsed(strip_tags(trimmed(c))), limit)


def with_contact_block(description: Column | str, address: Column, phone: Column) -> Column:
    """Description with the contact block at its end, added once."""
    desc = text(description)
    base = F.regexp_replace(F.rtrim(desc, F.lit(S.TRIM_CHARS)), r"\r\n|\r", "\n")
    block = F.concat_ws(
        "\n",
        F.lit(S.CONTACT_HEADING),
        F.when(address != "", F.concat(F.lit("Address: "), address)),
        F.when(phone != "", F.concat(F.lit("Phone: "), phone)),
    )
    return (
        F.when((address == "") & (phone == ""), desc)
        .when((base != "") & base.endswith(block), desc)
        .when(base == "", block)
        .otherwise(F.concat(base, F.lit("\n\n"), block))
    )
