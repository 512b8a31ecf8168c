"""Titles, links and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderflow.functions import signals as S
from tenderflow.functions.contact import comparable_email
from tenderflow.functions.text import collapsed, let, text, trimmed


def corporate_prefix(title: Column | str, posting: Column | str) -> Column:
    t = trimmed(title)
    private = F.lower(trimmed(posting)) == "private_company"
    prefixed = t.rlike(r"(?iu)^Corporate\s*:\s+")
    return F.when((t != "") & private & ~prefixed, F.concat(F.lit("Corporate: "), t)).otherwise(text(title))


def title_from_url(url: Column | str, kind: str = "page") -> Column:
    """Readable title from the last telling path segment of a URL."""
    longer_than, default = {"page": (5, "Bidding Page"), "document": (3, "Document")}[kind]
    path = F.regexp_extract(text(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    if kind == "document":
        parts = F.filter(parts, lambda p: (p != "") & (p != "0"))
    return let(parts, lambda ps: _title_of(ps, kind, longer_than, default))


def _title_of(parts: Column, kind: str, longer_than: int, default: str) -> Column:
    telling = F.filter(
        parts, lambda p: (F.octet_length(p) > longer_than) & ~p.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    )
    last = F.coalesce(F.try_element_at(telling, F.lit(-1)), F.try_element_at(parts, F.lit(-1)), F.lit(""))
    spaced = F.regexp_replace(last, "-|_|%20", " ")
    words = F.initcap(F.lower(F.coalesce(F.try_url_decode(spaced), spaced)))
    words = trimmed(words) if kind == "document" else words
    return let(words, lambda w: F.when(w.isin("", "0"), default).otherwise(w))


def public_slug(title: Column | str, pk: Column) -> Column:
    """First 40 characters of the title, everything but letters and digits as hyphens, then the key."""
    t = text(title)
    head = F.regexp_replace(F.substring(t, 1, 40), r"[^\p{L}\p{N}]", "-")
    return F.when(t == "", F.concat(F.lit("Unknown-"), pk)).otherwise(F.concat(head, F.lit("-"), pk))


def public_link(
    title: Column | str,
    record_id: Column | str,
    third_party: Column | str,
    *,
    trust_local_id: bool = False,
    base: str = S.PUBLIC_LINK_BASE,
) -> Column:
    """Public address of a record, null without a usable key."""
    tp = trimmed(third_party)
    local = text(record_id)
    pk = F.when(tp.rlike(r"^\d+$"), tp)
    if trust_local_id:
        pk = pk.when(local.rlike(r"^\d+$"), local)
    return F.when(pk.isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), public_slug(title, pk)))


def entity_label(entity_id: Column | str, names: list[str], emails: list[str]) -> Column:
    """Distinct name parts, the id, and the first valid e-mail."""
    parts = F.array_distinct(F.filter(F.array(*[collapsed(n) for n in names]), lambda v: v != ""))
    joined = F.array_join(parts, " ")
    name = F.when(joined == "", "Entity").otherwise(joined)
    shown = F.get(F.filter(F.array(*[comparable_email(e) for e in emails]), lambda v: v != ""), 0)
    suffix = F.when(shown.isNotNull(), F.concat(F.lit(" · "), shown)).otherwise("")
    return F.concat(name, F.lit(" (#"), text(entity_id), F.lit(")"), suffix)


def state_label(name: Column | str, abbreviation: Column | str) -> Column:
    """`ABBR — Name`, either alone, or null when both are blank."""
    n, a = trimmed(name), F.upper(trimmed(abbreviation))
    return (
        F.when((n != "") & (a != ""), F.concat(a, F.lit(" — "), n)).when(n != "", n).when(a != "", a)
    )


def source_label(name: Column | str, url: Column | str) -> Column:
    """`name — url`, or the URL alone; null without a URL."""
    n, u = trimmed(name), trimmed(url)
    return F.when(u == "", None).when(n != "", F.concat(n, F.lit(" — "), u)).otherwise(u)
