"""Identity keys of a record, and the key sets that linkage joins on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions.text import day_of, one_spaced, trimmed, whole_id

IDENTITY_COLUMNS = [
    "url_key", "raw_url", "strong_url", "sol_key", "tp_key", "source_key", "end_day",
    "title_key", "raw_title_key", "project_key", "has_tier_a",
]


def url_key(c: Column | str) -> Column:
    """Lower case, no scheme, no leading www., no trailing slashes."""
    bare = F.regexp_replace(F.lower(trimmed(c)), r"^https?://", "")
    return F.rtrim(F.regexp_replace(bare, r"^www\.", ""), F.lit("/"))


def listing_url_key(c: Column | str) -> Column:
    """Lower case without trailing slashes, scheme kept: the key of the master source index."""
    return F.rtrim(F.lower(trimmed(c)), F.lit("/"))


def title_key(c: Column | str) -> Column:
    plain = F.regexp_replace(trimmed(c), r"(?i)^corporate:", "")
    return F.lower(one_spaced(trimmed(plain), "(?U)"))


def token_key(c: Column | str) -> Column:
    return F.lower(trimmed(c))


def project_key(c: Column | str) -> Column:
    t = trimmed(c)
    return F.when(t.rlike(r"^\d{5,8}$"), t).otherwise("")


def url_variants(c: Column | str) -> Column:
    """The URL as given, its key, and the key under every usual prefix, without repeats."""
    raw, key = trimmed(c), url_key(c)
    prefixed = [F.concat(F.lit(p), key) for p in ("https://", "http://", "https://www.", "http://www.")]
    every = F.when(key == "", F.array(raw)).otherwise(F.array(raw, key, *prefixed))
    return F.array_distinct(F.filter(every, lambda v: v != ""))


def derive_identity_keys(
    df: DataFrame,
    *,
    url: str = "URL",
    title: str = "TITLE",
    raw_title: str | None = None,
    solicitation: str = "SOLICITATIONNUMBER",
    third_party: str = "THIRD_PARTY_IDENTIFIER",
    naics: str = "NAICSCODE",
    end: str = "ENDDATE",
    source: str = "BID_URL_ID",
) -> DataFrame:
    """Add the identity columns. Every record of a source with a project-like code has a tier A key."""
    dtype = df.schema[end].dataType.simpleString()
    made = {
        "url_key": url_key(url),
        "raw_url": F.lower(trimmed(url)),
        "sol_key": token_key(solicitation),
        "tp_key": token_key(third_party),
        "source_key": whole_id(source),
        "end_day": day_of(end, dtype),
        "title_key": title_key(title),
        "project_key": project_key(naics),
    }
    if raw_title:
        made["raw_title_key"] = title_key(raw_title)
    # A generator keeps the expressions in one place; the keys read them many times and would carry them along.
    own = F.inline(F.array(F.struct(*[v.alias(c) for c, v in made.items()])))
    others = [c for c in df.columns if c.lower() not in IDENTITY_COLUMNS]
    keyed = df.select(*others, own).withColumn("raw_title_key", F.col("raw_title_key" if raw_title else "title_key"))
    keyed = keyed.select(*others, *[c for c in IDENTITY_COLUMNS if c in keyed.columns])
    return keyed.withColumn("strong_url", F.col("url_key").contains("/")).withColumn(
        "has_tier_a",
        F.col("strong_url")
        | (F.col("sol_key") != "")
        | (F.col("tp_key") != "")
        | ((F.col("project_key") != "") & (F.col("source_key") > 0)),
    )


def _key(cond: Column, *parts: Column | str) -> Column:
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def present(keys: Column) -> Column:
    """The keys that a record really has."""
    return F.filter(keys, lambda k: k.isNotNull())


def _distinct(*keys: Column) -> Column:
    return F.array_distinct(present(F.array(*keys)))


def fingerprint_keys() -> Column:
    """Keys under which a record is remembered within one run."""
    c = F.col
    dated = (c("source_key") > 0) & c("end_day").isNotNull()
    return _distinct(
        _key(c("url_key") != "", "url:", c("url_key")),
        _key(c("sol_key") != "", "sol:", c("sol_key")),
        _key(c("tp_key") != "", "tp:", c("tp_key")),
        _key(dated & (c("title_key") != ""), "bc:", c("source_key"), ":", c("end_day"), ":", c("title_key")),
        _key(dated & (c("raw_title_key") != ""), "bc:", c("source_key"), ":", c("end_day"), ":", c("raw_title_key")),
        _key((c("source_key") > 0) & (c("project_key") != ""), "naics:", c("source_key"), ":", c("project_key")),
    )


# Rank of a reason inside its table: the first reason that hits wins.
REASONS = [
    ("A", "normalized_url"),
    ("A", "solicitation_number"),
    ("A", "third_party_identifier"),
    ("A", "bid_url_project_naics"),
    ("B", "bid_url_enddate_title"),
    ("C", "title_enddate"),
]


def stored_keys(naics: str = "NAICSCODE", url_match: str = "raw") -> Column:
    """Keys a stored record can be found by, null where it has none; explode and drop the nulls, or use `present`.

    `url_match='key'` compares URL keys on both sides.
    """
    c = F.col
    stored_url = c("raw_url") if url_match == "raw" else c("url_key")
    code = F.lower(trimmed(naics))
    titled = c("end_day").isNotNull() & (c("title_key") != "")
    sourced = c("source_key") > 0
    return F.array(
        _key(stored_url != "", "u*|", stored_url),
        _key(sourced & (stored_url != ""), "u", c("source_key"), "|", stored_url),
        _key(c("sol_key") != "", "s|", c("sol_key")),
        _key(c("tp_key") != "", "t|", c("tp_key")),
        _key(sourced & (code != ""), "n", c("source_key"), "|", code),
        _key(sourced & titled, "b", c("source_key"), "|", c("end_day"), "|", c("title_key")),
        _key(titled, "c|", c("end_day"), "|", c("title_key")),
    )


def probe_keys(url_match: str = "raw") -> Column:
    """Keys a record looks itself up by, as (reason rank, key), null where it has none. Tier C only without a source id."""
    c = F.col
    sourced = c("source_key") > 0
    scope = F.when(sourced, F.concat(F.lit("u"), c("source_key").cast("string"), F.lit("|"))).otherwise("u*|")
    strong, dated = c("strong_url"), c("end_day").isNotNull()
    plan: list[tuple[int, Column]] = [(0, _key(strong, scope, c("url_key")))]
    if url_match == "raw":
        plan.append((0, _key(strong & (c("raw_url") != c("url_key")), scope, c("raw_url"))))
    plan += [
        (1, _key(c("sol_key") != "", "s|", c("sol_key"))),
        (2, _key(c("tp_key") != "", "t|", c("tp_key"))),
        (3, _key(sourced & (c("project_key") != ""), "n", c("source_key"), "|", c("project_key"))),
    ]
    for t in ("title_key", "raw_title_key"):
        has = dated & (c(t) != "")
        if t == "raw_title_key":
            has = has & (c(t) != c("title_key"))
        plan.append((4, _key(sourced & has, "b", c("source_key"), "|", c("end_day"), "|", c(t))))
        plan.append((5, _key(~sourced & has, "c|", c("end_day"), "|", c(t))))
    pairs = [F.when(k.isNotNull(), F.struct(F.lit(r).alias("rank"), k.alias("key"))) for r, k in plan]
    return F.array(*pairs)


def probe_key_names() -> Column:
    """The probe keys without their rank."""
    return F.transform(present(probe_keys()), lambda k: k["key"])


