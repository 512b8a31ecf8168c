"""Reference resolution: entity, state, category, source and page ids by exact, suffix and fuzzy match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions.contact import comparable_email
from tenderflow.functions.identity import listing_url_key
from tenderflow.functions.names import (
    canonical_name,
    is_portal_host,
    organization_hints,
    organization_name,
    references_portal,
    significant_tokens,
    url_host,
)
from tenderflow.functions.text import one_spaced, text, trimmed, whole_id
from tenderflow.operators.candidates import (
    banded,
    banded_probes,
    best_shared_words,
    best_similar_join,
    contained_pairs,
    first_similar,
)
from tenderflow.operators.positions import with_positions
from tenderflow.operators.skew import block_match, lookup_join
from tenderflow.session import cut_lineage

SOURCE_NAME_SCORE = 72.0
HINT_SCORE = 78.0
# The score of a name that holds the hint or is held by it, and that of shared words.
HELD_SCORE = 88.0
WORDS_FROM, WORDS_WEIGHT, WORDS_MOST = 65.0, 35.0, 92.0
HELD_CATEGORY, CATEGORY_SCORE, TITLE_SCORE = 80.0, 50.0, 55.0


# ---------------------------------------------------------------- entities

def entity_names(entities: DataFrame, names: list[str] = ["name"]) -> DataFrame:
    """One row per entity name: id, lower-case name, canonical key, significant tokens."""
    every = entities.select(
        F.col("id").cast("bigint").alias("id"),
        F.explode(F.array_distinct(F.array(*[trimmed(n) for n in names]))).alias("name"),
    ).where(F.char_length("name") >= 3)
    return every.select(
        "id",
        F.lower("name").alias("lower"),
        canonical_name("name").alias("canon"),
        significant_tokens("name").alias("tokens"),
    )


def entity_addresses(entities: DataFrame, emails: list[str], websites: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lowest entity id per e-mail, and per e-mail domain or website host."""
    given = entities.select(
        F.col("id").cast("bigint").alias("entity_id"),
        F.array_distinct(F.array(*[comparable_email(e) for e in emails])).alias("emails"),
        F.array(*[url_host(w) for w in websites]).cast("array<string>").alias("hosts"),
    )
    by_email = given.select("entity_id", F.explode("emails").alias("email")).where(F.col("email") != "")
    domains = F.filter(
        F.transform("emails", lambda e: F.regexp_extract(e, r"@([a-z0-9.-]+)$", 1)), lambda d: d != ""
    )
    by_host = given.select("entity_id", F.explode(F.array_union(domains, F.col("hosts"))).alias("host")).where(
        F.col("host") != ""
    )
    low = F.min("entity_id").alias("entity_id")
    return by_email.groupBy("email").agg(low), by_host.groupBy("host").agg(low)


def top_scores(found: DataFrame) -> DataFrame:
    """Per hint the best score, with the lowest and the highest id that reach it."""
    best = found.groupBy("hint").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "low_id")).alias("lo"),
        F.min(F.struct((-F.col("score")).alias("s"), (-F.col("high_id")).alias("h"))).alias("hi"),
    )
    return best.select("hint", (-F.col("lo.s")).alias("score"), F.col("lo.low_id").alias("low_id"), (-F.col("hi.h")).alias("high_id"))


def holding_pairs(left: DataFrame, right: DataFrame, group: str | None = None) -> DataFrame:
    """(group, left, right): pairs of distinct texts of which one holds the other; equal ones come twice. Empty texts take no part."""
    own = [group] if group else []
    left, right = left.where("left <> ''"), right.where("right <> ''")
    inside = contained_pairs(left.withColumnRenamed("left", "needle"), right.withColumnRenamed("right", "text"), group)
    around = contained_pairs(right.withColumnRenamed("right", "needle"), left.withColumnRenamed("left", "text"), group)
    one = inside.select(*own, F.col("needle").alias("left"), F.col("text").alias("right"))
    return one.unionByName(around.select(*own, F.col("text").alias("left"), F.col("needle").alias("right")))


def best_name_matches(hints: DataFrame, names: DataFrame, at_least: float, **blocks: int) -> DataFrame:
    """For each distinct hint: the id of an equal name if any, else the best score and the ids that tie for it.

    Equal names are found by an equi join. For the other hints, names that hold them or are held and names with the most words in common
    are found by joins, and what these score is the least that a similar name must reach to be scored at all.
    """
    prepared = cut_lineage(
        hints.select("hint")
        .where(F.char_length("hint") >= 4)
        .distinct()
        .withColumns({"lower": F.lower("hint"), "canon": canonical_name("hint"), "tokens": significant_tokens("hint")})
    )
    keys = F.array(F.concat(F.lit("l|"), F.col("lower")), F.when(F.col("canon") != "", F.concat(F.lit("c|"), F.col("canon"))))
    some = F.filter(keys, lambda k: k.isNotNull())
    equal_index = names.select("id", F.explode(some).alias("key")).groupBy("key").agg(F.min("id").alias("equal_id"))
    equal = (
        prepared.select("hint", F.explode(some).alias("key"))
        .join(equal_index, "key")
        .groupBy("hint")
        .agg(F.min("equal_id").alias("equal_id"))
    )
    rest = cut_lineage(prepared.join(equal, "hint", "left_anti").select("hint", "lower", "tokens"))
    scores = ["hint", "score", "low_id", "high_id"]
    texts = cut_lineage(names.groupBy("lower").agg(F.min("id").alias("low_id"), F.max("id").alias("high_id")))
    long = rest.where(F.char_length("lower") >= 8)
    held = holding_pairs(long.select(F.col("lower").alias("left")), texts.select(F.col("lower").alias("right")))
    held = held.join(texts.withColumnRenamed("lower", "right"), "right").groupBy(F.col("left").alias("lower")).agg(F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id"))
    held = rest.join(held, "lower").select("hint", F.lit(HELD_SCORE).alias("score"), "low_id", "high_id")
    words = best_shared_words(
        rest.select(F.col("hint").alias("key"), F.col("tokens").alias("words")),
        names.select(F.col("tokens").alias("words"), F.col("id").alias("low_id"), F.col("id").alias("high_id")),
        max(0.0, (at_least - WORDS_FROM) / WORDS_WEIGHT),
    )
    shared = F.least(F.lit(WORDS_MOST), F.lit(WORDS_FROM) + F.col("shared") * F.lit(WORDS_WEIGHT))
    words = words.select(F.col("key").alias("hint"), F.round(shared, 6).alias("score"), "low_id", "high_id").where(shared >= at_least)
    known = cut_lineage(top_scores(held.where(F.col("score") >= at_least).unionByName(words)))
    # What is known already is what a similar name must reach.
    open_hints = rest.join(known.select("hint", F.col("score").alias("floor")), "hint", "left")
    open_hints = open_hints.select("hint", "lower", F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(float(at_least))).alias("floor"))
    alike = best_similar_join(open_hints, texts, **blocks).where(F.col("hint").isNotNull())
    fuzzy = top_scores(known.select(*scores).unionByName(alike.select(*scores)))
    none = F.lit(None)
    return equal.select(
        "hint", "equal_id", none.cast("double").alias("score"), none.cast("bigint").alias("low_id"),
        none.cast("bigint").alias("high_id"),
    ).unionByName(fuzzy.withColumn("equal_id", none.cast("bigint")))


def _resolve_hint_sets(sets: DataFrame, record: str, names: DataFrame, at_least: float) -> DataFrame:
    """One id per record from its hints: the lowest equal id, else the only id at the top score."""
    matches = best_name_matches(sets, names, at_least)
    joined = lookup_join(sets, matches, "hint", ["equal_id", "score", "low_id", "high_id"])
    per = joined.groupBy(record).agg(
        F.min("equal_id").alias("equal_id"),
        F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "low_id"))).alias("lo"),
        F.min(
            F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), (-F.col("high_id")).alias("h")))
        ).alias("hi"),
    )
    only = F.when((F.col("lo.low_id") == -F.col("hi.h")) & (-F.col("lo.s") >= at_least), F.col("lo.low_id"))
    return per.select(record, F.coalesce("equal_id", only).alias("found_id")).where(F.col("found_id").isNotNull())


def host_suffixes(host: Column) -> Column:
    """The host and its parents of at least two labels."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    every = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when((host != "") & (F.size(labels) >= 2), every).otherwise(F.array().cast("array<string>"))


def resolve_entity(
    records: DataFrame,
    record: str,
    entities: DataFrame,
    *,
    names: list[str] = ["name"],
    emails: list[str] = ["email"],
    websites: list[str] = ["website"],
    labelled: str | None = None,
) -> DataFrame:
    """Entity id of each record by source name, then e-mail, then host, then name hints; unresolved rows are left out.

    Reads `bid_url_name, ISSUING_ORGANIZATION, EMAIL, URL, source_listing_url` and `TITLE, DESCRIPTION`, or in place of these two the
    column `labelled` with the organizations found in them. Each stage only sees what the earlier ones left open.
    """
    index = entity_names(entities, names)
    by_email, by_host = entity_addresses(entities, emails, websites)

    # Read by every stage, so it is computed once.
    base = cut_lineage(records.select(
        F.col(record),
        organization_name("bid_url_name").alias("source_hint"),
        comparable_email("EMAIL").alias("email"),
        F.array_distinct(
            F.filter(
                F.array(url_host("URL"), url_host("source_listing_url")), lambda h: (h != "") & ~is_portal_host(h)
            )
        ).alias("hosts"),
        organization_hints(
            "bid_url_name", "ISSUING_ORGANIZATION", "source_listing_url", "URL", "TITLE", "DESCRIPTION", labelled
        ).alias("hints"),
    ))
    by_source_name = best_name_matches(base.select(F.col("source_hint").alias("hint")), index, SOURCE_NAME_SCORE).select(
        F.col("hint").alias("source_hint"),
        F.coalesce("equal_id", F.when(F.col("low_id") == F.col("high_id"), F.col("low_id"))).alias("name_id"),
    )
    staged = lookup_join(base, by_source_name, "source_hint", ["name_id"])
    staged = lookup_join(staged, by_email.withColumnRenamed("entity_id", "email_id"), "email", ["email_id"])

    # Hosts repeat across records, so they are resolved once each.
    hosts = staged.where(F.coalesce("name_id", "email_id").isNull()).select(F.explode("hosts").alias("h")).distinct()
    host_ids = (
        hosts.select("h", F.explode(host_suffixes(F.col("h"))).alias("host"))
        .join(by_host, "host")
        .groupBy("h")
        .agg(F.min("entity_id").alias("host_id"))
    )
    for i in (0, 1):
        staged = staged.withColumn("h", F.get("hosts", F.lit(i)))
        staged = lookup_join(staged, host_ids, "h", ["host_id"]).withColumnRenamed("host_id", f"host_id_{i}").drop("h")

    staged = cut_lineage(staged)
    early = F.coalesce("name_id", "email_id", "host_id_0", "host_id_1")
    stage = (
        F.when(F.col("name_id").isNotNull(), "source_name")
        .when(F.col("email_id").isNotNull(), "email")
        .otherwise("host")
    )
    settled = staged.where(early.isNotNull()).select(record, early.alias("entity_id"), stage.alias("matched_by"))
    open_sets = staged.where(early.isNull()).select(record, F.explode("hints").alias("hint"))
    from_hints = _resolve_hint_sets(open_sets, record, index, HINT_SCORE).select(
        record, F.col("found_id").alias("entity_id"), F.lit("name_hint").alias("matched_by")
    )
    return settled.unionByName(from_hints)


# ---------------------------------------------------------------- states and categories

def resolve_state(records: DataFrame, record: str, hint: str, states: DataFrame) -> DataFrame:
    """State id of each record: abbreviation, else equal name, else the first name that overlaps the hint."""
    named = states.select(
        F.col("id").cast("bigint").alias("id"),
        F.lower(trimmed("name")).alias("name"),
        F.upper(trimmed("abbreviation")).alias("abbr"),
    )
    hints = records.select(trimmed(hint).alias("raw")).where(F.col("raw") != "").distinct().withColumns(
        {"hint": F.lower("raw"), "code": F.when(F.col("raw").rlike("^[A-Za-z]{2}$"), F.upper("raw"))}
    )
    by_abbr = named.where(F.col("abbr") != "").groupBy(F.col("abbr").alias("code")).agg(F.min("id").alias("abbr_id"))
    by_name = named.where(F.col("name") != "").groupBy(F.col("name").alias("hint")).agg(F.min("id").alias("name_id"))
    staged = hints.join(by_abbr, "code", "left").join(by_name, "hint", "left")
    rest = staged.where(F.coalesce("abbr_id", "name_id").isNull()).select(F.col("hint").alias("left"))
    lowest = named.where(F.col("name") != "").groupBy(F.col("name").alias("right")).agg(F.min("id").alias("id"))
    overlap = holding_pairs(rest, lowest.select("right")).join(lowest, "right").groupBy(F.col("left").alias("hint")).agg(F.min("id").alias("overlap_id"))
    resolved = staged.join(overlap, "hint", "left").select(
        "raw", F.coalesce("abbr_id", "name_id", "overlap_id").alias("state_id")
    ).where(F.col("state_id").isNotNull())
    keyed = records.select(F.col(record), trimmed(hint).alias("raw"))
    return lookup_join(keyed, resolved, "raw", ["state_id"]).where(F.col("state_id").isNotNull()).select(record, "state_id")


def resolve_category(records: DataFrame, record: str, hint: str, categories: DataFrame) -> DataFrame:
    """Category id of each record: equal name, else the best score of at least 50, lowest id first."""
    named = categories.select(F.col("id").cast("bigint").alias("id"), F.lower(trimmed("name")).alias("name")).where(
        F.col("name") != ""
    )
    keyed = records.select(F.col(record), F.lower(trimmed(hint)).alias("hint"))
    hints = keyed.where(F.col("hint") != "").select("hint").distinct()
    by_name = named.groupBy(F.col("name").alias("hint")).agg(F.min("id").alias("category_id"))
    equal = hints.join(by_name, "hint")
    rest = cut_lineage(hints.join(by_name, "hint", "left_anti"))
    texts = by_name.select(F.col("hint").alias("lower"), F.col("category_id").alias("low_id"), F.col("category_id").alias("high_id"))
    held = holding_pairs(rest.select(F.col("hint").alias("left")), texts.select(F.col("lower").alias("right")))
    held = held.join(texts.withColumnRenamed("lower", "right"), "right").select(F.col("left").alias("hint"), F.lit(HELD_CATEGORY).alias("score"), "low_id", "high_id")
    known = cut_lineage(top_scores(held))
    # Names that hold the hint or are held score by that alone.
    open_hints = rest.join(known.select("hint", F.col("score").alias("floor")), "hint", "left")
    open_hints = open_hints.select("hint", F.col("hint").alias("lower"), F.coalesce("floor", F.lit(CATEGORY_SCORE)).alias("floor"))
    alike = best_similar_join(open_hints, texts, skip_contained=True).where(F.col("hint").isNotNull())
    scored = top_scores(known.unionByName(alike.select(*known.columns)))
    resolved = equal.unionByName(scored.select("hint", F.col("low_id").alias("category_id")))
    return (
        lookup_join(keyed, resolved, "hint", ["category_id"])
        .where(F.col("category_id").isNotNull())
        .select(record, "category_id")
    )


# ---------------------------------------------------------------- master sources

def master_url_index(master: DataFrame) -> DataFrame:
    """Lowest master id per URL, compared in lower case without trailing slashes."""
    return (
        master.select(listing_url_key("URL").alias("url_key"), F.col("ID").cast("bigint").alias("ID"))
        .where((F.col("url_key") != "") & F.col("ID").isNotNull())
        .groupBy("url_key")
        .agg(F.min("ID").alias("master_id"))
    )


def resolve_master_source_id(
    records: DataFrame,
    source_id: str,
    url_hint: str,
    sources: DataFrame,
    master: DataFrame | None,
    *,
    out: str = "master_source_id",
    from_source: bool = True,
    references_master: bool = True,
) -> DataFrame:
    """Add the master id of each record's source.

    With `from_source` the chain starts at the source row: its third-party id if the master has it, then the listing
    URL (else the source's own) in the master index. Both forms go on with the id itself if the master has it, the
    source's own URL, the hint, and at last the id as it is. Without a master table the id stays.
    """
    if master is None:
        return records.withColumn(out, F.when(whole_id(source_id) > 0, whole_id(source_id)))
    pair = F.concat_ws("|", whole_id(source_id).cast("string"), trimmed(url_hint))
    pairs = records.select(whole_id(source_id).alias("sid"), trimmed(url_hint).alias("hint"), pair.alias("pair")).distinct()
    by_url = master_url_index(master)
    ids = master.select(F.col("ID").cast("bigint").alias("known_id")).where(F.col("known_id").isNotNull()).distinct()
    own = sources.select(
        F.col("id").cast("bigint").alias("sid"), trimmed("url").alias("own_url"),
        whole_id("third_party_url_id").alias("third_party"), F.lit(True).alias("has_source"),
    )

    def with_url(df: DataFrame, url: Column, name: str) -> DataFrame:
        index = by_url.select(F.col("url_key").alias("_u"), F.col("master_id").alias(name))
        return lookup_join(df.withColumn("_u", listing_url_key(url)), index, "_u", [name]).drop("_u")

    def with_known(df: DataFrame, c: str, name: str) -> DataFrame:
        return lookup_join(df, ids.select(F.col("known_id").alias(c), F.col("known_id").alias(name)), c, [name])

    staged = pairs.join(own, "sid", "left")
    staged = with_known(staged, "sid", "same_id")
    staged = with_known(staged, "third_party", "third_id")
    staged = with_url(staged, F.col("hint"), "hint_id")
    staged = with_url(staged, F.col("own_url"), "own_id")
    has_source = F.coalesce("has_source", F.lit(False))
    third = F.when(F.lit(from_source and references_master) & has_source & (F.col("third_party") > 0), F.col("third_id"))
    listed = F.when(F.col("hint") != "", F.col("hint_id")).otherwise(F.col("own_id"))
    first = F.when(F.lit(from_source) & has_source, F.coalesce(third, listed))
    kept = F.when(F.col("sid") < 1, F.col("hint_id"))
    if references_master:
        kept = kept.otherwise(F.coalesce("same_id", "own_id", "hint_id", "sid"))
    else:
        kept = kept.otherwise(F.col("sid"))
    resolved = staged.select("pair", F.coalesce(first, kept).alias(out))
    # Hot sources were one pair each above; their records meet the result in a join that spreads them.
    keyed = records.withColumn("pair", pair)
    return lookup_join(keyed, resolved, "pair", [out]).drop("pair")


# ---------------------------------------------------------------- pages and titles

def page_title_key(c: Column | str) -> Column:
    one_line = F.lower(trimmed(one_spaced(text(c))))
    return trimmed(F.regexp_replace(one_line, r"[^a-z0-9\s]+", ""))


def match_page_by_title(bids: DataFrame, pages: DataFrame, **blocks: int) -> DataFrame:
    """First non-portal page of the listing whose title contains, is contained in, or resembles the bid title.

    `bids(listing_url, TITLE)`, `pages(listing_url, pos, url, title)`. One row per listing and normalized title.
    """
    titles = bids.select("listing_url", page_title_key("TITLE").alias("title")).where(F.col("title") != "").distinct()
    # A generator keeps the title's expression in one place; a filter on its result would be evaluated a second time, before it.
    own_title = F.explode(F.filter(F.array(page_title_key("title")), lambda v: v != "")).alias("page_title")
    usable = pages.where((trimmed("url") != "") & ~references_portal("url")).select(
        "listing_url", F.col("pos").cast("bigint").alias("pos"), trimmed("url").alias("page_url"), own_title
    )
    # Of the pages of a listing with equal titles only the first can be the match.
    usable = cut_lineage(usable.groupBy("listing_url", "page_title").agg(F.min(F.struct("pos", "page_url")).alias("at")))
    titles = cut_lineage(titles)
    held = holding_pairs(
        titles.select("listing_url", F.col("title").alias("left")), usable.select("listing_url", F.col("page_title").alias("right")), "listing_url"
    )
    held = held.join(usable.withColumnRenamed("page_title", "right"), ["listing_url", "right"]).groupBy("listing_url", F.col("left").alias("title")).agg(F.min("at").alias("at"))
    held = cut_lineage(held)
    # A similar page is of use only before that.
    probes = titles.join(held.withColumnRenamed("at", "held"), ["listing_url", "title"], "left").select(
        "listing_url", "title", F.coalesce(F.col("held.pos").cast("double"), F.lit(float("inf"))).alias("limit")
    )

    def match(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        t, p, _ = first_similar(lp["title"].tolist(), lp["limit"].to_numpy(), rp["page_title"].tolist(), rp["pos"].to_numpy(), TITLE_SCORE)
        return pd.DataFrame({"listing_url": lp["listing_url"].to_numpy()[t], "title": lp["title"].to_numpy()[t], "pos": rp["pos"].to_numpy()[p], "page_url": rp["page_url"].to_numpy()[p]})

    pages_at = banded(usable.select("listing_url", "page_title", "at.pos", "at.page_url"), "page_title", "listing_url")
    part = block_match(
        banded_probes(probes, "title", F.lit(TITLE_SCORE), "listing_url"), pages_at, "_band", match,
        "listing_url string, title string, pos bigint, page_url string", **{"left_block": 4_000, "right_block": 20_000, **blocks},
    )
    both = part.unionByName(held.select("listing_url", "title", "at.pos", "at.page_url"))
    first = both.groupBy("listing_url", "title").agg(F.min(F.struct("pos", "page_url")).alias("f"))
    return first.select("listing_url", "title", F.col("f.pos").alias("pos"), F.col("f.page_url").alias("page_url"))


def resolve_saved_url(bids: DataFrame, pages: DataFrame | None, *, listing: str = "listing_url", detail: str = "URL") -> DataFrame:
    """Add `saved_url`: empty for a portal source, else the detail URL, a matching page, or the source URL."""
    source = trimmed(listing)
    found = trimmed(detail)
    given = F.when(found != "", found).otherwise(source)
    if pages is None:
        matched = bids.withColumn("page_url", F.lit(None).cast("string"))
    else:
        key = F.concat_ws("\u0001", F.col(listing), page_title_key("TITLE"))
        hits = match_page_by_title(bids.withColumnRenamed(listing, "listing_url"), pages).select(
            F.concat_ws("\u0001", "listing_url", "title").alias("_page_key"), "page_url"
        )
        matched = lookup_join(bids.withColumn("_page_key", key), hits, "_page_key", ["page_url"]).drop("_page_key")
    saved = (
        F.when((source != "") & references_portal(source), "")
        .when((given != "") & ~references_portal(given), given)
        .when(F.col("page_url").isNotNull(), F.col("page_url"))
        .otherwise(source)
    )
    return matched.withColumn("saved_url", saved).drop("page_url")


def apply_title_rewrites(bids: DataFrame, rewrites: DataFrame, *, listing: str = "listing_url", pos: str = "pos") -> DataFrame:
    """Add `display_title`: the rewrite at the title's place when a listing has as many rewrites as titles.

    `rewrites(listing_url, pos, rewrite)`. Blank titles take no place; of equal raw titles the last rewrite wins.
    """
    named = bids.where(~text("TITLE").isin("", "0")).select(F.col(listing).alias("listing_url"), F.col(pos).alias("_pos"), "TITLE")
    raw = with_positions(named, "listing_url", "_pos", "place")
    new = with_positions(
        rewrites.select("listing_url", F.col("pos").alias("_pos"), "rewrite"), "listing_url", "_pos", "place"
    )
    sizes = raw.groupBy("listing_url").agg(F.count("*").alias("n")).join(
        new.groupBy("listing_url").agg(F.count("*").alias("n")), ["listing_url", "n"]
    )
    placed = raw.join(new.select("listing_url", "place", "rewrite"), ["listing_url", "place"])
    last = placed.groupBy("listing_url", "TITLE").agg(F.max_by("rewrite", "place").alias("rewrite"))
    good = last.join(sizes.select("listing_url"), "listing_url", "left_semi").select(
        F.concat_ws("\u0001", "listing_url", "TITLE").alias("_title_key"), "rewrite"
    )
    keyed = bids.withColumn("_title_key", F.concat_ws("\u0001", F.col(listing), F.col("TITLE")))
    return (
        lookup_join(keyed, good, "_title_key", ["rewrite"])
        .withColumn("display_title", F.coalesce("rewrite", "TITLE"))
        .drop("rewrite", "_title_key")
    )
