"""The save path of extracted solicitations, and batches of manual entries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow import schemas
from tenderflow.functions.contact import resolve_contact_email
from tenderflow.functions.description import clean_description
from tenderflow.functions.identity import derive_identity_keys, fingerprint_keys, present, probe_key_names, stored_keys
from tenderflow.functions.naics import normalize_naics
from tenderflow.functions.names import category_hint, state_hint, text_organizations
from tenderflow.functions.records import apply_ingest_defaults, classify_text, judged_by_keys
from tenderflow.functions.text import is_empty, parse_day, text, trimmed
from tenderflow.functions.titles import corporate_prefix
from tenderflow.operators.curate import Promotion, finish_visits, promote_pending
from tenderflow.operators.linkage import match_duplicates, ordered_greedy_dedup
from tenderflow.operators.listing import not_expired
from tenderflow.operators.positions import next_ids, numbered_in_order
from tenderflow.operators.resolve import (
    apply_title_rewrites,
    resolve_category,
    resolve_entity,
    resolve_master_source_id,
    resolve_saved_url,
    resolve_state,
)
from tenderflow.session import cut_lineage
from tenderflow.sources.files import parse_model_responses


class Ingest:
    """The outcome of every extracted row, and the new pending rows, whose references are resolved when they are first asked for."""

    def __init__(self, outcomes: DataFrame, make_saved: Callable[[], DataFrame]):
        self.outcomes = outcomes
        self._make_saved = make_saved

    @cached_property
    def saved(self) -> DataFrame:
        return self._make_saved()


def _given(c: str) -> Column:
    """A text that was really given, else null."""
    t = trimmed(c)
    return F.when((t != "") & (F.lower(t) != "not provided"), t)


def _in_listing(keys: Column, listing: str) -> Column:
    """Run keys hold within one listing."""
    return F.transform(keys, lambda k: F.concat_ws("\u0001", F.lit("run"), F.col(listing), k))


#: What tells an extracted row from all others, but for rows of equal responses.
ROW = ["source_id", "listing_url", "pos", "row_hash"]


def extracted_rows(responses: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """Extracted rows with display title and clean description, under a key that a second reading finds again."""
    hashed = responses.withColumn("row_hash", F.xxhash64("raw_json", "page_text", "pdf_text"))
    extracts = parse_model_responses(hashed, ("row_hash",))
    if rewrites is None:
        titled = extracts.withColumn("display_title", F.col("TITLE"))
    else:
        titles = apply_title_rewrites(extracts.select(*ROW, "TITLE"), rewrites).dropDuplicates(ROW)
        titled = with_row(extracts, titles, ["display_title"])
    # A column of its own, so that it is made once and then looked at.
    cleaned = titled.withColumn("display_title", corporate_prefix("display_title", "POSTING_ENTITY")).withColumn("DESCRIPTION", clean_description("DESCRIPTION"))
    return cleaned.withColumn(
        "DESCRIPTION", F.when(is_empty("DESCRIPTION") & ~is_empty("pdf_text"), F.col("pdf_text")).otherwise(F.col("DESCRIPTION"))
    )


def with_row(rows: DataFrame, more: DataFrame, columns: list[str]) -> DataFrame:
    """Add columns of another frame with one row for each key of an extracted row."""
    other = more.select(*[F.col(c).alias(f"_{c}") for c in ROW], *columns)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ROW]
    return rows.join(other, same, "left").drop(*[f"_{c}" for c in ROW])


def text_facts(extracts: DataFrame, now: dt.datetime) -> DataFrame:
    """All that later steps need of the texts: industry code, verdict, e-mail, hints. No text goes on from here."""
    return extracts.select(
        *ROW, "TITLE", "display_title", "URL", "ENDDATE", "NAICSCODE", "SOLICITATIONNUMBER", "THIRD_PARTY_IDENTIFIER", "ISSUING_ORGANIZATION",
        (~not_expired("ENDDATE", now.date())).alias("expired"),
        normalize_naics("NAICSCODE", "DESCRIPTION", "display_title", "listing_url").alias("naics"),
        classify_text("display_title", "DESCRIPTION", "listing_url", parse_day("ENDDATE")).alias("by_text"),
        resolve_contact_email("CONTACT_EMAIL", "DESCRIPTION").alias("EMAIL"),
        text_organizations("display_title", "DESCRIPTION").alias("labelled"),
        state_hint("LOCATION_STATE", "display_title", "DESCRIPTION").alias("state_hint"),
        category_hint("BID_CATEGORY", "display_title", "DESCRIPTION").alias("category_hint"),
    )


def normalize_facts(
    facts: DataFrame, sources: DataFrame, master: DataFrame | None, *, pages: DataFrame | None = None, project_key_from: str = "normalized"
) -> DataFrame:
    """Facts with saved URL, master source id and identity keys.

    `project_key_from='raw'` takes the project number from the field as given, not from the normalized code.
    """
    saved = resolve_saved_url(facts, pages)
    placed = resolve_master_source_id(saved, "source_id", "listing_url", sources, master, out="BID_URL_ID")
    return derive_identity_keys(
        placed,
        url="saved_url",
        title="display_title",
        raw_title="TITLE",
        naics="naics" if project_key_from == "normalized" else "NAICSCODE",
        end="ENDDATE",
    )


def ingest_extracts(
    responses: DataFrame,
    sources: DataFrame,
    master: DataFrame | None,
    pending: DataFrame,
    live: DataFrame,
    entities: DataFrame,
    states: DataFrame,
    categories: DataFrame,
    *,
    now: dt.datetime,
    rewrites: DataFrame | None = None,
    pages: DataFrame | None = None,
    assignee: int | None = None,
    directory: DataFrame | None = None,
    require_end: bool = True,
    project_key_from: str = "normalized",
) -> Ingest:
    """Responses to new pending rows, with the outcome of every extracted row: saved, duplicate, rejected, expired.

    Rows are decided as if read in order of source, listing and place: a saved row blocks later ones by its run
    keys within the listing, and by the table keys across listings. A first reading of the responses leaves narrow facts, on which all is
    decided; a second one brings the texts to the saved rows, the only time that texts are shuffled.
    """
    extracts = extracted_rows(responses, rewrites)
    dated = numbered_in_order(cut_lineage(text_facts(extracts, now)), ROW, "row_no")
    normalized = normalize_facts(dated.where(~F.col("expired")), sources, master, pages=pages, project_key_from=project_key_from)
    verdict = judged_by_keys(F.col("by_text"), parse_day("ENDDATE"), F.col("has_tier_a"), require_end=require_end)
    judged = normalized.withColumns({"verdict": verdict, "blank": text("TITLE").isin("", "0")}).drop("by_text")
    judged = cut_lineage(judged)
    matched = match_duplicates(judged.where(~F.col("blank")), "row_no", pending, live, few=True)
    checked = cut_lineage(judged.join(matched, "row_no", "left"))

    open_rows = checked.where(~F.col("blank") & F.col("tier").isNull())
    # Stored keys are those of the row as it would be saved, with its normalized code.
    keyed = open_rows.withColumn("NAICSCODE", F.col("naics"))
    run_keys = _in_listing(fingerprint_keys(), "listing_url")
    never = F.array().cast("array<string>")
    emitted = F.array_union(run_keys, present(stored_keys()))
    firsts = ordered_greedy_dedup(
        keyed.select(
            "row_no",
            F.array_union(run_keys, probe_key_names()).alias("probe_keys"),
            F.when(F.col("verdict.is_bid"), emitted).otherwise(never).alias("emit_keys"),
        ),
        "row_no",
    )
    outcome = (
        F.when(F.col("blank"), "rejected")
        .when(F.col("tier").isNotNull(), "duplicate")
        .when(~F.col("kept"), "duplicate")
        .when(F.col("verdict.is_bid"), "saved")
        .otherwise("rejected")
    )
    reason = (
        F.when(F.col("blank"), "blank_title")
        .when(F.col("tier").isNotNull(), F.concat_ws(":", "match_table", "reason"))
        .when(~F.col("kept"), "in_run")
        .otherwise(F.col("verdict.reason"))
    )
    decided = checked.join(firsts, "row_no", "left").withColumn("outcome", outcome).withColumn("why", reason)
    kept = decided.where(F.col("outcome") == "saved")
    outcomes = decided.select("row_no", "listing_url", "source_id", "pos", "outcome", "why").unionByName(
        dated.where("expired").select(
            "row_no", "listing_url", "source_id", "pos", F.lit("expired").alias("outcome"), F.lit("expired").alias("why")
        )
    )
    return Ingest(outcomes, lambda: _as_pending(kept, extracts, sources, entities, states, categories, pending, now, assignee, directory))


def _as_pending(kept, extracts, sources, entities, states, categories, pending, now, assignee, directory) -> DataFrame:
    """Saved extracts as pending rows, reference ids resolved and new ids given; their texts join at the end."""
    names = sources.select(F.col("id").cast("bigint").alias("source_id"), F.col("name").alias("bid_url_name"))
    base = kept.join(names, "source_id", "left").select(
        "row_no",
        *ROW,
        F.col("display_title").alias("TITLE"),
        "EMAIL",
        F.col("saved_url").alias("URL"),
        F.col("end_day").cast("timestamp_ntz").alias("ENDDATE"),
        F.col("naics").alias("NAICSCODE"),
        _given("SOLICITATIONNUMBER").alias("SOLICITATIONNUMBER"),
        _given("THIRD_PARTY_IDENTIFIER").alias("THIRD_PARTY_IDENTIFIER"),
        "BID_URL_ID",
        F.col("listing_url").alias("source_listing_url"),
        "bid_url_name",
        "ISSUING_ORGANIZATION",
        "labelled",
        "state_hint",
        "category_hint",
    )
    base = cut_lineage(base)
    entity = resolve_entity(base, "row_no", entities, labelled="labelled").select("row_no", F.col("entity_id").alias("ENTITYID"))
    state = resolve_state(base, "row_no", "state_hint", states).withColumnRenamed("state_id", "STATEID")
    category = resolve_category(base, "row_no", "category_hint", categories).withColumnRenamed("category_id", "CATEGORYID")
    filled = base.join(entity, "row_no", "left").join(state, "row_no", "left").join(category, "row_no", "left")
    numbered = next_ids(filled, ["row_no"], pending, "id", "id")
    # Rows of equal responses have equal texts.
    texts = extracts.select(*ROW, "DESCRIPTION").dropDuplicates(ROW)
    stamped = apply_ingest_defaults(with_row(numbered, texts, ["DESCRIPTION"]), now=now, assignee=assignee, directory=directory)
    dated = stamped.withColumn("created_at", F.lit(now).cast("timestamp_ntz")).withColumn("updated_at", F.col("created_at"))
    return schemas.conform(dated, schemas.schema("bids_temp"), fill=True)


class ManualBatch(NamedTuple):
    outcomes: DataFrame
    pending: DataFrame
    promotion: Promotion | None
    visits: tuple


def manual_bid_batch(
    entries: DataFrame,
    sources: DataFrame,
    failed: DataFrame,
    history: DataFrame,
    master: DataFrame | None,
    pending: DataFrame,
    live: DataFrame,
    *,
    now: dt.datetime,
) -> ManualBatch:
    """Save manual entries as pending rows or straight to live, and finish their visits.

    `entries` holds the bid columns plus `entry_id, source_id, listing_url, approve, actor_user_id, start_time`. Duplicates are
    not saved and leave no visit. Entries of one batch are checked against the tables and against each other, in order.
    """
    at = F.lit(now).cast("timestamp_ntz")
    own = sources.select(
        F.col("id").cast("bigint").alias("source_id"), F.col("url").alias("source_url"), F.col("name").alias("source_name"),
        F.lit(True).alias("known_source"),
    )
    placed = entries.withColumn("source_id", F.col("source_id").cast("bigint")).join(own, "source_id", "left")
    hint = F.coalesce("listing_url", "source_url")
    resolved = resolve_master_source_id(
        placed.withColumn("_hint", text(hint)), "source_id", "_hint", sources, master, out="BID_URL_ID"
    )
    rows = resolved.withColumns(
        {
            "source_listing_url": F.when(F.col("known_source"), F.col("source_url")).otherwise(
                trimmed(F.coalesce("listing_url", "URL"))
            ),
            "bid_url_name": F.col("source_name"),
            "CREATED": at,
            "LAST_MODIFIED": at,
            "SUBSCRIPTIONTYPEID": F.lit(10).cast("bigint"),
            "SETASIDECODEID": F.lit(1).cast("bigint"),
            "created_at": at,
            "updated_at": at,
            "BID_URL_ID": F.when(F.col("known_source"), F.col("BID_URL_ID")),
        }
    )
    keyed = cut_lineage(derive_identity_keys(rows))
    matched = match_duplicates(keyed, "entry_id", pending, live, few=True).select("entry_id", "tier", "reason")
    open_rows = keyed.join(matched, "entry_id", "left_anti")
    firsts = ordered_greedy_dedup(
        open_rows.select("entry_id", probe_key_names().alias("probe_keys"), present(stored_keys()).alias("emit_keys")),
        "entry_id",
    )
    fresh = keyed.join(firsts.where("kept").select("entry_id"), "entry_id", "left_semi")
    numbered = cut_lineage(next_ids(fresh, ["entry_id"], pending, "id", "id"))
    shape = schemas.schema("bids_temp")
    new_pending = pending.unionByName(
        schemas.conform(numbered.where(~F.col("approve")), pending.schema, fill=True)
    )
    straight = schemas.conform(numbered.where("approve"), shape, fill=True)
    promotion = promote_pending(straight, live, sources, master, now=now, few=True)
    approved = numbered.where("approve").select("entry_id", "id").join(
        promotion.outcomes.select("id", F.col("outcome").alias("promoted")), "id", "left"
    )
    outcome = (
        F.when(F.col("kept").isNull() | ~F.col("kept"), "duplicate")
        .when(~F.col("approve"), "pending")
        .when(F.col("promoted") == "inserted", "approved")
        .when(F.col("promoted") == "failed", "failed")
        .otherwise("duplicate")
    )
    outcomes = (
        keyed.select("entry_id", "approve")
        .join(firsts, "entry_id", "left")
        .join(approved.select("entry_id", "promoted"), "entry_id", "left")
        .select("entry_id", outcome.alias("outcome"))
    )
    done = numbered.where("known_source").select(
        F.col("source_id").alias("bid_url_id"), "start_time", at.alias("end_time"),
        F.col("actor_user_id").cast("bigint").alias("user_id"),
    )
    return ManualBatch(outcomes, new_pending, promotion, finish_visits(sources, failed, history, done))
