"""Table maintenance: snapshot in, snapshot out."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow import schemas
from tenderflow.functions import signals as S
from tenderflow.functions.identity import derive_identity_keys, present, probe_keys, stored_keys
from tenderflow.functions.text import is_email, parse_moment, text, trimmed
from tenderflow.operators.linkage import match_duplicates, ordered_greedy_dedup
from tenderflow.operators.listing import in_group
from tenderflow.operators.ordered import ALWAYS, NEVER, micros, replacing_rows
from tenderflow.operators.positions import next_ids
from tenderflow.operators.report import latest_error_per_source
from tenderflow.operators.resolve import resolve_master_source_id
from tenderflow.operators.screen import key_screen, likely_keys
from tenderflow.operators.skew import lookup_join
from tenderflow.session import cut_lineage, forget, stored


def _ts(at: dt.datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


# ---------------------------------------------------------------- live rows

def map_pending_to_live(
    pending: DataFrame,
    sources: DataFrame,
    master: DataFrame | None,
    *,
    now: dt.datetime,
    overrides: dict[str, Column] | None = None,
) -> DataFrame:
    """Pending rows as live rows: integer casts, overrides of reference ids, master source id, trimmed title, stamp.

    An override column wins over the row's value; a null override removes the value. `ID` stays null until assigned;
    the pending id travels along as `pending_id`.
    """
    live = schemas.schema("bid")
    base = pending.select(
        F.col("id").cast("bigint").alias("pending_id"),
        "source_listing_url",
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in live if f.name != "ID"],
    )
    for name, value in (overrides or {}).items():
        if name.upper() in schemas.REFERENCE_IDS:
            base = base.withColumn(name.upper(), value.try_cast("bigint"))
    hint = F.coalesce("source_listing_url", "URL")
    resolved = resolve_master_source_id(
        base.withColumn("_hint", trimmed(hint)), "BID_URL_ID", "_hint", sources, master, out="_master", from_source=False
    )
    return resolved.withColumns(
        {
            "BID_URL_ID": F.when(F.col("BID_URL_ID").isNotNull() & (F.col("_master") > 0), F.col("_master")).otherwise(
                F.col("BID_URL_ID")
            ),
            "TITLE": trimmed("TITLE"),
            "LAST_MODIFIED": _ts(now),
            "ID": F.lit(None).cast("bigint"),
        }
    ).select("pending_id", *[f.name for f in live])


def with_insert_defaults(rows: DataFrame) -> DataFrame:
    """Values a new live row gets where it has none: ids 0, inline URL 0, review flags 0, country us."""
    zero_ids = [
        "CATEGORYID", "ENTITYID", "SUBSCRIPTIONTYPEID", "USERID", "SETASIDECODEID", "BID_URL_ID", "NEEDS_REVIEW",
        "SOURCE_ID", "STATEID", "CATEGORY_ALIAS_ID", "UNDERREVIEW", "NAICSCODE_INT",
    ]
    return rows.fillna(0, subset=zero_ids).fillna({"INLINEURL": "0", "COUNTRY_ID": "us"})


def patch_live(live: DataFrame, patches: DataFrame) -> DataFrame:
    """Live rows with the non-null values of their patch. Null never clears, the id stays, empty text does overwrite.

    `patches` has one row per live ID. Reference ids are patched when present.
    """
    columns = [c for c in live.columns if c != "ID"]
    new = patches.select("ID", F.lit(True).alias("_patched"), *[F.col(c).alias(f"_new_{c}") for c in columns if c in patches.columns])
    joined = live.join(new, "ID", "left")
    merged = [
        F.coalesce(F.col(f"_new_{c}").try_cast(live.schema[c].dataType), F.col(c)).alias(c) if c in patches.columns else F.col(c)
        for c in columns
    ]
    return joined.select("ID", *merged).select(*live.columns)


class Promotion(NamedTuple):
    live: DataFrame
    pending: DataFrame
    outcomes: DataFrame


def _earlier_in_batch(rows: DataFrame) -> DataFrame:
    """For each row that was not kept the kept row of the batch it is a duplicate of: (id, target_id), target_id < id.

    `rows(id, probes, emits, kept)` with the keys as arrays.
    """
    index = (
        rows.where("kept").select(F.col("id").alias("first_id"), F.explode("emits").alias("key"))
        .groupBy("key")
        .agg(F.min("first_id").alias("first_id"))
    )
    probes = rows.where("NOT kept").select("id", F.explode("probes").alias("k")).select(
        "id", F.col("k.rank").alias("rank"), F.col("k.key").alias("key")
    )
    hits = lookup_join(probes, index, "key", ["first_id"]).where(F.col("first_id") < F.col("id"))
    best = hits.groupBy("id").agg(F.min(F.struct("rank", "first_id")).alias("b"))
    return best.select("id", F.col("b.first_id").alias("target_id"))


def _sharing_rows(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """Of the rows that have no match those with a key that another one has too, stored; all others stand alone in the batch.

    `rows(id, probes, emits)`. First only hashes are shuffled, to see which ones a probe and an emitted key of two rows have. A bit table of
    these then leaves out all other keys, and the rows without any, before keys are stored. Hashes that collide only keep a key more.
    """
    probes, names = F.transform("probes", lambda k: k["key"]), F.array_distinct(F.concat("_p", "emits"))
    every = rows.select(probes.alias("_p"), "emits").select(
        F.explode(F.transform(names, lambda k: F.struct(F.xxhash64(k).alias("h"), F.array_contains("_p", k).alias("p"), F.array_contains("emits", k).alias("e")))).alias("k")
    ).select("k.*")
    met = every.groupBy("h").agg(F.count("*").alias("n"), F.max("p").alias("p"), F.max("e").alias("e"))
    shared = stored(met.where("n > 1 AND p AND e").select("h"))
    screen = key_screen(shared, "h", hashed=True)
    told = rows.withColumn("_p", likely_keys("probes", screen, lambda k: k["key"])).withColumn("_e", likely_keys("emits", screen))
    told = told.where("_p <> 0 OR _e <> 0")

    def kept(keys: str, likely: str) -> Column:
        return F.filter(keys, lambda k, i: F.getbit(F.col(likely), i) == 1).alias(keys)

    out = stored(told.select("id", kept("probes", "_p"), kept("emits", "_e")).join(matched.select("id"), "id", "left_anti"))
    forget(shared)
    return out


def _patching_rows(rows: DataFrame, targets: DataFrame, now: dt.datetime, force: bool) -> DataFrame:
    """Ids of the rows that patch their target when all are applied in id order.

    `rows(id, target, own_bytes, own_at)`, `targets(target, bytes, at)`. A patch changes what later rows are compared with: a row
    patches when it is longer by over 50 bytes than what is there then, or newer.
    """
    if force:
        return rows.select("id")
    met = lookup_join(rows, targets, "target", ["bytes", "at"]).where(F.col("bytes").isNotNull())
    # A record without a time is never older, a row without one never newer.
    return replacing_rows(
        met.select(
            "id", "target", F.col("own_bytes").cast("bigint").alias("own_size"), F.coalesce(micros(F.col("own_at")), F.lit(NEVER)).alias("own_at"),
            F.col("bytes").cast("bigint").alias("size"), F.coalesce(micros(F.col("at")), F.lit(ALWAYS)).alias("at"),
        ),
        50, int(now.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + now.microsecond,
    )


def promote_pending(
    pending: DataFrame,
    live: DataFrame,
    sources: DataFrame,
    master: DataFrame | None,
    *,
    now: dt.datetime,
    source_id: int | None = None,
    force_patch: bool = False,
    few: bool = False,
) -> Promotion:
    """Move pending rows to the live table, as if in id order.

    A row that matches a live one, or an earlier inserted row of the batch, patches it when forced, when its
    description is over 50 bytes longer, or when it is newer; else it is skipped. The others are inserted. Rows with a
    blank title fail and stay pending. Keys are those of the snapshot: a patch does not change what later rows match. `few` says that the
    pending rows are few beside the live ones.
    """
    chosen = pending if source_id is None else pending.where(F.col("BID_URL_ID") == source_id)
    rows = chosen.withColumn("id", F.col("id").cast("bigint"))
    titled = trimmed("TITLE") != ""
    keyed = derive_identity_keys(rows)
    matched = cut_lineage(
        match_duplicates(keyed, "id", None, live, few=few, many=not few).select("id", F.col("record_id").alias("live_id"))
    )
    never = F.array().cast("array<string>")
    new_keys = keyed.select("id", present(probe_keys()).alias("probes"), F.when(titled, present(stored_keys())).otherwise(never).alias("emits"))
    new_rows = _sharing_rows(new_keys, matched)
    firsts = ordered_greedy_dedup(
        new_rows.select("id", F.transform("probes", lambda k: k["key"]).alias("probe_keys"), F.col("emits").alias("emit_keys")), "id"
    )
    in_batch = _earlier_in_batch(new_rows.join(firsts, "id"))

    target = cut_lineage(matched.select("id", F.concat(F.lit("L"), F.col("live_id")).alias("target")).unionByName(
        in_batch.select("id", F.concat(F.lit("P"), F.col("target_id")).alias("target"))
    ))
    forget(new_rows)
    facts = rows.select(
        "id",
        titled.alias("titled"),
        F.coalesce(F.octet_length(trimmed("DESCRIPTION")), F.lit(0)).alias("own_bytes"),
        F.coalesce("LAST_MODIFIED", "CREATED", "created_at").alias("own_at"),
    )
    inserted = target.where(F.col("target").startswith("P")).select("target", F.substring("target", 2, 30).cast("bigint").alias("id")).distinct()
    targets = live.select(
        F.concat(F.lit("L"), F.col("ID").cast("string")).alias("target"),
        F.octet_length(trimmed("DESCRIPTION")).alias("bytes"),
        F.coalesce("LAST_MODIFIED", "CREATED").alias("at"),
    ).unionByName(
        facts.join(inserted, "id").select("target", F.col("own_bytes").alias("bytes"), _ts(now).alias("at"))
    )
    patching = _patching_rows(
        facts.where("titled").join(target, "id").select("id", "target", "own_bytes", "own_at"),
        targets, now, force_patch,
    ).withColumn("patches", F.lit(True))
    outcome = (
        F.when(F.col("target").isNull() & F.col("titled"), "inserted")
        .when(F.col("target").isNull(), "failed")
        .when(F.col("patches"), "patched")
        .otherwise("skipped")
    )
    aimed = cut_lineage(target.join(patching, "id", "left"))
    outcomes = stored(facts.select("id", "titled").join(aimed, "id", "left").select("id", outcome.alias("outcome"), "target"))

    mapped = map_pending_to_live(rows, sources, master, now=now).drop("ID")
    told = outcomes.withColumnRenamed("id", "pending_id")
    # Only ids are put in order, whole rows are not.
    ids = next_ids(told.where(F.col("outcome") == "inserted").select("pending_id"), ["pending_id"], live, "ID", "ID")
    fresh = with_insert_defaults(mapped.join(ids, "pending_id"))
    own_id = ids.select(
        F.concat(F.lit("P"), F.col("pending_id").cast("string")).alias("target"), F.col("ID").alias("new_id")
    )
    decided = mapped.join(told.where(F.col("outcome") == "patched"), "pending_id")
    # Patches of one row apply in id order, so per column the last value given stays.
    columns = [c for c in schemas.schema("bid").names if c != "ID"]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pending_id"))).alias(c) for c in columns]
    folded = decided.groupBy("target").agg(*last).join(own_id, "target", "left")
    live_id = F.when(F.col("target").startswith("L"), F.substring("target", 2, 30).try_cast("bigint")).otherwise(F.col("new_id"))
    patches = folded.select(live_id.alias("ID"), *columns)
    whole = live.unionByName(schemas.conform(fresh.drop("pending_id"), live.schema))
    gone = outcomes.where(F.col("outcome") != "failed").select("id")
    return Promotion(patch_live(whole, patches), pending.join(gone, "id", "left_anti"), outcomes)


def approval_stats(outcomes: DataFrame) -> DataFrame:
    """Approved, already live (removed), failed."""
    kind = (
        F.when(F.col("outcome") == "inserted", "approved").when(F.col("outcome") == "failed", "failed").otherwise("duplicate")
    )
    return outcomes.groupBy(kind.alias("result")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sources

SOURCE_COLUMNS = [
    "url", "name", "start_time", "end_time", "weight", "user_id", "check_changes", "visit_required", "checksum",
    "valid", "third_party_url_id", "last_scraped_at",
]


class Sources(NamedTuple):
    sources: DataFrame
    failed: DataFrame
    outcomes: DataFrame


def quarantine_failed(sources: DataFrame, failed: DataFrame, logs: DataFrame) -> Sources:
    """Move sources whose latest error is newer than their last scrape (or that never were scraped) to the failed list.

    One failed row per URL: an existing one is overwritten and keeps its id. Of several sources with one URL the
    highest id stays. New failed rows get ids after the highest.
    """
    latest = latest_error_per_source(logs).select(
        F.col("bid_url_id").alias("id"), F.col("message").alias("failure_message"), F.col("created_at").alias("failed_at")
    )
    hit = sources.join(latest, "id").where(
        F.col("last_scraped_at").isNull() | (F.col("failed_at") > F.col("last_scraped_at"))
    )
    columns = ["original_bid_url_id", *SOURCE_COLUMNS, "failure_message", "failed_at"]
    moved = hit.select(F.col("id").alias("original_bid_url_id"), *columns[1:])
    per_url = moved.groupBy("url").agg(F.max_by(F.struct(*columns), "original_bid_url_id").alias("m"))
    known = failed.groupBy("url").agg(F.min("id").alias("known_id"))
    placed = per_url.join(known, "url", "left").select("known_id", "m.*")
    added = next_ids(
        placed.where(F.col("known_id").isNull()).drop("known_id"), ["original_bid_url_id"], failed, "id", "id"
    ).select("id", *columns)
    updated = placed.where(F.col("known_id").isNotNull()).select(F.col("known_id").alias("id"), *columns)
    untouched = failed.join(updated.select("id"), "id", "left_anti").select("id", *columns)
    new_failed = untouched.unionByName(updated).unionByName(added)
    remaining = sources.join(moved.select(F.col("original_bid_url_id").alias("id")), "id", "left_anti")
    outcomes = moved.select(F.col("original_bid_url_id").alias("id"), F.lit("quarantined").alias("outcome"))
    return Sources(remaining, new_failed, outcomes)


def restore_failed(
    sources: DataFrame, failed: DataFrame, *, default_group: str = S.DEFAULT_GROUP
) -> Sources:
    """Return failed sources to the active list in id order.

    A URL already active in the default group is only removed from the failed list; a name clash is skipped and stays;
    the others come back in the default group. A row restored earlier in the run counts as active.
    """
    active = in_group(sources, default_group)
    urls = active.select("url").where(F.col("url").isNotNull()).distinct().withColumn("url_active", F.lit(True))
    names = active.select("name").where(text("name") != "").distinct().withColumn("name_active", F.lit(True))
    listed = lookup_join(failed.select(F.col("id").cast("bigint").alias("id"), "url", "name"), urls, "url", ["url_active"])
    marked = lookup_join(listed, names, "name", ["name_active"])
    url_key = F.concat(F.lit("u|"), text("url"))
    name_key = F.when(text("name") != "", F.concat(F.lit("n|"), F.col("name")))
    both = F.filter(F.array(url_key, name_key), lambda k: k.isNotNull())
    open_rows = marked.where(F.col("url_active").isNull() & F.col("name_active").isNull())
    firsts = ordered_greedy_dedup(
        open_rows.select("id", both.alias("probe_keys"), both.alias("emit_keys")), "id"
    )
    back = firsts.where("kept").select("id")
    # Why a row did not come back: a restored row with its URL and a smaller id makes it already active.
    restored_urls = open_rows.join(back, "id").groupBy("url").agg(F.min("id").alias("first_id"))
    staged = lookup_join(
        marked.join(firsts, "id", "left"), restored_urls.select("url", "first_id"), "url", ["first_id"]
    )
    outcome = (
        F.when(F.col("url_active"), "already_active")
        .when(F.coalesce("kept", F.lit(False)), "restored")
        .when(F.coalesce(F.col("first_id") < F.col("id"), F.lit(False)), "already_active")
        .otherwise("skipped")
    )
    outcomes = staged.select("id", outcome.alias("outcome"))
    coming = failed.join(outcomes.where(F.col("outcome") == "restored").select("id"), "id", "left_semi")
    numbered = next_ids(coming.withColumnRenamed("id", "_failed_id"), ["_failed_id"], sources, "id", "id")
    added = numbered.select("id", *SOURCE_COLUMNS, F.lit(default_group).alias("scrape_group"))
    new_sources = sources.unionByName(schemas.conform(added, sources.schema, fill=True))
    gone = outcomes.where(F.col("outcome") != "skipped").select("id")
    return Sources(new_sources, failed.join(gone, "id", "left_anti"), outcomes)


def restore_marks(last_scraped: Column, end_time: Column, *, dedicated: bool) -> tuple[Column, Column]:
    """(last_scraped_at, end_time) of a restored source. Without a dedicated column the mark fills an empty end time."""
    if dedicated:
        return last_scraped, end_time
    return F.lit(None).cast("timestamp_ntz"), F.coalesce(end_time, last_scraped)


class Visits(NamedTuple):
    sources: DataFrame
    failed: DataFrame
    history: DataFrame


def finish_visits(sources: DataFrame, failed: DataFrame, history: DataFrame, visits: DataFrame) -> Visits:
    """Apply a batch of finished visits `(bid_url_id, start_time, end_time, user_id)`.

    Each source, and each failed row that came from it, takes the times of its last visit; every visit is one
    history row. The last visit is an arg-max aggregate, so many visits of one source combine per task.
    """
    valid = visits.where(F.col("bid_url_id") > 0)
    last = valid.groupBy("bid_url_id").agg(
        F.max_by(F.struct("start_time", "end_time"), F.struct("end_time", "start_time")).alias("v")
    ).select(F.col("bid_url_id").alias("_id"), F.col("v.start_time").alias("_s"), F.col("v.end_time").alias("_e"))

    def stamped(df: DataFrame, ident: str) -> DataFrame:
        j = df.join(last, F.col(ident) == F.col("_id"), "left")
        hit = F.col("_id").isNotNull()
        return j.withColumns(
            {
                "start_time": F.when(hit, F.col("_s")).otherwise(F.col("start_time")),
                "end_time": F.when(hit, F.col("_e")).otherwise(F.col("end_time")),
                "last_scraped_at": F.when(hit, F.col("_e")).otherwise(F.col("last_scraped_at")),
            }
        ).select(*df.columns)

    added = next_ids(valid, ["end_time", "bid_url_id", "start_time", "user_id"], history, "id", "id")
    return Visits(
        stamped(sources, "id"), stamped(failed, "original_bid_url_id"), history.unionByName(added.select(*history.columns))
    )


def set_last_scraped(sources: DataFrame, *, at: dt.datetime | None, group: str = "") -> DataFrame:
    """Set the mark of all sources of a group, or clear it with `at=None`; an empty group means all."""
    g = group.strip()
    mine = (F.col("scrape_group") == g) if g else F.lit(True)
    mark = _ts(at) if at is not None else F.lit(None).cast("timestamp_ntz")
    return sources.withColumn("last_scraped_at", F.when(mine, mark).otherwise(F.col("last_scraped_at")))


def backfill_group(sources: DataFrame, default: str = S.DEFAULT_GROUP) -> DataFrame:
    return sources.withColumn("scrape_group", F.when(text("scrape_group") == "", default).otherwise(F.col("scrape_group")))


def reject_pending(pending: DataFrame, source_id: int | None = None) -> DataFrame:
    """What stays after rejecting the pending rows of a source, or all of them."""
    if source_id is None:
        return pending.limit(0)
    return pending.where(F.coalesce(F.col("BID_URL_ID") != source_id, F.lit(True)))


def clear_issues(logs: DataFrame) -> DataFrame:
    return logs.limit(0)


# ---------------------------------------------------------------- validation

def validate_records(rows: DataFrame, directory: DataFrame | None = None, *, url_limit: int = 2048, current_user: str | None = None) -> DataFrame:
    """Rows with blank optional fields as null, ids as integers, and an `errors` array.

    `directory(id)` limits the assignee; the current assignee in column `current_user` stays allowed. The input holds
    text; columns that are missing are not checked.
    """
    have = set(rows.columns)
    out, numbers = rows, {}
    for c in ("DESCRIPTION", "EMAIL", "URL", "NAICSCODE", "SOLICITATIONNUMBER", "THIRD_PARTY_IDENTIFIER", "NSN",
              "INLINEURL", "COUNTRY_ID", "ENDDATE", "FEDDATE", "CREATED", "LAST_MODIFIED"):
        if c in have:
            out = out.withColumn(c, F.when(text(c) != "", F.col(c)))
    checks = [F.when(trimmed("TITLE") == "", "title_missing"),
              F.when(F.char_length(text("TITLE")) > 255, "title_too_long")]
    if "EMAIL" in have:
        checks.append(F.when(F.col("EMAIL").isNotNull() & (~is_email(F.col("EMAIL")) | (F.char_length("EMAIL") > 255)), "email_invalid"))
    for c, n in (("URL", url_limit), ("NAICSCODE", 255), ("SOLICITATIONNUMBER", 255), ("THIRD_PARTY_IDENTIFIER", 255),
                 ("NSN", 255), ("INLINEURL", 500), ("COUNTRY_ID", 32)):
        if c in have:
            checks.append(F.when(F.char_length(F.col(c)) > n, f"{c.lower()}_too_long"))
    for c, label in (("ENDDATE", "enddate_not_a_date"), ("FEDDATE", "feddate_not_a_date"), ("CREATED", "created_not_a_time"), ("LAST_MODIFIED", "last_modified_not_a_time")):
        if c in have:
            checks.append(F.when(F.col(c).isNotNull() & parse_moment(c).isNull(), label))
    for c in ("CATEGORYID", "ENTITYID", "SUBSCRIPTIONTYPEID", "USERID", "SETASIDECODEID", "BID_URL_ID", "SOURCE_ID",
              "STATEID", "CATEGORY_ALIAS_ID", "NAICSCODE_INT"):
        if c in have:
            given = trimmed(c)
            number = F.when(given.rlike(r"^[+-]?\d+$"), given.try_cast("bigint"))
            checks.append(F.when((given != "") & number.isNull(), f"{c.lower()}_not_a_number"))
            numbers[c] = number
    if directory is not None and "USERID" in have:
        allowed = directory.select(F.col("id").cast("bigint").alias("_allowed")).distinct()
        keyed = out.withColumn("_user", numbers["USERID"].cast("string"))
        known = allowed.select(F.col("_allowed").cast("string").alias("_user"), F.lit(True).alias("_known"))
        out = lookup_join(keyed, known, "_user", ["_known"]).drop("_user")
        same = F.coalesce(F.col(current_user).cast("bigint") == numbers["USERID"], F.lit(False)) if current_user else F.lit(False)
        checks.append(
            F.when(numbers["USERID"].isNotNull() & F.col("_known").isNull() & ~same,
                   "assignee_not_in_directory")
        )
    # The checks read the texts as given, so the errors come before the ids become integers.
    return out.withColumn("errors", F.array_compact(F.array(*checks))).drop("_known").withColumns(numbers)

