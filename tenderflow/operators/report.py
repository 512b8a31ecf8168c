"""Reports: user activity, run summary, counts, and the window queries behind them."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import signals as S
from tenderflow.functions.text import text, trimmed, whole_id
from tenderflow.functions.titles import entity_label, source_label, state_label


def report_range(
    now: dt.datetime, start: dt.date | None = None, end: dt.date | None = None, zone: str = S.DIRECTORY_ZONE
) -> tuple[dt.datetime, dt.datetime]:
    """Bounds of a report in UTC, the upper one exclusive: the month of `now` unless given; swapped when reversed.

    `now` is UTC. Days begin at midnight of the report zone.
    """
    tz = ZoneInfo(zone)
    local = now.replace(tzinfo=dt.timezone.utc).astimezone(tz)
    first = local.date().replace(day=1)
    last = (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    lo, hi = start or first, end or last
    if lo > hi:
        lo, hi = hi, lo

    def utc(day: dt.date) -> dt.datetime:
        at = dt.datetime.combine(day, dt.time(), tzinfo=tz)
        return at.astimezone(dt.timezone.utc).replace(tzinfo=None)

    return utc(lo), utc(hi + dt.timedelta(days=1))


def today_range(now: dt.datetime, zone: str = S.DIRECTORY_ZONE) -> tuple[dt.datetime, dt.datetime]:
    day = now.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(zone)).date()
    return report_range(now, day, day, zone)


def _within(c: str, bounds: tuple[dt.datetime, dt.datetime]) -> Column:
    lo, hi = (F.lit(b).cast("timestamp_ntz") for b in bounds)
    return (F.col(c) >= lo) & (F.col(c) < hi)


def user_activity_report(
    users: DataFrame,
    bids: DataFrame,
    visits: DataFrame,
    *,
    period: tuple[dt.datetime, dt.datetime],
    today: tuple[dt.datetime, dt.datetime],
) -> DataFrame:
    """Per directory user: bids added and sources visited in the period, bids added today; then the totals row.

    Bids are read once for both counts. Both counts are combined per task before the shuffle, so a user with
    very many rows is one row per task. `users` is a directory: (id, label).
    """
    added, now = _within("CREATED", period), _within("CREATED", today)
    per_user = (
        bids.where((added | now) & F.col("USERID").isNotNull())
        .groupBy(F.col("USERID").cast("bigint").alias("user_id"))
        .agg(F.count_if(added).alias("bids_added"), F.count_if(now).alias("bids_today"))
    )
    seen = (
        visits.where(_within("start_time", period) & F.col("user_id").isNotNull())
        .groupBy(F.col("user_id").cast("bigint").alias("user_id"))
        .agg(F.count("*").alias("urls_visited"))
    )
    named = users.where(F.col("id") > 0).select(F.col("id").cast("bigint").alias("user_id"), "label")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("bids_added", "urls_visited", "bids_today")]
    rows = named.join(per_user, "user_id", "left").join(seen, "user_id", "left").select("user_id", "label", *counts)
    # One composite key, so the rollup yields the user rows and the grand total only.
    summed = rows.rollup(F.struct("user_id", "label").alias("who")).agg(
        F.grouping_id().alias("is_total"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("bids_added", "urls_visited", "bids_today")],
    )
    return (
        summed.select(
            F.when(F.col("is_total") == 0, "user").otherwise("total").alias("row_type"),
            F.col("who.user_id").alias("user_id"),
            F.when(F.col("is_total") == 0, F.col("who.label")).otherwise("Total").alias("label"),
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("bids_added", "urls_visited", "bids_today")],
        )
        .orderBy(F.desc("row_type"), F.desc("bids_added"), F.lower("label"), "user_id")
    )


def entity_options(entities: DataFrame, names: list[str] = ["name"], emails: list[str] = ["email"]) -> DataFrame:
    return entities.select(F.col("id").cast("bigint").alias("id"), entity_label("id", names, emails).alias("label"))


def state_options(states: DataFrame) -> DataFrame:
    return states.select(F.col("id").cast("bigint").alias("id"), state_label("name", "abbreviation").alias("label")).where(
        F.col("label").isNotNull()
    )


def source_options(master: DataFrame) -> DataFrame:
    return master.select(F.col("ID").cast("bigint").alias("id"), source_label("NAME", "URL").alias("label")).where(
        F.col("label").isNotNull()
    )


def attach_report_labels(rows: DataFrame, entities: DataFrame, states: DataFrame, master: DataFrame) -> DataFrame:
    """Add entity, state and source labels: `X #id` when the id is unknown, a dash when there is none."""
    out = rows
    for options, ident, name, unknown in (
        (entity_options(entities), "ENTITYID", "entity", "Entity #"),
        (state_options(states), "STATEID", "state", "State #"),
        (source_options(master), "BID_URL_ID", "bid_url", "Bid URL #"),
    ):
        side = options.select(F.col("id").alias(f"_{name}_id"), F.col("label").alias(f"_{name}_label"))
        wanted = F.when(whole_id(ident) > 0, whole_id(ident))
        out = out.join(side, wanted == F.col(f"_{name}_id"), "left")
        label = F.coalesce(f"_{name}_label", F.concat(F.lit(unknown), wanted.cast("string")), F.lit("—"))
        out = out.withColumn(name, label).drop(f"_{name}_id", f"_{name}_label")
    return out


def bids_added_listing(
    bids: DataFrame,
    users: DataFrame,
    entities: DataFrame,
    states: DataFrame,
    master: DataFrame,
    *,
    period: tuple[dt.datetime, dt.datetime],
    user_id: int = 0,
    zone: str = S.DIRECTORY_ZONE,
) -> DataFrame:
    """Bids added in the period by one user or by every directory user, newest first, with labels."""
    kept = bids.where(_within("CREATED", period)).select(
        "ID", "TITLE", "ENTITYID", "STATEID", "BID_URL_ID", "CREATED", F.col("USERID").cast("bigint").alias("USERID")
    )
    if user_id > 0:
        kept = kept.where(F.col("USERID") == user_id)
    else:
        kept = kept.join(
            users.where(F.col("id") > 0).select(F.col("id").cast("bigint").alias("USERID")), "USERID", "left_semi"
        )
    labelled = attach_report_labels(kept, entities, states, master)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("CREATED"))
    return labelled.select(
        F.col("ID").cast("bigint").alias("id"),
        text("TITLE").alias("title"),
        "entity",
        "bid_url",
        "state",
        F.date_format("CREATED", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created"),
        F.date_format(local, "MMM d, yyyy").alias("created_display"),
    ).orderBy(F.desc("created"), F.desc("id"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Per source URL and overall: extracted, kept by date, expired, saved, duplicate, rejected, and the message.

    `outcomes(url, outcome)` with outcome in saved, duplicate, rejected, expired.
    """
    def n(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names)).cast("bigint")

    counted = outcomes.rollup("url").agg(
        F.grouping("url").alias("is_total"),
        n("saved", "duplicate", "rejected", "expired").alias("extracted"),
        n("saved", "duplicate", "rejected").alias("after_date_filter"),
        n("expired").alias("expired"),
        n("saved").alias("saved"),
        n("duplicate").alias("duplicates"),
        n("rejected").alias("rejected"),
    )
    message = (
        F.when(F.col("is_total") == 1, None)
        .when(F.col("saved") > 0, None)
        .when(F.col("duplicates") > 0, F.concat(F.col("duplicates"), F.lit(" already pending or live — check Pending Approval")))
        .when(F.col("rejected") > 0, "missing end date or weak bid signals")
        .when(F.col("extracted") == 0, "AI returned no bids")
        .when((F.col("expired") > 0) & (F.col("after_date_filter") == 0), F.concat(F.col("expired"), F.lit(" expired (filtered out)")))
    )
    issue = F.when(
        (F.col("is_total") == 0) & (F.col("saved") == 0) & (F.col("duplicates") == 0),
        F.when(F.col("rejected") > 0, "No bids found. Please check the URL.").otherwise("No bids found."),
    )
    return counted.withColumn("message", message).withColumn("issue", issue)


def issue_counts(logs: DataFrame) -> DataFrame:
    """Issues by level, and all of them."""
    return logs.rollup("level").agg(F.grouping("level").alias("is_total"), F.count("*").alias("issues")).select(
        F.when(F.col("is_total") == 1, "all").otherwise(F.col("level")).alias("level"), "issues"
    )


def dashboard_counts(logs: DataFrame, pending: DataFrame, master: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: issues, pending bids, unassigned and failed sources."""
    named = [
        ("issues", logs),
        ("pending", pending),
        ("unassigned", master.where(F.coalesce("USER_ID", F.lit(0)) == 0)),
        ("failed", failed),
    ]
    parts = [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for w, df in named]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w, _ in named])


def distinct_groups(sources: DataFrame, default: str = S.DEFAULT_GROUP) -> DataFrame:
    """Scrape groups in use and the default one, without repeats, in case-insensitive order."""
    used = sources.select(trimmed("scrape_group").alias("scrape_group"))
    always = sources.sparkSession.range(1).select(F.lit(default).alias("scrape_group"))
    return (
        used.unionByName(always)
        .where(F.col("scrape_group") != "")
        .distinct()
        .orderBy(F.lower("scrape_group"), "scrape_group")
    )


def outcome_stats(outcomes: DataFrame, column: str = "outcome") -> DataFrame:
    return outcomes.groupBy(column).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- latest per source

def latest_user_per_source(visits: DataFrame) -> DataFrame:
    """User of the latest visit per source: last end, then last start, then highest id.

    An arg-max aggregate: it combines per task, so a source with very many visits never meets one task whole.
    """
    known = visits.where((F.col("USER_ID").isNotNull()) & (F.col("USER_ID") != 0) & (F.col("BID_URL_ID") > 0))
    order = F.struct(
        F.col("END_TIME").isNotNull(), F.col("END_TIME"), F.col("START_TIME").isNotNull(), F.col("START_TIME"), F.col("ID")
    )
    return known.groupBy(F.col("BID_URL_ID").cast("bigint").alias("bid_url_id")).agg(
        F.max_by(F.col("USER_ID").cast("bigint"), order).alias("user_id")
    )


def latest_error_per_source(logs: DataFrame) -> DataFrame:
    """Latest error of each source, by time and then id."""
    errors = logs.where((F.col("level") == "error") & F.col("bid_url_id").isNotNull())
    latest = errors.groupBy("bid_url_id").agg(
        F.max_by(F.struct("id", "message", "created_at"), F.struct(F.col("created_at").isNotNull(), "created_at", "id")).alias("l")
    )
    return latest.select(
        F.col("bid_url_id").cast("bigint").alias("bid_url_id"),
        F.col("l.id").alias("log_id"),
        F.col("l.message").alias("message"),
        F.col("l.created_at").alias("created_at"),
    )


def assign_sources_from_history(master: DataFrame, visits: DataFrame) -> DataFrame:
    """The master table with unassigned sources given to the user of their latest visit, and the outcome of each."""
    latest = latest_user_per_source(visits).select(F.col("bid_url_id").alias("_source"), F.col("user_id").alias("_user"))
    joined = master.join(latest, F.col("ID").cast("bigint") == F.col("_source"), "left")
    is_open = F.coalesce("USER_ID", F.lit(0)) == 0
    found = F.col("_user") > 0
    outcome = F.when(is_open & found, "assigned").when(is_open, "skipped_no_history").otherwise("unchanged")
    return joined.withColumn("outcome", outcome).withColumn(
        "USER_ID", F.when(is_open & found, F.col("_user")).otherwise(F.col("USER_ID"))
    ).drop("_source", "_user")

