"""Listings and typeahead search: filter, order, page."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderflow.functions import signals as S
from tenderflow.functions.identity import listing_url_key
from tenderflow.functions.text import matches_search, null_if_empty, parse_moment, text, trimmed
from tenderflow.functions.titles import entity_label, source_label, state_label
from tenderflow.operators.resolve import master_url_index


def paged(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page in order. Plans as a top-k per task and a merge of page * per_page rows, not as a full sort."""
    return df.orderBy(*order).offset(max(page - 1, 0) * per_page).limit(per_page)


def one_of(value: int, allowed: list[int], default: int = 50) -> int:
    return value if value in allowed else default


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def last_scraped() -> Column:
    """When a source was last scraped: its mark, else the end of its last visit."""
    return F.coalesce("last_scraped_at", "end_time")


def scope_to_scraped_sources(bids: DataFrame, sources: DataFrame, mark: str = "last_scraped_at") -> DataFrame:
    """Bids whose source has a last-scraped mark."""
    ids = sources.where(F.col(mark).isNotNull()).select(F.col("id").alias("BID_URL_ID"))
    return bids.join(ids, "BID_URL_ID", "left_semi")


def _bid_filters(now: dt.datetime, recent_days: int, historical: bool, search: str, created_on, user_id) -> Column:
    cond = matches_search(search, "TITLE", "NAICSCODE", "URL")
    if not historical and recent_days > 0:
        start = dt.datetime.combine((now - dt.timedelta(days=recent_days)).date(), dt.time())
        cond = cond & (F.col("CREATED") >= F.lit(start).cast("timestamp_ntz"))
    if created_on is not None:
        day = dt.datetime.combine(created_on, dt.time())
        # A range on the stored column, so that it reaches the scan.
        cond = cond & (F.col("CREATED") >= F.lit(day).cast("timestamp_ntz"))
        cond = cond & (F.col("CREATED") < F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz"))
    if user_id is not None:
        cond = cond & (F.col("USERID") == user_id)
    return cond


def _newest_first() -> list[Column]:
    return [F.desc_nulls_last("CREATED"), F.desc("ID")]


def list_live_bids(
    bids: DataFrame,
    sources: DataFrame,
    *,
    now: dt.datetime,
    recent_days: int = 180,
    historical: bool = False,
    search: str = "",
    created_on: dt.date | None = None,
    user_id: int | None = None,
    page: int = 1,
    per_page: int = 50,
) -> DataFrame:
    kept = bids.where(_bid_filters(now, recent_days, historical, search, created_on, user_id))
    scoped = scope_to_scraped_sources(kept, sources)
    return paged(scoped, _newest_first(), page, one_of(per_page, [5, 10, 25, 50, 100]))


def list_missing_reference(
    bids: DataFrame,
    column: str,
    *,
    now: dt.datetime,
    recent_days: int = 180,
    historical: bool = False,
    search: str = "",
    created_on: dt.date | None = None,
    user_id: int | None = None,
    page: int = 1,
    per_page: int = 50,
) -> DataFrame:
    """Bids without an id in `column`: ENTITYID or CATEGORYID. Not limited to scraped sources."""
    cond = _bid_filters(now, recent_days, historical, search, created_on, user_id)
    kept = bids.where(cond & (F.coalesce(column, F.lit(0)) == 0))
    return paged(kept, _newest_first(), page, one_of(per_page, [5, 10, 25, 50, 100]))


def unassigned_sources(master: DataFrame, search: str = "") -> DataFrame:
    return master.where((F.coalesce("USER_ID", F.lit(0)) == 0) & matches_search(search, "URL", "NAME"))


def list_unassigned_sources(master: DataFrame, *, search: str = "", page: int = 1, per_page: int = 50) -> DataFrame:
    return paged(unassigned_sources(master, search), [F.col("ID")], page, clamped(per_page, 5, 200))


def in_group(sources: DataFrame, group: str | None) -> DataFrame:
    """Sources of a scrape group; an empty group means all."""
    g = (group or "").strip()
    return sources.where(F.col("scrape_group") == g) if g else sources


def list_sources(
    sources: DataFrame, *, group: str | None = None, search: str = "", page: int = 1, per_page: int = 50
) -> DataFrame:
    """Configured sources; without a group the default one."""
    scoped = in_group(sources, S.DEFAULT_GROUP if group is None else group)
    return paged(scoped.where(matches_search(search, "url", "name")), [F.col("id")], page, clamped(per_page, 5, 200))


def list_failed_sources(failed: DataFrame, *, search: str = "", page: int = 1, per_page: int = 50) -> DataFrame:
    kept = failed.where(matches_search(search, "url", "name", "failure_message"))
    return paged(kept, [F.desc_nulls_last("failed_at"), F.desc("id")], page, clamped(per_page, 5, 200))


def list_pending(pending: DataFrame, entities: DataFrame, *, search: str = "", page: int = 1, per_page: int = 50) -> DataFrame:
    """Pending bids, oldest first, with their entity label. The page is cut before the labels are joined."""
    kept = pending.where(matches_search(search, "TITLE", "URL", "bid_url_name", "NAICSCODE"))
    rows = paged(kept, [F.col("id"), F.col("created_at")], page, one_of(per_page, [10, 25, 50, 100, 200]))
    labels = entities.select(
        F.col("id").cast("bigint").alias("ENTITYID"), entity_label("id", ["name"], ["email"]).alias("entity_label")
    )
    # At most one page on the left, so it is the side to send.
    joined = labels.join(F.broadcast(rows.select(F.col("id").alias("_id"), "ENTITYID")), "ENTITYID").select("_id", "entity_label")
    return rows.join(joined, rows["id"] == joined["_id"], "left").drop("_id").orderBy("id", "created_at")


def list_recent_issues(logs: DataFrame, *, latest: int = 200, page: int = 1, per_page: int = 50) -> DataFrame:
    newest = logs.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(latest)
    return paged(newest, [F.desc_nulls_last("created_at"), F.desc("id")], page, per_page)


def not_expired(end: str, today: dt.date) -> Column:
    """True without an end date or with one from today on; an unreadable end date counts as expired."""
    day = parse_moment(end)
    # An unreadable date gives null here and counts as expired.
    return text(end).isin("", "0") | F.coalesce(day >= F.lit(today).cast("timestamp"), F.lit(False))


def drop_expired(extracts: DataFrame, today: dt.date, end: str = "ENDDATE") -> DataFrame:
    return extracts.where(not_expired(end, today))


def select_sources_to_scrape(
    sources: DataFrame, *, today: dt.date, group: str | None = "", skip_scraped_today: bool = False
) -> DataFrame:
    """Sources of a group with what to do about each, in id order."""
    url = trimmed("url")
    valid = url.rlike(r"(?i)^https?://[^\s/?#]+\.?[^\s]*$")
    scraped = F.to_date("last_scraped_at") == F.lit(today) if skip_scraped_today else F.lit(False)
    status = (
        F.when(url == "", "missing_url")
        .when(~valid, "invalid_url")
        .when(F.coalesce(scraped, F.lit(False)), "scraped_today")
        .otherwise("due")
    )
    return in_group(sources, group).withColumn("scrape_status", status).orderBy("id")


def manual_entry_eligible(sources: DataFrame, today: dt.date) -> DataFrame:
    day = F.to_date(last_scraped())
    return sources.where(day.isNull() | (day != F.lit(today)))


def directory_users(users: DataFrame, zone: str = S.DIRECTORY_ZONE) -> DataFrame:
    """Assignable users of a time zone with their label, in id order."""
    parts = F.filter(F.array(trimmed("FIRSTNAME"), trimmed("LASTNAME")), lambda v: v != "")
    label = F.coalesce(
        null_if_empty(F.array_join(parts, " ")), null_if_empty(trimmed("NAME")), F.lit("Unnamed")
    )
    return users.where(F.col("TIME_ZONE") == zone).select("id", label.alias("label")).orderBy("id")


def filter_report_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose joined text contains the query."""
    q = query.strip().lower()
    shown = [text(c) for c in ("title", "entity", "bid_url", "state", "created_display", "created")]
    return rows.where(F.lower(F.concat_ws(" ", *shown)).contains(q)) if q else rows


# ---------------------------------------------------------------- typeahead

def _needle(query: str, length: int) -> str:
    return "".join(ch for ch in query.strip()[:length] if ch not in "%_\\")


def search_entities(
    entities: DataFrame, query: str, *, limit: int = 40, names: list[str] = ["name"], emails: list[str] = ["email"]
) -> DataFrame:
    needle = _needle(query, 160)
    cond = matches_search(needle, *names, *emails)
    if needle.strip().isdigit():
        cond = cond | (F.col("id") == int(needle))
    rows = entities.where(cond).orderBy("id").limit(clamped(limit, 5, 100))
    return rows.select("id", entity_label("id", names, emails).alias("label"))


def _search_labels(labelled: DataFrame, searched: list[str], query: str, limit: int) -> DataFrame:
    needle = _needle(query, 80)
    cond = matches_search(needle, *searched) | (F.col("id").cast("string") == query.strip())
    return (
        labelled.where(F.col("label").isNotNull() & (F.col("label") != "") & cond)
        .orderBy(F.lower("label"), "id")
        .limit(clamped(limit, 5, 100))
        .select("id", "label")
    )


def search_states(states: DataFrame, query: str, *, limit: int = 50) -> DataFrame:
    labelled = states.withColumn("label", state_label("name", "abbreviation"))
    return _search_labels(labelled, ["name", "abbreviation"], query, limit)


def search_categories(categories: DataFrame, query: str, *, limit: int = 50) -> DataFrame:
    return _search_labels(categories.withColumn("label", trimmed("name")), ["label"], query, limit)


def search_sources(
    master: DataFrame | None, sources: DataFrame, query: str, *, limit: int = 40, user_id: int | None = None
) -> DataFrame:
    """Master sources, or with a user (or no master table) the configured ones under their master id."""
    q = query.strip()
    cap = clamped(limit, 5, 100)
    if user_id is None and master is not None:
        cond = matches_search(q, "URL", "NAME")
        if q.isdigit():
            cond = cond | (F.col("ID") == int(q))
        rows = master.where(cond).orderBy("NAME", "URL", "ID").limit(cap)
        shown = rows.select(F.col("ID").cast("bigint").alias("id"), source_label("NAME", "URL").alias("label"), trimmed("URL").alias("url"))
        return shown.where(F.col("label").isNotNull())
    scoped = sources.where(F.col("user_id") == user_id) if user_id else sources
    rows = scoped.where(matches_search(q, "url", "name")).orderBy("name", "url", "id").limit(cap).select(
        F.col("id").cast("bigint").alias("own_id"), source_label("name", "url").alias("label"), trimmed("url").alias("url"),
    )
    rows = rows.where(F.col("label").isNotNull()).withColumn("url_key", listing_url_key("url"))
    if master is None:
        return rows.select(F.col("own_id").alias("id"), "label", "url")
    # The found rows are few; the index is narrowed to them before it is built.
    mapped = master_url_index(
        master.join(F.broadcast(rows.select("url_key")), listing_url_key("URL") == F.col("url_key"), "left_semi")
    )
    return rows.join(mapped, "url_key", "left").select(F.coalesce("master_id", "own_id").alias("id"), "label", "url")


