"""Every operator as a query over the given tables: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow import schemas
from tenderflow.functions import contact, description, identity, names, naics, records, titles
from tenderflow.functions import signals as S
from tenderflow.functions.text import parse_day
from tenderflow.operators import curate, linkage, listing, pages, report, resolve
from tenderflow.plans.adapters import NOW, given, logical
from tenderflow.session import case_sensitive
from tenderflow.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIOD = report.report_range(NOW)
TODAY = report.today_range(NOW)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


class Tables:
    """Logical and given tables of one data folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return logical(self._spark, self._dir, name)

    def raw(self, name: str) -> DataFrame:
        return given(self._spark, self._dir, name)


def directory(t: Tables) -> DataFrame:
    return listing.directory_users(t["users"])


def joined_text(c, sep: str = " | "):
    return F.array_join(c, sep)


# ---------------------------------------------------------------- sources and sinks

def source_lines(t: Tables) -> DataFrame:
    """Upload lines from every customer: repeats of URLs and names, short lines, blank fields."""
    k = F.col("c_custkey")
    url = F.concat(F.lit(" https://agency"), (k % 700).cast("string"), F.lit(".gov/Bids"))
    name = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Office "), (k * 7 % 1100).cast("string")))
    rest = F.concat_ws(
        "|",
        F.when(k % 3 == 0, "2024-01-02 03:04:05").when(k % 3 == 1, "0").otherwise(""),
        F.lit(""),
        F.concat((k % 40).cast("string"), F.lit("kg")),
        (k % 60).cast("string"),
        F.lit("x"),
        F.lit("1"),
        F.concat(F.lit("99000000000000000"), (k % 900 + 100).cast("string")),
        F.lit("1"),
        F.lit("0"),
    )
    line = F.when(k % 17 == 3, F.concat_ws("|", url, name)).otherwise(F.concat_ws("|", url, name, rest))
    return t.raw("customer").select((k + 1).alias("line_no"), line.alias("value"))


@query
def import_source_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = files.import_source_list(source_lines(t), t["bid_url"])
    return new.withColumn("checksum", F.col("checksum").cast("string"))


@query
def parse_model_responses(spark, sf_dir):
    return files.parse_model_responses(Tables(spark, sf_dir)["responses"]).drop("pdf_text")


@query
def load_reference_table(spark, sf_dir):
    at = files.TableLocation(path=f"{sf_dir}/customer.parquet", columns={"id": "c_custkey", "name": "C_NAME"})
    return files.load_reference_table(spark, "entity", at)


@query
def export_unassigned(spark, sf_dir):
    out = files.export_unassigned(Tables(spark, sf_dir)["BIDURL"])
    return files.spreadsheet_rows(out)


# ---------------------------------------------------------------- listings

@query
def list_live_bids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    own = t["bid"].withColumn("BID_URL_ID", F.col("BID_URL_ID") - 1000)
    return listing.list_live_bids(own, t["bid_url"], now=NOW, search="road", per_page=100).select(
        "ID", "TITLE", "URL", "CREATED", "BID_URL_ID"
    )


@query
def list_missing_entity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return listing.list_missing_reference(t["bid"], "ENTITYID", now=NOW, page=2, per_page=100).select(
        "ID", "TITLE", "CREATED", "ENTITYID"
    )


@query
def list_missing_category(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return listing.list_missing_reference(
        t["bid"], "CATEGORYID", now=NOW, historical=True, user_id=7, per_page=100
    ).select("ID", "TITLE", "CREATED", "CATEGORYID")


@query
def list_unassigned_sources(spark, sf_dir):
    return listing.list_unassigned_sources(Tables(spark, sf_dir)["BIDURL"], search="RIVERTOWN", page=2, per_page=150)


@query
def list_sources(spark, sf_dir):
    return listing.list_sources(Tables(spark, sf_dir)["bid_url"], search="city", per_page=200).select(
        "id", "url", "name", "scrape_group"
    )


@query
def list_failed_sources(spark, sf_dir):
    return listing.list_failed_sources(Tables(spark, sf_dir)["failed_bid_urls"], search="promo", per_page=200).select(
        "id", "url", "name", "failure_message", "failed_at"
    )


@query
def list_pending(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return listing.list_pending(t["bids_temp"], t["entity"], search="supply", page=3, per_page=200).select(
        "id", "TITLE", "URL", "created_at", "entity_label"
    )


@query
def list_recent_issues(spark, sf_dir):
    return listing.list_recent_issues(Tables(spark, sf_dir)["scrape_logs"], page=2)


@query
def drop_expired(spark, sf_dir):
    return listing.drop_expired(Tables(spark, sf_dir)["extract"], NOW.date()).select("doc_id", "ENDDATE")


@query
def select_sources_to_scrape(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return listing.select_sources_to_scrape(t["bid_url"], today=NOW.date(), skip_scraped_today=True).select(
        "id", "url", "scrape_status"
    )


@query
def manual_entry_eligible(spark, sf_dir):
    return listing.manual_entry_eligible(Tables(spark, sf_dir)["bid_url"], NOW.date()).select("id", "url")


@query
def directory_users(spark, sf_dir):
    return directory(Tables(spark, sf_dir))


@query
def filter_report_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = report.bids_added_listing(t["bid"], directory(t), t["entity"], t["state"], t["BIDURL"], period=PERIOD)
    return listing.filter_report_rows(rows, " RFP 1")


# ---------------------------------------------------------------- columns

@query
def derive_identity_keys(spark, sf_dir):
    return identity.derive_identity_keys(Tables(spark, sf_dir)["bids_temp"]).select("id", *identity.IDENTITY_COLUMNS)


@query
def fingerprint_keys(spark, sf_dir):
    keyed = identity.derive_identity_keys(Tables(spark, sf_dir)["bid"])
    return keyed.select("ID", F.explode(identity.fingerprint_keys()).alias("fingerprint"))


@query
def url_variants(spark, sf_dir):
    return Tables(spark, sf_dir)["bid"].select("ID", F.explode(identity.url_variants("URL")).alias("variant"))


@query
def clean_description(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = t["bid"].select(F.lit("bid").alias("kind"), F.col("ID").alias("id"), "DESCRIPTION").unionByName(
        t["extract"].select(F.lit("extract").alias("kind"), F.col("doc_id").alias("id"), "DESCRIPTION")
    )
    return both.select("kind", "id", description.clean_description("DESCRIPTION").alias("description"))


@query
def resolve_contact_email(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = t["extract"].select(F.lit("extract").alias("kind"), F.col("doc_id").alias("id"), "CONTACT_EMAIL", "DESCRIPTION").unionByName(
        t["bid"].select(F.lit("bid").alias("kind"), F.col("ID").alias("id"), F.col("EMAIL").alias("CONTACT_EMAIL"), "DESCRIPTION")
    )
    return both.select("kind", "id", contact.resolve_contact_email("CONTACT_EMAIL", "DESCRIPTION").alias("email"))


@query
def normalize_naics(spark, sf_dir):
    return Tables(spark, sf_dir)["extract"].select(
        "doc_id", naics.normalize_naics("NAICSCODE", "DESCRIPTION", "TITLE", "listing_url").alias("naics")
    )


@query
def corporate_prefix(spark, sf_dir):
    t = Tables(spark, sf_dir)["extract"]
    return t.select("doc_id", titles.corporate_prefix("TITLE", contact.posting_entity("POSTING_ENTITY")).alias("title"))


@query
def normalize_posting_entity(spark, sf_dir):
    # The given column and the normalized one differ only in case, and both are to be told apart and written.
    t = Tables(case_sensitive(spark), sf_dir)
    return t["extract"].select("doc_id", "POSTING_ENTITY", contact.posting_entity("POSTING_ENTITY").alias("posting_entity"))


@query
def normalize_contact_fields(spark, sf_dir):
    t = Tables(spark, sf_dir)["extract"]
    address = contact.address_snippet("DESCRIPTION")
    phone = contact.phone_snippet("CONTACT_EMAIL")
    return t.select(
        "doc_id",
        contact.issuing_organization("ISSUING_ORGANIZATION").alias("organization"),
        phone.alias("phone"),
        F.char_length(address).alias("address_chars"),
        F.md5(contact.with_contact_block("lang", address, phone).cast("binary")).alias("block_md5"),
    )


@query
def flatten_description(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = t.raw("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("d")).unionByName(
        t.raw("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("d"))
    )
    return both.select("kind", "id", description.flatten_description("d").alias("description"))


@query
def title_from_url(spark, sf_dir):
    return Tables(spark, sf_dir).raw("pages").select(
        "page_id", "url",
        titles.title_from_url("url", "page").alias("page_title"),
        titles.title_from_url("url", "document").alias("document_title"),
    )


def title_pages(t: Tables) -> DataFrame:
    """Crawled pages of every listing: one per line of each document's whole text, titled by it, and one that a listed title may name."""
    lines = t.raw("documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "title"))
    named = t.raw("documents").where(F.col("doc_id") % 2 == 0).select(
        "doc_id", F.lit(-1).alias("line"), F.concat(F.lit("delivery of goods "), (F.col("doc_id") % 400).cast("string"), F.lit(" - details")).alias("title")
    )
    return named.unionByName(lines).select(
        F.concat(F.lit("https://agency"), (F.col("doc_id") % 60).cast("string"), F.lit(".gov/bids")).alias("listing_url"),
        (F.col("doc_id") * 1_000_000 + F.col("line") + 1).alias("pos"),
        F.concat(
            F.when(F.col("doc_id") % 3 == 0, "https://www.bidnetdirect.com/p/").otherwise("https://agency.gov/p/"),
            F.col("doc_id").cast("string"), F.lit("/"), (F.col("line") + 1).cast("string"),
        ).alias("url"),
        "title",
    )


@query
def resolve_saved_url(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.resolve_saved_url(t["extract"], title_pages(t)).select("doc_id", "saved_url")


@query
def classify_bid_like(spark, sf_dir):
    keyed = identity.derive_identity_keys(Tables(spark, sf_dir)["extract"], source="source_id")
    v = records.classify_bid_like("TITLE", "DESCRIPTION", "listing_url", parse_day("ENDDATE"), F.col("has_tier_a"))
    return keyed.select("doc_id", v["is_bid"].alias("is_bid"), v["reason"].alias("reason"))


@query
def url_host_and_portal(spark, sf_dir):
    t = Tables(spark, sf_dir)
    urls = t.raw("pages").select("url").unionByName(t["BIDURL"].select(F.col("URL").alias("url"))).unionByName(t["bid_url"].select("url"))
    host = names.url_host("url")
    return urls.select("url", host.alias("host"), names.is_portal_host(host).alias("is_portal"), names.subdomain_hint("url").alias("hint"))


@query
def entity_name_keys(spark, sf_dir):
    return Tables(spark, sf_dir)["entity"].select(
        "id", names.canonical_name("name").alias("canonical"), joined_text(names.significant_tokens("name")).alias("tokens")
    )


@query
def organization_hints(spark, sf_dir):
    t = Tables(spark, sf_dir)
    joined = t["extract"].join(t["bid_url"].select(F.col("id").alias("source_id"), F.col("name").alias("bid_url_name"), F.col("url").alias("source_url")), "source_id", "left")
    hints = names.organization_hints("bid_url_name", "ISSUING_ORGANIZATION", "source_url", "URL", "TITLE", "DESCRIPTION")
    from_bids = t["bid"].select(
        F.lit("bid").alias("kind"), F.col("ID").alias("id"),
        joined_text(names.organization_hints(F.lit(None), F.lit(None), F.lit(None), "URL", "TITLE", "DESCRIPTION")).alias("hints"),
    )
    return joined.select(F.lit("extract").alias("kind"), F.col("doc_id").alias("id"), joined_text(hints).alias("hints")).unionByName(from_bids)


@query
def geo_and_category_hints(spark, sf_dir):
    return Tables(spark, sf_dir)["extract"].select(
        "doc_id",
        names.state_hint("LOCATION_STATE", "TITLE", "DESCRIPTION").alias("state_hint"),
        names.category_hint("BID_CATEGORY", "TITLE", "DESCRIPTION").alias("category_hint"),
    )


@query
def public_link(spark, sf_dir):
    return Tables(spark, sf_dir)["bid"].select(
        "ID",
        titles.public_link("TITLE", "ID", "THIRD_PARTY_IDENTIFIER").alias("link"),
        titles.public_link("TITLE", "ID", "THIRD_PARTY_IDENTIFIER", trust_local_id=True).alias("trusted_link"),
    )


@query
def description_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = description.description_pairs(t["bid"].select(F.concat(F.lit("bid "), F.col("ID").cast("string")).alias("record"), "DESCRIPTION"), "record")
    b = description.description_pairs(t["extract"].select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("record"), "DESCRIPTION"), "record")
    return a.unionByName(b)


@query
def option_labels(spark, sf_dir):
    t = Tables(spark, sf_dir)
    parts = [("entity", report.entity_options(t["entity"])), ("state", report.state_options(t["state"])), ("source", report.source_options(t["BIDURL"]))]
    every = [df.select(F.lit(k).alias("kind"), "id", "label") for k, df in parts]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query
def detail_payload(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return records.detail_payload(t["bid"], "live", t["entity"]).unionByName(
        records.detail_payload(t["bids_temp"], "pending", t["entity"])
    )


@query
def record_payload(spark, sf_dir):
    bid = Tables(spark, sf_dir)["bid"].select("ID", "TITLE", "CREATED", "ENDDATE", "USERID", "EMAIL", "NSN")
    return records.record_payload(bid)


@query
def last_scraped(spark, sf_dir):
    return Tables(spark, sf_dir)["bid_url"].select("id", listing.last_scraped().alias("last_scraped"))


@query
def apply_ingest_defaults(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = records.apply_ingest_defaults(
        t["extract"].select("doc_id", "TITLE", F.when(F.col("doc_id") % 5 != 0, F.col("DESCRIPTION")).alias("DESCRIPTION")),
        now=NOW, assignee=4, directory=directory(t),
    )
    return rows.select("doc_id", "SUBSCRIPTIONTYPEID", "SETASIDECODEID", "USERID", "CREATED", "LAST_MODIFIED", F.md5(F.col("DESCRIPTION").cast("binary")).alias("description_md5"))


# ---------------------------------------------------------------- linkage

@query
def match_duplicates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pending = t["bids_temp"]
    return linkage.match_duplicates_excluding_self(pending, "id", "pending", pending, t["bid"])


@query
def match_duplicates_incoming(spark, sf_dir):
    t = Tables(spark, sf_dir)
    probes = identity.derive_identity_keys(
        t["extract"].withColumn("BID_URL_ID", F.col("source_id") + 1000), naics="NAICSCODE"
    )
    stored = t["bid"]
    return linkage.match_duplicates(probes, "doc_id", t["bids_temp"], stored, few=True)


@query
def duplicate_outcome(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pending = t["bids_temp"]
    m = linkage.match_duplicates(identity.derive_identity_keys(pending), "id", None, t["bid"])
    judged = pending.select("id").join(m, "id", "left")
    return judged.groupBy(linkage.duplicate_outcome("tier").alias("outcome"), "tier", "reason").agg(F.count("*").alias("n"))


@query
def similar_bids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    live = t["bid"]
    return linkage.similar_bids(live.withColumn("qid", F.col("ID")), "qid", live, t["bids_temp"], queries_are_pending=False)


@query
def ordered_greedy_dedup(spark, sf_dir):
    keyed = identity.derive_identity_keys(Tables(spark, sf_dir)["extract"], source="source_id").withColumn("k", identity.fingerprint_keys())
    return linkage.ordered_greedy_dedup(keyed.select("doc_id", F.col("k").alias("probe_keys"), F.col("k").alias("emit_keys")), "doc_id")


def href_links(t: Tables) -> DataFrame:
    """Every link target in the pages, resolved."""
    p = t.raw("pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select("page_id", "url", F.posexplode(found).alias("pos", "href")).select(
        "page_id", pages.resolve_href(F.col("href"), F.col("url")).alias("URL"), "pos"
    )


@query
def dedupe_links(spark, sf_dir):
    return linkage.dedupe_links(href_links(Tables(spark, sf_dir)))


@query
def dedupe_snapshots(spark, sf_dir):
    docs = Tables(spark, sf_dir).raw("documents").select(
        F.col("source").alias("listing_url"), F.col("doc_id").alias("pos"), "text",
        F.when(F.lower("text").contains("password"), "signal").alias("blocked_reason"),
    )
    return linkage.dedupe_snapshots(docs).select("listing_url", "pos", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---------------------------------------------------------------- resolution

def entity_records(t: Tables) -> DataFrame:
    src = t["bid_url"].select(F.col("id").alias("source_id"), F.col("name").alias("bid_url_name"), F.col("url").alias("source_listing_url"))
    return t["extract"].join(src, "source_id", "left").withColumn(
        "EMAIL", contact.resolve_contact_email("CONTACT_EMAIL", "DESCRIPTION")
    )


@query
def resolve_entity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.resolve_entity(entity_records(t), "doc_id", t["entity"])


@query
def resolve_state(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hinted = t["extract"].withColumn("hint", names.state_hint("LOCATION_STATE", "TITLE", "DESCRIPTION"))
    return resolve.resolve_state(hinted, "doc_id", "hint", t["state"])


@query
def resolve_category(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hinted = t["extract"].withColumn("hint", names.category_hint("BID_CATEGORY", "TITLE", "DESCRIPTION"))
    return resolve.resolve_category(hinted, "doc_id", "hint", t["category"])


@query
def resolve_master_source_id(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = t["bid_url"].select(F.col("id").alias("source_id"), F.lit("").alias("hint"))
    a = resolve.resolve_master_source_id(src, "source_id", "hint", t["bid_url"], t["BIDURL"])
    b = resolve.resolve_master_source_id(
        t["bids_temp"].select("id", "BID_URL_ID", "source_listing_url"), "BID_URL_ID", "source_listing_url",
        t["bid_url"], t["BIDURL"], from_source=False,
    )
    return a.select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), "master_source_id").unionByName(
        b.select(F.lit("pending").alias("kind"), "id", "master_source_id")
    )


@query
def scope_to_scraped_sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    own = t["bid"].withColumn("BID_URL_ID", F.col("BID_URL_ID") - 1000)
    return listing.scope_to_scraped_sources(own, t["bid_url"]).select("ID", "BID_URL_ID")


@query
def match_page_by_title(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.match_page_by_title(t["extract"], title_pages(t))


@query
def assign_sources_from_history(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.assign_sources_from_history(t["BIDURL"], t["BIDURLHISTORY"]).select("ID", "USER_ID", "outcome")


@query
def attach_report_labels(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t["bid"].select("ID", "ENTITYID", "STATEID", "BID_URL_ID")
    return report.attach_report_labels(rows, t["entity"], t["state"], t["BIDURL"]).select("ID", "entity", "state", "bid_url")


def title_rewrites(t: Tables) -> DataFrame:
    """Rewrites of every listing, one too few for some."""
    return t.raw("documents").where(~((F.col("doc_id") % 60 == 11) & (F.col("doc_id") < 60))).select(
        F.concat(F.lit("https://agency"), (F.col("doc_id") % 60).cast("string"), F.lit(".gov/bids")).alias("listing_url"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("Rewritten "), F.col("doc_id").cast("string")).alias("rewrite"),
    )


@query
def apply_title_rewrites(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return resolve.apply_title_rewrites(t["extract"].withColumn("pos", F.col("doc_id")), title_rewrites(t)).select("doc_id", "TITLE", "display_title")


# ---------------------------------------------------------------- reports

def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return report.user_activity_report(directory(t), t["bid"], t["bid_url_history"], period=PERIOD, today=TODAY)


@query
def user_activity_report(spark, sf_dir):
    return activity(spark, sf_dir)


@query
def bids_added_listing(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.bids_added_listing(t["bid"], directory(t), t["entity"], t["state"], t["BIDURL"], period=PERIOD)


def judged_extracts(t: Tables) -> DataFrame:
    keyed = identity.derive_identity_keys(t["extract"], source="source_id")
    verdict = records.classify_bid_like("TITLE", "DESCRIPTION", "listing_url", parse_day("ENDDATE"), F.col("has_tier_a"))
    repeated = F.col("SOLICITATIONNUMBER") != "Not provided"
    outcome = (
        F.when(~listing.not_expired("ENDDATE", NOW.date()), "expired").when(repeated, "duplicate")
        .when(verdict["is_bid"] & (F.col("doc_id") % 60 < 20), "saved").otherwise("rejected")
    )
    return keyed.select(F.col("listing_url").alias("url"), outcome.alias("outcome"))


@query
def run_summary(spark, sf_dir):
    return report.run_summary(judged_extracts(Tables(spark, sf_dir)))


@query
def issue_counts(spark, sf_dir):
    return report.issue_counts(Tables(spark, sf_dir)["scrape_logs"])


@query
def dashboard_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.dashboard_counts(t["scrape_logs"], t["bids_temp"], t["BIDURL"], t["failed_bid_urls"])


@query
def distinct_groups(spark, sf_dir):
    return report.distinct_groups(Tables(spark, sf_dir)["bid_url"])


@query
def report_range(spark, sf_dir):
    """Bids per Manila day of the default range."""
    lo, hi = report.report_range(NOW)
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Manila"), F.col("CREATED")))
    bid = Tables(spark, sf_dir)["bid"]
    kept = bid.where((F.col("CREATED") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("CREATED") < F.lit(hi).cast("timestamp_ntz")))
    return kept.groupBy(local.alias("manila_day")).agg(F.count("*").alias("n"))


@query
def latest_user_per_source(spark, sf_dir):
    return report.latest_user_per_source(Tables(spark, sf_dir)["BIDURLHISTORY"])


@query
def latest_error_per_source(spark, sf_dir):
    return report.latest_error_per_source(Tables(spark, sf_dir)["scrape_logs"])


# ---------------------------------------------------------------- typeahead

@query
def search_entities(spark, sf_dir):
    return listing.search_entities(Tables(spark, sf_dir)["entity"], "12", limit=100)


@query
def search_states(spark, sf_dir):
    return listing.search_states(Tables(spark, sf_dir)["state"], "ON%")


@query
def search_categories(spark, sf_dir):
    return listing.search_categories(Tables(spark, sf_dir)["category"], "m")


@query
def search_sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = listing.search_sources(t["BIDURL"], t["bid_url"], "AGENCY", limit=100)
    b = listing.search_sources(t["BIDURL"], t["bid_url"], "gov", limit=100, user_id=5)
    return a.select(F.lit("master").alias("kind"), "id", "label", "url").unionByName(
        b.select(F.lit("user").alias("kind"), "id", "label", "url")
    )


# ---------------------------------------------------------------- table maintenance

# Promotion runs after the last stamp in the tables, as an approval comes after the records it approves.
PROMOTED_AT = dt.datetime(2026, 1, 1)


@query
def promote_pending(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return curate.promote_pending(t["bids_temp"], t["bid"], t["bid_url"], t["BIDURL"], now=PROMOTED_AT).live.select(
        "ID", "TITLE", "URL", "BID_URL_ID", "ENTITYID", "NAICSCODE", "LAST_MODIFIED"
    )


@query
def approval_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = curate.promote_pending(t["bids_temp"], t["bid"], t["bid_url"], t["BIDURL"], now=PROMOTED_AT)
    return curate.approval_stats(done.outcomes)


@query
def map_pending_to_live(spark, sf_dir):
    t = Tables(spark, sf_dir)
    override = {"USERID": F.when(F.col("BID_URL_ID") % 2 == 0, F.lit("77")).otherwise(F.lit(None))}
    mapped = curate.map_pending_to_live(t["bids_temp"], t["bid_url"], t["BIDURL"], now=NOW, overrides=override)
    return curate.with_insert_defaults(mapped).select(
        "pending_id", "TITLE", "URL", "BID_URL_ID", "USERID", "ENTITYID", "CATEGORYID", "STATEID", "INLINEURL", "COUNTRY_ID",
        "NAICSCODE", "LAST_MODIFIED",
    )


@query
def patch_live(spark, sf_dir):
    t = Tables(spark, sf_dir)
    patches = t["bids_temp"].groupBy((F.floor(F.col("id") / 80000000) + 1).cast("bigint").alias("ID")).agg(
        F.max("ENTITYID").alias("ENTITYID"), F.min("EMAIL").alias("EMAIL"), F.max("INLINEURL").alias("INLINEURL"),
        F.max("LAST_MODIFIED").alias("LAST_MODIFIED"),
    )
    return curate.patch_live(t["bid"], patches).select("ID", "TITLE", "ENTITYID", "EMAIL", "INLINEURL", "LAST_MODIFIED")


@query
def quarantine_failed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = curate.quarantine_failed(t["bid_url"], t["failed_bid_urls"], t["scrape_logs"])
    a = done.sources.select(F.lit("active").alias("list"), "id", "url", F.lit(None).cast("string").alias("failure_message"))
    return a.unionByName(done.failed.select(F.lit("failed").alias("list"), "id", "url", "failure_message"))


@query
def restore_failed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return curate.restore_failed(t["bid_url"], t["failed_bid_urls"]).outcomes


@query
def restore_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return report.outcome_stats(curate.restore_failed(t["bid_url"], t["failed_bid_urls"]).outcomes)


@query
def finish_visits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    visits = t["bid_url_history"].where(F.col("end_time").isNotNull()).select(
        "bid_url_id", (F.col("start_time") + F.expr("INTERVAL 30 DAY")).alias("start_time"),
        (F.col("end_time") + F.expr("INTERVAL 30 DAY")).alias("end_time"), "user_id",
    )
    done = curate.finish_visits(t["bid_url"], t["failed_bid_urls"], t["bid_url_history"], visits)
    def rows(df, kind, *cols):
        return df.select(F.lit(kind).alias("kind"), "id", *cols)
    none = F.lit(None).cast("timestamp_ntz").alias("last_scraped_at")
    return (
        rows(done.sources, "source", "start_time", "end_time", "last_scraped_at")
        .unionByName(rows(done.failed, "failed", "start_time", "end_time", "last_scraped_at"))
        .unionByName(rows(done.history, "history", "start_time", "end_time", none))
    )


@query
def bulk_source_and_queue_updates(spark, sf_dir):
    t = Tables(spark, sf_dir)
    src = t["bid_url"]
    marked = curate.set_last_scraped(src, at=NOW, group="Test")
    cleared = curate.set_last_scraped(marked, at=None, group="VE")
    filled = curate.backfill_group(cleared)
    left = curate.reject_pending(t["bids_temp"], 1007).groupBy("BID_URL_ID").agg(F.count("*").alias("n"))
    a = filled.select(F.lit("source").alias("kind"), "id", "scrape_group", "last_scraped_at", F.lit(None).cast("bigint").alias("n"))
    b = left.select(
        F.lit("pending").alias("kind"), F.col("BID_URL_ID").alias("id"), F.lit(None).cast("string").alias("scrape_group"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped_at"), "n",
    )
    return a.unionByName(b)


@query
def conform_schema(spark, sf_dir):
    t = Tables(spark, sf_dir)
    given_rows = t["bids_temp"].withColumnRenamed("SOLICITATIONNUMBER", "soliciationnumber").withColumn("raw_html", F.lit("x"))
    out = schemas.conform(given_rows, schemas.schema("bid"))
    return out.select(F.col("ID").alias("ID"), "TITLE", "SOLICITATIONNUMBER", "ENDDATE", F.lit(len(out.columns)).cast("bigint").alias("n_columns"))


@query
def validate_records(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t["extract"].select(
        "doc_id", F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("DESCRIPTION")).alias("TITLE"),
        F.when(F.col("doc_id") % 4 == 0, "a b@c").when(F.col("doc_id") % 4 == 1, "").otherwise(F.lit("a.b@c-d.gov")).alias("EMAIL"),
        "ENDDATE", "NAICSCODE",
        F.when(F.col("doc_id") % 7 == 0, "12x").when(F.col("doc_id") % 7 == 1, "").otherwise(F.col("source_id").cast("string")).alias("ENTITYID"),
        (F.col("doc_id") % 200).cast("string").alias("USERID"), F.col("listing_url").alias("URL"),
    )
    out = curate.validate_records(rows, directory(t))
    return out.select("doc_id", "EMAIL", "ENTITYID", "USERID", joined_text(F.col("errors")).alias("errors"))


# ---------------------------------------------------------------- pages

@query
def pages_to_text(spark, sf_dir):
    return pages.pages_to_text(Tables(spark, sf_dir).raw("pages")).select("page_id", "text")


# Words of the given pages, in place of the procurement words that they lack.
PAGE_WORDS = {
    "browser_check": ["casino", "pills", "click here", "subscribe"],
    "blocked": ["casino", "cheap", "viagra", "winner"],
    "opened": ["que les", "of the", "und der"],
    "no_open": ["ad 0", "subscribe", "cookie"],
    "platform": ['class="ad"'],
    "spa": ["<main"],
    "more_script_hosts": ["example.net"],
    "more_heavy_hosts": ["example.org"],
}


@query
def classify_pages(spark, sf_dir):
    read = pages.pages_to_text(Tables(spark, sf_dir).raw("pages"))
    return pages.classify_pages(read, **PAGE_WORDS).select(
        "page_id", "browser_check", "blocked_reason", "spa", "login_page", "open_bids", "no_open_bids", "platform_page",
        "script_host", "heavy_portal", "needs_render", "page_class",
    )


# Link targets here end in words, not in .pdf: those in n stand for documents.
DOC_WORDS = {"suffix_pattern": r"(?i)n$", "negative": ["spam", "pills"], "positive": ["the", "que", "der", "un"], "id_pattern": r"(?i)\b[a-z]{1,6}\d{2,}\b"}


@query
def extract_document_links(spark, sf_dir):
    p = Tables(spark, sf_dir).raw("pages")
    return pages.extract_document_links(p, **DOC_WORDS)


@query
def extract_detail_links(spark, sf_dir):
    return pages.extract_detail_links(Tables(spark, sf_dir).raw("pages"), words="the|que|der|tion|en")


@query
def primary_description(spark, sf_dir):
    return pages.primary_description(journal_pages(Tables(spark, sf_dir))).select(
        "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.char_length("primary_description").alias("chars")
    )


def journal_pages(t: Tables) -> DataFrame:
    return t.raw("documents").select(
        "doc_id",
        F.concat(F.when(F.col("doc_id") % 3 == 0, "https://example.com/").otherwise("https://www.compliancenews.com/n/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(
            F.lit("Head\n"),
            F.when(F.col("doc_id") % 2 == 0, "Project  Details:\n").otherwise("PROJECT DESCRIPTION\n"),
            F.col("text"),
            F.when(F.col("doc_id") % 5 == 0, "\nBack To Trade Journal\nfoot").when(F.col("doc_id") % 5 == 1, "\n  PDF ATTACHMENTS\nfoot").otherwise(""),
        ).alias("text"),
    )


@query
def join_document_texts(spark, sf_dir):
    # Two hundred ids a listing: there are as many listings as the table has documents for.
    listing = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 200).cast("string"))
    docs = Tables(spark, sf_dir).raw("documents").select(listing.alias("listing_url"), F.col("doc_id").alias("pos"), "text")
    return pages.join_document_texts(docs).select("listing_url", "documents", F.md5(F.col("document_text").cast("binary")).alias("text_md5"))


def listing_links(t: Tables) -> DataFrame:
    """Titles of the bids of every source as links, with the source's listing text."""
    return t["bid"].select(F.col("BID_URL_ID").alias("page_id"), F.col("ID").alias("pos"), F.col("TITLE"), F.col("URL"))


def listing_texts(t: Tables) -> DataFrame:
    return t["bid_url"].select(
        (F.col("id") + 1000).alias("page_id"),
        F.concat(
            F.lit("Road repair RFP "), (F.col("id") % 50).cast("string"), F.lit(" due soon\nSTATUS:  open\n"),
            F.repeat(F.lit("Lorem ipsum. "), 40), F.lit("Supply of  Parts "), (F.col("id") % 50).cast("string"), F.lit(" Status: Closed"),
        ).alias("text"),
    )


@query
def prioritize_links(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return pages.prioritize_links(listing_links(t), listing_texts(t)).select("page_id", "pos", "is_open", "priority")


@query
def excerpt_budget(spark, sf_dir):
    docs = Tables(spark, sf_dir).raw("documents").select(
        F.col("doc_id").alias("page_id"), F.concat_ws("/", "source", "lang").alias("listing_url"),
        "text", F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("html"), F.reverse("text").alias("pdf_text"),
    )
    return pages.excerpt_budget(docs, caps=S.EXCERPT_CAPS, budget=S.EXCERPT_BUDGET).select(
        "page_id", *[F.char_length(c).alias(f"{c}_chars") for c in ("text", "html", "pdf_text")], F.md5(F.col("pdf_text").cast("binary")).alias("pdf_md5")
    )
