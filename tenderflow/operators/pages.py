"""Jobs over crawled pages `(page_id, url, html)`: text, classification, links, document texts, excerpts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderflow.functions import signals as S
from tenderflow.functions.html import page_links, page_text
from tenderflow.functions.text import contains_any, let, strip_tags, text, trimmed
from tenderflow.functions.titles import title_from_url
from tenderflow.operators.linkage import dedupe_links
from tenderflow.operators.skew import lookup_join
from tenderflow.session import cut_lineage

# Markup that the expression path reads like the parser does: no other named references than these.
SIMPLE_REFERENCES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "copy": "©", "reg": "®", "middot": "·",
    "bull": "•", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "amp": "&",  # last, so that no reference is read twice
}


def _cut_bytes(c: Column, max_bytes: int | None) -> Column:
    """The first bytes of a text, cut at a whole character; all of it without a limit."""
    if max_bytes is None:
        return c
    cut = F.substring(c.cast("binary"), 1, max_bytes)
    whole = F.regexp_replace(cut.cast("string"), "\ufffd+$", "")
    return F.when(F.octet_length(c) > max_bytes, whole).otherwise(c)


def needs_parser(html: Column) -> Column:
    """Pages whose text plain expressions would get wrong: nested hidden elements, stray markup, rarer references."""
    return let(html, _is_hard)


def _is_hard(html: Column) -> Column:
    known = "|".join(SIMPLE_REFERENCES)
    unusual_reference = html.rlike(rf"&(?!(?:{known});)[A-Za-z#]")
    hidden = "(script|style|noscript|nav|footer)"
    # Nested or unbalanced hidden elements leave a tag behind when the plain blocks are taken out.
    left_over = without_hidden(html).rlike(rf"(?i)</?{hidden}[\s>/]")
    comments = F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))
    hidden_in_comment = F.exists(comments, lambda c: c.rlike(rf"(?i)</?{hidden}"))
    raw_text = F.regexp_extract_all(html, F.lit(r"(?is)<(?:textarea|title)\b[^>]*>(.*?)</"), F.lit(1))
    markup_in_text = F.exists(raw_text, lambda c: c.contains("<"))
    odd_tags = html.rlike(r"(?i)<[^a-z!/?]|</[^a-z]|<!\[cdata")
    # Whole quoted values are stepped over; what is left must be a value with an angle bracket in it.
    plain = r"""[^<>"']*+"""
    attribute_markup = html.rlike(
        rf"""(?i)<[a-z]{plain}(?:"[^"<>]*"{plain}|'[^'<>]*'{plain})*+(?:"[^"]*[<>]|'[^']*[<>])"""
    )
    return unusual_reference | left_over | hidden_in_comment | markup_in_text | odd_tags | attribute_markup


def without_hidden(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|footer)\b[^>]*>.*?</\1\s*>", "")


def expression_text(html: Column) -> Column:
    """Visible text by expressions only, for pages that `needs_parser` clears."""
    shown = F.regexp_replace(F.regexp_replace(without_hidden(html), r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "")
    for ref, ch in SIMPLE_REFERENCES.items():
        shown = F.replace(shown, F.lit(f"&{ref};"), F.lit(ch))
    return F.regexp_replace(F.regexp_replace(shown, r"\s+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def parsed_text(html: pd.Series) -> pd.Series:
    return html.map(page_text)


def pages_to_text(pages: DataFrame, *, html: str = "html", out: str = "text", max_bytes: int | None = None) -> DataFrame:
    """Add the visible text of each page. Only pages with unusual markup go to the Python parser.

    Whole pages are read; `max_bytes=400000` reproduces the limit of a page fetcher.
    """
    src = pages.withColumn("_html", _cut_bytes(text(html), max_bytes)).withColumn("_hard", needs_parser(F.col("_html")))
    # The parser sees an empty text where the expressions suffice, so only hard pages cross to Python in full.
    hard = F.when(F.col("_hard"), F.col("_html")).otherwise("")
    return (
        src.withColumn("_parsed", parsed_text(hard))
        .withColumn(out, F.when(F.col("_hard"), F.col("_parsed")).otherwise(expression_text(F.col("_html"))))
        .drop("_html", "_hard", "_parsed")
    )


# ---------------------------------------------------------------- classification

def count_phrases(c: Column, phrases: list[str]) -> Column:
    total = F.lit(0)
    for p in phrases:
        total = total + F.when(c.contains(p), 1).otherwise(0)
    return total


def open_signals(low: Column, phrases: list[str]) -> Column:
    counted = F.regexp_extract(low, S.OPEN_COUNT_PATTERN, 1).try_cast("bigint")
    return (F.coalesce(counted, F.lit(0)) > 0) | contains_any(low, phrases) | low.rlike(S.OPEN_CODE_PATTERN)


def first_phrase(c: Column, phrases: list[str]) -> Column:
    out = F.when(c.contains(phrases[0]), phrases[0])
    for p in phrases[1:]:
        out = out.when(c.contains(p), p)
    return out


def on_host(host: Column, suffixes: list[str]) -> Column:
    """The host is one of the given ones or below one."""
    return F.array_contains(F.array(*[F.lit(s.lower()) for s in suffixes if s]), host) | F.greatest(
        F.lit(False), F.lit(False), *[host.endswith("." + s.lower()) for s in suffixes if s]
    )


def classify_pages(
    pages: DataFrame,
    *,
    html: str = "html",
    body: str = "text",
    url: str = "url",
    browser_check: list[str] = S.BROWSER_CHECK_PHRASES,
    blocked: list[str] = S.BLOCKED_PHRASES,
    spa: list[str] = S.SPA_MARKERS,
    no_open: list[str] = S.NO_OPEN_PHRASES,
    opened: list[str] = S.OPEN_PHRASES,
    platform: list[str] = S.PLATFORM_MARKERS,
    login_words: str = S.LOGIN_BID_WORDS,
    more_script_hosts: list[str] | None = None,
    more_heavy_hosts: list[str] | None = None,
) -> DataFrame:
    """Add page flags and the first blocking reason. The word lists are parameters; the defaults are the fixed ones.

    `heavy_portal` and `script_host` tell hosts whose listings need a browser, by suffix; more suffixes can be given.
    """
    # Plain columns first: each is read by many flags and must not be computed for each of them.
    read = pages.withColumns(
        {
            "_low_html": F.lower(text(html)),
            "_hay": F.lower(F.concat(text(body), F.lit(" "), strip_tags(html))),
            "_own": F.lower(text(body)),
            "_visible": trimmed(strip_tags(F.regexp_replace(text(html), r"(?is)<script.*?</script>", ""))),
        }
    )
    markup, low_html, hay, own = text(html), F.col("_low_html"), F.col("_hay"), F.col("_own")
    is_check = count_phrases(hay, browser_check) >= 2
    scripts = F.regexp_count(low_html, F.lit("<script"))
    is_spa = contains_any(low_html, [m.lower() for m in spa]) | ((scripts >= 3) & (F.octet_length("_visible") < 200))
    form = (markup.rlike(r"""(?i)type=["'\\]password["'\\]""") & hay.rlike("log in|login|sign in")) | markup.rlike(
        r"(?i)<form[^>]*(login|signin)[^>]*>"
    )
    is_open = open_signals(own, opened)
    detail_links = markup.rlike(S.DETAIL_PATH_PATTERN)
    platform_page = contains_any(low_html, platform)
    path = F.lower(F.regexp_extract(text(url), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    host = F.lower(F.regexp_extract(text(url), r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    is_heavy = on_host(host, S.HEAVY_PORTAL_HOSTS + (more_heavy_hosts or []))
    is_script = is_heavy | on_host(host, S.SCRIPT_LISTING_HOSTS + (more_script_hosts or []))
    out = read.withColumns(
        {
            "browser_check": is_check,
            "blocked_reason": F.when(is_check, "browser check/captcha").otherwise(first_phrase(hay, blocked)),
            "spa": is_spa,
            "login_page": form & ~hay.rlike(login_words),
            "open_bids": is_open,
            "no_open_bids": ~open_signals(hay, opened) & contains_any(hay, no_open),
            "platform_page": platform_page,
            "script_host": is_script,
            "heavy_portal": is_heavy,
            "needs_render": is_open & ~detail_links & (platform_page | is_script | path.rlike("/(procurement|solicitation)")),
        }
    )
    reason = (
        F.when(F.col("blocked_reason").isNotNull(), F.concat(F.lit("blocked: "), F.col("blocked_reason")))
        .when(F.col("login_page"), "login page")
        .when(F.col("no_open_bids"), "no open bids")
        .when(F.col("spa"), "script shell")
        .when(F.col("needs_render"), "needs render")
        .otherwise("ok")
    )
    return out.withColumn("page_class", reason).drop("_low_html", "_hay", "_own", "_visible")


# ---------------------------------------------------------------- links

LINK_SCHEMA = "pos int, tag string, href string, link_text string, near_text string"


def extract_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", near: bool = True) -> DataFrame:
    """One row per anchor, frame or embed with a target. The parser works on Arrow batches and keeps pages whole.

    Without `near`, the text around a link is left empty.
    """
    key_type = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, u, *link)
                for k, u, h in zip(pdf[key], pdf[url], pdf[html])
                for link in page_links(h, near)
            ]
            yield pd.DataFrame(rows, columns=[key, url, "pos", "tag", "href", "link_text", "near_text"])

    return pages.select(key, url, html).mapInPandas(read, f"{key} {key_type}, {url} string, {LINK_SCHEMA}")


def resolve_href(href: Column, base: Column) -> Column:
    h = trimmed(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    host = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    prefix = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(h.isin("", "#"), base)
        .when(h.rlike("(?i)^https?:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h)
        .when(h.startswith("/"), F.concat(prefix, h))
        .otherwise(F.concat(prefix, F.lit("/"), h))
    )


def is_template_href(c: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(c), c)
    marks = r"<%|%>|\$\{|\{\{\s*[^}]+\s*\}\}"
    return c.rlike(marks) | decoded.rlike(marks)


def _url_part(url: Column, part: str) -> Column:
    pattern = {
        "scheme": r"^([A-Za-z][A-Za-z0-9+.-]*):",
        "host": r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)",
        "port": r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]+:(\d+)",
        "path": r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)",
        "query": r"^[^?#]*\?([^#]*)",
    }[part]
    return F.regexp_extract(url, pattern, 1)


def same_document(a: Column, b: Column) -> Column:
    """Equal scheme, host, port, path and query; fragments do not count."""

    def port(u: Column) -> Column:
        p, s = _url_part(u, "port"), F.lower(_url_part(u, "scheme"))
        return F.when(p != "", p).when(s == "http", "80").when(s == "https", "443").otherwise("")

    def path(u: Column) -> Column:
        p = F.rtrim(_url_part(u, "path"), F.lit("/"))
        return F.when(p == "", "/").otherwise(p)

    schemes = (_url_part(a, "scheme") != "") & (F.lower(_url_part(a, "scheme")) == F.lower(_url_part(b, "scheme")))
    hosts = F.lower(_url_part(a, "host")) == F.lower(_url_part(b, "host"))
    return schemes & hosts & (port(a) == port(b)) & (path(a) == path(b)) & (_url_part(a, "query") == _url_part(b, "query"))


def is_bid_document(context: Column, base: Column, negative: list[str], positive: list[str], id_pattern: str) -> Column:
    hay = F.lower(F.concat(context, F.lit(" "), base))
    worded = let(hay, lambda h: ~contains_any(h, negative) & contains_any(h, positive))
    return worded | (let(hay, lambda h: ~contains_any(h, negative)) & context.rlike(id_pattern))


def extract_document_links(
    pages: DataFrame,
    links: DataFrame | None = None,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    suffix_pattern: str = r"(?i)\.pdf($|\?)",
    raw_pattern: str = r"""(?i)(https?://[^\s"']+\.pdf)""",
    negative: list[str] = S.DOC_NEGATIVE,
    positive: list[str] = S.DOC_POSITIVE,
    id_pattern: str = S.DOC_ID_PATTERN,
) -> DataFrame:
    """Links to documents worth reading, with a title; raw document URLs in the markup where a page has no such link."""
    found = links if links is not None else extract_links(pages, key, url, html)
    target = resolve_href(F.col("href"), F.col(url))
    one_line = trimmed(F.regexp_replace("link_text", r"\s+", " "))
    context = trimmed(F.concat_ws(" ", one_line, F.col("near_text"), F.col("href"), target))
    kept = (
        found.where(F.col("href").rlike(suffix_pattern))
        .where(~is_template_href(F.col("href")) & ~is_template_href(target))
        .where(is_bid_document(context, F.col(url), negative, positive, id_pattern))
        .select(
            key,
            F.col("pos").cast("int").alias("pos"),
            F.when(F.octet_length(one_line) > 4, one_line).otherwise(title_from_url(target, "document")).alias("TITLE"),
            target.alias("PDF_LINK"),
        )
    )
    # Read twice below; the links are narrow, the parsing behind them is not.
    kept = cut_lineage(kept)
    raw = F.regexp_extract_all(text(html), F.lit(raw_pattern), F.lit(1))
    fallback = (
        pages.join(kept.select(key).distinct(), key, "left_anti")
        .select(key, url, F.posexplode(raw).alias("pos", "PDF_LINK"))
        .where(is_bid_document(F.col("PDF_LINK"), F.col(url), negative, positive, id_pattern))
        .select(key, "pos", title_from_url("PDF_LINK", "document").alias("TITLE"), "PDF_LINK")
    )
    return kept.unionByName(fallback)


def detail_path_title(url: Column) -> Column:
    """Title in a `/Bids/` path, null when there is none."""
    slug = F.regexp_extract(_url_part(url, "path"), r"(?i)/Bids/(.+)$", 1)
    bare = F.regexp_extract(slug, r"(?i)^(?:ITB|RFP|RFQ|IFB|RFB|ITN)-[\d.\-]+(?:-[A-Z]{1,4})?-(.*)$", 1)
    coded = slug.rlike(r"(?i)^(?:ITB|RFP|RFQ|IFB|RFB|ITN)-[\d.\-]+(?:-[A-Z]{1,4})?-(.*)$")
    title = trimmed(F.replace(F.when(coded, bare).otherwise(slug), F.lit("-"), F.lit(" ")))
    return F.when(title != "", title)


def extract_detail_links(
    pages: DataFrame,
    links: DataFrame | None = None,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    words: str = S.DETAIL_LINK_WORDS,
    skip_filtered_portal: bool = True,
) -> DataFrame:
    """Links to detail pages of single solicitations, the first of each URL per page."""
    found = links if links is not None else extract_links(pages, key, url, html, near=False)
    href, target = F.col("href"), F.col("_target")
    non_http = r"(?i)^\s*(mailto|tel|sms|fax|data|blob):"
    host, path, query = F.lower(_url_part(target, "host")), _url_part(target, "path"), _url_part(target, "query")
    filtered_portal = (
        F.lit(skip_filtered_portal)
        & ((host == "procurement.opengov.com") | host.endswith(".procurement.opengov.com"))
        & F.lower(path).contains("/portal/")
        & (query.contains("departmentId=") | query.contains("departmentid="))
    )
    hub = ((host == "bonfirehub.com") | host.endswith(".bonfirehub.com")) & ~path.rlike(r"(?i)^/opportunities/\d+")
    in_bids = path.rlike(r"(?i)/Bids/[^/?#]+")
    anchors = (
        found.where(F.col("tag") == "a")
        .withColumn("_target", resolve_href(href, F.col(url)))
        .where(~href.rlike(r"(?i)\.pdf($|\?)") & ~href.rlike("(?i)^javascript:"))
        .where(~href.rlike(non_http) & ~target.rlike(non_http))
        .where(~is_template_href(href) & ~is_template_href(target))
        .where(~filtered_portal & ~same_document(target, F.col(url)) & ~hub)
        .withColumn("in_bids", in_bids)
        .withColumn(
            "TITLE",
            F.when(
                (F.octet_length("link_text") < 5) & F.col("in_bids"), F.coalesce(detail_path_title(target), F.lit(""))
            ).otherwise(F.col("link_text")),
        )
        .where(F.octet_length("TITLE") >= 5)
        .where(F.col("in_bids") | F.lower(F.concat(F.col("TITLE"), F.lit(" "), target)).rlike(words))
        .select(key, F.col("pos").cast("bigint").alias("pos"), trimmed("TITLE").alias("TITLE"), target.alias("URL"))
    )
    raw = F.regexp_extract_all(text(html), F.lit(r"""(?i)\bhref=(["'])(/Bids/[^"']+)\1"""), F.lit(2))
    scanned = (
        pages.select(key, url, F.posexplode(raw).alias("p", "href"))
        .withColumn("_target", resolve_href(F.col("href"), F.col(url)))
        .where(~same_document(target, F.col(url)))
        .withColumn("TITLE", detail_path_title(target))
        .where(F.octet_length("TITLE") >= 5)
        # After every anchor of the page.
        .select(key, (F.col("p") + F.lit(1 << 40)).alias("pos"), "TITLE", target.alias("URL"))
    )
    return dedupe_links(anchors.unionByName(scanned), key, "URL", "pos")


def prioritize_links(
    links: DataFrame, listings: DataFrame, *, key: str = "page_id", body: str = "text", pos: str = "pos", cap: int | None = None
) -> DataFrame:
    """Links whose title is followed by `Status: Open` within 400 characters of the listing text come first.

    Order is otherwise kept. `cap` keeps the first links of each page.
    """
    title = F.replace(trimmed("TITLE"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?is)\\Q"), title, F.lit("\\E.{0,400}?Status:\\s*Open"))
    joined = links.join(listings.select(key, F.col(body).alias("_body")), key, "left")
    flagged = joined.withColumn(
        "is_open", F.coalesce((trimmed("TITLE") != "") & F.regexp_like("_body", pattern), F.lit(False))
    ).drop("_body")
    order = Window.partitionBy(key).orderBy(F.desc("is_open"), pos)
    if cap is None:
        return flagged.withColumn("priority", F.row_number().over(order))
    salted = Window.partitionBy(key, "_salt").orderBy(F.desc("is_open"), pos)
    first = (
        flagged.withColumn("_salt", F.pmod(F.xxhash64("URL"), F.lit(16)))
        .withColumn("_r", F.row_number().over(salted))
        .where(F.col("_r") <= cap)
        .drop("_salt", "_r")
    )
    return first.withColumn("priority", F.row_number().over(order)).where(F.col("priority") <= cap)


# ---------------------------------------------------------------- texts

def primary_description(
    pages: DataFrame, *, url: str = "url", body: str = "text", host: str = S.TRADE_JOURNAL_HOST, min_chars: int = 120
) -> DataFrame:
    """Put the project description of trade-journal pages in front of their text; other pages stay as they are."""
    t = F.regexp_replace(text(body), r"\r\n?", "\n")
    stop = r"(?=\n\s*PDF\s+ATTACHMENTS\b|\nBack\s+To\s+Trade\s+Journal\b|\z)"
    page_host = F.lower(F.regexp_extract(text(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))

    def block(label: str) -> Column:
        b = trimmed(F.regexp_extract(t, rf"(?isU)PROJECT\s+{label}\s*:?\s*\n?(.+?)" + stop, 1))
        return F.when(F.char_length(b) >= min_chars, F.regexp_replace(b, r"\n{3,}", "\n\n"))

    found = F.when(page_host.contains(host), F.coalesce(block("DETAILS"), block("DESCRIPTION")))
    head = (
        "--- PRIMARY PROJECT DESCRIPTION (use the full text below for DESCRIPTION; do not replace with a short "
        "metadata summary) ---\n\n"
    )
    return pages.withColumn("primary_description", found).withColumn(
        body, F.when(found.isNotNull(), F.concat(F.lit(head), found, F.lit("\n\n--- PAGE TEXT ---\n\n"), F.col(body))).otherwise(F.col(body))
    )


def join_document_texts(
    documents: DataFrame, *, key: str = "listing_url", pos: str = "pos", body: str = "text", cap: int | None = None
) -> DataFrame:
    """Texts of the documents of a page or listing in order, joined by a separator.

    The result of a listing is one text by definition, so it must fit one row; `cap` keeps the first documents.
    """
    full = documents.where(text(body) != "")
    if cap is not None:
        salted = Window.partitionBy(key, "_salt").orderBy(pos)
        merged = Window.partitionBy(key).orderBy(pos)
        full = (
            full.withColumn("_salt", F.pmod(F.xxhash64(pos), F.lit(16)))
            .withColumn("_r", F.row_number().over(salted))
            .where(F.col("_r") <= cap)
            .withColumn("_r", F.row_number().over(merged))
            .where(F.col("_r") <= cap)
        )
    collected = full.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, body))).alias("_d"))
    return collected.select(
        key,
        F.array_join(F.transform("_d", lambda d: d[body]), S.DOCUMENT_SEPARATOR).alias("document_text"),
        F.size("_d").cast("bigint").alias("documents"),
    )


def excerpt_budget(
    pages: DataFrame,
    *,
    key: str = "page_id",
    listing: str = "listing_url",
    caps: dict[str, int],
    budget: int,
    passes: int = 3,
) -> DataFrame:
    """Cut the text columns of each page to their caps, then shrink them in proportion until a listing fits its budget.

    The passes run on lengths alone; the texts are joined back once by page, so a listing with very many pages is spread.
    """
    columns = list(caps)
    lengths = pages.select(
        key,
        F.col(listing).cast("string").alias("_listing"),
        *[F.least(F.char_length(text(c)), F.lit(n)).cast("bigint").alias(f"_n_{c}") for c, n in caps.items()],
    )
    # A few numbers per page; every pass reads them twice.
    lengths = cut_lineage(lengths)
    for _ in range(passes):
        total = sum((F.col(f"_n_{c}") for c in columns), F.lit(0).cast("bigint"))
        sums = lengths.groupBy("_listing").agg(F.sum(total).alias("_total"))
        over = F.col("_total") > budget
        ratio = F.lit(float(budget)) / F.col("_total")
        lengths = (
            lookup_join(lengths, sums, "_listing", ["_total"])
            .withColumns(
                {
                    f"_n_{c}": F.when(over, F.floor(F.col(f"_n_{c}") * ratio).cast("bigint")).otherwise(F.col(f"_n_{c}"))
                    for c in columns
                }
            )
            .drop("_total")
        )
    sized = pages.join(lengths.drop("_listing"), key)
    cut = {c: F.substring(text(c), F.lit(1), F.col(f"_n_{c}").cast("int")) for c in columns}
    return sized.withColumns(cut).select(*pages.columns)
