"""SQL oracles of the queries, for a second engine that sees the given tables as views.

Written from the rules, not from the Spark expressions: a plain restatement in SQL to compare results with.
"""

from __future__ import annotations

from tenderflow.functions import signals as S
from tenderflow.plans.adapters import NOW, oracle_ctes

ORACLES: dict[str, str] = {}

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(13)"
NOW_TS = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"
TODAY = f"DATE '{NOW:%Y-%m-%d}'"
# The month of NOW and the day of NOW in Manila, as UTC bounds.
MONTH = ("TIMESTAMP '2023-12-31 16:00:00'", "TIMESTAMP '2024-01-31 16:00:00'")
DAY = ("TIMESTAMP '2024-01-19 16:00:00'", "TIMESTAMP '2024-01-20 16:00:00'")
RECENT = "TIMESTAMP '2023-07-24 00:00:00'"


def add(name: str, tables: str, body: str, more: str = "", recursive: bool = False) -> None:
    ctes = [oracle_ctes(*tables.split())] if tables else []
    if more:
        ctes.append(more)
    head = ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n") if ctes else ""
    ORACLES[name] = head + body


def tx(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def tr(x: str) -> str:
    return f"trim({tx(x)}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({tx(x)}, '\\s+', ' ', 'g'), {WS})"


def wid(x: str) -> str:
    return f"greatest(coalesce({x}, 0), 0)"


def url_key(x: str) -> str:
    return f"rtrim(regexp_replace(regexp_replace(lower({tr(x)}), '^https?://', ''), '^www\\.', ''), '/')"


def listing_key(x: str) -> str:
    return f"rtrim(lower({tr(x)}), '/')"


def title_key(x: str) -> str:
    plain = f"regexp_replace({tr(x)}, '^corporate:', '', 'i')"
    return f"lower(regexp_replace(trim({plain}, {WS}), '\\s+', ' ', 'g'))"


def project_key(x: str) -> str:
    return f"CASE WHEN regexp_matches({tr(x)}, '^[0-9]{{5,8}}$') THEN {tr(x)} ELSE '' END"


def day_of(x: str) -> str:
    """Day of the date texts that the extracts hold."""
    return (
        f"CASE WHEN regexp_matches({tr(x)}, '^\\d{{4}}-') THEN CAST(substr({tr(x)}, 1, 10) AS DATE)"
        f" WHEN regexp_matches({tr(x)}, '^\\d+/\\d+/\\d{{4}}$') THEN CAST(strptime({tr(x)}, '%m/%d/%Y') AS DATE)"
        f" WHEN regexp_matches({tr(x)}, '^[A-Z][a-z]+ \\d+, \\d{{4}}$') THEN CAST(strptime({tr(x)}, '%B %d, %Y') AS DATE) END"
    )


def identity(table: str, ident: str, end: str, source: str = "BID_URL_ID", title: str = "TITLE", url: str = "URL", naics: str = "NAICSCODE") -> str:
    return f"""SELECT *, {url_key(url)} AS url_key, lower({tr(url)}) AS raw_url, lower({tr('SOLICITATIONNUMBER')}) AS sol_key,
  lower({tr('THIRD_PARTY_IDENTIFIER')}) AS tp_key, {wid(source)} AS source_key, {end} AS end_day, {title_key(title)} AS title_key,
  {project_key(naics)} AS project_key FROM {table}"""


STRONG = "contains(url_key, '/')"
TIER_A = f"({STRONG} OR sol_key <> '' OR tp_key <> '' OR (project_key <> '' AND source_key > 0))"

EMAIL = (
    r"^[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*"
    r"@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9]*(-[A-Za-z0-9]+)*$"
)


def is_email(x: str) -> str:
    return f"(regexp_matches({x}, '{EMAIL}') AND length({x}) <= 254)"


def first_email(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array({tr(x)}, '[\\s,;|]+'), lambda p: p <> '' AND {is_email('p')})"
    return f"CASE WHEN lower({tr(x)}) <> 'not provided' THEN {parts}[1] END"


def email_in_text(x: str) -> str:
    found = f"regexp_extract_all({tx(x)}, '\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})\\b', 1)"
    return f"list_filter({found}, lambda p: {is_email('p')})[1]"


def comparable_email(x: str) -> str:
    s = f"lower({tr(x)})"
    return f"CASE WHEN NOT contains({s}, 'not provided') AND {is_email(s)} THEN {s} ELSE '' END"


def posting(x: str) -> str:
    s = f"lower({collapse(x)})"
    return (
        f"CASE WHEN {s} = '' OR contains({s}, 'not provided') THEN 'uncertain'"
        f" WHEN {s} IN ('private_company', 'government', 'uncertain') THEN {s}"
        f" WHEN regexp_matches({s}, 'private[\\s_-]*company|^corporate$') THEN 'private_company'"
        f" WHEN regexp_matches({s}, '^government$|^gov$|public sector|public agency|municipal|county ') THEN 'government'"
        " ELSE 'uncertain' END"
    )


def words(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def has_any(x: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v}')" for v in values) + ")"


def valid_naics(c: str) -> str:
    return (
        f"(regexp_matches({c}, '^\\d{{2,6}}$') AND substr({c}, 1, 2) IN ({words(S.NAICS_SECTORS)})"
        f" AND NOT (length({c}) = 6 AND starts_with({c}, '926') AND {c} NOT IN ({words(S.NAICS_926)})))"
    )


def host_of(x: str) -> str:
    full = f"CASE WHEN regexp_matches({tr(x)}, '^(?i)[a-z][a-z0-9+.-]*:/') THEN {tr(x)} ELSE 'https://' || {tr(x)} END"
    return f"regexp_replace(lower(regexp_extract({full}, '^(?i)[a-z][a-z0-9+.-]*://([^/?#:@]+)', 1)), '^www\\.', '')"


def is_portal_host(h: str) -> str:
    suffix = " OR ".join(f"{h} = '{s}' OR ends_with({h}, '.{s}')" for s in S.PORTAL_HOST_SUFFIXES)
    return f"({h} <> '' AND ({has_any(h, S.PORTAL_MARKERS)} OR {suffix}))"


def portal(x: str) -> str:
    return has_any(f"lower({tr(x)})", S.PORTAL_MARKERS)


def source_label(name: str, url: str) -> str:
    return f"CASE WHEN {tr(url)} = '' THEN NULL WHEN {tr(name)} <> '' THEN {tr(name)} || ' — ' || {tr(url)} ELSE {tr(url)} END"


def entity_label() -> str:
    n, e = collapse("name"), comparable_email("email")
    return (
        f"CASE WHEN {n} = '' THEN 'Entity' ELSE {n} END || ' (#' || CAST(id AS VARCHAR) || ')'"
        f" || CASE WHEN {e} <> '' THEN ' · ' || {e} ELSE '' END"
    )


def state_label() -> str:
    n, a = tr("name"), f"upper({tr('abbreviation')})"
    return f"CASE WHEN {n} <> '' AND {a} <> '' THEN {a} || ' — ' || {n} WHEN {n} <> '' THEN {n} WHEN {a} <> '' THEN {a} END"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S+00:00')"


DIRECTORY = f"""directory AS (SELECT id, CASE WHEN first_last <> '' THEN first_last WHEN {tr('NAME')} <> '' THEN {tr('NAME')} ELSE 'Unnamed' END AS label
 FROM (SELECT *, trim({tr('FIRSTNAME')} || ' ' || {tr('LASTNAME')}) AS first_last FROM "users" WHERE TIME_ZONE = 'Asia/Manila'))"""

# ---------------------------------------------------------------- sources and sinks

LINES = """src_lines AS (SELECT c_custkey + 1 AS line_no, 'https://agency' || CAST(c_custkey % 700 AS VARCHAR) || '.gov/Bids' AS url,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Office ' || CAST(c_custkey * 7 % 1100 AS VARCHAR) END AS name, c_custkey AS k
 FROM customer WHERE c_custkey % 17 <> 3),
 open_lines AS (SELECT *, row_number() OVER (ORDER BY line_no) AS n,
   ['u|' || url] || CASE WHEN name = '' THEN [] ELSE ['n|' || name] END AS keys FROM src_lines
  WHERE url NOT IN (SELECT url FROM "bid_url" WHERE scrape_group = 'Test')
   AND name NOT IN (SELECT name FROM "bid_url" WHERE scrape_group = 'Test' AND coalesce(name, '') <> '')),
 walk(n, line_no, kept, seen) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT o.n, o.line_no, NOT list_has_any(w.seen, o.keys),
    CASE WHEN list_has_any(w.seen, o.keys) THEN w.seen ELSE w.seen || o.keys END
  FROM walk w JOIN open_lines o ON o.n = w.n + 1)"""
add("import_source_list", "bid_url", """SELECT l.line_no, l.url, l.name,
  CASE WHEN k % 3 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS start_time, CAST(NULL AS TIMESTAMP) AS end_time,
  k % 40 AS weight, k % 60 AS user_id, CAST(0 AS BIGINT) AS check_changes, CAST(1 AS BIGINT) AS visit_required,
  '99000000000000000' || CAST(k % 900 + 100 AS VARCHAR) AS checksum, 1 AS valid, CAST(0 AS BIGINT) AS third_party_url_id,
  'Test' AS scrape_group
FROM open_lines l JOIN walk w ON w.line_no = l.line_no AND w.kept""", LINES, recursive=True)

add("parse_model_responses", "responses", f"""SELECT listing_url, source_id, pos, is_fallback,
  coalesce(title, url_title) AS "TITLE", coalesce(enddate, '') AS "ENDDATE", coalesce(naics, '') AS "NAICSCODE",
  CASE WHEN coalesce(detail, '') IN ('', '0') THEN listing_url ELSE detail END AS "URL", '' AS "BID_CATEGORY", '' AS "LOCATION_STATE",
  {posting('posting')} AS "POSTING_ENTITY", coalesce({first_email('email')}, '') AS "CONTACT_EMAIL", coalesce(org, '') AS "ISSUING_ORGANIZATION",
  CASE WHEN is_fallback THEN backup ELSE regexp_replace(CASE WHEN coalesce(descr, '') = '' THEN backup ELSE descr END, '\\n{{3,}}', chr(10) || chr(10), 'g') END AS "DESCRIPTION",
  coalesce(sol, '') AS "SOLICITATIONNUMBER", '' AS "THIRD_PARTY_IDENTIFIER"
FROM (SELECT listing_url, source_id, coalesce(idx - 1, 0) AS pos, b IS NULL AS is_fallback, 'Bids' AS seg, 'Bids' AS url_title,
   CASE WHEN coalesce(pdf_text, '') <> '' THEN pdf_text WHEN coalesce(page_text, '') <> '' THEN page_text ELSE '{S.NO_TEXT}' END AS backup,
   b->>'$.TITLE' AS title, CASE WHEN json_type(b, '$.ENDDATE') = 'ARRAY' THEN b->>'$.ENDDATE[0]' ELSE b->>'$.ENDDATE' END AS enddate,
   b->>'$.NAICSCODE' AS naics, b->>'$.URL' AS detail, b->>'$.POSTING_ENTITY' AS posting,
   (b->>'$.CONTACT_EMAIL[0]') || ' ' || (b->>'$.CONTACT_EMAIL[1]') AS email, b->>'$.ISSUING_ORGANIZATION' AS org,
   b->>'$.DESCRIPTION' AS descr, b->>'$.SOLICITATIONNUMBER' AS sol
  FROM (SELECT *, unnest(CASE WHEN len(bids) > 0 THEN bids ELSE [NULL] END) AS b, unnest(CASE WHEN len(bids) > 0 THEN range(1, len(bids) + 1) ELSE [NULL] END) AS idx
   FROM (SELECT *, CASE WHEN json_valid(raw_json) THEN CAST(json_extract(raw_json, '$.bids') AS JSON[]) ELSE [] END AS bids FROM "responses")))""")

add("load_reference_table", "", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS website FROM customer")


def cell(x: str, number: bool = False) -> str:
    escaped = f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;')"
    kind = f"CASE WHEN regexp_matches({x}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') AND NOT contains({x}, '.') THEN 'Number' ELSE 'String' END"
    return f"'<Cell><Data ss:Type=\"' || {kind} || '\">' || {escaped} || '</Data></Cell>'"


add("export_unassigned", "BIDURL", f"""SELECT '<Row>' || {cell('CAST(ID AS VARCHAR)')} || {cell(tx('URL'))} || {cell(tx('NAME'))}
  || {cell("coalesce(strftime(END_TIME, '%Y-%m-%d %H:%M:%S'), '')")} || '</Row>' AS value
FROM "BIDURL" WHERE coalesce(USER_ID, 0) = 0""")

# ---------------------------------------------------------------- listings

SCRAPED = '(SELECT id FROM "bid_url" WHERE last_scraped_at IS NOT NULL)'
add("list_live_bids", "bid bid_url", f"""SELECT ID, TITLE, URL, CREATED, BID_URL_ID - 1000 AS BID_URL_ID FROM "bid"
WHERE CREATED >= {RECENT} AND (contains(lower(TITLE), 'road') OR contains(lower(NAICSCODE), 'road') OR contains(lower(URL), 'road'))
 AND BID_URL_ID - 1000 IN {SCRAPED} ORDER BY CREATED DESC, ID DESC LIMIT 100""")
add("list_missing_entity", "bid", f"""SELECT ID, TITLE, CREATED, ENTITYID FROM "bid" WHERE CREATED >= {RECENT} AND coalesce(ENTITYID, 0) = 0
ORDER BY CREATED DESC, ID DESC LIMIT 100 OFFSET 100""")
add("list_missing_category", "bid", """SELECT ID, TITLE, CREATED, CATEGORYID FROM "bid" WHERE USERID = 7 AND coalesce(CATEGORYID, 0) = 0
ORDER BY CREATED DESC, ID DESC LIMIT 100""")
add("list_unassigned_sources", "BIDURL", """SELECT * FROM "BIDURL" WHERE coalesce(USER_ID, 0) = 0
 AND (contains(lower(URL), 'rivertown') OR contains(lower(NAME), 'rivertown')) ORDER BY ID LIMIT 150 OFFSET 150""")
add("list_sources", "bid_url", """SELECT id, url, name, scrape_group FROM "bid_url" WHERE scrape_group = 'Test'
 AND (contains(lower(url), 'city') OR contains(lower(name), 'city')) ORDER BY id LIMIT 200""")
add("list_failed_sources", "failed_bid_urls", """SELECT id, url, name, failure_message, failed_at FROM "failed_bid_urls"
WHERE contains(lower(url), 'promo') OR contains(lower(name), 'promo') OR contains(lower(failure_message), 'promo')
ORDER BY failed_at DESC, id DESC LIMIT 200""")
add("list_pending", "bids_temp entity", f"""SELECT p.id, TITLE, URL, created_at, e.label AS entity_label FROM (SELECT * FROM "bids_temp"
  WHERE contains(lower(TITLE), 'supply') OR contains(lower(URL), 'supply') OR contains(lower(bid_url_name), 'supply') OR contains(lower(NAICSCODE), 'supply')
  ORDER BY id, created_at LIMIT 200 OFFSET 400) p LEFT JOIN (SELECT id, {entity_label()} AS label FROM "entity") e ON e.id = p.ENTITYID""")
add("list_recent_issues", "scrape_logs", """SELECT * FROM (SELECT * FROM "scrape_logs" ORDER BY created_at DESC, id DESC LIMIT 200)
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50""")
NOT_EXPIRED = f"(ENDDATE IN ('', '0') OR coalesce(({day_of('ENDDATE')}) >= {TODAY}, false))"
add("drop_expired", "extract", f'SELECT doc_id, ENDDATE FROM "extract" WHERE {NOT_EXPIRED}')
add("select_sources_to_scrape", "bid_url", f"""SELECT id, url, CASE WHEN {tr('url')} = '' THEN 'missing_url'
 WHEN NOT regexp_matches({tr('url')}, '^(?i)https?://[^\\s/?#]+') THEN 'invalid_url'
 WHEN CAST(last_scraped_at AS DATE) = {TODAY} THEN 'scraped_today' ELSE 'due' END AS scrape_status FROM "bid_url" """)
add("manual_entry_eligible", "bid_url", f"""SELECT id, url FROM "bid_url"
WHERE coalesce(CAST(coalesce(last_scraped_at, end_time) AS DATE) <> {TODAY}, true)""")
add("directory_users", "users", "SELECT id, label FROM directory", DIRECTORY)

LABELS = f"""e_l AS (SELECT id, {entity_label()} AS label FROM "entity"), s_l AS (SELECT id, {state_label()} AS label FROM "state"),
 u_l AS (SELECT ID AS id, {source_label('NAME', 'URL')} AS label FROM "BIDURL")"""


def label_of(side: str, ident: str, unknown: str) -> str:
    return f"CASE WHEN coalesce({ident}, 0) > 0 THEN coalesce({side}.label, '{unknown}' || CAST({ident} AS VARCHAR)) ELSE '—' END"


LABELLED = """"bid" b LEFT JOIN e_l ON e_l.id = b.ENTITYID AND b.ENTITYID > 0 LEFT JOIN s_l ON s_l.id = b.STATEID AND b.STATEID > 0
 LEFT JOIN u_l ON u_l.id = b.BID_URL_ID AND b.BID_URL_ID > 0"""
LABEL_COLUMNS = f"""{label_of('e_l', 'b.ENTITYID', 'Entity #')} AS entity, {label_of('s_l', 'b.STATEID', 'State #')} AS state,
 {label_of('u_l', 'b.BID_URL_ID', 'Bid URL #')} AS bid_url"""
ADDED = f"""SELECT b.ID AS id, {tx('b.TITLE')} AS title, {LABEL_COLUMNS}, {iso('b.CREATED')} AS created,
 strftime(b.CREATED + INTERVAL 8 HOUR, '%b %-d, %Y') AS created_display FROM {LABELLED}
 WHERE b.CREATED >= {MONTH[0]} AND b.CREATED < {MONTH[1]} AND b.USERID IN (SELECT id FROM directory WHERE id > 0)"""
add("bids_added_listing", "bid users entity state BIDURL", ADDED, DIRECTORY + ", " + LABELS)
add("filter_report_rows", "bid users entity state BIDURL", f"""SELECT * FROM ({ADDED})
WHERE contains(lower(title || ' ' || entity || ' ' || bid_url || ' ' || state || ' ' || created_display || ' ' || created), 'rfp 1')""", DIRECTORY + ", " + LABELS)
add("attach_report_labels", "bid entity state BIDURL", f"SELECT b.ID, {LABEL_COLUMNS} FROM {LABELLED}", LABELS)

# ---------------------------------------------------------------- columns

add("derive_identity_keys", "bids_temp", f"""SELECT id, url_key, raw_url, {STRONG} AS strong_url, sol_key, tp_key, source_key, end_day, title_key,
 title_key AS raw_title_key, project_key, {TIER_A} AS has_tier_a FROM k""", f"k AS ({identity('bids_temp', 'id', 'CAST(ENDDATE AS DATE)')})")
FINGERPRINT = """[CASE WHEN url_key <> '' THEN 'url:' || url_key END, CASE WHEN sol_key <> '' THEN 'sol:' || sol_key END,
 CASE WHEN tp_key <> '' THEN 'tp:' || tp_key END,
 CASE WHEN source_key > 0 AND end_day IS NOT NULL AND title_key <> '' THEN 'bc:' || CAST(source_key AS VARCHAR) || ':' || CAST(end_day AS VARCHAR) || ':' || title_key END,
 CASE WHEN source_key > 0 AND project_key <> '' THEN 'naics:' || CAST(source_key AS VARCHAR) || ':' || project_key END]"""
add("fingerprint_keys", "bid", f"SELECT * FROM (SELECT ID, unnest({FINGERPRINT}) AS fingerprint FROM k) WHERE fingerprint IS NOT NULL",
    f"k AS ({identity('bid', 'ID', 'CAST(ENDDATE AS DATE)')})")
add("url_variants", "bid", f"""SELECT DISTINCT ID, unnest([{tr('URL')}, {url_key('URL')}, 'https://' || {url_key('URL')}, 'http://' || {url_key('URL')},
 'https://www.' || {url_key('URL')}, 'http://www.' || {url_key('URL')}]) AS variant FROM "bid" WHERE {url_key('URL')} <> ''""")


def cleaned(x: str) -> str:
    keep = f"{tr('l')} <> '' AND NOT contains(lower({tr('l')}), 'not provided') AND NOT starts_with(lower({tr('l')}), 'naics')"
    return f"trim(coalesce(array_to_string(list_filter(regexp_split_to_array({tx(x)}, '\\r\\n|\\r|\\n'), lambda l: {keep}), chr(10)), ''), {WS})"


add("clean_description", "bid extract", f"""SELECT 'bid' AS kind, ID AS id, {cleaned('DESCRIPTION')} AS description FROM "bid"
UNION ALL SELECT 'extract', doc_id, {cleaned('DESCRIPTION')} FROM "extract" """)
add("resolve_contact_email", "bid extract", f"""SELECT 'extract' AS kind, doc_id AS id, coalesce({first_email('CONTACT_EMAIL')}, {email_in_text('DESCRIPTION')}) AS email FROM "extract"
UNION ALL SELECT 'bid', ID, coalesce({first_email('EMAIL')}, {email_in_text('DESCRIPTION')}) FROM "bid" """)


def naics_sql(field: str, desc: str, title: str, url: str) -> str:
    f = f"CASE WHEN contains(lower({tr(field)}), 'census.gov/naics') AND regexp_extract({tr(field)}, '[?&]input=([^&#]*)', 1) <> '' THEN regexp_extract({tr(field)}, '[?&]input=([^&#]*)', 1) WHEN lower({tr(field)}) = 'not provided' THEN '' ELSE {tr(field)} END"

    def checked(e: str) -> str:
        return f"CASE WHEN {valid_naics(e)} THEN {e} END"

    first = [checked(f"regexp_extract({x}, '(\\d{{2,6}})', 1)") for x in (f"({f})", tx(desc), tx(title), tx(url))]
    labelled = [checked(f"regexp_extract({tx(x)}, '(?i)NAICS[^0-9]{{0,10}}(\\d{{2,6}})', 1)") for x in (desc, title, url)]
    low = f"lower({tx(desc)} || ' ' || {tx(title)})"
    keyword = "CASE " + " ".join(f"WHEN {has_any(low, ws)} THEN '{code}'" for ws, code in S.NAICS_KEYWORDS) + " END"
    return f"coalesce({first[0]}, {', '.join(labelled)}, {keyword}, {', '.join(first[1:])}, '{S.NAICS_DEFAULT}')"


add("normalize_naics", "extract", f"""SELECT doc_id, {naics_sql('NAICSCODE', 'DESCRIPTION', 'TITLE', 'listing_url')} AS naics FROM "extract" """)
PREFIXED = f"CASE WHEN {tr('TITLE')} <> '' AND {posting('POSTING_ENTITY')} = 'private_company' AND NOT regexp_matches({tr('TITLE')}, '^(?i)Corporate\\s*:\\s+') THEN 'Corporate: ' || {tr('TITLE')} ELSE TITLE END"
add("corporate_prefix", "extract", f'SELECT doc_id, {PREFIXED} AS title FROM "extract"')
add("normalize_posting_entity", "extract", f'SELECT doc_id, POSTING_ENTITY, {posting("POSTING_ENTITY")} AS posting_entity FROM "extract"')


def org_sql(x: str) -> str:
    s = collapse(x)
    bare = s
    for p in S.PORTAL_VENDOR_PATTERNS:
        bare = f"trim(regexp_replace({bare}, '(?i){p}', '', 'g'), {WS})"
    bare = f"trim({bare}, {WS} || ',-·|—–')"
    return f"CASE WHEN {s} = '' OR lower({s}) IN ('not provided', 'n/a') OR length({bare}) < 3 THEN '' ELSE {bare} END"


TAGS = "<!--.*?-->|</?[A-Za-z!?][^>]*>?"
ADDRESS_LINES = f"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({tr('DESCRIPTION')}, '{TAGS}', '', 'gs'), '\\r\\n|\\r', chr(10), 'g'), chr(10)),
 lambda v: trim(regexp_replace(v, '[ \\t]+', ' ', 'g'), {WS})), lambda v: v <> ''), chr(10))"""
MISSING = "({x} = '' OR starts_with(lower({l}), 'not provided') OR lower({l}) IN (" + words(S.SNIPPET_PLACEHOLDERS) + "))"
add("normalize_contact_fields", "extract", f"""SELECT doc_id, organization, phone, length(address) AS address_chars,
 md5(CASE WHEN address = '' AND phone = '' THEN lang ELSE rtrim(lang) || chr(10) || chr(10) || '---' || chr(10) || '**Issuing entity — address & phone**'
  || CASE WHEN address <> '' THEN chr(10) || 'Address: ' || address ELSE '' END || CASE WHEN phone <> '' THEN chr(10) || 'Phone: ' || phone ELSE '' END END) AS block_md5
FROM (SELECT doc_id, lang, organization,
  CASE WHEN {MISSING.format(x='ph', l='ph')} THEN '' ELSE ph END AS phone,
  CASE WHEN {MISSING.format(x='ad', l="trim(string_split(ad, chr(10))[1])")} THEN '' ELSE ad END AS address
 FROM (SELECT doc_id, lang, {org_sql('ISSUING_ORGANIZATION')} AS organization, {collapse('CONTACT_EMAIL')} AS ph, coalesce({ADDRESS_LINES}, '') AS ad FROM "extract"))""")
add("flatten_description", "", """SELECT 'event' AS kind, event_id AS id, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), chr(10)) AS description FROM events
UNION ALL SELECT 'document', doc_id, regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') FROM documents""")


def url_title(longer: int, default: str, skip: bool) -> str:
    path = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    parts = f"list_filter(string_split(trim({path}, '/'), '/'), lambda p: {'p <> chr(48) AND length(p) > 0' if skip else 'true'})"
    telling = f"list_filter({parts}, lambda p: strlen(p) > {longer} AND NOT regexp_matches(p, '^[0-9.]+$'))"
    last = f"coalesce({telling}[-1], {parts}[-1], '')"
    spaced = f"url_decode(regexp_replace({last}, '-|_|%20', ' ', 'g'))"
    cap = f"array_to_string(list_transform(string_split(lower({spaced}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"CASE WHEN coalesce({cap}, '') IN ('', '0') THEN '{default}' ELSE {cap} END"


add("title_from_url", "", f"SELECT page_id, url, {url_title(5, 'Bidding Page', False)} AS page_title, {url_title(3, 'Document', True)} AS document_title FROM pages")

DESC, LINK = "lower(DESCRIPTION)", "lower(listing_url)"
BIDW = S.BID_WORDS
VERDICT = f"""CASE WHEN end_day IS NULL AND NOT {TIER_A} THEN 'no_end_date_or_stable_key' WHEN strlen({tr('TITLE')}) < 5 THEN 'short_title'
 WHEN lower({tr('TITLE')}) IN ({words(S.GENERIC_TITLES)}) THEN 'generic_title' WHEN regexp_matches({tr('TITLE')}, '(?i){BIDW}') THEN 'keyword_in_title'
 WHEN regexp_matches({DESC}, '(?i){BIDW}') THEN 'keyword_in_description' WHEN regexp_matches({LINK}, '(?i){BIDW}') THEN 'keyword_in_url'
 WHEN strlen({DESC}) < 120 THEN 'thin_description' WHEN {has_any(DESC, S.GEO_BLOCK_PHRASES)} THEN 'blocked_phrase' ELSE 'substantial' END"""
EXTRACT_KEYS = f"k AS ({identity('extract', 'doc_id', day_of('ENDDATE'), source='source_id')})"
add("classify_bid_like", "extract", f"""SELECT doc_id, reason IN ('keyword_in_title', 'keyword_in_description', 'keyword_in_url', 'substantial') AS is_bid, reason
FROM (SELECT doc_id, {VERDICT} AS reason FROM k)""", EXTRACT_KEYS)

HINT = "regexp_replace(split_part(host, '.', 1), '[-_]+', ' ', 'g')"
add("url_host_and_portal", "BIDURL bid_url", f"""SELECT url, CASE WHEN {tr('url')} = '' THEN '' ELSE host END AS host, {is_portal_host('host')} AS is_portal,
 CASE WHEN {is_portal_host('host')} AND len(string_split(host, '.')) >= 3 AND length(split_part(host, '.', 1)) >= 4 AND regexp_matches(split_part(host, '.', 1), '[-_]')
  THEN array_to_string(list_transform(list_filter(string_split({HINT}, ' '), lambda w: length(w) >= 2), lambda w: upper(w[1]) || w[2:]), ' ') ELSE '' END AS hint
FROM (SELECT url, CASE WHEN {tr('url')} = '' THEN '' ELSE {host_of('url')} END AS host FROM (SELECT url FROM pages UNION ALL SELECT URL FROM "BIDURL" UNION ALL SELECT url FROM "bid_url"))""")

CANON = f"trim(regexp_replace(regexp_replace(lower({collapse('name')}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
CANON_CASE = """CASE WHEN regexp_matches(n, '^city and county of .+$') THEN trim(substr(n, 20)) || ' city county'
 WHEN regexp_matches(n, '^.+\\s+city of$') THEN trim(regexp_extract(n, '^(.+)\\s+city of$', 1)) || ' city'
 WHEN regexp_matches(n, '^city of .+$') THEN trim(substr(n, 9)) || ' city' WHEN regexp_matches(n, '^county of .+$') THEN trim(substr(n, 11)) || ' county' ELSE n END"""
add("entity_name_keys", "entity", f"""SELECT id, canonical, (SELECT coalesce(string_agg(w, ' | ' ORDER BY i), '') FROM (SELECT w, min(i) AS i FROM (SELECT unnest(string_split(canonical, ' ')) AS w, generate_subscripts(string_split(canonical, ' '), 1) AS i)
  WHERE length(w) >= 3 AND w NOT IN ({words(S.NAME_STOP_WORDS)}) GROUP BY w)) AS tokens
FROM (SELECT id, {CANON_CASE} AS canonical FROM (SELECT id, {CANON} AS n FROM "entity"))""")


def hint_sql(x: str) -> str:
    s = f"trim(regexp_replace({tx(x)}, '{TAGS}', '', 'gs'), {WS})"
    return f"CASE WHEN lower({s}) IN ('not provided', 'n/a') THEN '' ELSE {s} END"


BLOB = "(TITLE || ' ' || DESCRIPTION)"
STATE_HINT = f"CASE WHEN {hint_sql('LOCATION_STATE')} <> '' THEN {hint_sql('LOCATION_STATE')} ELSE coalesce(list_filter(regexp_extract_all({BLOB}, '\\b([A-Z]{{2}})\\b', 1), lambda v: v IN ({words(S.US_STATES)}))[1], '') END"
CAT_TEXT = f"trim(CASE WHEN regexp_matches({BLOB}, '(?i)commodity\\s*[/:]\\s*(.+)') THEN regexp_extract({BLOB}, '(?i)commodity\\s*[/:]\\s*(.+)', 1) ELSE regexp_extract({BLOB}, '(?i)category\\s*[/:]\\s*(.+)', 1) END, {WS})"
add("geo_and_category_hints", "extract", f"""SELECT doc_id, {STATE_HINT} AS state_hint,
 CASE WHEN {hint_sql('BID_CATEGORY')} <> '' THEN {hint_sql('BID_CATEGORY')} ELSE {CAT_TEXT} END AS category_hint FROM "extract" """)

SLUG = "CASE WHEN TITLE = '' THEN 'Unknown-' || pk ELSE regexp_replace(substr(TITLE, 1, 40), '[^\\p{L}\\p{N}]', '-', 'g') || '-' || pk END"
TP_PK = f"CASE WHEN regexp_matches({tr('THIRD_PARTY_IDENTIFIER')}, '^\\d+$') THEN {tr('THIRD_PARTY_IDENTIFIER')}"
add("public_link", "bid", f"""SELECT ID, '{S.PUBLIC_LINK_BASE}' || {SLUG.replace('pk', 'pk1')} AS link, '{S.PUBLIC_LINK_BASE}' || {SLUG.replace('pk', 'pk2')} AS trusted_link
FROM (SELECT *, {TP_PK} END AS pk1, {TP_PK} ELSE CAST(ID AS VARCHAR) END AS pk2 FROM "bid")""")


def pairs_sql(record: str, table: str) -> str:
    return f"""SELECT {record} AS record, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT *, list_filter(regexp_split_to_array({tr('DESCRIPTION')}, '\\r?\\n+'), lambda v: v <> '' AND v <> '0') AS ls FROM "{table}")"""


add("description_pairs", "bid extract", f"""SELECT record, pos, CASE WHEN instr(line, ':') > 0 THEN trim(substr(line, 1, instr(line, ':') - 1), {WS}) ELSE '' END AS label,
 CASE WHEN instr(line, ':') > 0 THEN trim(substr(line, instr(line, ':') + 1), {WS}) ELSE trim(line, {WS}) END AS value
FROM ({pairs_sql("'bid ' || CAST(ID AS VARCHAR)", 'bid')} UNION ALL {pairs_sql("'doc ' || CAST(doc_id AS VARCHAR)", 'extract')})""")
add("option_labels", "entity state BIDURL", f"""SELECT 'entity' AS kind, id, {entity_label()} AS label FROM "entity"
UNION ALL SELECT 'state', id, {state_label()} FROM "state" WHERE {state_label()} IS NOT NULL
UNION ALL SELECT 'source', ID, {source_label('NAME', 'URL')} FROM "BIDURL" WHERE {tr('URL')} <> ''""")


def payload(kind: str, table: str, ident: str, created: str) -> str:
    return f"""SELECT b.{ident} AS record_id, '{kind}' AS source, CASE WHEN {tr('TITLE')} IN ('', '0') THEN 'Untitled' ELSE {tr('TITLE')} END AS "TITLE", {tx('DESCRIPTION')} AS "DESCRIPTION",
 {tr('b.EMAIL')} AS "EMAIL", {tr('URL')} AS "URL", {iso('ENDDATE')} AS "ENDDATE", {tr('NAICSCODE')} AS "NAICSCODE", {iso(created)} AS "CREATED",
 CASE WHEN ENTITYID > 0 THEN ENTITYID END AS "ENTITYID", CASE WHEN ENTITYID > 0 THEN coalesce(e_l.label, 'Entity #' || CAST(ENTITYID AS VARCHAR)) END AS entity_label
FROM "{table}" b LEFT JOIN e_l ON e_l.id = b.ENTITYID AND b.ENTITYID > 0"""


add("detail_payload", "bid bids_temp entity", payload("live", "bid", "ID", "coalesce(CREATED, LAST_MODIFIED)") + " UNION ALL " + payload("pending", "bids_temp", "id", "coalesce(created_at, CREATED)"),
    f'e_l AS (SELECT id, {entity_label()} AS label FROM "entity")')


def js(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'null' ELSE '\"' || {x} || '\"' END"


def jts(x: str) -> str:
    return js(f"strftime({x}, '%Y-%m-%dT%H:%M:%S')")


add("record_payload", "bid", f"""SELECT ID, '{{"CREATED":' || {jts('CREATED')} || ',"EMAIL":' || {js('EMAIL')} || ',"ENDDATE":' || {jts('ENDDATE')} || ',"ID":' || CAST(ID AS VARCHAR)
 || ',"NSN":' || {js('NSN')} || ',"TITLE":' || {js('TITLE')} || ',"USERID":' || CAST(USERID AS VARCHAR) || '}}' AS payload FROM "bid" """)
add("last_scraped", "bid_url", 'SELECT id, coalesce(last_scraped_at, end_time) AS last_scraped FROM "bid_url"')
add("apply_ingest_defaults", "extract users", f"""SELECT doc_id, CAST(10 AS BIGINT) AS "SUBSCRIPTIONTYPEID", CAST(1 AS BIGINT) AS "SETASIDECODEID", (SELECT max(id) FROM directory WHERE id = 4) AS "USERID",
 {NOW_TS} AS "CREATED", {NOW_TS} AS "LAST_MODIFIED", md5(CASE WHEN doc_id % 5 = 0 OR DESCRIPTION IN ('', '0') THEN '{S.NO_DESCRIPTION}' ELSE DESCRIPTION END) AS description_md5 FROM "extract" """, DIRECTORY)

# ---------------------------------------------------------------- linkage

REASON = ["normalized_url", "solicitation_number", "third_party_identifier", "bid_url_project_naics", "bid_url_enddate_title", "title_enddate"]


def matches(probe: str, stored: str, rid: str, table_rank: int, more: str = "true") -> str:
    """All hits of the probes in one stored table, one branch per reason."""
    cond = [
        f"contains(p.url_key, '/') AND s.raw_url = p.url_key AND s.raw_url <> '' AND (p.source_key = 0 OR s.source_key = p.source_key)",
        "p.sol_key <> '' AND s.sol_key = p.sol_key",
        "p.tp_key <> '' AND s.tp_key = p.tp_key",
        f"p.source_key > 0 AND p.project_key <> '' AND s.source_key = p.source_key AND lower({tr('s.NAICSCODE')}) = p.project_key",
        "p.source_key > 0 AND s.source_key = p.source_key AND s.end_day = p.end_day AND s.title_key = p.title_key AND p.title_key <> ''",
        "p.source_key = 0 AND s.end_day = p.end_day AND s.title_key = p.title_key AND p.title_key <> ''",
    ]
    raw = cond[0].replace("s.raw_url = p.url_key", "s.raw_url = p.raw_url")
    every = [(0, cond[0]), (0, raw), *[(i, c) for i, c in enumerate(cond) if i]]
    return "\nUNION ALL ".join(
        f"SELECT p.pid, {table_rank} AS t, {r} AS r, s.{rid} AS rid FROM {probe} p JOIN {stored} s ON {c} WHERE {more}" for r, c in every
    )


PK = f"pk AS ({identity('bids_temp', 'id', 'CAST(ENDDATE AS DATE)')}), lk AS ({identity('bid', 'ID', 'CAST(ENDDATE AS DATE)')})"
BEST = f"""SELECT pid AS {{pid}}, CASE WHEN r < 4 THEN 'A' WHEN r = 4 THEN 'B' ELSE 'C' END AS tier, CASE WHEN t = 0 THEN 'bids_temp' ELSE 'bid' END AS match_table,
 rid AS record_id, [{words(REASON)}][r + 1] AS reason FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY t, r, rid) AS n FROM hits) WHERE n = 1"""
add("match_duplicates", "bids_temp bid", BEST.format(pid="id"), PK + f""",
 pr AS (SELECT *, id AS pid FROM pk), hits AS ({matches('pr', 'pk', 'id', 0, 's.id <> p.pid')} UNION ALL {matches('pr', 'lk', 'ID', 1)})""")
add("match_duplicates_incoming", "bids_temp bid extract", BEST.format(pid="doc_id"), PK + f""",
 pr AS (SELECT *, doc_id AS pid FROM ({identity('extract', 'doc_id', day_of('ENDDATE'), source='source_id + 1000')})),
 hits AS ({matches('pr', 'pk', 'id', 0)} UNION ALL {matches('pr', 'lk', 'ID', 1)})""")
add("duplicate_outcome", "bids_temp bid", f"""SELECT CASE WHEN tier IS NULL THEN 'unique' ELSE 'duplicate' END AS outcome, tier, reason, count(*) AS n
FROM pk LEFT JOIN (SELECT id, tier, reason FROM ({BEST.format(pid='id')})) m USING (id) GROUP BY ALL""", PK + f""",
 pr AS (SELECT *, id AS pid FROM pk), hits AS ({matches('pr', 'lk', 'ID', 1)})""")

SHOWN = """source, id AS record_id, CASE WHEN tt = '' THEN 'Untitled' ELSE tt END AS title, strftime(ENDDATE, '%-m/%-d/%Y') AS end_date, uu AS url, ee AS email, strftime(scraped, '%-m/%-d/%Y') AS scraped"""
add("similar_bids", "bid bids_temp", f"""SELECT qid, CASE c WHEN 1 THEN 'entity' WHEN 2 THEN 'email' ELSE 'url' END AS match_type, CAST(n AS INTEGER) AS position, {SHOWN}
FROM (SELECT h.*, row_number() OVER (PARTITION BY qid ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, source, id) AS n FROM hits h
 JOIN (SELECT qid, min(c) AS c FROM hits GROUP BY qid) f USING (qid, c)) WHERE n <= 5""", f"""
 st AS (SELECT 'live' AS source, ID AS id, {tr('TITLE')} AS tt, ENDDATE, {tr('URL')} AS uu, {tr('EMAIL')} AS ee, coalesce(ENTITYID, 0) AS ent, coalesce(CREATED, LAST_MODIFIED) AS ts, CREATED AS scraped FROM "bid"
  UNION ALL SELECT 'pending', id, {tr('TITLE')}, ENDDATE, {tr('URL')}, {tr('EMAIL')}, coalesce(ENTITYID, 0), coalesce(created_at, CREATED), created_at FROM "bids_temp"),
 vals AS (SELECT source, id, unnest([CASE WHEN ent > 0 THEN '1|' || CAST(ent AS VARCHAR) END, CASE WHEN ee <> '' THEN '2|' || lower(ee) END, CASE WHEN uu <> '' THEN '3|' || lower(uu) END]) AS v, * EXCLUDE (source, id) FROM st),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY ts DESC NULLS LAST, source, id) AS rn FROM vals WHERE v IS NOT NULL) WHERE rn <= 6),
 qs AS (SELECT DISTINCT ID AS qid, unnest([CASE WHEN ENTITYID > 0 THEN '1|' || CAST(ENTITYID AS VARCHAR) END, CASE WHEN {is_email("lower(" + tr('EMAIL') + ")")} THEN '2|' || lower({tr('EMAIL')}) END,
   CASE WHEN {url_key('URL')} <> '' THEN '3|' || {url_key('URL')} END, CASE WHEN {url_key('URL')} <> '' THEN '3|' || lower({tr('URL')}) END]) AS v FROM "bid"),
 hits AS (SELECT DISTINCT qid, CAST(v[1] AS INTEGER) AS c, source, id, tt, ENDDATE, uu, ee, ts, scraped FROM qs JOIN top USING (v))""")

EXTRACT_FP = FINGERPRINT
WALK = """fp AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, list_filter({keys}, lambda v: v IS NOT NULL) AS keys FROM k),
 walk(n, doc_id, kept, seen) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST([] AS VARCHAR[])
  UNION ALL SELECT f.n, f.doc_id, NOT list_has_any(w.seen, f.keys), CASE WHEN list_has_any(w.seen, f.keys) THEN w.seen ELSE w.seen || f.keys END
  FROM walk w JOIN fp f ON f.n = w.n + 1)"""
add("ordered_greedy_dedup", "extract", "SELECT doc_id, kept FROM walk WHERE n > 0", EXTRACT_KEYS + ",\n" + WALK.format(keys=FINGERPRINT), recursive=True)
add("dedupe_stream", "extract", 'SELECT doc_id, TITLE FROM walk JOIN "extract" USING (doc_id) WHERE kept', EXTRACT_KEYS + ",\n" + WALK.format(keys=FINGERPRINT), recursive=True)

BASE = "regexp_extract(url, '^[A-Za-z]+://[^/?#:]+')"
HREFS = """hrefs AS (SELECT page_id, url, unnest(hs) AS href, CAST(unnest(range(0, len(hs))) AS INTEGER) AS pos FROM (SELECT *, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages))"""


def resolved(h: str) -> str:
    return f"CASE WHEN {h} IN ('', '#') THEN url WHEN regexp_matches({h}, '^(?i)[a-z][a-z0-9+.-]*:') THEN {h} WHEN starts_with({h}, '/') THEN {BASE} || {h} ELSE {BASE} || '/' || {h} END"


add("dedupe_links", "", f"""SELECT page_id, u AS "URL", min(pos) AS pos FROM (SELECT page_id, pos, {resolved('trim(href)')} AS u FROM hrefs) GROUP BY ALL""", HREFS)
add("dedupe_snapshots", "", """SELECT source AS listing_url, md5(text) AS text_md5, min(doc_id) AS pos FROM documents
 WHERE strlen(text) >= 80 AND NOT contains(lower(text), 'password') GROUP BY ALL""")

# ---------------------------------------------------------------- resolution

add("resolve_state", "extract state", f"""SELECT doc_id, state_id FROM (SELECT doc_id, coalesce(
  (SELECT min(id) FROM "state" s WHERE regexp_matches(h, '^[A-Za-z]{{2}}$') AND upper({tr('s.abbreviation')}) = upper(h)),
  (SELECT min(id) FROM "state" s WHERE lower({tr('s.name')}) = lower(h)),
  (SELECT min(id) FROM "state" s WHERE contains(lower({tr('s.name')}), lower(h)) OR contains(lower(h), lower({tr('s.name')})))) AS state_id
 FROM (SELECT doc_id, {STATE_HINT} AS h FROM "extract") WHERE h <> '') WHERE state_id IS NOT NULL""")
MASTER = f"""ix AS (SELECT {listing_key('URL')} AS u, min(ID) AS mid FROM "BIDURL" WHERE {listing_key('URL')} <> '' GROUP BY 1),
 src AS (SELECT id AS sid, {listing_key('url')} AS own, coalesce(third_party_url_id, 0) AS tp FROM "bid_url")"""
add("resolve_master_source_id", "bid_url BIDURL bids_temp", f"""SELECT 'source' AS kind, sid AS id, coalesce(t.ID, o.mid, m.ID, sid) AS master_source_id
 FROM src LEFT JOIN "BIDURL" t ON t.ID = tp AND tp > 0 LEFT JOIN ix o ON o.u = own LEFT JOIN "BIDURL" m ON m.ID = sid
UNION ALL SELECT 'pending', p.id, CASE WHEN {wid('p.BID_URL_ID')} < 1 THEN h.mid ELSE coalesce(m.ID, o.mid, h.mid, p.BID_URL_ID) END
 FROM "bids_temp" p LEFT JOIN "BIDURL" m ON m.ID = p.BID_URL_ID LEFT JOIN src ON sid = p.BID_URL_ID LEFT JOIN ix o ON o.u = own
 LEFT JOIN ix h ON h.u = {listing_key('p.source_listing_url')}""", MASTER)
add("scope_to_scraped_sources", "bid bid_url", f'SELECT ID, BID_URL_ID - 1000 AS BID_URL_ID FROM "bid" WHERE BID_URL_ID - 1000 IN {SCRAPED}')
LATEST_USER = """latest AS (SELECT bid_url_id, user_id FROM (SELECT BID_URL_ID AS bid_url_id, USER_ID AS user_id,
 row_number() OVER (PARTITION BY BID_URL_ID ORDER BY END_TIME DESC NULLS LAST, START_TIME DESC NULLS LAST, ID DESC) AS n FROM "BIDURLHISTORY"
 WHERE USER_ID IS NOT NULL AND USER_ID <> 0) WHERE n = 1)"""
add("latest_user_per_source", "BIDURLHISTORY", "SELECT * FROM latest", LATEST_USER)
add("assign_sources_from_history", "BIDURL BIDURLHISTORY", """SELECT ID, CASE WHEN coalesce(m.USER_ID, 0) = 0 AND l.user_id > 0 THEN l.user_id ELSE m.USER_ID END AS "USER_ID",
 CASE WHEN coalesce(m.USER_ID, 0) <> 0 THEN 'unchanged' WHEN l.user_id > 0 THEN 'assigned' ELSE 'skipped_no_history' END AS outcome
FROM "BIDURL" m LEFT JOIN latest l ON l.bid_url_id = m.ID""", LATEST_USER)
ERRORS = """errs AS (SELECT bid_url_id, id AS log_id, message, created_at FROM (SELECT *, row_number() OVER (PARTITION BY bid_url_id ORDER BY created_at DESC, id DESC) AS n
 FROM "scrape_logs" WHERE level = 'error' AND bid_url_id IS NOT NULL) WHERE n = 1)"""
add("latest_error_per_source", "scrape_logs", "SELECT * FROM errs", ERRORS)
add("apply_title_rewrites", "extract", """SELECT doc_id, e.TITLE, coalesce(w.rewrite, e.TITLE) AS display_title FROM "extract" e LEFT JOIN last w USING (listing_url, TITLE)""", """
 rw AS (SELECT 'https://agency' || CAST(doc_id % 60 AS VARCHAR) || '.gov/bids' AS listing_url, 'Rewritten ' || CAST(doc_id AS VARCHAR) AS rewrite,
   row_number() OVER (PARTITION BY doc_id % 60 ORDER BY doc_id) AS place FROM documents WHERE NOT (doc_id % 60 = 11 AND doc_id < 60)),
 raw AS (SELECT listing_url, TITLE, row_number() OVER (PARTITION BY listing_url ORDER BY doc_id) AS place FROM "extract" WHERE TITLE NOT IN ('', '0')),
 good AS (SELECT listing_url FROM (SELECT listing_url, count(*) AS n FROM raw GROUP BY 1) JOIN (SELECT listing_url, count(*) AS n FROM rw GROUP BY 1) USING (listing_url, n)),
 last AS (SELECT listing_url, TITLE, arg_max(rewrite, place) AS rewrite FROM raw JOIN rw USING (listing_url, place) WHERE listing_url IN (SELECT listing_url FROM good) GROUP BY ALL)""")

# ---------------------------------------------------------------- reports


def within(x: str, bounds: tuple[str, str]) -> str:
    return f"({x} >= {bounds[0]} AND {x} < {bounds[1]})"


add("user_activity_report", "bid bid_url_history users", """SELECT 'user' AS row_type, user_id, label, bids_added, urls_visited, bids_today FROM rep
UNION ALL SELECT 'total', NULL, 'Total', CAST(sum(bids_added) AS BIGINT), CAST(sum(urls_visited) AS BIGINT), CAST(sum(bids_today) AS BIGINT) FROM rep""", DIRECTORY + f""",
 rep AS (SELECT d.id AS user_id, label, (SELECT count(*) FROM "bid" b WHERE b.USERID = d.id AND {within('b.CREATED', MONTH)}) AS bids_added,
  (SELECT count(*) FROM "bid_url_history" v WHERE v.user_id = d.id AND {within('v.start_time', MONTH)}) AS urls_visited,
  (SELECT count(*) FROM "bid" b WHERE b.USERID = d.id AND {within('b.CREATED', DAY)}) AS bids_today FROM directory d WHERE d.id > 0)""")
KEEP = "('keyword_in_title', 'keyword_in_description', 'keyword_in_url', 'substantial')"
add("run_summary", "extract", """SELECT url, CAST(grouping(url) AS TINYINT) AS is_total, count(*) AS extracted, count(*) FILTER (o <> 'expired') AS after_date_filter, count(*) FILTER (o = 'expired') AS expired,
 count(*) FILTER (o = 'saved') AS saved, count(*) FILTER (o = 'duplicate') AS duplicates, count(*) FILTER (o = 'rejected') AS rejected,
 CASE WHEN grouping(url) = 1 OR count(*) FILTER (o = 'saved') > 0 THEN NULL
  WHEN count(*) FILTER (o = 'duplicate') > 0 THEN CAST(count(*) FILTER (o = 'duplicate') AS VARCHAR) || ' already pending or live — check Pending Approval'
  WHEN count(*) FILTER (o = 'rejected') > 0 THEN 'missing end date or weak bid signals'
  WHEN count(*) FILTER (o = 'expired') > 0 THEN CAST(count(*) FILTER (o = 'expired') AS VARCHAR) || ' expired (filtered out)' END AS message,
 CASE WHEN grouping(url) = 0 AND count(*) FILTER (o IN ('saved', 'duplicate')) = 0 THEN CASE WHEN count(*) FILTER (o = 'rejected') > 0 THEN 'No bids found. Please check the URL.' ELSE 'No bids found.' END END AS issue
FROM out GROUP BY ROLLUP (url)""", EXTRACT_KEYS + f""",
 out AS (SELECT listing_url AS url, CASE WHEN NOT {NOT_EXPIRED} THEN 'expired' WHEN SOLICITATIONNUMBER <> 'Not provided' THEN 'duplicate'
  WHEN ({VERDICT}) IN {KEEP} AND doc_id % 60 < 20 THEN 'saved' ELSE 'rejected' END AS o FROM k)""")
add("issue_counts", "scrape_logs", """SELECT level, count(*) AS issues FROM "scrape_logs" GROUP BY level UNION ALL SELECT 'all', count(*) FROM "scrape_logs" """)
add("dashboard_counts", "scrape_logs bids_temp BIDURL failed_bid_urls", """SELECT (SELECT count(*) FROM "scrape_logs") AS issues, (SELECT count(*) FROM "bids_temp") AS pending,
 (SELECT count(*) FROM "BIDURL" WHERE coalesce(USER_ID, 0) = 0) AS unassigned, (SELECT count(*) FROM "failed_bid_urls") AS failed""")
add("distinct_groups", "bid_url", """SELECT DISTINCT trim(scrape_group) AS scrape_group FROM "bid_url" WHERE trim(scrape_group) <> '' UNION SELECT 'Test'""")
add("report_range", "bid", f"""SELECT CAST(CREATED + INTERVAL 8 HOUR AS DATE) AS manila_day, count(*) AS n FROM "bid" WHERE {within('CREATED', MONTH)} GROUP BY 1""")
add("daily_activity_stream", "", "SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS manila_day, user_id, count(*) AS visits FROM events GROUP BY ALL")

# ---------------------------------------------------------------- typeahead

add("search_entities", "entity", f"""SELECT id, {entity_label()} AS label FROM "entity" WHERE contains(lower(name), '12') OR contains(lower(email), '12') OR id = 12 ORDER BY id LIMIT 100""")
add("search_states", "state", f"""SELECT id, {state_label()} AS label FROM "state" WHERE contains(lower(name), 'on') OR contains(lower(abbreviation), 'on') ORDER BY lower(label), id LIMIT 50""")
add("search_categories", "category", """SELECT id, trim(name) AS label FROM "category" WHERE contains(lower(name), 'm') ORDER BY lower(name), id LIMIT 50""")
add("search_sources", "BIDURL bid_url", f"""SELECT 'master' AS kind, ID AS id, {source_label('NAME', 'URL')} AS label, {tr('URL')} AS url FROM
 (SELECT * FROM "BIDURL" WHERE contains(lower(URL), 'agency') OR contains(lower(NAME), 'agency') ORDER BY NAME, URL, ID LIMIT 100)
UNION ALL SELECT 'user', coalesce(mid, id), {source_label('name', 'url')}, {tr('url')} FROM
 (SELECT * FROM "bid_url" WHERE user_id = 5 AND (contains(lower(url), 'gov') OR contains(lower(name), 'gov')) ORDER BY name, url, id LIMIT 100) LEFT JOIN ix ON u = {listing_key('url')}""", MASTER)

# ---------------------------------------------------------------- table maintenance

add("map_pending_to_live", "bids_temp bid_url BIDURL", f"""SELECT p.id AS pending_id, {tr('TITLE')} AS "TITLE", p.URL, coalesce(CASE WHEN p.BID_URL_ID IS NOT NULL THEN
  CASE WHEN p.BID_URL_ID < 1 THEN coalesce(h.mid, p.BID_URL_ID) ELSE coalesce(m.ID, o.mid, h.mid, p.BID_URL_ID) END END, 0) AS "BID_URL_ID",
 CASE WHEN p.BID_URL_ID % 2 = 0 THEN CAST(77 AS BIGINT) ELSE 0 END AS "USERID", coalesce(ENTITYID, 0) AS "ENTITYID", coalesce(CATEGORYID, 0) AS "CATEGORYID", coalesce(STATEID, 0) AS "STATEID",
 coalesce(INLINEURL, '0') AS "INLINEURL", coalesce(COUNTRY_ID, 'us') AS "COUNTRY_ID", NAICSCODE, {NOW_TS} AS "LAST_MODIFIED"
 FROM "bids_temp" p LEFT JOIN "BIDURL" m ON m.ID = p.BID_URL_ID LEFT JOIN src ON sid = p.BID_URL_ID LEFT JOIN ix o ON o.u = own
 LEFT JOIN ix h ON h.u = {listing_key('p.source_listing_url')}""", MASTER)
add("patch_live", "bids_temp bid", """SELECT b.ID, TITLE, coalesce(p.ENTITYID, b.ENTITYID) AS "ENTITYID", coalesce(p.EMAIL, b.EMAIL) AS "EMAIL", coalesce(p.INLINEURL, b.INLINEURL) AS "INLINEURL",
 coalesce(p.LAST_MODIFIED, b.LAST_MODIFIED) AS "LAST_MODIFIED" FROM "bid" b LEFT JOIN (SELECT CAST(floor(id / 80000000) AS BIGINT) + 1 AS pid, max(ENTITYID) AS ENTITYID, min(EMAIL) AS EMAIL,
 max(INLINEURL) AS INLINEURL, max(LAST_MODIFIED) AS LAST_MODIFIED FROM "bids_temp" GROUP BY 1) p ON p.pid = b.ID""")
add("quarantine_failed", "bid_url failed_bid_urls scrape_logs", """SELECT 'active' AS list, id, url, NULL AS failure_message FROM "bid_url" WHERE id NOT IN (SELECT id FROM moved)
UNION ALL SELECT 'failed', id, url, failure_message FROM "failed_bid_urls" WHERE id NOT IN (SELECT known FROM placed WHERE known IS NOT NULL)
UNION ALL SELECT 'failed', known, url, message FROM placed WHERE known IS NOT NULL
UNION ALL SELECT 'failed', (SELECT max(id) FROM "failed_bid_urls") + row_number() OVER (ORDER BY src_id), url, message FROM placed WHERE known IS NULL""", ERRORS + """,
 moved AS (SELECT s.id, s.url, message FROM "bid_url" s JOIN errs ON errs.bid_url_id = s.id WHERE last_scraped_at IS NULL OR errs.created_at > last_scraped_at),
 placed AS (SELECT url, max(id) AS src_id, arg_max(message, id) AS message, (SELECT min(f.id) FROM "failed_bid_urls" f WHERE f.url = moved.url) AS known FROM moved GROUP BY url)""")
RESTORE = """act_u AS (SELECT DISTINCT url FROM "bid_url" WHERE scrape_group = 'Test'), act_n AS (SELECT DISTINCT name FROM "bid_url" WHERE scrape_group = 'Test' AND coalesce(name, '') <> ''),
 f AS (SELECT id, url, name, url IN (SELECT url FROM act_u) AS ua, coalesce(name IN (SELECT name FROM act_n), false) AS na, row_number() OVER (ORDER BY id) AS n FROM "failed_bid_urls"),
 walk(n, id, outcome, urls, names) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL SELECT f.n, f.id, o, CASE WHEN o = 'restored' THEN urls || [f.url] ELSE urls END, CASE WHEN o = 'restored' AND coalesce(f.name, '') <> '' THEN names || [f.name] ELSE names END
  FROM (SELECT w.urls, w.names, f.n, f.id, f.url, f.name, CASE WHEN f.ua OR list_contains(w.urls, f.url) THEN 'already_active'
    WHEN f.na OR (coalesce(f.name, '') <> '' AND list_contains(w.names, f.name)) THEN 'skipped' ELSE 'restored' END AS o FROM walk w JOIN f ON f.n = w.n + 1) f)"""
add("restore_failed", "bid_url failed_bid_urls", "SELECT id, outcome FROM walk WHERE n > 0", RESTORE, recursive=True)
add("restore_stats", "bid_url failed_bid_urls", "SELECT outcome, count(*) AS n FROM walk WHERE n > 0 GROUP BY outcome", RESTORE, recursive=True)
add("finish_visits", "bid_url failed_bid_urls bid_url_history", """SELECT 'source' AS kind, id, coalesce(s, start_time) AS start_time, coalesce(e, end_time) AS end_time, coalesce(e, last_scraped_at) AS last_scraped_at FROM "bid_url" LEFT JOIN last ON bid = id
UNION ALL SELECT 'failed', id, coalesce(s, start_time), coalesce(e, end_time), coalesce(e, last_scraped_at) FROM "failed_bid_urls" LEFT JOIN last ON bid = original_bid_url_id
UNION ALL SELECT 'history', id, start_time, end_time, NULL FROM "bid_url_history"
UNION ALL SELECT 'history', (SELECT max(id) FROM "bid_url_history") + row_number() OVER (ORDER BY e, bid, s, u NULLS FIRST), s, e, NULL FROM v""", """
 v AS (SELECT bid_url_id AS bid, start_time + INTERVAL 30 DAY AS s, end_time + INTERVAL 30 DAY AS e, user_id AS u FROM "bid_url_history" WHERE end_time IS NOT NULL AND bid_url_id > 0),
 last AS (SELECT bid, arg_max(s, e) AS s, max(e) AS e FROM v GROUP BY bid)""")
add("bulk_source_and_queue_updates", "bid_url bids_temp", f"""SELECT 'source' AS kind, id, CASE WHEN coalesce(scrape_group, '') = '' THEN 'Test' ELSE scrape_group END AS scrape_group,
 CASE WHEN scrape_group = 'Test' THEN {NOW_TS} WHEN scrape_group = 'VE' THEN NULL ELSE last_scraped_at END AS last_scraped_at, NULL AS n FROM "bid_url"
UNION ALL SELECT 'pending', BID_URL_ID, NULL, NULL, count(*) FROM "bids_temp" WHERE BID_URL_ID <> 1007 GROUP BY BID_URL_ID""")
add("conform_schema", "bids_temp", 'SELECT id AS "ID", TITLE, SOLICITATIONNUMBER, ENDDATE, CAST(27 AS BIGINT) AS n_columns FROM "bids_temp"')
add("validate_records", "extract users", f"""SELECT doc_id, nullif(em, '') AS "EMAIL", CASE WHEN regexp_matches(en, '^\\d+$') THEN CAST(en AS BIGINT) END AS "ENTITYID", u AS "USERID", array_to_string(list_filter([
  CASE WHEN {tr('t')} = '' THEN 'title_missing' END, CASE WHEN length(t) > 255 THEN 'title_too_long' END,
  CASE WHEN em <> '' AND NOT {is_email('em')} THEN 'email_invalid' END,
  CASE WHEN ENDDATE = 'Not provided' THEN 'enddate_not_a_date' END, CASE WHEN en <> '' AND NOT regexp_matches(en, '^\\d+$') THEN 'entityid_not_a_number' END,
  CASE WHEN u NOT IN (SELECT id FROM directory) THEN 'assignee_not_in_directory' END], lambda v: v IS NOT NULL), ' | ') AS errors
FROM (SELECT doc_id, ENDDATE, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE DESCRIPTION END AS t, CASE WHEN doc_id % 4 = 0 THEN 'a b@c' WHEN doc_id % 4 = 1 THEN '' ELSE 'a.b@c-d.gov' END AS em,
 CASE WHEN doc_id % 7 = 0 THEN '12x' WHEN doc_id % 7 = 1 THEN '' ELSE CAST(source_id AS VARCHAR) END AS en, doc_id % 200 AS u FROM "extract")""", DIRECTORY)

# ---------------------------------------------------------------- pages


def page_text_sql(x: str) -> str:
    out = x
    for t in ("script", "style", "noscript", "nav", "footer"):
        out = f"regexp_replace({out}, '<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'gis')"
    out = f"regexp_replace(regexp_replace({out}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'gs')"
    for ref, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{ch}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


PAGE_TEXT = f"pt AS (SELECT page_id, url, html, {page_text_sql('html')} AS text FROM pages)"
add("pages_to_text", "", "SELECT page_id, text FROM pt", PAGE_TEXT)
HAY = f"lower(text || ' ' || regexp_replace(html, '{TAGS}', '', 'gs'))"
OPEN_CODE = "\\b(ifb|rfp|rfq|itb|rfb|ifq|ib|ipwb)[- ][a-z0-9]{2,}"


def opened(x: str) -> str:
    return f"(coalesce(TRY_CAST(regexp_extract({x}, '(\\d+)\\s+open\\s+solicitation', 1) AS BIGINT), 0) > 0 OR {has_any(x, ['que les', 'of the', 'und der'])} OR regexp_matches({x}, '{OPEN_CODE}'))"


FLAGS = f"""fl AS (SELECT *, (contains(hay, 'casino')::INT + contains(hay, 'pills')::INT + contains(hay, 'click here')::INT + contains(hay, 'subscribe')::INT) >= 2 AS browser_check,
  contains(lh, '<main') OR (len(regexp_extract_all(lh, '<script')) >= 3 AND strlen(vis) < 200) AS spa,
  ((regexp_matches(html, '(?i)type=["'']password["'']') AND regexp_matches(hay, 'log in|login|sign in')) OR regexp_matches(html, '(?i)<form[^>]*(login|signin)[^>]*>')) AND NOT regexp_matches(hay, '{S.LOGIN_BID_WORDS}') AS login_page,
  {opened('lower(text)')} AS open_bids, NOT {opened('hay')} AND {has_any('hay', ['ad 0', 'subscribe', 'cookie'])} AS no_open_bids, contains(lh, 'class="ad"') AS platform_page,
  regexp_matches(lower(url), '^[a-z]+://([^/?#]*[.])?example[.](net|org)([/?#:]|$)') AS script_host, regexp_matches(lower(url), '^[a-z]+://([^/?#]*[.])?example[.]org([/?#:]|$)') AS heavy_portal
 FROM (SELECT *, {HAY} AS hay, lower(html) AS lh, regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gis'), '{TAGS}', '', 'gs') AS vis FROM pt)),
 rs AS (SELECT *, CASE WHEN browser_check THEN 'browser check/captcha' WHEN contains(hay, 'casino') THEN 'casino' WHEN contains(hay, 'cheap') THEN 'cheap' WHEN contains(hay, 'viagra') THEN 'viagra'
   WHEN contains(hay, 'winner') THEN 'winner' END AS blocked_reason,
  open_bids AND NOT regexp_matches(html, '(?i)href=["''][^"'']*/Bids/[^"'']+["'']') AND (platform_page OR script_host OR regexp_matches(lower(url), '^[a-z]+://[^/?#]*[^?#]*/(procurement|solicitation)')) AS needs_render FROM fl)"""
add("classify_pages", "", """SELECT page_id, browser_check, blocked_reason, spa, login_page, open_bids, no_open_bids, platform_page, script_host, heavy_portal, needs_render,
 CASE WHEN blocked_reason IS NOT NULL THEN 'blocked: ' || blocked_reason WHEN login_page THEN 'login page' WHEN no_open_bids THEN 'no open bids' WHEN spa THEN 'script shell' WHEN needs_render THEN 'needs render' ELSE 'ok' END AS page_class
FROM rs""", PAGE_TEXT + ", " + FLAGS)
ANCHORS = """anchors AS (SELECT page_id, url, CAST(pos AS BIGINT) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, replace(replace(regexp_extract(a, '>([^<]*)<', 1), '&quot;', '"'), '&amp;', '&') AS label
 FROM (SELECT page_id, url, unnest(xs) AS a, unnest(range(0, len(xs))) AS pos FROM (SELECT *, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS xs FROM pages)))"""


def strip_fragment(x: str) -> str:
    return f"regexp_replace({x}, '#.*$', '')"


add("extract_detail_links", "", f"""SELECT page_id, u AS "URL", min(pos) AS pos, trim(arg_min(label, pos)) AS "TITLE" FROM
 (SELECT page_id, pos, label, url, {resolved('trim(href)')} AS u FROM anchors WHERE NOT regexp_matches(href, '(?i)\\.pdf($|\\?)'))
WHERE strlen(label) >= 5 AND regexp_matches(lower(label || ' ' || u), 'the|que|der|tion|en') AND rtrim({strip_fragment('u')}, '/') <> rtrim({strip_fragment('url')}, '/')
GROUP BY page_id, u""", ANCHORS)
add("primary_description", "", """SELECT doc_id, md5(CASE WHEN block IS NULL THEN t ELSE '--- PRIMARY PROJECT DESCRIPTION (use the full text below for DESCRIPTION; do not replace with a short metadata summary) ---' || chr(10) || chr(10)
  || block || chr(10) || chr(10) || '--- PAGE TEXT ---' || chr(10) || chr(10) || t END) AS text_md5, CAST(length(block) AS INTEGER) AS chars
FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 AND length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 120 THEN regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\n{3,}', chr(10) || chr(10), 'g') END AS block,
  'Head' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Project  Details:' ELSE 'PROJECT DESCRIPTION' END || chr(10) || text
   || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Back To Trade Journal' || chr(10) || 'foot' WHEN doc_id % 5 = 1 THEN chr(10) || '  PDF ATTACHMENTS' || chr(10) || 'foot' ELSE '' END AS t FROM documents)""")
add("join_document_texts", "", """SELECT source || '/' || lang || '/' || CAST(doc_id // 200 AS VARCHAR) AS listing_url, count(*) AS documents,
 md5(string_agg(text, chr(10) || chr(10) || '----- NEXT DOCUMENT -----' || chr(10) || chr(10) ORDER BY doc_id)) AS text_md5 FROM documents WHERE text <> '' GROUP BY ALL""")
add("prioritize_links", "bid bid_url", """SELECT page_id, pos, is_open, CAST(p AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY is_open DESC, pos) AS p FROM
 (SELECT BID_URL_ID AS page_id, b.ID AS pos, coalesce(trim(TITLE) = 'Road repair RFP ' || CAST(s.id % 50 AS VARCHAR), false)
   OR (s.id IS NOT NULL AND trim(TITLE) <> '' AND starts_with('Road repair RFP ' || CAST(s.id % 50 AS VARCHAR), trim(TITLE))) AS is_open FROM "bid" b LEFT JOIN "bid_url" s ON s.id + 1000 = b.BID_URL_ID))""")


def shrink(table: str, out: str) -> str:
    cols = ", ".join(f"CASE WHEN t > {S.EXCERPT_BUDGET} THEN CAST(floor({c} * ({float(S.EXCERPT_BUDGET)} / t)) AS BIGINT) ELSE {c} END AS {c}" for c in ("nt", "nh", "np"))
    return f"{out} AS (SELECT page_id, listing, {cols} FROM (SELECT *, CAST(sum(nt + nh + np) OVER (PARTITION BY listing) AS DOUBLE) AS t FROM {table}))"


add("excerpt_budget", "", """SELECT page_id, CAST(nt AS INTEGER) AS text_chars, CAST(nh AS INTEGER) AS html_chars, CAST(np AS INTEGER) AS pdf_text_chars, md5(substr(reverse(text), 1, np)) AS pdf_md5
FROM n3 JOIN documents ON doc_id = page_id""", f"""n0 AS (SELECT doc_id AS page_id, source || '/' || lang AS listing, least(length(text), {S.EXCERPT_CAPS['text']}) AS nt,
 least(length(text) + 7, {S.EXCERPT_CAPS['html']}) AS nh, least(length(text), {S.EXCERPT_CAPS['pdf_text']}) AS np FROM documents), {shrink('n0', 'n1')}, {shrink('n1', 'n2')}, {shrink('n2', 'n3')}""")


# ---------------------------------------------------------------- organization hints


def labelled_sql(blob: str) -> str:
    found = []
    for label in S.ORG_LABELS:
        hit = f"regexp_extract({blob}, '(?i)\\b{label}\\s*:\\s*([^\\r\\n]{{{{3,}}}})', 1)".replace("{{", "{").replace("}}", "}")
        found.append(f"list_transform(regexp_split_to_array(trim({hit}, {WS}), '[|;]'), lambda v: trim(v, {WS}))")
    return f"list_filter({' || '.join(found)}, lambda v: length(v) >= 4)"


def subdomain_sql(x: str) -> str:
    h = f"CASE WHEN {tr(x)} = '' THEN '' ELSE {host_of(x)} END"
    words_ = f"string_split(regexp_replace(split_part({h}, '.', 1), '[-_]+', ' ', 'g'), ' ')"
    cap = f"array_to_string(list_transform(list_filter({words_}, lambda w: length(w) >= 2), lambda w: upper(w[1]) || w[2:]), ' ')"
    return (
        f"CASE WHEN {is_portal_host('(' + h + ')')} AND len(string_split({h}, '.')) >= 3 AND length(split_part({h}, '.', 1)) >= 4"
        f" AND regexp_matches(split_part({h}, '.', 1), '[-_]') THEN {cap} ELSE '' END"
    )


FIRSTS = """array_to_string(list_filter(hs, lambda v, i: v <> '' AND list_position(list_transform(hs, lambda w: lower(w)), lower(v)) = i), ' | ')"""
NL = "(TITLE || chr(10) || DESCRIPTION)"
add("organization_hints", "extract bid bid_url", f"""SELECT 'extract' AS kind, doc_id AS id, {FIRSTS} AS hints FROM (SELECT doc_id,
  [{org_sql('s.name')}, {org_sql('ISSUING_ORGANIZATION')}, {subdomain_sql('s.url')}, {subdomain_sql('e.URL')}] || {labelled_sql(NL)} AS hs
  FROM "extract" e LEFT JOIN "bid_url" s ON s.id = e.source_id)
UNION ALL SELECT 'bid', ID, {FIRSTS} FROM (SELECT ID, [{subdomain_sql('b.URL')}] || {labelled_sql(NL)} AS hs FROM "bid" b)""")
