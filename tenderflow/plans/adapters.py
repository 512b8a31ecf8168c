"""The given tables as logical tables. Each adapter is one SQL text that Spark and a SQL oracle read alike."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

NOW = dt.datetime(2024, 1, 20, 9, 30)

_HOST = "'agency' || CAST({k} % 40 AS STRING) || '.gov'"
_SHIFT = "INTERVAL 24 YEAR"

ADAPTERS = {
    # Configured sources: every supplier.
    "bid_url": """
SELECT s_suppkey + 1 AS id,
  CASE WHEN s_suppkey % 23 = 9 THEN ''
       WHEN s_suppkey % 19 = 4 THEN 'ftp://files.agency' || CAST(s_suppkey AS STRING) || '.gov/list'
       WHEN s_suppkey % 11 = 7 THEN 'https://www.demandstar.com/agency/' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 13 = 5 THEN 'https://city-of-rivertown' || CAST(s_suppkey AS STRING) || '.bonfirehub.com/portal/'
       ELSE 'https://' || CASE WHEN s_suppkey % 3 = 0 THEN 'www.' ELSE '' END || 'agency' || CAST(s_suppkey AS STRING)
            || '.gov/Bids' || CASE WHEN s_suppkey % 5 = 0 THEN '/' ELSE '' END END AS url,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Rivertown ' || CAST(s_suppkey AS STRING) || ', City of'
       WHEN s_suppkey % 4 = 1 THEN 'BidNet Direct — City of Rivertown ' || CAST(s_suppkey AS STRING)
       WHEN s_suppkey % 4 = 2 THEN s_name
       ELSE 'N/A' END AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Test' WHEN s_suppkey % 3 = 1 THEN 'VE' ELSE '' END AS scrape_group,
  TIMESTAMP '2024-01-01 08:00:00' + INTERVAL 1 HOUR * CAST(s_nationkey AS INT) AS start_time,
  CASE WHEN s_suppkey % 4 = 3 THEN NULL
       ELSE TIMESTAMP '2024-01-01 09:00:00' + INTERVAL 1 HOUR * CAST(s_nationkey AS INT) END AS end_time,
  CAST(s_nationkey AS BIGINT) AS weight,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN CAST(0 AS BIGINT) ELSE s_suppkey % 40 + 1 END AS user_id,
  s_suppkey % 2 AS check_changes,
  s_suppkey % 2 AS visit_required,
  CAST(s_suppkey * 1000003 AS DECIMAL(24,0)) AS checksum,
  CAST(1 AS INT) AS valid,
  CASE WHEN s_suppkey % 9 = 2 THEN s_suppkey + 1001 ELSE CAST(0 AS BIGINT) END AS third_party_url_id,
  CASE WHEN s_suppkey % 3 = 1 THEN NULL
       WHEN s_suppkey % 5 = 3 THEN TIMESTAMP '2024-01-20 03:00:00'
       ELSE TIMESTAMP '2024-01-10 00:00:00' + INTERVAL 1 HOUR * CAST(s_nationkey AS INT) END AS last_scraped_at
FROM {supplier}""",
    # Master sources: every supplier and every customer of an agency.
    "BIDURL": """
SELECT s_suppkey + 1001 AS ID,
  'HTTPS://' || CASE WHEN s_suppkey % 3 = 0 THEN 'www.' ELSE '' END || 'agency' || CAST(s_suppkey AS STRING)
    || '.gov/bids' || CASE WHEN s_suppkey % 2 = 0 THEN '/' ELSE '' END AS URL,
  CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'Agency ' || s_name END AS NAME,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN CAST(0 AS BIGINT) ELSE s_suppkey % 60 + 1 END AS USER_ID,
  TIMESTAMP '2023-12-01 00:00:00' + INTERVAL 1 DAY * CAST(s_nationkey AS INT) AS START_TIME,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL
       ELSE TIMESTAMP '2023-12-01 02:00:00' + INTERVAL 1 DAY * CAST(s_nationkey AS INT) END AS END_TIME
FROM {supplier}
UNION ALL
SELECT c_custkey + 1000001, 'https://portal.rivertown' || CAST(c_custkey AS STRING) || '.gov/open-bids', c_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 60 + 1 END,
  TIMESTAMP '2023-11-01 00:00:00', TIMESTAMP '2023-11-02 00:00:00'
FROM {customer}""",
    # Live bids: every order.
    "bid": """
SELECT o_orderkey + 1 AS ID,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Corporate:  ' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'Road repair RFP '
    ELSE 'Supply of  Parts ' END || CAST(o_custkey % 50 AS STRING) AS TITLE,
  'Agency: Rivertown ' || CAST(o_custkey % 300 AS STRING) || chr(10) || 'Priority: ' || o_orderpriority || chr(10)
    || CASE WHEN o_orderkey % 6 = 0 THEN 'NAICS 236220' || chr(10) ELSE '' END || 'Contact: Not provided' || chr(10)
    || 'Contact buyer' || CAST(o_custkey % 90 AS STRING) || '@rivertown.gov for details' AS DESCRIPTION,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'Buyer' || CAST(o_custkey % 400 AS STRING) || '@Rivertown.gov' END AS EMAIL,
  CASE WHEN o_orderkey % 8 = 0 THEN 'https://agency' || CAST(o_custkey % 40 AS STRING) || '.gov/'
       ELSE 'https://www.agency' || CAST(o_custkey % 40 AS STRING) || '.gov/bids/' || CAST(o_orderkey AS STRING) END AS URL,
  o_orderdate + INTERVAL 24 YEAR + INTERVAL 1 HOUR * CAST(o_orderkey % 24 AS INT) AS CREATED,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderdate + INTERVAL 24 YEAR + INTERVAL 45 DAY END AS ENDDATE,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN CAST(0 AS BIGINT) ELSE o_orderkey % 6 + 1 END AS CATEGORYID,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(0 AS BIGINT) ELSE o_custkey * 2 % 1700 + 1 END AS ENTITYID,
  CAST(10 AS BIGINT) AS SUBSCRIPTIONTYPEID,
  o_custkey % 90 + 1 AS USERID,
  CASE WHEN o_orderkey % 7 = 2 THEN 'TP-' || CAST(o_orderkey AS STRING)
       WHEN o_orderkey % 7 = 3 THEN CAST(o_orderkey + 50000 AS STRING) ELSE NULL END AS THIRD_PARTY_IDENTIFIER,
  CASE WHEN o_orderkey % 4 = 1 THEN ' Sol-' || CAST(o_orderkey AS STRING) ELSE NULL END AS SOLICITATIONNUMBER,
  CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 24 YEAR ELSE NULL END AS FEDDATE,
  CAST(1 AS BIGINT) AS SETASIDECODEID,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(200000 + o_custkey AS STRING) WHEN o_orderkey % 3 = 1 THEN '921190' ELSE '' END AS NAICSCODE,
  CASE WHEN o_orderkey % 6 = 5 THEN CAST(0 AS BIGINT) ELSE o_custkey % 100 + 1001 END AS BID_URL_ID,
  '0' AS INLINEURL,
  CAST(o_orderkey % 2 AS INT) AS NEEDS_REVIEW,
  CAST(0 AS BIGINT) AS SOURCE_ID,
  CASE WHEN o_orderkey % 3 = 2 THEN CAST(0 AS BIGINT) ELSE o_custkey % 30 + 1 END AS STATEID,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 24 YEAR + INTERVAL 3 DAY ELSE NULL END AS LAST_MODIFIED,
  CAST(0 AS BIGINT) AS CATEGORY_ALIAS_ID,
  'us' AS COUNTRY_ID,
  CAST(0 AS INT) AS UNDERREVIEW,
  CAST(0 AS BIGINT) AS NAICSCODE_INT,
  CAST(NULL AS STRING) AS NSN
FROM {orders}""",
    # Pending bids: every line item.
    "bids_temp": """
SELECT (l_orderkey * 8 + l_linenumber) * 10000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS id,
  CASE WHEN l_partkey % 97 = 0 THEN ' ' WHEN l_partkey % 2 = 0 THEN 'Road  repair RFP ' ELSE 'Supply of Parts ' END
    || CASE WHEN l_partkey % 97 = 0 THEN '' ELSE CAST(l_partkey % 50 AS STRING) END AS TITLE,
  'Agency: Rivertown ' || CAST(l_suppkey AS STRING) || chr(10) || 'Flag: ' || l_returnflag || chr(10)
    || CASE WHEN l_linenumber = 1 THEN 'Scope: full delivery, installation, testing and three years of maintenance for all of the listed parts'
       ELSE 'Scope: parts' END AS DESCRIPTION,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'buyer' || CAST(l_partkey % 400 AS STRING) || '@rivertown.gov' END AS EMAIL,
  CASE WHEN l_partkey % 3 = 0 THEN 'https://agency' || CAST(l_suppkey % 40 AS STRING) || '.gov'
       ELSE 'https://www.Agency' || CAST(l_orderkey % 40 AS STRING) || '.gov/bids/' || CAST(l_orderkey AS STRING)
         || CASE WHEN l_partkey % 3 = 1 THEN '' ELSE '/' || CAST(l_linenumber AS STRING) END END AS URL,
  l_shipdate + INTERVAL 24 YEAR AS CREATED,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate + INTERVAL 24 YEAR + INTERVAL 30 DAY END AS ENDDATE,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 6 + 1 END AS CATEGORYID,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 1600 END AS ENTITYID,
  CAST(10 AS BIGINT) AS SUBSCRIPTIONTYPEID,
  l_suppkey % 90 + 1 AS USERID,
  CASE WHEN l_partkey % 41 = 0 THEN 'tp-' || CAST(l_orderkey AS STRING) ELSE '' END AS THIRD_PARTY_IDENTIFIER,
  CASE WHEN l_partkey % 37 = 0 THEN 'SOL-' || CAST(l_orderkey AS STRING) ELSE '' END AS SOLICITATIONNUMBER,
  CAST(NULL AS TIMESTAMP) AS FEDDATE,
  CAST(1 AS BIGINT) AS SETASIDECODEID,
  CASE WHEN l_partkey % 6 = 0 THEN CAST(200000 + l_partkey AS STRING) WHEN l_partkey % 6 = 1 THEN '921190' ELSE '23' END AS NAICSCODE,
  CASE WHEN l_partkey % 5 = 4 THEN CAST(0 AS BIGINT) WHEN l_partkey % 5 = 3 THEN l_suppkey + 1 ELSE l_suppkey + 1001 END AS BID_URL_ID,
  CASE WHEN l_partkey % 2 = 0 THEN '1' ELSE NULL END AS INLINEURL,
  CAST(0 AS INT) AS NEEDS_REVIEW,
  CAST(0 AS BIGINT) AS SOURCE_ID,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 25 + 1 END AS STATEID,
  CASE WHEN l_partkey % 2 = 0 THEN l_shipdate + INTERVAL 24 YEAR + INTERVAL 1 DAY ELSE NULL END AS LAST_MODIFIED,
  CAST(NULL AS BIGINT) AS CATEGORY_ALIAS_ID,
  CAST(NULL AS STRING) AS COUNTRY_ID,
  CAST(0 AS INT) AS UNDERREVIEW,
  CAST(NULL AS BIGINT) AS NAICSCODE_INT,
  CAST(NULL AS STRING) AS NSN,
  'https://agency' || CAST(l_suppkey AS STRING) || '.gov/bids' AS source_listing_url,
  'Rivertown ' || CAST(l_suppkey AS STRING) || ', City of' AS bid_url_name,
  l_shipdate + INTERVAL 24 YEAR + INTERVAL 1 HOUR * CAST(l_linenumber AS INT) AS created_at,
  l_shipdate + INTERVAL 24 YEAR AS updated_at
FROM {lineitem}""",
    # Visits, issues: every event.
    "bid_url_history": """
SELECT event_id + 1 AS id, (event_id * 7 + user_id) % 120 + 1 AS bid_url_id, ts AS start_time,
  CASE WHEN event_type = 'error' THEN NULL ELSE ts + INTERVAL 10 MINUTE END AS end_time,
  CASE WHEN user_id % 20 = 7 THEN NULL ELSE user_id END AS user_id
FROM {events}""",
    "BIDURLHISTORY": """
SELECT event_id + 1 AS ID, (event_id * 7 + user_id) % 120 + 1001 AS BID_URL_ID,
  CASE WHEN user_id % 20 = 7 THEN NULL ELSE user_id END AS USER_ID, ts AS START_TIME,
  CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS END_TIME
FROM {events}""",
    "scrape_logs": """
SELECT event_id + 1 AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE (event_id * 13) % 130 + 1 END AS bid_url_id,
  'https://agency' || CAST((event_id * 13) % 130 AS STRING) || '.gov/bids' AS url,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'success' ELSE 'warning' END AS level,
  event_type || ' ' || props AS message, date_trunc('hour', ts) AS created_at
FROM {events}""",
    # Quarantined sources: every part.
    "failed_bid_urls": """
SELECT p_partkey + 1 AS id, p_partkey % 90 + 1 AS original_bid_url_id,
  CASE WHEN p_partkey % 6 = 0 THEN 'https://agency' || CAST(p_partkey AS STRING) || '.gov/Bids'
       WHEN p_partkey % 6 = 1 THEN 'https://down' || CAST(p_partkey % 500 AS STRING) || '.gov/list'
       ELSE 'https://down' || CAST(p_partkey AS STRING) || '.gov/list' END AS url,
  CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN NULL WHEN p_partkey % 4 = 2 THEN ''
       ELSE p_brand || ' ' || CAST(p_partkey AS STRING) END AS name,
  TIMESTAMP '2024-01-01 00:00:00' AS start_time,
  CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2024-01-01 01:00:00' ELSE NULL END AS end_time,
  CAST(p_size AS BIGINT) AS weight, p_partkey % 60 + 1 AS user_id, CAST(0 AS BIGINT) AS check_changes,
  CAST(0 AS BIGINT) AS visit_required, CAST(p_partkey AS DECIMAL(24,0)) AS checksum, CAST(1 AS INT) AS valid,
  CAST(0 AS BIGINT) AS third_party_url_id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 02:00:00' + INTERVAL 1 HOUR * p_size END AS last_scraped_at,
  'Blocked: ' || p_type AS failure_message,
  TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 HOUR * p_size AS failed_at
FROM {part}""",
    "entity": """
SELECT c_custkey + 1 AS id,
  CASE WHEN c_custkey % 3 = 0 THEN 'City of Rivertown ' || CAST(c_custkey AS STRING)
       WHEN c_custkey % 3 = 1 THEN 'Rivertown  ' || CAST(c_custkey AS STRING) || ' County School District'
       ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'Not provided'
       ELSE 'Buyer' || CAST(c_custkey % 900 AS STRING) || '@Rivertown' || CAST(c_custkey % 70 AS STRING) || '.gov' END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'https://www.agency' || CAST(c_custkey AS STRING) || '.gov/' END AS website
FROM {customer}""",
    "state": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name,
  CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE chr(65 + n_nationkey % 20) || chr(75 + n_nationkey % 15) END AS abbreviation
FROM {nation}""",
    "category": """
SELECT CAST(ascii(p_type) * 1000 + length(p_type) AS BIGINT) AS id, p_type AS name FROM {part} GROUP BY p_type""",
    "users": """
SELECT user_id + 1 AS id,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE 'First' || CAST(user_id % 30 AS STRING) END AS FIRSTNAME,
  CASE WHEN user_id % 4 < 2 THEN NULL ELSE ' Last' || CAST(user_id AS STRING) END AS LASTNAME,
  CASE WHEN user_id % 8 = 0 THEN NULL ELSE 'user ' || CAST(user_id AS STRING) END AS NAME,
  CASE WHEN user_id % 3 = 2 THEN 'America/Denver' ELSE 'Asia/Manila' END AS TIME_ZONE
FROM {events} GROUP BY user_id""",
    # Extracted records: every document, its whole text as the description.
    "extract": """
SELECT doc_id, 'https://agency' || CAST(doc_id % 60 AS STRING) || '.gov/bids' AS listing_url, doc_id % 60 + 1 AS source_id,
  CASE WHEN doc_id % 31 = 0 THEN 'Home' WHEN doc_id % 7 = 0 THEN 'RFP ' || source || ' ' || lang
       ELSE 'Delivery of goods ' || CAST(doc_id % 400 AS STRING) END AS TITLE,
  CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'Not provided' WHEN doc_id % 6 = 2 THEN '2023-12-31'
       WHEN doc_id % 6 = 3 THEN '2/15/2024' WHEN doc_id % 6 = 4 THEN '2024-02-20 17:00' ELSE 'March 5, 2024' END AS ENDDATE,
  CASE WHEN doc_id % 5 = 0 THEN 'https://www.census.gov/naics/?input=541330&year=2022' WHEN doc_id % 5 = 1 THEN 'NAICS 926199'
       WHEN doc_id % 5 = 2 THEN '238160 - Roofing' ELSE '' END AS NAICSCODE,
  CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'https://www.bidnetdirect.com/x/' || CAST(doc_id AS STRING)
       ELSE 'https://agency' || CAST(doc_id % 60 AS STRING) || '.gov/bids/' || CAST(doc_id % 350 AS STRING) || '/' END AS URL,
  CASE WHEN doc_id % 3 = 0 THEN 'Promo goods' WHEN doc_id % 3 = 1 THEN 'N/A' ELSE 'standard' END AS BID_CATEGORY,
  CASE WHEN doc_id % 4 = 0 THEN 'AK' WHEN doc_id % 4 = 1 THEN 'nation_7' WHEN doc_id % 4 = 2 THEN 'Not provided' ELSE 'in NATION_3 area' END AS LOCATION_STATE,
  CASE WHEN doc_id % 5 = 0 THEN 'Private  Company' WHEN doc_id % 5 = 1 THEN 'County government' WHEN doc_id % 5 = 2 THEN 'gov'
       WHEN doc_id % 5 = 3 THEN 'Not provided' ELSE 'corporate' END AS POSTING_ENTITY,
  CASE WHEN doc_id % 3 = 0 THEN 'call us; Buyer' || CAST(doc_id % 900 AS STRING) || '@rivertown' || CAST(doc_id % 70 AS STRING) || '.gov'
       WHEN doc_id % 3 = 1 THEN 'not provided' ELSE '' END AS CONTACT_EMAIL,
  CASE WHEN doc_id % 4 = 0 THEN 'Bonfire Hub' WHEN doc_id % 4 = 1 THEN 'N/A' WHEN doc_id % 4 = 2 THEN 'DemandStar - Rivertown ' || CAST(doc_id AS STRING)
       ELSE 'Rivertown ' || CAST(doc_id AS STRING) || ' County School District' END AS ISSUING_ORGANIZATION,
  text AS DESCRIPTION,
  CASE WHEN doc_id % 9 = 0 THEN 'SOL-' || CAST(doc_id % 100 * 4 + 1 AS STRING) ELSE 'Not provided' END AS SOLICITATIONNUMBER,
  CASE WHEN doc_id % 10 = 0 THEN 'tp-' || CAST(doc_id % 77 * 7 + 2 AS STRING) ELSE '' END AS THIRD_PARTY_IDENTIFIER,
  lang, source
FROM {documents}""",
    # Model responses: the records of a listing as one JSON text each.
    "responses": """
SELECT 'https://agency' || CAST(doc_id % 60 AS STRING) || '.gov/bids?doc=' || CAST(doc_id AS STRING) AS listing_url,
  doc_id % 60 + 1 AS source_id,
  CASE WHEN doc_id % 29 = 3 THEN 'not json' WHEN doc_id % 29 = 4 THEN '{{"bids":[]}}' ELSE
  '{{"bids":[{{"TITLE":"' || CASE WHEN doc_id % 7 = 0 THEN 'RFP ' || source ELSE 'Delivery of goods ' || CAST(doc_id % 400 AS STRING) END
  || '","ENDDATE":["' || CASE WHEN doc_id % 6 = 2 THEN '2023-12-31' WHEN doc_id % 6 = 3 THEN '2/15/2024' ELSE '2024-02-20' END
  || '"],"NAICSCODE":' || CASE WHEN doc_id % 5 = 0 THEN '541330' ELSE '""' END
  || ',"URL":"' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://agency' || CAST(doc_id % 60 AS STRING) || '.gov/bids/' || CAST(doc_id % 350 AS STRING) END
  || '","POSTING_ENTITY":"' || CASE WHEN doc_id % 5 = 0 THEN 'corporate' ELSE 'government' END
  || '","CONTACT_EMAIL":["n/a","Buyer' || CAST(doc_id % 900 AS STRING) || '@rivertown.gov"],"ISSUING_ORGANIZATION":"Rivertown '
  || CAST(doc_id % 300 AS STRING) || '","SOLICITATIONNUMBER":"S-' || CAST(doc_id % 450 AS STRING) || '","DESCRIPTION":"'
  || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')
  || '"}},{{"TITLE":"Second notice ' || CAST(doc_id AS STRING) || '","ENDDATE":"March 5, 2024","URL":null,"DESCRIPTION":""}}]}}' END AS raw_json,
  'page ' || source AS page_text,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'document text of ' || source || ' in ' || lang END AS pdf_text
FROM {documents}""",
}

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table over the given ones."""
    sql = ADAPTERS[name]
    used = {t: given(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), **used)


def oracle_ctes(*names: str) -> str:
    """The adapters as common table expressions for a SQL oracle, where the given tables are views of their names."""
    plain = {t: t for t in TABLES}
    return ",\n".join(f'"{n}" AS ({ADAPTERS[n].format(**plain)})' for n in names)
