"""SQL of the save path's outcomes, for the second engine."""

from __future__ import annotations

from tenderflow.plans.adapters import oracle_ctes
from tenderflow.plans.oracles import (
    FINGERPRINT,
    KEEP,
    MASTER,
    NOT_EXPIRED,
    ORACLES,
    PK,
    PREFIXED,
    REASON,
    VERDICT,
    add,
    cleaned,
    day_of,
    identity,
    listing_key,
    matches,
    naics_sql,
    portal,
    tr,
    tx,
    words,
)
from tenderflow.plans.promotion_sql import FOUND, PROBE, greedy

PARSED = ORACLES["parse_model_responses"].removeprefix("WITH " + oracle_ctes("responses") + "\n")
CLEAN = cleaned("DESCRIPTION")
BODY = f"CASE WHEN {CLEAN} IN ('', '0') AND {tx('pdf_text')} NOT IN ('', '0') THEN pdf_text ELSE {CLEAN} END"

ROWS = f"""parsed AS ({PARSED}),
 ex0 AS (SELECT p.*, r.pdf_text, row_number() OVER (ORDER BY p.source_id, p.listing_url, p.pos) AS row_no FROM parsed p JOIN "responses" r USING (listing_url)),
 ex1 AS (SELECT row_no, listing_url, source_id, pos, TITLE AS raw_title, {PREFIXED} AS TITLE, URL, ENDDATE, NAICSCODE, SOLICITATIONNUMBER, THIRD_PARTY_IDENTIFIER,
   {BODY} AS DESCRIPTION, NOT {NOT_EXPIRED} AS expired FROM ex0),
 ex2 AS (SELECT e.* EXCLUDE (NAICSCODE, URL), {naics_sql('NAICSCODE', 'DESCRIPTION', 'TITLE', 'listing_url')} AS NAICSCODE,
   CASE WHEN {portal('listing_url')} THEN '' WHEN {tr('URL')} <> '' AND NOT {portal('URL')} THEN {tr('URL')} ELSE {tr('listing_url')} END AS URL,
   coalesce(t.ID, h.mid, m.ID, o.mid, source_id) AS BID_URL_ID
  FROM ex1 e LEFT JOIN src ON sid = source_id LEFT JOIN (SELECT ID FROM "BIDURL") t ON t.ID = tp AND tp > 0 LEFT JOIN (SELECT ID FROM "BIDURL") m ON m.ID = source_id
   LEFT JOIN ix o ON o.u = own LEFT JOIN ix h ON h.u = {listing_key('listing_url')} WHERE NOT expired),
 k AS ({identity('ex2', 'row_no', day_of('ENDDATE'))}),
 jd AS (SELECT *, row_no AS id, row_no AS pid, raw_title IN ('', '0') AS blank, {VERDICT} AS reason FROM k),
 pr AS (SELECT * FROM jd WHERE NOT blank),
 hits AS ({matches('pr', 'pk', 'id', 0)} UNION ALL {matches('pr', 'lk', 'ID', 1)}),
 best AS (SELECT pid, t, r FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY t, r, rid) AS n FROM hits) WHERE n = 1),
 nw AS (SELECT *, reason IN {KEEP} AS is_bid FROM pr WHERE pid NOT IN (SELECT pid FROM best)),
 run AS (SELECT id, is_bid, 'run' || listing_url || chr(1) || f AS k FROM (SELECT id, is_bid, listing_url, unnest({FINGERPRINT}) AS f FROM nw) WHERE f IS NOT NULL),
 pk_ AS (SELECT id, x.k AS k FROM (SELECT id, unnest({PROBE}) AS x FROM nw) WHERE x IS NOT NULL UNION SELECT id, k FROM run),
 fk AS (SELECT id, k FROM (SELECT id, unnest({FOUND}) AS k FROM nw WHERE is_bid) WHERE k IS NOT NULL UNION SELECT id, k FROM run WHERE is_bid),
 {greedy('nw', 'pk_', 'fk')}"""
OUTCOME = f"""SELECT jd.row_no, jd.listing_url, pos, CASE WHEN blank THEN 'rejected' WHEN best.r IS NOT NULL OR NOT g.kept THEN 'duplicate' WHEN reason IN {KEEP} THEN 'saved' ELSE 'rejected' END AS outcome,
 CASE WHEN blank THEN 'blank_title' WHEN best.r IS NOT NULL THEN CASE WHEN t = 0 THEN 'bids_temp' ELSE 'bid' END || ':' || [{words(REASON)}][best.r + 1]
  WHEN NOT g.kept THEN 'in_run' ELSE reason END AS why FROM jd LEFT JOIN best USING (pid) LEFT JOIN greedy g ON g.id = jd.id
UNION ALL SELECT row_no, listing_url, pos, 'expired', 'expired' FROM ex1 WHERE expired"""
for name in ("ingest_extracts", "ingest_extracts_stream"):  # one batch of the stream holds all responses
    add(name, "responses bids_temp bid bid_url BIDURL", OUTCOME, ",\n".join([PK, MASTER, ROWS]), recursive=True)
