"""SQL of the promotion of pending records, for the second engine: greedy in id order by rounds, patches by a fold per target."""

from __future__ import annotations

from tenderflow.plans.catalog import PROMOTED_AT
from tenderflow.plans.oracles import MASTER, PK, STRONG, add, listing_key, matches, tr

PROMOTED = f"TIMESTAMP '{PROMOTED_AT:%Y-%m-%d %H:%M:%S}'"


def keys(strong: str = STRONG) -> tuple[str, str]:
    """Lists of the keys a row looks itself up by, as (rank, key), and of those it can be found by."""
    scope = "CASE WHEN source_key > 0 THEN 'u' || source_key || '|' ELSE 'u*|' END"
    titled = "end_day IS NOT NULL AND title_key <> ''"
    by_title = "CASE WHEN source_key > 0 THEN 'b' || source_key || '|' ELSE 'c|' END || end_day || '|' || title_key"
    code = f"lower({tr('NAICSCODE')})"
    probe = [
        (0, strong, f"{scope} || url_key"), (0, strong, f"{scope} || raw_url"), (1, "sol_key <> ''", "'s|' || sol_key"), (2, "tp_key <> ''", "'t|' || tp_key"),
        (3, "source_key > 0 AND project_key <> ''", "'n' || source_key || '|' || project_key"),
        (4, f"{titled} AND source_key > 0", by_title), (5, f"{titled} AND source_key = 0", by_title),
    ]
    found = [
        ("raw_url <> ''", "'u*|' || raw_url"), ("source_key > 0 AND raw_url <> ''", "'u' || source_key || '|' || raw_url"), ("sol_key <> ''", "'s|' || sol_key"),
        ("tp_key <> ''", "'t|' || tp_key"), (f"source_key > 0 AND {code} <> ''", f"'n' || source_key || '|' || {code}"),
        (f"{titled} AND source_key > 0", "'b' || source_key || '|' || end_day || '|' || title_key"), (titled, "'c|' || end_day || '|' || title_key"),
    ]
    probes = ", ".join(f"CASE WHEN {c} THEN {{'r': {r}, 'k': {k}}} END" for r, c, k in probe)
    return f"[{probes}]", f"[{', '.join(f'CASE WHEN {c} THEN {k} END' for c, k in found)}]"


def greedy(rows: str, probes: str, found: str) -> str:
    """CTE greedy(id, kept) from rows(id), probes(id, k), found(id, k): kept unless an earlier kept row is found by one of its probe keys.

    Every round keeps the open rows that no earlier open row can block, and drops those that a kept one blocks.
    """
    return f"""kk AS (SELECT id, k, bool_or(p) AS p, bool_or(e) AS e FROM (SELECT id, k, true AS p, false AS e FROM {probes} UNION ALL SELECT id, k, false, true FROM {found}) GROUP BY id, k),
 rounds(n, id, st) AS (SELECT 0, id, 0 FROM {rows}
  UNION ALL SELECT n + 1, id, CASE WHEN st > 0 THEN st WHEN bool_or(by_kept) THEN 2 WHEN bool_or(by_open) THEN 0 ELSE 1 END FROM (
   SELECT n, r.id, st, count(*) FILTER (WHERE st = 0) OVER () AS n_open,
    coalesce(p AND min(CASE WHEN e AND st = 1 THEN r.id END) OVER (PARTITION BY k) < r.id, false) AS by_kept,
    coalesce(p AND min(CASE WHEN e AND st = 0 THEN r.id END) OVER (PARTITION BY k) < r.id, false) AS by_open
   FROM rounds r LEFT JOIN kk ON kk.id = r.id) WHERE n_open > 0 GROUP BY n, id, st),
 greedy AS (SELECT id, st = 1 AS kept FROM rounds WHERE n = (SELECT max(n) FROM rounds))"""


PROBE, FOUND = keys()
#: From pk(id, ..., keys of identity) and lk(ID, ...): oc(id, outcome, target).
OUTCOMES = f"""pr AS (SELECT *, id AS pid FROM pk), hits AS ({matches('pr', 'lk', 'ID', 1)}),
 ml AS (SELECT id, rid FROM (SELECT pid AS id, rid, row_number() OVER (PARTITION BY pid ORDER BY t, r, rid) AS n FROM hits) WHERE n = 1),
 nw AS (SELECT * FROM pk WHERE id NOT IN (SELECT id FROM ml)),
 pk_ AS (SELECT id, x.r AS r, x.k AS k FROM (SELECT id, unnest({PROBE}) AS x FROM nw) WHERE x IS NOT NULL),
 fk AS (SELECT id, k FROM (SELECT id, unnest({FOUND}) AS k FROM nw WHERE {tr('TITLE')} <> '') WHERE k IS NOT NULL),
 {greedy('nw', 'pk_', 'fk')},
 firsts AS (SELECT k, min(id) AS first_id FROM fk WHERE id IN (SELECT id FROM greedy WHERE kept) GROUP BY k),
 inb AS (SELECT id, first_id FROM (SELECT id, first_id, row_number() OVER (PARTITION BY id ORDER BY r, first_id) AS n FROM pk_ JOIN firsts USING (k)
   WHERE first_id < id AND id IN (SELECT id FROM greedy WHERE NOT kept)) WHERE n = 1),
 tg AS (SELECT id, 'L' || rid AS target FROM ml UNION ALL SELECT id, 'P' || first_id FROM inb),
 fa AS (SELECT pk.id, {tr('TITLE')} <> '' AS titled, strlen({tr('DESCRIPTION')}) AS size, coalesce(LAST_MODIFIED, CREATED, created_at) AS stamp, target FROM pk LEFT JOIN tg USING (id)),
 state0 AS (SELECT 'L' || ID AS target, strlen({tr('DESCRIPTION')}) AS size, coalesce(LAST_MODIFIED, CREATED) AS stamp FROM lk
  UNION ALL SELECT 'P' || id, size, {PROMOTED} FROM fa WHERE target IS NULL AND titled),
 seq AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS n FROM fa WHERE titled AND target IS NOT NULL),
 fold(target, n, size, stamp, id, patched) AS (SELECT target, CAST(0 AS BIGINT), size, stamp, CAST(NULL AS BIGINT), false FROM state0 WHERE target IN (SELECT target FROM seq)
  UNION ALL SELECT target, n, CASE WHEN h THEN own ELSE size END, CASE WHEN h THEN {PROMOTED} ELSE stamp END, id, h
   FROM (SELECT f.target, s.n, f.size, f.stamp, s.id, s.size AS own, s.size > f.size + 50 OR coalesce(s.stamp > f.stamp, false) AS h
    FROM fold f JOIN seq s ON s.target = f.target AND s.n = f.n + 1)),
 oc AS (SELECT fa.id, CASE WHEN fa.target IS NULL AND titled THEN 'inserted' WHEN fa.target IS NULL THEN 'failed' WHEN patched THEN 'patched' ELSE 'skipped' END AS outcome, fa.target
  FROM fa LEFT JOIN fold ON fold.id = fa.id)"""

COLUMNS = ["TITLE", "URL", "BID_URL_ID", "ENTITYID", "NAICSCODE", "LAST_MODIFIED"]
MAPPED = f"""mp AS (SELECT p.id, {tr('p.TITLE')} AS TITLE, p.URL, CASE WHEN p.BID_URL_ID IS NOT NULL THEN
   CASE WHEN p.BID_URL_ID < 1 THEN coalesce(h.mid, p.BID_URL_ID) ELSE coalesce(m.ID, o.mid, h.mid, p.BID_URL_ID) END END AS BID_URL_ID, ENTITYID, NAICSCODE, {PROMOTED} AS LAST_MODIFIED
  FROM "bids_temp" p LEFT JOIN "BIDURL" m ON m.ID = p.BID_URL_ID LEFT JOIN src ON sid = p.BID_URL_ID LEFT JOIN ix o ON o.u = own LEFT JOIN ix h ON h.u = {listing_key('p.source_listing_url')}),
 fr AS (SELECT 'P' || id AS target, (SELECT max(ID) FROM lk) + row_number() OVER (ORDER BY id) AS ID, TITLE, URL, coalesce(BID_URL_ID, 0) AS BID_URL_ID,
  coalesce(ENTITYID, 0) AS ENTITYID, NAICSCODE, LAST_MODIFIED FROM mp JOIN oc USING (id) WHERE outcome = 'inserted'),
 pa AS (SELECT target, {', '.join(f'arg_max({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in COLUMNS)} FROM mp JOIN oc USING (id) WHERE outcome = 'patched' GROUP BY target),
 lv AS (SELECT 'L' || ID AS target, ID, {', '.join(COLUMNS)} FROM lk UNION ALL SELECT target, ID, {', '.join(COLUMNS)} FROM fr)"""
add("promote_pending", "bids_temp bid bid_url BIDURL", f"""SELECT l.ID, {', '.join(f'coalesce(p.{c}, l.{c}) AS "{c}"' for c in COLUMNS)}
 FROM lv l LEFT JOIN pa p USING (target)""", ",\n".join([PK, OUTCOMES, MASTER, MAPPED]), recursive=True)
add("approval_stats", "bids_temp bid", """SELECT CASE outcome WHEN 'inserted' THEN 'approved' WHEN 'failed' THEN 'failed' ELSE 'duplicate' END AS result, count(*) AS n
 FROM oc GROUP BY 1""", ",\n".join([PK, OUTCOMES]), recursive=True)
