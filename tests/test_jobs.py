"""Composed jobs against a row-by-row loop, curation steps, sources and streams."""

import contextlib
import datetime as dt
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tenderflow import schemas
from tenderflow.operators import curate, listing, report
from tenderflow.plans import ingest
from tenderflow.plans.catalog import QUERIES
from tenderflow.session import case_sensitive
from tenderflow.sources import files
from tenderflow.streaming import jobs
from tests.test_linkage import bid_rows, brute_match, keys_of, pair_rank

NOW = dt.datetime(2026, 1, 1)


def table(spark, name, rows):
    names = schemas.schema(name).names
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schemas.schema(name))


def no_sources(spark):
    return table(spark, "bid_url", [])


def loop_promote(pending, live):
    """Approve the pending rows one by one; keys are those of the snapshot."""
    live = [{"pid": None, "at": r["LAST_MODIFIED"], "len": len((r["DESCRIPTION"] or "").strip()), **r} for r in live]
    outcomes, next_id = {}, max(r["ID"] for r in live) + 1
    stored = [(r["ID"], keys_of(r), i) for i, r in enumerate(live)]
    original = len(live)
    for p in sorted(pending, key=lambda r: r["id"]):
        k = keys_of(p)
        hits = [(pair_rank(k, s), sid, i) for sid, s, i in stored]
        # An existing live match wins over a row of this batch.
        ranked = min(((i >= original, r, sid, i) for r, sid, i in hits if r is not None), default=None)
        blank = not (p["TITLE"] or "").strip()
        size = len((p["DESCRIPTION"] or "").strip())
        if ranked:
            target = live[ranked[3]]
            if size > target["len"] + 50 or p["LAST_MODIFIED"] > target["at"]:
                if blank:
                    outcomes[p["id"]] = "any"
                    continue
                outcomes[p["id"]] = "patched"
                for c in ("TITLE", "URL", "DESCRIPTION", "NAICSCODE", "EMAIL"):
                    if p[c] is not None:
                        target[c] = p[c].strip() if c == "TITLE" else p[c]
                target["len"], target["at"] = size, NOW
            else:
                outcomes[p["id"]] = "any" if blank else "skipped"
        elif blank:
            outcomes[p["id"]] = "failed"
        else:
            outcomes[p["id"]] = "inserted"
            new = {**p, "ID": next_id, "len": size, "at": NOW, "TITLE": p["TITLE"].strip()}
            live.append(new)
            stored.append((next_id, k, len(live) - 1))
            next_id += 1
    return outcomes, live


@pytest.mark.parametrize("seed", [3, 4])
def test_promote_pending_like_a_loop(spark, seed):
    rnd = random.Random(seed)

    def dressed(rows, key):
        for r in rows:
            r["DESCRIPTION"] = "d" * rnd.choice([0, 10, 70, 130, 200, 300])
            r["EMAIL"] = rnd.choice([None, "", "a@b.gov"])
            r["LAST_MODIFIED"] = dt.datetime(2025, 1, rnd.randint(1, 28))
            r[key] = r["id"]
        return rows

    live = dressed(bid_rows(8, seed, lambda n: range(1, n + 1)), "ID")
    pending = dressed(bid_rows(40, seed + 50, lambda n: range(100, 100 + n)), "id")
    done = curate.promote_pending(table(spark, "bids_temp", pending), table(spark, "bid", live), no_sources(spark), None, now=NOW)
    want, want_live = loop_promote(pending, live)
    got = {r.id: r.outcome for r in done.outcomes.collect()}
    assert {k: v for k, v in got.items() if want[k] != "any"} == {k: v for k, v in want.items() if v != "any"}
    rows = {r.ID: r for r in done.live.collect()}
    assert set(rows) == {r["ID"] for r in want_live}
    for r in want_live:
        for c in ("TITLE", "URL", "DESCRIPTION", "NAICSCODE", "EMAIL"):
            assert rows[r["ID"]][c] == r[c], (r["ID"], c)
    failed = {k for k, v in got.items() if v == "failed"}
    assert {r.id for r in done.pending.collect()} == failed
    stats = {r.result: r.n for r in curate.approval_stats(done.outcomes).collect()}
    assert sum(stats.values()) == len(pending) and stats["approved"] == sum(v == "inserted" for v in want.values())


def test_promote_rules(spark):
    def live(**kw):
        return {"ID": 1, "TITLE": "A", "SOLICITATIONNUMBER": "s", "DESCRIPTION": "x" * 10, "LAST_MODIFIED": dt.datetime(2025, 6, 1), "INLINEURL": "1", **kw}

    def run(force=False, **kw):
        p = {"id": 9, "TITLE": "B", "SOLICITATIONNUMBER": "S", "DESCRIPTION": "y" * 10, "LAST_MODIFIED": dt.datetime(2025, 5, 1), **kw}
        done = curate.promote_pending(table(spark, "bids_temp", [p]), table(spark, "bid", [live()]), no_sources(spark), None, now=NOW, force_patch=force)
        return done.outcomes.first().outcome, done.live.orderBy("ID").collect(), done.pending.count()

    assert run()[0] == "skipped" and run()[1][0].TITLE == "A"
    assert run(DESCRIPTION="y" * 60)[0] == "skipped" and run(DESCRIPTION="y" * 61)[0] == "patched"
    outcome, rows, left = run(LAST_MODIFIED=dt.datetime(2025, 7, 1), EMAIL="")
    assert outcome == "patched" and rows[0].TITLE == "B" and rows[0].INLINEURL == "1" and rows[0].EMAIL == "" and left == 0
    assert run(force=True)[0] == "patched"
    outcome, rows, left = run(SOLICITATIONNUMBER="t")
    assert outcome == "inserted" and rows[1].ID == 2 and rows[1].COUNTRY_ID == "us" and rows[1].ENTITYID == 0 and rows[1].LAST_MODIFIED == NOW
    assert run(SOLICITATIONNUMBER="t", TITLE=" ")[0::2] == ("failed", 1)


def test_map_overrides(spark):
    p = table(spark, "bids_temp", [{"id": 1, "TITLE": " T ", "ENTITYID": 1, "STATEID": 2, "BID_URL_ID": 3}])
    over = {"ENTITYID": F.lit("34309"), "STATEID": F.lit(44), "bid_url_id": F.lit(1171), "USERID": F.lit(None)}
    r = curate.map_pending_to_live(p, no_sources(spark), None, now=NOW, overrides=over).first()
    assert (r.ENTITYID, r.STATEID, r.BID_URL_ID, r.USERID, r.TITLE, r.LAST_MODIFIED) == (34309, 44, 1171, None, "T", NOW)


def test_restore_marks(one):
    a, b = curate.restore_marks(F.col("x").cast("timestamp_ntz"), F.col("y").cast("timestamp_ntz"), dedicated=False)
    assert one(b, x="2024-01-02 00:00:00", y="2024-01-01 00:00:00") == dt.datetime(2024, 1, 1)
    assert one(b, x="2024-01-02 00:00:00", y=None) == dt.datetime(2024, 1, 2)
    assert one(a, x="2024-01-02 00:00:00", y=None) is None


def test_groups_and_missing_tables(spark):
    src = table(spark, "bid_url", [{"id": 1, "scrape_group": "VE"}, {"id": 2, "scrape_group": " Production "}, {"id": 3}])
    assert [r[0] for r in report.distinct_groups(src).collect()] == ["Production", "Test", "VE"]
    assert [r[0] for r in report.distinct_groups(no_sources(spark)).collect()] == ["Test"]
    for name in ("BIDURL", "BIDURLHISTORY", "entity"):
        assert files.load_reference_table(spark, name, files.TableLocation(table="no_such_table")).count() == 0
        assert files.load_reference_table(spark, name, files.TableLocation(path="/no/such/folder")).columns == schemas.schema(name).names
    empty = schemas.empty(spark, "BIDURL")
    assert listing.list_unassigned_sources(empty).count() == 0
    assert report.assign_sources_from_history(empty, schemas.empty(spark, "BIDURLHISTORY")).count() == 0


def test_report_range():
    now = dt.datetime(2024, 1, 31, 17, 0)  # already February in Manila
    assert report.report_range(now) == (dt.datetime(2024, 1, 31, 16), dt.datetime(2024, 2, 29, 16))
    lo, hi = report.report_range(now, dt.date(2024, 3, 5), dt.date(2024, 3, 1))
    assert (lo, hi) == (dt.datetime(2024, 2, 29, 16), dt.datetime(2024, 3, 5, 16))


def test_pending_order_and_expiry(spark):
    rows = [{"id": i, "TITLE": "t", "created_at": dt.datetime(2024, 1, 10 - i)} for i in (3, 1, 2)]
    got = listing.list_pending(table(spark, "bids_temp", rows), schemas.empty(spark, "entity"))
    assert [r.id for r in got.collect()] == [1, 2, 3]
    ends = [("",), (None,), ("0",), ("2024-01-19",), ("2024-01-20",), ("Not provided",), ("1/21/2024",)]
    kept = listing.drop_expired(spark.createDataFrame(ends, "ENDDATE string"), dt.date(2024, 1, 20)).collect()
    assert [r[0] for r in kept] == ["", None, "0", "2024-01-20", "1/21/2024"]


# ---------------------------------------------------------------- ingest

def response(url, sid, bids, pdf=""):
    return (url, sid, bids if isinstance(bids, str) else json.dumps({"bids": bids}), "page text", pdf)


RESPONSE = "listing_url string, source_id bigint, raw_json string, page_text string, pdf_text string"


def test_parse_model_responses(spark):
    bids = [
        {"TITLE": ["Road", "works"], "ENDDATE": "2026-05-01", "NAICSCODE": 236220, "ENTITY_ADDRESS": ["1 Main", "Town"], "ENTITY_PHONE": ["5 ", "6"],
         "EMAIL": "n/a; x@y.gov", "DESCRIPTION": {"Scope": "all", "Parts": ["a", "b"]}, "SOLICIATIONNUMBER": "S1", "ISSUING_ORGANIZATION": "Bonfire Hub"},
        {"TITLE": None, "DESCRIPTION": "", "URL": []},
    ]
    df = spark.createDataFrame(
        [response("https://a.gov/open-bids-list", 1, bids, "pdf body"), response("https://b.gov/", 2, "oops"), response("https://c.gov/x", 3, [])], RESPONSE
    )
    got = {(r.listing_url, r.pos): r for r in files.parse_model_responses(df).collect()}
    a = got[("https://a.gov/open-bids-list", 0)]
    assert a.TITLE == "Road works" and a.NAICSCODE == "236220" and a.CONTACT_EMAIL == "x@y.gov" and a.SOLICITATIONNUMBER == "S1"
    assert a.DESCRIPTION.startswith("Scope: all\nParts:\n  0: a\n  1: b\n\n---\n") and a.DESCRIPTION.endswith("Address: 1 Main\nTown\nPhone: 5 , 6")
    assert a.ISSUING_ORGANIZATION == "" and a.POSTING_ENTITY == "uncertain" and a.URL == "https://a.gov/open-bids-list"
    b = got[("https://a.gov/open-bids-list", 1)]
    assert b.TITLE == "Open Bids List" and b.DESCRIPTION == "pdf body"
    assert got[("https://b.gov/", 0)].TITLE == "Bidding Page" and got[("https://b.gov/", 0)].is_fallback
    assert got[("https://c.gov/x", 0)].DESCRIPTION == "page text"


def ingest_tables(spark):
    sources = table(spark, "bid_url", [{"id": i, "url": f"https://s{i}.gov/bids", "name": "N/A"} for i in (1, 2, 3)])
    pending = table(spark, "bids_temp", [{"id": 70, "TITLE": "old", "SOLICITATIONNUMBER": "P1", "URL": ""}])
    live = table(spark, "bid", [{"ID": 80, "TITLE": "older", "THIRD_PARTY_IDENTIFIER": "L1", "URL": ""}])
    entities = table(spark, "entity", [{"id": 5, "name": "Rifle Works", "email": "x@rifle.gov", "website": ""}])
    states = table(spark, "state", [{"id": 6, "name": "Ohio", "abbreviation": "OH"}])
    cats = table(spark, "category", [{"id": 7, "name": "Roads"}])
    return sources, pending, live, entities, states, cats


def random_responses(seed):
    rnd = random.Random(seed)
    rows = []
    for s in (1, 2, 3):
        bids = []
        for _ in range(14):
            bids.append(
                {
                    "TITLE": rnd.choice(["RFP road", "RFP pipe", "Home", "", "RFP road ", "Plain thing"]),
                    "ENDDATE": rnd.choice(["2026-03-01", "2026-04-01", "", "2020-01-01", "soon"]),
                    "URL": rnd.choice(["", f"https://s{s}.gov/bids/{rnd.randint(1, 9)}", "https://x.gov/bids/1"]),
                    "SOLICITATIONNUMBER": rnd.choice(["", "", "P1", "A", "B"]),
                    "THIRD_PARTY_IDENTIFIER": rnd.choice(["", "", "", "L1", "C"]),
                    "NAICSCODE": str(rnd.choice([236220, 238160, 541330, 561720, 237310])),
                    "DESCRIPTION": "text",
                }
            )
        rows.append((f"https://s{s}.gov/bids", s, bids))
    return rows


def loop_ingest(rows, pending, live):
    """The save path one extract at a time."""
    out, stored = {}, {"bids_temp": [dict(r) for r in pending], "bid": live}
    for url, sid, bids in rows:
        seen = set()
        for pos, b in enumerate(bids):
            end = b["ENDDATE"]
            day = dt.datetime.strptime(end, "%Y-%m-%d") if end[:2] == "20" else None
            if end and (day is None or day < NOW):
                out[(sid, pos)] = "expired"
                continue
            if not b["TITLE"]:
                out[(sid, pos)] = "rejected"
                continue
            row = {**b, "URL": b["URL"] or url, "BID_URL_ID": sid, "ENDDATE": day, "id": 1000 + len(stored["bids_temp"])}
            k = keys_of(row)
            prints = {f"url:{k['key']}"} if k["key"] else set()
            prints |= {f"sol:{k['sol']}"} if k["sol"] else set()
            prints |= {f"tp:{k['tp']}"} if k["tp"] else set()
            prints |= {f"bc:{k['end']}:{k['title']}"} if k["end"] and k["title"] else set()
            prints |= {f"n:{k['project']}"} if k["project"] else set()
            bid_like = row["TITLE"] != "Home" and len(row["TITLE"].strip()) >= 5 and (
                "RFP" in row["TITLE"] or "bids" in url
            )
            if prints & seen or brute_match(row, stored["bids_temp"], stored["bid"]):
                out[(sid, pos)] = "duplicate"
            elif not bid_like:
                out[(sid, pos)] = "rejected"
            else:
                out[(sid, pos)] = "saved"
                seen |= prints
                stored["bids_temp"].append(row)
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_ingest_like_a_loop(spark, seed):
    sources, pending, live, entities, states, cats = ingest_tables(spark)
    rows = random_responses(seed)
    df = spark.createDataFrame([response(*r) for r in rows], RESPONSE)
    done = ingest.ingest_extracts(df, sources, None, pending, live, entities, states, cats, now=NOW)
    got = {(r.source_id, r.pos): r.outcome for r in done.outcomes.collect()}
    blank = {"TITLE": "", "URL": "", "NAICSCODE": "", "BID_URL_ID": 0, "ENDDATE": None, "SOLICITATIONNUMBER": "", "THIRD_PARTY_IDENTIFIER": ""}
    want = loop_ingest(rows, [{**blank, "id": 70, "SOLICITATIONNUMBER": "P1"}], [{**blank, "id": 80, "THIRD_PARTY_IDENTIFIER": "L1"}])
    assert got == want
    saved = done.saved.orderBy("id").collect()
    assert [r.id for r in saved] == list(range(71, 71 + sum(v == "saved" for v in want.values())))
    assert all(r.SUBSCRIPTIONTYPEID == 10 and r.SETASIDECODEID == 1 and r.created_at == NOW for r in saved)


def test_ingest_resolves_references(spark):
    sources, pending, live, entities, states, cats = ingest_tables(spark)
    bids = [{"TITLE": "RFP one", "ENDDATE": "2026-05-01", "LOCATION_STATE": "oh", "BID_CATEGORY": "road", "DESCRIPTION": "write X@rifle.gov\nNot provided", "POSTING_ENTITY": "corporate"}]
    df = spark.createDataFrame([response("https://s1.gov/bids", 1, bids)], RESPONSE)
    directory = spark.createDataFrame([(4, "D")], "id bigint, label string")
    r = ingest.ingest_extracts(df, sources, None, pending, live, entities, states, cats, now=NOW, assignee=4, directory=directory).saved.first()
    assert (r.ENTITYID, r.STATEID, r.CATEGORYID, r.USERID) == (5, 6, 7, 4)
    assert r.TITLE == "Corporate: RFP one" and r.DESCRIPTION == "write X@rifle.gov" and r.EMAIL == "X@rifle.gov"


def test_manual_batch(spark):
    sources, pending, live, *_ = ingest_tables(spark)
    base = ("d", "", "https://q.gov/bids/1", dt.datetime(2026, 5, 1), "", None, None)
    entries = spark.createDataFrame(
        [(1, 1, None, False, 9, dt.datetime(2025, 12, 31), "First one", *base), (2, 1, None, True, 9, dt.datetime(2025, 12, 31), "First one", *base),
         (3, 2, None, True, 8, dt.datetime(2025, 12, 30), "Other", "d", "", "https://q.gov/bids/2", None, "", "Z", None)],
        "entry_id bigint, source_id bigint, listing_url string, approve boolean, actor_user_id bigint, start_time timestamp_ntz, TITLE string, "
        "DESCRIPTION string, EMAIL string, URL string, ENDDATE timestamp_ntz, NAICSCODE string, SOLICITATIONNUMBER string, THIRD_PARTY_IDENTIFIER string",
    )
    done = ingest.manual_bid_batch(entries, sources, schemas.empty(spark, "failed_bid_urls"), schemas.empty(spark, "bid_url_history"), None, pending, live, now=NOW)
    assert {r.entry_id: r.outcome for r in done.outcomes.collect()} == {1: "pending", 2: "duplicate", 3: "approved"}
    assert {r.TITLE for r in done.pending.collect()} == {"old", "First one"}
    assert {r.TITLE for r in done.promotion.live.collect()} == {"older", "Other"}
    assert {(r.bid_url_id, r.user_id) for r in done.visits.history.collect()} == {(1, 9), (2, 8)}
    assert {r.id for r in done.visits.sources.where("last_scraped_at is not null").collect()} == {1, 2}


# ---------------------------------------------------------------- source lists and export

def test_import_source_list(spark, tmp_path):
    lines = ["u1|One|2024-01-02 03:04:05|0|5kg|7|1|0|12|1|0", "", "u2| One |||||||||", "u1|Two|||||||||", "u3||||||||||extra", "u4||||||||||", "short|x", "old|Z|||||||||", "u5|Kept|||||||||"]
    path = tmp_path / "up.txt"
    path.write_text("\n".join(lines))
    src = table(spark, "bid_url", [{"id": 4, "url": "old", "name": "o", "scrape_group": "Test"}, {"id": 9, "url": "u5", "name": "Kept", "scrape_group": "VE"}])
    new = files.import_source_list(files.read_source_lines(spark, str(path)), src)
    got = {r.url: r for r in new.collect()}
    assert set(got) == {"u1", "u3", "u4", "u5"}
    assert got["u1"].start_time == dt.datetime(2024, 1, 2, 3, 4, 5) and got["u1"].end_time is None and got["u1"].weight == 5 and got["u1"].checksum == 12
    assert [r.id for r in files.append_sources(src, new).orderBy("id").collect()] == [4, 9, 10, 11, 12, 13]


def test_export(spark, tmp_path):
    m = table(spark, "BIDURL", [{"ID": 2, "URL": "a<b>&'\"", "NAME": "1.5", "USER_ID": 0, "END_TIME": dt.datetime(2024, 1, 1, 2)}, {"ID": 1, "URL": "7", "USER_ID": None}, {"ID": 3, "USER_ID": 4}])
    out = files.export_unassigned(m)
    files.write_export(out, str(tmp_path / "x"), "xml")
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert got[0].startswith('<Row><Cell><Data ss:Type="Number">1</Data></Cell><Cell><Data ss:Type="Number">7</Data></Cell><Cell><Data ss:Type="String"></Data>')
    assert 'a&lt;b&gt;&amp;&#039;&quot;' in got[1] and '<Data ss:Type="String">1.5</Data>' in got[1] and "2024-01-01 02:00:00" in got[1]


# ---------------------------------------------------------------- streams

def finish(writer, path):
    writer.option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()


def batches(spark, path, frames):
    """One file, and so one micro-batch, per frame."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{path}/d={i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_dedupe_stream_across_batches(spark, tmp_path):
    ddl = "id bigint, TITLE string, URL string, SOLICITATIONNUMBER string, THIRD_PARTY_IDENTIFIER string, NAICSCODE string, BID_URL_ID bigint, ENDDATE timestamp_ntz"
    def frame(*rows):
        return spark.createDataFrame([(i, t, u, s, None, "", 0, None) for i, t, u, s in rows], ddl)
    first = frame((1, "a", "x.gov/1", "s1"), (2, "b", "x.gov/2", "s1"))
    second = frame((3, "c", "x.gov/1", ""), (4, "d", "x.gov/2", ""), (5, "e", "x.gov/2", ""))
    stream = batches(spark, tmp_path / "in", [first, second])
    finish(jobs.dedupe_stream(stream, "id", str(tmp_path / "out")), tmp_path / "cp")
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out/kept")).collect()} == {1, 4}


def test_ingest_stream_sees_earlier_batches(spark, tmp_path):
    sources, pending, live, entities, states, cats = ingest_tables(spark)
    tables = {"bid_url": sources, "BIDURL": None, "bids_temp": pending, "bid": live, "entity": entities, "state": states, "category": cats}
    bid = [{"TITLE": "RFP one", "ENDDATE": "2026-05-01", "SOLICITATIONNUMBER": "Q", "DESCRIPTION": "t"}]
    a = spark.createDataFrame([response("https://s1.gov/bids", 1, bid)], RESPONSE)
    b = spark.createDataFrame([response("https://s2.gov/bids", 2, bid)], RESPONSE)
    stream = batches(spark, tmp_path / "in", [a, b])
    finish(jobs.ingest_extracts_stream(stream, lambda s: tables, str(tmp_path / "out"), now=NOW), tmp_path / "cp")
    got = {r.outcome: r.n for r in spark.read.parquet(str(tmp_path / "out/outcomes")).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert got == {"saved": 1, "duplicate": 1}


def test_dedupe_stream_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "k string, ts timestamp")
    out = jobs.dedupe_stream_by_key(batches(spark, tmp_path / "in", [rows]), "k", "ts")
    finish(out.writeStream.format("parquet").option("path", str(tmp_path / "o")), tmp_path / "cp")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def formatted_plan(df):
    """The plan as `explain("formatted")` prints it."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_reach_the_scan(spark, tmp_path):
    table(spark, "bid", [{"ID": 1, "TITLE": "t", "CREATED": NOW, "BID_URL_ID": 1, "USERID": 7}]).write.parquet(str(tmp_path / "bid"))
    bid = spark.read.parquet(str(tmp_path / "bid"))
    src = table(spark, "bid_url", [{"id": 1, "last_scraped_at": NOW}])
    got = listing.list_live_bids(bid, src, now=NOW, user_id=7).select("ID", "TITLE")
    plan = formatted_plan(got)
    assert "GreaterThanOrEqual(CREATED" in plan and "EqualTo(USERID,7)" in plan and "TakeOrderedAndProject" in plan
    assert "DESCRIPTION" not in plan and [r.ID for r in got.collect()] == [1]
    visits = table(spark, "bid_url_history", [])
    activity = report.user_activity_report(
        spark.createDataFrame([(7, "x")], "id bigint, label string"), bid, visits, period=(NOW - dt.timedelta(30), NOW), today=(NOW - dt.timedelta(1), NOW)
    )
    scans = [line for line in formatted_plan(activity).splitlines() if line.startswith("ReadSchema")]
    assert scans == ["ReadSchema: struct<CREATED:timestamp_ntz,USERID:bigint>"]


def test_names_that_differ_in_case_are_written(spark, tmp_path):
    out = QUERIES["normalize_posting_entity"](spark, "/root/testdata/sf0.001")
    out.write.parquet(f"{tmp_path}/out")
    back = case_sensitive(spark).read.parquet(f"{tmp_path}/out")
    assert back.columns == ["doc_id", "POSTING_ENTITY", "posting_entity"]
    assert back.where("POSTING_ENTITY = 'gov' AND posting_entity = 'government'").count() == out.where("POSTING_ENTITY = 'gov'").count() > 0
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_promote_a_few_like_all(spark):
    """A screen of the live rows' keys changes no outcome."""
    live, pending = bid_rows(60, 8, lambda n: range(1, n + 1)), bid_rows(20, 9, lambda n: range(100, 100 + n))
    for r in live:
        r["ID"] = r["id"]
    given = table(spark, "bids_temp", pending), table(spark, "bid", live), no_sources(spark), None
    whole, few = (sorted(curate.promote_pending(*given, now=NOW, few=f).outcomes.collect()) for f in (False, True))
    assert few == whole and {r.outcome for r in whole} >= {"inserted", "skipped"}
