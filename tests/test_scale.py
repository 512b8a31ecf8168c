"""What keeps the work on large tables down: each expression once, only wanted rows shuffled, nothing kept longer than it is read."""

import time

from pyspark.sql import functions as F

from tenderflow import session
from tenderflow.functions.identity import derive_identity_keys, probe_keys
from tenderflow.operators import curate
from tenderflow.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_identity_keys_are_made_once(spark):
    """Keys that read an identity column many times do not carry its expression along."""
    row = ("https://a.gov/b", "Corporate: x", None, None, "541330", None, 7)
    df = spark.createDataFrame([row], "URL string, TITLE string, SOLICITATIONNUMBER string, THIRD_PARTY_IDENTIFIER string, NAICSCODE string, ENDDATE date, BID_URL_ID long")
    keyed = derive_identity_keys(df)
    assert [r["key"] for r in keyed.select(F.explode(probe_keys()).alias("k")).where("k is not null").select("k.key").collect()] == ["u7|a.gov/b", "u7|https://a.gov/b", "n7|541330"]
    assert plan_of(keyed.select(probe_keys().alias("k"))).count("corporate:") == 1


def test_incoming_match_screens_the_stored_keys(spark):
    """Stored keys that no incoming record has stay out of the shuffle."""
    assert "hits(" in plan_of(QUERIES["match_duplicates_incoming"](spark, SMALL))


def test_only_rows_that_share_a_key_are_put_in_order(spark):
    """Of a batch, rows whose keys nobody else has, or has on the same side only, never reach the rounds."""
    ddl = "id long, probes array<struct<rank:int,key:string>>, emits array<string>"
    rows = [(1, [(0, "a")], ["a", "x"]), (2, [(0, "a"), (1, "b")], ["a"]), (3, [(0, "c")], ["c"]), (4, [(0, "d")], []), (5, [(1, "d")], []), (6, [(0, "a")], ["a"])]
    out = curate._sharing_rows(spark.createDataFrame(rows, ddl), spark.createDataFrame([(6, 60)], "id long, live_id long"))
    assert {r["id"]: ([k["key"] for k in r["probes"]], r["emits"]) for r in out.collect()} == {1: (["a"], ["a"]), 2: (["a"], ["a"])}


def test_release_deletes_the_shuffles_of_finished_steps(spark):
    """A step that ends long after the last release sets Spark's cleaner going."""
    done = []
    real, session._released[0] = session.gc.collect, time.monotonic() - 2 * session.RELEASE_S
    try:
        session.gc.collect = lambda: done.append(1) or real()
        session.cut_lineage(spark.range(3))
        session.cut_lineage(spark.range(3))
    finally:
        session.gc.collect = real
    assert done == [1]


def test_only_ids_of_new_live_rows_are_put_in_order(spark, monkeypatch):
    """Whole rows are neither sorted nor checkpointed to be numbered."""
    seen, real = [], curate.next_ids
    monkeypatch.setattr(curate, "next_ids", lambda df, *a: seen.append(df.columns) or real(df, *a))
    out = QUERIES["promote_pending"](spark, SMALL)
    assert seen == [["pending_id"]] and out.select("ID").distinct().count() == out.count()
