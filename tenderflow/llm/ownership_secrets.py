"""Secret scan with corpus-wide ownership frequency: who else holds the same value.

Candidates are found by patterns, hashed, and counted by distinct repositories and owners over the whole corpus. A value that
several owners hold is a widely copied example; one that a single owner holds, and that does not read like a placeholder, is
live-looking. Only DataFrame expressions are used.

Spans are code points, end exclusive. Kinds, in this order: assign, access and hex (the base), and opaque, a span that the method
adds: a long mixed-case token with digits that lies in no base span and that only one owner holds.

Nulls: a null text is empty; a null repository or owner is one of its own. Repeated rows are scanned each on their own and
count once towards repositories and owners. Other columns are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderflow.llm.common import stored, table

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Own addition.
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|test|(.)\1{5,}"

#: Kind: pattern, group that holds the value, least characters of the value.
KINDS = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16), "opaque": (OPAQUE, 0, 24)}
ORDER = list(KINDS)


def matches(text: str, kind: str) -> Column:
    """The leftmost matches of a kind as an array; null where nothing matches. gap: characters since the match before.

    Values leave the text as hashes only. good: long enough, and for opaque of mixed characters.
    """
    pattern, group, least = KINDS[kind]
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def one(x: Column) -> Column:
        value = x["value"]
        good = F.length(value) >= least
        if kind == "opaque":
            good = good & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        return F.struct(
            F.lit(ORDER.index(kind)).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), good.alias("good"),
            F.sha2(value, 256).alias("value_hash"), (~value.rlike(PLACEHOLDER)).alias("likely"),
        )

    # The piece after the last match has no hit.
    return F.when(F.col(text).rlike(pattern), F.transform(F.filter(found, lambda x: x["hit"].isNotNull()), one))


def candidates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans), both stored. rows: row, doc_id, text_key, repo, owner, some (holds a match). spans: row, repo, owner, kind, start,
    end, value_hash, likely, a span a row, opaque only outside the base.

    Places are running sums and the overlap with the base is a running greatest end and least start, as windows over the spans of a
    row of `docs`, so the work is that of sorting the spans, however many a text has.
    """
    repo = F.col("source") if repo is None else repo
    owner = F.col("source") if owner is None else owner
    df = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"),
        repo.cast("string").alias("repo"), owner.cast("string").alias("owner"),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,good:boolean,value_hash:string,likely:boolean>>")
    hits = F.concat(*[F.coalesce(matches("_t", k), none) for k in ORDER])
    held = stored(df.select("row", "doc_id", F.xxhash64("_t").alias("text_key"), "repo", "owner", hits.alias("hits")), "candidates")
    rows = held.select("row", "doc_id", "text_key", "repo", "owner", (F.size("hits") > 0).alias("some"))

    # Hits of a kind follow each other in order of place, and so do their positions in the array.
    flat = held.select("row", "repo", "owner", F.posexplode("hits").alias("pos", "h")).select("row", "repo", "owner", "pos", "h.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("pos")).cast("int")
    flat = flat.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    base = F.col("kind") < 3
    flat = flat.where("good")
    # A base span that begins at or before this one and ends after its start, or begins after its start and before its end.
    before, after = (Window.partitionBy("row").orderBy(o) for o in (F.asc("start"), F.desc("start")))
    flat = flat.withColumn("_reach", F.max(F.when(base, F.col("end"))).over(before)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(after))
    over = F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    spans = flat.where(base | ~over).select("row", "repo", "owner", "kind", "start", "end", "value_hash", "likely")
    return rows, stored(spans, "spans")


def judged(flat: DataFrame, most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """Stored spans, one a row, with n_repos and n_owners of their value and `live`."""
    # Distinct pairs first: a value that a third of all rows hold is one row per repository before anything is dealt by it.
    held = flat.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("_one")).groupBy("value_hash", "owner").agg(F.count("*").alias("r"))
    counts = stored(
        held.groupBy(F.col("value_hash").alias("_value")).agg(F.sum("r").alias("n_repos"), F.count("*").alias("n_owners")), "ownership"
    )
    live = F.col("likely") & (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    return flat.join(counts, F.col("value_hash") == F.col("_value")).select(
        "row", "kind", "start", "end", "value_hash", "n_repos", "n_owners", live.alias("live")
    )


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), x["kind"].alias("k"), x["end"].alias("e"))))
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None, **limits) -> DataFrame:
    """Per row of `docs`: doc_id, text_key and `spans` with kind, start, end, value_hash, n_repos, n_owners, live; opaque ones only where live."""
    own, spans = candidates(docs, doc_id, text, repo, owner)
    rows = judged(spans, **limits).where((F.col("kind") < 3) | F.col("live"))
    told = rows.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("kind", "start", "end", "value_hash", "n_repos", "n_owners", "live")).alias("told"))
    with_some = own.where("some").join(told, F.col("row") == F.col("_row"), "left").select("doc_id", "text_key", F.col("told").alias("spans"))
    empty = own.where("NOT some").select("doc_id", "text_key", F.lit(None).cast(told.schema["told"].dataType).alias("spans"))
    return with_some.unionByName(empty).withColumn("spans", F.coalesce(F.col("spans"), F.array().cast(told.schema["told"].dataType)))


def redact_live(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", mark: str = "[secret]", **limits) -> DataFrame:
    """`docs` with every live-looking span replaced by `mark`; overlapping spans are one. Columns and row count stay."""
    hit = scan(docs, doc_id, text, **limits)
    hit = hit.withColumn("_live", F.sort_array(F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("a"), s["end"].alias("e")))))
    hit = hit.where(F.size("_live") > 0).select(F.col("doc_id").alias("_s_id"), F.col("text_key").alias("_s_key"), "_live")
    # Rows of equal id and text have equal spans, so one row each is enough; a live value has one owner.
    hit = stored(hit.groupBy("_s_id", "_s_key").agg(F.min("_live").alias("_live")), "live")
    df = docs.join(hit, docs[doc_id].eqNullSafe(F.col("_s_id")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_s_key")), "left")

    def cut(done: Column, x: Column) -> Column:
        """Text kept so far and the place up to which the document is done."""
        fresh = x["a"] >= done["at"]
        kept = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, x["a"] - done["at"]), F.lit(mark))
        return F.struct(F.when(fresh, kept).otherwise(done["out"]).alias("out"), F.greatest(done["at"], x["e"]).alias("at"))

    done = F.aggregate("_live", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut)
    df = df.withColumn("_done", done)
    clean = F.when(F.col("_live").isNotNull(), F.concat(F.col("_done.out"), F.substring(F.col(text), F.col("_done.at") + 1, F.length(text)))).otherwise(F.col(text))
    df = df.withColumn("_clean", clean)
    new = {text: F.col("_clean")}
    if n_chars and n_chars in docs.columns:
        new[n_chars] = F.when(F.col("_live").isNotNull(), F.length("_clean")).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType)
    return df.withColumns(new).select(*docs.columns)


def op7_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    live = F.filter("spans", lambda s: s["live"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        listed(live).alias("live_spans"), (F.size("spans") - F.size(live)).cast("bigint").alias("n_widespread"),
    )
