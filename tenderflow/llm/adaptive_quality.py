"""Quality rules with adaptive thresholds: quantile sketches per language and source in place of fixed cutoffs.

Measures vary from document to document (none is zero for most): the logarithms of the mean word length, of distinct words
against the root of all words, of signs per character and of words that repeat the one before. The sketches (KLL) merge: a
group's sketch is made from partial ones, a language's from its groups and the corpus's from its languages. A group with few
documents takes the sketch of its language, a language with few takes that of the corpus.

A text counts once in its group, however many copies there are. A fence lies `reach` widths outside a quartile of the group; the
width is the distance of that quartile from the median. Near copies can make a group look narrow, so the width is at least the median of
the widths above zero of its language's groups, or, where there are none, of all groups. A measure that has no width anywhere sets no fence. So thresholds follow from the sketches alone.

Nulls: a null text counts as an empty one (no words, so it fails); a null language or source is a group of its own. Equal rows
get equal verdicts. Other columns are never looked at and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import stored, table, with_lookup

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_distinct"]

#: Measure: the sides on which a document can fail.
SIDES = {"word_length": ("low", "high"), "variety": ("low",), "symbols": ("high",), "stutter": ("high",)}
#: Measures of a count: a document where it is zero cannot have too many.
COUNTED = {"symbols": "n_symbols", "stutter": "n_stutter"}
#: Quartile of a side.
QUARTILE = {"low": 0.25, "high": 0.75}
#: Fence: so many widths outside the quartile. Five standard deviations from the median, were a measure normal.
REACH = 6.5
#: A group of fewer texts takes the sketch of the next larger group.
LEAST_ROWS = 100
#: Rejected keys that are sent to every executor, at most; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, lang, source, text_key and the counts. Windows and distinct words are told by 64-bit hashes."""
    df = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.xxhash64(text).alias("text_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_t"),
    )
    df = df.withColumns({
        "_w": F.array_remove(F.split("_t", GAP), ""),
        "_lines": F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != ""),
        "n_symbols": F.length(F.regexp_replace("_t", NO_SYMBOL, "")),
    })
    df = df.withColumns({
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_distinct": F.size(F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w)))),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_stutter": F.size(F.filter("_w", lambda w, i: w == F.get(F.col("_w"), i - 1))),
        "_h": F.when(
            F.size("_w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
        ),
    })
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))

    def twice(x: Column, i: Column) -> Column:
        return F.greatest(*[F.coalesce(F.get(F.col("_s"), i + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)])

    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twice), lambda x: x["p"])))
    fresh = F.transform("_p", lambda p, i: F.least(F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, x: a + x), F.lit(0)))
    return df.select("doc_id", "lang", "source", "text_key", *[F.col(c).cast("bigint").alias(c) for c in COUNTS])


def with_measures(df: DataFrame) -> DataFrame:
    """Add the measures; null where a document has no words."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    half = F.lit(0.5)  # so that documents without a sign or a repeated word still differ by their length
    return df.withColumns({
        "word_length": F.log(F.col("word_chars") / words),
        "variety": F.log(F.col("n_distinct") / F.sqrt(words)),
        "symbols": F.when(words.isNotNull(), F.log((F.col("n_symbols") + half) / (F.col("word_chars") + 1))),
        "stutter": F.log((F.col("n_stutter") + half) / (words + 1)),
    })


def sketches(rated: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per (lang, source): per measure the sketch that rules there: the group's, its language's or the corpus's."""
    names = list(SIDES)
    texts = rated.where("n_words > 0").groupBy("lang", "source", "text_key").agg(*[F.min(c).alias(c) for c in names])
    own = stored(
        texts.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c).alias(c) for c in names]), "sketches",
    )

    def merged(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return stored(
            df.groupBy(*keys).agg(F.sum(f"n{'' if tag == '_l' else '_l'}").alias(f"n{tag}"), *[
                F.kll_merge_agg_double(c if tag == "_l" else f"{c}_l").alias(f"{c}{tag}") for c in names
            ]),
            "sketches",
        )

    by_lang = merged(own, ["lang"], "_l")
    by_all = merged(by_lang.withColumn("_all", F.lit(1)), ["_all"], "_a")
    df = with_lookup(with_lookup(own, by_lang, ["lang"]).withColumn("_all", F.lit(1)), by_all, ["_all"])
    rules = lambda c: F.when(F.col("n") >= least_rows, F.col(c)).when(F.col("n_l") >= least_rows, F.col(f"{c}_l")).otherwise(F.col(f"{c}_a"))
    return df.select("lang", "source", *[rules(c).alias(c) for c in names])


def fences(rated: DataFrame, least_rows: int = LEAST_ROWS, reach: float = REACH) -> DataFrame:
    """One row per (lang, source): low_ and high_ fences of the measures, null where a measure sets none."""
    sides = [(c, side) for c, both in SIDES.items() for side in both]
    at = lambda c, q: F.kll_sketch_get_quantile_double(c, F.lit(q))
    groups = sketches(rated, least_rows)
    df = stored(
        groups.select(
            "lang", "source", *[at(c, QUARTILE[side]).alias(f"{side}_{c}") for c, side in sides],
            *[F.abs(at(c, QUARTILE[side]) - at(c, 0.5)).alias(f"width_{side}_{c}") for c, side in sides],
        ),
        "widths",
    )

    def usual_widths(keys: list[str], tag: str) -> DataFrame:
        wide = lambda c: F.when(F.col(c) > 0, F.col(c))
        usual = [F.percentile_approx(wide(f"width_{side}_{c}"), 0.5).alias(f"{tag}_{side}_{c}") for c, side in sides]
        return stored(df.withColumn("_all", F.lit(1)).groupBy(*keys).agg(*usual), "widths")

    wide = with_lookup(df, usual_widths(["lang"], "lang"), ["lang"]).withColumn("_all", F.lit(1))
    wide = with_lookup(wide, usual_widths(["_all"], "all"), ["_all"])

    def fence(c: str, side: str) -> Column:
        own, lang, corpus = (F.col(f"{tag}_{side}_{c}") for tag in ("width", "lang", "all"))
        width = F.greatest(own, F.coalesce(lang, corpus))
        out = F.lit(reach if side == "high" else -reach) * F.when(width > 0, width)
        return (F.col(f"{side}_{c}") + out).alias(f"{side}_{c}")

    return stored(wide.select("lang", "source", *[fence(c, side) for c, side in sides]), "fences")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **tuning) -> DataFrame:
    """Measures and verdict per document. base_failed: under 20 words, or over 30 % of the words in windows that repeat.

    `broken` lists the fences that a document lies outside of, as high_symbols. `tuning`: least_rows and reach of `fences`.
    """
    rated = with_measures(stored(measures(docs, doc_id, text, lang, source), "measures"))
    df = with_lookup(rated, fences(rated, **tuning), ["lang", "source"])
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))

    def fails(c: str, side: str) -> Column:
        if side == "low":
            return F.col(c) < F.col(f"low_{c}")
        over = F.col(c) > F.col(f"high_{c}")
        return over & (F.col(COUNTED[c]) > 0) if c in COUNTED else over

    outside = [F.when(fails(c, side), F.lit(f"{side}_{c}")) for c, both in SIDES.items() for side in both]
    df = df.withColumns({"base_failed": base, "broken": F.filter(F.array(*outside), lambda x: x.isNotNull())})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **tuning) -> DataFrame:
    """The rows of `docs`, columns unchanged, without those that the verdict rejects."""
    bad = stored(
        verdicts(docs, doc_id, text, lang, source, **tuning).where("NOT kept").select(
            F.col("doc_id").alias("_q_id"), F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), F.col("text_key").alias("_q_text")
        ).distinct(),
        "rejected",
    )
    match = (
        docs[doc_id].eqNullSafe(F.col("_q_id")) & docs[lang].eqNullSafe(F.col("_q_lang")) & docs[source].eqNullSafe(F.col("_q_source"))
        & (F.xxhash64(docs[text]) == F.col("_q_text"))
    )
    small = bad.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if small else bad, match, "left_anti")


def op10_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return verdicts(table(spark, sf_dir, "documents")).select(*columns, F.array_join("broken", ",").alias("broken"))
