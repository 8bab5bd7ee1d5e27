"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target number of words. Its target over its size is the expected number of copies of a word: the
whole part of it is certain copies of every document, the rest f is drawn. A document of n words has the inclusion odds
f / (1 - f) * sqrt(n / mean n of the source), so longer documents, which hold more context, come more often than short
ones, and empty ones never. Documents are ranked by random odds over inclusion odds, (u / (1 - u)) / odds, and each
source takes whole documents in this order until the words it still misses are filled (the last one is taken if that
comes nearer to the target): a sample of fixed size in words, whose inclusion probabilities are in effect those odds
times one factor of the source. u is a hash of the document's id and a seed, so reruns agree.

No group is sorted in one task: ranks (as rank / (1 + rank), which has their order) are first summed into BINS bins per
source with map-side combination, then into BINS finer bins inside the one bin where a source's sample ends, and only
the rows of that last bin (about a 16 millionth of a source) are ordered by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import WORD, guarded_join, staged

#: Bins of each of the two passes that find where a source's sample ends.
BINS = 4096
#: 52 random bits, exact as a double.
_BITS = 4503599627370496


def words(text: str | Column) -> Column:
    """Number of words; null counts none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """52 bits of md5(id|seed) as a long; a null id hashes as an empty one."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int) -> DataFrame:
    """One row per source (mx_source, mx_size) -> also mx_target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. All words are shared by weight; no source gets
    more than cap times its own size, and the excess is shared again by weight until none is above. In closed form:
    with sources in order of cap * size / weight, those whose ratio is below the common share per weight are full.
    The table has a row per source, so its windows are small.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("mx_source").isNull(), "mx_source")
    ranked = sizes.withColumn("mx_w", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("long"))
    ranked = ranked.withColumn("mx_full", F.lit(cap) * F.col("mx_size"))
    by_ratio = everything.orderBy((F.col("mx_full") / F.col("mx_w")), F.col("mx_source").isNull(), "mx_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("mx_size").over(everything)
    # the share per weight if all sources before this one are full
    share = (total - F.coalesce(F.sum("mx_full").over(before), F.lit(0))).cast("double") / F.sum("mx_w").over(rest)
    shared = ranked.withColumn("mx_share", share)
    shared = shared.withColumn("mx_open", F.col("mx_share") * F.col("mx_w") <= F.col("mx_full"))
    # the first source that isn't full fixes the share; if sources that hold nothing come last, none is open
    first = F.min(F.when(F.col("mx_open"), F.struct((F.col("mx_full") / F.col("mx_w")).alias("r"), F.col("mx_source").isNull().alias("z"), F.col("mx_source").alias("s"), F.col("mx_share").alias("v")))).over(everything)
    level = first["v"]
    goal = F.when(level.isNull(), F.col("mx_full").cast("double")).otherwise(F.least(F.col("mx_full").cast("double"), level * F.col("mx_w")))
    return shared.select("mx_source", "mx_size", goal.alias("mx_target"))


def _goal(df: DataFrame) -> DataFrame:
    """Copies that are certain, the odds of one more and the words that the sample must still bring."""
    ratio = F.when(F.col("mx_size") > 0, F.col("mx_target") / F.col("mx_size")).otherwise(F.lit(0.0))
    df = df.withColumn("mx_sure", F.floor(ratio).cast("long"))
    part = ratio - F.col("mx_sure")
    df = df.withColumn("mx_odds", F.when(part > 0, part / (F.lit(1.0) - part)))
    return df.withColumn("mx_miss", F.col("mx_target") - F.col("mx_sure") * F.col("mx_size"))


def pareto_order(u: Column, odds: Column) -> Column:
    """rank / (1 + rank) for rank = (u / (1 - u)) / odds; u in steps of 2**-52. Null without odds."""
    # with u's odds as a / b: a / b / odds / (1 + a / b / odds) = a / (a + b * odds)
    a, b = u + F.lit(0.5), F.lit(float(_BITS)) - u - F.lit(0.5)
    return F.when(odds > 0, a / (a + b * odds))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, cap: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """docs, or its columns keep, with columns size, source_size, target and copies (whole copies of the document that
    the mix takes).

    Null or empty texts have size 0 and are taken as often as is certain, without effect. A null source is a source of
    its own, the last. Rows that repeat an id share its random number; rows that tie in rank are decided together.
    Columns of these names are replaced; names that start with mx_ are reserved. An empty table gives no rows. Texts
    are only counted, so very long ones are as any other; without text in keep that is done once.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*kept, words(text).alias("size"), uniform(F.col(doc_id), seed).alias("mx_u"), F.col(source).alias("mx_src"))
    if text in kept:
        light = staged(sized.select("mx_src", "size", "mx_u"))
    else:
        sized = light = staged(sized)
    totals = light.groupBy(F.col("mx_src").alias("mx_source")).agg(F.sum("size").alias("mx_size"), F.count_if(F.col("size") > 0).alias("mx_many"))
    many = F.col("mx_size") / F.when(F.col("mx_many") > 0, F.col("mx_many"))
    sources = staged(totals.withColumn("mx_mean", many).drop("mx_many"))
    goals = _goal(targets(sources.drop("mx_mean"), cap)).join(sources.select(F.col("mx_source").alias("mx_s2"), "mx_mean"), F.col("mx_source").eqNullSafe(F.col("mx_s2"))).drop("mx_s2")
    goals = staged(goals)

    def ranked(rows: DataFrame, goals: DataFrame) -> DataFrame:
        both = guarded_join(rows, goals, F.col("mx_src").eqNullSafe(F.col("mx_source")))
        odds = F.col("mx_odds") * F.sqrt(F.col("size") / F.col("mx_mean"))
        return both.withColumn("mx_t", pareto_order(F.col("mx_u").cast("double"), odds))

    bin_ = F.floor(F.col("mx_t") * F.lit(float(BINS * BINS))).cast("long")
    drawn = ranked(light, goals).filter("mx_t is not null").select("mx_src", "size", "mx_t", "mx_miss", bin_.alias("mx_bin"))
    drawn = drawn.withColumn("mx_b", F.expr(f"mx_bin div {BINS}")).withColumn("mx_f", F.expr(f"mx_bin % {BINS}"))

    def ending(sums: DataFrame, miss: str, bin_: str) -> DataFrame:
        """The bin of each source in which its sample ends, and the words it still misses there."""
        upto = Window.partitionBy("mx_source").orderBy(bin_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("mx_run", F.sum("mx_sum").over(upto))
        return run.filter((F.col("mx_run") >= F.col(miss)) & (F.col("mx_run") - F.col("mx_sum") < F.col(miss)))

    coarse = drawn.groupBy(F.col("mx_src").alias("mx_source"), "mx_b", "mx_miss").agg(F.sum("size").alias("mx_sum"))
    left = F.col("mx_run") - F.col("mx_sum")
    first = staged(ending(coarse, "mx_miss", "mx_b").select(F.col("mx_source").alias("mx_s1"), F.col("mx_b").alias("mx_b1"), (F.col("mx_miss") - left).alias("mx_left")))
    inside = guarded_join(drawn, first, F.col("mx_src").eqNullSafe(F.col("mx_s1")) & (F.col("mx_b") == F.col("mx_b1")))
    second = inside.groupBy(F.col("mx_src").alias("mx_source"), "mx_b", "mx_f", "mx_left").agg(F.sum("size").alias("mx_sum"))
    second = staged(ending(second, "mx_left", "mx_f").select(F.col("mx_source").alias("mx_s1"), F.col("mx_b").alias("mx_b1"), F.col("mx_f").alias("mx_f1"), (F.col("mx_left") - left).alias("mx_last")))
    # inside that bin, rank by rank
    last = guarded_join(drawn, second, F.col("mx_src").eqNullSafe(F.col("mx_s1")) & (F.col("mx_b") == F.col("mx_b1")) & (F.col("mx_f") == F.col("mx_f1")))
    last = last.groupBy("mx_src", "mx_t", "mx_last").agg(F.sum("size").alias("mx_sum"))
    upto = Window.partitionBy("mx_src").orderBy("mx_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("mx_run", F.sum("mx_sum").over(upto))
    # a rank is in the sample if half of it or more is still missed
    within = last.filter(F.col("mx_run") - F.col("mx_sum") / 2 <= F.col("mx_last"))
    within = within.groupBy(F.col("mx_src").alias("mx_s3")).agg(F.max("mx_t").alias("mx_max"))
    cut = second.join(within, F.col("mx_s1").eqNullSafe(F.col("mx_s3")), "left").select(F.col("mx_s1").alias("mx_cs"), (F.col("mx_b1") * BINS + F.col("mx_f1")).alias("mx_end"), "mx_max")
    # all ranks below the last bin, and those of it that are within; nothing if the source misses no words
    plan = staged(goals.join(cut, F.col("mx_source").eqNullSafe(F.col("mx_cs")), "left").drop("mx_cs"))
    joined = ranked(sized, plan)
    more = F.when((bin_ < F.col("mx_end")) | (F.col("mx_t") <= F.col("mx_max")), 1).otherwise(0)
    return joined.select(*kept, "size", F.col("mx_size").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_sure") + more).cast("long").alias("copies"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as often as the mix takes it; rows taken 0 times go."""
    return mixed.filter("copies > 0").withColumn("mx_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


#: The same by SQL: ranks by one window per source, which DuckDB affords on small tables.
MIX_CTES = r"""
mx_sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|7'), 1, 13))::BIGINT AS u
  FROM mx_docs
),
mx_sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM mx_sized GROUP BY source),
mx_weights AS (
  SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS full_size FROM mx_sources
),
mx_shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share
  FROM mx_weights
),
mx_level AS (SELECT arg_min(share, full_size / w) AS v FROM mx_shares WHERE share * w <= full_size),
mx_targets AS (
  SELECT source, source_size, CASE WHEN v IS NULL THEN full_size::DOUBLE ELSE least(full_size::DOUBLE, v * w) END AS target FROM mx_shares, mx_level
),
mx_goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS sure,
         CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part
  FROM mx_targets
  JOIN (SELECT source AS s2, sum(size)::DOUBLE / nullif(count_if(size > 0), 0)::DOUBLE AS mean FROM mx_sized GROUP BY source) ON source IS NOT DISTINCT FROM s2
),
mx_odds AS (
  SELECT s.*, g.source_size, g.target, g.sure, target - sure * g.source_size AS miss,
         CASE WHEN part > 0 AND size > 0 THEN part / (1.0::DOUBLE - part) * sqrt(size::DOUBLE / mean) END AS odds
  FROM mx_sized s JOIN mx_goals g ON s.source IS NOT DISTINCT FROM g.source
),
mx_drawn AS (SELECT *, (u::DOUBLE + 0.5::DOUBLE) / ((u::DOUBLE + 0.5::DOUBLE) + (4503599627370496::DOUBLE - u::DOUBLE - 0.5::DOUBLE) * odds) AS t FROM mx_odds),
mx_ranks AS (
  SELECT source, t, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY t) AS run, any_value(miss) AS miss
  FROM mx_drawn WHERE t IS NOT NULL GROUP BY source, t
),
mx_cut AS (SELECT source, max(t) AS top FROM mx_ranks WHERE run - n < miss AND run - n / 2 <= miss GROUP BY source),
mx_mixed AS (
  SELECT d.* EXCLUDE (odds, t, miss, sure), sure + CASE WHEN t <= top THEN 1 ELSE 0 END AS copies
  FROM mx_drawn d LEFT JOIN mx_cut c ON d.source IS NOT DISTINCT FROM c.source
)
"""
