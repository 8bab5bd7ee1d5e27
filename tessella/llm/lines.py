"""Line dedup by distinct-site spread.

For each line's hash, a HyperLogLog sketch of the sites it occurs on merges by aggregation. Lines whose estimate is far
above the threshold are boilerplate and lines far below are not; those near it get an exact count of distinct sites.
Boilerplate lines are then removed from every document, on all sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import guarded_join, staged, text_key

#: A line on so many sites is boilerplate.
MIN_SITES = 8
#: Shorter lines never are, unless the caller says otherwise.
MIN_CHARS = 10
#: What op4 and the pipeline ask for: every line that isn't blank.
EVERY_LINE = 1
#: log2 of the sketch's registers; up to 128 sites are listed exactly, beyond that the standard error is 3.3 %.
LOG_REGISTERS = 10
#: Estimates within this share of the threshold are counted exactly (6 standard errors).
NEAR = 0.2


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _counted(line: Column, min_chars: int) -> Column:
    return (F.length(line) >= min_chars) & (F.length(F.trim(line)) > 0)


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes (h) of lines that occur on at least min_sites sites. A null site is a site of its own; null and empty
    texts have no counted lines."""
    # each line of a document once; sites as text with a mark, so that null differs from every name
    per_doc = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"), F.explode(F.filter(F.array_distinct(_lines(text)), lambda x: _counted(x, min_chars))).alias("line"))
    lines = per_doc.select("site", _hash(F.col("line")).alias("h"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"))
    # a line on fewer sites than any near count can't matter again
    likely = staged(spread.filter(F.col("sites") >= min_sites * (1 - NEAR)))
    sure = likely.filter(F.col("sites") > min_sites * (1 + NEAR)).select("h")
    near = staged(likely.filter(F.col("sites") <= min_sites * (1 + NEAR)).select("h"))
    exact = guarded_join(lines, near, "h").groupBy("h", "site").count().groupBy("h").count().filter(F.col("count") >= min_sites).select("h")
    return staged(sure.union(exact))


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text replaced by its remaining lines, and columns n_lines and n_removed.

    A null text stays null and has no lines; an empty one has one empty line. Line ends are single newlines. Repeated
    rows and ids are treated alike, as only lines decide. Columns named n_lines and n_removed are replaced; names that
    start with ld_ are reserved. An empty table gives no rows.
    """
    kept = docs.drop("n_lines", "n_removed")
    bad = boilerplate(docs, text, site, min_sites, min_chars)
    # which of its lines go, for each distinct text that has any
    own = docs.select(text_key(text).alias("ld_key"), F.explode(F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _counted(x, min_chars)), _hash))).alias("h"))
    # written first, so that the join below deals both sides out itself and can split a text that many rows share
    hits = staged(guarded_join(own, bad, "h").groupBy("ld_key").agg(F.collect_set("h").alias("ld_bad")))
    joined = kept.withColumn("ld_own", text_key(text)).join(hits.hint("merge"), F.col("ld_own") == F.col("ld_key"), "left")
    lines = _lines(text)
    remaining = F.filter(lines, lambda x: ~(_counted(x, min_chars) & F.array_contains("ld_bad", _hash(x))))
    out = joined.withColumn("ld_left", F.when(F.col("ld_bad").isNull(), lines).otherwise(remaining))
    out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_removed", F.col("n_lines") - F.coalesce(F.size("ld_left"), F.lit(0)))
    return out.withColumn(text, F.when(F.col("ld_bad").isNull(), F.col(text)).otherwise(F.array_join("ld_left", "\n"))).select(*kept.columns, "n_lines", "n_removed")


#: The same by SQL for lines of every length, from ld_docs to ld_kept.
ORACLE_CTES = """
ld_bad AS (
  SELECT line FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM ld_docs)
  WHERE length(trim(line, ' ')) > 0
  GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '')) >= 8
),
ld_list AS (SELECT coalesce(list(line), []) AS bad FROM ld_bad),
ld_kept AS (
  SELECT d.* EXCLUDE (text), CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, x)), chr(10)) END AS text,
         coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines,
         coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(bad, x))), 0)::BIGINT AS n_removed
  FROM ld_docs d, ld_list
)
"""
