"""Quotation linking in DataFrame functions only.

A message's lines are parsed into quote levels (> marks at their beginning). A quoted passage is a run of lines of one
level; its lines, without marks, in lower case and with white space folded, are hashed as a whole and one by one. The
own lines of every message, between its quotes, are hashed likewise. Passages join the earliest message of the
conversation that has them; a message's parent is the earlier message found for its least quote level, whole passages
first. Parents lead to the root of each thread by doubling, and messages are ordered by root and turn, so that a reply
stands after what it replies to. Quoted lines that were linked are cut from the bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged

#: The marks at the beginning of a quoted line.
MARKS = r"^\s*(?:>\s?)+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def _plain(line: Column) -> Column:
    """A line without marks, in lower case, white space folded."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with ql_lines (level, plain, raw of each line; none if the text is null) and ql_runs: the passages, as
    (level, plain lines joined by newlines, whether it has one line)."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n", -1), lambda x: F.struct(_level(x).alias("level"), _plain(x).alias("plain"), x.alias("raw")))
    df = messages.withColumn("ql_lines", F.when(F.col(text).isNotNull(), lines).otherwise(F.filter(lines, lambda x: F.lit(False))))
    # passages of a level: its lines with breaks where another level stands between, split at the breaks
    levels = F.array_sort(F.array_distinct(F.transform("ql_lines", lambda x: x["level"])))
    brk = F.lit("\u0000")

    def of_level(level: Column) -> Column:
        marked = F.array_join(F.transform("ql_lines", lambda x: F.when(x["level"] == level, F.when(x["plain"] == "", F.lit("")).otherwise(x["plain"])).otherwise(brk)), "\n")
        parts = F.transform(F.split(marked, "\u0000"), lambda p: F.regexp_replace(F.regexp_replace(p, "^\n+|\n+$", ""), "\n\n+", "\n"))
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(level.alias("level"), p.alias("passage")))

    return df.withColumn("ql_runs", F.flatten(F.transform(levels, of_level)))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, n_lines, n_quoted (quoted lines), max_level, parent_turn, root_turn,
    body (the text without linked quotes' lines), in reply order inside (conv_id, root_turn, turn).

    A quoted line is linked if it, or the passage it stands in, is found in an earlier message of the conversation.
    Quotes that are found nowhere stay in the body, as they may be citations. Rows without a conversation or turn, with
    a null text, or that repeat a turn are kept; the first two have no links, the last share theirs. An empty table
    gives no rows; other columns are dropped. The lines of one text are an array of its row, so a very long text costs
    a few times its own length.
    """
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = parsed(base)
    keys = rows.filter("conv_id is not null and turn is not null")
    # what each message says itself: its own passages (level 0) and their lines
    said = keys.select("conv_id", "turn", F.explode(F.filter("ql_runs", lambda r: r["level"] == 0)).alias("r")).select("conv_id", "turn", F.col("r.passage").alias("p"))
    units = said.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array("p"), F.split("p", "\n")))).alias("u"))
    # the earliest message that says it; map-side combined, so a phrase that all say is one row for each task
    first = units.groupBy("conv_id", F.xxhash64("u").alias("h"), F.length("u").alias("size")).agg(F.min("turn").alias("said_turn"))
    quoted = keys.select("conv_id", "turn", F.explode(F.filter("ql_runs", lambda r: r["level"] > 0)).alias("r")).select("conv_id", "turn", F.col("r.level").alias("level"), F.col("r.passage").alias("p"))
    asked = quoted.select("conv_id", "turn", "level", F.col("p").alias("u"), F.lit(0).alias("part")).union(
        quoted.select("conv_id", "turn", "level", F.explode(F.split("p", "\n")).alias("u"), F.lit(1).alias("part"))
    )
    asked = staged(asked.select("conv_id", "turn", "level", "part", "u", F.xxhash64("u").alias("h"), F.length("u").alias("size")).distinct())
    if asked.limit(1).count():
        found = staged(asked.join(staged(first).hint("merge"), ["conv_id", "h", "size"]).filter("said_turn < turn").select("conv_id", "turn", "level", "part", "u", "said_turn"))
        # the least level is the direct reply; whole passages before lines, long ones before short ones
        each = found.withColumn("plain", F.explode(F.split("u", "\n")))
        best = each.groupBy("conv_id", "turn").agg(
            F.min(F.struct("level", "part", (-F.length("u")).alias("size"), F.col("said_turn").alias("parent"))).alias("b"), F.collect_set(F.struct("level", "plain")).alias("ql_found")
        ).select("conv_id", "turn", F.col("b.parent").alias("parent_turn"), "ql_found")
        best = staged(best)
        roots = _roots(best.select("conv_id", "turn", F.col("parent_turn").alias("up")))
        own = best.join(roots.hint("merge"), ["conv_id", "turn"], "left").select(F.col("conv_id").alias("ql_c"), F.col("turn").alias("ql_t"), "parent_turn", "root_turn", "ql_found")
        rows = rows.join(own.hint("merge"), (F.col("conv_id") == F.col("ql_c")) & (F.col("turn") == F.col("ql_t")), "left").drop("ql_c", "ql_t")
    else:
        nothing = F.filter(F.transform("ql_lines", lambda x: F.struct(x["level"].alias("level"), x["plain"].alias("plain"))), lambda x: F.lit(False))
        rows = rows.withColumn("parent_turn", F.lit(None).cast(rows.schema["turn"].dataType)).withColumn("root_turn", F.col("parent_turn")).withColumn("ql_found", nothing)
    in_found = lambda x: F.coalesce(F.array_contains("ql_found", F.struct(x["level"].alias("level"), x["plain"].alias("plain"))), F.lit(False))
    stays = F.filter("ql_lines", lambda x: (x["level"] == 0) | ~in_found(x) & (x["plain"] != ""))
    body = F.when(F.col("text").isNull(), None).when(F.coalesce(F.size("ql_found"), F.lit(0)) <= 0, F.col("text")).otherwise(F.trim(F.array_join(F.transform(stays, lambda x: x["raw"]), "\n")))
    return rows.select(
        "conv_id", "turn", "role", F.size("ql_lines").cast("long").alias("n_lines"), F.size(F.filter("ql_lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("ql_lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), body.alias("body"),
    )


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn): each message's thread root, by doubling the steps that are taken up at once."""
    at = staged(parents)
    while True:
        up = at.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("up").alias("up2"))
        joined = at.join(up.hint("merge"), (F.col("conv_id") == F.col("c2")) & (F.col("up") == F.col("t2")), "left")
        at = staged(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
        if not at.filter("moved").limit(1).count():
            return at.select("conv_id", "turn", F.col("up").alias("root_turn"))
        at = at.drop("moved")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linked() in reply order, dealt out by range and sorted there: a long conversation spans tasks."""
    found = linked(messages, conv, turn, role, text)
    return found.repartitionByRange("conv_id", "root_turn", "turn").sortWithinPartitions("conv_id", "root_turn", "turn")


#: The digest by SQL, from conversations.
ORACLE = r"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
ln AS (
  SELECT rid, conv_id, turn, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS l FROM src WHERE text IS NOT NULL)
),
lv AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '^\s*(?:>\s?)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(raw, '^\s*(?:>\s?)+', '')), '\s+', ' ', 'g'), ' ') AS plain FROM ln
),
grp AS (SELECT *, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS g FROM lv),
runs AS (SELECT rid, any_value(conv_id) AS conv_id, any_value(turn) AS turn, level, g, string_agg(plain, chr(10) ORDER BY i) FILTER (plain <> '') AS p FROM grp GROUP BY rid, level, g),
said AS (
  SELECT conv_id, u, min(turn) AS said_turn FROM (
    SELECT conv_id, turn, p AS u FROM runs WHERE level = 0 AND p IS NOT NULL UNION ALL SELECT conv_id, turn, unnest(string_split(p, chr(10))) FROM runs WHERE level = 0 AND p IS NOT NULL
  ) WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, u
),
asked AS (
  SELECT DISTINCT conv_id, turn, level, 0 AS part, p AS u FROM runs WHERE level > 0 AND p IS NOT NULL
  UNION SELECT DISTINCT conv_id, turn, level, 1, unnest(string_split(p, chr(10))) FROM runs WHERE level > 0 AND p IS NOT NULL
),
found AS (SELECT a.*, said_turn FROM asked a JOIN said s ON a.conv_id = s.conv_id AND a.u = s.u AND said_turn < turn),
parent AS (SELECT conv_id, turn, arg_min(said_turn, (level, part, -length(u), said_turn)) AS parent_turn FROM found GROUP BY conv_id, turn),
up(conv_id, turn, above) AS (SELECT conv_id, turn, parent_turn FROM parent UNION ALL SELECT u.conv_id, u.turn, p.parent_turn FROM up u JOIN parent p ON p.conv_id = u.conv_id AND p.turn = u.above),
roots AS (SELECT conv_id, turn, min(above) AS root_turn FROM up GROUP BY conv_id, turn),
counts AS (SELECT rid, count(*)::BIGINT AS n_lines, count(*) FILTER (level > 0)::BIGINT AS n_quoted, max(level)::BIGINT AS max_level FROM lv GROUP BY rid)
SELECT s.conv_id, s.turn, s.role, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(max_level, 0)::BIGINT AS max_level, p.parent_turn, coalesce(r.root_turn, s.turn) AS root_turn
FROM src s LEFT JOIN counts c USING (rid) LEFT JOIN parent p ON p.conv_id = s.conv_id AND p.turn = s.turn LEFT JOIN roots r ON r.conv_id = s.conv_id AND r.turn = s.turn
"""

_CTES, _SELECT = ORACLE.rsplit("SELECT s.conv_id", 1)
#: ORACLE with the digest of the body.
BODY_ORACLE = (
    _CTES.rstrip()
    + r""",
cut AS (SELECT DISTINCT conv_id, turn, level, plain FROM (SELECT conv_id, turn, level, unnest(string_split(u, chr(10))) AS plain FROM found)),
bodies AS (
  SELECT l.rid, trim(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (l.level = 0 OR c.plain IS NULL AND l.plain <> ''), ''), ' ') AS body
  FROM lv l JOIN parent k ON k.conv_id = l.conv_id AND k.turn = l.turn LEFT JOIN cut c ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.level = l.level AND c.plain = l.plain GROUP BY l.rid
)
SELECT s.conv_id"""
    + _SELECT.replace("AS root_turn\n", "AS root_turn, sha256(coalesce(b.body, s.text, '')) AS body_sha256\n").rstrip()
    + " LEFT JOIN bodies b ON b.rid = s.rid\n"
)
