"""Conversations in reply order and without quotes, from the quotes themselves.

A line that starts with quote marks has as many levels as it has marks before its
text. Runs of lines of one level, up to a blank line, are passages. Letters and
digits of a passage in lower case, and of each of its lines of MIN_CHARS at least, are
hashed; a quoted hash leads to the first message of the conversation that has it in its
own words. A whole passage under MIN_CHARS counts where nothing longer of it links.
A message answers the latest of the messages that its outermost linked quotes
lead to. Root and depth of each message follow from the answers by pointer
doubling. What remains of a message after its quotes, and the lines that announce
them ("On ... wrote:"), is its text.

Only DataFrame functions are used. Originals are found by a minimum for each hash,
taken before the shuffle, and an equi-join with it, so a passage that many
messages repeat makes no pairs; what more than a share HOT of all rows joins with goes by
broadcast, so a common passage or root meets in no single task. Sorted by conv_id, root_turn, depth and turn, every
message comes after the one that it answers.

Defined results: a null or empty text stays without quotes and is empty; lines under
MIN_CHARS normalised characters link only as whole passages; a message without linked
quotes is a root of its own; rows with a null conv_id or turn link to nothing
(root_turn is their turn); rows that share conv_id and turn are one message with
all their quotes, and each is returned; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.batches import documents
from assetlode.llm.components import hot_join
from assetlode.workspace import Workspace

MIN_CHARS = 16
ANNOUNCES = r"(?i)^\s*(on\b.{1,200}\bwrote|am\b.{1,200}\bschrieb.{0,60}|le\b.{1,200}\ba écrit|el\b.{1,200}\bescribió|.{1,80}\b(wrote|writes|schrieb|a écrit|escribió))\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def _lines(text: Column) -> Column:
    """(level, content) of each line."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, r"^[> \t]*", 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.when(level > 0, F.substring(line, F.length(marks) + 1, F.length(line))).otherwise(line).alias("content"))

    return F.transform(F.split(whole, "\n", -1), parse)


def parsed(table: DataFrame) -> DataFrame:
    """Each message with its passages (level, norm, lines) and its own text."""
    rows = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), _lines(F.col("text").cast("string")).alias("lines"))
    n = F.size("lines")
    line = lambda i: F.element_at("lines", i + 1)
    blank = lambda i: F.trim(line(i)["content"]) == ""
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | F.when(i > 0, (line(i)["level"] != line(F.greatest(i, F.lit(1)) - 1)["level"]) | blank(F.greatest(i, F.lit(1)) - 1)).otherwise(F.lit(False)))
    rows = rows.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), n)
    contents = lambda s, k: F.transform(F.slice("lines", s + 1, end(k) - s), lambda x: x["content"])
    passages = F.transform("starts", lambda s, k: F.struct(line(s)["level"].alias("level"), normalised(F.array_join(contents(s, k), " ")).alias("norm"), F.transform(contents(s, k), normalised).alias("lines")))
    rows = rows.withColumn("passages", F.filter(passages, lambda p: p["norm"] != ""))
    announces = lambda i: line(i)["content"].rlike(ANNOUNCES) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)
    own = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (line(i)["level"] == 0) & ~announces(i))
    text = F.array_join(F.transform(own, lambda i: line(i)["content"]), "\n")
    # a text without quotes stays as it is but for white space at its ends
    quoted = F.exists("lines", lambda x: x["level"] > 0)
    text = F.when(quoted, F.regexp_replace(text, r"\n(?:[ \t]*\n){2,}", "\n\n")).otherwise(text)
    return rows.select("conv_id", "turn", "role", "passages", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def _units(passage: Column) -> Column:
    """Hashes of a passage and of its lines, and whether they are long; short lines are left out."""
    norms = F.array_distinct(F.concat(F.array(passage["norm"]), F.filter(passage["lines"], lambda x: F.length(x) >= MIN_CHARS)))
    return F.transform(norms, lambda x: F.struct(F.xxhash64(x).alias("unit"), (F.length(x) >= MIN_CHARS).alias("long")))


def answers(ws: Workspace, messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, n_linked of the messages that quote an earlier one."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = known.select("conv_id", "turn", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("passages", lambda p: p["level"] == 0), _units)))["unit"]).alias("unit"))
    first = own.groupBy("conv_id", "unit").agg(F.min("turn").alias("original"))
    quotes = known.select("conv_id", "turn", F.posexplode(F.filter("passages", lambda p: p["level"] > 0)).alias("at", "passage")).select("conv_id", "turn", "at", F.col("passage.level").alias("level"), F.explode(_units(F.col("passage"))).alias("u"))
    quotes = ws.save(quotes.select("turn", "at", "level", "u.long", F.struct("conv_id", "u.unit").alias("key")), "quoted")
    asked = quotes.groupBy("key").agg(F.count("*").alias("n"))
    found = first.select(F.struct("conv_id", "unit").alias("key"), "original").join(asked, "key")
    linked = hot_join(quotes, found, "key", quotes.count()).where("original < turn")
    linked = linked.groupBy("key.conv_id", "turn", "at", "level").agg(F.coalesce(F.max(F.when(F.col("long"), F.col("original"))), F.max("original")).alias("original"))
    # the outermost level first, then the latest original
    return linked.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct(-F.col("level"), F.col("original"))).alias("parent_turn"), F.count("*").alias("n_linked"))


def placed(ws: Workspace, links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn and depth of each message that answers another one."""
    now = ws.save(links.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "jump0")
    total, step = now.agg(F.sum("depth")).first()[0], 0
    while total:
        step += 1
        keyed = now.withColumn("key", F.struct("conv_id", "root_turn"))
        on = now.select(F.struct("conv_id", F.col("turn").alias("root_turn")).alias("key"), F.col("root_turn").alias("further"), F.col("depth").alias("more"))
        steps = keyed.groupBy("key").agg(F.count("*").alias("n")).join(on, "key", "left")
        moved = hot_join(keyed, steps, "key", now.count())
        now = ws.save(moved.select("conv_id", "turn", F.coalesce("further", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"jump{step}")
        ws.drop(f"jump{step - 1}")
        before, total = total, now.agg(F.sum("depth")).first()[0]
        if total == before:
            break
    return now


def threaded(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, n_linked, parent_turn, root_turn, depth of each message."""
    ws = Workspace(table.sparkSession, "quotes")
    messages = ws.save(parsed(table), "messages")
    links = ws.save(answers(ws, messages), "links")
    place = placed(ws, links)
    n_quotes = F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long")
    return (
        messages.join(links, ["conv_id", "turn"], "left").join(place, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", "text", n_quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    )


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threaded(documents(spark, sf_dir, "conversations")).orderBy("conv_id", "root_turn", "depth", "turn")


#: The same by recursion over messages instead of pointer doubling.
ORACLE = rf"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role,
         string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls
  FROM conversations
), line AS (
  SELECT rid, conv_id, turn, role, i, ls[i] AS line, regexp_extract(ls[i], '^[> \t]*') AS marks
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)
), leveled AS (
  SELECT *, length(marks) - length(replace(marks, '>', '')) AS level FROM line
), content AS (
  SELECT *, CASE WHEN level > 0 THEN substr(line, length(marks) + 1) ELSE line END AS content FROM leveled
), flagged AS (
  SELECT *, lag(level) OVER w AS before, lag(trim(content, ' ')) OVER w AS text_before, lead(level) OVER w AS after
  FROM content WINDOW w AS (PARTITION BY rid ORDER BY i)
), marked AS (
  SELECT *, sum(CASE WHEN i = 1 OR level <> before OR text_before = '' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS passage,
         trim(lower(regexp_replace(content, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS norm
  FROM flagged
), passages AS (
  SELECT rid, conv_id, turn, passage, min(level) AS level,
         trim(lower(regexp_replace(string_agg(content, ' ' ORDER BY i), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS norm
  FROM marked GROUP BY ALL HAVING norm <> ''
), units AS (
  SELECT rid, conv_id, turn, passage, level, norm FROM passages
  UNION
  SELECT m.rid, m.conv_id, m.turn, m.passage, p.level, m.norm FROM marked m JOIN passages p USING (rid, passage) WHERE length(m.norm) >= {MIN_CHARS}
), usable AS (
  SELECT * FROM units WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), firsts AS (
  SELECT conv_id, norm, min(turn) AS original FROM usable WHERE level = 0 GROUP BY ALL
), linked AS (
  SELECT u.conv_id, u.turn, u.rid, u.passage, u.level,
         coalesce(max(original) FILTER (length(u.norm) >= {MIN_CHARS}), max(original)) AS original
  FROM usable u JOIN firsts f ON u.conv_id = f.conv_id AND u.norm = f.norm
  WHERE u.level > 0 AND original < u.turn GROUP BY ALL
), links AS (
  SELECT conv_id, turn, arg_max(original, (-level, original)) AS parent_turn, count(*) AS n_linked FROM linked GROUP BY ALL
), place AS (
  SELECT l.conv_id, l.turn, l.parent_turn AS root_turn, 1 AS depth FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM links p WHERE p.conv_id = l.conv_id AND p.turn = l.parent_turn)
  UNION ALL
  SELECT l.conv_id, l.turn, p.root_turn, p.depth + 1 FROM links l JOIN place p ON p.conv_id = l.conv_id AND p.turn = l.parent_turn
), own AS (
  SELECT rid, string_agg(content, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(after, 0) > 0 AND regexp_matches(content, '{ANNOUNCES}'))) AS text, max(level) AS most
  FROM marked GROUP BY rid
), quotes AS (
  SELECT rid, count(*) AS n FROM passages WHERE level > 0 GROUP BY rid
)
SELECT r.conv_id, r.turn, r.role,
       regexp_replace(coalesce(CASE WHEN most > 0 THEN regexp_replace(o.text, '\n(?:[ \t]*\n){{2,}}', chr(10) || chr(10), 'g') ELSE o.text END, ''), '^\s+|\s+$', '', 'g') AS text,
       coalesce(q.n, 0) AS n_quotes, coalesce(l.n_linked, 0) AS n_linked, l.parent_turn,
       coalesce(p.root_turn, r.turn) AS root_turn, CAST(coalesce(p.depth, 0) AS BIGINT) AS depth
FROM raw r LEFT JOIN own o USING (rid) LEFT JOIN quotes q USING (rid)
LEFT JOIN links l ON l.conv_id = r.conv_id AND l.turn = r.turn
LEFT JOIN place p ON p.conv_id = r.conv_id AND p.turn = r.turn
"""
