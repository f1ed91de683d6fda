"""Line dedup over overlapping windows of three lines.

Lines are what "\\n" separates. Blank lines (white space only) belong to no window and always stay; lines are compared without
white space at their ends. Every three consecutive other lines of a text are a window, known by 128 bits of hashes; all lines of a text that has one or two of
them are a window too. Of the equal windows of the whole corpus the one with the smallest (id, text, position) stays; what the later ones cover, merged where
they overlap, goes. So in a run of equal lines the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, join_hot, table

SPAN = 3
#: ASCII white space without the line feed.
ENDS = "\t\x0b\x0c\r "


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(df: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(id, txt, h1, h2, at): the id and the text's hash, hashes and line numbers of every window."""
    numbered = F.transform(_lines(F.col(text_col)), lambda line, i: F.struct(F.btrim(line, F.lit(ENDS)).alias("line"), i.alias("i")))
    full = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("txt"), F.filter(numbered, lambda x: x["line"] != "").alias("lines"))
    ahead = [F.slice("lines", k + 1, F.greatest(F.lit(1), F.size("lines") - (span - 1))) for k in range(span)]  # of a short text, null where it has no line
    rows = full.where(F.size("lines") > 0).select("id", "txt", F.least(F.size("lines"), F.lit(span)).alias("n"), F.explode(F.arrays_zip(*[a.alias(f"l{k}") for k, a in enumerate(ahead)])).alias("w"))
    lines = [F.col(f"w.l{k}.line") for k in range(span)]
    at = F.filter(F.array(*[F.col(f"w.l{k}.i") for k in range(span)]), lambda i: i.isNotNull())
    return rows.select("id", "txt", F.xxhash64("n", *lines).alias("h1"), F.xxhash64(F.lit("again"), "n", *lines).alias("h2"), at.alias("at"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, txt, covered): the line numbers that later occurrences cover, for the texts that have any."""
    found = cut(windows(df, id_col, text_col, span))
    firsts = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "txt", F.col("at")[0].alias("at"))).alias("first")).where("n > 1"))
    here = F.struct("id", "txt", F.col("at")[0].alias("at"))
    later = join_hot(found, firsts, ["h1", "h2"], "n").where(here != F.col("first"))
    return later.groupBy("id", "txt").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("covered"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """The rows and columns of df, text_col without the covered lines, and then n_lines (before) and n_removed.

    Rows that share an id and a text are one document, each of them keeps what it keeps; rows that share an id with different texts are documents of their own,
    ordered by the texts' hashes. Rows with a null id or text are left as they are; a null text has zero lines, an empty one has one. Every row of df stays; columns of
    df that are called n_lines or n_removed don't.
    """
    covered = repeats(df, id_col, text_col, span).select(F.col("id").alias("_of"), F.col("txt").alias("_txt"), F.col("covered").alias("_covered"))
    lines = _lines(F.col(text_col))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered"))
    text = F.when(F.col("_covered").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    joined = df.join(covered, (F.col(id_col) == F.col("_of")) & (F.xxhash64(text_col) == F.col("_txt")), "left")
    counted = joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in df.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
    return counted


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


#: The texts without covered lines, in DuckDB's SQL; {docs} has doc_id and text.
DEDUPED = """
lines AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs})),
filled AS (SELECT doc_id, i, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS line FROM lines WHERE trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') <> ''),
wins AS (SELECT * FROM (SELECT doc_id, i AS a, lead(i) OVER w AS b, lead(i, 2) OVER w AS c, line AS l0, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2, lag(i) OVER w AS z FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL OR z IS NULL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, a) AS rn FROM wins) WHERE rn > 1),
covered AS (SELECT DISTINCT doc_id, unnest([a, b, c]) AS i FROM later),  -- null for the lines that a short text lacks
deduped AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
"""

QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLES = {
    "op5_line_dedup": "WITH " + DEDUPED.format(docs="documents") + "SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM deduped",
}
