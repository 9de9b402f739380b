"""Removal of repeated passages of lines, by overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

WINDOW = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tid, pos, h1, h2): each window of `size` lines, with 128 bits of hash, but for blank ones."""

    def windows(lines: Column) -> Column:
        def one(i: Column) -> Column:
            own = [F.get(lines, i + k) for k in range(size)]
            told = F.length(F.concat(*own)) > 0
            return F.when(told, F.struct(i.alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(size), *reversed(own)).alias("h2")))

        return F.when(F.size(lines) >= size, F.transform(F.sequence(F.lit(0), F.size(lines) - size), one))

    rows = docs.select("doc_id", "tid", F.explode_outer(common.let(F.split("text", "\n", -1), windows)).alias("w"))
    return rows.where("w IS NOT NULL").select("doc_id", "tid", "w.pos", "w.h1", "w.h2")


def _kept(lines: Column, starts: Column, size: int) -> Column:
    """The lines that no window at one of starts covers."""
    covered = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + size - 1)))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    return F.transform(places, lambda i: F.get(lines, i))


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) with text without repeated passages, and n_lines and n_removed.

    A window of `size` consecutive lines that occurs again, in the same text or another, is removed wherever it is
    not its first occurrence; lines under several windows go once. Occurrences are ordered by doc_id, null first, then
    by a hash of the text, then by line. Windows of empty lines are left alone, as are texts of fewer lines and null texts
    (n_lines 0). Rows with equal doc_id and text are one occurrence and have one result. An empty table gives no
    rows. Other columns stay as they are; columns named n_lines or n_removed are replaced.
    """
    before = docs.drop("n_lines", "n_removed")
    keyed = before.withColumn("_tid", F.xxhash64("text"))
    windows = _windows(keyed.select("doc_id", F.col("_tid").alias("tid"), "text"), size)
    place = F.struct("doc_id", "tid", "pos")
    often = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    later = common.salted_join(windows, often, ["h1", "h2"], ["doc_id", "pos"], "n").where(place != F.col("first"))
    starts = later.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("_starts")).withColumnRenamed("tid", "_tid").withColumnRenamed("doc_id", "_doc")
    joined = keyed.join(starts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (keyed["_tid"] == starts["_tid"]), "left").drop(starts["_tid"]).drop("_doc")

    def result(lines: Column) -> Column:
        def of(left: Column) -> Column:
            return F.struct(F.array_join(left, "\n").alias("text"), F.size(lines).alias("n_lines"), (F.size(lines) - F.size(left)).alias("n_removed"))

        whole = F.struct(F.col("text"), F.size(lines).alias("n_lines"), F.lit(0).alias("n_removed"))
        return F.when(F.col("_starts").isNull(), whole).otherwise(common.let(_kept(lines, F.col("_starts"), size), of))

    out = joined.withColumn("_out", common.let(F.split("text", "\n", -1), result))
    told = F.col("text").isNotNull()
    columns = [F.col("_out.text").alias("text") if c == "text" else F.col(c) for c in before.columns]
    return out.select(*columns, *[F.when(told, F.col(f"_out.{c}")).otherwise(0).alias(c) for c in ("n_lines", "n_removed")])


#: The same over documents, for DuckDB.
ORACLE_SQL = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM lines WHERE len(ls) >= 3)
  WHERE ls[pos + 1] || ls[pos + 2] || ls[pos + 3] <> ''
),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM w),
covered AS (SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, range(3) t(d) WHERE rn > 1),
every_line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM lines),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text, count(*) AS n
  FROM every_line e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos GROUP BY e.doc_id
)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(l.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(l.ls), 0) - coalesce(k.n, 0) AS INTEGER) AS n_removed
FROM lines l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""
