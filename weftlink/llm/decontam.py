"""Search for benchmark items inside documents. DataFrame functions only.

Items are partitioned by the number of their shingles. From each item, hash functions draw the shingles with the
least hash, as many as its partition needs; an item whose share c of shingles a document holds has each of its drawn
ones in it with probability c. Documents with enough drawn shingles of an item are candidates, however long they
are, and the exact share decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

SHINGLE = 5
CONTAINMENT = 0.8
#: Draws for an item: twice its partition's lower bound, up to this many. A pair at the least containment is missed if none is found: below 1e-20 with 32.
MOST_DRAWS = 32
#: Tables of up to so many numbers of 8 bytes, those in arrays included, are broadcast; larger ones are joined by a shuffle.
BROADCAST_NUMBERS = 2_000_000


def words(text: Column) -> Column:
    """Small letters and digits of any script, split at everything else."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep and shingles: hashes of the runs of SHINGLE words, of all words where there are fewer; none without words."""
    some = rows.where(F.col("text").rlike(r"[\p{L}\p{N}]"))

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))

    hashed = F.transform(words(F.col("text")), lambda x: F.xxhash64(x))
    return some.select(*keep, common.let(hashed, runs).alias("shingles"))


def _numbers(rows: DataFrame, column: str | None = None) -> int:
    """How many numbers are in rows, its array column included."""
    return rows.agg(F.sum(F.lit(3) + (F.size(column) if column else F.lit(0)))).first()[0] or 0


def _often(lists: DataFrame) -> DataFrame:
    """(item_id, often): in how many candidates an item is."""
    return lists.select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("often"))


def item_index(items: DataFrame) -> DataFrame:
    """(item_id, part, draws, shingles) of items (item_id, text); part: the power of two up to the number of its distinct shingles."""
    sets = _hashed(items.where("text IS NOT NULL"), ["item_id"]).select("item_id", F.array_distinct("shingles").alias("shingles"))
    # rows with one item_id make one item
    sets = sets.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))
    part = F.floor(F.log2(F.size("shingles"))).cast("int")
    return sets.select("item_id", part.alias("part"), F.least(F.lit(MOST_DRAWS), 2 * F.pow(F.lit(2), part)).cast("int").alias("draws"), "shingles")


def signatures(index: DataFrame) -> DataFrame:
    """(item_id, shingle): the shingles with the least hash under each of an item's hash functions, once each."""
    drawn = F.transform(F.sequence(F.lit(0), F.col("draws") - 1), lambda i: F.array_min(F.transform("shingles", lambda s: F.struct(F.xxhash64(i, s).alias("h"), s.alias("s"))))["s"])
    return index.select("item_id", F.explode(F.array_distinct(drawn)).alias("shingle"))


def text_id(text: str = "text") -> Column:
    return F.xxhash64(text)


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Whether two rows are of one document; a null doc_id is an id like any other."""
    return left["doc_id"].eqNullSafe(right["_doc"]) & (left["tid"] == right["_tid"])


def _found(docs: DataFrame, items: DataFrame, containment: float, broadcast_numbers: int) -> DataFrame:
    """(doc_id, tid, item_id, n_shingles, n_shared, containment) of the texts that hold enough of an item."""
    index = common.cut_lineage(item_index(items.select("item_id", "text")))
    drawn = common.cut_lineage(signatures(index))
    keyed = docs.select("doc_id", text_id().alias("tid"), "text").where("text IS NOT NULL")
    seen = _hashed(keyed, ["doc_id", "tid"]).select("doc_id", "tid", F.explode_outer("shingles").alias("shingle"))  # outer: else the optimizer hashes once more for a filter
    hits = seen.join(F.broadcast(drawn) if _numbers(drawn) <= broadcast_numbers else drawn, "shingle").select("doc_id", "tid", "item_id").distinct()
    lists = common.cut_lineage(hits.groupBy(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")).agg(F.collect_list("item_id").alias("items")))
    candidates = keyed.join(F.broadcast(lists) if _numbers(lists, "items") <= broadcast_numbers else lists, _same(keyed, lists)).select("doc_id", "tid", "text", "items")
    found = _hashed(candidates, ["doc_id", "tid", "items"]).select("doc_id", "tid", F.explode("items").alias("item_id"), F.col("shingles").alias("own"))
    small = _numbers(index, "shingles") <= broadcast_numbers
    found = found.join(F.broadcast(index), "item_id") if small else common.salted_join(found, index.join(_often(lists), "item_id"), ["item_id"], ["doc_id", "tid"], "often")
    exact = found.select("doc_id", "tid", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"))
    return exact.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= containment)


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of the pairs where a text of docs holds enough of an item.

    containment: the share of the item's distinct shingles that the text has; case and punctuation do not count. An
    item of fewer than five words is one shingle, which only a text of just these words has. Null and wordless texts
    hold nothing, null and wordless items are in nothing. Of rows with equal ids, null ones included, each pair is
    given once, with its largest share. Items with an equal item_id are one item with the shingles of all; items
    without an id are left out. Other columns are not read. Empty tables give no rows.
    """
    exact = _found(docs, items.where("item_id IS NOT NULL"), containment, broadcast_numbers)
    exact = exact.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return exact.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """The rows of docs (doc_id, text, ...), with all their columns, whose text holds no item. Rows with one doc_id are judged each by its own text."""
    found = _found(docs, items.where("item_id IS NOT NULL"), containment, broadcast_numbers).select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_found")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_doc"]) & (F.xxhash64(docs["text"]) == found["_found"]), "left_anti")


#: The same over documents and benchmark, for DuckDB, without the search by hashes.
ORACLE_SQL = r"""
WITH norm AS (
  SELECT 'd' AS kind, doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') FROM benchmark WHERE text IS NOT NULL
),
sh AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM norm WHERE w[1] <> '')
),
n AS (SELECT id, count(*) AS n_shingles FROM sh WHERE kind = 'b' GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM sh d JOIN sh b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n ON m.item_id = n.id WHERE n_shared / n_shingles >= 0.8
"""
