"""Queries that apply single rules to tables made of the documents, with SQL for each.

The driver's tables have no link suggestions, so cases() and suggestions() make some of every document: each rule meets
all of its branches, over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import text as words
from weftlink.functions import urls
from weftlink.functions.lexicon import BOILERPLATE_HEADINGS, BOILERPLATE_TEXTS, BYLINE, GENERIC_ANCHORS, MONEY_TYPES, STOPWORDS
from weftlink.operators import allocate, anchors, corpus, graph, report, requests, scoring, semantic
from weftlink.plans import site, target
from weftlink.settings import CORE, Settings
from weftlink.sources import extract, sitemap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


def _pick(key: Column, *values: Column) -> Column:
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key == i, v).otherwise(out)
    return out


_KINDS = ("blog", "product", "service", "general")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, targets and figures of every document: an anchor of its first line or a vague one, titles that have it or not."""
    docs = _docs(spark, sf_dir).withColumn("line", F.substring_index("text", "\n", 1))
    w = F.split("line", " ")
    cut = lambda a, b: F.array_join(F.slice(w, a, b - a + 1), " ")
    i = F.col("doc_id")
    anchor = _pick(i % 8, cut(1, 2), cut(2, 4), F.lit("Click here"), cut(1, 1), cut(1, 6), F.lit("abc"), cut(3, 5), cut(5, 6))
    return docs.select(
        "doc_id", "source", "line", anchor.alias("anchor"), _pick(i % 5, F.lit(""), cut(1, 4), cut(1, 8), cut(6, 9), cut(2, 3)).alias("h1"),
        F.concat(cut(2, 9), F.when(i % 3 == 0, " | Site").otherwise("")).alias("title"), F.array(cut(3, 7)).alias("h2"), cut(4, 12).alias("meta"), F.lower(cut(1, 3)).alias("slug"),
        F.array(cut(2, 2), cut(9, 10)).alias("topics"), (i % 13).cast("int").alias("shared"), ((i % 31) / F.lit(100.0)).alias("similarity"), words.word_count(F.col("text")).alias("words"),
        (i % 3 == 0).alias("is_orphan"), (i % 4).cast("int").alias("inbound"), _pick(i % 4, *map(F.lit, _KINDS)).alias("page_type"), ((i % 101) / F.lit(100.0)).alias("position"),
        ((i % 7) / F.lit(10.0) + F.lit(0.35)).alias("trust"), (i % 10 + 1).cast("int").alias("points"), (i % 9).cast("int").alias("para_idx"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array(F.lower(cut(3, 3)), F.lower(cut(5, 5))), lambda x: x != "")).alias("shared_list"), F.transform(F.slice(w, 1, 6), lambda x: F.lower(x)).alias("target_list"),
    )


_CUT = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
_CASES = f"""
src AS (SELECT *, string_split(line, ' ') AS w FROM (SELECT *, split_part(text, chr(10), 1) AS line FROM documents)),
cases AS (
  SELECT doc_id, source, line, w,
    CASE doc_id % 8 WHEN 0 THEN {_CUT(1, 2)} WHEN 1 THEN {_CUT(2, 4)} WHEN 2 THEN 'Click here' WHEN 3 THEN {_CUT(1, 1)} WHEN 4 THEN {_CUT(1, 6)} WHEN 5 THEN 'abc' WHEN 6 THEN {_CUT(3, 5)} ELSE {_CUT(5, 6)} END AS anchor,
    CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN {_CUT(1, 4)} WHEN 2 THEN {_CUT(1, 8)} WHEN 3 THEN {_CUT(6, 9)} ELSE {_CUT(2, 3)} END AS h1,
    {_CUT(2, 9)} || CASE WHEN doc_id % 3 = 0 THEN ' | Site' ELSE '' END AS title, {_CUT(3, 7)} AS h2, {_CUT(4, 12)} AS meta, lower({_CUT(1, 3)}) AS slug, [{_CUT(2, 2)}, {_CUT(9, 10)}] AS topics,
    CAST(doc_id % 13 AS INTEGER) AS shared, (doc_id % 31) / 100.0::DOUBLE AS similarity, CAST(len(string_split_regex(text, '\\s+')) AS INTEGER) AS words, doc_id % 3 = 0 AS is_orphan,
    CAST(doc_id % 4 AS INTEGER) AS inbound, [{_list(_KINDS)}][doc_id % 4 + 1] AS page_type, (doc_id % 101) / 100.0::DOUBLE AS position, (doc_id % 7) / 10.0::DOUBLE + 0.35::DOUBLE AS trust,
    CAST(doc_id % 10 + 1 AS INTEGER) AS points, CAST(doc_id % 9 AS INTEGER) AS para_idx,
    CASE WHEN doc_id % 4 = 0 THEN [] ELSE list_filter([lower({_CUT(3, 3)}), lower({_CUT(5, 5)})], lambda x: x <> '') END AS shared_list, list_transform(w[1:6], lambda x: lower(x)) AS target_list
  FROM src
)"""
_LOW = "trim(lower(anchor))"
_GENERIC = f"{_LOW} IN ({_list(GENERIC_ANCHORS)})"
_MONEY = f"page_type IN ({_list(MONEY_TYPES)})"
_SHORT = "len(string_split(anchor, ' ')) = 1 AND length(anchor) < 8"
_HAS_H1 = f"h1 <> '' AND (contains(lower(h1), {_LOW}) OR contains({_LOW}, array_to_string(string_split(lower(h1), ' ')[1:4], ' ')))"
_HAS_H2 = f"contains(lower(h2), {_LOW}) OR contains({_LOW}, array_to_string(string_split(lower(h2), ' ')[1:3], ' '))"
_STEPS = (
    (_HAS_H1, 3.0, "Anchor closely matches target H1"), (f"contains(lower(title), {_LOW})", 2.5, "Anchor found in target page title"), (_HAS_H2, 2.0, "Anchor matches a target H2 heading"),
    (f"contains(lower(meta), {_LOW})", 1.5, "Anchor found in target meta description"), (f"contains(slug, regexp_replace({_LOW}, '\\s+', '-', 'g'))", 1.0, "Anchor phrase matches target URL slug"),
)
_RELEVANCE = "CASE " + " ".join(f"WHEN {t} THEN {v}::DOUBLE" for t, v, _ in _STEPS) + " WHEN shared > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
_RELEVANT = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, _, r in _STEPS) + " END"
_OVERLAP = "CASE WHEN shared >= 10 THEN 2.0 WHEN shared >= 6 THEN 1.5 WHEN shared >= 3 THEN 1.0 WHEN shared >= 1 THEN 0.5 ELSE 0.0 END::DOUBLE"
_SIMILAR = "CASE WHEN similarity >= 0.25::DOUBLE THEN 1.0 WHEN similarity >= 0.12::DOUBLE THEN 0.5 ELSE 0.0 END::DOUBLE"
_LENGTH = "CASE WHEN words >= 80 THEN 2.0 WHEN words >= 40 THEN 1.5 WHEN words >= 20 THEN 1.0 ELSE 0.0 END::DOUBLE"
_STRATEGIC = f"(CASE WHEN is_orphan THEN 2.0 WHEN inbound < 2 THEN 1.0 ELSE 0.0 END + CASE WHEN {_MONEY} THEN 1.0 ELSE 0.0 END)::DOUBLE"
_PLACE = "CASE WHEN position <= 0.25::DOUBLE THEN 1.0 WHEN position <= 0.5::DOUBLE THEN 0.5 ELSE 0.0 END::DOUBLE"
_PENALTY = f"(CASE WHEN {_GENERIC} THEN 3.0 ELSE 0.0 END + CASE WHEN length(anchor) < 4 THEN 2.0 ELSE 0.0 END + CASE WHEN {_SHORT} THEN 0.5 ELSE 0.0 END)::DOUBLE"
_RAW = f"({_RELEVANCE} + {_OVERLAP} + {_SIMILAR} + {_LENGTH} + {_STRATEGIC} + {_PLACE} - {_PENALTY})"
_LABEL = "CASE WHEN position <= 0.25::DOUBLE THEN 'Early' WHEN position <= 0.6::DOUBLE THEN 'Middle' ELSE 'Late' END"


def _relevance() -> tuple[Column, Column]:
    return scoring.anchor_relevance(*[F.col(c) for c in ("anchor", "h1", "title", "h2", "meta", "slug", "shared")])


def _told() -> list[Column]:
    return [F.col(c) for c in ("shared", "similarity", "words", "is_orphan", "inbound", "page_type", "position")]


def _raw() -> Column:
    return scoring.raw_points(F.col("anchor"), _relevance()[0], *_told())


@_query(f"WITH {_CASES} SELECT doc_id, anchor, {_RELEVANCE} AS points, {_RELEVANT} AS reason FROM cases")
def anchor_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, reason = _relevance()
    return cases(spark, sf_dir).select("doc_id", "anchor", points.alias("points"), reason.alias("reason"))


@_query(f"WITH {_CASES} SELECT doc_id, {_OVERLAP} AS overlap, {_SIMILAR} AS similar, {_STRATEGIC} AS strategic, {_PENALTY} AS penalty FROM cases")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    strategic = scoring.strategic_points(F.col("is_orphan"), F.col("inbound"), F.col("page_type"))
    return cases(spark, sf_dir).select("doc_id", scoring.overlap_points(F.col("shared")).alias("overlap"), scoring.similarity_points(F.col("similarity")).alias("similar"), strategic.alias("strategic"), scoring.penalty_points(F.col("anchor")).alias("penalty"))


_SCORE = f"CAST(greatest(1, least(10, floor({_RAW} + 0.5))) AS INTEGER)"
_NATURAL = "CASE WHEN len(string_split(anchor, ' ')) >= 3 THEN 0.95::DOUBLE WHEN len(string_split(anchor, ' ')) >= 2 THEN 0.85::DOUBLE ELSE 0.70::DOUBLE END"


@_query(f"WITH {_CASES} SELECT doc_id, {_RAW} AS raw, {_SCORE} AS score, CAST(floor((trust * 0.40::DOUBLE + {_NATURAL} * 0.30::DOUBLE + (points / 10::DOUBLE) * 0.30::DOUBLE) * 100 + 0.5) AS INTEGER) AS confidence FROM cases")
def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumn("raw", _raw())
    return rows.select("doc_id", "raw", scoring.score(F.col("raw")).alias("score"), scoring.confidence(F.col("trust"), F.col("anchor"), F.col("points")).alias("confidence"))


_REASONS = f"""list_filter([{_RELEVANT},
  CASE WHEN shared >= 10 THEN 'Very high inter-page keyword overlap (' || shared || ' shared terms)' WHEN shared >= 6 THEN 'High inter-page keyword overlap (' || shared || ' terms)' WHEN shared >= 3 THEN 'Good inter-page keyword overlap (' || shared || ' terms)' END,
  CASE WHEN similarity >= 0.25::DOUBLE THEN 'Strong paragraph-to-target semantic similarity (' || CAST(floor(similarity * 100 + 0.5) AS BIGINT) || '%)' WHEN similarity >= 0.12::DOUBLE THEN 'Moderate paragraph-to-target semantic overlap' END,
  CASE WHEN words >= 80 THEN 'Rich paragraph context (80+ words)' WHEN words >= 40 THEN 'Good paragraph length (40+ words)' WHEN words >= 20 THEN 'Acceptable paragraph length (20+ words)' END,
  CASE WHEN is_orphan THEN 'Target is an orphan page (zero inbound internal links)' WHEN inbound < 2 THEN 'Target has very few inbound internal links' END,
  CASE WHEN {_MONEY} THEN 'Target is a high-value conversion / money page' END,
  CASE WHEN position <= 0.25::DOUBLE THEN 'Anchor is in the opening section of the article (high SEO value)' WHEN position <= 0.5::DOUBLE THEN 'Anchor is in the first half of the article' END], lambda x: x IS NOT NULL)"""
_WARNINGS = f"list_filter([CASE WHEN {_GENERIC} THEN 'Generic anchor text (click here / read more / etc.)' END, CASE WHEN length(anchor) < 4 THEN 'Anchor text too short (< 4 characters)' END, CASE WHEN {_SHORT} THEN 'Single very short word used as anchor' END], lambda x: x IS NOT NULL)"


@_query(f"WITH {_CASES} SELECT doc_id, array_to_string({_REASONS}, '; ') AS reason, array_to_string({_WARNINGS}, '; ') AS warnings FROM cases")
def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = scoring.reasons(_relevance()[1], *_told())
    return cases(spark, sf_dir).select("doc_id", F.array_join(reasons, "; ").alias("reason"), F.array_join(scoring.warnings(F.col("anchor")), "; ").alias("warnings"))


_LOWER_GENERIC = f"lower(anchor) IN ({_list(GENERIC_ANCHORS)})"


@_query(
    f"""
WITH {_CASES}, scored AS (SELECT *, {_RAW} AS raw FROM cases)
SELECT doc_id, floor(greatest(0.0::DOUBLE, least(3.0::DOUBLE, raw - greatest(0.0::DOUBLE, raw - 3))) * 10 + 0.5) / 10 AS anchor_relevance, floor(least(3.0::DOUBLE, shared * 0.5::DOUBLE) * 10 + 0.5) / 10 AS keyword_overlap,
  {_LENGTH} AS paragraph_quality, {_STRATEGIC} AS strategic_value, {_PLACE} AS position_bonus, CASE WHEN {_LOWER_GENERIC} THEN -3.0 WHEN length(anchor) < 4 THEN -2.0 ELSE 0.0 END::DOUBLE AS penalties, points::DOUBLE AS total
FROM scored
"""
)
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {n: F.col(n) for n in ("anchor", "shared", "words", "is_orphan", "inbound", "page_type", "position", "points")}
    told = scoring.breakdown(_raw(), c["anchor"], c["shared"], c["words"], c["is_orphan"], c["inbound"], c["page_type"], c["position"], c["points"])
    return cases(spark, sf_dir).select("doc_id", told.alias("b")).select("doc_id", "b.*")


@_query(
    f"""
WITH {_CASES} SELECT doc_id, 'Paragraph #' || (para_idx + 1) || ' extracted via "' || page_type || '" (confidence ' || CAST(floor(trust * 100 + 0.5) AS BIGINT) || '%) — confirmed main-body content (' || {_LABEL} || ' section of article), not from author bio, sidebar, or template section.' AS body_reason,
  '✓ Valid main-body paragraph from "' || page_type || '". Anchor "' || anchor || '" exists naturally in visible body content. Source does not already link to target. sourceType: main-body.' AS proof FROM cases
"""
)
def proof_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = scoring.body_reason(F.col("para_idx"), F.col("page_type"), F.col("trust"), F.col("position"))
    return cases(spark, sf_dir).select("doc_id", body.alias("body_reason"), scoring.validation_proof(F.col("page_type"), F.col("anchor")).alias("proof"))


# Anchors in a paragraph, which is the document's first line
_BARE = r"trim(regexp_replace(lower(title), '[|\-–—].*$', ''))"


@_query(
    f"""
WITH {_CASES}, x AS (SELECT *, {_LOW} AS low, {_BARE} AS t, trim(lower(h1)) AS h, string_split_regex(trim(anchor), '\\s+') AS aw FROM cases)
SELECT doc_id, anchor, CASE WHEN anchor = '' THEN 'semantic' WHEN len(aw) >= 5 THEN 'long-tail' WHEN low = t OR low = h THEN 'exact' WHEN contains(t, low) OR contains(h, low) OR contains(low, t) OR contains(low, h) THEN 'partial'
  WHEN len(list_filter(aw[2:], lambda y: regexp_matches(y, '^[A-Z]'))) > 0 THEN 'entity' WHEN len(list_filter(topics, lambda k: contains(low, lower(k)) OR contains(lower(k), low))) > 0 THEN 'branded' ELSE 'semantic' END AS anchor_type FROM x
"""
)
def anchor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = anchors.anchor_type(F.col("anchor"), F.col("title"), F.col("h1"), F.col("topics"))
    return cases(spark, sf_dir).select("doc_id", "anchor", kind.alias("anchor_type"))


_SMALL = "abcdefghijklmnopqrstuvwxyz"
_AT = f"coalesce(list_filter(range(1, length(line) + 1), lambda i: lower(substr(line, i, length(a))) = lower(a) AND (i = 1 OR NOT regexp_matches(substr(line, i - 1, 1), '[a-zA-Z0-9]')) AND NOT regexp_matches(substr(line, i + length(a), 1), '[a-zA-Z0-9]'))[1], 0)"


@_query(
    f"""
WITH {_CASES}, p AS (SELECT doc_id, line, string_split(line, ' ') AS ws, translate(array_to_string(w[9:10], ' '), '{_SMALL}', '{_SMALL.upper()}') AS a FROM cases),
f AS (SELECT *, CASE WHEN a = '' THEN 0 ELSE {_AT} END AS pos, len(string_split(a, ' ')) AS k, len(ws) AS n FROM p),
g AS (SELECT *, CASE WHEN pos > 1 THEN 1 + length(regexp_replace(substr(line, 1, pos - 2), '[^ ]', '', 'g')) ELSE 0 END AS bw FROM f),
h AS (SELECT *, greatest(0, (CASE WHEN bw < n THEN bw ELSE 0 END) - 6) AS lo, least(n, (CASE WHEN bw < n THEN bw ELSE 0 END) + k + 6) AS hi FROM g)
SELECT doc_id, CASE WHEN pos = 0 THEN '' ELSE CASE WHEN lo > 0 THEN '…' ELSE '' END || array_to_string(ws[lo + 1 : hi], ' ') || CASE WHEN hi < n THEN '…' ELSE '' END END AS context FROM h
"""
)
def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around the ninth and tenth words of each first line, sought in capitals."""
    anchor = F.translate(F.array_join(F.slice(F.split("line", " "), 9, 2), " "), _SMALL, _SMALL.upper())
    return cases(spark, sf_dir).select("doc_id", anchors.word_context(F.col("line"), anchor).alias("context"))


_POST = "list_filter(string_split_regex(trim(substr(line, pos + length(a))), '\\s+'), lambda x: x <> '')"
_PRE = "list_filter(string_split_regex(trim(substr(line, 1, pos - 1)), '\\s+'), lambda x: x <> '')"


@_query(
    f"""
WITH {_CASES}, p AS (SELECT doc_id, line, CASE WHEN doc_id % 5 = 4 THEN 'nowhere' ELSE lower(array_to_string(w[8:9], ' ')) END AS a FROM cases),
f AS (SELECT *, instr(lower(line), lower(a)) AS pos FROM p), g AS (SELECT *, {_PRE} AS pre, {_POST} AS post FROM f)
SELECT doc_id, CASE WHEN line = '' OR a = '' THEN '' WHEN pos = 0 THEN a ELSE CASE WHEN len(pre) > 0 THEN '…' || array_to_string(pre[greatest(len(pre) - 6, 0) + 1 : len(pre)], ' ') || ' ' ELSE '' END || '[' || a || ']' || CASE WHEN len(post) > 0 THEN ' ' || array_to_string(post[1:6], ' ') || '…' ELSE '' END END AS context,
  CASE WHEN pos > 0 THEN substr(line, 1, pos - 1) || '[' || a || '](https://x.org/' || doc_id || ')' || substr(line, pos + length(a)) ELSE line || ' (See also: [' || a || '](https://x.org/' || doc_id || '))' END AS linked FROM g
"""
)
def links_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("doc_id") % 5 == 4, "nowhere").otherwise(F.lower(F.array_join(F.slice(F.split("line", " "), 8, 2), " ")))
    url = F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string"))
    rows = cases(spark, sf_dir).withColumn("a", anchor)
    return rows.select("doc_id", anchors.bracket_context(F.col("line"), F.col("a")).alias("context"), anchors.insert_link(F.col("line"), F.col("a"), url).alias("linked"))


_ASCII_FOUND = "regexp_extract(line, '(?i)(?:^|[^a-zA-Z0-9])(' || a || ')(?:$|[^a-zA-Z0-9])', 1)"


@_query(f"WITH {_CASES} SELECT doc_id, a AS phrase, nullif(CASE WHEN length(a) >= 2 THEN {_ASCII_FOUND} ELSE '' END, '') AS found FROM (SELECT doc_id, line, lower(regexp_replace(array_to_string(w[4:5], ' '), '[^\\p{{L}}\\p{{N}} ]', '', 'g')) AS a FROM cases)")
def ascii_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase with its marks taken off, found where only ASCII letters and digits bound it."""
    phrase = F.lower(F.regexp_replace(F.array_join(F.slice(F.split("line", " "), 4, 2), " "), r"[^\p{L}\p{N} ]", ""))
    return cases(spark, sf_dir).withColumn("phrase", phrase).select("doc_id", "phrase", anchors.bounded_phrase(F.col("line"), F.col("phrase"), ascii_only=True).alias("found"))


_HIT = "list_filter(range(1, len(t)), lambda i: list_contains(s, t[i]) OR list_contains(s, t[i + 1]))[1]"


@_query(
    f"""
WITH {_CASES}, x AS (SELECT doc_id, shared_list AS s, target_list AS t FROM cases), y AS (SELECT *, {_HIT} AS i FROM x)
SELECT doc_id, CASE WHEN len(s) > 0 THEN coalesce(t[i] || ' ' || t[i + 1], list_filter(s, lambda k: len(string_split_regex(k, '\\s+')) >= 2 OR length(k) >= 8)[1], s[1]) END AS anchor FROM y
"""
)
def derived_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("doc_id", semantic.derived_anchor(F.col("shared_list"), F.col("target_list")).alias("anchor"))


_SEMANTIC = """list_filter([CASE WHEN len(shared_list) > 0 THEN len(shared_list) || ' shared keywords: ' || array_to_string(shared_list[1:5], ', ') END, CASE WHEN similarity > 0 THEN 'semantic similarity: ' || CAST(doc_id % 31 AS VARCHAR) || '.0%' END,
  CASE WHEN doc_id % 8 <> 5 THEN 'natural anchor "' || anchor || '" found in body content' END, CASE WHEN para_idx > 0 THEN para_idx || ' target keyword(s) in source title' END], lambda x: x IS NOT NULL)"""


@_query(f"WITH {_CASES} SELECT doc_id, CASE WHEN len({_SEMANTIC}) > 0 THEN array_to_string({_SEMANTIC}, '; ') ELSE 'Low semantic overlap — marginal candidate' END AS reason FROM cases")
def semantic_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("doc_id") % 8 != 5, F.col("anchor"))
    return cases(spark, sf_dir).select("doc_id", semantic.semantic_reason(F.col("shared_list"), F.col("similarity"), anchor, F.col("para_idx")).alias("reason"))


@_query(f"WITH {_CASES} SELECT doc_id, CASE WHEN len(w) = 1 THEN [0.0::DOUBLE] ELSE list_transform(range(0, len(w)), lambda i: round(i / (len(w) - 1)::DOUBLE, 3)) END AS positions FROM cases WHERE len(w) <= 80")
def relative_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).withColumn("n", F.size(F.split("line", " "))).where("n <= 80").select("doc_id", corpus.positions(F.col("n")).alias("positions"))


# Addresses
_ODD_URLS = "SELECT page_id, url || ['', '/', '//', '?a=b', '/X/Y///', '#f'][page_id % 6 + 1] AS url FROM pages UNION ALL SELECT page_id, 'No address ' || page_id FROM pages WHERE page_id % 9 = 0"
_SITE = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_PATH = r"coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
_IS_URL = "starts_with(url, 'http')"
_BARE_PATH = f"CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END"


@_query(
    f"""
SELECT page_id, url, CASE WHEN {_IS_URL} THEN lower({_SITE} || {_BARE_PATH}) ELSE lower(url) END AS every_slash, CASE WHEN {_IS_URL} THEN {_PATH} ELSE url END AS path,
  CASE WHEN length(url) > 40 THEN substr(url, 1, 40) || '…' ELSE url END AS short FROM ({_ODD_URLS})
"""
)
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, u = spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("url")
    ends = F.array(*[F.lit(x) for x in ("", "/", "//", "?a=b", "/X/Y///", "#f")])
    rows = pages.select("page_id", F.concat("url", F.get(ends, (F.col("page_id") % 6).cast("int"))).alias("url")).unionByName(pages.where("page_id % 9 = 0").select("page_id", F.concat(F.lit("No address "), F.col("page_id").cast("string")).alias("url")))
    return rows.select("page_id", "url", urls.normalize(u, every_slash=True).alias("every_slash"), urls.shown_path(u).alias("path"), urls.shortened(u, 40).alias("short"))


_ASKED = "SELECT page_id % 25 AS request, page_id AS seq, CASE WHEN page_id % 25 = 0 THEN NULL WHEN page_id % 25 < 4 THEN 'https://one.example/' || page_id % 3 WHEN page_id % 25 = 4 THEN 'ftp://x' WHEN page_id % 25 = 5 AND page_id % 2 = 0 THEN 'http:// bad ' || page_id ELSE ' ' || url || ' ' END AS url FROM pages"


@_query(
    f"""
WITH asked AS ({_ASKED}), k AS (SELECT request, trim(url) AS url, min(seq) AS seq FROM asked WHERE starts_with(trim(url), 'http') GROUP BY 1, 2),
s AS (SELECT *, regexp_matches(url, '^http:// ') AS wrong, CASE WHEN regexp_matches(url, '^http:// ') THEN '' ELSE {_SITE} END AS site FROM k),
sites AS (SELECT request, string_agg(site, ', ' ORDER BY first_seq) AS sites, count(*) AS n FROM (SELECT request, site, min(seq) AS first_seq FROM s WHERE site <> '' GROUP BY 1, 2) GROUP BY 1),
bad AS (SELECT request, array_to_string(list(url ORDER BY seq)[1:3], ', ') AS bad FROM s WHERE wrong GROUP BY 1), n AS (SELECT request, count(*) AS n FROM k GROUP BY 1), g AS (SELECT request, count(url) AS given FROM asked GROUP BY 1)
SELECT g.request, coalesce(n.n, 0) AS n_urls, CASE WHEN given = 0 THEN 'No URLs provided.' WHEN coalesce(n.n, 0) < 2 THEN 'Please enter at least 2 URLs. Internal linking requires comparing multiple pages.' WHEN bad IS NOT NULL THEN 'Invalid URL(s): ' || bad
  WHEN sites.n > 1 THEN 'All URLs must be from the same domain. Found: ' || sites END AS error FROM g LEFT JOIN n USING (request) LEFT JOIN sites USING (request) LEFT JOIN bad USING (request)
"""
)
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt by page_id: some empty, of one address, with addresses that are none, of several sites."""
    i = F.col("page_id")
    url = (
        F.when(i % 25 == 0, F.lit(None).cast("string")).when(i % 25 < 4, F.concat(F.lit("https://one.example/"), (i % 3).cast("string"))).when(i % 25 == 4, "ftp://x")
        .when((i % 25 == 5) & (i % 2 == 0), F.concat(F.lit("http:// bad "), i.cast("string"))).otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    )
    return requests.check_requests(spark.read.parquet(f"{sf_dir}/pages.parquet").select((i % 25).alias("request"), i.alias("seq"), url.alias("url")))


@_query(f"SELECT {_SITE} AS domain, url FROM pages WHERE {_SITE} <> {_SITE.replace('url', 't')} OR lower({_PATH}) <> lower({_PATH.replace('url', 't')})".replace("FROM pages", "FROM (SELECT *, min(url) OVER () AS t FROM pages)"))
def link_candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses but the target's: the least of all."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select(urls.site_key(F.col("url")).alias("domain"), "url")
    foreign = rows.select("domain", F.concat(F.lit("https://elsewhere.example/"), "domain").alias("url"))
    return sitemap.link_candidates(rows.unionByName(foreign), pages.agg(F.min("url")).first()[0])


# Suggestions and pages made of documents: a page for each document, whose site is a seventh of all
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir)
    i = F.col("doc_id")
    at = lambda n: F.concat(F.lit("https://d"), (i % 7).cast("string"), F.lit(".example/p"), n.cast("string"))
    to = (i * 3 + 7) % 350 * 7 + i % 7
    return rows.select(
        F.concat(F.lit("d"), (i % 7).cast("string"), F.lit(".example")).alias("site_key"), i.alias("src_seq"), to.alias("tgt_seq"), at(i).alias("source_url"), at(to).alias("target_url"),
        F.concat(F.lit("d"), (i % 7).cast("string"), F.lit(".example/p"), i.cast("string")).alias("source_norm"), F.concat(F.lit("d"), (i % 7).cast("string"), F.lit(".example/p"), to.cast("string")).alias("target_norm"),
        F.col("anchor").alias("suggested_anchor"), _pick(i % 3, F.lit("exact"), F.lit(""), F.lit("partial")).alias("anchor_type"), F.when(i % 4 != 1, F.col("line")).alias("anchor_context"), scoring.position_label(F.col("position")).alias("para_position_label"),
        F.col("line").alias("existing_paragraph"), F.concat("line", F.lit(" ["), "anchor", F.lit("](http://t)")).alias("updated_paragraph"), F.col("points").alias("score"), scoring.priority(F.col("points")).alias("priority"), F.col("title").alias("reason"),
        F.col("meta").alias("body_content_reason"), F.col("shared_list").alias("shared_keywords"), F.col("page_type").alias("source_page_type"), F.concat("page_type", F.lit("-to-blog")).alias("link_type"), F.col("para_idx").alias("confidence"),
    )


_SUGGESTIONS = f"""{_CASES}, opps AS (
  SELECT 'd' || doc_id % 7 || '.example' AS site_key, doc_id AS src_seq, t AS tgt_seq, 'https://d' || doc_id % 7 || '.example/p' || doc_id AS source_url, 'https://d' || doc_id % 7 || '.example/p' || t AS target_url,
    'd' || doc_id % 7 || '.example/p' || doc_id AS source_norm, 'd' || doc_id % 7 || '.example/p' || t AS target_norm, anchor AS suggested_anchor, ['exact', '', 'partial'][doc_id % 3 + 1] AS anchor_type, CASE WHEN doc_id % 4 <> 1 THEN line END AS anchor_context, {_LABEL} AS para_position_label,
    line AS existing_paragraph, line || ' [' || anchor || '](http://t)' AS updated_paragraph, points AS score, CASE WHEN points >= 8 THEN 'High' WHEN points >= 6 THEN 'Medium' ELSE 'Low' END AS priority, title AS reason, meta AS body_content_reason, shared_list AS shared_keywords,
    page_type AS source_page_type, page_type || '-to-blog' AS link_type, para_idx AS confidence FROM (SELECT *, (doc_id * 3 + 7) % 350 * 7 + doc_id % 7 AS t FROM cases))"""


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, with links to pages of its site, by neighbourhood and by length."""
    i = F.col("doc_id")
    name = lambda n: F.concat(F.lit("d"), (i % 7).cast("string"), F.lit(".example/p"), n.cast("string"))
    links = F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(name(i + 7), name(F.col("n_chars") % 90 * 7 + i % 7), name(i), name(i + 7)))
    paragraphs = F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array("source"))
    return _docs(spark, sf_dir).select(
        F.concat(F.lit("d"), (i % 7).cast("string"), F.lit(".example")).alias("site_key"), i.alias("page_seq"), F.concat(F.lit("https://"), name(i)).alias("url"), name(i).alias("normalized_url"),
        F.col("source").alias("title"), F.col("lang").alias("page_type"), links.alias("existing_links"), paragraphs.alias("paragraphs"), (i % 3).cast("int").alias("n_repeated"),
    )


_PAGES = """pages_of AS (SELECT 'd' || doc_id % 7 || '.example' AS site_key, doc_id AS page_seq, 'd' || doc_id % 7 || '.example/p' AS base, 'd' || doc_id % 7 || '.example/p' || doc_id AS normalized_url, 'https://d' || doc_id % 7 || '.example/p' || doc_id AS url,
    source AS title, lang AS page_type, doc_id % 11 = 0 AS bare, doc_id % 13 = 0 AS blank, n_chars, doc_id, CAST(doc_id % 3 AS INTEGER) AS n_repeated FROM documents),
all_links AS (SELECT DISTINCT site_key, normalized_url AS src, unnest([base || (doc_id + 7), base || (n_chars % 90 * 7 + doc_id % 7), normalized_url]) AS dst FROM pages_of WHERE NOT bare),
links AS (SELECT l.* FROM all_links l SEMI JOIN pages_of p ON l.site_key = p.site_key AND l.dst = p.normalized_url),
ins AS (SELECT site_key, dst, count(*) AS n FROM links GROUP BY 1, 2), outs AS (SELECT site_key, src, count(*) AS n FROM links GROUP BY 1, 2)"""


@_query(f"WITH {_PAGES} SELECT p.site_key, p.normalized_url, CAST(coalesce(n, 0) AS INTEGER) AS inbound_count, coalesce(n, 0) = 0 AS is_orphan FROM pages_of p LEFT JOIN ins ON p.site_key = ins.site_key AND p.normalized_url = ins.dst")
def inbound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_inbound(linked_pages(spark, sf_dir)).select("site_key", "normalized_url", "inbound_count", "is_orphan")


_DEGREES = "SELECT p.site_key, p.normalized_url, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM pages_of p LEFT JOIN ins i ON p.site_key = i.site_key AND p.normalized_url = i.dst LEFT JOIN outs o ON p.site_key = o.site_key AND p.normalized_url = o.src"


@_query(f"WITH {_PAGES} {_DEGREES}")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(linked_pages(spark, sf_dir))


_ALL_DEGREES = """deg AS (SELECT p.site_key, p.normalized_url, any_value(p.url) AS url, any_value(p.title) AS title, any_value(p.page_type) AS page_type,
  any_value(coalesce(i.n, 0)) + count(*) FILTER (o.kind = 'in') AS inbound, any_value(coalesce(u.n, 0)) + count(*) FILTER (o.kind = 'out') AS outbound
  FROM pages_of p LEFT JOIN ins i ON p.site_key = i.site_key AND p.normalized_url = i.dst LEFT JOIN outs u ON p.site_key = u.site_key AND p.normalized_url = u.src
  LEFT JOIN (SELECT site_key, target_norm AS norm, 'in' AS kind FROM opps UNION ALL SELECT site_key, source_norm, 'out' FROM opps) o ON p.site_key = o.site_key AND p.normalized_url = o.norm GROUP BY 1, 2),
flags AS (SELECT *, unnest(list_filter([CASE WHEN inbound = 0 THEN 'orphan' END, CASE WHEN inbound = 1 THEN 'needs_more' END, CASE WHEN outbound > 7 THEN 'too_many' END], lambda x: x IS NOT NULL)) AS flag FROM deg)"""


@_query(f"WITH {_SUGGESTIONS}, {_PAGES}, {_ALL_DEGREES} SELECT site_key, url, title, page_type, inbound, outbound, flag FROM flags")
def link_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_flags(linked_pages(spark, sf_dir), suggestions(spark, sf_dir))


_FILTERED = "SELECT source_url, target_url, suggested_anchor FROM opps"


@_query(
    f"""
WITH {_SUGGESTIONS}, {_PAGES}, orphans AS (SELECT p.url FROM pages_of p LEFT JOIN ins i ON p.site_key = i.site_key AND p.normalized_url = i.dst WHERE i.n IS NULL)
SELECT 'kind' AS filter, * FROM ({_FILTERED} WHERE link_type = 'product-to-blog' AND priority = 'High' AND para_position_label = 'Early')
UNION ALL SELECT 'band', * FROM ({_FILTERED} WHERE score >= 6 AND score < 8 AND anchor_type = 'partial')
UNION ALL SELECT 'search', * FROM ({_FILTERED} WHERE contains(lower(source_url), 'in') OR contains(lower(target_url), 'in') OR contains(lower(suggested_anchor), 'in') OR contains(lower(coalesce(anchor_context, '')), 'in') OR len(list_filter(shared_keywords, lambda k: contains(k, 'in'))) > 0)
UNION ALL SELECT 'orphan', * FROM ({_FILTERED} WHERE target_url IN (SELECT url FROM orphans))
UNION ALL SELECT 'pair', * FROM ({_FILTERED} WHERE source_url = 'https://d2.example/p2' OR target_url = 'https://d0.example/p49')
"""
)
def facet_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    opps, keep = suggestions(spark, sf_dir), ("source_url", "target_url", "suggested_anchor")
    pages = graph.with_inbound(linked_pages(spark, sf_dir))
    pair = report.filter_opportunities(opps, source="https://d2.example/p2").unionByName(report.filter_opportunities(opps, target="https://d0.example/p49"))
    made = {
        "kind": report.filter_opportunities(opps, link_type="product-to-blog", priority="High", position="Early"), "band": report.filter_opportunities(opps, band="medium", anchor_type="partial"),
        "search": report.filter_opportunities(opps, search="IN"), "orphan": report.filter_opportunities(opps, pages, orphan_only=True), "pair": pair,
    }
    out = None
    for name, rows in made.items():
        rows = rows.select(F.lit(name).alias("filter"), *keep)
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(
    f"""
WITH {_SUGGESTIONS}, v AS (SELECT unnest([{{'facet': 'linkType', 'value': link_type}}, {{'facet': 'source', 'value': source_url}}, {{'facet': 'target', 'value': target_url}}, {{'facet': 'anchorType', 'value': anchor_type}}]) AS x FROM opps)
SELECT x.facet AS facet, x.value AS value, count(*) AS n FROM v WHERE x.value <> '' GROUP BY 1, 2
"""
)
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.facets(suggestions(spark, sf_dir))


@_query(f"WITH {_SUGGESTIONS} SELECT suggested_anchor AS anchor FROM (SELECT suggested_anchor, min((-score, src_seq, tgt_seq)) AS f FROM opps GROUP BY 1 ORDER BY f LIMIT 25)")
def anchor_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.anchor_variations(suggestions(spark, sf_dir))


@_query(f"WITH {_SUGGESTIONS} SELECT source_url, target_url, suggested_anchor, score FROM opps ORDER BY score DESC, src_seq, tgt_seq LIMIT 8")
def top_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_opportunities(suggestions(spark, sf_dir)).select("source_url", "target_url", "suggested_anchor", "score")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    told = _pick(i % 9, *map(F.lit, ("success:raw", "success:rendered", "failed:http-404", "failed:render-unavailable", "no-body-content:raw", "skipped:non-html", "js-detected", "failed:empty", "no-body-content")))
    return _docs(spark, sf_dir).select(F.col("source").alias("url"), told.startswith("success").alias("success"), told.alias("status"), F.col("lang").alias("message"), (i % 2 == 0).alias("js_detected"))


_LOG = "log AS (SELECT source AS url, ['success:raw', 'success:rendered', 'failed:http-404', 'failed:render-unavailable', 'no-body-content:raw', 'skipped:non-html', 'js-detected', 'failed:empty', 'no-body-content'][doc_id % 9 + 1] AS status, lang AS message, doc_id % 2 = 0 AS js FROM documents)"
_SKIPPED = "gone AS (SELECT source AS url, 'duplicate' AS reason, lang AS details FROM documents WHERE doc_id % 17 = 0)"


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("doc_id % 17 = 0").select(F.col("source").alias("url"), F.lit("duplicate").alias("reason"), F.col("lang").alias("details"))


@_query(
    f"""
WITH {_LOG}, {_SKIPPED} SELECT CASE WHEN starts_with(status, 'failed:') THEN 'failed' ELSE 'no-body' END AS view, url, status AS reason, message AS details FROM log WHERE starts_with(status, 'failed:') OR starts_with(status, 'no-body-content')
UNION ALL SELECT 'skipped', url, reason, details FROM gone UNION ALL SELECT 'skipped', url, status, message FROM log WHERE starts_with(status, 'skipped:')
"""
)
def failure_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    failed = report.failures(log).select("view", "url", F.col("status").alias("reason"), F.col("message").alias("details"))
    return failed.unionByName(report.skips(_skipped(spark, sf_dir), log).select(F.lit("skipped").alias("view"), "url", "reason", "details"))


def _share(test: str, name: str, of: str) -> str:
    return f"(SELECT count(*) FROM {of} WHERE {test}) AS {name}"


_SUMMARY = ", ".join(
    [
        _share("NOT starts_with(status, 'success')", "fetch_failed", "log"), _share("status = 'js-detected'", "js_detected", "log"), _share("status = 'success:raw'", "raw_fetched", "log"), _share("status = 'success:rendered'", "rendered", "log"),
        _share("starts_with(status, 'no-body-content')", "no_body_content", "log"), _share("starts_with(status, 'failed:render')", "render_failed", "log"), _share("true", "fetched_ok", "pages_of"), "(SELECT CAST(sum(n_repeated) AS BIGINT) FROM pages_of) AS boilerplate_removed",
        _share("true", "skipped_total", "gone"), _share("true", "total_opps", "opps"), _share("score >= 8", "high_priority", "opps"), _share("score >= 6 AND score < 8", "med_priority", "opps"), _share("score < 6", "low_priority", "opps"),
        _share("flag = 'orphan'", "orphan_pages", "flags"), _share("flag = 'needs_more'", "needs_more_links", "flags"), _share("flag = 'too_many'", "too_many_links", "flags"), "(SELECT count(*) FROM log) + (SELECT count(*) FROM gone) AS total_urls_entered",
    ]
)


@_query(f"WITH {_SUGGESTIONS}, {_PAGES}, {_ALL_DEGREES}, {_LOG}, {_SKIPPED} SELECT {_SUMMARY}")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_log(spark, sf_dir), linked_pages(spark, sf_dir), _skipped(spark, sf_dir), suggestions(spark, sf_dir))


_CELLS = (
    "source_url", "target_url", "suggested_anchor", "anchor_type", "coalesce(anchor_context, '')", "para_position_label", "existing_paragraph", r"regexp_replace(updated_paragraph, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')",
    "score || '/10'", "priority", "reason", "body_content_reason", "array_to_string(shared_keywords, '; ')", "source_page_type", "link_type", "confidence || '%'", "CASE WHEN i.n > 0 THEN CAST(i.n AS VARCHAR) ELSE '' END", "CASE WHEN p.url IS NOT NULL AND i.n IS NULL THEN 'Yes' ELSE 'No' END",
)


@_query(f"WITH {_SUGGESTIONS}, {_PAGES} SELECT " + ", ".join(f'{c} AS "{n}"' for c, n in zip(_CELLS, report.EXPORT_COLUMNS)) + " FROM (SELECT * FROM opps) o LEFT JOIN (SELECT url, normalized_url, site_key AS sk FROM pages_of) p ON o.target_url = p.url LEFT JOIN (SELECT site_key AS sk, dst, n FROM ins) i ON p.sk = i.sk AND p.normalized_url = i.dst")
def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.export_rows(suggestions(spark, sf_dir), graph.with_inbound(linked_pages(spark, sf_dir)))


@_query(
    f"""
WITH {_SUGGESTIONS}, {_LOG} SELECT 'opportunities' AS section, CAST(json_object('source_url', source_url, 'score', score, 'shared_keywords', shared_keywords) AS VARCHAR) AS json FROM opps
UNION ALL SELECT 'fetchLog', CAST(json_object('status', status, 'js_detected', js) AS VARCHAR) FROM log
"""
)
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_rows(opportunities=suggestions(spark, sf_dir).select("source_url", "score", "shared_keywords"), fetchLog=_log(spark, sf_dir).select("status", "js_detected"))


_LEAST = CORE.min_score


@_query(
    f"""
WITH {_SUGGESTIONS}, {_PAGES}, made AS (SELECT * FROM opps WHERE src_seq % 2 = 0), sizes AS (SELECT site_key, count(*) AS n FROM pages_of GROUP BY 1), others AS (SELECT site_key, src, count(*) AS n FROM links WHERE src <> dst GROUP BY 1, 2)
SELECT p.site_key, p.page_seq, p.url, CASE WHEN blank THEN 'No valid body paragraphs extracted from this page' WHEN coalesce(o.n, 0) = s.n - 1 THEN 'Already links to every other page in the set'
  WHEN p.normalized_url NOT IN (SELECT target_norm FROM made) THEN 'No natural anchor text found matching other pages'' topics (min score: {_LEAST}/10)' ELSE 'All suggestions below minimum score threshold ({_LEAST}/10)' END AS no_opportunity_reason
FROM pages_of p JOIN sizes s USING (site_key) LEFT JOIN others o ON o.site_key = p.site_key AND o.src = p.normalized_url WHERE p.normalized_url NOT IN (SELECT source_norm FROM made)
"""
)
def pages_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of pages with an odd number: only even ones have suggestions."""
    return site.without_opportunity(linked_pages(spark, sf_dir), suggestions(spark, sf_dir).where("src_seq % 2 = 0"), CORE)


# Repeated paragraphs: a source's documents as a site's pages, their lines as paragraphs
def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.slice(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x))), 1, 80)
    rows = _docs(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("doc_id") % 250).cast("string")).alias("site_key"), F.col("doc_id").alias("page_seq"), F.when(F.col("doc_id") % 250 < 200, F.array_insert(lines, 1, F.concat(F.lit("A paragraph that every page of the site repeats: s"), (F.col("doc_id") % 250).cast("string")))).otherwise(lines).alias("paragraphs"))
    return rows.withColumn("paragraphs", F.slice("paragraphs", 1, 80)).withColumn("paragraph_positions", corpus.positions(F.size("paragraphs"))).withColumn("paragraph_count", F.size("paragraphs"))


_PAGED = """paged AS (SELECT 's' || doc_id % 250 AS site_key, doc_id AS page_seq, (CASE WHEN doc_id % 250 < 200 THEN ['A paragraph that every page of the site repeats: s' || doc_id % 250] ELSE [] END || ls[1:80])[1:80] AS ps
  FROM (SELECT doc_id, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) AS ls FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents))),
counts AS (SELECT site_key, p AS paragraph, count(DISTINCT page_seq) AS n FROM (SELECT site_key, page_seq, unnest(ps) AS p FROM paged) WHERE length(p) >= 50 GROUP BY 1, 2),
sizes AS (SELECT site_key, count(*) AS pages FROM paged GROUP BY 1), frame AS (SELECT c.*, pages FROM counts c JOIN sizes USING (site_key) WHERE pages >= 3 AND n >= greatest(3, ceil(pages * 0.4::DOUBLE)))"""


@_query(f"WITH {_PAGED} SELECT site_key, paragraph, n, pages FROM frame")
def site_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_paragraphs(_paged(spark, sf_dir)).select("site_key", "paragraph", "n", "pages")


@_query(
    f"""
WITH {_PAGED}, f AS (SELECT site_key, list(paragraph) AS fs FROM frame GROUP BY 1), kept AS (SELECT page_seq, ps, CASE WHEN fs IS NULL THEN ps ELSE list_filter(ps, lambda p: NOT list_contains(fs, p)) END AS ks FROM paged LEFT JOIN f USING (site_key))
SELECT page_seq, CAST(len(ps) - len(ks) AS INTEGER) AS n_repeated, CAST(len(ks) AS INTEGER) AS paragraph_count, CAST(i AS INTEGER) AS para_idx, ks[i + 1] AS paragraph, CASE WHEN len(ks) = 1 THEN 0.0::DOUBLE ELSE round(i / (len(ks) - 1)::DOUBLE, 3) END AS position
FROM (SELECT *, unnest(range(0, len(ks))) AS i FROM kept)
"""
)
def paragraphs_that_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.drop_repeated(_paged(spark, sf_dir))
    both = F.posexplode(F.arrays_zip(F.col("paragraphs").alias("text"), F.col("paragraph_positions").alias("position"))).alias("para_idx", "p")
    return rows.select("page_seq", "n_repeated", "paragraph_count", both).select("page_seq", "n_repeated", "paragraph_count", "para_idx", F.col("p.text").alias("paragraph"), "p.position")


# Boilerplate headings and texts: each pattern is met by lines that begin with one of these
_HEADS = ("About the Author", "About Our Authors", "Related Posts", "Competitive Intelligence in Practice", "Subscribe to our Newsletter", "Meet the author", "Written by", "Guest post", "You might also like", "Keep reading", "More stories", "Recommended for you",
    "Read next", "Up next", "Next article", "Don't miss", "Trending now", "Popular posts", "Most read", "Sign up for", "Newsletter", "Leave a comment", "Comments", "Join the discussion", "Share this", "Tags:", "Categories", "Filed under:", "Topics", "Post navigation", "Previous post", "What to read next")
_TEXTS = ("She is a senior staff writer", "By Jane Doe Smith", "by jane doe", "Ann covers markets for Reuters", "He writes about rivers", "It reports on trade", "Focuses on hills", "specializing in maps", "has been writing for years", "10+ years of experience", "previously worked here",
    "her work has appeared", "follow us on twitter", "connect with them", "find her on", "reach us at", "connect on linkedin", "views expressed", "opinions are her own", "guest author", "affiliate", "share this article", "subscribe to", "read more", "click here to", "Last updated", "tags: a", "related posts: b", "you might like", "A plain line")


def _headed(spark: SparkSession, sf_dir: str, heads: tuple[str, ...]) -> DataFrame:
    """The first line of every document after one of the heads; every third head stands alone."""
    n = len(heads)
    head = F.get(F.array(*map(F.lit, heads)), (F.col("doc_id") % n).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, head).otherwise(F.concat(head, F.lit(" "), F.substring_index("text", "\n", 1))).alias("line"))


def _headed_sql(heads: tuple[str, ...]) -> str:
    return f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN h ELSE h || ' ' || split_part(text, chr(10), 1) END AS line FROM (SELECT *, [{_list(heads)}][doc_id % {len(heads)} + 1] AS h FROM documents)"


@_query(f"SELECT doc_id, line FROM ({_headed_sql(_HEADS)}) WHERE length(line) >= 3 AND regexp_matches(line, '(?i){_any(BOILERPLATE_HEADINGS)}')")
def boilerplate_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.udf(extract.is_boilerplate_heading, "boolean")
    return _headed(spark, sf_dir, _HEADS).where(test("line"))


@_query(f"SELECT doc_id, line FROM ({_headed_sql(_TEXTS)}) WHERE regexp_matches(line, '(?i){_any(BOILERPLATE_TEXTS)}') OR regexp_matches(line, '{BYLINE.replace(chr(39), chr(39) * 2)}')")
def boilerplate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = F.udf(extract.is_boilerplate_text, "boolean")
    return _headed(spark, sf_dir, _TEXTS).where(test("line"))


# Allocation: documents as scored pairs; the SQL takes them one by one, as the caps ask
_SCORED = f"""{_CASES}, scored AS (SELECT 'g' || doc_id % 40 AS site_key, doc_id // 40 % 4 AS src_seq, doc_id // 7 % 5 AS tgt_seq, CAST(doc_id AS INTEGER) AS para_idx, anchor, CAST(doc_id % 6 + 5 AS INTEGER) AS score FROM cases),
best AS (SELECT site_key, src_seq, tgt_seq, lower(anchor) AS low, max_by((para_idx, anchor, score), (score, -para_idx)) AS b FROM scored WHERE score >= 7 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site_key, src_seq, tgt_seq ORDER BY b[3] DESC, b[1]) AS place FROM best),
turn AS (SELECT *, row_number() OVER (PARTITION BY site_key ORDER BY src_seq, tgt_seq, place) AS rn FROM ranked WHERE place <= 2)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return cases(spark, sf_dir).select(F.concat(F.lit("g"), (i % 40).cast("string")).alias("site_key"), F.floor(i / 40).cast("long").__mod__(4).alias("src_seq"), F.floor(i / 7).cast("long").__mod__(5).alias("tgt_seq"), i.cast("int").alias("para_idx"), "anchor", (i % 6 + 5).cast("int").alias("score"))


@_query(
    f"""
WITH RECURSIVE {_SCORED},
walk AS (
  SELECT site_key, 0::BIGINT AS rn, NULL::BIGINT AS src, NULL::BIGINT AS pair, []::VARCHAR[] AS used, []::BIGINT[] AS goals, false AS taken FROM (SELECT DISTINCT site_key FROM turn)
  UNION ALL
  SELECT site_key, rn, src_seq, CASE WHEN take THEN tgt_seq WHEN fresh THEN NULL ELSE pair END, CASE WHEN take THEN list_append(u, low) ELSE u END, CASE WHEN take THEN list_append(goals, tgt_seq) ELSE goals END, take
  FROM (
    SELECT *, (fresh OR pair IS NULL OR pair <> tgt_seq) AND len(u) < 2 AND len(list_filter(goals, lambda g: g = tgt_seq)) < 3 AND NOT list_contains(u, low) AS take
    FROM (SELECT t.site_key, t.rn, t.src_seq, t.tgt_seq, t.low, w.pair, w.goals, w.src IS DISTINCT FROM t.src_seq AS fresh, CASE WHEN w.src IS DISTINCT FROM t.src_seq THEN []::VARCHAR[] ELSE w.used END AS u FROM walk w JOIN turn t ON t.site_key = w.site_key AND t.rn = w.rn + 1)
  )
)
SELECT t.site_key, t.src_seq, t.tgt_seq, t.b[1] AS para_idx, t.b[2] AS anchor, t.b[3] AS score FROM walk w JOIN turn t USING (site_key, rn) WHERE w.taken
"""
)
def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links for a source and three for a target at most."""
    rows = allocate.allocate(_scored(spark, sf_dir), Settings(max_links_per_source=2, max_links_per_target=3))
    return rows.select("site_key", "src_seq", "tgt_seq", "para_idx", "anchor", "score")


# One target: every document as a candidate
_CANDIDATES = f"""{_CASES}, scores AS (SELECT *, 'https://t.example/' || doc_id AS url, 't.example/' || doc_id AS normalized_url, CASE WHEN doc_id % 8 NOT IN (2, 5) THEN anchor END AS own, doc_id % 5 = 0 AS already_links,
  floor((least(4.0::DOUBLE, shared * 0.4::DOUBLE) + least(3.0::DOUBLE, similarity * 12.0::DOUBLE) + CASE WHEN doc_id % 8 NOT IN (2, 5) THEN least(2.0::DOUBLE, para_idx * 0.2::DOUBLE) ELSE 0 END + least(1.0::DOUBLE, inbound * 0.5::DOUBLE)) * 10 + 0.5) / 10 AS composite FROM cases)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, own = F.col("doc_id"), ~(F.col("doc_id") % 8).isin(2, 5)
    rows = cases(spark, sf_dir)
    points = semantic.composite(F.col("shared"), F.col("similarity"), F.when(own, F.col("para_idx")), F.col("inbound"))
    name = F.concat(F.lit("t.example/"), i.cast("string"))
    return rows.select(
        F.lit("t.example").alias("site_key"), i.alias("page_seq"), F.concat(F.lit("https://"), name).alias("url"), name.alias("normalized_url"), "title", "page_type", F.lit("raw").alias("render_method"), F.lit("html5-main").alias("extraction_method"), F.col("trust").alias("confidence"),
        F.array("line").alias("paragraphs"), F.col("shared_list").alias("shared_keywords"), F.col("similarity").alias("cosine_similarity"), points.alias("composite_score"), F.when(own, F.col("anchor")).alias("anchor"), F.when(own, F.col("para_idx")).alias("anchor_score"),
        F.when(own, F.col("line")).alias("anchor_para"), (i % 5 == 0).alias("already_links"), F.col("inbound").alias("title_overlap"), F.lit("https://t.example/goal").alias("target_url"), F.col("meta").alias("target_title"), F.col("h1").alias("target_h1"), F.col("topics").alias("target_topics"), F.lit("product").alias("target_page_type"),
        F.col("target_list").alias("target_keywords"),
    )


@_query(f"WITH {_CANDIDATES} SELECT url, title, composite AS score, CAST(len(shared_list) AS INTEGER) AS shared_kws, similarity AS cos_sim, own IS NOT NULL AS has_anchor, own AS anchor, already_links FROM scores ORDER BY composite DESC, doc_id LIMIT 20")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target.top_scores(_candidates(spark, sf_dir))


_DERIVED = f"CASE WHEN len(shared_list) > 0 THEN coalesce(target_list[i] || ' ' || target_list[i + 1], list_filter(shared_list, lambda k: len(string_split_regex(k, '\\s+')) >= 2 OR length(k) >= 8)[1], shared_list[1]) END"
_LEAD = r"nullif(array_to_string(string_split_regex(trim(regexp_replace(CASE WHEN h1 <> '' THEN h1 ELSE meta END, '[|\-–—].*$', '')), '\s+')[1:4], ' '), '')"


@_query(
    f"""
WITH {_CANDIDATES}, y AS (SELECT *, {_HIT.replace("(s,", "(shared_list,").replace("len(t)", "len(target_list)").replace("t[i", "target_list[i")} AS i FROM scores),
z AS (SELECT *, coalesce(own, {_DERIVED}, {_LEAD}) AS a FROM y WHERE NOT already_links AND composite >= 0.5 AND doc_id % 3 <> 1)
SELECT doc_id AS src_seq, url AS source_url, line AS existing_paragraph, a AS suggested_anchor, page_type || '-to-product' AS link_type, CAST(floor(composite + 0.5) AS INTEGER) AS score, CAST(floor(similarity * 100 + 0.5) AS INTEGER) AS confidence,
  CASE WHEN composite >= 5 THEN 'High' WHEN composite >= 2.5 THEN 'Medium' ELSE 'Low' END AS priority, CASE WHEN own IS NOT NULL THEN 'natural' ELSE 'semantic' END AS opportunity_type, composite AS composite_score,
  CASE WHEN own IS NULL THEN line || chr(10) || chr(10) || '(Consider adding a link to: [' || a || '](https://t.example/goal))' WHEN instr(line, a) > 0 THEN substr(line, 1, instr(line, a) - 1) || '[' || a || '](https://t.example/goal)' || substr(line, instr(line, a) + length(a)) ELSE line END AS updated_paragraph
FROM z WHERE a IS NOT NULL ORDER BY composite DESC, doc_id LIMIT 20
"""
)
def fill_in_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a number of rest 1 by three have a strict suggestion already."""
    rows = _candidates(spark, sf_dir)
    strict = rows.where("page_seq % 3 = 1").select(F.col("normalized_url").alias("source_norm"))
    made = semantic.fill_ins(rows, strict)
    return made.select("src_seq", "source_url", "existing_paragraph", "suggested_anchor", "link_type", "score", "confidence", "priority", "opportunity_type", "composite_score", "updated_paragraph")


_NONE = "SELECT '{0}' AS of, CASE WHEN count(*) = 0 THEN 'No source pages yielded valid body content (' || (SELECT count(*) FROM log WHERE js) || ' JS-rendered, ' || (SELECT count(*) FROM log WHERE starts_with(status, 'failed:render')) || ' render failures, ' || (SELECT count(*) FROM log WHERE starts_with(status, 'failed:') AND NOT starts_with(status, 'failed:render')) || ' fetch failures).' WHEN bool_and(already_links) THEN 'All fetched pages already link to the target page.' WHEN bool_and(composite < 1) THEN 'All ' || count(*) || ' pages scored below 1/10 — target content may be very different from the rest of the site.' ELSE 'Scores found but all below minimum threshold (5/10). Highest: ' || printf('%.1f', max(composite)) || '.' END AS reason FROM scores WHERE {1}"
_SUBSETS = {"none": "false", "linked": "already_links", "low": "composite_score < 1", "rest": "composite_score >= 1"}


@_query(f"WITH {_CANDIDATES}, {_LOG} " + " UNION ALL ".join(_NONE.format(k, v.replace("composite_score", "composite")) for k, v in _SUBSETS.items()))
def no_result_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a target has no suggestion, for no candidates, linked ones, low ones and the rest."""
    rows, log, out = _candidates(spark, sf_dir), _log(spark, sf_dir), None
    for name, test in _SUBSETS.items():
        one = semantic.no_result_reason(rows.where(test), log, 5).select(F.lit(name).alias("of"), "reason")
        out = one if out is None else out.unionByName(one)
    return out


# Keywords of documents against those of benchmark items, by the library's own similarity
def _kept(pattern: str, least: int, of: str = "text") -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({of}), '{pattern}', ' ', 'g'), '\s+'), lambda w: length(w) >= {least} AND w NOT IN ({_list(STOPWORDS)}) AND NOT regexp_matches(w, '^[0-9]+$'))"


_TERMS = rf"list_slice({_kept(r'[^a-z0-9\s]', 4)}, 1, 60)"
_MET = f"""
WITH i AS (SELECT item_id, {_TERMS} AS w FROM benchmark), d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
hits AS (SELECT doc_id, item_id, count(*) AS n, count(DISTINCT word) AS k FROM (SELECT doc_id, unnest(w) AS word FROM d) a JOIN (SELECT DISTINCT item_id, unnest(w) AS word FROM i) b USING (word) GROUP BY ALL)"""


def keyword_pairs(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """(doc_id, item_id, ours, theirs) of the pairs that share `least` keywords: they meet by keyword, then bring their lists."""
    ours = docs.select("doc_id", F.explode(F.array_distinct("ours")).alias("word"))
    theirs = items.select("item_id", F.explode(F.array_distinct("theirs")).alias("word"))
    often = ours.groupBy("word").agg(F.count("*").alias("often"))
    met = ours.join(theirs.join(often, "word"), "word").groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return met.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "ours", "theirs")


def _lists(spark: SparkSession, sf_dir: str, table: str, key: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, words.paragraph_keywords(F.col("text")).alias(name))


@_query(f"{_MET} SELECT doc_id, item_id, hits.n / sqrt(CAST(len(d.w) AS DOUBLE) * len(i.w)) AS similarity FROM hits JOIN d USING (doc_id) JOIN i USING (item_id) WHERE hits.n / sqrt(CAST(len(d.w) AS DOUBLE) * len(i.w)) >= 0.12")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents near a benchmark item by their first 60 keywords, repeats included."""
    pairs = keyword_pairs(_lists(spark, sf_dir, "documents", "doc_id", "ours"), _lists(spark, sf_dir, "benchmark", "item_id", "theirs"), 1)
    return pairs.select("doc_id", "item_id", words.cosine(F.col("ours"), F.col("theirs")).alias("similarity")).where("similarity >= 0.12")


@_query(f"{_MET} SELECT doc_id, item_id, CAST(k AS INTEGER) AS n_shared FROM hits WHERE k >= 2")
def keyword_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share two different keywords."""
    pairs = keyword_pairs(_lists(spark, sf_dir, "documents", "doc_id", "ours"), _lists(spark, sf_dir, "benchmark", "item_id", "theirs"), 2)
    return pairs.select("doc_id", "item_id", F.size(words.shared_in_order(F.col("ours"), F.col("theirs"))).alias("n_shared"))
