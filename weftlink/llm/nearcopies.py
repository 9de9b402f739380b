"""Near copies: texts that share four fifths of their runs of five words.

A text is the set of its distinct shingles. Equal sets are one node. SimHash fingerprints of the sets meet by ball
hashing, which joins the nearest; at a similarity of 0.8 fingerprints differ in about 10 of 64 bits, so nodes whose
least hashes agree in a whole band meet as well. Each pair that is compared is decided by its exact Jaccard similarity.
First a node is compared with one that ball hashing found, and with the least node of the buckets that it shares the
most of. Then nodes still apart are compared: with the others that ball hashing found, and within each bucket all with
all, whatever its size. For that a bucket is dealt as pairs of blocks to tasks, which bound each pair's similarity from
above by 32 bits of each shingle; who may be similar and is not joined otherwise is decided exactly, as all pairs are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common, simhash
from weftlink.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s meets with probability 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.8, 0.99999 at 0.85.
BANDS, ROWS = 24, 6
#: Nodes of a block of a bucket; a task compares those of two blocks.
BLOCK = 256
#: Numbers of short forms that a task holds as tokens at once, about.
TOKENS = 1 << 17
#: Tables of up to so many ids are broadcast, which holds about 200 bytes a row in the driver. Of larger ones a bit for each id is, and what passes is joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Bits for an id, in blocks of BLOCK_BITS; so many blocks at most, 16 MB. Beyond that more rows pass than are wanted, and the join decides.
BITS_AN_ID, BLOCK_BITS, MOST_BLOCKS = 32, 1 << 15, 1 << 12
_WORD = re.compile(r"[^\W_]+")
#: Shingles that are hashed at once.
_STEP = 1 << 9
_DRAW = np.random.default_rng(5)
_FLIP = _DRAW.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MIX = _DRAW.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_ODD = _DRAW.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct runs of five words, of all words where there are fewer; case and punctuation do not count."""
    low = text.lower()
    words = _WORD.findall(low) or low.split()  # marks alone are told apart
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter([digest(w) for w in words], np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out += each[k : k + n] * _ODD[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def node_of(some: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(some.tobytes()) - (1 << 63)


def bands(some: np.ndarray) -> np.ndarray:
    """A hash for each band of least hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(some), _STEP):
        drawn = (some[at : at + _STEP] >> np.uint64(32)).astype(np.uint32) ^ _FLIP[:, None]
        drawn *= _MIX[:, None]
        np.minimum(least, drawn.min(1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def fingerprint(some: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(some), 1 << 15):
        ones += np.unpackbits(some[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(some)).tobytes(), "big", signed=True)


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, node, fp, keys) for each row of docs (doc_id, tid, text); keys: none for a blank text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.groups(batch, 2):
                nodes, fps, keys = [], [], []
                for text in part.column(2).to_pylist():
                    some = shingles(text or "")
                    nodes.append(node_of(some))
                    fps.append(fingerprint(some))
                    keys.append(bands(some) if len(some) else [])
                columns = [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "node", "fp", "keys"])

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, node long, fp long, keys array<long>")


def _passing(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows of docs (doc_id, tid, ...) that may be among the n of wanted (id, tid): all that are, and few others."""
    blocks = min(MOST_BLOCKS, 1 << (n * BITS_AN_ID // BLOCK_BITS).bit_length())

    def place(doc_id: str) -> tuple[Column, Column]:
        h = F.xxhash64(doc_id, "tid")
        return F.pmod(h, F.lit(blocks)).alias("_block"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(BLOCK_BITS - 1))

    block, at = place("id")
    bits = common.cut_lineage(wanted.select(block, at.alias("at")).groupBy("_block").agg(F.bitmap_construct_agg("at").alias("_bits")))
    block, at = place("doc_id")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumns({"_block": block, "_at": at}).join(F.broadcast(bits), "_block")
    return marked.where(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1).select(docs.columns)


def _sets(docs: DataFrame, wanted: DataFrame, more: str | None = None, brief: bool = False) -> DataFrame:
    """(node, shingles) of the nodes wanted (node, id, tid), one document of each, with the long column `more` if one is named; a node comes twice where its document does. brief: short forms as binary."""
    keep = ["node", *([more] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.groups(batch, len(keep)):
                sets = (shingles(t or "") for t in part.column(len(keep)).to_pylist())
                made = pa.array([short(x) for x in sets], pa.binary()) if brief else pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*keep, "shingles"])

    wanted = common.cut_lineage(wanted.select(*keep, "id", F.col("tid").alias("_tid")))
    n, rows = wanted.count(), docs.select("doc_id", "tid", "text")
    if n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:
        rows = _passing(rows, wanted.select("id", F.col("_tid").alias("tid")), n)
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tid") == F.col("_tid"))).select(*keep, "text")
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in keep) + f", shingles {'binary' if brief else 'array<long>'}")


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes (node, first: one of its documents) whose shingle sets are similar enough. A node may be the a of any number of pairs, the b of few."""
    pairs = common.cut_lineage(pairs.select("a", "b"))  # read for both ends
    at = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.tid").alias("tid"))
    centres = common.cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("often")))
    left = _sets(docs, at.join(centres, at["node"] == centres["a"], "left_semi")).dropDuplicates(["node"]).select(F.col("node").alias("a"), F.col("shingles").alias("own"))
    # of a pair one set travels, that of b; a's goes to where its pairs are
    right = _sets(docs, at.join(pairs, at["node"] == pairs["b"]), "a").select("a", F.col("node").alias("b"), F.col("shingles").alias("other"))
    met = common.salted_join(right, left, ["a"], ["b"], "often", sizes=centres)
    shared = F.size(F.array_intersect("own", "other"))
    whole = F.size("own") + F.size("other")
    return common.cut_lineage(met.where(common.let(shared, lambda s: s / (whole - s)) >= similarity).select("a", "b").distinct())


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends are not in one component of found (node, component)."""
    sizes = common.cut_lineage(pairs.groupBy("a").agg(F.count("*").alias("often")))
    of_a = found.select(F.col("node").alias("a"), F.col("component").alias("_of_a"))
    of_b = found.select(F.col("node").alias("b"), F.col("component").alias("_of_b"))
    known = common.salted_join(pairs, of_a, ["a"], ["b"], "often", "left", sizes=sizes).join(of_b, "b", "left")
    return known.where(F.coalesce("_of_a", "a") != F.coalesce("_of_b", "b")).drop("_of_a", "_of_b")


def short(some: np.ndarray) -> bytes:
    """32 bits of each shingle, sorted. Two sets share at most as many shingles as their short forms share numbers, repeats counted."""
    return np.sort((some >> np.uint64(32)).astype(np.uint32)).tobytes()


def _common(numbers: np.ndarray, owners: np.ndarray, n: int, shared: np.ndarray) -> None:
    """Adds to shared (n, n) how many numbers, repeats counted, each two owners have in common. Each owner's numbers are sorted."""
    place = np.arange(len(numbers))
    new = np.ones(len(numbers), bool)
    new[1:] = (numbers[1:] != numbers[:-1]) | (owners[1:] != owners[:-1])
    # the k-th repeat of a number is a token of its own
    tokens = numbers | ((place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) << np.uint64(32))
    by = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[by], owners[by]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    token = np.cumsum(first) - 1
    several = np.bincount(token) > 1
    owners, token = owners[several[token]], (np.cumsum(several) - 1)[token[several[token]]]
    step = 1 << 10
    for at in range(0, int(several.sum()), step):  # float32 counts exactly up to 2**24
        a, b = np.searchsorted(token, (at, at + step))
        has = np.zeros((n, step), np.float32)
        has[owners[a:b], token[a:b] - at] = 1
        shared += has @ has.T


def may_be_similar(shorts: list[bytes], components: list[int], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bound), i < j, of all pairs of different components whose similarity is `similarity` or more as far as their short forms tell; the highest bounds first."""
    own = [np.frombuffer(x, np.uint32) for x in shorts]
    sizes, shared = np.array([len(x) for x in own], np.float32), np.zeros((len(own), len(own)), np.float32)
    # one range of numbers after the other
    for lows in itertools.pairwise(np.linspace(0, 1 << 32, int(sizes.sum(dtype=np.float64)) // TOKENS + 2).astype(np.uint64)):
        cuts = [np.searchsorted(x, lows) for x in own]
        some = [x[a:b] for x, (a, b) in zip(own, cuts)]
        numbers = np.concatenate(some).astype(np.uint64)
        if len(numbers):
            _common(numbers, np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in some]), len(own), shared)
    bound = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    known = np.array(components, np.int64)
    i, j = np.nonzero(np.triu((bound >= similarity - 1e-6) & (known[:, None] != known[None, :]), 1))
    by = np.argsort(-bound[i, j], kind="stable")
    return i[by], j[by], bound[i, j][by]


def _joining(i: np.ndarray, j: np.ndarray, components: list[int]) -> list[int]:
    """Those of the pairs (i, j), in their order, that join what those before them, and the components, have not joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = root(components[a]), root(components[b])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(k)
    return out


def _within_buckets(members: DataFrame, found: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, every: bool = False) -> DataFrame:
    """(a, b): of the nodes that share a bucket of members (key, node) and are in different components of found, those that may be similar; without `every` only enough pairs to join them if all are.

    A bucket of n nodes is dealt to tasks as all pairs of its ceil(n / BLOCK) blocks. No pair is left out.
    """
    sizes = common.cut_lineage(members.groupBy("node").agg(F.count("*").alias("often")))
    joined = common.salted_join(members.select("key", "node"), found.join(sizes, "node"), ["node"], ["key"], "often", "left").withColumn("component", F.coalesce("component", "node"))
    joined = common.cut_lineage(joined.select("key", "node", "component"))
    mixed = joined.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least < most").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"), "n")
    dealt = common.cut_lineage(common.salted_join(joined, mixed.withColumn("weight", F.col("n")), ["key"], ["node"], "weight"))

    at = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.tid").alias("tid"))
    often = dealt.groupBy("node").agg(F.count("*").alias("often"))
    shorts = _sets(docs, at.join(often, "node", "left_semi"), brief=True).withColumnRenamed("shingles", "short").dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("key", "node"), F.col("blocks"))
    other = dealt.select("key", "node", "component", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    parts = other.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component").join(shorts, "node")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, known = rows.column("node").to_numpy(), rows.column("component").to_pylist()
        i, j, _ = may_be_similar(rows.column("short").to_pylist(), known, similarity)
        if not every:
            some = _joining(i, j, known)
            i, j = i[some], j[some]
        return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    return common.cut_lineage(parts.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct())


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes (node, fp) whose fingerprints are equal or differ in up to four bits, enough pairs to join them."""
    fps = common.cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("a"), F.count("*").alias("n")))
    near = simhash.links(fps.select(F.col("a").alias("node"), "fp"), simhash.part_bits(fps.count()))
    same = common.salted_join(nodes.select(F.col("node").alias("b"), "fp"), fps.where("n > 1"), ["fp"], ["b"], "n").where("a <> b").select("a", "b")
    # the least node of equals is the a of all of them, so a node is the b of few pairs
    return near.select("a", "b").unionByName(same).distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tid, component_id, stays) for each row of docs (doc_id, text).

    component_id: the least doc_id reachable over pairs of a similarity of `similarity` or more; tid: a hash of the
    text; stays: whether the row is its component's first by doc_id and tid. Null and blank texts are copies of one
    another. Repeated rows are one document and have one result; rows with one doc_id and several texts are judged
    text by text. A null doc_id comes after all others. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    seen = common.cut_lineage(nodes_of(docs))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tid")
    nodes = common.cut_lineage(seen.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    each = nodes.select("node", F.explode("keys").alias("key"))
    buckets = each.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").withColumn("weight", F.col("n"))
    members = common.cut_lineage(common.salted_join(each, buckets, ["key"], ["node"], "weight"))
    stars = common.cut_lineage(members.where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared")))
    near = common.cut_lineage(_by_fingerprint(nodes.where(F.size("keys") > 0)))
    # first one pair for each node of either kind, with the centre that shares the most bands: that joins most of those that belong together
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    first = common.cut_lineage(best.unionByName(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct())
    edges = _similar(first, docs, nodes, similarity)
    found = common.cut_lineage(components(edges))
    rest = common.cut_lineage(_apart(near.join(first, ["a", "b"], "left_anti"), found).select("a", "b"))
    pairs = _within_buckets(members, found, docs, nodes, similarity)
    more = _similar(rest.unionByName(pairs).distinct(), docs, nodes, similarity)
    edges = common.cut_lineage(edges.unionByName(more))
    if not pairs.join(more, ["a", "b"], "left_anti").isEmpty():
        # a pair that was to join others is not similar, so pairs that it stood for count: all that are left
        pairs = _within_buckets(members, components(edges), docs, nodes, similarity, every=True)
        edges = edges.unionByName(_similar(pairs, docs, nodes, similarity))
    named = nodes.select("node", "first", "rows").join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = common.cut_lineage(named)
    least = named.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("nodes"))
    named = common.salted_join(named, least, ["component"], ["node"], "nodes").select("node", "least", "rows")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tid") == F.col("least.tid"))
    return common.salted_join(seen.select("doc_id", "tid", "node"), named, ["node"], ["doc_id", "tid"], "rows").select("doc_id", "tid", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))
