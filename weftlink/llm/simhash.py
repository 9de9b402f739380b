"""Near-duplicates by SimHash fingerprints and ball hashing that meets in the middle.

Two fingerprints at a distance of up to 2 r bits have a value within r bits of each. Every distinct fingerprint therefore
emits all values in its ball of radius r, equal values meet, and who meets is verified. Values are dealt to tasks by
their leading bits. As a ball touches few leading parts, a fingerprint travels once for each part and the task
makes the values of that part, which moves 8 bytes for a part instead of 16 for each of 2,081 values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common
from weftlink.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Values a task makes at once for a leading part, at the least number of leading bits that allows it.
VALUES_A_PART = 500_000
MAX_PART_BITS = 24
#: Tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A linear code: the code of x ^ y is that of x ^ that of y. A table for each byte of a number.
_CODES = np.zeros((8, 256), np.uint32)
for _bit, _code in enumerate(np.random.default_rng(64).integers(1, 1 << 32, 64, dtype=np.uint32)):
    _CODES[_bit // 8] ^= np.where(np.arange(256) >> _bit % 8 & 1, _code, 0).astype(np.uint32)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's 4-word shingles: a bit is set if it is in over half of their hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= SHINGLE:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text); fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [struct.unpack(">q", fingerprint(t or b"").to_bytes(8, "big"))[0] for t in common.as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, radius: int) -> np.ndarray:
    """All numbers with up to `radius` of the lowest `bits` bits set, the fewest first."""
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)], np.uint64)


def part_bits(fps: int) -> int:
    """Leading bits that leave about VALUES_A_PART values to a part."""
    ball = len(_masks(BITS, RADIUS // 2))
    return max(1, min(MAX_PART_BITS, (max(1, fps * ball) // VALUES_A_PART).bit_length()))


def _code(x: np.ndarray, bits: int) -> np.ndarray:
    """The lowest `bits` bits of the code of each number of x."""
    out = np.zeros(len(x), np.uint32)
    for i in range(8):
        out ^= _CODES[i][((x >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64)]
    return out & np.uint32((1 << bits) - 1)


def _values(base: np.ndarray, masks: np.ndarray, turn: int, turn_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, indices into base) of all base ^ mask whose code is `turn`, in pieces. Only these are made."""
    if not turn_bits:
        step = max(1, (1 << 19) // len(masks))
        for at in range(0, len(base), step):
            some = base[at : at + step]
            yield (some[:, None] ^ masks).ravel(), np.repeat(np.arange(at, at + len(some)), len(masks))
        return
    codes = _code(masks, turn_bits)
    by = np.argsort(codes, kind="stable")
    masks, codes = masks[by], codes[by]
    wanted = _code(base, turn_bits) ^ np.uint32(turn)
    first = np.searchsorted(codes, wanted)
    counts = np.searchsorted(codes, wanted, side="right") - first
    cuts = np.searchsorted(np.cumsum(counts), np.arange(1 << 19, counts.sum() + (1 << 19), 1 << 19))
    for at, to in zip([0, *(cuts[:-1] + 1)], cuts + 1):
        n = counts[at:to]
        owner = np.repeat(np.arange(at, at + len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
        yield base[owner] ^ masks[place], owner


def meet(fps: np.ndarray, part: int, part_bits: int, radius: int, turn: int = 0, turn_bits: int = 0) -> tuple[np.ndarray, int]:
    """Pairs (rows of indices into fps) that share a value with the leading part, each with the least of those that share it, and how many values were made.

    All that share a value are within 2 * radius of one another, so a link from each to the least joins them without
    all pairs. Values are compared by the leading bits of a mix, and pairs are then verified. With turn_bits, only the
    values whose code is `turn` are made and compared.
    """
    low = BITS - part_bits
    order = np.argsort(fps)
    fps = fps[order]
    away = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(part))
    index_bits = np.uint64(max(1, int(len(fps) - 1).bit_length()))
    keys = []
    for flips in range(radius + 1):
        own = np.flatnonzero(away == flips)
        base = (np.uint64(part) << np.uint64(low)) | (fps[own] & np.uint64((1 << low) - 1))
        for values, owner in _values(base, _masks(low, radius - flips), turn, turn_bits):
            mixed = values * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            keys.append((mixed >> index_bits << index_bits) | own[owner].astype(np.uint64))
    keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    keys.sort()
    values, who = keys >> index_bits, (keys & ((np.uint64(1) << index_bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    meets = np.flatnonzero(~new)
    near = np.bitwise_count(fps[who[first[meets]]] ^ fps[who[meets]]) <= 2 * radius
    pairs = [(who[first[meets[near]]] << 32) | who[meets[near]]]
    # where two values have one mix, who shares which is found by comparing all of them, a handful
    for head in np.unique(first[meets[~near]]):
        some = np.unique(who[head : head + np.searchsorted(values[head:], values[head], side="right")])
        a, b = np.triu_indices(len(some), 1)
        close = np.bitwise_count(fps[some[a]] ^ fps[some[b]]) <= 2 * radius
        pairs.append((some[a[close]] << 32) | some[b[close]])
    pairs = np.unique(np.concatenate(pairs))
    return np.stack([order[pairs >> 32], order[pairs & 0xFFFFFFFF]], 1), len(keys)


def _wide(nodes: DataFrame, part_bits: int, radius: int, values: int) -> DataFrame:
    """(part, turn_bits) of the leading parts with more than `values` values."""
    own = nodes.groupBy(F.shiftrightunsigned("fp", BITS - part_bits).alias("lead")).agg(F.count("*").alias("n"))
    touched = F.array(*[F.struct(F.lit(int(m)).cast("long").alias("m"), F.lit(len(_masks(BITS - part_bits, radius - int(m).bit_count()))).alias("ball")) for m in _masks(part_bits, radius)])
    total = own.select("lead", "n", F.explode(touched).alias("t")).groupBy(F.col("lead").bitwiseXOR(F.col("t.m")).alias("part")).agg(F.sum(F.col("n") * F.col("t.ball")).alias("total"))
    return total.where(F.col("total") > values).select("part", F.ceil(F.log2(F.col("total") / values)).cast("int").alias("turn_bits"))


def _dealt(wide: DataFrame, part_bits: int, radius: int) -> DataFrame:
    """wide (node, fp, part, turn_bits) with a turn: each fingerprint for the turns in which it has values, 2,081 at most."""
    low = BITS - part_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, parts, bits = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            away = np.bitwise_count((fps >> np.uint64(low)) ^ parts)
            for k in np.unique(bits):
                for flips in range(radius + 1):
                    own = np.flatnonzero((away == flips) & (bits == k))
                    codes = np.unique(_code(_masks(low, radius - flips), int(k)))
                    for at in range(0, len(own), max(1, (1 << 18) // len(codes))):
                        some = own[at : at + max(1, (1 << 18) // len(codes))]
                        base = (parts[some] << np.uint64(low)) | (fps[some] & np.uint64((1 << low) - 1))
                        turns = (_code(base, int(k))[:, None] ^ codes).ravel().astype(np.int64)
                        rows = batch.take(pa.array(np.repeat(some, len(codes))))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(turns)], names=["node", "fp", "part", "turn_bits", "turn"])

    return wide.mapInArrow(run, "node long, fp long, part long, turn_bits int, turn long")


def links(nodes: DataFrame, part_bits: int, radius: int = RADIUS, values: int = 4 * VALUES_A_PART) -> DataFrame:
    """(a, b): links between the nodes (node, fp; distinct fp) whose fingerprints differ in up to `radius` bits, enough of them to join whoever is linked.

    A part with over `values` values is dealt over several tasks by a linear code of its values, and a task makes no
    others than its own: all tasks together make 2,081 values for each fingerprint, however many there are.
    """
    half = radius // 2
    touched = F.array(*[F.lit(int(m)).cast("long") for m in _masks(part_bits, half)])
    lead = F.shiftrightunsigned("fp", BITS - part_bits)
    parts = nodes.select("node", "fp", F.explode(F.transform(touched, lambda m: lead.bitwiseXOR(m))).alias("part"))
    wide = common.cut_lineage(_wide(nodes, part_bits, half, values))
    n_wide = wide.count()
    if n_wide:
        marked = parts.join(F.broadcast(wide) if n_wide <= BROADCAST_ROWS else wide, "part", "left").select("node", "fp", "part", "turn_bits")
        narrow = marked.where("turn_bits IS NULL").select("node", "fp", "part", F.lit(0).alias("turn_bits"), F.lit(0).cast("long").alias("turn"))
        parts = narrow.unionByName(_dealt(marked.where("turn_bits IS NOT NULL"), part_bits, half))
    else:
        parts = parts.select("node", "fp", "part", F.lit(0).alias("turn_bits"), F.lit(0).cast("long").alias("turn"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, fps = rows.column("node").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
        pairs, _ = meet(fps, key[0].as_py(), part_bits, half, key[1].as_py(), key[2].as_py())
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return parts.groupBy("part", "turn", "turn_bits").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    Null and empty texts have the fingerprint 0 and are linked like any other. Repeated rows stay. Other columns are
    not read. An empty table gives no rows. component_id: the least doc_id reachable over links, the row's own
    included; rows without a doc_id are linked, but never the least unless no other is.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius is 2 or 4")
    fps = common.cut_lineage(fingerprints(docs))
    nodes = common.cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = links(nodes.select(F.col("fp").alias("node"), "fp"), part_bits(nodes.count()), radius)
    linked = common.cut_lineage(components(edges).withColumnRenamed("node", "fp").join(nodes.select("fp", "least"), "fp"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    linked = common.salted_join(linked, ids, ["component"], ["fp"], "nodes").select("fp", "component_id")
    # only fingerprints of several rows, or with links, lead to another id than the row's own
    known = nodes.join(linked.withColumn("linked", F.lit(True)), "fp", "left").where("n > 1 OR linked").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = common.salted_join(fps, known, ["fp"], ["doc_id"], "n", "left")
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")
