"""Removal of long repeated byte strings by suffix sorting with a difference cover.

Sorting every suffix of a corpus moves many times its size. Here a shuffle first brings together what can be equal:
every string of `width` bytes has a leading gram, the one with the least hash among its grams of GRAM bytes, and equal
strings have equal ones. Runs of starts with the same leading gram form a site, whose context is all bytes that its
strings cover. Grams that occur at one site only are done. The distinct contexts of the others are dealt by gram, and
each task sorts their suffixes by the difference cover modulo 3: it sorts the triples at sampled positions, recurs on
their names, merges the remaining suffixes and compares adjacent prefixes of `width` bytes.

A gram with very many distinct contexts is not left to one task. Its contexts are cut into blocks of starts at which the
gram has about the same offset, and the bytes that all strings of a block share are the key under which blocks meet.
What then still has many different blocks is cut once more, into single strings, which are counted by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

WIDTH = 400
#: Bytes of context that are sorted at once.
SORT_BYTES = 1 << 20
#: Tables of up to so many numbers of 8 bytes at most, in their rows and arrays, are broadcast; larger ones are joined by a shuffle.
BROADCAST_NUMBERS = 8_000_000
#: Distinct contexts above which a gram is not sorted in one task but cut into blocks of starts, and starts of a block.
WIDE = 250
BLOCK = 32
#: A gram's place takes this many of the low bits of what grams are compared by, whatever the batch's length.
_PLACE_BITS = np.uint64(32)
_FACTOR = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (numbers above 0) in order, by the difference cover modulo 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    k = int(s.max()) + 1
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # with n % 3 == 1, a sampled position past the end keeps the two halves apart
    cover = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    ones = len(np.arange(1, n + (n % 3 == 1), 3))
    triples = _joined(_joined(s[cover], s[cover + 1], k), s[cover + 2], k)
    values, names = np.unique(triples, return_inverse=True)
    names = names.reshape(-1).astype(np.int64) + 1
    if len(values) < len(cover):
        order = suffix_array(names)
        names = np.empty(len(cover), np.int64)
        names[order] = np.arange(1, len(cover) + 1)
    else:
        order = np.empty(len(cover), np.int64)
        order[names - 1] = np.arange(len(cover))
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = names
    sampled = cover[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    top = len(cover) + 1
    of_rest = _joined(s[rest], rank[rest + 1], top)
    by = np.argsort(of_rest, kind="stable")
    rest, of_rest = rest[by], of_rest[by]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(_joined(s[one], rank[one + 1], top), of_rest)
    pairs_two, pairs_rest = s[two] * k + s[two + 1], s[rest] * k + s[rest + 1]
    if k * k * top >= 1 << 62:
        _, both = np.unique(np.concatenate([pairs_two, pairs_rest]), return_inverse=True)
        pairs_two, pairs_rest = both.reshape(-1)[: len(two)], both.reshape(-1)[len(two) :]
    before += np.searchsorted(_joined(pairs_two, rank[two + 2], top), _joined(pairs_rest, rank[rest + 2], top))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = rest
    out[free] = sampled
    return out


def _joined(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """A number for each pair (a, b), b < k, in the pairs' order."""
    if len(a) and int(a.max()) >= (1 << 62) // k:
        a = np.unique(a, return_inverse=True)[1].reshape(-1).astype(np.int64)
    return a * k + b


def repeated_starts(contexts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its starts (those with width bytes after them) begin a string that begins at another start too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.zeros(len(text), bool)
    for b, n in zip(begins, sizes):
        start[b : b + max(0, n - width + 1)] = True
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[start[order]]
    prefixes = np.lib.stride_tricks.sliding_window_view(text, width) if len(text) >= width else np.empty((0, width), np.uint8)
    found = np.zeros(len(text), bool)
    for at in range(0, len(order) - 1, 4096):
        p, q = order[at : at + 4096], order[at + 1 : at + 4097]
        p = p[: len(q)]
        # most neighbours differ early
        same = np.flatnonzero((prefixes[p, :16] == prefixes[q, :16]).all(1))
        same = same[(prefixes[p[same]] == prefixes[q[same]]).all(1)]
        found[p[same]] = True
        found[q[same]] = True
    return [found[b : b + max(0, n - width + 1)] for b, n in zip(begins, sizes)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _gram_hashes(raw: np.ndarray, size: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * powers[0][: len(raw)], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * powers[1][: len(raw) - size + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(x: np.ndarray, window: int) -> np.ndarray:
    n = len(x) - window + 1
    padded = np.concatenate([x, np.full(-len(x) % window, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, window)
    down = np.minimum.accumulate(padded, axis=1).ravel()
    up = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[window - 1 : window - 1 + n])


class SiteFinder:
    """Sites of texts: runs of starts with the same leading gram."""

    def __init__(self, width: int = WIDTH):
        self.width, self.gram = width, width // 2
        self._powers = _powers(1)

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text's number, key, context's hash, first start, starts, gram's place after the first start)."""
        joined = b"".join(texts)
        width, gram = self.width, self.gram
        if len(joined) < width:
            return
        raw = np.frombuffer(joined, np.uint8)
        if len(self._powers[0]) < len(raw):
            self._powers = _powers(max(len(raw), common.GROUP_BYTES))
        hashes = _gram_hashes(raw, gram, self._powers)
        places = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        owner = (_sliding_least(places, width - gram + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        begin = 0
        for number, text in enumerate(texts):
            starts = len(text) - width + 1
            if starts > 0:
                own = owner[begin : begin + starts]
                cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [starts]])
                firsts = cuts[:-1]
                keys = hashes[own[firsts]].view(np.int64)
                rel = own[firsts] - begin - firsts
                for first, end, key, r in zip(firsts.tolist(), cuts[1:].tolist(), keys.tolist(), rel.tolist()):
                    yield number, key, xxhash.xxh64_intdigest(text[first : end - 1 + width], r), first, end - first, r
            begin += len(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def sites(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, tid, key, ctx, first, starts, rel) of docs (doc_id, tid, text); tid tells apart rows with the same doc_id."""
    names = ["doc_id", "tid", "key", "ctx", "first", "starts", "rel"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = SiteFinder(width)
        for batch in batches:
            for some in common.groups(batch, 2):
                ids, tids = some.column(0).to_pylist(), some.column(1).to_pylist()
                rows = [(ids[i], tids[i], key, _signed(ctx), first, n, rel) for i, key, ctx, first, n, rel in find(common.as_bytes(some.column(2)))]
                for at in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000]), types)], names=names)

    return docs.select("doc_id", "tid", "text").mapInArrow(run, "doc_id long, tid long, key long, ctx long, first int, starts int, rel int")


_CONTEXT = [("key", pa.int64()), ("ctx", pa.int64()), ("m", pa.int64()), ("starts", pa.int32()), ("rel", pa.int32()), ("bytes", pa.binary())]


def _batches(rows: list[tuple], columns: list[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    names, types = zip(*columns)
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size]), types)], names=names)


def _contexts(docs: DataFrame, wanted: DataFrame, width: int, small: bool) -> DataFrame:
    """(key, ctx, m, starts, rel, bytes) of the sites in wanted (doc_id, tid, list of (key, ctx, m, first, starts, rel))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch, 0):
                rows = [
                    (s["key"], s["ctx"], s["m"], s["starts"], s["rel"], text[s["first"] : s["first"] + s["starts"] - 1 + width])
                    for text, found in zip(common.as_bytes(some.column(0)), some.column(1).to_pylist())
                    for s in found
                ]
                yield from _batches(rows, _CONTEXT)

    texts = docs.join(F.broadcast(wanted) if small else wanted, ["doc_id", "tid"]).select("text", "list")
    return texts.mapInArrow(run, "key long, ctx long, m long, starts int, rel int, bytes binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorted_runs(contexts: DataFrame, width: int) -> DataFrame:
    """(key, ctx, m, lo, hi): runs [lo, hi) of repeated starts of each of contexts. Contexts of a key are sorted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rows = []
            found = repeated_starts([b for _, b in held.values()], width)
            for (key, ctx), (m, _), flags in zip(held, held.values(), found):
                rows += [(key, ctx, m, lo, hi) for lo, hi in ([(0, len(flags))] if m > 1 else _runs(flags))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "ctx", "m", "lo", "hi"])

        for batch in batches:
            for key, ctx, m, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != last and size >= SORT_BYTES:
                    yield flush()
                    size = 0
                last = key
                if (key, ctx) not in held:
                    held[key, ctx] = m, text
                    size += len(text)
        if held:
            yield flush()

    return contexts.select("key", "ctx", "m", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, ctx long, m long, lo int, hi int")


def _cut(contexts: DataFrame, width: int, block: int) -> DataFrame:
    """(key, ctx, m, lo, key2, ctx2, starts, rel, bytes): contexts in pieces of up to `block` starts, from lo on.

    Pieces end where the gram's offset in a string is a multiple of block, so equal strings are in pieces with one key2,
    the hash of what all strings of such a piece share. ctx2 is the piece's own hash. For single strings these two are
    128 bits of the string, and bytes is left out.
    """
    columns = [("key", pa.int64()), ("ctx", pa.int64()), ("m", pa.int64()), ("lo", pa.int32()), ("key2", pa.int64()), ("ctx2", pa.int64()), ("starts", pa.int32()), ("rel", pa.int32()), ("bytes", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for key, ctx, m, starts, rel, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                lo = 0
                while lo < starts:
                    offset = rel - lo  # the gram's, in the string that starts at lo
                    least = offset // block * block
                    n = min(offset - least + 1, starts - lo)
                    piece = text[lo : lo + n - 1 + width]
                    if block == 1:
                        both = xxhash.xxh3_128_intdigest(piece)
                        rows.append((key, ctx, m, lo, _signed(both >> 64), _signed(both & (1 << 64) - 1), 1, 0, None))
                    else:
                        # shared by the strings whose gram is at least .. least + block - 1
                        shared = text[rel - least : rel - least - block + 1 + width]
                        rows.append((key, ctx, m, lo, _signed(xxhash.xxh64_intdigest(shared, key & 0xFFFFFFFF ^ least)), _signed(xxhash.xxh64_intdigest(piece, offset)), n, offset, piece))
                    lo += n
                if len(rows) >= 2000:
                    yield from _batches(rows, columns)
                    rows.clear()
        yield from _batches(rows, columns)

    kept = contexts.select("key", "ctx", "m", "starts", "rel", "bytes")
    return kept.mapInArrow(run, "key long, ctx long, m long, lo int, key2 long, ctx2 long, starts int, rel int, bytes binary")


def _cut_runs(contexts: DataFrame, width: int, wide: int, block: int) -> DataFrame:
    """(key, ctx, m, lo, hi) as _sorted_runs(), of contexts of grams that have too many of them for one task."""
    parts = common.cut_lineage(_cut(contexts, width, block))
    one = [F.first(c).alias(c) for c in ("starts", "rel", "bytes")[: 3 if block > 1 else 1]]
    shared = common.cut_lineage(parts.groupBy("key2", "ctx2").agg(F.sum("m").alias("m"), F.count("*").alias("rows"), *one))
    if block == 1:
        runs = shared.where("m > 1").select(F.col("key2").alias("key"), F.col("ctx2").alias("ctx"), "m", F.lit(0).alias("lo"), F.col("starts").alias("hi"))
    else:
        sizes = shared.groupBy("key2").agg(F.count("*").alias("d"), F.sum("m").alias("n")).where("n > 1").withColumn("w", F.col("d"))
        met = common.cut_lineage(common.salted_join(shared.drop("rows"), sizes, ["key2"], ["ctx2"], "w").withColumnsRenamed({"key2": "key", "ctx2": "ctx"}))
        runs = met.where("d = 1").select("key", "ctx", "m", F.lit(0).alias("lo"), F.col("starts").alias("hi"))
        runs = runs.unionByName(_sorted_runs(met.where(F.col("d").between(2, wide)), width))
        if met.where(F.col("d") > wide).limit(1).count():
            runs = runs.unionByName(_cut_runs(met.where(F.col("d") > wide), width, wide, 1))
    named = _runs_by_context(runs).select(F.col("key").alias("key2"), F.col("ctx").alias("ctx2"), "runs").join(shared.select("key2", "ctx2", "rows"), ["key2", "ctx2"])
    hits = common.salted_join(parts.select("key", "ctx", "m", "lo", "key2", "ctx2"), named, ["key2", "ctx2"], ["key", "ctx"], "rows")
    hits = hits.select("key", "ctx", "m", "lo", F.explode("runs").alias("r"))
    return hits.select("key", "ctx", "m", (F.col("lo") + F.col("r.lo")).alias("lo"), (F.col("lo") + F.col("r.hi")).alias("hi"))


def _disjoint(los: list[int], his: list[int]) -> list[int]:
    """The bounds of the runs that these runs make up, those that touch joined."""
    out: list[int] = []
    for lo, hi in sorted(zip(los, his)):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def _merged(covered: DataFrame) -> DataFrame:
    """(doc_id, tid, spans) of covered (doc_id, tid, lo, hi); spans: the bounds of disjoint runs, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_disjoint(los, his) for los, his in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "tid", "spans"])

    each = covered.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("x")).select("doc_id", "tid", "x.lo", "x.hi")
    return each.mapInArrow(run, "doc_id long, tid long, spans array<int>")


def _numbers(rows: DataFrame, column: str, each: int) -> int:
    """How many numbers are in rows, with `each` in an element of its array."""
    return rows.agg(F.sum(F.size(column) * each + 4)).first()[0] or 0


def _runs_by_context(runs: DataFrame) -> DataFrame:
    """(key, ctx, m, runs): the runs of a context as an array of disjoint ones, those that touch joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for los, his in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                bounds = _disjoint(los, his)
                merged.append([{"lo": a, "hi": b} for a, b in zip(bounds[::2], bounds[1::2])])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(merged, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["key", "ctx", "m", "runs"])

    each = runs.groupBy("key", "ctx").agg(F.max("m").alias("m"), F.collect_list(F.struct("lo", "hi")).alias("x")).select("key", "ctx", "m", "x.lo", "x.hi")
    return each.mapInArrow(run, "key long, ctx long, m long, runs array<struct<lo:int,hi:int>>")


def repeated_spans(docs: DataFrame, width: int = WIDTH, wide: int = WIDE, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """(doc_id, tid, spans) of the rows of docs (doc_id, tid, text) with bytes that repeated strings cover."""
    all_sites = sites(docs, width)  # found twice: that costs less than to write and read them
    keys = all_sites.groupBy("key").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("n > 1")
    keys = common.cut_lineage(keys)
    few = 3 * keys.count() <= broadcast_numbers
    met = all_sites.join(F.broadcast(keys), "key") if few else common.salted_join(all_sites, keys.withColumn("w", F.col("n")), ["key"], ["doc_id", "first"], "w")
    met = common.cut_lineage(met)
    end = F.lit(width - 1)
    alike = met.where("NOT mixed").select("doc_id", "tid", F.col("first").alias("lo"), (F.col("first") + F.col("starts") + end).alias("hi"))
    mixed = met.where("mixed")
    one = F.min(F.struct("doc_id", "tid", "first", "starts", "rel")).alias("one")
    distinct = common.cut_lineage(mixed.groupBy("key", "ctx").agg(F.count("*").alias("m"), one).select("key", "ctx", "m", "one.*"))
    many = common.cut_lineage(distinct.groupBy("key").agg(F.count("*").alias("d")).where(F.col("d") > wide))  # under a part in `wide` of the contexts
    n_many = many.count()

    def contexts(some: DataFrame) -> DataFrame:
        item = F.struct("key", "ctx", "m", "first", "starts", "rel")
        by_doc = common.cut_lineage(some.groupBy("doc_id", "tid").agg(F.collect_list(item).alias("list")))
        return _contexts(docs, by_doc, width, _numbers(by_doc, "list", 6) <= broadcast_numbers)

    if n_many:
        small = 2 * n_many <= broadcast_numbers
        marked = distinct.join(F.broadcast(many), "key", "left") if small else common.salted_join(distinct, many.withColumn("w", F.col("d")), ["key"], ["ctx"], "w", "left")
        marked = common.cut_lineage(marked)
        runs = _sorted_runs(contexts(marked.where("d IS NULL")), width).unionByName(_cut_runs(contexts(marked.where("d IS NOT NULL")), width, wide, block))
    else:
        runs = _sorted_runs(contexts(distinct), width)
    hits = common.salted_join(mixed, _runs_by_context(runs), ["key", "ctx"], ["doc_id", "first"], "m").select("doc_id", "tid", "first", F.explode("runs").alias("r"))
    hits = hits.select("doc_id", "tid", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi") + end).alias("hi"))
    return _merged(alike.unionByName(hits))


def deduplicate(docs: DataFrame, width: int = WIDTH, wide: int = WIDE, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, kept) for each row of docs (doc_id, text).

    A byte is removed if a string of `width` bytes covers it that starts anywhere else too, in the same text or
    another, judged on the input. A null text counts as empty; texts under `width` bytes stay whole. Repeated rows are
    texts of their own, so each has its bytes removed; so are rows without a doc_id. Other columns are not read. An empty table gives no rows.
    text: what remains, without the bytes of a character that was cut in two; kept: the remaining bytes as they are,
    only with with_bytes.
    """
    # a row without a doc_id is a document of its own among those that have none
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("no id"), text_key())).otherwise(text_key())
    docs = docs.select(F.col("doc_id").alias("given"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), own.alias("tid"), "text")
    spans = common.cut_lineage(repeated_spans(docs.select("doc_id", "tid", "text"), width, wide, block, broadcast_numbers))
    few = _numbers(spans, "spans", 1) <= broadcast_numbers
    joined = docs.join(F.broadcast(spans) if few else spans, ["doc_id", "tid"], "left").select(F.col("given").alias("doc_id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch):
                rows = []
                for text, bounds in zip(common.as_bytes(some.column(1)), some.column(2).to_pylist()):
                    bounds = bounds or []
                    edges = [0, *bounds, len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if bounds else text
                    rows.append((len(text), len(text) - len(kept), len(bounds) // 2, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore"), kept)[: len(names) - 1])
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "kept"][: 6 + with_bytes]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" + ", kept binary" * with_bytes)
