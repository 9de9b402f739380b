import random
import re

import numpy as np
import xxhash

from weftlink.llm import simhash
from weftlink.llm.components import components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """ids by brute force: {id: least reachable id}."""
    least = {i: i for i in fps}
    changed = True
    near = {i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= radius] for i in fps}
    while changed:
        changed = False
        for i in fps:
            m = min(least[j] for j in near[i])
            if m < least[i]:
                least[i], changed = m, True
    return least


def test_as_brute_force(spark, docs, prose):
    rng = random.Random(2)
    texts = []
    for i in range(40):
        base = prose(i, 300).split()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "  \n", "One", "one two three", "ONE two\x0bthree", "a b c d e", prose(3, 9000)] + [prose(99)] * 30
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs(texts).withColumnRenamed("source", "fp")).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in rows.items()} == plain_components(fps)


def test_links_of_random_balls(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randrange(8)):
                x ^= 1 << b
            fps.append(x)
    fps = dict(enumerate(dict.fromkeys(fps)))
    expected = plain_components(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    for part_bits, values in ((1, 10**9), (5, 10**9), (3, 20_000)):
        edges = simhash.links(nodes, part_bits, values=values)
        got = {r.node: r.component for r in components(edges).collect()}
        assert {i: got.get(i, i) for i in fps} == expected


def test_values_with_one_mix_are_told_apart(monkeypatch):
    # far more indices than fit beside a hash make mixes equal
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(6)]))
    pairs = set()
    for part in range(2):
        pairs |= {tuple(sorted(p)) for p in simhash.meet(fps, part, 1, 2)[0].tolist()}
    for a, b in pairs:
        assert int(fps[a] ^ fps[b]).bit_count() <= 4


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (7, 6)]
    frame = spark.createDataFrame(edges, "a long, b long")
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(600):
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {n: c for n, c in least.items() if any(n in e for e in edges if e[0] != e[1])}
    assert components(frame.limit(0)).collect() == []


def test_components_in_one_task_and_by_stars(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(60)] + [(i, i + 1) for i in range(100, 164)] + [(900, 900), (164, 100)]
    frame = spark.createDataFrame(edges, "a long, b long")
    context = spark.sparkContext
    got, jobs = [], []
    for few in (0, 10**6):
        context.setJobGroup(group := f"components-{few}", "")
        got.append(sorted(tuple(r) for r in components(frame, few_edges=few).collect()))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(group)))
    context._jsc.clearJobGroup()
    assert got[0] == got[1] and (163, 100) in got[0]
    # few edges take a few jobs, however long their paths are; a path of 64 took some 40 before
    assert jobs[1] <= 6 < jobs[0]


def test_empty_table_and_repeated_rows(spark, docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    rows = simhash.near_duplicates(docs(["a b"]).union(docs(["a b"]))).collect()
    assert [r.component_id for r in rows] == [0, 0]


def test_each_value_is_made_once():
    """The work is 2,081 values for each fingerprint, in all turns of a part together, at any number of fingerprints."""
    rng = np.random.default_rng(8)
    for n in (60, 240, 960):
        fps = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        for turn_bits in (0, 3, 12):
            made, met = 0, 0
            for part in range(4):
                low = simhash.BITS - 2
                for turn in range(1 << turn_bits):
                    if turn_bits == 12 and turn % 512:
                        continue
                    pairs, values = simhash.meet(fps, part, 2, 2, turn, turn_bits)
                    made, met = made + values, met + len(pairs)
            if turn_bits < 12:
                assert made == len(fps) * 2081
            assert low == 62 and met >= 0


def test_rows_for_the_turns_of_a_part(spark):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(40, 3, replace=False)) for _ in range(300)}
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(fps))], "node long, fp long")
    wide = nodes.selectExpr("node", "fp", f"{centre >> 60}L AS part", "4 AS turn_bits")
    dealt = simhash._dealt(wide, 4, 2)
    assert dealt.groupBy("node").count().agg({"count": "max"}).first()[0] <= 16
    seen = {(i, j) for turn in range(16) for rows in [[r.fp for r in dealt.where(f"turn = {turn}").collect()]] for a, b in simhash.meet(np.array(rows, np.uint64), centre >> 60, 4, 2, turn, 4)[0].tolist() for i, j in [tuple(sorted((rows[a], rows[b])))]}
    whole = sorted(fps)
    expected = {tuple(sorted((whole[a], whole[b]))) for a, b in simhash.meet(np.array(whole, np.uint64), centre >> 60, 4, 2)[0].tolist()}
    assert plain_components_of(seen) == plain_components_of(expected)


def plain_components_of(pairs):
    least = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least
