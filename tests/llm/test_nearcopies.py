import random
import re

import numpy as np

import corpus_pipeline
from weftlink.llm import nearcopies


def plain_shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower()) or (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts, similarity=0.8):
    sets = [plain_shingles(t) for t in texts]
    near = [[j for j, b in enumerate(sets) if a == b or len(a & b) >= similarity * len(a | b)] for a in sets]
    least, changed = list(range(len(texts))), True
    while changed:
        now = [min(least[j] for j in x) for x in near]
        least, changed = now, now != least
    return least


def edited(text, rng, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def near_texts(prose):
    rng = random.Random(4)
    texts = []
    for i in range(40):
        base = prose(i, 200)
        texts += [base, edited(base, rng, rng.choice([1, 2, 3, 4])), edited(base, rng, 12)]
    return texts + [edited(prose(99, 200), rng, 2) for _ in range(60)]


def test_as_brute_force(spark, docs, prose):
    texts = [*near_texts(prose), "", None, " \n", "!!!", "???", "One", "one.", "one two three", "ONE, two\tthree", prose(3, 9000)]
    rows = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == plain_components(texts)


def test_the_stage_keeps_one_of_similar_texts(spark, docs, prose):
    texts = near_texts(prose)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs(texts), "").collect())
    assert kept == sorted(set(plain_components(texts)))


def test_empty_table_and_repeated_rows(spark, docs):
    assert nearcopies.near_copies(docs([])).collect() == []
    rows = nearcopies.near_copies(docs(["a b", "x y"]).union(docs(["a b"]))).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (0, 0), (1, 1)]


def test_many_ids_are_not_broadcast(spark, docs, prose, monkeypatch):
    texts = [*near_texts(prose), "", None, "One", "one."]
    rows = docs(texts).union(docs(texts[:3])).union(spark.createDataFrame([(None, texts[0], "en", "src0", 1)], docs([]).schema))
    expected = sorted(map(tuple, nearcopies.near_copies(rows).collect()), key=str)
    sent = []
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(nearcopies.F, "broadcast", lambda df: (sent.append((df.columns, df.count())), df)[1])
    assert sorted(map(tuple, nearcopies.near_copies(rows).collect()), key=str) == expected
    assert any("_bits" in columns for columns, _ in sent)  # a row for each 32,768 bits, whatever the ids
    assert all(n <= 5 for columns, n in sent if "node" in columns or "id" in columns or "_bits" in columns)


def crowd(prose):
    """Texts that share buckets with hundreds of others, dissimilar, and are similar to one of them."""
    rng = random.Random(9)
    base, texts = prose(77, 200), []
    for _ in range(160):
        texts.append(edited(base, rng, 4))
        texts.append(edited(texts[-1], rng, 4))
    return texts


def test_no_pair_of_a_large_bucket_is_left_out(spark, docs, prose):
    texts = crowd(prose)
    expected = plain_components(texts)
    assert 50 < sum(i != x for i, x in enumerate(expected)) < 310
    rows = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == expected


def test_blocks_and_bounds_that_are_too_high(spark, docs, prose, monkeypatch):
    texts = crowd(prose)[:120]
    expected = plain_components(texts)
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    monkeypatch.setattr(nearcopies, "short", lambda some: np.sort((some >> np.uint64(58)).astype(np.uint32)).tobytes())  # six bits tell little
    rows = {r.doc_id: r.component_id for r in nearcopies.near_copies(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == expected


def test_the_bound_is_never_below_the_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, np.uint64)
    sets = [np.unique(rng.choice(base, 150 + 10 * i)) for i in range(20)]
    sets = [np.unique(np.concatenate([s, s[:40] ^ np.uint64(1)])) for s in sets]  # equal in their leading bits
    i, j, bound = nearcopies.may_be_similar([nearcopies.short(s) for s in sets], list(range(20)), 0.0)
    assert len(i) == 190
    for a, b, most in zip(i, j, bound):
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert most >= shared / (len(sets[a]) + len(sets[b]) - shared) - 1e-6
