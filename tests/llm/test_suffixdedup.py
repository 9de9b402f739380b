import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftlink.llm import suffixdedup


def plain(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in raw for i in range(len(t) - width + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(prose):
    rng = random.Random(4)
    texts = [prose(i, 120) for i in range(25)]
    for i in range(25):
        a, b = rng.choice(texts[:25]), rng.choice(texts[:25])
        x, y = rng.randrange(len(a) - 50), rng.randrange(len(b) - 50)
        texts.append(prose(100 + i, 20) + a[x : x + rng.randrange(30, 600)] + prose(200 + i, 5) + b[y : y + rng.randrange(30, 600)])
    texts += [texts[0], texts[0], "Der " * 400, "ab" * 333, "Der " * 90 + prose(1, 30), None, "", "x", "é" * 500, "é" * 20, "z" * 99, "z" * 100, "z" * 101, prose(77, 4000), "q" + prose(77, 4000)]
    return texts


@pytest.mark.parametrize("width, wide, block, broadcast_numbers", [(100, 250, 32, 500_000), (100, 2, 8, 500_000), (100, 1, 7, 0), (60, 250, 32, 0), (400, 250, 32, 500_000)])
def test_as_brute_force(spark, docs, prose, width, wide, block, broadcast_numbers):
    texts = corpus(prose)
    rows = sorted(suffixdedup.deduplicate(docs(texts).withColumnRenamed("source", "key").repartition(3), width, wide, block, broadcast_numbers, with_bytes=True).collect())
    assert [tuple(r)[1:5] for r in rows] == plain(texts, width)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and r.text == r.kept.decode(errors="ignore") for r in rows)
    assert [r.text for r, t in zip(rows, texts) if not r.n_removed] == [t or "" for r, t in zip(rows, texts) if not r.n_removed]


def test_passages_of_many_texts(spark, docs, prose):
    passage = prose(9, 40)
    texts = [prose(1000 + i, 12) + " " + passage[i % 7 :] + " " + prose(5000 + i % 90, 9) for i in range(300)]
    for wide in (50, 1000):
        rows = sorted(suffixdedup.deduplicate(docs(texts), 100, wide, 16).collect())
        assert [tuple(r)[1:5] for r in rows] == plain(texts, 100)


def test_batches_do_not_matter(prose):
    texts = [prose(i, 300).encode() for i in range(20)]
    find = suffixdedup.SiteFinder(100)
    alone = [(i, *s[1:]) for i, t in enumerate(texts) for s in find([t])]
    assert list(find(texts)) == alone


def test_empty_table_and_repeated_rows(spark, docs, prose):
    assert suffixdedup.deduplicate(docs([])).collect() == []
    one = docs([prose(1, 200)])
    assert [r.n_removed == r.n_bytes > 400 for r in suffixdedup.deduplicate(one.union(one)).collect()] == [True, True]


def test_suffix_array():
    rng = random.Random(1)
    for n in list(range(1, 40)) + [300, 301, 302]:
        for letters in (1, 2, 5):
            s = [rng.randint(1, letters) for _ in range(n)]
            assert suffixdedup.suffix_array(np.array(s)).tolist() == sorted(range(n), key=lambda i: s[i:])
