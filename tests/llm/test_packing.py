import os
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from weftlink.llm import packing


def whole(texts):
    t = Tokenizer.from_file(packing.default_tokenizer())
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for i, x in enumerate(texts)}


def hold(rows, ids, capacity=4096):
    """Every id in exactly one piece, sequences gapless and not too long; the padding they need."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        spans[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(spans) == set(ids)
    for doc, parts in list(spans.items()) + list(sequences.items()):
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
    for doc, parts in spans.items():
        assert sum(n for _, n in parts) == len(ids[doc])
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    assert max(sizes, default=0) <= capacity
    return sum(capacity - n for n in sizes if n & (n - 1))


def test_every_id_is_packed_once(spark, docs, prose):
    texts = [prose(i, 1 + 37 * i % 900) for i in range(120)] + [None, "", " \n\t ", "a b c \x1cd é", "<|endoftext|> it's 1234", prose(7, 9000), prose(3, 50), prose(3, 50)]
    frame = docs(texts)
    assert hold(packing.pack(frame.repartition(3)).collect(), whole(texts)) == 0
    assert hold(packing.pack(frame.coalesce(1), held_bytes=9000).collect(), whole(texts)) == 0


def test_empty_table_and_odd_columns(spark, docs):
    assert packing.pack(docs([]).withColumnRenamed("source", "start")).collect() == []
    assert [r.doc_tokens for r in packing.pack(docs([None]).withColumnRenamed("source", "start")).collect()] == [1]


def test_words_are_encoded_as_the_whole_text():
    t, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer(), cached=20)
    texts = ["Hello  World\n\n new\tline", "don't we'll 42 x², 3. A,. B., c. d, e.", "ÀÉ ÎÕ é ẞ ΑΣ ΑΣ, Σ. İ", "　wide　", "a" * 300 + " b", "###*** !!! %%%", "\n", " x ", "", "E\u0301 E\u0301. e\u0301, x", "it's, that'S. 'tis", "<|endoftext|>, a<|startoftext|>. b"] * 2
    ids, bounds = words.encode(pa.array([*texts, None])[0:])
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert bounds[-1] == bounds[-2] == len(ids)


def test_level_has_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    closed = []
    packer = packing.SumOfSquaresPacker(closed.append, capacity=40)
    for size in rng.integers(1, 40, 400).tolist():
        before = packer.counts.copy()
        level = packer.level_for(size)
        costs = {}
        for h in [0, *np.flatnonzero(before[1:40]).__add__(1)]:
            if h + size > 40:
                continue
            n = before.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 40
            costs[int(h)] = int((n[1:40].astype(int) ** 2).sum())
        assert costs[level] == min(costs.values())
        packer.place(0, 0, np.zeros(size, "<u4"), size)
        assert (packer.counts == [len(w) for w in packer._windows]).all()
    assert closed


TASK = r"""
import random, re, types
import pyarrow as pa
from weftlink.llm import packing

def mb(name):
    return int(re.search(name + r":\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

words = ["".join(random.Random(i).choices("abcdefghijklmnoprstuvwz", k=3 + i % 7)) for i in range(60_000)]
rng = random.Random(1)
texts = pa.array([" ".join(rng.choices(words, k=2000)) for _ in range(1200)])
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["doc_id", "text"])
packing.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
docs = types.SimpleNamespace(select=lambda *names: docs, mapInArrow=lambda run, schema: run)
run = packing.pack(docs)
before = mb("VmRSS")
rows = sum(b.num_rows for b in run(iter([batch])))
print(rows >= 1200, round(mb("VmHWM") - before), round(mb("VmRSS") - before))
"""


def test_memory_of_a_task_does_not_follow_its_batch():
    """16 MB of text in one batch: 200 MB at most while it is packed, and 100 MB, with the words kept, when the task has ended."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", TASK], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == "True" and int(out[1]) < 200 and int(out[2]) < 100, out
