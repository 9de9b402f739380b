"""Packing of token sequences into training windows by the sum-of-squares rule.

Each document goes to the fill level that makes the sum, over all levels, of the squared number of windows at
that level smallest. The counts stand in one array by level, so placing costs one pass over that array.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftlink.llm import common

CAPACITY = 4096
END_ID = 2
#: Bytes of ids of open windows that a task holds in memory; what exceeds them lies in a file of the task's own.
HELD_BYTES = 64 << 20
#: Words whose ids a worker keeps in each of two generations.
CACHED_WORDS = 200_000
CACHED_CHARS = 64
#: Texts are encoded in groups of about this many bytes; what a worker needs for that is some 30 times as much.
ENCODED_BYTES = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    Only for tokenizers that take ASCII capitals as small letters, and whose pre-tokenizer drops white space and never
    joins what it parts: then the ids of a text are those of its parts between blanks, one after the other, and a
    part's ids can be kept. Two generations of parts are kept: a full one becomes the old one, of which those still
    met are taken over.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._cached = cached
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of words, which are distinct."""
        known, old = self._known, self._old
        out = [known.get(w) for w in words]
        new: dict[str, bytes] = {}
        unknown = []
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = old.get(w)
                if out[i] is None:
                    unknown.append(i)
                else:
                    new[w] = out[i]
        for i, e in zip(unknown, self._tokenizer.encode_batch([words[i] for i in unknown], add_special_tokens=False) if unknown else ()):
            out[i] = array("I", e.ids).tobytes()
            if len(words[i]) <= CACHED_CHARS:
                new[words[i]] = out[i]
        if len(known) + len(new) > self._cached:
            self._old, self._known = known, {}
        self._known.update(new)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and where in them each text begins and the last ends. A null has none."""
        plain = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
        # a comma or full stop that ends a word is a part of its own: so fewer words differ
        split = pc.split_pattern(pc.replace_substring_regex(plain, r"([a-z])([.,]) ", r"\1 \2 "), " ")
        words = split.flatten().dictionary_encode()
        ids = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), "<u4")
        which = words.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], lengths)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        return flat[places], ends[bounds]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The process's tokenizer for path: a worker meets the same words in one task after the other."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class _Ids:
    """Ids of pieces in open windows: in memory up to a bound, the others in a file that goes with the task."""

    def __init__(self, held_bytes: int):
        self._left, self._file, self._size = held_bytes, None, 0

    def put(self, ids: np.ndarray) -> np.ndarray | tuple[int, int]:
        if ids.nbytes <= self._left:
            self._left -= ids.nbytes
            return ids.copy()  # a slice would hold the ids of a whole batch
        if self._file is None:
            self._file = tempfile.TemporaryFile()
        self._file.seek(self._size)
        self._file.write(ids.tobytes())
        self._size += ids.nbytes
        return self._size - ids.nbytes, ids.nbytes

    def free(self, held: np.ndarray | tuple[int, int]) -> None:
        if isinstance(held, np.ndarray):
            self._left += held.nbytes

    def get(self, held: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(held, np.ndarray):
            return held
        self._file.seek(held[0])
        return np.frombuffer(self._file.read(held[1]), "<u4")


class SumOfSquaresPacker:
    """Windows of `capacity` ids. close() is given each one as a list of pieces (doc, start, length, crc32 of the ids, doc's length)."""

    def __init__(self, close: Callable[[list], None], capacity: int = CAPACITY, held_bytes: int = HELD_BYTES):
        self.capacity, self._close = capacity, close
        self.counts = np.zeros(capacity + 1, np.int64)
        self._windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self._ids = _Ids(held_bytes)

    def level_for(self, size: int) -> int:
        """The level whose choice leaves the smallest sum of squares; the fullest of equals; 0: a new window."""
        n, c = self.counts, self.capacity
        cost = 2 * (n[size:] - n[: c - size + 1]) + 2
        cost[0] = 2 * n[size] + 1 if size < c else 0
        if size < c:
            cost[-1] = 1 - 2 * n[c - size]
        cost[1:][n[1 : c - size + 1] == 0] = np.iinfo(np.int64).max
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        level = self.level_for(len(ids))
        window = []
        if level:
            window = self._windows[level].pop()
            self.counts[level] -= 1
        window.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self._ids.put(ids)))
        level += len(ids)
        if level < self.capacity:
            self._windows[level].append(window)
            self.counts[level] += 1
            return
        for piece in window:
            self._ids.free(piece[5])
        self._close([piece[:5] for piece in window])

    def add(self, doc, ids: np.ndarray) -> None:
        """A whole document; what exceeds a window is cut off in full windows first."""
        full = len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            self._close([(doc, at, self.capacity, zlib.crc32(ids[at : at + self.capacity].tobytes()), len(ids))])
        if full < len(ids):
            self.place(doc, full, ids[full:], len(ids))

    def finish(self) -> None:
        """Ends the stream: the open windows are emptied into full ones, fullest first, by cutting where a window ends.

        The last window is cut into sequences whose lengths are powers of two, which need no padding.
        """
        left = sum(int(n) * level for level, n in enumerate(self.counts))
        window, room = [], 0
        for level in range(self.capacity - 1, 0, -1):
            for doc, start, _, _, total, held in (p for w in self._windows[level] for p in w):
                ids = self._ids.get(held)
                while len(ids):
                    if not room:
                        room = min(self.capacity, 1 << (left.bit_length() - 1))
                    taken = ids[:room]
                    window.append((doc, start, len(taken), zlib.crc32(taken.tobytes()), total))
                    start, ids, room, left = start + len(taken), ids[len(taken) :], room - len(taken), left - len(taken)
                    if not room:
                        self._close(window)
                        window = []
            self._windows[level] = []
        self.counts[:] = 0


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    columns = zip(*out) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, held_bytes: int = HELD_BYTES) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text).

    Every input partition is packed by itself in one pass without a shuffle, so its windows depend on nothing but
    its rows. A null or empty text is the single id end_id. Repeated rows are packed as often as they occur. Other
    columns are not read. An empty table gives no rows. Of levels with one cost the fullest is taken. sequence_id: the partition's number times 2**32, plus the
    window's number in it.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        base, made, out = TaskContext.get().partitionId() << 32, [0], []

        def close(window: list) -> None:
            offset = 0
            for doc, start, length, crc, total in window:
                out.append((doc, start, length, crc, total, base + made[0], offset))
                offset += length
            made[0] += 1

        packer = SumOfSquaresPacker(close, capacity, held_bytes)
        last = np.array([end_id], "<u4")
        for batch in batches:
            for some in common.groups(batch, limit=ENCODED_BYTES):
                ids, bounds = tokenizer.encode(some.column(1))
                bounds = bounds.tolist()
                for doc, a, b in zip(some.column(0).to_pylist(), bounds, bounds[1:]):
                    packer.add(doc, np.concatenate([ids[a:b], last]))
                yield _rows(out)
                out.clear()
        packer.finish()
        yield _rows(out)
        out.clear()
        common.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
