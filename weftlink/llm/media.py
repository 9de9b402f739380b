"""Interleaved sequences of text and media.

HTML becomes an ordered array of parts, each a text or a reference to a medium by digest, with its caption. A join by
digest resolves the references against a table of stored media.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.llm import common
from weftlink.sources.markup import Markup

ALIGN = 64
_SCHEME = "digest:"
_SILENT = frozenset(("script", "style", "template", "noscript"))
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
PART = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])


def encode(payload: bytes) -> bytes:
    """The payload as the samples of a binary grey map of 64 columns, 8 bits each."""
    return b"P5\n%d %d\n255\n" % (ALIGN, len(payload) // ALIGN) + payload


def decode(stored: bytes) -> bytes:
    """The samples of a map that encode() made."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a grey map of 8-bit samples")
    return samples


def payload_of(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % ALIGN or (0 if text else ALIGN))


def features(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and share of zero samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / max(1, counts.sum())
    levels = np.arange(256)
    mean = float(share @ levels)
    spread = float(share @ (levels - mean) ** 2) ** 0.5
    some = share[share > 0]
    return f"mean={mean:.4f};deviation={spread:.4f};entropy={abs(float(-(some * np.log2(some)).sum())):.4f};zeros={share[0]:.4f}"


def parse(page: str | None) -> list[dict]:
    """The parts of a page in order. A text part ends at block elements and at media; blank ones are left out.

    A medium is an img, video, audio or source with a src; its caption is the figcaption of the figure around it, else
    its alt or title, else null. Scripts, styles and comments give nothing.
    """
    parts: list[dict] = []
    held: list[str] = []
    figure: list[int] | None = None
    caption: list[str] | None = None
    page, last = page or "", 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            parts.append({"position": len(parts), "kind": "text", "text": text, "digest": None, "caption": None})

    markup = Markup(page)
    while (found := markup.next(last)) is not None:
        (held if caption is None else caption).append(entities.unescape(page[last : found.start]))
        last, name, closing = found.end, found.name, found.closing
        if name in _SILENT and not closing:
            last = markup.raw_end(name, last)[1]
        if name is None or name in _SILENT or name in _INLINE:
            continue
        if name == "figcaption":
            if closing and caption is not None:
                for at in figure or []:
                    parts[at]["caption"] = " ".join("".join(caption).split()) or parts[at]["caption"]
                caption = None
            elif not closing:
                flush()
                caption = []
            continue
        if caption is None:
            flush()
        if name == "figure":
            figure, caption = (None, None) if closing else ([], None)
        elif name in ("img", "video", "audio", "source") and not closing:
            given = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(found.raw)}
            if given.get("src"):
                if figure is not None:
                    figure.append(len(parts))
                src = given["src"]
                parts.append({"position": len(parts), "kind": "media", "text": None, "digest": src.removeprefix(_SCHEME), "caption": given.get("alt") or given.get("title")})
    (held if caption is None else caption).append(entities.unescape(page[last:]))
    flush()
    return parts


def interleave(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """pages (key, html) as (key, parts). A null or empty page has no parts."""
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
        for batch in batches:
            for some in common.groups(batch):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([parse(x) for x in some.column(1).to_pylist()], pa.list_(part))], names=[key, "parts"])

    return pages.select(key, html).mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("parts", T.ArrayType(PART))]))


def references(sequences: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row (key, position, digest, caption) for each medium of each sequence."""
    return sequences.select(key, F.explode("parts").alias("p")).where("p.kind = 'media'").select(key, "p.position", "p.digest", "p.caption")


def resolve(refs: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """refs with the columns of media (unique by digest) that they name; null where a digest is not stored.

    A digest may be named by any part of all references; media's column `named` says by about how many.
    """
    return common.salted_join(refs, media, ["digest"], [key, "position"], "named", "left")


def store(docs: DataFrame, to: str) -> DataFrame:
    """Writes docs (doc_id, text) to a table at `to` as (doc_id, n_bytes, html, digest, media), and reads it back.

    html is a page that shows the document's medium with a caption; media is the grey map of its padded text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch):
                texts = common.as_bytes(some.column(1))
                made = [encode(payload_of(t)) for t in texts]
                digests = [hashlib.sha256(m).hexdigest() for m in made]
                pages = [f'<p>Document</p><figure><img src="{_SCHEME}{d}"><figcaption>{len(t)} bytes</figcaption></figure>' for d, t in zip(digests, texts)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(len, texts), pa.int64()), pa.array(pages), pa.array(digests), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "html", "digest", "media"])

    docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, media binary").write.option("compression", "zstd").parquet(to)
    return docs.sparkSession.read.parquet(to)


def describe(media: DataFrame) -> DataFrame:
    """media (digest, media) read back, decoded and described, one row for each digest; payload: its digest as bytes; named: how many rows had it."""
    names = ["digest", "payload_bytes", "payload", "tail_crc32", "media_bytes", "feature"]
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.groups(batch):
                rows = []
                for name, stored in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    digest = hashlib.sha256(stored).hexdigest()
                    if digest != name:
                        raise ValueError(f"medium {name} has the digest {digest}")
                    got = decode(stored)
                    rows.append((name, len(got), hashlib.sha256(got).digest(), zlib.crc32(got[-ALIGN:]), len(stored), features(got)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload binary, tail_crc32 long, media_bytes long, feature string")
    return rows.groupBy("digest").agg(F.count("*").alias("named"), *[F.first(c).alias(c) for c in rows.columns[1:]])


def document_media(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) with its stored medium's properties.

    Null texts count as empty, whose payload is 64 zero bytes. Equal texts share one medium; repeated rows stay. Other
    columns are not read. An empty table gives no rows.
    """
    kept = store(docs, f"{common.shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}")
    refs = references(interleave(kept.select("doc_id", "html")))
    sizes = F.split("caption", " ")[0].cast("long").alias("n_bytes")
    payload = F.lower(F.hex("payload")).alias("payload_sha256")
    return resolve(refs, describe(kept)).select("doc_id", sizes, "payload_bytes", payload, "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature")
