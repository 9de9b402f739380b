"""Which scored links are suggested: greedily, under caps for each source, each target and each anchor of a source.

The order decides: source by source, and for each source target by target. A pair takes its best paragraph whose anchor
its source has not used yet. At most cap - 1 anchors are used when a pair's turn comes, so the best cap paragraphs with
different anchors are all that can matter for a pair, and everything before this step is done without order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.settings import CORE, Settings


def contenders(scored: DataFrame, settings: Settings = CORE) -> DataFrame:
    """Of scored (site_key, src_seq, tgt_seq, para_idx, anchor, score, ...) what can be chosen, with low, the anchor in small letters, and place."""
    pair = ["site_key", "src_seq", "tgt_seq"]
    rest = [c for c in scored.columns if c not in pair]
    best = scored.where(F.col("score") >= settings.min_score).groupBy(*pair, F.lower("anchor").alias("low"))
    best = best.agg(F.max_by(F.struct(*rest), F.struct("score", -F.col("para_idx"))).alias("b")).select(*pair, "low", "b.*")
    order = Window.partitionBy(*pair).orderBy(F.desc("score"), "para_idx")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= settings.max_links_per_source)


class Allocator:
    """Takes contenders in order and says which are chosen. Holds a count for each target of one site, and one source's anchors."""

    def __init__(self, per_source: int, per_target: int):
        self.per_source, self.per_target = per_source, per_target
        self.site = self.source = self.pair = None

    def take(self, site: str, source: int, target: int, low: str) -> bool:
        if site != self.site:
            self.site, self.source, self.targets = site, None, {}
        if source != self.source:
            self.source, self.anchors, self.pair = source, set(), None
        if target == self.pair or len(self.anchors) >= self.per_source or self.targets.get(target, 0) >= self.per_target or low in self.anchors:
            return False
        self.pair = target
        self.anchors.add(low)
        self.targets[target] = self.targets.get(target, 0) + 1
        return True


def allocate(scored: DataFrame, settings: Settings = CORE) -> DataFrame:
    """The rows of scored that are suggested.

    The contenders of a site stream through one task in order; it holds a number for each page, never the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Allocator(settings.max_links_per_source, settings.max_links_per_target)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
            yield batch.filter(pa.array([state.take(*r) for r in rows], pa.bool_()))

    rest = [c for c in scored.columns if c not in ("site_key", "src_seq", "tgt_seq")]
    rows = contenders(scored, settings).select("site_key", "src_seq", "tgt_seq", "low", "place", *rest)
    ordered = rows.repartition("site_key").sortWithinPartitions("site_key", "src_seq", "tgt_seq", "place")
    return ordered.mapInArrow(run, rows.schema).drop("low", "place")
