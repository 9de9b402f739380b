"""Suggested links as allocate() takes them from all scored pairs, with only those pairs scored that are looked at.

Whether a pair is taken depends on what its source took from earlier targets, and on what earlier sources took of its
target. So a source looks at the targets that its paragraphs have an anchor to, in order, leaves out those that are full,
and stops at its cap: as targets fill up, few of a site's pairs are ever looked at. What is looked at is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions.lexicon import GENERIC_ANCHORS
from weftlink.settings import Settings

#: Targets among which a source looks first; then twice as many, and so on.
WINDOW = 256
#: Targets of which the texts are kept ready.
READY = 4096
_OUT = "site_key string, src_seq long, tgt_seq long, para_idx int, anchor string"
_GOAL = ["h1", "h1_lead", "title", "h2", "h2_leads", "meta", "slug", "strategic", "keywords"]


class Goal:
    """A target's texts, in small letters."""

    def __init__(self, row: dict):
        self.h1, self.lead, self.title, self.meta, self.slug = row["h1"], row["h1_lead"], row["title"], row["meta"], row["slug"]
        self.h2 = [(h, lead) for h, lead in zip(row["h2"] or [], row["h2_leads"] or []) if h is not None]
        self.strategic, self.size = row["strategic"], len(row["keywords"] or [])
        self.keywords = set(row["keywords"] or [])

    def relevance(self, low: str, shared: int) -> float:
        """scoring.anchor_relevance"""
        if self.h1 and (low in self.h1 or self.lead in low):
            return 3.0
        if self.title is not None and low in self.title:
            return 2.5
        if any(low in h or lead in low for h, lead in self.h2):
            return 2.0
        if self.meta is not None and low in self.meta:
            return 1.5
        if self.slug is not None and low.replace(" ", "-") in self.slug:
            return 1.0
        return 0.5 if shared > 0 else 0.0


def overlap(shared: int) -> float:
    return 2.0 if shared >= 10 else 1.5 if shared >= 6 else 1.0 if shared >= 3 else 0.5 if shared >= 1 else 0.0


def penalty(low: str) -> float:
    return 3.0 * (low in GENERIC_ANCHORS) + 2.0 * (len(low) < 4) + 0.5 * (" " not in low and len(low) < 8)


def rounded(raw: float) -> int:
    return max(1, min(10, math.floor(raw + 0.5)))


class Site:
    """The phrases and targets of one site, and how often each target was taken."""

    def __init__(self, settings: Settings):
        self.settings, self.goals, self.ids, self.sizes, self.pages, self.looked = settings, [], [], [], [], 0

    def add_phrases(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("pages")
        self.ids.append(batch.column("id").to_numpy())
        self.sizes.append(np.diff(lists.offsets.to_numpy()))
        self.pages.append(lists.flatten().to_numpy())

    def close(self) -> None:
        """After phrases, by id, and targets, by tgt_seq."""
        self.seqs = np.concatenate([b.column("seq").to_numpy() for b in self.goals] or [np.empty(0, np.int64)])
        self.starts = np.cumsum([0] + [b.num_rows for b in self.goals])
        self.ids = np.concatenate(self.ids or [np.empty(0, np.int64)])
        sizes = np.concatenate(self.sizes or [np.empty(0, np.int64)])
        at = np.searchsorted(self.seqs, np.concatenate(self.pages or [np.empty(0, np.int64)]))
        #: phrase and target as one number; sorted, for phrases and the targets of each are
        self.met = (np.repeat(np.arange(len(self.ids), dtype=np.int64), sizes) << 32) | at
        self.taken, self.ready, self.pages, self.sizes = np.zeros(len(self.seqs), np.int64), {}, None, None
        self.full = np.zeros(len(self.seqs), bool)
        self.full[:] = self.settings.max_links_per_target < 1
        self.pack()

    def pack(self) -> None:
        """Full targets leave the lists."""
        self.met = self.met[~self.full[self.met & 0xFFFFFFFF]]
        self.open, self.since = np.flatnonzero(~self.full), 0

    def goal(self, at: int) -> Goal:
        found = self.ready.get(at)
        if found is None:
            if len(self.ready) >= READY:
                self.ready = {}
            k = int(np.searchsorted(self.starts, at, "right")) - 1
            row = self.goals[k].slice(at - int(self.starts[k]), 1)
            found = self.ready[at] = Goal({c: row.column(c)[0].as_py() for c in _GOAL})
        return found

    def links(self, seq: int, hits: pa.StructArray, paras: list[dict], keywords: list[str], linked: list[int]) -> list[tuple[int, int, str]]:
        """(tgt_seq, para_idx, anchor) that the source seq takes."""
        s, out, used = self.settings, [], set()
        if s.max_links_per_source < 1 or not len(hits):
            return out
        phrase = np.searchsorted(self.ids, hits.field("id").to_numpy())
        place, anchors, own = hits.field("para_idx").to_pylist(), hits.field("anchor").to_pylist(), set(keywords or [])
        lows = [a.lower() for a in anchors]
        unused = set(lows)  # a used anchor stays in the lists: where it is a paragraph's best, the paragraph has no other
        barred, told = {seq, *(linked or [])}, {p["para_idx"]: p for p in paras}
        most = max(p["points"] for p in paras)
        first, width = 0, WINDOW
        while first < len(self.open):
            last = min(first + width, len(self.open))
            low, high = int(self.open[first]), int(self.open[last - 1])
            key = phrase << 32
            a, b = np.searchsorted(self.met, key | low), np.searchsorted(self.met, key | high, "right")
            n = b - a
            hit = np.repeat(np.arange(len(phrase)), n)
            at = self.met[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)] & 0xFFFFFFFF
            live = ~self.full[at]
            hit, at = hit[live], at[live]
            order = np.argsort(at, kind="stable")  # hits stay in order
            hit, at = hit[order], at[order]
            edges = np.flatnonzero(np.diff(at, prepend=-1))
            for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                goal_at = int(at[x])
                target = int(self.seqs[goal_at])
                if target in barred:
                    continue
                best = self.best(self.goal(goal_at), hit[x:y].tolist(), place, lows, told, own, used, most)
                if best is None:
                    continue
                out.append((target, place[best], anchors[best]))
                used.add(lows[best])
                unused.discard(lows[best])
                self.taken[goal_at] += 1
                if self.taken[goal_at] >= s.max_links_per_target:
                    self.full[goal_at], self.since = True, self.since + 1
                if len(out) >= s.max_links_per_source or not unused:
                    break
            if len(out) >= s.max_links_per_source or not unused:
                break
            first, width = last, width * 2
        if self.since * 8 > len(self.open):
            self.pack()
        return out

    def best(self, goal: Goal, hits: list[int], place: list[int], lows: list[str], told: dict, own: set, used: set, most: float) -> int | None:
        """The pair's hit: of its paragraphs' best anchors that the source has not used the highest score, the first paragraph among equals."""
        s, top = self.settings, None
        shared = len(own & goal.keywords)
        self.looked += 1
        fixed = overlap(shared) + goal.strategic
        if shared < s.min_keyword_overlap or rounded(fixed + 4.0 + most) < s.min_score:
            return None
        seen = -1
        for h in hits:  # by paragraph, the best anchor first
            i = place[h]
            if i == seen:
                continue
            seen = i
            low = lows[h]
            if low in used:
                continue
            para = told[i]
            raw = fixed + para["points"] + goal.relevance(low, shared) - penalty(low)
            words = para["para_words"]
            if rounded(raw + 1.0) < s.min_score or (top and rounded(raw + 1.0) <= top[0]):
                continue
            if words and goal.size:
                near = sum(map(goal.keywords.__contains__, words)) / math.sqrt(float(len(words)) * goal.size)
                raw += 1.0 if near >= 0.25 else 0.5 if near >= 0.12 else 0.0
            score = rounded(raw)
            if score >= s.min_score and (top is None or score > top[0]):
                top = (score, h)
        return top and top[1]


def choose(hits: DataFrame, phrases: DataFrame, sources: DataFrame, goals: DataFrame, settings: Settings) -> DataFrame:
    """(site_key, src_seq, tgt_seq, para_idx, anchor) of the suggested links.

    hits, phrases: anchors.numbered_matches(); sources: (site_key, src_seq, paras, keywords, linked); goals: what the points depend on.
    A site's rows stream through one task: phrases and targets first, which it holds, then sources, one after the other.
    """

    def lead(text, words: int):
        return F.array_join(F.slice(F.split(F.lower(text), " "), 1, words), " ")

    rows = phrases.select("site_key", F.lit(0).alias("kind"), F.col("id").alias("seq"), "id", "pages")
    goals = goals.select(
        "site_key", F.lit(1).alias("kind"), F.col("tgt_seq").alias("seq"), F.lower("h1").alias("h1"), lead(F.col("h1"), 4).alias("h1_lead"), F.lower("title").alias("title"),
        F.transform("h2", lambda h: F.lower(h)).alias("h2"), F.transform("h2", lambda h: lead(h, 3)).alias("h2_leads"), F.lower("meta_desc").alias("meta"), "slug", "strategic", F.col("target_keywords").alias("keywords"),
    )
    sources = sources.join(hits, ["site_key", "src_seq"]).select("site_key", F.lit(2).alias("kind"), F.col("src_seq").alias("seq"), "hits", "paras", "keywords", "linked")
    rows = rows.unionByName(goals, allowMissingColumns=True).unionByName(sources, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = site = None
        closed = False
        for batch in batches:
            names, kinds = batch.column("site_key").to_pylist(), batch.column("kind").to_pylist()
            edges = [i for i in range(len(names)) if i == 0 or (names[i], kinds[i]) != (names[i - 1], kinds[i - 1])]
            made = []
            for a, b in zip(edges, [*edges[1:], len(names)]):
                part = batch.slice(a, b - a)
                if site is None or names[a] != key:
                    key, site, closed = names[a], Site(settings), False
                if kinds[a] == 0:
                    site.add_phrases(part)
                elif kinds[a] == 1:
                    site.goals.append(pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(c)]) for c in ("seq", *_GOAL)], names=["seq", *_GOAL]))
                else:
                    if not closed:
                        site.close()
                        closed = True
                    seqs, paras, words, linked = (part.column(c).to_pylist() for c in ("seq", "paras", "keywords", "linked"))
                    for i, seq in enumerate(seqs):
                        made += [(key, seq, *link) for link in site.links(seq, part.column("hits").slice(i, 1).flatten(), paras[i], words[i], linked[i])]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["site_key", "src_seq", "tgt_seq", "para_idx", "anchor"])

    return rows.repartition("site_key").sortWithinPartitions("site_key", "kind", "seq").mapInArrow(run, _OUT)
