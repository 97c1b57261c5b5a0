"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = floor(rate * m) edits. Cut
into k + 1 pieces, at least one piece survives k edits unchanged, so every passage within
the budget has an exact piece hit at its place. One Aho-Corasick automaton finds the hits
of all pieces in one pass over a text; Myers' bit-parallel algorithm then gives the true
distance around each hit. The search is exact: it misses no passage within the budget.

Items of fewer than ``LEAST`` characters occur inside of longer words by chance, so they
match exactly and between word boundaries only.

Texts are compared in lower case with each run of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 24
RATE = 0.05
SHARD = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length that make up ``item``."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of ``text``, the end of the first such)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        xv = eq | mv
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class Matcher:
    """Finds items in texts; its automaton is built once in each Python worker."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE, least: int = LEAST):
        #: (id, normalised text, budget); a budget of -1 is an exact match between word boundaries
        self.items = [(i, n, int(rate * len(n)) if len(n) >= least else -1) for i, t in items if (n := normal(t))]
        self.automaton = None

    def __getstate__(self):
        return {"items": self.items, "automaton": None}

    def build(self):
        import ahocorasick

        where: dict[str, list[tuple[int, int]]] = {}
        self.masks = []
        for at, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, max(k, 0)):
                where.setdefault(piece, []).append((at, offset))
            mask: dict[str, int] = {}
            for j, c in enumerate(text):
                mask[c] = mask.get(c, 0) | 1 << j
            self.masks.append(mask)
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str | None, any_: bool = False) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end in the normalised text) of each item within its budget."""
        if not self.items or not text:
            return []
        if self.automaton is None:
            self.build()
        t = normal(text)
        starts: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(t):
            for at, offset in places:
                starts.setdefault(at, set()).add(end + 1 - n - offset)
        out = []
        for at, found in starts.items():
            id_, item, k = self.items[at]
            m, best = len(item), None
            order = sorted(found)
            if k < 0:
                best = next(((0, p + m) for p in order if not (t[p - 1 : p].isalnum() or t[p + m : p + m + 1].isalnum())), None)
                order = []
            a = 0
            while a < len(order):
                b = a
                while b + 1 < len(order) and order[b + 1] - order[b] <= m:
                    b += 1
                lo, hi = max(0, order[a] - k), order[b] + m + k
                d, e = (0, order[a] + m) if a == b and t.startswith(item, max(order[a], 0)) and order[a] >= 0 else myers(self.masks[at], m, t[lo:hi])
                e = e if a == b and d == 0 and e == order[a] + m else lo + e
                if d <= k and (best is None or d < best[0]):
                    best = (d, e)
                a = b + 1
            if best:
                out.append((id_, *best))
                if any_:
                    return out
        return out


def _shards(benchmark: DataFrame, rate: float, least: int) -> list[Matcher]:
    """Matchers of at most about ``SHARD`` characters each, so that none outgrows a worker."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = total // SHARD + 1
    out = []
    for s in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == s)
        out.append(Matcher(sorted({(r[0], r[1]) for r in rows.collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1])), rate, least))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, distance, end_at): each document with each item it holds.

    ``rate``: edits allowed per character of an item. ``end_at`` is where the closest
    passage ends in the normalised document.

    * null or empty texts hold nothing; null ids are carried as null
    * items of fewer than ``least`` characters match exactly and as whole words only
    * very long texts and items are matched whole; a document is scanned once a shard of
      ``SHARD`` characters of the benchmark
    * repeated document rows give repeated result rows; repeated benchmark rows count once
    * an item that occurs several times gives its closest passage, the first of equals
    * an empty table on either side gives an empty result; other columns are ignored
    """
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, distance int, end_at int"
    out = None
    for matcher in _shards(benchmark, rate, least):

        def scan(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *f) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for f in matcher.find(t.as_py())]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "end_at"])

        got = one.mapInArrow(scan, schema)
        out = got if out is None else out.unionByName(got)
    return out


def _holds(matcher: Matcher):
    @F.arrow_udf("boolean")
    def holds(t: pa.Array) -> pa.Array:
        return pa.array([bool(matcher.find(x.as_py(), any_=True)) for x in t], pa.bool_())

    return holds


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that hold no item (see ``contaminated``)."""
    for matcher in _shards(benchmark, rate, least):
        docs = docs.where(~_holds(matcher)(F.col("text")))
    return docs
