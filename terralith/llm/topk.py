"""Exact top-k search by distributed histogram selection.

Queries are dealt into blocks and the corpus into groups; a task gets one query block and
then streams one group's vectors past it, so it holds a block and one Arrow batch. In each
pass it scores everything and counts, for each query, the scores in equal bins of the
query's current range. Summed over the groups, the counts tell which bin holds the kth best
score, and that bin is the next pass's range. A group only reports its bins from the top
down to the one where its own counts reach k: no lower bin can hold the kth best of all.
When the scores from there on are few, one more pass keeps exactly those, and ties are
broken by id. Scores are whole multiples of 1e-9 and bins have powers of two as widths, so
every comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_BYTES = 32 << 20
BINS = 256
UNIT = 1e9
_LOW, _SPAN = -float(1 << 30), 1 << 31
_TILE = 128


def cleaned(embeddings: DataFrame) -> DataFrame:
    """(uid, dim, vec_id, v): distinct rows that can be compared, each with a number of its own."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))).distinct()
    return cut(rows.select(F.monotonically_increasing_id().alias("uid"), F.size("v").alias("dim"), "vec_id", "v"))


def _unit(v: pa.Array, dim: int) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(size > 0, size, 1)[:, None]


class Block:
    """A query block: ids, unit vectors, the lower end of each query's range and what it still needs."""

    def __init__(self, parts: list[tuple]):
        self.uid, self.ids, self.x, self.low, self.need = (np.concatenate([p[k] for p in parts]) for k in range(5))
        self.floor = self.low.copy()
        self.h: np.ndarray | None = None

    def tiles(self, ids: np.ndarray, x: np.ndarray, floor: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, column, score) of the scores from ``floor`` on; a vector's own id scores below everything."""
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        for a in range(0, len(self.ids), _TILE):
            z = slice(a, a + _TILE)
            s = self.x[z] @ x.T
            s *= UNIT
            np.rint(s, out=s)
            lo, hi = np.searchsorted(ranked, self.ids[z]), np.searchsorted(ranked, self.ids[z], side="right")
            for i in np.flatnonzero(hi > lo):
                s[i, order[lo[i] : hi[i]]] = -np.inf
            line, col = np.nonzero(s >= (self.floor if floor else self.low)[z, None])
            yield line + a, col, s[line, col]

    def count(self, ids: np.ndarray, x: np.ndarray, width: int) -> None:
        """Adds one batch to the histograms and lifts floors to where the counts already suffice."""
        if self.h is None:
            self.h = np.zeros((len(self.ids), BINS), np.int32)
        for q, _, s in self.tiles(ids, x, True):
            at = (s - self.low[q]) * (1 / width)
            ok = at < BINS
            if ok.any():
                q = q[ok]
                a, z = int(q[0]), int(q[-1]) + 1
                self.h[a:z] += np.bincount((q - a) * BINS + at[ok].astype(np.int64), minlength=(z - a) * BINS).reshape(-1, BINS).astype(np.int32)
                b = self.reached(a, z)
                self.floor[a:z] = np.where(b >= 0, self.low[a:z] + b * float(width), self.low[a:z])

    def reached(self, a: int, z: int) -> np.ndarray:
        """The highest bin from which the counts reach the need; -1 where none does."""
        held = np.cumsum(self.h[a:z, ::-1], 1) >= self.need[a:z, None]
        return np.where(held[:, -1], BINS - 1 - held.argmax(1), -1)


def _streamed(batches: Iterator[pa.RecordBatch], see: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Runs ``see`` on (block, ids, vectors) of each batch of a group and ``end`` on a block that is through.

    Rows come ordered by (dim, qblock, g, kind): a group's queries, then its vectors.
    """
    key, parts, block = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        names = {n: b.column(n) for n in b.schema.names}
        marks = np.stack([names[n].to_numpy(zero_copy_only=False) for n in ("dim", "qblock", "g", "kind")], 1)
        edge = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for a, z in zip(edge, edge[1:]):
            dim, qblock, g, kind = marks[a].tolist()
            if (dim, qblock, g) != key:
                if block is not None:
                    yield from end(block)
                key, parts, block = (dim, qblock, g), [], None
            ids, x = names["vec_id"].slice(a, z - a).to_numpy(), _unit(names["v"].slice(a, z - a), dim)
            if kind == 0:
                parts.append((names["uid"].slice(a, z - a).to_numpy(), ids, x, names["low"].slice(a, z - a).to_numpy(), names["need"].slice(a, z - a).to_numpy()))
            elif parts:
                block = block or Block(parts)
                yield from see(block, ids, x)
    if block is not None:
        yield from end(block)


def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    def see(block: Block, ids: np.ndarray, x: np.ndarray) -> tuple:
        block.count(ids, x, width)
        return ()

    def end(block: Block) -> Iterator[pa.RecordBatch]:
        least = block.reached(0, len(block.ids))
        q, b = np.nonzero((block.h > 0) & (np.arange(BINS) >= least[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(block.uid[q]), pa.array(b.astype(np.int32)), pa.array(block.h[q, b].astype(np.int64))], ["uid", "bin", "n"])

    yield from _streamed(batches, see, end)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def see(block: Block, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for q, col, s in block.tiles(ids, x, False):
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(block.uid[q]), pa.array(block.ids[q]), pa.array(ids[col]), pa.array(s.astype(np.int64))], ["uid", "vec_id", "neighbor_id", "s"])

    yield from _streamed(batches, see, lambda block: ())


def top_k(embeddings: DataFrame, k: int = 10, query: Column | None = None, block: int | None = None, groups: int | None = None) -> DataFrame:
    """(vec_id, neighbor_id, rank, score): the k others of greatest cosine for every query.

    ``query`` picks the rows that are queries by ``vec_id`` (without it all are); every row
    is a neighbour. ``block``: queries that a task holds at once, else as many as fill
    ``BLOCK_BYTES``; the corpus is shuffled once a pass for every block of queries.

    * scores are rounded to 1e-9; equal scores go by the smaller id
    * null ids, null or empty vectors and vectors with a null, NaN or infinite element are
      left out on both sides; vectors are only compared with those of their own length,
      and very long ones make smaller blocks
    * a zero vector scores 0 with everything
    * rows that repeat id and vector count once; several vectors of one id are queries and
      neighbours each by itself (so the id may appear twice), but never each other's
    * fewer than k others: all of them; an empty table gives an empty result
    * other columns are ignored, whatever their names
    """
    rows = cleaned(embeddings)
    asked = rows if query is None else rows.where(query)
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    nq = asked.count()
    block = block or max(1, min(32_768, BLOCK_BYTES // (8 * (dim or 1))))
    blocks = -(-nq // block) or 1
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    groups = groups or max(1, min(-(-n // 8192), -(-tasks // blocks)))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    number = lambda m, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(m)).cast("int")
    order = ["dim", "qblock", "g", "kind"]
    tail = ["uid", "vec_id", "v", "low", "need"]
    corpus = rows.select("dim", number(groups, 1).alias("g"), "uid", "vec_id", "v", each(blocks).alias("qblock"))
    corpus = corpus.select("dim", "qblock", "g", F.lit(1).alias("kind"), "uid", "vec_id", "v", F.lit(None).cast("double").alias("low"), F.lit(None).cast("long").alias("need"))
    state = asked.select("uid", F.lit(_LOW).alias("low"), F.lit(k).cast("long").alias("need"))

    def pairs(state: DataFrame) -> DataFrame:
        q = asked.join(state.select("uid", "low", "need"), "uid").select("dim", number(blocks, 2).alias("qblock"), each(groups).alias("g"), F.lit(0).alias("kind"), *tail)
        return q.unionByName(corpus).repartition(max(blocks * groups, 1), "dim", "qblock", "g").sortWithinPartitions(*order)

    width = _SPAN // BINS
    while True:
        h = pairs(state).mapInArrow(lambda it, w=width: _count(it, w), "uid long, bin int, n long").groupBy("uid", "bin").agg(F.sum("n").alias("n"))
        above = h.withColumn("above", F.sum("n").over(Window.partitionBy("uid").orderBy(F.desc("bin")))).join(state.select("uid", "need"), "uid")
        best = above.where("above >= need").groupBy("uid").agg(F.max_by(F.struct("bin", "n", "above"), "bin").alias("b"))
        moved = state.select("uid", "low", "need").join(best, "uid", "left")
        need = F.col("need") - F.coalesce(F.col("b.above") - F.col("b.n"), F.lit(0))
        kept = F.coalesce(k - F.col("need") + F.col("b.above"), F.lit(k))
        state = cut(moved.select("uid", (F.col("low") + F.coalesce(F.col("b.bin"), F.lit(0)) * float(width)).alias("low"), need.alias("need"), kept.alias("kept")))
        total = state.agg(F.sum("kept")).first()[0] or 0
        if width == 1 or total <= 3 * k * nq:
            break
        width = max(1, width // BINS)
    found = pairs(state).mapInArrow(_keep, "uid long, vec_id long, neighbor_id long, s long")
    w = Window.partitionBy("uid").orderBy(F.desc("s"), "neighbor_id")
    got = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return got.select("vec_id", "neighbor_id", "rank", F.round(F.col("s") / UNIT, 6).alias("score"))


def every_20th() -> Column:
    """Rows whose id is divisible by 20."""
    return F.col("vec_id") % 20 == 0


TOP_K_SQL = """WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, neighbor_id)::INT AS rank FROM s)
SELECT vec_id, neighbor_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10"""
