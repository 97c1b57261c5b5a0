"""Near-duplicate groups by chosen-path set similarity join over minwise tokens.

Each document becomes the set of its word shingles and, from that, ``SIZE`` minwise values.
A tree starts with all documents in its root. A node draws, from its own path, which of
the ``SIZE`` coordinates to branch on (``1 / threshold`` of them in expectation); documents
that agree on the value at a drawn coordinate share a child. Since the draw depends on the
path alone, a document finds its own children without seeing the node's other members;
Spark only counts the members. Nodes of one member end, small nodes are compared
exhaustively, large ones branch on. Independent trees repeat this to the wanted recall.

A node that is still large at the last level holds documents that agree on several drawn
values, so mostly copies of one text. It is compared exhaustively as well, but pairs that
are already known to be in one group are skipped, so a node of n copies takes about n
comparisons. One of more than ``BIG`` members is dealt into blocks, and every two blocks are
compared by a task of their own, which bounds a task's memory. Nothing caps the members of a
node or the partners of a document.

The number of trees follows from the target recall at the threshold: a pair stays together
in a tree of ``levels`` levels with the survival probability of the branching process.

Sketches only filter: a pair at ``SLACK`` below the threshold or more is a candidate, and is
decided by the exact Jaccard similarity of its shingles. One at ``SURE`` above the threshold
(5.7 standard deviations of the estimate, about 6e-9 of pairs at the threshold) needs none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, groups_of, mix64, utf8_buffers

SIZE = 128
WORDS = 3
SMALL, BIG = 64, 4096
RECALL, LEVELS = 0.997, 4
SLACK, SURE = 0.1, 0.25
_BLOCK = 1 << 18

_LUT = np.full(256, 32, np.uint8)
_LUT[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_LUT[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LUT[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LUT[128:] = np.arange(128, 256)

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(1, 1 << 32, SIZE, np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SIZE, np.uint64).astype(np.uint32)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        most = max(n, _BLOCK + 4096)
        _powers[:] = []
        for b in (_BASE, _INV):
            steps = np.full(most, b, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, and the index of each row's first word."""
    n = len(off) - 1
    new = off + np.arange(n + 1)
    buf = np.full(int(new[-1]) + 1, 32, np.uint8)
    buf[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off))] = _LUT[raw]
    isw = np.zeros(len(buf) + 1, bool)
    isw[1:] = buf != 32
    edge = np.flatnonzero(isw[1:] != isw[:-1])
    start, end = edge[::2], edge[1::2]
    p, q = _power(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf.astype(np.uint64) * p, out=total[1:])
    return mix64((total[end] - total[start]) * q[start]), np.searchsorted(start, new)


def shingles(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles of all rows, and where each row's begin.

    A row of fewer than ``words`` words has one shingle of them all; one without words none.
    """
    w, first = word_hashes(raw, off)
    n = np.diff(first)
    last = np.repeat(first[1:], n)
    at = np.arange(len(w))
    total = np.zeros(len(w), np.uint64)
    wide = np.concatenate([w, np.zeros(words, np.uint64)])
    for k in range(words):
        total += np.where(at + k < last, wide[k : k + len(w)], np.uint64(0)) * np.uint64(2 * k + 3)
    keep = (at + words <= last) | (at == np.repeat(first[:-1], n))
    s = (mix64(total[keep]) >> np.uint64(32)).astype(np.uint32)
    return s, np.concatenate([[0], np.cumsum(np.where(n > 0, np.maximum(n - words + 1, 1), 0))])


def sketches(array, words: int = WORDS) -> np.ndarray:
    """(rows, SIZE) minwise values of an Arrow string array; all ones where there are no words."""
    raw, off = utf8_buffers(array)
    out = np.full((len(off) - 1, SIZE), 0xFFFFFFFF, np.uint32)
    for a, b in groups_of(off, _BLOCK):
        s, first = shingles(raw[off[a] : off[b]], off[a : b + 1] - off[a], words)
        at = np.flatnonzero(np.diff(first))
        if not len(at):
            continue
        begin = first[at]
        for j in range(SIZE):
            out[a + at, j] = np.minimum.reduceat((s ^ _XOR[j]) * _MUL[j], begin)
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = sketches(b.column("text"), words)
        full = ~(sig == 0xFFFFFFFF).all(1)
        sk = pa.array([hashlib.blake2b(r, digest_size=16).digest() if ok else None for r, ok in zip(sig, full)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("doc_id"), sk, pa.array([r.tobytes() for r in sig], pa.binary())], ["vid", "doc_id", "sk", "sig"])


def vertex(df: DataFrame):
    """A row's identity: its id and text. Rows that repeat both are one vertex."""
    return F.xxhash64(df["doc_id"], df["text"])


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(vid, doc_id, sk, sig) of each row with words: identity, id, hash of the sketch, sketch."""
    one = docs.select(vertex(docs).alias("vid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    got = one.mapInArrow(lambda it: _sketch_batches(it, words), "vid long, doc_id long, sk binary, sig binary")
    return got.where("sk is not null")


def children(path: np.ndarray, sig: np.ndarray, threshold: float, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row index, child path) of all children of each row's node ``path``.

    A node draws each coordinate with probability 1 / (threshold * SIZE).
    """
    p = mix64(path.astype(np.uint64) + np.uint64(level * _BASE & (1 << 64) - 1))
    coordinate = mix64(np.arange(1, SIZE + 1, dtype=np.uint64))
    bound = np.uint64(int(min(1.0, 1 / (threshold * SIZE)) * (2**64 - 1)))
    row, col = np.nonzero(mix64(p[:, None] ^ coordinate[None, :]) < bound)
    token = mix64(sig[row, col].astype(np.uint64) | (col.astype(np.uint64) << np.uint64(32)))
    return row, mix64(p[row] + token * np.uint64(_BASE)).view(np.int64)


def survival(similarity: float, threshold: float, levels: int) -> float:
    """Probability that a pair of this similarity shares a node of the last level of a tree."""
    q = 1.0
    for _ in range(levels):
        q = 1 - (1 - min(1.0, 1 / (threshold * SIZE)) * similarity * q) ** SIZE
    return q


def trees_for(recall: float, threshold: float, levels: int) -> int:
    """Trees that together keep a pair at the threshold with probability ``recall``, even if every node of every level is large."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, threshold, levels))))


def _roots(trees: int) -> np.ndarray:
    return mix64(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _branch(batches: Iterator[pa.RecordBatch], trees: int, threshold: float, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (path, vid) of the children; without a path column, of all the roots' children."""
    for b in batches:
        for a in range(0, b.num_rows, 256):
            part = b.slice(a, 256)
            n = part.num_rows
            raw, _ = utf8_buffers(part.column("sig"))
            sig = raw.view(np.uint32).reshape(n, SIZE) if n else np.zeros((0, SIZE), np.uint32)
            vid = part.column("vid").to_numpy(zero_copy_only=False)
            paths = [part.column("path").to_numpy(zero_copy_only=False)] if "path" in part.schema.names else [np.full(n, r) for r in _roots(trees)]
            for p in paths:
                row, child = children(p.view(np.uint64) if p.dtype == np.int64 else p, sig, threshold, level)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(vid[row])], ["path", "vid"])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of one-byte sketches, corrected for chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def components(sig: np.ndarray, threshold: float, low: float = 1.0, near: list | None = None) -> np.ndarray:
    """Smallest index of each row's group; ``near`` gets the pairs of rows of two groups at ``low`` or more.

    Every row outside the largest group is compared with all rows; two rows of the largest
    group are together already. That is exhaustive, and linear where one group fills a node.
    """
    n = len(sig)
    label, asked, i = np.arange(n), np.zeros(n, bool), 0
    while True:
        asked[i] = True
        like = np.concatenate([agreement(sig[a : a + 65536], sig[i]) for a in range(0, n, 65536)])
        ids = np.unique(np.append(label[like >= threshold], label[i]))
        if len(ids) > 1:
            label[np.isin(label, ids)] = ids[0]
        if near is not None:
            other = np.flatnonzero((like >= low) & (label != label[i]))
            near.append(np.stack([np.full(len(other), i), other]))
        rest = np.flatnonzero((label != np.bincount(label).argmax()) & ~asked)
        if not len(rest):
            if near:
                near[:] = [x[:, label[x[0]] != label[x[1]]] for x in near]
            return label
        i = rest[0]


def _pairs_in_small(path: np.ndarray, sig: np.ndarray, low: float, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of similar rows in one node, and which are sure; rows of a node follow one another."""
    out, n, shift = [], len(path), 1
    live = np.arange(n)
    while True:
        live = live[live + shift < n]
        live = live[path[live] == path[live + shift]]
        if not len(live):
            break
        for a in range(0, len(live), 65536):
            i = live[a : a + 65536]
            like = agreement(sig[i], sig[i + shift])
            hit = i[like >= low]
            out.append(np.stack([hit, hit + shift, like[like >= low] >= sure]))
        shift += 1
    i, j, known = np.concatenate(out, 1) if out else np.zeros((3, 0), int)
    return i, j, known.astype(bool)


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, sure) of a partition that is sorted by node; a node may span batches."""
    low, high = threshold - SLACK, threshold + SURE

    def edges(path: np.ndarray, vid: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        cutoff = np.flatnonzero(np.diff(path)) + 1
        begin, size = np.concatenate([[0], cutoff]), np.diff(np.concatenate([[0], cutoff, [len(path)]]))
        small = np.repeat(size <= SMALL, size)
        i, j, known = _pairs_in_small(path[small], sig[small], low, high)
        a, b, sure = [vid[small][i]], [vid[small][j]], [known]
        for s, k in zip(begin[size > SMALL], size[size > SMALL]):
            near: list = []
            label = components(sig[s : s + k], high, low, near)
            at = np.flatnonzero(label != np.arange(k))
            one, two = np.concatenate(near, 1)
            a += [vid[s + label[at]], vid[s + one]]
            b += [vid[s + at], vid[s + two]]
            sure += [np.ones(len(at), bool), np.zeros(len(one), bool)]
        a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(sure)], ["a", "b", "sure"])

    held: list[tuple] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw, _ = utf8_buffers(batch.column("sig8"))
        path = batch.column("path").to_numpy(zero_copy_only=False)
        part = (path, batch.column("vid").to_numpy(zero_copy_only=False), raw.reshape(n, SIZE))
        last = int(np.searchsorted(path, path[-1])) if path[0] != path[-1] else 0  # ascending within a partition
        if last:
            whole = [*held, tuple(x[:last] for x in part)]
            yield edges(*(np.concatenate([h[k] for h in whole]) for k in range(3)))
            held = [tuple(x[last:].copy() for x in part)]
        else:
            if held and held[-1][0][-1] != path[0]:
                yield edges(*(np.concatenate([h[k] for h in held]) for k in range(3)))
                held = []
            held.append(tuple(x.copy() for x in part))
    if held:
        yield edges(*(np.concatenate([h[k] for h in held]) for k in range(3)))


def candidate_nodes(sk: DataFrame, trees: int, threshold: float, levels: int) -> DataFrame:
    """(path, vid) of every node to compare: ended small ones, and large ones of the last level.

    Each level shuffles (path, vid) once; nodes of one member end before the checkpoint.
    """
    out, now = None, None
    for level in range(1, levels + 1):
        rows = (sk if now is None else now.join(sk, "vid")).mapInArrow(lambda it, k=level: _branch(it, trees, threshold, k), "path long, vid long")
        counted = cut(rows.withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n > 1"))
        last = level == levels
        done = counted.where(F.lit(True) if last else F.col("n") <= SMALL).select("path", "vid", "n")
        out = done if out is None else out.unionByName(done)
        now = counted.where(F.col("n") > SMALL).select("path", "vid")
        if last or now.isEmpty():
            return in_blocks(out)


def in_blocks(nodes: DataFrame, big: int = BIG) -> DataFrame:
    """(path, vid): a node of more than ``big`` members becomes one node for every two of its blocks."""
    m = F.ceil(F.col("n") / big)
    own, each = F.pmod(F.xxhash64("vid"), m), F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    split = nodes.where(F.col("n") > big).select("path", "vid", own.alias("b"), each.alias("c"))
    split = split.select(F.xxhash64("path", F.least("b", "c"), F.greatest("b", "c")).alias("path"), "vid")
    return nodes.where(F.col("n") <= big).select("path", "vid").unionByName(split)


def _byte(sig: np.ndarray) -> np.ndarray:
    """One byte of each minwise value, which all of its bits decide."""
    return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, off = utf8_buffers(b.column("text"))
        out = []
        for x, z in groups_of(off, _BLOCK):
            s, first = shingles(raw[off[x] : off[z]], off[x : z + 1] - off[x], words)
            out += [np.unique(s[first[k] : first[k + 1]]).tobytes() for k in range(z - x)]
        yield pa.RecordBatch.from_arrays([b.column("vid"), pa.array(out, pa.binary())], ["vid", "set"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``threshold`` or more; texts are (vid, text)."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    sets = cut(texts.join(need, "vid", "left_semi").dropDuplicates(["vid"]).mapInArrow(lambda it: _set_batches(it, words), "vid long, set binary"))

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y):
            p, q = (np.frombuffer(v.as_py(), np.uint32) for v in (p, q))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= threshold * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    one = pairs.join(sets.select(F.col("vid").alias("a"), F.col("set").alias("x")), "a")
    return one.join(sets.select(F.col("vid").alias("b"), F.col("set").alias("y")), "b").where(alike("x", "y")).select("a", "b")


def similar_edges(sk: DataFrame, texts: DataFrame, trees: int, threshold: float, levels: int, words: int = WORDS) -> DataFrame:
    """Edges (a, b), a < b, between vertices of which ``sk`` has one for each distinct sketch."""
    nodes = candidate_nodes(sk, trees, threshold, levels)

    @F.arrow_udf("binary")
    def short(sig: pa.Array) -> pa.Array:
        raw, _ = utf8_buffers(sig)
        return pa.array([r.tobytes() for r in _byte(raw.view(np.uint32).reshape(-1, SIZE))], pa.binary())

    held = nodes.join(sk.select("vid", short("sig").alias("sig8")), "vid")
    held = held.repartition("path").sortWithinPartitions("path")
    found = cut(held.mapInArrow(lambda it: _compare(it, threshold), "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")))
    return found.where("sure").select("a", "b").unionByName(verified(found.where("not sure").select("a", "b"), texts, threshold, words))


def connected(edges: DataFrame, most: int = 40) -> DataFrame:
    """(vid, comp): the smallest vertex reachable from each vertex that has an edge.

    Alternates the large-star and small-star steps until the edges don't change; each
    round's edges are checkpointed. The rounds grow with the logarithm of the longest path.
    """
    now, before = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError("the groups didn't settle")
    return now.select(F.col("u").alias("vid"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("vid"), F.col("v").alias("comp")).distinct())


def groups(docs: DataFrame, threshold: float = 0.5, recall: float = RECALL, levels: int = LEVELS, words: int = WORDS) -> DataFrame:
    """(vid, doc_id, keep_id, keep_vid) of each vertex in a group of two or more.

    The member with the smallest id (a null id comes last, then the smaller hash) stays.
    """
    sk = cut(sketched(docs, words))
    exact = sk.groupBy("sk").agg(F.min("vid").alias("rep"))
    members = cut(sk.select("vid", "doc_id", "sk").distinct().join(exact, "sk").select("vid", "doc_id", "rep"))
    reps = cut(sk.join(exact.select(F.col("rep").alias("vid")), "vid", "left_semi").dropDuplicates(["vid"]).select("vid", "sig"))
    trees = trees_for(recall, threshold, levels)
    comp = connected(similar_edges(reps, docs.select(vertex(docs).alias("vid"), F.col("text").alias("text")), trees, threshold, levels, words))
    all_ = members.join(comp.withColumnRenamed("vid", "rep"), "rep", "left").select("vid", "doc_id", F.coalesce("comp", "rep").alias("comp"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("vid"))
    best = all_.groupBy("comp").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    return all_.join(best, "comp").select("vid", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("best.vid").alias("keep_vid"))


def near_duplicates(docs: DataFrame, threshold: float = 0.5, recall: float = RECALL, levels: int = LEVELS, words: int = WORDS) -> DataFrame:
    """(doc_id, duplicate_of): every document that goes, with the one of its group that stays.

    * null or empty text, or text without letters and digits: no shingles, never a copy
    * fewer than ``words`` words: one shingle, so only equal texts are copies
    * rows that repeat an id and its text count once; they leave no row of their own here
    * null ids: such rows may be copies (their ``doc_id`` is null) and stay only if all of
      their group have none; other columns are ignored, whatever their names
    * very long texts: all of their shingles count, however many
    * ties: of members with equal ids the smaller hash stays, so the choice is the same each time
    * an empty table gives an empty result
    """
    got = groups(docs, threshold, recall, levels, words)
    return got.where("vid != keep_vid").select("doc_id", F.col("keep_id").alias("duplicate_of"))


def keep_one(docs: DataFrame, threshold: float = 0.5, recall: float = RECALL, levels: int = LEVELS, words: int = WORDS) -> DataFrame:
    """Rows of ``docs``, columns as they are, without all but one document of each group.

    Rows that repeat both id and text are one document, of which one row stays; see
    ``near_duplicates`` for the other cases. Texts without words all stay.
    """
    gone = groups(docs, threshold, recall, levels, words).where("vid != keep_vid").select("vid")
    key = "__vertex"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, vertex(docs))
    left = keyed.join(gone.withColumnRenamed("vid", key), key, "left_anti")
    again = cut(docs.where(F.length(F.trim("text")) > 0).select(vertex(docs).alias(key)).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    once = left.join(again, key, "left_anti")
    repeated = left.join(again, key, "left_semi").dropDuplicates([key])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])

