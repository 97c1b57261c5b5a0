"""Document scores by a causal self-attention language model, trained here in numpy.

Texts become subword ids of a public vocabulary. A token's probability is that of its class
times its share of the class: the ``CLASSES - TAIL`` most frequent ids are classes of one,
the others share ``TAIL`` classes of like weight; shares come from counts over all
documents. One attention layer predicts the class from the tokens before it:

    h = E[x] + softmax((E[x] Wq + Pq)(E[x'] Wk + Pk)^T / sqrt(D)) (E[x'] Wv);  logits = relu(h W + c) U + b

Every window has two blocks of ``HALF`` positions. The tokens of its second block are
scored with all of the window before them as context, so windows overlap by half and each
token is scored once. Windows of many documents make one batch; masks keep positions from
later tokens, from other documents and from padding.

Training is data parallel and goes once over all documents, at every size: each round takes
another part of them, every partition takes Adam steps on its own documents of that part
from the same start, and the parameters are averaged by tokens, in two levels.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
D, HIDDEN, HALF = 16, 32, 16
CLASSES, TAIL, INPUTS = 96, 32, 2048
ROUNDS, WINDOWS, RATE = 3, 256, 0.01
MOST = np.float32(60)  # logits are cut to +- MOST, so that their exponentials need no shift
_MASK = (np.arange(2 * HALF)[None, :] <= np.arange(HALF)[:, None] + HALF).astype(np.float32)
_ONES = {n: np.ones(n, np.float32) for n in (2 * HALF, CLASSES)}
_encodings: dict = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, pick, ids): the ids as 4-byte integers; pick in [0, 1) chooses training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = [np.array(enc.encode_ordinary(x.as_py() or ""), np.uint32) for x in b.column("text")]
            ids = [v.astype(np.uint16).tobytes() if not len(v) or v.max() < 65536 else b"\0" + v.tobytes() for v in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pick"), pa.array(ids, pa.binary())], ["doc_id", "pick", "ids"])

    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pick.alias("pick"), F.col("text").alias("text"))
    return one.mapInArrow(run, "doc_id long, pick double, ids binary")


def _ids(x: bytes) -> np.ndarray:
    """Ids as written by ``tokenized``: two bytes each, or a zero byte and four bytes each."""
    return np.frombuffer(x, np.uint16) if len(x) % 2 == 0 else np.frombuffer(x[1:], np.uint32)


def counted(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("ids"):
                n = np.bincount(_ids(x.as_py()))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """kind: class of each id; within: log share of its class; entry: its input row; usual: log share of each class."""

    kind: np.ndarray
    within: np.ndarray
    entry: np.ndarray
    usual: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Classes and shares of ids from their counts; an id never seen counts as one half."""
    n = counts + 0.5
    order = np.argsort(-counts, kind="stable")
    kind, entry = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32)
    own = CLASSES - TAIL
    kind[order[:own]] = np.arange(min(own, len(n)))
    rest = order[own:]
    mass = np.cumsum(n[rest])
    kind[rest] = own + np.minimum((mass * TAIL / mass[-1]).astype(int), TAIL - 1) if len(rest) else 0
    named = INPUTS - 257
    entry[order[:named]] = 1 + np.arange(min(named, len(n)))
    entry[order[named:]] = 1 + named + order[named:] % 256
    weight = np.bincount(kind, weights=n, minlength=CLASSES)
    return Vocabulary(kind, np.log(n / weight[kind]).astype(np.float32), entry, np.log((weight + 1e-9) / weight.sum()).astype(np.float32))


SHAPES = {"E": (INPUTS, D), "Wq": (D, D), "Wk": (D, D), "Wv": (D, D), "Pq": (HALF, D), "Pk": (2 * HALF, D), "W": (D, HIDDEN), "c": (HIDDEN,), "U": (HIDDEN, CLASSES), "b": (CLASSES,)}


def start(vocab: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) / np.sqrt(s[0] if k != "E" else D)).astype(np.float32) for k, s in SHAPES.items()}
    p["U"] *= 0.1
    p["c"][:] = 0
    p["b"] = vocab.usual.copy()
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, a = {}, 0
    for k, s in SHAPES.items():
        out[k], a = v[a : a + int(np.prod(s))].reshape(s), a + int(np.prod(s))
    return out


def windows(docs: list[np.ndarray], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs (n, 2 HALF), targets (n, HALF), document (n,), tokens in the window (n,)).

    Input row 0 stands for the beginning of a text and -1 for padding; the input at a
    position is the token before it.
    """
    size = np.array([len(x) for x in docs])
    n = -(-size // HALF)
    first = np.concatenate([[0], np.cumsum(n + 1)])  # one block of padding before each text
    blocks = np.full((first[-1], HALF), -1, np.int32)
    target = np.zeros((first[-1], HALF), np.int64)
    text = np.concatenate(docs).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
    begin = (first[:-1] + 1) * HALF
    at = np.arange(len(text)) + np.repeat(begin - (np.cumsum(size) - size), size)
    target.ravel()[at] = text
    inner = at + 1 < np.repeat(begin + size, size)
    blocks.ravel()[at[inner] + 1] = vocab.entry[text[inner]]
    blocks.ravel()[begin[size > 0]] = 0
    i = np.setdiff1d(np.arange(first[-1]), first[:-1], assume_unique=True)
    doc = np.repeat(np.arange(len(docs)), n)
    k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    return np.concatenate([blocks[i - 1], blocks[i]], 1), target[i], doc, np.minimum(size[doc] - k * HALF, HALF)


class Model:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        e = np.concatenate([p["E"], np.zeros((1, D), np.float32)])  # the last row is padding's
        self.e, self.q, self.k, self.v = e, e @ p["Wq"], e @ p["Wk"], e @ p["Wv"]

    def forward(self, x: np.ndarray) -> tuple:
        """Exponentials of the logits of the scored positions, their sums and what the gradient needs."""
        p = self.p
        own = x[:, HALF:]
        q = self.q.take(own, axis=0)
        q += p["Pq"]
        q *= np.float32(D**-0.5)
        k = self.k.take(x, axis=0)
        k += p["Pk"]
        v = self.v.take(x, axis=0)
        s = q @ k.transpose(0, 2, 1)
        np.clip(s, -MOST, MOST, out=s)
        np.exp(s, out=s)
        s *= _MASK
        if (x < 0).any():
            s *= (x >= 0).astype(np.float32)[:, None, :]
        s /= (s @ _ONES[2 * HALF])[..., None]
        h = s @ v
        h += self.e.take(own, axis=0)
        z = h.reshape(-1, D) @ p["W"]
        z += p["c"]
        np.maximum(z, 0, out=z)
        y = z @ p["U"]
        y += p["b"]
        np.clip(y, -MOST, MOST, out=y)
        np.exp(y, out=y)
        return y, y @ _ONES[CLASSES], (own, q, k, v, s, h, z)

    def losses(self, x: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Negative log probability of the class at each scored position."""
        y, total, _ = self.forward(x)
        return np.log(total / y.ravel().take(np.arange(0, y.size, CLASSES) + kind.ravel())).reshape(kind.shape)

    def gradient(self, x: np.ndarray, kind: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean loss and its gradient; weight 0 takes a position out."""
        p = self.p
        y, total, (own, q, k, v, s, h, z) = self.forward(x)
        w = (weight / max(weight.sum(), 1)).ravel().astype(y.dtype)
        at, one = np.arange(0, y.size, CLASSES) + kind.ravel(), np.ones(len(y), y.dtype)
        loss = float(np.log(total / y.ravel().take(at)) @ w)
        y *= (w / total)[:, None]
        y.reshape(-1)[at] -= w
        g = {"U": z.T @ y, "b": one @ y}
        dz = y @ p["U"].T
        dz *= z > 0
        g["W"], g["c"] = h.reshape(-1, D).T @ dz, one @ dz
        dh = (dz @ p["W"].T).reshape(h.shape)
        ds = dh @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ dh
        ds *= s
        ds -= s * (ds @ np.ones(2 * HALF, ds.dtype))[..., None]
        dk = ds.transpose(0, 2, 1) @ q
        dq = ds @ k
        dq *= np.float32(D**-0.5)
        g["Pq"], g["Pk"] = dq.sum(0), dk.sum(0)
        flat_, e = (lambda d: d.reshape(-1, D)), self.e
        q_, k_, v_ = flat_(dq), flat_(dk), flat_(dv)
        to, all_ = flat_(e.take(own, axis=0)), flat_(e.take(x, axis=0))
        g["Wq"], g["Wk"], g["Wv"] = to.T @ q_, all_.T @ k_, all_.T @ v_
        de = (k_ @ p["Wk"].T + v_ @ p["Wv"].T).reshape(*x.shape, D)
        de[:, HALF:] += dh + (q_ @ p["Wq"].T).reshape(dh.shape)  # the scored positions are the window's second block
        at = (x.reshape(-1, 1).astype(np.int64) + 1) * D + np.arange(D)  # row 0 is padding's, which has no parameters
        g["E"] = np.bincount(at.ravel(), de.ravel(), (INPUTS + 1) * D)[D:].reshape(INPUTS, D).astype(p["E"].dtype)
        return loss, g


class Adam:
    """Parameters that take steps over documents' windows; the moments last over all calls."""

    def __init__(self, p: np.ndarray, vocab: Vocabulary, seed: int):
        self.p, self.vocab, self.rng = p, vocab, np.random.default_rng(seed)
        self.m, self.v, self.t, self.tokens = np.zeros_like(p), np.zeros_like(p), 0, 0

    def see(self, docs: list[np.ndarray]) -> None:
        """One pass over all windows of the documents."""
        x, target, _, size = windows(docs, self.vocab)
        weight = (np.arange(HALF) < size[:, None]).astype(np.float32)
        order = self.rng.permutation(len(x))
        for a in range(0, len(order), WINDOWS):
            i = order[a : a + WINDOWS]
            _, g = Model(shaped(self.p)).gradient(x[i], self.vocab.kind[target[i]], weight[i])
            g, self.t = flat(g), self.t + 1
            self.m += 0.1 * (g - self.m)
            self.v += 0.01 * (g * g - self.v)
            step = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + np.float32(1e-8))
            self.p = (self.p - np.float32(RATE) * step).astype(np.float32)
        self.tokens += int(size.sum())


def keep_memory() -> None:
    """Have this process keep the memory of freed arrays, rather than give it back and fault it in again each step.

    The C library gives memory back once the free part at its heap's end is twice the largest
    mapped block freed so far, at most 32 MB; so freeing one untouched block of 24 MB suffices.
    """
    np.empty(24 << 20, np.uint8)


def _average(t: pa.Table) -> pa.Table:
    w = t["w"].to_numpy().astype(np.float64)
    total = sum(k * np.frombuffer(x, np.float32) for k, x in zip(w, t["p"].to_pylist()))
    return pa.table({"p": pa.array([(total / max(w.sum(), 1)).astype(np.float32).tobytes()], pa.binary()), "w": pa.array([int(w.sum())])})


def runs(sizes: np.ndarray, most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs [a, z) of whole documents of about ``most`` tokens, so that working arrays stay small."""
    a, end = 0, np.cumsum(sizes)
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def part(tokens: DataFrame, r: int) -> DataFrame:
    """The documents of round ``r``; every document is in exactly one round."""
    return tokens.where((F.col("pick") >= r / ROUNDS) & (F.col("pick") < (r + 1) / ROUNDS))


def train(tokens: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, int]:
    """Parameters after ``ROUNDS`` rounds, which together see every document once, and the tokens seen."""
    p, seen = flat(start(vocab)), 0
    for r in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], p=p, r=r) -> Iterator[pa.RecordBatch]:
            keep_memory()
            held = Adam(p, vocab, r)
            for b in batches:
                docs = [d for d in (_ids(x.as_py()) for x in b.column("ids")) if len(d)]
                for a, z in runs(np.array([len(d) for d in docs], np.int64)):
                    held.see(docs[a:z])
            if held.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([held.p.tobytes()], pa.binary()), pa.array([held.tokens])], ["p", "w"])

        own = part(tokens, r).select("ids").mapInArrow(run, "p binary, w long")
        some = own.groupBy(F.pmod(F.xxhash64("p"), F.lit(16)).alias("g")).applyInArrow(_average, "p binary, w long")
        got = some.groupBy().applyInArrow(_average, "p binary, w long").first()
        if got is not None:
            p, seen = np.frombuffer(got["p"], np.float32), seen + got["w"]
    return p, seen


def score_docs(p: np.ndarray, docs: list[np.ndarray], vocab: Vocabulary, batch: int = 512) -> np.ndarray:
    """Total negative log probability of each document's tokens."""
    model, out = Model(shaped(p)), np.zeros(len(docs))
    x, target, doc, size = windows(docs, vocab)
    for a in range(0, len(x), batch):
        i = slice(a, a + batch)
        nll = model.losses(x[i], vocab.kind[target[i]]) - vocab.within[target[i]]
        nll[np.arange(HALF) >= size[i, None]] = 0
        out += np.bincount(doc[i], weights=nll.sum(1, dtype=np.float64), minlength=len(docs))
    return out


def scores(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, nll, perplexity) of every document, by a model of all documents.

    ``nll`` is the mean negative log probability (natural logarithm) of its tokens.

    * null and empty texts have no tokens: nll and perplexity are null; null ids are carried
    * repeated rows each give a row; an empty table gives an empty result
    * very long texts are scored whole, window by window; other columns are ignored
    * the model depends on how rows lie in partitions (as do all averages of local steps)
    """
    tokens = cut(tokenized(docs, path))
    seen = {r[0]: r[1] for r in counted(tokens).collect()}  # at most one row an id of the vocabulary
    counts = np.zeros(max([*seen, INPUTS * 2]) + 1)
    counts[list(seen)] = list(seen.values())
    vocab = vocabulary(counts)
    p, _ = train(tokens, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for b in batches:
            ids = [_ids(x.as_py()) for x in b.column("ids")]
            n = np.array([len(v) for v in ids], np.int64)
            nll = np.zeros(len(ids))
            for a, z in runs(n):
                nll[a:z] = score_docs(p, ids[a:z], vocab)
            mean = np.where(n > 0, nll / np.maximum(n, 1), np.nan)
            none = n == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(np.round(mean, 6), mask=none), pa.array(np.round(np.exp(np.minimum(mean, 700)), 4), mask=none)], ["doc_id", "n_tokens", "nll", "perplexity"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, nll double, perplexity double")
