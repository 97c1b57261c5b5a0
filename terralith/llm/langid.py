"""Language identification in two levels: the family, then linear SVMs within it.

A document is a bag of byte trigrams of its lower-cased text (digits, punctuation and
white space count as one separator). One linear support vector machine for each family
decides the family; within it, one-versus-one machines vote for the language.

Training uses at most ``per_language`` labelled texts of each language (a documented bound;
the texts with the smallest hashes, so the choice doesn't depend on partitioning).
Prediction reads every byte of every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_of, utf8_buffers

FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "pl", "cs", "uk", "bg", "sk")}
UNKNOWN = "und"
BITS = 13

_LUT = np.full(256, 32, np.uint8)
_LUT[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LUT[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LUT[128:] = np.arange(128, 256)


@dataclass
class Model:
    """families: name -> languages; machines: (kind, positive, negative, weights, bias)."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: list[tuple] = field(default_factory=list)
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    coverage: float = 0.5

    def table(self) -> np.ndarray:
        """Which trigrams the training rows had, as a lookup table."""
        t = np.zeros(1 << 24, np.uint8)
        t[self.seen] = 1
        return t


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigram that begins at each byte: its 24-bit code and its hashed slot."""
    low = _LUT[raw].astype(np.int32)
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    slot = ((code.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    return code, slot


def _padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after another with one separator before, between and after them."""
    n = len(off) - 1
    new = off + np.arange(n + 1) + 1
    out = np.full(int(off[-1]) + n + 1, 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n) + 1, np.diff(off))] = raw
    return out, new


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Mean trigram vectors (scaled) and the sorted trigrams seen; for training only."""
    x, seen = np.zeros((len(texts), 1 << BITS), np.float32), []
    for i, t in enumerate(texts):
        raw = np.frombuffer((" " + (t or "") + " ").encode(), np.uint8)
        if len(raw) < 3:
            continue
        code, slot = _grams(raw)
        x[i] = np.bincount(slot, minlength=1 << BITS) / len(slot)
        seen.append(np.unique(code))
    return x * 100, (np.unique(np.concatenate(seen)).astype(np.int32) if seen else np.zeros(0, np.int32))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised, squared-hinge support vector machine."""
    n = len(y)
    w, b, a = np.zeros(x.shape[1], np.float64), 0.0, np.zeros(n)
    q = np.einsum("ij,ij->i", x, x) + 1 + 1 / (2 * c)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        change = 0.0
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w + b) - 1 + a[i] / (2 * c)
            new = max(a[i] - g / q[i], 0.0)
            if d := (new - a[i]) * y[i]:
                w += d * x[i]
                b += d
                change = max(change, abs(d))
            a[i] = new
        if change < 1e-4:
            break
    return w, b


def train(rows: list[tuple[str, str]], families: dict[str, tuple[str, ...]] | None = None, coverage: float = 0.5) -> Model:
    """A model of (language, text) rows. A language in no family is a family of its own."""
    rows = sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[0], r[1]))
    known = {lang: fam for fam, langs in (families or FAMILIES).items() for lang in langs}
    model = Model(coverage=coverage)
    for lang in sorted({r[0] for r in rows}):
        model.families.setdefault(known.get(lang, lang), []).append(lang)
    if not rows:
        return model
    x, model.seen = features([r[1] for r in rows])
    lang = np.array([r[0] for r in rows])
    fam = np.array([known.get(v, v) for v in lang])

    def fit(kind: str, pos: str, neg: str, use: np.ndarray, y: np.ndarray) -> None:
        w, b = linear_svm(x[use], np.where(y, 1.0, -1.0))
        model.machines.append((kind, pos, neg, (w * 100).astype(np.float32), float(b)))

    if len(model.families) > 1:
        for f in model.families:
            fit("family", f, "", np.ones(len(rows), bool), fam == f)
    for f, langs in model.families.items():
        for i, p in enumerate(langs):
            for n in langs[i + 1 :]:
                use = (lang == p) | (lang == n)
                fit(f, p, n, use, lang[use] == p)
    return model


def labelled_sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` different texts of each language: those with the smallest hashes.

    Texts alone decide, so null or repeated ids change nothing and copies count once. The
    first pass estimates the different texts of each language, which gives a hash bound that
    leaves a few more than needed; the second keeps, of the texts below it, the smallest
    within each partition and then of all. The driver gets no more than the bound.
    """
    t = docs.select(F.col("lang").cast("string").alias("l"), F.col("text").alias("t"), F.xxhash64("text").alias("h")).where("l is not null and l != '' and t is not null and t != ''")
    n = t.groupBy("l").agg(F.approx_count_distinct("h").alias("n"))
    bound = n.select("l", (F.lit(2.0**63) * F.least(F.lit(1.0), F.lit(1.3 * per_language + 20) / F.col("n"))).alias("b")).collect()
    if not bound:
        return []
    below = F.lit(False)
    for r in bound:
        below = below | ((F.col("l") == r["l"]) & (F.abs(F.col("h").cast("double")) <= float(r["b"])))
    once = t.where(below).groupBy("l", "h").agg(F.min("t").alias("t"))
    order = Window.partitionBy("l").orderBy("h")
    got = once.withColumn("i", F.row_number().over(order)).where(F.col("i") <= per_language).select("l", "t", "h").collect()
    return [(r["l"], r["t"]) for r in sorted(got, key=lambda r: (r["l"], r["h"], r["t"]))]


class Predictor:
    """Applies a model to Arrow string arrays; tables are built once in a Python worker."""

    def __init__(self, model: Model):
        self.model, self.seen, self.w = model, None, None

    def __getstate__(self):
        return {"model": self.model, "seen": None, "w": None}

    def scores(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: mean score of each machine, share of trigrams seen, letters or not."""
        m = self.model
        if self.seen is None:
            self.seen, self.w = m.table(), [k[3] for k in m.machines]
        n = len(off) - 1
        buf, new = _padded(raw, off)
        code, slot = _grams(buf)
        first, last = new[:-1] - 1, new[1:] - 2  # the trigrams of a row begin at [first, last)
        size = np.maximum(last - first, 1)

        def total(v: np.ndarray) -> np.ndarray:
            c = np.zeros(len(v) + 1)
            np.cumsum(v, out=c[1:], dtype=np.float64)
            return c[np.maximum(last, first)] - c[first]

        out = np.stack([total(w[slot]) / size + k[4] for w, k in zip(self.w, m.machines)], 1) if m.machines else np.zeros((n, 0))
        blank = total(code == 0x202020)
        filled = np.maximum(size - blank, 1)
        return out, total(self.seen[code]) / size, (total((code & 0xFF00) != 0x2000) > 0) & (filled > 0)

    def predict(self, array) -> tuple[list, list, np.ndarray]:
        raw, off = utf8_buffers(array)
        m, lang, fam, margin = self.model, [], [], []
        for a, b in groups_of(off, 2_000_000):
            s, cover, letters = self.scores(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            names = list(m.families)
            f = np.zeros(b - a, int)
            top = np.full(b - a, np.inf)
            if len(names) > 1:
                k = [i for i, x in enumerate(m.machines) if x[0] == "family"]
                f, top = s[:, k].argmax(1), s[:, k].max(1)
            best = np.array([""] * (b - a), object)
            for j, name in enumerate(names):
                langs, at = m.families[name], np.flatnonzero(f == j)
                votes, weight = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs)))
                for i, x in enumerate(m.machines):
                    if x[0] == name and x[2]:
                        p, q, v = langs.index(x[1]), langs.index(x[2]), s[at, i]
                        votes[:, p] += v >= 0
                        votes[:, q] += v < 0
                        weight[:, p] += v
                        weight[:, q] -= v
                pick = (votes + 0.5 * np.tanh(weight)).argmax(1) if len(at) else np.zeros(0, int)
                best[at] = np.array(langs, object)[pick]
                if len(langs) > 1:
                    top[at] = np.minimum(top[at], np.abs(weight[np.arange(len(at)), pick]))
            ok = letters & (cover >= m.coverage) & (len(names) > 0)
            lang += np.where(ok, best, UNKNOWN).tolist()
            fam += np.where(ok, np.array(names or [UNKNOWN], object)[f], UNKNOWN).tolist()
            margin.append(np.where(ok & np.isfinite(top), top, 0.0))
        return lang, fam, np.concatenate(margin) if margin else np.zeros(0)


def predicted(model: Model, text: Column) -> Column:
    """A struct column (language, family, margin) for a text column."""
    p = Predictor(model)

    @F.arrow_udf("language string, family string, margin double")
    def udf(t: pa.Array) -> pa.Array:
        lang, fam, margin = p.predict(t)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(fam, pa.string()), pa.array(np.round(margin, 6))], ["language", "family", "margin"])

    return udf(text)


def identify(docs: DataFrame, per_language: int = 300, families: dict[str, tuple[str, ...]] | None = None, coverage: float = 0.5) -> DataFrame:
    """(doc_id, language, family, margin, accepted) for every row of ``docs``.

    * null or empty text, or text without letters: language ``und``, not accepted
    * text of which fewer than ``coverage`` of the trigrams occur in training rows: ``und``
    * null ``lang``: the row isn't used for training, but is predicted
    * null or repeated ids and copies of a text don't change the choice of training rows
    * very long texts: all of their trigrams count, in groups of rows of about 2 MB
    * no labelled row at all: every row is ``und``; an empty table gives an empty result
    * repeated rows and ids: each row is predicted by itself; ties go to the earlier name
    * other columns are ignored, whatever their names
    """
    model = train(labelled_sample(docs, per_language), families, coverage)
    got = docs.select(F.col("doc_id"), predicted(model, F.col("text")).alias("p"))
    return got.select("doc_id", "p.language", "p.family", "p.margin", (F.col("p.language") != UNKNOWN).alias("accepted"))


def keep_known(docs: DataFrame, per_language: int = 300, coverage: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose language is known (see ``identify``)."""
    model = train(labelled_sample(docs, per_language), None, coverage)
    return docs.where(predicted(model, F.col("text"))["language"] != UNKNOWN)
