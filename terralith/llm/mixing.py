"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Raking scales the cells' token
counts until the shares of every source, language and topic meet their targets; each
document is then kept with its cell's probability, the cell's factor over the largest
factor. Expected kept tokens therefore meet all three sets of targets at once.

The cells, not the documents, go through the fitting: one Spark aggregation makes them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

AXES = ("source", "lang", "topic")
NONE = "(none)"
ALPHA = 0.8
ROUNDS = 30
SEED = "mix-1"
BROADCAST_ROWS = 200_000

# The topic of a document: the first rule one of whose marks the text holds, else prose.
TOPICS = (("legal", ("License", "rights reserved")), ("contact", ("@",)), ("code", (' = "', "{")), ("tabular", ("|",)))
PROSE = "prose"


def topic_of(text: Column) -> Column:
    out = F.lit(PROSE)
    for name, marks in reversed(TOPICS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | text.contains(m)
        out = F.when(hit, name).otherwise(out)
    return F.when(text.isNull() | (text == ""), NONE).otherwise(out)


def tokens_of(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def uniform(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone (on the text where there is no id)."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None, alpha: float, rounds: int) -> pd.DataFrame:
    """Adds ``probability`` to cells with ``tokens``.

    Without a target an axis gets shares in proportion to its tokens to the power ``alpha``.
    A value without a target (or with one of 0) isn't kept; a target of a value that has no
    tokens can't be met and is left out, and the others are scaled to sum to 1.
    """
    t = cells["tokens"].to_numpy(float)
    w = t.copy()
    aims = {}
    for axis in AXES:
        total = cells.groupby(axis)["tokens"].sum()
        given = (targets or {}).get(axis)
        aim = total.astype(float) ** alpha if given is None else pd.Series({k: float(given.get(k, 0.0)) for k in total.index})
        aim = aim.where(total > 0, 0.0)
        aims[axis] = cells[axis].map(aim / aim.sum() if aim.sum() > 0 else aim).to_numpy(float)
    keys = {axis: cells[axis].to_numpy() for axis in AXES}
    for _ in range(rounds):
        for axis in AXES:
            now = pd.Series(w).groupby(keys[axis]).transform("sum").to_numpy()
            w = w * (aims[axis] * (now > 0)) / (now + (now <= 0))
    f = w / (t + (t <= 0))
    return cells.assign(probability=f / f.max() if len(f) and f.max() > 0 else 0.0)


def _cell_columns(docs: DataFrame, topic: Column | None) -> list[Column]:
    text = F.col("text")
    return [F.coalesce(F.col("source").cast("string"), F.lit(NONE)), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), F.coalesce(topic_of(text) if topic is None else topic, F.lit(NONE))]


def fitted(cells: DataFrame, targets=None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, probability); one task fits all cells, which are few."""
    one = cells.groupBy().applyInPandas(lambda p: rake(p, targets, alpha, rounds), "source string, lang string, topic string, tokens long, probability double")
    return cut(one)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, by count; otherwise Spark chooses the join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, seed: str = SEED, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability) of the documents that are drawn.

    * a null source or language, and a null or empty text's topic, are the value "(none)"
    * very long texts: all of their words count; cells that tie share one probability
    * texts without words have no tokens and are never drawn
    * repeated rows and ids are drawn together; rows without an id draw by their text
    * an empty table gives an empty result; other columns are ignored, whatever their names
    """
    s, l, t = _cell_columns(docs, topic)
    rows = cut(docs.select(F.col("doc_id").alias("doc_id"), s.alias("source"), l.alias("lang"), t.alias("topic"), tokens_of(F.col("text")).alias("tokens"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u")))
    cells = rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    p = _small(fitted(cells, targets, alpha, rounds).select(*AXES, "probability"))
    got = rows.join(p, list(AXES)).where("tokens > 0 and u < probability")
    return got.select("doc_id", *AXES, "tokens", F.round("probability", 9).alias("probability"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, seed: str = SEED, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn (see ``sampled``), columns as they are."""
    names = ["__s", "__l", "__t", "__n", "__p"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    s, l, t, n, p = names
    a, b, c = _cell_columns(docs, topic)
    cells = docs.select(a.alias("source"), b.alias("lang"), c.alias("topic"), tokens_of(F.col("text")).alias("tokens")).groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    prob = _small(fitted(cells, targets, alpha, rounds).select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("probability").alias(p)))
    keyed = docs.withColumns({s: a, l: b, t: c})
    got = keyed.join(prob, [s, l, t]).where((uniform(F.col("doc_id"), F.col("text"), seed) < F.col(p)) & F.col("text").rlike(r"[^ \t\n\r\f]"))
    return got.select(*[F.col(f"`{x}`") for x in docs.columns])


def _case(text: str) -> str:
    out = "".join(f" WHEN {' OR '.join(f'contains({text}, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{name}'" for name, marks in TOPICS)
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN '{NONE}'{out} ELSE '{PROSE}' END"


def sampled_sql(alpha: float = ALPHA, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """``sampled`` without targets, in DuckDB's SQL."""

    def step(inner: str, axis: str, aim: str) -> str:
        return f"SELECT i, source, lang, topic, tokens, a1, a2, a3, CASE WHEN sum(w) OVER (PARTITION BY {axis}) > 0 THEN w * {aim} / sum(w) OVER (PARTITION BY {axis}) ELSE 0 END AS w FROM ({inner})"

    body = step(step(step("SELECT i + 1 AS i, source, lang, topic, tokens, a1, a2, a3, w FROM fit WHERE i < " + str(rounds), "source", "a1"), "lang", "a2"), "topic", "a3")
    marg = ", ".join(f"m{i} AS (SELECT {x}, v / sum(v) OVER () AS a FROM (SELECT {x}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {alpha}) ELSE 0 END AS v FROM cells GROUP BY 1))" for i, x in enumerate(AXES, 1))
    return f"""WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {_case('text')} AS topic,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS tokens,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows_ GROUP BY ALL), {marg},
fit AS (SELECT 0 AS i, c.source, c.lang, c.topic, c.tokens, m1.a AS a1, m2.a AS a2, m3.a AS a3, c.tokens::DOUBLE AS w
    FROM cells c JOIN m1 USING (source) JOIN m2 USING (lang) JOIN m3 USING (topic) UNION ALL ({body})),
p AS (SELECT source, lang, topic, f / max(f) OVER () AS probability FROM (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS f FROM fit WHERE i = {rounds}))
SELECT doc_id, source, lang, topic, tokens, round(probability, 9) AS probability FROM rows_ JOIN p USING (source, lang, topic) WHERE tokens > 0 AND u < probability"""
