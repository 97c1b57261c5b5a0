"""URL filtering by association rules.

A URL is a set of tokens: its lower-case runs of letters and digits, with each run of
digits as ``#``. Token sets that are frequent among bad labelled URLs are mined depth first
over the full token sets, one conditional table for each token, as in parallel FP-growth;
rules "tokens -> bad" are kept by support and confidence, and a rule is dropped if a rule
with fewer of its tokens is at least as confident. For matching,
an inverted index holds each rule under its rarest token; a URL looks up its tokens and
verifies the rules found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; a null URL has none."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]+", "#"), "[^\\p{L}#]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def grow(has: np.ndarray, n: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """(columns, URLs, bad URLs) of the token sets with at least ``least`` bad URLs.

    Row i of ``has`` stands for n[i] URLs, b[i] of them bad. A set with a subset of as many
    URLs, or with a subset that only bad URLs have, is left out with all that hold it: the
    subset is as confident, so no such set can stay as a rule.
    """
    stack = [((), np.arange(len(n)), np.arange(has.shape[1]))]
    while stack:
        items, rows, columns = stack.pop()
        here = has[np.ix_(rows, columns)]
        total, freq, hit = n[rows].sum(), n[rows] @ here, b[rows] @ here
        go = np.flatnonzero((hit >= least) & (freq < total))
        for k, c in enumerate(go):
            yield (*items, int(columns[c])), int(freq[c]), int(hit[c])
            if hit[c] < freq[c] and k + 1 < len(go):
                stack.append(((*items, int(columns[c])), rows[here[:, c]], columns[go[k + 1 :]]))


def mine(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float, max_tokens: int | None = None) -> DataFrame:
    """(rule, items, anchor, support, confidence) from (items, bad) rows.

    All tokens of a URL are mined, and supports and confidences are those of the table;
    ``max_tokens`` is taken for callers of before and has no effect.
    """
    n = labelled.count()
    least = max(min_support * n, min_count) - 1e-9
    single = cut(labelled.select(F.explode("items").alias("t"), "bad").groupBy("t").agg(F.count("*").alias("n"), F.sum("bad").alias("b")).where(F.col("b") >= least))
    if single.isEmpty():
        return labelled.sparkSession.createDataFrame([], "rule long, items array<string>, anchor string, support double, confidence double")
    ranked = cut(single.select("t", F.row_number().over(Window.orderBy(F.desc("n"), "t")).alias("k")))  # few: each has ``least`` bad URLs
    rows = labelled.select(F.monotonically_increasing_id().alias("id"), "items", "bad").select("id", "bad", F.explode("items").alias("t")).join(ranked, "t")
    sets = rows.groupBy("id", "bad").agg(F.sort_array(F.collect_list("k")).alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    # a set is mined under its rarest token, from the more frequent ones of the URLs that have it
    each = sets.select("s", "n", "b", F.posexplode("s").alias("at", "k"))
    under = each.groupBy("k", F.expr("slice(s, 1, at)").alias("s")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        have, urls, bad = t["s"].combine_chunks(), t["n"].to_numpy(), t["b"].to_numpy()
        values, column = np.unique(have.flatten().to_numpy(), return_inverse=True)
        has = np.zeros((len(urls), len(values)), bool)
        has[np.repeat(np.arange(len(urls)), have.value_lengths().to_numpy()), column] = True
        k, freq, hit = key[0].as_py(), int(urls.sum()), int(bad.sum())
        got = [((k,), freq, hit)]
        if hit < freq:
            got += [((k, *values[list(c)].tolist()), f, h) for c, f, h in grow(has, urls, bad, least)]
        got = [g for g in got if g[2] >= min_confidence * g[1]]
        return pa.table({"ks": pa.array([g[0] for g in got], pa.list_(pa.int32())), "freq": pa.array([g[1] for g in got], pa.int64()), "hit": pa.array([g[2] for g in got], pa.int64())})

    mined = under.groupBy("k").applyInArrow(run, "ks array<int>, freq long, hit long")
    named = mined.select(F.monotonically_increasing_id().alias("id"), "ks", "freq", "hit").select("id", "freq", "hit", F.explode("ks").alias("k")).join(ranked, "k")
    rules = named.groupBy("id", "freq", "hit").agg(F.sort_array(F.collect_list("t")).alias("items"))
    rules = cut(rules.select(F.xxhash64("items").alias("rule"), "items", (F.col("hit") / n).alias("support"), (F.col("hit") / F.col("freq")).alias("confidence")))
    rarest = rules.select("rule", F.explode("items").alias("t")).join(single, "t").groupBy("rule").agg(F.min(F.struct("n", "t")).alias("a")).select("rule", F.col("a.t").alias("anchor"))
    indexed = rules.join(rarest, "rule")
    wide = indexed.select(F.col("rule").alias("id"), "items", F.col("confidence").alias("own"))
    under = found(wide, indexed, "own").where("id != rule and confidence >= own").select(F.col("id").alias("rule")).distinct()
    return cut(indexed.join(under, "rule", "left_anti").select("rule", "items", "anchor", "support", "confidence"))


def found(urls: DataFrame, rules: DataFrame, *carry: str) -> DataFrame:
    """(id, rule, confidence, carried columns) for each rule all of whose tokens a row has."""
    each = urls.select("id", F.col("items").alias("have"), *carry, F.explode("items").alias("anchor"))
    hit = each.join(rules.select("rule", F.col("items").alias("want"), "anchor", "confidence"), "anchor")
    return hit.where(F.size(F.array_except("want", "have")) == 0).select("id", "rule", "confidence", *carry)


def filter_urls(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.5) -> DataFrame:
    """(page_id, n_rules, confidence, flagged) of every page.

    A page is labelled by the rows of ``labels`` with its id, bad if any has quality 0 or
    toxic 1. Labelled pages that repeat a URL count once, as bad if any of them is.

    * null or empty URLs have no tokens and are never flagged; null ids are carried
    * very long URLs: all of their tokens count; rules of equal confidence all stay, unless one
      holds another
    * null quality or toxic values say nothing; null ids of labels match no page
    * repeated pages each give a row; without labels or rules nothing is flagged
    * an empty table of pages gives an empty result; other columns are ignored
    """
    page = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    label = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    known = page.where("url is not null").join(label, "page_id").groupBy("url").agg(F.max("bad").alias("bad"))
    rules = mine(cut(known.select(tokens(F.col("url")).alias("items"), "bad")), min_support, min_count, min_confidence)
    urls = page.where("url is not null").groupBy(F.col("url").alias("id")).agg(F.lit(1).alias("one")).select("id", tokens(F.col("id")).alias("items"))
    hits = found(urls, rules).groupBy("id").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    got = page.join(hits, page["url"] == hits["id"], "left")
    return got.select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rules"), F.round(F.coalesce("c", F.lit(0.0)), 6).alias("confidence"), F.col("n").isNotNull().alias("flagged"))
