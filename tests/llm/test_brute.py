"""Each operator against brute force, an exact tokenizer or held-out rows."""

import itertools
import random
import re
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from terralith.llm import attention_lm, decontam, html_blocks, langid, minhash, mixing, registry, token_fst, topk, url_rules
from tests.compare import SF, duck, same


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    same(registry.queries()[name](spark, SF), duck(), registry.oracle_sql()[name])


@pytest.mark.parametrize("max_tokens", [16])
def test_rules_by_enumeration(spark, max_tokens):
    rng = random.Random(3)
    words = ["buy", "cheap", "news", "free", "blog", "shop", "win"]
    rows = []
    for _ in range(200):
        have = [w for w in words if rng.random() < 0.4]
        rows.append((have, int({"buy", "cheap"} <= set(have) or "win" in have and rng.random() < 0.7)))
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, bad int"), 0.02, 5, 0.5, max_tokens).collect()
    found = {}
    for n in range(1, 8):
        for c in itertools.combinations(sorted(words), n):
            of = [bad for have, bad in rows if set(c) <= set(have)]
            if sum(of) >= 5 and sum(of) >= 0.5 * len(of):
                found[c] = sum(of) / len(of)
    want = {c: p for c, p in found.items() if not any(set(o) < set(c) and q >= p for o, q in found.items())}
    assert {tuple(sorted(r["items"])): pytest.approx(r["confidence"]) for r in got} == want
    assert all(r["anchor"] in r["items"] for r in got)


def test_rules_of_wide_urls(spark):
    """19 frequent tokens: a and b are bad only together, and each of the 17 others is worse than either."""
    wide = [f"c{i}" for i in range(17)]
    rows = [(["a"], 0)] * 100 + [(["b"], 0)] * 100 + [(["a", "b", *wide], 1)] * 60 + [(wide, int(i < 30)) for i in range(40)] + [(["a", "b"], 1)] * 10
    found = {}
    for n in range(1, 4):  # larger sets hold a smaller one that is as confident
        for c in itertools.combinations(sorted(["a", "b", *wide]), n):
            of = [bad for have, bad in rows if set(c) <= set(have)]
            if sum(of) >= 5 and sum(of) >= 0.5 * len(of):
                found[c] = sum(of) / len(of)
    want = {c: p for c, p in found.items() if not any(set(o) < set(c) and q >= p for o, q in found.items())}
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, bad int"), 0.002, 5, 0.5, 16).collect()
    assert want["a", "b"] == 1 and {tuple(r["items"]): pytest.approx(r["confidence"]) for r in got} == want


def test_tokens_are_the_tokenizers(texts):
    enc = attention_lm.encoding(token_fst.VOCABULARY)
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab 'sStrellve12\n\t.,é漢🙂  <|") for _ in range(rng.randrange(400))) for _ in range(300)]
    some = [*odd, "don't  we'll\n\n x", "a" * 3000, " " * 700, *texts.values()]
    assert token_fst.count_tokens(pa.array(some)).tolist() == [len(enc.encode_ordinary(t or "")) for t in some]


def test_chunks_do_not_matter():
    text = "it's  a\n\ttest 12 of 'll chunks   "
    cp = np.frombuffer((text * 9).encode("utf-32-le"), np.uint32)
    sym, first = token_fst.symbols(cp, np.array([0, len(cp)])), np.array([0, len(cp)])
    assert all((token_fst.boundaries(sym, first, c) == token_fst.boundaries(sym, first, 10_000)).all() for c in (1, 2, 3, 7, 64))


def test_blocks():
    prose = "This is the main part of the story and it was told by a man who had been there with his friends for years. " * 3
    page = f"<html><head><title>t</title></head><body><ul><li><a href=x>Home</a></li></ul><h1>A title</h1><p>{prose}</p><p>Short one.</p><p>{prose}</p><div><a href=y>next page of links</a></div><p>Copyright</p></body></html>"
    text, _, good = html_blocks.extract_page(page)
    assert text.split("\n") == ["A title", prose.strip(), "Short one.", prose.strip()] and good == 4


@pytest.mark.parametrize("open_", ["<head><title>t</title><body>", "<head><meta charset=x><title>t</title>", "<head></head><svg viewBox=x><path d=y>", "<svg/>", "<noscript><img src=x>", "<template>"])
def test_unclosed_elements_leave_the_page(open_):
    prose = "This is the main part of the story and it was told by a man who had been there with his friends for years. " * 3
    assert html_blocks.extract_page(f"<html>{open_}<p>{prose}</p>") == (prose.strip(), 1, 1)
    closed = "<svg><text>x</text></svg><noscript>no</noscript><template><p>t</p></template>"
    assert html_blocks.extract_page(f"<html><head><title>t</title></head><body>{closed}<p>{prose}</p>") == (prose.strip(), 1, 1)


def test_raking_meets_targets():
    import pandas as pd

    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, x, t, int(rng.integers(10, 999))) for s in "abc" for x in ("en", "de") for t in ("p", "q")], columns=["source", "lang", "topic", "tokens"])
    aims = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    got = mixing.rake(cells, aims, 0.8, 100)
    w = got.tokens * got.probability
    for axis, aim in aims.items():
        share = w.groupby(got[axis]).sum() / w.sum()
        assert all(abs(share[k] - v) < 1e-6 for k, v in aim.items())


def _jaccard(texts):
    sets = {}
    for i, t in texts.items():
        raw = np.frombuffer((t or "").encode(), np.uint8)
        sets[i] = set(minhash.shingles(raw, np.array([0, len(raw)]))[0].tolist())
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]}


def test_near_duplicates_by_all_pairs(spark, texts):
    sim = _jaccard(texts)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = {i: i for i in texts} | {r.doc_id: r.duplicate_of for r in minhash.near_duplicates(docs).collect()}
    true = [p for p, s in sim.items() if s >= 0.55]
    assert true and sum(keep[a] == keep[b] for a, b in true) >= 0.9 * len(true)
    for i, k in keep.items():
        assert i == k or max(s for p, s in sim.items() if i in p) >= 0.4
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {i for i, k in keep.items() if i == k}


def test_pairs_about_the_threshold(spark):
    """Sketches alone can't tell pairs of 0.47 from pairs of 0.53; their shingles can."""
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(160):
        shared, own = some(102), 44 if i % 2 else 56
        rows += [(2 * i, " ".join(shared + some(own))), (2 * i + 1, " ".join(shared + some(own)))]
    got = {(r.duplicate_of, r.doc_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sim = _jaccard(dict(rows))
    want = {p for p, s in sim.items() if s >= 0.5}
    assert len(want) == 80 and got <= want and len(got) >= 0.97 * len(want)


def test_components_are_exhaustive():
    rng = np.random.default_rng(2)
    sig = np.concatenate([np.tile(rng.integers(0, 256, (1, 128)), (100, 1)), rng.integers(0, 256, (30, 128)), np.tile(rng.integers(0, 256, (1, 128)), (7, 1))]).astype(np.uint8)
    label = minhash.components(sig, 0.5)
    assert len(set(label[:100])) == len(set(label[130:])) == 1 and len(set(label)) == 32


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and length(text) > 60 and lang is not null")
    rows = [(r.lang, r.text) for r in docs.orderBy("doc_id").collect()]
    got = langid.Predictor(langid.train(rows[::2][:400])).predict(pa.array([t for _, t in rows[1::2]]))[0]
    known = [(g, x) for g, (x, _) in zip(got, rows[1::2]) if g != langid.UNKNOWN]
    assert len(known) >= 0.9 * len(got) and np.mean([g == x for g, x in known]) > 0.97


def test_top_k_by_sorting(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((300, 3)), 1)
    x[100:140] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.rint(u @ u.T * topk.UNIT)
    want = {(i, j, r) for i in range(300) for r, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5], 1)}
    got = {(r.vec_id, r.neighbor_id, r.rank) for r in topk.top_k(df, k=5, block=64).collect()}
    assert len(got & want) >= 0.999 * len(want) and len(got) == len(want)  # products may differ in the last bit


def test_gradient_and_scores():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 300, n).astype(np.uint16) for n in (1, 16, 17, 70)]
    vocab = attention_lm.vocabulary(np.bincount(np.concatenate(docs), minlength=5000).astype(float))
    p = attention_lm.flat(attention_lm.start(vocab)).astype(np.float64)
    x, target, doc, size = attention_lm.windows(docs, vocab)
    assert np.bincount(doc, weights=size).tolist() == [1, 16, 17, 70]  # each token is scored once
    weight, kind = (np.arange(attention_lm.HALF) < size[:, None]).astype(float), vocab.kind[target]
    _, g = attention_lm.Model(attention_lm.shaped(p)).gradient(x, kind, weight)
    g = attention_lm.flat(g)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 12, replace=False):
        step = np.zeros_like(p)
        step[i] = 1e-5
        up, down = (attention_lm.Model(attention_lm.shaped(p + d)).gradient(x, kind, weight)[0] for d in (step, -step))
        assert (up - down) / 2e-5 == pytest.approx(g[i], rel=0.02, abs=2e-4)
    alone = [attention_lm.score_docs(p.astype(np.float32), [d], vocab)[0] for d in docs]
    assert attention_lm.score_docs(p.astype(np.float32), docs, vocab, batch=3) == pytest.approx(alone, rel=1e-4)  # no document sees another


def test_scores_beat_token_frequencies(spark, texts):
    got = attention_lm.scores(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    enc = attention_lm.encoding(attention_lm.VOCABULARY)
    n = Counter(i for t in texts.values() for i in enc.encode_ordinary(t or ""))
    total = sum(n.values())
    entropy = -sum(k / total * np.log(k / total) for k in n.values())
    assert sum(r.nll * r.n_tokens for r in got if r.n_tokens) / total < entropy - 0.3
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(enc.encode_ordinary(t or "")) for i, t in texts.items()}


def test_training_sees_every_document_once(spark):
    """More than 3M tokens, of which a million a round were seen before."""
    rows = [(i, (i * 7919 % 4000) / 4000, np.full(1000 + i % 7, i % 50, np.uint16).tobytes()) for i in range(4000)]
    tokens = spark.createDataFrame(rows, "doc_id long, pick double, ids binary").repartition(8)
    parts = [{r.doc_id for r in attention_lm.part(tokens, r).collect()} for r in range(attention_lm.ROUNDS)]
    assert sum(map(len, parts)) == 4000 and set().union(*parts) == set(range(4000))
    assert attention_lm.train(tokens, attention_lm.vocabulary(np.ones(5000)))[1] == sum(len(x) // 2 for _, _, x in rows)


def _least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        old, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return min(row)


def test_edit_matching_by_full_tables():
    rng = random.Random(8)
    items = [(i, "".join(rng.choice("abcd efg") for _ in range(rng.randrange(30, 90)))) for i in range(6)]
    matcher = decontam.Matcher(items, rate=0.1)
    for _ in range(60):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        text = "".join(rng.choice("abcd efg") for _ in range(40)) + "".join(t) + "tail of it"
        norm = decontam.normal(text)
        want = {i: d for i, s in items if (d := _least_distance(decontam.normal(s), norm)) <= int(0.1 * len(decontam.normal(s)))}
        assert {i: d for i, d, _ in matcher.find(text)} == want


def test_pipeline_by_its_parts(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    language = {r.doc_id for r in langid.identify(docs).where("accepted").collect()}
    first = corpus_pipeline.language_id(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == language
    second = corpus_pipeline.near_dedup(spark, first, SF)
    assert {r.doc_id for r in second.collect()} == language - {r.doc_id for r in minhash.near_duplicates(first).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontam.Matcher(items)
    third = corpus_pipeline.decontaminate(spark, second, SF)
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect() if not matcher.find(r.text)}
    fourth = {r.doc_id for r in corpus_pipeline.mix(spark, third, SF).collect()}
    assert fourth == {r.doc_id for r in mixing.sampled(third).collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == fourth and [n for n, _ in corpus_pipeline.STAGES][1] == "near_dedup"


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i])
def test_training_rows_of_null_and_repeated_ids(spark, ids):
    """The choice goes by texts: it is the same for any ids, bounded, and counts copies once."""
    rows = [(ids(i), ["en", "de"][i % 2], f"text number {i // 2 % 20_000} of {i % 2}") for i in range(50_000)] + [(ids(i), "fr", "la même phrase") for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(8)
    got = langid.labelled_sample(df, 300)
    assert Counter(lang for lang, _ in got) == {"en": 300, "de": 300, "fr": 1} and len(set(got)) == 601
    assert got == langid.labelled_sample(df.withColumn("doc_id", spark.range(1).select("id").first()[0] + df["doc_id"]), 300)


def test_known_rows_stay_whatever_their_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r.text or "") for r in langid.keep_known(docs).collect())
    for other in (docs.withColumn("doc_id", docs["doc_id"] * 0), docs.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars")):
        assert sorted((r.text or "") for r in langid.keep_known(other).collect()) == want and want


def test_short_items_match_as_whole_words():
    m = decontam.Matcher([(1, "cat sat"), (2, "Yes"), (3, "a b"), (4, ""), (5, None), (6, " \n ")])
    assert {i for i, _, _ in m.find("the CAT  sat. yesterday a bc")} == {1}
    assert {i: e for i, _, e in m.find("concat sat, a b; yes")} == {3: 15, 2: 20} and m.find("concat satin") == []


def test_shards_of_a_benchmark(spark, monkeypatch, texts):
    """The same rows from one shard and from many; an item longer than a shard stays whole."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(4000))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "before " + long.replace("w77 ", "w7 ") + " after")], "doc_id long, text string"))
    bench = bench.select("item_id", "text").unionByName(spark.createDataFrame([(-1, long)], "item_id long, text string"))
    want = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "SHARD", 2000)
    assert len(decontam._shards(bench, decontam.RATE, decontam.LEAST)) > 5
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == want and (-1, -1, 1) in {r[:3] for r in want}


def test_top_k_of_every_20th(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 8)).round(1)
    x[3] = x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    all_ = {tuple(r) for r in topk.top_k(df, k=7, block=50, groups=3).collect()}
    some = {tuple(r) for r in topk.top_k(df, k=7, query=topk.every_20th(), block=10, groups=5).collect()}
    assert len(all_) == 3500 and some == {r for r in all_ if r[0] % 20 == 0}


@pytest.mark.parametrize("page", ["<a " * 200_000, "<p>x" + "<b" * 200_000, "</script " * 100_000, "<svg>" * 50_000 + "</svg>", "<!" * 100_000 + "x>", "<script>" + "</script " * 50_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_blocks.extract_page(page)
    assert time.process_time() - began < 3


def test_second_pass_by_definition():
    """All label sequences of up to six blocks, each block decided by looking outwards from it."""

    def decided(labels, i):
        def look(order):
            near = False
            for j in order:
                if labels[j] in ("good", "bad"):
                    return labels[j], near
                near |= labels[j] == "near"
            return "bad", near

        (left, left_near), (right, right_near) = look(range(i - 1, -1, -1)), look(range(i + 1, len(labels)))
        if labels[i] in ("good", "bad"):
            return labels[i]
        if labels[i] == "near":
            return "bad" if left == right == "bad" else "good"
        return left if left == right else "good" if (left_near if left == "bad" else right_near) else "bad"

    for n in range(7):
        for labels in itertools.product(("good", "bad", "short", "near"), repeat=n):
            assert html_blocks.second_pass(list(labels)) == [decided(labels, i) for i in range(n)]


def test_first_pass_by_definition(spark):
    """Blocks of the given pages, classed from the published thresholds by plain counting."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        for text, links, _ in html_blocks.blocks(r.html):
            words = re.findall(r"\w+", text.lower())
            share = len([w for w in words if w in html_blocks.STOP_WORDS]) / max(len(words), 1)
            want = "bad" if links > 0.2 * len(text) or "©" in text else ("bad" if links else "short") if len(text) < 70 else "bad" if share < 0.1 else "near" if share < 0.2 or len(text) <= 200 else "good"
            assert html_blocks.first_pass(text, links) == want


def test_trees_follow_from_the_recall():
    assert [minhash.trees_for(r, 0.5, 4) for r in (0.5, 0.9, 0.997)] == [2, 7, 16] and minhash.trees_for(0.9, 0.5, 1) == 3
    rng = np.random.default_rng(12)
    together = 0
    for _ in range(300):  # pairs of similarity 0.5, followed through one tree of three levels
        a = rng.integers(0, 1 << 32, minhash.SIZE, np.uint64).astype(np.uint32)
        b = np.where(rng.random(minhash.SIZE) < 0.5, a, a + 1)
        nodes = {int(rng.integers(1 << 62))}
        for level in (1, 2, 3):
            paths = np.array(sorted(nodes), np.int64)
            x, y = (set(minhash.children(paths, np.tile(s, (len(paths), 1)), 0.5, level)[1].tolist()) if len(paths) else set() for s in (a, b))
            nodes = x & y
        together += bool(nodes)
    assert together / 300 == pytest.approx(minhash.survival(0.5, 0.5, 3), abs=0.1)


def test_blocks_of_a_large_node_hold_every_pair(spark):
    rows = [(1, v, 90) for v in range(90)] + [(2, v, 5) for v in range(5)]
    got = minhash.in_blocks(spark.createDataFrame(rows, "path long, vid long, n long"), 20).collect()
    by = {}
    for r in got:
        by.setdefault(r.path, set()).add(r.vid)
    assert by.pop(2) == set(range(5)) and max(map(len, by.values())) < 70 and len(by) == 15
    assert {p for m in by.values() for p in itertools.combinations(sorted(m), 2)} == set(itertools.combinations(range(90), 2))


def test_states_are_forgotten_without_a_change(monkeypatch, texts):
    some = pa.array([*texts.values(), "".join(random.Random(1).choice("abcdefghij") for _ in range(5000))])
    want = token_fst.count_tokens(some).tolist()
    monkeypatch.setattr(token_fst, "MOST_STATES", 50)
    assert token_fst.count_tokens(some).tolist() == want


def test_count_maps_compose_over_any_chunks(texts):
    """The counts are the same for chunks of one byte, of a few and of more than the text; pieces may span many."""
    counter = token_fst.load(token_fst.VOCABULARY)
    rng = random.Random(11)
    text = ("x" * 700 + " don't " + "".join(rng.choice("abcdeé漢 .,1'") for _ in range(900)) + "é" * 333).encode()
    buf = np.frombuffer(text, np.uint8)
    cp = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.array([0, len(cp)])
    begins = np.zeros(len(buf), bool)
    begins[place[token_fst.boundaries(token_fst.symbols(cp, first), first)]] = True
    want = len(attention_lm.encoding(token_fst.VOCABULARY).encode_ordinary(text.decode()))
    changes = [counter.count(buf, begins, c) for c in (1, 2, 7, 64, 256, 10_000)]
    assert all(c.sum() == want and (c == changes[0]).all() for c in changes)


FAULTS = """
import resource
import numpy as np
from terralith.llm import attention_lm
{}
def step():
    return [np.ones(n, np.uint8) for n in (7 << 20, 6 << 20, 5 << 20)]
for _ in range(3):
    step()
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(20):
    step()
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""


def test_freed_arrays_stay_with_the_process():
    """A step's arrays of 18 MB have 4,608 pages, which were faulted in again by each step."""
    without, with_ = (int(subprocess.run([sys.executable, "-c", FAULTS.format(x)], capture_output=True, check=True, text=True).stdout) for x in ("", "attention_lm.keep_memory()"))
    assert with_ < 4608 < without
