"""Nulls, empty and very long texts, repeats, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from terralith.llm import attention_lm, chat, decontam, html_blocks, langid, minhash, mixing, token_fst, topk, url_rules

EN = "the quick brown fox jumps over the lazy dog and runs into the dark forest near the old river bank while birds sing"
DE = "der schnelle braune fuchs springt ueber den faulen hund und laeuft in den dunklen wald an dem alten fluss entlang"
LONG = " ".join(f"{w}{i % 97}" for i in range(1500) for w in EN.split())
PROSE = " ".join([EN] * 5000)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, vid long, sig string, path string, u double, language string, tokens long, probability double, item_id long, n int"
ROWS = [(1, EN, "en", "a"), (2, DE, "de", "b"), (3, None, "en", "a"), (4, "", "en", None), (5, LONG, "en", "a"), (None, EN + " indeed", None, None), (7, "  \n\t ", "de", "b"), (1, EN, "en", "a"), (8, "ß é 漢字 🙂 <|endoftext|>", None, "b"), (9, EN, "en", "b")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0, 1, "x", "y", 0.5, "zz", 3, 0.1, 4, 9) for r in rows], DOCS)


BENCH = [(10, EN), (10, EN), (None, DE), (11, None), (12, ""), (13, "short")]


def bench(spark, rows=BENCH):
    return spark.createDataFrame([(*r, 1, 1) for r in rows], "item_id long, text string, doc_id long, end_at int")


BY_DOC = {"op2": token_fst.token_counts, "op7": langid.identify, "op9": attention_lm.scores}


@pytest.mark.parametrize("name", BY_DOC)
def test_one_row_for_each_document(spark, name):
    got = BY_DOC[name](docs(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert BY_DOC[name](docs(spark, [])).collect() == []


def test_values_on_odd_rows(spark):
    n = {r.doc_id: r.n_tokens for r in token_fst.token_counts(docs(spark)).collect()}
    assert n[3] == n[4] == 0 and n[5] > 30_000
    lang = {r.doc_id: (r.language, r.accepted) for r in langid.identify(docs(spark)).collect()}
    assert lang[3] == lang[4] == lang[7] == ("und", False) and lang[1] == ("en", True) and lang[2] == ("de", True)
    s = {r.doc_id: r for r in attention_lm.scores(docs(spark)).collect()}
    assert s[3].nll is None and s[4].perplexity is None and s[5].nll > 0
    assert all(r.language == "und" for r in langid.identify(docs(spark, [(1, EN, None, None)])).collect())


def test_near_duplicates(spark):
    got = {(r.doc_id, r.duplicate_of) for r in minhash.near_duplicates(docs(spark)).collect()}
    assert got == {(9, 1), (None, 1)}
    kept = minhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8]
    assert minhash.near_duplicates(docs(spark, [])).collect() == minhash.keep_one(docs(spark, [])).collect() == []


def test_decontamination(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None, r.distance) for r in decontam.contaminated(docs(spark), bench(spark)).collect())
    assert got == [(False, 1, False, 0), (False, 1, False, 0), (False, 2, True, 0), (False, 9, False, 0), (True, 0, False, 0)]
    kept = decontam.without_benchmark(docs(spark), bench(spark))
    assert kept.columns == docs(spark).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 8]
    assert decontam.contaminated(docs(spark, []), bench(spark)).collect() == decontam.contaminated(docs(spark), bench(spark, [])).collect() == []
    assert decontam.without_benchmark(docs(spark), bench(spark, [])).count() == len(ROWS)


def test_mixing(spark):
    got = mixing.sampled(docs(spark)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 5, 8, 9, None} and all(0 < r.probability <= 1 for r in got)
    again = mixing.mixed(docs(spark))
    assert again.columns == docs(spark).columns and sorted(str(r.doc_id) for r in again.collect()) == sorted(str(r.doc_id) for r in got)
    assert mixing.sampled(docs(spark, [])).collect() == mixing.mixed(docs(spark, [])).collect() == []


def test_chat(spark):
    kind = "conv_id long, turn int, role string, text string, ts string, i int"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (1, 2, None, None), (1, 3, "assistant", None), (2, None, "assistant", LONG), (None, 0, "assistant", "lost"), (3, 0, "user", "alone")]
    got = sorted(chat.expand(spark.createDataFrame([(*r, "t", 1) for r in rows], kind)).collect())
    assert [(r.conv_id, r.turn, r.context_turns, len(r.reply)) for r in got] == [(1, 1, 1, 3), (1, 3, 3, 0), (2, None, 0, len(LONG))]
    assert all((r.prompt + r.reply)[r.train_from : r.train_to] == r.reply for r in got)
    assert got[1].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|unknown|>\n<|end|>\n<|assistant|>\n"
    assert chat.expand(spark.createDataFrame([], kind)).collect() == []


def test_html(spark):
    kind = "page_id long, url string, html string, text string, n_good int"
    rows = [(1, None), (2, ""), (None, "<p>x"), (3, "<script>never ends"), (4, f"<p>{PROSE}</p>"), (4, f"<p>{PROSE}</p>"), (5, "<<<>>&&;</p")]
    got = html_blocks.extract(spark.createDataFrame([(i, "u", h, "t", 1) for i, h in rows], kind)).collect()
    assert len(got) == len(rows) and {r.page_id: r.n_blocks for r in got}[3] == 0
    assert [r.text for r in got if r.page_id == 4] == [PROSE, PROSE] and html_blocks.extract(spark.createDataFrame([], kind)).collect() == []


def test_urls(spark):
    kind = "page_id long, url string, n int, items string, bad int"
    urls = [(i, f"http://{'spam' if i % 4 == 1 else 'news'}.example/{i}") for i in range(40)] + [(None, "http://spam.example/a"), (90, None), (91, ""), (92, "http://spam.example/" + "x/" * 5000), (1, "http://spam.example/1")]
    pages = spark.createDataFrame([(*r, 1, "i", 1) for r in urls], kind)
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(40)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = url_rules.filter_urls(pages, labels).collect()
    flagged = {r.page_id for r in got if r.flagged}
    assert len(got) == len(urls) and flagged == {*range(1, 40, 4), None, 92}
    assert url_rules.filter_urls(pages.where("false"), labels).collect() == []
    assert not any(r.flagged for r in url_rules.filter_urls(pages, labels.where("false")).collect())


def test_top_k(spark):
    kind = "vec_id long, embedding array<double>, dim int, s string, rank int"
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (None, [1.0, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], kind)
    got = topk.top_k(df, k=2)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1, 1.0), (1, 3, 2, 0.0), (2, 1, 1, 1.0), (2, 3, 2, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]
    assert topk.top_k(df.where(F.lit(False))).collect() == []


def test_pipeline(spark, tmp_path):
    """Odd rows, an empty table and clashing columns go through all stages; only the last stage's folder stays."""
    import corpus_pipeline

    bench(spark).drop("doc_id", "end_at").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("odd", ROWS), ("none", [])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "benchmark.parquet").symlink_to(tmp_path / "benchmark.parquet")
        docs(spark, rows).write.parquet(str(folder / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(folder))
        assert got.columns == docs(spark).columns
        assert {r.doc_id for r in got.collect()} <= {5, 8} and (rows or got.isEmpty())
    stages = [p.name for p in __import__("pathlib").Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("pipeline-*/*")]
    assert set(stages) == {"mix"}


def test_known_rows_of_odd_tables(spark):
    got = langid.keep_known(docs(spark))
    assert got.columns == docs(spark).columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "2", "5", "9", "None"]
    assert langid.keep_known(docs(spark, [])).collect() == []


def test_rules_that_tie(spark):
    """Two tokens that only come together make two rules of equal confidence; neither holds the other."""
    rows = [(["a", "b"], 1)] * 6 + [(["c"], 0)] * 6
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, bad int"), 0.01, 5, 0.5).collect()
    assert sorted((r["items"], r["confidence"]) for r in got) == [(["a"], 1.0), (["b"], 1.0)]
