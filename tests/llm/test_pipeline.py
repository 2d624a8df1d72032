"""The pipeline and its stages against brute force on small tables, and the queries against their SQL."""

import random

import pytest
from test_operators import brute_components, brute_repeats, brute_sets, check_packing, near_copies, words

import corpus_pipeline
from trendlens.llm.queries import ORACLE, QUERIES
from trendlens.session import settle


def test_stages_against_brute_force(spark, folder):
    random.seed(2)
    shared = " ".join(random.choices([f"p{i}" for i in range(80)], k=60))
    texts = near_copies(11, 12) + [
        shared + " " + " ".join(random.choices([f"q{i}" for i in range(500)], k=50)) for _ in range(4)] + [shared, shared + " x"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, "s", 0), (901, "12 34 !", None, "s", 7), (902, "words without a label here", None, "s", 26)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    stage = dict(corpus_pipeline.STAGES)
    after = settle(stage["language"](spark, docs, folder))
    left = {r.doc_id: r.text for r in after.collect()}
    assert set(left) == {r[0] for r in rows} - {900, 901}
    assert after.where("lang is null").count() == 0

    sets = brute_sets(left)
    part = brute_components(left, [(a, b) for a in left for b in left if a < b and sets[a] and sets[b]
                                   and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    after = settle(stage["near duplicates"](spark, after, folder))
    left = {i: t for i, t in left.items() if part[i] == i}
    assert {r.doc_id: r.text for r in after.collect()} == left

    want = brute_repeats(left, 50)
    after = settle(stage["repeated passages"](spark, after, folder))
    got = {r.doc_id: r for r in after.collect()}
    assert set(got) == {i for i in left if want[i][0] == 0 or want[i][0] > want[i][1]}
    assert sum(want[i][1] > 0 for i in left) >= 3
    for i, r in got.items():
        assert len(words(r.text)) == want[i][0] - want[i][1] and r.n_chars == len(r.text)
        assert want[i][1] or r.text == left[i]
    assert after.columns == corpus_pipeline.COLUMNS
    texts = {i: r.text for i, r in got.items()}
    assert check_packing(stage["packing"](spark, after, folder).collect(), texts) < 0.02
    assert check_packing(corpus_pipeline.run(spark, folder).collect(), texts) < 0.02


def test_equal_ids_and_no_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = settle(spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11)], kind))
    stage = dict(corpus_pipeline.STAGES)
    assert sorted(str(r.doc_id) for r in stage["near duplicates"](spark, docs, "").collect()) == ["1", "None"]
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs.limit(0), "").count() == 0


def test_rows_of_one_id_with_different_texts_stay(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "en", "b", 1), (5, long, "en", "a", 1), (5, "another text altogether here", "en", "s", 1), (5, long + " more", "en", "s", 1),
            (2, long + " end", "en", "s", 1), (7, "!", "en", "s", 1), (7, "!", "en", "s", 1), (7, "?", "en", "s", 1), (None, long, "en", "s", 1)]
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, settle(spark.createDataFrame(rows, kind)), "")
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(
        [("2", long + " end"), ("5", "another text altogether here"), ("7", "!"), ("7", "?"), ("None", long)])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(str(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert mine == theirs


def test_queries_cover_the_operators(spark, sf):
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [
        "op1_bpe", "op2_vectors", "op3_chat", "op4_jaccard", "op5_language", "op6_packing", "op7_substrings", "op8_urls", "op9_warc",
        "op10_fingerprints", "op11_merkle", "op12_lines", "op13_resample"]
    pages = QUERIES["op8_urls"](spark, sf).collect()
    assert len(pages) == spark.read.parquet(f"{sf}/pages.parquet").count()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = QUERIES["op10_fingerprints"](spark, sf).collect()
    assert sorted(r.doc_id for r in prints) == sorted(r.doc_id for r in docs.collect())
    assert all((r.n_near is not None) == (r.doc_id % 100 == 0) for r in prints)
    assert QUERIES["op1_bpe"](spark, sf).count() == len(prints)
