"""The pipeline's stages against brute force on a small corpus, and the registered queries against SQL."""

import random

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402
from arboretica.llm.quality import judge_quality  # noqa: E402
from test_text_operators import around_the_threshold, shingle_components  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["the", "of", "and", "it", "was"] * 20 + ["stone%d" % k for k in range(900)]
    clean = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i], "en", "s", 0) for i in range(5)]  # exact copies
    rows += [(200 + i, clean[10 + i].replace("stone7 ", "stone8 ", 1) + " end", "en", "s", 0) for i in range(5)]  # near copies
    rows += [(300 + i, clean[20 + i] + "\nThe same line stands below each of these documents here.", "en", "s", 0) for i in range(6)]
    rows += [(400, "bad " * 100, "en", "s", 0), (401, None, "en", "s", 0), (402, "", None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, corpus):
    docs, seen = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus).persist()
        seen.append({r.doc_id for r in docs.collect()})
        if name != "packing":
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
        if name == "line_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert sum("same line" in t for t in texts.values()) == 1 and "same line" in texts[305]
    assert 400 not in seen[0] and 401 not in seen[0] and set(range(30)) <= seen[0] and seen[1] == seen[0]
    assert seen[2] == seen[3] and set(range(30)) <= seen[2]
    assert not seen[2] & {100, 101, 102, 103, 104} and len(seen[2] & {200, 201, 202, 203, 204}) <= 1 and len(seen[2] & set(range(300, 306))) <= 1


def test_near_dedup_keeps_one_of_each_group(spark):
    """Survivors are the smallest ids of the brute-force components, for pairs of 0.75 to 0.9 and short texts."""
    texts = around_the_threshold(120, 6)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts] + [(None, texts[0][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = set(shingle_components(texts).values())
    assert 120 < len(want) < 240 and len(got) == len(want) + 1 and set(got) == want | {None}


def test_near_dedup_of_shared_ids(spark):
    """Rows that share an id and differ in text are judged by their texts, and equal rows stay once."""
    a, b, c = (" ".join("%s%d" % (x, k) for k in range(50)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, c), (3, c + " end"), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text[0]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [(1, "a"), (1, "b"), (3, "c")]


def test_stages_on_odd_tables(spark):
    """Every stage gives a defined result for an empty table, null ids, repeated rows, null texts and a text of one long line."""
    rng = random.Random(8)
    text = " ".join(rng.choice(["the", "of", "and"]) if k % 3 else "stone%d" % rng.randrange(900) for k in range(300))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text, "en", "s", 9), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "xx", "s", 0), (4, "w " * 30000, "en", "s", 1), (5, text + " " + "x" * 200_000, "en", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for own in ([], rows):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name == "packing":
                assert out.select("doc_id").count() >= len(own)
            else:
                assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
                kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
                ids = {"quality_rules": [(False, 1), (False, 1), (True, 0)], "line_dedup": sorted((r[0] is None, r[0] or 0) for r in own), "near_dedup": [(False, 1), (False, 2), (False, 4), (True, 0), (True, 0)]}[name]
                assert kept == (ids if own else [])


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() >= 30


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = judge_quality(docs).join(labels, "doc_id").where("NOT base_failed")
    clean = judged.where("quality = 1")
    assert clean.where("NOT kept").count() <= 0.005 * clean.count()
    junk = judged.where("quality = 0")
    assert junk.where("kept").count() <= 0.1 * junk.count()


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_line_dedup", "op10_warc"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    expected = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in df.collect()]
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted(df.columns) == sorted(names) and sorted(got, key=key) == sorted(expected, key=key)
