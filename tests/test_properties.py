"""Properties that hold for any clustering, and the same results however the rows are spread."""

import random

import pytest
from pyspark.sql import functions as F

from entwine.operators import frames, mentions, merge, predict, score
from entwine.sources.tables import keyed_documents, placed_tokens, sentences

KEYED = "doc_key long, sent_idx int, start_tok int, end_tok int, cluster_id long"


def clusterings(spark, seed):
    rng = random.Random(seed)
    rows = [(k, m // 5, m % 5, m % 5, rng.randint(0, 4)) for k in range(60) for m in range(12) if rng.random() < 0.7]
    return spark.createDataFrame(rows, KEYED)


def test_recall_of_one_side_is_precision_of_the_other(spark):
    a, b = clusterings(spark, 1), clusterings(spark, 2)
    there = {r["doc_key"]: r for r in score.document_scores(a, b).collect()}
    back = {r["doc_key"]: r for r in score.document_scores(b, a).collect()}
    for k, r in there.items():
        for m in ("muc", "ceafe"):
            assert r[f"{m}_p"] == pytest.approx(back[k][f"{m}_r"]) and r[f"{m}_f"] == pytest.approx(back[k][f"{m}_f"])
        assert all(0 <= r[c] <= 1 + 1e-9 for c in score.SCORES)


def test_spreading_of_rows_changes_nothing(spark):
    a, b = clusterings(spark, 3), clusterings(spark, 4)
    want = score.document_scores(a, b).collect()
    got = score.document_scores(a.repartition(9, "start_tok"), b.coalesce(1)).collect()
    assert {tuple(round(x, 9) for x in r) for r in got} == {tuple(round(x, 9) for x in r) for r in want}


TOKENS = "token_id long, doc_key long, doc_id string, sent_idx int, tok_pos int, idx int, text string, coref string, loaded_at timestamp"


def test_placed_tokens(spark):
    """The first delivery of a place counts; what has no place is left out; nulls get a value."""
    rows = [(1, 1, "d", 0, 0, 0, "a", "(1)", "2024-01-02"), (2, 1, "d", 0, 0, 0, "b", "-", "2024-01-01"), (3, 1, "d", 0, 1, None, None, None, None), (4, None, "d", 0, 0, 0, "x", "-", None), (5, 1, "d", None, 0, 0, "x", "-", None), (6, 1, "d", 0, 0, 0, "c", "-", "2024-01-01")]
    df = spark.createDataFrame(rows, TOKENS.replace("timestamp", "string")).withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    got = sorted((r["tok_pos"], r["text"], r["coref"], r["idx"]) for r in placed_tokens(df).collect())
    assert got == [(0, "b", "-", 0), (1, "", "-", None)]
    assert placed_tokens(df.limit(0)).count() == 0


def test_documents_have_one_code_for_each_spelling(spark):
    docs = spark.createDataFrame([(i, "d", "c", "train", x) for i, x in enumerate(["HI", " hindi\xa0", "xx", None])], "doc_key long, doc_id string, corpus string, split string, language string")
    codes = spark.createDataFrame([("hi", "hi"), ("Hindi", "hi"), ("Hindi", "hi")], "code string, lang string")
    assert [r["lang"] for r in keyed_documents(docs, codes).orderBy("doc_key").collect()] == ["hi", "hi", "und", "und"]


def test_pairs_of_a_long_document(spark):
    """Hundreds of frames of one document, and mentions that cross, nest and repeat."""
    rng = random.Random(5)
    rows = [(1, s, i, i, f"w{rng.randint(0, 9)}", rng.choice(["-", "-", "(1)", "(2", "2)", "(3|(1)", "3)|(2)"])) for s in range(1200) for i in range(6)]
    t = spark.createDataFrame(rows, "doc_key long, sent_idx int, tok_pos int, idx int, text string, coref string")
    s, found = sentences(t), mentions.mentions(t)
    p = frames.pairs(s, found, 24, skip_empty=False)
    assert p.count() == 299
    bad = predict.mask_mismatch(p)
    assert bad.count() == 0
    whole = p.select("pair_idx", (F.size("before_mentions") + F.size("after_mentions")).alias("n"), F.size("before_sent_indices").alias("b")).collect()
    assert all(r["b"] == 4 for r in whole) and sum(r["n"] for r in whole) > 300
    merged = merge.merge_pairs(predict.attach(p, predict.gold()))
    assert merged.count() == merged.select("sent_idx", "start_tok", "end_tok").distinct().count()
