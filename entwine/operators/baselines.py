"""Rule baselines: their clusters of a document's mentions, as tables that the metrics take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .score import KEY, SUMS, counted_cells, document_sums, sum_scores

NAMES = ("all_singletons", "all_one_cluster", "head_match")


def with_predictions(found: DataFrame) -> DataFrame:
    """found (with its head) and the cluster id that each baseline gives, named by the baseline."""
    place = F.struct("sent_idx", "start_tok", "mention_ord")
    first = found.withColumn("__first", F.min(place).over(W.partitionBy("doc_key", "head")))
    # clusters of a head are numbered by its first mention in reading order
    number = F.dense_rank().over(W.partitionBy("doc_key").orderBy("__first")) - 1
    return first.withColumn("head_match", number.cast("bigint")).drop("__first").withColumn("all_singletons", F.col("mention_ord").cast("bigint")).withColumn("all_one_cluster", F.lit(0).cast("bigint"))


def _clusters(found: DataFrame, name: str) -> DataFrame:
    return with_predictions(found).select(*KEY, F.col(name).alias("cluster_id"))


def all_singletons(found: DataFrame) -> DataFrame:
    return _clusters(found, "all_singletons")


def all_one_cluster(found: DataFrame) -> DataFrame:
    return _clusters(found, "all_one_cluster")


def head_match(found: DataFrame) -> DataFrame:
    return _clusters(found, "head_match")


def cells(found: DataFrame, name: str) -> DataFrame:
    """Cells of gold against a baseline: both hold the same positions, so nothing has to be matched."""
    return counted_cells(with_predictions(found).select("doc_key", F.col("cluster_id").alias("gold_id"), F.col(name).alias("pred_id")))


def head_cells(found: DataFrame) -> DataFrame:
    """Cells of gold against the clusters of a head, which need no number of their own to be counted."""
    return found.groupBy("doc_key", F.col("cluster_id").alias("gold_id"), F.col("head").alias("pred_id")).agg(F.count(F.lit(1)).alias("n"))


def scorable(found: DataFrame, least: int = 2) -> DataFrame:
    """Mentions of the documents with at least so many."""
    return found.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("doc_key"))).where(F.col("__n") >= least).drop("__n")


def evaluate(found: DataFrame, documents: DataFrame, least: int = 2) -> DataFrame:
    """baseline and the corpus scores of each, over the documents with at least two mentions.

    found: one row for each position, with its head.  Only the cells of gold clusters and heads are counted.
    What the two other baselines give follows from the sizes of the gold clusters: with one cluster for
    each of the N mentions, nothing is linked and a cluster of s has one best partner, 2 / (s + 1); with one
    cluster for all, every link of gold is found, and the largest cluster is the best partner, 2 s / (s + N).
    """
    gold = lambda value: f"sum(case when g_first then {value} else 0 end)"
    sums = document_sums(head_cells(found), more={"squares": gold("g_size * g_size"), "halves": gold("2 / (g_size + 1)"), "largest": "max(g_size)"})
    n, g, links = "gold_mentions", "n_gold", "muc_r_den"
    rules = {
        "head_match": {c: c for c in SUMS},
        "all_singletons": dict(
            muc_r_num="0", muc_r_den=links, muc_p_num="0", muc_p_den="0", b3_r_num=g, b3_p_num=n, b3_den=n, ceafe_num="halves", n_gold=g, n_pred=n, gold_mentions=n, pred_mentions=n,
        ),
        "all_one_cluster": dict(
            muc_r_num=links, muc_r_den=links, muc_p_num=f"{n} - {g}", muc_p_den=f"{n} - 1", b3_r_num=n, b3_p_num=f"squares / {n}", b3_den=n, ceafe_num=f"2 * largest / (largest + {n})",
            n_gold=g, n_pred="1", gold_mentions=n, pred_mentions=n,
        ),
    }
    kind = lambda c: "double" if c in ("b3_r_num", "b3_p_num", "ceafe_num") else "bigint"
    rows = [f"struct('{name}' as baseline, " + ", ".join(f"cast({rules[name][c]} as {kind(c)}) as {c}" for c in SUMS) + ")" for name in NAMES]
    each = sums.where(f"gold_mentions >= {int(least)}").selectExpr("doc_key", f"explode(array({', '.join(rows)})) as b").selectExpr("doc_key", "b.*")
    return sum_scores(each, documents, only_scored=True, run="baseline")
