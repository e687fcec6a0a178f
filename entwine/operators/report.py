"""Tables about clusterings: sizes, errors, comparisons and their text form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import sided


def size_histogram(clusters: DataFrame, largest: int = 10) -> DataFrame:
    """size (one over `largest` stands for all above) and the number of clusters of (doc_key, cluster_id)."""
    sizes = clusters.groupBy("doc_key", "cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(F.least("size", F.lit(largest + 1)).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def histogram_table(gold: DataFrame, pred: DataFrame, largest: int = 10) -> DataFrame:
    """size, label, gold, pred, difference of all sizes from 1 to the largest that occurs."""
    g, p = (size_histogram(x, largest).withColumnRenamed("n", n) for x, n in ((gold, "gold"), (pred, "pred")))
    both = g.join(p, "size", "full").select("size", F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("pred", F.lit(0)).alias("pred"))
    top = both.agg(F.coalesce(F.least(F.max("size"), F.lit(largest)), F.lit(1)).alias("top"), F.max("size").alias("most"))
    sizes = top.select(F.explode(F.concat(F.sequence(F.lit(1), "top"), F.when(F.col("most") > largest, F.array(F.lit(largest + 1))).otherwise(F.array().cast("array<int>")))).alias("size"))
    label = F.when(F.col("size") < largest, F.concat(F.lit("="), F.col("size").cast("string"))).otherwise(F.concat(F.lit("≥"), F.col("size").cast("string")))
    full = sizes.join(both, "size", "left").withColumn("gold", F.coalesce("gold", F.lit(0))).withColumn("pred", F.coalesce("pred", F.lit(0)))
    return full.select("size", label.alias("label"), "gold", "pred", (F.col("pred") - F.col("gold")).alias("difference"))


def error_analysis(cell: DataFrame, documents: DataFrame, group: str = "lang") -> DataFrame:
    """By group: gold and predicted clusters, of which perfect, under-merged, over-merged and spurious.

    Under-merged: a gold cluster of two or more that more than one predicted cluster shares; over-merged: a predicted cluster
    that shares with more than one gold cluster; spurious: with none; perfect: the same positions.
    """
    count = {
        "n_gold": "g_first", "n_pred": "p_first", "perfect": "n = g_size and n = p_size", "under_merged": "g_first and g_size >= 2 and g_degree > 1",
        "over_merged": "p_first and p_degree > 1", "spurious": "p_first and p_degree = 0",
    }
    sums = sided(cell).groupBy("doc_key").agg(*[F.expr(f"count_if({c}) as {name}") for name, c in count.items()])
    return documents.select("doc_key", group).join(sums, "doc_key").groupBy(group).agg(*[F.sum(c).alias(c) for c in count])


def fixed(value: Column, width: int = 0, missing: str = "—") -> Column:
    """A number with two digits after the point, its exact binary value rounded half to even; null as a dash.

    Spark's own formats round the shortest decimal half up.  For tables of a row for each language or run.
    """

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: missing.rjust(width) if v is None or v != v else f"{v:{width}.2f}")

    return text(value.cast("double"))


def ablation(scores: DataFrame, run: str = "run", group: str = "lang", value: str = "conll_f", groups: list[str] | None = None) -> DataFrame:
    """One row for each run, one column for each language that occurs (or of groups), overall last; null where a run has no score."""
    if groups is None:
        # one value for each language: a short list
        groups = sorted((r[0] for r in scores.select(group).distinct().collect()), key=lambda g: (g == "overall", g))
    return scores.groupBy(run).pivot(group, groups).agg(F.first(value))


def ablation_lines(scores: DataFrame, run: str = "run", group: str = "lang", value: str = "conll_f") -> list[str]:
    """The comparison of runs as lines of fixed width, a dash where a run has no score."""
    table = ablation(scores, run, group, value)
    names = [c for c in table.columns if c != run]
    cells = lambda row, widths: " | ".join(x.ljust(w) for x, w in zip(row, widths))
    widths = [15] + [9] * len(names)
    rows = table.orderBy(run).select(run, *[fixed(F.col(f"`{c}`")).alias(c) for c in names]).collect()
    return [cells(["Instruction", *names], widths), *[cells(list(r), widths) for r in rows]]


def language_table(scores: DataFrame, group: str = "lang") -> DataFrame:
    """The lines of the score table in order: languages by name, overall last."""
    cells = [F.upper(group), *[fixed(F.col(f"{m}_f")) for m in ("muc", "b3", "ceafe", "conll")], F.coalesce(F.col("num_docs").cast("string"), F.lit("?"))]
    line = F.array_join(F.array(*[F.rpad(c, w, " ") for c, w in zip(cells, (12, 8, 8, 9, 9, 6))]), " | ")
    last = (F.col(group) == "overall").cast("int")
    return scores.select(last.alias("last"), F.col(group), line.alias("line")).orderBy("last", group).select(group, "line")


def score_lines(long_scores: DataFrame, group: str = "lang") -> DataFrame:
    """group, metric and its figures in fixed width."""
    tag = F.when(F.col("metric") == "conll", "CoNLL").otherwise(F.upper("metric"))
    line = F.concat(F.lit("  "), F.rpad(tag, 6, " "), *[F.concat(F.lit(f"  {x.upper()}="), fixed(F.col(x), 6)) for x in "prf"])
    return long_scores.select(group, "metric", line.alias("line"))


def score_block(scores: dict, label: str = "") -> list[str]:
    """The scores of one language (as results_dict has them) as they are printed, with the number of documents."""
    head = ["", "=" * 50, f"  {label}", "=" * 50] if label else []
    lines = [f"  {'CoNLL' if m == 'conll' else m.upper():6s}  P={scores[m]['p']:6.2f}  R={scores[m]['r']:6.2f}  F={scores[m]['f']:6.2f}" for m in ("muc", "b3", "ceafe", "conll")]
    return [*head, *lines, *([f"  Documents evaluated: {scores['num_docs']}"] if "num_docs" in scores else [])]
