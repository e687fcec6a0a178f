"""MUC, B3, CEAFe and their mean, from long tables of clusters: joins of positions and counts of cells.

gold and pred have doc_key, sent_idx, start_tok, end_tok, cluster_id, one row for each position (where
several clusters hold a position, one_cluster_per_key chooses).  All figures are sums of numerators and
denominators over documents, so they add up by language and overall; ratios are taken at the end.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from .assignment import best_total

KEY = ["doc_key", "sent_idx", "start_tok", "end_tok"]
METRICS = ("muc", "b3", "ceafe")


def cells(gold: DataFrame, pred: DataFrame, run: str | None = None) -> DataFrame:
    """doc_key, gold_id, pred_id, n of common positions, gold_size, pred_size; an id is null for positions without.

    Both sides are one union that is shuffled by document once; the match of positions, the
    counts and the sizes all keep that partitioning.  run: a column of both that tells runs apart.
    """
    own = [run] if run else []
    none = F.lit(None).cast("bigint")
    g = gold.select(*own, *KEY, F.col("cluster_id").cast("bigint").alias("gold_id"), none.alias("pred_id"))
    p = pred.select(*own, *KEY, none.alias("gold_id"), F.col("cluster_id").cast("bigint").alias("pred_id"))
    matched = g.unionByName(p).repartition("doc_key").groupBy(*own, *KEY).agg(F.max("gold_id").alias("gold_id"), F.max("pred_id").alias("pred_id"))
    return counted_cells(matched, run)


def counted_cells(matched: DataFrame, run: str | None = None) -> DataFrame:
    """Cells of positions that have their gold_id and pred_id already, as those of a rule over gold positions."""
    own = [run] if run else []
    n = matched.groupBy(*own, "doc_key", "gold_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.sum("n").over(W.partitionBy(*own, "doc_key", c)))
    return n.withColumn("gold_size", size("gold_id")).withColumn("pred_size", size("pred_id"))


def sided(cell: DataFrame, run: str | None = None) -> DataFrame:
    """Cells with what their gold (g_) and predicted (p_) cluster is as a whole: one window for each side.

    size; parts: clusters of the other side that share with it, and each position that none has; degree: the
    sharing clusters; first: one cell of each cluster, so that sums count it once.
    """
    own = f"`{run}`, " if run else ""
    new = []
    for c, other, name in (("gold_id", "pred_id", "g"), ("pred_id", "gold_id", "p")):
        order = f"partition by {own}doc_key, {c} order by {other}"
        every = f"over ({order} rows between unbounded preceding and unbounded following)"
        new += [
            f"case when {c} is not null then sum(n) {every} end as {name}_size", f"sum(case when {other} is not null then 1 else n end) {every} as {name}_parts",
            f"count(case when {c} is not null and {other} is not null then 1 end) {every} as {name}_degree", f"{c} is not null and row_number() over ({order}) = 1 as {name}_first",
        ]
    return cell.selectExpr("*", *new)


def document_sums(cell: DataFrame, run: str | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """By document the sums of all metrics (SUMS): windows over its cells and one aggregation, no shuffle of its own.

    more: further aggregates, as SQL, over the sided cells of a document.
    """
    own = [run] if run else []
    once = lambda side, value: f"sum(case when {side}_first then {value} else 0 end)"
    several = lambda side, value: f"sum(case when {side}_first and {side}_size >= 2 then {value} else 0 end)"
    both, phi = "gold_id is not null and pred_id is not null", "2 * n / (g_size + p_size)"
    alone = f"{both} and g_degree = 1 and p_degree = 1"
    sums = {
        "muc_r_num": several("g", "g_size - g_parts"), "muc_r_den": several("g", "g_size - 1"), "muc_p_num": several("p", "p_size - p_parts"), "muc_p_den": several("p", "p_size - 1"),
        # a gold position that the prediction lacks counts as a cluster of its own
        "b3_r_num": f"sum(case when {both} then n * n / g_size when gold_id is not null then n / g_size else 0 end)",
        "b3_p_num": f"sum(case when {both} then n * n / p_size when gold_id is not null then cast(n as double) else 0 end)",
        "b3_den": "sum(case when gold_id is not null then n else 0 end)",
        "alone": f"sum(case when {alone} then {phi} else 0 end)", "edges": f"collect_list(case when {both} and not ({alone}) then struct(gold_id, pred_id, {phi} as phi) end)",
        "n_gold": once("g", 1), "n_pred": once("p", 1), "gold_mentions": "sum(case when gold_id is not null then n else 0 end)", "pred_mentions": "sum(case when pred_id is not null then n else 0 end)",
    } | (more or {})
    sums = sided(cell, run).groupBy(*own, "doc_key").agg(*[F.expr(f"{e} as {name}") for name, e in sums.items()])
    return _with_ceafe(sums)


def _with_ceafe(sums: DataFrame) -> DataFrame:
    """ceafe_num: the best one-to-one sum of 2 n / (gold size + pred size).

    Cells alone in their row and column are summed already; the others go to the assignment, component by component.
    """
    kept = [f for f in sums.schema.fields if f.name not in ("alone", "edges")]
    schema = T.StructType([*kept, T.StructField("ceafe_num", T.DoubleType())])

    def run(batches):
        for b in batches:
            at = {name: i for i, name in enumerate(b.schema.names)}
            lists, alone = b.column(at["edges"]), b.column(at["alone"]).to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()
            gold, pred, phi = (flat.field(i).to_pylist() for i in range(3))
            best = alone.copy()
            for i, (first, last) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
                if last > first:
                    best[i] += best_total(list(zip(gold[first:last], pred[first:last], phi[first:last])))
            yield pa.RecordBatch.from_arrays([*[b.column(at[f.name]) for f in kept], pa.array(best, pa.float64())], names=schema.fieldNames())

    return sums.mapInArrow(run, schema)


SUMS = ("muc_r_num", "muc_r_den", "muc_p_num", "muc_p_den", "b3_r_num", "b3_p_num", "b3_den", "ceafe_num", "n_gold", "n_pred", "gold_mentions", "pred_mentions")


def ratios(sums: DataFrame) -> DataFrame:
    """p, r and f of each metric, and of their mean, from sums."""
    terms = {"muc": ("muc_p_num", "muc_p_den", "muc_r_num", "muc_r_den"), "b3": ("b3_p_num", "b3_den", "b3_r_num", "b3_den"), "ceafe": ("ceafe_num", "n_pred", "ceafe_num", "n_gold")}
    share = lambda num, den: f"case when {den} > 0 then {num} / {den} else 0.0D end"
    pr = [f"{share(*terms[m][2 * i : 2 * i + 2])} as {m}_{x}" for m in METRICS for i, x in enumerate("pr")]
    f = [f"case when {m}_p + {m}_r > 0 then 2 * {m}_p * {m}_r / ({m}_p + {m}_r) else 0.0D end as {m}_f" for m in METRICS]
    means = [f"({' + '.join(f'{m}_{x}' for m in METRICS)}) / 3 as conll_{x}" for x in "prf"]
    return sums.selectExpr("*", *pr).selectExpr("*", *f).selectExpr("*", *means)


SCORES = [f"{m}_{x}" for m in (*METRICS, "conll") for x in "prf"]


def document_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """The metrics of each document, as fractions."""
    return ratios(document_sums(cells(gold, pred))).select("doc_key", *SCORES)


def corpus_scores(gold: DataFrame, pred: DataFrame, documents: DataFrame, group: str = "lang", only_scored: bool = False, run: str | None = None) -> DataFrame:
    """By language, and overall where there are several: sums and percentages (see cell_scores)."""
    return cell_scores(cells(gold, pred, run), documents, group, only_scored, run)


def cell_scores(cell: DataFrame, documents: DataFrame, group: str = "lang", only_scored: bool = False, run: str | None = None) -> DataFrame:
    """Sums and percentages of cells, by group and overall (see sum_scores)."""
    return sum_scores(document_sums(cell, run), documents, group, only_scored, run)


def sum_scores(sums: DataFrame, documents: DataFrame, group: str = "lang", only_scored: bool = False, run: str | None = None) -> DataFrame:
    """Sums and percentages of documents' sums, by group and overall.

    Documents without any cluster count in num_docs, unless only_scored; documents that the table
    lacks are in the group `all`.  run: a column of the cells by which scores are kept apart.
    """
    own = [run] if run else []
    every = documents.select("doc_key", group).join(sums, "doc_key", "right" if only_scored or run else "full")
    every = every.withColumn(group, F.coalesce(group, F.lit("all")))
    total = every.rollup(*own, group)
    levels = [f"grouping(`{group}`) as __all", *([f"grouping(`{run}`) as __runs"] if run else [])]
    every = ["count(doc_key) as num_docs", f"count(distinct `{group}`) as __groups", *levels, *[f"coalesce(sum({c}), 0) as {c}" for c in SUMS]]
    total = total.agg(*map(F.expr, every))
    if run:
        total = total.where("__runs = 0")
    named = [f"`{run}`"] if run else []
    kept = total.where("__all = 0 or __groups > 1").selectExpr(*named, f"case when __all = 1 then 'overall' else `{group}` end as `{group}`", "num_docs", *SUMS)
    return ratios(kept).selectExpr(*named, f"`{group}`", "num_docs", *SUMS, *[f"{c} * 100 as {c}" for c in SCORES])


def long_scores(scores: DataFrame, group: str = "lang") -> DataFrame:
    """group, metric, p, r, f."""
    metrics = ", ".join(f"'{m}', {m}_p, {m}_r, {m}_f" for m in (*METRICS, "conll"))
    return scores.selectExpr(f"`{group}`", f"stack(4, {metrics}) as (metric, p, r, f)")


def b3_std(cell: DataFrame) -> DataFrame:
    """The usual B3, whose precision is averaged over predicted positions: doc_key, p_num, p_den, r_num, r_den."""
    n, both = F.col("n"), F.col("gold_id").isNotNull() & F.col("pred_id").isNotNull()
    return cell.groupBy("doc_key").agg(
        F.sum(F.when(both, n * n / F.col("pred_size")).otherwise(0.0)).alias("p_num"), F.sum(F.when(F.col("pred_id").isNotNull(), n).otherwise(0)).alias("p_den"),
        F.sum(F.when(both, n * n / F.col("gold_size")).otherwise(0.0)).alias("r_num"), F.sum(F.when(F.col("gold_id").isNotNull(), n).otherwise(0)).alias("r_den"),
    )
