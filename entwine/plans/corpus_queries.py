"""Queries of the coreference operators over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import clamped, digits_to_ascii, fill_masks, last_tokens, mask_count
from ..operators import baselines, frames, mentions, merge, packed, predict, report, sampling, score
from ..session import table
from ..sources import conll, tables
from .queries import query
from .sql import select

S = tables.sentences
KEY = "doc_key, sent_idx, start_tok, end_tok"


def _tokens(spark, d):
    return tables.placed_tokens(table(spark, d, "tokens"))


#: The delimiters of each source, by session and the files that they were inferred from.
_delimiters: dict[tuple, dict | DataFrame] = {}


def _marked(spark, d, tolerant=True):
    """The corpus's sentences with their marks; cells are cut by the delimiters inferred for their source, once for given files."""
    t = table(spark, d, "tokens")
    if tolerant:
        key = (spark.sparkContext.applicationId, *sorted(t.inputFiles()))
        if key not in _delimiters:
            _delimiters[key] = packed.infer(t, "coref", packed.corpus_prefix())
        t = packed.with_delimiters(t, packed.corpus_prefix(), _delimiters[key])
    return tables.marked_sentences(tables.placed_tokens(t), tolerant)


def _documents(spark, d):
    return tables.keyed_documents(table(spark, d, "conll_documents"), table(spark, d, "language_codes"))


def _gold(spark, d):
    """One row for each position of a mention, with its head."""
    return mentions.headed_mentions(_marked(spark, d))


def _mentions(spark, d, **kw):
    return mentions.mentions(_marked(spark, d), tolerant=True, **kw)


@query("corpus_tokens", select("SELECT * FROM tok", "tok"))
def corpus_tokens(spark, d):
    return _tokens(spark, d)


@query("corpus_documents", select("SELECT * FROM doc", "doc"))
def corpus_documents(spark, d):
    return _documents(spark, d)


@query("sentences", select("SELECT doc_key, sent_idx, array_to_string(words, ' ') AS plain_text, n_tokens FROM sent", "sent"))
def sentences(spark, d):
    return S(_tokens(spark, d)).select("doc_key", "sent_idx", F.array_join("words", " ").alias("plain_text"), "n_tokens")


@query("sentence_stats", select("SELECT lang, count(*) AS n_sentences, sum(n_tokens) AS n_tokens, max(n_tokens) AS longest FROM sent JOIN doc USING (doc_key) GROUP BY ALL", "sent", "doc"))
def sentence_stats(spark, d):
    joined = S(_tokens(spark, d)).select("doc_key", "n_tokens").join(_documents(spark, d).select("doc_key", "lang"), "doc_key")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))


for _name, _tolerant in (("coref_events_strict", False), ("coref_events", True)):

    @query(_name, select("SELECT * FROM ev", "ev", strict=not _tolerant))
    def coref_events(spark, d, tolerant=_tolerant):
        return mentions.coref_events(_marked(spark, d, tolerant))


for _name, _tolerant in (("mentions_strict", False), ("mentions", True)):

    @query(_name, select("SELECT * FROM sound", "sound", strict=not _tolerant))
    def mention_rows(spark, d, tolerant=_tolerant):
        return mentions.mentions(_marked(spark, d, tolerant))


@query("span_match", select("SELECT * FROM men", "men"))
def span_match(spark, d):
    return _mentions(spark, d, keep_defects=True)


@query("mention_defects", select("SELECT doc_key, count(*) AS n_defects, count(*) FILTER (sent_idx <> end_sent) AS n_cross_sentence FROM men WHERE NOT (sent_idx = end_sent AND end_tok >= start_tok) GROUP BY ALL", "men"))
def mention_defects(spark, d):
    return mentions.mention_defects(_marked(spark, d))


@query("dup_key_report", select(f"SELECT {KEY}, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_mentions FROM sound GROUP BY ALL HAVING count(DISTINCT cluster_id) > 1", "sound"))
def dup_key_report(spark, d):
    return mentions.duplicate_keys(_mentions(spark, d))


@query("head_words", select(f"SELECT {KEY}, mention_ord, cluster_id, is_zero, head FROM headed", "headed"))
def head_words(spark, d):
    return _gold(spark, d).select("doc_key", "mention_ord", "sent_idx", "start_tok", "end_tok", "cluster_id", "is_zero", "head")


@query("gold_clusters", select("SELECT doc_key, cluster_id, count(*) AS size FROM keyed GROUP BY ALL", "keyed"))
def gold_clusters(spark, d):
    found = mentions.one_cluster_per_key(_mentions(spark, d))
    return mentions.clusters(found).select("doc_key", "cluster_id", F.col("size").cast("bigint").alias("size"))


_PACK_SQL = "SELECT doc_key, frame_idx, list(sent_idx ORDER BY sent_idx) AS sent_indices, sum(n_tokens) AS n_tokens, any_value(budget) AS budget, any_value(f) AS n_frames FROM (SELECT *, max(frame_idx) OVER (PARTITION BY doc_key) + 1 AS f FROM packed) GROUP BY ALL"

for _budget in (256, 32):

    @query(f"frame_pack_{_budget}", select(_PACK_SQL.replace("GROUP BY ALL", "GROUP BY doc_key, frame_idx"), "packed", budget=_budget))
    def frame_pack(spark, d, budget=_budget):
        return frames.pack(S(_tokens(spark, d)), budget)


@query("pairless_docs", select("SELECT doc_key, count(*) AS n_sentences FROM sent GROUP BY ALL HAVING count(*) < 2", "sent"))
def pairless_docs(spark, d):
    s = S(_tokens(spark, d))
    one = frames.pack(s).where("n_frames < 2").select("doc_key", F.size("sent_indices").cast("bigint").alias("n_sentences"))
    return one


@query("outer_mentions", select("SELECT doc_key, sent_idx, start_tok, end_tok, mention_ord, cluster_id FROM taken", "taken"))
def outer_mentions(spark, d):
    rows = frames.with_taken(mentions.sentences_with_mentions(_marked(spark, d))).select("doc_key", "sent_idx", F.explode("taken").alias("m"))
    return rows.select("doc_key", "sent_idx", F.col("m.s").alias("start_tok"), F.col("m.e").alias("end_tok"), F.col("m.o").alias("mention_ord"), F.col("m.c").alias("cluster_id"))


def _pairs(spark, d, **kw):
    marked = _marked(spark, d)
    return frames.pairs_of(mentions.sentences_with_mentions(marked), marked, **kw)


@query("pair_local_numbers", select("SELECT doc_key, pair_idx, side, sent_idx, start_tok, end_tok, cluster_id, local_no FROM pair_mentions", "pair_mentions"))
def pair_local_numbers(spark, d):
    p = _pairs(spark, d)
    side = lambda c, n: p.select("doc_key", "pair_idx", F.lit(n).alias("side"), F.explode(c).alias("m"))
    return side("before_mentions", 0).unionByName(side("after_mentions", 1)).select("doc_key", "pair_idx", "side", *[f"m.{c}" for c in ("sent_idx", "start_tok", "end_tok", "cluster_id", "local_no")])


_WITH = "FROM pair_text WHERE EXISTS (SELECT 1 FROM pair_mentions m WHERE m.doc_key = pair_text.doc_key AND m.pair_idx = pair_text.pair_idx)"


@query("masked_text", select(f"SELECT doc_key, pair_idx, masked_input {_WITH}", "pair_text"))
def masked_text(spark, d):
    return _pairs(spark, d).select("doc_key", "pair_idx", "masked_input")


@query("expected_output", select(f"SELECT doc_key, pair_idx, output {_WITH}", "pair_text"))
def expected_output(spark, d):
    return _pairs(spark, d).select("doc_key", "pair_idx", "output")


@query("pairs_budget_32", select("SELECT doc_key, pair_idx, masked_input, output FROM pair_text", "pair_text", budget=32))
def pairs_budget_32(spark, d):
    return _pairs(spark, d, budget=32, skip_empty=False).select("doc_key", "pair_idx", "masked_input", "output")


@query("mask_split_counts", "SELECT example_id, CAST(len(regexp_split_to_array(masked_input, '[#@]MASK')) - 1 AS INTEGER) AS n_masks FROM frame_examples WHERE masked_input IS NOT NULL")
def mask_split_counts(spark, d):
    return table(spark, d, "frame_examples").where("masked_input is not null").select("example_id", mask_count(F.col("masked_input")).alias("n_masks"))


@query(
    "reconstruct_output",
    """
WITH p AS (SELECT example_id, masked_input, regexp_split_to_array(masked_input, '[#@]MASK') AS s FROM frame_examples WHERE masked_input IS NOT NULL)
SELECT example_id, s[1] || array_to_string(list_transform(range(2, len(s) + 1), lambda i: '#' || (i - 2) || s[i]), '') AS output_text FROM p
""",
)
def reconstruct_output(spark, d):
    """Every mention gets its ordinal, as a prediction without numbers does."""
    none = F.array().cast("array<int>")
    return table(spark, d, "frame_examples").where("masked_input is not null").select("example_id", fill_masks(F.col("masked_input"), none).alias("output_text"))


@query(
    "clamp_attach",
    """
SELECT result_id, CAST(list_sum(list_transform(n, lambda x: least(x, 3))) AS BIGINT) AS total, CAST(len(n) AS INTEGER) AS n_numbers
FROM (SELECT result_id, list_transform(regexp_extract_all(output_text, '#([0-9]+)', 1), lambda x: CAST(x AS BIGINT)) AS n FROM inference_results WHERE output_text IS NOT NULL)
""",
)
def clamp_attach(spark, d):
    """Decoded numbers of the results, none over 3: how often each result has which is summed up."""
    r = table(spark, d, "inference_results").where("output_text is not null")
    n = F.transform(F.regexp_extract_all("output_text", F.lit("#([0-9]+)"), 1), lambda x: clamped(x, 3).cast("bigint"))
    r = r.select("result_id", n.alias("n"))
    return r.select("result_id", F.when(F.size("n") > 0, F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"), F.size("n").alias("n_numbers"))


_MERGED = "SELECT doc_key, sent_idx, start_tok, end_tok, cluster_id FROM merged"


@query("merge_gold", select(_MERGED, "merged"))
def merge_gold(spark, d):
    return merge.merge_pairs(predict.attach(_pairs(spark, d, skip_empty=False), predict.gold()))


@query("merge_singleton", select(_MERGED, "merged", number="CAST(nth - 1 AS INTEGER)"))
def merge_singleton(spark, d):
    return merge.merge_pairs(predict.attach(_pairs(spark, d, skip_empty=False), predict.singleton()))


_NOISY = "local_no + CASE WHEN CAST('0x' || md5('42:' || doc_key || ':' || pair_idx || ':' || (nth - 1))[1:6] AS BIGINT) < 1677721 THEN 1 ELSE 0 END"


@query("merge_noisy", select(_MERGED, "merged", number=_NOISY))
def merge_noisy(spark, d):
    return merge.merge_pairs(predict.attach(_pairs(spark, d, skip_empty=False), predict.noisy(0.1)))


@query("merge_noisy_32", select(_MERGED, "merged", number=_NOISY, budget=32))
def merge_noisy_32(spark, d):
    return merge.merge_pairs(predict.attach(_pairs(spark, d, budget=32, skip_empty=False), predict.noisy(0.1)))


@query("merge_head", select(_MERGED, "merged", heads=True))
def merge_head(spark, d):
    return merge.merge_pairs(predict.attach(predict.head_match(_pairs(spark, d))))


@query("merge_results")
def merge_results(spark, d):
    """The given inference results, in the order of their examples."""
    r = table(spark, d, "inference_results").join(table(spark, d, "frame_examples").select("example_id", "doc_key"), "example_id")
    return merge.merge_pairs(r, order="example_id")


_BASE = {
    "all_singletons": baselines.all_singletons,
    "all_one_cluster": baselines.all_one_cluster,
    "head_match": baselines.head_match,
}


def _scorable(spark, d):
    """Gold and documents of the rule baselines: documents with at least two mentions."""
    return baselines.scorable(_gold(spark, d)), _documents(spark, d)


_BASE_SQL = {
    "all_singletons": "CAST(mention_ord AS BIGINT)",
    "all_one_cluster": "CAST(0 AS BIGINT)",
    "head_match": "CAST(dense_rank() OVER (PARTITION BY doc_key ORDER BY f) - 1 AS BIGINT)",
}
for _name, _f in _BASE.items():

    @query(
        f"baseline_{_name}",
        select(
            f"SELECT {KEY}, {_BASE_SQL[_name]} AS cluster_id FROM (SELECT *, min({{'s': sent_idx, 't': start_tok, 'o': mention_ord}}) OVER (PARTITION BY doc_key, head) AS f FROM headed) "
            "WHERE doc_key IN (SELECT doc_key FROM headed GROUP BY ALL HAVING count(*) >= 2)",
            "headed",
        ),
    )
    def baseline(spark, d, f=_f):
        return f(_scorable(spark, d)[0])


@query("overlap_cells", select("SELECT doc_key, gold_id, n, gold_size, pred_size FROM cell", "cell", pred="head_match"))
def overlap_cells(spark, d):
    gold, _ = _scorable(spark, d)
    return baselines.cells(gold, "head_match").select("doc_key", "gold_id", "n", "gold_size", "pred_size")


_MUC = """
SELECT coalesce(lang, 'overall') AS lang, sum(r_num) AS muc_r_num, sum(r_den) AS muc_r_den, sum(p_num) AS muc_p_num, sum(p_den) AS muc_p_den
FROM doc
JOIN (SELECT doc_key, sum(CASE WHEN size > 1 THEN size - parts ELSE 0 END) AS r_num, sum(CASE WHEN size > 1 THEN size - 1 ELSE 0 END) AS r_den FROM golds GROUP BY ALL) USING (doc_key)
JOIN (SELECT doc_key, sum(CASE WHEN size > 1 THEN size - parts ELSE 0 END) AS p_num, sum(CASE WHEN size > 1 THEN size - 1 ELSE 0 END) AS p_den FROM preds GROUP BY ALL) USING (doc_key)
GROUP BY ROLLUP (lang)
"""
_B3 = """
SELECT coalesce(lang, 'overall') AS lang, round(sum(n * n / gold_size), 6) AS b3_r_num, round(sum(n * n / pred_size), 6) AS b3_p_num, sum(n) AS b3_den
FROM cell JOIN doc USING (doc_key) GROUP BY ROLLUP (lang)
"""


def _scores(spark, d, name):
    gold, docs = _scorable(spark, d)
    return score.cell_scores(baselines.cells(gold, name), docs, only_scored=True)


for _name in _BASE:

    @query(f"muc_{_name}", select(_MUC, "doc", "golds", "preds", pred=_name))
    def muc(spark, d, name=_name):
        return _scores(spark, d, name).select("lang", "muc_r_num", "muc_r_den", "muc_p_num", "muc_p_den")

    @query(f"b3_{_name}", select(_B3, "doc", "cell", pred=_name))
    def b3(spark, d, name=_name):
        return _scores(spark, d, name).select("lang", F.round("b3_r_num", 6).alias("b3_r_num"), F.round("b3_p_num", 6).alias("b3_p_num"), "b3_den")


# a closed form where every component is a star: the best cell of the centre
_CEAFE = """
SELECT coalesce(lang, 'overall') AS lang, round(sum(best), 6) AS ceafe_num, sum(n_gold) AS n_gold, sum(n_pred) AS n_pred
FROM doc JOIN (SELECT doc_key, {} AS best, count(*) AS n_gold FROM golds GROUP BY ALL) USING (doc_key)
JOIN (SELECT doc_key, count(*) AS n_pred FROM preds GROUP BY ALL) USING (doc_key) GROUP BY ROLLUP (lang)
"""
for _name, _best in (("all_singletons", "sum(best)"), ("all_one_cluster", "max(best)")):

    @query(f"ceafe_{_name}", select(_CEAFE.format(_best), "doc", "golds", "preds", pred=_name))
    def ceafe(spark, d, name=_name):
        return _scores(spark, d, name).select("lang", F.round("ceafe_num", 6).alias("ceafe_num"), "n_gold", "n_pred")


@query("ceafe_head_match")
def ceafe_head_match(spark, d):
    return _scores(spark, d, "head_match").select("lang", F.round("ceafe_num", 6).alias("ceafe_num"), "n_gold", "n_pred")


_CONLL = """
WITH s AS (
  SELECT lang, num_docs, r_num / nullif(r_den, 0) AS mr, p_num / nullif(p_den, 0) AS mp, b_r / b_den AS br, b_p / b_den AS bp, best / n_pred AS cp, best / n_gold AS cr FROM (
    SELECT coalesce(lang, 'overall') AS lang, count(*) AS num_docs, sum(r_num) AS r_num, sum(r_den) AS r_den, sum(p_num) AS p_num, sum(p_den) AS p_den,
      sum(b_r) AS b_r, sum(b_p) AS b_p, sum(b_den) AS b_den, sum({best}) AS best, sum(n_gold) AS n_gold, sum(n_pred) AS n_pred
    FROM doc
    JOIN (SELECT doc_key, sum(CASE WHEN size > 1 THEN size - parts ELSE 0 END) AS r_num, sum(CASE WHEN size > 1 THEN size - 1 ELSE 0 END) AS r_den, max(best) AS one, sum(best) AS many, count(*) AS n_gold FROM golds GROUP BY ALL) USING (doc_key)
    JOIN (SELECT doc_key, sum(CASE WHEN size > 1 THEN size - parts ELSE 0 END) AS p_num, sum(CASE WHEN size > 1 THEN size - 1 ELSE 0 END) AS p_den, count(*) AS n_pred FROM preds GROUP BY ALL) USING (doc_key)
    JOIN (SELECT doc_key, sum(n * n / gold_size) AS b_r, sum(n * n / pred_size) AS b_p, sum(n) AS b_den FROM cell GROUP BY ALL) USING (doc_key)
    GROUP BY ROLLUP (lang))
), f AS (
  SELECT lang, num_docs, coalesce(mr, 0) AS mr, coalesce(mp, 0) AS mp, br, bp, cr, cp,
    CASE WHEN coalesce(mr, 0) + coalesce(mp, 0) > 0 THEN 2 * mr * mp / (mr + mp) ELSE 0 END AS mf, CASE WHEN br + bp > 0 THEN 2 * br * bp / (br + bp) ELSE 0 END AS bf,
    CASE WHEN cr + cp > 0 THEN 2 * cr * cp / (cr + cp) ELSE 0 END AS cf FROM s
)
"""
_CONLL_SUMMARY = _CONLL + """
SELECT lang, num_docs, round(100 * mf, 6) AS muc_f, round(100 * bf, 6) AS b3_f, round(100 * cf, 6) AS ceafe_f,
  round(100 * (mp + bp + cp) / 3, 6) AS conll_p, round(100 * (mr + br + cr) / 3, 6) AS conll_r, round(100 * (mf + bf + cf) / 3, 6) AS conll_f FROM f
"""
_CONLL_LONG = _CONLL + """, long AS (
  SELECT lang, num_docs, unnest(['muc', 'b3', 'ceafe', 'conll']) AS metric, unnest([100 * mp, 100 * bp, 100 * cp, 100 * (mp + bp + cp) / 3]) AS p,
    unnest([100 * mr, 100 * br, 100 * cr, 100 * (mr + br + cr) / 3]) AS r, unnest([100 * mf, 100 * bf, 100 * cf, 100 * (mf + bf + cf) / 3]) AS f FROM f)
"""
_SCORED = ("muc_f", "b3_f", "ceafe_f", "conll_p", "conll_r", "conll_f")


def _conll_sql(final: str, name: str, best: str) -> str:
    return select("SELECT * FROM (" + final.replace("{best}", best) + ")", "doc", "golds", "preds", "cell", pred=name)


for _name, _best in (("all_singletons", "many"), ("all_one_cluster", "one"), ("head_match", None)):

    @query(f"conll_{_name}", _best and _conll_sql(_CONLL_SUMMARY, _name, _best))
    def conll_mean(spark, d, name=_name):
        return _scores(spark, d, name).select("lang", "num_docs", *[F.round(c, 6).alias(c) for c in _SCORED])


@query(
    "scores_gold_against_gold",
    # every component is one cell, so the best cells add up
    _conll_sql(_CONLL_SUMMARY, "gold", "many"),
)
def scores_gold_against_gold(spark, d):
    gold, docs = _scorable(spark, d)
    return score.corpus_scores(gold, gold, docs, only_scored=True).select("lang", "num_docs", *[F.round(c, 6).alias(c) for c in _SCORED])


@query("scores_merged_gold")
def scores_merged_gold(spark, d):
    """How well the gold numbers of the pairs survive the merge: entities absent from a frame are lost."""
    gold, docs = _scorable(spark, d)
    return score.corpus_scores(gold, merge_gold(spark, d), docs, only_scored=True).select("lang", "num_docs", *[F.round(c, 6).alias(c) for c in _SCORED])


@query("document_scores")
def document_scores(spark, d):
    gold, _ = _scorable(spark, d)
    s = score.ratios(score.document_sums(baselines.cells(gold, "head_match")))
    return s.select("doc_key", *[F.round(c, 6).alias(c) for c in score.SCORES])


@query(
    "b3_std_head_match",
    select("SELECT doc_key, round(sum(n * n / pred_size), 6) AS p_num, sum(n) AS p_den, round(sum(n * n / gold_size), 6) AS r_num, sum(n) AS r_den FROM cell GROUP BY ALL", "cell", pred="head_match"),
)
def b3_std_head_match(spark, d):
    gold, _ = _scorable(spark, d)
    s = score.b3_std(baselines.cells(gold, "head_match"))
    return s.select("doc_key", F.round("p_num", 6).alias("p_num"), "p_den", F.round("r_num", 6).alias("r_num"), "r_den")


@query("baselines")
def all_baselines(spark, d):
    gold = _gold(spark, d)
    s = baselines.evaluate(gold, _documents(spark, d))
    return s.select("baseline", "lang", "num_docs", *[F.round(c, 6).alias(c) for c in _SCORED])


_CLOSED = " UNION ALL ".join(f"SELECT '{n}' AS baseline, * FROM ({_conll_sql(_CONLL_SUMMARY, n, best)})" for n, best in (("all_singletons", "many"), ("all_one_cluster", "one")))


@query("baselines_closed", _CLOSED)
def baselines_closed(spark, d):
    """The two baselines that follow from the sizes of the gold clusters, out of the pass that scores all three."""
    return all_baselines(spark, d).where("baseline <> 'head_match'")


_HIST = "SELECT CAST(least(size, 11) AS INTEGER) AS size, count(*) AS n FROM {} GROUP BY ALL"


@query("cluster_size_hist", select(_HIST.format("(SELECT doc_key, cluster_id, count(*) AS size FROM keyed GROUP BY ALL)"), "keyed"))
def cluster_size_hist(spark, d):
    return report.size_histogram(mentions.one_cluster_per_key(_mentions(spark, d)))


@query(
    "cluster_size_table",
    select(
        """SELECT CAST(s AS INTEGER) AS size, CASE WHEN s < 10 THEN '=' || s ELSE '≥' || s END AS label, coalesce(g, 0) AS gold, coalesce(p, 0) AS pred, coalesce(p, 0) - coalesce(g, 0) AS difference
FROM (SELECT max(size) AS top FROM (SELECT size FROM golds UNION ALL SELECT size FROM preds)), unnest(range(1, 12)) AS t(s)
LEFT JOIN (SELECT least(size, 11) AS s, count(*) AS g FROM golds GROUP BY ALL) USING (s) LEFT JOIN (SELECT least(size, 11) AS s, count(*) AS p FROM preds GROUP BY ALL) USING (s)
WHERE s <= top""",
        "golds", "preds", pred="head_match",
    ),
)
def cluster_size_table(spark, d):
    gold, _ = _scorable(spark, d)
    return report.histogram_table(gold, baselines.head_match(gold))


@query(
    "error_analysis",
    select(
        """SELECT lang, sum(g.n_gold) AS n_gold, sum(p.n_pred) AS n_pred, sum(p.perfect) AS perfect, sum(g.under) AS under_merged, sum(p.over) AS over_merged, CAST(0 AS BIGINT) AS spurious
FROM doc JOIN (SELECT doc_key, count(*) AS n_gold, count(*) FILTER (size > 1 AND parts > 1) AS under FROM golds GROUP BY ALL) g USING (doc_key)
JOIN (SELECT doc_key, count(*) AS n_pred, count(*) FILTER (parts > 1) AS over, sum(perfect) AS perfect FROM preds JOIN (SELECT doc_key, pred_id, max(CASE WHEN n = gold_size AND n = pred_size THEN 1 ELSE 0 END) AS perfect FROM cell GROUP BY ALL) USING (doc_key, pred_id) GROUP BY ALL) p USING (doc_key)
GROUP BY ALL""",
        "doc", "golds", "preds", "cell", pred="head_match",
    ),
)
def error_analysis(spark, d):
    gold, docs = _scorable(spark, d)
    return report.error_analysis(baselines.head_cells(gold), docs)


@query("ablation_pivot")
def ablation_pivot(spark, d):
    gold = _gold(spark, d)
    s = baselines.evaluate(gold, _documents(spark, d)).withColumn("conll_f", F.round("conll_f", 4))
    return report.ablation(s, run="baseline")


_TABLE = """
SELECT lang, concat_ws(' | ', rpad(upper(lang), 12, ' '), rpad(max(CASE WHEN metric = 'muc' THEN printf('%.2f', f) END), 8, ' '), rpad(max(CASE WHEN metric = 'b3' THEN printf('%.2f', f) END), 8, ' '),
  rpad(max(CASE WHEN metric = 'ceafe' THEN printf('%.2f', f) END), 9, ' '), rpad(max(CASE WHEN metric = 'conll' THEN printf('%.2f', f) END), 9, ' '), rpad(CAST(num_docs AS VARCHAR), 6, ' ')) AS line
FROM long GROUP BY lang, num_docs
"""


@query("language_table", _conll_sql(_CONLL_LONG + _TABLE, "all_one_cluster", "one"))
def language_table(spark, d):
    return report.language_table(_scores(spark, d, "all_one_cluster"))


@query("long_scores", _conll_sql(_CONLL_LONG + "SELECT lang, metric, round(p, 6) AS p, round(r, 6) AS r, round(f, 6) AS f FROM long", "all_one_cluster", "one"))
def long_scores(spark, d):
    s = score.long_scores(_scores(spark, d, "all_one_cluster"))
    return s.select("lang", "metric", *[F.round(c, 6).alias(c) for c in "prf"])


@query("score_lines", _conll_sql(_CONLL_LONG + "SELECT lang, metric, printf('  %-6s  P=%6.2f  R=%6.2f  F=%6.2f', CASE metric WHEN 'conll' THEN 'CoNLL' ELSE upper(metric) END, p, r, f) AS line FROM long", "all_one_cluster", "one"))
def score_lines(spark, d):
    return report.score_lines(score.long_scores(_scores(spark, d, "all_one_cluster")))


@query(
    "few_shot_sample",
    """
SELECT example_id, language FROM frame_examples
QUALIFY row_number() OVER (PARTITION BY coalesce(language, 'unk') ORDER BY md5('42:' || example_id), example_id) <= 5
""",
)
def few_shot_sample(spark, d):
    return sampling.exact_sample(table(spark, d, "frame_examples"), 5, "example_id", "language").select("example_id", "language")


@query("first_per_language", "SELECT example_id, language FROM frame_examples QUALIFY row_number() OVER (PARTITION BY coalesce(language, 'unk') ORDER BY example_id) <= 1")
def first_per_language(spark, d):
    return sampling.first_per_group(table(spark, d, "frame_examples"), 1, "example_id", "language").select("example_id", "language")


_EXAMPLE_JSON = """SELECT example_id, doc_id, language, instruction, masked_input AS input, output, before_mentions, after_mentions, before_sent_indices, after_sent_indices FROM frame_examples"""


@query("example_records", _EXAMPLE_JSON)
def example_records(spark, d):
    return prompts.example_records(table(spark, d, "frame_examples"))


_CHAT = "'<|im_start|>system' || chr(10) || coalesce(instruction, '') || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(masked_input, '') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query("chat_training_text", f"SELECT example_id, {_CHAT} || coalesce(output, '') || '<|im_end|>' || chr(10) || '<|im_end|>' AS text FROM frame_examples")
def chat_training_text(spark, d):
    e = table(spark, d, "frame_examples")
    return e.select("example_id", prompts.training_text(F.col("instruction"), F.col("masked_input"), F.col("output"), "chatml").alias("text"))


@query("prompt_prefix", f"SELECT example_id, {_CHAT} AS text FROM frame_examples")
def prompt_prefix(spark, d):
    e = table(spark, d, "frame_examples")
    return e.select("example_id", prompts.prompt_prefix(F.col("instruction"), F.col("masked_input"), "chatml").alias("text"))


@query("left_truncated", "SELECT example_id, array_to_string(string_split(masked_input, ' ')[-40:], ' ') AS text FROM frame_examples WHERE masked_input IS NOT NULL")
def left_truncated(spark, d):
    e = table(spark, d, "frame_examples").where("masked_input is not null")
    return e.select("example_id", F.array_join(last_tokens(F.split("masked_input", " "), 40), " ").alias("text"))


@query(
    "pair_examples",
    select(
        "SELECT doc_key, pair_idx, doc_id, lang AS language, '" + prompts.INSTRUCTIONS[5].replace("'", "''") + "' AS instruction, masked_input, output FROM pair_text JOIN doc USING (doc_key) "
        "WHERE EXISTS (SELECT 1 FROM pair_mentions m WHERE m.doc_key = pair_text.doc_key AND m.pair_idx = pair_text.pair_idx)",
        "pair_text", "doc",
    ),
)
def pair_examples(spark, d):
    """The whole example table as it would be trained on, with the instruction of the best setting."""
    p = _pairs(spark, d).join(_documents(spark, d).select("doc_key", "doc_id", "lang"), "doc_key")
    return prompts.pair_examples(p, 5).select("doc_key", "pair_idx", "doc_id", "language", "instruction", "masked_input", "output")


@query(
    "digit_values",
    "SELECT DISTINCT text, translate(text, '०१२३४५६७८९০১২৩৪৫৬৭৮৯௦௧௨௩௪௫௬௭௮௯０１２３４５６７８９', '0123456789012345678901234567890123456789') AS value FROM tokens WHERE regexp_full_match(text, '\\p{Nd}+')",
)
def digit_values(spark, d):
    t = table(spark, d, "tokens").where(F.col("text").rlike(r"^\p{Nd}+$")).select("text").distinct()
    return t.select("text", digits_to_ascii(F.col("text")).alias("value"))


_LINES_SQL = r"""
WITH lines AS (
  SELECT file_name AS file, line_no, coalesce(raw, '') AS raw FROM raw_conll_lines QUALIFY row_number() OVER (PARTITION BY file_name, line_no ORDER BY line_id) = 1
), marked AS (
  SELECT *, CASE WHEN raw LIKE '#begin document%' THEN 1 WHEN raw LIKE '#end document%' THEN 0 END AS marker,
    CASE WHEN regexp_full_match(raw, '[\s\p{Z}]*') THEN 1 ELSE 0 END AS blank FROM lines
), placed AS (
  SELECT *, sum(coalesce(marker, 0)) OVER w AS seq, sum(blank) OVER w AS brk, last_value(marker IGNORE NULLS) OVER w AS open,
    last_value(CASE WHEN marker = 1 THEN regexp_extract(raw, '^#begin document \((.+?)\)', 1) END IGNORE NULLS) OVER w AS doc_id,
    string_split(raw, chr(9)) AS c
  FROM marked WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), rows AS (
  SELECT *, try_cast(translate(regexp_replace(c[3], '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '०१२३४५६७८९০১২৩৪৫৬৭৮৯௦௧௨௩௪௫௬௭௮௯', '012345678901234567890123456789') AS INTEGER) AS tok_idx
  FROM placed WHERE marker IS NULL AND open = 1 AND blank = 0 AND len(c) >= 4
    AND regexp_full_match(c[3], '[\s\p{Z}]*[+-]?\p{Nd}+[\s\p{Z}]*')
)
SELECT file, CAST(seq - 1 AS BIGINT) AS doc_seq, doc_id, dense_rank() OVER (PARTITION BY file, seq ORDER BY brk) - 1 AS sent_idx,
  row_number() OVER (PARTITION BY file, seq, brk ORDER BY line_no) - 1 AS tok_pos, tok_idx, c[4] AS text, CASE WHEN len(c) > 4 THEN c[len(c)] ELSE '-' END AS coref
FROM rows WHERE tok_idx IS NOT NULL
"""


@query("conll_scan", _LINES_SQL)
def conll_scan(spark, d):
    return conll.scan_lines(conll.first_delivery(table(spark, d, "raw_conll_lines")))


_WRITTEN = """
SELECT doc_key, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY s, t) - 1 AS INTEGER) AS line_no, line FROM (
  SELECT k.doc_key, k.sent_idx AS s, k.tok_pos AS t, concat_ws(chr(9), d.doc_id, '0', CAST(coalesce(k.idx, k.tok_pos) AS VARCHAR), k.text, '_', '_', coalesce(m.cell, '-')) AS line
  FROM tok k JOIN doc d USING (doc_key) LEFT JOIN (
    SELECT doc_key, sent_idx, tok_pos, string_agg(mark, '|' ORDER BY start_tok, end_tok, cluster_id, mark) AS cell FROM (
      SELECT doc_key, sent_idx, start_tok AS tok_pos, start_tok, end_tok, cluster_id, CASE WHEN start_tok = end_tok THEN '(' || cluster_id || ')' ELSE '(' || cluster_id END AS mark FROM keyed
      UNION ALL
      SELECT doc_key, sent_idx, end_tok, start_tok, end_tok, cluster_id, cluster_id || ')' FROM keyed WHERE start_tok <> end_tok) GROUP BY ALL
  ) m ON m.doc_key = k.doc_key AND m.sent_idx = k.sent_idx AND m.tok_pos = k.tok_pos
  UNION ALL SELECT doc_key, sent_idx, max(tok_pos) + 1, '' FROM tok JOIN doc USING (doc_key) GROUP BY ALL
  UNION ALL SELECT doc_key, -1, 0, '#begin document (' || doc_id || '); part 0' FROM doc WHERE doc_key IN (SELECT doc_key FROM tok)
  UNION ALL SELECT doc_key, 2147483647, 0, '#end document' FROM doc WHERE doc_key IN (SELECT doc_key FROM tok))
"""


@query("conll_lines", select(_WRITTEN, "tok", "doc", "keyed"))
def conll_lines(spark, d):
    t = _tokens(spark, d)
    found = mentions.one_cluster_per_key(mentions.mentions(t, tolerant=True))
    return conll.conll_lines(t, found, _documents(spark, d))
