"""The coreference operators on fixtures worked out by hand, and against plain statements of what they mean."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from entwine.functions import prompts
from entwine.functions.text import clamped, fill_masks, head_word, last_tokens, mask_count
from entwine.operators import baselines, frames, mentions, merge, predict, report, sampling, score
from entwine.operators.assignment import best_assignment, best_total
from entwine.sources.tables import marked_sentences, sentences

TOKENS = "doc_key long, sent_idx int, tok_pos int, idx int, text string, coref string"
MENTIONS = "doc_key long, mention_ord int, sent_idx int, start_tok int, end_tok int, cluster_id long, is_zero boolean"
KEYED = "doc_key long, sent_idx int, start_tok int, end_tok int, cluster_id long"


def tokens_of(spark, docs):
    """docs: {key: [[(text, coref), ...], ...]}"""
    rows = [(k, s, i, i, t, c) for k, sents in docs.items() for s, sent in enumerate(sents) for i, (t, c) in enumerate(sent)]
    return spark.createDataFrame(rows, TOKENS)


@pytest.mark.parametrize(
    "cell, events",
    [("-", []), ("*", []), ("", []), ("(3)", [("singleton", 3)]), ("(3", [("open", 3)]), ("3)", [("close", 3)]), ("(3)|(5", [("singleton", 3), ("open", 5)]), ("(3)|-", [("singleton", 3)]), ("( 3)", []), ("(१२)", [("singleton", 12)]), (" (4) | 5)", [("singleton", 4), ("close", 5)])],
)
def test_cells(spark, cell, events):
    got = mentions.coref_events(tokens_of(spark, {1: [[("x", cell)]]})).orderBy("part_pos").collect()
    assert [(r["kind"], r["cluster_id"]) for r in got] == events


@pytest.mark.parametrize(
    "cells, found",
    [(["(1", "-", "1)"], [(0, 2, 1)]), (["(1", "(1", "1)", "1)"], [(0, 2, 1)]), (["(1", "-"], [(0, 0, 1)]), (["1)"], []), (["(1|(2)", "1)"], [(0, 0, 2), (0, 1, 1)])],
)
def test_spans(spark, cells, found):
    got = mentions.mentions(tokens_of(spark, {1: [[("x", c) for c in cells]]})).orderBy("mention_ord").collect()
    assert [(r["start_tok"], r["end_tok"], r["cluster_id"]) for r in got] == found


def machine(events):
    """The same by a state machine: (start, end, cluster) in the order of their ends."""
    opened, out = {}, []
    for at, kind, c in events:
        if kind == "singleton":
            out.append((at, at, c))
        elif kind == "open":
            opened.setdefault(c, at)
        elif c in opened:
            out.append((opened.pop(c), at, c))
    return out + [(at, at, c) for c, at in opened.items()]


def test_spans_like_a_state_machine(spark):
    rng = random.Random(3)
    docs, want = {}, {}
    for k in range(300):
        events = [(i, rng.choice(["singleton", "open", "close", "close", "open"]), rng.randint(0, 2)) for i in range(rng.randint(0, 14))]
        mark = {"singleton": "({})", "open": "({}", "close": "{})"}
        docs[k] = [[("x", mark[e].format(c)) for _, e, c in events]] if events else []
        want[k] = machine(events)
    got = {}
    for r in mentions.mentions(tokens_of(spark, docs), keep_defects=True).orderBy("doc_key", "mention_ord").collect():
        got.setdefault(r["doc_key"], []).append((r["start_tok"], r["end_tok"], r["cluster_id"]))
    assert got == {k: v for k, v in want.items() if v}


def test_spans_over_sentences_are_set_apart(spark):
    t = tokens_of(spark, {1: [[("a", "(1"), ("b", "(2)")], [("c", "1)")]]})
    assert [(r["cluster_id"]) for r in mentions.mentions(t).collect()] == [2]
    assert [tuple(r) for r in mentions.mention_defects(t).collect()] == [(1, 1, 1)]


def greedy(sizes, budget):
    def once(b):
        out, used = [[]], 0
        for i, n in enumerate(sizes):
            if out[-1] and used + n > b:
                out.append([])
                used = 0
            out[-1].append(i)
            used += n
        return out

    found = once(budget)
    while len(sizes) > 1 and len(found) < 2:
        budget = max(1, budget // 2)
        found = once(budget)
    return found


@pytest.mark.parametrize("sizes, budget, want", [([4, 3, 9, 1, 1], 8, [[0, 1], [2], [3, 4]]), ([4, 3], 10, [[0], [1]]), ([1, 1], 256, [[0], [1]]), ([7], 256, [[0]])])
def test_packing(spark, sizes, budget, want):
    s = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "doc_key long, sent_idx int, n_tokens int")
    assert [r["sent_indices"] for r in frames.pack(s, budget).orderBy("frame_idx").collect()] == want == greedy(sizes, budget)


def test_packing_like_a_loop(spark):
    rng = random.Random(4)
    docs = {k: [rng.randint(1, 40) for _ in range(rng.randint(1, 30))] for k in range(200)}
    s = spark.createDataFrame([(k, i, n) for k, sizes in docs.items() for i, n in enumerate(sizes)], "doc_key long, sent_idx int, n_tokens int")
    got = {}
    for r in frames.pack(s, 64).orderBy("doc_key", "frame_idx").collect():
        got.setdefault(r["doc_key"], []).append(r["sent_indices"])
    assert got == {k: greedy(sizes, 64) for k, sizes in docs.items()}


@pytest.mark.parametrize("spans, kept", [([(0, 4), (1, 2)], [(0, 4)]), ([(0, 2), (1, 5), (4, 4)], [(0, 2), (4, 4)]), ([(0, 0), (0, 3)], [(0, 3)]), ([(7, 7)], []), ([(3, 2)], [])])
def test_outermost(spark, spans, kept):
    s = spark.createDataFrame([(1, 0, list("abcdef"), 6)], "doc_key long, sent_idx int, words array<string>, n_tokens int")
    m = spark.createDataFrame([(1, i, 0, a, b, i, False) for i, (a, b) in enumerate(spans)], MENTIONS)
    assert [(x["s"], x["e"]) for x in frames.selected(s, m).first()["taken"]] == kept


def test_zero_mentions(spark):
    words = [(1, 0, ["He", "said", "hello", "."], 4), (1, 1, ["She", "left", "."], 3)]
    s = spark.createDataFrame(words, "doc_key long, sent_idx int, words array<string>, n_tokens int")
    m = spark.createDataFrame([(1, 0, 0, 0, 0, 0, False), (1, 1, 0, 2, 2, 0, True)], MENTIONS)
    p = frames.pairs(s, m, 10).first()
    assert p["masked_input"] == "<m>He</m>#MASK said </z>@MASK hello . [MID] She left ."
    assert p["output"] == "<m>He</m>#0 said </z>#0 hello . [MID] She left ."
    assert (p["before_sent_indices"], p["after_sent_indices"]) == ([0], [1])
    # a zero mention at the place of an overt one: first in order decides
    for order, text in (((True, False), "</z>@MASK <m>He</m>#MASK"), ((False, True), "<m>He</m>#MASK said")):
        m = spark.createDataFrame([(1, i, 0, 0, 0, i, z) for i, z in enumerate(order)], MENTIONS)
        assert frames.pairs(s, m, 10).first()["masked_input"].startswith(text)


def test_pairs_without_mentions_and_overlong_spans(spark):
    s = spark.createDataFrame([(1, 0, ["a"], 1), (1, 1, ["b"], 1)], "doc_key long, sent_idx int, words array<string>, n_tokens int")
    none = spark.createDataFrame([], MENTIONS)
    assert frames.pairs(s, none).count() == 0
    assert frames.pairs(s, none, skip_empty=False).first()["masked_input"] == "a [MID] b"
    m = spark.createDataFrame([(1, 0, 0, 0, 9, 5, False)], MENTIONS)
    p = frames.pairs(s, m).first()
    assert p["masked_input"] == "<m>a</m>#MASK [MID] b" and p["before_mentions"][0]["end_tok"] == 9


def test_masks(spark):
    df = spark.createDataFrame([("<m>He</m>#MASK said </z>@MASK hello .", [0, 0]), ("no place", [3]), ("a#MASK b#MASK", [7]), ("#MASK", [])], "m string, n array<int>")
    got = df.select(mask_count(F.col("m")).alias("k"), fill_masks(F.col("m"), F.col("n")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(2, "<m>He</m>#0 said </z>#0 hello ."), (0, "no place"), (2, "a#7 b#1"), (1, "#0")]


def test_numbers_and_truncation(spark):
    df = spark.createDataFrame([("12x",), ("999",), ("",), ("x",), ("१२",), ("9" * 30,), (None,)], "d string")
    assert [r[0] for r in df.select(clamped(F.col("d"))).collect()] == [12, 200, 0, 0, 12, 200, 0]
    assert spark.range(1).select(last_tokens(F.array(*map(F.lit, "abc")), 2)).first()[0] == ["b", "c"]


def test_heads(spark):
    df = spark.createDataFrame([(["The", "Man", "."], 0, 2), ([".", ","], 0, 1), (["A", ".."], 0, 1), (["", "x"], 0, 0), (["a"], 0, 5)], "w array<string>, s int, e int")
    assert [r[0] for r in df.select(head_word(F.col("w"), F.col("s"), F.col("e"))).collect()] == ["man", ",", "..", "", "a"]


def test_rounding_as_printed(spark):
    """Half to even on the exact binary value, as Python prints it."""
    xs = [65.625, 65.615, 2.675, 0.125, 100.0, 0.005, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(report.fixed(F.col("x"), 6)).collect()] == [f"{x:6.2f}" if x is not None else "     —" for x in xs]


def test_a_model_behind_the_protocol():
    """A tokenizer of characters and a model that repeats the number of marks so far; too long prompts lose their beginning."""
    seen = []

    def following(ids):
        seen.append(len(ids))
        text = "".join(map(chr, ids))
        return ord(str(text.count("#") % 10)) if text.endswith("#") else ord(" ")

    make = lambda longest: predict.TokenDecoder(lambda t: list(map(ord, t)), lambda ids: "".join(map(chr, ids)), following, longest)
    d = make(1000)
    assert predict.controlled(d, "p", "a#MASK b@MASK c") == [1, 2]
    assert "".join(map(chr, d.ids)) == "pa#1 b#2 c#"
    assert predict.controlled(make(3), "#####", "a#MASK") == [2] and max(seen) < 12
    # a token with a blank before its digits is a number too
    d = make(1000)
    d.decode = lambda ids: " " + "".join(map(chr, ids))
    assert predict.controlled(d, "p", "a#MASK") == [1]


def test_one_long_document(spark):
    """Pairs of thousands of frames of one document; the work grows with its length."""
    import time

    def took(n):
        rows = spark.range(n * 4).selectExpr("1L as doc_key", "cast(id div 4 as int) as sent_idx", "cast(id % 4 as int) as tok_pos", "0 as idx", "concat('w', id % 9) as text", "if(id % 4 = 0, '(1)', '-') as coref")
        marked = marked_sentences(rows)
        start = time.perf_counter()
        found = frames.pairs_of(mentions.sentences_with_mentions(marked), marked, 4).agg(F.count("output"), F.sum(F.length("masked_input"))).first()
        assert found[0] == n - 1
        return time.perf_counter() - start

    took(500)
    assert took(16000) < 30 * max(took(2000), 1)


class Counting:
    """Gives the numbers 0, 1, 2 ... as tokens, each followed by a blank."""

    def __init__(self):
        self.n, self.open, self.seen = 0, False, ""

    def start(self, prompt):
        self.seen, self.n = prompt, 0

    def extend(self, text):
        self.seen += text

    def next_token(self):
        self.open = not self.open
        if self.open:
            self.n += 1
            return str(self.n - 1)
        return " "


def test_controlled_prediction(spark):
    assert predict.controlled(Counting(), "p", "a#MASK b@MASK c") == [0, 1]
    assert predict.controlled(Counting(), "p", "nothing") == []
    df = spark.createDataFrame([(1, 0, "i", "x#MASK y#MASK"), (1, 1, None, None)], "doc_key long, pair_idx int, instruction string, masked_input string")
    assert [r["numbers"] for r in predict.model_numbers(df, Counting).orderBy("pair_idx").collect()] == [[0, 1], []]


RESULT = "doc_key long, pair_idx int, before_mentions array<struct<sent_idx:int,start_tok:int,end_tok:int,predicted_local_no:int>>, after_mentions array<struct<sent_idx:int,start_tok:int,end_tok:int,predicted_local_no:int>>"


def merged(spark, docs):
    rows = [(d, k, *[[(s, 0, 0, n) for s, n in side] for side in pair]) for d, pairs in docs.items() for k, pair in enumerate(pairs)]
    got = {}
    for r in merge.merge_pairs(spark.createDataFrame(rows, RESULT)).collect():
        got.setdefault(r["doc_key"], {})[r["sent_idx"]] = r["cluster_id"]
    return got


def test_merge(spark):
    a, b, c, d, e, f = range(6)
    got = merged(spark, {1: [([(a, 0), (b, 1)], [(c, 0), (d, 2)]), ([(c, 5), (d, 5)], [(e, 5), (f, 1)])], 2: [([], [(a, 3)])]})
    assert got == {1: {a: 0, b: 1, c: 0, d: 2, e: 0, f: 3}, 2: {a: 0}}


def test_merge_like_the_algorithm(spark):
    rng = random.Random(6)

    def plain(pairs):
        known = {}
        for before, after in pairs:
            local = {}
            for m, n in before:
                if m in known:
                    local.setdefault(n, known[m])
                else:
                    known[m] = local.setdefault(n, max(known.values(), default=-1) + 1)
            for m, n in after:
                if n not in local:
                    local[n] = max(known.values(), default=-1) + 1
                known[m] = local[n]
        return known

    docs = {}
    for k in range(150):
        groups = [[10 * i + j for j in range(rng.randint(0, 3))] for i in range(rng.randint(2, 6))]
        docs[k] = [([(m, rng.randint(0, 3)) for m in x], [(m, rng.randint(0, 3)) for m in y]) for x, y in zip(groups, groups[1:])]
    want = {k: plain(v) for k, v in docs.items()}
    # numbers of replaced clusters are not used again here, so compare the partition
    got = merged(spark, docs)
    part = lambda x: {frozenset(m for m in x if x[m] == c) for c in x.values()}
    assert {k: part(v) for k, v in got.items()} == {k: part(v) for k, v in want.items() if v}


def clustering(spark, docs):
    return spark.createDataFrame([(k, 0, m, m, c) for k, clusters in docs.items() for c, ms in enumerate(clusters) for m in ms], KEYED)


def plain_scores(gold, pred):
    of = lambda x: {m: i for i, c in enumerate(x) for m in c}
    og, op = of(gold), of(pred)

    def muc(a, ob):
        num = den = 0
        for c in a:
            if len(c) > 1:
                hit = {ob[m] for m in c if m in ob}
                num += len(c) - len(hit) - sum(m not in ob for m in c)
                den += len(c) - 1
        return num, den

    r = sum(len(set(gold[og[m]]) & set(pred[op[m]])) / len(gold[og[m]]) if m in op else 1 / len(gold[og[m]]) for m in og)
    p = sum(len(set(gold[og[m]]) & set(pred[op[m]])) / len(pred[op[m]]) if m in op else 1.0 for m in og)
    w = [[2 * len(set(g) & set(q)) / (len(g) + len(q)) for q in pred] for g in gold]
    small, large = (len(gold), len(pred)) if len(gold) <= len(pred) else (len(pred), len(gold))
    best = max((sum(w[i][j] if len(gold) <= len(pred) else w[j][i] for i, j in enumerate(perm)) for perm in itertools.permutations(range(large), small)), default=0)
    return muc(gold, op), muc(pred, og), r, p, len(og), best


def test_metrics_of_the_fixture(spark):
    sums = score.ratios(score.document_sums(score.cells(clustering(spark, {1: [[1, 2], [3]]}), clustering(spark, {1: [[1, 2, 3]]})))).first()
    want = {"muc_r": 1, "muc_p": 0.5, "b3_p": 5 / 9, "b3_r": 1, "ceafe_num": 0.8, "ceafe_p": 0.8, "ceafe_r": 0.4}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: sums[k] for k in want}


def test_metrics_like_their_definitions(spark):
    rng = random.Random(8)
    gold, pred = {}, {}
    for k in range(120):
        for side in (gold, pred):
            ms = [m for m in range(7) if rng.random() < 0.8]
            label = {m: rng.randint(0, 3) for m in ms}
            side[k] = [[m for m in ms if label[m] == c] for c in sorted(set(label.values()))]
    rows = {r["doc_key"]: r for r in score.document_sums(score.cells(clustering(spark, gold), clustering(spark, pred))).collect()}
    for k in gold:
        if not gold[k] and not pred[k]:
            assert k not in rows
            continue
        (rn, rd), (pn, pd), br, bp, n, best = plain_scores(gold[k], pred[k])
        r = rows[k]
        assert (r["muc_r_num"], r["muc_r_den"], r["muc_p_num"], r["muc_p_den"], r["b3_den"]) == (rn, rd, pn, pd, n)
        assert (r["b3_r_num"], r["b3_p_num"], r["ceafe_num"]) == (pytest.approx(br), pytest.approx(bp), pytest.approx(best))
        assert (r["n_gold"], r["n_pred"]) == (len(gold[k]), len(pred[k]))


def test_same_clusterings_score_100(spark):
    gold = clustering(spark, {1: [[1, 2], [3]], 2: [[1, 2, 3]]})
    docs = spark.createDataFrame([(1, "hi"), (2, "ta"), (3, "ta")], "doc_key long, lang string")
    rows = {r["lang"]: r for r in score.corpus_scores(gold, gold, docs).collect()}
    assert set(rows) == {"hi", "ta", "overall"} and rows["ta"]["num_docs"] == 2
    assert all(r[f"{m}_{x}"] == pytest.approx(100) for r in rows.values() for m in ("muc", "b3", "ceafe", "conll") for x in "prf")
    one = score.corpus_scores(gold, gold, docs.where("lang = 'hi'"), only_scored=True).collect()
    assert {r["lang"] for r in one} == {"hi", "all", "overall"}


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], KEYED)
    docs = spark.createDataFrame([(1, "hi")], "doc_key long, lang string")
    rows = score.corpus_scores(none, none, docs).collect()
    assert [(r["lang"], r["num_docs"], r["conll_f"]) for r in rows] == [("hi", 1, 0.0)]
    assert score.document_scores(none, none).count() == 0


def test_assignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 5, 2).tolist()
        w = rng.random((n, m)).round(2)
        best = max(sum(w[i, j] if n <= m else w[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        found = best_assignment(w)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == min(n, m)
        assert sum(w[i, j] for i, j in found) == pytest.approx(best)
        edges = [(i, j, w[i, j]) for i in range(n) for j in range(m) if w[i, j] > 0.3]
        part = np.where(w > 0.3, w, 0)
        assert best_total(edges) == pytest.approx(max(sum(part[i, j] if n <= m else part[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m))))
    assert best_total([]) == 0


def test_baselines_and_reports(spark):
    t = tokens_of(spark, {1: [[("He", "(0)"), ("saw", "-"), ("him", "(1)"), (".", "-"), ("he", "(0)")]], 2: [[("Alone", "(0)")]]})
    found = mentions.with_heads(mentions.one_cluster_per_key(mentions.mentions(t)), sentences(t))
    docs = spark.createDataFrame([(1, "hi"), (2, "hi")], "doc_key long, lang string")
    ids = {r["start_tok"]: r["cluster_id"] for r in baselines.head_match(found.where("doc_key = 1")).collect()}
    assert ids == {0: 0, 2: 1, 4: 0}
    rows = {r["baseline"]: r for r in baselines.evaluate(found, docs).collect()}
    assert rows["head_match"]["conll_f"] == pytest.approx(100) and all(r["num_docs"] == 1 for r in rows.values())
    assert rows["all_one_cluster"]["muc_p"] == pytest.approx(50) and rows["all_singletons"]["muc_f"] == 0
    gold, one = found.where("doc_key = 1"), baselines.all_one_cluster(found.where("doc_key = 1"))
    e = report.error_analysis(score.cells(gold, one), docs).first()
    assert (e["n_gold"], e["n_pred"], e["perfect"], e["under_merged"], e["over_merged"], e["spurious"]) == (2, 1, 0, 0, 1, 0)
    table = report.histogram_table(gold, one).orderBy("size").collect()
    assert [(r["label"], r["gold"], r["pred"]) for r in table] == [("=1", 1, 0), ("=2", 1, 0), ("=3", 0, 1)]
    s = baselines.evaluate(found, docs)
    assert set(report.ablation(s, "baseline", groups=["hi", "ta"]).columns) == {"baseline", "hi", "ta"}
    assert report.language_table(s.where("baseline = 'head_match'")).first()["line"].startswith("HI           | 100.00")


def test_duplicate_keys(spark):
    m = spark.createDataFrame([(1, 0, 0, 0, 0, 5, False), (1, 1, 0, 0, 0, 6, False), (1, 2, 0, 1, 1, 5, False)], MENTIONS)
    assert {r["start_tok"]: r["cluster_id"] for r in mentions.one_cluster_per_key(m).collect()} == {0: 5, 1: 5}
    assert mentions.duplicate_keys(m).first()["n_clusters"] == 2


def test_samples(spark):
    df = spark.createDataFrame([(i, "hi" if i % 3 else None) for i in range(30)], "id long, language string")
    got = sampling.exact_sample(df, 4, "id", "language").collect()
    assert sorted(str(r["language"]) for r in got) == ["None"] * 4 + ["hi"] * 4
    assert {tuple(r) for r in got} == {tuple(r) for r in sampling.exact_sample(df.repartition(7), 4, "id", "language").collect()}
    assert sampling.exact_sample(df, 100, "id", "language").count() == 30


def test_prompts(spark):
    row = spark.range(1).select(
        prompts.instruction(1, "hi").alias("a"), prompts.instruction(9, "hi").alias("b"), prompts.instruction(5).alias("c"), prompts.instruction(1, "").alias("d"),
        *[prompts.training_text(F.lit("S"), F.lit("U"), F.lit("A"), f).alias(f) for f in prompts.TEMPLATES], prompts.prompt_prefix(F.lit("S"), F.lit(None).cast("string"), "chatml").alias("p"),
    ).first()
    assert row["a"].startswith("The text is in hi.\n") and row["b"] == row["c"] and row["d"].startswith("The text is in the given language.\n")
    for family, template in prompts.TEMPLATES.items():
        assert row[family].endswith(template[4]) and prompts.response_mark(row[family])
    assert row["p"].endswith("assistant\n") and prompts.response_mark("plain") is None
