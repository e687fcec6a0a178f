"""Pieces, packing and overlaps: their invariants, exact searches, odd tables."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entwine.llm import chunking, overlap, packing

LIMIT, OVER, SLACK = 120, 20, 8


def check(text, pieces, limit=LIMIT, over=OVER, slack=SLACK):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == "text"
    for (a, b, how), (c, d, _) in zip(pieces, pieces[1:]):
        assert b < d and over <= b - c <= over + slack and c > a
        if how == "word":
            assert not text[b - 1].isspace() and text[b].isspace()
    assert all(b - a <= limit for a, b, _ in pieces)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab।. \nका", max_size=900))
def test_pieces(text):
    pieces = chunking.chunk(text, None, LIMIT, OVER, SLACK)
    if len(text) <= LIMIT:
        assert pieces == [(0, len(text), "text")]
    else:
        check(text, pieces)


def test_pieces_without_blanks_and_with_markup():
    check("क्षा" * 400, chunking.chunk("क्षा" * 400, None, LIMIT, OVER, SLACK))
    rng = random.Random(2)
    text = " ".join(rng.choice(["<m>two words</m>#MASK", "</z>@MASK", "word", "end ."]) for _ in range(300))
    pieces = chunking.chunk(text, None, LIMIT, OVER, SLACK)
    check(text, pieces)
    for _, b, how in pieces[:-1]:
        if how != "cut":
            assert text[:b].count("<m>") == text[:b].count("</m>#MASK")


def test_an_edit_changes_its_neighbours_only():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) + rng.choice(["", "", "", "."]) for _ in range(6000))
    edited = text[:9000] + " new words here" + text[9000:]
    old = {text[a:b] for a, b, _ in chunking.chunk(text)}
    new = [edited[a:b] for a, b, _ in chunking.chunk(edited)]
    assert len(new) > 25 and sum(p not in old for p in new) <= 6


def test_bad_limits():
    with pytest.raises(ValueError):
        chunking.chunk("x" * 100, None, 50, 20, 8)


def test_piece_tables(spark):
    sentence = "word " * 30 + "."
    docs = spark.createDataFrame([(1, [sentence] * 40, "x"), (2, ["short", None], "x"), (3, None, "x"), (4, [], "x"), (5, ["क" * 5000], "x"), (6, ["y" * 2000], "x"), (7, ["y" * 2001], "x")], "doc_key long, sentences array<string>, text string")
    texts = [(1, "a <m>b</m>#MASK [MID] c", "[0]", "[1]"), (2, "w " * 900 + "[MID]" + " v" * 900, "[0, 1]", "[2]"), (3, None, None, None), (4, "", "[]", "bad")]
    examples = spark.createDataFrame(texts, "example_id long, masked_input string, before_sent_indices string, after_sent_indices string")
    assert sorted(tuple(r) for r in chunking.found_items(docs, examples).collect()) == [("document", 1), ("document", 5), ("document", 7), ("example", 2)]
    p = chunking.split_items(chunking.document_items(docs)).orderBy("item_key", "piece_no").collect()
    assert {r["item_key"] for r in p} == {1, 2, 4, 5, 6, 7} and all(len(r["text"]) == r["end"] - r["start"] <= 2000 for r in p)
    assert next(r for r in p if r["item_key"] == 2)["text"] == "short"
    one = [r for r in p if r["item_key"] == 1]
    assert all(r["ends_at"] == "sentence" for r in one[:-1]) and one[0]["first_part"] == 0 and one[-1]["last_part"] == 39
    e = {(r["item_key"], r["piece_no"]): r for r in chunking.example_pieces(examples).collect()}
    assert e[1, 0]["before_sent_indices"] == [0] and e[1, 0]["after_sent_indices"] == [1]
    assert e[2, 0]["after_sent_indices"] == [] and max(k for i, k in e if i == 2) >= 1 and e[2, max(k for i, k in e if i == 2)]["after_sent_indices"] == [2]
    assert chunking.split_items(chunking.document_items(docs.limit(0))).count() == 0


def test_indices_of_the_sentences_that_a_piece_touches(spark):
    """Every word of a masked text names its sentence, so the indices can be read off the pieces."""
    rng = random.Random(11)
    sentences = [" ".join(f"s{k}w{i}" for i in range(rng.randint(0 if k == 3 else 1, 60))) for k in range(40)]

    def masked(ks):
        out = []
        for k in ks:
            words = sentences[k].split()
            out.append(" ".join(f"<m>{w}</m>#MASK" if rng.random() < 0.1 else f"</z>@MASK {w}" if rng.random() < 0.05 else w for w in words))
        return " ".join(out)

    rows = [(n, 1, masked(range(a, a + 12)) + " [MID]  " + masked(range(a + 12, a + 24)), str(list(range(a, a + 12))), str(list(range(a + 12, a + 24)))) for n, a in enumerate((0, 5, 16))]
    rows.append((9, 2, "w " * 1500, "[0]", "[1]"))
    examples = spark.createDataFrame(rows, "example_id long, doc_key long, masked_input string, before_sent_indices string, after_sent_indices string")
    documents = spark.createDataFrame([(1, sentences)], "doc_key long, sentences array<string>")
    got = chunking.example_pieces(examples, documents, limit=700, overlap=60, slack=30).collect()
    assert len(got) > 12
    for r in got:
        if r["item_key"] == 9:
            assert (r["before_sent_indices"], r["after_sent_indices"]) == ([0], [1])
            continue
        import re

        # a cut inside a word may show no more than its end, so the whole words tell
        seen = sorted({int(k) for k in re.findall(r"(?<!\w)s(\d+)w", r["text"])})
        touched = r["before_sent_indices"] + r["after_sent_indices"]
        assert set(seen) <= set(touched) and len(touched) - len(seen) <= 2 and touched == sorted(touched)


def test_complements_are_found_whenever_there_are_any():
    rng = random.Random(12)
    for _ in range(4000):
        counts = [0] * 65
        for _ in range(rng.randint(0, 7)):
            counts[rng.randint(1, 20)] = rng.randint(1, 2)
        gap = rng.randint(1, 40)
        available, mirrored = (sum(1 << (size if side else 64 - size) for size, n in enumerate(counts) if n) for side in (1, 0))
        items = [size for size, n in enumerate(counts) for _ in range(n)]
        can = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
        got = packing._exact(gap, available, mirrored, 64, counts)
        assert bool(got) == can and (not got or sum(got) == gap and all(got.count(x) <= counts[x] for x in got))


def test_plans():
    rng = random.Random(4)
    for _ in range(400):
        capacity = rng.choice([1, 2, 7, 10, 64, 200])
        histogram = {}
        for _ in range(rng.randint(0, 40)):
            size = rng.randint(1, capacity)
            histogram[size] = histogram.get(size, 0) + rng.randint(1, 9)
        held = {}
        for times, items in packing.plan(histogram, capacity):
            assert times > 0 and sum(size * each for size, each in items) <= capacity
            for size, each in items:
                held[size] = held.get(size, 0) + times * each
        assert held == histogram


def test_exact_complements_are_used():
    assert len(packing.plan({7: 5, 3: 5}, 10)) == 1
    assert sum(t for t, _ in packing.plan({6: 4, 3: 4, 1: 4}, 10)) == 4
    assert sum(t for t, _ in packing.plan({4: 2, 3: 4, 2: 2, 1: 2}, 10)) == 3
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_packing_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, 3, 10, 25, 64, 64, 64, 130, 128])) for i in range(600)]
    sizes = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, n_tokens int, sequence int")
    got = packing.pack_sizes(sizes, capacity=64, salts=5).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["sequence"] is not None:
            by_sequence.setdefault(r["sequence"], []).append((r["offset"], r["offset"] + r["n_tokens"]))
    assert set(by_doc) == {i for i, _ in rows}
    for i, n in rows:
        pieces = sorted(by_doc[i], key=lambda r: r["piece_no"])
        assert sum(r["n_tokens"] for r in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 64))
        assert [r["start"] for r in pieces] == [64 * k for k in range(len(pieces))] and all((r["sequence"] is None) == (not n) for r in pieces)
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert set(by_sequence) == set(range(len(by_sequence)))
    report = packing.fill_report(packing.pack_sizes(sizes, capacity=64), 64).first()
    assert report["n_over"] == 0 and report["filled"] > 0.95
    assert packing.pack_sizes(sizes.limit(0), capacity=64).count() == 0


def test_texts_are_packed(spark):
    df = spark.createDataFrame([(1, "the house " * 2000), (2, None), (3, ""), (4, "a"), (5, "a")], "doc_id long, text string")
    got = packing.pack_texts(df).collect()
    assert sum(r["sequence"] is None for r in got) == 2 and {r["doc_id"] for r in got} == {1, 2, 3, 4, 5}


TOKENS = "token_id long, doc_key long, doc_id string, sent_idx int, tok_pos int, text string, loaded_at timestamp, class string"


def corpus(spark, docs, splits):
    rows = [(k * 10_000 + i, k, "same", i // 7, i % 7, w, None, "x") for k, words in docs.items() for i, w in enumerate(words)]
    documents = spark.createDataFrame([(k, s, "c") for k, s in splits.items()], "doc_key long, split string, corpus string")
    return spark.createDataFrame(rows, TOKENS), documents


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def damaged(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out += [f"q{rng.randint(0, 99)}"] if r < 2 * rate / 3 else [w, f"q{rng.randint(0, 99)}"] if r < rate else [w]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 41, 100, 333])
def test_segments_are_enough_and_do_not_overlap(n):
    rng = np.random.default_rng(n)
    for share in (0.52, 0.6, 0.75, 0.9, 1.0):
        words = rng.integers(1, 9, n)
        sketch = overlap.Sketch(rng.integers(0, 100, (2, 64)))
        for cut in (overlap.cut_segments(n, sketch.estimates(words), share, 3), overlap._cut_in_pairs(n, sketch.estimates(words), share, 3)):
            start, length, least = cut
            covered = [p for a, k in zip(start, length) for p in range(a, a + k)]
            assert len(covered) == len(set(covered)) and max(covered) < n and 1 <= least <= 3
            own = n - overlap.least_common(n, n, share)
            assert len(start) == (own if set(length) == {1} and len(start) < overlap.unmatched(n, share) + least else overlap.unmatched(n, share)) + least


def test_frequent_words_lie_together():
    """Pairs of frequent words are joined in segments of four, rare words stand alone."""
    words = np.array([1, 2, 1, 2] * 10 + list(range(100, 140)))
    counters = np.zeros((2, 1 << 16), np.int64)
    for length in (1, 2):
        codes = overlap.run_codes(np.array([1, 2, 1]), length)
        for row, at in enumerate(overlap.Sketch.places(codes, 1 << 16)):
            counters[row][at] = 1000
    start, length, _ = overlap.cut_segments(80, overlap.Sketch(counters).estimates(words))
    assert {int(k) for a, k in zip(start, length) if a < 40} <= {4} and 1 in length
    start, length, _ = overlap._cut_in_pairs(80, overlap.Sketch(counters).estimates(words), 0.75, 3)
    assert {int(k) for a, k in zip(start, length) if a < 40} == {4} and 1 in length
    # a text of nothing but frequent words, which are rare in pairs
    counters[:] = 0
    code = overlap.run_codes(np.arange(80), 1)
    for row, at in enumerate(overlap.Sketch.places(code, 1 << 16)):
        counters[row][at] = 1000
    start, length, _ = overlap.cut_segments(80, overlap.Sketch(counters).estimates(np.arange(80)))
    assert 2 in length


@pytest.mark.parametrize("vocabulary, least, share", [(30, 40, 0.75), (400, 40, 0.75), (6, 2, 0.55), (12, 3, 0.9)])
def test_overlaps_like_an_exact_search(spark, vocabulary, least, share):
    rng = random.Random(vocabulary)
    docs, splits = {}, {}
    for k in range(120):
        base = rng.choice(list(docs.values())) if docs and rng.random() < 0.6 else [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(30, 90) if least > 9 else rng.randint(1, 9))]
        docs[k] = damaged(rng, base, rng.choice([0, 0, 0.1, 0.25, 0.4]))
        splits[k] = rng.choice(["train", "train", "test", "val", "development", "other", None])
    want = set()
    for a in docs:
        for b in docs:
            if splits[a] == "train" and splits[b] in ("test", "val", "development") and min(len(docs[a]), len(docs[b])) >= least and lcs(docs[a], docs[b]) >= overlap.least_common(len(docs[a]), len(docs[b]), share):
                want.add((a, b))
    t, d = corpus(spark, docs, splits)
    got = [(r["train_key"], r["eval_key"]) for r in overlap.cross_split_overlaps(t.repartition(3), d, least, share).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    if least == overlap.MIN_WORDS:
        assert {tuple(r) for r in overlap.found_pairs(t, d).collect()} == {(min(p), max(p)) for p in want}
        report = overlap.overlap_report(t, d).agg(F.sum("n_pairs"), F.sum("n_documents"), F.sum("n_overlapping"), F.sum("n_exact_pairs")).first()
        exact = sum(docs[a] == docs[b] for a, b in want)
        assert tuple(report) == (len(want), sum(s in ("test", "val", "development") for s in splits.values()), len({b for _, b in want}), exact)


def test_overlaps_of_odd_tables(spark):
    words = [f"w{i}" for i in range(45)]
    disguised = [w.upper() + "​" for w in words] + [".", "—", None, ""]
    docs = {1: words, 2: disguised, 3: words[:39], 4: words, 5: ["same"] * 3000, 6: ["same"] * 2500, 7: [None] * 50}
    splits = {1: "train", 2: "test", 3: "test", 4: "train", 5: "train", 6: "val", 7: "test"}
    t, d = corpus(spark, docs, splits)
    late = t.where("doc_key = 1 and tok_pos = 0").withColumn("text", F.lit("other")).withColumn("token_id", F.col("token_id") + 10**9)
    lost = t.where("doc_key = 1").withColumn("doc_key", F.lit(None).cast("long"))
    placeless = t.where("doc_key = 1").withColumn("sent_idx", F.lit(None).cast("int"))
    every = t.unionByName(t.where("doc_key = 1")).unionByName(late).unionByName(lost).unionByName(placeless)
    assert sorted(tuple(r) for r in overlap.found_pairs(every, d).collect()) == [(1, 2), (2, 4), (5, 6)]
    assert overlap.found_pairs(t.limit(0), d).count() == 0
    assert overlap.found_pairs(t, d.limit(0)).count() == 0


def test_a_hot_group_of_copies(spark):
    """Copies are one class until their pairs are written; frequent segments are salted and lose nothing."""
    words = [f"w{i}" for i in range(50)]
    near = {k: [*words[:45], *(f"x{k % 9}{i}" for i in range(5))] for k in range(60, 90)}
    docs = {k: near.get(k, words) for k in range(90)}
    splits = {k: "train" if k % 4 else "test" for k in docs}
    t, d = corpus(spark, docs, splits)
    got = {(r["train_key"], r["eval_key"]): r["common"] for r in overlap.cross_split_overlaps(t, d, hot=3, block=4).collect()}
    n_test = sum(s == "test" for s in splits.values())
    assert len(got) == n_test * (90 - n_test)
    assert all(n == lcs(docs[a], docs[b]) for (a, b), n in list(got.items())[::97])
    assert overlap.cross_split_overlaps(t, d, hot=10**6).count() == len(got)


def test_banded_programme():
    rng = random.Random(6)
    for _ in range(500):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 25))]
        b = damaged(rng, a, 0.3) if rng.random() < 0.7 else [rng.randint(0, 4) for _ in range(rng.randint(1, 25))]
        b = [x if isinstance(x, int) else 7 for x in b] or [7]
        least = overlap.least_common(len(a), len(b))
        true = lcs(a, b)
        assert overlap.common_in_order(np.array(a), np.array(b), least) == (true if true >= least else 0)
