"""Rows that fail to parse and fields that hold several values: every rule, and inputs that are empty, null, long or odd."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entwine.operators import packed, rejects

LINES = "line_id long, file_name string, line_no int, n_cols int, raw string"


def lines_of(spark, raws, n_cols=7):
    return spark.createDataFrame([(i, "f", i, n_cols, r) for i, r in enumerate(raws)], LINES)


def row(index="3", word="w", coref="-", cols=7):
    return "\t".join(["d", "0", index, word, *["_"] * (cols - 5), coref])


CASES = [
    (row(), None), (row(coref=""), None), (row(coref="*"), None), (row(coref="_"), None), (row(index=" 4 "), None), (row(index="௧२3"), None), (row(index="0002147483647"), None),
    (row(index="2147483648"), "index_over_int"), (row(index="99999999999999999999"), "index_over_int"), (row(index="-1"), "index_not_a_number"), (row(index="1.5"), "index_not_a_number"), (row(index=""), "index_not_a_number"),
    (row(index="l0"), "index_not_a_number"), (row(index="1 2"), "index_not_a_number"), (row(coref="(1)|(2"), None), (row(coref="(1; 2)"), None), (row(coref="(1(2)"), None), (row(coref=" - "), None), (row(coref="-|(௩)"), None),
    (row(coref="(1))"), "coref_invalid"), (row(coref="((1)"), "coref_invalid"), (row(coref="( 1)"), "coref_invalid"), (row(coref="(1)|NA"), "coref_invalid"), (row(coref="{1}"), "coref_invalid"), (row(coref="5"), "coref_invalid"),
    (row(coref="(1)-2"), "coref_invalid"), (row(coref='"(1)|(2)"'), None), (row(word='"a\tb"'), None), (row(word='""""'), None), (row(word='"a""b"'), None), (row(word='a"b'), "broken_quoting"), (row(word='"ab'), "broken_quoting"),
    (row(word='"a"b'), "broken_quoting"), (row() + "\r", None), (row(word=""), None), ("\t" + row()[2:], None), (row(cols=8), "wrong_column_count"), (row(cols=6), "wrong_column_count"), ("d 0 3 w _ _ -", "wrong_column_count"),
    ("", "skip"), ("  \t ", "skip"), ("#begin document (x); part 0", "skip"), ("#end document", "skip"), ("\r", "skip"), (None, "null_line"), (row(word="x" * 100_000), None), (row(word='"' + '""' * 20_000 + '"'), None),
]


def test_reasons(spark):
    good, bad = rejects.split_rows(lines_of(spark, [r for r, _ in CASES]))
    reasons = {r["line_id"]: r["reasons"] for r in bad.collect()}
    kept = {r["line_id"]: r for r in good.collect()}
    for i, (raw, why) in enumerate(CASES):
        assert reasons.get(i) == (None if why in (None, "skip") else [why]), raw and raw[:60]
        assert (i in kept) == (why is None), raw and raw[:60]
    assert kept[5]["idx"] == 123 and kept[6]["idx"] == 2147483647 and kept[27]["text"] == "a\tb" and kept[28]["text"] == '"' and kept[26]["coref"] == "(1)|(2)"


def test_several_reasons_and_layouts(spark):
    got = {r["line_id"]: r["reasons"] for r in rejects.errors(rejects.parsed_cells(lines_of(spark, [row(index="x", coref="y")]))).collect()}
    assert got == {0: ["coref_invalid", "index_not_a_number"]}
    for n, why in ((None, "no_layout"), (3, "no_layout"), (12, "wrong_column_count")):
        assert rejects.errors(rejects.parsed_cells(lines_of(spark, [row()], n))).first()["reasons"] == [why]


def test_rejects_of_odd_tables(spark):
    assert rejects.found_rejects(lines_of(spark, [])).count() == 0
    odd = lines_of(spark, [row(index="x")] * 3 + [row()]).withColumn("value", F.lit("v")).withColumn("role", F.lit("r")).withColumn("__line", F.lit("l")).withColumn("reasons", F.lit(1))
    assert sorted(r[0] for r in rejects.found_rejects(odd).collect()) == [0, 1, 2]
    good, bad = rejects.split_rows(odd)
    assert good.count() == 1 and bad.count() == 3


TOKENS = "token_id long, doc_id string, coref string"
MARK = re.compile(r"\(\d+\)|\(\d+|\d+\)")


def unpacked(spark, cells, least=2):
    df = spark.createDataFrame([(i, "lb/x" if i % 2 else "mj-1", c) for i, c in enumerate(cells)], TOKENS)
    got = {}
    for r in packed.unpack(df, "token_id", "coref", packed.corpus_prefix(), least).orderBy("token_id", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["token_id"], []))
        got[r["token_id"]].append(r["part_value"])
    return got


def test_values(spark):
    cells = ["(1|(2)", "(1; 2)", "(1(2)", "1)2)", '["(1", "(2)"]', "'(1' '(2'", "-|(1)|*|_|(2", "(1)", "-", "", None, "(1)｜(2、(3)", " (௧) ; 2) ", "(1 | (2|(3 / 4)", "(1)|", "junk (1) and (2)"]
    assert unpacked(spark, cells) == {0: ["(1", "(2)"], 1: ["(1", "2)"], 2: ["(1", "(2)"], 3: ["1)", "2)"], 4: ["(1", "(2)"], 5: ["(1", "(2"], 6: ["(1)", "(2"], 11: ["(1)", "(2", "(3)"], 12: ["(௧)", "2)"], 13: ["(1", "(2", "(3", "4)"], 15: ["(1)", "(2)"]}
    assert unpacked(spark, ["(1)", "-", "(2|3)"], least=1) == {0: ["(1)"], 2: ["(2", "3)"]}


def test_values_of_odd_tables(spark):
    assert unpacked(spark, []) == {}
    assert unpacked(spark, [None, None]) == {}
    long = "|".join(f"({i})" for i in range(5000))
    assert unpacked(spark, [long, long])[1] == [f"({i})" for i in range(5000)]
    df = spark.createDataFrame([(1, None, "(1|(2)", "x", 5)], "token_id long, doc_id string, coref string, source string, pos int")
    assert [tuple(r) for r in packed.found_marks(df).orderBy("pos").collect()] == [(1, 0, "(1"), (1, 1, "(2)")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["(7)", "(8", "9)", "-"]), st.sampled_from(["|", ";", ", ", " / ", "&", "+", "\\", "、", "｜", " ", "||"])), min_size=1, max_size=6), min_size=1, max_size=12))
def test_values_like_a_pattern(spark, rows):
    cells = ["".join(v + d for v, d in r) for r in rows]
    want = {i: MARK.findall(c) for i, c in enumerate(cells) if len(MARK.findall(c)) > 1}
    assert unpacked(spark, cells) == want


def test_a_rule_is_a_row(spark):
    """Another row of the table is another rule; without a row its errors are none."""
    lines = lines_of(spark, [row(word="बड़ा"), row(word="ok"), row(coref="?")])
    more = (*rejects.RULES[:2], rejects.Rule("word", "word_not_latin", "match", r"^[a-z]+$"), rejects.Rule("index", "index_large", "under", "2"))
    got = {r["line_id"]: r["reasons"] for r in rejects.errors(rejects.parsed_cells(lines), rules=more).collect()}
    assert got == {0: ["index_large", "word_not_latin"], 1: ["index_large"], 2: ["index_large"]}


NUMBER = r"\d+(?:,\d+)?"


def test_the_inferred_delimiter_decides(spark):
    """The same cell is two values in a source that parts by commas, and one in a source that parts by semicolons."""
    a = ["1,2", "3,4", "5,6", "7,8,9"]
    b = ["1,5;2,5", "3;4,25", "6;7", "8,5;9"]
    df = spark.createDataFrame([(i, s, c) for s, cells in (("a", a), ("b", b)) for i, c in enumerate(cells, 10 * (s == "b"))], "token_id long, doc_id string, coref string")
    out = {}
    for r in packed.unpack(df, "token_id", "coref", F.col("doc_id"), value=NUMBER, shape=None).orderBy("token_id", "pos").collect():
        out.setdefault(r["token_id"], []).append(r["part_value"])
    assert out == {0: ["1", "2"], 1: ["3", "4"], 2: ["5", "6"], 3: ["7", "8", "9"], 10: ["1,5", "2,5"], 11: ["3", "4,25"], 12: ["6", "7"], 13: ["8,5", "9"]}
    scores = packed.delimiter_scores(df, "coref", F.col("doc_id"), NUMBER, None)
    assert {r["source"]: r["patterns"][0] for r in packed.inferred_delimiters(scores).collect()} == {"a": ",", "b": ";"}
    # another order of the same delimiters cuts otherwise
    wrong = packed.with_delimiters(df.where("doc_id = 'b'"), F.col("doc_id"), {"b": [",", ";"]}).select(packed.values_of(F.col("coref"), F.col("patterns"), NUMBER).alias("v"))
    assert ["1,5", "2,5"] not in [r["v"] for r in wrong.collect()]


def test_irregular_cells_are_reported(spark):
    cells = ["(1)|(2)"] * 5 + ["(1)|huh", "(3)|(4"]
    df = spark.createDataFrame([(i, "lb/x", c) for i, c in enumerate(cells)], TOKENS)
    assert [(r["token_id"], r["odd"]) for r in packed.irregular_cells(df, "token_id", "coref", packed.corpus_prefix()).collect()] == [(5, ["huh"])]
    # a delimiter that stands after a single value only is one too
    df = spark.createDataFrame([(1, "lb/x", "(1)|(2)"), (2, "lb/x", "(3; ")], TOKENS)
    assert packed.irregular_cells(df, "token_id", "coref", packed.corpus_prefix()).count() == 0
    # a delimiter that a source never uses cuts nothing in it
    df = spark.createDataFrame([(i, "lb/x" if i < 9 else "mj", "(1)|(2)" if i < 9 else "(1);(2)") for i in range(18)], TOKENS)
    known = packed.infer(df, "coref", packed.corpus_prefix())
    assert known == {"lb": [r"\|"], "mj": [";"]}


def test_many_sources_are_joined(spark):
    df = spark.createDataFrame([(i, f"s{chr(97 + i % 7)}/x" if i % 3 else "hot/x", "(1)|(2)" if i % 2 else "(1);(2)") for i in range(300)], TOKENS)
    rows = lambda bound: sorted(tuple(r) for r in packed.unpack(df, "token_id", "coref", packed.corpus_prefix(), 2, bound=bound).collect())
    assert rows(2) == rows(100) and len(rows(2)) == 600


def test_inferred_delimiters(spark):
    df = spark.createDataFrame([(i, "lb/x", "(1)|(2)") for i in range(20)] + [(90, "lb/x", "(1);(2)")] + [(i, "mj", "(1);(2)") for i in range(30, 60)], TOKENS)
    scores = packed.delimiter_scores(df, "coref", packed.corpus_prefix())
    best = {r["source"]: r["patterns"][0] for r in packed.inferred_delimiters(scores).collect()}
    assert best == {"lb": r"\|", "mj": ";"}


@pytest.mark.parametrize("text, value", [("१२", "12"), ("12", "12"), ("𝟗", "9"), (None, None), ("a௩", "a3")])
def test_digits(spark, text, value):
    from entwine.functions.text import digits_to_ascii

    assert spark.createDataFrame([(text,)], "t string").select(digits_to_ascii(F.col("t"))).first()[0] == value
