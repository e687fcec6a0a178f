"""Annotation files, records, configuration, whole runs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from entwine import cli
from entwine.operators import mentions, predict
from entwine.plans import pipeline
from entwine.sources import conll, records, tables
from entwine.streaming import merge as streaming

DOC = """junk\t0\t0\tBefore\t_\t_\t-
#begin document (a/b); part 000
a/b\t0\t0\tHe\t_\t_\t(1)
a/b\t0\t1\tsaid\t_\t_\t-

a/b\t0\tx\tbad\t_\t_\t-
a/b\t0
a/b\t0\t0\tthree


a/b\t0\t०\tHim\t_\t_\t(1)
a/b\t0\t1\t.\t_\t_\t-
#end document
outside\t0\t0\tlost\t_\t_\t-
#begin document
c\t0\t1\tShe\t_\t_\t(2
c\t0\t2\tleft\t_\t_\t2)
#begin document (empty); part 0
"""


def lines_of(spark, text, file="dir/some.file.conll"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text.split("\n"))], conll.SCHEMA)


@pytest.mark.parametrize("chunk", [3, 1 << 18])
def test_scan(spark, chunk):
    got = conll.scan_lines(lines_of(spark, DOC), chunk).orderBy("doc_seq", "sent_idx", "tok_pos").collect()
    assert [(r["doc_seq"], r["doc_id"], r["sent_idx"], r["tok_pos"], r["tok_idx"], r["text"], r["coref"]) for r in got] == [
        (0, "a/b", 0, 0, 0, "He", "(1)"), (0, "a/b", 0, 1, 1, "said", "-"), (0, "a/b", 1, 0, 0, "three", "-"),
        (0, "a/b", 2, 0, 0, "Him", "(1)"), (0, "a/b", 2, 1, 1, ".", "-"), (1, "some.file", 0, 0, 1, "She", "(2"), (1, "some.file", 0, 1, 2, "left", "2)"),
    ]


def test_scan_of_nothing(spark):
    assert conll.scan_lines(spark.createDataFrame([], conll.SCHEMA)).count() == 0
    nulls = spark.createDataFrame([("f", 0, "#begin document (x); part 0"), ("f", 1, None), ("f", 2, "x\t0\t0\tw")], conll.SCHEMA)
    assert [r["text"] for r in conll.scan_lines(nulls).collect()] == ["w"]


def test_round_trip(spark):
    text = "#begin document (d); part 0\nd\t0\t0\tA\t_\t_\t(1|(2)\nd\t0\t1\tB\t_\t_\t1)\n\nd\t0\t0\tC\t_\t_\t-\n\n#end document"
    tokens = conll.with_doc_key(conll.scan_lines(lines_of(spark, text))).withColumn("idx", F.col("tok_idx"))
    documents = tokens.select("doc_key", "doc_id").distinct()
    found = mentions.mentions(tokens)
    out = conll.conll_lines(tokens, found, documents)
    back = "\n".join(r["line"] for r in out.orderBy("line_no").collect())
    again = conll.with_doc_key(conll.scan_lines(lines_of(spark, back)))
    row = lambda m: {(r["sent_idx"], r["start_tok"], r["end_tok"], r["cluster_id"]) for r in m.collect()}
    assert row(mentions.mentions(again)) == row(found) == {(0, 0, 1, 1), (0, 0, 0, 2)}
    wrong = spark.createDataFrame([(documents.first()[0], 0, 0, 9, 3)], "doc_key long, sent_idx int, start_tok int, end_tok int, cluster_id long")
    assert all("3" not in r["line"] for r in conll.conll_lines(tokens, wrong, documents).collect())


def test_many_documents_to_a_file(spark, tmp_path):
    texts = [f"#begin document (a/{i}); part 0\na/{i}\t0\t0\tw{i}\t_\t_\t(1)\n\n#end document" for i in range(20)]
    tokens = conll.with_doc_key(conll.scan_lines(lines_of(spark, "\n".join(texts))))
    documents = tokens.select("doc_key", "doc_id").distinct()
    out = conll.conll_lines(tokens, mentions.mentions(tokens), documents)
    conll.write_conll(out, documents, str(tmp_path / "many"), )
    files = [p.read_text() for p in (tmp_path / "many").glob("part-*")]
    back = conll.scan_lines(lines_of(spark, "\n".join(files)))
    assert {(r["doc_id"], r["text"], r["coref"]) for r in back.collect()} == {(f"a/{i}", f"w{i}", "(1)") for i in range(20)}
    conll.write_conll(out, documents, str(tmp_path / "each"), separate=True)
    assert len(list((tmp_path / "each").glob("document=*a_*"))) == 20


@pytest.fixture
def root(tmp_path):
    body = "#begin document ({0}); part 0\n" + "".join(f"{{0}}\t0\t{i}\t{w}\t_\t_\t{c}\n" for i, (w, c) in enumerate([("He", "(1)"), ("saw", "-"), ("her", "(2)"), (".", "-")])) + "\n"
    body += "".join(f"{{0}}\t0\t{i}\t{w}\t_\t_\t{c}\n" for i, (w, c) in enumerate([("He", "(1)"), ("left", "-"), ("her", "(2)")])) + "\n#end document\n"
    for place, name in (
        ("mujadia_conll/train", "m_gold_conll"), ("mujadia_conll/development", "d.conll"), ("onto_notes_archive/development/deep", "x_hin_Deva_y.conll"), ("onto_notes_archive/development", "x_tam_Taml.conll"),
        ("litbank_train", "l_hin_Deva.conll"), ("litbank_train", "l_ben_Beng.conll"), ("litbank_train", "l_hin_Deva.txt"), ("litbank_val", "v_tam_Taml.conll"),
    ):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / name).write_text(body.format(name), encoding="utf-8")
    return tmp_path


def test_corpora(spark, root):
    at = f"file://{root}"
    files = lambda t: sorted({(r["corpus"], r["lang"], r["doc_id"]) for r in t.select("corpus", "lang", "doc_id").distinct().collect()})
    train, unknown = conll.read_corpora(spark, at, "train", ["hi", "bn", "xx"])
    assert unknown == ["xx"]
    assert files(train) == [("litbank", "bn", "l_ben_Beng.conll"), ("litbank", "hi", "l_hin_Deva.conll"), ("mujadia_conll", "hi", "m_gold_conll")]
    leaked, _ = conll.read_corpora(spark, at, "train", ["hi"], fall_back=True)
    assert ("onto_notes_archive", "hi", "x_hin_Deva_y.conll") in files(leaked)
    dev, _ = conll.read_corpora(spark, at, "dev")
    assert len(files(dev)) == 4
    none, _ = conll.read_corpora(spark, at, "dev", [])
    assert none.count() == 0 and set(none.columns) == set(dev.columns)


def test_command_line(spark, root, capsys):
    (root / "c.yaml").write_text(f"data:\n  root: file://{root}\n  output_dir: {root}/out\n  languages: {{hi: {{}}, bn: {{}}}}\npreprocessing:\n  max_tokens_per_frame: 8\nother: 1\n")
    config = records.read_config(f"{root}/c.yaml")
    assert config.languages == ("hi", "bn") and config.max_tokens_per_frame == 8 and config.rest == {"other": 1}
    cli.main(["prepare", "--config", f"{root}/c.yaml", "--splits", "train", "--few-shot", "1"])
    got = records.read_examples(spark, f"{root}/out/train.jsonl")
    assert sorted(r["language"] for r in got.collect()) == ["bn", "hi"]
    assert got.first()["before_mentions"][0]["local_no"] == 0 and got.first()["masked_input"].startswith("<m>He</m>#MASK saw")
    cli.main(["infer", "--config", f"{root}/c.yaml", "--split", "train", "--separate", "--details"])
    scores = json.loads((root / "out/results.json").read_text())
    assert scores["overall"]["conll"]["f"] == 100 and scores["hi"]["num_docs"] == 2
    cli.main(["prepare", "--config", f"{root}/c.yaml", "--splits", "train"])
    cli.main(["infer", "--config", f"{root}/c.yaml", "--split", "train", "--separate", "--examples", f"{root}/out/train.jsonl", "--output", f"{root}/saved"])
    assert json.loads((root / "saved/results.json").read_text()) == scores
    cli.main(["baselines", "--config", f"{root}/c.yaml", "--split", "train"])
    (root / "runs").mkdir()
    (root / "runs/one.json").write_text((root / "out/results.json").read_text())
    (root / "runs/two.json").write_text(json.dumps({"hi": scores["hi"]}))
    cli.main(["analyse", f"{root}/runs"])
    cli.main(["analyse", f"a={root}/out/results.json", f"b={root}/out/results.json", "gone=/nowhere/x.json"])
    said = capsys.readouterr().out
    assert "HI " in said and "OVERALL" in said and "no results of gone" in said and "head_match" in said
    assert "  CoNLL   P=100.00  R=100.00  F=100.00\n  Documents evaluated: 2" in said and "two             | —" in said and "=1   |      0 |      0 | +0" in said
    assert len(list((root / "out/conll").glob("document=*"))) == 3


def test_records_keep_letters_and_nulls(spark, tmp_path):
    e = spark.createDataFrame([("d", "hi", None, "पास", "x", "[]", "[]", "[1]", "[2]")], "doc_id string, language string, instruction string, masked_input string, output string, before_mentions string, after_mentions string, before_sent_indices string, after_sent_indices string")
    records.write_examples(e, str(tmp_path / "e"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "e").glob("part-*"))
    assert "पास" in text and json.loads(text)["before_mentions"] == "[]"
    (tmp_path / "e" / "part-9.json").write_text("\n{broken\n\n")
    r = records.read_examples(spark, str(tmp_path / "e")).collect()
    assert [x["line"] for x in records.unread_records(spark, str(tmp_path / "e")).collect()] == ["{broken"]
    assert r[0]["pair_idx"] == 1 and r[0]["doc_key"] is not None
    assert len(r) == 1 and r[0]["before_sent_indices"] == [1] and r[0]["instruction"] is None


def test_whole_run(spark):
    rows = [(k, s, i, i, w, c) for k in range(3) for s in range(4) for i, (w, c) in enumerate([("He", "(0)"), ("saw", "-"), ("her", "(1)")])]
    tokens = spark.createDataFrame(rows, "doc_key long, sent_idx int, tok_pos int, idx int, text string, coref string")
    documents = spark.createDataFrame([(k, str(k), "hi") for k in range(3)], "doc_key long, doc_id string, lang string")
    config = records.Config(max_tokens_per_frame=3)
    e = pipeline.examples(tokens, documents, config)
    assert e.count() == 9
    scores, merged = pipeline.evaluate(tokens, documents, pipeline.run_inference(e, "gold"))
    assert scores.first()["conll_f"] == pytest.approx(100) and merged.count() == 24
    heads = pipeline.run_inference(e, lambda p: predict.head_match(p))
    assert pipeline.evaluate(tokens, documents, heads)[0].first()["conll_f"] == pytest.approx(100)
    assert pipeline.evaluate(tokens, documents, pipeline.run_inference(e, "singleton"))[0].first()["conll_f"] < 100
    assert {r["baseline"] for r in pipeline.evaluate_baselines(tokens, documents).collect()} == {"all_singletons", "all_one_cluster", "head_match"}


RESULT = "doc_key long, pair_idx int, before_mentions array<struct<sent_idx:int,start_tok:int,end_tok:int,predicted_local_no:int>>, after_mentions array<struct<sent_idx:int,start_tok:int,end_tok:int,predicted_local_no:int>>"


def test_streaming_merge(spark, tmp_path):
    """Pairs in any order of arrival give the clusters of the batch merge."""
    from entwine.operators.merge import merge_pairs

    m = lambda s, n: (s, 0, 0, n)
    pairs = [(d, k, [m(k, 0), m(k + 100, 1)], [m(k + 1, 0), m(k + 101, 1 if k % 2 else 2)]) for d in (1, 2) for k in range(4)]
    whole = spark.createDataFrame(pairs, RESULT)
    want = {(r["doc_key"], r["sent_idx"]): r["cluster_id"] for r in merge_pairs(whole).collect()}
    for i, part in enumerate((pairs[2:4] + pairs[4:5], pairs[0:2] + pairs[6:8], pairs[5:6])):
        spark.createDataFrame(part, RESULT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.merge_stream(stream).writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {(r["doc_key"], r["sent_idx"]): r["cluster_id"] for r in spark.table("merged").orderBy("pair_idx").collect()}
    assert got == want


def test_streaming_merge_with_gaps(spark, tmp_path):
    """Pairs without mentions aren't made; in any order of arrival, some twice, the others give what the batch gives."""
    import random

    from entwine.operators import frames
    from entwine.operators.merge import merge_pairs

    rng = random.Random(7)
    rows = [(d, s, i, i, "w", rng.choice(["-"] * 9 + ["(1)", "(2)", "(3"]) if s % 4 else "-") for d in range(6) for s in range(30) for i in range(3)]
    marked = tables.marked_sentences(spark.createDataFrame(rows, "doc_key long, sent_idx int, tok_pos int, idx int, text string, coref string"))
    made = predict.attach(frames.pairs_of(mentions.sentences_with_mentions(marked), marked, 6), predict.noisy(0.3)).select("doc_key", "pair_idx", "follows", "before_mentions", "after_mentions")
    whole = spark.createDataFrame(made.collect(), made.schema)
    k = sorted((r["doc_key"], r["pair_idx"], r["follows"]) for r in whole.collect())
    assert any(f != p - 1 for _, p, f in k) and all(f == (k[i - 1][1] if i and k[i - 1][0] == d else -1) for i, (d, p, f) in enumerate(k))
    want = {tuple(r)[:4]: r["cluster_id"] for r in merge_pairs(whole).collect()}
    parts = whole.collect()
    rng.shuffle(parts)
    parts += parts[:5]
    for i in range(0, len(parts), 15):
        spark.createDataFrame(parts[i : i + 15], made.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = streaming.merge_stream(stream).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["doc_key"], r["sent_idx"], r["start_tok"], r["end_tok"]): r["cluster_id"] for r in spark.table("gaps").orderBy("pair_idx").collect()}
    assert got == want and want


def test_unread_files(spark, root):
    bad = root / "litbank_val" / "broken_tam_Taml.conll"
    bad.write_text("x")
    bad.chmod(0)
    at = f"file://{root}/litbank_val"
    got = [r[0] for r in conll.unread_files(spark, at).collect()]
    assert got in ([], [f"file:{bad}"])  # whoever may read everything has no unread file
    assert conll.unread_files(spark, f"{at}/nowhere").count() == 0


def test_streaming_ingest(spark, root):
    q = streaming.ingest_files(spark, f"file://{root}/litbank_train", f"{root}/tokens", f"{root}/check")
    assert q.awaitTermination(60)
    assert {r["doc_id"] for r in spark.read.parquet(f"{root}/tokens").collect()} == {"l_hin_Deva.conll", "l_ben_Beng.conll"}
