"""python -m entwine.cli prepare | infer | baselines | analyse"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import report, sampling, score
from .plans import pipeline
from .sources import conll, records


def _session() -> SparkSession:
    return SparkSession.builder.appName("entwine").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(a: argparse.Namespace) -> records.Config:
    from dataclasses import replace

    config = records.read_config(a.config) if a.config else records.Config()
    return replace(config, **{k: v for k, v in (("root", a.root), ("output_dir", a.output)) if v})


def _warn(config: records.Config, spark: SparkSession, split: str, languages: list[str] | None) -> None:
    """Names the files that can't be read."""
    for corpus, folders in conll.FOLDERS.items():
        holds = () if corpus == "mujadia_conll" else tuple(c for x in (languages or config.languages) if x in conll.LANGUAGES for c in conll.LANGUAGES[x][1])
        for (file,) in conll.unread_files(spark, f"{config.root}/{folders.get(split, split)}", corpus == "onto_notes_archive", holds).collect():
            print(f"[warn] failed to read {file}")


def prepare(a: argparse.Namespace) -> None:
    """Annotation files to example records, a folder for each split; --few-shot N keeps N of each language."""
    spark, config = _session(), _config(a)
    for split in a.splits:
        _warn(config, spark, split, a.languages)
        tokens, documents = pipeline.load_split(spark, config, split, a.languages, a.fall_back)
        e = pipeline.examples(tokens, documents, config)
        if a.few_shot is not None and split == "train":
            e = sampling.exact_sample(e.withColumn("__id", F.concat_ws(":", "doc_key", "pair_idx")), a.few_shot, "__id", "language", config.few_shot_seed).drop("__id")
        records.write_examples(e, f"{config.output_dir}/{split}.jsonl")


def infer(a: argparse.Namespace) -> None:
    """Predicts with a built-in rule, merges, writes files and scores; --examples takes saved examples instead of making them anew."""
    spark, config = _session(), _config(a)
    tokens, documents = pipeline.load_split(spark, config, a.split, a.languages, a.fall_back)
    if a.examples:
        for (line,) in records.unread_records(spark, a.examples).agg(F.count("line")).collect():
            if line:
                print(f"[warn] {line} lines of {a.examples} are no records")
        results = pipeline.saved_results(records.read_examples(spark, a.examples), documents, a.predictor)
    else:
        results = pipeline.run_inference(pipeline.examples(tokens, documents, config), a.predictor)
    scores, merged = pipeline.evaluate(tokens, documents, results)
    conll.write_conll(conll.conll_lines(tokens, merged, documents), documents, f"{config.output_dir}/conll", a.separate)
    got = records.write_results(scores, f"{config.output_dir}/results.json")
    for lang, s in got.items():
        n = s["num_docs"]
        print("\n".join(report.score_block(s, f"OVERALL ({n} docs)" if lang == "overall" else f"Language: {lang.upper()} ({n} docs)")))
    if a.details:
        gold = pipeline.gold_clusters(tokens).join(results.select("doc_key").distinct(), "doc_key", "left_semi")
        print("\nSize | Gold # | Pred # | Difference")
        for r in report.histogram_table(gold, merged).orderBy("size").collect():
            print(f"{r['label']:4s} | {r['gold']:6d} | {r['pred']:6d} | {r['difference']:+d}")
        report.error_analysis(score.cells(gold, merged), documents).orderBy("lang").show(100, False)


def baselines(a: argparse.Namespace) -> None:
    spark, config = _session(), _config(a)
    tokens, documents = pipeline.load_split(spark, config, a.split, a.languages, False)
    found = pipeline.evaluate_baselines(tokens, documents)
    found.select("baseline", "lang", "num_docs", *[report.fixed(F.col(f"{m}_f")).alias(m) for m in records.SCORE_METRICS]).orderBy("baseline", "lang").show(100, False)


def analyse(a: argparse.Namespace) -> None:
    """Score tables of result files (RUN=FILE, or a folder of them), and, of several, the comparison of runs."""
    spark = _session()
    runs: dict[str, str] = {}
    for x in a.results:
        name, given, path = x.partition("=")
        runs |= {name: path} if given else records.result_files(spark, x)
    scores, missing = records.read_results(spark, runs)
    for m in missing:
        print(f"[warn] no results of {m}")
    for (run,) in scores.select("run").distinct().orderBy("run").collect():
        print(f"\n{run}\nLanguage     | MUC-F    | B3-F     | CEAFe-F   | CoNLL-F   | Docs")
        for r in report.language_table(scores.where(F.col("run") == run)).collect():
            print(r["line"])
    if len(runs) > 1:
        print("", *report.ablation_lines(scores), sep="\n")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="entwine", description=__doc__)
    sub = p.add_subparsers(required=True)
    for name, f in (("prepare", prepare), ("infer", infer), ("baselines", baselines)):
        s = sub.add_parser(name, help=f.__doc__)
        s.set_defaults(run=f)
        s.add_argument("--config")
        s.add_argument("--root")
        s.add_argument("--output")
        s.add_argument("--languages", nargs="*")
        s.add_argument("--fall-back", action="store_true")
        if name == "prepare":
            s.add_argument("--splits", nargs="*", default=["train", "dev", "test"])
            s.add_argument("--few-shot", type=int)
        else:
            s.add_argument("--split", default="test")
        if name == "infer":
            s.add_argument("--predictor", default="gold", choices=sorted(pipeline.PREDICTORS))
            s.add_argument("--examples", help="saved examples")
            s.add_argument("--separate", action="store_true", help="a file for each document")
            s.add_argument("--details", action="store_true", help="cluster sizes and error analysis too")
    s = sub.add_parser("analyse", help=analyse.__doc__)
    s.set_defaults(run=analyse)
    s.add_argument("results", nargs="+", metavar="RUN=FILE|FOLDER")
    a = p.parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main()
