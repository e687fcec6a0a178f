"""Examples and scores as JSON, and the configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import RECORD, example_records
from ..session import files

MENTIONS = "array<struct<sent_idx:int,start_tok:int,end_tok:int,cluster_id:bigint,local_no:int,is_zero:boolean>>"
RECORD_SCHEMA = ", ".join(f"{c} string" for c in RECORD)
#: Beside the fields of a record: what tells its document and its place there.
ORDER = {"doc_key": "bigint", "pair_idx": "int", "follows": "int"}
SCORE_METRICS = ("muc", "b3", "ceafe", "conll")


def write_examples(examples: DataFrame, path: str) -> None:
    """One JSON object a line with the fields of RECORD, texts in their own letters; then what tells a pair's document and order, if known."""
    more = [c for c in ORDER if c in examples.columns]
    example_records(examples, more).select(*RECORD, *more).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of JSON lines with their nested fields parsed; blank lines are skipped, no schema is inferred."""
    raw = _records(spark, path)
    parsed = lambda c, kind: F.from_json(F.col(c), kind).alias(c)
    return raw.where("_corrupt is null").select(
        "doc_id", "language", "instruction", F.col("input").alias("masked_input"), "output", parsed("before_mentions", MENTIONS), parsed("after_mentions", MENTIONS),
        parsed("before_sent_indices", "array<int>"), parsed("after_sent_indices", "array<int>"), *ORDER,
    ).withColumns({
        # records of other writers: the header's id is the document, and pairs stand in the order of their first sentence
        "doc_key": F.coalesce("doc_key", F.xxhash64("doc_id")), "pair_idx": F.coalesce("pair_idx", F.array_min("before_sent_indices")),
    })


def _records(spark: SparkSession, path: str) -> DataFrame:
    kinds = ", ".join(f"{c} {k}" for c, k in ORDER.items())
    return spark.read.schema(f"{RECORD_SCHEMA}, {kinds}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def unread_records(spark: SparkSession, path: str) -> DataFrame:
    """file, line: the lines that are no records, which read_examples leaves out."""
    one = F.from_json("value", f"{RECORD_SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), one["_corrupt"].alias("__c")).where("__c is not null").drop("__c")


def results_dict(scores: DataFrame, group: str = "lang") -> dict:
    """Scores by language as nested dicts, percentages of two digits; a row for each language, so it is small."""
    out = {}
    for r in sorted(scores.collect(), key=lambda r: (r[group] == "overall", r[group])):
        out[r[group]] = {m: {x: round(r[f"{m}_{x}"], 2) for x in "prf"} for m in SCORE_METRICS} | {"num_docs": r["num_docs"]}
    return out


def write_results(scores: DataFrame, path: str, group: str = "lang") -> dict:
    out = results_dict(scores, group)
    p, fs = files(scores.sparkSession, path)
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(out, indent=2, ensure_ascii=False).encode("utf-8")))
    stream.close()
    return out


def result_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Run names and paths of the result files of a folder, by name."""
    p, fs = files(spark, path)
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return {x.getName()[:-5]: x.toString() for x in sorted(found, key=lambda x: x.getName()) if x.getName().endswith(".json")}


def read_results(spark: SparkSession, runs: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """run, lang, num_docs and the figures of result files by run name, and the runs whose file is missing."""
    prf = "struct<p:double,r:double,f:double>"
    kind = "map<string,struct<" + ",".join(f"{m}:{prf}" for m in SCORE_METRICS) + ",num_docs:bigint>>"
    out, missing = None, []
    for run, path in runs.items():
        p, fs = files(spark, path)
        if not fs.exists(p):
            missing.append(run)
            continue
        rows = spark.read.text(path, wholetext=True).select(F.lit(run).alias("run"), F.explode(F.from_json("value", kind)).alias("lang", "s"))
        rows = rows.select("run", "lang", F.col("s.num_docs").alias("num_docs"), *[_figure(m, x) for m in SCORE_METRICS for x in "prf"])
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "run string, lang string, num_docs bigint, " + ", ".join(f"{m}_{x} double" for m in SCORE_METRICS for x in "prf"))
    return out, missing


def _figure(metric: str, x: str) -> Column:
    return F.col(f"s.{metric}.{x}").alias(f"{metric}_{x}")


@dataclass(frozen=True)
class Config:
    """What a run needs; unknown keys of a file are kept in `rest`."""

    root: str = "data"
    output_dir: str = "processed_data"
    languages: tuple[str, ...] = ("hi", "ta", "bn")
    instruction_id: int = 5
    max_tokens_per_frame: int = 256
    min_mentions_per_example: int = 1
    max_cluster_id: int = 200
    max_seq_length: int = 4096
    few_shot_seed: int = 42
    rest: dict = field(default_factory=dict, compare=False)


#: Where a configuration file has each value.
_PLACES = {
    "root": ("data", "root"), "output_dir": ("data", "output_dir"), "languages": ("data", "languages"), "instruction_id": ("preprocessing", "instruction_id"),
    "max_tokens_per_frame": ("preprocessing", "max_tokens_per_frame"), "min_mentions_per_example": ("preprocessing", "min_mentions_per_example"),
    "max_cluster_id": ("inference", "max_cluster_id"), "max_seq_length": ("model", "max_seq_length"), "few_shot_seed": ("training", "seed"),
}


def read_config(path: str) -> Config:
    import yaml

    tree = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    got: dict = {}
    for f in fields(Config):
        section, key = _PLACES.get(f.name, (None, None))
        if section and isinstance(tree.get(section), dict) and key in tree[section]:
            value = tree[section][key]
            got[f.name] = tuple(value) if f.name == "languages" else value
    return Config(**got, rest={k: v for k, v in tree.items() if k not in {s for s, _ in _PLACES.values()}})
