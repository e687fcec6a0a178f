"""Whole runs: files or tables to examples, examples to scores; each is one lazy plan until it is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import instruction
from ..operators import baselines, frames, mentions, merge, predict, score
from ..sources import conll, tables
from ..sources.records import Config

PREDICTORS: dict[str, Callable[[], Column]] = {"gold": predict.gold, "singleton": predict.singleton, "noisy": lambda: predict.noisy(0.1)}


def load_split(spark: SparkSession, config: Config, split: str, languages: list[str] | None = None, fall_back: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tokens and documents of a split's files."""
    read, _ = conll.read_corpora(spark, config.root, split, languages or list(config.languages), fall_back)
    tokens = conll.with_doc_key(read).withColumn("idx", F.col("tok_idx"))
    documents = tokens.select("doc_key", "doc_id", "corpus", "split", "lang").distinct()
    return tokens.select("doc_key", "sent_idx", "tok_pos", "idx", "text", "coref"), documents


def examples(tokens: DataFrame, documents: DataFrame, config: Config = Config(), tolerant: bool = False, skip_empty: bool = True) -> DataFrame:
    """Examples of all documents, with their instruction."""
    marked = tables.marked_sentences(tokens, tolerant)
    pairs = frames.pairs_of(mentions.sentences_with_mentions(marked), marked, config.max_tokens_per_frame, skip_empty, config.min_mentions_per_example)
    named = pairs.join(documents.select("doc_key", "doc_id", F.col("lang").alias("language")), "doc_key")
    return named.withColumn("instruction", instruction(config.instruction_id, F.col("language")))


def gold_clusters(tokens: DataFrame, tolerant: bool = False) -> DataFrame:
    """One row for each position of a mention, with its head word."""
    return mentions.headed_mentions(tables.marked_sentences(tokens, tolerant))


def run_inference(pairs: DataFrame, predictor: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of a built-in predictor, or of a function that adds `numbers` to pairs."""
    if isinstance(predictor, str):
        return predict.attach(pairs, PREDICTORS[predictor]())
    return predict.attach(predictor(pairs))


def evaluate(tokens: DataFrame, documents: DataFrame, results: DataFrame, tolerant: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scores by language of merged results over the documents that have pairs, and the merged clusters."""
    merged = merge.merge_pairs(results)
    gold = gold_clusters(tokens, tolerant).join(results.select("doc_key").distinct(), "doc_key", "left_semi")
    return score.corpus_scores(gold, merged, documents, only_scored=True), merged


def evaluate_baselines(tokens: DataFrame, documents: DataFrame, tolerant: bool = False) -> DataFrame:
    return baselines.evaluate(gold_clusters(tokens, tolerant), documents)


def saved_results(examples: DataFrame, documents: DataFrame, predictor: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of saved examples.  Examples that don't say which document they are of get that of their doc_id, if one document has it."""
    one = documents.groupBy("doc_id").agg(F.min("doc_key").alias("__key"), F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id", "__key")
    known = documents.select(F.col("doc_key"), F.lit(True).alias("__known"))
    placed = examples.join(known, "doc_key", "left").join(one, "doc_id", "left")
    placed = placed.withColumn("doc_key", F.when(F.col("__known"), F.col("doc_key")).otherwise(F.coalesce("__key", "doc_key"))).drop("__known", "__key")
    return run_inference(placed, predictor)
