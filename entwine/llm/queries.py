"""Queries of the operators for training data, by name: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import budget, chunking, confusables, encode, overlap, packing, repetition
from .sql import ORACLES


def _both(spark, d):
    return table(spark, d, "tokens"), table(spark, d, "conll_documents")


def p1_found(spark, d):
    return overlap.found_pairs(*_both(spark, d))


def p1_report(spark, d):
    return overlap.overlap_report(*_both(spark, d))


def p2_found(spark, d):
    return confusables.found_tokens(table(spark, d, "tokens"))


def p2_consistent(spark, d):
    """Every token with its consistent form and what was found in it."""
    rows = confusables.consistent_tokens(*_both(spark, d), table(spark, d, "language_codes"))
    return rows.select("token_id", "consistent", F.array_join("issues", ",").alias("issues"))


def p4_found(spark, d):
    return chunking.found_items(table(spark, d, "conll_documents"), table(spark, d, "frame_examples"))


def p4_document_pieces(spark, d):
    return chunking.split_items(chunking.document_items(table(spark, d, "conll_documents")))


def p4_example_pieces(spark, d):
    return chunking.example_pieces(table(spark, d, "frame_examples"), table(spark, d, "conll_documents"))


def p5_token_budget(spark, d):
    return budget.token_budget(table(spark, d, "frame_examples"), table(spark, d, "language_codes"))


def p5_two_snapshots(spark, d):
    return budget.two_snapshots(table(spark, d, "frame_examples"), table(spark, d, "language_codes"))


def p7_ids(spark, d):
    return encode.encode_texts(table(spark, d, "documents"))


def p8_packed(spark, d):
    return packing.pack_texts(table(spark, d, "documents"))


def p8_fill(spark, d):
    return packing.fill_report(packing.pack_texts(table(spark, d, "documents")))


def p9_found(spark, d):
    return repetition.found_documents(table(spark, d, "documents"))


def p9_repetition(spark, d):
    shares = repetition.repetition(table(spark, d, "documents"))
    return shares.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in shares.columns[2:]])


_NAMES = ("p1_found p1_report p2_found p2_consistent p4_found p4_document_pieces p4_example_pieces p5_token_budget p5_two_snapshots p7_ids p8_packed p8_fill p9_found p9_repetition").split()
QUERIES = {name: globals()[name] for name in _NAMES}
__all__ = ["ORACLES", "QUERIES"]
