"""The corpus tables as the engine's own: one row for each token in its place, one for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import stripped
from ..operators.mentions import cell_marks
from ..session import table


def placed_tokens(tokens: DataFrame) -> DataFrame:
    """doc_key, sent_idx, tok_pos, idx, text, coref: of rows delivered for one place the first counts.

    This is the one shuffle by document: what follows by doc_key, or by doc_key and more, needs no other.
    Null text becomes empty, a null cell `-`; rows without a place are left out.
    """
    first = W.partitionBy("doc_key", "sent_idx", "tok_pos").orderBy(F.col("loaded_at").asc_nulls_last(), F.col("token_id").asc_nulls_last())
    kept = tokens.columns if "patterns" in tokens.columns else []
    return (
        tokens.where("doc_key is not null and sent_idx is not null and tok_pos is not null")
        .select("doc_key", "sent_idx", "tok_pos", "idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("coref", F.lit("-")).alias("coref"), *[c for c in kept if c == "patterns"], "loaded_at", "token_id")
        .repartition("doc_key")
        .withColumn("__nth", F.row_number().over(first))
        .where("__nth = 1")
        .drop("__nth", "loaded_at", "token_id")
    )


def marked_sentences(tokens: DataFrame, tolerant: bool = False) -> DataFrame:
    """doc_key, sent_idx, words, n_tokens, idxs, marks: one row for each sentence with all that later steps need of its tokens.

    Texts and cells of placed tokens travel in one shuffle and one grouping, so that what needs words and what
    needs marks read the same exchange.  words and idxs are in order; marks ARRAY<STRUCT<tok_pos, part_pos, part>>
    has the marks of the cells (see cell_marks).  A place stands in words at its rank, which is tok_pos where
    no token is missing.
    """
    cell = cell_marks(F.col("coref"), tolerant, F.col("patterns") if "patterns" in tokens.columns else None)
    one = F.struct("tok_pos", "text", *(["idx"] if "idx" in tokens.columns else []), F.when(F.col("coref").rlike(r"[()]"), cell).alias("cell"))
    rows = tokens.groupBy("doc_key", "sent_idx").agg(F.sort_array(F.collect_list(one)).alias("t"))
    marks = F.flatten(F.transform(F.filter("t", lambda x: x["cell"].isNotNull()), lambda x: F.transform(x["cell"], lambda m: F.struct(x["tok_pos"].alias("tok_pos"), m["part_pos"].alias("part_pos"), m["part"].alias("part")))))
    return rows.select("doc_key", "sent_idx", F.col("t.text").alias("words"), F.size("t").alias("n_tokens"), *([F.col("t.idx").alias("idxs")] if "idx" in tokens.columns else []), F.col("t.tok_pos").alias("places"), marks.alias("marks"))


def keyed_documents(documents: DataFrame, codes: DataFrame) -> DataFrame:
    """doc_key, doc_id, corpus, split, lang: one language code for each known spelling, `und` for others."""
    known = codes.select(F.lower("code").alias("__code"), F.col("lang").alias("__lang")).distinct()
    said = documents.withColumn("__code", F.lower(stripped(F.col("language"))))
    # language_codes is a fixed list; the optimizer broadcasts it by its size
    return said.join(known, "__code", "left").select("doc_key", "doc_id", "corpus", "split", F.coalesce("__lang", F.lit("und")).alias("lang"))


def sentences(tokens: DataFrame) -> DataFrame:
    """doc_key, sent_idx, words ARRAY<STRING> in order, n_tokens."""
    inner = F.sort_array(F.collect_list(F.struct("tok_pos", "text")))
    return tokens.groupBy("doc_key", "sent_idx").agg(inner.alias("__t")).select("doc_key", "sent_idx", F.col("__t.text").alias("words"), F.size("__t").alias("n_tokens"))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Placed tokens and keyed documents of a data directory."""
    t = lambda name: table(spark, sf_dir, name)
    return placed_tokens(t("tokens")), keyed_documents(t("conll_documents"), t("language_codes"))
