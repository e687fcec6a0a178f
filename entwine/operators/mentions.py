"""Mentions from coref cells: events of the cells, matched to spans by windows only.

Defined results: cells without a mark give no event; a close without an open is dropped; an open of an
open cluster is ignored; an open that is never closed is a mention of its one token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import digit_table, head_word, stripped
from . import packed
from .packed import MARK

EVENT = ["sent_idx", "tok_pos", "part_pos"]


def cell_marks(cell: Column, tolerant: bool = False, patterns: Column | None = None) -> Column:
    """The marks of a cell as ARRAY<STRUCT<part_pos, part>>.

    Parts are separated by a pipe and must be whole marks; tolerant cuts the cell as the operator of packed fields
    does, by the delimiters given (those inferred for its source), or else by any that can stand between marks.
    """
    if tolerant:
        given = patterns if patterns is not None else F.array(*map(F.lit, packed.DELIMITERS.values()))
        single = F.array(packed.bare(cell))
        found = F.when(packed.whole(cell), F.filter(single, lambda p: p.rlike(rf"^(?:{MARK})$"))).otherwise(packed.values_of(cell, given))
        return F.transform(found, lambda p, i: F.struct(i.alias("part_pos"), p.alias("part")))
    parts = F.transform(F.split(cell, r"\|"), lambda p, i: F.struct(i.alias("part_pos"), stripped(p).alias("part")))
    return F.filter(parts, lambda p: p["part"].rlike(rf"^(?:{MARK})$"))


def _event(part: str) -> tuple[str, str]:
    """kind and cluster_id of a mark."""
    sides = f"case when {part} like '(%)' then 'singleton' when {part} like '(%' then 'open' when {part} is not null then 'close' end as kind"
    number = f"regexp_replace({part}, '[()]', '')"
    return sides, f"try_cast(case when {number} rlike '^[0-9]*$' then {number} else translate({number}, '{digit_table()[0]}', '{digit_table()[1]}') end as bigint) as cluster_id"


def coref_events(tokens: DataFrame, tolerant: bool = False) -> DataFrame:
    """doc_key, sent_idx, tok_pos, part_pos, kind (singleton, open, close), cluster_id of tokens, or of marked sentences."""
    if "marks" in tokens.columns:
        part = tokens.select("doc_key", "sent_idx", F.explode("marks").alias("m")).select("doc_key", "sent_idx", "m.*")
    else:
        given = F.col("patterns") if "patterns" in tokens.columns else None
        part = tokens.where(F.col("coref").rlike(r"[()]")).select("doc_key", "sent_idx", "tok_pos", F.explode(cell_marks(F.col("coref"), tolerant, given)).alias("m")).select("doc_key", "sent_idx", "tok_pos", "m.*")
    return part.selectExpr("doc_key", *EVENT, *_event("part"))


def spans(events: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """Mentions in the order in which a reader of the file meets their ends; unclosed ones come last.

    doc_key, mention_ord, sent_idx, start_tok, end_sent, end_tok, cluster_id, is_zero.  beside: columns that rows
    without a kind carry; such rows pass through, their own mention's columns null.
    """
    # singletons stand in windows of their own, so that opens and closes see only each other
    cluster = f"over (partition by doc_key, cluster_id, kind = 'singleton' order by {', '.join(EVENT)})"
    effective = events.selectExpr("*", f"lag(kind) {cluster} as __before").where(
        "kind is null or kind = 'singleton' or case when kind = 'open' then __before is null or __before = 'close' else __before = 'open' end"
    )
    # of the opens and closes that count, the one after an open closes it
    here = f"struct({', '.join(EVENT)})"
    following = f"case when lead(kind) {cluster} = 'close' then struct({', '.join(f'lead({c}) {cluster} as {c}' for c in EVENT)}) end"
    begun = effective.selectExpr("*", f"case when kind = 'singleton' then {here} else {following} end as __end").where("kind is null or kind <> 'close'")
    every = begun.selectExpr("doc_key", "cluster_id", "kind is null as __beside", "__end is null as __left", f"{here} as __start", f"coalesce(__end, {here}) as __end", *beside)
    return every.selectExpr(
        "doc_key", "row_number() over (partition by doc_key order by __beside, __left, __end, cluster_id) - 1 as mention_ord", "__start.sent_idx as sent_idx", "__start.tok_pos as start_tok",
        "__end.sent_idx as end_sent", "__end.tok_pos as end_tok", "cluster_id", "false as is_zero", *beside,
    )


def sentences_with_mentions(marked: DataFrame) -> DataFrame:
    """doc_key, sent_idx, words, n_tokens, found: the sound mentions of each marked sentence, as an array without order.

    Every sentence travels as one more row among the events of its document, so words and mentions come
    together without a join and without reading the tokens twice.
    """
    kept = [c for c in ("words", "n_tokens", "idxs", "places") if c in marked.columns]
    mark = marked.schema["marks"].dataType.elementType
    each = marked.select("doc_key", "sent_idx", *kept, F.explode(F.concat(F.array(F.lit(None).cast(mark)), F.coalesce("marks", F.array().cast(marked.schema["marks"].dataType)))).alias("m"))
    rows = each.selectExpr("doc_key", "sent_idx", "m.tok_pos", "m.part_pos", *_event("m.part"), *[f"case when m is null then {c} end as {c}" for c in kept])
    found = spans(rows, tuple(kept))
    is_mention = F.col("n_tokens").isNull() & is_sound()
    m = F.struct("start_tok", "end_tok", "mention_ord", "cluster_id", "is_zero")
    by = found.groupBy("doc_key", "sent_idx").agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept], F.collect_list(F.when(is_mention, m)).alias("found"))
    return by.where("n_tokens is not null")


def headed_mentions(marked: DataFrame) -> DataFrame:
    """One row for each position of a mention of marked sentences, with its head word."""
    rows = sentences_with_mentions(marked).select("doc_key", "sent_idx", "words", F.explode("found").alias("m")).select("doc_key", "sent_idx", "words", "m.*")
    named = rows.withColumn("head", head_word(F.col("words"), F.col("start_tok"), F.col("end_tok"))).drop("words")
    return one_cluster_per_key(named)


def is_sound() -> Column:
    """Spans within one sentence that don't end before they start; the others are set apart (mention_defects)."""
    return (F.col("sent_idx") == F.col("end_sent")) & (F.col("end_tok") >= F.col("start_tok"))


def mentions(tokens: DataFrame, tolerant: bool = False, keep_defects: bool = False) -> DataFrame:
    found = spans(coref_events(tokens, tolerant))
    return found if keep_defects else found.where(is_sound()).drop("end_sent")


def mention_defects(tokens: DataFrame, tolerant: bool = False) -> DataFrame:
    """Spans over a sentence's end, or that end before they start, as counts by document."""
    found = spans(coref_events(tokens, tolerant)).where(~is_sound())
    return found.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_defects"), F.sum((F.col("sent_idx") != F.col("end_sent")).cast("bigint")).alias("n_cross_sentence"))


def one_cluster_per_key(found: DataFrame) -> DataFrame:
    """One row for each position: where several clusters hold it, the first by mention_ord counts."""
    first = W.partitionBy("doc_key", "sent_idx", "start_tok", "end_tok").orderBy("mention_ord")
    return found.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")


def duplicate_keys(found: DataFrame) -> DataFrame:
    """Positions that stand in more than one cluster."""
    return (
        found.groupBy("doc_key", "sent_idx", "start_tok", "end_tok").agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count(F.lit(1)).alias("n_mentions")).where("n_clusters > 1")
    )


def beside_sentences(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """doc_key, sent_idx, words, n_tokens and found: the mentions of each sentence as an array without order.

    A union that is grouped, not a join: where both sides are partitioned by document already it needs
    no shuffle.  Mentions of a sentence that doesn't exist are left out.
    """
    kept = [c for c in found.columns if c not in ("doc_key", "sent_idx")]
    m = F.struct(*kept)
    left = sentences.select("doc_key", "sent_idx", "words", "n_tokens", F.lit(None).cast(found.select(m.alias("m")).schema["m"].dataType).alias("m"))
    right = found.select("doc_key", "sent_idx", F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("int").alias("n_tokens"), m.alias("m"))
    both = left.unionByName(right).groupBy("doc_key", "sent_idx")
    return both.agg(F.first("words", ignorenulls=True).alias("words"), F.max("n_tokens").alias("n_tokens"), F.collect_list("m").alias("found")).where("n_tokens is not null")


def with_heads(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """Mentions with the head word of their span."""
    kept = [c for c in found.columns if c != "head"]
    rows = beside_sentences(sentences, found.select(*kept)).select("doc_key", "sent_idx", "words", F.explode("found").alias("m"))
    named = rows.select("words", *[F.col(c) if c in ("doc_key", "sent_idx") else F.col(f"m.{c}").alias(c) for c in kept])
    return named.withColumn("head", head_word(F.col("words"), F.col("start_tok"), F.col("end_tok"))).drop("words")


def clusters(found: DataFrame) -> DataFrame:
    """doc_key, cluster_id, size and the positions of each cluster, as a sorted array."""
    return found.groupBy("doc_key", "cluster_id").agg(F.sort_array(F.collect_set(F.struct("sent_idx", "start_tok", "end_tok"))).alias("positions")).withColumn("size", F.size("positions"))
