"""Several values packed in one field (problem 6): one row for each value, with its position.

The delimiters are inferred for each source, from all of its cells that hold two values or more, or one and something else.  A
candidate's cut is regular if what stands left of it ends in a value (or in a sign of no value) and what
stands right of it begins with one; its regularity is the share of regular cuts, its consistency
the share of its most frequent number of pieces, its coverage the share of the cells that hold it.
Candidates of a regularity of ACCEPT or more are the source's delimiters, best score (the product of
the three) first.  Weak candidates (blanks, and the place between two values) stand around the others as
padding too, so they are scored over the pieces that the strong ones leave irregular, and come last.

A cell is cut by its source's first delimiter; a piece that isn't whole then is cut by the next, and so on.
Nothing else cuts it: a candidate that the source doesn't use may be part of its values.

Before cells are scored, what their shape doesn't depend on is folded (for marks: the digits), so a source is a
short table of shapes and counts, aggregated before any shuffle.

Defined results: a null, empty or valueless cell has no rows here; quotes, brackets and blanks around a
value are no part of it; `-`, `*`, `_` and empty pieces are no values and take no position; a piece that the
source's delimiters leave irregular is no value, and its cell is reported by `irregular_cells`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Candidate delimiters as regular expressions; the last is the place between two marks.
STRONG = {
    "pipe": r"\|", "wide_pipe": "｜", "semicolon": ";", "comma": ",", "ideographic_comma": "、", "slash": "/",
    "backslash": r"\\", "ampersand": "&", "plus": r"\+",
}
WEAK = {"blank": r"(?U)\s+", "joint": r"(?<=\))(?=\(|\p{Nd})|(?<=\p{Nd})(?=\()"}
DELIMITERS = STRONG | WEAK
#: A mark of a coref cell: (n), (n or n).
MARK = r"\(\p{Nd}+\)|\(\p{Nd}+|\p{Nd}+\)"
#: What may stand around a value.
AROUND = r"[\s\p{Cf}\"'“”‘’\[\]]*"
#: What holds the place of no value.
NOTHING = r"[-*_]?"
#: The share of regular cuts from which on a candidate is a delimiter of its source.
ACCEPT = 0.2

Shape = Callable[[Column], Column] | None


def digits_folded(cell: Column) -> Column:
    """Cells that differ in numbers only have one shape."""
    return F.regexp_replace(cell, r"\p{Nd}+", "0")


def whole(piece: Column, value: str = MARK) -> Column:
    """Whether a piece is one value or none, so that it needs no further cut."""
    return piece.rlike(rf"(?U)^{AROUND}(?:{value}|{NOTHING}){AROUND}$")


def bare(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"(?U)^{AROUND}|{AROUND}$", "")


def _packed(cell: Column, value: str) -> Column:
    """Cells with two or more values."""
    return cell.rlike(rf"(?:{value}).*?(?:{value})")


def delimiter_scores(df: DataFrame, cell: str, source: Column, value: str = MARK, shape: Shape = digits_folded) -> DataFrame:
    """source, delimiter, weak, cells, consistency, regularity, coverage, score: one pass, aggregated before the shuffle."""
    c = F.col("cell")
    packed = df.select(F.coalesce(source, F.lit("")).alias("source"), F.col(cell).alias("cell")).where(_packed(c, value) | (c.rlike(value) & ~whole(c, value)))
    shapes = packed.groupBy("source", (shape(c) if shape else c).alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    ends, begins = rf"(?U)(?:(?:{value}|[-*_])|^){AROUND}$", rf"(?U)^{AROUND}(?:(?:{value}|[-*_])|$)"

    def cuts(candidate: Column, text: Column) -> Column:
        pieces = F.split(text, candidate["pattern"])
        beside = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: a.rlike(ends) & b.rlike(begins))
        return F.struct(candidate["delimiter"].alias("delimiter"), candidate["weak"].alias("weak"), (F.size(beside) + 1).alias("pieces"), F.size(F.filter(beside, lambda x: x)).alias("regular"))

    rest = F.filter(_cut(c, F.array(*map(F.lit, STRONG.values())), value), lambda p: ~whole(p, value))
    candidates = F.array(*[F.struct(F.lit(n).alias("delimiter"), F.lit(p).alias("pattern"), F.lit(n in WEAK).alias("weak")) for n, p in DELIMITERS.items()])
    tried = F.flatten(F.transform(candidates, lambda d: F.transform(F.when(d["weak"], F.col("rest")).otherwise(F.array(c)), lambda text: cuts(d, text))))
    every = F.array(F.struct(F.lit(None).cast("string").alias("delimiter"), F.lit(False).alias("weak"), F.lit(2).alias("pieces"), F.lit(0).alias("regular")))
    each = shapes.withColumn("rest", rest).select("source", "k", F.explode(F.concat(every, F.filter(tried, lambda x: x["pieces"] > 1))).alias("c")).select("source", "k", "c.*")
    by_count = each.groupBy("source", "delimiter", "weak", "pieces").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("regular")).alias("regular"))
    by = by_count.groupBy("source", "delimiter", "weak").agg(
        F.sum("k").alias("cells"), (F.max("k") / F.sum("k")).alias("consistency"), (F.sum("regular") / F.sum((F.col("pieces") - 1) * F.col("k"))).alias("regularity")
    )
    total = F.max(F.when(F.col("delimiter").isNull(), F.col("cells"))).over(W.partitionBy("source"))
    scored = by.withColumn("coverage", F.least(F.col("cells") / total, F.lit(1.0))).where("delimiter is not null")
    return scored.withColumn("score", F.round(F.col("consistency") * F.col("regularity") * F.col("coverage"), 9))


def inferred_delimiters(scores: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """source and its delimiters' patterns, strong ones first, each kind by score."""
    patterns = F.create_map(*[F.lit(x) for kv in DELIMITERS.items() for x in kv])
    rank = F.struct("weak", (-F.col("score")).alias("s"), "delimiter")
    used = scores.where(F.col("regularity") >= accept).groupBy("source").agg(F.sort_array(F.collect_list(rank)).alias("o"))
    return used.select("source", F.transform("o", lambda x: F.element_at(patterns, x["delimiter"])).alias("patterns"))


def _cut(cell: Column, patterns: Column, value: str) -> Column:
    """Pieces of a cell; patterns after the first cut only what isn't whole, and none is tried when all is."""
    first = F.when(F.size(patterns) > 0, F.split(cell, F.get(patterns, F.lit(0)))).otherwise(F.array(cell))
    state = lambda pieces: F.struct(F.forall(pieces, lambda p: whole(p, value)).alias("done"), pieces.alias("pieces"))

    def step(acc, pattern):
        finer = F.flatten(F.transform(acc["pieces"], lambda p: F.when(whole(p, value), F.array(p)).otherwise(F.split(p, pattern))))
        return F.when(acc["done"], acc).otherwise(state(finer))

    return F.aggregate(F.slice(patterns, 2, F.greatest(F.size(patterns) - 1, F.lit(0))), state(first), step, lambda acc: acc["pieces"])


def values_of(cell: Column, patterns: Column, value: str = MARK) -> Column:
    """The values of a cell in order, cut by the given delimiters only."""
    return F.filter(F.transform(_cut(cell, patterns, value), bare), lambda p: p.rlike(rf"^(?:{value})$"))


#: Sources whose delimiters are few enough to broadcast; those of more are joined by a shuffle, in which
#: each source is spread over SALTS groups.
BROADCAST_SOURCES = 5_000
SALTS = 32


def infer(df: DataFrame, cell: str, source: Column, value: str = MARK, shape: Shape = digits_folded, bound: int = BROADCAST_SOURCES) -> dict[str, list[str]] | DataFrame:
    """The delimiters of each source of df; a table (source, patterns) where there are more sources than bound."""
    found = inferred_delimiters(delimiter_scores(df, cell, source, value, shape))
    kept = found.limit(bound + 1).collect()
    return found if len(kept) > bound else {r["source"]: r["patterns"] for r in kept}


def with_delimiters(df: DataFrame, source: Column, known: dict[str, list[str]] | DataFrame, patterns: str = "patterns") -> DataFrame:
    """df with the delimiters of each row's source, as infer gives them; a source without packed cells has none."""
    key, none = F.coalesce(source, F.lit("")), F.array().cast("array<string>")
    rows = df.withColumn("__key", key)
    if isinstance(known, dict):
        table = F.broadcast(df.sparkSession.createDataFrame(list(known.items()), "__source string, __patterns array<string>"))
        joined = rows.join(table, F.col("__key") == F.col("__source"), "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt2")
        table = known.select(F.col("source").alias("__source"), F.col("patterns").alias("__patterns"), salts)
        rows = rows.withColumn("__salt1", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        joined = rows.join(table, (F.col("__key") == F.col("__source")) & (F.col("__salt1") == F.col("__salt2")), "left").drop("__salt1", "__salt2")
    return joined.withColumn(patterns, F.coalesce("__patterns", none)).drop("__key", "__source", "__patterns")


def unpack(df: DataFrame, key: str, cell: str, source: Column, least: int = 1, value: str = MARK, shape: Shape = digits_folded, bound: int = BROADCAST_SOURCES) -> DataFrame:
    """key, source, pos, part_value, n_parts of each value of the cells that hold at least `least` values."""
    rows = df.select(F.col(key), source.alias("source"), F.col(cell).alias("cell"))
    known = infer(rows, "cell", F.col("source"), value, shape, bound)
    wanted = _packed(F.col("cell"), value) if least > 1 else F.col("cell").rlike(value)
    cells = with_delimiters(rows.where(wanted), F.col("source"), known)
    parts = cells.select(key, "source", values_of(F.col("cell"), F.col("patterns"), value).alias("parts")).where(F.size("parts") >= least)
    return parts.select(key, "source", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("pos", "part_value")).select(key, "source", "pos", "part_value", "n_parts")


def irregular_cells(df: DataFrame, key: str, cell: str, source: Column, value: str = MARK, shape: Shape = digits_folded) -> DataFrame:
    """key, source, cell, odd: cells with pieces that their source's delimiters leave neither a value nor none."""
    rows = df.select(F.col(key), source.alias("source"), F.col(cell).alias("cell")).where(F.col("cell").isNotNull())
    pieces = _cut(F.col("cell"), F.col("patterns"), value)
    odd = with_delimiters(rows, F.col("source"), infer(rows, "cell", F.col("source"), value, shape)).withColumn("odd", F.filter(pieces, lambda p: ~whole(p, value)))
    return odd.where(F.size("odd") > 0).select(key, "source", "cell", "odd")


def corpus_prefix(doc_id: str = "doc_id") -> Column:
    """The source of a document id: the letters that it begins with."""
    return F.regexp_extract(F.coalesce(F.col(doc_id), F.lit("")), r"^([A-Za-z]*)", 1)


def found_marks(tokens: DataFrame) -> DataFrame:
    """token_id, pos, part_value of each mark of the cells with two or more."""
    return unpack(tokens, "token_id", "coref", corpus_prefix(), least=2).select("token_id", "pos", "part_value")
