"""Rows that fail to parse (problem 3): valid rows are loaded, the others set apart with every reason.

Lines are cut into cells (a cell quoted as a whole may hold tabs and doubled quotes), the cells are
exploded into (row, column, value), joined with a table of rules and evaluated; the errors are
aggregated by row, and the clean rows are those that the errors don't name (anti-join).

Defined results: begin, end and blank lines are no token rows; one carriage return at a line's end is no part of it;
a null line is a rejected row ("null_line"); n_cols null or under 4 rejects the row ("no_layout").
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits_to_ascii
from .packed import MARK

class Rule(NamedTuple):
    """One row of the rule table: cells of a role fail it by its name.

    kind: "match", the value must match the pattern; "under", the whole number that it is must not be over the argument (a
    value that is none fails other rules); "is", the value is the argument.
    """

    role: str
    rule: str
    kind: str
    argument: str


_FIELD = r'(?:"(?:[^"]++|"")*+"|[^"\t]*+)'
QUOTED_LINE = rf"^{_FIELD}(?:\t{_FIELD})*+$"
_SEPARATORS = r"\s|｜;,、/\\&+\"'“”‘’\[\]"
#: A coref cell: nothing, or marks that separators (or nothing) stand between, with places of no mark among them.
COREF_CELL = (
    rf"(?U)^[{_SEPARATORS}]*+(?:(?:{MARK}|(?<![^{_SEPARATORS}])[-*_](?![^{_SEPARATORS}]))[{_SEPARATORS}]*+)*+$"
)

# The rules, by the role of a cell.
RULES = (
    Rule("index", "index_not_a_number", "match", r"(?U)^\s*\p{Nd}+\s*$"),
    Rule("index", "index_over_int", "under", "2147483647"),
    Rule("coref", "coref_invalid", "match", COREF_CELL),
    Rule("row", "wrong_column_count", "is", "count"),
    Rule("row", "broken_quoting", "is", "quoting"),
    Rule("row", "no_layout", "is", "layout"),
    Rule("row", "null_line", "is", "null"),
)


def cells_of(line: Column) -> Column:
    """The cells of a line whose quoting is whole."""
    quoted = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({_FIELD})"), 1)
    plain = F.split(line, "\t")
    unquote = F.transform(quoted, lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(F.instr(line, '"') == 0, plain).otherwise(unquote)


def token_rows(lines: DataFrame) -> DataFrame:
    """The lines that should be token rows, without a carriage return at the end, with the quoting judged."""
    text = F.regexp_replace("raw", r"\r$", "")
    rows = lines.withColumn("__line", text).where(
        F.col("__line").isNull() | ~(F.col("__line").rlike(r"(?U)^\s*$") | F.col("__line").rlike(r"^\s*#(?:begin document|end document)\b"))
    )
    return rows.withColumn("__quoting", F.coalesce(F.instr("__line", '"') == 0, F.lit(True)) | F.col("__line").rlike(QUOTED_LINE))


def parsed_cells(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """One row for each cell: key, col, role, value; column -1 is the row itself, its value the number of its cells."""
    rows = token_rows(lines).withColumn("__cells", F.when(F.col("__quoting"), cells_of(F.col("__line"))).otherwise(F.split("__line", "\t")))
    n, want = F.size("__cells"), F.col("n_cols")
    role = lambda i: F.when(i == 2, "index").when(i == want - 1, "coref").when(i == 3, "word").otherwise("other")
    state = F.when(F.col("__line").isNull(), "null").when(~F.col("__quoting"), "quoting").when(want.isNull() | (want < 4), "layout").when(n != want, "count").otherwise("ok")
    row = F.array(F.struct(F.lit(-1).alias("col"), F.lit("row").alias("role"), state.alias("value")))
    # only where the row has its columns can a cell's role be told
    cells = F.when(state == "ok", F.transform("__cells", lambda c, i: F.struct(i.alias("col"), role(i).alias("role"), c.alias("value")))).otherwise(F.array().cast("array<struct<col:int,role:string,value:string>>"))
    return rows.select(key, F.explode(F.concat(row, cells)).alias("c")).select(key, "c.col", "c.role", "c.value")


def _fails(rules: tuple[Rule, ...]) -> Column:
    """Whether a value fails the rule that stands beside it (kind, argument); a value that can't be judged fails."""
    v, argument = F.col("value"), F.col("argument")
    # a pattern is compiled once where it is a literal, so each of the table's patterns has a branch of its own
    unmatched = F.lit(True)
    for pattern in sorted({r.argument for r in rules if r.kind == "match"}):
        unmatched = F.when(argument == pattern, ~v.rlike(pattern)).otherwise(unmatched)
    digits = F.regexp_replace(digits_to_ascii(F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), "^0+(?=.)", "")
    longer = (F.length(digits) > F.length(argument)) | ((F.length(digits) == F.length(argument)) & (digits > argument))
    over = F.when(digits.rlike("^[0-9]+$"), longer).otherwise(F.lit(False))
    return F.coalesce(F.when(F.col("kind") == "match", unmatched).when(F.col("kind") == "under", over).when(F.col("kind") == "is", v == argument), F.lit(True))


def errors(cells: DataFrame, key: str = "line_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, reasons ARRAY<STRING>, cells ARRAY<STRUCT>: every failed rule of each row that fails one."""
    table = F.broadcast(cells.sparkSession.createDataFrame(list(rules), "role string, rule string, kind string, argument string"))  # as long as the argument given
    bad = cells.join(table, "role").where(_fails(rules))
    return bad.groupBy(key).agg(F.sort_array(F.collect_set("rule")).alias("reasons"), F.sort_array(F.collect_list(F.struct("col", "value"))).alias("bad_cells"))


def split_rows(lines: DataFrame, key: str = "line_id", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The valid rows as tokens (key, doc_id, part_no, idx, text, coref), and the rejected with their reasons."""
    bad = errors(parsed_cells(lines, key), key, rules)
    rows = token_rows(lines)
    good = rows.join(bad.select(key), key, "left_anti").withColumn("__cells", cells_of(F.col("__line")))
    cell = lambda i: F.get("__cells", i)
    tokens = good.select(
        key, *[c for c in ("file_name", "line_no") if c in lines.columns], cell(F.lit(0)).alias("doc_id"), cell(F.lit(1)).alias("part_no"),
        digits_to_ascii(F.regexp_replace(cell(F.lit(2)), r"(?U)^\s+|\s+$", "")).try_cast("int").alias("idx"),
        cell(F.lit(3)).alias("text"), cell(F.col("n_cols") - 1).alias("coref"),
    )
    rejected = rows.select(key, *[c for c in ("file_name", "line_no", "n_cols", "raw") if c in lines.columns]).join(bad, key)
    return tokens, rejected


def found_rejects(lines: DataFrame) -> DataFrame:
    return errors(parsed_cells(lines)).select("line_id")
