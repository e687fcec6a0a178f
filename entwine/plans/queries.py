"""Queries by name: each takes (spark, sf_dir) and returns a DataFrame; ORACLES has SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed, rejects
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and SQL for DuckDB where SQL can say the same."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_JUDGED_SQL = r"""
WITH rows AS (
  SELECT *, regexp_replace(raw, '\r$', '') AS line FROM raw_conll_lines
), tokens AS (
  SELECT *, regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') AS quoted,
    list_transform(regexp_extract_all(chr(9) || line, '\t("(?:[^"]|"")*"|[^"\t]*)', 1),
      lambda f: CASE WHEN f LIKE '"%' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f
  FROM rows WHERE NOT regexp_full_match(line, '[\s\p{Z}]*') AND NOT regexp_matches(line, '^\s*#(?:begin|end) document\b')
), cells AS (
  SELECT *, len(f) = n_cols AS shaped, f[3] AS i, translate(regexp_replace(f[3], '[\s\p{Z}]', '', 'g'), '०१२३४५६७८९০১২৩৪৫৬৭৮৯௦௧௨௩௪௫௬௭௮௯', '012345678901234567890123456789') AS digits,
    regexp_replace(f[n_cols], '\(\p{Nd}+\)|\(\p{Nd}+|\p{Nd}+\)', chr(2), 'g') AS coref FROM tokens
), judged AS (
  SELECT *, regexp_full_match(i, '[\s\p{Z}]*\p{Nd}+[\s\p{Z}]*') AS numeric,
    coalesce(try_cast(digits AS HUGEINT), 99999999999) <= 2147483647 AS fits,
    regexp_full_match(coref, '[\s\p{Z}|｜;,、/\\&+"''\[\]]*(?:(?:\x02|[-*_])[\s\p{Z}|｜;,、/\\&+"''\[\]]*)*') AS marked
  FROM cells
)
"""
_REJECTS_SQL = _JUDGED_SQL + "SELECT line_id FROM judged WHERE NOT (quoted AND shaped AND numeric AND fits AND marked)"
_LOADED_SQL = _JUDGED_SQL + """SELECT line_id, file_name, line_no, f[1] AS doc_id, f[2] AS part_no, CAST(digits AS INTEGER) AS idx, f[4] AS text, f[n_cols] AS coref
FROM judged WHERE quoted AND shaped AND numeric AND fits AND marked"""
_REASONS_SQL = _JUDGED_SQL + """SELECT line_id, file_name, line_no, n_cols, raw,
  CASE WHEN NOT quoted THEN 'broken_quoting' WHEN NOT shaped THEN 'wrong_column_count'
    ELSE concat_ws(',', CASE WHEN NOT marked THEN 'coref_invalid' END, CASE WHEN NOT numeric THEN 'index_not_a_number' WHEN NOT fits THEN 'index_over_int' END) END AS reasons
FROM judged WHERE NOT (quoted AND shaped AND numeric AND fits AND marked)"""


@query("p3_found", _REJECTS_SQL)
def p3_found(spark, d):
    return rejects.found_rejects(table(spark, d, "raw_conll_lines"))


@query("p3_loaded_tokens", _LOADED_SQL)
def p3_loaded_tokens(spark, d):
    return rejects.split_rows(table(spark, d, "raw_conll_lines"))[0]


@query("p3_rejected", _REASONS_SQL)
def p3_rejected(spark, d):
    bad = rejects.split_rows(table(spark, d, "raw_conll_lines"))[1]
    return bad.select("line_id", "file_name", "line_no", "n_cols", "raw", F.array_join("reasons", ",").alias("reasons"))


@query(
    "p6_found",
    r"""
WITH marks AS (SELECT token_id, regexp_extract_all(coref, '\(\p{Nd}+\)|\(\p{Nd}+|\p{Nd}+\)') AS m FROM tokens)
SELECT token_id, CAST(i - 1 AS INTEGER) AS pos, m[i] AS part_value
FROM (SELECT token_id, m, unnest(range(1, len(m) + 1)) AS i FROM marks WHERE len(m) >= 2)
""",
)
def p6_found(spark, d):
    return packed.found_marks(table(spark, d, "tokens"))


@query(
    "p6_values",
    r"""
WITH marks AS (SELECT token_id, regexp_extract_all(coref, '\(\p{Nd}+\)|\(\p{Nd}+|\p{Nd}+\)') AS m FROM tokens)
SELECT token_id, CAST(i - 1 AS INTEGER) AS pos, m[i] AS part_value, CAST(len(m) AS INTEGER) AS n_parts
FROM (SELECT token_id, m, unnest(range(1, len(m) + 1)) AS i FROM marks)
""",
)
def p6_values(spark, d):
    return packed.unpack(table(spark, d, "tokens"), "token_id", "coref", packed.corpus_prefix()).drop("source")

from . import corpus_queries as _corpus  # noqa: E402,F401  (registers its queries)
