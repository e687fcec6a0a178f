"""Pair-local numbers merged into clusters of the whole document.

Pairs are taken in order.  A mention of the before frame that has a cluster already maps its local number to
it (the first such mention decides); one without gets the number's cluster or a new one.  Mentions of the after
frame get the number's cluster or a new one, replacing what they had.  The state is a document's; the fold
runs over the sorted pairs of a partition as a stream of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Position = tuple[int, int, int]


class MergeState:
    """Clusters of one document so far; also the state of the streaming merge."""

    def __init__(self, clusters: dict[Position, int] | None = None, following: int = 0):
        self.clusters = dict(clusters or {})
        self.following = following

    def add(self, before: Iterable[tuple[Position, int]], after: Iterable[tuple[Position, int]]) -> None:
        """One more pair: positions with their local numbers."""
        of_local: dict[int, int] = {}
        for position, local in before:
            if position in self.clusters:
                of_local.setdefault(local, self.clusters[position])
            elif local in of_local:
                self.clusters[position] = of_local[local]
            else:
                self.clusters[position] = of_local[local] = self._new()
        for position, local in after:
            if local not in of_local:
                of_local[local] = self._new()
            self.clusters[position] = of_local[local]

    def _new(self) -> int:
        self.following += 1
        return self.following - 1


_OUT = "doc_key bigint, sent_idx int, start_tok int, end_tok int, cluster_id bigint"
_MENTIONS = "array<struct<s:int,a:int,e:int,n:int>>"


def local_numbers(results: DataFrame, side: str) -> Column:
    """The mentions of one side as structs s, a, e, n: place and local number, which is predicted_local_no, else local_no, else 0."""
    names = results.schema[side].dataType.elementType.names
    pick = lambda m: F.coalesce(*[m[n] for n in ("predicted_local_no", "local_no") if n in names], F.lit(0))
    slim = F.transform(side, lambda m: F.struct(m["sent_idx"].alias("s"), m["start_tok"].alias("a"), m["end_tok"].alias("e"), pick(m).alias("n")))
    return F.coalesce(slim.cast(_MENTIONS), F.array().cast(_MENTIONS))


def _sides(column: pa.ListArray) -> tuple[list[Position], list[int], list[int]]:
    """Positions and numbers of all rows end to end, and where each row's end."""
    flat = column.flatten()
    s, a, e, n = (flat.field(i).to_pylist() for i in range(4))
    return list(zip(s, a, e)), n, [0, *column.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()]


def merge_pairs(results: DataFrame, key: str = "doc_key", order: str = "pair_idx") -> DataFrame:
    """doc_key, sent_idx, start_tok, end_tok, cluster_id of all mentions of the results; a null list is an empty one.

    The pairs of a partition are read as a sorted stream, so memory holds the mentions of one document, not its pairs.
    """
    rows = results.select(F.col(key).cast("bigint").alias("doc_key"), F.col(order).alias("k"), local_numbers(results, "before_mentions").alias("b"), local_numbers(results, "after_mentions").alias("f"))
    # the window puts each document's pairs in one partition and in order, and shuffles only what isn't yet
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_key").orderBy("k", "b", "f"))).select("doc_key", "nth", "b", "f")

    def run(batches):
        names, types = ["doc_key", "sent_idx", "start_tok", "end_tok", "cluster_id"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        out: tuple[list, ...] = ([], [], [], [], [])
        state, doc = None, None

        def done():
            if state is not None and state.clusters:
                for column, values in zip(out[1:4], zip(*state.clusters)):
                    column.extend(values)
                out[0].extend([doc] * len(state.clusters))
                out[4].extend(state.clusters.values())

        def written():
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            b, bn, b_ends = _sides(batch.column(2))
            f, fn, f_ends = _sides(batch.column(3))
            for i, (d, nth) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if nth == 1:
                    done()
                    state, doc = MergeState(), d
                x, y, v, w = b_ends[i], b_ends[i + 1], f_ends[i], f_ends[i + 1]
                state.add(zip(b[x:y], bn[x:y]), zip(f[v:w], fn[v:w]))
            if len(out[0]) > 50_000:
                yield written()
        done()
        yield written()

    return rows.mapInArrow(run, _OUT)
