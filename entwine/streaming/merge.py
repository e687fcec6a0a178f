"""Merging of pairs that arrive as a stream, and annotation files taken in as they arrive.

State is kept for each document: its clusters, the last pair that was merged, and pairs that came early.  A pair
names the one that it follows (pairs without mentions aren't made, so numbers have gaps), and is merged when that
one has been, so the result doesn't depend on the order of arrival; what a pair decides is given out once.
The clusters of a document are kept as long as its state, as a later pair may name any of its mentions.  With a
timeout, documents for which no pair comes in time are given up with their state (the stream then runs batches
without data too); without one their state is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import MergeState, local_numbers
from ..sources.conll import read_lines, scan_lines, with_doc_key

OUT = "doc_key bigint, pair_idx int, sent_idx int, start_tok int, end_tok int, cluster_id bigint"
STATE = "last int, new bigint, sent array<int>, start array<int>, end array<int>, cluster array<bigint>, early_follows array<int>, early_idx array<int>, early_pair array<string>"


def _fold(timeout_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    last, new, *clusters, follows, early_idx, early_pair = state.get if state.exists else (-1, 0, *[[]] * 7)
    merge = MergeState({(int(s), int(a), int(e)): int(c) for s, a, e, c in zip(*clusters)}, int(new))
    early = {int(p): (int(k), text) for p, k, text in zip(follows, early_idx, early_pair)}
    for pdf in batches:
        for p, k, pair in zip(pdf["follows"], pdf["pair_idx"], pdf["pair"]):
            if int(p) >= last:  # a pair that comes again decides nothing
                early.setdefault(int(p), (int(k), pair))
    rows = []
    while last in early:
        last, pair = early.pop(last)
        before, after = json.loads(pair)
        named = [(m[0], m[1], m[2]) for m in (*before, *after)]
        known = {p: merge.clusters.get(p) for p in named}
        merge.add(*([((m[0], m[1], m[2]), m[3]) for m in side] for side in (before, after)))
        rows += [(key[0], last, *p, merge.clusters[p]) for p, c in known.items() if merge.clusters[p] != c]
    places = [list(x) for x in zip(*merge.clusters)] or [[], [], []]
    held = sorted(early.items())
    state.update((last, merge.following, *places, list(merge.clusters.values()), [p for p, _ in held], [k for _, (k, _) in held], [text for _, (_, text) in held]))
    if timeout_ms:
        state.setTimeoutDuration(timeout_ms)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def merge_stream(results: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Clusters of a stream of results: doc_key, pair_idx, before_mentions, after_mentions, and follows, the pair_idx of
    the document's pair before (-1 for its first).  Without follows, pairs must be numbered from 0 without gaps."""
    side = lambda c: F.transform(local_numbers(results, c), lambda m: F.array(m["s"], m["a"], m["e"], m["n"]))
    number = F.col("pair_idx").cast("int")
    before = F.col("follows").cast("int") if "follows" in results.columns else number - 1
    slim = results.select(F.col("doc_key").cast("bigint").alias("doc_key"), number.alias("pair_idx"), before.alias("follows"), F.to_json(F.array(side("before_mentions"), side("after_mentions"))).alias("pair"))
    return slim.groupBy("doc_key").applyInPandasWithState(partial(_fold, timeout_ms), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def ingest_files(spark: SparkSession, folder: str, out: str, checkpoint: str, recursive: bool = True):
    """Takes in annotation files as they arrive and appends their tokens to a Parquet table; returns the query.

    Each file is whole in one micro-batch, and a batch that is run again replaces what it had written.
    """
    lines = read_lines(spark, folder, recursive, streaming=True)

    def write(batch: DataFrame, number: int) -> None:
        with_doc_key(scan_lines(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
