"""Texts put into training sequences of one fixed capacity (problem 8).

Exact-complement hashing on the histogram of sizes: sizes are at most the capacity, so the whole
corpus is a table of at most CAPACITY counts, and the plan is made on that table.  For the largest size
that is left, the lengths, pairs and triples whose sum fills its gap exactly are looked up in a bitset of
the available lengths and consumed as often as their counts allow; sizes for which no exact combination is left are placed
best-fit.  The plan is a list of patterns (how many sequences hold how many items of each size),
so nothing that is collected or broadcast grows with the number of texts.  Each text then finds its
place from its rank among the texts of its size; ranks are counted in salted groups, whose number grows
with the largest count, as a third of all texts may have one size.

Defined results: a text over the capacity is cut into whole sequences and a rest, which is packed; a text without
tokens (null or empty) has one row with no sequence; ties are ordered by key.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .encode import DEFAULT, TOKENIZERS, count_tokens

CAPACITY = 2048
#: Groups in which the items of one size are ranked, at least, and the items that one group is to hold.
SALTS = 16
RANKED = 500_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]


def _exact(gap: int, available: int, mirrored: int, width: int, counts: list[int]) -> tuple[int, ...] | None:
    """A length, pair or triple of available lengths that sums to gap; bit l of available is length l."""
    if available >> gap & 1:
        return (gap,)

    def pair(total: int, largest: int, taken: int = 0) -> tuple[int, int] | None:
        """The pair of the largest length up to `largest`; of length `largest` itself, `taken` items are spoken for."""
        # lengths a with total - a available: mirrored has bit width - l for length l
        shift = width - total
        both = available & ((1 << total) - 1) & (mirrored >> shift if shift >= 0 else mirrored << -shift) & ~1
        both &= (1 << (largest + 1)) - 1
        while both:
            a = both.bit_length() - 1
            b = total - a
            if a < b:
                return None
            if all(counts[x] - taken * (x == largest) >= (a, b).count(x) for x in (a, b)):
                return a, b
            both ^= 1 << a
        return None

    if got := pair(gap, gap):
        return got
    rest = available & ((1 << gap) - 1) & ~1
    while rest:
        a = rest.bit_length() - 1
        if 3 * a < gap:
            return None
        rest ^= 1 << a
        if got := pair(gap - a, a, 1):
            return (a, *got)
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (number of sequences, ((size, items of it in one sequence), ...)) that hold every item."""
    counts = [0] * (capacity + 1)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} isn't in 1..{capacity}")
        counts[size] += n
    width = capacity
    available = sum(1 << size for size, n in enumerate(counts) if n)
    mirrored = sum(1 << (width - size) for size, n in enumerate(counts) if n)
    out: list[Pattern] = []
    left: dict[int, int] = {}

    def take(size: int, n: int) -> None:
        nonlocal available, mirrored
        counts[size] -= n
        if not counts[size]:
            available &= ~(1 << size)
            mirrored &= ~(1 << (width - size))

    for size in range(capacity, 0, -1):
        while counts[size]:
            if size == capacity:
                out.append((counts[size], ((size, 1),)))
                take(size, counts[size])
                break
            gap = capacity - size
            take(size, 1)
            got = _exact(gap, available, mirrored, width, counts)
            counts[size] += 1
            available |= 1 << size
            mirrored |= 1 << (width - size)
            if not got:
                left[size] = counts[size]
                take(size, counts[size])
                break
            need: dict[int, int] = {}
            for x in (size, *got):
                need[x] = need.get(x, 0) + 1
            times = min(counts[x] // k for x, k in need.items())
            out.append((times, tuple(sorted(need.items(), reverse=True))))
            for x, k in need.items():
                take(x, k * times)
    return out + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """The rest, largest sizes first, each into the open sequences with the least room that suffices."""
    gaps: list[int] = []
    open_at: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def keep(n: int, gap: int, items: tuple[tuple[int, int], ...]) -> None:
        if gap not in open_at:
            insort(gaps, gap)
        open_at.setdefault(gap, []).append((n, items))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                each = min(capacity // size, n)
                times = n // each
                keep(times, capacity - each * size, ((size, each),))
                n -= times * each
                continue
            gap = gaps[i]
            times, items = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[i]
            each = min(gap // size, n)
            used = min(times, n // each)
            if used < times:
                keep(times - used, gap, items)
            keep(used, gap - each * size, (*items, (size, each)))
            n -= used * each
    return [p for group in open_at.values() for p in group]


def _lookup(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By size: rank at which each pattern's share begins, first sequence, items of it per sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    done: dict[int, int] = {}
    base = 0
    for times, items in patterns:
        offset = 0
        for size, each in items:
            rows.setdefault(size, []).append((done.get(size, 0), base, each, offset))
            done[size] = done.get(size, 0) + each * times
            offset += each * size
        base += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r)) for size, r in rows.items()}


def pack_sizes(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Place of each item: key, piece_no, start, n_tokens, sequence, offset.  sizes is read three times: cut it first."""
    whole = F.floor(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)) / capacity).cast("int")
    rest = (F.coalesce(F.col(size), F.lit(0)) - whole * capacity).cast("int")
    base = sizes.select(F.col(key), whole.alias("__whole"), rest.alias("__rest"))
    # every whole sequence is one item of the size of the capacity, and the rest is one more
    items = base.select(
        key, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("__whole") - F.when(F.col("__rest") == 0, 1).otherwise(0), F.lit(0))), lambda i: F.struct(i.alias("piece_no"), F.when(i < F.col("__whole"), capacity).otherwise(F.col("__rest")).alias("n")))).alias("__p")
    ).select(key, F.col("__p.piece_no").alias("piece_no"), F.col("__p.n").alias("n_tokens"))
    counted = items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    histogram = {int(s): int(n) for s, n in zip(counted["n_tokens"], counted["n"])}
    salts = max(salts, -(-max(histogram.values(), default=0) // RANKED))
    shared = sizes.sparkSession.sparkContext.broadcast(_lookup(plan({s: n for s, n in histogram.items() if s}, capacity)))
    # ranks within a salted group, and what the groups before it hold: neither is one task's, whatever a size's share
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("n_tokens", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("n_tokens").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("n_tokens", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__nth", F.row_number().over(W.partitionBy("n_tokens", "__salt").orderBy(key, "piece_no"))).join(groups, ["n_tokens", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__nth") - 1 + F.col("__before"))
    kind = sizes.schema[key].dataType.simpleString()

    def place(batches):
        lookup = shared.value
        for b in batches:
            n, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int32)
            for size in np.unique(n).tolist():
                at = np.flatnonzero(n == size)
                if size == 0:
                    continue
                begins, bin0, each, off = lookup[size]
                i = np.searchsorted(begins, rank[at], "right") - 1
                nth = rank[at] - begins[i]
                sequence[at] = bin0[i] + nth // each[i]
                offset[at] = off[i] + nth % each[i] * size
            empty = n == 0
            start = b.column(1).to_numpy().astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(start), b.column(2), pa.array(sequence, mask=empty), pa.array(offset, mask=empty)],
                names=[key, "piece_no", "start", "n_tokens", "sequence", "offset"],
            )

    return ranked.select(key, "piece_no", "n_tokens", "__rank").mapInArrow(place, f"`{key}` {kind}, piece_no int, start bigint, n_tokens int, sequence bigint, offset int")


def pack_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """Texts sized in tokens of a public tokenizer and packed."""
    sizes = cut(count_tokens(documents.select(key, text), text, "n_tokens", tokenizer, folder), "packing-sizes")
    return pack_sizes(sizes, key, "n_tokens", capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and the share of room that is used; sequences over the capacity (never any)."""
    by = packed.where("sequence is not null").groupBy("sequence").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return by.agg(
        F.count(F.lit(1)).alias("n_sequences"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.sum((F.col("used") == capacity).cast("bigint")).alias("n_full"), F.sum((F.col("used") > capacity).cast("bigint")).alias("n_over"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("filled"),
    )
