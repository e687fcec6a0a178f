"""Documents of evaluation splits that occur, the same or nearly so, in a training split (problem 1).

A case is a training and an evaluation document, both of at least MIN_WORDS words, whose longest common
subsequence of words has at least SHARE of the words of the longer one.

Segment join.  An evaluation text of n words and a partner leave at most k = floor(2 n (1 - SHARE)) words
unmatched in all, whatever the partner's length, and at most d = floor(n (1 - SHARE)) of them are the text's own.  The text is
cut into segments.  An unmatched word on either side destroys at most one segment, but one in the partner can only
part a segment of several words: so of k + HITS segments of any lengths at least HITS stand in every partner, as
they are, at a place no further away than the unmatched words allow, and so do HITS of d + HITS segments of one word.
Either bound holds for any cut, so the cut follows the frequencies, and of two cuts the cheaper is taken:

* pairs of words, of which the frequent ones lie together in segments of four and as many rare ones are parted into
  single words (a text of words that are frequent alone but rare together);
* the d + HITS rarest words alone, and what lies between them in segments that need not be looked up (a text with
  rare words, or of phrases that the whole corpus shares).

Training texts look up their substrings of these lengths (1, 2 and 4 words).  They send only those that some
evaluation text of a fitting length probes, so a small evaluation set makes a small join, however large
the training set is.  Candidates with HITS surviving segments are verified, first by their shared multiset of words,
then by dynamic programming over the band of positions that the tolerance permits.  No candidate is capped.

How frequent a segment is tells a count-min sketch of training texts, of two rows; which are probed, a table of
bits.  Both are sized from the corpus's words up to a bound (2 and 4 MB broadcast; each cell that isn't empty is collected
once, in 8 and 12 bytes); beyond it estimates are coarser, which costs time and changes no result.  Segments of very many training texts are spread over salts.

Exact copies form one class before the join, so a hot group of copies costs one row; pairs of copies
are expanded at the end from the membership table, in salted blocks, as the required result is one row for each pair.
The report needs no pairs: it adds up the classes' sizes.

Defined results: tokens rows with a null doc_key, sent_idx or tok_pos have no place and are left out; of
rows with one place the first delivered counts, as elsewhere; null and non-word texts are no words; documents
with no row in the document table, or with a split that is neither training nor evaluation, have no pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .confusables import unicode_data

MIN_WORDS = 40
SHARE = 0.75
HITS = 3
TRAINING = ("train", "training")
EVALUATION = ("development", "dev", "val", "validation", "valid", "test", "eval", "evaluation")
#: Lengths of segments in words.
LENGTHS = (1, 2, 4)
#: Counters of one row of the sketch, and bits of the table of probed segments: least and most.
COUNTERS = 1 << 15, 1 << 18
PROBES = 1 << 19, 1 << 25
#: Training texts of one hot segment that one task joins; beyond it the segment is spread over salts, SALTS at most.
HOT = 4_000
SALTS = 64
#: Members of a class that stand together in one block when pairs are expanded.
BLOCK = 4_000

_WORDS_SCHEMA = "doc_key bigint, split string, n int, class string, words array<bigint>"


def least_common(n: int, m: int, share: float = SHARE) -> int:
    """Words that the longer of two texts must have in common with the other; exact for any lengths."""
    return math.ceil(round(share * max(n, m), 9))


def word_code(form: str) -> int:
    """A 63-bit code of a word in consistent form, letter case aside; 0 if it has no letter or digit."""
    form = form.casefold()
    if not any(map(str.isalnum, form)):
        return 0
    return int.from_bytes(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 or 1


_codes: dict[str, int] = {}


def _code(text: str | None, known) -> int:
    if text is None:
        return 0
    got = _codes.get(text)
    if got is None:
        if len(_codes) > 400_000:
            _codes.clear()
        got = word_code(known.remembered(text)[0])
        if len(text) < 200:
            _codes[text] = got
    return got


def word_sequences(tokens: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document with its words as codes and its split; one shuffle by doc_key.

    The documents' rows travel in the same shuffle as the tokens (at sentence -1), so that no join is
    needed, and the sorted partitions are read as a stream: memory doesn't grow with a document's rows
    beyond its own words.
    """
    rows = tokens.select(
        F.col("doc_key").cast("bigint").alias("doc_key"), F.col("sent_idx").cast("int").alias("sent_idx"), F.col("tok_pos").cast("int").alias("tok_pos"),
        F.col("loaded_at").cast("timestamp").alias("at"), F.col("token_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"),
    ).where("doc_key is not null and sent_idx is not null and tok_pos is not null")
    marks = documents.select(
        F.col("doc_key").cast("bigint").alias("doc_key"), F.lit(-1).alias("sent_idx"), F.lit(-1).alias("tok_pos"),
        F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("bigint").alias("id"), F.col("split").cast("string").alias("text"),
    ).where("doc_key is not null")
    ordered = rows.where("sent_idx >= 0").unionByName(marks).repartition("doc_key").sortWithinPartitions("doc_key", "sent_idx", "tok_pos", F.col("at").asc_nulls_last(), F.col("id").asc_nulls_last(), "text")

    shared = unicode_data(tokens.sparkSession)

    def run(batches):
        known = shared.value
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b.select(["doc_key", "sent_idx", "tok_pos", "text"])])
            held = t if held is None else pa.concat_tables([held, t])
            keys = held.column("doc_key").to_numpy()
            if len(keys) == 0 or keys[0] == keys[-1] and len(keys) < 5_000_000:
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield _sequences(held.slice(0, last), known)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield _sequences(held, known)

    return ordered.mapInArrow(run, _WORDS_SCHEMA)


def _sequences(t: pa.Table, known) -> pa.RecordBatch:
    key, sent, pos = (t.column(c).to_numpy() for c in ("doc_key", "sent_idx", "tok_pos"))
    text = t.column("text").combine_chunks()
    coded = pc.dictionary_encode(text)
    codes = np.array([_code(x, known) for x in coded.dictionary.to_pylist()] + [0], np.int64)
    code = codes[pc.fill_null(coded.indices, len(codes) - 1).to_numpy()]
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    ends = np.append(starts[1:], len(key))
    # of the rows of one place, which stand together, the first counts
    first = np.append(True, (np.diff(key) != 0) | (np.diff(sent) != 0) | (np.diff(pos) != 0))
    keep = first & (code != 0) & (sent >= 0)
    out: dict[str, list] = {"doc_key": [], "split": [], "n": [], "class": [], "words": []}
    for a, b in zip(starts.tolist(), ends.tolist()):
        words = code[a:b][keep[a:b]]
        out["doc_key"].append(int(key[a]))
        out["split"].append(text[a].as_py() if sent[a] < 0 else None)
        out["n"].append(len(words))
        out["class"].append(hashlib.blake2b(words.tobytes(), digest_size=16).hexdigest())
        out["words"].append(words)
    schema = pa.schema([("doc_key", pa.int64()), ("split", pa.string()), ("n", pa.int32()), ("class", pa.string()), ("words", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_pydict(out, schema=schema)


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def run_codes(words: np.ndarray, length: int) -> np.ndarray:
    """A code of the run of so many words that begins at each place."""
    w = words.astype(np.uint64)
    total = np.zeros(max(len(w) - length + 1, 0), np.uint64)
    for j in range(length):
        total = total * _ODD + w[j : j + len(total)]
    return (_mixed(total + np.uint64(length)) >> np.uint64(1)).astype(np.int64)


class Sketch:
    """Estimated numbers of training texts that hold a run of words: never too low."""

    def __init__(self, counters: np.ndarray):
        self.rows = counters  # two rows

    @staticmethod
    def places(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return codes % size, (codes >> 31) % size

    def of(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.places(codes, self.rows.shape[1])
        return np.minimum(self.rows[0][a], self.rows[1][b])

    def estimates(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the estimate of the run at each place; a run of four is no more frequent than its halves."""
        two = self.of(run_codes(words, 2))
        return {1: self.of(run_codes(words, 1)), 2: two, 4: np.minimum(two[:-2], two[2:])}


def _sized(wanted: int, bounds: tuple[int, int]) -> int:
    return min(max(1 << max(int(wanted) - 1, 1).bit_length(), bounds[0]), bounds[1])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch of texts end to end, and the text of each word."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _collected(cells: DataFrame, size: int, kind: type) -> np.ndarray:
    """An array of a size from rows (place int, value); the driver gets them as a few byte strings."""
    width = np.dtype(kind)

    def packed(batches):
        for b in batches:
            columns = [b.column(0).to_numpy().astype(np.int32), b.column(1).to_numpy().astype(width)]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["places", "values"])

    out = np.zeros(size, width)
    for r in cells.mapInArrow(packed, "places binary, values binary").collect():  # at most 12 bytes a cell
        out[np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["values"], width)
    return out


def _sketch(classes: DataFrame, size: int) -> Sketch:
    """Counts of the words and pairs of words of training texts: a table of a bounded size, whatever the corpus."""

    def run(batches):
        total = np.zeros(2 * size, np.int64)
        for b in batches:
            words, text = _flat(b.column(0))
            for length in (1, 2):
                codes = run_codes(words, length)
                if not len(codes):
                    continue
                inside = text[: len(codes)] == text[length - 1 :]
                codes, owner = codes[inside], text[: len(inside)][inside]
                once = np.unique(_mixed(codes.astype(np.uint64) + _mixed(owner.astype(np.uint64) + _ODD)), return_index=True)[1]
                for row, at in enumerate(Sketch.places(codes[once], size)):
                    total += np.bincount(at + row * size, minlength=2 * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "texts"])

    counted = classes.where("train").select("words").mapInArrow(run, "counter int, texts bigint").groupBy("counter").agg(F.least(F.sum("texts"), F.lit(2**31 - 1)).cast("int").alias("texts"))
    return Sketch(_collected(counted, 2 * size, np.int32).reshape(2, size))


def _values(words: pa.ListScalar) -> np.ndarray:
    return words.values.to_numpy(zero_copy_only=False)


def _band(n: np.ndarray | int, share: float):
    """Lengths of which neither is under share of the other are in the same band or in neighbours."""
    return np.floor(np.log(n) / -math.log(share) + 1e-9).astype(np.int64) if share < 1 else np.asarray(n, np.int64) * 2


def unmatched(n: int, share: float = SHARE) -> int:
    """Words that a text of n and any partner leave unmatched in all, at most."""
    return math.floor(round(2 * n * (1 - share), 9))


def cut_segments(n: int, estimates: dict[int, np.ndarray], share: float = SHARE, hits: int = HITS) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the segments to look up of a text of n words begin, how long they are, and how many of them every partner holds.

    The cheaper of two cuts, by the training texts that hold its segments.
    """
    alone = n - math.ceil(round(share * n, 9))
    few = max(1, min(hits, n - alone))
    rare = np.argsort(estimates[1], kind="stable")[: alone + few]
    start, length, least = _cut_in_pairs(n, estimates, share, hits)
    cost = sum(int(estimates[size][start[length == size]].sum()) for size in LENGTHS)
    if int(estimates[1][rare].sum()) <= cost:
        return rare, np.ones(len(rare), np.int64), few
    return start, length, least


def _cut_in_pairs(n: int, estimates: dict[int, np.ndarray], share: float, hits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """k + hits segments of 1, 2 or 4 words that don't overlap, frequent words together; k = unmatched(n)."""
    k = unmatched(n, share)
    least = max(1, min(hits, n - k))
    wanted = k + least
    pairs = n // 2
    one, two = estimates[1].astype(np.int64), estimates[2][: 2 * pairs : 2].astype(np.int64)
    parted = one[: 2 * pairs : 2] + one[1 : 2 * pairs : 2] - two  # what it costs more to part a pair
    order = np.argsort(parted, kind="stable")
    more = max(0, wanted - pairs - n % 2)
    split = np.zeros(pairs, bool)
    split[order[:more]] = True
    # two neighbouring pairs as one segment, paid for by parting one pair more
    joined = np.zeros(pairs, bool)
    if pairs > 3:
        together = two[0 : pairs - 1 : 2] + two[1:pairs:2] - np.minimum(two[0 : pairs - 1 : 2], two[1:pairs:2])
        at = more
        for i in np.argsort(-together, kind="stable").tolist():
            while at < pairs and (split[order[at]] or joined[order[at]]):
                at += 1
            if at >= pairs or together[i] <= parted[order[at]]:
                break
            p = int(order[at])
            if split[2 * i] or split[2 * i + 1] or p // 2 == i:
                continue
            joined[2 * i] = joined[2 * i + 1] = split[p] = True
    pair = np.arange(pairs)
    whole, single, four = pair[~split & ~joined], pair[split], pair[joined][::2]
    start = np.concatenate([2 * whole, 2 * single, 2 * single + 1, 2 * four, np.arange(2 * pairs, n)])
    length = np.repeat([2, 1, 4, 1], [len(whole), 2 * len(single), len(four), n % 2])
    if len(start) > wanted:
        cost = np.zeros(len(start), np.int64)
        for size in LENGTHS:
            cost[length == size] = estimates[size][start[length == size]]
        kept = np.argsort(cost, kind="stable")[:wanted]
        start, length = start[kept], length[kept]
    return start, length, least


def _evaluation_segments(words: np.ndarray, sketch: Sketch, share: float, hits: int) -> tuple[np.ndarray, ...]:
    """code, count, first and last place and estimate of the distinct segments of a text; and how many survive."""
    estimates = sketch.estimates(words)
    start, length, least = cut_segments(len(words), estimates, share, hits)
    code, estimate = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    for size in LENGTHS:
        here = length == size
        if here.any():
            code[here], estimate[here] = run_codes(words, size)[start[here]], estimates[size][start[here]]
    distinct, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    low, high = np.full(len(distinct), len(words), np.int64), np.zeros(len(distinct), np.int64)
    np.minimum.at(low, inverse, start)
    np.maximum.at(high, inverse, start)
    return distinct, count, low, high, estimate[first], least


def _slot(codes: np.ndarray, band: np.ndarray | int, size: int) -> np.ndarray:
    """Where a segment in a band of lengths stands in the table of probes."""
    return (codes ^ (codes >> 29) ^ (np.asarray(band, np.int64) * 0x9E3779B1)) % size


def _salts(estimate: np.ndarray, hot: int) -> np.ndarray:
    return np.minimum(np.maximum(1, -(-estimate.astype(np.int64) // hot)), SALTS)


def _evaluation_rows(classes: DataFrame, sketch, share: float, hits: int, hot: int) -> DataFrame:
    """A row for each distinct segment of each evaluation text, each band that it may match in and each salt."""
    names = ["word", "band", "salt", "e", "en", "least", "ec", "elo", "ehi"]

    def run(batches):
        for b in batches:
            parts = []
            for rep, words in zip(b.column(0).to_pylist(), map(_values, b.column(1))):
                n, (code, count, low, high, estimate, least) = len(words), _evaluation_segments(words, sketch.value, share, hits)
                copies = 3 * _salts(estimate, hot)
                at = np.repeat(np.arange(len(code)), copies)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                same = lambda x: np.full(len(at), x, np.int64)
                parts.append((code[at], _band(n, share) - 1 + nth % 3, nth // 3, same(rep), same(n), same(least), count[at], low[at], high[at]))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(columns, types)], names=names)

    return classes.where("evaluation").select("rep", "words").mapInArrow(run, "word bigint, band int, salt int, e bigint, en int, least int, ec int, elo int, ehi int")


def _probes(classes: DataFrame, sketch, size: int, share: float, hits: int) -> np.ndarray:
    """Which segments evaluation texts probe, in which bands: a table of a bounded size, so collisions only cost time."""

    def run(batches):
        seen = np.zeros(size, bool)
        for b in batches:
            for words in map(_values, b.column(0)):
                code = _evaluation_segments(words, sketch.value, share, hits)[0]
                for step in (-1, 0, 1):
                    seen[_slot(code, _band(len(words), share) + step, size)] = True
        blocks = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(blocks[at])], names=["block", "bits"])

    marked = classes.where("evaluation").select("words").mapInArrow(run, "block int, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    return _collected(marked, size // 64, np.int64).view(np.uint8)


def _training_rows(classes: DataFrame, sketch, probes, share: float, hot: int) -> DataFrame:
    """A row for each distinct substring of each training text that an evaluation text of a fitting length probes."""
    names = ["word", "band", "salt", "t", "tn", "tc", "tlo", "thi"]

    def run(batches):
        wanted = np.unpackbits(probes.value).astype(bool)
        for b in batches:
            rep = b.column(0).to_numpy()
            words, text = _flat(b.column(1))
            if not len(words):
                continue
            size = np.bincount(text, minlength=len(rep))
            begins = np.cumsum(size) - size
            band = _band(np.maximum(size, 1), share)
            estimates = sketch.value.estimates(words)
            parts = []
            for length in LENGTHS:
                codes = run_codes(words, length)
                if not len(codes):
                    continue
                owner = text[: len(codes)]
                at = np.flatnonzero((owner == text[length - 1 :]) & wanted[_slot(codes, band[owner], len(wanted))])
                if not len(at):
                    continue
                order = at[np.lexsort((at, codes[at], owner[at]))]
                o, c = owner[order], codes[order]
                first = np.flatnonzero(np.append(True, (np.diff(o) != 0) | (np.diff(c) != 0)))
                last = np.append(first[1:], len(order)) - 1
                here = o[first]
                parts.append((c[first], band[here], rep[here] % _salts(estimates[length][order[first]], hot), rep[here], size[here], last - first + 1, order[first] - begins[here], order[last] - begins[here]))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(columns, types)], names=names)

    return classes.where("train").select("rep", "words").mapInArrow(run, "word bigint, band int, salt int, t bigint, tn int, tc int, tlo int, thi int")


def _candidates(e: DataFrame, t: DataFrame, share: float) -> DataFrame:
    least = F.ceil(F.round(F.lit(share) * F.greatest("en", "tn"), 9))
    allowed = (
        (F.col("e") != F.col("t"))
        & (F.least("en", "tn") >= least)
        & (F.col("tlo") - F.col("ehi") <= F.col("tn") - least)
        & (F.col("elo") - F.col("thi") <= F.col("en") - least)
    )
    return e.join(t, ["word", "band", "salt"]).where(allowed).groupBy("e", "t").agg(F.sum(F.least("ec", "tc")).alias("survived"), F.max("least").alias("least")).where("survived >= least").select("e", "t")


def common_in_order(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence if it is at least least, else 0: a banded dynamic programme.

    A match of a[i] and b[j] leaves j - i or i - j words unmatched, so only cells with
    -(len(a) - least) <= j - i <= len(b) - least count.
    """
    n, m = len(a), len(b)
    if min(n, m) < least:
        return 0
    left, right = n - least, m - least
    width = left + right + 1
    padded = np.concatenate([np.full(left, -1, np.int64), b, np.full(left, -1, np.int64)])
    row = np.zeros(width, np.int32)  # row[c] is the cell of j = i - left + c words of b
    for i in range(n):
        # from row i to row i + 1 the band moves by one: column c of the new row stands below column c + 1
        diagonal = row + (padded[i : i + width] == a[i])
        above = np.append(row[1:], 0)
        row = np.maximum.accumulate(np.maximum(diagonal, above))
        if row[-1] + (n - 1 - i) < least:
            return 0
    return int(row[-1]) if row[-1] >= least else 0


def _verify(pairs: DataFrame, share: float) -> DataFrame:
    def run(batches):
        for b in batches:
            out: dict[str, list] = {"e": [], "t": [], "common": []}
            for e, t, ew, tw in zip(*(b.column(i) for i in range(4))):
                x, y = _values(ew), _values(tw)
                least = least_common(len(x), len(y), share)
                (ux, cx), (uy, cy) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
                if np.minimum(cx[ix], cy[iy]).sum() >= least and (common := common_in_order(x, y, least)):
                    for k, v in (("e", e.as_py()), ("t", t.as_py()), ("common", common)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("e", pa.int64()), ("t", pa.int64()), ("common", pa.int32())]))

    return pairs.select("e", "t", "ew", "tw").mapInArrow(run, "e bigint, t bigint, common int")


def _linked_classes(tokens: DataFrame, documents: DataFrame, min_words: int, share: float, hits: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their class and sides, and the links of classes: e_class, t_class, common, and the numbers of members."""
    if not 0.5 < share <= 1:
        raise ValueError("share must be over 0.5 and at most 1")
    spark = tokens.sparkSession
    side = F.lower(F.trim("split"))
    docs = word_sequences(tokens, documents).where(F.col("n") >= max(1, min_words))
    docs = docs.withColumn("train", F.coalesce(side.isin(*TRAINING), F.lit(False))).withColumn("evaluation", F.coalesce(side.isin(*EVALUATION), F.lit(False)))
    docs = cut(docs.where("train or evaluation").drop("split"), "overlap-documents")
    number = lambda c: F.sum(F.col(c).cast("bigint"))
    classes = docs.groupBy("class").agg(F.min("doc_key").alias("rep"), number("train").alias("n_train"), number("evaluation").alias("n_evaluation"), F.min_by("words", "doc_key").alias("words"))
    classes = cut(classes.withColumn("train", F.col("n_train") > 0).withColumn("evaluation", F.col("n_evaluation") > 0), "overlap-classes")
    sizes = classes.agg(*[F.coalesce(F.sum(F.when(F.col(c), F.size("words"))), F.lit(0)).alias(c) for c in ("train", "evaluation")]).first()
    share_out = spark.sparkContext.broadcast
    sketch = share_out(_sketch(classes, _sized(sizes["train"] // 4, COUNTERS)))
    probes = share_out(_probes(classes, sketch, _sized(sizes["evaluation"] * 24, PROBES), share, hits))
    pairs = _candidates(_evaluation_rows(classes, sketch, share, hits, hot), _training_rows(classes, sketch, probes, share, hot), share)
    words = classes.select("rep", "words")
    pairs = pairs.join(words.select(F.col("rep").alias("e"), F.col("words").alias("ew")), "e").join(words.select(F.col("rep").alias("t"), F.col("words").alias("tw")), "t")
    linked = _verify(pairs, share)
    member = lambda side, n: classes.select(F.col("rep").alias(side), F.col("class").alias(f"{side}_class"), F.col(n))
    linked = linked.join(member("e", "n_evaluation"), "e").join(member("t", "n_train"), "t").select("e_class", "t_class", "common", "n_evaluation", "n_train")
    same = classes.where("train and evaluation").select(F.col("class").alias("e_class"), F.col("class").alias("t_class"), F.size("words").alias("common"), "n_evaluation", "n_train")
    return docs, linked.unionByName(same)


def cross_split_overlaps(tokens: DataFrame, documents: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE, hits: int = HITS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """train_key, eval_key, n_train, n_eval, common: all pairs of the two sides that overlap."""
    docs, links = _linked_classes(tokens, documents, min_words, share, hits, hot)
    # the members of a class stand in blocks, so that the pairs of two hot classes are made by many tasks
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    size = docs.groupBy("class").agg(*[F.sum(F.col(c).cast("bigint")).alias(f"n_{c}") for c in ("train", "evaluation")])
    placed = docs.select("doc_key", "class", "n", "train", "evaluation").join(size, "class")
    of = lambda side, c: placed.where(side).select(
        F.col("class").alias(f"{c}_class"), F.pmod(F.xxhash64("doc_key"), blocks(f"n_{side}")).cast("int").alias(f"{c}_block"), F.col("doc_key").alias(f"{c}_key"), F.col("n").alias(f"n_{c}")
    )
    evals, trains = of("evaluation", "e"), of("train", "t")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    cells = links.withColumn("e_block", every("n_evaluation")).withColumn("t_block", every("n_train")).drop("n_evaluation", "n_train")
    pairs = cells.join(evals, ["e_class", "e_block"]).join(trains, ["t_class", "t_block"])
    return pairs.select(F.col("t_key").alias("train_key"), F.col("e_key").alias("eval_key"), F.col("n_t").alias("n_train"), F.col("n_e").alias("n_eval"), "common")


def found_pairs(tokens: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_key_a, doc_key_b of all cases, the smaller key first."""
    pairs = cross_split_overlaps(tokens, documents)
    return pairs.select(F.least("train_key", "eval_key").alias("doc_key_a"), F.greatest("train_key", "eval_key").alias("doc_key_b"))


def overlap_report(tokens: DataFrame, documents: DataFrame) -> DataFrame:
    """Numbers per evaluation split and corpus: documents, those that overlap with training, pairs, exact pairs.

    No pair is expanded: an evaluation document has as many pairs as the classes linked with its own have training members.
    """
    docs, links = _linked_classes(tokens, documents, MIN_WORDS, SHARE, HITS, HOT)
    by_class = links.groupBy(F.col("e_class").alias("class")).agg(F.sum("n_train").alias("pairs"), F.sum(F.when(F.col("e_class") == F.col("t_class"), F.col("n_train")).otherwise(0)).alias("exact"))
    evals = documents.where(F.lower(F.trim("split")).isin(*EVALUATION)).select("doc_key", "split", "corpus")
    # documents of one class, split and corpus are one row before they meet the links
    placed = evals.join(docs.where("evaluation").select("doc_key", "class"), "doc_key", "left").groupBy("split", "corpus", "class").agg(F.count(F.lit(1)).alias("k"))
    found = placed.join(by_class, "class", "left")
    total = lambda c: F.coalesce(F.sum(F.col("k") * F.col(c)), F.lit(0)).cast("bigint")
    return found.groupBy("split", "corpus").agg(
        F.sum("k").alias("n_documents"), F.coalesce(F.sum(F.when(F.col("pairs").isNotNull(), F.col("k"))), F.lit(0)).alias("n_overlapping"), total("pairs").alias("n_pairs"), total("exact").alias("n_exact_pairs"),
    )
