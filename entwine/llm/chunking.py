"""Pieces under a limit that end at natural boundaries (problem 4).

Content-defined chunking: a rolling hash over WINDOW code points marks landmarks; from the start of a
piece the first landmark between the smallest and the largest size is moved to the nearest sentence end,
else to the nearest word end, in that span.  Without a landmark the last sentence end of the span
counts, else the last word end; a span with neither is cut at the landmark or at its end.  As landmarks depend on
the text around them only, an edit changes the pieces next to it and no others.

Each piece but the first begins OVERLAP code points before the end of the one before it, moved back to a word start
if there is one within SLACK; a piece with its overlap never exceeds the limit.  No boundary inside a
mention's markup is natural.

Defined results: a null item has no pieces; an empty one, and any up to the limit, is one piece as it stands;
null sentences are left out of the joined text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200
SLACK = 64
WINDOW = 32
#: A landmark comes every so many code points on average.
EVERY = 256

_SENTENCE_END = re.compile(r"[.!?।॥…。！？]+[\"'”’)\]]*(?=\s)|\[MID\](?=\s)|(?<=\S)(?=\s+\[MID\])|\S(?=\s*\n)")
_WORD_END = re.compile(r"\S(?=\s)")
_MARKUP = re.compile(r"<m>.*?</m>(?:#(?:MASK|\d+))?|</z>(?:[@#](?:MASK|\d+))?", re.S)


def landmarks(text: str, every: int = EVERY, window: int = WINDOW) -> np.ndarray:
    """Places p so that a hash of the window code points before p is 0 modulo every."""
    if len(text) < window:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (points + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(31)
    total = np.zeros(len(points) - window + 1, np.uint64)
    for j in range(window):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + len(total)]
    return np.flatnonzero((total >> np.uint64(20)) % np.uint64(every) == 0) + window


def boundaries(text: str, sentence_ends: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Sentence ends and word ends of a text that are inside no markup, as places after the last character."""
    spans = [m.span() for m in _MARKUP.finditer(text)] if "<m>" in text or "</z>" in text else []
    starts = [a for a, _ in spans]

    def free(p: int) -> bool:
        i = bisect_left(starts, p) - 1
        return i < 0 or p >= spans[i][1]

    sentences = sentence_ends if sentence_ends is not None else [m.end() for m in _SENTENCE_END.finditer(text)]
    return [p for p in sentences if free(p)], [p for m in _WORD_END.finditer(text) if free(p := m.end())]


def _nearest(places: list[int], at: int, low: int, high: int) -> int | None:
    i = bisect_left(places, at)
    near = [p for p in places[max(0, i - 1) : i + 1] if low <= p <= high]
    return min(near, key=lambda p: (abs(p - at), p)) if near else None


def _last(places: list[int], low: int, high: int) -> int | None:
    i = bisect_right(places, high) - 1
    return places[i] if i >= 0 and places[i] >= low else None


def chunk(text: str, sentence_ends: list[int] | None = None, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, str]]:
    """(start, end, how it ends) of each piece; end is "sentence", "word", "cut" or "text"."""
    if limit < 2 * (overlap + slack) + 2:
        raise ValueError("the limit must be over twice the overlap and its slack")
    if len(text) <= limit:
        return [(0, len(text), "text")]
    largest = limit - overlap - slack
    smallest = max(1, overlap + 1, largest // 3)
    marks = landmarks(text).tolist()
    sentences, words = boundaries(text, sentence_ends)
    out: list[tuple[int, int, str]] = []
    core = start = 0
    while True:
        room = limit if core == 0 else largest
        if len(text) - core <= room:
            out.append((start, len(text), "text"))
            return out
        low, high = core + smallest, core + largest
        i = bisect_left(marks, low)
        mark = marks[i] if i < len(marks) and marks[i] <= high else None
        end, how = None, ""
        for places, how in ((sentences, "sentence"), (words, "word")):
            end = _last(places, low, high) if mark is None else _nearest(places, mark, low, high)
            if end is not None:
                break
        if end is None:
            end, how = mark or high, "cut"
            while end < len(text) - 1 and end > low and _joined(text[end]):
                end -= 1
        out.append((start, end, how))
        core, start = end, end - overlap
        while start > end - overlap - slack and start > 0 and not text[start - 1].isspace():
            start -= 1
        if start > 0 and not text[start - 1].isspace():
            start = max(0, end - overlap)


def _joined(ch: str) -> bool:
    """Whether a character belongs to the one before it."""
    return unicodedata.category(ch)[0] == "M" or ch in "\u200c\u200d"


_PIECES = "item_kind string, item_key bigint, piece_no int, n_pieces int, start int, end int, overlap int, ends_at string, text string, first_part int, last_part int"


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK, only_oversized: bool = False) -> DataFrame:
    """Pieces of items (item_kind, item_key, parts ARRAY<STRING>: joined by one space they are the text).

    Items up to the limit stay in the JVM; only oversized ones go through Python, in a narrow map.
    first_part and last_part number the parts that a piece touches.
    """
    sized = items.where("parts is not null").withColumn("__text", F.array_join("parts", " "))
    large = sized.where(F.length("__text") > limit).drop("__text")

    def run(batches):
        for pdf in batches:
            rows = []
            for kind, key, parts in zip(pdf["item_kind"], pdf["item_key"], pdf["parts"]):
                parts = [p for p in parts if p is not None]
                text = " ".join(parts)
                ends = np.cumsum([len(p) + 1 for p in parts]) - 1
                pieces = chunk(text, ends[:-1].tolist() if len(parts) > 1 else None, limit, overlap, slack)
                done = 0
                for no, (a, b, how) in enumerate(pieces):
                    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
                    rows.append((kind, key, no, len(pieces), a, b, max(0, done - a), how, text[a:b], int(first), int(min(last, len(parts) - 1))))
                    done = b
            yield _frame(rows)

    split = large.mapInPandas(run, _PIECES)
    if only_oversized:
        return split
    parts = F.size(F.filter("parts", lambda p: p.isNotNull()))
    whole = sized.where(F.length("__text") <= limit).select(
        F.col("item_kind").cast("string").alias("item_kind"), F.col("item_key").cast("bigint").alias("item_key"), F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"),
        F.length("__text").alias("end"), F.lit(0).alias("overlap"), F.lit("text").alias("ends_at"), F.col("__text").alias("text"), F.lit(0).alias("first_part"), F.greatest(parts - 1, F.lit(0)).alias("last_part"),
    )
    return whole.unionByName(split)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    return pd.DataFrame(rows, columns=columns)


def document_items(documents: DataFrame) -> DataFrame:
    return documents.select(F.lit("document").alias("item_kind"), F.col("doc_key").cast("bigint").alias("item_key"), F.col("sentences").alias("parts"))


def example_items(examples: DataFrame) -> DataFrame:
    text = F.col("masked_input")
    return examples.select(F.lit("example").alias("item_kind"), F.col("example_id").cast("bigint").alias("item_key"), F.when(text.isNotNull(), F.array(text)).alias("parts"))


_WORD = re.compile(r"\S+")
#: Words of a masked text that stand for no word of its sentences.
_NO_WORD = re.compile(r"\[MID\]|</z>[@#](?:MASK|\d+)")


def sentence_spans(text: str, counts: list[int] | None) -> list[tuple[int, int]] | None:
    """Where the sentences of a masked text lie, from the number of words of each; None if the numbers don't fit the text."""
    words = [m.span() for m in _WORD.finditer(text) if not _NO_WORD.fullmatch(m[0])]
    if not counts or min(counts) < 0 or sum(counts) != len(words):
        return None
    out, done = [], 0
    for n in counts:
        out.append((words[done][0], words[done + n - 1][1]) if n else (0, 0))
        done += n
    return out


def _indices(text: str, a: int, b: int, spans: list[tuple[int, int]] | None, before: list[int], after: list[int]) -> tuple[list[int], list[int]]:
    """The indices of the sentences that text[a:b] touches, on either side."""
    if spans is None:  # all of a side that the piece lies in
        middle = text.find("[MID]")
        return before if middle < 0 or a < middle else [], after if middle < 0 or b > middle + 5 else []
    touched = [s < b and e > a for s, e in spans]
    sides = (before, touched[: len(before)]), (after, touched[len(before) :])
    return tuple([i for i, yes in zip(side, mask) if yes] for side, mask in sides)


_EXAMPLE = "item_kind string, item_key bigint, piece_no int, n_pieces int, start int, end int, overlap int, ends_at string, text string, before_sent_indices array<int>, after_sent_indices array<int>"


def example_pieces(examples: DataFrame, documents: DataFrame | None = None, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """Pieces of masked_input with the indices of the sentences that each piece touches, in either frame.

    A sentence's place in a masked text follows from its number of words in its document, as marks neither add nor part
    words.  Numbers of words come by a join on (doc_key, sentence), for oversized examples only.  Where the document is
    unknown or its words don't fit the text, a piece has all indices of each side that it lies in.  Sentence
    ends that are known this way are the natural boundaries; else those that the text shows.
    """
    parsed = lambda c: F.coalesce(F.from_json(F.col(c).cast("string"), "array<int>"), F.array().cast("array<int>"))
    kept = examples.select(
        F.lit("example").alias("item_kind"), F.col("example_id").cast("bigint").alias("item_key"), F.col("masked_input").alias("text"), parsed("before_sent_indices").alias("before_sent_indices"),
        parsed("after_sent_indices").alias("after_sent_indices"), *([F.col("doc_key").cast("bigint").alias("doc_key"), F.monotonically_increasing_id().alias("__row")] if documents is not None else []),
    ).where("text is not null")
    zero = F.lit(0)
    whole = kept.where(F.length("text") <= limit).select(
        "item_kind", "item_key", zero.alias("piece_no"), F.lit(1).alias("n_pieces"), zero.alias("start"), F.length("text").alias("end"), zero.alias("overlap"), F.lit("text").alias("ends_at"), "text",
        "before_sent_indices", "after_sent_indices",
    )
    large = kept.where(F.length("text") > limit)
    if documents is None:
        large = large.withColumn("counts", F.lit(None).cast("array<int>"))
    else:
        size = F.size(F.filter(F.split("s", r"(?U)\s+"), lambda w: w != ""))
        sized = documents.select(F.col("doc_key").cast("bigint").alias("doc_key"), F.posexplode("sentences").alias("i", "s")).select("doc_key", "i", size.alias("n"))
        wanted = large.select("item_key", "__row", "doc_key", F.posexplode(F.concat("before_sent_indices", "after_sent_indices")).alias("nth", "i"))
        # a sentence that its document lacks counts as -1, which fits no text
        counted = wanted.join(sized, ["doc_key", "i"], "left").groupBy("__row", "item_key").agg(F.sort_array(F.collect_list(F.struct("nth", F.coalesce("n", F.lit(-1)).alias("n")))).alias("c"))
        large = large.drop("doc_key").join(counted.select("__row", "item_key", F.col("c.n").alias("counts")), ["__row", "item_key"], "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text, before, after, counts in zip(pdf["item_key"], pdf["text"], pdf["before_sent_indices"], pdf["after_sent_indices"], pdf["counts"]):
                before, after = [int(i) for i in before], [int(i) for i in after]
                spans = sentence_spans(text, None if counts is None else [int(n) for n in counts])
                pieces = chunk(text, sorted({e for _, e in spans if 0 < e < len(text)}) if spans else None, limit, overlap, slack)
                done = 0
                for no, (a, b, how) in enumerate(pieces):
                    rows.append(("example", key, no, len(pieces), a, b, max(0, done - a), how, text[a:b], *_indices(text, a, b, spans, before, after)))
                    done = b
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EXAMPLE.split(", ")])

    return whole.unionByName(large.select("item_key", "text", "before_sent_indices", "after_sent_indices", "counts").mapInPandas(run, _EXAMPLE))


def found_items(documents: DataFrame, examples: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Items that the operator had to split."""
    pieces = split_items(document_items(documents).unionByName(example_items(examples)), limit, only_oversized=True)
    return pieces.where("n_pieces > 1 and piece_no = 0").select("item_kind", "item_key")
