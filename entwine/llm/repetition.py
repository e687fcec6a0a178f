"""Share of repeated content within each document (problem 9).

Repetition coverage: the words of many texts lie end to end in one numpy array of word hashes; rolling
hashes of several n-gram lengths over it tell which runs of words were seen earlier in the same text,
and the words and characters inside those runs are measured, and so are whole lines seen earlier.  Letter
case, digits, punctuation, signs and invisible characters are set aside: they are no part of a word.

Defined results: a null, empty or wordless text has 0 words and shares of 0.  Any length is measured whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run whose words count as repeated in share, and the run lengths measured besides.
RUN = 6
RUNS = (3, 6, 12)
LEAST_SHARE = 0.25
#: Code points that one pass holds, whatever the size of an Arrow batch; a longer text is a pass of its own.
PASS = 1_500_000

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 set aside, 1 blank, 2 part of a word, 3 line end; and the lower-case letter."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for o in range(0x110000):
        c = chr(o)
        if c in "\n\r\v\f\x85\u2028\u2029":
            kind[o] = 3
        elif c.isspace():
            kind[o] = 1
        elif unicodedata.category(c)[0] in "LM":
            kind[o] = 2
            if len(low := c.lower()) == 1:
                lower[o] = ord(low)
    return kind, lower


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _ODD)]))


def _seen_earlier(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same value stands earlier with the same owner."""
    both = _mixed(value + _mixed(owner.astype(np.uint64) + _ODD))
    seen = np.ones(len(both), bool)
    seen[np.unique(both, return_index=True)[1]] = False
    return seen


def measure(texts: list[str | None], runs: tuple[int, ...] = RUNS) -> dict[str, np.ndarray]:
    """n_words, and for each run length n words_n and chars_n, line_chars; n_chars counts characters of words."""
    kind_of, lower_of = _tables()
    n = len(texts)
    size = np.array([len(t) if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(n), size)
    kind = kind_of[points]
    keep = np.flatnonzero(kind)
    kind, owner, letter = kind[keep], owner[keep], lower_of[points[keep]].astype(np.uint64)
    in_word = kind == 2
    new_text = np.diff(owner, prepend=-1) != 0
    begins = in_word & (new_text | ~np.append(False, in_word[:-1]))
    out: dict[str, np.ndarray] = {k: np.zeros(n, np.int64) for k in ("n_words", "n_chars", "line_chars")} | {f"{u}_{r}": np.zeros(n, np.int64) for r in runs for u in ("words", "chars")}
    start = np.flatnonzero(begins)
    if not len(start):
        return out
    at = np.flatnonzero(in_word)
    word = np.cumsum(begins)[at] - 1
    length = np.bincount(word, minlength=len(start))
    offset = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    power = _powers(int(length.max()))
    hashed = _mixed(np.add.reduceat(_mixed(letter[at] + _ODD) * power[offset], np.cumsum(length) - length))
    text = owner[start]
    out["n_words"] = np.bincount(text, minlength=n)
    out["n_chars"] = np.bincount(text, length, minlength=n).astype(np.int64)
    for r in runs:
        if len(hashed) < r:
            continue
        last = len(hashed) - r + 1
        gram = np.zeros(last, np.uint64)
        for j in range(r):
            gram = gram * _ODD + hashed[j : j + last]
        whole = text[:last] == text[r - 1 :]
        where = np.flatnonzero(whole)
        again = where[_seen_earlier(text[where], gram[where])]
        edge = np.zeros(len(hashed) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + r, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out[f"words_{r}"] = np.bincount(text[covered], minlength=n)
        out[f"chars_{r}"] = np.bincount(text[covered], length[covered], minlength=n).astype(np.int64)
    # lines: the words between two line ends (or the ends of the text)
    line = (np.cumsum(new_text | (kind == 3)))[start]
    first = np.flatnonzero(np.diff(line, prepend=-1) != 0)
    words = np.diff(np.append(first, len(start)))
    nth = np.arange(len(start)) - np.repeat(first, words)
    lined = np.add.reduceat(hashed * _powers(int(words.max()))[nth], first)
    chars = np.add.reduceat(length, first)
    again = _seen_earlier(text[first], lined)
    out["line_chars"] = np.bincount(text[first][again], chars[again], minlength=n).astype(np.int64)
    return out


def _passes(texts: list[str | None]):
    part, held, first = [], 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if part and held + size > PASS:
            yield first, part
            part, held, first = [], 0, i
        part.append(t)
        held += size
    if part:
        yield first, part


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, runs: tuple[int, ...] = RUNS) -> DataFrame:
    """key, n_words, share (of words in runs of run words seen earlier), char_share_n of each run length, line_share."""
    lengths = tuple(sorted({*runs, run}))
    kind = df.schema[key].dataType.simpleString()
    names = ["n_words", "n_chars", "line_chars", f"words_{run}", *(f"chars_{r}" for r in lengths)]

    def work(batches):
        for b in batches:
            got = [measure(part, lengths) for _, part in _passes(b.column(1).to_pylist())]
            columns = [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names=[key, *names])

    counted = df.select(key, text).mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"{k} bigint" for k in names))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        key, "n_words", share(f"words_{run}", "n_words").alias("share"),
        *[share(f"chars_{r}", "n_chars").alias(f"char_share_{r}") for r in lengths], share("line_chars", "n_chars").alias("line_share"),
    )


def found_documents(documents: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    return repetition(documents, runs=(RUN,)).where(F.col("share") >= least).select("doc_id")
