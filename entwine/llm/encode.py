"""Token ids of texts by a byte-level BPE tokenizer, with forced boundaries (problem 7).

A pair of neighbouring bytes that occurs inside no token of the vocabulary can be inside no result of
any merge, so the text may be cut there: merging inside one pre-token never crosses it.  Cutting must
not change how the text falls into pre-tokens either, so a cut is taken only at the start of a
character, never after a blank (a run of blanks keeps or gives up its last one by what follows) and
never before an apostrophe (it could begin a contraction).  The blank before a word always is such a
cut; fragments longer than LONG bytes are cut at every certain cut within them.  Fragments
are encoded independently, each distinct one once while a worker remembers it, and concatenated.

Defined results: null and empty texts have an empty list (count 0); strings that look like special
tokens are ordinary text; no text is shortened.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public vocabulary files lie; a parameter of everything here.
TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
#: A fragment over so many bytes is cut at all certain cuts within it.
LONG = 48
#: Bytes of text that are encoded at once, whatever the size of an Arrow batch.
PASS = 4_000_000
#: Distinct fragments, and ids, that a worker remembers.
MEMO = 600_000

# Fixed value: the pattern that splits text into pre-tokens for these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """A vocabulary, its certain cuts and the fragments encoded so far."""

    def __init__(self, name: str, folder: str):
        import tiktoken

        data = open(f"{folder}/{name}.tiktoken", "rb").read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.hash = hashlib.blake2b(data + PATTERN.encode(), digest_size=8).hexdigest()
        self.encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: can_join[a, b]: byte b follows byte a inside some token
        self.can_join = np.zeros((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.can_join[a, b] = True
        self.memo: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.memo.clear()
        self.parts: list[np.ndarray] = []
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def certain_cuts(self, data: np.ndarray) -> np.ndarray:
        """Places p so that data[:p] and data[p:] can be encoded independently; data is UTF-8."""
        a, b = data[:-1], data[1:]
        ok = ~self.can_join[a, b] & ((b & 0xC0) != 0x80) & (b != 0x27)
        ok &= (a != 0x20) & ((a < 0x09) | (a > 0x0D)) & ((a < 0x1C) | (a > 0x1F))
        at = np.flatnonzero(ok & (a >= 0x80))
        if len(at):  # blanks of several bytes: U+0085 U+00A0 U+1680 U+2000-200A U+2028 U+2029 U+202F U+205F U+3000
            z, y = data[at].astype(np.int32), data[np.maximum(at - 1, 0)].astype(np.int32)
            x = data[np.maximum(at - 2, 0)].astype(np.int32)
            code = (x << 16) | (y << 8) | z
            blank = (y == 0xC2) & ((z == 0x85) | (z == 0xA0))
            blank |= (code == 0xE19A80) | (code == 0xE3_8080) | (code == 0xE2819F)
            blank |= ((code >= 0xE28080) & (code <= 0xE2808A)) | (code == 0xE280A8) | (code == 0xE280A9) | (code == 0xE280AF)
            ok[at[blank]] = False
        return np.flatnonzero(ok) + 1

    def fragments(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of the fragments of texts that lie end to end in data; ends holds where each text ends."""
        certain = self.certain_cuts(data) if len(data) > 1 else np.zeros(0, np.int64)
        forced = np.unique(np.concatenate([np.zeros(1, np.int64), ends[ends < len(data)]]))
        blank = certain[data[certain] == 0x20]
        cuts = np.union1d(forced, blank)
        length = np.diff(np.append(cuts, len(data)))
        inside = length[np.searchsorted(cuts, certain, "right") - 1] > LONG
        return np.union1d(cuts, certain[inside]) if inside.any() else cuts

    def _index(self, fragment: bytes) -> int:
        """The fragment's place among those encoded; encodes it if it is new."""
        got = len(self.start) - 1 + len(self.parts)
        self.parts.append(np.array(self.encoding.encode_ordinary(fragment.decode("utf-8", "replace")), np.int32))
        self.memo[fragment] = got
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's ids end; null is as empty."""
        at, data = _utf8(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.memo) > MEMO or len(self.ids) > 8 * MEMO:
            self._forget()
        cuts = self.fragments(data, at[1:])
        raw = data.tobytes()
        memo, new = self.memo, self._index
        edges = np.append(cuts, len(raw)).tolist()
        index = np.fromiter(
            (memo[f] if (f := raw[a:b]) in memo else new(f) for a, b in zip(edges, edges[1:])), np.int64, len(cuts)
        )
        if self.parts:
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(p) for p in self.parts])])
            self.ids = np.concatenate([self.ids, *self.parts])
            self.parts = []
        size = self.start[index + 1] - self.start[index]
        end = np.cumsum(size)
        flat = np.arange(int(end[-1])) + np.repeat(self.start[index] - (end - size), size)
        ids = self.ids[flat]
        # a text's ids end where the last fragment before its end does
        done = np.append(0, end)
        return ids, done[np.searchsorted(cuts, at[1:], "left")]

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.encode(texts)[1], prepend=0)


@lru_cache(maxsize=4)
def encoder(name: str = DEFAULT, folder: str = TOKENIZERS) -> Encoder:
    """One for each Python worker."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"no tokenizer name: {name!r}")
    return Encoder(name, folder)


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts (and the last ends), and the bytes of all, without copying the texts."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] else np.zeros(0, np.uint8)
    at = at - at[0]
    if texts.null_count:  # bytes may lie under a null
        size = np.diff(at) * ~texts.is_null().to_numpy(zero_copy_only=False)
        if int(size.sum()) != len(data):
            keep = np.repeat(size > 0, np.diff(at))
            data, at = data[keep], np.append(0, np.cumsum(size))
    return at, data


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most PASS bytes of one text column (a longer text is a part of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, end = 0, np.cumsum(size)
    while first < batch.num_rows:
        done = int(end[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(end, done + PASS, "right")))
        yield batch.slice(first, last - first)
        first = last


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """The key and the ids of each text, in a narrow map: no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        e = encoder(tokenizer, folder)
        for b in (part for whole in batches for part in slices(whole, 1)):
            out, ends = e.encode(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, ids])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "n_tokens", tokenizer: str = DEFAULT, folder: str = TOKENIZERS, keep_text: bool = False) -> DataFrame:
    """df with the number of tokens of a text column, and without the text unless keep_text."""
    kept = [c for c in df.columns if c != tokens and (keep_text or c != text)]
    read = kept if text in kept else [*kept, text]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(tokens, T.IntegerType())])

    def run(batches):
        e = encoder(tokenizer, folder)
        for b in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text))):
            n = pa.array(e.counts(b.column(b.schema.get_field_index(text))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], n], names=[*kept, tokens])

    return df.select(*read).mapInArrow(run, schema)
