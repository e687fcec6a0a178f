"""Prediction of the local numbers of a pair's mentions: built-in rules as columns, models in Python workers.

The text protocol is the same for all: a masked text has places, a prediction is one number for each, and the
k-th mention of a pair gets the k-th number, or k where there are fewer numbers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill_masks, head_word, mask_count

LARGEST = 200
#: Tokens that a model may give for one number.
DIGITS = 4


class Decoder(Protocol):
    """A language model that continues a text; one is made in each Python worker."""

    def start(self, prompt: str) -> None:
        """Begins a new text, keeping its end if it is too long."""

    def extend(self, text: str) -> None:
        """Appends text."""

    def next_token(self) -> str:
        """The most likely next token, which is appended if it is taken."""


def controlled(decoder: Decoder, prompt: str, masked: str, largest: int = LARGEST) -> list[int]:
    """One number for each place of a masked text; the decoder only ever adds digits."""

    pieces = re.split(r"[#@]MASK", masked)
    if len(pieces) == 1:
        return []
    decoder.start(prompt + pieces[0] + "#")
    out = []
    for piece in pieces[1:]:
        digits = ""
        for _ in range(DIGITS):
            token = decoder.next_token().strip()
            if not token[:1].isdigit():
                break
            digits += token
        number = re.match(r"\d+", digits)
        out.append(min(int(number[0]), largest) if number else 0)
        decoder.extend(piece + "#")
    return out


class TokenDecoder:
    """A Decoder of a tokenizer and a model: ids are what the model sees, the text is what the protocol sees.

    encode and decode are the tokenizer's; following(ids) gives the model's most likely next id.  A prompt over longest
    tokens (the model's length less the digits of one number) loses its beginning, so that the latest context is kept.
    A following that keeps its own cache of ids seen sees each text as the last one with more at its end.
    """

    def __init__(self, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], following: Callable[[list[int]], int], longest: int = 4096 - DIGITS):
        self.encode, self.decode, self.following, self.longest = encode, decode, following, longest
        self.ids: list[int] = []
        self.offered: int | None = None

    def start(self, prompt: str) -> None:
        self.ids, self.offered = list(self.encode(prompt))[-self.longest :], None

    def extend(self, text: str) -> None:
        # a token that was offered and is no digit was never taken
        if self.offered is not None and not self.decode([self.offered]).strip()[:1].isdigit():
            self.offered = None
        self._take()
        self.ids += self.encode(text)

    def next_token(self) -> str:
        self._take()
        self.offered = int(self.following(self.ids))
        return self.decode([self.offered])

    def _take(self) -> None:
        if self.offered is not None:
            self.ids.append(self.offered)
            self.offered = None


def causal_model(path: str, longest: int = 4096) -> Callable[[], TokenDecoder]:
    """A factory for model_numbers: a causal language model and its tokenizer in a local folder, by the transformers package where it is installed."""

    def factory() -> TokenDecoder:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        tokenizer, model = AutoTokenizer.from_pretrained(path), AutoModelForCausalLM.from_pretrained(path).eval()
        held: dict = {"ids": [], "cache": None}

        def following(ids: list[int]) -> int:
            kept = held["ids"] if ids[: len(held["ids"])] == held["ids"] and len(ids) > len(held["ids"]) else []
            with torch.no_grad():
                out = model(input_ids=torch.tensor([ids[len(kept) :]]), past_key_values=held["cache"] if kept else None, use_cache=True)
            held["ids"], held["cache"] = list(ids), out.past_key_values
            return int(out.logits[0, -1].argmax())

        return TokenDecoder(lambda text: tokenizer.encode(text, add_special_tokens=False), lambda ids: tokenizer.decode(ids, skip_special_tokens=True), following, longest - DIGITS)

    return factory


def model_numbers(pairs: DataFrame, factory: Callable[[], Decoder], prompt: Callable[[str, str], str] | None = None, largest: int = LARGEST) -> DataFrame:
    """pairs (with instruction and masked_input) and numbers ARRAY<INT> by a model, partition by partition."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name != "numbers") + ", numbers array<int>"
    kept = [c for c in pairs.columns if c != "numbers"]

    def run(batches: Iterator):
        decoder = factory()
        for pdf in batches:
            ask = prompt or (lambda instruction, text: f"{instruction}\n{text}\n")
            pdf["numbers"] = [controlled(decoder, ask(i or "", m or ""), m or "", largest) for i, m in zip(pdf["instruction"], pdf["masked_input"])]
            yield pdf

    return pairs.select(*kept).mapInPandas(run, schema)


def _all(column: str = "local_no") -> Column:
    return F.concat(F.col("before_mentions"), F.col("after_mentions"))[column]


def gold() -> Column:
    """The numbers that the annotation has."""
    return _all()


def singleton() -> Column:
    """A number of its own for each mention."""
    return F.transform(_all(), lambda n, i: i)


def noisy(rate: float, seed: int = 42, key: str = "doc_key") -> Column:
    """Gold numbers of which a share, chosen by hash, is replaced by the next number."""
    def change(n, i):
        bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("pair_idx").cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("bigint")
        return F.when(bucket < int(rate * 16**6), n + 1).otherwise(n)

    return F.transform(_all(), change)


def head_match(pairs: DataFrame) -> DataFrame:
    """numbers by the head words of the pair's mentions (its heads): the same head has the same number, by first appearance."""
    order = F.array_distinct("heads")
    return pairs.withColumn("numbers", F.transform("heads", lambda h: (F.array_position(order, h) - 1).cast("int")))


def attach(pairs: DataFrame, numbers: Column | str = "numbers") -> DataFrame:
    """pairs as results: mentions with predicted_local_no, and output_text."""
    n = F.col(numbers) if isinstance(numbers, str) else numbers
    given = pairs.withColumn("__n", F.when(mask_count(F.col("masked_input")) > 0, n).otherwise(F.array().cast("array<int>")))
    first = F.size("before_mentions")

    def numbered(side, shift):
        return F.transform(side, lambda m, i: m.withField("predicted_local_no", F.coalesce(F.get("__n", i + shift), i + shift).cast("int")))

    after, before = numbered(F.col("after_mentions"), first), numbered(F.col("before_mentions"), F.lit(0))
    text = fill_masks(F.col("masked_input"), F.col("__n"))
    return given.withColumns({"output_text": text, "after_mentions": after, "before_mentions": before}).drop("__n")


def mask_mismatch(pairs: DataFrame) -> DataFrame:
    """Pairs whose text has other than one place for each mention: a mark in the source text shifts the numbers."""
    return pairs.where(mask_count(F.col("masked_input")) != F.size("before_mentions") + F.size("after_mentions")).select("doc_key", "pair_idx")
