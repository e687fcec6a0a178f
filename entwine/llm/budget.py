"""Token totals by source, language and domain under an existing tokenizer (problem 5).

A ledger in a shared folder keeps three tables: the counts by content hash and tokenizer hash, the items of the
last snapshot with their slice and numbers, and the cube.  An update encodes only texts whose hash has no count yet,
compares the new snapshot with the last by item, and changes the cube by signed deltas: an item that
was removed or changed counts -1 times what it had, one that is new or changed +1 times what it has.

The ledger outlives its process.  Each update writes its tables into a folder of its own and then one manifest,
numbered and made only if no other has that number: a reader opens the manifest with the highest
number, so an update that dies leaves nothing behind that is read, and of two at once one fails.

Texts are never shuffled.  Hashes of texts are compared with the table of counts; what is new is marked in a table of
MARKS bits, whatever its amount, and a narrow pass over the texts encodes those that are marked.  Two texts on one bit
cost a needless encoding, no more: counts are made distinct by their hash.

A language is one code for each spelling: the known spellings first (letter case and blanks aside), then
the part before a hyphen or underscore; where the text's own script belongs to another language than
the one stated (or none is stated), the script decides, if one language alone has it.  Domains are compared without
case and blanks.

Defined results: null and empty texts have 0 tokens; a null source, unknown language and null domain are the
slices "unknown", "und" and "unknown"; an example repeated under another id counts again (its text isn't encoded again);
rows of one example_id in one snapshot are one example: the one created last.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .encode import TOKENIZERS, _utf8, encoder, slices

TOKENIZER = "byte_bpe_multi_50k"
SLICE = ("source", "language", "domain")
MEASURES = ("n_examples", "input_tokens", "output_tokens", "total_tokens")

#: Scripts that decide a language, as the first two bytes of their characters in UTF-8.
SCRIPT_BYTES = {"Deva": (0xE0, (0xA4, 0xA5)), "Beng": (0xE0, (0xA6, 0xA7)), "Taml": (0xE0, (0xAE, 0xAF))}
#: A script is the text's own if it has at least this share of the letters counted; markup is in Latin letters.
OWN_SHARE = 0.3


def folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))


def dominant_scripts(texts: pa.Array) -> pa.Array:
    """The script of each text by its UTF-8 bytes: an Indic one with OWN_SHARE of the letters, else Latin, else null."""
    at, data = _utf8(texts)
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[at])
    after = np.append(data[1:], 0) if len(data) else data
    names = [*SCRIPT_BYTES, "Latn"]
    lower = data | 0x20
    counts = [total((data == a) & ((after == b[0]) | (after == b[1]))) for a, b in SCRIPT_BYTES.values()]
    counts.append(total((lower >= 0x61) & (lower <= 0x7A)))
    table = np.stack(counts) if len(texts) else np.zeros((len(names), 0), np.int64)
    best = table[:-1].argmax(0)
    most, all_ = table[:-1].max(0, initial=0), table.sum(0)
    pick = np.where((most > 0) & (most >= OWN_SHARE * all_), best, np.where(table[-1] > 0, len(names) - 1, -1))
    return pa.array([names[i] if i >= 0 else None for i in pick.tolist()], pa.string())


def _count(texts: DataFrame, tokenizer: str, folder: str, wanted) -> DataFrame:
    """content, tokenizer, n_tokens and script of (content, slot, text); wanted: a broadcast table of bits by slot, or None for all."""

    def run(batches):
        e = encoder(tokenizer, folder)
        bits = None if wanted is None else np.unpackbits(wanted.value, bitorder="little").astype(bool)
        for b in batches:
            if bits is not None:
                b = b.filter(pa.array(bits[b.column(1).to_numpy()]))
            coded = pc.dictionary_encode(b.column(0))
            first = np.unique(coded.indices.to_numpy(zero_copy_only=False), return_index=True)[1]
            for part in slices(b.take(pa.array(np.sort(first))), 2):
                n = pa.array(e.counts(part.column(2)).astype(np.int64))
                mark = pa.array([e.hash] * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), mark, n, dominant_scripts(part.column(2))], names=["content", "tokenizer", "n_tokens", "script"])

    return texts.select("content", "slot", "text").mapInArrow(run, "content binary, tokenizer string, n_tokens bigint, script string")


def with_language(df: DataFrame, codes: DataFrame, stated: str = "stated", script: str = "script", language: str = "language") -> DataFrame:
    """df with one code for its stated language and the script of its text; codes are known spellings (code, lang, script), however many.

    Joins whose sides the optimizer sizes.  A spelling of several languages counts for the first by code.
    """
    known = codes.where("code is not null and lang is not null").select(folded(F.col("code")).alias("code"), "lang", "script")
    by_code = known.groupBy("code").agg(F.min("lang").alias("lang"))
    of_lang = known.groupBy("lang").agg(F.min("script").alias("of"))
    by_script = of_lang.where("of is not null").groupBy("of").agg(F.min("lang").alias("__by_script"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    said = folded(F.col(stated))
    df = df.drop(language).withColumn("__full", said).withColumn("__part", F.regexp_extract(said, r"^([^_-]+)", 1)).withColumn("__script", F.col(script))
    for c, lang in (("__full", "__l1"), ("__part", "__l2")):
        df = df.join(by_code.select(F.col("code").alias(c), F.col("lang").alias(lang)), c, "left")
    df = df.withColumn("__lang", F.coalesce("__l1", "__l2"))
    df = df.join(of_lang.select(F.col("lang").alias("__lang"), F.col("of").alias("__of")), "__lang", "left")
    df = df.join(by_script.withColumnRenamed("of", "__script"), "__script", "left")
    decided = F.coalesce(F.when(F.col("__script").isNull() | (F.col("__of") == F.col("__script")), F.col("__lang")), F.col("__by_script"), F.col("__lang"), F.lit("und"))
    return df.withColumn(language, decided).drop("__full", "__part", "__script", "__l1", "__l2", "__lang", "__of", "__by_script")


#: Bits of the table of texts without a count: what is collected and broadcast is at most 512 kB.
MARKS = 1 << 22


class TokenLedger:
    """The counts, items and cubes in one folder, for one tokenizer; each update leaves a new version of them."""

    def __init__(self, spark: SparkSession, folder: str, codes: DataFrame, tokenizer: str = TOKENIZER, tokenizers: str = TOKENIZERS):
        self.spark, self.folder, self.codes, self.tokenizer, self.tokenizers = spark, folder.rstrip("/"), codes, tokenizer, tokenizers
        self.mark = encoder(tokenizer, tokenizers).hash
        self.version, self.state = self._open()

    _COUNTS = "content binary, tokenizer string, n_tokens bigint, script string"
    _ITEMS = "example_id bigint, source string, language string, domain string, input_tokens bigint, output_tokens bigint"
    _CUBE = "source string, language string, domain string, " + ", ".join(f"{m} bigint" for m in MEASURES)

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> tuple[int, dict]:
        """The last manifest: the tables of counts, and for each tokenizer its items and cube."""
        jvm, path, fs = self._files()
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        # a manifest is written under another name and renamed, so one with its name is whole
        numbers = {int(p.getName().split(".")[0]): p for p in found if re.fullmatch(r"\d+\.json", p.getName())}
        if not numbers:
            return 0, {"counts": [], "of": {}}
        last = max(numbers)
        stream = fs.open(numbers[last])
        try:
            return last, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        jvm, path, fs = self._files()
        Path = jvm.org.apache.hadoop.fs.Path
        draft, final = Path(path, f"{uuid.uuid4().hex}.draft"), Path(path, f"{self.version + 1:09d}.json")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another update made version {self.version + 1} of the ledger in {self.folder}")
        self.version, self.state = self.version + 1, state

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.state["of"].get(self.mark, {}).get(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """content, tokenizer, n_tokens, script of every text ever counted, by this or another tokenizer."""
        if not self.state["counts"]:
            return self.spark.createDataFrame([], self._COUNTS)
        return self.spark.read.schema(self._COUNTS).parquet(*[f"{self.folder}/{at}" for at in self.state["counts"]])

    def cube(self) -> DataFrame:
        return self._table("cube", self._CUBE)

    def encoded(self) -> int:
        """Texts that the last update of this folder had no count for."""
        last = self.state.get("last")
        return self.spark.read.schema(self._COUNTS).parquet(f"{self.folder}/{last}").count() if last else 0

    def _unseen(self, contents: DataFrame, seen: DataFrame):
        """A table of bits by slot of the texts that have no count yet; None if none has, as all are wanted then."""
        if not self.state["counts"]:
            return None
        new = contents.join(seen.select("content"), "content", "left_anti")
        blocks = new.groupBy((F.col("slot") / 64).cast("int").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits")).toPandas()
        table = np.zeros(MARKS // 64, np.int64)
        table[blocks["block"].to_numpy(np.int64)] = blocks["bits"].to_numpy(np.int64)
        return self.spark.sparkContext.broadcast(table.view(np.uint8))

    def update(self, snapshot: DataFrame) -> DataFrame:
        """Takes in a whole snapshot of the examples; returns the new cube."""
        digest = lambda c: F.when(F.length(c) > 0, F.unhex(F.md5(F.col(c).cast("binary"))))
        hashed = snapshot.select(
            F.col("example_id").cast("bigint").alias("example_id"), "source", F.col("language").alias("stated"), "domain", "created_at",
            F.col("masked_input").alias("ti"), F.col("output").alias("to"), digest("masked_input").alias("hi"), digest("output").alias("ho"),
        )
        slot = lambda h: F.pmod(F.xxhash64(h), F.lit(MARKS)).cast("int")
        both = F.array(*[F.struct(F.col(h).alias("content"), slot(h).alias("slot"), F.col(t).alias("text")) for h, t in (("hi", "ti"), ("ho", "to"))])
        texts = hashed.select(F.explode(both).alias("t")).select("t.*").where("content is not null")
        seen = self.counts().where(F.col("tokenizer") == self.mark)
        wanted = self._unseen(texts.select("content", "slot").distinct(), seen)
        new = _count(texts, self.tokenizer, self.tokenizers, wanted).dropDuplicates(["content"])
        if wanted is not None:  # texts on a bit of an unseen one may have a count
            new = new.join(seen.select("content"), "content", "left_anti")
        at = f"update-{self.version + 1}-{uuid.uuid4().hex[:12]}"
        new.write.parquet(f"{self.folder}/{at}/counts")
        added = self.spark.read.schema(self._COUNTS).parquet(f"{self.folder}/{at}/counts")
        counts = seen.unionByName(added)

        latest = hashed.drop("ti", "to").groupBy("example_id").agg(F.max_by(F.struct("source", "stated", "domain", "hi", "ho"), F.struct("created_at", "hi", "ho")).alias("x")).select("example_id", "x.*")
        one = lambda h, n: counts.select(F.col("content").alias(h), F.col("n_tokens").alias(f"{n}_tokens"), F.col("script").alias(f"{n}_script"))
        joined = latest.join(one("hi", "input"), "hi", "left").join(one("ho", "output"), "ho", "left").withColumn("script", F.coalesce("input_script", "output_script"))
        items = with_language(joined, self.codes).select(
            "example_id", F.coalesce(F.trim("source"), F.lit("unknown")).alias("source"), "language", F.coalesce(folded(F.col("domain")), F.lit("unknown")).alias("domain"),
            F.coalesce("input_tokens", F.lit(0)).cast("bigint").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("bigint").alias("output_tokens"),
        )
        items.write.parquet(f"{self.folder}/{at}/items")
        now = self.spark.read.schema(self._ITEMS).parquet(f"{self.folder}/{at}/items")
        deltas = self._deltas(self._table("items", self._ITEMS), now)
        cube = self.cube().unionByName(deltas).groupBy(*SLICE).agg(*[F.sum(m).alias(m) for m in MEASURES]).where("n_examples > 0")
        cube.write.parquet(f"{self.folder}/{at}/cube")
        of = self.state["of"] | {self.mark: {"tokenizer": self.tokenizer, "items": f"{at}/items", "cube": f"{at}/cube"}}
        self._commit({"counts": [*self.state["counts"], f"{at}/counts"], "last": f"{at}/counts", "of": of})
        return self.cube()

    @staticmethod
    def _deltas(before: DataFrame, now: DataFrame) -> DataFrame:
        """What the slices gain and lose; unchanged items leave no delta."""
        kept = [c for c in now.columns if c != "example_id"]
        change = before.select("example_id", F.struct(*kept).alias("b")).join(now.select("example_id", F.struct(*kept).alias("n")), "example_id", "full").where(~F.col("b").eqNullSafe(F.col("n")))
        signed = change.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("b").alias("x")), F.struct(F.lit(1).alias("sign"), F.col("n").alias("x")))).alias("d")).select("d.sign", "d.x.*").where("source is not null")
        return signed.groupBy(*SLICE).agg(
            F.sum("sign").cast("bigint").alias("n_examples"), F.sum(F.col("sign") * F.col("input_tokens")).alias("input_tokens"), F.sum(F.col("sign") * F.col("output_tokens")).alias("output_tokens"),
            F.sum(F.col("sign") * (F.col("input_tokens") + F.col("output_tokens"))).alias("total_tokens"),
        )


def token_budget(examples: DataFrame, codes: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """The cube of one snapshot, by a new ledger in the shared folder."""
    spark = examples.sparkSession
    return TokenLedger(spark, scratch(spark, "ledger"), codes, tokenizer, folder).update(examples)


def two_snapshots(examples: DataFrame, codes: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """The cube after two updates of one ledger, opened anew for the second.

    The first snapshot has every example under a second id as well, without its domain and with its input as output.  The
    second is the table as it is: it removes half of the examples, changes text and slice of the others, and
    encodes the outputs alone.  The cube is that of the table.
    """
    spark = examples.sparkSession
    at = scratch(spark, "ledger")
    early = examples.withColumn("domain", F.lit(None).cast("string")).withColumn("output", F.col("masked_input"))
    TokenLedger(spark, at, codes, tokenizer, folder).update(early.unionByName(early.withColumn("example_id", -1 - F.col("example_id"))))
    return TokenLedger(spark, at, codes, tokenizer, folder).update(examples)
