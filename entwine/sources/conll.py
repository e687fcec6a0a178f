"""Column-format annotation files: scan of their lines, directories and corpora of them, and their writer.

The scan is windows over numbered lines.  What a line needs to know of the lines before it (how many documents
began, how many blank lines there were, whether a document is open) is summed within chunks of lines, and the
chunks' totals are summed by file, so a file of any size is never one task's.

Defined results: rows outside begin and end lines are dropped; a document without an end line ends where the
next begins or with the file; rows with under four columns, or an index that is no whole number, are skipped
and don't end a sentence; a document without token rows doesn't exist; null lines count as blank ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import digits_to_ascii, stripped
from ..session import files

#: Lines that one task numbers together.
CHUNK = 1 << 18
#: File suffixes, and each corpus's folders by split; "{}" is the split itself.
SUFFIXES = (".conll", "_conll")
FOLDERS = {
    "mujadia_conll": {"train": "mujadia_conll/train", "dev": "mujadia_conll/development", "test": "mujadia_conll/test"},
    "onto_notes_archive": {"train": "onto_notes_archive/train", "dev": "onto_notes_archive/development", "test": "onto_notes_archive/test"},
    "litbank": {"train": "litbank_train", "dev": "litbank_val", "test": "litbank_test"},
}
LANGUAGES = {"hi": ("Hindi", ("hin_Deva",)), "ta": ("Tamil", ("tam_Taml",)), "bn": ("Bengali", ("ben_Beng",))}

SCHEMA = "file string, line_no int, raw string"


def scan_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file, doc_seq, doc_id, sent_idx, tok_pos, tok_idx, text, coref of numbered lines (file, line_no, raw)."""
    raw = F.coalesce("raw", F.lit(""))
    begins, ends = raw.startswith("#begin document"), raw.startswith("#end document")
    name = F.coalesce(F.nullif(F.regexp_extract(raw, r"^#begin document \((.+?)\)", 1), F.lit("")), _stem(F.col("file")))
    opened = F.struct(F.lit(True).alias("open"), name.alias("doc_id"))
    closed = F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("doc_id"))
    marker = F.when(begins, opened).when(ends, closed)
    rows = lines.select("file", "line_no", raw.alias("raw"), F.floor(F.col("line_no") / chunk).alias("chunk"), marker.alias("marker"))
    rows = rows.withColumn("begin", F.coalesce(F.col("marker.open"), F.lit(False)).cast("long")).withColumn("blank", (F.col("marker").isNull() & F.col("raw").rlike(r"(?U)^\s*$")).cast("long"))
    local = W.partitionBy("file", "chunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("l_begin", F.sum("begin").over(local)).withColumn("l_blank", F.sum("blank").over(local)).withColumn("l_marker", F.last("marker", ignorenulls=True).over(local))
    totals = rows.groupBy("file", "chunk").agg(F.sum("begin").alias("begin"), F.sum("blank").alias("blank"), F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("line_no"))).alias("marker"))
    before = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "file", "chunk", F.coalesce(F.sum("begin").over(before), F.lit(0)).alias("o_begin"), F.coalesce(F.sum("blank").over(before), F.lit(0)).alias("o_blank"), F.last("marker", ignorenulls=True).over(before).alias("o_marker")
    )
    placed = rows.join(offsets, ["file", "chunk"]).withColumn("open", F.coalesce("l_marker", "o_marker"))
    cols = F.split("raw", "\t")
    index = digits_to_ascii(stripped(F.get(cols, F.lit(2))))
    tokens = placed.where(F.col("marker").isNull() & F.col("open.open") & (F.col("blank") == 0)).select(
        "file", (F.col("o_begin") + F.col("l_begin") - 1).alias("doc_seq"), F.col("open.doc_id").alias("doc_id"), (F.col("o_blank") + F.col("l_blank")).alias("break"), "line_no",
        F.when(index.rlike(r"^[+-]?[0-9]+$"), index.try_cast("int")).alias("tok_idx"), F.get(cols, F.lit(3)).alias("text"),
        F.when(F.size(cols) > 4, F.element_at(cols, -1)).otherwise("-").alias("coref"),
    ).where("text is not null and tok_idx is not null")
    return tokens.select(
        "file", "doc_seq", "doc_id", (F.dense_rank().over(W.partitionBy("file", "doc_seq").orderBy("break")) - 1).alias("sent_idx"),
        (F.row_number().over(W.partitionBy("file", "doc_seq", "break").orderBy("line_no")) - 1).alias("tok_pos"), "tok_idx", "text", "coref",
    )


def _stem(path: Column) -> Column:
    """A file's name without folders and its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def first_delivery(lines: DataFrame, file: str = "file_name", key: str = "line_id") -> DataFrame:
    """file, line_no, raw of a table of delivered lines: of lines with one place the first by key counts."""
    nth = F.row_number().over(W.partitionBy(file, "line_no").orderBy(key))
    return lines.withColumn("__nth", nth).where("__nth = 1").select(F.col(file).alias("file"), "line_no", "raw")


def read_lines(spark: SparkSession, path: str, recursive: bool = False, name_holds: tuple[str, ...] = (), streaming: bool = False, skip_failing: bool = True) -> DataFrame:
    """file, line_no, raw of the annotation files of a folder; a missing folder has none.

    name_holds: parts of which a file's name must hold one; files are chosen before they are read.  skip_failing:
    files that can't be read are left out (unread_files names them); otherwise the read fails.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*conll").option("ignoreCorruptFiles", str(skip_failing).lower()).option("wholetext", "true")
    texts = reader.schema("value string").format("text").load(path) if streaming else reader.text(path, wholetext=True)
    wanted = _wanted(F.col("_metadata.file_name"), name_holds)
    lines = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")
    return texts.where(wanted).select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("line_no", "raw"))


def _wanted(name: Column, name_holds: tuple[str, ...]) -> Column:
    wanted = name.endswith(SUFFIXES[0]) | name.endswith(SUFFIXES[1])
    return wanted & _any([name.contains(x) for x in name_holds]) if name_holds else wanted


def unread_files(spark: SparkSession, path: str, recursive: bool = False, name_holds: tuple[str, ...] = ()) -> DataFrame:
    """file: the annotation files of a folder that can't be read; every one that can has a line at least."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "file string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*conll").load(path)
    listed = listed.select(F.col("path").alias("file")).where(_wanted(F.regexp_extract("file", r"([^/]*)$", 1), name_holds))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = read_lines(spark, path, recursive, name_holds).select(plain(F.col("file")).alias("__file")).distinct()
    return listed.join(read, plain(F.col("file")) == F.col("__file"), "left_anti")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = files(spark, path)
    return fs.exists(p)


def read_corpus(spark: SparkSession, root: str, corpus: str, split: str, language: str, fall_back: bool = False) -> DataFrame:
    """Tokens of one corpus, split and language, with corpus, split and lang.

    fall_back: where the split's folder is missing, the development files are read instead, under the name of
    the split asked for; that leaks development data, so it is off unless asked for.
    """
    folder = FOLDERS[corpus].get(split, f"litbank_{split}" if corpus == "litbank" else f"{corpus}/{split}")
    if fall_back and corpus == "onto_notes_archive" and not _exists(spark, f"{root}/{folder}"):
        folder = FOLDERS[corpus]["dev"]
    codes = () if corpus == "mujadia_conll" else LANGUAGES[language][1]
    lines = read_lines(spark, f"{root}/{folder}", recursive=corpus == "onto_notes_archive", name_holds=codes)
    return scan_lines(lines).withColumn("corpus", F.lit(corpus)).withColumn("split", F.lit(split)).withColumn("lang", F.lit(language))


def read_corpora(spark: SparkSession, root: str, split: str, languages: list[str] | None = None, fall_back: bool = False) -> tuple[DataFrame, list[str]]:
    """Tokens of all corpora of a split, and the languages asked for that are unknown (they are skipped)."""
    out, unknown = None, []
    for language in languages if languages is not None else list(LANGUAGES):
        if language not in LANGUAGES:
            unknown.append(language)
            continue
        for corpus in FOLDERS:
            if corpus == "mujadia_conll" and language != "hi":
                continue
            part = read_corpus(spark, root, corpus, split, language, fall_back)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = scan_lines(spark.createDataFrame([], SCHEMA)).select("*", *[F.lit("").alias(c) for c in ("corpus", "split", "lang")]).where("false")
    return out, unknown


def with_doc_key(tokens: DataFrame) -> DataFrame:
    """Tokens of files with a key of their own for each document: corpus, split, language, file and place in it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("corpus", "split", "lang", "file", "doc_seq") if c in tokens.columns]
    return tokens.withColumn("doc_key", F.xxhash64(F.concat_ws("\u0001", *parts)))


def conll_lines(tokens: DataFrame, predicted: DataFrame, documents: DataFrame, part: int = 0) -> DataFrame:
    """doc_key, line_no, line: each document as it would stand in a file, with predicted clusters in the last column.

    A span whose first or last token doesn't exist is left out; marks of one token follow each other in reading order of their spans.
    """
    index = F.coalesce("idx", "tok_pos") if "idx" in tokens.columns else F.col("tok_pos")
    token = F.struct("tok_pos", index.cast("string").alias("index"), "text")
    span = F.struct(*[F.col(c).cast("bigint").alias(c) for c in ("start_tok", "end_tok", "cluster_id")])
    none = "struct<tok_pos:int,index:string,text:string>", "struct<start_tok:bigint,end_tok:bigint,cluster_id:bigint>"
    t = tokens.select("doc_key", "sent_idx", token.cast(none[0]).alias("t"), F.lit(None).cast(none[1]).alias("m"))
    p = predicted.select("doc_key", "sent_idx", F.lit(None).cast(none[0]).alias("t"), span.alias("m"))
    # a union that is grouped: partitioned by document on both sides, it needs no shuffle
    sentence = t.unionByName(p).groupBy("doc_key", "sent_idx").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sort_array(F.collect_list("m")).alias("ms")).where(F.size("ts") > 0)
    known = F.filter("ms", lambda m: F.array_contains("ts.tok_pos", m["start_tok"].cast("int")) & F.array_contains("ts.tok_pos", m["end_tok"].cast("int")))

    def cell(x):
        n = lambda m: m["cluster_id"].cast("string")
        begins, ends = lambda m: m["start_tok"] == x["tok_pos"], lambda m: m["end_tok"] == x["tok_pos"]
        mark = lambda m: F.when(begins(m) & ends(m), F.concat(F.lit("("), n(m), F.lit(")"))).when(begins(m), F.concat(F.lit("("), n(m))).when(ends(m), F.concat(n(m), F.lit(")")))
        marks = F.array_compact(F.transform("known", mark))
        return F.when(F.size(marks) > 0, F.array_join(marks, "|")).otherwise("-")

    row = F.transform("ts", lambda x: F.concat_ws("\t", x["index"], x["text"], F.lit("_"), F.lit("_"), cell(x)))
    rows = sentence.withColumn("known", known).select("doc_key", "sent_idx", F.concat(row, F.array(F.lit(None).cast("string"))).alias("rows"))
    # each sentence knows how many lines stand before it, so no row holds a document
    order = W.partitionBy("doc_key").orderBy("sent_idx")
    done = F.coalesce(F.sum(F.size("rows")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    placed = rows.select("doc_key", "rows", done.alias("done"), (F.row_number().over(order) == 1).alias("first"), F.lead("sent_idx").over(order).isNull().alias("final"))
    placed = placed.join(documents.select("doc_key", "doc_id"), "doc_key")
    none = F.array().cast("array<string>")
    begin = F.when(F.col("first"), F.array(F.concat(F.lit("#begin document ("), "doc_id", F.lit(f"); part {part}")))).otherwise(none)
    end = F.when(F.col("final"), F.array(F.lit("#end document"))).otherwise(none)
    body = F.transform("rows", lambda r: F.when(r.isNull(), "").otherwise(F.concat("doc_id", F.lit(f"\t{part}\t"), r)))
    each = placed.select("doc_key", F.when(F.col("first"), 0).otherwise(F.col("done")).alias("at"), F.posexplode(F.concat(begin, body, end)).alias("i", "line"))
    return each.select("doc_key", (F.col("at") + F.col("i")).cast("int").alias("line_no"), "line")


def write_conll(lines: DataFrame, documents: DataFrame, path: str, separate: bool = False) -> None:
    """Writes documents as files, as many to a file as a partition has; or separate ones in folders named by key and id
    (what names can't hold is escaped), for few documents."""
    text = lines.groupBy("doc_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("value"))
    if not separate:
        text.select("value").write.mode("overwrite").text(path)
        return
    name = F.concat(F.col("doc_key").cast("string"), F.lit("-"), F.regexp_replace("doc_id", r"[^\w.-]", "_"))
    named = text.join(documents.select("doc_key", "doc_id"), "doc_key").select(name.alias("document"), "value")
    named.write.mode("overwrite").partitionBy("document").text(path)
