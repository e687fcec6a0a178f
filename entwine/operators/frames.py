"""Frames: sentences packed under a budget of tokens, and consecutive pairs of frames as masked texts.

Packing is sequential (a frame's start depends on the one before it), so it is a fold over the sizes
of a document's sentences, in the JVM; only sizes and starts of frames are ever together in one row, 16 bytes a
sentence.  A document whose sentences fit into one frame is packed with the first budget of budget,
budget/2, ... 1 under its size, which gives two frames or more; one sentence alone stays one frame and
has no pair.

Words and mentions stay in rows of one sentence: each gets the number of its frame by a running window, the
sentences of a frame are grouped, and a frame meets the next one by `lead`.  So the work grows in
proportion to a document's length, and no row holds a whole document's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import MID, head_word
from .mentions import beside_sentences

BUDGET = 256
#: Items that a growing array in a fold holds before they are set aside, so that appending doesn't copy all.
PART = 128


def budgets(budget: int) -> list[int]:
    """The budget and its halves down to 1."""
    out = [max(1, budget)]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return out


def _grown(parts: Column, last: Column, item: Column) -> tuple[Column, Column]:
    """An array of arrays and its last array, with one more item."""
    full = F.size(last) >= PART
    return F.when(full, F.array_append(parts, last)).otherwise(parts), F.when(full, F.array(item)).otherwise(F.array_append(last, item))


def frame_starts(sizes: Column, budget: Column) -> Column:
    """Places in an array of sizes at which greedy frames begin."""
    zero = F.struct(F.array().cast("array<array<int>>").alias("parts"), F.array(F.lit(0)).alias("last"), F.lit(0).cast("bigint").alias("used"))

    def step(acc, x):
        over = (acc["used"] > 0) & (acc["used"] + x["n"] > budget)
        parts, last = _grown(acc["parts"], acc["last"], x["i"])
        return F.struct(
            F.when(over, parts).otherwise(acc["parts"]).alias("parts"), F.when(over, last).otherwise(acc["last"]).alias("last"),
            F.when(over, x["n"].cast("bigint")).otherwise(acc["used"] + x["n"]).alias("used"),
        )

    return F.aggregate(F.transform(sizes, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), zero, step, lambda a: F.flatten(F.array_append(a["parts"], a["last"])))


def _with_starts(sentences: DataFrame, budget: int, halve: bool = True) -> DataFrame:
    """doc_key, s (sentences in order with n_tokens), the budget used and the starts of the frames."""
    docs = sentences.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "n_tokens"))).alias("s"), F.sum("n_tokens").alias("total"))
    series = F.array(*[F.lit(b) for b in budgets(budget)])
    used = F.coalesce(F.try_element_at(F.filter(series, lambda b: b < F.col("total")), F.lit(1)), F.lit(1)) if halve else F.lit(budget)
    docs = docs.withColumn("budget", F.when(F.size("s") < 2, F.lit(budget)).otherwise(used).cast("int"))
    return docs.withColumn("starts", F.when(F.size("s") < 2, F.array(F.lit(0))).otherwise(frame_starts(F.col("s.n_tokens"), F.col("budget"))))


def pack(sentences: DataFrame, budget: int = BUDGET, halve: bool = True) -> DataFrame:
    """doc_key, frame_idx, sent_indices, n_tokens, budget, n_frames of each frame."""
    docs = _with_starts(sentences, budget, halve)
    end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("s"))
    each = docs.select("doc_key", "budget", F.size("starts").alias("n_frames"), F.posexplode(F.transform("starts", lambda a, i: F.slice("s", a + 1, end(i) - a))).alias("frame_idx", "f"))
    return each.select("doc_key", "frame_idx", F.col("f.sent_idx").alias("sent_indices"), F.aggregate("f.n_tokens", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_tokens"), "budget", "n_frames")


def framed(rows: DataFrame, sizes: DataFrame, budget: int = BUDGET, halve: bool = True) -> DataFrame:
    """rows (one for each sentence) with frame_idx and n_frames; sizes has doc_key, sent_idx, n_tokens of the same sentences.

    The frames' first sentences and the rows are one union in the partitioning by document; a running window
    hands each number on to the rows after it.
    """
    docs = _with_starts(sizes, budget, halve).select("doc_key", F.size("starts").alias("n_frames"), F.posexplode(F.transform("starts", lambda a: F.get("s.sent_idx", a))).alias("frame_idx", "sent_idx"))
    row = F.struct(*[c for c in rows.columns if c not in ("doc_key", "sent_idx")])
    kind = rows.select(row.alias("r")).schema["r"].dataType
    both = rows.select("doc_key", "sent_idx", F.lit(None).cast("struct<f:int,n:int>").alias("__f"), row.alias("__r")).unionByName(
        docs.select("doc_key", "sent_idx", F.struct(F.col("frame_idx").alias("f"), F.col("n_frames").alias("n")).alias("__f"), F.lit(None).cast(kind).alias("__r"))
    )
    before = W.partitionBy("doc_key").orderBy("sent_idx", F.col("__r").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("__f", F.last("__f", ignorenulls=True).over(before)).where("__r is not null").select("doc_key", "sent_idx", F.col("__f.f").alias("frame_idx"), F.col("__f.n").alias("n_frames"), "__r.*")


def outermost(found: Column, n_tokens: Column) -> Column:
    """The mentions of one sentence that are rendered: from the left, the longest that starts at or after the end
    of the last one taken.  One that crosses or lies in a taken one is dropped and blocks nothing; a zero
    mention takes no room.  found: ARRAY<STRUCT<start_tok, end_tok, mention_ord, cluster_id, is_zero>>."""

    def sortable(m):
        fields = {"s": m["start_tok"], "l": m["start_tok"] - m["end_tok"], "o": m["mention_ord"], "e": m["end_tok"], "c": m["cluster_id"], "z": m["is_zero"]}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    ordered = F.sort_array(F.transform(found, sortable))
    none = F.slice(ordered, 1, 0)
    empty = F.struct(F.filter(F.array(none), lambda x: F.lit(False)).alias("parts"), none.alias("last"), F.lit(0).alias("free"))

    def step(acc, m):
        take = (m["s"] >= acc["free"]) & (m["s"] < n_tokens) & (m["e"] >= m["s"])
        parts, last = _grown(acc["parts"], acc["last"], m)
        return F.struct(
            F.when(take, parts).otherwise(acc["parts"]).alias("parts"), F.when(take, last).otherwise(acc["last"]).alias("last"),
            F.when(take & ~m["z"], m["e"] + 1).otherwise(acc["free"]).alias("free"),
        )

    chosen = F.aggregate(ordered, empty, step, lambda a: F.flatten(F.array_append(a["parts"], a["last"])))
    return F.when(F.size(found) == 0, none).otherwise(chosen)


def _texts(words: Column, a: Column, b: Column) -> Column:
    """Words from a to before b, joined."""
    return F.array_join(F.slice(words, a + 1, F.greatest(F.least(b, F.size(words)) - a, F.lit(0))), " ")


def selected(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """Each sentence with its words and the mentions that are rendered in it, chosen once for both of its pairs."""
    return with_taken(beside_sentences(sentences, found.select("doc_key", "sent_idx", "start_tok", "end_tok", "mention_ord", "cluster_id", "is_zero")))


def with_taken(rows: DataFrame) -> DataFrame:
    """doc_key, sent_idx, words, n_tokens, taken of sentences that have their mentions in `found`."""
    return rows.select("doc_key", "sent_idx", "words", "n_tokens", outermost(F.col("found"), F.col("n_tokens")).alias("taken"))


def pieces(words: Column, taken: Column) -> Column:
    """A sentence with its mentions marked, as the texts between the places where labels go: one more than there are mentions.

    taken must be a column, not an expression: each piece looks at its neighbours in it.
    """
    after = lambda m: F.when(m["z"], m["s"]).otherwise(F.least(m["e"] + 1, F.size(words)))
    begun = lambda i: F.when(i == 0, 0).otherwise(after(F.get(taken, i - 1)))

    def before(m, i):
        mark = F.when(m["z"], "</z>").otherwise(F.concat(F.lit("<m>"), _texts(words, m["s"], m["e"] + 1), F.lit("</m>")))
        # an empty word is a word too: only where there are none is there no blank
        between = F.when(begun(i) < m["s"], F.concat(_texts(words, begun(i), m["s"]), F.lit(" "))).otherwise("")
        return F.concat(F.when(i == 0, "").otherwise(" "), between, mark)

    end = after(F.element_at(taken, -1))
    tail = F.when(end < F.size(words), F.concat(F.lit(" "), _texts(words, end, F.size(words)))).otherwise("")
    return F.when(F.size(taken) == 0, F.array(F.array_join(words, " "))).otherwise(F.concat(F.transform(taken, before), F.array(tail)))


def pairs(sentences: DataFrame, found: DataFrame, budget: int = BUDGET, skip_empty: bool = True, least_mentions: int = 1) -> DataFrame:
    """Consecutive frame pairs of each document as masked input and expected output (see pairs_of)."""
    rows = beside_sentences(sentences, found.select("doc_key", "sent_idx", "start_tok", "end_tok", "mention_ord", "cluster_id", "is_zero"))
    return pairs_of(rows, sentences, budget, skip_empty, least_mentions)


def pairs_of(rows: DataFrame, sizes: DataFrame, budget: int = BUDGET, skip_empty: bool = True, least_mentions: int = 1) -> DataFrame:
    """Frame pairs of sentences that have their mentions in `found`; sizes: the same sentences' doc_key, sent_idx, n_tokens.

    Local numbers count the clusters by their first mention in the pair, before frame first.  With
    skip_empty pairs of fewer than least_mentions mentions are left out; follows is the pair_idx of the document's kept
    pair before each (-1 for its first), heads the head words of its mentions.
    """
    taken = with_taken(rows).withColumn("pieces", pieces(F.col("words"), F.col("taken")))
    mask = lambda m: F.when(m["z"], "@MASK").otherwise("#MASK")

    def labelled(s, label):
        """A sentence's text; label(mention) is what stands after its mark."""
        rest = F.slice(s["pieces"], 2, F.greatest(F.size(s["pieces"]) - 1, F.lit(0)))
        return F.concat(F.get(s["pieces"], F.lit(0)), F.array_join(F.zip_with(s["taken"], rest, lambda m, p: F.concat(label(m), p)), ""))

    heads = F.transform("taken", lambda m: head_word(F.col("words"), m["s"], m["e"]))
    whole = taken.withColumn("heads", heads).withColumn("masked", labelled({"pieces": F.col("pieces"), "taken": F.col("taken")}, mask)).drop("words", "n_tokens")
    numbered_rows = framed(whole, sizes.select("doc_key", "sent_idx", "n_tokens"), budget).where("n_frames > 1")
    frame = numbered_rows.groupBy("doc_key", "frame_idx").agg(F.max("n_frames").alias("n_frames"), F.sort_array(F.collect_list(F.struct("sent_idx", "taken", "pieces", "masked", "heads"))).alias("before"))
    order = W.partitionBy("doc_key").orderBy("frame_idx")
    pair = frame.withColumn("after", F.lead("before").over(order)).where("frame_idx < n_frames - 1").withColumnRenamed("frame_idx", "pair_idx")

    def flat(side):
        def mention(s, m):
            return F.struct(s["sent_idx"].alias("sent_idx"), m["s"].alias("start_tok"), m["e"].alias("end_tok"), m["c"].alias("cluster_id"), m["z"].alias("is_zero"))

        return F.flatten(F.transform(side, lambda s: F.transform(s["taken"], lambda m: mention(s, m))))

    pair = pair.withColumn("bm", flat(F.col("before"))).withColumn("am", flat(F.col("after")))
    if skip_empty:
        pair = pair.where(F.size("bm") + F.size("am") >= max(1, least_mentions))
    pair = pair.withColumn("follows", F.coalesce(F.lag("pair_idx").over(W.partitionBy("doc_key").orderBy("pair_idx")), F.lit(-1)))
    pair = pair.withColumn("order", F.array_distinct(F.concat("bm.cluster_id", "am.cluster_id")))
    local = lambda c: (F.array_position("order", c) - 1).cast("int")

    def numbered(side):
        before_number = ("sent_idx", "start_tok", "end_tok", "cluster_id")
        return F.transform(side, lambda m: F.struct(*[m[c].alias(c) for c in before_number], local(m["cluster_id"]).alias("local_no"), m["is_zero"].alias("is_zero")))

    number = lambda m: F.concat(F.lit("#"), local(m["c"]).cast("string"))
    text = lambda side: F.array_join(F.transform(side, lambda s: labelled(s, number)), " ")
    both = lambda f: F.concat(f("before"), F.lit(MID), f("after"))
    return pair.select(
        "doc_key", "pair_idx", both(lambda c: F.array_join(F.col(f"{c}.masked"), " ")).alias("masked_input"), both(lambda c: text(F.col(c))).alias("output"),
        numbered(F.col("bm")).alias("before_mentions"), numbered(F.col("am")).alias("after_mentions"),
        F.col("before.sent_idx").alias("before_sent_indices"), F.col("after.sent_idx").alias("after_sent_indices"), "follows", F.flatten(F.concat("before.heads", "after.heads")).alias("heads"),
    )
