"""One consistent written form for equal looking words (problem 2).

Every token is resolved in five steps:

1. full-width, half-width, circled, styled and presentation forms of letters and numbers, ligatures and small
   capitals are folded to the letters they stand for;
2. invisible characters are removed, except joiners right after a virama and the joiners, selectors
   and tags that hold an emoji sequence together;
3. blanks of any kind become one plain space, and none is left at either end;
4. the text is composed as NFC has it, and sign sequences that only look like the usual spelling
   (vowel letter A with a vowel sign, a colon for a visarga) get the usual spelling;
5. the script sets of the letters of each word are intersected, as Unicode's security mechanisms (UTS 39) define it: by
   Script_Extensions, with the Japanese, Korean and Bopomofo writing systems as sets of their own.  An empty intersection is
   a mixed word: the script in which the *whole* word can be spelled with look-alike letters, and which
   holds most of its letters already, is chosen and the word is spelled in it.  Where no script can hold all of it,
   each foreign letter that looks like one of the word's main script, or else of the Latin script, is spelled so, and the
   rest is kept.  A word wholly in one script that could be spelled in another as well (whole-script confusable) is
   reported; it is respelled where the script of its context is known to be the other one.  Letters that are not
   recommended for use and look like one of their own script that is (as U+0251 like a) get that one.

Scripts, confusables and recommended characters of all scripts are Unicode's data as the ICU library has it that
Spark ships; the driver reads them once, and workers get them as one table (under 1 MB, whatever the data).

Defined results: a null text stays null and is never reported; an empty text stays empty; a text of
blanks and invisible characters becomes empty; texts of any length are handled whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------------

#: Zero-width non-joiner and joiner.
JOINERS = "\u200c\u200d"

#: Look-alike letters beside Unicode's, one column for each script; "." where a script has none.
LOOKALIKES = {
    "Latn": "A B C E H I J K M N O P S T X Y Z a c d e h i j k o p q s u v w x y Ë ë Ï ï",
    "Cyrl": "А В С Е Н І Ј К М . О Р Ѕ Т Х Ү . а с ԁ е һ і ј к о р ԛ ѕ . ѵ ԝ х у Ё ё Ї ї",
    "Grek": "Α Β . Ε Η Ι . Κ Μ Ν Ο Ρ . Τ Χ Υ Ζ α . . . . ι . κ ο ρ . . υ ν . . γ . . Ϊ ϊ",
}

#: Vowel letter A and a sign, and the one letter that they look like.
VOWEL_SPELLINGS = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॅ": "ॲ", "आे": "ओ", "आै": "औ", "एे": "ऐ",
    "অা": "আ", "અા": "આ", "ਅਾ": "ਆ", "ଅା": "ଆ", "ಅಾ": "ಆ", "அா": "ஆ",
}

#: Bits of the reported issues.
WIDTH, INVISIBLE, BLANK, UNCOMPOSED, SPELLING, MIXED, WHOLE_SCRIPT, UNRESOLVED = (1 << i for i in range(8))
ISSUES = ("width", "invisible", "blank", "uncomposed", "spelling", "mixed_script", "whole_script", "unresolved_mix")

# -------------------------------------------------------------------------------------------------

#: Writing systems of several scripts, by script.
AUGMENTED = {"Hani": ("Hanb", "Jpan", "Kore"), "Hira": ("Jpan",), "Kana": ("Jpan",), "Hang": ("Kore",), "Bopo": ("Hanb",)}
#: Kinds of compatibility forms that look like what they stand for.
FOLDED_KINDS = ("<font>", "<circle>", "<wide>", "<narrow>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")

_VOWELS = re.compile("|".join(map(re.escape, VOWEL_SPELLINGS)))
#: A colon that stands where only a visarga can: after a letter or sign of a script that has one.
_COLON = re.compile("(?<=[ऄ-ह़-ौंक़-ॡ])(?:[:꞉ː∶])|(?<=[অ-হ়-ৌংড়-ৡ])(?:[:꞉ː∶])")
_WORDS = re.compile(r"[^\W\d_]+", re.UNICODE)
_PLAIN = re.compile(r"[!-~]*\Z")


def _folded(ch: str) -> str | None:
    """What a compatibility form of a letter or number stands for; None where it stands for itself."""
    kind, _, _ = unicodedata.decomposition(ch).partition(" ")
    o = ord(ch)
    if 0xFF01 <= o <= 0xFFEE:
        plain = unicodedata.normalize("NFKC", ch)
        return plain if plain != ch else None
    if kind in FOLDED_KINDS and not 0x3130 <= o <= 0x318F:
        plain = unicodedata.normalize("NFKC", ch)
        if plain != ch and all(c.isalnum() for c in plain):
            return plain
    name = unicodedata.name(ch, "") if 0x0262 <= o <= 0x02B6 or 0x1D00 <= o <= 0x1D22 else ""
    small = name.removeprefix("LATIN LETTER SMALL CAPITAL ")
    return small.lower() if len(small) == 1 and name else None


class Unicode:
    """Script sets and look-alikes of all characters, and what a worker has resolved with them so far."""

    def __init__(self, scripts: list[tuple[int, int, tuple[str, ...]]], prototypes: dict[str, str], unusual: list[tuple[int, int]]):
        self.data = scripts, prototypes, unusual
        self.starts = [a for a, _, _ in scripts]
        self.known: dict[str, frozenset[str] | None] = {}
        self.folds = {c: f for c in map(chr, (*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F1A0))) if (f := _folded(c)) and not "\ud800" <= c <= "\udfff"}
        self.fold = re.compile("[" + "".join(map(re.escape, self.folds)) + "]")
        #: by script: the letter of another script, or an unusual one of this, to its own
        self.to: dict[str, dict[str, str]] = {}
        columns = {script: row.split() for script, row in LOOKALIKES.items()}
        for script, column in columns.items():
            for other in columns.values():
                for a, own in zip(other, column):
                    if a != "." and own != "." and a != own:
                        self.to.setdefault(script, {})[a] = own
        classes: dict[str, list[str]] = {}
        for c, p in prototypes.items():
            classes.setdefault(p, []).append(c)
        odd = lambda c: any(a <= ord(c) <= b for a, b in unusual)
        odd_of = {c: odd(c) for c in prototypes}
        for p, members in classes.items():
            members = sorted({*members, *([p] if len(p) == 1 else [])})
            if len(members) < 2:
                continue
            by_script: dict[str, list[str]] = {}
            for c in members:
                for script in self.scripts(c) or ():
                    if c.isalpha():
                        by_script.setdefault(script, []).append(c)
            for script, own in by_script.items():
                usual = [c for c in own if not odd_of.get(c, odd(c))]
                for c in members:
                    held = self.scripts(c)
                    if not usual or not c.isalpha() or held is None or (script in held and not odd_of.get(c, odd(c))):
                        continue
                    best = min(usual, key=lambda x: (x.isupper() != c.isupper(), ord(x)))
                    if best != c:
                        self.to.setdefault(script, {}).setdefault(c, best)
        #: what is odd in the only script that it has: respelled without a mix
        self.own = {c: to[c] for script, to in self.to.items() for c in to if self.scripts(c) is not None and script in self.scripts(c)}
        self.memo: dict[tuple[str, str | None], tuple[str, int]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("memo", "known")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state, memo={}, known={})

    @staticmethod
    def read(spark: SparkSession) -> Unicode:
        """The data of the ICU library on the driver."""
        jvm = spark.sparkContext._jvm
        icu = jvm.com.ibm.icu

        def ranges(pattern: str) -> list[tuple[int, int]]:
            # complementing twice makes it write its characters instead of the pattern it was made from
            text = icu.text.UnicodeSet(pattern).complement().complement().toPattern(True)
            got = [int(x or y, 16) if x or y else ord(z) for x, y, z in re.findall(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\?([^\[\]\\])", text.replace("-", "\0"))]
            out: list[tuple[int, int]] = []
            until = False
            for o in got:
                if o == 0:
                    until = True
                elif until:
                    out[-1], until = (out[-1][0], o), False
                else:
                    out.append((o, o))
            return out

        sets: dict[int, list[str]] = {}
        edges: set[int] = set()
        spans: list[tuple[int, int, str]] = []
        for i in range(icu.lang.UCharacter.getIntPropertyMaxValue(icu.lang.UProperty.SCRIPT) + 1):
            name = icu.lang.UScript.getShortName(i)
            if name in ("Zyyy", "Zinh", "Zzzz"):
                continue
            for a, b in ranges(f"[:scx={name}:]"):
                spans.append((a, b, name))
                edges |= {a, b + 1}
        cuts = sorted(edges)
        at = {o: i for i, o in enumerate(cuts)}
        for a, b, name in spans:
            for i in range(at[a], at[b + 1]):
                sets.setdefault(i, []).append(name)
        scripts = [(cuts[i], cuts[i + 1] - 1, tuple(sorted({*names, *(x for n in names for x in AUGMENTED.get(n, ()))}))) for i, names in sorted(sets.items())]
        builder = getattr(icu.text, "SpoofChecker$Builder")()
        checker = builder.build()
        # ideographs and syllables are composed or unlike each other; planes above have nothing else
        every = map(chr, (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)))
        letters = [c for c in every if unicodedata.category(c)[0] in "LN" and unicodedata.normalize("NFD", c) == c]
        shapes = checker.getSkeleton("\n".join(letters)).split("\n")
        prototypes = {c: p for c, p in zip(letters, shapes) if p} if len(shapes) == len(letters) else {}
        if not prototypes:
            raise RuntimeError("the confusables of the ICU library can't be read")
        common = Counter(prototypes.values())
        prototypes = {c: p for c, p in prototypes.items() if common[p] > 1}
        usual = ranges(icu.text.SpoofChecker.RECOMMENDED.toPattern(True))
        unusual, o = [], 0
        for a, b in sorted(usual):
            if a > o:
                unusual.append((o, a - 1))
            o = b + 1
        return Unicode(scripts, prototypes, [*unusual, (o, sys.maxunicode)])

    def scripts(self, ch: str) -> frozenset[str] | None:
        """Scripts and writing systems in which a letter or mark may stand; None: in any."""
        got = self.known.get(ch, 0)
        if got == 0:
            i = bisect_right(self.starts, ord(ch)) - 1
            got = frozenset(self.data[0][i][2]) if i >= 0 and ord(ch) <= self.data[0][i][1] and ch not in JOINERS else None
            self.known[ch] = got
        return got

    def spelled(self, word: str, script: str) -> str | None:
        """A word with every letter in one script; None where one has no look-alike there."""
        to = self.to.get(script, {})
        out = []
        for ch in word:
            held = self.scripts(ch)
            if held is None or script in held:
                out.append(ch)
            elif ch in to:
                out.append(to[ch])
            else:
                return None
        return "".join(out)

    def respell(self, word: str, context: str | None = None) -> tuple[str, int]:
        """A word in one script where that is possible, and what was found."""
        sets = [s for s in map(self.scripts, word) if s is not None]
        if not sets:
            return word, 0
        issues = 0
        if any(ch in self.own for ch in word):
            usual = "".join(self.own.get(ch, ch) for ch in word)
            word, issues = usual, SPELLING
        shared = frozenset.intersection(*sets)
        if shared:
            if shared & _PLAIN_SCRIPTS or not any(ch in to for to in self.to.values() for ch in word[:1] if not ch.isascii()):
                return word, issues
            others = [script for script in _CASED if script not in shared and self.spelled(word, script) is not None]
            if not others:
                return word, issues
            if context in others and context not in shared:
                return self.spelled(word, context), issues | WHOLE_SCRIPT
            return word, issues | WHOLE_SCRIPT
        held = Counter(script for s in sets for script in s)
        order = sorted(held, key=lambda s: (-held[s], s != "Latn", s))
        for script in order:
            if (form := self.spelled(word, script)) is not None:
                return form, issues | MIXED
        # equal looking mixes become equal: what has no place in the main script is spelled in Latin letters where it can be
        to = self.to.get("Latn", {}) | self.to.get(order[0], {})
        form = "".join(ch if (s := self.scripts(ch)) is None or order[0] in s else to.get(ch, ch) for ch in word)
        return form, issues | MIXED | UNRESOLVED

    def resolve(self, text: str | None, context: str | None = None) -> tuple[str | None, int]:
        """The consistent form of a text and the issues of the text as it stood; context: the script of what it stands in."""
        if text is None or _PLAIN.match(text):
            return text, 0
        issues, form = 0, text
        if self.fold.search(form):
            wide = any("\uff01" <= c <= "\uffee" for c in form)
            form = self.fold.sub(lambda m: self.folds[m[0]], form)
            issues = (WIDTH if wide else 0) | (SPELLING if any(c in self.folds for c in text if not "\uff01" <= c <= "\uffee") else 0)
        if any(map(_ignorable, form)):
            seen = _drop_invisible(form)
            issues |= INVISIBLE * (seen != form)
            form = seen
        if any(map(str.isspace, form)):
            spaced = re.sub(r"\s", " ", form).strip(" ")
            issues |= BLANK * (spaced != form)
            form = spaced
        composed = unicodedata.normalize("NFC", form)
        issues |= UNCOMPOSED * (composed != form)
        spelled = _COLON.sub(lambda m: "ः" if m.string[m.start() - 1] < "ঀ" else "ঃ", composed)
        spelled = _VOWELS.sub(lambda m: VOWEL_SPELLINGS[m[0]], spelled)
        issues |= SPELLING * (spelled != composed)
        parts, at = [], 0
        for start, end in _letter_runs(spelled):
            word, found = self.respell(spelled[start:end], context)
            issues |= found
            parts += spelled[at:start], word
            at = end
        form = "".join(parts) + spelled[at:]
        return (unicodedata.normalize("NFC", form) if issues & (MIXED | SPELLING | WHOLE_SCRIPT) else form), issues

    def remembered(self, text: str | None, context: str | None = None) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        got = self.memo.get((text, context))
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.resolve(text, context)
            if len(text) < 200:
                self.memo[text, context] = got
        return got


#: Scripts whose words aren't looked at for whole-script confusables: their letters are the usual ones.
_PLAIN_SCRIPTS = frozenset({"Latn"})
#: Scripts in which a word of another may be spelled as a whole.
_CASED = ("Latn", "Cyrl", "Grek", "Armn", "Copt")
#: Texts that a worker remembers; emptied beyond, so that memory stays bounded.
MEMO = 400_000

_read: dict[str, tuple[Unicode, object]] = {}


def unicode_data(spark: SparkSession):
    """Unicode's data as a broadcast, read once for each session."""
    key = spark.sparkContext.applicationId
    if key not in _read:
        data = Unicode.read(spark)
        _read[key] = data, spark.sparkContext.broadcast(data)
    return _read[key][1]


def resolve(text: str | None, context: str | None = None) -> tuple[str | None, int]:
    """resolve of the active session's data, on the driver."""
    spark = SparkSession.getActiveSession()
    unicode_data(spark)
    return _read[spark.sparkContext.applicationId][0].resolve(text, context)


def _is_emoji(ch: str) -> bool:
    o = ord(ch)
    return 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or 0x2190 <= o <= 0x2BFF and unicodedata.category(ch) == "So"


def _is_emoji_part(ch: str) -> bool:
    return _is_emoji(ch) or ch in "\ufe0e\ufe0f\u20e3" or 0x1F3FB <= ord(ch) <= 0x1F3FF or 0xE0020 <= ord(ch) <= 0xE007F


def _ignorable(ch: str) -> bool:
    o = ord(ch)
    return (
        unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace()
        or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF
    )


def _drop_invisible(text: str) -> str:
    out: list[str] = []
    for i, ch in enumerate(text):
        if _ignorable(ch):
            before = out[-1] if out else ""
            if ch in JOINERS and before and unicodedata.combining(before) == 9:
                out.append(ch)
            elif ch == JOINERS[1] and before and _is_emoji_part(before) and i + 1 < len(text) and _is_emoji(text[i + 1]):
                out.append(ch)
            elif ch in "\ufe0e\ufe0f" and before and (_is_emoji(before) or before in "#*0123456789©®™‼⁉ℹ"):
                out.append(ch)
            elif 0xE0020 <= ord(ch) <= 0xE007F and before and (_is_emoji(before) or 0xE0020 <= ord(before) <= 0xE007F):
                out.append(ch)
        else:
            out.append(ch)
    return "".join(out)


def _letter_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of letters and marks (joiners included)."""
    start = None
    for i, ch in enumerate(text):
        if ch.isalpha() or unicodedata.category(ch)[0] == "M" or ch in JOINERS:
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(text)


def consistent_text(df: DataFrame, text: str = "text", form: str = "consistent", issues: str = "issues", only_inconsistent: bool = False, context: str | None = None) -> DataFrame:
    """df with the consistent form of a text column and an array of what was found in it.

    A narrow map: no shuffle, each Arrow batch resolves its distinct texts only.  only_inconsistent
    keeps the rows whose text isn't in the consistent form.  context: a column with the script of what each text stands
    in, if it is known.  Null text: null form, no issues.  The two new columns replace columns of the same names.
    """
    shared = unicode_data(df.sparkSession)
    kept = df.drop(*[c for c in (form, issues, "__bits") if c in df.columns and c not in (text, context)])
    schema = T.StructType([*kept.schema.fields, T.StructField(form, T.StringType()), T.StructField("__bits", T.IntegerType())])

    def run(batches):
        known = shared.value
        for b in batches:
            texts = pc.dictionary_encode(b.column(b.schema.get_field_index(text)))
            if context is None:
                got, place = [known.remembered(x) for x in texts.dictionary.to_pylist()], texts.indices
            else:
                rows = zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index(context)).to_pylist())
                got, place = [known.remembered(*r) for r in rows], pa.array(range(b.num_rows), pa.int32())
            forms, bits = pc.take(pa.array([f for f, _ in got], pa.string()), place), pc.take(pa.array([i for _, i in got], pa.int32()), place)
            out = pa.RecordBatch.from_arrays([*b.columns, forms, pc.fill_null(bits, 0)], names=[*b.schema.names, form, "__bits"])
            if only_inconsistent:
                out = out.filter(pc.not_equal(pc.bit_wise_and(out.column(out.num_columns - 1), ~WHOLE_SCRIPT & 0xFF), 0))
            yield out

    found = kept.mapInArrow(run, schema)
    names = F.array_compact(F.array(*[F.when(F.col("__bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(ISSUES)]))
    return found.withColumn(issues, names).drop("__bits")


def may_be_another_script(text: Column) -> Column:
    """Texts with letters of the scripts whose words may be spelled in Latin letters as a whole."""
    return F.coalesce(text.rlike(r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCoptic}]"), F.lit(False))


def consistent_tokens(tokens: DataFrame, documents: DataFrame, codes: DataFrame) -> DataFrame:
    """token_id, consistent, issues of every token, whole-script look-alikes spelled in the script of their document's language.

    Only tokens that may be such look-alikes meet the documents; the others are mapped where they are.
    """
    known = codes.where("code is not null and script is not null").groupBy(F.lower(F.trim("code")).alias("code")).agg(F.min("script").alias("context"))
    of = documents.where("doc_key is not null").select("doc_key", F.lower(F.trim("language")).alias("code")).join(known, "code").groupBy("doc_key").agg(F.min("context").alias("context"))
    rows = tokens.select("token_id", "doc_key", "text")
    suspect = may_be_another_script(F.col("text"))
    plain = consistent_text(rows.where(~suspect).select("token_id", "text"))
    placed = consistent_text(rows.where(suspect).join(of, "doc_key", "left").select("token_id", "text", "context"), context="context").drop("context")
    return plain.unionByName(placed).select("token_id", "consistent", "issues")


def found_tokens(tokens: DataFrame) -> DataFrame:
    """token_id of the rows whose text isn't in the consistent form."""
    return consistent_text(tokens.select("token_id", "text"), only_inconsistent=True).select("token_id")
