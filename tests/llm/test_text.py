"""Consistent forms, token ids, repetition: small cases, other implementations, odd tables."""

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entwine.llm import budget, confusables, encode, repetition

pytestmark = pytest.mark.usefixtures("spark")

FORMS = [
    ("ɑpple", "apple"), ("ᴀbc", "abc"), ("Ⓐbc", "Abc"), ("ℋello", "Hello"), ("ⅷ", "viii"), ("①", "1"), ("Ｔシャツ", "Tシャツ"), ("Тシャツ", "Tシャツ"), ("µm", "μm"), ("ﺍﺏ", "اب"),
    ("Ｈｏｕｓｅ", "House"), ("１２３", "123"), ("wén", "wén"), ("ज़ूर", "ज़ूर"), ("কো", "কো"), ("லொ", "லொ"), ("का​", "का"), ("f​o", "fo"), ("फि\xadक्ष", "फिक्ष"),
    ("\xa0का　", "का"), ("अाम", "आम"), ("দু:খ", "দুঃখ"), ("प्रात:", "प्रातः"), ("hеavy", "heavy"), ("Карoвеха", "Каровеха"), ("sοme", "some"), ("‌।", "।"), ("शाम﻿\xa0", "शाम"),
    ("क‍ष", "कष"), ("क्‍‍ष", "क्‍ष"), ("a　b", "a b"), ("​", ""), (" Ситраван", "Ситраван"), ("lоѕt", "lost"), ("ﬁsh", "fish"), ("𝐇ouse", "House"),
]
KEPT = ["House", "आम", "Каровеха", "Νικορέλα", "ñandu", "naïve", "१२३", "௧", "क्‍ष", "ক্‌ভ", "👩‍🌾", "👨‍👩‍👧", "❤️", "", "।", ":", "10:30", "a:b", "東京タワー", "x" * 50_000, "का" * 20_000]


@pytest.mark.parametrize("text, form", FORMS)
def test_forms(text, form):
    got, issues = confusables.resolve(text)
    assert got == form and issues & ~confusables.WHOLE_SCRIPT
    assert confusables.resolve(form)[0] == form


def test_words_of_several_scripts():
    """Writing systems of several scripts are no mix; a mix that no script can hold keeps its main script."""
    assert confusables.resolve("東京タワーへ")[1] == 0 and confusables.resolve("한국漢字")[1] == 0
    assert confusables.resolve("μm")[0] == confusables.resolve("µm")[0] and confusables.resolve("Tシャツ")[1] & confusables.MIXED
    assert confusables.resolve("соре") == ("соре", confusables.WHOLE_SCRIPT)
    assert confusables.resolve("соре", "Latn") == ("cope", confusables.WHOLE_SCRIPT) and confusables.resolve("соре", "Deva")[0] == "соре"
    assert confusables.resolve("осаж", "Latn") == ("осаж", 0)


def test_tokens_in_the_script_of_their_document(spark):
    t = spark.createDataFrame([(1, 1, "соре"), (2, 2, "соре"), (3, 9, "соре"), (4, None, "соре"), (5, 1, "дом"), (6, 1, None), (7, 2, "Ｔ")], "token_id long, doc_key long, text string")
    d = spark.createDataFrame([(1, "EN "), (2, "ru"), (3, None)], "doc_key long, language string")
    c = spark.createDataFrame([("en", "en", "English", "Latn"), ("ru", "ru", "Russian", "Cyrl")], "code string, lang string, name string, script string")
    got = {r["token_id"]: r["consistent"] for r in confusables.consistent_tokens(t, d, c).collect()}
    assert got == {1: "cope", 2: "соре", 3: "соре", 4: "соре", 5: "дом", 6: None, 7: "T"}


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    got, issues = confusables.resolve(text)
    assert got == text and not issues & ~confusables.WHOLE_SCRIPT


def test_mixed_words_without_a_spelling_are_reported():
    assert confusables.resolve("zж")[1] & confusables.UNRESOLVED
    assert confusables.resolve("оса")[1] == confusables.WHOLE_SCRIPT and confusables.resolve("осаж")[1] == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aеoοkк ​‍क्ा्अ:é́e１．Ａ\xa0　👩🌾কো-"), max_size=12))
def test_forms_are_stable(text):
    form, issues = confusables.resolve(text)
    assert confusables.resolve(form)[0] == form
    assert unicodedata.normalize("NFC", form) == form and form == form.strip()
    assert (form == text) or issues & ~confusables.WHOLE_SCRIPT


def test_tokens_table(spark):
    rows = [(i, t, "old", 1) for i, (t, _) in enumerate(FORMS)] + [(100 + i, t, None, 2) for i, t in enumerate([None, "", "a", "a"])]
    df = spark.createDataFrame(rows, "token_id long, text string, consistent string, issues int")
    got = {r["token_id"]: r for r in confusables.consistent_text(df).collect()}
    assert [got[i]["consistent"] for i in range(len(FORMS))] == [f for _, f in FORMS]
    assert got[100]["consistent"] is None and got[100]["issues"] == [] and got[[t for t, _ in FORMS].index("１２３")]["issues"] == ["width"]
    assert sorted(r[0] for r in confusables.found_tokens(df).collect()) == list(range(len(FORMS)))
    assert confusables.found_tokens(df.limit(0)).count() == 0


ALPHABET = ["'s", "'re", "'", " ", "  ", "\n", "\t", "\xa0", "　", "a", "b", "é", "क", "का", "।", "1", "!", "?", "🎉", "<|endoftext|>", "́", "中", "'ll", "\r\n", "\x85", "\x1c", "​", "\x00", " the", "ing"]


def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_like_the_library():
    rng = random.Random(7)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(5000)] + ["का" * 3000, "中" * 2000, "!'s" * 99, " " * 3000, "", "x" * 30_000]
    e = encode.encoder()
    ids, ends = e.encode(pa.array(texts))
    want = [x.ids for x in hf().encode_batch(texts, add_special_tokens=False)]
    at = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert e.counts(pa.array(texts)).tolist() == list(map(len, want))


def test_certain_cuts_are_outside_all_tokens():
    e = encode.encoder()
    text = "दूसरा ख़िढ़ीआम 's पर don't बैठकर 東京 naïve"
    data = text.encode()
    import numpy as np

    for p in e.certain_cuts(np.frombuffer(data, np.uint8)).tolist():
        left, right = data[:p].decode(), data[p:].decode()
        assert e.encoding.encode_ordinary(left) + e.encoding.encode_ordinary(right) == e.encoding.encode_ordinary(text)


def test_ids_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "the <|endoftext|>", 5), (4, "the", 5), (4, "the", 5)], "doc_id long, text string, ids int")
    got = encode.encode_texts(df).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got)[:2] == [(1, []), (2, [])] and len(got) == 5
    assert hf().decode(next(r["ids"] for r in got if r["doc_id"] == 3), skip_special_tokens=False) == "the <|endoftext|>"
    assert encode.encode_texts(df.limit(0)).count() == 0
    sliced = pa.array(["zz", None, "the", ""]).slice(1)
    assert encode.encoder().counts(sliced).tolist() == [0, 1, 0]
    counted = encode.count_tokens(df, keep_text=True)
    assert counted.columns == ["doc_id", "text", "ids", "n_tokens"] and counted.where("doc_id = 4").first()["n_tokens"] == 1
    with pytest.raises(ValueError):
        encode.encoder("../x")


def plain_share(text, run=6):
    words = "".join(c if unicodedata.category(c)[0] in "LM" or c.isspace() else "" for c in text.lower()).split()
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - run + 1):
        gram = tuple(words[i : i + run])
        if gram in seen:
            covered[i : i + run] = [True] * run
        seen.add(gram)
    return (sum(covered) / len(words) if words else 0.0), len(words)


def test_repetition_like_a_loop():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "b", "c1", "1", "।", "का", "\n", "d,"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = repetition.measure(texts, (6,))
    for i, t in enumerate(texts):
        share, n = plain_share(t)
        assert got["n_words"][i] == n and got["words_6"][i] == round(share * n)


def test_repetition_of_odd_tables(spark):
    once = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n1 2 ।"), (4, once), (5, f"{once} {once}"), (6, f"{once}\n{once.upper()}!"), (7, "x " * 100_000), (8, f"{once} other")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, share string")
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert [got[i]["share"] for i in (1, 2, 3, 4, 8)] == [0.0] * 5 and got[1]["n_words"] == 0
    assert got[5]["share"] == pytest.approx(0.5) and got[6]["line_share"] == pytest.approx(0.5) and got[7]["share"] == pytest.approx(1, abs=1e-4)
    assert sorted(r[0] for r in repetition.found_documents(df).collect()) == [5, 6, 7]
    assert repetition.found_documents(df.limit(0)).count() == 0


EXAMPLES = "example_id long, source string, language string, domain string, masked_input string, output string, created_at timestamp, total_tokens int"
CODES = [("hi", "hi", "Hindi", "Deva"), ("Hindi", "hi", "Hindi", "Deva"), ("bn", "bn", "Bengali", "Beng"), ("en", "en", "English", "Latn")]


def examples_of(spark, rows):
    return spark.createDataFrame([(*r[:6], None, 0) for r in rows], EXAMPLES)


def cube_of(df):
    return {(r["source"], r["language"], r["domain"]): (r["n_examples"], r["input_tokens"], r["output_tokens"], r["total_tokens"]) for r in df.collect()}


def test_ledger(spark, tmp_path):
    codes = spark.createDataFrame(CODES, "code string, lang string, name string, script string")
    n = lambda t: int(encode.encoder(budget.TOKENIZER).counts(pa.array([t]))[0])
    ledger = budget.TokenLedger(spark, str(tmp_path), codes)
    first = [(1, "a", " HINDI", "News ", "पास खो", "आम"), (2, "a", "hi", "news", "पास खो", None), (3, "b", None, None, "the house", ""), (4, "b", "bn", "x", "the <m>house</m>#MASK", "the")]
    got = cube_of(ledger.update(examples_of(spark, first)))
    p, o = n("पास खो"), n("आम")
    h, m = n("the house"), n("the <m>house</m>#MASK")
    assert got == {("a", "hi", "news"): (2, 2 * p, o, 2 * p + o), ("b", "en", "unknown"): (1, h, 0, h), ("b", "en", "x"): (1, m, n("the"), m + n("the"))}
    assert ledger.encoded() == 5
    # one is removed, one changes its text, one its slice, one is new with a known text
    second = [(1, "a", "hi", "news", "पास खो", "आम"), (3, "b", None, None, "the house", "आम"), (4, "c", "bn", "x", "the <m>house</m>#MASK", "the"), (5, "b", "en", None, "the house", None)]
    reopened = budget.TokenLedger(spark, str(tmp_path), codes)
    assert cube_of(reopened.cube()) == got
    again = cube_of(reopened.update(examples_of(spark, second)))
    with pytest.raises(RuntimeError):
        ledger.update(examples_of(spark, second))  # its version is no longer the last
    ledger = budget.TokenLedger(spark, str(tmp_path), codes)
    assert again == {("a", "hi", "news"): (1, p, o, p + o), ("b", "en", "unknown"): (2, 2 * h, o, 2 * h + o), ("c", "en", "x"): (1, m, n("the"), m + n("the"))}
    assert ledger.encoded() == 0
    assert cube_of(ledger.update(examples_of(spark, second + second[:1]))) == again
    assert cube_of(ledger.update(examples_of(spark, []))) == {}
    fresh = budget.TokenLedger(spark, str(tmp_path / "new"), codes)
    assert cube_of(fresh.update(examples_of(spark, second))) == again
    # a text that is new is encoded, and nothing else; another tokenizer counts anew in the same folder
    more = second + [(7, "b", "en", None, "an unseen house", "आम")]
    fresh.update(examples_of(spark, more))
    assert fresh.encoded() == 1
    other = budget.TokenLedger(spark, str(tmp_path / "new"), codes, tokenizer="byte_bpe_50k")
    assert cube_of(other.cube()) == {} and sum(r[0] for r in cube_of(other.update(examples_of(spark, more))).values()) == 5
    assert cube_of(budget.TokenLedger(spark, str(tmp_path / "new"), codes).cube()) == cube_of(fresh.cube())
    assert cube_of(budget.two_snapshots(examples_of(spark, more), codes)) == cube_of(fresh.cube())


def test_languages(spark):
    codes = spark.createDataFrame(CODES, "code string, lang string, name string, script string")
    rows = [("hi-IN", "Deva", "hi"), ("hin", "Deva", "hi"), (" bn\xa0", "Beng", "bn"), ("bn", "Deva", "hi"), ("xx", None, "und"), (None, None, "und"), (None, "Latn", "en"), ("Hindi", None, "hi"), ("en", "Thai", "en")]
    df = spark.createDataFrame(rows, "said string, script string, want string")
    named = lambda codes: budget.with_language(df, codes, "said").collect()
    assert all(r["language"] == r["want"] for r in named(codes)) and len(named(codes)) == len(rows)
    assert {r["language"] for r in named(codes.limit(0))} == {"und"}
    # however many spellings there are, none is lost
    many = spark.createDataFrame([(f"Spelling {i}", "hi", "Hindi", "Deva") for i in range(1500)] + [("bn", "bn", "Bengali", "Beng")], "code string, lang string, name string, script string")
    said = spark.createDataFrame([(f"spelling {i}", None) for i in range(1500)], "said string, script string")
    assert {r["language"] for r in budget.with_language(said, many, "said").collect()} == {"hi"}
    assert budget.dominant_scripts(pa.array(["पास <m>", "the", None, "", "123", "ক the"])).to_pylist() == ["Deva", "Latn", None, None, None, "Latn"]
