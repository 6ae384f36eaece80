import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tocsin.functions import text as tx
from tocsin.functions.romanize import romanize_latin, romanize_malayalam
from tocsin.operators.labels import add_clean_text
from tocsin.plans.oracles import clean as clean_sql
from tests.compare import duck


def one(spark, value, fn):
    schema = "t string"
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("t"))).first()[0]


def many(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("RT @a: #KeralaFloods &amp; x", "keralafloods and x"),
        ("http://a RT b", "rt b"),
        ("RThttp://a b", "b"),
        ("https://x.y", ""),
        ("a &lt;b&gt;", "a b"),
        ("see www.x.org now", "see now"),
        ("rt keep", "rt keep"),
        ("#@user tag", "tag"),
        ("a#b @#c", "ab c"),
        ("don't - stop, ok?!", "don't - stop, ok?!"),
        ("tab\there and there", "tab here and there"),
        ("½ ² café \U0001f600", "½ ² café"),
        ("പ്രളയം", "പ രളയ"),
        (None, ""),
    ],
)
def test_clean_text(spark, raw, expected):
    assert one(spark, raw, tx.clean_text) == expected


def test_clean_text_keeps_marks_on_request(spark):
    assert one(spark, "പ്രളയം!", lambda c: tx.clean_text(c, keep_marks=True)) == "പ്രളയം!"


PIECES = ["RT ", "RT", "http", "http://a.b", "www.", "@", "#", "@a", "#b", "&amp;", "&lt;", "&gt;", "lt;", " ", "\t",
          "\n", "_", "é", "ß", "9", "!", "'", "-", "$", "x", "Y", " ", "́"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=40, max_size=40))
def test_fused_cleaning_equals_single_steps(spark, texts):
    con = duck("/nonexistent")
    con.execute("CREATE TABLE t (i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    expected = [r[0] for r in con.execute(f"SELECT {clean_sql('s')} FROM t ORDER BY i").fetchall()]
    assert many(spark, texts, tx.clean_text) == expected


def test_cleaning_is_evaluated_once(spark):
    df = add_clean_text(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_counts(spark):
    assert one(spark, "  a bb ccc \n", tx.word_count) == 3
    assert one(spark, "", tx.clean_word_count) == 0
    assert one(spark, "a bb c", tx.clean_word_count) == 3


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('1. "need water now pls"', "need water now pls"),
        ("- help us", "help us"),
        ("• 2) both kinds", "both kinds"),
        ("plain", "plain"),
        ("'quoted'", "quoted"),
    ],
)
def test_strip_list_markers(spark, raw, expected):
    assert one(spark, raw, tx.strip_list_markers) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("need water now please", True),
        ("three words only", False),
        ("", False),
        ("Here are ten tweets now", False),
        ("  I'll send what you need", False),
        (" ".join(["w"] * 60), True),
        (" ".join(["w"] * 61), False),
        ("1. too few here", False),
        ("1. enough words are here", True),
    ],
)
def test_is_good_row(spark, raw, expected):
    assert one(spark, raw, tx.is_good_row) is expected


def test_fingerprint(spark):
    a, b = many(spark, ["A b C d e f g h tail", " a  B c D e F g H other"], tx.fingerprint)
    assert a == b == "a b c d e f g h"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Critical Rescue", "Critical Rescue"),
        (" Critical Rescue\n", "Critical Rescue"),
        ("label: irrelevant.", "Irrelevant"),
        ("irrelevant or situational awareness", "Situational Awareness"),
        ("none", "UNMATCHED"),
        ("ERROR", "ERROR"),
    ],
)
def test_match_label(spark, raw, expected):
    assert one(spark, raw, tx.match_label) == expected


def test_excerpt(spark):
    assert one(spark, "né\U0001f600x", lambda c: tx.excerpt(c, 3, ascii_only=True)) == "n??"


def test_ngrams(spark):
    grams = one(spark, "A bb cc dd", lambda c: tx.ngrams(tx.tokens(c), 1, 2))
    assert grams == ["bb", "cc", "dd", "bb cc", "cc dd"]
    assert one(spark, "a", lambda c: tx.ngrams(tx.tokens(c), 1, 3)) == []
    assert one(spark, "aa bb cc", lambda c: tx.ngrams(tx.tokens(c), 3, 3)) == ["aa bb cc"]


def test_romanize(spark):
    assert one(spark, "കേരളം", romanize_malayalam) == "keraLaM"
    assert one(spark, "പ്രളയം", romanize_malayalam) == "praLayaM"
    assert one(spark, "help", romanize_malayalam) == "help"
    assert one(spark, "Straße où", romanize_latin) == "Strasse ou"


def test_tokens_follow_unicode_letters(spark):
    text = "Ünï_côde 9x a bé½"
    expected = [w for w in re.findall(r"\w\w+", unicodedata.normalize("NFC", text).lower())]
    assert one(spark, text, tx.tokens) == expected
