"""Romanisation by clusters against a plain loop over letters."""

import random

from pyspark.sql import functions as F

from tocsin.functions.romanize import MALAYALAM, romanize_malayalam

VIRAMA, ZWJ, ZWNJ = "്", "‍", "‌"


def loop(text):
    """Letter by letter with one letter of look-ahead."""
    for table in (MALAYALAM.joined, None, MALAYALAM.composed):
        if table is None:
            kept = []
            for c in text:
                if c not in (ZWJ, ZWNJ) or not kept or not "ഀ" <= kept[-1] <= "ൿ":
                    kept.append(c)
            text = "".join(kept)
        else:
            for spelled, letter in table.items():
                text = text.replace(spelled, letter)
    out = []
    for i, c in enumerate(text):
        after = text[i + 1 : i + 2]
        if c in MALAYALAM.consonants:
            silent = after and (after in MALAYALAM.signs or after == VIRAMA)
            out.append(MALAYALAM.consonants[c] + ("" if silent else "a"))
        elif c != VIRAMA:
            out.append(MALAYALAM.signs.get(c) or MALAYALAM.others.get(c, c))
    return "".join(out)


def romanized(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.out for r in df.select("i", romanize_malayalam(F.col("t")).alias("out")).orderBy("i").collect()]


def test_known_words(spark):
    words = {
        "കേരളം": "keraLaM",
        "പ്രളയം": "praLayaM",
        "അവൻ": "avan",
        "അവ" + "ന" + VIRAMA + ZWJ: "avan",  # the last letter spelled with a joiner
        "ക" + "ൊ": "ko",  # a vowel sign in two parts
        "ക" + VIRAMA + ZWNJ + "ഷ": "kSha",
        "help 👩" + ZWJ + "🚒": "help 👩" + ZWJ + "🚒",
        "കേ 👩" + ZWJ + "🚒!": "ke 👩" + ZWJ + "🚒!",
        "": "",
    }
    assert romanized(spark, [*words, None]) == [*words.values(), None]


def test_any_order_of_letters(spark):
    draw = random.Random(1)
    letters = [chr(c) for c in range(0x0D00, 0x0D80)] + [VIRAMA, ZWJ, ZWNJ] * 8 + list("a b\n👩é")
    texts = ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(2000)]
    texts.append("".join(draw.choices(letters, k=200_000)))
    texts.append("x" * 300_000 + "ക")
    assert romanized(spark, texts) == [loop(t) for t in texts]


def test_tables_are_compiled_to_one_expression(spark):
    """One pass of clusters and no chain of one replacement per letter."""
    df = spark.createDataFrame([("ക",)], "t string").select(romanize_malayalam(F.col("t")).alias("out"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") <= len(MALAYALAM.joined) + len(MALAYALAM.composed) + 1
    assert plan.count("regexp_extract_all(") == 1
