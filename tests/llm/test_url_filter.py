"""Hosts, rules and the exactness of the cascade."""

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tests.conftest import SF
from tocsin.llm import url_filter
from tocsin.llm.queries import ORACLES, QUERIES, URL_RULES
from tocsin.llm.url_filter import Rule, build_cascade, is_listed, judge, slices_needed, universe_keys, with_listed


def test_query_matches_sql(spark):
    df = QUERIES["op4_url_filter"](spark, SF)
    assert compare(df, duck(SF), ORACLES["op4_url_filter"]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_parts_and_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "block"),  # its host has blocked pages
        ("http://b.com/fr/?a", "b.com", "/fr/", "com/fr/", "allow"),
        ("http://b.com/de", "b.com", "/de", None, "allow"),
        ("http://h.net?a://b/c", "h.net", "", None, "allow"),
        ("http://Ü.net/É://x", "Ü.net", "/É://x", None, "allow"),
        ("no scheme.org/es/", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://a.net/\nx#y", "a.net", "/\nx", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://l.com/" + "x" * 100_000, "l.com", "/" + "x" * 100_000, None, "allow"),
    ]
    df = spark.createDataFrame([(u[0], "clash", "clash") for u in urls * 2], "url string, host string, verdict string")
    rows = judge(df, URL_RULES).collect()
    want = {u[0]: u[1:] for u in urls}
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.url]
    assert judge(df.limit(0), URL_RULES).collect() == []


def test_longest_rule_wins_and_no_rule_lists_nothing(spark):
    df = spark.createDataFrame([("http://a.b.c/x/y",)], "url string")
    rules = [Rule("allow", "c", "/"), Rule("block", "b.c", "/x"), Rule("allow", "a.b.c", "/x/y")]
    assert judge(df, rules).first().rule == "a.b.c/x/y"
    assert judge(df, rules[:2]).first().verdict == "block"
    assert judge(df, []).first().verdict == "allow"


@pytest.mark.parametrize("listed", [0, 1, 300, 2500, 5000])
def test_cascade_is_exact_over_its_universe(spark, listed):
    universe = spark.range(5000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < listed).alias("listed")
    )
    universe = universe.unionByName(universe.limit(50)).unionByName(universe.limit(1).withColumn("key", F.lit(None).cast("string")))
    levels = build_cascade(universe, "key", "listed")
    assert (len(levels) == 0) == (listed == 0)
    wrong = universe.filter("key IS NOT NULL").filter(is_listed(F.col("key"), levels) != F.col("listed"))
    assert wrong.count() == 0
    assert listed != 300 or len(levels) > 1


def test_cascades_in_slices_give_the_same_answer_without_a_join(spark, monkeypatch):
    """Beyond the bound every slice has a cascade below it; there is still no join."""
    rows = spark.range(6000).selectExpr(
        "id", "IF(id % 50 = 0, NULL, concat('k', id % 1500)) AS key", "id % 1500 % 3 = 1 AS truth", "'clash' AS found"
    )
    keys = universe_keys(rows, "key", "truth")
    bound = 300
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", bound)
    assert slices_needed(500, 970) > 1
    sizes = []
    monkeypatch.setattr(url_filter, "cascade", lambda k, make=url_filter.cascade: sizes.append(make(k)) or sizes[-1])
    out = with_listed(rows, "key", keys, "found")
    assert len(sizes) == slices_needed(*[keys.filter(f).count() for f in ("listed", "NOT listed")])
    assert all(len(level.data) <= bound for levels in sizes for level in levels)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.found for r in out.collect()}
    assert got == {r.id: bool(r.key and r.truth) for r in rows.collect()}


def test_judging_in_slices(spark, monkeypatch):
    urls = [f"http://h{i}.com/{'de/' if i % 7 == 0 else 'x'}" for i in range(70)] + [f"http://h{i}.com/y" for i in range(70)]
    df = spark.createDataFrame([(u,) for u in [*urls, None, "none"]], "url string")
    want = sorted(map(repr, judge(df, URL_RULES).collect()))
    assert sum("'block'" in r for r in want) == 20
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", 8)
    assert sorted(map(repr, judge(df, URL_RULES).collect())) == want


def test_slices_follow_the_universe():
    """Few listed keys in a large universe need slices as well."""
    assert slices_needed(0, 10**12) == 1
    assert slices_needed(10**6, 10**7) == 1
    assert 20 < slices_needed(1000, 30 * 10**9) < 60
