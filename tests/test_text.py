"""Text functions on the values of the fixtures."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def run(spark, f, values, *more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v"), *more).alias("o")).orderBy("i").collect()]


def test_normalize_title(spark):
    given = ["political philosophy", "United_States", "United   States", "Anarchism#History", "#Section", ":Category:Foo", "Star Trek: The Next Generation", "ß", "SS", "", "   ", "_", None, "ǆ", "ǅ", "::  : x", " a b "]
    want = ["Political philosophy", "United States", "United States", "Anarchism", None, "Category:Foo", "Star Trek: The Next Generation", "ß", "SS", None, None, None, None, "Ǆ", "ǅ", "X", "A b"]
    assert run(spark, T.normalize_title, given) == want


def test_namespaces_and_categories(spark):
    names = ["File", "Category", "Talk", "User talk"]
    assert run(spark, T.is_foreign, ["File:Example.jpg", "category:Living people", "It: Chapter Two", "Anarchism", ":Category:X", "user_talk:Z", " file :q"], names) == [True, True, False, False, False, True, True]
    assert run(spark, T.category_name, ["Category:Politics|key", "category: jazz", ":Category:X", "Foo"]) == ["Politics", "Jazz", None, None]
    assert run(spark, T.is_maintenance, ["CS1 maint: x", "Towns in Sudan", "articles lower", "All articles", "Film stubs", "People from Oslo"]) == [True, False, False, True, True, True]


def test_links_and_cleaning(spark):
    given = ["see [[Cat]] and [[Dog|dogs]].", "[[File:a.jpg|thumb|of [[Paris]]]]", "[[Cat]] and [[Dog", "[[|x]] [[]]", "[[[[A]]]]"]
    assert run(spark, T.links, given) == [["Cat", "Dog"], ["Paris"], ["Cat"], [], ["A"]]
    assert run(spark, T.strip_comments, ["a <!-- [[Hidden]] --> b", "a <!-- b"]) == ["a  b", "a "]
    assert run(spark, T.strip_element, ['a <ref>see [[Book]]</ref> b <ref name="x" /> c', "<references/> z", "a <REF>open"], "ref") == ["a  b  c", "<references/> z", "a "]
    assert run(spark, T.strip_templates, ["a {{infobox|x={{inner|[[Deep]]}}|y=[[Mid]]}} b", "{| class=x\n| [[Cell]]\n|}", "a {{open", None]) == ["a  b", "{| class=x\n| [[Cell]]\n|}", "a ", None]
    assert run(spark, T.clean, ["x\n==References==\n[[A]]", "x\n== External Links ==\ny", "x\n== See also ==\n[[B]]", "{{i|[[C]]}}"]) == ["x\n", "x\n", "x\n== See also ==\n[[B]]", "{{i|[[C]]}}"]
    assert run(spark, T.decode_entities, ["AT&amp;T &lt;x&gt; &amp;lt; &nbsp;"]) == ["AT&T <x> &lt; &nbsp;"]


def test_extras(spark):
    assert run(spark, T.short_description, ["{{Short description|none}}{{shortdesc| First }}{{short desc|second}}", "{{Short description|none}}", "x", "{{Short description|" + "é" * 100 + "}}"]) == ["First", None, None, "é" * 80]
    f = lambda c: T.flags(c, F.lit("Mercury"))
    assert run(spark, f, ["{{Disambiguation}}", "{{hndis|x}}", "{{Airport disambiguation}}", "{{Infobox person}}", "{{Featured article}} {{good article}}"]) == [1, 1, 1, 0, 6]
    assert run(spark, lambda c: T.flags(F.lit(""), c), ["Mercury (disambiguation)", "Mercury"]) == [1, 0]
    assert run(spark, T.infobox_kind, ["{{Infobox film\n|a}} {{Infobox person}}", "{{infobox}}", "x"]) == ["film", None, None]
    got = run(spark, T.coordinates, ["{{coord|40.7127|-74.0059}}", "{{Coord|40|42|46|N|74|0|22|W}}", "{{coord|1|2}} {{coord|3|4|display=inline,title}}", "{{coord|1|2|display=title}} {{coord|3|4}}", "{{coord|999|10}}", "{{coord|x}}"])
    assert [got[4], got[5]] == [None, None]
    for g, w in zip(got, [(40.7127, -74.0059), (40.7128, -74.0061), (3, 4), (1, 2)]):
        assert g.lat == pytest.approx(w[0], abs=1e-3) and g.lon == pytest.approx(w[1], abs=1e-3)
    hostile = ["{{", "{{}}{{|}}", "{{" + "x" * 100000 + "}}"] + ["{{" + "a" * n + "é}}" for n in range(70)]
    assert len(run(spark, T.template_names, hostile)) == 73
    assert all(x == ("ab" + "é" * 40)[: 2 + max(0, n - 2) // 2] or n < 2 for n in range(2, 12) for x in run(spark, T.cut_bytes, ["ab" + "é" * 40], n))


def test_search_score(spark):
    rows = [("cat", "cat", 5), ("catholic church", "cat", 93701), ("albert einstein", "einst", 241), ("einstein bros. bagels", "einst", 1), ("the weinstein company", "einst", 5), ("albert einstein", "einst", 5), ("unrelated", "einst", 9)]
    got = [spark.createDataFrame([(a, d)], "a string, d long").select(T.search_score(F.col("a"), q, F.col("d")).alias("s")).first().s for a, q, d in rows]
    assert got[0] == 1 << 60 and got[0] > got[1] == 9370200 and got[2] > got[3] and got[4:] == [6, 180, None]


def test_names(spark):
    bad = ["Living people", "possibly living people", "Year of birth missing", "1985 births", "2020 deaths", "Deaths in 2020", "Lists of deaths in 2019", "Jazz (living people)", "Date of death unknown"]
    good = ["Deaths in police custody", "Births", "12 births", "Jazz musicians"]
    assert run(spark, T.is_vacuous, bad + good) == [True] * len(bad) + [False] * len(good)
    assert run(spark, T.clean_label, ["Living people", "Jazz musicians (living people)", "Mercury (planet)", "(living people)", " "]) == [None, "Jazz musicians", "Mercury (planet)", None, None]
    assert run(spark, T.nickname, ["  bob  ", "", "a\x00b\x1b", "x" * 200, None]) == ["bob", "anonymous", "ab", "x" * 20, "anonymous"]
    assert [spark.range(1).select(T.compass_charges(F.lit(p)).alias("c")).first().c for p in (0, 1, 2, 3, 4, 5, 50)] == [1, 1, 1, 1, 2, 3, 4]
    assert [spark.range(1).select(T.verdict(F.lit(c), F.lit(3)).alias("c")).first().c for c in (3, 4, 5, 9)] == ["par", "bogey", "double bogey", "+6"]


def test_codes_and_race_links(spark):
    df = spark.createDataFrame([([9, 3, 4, 100],), ([],)], "ids array<long>").select(T.delta_encode(F.col("ids")).alias("e"))
    assert [(r.e, r.d) for r in df.select("e", T.delta_decode(F.col("e")).alias("d")).collect()] == [([3, 1, 5, 91], [3, 4, 9, 100]), ([], [])]
    one = spark.createDataFrame([("C++ & co", "É t", "hard", 1000)], "a string, b string, c string, d int").select(T.race_link(*map(F.col, "abcd"), F.lit("ds1")).alias("l"))
    got = one.select(T.parse_race_link(F.col("l"), "ds1").alias("r"), T.parse_race_link(F.col("l"), "ds2").alias("no")).first()
    assert (got.r.mode, got.r.start, got.r.goal, got.r.difficulty, got.r.ban) == ("pair", "C++ & co", "É t", "hard", "1000") and got.no is None
    given = ["?round=4&holes=9", "?round=4&holes=5", "?daily=7&difficulty=hard", "?daily=0", "?from=A", "?from=A&to=B&ban=x", "?"]
    assert [x and x.mode for x in run(spark, T.parse_race_link, given, "d")] == ["round", None, "daily", None, None, None, "daily"]
