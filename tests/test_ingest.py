"""A dump from XML to tables, sources, sinks, runs and streams."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ingest, runs
from loomgraph.sources import sinks, tables, wiki
from loomgraph.streaming import state

HEAD = '<mediawiki><siteinfo><namespaces><namespace key="0" case="first-letter" /><namespace key="6">File</namespace><namespace key="14">Category</namespace></namespaces></siteinfo>'


def page(title, text="", ns=0, redirect=None):
    r = f'<redirect title="{redirect}" />' if redirect else ""
    return f'<page><title>{title}</title><ns>{ns}</ns>{r}<revision><text bytes="1" xml:space="preserve">{text}</text></revision></page>\n'


BODY = (
    "See [[political philosophy]], [[Political_philosophy|x]] and [[Political philosophy#History]], [[AccessibleComputing]], [[File:a.jpg|thumb]] [[Category:Politics]] "
    "[[Nonexistent page]] [[anarchism]] &lt;!-- [[Hidden]] --&gt; {{Infobox x|a=[[Star Trek: The Next Generation]]}} {{Short description|Idea}}\n== References ==\n[[Computer accessibility]] [[Gone]]"
)
PAGES = [
    page("Anarchism", BODY), page("Political philosophy", "AT&amp;T\n[[A11y]]"), page("AccessibleComputing", redirect="Computer accessibility"), page("Computer accessibility", ""), page("A11y", redirect="AccessibleComputing"),
    page("Broken", redirect="Does not exist"), page("Star Trek: The Next Generation", "x"), page("Talk:Anarchism", "[[Anarchism]]", 1), page("Odd", "y", "?"),
]


@pytest.mark.parametrize("packed", [False, True])
def test_build(spark, tmp_path, packed):
    text = (HEAD + "".join(PAGES) + "</mediawiki>").encode()
    f = tmp_path / ("d.xml.bz2" if packed else "d.xml")
    f.write_bytes(bz2.compress(text) if packed else text)
    p = wiki.pages(spark, str(f))
    assert wiki.namespaces(spark, str(f)) == ["File", "Category"] and p.count() == 9
    assert p.where("title = 'Political philosophy'").first().text == "AT&T\n[[A11y]]"
    if packed:
        return
    t = ingest.build(p, ["File", "Category"])
    titles = {r.title: r.id for r in t["titles"].collect()}
    assert titles == {"Anarchism": 0, "Political philosophy": 1, "Computer accessibility": 2, "Star Trek: The Next Generation": 3}
    assert {(r.alias, r.article_id) for r in t["redirects"].collect()} == {("AccessibleComputing", 2), ("A11y", 2)}
    assert {(r.src, r.dst) for r in t["edges"].collect()} == {(0, 1), (0, 2), (0, 3), (1, 2)}
    assert {r.kind: r.n for r in ingest.funnel(t["links"]).collect()} == {"edge": 4, "duplicate": 2, "foreign": 2, "red": 1, "self": 1}
    assert [(r.id, r.category, r.ord) for r in t["categories"].collect()] == [(0, "Politics", 1)]
    x = t["extras"].where("id = 0").first()
    assert x.description == "Idea" and x.kind == "x" and x.flags == 0


def test_redirects_follow_five_hops(spark):
    chain = [(f"p{i}", f"p{i + 1}") for i in range(7)] + [("p7", None), ("a", "b"), ("b", "a"), ("c", "none")]
    got = {r.key: r.final for r in ingest.redirect_closure(spark.createDataFrame(chain, "key string, target string")).collect()}
    assert got == {"p0": None, "p1": None} | {f"p{i}": "p7" for i in range(2, 8)} | {"a": None, "b": None, "c": None}


def test_sources(spark, tmp_path):
    assert tables.optional_table(spark, f"{tmp_path}/none", "id bigint").count() == 0
    assert tables.Config.of({"alpha": 0.5, "clean": {"templates": True}, "other": 1}).clean == {"references": True, "templates": True, "citations": True}
    (tmp_path / "log.jsonl").write_text('{"board":"b","clicks":3}\n\nnot json\n{"board":"c","clicks":4}\n')
    assert sorted(r.board for r in tables.replay(spark, f"{tmp_path}/log.jsonl", "board string, clicks long").collect() if r.board) == ["b", "c"]
    (tmp_path / "labels.json").write_text('{"1": "One", "x": "no"}')
    assert [(r.community, r.name) for r in tables.label_map(spark, f"{tmp_path}/labels.json").collect()] == [(1, "One")]
    (tmp_path / "deny.txt").write_text("# c\n\n anarchism \nUnknown\n")
    index = spark.createDataFrame([("Anarchism", 7)], "key string, id long")
    assert {(r.title, r.id) for r in tables.deny_list(spark, f"{tmp_path}/deny.txt", index).collect()} == {("anarchism", 7), ("Unknown", None)}
    r = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 3)], "id long, v string, o int")
    assert tables.capped_list(r, "v", 2, "o").first()["values"] == ["b", "a"]
    a = tables.fingerprint(spark, [f"{tmp_path}/deny.txt"])
    (tmp_path / "deny.txt").write_text("# d\n\n anarchism \nUnknown\n")
    assert tables.fingerprint(spark, [f"{tmp_path}/deny.txt"]) != a
    pool = spark.createDataFrame([(0, 3, 1, 2)], "difficulty int, par int, src long, dst long")
    assert tables.check_pools(pool, 3, {"n": 1}, {"n": 1}).count() == 1
    for n, stamp in ((2, {"n": 1}), (3, {"n": 2})):
        with pytest.raises(ValueError):
            tables.check_pools(pool, n, stamp, {"n": 1})
    lines = spark.createDataFrame([("en.wikipedia b_c 1 d 5 x",), ("en.wikipedia B_c 1 d 7 x",), ("de.wikipedia B_c 1 d 7 x",), ("en.wikipedia B_c 1 d ? x",), ("en.wikipedia Al 1 d 2 x",)], "value string")
    t, al = spark.createDataFrame([(1, "B c")], "id long, title string"), spark.createDataFrame([(1, "Al"), (9, "B c")], "id long, alias string")
    assert [(r.id, r.views) for r in ingest.pageviews(lines, t, al).collect()] == [(1, 14)]


def test_sinks_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(i, f'T "{i}"\\', "d" if i % 2 else None, i % 3, 5, "c", 1) for i in range(1000)], "id long, title string, description string, flags long, views long, community string, degree long")
    e = spark.createDataFrame([(0, 5), (0, 3), (999, 0)], "src long, dst long")
    docs = sinks.shards(n, e)
    sinks.write_documents(docs, f"{tmp_path}/shards", "shard")
    back = spark.read.text(f"{tmp_path}/shards").withColumnRenamed("value", "doc")
    got = {r.id: (r.title, r.targets) for r in sinks.read_shards(back).collect()}
    assert len(got) == 1000 and got[0] == ('T "0"\\', [3, 5]) and got[999][1] == [0] and got[1][1] == []
    doc = json.loads(back.where("shard = 0").first().doc)
    assert [x["id"] for x in doc["d"]] == [3, 5] and len(doc["a"]) == sinks.SHARD
    sinks.write_edges(e, f"{tmp_path}/edges")
    assert spark.read.parquet(f"{tmp_path}/edges/by_dst").count() == 3
    levels = spark.createDataFrame([(4, 1), (2, 1), (9, 2)], "id long, dist int")
    assert json.loads(sinks.compass_document(levels, spark).first().doc) == {"d": 2, "l": [[2, 2], [9]]}


def test_runs(spark):
    rows = [("b", "p", 3, 900, 1), ("b", "p", 3, 800, 2), ("b", "p", 4, 1, 3), ("b", "", 2, 5, 4), ("b", "", 2, 5, 5), ("b", "q", 3, 800, 6)]
    got = [(r.player, r.seq) for r in runs.leaderboard(spark.createDataFrame(rows, "board string, player string, clicks long, ms long, seq long")).orderBy("rank").collect()]
    assert got == [("", 4), ("", 5), ("p", 2), ("q", 6)]
    a = [(1, 0, 0, "pause"), (1, 10, 1, "start"), (1, 15, 2, "start"), (1, 30, 3, "pause"), (1, 50, 4, "resume"), (1, 60, 5, "finish"), (1, 90, 6, "resume"), (2, 5, 1, "start")]
    acts = spark.createDataFrame(a, "run long, ts_ms long, seq long, action string")
    assert {(r.run, r.active_ms, r.state) for r in runs.active_time(acts).collect()} == {(1, 30, "finished"), (2, 0, "running")}
    d = spark.createDataFrame([("a", x) for x in (1, 2, 3, 7, 8, 8)], "player string, number long")
    assert runs.streaks(d).first().best == 3
    cards = spark.createDataFrame([(1, 3, 3), (1, 4, None)], "card long, par long, clicks long")
    assert tuple(runs.scorecard(cards).first()) == (1, 7, 10, "+3")
    r = spark.createDataFrame([(1, i, i != 2) for i in range(5)], "run long, seq long, useful boolean").withColumn("charges", F.lit(2))
    assert [x.granted for x in runs.spend(r).orderBy("seq").collect()] == [True, True, True, False, False]


def test_token_bucket_and_its_stream(spark, tmp_path):
    rows = [("a", float(t), i) for i, t in enumerate((0, 0, 0, 0, 1, 1, 5, 5, 5, 5))] + [("b", 0.0, 99)]
    df = spark.createDataFrame(rows, "client string, ts double, seq long")
    want = {(r.client, r.seq): r.allowed for r in state.token_bucket(df, 3, 1).collect()}
    assert [want["a", i] for i in range(10)] == [True, True, True, False, True, False, True, True, True, False] and want["b", 99]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert {(r.client, r.seq): r.allowed for r in state.gathered(state.token_bucket_stream(s, 3, 1), once=True).collect()} == want
