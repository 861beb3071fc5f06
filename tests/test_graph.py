"""Traversal, search and links on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.labels import display_label, document_category, safe_name
from quillgraph.operators import graph as G
from quillgraph.operators import ingest as I
from quillgraph.operators import links as L
from quillgraph.operators import search as S
from quillgraph.operators.ranks import in_order
from quillgraph.operators.schema import ddl_gate, parse_ddl, read_only


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, r) for a, b, r in pairs], "src string, dst string, rel_type string")


def test_impact_cycle_and_loop(spark):
    e = edges(spark, ("a", "b", "R"), ("b", "c", "R"), ("c", "a", "R"), ("c", "c", "R"), ("a", "b", "S"))
    got = {(r.id, r.depth) for r in G.impact(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("b", 1), ("c", 2)}


def test_reasoning_chain_excludes_root(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = edges(spark, ("a", "b", "R"), ("c", "b", "S"))
    got = {(r.hop, r.id, r.direction) for r in G.reasoning_chain(n, e, "a").collect()}
    assert got == {(1, "b", "out"), (2, "c", "in")}


def test_communities(spark):
    e = edges(spark, ("a", "b", "R"), ("b", "c", "R"), ("a", "c", "R"), ("x", "y", "R"), ("y", "z", "R"), ("x", "z", "R"))
    got = {r.id: r.community for r in G.communities(e).collect()}
    assert len({got[k] for k in "abc"}) == 1 and len({got[k] for k in "xyz"}) == 1 and got["a"] != got["x"]


def test_seed_expansion_sees_neighbours_once(spark):
    e = edges(spark, ("s1", "n", "R"), ("s2", "n", "R"), ("s2", "m", "R"))
    seeds = spark.createDataFrame([("s1", 0), ("s2", 1)], "id string, seed_rank int")
    assert sorted((r.node, r.other) for r in G.seed_expansion(seeds, e).collect()) == [("s1", "n"), ("s2", "m")]


def test_display_labels(spark):
    rows = [("TRM_FINANCE_6", None, "4."), ("TRM_X", None, None), ("id", None, "{'_id': 1"), ("n1", "增值", "zz"), ("0123456789abcdef", None, "2.5%"), ("short", None, None), (None, None, None), ("k", "  A long enough title that goes on and on and on  ", None)]
    df = spark.createDataFrame(rows, "id string, title string, name string")
    got = [r[0] for r in df.select(display_label("id", title="title", name="name")).collect()]
    assert got == ["金融业 6%", "TRM", "id", "增值", "...89abcdef", "short", "未命名", "A long enough title that goes on and on "]


def test_categories_and_names(spark):
    df = spark.createDataFrame([("policy/a",), ("pdf_cpa1",), ("",), (None,), ("发票x",)], "t string")
    assert [r[0] for r in df.select(document_category(F.col("t"))).collect()] == ["legal", "knowledge", "other", "other", "legal"]
    name = spark.createDataFrame([("税" * 100 + ":x",)], "t string").select(safe_name(F.col("t"))).first()[0]
    assert len(name.encode()) <= 240 and name.startswith("税" * 80)


def test_fusion_example(spark):
    one = spark.createDataFrame([("A", "FAQEntry", 0)], "id string, label string, rank int")
    assert S.fuse([one, one], boost=S.FUSION_BOOST).first().rrf_score == 0.037787


def test_subterms():
    assert S.subterms("小规模纳税人的增值税优惠")[:2] == ["小规模纳税人", "增值税"]
    assert all(len(t) >= 2 for t in S.subterms("如何申报个人所得税退税"))


def test_early_stop_counts_labels_before(spark):
    rows = [(f"a{i}", "A", "term", None, None) for i in range(60)] + [("b", "B", "term", None, None)]
    n = spark.createDataFrame(rows, "id string, label string, name string, title string, content string")
    got = S.text_search(n, "term", ["A", "B"], limit=2).collect()
    assert [r.id for r in got] == ["a0", "a1"] and got[0].score == 105


def test_keywords_long_dictionary_equals_short(spark):
    t = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, None), (4, "")], "id int, t string")
    k = spark.createDataFrame([("beta", 0), ("gamma", 1), ("mm", 2), ("zeta", 3), ("a", 4)], "keyword string, seq int")
    short = sorted(map(tuple, L.keyword_links(t, k, "id", "t").collect()))
    assert sorted(map(tuple, L.keyword_links(t, k, "id", "t", part_bytes=4).collect())) == short == [(1, "a"), (1, "beta"), (1, "gamma"), (1, "mm"), (2, "a"), (2, "beta")]


def test_empty_keywords_and_long_texts(spark):
    t = spark.createDataFrame([(1, "é日本語 " * 30_000 + "needle"), (2, "x"), (3, "")], "id int, t string")
    k = spark.createDataFrame([("", 0), (None, 1), ("needle", 2), ("日", 3), ("本語 é", 4)], "keyword string, seq int")
    want = [(1, "needle"), (1, "日"), (1, "本語 é")]
    assert sorted(map(tuple, L.keyword_links(t, k, "id", "t").collect())) == want
    assert sorted(map(tuple, L.keyword_links(t, k, "id", "t", part_bytes=4).collect())) == want


def test_resolution(spark):
    calls = spark.createDataFrame([("s", "f", 0.9), ("s", "g", 0.9), ("s", "h", 0.9)], "src string, name string, confidence double")
    symbols = spark.createDataFrame([("n1", "f", 1), *[(f"m{i}", "g", i) for i in range(4)]], "node_id string, name string, seq int")
    got = sorted((r.dst, r.confidence) for r in L.resolve_names(calls, symbols).collect())
    assert got == [("external:h", 0.4), ("m0", 0.6), ("m1", 0.6), ("m2", 0.6), ("n1", 0.95)]


def test_versions_skip_equal_years(spark):
    df = spark.createDataFrame([("t", 2022, "a"), ("t", 2023, "b"), ("t", 2023, "c")], "base string, year int, id string")
    assert [tuple(r) for r in L.version_chain(df, "base", "year", "id").collect()] == [("c", "a")]


def test_gates(spark):
    rows = [("", "title", "c" * 20), ("1", "t", "c" * 20), ("1", "ti", "c" * 19), ("1", "ti", "c" * 20), ("1", "{'_id': 1", "c" * 30)]
    df = spark.createDataFrame(rows, "id string, title string, content string")
    got = [r[0] for r in df.select(I.gate_reason(F.col("id"), F.col("title"), F.col("content"), F.lit(False))).collect()]
    assert got == ["missing_id", "title_too_short", "content_too_short", None, "title_is_raw_id"]


def test_upsert_and_rewire(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (1, None)], "k int, v string")
    assert sorted(map(tuple, I.upsert(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, None)]
    e = edges(spark, ("a", "b", "R"), ("c", "b", "R"), ("a", "c", "R"))
    got = sorted(map(tuple, I.rewire(e, spark.createDataFrame([("c", "a")], "o string, n string")).collect()))
    assert got == [("a", "b", "R")]


def test_schema_text(spark):
    ddl = "CREATE NODE TABLE IF NOT EXISTS A(id STRING, n DECIMAL(10, 2), PRIMARY KEY (id));\nCREATE REL TABLE IF NOT EXISTS If_Conditional(FROM A TO B, w DOUBLE);"
    assert [(k, n, line, c) for k, n, line, c, _ in parse_ddl(ddl)] == [("NODE", "A", 1, ["id", "n"]), ("REL", "If_Conditional", 2, ["w"])]
    assert read_only("SELECT 'DROP' FROM t") and not read_only("select 1; drop table t")
    s = spark.createDataFrame([("CREATE NODE TABLE A(id STRING)",), ("DROP TABLE Z",), ("DELETE x",)], "statement string")
    assert [r.verdict for r in ddl_gate(s, spark.createDataFrame([("A",)], "name string")).orderBy("statement").collect()] == ["ok", "forbidden", "undeclared"]


def _graph(spark, seed, n=14, m=34):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("RS")) for _ in range(m)})
    return rows, spark.createDataFrame(rows, "src string, dst string, rel_type string")


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.mark.parametrize("seed,depth", [(1, 1), (2, 2), (3, 3), (4, 4)])
def test_paths_between(spark, seed, depth):
    rows, e = _graph(spark, seed)
    starts, ends = ("n0", "n1", "n2", "none"), ("n2", "n3", "n4")
    every = []

    def walk(a, at, used):
        if used and at in ends:
            every.append((a, at, len(used), [a, *(x[1] for x in used)], [x[2] for x in used]))
        if len(used) < depth:
            for x in rows:
                if x[0] == at and x not in used:
                    walk(a, x[1], [*used, x])

    for a in starts:
        walk(a, a, [])
    got = [tuple(r) for r in G.paths_between(e, _ids(spark, *starts), _ids(spark, *ends), depth).collect()]
    assert sorted(map(str, got)) == sorted(map(str, every))
    shortest = {}
    reach = {a: {a} for a in starts}
    for n in range(1, depth + 1):
        for a in starts:
            reach[a] = {x[1] for x in rows if x[0] in reach[a]}
            for b in reach[a] & set(ends):
                shortest.setdefault((a, b), n)
    assert {(r.a, r.b): r.steps for r in G.shortest_between(e, _ids(spark, *starts), _ids(spark, *ends), depth).collect()} == shortest


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_communities_round_by_round(spark, seed):
    rows, e = _graph(spark, seed, 30, 50)
    near = {}
    for a, b, _ in rows:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for rounds in (1, 2, 10):
        label = {a: a for a in near}
        for _ in range(rounds):
            label = {a: min(set(label[b] for b in near[a]), key=lambda x: (-sum(label[b] == x for b in near[a]), x)) for a in near}
        assert {r.id: r.community for r in G.communities(e, rounds).collect()} == label
    assert G.communities(e.limit(0)).count() == 0


def test_in_order(spark):
    df = spark.createDataFrame([(k % 7 if k % 5 else None, str(k)) for k in range(50)], "a int, b string")
    got = sorted((r.n, -1 if r.a is None else r.a) for r in in_order(df, ["a"], "n").collect())
    assert [n for n, _ in got] == list(range(50)) and [a for _, a in got] == sorted(a for _, a in got)
    assert in_order(df.limit(0), ["a"], "n").count() == 0


@pytest.mark.parametrize("name", ["j36_shortest_between", "j36_paths_between"])
def test_paths_from_few_seeds_keep_only_edges_that_these_reach(spark, name, monkeypatch):
    """Not the graph's, which a checkpoint would write to disk once a step."""
    from quillgraph.plans.registry import QUERIES

    folder, kept, pinned = "/root/testdata/sf0.01", [], G.pinned

    def counted(df):
        out = pinned(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(G, "pinned", counted)
    assert QUERIES[name](spark, folder).count()
    assert max(kept) < spark.read.parquet(f"{folder}/lineitem.parquet").count() / 4


def test_edges_of_few_nodes_of_a_label_are_found_without_a_shuffle(spark, monkeypatch):
    """Nor are they where ids of another label are many; whether they are shuffled or not, paths are the same."""
    from quillgraph.plans.registry import QUERIES
    from quillgraph.sources import views as W

    folder = "/root/testdata/sf0.01"
    monkeypatch.setattr(W, "SMALL", 40)
    ids = _ids(spark, *(f"Customer:{k}" for k in range(50)), *(f"Supplier:{k}" for k in range(30)))
    found = W.edges_at(spark, folder, ids, "dst")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    want = {(f"Part:{r.l_partkey}", f"Supplier:{r.l_suppkey}") for r in spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_suppkey < 30").select("l_partkey", "l_suppkey").collect()}
    assert {(r.src, r.dst) for r in found.collect()} == want
    every = sorted(map(str, QUERIES["j36_paths_between"](spark, folder).collect()))
    for small in (0, 1000):
        monkeypatch.setattr(W, "SMALL", small)
        assert sorted(map(str, QUERIES["j36_paths_between"](spark, folder).collect())) == every


def test_region_keeps_repeated_edges_once(spark):
    rows, e = _graph(spark, 5)
    once, again = (G._region(x, _ids(spark, "n0", "n1"), _ids(spark, "n2", "n3"), 3).collect() for x in (e, e.unionByName(e)))
    assert sorted(map(str, once)) == sorted(map(str, again)) and len(set(again)) == len(again)


def test_v_pattern_gives_each_pair_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Pairs with several shared targets, repeated edges, other relations, and targets whose sources are dealt over blocks."""
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(40)}", f"t{rng.randrange(6)}", rng.choice("RRQ")) for _ in range(160)] * 2
    near = lambda rel: {(a, t) for a, t, r in rows if r == rel}
    monkeypatch.setattr(G, "BLOCK", 4, raising=False)
    for left, right in (("R", "R"), ("R", "Q")):
        want = sorted({(a, b) for a, t in near(left) for b, u in near(right) if t == u and a < b})
        found = G.v_pattern(edges(spark, *rows), left, right)
        assert sorted((r.a, r.b) for r in found.collect()) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not plan.startswith("Aggregate")
        some = spark.createDataFrame(want[:5], "a string, b string")
        assert sorted((r.a, r.b) for r in G.v_pattern(edges(spark, *rows), left, right, some).collect()) == want[5:]
