"""Splitters, parsers, file sources and streams."""

import json

import pandas as pd
from pyspark.sql import functions as F

from quillgraph.functions import split as SP
from quillgraph.operators.ingest import first_per_window, upsert
from quillgraph.sources import files
from quillgraph.streaming import streams


def test_numerals():
    assert [SP.numeral(x) for x in ("十", "十二", "二十一", "一百零三", "7", "x")] == [10, 12, 21, 103, 7, 0]


def test_articles_and_sections():
    body = "本条内容依照本法第三条规定执行，应当符合要求并且长度超过三十个字符以便保留下来。"
    text = f"第一条 【总则】{body}\n第二条 短\n第十条 {body}"
    assert [(a, t, r) for a, _, t, _, r in SP.split_clauses(text)] == [(1, "总则", "art3"), (10, "", "art3")]
    three = "".join(f"\n{n}、{body}" for n in "一二三")
    assert [a for a, *_ in SP.split_clauses(three)] == [1, 2, 3]
    assert SP.split_clauses(three[: len(three) // 2]) == [] == SP.split_clauses(None)


def test_parts_and_subjects():
    part = "这一项的内容需要超过二十个字符才能被保留下来所以写长一点"
    text = f"{part}{part}（一）{part}（二）{part}"
    assert [n for n, _ in SP.split_parts(text)] == ["", "（一）", "（二）"]
    assert SP.subjects("销售/管理/制造费用") == [("销售费用", "alternative"), ("管理费用", "alternative"), ("制造费用", "alternative")]
    assert SP.subjects("as_库存现金 (x) + 银行存款") == [("库存现金", "additive"), ("银行存款", "additive")]
    assert SP.subjects("应交税费") == [("应交税费", "atomic")] and SP.subjects(None) == []


def test_markdown_sections():
    got = SP.sections("# A\na b\n## B\nc\n## C\n# D\nd e f")
    assert [(h, lv, s, e, w) for _, h, lv, s, e, w in got] == [("A", 1, 1, 5, 7), ("B", 2, 3, 4, 1), ("C", 2, 5, 5, 0), ("D", 1, 6, 7, 3)]


def test_code_symbols():
    src = "import os\nfrom a.b import c\nclass K(Base):\n    def m(self):\n        f(); f()\ndef g():\n    return K().m()\n"
    rows = SP.python_symbols("p.py", src)
    assert [(r[2], r[3]) for r in rows if r[0] == "symbol"] == [("K", "class"), ("m", "method"), ("g", "function")]
    assert [r[2] for r in rows if r[0] == "call"] == ["f", "m", "K"] or {r[2] for r in rows if r[0] == "call"} == {"f", "m", "K"}
    assert [r[2] for r in rows if r[0] == "base"] == ["Base"] and SP.python_symbols("x", "def (") == []
    js = SP.script_symbols("a.ts", "export class A extends B {}\nfunction f() {}\nexport const g = (x) => x\ninterface I {}")
    assert [(k, n, line, e) for k, _, n, line, e in js] == [("class", "A", 1, True), ("function", "f", 2, False), ("arrow", "g", 3, True), ("interface", "I", 4, False)]


def test_diff_and_journal():
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n"
    assert SP.added_lines(diff) == [("x", 2, "b"), ("x", 3, "d")]
    assert SP.journal_blocks("销售\n借：现金\n贷：收入\n\n其他\n借：x\n") == [(0, "销售", 2), (1, "其他", 1)]


def test_explode_with_handles_empty(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, "plain")], "id int, t string")
    out = SP.explode_with(df, SP.sections, ["t"], "idx int, heading string, level int, a int, b int, words int")
    assert [(r.id, r.heading) for r in out.collect()] == [(1, "A")]


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01 00:00:00", "n": 1}\nbroken\n{"ts": "2024-02-01 00:00:00", "n": 2}\n')
    assert [r.n for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), "ts string, n long", since="2024-01-15").collect()] == [2]
    (tmp_path / "doc.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}]))
    assert files.json_documents(spark, str(tmp_path / "doc.json"), "id string").count() == 2
    for name in ("src/a.py", "src/node_modules/b.py", "src/c.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in files.text_tree(spark, str(tmp_path / "src"), ["py"]).collect()] == ["a.py"]
    lines = spark.createDataFrame([("s", 1, "Goods"), ("s", 2, "Tea 13.0%"), ("s", 3, "Services"), ("s", 4, "Rail 9%")], "f string, i int, t string")
    assert [(r.section, r.item, r.rate) for r in files.sheet_rates(lines, "f", "i", "t").orderBy("rate").collect()] == [("Services", "Rail", 9.0), ("Goods", "Tea", 13.0)]


def test_rate_limit_batch_and_stream(spark, tmp_path):
    times = [0, 10, 20, 61, 122, 130, 131]
    rows = pd.DataFrame({"client_ip": "a", "event_id": range(len(times)), "ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t) for t in times]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    batch = first_per_window(spark.read.parquet(str(tmp_path / "in")), "client_ip", "ts", most=2)
    want = [r.refused for r in batch.orderBy("event_id").collect()]
    assert want == [False, False, True, False, False, False, True]
    stream = spark.readStream.schema("client_ip string, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.rate_limited(stream, most=2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.refused for r in spark.table("limited").orderBy("ts").collect()] == want


def test_windowed_counts_and_sink(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", k) for h in range(4) for k in ("x", "y")]
    spark.createDataFrame(rows, "ts string, k string").select(F.col("ts").cast("timestamp"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.n for r in spark.table("counted").collect()} <= {1}
    sink = streams.merge_sink(str(tmp_path / "table"), "k", upsert)
    for number, data in enumerate([[("a", 1)], [("a", 2), ("b", 3)], [("a", 2), ("b", 3)]]):
        sink(spark.createDataFrame(data, "k string, v int"), number)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table/v2")).collect())) == [("a", 2), ("b", 3)]
