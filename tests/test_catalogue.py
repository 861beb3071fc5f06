"""Rules behind the catalogue queries on small inputs."""

from pyspark.sql import functions as F

from quillgraph.functions import domain as D
from quillgraph.functions import text as X
from quillgraph.operators import links as L
from quillgraph.operators import schema as SC


def test_question_numbers_of_every_form(spark):
    text = "头\n1、甲 乙\n第 2. 丙\n（ 3 ）丁\n(4) x\n题目5题 戊\n第6题己\n7．中文\nno 8、 mark\n1234、too long\n12 .y"
    rows = spark.createDataFrame([(text,), (None,), ("",), ("3、",)], "t string").select(D.numbered_questions(F.col("t")).alias("q")).collect()
    assert [(q.number, q.text) for q in rows[0].q] == [(1, "甲 乙"), (2, "丙"), (3, "丁"), (4, "x"), (5, "戊"), (6, "己"), (7, "中文\nno 8、 mark\n1234、too long"), (12, "y")]
    assert rows[1].q == rows[2].q == [] and [(q.number, q.text) for q in rows[3].q] == [(3, "")]


def test_title_lookup(spark):
    titles = spark.createDataFrame([(1, "Grand Customs Act"), (2, "Customs Act"), (3, "Grand Tax"), (4, "Tax"), (5, None), (6, "Grand Customs Act")], "target int, title string")
    refs = spark.createDataFrame([(1, "Customs Act"), (2, "Grand Customs Act"), (3, "Grand Tax"), (4, "Tax"), (5, None), (6, "Grand")], "id int, ref string")
    got = sorted(map(tuple, L.title_lookup(refs, titles, "Grand ").collect()))
    assert got == [(1, "Customs Act", 2, "title"), (2, "Grand Customs Act", 1, "title"), (3, "Grand Tax", 3, "title")]  # Tax is too short
    short = L.title_lookup(refs, titles.filter("target = 1"), "Grand ").filter("id = 1").collect()
    assert [tuple(r) for r in short] == [(1, "Customs Act", 1, "short")]


def test_schema_files(spark):
    df = spark.createDataFrame([("a", "CREATE NODE TABLE A(id STRING, n MAP(STRING, INT64));\n\nCREATE REL TABLE GROUP R(FROM A TO A, FROM A TO B)"), ("b", None), ("c", "nothing")], "path string, text string")
    got = sorted((r.path, r.kind, r.name, r.line, tuple(r.columns)) for r in SC.ddl_file_tables(df).collect())
    assert got == [("a", "NODE", "A", 1, ("id", "n")), ("a", "REL", "R", 3, ())]


def test_links_and_topics(spark):
    text = "# Top One\n[a](b.md) ![i](x.png) [](c) [no] (d)\n### deep\n## two\n# top one"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(X.markdown_links(F.col("t")).alias("l"), X.topics(X.markdown_headings(F.col("t"))).alias("t")).collect()
    assert [tuple(x) for x in r[0].l] == [("a", "b.md"), ("", "c")] and r[0].t == ["top one", "two"]
