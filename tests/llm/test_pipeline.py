"""The pipeline's stages: columns, effect of their decisions, and one run from end to end."""

from collections import Counter

import pandas as pd
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from quillgraph.llm import quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[1:5]) and list(stages[5].columns) == ["doc_id", "n_ids", "ids"]


def test_quality_stage_keeps_good(stages):
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    good = [i for i in labels.index if labels[i] == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and len(kept) < len(stages[0])


def test_line_stage(stages):
    assert len(stages[2]) <= len(stages[1]) and (stages[2].n_chars == stages[2].text.str.len()).all()
    assert sum(stages[2].text.str.len()) < sum(stages[1].text.str.len())


def test_near_stage(stages):
    assert stages[3].doc_id.is_unique and set(stages[3].doc_id) <= set(stages[2].doc_id)


def test_mix_stage(stages):
    copies = Counter(stages[4].doc_id)
    assert max(copies.values()) <= 2 and set(copies) <= set(stages[3].doc_id)
    words = lambda d: d.text.str.split().str.len().sum()
    assert abs(words(stages[4]) / words(stages[3]) - 1.5) < 0.1


def test_last_stage_and_run(spark, stages):
    assert Counter(stages[5].doc_id) == Counter(stages[4].doc_id) and (stages[5].n_ids == stages[5].ids.str.len()).all()
    out = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert Counter(out.doc_id) == Counter(stages[5].doc_id)


def test_copies_are_segmented_apart(spark):
    text = "an unremarkable sentence of several ordinary words " * 20
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in corpus_pipeline.sentencepiece(spark, docs, FOLDER).collect()}) == 4


def test_near_stage_takes_five_words_and_four_fifths(spark):
    """Every number of scattered changes: a copy goes if and only if its five-word sets are similar enough."""
    rows, want = [], set()
    for k in range(1, 9):
        words = [f"t{k}w{i}" for i in range(200)]
        changed = [f"x{i}" if i % 20 == 10 and i // 20 < k else w for i, w in enumerate(words)]
        x, y = (set(zip(*(t[i:] for i in range(5)))) for t in (words, changed))
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(changed))]
        want |= {10 * k} | ({10 * k + 1} if 5 * len(x & y) < 4 * len(x | y) else set())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == want and 41 not in want and 51 in want


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names; and no rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None, "a"), (None, None, "en", "s", 0, None), (2, "", "en", "s", 0, "b"), (3, long, "en", "s", len(long), "c"), (3, long, "en", "s", len(long), "c"), (4, "same words here", None, "s", 15, "d"), (4, "same words here", None, "s", 15, "e"), (None, "same words here", "en", None, 15, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").withColumn("n", F.lit(1)).withColumn("copies", F.lit(9)).withColumn("c", F.lit("x"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for some in (docs, docs.limit(0)):
            out = stage(spark, some, FOLDER)
            got = out.collect()
            assert (out.columns == docs.columns or k == 4) and (some is docs or not got), name
    near = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sum(r.text == long for r in near) == 1 and sum((r.text or "") == "same words here" for r in near) == 1 and sum(not r.text for r in near) == 3
    mixed = corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()
    assert max(Counter(map(tuple, mixed)).values()) <= 4 and {r.copies for r in mixed} == {9}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == docs.count()  # no labels: every score is one half
