"""Corpus operators against plain versions, round trips and held-out rows, with the odd inputs each one defines."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann, chat, components, html_wrappers, line_dedup, media_ts, mixing, ngram_join, quality, queries, sharding, spm_dropout
from quillgraph.llm.common import among, global_rank

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and a column with a clashing name."""
    text = "one two three four five six seven\n" * 40
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, None), (2, text, "en", "s", 1, "x"), (2, text, "en", "s", 1, "x"), (3, text, None, "s", 1, "y"), (4, "w " * 50_000, "en", None, 2, "z"), (5, "a", "en", "t", 1, ""), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    x = spark.range(n).select("id", sharding.permute(F.col("id"), n, 5).alias("p")).withColumn("back", sharding.permute(F.col("p"), n, 5, inverse=True))
    rows = x.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards(spark, docs):
    got = queries.op1_sharding(spark, FOLDER).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(docs) and sizes.max() - sizes.min() <= 1 and len(sizes) == 40
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    want = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text)}
    assert {r.doc_id: (r["size"], r.text_crc32) for _, r in got.iterrows()} == want
    again = queries.op1_sharding(spark, FOLDER).toPandas()
    assert got.sort_values("doc_id")["slot"].tolist() == again.sort_values("doc_id")["slot"].tolist()


def test_shards_odd(spark):
    got = sharding.shard_table(odd(spark), shards=3).toPandas()
    assert len(got) == 8 and sorted(got.groupby("shard").size()) == [2, 3, 3] and got["size"].min() == 16
    assert sharding.shard_table(odd(spark).limit(0)).count() == 0
    place = spark.range(100).select("id", *sharding.place(F.col("id"), 100, 7, 3)).toDF("id", "shard", "slot")
    assert place.filter(sharding.row_at(F.col("shard"), F.col("slot"), 100, 7, 3) != F.col("id")).count() == 0


def test_global_rank(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("é",)], "s string")
    assert [(r.s, r["rank"]) for r in global_rank(df, [F.col("s")]).orderBy("rank").collect()] == [("a", 0), ("b", 1), ("é", 2), (None, 3)]


# media


def test_transport_stream():
    for n in (64, 128, 192, 4096, media_ts.UNIT, media_ts.UNIT + 64, 3 * media_ts.UNIT):
        data = os.urandom(n)
        s = media_ts.demux(media_ts.mux(data))
        assert s.payload == data and s.continuity_errors == 0 and len(s.timestamps) == len(s.random_access) == -(-n // media_ts.UNIT)
    m = media_ts.mux(os.urandom(6400))
    p = media_ts.PACKET
    assert media_ts.demux(m[: 10 * p] + m[9 * p : 10 * p] + m[10 * p :]).duplicates == 1
    with pytest.raises(ValueError):
        media_ts.demux(m[: 5 * p] + m[6 * p :])
    with pytest.raises(ValueError):
        media_ts.demux(m[:p] + b"x" + m[p + 1 :])


def test_media_digests(spark, docs):
    got = {r.doc_id: r for r in queries.op2_media_ts(spark, FOLDER).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        raw = t.encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    rows = media_ts.media_digests(odd(spark)).collect()
    assert len(rows) == 8 and sum(r.payload_bytes == 64 and r.n_bytes == 0 for r in rows) == 3
    back = media_ts.media_column(odd(spark)).select("doc_id", media_ts.load("media").alias("m")).filter("doc_id = 5").first().m
    assert bytes(back.payload) == b"a".ljust(64, b"\0")


# mixing


def targets(sizes, share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        out = {s: most * sizes[s] if s in full else left * w[s] / free for s in order}
        more = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not more:
            return out
        full |= more


def test_mixing(spark, docs):
    got = queries.op3_mixing(spark, FOLDER).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    assert (got["size"] == got.text.map(lambda t: len(WORD.findall(t)))).all() and (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    want = targets(got.groupby("source")["size"].sum().to_dict())
    for s, g in got.groupby("source"):
        assert math.isclose(g.target.iloc[0], want[s], rel_tol=1e-9) and g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - want[s]) <= max(0.03 * want[s], g["size"].min() * 2)
    again = queries.op3_mixing(spark, FOLDER).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_rates_differ_inside_a_source(spark, docs):
    """Rates are the prior times one multiplier a source, held at two, and meet the target: no closed form gives them."""
    got = mixing.mix(spark.createDataFrame(docs)).toPandas()
    prior = np.where(got["size"] < 64, 0.5, 1.0)
    free = 0
    for s, g in got.assign(prior=prior).groupby("source"):
        low, high = 0.0, 1e6
        for _ in range(200):
            tilt = (low + high) / 2
            low, high = (tilt, high) if (g["size"] * np.minimum(2, g.prior * tilt)).sum() < g.target.iloc[0] else (low, tilt)
        rate = np.minimum(2, g.prior * tilt)
        assert ((g.copies >= np.floor(rate - 1e-6)) & (g.copies <= np.ceil(rate + 1e-6))).all()
        free += (g.target.iloc[0] < 1.99 * g["size"].sum()) and g.prior.nunique() > 1 and rate.nunique() > 1
    assert free


def test_mixing_odd(spark):
    m = mixing.mix(odd(spark)).toPandas()
    assert len(m) == 8 and (m.taken <= 2 * m["size"]).all() and set(m.source.dropna()) == {"s", "t"}
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    out = mixing.mixed(odd(spark))
    assert out.columns == odd(spark).columns and out.filter("doc_id = 4").count() <= 2


BIG = (1 << 60) + 1


def test_large_ids_beside_null_ones(spark):
    """No id goes through a float: rows with null ids stand in the same batch."""
    rows = [(BIG, "w " * 40 + "a", "s", [1.0, 0.0]), (None, "w " * 30 + "b", "s", [2.0, 0.0]), (BIG + 1, "w " * 40 + "a", "s", [1.0, 1.0]), (100 * BIG % (1 << 61) // 100 * 100, "q", "s", [1.0, 0.5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, v array<double>").coalesce(1)
    ids = sorted(r[0] for r in rows if r[0])
    assert sorted(r.doc_id for r in mixing.mix(df).collect() if r.doc_id is not None) == ids
    linked = {r.doc_id: r.component_id for r in ngram_join.linked(df).collect()}
    assert linked[BIG] == linked[BIG + 1] == BIG and sorted(i for i in linked if i is not None) == ids
    found = [r.vec_id for r in ann.nearest(df, "doc_id", "v").collect()]
    assert len(found) == 3 and set(found) == {BIG, BIG + 1, None}


def test_mixed_rows_equal_the_copies_of_the_mix(spark):
    rows = [(1, "a b c d e f g", "s", i) for i in range(9)] + [(2, "x y z", "s", 0), (3, None, "t", 0), (3, None, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    out = mixing.mixed(df).collect()
    assert Counter(r.doc_id for r in out) == +want and max(Counter(out).values()) <= 2


def test_balance_with_priors(spark):
    cells = spark.createDataFrame([("a", 1.0, 100.0), ("a", 0.5, 100.0), ("b", 1.0, 10.0)], "source string, prior double, tokens double")
    t = spark.createDataFrame([("a", 350.0), ("b", 2.0)], "source string, target double")
    lam = {r.source: r["lambda"] for r in mixing.balance(cells, t).collect()}
    assert math.isclose(sum(m * min(2, p * math.exp(lam["a"])) for p, m in ((1, 100), (0.5, 100))), 350, rel_tol=1e-8) and math.isclose(10 * math.exp(lam["b"]), 2, rel_tol=1e-8)


# line dedup


def test_matches_come_from_fingerprints(spark, monkeypatch):
    """Without the right fingerprints nothing is deleted; the answer is theirs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    gone = lambda: line_dedup.dedup_lines(docs, removed="n").agg(F.sum("n")).first()[0]
    assert gone() > 0
    made = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda *a: made(*a).withColumn("g", F.xxhash64("d", "t", "j")))
    assert gone() == 0


def test_line_dedup(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    block = "\n".join(words(f"p{j}", 13) for j in range(4))
    rows = [
        (1, words("a", 30) + "\n" + block + "\n" + words("b", 30)), (2, words("c", 9) + "\n" + block + "\n\n" + words("d", 5)), (3, words("long", 51)), (4, "x\n" + words("long", 51)),
        (5, words("s", 20)), (6, words("s", 20)), (7, None), (8, ""), (9, block), (9, block), (None, words("n", 60)), (10, words("n", 60)), (11, "tick\n" * 200),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit("clash"))
    out = line_dedup.dedup_lines(df, removed="gone")
    assert out.columns == ["doc_id", "text", "d", "gone"] and out.count() == len(rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == rows[0][1] and got[2] == words("c", 9) + "\n\n" + words("d", 5) and got[3] == rows[2][1] and got[4] == "x"
    assert got[5] == got[6] == words("s", 20) and got[7] is None and got[8] == "" and got[9] == "" and got[None] == words("n", 60) and got[10] == ""
    assert 0 < len(got[11].split("\n")) < 60
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_finds_every_long_run(spark, docs):
    got = {r.doc_id: r for r in queries.op4_line_dedup(spark, FOLDER).collect()}
    seen = {}
    for i, t in zip(docs.doc_id, docs.text):
        lines = [x for x in t.split("\n") if x.split()]
        kept, had = Counter(got[i].text.split("\n")), Counter(t.split("\n"))
        for a in range(len(lines)):
            run, n = [], 0
            for x in lines[a:]:
                run.append(x)
                n += len(x.split())
                if n > 50:
                    break
            if n > 50:
                if seen.setdefault(tuple(run), i) != i:
                    assert all(kept[x] < had[x] for x in run)
    earlier = set()
    for i, t in zip(docs.doc_id, docs.text):
        for x, c in (Counter(t.split("\n")) - Counter(got[i].text.split("\n"))).items():
            assert not x.split() or x in earlier or Counter(t.split("\n"))[x] > c
        earlier.update(t.split("\n"))


def plain_runs(rows, least=50):
    """Texts without the lines of each run of `least` words that stands at an earlier place too, by all pairs of places."""
    order = sorted(rows, key=lambda r: r[0])
    lines = [[(n, x, len(x.split())) for n, x in enumerate(t.split("\n")) if x.split()] for _, t in order]
    out = {}
    for e, (doc, t) in enumerate(order):
        gone = set()
        for d in range(e + 1):
            for off in range(1 - len(lines[e]), len(lines[d])):
                if d == e and off >= 0:
                    continue
                run = []
                for j in range(len(lines[e]) + 1):
                    if j < len(lines[e]) and 0 <= j + off < len(lines[d]) and lines[e][j][1] == lines[d][j + off][1]:
                        run.append(lines[e][j])
                        continue
                    if run and sum(w for _, _, w in run) >= least:
                        gone |= set(range(run[0][0], run[-1][0] + 1))
                    run = []
        out[doc] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def test_line_dedup_equals_all_pairs_of_places(spark):
    """Runs whose first lines also stand earlier without the rest: a document's run is met by a later place than the first."""
    rng = np.random.default_rng(3)
    words = lambda k, n: " ".join(f"{k}_{i}" for i in range(n))
    rows = []
    for k in range(40):  # a alone, then a and b twice
        a, b = words(f"a{k}", 30), words(f"b{k}", 25)
        rows += [(10 * k, a), (10 * k + 1, f"x{k}\n{a}\n\n{b}\ny{k}"), (10 * k + 2, f"z{k} z\n{a}\n\n{b}\nw{k}")]
    pool = [words(f"p{i}", int(rng.choice([1, 3, 9, 20, 26, 30, 49, 50, 60]))) for i in range(14)] + ["", " "]
    rows += [(1000 + i, "\n".join(rng.choice(pool, int(rng.integers(1, 14))))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_runs(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


# tokens


def test_pieces_without_dropout_equal_the_library(docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=spm_dropout.MODEL)
    e = spm_dropout.Encoder(spm_dropout.Pieces(), 0.0)
    texts = [*docs.text[:80], "Hello  world", "  a b ", "a\nb\n\n", "日本 \x00 z é", "", "a\r\n\tb", " ", "\n", "x" * 3000, "ab " * 50, "<s> </s> <0x0A>"]
    for t in texts:
        assert np.frombuffer(e.encode(t), np.int32).tolist() == m.encode(t), t[:40]


def test_dropout_is_lossless_seeded_and_varied(docs):
    p = spm_dropout.Pieces()
    a, b, c = (spm_dropout.Encoder(p, 0.1, s) for s in (1, 1, 2))
    texts = [*docs.text[:60], "▁x a▁ b▁▁", "y" * 2000, "ﬁ ﷺ 🙂", "tokenization " * 40]
    one = a.encode_all(texts, list(range(len(texts))))
    assert one == [b.encode(t, i) for i, t in enumerate(texts)] != [c.encode(t, i) for i, t in enumerate(texts)]
    for t, ids in zip(texts, one):
        assert spm_dropout.decode(p, np.frombuffer(ids, np.int32)) == t
    assert one[-1] != spm_dropout.Encoder(p, 0.0).encode(texts[-1])


def test_dropout_draws_each_use_anew(docs):
    """Every word is split somewhere, no more often than a merge is skipped, and many copies of a text give many encodings."""
    p = spm_dropout.Pieces()
    e, plain = spm_dropout.Encoder(p, 0.1, 1), spm_dropout.Encoder(p, 0.0)
    words = [w for w in sorted({w for t in docs.text[:40] for w in t.split()}) if w.isascii() and w.isalpha() and len(plain.encode(w)) == 4][:40]
    assert len(words) == 40
    for w in words:
        merges = len(w)  # with the space before it, down to one piece
        split = sum(e.encode(w, k) != plain.encode(w) for k in range(1500)) / 1500
        assert 0 < split < 1 - (1 - 26 / 256) ** merges + 0.06, w
    text = " ".join(words)
    assert len({e.encode(text, k) for k in range(200)}) == 200
    same = np.frombuffer(e.encode(f"{words[0]} " * 2000), np.int32)
    assert len(same) > 2000 * 1.05


def plain_dropout(pieces, text, key, seed, limit):
    """The agenda in its plainest form: draws one by one from the hash's definition, the best pair found by looking at all."""
    import xxhash

    mask, out = (1 << 64) - 1, []

    def draw(base, place, k):
        if k >= 16:
            return xxhash.xxh3_128_digest((k // 16).to_bytes(8, "little") + place.to_bytes(8, "little"), seed=base)[k % 16]
        x = (base + (2 * place + 1 + k // 8) * 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return (x ^ x >> 31) >> 8 * (k % 8) & 255

    base = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"), seed=seed)
    for place, chunk in enumerate(pieces.chunks(" " + text) if text else []):
        parts, dead, k = list(chunk), set(), 0  # dead: pairs of spans whose merge was skipped
        spans = [(i, i + 1) for i in range(len(chunk))]
        while True:
            pairs = [(-pieces.ids[a + b][1], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in pieces.ids and (spans[i], spans[i + 1]) not in dead]
            if not pairs:
                break
            _, i = min(pairs)
            k += 1
            if draw(base, place, k - 1) < limit:
                dead.add((spans[i], spans[i + 1]))
                continue
            parts[i : i + 2], spans[i : i + 2] = [parts[i] + parts[i + 1]], [(spans[i][0], spans[i + 1][1])]
        for p in parts:
            out += [pieces.ids[p][0]] if p in pieces.ids else [pieces.byte_ids[b] for b in p.encode()]
    return out


def test_dropout_equals_the_plain_agenda(docs):
    p = spm_dropout.Pieces()
    texts = [*docs.text[:12], "▁x a▁ b▁▁ é 日本 ﬁ🙂 \x00", "internationalization" * 4 + " " + "z" * 200, "", "a\r\n\tb  c"]
    for dropout in (0.1, 0.5):
        e = spm_dropout.Encoder(p, dropout, 9)
        for k, (t, ids) in enumerate(zip(texts, e.encode_all(texts, [7 * k for k in range(len(texts))]))):
            assert np.frombuffer(ids, np.int32).tolist() == plain_dropout(p, t[:3000], 7 * k, 9, round(dropout * 256)) or len(t) > 3000, t[:40]


def test_tokens_query(spark, docs):
    p = spm_dropout.Pieces()
    got = {r.doc_id: r for r in queries.op5_sentencepiece(spark, FOLDER).collect()}
    assert set(got) == set(docs.doc_id)
    for i, t in zip(docs.doc_id, docs.text):
        assert got[i].n_ids == len(got[i].ids) and spm_dropout.decode(p, got[i].ids) == t


def test_kept_segmentations_equal_fresh_ones(docs, monkeypatch):
    p, texts = spm_dropout.Pieces(), [*docs.text[:60], "z" * 300, "unbelievablyinternationalization " * 30]
    kept = spm_dropout.Encoder(p, 0.3, 2).encode_all(texts, list(range(len(texts))))
    monkeypatch.setattr(spm_dropout, "CACHE", 1)
    assert kept == spm_dropout.Encoder(p, 0.3, 2).encode_all(texts, list(range(len(texts))))


def test_segmented_odd(spark):
    out = spm_dropout.segmented(odd(spark).withColumn("ids", F.lit(1)))
    back = spm_dropout.decode_column(out).select("doc_id", "text", "n_ids", "decoded").collect()
    assert len(back) == 8 and all((r.text or "") == r.decoded for r in back) and all(r.n_ids == 0 for r in back if not r.text)


# pages


def test_wrapper_and_text():
    page = lambda title, *ps: f"<html><head><title>{title}</title></head><body><div class=top><a href=/>Home</a></div><div class=body><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</div><div class=foot>Same</div></body></html>"
    pages = [page("T1", "a", "b"), page("T2", "c"), page("T3", "d", "e", "f")]
    w = html_wrappers.infer(pages)
    regex, keys = html_wrappers.expression(w)
    for p in pages:
        stream = html_wrappers._stream(p)
        assert re.fullmatch(regex, "".join("t" if n[0] == "text" else chr(0xE000 + keys.index(n[1])) for n in stream))
    assert html_wrappers.content_element(pages, html_wrappers.template_texts(w, pages)) == "div.body"
    assert html_wrappers.extract(pages[2], "div.body") == "T3\n\nd\n\ne\n\nf"
    full = "<body><header class=site>H</header><div class='cookie-notice'>C</div><main><article><header><h1>T &amp; x</h1></header><p>a<br>b <a>c</a>d</p><aside>s</aside><form>f</form><script>var x='</p>'</script><ul><li>1<li>2</ul><section id=comments><p>cc</p></section><p>&nbsp;z &lt;p&gt;</article></main><footer>F"
    assert html_wrappers.extract(full) == "T & x\n\na b cd\n\n1\n\n2\n\nz <p>"
    assert html_wrappers.extract(None) == "" == html_wrappers.extract("<p>") and html_wrappers.extract("plain  text") == "plain text"


def test_names_and_attributes():
    """Furniture by whole names and real attributes only; text decoded token by token; inline adverts; MathML stays."""
    cases = [
        ('<div title="hidden gems">g</div><section aria-label="hidden costs">c</section><i data-hidden="false">k</i>', "g\n\nc\n\nk"),
        ('<div class="legal-analysis">la</div><div class="share-prices">sp</div><div id="promo-chart">pc</div>', "la\n\nsp\n\npc"),
        ("x <math><mi>x</mi><mo>=</mo><mn>1</mn></math> y AT&amp<b>lt;</b>", "x x=1 y AT&lt;"),
        ('a<span class="advert">AD <span>more</span> x</span> b<div class="comment-list">cc</div><p hidden>h</p><p style="display: none">n</p>', "a b"),
        ('<header class="entry-header"><h1>T</h1></header><p>a<nav>n</nav><p>b', "T\n\na\n\nb"),
    ]
    for inside, want in cases:
        rest = "<p>and a closing paragraph of the article</p>"
        page = f"<body><div class='layout has-sidebar'><article>{inside}{rest}</article><div class=sidebar>s</div></div><footer>f</footer>"
        assert html_wrappers.extract(page) == f"{want}\n\nand a closing paragraph of the article", inside
    assert html_wrappers.extract('<div class="notice"><p>only text</p></div>') == "only text"
    assert html_wrappers.extract('<div class="comments"><p>only</p></div><nav>menu of the page</nav>') == "only"
    assert html_wrappers.extract("<div>" * 5000 + "deep" + "<p>" * 5000 + "er") == "deep\n\ner"


def test_templates_without_article(spark):
    """Content by the pages' own text: bylines and headings stay, menus, template lines and side boxes go; long pages too."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        ps = [text(30) for _ in range(1 + 3 * k if k < 11 else 3000)]
        title = text(4)
        body = f"<div class=post><h1>{title}</h1><div class=body>{''.join(f'<p>{p}</p>' for p in ps)}</div><p>Share this story with friends</p></div>"
        menu = "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(900))
        rows.append((k, f"http://Host.example/{k}", f"<html><body><div class=top><ul>{menu}</ul></div><div class=ad>{text(5)}</div><div class=cols>{body}<div class=widget-area>{text(3)}</div></div><div class=foot>Same foot</div></body></html>"))
        want[k] = "\n\n".join([title, *ps])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.main_texts(df).collect()}
    assert {k for k in want if got[k] != want[k]} == set()
    # pages that repeat each other keep their text
    same = spark.createDataFrame([(k, "http://h/", f"<body><p>{text(1)}</p><div class=b><p>always the same article text, many words long</p></div>") for k in range(9)], "page_id long, url string, html string")
    assert all("always the same article" in r.text for r in html_wrappers.main_texts(same).collect())
    # a layout with an article beside one without, on one host
    mixed = rows + [(100 + k, f"http://host.example/a{k}", f"<body class=x{k}><div class=top>menu</div><article><p>own {k} words</p></article>") for k in range(6)]
    got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(mixed, "page_id long, url string, html string")).collect()}
    assert all(got[100 + k] == f"own {k} words" for k in range(6)) and got[3] == want[3]


def test_pages_query(spark):
    got = queries.op6_html(spark, FOLDER).toPandas()
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet").set_index("page_id")
    import html

    for r in got.itertuples():
        article = re.search(r"<article>(.*?)</article>", pages.html[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x.replace("<b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    rows = spark.createDataFrame([(1, None, None), (2, "odd", "<p>x"), (2, "odd", "<p>x")], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_wrappers.main_texts(rows).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_wrappers.main_texts(rows.limit(0)).count() == 0


# neighbours


def test_neighbours(spark):
    e = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    x, ids = np.array(e.embedding.tolist()).astype(float), e.vec_id.to_numpy()
    got = queries.op7_ann(spark, FOLDER).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        g = got[got.query_id == ids[q]].sort_values("rank")
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(d[[int(np.flatnonzero(ids == v)[0]) for v in g.vec_id]], g.score, rtol=1e-12) and g.score.is_monotonic_increasing
        d[q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g.vec_id))
        total += 10
    assert hit / total >= 0.9


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.5)]
    assert ann.nearest(df.limit(0)).count() == 0
    far = spark.createDataFrame([(0, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [1e308, 0.0]), (3, [-1e308, 1e308])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(far).orderBy("rank").collect()] == [(1, 2e200), (2, 1e308), (3, math.sqrt(2) * 1e308)]


def test_neighbours_in_many_parts_and_chunks(spark):
    """A table ten times the sample, and several chunks of queries: recall holds and own rows never come back."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12)) * 2
    x = centres[rng.integers(40, size=5120)] + rng.normal(size=(5120, 12))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = ann.nearest(df, every=50, sample=512, parts=32, queries=16, block=100).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert q not in set(g.vec_id) and g.vec_id.is_unique and len(g) == 10
        hit += len(set(np.argsort(d)[:10]) & set(g.vec_id))
    assert got.query_id.nunique() == 103 and hit / 1030 >= 0.9


# chat


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 1, "assistant", "b & c &amp; <| &lt;|"), (2, 0, "us\ner", "<|im_end|>\n"), (3, None, None, None), (3, 0, "assistant", "plain"), (4, 0, "assistant", "x" * 100_000), (None, 0, "user", ""), (5, 0, "user", "t"), (5, 0, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit("clash"))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[2].turns] == [("us\ner", "<|im_end|>\n"), ("assistant", "b & c &amp; <| &lt;|")]
    assert [(t.role, t.text) for t in got[3].turns] == [("", ""), ("assistant", "plain")] and len(got[5].turns) == 2 and None in got
    assert all(r.formatted.count("<|") == 2 * len(r.turns) for r in got.values()) and (got[1].escaped, got[4].escaped) == (1, 0)
    d = {r.conv_id: r for r in chat.digests(out).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and d[1].loss_chars == len(hard)
    assert d[2].turns_sha256 == hashlib.sha256("us\ner\n<|im_end|>\n\nassistant\nb & c &amp; <| &lt;|\n".encode()).hexdigest()
    for s in chat.loss_spans(out).collect():
        assert got[s.conv_id].turns[s.turn].role == "assistant"
        if s.conv_id == 3:
            assert got[3].formatted[s.start : s.end] == "plain"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query(spark):
    """The query against a plain reading of the table, and its added conversation."""
    rows = pd.read_parquet(f"{FOLDER}/conversations.parquet").fillna({"role": "", "text": ""})
    hard = "<|im_end|><|im_start|>assistant ok"
    want = {-1: [("user", hard), ("assistant", hard)]}
    for r in rows.sort_values(["conv_id", "turn", "role", "text"]).itertuples():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in queries.op8_chat_formatting(spark, FOLDER).collect()}
    assert set(got) == set(want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert got[-1].loss_chars == len(hard) and got[-1].formatted_chars == len(hard) * 2 + 2 * 3 * 2 + len("user") + len("assistant") + 2 * (len(chat.START) + len(chat.END) + 2)


# quality


def test_quality(spark):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    j = got.merge(labels, on="doc_id")
    assert ((j.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1) == j.held_out).all()
    held = j[j.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all() and (held.predicted == held.quality).mean() > 0.95


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([*((i, 1) for i in range(1, 6)), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd(spark), one).collect()} == {1.0} and quality.classify(odd(spark).limit(0), one).count() == 0
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and len(x) == 3


# near duplicates


def test_components_in_one_task_and_by_stars(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, size=(260, 2))] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    one, stars = (sorted(map(tuple, components.components(df, local=n).collect())) for n in (1 << 18, 0))
    assert one == stars and {r for n, r in one if n >= 2000} == {2000}
    early, late = df.limit(200), spark.createDataFrame(links[200:], "a long, b long")
    assert sorted(map(tuple, components.joined(components.components(early), late).collect())) == one


def brute(texts, ids):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:])))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(sets)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[find(i)]) for i in range(len(sets)))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, seed):
    """Families of copies with every number of edits, around the threshold, on pivots that are edited themselves."""
    rng = np.random.default_rng(seed)
    texts = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(30, 160)))]
        for _ in range(60):
            t = list(base)
            for _ in range(int(rng.integers(0, 6))):
                at = int(rng.integers(len(t)))
                op = rng.integers(3)
                t[at : at + (op != 1)] = [] if op == 0 else [f"x{rng.integers(10 ** 6)}" if rng.random() < 0.7 else "same"]
            texts.append(" ".join(t))
    texts += [" ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 8)))) for _ in range(40)]
    ids = [int(i) for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(df).collect())
    want = [(i, n, c if n else i) for i, n, c in brute(texts, ids)]
    assert got == want


def test_near_query(spark, docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op10_ngram_join(spark, FOLDER).collect())
    assert got == brute(docs.text.tolist(), docs.doc_id.tolist())


@pytest.mark.parametrize("parts", [8, 24, 53])
def test_near_over_many_files(spark, parts):
    """Tasks that read several files, so that batches span them, give the same components."""
    from .. import oracle
    from quillgraph.llm.sql import NGRAM_JOIN

    folder = "/root/testdata/sf0.01"
    held = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sorted(tuple(r) for r in queries.op10_ngram_join(spark, folder).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = oracle.connect(folder).execute(f"SELECT doc_id, n_shingles, component_id FROM ({NGRAM_JOIN})").fetchall()
    assert got == sorted(want)


def test_signatures_of_batches_over_files():
    """Numbers that jump up and down inside a batch come back as they were."""
    c = np.array([5, 6, 7, 3 << 33, (3 << 33) + 1, 8, 9, 2**60, 2**60 + 1])
    sigs = [[1, 2], [2], [3], [1], [3, 4], [4], [5], [5], [6]]
    lists = pa.array([[x << 40 for x in s] for s in sigs], pa.list_(pa.int64()))
    none = pa.array([[]] * len(c), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(c), lists, none], names=["c", "sigs0", "sigs1"])
    packed = pa.Table.from_batches(ngram_join._dealt(1)(iter([batch])))
    out = ngram_join._shared(1)(packed)
    got = sorted(zip((x >> 40 for x in out["sig"].to_pylist()), out["c"].to_pylist(), out["lower"].to_pylist()))
    assert got == sorted((x, int(n), False) for n, s in zip(c, sigs) for x in s if sum(x in t for t in sigs) > 1)


def test_near_odd(spark):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.linked(odd(spark)).collect())
    assert [g[:2] for g in got] == [(-1, 0), (-1, 0), (1, 0), (2, 7), (2, 7), (3, 7), (4, 1), (5, 1)] and {g[2] for g in got if g[1] == 7} == {2}
    kept = ngram_join.keep_one(odd(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "None", "None"] and kept.columns == odd(spark).columns
    assert ngram_join.linked(odd(spark).limit(0)).count() == 0


def test_keep_one_of_null_ids(spark):
    words = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " more"), (None, words("c")), (7, words("c")), (None, words("d")), (None, words("d"))]
    kept = [(r.doc_id, r.text.split()[0]) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == [(7, "c0"), (None, "a0"), (None, "b0"), (None, "d0")]


def test_texts_that_share_passages_are_not_paired(spark, monkeypatch):
    """Texts of one large shared passage and words of their own: far from similar, but all in buckets of one pivot."""
    rng = np.random.default_rng(3)
    common, other = [f"p{i}" for i in range(200)], [f"q{i}" for i in range(60)]
    texts = []
    for k in range(60):
        own = [f"w{k}x{i}" for i in range(90)]
        some = sorted(rng.choice(60, 40, replace=False).tolist())
        texts.append(" ".join(common + [other[i] for i in some] + own))
    texts += [f"{texts[k]} tail{k}" for k in range(0, 60, 7)]
    tried, verified = [], ngram_join._verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.linked(df, n=5, num=4, den=5).collect()}
    assert got == {i: i for i in range(60)} | {60 + i: k for i, k in enumerate(range(0, 60, 7))}
    assert sum(tried[2:]) < len(texts)  # after stars and their exemplars


@pytest.mark.parametrize("n", [0, 3, 300, 1020, 5000])
def test_parities_differ_no_more_than_sets(n):
    rng = np.random.default_rng(n)
    pool = rng.integers(0, 2**63, n + 60).astype(np.uint64)
    for d in (0, 1, 7, 60):
        x, y = np.unique(pool[:n]), np.unique(pool[d // 2 : n + d - d // 2])
        p, q = ngram_join.parities(x), ngram_join.parities(y)
        if len(p) == len(q):
            assert np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(np.setxor1d(x, y))
    assert not len(pool[:n]) or ngram_join.parities(pool[:1]).any()


def test_signatures_meet():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        n = int(np.exp(rng.uniform(0, np.log(900))))
        pool = rng.integers(0, 2**63, n + 200).astype(np.uint64)
        d = int(rng.integers(0, max(1, n // 19) + 2))
        a = int(rng.integers(0, min(d, n - 1) + 1))
        x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[a:n], pool[n : n + int(rng.integers(0, d - a + 1))]]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            assert len(np.intersect1d(ngram_join.signatures(x), ngram_join.signatures(y)))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (105, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[105] == got[101] == got[100] == 100
    assert components.components(e.limit(0)).count() == 0


def test_among_never_loses(spark):
    keys = lambda n: spark.range(n).select("id", F.unhex(F.md5(F.col("id").cast("string").cast("binary"))).alias("key"))
    out = among(keys(2000), "key", keys(300), bits=1 << 15)
    assert {r.id for r in out.collect()} >= set(range(300)) and out.count() < 400
