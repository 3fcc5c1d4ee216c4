"""Main text of pages, nearest neighbours, and the pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import htmlmain, oracle, queries, vptree

from .test_documents import kept_columns


def test_held_out_pages():
    pages = htmlmain.labelled_pages(60, seed=77)
    assert sum(htmlmain.main_text(p) == " ".join(m) for p, m in pages) >= 0.9 * len(pages)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article></article>", ""),
        ("<article><p>A &amp; b&nbsp;c &#233;<br>d</p></article>", "A & b c é d"),
        ('<nav><ul><li><a href="/">x</a></ul></nav><article><h1>T</h1><p>One <b>two</b> three.<p>Four.</article><footer>&copy; z</footer>', "T One two three. Four."),
        ('<article><p>Text here stays.</p><script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><p>And here.</p></article>', "Text here stays. And here."),
        ('<article><p>A long first sentence of the article.</p><div class="ad">Buy now.</div><p>The second one goes on.</p></article><section id="comments"><p>Nice!</p></section>', "A long first sentence of the article. The second one goes on."),
        ("<p", ""),
    ],
)
def test_page(page, text):
    assert htmlmain.main_text(page) == text


@pytest.mark.parametrize("size", [10, 1_900, 2_100, 300_000])
def test_attributes_are_read_whole(size):
    """Long values before the telling attributes hide none of them, and tell nothing themselves."""
    long_ = f'data-state="{("class=ad hidden " * size)[:size]}" srcset=\'{"x" * size}\''
    told = {b.text: b.features for b in htmlmain.blocks(f'<div {long_} class="ad">A</div><div {long_} hidden>B</div><div {long_} id=comments role="note" aria-hidden="true">C</div><div {long_}>D</div>')}
    short = {b.text: b.features for b in htmlmain.blocks('<div class="ad">A</div><div hidden>B</div><div id=comments role="note" aria-hidden="true">C</div><div>D</div>')}
    assert told == short and told["A"] != told["D"] != told["B"]


def test_viterbi_finds_the_best_path():
    chain = htmlmain.chain()
    page = htmlmain.blocks(htmlmain.labelled_pages(1, seed=3)[0][0])[:9]
    s = chain.scores(page)

    def value(path):
        return sum(s[i][y] for i, y in enumerate(path)) + sum(chain.pairs[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max(value([(k >> i) & 1 for i in range(len(page))]) for k in range(1 << len(page)))
    assert value(chain.decode(page)) == pytest.approx(best)


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, "<article><p>Ab cd.</p></article>", "old"), (1, "<article><p>Ab cd.</p></article>", "old"), (None, None, None), (2, "<article>" + "<p>Word word word.</p>" * 20_000, "x")], "page_id long, html string, TEXT string")
    out = htmlmain.extract(pages)
    kept_columns(out, pages, "text")
    got = [r.text for r in out.collect()]
    assert got[0] == got[1] == "Ab cd." and got[2] == "" and len(got[3]) == 20_000 * 16 - 1
    assert htmlmain.extract(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))) * rng.uniform(0.5, 2, (900, 1))
    x[100:400] = x[100]
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] * 16, 1), (None, [1.0] * 16, 1), (2080, [], 1), (40, rows[40][1], 2), (2100, [float("inf")] * 16, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def by_hand(rows, k):
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted((-float(vptree.dot(x[None, :], y[None, :])[0]), i) for i, y in good if i != q)[:k]
    return out


def test_exact_search(vectors, spark):
    want = by_hand([tuple(r) for r in vectors.collect()], 20)
    got = {}
    for r in vptree.nearest(vectors, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, {}).setdefault(r["rank"], (-r.score, r.vec_id))
    assert {q: [v[i + 1] for i in range(len(v))] for q, v in got.items()} == want
    assert vptree.nearest(vectors.limit(0), F.col("id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("kind", ["binary", "one huge", "floats", "repeated ids"])
def test_ties_and_repeated_ids(kind):
    """Any number of distinct vectors that tie, distances that cancel, ids that recur: as sorting all pairs has it."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(1_500, 12)) if kind != "binary" else (rng.random((1_500, 12)) < 0.5).astype(float)
    x[~x.any(axis=1)] = 1
    ids = rng.permutation(1_500)
    if kind == "one huge":
        x[7] *= 1e9
    if kind == "repeated ids":
        x[:40], ids[:30] = x[0], 3
        ids[100:130] = 3
    q, q_ids, k = x[:60].copy(), ids[:60].copy(), 5
    who, found, score = vptree.search_shard(x, ids, q, q_ids, k, float(np.sqrt((x * x).sum(axis=1)).max()), 1.0)
    for i in range(len(q)):
        s = vptree.dot(np.broadcast_to(q[i], x.shape), x)
        want = sorted((-a, b) for a, b in zip(s.tolist(), ids.tolist(), strict=True) if b != q_ids[i])[:k]
        assert [(-a, b) for a, b in zip(score[who == i].tolist(), found[who == i].tolist(), strict=True)] == want, i


@pytest.mark.parametrize("kind", ["clusters", "binary", "small integers", "one vector", "sizes"])
def test_shards_of_one_tree(spark, monkeypatch, kind):
    """Many shards: the same rows as sorting all pairs, ties to the smaller id, whichever leaves are left out."""
    monkeypatch.setattr(vptree, "SHARD_ROWS", 60)
    monkeypatch.setattr(vptree, "rows_of", lambda dim: 60)
    rng = np.random.default_rng(31)
    if kind == "clusters":
        x = rng.normal(size=(9, 8))[rng.integers(0, 9, 1_200)] + 0.02 * rng.normal(size=(1_200, 8))
    elif kind == "binary":
        x = (rng.random((1_200, 8)) < 0.5).astype(float)
    else:
        x = rng.integers(-2, 3, (1_200, 8)).astype(float)
    if kind == "one vector":
        x[: 600] = x[0]
    x[~x.any(axis=1)] = 1
    rows = [(i, v[: 5 + i % 3].tolist() if kind == "sizes" else v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.nearest(df, F.col("id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    good = [(i, np.array(v)) for i, v in rows if any(v)]
    want = {q: sorted((-float(vptree.dot(v[None], w[None])[0]), i) for i, w in good if i != q and len(w) == len(v))[:7] for q, v in good if q % 20 == 0}
    assert got == want


def test_leaves_are_left_out():
    """Of unit vectors in clusters a query reaches few leaves, and those hold all its neighbours."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4_000)] + 0.05 * rng.normal(size=(4_000, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    space = vptree.Space(float(np.sqrt((x * x).sum(axis=1)).max()), np.arange(2_000), x[:2_000], 32)
    leaf, q = space.leaf_of(x), x[::50]
    who, at = space.reached(q, space.radius(q, np.arange(0, 4_000, 50), 10))
    assert space.leaves == 32 and len(who) < 0.5 * len(q) * space.leaves
    dots = q @ x.T
    dots[np.arange(len(q)), np.arange(0, 4_000, 50)] = -np.inf
    reached = set(zip(who.tolist(), at.tolist(), strict=True))
    assert all((i, int(leaf[j])) in reached for i, row in enumerate(np.argsort(-dots, axis=1)[:, :10]) for j in row)


def test_relaxed_search_keeps_most():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 12))[rng.integers(0, 20, 3000)] + 0.2 * rng.normal(size=(3000, 12))
    ids, q = np.arange(3000), np.arange(0, 3000, 30)
    largest = np.sqrt((x * x).sum(axis=1)).max()
    exact = vptree.search_shard(x, ids, x[q], q, 20, largest, 1.0)
    relaxed = vptree.search_shard(x, ids, x[q], q, 20, largest, 1.3)
    pairs = lambda s: set(zip(s[0].tolist(), s[1].tolist(), strict=True))
    dots = x[q] @ x.T
    dots[np.arange(len(q)), q] = -np.inf
    assert pairs(exact) == {(i, j) for i, row in enumerate(np.argsort(-dots, axis=1)[:, :20]) for j in row.tolist()}
    assert len(pairs(exact) & pairs(relaxed)) >= 0.9 * len(pairs(exact))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found = con.execute(oracle.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(map(str, map(tuple, queries.QUERIES[name](spark, sf).select(*columns).collect()))) == want


COLUMNS = {
    "op1_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_quality": "doc_id bigint, score double, keep boolean",
    "op3_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_shard": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op8_tokens": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_decontaminate": "doc_id bigint, item_id bigint, start_word int, similarity double",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    """Columns, types, a row for each row of the table, and what the contracts fix, over sf0.001."""
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == COLUMNS[name]
    got = out.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    crc = lambda x: zlib.crc32(x.encode())
    if name in ("op9_nearest", "op10_decontaminate", "op7_main_text"):
        assert got
        return
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        if name == "op1_language":
            assert r.held_out == (crc(str(r.doc_id)) % 4 == 2) and 0 <= r.score <= 1
        if name == "op2_quality":
            assert 0 <= r.score <= 1 and r.keep == (r.score >= 0.5)
        if name == "op4_shard":
            assert r.size == len(text.encode()) + 16 and r.text_crc32 == crc(text) and r.law == "rows" and r.grown_shard is None
        if name == "op6_lm_score":
            assert r.held_out == (crc(str(r.doc_id)) % 5 == 1) and r.n_tokens == len(text.encode().lower().split()) + 1
        if name == "op8_tokens":
            assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 512)
    if name == "op1_language":
        told = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out and docs[r.doc_id].lang]
        assert len(told) > 20 and sum(told) >= 0.95 * len(told)
    if name == "op4_shard":
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        # Equal texts are neighbours: only an end of a shard parts them.
        place, groups = {r.doc_id: i for i, r in enumerate(sorted(got, key=lambda r: (r.shard, r.slot)))}, collections.defaultdict(list)
        for i, d in docs.items():
            groups[d.text].append(place[i])
        assert any(len(g) > 1 for g in groups.values()) and all(max(g) - min(g) == len(g) - 1 for g in groups.values())


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = pipeline.table(spark, sf, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    from larkspur.llm.runtime import Scratch

    own, sizes = Scratch(spark, "test"), []
    for name, stage in pipeline.STAGES:
        out = own.keep(stage(spark, docs, sf), name)
        if name != "shard":
            assert out.columns == docs.columns
        sizes.append((name, out.count(), out.select("doc_id").distinct().count()))
        assert all(before[r.doc_id] == r.text for r in out.select("doc_id", "text").collect())
        docs = out
    assert [n for n, _, _ in sizes] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    assert sizes[0][1] >= sizes[1][1] >= sizes[2][1] and sizes[3][1] == sizes[4][1]
    by = sorted(r["count"] for r in docs.groupBy("shard").count().collect())
    assert by[-1] - by[0] <= 1
    random.seed(0)


def test_pages_of_the_table():
    """Pages not made by the operator's own rules: what stands in the article element, read by plain patterns, where nothing is nested in it."""
    import html
    import re

    import pyarrow.parquet as pq

    seen = right = 0
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inner = re.findall(r"<article[^>]*>(.*?)</article>", r["html"] or "", re.S)
        if len(inner) != 1 or re.search(r"<(?!/?(p|b|i|em|strong|br|h[1-6]|a)\b)", inner[0]):
            continue
        text = " ".join(html.unescape(re.sub(r"</?(b|i|em|strong|a)\b[^>]*>", "", re.sub(r"</?(p|br|h[1-6])\b[^>]*>", "\n", inner[0]))).split())
        seen += 1
        right += htmlmain.main_text(r["html"]) == text
    assert seen >= 100 and right >= 0.98 * seen


def test_page_oracle_shape(spark):
    out = queries.QUERIES["op7_main_text"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) and r.text for r in out.collect())


def test_pipeline_edges(spark, odd, none):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (odd, none):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "shard":
                assert {"shard", "slot"} <= set(out.columns)
                assert out.count() == docs.count()
            else:
                assert out.columns == docs.columns
                kept = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
                assert kept <= {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
                if name == "language_id":
                    assert kept == {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")}
