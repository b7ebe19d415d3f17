"""Vector, archive and pipeline operators on odd rows and against plain versions."""

import hashlib

import numpy as np
import pytest
from conftest import SF
from oracle import connect, differences
from pyspark.sql import functions as F

from dugout.llm import ann_partitions, flat_graph, secret_scan, warc_index
from dugout.llm.components import components
from dugout.llm.queries import QUERIES, SQL

from .conftest import DOCS, clashing

VECTORS = "vec_id bigint, embedding array<float>"
ODD = [(None, [1.0, 2.0, 0.5, 1.0]), (9001, None), (9002, [0.0] * 4), (9003, [1.0, None, 2.0, 1.0]),
       (9004, [1.0, float("nan"), 2.0, 1.0]), (9005, [float("inf"), 1.0, 2.0, 1.0]), (9006, [1.0, 2.0]), (9007, [])]


def clustered(n, d, seed, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(1, n // 15), d))
    return centre[rng.integers(0, len(centre), n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("a,b,want", [
    ([1, 2, 5, 9], [2, 3, 4, 9], {1: 1, 2: 1, 3: 1, 5: 4, 4: 4}),
    (list(range(1, 60)), list(range(2, 61)), {i: 1 for i in range(1, 61)}),
    ([50] * 40, list(range(40)), {i: 0 for i in [*range(40), 50]}), ([], [], {}),
])
def test_components(spark, a, b, want):
    got = components(spark.createDataFrame(list(zip(a, b)), "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in got} == want


@pytest.mark.parametrize("block", [64, 2048])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(flat_graph, "BLOCK", block)
    x = np.vstack([clustered(500, 8, 1, 0.25), clustered(200, 8, 2, 0.02), np.ones((150, 8)) + 0.05 * clustered(150, 8, 3, 1)])
    x = x.astype(np.float32)
    made = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] + [r for r in ODD if r[0] != 9006]
    frame = spark.createDataFrame(made, VECTORS).withColumn("label", F.lit("clash"))
    got = {r.vec_id: r for r in flat_graph.grouped(frame).collect()}
    assert len(got) == len({r[0] for r in made})
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        fresh = np.minimum(label, np.where(near, label, len(x)).min(1))
        if (fresh == label).all():
            break
        label = fresh
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.99
    for i, _ in ODD:
        if i != 9006:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_pairs_that_shards_divide_are_found_in_the_end(spark, monkeypatch):
    """Isolated pairs in many small shards: the first search loses some, the audit sees it."""
    monkeypatch.setattr(flat_graph, "SHARD", 20)
    monkeypatch.setattr(flat_graph, "OVERLAP", 1)
    audits, plain = [], flat_graph.audit
    monkeypatch.setattr(flat_graph, "audit", lambda *a: audits.append(plain(*a)) or audits[-1])
    rng = np.random.default_rng(5)
    one = rng.normal(size=(400, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = rng.normal(size=one.shape)
    off -= (off * one).sum(1, keepdims=True) * one
    two = 0.902 * one + np.sqrt(1 - 0.902**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    made = [(int(i), v.tolist()) for i, v in enumerate(np.vstack([one, two]))]
    got = {r.vec_id: r for r in flat_graph.grouped(spark.createDataFrame(made, "vec_id bigint, embedding array<double>")).collect()}
    assert sum(got[i + 400].component_id == i and got[i].n_links == 1 for i in range(400)) >= 0.99 * 400
    assert audits[0] < 0.99


def test_every_shard_may_be_cut_into_blocks(spark):
    """As many large shards as there can be: their numbers of blocks must not nest in one expression."""
    counts = {s: flat_graph.BLOCK * (1 + s % 3) - s % 2 for s in range(flat_graph.SHARDS) if s != 7}
    rows = spark.range(flat_graph.SHARDS).withColumn("shard", F.col("id").cast("int")).withColumn("n", flat_graph._blocks(counts))
    assert {r.shard: r.n for r in rows.collect()} == {s: 1 + s % 3 if s in counts else 1 for s in range(flat_graph.SHARDS)}


def test_the_walk_sees_what_it_saw(spark):
    """Rows in range that a walk from the medoid reaches, against one that looks at every row in each step."""
    x = clustered(300, 8, 7, 0.5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, reach, links, beam = x[:90], np.linspace(0.1, 0.9, 90), flat_graph.pruned(x), 3
    cosine, medoid = q @ x.T, int((x @ x.sum(0)).argmax())
    want = set()
    for k in range(len(q)):
        seen, done = {medoid}, set()
        while True:
            bar = sorted((cosine[k, j] for j in seen), reverse=True)[beam - 1] if len(seen) >= beam else -np.inf
            step = {j for j in seen - done if cosine[k, j] >= min(bar, np.cos(reach[k]))}
            if not step:
                break
            done |= step
            seen |= {int(j) for i in step for j in links[i]}
        want |= {(k, j) for j in seen if cosine[k, j] >= np.cos(reach[k])}
    found = list(zip(*(c.tolist() for c in flat_graph.in_range(x, links, q, reach, beam))))
    assert len(found) == len(set(found)) and set(found) == want


def test_no_vectors(spark):
    for made in ([], [(1, None), (2, [0.0, 0.0])]):
        frame = spark.createDataFrame(made, VECTORS)
        assert flat_graph.grouped(frame).filter("n_links = 0 and kept").count() == len(made)
        assert ann_partitions.nearest(frame, F.col("id") % 50 == 0).count() == 0


def plain_nearest(ids, x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u[q]
    return [(ids[j], score[j]) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != ids[q]][:k]


def test_few_vectors_are_searched_whole(spark):
    x = np.array([[1, 0, 0, 1], [1, 0, 0, 1], [2, 0, 0, 2], [0, 1, 1, 0], [1, 1, 0, 0], [0, 0, 1, 1], [3, 1, 0, 2]], float)
    ids = [100, 7, 3, 50, 12, 13, 14]
    made = [(i, v.tolist()) for i, v in zip(ids, x)] + [(100, x[0].tolist())] + ODD
    for n in (1, 2, 4, 7):
        some = made[:n] + made[7:] if n == 7 else made[:n]
        got = ann_partitions.nearest(spark.createDataFrame(some, VECTORS), F.col("id") % 50 == 0, k=5).collect()
        for q in range(n):
            own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
            if ids[q] % 50 == 0:
                want = plain_nearest(ids[:n], x[:n], q, 5)
                assert [r[1] for r in own] == [w[0] for w in want] and [r[0] for r in own] == list(range(1, len(want) + 1))
                assert [r[2] for r in own] == pytest.approx([w[1] for w in want], abs=1e-12)
            else:
                assert not own


@pytest.mark.parametrize("block", [100, 1024])
def test_recall_of_the_search(spark, monkeypatch, block):
    monkeypatch.setattr(ann_partitions, "BLOCK", block)
    x = np.vstack([clustered(1500, 16, 5, 0.7), np.tile(clustered(1, 16, 6, 1), (700, 1)) + 1e-3 * clustered(700, 16, 7, 1)])
    x = x.astype(np.float32).astype(float)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], VECTORS).withColumn("part", F.lit("clash"))
    got = ann_partitions.nearest(frame, F.col("id") % 50 == 0).toPandas()
    hit = total = 0
    for q in range(0, len(x), 50):
        want = plain_nearest(np.arange(len(x)), x, q, 5)
        hit += len({w[0] for w in want} & set(got[got.query_id == q].vec_id))
        total += 5
    assert hit / total >= 0.9 and (got.groupby("query_id").size() == 5).all()


def test_balanced_parts_cut_few_edges():
    x = clustered(600, 8, 9, 0.1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = ann_partitions.graph(x, 10)
    part = ann_partitions.balanced(near, 10)
    assert np.bincount(part, minlength=10).max() <= np.ceil(1.05 * 60)
    assert (part[near] == part[:, None]).mean() > 0.8


# ---- archives

PAGES = [
    (1, "http://www.a.org/x", "<p>" + "é" * 600), (2, "http://www.a.org/x", "<p>" + "é" * 600), (3, "http://b.a.org:80/", "s"),
    (4, "http://b.a.org:80/", "s"), (5, None, None), (6, "no url", ""), (None, "http://user@c.org?q", "<p>" + "é" * 600),
    (7, "http://c.org/\r\nx y", "\r\n\r\n" * 400), (7, "http://c.org/\r\nx y", "\r\n\r\n" * 400), (8, "http://ü.org/é", "z" * 999),
    (9, "http://ü.org/é", "z" * 999), (10, "http://long.org/", "w" * 2_000_000), (None, None, "q" * 1000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("key", "digest", "file", "refers_to", "revisit")})


def test_archived_pages(spark, pages):
    got = warc_index.archived(pages).collect()
    assert len(got) == len(PAGES)
    best = {}
    for p, _, h in PAGES:
        if len((h or "").encode()) >= 1000 and p is not None:
            best[h] = max(p, best.get(h, p))
    want = []
    for p, _, h in PAGES:
        body = (h or "").encode()
        to = best.get(h) if len(body) >= 1000 else None
        to = None if to == p else to
        want.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert warc_index.archived(pages.limit(0)).count() == 0


def test_lookup_by_url(spark, pages, monkeypatch):
    monkeypatch.setattr(warc_index, "BLOCK", 2)
    from dugout.session import scratch_path

    folder = scratch_path(spark, "warc")
    index = warc_index.write_index(warc_index.write_archives(warc_index.resolved(pages), folder), folder)
    asked = spark.createDataFrame([("http://www.a.org/x",), ("http://nowhere.org/",), ("HTTP://B.A.ORG/",)], "url string")
    found = warc_index.lookup(index, asked)
    assert sorted(r.page_id for r in found.collect()) == [1, 2, 3, 4]
    assert sorted(r.page_id for r in warc_index.read_records(found, folder).collect()) == [1, 2, 3, 4]


def test_keys(spark):
    urls = ["http://www.A.org/B?c", "https://u:p@x.y.z:8080", "ftp://h", "plain", None]
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select(warc_index.key_of(F.col("u")))
    assert [r[0] for r in frame.collect()] == ["org,a,www)/B?c", "z,y,x)", "h)", "plain", ""]


# ---- queries and pipeline


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_every_query_gives_its_rows(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    ids = "vec_id" if "vec_id" in got and "query_id" not in got else next((c for c in ("doc_id", "page_id") if c in got), "query_id")
    table = spark.read.parquet(f"{SF}/{ {'doc_id': 'documents', 'page_id': 'pages'}.get(ids, 'embeddings')}.parquet")
    if ids == "query_id":
        table = table.filter("vec_id % 50 = 0")
    assert got[ids].nunique() == table.count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs = corpus_pipeline.kept(docs, f"test-{name}")
        if name != "pack":
            assert docs.columns == columns
        if name in ("quality", "near_duplicates"):
            assert 0 < docs.count() < before.count() and docs.exceptAll(before).count() == 0
        elif name == "secrets":
            spotted = secret_scan.found(before).filter("size(spans) > 0").count()
            assert docs.count() == before.count() and docs.exceptAll(before).count() == spotted
        elif name == "mix":
            assert docs.distinct().exceptAll(before.distinct()).count() == 0
            assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


def test_pipeline_on_odd_rows(spark, rows):
    import corpus_pipeline

    for some in (rows, []):
        docs = spark.createDataFrame(some, DOCS).withColumn("extra", F.lit("x"))
        docs = clashing(docs)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.kept(stage(spark, docs, SF), f"odd-{name}")
        assert docs.count() >= len(some) // 4
