"""Operators on vectors and urls against brute force."""

import math

import numpy as np
import pytest

from brindle.llm import embed_dedup, registry, topk, urlfilter
from brindle.llm.components import connected_components
from brindle.llm.common import Scratch


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 16)).astype(np.float32)
    for i in range(50, 120):
        x[i] = x[50] + 0.05 * r.standard_normal(16)
    x[121] = x[120]
    x[122] = x[120]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(400)]
    return rows + [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None, *([0.0] * 14)], 1), (403, [math.nan] * 16, 1), (404, [1.0, 2.0], 1), (405, [2.0, 4.0], 1), (406, [], 1)]


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<float>, dim int")


def usable(row, zero):
    v = row[1]
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


@pytest.mark.parametrize(("block", "seeds"), [(1000, 8192), (1 << 19, 100), (1 << 19, 3)])
def test_top_k(table, vectors, monkeypatch, block, seeds):
    monkeypatch.setattr(topk, "ROW_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block // 10)
    monkeypatch.setattr(topk, "SEED_ROWS", seeds)
    q = {r[0]: np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(np.int64) for r in vectors if usable(r, True)}
    want = set()
    for i in q:
        if i % 50 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(table).collect()} == want


def test_segment_bounds_hold():
    r = np.random.default_rng(0)
    a, b = r.standard_normal((2, 50, 30))
    for share in (0, 0.1, 0.5, 0.75, 1):
        assert (topk.segment_statistics(a, share) @ topk.segment_statistics(b, share).T >= a @ b.T - 1e-9).all()


def test_pairs_that_survive():
    """Correlated vectors: the first levels leave under a fifth of the pairs, and the result is that of brute force."""
    r = np.random.default_rng(4)
    x = np.floor(256 * (r.standard_normal((4000, 64)) * 0.9 ** np.arange(64)) @ np.linalg.qr(r.standard_normal((64, 64)))[0])
    ids = r.permutation(4000)
    q, least, seen = x[:80], np.full(80, -np.inf), []
    got = topk.block_top(ids[:80], q, ids, x, 5, topk.rotation(x[1000:2000]), least, seen)
    score = (q @ x.T).astype(int)
    want = {(int(ids[i]), int(ids[j]), int(score[i, j])) for i in range(80) for j in sorted((j for j in range(4000) if j != i), key=lambda j: (-score[i, j], ids[j]))[:5]}
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want
    pairs = sum(s[0] for s in seen[1:])
    assert sum(s[1] for s in seen[1:]) < 0.2 * pairs and sum(s[-1] for s in seen[1:]) < 0.05 * pairs


def test_top_k_of_repeated_ids(spark):
    rows = [(None, [9.0, 9.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [0.5, 0.25]), (4, [0.5, 0.25]), (4, [0.5, 0.25])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()]
    assert len(got) == 2 and {r[2] for r in got} <= {3, 4} and {r[3] for r in got} <= {32768, 16384}


@pytest.mark.parametrize("window", [1024, 64])
def test_near_vectors(table, vectors, monkeypatch, window):
    monkeypatch.setattr(embed_dedup, "WINDOW", window)
    x = {r[0]: np.array(r[1], np.float32).astype(float) for r in vectors if usable(r, False)}
    links = {i: {j for j in x if j != i and len(x[j]) == len(x[i]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.95} for i in x}
    root = {r[0]: r[0] for r in vectors}
    for _ in range(10):
        for i in x:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    got = embed_dedup.near_vectors(table).collect()
    assert len(got) == len(vectors)
    for r in got:
        assert (r.component_id, r.kept) == (root[r.vec_id], root[r.vec_id] == r.vec_id)
        assert r.n_links <= len(links.get(r.vec_id, ()))
        if window > 400:
            assert r.n_links == len(links.get(r.vec_id, ()))


def test_links_of_a_dense_group(spark):
    """More noisy copies than a window holds: each is linked with all others."""
    r = np.random.default_rng(11)
    x = r.standard_normal((1900, 16))
    x[100:1700] = x[100] * r.uniform(0.5, 2, (1600, 1)) + 0.02 * r.standard_normal((1600, 16))
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(1900)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert (want[100:1700] >= 1500).all()
    got = {v.vec_id: v for v in embed_dedup.near_vectors(table).collect()}
    assert [got[i].n_links for i in range(1900)] == want.tolist()
    assert {got[i].component_id for i in range(100, 1700)} == {100}


def test_recall_on_planted_groups(spark):
    """Over 6000 vectors: groups of two to 800 noisy copies at cosines about the threshold, against brute force."""
    r = np.random.default_rng(12)
    x = r.standard_normal((6000, 32))
    at = 0
    for size in (2, 2, 3, 5, 8, 30, 120, 800, *[2] * 200):
        x[at : at + size] = x[at] + 0.22 * r.standard_normal((size, 32))
        at += size
    x = x.astype(np.float32)
    order = r.permutation(6000)
    table = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in order], "vec_id long, embedding array<float>").repartition(5)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.sum() > 10_000
    got = {v.vec_id: v.n_links for v in embed_dedup.near_vectors(table).collect()}
    n = np.array([got[i] for i in range(6000)])
    assert (n <= want).all() and n.sum() >= 0.999 * want.sum()


def test_repeated_vector_ids(spark):
    """A null id has no links; an id of two vectors has those of both."""
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0])]
    got = sorted(map(tuple, embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False)], key=str)


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(none).count() == 0 and topk.top_k(none).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


URLS = [
    ("http://Example.COM/x", "example.com", "/x", "com/", "allow"),
    ("https://www.example.com/en/1?a=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://blog.example.com/en/#f", "blog.example.com", "/en/", "example.com/en/", "block"),
    ("http://a.b.www.example.com/en/", "a.b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?q=/en/", "example.com", "", None, "allow"),
    ("ftp://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
    ("ftp://x.net/ES/a", "x.net", "/ES/a", None, "allow"),
    ("http://example.org/fr/", "example.org", "/fr/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c.com/d", "b:", "//c.com/d", None, "allow"),
    ("http://" + "a." * 2000 + "net/fr/" + "x" * 5000, "a." * 2000 + "net", "/fr/" + "x" * 5000, "net/fr/", "block"),
]


@pytest.mark.parametrize("blocks", [1 << 17, 0])
def test_url_rules(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", blocks)
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "x"), (None, URLS[1][0], "x")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(registry.RULES, "host string, path string, verdict string")
    got = urlfilter.judge_urls(pages, rules).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert tuple(r)[1:] == URLS[1 if r.page_id is None else r.page_id][1:]


def test_url_rules_at_size(spark):
    """A long list: the filter passes every listed key, and the exact join leaves no other."""
    rules = spark.range(3000).selectExpr("concat('h', id, '.org') AS host", "'/' AS path", "'block' AS verdict")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://www.h', id, '.org/p') AS url")
    got = urlfilter.judge_urls(pages, rules)
    assert got.filter("verdict = 'block'").count() == 3000 == got.filter("page_id < 3000 AND rule = concat('h', page_id, '.org/')").count()


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in urlfilter.judge_urls(pages, rules).collect()] == [(1, "a.com", "/", None, "allow")]
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame(registry.RULES, "host string, path string, verdict string")).count() == 0
