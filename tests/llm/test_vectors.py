"""Searches and near-duplicates of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioquery.llm import components, pivot_search, sphere_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, d string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "i", "v", "d", "r") for i, v in rows], SCHEMA).repartition(3)


def vectors(seed=1, n=300, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(n // 4, n // 2):  # a group of near copies, and some exact ones
        x[i] = x[3] + rng.normal(size=dim) * (0.05 if i % 3 else 0.0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


ODD = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [None] * 12), (905, [1.0, 2.0]), (906, [0.0] * 12), (None, [1.0] * 12)]


@pytest.mark.parametrize("blocks", [(256, 16_384), (7, 40)])
def test_top_k_equals_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(pivot_search, "ROW_BLOCK", blocks[1])
    monkeypatch.setattr(pivot_search, "CHUNK", 16)
    rows = vectors()
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.search(frame(spark, rows + ODD), F.col("vec_id") % 20 == 0).collect()}
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in [*rows, (906, [0.0] * 12)]}
    want = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted(((-int(whole[q] @ whole[x]), x) for x in whole if x != q))[:20]
            want |= {(q, k, x, -s) for k, (s, x) in enumerate(scored, 1)}
    assert got == want


def test_top_k_of_few_and_of_large_vectors(spark):
    few = [(0, [1.0, 1.0]), (20, [1.0, -1.0]), (21, [1e7, 1e7])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.search(frame(spark, few), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 21, 64 * 64 * 2 * 10**7), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 21, 0)]
    assert pivot_search.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 1e9, 1e12, 1e30])
def test_top_k_is_exact_for_large_components(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4) * (size if i % 3 else 1.0)]) for i in range(60)]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.search(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect()}
    whole = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    want = set()
    for q in (0, 20, 40):
        score = {x: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[x])))) for x in whole if x != q}
        want |= {(q, k, x, score[x]) for k, x in enumerate(sorted(score, key=lambda x: (-score[x], x))[:5], 1)}
    assert got == want


def test_blocks_that_cannot_win_are_not_shipped(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "ROW_BLOCK", 100)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(16, 12))
    x = middles[rng.integers(0, 16, 2_000)] + rng.normal(size=(2_000, 12)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    report = {}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivot_search.search(frame(spark, rows), F.col("vec_id") % 20 == 0, report=report).collect()}
    whole = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    want = set()
    for q in range(0, 2_000, 20):
        score = whole @ whole[q]
        want |= {(q, k, int(v), int(score[v])) for k, v in enumerate([v for v in np.lexsort((np.arange(2_000), -score)) if v != q][:20], 1)}
    assert got == want
    assert 2 * report["shipped"] <= report["block_pairs"] and report["block_pairs"] >= 100


@pytest.mark.parametrize("block", [1_024, 16])
def test_near_duplicates_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(sphere_dedup, "BLOCK", block)
    monkeypatch.setattr(sphere_dedup, "CELL_ROWS", 40)
    rows = vectors(2)
    out = {r["vec_id"]: r for r in sphere_dedup.near_duplicates(frame(spark, rows + ODD), reach=1.0).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(root[i], *root[linked[i]]) if linked[i].any() else root[i] for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    assert {i: (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) for i, _ in rows} == {i: (int(linked[i].sum()), int(root[i]), bool(root[i] == i)) for i, _ in rows}
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i, _ in ODD if i)
    assert sphere_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_default_finds_pairs_across_borders(spark, monkeypatch):
    monkeypatch.setattr(sphere_dedup, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 2))  # on a circle, differences of pairs point along the line between neighbouring centroids
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in sphere_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("dim", [2, 8, 32])
def test_default_has_all_links_over_many_cells(spark, dim, monkeypatch):
    monkeypatch.setattr(sphere_dedup, "CELL_ROWS", 60)
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(40, dim))
    x = np.concatenate([rng.normal(size=(300, dim)), middles[rng.integers(0, 40, 600)] + rng.normal(size=(600, dim)) * 0.15])
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in sphere_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == dict(enumerate(want.tolist())) and want.sum() > 300


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 103: 100, 105: 100}
