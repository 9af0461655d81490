"""Products of packed windows and trees of four linkages against plain versions."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import covariance, products


def day(k):
    return date(2020, 1, 1) + timedelta(days=k)


@pytest.mark.parametrize("block", [256, 3])
def test_moments_equal_pandas_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(products, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)) @ rng.normal(size=(8, 8)) + 100
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6], x[5:, 7] = 3.3, np.nan
    names = [f"m{k}" for k in range(8)]
    returns = spark.createDataFrame([(day(t), m, None if np.isnan(x[t, k]) else float(x[t, k])) for t in range(40) for k, m in enumerate(names)], "ts date, market string, ret double")
    book = spark.createDataFrame([(day(t), m) for t in (20, 39) for m in names], "ts date, market string")
    for before in (False, True):
        got = {(r.ts, r.market, o): (n, np.nan if c is None else c, np.nan if q is None else q) for r in covariance.pair_moments(returns, book, 15, before).collect() for o, n, c, q in zip(r.others, r.n, r.cov, r.corr, strict=True)}
        for t in (20, 39):
            end = t + (not before)
            part = pd.DataFrame(x[end - 15 : end], columns=names)
            for a in names:
                for b in names:
                    both = part[[a, b]].dropna() if a != b else part[[a]].dropna().assign(other=lambda d: d.iloc[:, 0])
                    n, cov, corr = got.get((day(t), a, b), (0, np.nan, np.nan))
                    if len(both):
                        assert n == len(both)
                    if len(both) > 1:
                        assert cov == pytest.approx(np.cov(both.to_numpy(), rowvar=False)[0, 1], abs=1e-9)
                        moves = both.std().min() > 1e-9
                        assert (corr == pytest.approx(np.corrcoef(both.to_numpy(), rowvar=False)[0, 1], abs=1e-9)) if moves else np.isnan(corr)


def plain_order(distance, linkage):
    """Joins the nearest parts, pair by pair."""
    parts, ids = [[k] for k in range(len(distance))], list(range(len(distance)))
    d = {(i, j): distance[i][j] for i in range(len(distance)) for j in range(len(distance)) if i != j}
    size = {k: 1 for k in ids}
    while len(parts) > 1:
        _, a, b = min((d[p], *p) for p in d if p[0] < p[1])
        fresh = max(ids) + 1 + len(distance)
        i, j = ids.index(a), ids.index(b)
        for c in ids:
            if c not in (a, b):
                x, y, h = d[a, c], d[b, c], d[a, b]
                na, nb, nc = size[a], size[b], size[c]
                v = {"single": min(x, y), "complete": max(x, y), "average": (na * x + nb * y) / (na + nb), "ward": (((na + nc) * x**2 + (nb + nc) * y**2 - nc * h**2) / (na + nb + nc)) ** 0.5}[linkage]
                d[fresh, c] = d[c, fresh] = v
        d = {p: v for p, v in d.items() if a not in p and b not in p}
        joined = parts[i] + parts[j]
        size[fresh] = size[a] + size[b]
        keep = [k for k in range(len(ids)) if k not in (i, j)]
        parts, ids = [parts[k] for k in keep] + [joined], [ids[k] for k in keep] + [fresh]
    return parts[0]


@pytest.mark.parametrize("linkage", ["single", "average", "complete", "ward"])
def test_trees_of_200_random_books(linkage):
    rng = random.Random(linkage)
    for _ in range(200):
        n = rng.randint(1, 14)
        x = np.array([[rng.gauss(0, 1) for _ in range(4)] for _ in range(n)])
        distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        assert covariance.leaf_order(distance, linkage) == plain_order(distance.tolist(), linkage)


def test_a_large_tree_takes_quadratic_time():
    import time

    x = np.random.default_rng(0).normal(size=(2000, 5))
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    began = time.time()
    assert sorted(covariance.leaf_order(distance, "ward")) == list(range(2000))
    assert time.time() - began < 30


def test_linkages_of_a_book(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6)) * 0.02
    returns = spark.createDataFrame([(day(t), m, float(x[t, k])) for t in range(50) for k, m in enumerate("abcdef")], "ts date, market string, ret double")
    book = spark.createDataFrame([(day(49), m) for m in "abcdef"], "ts date, market string")
    pairs = covariance.pair_moments(returns, book, 40)
    for linkage in covariance.LINKAGES:
        got = covariance.risk_parity_tree(book, pairs, 10, linkage).collect()
        assert sum(r.weight for r in got) == pytest.approx(1) and all(r.weight > 0 for r in got)
    with pytest.raises(ValueError, match="no linkage"):
        covariance.risk_parity_tree(book, pairs, 10, "median")
