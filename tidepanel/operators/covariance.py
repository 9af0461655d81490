"""Weights from the correlations of a book's markets. Pairs' moments come from products of blocks of the members' windows; one time's
matrix, as many numbers as members squared, is one group."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import products


def pair_moments(returns: DataFrame, book: DataFrame, window: int, before: bool = False) -> DataFrame:
    """returns: ts, market, ret on a dense grid; book: ts, market. By ts and member: the other members in arrays (products.PAIRS), with
    n, cov and corr (sample) over the times of the window at which both are known. The window ends at ts, or with before right
    before it."""
    calendar = returns.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))  # a calendar
    ends = book.select("ts").distinct().join(calendar, "ts").select("ts", (F.col("i") - int(before)).alias("e"))
    rows = returns.join(calendar, "ts").select("i", "market", F.col("ret").alias("x"))
    return products.moments(products.packed(ends, rows, window, ["ts"], book.select("ts", "market")), window, ["ts"])


def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, cov and corr of one group's members, in the rows' order; 0 or NaN where a pair has nothing in common."""
    names = pd.Index(pdf["market"])
    n, cov, corr = np.zeros((len(names),) * 2, np.int64), *np.full((2, len(names), len(names)), np.nan)
    for k, parts in enumerate(pdf["parts"]):
        for p in parts if parts is not None else []:
            at = names.get_indexer(p["others"])
            ok = at >= 0
            for matrix, c in ((n, "n"), (cov, "cov"), (corr, "corr")):
                matrix[k, at[ok]] = np.asarray(p[c], float)[ok]
    return n, cov, corr


def _by_time(book: DataFrame, moments: DataFrame, least: int, made: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """made(covariances, correlations) gives a time's weights; equal ones where a pair has fewer than least common times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("market", ignore_index=True)
        n, cov, corr = _matrices(pdf)
        thin = (n < least).any() or not np.isfinite(corr).all()
        weight = np.full(len(pdf), 1 / len(pdf)) if thin or len(pdf) == 1 else made(cov, corr)
        return pd.DataFrame({"ts": pdf["ts"], "market": pdf["market"], "weight": weight})

    ts = book.schema["ts"].dataType.simpleString()
    rows = book.select("ts", "market").join(products.gathered(moments, ["ts"]), ["ts", "market"], "left")
    return rows.groupBy("ts").applyInPandas(run, f"ts {ts}, market string, weight double")


def cluster_equal(book: DataFrame, moments: DataFrame, threshold: float, least: int) -> DataFrame:
    """Equal weights across the connected groups at a correlation of the threshold or more, and equal within each."""

    def made(_: np.ndarray, corr: np.ndarray) -> np.ndarray:
        near = corr >= threshold
        np.fill_diagonal(near, True)
        while (wider := (near.astype(int) @ near.astype(int)) > 0).sum() > near.sum():
            near = wider
        return 1 / (near.sum(1) * len(np.unique(near, axis=0)))

    return _by_time(book, moments, least, made)


def risk_parity_tree(book: DataFrame, moments: DataFrame, least: int, linkage: str = "single") -> DataFrame:
    """Hierarchical risk parity: markets in the order of their tree (single, average, complete or ward linkage) over
    sqrt((1 - corr) / 2), whose halves share the weight by inverse variance, and so on down."""
    if linkage not in LINKAGES:
        raise ValueError(f"no linkage {linkage}")
    return _by_time(book, moments, least, lambda cov, corr: _bisected(cov, leaf_order(np.sqrt(np.maximum((1 - np.clip(corr, -1, 1)) / 2, 0)), linkage)))


#: Distances of a joined part to the others, from those of its two parts (sizes a, b and c; d their distance): Lance and Williams.
LINKAGES: dict[str, Callable] = {
    "single": lambda x, y, d, a, b, c: np.minimum(x, y),
    "complete": lambda x, y, d, a, b, c: np.maximum(x, y),
    "average": lambda x, y, d, a, b, c: (a * x + b * y) / (a + b),
    "ward": lambda x, y, d, a, b, c: np.sqrt(np.maximum(((a + c) * x * x + (b + c) * y * y - c * d * d) / (a + b + c), 0)),
}


def merges(distance: np.ndarray, linkage: str) -> list[tuple[float, int, int]]:
    """The tree's joins (height, row, row), lowest first, by chains of nearest neighbours: a chain goes on to ever nearer parts, and
    two that are each other's nearest are joined for good, whatever else is joined. Quadratic time in the rows."""
    d, n = distance.astype(float).copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = np.ones(n), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        here = chain[-1]
        near = int(np.argmin(d[here]))
        if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:  # of equals, the one before ends the chain
            near = chain[-2]
            del chain[-2:]
            height = d[here, near]
            out.append((float(height), min(here, near), max(here, near)))
            row = LINKAGES[linkage](d[here], d[near], height, size[here], size[near], size)
            row[~alive] = np.inf
            alive[near] = False
            d[near], d[:, near] = np.inf, np.inf
            row[[here, near]] = np.inf
            d[here], d[:, here] = row, row
            size[here] += size[near]
        else:
            chain.append(near)
    return sorted(out, key=lambda m: m[0])


def leaf_order(distance: np.ndarray, linkage: str = "single") -> list[int]:
    """The rows in the order of the tree's leaves: of two parts, the one that was there first stands first."""
    n = len(distance)
    parts, part_of, up = {k: [k] for k in range(n)}, list(range(n)), list(range(n))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for fresh, (_, a, b) in enumerate(merges(distance, linkage), n):
        a, b = root(a), root(b)
        first, second = sorted((part_of[a], part_of[b]))
        parts[fresh] = parts.pop(first) + parts.pop(second)
        up[b], part_of[a] = a, fresh
    return parts.popitem()[1] if parts else []


def _bisected(cov: np.ndarray, order: list[int]) -> np.ndarray:
    weight = np.ones(len(cov))

    def risk(part: list[int]) -> float:
        own = cov[np.ix_(part, part)]
        w = 1 / np.diag(own)
        w /= w.sum()
        return float(w @ own @ w)

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            share = risk(right) / (risk(left) + risk(right))
            weight[left] *= share
            weight[right] *= 1 - share
            todo += [left, right]
    return weight


def volatility_scale(book: DataFrame, moments: DataFrame, target: float, per_year: int, least: int, low: float = 0.0, high: float = 1.0, step: float | None = None) -> DataFrame:
    """ts, multiplier: the target over the book's volatility a year by its weights and covariances (of which negative eigenvalues are
    taken as 0), inside the bounds, in steps down from where it is; high where a covariance is missing or rests on fewer than
    least times."""
    held = book.where("weight <> 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["weight"].to_numpy(float)
        n, cov, _ = _matrices(pdf)
        cov = np.where(n >= max(2, least), cov, np.nan)
        value = high
        if np.isfinite(cov).all():
            values, vectors = np.linalg.eigh(cov)
            risk = math.sqrt(max(0.0, float(w @ ((vectors * values.clip(0)) @ vectors.T) @ w)) * per_year)
            value = min(high, max(low, target / risk)) if risk > 0 else high
            if step and value < high - 1e-12:
                value = low + math.floor((value - low) / step + 1e-12) * step
        return pd.DataFrame({"ts": pdf["ts"].iloc[:1], "multiplier": [value]})

    ts = book.schema["ts"].dataType.simpleString()
    return held.join(products.gathered(moments, ["ts"]), ["ts", "market"], "left").groupBy("ts").applyInPandas(run, f"ts {ts}, multiplier double")
