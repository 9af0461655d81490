"""Pairwise-complete covariances as products of blocks of packed vectors.

A vector is a market's known values in a window, packed in one row. Markets of a group (a book's time, a period) are dealt in blocks,
and a task takes a pair of blocks: four matrix products give all its pairs' counts, sums and cross sums. So what is shuffled is
members times window, once for each block of the group, and never a row for a pair or for a pair's day; what comes out is a row
for a member and a block, with the other members in arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def packed(ends: DataFrame, rows: DataFrame, window: int, by: list[str], members: DataFrame | None = None) -> DataFrame:
    """ends: by, e; rows: i, market, x. by, market, held: the places (0 the last) and values of x that a market has in the window of
    the numbers e - window + 1 to e; of the members (by, market) only, if they are given. A row that is not known is left out."""
    spans = ends.select(*by, F.explode(F.sequence(F.col("e") - window + 1, F.col("e"))).alias("i"), "e")
    known = rows.where(F.col("x").isNotNull()).select("i", "market", "x")
    if members is None:
        inside = spans.join(known, "i")
    else:
        inside = members.join(spans, by).join(known, ["i", "market"])
    return inside.groupBy(*by, "market").agg(F.collect_list(F.struct((F.col("e") - F.col("i")).cast("int").alias("at"), F.col("x").cast("double").alias("x"))).alias("held"))


def _matrix(held: pd.Series, window: int) -> np.ndarray:
    """Values less their row's first, NaN where unknown."""
    out = np.full((len(held), window), np.nan)
    for k, cells in enumerate(held):
        at = np.fromiter((c["at"] for c in cells), np.int64, len(cells))
        out[k, at] = np.fromiter((c["x"] for c in cells), np.float64, len(cells))
        out[k] -= cells[0]["x"]
    return out


def block_moments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, cov and corr (sample) of each row of a with each of b over the places at which both are known; NaN where they are not
    defined. A side that does not move has no correlation."""
    in_a, in_b = (~np.isnan(m) for m in (a, b))
    x, y, ma, mb = np.where(in_a, a, 0.0), np.where(in_b, b, 0.0), in_a.astype(float), in_b.astype(float)
    n, sa, sb = ma @ mb.T, x @ mb.T, ma @ y.T
    qa, qb = (x * x) @ mb.T, ma @ (y * y).T
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = x @ y.T - sa * sb / n
        va, vb = (np.where(q - s * s / n > 1e-13 * q, q - s * s / n, 0.0) for q, s in ((qa, sa), (qb, sb)))
        cov = np.where(n > 1, cross / (n - 1), np.nan)
        corr = np.where((n > 1) & (va > 0) & (vb > 0), cross / np.sqrt(va * vb), np.nan)
    return n.astype(np.int64), cov, corr


PAIRS = "others array<string>, n array<long>, cov array<double>, corr array<double>"


def moments(vectors: DataFrame, window: int, by: list[str], least_corr: float | None = None, least: int = 0, block: int | None = None) -> DataFrame:
    """by, market, others, n, cov, corr: for each member and block the pairs with the block's members, itself included. With
    least_corr only pairs with others that reach it over `least` places or more, and only members that have any."""
    block = block or BLOCK
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*by)) / block).cast("int")
    placed = vectors.withColumn("__n", blocks).withColumn("__b", F.pmod(F.xxhash64("market"), F.col("__n")).cast("int"))
    dealt = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("__i", F.least("__b", "__o")).withColumn("__j", F.greatest("__b", "__o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("market", ignore_index=True)
        values, names, side = _matrix(pdf["held"], window), pdf["market"].to_numpy(), pdf["__b"].to_numpy()
        i, j = pdf["__i"].iloc[0], pdf["__j"].iloc[0]
        rows = []
        for own, other in {(i, j), (j, i)}:
            mine, theirs = np.flatnonzero(side == own), np.flatnonzero(side == other)
            n, cov, corr = block_moments(values[mine], values[theirs])
            for k, m in enumerate(mine.tolist()):
                keep = np.ones(len(theirs), bool)
                if least_corr is not None:
                    with np.errstate(invalid="ignore"):
                        keep = (n[k] >= least) & (corr[k] >= least_corr) & (theirs != m)
                if keep.any():
                    rows.append((*(pdf[c].iloc[0] for c in by), names[m], names[theirs][keep].tolist(), n[k][keep], cov[k][keep], corr[k][keep]))
        return pd.DataFrame(rows, columns=[*by, "market", "others", "n", "cov", "corr"])

    fields = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in by)
    return dealt.groupBy(*by, "__i", "__j").applyInPandas(run, f"{fields}, market string, {PAIRS}")


def gathered(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, market, parts: a member's blocks together."""
    part: Column = F.struct("others", "n", "cov", "corr")
    return pairs.groupBy(*by, "market").agg(F.collect_list(part).alias("parts"))
