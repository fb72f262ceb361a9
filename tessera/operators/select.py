"""Representatives of a bag: per-bag selections, each with a group number per tile and a mark on the tiles that are kept.

Strategies take one bag as NumPy arrays and run in applyInPandas, a bag per call; all randomness is seeded by the bag's
name, so a run can be repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "slide string, tile_idx int, `group` int, selected boolean"
# Floors of a mixture's variances and shares.
LEAST_VARIANCE, LEAST_SHARE = 1e-8, 1e-12


def kmeans(x: np.ndarray, k: int, iterations: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of each row): starts from the first row and then the farthest ones; Lloyd steps."""
    k = min(max(k, 1), len(x))
    centres = [x[0]]
    far = ((x - x[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres, np.float64)
    for _ in range(iterations):
        near = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres, ((x[:, None] - centres) ** 2).sum(-1).argmin(1)


def nearest_unused(points: np.ndarray, centres: np.ndarray) -> list[int]:
    """For each centre in turn the nearest point that none has taken."""
    taken: list[int] = []
    for centre in centres:
        far = ((points - centre) ** 2).sum(1)
        far[taken] = np.inf
        taken.append(int(far.argmin()))
    return taken


def hshr(x: np.ndarray, xy: np.ndarray, clusters: int = 25) -> tuple[np.ndarray, list[int]]:
    """One tile per k-means cluster: the nearest to its centre."""
    centres, near = kmeans(x, clusters)
    chosen = [int(rows[((x[rows] - centres[c]) ** 2).sum(1).argmin()]) for c in range(len(centres)) if len(rows := np.flatnonzero(near == c))]
    return near, chosen


def splice(x: np.ndarray, xy: np.ndarray, percentile: float = 25.0) -> tuple[np.ndarray, list[int]]:
    """In tile order each tile left becomes a seed and takes all tiles left that are closer than a percentile of them.

    Earlier seeds count among those left: a later seed may take one into its group, which stays selected.
    """
    open_, group, chosen = np.ones(len(x), bool), np.zeros(len(x), int), []
    for i in range(len(x)):
        if open_[i]:
            group[i] = len(chosen)
            rows = np.flatnonzero(open_)
            far = np.sqrt(((x[rows] - x[i]) ** 2).sum(1))
            near = rows[(far < np.percentile(far, percentile)) & (rows != i)]
            open_[near] = False
            group[near] = len(chosen)
            chosen.append(i)
    return group, chosen


def mosaic(x: np.ndarray, xy: np.ndarray, clusters: int = 9, percent: float = 1.0) -> tuple[np.ndarray, list[int]]:
    """K-means on the vectors, and within each cluster spatial k-means: a share of its tiles, spread over the slide."""
    _, near = kmeans(x, clusters)
    return near, _spread(near, range(near.max() + 1), xy, percent, first_alone=False)


def _spread(group: np.ndarray, numbers, xy: np.ndarray, percent: float, first_alone: bool) -> list[int]:
    chosen = []
    for c in numbers:
        rows = np.flatnonzero(group == c)
        if not len(rows):
            continue
        n = max(1, int(len(rows) * percent / 100))
        if n == 1 and first_alone:
            chosen.append(int(rows[0]))
        else:
            centres, _ = kmeans(xy[rows].astype(float), n)
            chosen += rows[nearest_unused(xy[rows].astype(float), centres)].tolist()
    return chosen


def fit_mixture(x: np.ndarray, prototypes: np.ndarray, iterations: int = 10, tau: float = 10.0, eps: float = 0.1):
    """MAP-EM of a diagonal mixture around prototypes: (prob, mean, cov, responsibilities).

    Every component starts at its prototype with variance eps, and each step adds tau rows of just that distribution to the rows
    that a component holds: shares, means and variances are the moments of both together, variances LEAST_VARIANCE at least.
    """
    prob, mean, cov = np.full(len(prototypes), 1 / len(prototypes)), prototypes.astype(float), np.full(prototypes.shape, eps)
    resp = responsibilities(x, prob, mean, cov)
    for _ in range(iterations):
        held = (resp.sum(0) + tau)[:, None]
        mean, square = (resp.T @ x + tau * prototypes) / held, (resp.T @ x**2 + tau * (prototypes**2 + eps)) / held
        prob, cov = held[:, 0] / held.sum(), np.maximum(square - mean**2, LEAST_VARIANCE)
        resp = responsibilities(x, prob, mean, cov)
    return prob, mean, cov, resp


def responsibilities(x: np.ndarray, prob: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Share of each component in each row, by log-sum-exp; shares and variances have floors."""
    cov = np.maximum(cov, LEAST_VARIANCE)
    log = np.log(np.maximum(prob, LEAST_SHARE)) - 0.5 * (np.log(2 * np.pi * cov).sum(1) + ((x[:, None] - mean) ** 2 / cov).sum(-1))
    log -= log.max(1, keepdims=True)
    return np.exp(log) / np.exp(log).sum(1, keepdims=True)


def mixtures(tiles: DataFrame, prototypes: np.ndarray, **options) -> DataFrame:
    """(slide, tile_idx, top, top_prob): the prototype with the largest share in each tile, from 0, by the slide's own mixture."""

    def run(bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values("tile_idx")
        resp = fit_mixture(np.array(bag.vec.tolist(), np.float64), prototypes, **options)[3]
        return pd.DataFrame({"slide": bag.slide, "tile_idx": bag.tile_idx, "top": resp.argmax(1), "top_prob": resp.max(1)})

    return tiles.select("slide", "tile_idx", "vec").groupBy("slide").applyInPandas(run, "slide string, tile_idx int, top int, top_prob double")


def embeddings(tiles: DataFrame, prototypes: np.ndarray, **options) -> DataFrame:
    """(slide, proto, prob, mean, cov): a slide's mixture, a row per prototype; together they are the slide's embedding."""

    def run(bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values("tile_idx")
        prob, mean, cov, _ = fit_mixture(np.array(bag.vec.tolist(), np.float64), prototypes, **options)
        return pd.DataFrame({"slide": bag.slide.iloc[0], "proto": range(len(prob)), "prob": prob, "mean": mean.tolist(), "cov": cov.tolist()})

    return tiles.select("slide", "tile_idx", "vec").groupBy("slide").applyInPandas(run, "slide string, proto int, prob double, mean array<double>, cov array<double>")


def prototype_mosaic(prototypes: np.ndarray, labels: list[str] | None = None, percent: float = 1.0) -> Callable:
    """Groups by the top prototype, from 1; group 0 holds the tiles whose prototype is labelled "exclude"."""

    def run(x: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, list[int]]:
        top = fit_mixture(x, prototypes)[3].argmax(1)
        group = np.array([0 if labels and labels[t] == "exclude" else t + 1 for t in top])
        return group, _spread(group, range(1, len(prototypes) + 1), xy, percent, first_alone=True)

    return run


REGISTRY: dict[str, Callable] = {"hshr-features": hshr, "splice-features": splice, "yottixel-features": mosaic}


def per_bag(tiles: DataFrame, strategy: Callable) -> DataFrame:
    """(slide, tile_idx, group, selected) for tiles(slide, tile_idx, x0, y0, vec); a bag is read in tile order."""

    def run(bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values("tile_idx").reset_index(drop=True)
        np.random.seed(zlib.crc32(bag.slide[0].encode()))
        group, chosen = strategy(np.array(bag.vec.tolist(), np.float64), bag[["x0", "y0"]].to_numpy())
        return pd.DataFrame({"slide": bag.slide, "tile_idx": bag.tile_idx, "group": group, "selected": bag.index.isin(chosen)})

    return tiles.select("slide", "tile_idx", "x0", "y0", "vec").groupBy("slide").applyInPandas(run, SCHEMA)


def distance_groups(tiles: DataFrame, scale: float = 10.0) -> DataFrame:
    """Tiles grouped by their rounded distance to the mean of the slide, groups numbered from 0, one tile of each selected.

    All of it is relational; the tile selected is the one with the smallest hash.
    """
    long = tiles.select("slide", "tile_idx", F.posexplode("vec").alias("dim", "x"))
    means = long.groupBy("slide", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    far = long.join(means, ["slide", "dim"]).groupBy("slide", "tile_idx").agg(F.rint(scale * F.sqrt(F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))))).cast("long").alias("bin"))
    group = (F.dense_rank().over(Window.partitionBy("slide").orderBy("bin")) - 1).alias("group")
    pick = F.row_number().over(Window.partitionBy("slide", "bin").orderBy(F.xxhash64("slide", "tile_idx"), "tile_idx"))
    return far.select("slide", "tile_idx", group, (pick == 1).alias("selected"))
