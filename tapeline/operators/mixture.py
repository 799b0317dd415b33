"""Mixtures of normal or Cauchy distributions fitted to histograms.

A histogram has a bounded number of bins, so one task fits one histogram from one start, and the
starts of one symbol are fitted side by side. The best start is chosen by an aggregate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starts per histogram, rounds of a fit at most, and the rise of the log-likelihood below which it ends.
STARTS, ROUNDS, RISE = 5, 300, 1e-8
KINDS = ("gaussian", "cauchy")


def _log_density(x: np.ndarray, at: np.ndarray, scale: np.ndarray, kind: str) -> np.ndarray:
    """Log densities, a row per component."""
    z = (x - at[:, None]) / scale[:, None]
    shape = -np.log1p(z * z) - np.log(np.pi) if kind == "cauchy" else -0.5 * (z * z + np.log(2 * np.pi))
    return shape - np.log(scale)[:, None]


def fit_once(x: np.ndarray, mass: np.ndarray, components: int, kind: str, seed: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """(weights, locations, scales, log-likelihood before each step) from one start.

    Locations start at quantiles drawn by the seed, scales at the histogram's deviation over the
    components. A step takes each bin's posterior shares; a normal component gets their mean and
    deviation. A Cauchy component is a t distribution with one degree of freedom: the location
    is the mean weighted by 2 / (1 + z*z), then the scale with those weights at the new location.
    Neither step lowers the likelihood unless a scale would pass below `least`, where it stays.
    """
    total = mass.sum()
    share = mass / total
    drawn = np.sort(np.random.default_rng(seed).random(components))
    at = x[np.minimum(np.searchsorted(np.cumsum(share), drawn), len(x) - 1)].astype(float)
    spread = np.sqrt(share @ (x - share @ x) ** 2)
    scale, weight = np.full(components, max(spread / components, least)), np.full(components, 1 / components)
    trace: list[float] = []
    for _ in range(ROUNDS):
        with np.errstate(divide="ignore"):
            logs = np.log(weight)[:, None] + _log_density(x, at, scale, kind)
        peak = logs.max(axis=0)
        whole = peak + np.log(np.exp(logs - peak).sum(axis=0))
        trace.append(float(mass @ whole))
        if len(trace) > 1 and abs(trace[-1] - trace[-2]) < RISE:
            break
        part = np.exp(logs - whole) * mass
        size = part.sum(axis=1)
        pull = 2 / (1 + ((x - at[:, None]) / scale[:, None]) ** 2) if kind == "cauchy" else 1.0
        moved = ((part * pull) @ x) / np.maximum((part * pull).sum(axis=1), 1e-300)
        at = np.where(size > 0, moved, at)
        off = x - at[:, None]
        pull = 2 / (1 + (off / scale[:, None]) ** 2) if kind == "cauchy" else 1.0
        scale = np.where(size > 0, np.maximum(np.sqrt((part * pull * off * off).sum(axis=1) / np.maximum(size, 1e-300)), least), scale)
        weight = size / total
    return weight, at, scale, trace


def fit_mixture(histogram: DataFrame, components: int = 3, kind: str = "gaussian", starts: int = STARTS) -> DataFrame:
    """(symbol, component, weight, location, scale, log_likelihood) of the best of several starts for each symbol's histogram (symbol, centre, v).

    Components are numbered by location. A scale is at least half the smallest distance of two
    bins, as nothing finer can be seen. Null and negative volumes count as 0; histograms without
    volume, or with all of it at one centre, give no rows. Of equally good starts the first counts.
    """
    if kind not in KINDS or components < 1 or starts < 1:
        raise ValueError(f"kind must be one of {KINDS}, with at least one component and start")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = rows.groupby("centre")["v"].sum()
        x, mass = g.index.to_numpy(float), g.to_numpy(float)
        if (mass > 0).sum() < 2:
            return pd.DataFrame(columns=["symbol", "start", "ll", "parts"])
        weight, at, scale, trace = fit_once(x, mass, components, kind, int(key[1]), float(np.diff(x).min()) / 2)
        order = np.argsort(at, kind="stable")
        parts = [{"weight": weight[k], "location": at[k], "scale": scale[k]} for k in order.tolist()]
        return pd.DataFrame({"symbol": [key[0]], "start": [int(key[1])], "ll": [trace[-1]], "parts": [parts]})

    mass = F.greatest(F.coalesce(F.col("v").cast("double"), F.lit(0.0)), F.lit(0.0))
    each = histogram.where("centre is not null").select("symbol", F.col("centre").cast("double").alias("centre"), mass.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    fits = each.groupBy("symbol", "start").applyInPandas(fit, "symbol string, start int, ll double, parts array<struct<weight: double, location: double, scale: double>>")
    best = fits.groupBy("symbol").agg(F.max_by(F.struct("ll", "parts"), F.struct("ll", -F.col("start"))).alias("x"))
    out = best.select("symbol", "x.ll", F.posexplode("x.parts").alias("component", "p"))
    return out.select("symbol", "component", "p.weight", "p.location", "p.scale", F.col("ll").alias("log_likelihood"))
