"""Gaussian hidden Markov regimes: one fit for each anchor date, forward filtering only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.scratch import stash

STARTS = 4
FEATURES = ("mkt_ret", "mkt_vol", "avg_corr", "disp", "dd", "vix")


@dataclass
class Params:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    loglik: float

    @property
    def states(self) -> int:
        return len(self.start)


def log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    eye = np.eye(len(mean))
    for ridge in (1e-6, 1e-3):
        try:
            low = np.linalg.cholesky(cov + ridge * eye)
            break
        except np.linalg.LinAlgError:
            continue
    else:
        low = np.diag(np.sqrt(np.abs(np.diag(cov)) + 1e-3))
    z = np.linalg.solve(low, (x - mean).T)
    return -0.5 * (len(mean) * np.log(2 * np.pi) + (z**2).sum(axis=0)) - np.log(np.diag(low)).sum()


def emissions(x: np.ndarray, p: Params) -> np.ndarray:
    return np.column_stack([log_density(x, m, c) for m, c in zip(p.means, p.covs, strict=True)])


def scaled(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities divided by each row's greatest, and the logs of what was divided by."""
    top = e.max(axis=1)
    return np.exp(e - top[:, None]), top


def forward(e: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """P(state at t | values up to t) and the log-likelihood; each row is scaled to sum to one, so nothing underflows."""
    b, top = scaled(e)
    out, norms, now = np.empty_like(e), np.empty(len(e)), p.start
    for t in range(len(e)):
        now = (now if t == 0 else now @ p.moves) * b[t]
        norms[t] = max(now.sum(), 1e-300)
        now = now / norms[t]
        out[t] = now
    return out, float((np.log(norms) + top).sum())


def backward(e: np.ndarray, p: Params) -> np.ndarray:
    """Likelihood of the values after t by state, each row scaled to sum to one."""
    b, _ = scaled(e)
    out = np.ones_like(e) / e.shape[1]
    for t in range(len(e) - 2, -1, -1):
        x = p.moves @ (b[t + 1] * out[t + 1])
        out[t] = x / max(x.sum(), 1e-300)
    return out


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Seeded k-means labels, the tightest of ``STARTS`` tries."""
    return min((_centres_once(x, k, rng) for _ in range(STARTS)), key=lambda found: found[1])[0]


def _centres_once(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Labels from spread starting points and Lloyd's steps, and the squares that are left."""
    chosen = [x[rng.integers(len(x))]]
    while len(chosen) < k:
        away = np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(x[rng.choice(len(x), p=away / away.sum())] if away.sum() > 0 else x[rng.integers(len(x))])
    centres = np.array(chosen)
    for _ in range(50):
        label = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == i].mean(axis=0) if (label == i).any() else centres[i] for i in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return label, float(((x - centres[label]) ** 2).sum())


def fit(x: np.ndarray, k: int, steps: int = 30, tolerance: float = 1e-4, seed: int = 42) -> Params:
    """Baum-Welch from k-means; a sticky start of the transitions and a small ridge on covariances."""
    d, eye = x.shape[1], np.eye(x.shape[1])
    label = _centres(x, k, np.random.default_rng(seed))
    spread = np.cov(x.T).reshape(d, d)
    own = [x[label == i] for i in range(k)]
    moves = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1))
    p = Params(np.full(k, 1 / k), moves, np.array([o.mean(axis=0) if len(o) else x.mean(axis=0) for o in own]), np.array([(np.cov(o.T).reshape(d, d) if len(o) > d else spread) + 1e-4 * eye for o in own]), -np.inf)
    for step in range(steps):
        e = emissions(x, p)
        (a, total), b = forward(e, p), backward(e, p)
        gamma = a * b + 1e-300
        gamma /= gamma.sum(axis=1, keepdims=True)
        pair = a[:-1, :, None] * p.moves[None] * (scaled(e)[0][1:] * b[1:])[:, None, :]
        pair = (pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0) + 1e-10
        mass = gamma.sum(axis=0) + 1e-10
        means = gamma.T @ x / mass[:, None]
        covs = np.array([((x - m).T * gamma[:, i]) @ (x - m) / mass[i] + 1e-4 * eye for i, m in enumerate(means)])
        done = step > 0 and total - p.loglik < tolerance
        p = Params((gamma[0] + 1e-10) / (gamma[0] + 1e-10).sum(), pair / pair.sum(axis=1, keepdims=True), means, covs, p.loglik if done else total)
        if done:
            break
    return p


def forward_filter(x: np.ndarray, p: Params) -> np.ndarray:
    """P(state at t | values up to t), rows sum to one."""
    return forward(emissions(x, p), p)[0]


def bic(p: Params, n: int, d: int) -> float:
    k = p.states
    return -2 * p.loglik + np.log(n) * (k - 1 + k * (k - 1) + k * d + k * d * (d + 1) / 2)


def state_labels(p: Params) -> list[str]:
    """The third of states with the least mean return is risk_off, the top third risk_on (at least one each)."""
    order = np.argsort(p.means[:, 0], kind="stable")
    third = max(1, p.states // 3)
    labels = ["neutral"] * p.states
    for i in order[:third]:
        labels[i] = "risk_off"
    for i in order[-third:]:
        labels[i] = "risk_on"
    return labels


def classify_hmm(features: DataFrame, first: int = 504, refit: int = 126, most: int = 2520, burn: int = 200, counts: tuple[int, ...] = (2, 3, 4), seed: int = 42) -> DataFrame:
    """``date, regime, score``: labels from models fitted at anchors on earlier rows only.

    Anchors come every ``refit`` rows from row ``first``; each is a group of its own that holds its training rows
    (``most`` at most) and the rows up to the next anchor, so fits run in parallel. The number of states is chosen
    once, on the first anchor's rows. Shorter histories, earlier rows and failed fits are neutral with score 0.
    """
    features = stash(features, "features")
    full = features.dropna(subset=list(FEATURES))
    rows = full.withColumn("n", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # one row a date
    size = full.count()
    neutral = features.select("date", F.lit("neutral").alias("regime"), F.lit(0.0).alias("score"))
    if size < first + refit:
        return neutral

    def choose(block: pd.DataFrame) -> pd.DataFrame:
        head = block.sort_values("n")[list(FEATURES)].to_numpy()
        z, found = (head - head.mean(axis=0)) / (head.std(axis=0) + 1e-9), {}
        for c in counts:
            try:
                found[c] = bic(fit(z, c, seed=seed), len(z), z.shape[1])
            except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                continue
        return pd.DataFrame({"k": [min(found, key=found.get) if found else counts[0]]})

    k = rows.filter(f"n < {first} AND n >= {first - most}").withColumn("group", F.lit(1)).groupBy("group").applyInPandas(choose, "k int").first()[0]
    # every row goes to the anchors that train on it or label it
    low, high = f"greatest(0, ceil((n - {first} - {refit - 1}) / {refit}))", f"least({(size - 1 - first) // refit}, floor((n + {most} - {first}) / {refit}))"
    grouped = rows.filter(f"{low} <= {high}").withColumn("anchor", F.explode(F.expr(f"transform(sequence(cast({low} AS bigint), cast({high} AS bigint)), i -> {first} + i * {refit})")))

    def label(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("n")
        anchor = block["anchor"].iloc[0]
        x = block[list(FEATURES)].to_numpy()
        seen = (block["n"] < anchor).to_numpy()
        x = (x - x[seen].mean(axis=0)) / (x[seen].std(axis=0) + 1e-9)
        new = block.loc[~seen, ["date"]].copy()
        try:
            p = fit(x[seen], k, seed=seed)
            states = forward_filter(x[max(0, seen.sum() - burn) :], p)[-len(new) :]
            names = np.array(state_labels(p))
            new["regime"] = names[states.argmax(axis=1)]
            new["score"] = states[:, names == "risk_on"].sum(axis=1) - states[:, names == "risk_off"].sum(axis=1)
        except (np.linalg.LinAlgError, ValueError, FloatingPointError):
            new["regime"], new["score"] = "neutral", 0.0
        return new

    # a number of its own: the fits are few and heavy, and would be merged into one task by their size
    found = grouped.repartition(len(range(first, size, refit)), "anchor").groupBy("anchor").applyInPandas(label, "date date, regime string, score double")
    return neutral.select("date").join(found, "date", "left").select("date", F.coalesce("regime", F.lit("neutral")).alias("regime"), F.coalesce("score", F.lit(0.0)).alias("score"))
