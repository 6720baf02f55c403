"""Variable selection with a controlled false discovery rate.

The K random experiments are one Spark job of K tasks: each gets the standardized design, draws its own dummies and
returns which columns were active as each dummy entered, for all T up to a cap in one run.  A design of at most GATHERED
bytes is broadcast; a larger one stays on the executors where it has more rows than columns (operators/tall.py), else it
is broadcast up to MAX_BROADCAST.  Frequencies are an aggregation of those rows; calibration works on p x T numbers.
"""

from __future__ import annotations

import contextlib
import dataclasses
import math
import statistics
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dummies import cluster_factors, dummies
from ..functions.solvers import SOLVERS, TOL, states_of
from ..operators import clusters, penalties
from ..operators.calibrate import ar1_reach
from ..operators.matrix import MAX_GRAM, check
from ..operators.tall import Tall, tall

GATHERED, MAX_BROADCAST, EPS = 64 << 20, 200 << 20, float(np.finfo(float).eps)
SOLVER_OPTIONS = frozenset({"lambda2", "rho", "groups", "penalty", "inner"})
GREEDY = frozenset({"tomp", "tools", "tmp", "tgp", "tacgp", "tncgmp", "tncgmp_full", "tafs"})


@dataclasses.dataclass
class Control:
    k: int = 20
    max_layers: int = 10
    solver: str = "tlars"
    strategy: str = "standard"
    distribution: str = "normal"
    scaling: str = "l2"
    opt_threshold: float = 0.75
    t_cap: bool = True
    seed: int = 0
    options: dict = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Selection:
    """fdp_hat and counts are [levels, T, V]; without a grid of rho there is one level.  phi and phi_prime are those of
    the winning cell, or of the last T at the operating level where nothing is feasible."""

    selected: np.ndarray
    phi: np.ndarray
    phi_prime: np.ndarray
    fdp_hat: np.ndarray
    counts: np.ndarray
    grid: np.ndarray
    v: float
    t_stop: int
    layers: int
    rho: float | None = None
    rho_grid: np.ndarray | None = None


def _gathered(x: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and further columns in the order of row_id, on the driver; size-checked."""
    p, n = check(x), x.count()
    if n * (p + len(columns)) * 8 > MAX_BROADCAST:
        raise ValueError(f"{n} x {p} is more than is broadcast; use fewer columns (screening) or rows")
    rows = x.select("row_id", "features", *[F.col(y).cast("double").alias(f"y{k}") for k, y in enumerate(columns)]).toPandas().sort_values("row_id", kind="stable")
    t = rows[[f"y{k}" for k in range(len(columns))]].to_numpy(float)
    if not np.isfinite(t).all():
        raise ValueError("the response has null or infinite values")
    return np.array(rows["features"].tolist(), float), t


def _tall(x: DataFrame, columns: list[str], layers: int, scaling: str = "l2") -> Tall | None:
    """The design where it is left on the executors."""
    p = check(x)
    bad = [F.max((F.col(y).cast("double").isNull() | F.isnan(F.col(y).cast("double")) | (F.abs(F.col(y).cast("double")) == float("inf"))).cast("int")) for y in columns]
    n, *wrong = x.agg(F.count("*"), *bad).first()
    most = p * (1 + layers) + len(columns)
    if n * (p + len(columns)) * 8 <= GATHERED or n <= most or most > MAX_GRAM:
        return None
    if any(wrong):
        raise ValueError("the response has null or infinite values")
    return tall(x, columns, n, p, scaling)


def centered(x: DataFrame) -> tuple[np.ndarray, int]:
    """A matrix with the products of the centered columns, and how many rows they have."""
    far = _tall(x, [], 0)
    if far is not None:
        with released(far):
            return far.raw, far.shape[0]
    m, _ = _gathered(x, [])
    return m - m.mean(0), len(m)


def designs(x: DataFrame, responses: list[str], scaling: str = "l2", layers: int = 10) -> tuple[np.ndarray | Tall, np.ndarray]:
    """Standardized columns and centered responses [n, q], for up to so many layers of dummies.  What is left on the
    executors comes as its triangle (Tall) and the responses' part of it, to be let go of by `released`."""
    far = _tall(x, responses, layers, scaling)
    if far is not None:
        return far, far.ends
    m, t = _gathered(x, responses)
    m = m - m.mean(0)
    scale = np.linalg.norm(m, axis=0) / (1 if scaling == "l2" else math.sqrt(len(m) - 1))
    return m / np.where(scale < EPS, 1.0, scale), t - t.mean(0)


def design(x: DataFrame, y: str, scaling: str = "l2", layers: int = 10) -> tuple[np.ndarray | Tall, np.ndarray]:
    """The same for one response [n]."""
    m, t = designs(x, [y], scaling, layers)
    return m, t[:, 0]


@contextlib.contextmanager
def released(m: np.ndarray | Tall) -> Iterator[None]:
    try:
        yield
    finally:
        if isinstance(m, Tall):
            m.free()


def rows_for(m: np.ndarray | Tall) -> np.ndarray:
    """A matrix with the products of the standardized columns."""
    return m.triangle if isinstance(m, Tall) else m


def _lag(m: np.ndarray | Tall) -> float:
    """The mean over rows of the lag-1 ratio along columns."""
    return m.lag() if isinstance(m, Tall) else np.mean((m[:, 1:] * m[:, :-1]).sum(1) / np.maximum((m * m).sum(1), EPS))


def _found(z: np.ndarray, targets: np.ndarray, p: int, t_stop: int, c: Control, betas: bool) -> Iterator[pd.DataFrame]:
    """Rows of one experiment, of which z is [X D]."""
    options = {o: v for o, v in c.options.items() if o in SOLVER_OPTIONS}
    for q, found in enumerate(states_of(partial(SOLVERS[c.solver], **options), z, targets, p, t_stop, c.options.get("exact", False), c.solver == "tafs")):
        found += [found[-1] if found else np.zeros(z.shape[1])] * (t_stop - len(found))
        for t, beta in enumerate(found):
            on = np.flatnonzero(np.abs(beta if betas and t == t_stop - 1 else beta[:p]) > EPS)
            yield pd.DataFrame({"q": np.int32(q), "t": np.int32(t), "col_id": on.astype(np.int32), "beta": beta[on]})


def _far_runs(m: Tall, ys: np.ndarray, c: Control, layers: int, t_stop: int, betas: bool) -> DataFrame:
    p = m.shape[1]
    x, more = m.triangle, layers * p

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        targets = np.vstack([ys, np.zeros((more, ys.shape[1]))])
        for f in frames:
            for d in f["d"]:
                z = np.hstack([np.vstack([x, np.zeros((more, p))]), np.frombuffer(d).reshape(-1, more)])
                yield from _found(z, targets, p, t_stop, c, betas)

    return m.drawn(c, layers).mapInPandas(run, "q int, t int, col_id int, beta double")


def _runs(spark, m: np.ndarray | Tall, ys: np.ndarray, control: Control, layers: int, t_stop: int, betas: bool) -> DataFrame:
    """One task for each experiment: rows (q, t, col_id, beta) of the columns active as dummy t + 1 entered, for each
    response q (a column of ys); with betas also those of dummies (col_id >= p) at the last t."""
    if isinstance(m, Tall):
        return _far_runs(m, ys, control, layers, t_stop, betas)
    n, p = m.shape
    shared = spark.sparkContext.broadcast((m, ys, control))  # bounded by MAX_BROADCAST

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, targets, c = shared.value
        for f in frames:
            for k in f["id"]:
                d = dummies(n, p, layers, int(k), c.seed, c.strategy, c.distribution, c.options.get("factors"))
                d = d - d.mean(0)
                if "factors" not in c.options:
                    norm = np.linalg.norm(d, axis=0) / (1 if c.scaling == "l2" else math.sqrt(n - 1))
                    d /= np.where(norm < EPS, 1.0, norm)
                yield from _found(np.hstack([x, d]), targets, p, t_stop, c, betas)

    return spark.range(control.k).repartition(control.k, "id").mapInPandas(run, "q int, t int, col_id int, beta double")


def experiments_for(spark, m: np.ndarray | Tall, ys: np.ndarray, control: Control, layers: int, t_stop: int) -> np.ndarray:
    """Phi [q, T, p]: how often each column was active when dummy 1 .. T entered."""
    rows = _runs(spark, m, ys, control, layers, t_stop, False).groupBy("q", "t", "col_id").count().collect()  # at most q x T x p
    phi = np.zeros((ys.shape[1], t_stop, m.shape[1]))
    for r in rows:
        phi[r["q"], r["t"], r["col_id"]] = r["count"] / control.k
    return phi


def experiments(spark, m: np.ndarray | Tall, y: np.ndarray, control: Control, layers: int, t_stop: int) -> np.ndarray:
    """Phi [T, p] of one response."""
    return experiments_for(spark, m, y[:, None], control, layers, t_stop)[0]


def voting_grid(k: int) -> np.ndarray:
    v = 0.5 + np.arange(k) / k
    return np.append(v[v < 1 - EPS], 1 - EPS)


def deflated(phi: np.ndarray, n_dummies: int) -> np.ndarray:
    """Phi' of the last row of phi [T, p]."""
    d = np.diff(phi, axis=0, prepend=0)
    gain = d[:, phi[-1] > 0.5].sum(1)
    rest = (phi.shape[1] - phi.sum(1)) / (n_dummies - np.arange(len(phi)))
    scale = np.where(gain > TOL, 1 - rest / np.where(gain > TOL, gain, 1), 0)
    return np.clip(scale @ d, 0, 1)


def estimated_fdp(phi: np.ndarray, prime: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    above = phi[None, :] > grid[:, None]
    r = above.sum(1)
    return np.where(r > 0, np.clip((above * (1 - prime)).sum(1) / np.maximum(r, 1), 0, 1), 0), r


def _gap_in_groups(phi: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The least difference of each value to another one with its label; infinite for a label of one."""
    order = np.lexsort((phi, labels))
    step = np.where(np.diff(labels[order]) == 0, np.diff(phi[order]), np.inf)
    out = np.empty(len(phi))
    out[order] = np.minimum(np.append(np.inf, step), np.append(step, np.inf))
    return out


def _gap_in_window(phi: np.ndarray, reach: int) -> np.ndarray:
    """The same among places at most `reach` apart."""
    out = np.full(len(phi), np.inf)
    for k in range(1, min(reach, len(phi) - 1) + 1):
        gap = np.abs(phi[k:] - phi[:-k])
        np.minimum(out[k:], gap, out=out[k:])
        np.minimum(out[:-k], gap, out=out[:-k])
    return out


def _over(gap: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(gap), 2 - gap, 2.0)


def _spread(full: np.ndarray, length: int) -> np.ndarray:
    """`length` evenly spaced places of an ascending grid, halves rounded up."""
    if length == 1:
        return full[-1:]
    at = np.floor(np.arange(length) * (len(full) - 1) / (length - 1) + 0.5).astype(int)
    return full[np.minimum(at, len(full) - 1)]


class Dependence:
    """How frequencies of related columns are deflated: phi [T, p] -> [levels, T, p].

    equi and ar1 take the gaps at every t; bt, nn and prior_groups take those of the terminal t at every level of a grid
    of rho.  equi on columns whose mean correlation is at most 0.02 leaves phi alone, a level without neighbours halves it.
    Options: grid_length (20), linkage (single), groups (labels, or a list of them, which are refined), threshold (0.02).
    """

    def __init__(self, method: str | None, m: np.ndarray | Tall, options: dict) -> None:
        p = m.shape[1]
        self.method, self.rho, self.labels, self.reach, self.corr = method, None, [], 0, None
        low = options.get("threshold", 0.02)
        if method == "equi":
            m = rows_for(m)
            rho = options.get("cor_coef", (np.square(m @ (1 / np.maximum(np.linalg.norm(m, axis=0), EPS))).sum() - p) / (p * (p - 1)))
            self.labels = [np.zeros(p, int)] if abs(rho) > low else []
        elif method == "ar1":
            rho = options["cor_coef"] if "cor_coef" in options else abs(_lag(m))
            self.reach = ar1_reach(rho) if 0 < rho < 1 else 1 if rho == 0 else p
        elif method in ("bt", "nn", "prior_groups"):
            m = rows_for(m)
            norm = np.linalg.norm(m, axis=0)
            corr = np.abs(m.T @ m) / np.maximum(np.outer(norm, norm), EPS)
            length = min(options.get("grid_length", 20), p)
            if method == "nn":
                self.rho, self.corr = np.linspace(0, 1, length), np.where(np.eye(p, dtype=bool), -1.0, corr)
            else:
                self._trees(np.clip(1 - corr, 0, None), length, options, method == "prior_groups")
        elif method is not None:
            raise ValueError(f"unknown dependence {method}")
        size = len(self.rho) if self.rho is not None else 1
        self.operating = min(max(math.floor(0.75 * size + 0.5) - 1, 0), size - 1)

    def _trees(self, d: np.ndarray, length: int, options: dict, grouped: bool) -> None:
        """A tree for each group of columns (bt: one for all), cut at heights spread over all merges and at zero."""
        given = options["groups"] if grouped else np.zeros(len(d), int)
        labels = np.atleast_2d(np.asarray(given, int))
        _, fine = np.unique(labels, axis=1, return_inverse=True)
        trees = [(of, clusters.tree(d[np.ix_(of, of)], options.get("linkage", "single"))) for of in clusters.members(fine.ravel())]
        heights = np.sort([m.distance for _, t in trees for m in t])[::-1]
        cuts = _spread(np.append(heights, 0.0), length)  # the last level: every column alone, but for equal ones
        self.rho = 1 - cuts
        for h in cuts:
            label, first = np.empty(len(d), int), 0
            for of, t in trees:
                label[of] = first + clusters.cut_by_height(t, len(of), h)
                first += len(of)
            self.labels.append(label)

    def adjusted(self, phi: np.ndarray) -> np.ndarray:
        if self.method == "ar1":
            return np.array([[row / _over(_gap_in_window(row, self.reach)) for row in phi]])
        if self.method == "equi":
            return np.array([[row / _over(_gap_in_groups(row, self.labels[0])) if self.labels else row for row in phi]])
        if self.method == "nn":
            gap = np.abs(phi[-1][:, None] - phi[-1][None, :])
            return np.array([phi / _over(np.where(self.corr >= r, gap, np.inf).min(1)) for r in self.rho])
        if self.rho is not None:
            return np.array([phi / _over(_gap_in_groups(phi[-1], label)) for label in self.labels])
        return phi[None]


def pick(fdp: np.ndarray, counts: np.ndarray, t_fdr: float, faithful: bool = False) -> tuple[int, int, int] | None:
    """(level, T, v) of the winner in [levels, T, V]: most selections within the target, then larger v, level, T.  The
    last of several T is no candidate; `faithful` admits cells beyond the target that have that number."""
    open_ = slice(0, max(fdp.shape[1] - 1, 1))
    fdp, counts = fdp[:, open_], counts[:, open_]
    fits = fdp <= t_fdr
    if not fits.any():
        return None
    ties = np.argwhere((counts == counts[fits].max()) & (fits | faithful))
    level, t, v = max(map(tuple, ties.tolist()), key=lambda c: (c[2], c[0], c[1]))
    return level, t, v


def select(x: DataFrame, y: str, t_fdr: float = 0.1, control: Control | None = None, dependence: str | None = None) -> Selection:
    """Columns of x (row_id, features, y) that drive y, with the expected share of false ones at most t_fdr.

    `dependence` deflates frequencies among related columns (see Dependence).
    """
    c = control or Control()
    m, target = design(x, y, c.scaling, c.max_layers)
    with released(m):
        return calibrated(x.sparkSession, m, target, t_fdr, c, dependence)


def calibrated(spark, m: np.ndarray | Tall, target: np.ndarray, t_fdr: float, c: Control, dependence: str | None = None) -> Selection:
    """The selection on a standardized design."""
    near = Dependence(dependence, m, c.options)
    n, p = m.shape
    grid = voting_grid(c.k)
    at, opt = near.operating, int(np.flatnonzero(grid <= c.opt_threshold)[-1])

    def judged(phi: np.ndarray, layers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """fdp [levels, V], counts, Phi' and Phi [levels, p] at the last t of phi."""
        levels = near.adjusted(phi)
        primes = np.array([deflated(a, layers * p) for a in levels])
        cells = [estimated_fdp(a[-1], prime, grid) for a, prime in zip(levels, primes, strict=True)]
        return np.array([f for f, _ in cells]), np.array([r for _, r in cells]), primes, levels[:, -1]

    layers = c.max_layers if c.strategy == "skipl" else 1
    while True:
        fdp, *_ = judged(experiments(spark, m, target, c, layers, 1), layers)
        if fdp[at, opt] <= t_fdr or layers >= c.max_layers:
            break
        layers += 1
    cap = min(layers * p, math.ceil(n / 2)) if c.t_cap else layers * p
    t_run = min(5, cap)
    while True:  # paths are stable when T grows, so T is replayed from one run
        phi = experiments(spark, m, target, c, layers, t_run)
        rows, still, best = [], 0, 0
        for t in range(1, t_run + 1):
            rows.append(judged(phi[:t], layers))
            fdp, r = rows[-1][0][at], int(rows[-1][1][at, 0])
            still, best = (0, r) if r > best else (still + 1, best)
            done = fdp[-1] > t_fdr or c.solver in GREEDY and still >= 5
            if done:
                break
        if done or t_run >= cap:
            break
        t_run = min(2 * t_run, cap)
    fdps, counts = (np.array([r[k] for r in rows]).swapaxes(0, 1) for k in (0, 1))
    cell = pick(fdps, counts, t_fdr, c.options.get("faithful", False))
    if cell is None:
        return Selection(np.zeros(0, int), rows[-1][3][at], rows[-1][2][at], fdps, counts, grid, 1.0, len(rows), layers, None, near.rho)
    level, t, v = cell
    rho = float(near.rho[level]) if near.rho is not None else None
    return Selection(np.flatnonzero(rows[t][3][level] > grid[v]), rows[t][3][level], rows[t][2][level], fdps, counts, grid, float(grid[v]), t + 1, layers, rho, near.rho)


@dataclasses.dataclass
class Screened:
    selected: np.ndarray
    fdr: float
    phi: np.ndarray
    beta: np.ndarray
    dummy_betas: np.ndarray
    confidence: float = 0.0


def _rated(found: np.ndarray, phi: np.ndarray, beta: np.ndarray, drawn: np.ndarray, confidence: float = 0.0) -> Screened:
    return Screened(found, 1 / len(found) if len(found) else 0.0, phi, beta, drawn, confidence)


def _screen_blocks(p: int, blocks: int) -> np.ndarray:
    """Labels of contiguous blocks, the first ones a column longer where p isn't a multiple."""
    return np.repeat(np.arange(blocks), [p // blocks + (b < p % blocks) for b in range(blocks)])


def _screen_over(phi: np.ndarray, m: np.ndarray | Tall, dependence: str, options: dict) -> np.ndarray:
    """What screening divides frequencies by; a gap above 1.5 counts as none."""
    p, low = m.shape[1], options.get("threshold", 0.02)
    u = rows_for(m) / np.maximum(np.linalg.norm(rows_for(m), axis=0), EPS)
    mean_corr = lambda of: (np.square(u[:, of].sum(1)).sum() - len(of)) / (len(of) * (len(of) - 1)) if len(of) > 1 else 0.0
    if dependence == "ar1":
        rho = min(0.999, max(0.001, abs(_lag(m))))
        gap = _gap_in_window(phi, max(1, math.ceil(math.log(low) / math.log(rho))))
    else:
        labels = np.zeros(p, int) if dependence == "equi" else _screen_blocks(p, options.get("blocks", 5))
        rho = sum(len(of) * mean_corr(of) for of in clusters.members(labels)) / p
        if abs(rho) <= low:
            return np.ones(p)
        gap = _gap_in_groups(phi, labels)
    return 2 - np.where(gap > 1.5, 0.0, gap)


def screened(spark, m: np.ndarray | Tall, ys: np.ndarray, c: Control, dependence: str | None = None) -> list[Screened]:
    """Screening of each column of ys from one job: frequencies above one half at the first dummy."""
    p, q = m.shape[1], ys.shape[1]
    rows = _runs(spark, m, ys, c, 1, 1, True).collect()  # the active columns of k x q runs with one dummy each
    phi, beta, drawn = np.zeros((q, p)), np.zeros((q, p)), [[] for _ in range(q)]
    for r in rows:
        if r["col_id"] < p:
            phi[r["q"], r["col_id"]] += 1 / c.k
            beta[r["q"], r["col_id"]] += r["beta"] / c.k
        else:
            drawn[r["q"]].append(r["beta"])
    out = []
    for k in range(q):
        f = phi[k] / _screen_over(phi[k], m, dependence, c.options) if dependence else phi[k]
        out.append(_rated(np.flatnonzero(f > 0.5), f, beta[k], np.sort(drawn[k])))
    return out


def bootstrapped(s: Screened, resamples: int = 1000, step: float = 0.001, seed: int = 0) -> Screened:
    """The columns whose mean coefficient lies outside a bias-corrected normal interval of resampled dummy means, at the
    least confidence that selects no more columns than screening did."""
    if not len(s.dummy_betas):
        return s
    g = np.random.default_rng([seed, 7])
    means = np.array([s.dummy_betas[g.integers(0, len(s.dummy_betas), len(s.dummy_betas))].mean() for _ in range(resamples)])
    center, sd = 2 * s.dummy_betas.mean() - means.mean(), means.std(ddof=1)
    for level in np.arange(0, 1, step):
        z = statistics.NormalDist().inv_cdf(0.5 + level / 2) * sd
        out = np.flatnonzero((s.beta < center - z) | (s.beta > center + z))
        if len(out) <= np.count_nonzero(s.phi > 0.5):
            return _rated(out, s.phi, s.beta, s.dummy_betas, float(level))
    return _rated(np.zeros(0, int), s.phi, s.beta, s.dummy_betas, 1.0)


def screen(x: DataFrame, y: str, control: Control | None = None, dependence: str | None = None, bootstrap: bool = False) -> tuple[np.ndarray, float]:
    """(selected columns, estimated rate 1 / their number); dependence: ar1, equi or block_equi."""
    c = control or Control()
    m, target = design(x, y, c.scaling, 1)
    with released(m):
        s = screened(x.sparkSession, m, target[:, None], c, dependence)[0]
    s = bootstrapped(s, seed=c.seed) if bootstrap else s
    return s.selected, s.fdr


def screen_many(x: DataFrame, responses: list[str], control: Control | None = None, t_fdr: float = 0.1, bounds: tuple = (0.05, 0.15)) -> dict[str, tuple[np.ndarray, str]]:
    """Screening of several responses in one job; one whose estimates are out of bounds gets a full selection."""
    c = control or Control()
    m, ys = designs(x, responses, c.scaling, c.max_layers)
    lo, hi = bounds
    out = {}
    with released(m):
        for k, s in enumerate(screened(x.sparkSession, m, ys, c)):
            b = bootstrapped(s, seed=c.seed)
            if lo <= b.fdr <= hi and (s.fdr > hi or b.fdr >= s.fdr):
                out[responses[k]] = (b.selected, "bootstrap")
            elif lo <= s.fdr <= hi:
                out[responses[k]] = (s.selected, "ordinary")
            else:
                out[responses[k]] = (calibrated(x.sparkSession, m, ys[:, k], t_fdr, c).selected, "full")
    return out


def select_groups(x: DataFrame, y: str, t_fdr: float = 0.1, corr_max: float = 0.5, informed: bool = False, control: Control | None = None, lambda2: float | None = None, linkage: str = "single", groups: np.ndarray | None = None, grouped_dummies: bool = True) -> Selection:
    """Grouped selection by an elastic net (or one informed by groups), with dummies as correlated as the groups.

    Groups are given or cut from a tree of correlations at corr_max.  lambda2: given, or the largest one within a
    standard error of the best ridge error (informed: of the informed net), in the solver's scale.
    """
    c = control or Control()
    m, target = design(x, y, c.scaling, c.max_layers)
    n, p = m.shape
    with released(m):
        rows = rows_for(m)
        if groups is None:
            norm = np.linalg.norm(rows, axis=0)
            merges = clusters.tree(np.clip(1 - np.abs(rows.T @ rows) / np.maximum(np.outer(norm, norm), EPS), 0, None), linkage)
            groups = clusters.cut_by_height(merges, p, 1 - corr_max)
        groups = np.asarray(groups, int)
        if lambda2 is None:
            found = penalties.informed_cv(x, y, group_penalty(groups), seed=c.seed) if informed else penalties.elastic_net_cv(x, y, 0.0, seed=c.seed)
            lambda2 = found.at_1se * (1 if informed else p / 2) * (n - 1 if c.scaling == "zscore" else 1)
        more = {"groups": groups, "lambda2": lambda2, "exact": True} | ({"factors": cluster_factors(rows, groups, n)} if grouped_dummies else {})
        c = dataclasses.replace(c, solver="tienet" if informed else "tenet", options=c.options | more)
        return calibrated(x.sparkSession, m, target, t_fdr, c)


def group_penalty(groups: np.ndarray) -> np.ndarray:
    """K of the informed net: 1 / size between columns of one group."""
    same = groups[:, None] == groups[None, :]
    return same / same.sum(0)


def select_tikhonov(x: DataFrame, y: str, penalty: np.ndarray, t_fdr: float = 0.1, control: Control | None = None) -> Selection:
    c = control or Control()
    return select(x, y, t_fdr, dataclasses.replace(c, solver="tcienet", options=c.options | {"penalty": penalty}))


@dataclasses.dataclass
class SparseComponents:
    loadings: np.ndarray  # [p, m]
    active: list[np.ndarray]
    adjusted_variance: np.ndarray


def sparse_components(x: DataFrame, count: int, t_fdr: float = 0.1, control: Control | None = None, lambda2: float | None = None, thresholded: bool = False, ridge: float = 1e-6) -> SparseComponents:
    """Principal components with loadings on selected columns only.

    Each component's scores are a response of the grouped selection; its loadings are the ridge coefficients of the
    scores on the selected columns (or, thresholded, its largest loadings, as many), of length one.  The adjusted
    variance is that of the QR decomposition of the new scores.
    """
    from ..operators.linear import components, scores

    c = control or Control()
    found = components(x, count)
    scored = scores(x, found)
    loadings, active = np.zeros((len(found.mean), len(found.sd))), []
    raw, n = centered(x)
    for k in range(len(found.sd)):
        y = x.join(scored.select("row_id", F.col("scores")[k].alias("__score")), "row_id")
        own = dataclasses.replace(c, seed=c.seed * 1_000_003 + k)
        on = select_groups(y, "__score", t_fdr, control=own, lambda2=lambda2).selected
        if len(on) and thresholded:
            on = np.sort(np.argsort(-np.abs(found.loadings[:, k]), kind="stable")[: len(on)])
            loadings[on, k] = found.loadings[on, k]
        elif len(on):
            a = raw[:, on]
            loadings[on, k] = np.linalg.solve(a.T @ a + ridge * np.eye(len(on)), a.T @ (raw @ found.loadings[:, k]))
        loadings[:, k] /= np.linalg.norm(loadings[:, k]) or 1.0
        active.append(on)
    r = np.linalg.qr(raw @ loadings, mode="r")
    return SparseComponents(loadings, active, np.diag(r) ** 2 / (n - 1))
