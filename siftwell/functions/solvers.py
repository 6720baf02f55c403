"""Forward selection that stops when so many dummies are active; numpy kernels that run inside tasks.

A kernel takes Z = [X D] with centered columns of unit norm (the first p are real), centered y, and the number of
dummies to stop at, and yields after each step the coefficients as a dense vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np

TOL = 1e-6


def reduced(z: np.ndarray, ys: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Z and the columns of ys on as few rows as keep all their products: the triangle of a QR decomposition, made a block
    of rows at a time, as kernels read rows by products only.  Of the first p columns those that are equal, or but for the
    sign, stay so to the last bit: ties go to the first.  A matrix that isn't taller than the triangle stays."""
    n, m = z.shape
    if n <= m + ys.shape[1]:
        return z, ys
    r, step = np.zeros((0, m + ys.shape[1])), max(4 * (m + ys.shape[1]), 4096)
    for at in range(0, n, step):
        r = np.linalg.qr(np.vstack([r, np.hstack([z[at : at + step], ys[at : at + step]])]), mode="r")
    first: dict[bytes, tuple[int, float]] = {}
    for j in range(p):
        column = np.ascontiguousarray(z[:, j])
        sign = -1.0 if column[np.abs(column).argmax()] < 0 else 1.0
        k, its = first.setdefault(hashlib.sha256((column * sign + 0.0).tobytes()).digest(), (j, sign))
        r[:, j] = r[:, k] * (sign * its)
    return r[:, :m], r[:, m:]


def _independent(z: np.ndarray, active: list[int], j: int) -> bool:
    """Whether column j isn't in the span of the active ones, by the pivot that it would add."""
    if not active:
        return True
    a = z[:, active]
    w = np.linalg.lstsq(a, z[:, j], rcond=None)[0]
    return float(((z[:, j] - a @ w) ** 2).sum()) > TOL * float(z[:, j] @ z[:, j])


def least_angle(z: np.ndarray, y: np.ndarray, kind: str = "lars") -> Iterator[np.ndarray]:
    """lars; lasso (a coefficient that reaches zero leaves); stepwise (full least-squares steps); stagewise (directions
    against a coefficient's correlation leave first)."""
    n, m = z.shape
    beta, active, banned = np.zeros(m), [], np.zeros(m, bool)
    fit, leave = np.zeros(n), None
    for _ in range(8 * min(n, m)):
        c = z.T @ (y - fit)
        top = np.abs(np.where(banned, 0, c))
        if leave is None:
            free = np.setdiff1d(np.arange(m), active)
            if len(active) >= min(n - 1, m) or not len(free) or (active and top.max() < 100 * TOL * TOL):
                return
            j = int(free[top[free].argmax()])
            if top[j] < 100 * np.finfo(float).eps:
                return
            if not _independent(z, active, j):
                banned[j] = True
                continue
            active.append(j)
        leave = None
        sign = np.sign(c[active])
        if kind == "stepwise":  # what is fitted already has no correlation left
            sign[np.abs(c[active]) < 1e-9 * np.abs(c[active]).max()] = 0
        while True:
            za = z[:, active]
            w = np.linalg.solve(za.T @ za, sign)
            against = w * sign
            if kind != "stagewise" or against.min() >= 0 or len(active) == 1:
                break
            out = int(against.argmin())
            active.pop(out)
            sign = np.delete(sign, out)
        norm = 1 / np.sqrt(sign @ w)
        u = za @ (w * norm)
        top_c = np.abs(c[active]).max()
        gamma = top_c / norm
        if kind != "stepwise":
            a, rest = z.T @ u, np.setdiff1d(np.flatnonzero(~banned), active)
            gap, pace = np.concatenate([top_c - c[rest], top_c + c[rest]]), np.concatenate([norm - a[rest], norm + a[rest]])
            own = np.abs(pace) > 1e-9 * norm  # else it goes along with the active ones, as an equal column does
            ways = gap[own] / pace[own]
            ways = ways[ways > 1e-12]
            if len(ways):
                gamma = min(gamma, ways.min())
        if kind == "lasso":
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = -beta[active] / (w * norm)
            cross = np.where((cross > 1e-12) & np.isfinite(cross), cross, np.inf)
            if cross.min() < gamma:
                gamma, leave = cross.min(), active[int(cross.argmin())]
        beta[active] += gamma * w * norm
        fit = z @ beta
        if leave is not None:
            beta[leave] = 0
            active.remove(leave)
        yield beta.copy()
        if kind == "stepwise" and np.linalg.norm(y - fit) < TOL:
            return


def greedy(z: np.ndarray, y: np.ndarray, kind: str = "omp") -> Iterator[np.ndarray]:
    """omp, ools (score over the residual column norm), mp and ncgmp (one atom, which may repeat), ncgmp_full (as omp), gp
    and acgp (gradient with exact line search, the latter with a conjugate correction)."""
    n, m = z.shape
    beta, active, last = np.zeros(m), [], None
    norms = (z**2).sum(0) if kind in ("ools", "ncgmp") else None
    rest = z.copy() if kind == "ools" else None
    for _ in range(8 * min(n, m)):
        r = y - z @ beta
        c = z.T @ r
        score = np.abs(c)
        if kind == "ools":
            left = (rest**2).sum(0)
            score = np.where(left > TOL * norms, score / np.sqrt(np.maximum(left, 1e-300)), 0)
        repeats = kind in ("mp", "ncgmp", "gp", "acgp")
        if not repeats:
            score = score.copy()
            score[active] = 0
        j = int(score.argmax())
        if score[j] < 100 * np.finfo(float).eps or len(active) >= min(n - 1, m):
            return
        if j not in active:
            active.append(j)
        if kind == "mp":
            beta[j] += c[j]
        elif kind == "ncgmp":
            beta[j] += c[j] / norms[j]
        elif kind in ("gp", "acgp"):
            d = np.zeros(m)
            d[active] = c[active]
            if kind == "acgp" and last is not None:
                zd, zl = z @ d, z @ last
                d = d - (zd @ zl) / max(zl @ zl, 1e-300) * last
            zd = z @ d
            beta += (r @ zd) / max(zd @ zd, 1e-300) * d
            last = d
        else:
            beta[active] = np.linalg.lstsq(z[:, active], y, rcond=None)[0]
            if kind == "ools":
                q = rest[:, j] / max(np.linalg.norm(rest[:, j]), 1e-300)
                rest = rest - np.outer(q, q @ rest)
        yield beta.copy()


def adaptive(z: np.ndarray, y: np.ndarray, rho: float = 0.3) -> Iterator[np.ndarray]:
    """Coefficients move rho of the way to least squares on the active columns.  No column enters while an active one has
    the largest correlation, so rho = 1 is omp and a small rho follows the least angle path.  Correlations move like the
    coefficients: rows are read only as a column enters."""
    n, m = z.shape
    beta, active = np.zeros(m), []
    c = z.T @ y
    for _ in range(math.ceil(8 * min(n, m) / rho)):
        j = int(np.abs(c).argmax())
        if abs(c[j]) < 100 * np.finfo(float).eps or len(active) >= min(n - 1, m):
            return
        if j not in active:
            active.append(j)
            aim, fit = np.zeros(m), z[:, active]
            aim[active] = np.linalg.lstsq(fit, y, rcond=None)[0]
            left = z.T @ (y - fit @ aim[active])
        beta = (1 - rho) * beta + rho * aim
        c = (1 - rho) * c + rho * left
        yield beta


def elastic_net(z: np.ndarray, y: np.ndarray, lambda2: float = 0.1, inner: str = "lasso") -> Iterator[np.ndarray]:
    """The lasso of the augmented rows sqrt(lambda2) I, scaled so that columns keep unit norm."""
    m, d2 = z.shape[1], 1 / np.sqrt(1 + lambda2)
    rows = np.vstack([z, np.sqrt(lambda2) * np.eye(m)]) * d2
    for beta in least_angle(rows, np.concatenate([y, np.zeros(m)]), inner):
        yield beta / d2


def informed_net(z: np.ndarray, y: np.ndarray, groups: np.ndarray, lambda2: float = 0.1, inner: str = "lasso") -> Iterator[np.ndarray]:
    """One row sqrt(lambda2 / size) for each group of base columns; dummies belong to their base column's group."""
    base = np.arange(z.shape[1]) % len(groups)
    rows = np.array([np.sqrt(lambda2 / (groups == g).sum()) * (groups[base] == g) for g in np.unique(groups)])
    yield from least_angle(np.vstack([z, rows]), np.concatenate([y, np.zeros(len(rows))]), inner)


def tikhonov(z: np.ndarray, y: np.ndarray, penalty: np.ndarray, lambda2: float = 0.1) -> Iterator[np.ndarray]:
    """The lasso with lambda2 b'Kb, K over base columns, dummies folded onto them."""
    value, vector = np.linalg.eigh(penalty)
    root = (vector * np.sqrt(np.maximum(value, 0))).T[:, np.arange(z.shape[1]) % len(penalty)]
    yield from least_angle(np.vstack([z, np.sqrt(lambda2) * root]), np.concatenate([y, np.zeros(len(root))]), "lasso")


#: The coordinate-descent solvers reach the lasso and the nets at each dummy's entry, which is where paths are read.
SOLVERS: dict[str, Callable[..., Iterator[np.ndarray]]] = {
    "tlars": lambda z, y, **k: least_angle(z, y, "lars"), "tlasso": lambda z, y, **k: least_angle(z, y, "lasso"), "tccd": lambda z, y, **k: least_angle(z, y, "lasso"),
    "tstepwise": lambda z, y, **k: least_angle(z, y, "stepwise"), "tstagewise": lambda z, y, **k: least_angle(z, y, "stagewise"),
    "tenet": lambda z, y, **k: elastic_net(z, y, k.get("lambda2", 0.1)), "tenet_aug": lambda z, y, **k: elastic_net(z, y, k.get("lambda2", 0.1), k.get("inner", "lasso")),
    "tcenet": lambda z, y, **k: elastic_net(z, y, k.get("lambda2", 0.1)),
    "tienet": lambda z, y, **k: informed_net(z, y, k["groups"], k.get("lambda2", 0.1)), "tienet_aug": lambda z, y, **k: informed_net(z, y, k["groups"], k.get("lambda2", 0.1), k.get("inner", "lasso")),
    "tcienet": lambda z, y, **k: tikhonov(z, y, k["penalty"], k.get("lambda2", 0.1)) if "penalty" in k else informed_net(z, y, k["groups"], k.get("lambda2", 0.1)),
    **{f"t{x}": (lambda z, y, x=x, **k: greedy(z, y, x)) for x in ("omp", "ools", "mp", "gp", "acgp", "ncgmp")},
    "tafs": lambda z, y, **k: adaptive(z, y, k.get("rho", 0.3)),
    "tncgmp_full": lambda z, y, **k: greedy(z, y, "omp"),
}


def states(path: Iterator[np.ndarray], p: int, t_stop: int, exact: bool = False) -> list[np.ndarray]:
    """Coefficients at the step where dummy 1, 2, ... t_stop entered; with `exact`, a count that is skipped has none.
    A path that ends early leaves the list short."""
    eps, out = np.finfo(float).eps, []
    for beta in path:
        n = int((np.abs(beta[p:]) > eps).sum())
        while len(out) < min(n, t_stop):
            out.append(beta if not exact or len(out) + 1 == n else np.zeros_like(beta))
        if len(out) >= t_stop:
            break
    return out


def states_of(kernel: Callable[..., Iterator[np.ndarray]], z: np.ndarray, ys: np.ndarray, p: int, t_stop: int, exact: bool = False, by_columns: bool = False) -> Iterator[list[np.ndarray]]:
    """The states for each response (a column of ys).  A path on a tall design that isn't done after m / 8 steps (or
    columns, where only those read rows), by when a decomposition costs about as much, begins again on the triangle."""
    n, m = z.shape
    low, limit = None, m // 8 if n > m + ys.shape[1] else None
    for q in range(ys.shape[1]):
        taken = [0]

        def begun(path: Iterator[np.ndarray], taken: list[int] = taken) -> Iterator[np.ndarray]:
            for beta in path:
                taken[0] = np.count_nonzero(beta) if by_columns else taken[0] + 1
                if limit is not None and taken[0] > limit:
                    return
                yield beta

        if low is None:
            found = states(begun(kernel(z, ys[:, q])), p, t_stop, exact)
            if limit is None or taken[0] <= limit:
                yield found
                continue
            low = reduced(z, ys, p)
        yield states(kernel(low[0], low[1][:, q]), p, t_stop, exact)


def supports(path: Iterator[np.ndarray], p: int, t_stop: int, exact: bool = False) -> list[np.ndarray]:
    """Active real columns at those steps."""
    return [np.flatnonzero(np.abs(b[:p]) > np.finfo(float).eps) for b in states(path, p, t_stop, exact)]


def trace(z: np.ndarray, y: np.ndarray, path: Iterator[np.ndarray], steps: int | None = None) -> dict[str, list]:
    """What a path did: for each step the residual sum of squares, R2, the degrees of freedom (active columns), Mallows'
    Cp against the residual variance of the last step, and signed actions (j + 1 entered, -(j + 1) left)."""
    eps, was = np.finfo(float).eps, np.zeros(z.shape[1], bool)
    out: dict[str, list] = {"rss": [], "r2": [], "dof": [], "actions": [], "active": []}
    for k, beta in enumerate(path):
        if steps is not None and k >= steps:
            break
        on, r = np.abs(beta) > eps, y - z @ beta
        out["rss"].append(float(r @ r))
        out["r2"].append(1 - float(r @ r) / float(y @ y))
        out["dof"].append(int(on.sum()))
        out["actions"].append([*(np.flatnonzero(on & ~was) + 1).tolist(), *(-np.flatnonzero(was & ~on) - 1).tolist()])
        out["active"].append(np.flatnonzero(on).tolist())
        was = on
    n = len(y)
    spare = n - 1 - out["dof"][-1] if out["dof"] else 0
    variance = out["rss"][-1] / spare if spare > 0 else float("nan")
    out["cp"] = [rss / variance - n + 2 * (dof + 1) if variance > 0 else float("nan") for rss, dof in zip(out["rss"], out["dof"], strict=True)]
    return out
