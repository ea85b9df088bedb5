"""Table numbers of Pitman-Yor restaurants, drawn from their exact conditional."""

from __future__ import annotations

import numpy as np

from itemforge.llm.words import U, mix

#: Up to so many customers the generalised Stirling numbers come from their recurrence.
EXACT = 256
_POINTS = np.arange(-64, 65)


def uniform(seed: np.ndarray) -> np.ndarray:
    return (mix(seed + U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) / (1 << 53)


def _recurrence(d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(n, t) for n, t up to EXACT."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0
    t = np.arange(1, EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(n - t * d > 0, s[n, 1:] + np.log(n - t * d), -np.inf)
        s[n + 1, 1:] = np.logaddexp(s[n, :-1], stay)
    return s


_TABLES: dict[float, np.ndarray] = {}


def table(d: float) -> np.ndarray:
    if d not in _TABLES:
        _TABLES[d] = _recurrence(d)
    return _TABLES[d]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series eight steps up."""
    x = np.asarray(x, float)
    low = x.copy()
    for i in range(1, 8):
        low *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


class _Series:
    """log of the coefficient of x^n in (1 - (1 - x)^d)^t by its binomial sum, for t up to some n^d; what depends on n alone is kept."""

    def __init__(self, n: np.ndarray, d: float, terms: int = 26):
        first = log_gamma(n - d)
        self.base = first - log_gamma(n + 1)
        k = np.arange(1, terms)
        sign = (-1.0) ** (k + 1) * np.sin(np.pi * k * d) / np.pi * np.exp(log_gamma(1 + k * d))
        self.terms = sign[:, None] * np.exp(log_gamma(n[None, :] - k[:, None] * d) - first)

    def __call__(self, at: np.ndarray, t: np.ndarray, terms: int = 26) -> np.ndarray:
        """at: places of n; t: for each one."""
        total, choose = np.zeros(len(at)), np.ones(len(at))
        for k in range(1, terms):
            choose *= (t - (k - 1)) / k
            total += choose * self.terms[k - 1, at]
        return np.log(total) + self.base[at]


def _saddle(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same by the saddle point; its error falls as 1 / t."""
    low, high = np.full(len(n), -60.0), np.full(len(n), -1e-12)  # log of u = 1 - x
    for _ in range(48):
        mid = (low + high) / 2
        u = np.exp(mid)
        more = t * (1 - u) * d * u ** (d - 1) / -np.expm1(d * mid) > n
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    u = np.exp((low + high) / 2)
    x, f, f1, f2 = 1 - u, -np.expm1(d * (low + high) / 2), d * u ** (d - 1), d * (1 - d) * u ** (d - 2)
    spread = x * t * (f1 / f + x * f2 / f - x * (f1 / f) ** 2)
    return t * np.log(f) - n * np.log1p(-u) - 0.5 * np.log(2 * np.pi * spread)


class Stirling:
    """log S(n, t) of generalised Stirling numbers for given n > EXACT and any t."""

    def __init__(self, n: np.ndarray, d: float):
        self.d, self.n = d, np.asarray(n, float)
        kinds, self.at = np.unique(self.n, return_inverse=True)
        self.series, self.power, self.full = _Series(kinds, d), kinds**d, log_gamma(kinds + 1)

    def __call__(self, t: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """t: a number, or a row of them, for each of the rows of n."""
        t, d = np.asarray(t, float), self.d
        at = self.at if rows is None else self.at[rows]
        n = self.n if rows is None else self.n[rows]
        shape = t.shape
        if t.ndim > 1:
            at, n = np.repeat(at, shape[1]), np.repeat(n, shape[1])
        t = t.ravel()
        out, edge = np.empty(len(t)), self.power[at]
        easy = t < 0.2 * edge  # the terms then fall by a factor of 5 and more
        few = (t < 1.8 * edge) & ~easy  # sum and saddle point differ by 3 % at the upper end
        rest = (t >= 1.8 * edge) & (t < n)
        for own, terms in ((easy, 12), (few, 26)):
            if own.any():
                out[own] = self.series(at[own], t[own], terms)
        if rest.any():
            out[rest] = _saddle(n[rest], t[rest], d)
        out[t >= n] = np.log(d) * n[t >= n]
        return (out + self.full[at] - log_gamma(t + 1) - t * np.log(d)).reshape(shape)


def log_stirling(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(n, t) for n > EXACT, one t for each n."""
    return Stirling(n, d)(t)


def seat(d: float, strength: float, n: np.ndarray, tables: np.ndarray, parent: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Tables of n customers of a dish each. tables: of the other dishes in the restaurant; parent: the dish's probability there.

    P(t) is in proportion to S(n, t) (strength + d tables) (strength + d (tables + 1)) ... parent^t. Up to
    EXACT customers all t are weighed. Beyond, the mode is found by bisection of log t and 129 points over at
    least 8 standard deviations on either side are weighed; where they are further apart than 1, t is
    uniform between them. Where a standard deviation is 2 at most, 33 points are enough for that.
    """
    out, u = np.minimum(n, 1).astype(float), uniform(seed)
    room = strength + d * tables
    order = np.argsort(n, kind="stable")
    cut = np.searchsorted(n[order], np.arange(EXACT + 2))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        if k < 2:
            continue
        for a in range(cut[k], cut[k + 1], 1 + (1 << 20) // k):
            own = order[a : min(a + 1 + (1 << 20) // k, cut[k + 1])]
            weight = table(d)[k, 1 : k + 1] + np.cumsum(np.log(room[own, None] + d * np.arange(k)) + np.log(parent[own, None]), axis=1)
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (share[:, :-1] < u[own, None] * share[:, -1:]).sum(axis=1)
    for a in range(cut[EXACT + 1], len(n), 4096):
        own = order[a : a + 4096]
        out[own] = _many(d, n[own].astype(float), room[own], parent[own], u[own])
    return out


def _many(d: float, n: np.ndarray, room: np.ndarray, parent: np.ndarray, u: np.ndarray) -> np.ndarray:
    known = Stirling(n, d)

    def weight(t: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        space, p = (room, parent) if own is None else (room[own], parent[own])
        if t.ndim > 1:
            space, p = space[:, None], p[:, None]
        return known(t, own) + log_gamma(space / d + t) + t * np.log(d * p)

    low, high = np.ones(len(n)), n.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = np.floor(np.sqrt(low[open_] * high[open_]))  # under high
        up = weight(mid + 1, open_) > weight(mid, open_)
        low[open_], high[open_] = np.where(up, mid + 1, low[open_]), np.where(up, high[open_], mid)
    mode = low
    by = np.maximum(1, np.floor(np.sqrt(mode) / 2))
    left, right = np.maximum(1, mode - by), np.minimum(n, mode + by)
    bend = (2 * weight(mode) - weight(left) - weight(right)) / np.maximum(1, (right - left) / 2) ** 2
    wide = 1 / np.sqrt(np.maximum(bend, 1e-12))
    out = np.empty(len(n))
    for own, points in ((wide <= 2, _POINTS[48:81]), (wide > 2, _POINTS)):
        if own.any():
            own = np.flatnonzero(own)
            out[own] = _pick(weight, own, n[own], mode[own], np.maximum(1, np.floor(wide[own] / 8)), points, u[own])
    return out


def _pick(weight, own, n, mode, step, points, u):  # noqa: ANN001, ANN202  arrays of the rows of own
    t = mode[:, None] + points * step[:, None]
    ok = (t >= 1) & (t <= n[:, None])
    w = np.where(ok, weight(np.clip(t, 1, n[:, None]), own), -np.inf)
    share = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    goal = u * share[:, -1]
    at = (share[:, :-1] < goal[:, None]).sum(axis=1)
    row = np.arange(len(n))
    under = np.where(at > 0, share[row, at - 1], 0)
    inside = (goal - under) / np.maximum(share[row, at] - under, 1e-300)
    return np.clip(np.floor(t[row, at] + (np.clip(inside, 0, 0.999999) - 0.5) * step + 0.5), 1, n)
