"""Small classifiers and decompositions on numpy: LDA with Ledoit-Wolf shrinkage, SVM by SMO, CSP, xDAWN, ANOVA F."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np


def generalised_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and columns w with a w = l b w and w' b w = 1; the largest part of each w is positive."""
    values, vectors = np.linalg.eigh(b)
    keep = values > values.max() * 1e-12
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    values, inner = np.linalg.eigh(whiten.T @ a @ whiten)
    w = whiten @ inner
    peak = np.take_along_axis(w, np.abs(w).argmax(axis=0)[None, :], 0)
    return values, w * np.where(peak < 0, -1.0, 1.0)


# ---- linear discriminant analysis ----


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """(1 - d) S + d tr(S)/p I with the shrinkage of Ledoit & Wolf (2004); x is centred here."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    spread = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = (((x**2).T @ (x**2)).sum() / n - (s**2).sum()) / (n * p)
    shrink = 0.0 if spread == 0 else min(max(noise, 0.0), spread) / spread
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def shrunk(s: np.ndarray, amount: float) -> np.ndarray:
    return (1 - amount) * s + amount * np.trace(s) / len(s) * np.eye(len(s))


@dataclass
class Lda:
    """Linear discriminant analysis: scores x coef' + intercept.

    ``tol``: with the solver svd, directions with less than this share of the largest pooled variance are left out.
    """

    solver: str = "lsqr"
    shrinkage: str | float | None = None
    priors: list[float] | None = None
    tol: float | None = None
    classes: np.ndarray = field(default_factory=lambda: np.empty(0))
    coef: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    intercept: np.ndarray = field(default_factory=lambda: np.empty(0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Lda:
        self.classes, counts = np.unique(y, return_counts=True)
        priors = counts / len(y) if self.priors is None else np.asarray(self.priors, float)
        means = np.stack([x[y == c].mean(axis=0) for c in self.classes])
        if self.shrinkage is not None and self.solver == "svd":
            raise ValueError("shrinkage goes with the solvers lsqr and eigen")
        pooled = np.zeros((x.shape[1], x.shape[1]))
        for c, prior in zip(self.classes, priors):
            part = x[y == c]
            if self.shrinkage == "auto":  # on standardised data, scaled back
                scale = part.std(axis=0)
                scale[scale == 0] = 1
                own = scale[:, None] * ledoit_wolf(part / scale) * scale
            else:
                centred = part - part.mean(axis=0)
                own = centred.T @ centred / len(part)
                if self.shrinkage is not None:
                    own = shrunk(own, float(self.shrinkage))
            pooled += prior * own
        return self.from_statistics(self.classes, means, pooled, priors)

    def from_statistics(self, classes: np.ndarray, means: np.ndarray, pooled: np.ndarray, priors: np.ndarray) -> Lda:
        self.classes = classes
        self.coef = np.linalg.lstsq(pooled, means.T, rcond=self.tol if self.solver == "svd" else None)[0].T
        self.intercept = -0.5 * (means * self.coef).sum(axis=1) + np.log(priors)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef.T + self.intercept

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.scores(x).argmax(axis=1)]

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


# ---- logistic regression ----


def class_weights(weight: str | dict | None, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A weight for each class: ones, those given (1 where none is), or with ``balanced`` the inverse of its share, 1 on average."""
    if weight is None:
        return np.ones(len(classes))
    if weight == "balanced":
        return counts.sum() / (len(classes) * counts)
    if isinstance(weight, str):
        raise ValueError("class weights are balanced or given by class")
    return np.array([float(weight.get(c, weight.get(float(c), 1.0))) for c in classes])


def logistic_sums(x: np.ndarray, at: np.ndarray, w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of multinomial logistic regression, summed over rows of class numbers ``at``, as one vector.

    ``w`` has one row a class: coefficients, then the intercept. Sums of parts of the rows add up.
    """
    k, n = len(w), len(x)
    xb, rows = np.hstack([x, np.ones((n, 1))]), weights[at]
    s = xb @ w.T
    s -= s.max(axis=1, keepdims=True)
    q = np.exp(s)
    q /= q.sum(axis=1, keepdims=True)
    loss = -(rows * np.log(np.maximum(q[np.arange(n), at], 1e-300))).sum()
    gradient = (rows[:, None] * (q - np.eye(k)[at])).T @ xb
    hessian = np.zeros((k, xb.shape[1], k, xb.shape[1]))
    for i in range(k):
        for j in range(i, k):
            hessian[i, :, j, :] = xb.T @ (xb * (rows * q[:, i] * ((i == j) - q[:, j]))[:, None])
            hessian[j, :, i, :] = hessian[i, :, j, :].T
    return np.concatenate([[loss], gradient.ravel(), hessian.ravel()])


def soft(x: np.ndarray | float, amount: np.ndarray | float) -> np.ndarray | float:
    """x moved toward zero by an amount, and not past it."""
    return np.sign(x) * np.maximum(np.abs(x) - amount, 0.0)


def lasso_step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, lasso: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The step d that minimises gradient.d + d'hessian d / 2 + sum(lasso * |w + d|), by coordinate descent.

    After each round over all coordinates those that aren't zero are gone over until they settle.
    """
    d, slope = np.zeros_like(w), gradient.copy()  # slope of the smooth part at d
    curve = np.maximum(np.diag(hessian), 1e-12)

    def sweep(coordinates: np.ndarray) -> float:
        most = 0.0
        for i in coordinates:
            at = w[i] + d[i]
            move = soft(at - slope[i] / curve[i], lasso[i] / curve[i]) - at
            if move:
                d[i] += move
                slope[:] += move * hessian[:, i]
                most = max(most, abs(move) * math.sqrt(curve[i]))
        return most

    every = np.arange(len(w))
    for _ in range(rounds):
        first = most = sweep(every)
        for _ in range(rounds):
            if most < 1e-12:
                break
            most = sweep(np.flatnonzero(w + d))
        if first < 1e-10:
            break
    return d


@dataclass
class Logistic:
    """Multinomial logistic regression: sum of losses + penalty / C, intercept free.

    The penalty is |w|^2 / 2 (``l2``), the sum of |w| (``l1``), ``l1_ratio`` of the latter and the rest of the former
    (``elasticnet``), or none. Newton steps with halving; where |w| counts, each step minimises the quadratic model with it
    (proximal Newton), so weights become exactly zero, and it ends where the conditions of the optimum hold.
    ``class_weight`` as in ``class_weights``.
    """

    C: float = 1.0
    max_iter: int = 100
    tol: float = 1e-8
    penalty: str | None = "l2"
    fit_intercept: bool = True
    class_weight: str | dict | None = None
    l1_ratio: float | None = None
    classes: np.ndarray = field(default_factory=lambda: np.empty(0))
    w: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def __post_init__(self):
        if self.penalty not in ("l2", "l1", "elasticnet", None):
            raise ValueError("penalty is l2, l1, elasticnet or None")
        if (self.penalty == "elasticnet") != (self.l1_ratio is not None) or not 0 <= (self.l1_ratio or 0) <= 1:
            raise ValueError("elasticnet takes an l1_ratio from 0 to 1, other penalties none")

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        classes, at, counts = np.unique(y, return_inverse=True, return_counts=True)
        return self.fit_sums(classes, counts, x.shape[1], lambda w, weights: logistic_sums(x, at, w, weights))

    def fit_sums(self, classes: np.ndarray, counts: np.ndarray, p: int, sums) -> Logistic:
        """Fit from ``sums(w, weights)``: ``logistic_sums`` over all rows, wherever they are."""
        self.classes, k = classes, len(classes)
        weights = class_weights(self.class_weight, classes, counts)
        share = {"l1": 1.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)
        squared = (1 - share) / self.C if self.penalty else 1e-9
        penalty = np.append(np.full(p, max(squared, 1e-9)), 1e-9 if self.fit_intercept else 1e12)
        lasso = np.tile(np.append(np.full(p, share / self.C), 0.0), (k, 1))
        enough = self.tol * max(1.0, counts.sum() / 1000)

        def evaluate(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            found = sums(w, weights)
            gradient = found[1 : 1 + w.size].reshape(w.shape) + penalty * w
            return float(found[0]) + 0.5 * (penalty * w * w).sum() + (lasso * np.abs(w)).sum(), gradient, found[1 + w.size :].reshape(w.size, w.size)

        w = np.zeros((k, p + 1))
        value, gradient, hessian = evaluate(w)
        for _ in range(self.max_iter):
            off = gradient if not share else np.where(w != 0, gradient + lasso * np.sign(w), soft(gradient, lasso))
            if np.abs(off).max() < enough:
                break
            curved = hessian + np.diag(np.tile(penalty, k))
            if share:
                step = -lasso_step(w.ravel(), gradient.ravel(), curved, lasso.ravel()).reshape(w.shape)
            else:
                step = np.linalg.lstsq(curved, gradient.ravel(), rcond=None)[0].reshape(w.shape)
            size = 1.0
            while size > 1e-10 and (after := evaluate(w - size * step))[0] > value:
                size /= 2
            if size <= 1e-10:
                break
            w = w - size * step
            value, gradient, hessian = after
        self.w = w
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.w[:, :-1].T + self.w[:, -1]
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.predict_proba(x).argmax(axis=1)]


# ---- support vector machine ----


class Columns:
    """Columns of the products of rows, made when they are asked for; those asked for lately are kept, up to a number of doubles."""

    def __init__(self, x: np.ndarray, gram, most_doubles: int):
        self.x, self.gram, self.most = x, gram, max(2, most_doubles // max(1, len(x)))
        self.held: dict[int, np.ndarray] = {}

    def __getitem__(self, i: int) -> np.ndarray:
        column = self.held.pop(i, None)
        if column is None:
            column = self.gram(self.x, self.x[i : i + 1])[:, 0]
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
        self.held[i] = column
        return column


#: Rows and vectors of a product that is made at once.
TILE = 512


class Machines(Sequence):
    """Machines of all pairs of classes that share their vectors: for each class its vectors (m, features) and their multipliers times signs
    (m, classes - 1), one column for each other class. Item n is (class, class, support, multipliers times signs, bias) as of a machine by itself."""

    def __init__(self, vectors: list[np.ndarray], weights: list[np.ndarray], biases: np.ndarray):
        self.vectors, self.weights = vectors, weights
        self._paired(len(vectors), biases)

    def _paired(self, classes: int, biases: np.ndarray) -> None:
        self.classes, self.biases = classes, np.asarray(biases, float)
        self.pairs = [(i, j) for i in range(classes) for j in range(i + 1, classes)]

    def __len__(self) -> int:
        return len(self.pairs)

    def tiles(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(vectors, multipliers times signs) of a class, a tile at a time."""
        for k in range(0, len(self.vectors[c]), TILE):
            yield self.vectors[c][k : k + TILE], self.weights[c][k : k + TILE]

    def __getitem__(self, n: int) -> tuple:
        i, j = self.pairs[n]
        own = [(v[w[:, col] != 0], w[w[:, col] != 0, col]) for c, col in ((i, j - 1), (j, i)) for v, w in self.tiles(c)]
        return i, j, np.concatenate([v for v, _ in own]), np.concatenate([w for _, w in own]), float(self.biases[n])

    def margins(self, x: np.ndarray, gram) -> np.ndarray:
        """(rows, pairs): each product of a row and a vector is made once for all pairs, a tile at a time."""
        out = np.tile(self.biases, (len(x), 1))
        for c in range(self.classes):
            others = [n for n, pair in enumerate(self.pairs) if c in pair]  # by the other class, as the columns are
            sums = np.zeros((len(x), len(others)))
            for v, w in self.tiles(c):
                for at in range(0, len(x), TILE):
                    sums[at : at + TILE] += gram(x[at : at + TILE], v) @ w
            out[:, others] += sums
        return out


@dataclass
class Svm:
    """C-SVM by sequential minimal optimisation (Platt 1998, maximal violating pair), one machine for each pair of classes.

    With ``probability``, each machine gets a sigmoid over its margins (Platt 1999, with the targets and steps of Lin, Lin & Weng 2007),
    and those of all pairs are coupled (Wu, Lin & Weng 2004).
    """

    C: float = 1.0
    kernel: str = "rbf"
    degree: int = 3
    gamma: str | float = "scale"
    coef0: float = 0.0
    tol: float = 1e-3
    max_iter: int = 100_000
    class_weight: str | dict | None = None
    probability: bool = False
    classes: np.ndarray = field(default_factory=lambda: np.empty(0))
    machines: list = field(default_factory=list)
    sigmoids: list = field(default_factory=list)
    width: float = 1.0

    def gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return a @ b.T
        if self.kernel == "poly":
            return (self.width * (a @ b.T) + self.coef0) ** self.degree
        if self.kernel == "sigmoid":
            return np.tanh(self.width * (a @ b.T) + self.coef0)
        if self.kernel == "rbf":
            k = 2 * a @ b.T  # in place: most of a large machine's time goes here
            k -= (a * a).sum(1)[:, None]
            k -= (b * b).sum(1)
            np.minimum(k, 0, out=k)
            k *= self.width
            return np.exp(k, out=k)
        raise ValueError("kernel is linear, poly, rbf or sigmoid")

    def prepare(self, classes: np.ndarray, counts: np.ndarray, features: int, variance: float) -> None:
        """What machines share: classes, the kernel's width, and how far the multipliers of each class may go."""
        self.classes = classes
        self.most = self.C * class_weights(self.class_weight, classes, counts)
        self.width = {"scale": 1 / (features * variance) if variance > 0 else 1.0, "auto": 1 / features}.get(self.gamma, self.gamma)

    def pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(self.classes)) for j in range(i + 1, len(self.classes))]

    def machine(self, pair: tuple[int, int], x: np.ndarray, sign: np.ndarray, most_doubles: int | None = None) -> tuple:
        """(support, multipliers times signs, bias, places of the support) of a pair's machine on some rows; with ``most_doubles`` products are made when needed."""
        i, j = pair
        k = self.gram(x, x) if most_doubles is None or len(x) ** 2 <= most_doubles else Columns(x, self.gram, most_doubles)
        alpha, bias = self._solve(k, sign, np.where(sign > 0, self.most[i], self.most[j]))
        at = np.flatnonzero(alpha > 0)
        return x[at], (alpha * sign)[at], bias, at

    def fit(self, x: np.ndarray, y: np.ndarray) -> Svm:
        classes, counts = np.unique(y, return_counts=True)
        self.prepare(classes, counts, x.shape[1], x.var())
        self.machines, self.sigmoids = [], []
        for i, j in self.pairs():
            pick = (y == self.classes[i]) | (y == self.classes[j])
            part, sign = x[pick], np.where(y[pick] == self.classes[i], 1.0, -1.0)
            support, weight, bias, _ = self.machine((i, j), part, sign)
            self.machines.append((i, j, support, weight, bias))
            if self.probability:
                s = self.gram(part, support) @ weight + bias
                counted = int((sign > 0).sum()), int((sign < 0).sum())
                answer = lambda asked, s=s, sign=sign, counted=counted: {0: sigmoid_sums(s, sign, asked[0], *sigmoid_targets(*counted))}
                self.sigmoids.append(run_flows({0: sigmoid_flow(*counted)}, answer)[0])
        return self

    def _solve(self, k: np.ndarray | Columns, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, float]:
        alpha, gradient = np.zeros(len(y)), -np.ones(len(y))
        for _ in range(self.max_iter):
            up = (alpha < most) & (y > 0) | (alpha > 0) & (y < 0)
            low = (alpha < most) & (y < 0) | (alpha > 0) & (y > 0)
            v = -y * gradient
            i, j = int(np.where(up, v, -np.inf).argmax()), int(np.where(low, v, np.inf).argmin())
            if v[i] - v[j] < self.tol:
                break
            a, b = k[i], k[j]
            curve = max(a[i] + b[j] - 2 * a[j], 1e-12)
            step = (v[i] - v[j]) / curve
            step = min(step, most[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else most[j] - alpha[j])
            alpha[i] += y[i] * step
            alpha[j] -= y[j] * step
            gradient += y * step * (a - b)
        v = -y * gradient
        free = (alpha > 1e-9) & (alpha < most - 1e-9)
        bias = v[free].mean() if free.any() else (v[i] + v[j]) / 2
        return np.where(alpha < 1e-12, 0.0, alpha), float(bias)

    def resolved(self, k: np.ndarray, y: np.ndarray, most: np.ndarray, alpha: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """Multipliers of some rows that go on from ``alpha`` where the gradient is given and all other rows' multipliers stay (second order
        choice of pairs, Fan, Chen & Lin 2005)."""
        alpha, gradient, own = alpha.copy(), gradient.copy(), np.diag(k)
        for _ in range(self.max_iter):
            up = (alpha < most) & (y > 0) | (alpha > 0) & (y < 0)
            low = (alpha < most) & (y < 0) | (alpha > 0) & (y > 0)
            v = -y * gradient
            i = int(np.where(up, v, -np.inf).argmax())
            apart = v[i] - v
            if not up.any() or not (low & (apart >= self.tol / 2)).any():
                break
            a = k[i]
            curve = np.maximum(own[i] + own - 2 * a, 1e-12)
            j = int(np.where(low & (apart > 0), apart * apart / curve, -np.inf).argmax())
            step = min(apart[j] / curve[j], most[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else most[j] - alpha[j])
            alpha[i] += y[i] * step
            alpha[j] -= y[j] * step
            gradient += y * step * (a - k[j])
        return np.where(alpha < 1e-12, 0.0, np.where(alpha > most - 1e-12, most, alpha))

    def margins(self, x: np.ndarray, machine: int) -> np.ndarray:
        _, _, support, weight, bias = self.machines[machine]
        return self.gram(x, support) @ weight + bias

    def all_margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, pairs)."""
        if isinstance(self.machines, Machines):
            return self.machines.margins(x, self.gram)
        return np.stack([self.margins(x, n) for n in range(len(self.machines))], axis=1) if self.machines else np.empty((len(x), 0))

    def votes(self, x: np.ndarray) -> np.ndarray:
        out, margins = np.zeros((len(x), len(self.classes))), self.all_margins(x)
        for n, (i, j) in enumerate(self.pairs()):
            s = margins[:, n]
            out[:, i] += s > 0
            out[:, j] += s <= 0
            squash = s / (3 * (np.abs(s) + 1))  # ties between votes go to the larger margin
            out[:, i] += squash
            out[:, j] -= squash
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.votes(x).argmax(axis=1)]

    @property
    def predict_proba(self):
        if not self.probability:
            raise AttributeError("probabilities need probability=True")
        return self._probabilities

    def _probabilities(self, x: np.ndarray) -> np.ndarray:
        k = len(self.classes)
        r, margins = np.zeros((len(x), k, k)), self.all_margins(x)
        for n, ((i, j), (a, b)) in enumerate(zip(self.pairs(), self.sigmoids)):
            p = np.clip(1 / (1 + np.exp(np.clip(a * margins[:, n] + b, -500, 500))), 1e-7, 1 - 1e-7)
            r[:, i, j], r[:, j, i] = p, 1 - p
        return coupled(r)


def coupled(r: np.ndarray) -> np.ndarray:
    """Probabilities p (rows) that minimise the sum over pairs of (r_ji p_i - r_ij p_j)^2 with a sum of one."""
    n, k = r.shape[:2]
    q = -r * r.transpose(0, 2, 1)
    at = np.arange(k)
    q[:, at, at] = (r**2).sum(axis=1)
    system = np.ones((n, k + 1, k + 1))
    system[:, :k, :k], system[:, k, k] = q, 0.0
    p = np.linalg.solve(system, np.broadcast_to(np.append(np.zeros(k), 1.0)[:, None], (n, k + 1, 1)))[:, :k, 0]
    p = np.maximum(p, 0.0)
    return p / p.sum(axis=1, keepdims=True)


def sigmoid_targets(positive: int, negative: int) -> tuple[float, float]:
    """Targets of positive and negative rows, a little inside 0 and 1."""
    return (positive + 1) / (positive + 2), 1 / (negative + 2)


def sigmoid_sums(s: np.ndarray, sign: np.ndarray, ab: np.ndarray, high: float, low: float) -> np.ndarray:
    """Loss, gradient (2) and Hessian (3) of 1 / (1 + exp(a s + b)), summed over rows; sums of parts add up."""
    z, t = ab[0] * s + ab[1], np.where(sign > 0, high, low)
    loss = np.logaddexp(0.0, z) - (1 - t) * z
    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
    d, c = t - p, p * (1 - p)
    return np.array([loss.sum(), (d * s).sum(), d.sum(), (c * s * s).sum(), (c * s).sum(), c.sum()])


def sigmoid_flow(positive: int, negative: int, rounds: int = 100):
    """Newton steps with halving as a generator: it yields (a, b), is sent ``sigmoid_sums`` over all rows there, and returns the last (a, b)."""
    ab = np.array([0.0, math.log((negative + 1) / (positive + 1))])
    found = yield ab
    for _ in range(rounds):
        gradient, (aa, ab_, bb) = found[1:3], found[3:]
        if np.abs(gradient).max() < 1e-5:
            break
        step, size = np.linalg.solve(np.array([[aa, ab_], [ab_, bb]]) + 1e-12 * np.eye(2), gradient), 1.0
        while (after := (yield ab - size * step))[0] > found[0] and size > 1e-10:
            size /= 2
        if after[0] > found[0]:
            break
        ab, found = ab - size * step, after
    return float(ab[0]), float(ab[1])


def run_flows(flows: dict, sums) -> dict:
    """Results of generators that go on side by side; ``sums({key: asked})`` answers all that are open at once."""
    asked, out = {k: next(f) for k, f in flows.items()}, {}
    while asked:
        for k, answer in sums(asked).items():
            try:
                asked[k] = flows[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
                del asked[k]
    return out


# ---- spatial filters ----


def csp_filters(class_covariances: list[np.ndarray], n_components: int) -> np.ndarray:
    """Common spatial patterns (Blankertz et al. 2008): rows are filters, by how far an eigenvalue is from 1/2.

    With more than two classes each is set against the others and they take turns.
    """
    total = np.sum(class_covariances, axis=0)
    if len(class_covariances) == 2:
        values, w = generalised_eigh(class_covariances[0], total)
        return w[:, np.argsort(-np.abs(values - 0.5), kind="stable")[:n_components]].T
    ranked = []
    for c in class_covariances:
        values, w = generalised_eigh(c, total)
        ranked.append(w[:, np.argsort(-np.abs(values - 1 / len(class_covariances)), kind="stable")].T)
    turns = [ranked[i % len(ranked)][i // len(ranked)] for i in range(len(ranked) * len(total)) if i // len(ranked) < len(ranked[i % len(ranked)])]
    return np.array(turns[:n_components])


def xdawn_filters(evoked: np.ndarray, data_covariance: np.ndarray, n_filters: int) -> np.ndarray:
    """xDAWN (Rivet et al. 2009): rows maximise evoked against whole power."""
    signal = evoked @ evoked.T / evoked.shape[1]
    _, w = generalised_eigh(signal, data_covariance)
    return w[:, ::-1][:, :n_filters].T


def anova_f(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """F of each feature from class counts (k,), sums and sums of squares (k, features)."""
    n, k = counts.sum(), len(counts)
    between = (sums**2 / counts[:, None]).sum(axis=0) - sums.sum(axis=0) ** 2 / n
    within = squares.sum(axis=0) - (sums**2 / counts[:, None]).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (between / (k - 1)) / (within / (n - k))


def anova_f_centred(counts: np.ndarray, means: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """F of each feature from class counts (k,), means and centred sums of squares (k, features)."""
    n, k = counts.sum(), len(counts)
    grand = (counts[:, None] * (means - means[0])).sum(axis=0) / n  # from the first mean: large offsets cost no digits
    between = (counts[:, None] * (means - means[0] - grand) ** 2).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (between / (k - 1)) / (squares.sum(axis=0) / (n - k))


# ---- clustering ----


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100, starts: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(centres, labels) by Lloyd's algorithm from k-means++ starts; the best of several."""
    best = (math.inf, np.empty(0), np.empty(0))
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres) ** 2).sum(-1).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(rounds):
            d = ((x[:, None] - centres) ** 2).sum(-1)
            labels = d.argmin(1)
            after = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
            if np.allclose(after, centres, atol=1e-12):
                break
            centres = after
        d = ((x[:, None] - centres) ** 2).sum(-1)
        if d.min(1).sum() < best[0]:
            best = (float(d.min(1).sum()), centres, d.argmin(1))
    return best[1], best[2]


class Lloyd:
    """Lloyd's algorithm from sums: hand each round, for every centre, the count and sum of the rows nearest to it."""

    def __init__(self, centres: np.ndarray, rounds: int = 100):
        self.centres, self.left, self.done = centres, rounds, False

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Counts and sums of some rows, as one vector; sums of parts of the rows add up."""
        one = np.eye(len(self.centres))[nearest(x, self.centres)]
        return np.concatenate([one.sum(axis=0), (one.T @ x).ravel()])

    def advance(self, sums: np.ndarray) -> None:
        k = len(self.centres)
        counts = sums[:k, None]
        after = np.where(counts > 0, sums[k:].reshape(self.centres.shape) / np.maximum(counts, 1), self.centres)
        self.left -= 1
        self.done = bool(np.allclose(after, self.centres, atol=1e-12)) or self.left <= 0
        self.centres = after


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row."""
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def strength(together: np.ndarray) -> float:
    """The least share, over a test set's clusters (rows), of pairs that the training centres (columns) keep together."""
    shares = []
    for row in together:
        n = row.sum()
        if n > 1:
            shares.append((row * (row - 1)).sum() / (n * (n - 1)))
        elif n == 1:
            shares.append(0.0)
    return float(min(shares, default=0.0))


def prediction_strength(x: np.ndarray, k: int, splits: int = 10, seed: int = 0) -> tuple[float, float]:
    """(mean, standard error) over half splits of the least share, over test clusters, of pairs that training centres keep together."""
    out = []
    for split in range(splits):
        order = np.random.default_rng([seed, split]).permutation(len(x))
        train, test = x[order[: len(x) // 2]], x[order[len(x) // 2 :]]
        centres, _ = kmeans(train, k, seed)
        _, own = kmeans(test, k, seed)
        other = ((test[:, None] - centres) ** 2).sum(-1).argmin(1)
        together = np.zeros((k, k))
        np.add.at(together, (own, other), 1)
        out.append(strength(together))
    return float(np.mean(out)), float(np.std(out) / math.sqrt(splits))
