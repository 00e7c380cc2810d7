"""Dense linear algebra on one replicate or one pair of replicates; plain numpy, used inside grouped functions."""

from __future__ import annotations

import numpy as np

from wobble.errors import WobbleError


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry by magnitude positive."""
    if not vectors.size:
        return vectors
    top = np.abs(vectors).argmax(0)
    s = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(s == 0, 1, s)


def eigen(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and eigenvectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return values[::-1], fix_signs(vectors[:, ::-1])


def genotype_pca(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as coordinates, and their shares of the sum of all eigenvalues."""
    values, vectors = eigen(gram)
    values = np.maximum(values, 0)
    total = values.sum()
    return vectors[:, :k], values[:k] / total if total > 0 else np.zeros(k)


def matrix_pca(gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores U S of a centred matrix from its Gram matrix, and their shares of variance."""
    values, vectors = eigen(gram)
    values = np.maximum(values, 0)
    total = values.sum()
    return vectors[:, :k] * np.sqrt(values[:k]), values[:k] / total if total > 0 else np.zeros(k)


def pcoa(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal coordinates of a distance matrix; what negative eigenvalues would give is zero."""
    d2 = distance**2
    b = -0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean())
    return matrix_pca(b, k)


def normalise_rows(a: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a, dtype=float), where=n > 0)


def unit_frobenius(a: np.ndarray) -> np.ndarray:
    a = a - a.mean(0)
    n = np.linalg.norm(a)
    if n == 0:
        raise WobbleError("An embedding whose points all coincide can't be aligned.")
    return a / n


def procrustes(reference: np.ndarray, comparable: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both matrices centred and scaled, comparable rotated and scaled onto reference, and the disparity 1 - s**2."""
    if reference.shape != comparable.shape or not reference.size:
        raise WobbleError("No samples left for comparison after clipping." if not reference.size else "Embeddings of different shape can't be aligned.")
    a, b = unit_frobenius(reference), unit_frobenius(comparable)
    u, s, vt = np.linalg.svd(b.T @ a)
    scale = s.sum()
    return a, b @ (u @ vt) * scale, float(1 - scale**2)


def stability(disparity: float) -> float:
    return float(np.sqrt(max(0.0, 1 - disparity)))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, a column at a time: no array has rows times centres times columns cells."""
    out = np.zeros((len(x), len(c)))
    for a, b in zip(x.T, c.T, strict=True):
        out += (a[:, None] - b[None]) ** 2
    return out


def kmeans(x: np.ndarray, k: int, seed: int = 42, restarts: int = 10, rounds: int = 300) -> np.ndarray:
    """Labels of the best of several runs, each from spread-out seeds."""
    n = len(x)
    if not 1 <= k <= n:
        raise WobbleError(f"k-means needs 1 <= k <= {n} clusters, not {k}.")
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(n, int)
    for _ in range(restarts):
        centres = [x[rng.integers(n)]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
            centres.append(x[rng.choice(n, p=d / d.sum())] if d.sum() > 0 else x[rng.integers(n)])
        c = np.array(centres)
        for _ in range(rounds):
            d = squares(x, c)
            own = d.argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else x[d.min(1).argmax()] for j in range(k)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        inertia = squares(x, c).min(1).sum()
        if inertia < best - 1e-12:
            best, labels = inertia, own
    return labels


def fowlkes_mallows(a: np.ndarray, b: np.ndarray) -> float:
    n = len(a)
    table = np.zeros((a.max(initial=0) + 1, b.max(initial=0) + 1))
    np.add.at(table, (a, b), 1)
    t, p, q = (table**2).sum() - n, (table.sum(0) ** 2).sum() - n, (table.sum(1) ** 2).sum() - n
    return float(np.sqrt(t / p) * np.sqrt(t / q)) if t > 0 else 0.0


class Mixture:
    """A full-covariance Gaussian mixture, fitted by expectation maximisation from a k-means labelling."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 42, rounds: int = 100, floor: float = 1e-6):
        self.k, self.d = k, x.shape[1]
        own = np.eye(k)[kmeans(x, k, seed, 1)]
        last = -np.inf
        for _ in range(rounds):
            size = own.sum(0) + 1e-10
            self.weight, self.mean = size / len(x), own.T @ x / size[:, None]
            self.chol = []
            for j in range(k):
                y = x - self.mean[j]
                self.chol.append(np.linalg.cholesky((own[:, j, None] * y).T @ y / size[j] + floor * np.eye(self.d)))
            logs = self.logs(x)
            each = np.logaddexp.reduce(logs, axis=1)
            own = np.exp(logs - each[:, None])
            if abs(each.mean() - last) < 1e-3:
                break
            last = each.mean()

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of each component's weighted density at each row."""
        out = np.empty((len(x), self.k))
        for j in range(self.k):
            z = np.linalg.solve(self.chol[j], (x - self.mean[j]).T)
            out[:, j] = np.log(self.weight[j]) - 0.5 * (self.d * np.log(2 * np.pi) + (z**2).sum(0)) - np.log(np.diag(self.chol[j])).sum()
        return out

    def bic(self, x: np.ndarray) -> float:
        """Bayesian information criterion of rows, which needn't be those of the fit."""
        free = (self.k - 1) + self.k * self.d + self.k * self.d * (self.d + 1) / 2
        return float(-2 * np.logaddexp.reduce(self.logs(x), axis=1).sum() + free * np.log(len(x)))


def fold(n: int, folds: int, which: int) -> np.ndarray:
    """Which of n rows a fold holds out: neighbours, and one more in each of the first n % folds."""
    sizes = np.full(folds, n // folds)
    sizes[: n % folds] += 1
    at = sizes[:which].sum()
    return (np.arange(n) >= at) & (np.arange(n) < at + sizes[which])


def held_out_bic(x: np.ndarray, k: int, which: int, folds: int = 5, seed: int = 42) -> float:
    """Criterion of the rows that a fold holds out, under a mixture fitted to the others; infinite if these are fewer than k."""
    out = fold(len(x), folds, which)
    if not out.any() or (~out).sum() < max(k, 2):
        return float("inf")
    return Mixture(x[~out], k, seed).bic(x[out])


def cluster_numbers(n: int, n_populations: int, bounds: tuple[int, int] | None = None) -> list[int]:
    """Numbers of clusters to try for n rows, both bounds included. By default from 3 (or fewer, if there are fewer) to the number of populations, or to the root of the number of samples if there is but one.

    The upper bound is tried as well: without it, no number would be left for two or three populations."""
    top = n_populations if n_populations > 1 else int(np.sqrt(n))
    lo, hi = bounds if bounds else (min(3, top), top)
    ks = list(range(max(1, lo), min(hi, n) + 1))
    if not ks:
        raise WobbleError("No number of clusters is left to try.")
    return ks
