"""Models of a few rows in numpy, which those over tables are tested against."""

import numpy as np

from tideline.operators.kernels import ALPHA, COMPONENTS, GAMMA


def standardise(x: np.ndarray) -> np.ndarray:
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s > 0, s, 1)


def kernel_pca(x: np.ndarray, extra: np.ndarray, k: int = COMPONENTS, gamma: float = GAMMA) -> tuple[np.ndarray, np.ndarray]:
    """Components of the rows of x, and of extra rows in their space."""
    def kernel(a: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * ((a[:, None, :] - x[None, :, :]) ** 2).sum(2))

    full = kernel(x)
    mean = full.mean(0)
    centred = full - mean - mean[:, None] + full.mean()
    value, vector = np.linalg.eigh(centred)
    top = np.argsort(-value)[:k]
    value, vector = np.maximum(value[top], 1e-12), vector[:, top]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), range(vector.shape[1])])
    other = kernel(extra)
    return vector * np.sqrt(value), (other - other.mean(1)[:, None] - mean + full.mean()) @ (vector / np.sqrt(value))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Predictions of a ridge regression with an intercept that isn't shrunk."""
    xc, yc = x - x.mean(0), y - y.mean()
    return y.mean() + xc @ np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
