"""The two-layer router network on one block of rows: forward, loss and gradient.

Linear - LayerNorm - ReLU - dropout, twice, then one logit. A block is what a
task has at hand (rows of features); sums of its loss and gradient over blocks
are those of the whole table, so Spark can add them up in any order. Dropout
masks come from a hash of (seed, epoch, row key, unit): a row is masked alike
in whichever block or attempt it is read.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-5
#: Fixed values of the reference's network and training.
HIDDEN = (256, 128)
DROPOUT = 0.4

Weights = dict[str, np.ndarray]


def shapes(width: int, hidden: tuple[int, int] = HIDDEN) -> dict[str, tuple[int, ...]]:
    """Name and (out, in) shape of every parameter, in a fixed order."""
    a, b = hidden
    return {"fc1.w": (a, width), "fc1.b": (a,), "ln1.g": (a,), "ln1.b": (a,),
            "fc2.w": (b, a), "fc2.b": (b,), "ln2.g": (b,), "ln2.b": (b,), "fc3.w": (1, b), "fc3.b": (1,)}


def initial(width: int, hidden: tuple[int, int] = HIDDEN, seed: int = 0) -> Weights:
    """Uniform within ``1/sqrt(inputs)``; layer norms start as the identity."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes(width, hidden).items():
        layer, kind = name.split(".")
        if layer.startswith("ln"):
            out[name] = np.full(shape, 1.0 if kind == "g" else 0.0)
        else:
            fan_in = {"fc1": width, "fc2": hidden[0], "fc3": hidden[1]}[layer]
            out[name] = rng.uniform(-1, 1, shape) / np.sqrt(fan_in)
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def unflat(vector: np.ndarray, width: int, hidden: tuple[int, int] = HIDDEN) -> Weights:
    out, at = {}, 0
    for name, shape in shapes(width, hidden).items():
        n = int(np.prod(shape))
        out[name] = vector[at:at + n].reshape(shape)
        at += n
    return out


def keep_mask(keys: np.ndarray, units: int, layer: int, epoch: int, seed: int, rate: float) -> np.ndarray | None:
    """Per row key and unit: 0 with probability ``rate``, else ``1 / (1 - rate)``."""
    if rate == 0:
        return None
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, units + 1, dtype=np.uint64)[None, :] \
            * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((seed * 1_000_003 + epoch) * 7 + layer) & 0xFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) / 2.0**53 >= rate) / (1.0 - rate)


def _normed(x):
    mu = x.mean(axis=1, keepdims=True)
    scale = 1.0 / np.sqrt(x.var(axis=1, keepdims=True) + EPS)
    return (x - mu) * scale, scale


def _layer(x, w: Weights, n: int, mask):
    z, scale = _normed(x @ w[f"fc{n}.w"].T + w[f"fc{n}.b"])
    y = z * w[f"ln{n}.g"] + w[f"ln{n}.b"]
    h = np.maximum(y, 0)
    return (h if mask is None else h * mask), (x, z, scale, y, mask)


def _layer_back(dh, cache, w: Weights, n: int, grad: Weights):
    x, z, scale, y, mask = cache
    dy = (dh if mask is None else dh * mask) * (y > 0)
    grad[f"ln{n}.g"], grad[f"ln{n}.b"] = (dy * z).sum(axis=0), dy.sum(axis=0)
    dz = dy * w[f"ln{n}.g"]
    # through mean and variance of the row
    da = (dz - dz.mean(axis=1, keepdims=True) - z * (dz * z).mean(axis=1, keepdims=True)) * scale
    grad[f"fc{n}.w"], grad[f"fc{n}.b"] = da.T @ x, da.sum(axis=0)
    return da @ w[f"fc{n}.w"]


def logits(x: np.ndarray, w: Weights, masks=(None, None)):
    h1, c1 = _layer(x, w, 1, masks[0])
    h2, c2 = _layer(h1, w, 2, masks[1])
    return (h2 @ w["fc3.w"].T + w["fc3.b"]).ravel(), (c1, c2, h2)


def row_losses(z: np.ndarray, y: np.ndarray, pos_weight: float) -> np.ndarray:
    """Binary cross-entropy of logits, positives weighted."""
    soft = np.logaddexp(0.0, -z)
    return pos_weight * y * soft + (1 - y) * (soft + z)


def loss_and_gradient(x: np.ndarray, y: np.ndarray, keys: np.ndarray, w: Weights, *, pos_weight: float = 1.0,
                      rate: float = DROPOUT, epoch: int = 0, seed: int = 0) -> tuple[float, Weights]:
    """Sums over the rows of a block, not means."""
    masks = [keep_mask(keys, w[f"fc{n}.b"].size, n, epoch, seed, rate) for n in (1, 2)]
    z, (c1, c2, h2) = logits(x, w, masks)
    p = np.exp(-np.logaddexp(0.0, -z))
    dz = ((1 - y) * p - pos_weight * y * (1 - p))[:, None]
    grad: Weights = {"fc3.w": dz.T @ h2, "fc3.b": dz.sum(axis=0)}
    _layer_back(_layer_back(dz @ w["fc3.w"], c2, w, 2, grad), c1, w, 1, grad)
    return float(row_losses(z, y, pos_weight).sum()), {n: grad[n] for n in w}


def clipped(gradient: np.ndarray, most: float) -> np.ndarray:
    size = float(np.sqrt((gradient ** 2).sum()))
    return gradient * (most / (size + 1e-6)) if size > most else gradient


class Adam:
    """First and second moments of the gradient, on the driver: as large as the network, whatever the data."""

    def __init__(self, size: int, decay: float = 1e-5, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.decay, self.betas, self.eps = decay, betas, eps

    def step(self, params: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        g = gradient + self.decay * params
        self.t += 1
        self.m += (1 - self.betas[0]) * (g - self.m)
        self.v += (1 - self.betas[1]) * (g * g - self.v)
        m, v = self.m / (1 - self.betas[0] ** self.t), self.v / (1 - self.betas[1] ** self.t)
        return params - rate * m / (np.sqrt(v) + self.eps)


def cyclic_rate(step: int, base: float = 1e-3, top: float = 5e-3, up: int = 10) -> float:
    """A triangle that rises and falls over ``up`` steps each way, half as high in every cycle."""
    cycle, at = divmod(step, 2 * up)
    return base + (top - base) * (at / up if at <= up else 2 - at / up) / 2.0 ** cycle


def stepped_rate(step: int, base: float = 1e-3, every: int = 50, factor: float = 0.05) -> float:
    """Cut by ``factor`` after every ``every`` steps."""
    return base * factor ** (step // every)
