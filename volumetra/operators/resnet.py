"""Residual networks as scorers of cubes: the forward pass in numpy, in small blocks, inside the tasks that hold the cubes.

Weights are arrays by "layer/part", in the layout (*kernel, inputs, outputs), kept as one .npz file. A network is described
once, by `forward`; with `Shapes` it tells which weights it needs, with `Arrays` it computes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

# Blocks of each unit, whether they are bottlenecks, and the normalisation's epsilon.
DEPTHS = {
    "18-layer": ((2, 2, 2, 2), False),
    "34-layer": ((3, 4, 6, 3), False),
    "50-layer": ((3, 4, 6, 3), True),
    "101-layer": ((3, 4, 23, 3), True),
    "152-layer": ((3, 6, 36, 3), True),
}
EPSILON = 1e-5
NORM_PARTS = ("gamma", "beta", "moving_mean", "moving_variance")


def convolved_size(size: tuple[int, ...], kernel: tuple[int, ...], stride: int, pad: int) -> tuple[int, ...]:
    return tuple((n + 2 * pad - k) // stride + 1 for n, k in zip(size, kernel))


class Shapes:
    """Goes through a network with shapes instead of arrays, and collects the shape of each weight."""

    def __init__(self, rank: int):
        self.rank, self.needed = rank, {}

    def conv(self, x, name, features, kernel, stride, pad):
        self.needed[f"{name}/kernel"] = (*kernel, x[-1], features)
        return (*self._sized(x, kernel, stride, pad), features)

    def norm(self, x, name):
        # Over the last axis but one, not over features: existing weights have that size.
        self.needed |= {f"{name}/{part}": (x[self.rank - 1],) for part in NORM_PARTS}
        return x

    def pool(self, x, kernel, stride):
        return (*self._sized(x, kernel, stride, 0), x[-1])

    def _sized(self, x, kernel, stride, pad):
        out = convolved_size(x[:-1], kernel, stride, pad)
        if min(out) < 1:
            raise ValueError(f"the network's input is too small: {x[:-1]} meets a kernel of {kernel}")
        return out

    def relu(self, x):
        return x

    def add(self, x, y):
        return x

    def head(self, x, classes):
        self.needed |= {"fully_connected/kernel": (x[-1], classes), "fully_connected/bias": (classes,)}
        return (classes,)


class Arrays:
    """Goes through a network with a batch (n, *size, features)."""

    def __init__(self, rank: int, weights: dict[str, np.ndarray]):
        self.rank, self.weights = rank, weights

    def _windows(self, x, kernel, stride):
        """For each place in the kernel, what stands there in all windows."""
        out = convolved_size(x.shape[1:-1], kernel, stride, 0)
        for at in np.ndindex(*kernel):
            yield at, x[(slice(None), *(slice(a, a + stride * (m - 1) + 1, stride) for a, m in zip(at, out)))]

    def conv(self, x, name, features, kernel, stride, pad):
        weight = self.weights[f"{name}/kernel"]
        x = np.pad(x, [(0, 0), *[(pad, pad)] * self.rank, (0, 0)])
        return sum(part @ weight[at] for at, part in self._windows(x, kernel, stride))

    def norm(self, x, name):
        gamma, beta, mean, variance = (self.weights[f"{name}/{part}"] for part in NORM_PARTS)
        scale = gamma / np.sqrt(variance + EPSILON)
        return x * scale[:, None] + (beta - mean * scale)[:, None]

    def pool(self, x, kernel, stride):
        best = None
        for _, part in self._windows(x, kernel, stride):
            best = part if best is None else np.maximum(best, part)
        return best

    def relu(self, x):
        return np.maximum(x, 0)

    def add(self, x, y):
        return x + y

    def head(self, x, classes):
        e = x.mean(tuple(range(1, x.ndim - 1))) @ self.weights["fully_connected/kernel"] + self.weights["fully_connected/bias"]
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _block(ops, x, name: str, features: int, stride: int, bottleneck: bool, first: bool):
    """Convolutions beside a shortcut; only a unit's first block projects the shortcut. The stride is in the first convolution."""
    steps = [("a", 1 if bottleneck else 3, features, stride), ("b", 3, features, 1)]
    if bottleneck:
        steps.append(("c", 1, 4 * features, 1))
    y = x
    for tag, size, width, step in steps:
        y = y if tag == "a" else ops.relu(y)
        y = ops.norm(ops.conv(y, f"{name}_conv_{tag}", width, (size,) * ops.rank, step, size // 2), f"{name}_bn_{tag}")
    if first:
        x = ops.norm(ops.conv(x, f"{name}_shortcut_conv", steps[-1][2], (1,) * ops.rank, stride, 0), f"{name}_shortcut_bn")
    return ops.relu(ops.add(y, x))


def forward(ops, x, depth: str, features: int, classes: int):
    x = ops.relu(ops.norm(ops.conv(x, "conv1", features, (7, 7, 3)[: ops.rank], 2, 3), "conv1_bn"))
    x = ops.pool(x, (3, 3, 2)[: ops.rank], 2)
    blocks, bottleneck = DEPTHS[depth]
    for unit, count in enumerate(blocks):
        for k in range(count):
            x = _block(ops, x, f"resunit{unit + 2}_block{k}", features << unit, 2 if unit and not k else 1, bottleneck, not k)
    return ops.head(x, classes)


@lru_cache(maxsize=2)
def _read(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


class ResidualNetwork:
    """A scorer for cubes of `shape` (y, x, z, channels; y, x, channels for single planes). `weights` are arrays, or the name
    of a file that was given to all executors (see `from_file`); a Python worker reads it once."""

    def __init__(self, weights: dict[str, np.ndarray] | str, depth: str = "50-layer", shape: tuple[int, ...] = (50, 50, 20, 2), classes: int = 2, features: int = 64, block: int = 32):
        if len(shape) not in (3, 4):
            raise ValueError(f"a network has 2 or 3 axes and channels, not {shape}")
        if depth not in DEPTHS:
            raise ValueError(f"unknown depth {depth!r}")
        self.weights, self.depth, self.shape, self.classes, self.features, self.block = weights, depth, tuple(shape), classes, features, block
        if isinstance(weights, dict):
            self.check(weights)

    @classmethod
    def from_file(cls, spark: SparkSession, path: str | None, **described) -> "ResidualNetwork":
        """With the .npz file at `path`, in any store that Spark reads."""
        if path is None:
            raise OSError("a network cannot score without weights")
        if not path.endswith(".npz"):
            raise ValueError(f"weights are read from .npz files only, not {path}")
        spark.sparkContext.addFile(path)
        model = cls(path.rsplit("/", 1)[-1], **described)
        model.check(_read(SparkFiles.get(model.weights)))
        return model

    @property
    def channels(self) -> int:
        return self.shape[-1]

    def needed(self) -> dict[str, tuple[int, ...]]:
        shapes = Shapes(len(self.shape) - 1)
        forward(shapes, self.shape, self.depth, self.features, self.classes)
        return shapes.needed

    def check(self, weights: dict[str, np.ndarray]) -> None:
        needed = self.needed()
        wrong = [k for k in needed.keys() | weights.keys() if k not in needed or k not in weights or weights[k].shape != needed[k]]
        if wrong:
            raise ValueError(f"the weights do not fit the network, in {sorted(wrong)[:5]}")

    def initial(self, seed: int = 0) -> dict[str, np.ndarray]:
        """Weights of an untrained network: normal by fan-in, and a normalisation that changes nothing."""
        draw = np.random.default_rng(seed)
        kinds = {"kernel": lambda s: draw.normal(0, np.sqrt(2 / np.prod(s[:-1])), s), "gamma": np.ones, "moving_variance": np.ones}
        return {k: kinds.get(k.rsplit("/", 1)[1], np.zeros)(s).astype(np.float32) for k, s in self.needed().items()}

    def load(self) -> "ResidualNetwork":
        if isinstance(self.weights, dict):
            return self
        return ResidualNetwork(_read(SparkFiles.get(self.weights)), self.depth, self.shape, self.classes, self.features, self.block)

    def score(self, batch: np.ndarray) -> np.ndarray:
        """batch: (n, z, y, x, channels)."""
        x = np.moveaxis(batch, 1, 3)
        if len(self.shape) == 3:
            if x.shape[3] != 1:
                raise ValueError(f"a network for planes meets cubes of {x.shape[3]} planes")
            x = x[:, :, :, 0]
        if x.shape[1:] != self.shape:
            raise ValueError(f"cubes of {x.shape[1:]} meet a network for {self.shape}")
        ops = Arrays(len(self.shape) - 1, self.weights)
        parts = [forward(ops, x[k : k + self.block].astype(np.float32), self.depth, self.features, self.classes) for k in range(0, len(x), self.block)]
        return np.concatenate(parts) if parts else np.zeros((0, self.classes))


def chosen_model(name: str, background: bool) -> str:
    """The default model needs a background; without one its form for one channel is taken."""
    return "resnet50_1ch" if name == "resnet50_tv" and not background else name


def model_files(trained: str | None, weights: str | None) -> tuple[str | None, str | None]:
    """A file of weights that is given as a model counts as weights of the default one."""
    return (None, trained) if trained and trained.endswith((".h5", ".npz")) else (trained, weights)
