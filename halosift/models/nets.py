"""Small feed-forward nets on NumPy batches, used inside tasks only.

Every layer is a valid convolution followed by ReLU (softmax at the end); a dense
layer is one with a 1x1 kernel on a 1x1 image. A net has one or more branches of
convolutions on the same input, whose flattened ends are joined, then dense layers.
All parameters live in one flat vector, which is what Spark moves around.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import sqrt

import numpy as np

# Optimiser constants.
LEARNING_RATE, BETA1, BETA2, EPSILON = 1e-3, 0.9, 0.999, 1e-7

# Moments of parameters without gradient shrink for ever. They are zero below TINY, looked at
# every CLEARED_AFTER steps: processors are many times slower on numbers near 1e-308.
TINY, CLEARED_AFTER = 1e-200, 256
ZERO = np.zeros(())  # faster in small batches than a number that each call turns into an array


@dataclass(frozen=True)
class Layer:
    name: str
    kernel: tuple[int, int]
    filters: int
    in_shape: tuple[int, int, int]
    start: int  # first parameter in the flat vector

    @property
    def out_shape(self) -> tuple[int, int, int]:
        h, w, _ = self.in_shape
        return h - self.kernel[0] + 1, w - self.kernel[1] + 1, self.filters

    @property
    def weight_shape(self) -> tuple[int, int, int, int]:
        return *self.kernel, self.in_shape[2], self.filters

    @property
    def n_weights(self) -> int:
        return int(np.prod(self.weight_shape))

    @property
    def end(self) -> int:
        return self.start + self.n_weights + self.filters

    def parts(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.start + self.n_weights
        return params[self.start:cut].reshape(self.weight_shape), params[cut:self.end]

    def forward(self, params: np.ndarray, a: np.ndarray) -> np.ndarray:
        """One product of matrices for each place of the kernel, over all rows and pixels."""
        weights, bias = self.parts(params)
        h, w, _ = self.out_shape
        z = np.zeros((len(a) * h * w, self.filters)) + bias
        for di in range(self.kernel[0]):
            for dj in range(self.kernel[1]):
                z += a[:, di:di + h, dj:dj + w].reshape(-1, a.shape[3]) @ weights[di, dj]
        return z.reshape(len(a), h, w, self.filters)

    def pull(self, params: np.ndarray, dz: np.ndarray) -> np.ndarray:
        """What a derivative (or multiplier) of the output is of the input."""
        weights, _ = self.parts(params)
        h, w, _ = self.out_shape
        da, flat = np.zeros((len(dz), *self.in_shape)), dz.reshape(-1, self.filters)
        for di in range(self.kernel[0]):
            for dj in range(self.kernel[1]):
                da[:, di:di + h, dj:dj + w] += (flat @ weights[di, dj].T).reshape(len(dz), h, w, -1)
        return da

    def backward(self, params: np.ndarray, a: np.ndarray, dz: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """Write this layer's gradient into ``grad`` and return that of its input."""
        g_weights, g_bias = self.parts(grad)
        h, w, _ = self.out_shape
        flat = dz.reshape(-1, self.filters)
        g_bias += flat.sum(axis=0)
        for di in range(self.kernel[0]):
            for dj in range(self.kernel[1]):
                window = a[:, di:di + h, dj:dj + w]
                g_weights[di, dj] += window.reshape(-1, a.shape[3]).T @ flat
        return self.pull(params, dz)


@dataclass(frozen=True)
class Net:
    """``branches`` are lists of (filters, kernel); ``hidden`` are dense sizes."""

    input_shape: tuple[int, int, int]
    branches: tuple[tuple[tuple[int, tuple[int, int]], ...], ...]
    hidden: tuple[int, ...]
    classes: int

    @cached_property
    def branch_layers(self) -> list[list[Layer]]:
        names = ["conv"] if len(self.branches) == 1 else [f"branch{i + 1}_conv" for i in range(len(self.branches))]
        start, out = 0, []
        for name, branch in zip(names, self.branches):
            shape, layers = self.input_shape, []
            for i, (filters, kernel) in enumerate(branch):
                layers.append(Layer(f"{name}{i}", kernel, filters, shape, start))
                shape, start = layers[-1].out_shape, layers[-1].end
            out.append(layers)
        return out

    @cached_property
    def dense_layers(self) -> list[Layer]:
        start = max([lay.end for b in self.branch_layers for lay in b], default=0)
        width = sum(int(np.prod(b[-1].out_shape if b else self.input_shape)) for b in self.branch_layers)
        layers = []
        for i, n in enumerate([*self.hidden, self.classes]):
            name = "output" if i == len(self.hidden) else f"dense{i}"
            layers.append(Layer(name, (1, 1), n, (1, 1, width), start))
            width, start = n, layers[-1].end
        return layers

    @property
    def n_params(self) -> int:
        return self.dense_layers[-1].end

    @property
    def n_inputs(self) -> int:
        return int(np.prod(self.input_shape))

    def initial(self, seed: int) -> np.ndarray:
        """Glorot-uniform weights and zero biases."""
        rng, params = np.random.default_rng(seed), np.zeros(self.n_params)
        for layer in [lay for b in self.branch_layers for lay in b] + self.dense_layers:
            kh, kw, c, f = layer.weight_shape
            limit = np.sqrt(6.0 / (kh * kw * (c + f)))
            layer.parts(params)[0][:] = rng.uniform(-limit, limit, layer.weight_shape)
        return params

    @cached_property
    def is_dense(self) -> bool:
        return len(self.branches) == 1 and not self.branches[0]

    def batches(self) -> "Net | DenseBatches":
        """What takes `predict` and `gradient` of many batches faster, if there is such a thing."""
        return DenseBatches(self) if self.is_dense else self

    def _run(self, params: np.ndarray, x: np.ndarray):
        """Inputs of every layer, and the class probabilities."""
        image = x.reshape(-1, *self.input_shape)
        inputs, ends = {}, []
        for layers in self.branch_layers:
            a = image
            for layer in layers:
                inputs[layer.name] = a
                a = np.maximum(layer.forward(params, a), 0.0)
            inputs["end", id(layers)] = a
            ends.append(a.reshape(len(x), 1, 1, -1))
        a = np.concatenate(ends, axis=3)
        for layer in self.dense_layers:
            inputs[layer.name] = a
            z = layer.forward(params, a)
            a = np.maximum(z, 0.0)
        z = z[:, 0, 0, :]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return inputs, e / e.sum(axis=1, keepdims=True)

    def predict(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.is_dense:
            return self.batches().predict(params, x)
        return self._run(params, x)[1]

    def activations(self, params: np.ndarray, x: np.ndarray, layer: str) -> np.ndarray:
        """ReLU output of a convolution layer, (rows, h, w, filters)."""
        for layers in self.branch_layers:
            a = x.reshape(-1, *self.input_shape)
            for lay in layers:
                a = np.maximum(lay.forward(params, a), 0.0)
                if lay.name == layer:
                    return a
        raise ValueError(f"no convolution layer named {layer}")

    def gradient(self, params: np.ndarray, x: np.ndarray, y: np.ndarray):
        """(probabilities, gradient of the mean cross-entropy) for class indexes ``y``."""
        if self.is_dense:
            return self.batches().gradient(params, x, y)
        inputs, p = self._run(params, x)
        grad = np.zeros_like(params)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1.0
        d = (d / len(y)).reshape(len(y), 1, 1, -1)
        for layer in reversed(self.dense_layers):
            d = layer.backward(params, inputs[layer.name], d, grad)
            if layer is not self.dense_layers[0]:
                d = d * (inputs[layer.name] > 0)
        at = 0
        for layers in self.branch_layers:
            end = inputs["end", id(layers)]
            width = int(np.prod(end.shape[1:]))
            part = d[:, 0, 0, at:at + width].reshape(end.shape)
            at += width
            for k in range(len(layers) - 1, -1, -1):
                out = end if k == len(layers) - 1 else inputs[layers[k + 1].name]
                part = layers[k].backward(params, inputs[layers[k].name], part * (out > 0), grad)
        return p, grad


class DenseBatches:
    """`predict` and `gradient` of a dense net on batch after batch, on plain matrices: each layer's weights with the
    bias as last row, as they lie in the vector; inputs with a last column of ones; classes in rows. Views and arrays in
    between are made once for a vector and a number of rows, as small batches are many. So a gradient is overwritten by
    the next one; probabilities are not."""

    def __init__(self, net: Net):
        self.layers = [(lay.start, lay.end, lay.filters) for lay in net.dense_layers]
        self.classes = np.arange(net.classes)[:, None]
        self.params, self.rows = None, -1
        self.grad = np.empty(net.n_params)
        self.grads = self._parts(self.grad)

    def _parts(self, vector: np.ndarray) -> list[np.ndarray]:
        return [vector[start:end].reshape(-1, filters) for start, end, filters in self.layers]

    def _take(self, params: np.ndarray, rows: int) -> None:
        if params is self.params and rows == self.rows:
            return
        if params is not self.params:
            self.params, self.matrices = params, self._parts(params)
        if rows != self.rows:
            ends = np.cumsum([0] + [rows * len(m) for m in self.grads])
            self.rows, flat = rows, np.ones(ends[-1])
            layers = [flat[i:j] for i, j in zip(ends, ends[1:])]
            self.inputs = [a.reshape(rows, -1) for a in layers]
            self.hidden, self.flat = layers[1:], flat[ends[1]:]  # of inputs, all but the first
            self.positive, self.factors = np.empty(self.flat.size, dtype=bool), np.empty(self.flat.size)
            self.of_hidden = [self.factors[i:j] for i, j in zip(ends[1:] - ends[1], ends[2:] - ends[1])]
            self.own, self.turned = [a[:, :-1] for a in self.inputs], [a.T for a in self.inputs]
            self.last = np.empty((rows, len(self.classes)))
            self.out, self.row = np.empty(self.last.T.shape), np.empty(rows)
            self.is_class = np.empty(self.last.T.shape, dtype=bool)
        back = [m[:-1].T for m in self.matrices[1:]]
        self.forward = list(zip(self.inputs, self.matrices, self.own[1:], self.hidden))
        self.backward = list(zip(self.turned[1:], self.grads[1:], back, self.own[1:], self.hidden, self.of_hidden))[::-1]

    def _predict(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        self._take(params, len(x))
        np.copyto(self.own[0], x)
        for inputs, matrix, out, whole in self.forward:
            np.matmul(inputs, matrix, out=out)
            np.maximum(whole, ZERO, out=whole)  # ones stay ones
        np.matmul(self.inputs[-1], self.matrices[-1], out=self.last)
        a, row = self.out, self.row
        np.copyto(a, self.last.T)
        a -= np.maximum.reduce(a, axis=0, out=row)
        p = np.exp(a)
        p /= np.add.reduce(p, axis=0, out=row)
        return p

    def predict(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._predict(params, x).T

    def gradient(self, params: np.ndarray, x: np.ndarray, y: np.ndarray):
        """(probabilities, gradient of the mean cross-entropy) for class indexes ``y``."""
        p = self._predict(params, x)
        d = np.subtract(p, np.equal(self.classes, y, out=self.is_class), out=self.out)
        d /= len(y)
        d = d.T
        np.copyto(self.factors, np.greater(self.flat, ZERO, out=self.positive))
        for turned, grad, back, own, whole, factors in self.backward:
            np.matmul(turned, d, out=grad)
            d = np.matmul(d, back, out=own)  # takes the place of the input, which is not needed again
            np.multiply(whole, factors, out=whole)
        np.matmul(self.turned[0], d, out=self.grads[0])
        return p.T, self.grad


@dataclass
class Adam:
    params: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float

    def __post_init__(self):
        self._part = np.empty_like(self.params)

    @staticmethod
    def begin(params: np.ndarray) -> "Adam":
        return Adam(params.copy(), np.zeros_like(params), np.zeros_like(params), 0.0)

    def step(self, grad: np.ndarray) -> None:
        """One step. Works in place, as it is made once a batch: with a buffer for what is in between."""
        self.steps += 1
        part, first, second = self._part, self.first, self.second
        np.subtract(grad, first, out=part)
        part *= 1 - BETA1
        first += part
        np.multiply(grad, grad, out=part)
        part -= second
        part *= 1 - BETA2
        second += part
        rate = LEARNING_RATE * sqrt(1 - BETA2**self.steps) / (1 - BETA1**self.steps)
        np.sqrt(second, out=part)
        part += EPSILON
        np.divide(first, part, out=part)
        part *= rate
        self.params -= part
        if self.steps % CLEARED_AFTER == 0:
            for moments in (first, second):
                moments[np.abs(moments) < TINY] = 0.0


# Convolution filter lists by architecture name.
ARCHS = {
    "default": [64, 64, 64],
    "xsmall3": [3, 3],
    "small3": [3, 3, 3],
    "small4": [4, 4, 4],
    "small8": [8, 8, 8],
    "dual": [8, 8, 8],
    "sublead": [8, 8, 8],
}
DENSE_NODES = [64, 64, 64]
FIRST_KERNEL, SECOND_KERNEL = (3, 3), (3, 1)


def dense_net(n_features: int, classes: int, nodes=tuple(DENSE_NODES)) -> Net:
    return Net((1, 1, n_features), ((),), tuple(nodes), classes)


def conv_net(shape: tuple[int, int, int], classes: int, filters, kernel=FIRST_KERNEL) -> Net:
    """Convolutions, then two dense layers twice as wide as the last filter count."""
    return Net(tuple(shape), (tuple((f, kernel) for f in filters),), (2 * filters[-1],) * 2, classes)


def dual_conv_net(
    shape: tuple[int, int, int], classes: int, filters, kernels=(FIRST_KERNEL, SECOND_KERNEL)
) -> Net:
    """Two branches; the second ends in one convolution over all that is left of
    its image, so that both end in one pixel per filter."""
    first, second = (tuple((f, k) for f in filters) for k in kernels)
    left = tuple(shape[i] - len(filters) * (kernels[1][i] - 1) for i in (0, 1))
    return Net(
        tuple(shape), (first, (*second, (filters[-1], left))), (2 * filters[-1],) * 2, classes
    )


def grid_net(arch: str, shape: tuple[int, int, int], classes: int) -> Net:
    build = dual_conv_net if arch == "dual" else conv_net
    return build(shape, classes, ARCHS[arch])
