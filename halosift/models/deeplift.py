"""DeepLIFT multipliers: what of a change of the output each input owes, against a reference.

An input's attribution is its difference from the reference times a multiplier,
which one backward pass gives. A linear step hands multipliers through its weights. A
ReLU has the multiplier change of output / change of input, or its slope where the input
does not change. The softmax is taken apart: exponentials as such steps (shifted by one
amount for row and reference, which cancels), and the division, whose change is shared between
numerator and denominator as the mean over both orders of changing them. Attributions of a row add up to the change of the class
probability exactly.
"""

from __future__ import annotations

import numpy as np

from halosift.models.nets import Net

NO_CHANGE = 1e-7  # smaller changes have the slope as their multiplier
PAIRS_AT_ONCE = 2048


def _trace(net: Net, params: np.ndarray, x: np.ndarray) -> tuple[dict, np.ndarray]:
    """Every layer's output before ReLU, and that of the last."""
    image, before, ends = x.reshape(-1, *net.input_shape), {}, []
    for layers in net.branch_layers:
        a = image
        for layer in layers:
            before[layer.name] = layer.forward(params, a)
            a = np.maximum(before[layer.name], 0.0)
        ends.append(a.reshape(len(x), 1, 1, -1))
    a = np.concatenate(ends, axis=3)
    for layer in net.dense_layers:
        before[layer.name] = layer.forward(params, a)
        a = np.maximum(before[layer.name], 0.0)
    return before, before[net.dense_layers[-1].name][:, 0, 0, :]


def _ratio(change: np.ndarray, of: np.ndarray, slope: np.ndarray) -> np.ndarray:
    small = np.abs(of) < NO_CHANGE
    return np.where(small, slope, change / np.where(small, 1.0, of))


def _relu(z: np.ndarray, base: np.ndarray) -> np.ndarray:
    return _ratio(np.maximum(z, 0.0) - np.maximum(base, 0.0), z - base, (z > 0).astype(float))


def softmax_multipliers(z: np.ndarray, base: np.ndarray, class_index: int) -> np.ndarray:
    """Of the class probability, for each of the last layer's outputs."""
    top = np.maximum(z.max(axis=1), base.max(axis=1))[:, None]
    e, f = np.exp(z - top), np.exp(base - top)
    all_e, all_f = e.sum(axis=1), f.sum(axis=1)
    own_e, own_f = e[:, class_index], f[:, class_index]
    over = (1 / all_e + 1 / all_f) / 2  # of the numerator
    under = -(own_e + own_f) / (2 * all_e * all_f)  # of the denominator
    of_e = np.repeat(under[:, None], z.shape[1], axis=1)
    of_e[:, class_index] += over
    return of_e * _ratio(e - f, z - base, e)


def _pairs(net: Net, params: np.ndarray, row: dict, base: dict, x: np.ndarray, start: np.ndarray, class_index: int) -> np.ndarray:
    """Attributions of each (row, reference) pair, (pairs, inputs)."""
    last = net.dense_layers[-1]
    m = softmax_multipliers(row[last.name][:, 0, 0, :], base[last.name][:, 0, 0, :], class_index)[:, None, None, :]
    for k in range(len(net.dense_layers) - 1, -1, -1):
        layer = net.dense_layers[k]
        if layer is not last:
            m = m * _relu(row[layer.name], base[layer.name])
        m = layer.pull(params, m)
    total, at = np.zeros((len(x), *net.input_shape)), 0
    for layers in net.branch_layers:
        shape = layers[-1].out_shape if layers else net.input_shape
        width = int(np.prod(shape))
        part = m[:, 0, 0, at:at + width].reshape(-1, *shape)
        at += width
        for layer in reversed(layers):
            part = layer.pull(params, part * _relu(row[layer.name], base[layer.name]))
        total += part
    return total.reshape(len(x), -1) * (x - start)


def attribute(net: Net, params: np.ndarray, x: np.ndarray, background: np.ndarray, class_index: int) -> np.ndarray:
    """Attributions of the rows of ``x``, averaged over the background rows."""
    many = len(background)
    base, _ = _trace(net, params, background)
    out = np.zeros((len(x), net.n_inputs))
    step = max(1, PAIRS_AT_ONCE // many)
    for i in range(0, len(x), step):
        rows = x[i:i + step]
        own, _ = _trace(net, params, rows)
        for j in range(0, many, PAIRS_AT_ONCE):  # a larger background goes in parts
            some = background[j:j + PAIRS_AT_ONCE]
            wide = {k: np.repeat(v, len(some), axis=0) for k, v in own.items()}
            other = {k: np.tile(v[j:j + PAIRS_AT_ONCE], (len(rows), 1, 1, 1)) for k, v in base.items()}
            got = _pairs(net, params, wide, other, np.repeat(rows, len(some), axis=0), np.tile(some, (len(rows), 1)), class_index)
            out[i:i + step] += got.reshape(len(rows), len(some), -1).sum(axis=1)
    return out / many
