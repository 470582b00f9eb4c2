"""NumPy nets: gradients against finite differences, shapes, and one plain layer."""

import numpy as np
import pytest

from halosift.models.nets import ARCHS, Adam, conv_net, dense_net, dual_conv_net, grid_net


def loss(net, params, x, y):
    return -np.log(net.predict(params, x)[np.arange(len(y)), y]).mean()


@pytest.mark.parametrize(
    "net",
    [
        dense_net(5, 3, (4, 3)),
        conv_net((5, 5, 2), 3, [3, 2]),
        dual_conv_net((7, 7, 2), 3, [2, 2, 2]),
    ],
)
def test_gradient_matches_finite_differences(net):
    rng = np.random.default_rng(1)
    params = net.initial(3) + rng.normal(0, 0.05, net.n_params)
    x, y = rng.normal(size=(6, net.n_inputs)), rng.integers(0, 3, 6)
    _, grad = net.gradient(params, x, y)
    for k in rng.choice(net.n_params, min(60, net.n_params), replace=False):
        step = np.zeros(net.n_params)
        step[k] = 1e-6
        slope = (loss(net, params + step, x, y) - loss(net, params - step, x, y)) / 2e-6
        assert abs(slope - grad[k]) < 1e-6


def test_shapes():
    shapes = [lay.out_shape for lay in grid_net("default", (7, 7, 1), 3).branch_layers[0]]
    assert shapes == [(5, 5, 64), (3, 3, 64), (1, 1, 64)]
    assert grid_net("xsmall3", (7, 7, 1), 3).branch_layers[0][-1].out_shape == (3, 3, 3)
    dual = grid_net("dual", (7, 7, 3), 3)
    assert [lay.out_shape for lay in dual.branch_layers[1]] == [(5, 7, 8), (3, 7, 8), (1, 7, 8), (1, 1, 8)]
    assert dual.dense_layers[0].in_shape == (1, 1, 16)
    assert set(ARCHS) == {"default", "xsmall3", "small3", "small4", "small8", "dual", "sublead"}


def test_two_classes_have_two_outputs():
    net = dense_net(4, 2)
    p = net.predict(net.initial(0), np.ones((3, 4)))
    assert p.shape == (3, 2) and np.allclose(p.sum(axis=1), 1)


def test_convolution_by_hand():
    net = conv_net((3, 3, 1), 2, [1])
    params = np.zeros(net.n_params)
    weights, bias = net.branch_layers[0][0].parts(params)
    weights[:, :, 0, 0] = np.arange(9).reshape(3, 3)
    bias[:] = 0.5
    image = np.arange(9, dtype=float)[::-1]
    out = net.activations(params, image[None], "conv0")
    assert out.shape == (1, 1, 1, 1)
    assert out.item() == pytest.approx((np.arange(9) * image).sum() + 0.5)


def test_adam_first_step_has_the_learning_rate():
    state = Adam.begin(np.zeros(3))
    state.step(np.array([1.0, -2.0, 0.5]))
    assert np.allclose(state.params, [-0.001, 0.001, -0.001], rtol=1e-4)


# --- DeepLIFT --------------------------------------------------------------------------


def _nets_for_multipliers():
    from halosift.models.nets import conv_net, dual_conv_net

    return [dense_net(5, 3, ()), dense_net(5, 3, (4,)), dense_net(5, 2, (6, 4)), conv_net((5, 5, 2), 3, [3, 2]), dual_conv_net((7, 7, 1), 3, [2, 2])]


@pytest.mark.parametrize("net", _nets_for_multipliers())
def test_multipliers_add_up_to_the_change_of_probability(net):
    from halosift.models import deeplift

    rng = np.random.default_rng(1)
    params = rng.normal(0, 0.5, net.n_params)
    x, base = rng.normal(size=(7, net.n_inputs)), rng.normal(size=(5, net.n_inputs))
    x[0] = base[0]  # no change at all
    for c in range(net.classes):
        got = deeplift.attribute(net, params, x, base, c)
        want = net.predict(params, x)[:, c] - net.predict(params, base)[:, c].mean()
        assert np.allclose(got.sum(axis=1), want, atol=1e-12)
    alone = deeplift.attribute(net, params, x[:1], base[:1], 0)
    assert np.allclose(alone, 0)


def test_small_changes_follow_the_gradient():
    """Where no ReLU changes sides, multipliers of a small change are the slope."""
    from halosift.models import deeplift

    net, rng = dense_net(4, 3, (6,)), np.random.default_rng(3)
    params, x = rng.normal(0, 0.5, net.n_params), rng.normal(size=4)
    step = 1e-4
    got = deeplift.attribute(net, params, (x + step)[None, :], x[None, :], 1)[0] / step
    slope = [(net.predict(params, (x + step * e / 2)[None, :])[0, 1] - net.predict(params, (x - step * e / 2)[None, :])[0, 1]) / step for e in np.eye(4)]
    assert np.allclose(got, slope, atol=1e-3)


def test_multipliers_do_not_depend_on_how_pairs_are_cut(monkeypatch):
    from halosift.models import deeplift

    net, rng = dense_net(4, 3, (6,)), np.random.default_rng(5)
    params, x, base = rng.normal(0, 0.5, net.n_params), rng.normal(size=(9, 4)), rng.normal(size=(6, 4))
    whole = deeplift.attribute(net, params, x, base, 2)
    each = np.mean([[deeplift.attribute(net, params, r[None, :], b[None, :], 2)[0] for b in base] for r in x], axis=1)
    assert np.allclose(whole, each, atol=1e-12)
    monkeypatch.setattr(deeplift, "PAIRS_AT_ONCE", 4)
    assert np.allclose(deeplift.attribute(net, params, x, base, 2), whole, atol=1e-12)


def test_dense_net_is_that_of_plain_layers():
    """The short way of nets without convolutions against the layers one by one."""
    rng, net = np.random.default_rng(5), dense_net(5, 3, (6, 4))
    params, x, y = net.initial(2) + rng.normal(0, 0.1, net.n_params), rng.normal(size=(50, 5)), rng.integers(0, 3, 50)
    inputs, p = net._run(params, x)
    got, grad = net.gradient(params, x, y)
    assert np.allclose(got, p, atol=1e-14) and np.allclose(net.predict(params, x), p, atol=1e-14)
    want, d = np.zeros_like(params), p.copy()
    d[np.arange(50), y] -= 1.0
    d = (d / 50).reshape(50, 1, 1, -1)
    for k, layer in reversed(list(enumerate(net.dense_layers))):
        d = layer.backward(params, inputs[layer.name], d, want)
        d = d * (inputs[layer.name] > 0) if k else d
    assert np.allclose(grad, want, atol=1e-14)


def test_moments_without_gradient_become_zero():
    """They would stay near 5e-324 for ever, where a step takes four times as long."""
    state = Adam.begin(np.ones(3))
    state.step(np.array([1.0, 0.0, 0.5]))
    for _ in range(9000):
        state.step(np.array([0.0, 0.0, 0.5]))
    assert state.first[0] == 0.0 and state.first[1] == 0.0 and state.first[2] == pytest.approx(0.5)
    assert np.abs(state.first[state.first != 0]).min() > 1e-300


@pytest.mark.parametrize("nodes", [(), (5,), (6, 4)])
def test_batches_of_a_dense_net_equal_its_layers(nodes):
    """Batches of other rows and parameters one after another; what they hold is that of the layers, each on its own."""
    net, layers = dense_net(4, 3, nodes), dense_net(4, 3, nodes)
    layers.__dict__["is_dense"] = False
    batches, rng, given = net.batches(), np.random.default_rng(6), [net.initial(1), net.initial(2)]
    kept = []
    for rows, which in ((7, 0), (7, 1), (3, 1), (7, 0), (1, 0)):
        x, y = rng.normal(size=(rows, 4)), rng.integers(0, 3, rows)
        (p, grad), (want_p, want) = batches.gradient(given[which], x, y), layers.gradient(given[which], x, y)
        assert np.allclose(p, want_p, atol=1e-14) and np.allclose(grad, want, atol=1e-14)
        assert np.allclose(batches.predict(given[which], x), want_p, atol=1e-14)
        kept.append((p, want_p))
    assert all(np.allclose(p, want, atol=1e-14) for p, want in kept)  # probabilities are not overwritten
