"""Scaling, label encodings and images against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halosift.functions import labels, scaling
from halosift.functions.grids import GridSpec, Images, build_images, pixel_names
from halosift.operators.maps import mean_maps


def test_scaling_rules(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None), (3.0, 5.0, None), (float("nan"), 5.0, None), (2.0, None, None)],
        "`sw+` double, b double, c double",
    )
    fitted = scaling.MinMax.fit(df, ["sw+", "b", "c"])
    assert fitted.ranges == {"sw+": (1.0, 3.0), "b": (5.0, 5.0), "c": (None, None)}
    rows = [tuple(r) for r in fitted.scale(df).collect()]
    assert rows == [(0.0, 0.0, None), (1.0, 0.0, None), (None, 0.0, None), (0.5, None, None)]
    back = [tuple(r) for r in fitted.unscale(fitted.scale(df)).collect()]
    assert back == [(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None), (2.0, None, None)]


def test_one_hot_has_one_entry_per_class(spark):
    df = spark.createDataFrame([(0,), (1,), (None,), (7,)], "label int")
    hot = labels.one_hot(F.col("label"), [1, 0])
    rows = df.select(hot.alias("h"), labels.from_one_hot(hot, [1, 0]).alias("back")).collect()
    assert [r["h"] for r in rows] == [[1, 0], [0, 1], [0, 0], [0, 0]]
    assert [r["back"] for r in rows] == [0, 1, None, None]


def test_predicted_label_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],)], "p array<double>")
    got = df.select(labels.predicted_label(F.col("p"), [3, 1, 2])).collect()
    assert [r[0] for r in got] == [1, 3]


def test_label_names(spark):
    df = spark.createDataFrame([(0,), (9,), (None,)], "label int")
    assert [r[0] for r in df.select(labels.label_name(F.col("label"))).collect()] == ["signal", None, None]


@pytest.fixture(scope="module")
def pixels(spark):
    """Ten 3x3 images; the third is all zeros in E, the fifth lacks one pixel."""
    rng = np.random.default_rng(0)
    data = rng.normal(size=(10, 3, 9))
    data[2, 0] = 0.0
    data[4, 0, 3] = np.nan
    names = [n for ch in "Etr" for n in pixel_names(ch, 1)]
    rows = [(i, i % 2, *(None if math.isnan(v) else float(v) for v in data[i].ravel())) for i in range(10)]
    schema = "key int, label int, " + ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame(rows, schema), data


def tensors(images):
    rows = images.df.orderBy("key").collect()
    return np.array([[np.nan if v is None else v for v in r["x"]] for r in rows])


def expected(data, spec):
    named = dict(zip("Etr", np.moveaxis(data.copy(), 1, 0)))
    for ch in spec.normalize:
        total = np.nansum(named[ch], axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = named[ch] / total
        named[ch] = np.where((total == 0) & ~np.isnan(named[ch]), 0.0, share)
    if spec.products:
        return [named[a] * named[b] for a, b in spec.products_in_order]
    return [named[c] for c in spec.names]


@pytest.mark.parametrize(
    "spec, names",
    [
        (GridSpec(), ["E", "t", "r"]),
        (GridSpec(channels=("r", "E")), ["E", "r"]),
        (GridSpec(channels=("E",), normalize=("E",)), ["E"]),
        (GridSpec(products=(("r", "E"),)), ["Er"]),
        (GridSpec(normalize=("E", "t"), products=(("E", "t"), ("t", "r"))), ["Et", "tr"]),
    ],
)
def test_images(pixels, spec, names):
    df, data = pixels
    plain = build_images(df, spec, ["key", "label"], scale=False)
    assert plain.names == names and plain.shape == (3, 3, len(names))
    channels = expected(data, spec)
    assert np.allclose(tensors(plain), np.stack(channels, axis=2).reshape(10, -1), equal_nan=True)
    scaled = build_images(df, spec, ["key", "label"])
    low = [np.nanmin(c) for c in channels]
    high = [np.nanmax(c) for c in channels]
    want = np.stack([(c - a) / (b - a) for c, a, b in zip(channels, low, high)], axis=2).reshape(10, -1)
    assert np.allclose(tensors(scaled), want, equal_nan=True)


def test_scale_can_be_fitted_on_the_training_rows(pixels):
    df, data = pixels
    images = build_images(df, GridSpec(channels=("t",)), ["key"], fit_on=df.filter("key < 5"))
    assert images.ranges["t"] == (data[:5, 1].min(), data[:5, 1].max())


def test_missing_pixel_columns_are_named(pixels):
    df, _ = pixels
    with pytest.raises(ValueError, match="CNNgrid_t_cell0_0"):
        build_images(df.drop("CNNgrid_t_cell0_0"), GridSpec(), ["key"])


def test_mean_maps_sum_to_one_and_put_eta_first(spark):
    x = [[0.0] * 18 for _ in range(2)]
    x[0][(0 * 3 + 2) * 2 + 1] = 4.0  # i = -1, j = +1, second channel
    x[1][(2 * 3 + 0) * 2 + 1] = 12.0
    x[0][0] = 1.0
    df = spark.createDataFrame([(1, x[0]), (1, x[1])], "label int, x array<double>")
    got = {
        (r["channel"], r["i"], r["j"]): r["value"] for r in mean_maps(Images(df, 3, ["a", "b"])).collect()
    }
    assert len(got) == 18 and got["b", -1, 1] == 0.25 and got["b", 1, -1] == 0.75 and got["a", -1, -1] == 1.0


def test_unknown_channels_are_refused():
    from halosift.functions.grids import GridSpec

    for wrong in ({"channels": ("E", "q")}, {"products": (("E", "E"),)}, {"normalize": ("x",)}):
        with pytest.raises(ValueError, match="unknown channels"):
            GridSpec(**wrong)
