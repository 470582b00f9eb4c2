"""Whole jobs composed from the operators. Each returns its tables by name.

``dry_run`` stops before training and returns statistics (and input maps or
histograms) only. Intermediate tables that several later steps read are pinned in
the shared folder once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halosift.functions.grids import GridSpec, Images, build_images
from halosift.functions.scaling import MinMax, real, scaled
from halosift.models import score as scoring
from halosift.models.nets import ARCHS, DENSE_NODES, Net, dense_net, grid_net
from halosift.models.sync import Model, fit, numbered_rows
from halosift.models.train import BATCH_ROWS, Trained, pin_shards, train
from halosift.operators import attribution, cuts, histograms, maps, metrics, roc, sampling, stats
from halosift.session import pin
from halosift.sources.catalogue import GRID_PATTERN, IDENTITY_COLUMNS, quoted, require_columns
from halosift.sources.runs import RunStore

# Classes of the detector flows.
DETECTOR_CLASSES = [1, 2, 3]

# Fixed values: (epochs, early stopping) of the benchmark feature sets; other flows use 20 and no.
BENCHMARK_EPOCHS = {
    "default": (500, True),
    "clusterShapeOnly": (1500, False),
    "IsoOnly": (500, True),
    "subclusterObs": (500, True),
    "addTimeEtaCov": (500, True),
    "addTimeEtaCovEtaPhiCov": (500, True),
    "fourFeature": (2000, False),
}

CLEANING = [
    stats.Cut("matched", cuts.is_matched),
    stats.Cut("no signal-sample background", cuts.is_not_signal_sample_background),
]


@dataclass
class Result:
    """Tables by name, and the trained model if there is one."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    model: Trained | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def run_name(base: str, *options: str, epochs: int, early_stop: bool = False) -> str:
    """Readable run name. Options are only written to it, never read back from it."""
    parts = [base, *[o.replace("+", "p") for o in options if o], f"{epochs}epochs"]
    return "_".join(parts + (["earlyStop"] if early_stop else []))


@dataclass(frozen=True)
class Training:
    """How to train. Averaging by epoch gives other results for other shard counts, so
    the count is an argument and never taken from the cluster; ``synchronous`` training
    (`halosift.models.sync`) gives the same ones, a step of ``batch_rows`` rows at a time."""

    store: RunStore
    run: str
    epochs: int = 20
    shards: int = field(kw_only=True)
    early_stop: bool = False
    seed: int = 43
    batch_rows: int = BATCH_ROWS
    save_best: bool = True
    resume: bool = False
    synchronous: bool = False


def benchmark_training(store: RunStore, features: str, extra: str = "", *, shards: int, synchronous: bool = False) -> Training:
    """The usual length of training for a benchmark feature set."""
    epochs, early_stop = BENCHMARK_EPOCHS[features]
    name = run_name("benchmark", extra, features, epochs=epochs, early_stop=early_stop)
    return Training(store, name, epochs, shards=shards, early_stop=early_stop, synchronous=synchronous)


def _train(rows: DataFrame, classes: Sequence[int], net: Net, how: Training, key: Sequence[str]) -> Trained:
    fit_part, validation = sampling.fit_validation(rows, key)
    if how.synchronous:
        model = Model(how.run, net, how.epochs, early_stop=how.early_stop, seed=how.seed)
        dealt = numbered_rows(fit_part, validation, classes, how.shards, key)
        return fit(dealt, [model], how.store, how.shards, batch_rows=how.batch_rows, resume=how.resume)[how.run]
    fit_rows = pin_shards(fit_part, classes, how.shards, key)
    held_rows = pin_shards(validation, classes, how.shards, key)
    return train(
        fit_rows, held_rows, net, how.store, how.run, how.epochs, how.seed, how.save_best, how.early_stop,
        batch_rows=how.batch_rows, resume=how.resume,
    )


def _multiclass_tables(scored: DataFrame, classes: Sequence[int], against: int) -> dict[str, DataFrame]:
    """The class-against-rest and one-vs-one views of a scored test table."""
    rest = roc.roc_points(roc.against_rest(scored, against, classes))
    pairs = roc.pair_curves(scored, classes)
    first = roc.pair_curves(scored, classes, first_only=True)
    return {
        "class_curve": rest,
        "pair_curves": pairs,
        "pair_curves_zoomed": roc.zoom(first),
        "working_points": roc.working_points(first),
        "test_metrics": metrics.accuracy_and_loss(scored, classes),
        "test_area": metrics.micro_auc(scored, classes),
    }


def _trained_tables(model: Trained) -> dict[str, DataFrame]:
    return {
        "history": model.store.history(model.run),
        "checkpoints": model.store.checkpoints(model.run),
    }


# --- grid detector flow ----------------------------------------------------------------


def grid_steps(key: Sequence[str], classes: Sequence[int] = DETECTOR_CLASSES) -> list[stats.Step]:
    return [
        *CLEANING,
        stats.Cut("class 1 from EGamma", lambda label: cuts.is_class_from(1, "EGamma", label)),
        stats.Cut("leading", lambda label: cuts.is_leading()),
        stats.TableStep("balanced", lambda df: sampling.balance_classes(df, classes, key)),
    ]


def _complete(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(quoted(c)).isNotNull() & ~F.isnan(quoted(c)) for c in columns], F.lit(True))


def _pinned_steps(
    df: DataFrame, steps: Sequence[stats.Step], keep: Sequence[str], **options
) -> tuple[DataFrame, DataFrame]:
    """`stats.run_steps` with the rows left by the row-level stages pinned, narrow,
    before the first stage that needs the whole table. The cut flow is counted while they
    are written: the input is read once. ``keep`` names the columns that go on."""
    first = next((n for n, s in enumerate(steps) if isinstance(s, stats.TableStep)), len(steps))
    wanted = list(dict.fromkeys([*[c for c in ("sample", "label") if c in df.columns], *keep]))
    rows, flow = stats.run_while_writing(df, steps[:first], wanted, **options)
    if first == len(steps):
        return rows, flow
    rows, rest = stats.run_steps(rows, steps[first:], **options)
    later = rest.filter("stage > 0").withColumn("stage", F.col("stage") + first)
    return rows, flow.unionByName(later)


def _pinned(images: Images) -> Images:
    return Images(pin(images.df), images.side, images.names, images.ranges)


def grid_flow(
    df: DataFrame,
    key: Sequence[str],
    spec: GridSpec = GridSpec(products=(("E", "r"),)),
    arch: str | Callable[[tuple[int, int, int], int], Net] = "default",
    training: Training | None = None,
    dry_run: bool = False,
    drop_incomplete: bool = False,
    fit_on_train: bool = False,
) -> Result:
    """Cuts, balance, images and input maps; then a grid classifier and its curves.

    ``arch="sublead"`` gives the input maps of the subleading rows only. ``arch``
    may also be a function of the image shape and the number of classes that gives
    the net, for filters and masks of one's own. ``drop_incomplete`` leaves out
    images with a missing pixel before balancing; ``fit_on_train`` takes the ranges
    of the channels from the training rows.
    """
    if isinstance(arch, str) and arch not in ARCHS:
        raise ValueError(f"unknown architecture {arch!r}; one of {sorted(ARCHS)}")
    require_columns(df, IDENTITY_COLUMNS, "grid_flow")
    steps, keep = grid_steps(key), [*key, "label"]
    if arch == "sublead":
        subleading = cuts.split_leading(stats.apply_steps(df, steps[:3]))[1]
        images = _pinned(build_images(subleading, spec, keep))
        train_rows, _ = sampling.train_test(images.df, key)
        shown = Images(train_rows, images.side, images.names)
        return Result({"input_maps": maps.mean_maps(shown)})

    pixels = [c for c in df.columns if GRID_PATTERN.fullmatch(c)]
    if drop_incomplete:
        steps.insert(-1, stats.Cut("complete", lambda label: _complete(pixels)))
    rows, flow = _pinned_steps(df, steps, [*keep, *pixels])
    out = Result({"cut_flow": flow})
    fit_on = sampling.train_test(rows, key)[0] if fit_on_train else None
    images = _pinned(build_images(rows, spec, keep, fit_on=fit_on))
    train_rows, test_rows = sampling.train_test(images.df, key)
    out.tables["input_maps"] = maps.mean_maps(Images(train_rows, images.side, images.names))
    if dry_run or training is None:
        return out

    make = arch if callable(arch) else lambda shape, n: grid_net(arch, shape, n)
    net = make(images.shape, len(DETECTOR_CLASSES))
    model = out.model = _train(train_rows, DETECTOR_CLASSES, net, training, key)
    out.tables.update(_trained_tables(model))
    one = sampling.take_random(test_rows, 1, sampling.SPLIT_SEED, key)
    layers = [
        scoring.activations(one, net, model.params, layer, keep) for layer in scoring.conv_layers(net)
    ]
    for n, table in enumerate(layers):
        out.tables["activations"] = table if n == 0 else out.tables["activations"].unionByName(table)
    scored = out.tables["scored"] = pin(scoring.score(test_rows, net, model.params).drop("x"))
    out.tables.update(_multiclass_tables(scored, DETECTOR_CLASSES, against=1))
    return out


# --- dense flows -----------------------------------------------------------------------


def _feature_rows(
    df: DataFrame, features: Sequence[str], key: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows, train rows, test rows) of a pinned table, with the key, the label and the features."""
    plain = df.select(*map(quoted, dict.fromkeys([*key, "label", *features])))
    return plain, *sampling.train_test(plain, key)


def _with_inputs(features: Sequence[str], fit_on: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables with the scaled feature array ``x``."""
    fitted = MinMax.fit(fit_on, features)
    x = F.array(*[scaled(real(f), *fitted.ranges[f]) for f in features])
    return [t.withColumn("x", x) for t in tables]


def dense_flow(
    df: DataFrame,
    key: Sequence[str],
    features: str | Iterable[str] = "detector",
    exclude: str | None = None,
    even: bool = False,
    training: Training | None = None,
    dry_run: bool = False,
    nodes: Sequence[int] = tuple(DENSE_NODES),
    drop_incomplete: bool = False,
    fit_on_train: bool = False,
    explain: bool = False,
) -> Result:
    """Cleaning, optional balance, histograms; then a dense classifier, its curves
    and the closure test. ``explain`` adds the feature attribution."""
    names, warning = cuts.feature_columns(features, exclude)
    if warning:
        print(warning)
    require_columns(df, [*IDENTITY_COLUMNS, *names], "dense_flow")
    steps: list[stats.Step] = list(CLEANING)
    if even:
        steps.append(
            stats.TableStep("balanced", lambda t: sampling.balance_classes(t, DETECTOR_CLASSES, key))
        )
    if dry_run:
        return Result({"cut_flow": stats.cut_flow(df, steps, samples=False)})
    rows, flow = _pinned_steps(df, steps, [*key, *names], samples=False)
    out = Result({"cut_flow": flow})
    if drop_incomplete:
        rows = rows.dropna(subset=names)
    rows = pin(rows) if even else rows  # a balanced sample is a filter by hash, which many passes would repeat
    all_rows, train_rows, test_rows = _feature_rows(rows, names, key)
    classes = stats.class_list(all_rows)
    out.tables["histograms"] = histograms.class_histograms(train_rows, names, classes)
    if training is None:
        return out

    fit_on = train_rows if fit_on_train else all_rows
    train_rows, test_rows = _with_inputs(names, fit_on, train_rows, test_rows)
    net = dense_net(len(names), len(classes), nodes)
    model = out.model = _train(train_rows, classes, net, training, key)
    out.tables.update(_trained_tables(model))
    scored = out.tables["scored"] = pin(scoring.score(test_rows, net, model.params).drop("x"))
    out.tables.update(_multiclass_tables(scored, classes, against=1))
    out.tables["closure"] = histograms.closure(
        pin(scoring.score(train_rows, net, model.params).drop("x")), names, classes
    )
    if explain:
        values = attribution.explain_sample(train_rows, net, model.params, key, multipliers=True)
        out.tables["importance"] = attribution.importance(values, names)
    return out


def benchmark_steps(classes: Sequence[int] | None = None) -> list[stats.Step]:
    """The stages; with ``classes`` the last one keeps those classes only."""
    chosen = [stats.Cut("classes", lambda label: F.coalesce(label.isin(*classes), F.lit(False)))] if classes else []
    return [
        *CLEANING,
        stats.Relabel("halo as background", {2: 1}),
        stats.Cut("object selection", lambda label: cuts.is_not_sentinel("R9")),
        stats.Cut("leading photon", lambda label: cuts.is_lead_photon()),
        *chosen,
    ]


def benchmark_flow(
    df: DataFrame,
    key: Sequence[str],
    features: str | Iterable[str] = "default",
    training: Training | None = None,
    dry_run: bool = False,
    nodes: Sequence[int] = tuple(DENSE_NODES),
    drop_incomplete: bool = False,
    fit_on_train: bool = False,
    classes: Sequence[int] | None = None,
) -> Result:
    """Cleaning, halo merged into class 1, object selection, leading photons; then
    a dense classifier with the curve and area of class 1 against the rest.

    All rows that the cuts leave are trained on, and the classes are those found
    there; ``classes`` selects some, as a last stage of the cut flow. The scaler is
    fitted on all rows, or on the train rows with ``fit_on_train``."""
    names, _ = cuts.feature_columns(features)
    require_columns(df, [*IDENTITY_COLUMNS, "R9", "lead", *names], "benchmark_flow")
    steps = benchmark_steps(classes)
    if drop_incomplete:
        steps.append(stats.Cut("complete", lambda label: _complete(names)))
    if dry_run:
        return Result({"cut_flow": stats.cut_flow(df, steps, stats.BENCHMARK_CLASSES)})
    rows, flow = _pinned_steps(df, steps, [*key, *names], classes=stats.BENCHMARK_CLASSES)
    out = Result({"cut_flow": flow})
    all_rows, train_rows, test_rows = _feature_rows(rows, names, key)
    parts = train_rows.select("label", F.lit("train").alias("part")).unionByName(test_rows.select("label", F.lit("test").alias("part")))
    out.tables["rows"] = parts.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    if training is None:
        return out
    found = stats.class_list(all_rows)
    fit_on = train_rows if fit_on_train else all_rows
    train_rows, test_rows = _with_inputs(names, fit_on, train_rows, test_rows)
    net = dense_net(len(names), len(found), nodes)
    model = out.model = _train(train_rows, found, net, training, key)
    out.tables.update(_trained_tables(model))
    scored = out.tables["scored"] = pin(scoring.score(test_rows, net, model.params).drop("x"))
    entries = roc.against_rest(scored, 1, found)
    out.tables["curve"] = roc.roc_points(entries)
    out.tables["area"] = roc.auc(entries)
    return out


def benchmark_sets(
    df: DataFrame,
    key: Sequence[str],
    sets: Mapping[str, Training],
    nodes: Sequence[int] = tuple(DENSE_NODES),
    classes: Sequence[int] | None = None,
) -> Result:
    """The benchmark flow for several feature sets at once: one pin with all their
    columns, one training that feeds all nets from one scan (synchronous, with the first
    set's shards and batch), one pass that scores all test rows, one job for all areas. Each set
    trains for its own epochs, with or without early stop."""
    names = {s: cuts.feature_columns(s)[0] for s in sets}
    union = list(dict.fromkeys(c for columns in names.values() for c in columns))
    require_columns(df, [*IDENTITY_COLUMNS, "R9", "lead", *union], "benchmark_sets")
    rows, flow = _pinned_steps(df, benchmark_steps(classes), [*key, *union], classes=stats.BENCHMARK_CLASSES)
    out = Result({"cut_flow": flow})
    all_rows, train_rows, test_rows = _feature_rows(rows, union, key)
    found = stats.class_list(all_rows)
    train_rows, test_rows = _with_inputs(union, all_rows, train_rows, test_rows)
    how = next(iter(sets.values()))
    models = [
        Model(t.run, dense_net(len(names[s]), len(found), nodes), t.epochs, tuple(union.index(c) for c in names[s]), t.early_stop, t.seed)
        for s, t in sets.items()]
    fit_part, validation = sampling.fit_validation(train_rows, key)
    dealt = numbered_rows(fit_part, validation, found, how.shards, key)
    trained = fit(dealt, models, how.store, how.shards, batch_rows=how.batch_rows, resume=how.resume)
    scored, at = test_rows, sorted(found).index(1)
    for n, model in enumerate(models):
        own = F.array(*[F.col("x")[k] for k in model.columns])
        scored = scoring.score(scored.withColumn("_own", own), model.net, trained[model.run].params, "_own").withColumn(
            f"_p{n}", F.col("p")[at]).drop("_own", "p")
    scored = out.tables["scored"] = pin(scored.drop("x"))
    entries = scored.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("features"), F.col(f"_p{n}").alias("score"), (F.col("label") == 1).alias("positive"))
        for n, s in enumerate(sets)])))
    lengths = F.create_map(*[F.lit(v) for s, t in sets.items() for v in (s, trained[t.run].epochs)])
    out.tables["areas"] = roc.auc(entries, ["features"]).withColumn("epochs", lengths[F.col("features")])
    return out


def label_report(df: DataFrame) -> DataFrame:
    """Label fractions of the cleaned table in the benchmark convention."""
    return stats.summary(cuts.clean(df), stats.BENCHMARK_CLASSES, samples=False)


def by_process(df: DataFrame) -> DataFrame:
    """Label fractions of the cleaned table for each sample."""
    return stats.summary(cuts.clean(df), samples=False, by=["sample"])
