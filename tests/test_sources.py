"""Ingest: headers, missing texts, types, appended columns, lineage, pushdown, runs."""

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from halosift.operators import cuts
from halosift.sources import tables
from halosift.sources.catalogue import MISSING_TEXTS, column_kind, require_columns
from halosift.sources import runs
from halosift.sources.runs import RunStore, best_checkpoint, improved_epochs, metric_row, params_row, state_row


def write(path, text):
    path.write_text(text)
    return str(path)


def test_columns_are_matched_by_name(spark, tmp_path):
    a = write(tmp_path / "a.csv", "sample,event,label,R9\nMETPD,1,2,0.5\n")
    b = write(tmp_path / "b.csv", "label,sample,event\n3,EGamma,7\n")
    c = write(tmp_path / "c.csv", "sample,event,label,R9\nMETPD,2,1.0,-999\n")
    df = tables.read_csv(spark, [a, b, c], with_source=True)
    rows = {r["event"]: r for r in df.collect()}
    assert rows[1]["R9"] == 0.5 and rows[7]["R9"] is None and rows[2]["R9"] == -999.0
    assert (rows[7]["sample"], rows[7]["label"]) == ("EGamma", 3)
    assert rows[2]["label"] == 1
    assert rows[7]["source_file"].endswith("b.csv")
    assert dict(df.dtypes)["event"] == "bigint" and dict(df.dtypes)["R9"] == "double"


def test_missing_texts_become_null(spark, tmp_path):
    lines = "\n".join(f"{t},{t},{t}" for t in MISSING_TEXTS)
    path = write(tmp_path / "m.csv", f"sample,label,energy\n{lines}\nMETPD,1,2.5\nNAN,x,inf\n")
    rows = tables.read_csv(spark, path, bad="null").collect()
    assert len(rows) == len(MISSING_TEXTS) + 2
    known = [r for r in rows if r["sample"] is not None]
    assert [tuple(r) for r in known] == [("METPD", 1, 2.5), ("NAN", None, float("inf"))]


def test_sample_header(spark, tmp_path):
    """The header of the published sample table: capital Event, no sample column."""
    header = "Event,subcl,eta_center,phi_center,time_center,eta_sig,phi_sig,etaphi_cov,timeeta_cov,energy,sw+,label"
    path = write(tmp_path / "s.csv", header + "\n18,0,-0.2,0.3,0.1,0.02,0.01,-0.05,-0.2,59.6,0.4,1\n")
    df = tables.read_csv(spark, path)
    assert df.select("event").first()[0] == 18
    assert dict(df.dtypes)["sw+"] == "double" and dict(df.dtypes)["time_center"] == "double"
    with pytest.raises(ValueError, match="sample"):
        cuts.clean(df)
    with pytest.raises(ValueError, match="sample, object"):
        cuts.single_subcluster_only(df)


def test_files_of_a_folder_may_differ_in_their_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "sample,event\nMETPD,1\n")
    write(folder / "b.csv", "event,sample\n1,METPD\n")
    write(folder / "c.csv", "sample,extra\nGJets,7.5\n")
    for path in (str(folder), f"{folder}/*.csv"):
        got = {tuple(r) for r in tables.read_csv(spark, path).select("sample", "event", "extra").collect()}
        assert got == {("METPD", 1, None), ("GJets", None, 7.5)}


@pytest.mark.parametrize("line, said", [("METPD,abc", "event holds no whole"), ("METPD,1,9", "more or fewer"), ("METPD", "more or fewer")])
def test_bad_lines_fail_the_read(spark, tmp_path, line, said):
    path = write(tmp_path / "bad.csv", f"sample,event\nMETPD,1\n{line}\n")
    with pytest.raises(Exception, match=said):
        tables.read_csv(spark, path).collect()
    assert tables.read_csv(spark, path, bad="null").count() == 2
    with pytest.raises(ValueError, match="raise"):
        tables.read_csv(spark, path, bad="ignore")


def test_kinds_of_unknown_columns_are_found_over_all_rows(spark, tmp_path):
    a = write(tmp_path / "a.csv", "event,w,r,t,none,mixed\n1,5,1,x,NA,1\n2,NA,2.5,7,NA,2\n")
    b = write(tmp_path / "b.csv", "event,mixed\n3,late\n")
    kinds = dict(tables.read_csv(spark, [a, b]).dtypes)
    assert [kinds[c] for c in ("w", "r", "t", "none", "mixed")] == ["bigint", "double", "string", "double", "string"]
    assert dict(tables.read_csv(spark, [a, b], kinds={"w": "text"}).dtypes)["w"] == "string"


def test_datasets(spark, tmp_path):
    a = write(tmp_path / "sig.csv", "sample,event\nGMSB,1\n")
    b = write(tmp_path / "dat.csv", "sample,event\nMETPD,2\n")
    df = tables.read_datasets(spark, {"signal": [a], "data": [b]})
    assert {(r["dataset"], r["event"]) for r in df.collect()} == {("signal", 1), ("data", 2)}


def test_landed_cuts_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame(
        [("METPD", 1, 0, 1, 0.5), ("EGamma", 2, 0, -1, float("nan"))],
        "sample string, event bigint, subcl bigint, label bigint, R9 double",
    )
    tables.land(tables.nan_to_null(df), str(tmp_path / "t"))
    back = tables.read_parquet(spark, str(tmp_path / "t"))
    assert back.filter("R9 is null").count() == 1
    kept = cuts.drop_sentinel(cuts.split_leading(cuts.drop_unmatched(back))[0]).select("event")
    plan = kept.filter("sample = 'METPD'")._jdf.queryExecution().executedPlan().toString()
    for text in ("EqualNullSafe(label,-1)", "EqualNullSafe(subcl,0)", "EqualNullSafe(R9,-999.0)"):
        assert text in plan
    assert "PartitionFilters: [isnotnull(sample" in plan
    assert kept.count() == 1


def test_column_kinds():
    assert column_kind("CNNgrid_E_cell-3_0") == "real"
    assert column_kind("Event") == "whole" and column_kind("sample") == "text"
    assert column_kind("something_else") is None


def test_require_columns_ignores_case(spark):
    df = spark.createDataFrame([(1,)], "Event int")
    require_columns(df, ["event"], "x")
    with pytest.raises(ValueError, match="label"):
        require_columns(df, ["event", "label"], "x")


def test_best_checkpoint_compares_numbers(spark):
    df = spark.createDataFrame(
        [("r", 1, 10.0, [0.0]), ("r", 2, 9.0, [1.0]), ("r", 3, 9.0, [2.0])],
        "run string, epoch int, val_loss double, params array<double>",
    )
    assert best_checkpoint(df).first()["epoch"] == 2
    assert best_checkpoint(df, per_run=True).first()["params"] == [1.0]


def test_improved_epochs_start_below_threshold(spark):
    df = spark.createDataFrame(
        [("r", 1, 1500.0), ("r", 2, 1000.0), ("r", 3, 5.0), ("r", 4, 5.0), ("r", 5, 4.0)],
        "run string, epoch int, val_loss double",
    )
    assert [r["epoch"] for r in improved_epochs(df).orderBy("epoch").collect()] == [3, 5]


def test_starting_a_run_clears_that_run_only(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    for run in ("a", "b"):
        store.start(run)
        store.save_checkpoint(run, 1, 0.5, [1.0, 2.0])
        store.save_history([(run, 1, "loss", 0.4, 0.5)])
    store.start("a")
    assert store.checkpoints("a").count() == 0 and store.history("a").count() == 0
    assert store.checkpoints("b").first()["params"] == [1.0, 2.0]


def test_headers_of_many_files_take_as_many_jobs_as_those_of_few(spark, tmp_path):
    """500 files of two layouts: jobs do not depend on the number of files."""
    jobs = {}
    for n in (80, 500):  # from 33 paths on Spark lists them in a job for each scan
        folder = tmp_path / str(n)
        folder.mkdir()
        for k in range(n):
            write(folder / f"f{k:03}.csv", f"sample,event\nMETPD,{k}\n" if k % 2 else f"event,sample,label\n{k},EGamma,3\n")
        spark.sparkContext.setJobGroup(f"headers{n}", "read")
        df = tables.read_csv(spark, str(folder))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers{n}"))
        spark.sparkContext.setJobGroup("", "")
        rows = df.collect()
        assert sorted(r["event"] for r in rows) == list(range(n))
        assert all((r["label"] == 3) == (r["event"] % 2 == 0) for r in rows)
    assert jobs[80] == jobs[500] <= 6


def test_header_lines_and_file_names_of_all_kinds(spark, tmp_path):
    a = write(tmp_path / "a b[1].csv", "\n  \nsample,event\nMETPD,1\n")
    b = write(tmp_path / "c%20{d}.csv", '"sample","event"\nGJets,2')
    write(tmp_path / "empty.csv", "")
    c = write(tmp_path / "only.csv", "event,sample,extra\n")
    layouts = tables.file_layouts(spark, [str(tmp_path)])
    assert {k: len(v) for k, v in layouts.items()} == {("sample", "event"): 2, ("event", "sample", "extra"): 1}
    got = {tuple(r) for r in tables.read_csv(spark, str(tmp_path)).select("sample", "event").collect()}
    assert got == {("METPD", 1), ("GJets", 2)}
    assert tables.file_layouts(spark, []) == {}


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path, monkeypatch):
    """A first part of a file has as many lines as fit in a block: no aggregate by file may sort them, or keep them."""
    (tmp_path / "h").mkdir()
    for n in range(3):
        write(tmp_path / "h" / f"{n}.csv", "\n\nsample,event\n" + "METPD,1\n" * 25000)
    monkeypatch.setattr(DataFrame, "groupBy", lambda *a: pytest.fail("lines are aggregated"))
    layouts = tables.file_layouts(spark, [str(tmp_path / "h" / "[02].csv"), str(tmp_path / "h")])
    files = layouts.pop(("sample", "event"))
    assert [f.rpartition("/")[2] for f in files] == ["0.csv", "2.csv", "1.csv"] and not layouts


def test_too_many_headers_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LAYOUTS_AT_MOST", 2)
    for k in range(3):
        write(tmp_path / f"{k}.csv", f"c{k}\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        tables.read_csv(spark, str(tmp_path))


# --- the log of a run ------------------------------------------------------------------


def epoch_rows(epoch):
    return [metric_row(epoch, "loss", 1 / epoch, 2 / epoch), params_row(epoch, 2 / epoch, [float(epoch)] * 3),
            state_row(epoch, 2 / epoch, 3.0, 2 / epoch, [float(epoch), 0.5])]


def holds(store, run, epochs):
    assert sorted(r["epoch"] for r in store.history(run).collect()) == list(range(1, epochs + 1))
    assert sorted((r["epoch"], r["params"][0]) for r in store.checkpoints(run).collect()) == [(e, float(e)) for e in range(1, epochs + 1)]
    assert store.state(run) == {"epoch": epochs, "best": 2 / epochs, "stop_best": 3.0, "val_loss": 2 / epochs, "vector": [float(epochs), 0.5]}


def test_a_run_has_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_AFTER", 5)
    store, most = RunStore(spark, str(tmp_path / "runs")), 0
    store.start("a")
    for epoch in range(1, 24):
        store.append("a", epoch_rows(epoch))
        most = max(most, store.files("a"))
        if epoch == 12:
            store = RunStore(spark, str(tmp_path / "runs"))  # a new session goes on
    holds(store, "a", 23)
    assert most <= 7
    assert store.states("a").count() <= 5


def test_a_crash_between_two_writes_loses_nothing(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "runs"))
    store.start("a")
    for epoch in (1, 2, 3):
        store.append("a", epoch_rows(epoch))
    # while the next generation is written: its folder has data and no mark of success
    half = tmp_path / "runs" / "a" / "log-000001"
    half.mkdir()
    (half / "part-00000-x.parquet").write_bytes(b"cut off")
    holds(RunStore(spark, str(tmp_path / "runs")), "a", 3)
    # after it was written, before the old one is deleted
    with monkeypatch.context() as m:
        m.setattr(RunStore, "_delete", lambda self, path: None)
        store.compact("a")
    assert store._generations("a") == [0, 1]
    again = RunStore(spark, str(tmp_path / "runs"))
    holds(again, "a", 3)
    again.append("a", epoch_rows(4))
    holds(again, "a", 4)
    again.compact("a")
    assert again._generations("a") == [2] and again.files("a") == 1
    holds(again, "a", 4)


def test_an_epoch_that_failed_to_be_saved_is_repeated_once(spark, tmp_path, monkeypatch):
    """History and state cannot part: after the failure both end at the epoch before."""
    store = RunStore(spark, str(tmp_path / "runs"))
    store.start("a")
    store.append("a", epoch_rows(1))
    with pytest.raises(Exception):
        store.append("a", [*epoch_rows(2), (2, "state", None, None, 0.1, 0.1, 0.1, ["no number"])])
    holds(store, "a", 1)
    store.append("a", epoch_rows(2))
    holds(store, "a", 2)


def test_a_run_that_is_not_there(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.state("none") is None and store.files("none") == 0
    with pytest.raises(ValueError, match="no run"):
        store.history("none")
