"""Configurations, identities, guards, checkpoints, queues; the model; a whole run."""

import json
import os

import numpy as np
import pytest

from loomcast import __main__ as cli
from loomcast.plans import control, experiment


def _config(**change):
    return {"source": {"path": "u.csv", "key": "a", "time": "b", "rules": []}, "out": "runs", "start": 0, "end": 600} | change


def test_configurations_are_checked(tmp_path):
    path = str(tmp_path / "c.json")
    for change, ok in (({}, True), ({"out": "/abs"}, False), ({"out": "../up"}, False), ({"end": 0}, False), ({"splits": [0.5, 0.2, 0.2]}, False), ({"what": 1}, False), ({"locked": True, "decay": 0.1}, False), ({"locked": True}, True)):
        json.dump(_config(**change), open(path, "w"))
        if ok:
            assert control.load(path)[0].out == "runs"
        else:
            with pytest.raises(control.ConfigError):
                control.load(path)


def test_folders_belong_to_one_run(tmp_path):
    a, b, folder = {"id": "a"}, {"id": "b"}, str(tmp_path / "run")
    control.bind(folder, a)
    control.bind(folder, a)
    with pytest.raises(control.ConfigError):
        control.bind(folder, b)
    with pytest.raises(control.ConfigError):
        control.bind(str(tmp_path), a)
    (tmp_path / "run" / "x").write_text("1")
    control.guard(folder, "x", a, ["x"])
    assert control.guarded(folder, "x", a) and not control.guarded(folder, "x", b) and not control.guarded(folder, "y", a)
    (tmp_path / "run" / "x").write_text("2")
    assert not control.guarded(folder, "x", a)


def test_newest_whole_checkpoint(tmp_path):
    who, folder = {"id": "a"}, str(tmp_path)
    assert control.newest_checkpoint(folder + "/none", who) is None
    for i in range(3):
        control.save_checkpoint(folder, i, bytes([i]), who)
    open(os.path.join(folder, "step-000002.npz"), "wb").write(b"torn")
    assert control.newest_checkpoint(folder, who) == b"\x01" and control.newest_checkpoint(folder, {"id": "b"}) is None


def test_queue_goes_on_where_it_stopped(tmp_path):
    ran, broken = [], {"two"}

    def work(name):
        ran.append(name)
        if name in broken:
            raise OSError("no")
        return {"x": float("nan")}

    assert not control.Tasks(str(tmp_path), ["one", "two", "three"]).run(work, control.Progress(str(tmp_path)))
    assert control.Tasks(str(tmp_path), ["one", "two", "three"]).summary() == {"pending": 0, "running": 0, "done": 2, "failed": 1}
    broken.clear()
    assert control.Tasks(str(tmp_path), ["one", "two", "three"]).run(work)
    assert ran == ["one", "two", "three", "two"] and len(open(tmp_path / "failures.jsonl").readlines()) == 1
    assert control.status(str(tmp_path))["total"] == 3 and control.canonical({"b": float("inf"), "a": 1}) == '{"a":1,"b":null}'


def _slots(spark, gap=True):
    rows = [(w, t, None if gap and (w, t) == (1, 5) else float((t + w) % 2), not (gap and (w, t) == (1, 5))) for w in range(4) for t in range(20)]
    return spark.createDataFrame(rows, "workload long, t long, cpu_input double, input_valid boolean")


def test_model_predicts_the_other_state(spark):
    dep = spark.createDataFrame([(w, w % 2) for w in range(4)], "workload long, node long")
    slots = _slots(spark)
    m = experiment.WorkloadModel(("cpu",), k=2, strength=0.0).fit(slots)
    m = experiment.WorkloadModel.restored(json.loads(json.dumps(m.record())))
    assert m.matrix[0][1] > 0.8 and m.matrix[1][0] > 0.8
    mu = {(r["workload"], r["t"]): r for r in m.transform(slots).collect()}
    assert mu[1, 5]["mu"] is None and mu[1, 5]["state"] is None and mu[0, 1]["state"] == 1
    out = {r["workload"]: r for r in m.predict_next(slots, dep, 20).collect()}
    assert len(out) == 4
    for w, r in out.items():
        assert sum(r["mu"]) == pytest.approx(1) and abs(r["cpu"] - (20 + w) % 2) < 0.35
    early = {r["workload"]: r["mu"] for r in m.predict_next(slots.where("t < 10"), dep, 10).collect()}
    assert early == {r["workload"]: r["mu"] for r in m.predict_next(slots, dep, 10).collect()}  # later slots cannot show


def test_origin_rows_equal_a_scan(spark):
    e = control.Experiment(**_config(end=1200, histories=(6,), horizons=(1, 3), splits=(0.6, 0.2, 0.2)))
    m = experiment.WorkloadModel(("cpu",), k=2).fit(_slots(spark))
    mu = m.transform(_slots(spark)).cache()
    state = {(r["workload"], r["t"]): r["state"] for r in mu.collect()}
    got = {(r["origin"], r["workload"], r["h"]): r["back"] for r in experiment.origin_rows(mu, e, 6, "train").collect()}
    for (o, w, h), back in got.items():
        c = np.zeros(2)
        for v in range(4):
            for j in range(o - 5, o - h + 1):
                a, b = state.get((v, j)), state.get((v, j + h))
                if a is not None and b is not None and a == state[w, o]:
                    c[b] += np.exp(-e.decay * (o - j - h + h))
        want = (c + 1) / (c + 1).sum() if c.any() else None
        assert (back is None) == (want is None) and (want is None or np.allclose(back, want))
    assert len(got) == sum(state.get((w, o)) is not None for w in range(4) for o in range(5, 9)) * 2


def test_whole_run_and_again(spark, tmp_path, capsys):
    assert cli.smoke(str(tmp_path), spark) == 0
    run_dir = tmp_path / "runs" / "smoke"
    plot = spark.read.option("header", True).csv(str(run_dir / "plot_data")).toPandas().astype(float)
    every = spark.read.parquet(str(run_dir / "metrics_all_tasks")).toPandas()
    assert len(plot) == len(every) > 0 and {"mcc", "kappa", "hellinger", "ece"} <= set(every.columns) and ((plot["accuracy_low"] <= plot["accuracy"] + 1e-9) & (plot["accuracy"] <= plot["accuracy_high"] + 1e-9)).all()
    m = spark.read.parquet(str(run_dir / "metrics_by_h")).toPandas()
    assert sorted(m["h"]) == [1, 3] and (m["n"] > 0).all() and np.isfinite(m[["soft_ce", "brier", "accuracy"]]).all().all()
    config, before = str(tmp_path / "experiment.json"), os.stat(run_dir / "model.json").st_mtime_ns
    assert cli.run("run-all", config, "smoke", spark=spark) == 0 and os.stat(run_dir / "model.json").st_mtime_ns == before
    assert cli.run("verify", config, "smoke", spark=spark) == 0 and control.status(str(run_dir))["state"] == "done"
    (run_dir / "model.json").write_text("{}")
    assert cli.run("verify", config, "smoke", spark=spark) == 2
    assert cli.main(["plan", "--config", config]) == 0 and cli.main(["preflight", "--config", str(tmp_path / "none.json")]) == 1
    assert cli.main(["status", "--run-dir", str(run_dir)]) == 0
    capsys.readouterr()


def test_recursive_run(spark, tmp_path, capsys):
    assert cli.smoke(str(tmp_path), spark, strategy="recursive", variant="vo_markov") == 0
    m = spark.read.parquet(str(tmp_path / "runs" / "smoke" / "metrics_by_h")).toPandas()
    assert sorted(m["h"]) == [1, 3] and np.isfinite(m["brier"]).all()
    capsys.readouterr()
