"""python -m loomcast VERB --config FILE [--run-id NAME]. Exit 0: done, 1: error, 2: a report is not in order, 130: interrupted."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile

from .plans import control, experiment
from .sources import usage

STAGES = ["prepare", "train", "evaluate", "aggregate"]


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def show(x) -> None:
    print(json.dumps(control.json_safe(x), indent=1, sort_keys=True))


def run(verb: str, config: str, run_id: str | None = None, variant: str | None = None, spark=None) -> int:
    e, base = control.load(config)
    if variant:
        e = control.Experiment(**(e.__dict__ | {"variant": variant})).check()
    if verb == "plan":
        show({"tasks": experiment.task_names(e), "splits": experiment.split_bounds(e), "variant": e.variant})
        return 0
    spark = spark or session()
    report = usage.preflight(spark, e.spec(base))
    if verb == "preflight" or not report["ok"]:
        show(report)
        return 0 if report["ok"] else 2
    who = control.identity(e, control.file_digest(e.spec(base).path))
    run_dir = os.path.join(base, e.out, run_id or who["id"])
    control.bind(run_dir, who)
    progress = control.Progress(run_dir, len(STAGES))
    if verb in ("verify", "summarize"):
        state = {s: control.guarded(run_dir, s, who) for s in STAGES}
        show({"artifacts": state, "tasks": control.Tasks(run_dir, experiment.task_names(e)).summary()})
        return 0 if verb == "summarize" or all(state.values()) else 2
    for i, stage in enumerate(STAGES if verb == "run-all" else [verb]):
        if verb == "run-all" and control.guarded(run_dir, stage, who):
            continue
        progress.update(stage, i)
        try:
            if stage == "prepare":
                experiment.prepare(spark, e, base, run_dir)
                made = ["slots", "deployment", "prepared.json"]
            elif stage == "train":
                if not experiment.train(spark, e, run_dir, who):
                    raise RuntimeError("not all tasks are done; see tasks.json")
                made = ["model.json", *(f"trained-{t}.json" for t in experiment.task_names(e))]
            elif stage == "evaluate":
                experiment.evaluate(spark, e, run_dir)
                made = ["forecasts", "metrics_by_h"]
            else:
                experiment.aggregate(spark, run_dir)
                made = ["horizon_degradation", "metrics_all_h"]
        except BaseException as x:
            progress.failed(stage, x)
            raise
        control.guard(run_dir, stage, who, made)
    progress.update(verb, len(STAGES), state="done")
    show({"run_dir": run_dir, "identity": who})
    return 0


def smoke(folder: str | None = None, spark=None, **change) -> int:
    """A whole run on a small made-up trace."""
    import math

    top = folder or tempfile.mkdtemp(prefix="loomcast-smoke-")
    with open(os.path.join(top, "usage.csv"), "w") as f:
        for w in range(6):
            for t in range(80):
                if (w + t) % 17:
                    f.write(f"c{w},m{w % 2},{t * 60},{50 + 40 * math.sin(t / 3 + w)},{30 + 10 * (t // 14 % 3)}\n")
    rules = [{"name": "cpu", "column": "cpu", "scale": 0.01, "valid_min": 0}, {"name": "mem", "column": "mem", "scale": 0.01, "valid_min": 0}]
    source = {"path": "usage.csv", "key": "id", "time": "at", "node": "machine", "fmt": "csv", "header": False, "columns": ["id", "machine", "at", "cpu", "mem"], "rules": rules}
    with open(os.path.join(top, "experiment.json"), "w") as f:
        json.dump({"source": source, "out": "runs", "start": 0, "end": 4800, "histories": [6], "horizons": [1, 3], "stride": 2, "k": 3, "epochs": 2, "period": 20} | change, f)
    code = run("run-all", os.path.join(top, "experiment.json"), "smoke", spark=spark)
    if folder is None:
        shutil.rmtree(top)
    return code


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomcast", description=__doc__)
    p.add_argument("verb", choices=["preflight", "plan", *STAGES, "run-all", "verify", "summarize", "status", "smoke-test"])
    p.add_argument("--config")
    p.add_argument("--run-id")
    p.add_argument("--run-dir")
    p.add_argument("--variant")
    a = p.parse_args(args)
    try:
        if a.verb == "smoke-test":
            return smoke()
        if a.verb == "status":
            found = control.status(a.run_dir or "")
            show(found)
            return 0 if found else 2
        if not a.config:
            p.error("--config is needed")
        return run(a.verb, a.config, a.run_id, a.variant)
    except KeyboardInterrupt:
        return 130
    except Exception as x:
        print(f"{type(x).__name__}: {x}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
