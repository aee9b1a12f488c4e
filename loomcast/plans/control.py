"""Runs of experiments: checked configurations, identities, guarded artifacts, checkpoints, progress and task queues."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import platform
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

from ..sources.tables import json_safe, write_json
from ..sources.usage import ResourceRule, SourceSpec

#: Fixed values of a standard experiment; a configuration that says locked must have them.
LOCKED = {"order": 3, "decay": 0.02, "rounds": 2, "step": 60, "splits": (0.6, 0.2, 0.2), "strength": 0.5, "blend": 0.5, "fill": 3, "min_coverage": 0.8}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Experiment:
    """What a run computes. Paths are relative to the configuration's folder."""

    source: dict
    out: str
    start: int
    end: int
    step: int = 60
    splits: tuple = (0.6, 0.2, 0.2)
    histories: tuple = (5,)
    horizons: tuple = (1,)
    stride: int = 1
    workloads: int = 200
    k: int = 8
    order: int = 3
    decay: float = 0.02
    rounds: int = 2
    strength: float = 0.5
    blend: float = 0.5
    fill: int = 3
    min_coverage: float = 0.8
    period: int = 1440
    epochs: int = 5
    rate: float = 0.02
    seed: int = 7
    variant: str = "full"
    strategy: str = "direct"
    locked: bool = False

    def check(self) -> Experiment:
        wrong = [f"{k} must be {v}" for k, v in LOCKED.items() if self.locked and getattr(self, k) != v]
        for name, path in (("out", self.out), ("source.path", self.source.get("path", ""))):
            if not path or os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
                wrong.append(f"{name} must be a relative path below the configuration")
        if self.end <= self.start or self.step < 1:
            wrong.append("the time axis is empty")
        if abs(sum(self.splits) - 1) > 1e-9 or len(self.splits) != 3 or min(self.splits) <= 0:
            wrong.append("splits must be three shares that sum to 1")
        if not self.histories or not self.horizons or min(*self.histories, *self.horizons) < 1:
            wrong.append("histories and horizons must be positive")
        if self.strategy not in ("direct", "recursive"):
            wrong.append("strategy must be direct or recursive")
        if self.k < 2 or self.workloads < 1 or not 0 <= self.blend <= 1:
            wrong.append("k, workloads or blend out of range")
        if wrong:
            raise ConfigError("; ".join(wrong))
        return self

    def spec(self, base: str) -> SourceSpec:
        s = dict(self.source)
        rules = tuple(ResourceRule(**r) for r in s.pop("rules"))
        return SourceSpec(**(s | {"path": os.path.join(base, s["path"]), "rules": rules, "columns": tuple(s.get("columns", ()))}))


def load(path: str) -> tuple[Experiment, str]:
    """(configuration, its folder); unknown or missing keys are errors."""
    with open(path) as f:
        raw = json.load(f)
    unknown = sorted(set(raw) - {f.name for f in fields(Experiment)})
    if unknown:
        raise ConfigError(f"unknown keys: {unknown}")
    try:
        e = Experiment(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    except TypeError as x:
        raise ConfigError(str(x)) from x
    return e.check(), os.path.dirname(os.path.abspath(path))


def canonical(x) -> str:
    return json.dumps(json_safe(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def digest(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else canonical(x).encode()).hexdigest()


def file_digest(path: str) -> str:
    """Of a file, or of all files below a folder with their names."""
    if os.path.isdir(path):
        names = sorted(os.path.relpath(os.path.join(d, n), path) for d, _, ns in os.walk(path) for n in ns if not n.startswith((".", "_")))
        return digest([[n, file_digest(os.path.join(path, n))] for n in names])
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def code_digest() -> str:
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    names = sorted(os.path.join(d, n) for d, _, ns in os.walk(top) for n in ns if n.endswith(".py") and os.path.basename(d) != "llm")
    return digest([[os.path.relpath(n, top), file_digest(n)] for n in names])


def identity(e: Experiment, data: str) -> dict:
    parts = {"config": digest(asdict(e)), "data": data, "code": code_digest()}
    return parts | {"id": digest(parts)[:16]}


def read_json(path: str):
    with open(path) as f:
        return json.load(f)


def bind(run_dir: str, who: dict) -> None:
    """Makes the folder this run's: another run's folder, or a filled one of nobody, is refused."""
    mark = os.path.join(run_dir, "identity.json")
    os.makedirs(run_dir, exist_ok=True)
    if os.path.exists(mark):
        theirs = read_json(mark)
        if theirs != who:
            raise ConfigError(f"{run_dir} belongs to another run: {sorted(k for k in who if theirs.get(k) != who[k])} differ")
    elif os.listdir(run_dir):
        raise ConfigError(f"{run_dir} is not empty and has no identity")
    else:
        write_json(who, mark)


def guard(run_dir: str, name: str, who: dict, paths: list[str]) -> None:
    """Records an artifact's files, to be called when they are complete."""
    os.makedirs(os.path.join(run_dir, "guards"), exist_ok=True)
    write_json({"run": who["id"], "files": {p: file_digest(os.path.join(run_dir, p)) for p in paths}}, os.path.join(run_dir, "guards", f"{name}.json"))


def guarded(run_dir: str, name: str, who: dict) -> bool:
    """Whether an artifact of this run is there and its files are unchanged."""
    path = os.path.join(run_dir, "guards", f"{name}.json")
    if not os.path.exists(path):
        return False
    g = read_json(path)
    return g["run"] == who["id"] and all(os.path.exists(os.path.join(run_dir, p)) and file_digest(os.path.join(run_dir, p)) == h for p, h in g["files"].items())


def save_checkpoint(folder: str, step: int, data: bytes, who: dict) -> str:
    """The bytes first, then their record: a checkpoint without a record does not exist."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"step-{step:06d}.npz")
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    write_json({"run": who["id"], "step": step, "sha256": digest(data)}, path[:-4] + ".json")
    return path


def newest_checkpoint(folder: str, who: dict) -> bytes | None:
    """The latest checkpoint of this run whose bytes are what its record says."""
    records = sorted((n for n in os.listdir(folder) if n.endswith(".json")), reverse=True) if os.path.isdir(folder) else []
    for name in records:
        r, path = read_json(os.path.join(folder, name)), os.path.join(folder, name[:-5] + ".npz")
        if r["run"] == who["id"] and os.path.exists(path):
            with open(path, "rb") as f:
                data = f.read()
            if digest(data) == r["sha256"]:
                return data
    return None


@contextlib.contextmanager
def locked(path: str) -> Iterator[None]:
    with open(path, "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


class Progress:
    """status.json, events.jsonl and failures.jsonl of a run; several processes may write."""

    def __init__(self, run_dir: str, total: int = 0):
        self.dir, self.began, self.total = run_dir, time.time(), total
        os.makedirs(run_dir, exist_ok=True)

    def _append(self, name: str, row: dict) -> None:
        with locked(os.path.join(self.dir, ".lock")), open(os.path.join(self.dir, name), "a") as f:
            f.write(canonical(row) + "\n")

    def update(self, stage: str, done: int = 0, total: int | None = None, state: str = "running", **more) -> dict:
        total = self.total if total is None else total
        spent = time.time() - self.began
        left = spent / done * (total - done) if 0 < done <= total else None
        row = {"stage": stage, "state": state, "done": done, "total": total, "elapsed_seconds": spent, "eta_seconds": left, "at": time.time(), **more}
        self._append("events.jsonl", row)
        with locked(os.path.join(self.dir, ".lock")):
            write_json(row, os.path.join(self.dir, "status.json"))
        return row

    def failed(self, stage: str, error: BaseException) -> None:
        row = {"stage": stage, "error": type(error).__name__, "message": str(error)[:2000], "at": time.time()}
        self._append("failures.jsonl", row)
        self.update(stage, state="failed", message=row["message"])


def status(run_dir: str) -> dict | None:
    path = os.path.join(run_dir, "status.json")
    return read_json(path) if os.path.exists(path) else None


class Tasks:
    """A queue of named tasks whose states outlive the process. A task found running belongs to a stopped process and is pending again."""

    def __init__(self, run_dir: str, names: list[str]):
        self.path = os.path.join(run_dir, "tasks.json")
        known = read_json(self.path) if os.path.exists(self.path) else {}
        self.state = {n: known.get(n, {"state": "pending", "tries": 0}) for n in names}
        for s in self.state.values():
            if s["state"] == "running":
                s["state"] = "pending"
        self._save()

    def _save(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        write_json(self.state, self.path)

    def _set(self, name: str, **change) -> None:
        self.state[name] = self.state[name] | change
        self._save()

    def run(self, work, progress: Progress | None = None) -> bool:
        """Runs what is not done; a failure is recorded and the others go on. True if all are done."""
        for i, name in enumerate(self.state):
            if self.state[name]["state"] != "done":
                self._set(name, state="running", tries=self.state[name]["tries"] + 1)
                try:
                    self._set(name, state="done", result=json_safe(work(name)), error=None)
                except Exception as e:  # recorded; the caller sees False
                    self._set(name, state="failed", error=f"{type(e).__name__}: {e}"[:2000])
                    if progress:
                        progress.failed(name, e)
            if progress:
                progress.update(name, i + 1, len(self.state))
        return self.summary()["done"] == len(self.state)

    def summary(self) -> dict:
        return {s: sum(x["state"] == s for x in self.state.values()) for s in ("pending", "running", "done", "failed")}


def environment() -> dict:
    import numpy
    import pyspark

    return {"python": sys.version.split()[0], "platform": platform.platform(), "cpus": os.cpu_count(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}
