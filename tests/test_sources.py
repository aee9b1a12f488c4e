"""Raw traces: lookup, archives, headers, exact export, capture in parts, dense bundles."""

import json
import os
import tarfile

import numpy as np
import pytest

from loomcast.operators import metrics
from loomcast.sources import archives

LINES = [b"c2,m1,5,1.50\r\n", b"c1,m1,1,\xff\xfe\n", b"\n", b"c3,m2,9,x\n", b"c1,m1,2, 7 \n", b"c2,m1,6,0\n"]


@pytest.fixture
def trace(tmp_path):
    path = tmp_path / "raw" / "usage.csv"
    path.parent.mkdir()
    path.write_bytes(b"".join(LINES))
    return str(path)


def test_lookup_and_archives(tmp_path, trace):
    assert archives.find_table(os.path.dirname(trace), "usage") == trace
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        tar.add(trace, "../deep/usage.csv")
    out = archives.unpacked_member(archives.find_table(str(tmp_path), "x"), str(tmp_path / "out"))
    assert out == str(tmp_path / "out" / "usage.csv") and open(out, "rb").read() == b"".join(LINES)
    with pytest.raises(FileNotFoundError):
        archives.find_table(str(tmp_path), "none")


def test_header_or_places(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,at,v\nc1,1,2\n")
    (tmp_path / "b.csv").write_text("c1,1,2\nc2,2\n")
    a = archives.read_trace(spark, str(tmp_path / "a.csv"), ["x", "y", "z"], ("id", "at"))
    b = archives.read_trace(spark, str(tmp_path / "b.csv"), ["id", "at", "v"], ("id", "at"))
    assert [tuple(r) for r in a.collect()] == [("c1", "1", "2")]
    assert sorted((tuple(r) for r in b.collect()), key=str) == [("c1", "1", "2"), ("c2", "2", None)]


def _bytes(folder):
    return b"".join(open(os.path.join(folder, n), "rb").read() for n in sorted(os.listdir(folder)) if n.startswith("part-"))


def test_export_is_exact(spark, tmp_path, trace):
    chosen = spark.createDataFrame([("c1",), ("c2",)], "workload string")
    archives.export_raw(spark, trace, chosen, str(tmp_path / "out"))
    assert _bytes(tmp_path / "out" / "all") == b"".join(x for x in LINES if x[:2] in (b"c1", b"c2"))
    for c in ("c1", "c2"):
        assert _bytes(tmp_path / "out" / "by_workload" / f"workload={c}") == b"".join(x for x in LINES if x.startswith(c.encode()))
    assert sorted(r[0] for r in archives.first_cells(spark, trace, "c3").collect()) == ["c1", "c2"]


def test_capture_takes_each_file_once(spark, tmp_path, trace):
    chosen = spark.createDataFrame([("c2",)], "workload string")
    args = (spark, os.path.dirname(trace), chosen, str(tmp_path / "out"), str(tmp_path / "log"))
    for more in (b"", b"c2,m1,7,0\n"):
        if more:
            open(os.path.join(os.path.dirname(trace), "more.csv"), "wb").write(more)
        archives.capture(*args)
        archives.capture(*args)
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c2,m1,5,1.50\r", "c2,m1,6,0", "c2,m1,7,0"]


def test_dense_bundle(spark, tmp_path):
    path = str(tmp_path / "x.npz")
    v = np.array([[[0.5], [np.nan], [2.0]]])
    good = dict(workload_ids=np.array(["a"]), time_seconds=np.array([0, 60, 120]), resource_names=np.array(["cpu"]), observed_values=v, target_observed_mask=~np.isnan(v[..., 0]))
    archives.write_npz(path, **good)
    assert [tuple(r) for r in archives.read_dense(spark, path).orderBy("t").collect()] == [("a", 0, 0.5, True), ("a", 60, None, False), ("a", 120, 2.0, True)]
    with pytest.raises(TypeError):
        archives.write_npz(path, x=np.array([{}], dtype=object))
    for change in ({"time_seconds": np.array([0, 60, 130])}, {"time_seconds": np.array([0, 60])}):
        archives.write_npz(path, **(good | change))
        with pytest.raises(ValueError):
            archives.read_dense(spark, path)


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1 / 3), ("a", 1e12), ("c", None)], "k string, v double")
    archives.write_numbers(df, str(tmp_path / "n"), ["k"])
    assert _bytes(tmp_path / "n").replace(b"k,v\n", b"") == b"a,1e+12\nb,0.3333333333\nc,\n" 
    archives.write_predictions(spark.createDataFrame([(1, float("nan"))], "h int, p double"), str(tmp_path / "p.json"))
    assert json.load(open(tmp_path / "p.json")) == [{"h": 1, "p": None}]


def test_collected_runs(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    both = archives.union_all({"one": a, "two": b})
    assert sorted(both.columns) == ["run", "x", "y"]
    assert {r["run"]: (r["n_rows"], r["complete"]) for r in archives.completeness(both, ["one", "two", "three"]).collect()} == {"one": (1, True), "two": (1, True), "three": (0, False)}


def test_edges_and_flat_results(spark):
    df = spark.createDataFrame([(x / 10, x > 4) for x in (1, 1, 1, 5, 9, 10)], "c double, hit boolean")
    assert metrics.bin_edges(df, "c", 4) == [0, 0.25, 0.5, 0.75, 1.0]
    edges = metrics.bin_edges(df, "c", 3, "quantile")
    assert edges[0] == 0 and edges[-1] == 1 and edges == sorted(set(edges))
    assert sum(r["n"] for r in metrics.edge_bins(df, "c", "hit", edges).collect()) == 6
    assert metrics.flatten({"a": {"b": 1.0, "c": [1]}, "d": None}) == {"a.b": 1.0, "d": None}
