"""Streams that stop and go on, blobs, zstd lines, series: against plain loops."""

import glob
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import series as V
from millrace.sources import zstd_lines as Z
from millrace.streaming import extract as X
from millrace.streaming import selection as K

H = lambda s: hashlib.sha256(str(s).encode()).hexdigest()


def test_streamed_selection(spark, tmp_path):
    """Any arrival in any batches, with restarts between, gives the batch's prefix; texts that come again and targets that are never reached."""
    rnd = random.Random(2)
    rows = [(s, H((s, i % 60)), i, 10 + i % 60 % 7) for s, n in (("hot", 150), ("few", 5), ("none", 1)) for i in range(n)]
    expected = {}
    for s in ("hot", "few", "none"):
        least = {}
        for _, rank, i, t in (r for r in rows if r[0] == s):
            least[rank] = min(least.get(rank, (i, t)), (i, t))
        total = 0
        for rank in sorted(least):
            if total < 120:
                total += least[rank][1]
                expected[s, least[rank][0]] = total
    rnd.shuffle(rows)
    path, log, state = (f"file://{tmp_path}/{x}" for x in ("in", "log", "state"))
    schema = "source string, rank string, doc_id long, tokens long"
    for part in (rows[:70], rows[70:90], rows[90:]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
        K.keep_prefixes(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 120, log, state)
    got = {(r["source"], r["doc_id"]): r["running"] for r in K.kept_rows(spark.read.parquet(log), 120).collect()}
    assert got == expected
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "HDFS").find("RocksDB") < 0


def blobs(spark):
    raw = {f"b{i}": f"text number {i} ü".encode() for i in range(12)} | {"bad": b"a\xffb", "cut": "ü".encode()[:1], "blank": b" \n\x0b", "short": b"x", "gone": None}
    return raw, spark.createDataFrame(list(raw.items()), "blob_id string, raw binary")


def test_extraction_goes_on(spark, tmp_path):
    """A fetch that breaks off in the second batch: what was committed stays, the rest is done by the next run; as one run."""
    raw, remote = blobs(spark)
    asked = [[f"b{i}" for i in range(6)] + ["bad", "gone", "b0"], ["b0", "b7", "cut", "blank", "gone"], ["b8", "short", "b7", "bad"]]
    source = f"file://{tmp_path}/asked"

    def deliver(k):
        spark.createDataFrame([(x,) for x in asked[k]], "blob_id string").coalesce(1).write.mode("append").parquet(source)

    calls = []

    def fetch(ids, fail=False):
        calls.append(sorted(r["blob_id"] for r in ids.collect()))
        if fail:
            raise RuntimeError("the remote is gone")
        return ids.join(remote, "blob_id", "left")

    store, out = f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    run = lambda f: X.extract(spark, spark.readStream.schema("blob_id string").option("maxFilesPerTrigger", 1).parquet(source), f, store, out, 5, 100)
    deliver(0)
    run(fetch)
    first = sorted(map(tuple, X.extracted(spark, out).collect()), key=str)
    deliver(1)
    with pytest.raises(Exception):
        run(lambda ids: fetch(ids, True))
    assert sorted(map(tuple, X.extracted(spark, out).collect()), key=str) == first
    deliver(2)
    run(fetch)
    assert calls[0] == sorted(set(asked[0])) and calls[1] == calls[2] == sorted({"b7", "cut", "blank", "gone"}) and calls[3] == ["b8", "short"]
    got = sorted(((r["blob_id"], r["status"], r["text"], r["cached"]) for r in X.extracted(spark, out).collect()), key=str)
    expected, seen = [], set()
    for batch in asked:
        for b in batch:
            status = "fetch_failed" if raw[b] is None else {"bad": "decode_failed", "cut": "decode_failed", "blank": "empty_rejected", "short": "length_rejected"}.get(b, "kept")
            expected.append((b, status, raw[b].decode() if status == "kept" else None, b in seen))
        seen |= {b for b in batch if raw[b] is not None}
    assert got == sorted(expected, key=str)
    with pytest.raises(ValueError, match="another configuration"):
        X.extract(spark, spark.readStream.schema("blob_id string").parquet(source), fetch, store, out, 5, 99)
    # a batch that was written but not committed isn't read
    spark.createDataFrame([("x", "kept", "x", False)], X._ROWS).write.parquet(f"{out}/rows/batch=99")
    assert len(X.extracted(spark, out).collect()) == len(expected)


def test_zstd_lines(spark, tmp_path):
    """Real zstd frames; the order depends on seed and lines alone; nothing is left of a write that fails."""
    import zstandard

    texts = [f"line {i} ä  " + "x" * (i % 50) for i in range(10000)] + ["", "same", "same", None]
    frame = spark.createDataFrame([(t,) for t in texts], "value string")
    orders = []
    for k, seed in enumerate(("s", "s", "t")):
        path = f"file://{tmp_path}/z{k}"
        Z.write_zstd_lines(Z.shuffled(frame.repartition(2 + k), "value", seed, 3), path)
        rows = Z.read_zstd_lines(spark, path).collect()
        orders.append([r["value"] for r in sorted(rows, key=lambda r: (r["file"], r["line"]))])
    assert sorted(orders[0]) == sorted(t for t in texts if t is not None)
    assert orders[0] == orders[1] != orders[2]
    assert orders[0] == sorted(orders[0], key=lambda t: H(f"s\x1f{t}"))
    (first, *_) = sorted(glob.glob(f"{tmp_path}/z0/*.zst"))
    with open(first, "rb") as raw:
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read().decode()
    assert plain.split("\n")[0] == orders[0][0]
    with pytest.raises(Exception, match="exists"):
        Z.write_zstd_lines(frame, f"file://{tmp_path}/z0")
    broken = spark.range(100).select(F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("value")).repartition(3)
    with pytest.raises(Exception):
        Z.write_zstd_lines(broken, f"file://{tmp_path}/broken")
    assert not glob.glob(f"{tmp_path}/broken/*.zst") and not glob.glob(f"{tmp_path}/broken/_SUCCESS")


@pytest.mark.parametrize("fan", [2, 3, 512])
def test_moving_average(spark, fan):
    rnd = random.Random(fan)
    rows = [(k, step, rnd.random(), t) for k, n in (("a", 70), ("b", 1), ("c", 9)) for t, step in enumerate(sorted(rnd.choices(range(200), k=n)))]
    rows += [("a", 5, None, 99), ("d", 1, None, 0)]
    frame = spark.createDataFrame(rows, "k string, step long, value double, t int").repartition(4)
    got = {}
    for r in V.moving_average(frame, ["k"], "step", "value", 0.9, "t", fan).collect():
        got.setdefault(r["k"], []).append((r["step"], r["value"], r["ema"]))
    assert set(got) == {"a", "b", "c"}
    for k, series in got.items():
        own = sorted((s, t, v) for key, s, v, t in rows if key == k and v is not None)
        acc, expected = None, []
        for s, _, v in own:
            acc = v if acc is None else 0.9 * acc + 0.1 * v
            expected.append((s, v, acc))
        assert [x[:2] for x in sorted(series)] == sorted(x[:2] for x in expected)
        assert all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(sorted(series), sorted(expected)))
    assert V.moving_average(frame.limit(0), ["k"], "step", "value").collect() == []


def test_metric_rows_and_comparison(spark):
    lines = ['{"kind": "train", "step": 1, "loss": 2, "lr": 0.5, "note": "x", "ok": true, "time": 3.5, "gone": null}', '{"step": 2, "val_loss": 1.5}', '{"step": 2, "loss": 1.25, "time": 1}', '{"kind": "train", "loss": 1}', "broken {", "[1]", "", '{"step": "7", "loss": 1}']
    rows = V.metric_rows(spark.createDataFrame([("r", x) for x in lines], "run string, value string"))
    assert {(r["kind"], r["step"], r["field"], r["value"]) for r in rows.where("step < 7").collect()} == {("train", 1, "loss", 2.0), ("train", 1, "lr", 0.5), ("val", 2, "val_loss", 1.5), ("train", 2, "loss", 1.25)}
    log = [("long", json.dumps({"kind": "val", "step": i, "loss": float(i)})) for i in range(201)] + [("long", '{"kind": "train", "step": 1, "loss": 9}'), ("two", '{"kind": "a", "step": 1, "loss": 4}'), ("two", '{"kind": "b", "step": 1, "loss": 5}')]
    curves = V.compare_runs(V.metric_rows(spark.createDataFrame(log, "run string, value string"))).collect()
    by = {(r["label"], r["step"]): r["shown"] for r in curves}
    assert len(curves) == 203 and by["two/a", 1] == 4.0 and by["two/b", 1] == 5.0
    acc = 0.0
    for i in range(1, 201):
        acc = 0.9 * acc + 0.1 * i
    assert abs(by["long", 200] - acc) < 1e-9
