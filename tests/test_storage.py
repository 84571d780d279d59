"""Named files, publication by compare and swap, and the streaming source of manifests."""

from __future__ import annotations

import hashlib
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from subtide.sources import named_files as N
from subtide.sources import sinks
from subtide.sources.storage import safe_name


def tree(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if not p.name.endswith(".crc"))


@pytest.fixture
def shards(spark):
    rows = [(f"s{k % 5}/part-{k % 5}.jsonl", k, f'{{"n": {k}, "t": "é"}}\n') for k in range(200)] + [("one.srt", 0, "")]
    return spark.createDataFrame(rows, "file string, n int, line string").repartition(4)


def test_one_file_per_name_with_a_manifest(spark, shards, tmp_path):
    out = tmp_path / "out"
    N.write_named_files(shards, str(out), "file", "line", ["n"])
    want = {f"s{m}/part-{m}.jsonl": "".join(f'{{"n": {k}, "t": "é"}}\n' for k in range(m, 200, 5)) for m in range(5)} | {"one.srt": ""}
    assert tree(out) == sorted([*want, "_manifest.json", *{n.split("/")[0] for n in want if "/" in n}])
    assert {n: (out / n).read_text() for n in want} == want
    listed = {r["name"]: (r["size"], r["sha256"]) for r in N.manifest(spark, str(out)).collect()}
    assert listed == {n: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for n, t in want.items()}
    assert {r["name"]: r["ok"] for r in N.read_named_files(spark, str(out)).collect()} == dict.fromkeys(want, True)
    (out / "one.srt").write_text("x")
    (out / "s1/part-1.jsonl").unlink()
    assert {r["name"] for r in N.read_named_files(spark, str(out)).where("NOT ok").collect()} == {"one.srt", "s1/part-1.jsonl"}


def test_a_second_run_refuses_to_overwrite(spark, shards, tmp_path):
    N.write_named_files(shards, str(tmp_path / "out"), "file", "line", ["n"])
    before = tree(tmp_path)
    with pytest.raises(Exception, match="exists"):
        N.write_named_files(shards.limit(1), str(tmp_path / "out"), "file", "line")
    assert tree(tmp_path) == before


@pytest.mark.parametrize("fault", ["task", "size", "sum", "name", "escape"])
def test_a_crash_leaves_nothing_half_written(spark, shards, tmp_path, fault):
    late = F.when(F.col("n") == 150, F.raise_error(F.lit("crash"))).otherwise(F.col("line"))
    whole = shards.withColumn("size", F.lit(3).cast("long")).withColumn("sum", F.lit("00"))
    with pytest.raises(Exception, match={"task": "crash", "size": "bytes", "sum": "checksum", "name": "file name", "escape": "file name"}[fault]):
        if fault == "task":
            N.write_named_files(shards, str(tmp_path / "out"), "file", late, ["n"])
        elif fault in ("size", "sum"):
            N.write_named_files(whole, str(tmp_path / "out"), "file", "line", ["n"], **({"size": "size"} if fault == "size" else {"sha256": "sum"}))
        else:
            N.write_named_files(shards, str(tmp_path / "out"), F.lit("_manifest.json" if fault == "name" else "../x"), "line")
    assert tree(tmp_path) == []
    N.write_named_files(shards, str(tmp_path / "out"), "file", "line", ["n"])  # and the next run is free to go
    assert (tmp_path / "out" / "_manifest.json").exists()


def test_a_verified_cache_fill(spark, tmp_path):
    data = [("a.m4a", b"abc"), ("b/c.m4a", b"\x00\xff")]
    rows = spark.createDataFrame([(n, d, len(d), hashlib.sha256(d).hexdigest().upper()) for n, d in data], "name string, data binary, bytes long, sum string")
    N.write_named_files(rows, str(tmp_path / "cache"), "name", "data", size="bytes", sha256="sum")
    assert {r["name"]: bytes(r["data"]) for r in N.read_named_files(spark, str(tmp_path / "cache")).where("ok").collect()} == dict(data)


def test_safe_names():
    assert all(map(safe_name, ("a", "a/b.txt", ".x"))) and not any(map(safe_name, ("", "/a", "../a", "a/../b", "a//b", "a\\b", ".")))


def test_publication_notices_a_second_writer(spark, tmp_path):
    base = str(tmp_path / "store")
    first = sinks.publish(spark.range(3), base)
    seen = sinks.head(spark, base)["number"]
    second = sinks.publish(spark.range(4), base, after=seen)
    with pytest.raises(sinks.ConcurrentPublication):
        sinks.publish(spark.range(5), base, after=seen)
    assert sinks.current(spark, base).count() == 4
    assert [(e["number"], e["previous"], e["version"]) for e in sinks.history(spark, base)] == [(1, 0, first), (2, 1, second)]
    assert sorted(n for n in os.listdir(base) if n.startswith("v-")) == sorted([first, second])  # the loser's data is gone


def test_of_two_writers_at_once_one_fails(spark, tmp_path, monkeypatch):
    base, meet, results = str(tmp_path / "store"), threading.Barrier(2), []
    sinks.publish(spark.range(1), base)
    append = sinks._append

    def together(*args):
        meet.wait(60)
        append(*args)

    monkeypatch.setattr(sinks, "_append", together)

    def write(n):
        try:
            results.append((n, sinks.publish(spark.range(n), base)))
        except sinks.ConcurrentPublication as e:
            results.append((n, e))

    threads = [threading.Thread(target=write, args=(n,)) for n in (7, 9)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    won = [n for n, r in results if isinstance(r, str)]
    assert len(results) == 2 and len(won) == 1
    assert sinks.current(spark, base).count() == won[0] and sinks.head(spark, base)["number"] == 2
    assert len([n for n in os.listdir(base) if n.startswith("v-")]) == 2


def test_equal_content_is_not_published_again_and_caches_are_carried(spark, tmp_path):
    base = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, None, {"a": 1}), (2, "x", None), (2, "x", None)], "i int, s string, m map<string,int>")
    v = sinks.publish({"main": rows, "cache": spark.range(5)}, base)
    assert sinks.publish({"main": rows.orderBy(F.desc("i")).repartition(3).select("m", "s", "i"), "cache": spark.range(5)}, base) == v
    w = sinks.publish(rows.limit(2), base, carry=["cache"])
    assert w != v and sinks.current(spark, base, "cache").count() == 5 and sinks.head(spark, base)["tables"]["cache"] == f"{v}/cache"
    assert sinks.vacuum(spark, base, keep=1) == [] and sinks.current(spark, base).count() == 2
    digests = {sinks.content_digest(spark.createDataFrame([r], "a string, b string")) for r in ((None, "x"), ("x", None), ("x", "x"), ("xx", None))}
    assert len(digests) == 4
    with pytest.raises(ValueError):
        sinks.publish(spark.range(0), base, {"some": "count(*) > 0"})
    assert sinks.head(spark, base)["version"] == w and len([n for n in os.listdir(base) if n.startswith("v-")]) == 2


def manifests(spark, library, state, checkpoint, out):
    from subtide.streaming.manifests import Manifests

    spark.dataSource.register(Manifests)
    stream = spark.readStream.format("manifests").option("state", str(state)).load(str(library))
    q = stream.writeStream.format("json").option("checkpointLocation", str(checkpoint)).option("path", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_of_manifests_with_a_restart(spark, tmp_path):
    library, state, check, out = (tmp_path / n for n in ("library", "state", "check", "out"))
    put = lambda name, text: ((library / name).mkdir(parents=True, exist_ok=True), (library / name / ".media.json").write_text(text))
    read = lambda: sorted((r["path"].split("/")[0], r["change"], r["value"]) for r in spark.read.schema("path string, change string, fingerprint string, value string").json(str(out)).collect())
    for n in "abc":
        put(n, f'{{"id": "{n}"}}')
    (library / "a" / "deeper").mkdir()
    (library / "a" / "deeper" / ".media.json").write_text("no")
    (library / "a" / "other.json").write_text("no")
    manifests(spark, library, state, check, out)
    first = [(n, "added", f'{{"id": "{n}"}}') for n in "abc"]
    assert read() == first
    manifests(spark, library, state, check, out)  # nothing new
    assert read() == first
    put("a", '{"id": "a", "v": 2}')
    (library / "b" / ".media.json").unlink()
    (library / "c").rename(library / "d")  # a move gives both paths
    manifests(spark, library, state, check, out)
    assert read() == sorted([*first, ("a", "changed", '{"id": "a", "v": 2}'), ("b", "removed", None), ("c", "removed", None), ("d", "added", '{"id": "c"}')])
    offsets = [json.loads(p.read_text().splitlines()[-1]) for p in (check / "offsets").iterdir() if p.name.isdigit()]
    assert all(len(json.dumps(o)) < 200 for o in offsets)
