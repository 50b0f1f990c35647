"""Python data sources and runs with deadlines."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from vellum.sinks import versions
from vellum.sources import ranges
from vellum.storage import new_path
from vellum.streaming import runs


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 64)
    monkeypatch.setattr(ranges, "BLOCKS", 2)


def vectors(spark, n=40):
    rows = [(m, f"{k:064x}", [float(np32(k / 7)), -1.5] + [0.25] * (d - 2)) for m, d in (("a b", 3), ("m2", 5)) for k in range(n)]
    return spark.createDataFrame(rows, "model string, embedding_text_sha256 string, vector array<float>"), rows


def np32(x):
    return struct.unpack("<f", struct.pack("<f", x))[0]


def path_of(uri):
    return uri.removeprefix("file://")


def test_vectors_round_trip_by_ranges(spark):
    table, rows = vectors(spark)
    path = new_path(spark, "vectors")
    versions.write_vectors(table, path)
    ranges.register(spark)
    ranges.write_digests(spark, path)
    found = spark.read.format("vectors").load(path)
    assert sorted((r["model"], r["embedding_text_sha256"], list(r["vector"])) for r in found.collect()) == sorted((m, k, v) for m, k, v in rows)
    assert {r["dims"] for r in found.filter("model = 'a b'").collect()} == {3} and found.filter("dims = 5").count() == 40
    chosen = spark.read.format("vectors").option("model", "a b").load(path)
    assert chosen.count() == 40 and spark.read.format("vectors").option("dims", 5).load(path).select("model").distinct().collect()[0][0] == "m2"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("vectors").option("pushdown", "true").load(path).filter("model = 'm2' and dims = 5 and embedding_text_sha256 <> ''")
        assert pushed.count() == 40 and "a b" not in {r["model"] for r in pushed.collect()}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ranges_cut_lines_once(tmp_path, small_blocks):
    """Every line comes from one range, wherever ranges end; short files, long lines, no last line end."""
    for k, text in enumerate(["", "one\n", "no end", "\n\n", "x" * 300 + "\ny\n" + "z" * 127 + "\n", "".join(f"line {i}\r\n" for i in range(50))]):
        file = tmp_path / f"{k}.sse"
        file.write_bytes(text.encode())
        system, [f] = ranges.fs.LocalFileSystem(), [f for f in ranges._files(str(tmp_path), ".sse")[1] if f.path == str(file)]
        parts = [ranges.Range(f.path, a, min(a + 128, f.size), f.size, []) for a in range(0, f.size, 128)]
        lines = [x for p in parts for x in ranges._lines(system, p)]
        whole = text.encode().splitlines(keepends=True)
        assert [b for _, b in lines] == [x.rstrip(b"\r\n") for x in whole]
        assert [a for a, _ in lines] == [sum(map(len, whole[:i])) for i in range(len(whole))]


def test_corrupt_blocks_and_lines(spark, tmp_path):
    folder = tmp_path / "model=m"
    folder.mkdir()
    line = '{"embedding_text_sha256": "k%d", "dims": 1, "vector": "AACAPw=="}\n'
    (folder / "part-0.json").write_text("".join(line % k for k in range(20)))
    assert ranges.write_digests(spark, str(tmp_path)) == 1
    reader = ranges._VectorReader(str(tmp_path))
    read = lambda: [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(read()) == 20 and read()[3] == {"model": "m", "embedding_text_sha256": "k3", "dims": 1, "vector": [1.0]}
    data = (folder / "part-0.json").read_bytes()
    (folder / "part-0.json").write_bytes(data.replace(b"k7", b"k8"))
    with pytest.raises(ranges.CorruptFile, match="block"):
        read()
    (folder / "part-0.json").write_bytes(b"")
    assert read() == []  # no range
    (folder / "part-0.json").write_bytes(data + data * 20_000)
    with pytest.raises(ranges.CorruptFile, match="as long as"):
        read()
    (folder / ".part-0.json.blocks").unlink()
    (folder / "part-0.json").write_bytes(data[:-20])
    with pytest.raises(ranges.CorruptFile, match="byte"):
        read()


def test_event_lines_as_batch_and_stream(spark, tmp_path):
    """A torn line waits for its end; a restart goes on where the last batch ended."""
    source, out, state = tmp_path / "in", new_path(spark, "events"), new_path(spark, "state")
    source.mkdir()
    ranges.register(spark)
    (source / "a.sse").write_text('data: {"n": 1}\n\n: note\ndata: {"n": 2}\ndata: {"n":')

    def drain():
        stream = spark.readStream.format("event_lines").load(str(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(((r["file"][-5:], r["data"], r["done"]) for r in spark.read.parquet(out).collect()), key=str)

    assert drain() == [("a.sse", '{"n": 1}', False), ("a.sse", '{"n": 2}', False)]
    with (source / "a.sse").open("a") as f:
        f.write(' 3}\ndata: [DONE]\n')
    (source / "b.sse").write_text("data: x\n")
    rows = drain()
    assert [d for f, d, _ in rows if f == "a.sse" and d] == ['{"n": 1}', '{"n": 2}', '{"n": 3}']
    assert [(f, done) for f, _, done in rows if done] == [("a.sse", True)] and ("b.sse", "x", False) in rows and len(rows) == 5
    batch = spark.read.format("event_lines").load(str(source))
    assert sorted(((r["file"][-5:], r["data"], r["done"]) for r in batch.collect()), key=str) == rows


def test_runs_end_time_out_come_late_and_resume(spark, tmp_path):
    source, out, state = tmp_path / "in", new_path(spark, "runs"), new_path(spark, "state")
    schema = "who string, event_type string"

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(str(source))

    def rows():
        try:
            return sorted(tuple(r) for r in spark.read.parquet(out).select("who", "outcome", "run", "events").collect())
        except Exception:
            return []

    def wait(n):
        until = time.time() + 90
        while time.time() < until and len(rows()) < n:
            time.sleep(0.5)
        return rows()

    put(("a", "go"), ("a", "end"), ("b", "go"), ("b", "go"))
    events = spark.readStream.schema(schema).json(str(source))
    tracked = runs.tracked_runs(events, "who", "end", seconds=4, resumes="again")
    before = spark.conf.get(runs._PROVIDER, None)
    with runs.column_state(spark):
        query = tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="500 milliseconds").start()
        try:
            assert wait(2) == [("a", "ended", 1, 2), ("b", "timeout", 1, 2)]
            put(("b", "go"), ("a", "again"))
            assert wait(4)[1:] == [("a", "timeout", 2, 1), ("b", "late", 1, 1), ("b", "timeout", 1, 2)]
        finally:
            query.stop()
    assert spark.conf.get(runs._PROVIDER, None) == before
