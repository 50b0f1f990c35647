"""Python data sources that read line files by ranges of bytes: vector bundles and event streams.

``vectors``: base64 lines in folders ``model=…`` (as ``sinks.versions.write_vectors`` writes them), split into
ranges of whole blocks.  Where a file has a list of its blocks' digests beside it, each task checks those it reads;
a choice of ``model`` leaves out folders, one of ``dims`` lines before their vectors are decoded.

``event_lines``: files of ``data: …`` lines up to ``data: [DONE]``, in batch or as a stream whose offsets are bytes
per file; a line counts when its end is there.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import PurePosixPath
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

#: Bytes of a block, whose digest is kept, and blocks of a range.
BLOCK, BLOCKS = 1 << 20, 32


class CorruptFile(ValueError):
    """A block isn't what its digest says, or a line can't be read."""


def _files(path: str, ending: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    found = system.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
    kept = [f for f in found if f.is_file and f.base_name.endswith(ending) and not f.base_name.startswith((".", "_"))]
    return system, sorted(kept, key=lambda f: f.path)


def _system(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file."""

    file: str
    start: int
    end: int
    size: int
    digests: list[str]


def _lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range; checks the blocks that the range covers."""
    with system.open_input_file(part.file) as source:
        data = source.read_at(part.end - part.start, part.start)
        for k, want in enumerate(part.digests):
            if hashlib.sha256(data[k * BLOCK : (k + 1) * BLOCK]).hexdigest() != want:
                raise CorruptFile(f"{part.file}: block {part.start // BLOCK + k} isn't what its digest says")
        at, tail = part.start, b""
        if part.start and source.read_at(1, part.start - 1) != b"\n":
            first = data.find(b"\n")
            if first < 0:
                return
            at, data = at + first + 1, data[first + 1 :]
        end = part.end
        while data and not data.endswith(b"\n") and end < part.size:  # the last line goes on behind the range
            more = source.read_at(min(BLOCK, part.size - end), end)
            end += len(more)
            cut = more.find(b"\n")
            tail += more if cut < 0 else more[: cut + 1]
            if cut >= 0:
                break
        for line in (data + tail).splitlines(keepends=True):
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def _sidecar(file: str) -> str:
    """The hidden file with a file's block digests."""
    return str(PurePosixPath(file).with_name(f".{PurePosixPath(file).name}.blocks"))


def write_digests(spark: SparkSession, path: str) -> int:
    """Writes the digests of each file's blocks beside it, file by file in tasks; returns the number of blocks."""
    _, files = _files(path, ".json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _system(path)
        for batch in batches:
            counts = []
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(name) as source:
                    found = [hashlib.sha256(b).hexdigest() for b in iter(lambda s=source: s.read(BLOCK), b"")]
                with system.open_output_stream(_sidecar(name)) as out:
                    out.write(json.dumps(found).encode())
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n"])

    if not files:
        return 0
    listed = spark.createDataFrame([(f.path,) for f in files], "file string").repartition(min(len(files), 1000))
    return listed.mapInArrow(write, "n long").agg({"n": "sum"}).first()[0]


def _with_digests(system: fs.FileSystem, part: Range) -> Range:
    """The range with the digests of its blocks, where its file has any."""
    where = _sidecar(part.file)
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return part
    with system.open_input_stream(where) as source:
        digests = json.loads(source.read())
    if len(digests) != -(-part.size // BLOCK):
        raise CorruptFile(f"{part.file} isn't as long as its digests say")
    return replace(part, digests=digests[part.start // BLOCK : part.start // BLOCK + BLOCKS])


class _VectorReader(DataSourceReader):
    def __init__(self, path: str, model: str | None = None, dims: int | None = None) -> None:
        self.path, self.model, self.dims = path, model, dims

    def partitions(self) -> list[Range]:
        _, files = _files(self.path, ".json")
        step = BLOCK * BLOCKS
        chosen = [f for f in files if self.model is None or _model(f.path) == self.model]
        return [Range(f.path, a, min(a + step, f.size), f.size, []) for f in chosen for a in range(0, f.size, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system = _system(self.path)
        model, rows = _model(partition.file), []
        for at, line in _lines(system, _with_digests(system, partition)):
            try:
                row = json.loads(line)
                dims = int(row["dims"])
                if self.dims is not None and dims != self.dims:
                    continue
                packed = base64.b64decode(row["vector"], validate=True)
                if len(packed) != 4 * dims:
                    raise ValueError(f"{len(packed)} bytes for {dims} numbers")
                rows.append((model, row["embedding_text_sha256"], dims, packed))
            except (ValueError, KeyError, TypeError) as e:
                raise CorruptFile(f"{partition.file}, byte {at}: {e}") from e
            if len(rows) == 1000:
                yield _vector_batch(rows)
                rows = []
        if rows:
            yield _vector_batch(rows)


class _FilteredReader(_VectorReader):
    """Takes equality filters on model and dims; other filters stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("model",):
                self.model = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("dims",):
                self.dims = f.value
            else:
                yield f


def _model(file: str) -> str:
    named = [p.removeprefix("model=") for p in PurePosixPath(file).parts if p.startswith("model=")]
    return unquote(named[-1]) if named else ""


def _vector_batch(rows: list[tuple]) -> pa.RecordBatch:
    """The numbers are little-endian 32-bit floats."""
    flat = pa.Array.from_buffers(pa.float32(), sum(r[2] for r in rows), [None, pa.py_buffer(b"".join(r[3] for r in rows))])
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + r[2])
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
        ["model", "embedding_text_sha256", "dims", "vector"],
    )


class VectorBundle(DataSource):
    """``spark.read.format("vectors").load(path)``.

    The options ``model`` and ``dims`` choose vectors; with the option ``pushdown`` filters on those columns do so
    by themselves, which Spark allows where ``spark.sql.python.filterPushdown.enabled`` is true.
    """

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "model string, embedding_text_sha256 string, dims int, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("pushdown") == "true":
            return _FilteredReader(self.options["path"])
        dims = self.options.get("dims")
        return _VectorReader(self.options["path"], self.options.get("model"), int(dims) if dims else None)


def _events(system: fs.FileSystem, part: Range) -> Iterator[tuple]:
    for at, line in _lines(system, part):
        if line.startswith(b"data:"):
            body = line[5:].strip().decode("utf-8", "replace")
            yield part.file, at, None if body == "[DONE]" else body, body == "[DONE]"


class _EventReader(DataSourceReader):
    def __init__(self, path: str, ending: str) -> None:
        self.path, self.ending = path, ending

    def partitions(self) -> list[Range]:
        _, files = _files(self.path, self.ending)
        step = BLOCK * BLOCKS
        return [Range(f.path, a, min(a + step, f.size), f.size, []) for f in files for a in range(0, f.size, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system = _system(self.path)
        yield from _events(system, partition)


class _EventStreamReader(DataSourceStreamReader):
    """Offsets: the bytes of whole lines of each file."""

    def __init__(self, path: str, ending: str) -> None:
        self.path, self.ending = path, ending
        self.whole: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = _files(self.path, self.ending)
        for f in files:
            done, at = self.whole.get(f.path, 0), f.size
            with system.open_input_file(f.path) as source:
                while at > done:  # from the end back to the last line's end
                    low = max(done, at - BLOCK)
                    cut = source.read_at(at - low, low).rfind(b"\n")
                    if cut >= 0:
                        done = low + cut + 1
                        break
                    at = low
            self.whole[f.path] = done
        return {k: v for k, v in self.whole.items() if v}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        step, out = BLOCK * BLOCKS, []
        for file, stop in sorted(end.items()):
            out += [Range(file, a, min(a + step, stop), stop, []) for a in range(start.get(file, 0), stop, step)]
        return out

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Range) -> Iterator[tuple]:
        system = _system(self.path)
        yield from _events(system, partition)


class EventLines(DataSource):
    """``spark.read`` or ``spark.readStream.format("event_lines").load(path)``; option ``ending`` (".sse")."""

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "file string, at long, data string, done boolean"

    def _given(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("ending", ".sse")

    def reader(self, schema) -> DataSourceReader:
        return _EventReader(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _EventStreamReader(*self._given())


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session."""
    spark.dataSource.register(VectorBundle)
    spark.dataSource.register(EventLines)
