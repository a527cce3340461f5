"""Frame stacks in .npy and .npz files as a data source: tasks read ranges of bytes of an array, never a whole file."""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FRAMES = "video_id string, frame int, row int, col int, value double"
META = "video_id string, m int, n int, l int, dx double, dt double, x0 double, y0 double"
AXES = ("row", "col", "frame")
#: Values a task reads, and values of a batch it hands on.
TASK_VALUES, BATCH_VALUES = 4_000_000, 100_000


@dataclass(frozen=True)
class Array:
    """Where an array lies: its first value is `offset` bytes into the file, or into the member if that is compressed.
    shape and axes run from the slowest index to the fastest."""

    path: str
    member: str | None
    offset: int
    dtype: str
    shape: tuple[int, ...]
    axes: tuple[str, ...]


@dataclass
class Slab(InputPartition):
    """The part of an array within [from, to) on each axis."""

    video: str
    array: Array
    bounds: tuple[tuple[int, int], ...]


@dataclass
class Geometry(InputPartition):
    path: str


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def stack_files(path: str) -> list[str]:
    """The .npy and .npz files that a path, folder or pattern names, sorted. A star does not cross a slash; names that start
    with a dot or an underscore are left out, as Spark does."""
    wild = [path.index(c) for c in "*?[" if c in path]
    head = path[: path.rfind("/", 0, min(wild)) + 1] if wild else path
    system, base = _system(head or ".")
    prefix = head[: len(head) - len(base)] if head.endswith(base) else ""
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    pattern = path[len(head) :].split("/") if wild else ["*"]
    found = system.get_file_info(fs.FileSelector(base, recursive=len(pattern) > 1))
    parts = {x.path: x.path[len(base.rstrip("/")) :].strip("/").split("/") for x in found if x.type == fs.FileType.File}
    hit = [p for p, names in parts.items() if len(names) == len(pattern) and all(map(fnmatch.fnmatchcase, names, pattern))]
    return sorted(prefix + p for p in hit if p.endswith((".npy", ".npz")) and p.rsplit("/", 1)[-1][0] not in "._")


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"array format {version} is not known")
    return read(stream)


def find_array(path: str, name: str) -> Array:
    """Reads the headers of a file, and no values."""
    system, place = _system(path)
    with system.open_input_file(place) as file:
        member = None
        if path.endswith(".npy"):
            shape, fortran, dtype = _header(file)
            offset = file.tell()
        else:
            with zipfile.ZipFile(file) as packed:
                if name + ".npy" not in packed.namelist():
                    raise ValueError(f"{path} has no array {name!r}")
                info = packed.getinfo(name + ".npy")
                with packed.open(info) as stream:
                    shape, fortran, dtype = _header(stream)
                    offset = stream.tell()
                if info.compress_type == zipfile.ZIP_STORED:
                    file.seek(info.header_offset + 26)
                    offset += info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4)))
                else:
                    member = info.filename
    if dtype.kind not in "biuf":
        raise ValueError(f"{path}: values of type {dtype} are not numbers")
    axes = AXES[: len(shape)]
    return Array(path, member, offset, dtype.str, shape[::-1] if fortran else shape, axes[::-1] if fortran else axes)


class _Values:
    """Reads runs of an array's values; those of a compressed member in ascending order."""

    def __init__(self, array: Array) -> None:
        self.array, self.dtype = array, np.dtype(array.dtype)

    def __enter__(self) -> _Values:
        system, place = _system(self.array.path)
        self.file = self.stream = system.open_input_file(place)
        if self.array.member is not None:
            self.stream = zipfile.ZipFile(self.file).open(self.array.member)
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()
        self.file.close()

    def read(self, start: int, count: int) -> np.ndarray:
        self.stream.seek(self.array.offset + start * self.dtype.itemsize, io.SEEK_SET)
        content = self.stream.read(count * self.dtype.itemsize)
        if len(content) < count * self.dtype.itemsize:
            raise ValueError(f"{self.array.path} ends before its array does")
        return np.frombuffer(content, self.dtype)


def slabs(video: str, array: Array, wanted: dict[str, tuple[int, int]], values: int) -> list[Slab]:
    """An array cut along its two slower axes into parts of at most `values` values, or one line of the fastest axis where that
    is longer. A compressed member can only be read from its start and is one part."""
    (a0, a1), (b0, b1), (c0, c1) = ((max(0, wanted.get(x, (0, n))[0]), min(n, wanted.get(x, (0, n))[1])) for x, n in zip(array.axes, array.shape, strict=True))
    if a1 <= a0 or b1 <= b0 or c1 <= c0:
        return []
    if array.member is not None:
        return [Slab(video, array, ((a0, a1), (b0, b1), (c0, c1)))]
    line = array.shape[2]
    b_step = min(b1 - b0, max(1, values // line))
    a_step = max(1, values // ((b1 - b0) * line)) if b_step == b1 - b0 else 1
    return [Slab(video, array, ((a, min(a + a_step, a1)), (b, min(b + b_step, b1)), (c0, c1))) for a in range(a0, a1, a_step) for b in range(b0, b1, b_step)]


def slab_rows(slab: Slab, rows: int) -> Iterator[pa.RecordBatch]:
    """A slab's values as rows of frames, in batches of about `rows` values."""
    (a0, a1), (b0, b1), (c0, c1) = slab.bounds
    _, width, line = slab.array.shape
    # whole slices of the slowest axis lie beside each other and are read together
    a_step = max(1, rows // (width * line)) if b1 - b0 == width else 1
    b_step = b1 - b0 if a_step > 1 else max(1, rows // line)
    with _Values(slab.array) as values:
        for a in range(a0, a1, a_step):
            for b in range(b0, b1, b_step):
                a_to, b_to = min(a + a_step, a1), min(b + b_step, b1)
                block = values.read((a * width + b) * line, ((a_to - 1 - a) * width + b_to - b) * line)
                block = block.reshape(a_to - a, b_to - b, line)[:, :, c0:c1]
                index = dict(zip(slab.array.axes, np.meshgrid(np.arange(a, a_to), np.arange(b, b_to), np.arange(c0, c1), indexing="ij"), strict=True))
                columns = [pa.array(index[x].ravel(), pa.int32()) for x in ("frame", "row", "col")]
                yield pa.record_batch([pa.array([slab.video] * block.size, pa.string()), *columns, pa.array(block.ravel().astype(float))], ["video_id", "frame", "row", "col", "value"])


def _video(path: str) -> str:
    return path.rsplit("/", 1)[-1][:-4]


class StackReader(DataSourceReader):
    """Options: path; array; geometry (true: a row a file in place of values); <axis>_from and <axis>_to; task_values;
    batch_values."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.name = self.options.get("array", "ImgSequence")

    def _wanted(self) -> dict[str, tuple[int, int]]:
        far = 2**62
        return {x: (int(self.options.get(x + "_from", 0)), int(self.options.get(x + "_to", far))) for x in AXES}

    def partitions(self) -> list[InputPartition]:
        paths = stack_files(self.options["path"])
        if self.options.get("geometry") == "true":
            return [Geometry(p) for p in paths] or [Geometry("")]
        out: list[InputPartition] = []
        for path in paths:
            array = find_array(path, self.name)
            if len(array.shape) != 3:
                raise ValueError(f"{path}: a stack has three axes (row, col, frame), not {len(array.shape)}")
            out += slabs(_video(path), array, self._wanted(), int(self.options.get("task_values", TASK_VALUES)))
        return out or [Geometry("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch | tuple]:
        if isinstance(partition, Slab):
            yield from slab_rows(partition, int(self.options.get("batch_values", BATCH_VALUES)))
        elif partition.path:
            yield self._geometry(partition.path)

    def _geometry(self, path: str) -> tuple:
        array = find_array(path, self.name)
        size = dict(zip(array.axes, array.shape, strict=True))
        return (_video(path), size["row"], size["col"], size["frame"], *[self._first(path, self.options.get(x, x)) for x in ("dx", "dt")], *[self._first(path, self.options.get(k, x)) for k, x in (("x", "X"), ("y", "Y"))])

    def _first(self, path: str, name: str) -> float | None:
        """The first value of an array; null if there is none."""
        if path.endswith(".npy"):
            return None
        try:
            array = find_array(path, name)
        except ValueError:
            return None
        if 0 in array.shape:
            return None
        with _Values(array) as values:
            return float(values.read(0, 1)[0])


class StackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wave_stack"

    def schema(self) -> str:
        return META if self.options.get("geometry") == "true" else FRAMES

    def reader(self, schema: StructType) -> StackReader:
        return StackReader(dict(self.options))
