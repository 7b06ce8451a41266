"""Volume files as a data source: planes in, planes out.

A file is a header of 16 bytes and the volume's values in z, y, x order: the mark ``TFV1``, the kind of the values (``f4``,
``f8`` or ``u1`` and two spaces), and ny and nx as little-endian unsigned 32-bit integers.  Its depth follows from its length.

Reading gives (volume, z, plane).  Files are listed on the driver, which opens none; small ones are read together, large ones by
ranges of their planes, and the reader seeks to the planes that are wanted, which options name.  (Filters are not pushed
down: Spark 4.1 keeps those of one scan for the next one of the same DataFrame, which then misses rows.)
Writing takes each volume's planes in order, in one task, and needs no more memory than a batch of planes.  A task writes
under names of its own, and the driver renames the files when all tasks are done, so a lost or repeated task leaves nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .files import opened

# fixed values of the layout
MARK, HEADER = b"TFV1", struct.Struct("<4s4sII")
KINDS = {"f4": np.dtype("<f4"), "f8": np.dtype("<f8"), "u1": np.dtype("u1")}
SUFFIX = ".tfv"
#: Bytes that a reading task gets, about.
SPLIT = 64 << 20
#: Files that a reading task gets at most.
FILES = 1000
SCHEMA = "volume string, z int, plane array<float>"


def header(kind: str, ny: int, nx: int) -> bytes:
    return HEADER.pack(MARK, kind.ljust(4).encode(), ny, nx)


@dataclass(frozen=True)
class Layout:
    kind: np.dtype
    ny: int
    nx: int
    planes: int

    @classmethod
    def read(cls, file, size: int, name: str) -> Layout:
        mark, kind, ny, nx = HEADER.unpack(file.read_at(HEADER.size, 0)) if size >= HEADER.size else (b"", b"", 0, 0)
        kind = KINDS.get(kind.decode("ascii", "replace").strip())
        if mark != MARK or kind is None:
            raise ValueError(f"{name} is no volume file")
        planes, rest = divmod(size - HEADER.size, max(ny * nx * kind.itemsize, 1))
        if rest:
            raise ValueError(f"{name} ends inside a plane")
        return cls(kind, ny, nx, planes)

    def plane(self, file, z: int) -> np.ndarray:
        size = self.ny * self.nx * self.kind.itemsize
        return np.frombuffer(file.read_at(size, HEADER.size + z * size), self.kind)


@dataclass
class Part(ds.InputPartition):
    """Files (path, bytes, first byte, last byte of the range whose planes are read)."""

    files: list[tuple[str, int, int, int]]


class VolumeReader(ds.DataSourceReader):
    def __init__(self, folder: str, least: int = 0, most: int | None = None, volumes: list[str] | None = None):
        self.folder, self.least, self.most, self.volumes = folder, least, most, volumes

    def partitions(self) -> list[Part]:
        home, base = opened(self.folder)
        found = [i for i in home.get_file_info(pafs.FileSelector(base)) if i.base_name.endswith(SUFFIX) and not i.base_name.startswith(".")]
        parts, held, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            if self.volumes is not None and i.base_name.removesuffix(SUFFIX) not in self.volumes:
                continue
            if i.size > SPLIT:
                parts += [Part([(i.path, i.size, at, min(at + SPLIT, i.size))]) for at in range(0, i.size, SPLIT)]
                continue
            held.append((i.path, i.size, 0, i.size))
            size += i.size
            if size >= SPLIT or len(held) == FILES:
                parts.append(Part(held))
                held, size = [], 0
        return parts + [Part(held)] * bool(held or not parts)

    def wanted(self, layout: Layout, first: int, last: int) -> range:
        """The planes that begin in a range of bytes and that the filters leave."""
        size = max(layout.ny * layout.nx * layout.kind.itemsize, 1)
        begin, end = -(-max(first - HEADER.size, 0) // size), -(-max(last - HEADER.size, 0) // size)
        most = layout.planes - 1 if self.most is None else self.most
        return range(max(begin, self.least), min(end, layout.planes, most + 1))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        home, _ = opened(self.folder)
        for path, size, first, last in partition.files:
            name = path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
            with home.open_input_file(path) as file:
                layout = Layout.read(file, size, path)
                for z in self.wanted(layout, first, last):
                    values = pa.array(layout.plane(file, z).astype(np.float32))
                    plane = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z], pa.int32()), plane], names=["volume", "z", "plane"])


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[tuple[str, str]]


class VolumeWriter(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, ny: int, nx: int, kind: str):
        self.folder, self.ny, self.nx, self.kind = folder, ny, nx, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        home, base = opened(self.folder)
        home.create_dir(base, recursive=True)
        names, volume, out, depth = [], object(), None, 0
        try:
            for batch in iterator:
                volumes, places = batch.column("volume").to_pylist(), batch.column("z").to_pylist()
                for k, (name, z) in enumerate(zip(volumes, places)):
                    if name != volume:
                        if out is not None:
                            out.close()
                        if not name or "/" in name or name.startswith(".") or any(name == n for _, n in names):
                            raise ValueError(f"{name!r} cannot be a file's name, or its planes are not together")
                        temporary = f"{base}/.{name}-{uuid.uuid4().hex}"
                        names.append((temporary, name))
                        volume, depth, out = name, 0, home.open_output_stream(temporary, compression=None)
                        out.write(header(self.kind, self.ny, self.nx))
                    plane = batch.column("plane")[k].values
                    if z != depth or plane is None or len(plane) != self.ny * self.nx or plane.null_count:
                        raise ValueError(f"plane {z} of {name} where plane {depth} with {self.ny * self.nx} values is due")
                    out.write(plane.to_numpy().astype(KINDS[self.kind]).tobytes())
                    depth += 1
        except BaseException:
            self._drop([Written(names)])
            raise
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        home, base = opened(self.folder)
        home.create_dir(base, recursive=True)
        for m in messages:
            for temporary, name in m.names if m else ():
                home.move(temporary, f"{base}/{name}{SUFFIX}")

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)

    def _drop(self, messages: list[Written | None]) -> None:
        home, _ = opened(self.folder)
        for m in messages:
            for temporary, _ in m.names if m else ():
                if home.get_file_info(temporary).type != pafs.FileType.NotFound:
                    home.delete_file(temporary)


class VolumeSource(ds.DataSource):
    """Options: ``path``; for reading ``least``, ``most`` and ``volumes`` (a JSON list); for writing ``ny``, ``nx`` and ``kind``."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        most, volumes = self.options.get("most"), self.options.get("volumes")
        return VolumeReader(self.options["path"], int(self.options.get("least", 0)), most and int(most), volumes and json.loads(volumes))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options["path"], int(self.options["ny"]), int(self.options["nx"]), self.options.get("kind", "f4"))


def read_volumes(spark: SparkSession, folder: str, least: int = 0, most: int | None = None, volumes: list[str] | None = None) -> DataFrame:
    """(volume, z, plane) of the volume files in a folder: the planes from ``least`` to ``most``, of all volumes or those named."""
    spark.dataSource.register(VolumeSource)
    read = spark.read.format("volume").option("least", least)
    read = read if most is None else read.option("most", most)
    return (read if volumes is None else read.option("volumes", json.dumps(volumes))).load(folder)


def write_volumes(planes: DataFrame, folder: str, ny: int, nx: int, kind: str = "f4") -> None:
    """A file for each volume of ``planes`` (volume, z from 0 without gaps, plane); a file that is there already is replaced.

    Planes that are missing, double, null, of another length or with nulls inside are an error, and nothing is written.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of values: {kind}")
    planes.sparkSession.dataSource.register(VolumeSource)
    rows = planes.selectExpr("cast(volume AS string) AS volume", "cast(z AS int) AS z", "cast(plane AS array<float>) AS plane")
    dealt = rows.repartition("volume").sortWithinPartitions("volume", "z")
    dealt.write.format("volume").option("ny", ny).option("nx", nx).option("kind", kind).mode("append").save(folder)
