"""Image volumes from NIfTI-1 files, plain or gzipped, as long rows (path, x, y, z, t, value), and where their voxels lie."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.batches import bound_batches, lean_worker

#: Fixed values of the file format: data types by code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
ROWS = 1 << 16


HEADER = 352


def encode(values: np.ndarray, affine: np.ndarray | None = None, t_step: float = 1.0, quaternion: bool = False) -> bytes:
    """A 4-D array of doubles as one file. ``affine`` (4 x 4) takes voxel numbers to millimetres; without it voxels have
    edges of 1. It is written as the file's sform or, if it is a rotation with scales, on request as its qform."""
    head = bytearray(HEADER)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, *values.shape, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 64, 64)
    sizes, flip = (1.0, 1.0, 1.0), 1.0
    if affine is not None:
        affine = np.asarray(affine, dtype=float)
        sizes = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
        if quaternion:
            turn = affine[:3, :3] / sizes
            flip = float(np.sign(np.linalg.det(turn)))
            struct.pack_into("<2h", head, 252, 1, 0)
            struct.pack_into("<6f", head, 256, *_quaternion(turn * [1, 1, flip]), *affine[:3, 3])
        else:
            struct.pack_into("<2h", head, 252, 0, 1)
            struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    struct.pack_into("<8f", head, 76, flip, *sizes, t_step, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, float(HEADER), 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype("<f8").tobytes(order="F")


def _quaternion(turn: np.ndarray) -> np.ndarray:
    """(b, c, d) of a rotation; a is not negative."""
    outer = np.array(
        [
            [np.trace(turn), turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]],
            [0, turn[0, 0] - turn[1, 1] - turn[2, 2], turn[0, 1] + turn[1, 0], turn[0, 2] + turn[2, 0]],
            [0, 0, turn[1, 1] - turn[0, 0] - turn[2, 2], turn[1, 2] + turn[2, 1]],
            [0, 0, 0, turn[2, 2] - turn[0, 0] - turn[1, 1]],
        ]
    )
    values, vectors = np.linalg.eigh((outer + np.triu(outer, 1).T) / 3)
    best = vectors[:, values.argmax()]
    return (best if best[0] >= 0 else -best)[1:]


def _rotation(b: float, c: float, d: float) -> np.ndarray:
    """The rotation of a unit quaternion whose first part is left out."""
    a = max(0.0, 1.0 - b * b - c * c - d * d) ** 0.5
    return np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )


def _order(content: bytes) -> str:
    """The byte order of a header."""
    for order in "<>":
        if len(content) >= 348 and struct.unpack_from(order + "i", content)[0] == 348 and content[344:347] == b"n+1":
            return order
    raise ValueError("not a single-file NIfTI-1 image")


def _shape(content: bytes, order: str) -> list[int]:
    n, *sizes = struct.unpack_from(order + "8h", content, 40)
    return [*sizes[: min(n, 4)], 1, 1, 1, 1][:4]


def geometry(content: bytes) -> dict:
    """Of a file, from its header alone: ``dims``, ``affine`` (voxel numbers to millimetres), ``voxel`` (the three edges) and ``t_step``.

    The sform counts if the file has one, else the qform, else the voxel sizes alone, from the first voxel on. Edges
    are the lengths of the affine's columns. Voxel sizes that are 0 or not finite count as 1.
    """
    if content[:2] == b"\x1f\x8b":
        content = zlib.decompressobj(31).decompress(content, HEADER)
    order = _order(content)
    flip, *pixdim = struct.unpack_from(order + "5f", content, 76)
    sizes = [abs(s) if s and np.isfinite(s) else 1.0 for s in pixdim[:3]]
    qform, sform = struct.unpack_from(order + "2h", content, 252)
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.reshape(struct.unpack_from(order + "12f", content, 280), (3, 4))
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(order + "6f", content, 256)
        affine[:3, :3] = _rotation(b, c, d) * [*sizes[:2], sizes[2] * (-1.0 if flip < 0 else 1.0)]
        affine[:3, 3] = shift
    else:
        affine[:3, :3] = np.diag(sizes)
    edges = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    edges = np.where((edges > 0) & np.isfinite(edges), edges, sizes)
    return {"dims": _shape(content, order), "affine": affine.tolist(), "voxel": edges.tolist(), "t_step": float(pixdim[3])}


def decode(content: bytes) -> np.ndarray:
    """The 4-D array of a file, scaled as its header says; time is the last axis."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order = _order(content)
    sizes = _shape(content, order)
    kind, start, slope, shift = TYPES[struct.unpack_from(order + "h", content, 70)[0]], *struct.unpack_from(order + "3f", content, 108)
    values = np.frombuffer(content, dtype=order + kind, count=int(np.prod(sizes)), offset=int(start)).astype(float)
    return (values * slope + shift if slope else values).reshape(sizes, order="F")


GEOMETRY = "path string, dims array<int>, affine array<array<double>>, voxel array<double>, t_step double"


def volume_geometry(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, dims, affine, voxel, t_step), one row a file; see ``geometry``. Values are not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.float64()]
        names = ["path", "dims", "affine", "voxel", "t_step"]
        for batch in batches:
            found = [{"path": name.as_py(), **geometry(data.as_py())} for name, data in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)], names=names)

    bound_batches(files.sparkSession)
    return files.select(path, content).mapInArrow(run, GEOMETRY)


def to_millimetres(volume: DataFrame, known: DataFrame, names: Sequence[str] = ("x_mm", "y_mm", "z_mm")) -> DataFrame:
    """Adds where each voxel of (path, x, y, z, ...) lies, by the affine of its file (``volume_geometry``)."""
    met = volume.drop(*names).join(known.select("path", "affine"), "path")
    at = lambda row: sum((F.col("affine")[row][k] * F.col(p) for k, p in enumerate(("x", "y", "z"))), F.col("affine")[row][3])
    return met.withColumns({n: at(row) for row, n in enumerate(names)}).drop("affine")


def volume_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Decodes files, one at a time; a file's rows leave in blocks, and a worker gets files of 8 MB together, or one larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = decode(data.as_py())
                flat = values.ravel()
                for at in range(0, len(flat), ROWS):
                    place = np.unravel_index(np.arange(at, min(at + ROWS, len(flat))), values.shape)
                    columns = [pa.array([name] * len(place[0]), pa.string()), *(pa.array(p, pa.int32()) for p in place), pa.array(flat[at : at + ROWS])]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "x", "y", "z", "t", "value"])

    bound_batches(files.sparkSession)
    return files.select(path, content).mapInArrow(run, "path string, x int, y int, z int, t int, value double")


def write_volumes(rows: DataFrame, folder: str, key: str = "z", affine: np.ndarray | None = None, t_step: float = 1.0) -> int:
    """Writes a file ``key.nii`` for each ``key``, of voxels at x, y and z and the embedding over time; number of files.

    A column of x, y and z that the table has not got, or that is the key, is 0. A file's voxels meet in one task, which
    writes it; ``folder`` is a path or URI that all executors reach. Voxels that are absent are NaN.
    """
    places = [c for c in ("x", "y", "z") if c in rows.columns and c != key]

    def write(table: pa.Table) -> pa.Table:
        series = table.column("embedding").to_pylist()
        at = [np.asarray(table.column(c)).astype(int) if c in places else np.zeros(len(series), dtype=int) for c in ("x", "y", "z")]
        values = np.full((*(int(a.max()) + 1 for a in at), max(map(len, series))), np.nan)
        for x, y, z, own in zip(*at, series):
            values[x, y, z, : len(own)] = own
        files, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(root, recursive=True)
        name = f"{table.column(key)[0].as_py()}.nii"
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(encode(values, affine, t_step))
        return pa.table({"name": [name]})

    return rows.select(key, *places, "embedding").groupBy(key).applyInArrow(write, "name string").count()


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.nii*") -> DataFrame:
    """(path, content, ...) of the image files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def scan_volumes(spark: SparkSession, folder: str, pattern: str = "*.nii*") -> DataFrame:
    return volume_rows(scan_files(spark, folder, pattern))
