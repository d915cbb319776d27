"""File sources and sinks: npy, MATLAB version 5, EMD, XYZ, coefficient tables, stage checkpoints.

Array files are read by ``binaryFile`` in Arrow tasks, a file each, and become long rows; nothing passes the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from dataclasses import asdict, is_dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _elements(raw: bytes, at: int, end: int, order: str):
    """(type, bytes) of each data element; small ones hold type and size in one word."""
    while at + 8 <= end:
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:
            kind, size, data = kind & 0xFFFF, kind >> 16, at + 4
            at += 8
        else:
            data, at = at + 8, at + 8 + size + (-size % 8 if kind != 15 else 0)
        yield kind, raw[data : data + size]


def read_mat5(raw: bytes) -> dict[str, np.ndarray]:
    """Real numeric arrays of a version 5 file by name, in their own axis order."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out = {}
    for kind, data in _elements(raw, 128, len(raw), order):
        if kind == 15:
            kind, data = next(_elements(inner := zlib.decompress(data), 0, len(inner), order))
        if kind != 14:
            continue
        parts = list(_elements(data, 0, len(data), order))
        if struct.unpack_from(order + "I", parts[0][1])[0] & 0xFF not in range(6, 16):
            continue
        dims = np.frombuffer(parts[1][1], order + "i4")
        kind, values = parts[3]
        if kind in NUMERIC:
            out[parts[2][1].decode("latin-1")] = np.frombuffer(values, order + NUMERIC[kind]).reshape(dims, order="F")
    return out


def decode_array(path: str, raw: bytes, variable: str | None = None) -> np.ndarray:
    """Array of an npy, npz or MATLAB version 5 file; the named variable, or the first numeric one."""
    if path.endswith(".npy"):
        return np.load(io.BytesIO(raw), allow_pickle=False)
    if path.endswith((".npz", ".mat")):
        if raw[:8] == b"\x89HDF\r\n\x1a\n" or raw[512:520] == b"\x89HDF\r\n\x1a\n":
            return _hdf5(raw, variable)
        found = dict(np.load(io.BytesIO(raw), allow_pickle=False)) if path.endswith(".npz") else read_mat5(raw)
        if variable is None:
            if not found:
                raise ValueError(f"no numeric array in {path}")
            return next(iter(found.values()))
        return found[variable]
    raise ValueError(f"unsupported array file {path}")


def _hdf5(raw: bytes, variable: str | None) -> np.ndarray:
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 (EMD, MATLAB 7.3) needs h5py, which isn't installed") from e
    with h5py.File(io.BytesIO(raw), "r") as f:
        if variable:
            return np.asarray(f[variable])
        found = []
        f.visititems(lambda name, x: found.append(name) if isinstance(x, h5py.Dataset) and x.ndim >= 3 and x.dtype.kind in "iuf" else None)
        return np.asarray(f[found[0]])


def read_arrays(spark: SparkSession, path: str, axes: list[str], variable: str | None = None) -> DataFrame:
    """file, the named axes (from 0) and v of every cell of the arrays at ``path`` (a file, a folder or a glob)."""
    schema = pa.schema([("file", pa.string()), *((a, pa.int32()) for a in axes), ("v", pa.float64())])

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                a = decode_array(name, raw, variable)
                if a.ndim != len(axes):
                    raise ValueError(f"{name} has {a.ndim} axes, not {len(axes)}")
                flat = a.ravel()
                for at in range(0, flat.size, 1 << 16):
                    part = flat[at : at + (1 << 16)]
                    index = np.unravel_index(np.arange(at, at + len(part)), a.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *(pa.array(x, pa.int32()) for x in index), pa.array(part.astype(np.float64))], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, " + ", ".join(f"{a} int" for a in axes) + ", v double")


def read_emd(spark: SparkSession, path: str, data: str = "/data/raw/data") -> DataFrame:
    """frame, view, r, c, v of an EMD file; its axes are stored in reverse."""
    rows = read_arrays(spark, path, ["c", "r", "view", "frame"], data)
    return rows.select("frame", "view", "r", "c", "v")


def read_emd_angles(spark: SparkSession, path: str, table: str = "/data/raw/imageSetParameters", column: int = 4) -> DataFrame:
    """view, theta: a column of the table of image parameters; its axes are stored in reverse."""
    rows = read_arrays(spark, path, ["part", "view"], table)
    return rows.where(F.col("part") == column).select("view", F.col("v").alias("theta"))


def read_projections(spark: SparkSession, images: str, angles: str) -> tuple[DataFrame, DataFrame]:
    """view, r, c, v of a stack of images (rows, columns, views) and view, phi, theta, psi of its angles.

    The angles are a list of tilts or three columns; their number must be that of the views.
    """
    px = read_arrays(spark, images, ["r", "c", "view"]).select("view", "r", "c", "v")
    listed = spark.read.format("binaryFile").load(angles).select("path", "content").collect()  # one file, three numbers a view
    table = decode_array(listed[0]["path"], bytes(listed[0]["content"]))
    table = table.reshape(len(table), -1) if table.ndim < 2 or table.shape[1] in (1, 3) else table.reshape(-1, 1)
    views = px.agg(F.max("view")).first()[0]
    if views is None or len(table) != views + 1 or table.shape[1] not in (1, 3):
        raise ValueError(f"{len(table)} x {table.shape[1]} angles for {0 if views is None else views + 1} views")
    full = table if table.shape[1] == 3 else np.column_stack([0 * table[:, 0], table[:, 0], 0 * table[:, 0]])
    return px, spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(full)], "view int, phi double, theta double, psi double")


def convert_arrays(spark: SparkSession, path: str, axes: list[str], out: str, variable: str | None = None) -> None:
    """Arrays of any readable format at ``path`` as a table of their cells at ``out``."""
    read_arrays(spark, path, axes, variable).write.mode("errorifexists").parquet(out)


def write_reconstruction(path: str, volume: DataFrame, summary: DataFrame, timing: DataFrame) -> None:
    """A volume, its summary (one row) and the seconds of each round; the last two as csv with a header."""
    volume.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/volume")
    for name, df in (("summary", summary), ("iter_timing", timing)):
        df.coalesce(1).write.mode("errorifexists").csv(f"{path}/{name}", header=True)


def write_refinement(path: str, model: DataFrame, parameters: DataFrame, errors: DataFrame) -> None:
    """A refined model with the history of its heights and widths and of its error."""
    write_result({"model_refined": model, "hb_history": parameters, "err_history": errors}, path)


def with_coefficients(atoms: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``atoms`` (z) with the scattering coefficients of their element; the table has a row for each element."""
    return atoms.join(F.broadcast(coefficients), "z")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """file, atom_id, element, x, y, z; the first two lines of a file are its count and comment."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where("n >= 2 AND trim(line) <> ''")
    part = F.split(F.trim("line"), r"\s+")
    return lines.select("file", (F.col("n") - 2).cast("long").alias("atom_id"), part[0].alias("element"), *(part[k + 1].cast("double").alias(a) for k, a in enumerate("xyz")))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """Scattering coefficients: a csv with z, a1-a3, b1-b3, c1-c3, d1-d3, a row for each element."""
    return spark.read.csv(path, header=True, schema="z int, " + ", ".join(f"{k}{n} double" for k in "abcd" for n in (1, 2, 3)))


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("sep", " ").csv(path)


def write_result(members: dict[str, DataFrame], path: str) -> None:
    for name, df in members.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def _digest(config) -> str:
    return hashlib.sha256(json.dumps(asdict(config) if is_dataclass(config) else config, sort_keys=True, default=str).encode()).hexdigest()


class Stages:
    """Checkpoints of named stages with a manifest; a stage is written once and read only under the same configuration."""

    def __init__(self, spark: SparkSession, path: str, config):
        self.spark, self.path, self.config = spark, path.rstrip("/"), _digest(config)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        row = [(name, self.config, 1, df.schema.json())]
        self.spark.createDataFrame(row, "stage string, config string, schema_version int, schema string").coalesce(1).write.mode("append").json(f"{self.path}/_manifest")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        found = self.spark.read.json(f"{self.path}/_manifest", schema="stage string, config string, schema_version int, schema string").where(F.col("stage") == name).collect()
        if not found:
            raise FileNotFoundError(f"stage {name} isn't complete under {self.path}")
        if found[0].config != self.config:
            raise ValueError(f"stage {name} was made with another configuration")
        return self.spark.read.parquet(f"{self.path}/{name}")
