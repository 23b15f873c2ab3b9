"""Array and image files, one per subject: binary scans, decoding and writing in tasks."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import LARGEST_FLOAT, fill_nonfinite, id_from_path
from ..session import qualified

# Fixed values of the public NIfTI-1 format: data type code to numpy type.
NIFTI_TYPES = {
    2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8",
}
NIFTI_HEADER = 348

DECODED = "path string, subject_id string, x array<float>, shape array<int>, error string"


def decode_npy(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def decode_nifti(content: bytes) -> np.ndarray:
    """Voxel array of a NIfTI-1 file, compressed or not, with its intensity scaling applied."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if len(raw) < NIFTI_HEADER:
        raise ValueError("file shorter than a header")
    order = next((o for o in "<>" if np.frombuffer(raw, o + "i4", 1, 0)[0] == NIFTI_HEADER), None)
    if order is None or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = np.frombuffer(raw, order + "i2", 8, 40)
    shape = [int(n) for n in dims[1 : 1 + dims[0]]]
    kind = NIFTI_TYPES.get(int(np.frombuffer(raw, order + "i2", 1, 70)[0]))
    if kind is None:
        raise ValueError("unsupported data type")
    offset, slope, inter = np.frombuffer(raw, order + "f4", 3, 108)
    data = np.frombuffer(raw, order + kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope != 0 and np.isfinite(slope) and (slope, inter) != (1, 0):
        data = data * float(slope) + float(inter)
    return data


def encode_nifti(values: np.ndarray) -> bytes:
    """A compressed single-file NIfTI-1 image of 32-bit floats."""
    header = np.zeros(352, np.uint8)

    def put(at: int, kind: str, *numbers) -> None:
        raw = np.array(numbers, kind).tobytes()
        header[at : at + len(raw)] = np.frombuffer(raw, np.uint8)

    put(0, "<i4", NIFTI_HEADER)
    put(40, "<i2", values.ndim, *values.shape)
    put(70, "<i2", 16, 32)
    put(76, "<f4", *([1.0] * 8))
    put(108, "<f4", 352.0, 1.0, 0.0)
    header[344:348] = np.frombuffer(b"n+1\0", np.uint8)
    return gzip.compress(header.tobytes() + values.astype("<f4").tobytes(order="F"))


def encode_npy(values: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, values)
    return out.getvalue()


def scan_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, content) of every file with the suffix; file listing and reading are Spark's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


def decode_files(files: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(path, subject_id, x, shape, error), one row per file; an unreadable file has its error and no array."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, subject, content in zip(part["path"], part["subject_id"], part["content"]):
                values, shape, error = None, None, None
                try:
                    grid = decode(bytes(content))
                    values, shape = np.ascontiguousarray(grid, np.float32).ravel(), list(grid.shape)
                except Exception as e:  # a damaged file must not stop the cohort
                    error = f"{type(e).__name__}: {e}"
                # one file per output batch: a volume is large
                yield pd.DataFrame(
                    {"path": [path], "subject_id": [subject], "x": [values], "shape": [shape], "error": [error]}
                )

    return files.withColumn("subject_id", id_from_path(F.col("path"))).mapInPandas(run, DECODED)


def scan_array_files(spark: SparkSession, folder: str) -> DataFrame:
    """Flattened arrays of ``.npy`` files with non-finite values replaced: (subject_id, x, shape, error).

    Arrays are read in single precision, so infinities become the largest single-precision value of their sign.
    A file that cannot be read keeps its row, without an array and with its error.
    """
    decoded = decode_files(scan_files(spark, folder, ".npy"), decode_npy)
    filled = fill_nonfinite(F.col("x").cast("array<double>"), LARGEST_FLOAT)
    return decoded.select("subject_id", filled.alias("x"), "shape", "error")


def convert_volumes(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Decode compressed images once and keep them as parquet; returns the written table."""
    decode_files(scan_files(spark, folder, ".nii.gz"), decode_nifti).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_array_files(
    rows: DataFrame, folder: str, encode: Callable[[np.ndarray], bytes], suffix: str
) -> DataFrame:
    """Write one file per row of (subject_id, x, shape) from the tasks; returns (path, bytes) lazily.

    A retried task writes the same bytes to the same name. A path without a scheme is on the file system that
    Spark itself would use.
    """
    target = qualified(rows.sparkSession, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pafs.FileSystem.from_uri(target.replace("s3a://", "s3://", 1))
        files.create_dir(root, recursive=True)
        for part in parts:
            done = []
            for subject, x, shape in zip(part["subject_id"], part["x"], part["shape"]):
                content = encode(np.asarray(x).reshape(shape))
                path = f"{root}/{subject}{suffix}"
                with files.open_output_stream(path, compression=None) as out:
                    out.write(content)
                done.append((path, len(content)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return rows.select("subject_id", "x", "shape").mapInPandas(run, "path string, bytes long")
