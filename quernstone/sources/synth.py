"""Generated vectors for benchmarks, and files of vectors."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import StorageError

# Fixed value: dimension of the SIFT files.
SIFT_DIM = 128


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """Ids 1..n with independent elements in [0, 1), made where they are used."""
    return spark.range(1, n + 1).select("id", F.array(*[F.rand(seed * 100_003 + i).cast("float") for i in range(dim)]).alias("vector"))


def _centres(clusters: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).random((clusters, dim))


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, spread: float = 0.05, seed: int = 1) -> DataFrame:
    """Ids 1..n in normal clusters, dealt in turn."""
    c = _centres(clusters, dim, seed)
    centre = F.array(*[F.array(*map(F.lit, map(float, row))) for row in c])
    row = spark.range(1, n + 1).withColumn("_c", F.get(centre, ((F.col("id") - 1) % clusters).cast("int")))
    return row.select("id", F.array(*[(F.get("_c", F.lit(i)) + spread * F.randn(seed * 100_003 + i)).cast("float") for i in range(dim)]).alias("vector"))


def clustered_queries(n: int, dim: int, clusters: int, spread: float = 0.05, seed: int = 1, query_seed: int = 2) -> list[list[float]]:
    """Points of the same clusters with 0.1 normal noise on top, as query vectors."""
    c, rng = _centres(clusters, dim, seed), np.random.default_rng(query_seed)
    at = rng.integers(clusters, size=n)
    return (c[at] + spread * rng.standard_normal((n, dim)) + 0.1 * rng.standard_normal((n, dim))).tolist()


def read_sift(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]]]:
    """Vectors (ids 1..n) and queries of one benchmark file on the driver's disk.

    Layout, little-endian: u64 n, u64 dim (128), n*dim f32, u64 queries, queries*dim f32.
    """
    with open(path, "rb") as f:
        data = f.read()
    try:
        n, dim = struct.unpack_from("<QQ", data, 0)
        if dim != SIFT_DIM:
            raise StorageError(f"dimension {dim}, expected {SIFT_DIM}")
        x = np.frombuffer(data, "<f4", n * dim, 16).reshape(n, dim)
        (m,) = struct.unpack_from("<Q", data, 16 + 4 * n * dim)
        q = np.frombuffer(data, "<f4", m * dim, 24 + 4 * n * dim).reshape(m, dim)
    except (struct.error, ValueError) as e:
        raise StorageError(f"{path} is cut short") from e
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x, 1)], "id long, vector array<float>")
    return rows, q.tolist()


def write_sift(path: str, vectors: Sequence[Sequence[float]], queries: Sequence[Sequence[float]]) -> None:
    """Writes such a file on the driver's disk."""
    with open(path, "wb") as f:
        for part, head in ((vectors, struct.pack("<QQ", len(vectors), SIFT_DIM)), (queries, struct.pack("<Q", len(queries)))):
            x = np.asarray(part, dtype="<f4").reshape(len(part), -1)
            if len(x) and x.shape[1] != SIFT_DIM:
                raise StorageError(f"dimension {x.shape[1]}, expected {SIFT_DIM}")
            f.write(head + x.tobytes())


def append_jsonl(path: str, records: Iterable[Mapping]) -> None:
    """Adds benchmark records, one JSON object per line."""
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(dict(r), sort_keys=True) + "\n" for r in records)
