"""Files of other tools: HDF5 matrices (where h5py is installed) and metadata in its older shapes."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    import h5py
except ImportError:
    h5py = None


def _needs_h5py() -> None:
    if h5py is None:
        raise ImportError("h5py is needed for HDF5 files; use Parquet tables otherwise")


def read_h5(path: str) -> dict[str, np.ndarray]:
    """Every dataset of a file by name."""
    _needs_h5py()
    with h5py.File(path, "r") as f:
        return {name: f[name][()] for name in f}


def write_h5(path: str, arrays: dict[str, np.ndarray]) -> None:
    _needs_h5py()
    with h5py.File(path, "w") as f:
        for name, values in arrays.items():
            f.create_dataset(name, data=values)


def matrix_table(spark: SparkSession, arrays: dict[str, np.ndarray], matrix_key: str = "matrix") -> DataFrame:
    """(idx, id, description, embedding) of a matrix with its ids; ids default to query_{idx}, descriptions to blank, bytes are decoded."""
    if matrix_key not in arrays:
        raise KeyError(f"no dataset {matrix_key}; available: {', '.join(sorted(arrays))}")
    x = np.atleast_2d(np.asarray(arrays[matrix_key], dtype=np.float32))
    text = lambda v: v.decode() if isinstance(v, bytes) else str(v)
    ids = [text(v) for v in arrays["ids"]] if "ids" in arrays else [f"query_{i}" for i in range(len(x))]
    about = [text(v) for v in arrays["descriptions"]] if "descriptions" in arrays else [""] * len(x)
    return spark.createDataFrame(pa.table({"idx": pa.array(range(len(x)), pa.int64()), "id": ids, "description": about, "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))


def parse_metadata(text: str) -> tuple[list[dict[str, str]], dict | None]:
    """(rows of id and description, embedder configuration) of a metadata file.

    Three shapes are read: an object with `metadata` and `embedder_config`, a list of objects, and a list of ids.
    """
    data = json.loads(text)
    config = data.get("embedder_config") if isinstance(data, dict) else None
    rows = data.get("metadata", []) if isinstance(data, dict) else data
    out = [{"id": r, "description": ""} if isinstance(r, str) else {"id": str(r.get("id", "")), "description": str(r.get("description", ""))} for r in rows]
    return out, config
