"""Arrow batches for mapInArrow: ids keep their nulls and all their bits."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa

TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def batch_of(schema: str, columns: Mapping[str, object]) -> pa.RecordBatch:
    """A batch with the columns of a DDL schema such as "id long, text string"."""
    names, arrays = [], []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        x, t = columns[name], TYPES[kind]
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        names.append(name)
        arrays.append(x.cast(t) if isinstance(x, pa.Array) else pa.array(np.asarray(x) if isinstance(x, np.ndarray) else x, type=t))
    return pa.RecordBatch.from_arrays(arrays, names=names)
