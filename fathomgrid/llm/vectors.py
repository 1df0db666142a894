"""Reading vector columns in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_length(ids: pa.Array, vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each vector length; without null ids and vectors that are null, empty or hold
    null or non-finite components."""
    out: dict[int, list] = {}
    for i, v in zip(ids.to_pylist(), vectors):
        if i is None or not v.is_valid or len(v) == 0 or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            out.setdefault(len(x), []).append((i, x))
    return [(np.array([i for i, _ in rows], np.int64), np.stack([x for _, x in rows])) for _, rows in sorted(out.items())]
