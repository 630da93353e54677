"""A shuffle of packed arrays: many small (key, place) rows travel as few binary rows, one for each bucket and map unit.

Map units combine first: they send a key that several of their own rows hold only once, so that no bucket gets more rows
of one key than there are units, however many rows hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spread(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts rows of a bucket together and sorts inside by place, limits of the buckets in that order)."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def pack(buckets: int, keys: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """Rows (bucket, keys, and each column as bytes)."""
    order, limits = spread(keys, buckets)
    out: dict[str, list] = {"bucket": [], "keys": [], **{k: [] for k in columns}}
    sorted_ = {"keys": keys[order], **{k: v[order] for k, v in columns.items()}}
    for b in range(buckets):
        lo, hi = limits[b], limits[b + 1]
        if hi > lo:
            out["bucket"].append(b)
            for k, v in sorted_.items():
                out[k].append(v[lo:hi].tobytes())
    return pa.record_batch([pa.array(out.pop("bucket"), pa.int64()), *(pa.array(v, pa.binary()) for v in out.values())], ["bucket", *out]) if out["bucket"] else None


def unpack(table: pa.Table, kinds: dict[str, np.dtype]) -> list[np.ndarray]:
    """The arrays of all rows of a bucket, joined."""
    return [np.frombuffer(b"".join(table[k].to_pylist()), kind) for k, kind in kinds.items()]
