"""Runs of equal keys in partitions that are sorted by key, for mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches' rows in tables that never cut a run of the first column;
    no more is held than a batch and the run that it ends in."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1].column(0)[0].as_py() != key[0]):
            # everything before this batch's last run is complete
            yield pa.Table.from_batches([*held, b.slice(0, last)] if last else held)
            held = [b.slice(last)]
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of a sorted array."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])
