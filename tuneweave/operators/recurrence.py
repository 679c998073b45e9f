"""Linear recurrences ``y = a * y_before + b`` as scans of affine maps.

The map of a step is the pair ``(a, b)``; two maps in a row are one map again,
``(a2 * a1, a2 * b1 + b2)``, whatever is composed first. So a prefix of maps can be
built by doubling the reach of each pair, over flat arrays that hold many sequences at
once, instead of walking step by step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def affine_prefix(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefixes of the maps ``(a, b)`` in every segment; ``starts`` marks
    the first element of each. As many passes as the longest segment has binary digits,
    fewer where the products of ``a`` vanish."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    first = np.flatnonzero(starts)
    if not len(first):
        return a, b
    at = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    reach, longest = 1, int(at.max()) + 1
    while reach < longest:
        to = np.flatnonzero(at >= reach)
        to = to[a[to] != 0]  # a map that forgets what came before it is complete
        if not len(to):
            break
        new_b = b[to] + a[to] * b[to - reach]
        a[to], b[to] = a[to] * a[to - reach], new_b
        reach *= 2
    return a, b


def discounted_tails(x: np.ndarray, factor: float, ends: np.ndarray) -> np.ndarray:
    """``y = x + factor * y_after`` from the end of every segment; ``ends`` marks the
    last element of each."""
    a = np.full(len(x), factor)
    a[ends] = 0.0
    return affine_prefix(a[::-1], x[::-1], ends[::-1])[1][::-1]


def scan_batches(batches: Iterator[pa.RecordBatch], a: str, b: str, start: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows in order with columns ``a`` and ``b`` replaced by the
    prefixes of their maps; ``start`` is true where a sequence begins. A sequence that a
    batch cuts goes on in the next one."""
    carry = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names = batch.schema.names
        starts = batch.column(names.index(start)).to_numpy(zero_copy_only=False).astype(bool)
        maps = [batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in (a, b)]
        opened = starts.copy()
        if carry is not None and not starts[0]:
            maps[1][0] = maps[1][0] + maps[0][0] * carry[1]
            maps[0][0] = maps[0][0] * carry[0]
        opened[0] = True
        pa_, pb = affine_prefix(maps[0], maps[1], opened)
        carry = (pa_[-1], pb[-1])
        columns = list(batch.columns)
        columns[names.index(a)], columns[names.index(b)] = pa.array(pa_), pa.array(pb)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
