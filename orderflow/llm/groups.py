"""Whole groups out of sorted partitions, for functions that run in ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key after another. The partition holds a key's rows together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for values in columns:
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(values[a] for values in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def reach(n: int, near) -> np.ndarray:
    """For each of ``n`` members the smallest member that links reach.

    ``near(i, rest)`` says which of the members ``rest`` member ``i`` links with. A member is
    compared only with those that no link has reached yet.
    """
    root = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            found = rest[hit]
            root[found] = seed
            queue.extend(found.tolist())
            rest = rest[~hit]
    return root
