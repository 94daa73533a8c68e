"""Groups of sorted rows as they stream through a task, so that it holds one group and one Arrow batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``keys``, across batches; null is a key."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for at in range(1, len(names) + 1):
            if at < len(names) and names[at] == names[start]:
                continue
            if held and names[start] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, at - start))
            current, start = names[start], at
    if held:
        yield current, pa.Table.from_batches(held)
