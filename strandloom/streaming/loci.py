"""Loci of a coordinate-sorted stream of alignments.

The state of a scaffold is one open locus. A record that begins beyond its end closes it (the stream
itself is the watermark); records that begin before the open locus does are out of order and fail
the query, never dropped. ``flush`` rows, whose start is null, close what is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "scaffold string, locus long, start long, end long, n long"
STATE = "locus long, start long, end long, n long, open boolean"


def advance(open_: tuple | None, number: int, rows: Iterator[tuple[int | None, int | None]]) -> tuple[tuple | None, int, list[tuple]]:
    """(open locus (start, end, n) or none, loci closed so far, newly closed ones) after rows in order."""
    closed = []
    for start, end in rows:
        if start is None or open_ is not None and start > open_[1]:
            if open_ is not None:
                number += 1
                closed.append((number, *open_))
            open_ = None if start is None else (start, end, 1)
        elif open_ is None:
            open_ = (start, end, 1)
        else:
            if start < open_[0]:
                raise ValueError(f"record at {start} comes after a locus that begins at {open_[0]}")
            open_ = (open_[0], max(open_[1], end), open_[2] + 1)
    return open_, number, closed


def locus_stream(records: DataFrame, *, scaffold: str = "scaffold", start: str = "start", end: str = "end", order: str = "ord") -> DataFrame:
    """Closed loci of a stream of (scaffold, start, end, ord) records; touching records share a locus."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, open_ = 0, None
        if state.exists:
            number, a, b, n, is_open = state.get
            open_ = (a, b, n) if is_open else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        pairs = ((None if pd.isna(s) else int(s), None if pd.isna(e) else int(e)) for s, e in zip(rows[start], rows[end], strict=True))
        open_, number, closed = advance(open_, number, pairs)
        state.update((number, *(open_ or (0, 0, 0)), open_ is not None))
        yield pd.DataFrame([(key[0], *c) for c in closed], columns=["scaffold", "locus", "start", "end", "n"])

    return records.groupBy(scaffold).applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
