"""Groups of rows that come sorted, without any task holding more than one and a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 1 << 12) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``, numbers without nulls.

    A table has about ``least`` rows or one group. What is held is the group
    that is not complete yet and the batches that came since the last table.
    """
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held)
        other = np.zeros(rows, bool)
        for k in keys:
            column = table[k].to_numpy()
            other |= column != column[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield table.slice(0, cut)
        held, rows = [table.slice(cut)], rows - cut
    if rows:
        yield pa.concat_tables(held)
