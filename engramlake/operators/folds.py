"""Outcomes that depend on order: rows of a key, one after another, with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a frame that a fold puts out.
OUT_ROWS = 5_000


class Step:
    """What a fold does with a key: ``row`` for each of its rows in order, ``end`` after the last. Both give rows to put out."""

    def row(self, r) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[], Step], schema: str) -> DataFrame:
    """Rows of each key go through a new ``step`` in ``order``; keys meet in tasks by hash and are sorted there.

    A task streams over its sorted rows and holds the state of one key only, so a key may have any
    number of rows. One key's rows are one after another by nature: they are one task's work.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for f in frames:
            for r in f.itertuples(index=False):
                mine = tuple(getattr(r, k) for k in keys)
                if state is None or mine != key:
                    out += state.end() if state else []
                    key, state = mine, step()
                out += state.row(r)
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        out += state.end() if state else []
        yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
