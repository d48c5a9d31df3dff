"""Rows of a key, one key after another, from Arrow batches of a partition that Spark has sorted by that key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a stream of batches; one batch at a time is held."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def by_key(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, rows of the key) for each run of equal first `width` columns; the rows are an iterator and are read once, in order.

    What is left of a key's rows is skipped when the next key is asked for. Keys may span batches; nulls are keys like others.
    """
    every = rows(batches)
    ahead = next(every, None)
    while ahead is not None:
        key = ahead[:width]

        def own(key: tuple = key) -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[:width] == key:
                now, ahead = ahead, next(every, None)
                yield now[width:]

        mine = own()
        yield key, mine
        for _ in mine:
            pass
