"""Functions of one row's lists, run over a few rows of an Arrow batch at a time.

Python objects take many times what the same lists take in Arrow, and a batch may hold
thousands of texts or files.  So a batch is halved until a part is small, each part is turned
into objects, worked on and turned back, and only then the next one is begun: what a task holds
as objects does not grow with the rows of its batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Arrow bytes and rows of a part; a single row may be larger.
PART_BYTES, PART_ROWS = 1 << 16, 256


def parts(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of a batch in order, as slices of ``PART_BYTES`` and ``PART_ROWS`` at most, or of one row."""
    todo = [(0, len(columns[0]))]
    while todo:
        at, n = todo.pop()
        own = tuple(c.slice(at, n) for c in columns)
        if n > 1 and (n > PART_ROWS or sum(c.nbytes for c in own) > PART_BYTES):
            todo += [(at + n // 2, n - n // 2), (at, n // 2)]
        else:
            yield own


def by_row(function: Callable, returns: str, *columns: Column) -> Column:
    """``function`` of each row's values, as plain Python objects with None for null, as a column of type ``returns``."""
    kind = to_arrow_type(_parse_datatype_string(returns))

    def over(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for own in parts(batch):
                yield pa.array([function(*row) for row in zip(*(c.to_pylist() for c in own), strict=True)], kind)

    # The number of arguments is told by the type hint.
    if len(columns) == 1:

        @F.arrow_udf(returns)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from over((b,) for b in batches)

    else:

        @F.arrow_udf(returns)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from over(batches)

    return run(*columns)
