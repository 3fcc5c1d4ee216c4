"""Results as a stream of frames: a start with the columns, the rows, an end with their number.

Rows come partition by partition, so the driver holds one partition at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from larkspur.engine import ResultColumn, Rows, translated
from larkspur.errors import ResultTooLarge

DEFAULT_MOST_ROWS = 100_000


@dataclass(frozen=True)
class Start:
    columns: tuple[ResultColumn, ...]


@dataclass(frozen=True)
class Row:
    values: tuple


@dataclass(frozen=True)
class End:
    rows: int


def frames(rows: Rows, most: int = DEFAULT_MOST_ROWS) -> Iterator[Start | Row | End]:
    """Raises :class:`ResultTooLarge` in place of the row beyond ``most``."""
    yield Start(rows.columns)
    n = 0
    with translated():
        for r in rows.frame.limit(most + 1).toLocalIterator():
            n += 1
            if n > most:
                raise ResultTooLarge(most)
            yield Row(rows.python(r))
    yield End(n)
