"""What a Python worker keeps between tasks, and how it reads a stored table."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem


def once_per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """The value of `make()`, made once per worker process and kept for later tasks of that process.

    Functions arrive by value, with fresh globals for every task; a module of its own name outlives them. Keep only what
    is the same for every task with this key, such as a loaded vocabulary.
    """
    name = "ratewright_worker_values"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def stored_batches(files: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """The rows of Parquet files, as `inputFiles()` names them, at most `rows` at a time.

    The files must lie in a folder that every executor can reach, as those of `session.stored` do. Schemes of Hadoop for
    S3 are read by the client of pyarrow, with its own credentials.
    """
    for uri in files:
        scheme, colon, rest = uri.partition(":")
        system, path = FileSystem.from_uri(f"{'s3' if scheme in {'s3a', 's3n'} else scheme}{colon}{rest}")
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(rows, use_threads=False):
                yield pa.Table.from_batches([batch])


class Memo(dict):
    """Values of a pure function, at most twice `size` of them.

    When the dictionary is full it becomes the old generation, replacing the one before; what is asked for again moves
    back. So memory is bounded, and frequent arguments stay.
    """

    def __init__(self, function: Callable[[Any], Any], size: int = 300_000):
        super().__init__()
        self.function, self.size, self.old = function, size, {}

    def keep(self, key: Any, value: Any) -> Any:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def known(self, key: Any) -> bool:
        """Whether the value is at hand; if so, it is in the young generation afterwards."""
        if key in self:
            return True
        if key in self.old:
            self.keep(key, self.old.pop(key))
            return True
        return False

    def __missing__(self, key: Any) -> Any:
        value = self.old.pop(key, None)
        return self.keep(key, self.function(key) if value is None else value)
