"""Small helpers for operators that work on whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.session import ship

#: Texts are handed to the per-batch code in slices of about this many bytes, so long documents don't pile up.
SLICE_BYTES = 1 << 20
#: What a task remembers about words is bounded by about this many bytes; an entry costs ENTRY_BYTES beside its word.
CACHE_BYTES = 16 << 20
ENTRY_BYTES = 150

# ASCII upper case to lower case; every ASCII byte that is no letter or digit to a space. Bytes from 0x80 on stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    if not data.isascii():
        data = data.decode("utf-8", "replace").lower().encode()
    return data.translate(WORD_TABLE).split()


class HashCache(dict):
    """word -> number from ``make``, forgotten as a whole when it has grown to ``limit`` bytes."""

    def __init__(self, make: Callable[[bytes], int], limit: int = CACHE_BYTES):
        super().__init__()
        self.make, self.limit, self.used = make, limit, 0

    def __missing__(self, word: bytes) -> int:
        value = self.make(word)
        cost = len(word) + ENTRY_BYTES
        if self.used + cost > self.limit:
            self.clear()
            self.used = 0
        if cost <= self.limit:
            self[word] = value
            self.used += cost
        return value

    def array(self, words: list[bytes], dtype) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=dtype, count=len(words))


def hash64(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


_held: dict[Hashable, Any] = {}
_touched: set[Hashable] = set()


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process keeps for the next task of the same operator, as a loaded vocabulary."""
    if key not in _held:
        _held[key] = make()
    _touched.add(key)
    return _held[key]


def begin_task(make: Callable[[], Any]) -> Any:
    """What ``make`` gives; things that are held for other operators, so not asked for by it, are dropped."""
    _touched.clear()
    work = make()
    for key in set(_held) - _touched:
        del _held[key]
    return work


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with their texts as bytes (null: empty), each of about SLICE_BYTES or one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start = 0
    while start < len(sizes):
        total = np.cumsum(sizes[start:])
        stop = start + max(1, int(np.searchsorted(total, SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start), [x or b"" for x in texts.slice(start, stop - start).to_pylist()]
        start = stop


def map_texts(
    docs: DataFrame,
    keep: dict[str, str],
    fields: str,
    make: Callable[[], Callable[[list[bytes], pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]]],
    text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep`` (new name -> SQL expression) and computed ``fields``.

    ``make`` runs once in each task and returns a function of (texts as bytes, rest of the batch).
    Only the named columns are read, so further columns of ``docs`` neither cost nor clash.
    """
    ship(docs.sparkSession)
    kept = docs.select(*(F.expr(e).alias(f"_k_{n}") for n, e in keep.items()), F.col(text).cast("string").cast("binary").alias("text"))
    types = ", ".join(f"`{n}` {kept.schema[f'_k_{n}'].dataType.simpleString()}" for n in keep)
    schema = ", ".join(x for x in (types, fields) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin_task(make)
        for batch in batches:
            for part, texts in slices(batch):
                made = work(texts, part)
                columns = [part.column(part.schema.get_field_index(f"_k_{n}")) for n in keep]
                names = list(keep)
                for name, values in made.items():
                    columns.append(values if isinstance(values, pa.Array) else pa.array(values))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(run, schema)
