"""Embedding by named providers, in batches with retries and a fallback for the items that fail."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.session import ship

#: A provider is made once a task, for a number of dimensions, and turns texts into as many vectors. It may raise.
Provider = Callable[[list[str]], list]
PROVIDERS: dict[str, Callable[[int], Provider]] = {}
BATCH, RETRIES = 100, 3
#: What is embedded in place of a text that fails.
FALLBACK = " "


def provider(name: str) -> Callable[[Callable[[int], Provider]], Callable[[int], Provider]]:
    def add(make: Callable[[int], Provider]) -> Callable[[int], Provider]:
        if name in PROVIDERS:
            raise ValueError(f"two providers are named {name}")
        PROVIDERS[name] = make
        return make

    return add


def _hashed(dims: int, prefix: str) -> Provider:
    def one(text: str) -> np.ndarray:
        seed = prefix + (text or "__EMPTY__")
        digests = b"".join(hashlib.sha256(f"{seed}:salt_{i}".encode()).digest() for i in range((dims + 7) // 8))
        v = np.frombuffer(digests, ">i4")[:dims] / 2.0**31
        norm = np.sqrt((v * v).sum())
        return v / norm if norm else v

    return lambda texts: [one(t) for t in texts]


@provider("hash")
def hashed(dims: int) -> Provider:
    """A deterministic unit vector, equal to ``functions.vectors.hash_vector``."""
    return _hashed(dims, "")


@provider("chemical_hash")
def hashed_structure(dims: int) -> Provider:
    """The same for structures, which a prefix keeps apart from texts."""
    return _hashed(dims, "chem_text:")


def embed_all(texts: list[str], embed: Provider, dims: int, retries: int = RETRIES) -> list[tuple[list[float], str | None]]:
    """(vector, error) of each text: a batch that fails ``retries`` times is halved, down to the items that fail.

    Such an item gets the fallback's vector and the error's text. A vector of other dimensions is an error of its batch.
    If the fallback fails too, that is raised.
    """
    if not texts:
        return []
    error: Exception | None = None
    for _ in range(retries + 1):
        try:
            made = [[float(x) for x in v] for v in embed(texts)]
            if len(made) != len(texts) or any(len(v) != dims for v in made):
                raise ValueError(f"expected {len(texts)} vectors of {dims} dimensions")
            return [(v, None) for v in made]
        except Exception as e:  # whatever a provider raises, the others' vectors are wanted
            error = e
    if len(texts) == 1:
        if texts[0] == FALLBACK:
            raise error
        return [(embed_all([FALLBACK], embed, dims, retries)[0][0], f"{type(error).__name__}: {error}")]
    half = len(texts) // 2
    return embed_all(texts[:half], embed, dims, retries) + embed_all(texts[half:], embed, dims, retries)


def embed(df: DataFrame, text: str, dims: int, name: str = "hash", batch: int = BATCH, retries: int = RETRIES, made: Callable[[int], Provider] | None = None) -> DataFrame:
    """All columns of df, embedding array<double>, model and error; the provider is the one of that name, or ``made``.

    Null texts count as empty. Columns of df that are named like the three new ones give way to them.
    """
    ship(df.sparkSession)
    make = made or PROVIDERS[name]
    names = [c for c in df.columns if c not in ("embedding", "model", "error")]
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make(dims)
        for rest in batches:
            for start in range(0, len(rest), batch):
                part = rest.slice(start, batch)
                vectors, errors = zip(*embed_all(part.column(len(names)).to_pylist(), call, dims, retries))
                new = [pa.array(vectors, pa.list_(pa.float64())), pa.array([name] * len(part)), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*part.schema.names[:-1], "embedding", "model", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "t")
    out = rows.mapInArrow(run, f"{fields}, embedding array<double>, model string, error string")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "embedding", "model", "error")


def with_structures(chunks: DataFrame, structures: str = "structures") -> DataFrame:
    """A row for each distinct, non-blank structure of a chunk, as ``structure``: what a structure provider embeds."""
    own = F.array_distinct(F.filter(F.transform(structures, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))
    return chunks.withColumn("structure", F.explode(own))
