"""Vector arithmetic on array columns, accumulated in doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0.0 where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    square = F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def l2_normalize(a: Column | str) -> Column:
    """A zero vector stays zero."""
    scale = lambda x: F.when(x["n"] == 0, x["v"]).otherwise(F.transform(x["v"], lambda y: y / x["n"]))
    return _bound(_bound(_double(a), lambda v: F.struct(v.alias("v"), norm(v).alias("n"))), scale)


def check_dimensions(a: Column | str, dims: int) -> Column:
    """The vector, or an error if it doesn't have this many numbers."""
    wrong = lambda v: F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, got "), F.size(v).cast("string")))
    return _bound(F.col(a) if isinstance(a, str) else a, lambda v: F.when(F.size(v) == dims, v).otherwise(wrong(v)))


def hash_vector(text: Column | str, dims: int, prefix: str = "") -> Column:
    """A deterministic unit vector: eight signed 32-bit numbers from each of sha256(text + ':salt_i')."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.concat(F.lit(prefix), F.when(c == "", F.lit("__EMPTY__")).otherwise(c))
    digests = F.transform(F.sequence(F.lit(0), F.lit((dims + 7) // 8 - 1)), lambda i: F.sha2(F.concat(c, F.lit(":salt_"), i.cast("string")), 256))

    def numbers(h: Column) -> Column:
        def one(k: Column) -> Column:
            x = F.conv(F.substr(h, k * 8 + 1, F.lit(8)), 16, 10).cast("double")
            return F.when(x >= 2.0**31, x - 2.0**32).otherwise(x) / F.lit(2.0**31)

        return F.transform(F.sequence(F.lit(0), F.lit(7)), one)

    return l2_normalize(F.slice(F.flatten(F.transform(digests, numbers)), 1, dims))
