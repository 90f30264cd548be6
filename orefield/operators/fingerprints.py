"""Structure fingerprints from line notations, and all pairs above a similarity.

A notation is cut into atoms, bonds, branches and ring marks; each run of up to three of these sets one of 1024 bits by
its hash. Fingerprints are kept as packed longs. Without a molecule toolkit these are runs along the notation, not atom
neighbourhoods, so notations should be in one canonical form.

Pairs are found without comparing all: of two sets of x and y bits with a Tanimoto similarity of at least t, the rarest
common bit is among the x - a + 1 rarest of the one and the y - a + 1 of the other, a = ceil(t / (1 + t) * (x + y)),
and x * t <= y <= x / t. Equal fingerprints are one class, however many structures have them, and the structures of a class
go in blocks, so what is joined and shuffled grows with the structures and only the rows told grow with their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.session import materialize, spread

BITS = 1024
LONGEST = 3
THRESHOLD = 0.5
#: Keys of one fingerprint that are paired as one row; a pair of blocks gives the square of it.
BLOCK = 1024
#: A bracket atom, a two-letter atom, a ring number over 9, or a single sign.
TOKEN = r"(\[[^\]]*\]|Br|Cl|%\d\d|.)"


def bits(notation: Column, size: int = BITS, longest: int = LONGEST) -> Column:
    """The set bits in order; null and blank notations have none."""
    tokens = F.regexp_extract_all(F.coalesce(F.trim(notation), F.lit("")), F.lit(TOKEN), F.lit(1))

    def runs(t: Column) -> Column:
        own = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*(own(n) for n in range(1, longest + 1))))

    place = lambda run: (F.conv(F.substring(F.md5(run.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(F.array(tokens), runs)), place)))


def packed(set_bits: Column, size: int = BITS) -> Column:
    """array<long>, bit b in word b / 64."""
    word = lambda w: F.aggregate(F.filter(set_bits, lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)))
    return F.transform(F.sequence(F.lit(0), F.lit(size // 64 - 1)), word)


def common(a: Column, b: Column) -> Column:
    """Bits set in both packed fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)


def vector(set_bits: Column, size: int = BITS) -> Column:
    """The fingerprint as an embedding: 0.0 or 1.0 in each dimension."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.array_contains(set_bits, i), 1.0).otherwise(0.0))


def _classes(rows: DataFrame, key: str, notation: str) -> tuple[DataFrame, DataFrame]:
    """(no, ids) of all rows with a bit, about BLOCK keys of one fingerprint in a row, and (no, fp, on, ones) of the distinct fingerprints.

    Each distinct notation is cut once, on notations dealt over the cluster; fp is the packed fingerprint, no its number.
    """
    texts = spread(rows.groupBy(F.col(notation).alias("notation")).agg(F.count("*").alias("members")))
    # The filter is put on the table, else Spark moves it under the grouping and cuts every row's notation.
    texts = materialize(texts.withColumn("on", bits(F.col("notation"))), "fingerprints").where(F.size("on") > 0)
    classes = texts.groupBy("on").agg(F.sum("members").alias("members"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("no"), "on", packed(F.col("on")).alias("fp"), F.size("on").alias("ones"), "members"), "classes")
    known = texts.select("notation", "on").join(classes, "on").select("notation", "no", "members")
    held = rows.select(key, F.col(notation).alias("notation")).join(known.hint("merge"), "notation")
    block = F.pmod(F.xxhash64(key), F.ceil(F.col("members") / BLOCK))
    # Sorted, so that a task run again deals the same rows; in structs, as lists drop nulls.
    ids = F.transform(F.sort_array(F.collect_list(F.struct(key))), lambda r: r[key])
    return held.groupBy("no", block.alias("block")).agg(ids.alias("ids")).drop("block"), classes.drop("members")


def similar(
    queries: DataFrame, entities: DataFrame, least: float = THRESHOLD, query_id: str = "query_id", id_col: str = "id", notation: str = "smiles", digits: int | None = None
) -> DataFrame:
    """(query_id, id, score): all pairs whose Tanimoto similarity is at least ``least``, over 0; scores rounded to ``digits``.

    Structures without a notation have no partner. Every pair is there, so as many as are that similar; they are told last,
    from pairs of blocks of keys that are dealt over the cluster, and a score is worked out and rounded once for each pair of fingerprints.
    """
    asked, a = _classes(queries.withColumnRenamed(query_id, "query_id"), "query_id", notation)
    own, b = _classes(entities.withColumnRenamed(id_col, "id"), "id", notation)
    # At most BITS rows.
    often = b.select(F.explode("on").alias("bit")).groupBy("bit").agg(F.count("*").alias("often"))
    share = least / (1 + least)

    def rarest(classes: DataFrame, side: str) -> DataFrame:
        rows = classes.select("no", "fp", "ones", F.explode("on").alias("bit")).join(F.broadcast(often), "bit", "left").na.fill(0, ["often"])
        place = F.row_number().over(Window.partitionBy("no").orderBy("often", "bit"))
        # The least that any partner's size asks for; the exact bound follows the join.
        rows = rows.withColumn("place", place).where(F.col("place") <= F.col("ones") - F.ceil(least * F.col("ones") - 1e-9) + 1)
        return rows.select("bit", *(F.col(c).alias(f"{c}_{side}") for c in ("no", "fp", "ones", "place")))

    need = F.ceil(share * (F.col("ones_q") + F.col("ones_e")) - 1e-9)
    pairs = rarest(a, "q").join(rarest(b, "e"), "bit")
    pairs = pairs.where((F.col("ones_e") >= least * F.col("ones_q") - 1e-9) & (F.col("ones_e") * least <= F.col("ones_q") + 1e-9))
    pairs = pairs.where((F.col("place_q") <= F.col("ones_q") - need + 1) & (F.col("place_e") <= F.col("ones_e") - need + 1))
    pairs = pairs.select("no_q", "no_e", "fp_q", "fp_e", "ones_q", "ones_e").distinct()
    both = common(F.col("fp_q"), F.col("fp_e"))
    scored = pairs.withColumn("both", both).withColumn("score", F.col("both") / (F.col("ones_q") + F.col("ones_e") - F.col("both"))).where((F.col("score") >= least) & (F.col("score") > 0))
    score = F.col("score") if digits is None else F.round("score", digits)
    scored = materialize(scored.select("no_q", "no_e", score.alias("score")), "scored")
    found = scored.join(asked.toDF("no_q", "query_ids"), "no_q").join(own.toDF("no_e", "ids"), "no_e")
    # A transform keeps Spark from making one function of both explodes, which would copy a pair's rows, a million, before it passes one on.
    each = F.explode(F.transform("query_ids", lambda q: q))
    found = spread(found.select("score", "query_ids", "ids")).select("score", "ids", each.alias("query_id"))
    return found.select("query_id", F.explode("ids").alias("id"), "score")
