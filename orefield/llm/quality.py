"""Quality rules with thresholds from mergeable quantile sketches for each language and source.

The sketch of a metric is a table of counts over buckets of bounded relative width (1/16): (group, metric, bucket, n).
Sketches merge by adding counts, so a source's sketch comes from partial sums on every executor. What a source's sketch
says is mixed with its language's, and that with everything's, by numbers of texts: a small source leans on the wider
sketch, and no number of texts switches from one to the other.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.arrow import map_texts
from orefield.session import materialize

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
NOT_CHARS = BLANKS + bytes(range(0x80, 0xC0))
#: Rates per million, so that sketches and thresholds are whole numbers.
MILLION = 1_000_000
SUB = 4  # 2 ** SUB buckets for each power of two


@dataclass(frozen=True)
class Rule:
    """A text fails if its rate is surely over the fence of its group.

    The fence is the group's median and its spread. The spread is twice the way from the median to a high quantile,
    ``high`` in percent, that is taken to be sound: symbols, stutter and word length may be junk in a tenth of the texts,
    repeats are ordinary in long ones. Quantiles are buckets: the upper ends of the median's and the high one's count, the
    lower end of the median's for the spread, so an even group has a spread of two buckets at least. Nor is the spread
    less than what one occurrence makes of a text of the group's median length, as rates are no finer than that.
    "Surely" means by DEVIATIONS of the count that the fence expects of a text of that length, or of a count of 1.
    """

    metric: str
    top: str
    bottom: str
    high: int


RULES = (
    Rule("symbol_rate", "n_symbols", "n_words", 90),
    Rule("dup_line_rate", "n_dup_lines", "n_lines", 99),
    Rule("repeat_rate", "n_repeat_words", "n_words", 99),
    Rule("stutter_rate", "n_stutter", "n_words", 90),
    Rule("word_length", "word_chars", "n_words", 90),
)
DEVIATIONS = 3
#: The texts as which the wider sketch counts beside a group's own ones, for the median and for the spread.
MEDIAN_PRIOR, SPREAD_PRIOR = 20, 200


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that stand twice or more in the text, the first included; exact."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    v = len(ids)
    grams = number[:n].copy()
    size = v
    for k in range(1, width):
        if size * v >= 1 << 62:
            values, grams = np.unique(grams, return_inverse=True)
            size = len(values)
        grams = grams * v + number[k : k + n]
        size *= v
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(data: bytes) -> tuple[int, ...]:
    """The counts NAMES of a text; n_stutter counts words equal to the word before."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(data.translate(None, NOT_CHARS)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(eq, words, words[1:])),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, g0, g1, the counts, base_failed) for each row of docs; null texts have no words."""

    def make():
        def work(texts, _):
            table = np.array([measures(t) for t in texts], dtype=np.int64).reshape(-1, len(NAMES))
            return {n: np.ascontiguousarray(table[:, i]) for i, n in enumerate(NAMES)}

        return work

    keep = {"doc_id": f"`{id_col}`"} | {f"g{i}": f"coalesce(cast(`{g}` as string), '')" for i, g in enumerate(groups)}
    out = map_texts(docs, keep, ", ".join(f"{n} long" for n in NAMES), make, text_col)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rate(rule: Rule) -> Column:
    return F.when(F.col(rule.bottom) > 0, F.expr(f"{rule.top} * {MILLION} div {rule.bottom}")).otherwise(F.lit(0).cast("long"))


def bucket(value: Column) -> Column:
    """The value's leading SUB + 1 bits: the lower end of its bucket; values under 2 ** SUB stand for themselves."""
    drop = F.greatest(F.length(F.bin(value)) - (SUB + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame) -> DataFrame:
    """(g0, g1, metric, bucket, n) of the rules' rates and of the texts' lengths; texts that fail the base rules are left out."""
    values = {r.metric: rate(r) for r in RULES} | {r.bottom: F.col(r.bottom) for r in RULES}
    rates = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in values.items()))).alias("x")
    rows = measured.where("not base_failed").select("g0", "g1", rates)
    return rows.groupBy("g0", "g1", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def top(low: Column) -> Column:
    """The upper end of the bucket with this lower end."""
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(low)) - (SUB + 1), F.lit(0))) - 1


def mixed(own: Column, n: Column, wider: Column, prior: int, by_ratio: bool = False) -> Column:
    """The mean of a group's value over its n texts and of the wider one's over ``prior`` texts, in whole numbers.

    ``by_ratio``: the geometric mean, for spreads, as a group of which much is junk has one many times too large.
    """
    n = n.cast("double")
    if by_ratio:
        return F.round(F.exp((n * F.ln(own) + float(prior) * F.ln(wider)) / (n + float(prior)))).cast("long")
    return F.floor((n * own + float(prior) * wider) / (n + float(prior)))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(g0, g1, metric, fence) for each group of the sketch and each rule."""
    percent = F.create_map(*(F.lit(x) for r in RULES for x in (r.metric, r.high)))
    length = F.create_map(*(F.lit(x) for r in RULES for x in (r.metric, r.bottom)))
    found = None
    for level, keys in enumerate(([], ["g0"], ["g0", "g1"])):
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        each = Window.partitionBy(*keys, "metric")
        ranked = merged.withColumn("up", F.sum("n").over(each.orderBy("bucket"))).withColumn("total", F.sum("n").over(each))
        least = lambda share, of: F.min(F.when(F.col("up") * of >= F.col("total") * share, F.col("bucket")))
        quantiles = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), least(1, 2).alias("middle"), least(F.coalesce(percent[F.col("metric")], F.lit(50)), 100).alias("high"))
        lengths = quantiles.select(*keys, F.col("metric").alias("length"), F.col("middle").alias("typical"))
        rules = quantiles.withColumn("length", length[F.col("metric")]).where("length is not null").join(lengths, [*keys, "length"])
        finest = F.expr(f"greatest({MILLION} div greatest(typical, 1), 1)")
        own = rules.select(*keys, "metric", "n", top(F.col("middle")).alias("m"), F.greatest(2 * (top(F.col("high")) - F.col("middle")), finest).alias("s"))
        if level:
            wider = found.withColumnsRenamed({"m": "wm", "s": "ws"})
            own = own.join(wider, [*keys[:-1], "metric"])
            own = own.select(*keys, "metric", mixed(F.col("m"), F.col("n"), F.col("wm"), MEDIAN_PRIOR).alias("m"), mixed(F.col("s"), F.col("n"), F.col("ws"), SPREAD_PRIOR, by_ratio=True).alias("s"))
        else:
            own = own.drop("n")
        found = own
    return found.select("g0", "g1", "metric", (F.col("m") + F.col("s")).alias("fence"))


def fences(limits: DataFrame) -> DataFrame:
    """(g0, g1, then for each rule its fence): one row for each group."""
    return limits.groupBy("g0", "g1").agg(*(F.max(F.when(F.col("metric") == r.metric, F.col("fence"))).alias(f"max_{r.metric}") for r in RULES))


def over(rule: Rule) -> Column:
    """Whether the count is over what the fence expects by DEVIATIONS; both sides times a million, so in whole numbers."""
    expected = (F.col(f"max_{rule.metric}") * F.greatest(rule.bottom, F.lit(1))).cast("double")
    beyond = F.col(rule.top).cast("double") * MILLION - expected
    return (beyond > 0) & (beyond * beyond > DEVIATIONS**2 * float(MILLION) * F.greatest(expected, F.lit(float(MILLION))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, reasons): a row for each row of docs.

    Null and empty texts have no words and so fail the base rules; null groups are groups of their own. A group whose
    texts all fail has no threshold and needs none. Repeated rows count as often as they stand there.
    """
    measured = materialize(metrics(docs, id_col, text_col, groups), "metrics")
    sketch = materialize(sketches(measured), "sketch")
    limits = materialize(fences(thresholds(sketch)), "fences")
    broken = F.array_compact(F.array(*(F.when(over(r), F.lit(r.metric)) for r in RULES)))
    judged = measured.join(limits, ["g0", "g1"], "left").withColumn("reasons", broken)
    return judged.select("doc_id", *NAMES, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")
