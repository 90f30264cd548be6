"""Toxic passages: maximum-scoring segments of word log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.arrow import CACHE_BYTES, ENTRY_BYTES, HashCache, begin_task, hash64, map_texts, plain_words, slices
from orefield.session import discard, materialize

#: Words and their first five and six bytes are counted in two tables of this many hash buckets, which bounds the model at any size
#: of the corpus. A piece counts by the smaller of its two weights, so a chance meeting in one table does nothing.
HALF = 1 << 20
BUCKETS = 2 * HALF
STEMS = (5, 6)
#: The word statistics and the calibration are fitted on at most about this many labelled rows.
LABELLED_ROWS = 1 << 18
SHINGLE = 5  # words of the runs that tell near-copies among the labelled rows
PRIOR_WORDS = 2000.0  # weight of the Dirichlet prior, in counts, spread as all words are
FLOOR = 0.5  # and the least that every bucket gets
SIGMAS = 3.0  # a piece counts by as much as its log-odds surely exceed zero
DRIFT = 0.25  # taken from every word's log-odds: neutral text then runs downhill
BIN, BINS = 0.25, 400
LOW, STEP, STEPS = -8.0, 0.125, 192  # the histogram of word scores
DISTINCT = 50_000  # words counted by a task before they go into its buckets
SCORED = 50_000  # new words that are scored at once
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray  # float32 shrunk log-odds of each bucket
    lam: float = 1.0  # Karlin-Altschul lambda and K of the non-toxic word scores
    k: float = 1.0
    slope: float = 1.0
    bias: float = -2.0


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, buckets in both tables) of the pieces of all words: each word and its stems.

    Inflected and compound forms share stems.
    """
    named, owner = [b"^%b$" % w for w in words], list(range(len(words)))
    for n in STEMS:
        long = [i for i, w in enumerate(words) if len(w) >= n]
        owner += long
        named += [b"^" + words[i][:n] for i in long]
    hashes = np.fromiter(map(hash64, named), np.uint64, len(named))
    return np.array(owner, np.int64), np.stack([hashes % np.uint64(HALF), np.uint64(HALF) + (hashes >> np.uint64(32)) % np.uint64(HALF)]).astype(np.int64)


class WordScores(dict):
    """word -> the log-odds of its most toxic form, less the drift; forgotten as a whole when grown to ``limit`` bytes."""

    def __init__(self, weights: np.ndarray, limit: int = CACHE_BYTES):
        super().__init__()
        self.weights, self.limit, self.used = weights, limit, 0

    def array(self, words: list[bytes]) -> np.ndarray:
        """The scores of the words of one text; words new to a long text are scored SCORED at a time."""
        if self.used > self.limit:
            self.clear()
            self.used = 0
        new = [w for w in set(words) if w not in self]
        for i in range(0, len(new), SCORED):
            part = new[i : i + SCORED]
            owner, buckets = pieces(part)
            best = np.full(len(part), -np.inf, np.float32)
            np.maximum.at(best, owner, self.weights[buckets].min(axis=0))
            self.update(zip(part, (best.astype(np.float64) - DRIFT).tolist()))
        self.used += sum(map(len, new)) + ENTRY_BYTES * len(new)
        return np.fromiter(map(self.__getitem__, words), np.float32, len(words))


def remainder(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) by the linear scan of Ruzzo and Tompa (1999).

    Neighbours of the same sign are summed first; that changes no maximal segment.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(up)) + 1
    starts = np.concatenate([[0], edges])
    sums = np.add.reduceat(scores.astype(np.float64), starts)
    ends = np.concatenate([edges, [len(scores)]])
    stack: list[list] = []  # [left sum, right sum, start, end]
    total = 0.0
    for a, b, x in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if x <= 0:
            total += x
            continue
        new = [total, total + x, a, b]
        total += x
        while stack:
            j = len(stack) - 1
            # The nearest earlier segment that starts lower; a climbing minimum lets whole blocks be passed at once.
            while j >= 0 and stack[j][0] >= new[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                new.append(j)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        else:
            new.append(-1)
        stack.append(new)
    return [(s[2], s[3], s[1] - s[0]) for s in stack]


def statistic(found: list[tuple[int, int, float]], n_words: int, model: Model) -> float:
    """Sum over the segments of their normalised scores, lambda * S - ln(K * n), where these are positive."""
    base = math.log(max(model.k * n_words, 1e-12))
    return sum(max(0.0, model.lam * s - base) for _, _, s in found)


def least_shingles(hashes: np.ndarray) -> tuple[int, int]:
    """The least value of two hashes over the runs of SHINGLE words (fewer words: the whole text; none: zeros)."""
    n = min(SHINGLE, len(hashes))
    if not n:
        return 0, 0
    runs = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        runs = (runs ^ hashes[i : i + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return int(runs.min()), int((runs * np.uint64(0xC2B2AE3D27D4EB4F)).min())


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with their label; the labels are cut to LABELLED_ROWS by a hash of the id, so they may be broadcast."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic is not null")
    known = known.where(remainder("_id") != 2)
    n = known.count()
    if n > LABELLED_ROWS:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * LABELLED_ROWS / n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "_id")
    rows = rows.select("text", "toxic", (remainder("_id") == 3).alias("tune"))

    def make():
        cache = HashCache(hash64)

        def work(texts, _):
            least = [least_shingles(cache.array(plain_words(t), np.uint64)) for t in texts]
            return {"a": np.array([x for x, _ in least], np.uint64).view(np.int64), "b": np.array([y for _, y in least], np.uint64).view(np.int64)}

        return work

    # Copies and near-copies mostly share two least shingle hashes; one of them speaks for all, or a copied text's own
    # words would look like evidence. The map side keeps one text of each key already, that of the least hash, so the
    # model doesn't depend on the order of rows.
    keyed = map_texts(rows, {"toxic": "toxic", "tune": "tune", "text": "text"}, "a long, b long", make)
    return keyed.groupBy("a", "b", "toxic").agg(F.min("tune").alias("tune"), F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", "tune")


def _count(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, n) over the pieces of all words of the rows, each once for a row."""
    source = rows.select(F.col("text").cast("string").cast("binary").alias("text"), "toxic")

    def run(batches):
        sums = begin_task(lambda: np.zeros((2, BUCKETS), np.int32))  # a task has fewer rows than that holds
        words = (Counter(), Counter())

        def pour(t: int) -> None:
            owner, buckets = pieces(list(words[t]))
            times = np.fromiter(words[t].values(), np.int32, len(words[t]))[owner]
            for own in buckets:
                np.add.at(sums[t], own, times)
            words[t].clear()

        for batch in batches:
            for part, texts in slices(batch):
                for text, toxic in zip(texts, part.column(1).to_pylist()):
                    words[toxic != 0].update(set(plain_words(text)))
                    if len(words[toxic != 0]) > DISTINCT:
                        pour(int(toxic != 0))
        for t in (0, 1):
            pour(t)
            some = np.flatnonzero(sums[t])
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), t, np.int8)), pa.array(sums[t][some])], names=["bucket", "toxic", "n"]
            )

    counted = source.mapInArrow(run, "bucket int, toxic byte, n int")
    return counted.groupBy("bucket", "toxic").agg(F.sum("n").cast("int").alias("n"))


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior, shrunk by SIGMAS deviations towards 0."""
    both = toxic + clean
    prior = FLOOR + PRIOR_WORDS * both / max(both.sum(), 1)
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (toxic.sum() + PRIOR_WORDS)) - np.log(b / (clean.sum() + PRIOR_WORDS))
    sigma = np.sqrt(1 / a + 1 / b)
    return np.sign(delta) * np.maximum(0, np.abs(delta) - SIGMAS * sigma)


def karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * score)) = 1, at most 5; without positive scores there is no root."""
    p = weights / max(weights.sum(), 1)
    if not (p[scores > 0] > 0).any():
        return 5.0
    if (p * scores).sum() >= 0:
        return 0.1
    low, high = 1e-6, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 5:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return min((low + high) / 2, 5.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Word statistics from two of four parts of the labels, extreme values and the final curve from a third.

    The fourth part, crc32(doc_id) mod 4 = 2, is never read. Without labels all scores are low. The model depends on the
    rows alone, not on their order or partitions.
    """
    rows = materialize(_labelled(docs, labels, id_col, text_col), "labelled")
    counts = np.zeros((2, BUCKETS))
    # Passages that many documents share would count once for each; every distinct line speaks once for each label.
    lines = rows.where("not tune").select("toxic", F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.groupBy(F.xxhash64("text"), "toxic").agg(F.min("text").alias("text"))
    # At most 2 * BUCKETS rows of 9 bytes, 38 MB, come to the driver at any size of the corpus.
    for r in _count(lines).toArrow().to_batches():
        counts[r.column(1).to_numpy(), r.column(0).to_numpy()] = r.column(2).to_numpy()
    model = Model(log_odds(counts[1], counts[0]).astype(np.float32))
    tune = materialize(_segment_scores(rows.where("tune"), model), "tune")
    steps = tune.where("toxic = 0").select(F.posexplode("hist").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(STEPS)
    for i, n in steps:
        seen[i] = n
    model.lam = karlin_lambda(LOW + STEP * (np.arange(STEPS) + 0.5), seen)
    # K by maximum likelihood over the clean documents: their number over the sum of n * exp(-lambda * S).
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    clean = tune.where("toxic = 0").agg(F.count("*"), F.sum(F.col("n_words") * F.exp(-F.lit(model.lam) * top))).first()
    if clean[0]:
        # Nine digits: the sum's last ones depend on the order of its terms.
        model.k = float(f"{min(max(clean[0] / max(clean[1] or 0.0, 1e-9), 1e-6), 1e3):.9g}")
    base = F.log(F.greatest(F.lit(model.k) * F.greatest("n_words", F.lit(1)), F.lit(1e-12)))
    total = F.aggregate("scores", F.lit(0.0), lambda x, s: x + F.greatest(F.lit(0.0), F.lit(model.lam) * s - base))
    hist = np.zeros((2, BINS))
    for r in tune.groupBy(F.least(F.floor(total / BIN), F.lit(BINS - 1)).alias("x"), "toxic").count().collect():
        hist[int(r[1] != 0), r[0]] += r[2]
    discard(tune)
    discard(rows)
    model.slope, model.bias = logistic(hist)
    return model


def logistic(hist: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """(slope, bias) of log(1 + x) against the label, x at the bins' lower ends, by Newton steps with a weak ridge."""
    x = np.log1p(np.arange(hist.shape[1]) * BIN)
    n, y = hist.sum(axis=0), hist[1]
    if not y.sum() or y.sum() == n.sum():
        return 1.0, -2.0
    w = np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([((p - y / np.maximum(n, 1)) * n * x).sum(), ((p - y / np.maximum(n, 1)) * n).sum()]) + ridge * np.array([w[0] - 1, 0])
        q = n * p * (1 - p) + 1e-9
        h = np.array([[(q * x * x).sum() + ridge, (q * x).sum()], [(q * x).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _segment_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n_words, scores, hist): the scores of all maximal segments, and a histogram of the word scores."""

    def make():
        cache = WordScores(model.weights)

        def work(texts, _):
            values = [cache.array(plain_words(t)) for t in texts]
            bins = [np.bincount(np.clip((v - LOW) / STEP, 0, STEPS - 1).astype(np.int64), minlength=STEPS) for v in values]
            scores = [[s for _, _, s in segments(v)] for v in values]
            return {"n_words": [len(v) for v in values], "scores": pa.array(scores, type=pa.list_(pa.float64())), "hist": pa.array(bins, type=pa.list_(pa.int64()))}

        return work

    return map_texts(rows, {"toxic": "toxic"}, "n_words long, scores array<double>, hist array<long>", make)


PASSAGES = "n_words long, top double, statistic double, score double, passages array<struct<first:bigint,end:bigint,score:double,e_value:double>>"


def _passages(docs: DataFrame, keep: dict[str, str], model: Model, text_col: str, e_value: float = 0.05) -> DataFrame:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def make():
        cache = WordScores(model.weights)

        def work(texts, _):
            n_words, tops, stats, told = [], [], [], []
            for t in texts:
                scores = cache.array(plain_words(t))
                found = segments(scores)
                n = max(1, len(scores))
                n_words.append(len(scores))
                tops.append(max((s for _, _, s in found), default=0.0))
                stats.append(statistic(found, n, model))
                values = [(a, b, s, model.k * n * math.exp(-model.lam * s)) for a, b, s in found]
                told.append([{"first": a, "end": b, "score": s, "e_value": e} for a, b, s, e in values if e <= e_value])
            x = np.array(stats, dtype=np.float64)
            score = 1 / (1 + np.exp(-(model.slope * np.log1p(x) + model.bias)))
            return {"n_words": n_words, "top": np.array(tops, np.float64), "statistic": x, "score": score, "passages": pa.array(told, type=kind)}

        return work

    return map_texts(docs, keep, PASSAGES, make, text_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, top, statistic, score, passages), a row for each row of docs.

    passages are the maximal segments, in words, with an E-value of at most 0.05; score is a probability in 0..1. Null
    and empty texts have no passage and the lowest score. Repeated rows score alike; other columns are not read.
    """
    return _passages(docs, {"doc_id": f"`{id_col}`"}, model, text_col)


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows that score at least ``threshold``."""
    names = docs.columns
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    i = names.index(text_col)
    scored = _passages(renamed, {f"c{j}": f"c{j}" for j in range(len(names))}, model, f"c{i}")
    return scored.where(F.col("score") < threshold).select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(names)))
