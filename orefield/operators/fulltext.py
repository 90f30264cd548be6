"""Full-text search over a positional index: query grammar, cover-density ranks, highlights.

``build`` writes postings (word, id, positions) once, dealt by texts and sorted by word, so the list of a word that a third
of all texts hold is many tasks and files, and only texts are shuffled. A query is words, "phrases", -excluded ones and ``or``, which parts groups; a group's
terms must all match. Each group looks up its rarest word alone; its other words are then joined by word and text, so no
list of a common word is read out for a query that has a rarer one.

Words are runs of letters, digits and underscores, lower-cased, without a plural ending; stop words don't count but keep
their places. A query's positive terms make it match: a group that only excludes matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.operators.retrieval import identifiers, rank
from orefield.session import materialize, ship, spread

WORD = re.compile(r"\w+")
PART = re.compile(r'-?"[^"]*"?|\S+')
STOP = frozenset(T.STOP_WORDS)
#: Texts are tokenised in slices of about so many characters.
SLICE_CHARS = 1 << 18
#: A task remembers the stems of about so many words.
STEMS = 1 << 16
#: The weight of a word that has no other, in a cover's score.
WEIGHT = 0.1


def stem(word: str) -> str:
    """The weak plural stemmer: -ies to -y, -es to -e, -s away, but for a few endings."""
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    if word.endswith("s") and len(word) > 1 and not word.endswith(("us", "ss")):
        return word[:-1]
    return word


def terms(query: str | None) -> list[tuple[int, int, bool, list[tuple[int, str]]]]:
    """(group, number, excluded, [(place, word)]) of each term, repeats once; a group's positive terms are numbered from 0."""
    out, group, n, seen = [], 0, 0, set()
    for part in PART.findall(query or ""):
        if part.lower() == "or":
            group, n = group + 1, 0
            continue
        words = [(i, stem(w.lower())) for i, w in enumerate(WORD.findall(part)) if w.lower() not in STOP]
        excluded, words = part.startswith("-"), [(i - words[0][0], w) for i, w in words]
        if words and (group, excluded, *words) not in seen:
            seen.add((group, excluded, *words))
            out.append((group, -1 - len(out) if excluded else n, excluded, words))
            n += not excluded
    return out


@dataclass
class FullText:
    """texts (id, t); postings (word, id, positions); frequencies (word, texts)."""

    texts: DataFrame
    postings: DataFrame
    frequencies: DataFrame


def build(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> FullText:
    """Null and empty texts have no words, rows with a null id are left out; ids are taken as distinct."""
    ship(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            start = 0
            while start < len(batch):
                words, row, place, stop, chars = [], [], [], start, 0
                while stop < len(batch) and chars < SLICE_CHARS:
                    text = batch.column(1)[stop].as_py() or ""
                    own = WORD.findall(text)
                    words += own
                    row.append(len(own))
                    stop, chars = stop + 1, chars + len(text)
                ids = np.repeat(np.asarray(batch.column(0).slice(start, stop - start)), row)
                place = np.concatenate([np.arange(n) for n in row]) if row else np.zeros(0, np.int64)
                start = stop
                if len(stems) > STEMS:
                    stems.clear()
                for w in set(words) - stems.keys():
                    stems[w] = "" if w.lower() in STOP else stem(w.lower())
                coded = pa.array([stems[w] for w in words], pa.string()).dictionary_encode()
                code = np.asarray(coded.indices)
                order = np.lexsort((place, code, ids))
                code, ids, place = code[order], ids[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(ids) != 0)])) if len(code) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)).astype(np.int32)), pa.array(place.astype(np.int32)))
                out = pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array(ids[first]), lists], names=["word", "id", "positions"])
                yield out.filter(pa.array(np.asarray(out.column(0).to_numpy(zero_copy_only=False) != "", dtype=bool)))

    made = spread(texts).mapInArrow(postings, "word string, id long, positions array<int>")
    # A range of words for each file would take a sample first, and with it a second pass over the texts.
    stored = materialize(made.sortWithinPartitions("word"), "postings")
    return FullText(texts, stored, materialize(stored.groupBy("word").agg(F.count("*").alias("texts")), "frequencies"))


def parse(queries: DataFrame, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, grp, term, excluded, place, word, width, n_words): a row for each word of a query's terms."""
    ship(queries.sparkSession)
    kind = queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).cast("string").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, group, number, excluded, place, word, words[-1][0] + 1, len(words))
                for i, q in enumerate(batch.column(1).to_pylist())
                for group, number, excluded, words in terms(q)
                for place, word in words
            ]
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            made = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], names=["query_id", "grp", "term", "excluded", "place", "word", "width", "n_words"])

    return asked.mapInArrow(run, f"query_id {kind}, grp int, term int, excluded boolean, place int, word string, width int, n_words int")


def _matched(index: FullText, parsed: DataFrame) -> DataFrame:
    """(query_id, grp, id, entries): groups that match texts; entries (pos, term, width) of their terms, in order."""
    known = materialize(parsed.join(index.frequencies, "word", "left").na.fill(0, ["texts"]), "terms")
    own = F.when(~F.col("excluded"), F.struct("texts", "word"))
    groups = known.groupBy("query_id", "grp").agg(F.min(own).alias("rarest"), F.countDistinct(F.when(~F.col("excluded"), F.col("term"))).alias("n_terms"))
    groups = groups.where("rarest.texts > 0").select("query_id", "grp", "n_terms", F.col("rarest.word").alias("word"))
    # Of the postings only those of asked words are read on; the others take no part in a join by word and text.
    asked = index.postings.join(known.where("texts > 0").select("word").distinct(), "word", "left_semi")
    candidates = groups.join(asked.select("word", "id"), "word").select("query_id", "grp", "n_terms", "id")
    words = known.where("texts > 0").select("query_id", "grp", "term", "excluded", "place", "word", "width", "n_words")
    held = candidates.join(words, ["query_id", "grp"]).join(asked, ["word", "id"])
    starts = F.transform("positions", lambda p: p - F.col("place"))
    lists = held.groupBy("query_id", "grp", "id", "term").agg(
        F.first("n_terms").alias("n_terms"),
        F.first("excluded").alias("excluded"),
        F.first("width").alias("width"),
        F.first("n_words").alias("n_words"),
        F.collect_list(starts).alias("lists"),
    )
    # A term's words are few; a phrase begins where all of them, moved to its first word, have a place.
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    found = lists.where(F.size("lists") == F.col("n_words")).withColumn("starts", both).where(F.size("starts") > 0)
    entries = F.transform("starts", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term"), F.col("width").alias("width")))
    groups = found.groupBy("query_id", "grp", "id").agg(
        F.max("excluded").alias("excluded"),
        F.sum(F.when(~F.col("excluded"), 1)).alias("matched"),
        F.first("n_terms").alias("n_terms"),
        F.flatten(F.collect_list(entries)).alias("entries"),
    )
    kept = groups.where(~F.col("excluded") & (F.col("matched") == F.col("n_terms")))
    return kept.select("query_id", "grp", "id", "n_terms", F.array_sort("entries").alias("entries"))


def covers(entries: Column, n_terms: Column) -> Column:
    """(score, noise, first, last) over the minimal stretches that hold every term of a group.

    A stretch counts the WEIGHT divided by one more than its words that belong to no term; noise, first and last tell of
    the stretch with the fewest such words, the first one among equals. One pass over the places in order: it keeps
    each term's last one, and a stretch ends where the smallest of these grows.
    """
    none = F.transform(F.sequence(F.lit(1), n_terms), lambda _: F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("before"), F.lit(0).alias("width")))
    best = F.struct(F.lit(1 << 62).cast("long").alias("noise"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    start = F.struct(none.alias("seen"), F.lit(0).cast("long").alias("words"), F.lit(-1).alias("from"), F.lit(0.0).alias("score"), best.alias("best"))

    def step(s: Column, e: Column) -> Column:
        own = F.struct(e["pos"].alias("pos"), s["words"].alias("before"), e["width"].alias("width"))
        seen = F.transform(s["seen"], lambda x, i: F.when(i == e["term"], own).otherwise(x))
        moved = F.struct(seen.alias("seen"), (s["words"] + e["width"]).alias("words"))
        # Bound as one-element arrays, so that each value is computed once.
        low = F.transform(F.array(moved), lambda m: F.struct(m["seen"].alias("seen"), m["words"].alias("words"), F.array_min(m["seen"]).alias("low"), F.array_max(F.transform(m["seen"], lambda x: x["pos"] + x["width"] - 1)).alias("last")))

        def close(m: Column) -> Column:
            fresh = (m["low"]["pos"] >= 0) & (m["low"]["pos"] > s["from"])
            noise = F.greatest(F.lit(0).cast("long"), (m["last"] - m["low"]["pos"] + 1).cast("long") - (m["words"] - m["low"]["before"]))
            cover = F.struct(noise.alias("noise"), m["low"]["pos"].alias("first"), m["last"].alias("last"))
            return F.struct(
                m["seen"].alias("seen"),
                m["words"].alias("words"),
                F.when(fresh, m["low"]["pos"]).otherwise(s["from"]).alias("from"),
                F.when(fresh, s["score"] + F.lit(WEIGHT) / (noise + 1)).otherwise(s["score"]).alias("score"),
                F.when(fresh, F.least(s["best"], cover)).otherwise(s["best"]).alias("best"),
            )

        return F.get(F.transform(low, close), F.lit(0))

    return F.aggregate(entries, start, step, lambda s: F.struct(s["score"].alias("score"), s["best"].alias("best")))


def match(index: FullText, queries: DataFrame, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, id): every text that matches, by the grammar or because it holds one of the query's identifiers."""
    found = _matched(index, parse(queries, query_id, query_text)).select("query_id", "id")
    named = _identified(index, queries, query_id, query_text)
    return (found if named is None else found.unionByName(named.select("query_id", "id"))).distinct()


def _identified(index: FullText, queries: DataFrame, query_id: str, query_text: str) -> DataFrame | None:
    """(query_id, id) of texts that hold a registry number or equipment code of the query, from a word's start on, in any case."""
    named = queries.select(F.col(query_id).alias("query_id"), F.explode(identifiers(F.coalesce(F.col(query_text), F.lit("")))).alias("ident"))
    if named.isEmpty():
        return None
    first = parse(named.select(F.struct("query_id", "ident").alias("query_id"), F.col("ident").alias("text"))).where("place = 0")
    first = first.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.ident").alias("ident"), "word")
    held = first.join(index.postings.select("word", "id"), "word").join(index.texts, "id")
    return held.where(F.contains(F.lower("t"), F.lower("ident"))).select("query_id", "id").distinct()


def search(index: FullText, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, id, score, rank, first, last): each query's k best matches by cover density, ties by id.

    A query's score is the sum over its groups. As a last step 1.0 is added where the text holds an identifier of the
    query in its case; that doesn't change the ranks. first and last are the words of the best cover, null where only an
    identifier matched.
    """
    own = _matched(index, parse(queries, query_id, query_text)).withColumn("c", covers(F.col("entries"), F.col("n_terms")))
    # Rounded, so that equal covers tie in whatever order they were added.
    found = own.groupBy("query_id", "id").agg(F.round(F.sum("c.score"), 9).alias("score"), F.min("c.best").alias("best"))
    found = found.select("query_id", "id", "score", F.col("best.first").alias("first"), F.col("best.last").alias("last"))
    named = _identified(index, queries, query_id, query_text)
    if named is None:
        return rank(found, F.desc("score"), F.col("id")).where(F.col("rank") <= k)
    found = found.join(named, ["query_id", "id"], "full").na.fill(0.0, ["score"])
    best = rank(found, F.desc("score"), F.col("id")).where(F.col("rank") <= k)
    asked = queries.select(F.col(query_id).alias("query_id"), identifiers(F.coalesce(F.col(query_text), F.lit(""))).alias("idents")).where(F.size("idents") > 0)
    held = best.join(asked, "query_id").join(index.texts, "id").where(F.exists("idents", lambda x: F.contains("t", x))).select("query_id", "id", F.lit(1.0).alias("more"))
    best = best.join(held, ["query_id", "id"], "left")
    return best.withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).select("query_id", "id", "score", "rank", "first", "last")


def fragment(text: str, wanted: set[str], first: int, last: int, least: int, most: int, marks: tuple[str, str]) -> str:
    """The words first to last, filled up to ``least`` on the right or else the left, at most ``most``; wanted ones marked."""
    spans = [m.span() for m in WORD.finditer(text)]
    end = min(len(spans), max(last + 1, first + least))
    begin = max(0, min(first, end - least))
    end = min(end, begin + most)
    out, at = [], spans[begin][0]
    for a, b in spans[begin:end]:
        word = text[a:b]
        hit = word.lower() not in STOP and stem(word.lower()) in wanted
        out += [text[at:a], marks[0] + word + marks[1] if hit else word]
        at = b
    return "".join(out)


def highlight(
    index: FullText, ranked: DataFrame, queries: DataFrame, query_id: str = "query_id", query_text: str = "text", least: int = 15, most: int = 35, marks: tuple[str, str] = ("<b>", "</b>")
) -> DataFrame:
    """ranked (of ``search``) and highlight: ``least`` to ``most`` words from the best cover on, the query's words marked.

    Where no cover is, the first 200 characters.
    """
    wanted = parse(queries, query_id, query_text).where(~F.col("excluded")).groupBy("query_id").agg(F.collect_set("word").alias("wanted"))
    # Written, so that its size is known and the texts needn't be shuffled to meet these few rows.
    ranked = materialize(ranked, "ranked")
    rows = ranked.join(index.texts, "id").join(wanted, "query_id", "left")
    kept = [f.name for f in ranked.schema]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i) for i in range(len(kept))]
            out = []
            for i in range(len(batch)):
                text, first, last = batch.column(len(kept))[i].as_py() or "", own[kept.index("first")][i].as_py(), own[kept.index("last")][i].as_py()
                words = set(batch.column(len(kept) + 1)[i].as_py() or ())
                out.append(text[:200] if first is None else fragment(text, words, first, last, least, most, marks))
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.string())], names=[*kept, "highlight"])

    return rows.select(*kept, "t", "wanted").mapInArrow(run, f"{fields}, highlight string")
