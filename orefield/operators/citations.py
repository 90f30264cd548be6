"""Citation ids, claim checks and the place of evidence on a rendered page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import text as T

FACTUAL = r"(?i)\b(?:\d+(?:\.\d+)?\s*(?:°C|K|Pa|bar|atm|mol|mM|mg/L|%|kJ/mol)|rate constant|half-life|yield|selectivity|synthesis|InChI|SMILES)\b"
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
WIDTH, HEIGHT = 612.0, 792.0


def assign(chunks: DataFrame, by: str = "query_id", order: str = "rank") -> DataFrame:
    """chunks plus number and citation_id CIT-001, CIT-002, ... in order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return chunks.withColumn("number", n).withColumn("citation_id", F.format_string("CIT-%03d", F.col("number")))


def metadata(c: Column) -> Column:
    """A citation's fields with fallbacks: text display, retrieval, content; box and title from the metadata."""
    return F.struct(
        F.trim(F.coalesce(T.non_empty(c["display_text"]), T.non_empty(c["retrieval_text"]), c["content"])).alias("raw_text"),
        F.coalesce(T.non_empty(c["title"]), F.lit("Scientific Document")).alias("document_title"),
        F.coalesce(c["bbox"], c["meta_bbox"]).alias("bbox"),
        F.round(c["score"], 4).alias("confidence"),
    )


def evidence_block(citation_id: Column, title: Column, section: Column, page: Column, doi: Column, text: Column) -> Column:
    head = F.concat_ws(
        " | ",
        F.concat(F.lit("["), citation_id, F.lit("] "), title),
        F.concat(F.lit("Section: "), T.non_empty(section)),
        F.concat(F.lit("Page: "), page.cast("string")),
        F.concat(F.lit("DOI: "), T.non_empty(doi)),
    )
    return F.concat(F.lit("### Evidence "), head, F.lit("\n"), text, F.lit("\n"))


def resolve_id(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"^[\[\] ]+|[\[\] ]+$", ""))


def claims(answers: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, claim_no, claim, cited, factual): the sentences of each answer with their distinct citation tags."""
    parts = F.filter(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    rows = answers.select(F.col(id_col).alias("id"), F.posexplode(F.transform(parts, lambda s: F.trim(s))).alias("claim_no", "claim"))
    cited = F.array_distinct(F.transform(F.regexp_extract_all("claim", F.lit(r"(?i)(CIT-\d+)"), F.lit(1)), lambda x: F.upper(x)))
    return rows.withColumns({"cited": cited, "factual": F.col("claim").rlike(FACTUAL)})


def entailment(claim: Column, text: Column) -> Column:
    """The share of the claim's content words in the cited text; 1.0 for a claim of stop words only."""
    words = T.content_words(F.regexp_replace(claim, r"(?i)\[CIT-\d+\]", ""))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, T.tokens(text))) / F.size(words))


def check_claims(answers: DataFrame, citations: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(id, claim_no, claim, cited, invalid, score, supported, uncited): a row for each cited or factual claim.

    citations (id, citation_id, text). Claims meet their citations by an equi-join on answer and tag.
    """
    all_claims = claims(answers)
    tags = all_claims.select("id", "claim_no", "claim", F.explode("cited").alias("citation_id"))
    known = citations.select("id", F.upper("citation_id").alias("citation_id"), F.col("text").alias("source"))
    joined = tags.join(known, ["id", "citation_id"], "left")
    scored = joined.groupBy("id", "claim_no").agg(
        F.max(F.when(F.col("source").isNotNull(), entailment(F.col("claim"), F.col("source")))).alias("best"),
        F.sort_array(F.collect_set(F.when(F.col("source").isNull(), F.col("citation_id")))).alias("invalid"),
    )
    out = all_claims.join(scored, ["id", "claim_no"], "left").where((F.size("cited") > 0) | F.col("factual"))
    score = F.round(F.coalesce("best", F.lit(0.0)), 4)
    return out.select(
        "id", "claim_no", "claim", "cited", F.coalesce("invalid", F.array().cast("array<string>")).alias("invalid"), score.alias("score"),
        (F.coalesce("best", F.lit(0.0)) >= threshold).alias("supported"), (F.size("cited") == 0).alias("uncited"),
    )


def totals(checked: DataFrame, answers: DataFrame, known_dois: DataFrame | None = None) -> DataFrame:
    """(id, n_claims, n_supported, n_unsupported, n_uncited, n_invalid, valid, regenerate) of each answer.

    A DOI of the text that is none of the answer's (id, doi) counts as invalid.
    """
    per = checked.groupBy("id").agg(
        F.count("*").alias("n_claims"),
        F.sum(F.when(F.col("supported") & ~F.col("uncited"), 1).otherwise(0)).alias("n_supported"),
        F.sum(F.when(~F.col("supported") & ~F.col("uncited"), 1).otherwise(0)).alias("n_unsupported"),
        F.sum(F.when(F.col("uncited"), 1).otherwise(0)).alias("n_uncited"),
        F.size(F.array_distinct(F.flatten(F.collect_list("invalid")))).alias("bad_tags"),
    )
    dois = answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(DOI), F.lit(1)))).alias("doi"))
    if known_dois is not None:
        dois = dois.join(known_dois.select("id", "doi"), ["id", "doi"], "left_anti")
    bad = dois.groupBy("id").agg(F.count("*").alias("bad_dois"))
    out = answers.select("id").join(per, "id", "left").join(bad, "id", "left").na.fill(0)
    n_invalid = F.col("bad_tags") + F.col("bad_dois")
    return out.select(
        "id", "n_claims", "n_supported", "n_unsupported", "n_uncited", n_invalid.alias("n_invalid"),
        ((n_invalid == 0) & (F.col("n_unsupported") == 0) & (F.col("n_uncited") == 0)).alias("valid"),
        ((n_invalid > 0) | ((F.col("n_unsupported") > 0) & (F.col("n_supported") == 0)) | (F.col("n_uncited") > 2)).alias("regenerate"),
    )


def viewport(box: dict[str, Column], rotation: Column, zoom: Column | float = 1.0, size: tuple[float, float] = (800.0, 1100.0), page: tuple[float, float] = (WIDTH, HEIGHT)) -> Column:
    """struct<x_pct, y_pct, width_pct, height_pct, x0, y0, x1, y1>: a box in points on a zoomed and turned page."""
    w, h = map(F.lit, page)
    zoom = zoom if isinstance(zoom, Column) else F.lit(zoom)
    clamp = lambda c, low, high: F.greatest(low, F.least(high, c))
    x0, y0 = clamp(F.coalesce(box["x0"], F.lit(0.0)), F.lit(0.0), w), clamp(F.coalesce(box["y0"], F.lit(0.0)), F.lit(0.0), h)
    x1, y1 = clamp(F.coalesce(box["x1"], w * 0.5), x0, w), clamp(F.coalesce(box["y1"], h * 0.1), y0, h)
    turn = F.pmod(rotation, F.lit(360))
    pick = lambda a, b, c, d: F.when(turn == 90, a).when(turn == 180, b).when(turn == 270, c).otherwise(d)
    rx0, ry0 = pick(h - y1, w - x1, y0, x0), pick(x0, h - y1, w - x1, y0)
    rx1, ry1 = pick(h - y0, w - x0, y1, x1), pick(x1, h - y0, w - x0, y1)
    pw, ph = pick(h, w, h, w), pick(w, h, w, h)
    sw, sh = F.lit(size[0]) * zoom, F.lit(size[1]) * zoom
    r = F.round
    return F.struct(
        r(rx0 / pw * 100.0, 3).alias("x_pct"), r(ry0 / ph * 100.0, 3).alias("y_pct"), r((rx1 - rx0) / pw * 100.0, 3).alias("width_pct"), r((ry1 - ry0) / ph * 100.0, 3).alias("height_pct"),
        r(rx0 / pw * sw, 2).alias("x0"), r(ry0 / ph * sh, 2).alias("y0"), r(rx1 / pw * sw, 2).alias("x1"), r(ry1 / ph * sh, 2).alias("y1"),
    )


def evidence_url(document_id: Column, base: str = "/api/v1") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/documents/"), document_id.cast("string"), F.lit("/file"))
