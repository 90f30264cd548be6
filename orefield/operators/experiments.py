"""Listing of extracted experiments with their documents' titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the conditions in their stored form, in order, and the record's columns behind them.
CONDITIONS = {"temperature_celsius": "temperature", "pressure_bar": "pressure", "solvent": "solvent", "catalyst": "catalyst", "reaction_time_hours": "hours"}
# Title of untitled documents, confidence of records without one.
UNTITLED = "Scientific Paper"
UNSURE = 0.85


def _shown(c: Column, quoted: bool) -> Column:
    """A stored value as it is displayed: strings in quotes, null as None."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")) if quoted else text, F.lit("None"))


def conditions_text(types: dict[str, str]) -> Column:
    """The conditions as one text, by the types of their columns."""
    parts = [F.concat(F.lit(f"'{name}': "), _shown(F.col(c), types[c] == "string")) for name, c in CONDITIONS.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def participants_text(reactants: Column, products: Column) -> Column:
    """Reactants, then products, as one text; null arrays hold none."""
    one = lambda role: lambda x: F.concat(F.lit(f"{{'role': '{role}', 'name': "), _shown(x, True), F.lit("}"))
    of = lambda c, role: F.transform(F.coalesce(c, F.array().cast("array<string>")), one(role))
    return F.concat(F.lit("["), F.array_join(F.concat(of(reactants, "reactant"), of(products, "product")), ", "), F.lit("]"))


def listing(experiments: DataFrame, documents: DataFrame, chemical: str | None = None, solvent: str | None = None, catalyst: str | None = None, limit: int | None = None) -> DataFrame:
    """Experiments (id, document_id, created_at and the columns of ``extract.experiments``) with document_title, newest first.

    Filters are substrings without regard to case: solvent and catalyst of that condition, whose null is displayed as None,
    so that "none" finds records without one; chemical of description, participants and conditions together. Empty filters
    pass all rows. Experiments of unknown documents are left out; null titles become UNTITLED, null or zero confidences
    UNSURE. Rows that repeat stay. documents (document_id, title) has one row for each id. All filters run before the join.
    """
    holds = lambda text, part: F.contains(F.lower(text), F.lit(part.lower()))
    conditions = conditions_text(dict(experiments.dtypes))
    rows = experiments
    for name, part in (("solvent", solvent), ("catalyst", catalyst)):
        if part:
            rows = rows.where(holds(_shown(F.col(name), False), part))
    if chemical:
        everything = F.concat_ws(" ", F.coalesce("description", F.lit("")), participants_text(F.col("reactants"), F.col("products")), conditions)
        rows = rows.where(holds(everything, chemical))
    titles = documents.select("document_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit(UNTITLED)).alias("document_title"))
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) != 0, F.col("confidence")).otherwise(UNSURE)
    listed = rows.withColumn("confidence", sure).join(titles, "document_id").orderBy(F.col("created_at").desc(), "id")
    return listed if limit is None else listed.limit(limit)
