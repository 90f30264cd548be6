"""Genre, intent and image classes, experiments, equations, tables and markup as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.session import spread

# Weighted genre signals, in the order that breaks ties.
GENRES = {
    "sds": {
        r"\bsafety\s+data\s+sheet\b": 3.0, r"\bmaterial\s+safety\s+data\s+sheet\b": 3.0, r"\bmsds\b": 2.0, r"\bghs\s+(?:classification|hazard)\b": 2.5,
        r"\bhazards?\s+identification\b": 2.0, r"\bfirst-?aid\s+measures\b": 2.0, r"\baccidental\s+release\s+measures\b": 2.0, r"\bexposure\s+controls\b": 2.0,
        r"\btoxicological\s+information\b": 2.0, r"\becological\s+information\b": 2.0, r"\bdisposal\s+considerations\b": 2.0, r"\btransport\s+information\b": 2.0,
        r"\bcas\s*(?:no\.?|number|#)?\s*[:\d\-]+": 2.0, r"\bsignal\s+word\s*:\s*(?:danger|warning)\b": 2.5, r"\b(?:h\d{3}|p\d{3})\b": 1.5,
    },
    "sop": {
        r"\bstandard\s+operating\s+procedure\b": 3.0, r"\bsop\s*(?:no\.?|number|#|id)\b": 2.5, r"\bpurpose\s+and\s+scope\b": 2.0, r"\bresponsibilities?\b": 1.5,
        r"\bprocedure\s+steps?\b": 2.0, r"\bequipment\s+and\s+(?:reagents|materials)\b": 2.0, r"\brevision\s+history\b": 2.0, r"\bapproval\s+signatures?\b": 2.0,
        r"\beffective\s+date\b": 1.5, r"\bsupersedes\b": 1.5,
    },
    "experimental_report": {
        r"\blaboratory\s+notebook\b": 3.0, r"\bexperimental\s+report\b": 3.0, r"\bbatch\s*(?:no\.?|number|#)\b": 2.0, r"\blot\s*(?:no\.?|number|#)\b": 2.0,
        r"\breaction\s+scheme\b": 2.0, r"\byield\s*:\s*\d+": 2.0, r"\bcrude\s+product\b": 2.0, r"\bpurification\s+method\b": 1.5, r"\banalytical\s+data\b": 1.5,
        r"\b1h-?nmr\b": 2.0, r"\bhplc\s+analysis\b": 2.0, r"\brun\s*(?:no\.?|number|#)\b": 1.5,
    },
    "research_paper": {
        r"\babstract\b": 2.0, r"\bmaterials\s+and\s+methods\b": 2.5, r"\bexperimental\s+section\b": 2.0, r"\bresults\s+and\s+discussion\b": 2.5, r"\bconclusions?\b": 1.5,
        r"\breferences\b": 2.0, r"\bdoi\s*:\s*10\.\d{4,9}/": 3.0, r"\bcorresponding\s+author\b": 2.0, r"\belectronic\s+supplementary\s+information\b": 2.5, r"\bpeer-?reviewed\b": 1.5,
    },
    "textbook": {
        r"\bchapter\s+\d+\b": 2.5, r"\btable\s+of\s+contents\b": 2.5, r"\bindex\b": 1.5, r"\bexercises?\b": 2.0, r"\bproblems?\s+and\s+solutions?\b": 2.5, r"\bpreface\b": 2.0,
        r"\bedition\b": 1.5, r"\bisbn\b": 2.5,
    },
    "technical_report": {
        r"\btechnical\s+report\b": 3.0, r"\bexecutive\s+summary\b": 2.5, r"\bproject\s+report\b": 2.0, r"\bdeliverable\s+d?\d+": 2.5, r"\bgrant\s+agreement\b": 2.0,
        r"\bcontract\s*(?:no\.?|number|#)\b": 2.0, r"\bprepared\s+for\b": 1.5,
    },
}
# The parser of each genre.
PARSERS = {"research_paper": "grobid_parser", "textbook": "textbook_parser", "experimental_report": "experimental_parser", "sop": "sop_parser", "sds": "sds_parser", "technical_report": "tech_report_parser", "unknown": "generic_parser"}


def needed_word(pattern: str) -> str:
    """The longest run of letters and digits that every match of a signal holds; empty if there is none.

    Groups, classes and optional characters are taken out first, so what is left stands in each match."""
    plain = re.sub(r"\(\?:[^()]*\)[?*]?", " ", pattern)
    plain = re.sub(r"\[[^\]]*\]|\{[^}]*\}|\\[a-zA-Z][?*+]?|.[?*]", " ", plain)
    return max(re.findall(r"[a-z0-9]+", plain), key=len, default="")


def genre_scores(text: Column, filename: Column, pages: Column) -> Column:
    """struct of a score for each genre: weighted signals, each counted three times at most, plus page and name clues."""
    both = F.lower(F.concat(F.coalesce(filename, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    name = F.lower(F.coalesce(filename, F.lit("")))

    def counted(lowered: Column) -> Column:
        """Weighted sums; a signal is counted only where its word stands, which a plain search finds out."""
        sums = []
        for genre, signals in GENRES.items():
            total = F.lit(0.0)
            for pattern, weight in signals.items():
                n = F.least(F.size(F.regexp_extract_all(lowered, F.lit(f"({pattern})"), F.lit(1))), F.lit(3))
                word = needed_word(pattern)
                total = total + F.lit(weight) * (F.when(F.contains(lowered, F.lit(word)), n).otherwise(0) if word else n)
            sums.append(total.alias(genre))
        return F.struct(*sums)

    # A lambda's argument is computed once, however often it is named.
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return once(once(both, counted), lambda sums: _with_clues(sums, name, pages))


def _with_clues(sums: Column, name: Column, pages: Column) -> Column:
    score = {g: sums[g] for g in GENRES}
    score["textbook"] = score["textbook"] + F.when(pages > 100, 4.0).otherwise(0.0)
    short = score["sds"] + F.when((pages <= 16) & (score["sds"] > 2.0), 2.0).otherwise(0.0)
    score["sds"] = short + F.when(F.contains(name, F.lit("sds")), 3.0).otherwise(0.0)
    score["sop"] = score["sop"] + F.when(F.contains(name, F.lit("sop")), 3.0).otherwise(0.0)
    score["technical_report"] = score["technical_report"] + F.when(F.contains(name, F.lit("report")), 1.5).otherwise(0.0)
    return F.struct(*(s.alias(g) for g, s in score.items()))


def genre_verdict(scores: Column, threshold: float = 0.40) -> Column:
    """struct<genre, confidence, parser> of genre_scores(); ties go to the earlier genre."""
    values = F.array(*(scores[g] for g in GENRES))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    best = F.array_max(values)
    confidence = F.when(total == 0, 0.0).otherwise(F.round(F.least(best / (total + 1.0), F.lit(1.0)), 2))
    genre = F.when((total == 0) | (confidence < threshold), F.lit("unknown")).otherwise(F.element_at(F.array(*map(F.lit, GENRES)), F.array_position(values, best).cast("int")))
    parser = F.element_at(F.create_map(*(F.lit(x) for kv in PARSERS.items() for x in kv)), genre)
    return F.struct(genre.alias("genre"), confidence.alias("confidence"), parser.alias("parser"))


# Caption patterns of image classes, in order.
CAPTIONS = {
    "reaction_scheme": r"\bscheme\s+\d+\b|\breaction\s+scheme\b|\bsynthesis\s+of\b|\bpathway\b|\breagents?\s+and\s+conditions\b",
    "molecular_structure": r"\bstructure\s+(?:of|\d+)\b|\bcompound\s+\d+\b|\bchemical\s+structure\b|\bmolecular\s+formula\b",
    "plot": r"\bspectra\b|\bspectrum\b|\bchromatogram\b|\bnmr\b|\bhplc\b|\bft-?ir\b|\bplot\b|\bcurve\b|\babsorbance\b|\btransmittance\b",
    "photograph": r"\bmicrograph\b|\bsem\b|\btem\b|\bafm\b|\bx-ray\s+crystal\b|\bphotograph\b",
}


def image_class(caption: Column) -> Column:
    out = None
    for kind, pattern in CAPTIONS.items():
        test = F.trim(F.lower(caption)).rlike(pattern)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


# Intents and their words, in the order of the rules.
RESTRICTED = (
    "sarin", "soman", "tabun", "vx nerve", "novichok", "mustard gas", "phosgene synthesis", "ricin extraction", "weaponize", "clandestine explosive", "rdx synthesis",
    "tatp synthesis", "c4 explosive", "improvised explosive", "heroin synthesis", "methamphetamine cook", "fentanyl clandestine",
)
CALCULATION = (
    "calculate", "yield", "molar", "moles", "concentration", "molarity", "molecular weight", "stoichiometry", "limiting reagent", "dilution", "convert", "mass", "grams",
    "mg", "ml", "standard deviation", "mean",
)
CALCULATION_UNITS = ("mol", "g", "mg", "ml", "l", "%", "yield", "molar", "ppm")
CHEMICAL = (
    "smiles", "inchi", "cas", "structure", "formula", "logp", "tpsa", "molecular formula", "iupac", "pubchem", "isomer", "chirality", "functional group", "melting point", "boiling point",
)
INTENT_WORDS = {
    "chemical_identity": ("smiles", "structure of", "inchi", "cas number"),
    "chemical_property": ("solubility", "boiling point", "melting point", "tpsa", "logp", "pka"),
    "reaction_synthesis": ("synthesis", "reaction", "reagent", "catalyst", "mechanism", "procedure"),
    "comparison": ("compare", "difference between", "versus", "vs.", "better yield"),
}
FACTOID_STARTS = ("what is", "who", "when", "define", "name")


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def intent(q: Column) -> Column:
    low = F.lower(q)
    out = F.when(has_any(low, RESTRICTED), "safety_hazard").when(has_any(low, CALCULATION) & has_any(low, CALCULATION_UNITS), "calculation_analytics")
    for name, words in INTENT_WORDS.items():
        out = out.when(has_any(low, words), name)
    return out.when(F.exists(F.array(*map(F.lit, FACTOID_STARTS)), lambda w: F.startswith(low, w)), "factoid").otherwise("general")


def evidence_needs(q: Column, kind: Column) -> Column:
    """struct<retrieval, chemistry, calculation, restricted>."""
    low = F.lower(q)
    return F.struct(
        (kind.isin("factoid", "chemical_property", "reaction_synthesis", "comparison", "general") | has_any(low, ("document", "paper", "study"))).alias("retrieval"),
        (kind.isin("chemical_identity", "chemical_property", "reaction_synthesis") | has_any(low, CHEMICAL)).alias("chemistry"),
        ((kind == "calculation_analytics") | has_any(low, ("calculate", "how many moles", "percent yield", "dilute", "molarity"))).alias("calculation"),
        (kind == "safety_hazard").alias("restricted"),
    )


def subtasks(needs: Column) -> Column:
    """The agents to run, in order; a restricted question goes to the aggregator alone."""
    plan = F.array(F.when(needs["chemistry"], "chemistry"), F.when(needs["retrieval"], "retrieval"), F.when(needs["calculation"], "analytics"), F.lit("aggregator"))
    return F.when(needs["restricted"], F.array(F.lit("aggregator"))).otherwise(F.array_compact(plan))


def next_step(safe: Column, tasks: Column) -> Column:
    """tasks array<struct<agent, status>>: the first pending agent, or the aggregator if there is none or it isn't safe."""
    pending = F.filter(tasks, lambda t: t["status"] == "pending")
    return F.when(~safe | (F.size(pending) == 0), F.lit("aggregator")).otherwise(F.get(pending, F.lit(0))["agent"])


# Fixed values of the experiment extractor.
MARKERS = ("reaction", "yield", "stirred", "heated", "reflux", "synthesized", "added", "catalyst", "solvent", "temperature", "°c", "bar", "atm", "mmol")
EXPERIMENT_SOLVENTS = {
    "water": "Water", "ethanol": "Ethanol", "methanol": "Methanol", "thf": "THF", "acetonitrile": "Acetonitrile", "dcm": "DCM", "ch2cl2": "Ch2cl2", "toluene": "Toluene",
    "dmf": "DMF", "dmso": "DMSO", "ether": "Ether", "acetone": "Acetone", "hexane": "Hexane",
}
EXPERIMENT_CATALYSTS = ("Pt/Al2O3", "Pd/C", "Ni", "H2SO4", "NaOH", "KOH", "CuI", "Rh", "Ru", "zeolite", "acid catalyst", "base")
NOT_PARTICIPANTS = ("The", "And", "For", "With", "This", "After")
TEMPERATURE = r"(?i)(\d+(?:\.\d+)?)\s*(°C|deg\s*C|K\b)"
PRESSURE = r"(?i)(\d+(?:\.\d+)?)\s*(bar|atm|MPa|kPa)\b"
YIELD = r"(?i)(?:yield|obtained)[^\d]*(\d+(?:\.\d+)?)\s*%"
TIME = r"(?i)(\d+(?:\.\d+)?)\s*(hours|hr|h|minutes|min)\b"


def _first(text: Column, options: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(text.rlike(rf"(?i)\b{k}\b"), F.lit(v)) for k, v in options.items()))


def experiment(p: Column) -> Column:
    """The experiment record of one paragraph; units count only as whole words, and kelvins become degrees Celsius."""
    number = lambda pattern: F.regexp_extract(p, pattern, 1).try_cast("double")
    unit = lambda pattern: F.lower(F.regexp_extract(p, pattern, 2))
    t = F.round(number(TEMPERATURE) - F.when(unit(TEMPERATURE) == "k", 273.15).otherwise(0.0), 1)
    pressure = F.round(F.when(unit(PRESSURE) == "kpa", number(PRESSURE) / 100.0).when(unit(PRESSURE) == "mpa", number(PRESSURE) * 10.0).otherwise(number(PRESSURE)), 2)
    hours = F.round(F.when(F.startswith(unit(TIME), F.lit("min")), number(TIME) / 60.0).otherwise(number(TIME)), 2)
    solvent = _first(p, EXPERIMENT_SOLVENTS)
    names = F.filter(F.regexp_extract_all(p, F.lit(r"\b([A-Z][a-z0-9]*(?:-[A-Z][a-z0-9]*)*)\b"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*NOT_PARTICIPANTS))
    y = number(YIELD)
    present = (F.coalesce(t, F.lit(0.0)) != 0) | (F.coalesce(y, F.lit(0.0)) != 0) | solvent.isNotNull()
    return F.struct(
        F.concat(F.substring(p, 1, 300), F.when(F.length(p) > 300, "...").otherwise("")).alias("description"),
        t.alias("temperature"), pressure.alias("pressure"), solvent.alias("solvent"),
        _first(p, {c: c for c in EXPERIMENT_CATALYSTS}).alias("catalyst"), hours.alias("hours"), y.alias("yield_percent"),
        F.slice(names, 1, 3).alias("reactants"), F.slice(names, 4, 2).alias("products"), F.when(present, 0.88).otherwise(0.70).alias("confidence"),
    )


def experiments(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each paragraph of over 30 characters with a marker, with the record's fields beside df's other columns."""
    paragraphs = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n"), lambda p: F.trim(p))
    good = F.filter(paragraphs, lambda p: (F.length(p) > 30) & has_any(F.lower(p), MARKERS))
    rows = spread(df).select(*(c for c in df.columns if c != text), F.posexplode(good).alias("paragraph", "p"))
    return rows.withColumn("e", experiment(F.col("p"))).select(*(c for c in rows.columns if c != "p"), "e.*")


# Symbols and their LaTeX.
SYMBOLS = {
    "Δ": r"\Delta", "δ": r"\delta", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "ω": r"\omega",
    "±": r"\pm", "∓": r"\mp", "×": r"\times", "÷": r"\div", "·": r"\cdot", "°": r"^\circ", "≈": r"\approx", "≠": r"\neq", "≤": r"\leq", "≥": r"\geq", "→": r"\rightarrow",
    "⇌": r"\rightleftharpoons", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∞": r"\infty", "Å": r"\text{\AA}",
}
# Patterns of the equation detector.
EQUATION_NUMBER = r"\((?:\d+|[A-Z]\d*|\b[iIvVxX]+\b)\)\s*$"
OPERATOR = r"[=<>±≈≠≤≥⇌→]\s*"
LATEX = r"(\$\$.*?\$\$|\$.*?\$|\\\[.*?\\\]|\\\(.*?\\\))"


def to_latex(c: Column) -> Column:
    out = F.trim(F.regexp_replace(F.trim(c), r"^\$\$|\$\$$|^\\\[|\\\]$|^\$|\$$", ""))
    for symbol, latex in SYMBOLS.items():
        out = F.replace(out, F.lit(symbol), F.lit(f" {latex} "))
    out = F.regexp_replace(out, r"([A-Za-z0-9)])\^([A-Za-z0-9\-+]+)", r"$1^{$2}")
    out = F.regexp_replace(out, r"([A-Za-z0-9)])_([A-Za-z0-9]+)", r"$1_{$2}")
    return T.squeeze(out)


def equation(c: Column) -> Column:
    """struct<confidence, latex>, null if the block is no equation."""
    c = F.trim(c)
    op, symbol = c.rlike(OPERATOR), c.rlike("[" + "".join(SYMBOLS) + "]")
    short = (F.length(c) < 250) & (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) <= 2)
    confidence = F.when((c.rlike(EQUATION_NUMBER) & op) | c.rlike(LATEX), 0.95).when(short & op & symbol, 0.75)
    return F.when(confidence.isNotNull(), F.struct(confidence.alias("confidence"), to_latex(c).alias("latex")))


def header_unit(h: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(F.nullif(F.regexp_extract(h, r"\(([^)]+)\)", 1), F.lit("")), F.regexp_extract(h, r"\[([^\]]+)\]", 1))), F.lit(""))


def table_text(index: Column, caption: Column, headers: Column, rows: Column, footnotes: Column) -> Column:
    """The table with every cell under its header; missing headers are named by their column."""
    title = (
        F.when(F.coalesce(caption, F.lit("")) == "", F.concat(F.lit("[Table "), index.cast("string"), F.lit("]")))
        .when(F.startswith(F.lower(F.trim(caption)), F.lit("table")), F.concat(F.lit("["), F.trim(caption), F.lit("]")))
        .otherwise(F.concat(F.lit("[Table "), index.cast("string"), F.lit(": "), F.trim(caption), F.lit("]")))
    )
    cell = lambda c, i: F.concat(F.coalesce(F.get(headers, i), F.concat(F.lit("Col "), (i + 1).cast("string"))), F.lit(": "), c)
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(r, cell), " | ")))
    notes = F.when(F.size(footnotes) > 0, F.concat(F.lit("Notes: "), F.array_join(footnotes, " ; ")))
    return F.array_join(F.concat(F.array(title), lines, F.array_compact(F.array(notes))), "\n")


def table_html(caption: Column, headers: Column, rows: Column) -> Column:
    tags = lambda xs, tag: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), "")
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), tags(r, "td"), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table><caption>"), caption, F.lit("</caption><thead><tr>"), tags(headers, "th"), F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>"))


def text_tables(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, table_index, caption, headers, rows, units, footnotes) of captioned text tables with pipes, tabs or wide gaps.

    Lines are numbered rows; a caption opens a table and an empty line closes it, found by windows over a
    document's lines.
    """
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "s")).withColumn("s", F.trim("s"))
    doc = Window.partitionBy("id").orderBy("n")
    is_caption = F.col("s").rlike(r"(?i)^table\s+(?:\d+|[A-Z]\d*|[ivx]+)[:.\s]?")
    lines = lines.withColumn("run", F.sum(F.when(F.col("s") == "", 1).otherwise(0)).over(doc))
    opened = F.min(F.when(is_caption, F.col("n"))).over(Window.partitionBy("id", "run"))
    body = lines.withColumn("opened", opened).where("opened is not null and n >= opened and s <> ''")
    cells = F.when(F.contains("s", F.lit("|")), F.split("s", r"\|")).when(F.contains("s", F.lit("\t")), F.split("s", "\t")).otherwise(F.split("s", r"\s{2,}"))
    cells = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    body = body.where(~F.col("s").rlike(r"^[-|:+ ]+$")).withColumn("cells", cells)
    note = F.col("s").rlike(r"^(?:[*†‡§]|\b[a-z]\b|\b\d+\b)\s+(.+)") & (F.size("cells") < 2) & (F.col("n") > F.col("opened"))
    grouped = body.groupBy("id", "opened").agg(
        F.min_by("s", "n").alias("caption"),
        F.transform(F.sort_array(F.collect_list(F.when((F.size("cells") >= 2) & (F.col("n") > F.col("opened")), F.struct("n", "cells")))), lambda x: x["cells"]).alias("all"),
        F.transform(F.sort_array(F.collect_list(F.when(note, F.struct("n", "s")))), lambda x: x["s"]).alias("footnotes"),
    )
    tables = grouped.where(F.size("all") > 1).withColumns({"headers": F.get("all", F.lit(0)), "rows": F.expr("slice(all, 2, size(all))")})
    units = F.filter(F.transform("headers", lambda h: F.struct(h.alias("header"), header_unit(h).alias("unit"))), lambda u: u["unit"].isNotNull())
    index = F.row_number().over(Window.partitionBy("id").orderBy("opened"))
    return tables.select("id", index.alias("table_index"), "caption", "headers", "rows", units.alias("units"), "footnotes")


def yield_contradictions(chunks: DataFrame, by: str = "query_id", order: str = "position", text: str = "text", gap: float = 10.0) -> DataFrame:
    """(by, low, high, first, last) of groups of two or more chunks whose stated yields differ by over ``gap`` points."""
    values = F.regexp_extract_all(text, F.lit(r"(?i)(?:yield|conversion)\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*%"), F.lit(1))
    found = chunks.select(by, order, F.posexplode(values).alias("n", "v")).select(by, F.struct(order, "n").alias("o"), F.col("v").cast("double").alias("v"))
    enough = chunks.groupBy(by).agg(F.count("*").alias("chunks")).where("chunks >= 2").select(by)
    out = found.join(enough, by, "left_semi").groupBy(by).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.min_by("v", "o").alias("first"), F.max_by("v", "o").alias("last"), F.count("*").alias("n")
    )
    return out.where((F.col("n") >= 2) & (F.col("high") - F.col("low") > gap)).drop("n")
