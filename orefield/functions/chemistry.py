"""Chemical identifiers, mentions, structures and their comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, names and confidences of the mention extractor.
CAS = r"\b([1-9]\d{1,6}-\d{2}-\d)\b"
ANY_CAS = r"\b(\d{2,7}-\d{2}-\d)\b"
INCHI_KEY = r"\b([A-Z]{14}-[A-Z]{10}-[A-Z\d])\b"
INCHI = r"\b(InChI=1S?/[A-Za-z0-9()+\-,./;:?#]+)\b"
CONDITION = r"(?i)((?:^|\s)-?\d+(?:\.\d+)?\s*(?:°C|K|°F|bar|atm|MPa|kPa|psi|h|hours?|min|minutes?)\b)"
WORDS = r"\b([A-Za-z0-9\-()/._]+)\b"
FORMULA = r"\b([A-Z][a-z]?(?:\d+)?(?:[A-Z][a-z]?(?:\d+)?)+)\b"
NOT_FORMULAS = "DNA RNA USA NASA PDF RAM CPU HTML URL API".split()
SOLVENTS = {
    "thf": "tetrahydrofuran",
    "dmf": "dimethylformamide",
    "dcm": "dichloromethane",
    "dmso": "dimethyl sulfoxide",
    "meoh": "methanol",
    "etoh": "ethanol",
    "etoac": "ethyl acetate",
    "mecn": "acetonitrile",
    "acn": "acetonitrile",
    "et2o": "diethyl ether",
    "tfa": "trifluoroacetic acid",
    "nmp": "n-methyl-2-pyrrolidone",
    "toluene": "toluene",
    "benzene": "benzene",
    "hexane": "hexane",
    "hexanes": "hexanes",
    "heptane": "heptane",
    "acetone": "acetone",
    "chloroform": "chloroform",
    "pyridine": "pyridine",
}
CATALYSTS = {
    "pd(pph3)4": "tetrakis(triphenylphosphine)palladium(0)",
    "pd/c": "palladium on carbon",
    "pd(dppf)cl2": "[1,1'-bis(diphenylphosphino)ferrocene]dichloropalladium(II)",
    "ru-binap": "ruthenium-BINAP",
    "rh-duphos": "rhodium-DuPhos",
    "pt/c": "platinum on carbon",
    "raney ni": "Raney nickel",
    "cu(oac)2": "copper(II) acetate",
    "fecl3": "iron(III) chloride",
    "alcl3": "aluminum chloride",
}
CONFIDENCE = {"cas_number": 0.99, "inchi_key": 0.98, "inchi": 0.98, "solvent": 0.95, "catalyst": 0.95, "process_condition": 0.90, "chemical_formula": 0.75}
COMMON_NAMES = (
    "aspirin", "acetylsalicylic acid", "benzene", "paracetamol", "acetaminophen", "caffeine", "ibuprofen", "ethanol", "acetone", "toluene", "glucose",
    "phenol", "aniline", "benzoic acid", "methanol", "acetic acid",
)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def cas_valid(c: Column) -> Column:
    """d...d-dd-d whose last digit is the sum of the other digits times their places from the right, modulo 10."""
    c = F.trim(c)
    digits = F.reverse(F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 20))
    body = F.substr(digits, F.lit(2))
    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda i: F.coalesce(F.substr(body, i, F.lit(1)).try_cast("int"), F.lit(0)) * i),
        F.lit(0),
        lambda s, x: s + x,
    )
    return F.coalesce(F.when(c.rlike(r"^\d+-\d{2}-\d$"), total % 10 == F.substring(digits, 1, 1).try_cast("int")), F.lit(False))


def cas_normalize(c: Column) -> Column:
    """Digits regrouped as rest-dd-d; fewer than five digits give the trimmed input."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    n = F.length(d)
    return F.when(n < 5, F.trim(c)).otherwise(F.concat_ws("-", F.substr(d, F.lit(1), n - 3), F.substr(d, n - 2, F.lit(2)), F.substr(d, n, F.lit(1))))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def mentions(text: Column) -> Column:
    """array<struct<raw,normalized,type,confidence>>: numbers, keys, InChI, solvents or catalysts, conditions, formulas.

    Minus signs of conditions are kept. Null text has none.
    """
    text = F.coalesce(text, F.lit(""))

    def as_(kind: str, raw: Column, normalized: Column | None = None) -> Column:
        return F.struct(raw.alias("raw"), (raw if normalized is None else normalized).alias("normalized"), F.lit(kind).alias("type"), F.lit(CONFIDENCE[kind]).alias("confidence"))

    solvents, catalysts = _map(SOLVENTS), _map(CATALYSTS)

    def reagent(w: Column) -> Column:
        s, c = F.try_element_at(solvents, F.lower(w)), F.try_element_at(catalysts, F.lower(w))
        return F.when(s.isNotNull(), as_("solvent", w, s)).when(c.isNotNull(), as_("catalyst", w, c))

    conditions = F.transform(found(text, CONDITION), lambda x: F.trim(x))
    return F.concat(
        F.transform(F.filter(found(text, CAS), cas_valid), lambda x: as_("cas_number", x)),
        F.transform(found(text, INCHI_KEY), lambda x: as_("inchi_key", x)),
        F.transform(found(text, INCHI), lambda x: as_("inchi", x)),
        F.filter(F.transform(found(text, WORDS), reagent), lambda x: x.isNotNull()),
        F.transform(conditions, lambda x: as_("process_condition", x, F.replace(x, F.lit(" "), F.lit("")))),
        F.transform(F.filter(found(text, FORMULA), lambda x: ~x.isin(NOT_FORMULAS)), lambda x: as_("chemical_formula", x)),
    )


def simple_mentions(text: Column) -> Column:
    """Registry numbers, common names and tokens that are valid as structures, distinct in that order."""
    lower = F.lower(text)
    names = F.array_compact(F.array(*(F.when(lower.rlike(rf"\b{n}\b"), F.lit(n)) for n in COMMON_NAMES)))
    bare = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[,;.:()]+|[,;.:()]+$", ""))
    tokens = F.filter(bare, lambda w: (F.length(w) >= 3) & w.rlike(r"[=#@\[\]/\\]") & structure_error(w).isNull())
    return F.array_distinct(F.concat(found(text, ANY_CAS), names, tokens))


def structure_error(smiles: Column) -> Column:
    """Null for a plausible structure: balanced brackets, known characters and no carbon with three double branches."""
    s = F.trim(smiles)
    count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit("empty"))
        .when(s.rlike(r"C(?:\(=[A-Za-z]\)){3,}") | F.contains(s, F.lit("(=C)(=C)(=C)")), F.lit("valence"))
        .when((count("(") != count(")")) | (count("[") != count("]")), F.lit("brackets"))
        .when(~s.rlike(r"^[CNOFPSBIHlrcnofps0-9=#@+\-\[\]\\/().%: ]*$"), F.lit("characters"))
    )


def structure(smiles: Column) -> Column:
    """struct<valid, error, canonical, inchi_key, heavy_atoms, rings>: the check without a chemistry library.

    The key is a digest of the trimmed input, the same on every run.
    """
    s = F.trim(smiles)
    error = structure_error(smiles)
    ok = error.isNull()
    key = F.upper(F.translate(F.substring(F.sha2(s, 256), 1, 24), "0123456789", "GHIJKLMNOP"))
    return F.struct(
        ok.alias("valid"),
        error.alias("error"),
        F.when(ok, s).alias("canonical"),
        F.when(ok, F.concat(F.substring(key, 1, 14), F.lit("-"), F.substring(key, 15, 10), F.lit("-N"))).alias("inchi_key"),
        F.when(ok, F.size(found(s, r"([A-Z][a-z]?|[cnops])"))).alias("heavy_atoms"),
        F.when(ok, s.rlike(r"[1-9]").cast("int")).alias("rings"),
    )


def compare_structures(a: Column, b: Column) -> Column:
    """'invalid', 'identical_key', 'stereo', 'identical_smiles' or 'different' of two structure() values."""
    return (
        F.when(~a["valid"] | ~b["valid"], F.lit("invalid"))
        .when(a["inchi_key"] == b["inchi_key"], F.lit("identical_key"))
        .when(F.substring(a["inchi_key"], 1, 14) == F.substring(b["inchi_key"], 1, 14), F.lit("stereo"))
        .when(a["canonical"] == b["canonical"], F.lit("identical_smiles"))
        .otherwise(F.lit("different"))
    )


def recognition_consensus(first: tuple[Column, Column], second: tuple[Column, Column], threshold: float = 0.8, always_both: bool = False) -> Column:
    """struct<smiles, confidence, valid, disagreement, review> from two (structure text, confidence) predictions."""
    (sa, ca), (sb, cb) = first, second
    a, b = structure(sa), structure(sb)
    same = compare_structures(a, b).isin("identical_key", "identical_smiles")

    def result(smiles: Column, confidence: Column, valid: bool, differ: bool, review: bool) -> Column:
        return F.struct(smiles.alias("smiles"), confidence.alias("confidence"), F.lit(valid).alias("valid"), F.lit(differ).alias("disagreement"), F.lit(review).alias("review"))

    alone = a["valid"] & (ca >= threshold) & F.lit(not always_both)
    both = a["valid"] & b["valid"]
    return (
        F.when(alone, result(sa, ca, True, False, False))
        .when(both & same, result(sa, F.least(F.lit(0.99), F.greatest(ca, cb) + 0.1), True, False, False))
        .when(both, result(F.when(ca >= cb, sa).otherwise(sb), F.greatest(ca, cb), True, True, True))
        .when(b["valid"], result(sb, cb, True, True, False))
        .when(a["valid"], result(sa, ca, True, True, False))
        .otherwise(result(F.lit(None).cast("string"), F.lit(0.0), False, False, True))
    )


def lookup_route(identifier: Column) -> Column:
    """Which lookup an identifier goes to: inchikey, inchi, smiles, formula or name; null for an empty one."""
    c = F.trim(identifier)
    dashes = F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit("")))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string"))
        .when((F.length(c) == 27) & (dashes == 2), "inchikey")
        .when(F.startswith(c, F.lit("InChI=")), "inchi")
        .when(c.rlike(r"[=#@\[\]/\\]"), "smiles")
        .when((F.length(c) <= 12) & c.rlike(r"[0-9]") & ~F.contains(c, F.lit(" ")), "formula")
        .otherwise("name")
    )


def query_variants(q: Column) -> Column:
    """The query, its registry numbers and structures as search phrases, and itself without a conversational start."""
    cas = F.transform(found(q, ANY_CAS), lambda x: F.concat(F.lit("CAS "), x))
    smiles = F.transform(
        F.filter(found(q, r"([CNOFPSClBrI][A-Za-z0-9@+\-\[\]()\\=#$%/]{3,})"), lambda x: ~F.startswith(F.lower(x), F.lit("http"))), lambda x: F.concat(F.lit("structure "), x)
    )
    bare = F.trim(F.regexp_replace(q, r"(?i)^(what is|how to|can you tell me|find|describe|show me|explain)\s+", ""))
    return F.array_distinct(F.concat(F.array(q), cas, smiles, F.when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>"))))


def reaction_summary(r: Column) -> Column:
    """A reaction struct (title, reactants, products, catalysts, solvents, temperature, pressure, hours, yield) as lines."""
    listed = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))
    conditions = F.concat_ws(
        ", ",
        F.concat(r["temperature"].cast("string"), F.lit(" °C")),
        F.concat(r["pressure"].cast("string"), F.lit(" bar")),
        F.concat(r["hours"].cast("string"), F.lit(" h")),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[Reaction Scheme: "), r["title"], F.lit("]")),
        line("Reactants", listed(r["reactants"], " + ")),
        line("Products", listed(r["products"], " + ")),
        line("Catalysts", listed(r["catalysts"], ", ")),
        line("Solvents", listed(r["solvents"], ", ")),
        line("Conditions", F.nullif(conditions, F.lit(""))),
        line("Yield", F.concat(r["yield"].cast("string"), F.lit("%"))),
    )
