"""Identifiers, mentions, structures and calculations, over inputs derived from part and lineitem numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import chemistry as C
from orefield.functions import text as T
from orefield.operators import calc
from orefield.plans.registry import query, views
from orefield.plans.search import WORDS

# The same text derives the inputs in both engines. Even keys get the right check digit, odd ones the next.
DIGITS = "lpad(CAST(p_partkey + 1000 AS STRING), 4, '0')"
BODY = f"{DIGITS} || lpad(CAST(p_size AS STRING), 2, '0')"
CHECK = "(" + " + ".join(f"CAST(substr({BODY}, {6 - i}, 1) AS INT) * {i + 1}" for i in range(6)) + ")"
CAS_TEXT = f"{DIGITS} || '-' || lpad(CAST(p_size AS STRING), 2, '0') || '-' || CAST(({CHECK} + p_partkey % 2) % 10 AS STRING)"
CAS_VALID_SQL = """len(regexp_extract_all({0}, '^\\d+-\\d{{2}}-\\d$')) > 0 AND
  list_sum(list_transform(range(1, len(replace({0}, '-', ''))), lambda i: i * CAST(substr(replace({0}, '-', ''), CAST(len(replace({0}, '-', '')) - i AS BIGINT), 1) AS INT))) % 10
  = CAST(right({0}, 1) AS INT)"""


@query(f"WITH c AS (SELECT p_partkey, {CAS_TEXT} AS cas FROM part) SELECT p_partkey, cas, {CAS_VALID_SQL.format('cas')} AS valid FROM c")
def cas_checksum(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", F.expr(CAS_TEXT).alias("cas")).withColumn("valid", C.cas_valid(F.col("cas")))


LOOSE = f"CASE WHEN p_partkey % 3 = 0 THEN ' ' || {BODY} || '7' WHEN p_partkey % 3 = 1 THEN 'CAS ' || {CAS_TEXT} ELSE ' x' || CAST(p_size AS STRING) || ' ' END"


@query(
    f"""WITH c AS (SELECT p_partkey, {LOOSE} AS raw FROM part), d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM c)
    SELECT p_partkey, CASE WHEN len(d) < 5 THEN trim(raw) ELSE d[:-4] || '-' || d[-3:-2] || '-' || d[-1:] END AS cas FROM d"""
)
def cas_normalize(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", C.cas_normalize(F.expr(LOOSE)).alias("cas"))


SENTENCE = f"""'Sample ' || CASE WHEN p_partkey % 4 = 0 THEN {CAS_TEXT} || ' in THF' WHEN p_partkey % 4 = 1 THEN 'H2SO' || CAST(p_size AS STRING) || ' and Pd/C with toluene'
  WHEN p_partkey % 4 = 2 THEN 'ABCDEFGHIJKLMN-ABCDEFGHIJ-K at -' || CAST(p_size AS STRING) || ' bar for 3.5 hours, USA' ELSE p_name || ' InChI=1S/C2H' || CAST(p_size AS STRING) || '/c1-2 5 min' END"""
_LIST = lambda pattern: f"regexp_extract_all(t, '{pattern}', 1)"
_PAIRS = lambda d: "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in d.items()) + "}"


@query(
    f"""WITH s AS (SELECT p_partkey, {SENTENCE} AS t FROM part), m AS (
      SELECT p_partkey, unnest(
        list_transform(list_filter({_LIST(C.CAS)}, lambda x: {CAS_VALID_SQL.format('x')}), lambda x: {{'raw': x, 'normalized': x, 'type': 'cas_number', 'confidence': 0.99}})
        || list_transform({_LIST(C.INCHI_KEY)}, lambda x: {{'raw': x, 'normalized': x, 'type': 'inchi_key', 'confidence': 0.98}})
        || list_transform({_LIST(C.INCHI)}, lambda x: {{'raw': x, 'normalized': x, 'type': 'inchi', 'confidence': 0.98}})
        || list_transform(list_filter({_LIST(C.WORDS)}, lambda x: {_PAIRS(C.SOLVENTS)}[lower(x)] IS NOT NULL), lambda x: {{'raw': x, 'normalized': {_PAIRS(C.SOLVENTS)}[lower(x)], 'type': 'solvent', 'confidence': 0.95}})
        || list_transform(list_filter({_LIST(C.WORDS)}, lambda x: {_PAIRS(C.CATALYSTS)}[lower(x)] IS NOT NULL), lambda x: {{'raw': x, 'normalized': {_PAIRS(C.CATALYSTS)}[lower(x)], 'type': 'catalyst', 'confidence': 0.95}})
        || list_transform({_LIST(C.CONDITION)}, lambda x: {{'raw': trim(x), 'normalized': replace(trim(x), ' ', ''), 'type': 'process_condition', 'confidence': 0.90}})
        || list_transform(list_filter({_LIST(C.FORMULA)}, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in C.NOT_FORMULAS)})), lambda x: {{'raw': x, 'normalized': x, 'type': 'chemical_formula', 'confidence': 0.75}}), recursive := true) FROM s)
    SELECT p_partkey, raw, normalized, type, CAST(confidence AS DOUBLE) AS confidence FROM m"""
)
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", F.inline(C.mentions(F.expr(SENTENCE))))


@query(
    f"""SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '{C.FORMULA}', 1), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in C.NOT_FORMULAS)}))) AS n_formulas FROM documents"""
)
def document_formulas(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    kept = F.filter(C.found(F.col("text"), C.FORMULA), lambda x: ~x.isin(C.NOT_FORMULAS))
    return docs.select("doc_id", F.size(kept).cast("long").alias("n_formulas"))


ODD_NAME = "CASE WHEN p_partkey % 3 = 0 THEN translate(p_name, 'oeast', '03457') WHEN p_partkey % 3 = 1 THEN 'M3th -- ' || p_name || '..é!' ELSE 'vx ' || p_name || ' GB' END"


@query(
    f"""WITH s AS (SELECT p_partkey, {ODD_NAME} AS t FROM part),
    a AS (SELECT p_partkey, t, translate(lower(regexp_replace(translate(t, '{T.ACCENTS[0]}', '{T.ACCENTS[1]}'), '[^\\x00-\\x7F]', '', 'g')), '{T.LOOK_ALIKE[0]}', '{T.LOOK_ALIKE[1]}') AS x FROM s),
    b AS (SELECT p_partkey, t, trim(regexp_replace(regexp_replace(regexp_replace(x, '[\\-_.]{{2,}}', ' ', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS y FROM a)
    SELECT p_partkey, array_to_string(list_transform(string_split(y, ' '), lambda w: coalesce({_PAIRS(T.ABBREVIATIONS)}[w], w)), ' ') AS normalized,
      regexp_replace(translate(trim(lower(t)), '{T.SCREEN_LOOK_ALIKE[0]}', '{T.SCREEN_LOOK_ALIKE[1]}'), '[\\s_,.*#]+', '', 'g') AS deobfuscated FROM b"""
)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    t = F.expr(ODD_NAME)
    return part.select("p_partkey", T.normalize_name(t).alias("normalized"), T.deobfuscate(t).alias("deobfuscated"))


@query(
    f"""WITH s AS (SELECT p_partkey, {WORDS.format("p_name")} AS a, {WORDS.format("p_name || ' ' || p_brand")} AS b FROM part)
    SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS score FROM s"""
)
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    score = T.jaccard(T.tokens("p_name"), T.tokens(F.concat_ws(" ", "p_name", "p_brand")))
    return part.select("p_partkey", F.round(score, 6).alias("score"))


SMILES_A = "CASE p_partkey % 6 WHEN 0 THEN 'CC(=O)O' || CAST(p_size AS STRING) WHEN 1 THEN 'C(=C)(=C)(=C)C' WHEN 2 THEN 'CC(C' WHEN 3 THEN 'CCO' WHEN 4 THEN 'X?Y' ELSE ' c1ccccc1 ' END"
SMILES_B = "CASE WHEN p_partkey % 4 = 0 THEN 'CCO' WHEN p_partkey % 4 = 1 THEN 'c1ccccc1' WHEN p_partkey % 4 = 2 THEN 'CC(=O)O' || CAST(p_size AS STRING) ELSE '' END"
CONF_A, CONF_B = "CAST(p_size AS DOUBLE) / 50", "CAST((p_partkey * 7) % 50 AS DOUBLE) / 50"


def _error_sql(s: str) -> str:
    s = f"trim({s})"
    n = lambda c: f"(len({s}) - len(replace({s}, '{c}', '')))"
    return f"""CASE WHEN coalesce({s}, '') = '' THEN 'empty' WHEN regexp_matches({s}, 'C(?:\\(=[A-Za-z]\\)){{3,}}') OR contains({s}, '(=C)(=C)(=C)') THEN 'valence'
      WHEN {n("(")} <> {n(")")} OR {n("[")} <> {n("]")} THEN 'brackets' WHEN NOT regexp_matches({s}, '^[CNOFPSBIHlrcnofps0-9=#@+\\-\\[\\]\\\\/().%: ]*$') THEN 'characters' END"""


@query(
    f"""WITH s AS (SELECT p_partkey, {SMILES_A} AS a FROM part), e AS (SELECT *, {_error_sql("a")} AS error FROM s),
    k AS (SELECT *, upper(translate(left(sha256(trim(a)), 24), '0123456789', 'GHIJKLMNOP')) AS k FROM e)
    SELECT p_partkey, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN trim(a) END AS canonical,
      CASE WHEN error IS NULL THEN left(k, 14) || '-' || substr(k, 15, 10) || '-N' END AS inchi_key,
      CASE WHEN error IS NULL THEN CAST(len(regexp_extract_all(trim(a), '([A-Z][a-z]?|[cnops])')) AS INT) ELSE 0 END AS heavy_atoms,
      CASE WHEN error IS NULL THEN CAST(regexp_matches(a, '[1-9]') AS INT) ELSE 0 END AS rings FROM k"""
)
def structure_fallback(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", C.structure(F.expr(SMILES_A)).alias("s")).select("p_partkey", "s.*").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("heavy_atoms", "rings")})


COMPARE_SQL = f"""WITH s AS (SELECT p_partkey, {SMILES_A} AS a, {SMILES_B} AS b, {CONF_A} AS ca, {CONF_B} AS cb FROM part),
    e AS (SELECT *, {_error_sql("a")} IS NULL AS va, {_error_sql("b")} IS NULL AS vb, trim(a) = trim(b) AS same FROM s)"""


@query(f"{COMPARE_SQL} SELECT p_partkey, CASE WHEN NOT va OR NOT vb THEN 'invalid' WHEN same THEN 'identical_key' ELSE 'different' END AS verdict FROM e")
def structure_compare(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", C.compare_structures(C.structure(F.expr(SMILES_A)), C.structure(F.expr(SMILES_B))).alias("verdict"))


@query(
    f"""{COMPARE_SQL} SELECT p_partkey,
      CASE WHEN va AND ca >= 0.8::DOUBLE THEN a WHEN va AND vb AND same THEN a WHEN va AND vb THEN CASE WHEN ca >= cb THEN a ELSE b END WHEN vb THEN b WHEN va THEN a END AS smiles,
      CASE WHEN va AND ca >= 0.8::DOUBLE THEN ca WHEN va AND vb AND same THEN least(0.99::DOUBLE, greatest(ca, cb) + 0.1::DOUBLE) WHEN va AND vb THEN greatest(ca, cb) WHEN vb THEN cb WHEN va THEN ca ELSE 0 END AS confidence,
      va OR vb AS valid, NOT (va AND ca >= 0.8::DOUBLE) AND (va OR vb) AND NOT (va AND vb AND same) AS disagreement,
      NOT (va AND ca >= 0.8::DOUBLE) AND ((va AND vb AND NOT same) OR NOT (va OR vb)) AS review FROM e"""
)
def ocsr_consensus(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    c = C.recognition_consensus((F.expr(SMILES_A), F.expr(CONF_A)), (F.expr(SMILES_B), F.expr(CONF_B)))
    return part.select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


ID_TEXT = f"CASE p_partkey % 7 WHEN 0 THEN 'ABCDEFGHIJKLMN-ABCDEFGHIJ-K' WHEN 1 THEN 'InChI=1S/C2' WHEN 2 THEN 'CC=O' WHEN 3 THEN 'C2H6O' WHEN 4 THEN p_name WHEN 5 THEN ' ' ELSE {CAS_TEXT} END"


@query(
    f"""WITH s AS (SELECT p_partkey, trim({ID_TEXT}) AS c FROM part) SELECT p_partkey, CASE WHEN c = '' THEN NULL WHEN len(c) = 27 AND len(c) - len(replace(c, '-', '')) = 2 THEN 'inchikey'
      WHEN starts_with(c, 'InChI=') THEN 'inchi' WHEN regexp_matches(c, '[=#@\\[\\]/\\\\]') THEN 'smiles' WHEN len(c) <= 12 AND regexp_matches(c, '[0-9]') AND NOT contains(c, ' ') THEN 'formula' ELSE 'name' END AS route FROM s"""
)
def lookup_routing(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", C.lookup_route(F.expr(ID_TEXT)).alias("route"))


ASK = f"CASE p_partkey % 4 WHEN 0 THEN 'What is ' || p_name || '?' WHEN 1 THEN 'find ' || {CAS_TEXT} || ' data' WHEN 2 THEN 'explain CCO1=CC reactivity' ELSE p_name END"


@query(
    f"""WITH s AS (SELECT p_partkey, {ASK} AS q FROM part), v AS (SELECT p_partkey, [q]
      || list_transform(regexp_extract_all(q, '{C.ANY_CAS}', 1), lambda x: 'CAS ' || x)
      || list_transform(list_filter(regexp_extract_all(q, '([CNOFPSClBrI][A-Za-z0-9@+\\-\\[\\]()\\\\=#$%/]{{3,}})', 1), lambda x: NOT starts_with(lower(x), 'http')), lambda x: 'structure ' || x)
      || [trim(regexp_replace(q, '(?i)^(what is|how to|can you tell me|find|describe|show me|explain)\\s+', ''))] AS v FROM s)
    SELECT DISTINCT p_partkey, unnest(v) AS variant FROM v"""
)
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", F.explode(C.query_variants(F.expr(ASK))).alias("variant"))


NOTE = "CASE p_partkey % 3 WHEN 0 THEN 'Caffeine and aspirin, CC(=O)O; 50-00-0' WHEN 1 THEN 'benzoic acid (C1=CC) [x' ELSE p_name END"


@query(
    f"""WITH s AS (SELECT p_partkey, {NOTE} AS t FROM part), m AS (SELECT p_partkey, regexp_extract_all(t, '{C.ANY_CAS}', 1)
      || list_filter([{", ".join(f"'{n}'" for n in C.COMMON_NAMES)}], lambda n: regexp_matches(lower(t), '\\b' || n || '\\b'))
      || list_filter(list_transform(regexp_split_to_array(trim(t), '\\s+'), lambda w: regexp_replace(w, '^[,;.:()]+|[,;.:()]+$', '', 'g')),
        lambda w: len(w) >= 3 AND regexp_matches(w, '[=#@\\[\\]/\\\\]') AND ({_error_sql("w")}) IS NULL) AS m FROM s)
    SELECT DISTINCT p_partkey, unnest(m) AS mention FROM m"""
)
def chemical_mentions(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", F.explode(C.simple_mentions(F.expr(NOTE))).alias("mention"))


FROM_UNIT = "CASE p_partkey % 6 WHEN 0 THEN 'mg' WHEN 1 THEN ' ML' WHEN 2 THEN 'mM' WHEN 3 THEN 'C' WHEN 4 THEN 'kelvin' ELSE 'g' END"
TO_UNIT = "CASE p_partkey % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'um' WHEN 3 THEN 'K' WHEN 4 THEN 'c' ELSE 'l' END"
_UNIT_ROWS = ", ".join(f"('{k}', '{u}', {f!r}::DOUBLE)" for k, us in calc.UNITS.items() for u, f in us.items())


@query(
    f"""WITH u(kind, unit, f) AS (VALUES {_UNIT_ROWS}), s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v, lower(trim({FROM_UNIT})) AS a, lower(trim({TO_UNIT})) AS b FROM part)
    SELECT p_partkey, CASE WHEN x.kind IS NOT NULL THEN 'unit_conversion_' || x.kind WHEN (a = 'c' AND b = 'k') OR (a = 'kelvin' AND b = 'c') THEN 'unit_conversion_temperature' END AS kind,
      CASE WHEN x.kind IS NOT NULL THEN round(v * x.f / y.f, 6) WHEN a = 'c' AND b = 'k' THEN round(v + 273.15::DOUBLE, 2) WHEN a = 'kelvin' AND b = 'c' THEN round(v - 273.15::DOUBLE, 2) END AS value
    FROM s LEFT JOIN (SELECT x.unit AS ux, y.unit AS uy, x.kind FROM u x JOIN u y ON x.kind = y.kind) k ON k.ux = a AND k.uy = b
      LEFT JOIN u x ON x.unit = a AND x.kind = k.kind LEFT JOIN u y ON y.unit = b AND y.kind = k.kind"""
)
def unit_conversion(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    c = calc.convert_unit(F.col("p_size").cast("double"), F.expr(FROM_UNIT), F.expr(TO_UNIT))
    return part.select("p_partkey", c.alias("c")).select("p_partkey", "c.kind", "c.value")


@query(
    """WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) AS b FROM part)
    SELECT p_partkey, CASE WHEN b > 0 THEN round(a / b, 6) END AS moles, CASE WHEN b <= 0 THEN 'molecular weight must be positive' END AS reason, round(a * b, 4) AS mass,
      CASE WHEN b > 0 THEN round(a / b, 6) END AS molarity, CASE WHEN b > 0 THEN round(a / b * 100, 2) END AS percent_yield FROM s"""
)
def molar_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    a, b = F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")
    n = calc.moles(a, b)
    return part.select("p_partkey", n["value"].alias("moles"), n["reason"].alias("reason"), calc.mass(a, b).alias("mass"), calc.molarity(a, b)["value"].alias("molarity"), calc.percent_yield(a, b)["value"].alias("percent_yield"))


@query(
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS c1, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE (p_partkey % 9)::DOUBLE END AS v1,
      CASE WHEN p_partkey % 5 = 2 THEN NULL ELSE (p_partkey % 4)::DOUBLE END AS c2, CASE WHEN p_partkey % 5 = 3 THEN NULL ELSE 2.5::DOUBLE END AS v2 FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'c1' WHEN 1 THEN 'v1' WHEN 2 THEN 'c2' WHEN 3 THEN 'v2' END AS unknown,
      CASE p_partkey % 5 WHEN 0 THEN round(c2 * v2 / nullif(v1, 0), 6) WHEN 1 THEN round(c2 * v2 / nullif(c1, 0), 4) WHEN 2 THEN round(c1 * v1 / nullif(v2, 0), 6) WHEN 3 THEN round(c1 * v1 / nullif(c2, 0), 4) END AS value FROM s"""
)
def dilution(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    hole = lambda i, c: F.when(F.col("p_partkey") % 5 != i, c.cast("double"))
    d = calc.dilution(hole(0, F.col("p_size")), hole(1, F.col("p_partkey") % 9), hole(2, F.col("p_partkey") % 4), hole(3, F.lit(2.5)))
    return part.select("p_partkey", d.alias("d")).select("p_partkey", "d.unknown", "d.value")


@query(
    """SELECT l_returnflag, round(avg(l_quantity::DOUBLE), 4) AS mean, round(quantile_cont(l_quantity::DOUBLE, 0.5), 4) AS median, round(coalesce(stddev_samp(l_quantity::DOUBLE), 0), 4) AS stdev,
      round(stddev_samp(l_quantity::DOUBLE) / avg(l_quantity::DOUBLE) * 100, 2) AS rsd_percent, round(min(l_quantity::DOUBLE), 4) AS min, round(max(l_quantity::DOUBLE), 4) AS max, count(*) AS n FROM lineitem GROUP BY l_returnflag"""
)
def descriptive_stats(spark: SparkSession, sf: str) -> DataFrame:
    (li,) = views(spark, sf, "lineitem")
    return calc.describe(li.select("l_returnflag", F.col("l_quantity").cast("double").alias("q")), "q", "l_returnflag")


CALC = """CASE p_partkey % 5 WHEN 0 THEN 'Actual yield: ' || CAST(p_size AS STRING) || ' g, theoretical 60 g' WHEN 1 THEN 'how many moles in ' || CAST(p_size AS STRING) || ' g of it (MW 180.16)'
  WHEN 2 THEN 'convert ' || CAST(p_size AS STRING) || ' mg to g' WHEN 3 THEN 'mean of 1.5, ' || CAST(p_size AS STRING) || ' and -2.5' ELSE 'mean of ' || p_name END"""


@query(
    f"""WITH s AS (SELECT p_partkey, {CALC} AS q FROM part), n AS (SELECT *, list_transform(regexp_extract_all(q, '{calc.NUMBERS}', 1), lambda x: x::DOUBLE) AS v,
      try_cast(regexp_extract(lower(q), '{calc.YIELD}', 1) AS DOUBLE) AS ya, try_cast(regexp_extract(lower(q), '{calc.YIELD}', 2) AS DOUBLE) AS yb,
      try_cast(regexp_extract(lower(q), '{calc.MOLES}', 1) AS DOUBLE) AS ma, try_cast(regexp_extract(lower(q), '{calc.MOLES}', 2) AS DOUBLE) AS mb, try_cast(regexp_extract(lower(q), '{calc.CONVERT}', 1) AS DOUBLE) AS ca FROM s)
    SELECT p_partkey, round(ya / yb * 100, 2) AS percent_yield, round(ma / mb, 6) AS moles, round(ca * 0.001::DOUBLE / 1, 6) AS converted,
      CASE WHEN regexp_matches(lower(q), 'mean|statistics|standard deviation') AND len(v) >= 3 THEN round(list_avg(v), 6) END AS mean FROM n"""
)
def calc_parse(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    p = part.select("p_partkey", calc.parse_calculation(F.expr(CALC)).alias("c"))
    mean = F.aggregate("c.values", F.lit(0.0), lambda s, x: s + x) / F.size("c.values")
    return p.select("p_partkey", "c.percent_yield", "c.moles", "c.converted", F.round(mean, 6).alias("mean"))


@query(
    """SELECT p_partkey, concat_ws(chr(10), '[Reaction Scheme: ' || p_brand || ']', 'Reactants: ' || p_name || ' + water', CASE WHEN p_partkey % 2 = 0 THEN 'Products: ' || p_type END,
      'Conditions: ' || concat_ws(', ', p_size || ' °C', CASE WHEN p_partkey % 3 = 0 THEN '2 bar' END), CASE WHEN p_partkey % 5 = 0 THEN 'Yield: 80%' END) AS summary FROM part"""
)
def reaction_summary(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    r = F.struct(
        F.col("p_brand").alias("title"), F.array("p_name", F.lit("water")).alias("reactants"), F.when(key % 2 == 0, F.array("p_type")).otherwise(none).alias("products"),
        none.alias("catalysts"), none.alias("solvents"), F.col("p_size").alias("temperature"), F.when(key % 3 == 0, 2).alias("pressure"), F.lit(None).cast("int").alias("hours"), F.when(key % 5 == 0, 80).alias("yield"),
    )
    return part.select("p_partkey", r.alias("r")).select("p_partkey", C.reaction_summary(F.col("r")).alias("summary"))
