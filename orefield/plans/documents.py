"""Classification, extraction, chunking, citations and markup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.operators import chunking, citations, extract
from orefield.plans.chemistry import SENTENCE
from orefield.plans.registry import query, views
from orefield.plans.search import WORDS

# Genre headings, file names and page counts by document number, before the document's own text.
HEAD = """CASE doc_id % 8 WHEN 0 THEN 'Safety Data Sheet. First-aid measures. CAS no: 50-00-0 H301 H302 ' WHEN 1 THEN 'Standard Operating Procedure SOP number 3. Revision history. ' WHEN 2 THEN 'Laboratory notebook, batch no 7. Yield: 80 '
  WHEN 3 THEN 'Abstract. Results and discussion. Conclusion. References. doi: 10.1234/x ' WHEN 4 THEN 'Chapter 1 Chapter 2 Chapter 3 Chapter 4 Exercises. ISBN ' WHEN 5 THEN 'Technical report. Executive summary. ' WHEN 6 THEN 'Abstract. Index. ' ELSE '' END"""
NAME = "CASE doc_id % 5 WHEN 0 THEN 'my_SDS.pdf' WHEN 1 THEN 'sop-7.pdf' WHEN 2 THEN 'report.pdf' ELSE '' END"
N_PAGES = "CAST(doc_id % 150 AS INT)"
GENRE_TEXT = f"{HEAD} || text"


def _genre_sql() -> str:
    plain = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7F]', '_', 'g')"
    sums = []
    for genre, signals in extract.GENRES.items():
        parts = [f"{w}::DOUBLE * least(len(regexp_extract_all(t, '{p}')), 3)" for p, w in signals.items()]
        sums.append(f"{' + '.join(parts)} AS {genre}0")
    names = list(extract.GENRES)
    return f"""WITH d AS (SELECT doc_id, {plain(f"lower({NAME} || chr(10) || {GENRE_TEXT})")} AS t, lower({NAME}) AS f, {N_PAGES} AS p FROM documents),
      a AS (SELECT doc_id, f, p, {", ".join(sums)} FROM d),
      s AS (SELECT doc_id, [sds0 + CASE WHEN p <= 16 AND sds0 > 2 THEN 2 ELSE 0 END + CASE WHEN contains(f, 'sds') THEN 3 ELSE 0 END, sop0 + CASE WHEN contains(f, 'sop') THEN 3 ELSE 0 END,
        experimental_report0, research_paper0, textbook0 + CASE WHEN p > 100 THEN 4 ELSE 0 END, technical_report0 + CASE WHEN contains(f, 'report') THEN 1.5::DOUBLE ELSE 0 END] AS v FROM a),
      c AS (SELECT doc_id, v, list_sum(v) AS total, CASE WHEN list_sum(v) = 0 THEN 0 ELSE round(least(list_max(v) / (list_sum(v) + 1), 1), 2) END AS confidence FROM s)
      SELECT doc_id, CASE WHEN total = 0 OR confidence < 0.4::DOUBLE THEN 'unknown' ELSE {names}[list_position(v, list_max(v))] END AS genre, confidence FROM c"""


@query(_genre_sql())
def genre_classify(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    scored = docs.select("doc_id", extract.genre_scores(F.expr(GENRE_TEXT), F.expr(NAME), F.expr(N_PAGES)).alias("s"))
    v = extract.genre_verdict(F.col("s"))
    return scored.select("doc_id", v["genre"].alias("genre"), v["confidence"].alias("confidence"))


CAPTION = "CASE p_partkey % 6 WHEN 0 THEN 'Scheme 2: route' WHEN 1 THEN 'Structure of it' WHEN 2 THEN '1H NMR spectrum' WHEN 3 THEN 'SEM micrograph' WHEN 4 THEN p_name ELSE 'Synthesis of plot' END"


@query(f"WITH s AS (SELECT p_partkey, lower(trim({CAPTION})) AS c FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{k}'" for k, p in extract.CAPTIONS.items()) + " ELSE 'unknown' END AS category FROM s")
def image_captions(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", extract.image_class(F.expr(CAPTION)).alias("category"))


QUESTION = """CASE (conv_id + turn * 3) % 9 WHEN 0 THEN 'What is the paper about' WHEN 1 THEN 'Calculate the yield in %' WHEN 2 THEN 'SMILES of x' WHEN 3 THEN 'Boiling point here' WHEN 4 THEN 'reaction mechanism'
  WHEN 5 THEN 'compare both' WHEN 6 THEN 'tabun facts' WHEN 7 THEN 'Who wrote this study' ELSE text END"""


def _has(c: str, words: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({c}, w))) > 0"


INTENT_SQL = f"""WITH s AS (SELECT conv_id, turn, lower({QUESTION}) AS q FROM conversations), i AS (SELECT *, CASE WHEN {_has("q", extract.RESTRICTED)} THEN 'safety_hazard'
    WHEN {_has("q", extract.CALCULATION)} AND {_has("q", extract.CALCULATION_UNITS)} THEN 'calculation_analytics' {" ".join(f"WHEN {_has('q', w)} THEN '{n}'" for n, w in extract.INTENT_WORDS.items())}
    WHEN len(list_filter([{", ".join(repr(w) for w in extract.FACTOID_STARTS)}], lambda w: starts_with(q, w))) > 0 THEN 'factoid' ELSE 'general' END AS intent FROM s)"""


def _intents(spark: SparkSession, sf: str) -> DataFrame:
    (turns,) = views(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.expr(QUESTION).alias("q")).withColumn("intent", extract.intent(F.col("q")))


@query(INTENT_SQL + " SELECT conv_id, turn, intent FROM i")
def intent_route(spark: SparkSession, sf: str) -> DataFrame:
    return _intents(spark, sf).drop("q")


@query(
    INTENT_SQL
    + f""", n AS (SELECT *, intent IN ('factoid', 'chemical_property', 'reaction_synthesis', 'comparison', 'general') OR {_has("q", ("document", "paper", "study"))} AS retrieval,
      intent IN ('chemical_identity', 'chemical_property', 'reaction_synthesis') OR {_has("q", extract.CHEMICAL)} AS chemistry,
      intent = 'calculation_analytics' OR {_has("q", ("calculate", "how many moles", "percent yield", "dilute", "molarity"))} AS calculation, intent = 'safety_hazard' AS restricted FROM i)
    SELECT conv_id, turn, retrieval, chemistry, calculation, restricted, CASE WHEN restricted THEN 'aggregator' ELSE concat_ws('>', CASE WHEN chemistry THEN 'chemistry' END, CASE WHEN retrieval THEN 'retrieval' END,
      CASE WHEN calculation THEN 'analytics' END, 'aggregator') END AS subtasks,
      CASE WHEN restricted THEN 'aggregator' WHEN chemistry THEN 'chemistry' WHEN retrieval THEN 'retrieval' WHEN calculation THEN 'analytics' ELSE 'aggregator' END AS next_step FROM n"""
)
def evidence_needs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _intents(spark, sf).withColumn("n", extract.evidence_needs(F.col("q"), F.col("intent"))).withColumn("tasks", extract.subtasks(F.col("n")))
    pending = F.transform("tasks", lambda t: F.struct(t.alias("agent"), F.lit("pending").alias("status")))
    return rows.select("conv_id", "turn", "n.*", F.array_join("tasks", ">").alias("subtasks"), extract.next_step(~F.col("n.restricted"), pending).alias("next_step"))


PROCEDURE = """CASE p_partkey % 5 WHEN 0 THEN 'The mixture was heated to ' || CAST(p_size AS STRING) || ' °C at 2 MPa for 90 min in THF with Pd/C.' WHEN 1 THEN 'Stirred at ' || CAST(p_size + 273 AS STRING) || ' K and 150 kPa for 2 h. The yield was ' || CAST(p_size AS STRING) || ' %.'
  WHEN 2 THEN 'Reaction of Benzene and Aniline-Oxide gave Phenol in water and base, nothing else noted.' WHEN 3 THEN 'A plain text without any of the words that are looked for.' ELSE 'Product added.' END"""
TWO = f"{PROCEDURE} || chr(10) || chr(10) || 'Then reflux with ' || p_name || ' was kept for 3 hours at 1 bar.'"
_R = lambda p, i: f"regexp_extract(p, '{p}', {i})"
_N = lambda p: f"try_cast(nullif({_R(p, 1)}, '') AS DOUBLE)"
_OPTION = lambda o: "CASE " + " ".join(f"WHEN regexp_matches(p, '(?i)\\b{k}\\b') THEN '{v}'" for k, v in o.items()) + " END"


@query(
    f"""WITH s AS (SELECT p_partkey, list_filter(list_transform(string_split({TWO}, chr(10) || chr(10)), lambda x: trim(x)), lambda x: len(x) > 30 AND {_has("lower(x)", extract.MARKERS)}) AS ps FROM part),
    r AS (SELECT p_partkey, unnest(range(len(ps))) AS paragraph, unnest(ps) AS p FROM s),
    v AS (SELECT *, {_N(extract.TEMPERATURE)} - CASE WHEN lower({_R(extract.TEMPERATURE, 2)}) = 'k' THEN 273.15::DOUBLE ELSE 0 END AS t, {_N(extract.PRESSURE)} * CASE lower({_R(extract.PRESSURE, 2)}) WHEN 'mpa' THEN 10 ELSE 1 END AS pr,
      lower({_R(extract.PRESSURE, 2)}) AS pu, {_N(extract.TIME)} AS h, lower({_R(extract.TIME, 2)}) AS hu, {_N(extract.YIELD)} AS y, {_OPTION(extract.EXPERIMENT_SOLVENTS)} AS solvent, {_OPTION({c: c for c in extract.EXPERIMENT_CATALYSTS})} AS catalyst,
      list_filter(regexp_extract_all(p, '\\b([A-Z][a-z0-9]*(?:-[A-Z][a-z0-9]*)*)\\b', 1), lambda w: len(w) > 2 AND w NOT IN ({", ".join(repr(w) for w in extract.NOT_PARTICIPANTS)})) AS names FROM r)
    SELECT p_partkey, CAST(paragraph AS INT) AS paragraph, round(t, 1) AS temperature, round(CASE WHEN pu = 'kpa' THEN pr / 100 ELSE pr END, 2) AS pressure, solvent, catalyst,
      round(CASE WHEN starts_with(hu, 'min') THEN h / 60 ELSE h END, 2) AS hours, y AS yield_percent, array_to_string(names[1:3], ',') AS reactants, array_to_string(names[4:5], ',') AS products,
      CASE WHEN coalesce(round(t, 1), 0) <> 0 OR coalesce(y, 0) <> 0 OR solvent IS NOT NULL THEN 0.88::DOUBLE ELSE 0.7 END AS confidence FROM v"""
)
def experiment_extract(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    out = extract.experiments(part.select("p_partkey", F.expr(TWO).alias("text")))
    return out.drop("description").withColumns({c: F.array_join(c, ",") for c in ("reactants", "products")})


EQUATION = "CASE p_partkey % 5 WHEN 0 THEN 'k = A exp(-E/RT)  (' || CAST(p_size AS STRING) || ')' WHEN 1 THEN '$$ x_eq = y^2 $$' WHEN 2 THEN 'ΔH ≈ ' || CAST(p_size AS STRING) || ' ± 3' WHEN 3 THEN 'pH > 7 in ' || p_name ELSE p_name END"


def _latex_sql(c: str) -> str:
    out = f"trim(regexp_replace(trim({c}), '^\\$\\$|\\$\\$$|^\\\\\\[|\\\\\\]$|^\\$|\\$$', '', 'g'))"
    for symbol, latex in extract.SYMBOLS.items():
        out = f"replace({out}, '{symbol}', ' {latex} ')"
    out = f"regexp_replace({out}, '([A-Za-z0-9)])\\^([A-Za-z0-9\\-+]+)', '\\1^{{\\2}}', 'g')"
    out = f"regexp_replace({out}, '([A-Za-z0-9)])_([A-Za-z0-9]+)', '\\1_{{\\2}}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(
    f"""WITH s AS (SELECT p_partkey, trim({EQUATION}) AS t FROM part), c AS (SELECT *, CASE WHEN (regexp_matches(t, '{extract.EQUATION_NUMBER}') AND regexp_matches(t, '{extract.OPERATOR}')) OR regexp_matches(t, '{extract.LATEX}') THEN 0.95::DOUBLE
      WHEN len(t) < 250 AND regexp_matches(t, '{extract.OPERATOR}') AND regexp_matches(t, '[{"".join(extract.SYMBOLS)}]') THEN 0.75 END AS confidence FROM s)
    SELECT p_partkey, confidence, CASE WHEN confidence IS NOT NULL THEN {_latex_sql("t")} END AS latex FROM c"""
)
def equation_detect(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    return part.select("p_partkey", extract.equation(F.expr(EQUATION)).alias("e")).select("p_partkey", "e.confidence", "e.latex")


@query(
    """SELECT l_orderkey, l_linenumber, 'Table 1' AS x, '[Table 1: Line ' || l_linenumber || ']' || chr(10) || 'Row 1: Qty (kg): ' || CAST(l_quantity AS INT) || ' | Flag: ' || l_returnflag || ' | Col 3: ' || l_linestatus || chr(10) || 'Notes: * per order' AS text,
      '<table><caption>c</caption><thead><tr><th>Qty (kg)</th><th>Flag</th></tr></thead><tbody><tr><td>' || CAST(l_quantity AS INT) || '</td><td>' || l_returnflag || '</td><td>' || l_linestatus || '</td></tr></tbody></table>' AS html, 'kg' AS unit
    FROM lineitem"""
)
def table_row_context(spark: SparkSession, sf: str) -> DataFrame:
    (li,) = views(spark, sf, "lineitem")
    headers = F.array(F.lit("Qty (kg)"), F.lit("Flag"))
    rows = F.array(F.array(F.col("l_quantity").cast("int").cast("string"), "l_returnflag", "l_linestatus"))
    text = extract.table_text(F.lit(1), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")), headers, rows, F.array(F.lit("* per order")))
    html = extract.table_html(F.lit("c"), headers, rows)
    return li.select("l_orderkey", "l_linenumber", F.lit("Table 1").alias("x"), text.alias("text"), html.alias("html"), extract.header_unit(F.lit("Qty (kg)")).alias("unit"))


TABLE = "'Intro ' || p_name || chr(10) || 'Table ' || CAST(p_size AS STRING) || ': yields' || chr(10) || '| Run | Yield (%) |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || CAST(p_size AS STRING) || ' |' || chr(10) || '* measured once' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '2  77' END || chr(10) || 'tail | x'"


@query(
    f"""SELECT p_partkey AS id, 1 AS table_index, 'Table ' || p_size || ': yields' AS caption, 'Run|Yield (%)' AS headers, '1,' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ';2,77;tail,x' END AS rows, '%' AS units, '* measured once' AS footnotes FROM part"""
)
def text_tables(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    out = extract.text_tables(part.select("p_partkey", F.expr(TABLE).alias("text")), "p_partkey")
    return out.select(
        "id", "table_index", "caption", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"),
        F.array_join(F.transform("units", lambda u: u["unit"]), ",").alias("units"), F.array_join("footnotes", ";").alias("footnotes"),
    )


NOTE = "CASE p_partkey % 3 WHEN 0 THEN 'Yield of ' || CAST(p_size AS STRING) || ' % and conversion 12.5%' WHEN 1 THEN 'the YIELD ' || CAST(p_size + 5 AS STRING) || '%' ELSE p_name END"


@query(
    f"""WITH c AS (SELECT CAST(p_size AS INT) % 20 * 100 + p_partkey % 50 AS query_id, p_partkey AS position, {NOTE} AS text FROM part), f AS (SELECT query_id, position, unnest(range(len(v))) AS n, CAST(unnest(v) AS DOUBLE) AS v FROM
      (SELECT query_id, position, regexp_extract_all(text, '(?i)(?:yield|conversion)\\s+(?:of\\s+)?(\\d+(?:\\.\\d+)?)\\s*%', 1) AS v FROM c))
    SELECT query_id, min(v) AS low, max(v) AS high, arg_min(v, position * 100 + n) AS first, arg_max(v, position * 100 + n) AS last FROM f
    WHERE query_id IN (SELECT query_id FROM c GROUP BY query_id HAVING count(*) >= 2) GROUP BY query_id HAVING count(*) >= 2 AND max(v) - min(v) > 10"""
)
def yield_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    chunks = part.select(((F.col("p_size") % 20) * 100 + F.col("p_partkey") % 50).alias("query_id"), F.col("p_partkey").alias("position"), F.expr(NOTE).alias("text"))
    return extract.yield_contradictions(chunks)


PACK_SQL = """WITH RECURSIVE b AS (SELECT doc_id, n, t, greatest(len(regexp_extract_all(t, '\\S+')), CAST(floor(length(t) / 4) AS INT)) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos
  FROM (SELECT doc_id, unnest(range(len(ls))) AS n, trim(unnest(ls)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE t <> ''),
f AS (SELECT doc_id, pos, n, t, k, 0 AS c, k AS total FROM b WHERE pos = 1
  UNION ALL SELECT b.doc_id, b.pos, b.n, b.t, b.k, CASE WHEN f.total > 0 AND f.total + b.k > 300 THEN f.c + 1 ELSE f.c END, CASE WHEN f.total > 0 AND f.total + b.k > 300 THEN b.k ELSE f.total + b.k END
  FROM f JOIN b ON b.doc_id = f.doc_id AND b.pos = f.pos + 1)
SELECT doc_id, c AS chunk_index, sha256(string_agg(t, chr(10) || chr(10) ORDER BY n)) AS text_sha256, CAST(sum(k) AS BIGINT) AS tokens, CAST(min(n) AS INT) AS first, CAST(max(n) AS INT) AS last FROM f GROUP BY doc_id, c"""


@query(PACK_SQL)
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return chunking.pack_blocks(blocks, 300, "doc_id").withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


@query(
    f"""SELECT p_partkey, '[Document: ' || p_brand || '] [Page: ' || p_size || '] [Chemicals: ' || CASE p_partkey % 4
      WHEN 0 THEN regexp_extract({SENTENCE}, '\\d+-\\d+-\\d') || ', tetrahydrofuran, THF' WHEN 1 THEN 'palladium on carbon, toluene, H2SO' || p_size
      WHEN 2 THEN 'ABCDEFGHIJKLMN-ABCDEFGHIJ-K, -' || p_size || 'bar, 3.5hours, ABCDEFGHIJKLMN, ABCDEFGHIJ'
      ELSE 'InChI=1S/C2H' || p_size || '/c1-2, 5min, InChI, C2H' || p_size END || ']' || chr(10) || chr(10) || {SENTENCE} AS retrieval_text
    FROM part"""
)
def chunk_enrich(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    rows = part.select("p_partkey", chunking.enrich(F.expr(SENTENCE), F.col("p_brand"), F.col("p_size")).alias("e"))
    return rows.select("p_partkey", "e.retrieval_text")


@query(
    """WITH s AS (SELECT l_orderkey AS id, l_partkey % 100 AS a, l_partkey % 100 + l_linenumber * 3 AS b FROM lineitem), w AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT id, min(a) AS start, max(b) AS end FROM g GROUP BY id, g"""
)
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    (li,) = views(spark, sf, "lineitem")
    a = F.col("l_partkey") % 100
    return chunking.merge_intervals(li.select(F.col("l_orderkey").alias("id"), a.alias("start"), (a + F.col("l_linenumber") * 3).alias("end")))


@query()
def atomic_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Match offsets have no SQL form; tests compare with a plain loop."""
    (part,) = views(spark, sf, "part")
    return chunking.atomic_spans(part.select(F.col("p_partkey").alias("id"), F.expr(SENTENCE).alias("text")))


BOX = "l_orderkey AS page_id, l_linenumber AS block_id, (l_partkey % 700) - 40.0::DOUBLE AS x0, (l_suppkey * 13 % 900) - 30.0::DOUBLE AS y0, (l_partkey % 700) - 40.0::DOUBLE + l_quantity * 8 AS x1, (l_suppkey * 13 % 900) + l_quantity AS y1"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    (li,) = views(spark, sf, "lineitem")
    x0, y0 = (F.col("l_partkey") % 700).cast("double") - 40.0, (F.col("l_suppkey") * 13 % 900).cast("double") - 30.0
    return li.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("block_id"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity") * 8).alias("x1"), (y0 + 30.0 + F.col("l_quantity")).alias("y1"))


@query(
    f"""WITH b AS (SELECT {BOX} FROM lineitem), s AS (SELECT *, CASE WHEN x0 < 276 AND x1 > 336 THEN 'span' WHEN x1 <= 336 THEN 'left' ELSE 'right' END AS side FROM b),
    t AS (SELECT *, count(*) FILTER (side = 'left') OVER p >= 2 AND count(*) FILTER (side = 'right') OVER p >= 2 AS two, min(y0) FILTER (side <> 'span') OVER p AS top FROM s WINDOW p AS (PARTITION BY page_id))
    SELECT page_id, block_id, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN NOT two THEN 0 WHEN side = 'left' THEN 1 WHEN side = 'right' THEN 2 WHEN y0 < top THEN 0 ELSE 3 END, y0, x0, block_id) AS position FROM t"""
)
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.reading_order(_boxes(spark, sf)).select("page_id", "block_id", "position")


@query(
    f"""WITH b AS (SELECT {BOX} FROM lineitem) SELECT a.page_id, a.block_id AS a, c.block_id AS b, a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1 AS overlaps,
      a.x0 <= c.x0 AND a.y0 <= c.y0 AND a.x1 >= c.x1 AND a.y1 >= c.y1 AS contains FROM b a JOIN b c ON a.page_id = c.page_id AND a.block_id < c.block_id"""
)
def bbox_relations(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    box = F.struct("x0", "y0", "x1", "y1")
    a, b = (boxes.select("page_id", F.col("block_id").alias(n), box.alias(f"{n}_box")) for n in "ab")
    pairs = a.join(b, "page_id").where("a < b")
    return pairs.select("page_id", "a", "b", chunking.overlaps(F.col("a_box"), F.col("b_box")).alias("overlaps"), chunking.contains(F.col("a_box"), F.col("b_box")).alias("contains"))


@query(
    f"""WITH b AS (SELECT {BOX} FROM lineitem), t AS (SELECT page_id, block_id AS table_id, y0 FROM b WHERE block_id = 1)
    SELECT t.page_id, table_id, block_id, t.y0 - y1 AS distance FROM t JOIN b ON b.page_id = t.page_id AND b.block_id > 1 AND y1 <= t.y0 AND t.y0 - y1 <= 60
    QUALIFY row_number() OVER (PARTITION BY t.page_id, table_id ORDER BY t.y0 - y1, block_id) = 1"""
)
def nearest_caption(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    tables = boxes.where("block_id = 1").withColumnRenamed("block_id", "table_id")
    return chunking.nearest_caption(tables, boxes.where("block_id > 1"))


@query(
    f"""WITH b AS (SELECT {BOX} FROM lineitem), t AS (SELECT page_id, block_id AS table_id, y1, row_number() OVER () AS r FROM b WHERE block_id <= 2)
    SELECT t.page_id, table_id, string_agg(block_id, ',' ORDER BY y0, block_id) AS notes FROM t JOIN b ON b.page_id = t.page_id AND b.block_id > 2 AND y0 >= t.y1 AND y0 - t.y1 < 50 GROUP BY t.page_id, table_id, r"""
)
def table_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    tables = boxes.where("block_id <= 2").withColumnRenamed("block_id", "table_id")
    notes = chunking.footnotes(tables, boxes.where("block_id > 2"))
    return notes.withColumn("notes", F.array_join(F.col("notes").cast("array<string>"), ","))


@query(
    f"""WITH b AS (SELECT {BOX} FROM lineitem), c AS (SELECT page_id, block_id, (page_id % 4) * 90 AS rot, greatest(0, least(612, x0)) AS x0, greatest(0, least(792, y0)) AS y0, x1, y1 FROM b),
    d AS (SELECT page_id, block_id, rot, x0, y0, greatest(x0, least(612, x1)) AS x1, greatest(y0, least(792, y1)) AS y1 FROM c),
    r AS (SELECT page_id, block_id, CASE rot WHEN 90 THEN 792 - y1 WHEN 180 THEN 612 - x1 WHEN 270 THEN y0 ELSE x0 END AS a0, CASE rot WHEN 90 THEN x0 WHEN 180 THEN 792 - y1 WHEN 270 THEN 612 - x1 ELSE y0 END AS b0,
      CASE rot WHEN 90 THEN 792 - y0 WHEN 180 THEN 612 - x0 WHEN 270 THEN y1 ELSE x1 END AS a1, CASE rot WHEN 90 THEN x1 WHEN 180 THEN 792 - y0 WHEN 270 THEN 612 - x0 ELSE y1 END AS b1,
      CASE WHEN rot IN (90, 270) THEN 792::DOUBLE ELSE 612 END AS pw, CASE WHEN rot IN (90, 270) THEN 612::DOUBLE ELSE 792 END AS ph FROM d)
    SELECT page_id, block_id, round(a0 / pw * 100, 3) AS x_pct, round(b0 / ph * 100, 3) AS y_pct, round((a1 - a0) / pw * 100, 3) AS width_pct, round((b1 - b0) / ph * 100, 3) AS height_pct,
      round(a0 / pw * 1200, 2) AS x0, round(b0 / ph * 1650, 2) AS y0, round(a1 / pw * 1200, 2) AS x1, round(b1 / ph * 1650, 2) AS y1 FROM r"""
)
def viewport_map(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    v = citations.viewport({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, (F.col("page_id") % 4 * 90).cast("int"), 1.5)
    return boxes.select("page_id", "block_id", v.alias("v")).select("page_id", "block_id", "v.*")


@query(
    """SELECT l_orderkey AS query_id, l_linenumber, printf('CIT-%03d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber)) AS citation_id FROM lineitem"""
)
def citation_ids(spark: SparkSession, sf: str) -> DataFrame:
    (li,) = views(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("query_id"), "l_linenumber", F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber").alias("rank"))
    return citations.assign(rows).select("query_id", "l_linenumber", "citation_id")


ANSWER = "replace(text, chr(10), ' ') || CASE turn % 4 WHEN 0 THEN ' [CIT-001] The yield was 5 % here' WHEN 1 THEN ' [CIT-999, cit-002].' WHEN 2 THEN ' See doi 10.1234/ab.c of it.' ELSE '' END"
CITED = "SELECT conv_id * 1000 + turn AS id, 'CIT-00' || k AS citation_id, CASE WHEN k = 1 THEN text ELSE reverse(text) END AS text FROM conversations, (SELECT unnest([1, 2]) AS k)"
CLAIM_SQL = f"""WITH a AS (SELECT conv_id * 1000 + turn AS id, {ANSWER} AS text FROM conversations), cit AS ({CITED}),
  s AS (SELECT id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM a),
  c AS (SELECT id, CAST(unnest(range(len(ss))) AS INT) AS claim_no, trim(unnest(ss)) AS claim FROM s),
  t AS (SELECT *, list_transform(regexp_extract_all(claim, '(?i)(CIT-\\d+)', 1), lambda x: upper(x)) AS cited, regexp_matches(regexp_replace(claim, '[^\\x00-\\x7F]', '_', 'g'), '{citations.FACTUAL}') AS factual,
    list_filter({WORDS.format("regexp_replace(claim, '(?i)\\[CIT-\\d+\\]', '', 'g')")}, lambda w: w NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)})) AS cw FROM c WHERE true),
  m AS (SELECT t.id, t.claim_no, max(CASE WHEN cit.text IS NOT NULL THEN CASE WHEN len(cw) = 0 THEN 1 ELSE len(list_intersect(cw, {WORDS.format("cit.text")})) / len(cw) END END) AS best,
    string_agg(DISTINCT CASE WHEN cit.text IS NULL THEN u.tag END, ',' ORDER BY CASE WHEN cit.text IS NULL THEN u.tag END) AS invalid
    FROM t, LATERAL (SELECT DISTINCT unnest(t.cited) AS tag) u LEFT JOIN cit ON cit.id = t.id AND cit.citation_id = u.tag GROUP BY t.id, t.claim_no),
  k AS (SELECT t.id, t.claim_no, t.claim, coalesce(m.invalid, '') AS invalid, coalesce(m.best, 0) AS best, len(cited) = 0 AS uncited FROM t LEFT JOIN m USING (id, claim_no) WHERE len(cited) > 0 OR factual)"""


def _checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    (turns,) = views(spark, sf, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    answers = turns.select(key, F.expr(ANSWER).alias("text"))
    known = turns.select(key, F.explode(F.array(F.struct(F.lit("CIT-001").alias("citation_id"), F.col("text").alias("text")), F.struct(F.lit("CIT-002").alias("citation_id"), F.reverse("text").alias("text")))).alias("c")).select("id", "c.*")
    return answers, citations.check_claims(answers, known)


@query(CLAIM_SQL + " SELECT id, claim_no, claim, invalid, round(best, 4) AS score, best >= 0.3::DOUBLE AS supported, uncited FROM k")
def claim_validate(spark: SparkSession, sf: str) -> DataFrame:
    _, checked = _checked(spark, sf)
    return checked.drop("cited").withColumn("invalid", F.array_join("invalid", ","))


@query(
    CLAIM_SQL + f""", p AS (SELECT id, count(*) AS n_claims, count(*) FILTER (best >= 0.3::DOUBLE AND NOT uncited) AS n_supported, count(*) FILTER (best < 0.3::DOUBLE AND NOT uncited) AS n_unsupported, count(*) FILTER (uncited) AS n_uncited,
      len(list_distinct(list_filter(string_split(coalesce(string_agg(invalid, ','), ''), ','), lambda x: x <> ''))) AS tags FROM k GROUP BY id),
    z AS (SELECT a.id, coalesce(n_claims, 0) AS n_claims, coalesce(n_supported, 0) AS n_supported, coalesce(n_unsupported, 0) AS n_unsupported, coalesce(n_uncited, 0) AS n_uncited,
      coalesce(tags, 0) + len(list_distinct(regexp_extract_all(a.text, '{citations.DOI}', 1))) AS n_invalid FROM a LEFT JOIN p USING (id))
    SELECT *, n_invalid = 0 AND n_unsupported = 0 AND n_uncited = 0 AS valid, n_invalid > 0 OR (n_unsupported > 0 AND n_supported = 0) OR n_uncited > 2 AS regenerate FROM z"""
)
def claim_totals(spark: SparkSession, sf: str) -> DataFrame:
    answers, checked = _checked(spark, sf)
    return citations.totals(checked, answers)


@query(
    """SELECT doc_id, upper(regexp_replace('[cit-' || doc_id || '] ', '^[\\[\\] ]+|[\\[\\] ]+$', '', 'g')) AS resolved, '/api/v1/documents/' || doc_id || '/file' AS url,
      '### Evidence [CIT-001] ' || source || ' | Section: ' || lang || ' | Page: ' || n_chars || chr(10) || left(text, 50) || chr(10) AS block FROM documents"""
)
def evidence_blocks(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    tag = F.concat(F.lit("[cit-"), F.col("doc_id").cast("string"), F.lit("] "))
    block = citations.evidence_block(F.lit("CIT-001"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lit(None).cast("string"), F.substring("text", 1, 50))
    return docs.select("doc_id", citations.resolve_id(tag).alias("resolved"), citations.evidence_url(F.col("doc_id")).alias("url"), block.alias("block"))
