"""Table access, filters, joins and aggregates of the serving side, over the star schema and the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.operators import relational as R
from orefield.operators import retrieval
from orefield.plans.registry import query, views


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def get_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return R.get(views(spark, sf, "orders")[0], "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def list_page(spark: SparkSession, sf: str) -> DataFrame:
    return R.page(views(spark, sf, "orders")[0], "o_orderkey", 100, 50, {"o_orderstatus": "F", "unknown": 1}).select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return R.count(views(spark, sf, "orders")[0], {"o_orderstatus": "O"})


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "events")
    rows = e.select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "value", "event_id")
    old, new = rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0")
    return R.upsert(old, new, ["user_id", "event_type"], "at").select("user_id", "event_type", "value", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0")
def insert_update_delete(spark: SparkSession, sf: str) -> DataFrame:
    (o,) = views(spark, sf, "orders")
    rows = o.select("o_orderkey", "o_totalprice")
    left = R.delete(rows, rows.where("o_orderkey % 5 = 0"), ["o_orderkey"])
    return left.unionByName(rows.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))


@query(
    """SELECT c.c_custkey AS id, coalesce(o.n, 0) AS n_orders, coalesce(s.n, 0) AS n_suppliers FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT s_suppkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_suppkey = c.c_custkey"""
)
def doc_listing_counts(spark: SparkSession, sf: str) -> DataFrame:
    c, o, s = views(spark, sf, "customer", "orders", "supplier")
    return R.with_child_counts(c.select(F.col("c_custkey").alias("id")), "id", {"n_orders": (o, "o_custkey"), "n_suppliers": (s, "s_suppkey")})


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(views(spark, sf, "orders")[0], ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT n_nationkey, n_name, coalesce((SELECT string_agg(s_suppkey, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation")
def nested_children(spark: SparkSession, sf: str) -> DataFrame:
    n, s = views(spark, sf, "nation", "supplier")
    out = R.with_children(n.select("n_nationkey", "n_name"), s.select("s_suppkey", "s_nationkey"), "n_nationkey", "s_nationkey", "suppliers")
    return out.withColumn("suppliers", F.array_join(F.transform("suppliers", lambda x: x["s_suppkey"].cast("string")), ","))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS sha FROM conversations WHERE coalesce(text, '') <> '' GROUP BY conv_id")
def page_text_join(spark: SparkSession, sf: str) -> DataFrame:
    return R.join_pages(views(spark, sf, "conversations")[0], "conv_id", "turn", "text").select("conv_id", F.sha2("text", 256).alias("sha"))


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderpriority = '1-URGENT'
      AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01'"""
)
def tenant_date_filters(spark: SparkSession, sf: str) -> DataFrame:
    o, c = views(spark, sf, "orders", "customer")
    names = {"tenant": "o_orderpriority", "document": "o_custkey", "type": "o_orderstatus", "date": "o_orderdate"}
    mine = c.where("c_nationkey = 3").select("c_custkey")
    dates = F.lit("1994-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp")
    return retrieval.filter_chunks(o, "1-URGENT", mine, [], ["F", "O"], *dates, columns=names).select("o_orderkey")


@query("SELECT doc_id, source FROM documents WHERE n_chars % 4 <> 0 AND doc_id % 10 <> 0 AND source IN ('src1', 'src2') AND lang = 'en'")
def visibility_filters(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = views(spark, sf, "documents")
    rows = d.withColumns({"is_current": F.col("n_chars") % 4 != 0, "deleted_at": F.when(F.col("doc_id") % 10 == 0, F.lit("x")), "english": F.col("lang") == "en"})
    names = {"section": "source", "entities": "english"}
    return retrieval.filter_chunks(retrieval.visible(rows), sections=["src1", "src2"], has_entities=True, columns=names).select("doc_id", "source")


@query("SELECT p_partkey, contains(lower(p_name), 'red') AS part, lower(p_type) = lower('SMALL') AS same FROM part WHERE contains(lower(p_name), 'red') OR lower(p_type) = 'small'")
def text_predicates(spark: SparkSession, sf: str) -> DataFrame:
    (p,) = views(spark, sf, "part")
    part, same = retrieval.contains_text(F.col("p_name"), "RED"), retrieval.equals_text(F.col("p_type"), F.lit("small"))
    return p.select("p_partkey", part.alias("part"), same.alias("same")).where("part or same")


@query("SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 6') AND contains(lower(event_type), 'vi')")
def json_text_filter(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "events")
    return e.where(retrieval.contains_text(F.col("props"), '"K": 6') & retrieval.contains_text(F.col("event_type"), "VI")).select("event_id")


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), 'Scientific Paper') AS title FROM documents")
def title_fallback(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = views(spark, sf, "documents")
    blank = lambda n, c: F.when(F.col("doc_id") % n == 0, F.lit("")).otherwise(F.col(c))
    return d.select("doc_id", R.chunk_title(blank(3, "lang"), blank(2, "source")).alias("title"))


@query(
    """SELECT e.vec_id, d.source, length(d.text) AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1"""
)
def embedding_chunk_join(spark: SparkSession, sf: str) -> DataFrame:
    e, d, lab = views(spark, sf, "embeddings", "documents", "labels")
    rows = e.select(F.col("vec_id").alias("doc_id")).join(d, "doc_id").join(lab.where("quality = 1"), "doc_id")
    return rows.select(F.col("doc_id").alias("vec_id"), "source", F.length("text").cast("long").alias("n"))


@query(
    """SELECT DISTINCT l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE (p_brand = 'Brand#3' OR p_type = 'ECONOMY') AND o_orderstatus = 'F'"""
)
def bridge_join(spark: SparkSession, sf: str) -> DataFrame:
    li, p, o = views(spark, sf, "lineitem", "part", "orders")
    wanted = p.where((F.col("p_brand") == "Brand#3") | (F.col("p_type") == "ECONOMY")).select("p_partkey")
    links = li.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(wanted, "p_partkey")
    return links.join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("l_orderkey", "p_partkey").distinct()


UPLOAD = """doc_id AS upload_id, source AS org, CASE WHEN doc_id % 11 = 0 THEN 'a.txt' ELSE 'a b.PDF' END AS filename, CASE WHEN doc_id % 13 = 0 THEN 'text/html' WHEN doc_id % 7 = 0 THEN '' ELSE 'application/pdf' END AS content_type,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN text ELSE '%PDF-' || left(text, 5) END AS body"""


@query(
    f"""WITH u AS (SELECT {UPLOAD} FROM documents), w AS (SELECT upload_id, org, sha256(body) AS sha, CASE WHEN NOT ends_with(lower(filename), '.pdf') THEN 'extension' WHEN octet_length(encode(body)) > 60000 THEN 'too_large' WHEN body = '' THEN 'empty'
      WHEN NOT starts_with(body, '%PDF-') THEN 'magic' WHEN content_type NOT IN ('', 'application/pdf') THEN 'content_type' END AS wrong FROM u),
    k AS (SELECT org, sha, min(upload_id) AS document_id FROM w WHERE upload_id % 23 = 0 GROUP BY 1, 2), f AS (SELECT org, sha, min(upload_id) AS first_upload FROM w WHERE wrong IS NULL GROUP BY 1, 2),
    s AS (SELECT w.*, document_id, coalesce(wrong, CASE WHEN document_id IS NOT NULL OR first_upload < upload_id THEN 'duplicate' END, 'accepted') AS status FROM w LEFT JOIN k USING (org, sha) LEFT JOIN f USING (org, sha))
    SELECT upload_id, sha, status, coalesce(CASE WHEN status = 'duplicate' THEN document_id END, -1) AS duplicate_of FROM s"""
)
def upload_dedup(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = views(spark, sf, "documents")
    u = d.selectExpr("doc_id", "source", "text").selectExpr(*_aliased(UPLOAD)).withColumn("content", F.col("body").cast("binary"))
    known = u.where("upload_id % 23 = 0").select("org", F.sha2("content", 256).alias("sha"), F.col("upload_id").alias("document_id"))
    return R.check_uploads(u, known, 60000).withColumn("duplicate_of", F.coalesce("duplicate_of", F.lit(-1)))


def _aliased(text: str) -> list[str]:
    from orefield.plans.search import _split

    return [x.strip() for x in _split(text)]


@query(
    """WITH n AS (SELECT doc_id, source, text, regexp_extract(CASE doc_id % 3 WHEN 0 THEN '../x/my file.pdf' WHEN 1 THEN 'dir/' ELSE lang || 'é:1.pdf' END, '([^/]*)$', 1) AS b FROM documents)
    SELECT doc_id, concat_ws('/', source, left(sha256(text), 2), sha256(text) || '_' || CASE WHEN b = '' THEN 'unnamed_file' ELSE regexp_replace(b, '[^\\p{L}\\p{N}_.\\-]', '_', 'g') END) AS key FROM n"""
)
def storage_keys(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = views(spark, sf, "documents")
    name = F.expr("CASE doc_id % 3 WHEN 0 THEN '../x/my file.pdf' WHEN 1 THEN 'dir/' ELSE lang || 'é:1.pdf' END")
    return d.select("doc_id", R.storage_key(F.col("source"), F.col("text"), name).alias("key"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN 1.0::DOUBLE WHEN turn % 5 > 0 THEN least(1.0::DOUBLE, 0.6::DOUBLE + 0.08::DOUBLE * (turn % 5)) WHEN conv_id % 2 > 0 THEN 0.85::DOUBLE ELSE 0.5 END AS confidence,
      CASE WHEN turn % 3 > 0 THEN (turn % 3)::DOUBLE WHEN conv_id % 2 > 0 THEN 0.95::DOUBLE ELSE 0.8 END AS chat FROM conversations"""
)
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    (t,) = views(spark, sf, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    chat = R.chat_confidence((turn % 3).cast("double"), conv % 2)
    return t.select("conv_id", "turn", R.confidence(turn % 7 == 0, turn % 5, conv % 2).alias("confidence"), chat.alias("chat"))


@query(
    """SELECT doc_id, 'Found' || chr(10) || '- ' || lang || chr(10) || '### Citations' || chr(10) || '- [CIT-001] ' || source || chr(10) || '- [CIT-002] Scientific Literature Reference' AS answer, 'CIT-001:1,CIT-002:' || greatest(n_chars % 4, 1) AS cits,
      'Evidence:' || chr(10) || '[1] ' || source || chr(10) || chr(10) || 'Question: ' || lang AS prompt FROM documents"""
)
def answer_assembly(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = views(spark, sf, "documents")
    raw = F.array(
        F.struct(F.col("source").alias("title"), F.lit(0).alias("page"), F.lit(0.5).alias("score")), F.struct(F.lit("").alias("title"), (F.col("n_chars") % 4).cast("int").alias("page"), F.lit(None).cast("double").alias("score"))
    )
    rows = d.withColumn("cits", R.chat_citations(raw))
    shown = F.array_join(F.transform("cits", lambda c: F.concat(c["citation_id"], F.lit(":"), c["page"].cast("string"))), ",")
    return rows.select("doc_id", R.answer_markdown(F.lit("Found"), F.array("lang"), F.col("cits")).alias("answer"), shown.alias("cits"), R.prompt(F.col("lang"), F.array("source")).alias("prompt"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'Event Type: ' || event_type || ', K: ' || json_extract_string(props, '$.k') AS line FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "events")
    props = F.from_json("props", "k bigint")
    m = F.create_map(F.lit("k"), props["k"].cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("cid"), F.lit("x"))
    return e.select("event_id", props["k"].alias("k"), R.map_lines(m).alias("line"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1900 + doc_id % 100 END AS year FROM documents")
def inverted_abstract(spark: SparkSession, sf: str) -> DataFrame:
    (d,) = views(spark, sf, "documents")
    index = R.inverted_index(d.select("doc_id", T.squeeze(F.col("text")).alias("text")))
    date = F.when(F.col("doc_id") % 3 == 0, F.lit("n.d.")).otherwise(F.concat((F.col("doc_id") % 100 + 1900).cast("string"), F.lit("-01-02")))
    return index.select("doc_id", R.inverted_abstract(F.col("index")).alias("abstract"), F.coalesce(R.year_of(date), F.lit(0)).cast("long").alias("year"))


@query("SELECT p_partkey % 40 AS provider_order, p_partkey, p_name AS title FROM part QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) = 1")
def title_dedup(spark: SparkSession, sf: str) -> DataFrame:
    (p,) = views(spark, sf, "part")
    rows = p.select((F.col("p_partkey") % 40).alias("provider_order"), "p_partkey", F.col("p_name").alias("title"))
    return R.first_by_title(rows, "p_partkey")


@query(
    """SELECT c_custkey AS doi, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'a' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'b' || c_custkey END, CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey END) AS title FROM customer"""
)
def doi_federation(spark: SparkSession, sf: str) -> DataFrame:
    (c,) = views(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").alias("doi"))
    source = lambda n, letter: keys.where(F.col("doi") % n == 0).select("doi", F.concat(F.lit(letter), F.col("doi").cast("string")).alias("title"))
    return R.first_hit(keys, [source(3, "a"), source(2, "b"), source(5, "c")], "doi", "title")
