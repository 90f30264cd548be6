"""DuckDB SQL for the operators that SQL can express."""

OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS g0, coalesce(source, '') AS g1, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), ls AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, g0, g1, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(ls.n_lines, 0) AS n_lines, coalesce(ls.n_dup_lines, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
  FROM d LEFT JOIN ls USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    greatest(n_words, 1) AS nw, greatest(n_lines, 1) AS nl FROM m
), r AS (
  SELECT doc_id, g0, g1, base_failed, unnest([
    {'metric': 'symbol_rate', 'v': n_symbols * 1000000 // nw, 'nt': n_symbols, 'nb': nw},
    {'metric': 'dup_line_rate', 'v': n_dup_lines * 1000000 // nl, 'nt': n_dup_lines, 'nb': nl},
    {'metric': 'repeat_rate', 'v': n_repeat_words * 1000000 // nw, 'nt': n_repeat_words, 'nb': nw},
    {'metric': 'stutter_rate', 'v': n_stutter * 1000000 // nw, 'nt': n_stutter, 'nb': nw},
    {'metric': 'word_length', 'v': word_chars * 1000000 // nw, 'nt': word_chars, 'nb': nw}], recursive := true) FROM b
), u AS (
  SELECT g0, g1, metric, v FROM r WHERE NOT base_failed UNION ALL SELECT g0, g1, 'n_words', n_words FROM b WHERE NOT base_failed UNION ALL SELECT g0, g1, 'n_lines', n_lines FROM b WHERE NOT base_failed
), s AS (
  SELECT g0, g1, metric, (v >> greatest(length(ltrim(bin(v), '0')) - 5, 0)) << greatest(length(ltrim(bin(v), '0')) - 5, 0) AS bucket, count(*) AS n FROM u GROUP BY ALL
), q0 AS (
  SELECT metric, max(total) AS n, min(bucket) FILTER (up * 2 >= total) AS middle,
    min(bucket) FILTER (up * 100 >= total * CASE WHEN metric IN ('dup_line_rate', 'repeat_rate') THEN 99 ELSE 90 END) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY metric) AS total
        FROM (SELECT metric, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL
), o0 AS (
  SELECT x.*, x.middle + (1 << greatest(length(ltrim(bin(x.middle), '0')) - 5, 0)) - 1 AS m,
    greatest(2 * (x.high + (1 << greatest(length(ltrim(bin(x.high), '0')) - 5, 0)) - 1 - x.middle), 1000000 // greatest(a.middle, 1), 1) AS s
  FROM q0 x JOIN q0 a ON a.metric = CASE WHEN x.metric = 'dup_line_rate' THEN 'n_lines' ELSE 'n_words' END WHERE x.metric NOT IN ('n_words', 'n_lines')
), q1 AS (
  SELECT g0, metric, max(total) AS n, min(bucket) FILTER (up * 2 >= total) AS middle,
    min(bucket) FILTER (up * 100 >= total * CASE WHEN metric IN ('dup_line_rate', 'repeat_rate') THEN 99 ELSE 90 END) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY g0, metric ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY g0, metric) AS total
        FROM (SELECT g0, metric, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL
), o1 AS (
  SELECT x.*, x.middle + (1 << greatest(length(ltrim(bin(x.middle), '0')) - 5, 0)) - 1 AS m,
    greatest(2 * (x.high + (1 << greatest(length(ltrim(bin(x.high), '0')) - 5, 0)) - 1 - x.middle), 1000000 // greatest(a.middle, 1), 1) AS s
  FROM q1 x JOIN q1 a ON a.g0 = x.g0 AND a.metric = CASE WHEN x.metric = 'dup_line_rate' THEN 'n_lines' ELSE 'n_words' END WHERE x.metric NOT IN ('n_words', 'n_lines')
), f1 AS (
  SELECT y.g0, y.metric, floor((y.n::DOUBLE * y.m + 20.0::DOUBLE * w.m) / (y.n::DOUBLE + 20)) AS m, CAST(round(exp((y.n::DOUBLE * ln(y.s) + 200.0::DOUBLE * ln(w.s)) / (y.n::DOUBLE + 200))) AS BIGINT) AS s
  FROM o1 y JOIN o0 w ON w.metric = y.metric
), q2 AS (
  SELECT g0, g1, metric, max(total) AS n, min(bucket) FILTER (up * 2 >= total) AS middle,
    min(bucket) FILTER (up * 100 >= total * CASE WHEN metric IN ('dup_line_rate', 'repeat_rate') THEN 99 ELSE 90 END) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY g0, g1, metric ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY g0, g1, metric) AS total
        FROM (SELECT g0, g1, metric, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL
), o2 AS (
  SELECT x.*, x.middle + (1 << greatest(length(ltrim(bin(x.middle), '0')) - 5, 0)) - 1 AS m,
    greatest(2 * (x.high + (1 << greatest(length(ltrim(bin(x.high), '0')) - 5, 0)) - 1 - x.middle), 1000000 // greatest(a.middle, 1), 1) AS s
  FROM q2 x JOIN q2 a ON a.g0 = x.g0 AND a.g1 = x.g1 AND a.metric = CASE WHEN x.metric = 'dup_line_rate' THEN 'n_lines' ELSE 'n_words' END WHERE x.metric NOT IN ('n_words', 'n_lines')
), f2 AS (
  SELECT y.g0, y.g1, y.metric, floor((y.n::DOUBLE * y.m + 20.0::DOUBLE * w.m) / (y.n::DOUBLE + 20)) AS m, CAST(round(exp((y.n::DOUBLE * ln(y.s) + 200.0::DOUBLE * ln(w.s)) / (y.n::DOUBLE + 200))) AS BIGINT) AS s
  FROM o2 y JOIN f1 w ON w.g0 = y.g0 AND w.metric = y.metric
), f AS (
  SELECT g0, g1, metric, CAST(m + s AS BIGINT) AS fence FROM f2
), e AS (
  SELECT doc_id, CAST(fence * nb AS DOUBLE) AS expected, CAST(nt AS DOUBLE) * 1000000 - CAST(fence * nb AS DOUBLE) AS beyond
  FROM r JOIN f USING (g0, g1, metric)
), bad AS (
  SELECT DISTINCT doc_id FROM e WHERE beyond > 0 AND beyond * beyond > 9 * 1000000.0::DOUBLE * greatest(expected, 1000000.0::DOUBLE)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM b
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS line, s, hash(text) AS rev
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), c AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l
), t AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM c
), f AS (
  SELECT a.doc_id, a.i AS b, min(z.i) AS e, true AS forth FROM t a JOIN t z
    ON a.doc_id = z.doc_id AND z.i >= a.i AND z.c >= a.c - a.w + 50 GROUP BY ALL
  UNION ALL
  SELECT z.doc_id, max(a.i) AS b, z.i AS e, false AS forth FROM t a JOIN t z
    ON a.doc_id = z.doc_id AND z.i >= a.i AND z.c >= a.c - a.w + 50 GROUP BY ALL
), x AS (
  SELECT f.doc_id, b, e, forth, array_to_string(s[b + 1:e + 1], chr(10)) AS block
  FROM f JOIN l ON f.doc_id = l.doc_id AND l.i = f.b
), r AS (
  SELECT doc_id, b, e, row_number() OVER (PARTITION BY forth, block ORDER BY doc_id, b) AS nth FROM x
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN b AND e WHERE nth > 1
), runs AS (
  SELECT doc_id, min(i) AS first, max(i) AS last, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone) GROUP BY doc_id, run
), told AS (
  SELECT doc_id, sum(n) AS n, string_agg(first || '-' || last, ',' ORDER BY first) AS dropped FROM runs GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
  CAST(coalesce(told.n, 0) AS BIGINT) AS n_dropped, coalesce(told.dropped, '') AS dropped,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x
), p AS (
  SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score, q.r AS own, e.r FROM v q JOIN v e ON q.r <> e.r AND len(q.v) = len(e.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def _climb_sql(nodes: str, name: str, levels: int) -> str:
    """Tables of runs and digests level by level over nodes (tree, n, pos, digest), and ``name`` (tree, digest) of the roots."""
    out = f"{name}_l0 AS (SELECT tree, n, pos, digest FROM {nodes}),"
    for k in range(levels):
        out += f"""
  {name}_r{k} AS (SELECT tree, n, pos // 16 AS pos, list(digest ORDER BY {name}_l{k}.pos) AS run FROM {name}_l{k} WHERE n > {16**k} GROUP BY tree, n, {name}_l{k}.pos // 16),
  {name}_l{k + 1} AS (SELECT tree, n, pos, sha256(array_to_string(run, '')) AS digest FROM {name}_r{k}),"""
    ended = (f"SELECT tree, digest FROM {name}_l{k} WHERE n <= {16**k}" + (f" AND n > {16 ** (k - 1)}" if k else "") for k in range(levels + 1))
    return out + f" {name} AS ({' UNION ALL '.join(ended)})"


def _path_sql(nodes: str, name: str, levels: int, start: str) -> str:
    """``name``_path: nodes with p, their siblings from below, and f, ``start`` folded with them."""
    out = f"{name}_p0 AS (SELECT *, '' AS p, {start} AS f FROM {nodes})"
    for k in range(levels):
        i = f"(x.pos // {16**k}) % 16"
        before, after = f"array_to_string(run[1:{i}], '')", f"array_to_string(run[{i} + 2:], '')"
        out += f""",
  {name}_p{k + 1} AS (SELECT x.* EXCLUDE (p, f), CASE WHEN run IS NULL THEN p ELSE p || {before} || {after} END AS p,
    CASE WHEN run IS NULL THEN f ELSE sha256({before} || f || {after}) END AS f
    FROM {name}_p{k} x LEFT JOIN {name}_r{k} r ON r.tree = x.tree AND r.pos = x.pos // {16 ** (k + 1)})"""
    return out


def op13_sql(levels: int = 6, source_levels: int = 4) -> str:
    """Trees of up to 16 ** levels rows a source and 16 ** source_levels sources."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = f"xor(list_reduce([4294967295] || {bits}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {leaf("text")} AS digest, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS tampered FROM documents
), x AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_climb_sql("x", "sub", levels)}, {_path_sql("x", "sub", levels, "coalesce(tampered, digest)")},
y AS (SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM sub),
{_climb_sql("y", "top", source_levels)},
z AS (SELECT y.*, a.doc_id, a.digest AS leaf, a.p AS below, a.f AS under FROM y JOIN sub_p{levels} a ON a.tree = y.of),
{_path_sql("z", "top", source_levels, "under")}
SELECT doc_id, leaf, q.digest AS subroot, top.digest AS root, sha256(below || p) AS proof_sha256, f AS folded_root, f = top.digest AS verified FROM top_p{source_levels} q, top
"""
