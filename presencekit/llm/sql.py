"""SQL of the driver queries that DuckDB can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'text ' || coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM sized GROUP BY source),
-- in order of the level at which a source is capped, the first level that the next source does not reach is the level
ord AS (SELECT *, sum(w) OVER ()::BIGINT AS ws, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cw,
  coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cc FROM src),
lev AS (SELECT (3 * total - 2 * cc) AS up, 2 * (ws - cw) AS down FROM ord WHERE w::HUGEINT * (3 * total - 2 * cc) <= 2 * source_size::HUGEINT * 2 * (ws - cw) ORDER BY 2.0 * source_size / w, source NULLS LAST LIMIT 1),
tgt AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w::DOUBLE * (SELECT up FROM lev)::DOUBLE / (SELECT down FROM lev)::DOUBLE) AS target FROM src)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (floor(target / source_size) + (u < target / source_size - floor(target / source_size))::INT))::BIGINT AS taken
FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5"""

MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) c ON c.id = d.doc_id"""


def rules(boilerplate: tuple[str, ...], max_lost: float) -> str:
    marks = lambda c, some: f"(length({c}) - length(translate({c}, '{some}', '')))"
    fails = f"""(CASE WHEN regexp_matches(l, '[#*$%&|<>!]') THEN {marks("l", "|")} * 40 > length(l) OR {marks("l", "#*$%&|<>")} * 24 > length(l) OR (length(l) >= 15 AND {marks("l", "!")} * 18 > length(l)) ELSE false END
  OR (length(l) >= 200 AND NOT regexp_matches(l, '[.!?;:,]')) OR (length(l) <= 160 AND regexp_matches(lower(l), '{"|".join(boilerplate).replace("'", "''")}')))"""
    chars = lambda c: rf"length(regexp_replace({c}, '[\x20\x09-\x0D]', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM pos) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 5)) AS j) GROUP BY 1),
ln AS (SELECT doc_id, l, row_number() OVER () AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)),
per AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup, coalesce(sum({chars("l")}) FILTER (WHERE {fails}), 0) AS lost FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, {chars("text")}::BIGINT AS word_chars, {marks("text", "#*$%&|<>")}::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {max_lost} * word_chars AS kept FROM f"""
