"""The SQL that the queries of ``engine_queries`` are checked against."""

from __future__ import annotations


def _code(c: str) -> str:
    humps = rf"regexp_replace({c}, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1 \2', 'g')"
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({humps}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _plain(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_LIVE = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, deleted_at ASC NULLS FIRST, body, kind ASC NULLS FIRST, end_line) AS n FROM chunks) WHERE n = 1 AND deleted_at IS NULL)"""
_ASKED = "asked AS (SELECT DISTINCT query_id, query FROM hits)"
_LABELS = """labels AS (SELECT DISTINCT s.symbol_id AS query_id, s.name AS query, l.file_path AS file, s.line AS target_line FROM symbols s JOIN live l ON l.id = s.chunk_id WHERE s.symbol_id % 20 = 0 AND s.name IS NOT NULL)"""
_LABEL_ASKED = "asked AS (SELECT DISTINCT query_id, query FROM labels)"

_BM25 = f"""toks AS (SELECT id, {_code("body")} AS w FROM live),
st AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM toks),
p AS (SELECT id, t AS term, dl, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS t FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT query_id, unnest({_code("query")}) AS t FROM asked) GROUP BY ALL),
bs AS (SELECT query_id, id AS chunk_id, round(-sum(qtf * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN df USING (term) JOIN p USING (term), st GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM bs) WHERE rank <= 10)"""


def _vector(source: str, key: str, text: str) -> str:
    return f"""(SELECT {key}, b, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM (SELECT {key}, b, CAST(sum(s) AS DOUBLE) AS v FROM
  (SELECT {key}, CAST(('0x' || md5(t)[1:8]) AS UBIGINT) % 384 AS b, CASE WHEN CAST(('0x' || md5(t)[9:10]) AS UBIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM (SELECT {key}, unnest({_plain(text)}) AS t FROM {source}))
  GROUP BY ALL) WHERE v <> 0)"""


_VECTOR = f"""cv AS {_vector("live", "id", "body")}, qv AS {_vector("asked", "query_id", "query")},
cn AS (SELECT l.id, CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS n FROM live l LEFT JOIN (SELECT DISTINCT id FROM cv) c USING (id)),
qn AS (SELECT a.query_id, CASE WHEN c.query_id IS NULL THEN 0 ELSE 1 END AS n FROM asked a LEFT JOIN (SELECT DISTINCT query_id FROM qv) c USING (query_id)),
dots AS (SELECT query_id, id, sum(cv.v * qv.v) AS dot FROM cv JOIN qv USING (b) GROUP BY ALL),
vs AS (SELECT qn.query_id, cn.id AS chunk_id, round(sqrt(greatest(0, cn.n + qn.n - 2 * coalesce(dot, 0))), 6) AS distance FROM qn CROSS JOIN cn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = cn.id),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM vs) WHERE rank <= 10)"""


def _fused(a: str = "1.0", b: str = "1.0", weights: str = "") -> str:
    return f"""both_lists AS (SELECT query_id, chunk_id, rank, {a} AS w, rank AS br FROM lex {weights} UNION ALL SELECT query_id, chunk_id, rank, {b}, NULL FROM vec {weights}),
fu AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 12) AS score, min(br) AS bm25_rank FROM both_lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank ASC NULLS LAST, chunk_id) AS rank FROM fu)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_IDENT = r"regexp_matches(w[1], '_|[0-9]|\p{Ll}\p{Lu}')"
_ADAPTIVE = rf"""aw AS (SELECT query_id, query, CASE WHEN len(w) = 1 AND {_IDENT} THEN 2.0 ELSE 1.0 END AS w_lexical, CASE WHEN len(w) >= 2 THEN 2.0 ELSE 1.0 END AS w_vector
  FROM (SELECT query_id, query, list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '') AS w FROM aq))"""
_HITS = "h AS (SELECT DISTINCT hit_id, query_id, rank, file, start_line, end_line, snippet, signature FROM hits)"
_DOT = "list_sum(list_transform(list_zip(a, b), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_KNN = """e AS (SELECT vec_id, embedding AS v FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))), 6) AS distance FROM e q CROSS JOIN e WHERE q.vec_id % 20 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM ds) WHERE rank <= 10)"""
_STATE = """{name} AS (SELECT repo_id, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY indexed_at DESC, content_hash, mtime, deleted_at ASC NULLS FIRST) AS n FROM file_states {where}) WHERE n = 1 AND NOT ({dead}))"""
_NOW = _STATE.format(name="now", where="", dead="deleted_at IS NOT NULL")
_OLD = _STATE.format(name="old", where="WHERE indexed_at < TIMESTAMP '2025-10-01'", dead="deleted_at IS NOT NULL AND deleted_at < TIMESTAMP '2025-10-01'")
_EVAL = """places AS (SELECT id AS chunk_id, file_path AS file, start_line, end_line FROM live),
arms AS (SELECT 'lexical' AS arm, query_id, chunk_id, rank FROM lex UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM vec UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fused WHERE rank <= 10),
fr AS (SELECT arm, l.query_id, l.file, l.target_line, min(a.rank) AS rank FROM labels l JOIN arms a USING (query_id) JOIN places p ON p.chunk_id = a.chunk_id AND p.file = l.file AND l.target_line BETWEEN p.start_line AND p.end_line GROUP BY ALL),
fa AS (SELECT a.arm, l.query_id, l.query, fr.rank FROM labels l CROSS JOIN (VALUES ('lexical'), ('vector'), ('hybrid')) a(arm) LEFT JOIN fr ON fr.arm = a.arm AND fr.query_id = l.query_id AND fr.file = l.file AND fr.target_line = l.target_line)"""

_ARMS = (_BM25, _VECTOR, _fused())
_BOOSTED = (
    f"qt AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest({_code('query')}) AS t FROM asked))",
    f"imp AS (SELECT DISTINCT file_path, t FROM (SELECT file_path, unnest({_code('source')}) AS t FROM file_imports WHERE file_path IS NOT NULL))",
    "lifted AS (SELECT DISTINCT query_id, file_path FROM qt JOIN imp USING (t))",
    "bo AS (SELECT f.query_id, f.chunk_id, round(f.score + CASE WHEN x.query_id IS NULL THEN 0 ELSE 0.01 END, 12) AS score FROM fused f JOIN live l ON l.id = f.chunk_id LEFT JOIN lifted x ON x.query_id = f.query_id AND x.file_path = l.file_path)",
)

_HYDRATED = (
    "sy AS (SELECT chunk_id, arg_min(signature, {'l': line, 's': coalesce(signature, '')}) AS signature FROM symbols WHERE chunk_id IS NOT NULL AND signature IS NOT NULL GROUP BY chunk_id)",
    "im AS (SELECT file_path, count(*) AS imports FROM (SELECT DISTINCT file_path, ord, source, kind, line FROM file_imports WHERE file_path IS NOT NULL) GROUP BY file_path)",
)
_DOC_CHUNKS = r"""dl AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS w FROM documents WHERE text <> ''),
dw AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 15) + 1, 45)) AS a FROM dl),
live AS (SELECT doc_id || '.txt:' || a || '-' || least(len(w), a + 59) AS id, CAST(a AS INTEGER) AS start_line, CAST(least(len(w), a + 59) AS INTEGER) AS end_line, array_to_string(w[a:a + 59], chr(10)) AS body FROM dw)"""
_LINES = r"""f AS (SELECT DISTINCT rel_path, language, replace(content, chr(13) || chr(10), chr(10)) AS content FROM source_files WHERE content IS NOT NULL),
l AS (SELECT rel_path, language, unnest(string_split(content, chr(10))) AS s, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM f)"""
#: Import statements of one line: the language, and the pattern whose first group is the source.
_IMPORT_LINES = {
    "java": r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;",
    "ruby": r"^[ \t]*require(?:_relative)?[ \t(]*[\x27\x22]([^\x27\x22\n]+)[\x27\x22]",
    "c": r"^[ \t]*#[ \t]*include[ \t]*(<[^>\n]*>|\x22[^\x22\n]*\x22)",
    "cpp": r"^[ \t]*#[ \t]*include[ \t]*(<[^>\n]*>|\x22[^\x22\n]*\x22)",
    "python": r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(?:\*|\([^)]*\)|[^\n#(]+)",
}
_TYPE_LINES = {
    "python": r"^[ \t]*class[ \t]+(\w+)",
    "go": r"^type[ \t]+(\w+)[ \t]+\S",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?(?:struct|union|enum|trait|type)[ \t]+(\w+)",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)[ \t]+)*(?:class|interface|enum|record)[ \t]+(\w+)",
    "ruby": r"^[ \t]*(?:class|module)[ \t]+([A-Z][\w:]*)",
    "typescript": r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:const[ \t]+)?(?:class|interface|enum|type)[ \t]+([\w$]+)",
}
_FUNCTION_LINES = {
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern)[ \t]+)*fn[ \t]+(\w+)",
    "ruby": r"^[ \t]*def[ \t]+(?:self\.)?(\w+[?!=]?)",
    "bash": r"^[ \t]*(?:function[ \t]+)?(\w+)[ \t]*\(\)",
    "python": r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(",
    "go": r"^func[ \t]*(?:\([^)]*\)[ \t]*)?(\w+)[ \t]*\(",
}


def _line_groups(patterns: dict[str, str], name: str) -> str:
    return " UNION ".join(f"SELECT language, rel_path AS file_path, line, regexp_extract(s, '{p}', 1) AS {name} FROM l WHERE language = '{k}' AND regexp_matches(s, '{p}')" for k, p in patterns.items())


ORACLE = {
    "tok_code": f"SELECT doc_id, array_to_string({_code('text')}, ' ') AS tokens FROM documents",
    "tok_plain": f"SELECT doc_id, array_to_string({_plain('text')}, ' ') AS tokens FROM documents",
    "corpus_statistics": f"SELECT count(*) AS n, CAST(sum(len({_code('text')})) AS BIGINT) AS total, round(sum(len({_code('text')})) / count(*), 6) AS avgdl FROM documents",
    "postings_df": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_code('text')}) AS term FROM documents) GROUP BY term",
    "bm25_batch": _with(_LIVE, _ASKED, _BM25) + "SELECT query_id, chunk_id, score, rank FROM lex",
    "bm25_degenerate": "SELECT CAST(0 AS BIGINT) AS query_id, '' AS chunk_id, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS rank WHERE false",
    "knn_batch": _with(_KNN) + "SELECT query_id, chunk_id, distance, rank FROM near",
    "cosine_to_label": f"""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS b FROM embeddings GROUP BY label), j AS (SELECT vec_id, embedding AS a, b FROM embeddings JOIN f USING (label))
SELECT vec_id, round({_DOT} / (sqrt({_DOT.replace("(a, b)", "(a, a)")}) * sqrt({_DOT.replace("(a, b)", "(b, b)")})), 6) AS cosine,
  round(sqrt(list_sum(list_transform(list_zip(a, b), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))), 6) AS distance FROM j""",
    "feature_hash_md5": f"WITH bodies AS (SELECT DISTINCT body FROM chunks), cv AS {_vector('bodies', 'body', 'body')} SELECT CAST(b AS INTEGER) AS bucket, count(*) AS texts, CAST(sum(CAST(round(CAST(CAST(v AS FLOAT) AS DOUBLE) * 100000) AS BIGINT)) AS BIGINT) AS total FROM cv GROUP BY b",
    "vector_batch": _with(_LIVE, _ASKED, _VECTOR) + "SELECT query_id, chunk_id, distance, rank FROM vec",
    "rrf_equal": _with(_LIVE, _ASKED, *_ARMS) + "SELECT query_id, chunk_id, score, bm25_rank, rank FROM fused",
    "rrf_weighted": _with(_LIVE, _ASKED, "aq AS (SELECT * FROM asked)", _ADAPTIVE, _BM25, _VECTOR, _fused("0.25", "w_vector", "JOIN aw USING (query_id)")) + "SELECT query_id, chunk_id, score, bm25_rank, rank FROM fused",
    "weights_adaptive": _with("aq AS (SELECT DISTINCT symbol_id AS query_id, name AS query FROM symbols UNION ALL SELECT DISTINCT query_id, query FROM hits)", _ADAPTIVE) + "SELECT DISTINCT a.query_id, q.query, CAST(w_lexical AS DOUBLE) AS w_lexical, CAST(w_vector AS DOUBLE) AS w_vector FROM aw a JOIN aq q USING (query_id)",
    "boosted": _with(
        _LIVE, _ASKED, *_ARMS,
        *_BOOSTED,
    ) + "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bo",
    "search_hybrid": _with(_LIVE, _ASKED, *_ARMS) + "SELECT query_id, chunk_id, score, rank FROM fused",
    "search_full": _with(
        _LIVE, _ASKED, "aq AS (SELECT * FROM asked)", _ADAPTIVE, _BM25, _VECTOR.replace("FROM vs)", "FROM vs WHERE chunk_id IN (SELECT id FROM cv))"), _fused("w_lexical", "w_vector", "JOIN aw USING (query_id)"), *_BOOSTED, *_HYDRATED,
        """o AS (SELECT b.query_id, b.rank, b.chunk_id, b.score, l.file_path AS file, l.start_line, l.end_line, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bo) b JOIN live l ON l.id = b.chunk_id)""",
        """r1(query_id, n, rank, chunk_id, score, ok, kept) AS (
  SELECT query_id, n, rank, chunk_id, score, true, [{'f': file, 'a': start_line, 'b': end_line}] FROM o WHERE n = 1
  UNION ALL
  SELECT o.query_id, o.n, o.rank, o.chunk_id, o.score, x.ok, CASE WHEN x.ok THEN list_append(r1.kept, {'f': o.file, 'a': o.start_line, 'b': o.end_line}) ELSE r1.kept END
  FROM r1 JOIN o ON o.query_id = r1.query_id AND o.n = r1.n + 1,
  LATERAL (SELECT len(list_filter(r1.kept, lambda k: k.f = o.file AND least(k.b, o.end_line) - greatest(k.a, o.start_line) + 1 > 0.5 * (least(k.b - k.a, o.end_line - o.start_line) + 1))) = 0 AS ok) x)""",
        "k1 AS (SELECT query_id, chunk_id, score, rank FROM r1 WHERE ok)",
        "mm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM k1 GROUP BY query_id)",
        "c AS (SELECT k1.*, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS rel FROM k1 JOIN mm USING (query_id))",
        "fv AS (SELECT id, b, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM cv)",
        "nv AS (SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM fv WHERE id IN (SELECT chunk_id FROM c))",
        "pc AS (SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, sum(u.v * w.v) AS cos FROM c x JOIN c y USING (query_id) JOIN nv u ON u.id = x.chunk_id JOIN nv w ON w.id = y.chunk_id AND w.b = u.b GROUP BY ALL)",
        """r2(query_id, step, picked) AS (
  SELECT query_id, 0, CAST([] AS VARCHAR[]) FROM mm
  UNION ALL
  SELECT query_id, step + 1, list_append(picked, chunk_id) FROM (
    SELECT query_id, step, picked, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * most, 12) DESC, rank) AS n FROM (
      SELECT r2.query_id, r2.step, r2.picked, c.chunk_id, c.rel, c.rank, coalesce(max(greatest(pc.cos, 0)), 0) AS most
      FROM r2 JOIN c ON c.query_id = r2.query_id AND NOT list_contains(r2.picked, c.chunk_id) LEFT JOIN pc ON pc.query_id = r2.query_id AND pc.a = c.chunk_id AND list_contains(r2.picked, pc.b)
      GROUP BY ALL)) WHERE n = 1)""",
        "f2 AS (SELECT query_id, CAST(step AS BIGINT) AS rank, picked[step] AS chunk_id FROM r2 WHERE step BETWEEN 1 AND 10)",
        f"""h2 AS (SELECT f2.*, k1.score, l.file_path, l.start_line, l.end_line, coalesce(l.kind, '') AS kind, sy.signature, CAST(coalesce(im.imports, 0) AS INTEGER) AS imports,
  list_distinct(list_concat({_code("substring(l.body, 1, 2000)")}, {_code("coalesce(sy.signature, '')")})) AS w
  FROM f2 JOIN k1 ON k1.query_id = f2.query_id AND k1.chunk_id = f2.chunk_id JOIN live l ON l.id = f2.chunk_id LEFT JOIN sy ON sy.chunk_id = f2.chunk_id LEFT JOIN im ON im.file_path = l.file_path)""",
        """r3(query_id, rank, ok, kept) AS (
  SELECT query_id, rank, true, [w] FROM h2 WHERE rank = 1
  UNION ALL
  SELECT h2.query_id, h2.rank, x.ok, CASE WHEN x.ok THEN list_append(r3.kept, h2.w) ELSE r3.kept END
  FROM r3 JOIN h2 ON h2.query_id = r3.query_id AND h2.rank = r3.rank + 1,
  LATERAL (SELECT len(h2.w) = 0 OR len(list_filter(r3.kept, lambda k: len(list_intersect(k, h2.w)) >= 0.9 * len(list_distinct(list_concat(k, h2.w))))) = 0 AS ok) x)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT query_id, rank, chunk_id, file_path, start_line, end_line, kind, signature, round(score, 9) AS score, imports FROM h2 JOIN r3 USING (query_id, rank) WHERE ok",
    "overlap_dedup": """WITH RECURSIVE """ + _HITS + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h),
r(query_id, n, rank, hit_id, ok, kept) AS (
  SELECT query_id, n, rank, hit_id, true, [{'f': file, 'a': start_line, 'b': end_line}] FROM o WHERE n = 1
  UNION ALL
  SELECT o.query_id, o.n, o.rank, o.hit_id, x.ok, CASE WHEN x.ok THEN list_append(r.kept, {'f': o.file, 'a': o.start_line, 'b': o.end_line}) ELSE r.kept END
  FROM r JOIN o ON o.query_id = r.query_id AND o.n = r.n + 1,
  LATERAL (SELECT len(list_filter(r.kept, lambda k: k.f = o.file AND least(k.b, o.end_line) - greatest(k.a, o.start_line) + 1 > 0.5 * (least(k.b - k.a, o.end_line - o.start_line) + 1))) = 0 AS ok) x)
SELECT query_id, rank, hit_id FROM r WHERE ok""",
    "content_dedup": "WITH RECURSIVE " + _HITS + f""", o AS (SELECT query_id, rank, hit_id, list_distinct(list_concat({_code("coalesce(snippet, '')")}, {_code("coalesce(signature, '')")})) AS w, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM h),
r(query_id, n, rank, hit_id, ok, kept) AS (
  SELECT query_id, n, rank, hit_id, true, [w] FROM o WHERE n = 1
  UNION ALL
  SELECT o.query_id, o.n, o.rank, o.hit_id, x.ok, CASE WHEN x.ok THEN list_append(r.kept, o.w) ELSE r.kept END
  FROM r JOIN o ON o.query_id = r.query_id AND o.n = r.n + 1,
  LATERAL (SELECT len(o.w) = 0 OR len(list_filter(r.kept, lambda k: len(list_intersect(k, o.w)) >= 0.9 * len(list_distinct(list_concat(k, o.w))))) = 0 AS ok) x)
SELECT query_id, rank, hit_id FROM r WHERE ok""",
    "mmr": "WITH RECURSIVE " + _KNN + """, sc AS (SELECT query_id, chunk_id, 0 - distance AS score, rank FROM near),
mm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM sc GROUP BY query_id),
c AS (SELECT sc.*, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS rel, e.v FROM sc JOIN mm USING (query_id) JOIN e ON e.vec_id = sc.chunk_id),
pc AS (SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b, list_sum(list_transform(list_zip(x.v, y.v), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
  / (sqrt(list_sum(list_transform(x.v, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) * sqrt(list_sum(list_transform(y.v, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))) AS cos FROM c x JOIN c y USING (query_id)),
r(query_id, step, picked) AS (
  SELECT query_id, 0, CAST([] AS BIGINT[]) FROM mm
  UNION ALL
  SELECT query_id, step + 1, list_append(picked, chunk_id) FROM (
    SELECT query_id, step, picked, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * rel - 0.3 * most, 12) DESC, rank) AS n FROM (
      SELECT r.query_id, r.step, r.picked, c.chunk_id, c.rel, c.rank, coalesce(max(greatest(pc.cos, 0)), 0) AS most
      FROM r JOIN c ON c.query_id = r.query_id AND NOT list_contains(r.picked, c.chunk_id) LEFT JOIN pc ON pc.query_id = r.query_id AND pc.a = c.chunk_id AND list_contains(r.picked, pc.b)
      GROUP BY ALL)) WHERE n = 1),
f AS (SELECT query_id, step AS rank, picked[step] AS chunk_id FROM r WHERE step > 0)
SELECT f.query_id, f.chunk_id, sc.score, CAST(f.rank AS BIGINT) AS rank FROM f JOIN sc ON sc.query_id = f.query_id AND sc.chunk_id = f.chunk_id""",
    "hydrated": _with(
        _LIVE, _ASKED, _BM25,
        "sy AS (SELECT chunk_id, arg_min(signature, {'l': line, 's': coalesce(signature, '')}) AS signature FROM symbols WHERE chunk_id IS NOT NULL AND signature IS NOT NULL GROUP BY chunk_id)",
        "im AS (SELECT file_path, string_agg(source || '/' || kind || '/' || line, ',' ORDER BY ord, source, kind, line) AS imports FROM (SELECT DISTINCT file_path, ord, source, kind, line FROM file_imports WHERE file_path IS NOT NULL) GROUP BY file_path)",
    ) + "SELECT query_id, rank, lex.chunk_id, live.file_path, coalesce(kind, '') AS kind, signature, md5(substring(body, 1, 2000)) AS snippet, coalesce(imports, '') AS imports FROM lex JOIN live ON live.id = lex.chunk_id LEFT JOIN sy ON sy.chunk_id = lex.chunk_id LEFT JOIN im ON im.file_path = live.file_path",
    "wire": _with(_LIVE, _ASKED, _BM25, *_HYDRATED)
    + """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INTEGER) AS at, live.file_path AS file, start_line, end_line, coalesce(kind, '') AS kind, signature, md5(substring(body, 1, 2000)) AS snippet, score,
  CAST(coalesce(imports, 0) AS INTEGER) AS imports, 0 AS exports FROM lex JOIN live ON live.id = lex.chunk_id LEFT JOIN sy ON sy.chunk_id = lex.chunk_id LEFT JOIN im ON im.file_path = live.file_path""",
    "index_files": "SELECT DISTINCT 'documents' AS repo_id, doc_id || '.txt' AS path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL",
    "index_chunks": _with(_DOC_CHUNKS) + f"SELECT id, start_line, end_line, md5(body) AS body, CAST(len({_code('body')}) AS BIGINT) AS tokens FROM live",
    "index_search": _with(_DOC_CHUNKS, _ASKED, _BM25) + "SELECT query_id, chunk_id, score, rank FROM lex",
    "structure_imports": _with(_LINES)
    + _line_groups(_IMPORT_LINES, "source")
    + r" UNION SELECT language, rel_path, line, list_min(list_transform(string_split(regexp_extract(s, '^[ \t]*import[ \t]+([\w., \t]+)', 1), ','), lambda x: regexp_extract(x, '[^ \t]+'))) FROM l WHERE language = 'python' AND regexp_matches(s, '^[ \t]*import[ \t]+[\w., \t]+')",
    "structure_functions": _with(_LINES) + _line_groups(_FUNCTION_LINES, "name"),
    "overlap_with_previous": _with(_LIVE)
    + """SELECT id, CASE WHEN least(b, end_line) < greatest(a, start_line) THEN 0 ELSE round((least(b, end_line) - greatest(a, start_line) + 1) / least(b - a + 1, end_line - start_line + 1), 6) END AS share
FROM (SELECT id, start_line, end_line, lag(start_line) OVER w AS a, lag(end_line) OVER w AS b FROM live WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line, id)) WHERE a IS NOT NULL""",
    "words_with_previous": f"""WITH h AS (SELECT DISTINCT query_id, rank, hit_id, list_distinct({_code('snippet')}) AS w FROM hits),
x AS (SELECT *, lag(w) OVER (PARTITION BY query_id ORDER BY rank, hit_id) AS v FROM h)
SELECT query_id, hit_id, CASE WHEN len(list_distinct(list_concat(w, v))) = 0 THEN 0 ELSE round(len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))), 6) END AS likeness FROM x WHERE v IS NOT NULL""",
    "structure_types": _with(_LINES) + _line_groups(_TYPE_LINES, "name"),
    "registry_prune": _with(_NOW) + "SELECT DISTINCT repo_id FROM file_states WHERE repo_id NOT IN (SELECT repo_id FROM now)",
    "sales_by_region": """SELECT r_name, n_name, count(*) AS lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "order_gaps": """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS nth, CAST(date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS INTEGER) AS days
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "windows": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n\z', ''), chr(10)) AS w FROM documents WHERE text <> ''),
s AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 15) + 1, 45)) AS a FROM l)
SELECT doc_id || ':' || a || '-' || least(len(w), a + 59) AS id, CAST(a AS INTEGER) AS start_line, CAST(least(len(w), a + 59) AS INTEGER) AS end_line, md5(array_to_string(w[a:a + 59], chr(10))) AS body FROM s""",
    "blank_islands": r"""WITH l AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS s FROM l), y AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x WHERE regexp_matches(s, '[^ \t]'))
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line FROM y GROUP BY doc_id, g""",
    "chunk_id_parse": r"""WITH c AS (SELECT id FROM chunks UNION SELECT chunk_id FROM symbols), p AS (SELECT id, regexp_matches(id, '(?s)^.*:\d{1,9}-\d{1,9}$') AS ok FROM c)
SELECT id, CASE WHEN ok THEN regexp_extract(id, '(?s)^(.*):(\d{1,9})-(\d{1,9})$', 1) END AS path, CASE WHEN ok THEN CAST(regexp_extract(id, '(?s)^(.*):(\d{1,9})-(\d{1,9})$', 2) AS INTEGER) END AS start_line, CASE WHEN ok THEN CAST(regexp_extract(id, '(?s)^(.*):(\d{1,9})-(\d{1,9})$', 3) AS INTEGER) END AS end_line FROM p""",
    "gates": "SELECT DISTINCT repo_id, rel_path FROM source_files WHERE length <= 1048576 AND len(list_filter(string_split(content, chr(10)), lambda x: strlen(x) > 4096)) = 0",
    "lang_detect": r"""SELECT DISTINCT rel_path, CASE regexp_extract(rel_path, '\.([^./\\]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'cts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go'
WHEN 'sh' THEN 'bash' WHEN 'bash' THEN 'bash' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'rb' THEN 'ruby' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'hxx' THEN 'cpp' WHEN 'hh' THEN 'cpp' END AS language FROM source_files""",
    "first_lines": r"SELECT DISTINCT record_id, list_filter(list_transform(string_split(docstring, chr(10)), lambda x: trim(regexp_replace(x, '[\r\t]', ' ', 'g'))), lambda x: x <> '')[1] AS line FROM csn_records",
    "snippets": "SELECT DISTINCT id, md5(substring(body, 1, 2000)) AS snippet, CAST(length(substring(body, 1, 2000)) AS INTEGER) AS chars FROM chunks",
    "delta_changes": _with(_NOW, _OLD) + "SELECT repo_id, path, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN n.h = o.h THEN 'same' ELSE 'changed' END AS change FROM (SELECT repo_id, path, content_hash AS h FROM now) n FULL JOIN (SELECT repo_id, path, content_hash AS h FROM old) o USING (repo_id, path)",
    "upsert_files": _with(_NOW, _OLD) + "SELECT * FROM now UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.repo_id = old.repo_id AND now.path = old.path)",
    "eval_recall_mrr": _with(_LIVE, _LABELS, _LABEL_ASKED, *_ARMS, _EVAL) + "SELECT arm, count(*) AS queries, count(*) FILTER (rank IS NULL) AS misses, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM fa GROUP BY arm",
    "eval_hybrid_worse": _with(_LIVE, _LABELS, _LABEL_ASKED, *_ARMS, _EVAL) + "SELECT count(*) FILTER (h.r > least(l.r, v.r)) AS worse, count(*) AS queries FROM (SELECT query_id, coalesce(rank, 1000000000) AS r FROM fa WHERE arm = 'hybrid') h JOIN (SELECT query_id, coalesce(rank, 1000000000) AS r FROM fa WHERE arm = 'lexical') l USING (query_id) JOIN (SELECT query_id, coalesce(rank, 1000000000) AS r FROM fa WHERE arm = 'vector') v USING (query_id)",
    "debounce_bursts": """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 600 SECOND THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM g GROUP BY user_id, g""",
}
