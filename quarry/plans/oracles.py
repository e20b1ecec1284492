"""SQL, for DuckDB over the same tables, of the engine's queries."""

from __future__ import annotations

from quarry.functions.text import LANGUAGES, SUPPORTED
from quarry.operators.ignore import IGNORED
from quarry.plans.catalog import CHANGED, NOW, PATHS, QUERY, SNIPPETS


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list, names: str) -> str:
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


_EXT = ", ".join(map(_q, SUPPORTED))
_SUFFIX = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
_LANG = "CASE lower(suffix) " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in LANGUAGES.items()) + " END"
_NAMES = ", ".join(_q(p) for p in IGNORED if "*" not in p)
_IGNORED = f"(list_has_any(string_split(path, '/'), [{_NAMES}]) OR ends_with(path, '.pyc') OR ends_with(path, '.egg-info'))"
_FILES = "SELECT doc_id, source AS project, '/' || source || '/' || doc_id || '.' || lang AS path, text FROM documents"


def _chunks(files: str, size: int, overlap: int, name: str = "c") -> str:
    step = max(1, size - overlap)
    return f"""{name}_l AS (SELECT project, path, sha256(text) AS file_hash, CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM ({files})),
     {name} AS (SELECT project, path, (i // {step})::INT AS chunk_idx, path || ':' || (i // {step}) AS chunk_id, array_to_string(l[i + 1:least(i + {size}, len(l))], chr(10)) AS text, 'block' AS type, '' AS name,
              (i + 1)::INT AS line_start, least(i + {size}, len(l))::INT AS line_end, i::INT AS start_line, least(i + {size}, len(l))::INT AS end_line, 'line' AS offset_unit, file_hash FROM (SELECT *, unnest(range(0, len(l), {step})) AS i FROM {name}_l))"""


_CODE = _chunks(_FILES, 10, 2)
_OLD = _chunks(f"SELECT project, path || '.py' AS path, text FROM ({_FILES})", 10, 2, "o")
_NEXT = f"SELECT project, path || '.py' AS path, CASE WHEN doc_id % 10 = 0 THEN text || ' more' ELSE text END AS text FROM ({_FILES}) WHERE doc_id % 10 <> 1"
_TOKENS = "t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2) AS toks FROM documents WHERE text <> '')"
_STATS = f"""{_TOKENS},
     w AS (SELECT id, unnest(toks) AS term FROM t), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st), eps AS (SELECT 0.25 * avg(r) AS e FROM raw),
     idf AS (SELECT term, df, CASE WHEN r < 0 THEN e ELSE r END AS idf FROM raw, eps)"""


def _scores(queries: str) -> str:
    return f"""{_STATS},
     q AS ({queries}), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2)) AS term FROM q) GROUP BY ALL),
     sc AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(toks) / avgdl))), 9) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN t USING (id), st GROUP BY ALL),
     sp AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS sparse_rank FROM sc WHERE score > 0)"""


def _dense(queries: str) -> str:
    return f"""qv AS ({queries}),
     dd AS (SELECT query_id, v.vec_id AS id, list_sum(list_transform(list_zip(v.embedding, qv.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dist FROM embeddings v, qv),
     dn AS (SELECT query_id, id, 1 - dist AS score, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS dense_rank FROM dd)"""


_ONE, _NONE = f"SELECT 0 AS query_id, {_q(QUERY)} AS text", "SELECT 0 AS query_id, 'zzzzqq -- ?' AS text"
_BATCH = "SELECT item_id AS query_id, text FROM benchmark"
_QV0, _QVB = "SELECT 0 AS query_id, embedding FROM embeddings WHERE vec_id = 0", "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)"


def _fused(texts: str, vectors: str, each: int, top: int, k: int = 60) -> str:
    return f"""{_scores(texts)}, {_dense(vectors)},
     f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, dense_rank, sparse_rank, coalesce(1.0::DOUBLE / ({k} + dense_rank), 0) + coalesce(1.0::DOUBLE / ({k} + sparse_rank), 0) AS score
           FROM (SELECT * FROM dn WHERE dense_rank <= {each}) a FULL JOIN (SELECT * FROM sp WHERE sparse_rank <= {each}) b ON a.query_id = b.query_id AND a.id = b.id),
     fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank ASC NULLS LAST, sparse_rank) AS rank FROM f) WHERE rank <= {top})"""


def _rrf(k: int) -> str:
    return f"WITH {_fused(_BATCH, _QVB, 10, 10, k)} SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM fused"


_PATHS = _values(PATHS, "path")
_URLS = f"(SELECT path FROM {_PATHS} UNION ALL SELECT url FROM pages)"
_REG = _values([("src0", "/old/src0", "2020-01-01 00:00:00"), ("src1", "/old/src1", "2021-01-01 00:00:00"), ("gone", "/gone", "2022-01-01 00:00:00")], "project, project_path, t")
_EVENTS = "SELECT (user_id % 5)::VARCHAR AS project, user_id::VARCHAR AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, ts AS event_time, event_id FROM events"
_FIRST = "trim(split_part(text, chr(10), 1))"

ORACLES = {
    "tokenize": "SELECT doc_id AS id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2), ' ') AS tokens FROM documents",
    "split_lines": f"WITH {_CODE} SELECT split_part(split_part(path, '/', 3), '.', 1)::BIGINT AS id, len(l)::INT AS n_lines, sha256(array_to_string(l, '|')) AS lines FROM c_l",
    "chunk_lines": f"WITH {_chunks(_FILES, 10, 0)} SELECT * EXCLUDE (text, file_hash) FROM c",
    "chunk_lines_overlap": f"WITH {_CODE} SELECT chunk_id, text, line_start, line_end FROM c",
    "chunk_lines_default": f"WITH {_chunks(_FILES, 50, 5)} SELECT chunk_id, text, line_start, line_end FROM c",
    "chunk_dispatch": f"SELECT project, path, CASE WHEN strlen(text) > 512000 THEN 'lines' WHEN language IS NULL THEN 'lines' ELSE 'symbols' END AS chunker, language FROM (SELECT *, {_LANG} AS language FROM (SELECT *, {_SUFFIX} AS suffix FROM (SELECT project, text, path || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.txt' ELSE '.hpp' END AS path FROM ({_FILES}))))",
    "lang_map": f"SELECT path, suffix, {_LANG} AS language FROM (SELECT path, {_SUFFIX} AS suffix FROM {_PATHS})",
    "symbol_name": f"SELECT id, CASE WHEN contains(f, 'def ') THEN trim(split_part(split_part(f, 'def ', 2), '(', 1)) WHEN contains(f, 'class ') THEN trim(split_part(split_part(f, 'class ', 2), ':', 1)) WHEN contains(f, 'function ') THEN trim(split_part(split_part(f, 'function ', 2), '(', 1)) ELSE '' END AS name FROM (SELECT id, {_FIRST} AS f FROM {_values(list(enumerate(SNIPPETS)), 'id, text')})",
    "filter_supported": f"SELECT path FROM (SELECT path FROM {_URLS} UNION ALL SELECT path FROM ({_FILES})) WHERE lower({_SUFFIX}) IN ({_EXT})",
    "filter_ignored": f"SELECT path FROM {_URLS} WHERE NOT {_IGNORED}",
    "scan_ragignore": f"SELECT path FROM ({_FILES}) WHERE NOT {_IGNORED} AND NOT list_contains(string_split(path, '/'), 'src1') AND NOT ends_with(path, '.fr') AND NOT starts_with(path, '/src2/') AND NOT (path LIKE '%/%src3/1%')",
    "content_hash": "SELECT doc_id AS id, sha256(text) AS file_hash FROM documents",
    "bm25_tf": f"WITH {_STATS} SELECT id, term, tf FROM tf",
    "bm25_df": f"WITH {_STATS} SELECT term, df FROM df",
    "bm25_corpus_stats": f"WITH {_STATS} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "bm25_idf": f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_score": f"WITH {_scores(_ONE)} SELECT id, round(score, 6) AS score FROM sc",
    "bm25_topk": f"WITH {_scores(_ONE)} SELECT id, sparse_rank::INT AS sparse_rank, round(score, 6) AS score FROM sp WHERE sparse_rank <= 10",
    "bm25_empty": f"WITH {_scores(_NONE)} SELECT id, sparse_rank::INT AS sparse_rank, round(score, 6) AS score FROM sp WHERE sparse_rank <= 10",
    "dense_topk": f"WITH {_dense(_QV0)} SELECT id, dense_rank::INT AS dense_rank, round(score, 6) AS score FROM dn WHERE dense_rank <= 10",
    "dense_rank": f"WITH {_dense(_QVB)} SELECT query_id, id, dense_rank::INT AS dense_rank, round(score, 6) AS score FROM dn WHERE dense_rank <= 20",
    "dense_topk_batch": f"WITH {_dense(_QVB)} SELECT query_id, id, dense_rank::INT AS dense_rank, round(score, 6) AS score FROM dn WHERE dense_rank <= 10",
    "vec_normalize": "SELECT id, round(s / n, 6) AS total, round(sqrt(q / (n * n)) * 3, 6) AS norm FROM (SELECT vec_id AS id, list_sum(list_transform(embedding, lambda x: (x * 3)::FLOAT::DOUBLE)) AS s, sqrt(list_sum(list_transform(embedding, lambda x: (x * 3)::FLOAT::DOUBLE * (x * 3)::FLOAT::DOUBLE))) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q FROM embeddings)",
    "vec_mean_pool": "SELECT label, dim::INT AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL",
    "rrf_fuse": _rrf(60),
    "rrf_k30": _rrf(30),
    "rrf_k90": _rrf(90),
    "rrf_missing": f"WITH {_fused(_BATCH, _QVB, 10, 10)} SELECT query_id, id, rank::INT AS rank FROM fused JOIN documents ON id = doc_id WHERE id % 2 = 0",
    "hybrid_search": f"WITH {_fused(_ONE, _QV0, 10, 5)} SELECT id, rank::INT AS rank, round(score, 9) AS score, 'hybrid_rrf' AS search_type, sha256(text) AS text_hash FROM fused JOIN documents ON id = doc_id",
    "hybrid_search_batch": f"WITH {_fused(_BATCH, _QVB, 20, 10)} SELECT query_id, id, rank::INT AS rank, round(score, 9) AS score, 'hybrid_rrf' AS search_type FROM fused JOIN documents ON id = doc_id",
    "dense_only_search": f"WITH {_dense(_QV0)} SELECT id, dense_rank::INT AS rank, round(score, 6) AS score, 'dense_only' AS search_type FROM dn JOIN documents ON id = doc_id WHERE dense_rank <= 5",
    "search_file_types": f"WITH {_fused(_ONE, _QV0, 20, 10)} SELECT id, path, rank::INT AS rank FROM fused JOIN ({_FILES}) ON id = doc_id WHERE {_SUFFIX} = '.en'",
    "scan_chunks": f"WITH {_CODE} SELECT chunk_id, file_hash FROM c WHERE project = 'src1'",
    "chunks_by_path": f"WITH {_CODE} SELECT path, chunk_id FROM c WHERE path = '/src0/3.en' OR path = '/src1/5.en' OR path LIKE '/src2/1%'",
    "list_files": f"WITH {_CODE} SELECT DISTINCT path FROM c",
    "list_projects": f"WITH {_CODE} SELECT DISTINCT project FROM c",
    "project_stats": f"WITH {_CODE} SELECT project, count(*) AS n_chunks, count(DISTINCT path) AS n_files, coalesce(any_value(project_path), 'N/A') AS project_path FROM c LEFT JOIN {_REG} USING (project) GROUP BY project",
    "total_chunks": f"WITH {_CODE} SELECT count(*) AS total_chunks FROM c",
    "dry_run": f"SELECT path FROM ({_FILES}) WHERE project IN ('src1', 'src2')",
    "registry_upsert": f"SELECT coalesce(n.project, o.project) AS project, coalesce(n.project_path, o.project_path) AS project_path, coalesce(o.t, '{NOW}') AS first_indexed, CASE WHEN n.project IS NULL THEN o.t ELSE '{NOW}' END AS last_indexed FROM {_REG} o FULL JOIN {_values([('src1', '/new/src1'), ('src9', '/new/src9')], 'project, project_path')} n ON o.project = n.project",
    "registry_lookup": f"WITH {_CODE} SELECT project, project_path FROM (SELECT DISTINCT project FROM c) LEFT JOIN {_REG} USING (project)",
    "file_content": f"SELECT path, text FROM ({_FILES}) WHERE path LIKE '/src0/%'",
    "detect_changes": f"WITH {_OLD}, n AS ({_NEXT}), oh AS (SELECT DISTINCT project, path, file_hash FROM o) SELECT coalesce(n.project, oh.project) AS project, coalesce(n.path, oh.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN oh.path IS NULL THEN 'added' WHEN sha256(n.text) = file_hash THEN 'unchanged' ELSE 'changed' END AS change FROM n FULL JOIN oh ON n.path = oh.path AND n.project = oh.project",
    "append_new_chunks": f"WITH {_OLD}, {_chunks(_NEXT, 8, 0, 'n')} SELECT project, chunk_id, line_start, line_end FROM o UNION ALL SELECT project, chunk_id, line_start, line_end FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.project = n.project AND o.chunk_id = n.chunk_id)",
    "delete_paths": f"WITH {_CODE} SELECT chunk_id FROM c WHERE path NOT IN (SELECT path FROM ({_FILES}) WHERE doc_id % 7 = 0)",
    "force_clear": f"WITH {_CODE} SELECT chunk_id FROM c WHERE project <> 'src0'",
    "projects_to_index": f"WITH {_CODE} SELECT DISTINCT 'src' || (doc_id % 30) AS project FROM documents WHERE 'src' || (doc_id % 30) NOT IN (SELECT project FROM c)",
    "parse_changed": f"SELECT trim(p, ' ') AS path FROM (SELECT unnest(CASE WHEN contains(list, chr(10)) THEN string_split(list, chr(10)) ELSE string_split_regex(list, '\\s+') END) AS p FROM {_values(CHANGED, 'list')}) WHERE trim(p, ' ') <> ''",
    "coalesce_changes": f"SELECT project, path, arg_max(op, (event_time, event_id)) AS op, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS event_time FROM ({_EVENTS}) GROUP BY ALL",
    "debounce_sessions": f"SELECT project, strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_events FROM (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY event_time, event_id) AS s FROM (SELECT *, CASE WHEN event_time - lag(event_time) OVER (PARTITION BY project ORDER BY event_time, event_id) > INTERVAL 5 SECOND THEN 1 ELSE 0 END AS fresh FROM ({_EVENTS}))) GROUP BY project, s",
    "apply_changes": f"WITH {_chunks(_NEXT, 10, 2)} SELECT project, chunk_id, file_hash, line_start, line_end FROM c",
}

_PY = "import os\n\n@deco\ndef f(x):\n    return x\n\n\nclass A:\n    async def g(self):\n        def h(): pass\n"
#: What has no table: literals and a sample tree.
_SYMBOLS = [
    ("a.py", 0, "@deco\ndef f(x):\n    return x", "function", "f", 3, 5, 11, 39, "byte", _PY),
    ("a.py", 1, "def f(x):\n    return x", "function", "f", 4, 5, 17, 39, "byte", _PY),
    ("a.py", 2, "class A:\n    async def g(self):\n        def h(): pass", "class", "A", 8, 10, 42, 95, "byte", _PY),
    ("a.py", 3, "async def g(self):\n        def h(): pass", "function", "g", 9, 10, 55, 95, "byte", _PY),
    ("a.py", 4, "def h(): pass", "function", "h", 10, 10, 82, 95, "byte", _PY),
    ("b.py", 0, "def broken(:", "block", "", 1, 1, 0, 1, "line", "def broken(:"),
    ("c.js", 0, "function a() {}", "block", "", 1, 1, 0, 1, "line", "function a() {}"),
    ("d.py", 0, "x = 1", "block", "", 1, 1, 0, 1, "line", "x = 1"),
]


def _literal(x: str | int) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _rows(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({names})"


ORACLES |= {
    "bm25_stored": ORACLES["bm25_score"],
    "chunk_symbols": f"""SELECT 'p' AS project, path, chunk_idx, path || ':' || chunk_idx AS chunk_id, text, type, name, line_start, line_end, "start", "end", offset_unit, sha256(src) AS file_hash
        FROM {_rows(_SYMBOLS, 'path, chunk_idx, text, type, name, line_start, line_end, "start", "end", offset_unit, src')}""",
    "scan_files": f"SELECT name, n FROM {_rows([('__init__.py', 0), ('a.py', 22), ('App.tsx', 16)], 'name, n')}",
    "discover_repos": "SELECT true AS named, true AS sample",
    "index_project": f"SELECT 'sample' AS project, type, name, line_start, line_end, text FROM {_rows([('function', 'a', 1, 2, 'def a():' + chr(10) + '    return 1'), ('block', '', 1, 1, 'function b() {}')], 'type, name, line_start, line_end, text')}",
    "health": f"SELECT c AS \"check\", true AS ok FROM {_rows([('embedding',), ('store',), ('search',), ('writable',)], 'c')}",
    "stream_changes": "SELECT project, path, text FROM (SELECT (user_id % 5)::VARCHAR AS project, user_id || '.py' AS path, 'x = ' || event_id AS text, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'",
    "embed_text": """WITH t AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))) AS m FROM documents),
     b AS (SELECT doc_id, ('0x' || substr(m, 1, 2))::INT & 63 AS i, sum(CASE WHEN ('0x' || substr(m, 15, 2))::INT >= 128 THEN 1 ELSE -1 END)::DOUBLE AS x FROM t GROUP BY ALL),
     n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id AS id, 64 AS dim, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm, """ + ", ".join(f"round(coalesce((SELECT x FROM b WHERE b.doc_id = d.doc_id AND i = {i}) / nullif(n, 0), 0), 4) AS x{i}" for i in range(4)) + " FROM documents d LEFT JOIN n USING (doc_id)",
}

_TENTH = "SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 10 = 0"
_WHOLE = "SELECT 'p' AS project, doc_id // 200 AS path, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY doc_id // 200"
ORACLES |= {
    "bm25_skipping": f"WITH {_scores(_BATCH)} SELECT query_id, id, sparse_rank::INT AS sparse_rank, round(score, 6) AS score FROM sp WHERE sparse_rank <= 10",
    "bm25_grid": f"WITH {_scores(_BATCH)} SELECT query_id, id, sparse_rank::INT AS sparse_rank, round(score, 6) AS score FROM sp WHERE sparse_rank <= 10",
    "dense_grid": f"WITH {_dense(_TENTH)} SELECT query_id, id, dense_rank::INT AS dense_rank, round(score, 6) AS score FROM dn WHERE dense_rank <= 10",
    "ivf_exact": f"WITH {_dense(_TENTH)} SELECT query_id, id, dense_rank::INT AS dense_rank, round(score, 6) AS score FROM dn WHERE dense_rank <= 10",
    "vec_masked_mean": "SELECT run, dim::INT AS dim, round(sum(CASE WHEN label % 2 = 0 THEN x::DOUBLE ELSE 0 END) / greatest(count(*) FILTER (label % 2 = 0), 1e-9), 6) AS mean FROM (SELECT vec_id // 8 AS run, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY ALL",
    "chunk_splits": f"WITH {_chunks(_WHOLE, 10, 2)} SELECT path::VARCHAR AS path, chunk_idx, chunk_id, text, line_start, line_end FROM c",
    "append_bloom": ORACLES["append_new_chunks"],
    "sql_fuse": _rrf(60),
    "detect_by_digest": f"SELECT * FROM ({ORACLES['detect_changes']}) WHERE change <> 'unchanged'",
    "stream_debounce": ORACLES["debounce_sessions"],
}
