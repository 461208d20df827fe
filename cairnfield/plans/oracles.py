"""The same queries as SQL over the driver's tables, for comparison."""

from __future__ import annotations

from ..functions.clinical import CONTEXT, CONTEXT_GAP, NO_CONTEXT, QUESTION, REQUEST
from .reference_data import COMORBIDITIES, DEFAULT_PROTOCOL, DIAGNOSES, PROTOCOLS, QUICK_QUESTIONS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_NEAR = """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) ** 2)) AS distance
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d QUALIFY rank <= 6
)"""
_TEAMS = "WITH a AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN 'doctors' WHEN 2 THEN 'nurses' ELSE 'pharmacy' END AS team FROM events)"
_CHUNKS = "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT *, unnest(range(0, CASE WHEN n <= 1600 THEN 1 ELSE CAST(ceil((n - 200) / 1400.0) AS BIGINT) END)) AS i FROM d)"
_SPANS = "WITH p AS (SELECT source AS stem, doc_id AS page, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT stem, page, CAST(coalesce(sum(n + 2) OVER (PARTITION BY stem ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b, n FROM p)"
_DEDUP = "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents), m AS (SELECT doc_id, sha256, min(doc_id) OVER (PARTITION BY sha256) AS kept FROM h)"
_SQUEEZE = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_CODED = "SELECT c_custkey, c_name, ['L40.5', 'A41.9', 'T81.4', 'M05.3', 'Z00'][c_custkey % 5 + 1] AS code FROM customer"
_PROTOCOL_ITEMS = _values([(c, k, i, x) for c, (r, e, a, f) in [*PROTOCOLS.items(), ("Z00", (DEFAULT_PROTOCOL["protocol_ref"], DEFAULT_PROTOCOL["exams"], DEFAULT_PROTOCOL["actions"], False))] for k, xs in (("exam", e), ("action", [d for _, d in a])) for i, x in enumerate(xs)])
_PROTOCOL_REFS = _values([(c, r, len(a), ", ".join(x.split(" ")[0] for x in e)) for c, (r, e, a, f) in [*PROTOCOLS.items(), ("Z00", (DEFAULT_PROTOCOL["protocol_ref"], DEFAULT_PROTOCOL["exams"], DEFAULT_PROTOCOL["actions"], False))]])
_PATCHES = """WITH p AS (SELECT event_id, CAST(user_id AS VARCHAR) AS patient_id, event_id AS recorded_at,
  CASE WHEN event_type = 'view' THEN CAST(greatest(0, 100 - floor(value / 5)) AS INTEGER) END AS spo2,
  CASE WHEN event_type = 'click' THEN round(34 + value / 60, 1) END AS temp,
  CASE WHEN event_type = 'error' THEN CAST(floor(40 + value / 2) AS INTEGER) END AS hr,
  CASE WHEN event_type = 'purchase' THEN CAST(CAST(floor(10 + value / 3) AS BIGINT) AS VARCHAR) || '/80' END AS bp FROM events
), s AS (SELECT *, CASE WHEN CAST(split_part(bp, '/', 1) AS INTEGER) <= 30 THEN 10 * CAST(split_part(bp, '/', 1) AS INTEGER) ELSE CAST(split_part(bp, '/', 1) AS INTEGER) END AS sys FROM p)"""
_MANIFEST = _DEDUP + ", f AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'error' WHEN doc_id <> kept THEN 'skipped' ELSE 'ok' END AS status FROM m)"
_CHUNK_MANIFEST = "WITH k AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN doc_id % 4 <> 0 THEN 'd/' || doc_id || '.jsonl' ELSE '' END AS path, n_chars * 1.0 AS mtime FROM documents)"
_SANITIZE = r"regexp_replace(regexp_replace(strip_accents(regexp_replace(regexp_replace(translate({0}, '–—' || chr(10) || '•', '--  '), '^\s+|\s+$', '', 'g'), '\*+$', '')), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_KEY = r"trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9+]+', ' ', 'g'))"
_URL_NAME = r"regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1)"

SQL = {
    "knn_topk": _NEAR + " SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM r",
    "citations": _NEAR + " SELECT query_id, rank, '[' || rank || '] PCDT ' || coalesce(d.source, '?') || ' (pp. ' || vec_id || '-?)' AS label FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id",
    "knn_sources": _NEAR + " SELECT query_id, coalesce(string_agg(DISTINCT d.source, ', ' ORDER BY d.source), '') AS sources FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id GROUP BY query_id",
    "latest_per_key": "SELECT user_id, event_id, epoch_us(ts) AS ts_us, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "patients_filter": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'",
    "patients_search": "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%1_5%%' OR CAST(c_custkey AS VARCHAR) ILIKE '%1_5%%'",
    "alerts_filter": _TEAMS + " SELECT event_id, user_id, team FROM a WHERE event_type = 'error' AND team IN ('doctors', 'all')",
    "alerts_none": _TEAMS + " SELECT event_id, team FROM a WHERE event_type = ''",
    "patient_by_id": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "exam_by_key": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 899 AND o_orderkey = 0",
    "exact_dedup": _DEDUP + " SELECT doc_id, sha256, CASE WHEN doc_id <> kept THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN doc_id <> kept THEN 'duplicate_sha256' END AS detail, kept FROM m",
    "page_spans": _SPANS + ' SELECT stem, page, b AS "start", b + n AS "end" FROM s',
    "clean_pages": r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: NOT regexp_matches(x, '^\s*[0-9]{1,4}\s*$')) AS ls FROM documents),
        b AS (SELECT doc_id, regexp_replace(array_to_string(ls, chr(10)), '^\s+|\s+$', '', 'g') AS t FROM l)
        SELECT doc_id, sha256(CASE WHEN t = '' THEN '' ELSE t || chr(10) END) AS clean_sha256, CASE WHEN t = '' THEN 0 ELSE length(t) + 1 END AS n_chars FROM b""",
    "chunk_text": _CHUNKS + " SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, i * 1400 AS char_start, least(i * 1400 + 1600, n) AS char_end, sha256(substring(text, i * 1400 + 1, 1600)) AS chunk FROM c",
    "chunk_counts": "SELECT doc_id, CAST(CASE WHEN length(text) <= 0 THEN 0 WHEN length(text) <= 1600 THEN 1 ELSE ceil((length(text) - 200) / 1400.0) END AS INTEGER) AS n FROM documents",
    "chunk_page_range": _SPANS
    + """, t AS (SELECT stem, max(b + n) AS len FROM s GROUP BY stem), c AS (
        SELECT stem, len, unnest(range(0, CASE WHEN len <= 0 THEN 0 WHEN len <= 1600 THEN 1 ELSE CAST(ceil((len - 200) / 1400.0) AS BIGINT) END)) AS i FROM t)
        SELECT c.stem, c.i AS chunk_index, coalesce(min(s.page), 1) AS page_start, coalesce(max(s.page), 1) AS page_end
        FROM c LEFT JOIN s ON s.stem = c.stem AND s.n > 0 AND s.b < least(c.i * 1400 + 1600, c.len) AND s.b + s.n > c.i * 1400 GROUP BY c.stem, c.i""",
    "chunk_ids": _CHUNKS + " SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, doc_id || ':' || i AS chunk_id FROM c",
    "word_count": r"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '\S+')), 0) AS INTEGER) AS n FROM documents",
    "norm_space": f"SELECT doc_id, sha256({_SQUEEZE}) AS normal FROM documents",
    "ascii_fold": "SELECT doc_id, sha256(strip_accents(text)) AS folded FROM documents",
    "norm_key": f"SELECT doc_id, sha256({_KEY.format('text')}) AS key FROM documents",
    "sanitize_name": f"SELECT doc_id, sha256(upper(s[1]) || s[2:]) AS name FROM (SELECT doc_id, {_SANITIZE.format('text')} AS s FROM documents)",
    "parse_lines": r"SELECT doc_id, CAST(len(l) AS INTEGER) AS n, sha256(array_to_string(l, '|')) AS lines FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)",
    "page_links": r"""WITH b AS (SELECT page_id, url, list_filter(string_split(regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g'), '<'), lambda x: x[:2] = 'a ') AS tags FROM pages
        ), e AS (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS position FROM b
        ), h AS (SELECT page_id, url, position, replace(split_part(tag, '"', 2), '&amp;', '&') AS href FROM e
        ), l AS (SELECT page_id, position, split_part(CASE WHEN href[1] = '/' THEN split_part(url, '/', 1) || '//' || split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1) || href ELSE href END, '#', 1) AS link FROM h)
        SELECT page_id, link, CAST(min(position) AS INTEGER) AS position FROM l WHERE link[:4] = 'http' GROUP BY page_id, link""",
    "url_id": "SELECT page_id, sha256(url)[1:16] AS id FROM pages",
    "local_filename": rf"""WITH s AS (SELECT page_id, url, regexp_replace(CASE WHEN {_URL_NAME} = '' THEN 'document' ELSE {_URL_NAME} END, '[^\w.\-]+', '_', 'g')[1:180] AS slug FROM pages),
        f AS (SELECT page_id, url, slug || CASE WHEN lower(slug) LIKE '%.pdf' THEN '' WHEN page_id % 3 = 0 THEN '.pdf' WHEN contains(slug, '.') THEN '' WHEN page_id % 3 = 1 THEN '.html' ELSE '.bin' END AS name FROM s)
        SELECT page_id, CASE WHEN page_id = min(page_id) OVER (PARTITION BY name) THEN name ELSE regexp_replace(name, '(\.[^.]*)$', '_' || sha256(url)[1:8] || '\1') END AS filename FROM f""",
    "patient_detail": """WITH v AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
        o AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS exams FROM orders WHERE o_totalprice > 100000 GROUP BY 1)
        SELECT c_custkey, c_name, coalesce(v.value, 36.5) AS vital, CAST(coalesce(o.n, 0) AS INTEGER) AS n_exams, coalesce(o.exams, '') AS exams
        FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN v ON user_id = c_custkey""",
    "exam_attachments": """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS files FROM lineitem GROUP BY 1)
        SELECT o_orderkey, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(files, '') AS files FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "alert_names": "SELECT event_id, CASE WHEN user_id = 0 THEN 'Sistema' ELSE coalesce(c_name, CAST(user_id AS VARCHAR)) END AS name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 = 0",
    "pending_counts": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM orders GROUP BY o_custkey",
    "unresolved_count": "SELECT count(*) AS unresolved FROM orders WHERE o_orderstatus <> 'F'",
    "group_fixed_domain": "SELECT ordinal, type, (SELECT count(*) FROM events WHERE event_type = type) AS n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'prescription'), (3, 'purchase')) t(ordinal, type)",
    "last_user_turn": "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "vitals_locf": """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 36.5) AS temperature,
        coalesce(last_value(CASE WHEN event_type = 'click' THEN CAST(round(value) AS INTEGER) END IGNORE NULLS) OVER w, 72) AS heart_rate
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "patch_fold": "SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS a, arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY user_id",
    "vital_alerts": _PATCHES
    + """, a AS (SELECT patient_id, recorded_at, 'oxygen_saturation' AS kind, 'SpO2 crítico registrado (' || spo2 || '%).' AS message FROM s WHERE spo2 < 92
        UNION ALL SELECT patient_id, recorded_at, 'temperature', 'Temperatura crítica registrada (' || format('{:.1f}', temp) || ' °C).' FROM s WHERE temp >= 39 OR temp < 35
        UNION ALL SELECT patient_id, recorded_at, 'heart_rate', 'Frequência cardíaca crítica registrada (' || hr || ' bpm).' FROM s WHERE hr > 120 OR hr < 45
        UNION ALL SELECT patient_id, recorded_at, 'systolic', 'Pressão arterial crítica registrada (' || bp || ').' FROM s WHERE sys >= 180)
        SELECT patient_id, recorded_at, kind, 'critical' AS severity, 'clinical' AS category, message, 'doctors' AS team FROM a""",
    "vital_tiers": _PATCHES
    + """ SELECT event_id, CASE WHEN spo2 IS NOT NULL THEN 'oxygen_saturation' WHEN temp IS NOT NULL THEN 'temperature' WHEN hr IS NOT NULL THEN 'heart_rate' ELSE 'systolic' END AS kind,
        CASE WHEN spo2 < 90 OR temp >= 39 OR temp < 35 OR hr > 120 OR hr < 45 OR sys >= 180 THEN 'crit' WHEN spo2 < 94 OR temp >= 38 OR hr > 100 OR sys >= 140 THEN 'warn' ELSE 'normal' END AS tier
        FROM s WHERE coalesce(spo2, temp, hr, sys) IS NOT NULL""",
    "systolic": """WITH t AS (SELECT o_orderkey, split_part(CAST(CAST(floor(o_totalprice / 2500) AS BIGINT) AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '.5/80' WHEN o_orderkey % 5 = 0 THEN '' ELSE ' /80' END, '/', 1) AS s FROM orders),
        n AS (SELECT o_orderkey, CASE WHEN NOT contains(s, '.') THEN TRY_CAST(trim(s) AS INTEGER) END AS v FROM t)
        SELECT o_orderkey, CASE WHEN v <= 30 THEN v * 10 ELSE v END AS systolic FROM n""",
    "clamp_default": "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN least(120, greatest(0, p_size * 4 - 30)) ELSE 45 END AS age, CASE WHEN p_size % 3 = 0 OR trim(p_name) = '' THEN 'Paciente sem nome' ELSE trim(p_name) END AS name FROM part",
    "status_transition": "SELECT event_id, user_id, previous_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM events) WHERE event_type = 'error' AND previous_status IS DISTINCT FROM 'error'",
    "pending_alerts": """WITH p AS (SELECT o_custkey AS patient, o_orderkey AS o, (CASE WHEN o_orderkey % 11 = 0 THEN 'Lactato ' ELSE 'Exame ' END) || o_orderkey AS name FROM orders WHERE o_orderstatus = 'P'),
        g AS (SELECT patient, count(*) AS n, list(name ORDER BY o)[1:3] AS names, arg_min(name, o) FILTER (WHERE contains(name, 'Lactato')) AS urgent FROM p GROUP BY patient)
        SELECT patient, 'critical' AS severity, n || ' exames pendentes que requerem atenção imediata.' AS message FROM g WHERE n > 3
        UNION ALL SELECT patient, 'moderate', 'Exames aguardando revisão: ' || array_to_string(names, ', ') || '.' FROM g WHERE n <= 3
        UNION ALL SELECT patient, 'critical', 'Exame crítico pendente: ' || urgent || '. Revisão urgente solicitada.' FROM g WHERE urgent IS NOT NULL""",
    "protocol_apply": f"SELECT c_custkey, kind, pos, item FROM ({_CODED}) JOIN {_PROTOCOL_ITEMS} t(pcode, kind, pos, item) ON pcode = code",
    "lookup_fallback": f"""WITH q AS (SELECT * FROM {_values([(c, '|'.join(x)) for c, x in QUICK_QUESTIONS.items()])} t(k, answer)), p AS (SELECT p_partkey, ['L40.5', 'L40.9', 'A41.0', 'Z00'][p_partkey % 4 + 1] AS code FROM part)
        SELECT p_partkey, code, answer FROM p JOIN q ON k = CASE WHEN code LIKE 'L40%' THEN 'L40.5' WHEN code LIKE 'A41%' THEN 'A41.9' ELSE 'default' END""",
    "decision_flow": f"""WITH c AS (SELECT c_custkey AS id, c_name, code, c_custkey % 90 AS age, ref, n, exams FROM ({_CODED}) JOIN {_PROTOCOL_REFS} t(pcode, ref, n, exams) ON pcode = code),
        l AS (SELECT id, code, list_filter(['[08:00:00] Triagem: dados do paciente carregados - ' || code || ', ' || c_name || ', ' || age || ' anos', '[08:00:01] Consultando protocolo: ' || ref,
          '[08:00:02] Exames identificados: ' || exams, '[08:00:03] Acoes sugeridas geradas: ' || n || ' itens - aguarda aprovacao medica',
          CASE WHEN code = 'A41.9' THEN 'Caso critico detectado - alerta imediato para equipe medica' END, CASE WHEN code = 'T81.4' THEN 'Possivel interacao medicamentosa detectada - encaminhado para farmacia' END,
          '[08:00:04] Alerta enviado: equipes notificadas conforme regras', '[08:00:05] Fluxo concluido'], lambda x: x IS NOT NULL) AS ls FROM c)
        SELECT id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line, code = 'A41.9' AS sepsis_critical, code = 'T81.4' AS pharmacy_interaction FROM l""",
    "catalog_merge": f"""WITH k AS (SELECT p_partkey AS o, 'P' || p_partkey AS code, p_name || ' ' || p_size AS label, p_brand AS ing FROM part WHERE p_partkey % 2 = 0),
        x AS (SELECT p_partkey AS o, p_name || ' ' || p_size AS label FROM part WHERE p_partkey % 2 = 1),
        n AS (SELECT {_KEY.format('label')} AS key, arg_min(upper(label[1]) || label[2:], o) AS label FROM x GROUP BY 1),
        w AS (SELECT key, arg_max(code, o) AS code FROM (SELECT o, code, {_KEY.format('label')} AS key FROM k UNION ALL SELECT o, code, {_KEY.format('ing')} FROM k) GROUP BY key),
        h AS (SELECT DISTINCT w.code FROM n JOIN w USING (key))
        SELECT k.code, k.label, CASE WHEN h.code IS NOT NULL THEN 'RENAME-2024,base' ELSE 'base' END AS tags, false AS is_new FROM k LEFT JOIN h ON h.code = k.code
        UNION ALL SELECT trim(regexp_replace(upper(n.label), '[^A-Z0-9]+', '_', 'g'), '_'), n.label, 'RENAME-2024', true FROM n LEFT JOIN w USING (key) WHERE w.code IS NULL""",
    "catalog_codes": """WITH b AS (SELECT p_partkey AS ordinal, p_name AS label, regexp_replace(upper(p_name), '[^A-Z0-9]+', '_', 'g') AS base FROM part)
        SELECT ordinal, label, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS code FROM b WINDOW w AS (PARTITION BY base ORDER BY ordinal)""",
    "catalog_list": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name",
    "catalog_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')",
    "catalog_unselected": "WITH p AS (SELECT p_partkey, p_name || ' ' || p_size || ' ' || p_brand AS p_name FROM part) SELECT p_partkey, p_name FROM p WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM p WHERE p_partkey % 3 = 0)",
    "code_selectable": "WITH c AS (SELECT p_partkey, upper(p_name[1]) || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '-X' ELSE '.1' END AS code FROM part) SELECT p_partkey, code, regexp_matches(code, '^[A-Z][0-9][0-9]') AND NOT contains(code, '-') AS selectable FROM c",
    "manifest_stats": _MANIFEST + " SELECT status, (SELECT count(*) FROM f WHERE f.status = t.status) AS n FROM (VALUES ('ok'), ('skipped'), ('error'), ('pending')) t(status)",
    "run_counters": _MANIFEST + " SELECT doc_id, status, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') OVER (ORDER BY doc_id) AS n_{s}" for s in ("ok", "skipped", "error")) + " FROM f",
    "embed_candidates": _CHUNK_MANIFEST + " SELECT doc_id, status FROM k WHERE status IN ('ok', 'skipped') AND path <> '' AND path IN (SELECT 'd/' || doc_id || '.jsonl' FROM labels)",
    "incremental_embed": _CHUNK_MANIFEST + " SELECT doc_id FROM k WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = k.doc_id AND l.quality = 1 AND k.doc_id % 2 = 0)",
    "incremental_chunk": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.doc_id + l.quality - 0.5 >= d.doc_id)",
    "manifest_scan": "SELECT DISTINCT (page_id % 100) || '.PDF' AS relative_path FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 = 0 AND page_id % 100 IN (SELECT page_id % 100 FROM pages WHERE page_id % 2 = 0)",
    "manifest_upsert": "WITH u AS (SELECT DISTINCT doc_id * 2 AS key, quality FROM labels) SELECT coalesce(u.key, d.doc_id) AS key, CASE WHEN u.key IS NULL THEN d.lang END AS error, CASE WHEN u.key IS NULL THEN d.n_chars ELSE CAST(u.quality AS BIGINT) END AS n FROM documents d FULL JOIN u ON u.key = d.doc_id",
    "replace_by_key": "SELECT doc_id, n_chars AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, CAST(toxic AS BIGINT) FROM labels",
    "sse_fold": "WITH e AS (SELECT *, CASE WHEN turn % 7 = 3 THEN 'error' WHEN role = 'assistant' THEN 'token' ELSE 'sources' END AS event FROM conversations) SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN event = 'token' THEN text END, '' ORDER BY turn), '')) AS answer, count(*) FILTER (WHERE event = 'token') AS n_tokens, bool_or(event = 'error') AS failed FROM e GROUP BY conv_id",
    "chunk_nav": _CHUNKS + " SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(lag(i) OVER w AS INTEGER) AS prev_index, CAST(lead(i) OVER w AS INTEGER) AS next_index FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "weekly_volume": "SELECT event_type, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week, count(*) AS n FROM events GROUP BY 1, 2",
}
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CONTEXT = (
    _NEAR
    + f""", b AS (SELECT query_id, string_agg('[' || rank || '] PCDT stem=' || coalesce(d.source, '?') || ' págs. ' || vec_id || '-?' || chr(10) || {_STRIP.format("coalesce(text, '')")}, {_text(CONTEXT_GAP)} ORDER BY rank) AS context
      FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id GROUP BY query_id)"""
)
_PATIENTS = f"SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'admitted' ELSE 'discharged' END AS status, code AS cid_code, 'label ' || code AS cid_label FROM ({_CODED})"
_EXAMS = "SELECT o_orderkey AS id, o_custkey AS patient_id, 'Exame ' || o_orderkey AS name, strftime(o_orderdate, '%Y-%m-%d') AS requested_at, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'critical' END AS status, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS at_us FROM orders"
_ITEMS = "SELECT event_id AS id, user_id AS patient_id, CASE WHEN event_type = 'click' THEN 'exam' ELSE 'review' END AS type, CASE WHEN event_id % 4 = 0 THEN 'accepted' ELSE 'suggested' END AS status FROM events WHERE event_type IN ('purchase', 'click')"
_FILES = "SELECT l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice AS id, l_orderkey AS exam_id, 'f' || l_linenumber || '.pdf' AS name, 'application/pdf' AS mime, l_partkey AS size, 'up/' || l_partkey AS path FROM lineitem"
_READMIT = f"WITH p AS ({_PATIENTS}), r AS (SELECT * FROM p WHERE id % 10 = 0), fine AS (SELECT * FROM r WHERE status <> 'admitted')"
_MOVED = f"WITH p AS ({_PATIENTS}), m AS (SELECT id FROM p WHERE id % 7 = 0 AND cid_code <> 'A41.9')"

SQL |= {
    "context_block": _CONTEXT + " SELECT query_id, sha256(context) AS context FROM b",
    "prompt_text": _CONTEXT
    + f""", u AS (SELECT conv_id AS query_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
        SELECT u.query_id, sha256({_text(QUESTION)} || coalesce(u.text, '') || {_text(CONTEXT)} || coalesce(b.context, {_text(NO_CONTEXT)}) || {_text(REQUEST)}) AS prompt FROM u LEFT JOIN b USING (query_id)""",
    "text_previews": "SELECT doc_id, sha256(replace(text, chr(10), ' ')[1:200]) AS preview, sha256(CASE WHEN length(text) > 42 THEN text[1:40] || '…' ELSE text END) AS title FROM documents",
    "flat_metadata": """SELECT doc_id, source AS source_stem, CASE WHEN doc_id % 3 = 0 THEN lang END AS section, CAST(n_chars AS VARCHAR) AS chunk_index,
        CASE WHEN doc_id % 2 = 0 THEN '[' || doc_id || ', ' || (doc_id + 1) || ']' END AS page_range, '["' || lang || '", "a\\"b"]' AS tags,
        CAST((source IS NOT NULL)::INT + (doc_id % 3 = 0 AND lang IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT + (doc_id % 2 = 0)::INT + 1 AS INTEGER) AS n FROM documents""",
    "display_values": "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, '—') AS lang, CASE WHEN doc_id % 2 = 0 THEN doc_id || ', ' || n_chars ELSE '—' END AS pages FROM documents",
    "section_split": r"""WITH m AS (
          SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>(.*?)</script>', chr(10) || '```' || chr(10) || '## code' || chr(10) || '\1' || chr(10) || '```' || chr(10), 'g'),
            '<(nav|article|footer)>', chr(10) || '## \1' || chr(10), 'g'), '(?s)<h1>(.*?)</h1>', chr(10) || '### \1' || chr(10), 'g'), '<(p|li|div class=.ad.)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS md FROM pages
        ), l AS (SELECT page_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos FROM m
        ), o AS (SELECT *, trim(line) AS t, coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at0 FROM l
        ), f AS (SELECT *, sum((t LIKE '```%')::INT) OVER (PARTITION BY page_id ORDER BY pos) % 2 = 1 AS fenced FROM o
        ), h AS (SELECT *, CASE WHEN NOT fenced AND t LIKE '## %' THEN trim(t[4:]) END AS h1, CASE WHEN NOT fenced AND t LIKE '### %' THEN trim(t[5:]) END AS h2 FROM f
        ), n AS (SELECT *, h1 IS NOT NULL OR h2 IS NOT NULL AS head, sum((h1 IS NOT NULL OR h2 IS NOT NULL)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS sec FROM h
        ), c AS (
          SELECT page_id, sec, max(h1) AS h1, max(h2) AS h2, min(at0) FILTER (WHERE NOT head) AS b, max(at0 + length(line)) AS upto, max(pos) AS last FROM n GROUP BY page_id, sec
        ), d AS (
          SELECT *, last_value(h1 IGNORE NULLS) OVER w AS header_1, max(CASE WHEN h1 IS NOT NULL THEN sec END) OVER w AS s1,
                 last_value(h2 IGNORE NULLS) OVER w AS g2, max(CASE WHEN h2 IS NOT NULL THEN sec END) OVER w AS s2,
                 lead(sec) OVER (PARTITION BY page_id ORDER BY sec) IS NULL AS final FROM c WINDOW w AS (PARTITION BY page_id ORDER BY sec)
        ), e AS (SELECT *, CASE WHEN s2 > coalesce(s1, -1) THEN g2 END AS header_2, CASE WHEN final THEN upto ELSE upto + 1 END AS z FROM d WHERE b IS NOT NULL
        ), g AS (SELECT e.*, md[b + 1:z] AS body FROM e JOIN m USING (page_id))
        SELECT CAST(page_id AS VARCHAR) AS source_stem, coalesce(nullif(concat_ws(' > ', nullif(header_1, ''), nullif(header_2, '')), ''), '(sem cabeçalho)') AS section, header_1, header_2,
               CAST(b AS INTEGER) AS char_start, CAST(z AS INTEGER) AS char_end, sha256(body) AS body FROM g WHERE regexp_matches(body, '\S')""",
    "sentence_pages": """WITH t AS (SELECT conv_id AS stem, turn AS page, coalesce(text, '') AS text FROM conversations
        ), s AS (SELECT stem, page, sum(length(text) + 2) OVER (PARTITION BY stem ORDER BY page) - 2 AS e, length(text) AS n FROM t
        ), w AS (SELECT stem, string_agg(text, chr(10) || chr(10) ORDER BY page) AS whole FROM t GROUP BY stem
        ), p AS (SELECT stem, unnest(string_split(whole, '. ')) AS part, generate_subscripts(string_split(whole, '. '), 1) - 1 AS chunk_index FROM w
        ), i AS (SELECT stem, chunk_index, sum(length(part) + 2) OVER (PARTITION BY stem ORDER BY chunk_index) - 2 AS b, length(part) AS n FROM p)
        SELECT i.stem AS conv_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(i.b - i.n AS BIGINT) AS char_start, CAST(i.b AS BIGINT) AS char_end,
               coalesce(min(s.page), 1) AS page_start, coalesce(max(s.page), 1) AS page_end
        FROM i LEFT JOIN s ON s.stem = i.stem AND i.b - i.n < s.e AND i.b > s.e - s.n GROUP BY ALL""",
    "patient_full": f"""WITH p AS ({_PATIENTS}), f AS (SELECT exam_id, list({{'name': name, 'mime': mime, 'size': size, 'path': path}} ORDER BY id) AS fs FROM ({_FILES}) GROUP BY exam_id),
        e AS (SELECT patient_id, list({{'id': id, 'name': name, 'requestedAt': requested_at, 'status': status, 'protocolRef': CAST(NULL AS VARCHAR), 'attachments': coalesce(fs, [])}} ORDER BY at_us DESC, id) AS es FROM ({_EXAMS}) LEFT JOIN f ON exam_id = id GROUP BY patient_id),
        i AS (SELECT patient_id, list({{'id': id, 'type': type, 'status': status}} ORDER BY id) AS xs FROM ({_ITEMS}) GROUP BY patient_id),
        l AS (SELECT user_id AS patient_id, list({{'id': event_id, 'step': 'admission', 'timestamp': epoch_us(ts)}} ORDER BY ts DESC, event_id DESC) AS ls FROM events WHERE event_type = 'error' GROUP BY 1),
        v AS (SELECT user_id AS patient_id, arg_max(CAST(floor(value) AS INTEGER), (ts, event_id)) AS hr, arg_max(CAST(event_id AS VARCHAR), (ts, event_id)) AS shown FROM events WHERE event_type = 'view' GROUP BY 1)
        SELECT p.id, CAST(to_json({{'id': p.id, 'name': p.name, 'status': p.status, 'cid': {{'code': cid_code, 'label': cid_label}}, 'vitalSigns': {{'heartRate': coalesce(hr, 72), 'updatedAt': shown}},
          'exams': coalesce(es, []), 'suggestedItems': coalesce(xs, []), 'agentLog': coalesce(ls, [])}}) AS VARCHAR) AS body
        FROM p LEFT JOIN e ON e.patient_id = p.id LEFT JOIN i ON i.patient_id = p.id LEFT JOIN l ON l.patient_id = p.id LEFT JOIN v ON v.patient_id = p.id""",
    "patients_sorted": "SELECT c_custkey, c_name, round(c_acctbal) AS admitted_at FROM customer ORDER BY admitted_at DESC, c_custkey",
    "alerts_sorted": _TEAMS + " SELECT event_id, team, epoch_us(ts) AS ts_us FROM a ORDER BY ts DESC, event_id",
    "exams_sorted": f"SELECT id, patient_id, at_us FROM ({_EXAMS}) ORDER BY at_us DESC, id",
    "items_sorted": f"{_ITEMS} ORDER BY id",
    "log_sorted": "SELECT event_id AS id, 'admission' AS step, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error' ORDER BY at_us DESC, id DESC",
    "first_manifest_rows": "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 25",
    "download_slice": "SELECT * FROM region ORDER BY r_regionkey LIMIT (SELECT count(*) - 2 FROM region)",
    "exam_tab": f"SELECT id, patient_id FROM ({_EXAMS}) WHERE status = 'critical'",
    "grouped_actions": f"""WITH i AS ({_ITEMS}), d AS (SELECT DISTINCT patient_id FROM i)
        SELECT d.patient_id, t.ordinal, t.type, coalesce(string_agg(CAST(i.id AS VARCHAR), ',' ORDER BY i.id), '') AS items
        FROM d, (VALUES (0, 'exam'), (1, 'prescription'), (2, 'observation')) t(ordinal, type) LEFT JOIN i ON i.patient_id = d.patient_id AND i.type = t.type GROUP BY ALL""",
    "new_patient_fields": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'Paciente sem nome' ELSE c_name END AS name, CASE WHEN c_custkey % 4 < 2 THEN 'Não informado' ELSE 'visto' END AS observations, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM customer",
    "comorbidity_labels": f"WITH c AS (SELECT p_partkey, {[c for c, _, _ in COMORBIDITIES][:5] + ['??']}[p_partkey % 6 + 1] AS code FROM part) SELECT p_partkey, c.code, coalesce(t.label, c.code) AS label FROM c LEFT JOIN {_values([(c, x) for c, x, _ in COMORBIDITIES])} t(code, label) ON t.code = c.code",
    "code_library": f"""WITH c AS (SELECT upper(p_name[1]) || lpad(CAST(p_size AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '-X' ELSE '.1' END AS code, p_name AS label FROM part)
        SELECT code, label, 'library' AS origin FROM c WHERE regexp_matches(code, '^[A-Z][0-9][0-9]') AND NOT contains(code, '-') UNION ALL SELECT code, label, 'fallback' FROM {_values(DIAGNOSES)} t(code, label)""",
    "toggled": "SELECT p_partkey, CASE WHEN p_size % 3 = p_partkey % 3 THEN 'a' ELSE 'a,' || (p_partkey % 3) || ',' || (p_size % 3) END AS chosen FROM part",
    "relative_paths": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id || '.pdf' ELSE '/other/' || page_id || '.pdf' END AS path FROM pages",
    "exam_units": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'mmol/L' ELSE 'mg/dL' END AS unit FROM part",
    "breadcrumbs": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 0 THEN p_name || ' > ' || p_brand WHEN p_partkey % 3 > 0 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand ELSE '(sem cabeçalho)' END AS section FROM part",
    "viewer_stats": _CHUNK_MANIFEST + " SELECT count(DISTINCT doc_id) AS n_docs, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'skipped') AS n_skipped, count(*) FILTER (WHERE status = 'error') AS n_error, CAST(sum(CASE WHEN status = 'ok' AND doc_id % 6 <> 0 THEN doc_id END) AS BIGINT) AS n_chunks FROM k",
    "event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "catalog_extract": f"""WITH s AS (SELECT p_size, p_partkey, {_SANITIZE.format("('•' || p_name || '*')")} AS s FROM part WHERE p_size % 7 <> 0 AND p_partkey % 3 <> 0 AND p_partkey > 0)
        SELECT p_size AS table_id, p_partkey AS row_no, upper(s[1]) || s[2:] AS name FROM s WHERE s <> '' QUALIFY row_number() OVER (PARTITION BY {_KEY.format("s")} ORDER BY p_size, p_partkey) = 1""",
    "readmit_patients": _READMIT + " SELECT id, 'admitted' AS status, status = 'admitted' AS refused FROM r",
    "readmit_exams": _READMIT
    + f""" SELECT 'ex-' || id AS id, patient_id, name, status FROM ({_EXAMS}) WHERE patient_id NOT IN (SELECT id FROM fine)
        UNION ALL SELECT 'ex-' || md5('readmission:' || id || ':' || pos), id, item, 'pending' FROM fine JOIN {_PROTOCOL_ITEMS} t(pcode, kind, pos, item) ON pcode = cid_code AND kind = 'exam'""",
    "readmit_vitals": _READMIT + " SELECT id AS patient_id, coalesce(arg_max(CAST(floor(value) AS INTEGER), (ts, event_id)), 72) AS heart_rate, '2024-02-01T00:00:00' AS recorded_at FROM fine LEFT JOIN events ON user_id = id AND event_type = 'view' GROUP BY id",
    "code_change": _MOVED
    + f""" SELECT 'sa-' || md5('cid-update:' || id || ':' || pos) AS id, id AS patient_id, item AS description FROM m JOIN {_PROTOCOL_ITEMS} t(pcode, kind, pos, item) ON pcode = 'A41.9' AND kind = 'action'
        UNION ALL SELECT 'log', id, 'Protocolo aplicado para CID A41.9' FROM m""",
    "coded_after": _MOVED + " SELECT id, CASE WHEN id IN (SELECT id FROM m) THEN 'A41.9' ELSE cid_code END AS cid_code, CASE WHEN id IN (SELECT id FROM m) THEN 'Sepse' ELSE cid_label END AS cid_label FROM p",
    "cascade_delete": """WITH g AS (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
        SELECT 'exams' AS "table", count(*) AS n FROM orders WHERE o_custkey NOT IN (FROM g) UNION ALL
        SELECT 'items', count(*) FROM events WHERE event_type IN ('purchase', 'click') AND user_id NOT IN (FROM g) UNION ALL
        SELECT 'attachments', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM g))""",
    "bulk_accept": f"SELECT id, CASE WHEN patient_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND status = 'suggested' THEN 'accepted' ELSE status END AS status FROM ({_ITEMS})",
    "upload_guard": "SELECT l_orderkey AS exam_id, 'up/' || l_partkey AS path, l_orderkey % 2 <> 0 AS refused FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "critical_results": """WITH u AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
        SELECT user_id AS id, user_id AS patient_id, event_id AS at, 'critical' AS severity, 'exam' AS category, 'doctors' AS team,
          'Resultado crítico registrado para Exame ' || user_id || ': ' || CASE WHEN event_id % 3 = 2 THEN CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) ELSE 'sem valor informado' END || '.' AS message
        FROM u WHERE event_type = 'error' AND before IS DISTINCT FROM 'error'""",
    "alert_json": _PATCHES + """, a AS (SELECT patient_id, recorded_at, 'SpO2 crítico registrado (' || spo2 || '%).' AS message FROM s WHERE spo2 < 92
        UNION ALL SELECT patient_id, recorded_at, 'Temperatura crítica registrada (' || format('{:.1f}', temp) || ' °C).' FROM s WHERE temp >= 39 OR temp < 35
        UNION ALL SELECT patient_id, recorded_at, 'Frequência cardíaca crítica registrada (' || hr || ' bpm).' FROM s WHERE hr > 120 OR hr < 45
        UNION ALL SELECT patient_id, recorded_at, 'Pressão arterial crítica registrada (' || bp || ').' FROM s WHERE sys >= 180)
        SELECT CAST(to_json({'patientId': patient_id, 'severity': 'critical', 'message': message, 'createdAt': recorded_at, 'resolved': false}) AS VARCHAR) AS body FROM a""",
}
_EMBED = (
    _CHUNKS
    + r""", t AS (SELECT doc_id * 100000 + i AS vec_id, unnest(regexp_extract_all(translate(substring(text, i * 1400 + 1, 1600), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM c
    ), h AS (SELECT vec_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS h FROM t
    ), s AS (SELECT vec_id, h % 256 AS dimension, CAST(sum(CASE WHEN h // 256 % 2 = 1 THEN -1 ELSE 1 END) AS DOUBLE) AS x FROM h GROUP BY ALL
    ), e AS (SELECT vec_id, CAST(dimension AS INTEGER) AS dimension, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS value FROM s WHERE x <> 0)"""
)
_STEMS = """WITH f AS (SELECT doc_id, CAST(coalesce(n_chars, 0) AS DOUBLE) AS mtime, coalesce(length(text), 0) AS size, NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0) AS in_run FROM documents WHERE doc_id IS NOT NULL),
    g AS (SELECT *, CAST(CASE WHEN size = 0 THEN 0 WHEN size <= 1600 THEN 1 ELSE ceil((size - 200) / 1400.0) END AS BIGINT) AS n FROM f)"""
SQL |= {
    "chunk_embeddings": _EMBED + " SELECT (vec_id // 100000) || ':' || (vec_id % 100000) AS chunk_id, dimension, round(value, 6) AS value FROM e",
    "embed_store": _STEMS + " SELECT CAST(doc_id AS VARCHAR) AS source_stem, CASE WHEN n > 0 THEN 'embedded' ELSE 'skipped_empty' END AS status, n AS embedded_count, mtime AS chunks_mtime_unix, n AS n_vectors, n AS n_ids, in_run FROM g",
    "embed_rerun": _STEMS + " SELECT 2 AS run, count(*) FILTER (WHERE in_run) AS documents, CAST(sum(n) AS BIGINT) AS vectors FROM g UNION ALL SELECT 3, 0, CAST(sum(n) AS BIGINT) FROM g",
    "chunk_knn": _EMBED
    + """, v AS (SELECT doc_id * 100000 + i AS vec_id, coalesce((SELECT sum(value * value) FROM e WHERE e.vec_id = doc_id * 100000 + i), 0) AS n2 FROM c
    ), q AS (SELECT * FROM v WHERE vec_id % 5000000 = 0
    ), dots AS (SELECT a.vec_id AS q_id, b.vec_id, sum(a.value * b.value) AS dot FROM e a JOIN e b ON a.dimension = b.dimension AND a.vec_id % 5000000 = 0 GROUP BY ALL
    ), r AS (SELECT q.vec_id AS query_id, v.vec_id, q.n2 + v.n2 - 2 * coalesce(dot, 0) AS distance FROM q JOIN v ON v.vec_id <> q.vec_id LEFT JOIN dots ON dots.q_id = q.vec_id AND dots.vec_id = v.vec_id
    ), k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, distance FROM r)
    SELECT query_id, rank, round(abs(distance), 6) AS distance FROM k WHERE rank <= 4""",
    "readmission_history": _READMIT
    + f""", x AS (SELECT patient_id AS id, count(*) AS n FROM ({_EXAMS}) GROUP BY 1), i AS (SELECT patient_id AS id, count(*) AS n FROM ({_ITEMS}) GROUP BY 1),
        l AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
        v AS (SELECT user_id AS id, count(*) AS n, arg_max(CAST(floor(value) AS INTEGER), (ts, 'vs-' || event_id)) AS hr FROM events WHERE event_type = 'view' GROUP BY 1),
        c AS (SELECT pcode, count(*) FILTER (WHERE kind = 'exam') AS n_exams, count(*) FILTER (WHERE kind = 'action') AS n_items FROM {_PROTOCOL_ITEMS} t(pcode, kind, pos, item) GROUP BY 1),
        b AS (SELECT p.*, coalesce(x.n, 0) AS n_exams, coalesce(i.n, 0) AS n_items, coalesce(l.n, 0) AS n_log, coalesce(v.n, 0) AS n_vitals, hr, p.id IN (SELECT id FROM fine) AS moved
          FROM p LEFT JOIN x USING (id) LEFT JOIN i USING (id) LEFT JOIN l USING (id) LEFT JOIN v USING (id))
        SELECT 0 AS moment, id, status, '2023-12-01T00:00:00' AS admitted_at, n_exams, n_items, n_log, n_vitals, hr AS heart_rate FROM b UNION ALL
        SELECT 1, id, CASE WHEN moved THEN 'admitted' ELSE status END, CASE WHEN moved THEN '2024-02-01T00:00:00' ELSE '2023-12-01T00:00:00' END, CASE WHEN moved THEN c.n_exams ELSE b.n_exams END,
          CASE WHEN moved THEN c.n_items ELSE b.n_items END, n_log + moved::INT, n_vitals + moved::INT, CASE WHEN moved THEN coalesce(hr, 72) ELSE hr END FROM b LEFT JOIN c ON pcode = cid_code""",
    "state_at_times": """WITH c AS (SELECT user_id, event_type, value, epoch_us(ts) AS at_us FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1
        ), a AS (SELECT event_id, user_id, epoch_us(ts) + 1800000000 AS asked_us FROM events WHERE event_id % 7 = 0 AND ts IS NOT NULL)
        SELECT a.event_id, a.user_id, asked_us, CASE WHEN c.event_type <> 'purchase' THEN c.event_type END AS event_type, CASE WHEN c.event_type <> 'purchase' THEN c.value END AS value
        FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND asked_us >= at_us""",
}
_MARK = "(SELECT max(epoch_ms(ts)) - 600000 FROM events)"
SQL |= {
    "stream_ordered_results": f"""WITH u AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE epoch_ms(ts) <= {_MARK})
        SELECT user_id AS id, user_id AS patient_id, epoch_us(ts) AS at_us, event_id AS seq, 'critical' AS severity, 'exam' AS category, 'doctors' AS team,
          'Resultado crítico registrado para Exame ' || user_id || ': ' || CASE WHEN event_id % 3 = 2 THEN CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) ELSE 'sem valor informado' END || '.' AS message
        FROM u WHERE event_type = 'error' AND before IS DISTINCT FROM 'error'""",
    "stream_windows": f"SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_ms(max(date_trunc('hour', ts))) + 3600000 <= {_MARK}",
    "stream_sessions": f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000, true) AS first FROM events),
        s AS (SELECT user_id, t, sum(first::INT) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
        SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING (max(t) + 1800000000) // 1000 <= {_MARK}""",
}
SQL["stream_vital_alerts"] = SQL["vital_alerts"]
SQL["stream_critical_results"] = SQL["critical_results"]
