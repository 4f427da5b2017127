"""The same answers in plain SQL, written from the definitions and run over the same files."""

_WS = r"[ \t\n\r\f\x0B]"

# one row per well-formed table: its rows of cells, and the edits with a known distance
_GRIDS = """
src AS (
  SELECT doc_id * 3 AS sample_id, doc_id AS k, '' AS head,
         list_transform(string_split(text, chr(10)), lambda l: [l]) AS cells, 'img' || md5(text) AS img
  FROM documents
  UNION ALL
  SELECT o_orderkey * 3 + 1, o_orderkey, '<tr><th>part</th><th>qty</th><th>flag</th></tr>',
         list_transform(range(1, o_orderkey % 6 + 2), lambda i:
           [CAST(o_custkey + i AS VARCHAR), CAST((o_orderkey * 7 + i * 3) % 50 AS VARCHAR), o_orderstatus]),
         'img' || o_custkey
  FROM orders),
grids AS (
  SELECT *, list_transform(cells, lambda c: '<tr><td>' || array_to_string(c, '</td><td>') || '</td></tr>') AS body
  FROM src),
tabs AS (SELECT *, '<table>' || head || array_to_string(body, '') || '</table>' AS tb FROM grids)"""

_SAMPLES = _GRIDS + """,
samples AS (
  SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN 'validation' ELSE 'train' END AS split, html_table, image FROM (
    SELECT sample_id, CASE k % 10
        WHEN 0 THEN tb
        WHEN 1 THEN '```html' || chr(10) || tb || chr(10) || '```'
        WHEN 2 THEN '<html><body>' || tb || '</body></html>'
        WHEN 3 THEN ' ```HTML' || chr(10) || '<HTML> <Body>' || tb || '</BODY>' || chr(10) || '</html> ```  '
        WHEN 4 THEN chr(10) || tb || chr(10)
        WHEN 5 THEN replace(tb, '</table>', '')
        WHEN 7 THEN '<div>no grid here</div>'
        WHEN 8 THEN '<table>'
        WHEN 9 THEN tb || tb END AS html_table,
      CASE WHEN k % 20 <> 9 THEN img END AS image
    FROM tabs
    UNION ALL
    SELECT page_id * 3 + 2, html, 'img' || page_id FROM pages))"""

_PREDS = """,
preds AS (
  SELECT sample_id, stage, pred_html, CASE WHEN pred_html IS NULL THEN 'generation failed' END AS error FROM (
    SELECT sample_id, k, 'pre' AS stage, CASE k % 5
        WHEN 0 THEN tb
        WHEN 1 THEN '<table>' || head || array_to_string(body[1:greatest(len(body) - 1 - k % 3, 0)], '') || '</table>'
        WHEN 2 THEN replace_first.a || '<td>9' || replace_first.b
        WHEN 3 THEN replace_first.a || '<td colspan="2">' || replace_first.b END AS pred_html
    FROM (SELECT *, {'a': left(tb, strpos(tb, '<td>') - 1), 'b': substr(tb, strpos(tb, '<td>') + 4)} AS replace_first
          FROM tabs)
    UNION ALL
    SELECT sample_id, k, 'post', CASE WHEN k % 5 <> 4 THEN tb END FROM tabs)
  WHERE k % 13 <> 5 AND NOT (k % 11 = 3 AND stage = 'pre'))"""


def _stripped(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _cleaned(c: str) -> str:
    """One wrapper after the other, as the rule is stated."""
    c = _stripped(c)
    for pattern in (f"^```(?:html)?{_WS}*", f"{_WS}*```$", f"^<html>{_WS}*", f"{_WS}*</html>$",
                    f"^<body>{_WS}*", f"{_WS}*</body>$"):
        c = f"regexp_replace({c}, '{pattern}', '', 'i')"
    return _stripped(c)


def _times(c: str, tag: str) -> str:
    return f"CAST((length(lower({c})) - length(replace(lower({c}), '{tag}', ''))) / {len(tag)} AS INTEGER)"


_JUDGED = _SAMPLES + f""",
cleaned AS (SELECT *, {_cleaned('html_table')} AS c FROM samples),
judged AS (
  SELECT *, CASE
    WHEN html_table IS NULL OR length({_stripped('html_table')}) < 10 THEN 'too_short_raw'
    WHEN strpos(lower(c), '<table') = 0 THEN 'no_table'
    WHEN {_times('c', '<table')} <> {_times('c', '</table>')} THEN 'unbalanced'
    WHEN length(c) NOT BETWEEN 20 AND 50000 THEN 'length_out_of_range'
    WHEN image IS NULL THEN 'no_image' END AS reason
  FROM cleaned),
valid AS (SELECT sample_id, split, c AS html_table, image FROM judged WHERE reason IS NULL)"""

_SCORED = _JUDGED + _PREDS + """,
sizes AS (
  SELECT sample_id, k, len(body) AS n, len(cells[1]) + 1 AS per_row, length(cells[1][1]) AS first_len,
         1 + (len(cells[1]) + 1) * (len(body) + CASE WHEN head = '' THEN 0 ELSE 1 END) AS nodes
  FROM tabs),
asked AS (
  SELECT v.sample_id, s.stage, coalesce(p.error, CASE WHEN p.pred_html IS NULL THEN 'no prediction' END) AS error
  FROM valid v JOIN (VALUES ('pre'), ('post')) s(stage) ON true
    LEFT JOIN preds p ON p.sample_id = v.sample_id AND p.stage = s.stage),
scored AS (
  SELECT p.sample_id, p.stage, p.error,
    CASE WHEN p.error IS NOT NULL THEN NULL
         WHEN p.stage = 'post' OR k % 5 IN (0, 2) THEN 1.0
         WHEN k % 5 = 1 THEN 1.0 - per_row * least(n, 1 + k % 3) / CAST(nodes AS DOUBLE)
         ELSE 1.0 - 1.0 / CAST(nodes AS DOUBLE) END AS s,
    CASE WHEN p.error IS NULL AND p.stage = 'pre' AND k % 5 = 2 THEN 1.0 - (1.0 / CAST(first_len + 1 AS DOUBLE)) / CAST(nodes AS DOUBLE)
         END AS f
  FROM asked p JOIN sizes USING (sample_id)),
scores AS (SELECT sample_id, stage, CAST(s AS DOUBLE) AS teds_structure, CAST(coalesce(f, s) AS DOUBLE) AS teds_full,
                  error FROM scored)"""

_NODES = _GRIDS + """,
held AS (SELECT * FROM tabs WHERE k % 10 NOT IN (6, 7)),
all_rows AS (
  SELECT sample_id, 0 AS r, ['part', 'qty', 'flag'] AS cs, 'th' AS tag FROM held WHERE head <> '' AND k % 10 <> 8
  UNION ALL
  SELECT sample_id, unnest(range(len(cells))) + CASE WHEN head = '' THEN 0 ELSE 1 END, unnest(cells), 'td'
  FROM held WHERE k % 10 <> 8),
cell_rows AS (SELECT *, 1 + r * (len(cs) + 1) AS tr FROM all_rows)"""

_NODE_ROWS = """
SELECT sample_id, 0 AS node_id, -1 AS parent, 0 AS depth, 'table' AS tag, 1 AS colspan, 1 AS rowspan,
       CAST(NULL AS VARCHAR) AS text FROM held
UNION ALL SELECT sample_id, tr, 0, 1, 'tr', 1, 1, NULL FROM cell_rows
UNION ALL SELECT sample_id, tr + j, tr, 2, tag, 1, 1, CASE WHEN tag = 'td' THEN t END
FROM (SELECT sample_id, tr, tag, unnest(range(1, len(cs) + 1)) AS j, unnest(cs) AS t FROM cell_rows)"""

_ENCODED = """
raw AS (
  SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS failed,
    list_transform(range(1, o_orderkey % 40 + 2), lambda i: CASE WHEN i = 1 AND o_orderkey % 50 = 0 THEN -1
      ELSE (o_orderkey * 7919 + i * 104729) % 152100 END) AS ids FROM orders),
encoded AS (
  SELECT k AS sample_id, CASE WHEN k % 7 = 0 THEN 'validation' ELSE 'train' END AS split,
    CASE WHEN k % 10 <> 6 THEN '<table>' || k || '</table>' END AS html_table,
    CASE WHEN NOT failed THEN ids END AS input_ids,
    CASE WHEN NOT failed THEN list_transform(ids, lambda x, i: CASE WHEN i <= k % 5 THEN -100 ELSE x END) END AS labels,
    CASE WHEN failed THEN 'Encoding failed: key ' || k END AS error
  FROM raw)"""

_CLAMP = "(x >= 151743 AND x <> 151900)"

_RANGED = _ENCODED + """,
ranged AS (
  SELECT * REPLACE (coalesce(error,
    CASE WHEN list_min(input_ids) < 0 OR list_max(input_ids) >= 151643 THEN 'Invalid input_ids: range ['
      || list_min(input_ids) || ', ' || list_max(input_ids) || '] vs vocab_size 151643' END,
    CASE WHEN list_min(list_filter(labels, lambda x: x <> -100)) < 0
           OR list_max(list_filter(labels, lambda x: x <> -100)) >= 151643 THEN 'Invalid labels: range ['
      || list_min(list_filter(labels, lambda x: x <> -100)) || ', '
      || list_max(list_filter(labels, lambda x: x <> -100)) || '] vs vocab_size 151643' END) AS error)
  FROM encoded),
statuses AS (
  SELECT *, CASE WHEN html_table IS NULL OR trim(html_table) = '' THEN 'empty_html' WHEN error IS NOT NULL THEN 'bad_tokens'
    WHEN len(input_ids) > 30 THEN 'too_long' ELSE 'valid' END AS status FROM ranged)"""

_LOG = """
log AS (SELECT user_id AS run_id, event_id AS step, ts, value AS loss FROM events)"""

_OCR = _SAMPLES + """,
top AS (
  SELECT row_number() OVER (ORDER BY length(html_table) DESC, sample_id) - 1 AS row_index,
         length(html_table) AS html_table_length, html_table AS ground_truth_html, image
  FROM samples WHERE html_table IS NOT NULL QUALIFY row_index < 20),
ocr AS (
  SELECT row_index, html_table_length, ground_truth_html,
    CASE WHEN image IS NULL THEN 'Error: no table in None'
         WHEN right(image, 1) IN ('4', '9') THEN 'Error: no table in ' || image
         ELSE '```html' || chr(10) || '<table><tr><td>' || image || '</td></tr></table>' || chr(10) || '```'
    END AS ocr_result
  FROM top)"""

_FAILS = "(image IS NULL OR right(image, 1) IN ('4', '9'))"
_ANSWER = "'<table><tr><td>' || image || '</td></tr></table>'"
_FENCED = "'```html' || chr(10) || " + _ANSWER + " || chr(10) || '```'"
_ERROR = f"CASE WHEN {_FAILS} THEN 'no table in ' || coalesce(image, 'None') END"

_TURNS = """
turns AS (SELECT * FROM conversations)"""

_PATHS = """
paths AS (
  SELECT '/img/' || source || '/d' || doc_id ||
    (['.jpg', '.JPEG', '.png', '.bmp', '.tiff', '.webp', '.txt', '.gif', ''])[doc_id % 9 + 1] AS path,
    'd' || doc_id AS stem,
    (['.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.webp', '.txt', '.gif', ''])[doc_id % 9 + 1] AS suffix, doc_id, lang
  FROM documents)"""


def _sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def _hashed(rows: str, seed: int) -> str:
    return f"row_number() OVER (ORDER BY md5('{seed}:' || sample_id), sample_id) - 1 AS position, count(*) OVER () AS n FROM {rows}"


_TOP20 = """
SELECT row_number() OVER (ORDER BY length(html_table) DESC, sample_id) AS rank, sample_id, html_table,
       length(html_table) AS html_length FROM valid QUALIFY rank <= 20"""
_NAME = "lpad(CAST({0} AS VARCHAR), CAST(greatest(2, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"
_RANK = _NAME.format("rank")


def _messages(*parts: tuple) -> str:
    """(turn, role, part, type, text, image) rows of every sample."""
    return "\nUNION ALL ".join(
        f"SELECT sample_id, {turn} AS turn, '{role}' AS role, {part} AS part, '{kind}' AS type, {text} AS text,"
        f" {image} AS image FROM samples" for turn, role, part, kind, text, image in parts)


def _flat(prompt: str) -> str:
    return (f"SELECT sample_id, image, 0 AS turn, 'user' AS role, {prompt} AS content FROM samples UNION ALL "
            "SELECT sample_id, image, 1, 'assistant', html_table FROM samples")


_TEXT_NULL = "CAST(NULL AS VARCHAR)"
_INSTRUCTION = "'Transcribe the pictured grid as markup.'"

ORACLE: dict[str, str] = {
    "load_split": _sql(_SAMPLES, "SELECT * FROM samples WHERE split = 'validation'"),
    "load_all_splits": _sql(_SAMPLES, "SELECT sample_id, split, length(html_table) AS html_length FROM samples"),
    "sample_n": _sql(_SAMPLES, "SELECT sample_id, split FROM samples ORDER BY md5('42:' || sample_id), sample_id LIMIT 5000"),
    "scan_image_folder": _sql(_PATHS, """
        SELECT regexp_extract(path, '[^/]+$') AS file, octet_length(encode(text)) AS length
        FROM paths JOIN documents USING (doc_id) WHERE doc_id % 9 < 6"""),
    "export_samples": _sql(_JUDGED, f"""
        SELECT rank, sample_id, 'sample_' || {_RANK} || '.png' AS image_file, 'sample_' || {_RANK} || '.html' AS html_file,
               html_length FROM ({_TOP20})"""),
    "export_predictions": _sql(_JUDGED + _PREDS, f"""
        SELECT stage, rank, 'sample_' || {_RANK} || '_pred.html' AS html_file, pred_html
        FROM ({_TOP20}) JOIN preds USING (sample_id) WHERE pred_html IS NOT NULL"""),
    "ocr_job": _sql(_OCR, "SELECT * FROM ocr"),
    "export_ocr_pairs": _sql(_OCR, f"""
        SELECT row_index, side, CASE side WHEN 'ground_truth' THEN ground_truth_html ELSE ocr_result END AS html,
               'row_' || {_NAME.format('(row_index + 1)')} || '_' || side || '.html' AS html_file
        FROM ocr JOIN (VALUES ('ground_truth'), ('ocr_result')) t(side) ON NOT starts_with(ocr_result, 'Error')"""),
    "ocr_summary": _sql(_OCR, """
        SELECT row_index, html_table_length, CASE WHEN starts_with(ocr_result, 'Error') THEN 'error' ELSE 'success' END AS status,
               CASE WHEN starts_with(ocr_result, 'Error') THEN ocr_result END AS error_message FROM ocr"""),
    "success_count": _sql(_SAMPLES, f"""
        SELECT count(*) FILTER (NOT {_FAILS}) AS n_success, count(*) AS n_total FROM samples WHERE html_table IS NOT NULL"""),
    "status_split": _sql(_SAMPLES, f"""
        SELECT CASE WHEN {_FAILS} THEN 'error' ELSE 'success' END AS status, count(*) AS n
        FROM samples WHERE html_table IS NOT NULL GROUP BY 1"""),
    "append_metrics": """
        WITH log AS (SELECT user_id AS run_id, event_id AS step, value AS loss FROM events WHERE event_type <> 'purchase'),
        evals AS (SELECT user_id AS run_id, event_id AS step, value / 1000 AS avg_full, event_id % 10 + 1 AS n_evaluated
                  FROM events WHERE event_type = 'purchase'),
        placed AS (SELECT e.*, (SELECT max(l.step) FROM log l WHERE l.run_id = e.run_id AND l.step <= e.step) AS log_step FROM evals e),
        latest AS (SELECT * FROM placed WHERE log_step IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY run_id, log_step ORDER BY step DESC) = 1)
        SELECT l.run_id, l.step, l.loss, round(m.avg_full, 6) AS avg_full, m.n_evaluated
        FROM log l LEFT JOIN latest m ON m.run_id = l.run_id AND m.log_step = l.step""",

    "clean_html": _sql(_SAMPLES, f"SELECT sample_id, {_cleaned('html_table')} AS cleaned FROM samples"),
    "clean_html_inline": _sql(_GRIDS + _PREDS, f"SELECT sample_id, stage, {_cleaned('pred_html')} AS cleaned FROM preds"),
    "strip_prediction": _sql(_SAMPLES, f"SELECT sample_id, {_stripped('html_table')} AS stripped FROM samples"),
    "truncate_html": _sql(_SAMPLES, """
        SELECT sample_id, CASE WHEN length(html_table) > 8000 THEN left(html_table, 8000) || '...' ELSE html_table END AS html_table
        FROM samples"""),
    "truncate_html_tiered": _sql(_SAMPLES, """
        SELECT sample_id, CASE WHEN length(html_table) > n THEN left(html_table, n) || '...' ELSE html_table END AS html_table
        FROM (SELECT *, CASE sample_id % 3 WHEN 0 THEN 4000 WHEN 1 THEN 6000 ELSE 8000 END AS n FROM samples)"""),
    "char_length": _sql(_SAMPLES, "SELECT sample_id, length(html_table) AS html_length FROM samples"),
    "preview": _sql(_SAMPLES, "SELECT sample_id, left(html_table, 200) || '...' AS preview FROM samples"),
    "count_table_tags": _sql(_SAMPLES, f"""
        SELECT sample_id, {_times('html_table', '<table')} AS n_open, {_times('html_table', '</table>')} AS n_close FROM samples"""),
    "sample_file_name": _sql(_SAMPLES, f"SELECT sample_id, 'sample_' || {_NAME.format('sample_id')} || '.html' AS html_file FROM samples"),
    "path_stem_suffix": _sql(_PATHS, "SELECT path, stem, suffix FROM paths"),
    "to_parts_messages": _sql(_SAMPLES, _messages(
        (0, "user", 0, "text", _INSTRUCTION, _TEXT_NULL), (0, "user", 1, "image", _TEXT_NULL, "image"),
        (1, "assistant", 0, "text", "html_table", _TEXT_NULL))),
    "to_flat_messages": _sql(_SAMPLES, _flat("'Give the markup of the grid in the picture.'")),
    "to_flat_messages_batch": _sql(_SAMPLES, _flat("'<image>' || chr(10) || 'Transcribe the grid.'")),
    "to_prompt_messages": _sql(_SAMPLES, _messages(
        (0, "system", 0, "text", "'You transcribe pictures of grids.'", _TEXT_NULL),
        (1, "user", 0, "image", _TEXT_NULL, "image"), (1, "user", 1, "text", _INSTRUCTION, _TEXT_NULL))),
    "prompt_turn": _sql(_TURNS, "SELECT conv_id, role, text AS content FROM turns WHERE turn = 0"),
    "ground_truth_of": _sql(_TURNS, """
        SELECT conv_id, coalesce(max(CASE WHEN turn = 1 THEN text END), '') AS truth FROM turns GROUP BY conv_id"""),

    "truncate_tokens": _sql(_ENCODED, """
        SELECT sample_id, array_to_string(input_ids[1:20], ',') AS input_ids, CASE WHEN input_ids IS NOT NULL THEN least(len(input_ids), 20) END AS attention,
               len(input_ids) > 20 AS was_cut FROM encoded"""),
    "strip_prompt_tokens": _sql(_ENCODED, "SELECT sample_id, array_to_string(input_ids[6:], ',') AS generated FROM encoded"),
    "clamp_token_ids": _sql(_ENCODED, f"""
        SELECT sample_id, array_to_string(list_transform(input_ids, lambda x: CASE WHEN {_CLAMP} THEN 0 ELSE x END), ',') AS input_ids
        FROM encoded"""),
    "clamp_labels": _sql(_ENCODED, f"""
        SELECT sample_id, array_to_string(list_transform(labels, lambda x: CASE WHEN {_CLAMP} THEN 0 ELSE x END), ',') AS labels
        FROM encoded"""),
    "clamp_counts": _sql(_ENCODED, f"""
        SELECT sample_id, len(list_filter(input_ids, lambda x: {_CLAMP})) AS n_clamped,
               len(list_filter(input_ids, lambda x: x >= 151643 AND NOT {_CLAMP})) AS n_preserved
        FROM encoded"""),
    "validate_token_range": _sql(_RANGED, "SELECT sample_id, error FROM ranged"),
    "error_type": _sql(_RANGED, "SELECT sample_id, split_part(error, ':', 1) AS error_type FROM ranged"),
    "safe_filter": _sql(_RANGED, "SELECT sample_id, split, html_table FROM statuses WHERE status = 'valid'"),
    "error_histogram": _sql(_RANGED, """
        SELECT split_part(error, ':', 1) AS error_type, count(*) AS n FROM statuses WHERE status = 'bad_tokens' GROUP BY 1"""),
    "first_errors": _sql(_RANGED, """
        SELECT sample_id, error FROM (SELECT * FROM statuses WHERE status <> 'valid' ORDER BY sample_id LIMIT 5)
        WHERE status = 'bad_tokens'"""),
    "filter_token_length": _sql(_ENCODED, "SELECT sample_id, len(input_ids) AS n_tokens FROM encoded WHERE len(input_ids) <= 20"),
    "filter_encodable": _sql(_ENCODED, """
        SELECT sample_id, split, html_table FROM encoded WHERE error IS NULL AND len(input_ids) <= 30"""),
    "audit_clamped": _sql(_ENCODED, "SELECT count(*) AS n_rows, 0 AS n_bad FROM encoded"),
    "zip_arrays": _sql(_ENCODED, """
        SELECT sample_id, 0 AS at, array_to_string(input_ids[4:], ',') AS generated FROM encoded
        UNION ALL
        SELECT sample_id, 1, array_to_string(input_ids[2:], ',') FROM encoded"""),

    "valid_html": _sql(_JUDGED, "SELECT sample_id, reason IS NULL AS valid FROM judged"),
    "reject_reason": _sql(_JUDGED, "SELECT sample_id, reason FROM judged"),
    "filter_and_clean": _sql(_JUDGED, "SELECT * FROM valid"),
    "not_null_html": _sql(_SAMPLES, "SELECT sample_id, split FROM samples WHERE html_table IS NOT NULL"),
    "filter_rows": _sql(_SAMPLES, "SELECT sample_id, split FROM samples WHERE contains(html_table, '<td>') AND image IS NOT NULL"),
    "filter_char_length": _sql(_SAMPLES, "SELECT sample_id, html_table FROM samples WHERE length(html_table) <= 300"),
    "nonblank_pair": _sql(_SAMPLES + _PREDS, f"""
        SELECT sample_id, stage FROM samples JOIN preds USING (sample_id)
        WHERE {_stripped('html_table')} <> '' AND {_stripped('pred_html')} <> ''"""),
    "require_non_empty": _sql(_JUDGED, "SELECT count(*) AS n FROM valid"),
    "filter_report": _sql(_JUDGED, """
        SELECT split, count(*) AS original, count(*) FILTER (reason IS NULL) AS kept,
               count(*) FILTER (reason IS NOT NULL) AS removed,
               round(count(*) FILTER (reason IS NULL) / count(*) * 100, 2) AS kept_pct
        FROM judged GROUP BY split"""),
    "reject_histogram": _sql(_JUDGED, "SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason"),
    "split_report": _sql(_SAMPLES, """
        SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM samples) * 100, 1) AS pct FROM samples GROUP BY split"""),
    "size_before_after": _sql(_SAMPLES, """
        SELECT split, count(*) AS n_before, count(*) FILTER (length(html_table) <= 300) AS n_after FROM samples GROUP BY split"""),
    "training_step_plan": _sql(_SAMPLES, """
        SELECT split, n, batch, accum, devices, epochs, n // (batch * accum * devices) AS steps_per_epoch,
               (n * epochs) // (batch * accum * devices) AS total_steps
        FROM (SELECT split, count(*) AS n FROM samples GROUP BY split)
        JOIN (VALUES (1, 4, 1, 6), (1, 8, 1, 1), (2, 4, 4, 3)) t(batch, accum, devices, epochs) ON true"""),

    "train_val_split": _sql(_JUDGED, f"""
        SELECT sample_id, CASE WHEN position < (n * 85) // 100 THEN 'train' ELSE 'validation' END AS split
        FROM (SELECT sample_id, {_hashed('valid', 3407)})"""),
    "ratio_split": _sql(_SAMPLES, f"""
        SELECT sample_id, CASE WHEN position < (n * 99) // 100 THEN 'train' ELSE 'validation' END AS split
        FROM (SELECT sample_id, {_hashed('samples', 42)})"""),
    "seeded_shuffle": _sql(_SAMPLES, f"SELECT sample_id, position FROM (SELECT sample_id, {_hashed('samples', 3407)})"),
    "assign_training_batches": _sql(_SAMPLES, f"""
        SELECT sample_id, position, position // 8 AS micro_batch, position // 32 AS step, position % 4 AS worker
        FROM (SELECT sample_id, {_hashed('samples', 42)}) WHERE position < n // 8 * 8"""),
    "first_n_eval": _sql(_JUDGED, "SELECT sample_id, html_table FROM valid ORDER BY sample_id LIMIT 10"),
    "tiered_eval_sample": _sql(_SAMPLES, "SELECT sample_id, split FROM samples ORDER BY sample_id LIMIT 100"),
    "topk_longest": _sql(_JUDGED, f"SELECT sample_id, html_length, html_table FROM ({_TOP20})"),
    "topk_ranked": _sql(_JUDGED, f"""
        SELECT rank, sample_id, 'sample_' || {_RANK} || '.png' AS image_file, 'sample_' || {_RANK} || '.html' AS html_file,
               html_length FROM ({_TOP20})"""),

    "log_throughput": _sql(_LOG, """
        SELECT run_id, step, round((step - lag(step) OVER w) * 4 / ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6), 6)
               AS samples_per_sec
        FROM log WHERE step % 10 = 0 WINDOW w AS (PARTITION BY run_id ORDER BY step)"""),
    "eval_cadence": _sql(_LOG, "SELECT run_id, step, loss FROM log WHERE step % 10 = 0 AND step > 0"),
    "gated_cadence": _sql(_LOG, """
        SELECT run_id, step, CASE WHEN step >= 50 THEN 'evaluate' ELSE 'skip' END AS action FROM log
        WHERE step % 10 = 0 AND step > 0"""),
    "elapsed_minutes": _sql(_LOG, """
        SELECT run_id, step, loss, minutes FROM (
          SELECT *, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id)) / 6e7, 6) AS minutes FROM log)
        WHERE step % 10 = 0"""),
    "ema_smooth": _sql(_LOG, """
        SELECT i.run_id, i.step, i.loss, round(sum(power(0.9, i.p - j.p) * j.loss) / sum(power(0.9, i.p - j.p)), 6) AS smoothed
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS p FROM log) i
        JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS p FROM log) j
          ON j.run_id = i.run_id AND j.p <= i.p
        GROUP BY ALL"""),
    "best_checkpoint": _sql(_LOG, """
        SELECT run_id, step, loss FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loss, step) = 1"""),
    "retained_checkpoints": _sql(_LOG, """
        SELECT run_id, step, loss, b = 1 AS is_best FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r,
                 row_number() OVER (PARTITION BY run_id ORDER BY loss, step) AS b
          FROM log WHERE step % 5 = 0 AND step > 0) WHERE r <= 3 OR b = 1"""),
    "progress_marks": _sql(_JUDGED, """
        SELECT processed, valid FROM (
          SELECT row_number() OVER (ORDER BY sample_id) AS processed,
                 sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY sample_id) AS valid FROM judged)
        WHERE processed % 1000 = 0"""),

    "pair_predictions": _sql(_JUDGED + _PREDS, """
        SELECT sample_id, html_table, stage, pred_html, error FROM valid LEFT JOIN preds USING (sample_id)"""),
    "compare_stages": _sql(_SCORED, """
        SELECT sample_id, pred_html_pre, pred_html_post, score_delta FROM (
          SELECT sample_id, max(pred_html) FILTER (stage = 'pre') AS pred_html_pre,
                 max(pred_html) FILTER (stage = 'post') AS pred_html_post FROM preds GROUP BY sample_id)
        LEFT JOIN (
          SELECT sample_id, round(max(teds_full) FILTER (stage = 'post') - max(teds_full) FILTER (stage = 'pre'), 6) AS score_delta
          FROM scores GROUP BY sample_id) USING (sample_id)"""),
    "pair_by_stem": _sql(_PATHS, """
        SELECT stem, '/html/' || stem || '.html' AS html_path, path AS image_path FROM paths WHERE doc_id % 9 < 6"""),
    "batch_predict": _sql(_SAMPLES, f"""
        SELECT sample_id, 'pre' AS stage, CASE WHEN NOT {_FAILS} THEN {_ANSWER} END AS pred_html, {_ERROR} AS error FROM samples"""),
    "eval_predict": _sql(_SAMPLES, f"""
        SELECT sample_id, 'eval' AS stage, CASE WHEN {_FAILS} THEN '' ELSE {_FENCED} END AS pred_html, {_ERROR} AS error FROM samples"""),
    "dedup_predict": _sql(_SAMPLES, f"""
        SELECT sample_id, 'pre' AS stage, CASE WHEN NOT {_FAILS} THEN {_ANSWER} END AS pred_html, {_ERROR} AS error FROM samples"""),
    "tokenize": _sql(_SAMPLES, """
        SELECT sample_id, len(w) AS n_tokens, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS sum_ids,
               CASE WHEN w IS NULL THEN 'Encoding failed: no text' END AS error
        FROM (SELECT sample_id, string_split(html_table, ' ') AS w FROM samples)"""),
    "map_rows": _sql(_SAMPLES, "SELECT sample_id, coalesce(length(html_table), -1) AS n_chars FROM samples"),

    "shred_table": _sql(_NODES, _NODE_ROWS),
    "teds_structure": _sql(_SCORED, "SELECT sample_id, stage, round(teds_structure, 6) AS teds_structure FROM scores"),
    "teds_full": _sql(_SCORED, "SELECT sample_id, stage, round(teds_full, 6) AS teds_full FROM scores"),
    "eval_table": _sql(_SCORED, """
        SELECT sample_id, stage, round(teds_structure, 6) AS teds_structure, round(teds_full, 6) AS teds_full, error FROM scores"""),
    "teds_avg_zero_policy": _sql(_SCORED, """
        SELECT round(avg(coalesce(teds_structure, 0)), 6) AS avg_structure, round(avg(coalesce(teds_full, 0)), 6) AS avg_full,
               count(*) AS n_evaluated FROM scores"""),
    "teds_avg_skip_policy": _sql(_SCORED, """
        SELECT round(avg(teds_structure), 6) AS avg_structure, round(avg(teds_full), 6) AS avg_full,
               count(teds_full) AS n_evaluated FROM scores"""),
    "predict_and_score": _sql(_JUDGED, f"""
        SELECT 'echo' AS stage, round(avg(CASE WHEN {_FAILS} THEN 0.0 ELSE 1.0 END), 6) AS avg_structure,
               round(avg(CASE WHEN {_FAILS} THEN 0.0 ELSE 1.0 END), 6) AS avg_full, count(*) AS n_evaluated FROM valid"""),
    "eval_by_stage": _sql(_SCORED, """
        SELECT stage, round(avg(coalesce(teds_structure, 0)), 6) AS avg_structure,
               round(avg(coalesce(teds_full, 0)), 6) AS avg_full, count(*) AS n_evaluated FROM scores GROUP BY stage"""),

    "stream_clean_filter": _sql(_JUDGED, "SELECT * FROM valid"),
    "stream_monitor_5m": _sql(_LOG, """
        SELECT CAST(epoch_us(ts) // 300000000 * 300 AS BIGINT) AS window_start, count(*) AS n, round(sum(loss), 4) AS sum_loss,
               max(step) AS max_step FROM log GROUP BY 1"""),
    "stream_dedup": """
        SELECT CASE WHEN NOT fails THEN '<table><tr><td>' || image || '</td></tr></table>' END AS pred_html,
               CASE WHEN fails THEN 'no table in ' || image END AS error, count(*) AS n
        FROM (SELECT image, right(image, 1) IN ('4', '9') AS fails
              FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS image, event_type, props FROM events))
        GROUP BY ALL""",
}
ORACLE["stream_throughput"] = ORACLE["log_throughput"]
ORACLE["stream_eval_avg"] = ORACLE["eval_by_stage"]
ORACLE["observed_filter_report"] = ORACLE["stream_filter_report"] = ORACLE["filter_report"]

# column types as the engine gives them, where SQL's own choice is wider or narrower
_TYPES = {
    "INTEGER": {
        "load_all_splits": "html_length", "char_length": "html_length", "topk_longest": "html_length",
        "export_samples": "rank html_length", "topk_ranked": "rank html_length", "export_predictions": "rank",
        "ocr_job": "row_index html_table_length", "ocr_summary": "row_index html_table_length",
        "export_ocr_pairs": "row_index", "truncate_tokens": "attention", "clamp_counts": "n_clamped n_preserved",
        "filter_token_length": "n_tokens", "tokenize": "n_tokens", "shred_table": "node_id parent",
    },
    "BIGINT": {
        "audit_clamped": "n_bad", "training_step_plan": "batch accum devices epochs", "progress_marks": "valid",
    },
}
for _type, _columns in _TYPES.items():
    for _name, _list in _columns.items():
        _casts = ", ".join(f"CAST({c} AS {_type}) AS {c}" for c in _list.split())
        ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
