"""DuckDB SQL equivalents of the catalogue queries (the correctness oracle).

Tables are the driver's views: documents, conversations, embeddings, labels,
benchmark, ... Queries without a SQL form (model plug-ins, streams) are absent
and get a rows-only check."""
from __future__ import annotations

from tessera.functions.text import (DATASET_CHUNK_FOOTER, DATASET_CHUNK_HEADER, RULE, TERMINATOR_CLASS,
                                    WS_CLASS)
from tessera.operators.generate import ANSWER_TEMPLATE, QUESTION_MARKER, QUESTION_TEMPLATE_API, QUESTION_TEMPLATE_LOCAL, TEXT_MARKER
from tessera.plans.sqltext import (chunks_cte, clean, clean_txt, collapse, last_term_len, lit,
                                   split_sentences, trim_ws)

NL = chr(10)
ORACLE: dict[str, str] = {}

PAGES_CTE = f"""pages AS (
  SELECT doc_id, source, CAST(p AS INTEGER) AS page_num,
         CASE WHEN p % 7 = 0 THEN {lit('  ' + NL + chr(9) + ' ')} ELSE substring(text, (p - p // 7 - 1) * 2000 + 1, 2000) END AS text
  FROM (SELECT doc_id, source, text, unnest(range(1, k + k // 6 + 1)) AS p
        FROM (SELECT *, greatest(CAST(ceil(length(text) / 2000.0) AS BIGINT), 1) AS k FROM documents WHERE text IS NOT NULL)))"""

ORACLE["chunk_stats"] = f"""WITH RECURSIVE {chunks_cte("(SELECT doc_id || '|' || source AS doc_id, text FROM documents WHERE " + trim_ws('text') + " <> '')", 1000, 200)}
SELECT split_part(doc_id, '|', 2) AS source, count(*) AS n_chunks, round(avg(length(chunk)), 6) AS avg_chunk_chars,
       CAST(min(length(chunk)) AS INTEGER) AS min_chunk_chars, CAST(max(length(chunk)) AS INTEGER) AS max_chunk_chars
FROM chunks GROUP BY 1"""

ORACLE["chunk_text"] = f"WITH RECURSIVE {chunks_cte('documents', 1000, 200)} SELECT * FROM chunks"
ORACLE["chunk_blocks"] = ORACLE["chunk_text"]
ORACLE["chunk_small"] = f"WITH RECURSIVE {chunks_cte('documents', 300, 50)} SELECT * FROM chunks"
ORACLE["chunk_overlap_ge_size"] = f"WITH RECURSIVE {chunks_cte('documents', 50, 60)} SELECT * FROM chunks"

ORACLE["chunk_sentences"] = f"""WITH s AS (SELECT doc_id, {split_sentences(clean('text'))} AS s FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, s, unnest(range(0, CAST(ceil(len(s) / 5.0) AS BIGINT))) AS g FROM s)
SELECT doc_id, CAST(g AS INTEGER) AS chunk_index, trim(array_to_string(list_slice(s, g * 5 + 1, g * 5 + 5), ' ')) AS chunk FROM g"""

ORACLE["split_sentences"] = f"""WITH s AS (SELECT doc_id, {split_sentences(clean('text'))} AS s FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, s[i + 1] AS sentence FROM g"""

ORACLE["paragraphs"] = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({clean_txt('text')}, {lit(NL * 2)}), lambda z: {trim_ws('z')}), lambda z: z <> '') AS p FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, p, unnest(range(0, len(p))) AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS para_index, p[i + 1] AS text FROM g"""

ORACLE["ws_trim"] = f"SELECT doc_id, {trim_ws('text')} AS text FROM documents"
ORACLE["ws_collapse"] = f"SELECT doc_id, {collapse('text')} AS text FROM documents"
ORACLE["chunk_clean"] = f"SELECT doc_id, {clean('text')} AS text FROM documents"
ORACLE["sentence_boundary"] = f"""SELECT doc_id, CAST(CASE WHEN {last_term_len(clean('text'))} > 0 THEN {last_term_len(clean('text'))} END AS INTEGER) AS boundary FROM documents"""
ORACLE["clean_txt"] = f"SELECT doc_id, {clean_txt('text')} AS text FROM documents"

ROW_INDEX = "(row_number() OVER (ORDER BY doc_id) - 1)"
ORACLE["row_index"] = f"SELECT doc_id, {ROW_INDEX} AS real_index FROM documents"
ORACLE["slice_rows"] = f"SELECT * FROM (SELECT {ROW_INDEX} AS real_index, doc_id FROM documents) WHERE real_index >= 100"
ORACLE["valid_text"] = f"SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND {trim_ws('text')} <> ''"
ORACLE["min_length"] = f"""SELECT doc_id, CAST(length({collapse('text')}) AS INTEGER) AS n FROM documents
WHERE text IS NOT NULL AND {trim_ws('text')} <> '' AND length({collapse('text')}) >= 10"""
ORACLE["dataset_chunks"] = f"""SELECT real_index, {lit(DATASET_CHUNK_HEADER)} || {collapse('text')} || {lit(DATASET_CHUNK_FOOTER)} AS chunk
FROM (SELECT {ROW_INDEX} AS real_index, text FROM documents)
WHERE text IS NOT NULL AND {trim_ws('text')} <> '' AND length({collapse('text')}) >= 10"""

ORACLE["page_limit"] = f"WITH {PAGES_CTE} SELECT doc_id, page_num, text FROM pages WHERE page_num <= 3"
ORACLE["pages_drop_blank"] = f"WITH {PAGES_CTE} SELECT doc_id, page_num, text FROM pages WHERE {trim_ws('text')} <> ''"
ORACLE["pages_keep_blank"] = f"WITH {PAGES_CTE} SELECT doc_id, page_num, {trim_ws('text')} AS text FROM pages"
CLEAN_PAGE = f"{lit(NL * 2 + '=== PAGE ')} || page_num || {lit(' ===' + NL * 2)} || {collapse('text')}"
ORACLE["clean_page"] = f"WITH {PAGES_CTE} SELECT doc_id, page_num, {CLEAN_PAGE} AS text FROM pages WHERE {trim_ws('text')} <> ''"
JOINED = f"""joined AS (SELECT doc_id, count(*) AS pages_total, count(t) AS pages_with_text,
  CASE WHEN count(t) = 0 THEN '' ELSE {lit(RULE)} || string_agg(t, {lit(NL * 2)} ORDER BY page_num) || {lit(NL * 2 + RULE)} END AS text
  FROM (SELECT doc_id, page_num, CASE WHEN {trim_ws('text')} <> '' THEN {CLEAN_PAGE} END AS t FROM pages) GROUP BY doc_id)"""
ORACLE["join_pages"] = f"WITH {PAGES_CTE}, {JOINED} SELECT doc_id, text FROM joined"
ORACLE["page_stats"] = f"""WITH {PAGES_CTE}, {JOINED}
SELECT doc_id, pages_total, pages_with_text, CAST(length(text) AS BIGINT) AS total_chars,
       round(length(text) / pages_total, 6) AS avg_chars_per_page FROM joined"""

DOC_COLS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLE["scan_parquet"] = DOC_COLS
ORACLE["scan_csv"] = DOC_COLS
ORACLE["scan_csv_split"] = DOC_COLS.replace("text", "replace(text, ' ', chr(10)) AS text")
ORACLE["scan_json"] = DOC_COLS
ORACLE["scan_named_split"] = DOC_COLS + " WHERE lang = 'en'"
ORACLE["scan_txt"] = f"SELECT doc_id, {clean_txt('text')} AS text FROM documents"
ORACLE["decode_txt"] = "SELECT doc_id, text FROM documents"


def _preview(x: str) -> str:
    return f"CASE WHEN length(CAST({x} AS VARCHAR)) > 100 THEN left(CAST({x} AS VARCHAR), 100) || '...' ELSE CAST({x} AS VARCHAR) END"


ORACLE["dataset_info"] = f"""SELECT 'documents' AS name, 'train' AS split, CAST(NULL AS VARCHAR) AS config,
  (SELECT count(*) FROM documents) AS total_samples, 'doc_id,text,lang,source,n_chars' AS columns,
  'doc_id:bigint,text:string,lang:string,source:string,n_chars:bigint' AS features, true AS text_column_exists,
  {_preview('doc_id')} AS sample_doc_id, {_preview('text')} AS sample_text, {_preview('lang')} AS sample_lang,
  {_preview('source')} AS sample_source, {_preview('n_chars')} AS sample_n_chars
FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 1)"""

# ---------------------------------------------------------------- QA and formats

QA_CTE = """qa AS (
  SELECT printf('dataset_%d_question_%d', u.conv_id, u.turn) AS id, u.text AS question, a.text AS answer,
         u.text AS context, CAST(u.turn AS INTEGER) AS question_index, u.conv_id AS chunk_index
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
QAT_CTE = QA_CTE + """, qat AS (SELECT qa.*, CAST(l.quality AS VARCHAR) AS question_type
  FROM qa LEFT JOIN labels l ON l.doc_id = qa.chunk_index)"""
TCHUNKS_CTE = f"""tchunks AS (SELECT real_index, {lit(DATASET_CHUNK_HEADER)} || {collapse('text')} || {lit(DATASET_CHUNK_FOOTER)} AS chunk
  FROM (SELECT {ROW_INDEX} AS real_index, text FROM documents)
  WHERE text IS NOT NULL AND {trim_ws('text')} <> '' AND length({collapse('text')}) >= 10),
tfan AS (SELECT real_index, chunk, CAST(q AS INTEGER) AS question_index FROM (SELECT *, unnest(range(3)) AS q FROM tchunks))"""
DOC_CHUNKS = chunks_cte("documents", 1000, 200)

ORACLE["question_fanout"] = f"""WITH RECURSIVE {DOC_CHUNKS}
SELECT doc_id, chunk_index, CAST(q AS INTEGER) AS question_index FROM (SELECT *, unnest(range(3)) AS q FROM chunks)"""
ORACLE["qa_ids"] = f"""WITH {TCHUNKS_CTE}
SELECT real_index, question_index, printf('dataset_%d_question_%d', real_index, question_index) AS id FROM tfan"""
ORACLE["output_names"] = f"""WITH {TCHUNKS_CTE}
SELECT real_index, question_index, printf('file_chunk_%06d.txt', real_index) AS chunk_file,
       printf('file_chunk_%06d_qa_%02d.json', real_index, question_index) AS qa_file,
       printf('dataset_chunk_%06d.txt', real_index) AS named_chunk_file,
       printf('chunk_%04d_qa_%02d.json', real_index, question_index) AS doc_qa_file FROM tfan"""
ORACLE["question_prompt"] = f"""WITH {TCHUNKS_CTE}
SELECT real_index, {lit(QUESTION_TEMPLATE_API + TEXT_MARKER)} || chunk AS prompt FROM tchunks"""
ORACLE["answer_prompt"] = f"""WITH {QA_CTE}
SELECT id, {lit(ANSWER_TEMPLATE + TEXT_MARKER)} || context || {lit(QUESTION_MARKER)} || question AS prompt FROM qa"""


def _first_sentence(x: str) -> str:
    return (f"coalesce(list_filter(list_transform(string_split_regex({x}, {lit(TERMINATOR_CLASS + '+')}), "
            f"lambda z: {trim_ws('z')}), lambda z: z <> '')[1], '')")


ORACLE["generate_qa"] = f"""WITH {TCHUNKS_CTE}
SELECT printf('dataset_%d_question_%d', real_index, question_index) AS id, {_first_sentence('chunk')} || '?' AS question,
       {_first_sentence('chunk')} AS answer, chunk AS context, question_index, real_index AS chunk_index,
       CAST(NULL AS VARCHAR) AS error FROM tfan"""
ORACLE["generate_resume"] = f"""WITH {TCHUNKS_CTE}
SELECT printf('dataset_%d_question_%d', real_index, question_index) AS id, {_first_sentence('chunk')} || '?' AS question,
       {_first_sentence('chunk')} AS answer, chunk AS context, question_index, real_index AS chunk_index,
       CAST(NULL AS VARCHAR) AS error, CAST(1 + length(chunk) % 2 AS BIGINT) AS run FROM tfan"""
ORACLE["join_chunk_qa"] = f"""WITH RECURSIVE {DOC_CHUNKS}
SELECT doc_id, chunk_index, CAST(q AS INTEGER) AS question_index, CAST(length(chunk) AS INTEGER) AS chunk_chars
FROM (SELECT *, unnest(range(3)) AS q FROM chunks)"""
ORACLE["resume_anti"] = """SELECT doc_id, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
ORACLE["union_sources"] = """SELECT 'documents' AS src, doc_id, text FROM documents
UNION ALL SELECT 'benchmark' AS src, item_id AS doc_id, text FROM benchmark"""
ORACLE["union_with_errors"] = """SELECT 'row' AS kind, doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS DOUBLE) END AS n_chars FROM documents
UNION ALL SELECT 'record' AS kind, doc_id, '{"doc_id": ' || doc_id || ', "text": ' AS text, CAST(NULL AS DOUBLE) AS n_chars FROM documents
UNION ALL SELECT 'input' AS kind, NULL AS doc_id, NULL AS text, NULL AS n_chars"""
ORACLE["union_missing_cols"] = """SELECT doc_id, item_id, lang, text FROM (
  SELECT doc_id, text, lang FROM documents UNION ALL BY NAME SELECT item_id, text FROM benchmark)"""
ORACLE["qa_stats"] = f"""WITH {QA_CTE}
SELECT count(*) AS total_pairs, round(avg(length(coalesce(question, ''))), 6) AS avg_question_length,
       round(avg(length(coalesce(answer, ''))), 6) AS avg_answer_length,
       round(avg(length(coalesce(context, ''))), 6) AS avg_context_length FROM qa"""
ORACLE["question_type_counts"] = f"""WITH {QAT_CTE}
SELECT coalesce(question_type, 'unknown') AS question_type, count(*) AS n FROM qat GROUP BY 1"""
ORACLE["metadata"] = f"""WITH {QAT_CTE}, t AS (SELECT coalesce(question_type, 'unknown') AS t, count(*) AS n,
  sum(length(coalesce(question, ''))) AS q, sum(length(coalesce(answer, ''))) AS a FROM qat GROUP BY 1)
SELECT 'Generated from conversations' AS name, 'Instruction dataset generated from PDF document' AS description,
       'conversations.parquet' AS source_file, CAST(sum(n) AS BIGINT) AS total_qa_pairs,
       string_agg(t || '=' || n, ',' ORDER BY t) AS question_types,
       round(sum(q) / sum(n), 6) AS avg_question_length, round(sum(a) / sum(n), 6) AS avg_answer_length FROM t"""
ORACLE["fmt_instruction_id"] = f"WITH {QA_CTE} SELECT question AS instruction, '' AS input, answer AS output, id FROM qa"
ORACLE["fmt_instruction"] = f"WITH {QA_CTE} SELECT question AS instruction, '' AS input, answer AS output FROM qa"
ORACLE["fmt_alpaca"] = ORACLE["fmt_instruction"]
ORACLE["fmt_chat"] = f"""WITH {QA_CTE}
SELECT id, CAST(to_json([{{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': answer}}]) AS VARCHAR) AS messages FROM qa"""


def _pretty(fields) -> str:
    parts = []
    for i, (name, expr, is_num) in enumerate(fields):
        sep = "," if i < len(fields) - 1 else ""
        val = f"CAST({expr} AS VARCHAR)" if is_num else f"CAST(to_json({expr}) AS VARCHAR)"
        parts.append(f"{lit(NL + '  ' + chr(34) + name + chr(34) + ': ')} || {val} || {lit(sep)}")
    return "'{' || " + " || ".join(parts) + f" || {lit(NL + '}')}"


ORACLE["datapoint_json"] = f"""WITH {QA_CTE}
SELECT printf('datapoint_%d.json', row_number() OVER (ORDER BY chunk_index, question_index) - 1) AS file_name,
       {_pretty([('instruction', 'question', False), ('input', "''", False), ('output', 'answer', False)])} AS body FROM qa"""
ORACLE["qa_pair_json"] = f"""WITH {QA_CTE}
SELECT printf('file_chunk_%06d_qa_%02d.json', chunk_index, question_index) AS file_name,
       {_pretty([('id', 'id', False), ('question', 'question', False), ('answer', 'answer', False),
                 ('context', 'context', False), ('question_index', 'question_index', True),
                 ('chunk_index', 'chunk_index', True)])} AS body FROM qa"""
ORACLE["chunk_stats_global"] = f"""WITH RECURSIVE {DOC_CHUNKS}
SELECT count(*) AS n_chunks, round(avg(length(chunk)), 6) AS avg_chunk_chars,
       CAST(min(length(chunk)) AS INTEGER) AS min_chunk_chars, CAST(max(length(chunk)) AS INTEGER) AS max_chunk_chars
FROM chunks"""
ORACLE["dataset_chunk_stats"] = f"""WITH {TCHUNKS_CTE}
SELECT count(*) AS n_chunks, round(avg(length(chunk)), 6) AS avg_chunk_chars FROM tchunks"""
ORACLE["run_summary"] = f"""WITH RECURSIVE {DOC_CHUNKS}, c AS (SELECT count(*) AS n FROM chunks)
SELECT c.n AS text_chunks, 3 * c.n AS qa_pairs, (SELECT count(*) FROM embeddings) AS embeddings,
       round(3 * c.n / c.n, 6) AS qa_per_chunk FROM c"""

# ---------------------------------------------------------------- vectors
ORACLE["embed_hashing"] = f"""WITH RECURSIVE {DOC_CHUNKS},
toks AS (SELECT doc_id, chunk_index, unnest(string_split_regex(chunk, {lit(WS_CLASS + '+')})) AS w FROM chunks),
b AS (SELECT doc_id, chunk_index, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS dim FROM toks WHERE w <> '')
SELECT doc_id, chunk_index, dim, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY doc_id, chunk_index, dim"""
ORACLE["embed_token_budget"] = ORACLE["embed_hashing"]
ORACLE["mean_pool"] = """WITH t AS (SELECT label AS key, CASE WHEN embedding[1] >= 0 THEN 1 ELSE 0 END AS mask,
  unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT key, CAST(dim AS INTEGER) AS dim, round(sum(CAST(v AS DOUBLE) * mask) / greatest(sum(mask), 1e-9), 6) AS value
FROM t GROUP BY key, dim"""
ORACLE["embedding_dim"] = """SELECT count(embedding) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS dim,
  count(DISTINCT len(embedding)) AS n_widths FROM embeddings"""
ORACLE["cosine"] = """SELECT a.vec_id, b.vec_id AS next_id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLE["topk_single"] = """WITH d AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding) AS v FROM embeddings),
c AS (SELECT list(m ORDER BY dim) AS q FROM (SELECT dim, avg(CAST(v AS DOUBLE)) AS m FROM d GROUP BY dim)),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, c
      WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id DESC) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5"""
ORACLE["topk_batch"] = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q, v c),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5"""

ORACLE["topk_pruned"] = ORACLE["topk_batch"]
ORACLE["page_chunks"] = f"""WITH RECURSIVE {PAGES_CTE}, {JOINED}, {chunks_cte('joined', 1000, 200)}
SELECT * FROM chunks"""

ORACLE["chunk_files"] = f"""WITH RECURSIVE {DOC_CHUNKS}
SELECT printf('doc_%d.txt/chunk_%04d.txt', doc_id, chunk_index) AS file_name, chunk AS body FROM chunks"""

ORACLE["qa_pair_files"] = f"""WITH {QA_CTE}
SELECT printf('qa_pair_%04d.json', row_number() OVER (ORDER BY chunk_index, question_index) - 1) AS file_name,
       {_pretty([('id', 'id', False), ('question', 'question', False), ('answer', 'answer', False),
                 ('context', 'context', False), ('question_index', 'question_index', True),
                 ('chunk_index', 'chunk_index', True)])} AS body FROM qa"""

# ---------------------------------------------------------------- positions, sources, sinks, streams
ORACLE["row_index_multi_file"] = ORACLE["row_index"]
ORACLE["row_index_json"] = ORACLE["row_index"]
ORACLE["slice_after_split"] = f"""SELECT * FROM (SELECT {ROW_INDEX} AS real_index, doc_id FROM documents WHERE lang = 'en') WHERE real_index >= 20"""
ORACLE["scan_auto_formats"] = """SELECT suffix, count(text) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents JOIN (SELECT unnest(['csv', 'JSONL', 'json', 'parquet', 'unknown']) AS suffix) ON true GROUP BY suffix"""
LINES = """SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS page_num, unnest(l) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL"""
ORACLE["pages_text_layer"] = LINES + ")"
ORACLE["pdf_pages"] = LINES + " AND doc_id % 4 < 2)"
ORACLE["pdf_pages_all"] = ORACLE["pages_text_layer"]
ORACLE["split_by_extension"] = """SELECT ['pdf', 'pdf', 'txt', 'unsupported'][doc_id % 4 + 1] AS kind, doc_id FROM documents"""
ORACLE["sink_json"] = f"WITH {QA_CTE} SELECT * FROM qa"
ORACLE["sink_csv"] = ORACLE["sink_json"]
ORACLE["sink_embeddings"] = """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim,
  round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings"""
ORACLE["export_all"] = f"""WITH {QA_CTE} SELECT output, count(*) AS n FROM qa JOIN (SELECT unnest(['qa_parquet', 'instructions_json',
  'instructions_csv', 'json', 'csv', 'instructions', 'alpaca', 'chat', 'alpaca_datapoints']) AS output) ON true GROUP BY output"""
ORACLE["metadata_sink"] = f"""WITH {QA_CTE}
SELECT 'conversations.parquet' AS source_file, count(*) AS total_qa_pairs, round(avg(length(coalesce(question, ''))), 6) AS avg_question_length FROM qa"""
ORACLE["stream_chunks"] = f"""WITH RECURSIVE {chunks_cte("(SELECT doc_id, " + clean_txt('text') + " AS text FROM documents)", 1000, 200)} SELECT * FROM chunks"""
ORACLE["stream_qa_stats"] = f"""WITH {QAT_CTE}
SELECT coalesce(question_type, 'unknown') AS question_type, count(*) AS n, round(avg(length(question)), 6) AS avg_question_length,
       round(avg(length(answer)), 6) AS avg_answer_length FROM qat GROUP BY 1"""
ORACLE["progress"] = "SELECT count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents"
ORACLE["unavailable_model"] = f"WITH {TCHUNKS_CTE} SELECT 'chunks' AS kind, count(*) AS n FROM tchunks"
ORACLE["local_question_prompt"] = f"""WITH {TCHUNKS_CTE}
SELECT real_index, {lit(QUESTION_TEMPLATE_LOCAL + TEXT_MARKER)} || chunk AS prompt FROM tchunks"""
