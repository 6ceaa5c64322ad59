"""DuckDB SQL for the queries that SQL can express. Hash placement (op2), token ids
(op7, op9), XXH64 fingerprints (op6), SimHash candidates (op5) and trained models
(op1, op10) have none; their tests use brute force or held-out rows."""

#: op3: every window as its words, the smallest doc_id per window, words covered.
OP3 = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM w JOIN f USING (k) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: op4: digests straight from the rows; the length from the template.
OP4 = r"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
            + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) AS formatted_chars
    FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM t
"""


def _tree(column: str) -> str:
    """Sections of a text as lists of leaves."""
    sections = f"list_filter(string_split(regexp_replace({column}, '(\\n\\n+)', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
    return (f"list_transform({sections}, lambda s: list_filter("
            "string_split(regexp_replace(s, '(\\n|\\. )', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> ''))")


def _print(tree: str) -> str:
    """The fingerprint string of such a tree."""
    root = f"sha256(coalesce(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(p)), ''))), ''), ''))"
    body = f"list_transform({tree}, lambda s: '/' || array_to_string(list_transform(s, lambda p: substr(sha256(p), 1, 12) || '-' || length(p)), ','))"
    return f"{root} || coalesce(array_to_string({body}, ''), '')"


def _leaves(tree: str) -> str:
    return f"list_distinct(flatten(list_transform({tree}, lambda s: list_transform(s, lambda p: substr(sha256(p), 1, 12) || '-' || length(p)))))"


def _chars(leaves: str) -> str:
    return f"coalesce(list_sum(list_transform({leaves}, lambda x: CAST(substr(x, 14) AS BIGINT))), 0)"


def _likeness(a: str, b: str) -> str:
    common, total = _chars(f"list_intersect({a}, {b})"), f"({_chars(a)} + {_chars(b)})"
    return f"CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE {common}::DOUBLE / greatest({total} - {common}, 1)::DOUBLE END"


#: op8: neighbours by one window, trees as nested lists.
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (
    SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM d),
e AS (SELECT *, substr(text, 1, n - n // 3) || substr(following, 1, n // 3) AS edited FROM o),
t AS (SELECT *, {_tree("text")} AS own, {_tree("edited")} AS changed, {_tree("following")} AS other FROM e),
s AS (SELECT *, {_leaves("own")} AS a, {_leaves("changed")} AS b, {_leaves("other")} AS c FROM t)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_print("own")} AS fingerprint, {_print("changed")} AS edited_fingerprint,
    {_likeness("a", "b")} AS near_edited, {_likeness("a", "c")} AS near_next
FROM s
"""

LLM_ORACLE: dict[str, str] = {
    "op3_substring_dedup": OP3,
    "op4_chat_format": OP4,
    "op8_merkle_fingerprints": OP8,
}
