"""SQL spellings (DuckDB / RE2) of the text functions, for the oracle queries.

They share the character classes of ``tessera.functions.text`` (written with
``\\x{h}`` escapes, which RE2 and Java both accept)."""
from __future__ import annotations

from tessera.functions.text import (DROP_CLASS, LAST_TERMINATOR_PREFIX, RULE, TERMINATOR_CLASS,
                                    TXT_TITLE, WS_CHARS, WS_CLASS, WS_CLASS_NO_NL)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = lit(WS_CHARS)


def trim_ws(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS_CLASS + '+')}, ' ', 'g'))"


def clean(x: str) -> str:
    inner = f"regexp_replace({x}, {lit(WS_CLASS + '+')}, ' ', 'g')"
    return f"trim(regexp_replace({inner}, {lit(DROP_CLASS)}, '', 'g'))"


def clean_txt(x: str) -> str:
    body = f"regexp_replace({x}, {lit(WS_CLASS_NO_NL + '+')}, ' ', 'g')"
    body = f"trim(regexp_replace({body}, ' *\n *', '\n', 'g'))"
    return f"({lit(RULE + chr(10) + TXT_TITLE + chr(10) + RULE + chr(10) * 2)} || {body} || {lit(chr(10) * 2 + RULE)})"


def last_term_len(x: str) -> str:
    return f"length(regexp_extract({x}, {lit(LAST_TERMINATOR_PREFIX)}, 0))"


def split_sentences(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({x}, {lit(TERMINATOR_CLASS + '+')}), "
            f"lambda z: {trim_ws('z')}), lambda z: z <> '')")


def chunk_end(s: str, size: int) -> str:
    lo = f"greatest({s} + {size - 100}, {s})"
    hi = f"least({s} + {size + 50}, n)"
    m = last_term_len(f"substring(t, {lo} + 1, {hi} - {lo})")
    return (f"(CASE WHEN {s} + {size} < n AND {m} > 0 AND {lo} + {m} > {s} + {size // 2} "
            f"THEN {lo} + {m} ELSE {s} + {size} END)")


def chunks_cte(source: str, size: int, overlap: int, key: str = "doc_id", text: str = "text",
               name: str = "chunks") -> str:
    """CTEs ending in ``name``(key, chunk_index, chunk_start, chunk_end, chunk):
    the overlapping chunker as a recursive CTE over (key, start)."""
    return f"""__src AS (SELECT {key} AS k, {clean(text)} AS t FROM {source} WHERE {text} IS NOT NULL),
__src2 AS (SELECT k, t, length(t) AS n FROM __src WHERE length(t) > 0),
__r AS (
  SELECT k, t, n, 0 AS s, {chunk_end('0', size)} AS e FROM __src2
  UNION ALL
  SELECT k, t, n, ns AS s, {chunk_end('ns', size)} AS e
  FROM (SELECT k, t, n, greatest(s + 1, e - {overlap}) AS ns FROM __r) WHERE ns < n
),
__ch AS (SELECT k, s, least(e, n) AS e2, trim(substring(t, s + 1, e - s)) AS chunk FROM __r),
{name} AS (SELECT k AS {key}, CAST(row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS INTEGER) AS chunk_index,
  CAST(s AS INTEGER) AS chunk_start, CAST(e2 AS INTEGER) AS chunk_end, chunk FROM __ch WHERE chunk <> '')"""
