"""Scalar text functions as native Spark Column expressions.

Everything here compiles to JVM expressions (regexp_replace, trim, concat,
format_string ...), so it stays inside whole-stage codegen and is usable in
batch and streaming frames alike. Python's notion of whitespace and of word
characters differs from Java's defaults, so the character classes are built
explicitly (see ``WS_CHARS``)."""
from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference output exactly.
# ---------------------------------------------------------------------------
SENTENCE_TERMINATORS = ".!?؟؛"
KEEP_PUNCTUATION = ".,!?؟؛:،-()[]{}"
DATASET_CHUNK_HEADER = "\n\n=== DATASET CHUNK ===\n\n"
DATASET_CHUNK_FOOTER = "\n\n=== END CHUNK ===\n\n"
PAGE_HEADER_FORMAT = "\n\n=== PAGE %d ===\n\n"
RULE = "=" * 50
JOINED_HEAD, PAGE_SEPARATOR, JOINED_TAIL = RULE, "\n\n", "\n\n" + RULE
TXT_TITLE = "TEXT DOCUMENT"
MIN_DATASET_TEXT = 10
PREVIEW_CHARS = 100
PREVIEW_SUFFIX = "..."
QA_ID_FORMAT = "dataset_%d_question_%d"
CHUNK_FILE_FORMAT = "chunk_%04d.txt"
CHUNK_QA_FILE_FORMAT = "chunk_%04d_qa_%02d.json"
DATASET_CHUNK_FILE_FORMAT = "dataset_chunk_%06d.txt"
DATASET_CHUNK_QA_FILE_FORMAT = "dataset_chunk_%06d_qa_%02d.json"
TABLE_CHUNK_FILE_FORMAT = "file_chunk_%06d.txt"
TABLE_CHUNK_QA_FILE_FORMAT = "file_chunk_%06d_qa_%02d.json"
QA_PAIR_FILE_FORMAT = "qa_pair_%04d.json"
DATAPOINT_FILE_FORMAT = "datapoint_%d.json"

# Python's whitespace set (str.isspace), derived by rule rather than listed.
WS_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def _esc(cp: int) -> str:
    ch = chr(cp)
    return ch if ch.isalnum() and cp < 128 else "\\x{%x}" % cp


def _cls_escape(chars: str) -> str:
    """Escape a set of characters for a regex class, consecutive code points
    as ranges; ``\\x{h}`` works in Java and RE2."""
    cps = sorted({ord(c) for c in chars})
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(_esc(cps[i]) if i == j else _esc(cps[i]) + "-" + _esc(cps[j]))
        i = j + 1
    return "".join(out)


WS_CLASS = "[" + _cls_escape(WS_CHARS) + "]"
WS_CLASS_NO_NL = "[" + _cls_escape(WS_CHARS.replace("\n", "")) + "]"
TERMINATOR_CLASS = "[" + _cls_escape(SENTENCE_TERMINATORS) + "]"
# Python's \w is "alphanumeric or underscore"; \p{L}\p{N}_ is its Unicode form.
DROP_CLASS = "[^\\p{L}\\p{N}_" + _cls_escape(WS_CHARS) + _cls_escape(KEEP_PUNCTUATION) + "]"
LAST_TERMINATOR_PREFIX = "(?s)^.*" + TERMINATOR_CLASS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """``str.strip()``: trims every Python whitespace character (no regex)."""
    return F.trim(_c(c), F.lit(WS_CHARS))


_WS_OTHER = WS_CHARS.replace(" ", "")
_WS_OTHER_NO_NL = _WS_OTHER.replace("\n", "")


def _spaces(c: Column, keep_newline: bool = False) -> Column:
    """Every whitespace character (but '\\n' when kept) turned into a space and
    runs of spaces shortened to one. A per-character ``translate`` plus a
    literal-space pattern is about twice as fast as one regex over the full
    whitespace class, and gives the same text."""
    other = _WS_OTHER_NO_NL if keep_newline else _WS_OTHER
    return F.regexp_replace(F.translate(c, other, " " * len(other)), "  +", " ")


def ws_collapse(c) -> Column:
    """``' '.join(s.split())``: whitespace runs become one space, then trim."""
    return F.trim(_spaces(_c(c)))


def is_blank(c) -> Column:
    """True when null or only whitespace."""
    return _c(c).isNull() | (ws_trim(c) == "")


def valid_text(c) -> Column:
    """Non-null and not blank after strip."""
    return _c(c).isNotNull() & (ws_trim(c) != "")


def chunk_clean(c) -> Column:
    """Chunker cleaning: collapse whitespace runs to one space, delete every
    character outside letters/digits/underscore/whitespace/kept punctuation,
    then strip. Deleting comes after collapsing, as in the reference."""
    collapsed = _spaces(_c(c))
    # after collapsing, the only whitespace left is U+0020, so trim suffices
    return F.trim(F.regexp_replace(collapsed, DROP_CLASS, ""))


def sentence_boundary(segment, offset) -> Column:
    """Offset just after the last sentence terminator in ``segment``; null if none."""
    m = F.length(F.regexp_extract(_c(segment), LAST_TERMINATOR_PREFIX, 0))
    return F.when(m > 0, _c(offset) + m)


def split_sentences(c) -> Column:
    """Split on runs of terminators, strip pieces, drop empty ones (array<string>)."""
    parts = F.split(_c(c), TERMINATOR_CLASS + "+", -1)
    return F.filter(F.transform(parts, lambda s: ws_trim(s)), lambda s: s != "")


def wrap_dataset_chunk(c) -> Column:
    """Dataset-row cleaning: collapse whitespace; '' when shorter than 10; else
    wrap in the dataset-chunk banner (collapse evaluated once)."""
    def wrap(t):
        return F.when(F.length(t) < MIN_DATASET_TEXT, F.lit("")).otherwise(
            F.concat(F.lit(DATASET_CHUNK_HEADER), t, F.lit(DATASET_CHUNK_FOOTER)))
    return F.transform(F.array(ws_collapse(c)), wrap)[0]


def clean_page(text, page_num) -> Column:
    """One page of extracted text: collapsed, prefixed with its page banner."""
    return F.concat(F.format_string(PAGE_HEADER_FORMAT, _c(page_num)), ws_collapse(text))


def join_cleaned_pages(parts) -> Column:
    """Join cleaned page texts (array in page order) the way the reference does,
    already stripped: the rule once in front, pages separated by a blank line."""
    return F.when(F.size(_c(parts)) == 0, F.lit("")).otherwise(
        F.concat(F.lit(JOINED_HEAD), F.array_join(_c(parts), PAGE_SEPARATOR), F.lit(JOINED_TAIL)))


def clean_txt(c, banner: bool = True) -> Column:
    """Plain-text file cleaning: each line whitespace-collapsed (blank lines kept
    as empty lines), joined by newlines, framed by the text-document banner and
    stripped. Implemented with two regex passes instead of split/transform/join."""
    body = F.trim(F.regexp_replace(_spaces(_c(c), keep_newline=True), " ?\n ?", "\n"))
    if not banner:
        return ws_trim(body)
    return F.concat(F.lit(RULE + "\n" + TXT_TITLE + "\n" + RULE + "\n\n"), body,
                    F.lit("\n\n" + RULE))


def paragraphs(c) -> Column:
    """Split on blank-line pairs, strip, drop empty pieces (array<string>)."""
    return F.filter(F.transform(F.split(_c(c), "\n\n", -1), lambda p: ws_trim(p)),
                    lambda p: p != "")


def preview(c, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters plus '...' when longer (the dataset-info sample)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(PREVIEW_SUFFIX))).otherwise(s)


def qa_id(real_index, question_index) -> Column:
    return F.format_string(QA_ID_FORMAT, _c(real_index).cast("long"), _c(question_index).cast("int"))
