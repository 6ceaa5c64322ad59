"""Byte -> text decoding with the reference's encoding cascade, all native.

The cascade tries utf-8, utf-8-sig, cp1256, iso-8859-6, windows-1256 and keeps
the first result that decodes *and* is not blank, else utf-8 with undecodable
bytes dropped. cp1256 maps every byte value, so only two branches are live:
valid non-blank utf-8, else cp1256 (if non-blank), else utf-8 minus bad bytes.
cp1256 is applied as ISO-8859-1 decode + translate, with the table derived
from Python's codec (so no legacy JVM charset switch is needed)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ws_trim

_LATIN1 = bytes(range(128, 256)).decode("latin-1")
_CP1256 = bytes(range(128, 256)).decode("cp1256")
_SRC = "".join(a for a, b in zip(_LATIN1, _CP1256) if a != b)
_DST = "".join(b for a, b in zip(_LATIN1, _CP1256) if a != b)


def decode_cp1256(content) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.translate(F.decode(c, "ISO-8859-1"), _SRC, _DST)


def decode_text(content, universal_newlines: bool = True) -> Column:
    """Decode a binary column like the reference's text-file reader."""
    c = F.col(content) if isinstance(content, str) else content
    as_utf8 = c.cast("string")
    cp = decode_cp1256(c)
    dropped = F.regexp_replace(F.make_valid_utf8(as_utf8), "\\x{FFFD}", "")
    out = (F.when(F.is_valid_utf8(as_utf8) & (ws_trim(as_utf8) != ""), as_utf8)
           .when(ws_trim(cp) != "", cp)
           .otherwise(dropped))
    if universal_newlines:
        out = F.regexp_replace(out, "\r\n?", "\n")
    return out
