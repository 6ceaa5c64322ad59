"""Whole-text token ids from a public vocabulary, encoded word by word.

White space always separates tokens of the word-level vocabulary, so the ids of
a text are the ids of its words in a row. Each worker encodes a distinct word
once and keeps its ids as little-endian unsigned 32-bit integers. Plain words
(letters, then ASCII signs) go straight to the vocabulary's merge model, all
others through the whole tokenizer."""
from __future__ import annotations

import os
import re
from functools import lru_cache

TOKENIZER_DIR = "/opt/tokenizers"

#: Latin letters up to U+024F, then signs that form one piece of their own.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:;=?@\[-`{-~]*)")


def vocabulary_path(name: str = "word_bpe_49k.json", folder: str = TOKENIZER_DIR) -> str:
    """Place of a public vocabulary file; the folder is a parameter."""
    return os.path.join(folder, name)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a printable character: itself if
    printable, else the next free one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """word (UTF-8 bytes) -> its ids as bytes. About ``most`` words are kept, in
    a newer and an older half: that bounds memory and changes no result."""

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.half = Tokenizer.from_file(path), most // 2
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.old: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        # the short way is only taken if this vocabulary splits words as PLAIN does
        self.short = all(self._plain(w) == self._whole(w) for w in ("Hello", "Straße,", "dont&&&", "ÉTÉ...", "a|", "x"))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _whole(self, word: str) -> bytes:
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        out = self.cores.get(piece)
        if out is None:
            text = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            out = self._bytes([t.id for t in self.model.tokenize(text)])
            if len(self.cores) > self.half:
                self.cores.clear()
            self.cores[piece] = out
        return out

    def _plain(self, word: str) -> bytes | None:
        m = PLAIN.fullmatch(word)
        if not m or len(word) > 1000:
            return None
        core, signs = m[1].lower(), m[2]
        if not core.isalpha():  # lower case may bring a combining mark, which splits words
            return None
        return self._piece(core) + (self._piece(signs) if signs else b"")

    def __missing__(self, word: bytes) -> bytes:
        out = self.old.get(word)
        if out is None:
            text = word.decode("utf-8", "replace")
            out = self._plain(text) if self.short else None
            if out is None:
                out = self._whole(text)
        if len(word) < 200:  # a longer one hardly comes again
            self[word] = out
        return out

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole UTF-8 text; null or blank: none. ``bytes.split()``
        parts at the six ASCII spaces; other white space stays inside a word
        and is left to the tokenizer."""
        if not text:
            return b""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
