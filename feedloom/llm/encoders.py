"""Worker-side token caches. A text is cut at spaces, where no token of these vocabularies can cross, and every distinct
piece is encoded once per worker process while it stays in the cache.

Two generations bound a cache: when the young one is full it becomes the old one, and what is used again moves back.
"""
from __future__ import annotations

import re
import struct
import sys
import types

#: Distinct pieces a worker remembers per generation, some 150 bytes each.
REMEMBERED = 600_000


class Remembered(dict):
    """Piece -> value; a miss asks the old generation, then ``encode``."""

    def __init__(self, encode, limit: int = REMEMBERED):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece):
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        # Very long pieces are not worth a place: they hardly come again and would break the bound on bytes.
        if len(piece) <= 256:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


def per_process(name: str, make):
    """One value per worker process, kept over tasks."""
    shelf = sys.modules.setdefault("_corpus_worker_caches", types.ModuleType("_corpus_worker_caches"))
    if not hasattr(shelf, name):
        setattr(shelf, name, make())
    return getattr(shelf, name)


def word_ids(tokenizer_file: str) -> Remembered:
    """Piece -> its token ids as little-endian unsigned 32-bit bytes, by a ``tokenizers`` file whose pre-tokens end at
    white space and keep none of it."""

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.no_padding()
        tokenizer.no_truncation()

        def encode(piece: str) -> bytes:
            """A closing mark behind a plain letter is a pre-token of its own, and case is folded letter by letter, so the
            many spellings of a word cost one encoding. A word of plain small letters is one pre-token and goes straight
            to the merges; all else is the tokenizer's."""
            if _WORD.fullmatch(piece):
                return ids_of([t.id for t in merges.tokenize(piece.translate(spelling))])
            if len(piece) > 1 and piece[-1] in _CLOSING and piece[-2].isalpha() and _LATIN.fullmatch(piece[-2]):
                return cache[piece[:-1]] + cache[piece[-1]]
            lower = piece.lower()
            if lower != piece and "<" not in piece and _LATIN.fullmatch(piece):
                return cache[lower]
            return ids_of(tokenizer.encode(piece, add_special_tokens=False).ids)

        merges = tokenizer.model
        # How the merges spell each letter: its bytes as characters, as the pre-tokenizer gives them.
        spelling = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(97, 256)) if _WORD.fullmatch(c)}
        cache = Remembered(encode)
        return cache

    return per_process("word_ids:" + tokenizer_file, make)


def ids_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_CLOSING = ".,;:!?"
_WORD = re.compile("[a-zß-öø-ÿ]+")
_LATIN = re.compile("[\x20-\x7eÀ-ÖØ-öø-ÿ]+")


_BREAKS = str.maketrans("\n\t\r", "   ")


def text_ids(cache: Remembered, text: str) -> bytes:
    """The ids of a whole text. Only spaces, tabs and line ends cut it: all of them are white space to the tokenizer,
    which drops it; any other kind stays inside a piece and is the tokenizer's to judge."""
    return b"".join(map(cache.__getitem__, text.translate(_BREAKS).split(" "))) if text else b""


def piece_lengths(model_file: str) -> Remembered:
    """Piece -> how many tokens a sentencepiece model makes of it."""

    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return Remembered(lambda piece: len(model.encode(piece)))

    return per_process("piece_lengths:" + model_file, make)


#: What the model reads as a space of its own.
MARK = "\u2581"
#: A word with the spaces before it; the last one also takes the spaces after it.
_SPACED = re.compile(r" *[^ ]+(?: +\Z)?")


def pieces(text: str) -> list[str]:
    """The parts of a text that a model with a leading word mark encodes one by one with the same result.

    The model marks each space and puts one mark before the text, and no token has a mark behind another character, so
    every part begins at a run of marks. A part's first mark is left out here, as the model adds it again. A text that
    holds the mark itself stays whole: beside a space it would make one run with it.
    """
    if MARK in text:
        return [text]
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    found = _SPACED.findall(text)
    return [found[0], *(f[1:] for f in found[1:])] if found else [text]
