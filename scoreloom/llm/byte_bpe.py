"""Byte-level BPE through the tokenizers library, one call for each distinct stretch of text.

The tokenizer first splits a text by a pattern. A space that is followed by a character other than white
space always starts a new unit there, and a newline between two such characters is a unit of its own, so
a text may be cut before each of them and the pieces encode on their own exactly as in the whole text.
Pieces repeat, so each is encoded once per memory of a worker; new ones go to the library in rows,
ended by newlines, whose token marks where a piece's ids end.

Added tokens (such as an end-of-text mark) are found in texts as the library finds them, before all else:
a text is cut around them first.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from .recent import Recent

#: A space before anything but white space.
CUT = re.compile(r" (?=\S)")
#: Pre-tokenizers for which cutting there is safe.
SAFE = {"type": "ByteLevel", "add_prefix_space": False}
#: Marks of pieces that hold white space or start an odd text; others can't start with them, as they are white space.
FIRST, SPACED = "\x1f", "\x1e"
MARKS = FIRST + SPACED
#: Signs that make one unit of their own behind a word, and the end of the letters that words may hold here.
TAIL, LATIN = ".,;:!?*%#&$@", "\u0250"
#: The byte-level alphabet by its rule: printable characters stand for their bytes, the others follow from U+0100.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
SPACE = chr(ALPHABET[0x20])
#: Pieces of a row for the library.
ROW = 2000
#: Texts are worked on together up to so many characters.
TOGETHER = 1 << 18


def regular(text: str) -> list[str] | None:
    """Pieces of a text whose only white space is single spaces and newlines between words, else None.

    Pieces are words that follow a space, or a newline, which they then keep; the first one gets a newline.
    """
    words, keys = text.split(), text.replace("\n", " \n").split(" ")
    if len(keys) != len(words) or len("".join(words)) + len(words) - 1 != len(text):
        return None
    keys[0] = "\n" + keys[0]
    return keys


def odd(text: str) -> list[str]:
    """Pieces of any text: without the space before them, marked where they hold white space; the first is marked and whole."""
    keys = CUT.split(text)
    return [FIRST + keys[0], *[k if k.split() == [k] else SPACED + k for k in keys[1:]]]


def groups(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of about TOGETHER characters (a longer text is alone)."""
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class ByteTokenizer:
    """`remembered`: bytes of memory for pieces that were met before."""

    def __init__(self, path: str, remembered: int = 320 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        if spec.get("normalizer") or any(pre.get(k) != v for k, v in SAFE.items()) or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers with their own pattern and no normaliser are supported")
        if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain added tokens are supported")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.newline = self._plain(["\n"])[0]
        if len(self.newline) != 4:
            raise ValueError("a newline must be one token")
        self.added = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in added}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.sizes = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(token.encode()) if token in self.added else len(token)
        self.pieces = Recent(remembered, self._pieces)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, pieces: list[str], before: str, head: bytes) -> list[bytes]:
        """Ids of pieces without white space, each with `before` in front, with `head` added to each."""
        blob = self._plain([before + f"\n{before}".join(pieces) + "\n"])[0]
        ends = (np.flatnonzero(np.frombuffer(blob, "<u4") == np.frombuffer(self.newline, "<u4")) * 4).tolist()
        return [head + blob[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)]

    def _pieces(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of new pieces. Plain words go to the model by themselves, marks behind them apart; the rest in rows."""
        found, rows, tailed = {}, [], []
        for k in keys:
            if k[0] in MARKS:
                continue
            bare = k.rstrip(TAIL)
            body = bare[1:] if bare[:1] == "\n" else bare
            if not (body.isalpha() and len(k) - len(bare) < 8 and (body.isascii() or max(body) < LATIN)):
                rows.append(k)
                continue
            ids = found.get(bare) or self.pieces.known(bare)
            if ids is None:
                ids = found[bare] = self._word(body, bare is not body)
            if bare != k:
                tailed.append((k, ids, k[len(bare) :]))
        tails = {t for _, _, t in tailed}
        tails = dict(zip(tails, self._plain(list(tails)), strict=True))
        found.update((k, ids + tails[t]) for k, ids, t in tailed)
        rest = [k for k in keys if k[0] in MARKS]
        found.update(zip(rest, self._plain([(" " if k[0] == SPACED else "") + k[1:] for k in rest]), strict=True))
        for lines in (False, True):
            some = [k for k in rows if (k[0] == "\n") == lines]
            for at in range(0, len(some), ROW):
                row = some[at : at + ROW]
                found.update(zip(row, self._row([k[1:] for k in row], "", self.newline) if lines else self._row(row, " ", b""), strict=True))
        return found

    def _word(self, body: str, starts_line: bool) -> bytes:
        """Ids of a word of Latin letters, a unit of the tokenizer's pattern, by the library's model."""
        # ASCII letters stand for themselves
        mapped = body if body.isascii() else body.encode().decode("latin-1").translate(ALPHABET)
        ids = [t.id for t in self.model.tokenize(mapped if starts_line else SPACE + mapped)]
        return (self.newline if starts_line else b"") + struct.pack(f"<{len(ids)}I", *ids)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        keys, skips = [], []
        for t in texts:
            k = regular(t) if t else []
            skips.append(4 if k else 0)
            keys.append(odd(t) if k is None else k)
        values, at = self.pieces.values(list(chain.from_iterable(keys))), 0
        for k, skip in zip(keys, skips, strict=True):
            yield b"".join(values[at : at + len(k)])[skip:]
            at += len(k)

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        for part in groups(texts):
            marked = [i for i, t in enumerate(part) if self.around and self.around.search(t)]
            if not marked:
                yield from self._together(part)
                continue
            whole = set(marked)
            plain = self._together([t for i, t in enumerate(part) if i not in whole])
            for i, t in enumerate(part):
                if i not in whole:
                    yield next(plain)
                else:
                    sections = self.around.split(t)
                    between = self._together(sections[::2])
                    yield b"".join(self.added[s] if k % 2 else next(between) for k, s in enumerate(sections))

    def spans(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Code point spans of each text's tokens, (n, 2). Tokens that share a character all carry its span."""
        for text, blob in zip(texts, self.ids(texts), strict=True):
            ends = np.cumsum(self.sizes[np.frombuffer(blob, "<u4")])
            if not len(ends):
                yield np.zeros((0, 2), np.int64)
                continue
            starts = np.concatenate(([0], ends[:-1]))
            char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
            yield np.stack((char[starts], char[ends - 1] + 1), axis=1)


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> ByteTokenizer:
    """One tokenizer for each Python worker, which serves many tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteTokenizer(path)
