"""Exact, cached encoding with a byte-level BPE vocabulary of the ``tokenizers`` library."""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ._common import CACHES

#: The split pattern of the byte-level vocabulary.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Two white-space characters in a row: there the place of a split depends on the neighbours.
_RUN = re.compile(r"\s\s")
#: Characters that engines class differently; texts with them go to the library whole.
_ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: Texts that are not encoded word by word in batches: such characters, or white space of three characters, or of two at the end.
_SLOW = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}]|[\t-\r\p{Z}]{3}|[\t-\r\p{Z}]{2}\z"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    table, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[byte] = chr(byte)
        else:
            table[byte], spare = chr(spare), spare + 1
    return table


class _Cache(dict):
    """Piece or word -> its ids as bytes; the library encodes each piece once."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.encode(piece)
        if len(piece) < 64:
            self[piece] = found
        return found


class Encoder:
    """text -> ids as little-endian bytes (2 bytes an id if the vocabulary has at most 65,536).

    The vocabulary first splits a text into pieces and never merges across them, so pieces are encoded once and
    kept in a bounded cache. Where only single white-space characters stand between words, a split before each
    space and around each line end gives whole pieces; other texts are split by the full pattern.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Contents of the vocabulary's added tokens: the library finds them before it splits, so texts with one go to it whole.
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.characters = self.tokenizer.model, _byte_characters()
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces = _Cache(self.piece, most)
        self.spaced = _Cache(lambda word: self.word(" " + word), most)
        self.alone = _Cache(lambda word: self.word(word) if word else b"", most // 4)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        assert sys.byteorder == "little"
        self.line_end = self.piece("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.characters[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.characters)
        return array(self.code, [token.id for token in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        if word[1:].isalpha() and word[0] == " ":  # one piece: a space and letters
            return self.piece(word)
        pieces = PIECES.findall(word)
        return self.piece(word) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): those of text i, and end_id after them, are ids[bounds[i]:bounds[i + 1]]; null texts are empty.

        White space of at most two characters splits alike wherever it stands, so the words of a whole batch are told apart
        and counted by Arrow, each distinct one is looked up once, and the ids are gathered by numpy.
        """
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, _SLOW)
        for content in self.added:
            slow = pc.or_(slow, pc.match_substring(texts, content))
        odd = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
        if not len(odd):
            return self._words(texts, end_id)
        ids, bounds = self._words(texts.filter(pc.invert(slow)), end_id)
        parts, plain = [], iter(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        rest = {i: texts[i].as_py() for i in odd.tolist()}
        end = np.array([end_id], self.dtype)
        for i in range(len(texts)):
            if i in rest:
                parts.append(np.concatenate([np.frombuffer(self(rest[i]), self.dtype), end]))
            else:
                a, b = next(plain)
                parts.append(ids[a:b])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _words(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n "), " ")
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        breaks = index == pc.index(coded.dictionary, "\n").as_py()  # -1 where there is none
        spaced = ~breaks
        spaced[1:] &= ~breaks[:-1]
        spaced[offsets[:-1]] = False
        code = 2 * index + spaced
        known = np.zeros(2 * len(words), np.int64)
        known[code] = 1
        used = np.flatnonzero(known)
        known[used] = np.arange(len(used))
        after, alone = self.spaced, self.alone
        found = [after[words[c >> 1]] if c & 1 else alone[words[c >> 1]] for c in used.tolist()]
        table = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.array([len(x) for x in found], np.int64) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        rank = known[code]
        length = sizes[rank]
        total = np.concatenate([[0], np.cumsum(length)])
        bounds = total[offsets] + np.arange(n + 1)
        document = np.repeat(np.arange(n), np.diff(offsets))
        within = np.arange(total[-1])
        ids = np.full(bounds[-1], end_id, self.dtype)
        ids[within + np.repeat(document, length)] = table[within + np.repeat(starts[rank] - total[:-1], length)]
        return ids, bounds

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD.search(text) or any(content in text for content in self.added):
            return self.whole(text)
        if _RUN.search(text):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))
        spaced, out = self.spaced.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            if head:
                out.append(self.word(head))
            out.extend(map(spaced, rest))
            out.append(self.line_end)
        out.pop()
        return b"".join(out)


_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary: its cache serves all tasks of that worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
