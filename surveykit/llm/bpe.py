"""Ids of public tokenizers, looked up per blank-free piece of text and kept by the worker.

Neither kind of vocabulary joins text across a space that stands between two other characters, so a text can be cut
there and its ids are the ids of the pieces in a row. Pieces repeat far more often than texts do. A new piece of
printable ASCII or Latin letters is cut by the tokenizer's own pattern and only its new parts go to the tokenizer's
model; any other piece goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: pieces and parts kept by a worker; past that a table starts anew, so a worker's memory has a bound
KEPT = 500_000
#: rows whose texts are held as Python strings at a time
ROWS = 256
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"^\s|\s\s|\s$")
#: characters that no normaliser changes but for their case, and whose classes all libraries agree on
_PLAIN = re.compile("[\n!-~¡-¬®-įĲ-ňŊ-žƀ-ǃǍ-ǯ]*")
# Fixed value: the pattern of byte-level tokenizers that carry none of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OPEN: dict[str, PieceTable] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceTable:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: blanks leave no ids; then pieces don't carry the space before them
        self.word_ends = not self.tokenizer.encode(" ", add_special_tokens=False).ids
        self.pattern, self.lower = self._own_pattern()
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _own_pattern(self):
        stated = json.loads(self.tokenizer.to_str())
        cut, norm = stated["pre_tokenizer"], stated["normalizer"]
        if cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and norm is None:
            return regex.compile(BYTE_LEVEL), False
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        steps = cut.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"]:
            return regex.compile(steps[0]["pattern"]["Regex"]), True
        return None, False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= KEPT:
            self.parts.clear()
        stood = part.encode().decode("latin-1").translate(self.letters)
        self.parts[part] = found = np.array([t.id for t in self.model.tokenize(stood)], dtype="<u4").tobytes()
        return found

    def _new(self, piece: str, before: str) -> bytes:
        if self.pattern is None or "<|" in piece or not _PLAIN.fullmatch(piece):
            return self._whole(before + piece)
        parts = self.parts
        return b"".join([parts.get(p) or self._part(p) for p in self.pattern.findall(before + (piece.lower() if self.lower else piece))])

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.word_ends:
            before, first, pieces = "", b"", text.replace("\n", " ").split(" ")
        else:
            before, (head, *pieces) = " ", _CUT.split(text) if _WIDE.search(text) else text.split(" ")
            first = self._new(head, "")
        known = self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > KEPT:
            known.clear()
            new = set(pieces)
        for piece in new:
            known[piece] = self._new(piece, before)
        return first + b"".join(map(known.__getitem__, pieces))


def open_table(path: str) -> PieceTable:
    """One table per worker and vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = PieceTable(path)
    return _OPEN[path]


def forget() -> None:
    """Give back what this worker keeps of pieces; a task that encodes none calls it, as workers outlive tasks."""
    _OPEN.clear()


def encoded(texts: Iterable[str | None], path: str, end: int) -> Iterator[bytes]:
    table, tail = open_table(path), np.array([end], dtype="<u4").tobytes()
    for text in texts:
        yield table.ids(text or "") + tail


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``, so that Python objects of only so many texts exist at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
