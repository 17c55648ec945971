"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document is cut at the window length; what is left of it goes in
the open window it fills best. When it fits in none, its head tops up the fullest window, which is emitted full, and the
rest takes the freed place. At the end the windows still open are merged in a second, short step: the pieces of several
partitions' windows, best fit in order of size, cut only where they fit in no gap.

Memory: the open windows, the batch at hand and a word cache of bounded size. Between the two steps pieces are written as
a few numbers each; only the pieces of open windows carry their ids. Null texts count as empty: such a document is its end
id alone. Repeated rows and equal doc_ids are packed as documents of their own; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, slices, texts, written

LENGTH = 2048
OPEN = 16
END_ID = 1
FAN_IN = 64
CACHE = 250_000
TOKENIZER = "word_bpe_49k.json"


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as they are, the others from U+0100 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of texts by the tokenizer, remembered per white-space word.

    White space only separates for this tokenizer (its pattern never matches it, and nothing composes across it), so the
    ids of a text are those of its words in order; ASCII letters may be lowered first, as the tokenizer does it itself.
    Two kinds of words keep their case: those that may hold a special token, which is matched as written, and those with
    combining marks, which are composed before they are lowered (j with caron is one letter, J with caron is not).
    Words are cut at ASCII white space only. Of a new word, Latin letters and the ASCII signs after them are separate
    pieces for the tokenizer's pattern; a piece of letters goes straight to its model, everything else through the whole
    tokenizer. What is remembered is bounded by `CACHE` words and as many stems.
    """

    _by_path: dict[str, "Words"] = {}
    _shape = re.compile(r"([^\W\d_]+)([,.!?;:%#*&$|]*)")
    # the start of a special token, and the first bytes of U+0300 to U+037F
    _cased = re.compile(rb"<\||[\xcc\xcd]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Words":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters_of(self, stem: str) -> bytes:
        low = stem if stem.isascii() else stem.lower().encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()

    def _new(self, word: str) -> bytes:
        m = self._shape.fullmatch(word)
        # \w also holds numbers like ² and ½, which are pieces of their own; Latin letters have one lower-case form each,
        # but for the dotted capital I, and are in composed form
        if not m or not m[1].isalpha() or not word.isascii() and (max(word) >= "\u0250" or "\u0130" in word):
            return self._whole(word)
        out = b""
        for piece, letters in ((m[1], True), (m[2], False)):
            if piece:
                got = self.stems.get(piece)
                if got is None:
                    got = self._letters_of(piece) if letters else self._whole(piece)
                    if len(self.stems) < CACHE:
                        self.stems[piece] = got
                out += got
        return out

    def ids(self, docs: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        for d in docs:
            words = d.encode()
            if self._cased.search(words):
                words = [w if self._cased.search(w) else w.lower() for w in words.split()]
            else:
                words = words.lower().split()
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:
                own = {w: known.get(w) or self._new(w.decode()) for w in set(words)}
                if len(known) < CACHE:
                    known.update(own)
                yield b"".join(map(own.__getitem__, words))


class OpenWindows:
    """Open windows in order of fill. A piece is (doc_id, start, length, crc, doc_tokens, ids)."""

    def __init__(self, places: int, length: int):
        self.places, self.length = places, length
        self.fills: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.next = 0

    def put(self, size: int) -> int | None:
        """Number of the fullest open window that has room, a new one if a place is free, else None."""
        at = bisect_left(self.fills, (self.length - size + 1, -1)) - 1
        if at >= 0:
            fill, n = self.fills.pop(at)
        elif len(self.fills) < self.places:
            fill, n = 0, self.next
            self.next += 1
            self.pieces[n] = []
        else:
            return None
        insort(self.fills, (fill + size, n))
        return n

    def take_fullest(self) -> tuple[int, int]:
        return self.fills.pop()


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, part int, open boolean, ids binary"
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int32()),
                          ("open", pa.bool_()), ("ids", pa.binary())])


def _packer(path: str, length: int, places: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, windows = Words.of(path), OpenWindows(places, length)
        end, rows = np.array([END_ID], "<u4").tobytes(), []

        def emit(n: int, still_open: bool) -> None:
            offset = 0
            for piece in windows.pieces.pop(n):
                *own, ids = piece
                rows.append((*own, (part << 33) + n, offset, part, still_open, ids if still_open else None))
                offset += piece[2]

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield from arrow_batches(dict(zip(PIECE_SCHEMA.names, zip(*rows))), PIECE_SCHEMA)
                rows.clear()

        for b in slices(batches):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.ids(texts(b.column("text")))):
                ids += end
                total = len(ids) // 4

                def piece(start: int, size: int) -> tuple:
                    own = ids[start * 4:(start + size) * 4]
                    return doc_id, start, size, zlib.crc32(own), total, own

                at = 0
                while total - at >= length:
                    windows.pieces[windows.next] = [piece(at, length)]
                    emit(windows.next, False)
                    windows.next += 1
                    at += length
                if at < total:
                    n = windows.put(total - at)
                    if n is None:
                        fill, n = windows.take_fullest()
                        if fill < length:
                            windows.pieces[n].append(piece(at, length - fill))
                            at += length - fill
                        emit(n, False)
                        n = windows.put(total - at)
                    windows.pieces[n].append(piece(at, total - at))
            yield from flush()
        for _, n in windows.fills:
            emit(n, True)
        yield from flush()

    return pack


def _merge(length: int, first_id: int):
    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        """As few sequences as hold all pieces: whole ones best fit in order of size, and what fits nowhere is cut over the gaps."""
        pieces = pieces.sort_values(["length", "part", "sequence_id", "offset"], ascending=[False, True, True, True], ignore_index=True)
        windows, filled, rows = OpenWindows(-(-int(pieces["length"].sum()) // length), length), {}, []
        for doc_id, start, size, total, ids in zip(*[pieces[c] for c in ("doc_id", "start", "length", "doc_tokens", "ids")]):
            at = 0
            while at < size:
                n, own = windows.put(size - at), size - at
                if n is None:
                    fill, n = windows.take_fullest()
                    windows.places -= 1
                    own = length - fill
                if own:
                    crc = zlib.crc32(memoryview(ids)[at * 4:(at + own) * 4])
                    rows.append((doc_id, start + at, own, crc, total, first_id + (int(key[0]) << 33) + n, filled.get(n, 0)))
                    filled[n] = filled.get(n, 0) + own
                    at += own
        out = pd.DataFrame(rows, columns=RESULT)
        return out.astype({"doc_id": "Int64"})

    return merge


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, places: int = OPEN) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    pieces = written(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_packer(tokenizer, length, places), PIECES), "pieces")
    merged = pieces.filter("open").groupBy((F.col("part") / FAN_IN).cast("int")).applyInPandas(
        _merge(length, 1 << 62), ", ".join(f"{c} bigint" for c in RESULT))
    return pieces.filter("not open").select(*RESULT).unionByName(merged)
