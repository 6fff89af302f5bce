"""Operator 9: packing by power-of-two decomposition.

A document of n tokens (its end token included) is cut into pieces whose lengths are
the powers of two that sum to n, the longest first, with as many pieces of the full
length as fit. Equal lengths share a bucket; each piece is a sequence of its own, so
no sequence crosses documents and, at a power of two, none is padded.

A sequence's number holds its bucket in the low four bits, so a reader can select a
bucket; the rest is unique for the row and piece.

Defined cases: a null text counts as empty and gives one piece that holds the end token;
repeated rows, and different texts of equal length, are packed each; rows with a null id are packed like
others; a text is packed whole, whatever its length; an empty table gives an empty result; columns beside
id and text are never read, so others may have any name.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import prepare

FULL, END = 2048, 1
#: The first code point without an entry in kinds(), and the kind of those that are left to the library.
BEYOND, UNKNOWN = 0x20000, 4
_loaded: dict[str, Encoder] = {}


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def kinds() -> np.ndarray:
    """Of each code point below BEYOND: 0 white space, 1 letter, 2 number, 3 anything else; UNKNOWN where the
    library may know more, as points that this Python has as unassigned; the last entry stands for all beyond."""
    out = np.full(BEYOND + 1, 3, np.uint8)
    out[-1] = UNKNOWN
    for p in range(BEYOND):
        c = chr(p)
        k = unicodedata.category(c)
        if k == "Cn":
            out[p] = UNKNOWN
        elif k[0] == "L":
            out[p] = 1
        elif k[0] == "N":
            out[p] = 2
        elif c.isspace() and not "\x1c" <= c <= "\x1f":
            out[p] = 0
    return out


class Encoder:
    """Ids by a lower-casing word-level BPE file whose tokens end words with a mark.

    The library that the file is for merges slowly; the same merges run in tiktoken. Its
    alphabet has two signs for each byte, inside a word and at its end, written as
    code points of two bytes that merge before all else; so a token's number is its
    rank there too. Where words end is found for a whole text at once. Texts with
    special strings or, once normalised, characters that kinds() doesn't know go to the library itself.
    """

    SIGNS = 0x100  # the first code point of the alphabet; a sign at a word's end is 256 further

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark, symbols = "</w>", byte_symbols()
        index = {c: i for i, c in enumerate(symbols)}
        ranks: dict[bytes, int] = {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token in self.special:
                continue
            ends = token.endswith(mark) and token != mark
            body = token.removesuffix(mark) if ends else token
            signs = [self.SIGNS + index[c] for c in body]
            if ends:
                signs[-1] += 256
            ranks["".join(map(chr, signs)).encode()] = number
        top = max(ranks.values()) + 1
        for b in range(256):
            ranks.setdefault(bytes([b]), top + b)
        a, z = self.SIGNS, self.SIGNS + 256
        self.merge = tiktoken.Encoding("words", pat_str=f"[\\u{{{a:x}}}-\\u{{{a + 255:x}}}]*[\\u{{{z:x}}}-\\u{{{z + 255:x}}}]", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kind = kinds()

    def ends(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Which code points are white space, and which are the last of a word of the file's pattern; None if a point is unknown."""
        kind = self.kind[np.minimum(points, BEYOND)]
        if kind.max(initial=0) == UNKNOWN:
            return None
        after = np.append(kind[1:], 0)
        end = (kind != 0) & ((kind == 2) | (kind != after))
        quote = np.flatnonzero((points == 39) & (np.append(0, kind[:-1]) != 3) & (after == 1))
        for q in quote.tolist():
            tail = "".join(map(chr, points[q + 1 : q + 3].tolist()))
            n = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
            if n:  # a contraction is one word
                end[q], end[q + n] = False, True
        return kind == 0, end

    def signs(self, text: str) -> str | None:
        """The text in the alphabet of the merges; None if it holds an unknown code point."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()
        raw = np.frombuffer(text.encode(), np.uint8)
        if text.isascii():
            blank, end = self.ends(raw.astype(np.uint32))
        else:
            found = self.ends(np.frombuffer(text.encode("utf-32-le"), np.uint32))
            if found is None:
                return None
            blank, end = found
            first = np.flatnonzero((raw & 0xC0) != 0x80)
            size = np.diff(np.append(first, len(raw)))
            blank = np.repeat(blank, size)
            last = first + size - 1
            wide = np.zeros(len(raw), bool)
            wide[last[end]] = True
            end = wide
        return (raw.astype(np.uint16) + self.SIGNS + 256 * end.astype(np.uint16))[~blank].tobytes().decode("utf-16-le")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """32-bit ids of each text with the end token."""
        out = []
        for text in texts:
            signs = None if any(s in text for s in self.special) else self.signs(text)
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids if signs is None else self.merge(signs)
            ids.append(END)
            out.append(np.array(ids, "<u4"))
        return out


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def lengths(n: int, full: int = FULL) -> list[int]:
    """Powers of two that sum to n, none above full, the longest first."""
    return [full] * (n // full) + [1 << k for k in range(full.bit_length() - 2, -1, -1) if n % full >> k & 1]


LAYOUT = "start long, length long, ids_crc32 long, doc_tokens long, offset long, ids array<int>"


def pack(docs: DataFrame, path: str, full: int = FULL, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the piece's ids."""
    if full & (full - 1):
        raise ValueError("the full length must be a power of two")
    prepare(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    layout = LAYOUT if with_ids else LAYOUT.removesuffix(", ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, x in enumerate(encode([t.as_py() or "" for t in part.column(text_column)])):
                    begin = 0
                    for n in lengths(len(x), full):
                        row.append(i)
                        start.append(begin)
                        length.append(n)
                        crc.append(zlib.crc32(x[begin : begin + n]))
                        begin += n
                    total += [len(x)] * (len(row) - len(total))
                    if with_ids:
                        ids.append(x)
                r = pa.array(row, pa.int64())
                columns = [part.column(id_column).take(r), *(pa.array(c, pa.int64()) for c in (start, length, crc, total)), pa.array([0] * len(row), pa.int64())]
                if with_ids:
                    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, *(x.split()[0] for x in layout.split(", "))])

    pieces = docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {layout}")
    number = F.monotonically_increasing_id() * 16 + F.length(F.bin("length")) - 1
    return pieces.select(id_column, "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
