"""Sum-of-squares online packing of documents into token windows.

A level array counts the open windows at every fill level. A document goes to the level
where the sum of the squares of these counts grows least, which keeps the levels spread
so that later documents find a window to fill to the brim. Only open windows are held.
Documents longer than a window fill whole windows first, and only their rest is placed.
When a part of the corpus ends, or too many windows are open, the open ones are poured
together, cutting at the brim; what remains at the very end becomes windows whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm.common import Bounded, byte_alphabet

WINDOW = 2048
#: Open windows of one task after which they are poured together.
OPEN = 4096


def _class(kind: str) -> str:
    """The letters (L) or numbers (N) below U+0250, for a set of a regular expression."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: How the vocabulary cuts Latin text once white space is gone: a run of letters, one
#: number, one of seven endings, a run of anything else (fixed by its file).
PATTERN = (
    f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|"
    f"[^\\t-\\r \\x85\\xa0{_class('L')}{_class('N')}]+"
)
#: Beyond these letters, or with a dotted capital I, lower case may need the library.
_OUTSIDE = re.compile("[^\x00-įı-ɏ]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def encoder(path: str):
    """Function text -> ids as little-endian unsigned 32-bit integers.

    White space separates tokens in this vocabulary and is dropped, so the pieces
    between it encode alone as they do within the text. Latin text without special
    tokens is lower-cased and cut here by the vocabulary's own pattern, and only the
    merges of each different word are the library's; other text is the library's whole.
    """
    tokenizer = _tokenizer(path)
    words = re.compile(PATTERN).findall
    alphabet = {b: c for c, b in byte_alphabet().items()}
    merge = tokenizer.model.tokenize

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(s: str) -> bytes:
        if not (s.isascii() and s.isalpha()):  # letters stand for themselves
            s = s.encode("utf-8").decode("latin-1").translate(alphabet)
        return packed([t.id for t in merge(s)])

    merged = Bounded(word)
    other = Bounded(lambda s: packed(tokenizer.encode(s, add_special_tokens=False).ids))

    def encode(text: str) -> bytes:
        if "<|" not in text and not _OUTSIDE.search(text):
            # Here each letter has one lower case, and no two letters compose.
            return b"".join(map(merged.__getitem__, words(text.lower())))
        # These four are white space to ``split`` only.
        parts = re.split("[ \t\r\n]+", text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(other.__getitem__, parts))

    return encode


class Packer:
    """Windows of one task. ``out`` gathers rows (item, start, ids, window, offset)."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.total = 0
        self.made = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for item, start, ids in pieces:
            self.out.append((item, start, ids, self.made, offset))
            offset += len(ids) // 4
        self.made += 1

    def level_for(self, size: int) -> int:
        """The level that adds least to the sum of squares; the fullest of equals."""
        w, counts = self.window, self.counts
        if size == w:
            return 0
        have = np.flatnonzero(counts[1:w - size + 1]) + 1
        best, at = 2 * int(counts[size]) + 1, 0
        if len(have):
            after = counts[have + size]
            growth = 2 * (after - counts[have]) + 2
            growth[have + size == w] = 1 - 2 * counts[w - size]
            i = len(have) - 1 - int(np.argmin(growth[::-1]))
            if growth[i] <= best:
                at = int(have[i])
        return at

    def add(self, item, ids: bytes) -> None:
        """Place one document's ids; ``item`` comes back with each piece."""
        step, start = self.window * 4, 0
        while len(ids) - start >= step:
            self._close([(item, start // 4, ids[start:start + step])])
            start += step
        rest = ids[start:] if start else ids
        size = len(rest) // 4
        if not size:
            return
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
            self.total -= 1
        else:
            pieces = []
        pieces.append((item, start // 4, rest))
        if level + size == self.window:
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.total += 1
        if self.total > OPEN:
            self.pour(last=False)

    def pour(self, last: bool = True) -> None:
        """Fill the open windows with one another; at last, cut the rest by powers of two."""
        stream = [p for level in range(self.window - 1, 0, -1) for w in self.open[level] for p in w]
        left = sum(len(ids) for _, _, ids in stream) // 4
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.total = 0
        sizes = [self.window] * (left // self.window)
        rest = left % self.window
        if last:
            sizes += [1 << b for b in range(self.window.bit_length(), -1, -1) if rest >> b & 1]
        pieces, room, k = [], sizes[0] if sizes else 0, 0
        keep: list = []
        for item, start, ids in stream:
            while ids and room:
                part = ids[:room * 4]
                pieces.append((item, start, part))
                room -= len(part) // 4
                start += len(part) // 4
                ids = ids[len(part):]
                if not room:
                    self._close(pieces)
                    pieces, k = [], k + 1
                    room = sizes[k] if k < len(sizes) else 0
            if ids:
                keep.append((item, start, ids))
        if keep:
            self.open[rest].append(keep)
            self.counts[rest] = self.total = 1


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end: int = 1,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) per piece.

    A document is the ids of its whole text and then ``end``; null texts count as empty,
    so each document has a piece. Every id lies in exactly one piece. Rows with equal or
    no numbers are documents of their own. Each part of the input is packed by its task
    alone: nothing is shuffled, and lost tasks repeat the same windows. A sequence's
    number is the part's number and a count within it. An empty table gives no piece.
    """
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, stop = encoder(path), Packer(window), np.array([end], dtype="<u4").tobytes()
        part, numbers_type = 0, None

        def rows() -> Iterator[pa.RecordBatch]:
            done, packer.out = packer.out, []
            for lo in range(0, len(done), 20_000):
                some = done[lo:lo + 20_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0][0] for r in some], numbers_type),
                    pa.array([r[1] for r in some], pa.int64()),
                    pa.array([len(r[2]) // 4 for r in some], pa.int64()),
                    pa.array([r[2] for r in some], pa.binary()),
                    pa.array([r[0][1] for r in some], pa.int64()),
                    pa.array([(part << 33) + r[3] for r in some], pa.int64()),
                    pa.array([r[4] for r in some], pa.int64()),
                ], names=schema.fieldNames())

        for batch in batches:
            numbers, texts, parts = batch.columns
            numbers_type = numbers.type
            for number, text_scalar, at in zip(numbers.to_pylist(), texts, parts.to_pylist()):
                part = at
                ids = encode(text_scalar.as_py() or "") + stop
                packer.add((number, len(ids) // 4), ids)
                if len(packer.out) >= 20_000:
                    yield from rows()
        packer.pour()
        yield from rows()

    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part")
    ).mapInArrow(run, schema)
