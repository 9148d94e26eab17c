"""Byte-level BPE by backtracking from longest matches.

Bytes become Latin-1 characters, so that an Aho-Corasick automaton can hold the
vocabulary. One pass of the automaton over the reversed piece gives, for every
position, the longest token that begins there. Encoding takes longest matches from
the left and backs off to shorter ones where two neighbours are not compatible: a pair
is compatible if merging its joined bytes gives exactly that pair, which is decided by
undoing merges at the seam and remembered. A position that failed once is never tried
again, so the work is linear and the result equals that of merging by rank.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Bounded, text_udf


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        whole = set()
        for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
            if len(token) == 1:
                whole.add(rank)
                continue
            pair = self._last_merge(token, rank)
            if pair:
                whole.add(rank)
                self.parts[rank] = pair
                self.joined[pair] = rank
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank in whole:
                self.trie.add_word(token[::-1].decode("latin-1"), len(token))
        self.trie.make_automaton()
        self.whole = whole
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        #: The longest token that is a proper prefix of each token; -1 if there is none.
        self.shorter = {rank: self._shorter(token) for token, rank in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.packed = Bounded(self._piece, limit=400_000)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair that lower-ranked merges leave of a token; None if they never make it."""
        ids = [self.ranks[token[i:i + 1]] for i in range(len(token))]
        while len(ids) > 2:
            best, at = rank, -1
            for i in range(len(ids) - 1):
                made = self.joined.get((ids[i], ids[i + 1]), rank)
                if made < best:
                    best, at = made, i
            if at < 0:
                return None
            ids[at:at + 2] = [best]
        return (ids[0], ids[1])

    def _shorter(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:n], -1)
            if rank in self.whole:
                return rank
        return -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens merge to exactly these two."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two merges that touch the seam, again and again. If the
        # two tokens now at the seam would have merged before it, the pair cannot stand.
        # A merge to the left of another wins a tie of ranks.
        before = (1 << 62, 0)
        while True:
            made = self.joined.get((a, b))
            if made is not None and (made, 0) < before:
                return False
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                return True
            if pb is None or (pa is not None and a > b):
                before, a = (a, 0), pa[1]
            else:
                before, b = (b, 1), pb[0]

    def _merge(self, data: bytes) -> list[int]:
        n = len(data)
        longest = [0] * n
        last = n - 1
        for end, size in self.trie.iter(data[::-1].decode("latin-1")):
            if size > longest[last - end]:
                longest[last - end] = size
        ranks, shorter, size_of, fits = self.ranks, self.shorter, self.size_of, self.fits
        ids: list[int] = []
        dead: set[int] = set()
        at, left = 0, -1
        token = ranks[data[:longest[0]]]
        while True:
            end = at + size_of[token]
            if end not in dead:
                good = left < 0 or fits.get((left, token))
                if good is None:
                    good = self.compatible(left, token)
                if good:
                    ids.append(token)
                    if end == n:
                        return ids
                    at, left = end, token
                    token = ranks[data[at:at + longest[at]]]
                    continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                back = ids.pop()
                at -= size_of[back]
                left = ids[-1] if ids else -1
                token = shorter[back]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else self._merge(data)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded binary) per row; no shuffle.

    Null texts encode as empty ones, to no ids. Repeated rows are encoded each, whole.
    """

    def make():
        codec = load(path, pattern)

        def one(t: str) -> tuple:
            ids = codec.encode(t)
            return (ids, codec.decode(ids))

        return one

    run = text_udf(make, "ids binary, decoded binary")
    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("e")).select(
        "doc_id", "e.ids", "e.decoded"
    )
