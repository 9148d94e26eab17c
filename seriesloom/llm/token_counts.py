"""Token counts with a whole-token shortcut.

Most words of a text are one token. Which vocabulary strings encode alone as that one
token is proven once per worker, by encoding each of them; a matching piece of a text
then counts 1 without any merging. Only the other pieces are merged, by the library.
"""

from __future__ import annotations

import functools
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import Bounded, byte_alphabet, text_udf

#: Code points whose class (letter, number, space) is the same in every Unicode version
#: that the two regular-expression libraries use; other texts are cut by the tokenizer.
_UNSAFE = re.compile("[^\x00-՗ -⁰ぁ-鿿가-힣]")


@functools.lru_cache(maxsize=4)
def load(path: str):
    """(tokenizer, pieces proven to be one token, special strings)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    # Text of each vocabulary string: the byte alphabet maps each byte to one character.
    to_byte = byte_alphabet()
    texts = {}
    for name, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if name in special:
            continue
        try:
            texts[bytes(to_byte[c] for c in name).decode("utf-8")] = number
        except (KeyError, UnicodeDecodeError):
            continue  # parts of characters never are whole pieces
    keys = list(texts)
    codes = tokenizer.encode_batch(keys, add_special_tokens=False)
    proven = {k for k, e in zip(keys, codes) if e.ids == [texts[k]]}
    return tokenizer, proven, sorted(special, key=len, reverse=True)


def counter(path: str, pattern: str):
    """Function text -> number of tokens, equal to the tokenizer's own."""
    tokenizer, proven, special = load(path)
    pieces = regex.compile(pattern).findall
    cut = re.compile("|".join(map(re.escape, special))) if special else None

    alphabet = {b: c for c, b in byte_alphabet().items()}
    merge = tokenizer.model.tokenize

    def merged(piece: str) -> int:
        if piece in proven:
            return 1
        return len(merge(piece.encode("utf-8").decode("latin-1").translate(alphabet)))

    cost = Bounded(merged)

    def count(text: str) -> int:
        if not text:
            return 0
        if _UNSAFE.search(text):
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        parts, n = [text], 0
        if cut and cut.search(text):
            parts = cut.split(text)
            n = len(parts) - 1
        return n + sum(sum(map(cost.__getitem__, pieces(p))) for p in parts)

    return count


def count_tokens(
    docs: DataFrame, path: str, pattern: str, limit: int = 512,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; no shuffle.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows are counted each.
    A special token's string inside a text is that one token, as the library's default.
    Texts are never cut short; a piece of any length is merged in near-linear time.
    """

    def make():
        count = counter(path, pattern)
        return lambda t: (len(t.encode("utf-8")), count(t))

    counts = text_udf(make, "n_bytes long, n_tokens long")
    return (
        docs.select(F.col(doc_id).alias("doc_id"), counts(F.col(text)).alias("c"))
        .select("doc_id", "c.n_bytes", "c.n_tokens")
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )
