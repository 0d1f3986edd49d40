"""Byte-level BPE (operator 9): exact encoding in linear time by longest matches and backtracking.

All vocabulary tokens that occur in a piece come from one Aho-Corasick pass over its bytes, read as Latin-1.
The encoder takes the longest token at each place that is compatible with the token before it, falls back to
shorter ones, and steps back where none fits; places that failed are not entered again. Two tokens are compatible
if merging their joined bytes by rank gives these two tokens again, and an encoding is the one that merging
gives if all neighbours are compatible. Compatibility is remembered for each pair.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
from collections.abc import Callable
from functools import cache
from itertools import chain

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_texts

#: Entries after which a worker's memory of pieces becomes the older generation and a new one starts. Pieces that are tokens
#: themselves are known from the vocabulary and take no part in it. What is remembered changes the speed only.
PIECES = 120_000
#: Entries after which a worker forgets which pairs are compatible.
PAIRS = 300_000


class _Pieces(dict):
    """Ids by piece: all tokens of the vocabulary, pieces met lately, and on a miss the older generation or the encoder."""

    def __init__(self, whole: dict[str, tuple[int, ...]], encode_piece):
        super().__init__(whole)
        self.whole, self.encode_piece, self.older = whole, encode_piece, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:  # longer ones hardly recur
            if len(self) >= len(self.whole) + PIECES:
                self.older = dict(self)
                self.clear()
                self.update(self.whole)
            self[piece] = found
        return found


class BytePairCoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.pieces = regex.compile(pattern)
        self.reach = max(map(len, ranks), default=1)
        self.base = max(self.tokens, default=0) + 1
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter = {i: next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1) for b, i in ranks.items()}
        self.finder = ahocorasick.Automaton()
        whole = {}
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), rank)
            with contextlib.suppress(UnicodeDecodeError):
                whole[token.decode()] = (rank,)
        self.finder.make_automaton()
        self.known = _Pieces(whole, self.encode_piece)

    @classmethod
    def from_rank_file(cls, path: str, pattern: str) -> BytePairCoder:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}, pattern)

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins: merging by rank, the adjacent pair of lowest rank first."""
        found = self.parts.get(token)
        if found is None:
            raw = self.tokens[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 2:
                _, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self.parts[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again.

        Along the seam, the token on the left grows from right halves and the one on the right from left halves. Taking
        back the later of both last merges again and again visits all pairs that ever met at the seam: none of them may
        be a token that would have been merged before.
        """
        key = left * self.base + right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        tokens, until, fits = self.tokens, 1 << 60, True
        while fits:
            joined = self.ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < until:
                fits = False
            elif len(tokens[left]) > 1 and (left > right or len(tokens[right]) == 1):
                until, left = left, self.halves(left)[1]
            elif len(tokens[right]) > 1:
                until, right = right + 1, self.halves(right)[0]  # of equal ranks the merge further left comes first
            else:
                break
        self.pairs[key] = fits
        return fits

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        text, size, shorter, fits, tokens = raw.decode("latin-1"), len(raw), self.shorter, self.compatible, self.tokens
        path: list[int] = []
        before = rank = -1
        for _, rank in self.finder.iter_long(text):  # the longest token at each place
            if before >= 0 and not fits(before, rank):
                break
            path.append(rank)
            before = rank
        else:
            if rank < 0 or sum(len(tokens[x]) for x in path) != size:
                raise ValueError("the vocabulary lacks a byte of this text")
            return tuple(path)
        failed = bytearray(size + 1)
        at = sum(len(tokens[x]) for x in path)
        while True:
            while rank >= 0 and (failed[at + len(tokens[rank])] or (path and not fits(path[-1], rank))):
                rank = shorter[rank]
            if rank < 0:  # no token fits here: back to the token before, which has to be shorter
                failed[at] = 1
                if not path:
                    raise ValueError("the vocabulary lacks a byte of this text")
                last = path.pop()
                at -= len(tokens[last])
                rank = shorter[last]
                continue
            path.append(rank)
            at += len(tokens[rank])
            if at == size:
                return tuple(path)
            _, rank = next(self.finder.iter_long(text[at : at + self.reach]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def _coder(path: str, pattern: str) -> BytePairCoder:
    """One per worker process and vocabulary."""
    return BytePairCoder.from_rank_file(path, pattern)


def encode_documents(documents: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text as the array ``into``; a null text counts as empty.

    ``path``: a rank file that every executor can read. Row-wise: rows and other columns stay (``into`` is
    replaced). Texts of any length are encoded piece by piece of ``pattern``, without special tokens.
    """

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        coder = _coder(path, pattern)
        return pd.Series([coder.encode(x or "") for x in texts], dtype=object)

    bound_batches(documents.sparkSession)
    return documents.withColumn(into, encode(F.col(text)))


def digest_tokens(documents: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes every whole text: ``keep`` columns, ``n_tokens, ids_sha256, decoded_sha256``.

    Works on one text at a time, so the ids of a batch are never held together. Kept columns pass through untouched.
    """

    def start() -> Callable[[str | None], tuple]:
        coder = _coder(path, pattern)

        def digest(value: str | None) -> tuple[int, str, str]:
            ids = coder.encode(value or "")
            listed = " ".join(map(coder.names.__getitem__, ids))
            return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

        return digest

    return map_texts(documents, start, "n_tokens long, ids_sha256 string, decoded_sha256 string", text, keep)
