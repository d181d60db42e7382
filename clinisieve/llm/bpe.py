"""Byte-level BPE by backtracking over longest matches.

A sequence of tokens is the result of the merges exactly if every two neighbours of it are: their
bytes, merged together, give the two again.  So a piece is encoded without running its merges: take
the longest token at the current place, and accept it if it fits its left neighbour; else try its
longest proper prefix that is a token; if none is left, drop the neighbour, remember that its end is
a dead end, and go on with its prefixes.  Each place dies once at most, so the time is linear.  Longest matches come from
an Aho-Corasick automaton over the bytes as Latin-1 characters, and whether two tokens fit is
memoised.  Every match of the splitting pattern is encoded by itself; a match that is a token as a
whole is that token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinisieve.llm.common import slices

#: Pieces that a worker keeps the ids of, twice over (new and older), also while it does other work, and half as many pairs
#: of neighbours; what is forgotten is found anew, which changes the time only.
MEMO = 1 << 17
MEMO_LENGTH = 64
#: Characters from which on a text is split piece by piece.
LONG = 1 << 20
#: Pieces that are put together, or ids that are turned back, at a time.
_AT_ONCE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Memo(dict):
    """Results of a function by its argument: when there are ``MEMO // share`` new ones, they become the older ones, and those go that were older."""

    def __init__(self, of: Callable, share: int = 1):
        super().__init__()
        self.of, self.share = of, share
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.of(key)
            if isinstance(key, str) and len(key) > MEMO_LENGTH:
                return found
        if len(self) >= MEMO // self.share:
            self.older = self.copy()
            self.clear()
        self[key] = found
        return found


class ByteBPE:
    """Encoder for a table of ranks (bytes of a token to its id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        # Arrays hold numbers side by side; as objects all over a worker's memory, they would take several times as long to reach.
        n = max(ranks.values()) + 1
        self.size_of, self.shorter, self.left, self.right = (array("i", [-1]) * n for _ in range(4))
        # A token that merges cannot make stands for itself only as a whole piece.
        made: dict[bytes, int] = {}
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)
            if len(token) == 1:
                made[token] = rank
            elif len(parts := self._merge(token, 2)) == 2:
                left, right = (ranks[p] for p in parts)
                if max(left, right) > rank:
                    raise ValueError(f"token {rank} ranks before its parts")
                self.left[rank], self.right[rank] = left, right
                self.merged[left << 32 | right] = rank
                made[token] = rank
        # Single bytes match everywhere, so the automaton does not look for them.
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in made.items():
            self.shorter[rank] = next((made[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in made), -1)
            if len(token) > 1:
                self.longest.add_word(token.decode("latin-1"), rank)
        self.longest.make_automaton()
        self.fitting = Memo(lambda pair: self._fit(pair >> 32, pair & 0xFFFFFFFF), share=2)
        self.known = Memo(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes())

    def _merge(self, piece: bytes, leave: int = 1) -> list[bytes]:
        """The merges one by one, lowest rank first, until ``leave`` parts are left; for tokens only."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > leave:
            ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranked if r is not None), default=None)
            if best is None:
                break
            at = ranked.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether merges leave the two tokens as they are when they stand side by side.

        Ranks of merges never fall, so both tokens grow as if alone until the parts that touch merge:
        that is so if their own rank comes before those that take them up (of equal ranks the left one does).
        """
        return self.fitting[left << 32 | right]

    def _fit(self, left: int, right: int) -> bool:
        """The merges of both tokens undone at their common edge, the last one first.

        Parts whole before they touch others merge into a token only if they are its halves.
        """
        merged, halves_left, halves_right = self.merged.get, self.left, self.right
        left_until = right_until = 1 << 32
        while True:
            crossing = merged(left << 32 | right)
            if crossing is not None and crossing < left_until and crossing <= right_until:
                return False
            last, first = halves_right[left], halves_left[right]
            if last >= 0 and (left > right or first < 0):
                left, left_until = last, left
            elif first >= 0:
                right, right_until = first, right
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, size_of, shorter_than, fitting = len(piece), self.size_of, self.shorter, self.fitting
        longest = list(map(self.single.__getitem__, piece))
        for end, rank in self.longest.iter(piece.decode("latin-1")) if self.merged else ():
            longest[end + 1 - size_of[rank]] = rank  # matches come by ascending end
        alive = bytearray(b"\x01") * (size + 1)
        at, token, ids = 0, longest[0], []
        while True:
            end = at + size_of[token]
            if alive[end] and (not ids or fitting[ids[-1] << 32 | token]):
                ids.append(token)
                if end == size:
                    return ids
                at, token = end, longest[end]
                continue
            shorter = shorter_than[token]
            while shorter < 0:  # nothing fits here: this place is a dead end
                alive[at] = 0
                token = ids.pop()
                at -= size_of[token]
                shorter = shorter_than[token]
            token = shorter

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text one by one."""
        for part in self.encode_parts(text):
            yield from array("i", part)

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """The ids of a text as 32-bit numbers in a row, in parts; the pieces of a long text are not listed beforehand."""
        found = iter(self.pattern.findall(text)) if len(text) < LONG else (m[0] for m in self.pattern.finditer(text))
        while part := b"".join(map(self.known.__getitem__, islice(found, _AT_ONCE))):
            yield part


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec per worker; the vocabulary file must be readable under this path on every machine."""
    return ByteBPE(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def tokenized(df: DataFrame, text_col: str, path: str, pattern: str) -> DataFrame:
    """``df`` with ``ids``, the token ids of a text as array<int>, and ``decoded``, the bytes they stand for.

    Null and empty texts give no ids and no bytes; rows alike are each worked on, and an empty table gives an empty table.  Columns that ``df`` has by these names are replaced.
    Rows are worked on in parts of bounded size, however long the texts.
    """
    df = df.drop("ids", "decoded")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec(path, pattern)
        table = pa.array(map(encoder.bytes_of.get, range(len(encoder.size_of))), pa.binary())
        for part in (p for batch in batches for p in slices(batch, at)):
            ids, ends = array("i"), [0]
            for text in part.column(at):
                if text.is_valid:
                    for piece in encoder.encode_parts(text.as_py()):
                        ids.frombytes(piece)
                ends.append(len(ids))
            numbers = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            # The bytes of all ids lie in a row; those of a text end where those of its last id do.
            _, at_id, joined = table.take(numbers).buffers()
            at_row = np.frombuffer(at_id, np.int32, len(ids) + 1)[ends] if len(ids) else np.zeros(len(ends), np.int32)
            back = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at_row), joined])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), numbers)
            yield pa.RecordBatch.from_arrays([*part.columns, tokens, back], [*part.schema.names, "ids", "decoded"])

    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return df.mapInArrow(run, schema)


def decoded(ids: Sequence[int], table: dict[int, bytes]) -> bytes:
    return b"".join(b"".join(map(table.__getitem__, ids[at:at + _AT_ONCE])) for at in range(0, len(ids), _AT_ONCE))


def decode(ids: Column, path: str) -> Column:
    """The bytes that token ids (array<int>) stand for; null gives no bytes, an unknown id an error."""
    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        table = token_bytes(path)
        # A row at a time: as Python numbers, all ids of a batch would take ten times their room.
        return pa.array([decoded(x.values.to_numpy().tolist(), table) if x.is_valid else b"" for x in column], pa.binary())
    return of(ids)
