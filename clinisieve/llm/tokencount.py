"""Token counts by a tokenizer compiled to a finite-state transducer.

The merges of a word-end BPE become a deterministic transducer over bytes.  A prefix of a word ends
in one certain last token; a state is the node of an Aho-Corasick automaton over all tokens, together with the last
tokens of the prefixes that a later token can still begin after.  A transition finds the one token
that ends here and fits the token before it, and is annotated with the number of tokens that it adds to
the prefix's count (it may be negative, as a longer token can replace several).  The last byte of a
word is a symbol of its own, which ends the word and goes back to the start.  States and transitions are compiled when they are
first met and then looked up; a whole word met before is one transition.

Long texts are cut into stretches that are worked on in parallel.  A stretch becomes a state map:
from the state at its left edge to the tokens it adds and the state at its right edge.  Cuts fall before white space
or a digit, where every word ends and the map is a constant.  In a text without such a place they fall
inside a word; then the map is worked out for the state that the bytes before the cut lead to, and keeps
the opening word's bytes to be exact for any other state.  Maps compose associatively: Spark composes them in
groups of neighbours, round by round, to one map for each text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from clinisieve.llm.common import fresh, slices
from clinisieve.sources.scratch import written

#: Characters of a stretch, at least.
STRETCH = 1 << 16
#: Neighbouring maps that one task composes.
NEIGHBOURS = 64
#: Words, transitions and states that a worker remembers; full memos are emptied, which changes the time only.
MEMO, MEMO_LENGTH = 400_000, 64
#: Characters before a cut inside a word whose bytes give the state that is tried first.
WARM_UP = 64
END = 256
#: Letters first, as most words begin with one: no other alternative can begin there, so the order changes the time only.
WORD = r"{letter}+|{number}|'(?:[stmd]|re|ve|ll)|[^\s{others}]+"
#: A cut before one of these is outside of all words.
SOFT = re.compile(r"[ \t\n\r0-9]")
#: A cut here is within a word, or where a soft one is.
ANY_CUT = re.compile(r"[ \t\n\r0-9]|(?<=[A-Za-z]{4})(?=[A-Za-z])|(?<=[一-鿿])(?=[一-鿿])|(?<=[=_*.~#+-]{2})(?=[=_*.~#+-])")

State = tuple[int, ...]


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of words; ``merges`` has the parts of each token but the single symbols, by rank."""

    def __init__(self, singles: list[int], merges: list[tuple[tuple[int, ...], tuple[int, ...]]]):
        token_of: dict[tuple[int, ...], int] = {(s,): n for n, s in enumerate(singles)}
        self.rank_of: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for left, right in merges:
            token = token_of.setdefault(left + right, len(token_of))
            pair = token_of[left], token_of[right]
            if pair in self.rank_of or token in self.parts:
                raise ValueError("a token has several merges")
            # Tokens are numbered by rank, so a merge ranks as its token does.
            self.rank_of[pair], self.parts[token] = token, pair
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton({s: t for s, t in token_of.items() if self._can_be_made(t)})
        self.start: State = (0, -1, 0)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[State, int] = {self.start: 0}
        self.states: list[State] = [self.start]
        self.moves: dict[int, tuple[int, int]] = {}

    def _automaton(self, tokens: dict[tuple[int, ...], int]) -> None:
        """Aho-Corasick over sequences of symbols; ``ends`` lists the tokens that end at a node, longest first."""
        self.goes: list[dict[int, int]] = [{}]
        self.depth, ending = [0], {}
        for symbols, token in tokens.items():
            node = 0
            for s in symbols:
                following = self.goes[node].get(s)
                if following is None:
                    following = self.goes[node][s] = len(self.goes)
                    self.goes.append({})
                    self.depth.append(self.depth[node] + 1)
                node = following
            ending[node] = (token, len(symbols))
        self.back = [0] * len(self.goes)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.goes)
        level = [0]
        while level:
            below = []
            for node in level:
                for s, child in self.goes[node].items():
                    if node:
                        self.back[child] = self._go(self.back[node], s)
                    own = ((ending[child]),) if child in ending else ()
                    self.ends[child] = own + self.ends[self.back[child]]
                    below.append(child)
            level = below

    def _go(self, node: int, symbol: int) -> int:
        while symbol not in self.goes[node]:
            if not node:
                return 0
            node = self.back[node]
        return self.goes[node][symbol]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts at one edge of a token while it grows, each with the rank of the merge that ends it."""
        grown, until = [], float("inf")
        while True:
            grown.append((token, until))
            if token not in self.parts:
                return grown[::-1]
            token, until = self.parts[token][side], token

    def _fit(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``before`` takes place across the border of two tokens."""
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            crossing = self.rank_of.get((x, y))
            # At equal ranks the merge further left comes first.
            if crossing is not None and crossing < before and crossing < x_until and crossing <= y_until:
                return False
            if x_until <= y_until:
                if x_until == float("inf"):
                    return True
                i += 1
            else:
                j += 1

    def _can_be_made(self, token: int) -> bool:
        if token not in self.parts:
            return True
        return all(map(self._can_be_made, self.parts[token])) and self._fit(*self.parts[token], before=token)

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            known = self._fits[left, right] = self._fit(left, right)
        return known

    def _compile(self, state: State, symbol: int) -> tuple[State, int]:
        """The transition from a state: the state after it, and the tokens it adds."""
        node = self._go(state[0], symbol)
        for token, length in self.ends[node]:
            left, count = state[2 * length - 1], state[2 * length]
            if left < 0 or self.fits(left, token):
                break
        adds = count + 1
        if symbol >= END:
            return self.start, adds
        kept = state[1:1 + 2 * self.depth[node]]
        older = [x - adds if i % 2 else x for i, x in enumerate(kept)]
        return (node, token, 0, *older), adds

    def run(self, state: State, word: bytes, closes: bool) -> tuple[State, int]:
        """(state after, tokens added) of a word's bytes from a state; ``closes`` if the word ends with them."""
        if len(self.moves) >= MEMO:
            self._reset()
        at, added, last = self._numbered(state), 0, len(word) - 1
        moves = self.moves
        for i, byte in enumerate(word):
            symbol = byte + END if closes and i == last else byte
            move = moves.get(at << 9 | symbol)
            if move is None:
                after, adds = self._compile(self.states[at], symbol)
                move = moves[at << 9 | symbol] = self._numbered(after), adds
            at, adds = move
            added += adds
        return self.states[at], added

    def _numbered(self, state: State) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number


class Known(dict):
    """The token counts of words met before; others are counted by ``count``."""

    def __init__(self, count: Callable[[str | bytes], int]):
        super().__init__()
        self.count = count

    def __missing__(self, word: str | bytes) -> int:
        found = self.count(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


class Counter:
    """Counts tokens as the tokenizer of a file would: normalised, split into words, special strings one token each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]] + [s["type"] for s in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("not a lower-case byte-level BPE with word ends")
        byte_of = byte_symbols()

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix)
            own = [byte_of[c] for c in (token[:-len(suffix)] if ends else token)]
            return (*own[:-1], own[-1] + END) if ends else tuple(own)

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.transducer = Transducer(list(range(2 * END)), [(symbols(a), symbols(b)) for a, b in pairs])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.special_size = max((len(t["content"]) for t in spec["added_tokens"]), default=0)
        self.of_ascii = re.compile(WORD.format(letter="[a-z]", number="[0-9]", others="a-z0-9"), re.ASCII).findall
        self.of_text = regex.compile(WORD.format(letter=r"\p{L}", number=r"\p{N}", others=r"\p{L}\p{N}")).findall
        self.library, self.byte_of = Tokenizer.from_file(path), byte_of
        self.assigned: set[str] = set()
        self.known = Known(lambda word: self.transducer.run(self.transducer.start, as_bytes(word), True)[1])

    def words(self, text: str) -> list[str] | list[bytes]:
        """The words of a text without special strings."""
        if text.isascii():
            return self.of_ascii(text.lower())
        if self._has_unknown(text):
            # Characters newer than this Python's tables: the library knows which of them are letters.
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in pieces]
        # One character at a time: Python would make another letter of a sigma at a word's end.
        return self.of_text(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _has_unknown(self, text: str) -> bool:
        """Whether a text has characters that this Python's Unicode tables do not know."""
        new = set(text) - self.assigned
        unknown = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - unknown
        return bool(unknown)

    def stretch(self, text: str, opens: bool = False, stays_open: bool = False, before: str = "") -> dict:
        """The state map of a stretch; ``opens`` and ``stays_open`` if a word goes over its left and right edge.

        ``before`` is what stands in front of the stretch, for the state that is tried first.
        """
        parts = self.special.split(text)
        lists = [self.words(p) for p in parts]
        count, machine = len(parts) - 1, self.transducer
        found = {"opens": opens, "entry": None, "head": None, "head_count": 0, "through": False, "exit": None}
        first = last = None
        if opens:
            first, lists[0] = lists[0][0], lists[0][1:]
        if stays_open and any(lists[-1:]):
            last, lists[-1] = lists[-1][-1], lists[-1][:-1]
        if opens:
            entry = machine.run(machine.start, as_bytes(self.words(before)[-1]), False)[0]
            through = stays_open and last is None
            state, added = machine.run(entry, as_bytes(first), not through)
            found |= {"entry": list(entry), "head": as_bytes(first), "head_count": added, "through": through, "exit": list(state) if through else None}
            count += added
        if last is not None:
            state, added = machine.run(machine.start, as_bytes(last), False)
            found["exit"] = list(state)
            count += added
        return found | {"count": count + sum(sum(map(self.known.__getitem__, words)) for words in lists)}

    def cuts(self, text: str) -> Iterator[tuple[int, bool]]:
        """Where the stretches of a text end, and whether within a word."""
        at = 0
        while len(text) - at > 2 * STRETCH:
            place = SOFT.search(text, at + STRETCH, at + 2 * STRETCH)
            if place is None:
                near = self.special_size
                place = next((m for m in ANY_CUT.finditer(text, at + STRETCH) if m.group() or not any(
                    s.start() < m.start() < s.end() for s in self.special.finditer(text, max(0, m.start() - near), m.start() + near))), None)
                if place is None:
                    return
            at = place.start()
            yield at, not place.group()

    def stretches(self, text: str) -> Iterator[tuple[str, bool, bool, str]]:
        """(text, opens, stays open, what stands before) of every stretch."""
        start, opens = 0, False
        for stop, within in [*self.cuts(text), (len(text), False)]:
            yield text[start:stop], opens, within, text[max(0, start - WARM_UP):start] if opens else ""
            start, opens = stop, within

    def composed(self, a: dict, b: dict) -> dict:
        """The map of two neighbouring stretches."""
        out = {k: a[k] for k in ("opens", "entry", "head", "head_count")} | {"through": False, "exit": b["exit"]}
        added, count = b["head_count"], b["count"]
        if b["opens"]:
            if list(a["exit"]) != list(b["entry"]):  # another state than was tried
                state, added = self.transducer.run(tuple(a["exit"]), b["head"], not b["through"])
                count += added - b["head_count"]
                if b["through"]:
                    out["exit"] = list(state)
            if a["through"]:
                out |= {"head": a["head"] + b["head"], "head_count": a["head_count"] + added, "through": b["through"]}
        return out | {"count": a["count"] + count}


def as_bytes(word: str | bytes) -> bytes:
    return word if isinstance(word, bytes) else word.encode()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker; the file must be readable under this path on every machine."""
    return Counter(path)


_MAP = "opens boolean, entry array<int>, head binary, head_count bigint, through boolean, exit array<int>, count bigint"
_MAP_TYPE = pa.schema([("opens", pa.bool_()), ("entry", pa.list_(pa.int32())), ("head", pa.binary()), ("head_count", pa.int64()),
                       ("through", pa.bool_()), ("exit", pa.list_(pa.int32())), ("count", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch], at: int, path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for part in (p for batch in batches for p in slices(batch, at)):
        counts = [own.stretch(t.as_py())["count"] if t.is_valid else 0 for t in part.column(at)]
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), pa.array(counts, pa.int64())],
                                         [*(n for i, n in enumerate(part.schema.names) if i != at), "n_tokens"])


def _stretch_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(row, n, text, opens, stays_open, before) of (row, text)."""
    own = counter(path)
    for batch in batches:
        for row, text in zip(*batch.columns, strict=True):
            for n, (piece, opens, within, before) in enumerate(own.stretches(text.as_py())):
                yield pa.RecordBatch.from_pydict({"row": [row.as_py()], "n": [n], "text": [piece], "opens": [opens], "stays_open": [within], "before": [before]})


def _map_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1).to_pylist()[0]
            found = own.stretch(one["text"], one["opens"], one["stays_open"], one["before"])
            yield _maps([one["row"]], [one["n"]], [found])


def _maps(rows: list[int], numbers: list[int], maps: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([m[f.name] for m in maps], f.type) for f in _MAP_TYPE]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(numbers, pa.int64()), *columns], ["row", "n", *_MAP_TYPE.names])


def _composer(path: str) -> Callable[[pa.Table], pa.Table]:
    def compose(group: pa.Table) -> pa.Table:
        own = counter(path)
        maps = group.sort_by("n").to_pylist()
        whole = maps[0]
        for m in maps[1:]:
            whole = own.composed(whole, m)
        return pa.Table.from_batches([_maps([maps[0]["row"]], [maps[0]["n"] // NEIGHBOURS], [whole])])
    return compose


def token_counts(df: DataFrame, text_col: str, path: str) -> DataFrame:
    """``df`` with ``n_tokens`` in place of the text.

    Null and empty texts have no tokens.  Strings of special tokens count one each; none are added.
    A column ``n_tokens`` that ``df`` has is replaced.  Repeated rows are counted each.  An empty table gives
    an empty table.  Texts of over two stretches are cut and counted in parallel; their other columns are shuffled
    once.  A text whose stretch has no place to cut, as 65,536 characters of a script other than Latin or
    Han without white space or digit, is one stretch.
    """
    df = df.drop("n_tokens") if text_col != "n_tokens" else df
    others = [c for c in df.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    is_long = F.coalesce(F.octet_length(text) > 2 * STRETCH, F.lit(False))
    at = df.columns.index(text_col)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text_col), T.StructField("n_tokens", T.LongType())])
    short = df.where(~is_long).mapInArrow(lambda b: _counted(b, at, path), schema)

    row, found_row = fresh(df, "row"), fresh(df, "found_row")
    numbered = df.where(is_long).withColumn(row, F.monotonically_increasing_id())
    numbered = written(numbered)  # the numbers are read twice
    pieces = numbered.select(row, text).mapInArrow(
        lambda b: _stretch_rows(b, path), "row bigint, n bigint, text string, opens boolean, stays_open boolean, before string")
    maps = written(pieces.repartition("row", "n").mapInArrow(lambda b: _map_rows(b, path), f"row bigint, n bigint, {_MAP}"))
    most = maps.agg(F.max("n")).first()[0] or 0
    while most:
        maps = maps.groupBy("row", F.floor(F.col("n") / NEIGHBOURS)).applyInArrow(_composer(path), f"row bigint, n bigint, {_MAP}")
        most //= NEIGHBOURS
    counts = maps.select(F.col("row").alias(found_row), F.col("count").alias("n_tokens"))
    long = numbered.join(counts, F.col(row) == F.col(found_row)).select(*[F.col(f"`{c}`") for c in others], "n_tokens")
    return short.unionByName(long)
