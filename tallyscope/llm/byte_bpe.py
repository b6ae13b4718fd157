"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Tokens are written as Latin-1 strings, one character a byte.  An automaton over them finds the longest
token that starts at a byte.  The encoder takes the longest match, or the next shorter token that is a
prefix of it, as long as it is compatible with the token before; where none is, it takes back the last
token and marks the place as a dead end.
Two adjacent tokens are compatible if merging their bytes by rank leaves them apart, which is read off
by undoing their merges from the last to the first along the border, and remembered.  An encoding whose
neighbours are all compatible is the one that the merges give, and each place is left at most once
as a dead end, so the time is linear in the bytes.

A space before a character that is no white space always begins a match of the splitting pattern.  A
text therefore falls into independent chunks at these spaces; a Python worker keeps a table of distinct
chunks, which only saves work: it may be emptied or lost at any time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyscope.llm.common import text_slices

#: Entries of a worker's chunk table, at most, and the longest chunk kept there.
MOST_CHUNKS, LONGEST = 500_000, 64
#: Remembered pairs of adjacent tokens, at most; the memory is emptied when full.
MOST_PAIRS = 1_000_000
_CHUNK = re.compile(r" ?[^ ]+(?: (?!\S)[^ ]*)*|(?: (?!\S)[^ ]*)+")
_NEVER = 1 << 62


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file with a base64 token and its rank in each line."""
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairs:
    """Merges of a rank table.  Each single byte must be a token; merge order is the order of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a single byte is not a token")
        size = max(ranks.values()) + 1
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.token = [""] * size
        #: The longest token that is a proper prefix of a token, or -1; the two tokens it is merged from.
        self.shorter, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        #: Rank of a token's last merge; -1 for single bytes.
        self.merged = [-1] * size
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            self.token[rank] = token
            if len(token) > 1 and (split := self._split(token, rank)):
                self.left[rank], self.right[rank] = split
                self.merged[rank] = rank
                self.joined[split] = rank
        # a token that no merges lead to stands only for a word that equals it
        self.reached = {token: rank for token, rank in self.ranks.items() if len(token) == 1 or self.merged[rank] >= 0}
        for token, rank in self.reached.items():
            self.shorter[rank] = next((self.reached[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.reached), -1)
        self.size = [len(token) for token in self.token]
        self.widest = max(self.size)
        self._prepare()

    def _split(self, token: str, rank: int) -> tuple[int, int] | None:
        for n in range(len(token) - 1, 0, -1):
            first, second = self.ranks.get(token[:n], _NEVER), self.ranks.get(token[n:], _NEVER)
            if max(first, second) < rank and self._made(first) and self._made(second) and self._apart(first, second):
                return first, second
        return None

    def _made(self, rank: int) -> bool:
        return len(self.token[rank]) == 1 or self.merged[rank] >= 0

    def _prepare(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.reached.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "automaton"} | {"known": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def _apart(self, first: int, second: int) -> bool:
        """Whether no merge across the border comes before the merges that made the two tokens."""
        limit = _NEVER
        while self.joined.get((first, second), _NEVER) >= limit:
            before, after = self.merged[first], self.merged[second]
            if before < 0 and after < 0:
                return True
            if before > after:
                limit, first = before, self.right[first]
            else:  # of equal merges the left one is made first
                limit, second = after + 1, self.left[second]
        return False

    def compatible(self, first: int, second: int) -> bool:
        """``_apart``, remembered."""
        if len(self.known) >= MOST_PAIRS:
            self.known.clear()
        found = self.known[first, second] = self._apart(first, second)
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word, as merging its bytes by rank gives them."""
        text = word.decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None or not text:
            return [] if whole is None else [whole]
        n, size, shorter, known, matches = len(text), self.size, self.shorter, self.known, self.automaton.iter_long
        ids, at, last, token = [], 0, -1, -1
        for _, token in matches(text):  # the longest match at each end of the one before
            if last >= 0:
                fits = known.get((last, token))
                if not (self.compatible(last, token) if fits is None else fits):
                    break
            ids.append(token)
            at, last = at + size[token], token
        alive = bytearray(b"\1") * (n + 1) if at < n else b""
        while at < n:
            while token >= 0:
                end = at + size[token]
                if alive[end]:
                    fits = True if last < 0 else known.get((last, token))
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, last = end, token
                token = next(matches(text[at : at + self.widest]))[1] if at < n else -1
            else:
                alive[at] = 0
                taken = ids.pop()
                at -= size[taken]
                token, last = shorter[taken], ids[-1] if ids else -1
        return ids

    def decode(self, ids) -> bytes:
        """The bytes of the tokens, one after the other."""
        token = self.token
        return "".join([token[i] for i in ids]).encode("latin-1")


class ChunkTable(dict):
    """chunk -> (ids as bytes, bytes decoded from the ids); a missing chunk is encoded when first looked up."""

    def __init__(self, pairs: BytePairs, pattern: str):
        self.pairs, self.pattern = pairs, regex.compile(pattern)

    def __reduce__(self):
        return ChunkTable, (self.pairs, self.pattern.pattern)

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        ids = [i for word in self.pattern.findall(chunk) for i in self.pairs.encode(word.encode())]
        found = pack(f"<{len(ids)}I", *ids), self.pairs.decode(ids)
        if len(chunk) <= LONGEST:
            if len(self) >= MOST_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a whole text as little-endian unsigned integers, and the bytes decoded from them."""
        parts = [self[chunk] for chunk in _CHUNK.findall(text)]
        return b"".join([ids for ids, _ in parts]), b"".join([said for _, said in parts])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as little-endian unsigned 32-bit integers, decoded bytes) of each row.

    ``pattern`` splits a text into words and must be the usual one of byte-level BPE: spaces in front of
    letters, numbers or other signs belong to them.  A null or empty text has no ids and decodes to
    nothing.  A null id is kept.  Repeated rows give repeated results, an empty table none.  Only the two
    named columns are read.  A text of any length is one row; a task holds one slice of rows at a time.
    There is no shuffle: the merges, fixed in size by the rank table, are sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ChunkTable(BytePairs(ranks), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_slices(batches, 1):
            done = [known.encode(text or "") for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([ids for ids, _ in done], pa.binary()), pa.array([said for _, said in done], pa.binary())],
                names=["id", "ids", "decoded"],
            )

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids binary, decoded binary")
