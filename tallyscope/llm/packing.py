"""Packing of tokenised documents into windows, online and with bounded space.

A task keeps at most ``open_windows`` windows.  Each document's ids, cut into full windows first, go
to the open window they fit best.  When none fits and no more may be opened, the fullest one is
filled with the beginning of the ids and emitted.  What is left open at a partition's end is merged
with the windows of neighbouring partitions by the same rule, and the last window of each merge is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyscope.llm.common import staged, text_slices

#: Entries of a task's word table, at most; longer words are not kept.
MOST_WORDS, LONGEST = 200_000, 64
#: Partitions whose open windows are merged together.
MERGED = 8
#: Space of any kind on both sides of a space, or at its end: there a space need not begin a token.
_RUNS = re.compile(r"\s \s|\s $|^ \s|^ $")


def byte_level_ranks(tokenizer_file: str) -> tuple[dict[bytes, int], str, dict[str, int]]:
    """Ranks and pattern of a byte-level BPE tokenizer file, whose ids must be its merge order, and its added tokens."""
    spec = json.load(open(tokenizer_file, encoding="utf-8"))
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("not a byte-level BPE without normaliser")
    if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
        raise ValueError("only the plain byte-level splitting is supported")
    # the printable stand-ins of bytes: printable ones stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    if any(token.get(flag) for token in spec.get("added_tokens", ()) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("only added tokens that match as they stand are supported")
    added = {token["content"]: token["id"] for token in spec.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    return ranks, r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", added


class WordTable(dict):
    """word with its leading space -> ids as bytes; a missing word is encoded when first looked up."""

    def __init__(self, tokenizer_file: str):
        import tiktoken

        ranks, pattern, added = byte_level_ranks(tokenizer_file)
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {content: np.asarray([i], "<u4").tobytes() for content, i in added.items()}
        # of added tokens that begin at one place the longest counts
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.model.encode_ordinary(word), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text: of its added tokens, and of the stretches between them, each for itself."""
        if self.marks is None:
            return self.between(text)
        ids, at = [], 0
        for mark in self.marks.finditer(text):
            ids += [self.between(text[at : mark.start()]), self.added[mark[0]]]
            at = mark.end()
        return b"".join([*ids, self.between(text[at:])]) if at else self.between(text)

    def between(self, text: str) -> bytes:
        """A single space between other characters always begins a token, so words are independent."""
        if not text:
            return b""
        if _RUNS.search(text):
            return np.asarray(self.model.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return b"".join([self[first], *[self[" " + word] for word in rest]])


class Packer:
    """Best-fit into at most ``most`` open windows of ``size`` ids.  A piece is (key.., start, ids)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[int] = []  # ascending; windows[i] has free[i] left
        self.windows: list[list] = []

    def add(self, key: tuple, start: int, ids: bytes) -> Iterator[list]:
        """Places the ids (4 bytes each) and yields the windows that became full."""
        while len(ids) >= 4 * self.size:
            yield [(key, start, ids[: 4 * self.size])]
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            n = len(ids) // 4
            at = bisect.bisect_left(self.free, n)
            if at == len(self.free) and len(self.free) < self.most:
                self._put(self.size - n, [(key, start, ids)])
                return
            if at == len(self.free):  # none fits: the fullest takes the beginning
                at, n = 0, self.free[0]
            left, window = self.free.pop(at) - n, self.windows.pop(at)
            window.append((key, start, ids[: 4 * n]))
            start, ids = start + n, ids[4 * n :]
            if left:
                self._put(left, window)
            else:
                yield window

    def _put(self, left: int, window: list) -> None:
        at = bisect.bisect_left(self.free, left)
        self.free.insert(at, left)
        self.windows.insert(at, window)


_COLUMNS = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _rows(window: list, sequence: int) -> Iterator[tuple]:
    offset = 0
    for (doc, tokens), start, ids in window:
        yield doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset
        offset += len(ids) // 4


def _powers(window: list) -> Iterator[list]:
    """A window cut into windows whose sizes are powers of two."""
    total = sum(len(ids) // 4 for _, _, ids in window)
    pieces = list(reversed(window))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, cut = 1 << bit, []
            while room:
                key, start, ids = pieces.pop()
                n = min(room, len(ids) // 4)
                cut.append((key, start, ids[: 4 * n]))
                if len(ids) > 4 * n:
                    pieces.append((key, start + n, ids[4 * n :]))
                room -= n
            yield cut


def pack(
    docs: DataFrame, tokenizer_file: str, size: int = 2048, end_id: int = 1, open_windows: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each id of each row, ``end_id`` included, lies in exactly one piece, and the pieces of a sequence
    follow each other without gaps.  A null or empty text is its end id alone; a null id is kept;
    repeated rows are packed each on their own (with the same id); an empty table gives no rows; a
    text of more than ``size`` ids fills sequences of its own first.  Only the two named columns are read.
    A partition's own windows never leave its task; at most ``open_windows`` of them are staged and
    merged, ``MERGED`` partitions at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()
    names = [part.split()[0] for part in _COLUMNS.split(", ")] + ["part", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, packer, sequence, rows = WordTable(tokenizer_file), Packer(size, open_windows), part << 32, []
        for batch in text_slices(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text or "") + end
                for window in packer.add((doc, len(ids) // 4), 0, ids):
                    rows += [(*row, None, None) for row in _rows(window, sequence)]
                    sequence += 1
            yield table_of(rows)
            rows = []
        for window in packer.windows:
            yield table_of([(*row, part, piece[2]) for row, piece in zip(_rows(window, sequence), window)])
            sequence += 1

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    types = [to_arrow_type(docs.schema[id_col].dataType), *[pa.int64()] * 7, pa.binary()]
    schema = _COLUMNS.format(id=kind)
    packed = staged(source.mapInArrow(run, schema + ", part bigint, ids binary"), "packed")

    def merge(key: tuple[pa.Scalar, ...], left: pa.Table) -> pa.Table:
        packer, sequence, rows = Packer(size, open_windows), (1 << 62) + (key[0].as_py() << 32), []
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        get = lambda name: left.column(name).to_pylist()
        for doc, tokens, start, ids in zip(get("doc_id"), get("doc_tokens"), get("start"), get("ids")):
            for window in packer.add((doc, tokens), start, ids):
                rows += _rows(window, sequence)
                sequence += 1
        # the open windows are joined end to end; only the last is short
        joined = [piece for window in packer.windows for piece in window]
        closing = Packer(size, 1)
        for key_, start, ids in joined:
            for window in closing.add(key_, start, ids):
                rows += _rows(window, sequence)
                sequence += 1
        for window in (cut for last in closing.windows for cut in _powers(last)):
            rows += _rows(window, sequence)
            sequence += 1
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.table([pa.array(c, t) for c, t in zip(columns, types[:7])], names=names[:7])

    open_ = packed.filter("part is not null").withColumn("_group", F.expr(f"part div {MERGED}"))
    merged = open_.groupBy("_group").applyInArrow(merge, schema)
    return packed.filter("part is null").drop("part", "ids").unionByName(merged)
