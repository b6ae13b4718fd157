"""Secret scans: all rules in one automaton, one pass over the bytes of each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm.automaton import Automaton
from tallyscope.llm.common import text_bytes, text_slices


class Rule(NamedTuple):
    """``pattern`` finds candidates, leftmost and not overlapping; those whose ``group`` has fewer
    than ``least`` bytes are dropped.  ``flag`` is what the automaton looks for: a pattern that ends
    somewhere in every candidate that is long enough (the pattern itself, where none is given)."""

    kind: str
    pattern: bytes
    least: int = 0
    group: int = 0
    flag: bytes | None = None


#: The three base kinds, in the order in which spans are listed.
BASE = (
    Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", rb"AKIA[A-Z0-9]+", 20),
    Rule("hex", rb"[0-9a-f]+", 24, 0, rb"[0-9a-f]{24}"),
)
#: Further kinds, of published token formats.
MORE = (
    Rule("github", rb"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", rb"xox[aboprs]-[A-Za-z0-9-]+", 20),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        self.automaton = Automaton([rule.flag or rule.pattern for rule in rules])
        self.exact = [re.compile(rule.pattern) for rule in rules]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(rule, start, end) of each text, in bytes, by start and then rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        starts = self.automaton.cut(data, offsets)
        masks = self.automaton.scan(data, starts)
        stops = np.append(starts, len(data))[1:]
        hits = np.flatnonzero(masks)
        for part, row in zip(hits, np.searchsorted(offsets, starts[hits], side="right") - 1):
            base = int(starts[part])
            text = data[base : stops[part]].tobytes()
            base -= int(offsets[row])
            for i, rule in enumerate(self.rules):
                if masks[part] >> i & 1:
                    found[row] += [
                        (i, base + m.start(), base + m.end())
                        for m in self.exact[i].finditer(text)
                        if m.end(rule.group) - m.start(rule.group) >= rule.least
                    ]
        return [sorted(spans, key=lambda s: (s[1], s[0])) for spans in found]


def _positions(row: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte positions as code point positions."""
    before = np.concatenate([[0], np.cumsum((row & 0xC0) != 0x80)])
    return [(i, int(before[start]), int(before[end])) for i, start, end in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans as array of (kind, start, end)) of each row, in code points, end exclusive, by start
    and then by the order of the rules.

    A null or empty text has no spans; a null id is kept; repeated rows give repeated results; an
    empty table gives none; texts of any length are scanned whole.  Only the two named columns are
    read.  Rules may match overlapping spans of different kinds, and all are listed.
    """

    scanner = Scanner(rules)  # compiled once; tasks receive its arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [rule.kind for rule in rules]
        for part in text_slices(batches, 1):
            data, offsets = text_bytes(part.column(1))
            rows = [
                [{"kind": kinds[i], "start": a, "end": b} for i, a, b in _positions(data[offsets[n] : offsets[n + 1]], spans)] if spans else []
                for n, spans in enumerate(scanner.spans(data, offsets))
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["id", "spans"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(
        run, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    )


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of touching or overlapping spans replaced by ``mark``."""
    out, at, last = [], 0, -1
    for start, end in sorted(spans):
        if start > last:
            out += [text[at:start], mark]
        at = last = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the secrets of ``text_col`` replaced by ``mark``; null stays null.
    Rows without a secret are passed on as they are.  Other columns may have any name or type."""
    column = docs.columns.index(text_col)

    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, column):
            data, offsets = text_bytes(part.column(column))
            found = scanner.spans(data, offsets)
            if any(found):
                texts = part.column(column).to_pylist()
                for n, spans in enumerate(found):
                    if spans:
                        places = _positions(data[offsets[n] : offsets[n + 1]], spans)
                        texts[n] = redacted(texts[n], [(a, b) for _, a, b in places], mark)
                part = part.set_column(column, part.schema.field(column), pa.array(texts, part.schema.field(column).type))
            yield part

    return docs.mapInArrow(run, docs.schema)
