"""SentencePiece encoding and decoding through tables of distinct chunks.

Where no piece of a model crosses a white space marker, a text falls into independent chunks: each
run of markers with what follows it.  A task keeps a table of the distinct chunks it has met.  Each
is segmented and decoded once by the library, and the ids of a text are the table's entries joined
by position.  The table is emptied when it reaches ``MOST_CHUNKS`` entries, which bounds memory and
changes no result.  There is no shuffle: a task repeats the segmentation of common words, which
costs far less than moving every word of the corpus would.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyscope.llm.common import text_slices

MARK = "▁"
#: Entries of a task's table, at most; a longer chunk than ``LONGEST`` characters is never kept.
MOST_CHUNKS, LONGEST = 200_000, 64
_CHUNK = re.compile(" +[^ ]*")


class ChunkTable(dict):
    """chunk -> (ids as bytes, decoded chunk); a missing chunk is segmented when first looked up."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("pieces of this model cross white space markers")
        probe = "  a  b "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError("this model changes white space, so chunks are not independent")

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        # the library puts the first marker of a text itself
        ids = self.model.encode(chunk[1:]) if len(chunk) > 1 else [self.model.piece_to_id(MARK)]
        found = np.asarray(ids, "<u4").tobytes(), " " + self.model.decode(ids) if len(chunk) > 1 else " "
        if len(chunk) <= LONGEST:
            if len(self) >= MOST_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as little-endian unsigned integers, and the text decoded from them."""
        if not text:
            return b"", ""
        parts = [self[chunk] for chunk in _CHUNK.findall(" " + text.replace(MARK, " "))]
        return b"".join([ids for ids, _ in parts]), "".join([said for _, said in parts])[1:]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as little-endian unsigned 32-bit integers with begin and end ids, decoded text) of each row.

    A null or empty text has the begin and end ids only and decodes to the empty text.  A null id is
    kept.  Repeated rows give repeated results, an empty table none.  Only the two named columns are
    read.  A text of any length is one row; a task holds one slice of rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(model_file)
        begin = np.asarray([known.model.bos_id()], "<u4").tobytes()
        end = np.asarray([known.model.eos_id()], "<u4").tobytes()
        for part in text_slices(batches, 1):
            done = [known.encode(text or "") for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([begin + ids + end for ids, _ in done], pa.binary()), pa.array([t for _, t in done], pa.string())],
                names=["id", "ids", "decoded"],
            )

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids binary, decoded string")
