"""Near duplicates by SetSketch registers: bands, a joint likelihood estimate, then the full sets.

A register is the truncated, exponentially spaced minimum of one hash function over a set's shingles,
so sketches merge by their maxima and two sets agree in a register with a probability that follows
their similarity.  Texts with equal sets form one class first.  Classes that agree in all registers
of a band share a bucket, and classes joined by buckets form a group.

A group is compared inside tasks, a chunk of classes with another: pairs that are not yet in one
component are estimated from all registers, and those that may be links are compared on their full
sets at once, the nearest first.  Only links that join two components leave a task, so no list of
pairs is ever written, neither of links nor of refuted ones.  Every chunk meets itself and the first
chunk of its group; what is then still outside the largest component of its group meets all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.common import discarded, freed, narrowed, staged, text_slices
from tallyscope.llm.components import components, joined_components

#: Registers of a sketch, and the share of pairs at the threshold that may miss all bands.
REGISTERS, MISSED = 192, 3e-7
#: A pair is compared on its sets unless its estimate is so many deviations below the threshold.
DEVIATIONS = 5
#: Base, rate and limit of the registers.
BASE, RATE, LIMIT = 1.02, 20.0, (1 << 16) - 1
#: Classes of a chunk and bytes of their sets, about: what a task holds twice.
CHUNK, CHUNK_BYTES = 512, 16 << 20

_random = np.random.default_rng(20)
_FLIPS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_FACTORS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)


def band_width(percent: int) -> int:
    """Registers of a band: the most with which a pair at the threshold still shares a bucket, but for ``MISSED``."""
    like = percent / 100
    return max([w for w in range(1, REGISTERS + 1) if (1 - like**w) ** (REGISTERS // w) <= MISSED], default=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of all texts, ascending within a text, and the n + 1 offsets."""
    tokens, counts = [], []
    for text in texts:
        found = (text or "").encode().lower().split()  # exactly A-Z, and exactly the six characters of white space
        tokens += found
        counts.append(len(found))
    counts = np.array(counts, np.int64)
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    hashes = known[coded.indices.to_numpy()] if len(tokens) else np.zeros(0, np.uint64)
    # a text of fewer words is one shingle
    pieces = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    owner = np.repeat(np.arange(len(counts)), pieces)
    starts = np.repeat(np.cumsum(counts) - counts, pieces) + np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lengths = np.minimum(counts, size)[owner]
    values = lengths.astype(np.uint64)
    for i in range(size):
        inside = i < lengths
        values = _mixed(values * np.uint64(0xD1342543DE82EF95) + np.where(inside, hashes[np.where(inside, starts + i, 0)] if len(hashes) else 0, np.uint64(0)))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    offsets = np.searchsorted(owner[new], np.arange(len(counts) + 1))
    return values[new], offsets


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    starts = offsets[full]
    for i in range(REGISTERS):
        least = np.minimum.reduceat(((values ^ _FLIPS[i]) * _FACTORS[i]) >> np.uint64(32), starts)
        spaced = -np.log1p(-(least + 0.5) / 2.0**32) / RATE  # exponential with rate RATE
        out[full, i] = np.clip(np.floor(1 - np.log(spaced) / np.log(BASE)), 0, LIMIT).astype(np.uint16)
    return out


_GRID = np.linspace(0.4, 1, 121)


def estimated(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches with known set sizes, by maximum likelihood over a grid."""
    above, below = (left > right).sum(axis=-1), (left < right).sum(axis=-1)
    u = n_left / (n_left + n_right)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up = share(u[..., None] - (1 - u)[..., None] * _GRID)
    down = share((1 - u)[..., None] - u[..., None] * _GRID)
    possible = _GRID <= np.minimum(u / (1 - u), (1 - u) / u)[..., None] + 1e-6
    likelihood = above[..., None] * np.log(up) + below[..., None] * np.log(down) + (REGISTERS - above - below)[..., None] * np.log(np.maximum(1 - up - down, 1e-9))
    return _GRID[np.argmax(np.where(possible, likelihood, -np.inf), axis=-1)]


def _sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sketch): set size, 128-bit digest of the set, registers."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            values, offsets = shingle_sets(part.column(1).to_pylist(), size)
            sketch = registers(values, offsets)
            digests = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), pa.array([row.tobytes() for row in sketch], pa.binary())],
                names=["id", "n", "digest", "sketch"],
            )

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n bigint, digest binary, sketch binary")


def _members(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(group, chunks, node, n, sketch, shingles) of the wanted classes, and how many chunks their group
    has: the one pass that moves texts, and only theirs.  A class comes once for each row with its id and text."""
    source = narrowed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", wanted, "id")
    chunks = wanted.groupBy("group").agg(F.expr(f"1 + greatest(count(1) div {CHUNK}, sum(8 * n) div {CHUNK_BYTES})").alias("chunks"))
    joined = source.join(wanted.join(chunks, "group"), F.col("_id").eqNullSafe(F.col("id"))).select("group", "chunks", "node", "n", "sketch", "text", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 5):
            values, offsets = shingle_sets(part.column(5).to_pylist(), size)
            rows = [values[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            # another text may carry the same id
            same = [xxhash.xxh3_128_digest(row) == digest for row, digest in zip(rows, part.column(6).to_pylist())]
            found = pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(rows, pa.binary())], names=["group", "chunks", "node", "n", "sketch", "shingles"])
            yield found.filter(pa.array(same, pa.bool_()))

    return joined.mapInArrow(run, "group bigint, chunks bigint, node bigint, n bigint, sketch binary, shingles binary")


class Chunk:
    """Classes of one task, ascending by side and node: numbers as arrays, sets as they come."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        if not self.rows or self.rows[-1][:2] != row[:2]:  # a class may come several times
            self.rows.append(row)

    def links(self, both: bool, least: float, percent: int) -> list[tuple[int, int]]:
        """Links between left and right classes, and between left ones if ``both``, that join two labels."""
        if len(self.rows) < 2:
            return []
        side, node, label, n, sketch, sets = zip(*self.rows)
        side, node, label = np.array(side), np.array(node), np.array(label)
        sketches, size = np.frombuffer(b"".join(sketch), np.uint16).reshape(-1, REGISTERS), np.array(n, float)
        found = []
        for x in np.flatnonzero(side == 0):
            fit = (label != label[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])) & (side == 1)
            if both:
                fit[x + 1 :] |= (label[x + 1 :] != label[x]) & (side[x + 1 :] == 0) & (100 * np.minimum(size[x + 1 :], size[x]) >= percent * np.maximum(size[x + 1 :], size[x]))
            rows = np.flatnonzero(fit)
            if not len(rows):
                continue
            value = estimated(np.broadcast_to(sketches[x], (len(rows), REGISTERS)), sketches[rows], np.full(len(rows), size[x]), size[rows])
            mine = np.frombuffer(sets[x], np.uint64)
            for y in rows[np.argsort(-value, kind="stable")][: np.count_nonzero(value >= least)]:
                if label[y] == label[x]:
                    continue
                theirs = np.frombuffer(sets[y], np.uint64)
                common = len(mine) + len(theirs) - len(np.union1d(mine, theirs))
                if 100 * common >= percent * (len(mine) + len(theirs) - common):
                    found.append((int(node[x]), int(node[y])))
                    label[label == label[y]] = label[x]
        return found


def _links(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """(a, b) from rows (group, i, j, side, node, label, n, sketch, shingles) dealt by group, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = Chunk(), None

        def found() -> pa.RecordBatch:
            # a chunk meets itself where it is both sides' (i = j)
            a, b = zip(*links) if (links := held.links(key is not None and key[1] == key[2], least, percent)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for group, i, j, *row in zip(*(column.to_pylist() for column in batch.slice(at, 64).columns)):
                    if (group, i, j) != key:
                        yield found()
                        held, key = Chunk(), (group, i, j)
                    held.add(tuple(row))
        yield found()

    keys = ["group", "i", "j"]
    dealt = rows.select(*keys, "side", "node", "label", "n", "sketch", "shingles").repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _within(members: DataFrame) -> DataFrame:
    """Every chunk with itself, and with the first chunk of its group."""
    dealt = members.withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)")).withColumn("label", F.col("node"))
    own = dealt.withColumns({"i": F.col("chunk"), "j": F.col("chunk"), "side": F.lit(0)})
    many = dealt.filter("chunks > 1").withColumn("i", F.lit(0).cast("bigint"))
    first = many.filter("chunk = 0").withColumns({"j": F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("chunks") - 1)), "side": F.lit(0)})
    other = many.filter("chunk > 0").withColumns({"j": F.col("chunk"), "side": F.lit(1)})
    return own.unionByName(first).unionByName(other)


def _outside(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of groups with several chunks, the classes outside the largest component with all classes."""
    many = members.filter("chunks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a row for each class again, as its rows may repeat
    counts = many.groupBy("group", "label").agg(F.count_distinct("node").alias("m"))
    main = counts.groupBy("group").agg(F.max_by("label", "m").alias("main"), (F.sum("m") - F.max("m")).alias("others"))
    known = many.join(main, "group").withColumn("lefts", F.expr(f"1 + others div {CHUNK}")).filter("others > 0")
    row = F.xxhash64("node", F.lit(7))
    # i and j are never equal: a right chunk is numbered from the last left one on
    left = known.filter("label <> main").withColumns({"i": F.pmod(row, F.col("lefts")), "j": F.explode(F.expr("sequence(lefts, lefts + chunks - 1)")), "side": F.lit(0)})
    right = known.withColumns({"j": F.col("lefts") + F.pmod(row, F.col("chunks")), "i": F.explode(F.expr("sequence(0L, lefts - 1)")), "side": F.lit(1)})
    return left.unionByName(right)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: texts are linked when the intersection of their sets
    of ``size``-word shingles is at least ``percent`` per cent of the union, and a component is named
    by its smallest id.

    Words are runs without white space, A-Z in lower case.  A text with fewer words is one shingle; a
    null text or one without words has none and is linked with nothing.  A null id is kept, and names a
    component only where it has no other.  Repeated rows have equal sets and so one component.  An
    empty table gives no rows.  Only the two named columns are read; ids may be of any type with an order.

    A link is missed if its two texts are in no common group, by a chance of at most ``MISSED`` at the
    threshold and less above it, or if its estimate is ``DEVIATIONS`` deviations too low, by a like chance.
    """
    spark = docs.sparkSession
    rows = staged(_sketches(docs, size, id_col, text_col), "sketches")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    least = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    width = band_width(percent)
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * width * i + 1, 2 * width)) for i in range(REGISTERS // width)])
    entries = classes.select("node", F.explode(bands).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    stars = staged(entries.join(shared, "bucket").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
    groups = components(stars)
    wanted = staged(classes.join(groups.withColumnRenamed("label", "group"), "node"), "wanted")
    discarded(stars, groups)
    freed(spark)  # the buckets' shuffle files go before the texts move
    members = staged(_members(docs, wanted, size, id_col, text_col), "members")
    freed(spark)

    links = staged(_links(_within(members), least, percent), "links")
    labels = components(links)
    if not members.filter("chunks > 1").isEmpty():
        more = staged(_links(_outside(members, labels), least, percent), "links")
        labels = staged(joined_components(labels, more), "labels")
        discarded(more)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    whole = staged(named.join(smallest, "label").select("digest", "component_id"), "components")
    discarded(members, wanted, links, classes)
    freed(spark)
    filled = rows.filter("n > 0").join(whole, "digest").select("id", F.col("n").alias("n_shingles"), "component_id")
    return filled.unionByName(rows.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all columns whatever those are
    called; of rows repeated with that id one stays."""
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")), "documents")
    own = F.struct(F.col("_doc")[id_col].isNull().alias("unnamed"), F.col("_doc")[id_col].alias("id"), F.col("_row").alias("row"))
    found = near_duplicates(numbered.select(own.alias("_id"), F.col("_doc")[text_col].alias("_text")), size, percent, "_id", "_text")
    dropped = found.filter("id <> component_id").select(F.col("id.row").alias("_row"))
    return numbered.join(dropped, "_row", "left_anti").select("_doc.*")
