"""Vector code compression: a codebook for each part of a vector, learned over trees of anchors.

Vectors are cut into equal parts.  For each part position a task builds a metric tree over a block of
vectors, middle-out: anchors take the points nearest to them (a new anchor is the point farthest from
its own, and takes only from anchors near enough by the triangle inequality), the anchors' balls are
merged upwards, the closest first, and divided downwards by anchors of their own.  Every ball caches
the number and the sum of its points.

A round walks down the trees with lists of the codebook entries that can still be nearest.  A ball
inherits the list of the ball around it and strikes an entry off if another is nearer to all its points.
A ball with one entry left is wholly owned: its cached sum and count are added.  Only single points at
the bottom are compared one by one, with the entries left.  All sums and distances that decide are whole
numbers; balls use floating point with a margin, which may keep an entry too many but strikes none off.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyscope.llm.common import staged

#: Vectors of a block, which is what a tree covers, and points of a ball that is not divided further.
BLOCK_ROWS, LEAF = 4096, 12
#: Whole components must be smaller, so that distances and their sums stay exact in 64 bits.
LARGEST = 1 << 27
#: Margins of floating point distances between balls and entries, relative and absolute.
_MARGIN, _LEAST = 1e-9, 1e-6


class Tree:
    """Balls over points of whole numbers.  A ball holds the points ``order[start:stop]``."""

    FIELDS = ("order", "start", "stop", "left", "right", "centre", "radius", "total")

    def __init__(self, points: np.ndarray):
        self.points, self.exact = points.astype(np.float64), points
        self.nodes: list[tuple] = []  # (left, right, centre, radius, total, members of an undivided ball)
        self.root = self._divided(np.arange(len(points)))
        self._laid_out()

    def _ball(self, members: np.ndarray, left: int = -1, right: int = -1) -> int:
        total = self.exact[members].sum(axis=0)
        centre = total / len(members)
        radius = math.sqrt(((self.points[members] - centre) ** 2).sum(axis=1).max())
        self.nodes.append((left, right, centre, radius, total, members))
        return len(self.nodes) - 1

    def _divided(self, members: np.ndarray) -> int:
        """The ball of these points, divided by anchors unless it is small or one point many times."""
        if len(members) <= LEAF:
            return self._ball(members)
        points = self.points[members]
        owner, distance = np.zeros(len(members), np.int64), np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        anchors = [0]
        while len(anchors) < math.isqrt(len(members)):
            far = int(distance.argmax())
            if not distance[far]:
                break
            apart = np.sqrt(((points[anchors] - points[far]) ** 2).sum(axis=1))
            # points nearer to their anchor than half the way between the anchors stay
            near = np.flatnonzero(distance >= apart[owner] / 2)
            to_new = np.sqrt(((points[near] - points[far]) ** 2).sum(axis=1))
            closer = to_new < distance[near]
            distance[near[closer]] = to_new[closer]
            owner[near[closer]] = len(anchors)
            anchors.append(far)
        if len(anchors) == 1:
            return self._ball(members)
        groups = [members[owner == a] for a in range(len(anchors))]
        return self._merged([(self._divided(g), g) for g in groups if len(g)])

    def _merged(self, balls: list[tuple[int, np.ndarray]]) -> int:
        """One ball of several, always joining the two whose common ball is the smallest."""
        centre = np.array([self.nodes[i][2] for i, _ in balls])
        radius = np.array([self.nodes[i][3] for i, _ in balls])
        span = np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2)) + radius[:, None] + radius
        span[np.diag_indices(len(balls))] = np.inf
        for _ in range(len(balls) - 1):
            a, b = divmod(int(span.argmin()), len(balls))
            members = np.concatenate([balls[a][1], balls[b][1]])
            node = self._ball(members, balls[a][0], balls[b][0])
            balls[a] = (node, members)
            centre[a], radius[a] = self.nodes[node][2], self.nodes[node][3]
            gone = np.isinf(span[a]) & (np.arange(len(balls)) != a)
            span[a] = span[:, a] = np.where(gone, np.inf, np.sqrt(((centre - centre[a]) ** 2).sum(axis=1)) + radius + radius[a])
            span[b] = span[:, b] = np.inf
            span[a, a] = np.inf
        return balls[a][0] if len(balls) > 1 else balls[0][0]

    def _laid_out(self) -> None:
        """Arrays of the balls, and an order of the points in which each ball is one stretch."""
        n = len(self.nodes)
        self.left = np.array([node[0] for node in self.nodes], np.int32)
        self.right = np.array([node[1] for node in self.nodes], np.int32)
        self.centre = np.array([node[2] for node in self.nodes])
        self.radius = np.array([node[3] for node in self.nodes])
        self.total = np.array([node[4] for node in self.nodes], np.int64)
        self.start, self.stop = np.zeros(n, np.int32), np.zeros(n, np.int32)
        order, todo = [], [(self.root, 0)]
        while todo:
            node, at = todo.pop()
            left, right, _, _, _, members = self.nodes[node]
            self.start[node], self.stop[node] = at, at + len(members)
            if left < 0:
                order.append((at, members))
            else:
                todo += [(left, at), (right, at + len(self.nodes[left][5]))]
        self.order = np.concatenate([members for _, members in sorted(order, key=lambda x: x[0])]).astype(np.int32)


class Walk:
    """One round over one tree: which entry owns each point, and the sums and counts of the entries."""

    def __init__(self, tree: dict, points: np.ndarray, book: np.ndarray):
        self.tree, self.points, self.book = tree, points, book
        self.near = book.astype(np.float64)
        self.code = np.zeros(len(points), np.int64)  # in the order of the tree
        self.sums, self.counts = np.zeros_like(book), np.zeros(len(book), np.int64)
        #: Distances worked out, of single points to entries: what the trees save.
        self.compared = 0
        self._down()

    def _down(self) -> None:
        tree = self.tree
        balls = np.array([len(tree["start"]) - 1])  # the ball made last holds all others
        lists = np.ones((1, len(self.book)), bool)
        while len(balls):
            lists = self._shorter(balls, lists)
            owned = lists.sum(axis=1) == 1
            self._owned(balls[owned], lists[owned].argmax(axis=1))
            bottom = ~owned & (tree["left"][balls] < 0)
            self._single(balls[bottom], lists[bottom])
            inner = ~owned & ~bottom
            balls, lists = np.concatenate([tree["left"][balls[inner]], tree["right"][balls[inner]]]), np.concatenate([lists[inner]] * 2)

    def _shorter(self, balls: np.ndarray, lists: np.ndarray) -> np.ndarray:
        tree = self.tree
        distance = np.sqrt(((tree["centre"][balls][:, None] - self.near) ** 2).sum(axis=2))
        distance = np.where(lists, distance, np.inf)
        reach = distance.min(axis=1) + 2 * tree["radius"][balls]
        return distance <= (reach * (1 + _MARGIN) + _LEAST)[:, None]

    def _owned(self, balls: np.ndarray, entries: np.ndarray) -> None:
        tree = self.tree
        np.add.at(self.sums, entries, tree["total"][balls])
        np.add.at(self.counts, entries, (tree["stop"] - tree["start"])[balls].astype(np.int64))
        for ball, entry in zip(balls, entries):
            self.code[tree["start"][ball] : tree["stop"][ball]] = entry

    def _single(self, balls: np.ndarray, lists: np.ndarray) -> None:
        if not len(balls):
            return
        tree = self.tree
        sizes = (tree["stop"] - tree["start"])[balls].astype(np.int64)
        first = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) - np.repeat(first - tree["start"][balls], sizes)
        row, entry = np.nonzero(np.repeat(lists, sizes, axis=0))  # entries ascend within a row
        self.compared += len(row)
        distance = ((self.points[places[row]] - self.book[entry]) ** 2).sum(axis=1)
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(distance, heads)
        best = distance == np.repeat(least, np.diff(np.append(heads, len(row))))
        hit = np.flatnonzero(best)
        _, which = np.unique(row[hit], return_index=True)  # of equal distances the lower entry
        codes = entry[hit[which]]
        self.code[places] = codes
        np.add.at(self.sums, codes, self.points[places])
        np.add.at(self.counts, codes, 1)


def _whole(lists: pa.ListArray, scale: int) -> np.ndarray:
    """A row of whole components for each vector."""
    widths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths}")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(flat * scale)
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return values.astype(np.int64).reshape(len(lists), widths[0])


def _cut(whole: np.ndarray, parts: int) -> np.ndarray:
    """(vector, part, position)"""
    if whole.shape[1] % parts:
        raise ValueError(f"{whole.shape[1]} components do not make {parts} equal parts")
    return whole.reshape(len(whole), parts, whole.shape[1] // parts)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vector) of rows whose vector is there and has finite components only."""
    vector = vectors[vector_col].cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vector.alias("vector"))
    return rows.filter(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)))


def _blocks(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """One row for each block of vectors: ids, labels, and for each part the points and the tree over them."""
    id_type, label_type = (to_arrow_type(rows.schema[c].dataType) for c in ("id", "label"))
    names = ["ids", "labels", "shape", "points", *Tree.FIELDS]
    kinds = [pa.list_(id_type), pa.list_(label_type), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * (1 + len(Tree.FIELDS))]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        pieces = _cut(_whole(table.column("vector").combine_chunks(), scale), parts)
        trees = [Tree(pieces[:, part]) for part in range(parts)]
        columns = [table.column("id").to_pylist(), table.column("label").to_pylist(), list(pieces.shape)]
        columns.append([pieces[tree.order, part].astype("<i4").tobytes() for part, tree in enumerate(trees)])
        columns += [[getattr(tree, field).tobytes() for tree in trees] for field in Tree.FIELDS]
        return pa.RecordBatch.from_arrays([pa.array([column], kind) for column, kind in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = BLOCK_ROWS - sum(part.num_rows for part in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(part.num_rows for part in held) == BLOCK_ROWS:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    lists = ", ".join(f"{name} array<binary>" for name in names[3:])
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(run, f"ids array<{kind['id']}>, labels array<{kind['label']}>, shape array<bigint>, {lists}")


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[dict, np.ndarray]]]]:
    """(row, (tree, its points) of each part) of the staged blocks."""
    types = dict(zip(Tree.FIELDS, ("<i4", "<i4", "<i4", "<i4", "<i4", "<f8", "<f8", "<i8")))
    column = {name: batch.column(batch.schema.get_field_index(name)) for name in ("shape", "points", *Tree.FIELDS)}
    for i in range(batch.num_rows):
        _, parts, width = column["shape"][i].as_py()
        found = []
        for part in range(parts):
            tree = {name: np.frombuffer(column[name].values[column[name].offsets[i].as_py() + part].as_buffer(), kind) for name, kind in types.items()}
            balls = (len(tree["start"]), width)
            tree["centre"], tree["total"] = tree["centre"].reshape(balls), tree["total"].reshape(balls)
            points = np.frombuffer(column["points"].values[column["points"].offsets[i].as_py() + part].as_buffer(), "<i4")
            found.append((tree, points.astype(np.int64).reshape(len(tree["order"]), width)))
        yield i, found


def _learned(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, position) after the rounds.  A round brings back one sum for each component."""
    trees = blocks.drop("ids", "labels")
    for _ in range(rounds):
        now = books

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                for _, found in _trees(batch):
                    for part, (tree, points) in enumerate(found):
                        walk = Walk(tree, points, now[part])
                        sums[part] += walk.sums
                        counts[part] += walk.counts
            part, entry = (axis.ravel() for axis in np.indices(counts.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(entry), pa.array(counts.ravel()), pa.array(list(sums.reshape(len(part), now.shape[2])), pa.list_(pa.int64()))],
                names=["part", "entry", "count", "sums"],
            )

        found = trees.mapInArrow(run, "part bigint, entry bigint, count bigint, sums array<bigint>")
        one = found.select("part", "entry", "count", F.posexplode("sums").alias("place", "value"))
        # as many rows as the codebooks have components
        sums = one.groupBy("part", "entry", "place").agg(F.sum("count").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("s"))
        books = now.copy()
        for row in sums.filter("n > 0").collect():
            books[row.part, row.entry, row.place] = int(row.s) // row.n
    return books


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, codes, error) of each usable row, codebooks as (part, entry, position)).

    A component x counts as floor(scale * x).  The codebooks start as the parts of the ``entries``
    smallest ids (of equal ids the smaller vector first, null ids last); with fewer rows there are fewer
    entries.  A round assigns each part to the nearest entry, the lower one if two are equally near, and
    replaces each used entry by the floor of its parts' mean.  ``codes`` is the list of final entries and
    ``error`` the sum of the squared distances to them.

    Rows whose vector is null or has a null or non-finite component are left out.  Rows with null or
    repeated ids and labels are kept, each counting for itself; an empty table gives no rows and empty
    codebooks.  Vectors of different lengths, or that the parts do not divide, and components of
    ``LARGEST`` or more after scaling are errors.  Only the three named columns are read.

    No row is shuffled: trees are built where the rows are read, and staged; a round reads them and
    brings back parts x entries x positions sums.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    rows = usable(vectors, id_col, vector_col, label_col)
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, codes binary, error bigint"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    start = _cut(_whole(pa.array([row.vector for row in first], pa.list_(pa.float64())), scale), parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    blocks = staged(_blocks(rows, parts, scale), "anchor-trees")
    books = _learned(blocks, books, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in _trees(batch):
                codes, error = np.zeros((len(found[0][1]), parts), np.uint8), np.zeros(len(found[0][1]), np.int64)
                for part, (tree, points) in enumerate(found):
                    code = Walk(tree, points, books[part]).code
                    codes[tree["order"], part] = code
                    error[tree["order"]] += ((points - books[part][code]) ** 2).sum(axis=1)
                ids, labels = (batch.column(batch.schema.get_field_index(name))[i].values for name in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(error)], names=["id", "label", "codes", "error"])

    return blocks.select("ids", "labels", "shape", "points", *Tree.FIELDS).mapInArrow(run, schema), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same as plain SQL over ``embeddings``: every vector against every entry in each round."""
    steps = [f"""
v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
    list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT n, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x
  FROM v, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM p WHERE n <= {entries})"""]
    nearest = """
a{0} AS MATERIALIZED (
  SELECT p.n, p.part, p.x, arg_min(struct_pack(entry := c.entry, d := list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))),
    (list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry)) AS best
  FROM p JOIN c{0} c ON c.part = p.part GROUP BY p.n, p.part, p.x)"""
    for i in range(rounds):
        steps.append(nearest.format(i))
        steps.append(f"""
s{i} AS (
  SELECT part, entry, place, sum(y) AS s, count(*) AS n
  FROM (SELECT part, best.entry AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY part, entry, place),
m{i} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x FROM s{i} GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)""")
    steps.append(nearest.format(rounds))
    steps.append(f"""
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS sha FROM c{rounds}),
coded AS (SELECT n, string_agg(lpad(to_hex(best.entry), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM v JOIN coded USING (n), book""")
    return "WITH" + ",".join(steps[:-1]) + "," + steps[-1]


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with ``label_error``, the error summed over rows of equal label; nulls are one label."""
    rows = staged(coded, "anchor-codes")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    return rows.join(sums, rows["label"].eqNullSafe(sums["_label"]), "left").drop("_label")
