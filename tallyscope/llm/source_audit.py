"""How the sources of a language differ in their use of words, from count-level bitmaps.

For each (group, count) the terms that the group has so often are one set of bits.  The joint cells of
two groups, how many terms the one has c times and the other d times, are the bits of AND counted; each
cell is multiplied by the distance f of the two shares, which depends on c and d only.  Cells with a
zero follow by complement: the terms of a level less those met in the other group's levels.

Kept terms are dealt into blocks of about ``BLOCK_TERMS`` of similar frequency, so that a block's counts
are few and its bits dense.  A task gets one block of a language for one pair of chunks of groups and
adds its cells up; what leaves it is one number for each pair of groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyscope.llm.common import staged

#: Terms of a block on average, and groups of a chunk: they bound what a task of the pairs holds.
BLOCK_TERMS, CHUNK_GROUPS = 2048, 256
#: Entries (group and term) that a counting task holds before it hands them on, and bytes of text split at once.
MOST_ENTRIES, PIECE = 400_000, 1 << 20
#: Shares are parts of ``SCALE``; ``PRIOR`` is added to each count.
SCALE, PRIOR = 1_000_000_000, 5
#: A-Z to small letters; other letters a-z and all bytes beyond ASCII stay; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; no term is cut."""
    start = 0
    while start < len(text):
        stop = start + PIECE
        if stop < len(text):
            stop = text.find(b" ", stop)
            stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


class Counts:
    """Occurrences and documents of each (lang, source, term), held up to a bound."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.entries = 0

    def add(self, group: tuple[str, str], text: str) -> None:
        found = self.groups.setdefault(group, (Counter(), Counter()))
        before, seen = len(found[0]), set()
        for terms in pieces(text.encode().translate(_LETTERS)):
            found[0].update(terms)
            seen.update(terms)
        found[1].update(seen)
        self.entries += len(found[0]) - before

    def taken(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in self.groups.items():
            # the empty term stands for the group itself, which may have no term
            terms = [b"", *counts]
            n, d = [0, *counts.values()], [0, *map(docs.__getitem__, counts)]
            for at in range(0, len(terms), 1 << 16):
                some = slice(at, at + (1 << 16))
                size = len(terms[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size), pa.array(terms[some], pa.binary()).cast(pa.string()), pa.array(n[some], pa.int64()), pa.array(d[some], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        self.groups, self.entries = {}, 0


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents that have it.

    Each group has a row with the empty term, too.  Counted in the tasks first, so a group or term with
    most of the rows moves one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                held.add((lang, source), text)
                if held.entries >= MOST_ENTRIES:
                    yield from held.taken()
        yield from held.taken()

    source = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = source.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) in exact decimals; null without kept terms."""
    wide = "cast({} as decimal(20,0))".format
    whole = f"({wide(n)} + {PRIOR}) * cast({SCALE} as decimal(10,0))"
    return F.expr(f"1 + {whole} div nullif({wide(total)} + {PRIOR} * {wide(terms)}, 0)")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, lang_n, level, block, bit): terms in at least ``least_docs`` documents of a language.

    A block holds terms of a language whose counts have the same power of two, about ``BLOCK_TERMS`` of
    them in the language with most, and ``bit`` numbers them in it."""
    found = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = staged(
        found.filter(F.col("docs") >= least_docs).select("lang", "term", "lang_n", F.length(F.bin("lang_n")).alias("level")), "audit-kept"
    )
    most = kept.groupBy("lang", "level").count().groupBy("level").agg(F.max("count").alias("most")).collect()  # a row for each bit of a long
    blocks = F.coalesce(*[F.when(F.col("level") == row.level, F.lit(-(-row.most // BLOCK_TERMS))) for row in most], F.lit(1))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    place = F.row_number().over(W.partitionBy("lang", "level", "block").orderBy("term")) - 1
    return dealt.withColumn("bit", place)


def _distances(p: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place x in ``at`` the sum of n * |p - x|, from running sums over the sorted p."""
    order = np.argsort(p, kind="stable")
    p, n = p[order], n[order]
    below_n, below_s = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * p))
    i = np.searchsorted(p, at)
    return at * below_n[i] - below_s[i] + (below_s[-1] - below_s[i]) - at * (below_n[-1] - below_n[i])


_PAIRS = "lang string, a string, b string, value bigint"


def _table(lang: str, rows: list[tuple]) -> pa.Table:
    a, b, value = zip(*rows) if rows else ([], [], [])
    return pa.table([pa.array([lang] * len(rows), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def _of_levels(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Each pair's sum as if no term were shared: every level of the one against a zero of the other."""
    lang, first, second = key[0].as_py(), key[1].as_py(), key[2].as_py()
    data = {name: rows.column(name).to_numpy() for name in ("chunk", "source", "p", "p0", "n")}
    groups = {}
    for source in np.unique(data["source"]):
        mine = data["source"] == source
        groups[source] = (data["chunk"][mine][0], data["p"][mine], data["n"][mine], data["p0"][mine][0])
    names = sorted(groups)
    zeros = np.array([groups[name][3] for name in names], np.int64)
    sums = np.array([_distances(groups[name][1], groups[name][2], zeros) for name in names])
    terms = int(groups[names[0]][2].sum())
    out = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            if first == second or groups[a][0] != groups[names[j]][0]:
                out.append((a, names[j], int(sums[i, j] + sums[j, i] - terms * abs(int(zeros[i] - zeros[j])))))
    return _table(lang, out)


def _of_bits(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """What the terms that both groups have in one block add to a pair's sum over ``_of_levels``."""
    lang, first, second = key[0].as_py(), key[-2].as_py(), key[-1].as_py()
    rows = rows.sort_by([("chunk", "ascending"), ("source", "ascending"), ("n", "ascending"), ("word", "ascending")])
    data = {name: rows.column(name).to_numpy() for name in ("chunk", "source", "n", "p", "p0", "word", "bits")}
    new = np.append(True, (data["source"][1:] != data["source"][:-1]) | (data["n"][1:] != data["n"][:-1]))
    heads = np.flatnonzero(new)
    levels = np.zeros((len(heads), int(data["word"].max()) + 1), np.uint64)
    levels[np.cumsum(new) - 1, data["word"]] = data["bits"].view(np.uint64)
    source, chunk, p, p0 = (data[name][heads] for name in ("source", "chunk", "p", "p0"))
    starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
    ends = np.append(starts[1:], len(source))
    out = []
    for i, (start, end) in enumerate(zip(starts, ends)):
        if chunk[start] != first:
            break
        other = end if first == second else int(np.searchsorted(chunk, second))
        if other == len(source):
            break
        q, q0 = p[other:], p0[other:]
        total, zero = np.zeros(len(q), np.int64), np.abs(p0[start] - q0) - np.abs(p0[start] - q)
        for level in range(start, end):
            shared = np.bitwise_count(levels[level] & levels[other:]).sum(axis=1, dtype=np.int64)
            total += shared * (np.abs(p[level] - q) - np.abs(p[level] - q0) + zero)
        later = starts[starts >= other]
        for b, value in zip(source[later], np.add.reduceat(total, later - other)):
            if value:
                out.append((min(source[start], b), max(source[start], b), int(value)))
    return _table(lang, out)


def _by_chunks(rows: DataFrame) -> DataFrame:
    """Each row once for each pair of chunks that its own takes part in, as ``first`` and ``second``."""
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    return rows.withColumn("_other", others).withColumns(
        {"first": F.least("chunk", "_other"), "second": F.greatest("chunk", "_other")}
    ).drop("_other", "chunks")


def audit(
    docs: DataFrame, least_docs: int = 30, most_terms: int = 50,
    lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank) of each group, which is a source within a language.

    Part ``pair``: each other source of the language, by the sum of |p - q| over the language's kept
    terms.  Part ``term``: the kept terms that the group has and uses more than the language as a whole,
    by p - q, ranks to ``most_terms``.  Ties go to the smaller item in UTF-8.

    A null or empty language, source or text counts as empty; a group without terms has only zeros, and
    a language without kept terms gives pairs of value 0.  Repeated rows count each time, an empty table
    gives no rows.  Only the three named columns are read.  A very long text is split a piece at a time;
    a task holds the distinct terms of a text beside at most ``MOST_ENTRIES`` counts.
    """
    counts = staged(term_counts(docs, lang_col, source_col, text_col), "audit-counts")
    kept = staged(kept_terms(counts, least_docs), "audit-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    met = counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    totals = met.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    named = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    named = named.na.fill(0, ["total", "own", "terms", "lang_total"])
    sizes = named.groupBy("lang").agg(F.ceil(F.count("*") / CHUNK_GROUPS).alias("chunks"))
    groups = staged(
        named.join(sizes, "lang").select(
            "*", F.coalesce(_share("0", "total", "terms"), F.lit(0)).alias("p0"), F.expr("pmod(xxhash64(source), chunks)").alias("chunk")
        ),
        "audit-groups",
    )
    cells = staged(
        met.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "level", "block", "bit", "chunk", "chunks", "p0",
            _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"),
        ),
        "audit-cells",
    )

    # one set of bits for each (group, count), 64 terms to a word
    bitmaps = cells.groupBy("lang", "level", "block", "chunk", "chunks", "source", "n", "p", "p0", F.expr("bit div 64").cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, bit % 64))").alias("bits")
    )
    joint = _by_chunks(bitmaps).groupBy("lang", "level", "block", "first", "second").applyInArrow(_of_bits, _PAIRS)
    has = cells.groupBy("lang", "source", "chunk", "chunks", "p0", "p").agg(F.count("*").alias("n"))
    # by complement: the terms that a group does not have
    lacks = groups.select("lang", "source", "chunk", "chunks", "p0", F.col("p0").alias("p"), (F.col("terms") - F.col("own")).alias("n"))
    apart = _by_chunks(has.unionByName(lacks)).groupBy("lang", "first", "second").applyInArrow(_of_levels, _PAIRS)
    sums = joint.unionByName(apart).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", "value", F.explode(ways).alias("_way")).select("lang", "_way.source", F.lit("pair").alias("part"), "_way.item", "value")
    terms = cells.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    best = terms.withColumn("rank", rank).filter(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", rank).unionByName(best)


AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang) AS terms FROM kept),
grp AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
counted AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.n AS lang_n, k.total AS lang_total, k.terms
  FROM grp g JOIN langs k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * terms) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms) AS q FROM counted),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
