"""Exact, near and substring dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from llm_rows import LONG, TEXTS
from oracle import compare, connect
from pyspark.sql import functions as F

from tallyscope.llm import radix_dedup, registry, setsketch_dedup, suffix_dedup
from tallyscope.llm.common import narrowed
from tallyscope.llm.components import components, joined_components


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    found = radix_dedup.duplicates(odd).collect()
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    want = sorted((r.doc_id, min((i for i in groups[normal(r.text)] if i is not None), default=None), len(groups[normal(r.text)]), hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows if r.doc_id is not None)
    assert sorted((r.id, r.keep_id, r.group_size, r.text_sha256) for r in found if r.id is not None) == want
    assert sum(r.kept for r in found) == len(groups)  # of rows repeated with one id, one stays
    assert all(r.id == r.keep_id for r in found if r.kept)
    assert radix_dedup.duplicates(none).count() == 0


def test_exact_digits_decide(spark):
    """Texts that part only late, at, or behind the edges of the levels."""
    base = "".join(chr(97 + i % 26) for i in range(70_000))
    texts = [base[:n] + tail for n in (0, 15, 16, 17, 255, 256, 257, 4095, 4096, 65_535, 65_536, 65_537) for tail in ("", "x", "y", "xx")]
    rows = [(i, t) for i, t in enumerate(texts + texts[::3])]
    found = {r.id: (r.keep_id, r.group_size) for r in radix_dedup.duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        assert found[i] == (min(same), len(same))


def test_exact_keeps_rows_and_columns(odd, none):
    kept = radix_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({normal(t) for t in TEXTS} | {"other text, id of another row"})
    assert radix_dedup.deduplicated(none).count() == 0


def test_exact_equals_sql(spark, folder):
    assert compare(registry.queries()["op4_exact_dedup"](spark, folder), connect(folder), registry.oracle_sql()["op4_exact_dedup"]) is None


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {n: n for pair in links for n in pair}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    linked = {n for a, b in links if a != b for n in (a, b)}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {(r.node, r.label) for r in components(df).collect()} == {(n, top(n)) for n in linked}
    assert components(df.limit(0)).count() == 0
    halves = joined_components(components(df.filter("a % 2 = 0")), df.filter("a % 2 = 1"))
    assert {(r.node, r.label) for r in halves.collect()} == {(n, top(n)) for n in linked} and halves.count() == len(linked)


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_near(rows, size, percent):
    """(id, set size, smallest id of the component) of each row."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    smallest = {}
    for n, (i, _) in enumerate(rows):
        if i is not None and sets[n]:
            smallest[top(n)] = min(smallest.get(top(n), i), i)
    return [(i, len(sets[n]), smallest.get(top(n)) if sets[n] else i) for n, (i, _) in enumerate(rows)]


def near_rows(df, **options):
    return sorted((tuple(r) for r in setsketch_dedup.near_duplicates(df, **options).select("id", "n_shingles", "component_id").collect()), key=repr)


def test_near_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert near_rows(odd, size=3, percent=85) == sorted(brute_near(rows, 3, 85), key=repr)
    assert near_rows(none) == []


def test_near_chains_and_crowds(spark):
    """Chains whose ends are not linked, and a crowd around one text with members just below the bound."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, n = [], itertools.count()
    for _ in range(6):  # chains: a few words change at each step
        words = [word() for _ in range(120)]
        for _ in range(12):
            rows.append((next(n), " ".join(words)))
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(150)]
    for i in range(150):  # a crowd with one to eight changes each
        words = list(base)
        for _ in range(1 + i % 8):
            words[rng.randrange(len(words))] = word()
        rows.append((next(n), " ".join(words)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size, percent in ((3, 85), (5, 80)):
        assert near_rows(df, size=size, percent=percent) == sorted(brute_near(rows, size, percent), key=repr)


def test_near_large_buckets_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "CHUNK", 3)
    test_near_chains_and_crowds(spark)


def test_near_links_grow_with_members(spark, monkeypatch):
    """Of a crowd with many pairs on both sides of the bound, only links that join components leave the tasks."""
    monkeypatch.setattr(setsketch_dedup, "CHUNK", 40)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    for members in (100, 200, 400):
        rows = []
        for i in range(members):
            words = list(base)
            for _ in range(rng.randrange(2, 9)):
                words[rng.randrange(len(words))] = word()
            rows.append((i, " ".join(words)))
        counts = []
        real = setsketch_dedup.staged
        monkeypatch.setattr(setsketch_dedup, "staged", lambda df, name: counts.append((name, (out := real(df, name)).count())) or out)  # noqa: B023
        assert near_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), size=3, percent=85) == sorted(brute_near(rows, 3, 85), key=repr)
        monkeypatch.setattr(setsketch_dedup, "staged", real)
        assert sum(n for name, n in counts if name == "links") <= 3 * members, counts


@pytest.mark.parametrize("percent", [50, 70, 80, 85, 95])
def test_bands_follow_the_threshold(percent):
    width = setsketch_dedup.band_width(percent)
    assert (1 - (percent / 100) ** width) ** (setsketch_dedup.REGISTERS // width) <= setsketch_dedup.MISSED or width == 1


def test_near_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, c, i == c) for i, n, c in brute_near(rows, 3, 85))
    assert sorted(tuple(r) for r in registry.queries()["op3_near_dedup"](spark, folder).collect()) == want


def test_near_keeps_rows_and_columns(odd):
    kept = setsketch_dedup.deduplicated(odd)
    rows = [(n, r.text) for n, r in enumerate(odd.collect())]
    assert kept.columns == odd.columns and kept.count() == sum(i == c for i, _, c in brute_near(rows, 5, 80))


def test_estimates_are_near(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for common in (1000, 1700, 1900):
        one, two = np.sort(values[:2000]), np.sort(values[2000 - common : 4000 - common])
        sketch = setsketch_dedup.registers(np.concatenate([one, two]), np.array([0, 2000, 4000]))
        true = common / (4000 - common)
        assert abs(setsketch_dedup.estimated(sketch[:1], sketch[1:], np.array([2000.0]), np.array([2000.0]))[0] - true) < 0.12
    # sketches merge by their maxima
    both = setsketch_dedup.registers(np.sort(values), np.array([0, 3000]))
    parts = setsketch_dedup.registers(values, np.array([0, 1200, 3000]))
    assert (parts.max(axis=0) == both[0]).all()


def brute_repeats(rows, length):
    seen = {}
    raw = [(t or "").encode() for _, t in rows]
    for t in raw:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, raw):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, length):
    found = suffix_dedup.without_repeats(df, length)
    return sorted(((r.id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found.collect()), key=repr)


def test_repeats_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows_, df = [(i, t) for i, t in rows if t is None or len(t) < 10_000], odd.filter("text is null or length(text) < 10000")
    for length in (33, 200):
        assert removed(df, length) == brute_repeats(rows_, length)
    whole = [r for r in removed(odd, 200) if r[1] == len(LONG)]
    assert len(whole) == 2 and all(r[2] == len(LONG) for r in whole)
    assert removed(none, 200) == []


@pytest.mark.parametrize("part", [1 << 20, 700])
def test_repeats_of_every_shape(spark, monkeypatch, part):
    """Passages at all edges, overlapping, periodic, shared by many, and texts longer than a part."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [noise(n) for n in (60, 61, 75, 100, 140, 300, 900)] + ["é" * 40 + noise(30)]
    rows = []
    for i in range(150):
        cut = [p[rng.randrange(0, 8) : len(p) - rng.randrange(0, 8)] for p in rng.sample(passages, rng.randrange(0, 4))]
        rows.append((i, "".join(x for p in cut for x in (noise(rng.randrange(0, 150)), p)) + noise(rng.randrange(0, 100))))
    rows += [(200, "ab" * 300), (201, "x" * 61), (202, "x" * 60), (203, "abc" * 25), (204, passages[6] * 3)]
    monkeypatch.setattr(suffix_dedup, "PART", part)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert removed(df, 60) == brute_repeats(rows, 60)


def test_repeats_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in registry.queries()["op7_suffix_dedup"](spark, folder).collect()), key=repr) == brute_repeats(rows, 200)


def test_shuffle_files_of_the_buckets_go_before_texts_move(spark, monkeypatch):
    steps, freed, members = [], setsketch_dedup.freed, setsketch_dedup._members
    monkeypatch.setattr(setsketch_dedup, "freed", lambda s: (steps.append("freed"), freed(s))[1])
    monkeypatch.setattr(setsketch_dedup, "_members", lambda *a: (steps.append("texts"), members(*a))[1])
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (2, long + " x"), (3, "a b c")], "doc_id long, text string")
    found = {r["id"]: r["component_id"] for r in setsketch_dedup.near_duplicates(df, 3, 85).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert steps[:2] == ["freed", "texts"]


def moved_rows(df):
    """Rows of the largest shuffle of a query, which is run for it."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return found, max((int(float(n)) for n in re.findall(r"rowCount=([0-9.E+]+)", df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))), default=0)


def test_only_texts_that_share_a_bucket_move(spark, monkeypatch):
    """Texts that share no bucket with others stay where they are, and so do the sets once made."""
    moved, real = {}, setsketch_dedup.staged
    texts = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(2000)] + [" ".join(f"w{i}_{j}" for j in range(60)) + " x" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)

    def staged(table, name):
        if name in ("members", "links"):
            moved.setdefault(name, []).append(moved_rows(table))
        return real(table, name)

    monkeypatch.setattr(setsketch_dedup, "staged", staged)
    monkeypatch.setattr(setsketch_dedup, "CHUNK", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.id: r.component_id for r in setsketch_dedup.near_duplicates(df, 3, 85).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {i: i - 2000 if i >= 2000 else i for i in range(2020)}
    [(members, most)] = moved["members"]
    assert len(members) == 40 and 40 <= most <= 240


def test_narrowed_keeps_every_wanted_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").alias("row"))
    for key in (F.col("k"), F.struct(F.col("k").isNull().alias("unnamed"), F.col("k").alias("k")), F.col("k").cast("string"), F.col("k").cast("double")):
        keyed = rows.select(key.alias("k"), "row")
        for wanted in (keyed.filter("row % 100 = 0"), keyed.filter("row = 0"), keyed.filter("row % 2 = 0"), keyed):
            kept = [r.row for r in narrowed(keyed, "k", wanted.withColumnRenamed("k", "other"), "other").select("row").collect()]
            want = {r.row for r in wanted.collect()}
            assert want <= set(kept) and len(kept) == len(set(kept)) <= len(want) + 1000
        assert narrowed(keyed, "k", keyed.limit(0), "k").count() == 0
