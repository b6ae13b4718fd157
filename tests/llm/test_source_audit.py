"""The source audit against counting by hand and against SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest
from llm_rows import TEXTS
from oracle import compare, connect
from pyspark.sql import functions as F

from tallyscope.llm import registry, source_audit

SCHEMA = "doc_id bigint, text string, lang string, source string"


def by_hand(rows, least_docs, most_terms):
    groups, has = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(terms)
        has[lang or ""].update(set(terms))
    out = set()
    for lang in {key[0] for key in groups}:
        kept = [t for t, n in has[lang].items() if n >= least_docs]
        counts = {s: {t: c[t] for t in kept} for (of, s), c in groups.items() if of == lang}
        counts[None] = {t: sum(c[t] for c in counts.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in counts.items()}
        for s in counts.keys() - {None}:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts.keys() - {None, s}]
            terms = [(t, p[s][t] - p[None][t]) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, most_terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


def sample(seed, n=300):
    rng = random.Random(seed)
    words = ["The", "the", "é", "Éa", "zum", "中文", "naïve", "İ", "ſ", "x1y", "q_r", "\x00", "​z", "😀"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "-", "\n"]).join(words[int(rng.random() ** 2 * len(words))] for _ in range(rng.randrange(0, 40)))
        rows.append((i if i % 9 else None, rng.choice([text, text, text, None, "", "123 !"]), rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 5 + ["a", "b", "", None, "c", "Ö", "z" * 30])))
    rows += [(1, "only here", "xx", "one"), (2, None, "xx", "two"), (3, None, "yy", None)] + rows[:20]
    return rows


def found(df, **options):
    return [tuple(r) for r in source_audit.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()]


@pytest.mark.parametrize("small", [False, True])
def test_equals_counting_by_hand(spark, monkeypatch, small):
    if small:  # many blocks, chunks, hand-overs and pieces
        for name, value in {"BLOCK_TERMS": 3, "CHUNK_GROUPS": 2, "MOST_ENTRIES": 7, "PIECE": 5}.items():
            monkeypatch.setattr(source_audit, name, value)
    rows = sample(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(df, least_docs=4, most_terms=6)
    assert len(got) == len(set(got)) and set(got) == by_hand([(r[2], r[3], r[1]) for r in rows], 4, 6)


def test_blocks_of_many_terms(spark):
    """More terms than bits in a word, and counts that many terms share."""
    rng = random.Random(4)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=120)), "en", f"s{i % 7}") for i in range(140)]
    got = found(spark.createDataFrame(rows, SCHEMA), least_docs=3)
    assert set(got) == by_hand([(r[2], r[3], r[1]) for r in rows], 3, 50)


def test_odd_rows(spark, odd, none):
    rows = [(None, t, None, s) for t in TEXTS for s in ("a", None)]
    names = ["n", "term", "p", "q", "block", "bit", "first", "item", "rank", "value", "a", "b", "chunk", "total"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(x) for x in names])
    assert set(found(df, least_docs=2)) == by_hand([(r[2], r[3], r[1]) for r in rows], 2, 50)
    assert source_audit.audit(df.limit(0)).count() == 0
    # no term in enough documents: zeros only
    assert sorted(found(df, least_docs=10**6)) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_equals_sql(spark, folder):
    name = "op12_source_audit"
    assert compare(registry.queries()[name](spark, folder), connect(folder), registry.oracle_sql()[name]) is None
