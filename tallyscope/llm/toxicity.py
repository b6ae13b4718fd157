"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, and context windows.

Terms that mark toxic texts are counted out of labelled rows and put into a trie.  The Levenshtein
automata of all terms, intersected with the trie, run as one automaton over the letters of a word;
its states are sets of (trie node, errors, letter owed by a transposition), made deterministic when
first reached.  Each hit is weighed by what its window shows: a hit inside quotation marks, or near
a word that reports speech, counts as quoted.  A logistic regression turns the counts into a score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallyscope.llm.common import held_out, staged, text_slices

#: Labelled rows learned from: so many of each class, those with the smallest hashes of their ids.
LABELLED = 10_000
#: A term needs this share of the toxic texts (and three of them) and this share of its texts toxic.
LEAST_SHARE, LEAST_PRECISION = 0.005, 0.9
#: Stems: beginnings of these lengths that so many different words share, judged like terms.
STEM_LENGTHS, STEM_WORDS = range(4, 8), 4
#: Terms shorter than the first length match exactly, shorter than the second with one error, others with two.
ERRORS_FROM = (5, 10)
#: Words on each side of a hit that are its context window.
WINDOW = 5
#: Entries of a task's table of words, and the longest word kept there.
MOST_WORDS, LONGEST = 200_000, 64
#: Words that report what others said.
REPORTING = frozenset("said says wrote quote quoted quotes called term word phrase slur dijo dice palabra sagte schrieb wort zitat dit mot citation".split())

#: Letters with their marks, digits and joiners in all scripts, and the signs that stand for letters.
_WORD = regex.compile(r"[\w$@]+")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]")
_STRETCHED = re.compile(r"(.)\1{2,}")
_LOOKALIKE = str.maketrans("013457@$", "oieastas")


def plain(word: str) -> str:
    """Look-alike digits and signs as letters (in words that have letters), stretched letters once."""
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(_LOOKALIKE)
    return _STRETCHED.sub(r"\1", word)


def allowed_errors(term: str) -> int:
    return sum(len(term) >= n for n in ERRORS_FROM)


class LexiconAutomaton:
    """``match(word)`` gives (term, errors) of the nearest term within its allowed errors, or None."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room: list[int] = [0]  # most errors that a term at or below the node allows
        for term in sorted(terms):
            node = 0
            for letter in term:
                self.room[node] = max(self.room[node], allowed_errors(term))
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.children[node][letter]
            self.room[node] = max(self.room[node], allowed_errors(term))
            self.term[node] = term
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        """The state of these items and of those reached by leaving out letters of a term."""
        todo = list(items)
        while todo:
            node, errors, owed = todo.pop()
            if not owed and errors < self.room[node]:
                for child in self.children[node].values():
                    item = (child, errors + 1, "")
                    if errors + 1 <= self.room[child] and item not in items:
                        items.add(item)
                        todo.append(item)
        key = frozenset(items)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(errors, self.term[n]) for n, errors, owed in key if not owed and self.term[n] and errors <= allowed_errors(self.term[n])]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        items = set()
        for node, errors, owed in self.states[state]:
            children = self.children[node]
            if owed:
                if letter == owed:
                    items.add((node, errors, ""))
                continue
            if letter in children:
                items.add((children[letter], errors, ""))
            if errors < self.room[node]:
                items.add((node, errors + 1, ""))
                for other, child in children.items():
                    if errors < self.room[child]:
                        items.add((child, errors + 1, ""))
                        if letter in self.children[child] and errors < self.room[self.children[child][letter]]:
                            items.add((self.children[child][letter], errors + 1, other))
        self.moves[state][letter] = self._state(items)
        return self.moves[state][letter]

    def match(self, word: str) -> tuple[str, int] | None:
        state = self.start
        for letter in word:
            following = self.moves[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if not self.states[state]:
                return None
        return self.accepts[state]


class Model(NamedTuple):
    stems: frozenset  # beginnings of words that mark toxic texts
    terms: dict[str, float]  # weight of an exact hit's near misses: how often they were toxic
    clean: frozenset  # words near a term, or with a stem, that clean texts use
    weights: tuple[float, ...]


class WordHits(dict):
    """word -> (term, weight) or None, found when first looked up; emptied when it is full."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, LexiconAutomaton(list(model.terms))

    def __missing__(self, word: str):
        found = None
        bare = plain(word)
        if word in self.model.terms:
            found = (word, 1.0)
        elif word not in self.model.clean:
            if any(word[:n] in self.model.stems for n in STEM_LENGTHS):
                found = (word, 1.0)
            elif hit := self.automaton.match(bare):  # ends at the first letter that no term allows
                found = (hit[0], 1.0 if bare in self.model.terms else self.model.terms[hit[0]])
        if len(word) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


FEATURES = 5


def features(text: str, hits: WordHits) -> list[float]:
    """Counts of a text's hits: exact, near, quoted, different terms, share of all words."""
    lower = text.lower()
    words = _WORD.findall(lower)
    present = {w for w in set(words) if hits[w]}
    if not present:
        return [0.0] * FEATURES
    quoted_parts = [m.span() for m in _QUOTED.finditer(lower)]
    exact = near = quoted = 0.0
    terms = Counter()
    places = list(_WORD.finditer(lower))
    for i, place in enumerate(places):
        word = place[0]
        if word not in present:
            continue
        term, weight = hits[word]
        window = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        if any(a <= place.start() and place.end() <= b for a, b in quoted_parts) or not REPORTING.isdisjoint(window):
            quoted += weight
            continue
        terms[term] = max(terms[term], weight)
        if weight == 1.0:
            exact += 1
        else:
            near += weight
    return [float(np.log1p(x)) for x in (exact, near, quoted, sum(terms.values()), 100 * (exact + near) / len(words))]


def _probability(weights: tuple[float, ...], rows: np.ndarray) -> np.ndarray:
    z = weights[0] + rows @ np.asarray(weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fitted(rows: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, drawn to a prior in which quoted hits count a quarter."""
    prior = np.array([-3.0, 2.0, 1.5, 0.5, 1.0, 0.5])
    x = np.column_stack([np.ones(len(rows)), rows])
    w, pull = prior.copy(), np.array([0.01, 1, 1, 1, 1, 1.0])
    for _ in range(25):
        p = _probability(tuple(w), rows)
        slope = x.T @ (toxic - p) - pull * (w - prior)
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
    return tuple(float(v) for v in w)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text, digest of the words in order, different words) of (toxic, text), cut as for scoring."""
    for part in text_slices(batches, 1):
        words = [_WORD.findall((text or "").lower()) for text in part.column(1).to_pylist()]
        digests = [hashlib.sha256(" ".join(w).encode()).digest() for w in words]
        different = pa.array([list(dict.fromkeys(w)) for w in words], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary()), different], names=["_toxic", "_text", "_digest", "_words"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model:
    """The model learned from labelled rows outside fold 0.

    At most ``labelled`` ids of each class are taken, a bounded sample chosen by hash; their number
    bounds all that is collected here.  Rows without id or label are left out; of several labels of
    an id the largest counts.  Texts with the same words in the same order count once for a term; all
    others are texts of their own, however many words they share.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    chosen = [known.filter(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(labelled) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id")
    # written before words are exploded, so that each text is cut once
    cut = texts.select("_toxic", "_text").mapInArrow(_cut, "_toxic int, _text string, _digest binary, _words array<string>")
    texts = staged(cut, "labelled")

    per_word = texts.select("_toxic", "_digest", F.explode("_words").alias("word"))
    counts = per_word.distinct().groupBy("word").agg(F.sum("_toxic").alias("toxic"), F.sum(1 - F.col("_toxic")).alias("clean"))
    counts = staged(counts, "words")
    all_toxic = texts.filter("_toxic = 1").select("_digest").distinct().count()
    least = max(3, LEAST_SHARE * all_toxic)
    found = counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean")))).collect()
    terms = {row["word"]: 1.0 for row in found}
    begun = counts.select("*", F.explode(F.array(*[F.substring("word", 1, n) for n in STEM_LENGTHS])).alias("stem")).filter("length(word) > length(stem)")
    begun = begun.groupBy("stem").agg(F.count(F.lit(1)).alias("words"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    begun = begun.filter((F.col("words") >= STEM_WORDS) & (F.col("toxic") >= least) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    stems = frozenset(row["stem"] for row in begun.collect())

    # how often near misses of each term were toxic, and which of them and of words with a stem clean texts use
    automaton = LexiconAutomaton(list(terms))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(w, plain(w)) for w in batch.column(0).to_pylist()]
            begun = ["" if any(w[:n] in stems for n in STEM_LENGTHS) else None for w, _ in words]
            hit = [None if w in terms else (automaton.match(bare) or (stem,))[0] for (w, bare), stem in zip(words, begun)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.string())], names=["word", "toxic", "clean", "term"]).filter(pa.array([h is not None for h in hit]))

    # words near a term, and those that only begin like one (of no term): a part of the sample's words
    misses = counts.mapInArrow(near, "word string, toxic bigint, clean bigint, term string").collect() if terms or stems else []
    toxic, clean = Counter(), Counter()
    for row in misses:
        toxic[row["term"]] += row["toxic"]
        clean[row["term"]] += row["clean"]
    # a near miss starts at one in two
    terms = {t: min(0.99, (toxic[t] + 1) / (toxic[t] + clean[t] + 2)) for t in terms}
    model = Model(stems, terms, frozenset(row["word"] for row in misses if row["clean"] > row["toxic"]), (0.0,) * (FEATURES + 1))
    rows = texts.select("_toxic", "_text").mapInArrow(_with_features(model), f"toxic int, {', '.join(f'f{i} double' for i in range(FEATURES))}").toPandas()
    return model._replace(weights=_fitted(rows.to_numpy(float)[:, 1:], rows["toxic"].to_numpy(float)))


def _with_features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = WordHits(model)
        for part in text_slices(batches, 1):
            rows = np.array([features(t or "", hits) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, rows.T)], names=["toxic", *(f"f{i}" for i in range(FEATURES))])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score from 0 to 1) of each row's whole text.  A null or empty text has the score of a text
    without hits; null ids are kept; repeated rows get equal scores; an empty table gives no rows.
    Only the two named columns are read, and only the text takes part in the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = WordHits(model)
        for part in text_slices(batches, 1):
            rows = np.array([features(t or "", hits) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_probability(model.weights, rows))], names=["id", "score"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns, whatever those are called.

    A null or empty text has no hits and the score of a text without any, which a fitted model keeps.
    Rows with null ids stay, repeated rows stay or go together, and an empty table gives no rows."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = WordHits(model)
        for part in text_slices(batches, column):
            rows = np.array([features(t or "", hits) for t in part.column(column).to_pylist()])
            yield part.filter(pa.array(_probability(model.weights, rows) < threshold))

    return docs.mapInArrow(run, docs.schema)
