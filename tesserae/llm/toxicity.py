"""Toxicity of whole texts: a learned lexicon, misspellings of it, and the context of each hit.

Training. From a bounded sample of labelled rows (``PER_CLASS`` of each class, the first by a hash
of the key) the words, and the beginnings of words, whose presence tells toxic rows from others
become the terms and stems of the lexicon. Copies would make chance words look telling, so texts of
the sample that share a MinHash band count as one there; no row is left out. What clean rows quote
does not speak for a word, as they may quote abuse. A logistic regression
over the context features of the same sample gives the weights; classes are weighed back to their
shares of all training rows. Words and beginnings one edit away that the sample's clean rows hold
(``oron``, ``closer``) are no misspellings. Equal tables give equal models, however they are partitioned.

Scoring. The lexicon is a trie, intersected with the Levenshtein automaton of one edit for terms and stems of
``FUZZY`` letters and more; the product automaton is made deterministic state by state as words
demand it, so a word costs a table look-up per letter until it can no longer match. Around each hit
a window of words separates quotation (quotation marks or a verb of saying) from address (second
person), and the document's score comes from the counts of each kind of hit.

Null and empty texts have no hit and get the score of that. Repeated rows are scored alike. Without
labelled texts of both classes every score is the share of toxic rows (0 without labels). Null keys count
as the empty string when rows are dealt to folds; a key that is labelled twice has the greater label,
and one with several texts is trained with the least. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .simhash import BANDS, bands, gram_hashes, roots

PER_CLASS, TERMS, FUZZY, WINDOW, CACHE = 4_000, 200, 4, 6, 100_000
#: Letters of a stem, rows that a feature must be in, and the least log-likelihood ratio of one; the
#: ratio must also be beyond what chance gives the best of all features, twice the log of their number.
STEM_LETTERS, ROWS, TELLING = (4, 5, 6, 7, 8), 4, 15.0
WORD = re.compile(r"\w+")
#: Second person, and verbs of saying, in the languages at hand (fixed values).
ADDRESS = frozenset(
    "you your yours yourself yourselves u ur thou thee ye du dich dir dein deine deinen deinem deiner ihr euch euer eure tu te toi ton ta tes vous votre vos "
    "tú ti contigo vosotros os vuestro usted ustedes tuyo eres sois".split()
)
SAYING = frozenset(
    "say says said saying write writes wrote written call calls called quote quotes quoted claim claims claimed tell told according "
    "sagt sagte sagten schreibt schrieb zitat zitiert zitierte nennt nannte nannten laut dit disait dire écrit écrivait cite citait cité appelle appelait appelé selon "
    "dice dijo dijeron escribe escribió cita citó citado llama llamó llamaron según".split()
)
QUOTES = "\"'“”„«»‘’‹›"
#: A quoted passage; clean rows may quote abuse, so what they quote does not speak for a word.
QUOTED = '["“”„«»][^"“”„«»]{0,300}["“”„«»]'


class Lexicon:
    """Lexicon trie times Levenshtein automaton, made deterministic lazily."""

    def __init__(self, terms: list[str], stems: list[str] = (), loud: list[str] = (), fuzzy: int = FUZZY, states: int = 50_000, spared: list[str] = (), stem_edits: bool = False):
        """``loud`` terms allow no edit; ``spared`` are the words (=) and beginnings (^) that are no misspelling."""
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.edits = [0]  # the most edits that any term below allows
        self.allowed = {t: int(len(t) >= fuzzy and t not in loud) for t in terms}
        for t in terms:
            allowed, node = self.allowed[t], 0
            self.edits[0] = max(self.edits[0], allowed)
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.edits.append(0)
                node = self.next[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            self.term[node] = t
        self.stem: dict[int, str] = {}
        self.spared = frozenset(spared)
        self.stem_allowed = {t: int(stem_edits and len(t) >= fuzzy) for t in stems}
        for t in stems:
            allowed, node = self.stem_allowed[t], 0
            self.edits[0] = max(self.edits[0], allowed)
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.edits.append(0)
                node = self.next[node][c]
                self.edits[node] = max(self.edits[node], allowed)
            self.stem[node] = t
        self.most = states
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[str, int] | None] = []
        self.begun: list[str | None] = []  # the stem that a word in this state begins with
        self.near: list[str | None] = []  # the stem that it begins one edit from
        self.sets: list[frozenset] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits), closed under leaving out a letter of the term; -1 if empty."""
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e < self.edits[child] and (child, e + 1) not in pairs:
                    pairs.add((child, e + 1))
                    todo.append((child, e + 1))
        if not pairs:
            return -1
        key = frozenset(pairs)
        if key not in self.number:
            self.number[key] = len(self.moves)
            self.moves.append({})
            self.sets.append(key)
            ends = [(e, self.term[n]) for n, e in key if self.term[n] and e <= self.allowed[self.term[n]]]
            self.final.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.begun.append(next((self.stem[n] for n, e in sorted(key) if e == 0 and n in self.stem), None))
            self.near.append(next((self.stem[n] for n, e in sorted(key) if e == 1 and n in self.stem and self.stem_allowed[self.stem[n]]), None))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if (child := self.next[node].get(c)) is not None:
                out.add((child, e))
            if e < self.edits[node]:
                out.add((node, e + 1))
            for child in self.next[node].values():
                if e < self.edits[child]:
                    out.add((child, e + 1))
        self.moves[state][c] = self._state(out)
        return self.moves[state][c]

    def look(self, word: str) -> tuple[tuple[str, int] | None, list[tuple[str, str]]]:
        """What ``word`` is as it stands, and, if nothing, its (term or stem, neighbour) one edit away."""
        if len(self.moves) > self.most:
            self._reset()
        state, moves, near = self.start, self.moves, []
        for i, c in enumerate(word):
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return None, near
            state = to
            if self.begun[state]:
                return (self.begun[state], 0), []
            if self.near[state]:
                near.append((self.near[state], "^" + word[: i + 1]))
        last = self.final[state]
        if last and not last[1]:
            return last, []
        return None, ([(last[0], "=" + word)] if last else []) + near

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that ``word`` is, or is one edit from, or the stem it begins with, and the edits.

        A word that begins one edit from a stem is no hit if any such beginning is spared.
        """
        exact, near = self.look(word)
        if exact or not near:
            return exact
        if near[0][1][0] == "=" and near[0][1] not in self.spared:
            return near[0][0], 1
        starts = [(t, n) for t, n in near if n[0] == "^"]
        return (starts[0][0], 1) if starts and not any(n in self.spared for _, n in starts) else None


FEATURES = ("direct", "quoted", "addressed", "density")


def scanner(terms: list[str], stems: list[str] = (), spared: list[str] = (), window: int = WINDOW) -> Callable[[str], list[float]]:
    """A function from a text to its features, in the order of FEATURES."""
    lexicon = Lexicon(terms, stems, spared=spared, stem_edits=True)

    class Known(dict):
        def __missing__(self, word: str) -> tuple[str, int] | None:
            self[word] = found = lexicon.find(word)
            return found

    known = Known()

    def features(text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        if len(known) > CACHE:
            known.clear()
        hits = {w: f for w in set(words) if (f := known[w])}
        if not hits:
            return [0.0] * len(FEATURES)
        direct = quoted = addressed = 0
        places = list(WORD.finditer(low))
        for i, m in enumerate(places):
            if m[0] not in hits:
                continue
            around = words[max(0, i - window) : i] + words[i + 1 : i + 1 + window]
            a, b = places[max(0, i - window)].start(), places[min(len(places) - 1, i + window)].end()
            marks = any(c in QUOTES for c in low[a : m.start()]) and any(c in QUOTES for c in low[m.end() : b + 1])
            if marks or not SAYING.isdisjoint(around):
                quoted += 1
            else:  # as it is written or misspelled
                direct += 1
            addressed += not ADDRESS.isdisjoint(around)
        return [float(np.log1p(x)) for x in (direct, quoted, addressed, 100 * direct / len(words))]

    return features


@dataclass(frozen=True)
class Model:
    terms: list[str]
    weights: list[float]  # of the features, then the intercept
    stems: list[str] = ()
    spared: list[str] = ()  # words (=) and beginnings (^) that are no misspelling


def fold(key: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - len(y) * penalty * w / 100
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(len(y) * penalty / 100 + 1e-9)
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, held: int = 5, per_class: int = PER_CLASS, terms: int = TERMS) -> Model:
    """The lexicon and weights, from labelled rows whose fold is not 0."""
    rows = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), held) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    unknown = Model([], [0.0] * len(FEATURES) + [float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))])
    if not shares.get(0) or not shares.get(1):
        return unknown
    some = None
    for c in (0, 1):
        first = rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(per_class)
        some = first if some is None else some.unionByName(first)
    # A labelled key with several texts is trained with the least of them, so the sample stays bounded.
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id")
    plain = shared.stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    told = F.when(F.col("toxic") == 1, F.col("text")).otherwise(F.regexp_replace("text", QUOTED, " "))
    sample = shared.stored(plain.join(F.broadcast(copies(plain)), "doc_id").withColumn("told", told), "grouped")
    shared.dropped(docs.sparkSession, plain)
    n = {r.toxic: (r.n, r.groups) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.countDistinct("group").alias("groups")).collect()}
    if not n.get(0) or not n.get(1):
        return unknown
    (rows_pos, pos), (rows_neg, neg) = n[1], n[0]
    words = F.regexp_extract_all(F.lower("told"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    whole = F.array_distinct(words)
    stems = [F.transform(F.filter(whole, lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.concat(F.lit("^"), F.substring(w, 1, k))) for k in STEM_LETTERS]
    features = F.array_distinct(F.concat(F.transform(F.filter(whole, lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("="), w)), *stems))
    seen = sample.select("toxic", "group", F.explode(features).alias("f")).distinct()
    counts = shared.stored(seen.groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") + F.col("c") >= ROWS), "counts")
    floor = max(TELLING, 2 * float(np.log(max(1, counts.count()))))
    likely = counts.where((F.col("t") >= ROWS) & (F.col("c") * max(pos, 1) <= 0.02 * F.col("t") * max(neg, 1)))
    best = likely.orderBy(F.desc("t"), "f").limit(40 * terms).collect()
    model_terms, model_stems = chosen([(r.f, int(r.t), int(r.c)) for r in best], pos, neg, terms, floor)
    spared = spared_words(sample, model_terms, model_stems, rows_pos, rows_neg)
    found = sorted(features_of(sample, Model(model_terms, [], model_stems, spared), extra=["toxic"]).collect(), key=lambda r: (r.doc_id, r.toxic))
    shared.dropped(docs.sparkSession, sample)
    x = np.array([[*r.features, 1.0] for r in found] or np.zeros((0, len(FEATURES) + 1)))
    y = np.array([r.toxic for r in found], float)
    weight = np.where(y == 1, shares[1] / max(rows_pos, 1), shares[0] / max(rows_neg, 1))
    return Model(model_terms, [float(v) for v in logistic(x, y, weight)], model_stems, spared)


def copies(sample: DataFrame) -> DataFrame:
    """(doc_id, group) of a bounded sample: texts that share a MinHash band, directly or not, are one group."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            told = pa.array([bands(gram_hashes(t, 5)) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), told], names=["doc_id", "bands"])

        return work

    slim = sample.select("doc_id", "text")
    told = shared.arrow_map(slim, f"{shared.ddl(slim, 'text')}, bands array<long>", make).toArrow().sort_by("doc_id")
    own = np.flatnonzero(np.diff(told.column("bands").combine_chunks().offsets.to_numpy()) > 0)
    flat = told.column("bands").combine_chunks().flatten().to_numpy().reshape(len(own), BANDS)
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for band in flat.T if len(own) else ():
        _, first, inverse = np.unique(band, return_index=True, return_inverse=True)
        a.append(own)
        b.append(own[first[inverse.ravel()]])
    group = roots(len(told), np.concatenate(a), np.concatenate(b))
    named = told.select(["doc_id"]).append_column("group", pa.array(group, pa.int64()))
    return sample.sparkSession.createDataFrame(named)


def chosen(counts: list[tuple[str, int, int]], pos: int, neg: int, most: int = TERMS, floor: float = TELLING) -> tuple[list[str], list[str]]:
    """Terms and stems that are telling by log-likelihood ratio, the strongest ``most`` of each.

    A feature is ``=word`` or ``^stem``. Of stems that begin alike the longest stays that nearly all
    words of the shorter ones share, else the shorter one.
    """

    def ratio(t: int, c: int) -> float:
        total, out = pos + neg, 0.0
        for seen, n in ((t, pos), (c, neg)):
            for k, both in ((seen, t + c), (n - seen, total - t - c)):
                if k:
                    out += k * np.log(k * total / (n * both))
        return 2 * out

    scored = sorted(((ratio(t, c), f, t) for f, t, c in counts), key=lambda x: (-x[0], x[1]))
    telling = [(f, t) for s, f, t in scored if s >= floor]
    stems: dict[str, int] = {}
    for f, t in sorted(telling, key=lambda x: (len(x[0]), x[0])):
        stem = f[1:]
        if f[0] == "^":
            short = next((x for x in stems if stem.startswith(x)), None)
            if short is None:
                stems[stem] = t
            elif t >= 0.98 * stems[short]:
                del stems[short]
                stems[stem] = t
    return [f[1:] for f, _ in telling if f[0] == "="][:most], sorted(stems, key=lambda x: (-stems[x], x))[:most]


def spared_words(sample: DataFrame, terms: list[str], stems: list[str], pos: int, neg: int) -> list[str]:
    """Words (=) and beginnings (^) one edit from the lexicon that clean rows hold, such as ``closer`` by ``loser``.

    One that toxic rows hold over ten times as often as clean ones is a misspelling all the same.
    """

    def near(batches):
        lexicon = Lexicon(terms, stems, stem_edits=True)
        for batch in batches:
            seen: dict[tuple[str, int], int] = {}
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name in {n for w in set(WORD.findall((text or "").lower())) for _, n in lexicon.look(w)[1]}:
                    seen[name, toxic] = seen.get((name, toxic), 0) + 1
            rows = [(name, n * toxic, n * (1 - toxic)) for (name, toxic), n in seen.items()]
            name, t, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(t, pa.int64()), pa.array(c, pa.int64())], names=["name", "t", "c"])

    counts = sample.select("told", "toxic").mapInArrow(near, "name string, t long, c long").groupBy("name").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    return sorted(r.name for r in counts.where((F.col("c") > 0) & (10 * F.col("c") * pos >= F.col("t") * neg)).collect())


def features_of(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scan = scanner(model.terms, model.stems, model.spared)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = pa.array([scan(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            names = ["doc_id", *batch.schema.names[2:], "features"]
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], got], names=names)

        return work

    slim = docs.select("doc_id", "text", *(extra or []))
    return shared.arrow_map(slim, f"{shared.ddl(slim, 'text')}, features array<double>", make)


def score(docs: DataFrame, model: Model, held: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted. One pass over the texts, no shuffle."""
    found = features_of(docs.select("doc_id", "text"), model)
    margin = F.lit(model.weights[-1])
    for i, w in enumerate(model.weights[:-1]):
        margin = margin + F.col("features")[i] * F.lit(w)
    scored = found.select("doc_id", (fold(F.col("doc_id"), held) == 0).alias("held_out"), (1 / (1 + F.exp(-margin))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, as they are, that the model does not call toxic."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scan, w = scanner(model.terms, model.stems, model.spared), np.array(model.weights)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [float(np.dot([*scan(t or ""), 1.0], w)) < 0 for t in texts]
            return batch.filter(pa.array(keep, pa.bool_()))

        return work

    return shared.arrow_map(docs, shared.ddl(docs), make, text=docs.columns.index("text"))
