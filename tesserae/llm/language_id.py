"""Language identification of whole texts, with spans of mixed-language text.

Training. Up to ``PER_LANG`` labelled texts per language (the first by a hash of the key) give the
counts of letter trigrams of words, with their edges, and the scripts a language is written in.

Prediction. Words are runs of letters. The ranges of Unicode scripts narrow a word's candidates to
the languages that use its script, trigram log likelihoods score them, and Viterbi with a penalty
for every switch labels the words. The text's language is the one whose words hold the most
letters; ``score`` is their share. All texts of a slice take their Viterbi steps together. A step
keeps one best language and one bit per language, so the memory of a slice is bounded by its words
times an eighth of the languages; with many languages slices and the memory of words shrink.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if no labelled
row exists. Null keys count as the empty string when rows are dealt to folds. Rows that repeat in
training count as often as they are chosen; rows to predict are labelled alike. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PER_LANG, PENALTY, SMOOTH, CACHE, SLICE = 600, 14.0, 0.5, 300_000, 12_000_000
#: Languages up to which the numbers of remembered words and of a slice's bytes hold; with more they shrink.
MANY = 16
LETTERS = re.compile(r"[^\W\d_]+")
#: First code points of runs of a script, up to the next entry (fixed values).
SCRIPTS = (
    (0x0, "common"), (0x41, "latin"), (0x5B, "common"), (0x61, "latin"), (0x7B, "common"), (0xAA, "latin"), (0xAB, "common"), (0xC0, "latin"),
    (0x2B9, "common"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "common"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "common"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "common"), (0xE00, "thai"), (0xE80, "common"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "common"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"),
    (0x2C60, "latin"), (0x2C80, "common"), (0x3040, "kana"), (0x3100, "common"), (0x3400, "han"), (0x4DC0, "common"), (0x4E00, "han"), (0xA000, "common"),
    (0xAC00, "hangul"), (0xD7B0, "common"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "common"), (0xFF21, "latin"), (0xFF5B, "common"), (0x20000, "han"), (0x32000, "common"),
)
_STARTS = [a for a, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    edged = f"<{word}>"
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    rows: dict[str, int]  # of a trigram in the table; row 0 is for those not seen
    table: np.ndarray  # log likelihoods, a column per language
    scripts: dict[str, np.ndarray]  # of each script, 0 for a language that uses it and -1e4 for others


def build(counts: dict[tuple[str, str], int], uses: dict[tuple[str, str], int]) -> Model:
    """The model from counts of (lang, trigram) and (lang, script)."""
    langs = sorted({lang for lang, _ in counts})
    place = {lang: i for i, lang in enumerate(langs)}
    rows = {g: i for i, g in enumerate(sorted({g for _, g in counts}), 1)}
    table = np.full((len(rows) + 1, len(langs)), SMOOTH)
    for (lang, g), n in counts.items():
        table[rows[g], place[lang]] += n
    total: Counter = Counter()
    for (lang, _), n in uses.items():
        total[lang] += n
    scripts: dict[str, np.ndarray] = {}
    for (lang, s), n in uses.items():
        mask = scripts.setdefault(s, np.full(len(langs), -1e4))
        if lang in place and n >= 0.01 * total[lang]:
            mask[place[lang]] = 0
    scripts = {s: m for s, m in scripts.items() if (m == 0).any()}
    return Model(langs, rows, np.log(table / table.sum(axis=0)) if langs else table, scripts)


def fold(key: Column, n: int = 4) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def fit(docs: DataFrame, held: int = 2, folds: int = 4, per_lang: int = PER_LANG) -> Model:
    """Trigram counts of at most ``per_lang`` labelled texts a language, counted on the executors."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    # Rows without a key differ by their text, so that they are not chosen all together.
    chance = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(6)), F.lit(1 << 40))
    # A first cut by hash leaves some four times the rows wanted of each language, so that no language is ranked whole.
    many = shared.stored(usable.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    near = usable.withColumn("chance", chance).join(shared.small(many, many.count()), "lang").where(F.col("chance") / float(1 << 40) * F.col("n") <= 4 * per_lang + 20)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id", "text"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= per_lang)

    def count(batches):
        for batch in shared.slices(batches, 0):
            seen: Counter = Counter()
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    seen[lang, "script", script(word)] += n
                    for g in grams(word):
                        seen[lang, "gram", g] += n
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(seen.values(), pa.int64())], names=["lang", "kind", "what", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, kind string, what string, n long")
    rows = counts.groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")).collect()
    return build({(r.lang, r.what): r.n for r in rows if r.kind == "gram"}, {(r.lang, r.what): r.n for r in rows if r.kind == "script"})


def viterbi(emit: Callable[[np.ndarray], np.ndarray], sizes: np.ndarray, states: int, penalty: float = PENALTY) -> np.ndarray:
    """Best labels of many sequences at once, laid end to end; ``emit`` gives the scores of places.

    Sequences are taken longest first, so those that still run at a step are the first ones. A switch
    can only come from the best state before it, so a step keeps that state and one bit per state.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = np.append(0, sizes.cumsum())[:-1][order]
    length = sizes[order]
    out = np.zeros(int(sizes.sum()), np.int32)
    if not len(sizes) or not length[0]:
        return out
    running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sequences longer than t
    value = emit(starts[: running[0]])
    back: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(1, length[0]):
        value_t = value[: running[t]]
        best = value_t.argmax(axis=1)
        jump = value_t[np.arange(len(best)), best][:, None] - penalty
        switch = jump > value_t
        back.append((best.astype(np.int32), np.packbits(switch, axis=1)))
        value[: running[t]] = np.where(switch, jump, value_t) + emit(starts[: running[t]] + t)
    # A sequence's row stays as it was at its own end, so all ends are read at once.
    state = value.argmax(axis=1)
    for t in range(length[0] - 1, 0, -1):
        n = running[t]
        out[starts[:n] + t] = state[:n]
        best, switch = back[t - 1]
        bit = switch[np.arange(n), state[:n] >> 3] >> (7 - (state[:n] & 7)) & 1
        state[:n] = np.where(bit == 1, best, state[:n])
    out[starts[: running[0]]] = state
    return out


def labeller(model: Model, penalty: float = PENALTY) -> Callable[[list[str | None]], list[tuple[str, float, list[tuple[int, int, str]]]]]:
    """A function from texts to (language, score, spans) each."""
    known: dict[str, int] = {}
    flat = np.zeros(len(model.langs))
    cache = CACHE * MANY // max(MANY, len(model.langs))
    scores = np.zeros((1 << 12, len(model.langs)), np.float32)

    def learn(words: list[str]) -> None:
        nonlocal scores
        base = len(known)
        while base + len(words) > len(scores):
            scores = np.vstack([scores, np.zeros_like(scores)])
        held, at = 0, 0
        for to, w in enumerate(words, 1):  # in blocks, since every trigram is a row of all languages
            held += len(w)
            if to < len(words) and held * len(model.langs) < 4_000_000:
                continue
            ids = [[model.rows.get(g, 0) for g in grams(w)] for w in words[at:to]]
            starts = np.append(0, np.cumsum([len(x) for x in ids]))[:-1]
            got = np.add.reduceat(model.table[np.concatenate([np.array(x) for x in ids])], starts, axis=0)
            got += np.array([model.scripts.get(script(w), flat) for w in words[at:to]])
            scores[base + at : base + to] = got - got.max(axis=1, keepdims=True)
            held, at = 0, to
        known.update(zip(words, range(base, base + len(words)), strict=True))

    def label(texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        words = [LETTERS.findall((t or "").lower()) for t in texts]
        if len(known) > cache:
            known.clear()
        if new := list(set().union(*words) - known.keys()):
            learn(new)
        sizes = np.array([len(w) for w in words])
        ids = np.fromiter((known[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        path = viterbi(lambda at: scores[ids[at]].astype(np.float64), sizes, len(model.langs), penalty)
        letters = np.fromiter((len(w) for ws in words for w in ws), np.int64, len(ids))
        out, at = [], 0
        for t, n in zip(texts, sizes, strict=True):
            mine = path[at : at + n]
            if not n or not any(c.isalpha() for c in t):
                out.append(("und", 0.0, []))
            else:
                held = np.bincount(mine, letters[at : at + n], minlength=len(model.langs))
                best = int(held.argmax())
                out.append((model.langs[best], float(held[best] / held.sum()), spans(t, mine)))
            at += n
        return out

    def spans(text: str, path: np.ndarray) -> list[tuple[int, int, str]]:
        """Runs of one language from first to last letter, in code points of the text."""
        cut = np.flatnonzero(path[1:] != path[:-1]) + 1
        if not len(cut):
            return [(0, len(text), model.langs[path[0]])]
        places = [m.span() for m in LETTERS.finditer(text)]
        if len(places) != len(path):  # lower case made or joined words: places can't be told
            return [(0, len(text), "mul")]
        ends = [*cut, len(path)]
        return [(places[a][0], places[b - 1][1], model.langs[path[a]]) for a, b in zip([0, *cut], ends, strict=True)]

    return label


def predict(docs: DataFrame, model: Model, held: int = 2, folds: int = 4, penalty: float = PENALTY) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score and spans (``lang:start:end``, comma-joined)."""

    def run(batches):
        label = labeller(model, penalty) if model.langs else lambda texts: [("und", 0.0, [])] * len(texts)
        for batch in shared.slices(batches, 1, SLICE * MANY // max(MANY, len(model.langs))):
            got = label(batch.column(1).to_pylist())
            told = [",".join(f"{x}:{a}:{b}" for a, b, x in g[2]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(told, pa.string())],
                names=["doc_id", "held_out", "lang_pred", "score", "spans"],
            )

    slim = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, spans string")
