"""Pluggable classifiers: batches, cache, parsing, exclusion, cost and topics.

A classifier is any function from a list of texts to a list of answers; it runs on the executors in
``mapInPandas``, so a model or a service client is made once per task. :func:`keyword_classifier` is
the deterministic one that needs no network.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.coding import exclusive
from tesserae.storage import answer_key, cached

Classifier = Callable[[list[str]], list[list[dict]]]
BATCH, TOPIC_BATCH, CHARS_PER_TOKEN, OUT_TOKENS, SECONDS_PER_BATCH = 20, 30, 3.5, 40, 5.0

#: Categories of a codebook at most.
MOST_CATEGORIES = 10_000


def keyword_classifier(keywords: dict[str, list[str]]) -> Classifier:
    """Each category whose keywords a text holds, with their share as confidence, the surest first."""

    def run(texts: list[str]) -> list[list[dict]]:
        out = []
        for t in texts:
            words = set(re.findall(r"\w+", t.lower()))
            hits = {c: len(words & {k.lower() for k in ks}) / max(1, len(ks)) for c, ks in keywords.items()}
            out.append([{"cat_id": c, "confidence": round(s, 4), "reason": "keywords"} for c, s in sorted(hits.items(), key=lambda x: (-x[1], x[0])) if s > 0])
        return out

    return run


def parse_answer(reply: str) -> list[dict]:
    """The list of answers in a model's prose: a fenced or bare JSON block, one object counting as a list."""
    m = re.search(r"```(?:json)?\s*(.*?)```", reply, re.DOTALL)
    body = m[1] if m else reply
    for opening, closing in (("[", "]"), ("{", "}")):
        a, b = body.find(opening), body.rfind(closing)
        if 0 <= a < b:
            try:
                found = json.loads(body[a : b + 1])
                return found if isinstance(found, list) else [found]
            except ValueError:
                continue
    return []


_ANSWER = "_row_idx long, key string, cat_id string, place int, confidence double, reason string"


def classified(rows: DataFrame, make: Callable[[], Classifier], known: list[str], batch: int = BATCH) -> DataFrame:
    """(_row_idx, key, cat_id, place, confidence, reason); unknown categories are dropped."""
    allowed = set(known)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = make()
        for part in parts:
            found = []
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                for idx, key, answers in zip(some["_row_idx"], some["key"], classify(some["text"].fillna("").tolist()), strict=True):
                    good = [a for a in answers if a.get("cat_id") in allowed]
                    found += [(idx, key, a["cat_id"], k, float(a.get("confidence") or 0.0), str(a.get("reason", ""))[:200]) for k, a in enumerate(good)]
            yield pd.DataFrame(found, columns=["_row_idx", "key", "cat_id", "place", "confidence", "reason"])

    return rows.select("_row_idx", "key", "text").mapInPandas(run, _ANSWER)


def code_with(rows: DataFrame, make: Callable[[], Classifier], groups: DataFrame, cache: DataFrame | None = None, codebook: str = "cb", version: str = "1", prompt: str = "") -> DataFrame:
    """Tags of a classifier: cached answers first, the rest asked for, the first of a group winning.

    ``groups`` is the codebook (cat_id, exclusion_group), which is small and read to the driver.
    """
    known = sorted(r.cat_id for r in groups.select("cat_id").limit(MOST_CATEGORIES + 1).collect())
    if len(known) > MOST_CATEGORIES:
        raise ValueError(f"a codebook of over {MOST_CATEGORIES} categories can't be asked for")
    keyed = rows.withColumn("key", answer_key(F.col("text"), codebook, version, prompt, known))
    if cache is None:
        told = classified(keyed, make, known)
    else:
        hits, misses = cached(keyed, cache)
        told = hits.select("_row_idx", "key", F.explode("answers").alias("a")).select("_row_idx", "key", "a.*").unionByName(classified(misses, make, known))
    return exclusive(told, groups).withColumns({"coder": F.lit("ai"), "source": F.lit("ai"), "codebook_id": F.lit(codebook)})


def preflight(rows: DataFrame, prompt_chars: int, prices: dict[str, float], batch: int = BATCH) -> DataFrame:
    """Rows, batches, tokens, cost and seconds of a run, before it is made; prices are per million tokens."""
    n, chars = F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))
    batches = F.ceil(n / batch)
    row_tokens, prompt = F.ceil(chars / CHARS_PER_TOKEN), int(prompt_chars / CHARS_PER_TOKEN)
    cost = (row_tokens * prices["input"] + n * OUT_TOKENS * prices["output"] + F.least(batches, F.lit(1)) * prompt * prices["cache_write"] + F.greatest(batches - 1, F.lit(0)) * prompt * prices["cache_read"]) / 1e6
    return rows.agg(n.alias("rows"), batches.alias("batches"), row_tokens.alias("row_tokens"), (n * OUT_TOKENS).alias("out_tokens"), cost.alias("cost"), (batches * SECONDS_PER_BATCH).alias("seconds"))


def usage_cost(prices: dict[str, float], **tokens: Column) -> Column:
    """What a call costs: each kind of tokens (input, output, cache_write, cache_read) times its price per million."""
    cost = F.lit(0.0)
    for kind, n in tokens.items():
        cost = cost + F.coalesce(n, F.lit(0)) * F.lit(prices[kind]) / 1e6
    return cost


@dataclass
class Budget:
    """Spending with reservations: a warning from 80 %, a block from 100 %."""

    limit: float
    spent: float = 0.0
    reserved: dict[str, float] = field(default_factory=dict)

    def state(self) -> str:
        used = (self.spent + sum(self.reserved.values())) / self.limit if self.limit > 0 else 0.0
        return "blocked" if used >= 1 else "warning" if used >= 0.8 else "ok"

    def reserve(self, job: str, amount: float) -> None:
        if self.limit > 0 and self.spent + sum(self.reserved.values()) + amount > self.limit:
            raise ValueError(f"{amount:.2f} is over what is left of {self.limit:.2f}")
        self.reserved[job] = amount

    def release(self, job: str) -> None:
        self.reserved.pop(job, None)

    def commit(self, job: str, amount: float) -> None:
        self.release(job)
        self.spent += amount


# --- topics ---------------------------------------------------------------------------------------


def normalise_topics(raw: list[dict], most: int = 20) -> list[dict]:
    """Topics with unique ids; ``other`` is reserved and always last."""
    out, seen = [], Counter()
    for t in raw[:most]:
        base = re.sub(r"[^a-z0-9]+", "_", str(t.get("topic_id") or t.get("name") or "topic").lower()).strip("_")[:48] or "topic"
        if base == "other":
            continue
        seen[base] += 1
        out.append({**t, "topic_id": base if seen[base] == 1 else f"{base}_{seen[base]}"})
    return [*out, {"topic_id": "other", "name": "Other"}]


def induce_topics(df: DataFrame, k: int = 8, sample: int = 300, stop: list[str] | None = None) -> list[dict]:
    """A deterministic stand-in for topic induction: the terms found in most texts of a bounded sample."""
    from tesserae.operators.analytics import ngrams
    from tesserae.operators.sampling import random_sample

    some = random_sample(df, min(500, max(20, sample)))
    best = ngrams(some, 1, 10 * k, 1, stop).orderBy(F.desc("docs"), "gram").limit(min(20, max(3, k))).collect()
    return normalise_topics([{"topic_id": r.gram, "name": r.gram, "keywords": [r.gram]} for r in best])


def assign_topics(df: DataFrame, topics: list[dict], text: str = "text") -> DataFrame:
    """(_row_idx, topic_id): the topic with the most keywords in a text, the first on ties, else other."""
    from tesserae.functions.text import tokens

    words = tokens(F.col(text))
    scored = [F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, t["keywords"])))).alias("n"), F.lit(-k).alias("k"), F.lit(t["topic_id"]).alias("id")) for k, t in enumerate(topics) if t.get("keywords")]
    if not scored:
        return df.select("_row_idx", F.lit("other").alias("topic_id"))
    best = F.array_max(F.array(*scored))
    return df.select("_row_idx", F.when(best["n"] > 0, best["id"]).otherwise("other").alias("topic_id"))


def revert_topics(current: DataFrame, prior: DataFrame) -> DataFrame:
    """The assignment before the last run, for rows that are still there."""
    return current.select("_row_idx").join(prior.select("_row_idx", "topic_id"), "_row_idx", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit("other")))


def rename_topic(topics: DataFrame, topic_id: str, name: str) -> DataFrame:
    return topics.withColumn("name", F.when(F.col("topic_id") == topic_id, name).otherwise(F.col("name")))


# --- enrichment -----------------------------------------------------------------------------------


def enrich(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[dict]]], schema: str, kind: str, target: str = "", cache: DataFrame | None = None) -> DataFrame:
    """``rows`` with a struct column named ``kind``: sentiment, entities, stance toward a target, and so on.

    Answers are keyed by kind, target and text; each distinct text that the cache lacks is asked for
    once. ``schema`` is the DDL of one answer.
    """
    keyed = rows.withColumn("_key", F.sha1(F.concat_ws("|", F.lit(kind), F.lit(target), F.coalesce("text", F.lit(""))).cast("binary")))
    wanted = keyed.groupBy("_key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    if cache is not None:
        wanted = wanted.join(cache.where(F.col("kind") == kind).select(F.col("key").alias("_key")), "_key", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for part in parts:
            yield pd.DataFrame({"_key": part["_key"], "answer": [json.dumps(a) for a in ask(part["text"].tolist())]})

    told = wanted.mapInPandas(run, "_key string, answer string")
    if cache is not None:
        told = told.unionByName(cache.where(F.col("kind") == kind).select(F.col("key").alias("_key"), "answer"))
    return keyed.join(told, "_key", "left").withColumn(kind, F.from_json("answer", schema)).drop("_key", "answer")


def word_sentiment(positive: list[str], negative: list[str]) -> Callable[[], Callable[[list[str]], list[dict]]]:
    """A deterministic sentiment from two word lists, each text's score between -1 and 1."""

    def make() -> Callable[[list[str]], list[dict]]:
        def ask(texts: list[str]) -> list[dict]:
            out = []
            for t in texts:
                words = re.findall(r"\w+", t.lower())
                p, n = sum(w in positive for w in words), sum(w in negative for w in words)
                out.append({"label": "positive" if p > n else "negative" if n > p else "neutral", "score": (p - n) / max(1, p + n)})
            return out

        return ask

    return make
