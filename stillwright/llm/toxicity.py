"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled ones are all it learns from. Beginnings of words and whole words, at a few
counts a text, are features; those that toxic texts have significantly more often than texts at large are
kept. Logistic classifiers are trained in numpy on the risk of du Plessis and Kiryo: with the class prior p, the
negative part of the risk is that of the unlabelled texts less p times that of the toxic ones, and where it falls
below zero (the unlabelled texts are fitted too well) the step goes back. Several classifiers, each with another
part of the unlabelled texts left out, are averaged.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import column, materialize, steps, texts
from stillwright.llm.quality import held_out

#: Toxic texts and unlabelled texts that are learned from at most (those with the smallest hashes of their ids),
#: tasks that read them, features, z value that a feature must reach, texts it must be in, classifiers.
FIT_TEXTS, FIT_TASKS, FEATURES, SURE, SUPPORT, MEMBERS = 10_000, 16, 4000, 4.0, 4, 4
#: Beginnings of words that are features, in letters, and the counts a text that are told apart.
BEGINNINGS, TIMES = (3, 4, 5, 6, 7), (1, 2, 4, 8)
#: Of the training: ridge penalty, steps, step size.
PENALTY, STEPS, RATE = 5e-4, 400, 0.05
#: Words that a task remembers at most.
REMEMBERED = 200_000

_words = re.compile(r"[^\W\d_]+").findall


def marks(word: str) -> list[str]:
    """Features of a word: the word as a whole and its beginnings."""
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if k < len(word))]


def features(text: str) -> list[str]:
    """Features of a whole text, each at every count that it reaches."""
    found: dict[str, int] = defaultdict(int)
    for word, n in Counter(_words(text.lower())).items():
        for mark in marks(word):
            found[mark] += n
    return [f"{mark} {t}" for mark, n in found.items() for t in TIMES if n >= t]


class Model:
    """Weights of at most FEATURES features: what every task gets, whatever the corpus."""

    def __init__(self, names: list[str], weights: np.ndarray) -> None:
        self.weights = weights
        #: for each mark the features of its counts
        self.levels: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, name in enumerate(names):
            mark, times = name.split(" ")
            self.levels[mark].append((int(times), i))

    def rows(self, many: list[str]) -> list[list[int]]:
        """Of each text the features it has."""
        known: dict[str, list[str]] = {}
        out = []
        for text in many:
            found: dict[str, int] = defaultdict(int)
            for word, n in Counter(_words(text.lower())).items():
                own = known.get(word)
                if own is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    own = known[word] = [m for m in marks(word) if m in self.levels]
                for mark in own:
                    found[mark] += n
            out.append([i for mark, n in found.items() for t, i in self.levels[mark] if n >= t])
        return out

    def score(self, many: list[str]) -> np.ndarray:
        z = self.weights[-1] + np.array([self.weights[sorted(r)].sum() for r in self.rows(many)])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def trained(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of a logistic classifier, the last one constant: rows of 0 and 1, Adam on the non-negative risk."""
    p, u = (np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32) for x in (toxic, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        zp, zu = (np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64) for x in (p, u))
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        back = (su.astype(np.float32) @ u) / len(u) - prior * (sp.astype(np.float32) @ p) / len(p)
        slope = prior * ((sp - 1).astype(np.float32) @ p) / len(p) + back if negative >= 0 else -back
        slope = slope + PENALTY * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w = w - RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, float]:
    """p, u (whether a text is a toxic or an unlabelled example), text: one text for an id; and the share of toxic rows among the labelled ones."""
    y = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("double").alias("y")).where("doc_id is not null and y is not null")
    y = y.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    known, toxic = y.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    total = docs.count()

    def within(n: int):
        """Ids whose hash is among the smallest, about `most` of n of them."""
        return F.xxhash64("doc_id") <= F.lit(min(int((most / max(n, 1) - 0.5) * 2**64), 2**63 - 1))

    few = y.where("y = 1").where(within(toxic)).select("doc_id", F.lit(True).alias("p"))
    rows = docs.where("doc_id is not null").join(F.broadcast(few), "doc_id", "left").withColumn("u", within(total)).withColumn("p", F.coalesce("p", F.lit(False)))
    rows = rows.where("p or u").groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"), F.min("text").alias("text"))
    return rows.repartition(FIT_TASKS, "doc_id"), toxic / known if known else 0.0


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_TEXTS) -> Model | None:
    rows, prior = sample(docs, labels, most)
    rows = materialize(rows, "examples", free=False)
    n = rows.agg(F.sum(F.col("p").cast("int")).alias("p"), F.sum(F.col("u").cast("int")).alias("u")).first()
    if not n["p"] or not n["u"]:
        return None
    prior = min(max(prior, 1e-6), 0.99)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, most=4_000_000):
            of_p: Counter[str] = Counter()
            of_u: Counter[str] = Counter()
            for text, p, u in zip(*(column(part, c).to_pylist() for c in ("text", "p", "u")), strict=True):
                own = features(text)
                if p:
                    of_p.update(own)
                if u:
                    of_u.update(own)
            names = list(of_p | of_u)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (of_p, of_u))], names=["feature", "p", "u"])

    sums = rows.mapInArrow(seen, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= SUPPORT)
    share = (F.col("p") + F.col("u") + 1) / F.lit(float(n["p"] + n["u"] + 2))
    z = (F.col("p") / float(n["p"]) - F.col("u") / float(n["u"])) / F.sqrt(share * (1 - share) * F.lit(1 / n["p"] + 1 / n["u"]))
    names = [r["feature"] for r in sums.withColumn("z", z).where(F.col("z") >= SURE).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]
    model = Model(names, np.zeros(len(names) + 1))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "p"), column(part, "u"), pa.array(model.rows(column(part, "text").to_pylist()), pa.list_(pa.int32()))], names=["doc_id", "p", "u", "x"])

    def member(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        own = np.zeros((len(pdf), len(names)), np.float32)
        for i, x in enumerate(pdf["x"]):
            own[i, x] = 1
        out = pdf["left_out"] == pdf["member"]
        p, u = pdf["p"].to_numpy(bool), (pdf["u"] & ~out).to_numpy(bool)
        return pd.DataFrame({"weights": [trained(own[p], own[u if u.any() else pdf["u"].to_numpy(bool)], prior).tolist()]})

    examples = rows.mapInArrow(coded, "doc_id long, p boolean, u boolean, x array<int>").withColumn("left_out", F.expr(f"cast(pmod(xxhash64(doc_id, 1), {MEMBERS}) as int)"))
    fitted = examples.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))).groupBy("member").applyInPandas(member, "weights array<double>").collect()
    return Model(names, np.mean(sorted(r["weights"] for r in fitted), axis=0))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, scored by its whole text alone.

    Learns from at most about fit_texts toxic texts and as many unlabelled ones (any text, labelled or not, whose id is not held out); of
    labels only which are toxic and their share are used. Held-out ids teach nothing. Null text is empty and has
    the score of a text without any feature. A null doc_id is scored, not held out and teaches nothing; repeated rows
    stay, equal texts have equal scores; of texts that share an id the least one teaches; labels that disagree are toxic if half of them are. An
    empty table gives an empty result; without toxic labels every score is 0. Other columns are not read.
    """
    rows = texts(docs)
    model = fit(rows.where(~held_out()), labels.where(~held_out()), fit_texts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            many = column(part, "text").to_pylist()
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(model.score(many) if model else np.zeros(len(many)))], names=["doc_id", "score"])

    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
