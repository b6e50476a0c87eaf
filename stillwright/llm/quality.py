"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

A document becomes a few statistics of its bytes and words. Random cosines of the standardised
statistics approximate a Gaussian kernel; the ridge weights on them solve normal equations whose
parts are summed by partition; binned scores are calibrated by pool-adjacent-violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import column, materialize, steps, text_hash, texts

#: Labelled rows that a model is fitted on at most (those with the smallest hash of the id), tasks
#: that sum the normal equations, cosines, seed, width of the kernel, ridge penalty a row, bins.
FIT_ROWS, FIT_TASKS, COSINES, SEED, WIDTH, PENALTY, BINS = 200_000, 16, 256, 7, 2.5, 1e-4, 1000

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "stop", "comma", "bang", "symbol", "bar",
    "other", "high", "distinct", "top_word", "distinct_lines", "line_words", "symbol_words", "upper_words", "again",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


#: Each row of the product bincount @ KINDS counts the bytes of a kind.
KINDS = np.stack(
    [
        _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(" \t"), _table("\n\r"), _table(".?"), _table(","), _table("!"),
        _table("#$%&*@^~+=<>{}[]\\_"), _table("|"), _table("\"'():;/-`"), np.arange(256) >= 128,
    ],
    axis=1,
).astype(float)


def statistics(text: str) -> list[float]:
    """Shares of kinds of bytes and words of a whole text, and its size on a log scale; all 0 for an empty one."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, m = len(raw), len(words)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ KINDS / n
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    odd = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\")" or not w[0].isalnum() and w[0] not in "'\"(")
    loud = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    return [np.log1p(n), np.log1p(m), np.log1p(n / m), *kinds.tolist(), len(seen) / m, max(seen.values()) / m, len(set(lines)) / max(len(lines), 1), np.log1p(m / max(len(lines), 1)), odd / m, loud / m, sum(map(eq, words, words[1:])) / m]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, x (array of the statistics of the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            x = [statistics(t) for t in column(part, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "text_hash"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "text_hash", "x"])

    return texts(docs).withColumn("text_hash", text_hash(F.col("text"))).mapInArrow(run, "doc_id long, text_hash binary, x array<double>")


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic fit of means y with weights w, x ascending."""
    means: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for a, b in zip(y.tolist(), w.tolist(), strict=True):
        means.append(a)
        weights.append(b)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / total]
            weights[-2:] = [total]
            sizes[-2:] = [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes)


class Model:
    """Everything a task needs to score: at most a few hundred kB, whatever the corpus."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, cosines: int = COSINES, seed: int = SEED, width: float = WIDTH) -> None:
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequencies = random.normal(0, 1 / width, (len(mean), cosines))
        self.phases = random.uniform(0, 2 * np.pi, cosines)
        self.weights = np.zeros(cosines + 1)
        self.grid, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.grid, self.levels)


def _matrix(values) -> np.ndarray:
    return np.array(list(values), float).reshape(-1, len(NAMES))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of labels.quality (0 or 1) from the statistics of the labelled documents.

    Bounded: at most fit_rows labelled rows, those with the smallest hash of their id. Labels that are
    null or of unknown documents are left out; without any label every score is 0.5.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    y = y.groupBy("doc_id").agg(F.avg("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    known = y.count()
    if known > fit_rows:  # a bound on the hash first, so that few more rows than are taken come together
        share = min(1.0, 1.1 * fit_rows / known + 1000 / known)
        y = y.where(F.col("h") <= F.lit(min(int((share - 0.5) * 2**64), 2**63 - 1))).orderBy("h", "doc_id").limit(fit_rows)
    rows = materialize(stats.join(y, "doc_id").repartition(FIT_TASKS, "doc_id"), "labelled", free=False)
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not moments:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
    model = Model(np.array([r["m"] for r in moments]), np.array([r["s"] or 1.0 for r in moments]))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each partition one matrix [F'F, F'y, count], by rows; classes weigh the same."""
        total = np.zeros((2, COSINES + 1, COSINES + 2))
        n = np.zeros(2)
        for pdf in batches:
            f, t = model.features(_matrix(pdf["x"])), pdf["y"].to_numpy()
            for c, part in enumerate((t < 0.5, t >= 0.5)):
                total[c] += np.hstack([f[part].T @ f[part], (f[part].T @ t[part])[:, None]])
                n[c] += part.sum()
        for c in range(2):
            yield pd.DataFrame({"c": c, "i": range(COSINES + 2), "v": [*total[c].tolist(), [n[c]] * (COSINES + 2)]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": pdf["c"][:1], "i": pdf["i"][:1], "v": [np.sum(pdf["v"].tolist(), axis=0).tolist()]})

    kind = "c int, i int, v array<double>"
    parts = rows.mapInPandas(sums, kind).groupBy("c", "i").applyInPandas(added, kind).orderBy("c", "i").collect()
    both = np.array([r["v"] for r in parts]).reshape(2, COSINES + 2, COSINES + 2)
    n = np.maximum(both[:, -1, 0], 1)
    equations = (both[:, :-1] / n[:, None, None]).mean(axis=0)
    a, b = equations[:, :-1], equations[:, -1]
    model.weights = np.linalg.solve(a + PENALTY * np.eye(len(a)), b)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"bin": np.rint(model.raw(_matrix(pdf["x"])) * BINS).clip(-BINS, 2 * BINS).astype(int), "y": pdf["y"]})

    bins = rows.mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("y").alias("n")).orderBy("bin").collect()
    grid, means, n = (np.array([r[c] for r in bins], float) for c in ("bin", "y", "n"))
    model.grid, model.levels = grid / BINS, pool(grid, means, n)
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_hash": pdf["text_hash"], "score": model.score(_matrix(pdf["x"]))})

    return stats.mapInPandas(run, "doc_id long, text_hash binary, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of every document, scored by its whole text alone.

    Held-out ids teach nothing. Null text is empty; empty texts are scored by all-zero statistics. A
    null doc_id is scored and not held out; repeated rows stay, and equal texts have equal scores; a label
    of rows that share an id teaches all their texts; an empty table gives an empty result; without
    labels every score is 0.5. text_hash (128 bits) names the text. Other columns are not read.
    """
    stats = materialize(with_statistics(docs), "statistics", free=False)
    model = fit(stats, labels.where(~held_out()))
    return scored(stats, model).select("doc_id", "text_hash", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
