"""Hard negatives, toxicity and collocations against plain Python."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwright.llm import collocations, hard_negatives, toxicity

CLASHING = {n: "n" for n in ("key", "chunk", "share", "rank", "score", "best", "phrase", "words", "cut", "a", "l", "p", "u", "y", "x", "total", "n")}


def widened(df):
    for name, value in CLASHING.items():
        df = df.withColumn(name, F.lit(value))
    return df


# 11 hard negatives


def _negatives(rows, each=3, most=5, low=80):
    """By rows: (vec_id, label, vector); equal rows once."""
    ok = {(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    q = {r: [math.floor(256 * x) for x in r[2]] for r in ok}
    out = collections.Counter()
    for a in ok:
        if a[0] % each:
            continue
        known = [(-sum(x * y for x, y in zip(q[a], q[b])), b[0], b) for b in ok if b != a and len(b[2]) == len(a[2])]
        known.sort(key=lambda t: t[:2])
        for s, i, _ in [t for t in known if t[2][1] == a[1]][:most]:
            found = [t for t in known if t[2][1] != a[1] and low * -s <= 100 * -t[0] <= 100 * -s][:most]
            out.update((a[0], i, n + 1, t[1], -s, -t[0]) for n, t in enumerate(found))
    return out


@pytest.mark.parametrize("limits", [{}, {"block_rows": 7, "chunk_rows": 4}, {"block_rows": 16, "chunk_rows": 5, "broadcast_bytes": 0}])
def test_hard_negatives(spark, limits):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(4), [round(rnd.gauss(0, 0.4), 3) for _ in range(5)]) for i in range(-60, 60)]
    same = [0.5, -0.25, 0.125, 0.0, 1.0]
    rows += [(100 + i, i % 3, same) for i in range(40)]  # a large group of ties
    rows += [(200 + i, i % 2, []) for i in range(4)] + [(210 + i, i % 2, [1.0, 2.0]) for i in range(7)]  # other lengths
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, same), (301, None, same), (303, 1, None), (306, 1, [0.1, None, 0.2, 0.3, 0.4]), (309, 1, [float("nan")] * 5), (312, 1, [float("inf")] + [0.0] * 4)]
    rows += [(330 + i, i % 2, [1e6, -3e5, 8e6, 1.5, 0.25 * i]) for i in range(6)]  # sums beyond 2**53
    df = widened(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5))
    got = hard_negatives.hard_negatives(df, anchors_each=3, **limits).collect()
    assert collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == _negatives(rows)
    assert len(got) > 500


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [0.9, 0.1]), (0, 2, [1.0, 0.0]), (1, 2, [0.85, 0.0]), (2, 1, [0.95, 0.0]), (4, 3, [0.9, 0.0])]
    df = spark.createDataFrame(rows * 2, "vec_id long, label int, embedding array<float>")
    got = hard_negatives.hard_negatives(df, anchors_each=100).collect()
    want = _negatives([(i, y, np.array(v, np.float32).tolist()) for i, y, v in rows], each=100)
    assert collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == want
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(hard_negatives.relabelled(empty)).count() == 0


def test_labels_move_on(spark):
    df = spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (0, None, [1.0]), (None, 3, [1.0])], "vec_id long, label int, embedding array<float>")
    assert [r["label"] for r in hard_negatives.relabelled(df).collect()] == [0, 9, None, 3]


# 12 toxicity


def _prose(rnd, n, words):
    return " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeimnorst") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    bad = ["vexling", "grobian", "snarkful"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        text = _prose(rnd, rnd.choice([5, 60, 400]), words)
        if toxic:
            for _ in range(3):
                at = rnd.randrange(len(text) + 1)
                text = f"{text[:at]} {rnd.choice(bad)} {text[at:]}"
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(toxic)))
    return rows, labels, bad


def test_toxicity(spark, spoken):
    rows, labels, bad = spoken
    odd = [(2000, None), (2001, ""), (2002, "x" * 300_000 + f" {bad[0]} {bad[1]} {bad[0]}"), (None, f"{bad[0]} {bad[2]} {bad[1]}"), (None, "fine"), (8, rows[8][1])]
    df = widened(spark.createDataFrame([*rows, *odd], "doc_id long, text string").repartition(6))
    known = widened(spark.createDataFrame([*labels, (None, 1), (7000, 1), (5, None)], "doc_id long, toxic int"))
    got = toxicity.toxicity_scores(df, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, _ in rows:
        assert by[i][0]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i][0]["predicted"] == int(i % 8 == 0), i
    assert by[8][0]["score"] == by[8][1]["score"] and by[2000][0]["score"] == by[2001][0]["score"]
    assert sorted(r["predicted"] for r in by[None]) == [0, 1] and not any(r["held_out"] for r in by[None])
    assert by[2002][0]["predicted"] == 1 and by[2001][0]["predicted"] == 0
    # labels of held-out ids teach nothing
    other = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    again = toxicity.toxicity_scores(df, spark.createDataFrame([*other, (7000, 1)], "doc_id long, toxic int")).collect()
    assert sorted(((r["doc_id"] or -1, r["score"]) for r in again)) == sorted(((r["doc_id"] or -1, r["score"]) for r in got))


def test_toxicity_without_labels_or_rows(spark, spoken):
    df = spark.createDataFrame(spoken[0][:30], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(df, none).collect()} == {0.0}
    assert toxicity.toxicity_scores(df.where("doc_id < 0"), none).count() == 0


def test_risk_steps_back_where_it_falls_below_zero():
    """Unlabelled rows that hold fewer toxic ones than the prior says: the risk of the negatives would go below zero."""
    rnd = np.random.default_rng(1)
    x = (rnd.random((400, 6)) < 0.2).astype(np.float32)
    toxic = x[:60].copy()
    toxic[:, 0] = 1
    w = toxicity.trained(toxic, x[60:], 0.3)
    assert np.isfinite(w).all() and w[0] > 1 and abs(w[1:6]).max() < w[0]


def test_a_model_counts_what_the_features_say():
    text = "Trash trash TRASHY, tra trash; trash"
    names = ["trash$ 1", "trash$ 4", "tras 4", "tra$ 2", "trashy$ 1", "tr 1"]
    assert sorted(names[i] for i in toxicity.Model(names, np.zeros(7)).rows([text])[0]) == ["tras 4", "trash$ 1", "trash$ 4", "trashy$ 1"]
    assert set(toxicity.features(text)) >= {"trash$ 1", "trash$ 4", "tras 4", "trashy$ 1"} and "tra$ 2" not in toxicity.features(text)


# 13 collocations


def _collocations(rows, longest=3, least=10, inside=50, first=2000, broadcast_bytes=None):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f, n = collections.Counter(), 0
        for _, own, text in rows:
            if (own or "und") != lang:
                continue
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                words = [w for w in re.split("[\x20\x09]+", piece) if w]
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            score, k, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                out.append((lang, -score, -a, " ".join(p).encode(), l, r, n))
    out.sort()
    ranks = collections.Counter()
    for lang, score, a, p, l, r, n in out:
        ranks[lang] += 1
        if ranks[lang] <= first:
            yield lang, ranks[lang], p.decode(), -a, l, r, n, -score


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("limits", [{}, {"longest": 4, "least": 3, "broadcast_bytes": 0}, {"longest": 2, "least": 2, "first": 7}])
def test_collocations(spark, monkeypatch, limits):
    rnd = random.Random(8)
    words = ["the", "The", "of", "été", "É", "日本", "a.b", "x|y", "\x00", "\xa0", "n't", "$1", "\\", "[z", "o", "um"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ";", "\x0b", " \r\n "]) for _ in range(n))
    rows = [(i, rnd.choice(["en", "fr", None, "und"]), text(rnd.choice([0, 3, 30, 100]))) for i in range(200)]
    rows += [(1, "en", "big dog and cat " * 300)] * 3 + [(2, "de", None), (3, "de", ""), (4, "de", " \t"), (5, "nl", "once only"), (None, "en", "of the of the of the")]
    rows += [(6, "en", "ab " * 5000), (7, "en", "q" * 100_000 + " end")]
    df = widened(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5))
    want = sorted(_collocations(rows, **limits))
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(df, **limits).collect())
    assert got == want and len(want) > 20
    monkeypatch.setattr(collocations, "STEP_BYTES", 500)
    assert collocations.collocations(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_parts_of_long_texts_end_with_pieces(size):
    rnd = random.Random(size)
    for _ in range(200):
        text = "".join(rnd.choice(["word", "é", " ", ".", ";\n", "\t", "x" * 30]) for _ in range(rnd.randrange(60))).encode()
        cut = list(collocations.parts(text, size))
        assert b"".join(cut) == text and all(x[-1:] in b".;\n" for x in cut[:-1])
        whole, many = ([w for x in xs for p in re.split(b"[.;\n]", x) if (w := tuple(p.split()))] for xs in ([text], cut))
        assert whole == many
    assert max(map(len, collocations.parts(b"ab cd. " * 5000, 700))) <= 707


def test_runs_of_many_words_are_numbered_in_steps():
    """Where numbers of runs pass 64 bits, the first words' number stands for them."""
    rnd = random.Random(2)
    tokens = collocations.Tokens([" ".join(f"w{rnd.randrange(30)}" for _ in range(4000)).encode()], "en")
    everything = collocations.Bitmap(20, np.full(1 << 17, 255, np.uint8))
    few = tokens.runs(3, everything)
    want = dict(zip(tokens.phrases(few[0]).to_pylist(), few[1].tolist(), strict=True))

    tokens.vocabulary = _Longer(tokens.vocabulary)
    many = tokens.runs(3, everything)
    tokens.vocabulary = tokens.vocabulary.inner
    assert dict(zip(tokens.phrases(many[0]).to_pylist(), many[1].tolist(), strict=True)) == want


class _Longer:
    """A vocabulary that says it has four million words."""

    def __init__(self, inner):
        self.inner = inner

    def __len__(self):
        return 4_000_000

    def to_pylist(self):
        return self.inner.to_pylist()


def test_arithmetic_is_exact_beyond_64_bits(spark):
    """Counts of 10**12: a * a * 1000000 has 31 digits."""
    a, l, r = 999_999_999_989, 1_000_000_000_039, 1_000_000_000_061
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    out = row.withColumn("above", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", exact("l") * exact("r")).selectExpr("above div below s").first()
    assert out["s"] == 1_000_000 * a * a // (l * r)
