"""Quality by a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on a text. Expectation-maximisation over their votes on a bounded
sample estimates each labeller's accuracies and the share of good texts, without any true label; the posterior of
each text then labels it, softly, for a linear scorer over hashed features of its surface (the shapes of its words,
its signs and its repetitions), which judges every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import give_back, hash_sample, kept_rows, pick, place_of, table
from veldra.llm.linear import logistic

SAMPLE = 4000
BITS = 12
GOOD, BAD, NONE = 1, 0, -1
LEAST_WORDS = 16  # a text of fewer words has proportionally less evidence
_SHAPE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


_REPEATED = re.compile(r"(.)\1{3,}")


def measures(words: list[str]) -> dict[str, float]:
    """Shares that the labellers look at; zero for a text without words."""
    n = len(words)
    if not n:
        return dict.fromkeys(("marks", "capitals", "bars", "repeats", "distinct", "loud", "mean"), 0.0) | {"n": 0}
    letters = sum(map(str.isalpha, "".join(words)))
    chars = sum(map(len, words))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return {
        "n": n,
        "marks": sum(len(w) > 2 and not w[-1].isalnum() and w[-1] == w[-2] == w[-3] for w in words) / n,
        "capitals": upper / n,
        "bars": sum(not any(c.isalnum() for c in w) for w in words) / n,
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct": len(set(words)) / n,
        "loud": sum(w.endswith("!!") for w in words) / n,
        "letters": letters / max(1, chars),
        "mean": chars / n,
    }


def labellers() -> list:
    """Votes on measures; every labeller keeps silent where it has nothing to say."""
    return [
        lambda m: BAD if m["marks"] > 0.15 else NONE if m["marks"] > 0.02 else GOOD,
        lambda m: BAD if m["capitals"] > 0.4 and m["n"] > 4 else NONE if m["capitals"] > 0.15 else GOOD,
        lambda m: BAD if m["bars"] > 0.15 else NONE if m["bars"] > 0.05 else GOOD,
        lambda m: BAD if m["repeats"] > 0.15 and m["n"] > 4 else NONE if m["repeats"] > 0.05 else GOOD,
        lambda m: BAD if m["loud"] > 0.15 else NONE if m["loud"] else GOOD,
        lambda m: NONE if not m["n"] else BAD if m["letters"] < 0.75 else NONE if m["letters"] < 0.9 else GOOD,
        lambda m: BAD if m["n"] > 30 and m["distinct"] < 0.2 else NONE if m["n"] <= 30 else GOOD,
    ]


def votes(m: dict[str, float]) -> list[int]:
    return [f(m) for f in labellers()]


def expectation_maximisation(v: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each text, each labeller's P(vote | class) as [labeller, class, vote], the share of good.

    Starts from the thought that one labeller's bad vote is rather right than wrong (a fault is seldom seen by
    more than one); silence is a vote of its own.
    """
    n, k = v.shape
    if not n:
        return np.zeros(0), np.full((k, 2, 3), 1 / 3), 0.5
    post = np.where((v == BAD).any(1), 0.15, 0.95)
    for _ in range(rounds):
        p = float(np.clip(post.mean(), 0.01, 0.99))
        table_ = np.zeros((k, 2, 3))
        for j in range(k):
            for s, vote in enumerate((BAD, GOOD, NONE)):
                hit = v[:, j] == vote
                table_[j, 1, s] = (post[hit].sum() + 0.5) / (post.sum() + 1.5)
                table_[j, 0, s] = ((1 - post[hit]).sum() + 0.5) / ((1 - post).sum() + 1.5)
        at = np.where(v == BAD, 0, np.where(v == GOOD, 1, 2))
        up = np.log(p) + sum(np.log(table_[j, 1, at[:, j]]) for j in range(k))
        down = np.log(1 - p) + sum(np.log(table_[j, 0, at[:, j]]) for j in range(k))
        new = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, table_, p


def shape_of(token: str) -> str:
    if token.isalpha():
        return "A" if token.isupper() and len(token) > 1 else "a" if token.islower() else "Aa"
    return "9" if token.isdigit() else _REPEATED.sub(r"\1\1\1", token)


_SHAPES: dict[str, tuple[int, ...]] = {}


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def shape_slots(word: str) -> tuple[int, ...]:
    """Slots of a word's shape: letters, digits and signs, one after the other."""
    got = _SHAPES.get(word)
    if got is None:
        if len(_SHAPES) > 100_000:
            _SHAPES.clear()
        parts = [shape_of(t) for t in _SHAPE.findall(word)]
        got = (_slot("w" + "".join(parts)), *(_slot("t" + p) for p in parts))
        if len(word) <= 64:
            _SHAPES[word] = got
    return got


def surface(text: str | None) -> tuple[np.ndarray, dict[str, float]]:
    """Hashed features of a whole text, and its measures."""
    words = text.split() if text else []
    m = measures(words)
    x = np.zeros(1 << BITS, np.float32)
    for w, n in Counter(words).items():
        for s in shape_slots(w):
            x[s] += n
    if words:
        x /= max(len(words), LEAST_WORDS)
        for name in ("repeats", "marks", "bars", "loud", "capitals"):
            x[_slot("m" + name)] += m[name] * min(1.0, m["n"] / LEAST_WORDS)
        if m["n"] > 30:
            x[_slot("same")] += max(0.0, 0.4 - m["distinct"])
    return x, m


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, limit: float):
        self.weights, self.bias, self.limit = weights, bias, limit

    @classmethod
    def fit(cls, texts: list[str | None], limit: float = 0.5) -> QualityModel:
        if not texts:
            return cls(np.zeros(1 << BITS, np.float32), 3.0, limit)
        x, said = np.empty((len(texts), 1 << BITS), np.float32), []
        for k, t in enumerate(texts):
            x[k], m = surface(t)
            said.append(votes(m))
        _SHAPES.clear()
        post, _, _ = expectation_maximisation(np.array(said))
        w, b = logistic(x, post.astype(np.float32), rounds=400, rate=20.0, ridge=1e-6)
        return cls(w, b, limit)

    def score(self, text: str | None) -> float:
        x, m = surface(text)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))) if m["n"] else 0.0


def train(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits on at most `sample` documents (those of the smallest hashes of their ids; of a repeated id the least
    text); needs no labels."""
    ids = hash_sample(docs.where("doc_id is not null").select("doc_id"), F.col("doc_id"), sample, docs.count())
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = some.orderBy("doc_id").select("text").collect()  # at most `sample` rows
    model = QualityModel.fit([r["text"] for r in rows])
    del rows
    give_back()
    return model


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.score(t.as_py()) for t in batch.column("text")]
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array([round(g, 6) for g in got], pa.float64()), pa.array([bool(g >= m.limit) for g in got], pa.bool_())], [*keep, "score", "keep"])

    return run


def rate(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and keep, for whole texts.

    Null texts and texts without words score 0 and are not kept. Repeated rows each get a row; an empty table gives
    none.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    return docs.mapInArrow(_score(sent), "doc_id long, score double, keep boolean")


def _filtered(sent, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t.as_py()) >= m.limit for t in batch.column(text)], pa.bool_()))
        _SHAPES.clear()

    return run


def good(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(pick(docs, doc_id=id_col, text=text_col), sample))
    return kept_rows(docs, _filtered(sent, place_of(docs, text_col)))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"))
