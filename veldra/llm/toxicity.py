"""Toxicity by cumulative-link ordinal regression over sparse text features.

A document's grade (0 to 3) follows from where its score lies among ordered thresholds; all thresholds share the
features' weights: P(grade >= j) = sigmoid(w.x - b_j). Features are the words of a text and their beginnings, of which
only those take part that clearly favour labelled toxic texts or clean ones; the weights are fitted with a lasso, so
most are zero. Labels say toxic or not; a toxic text's grade (1 to 3) is the third of all labelled toxic texts in which
the score lies that models of the other folds of the labels give it, which have chosen their features and weights without it. So
grades above 1 rank toxic texts by the strength of their signs, not by a severity that someone has judged. The expected severity is the sum of P(grade >= j) over the thresholds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import give_back, hash_sample, kept_rows, pick, place_of, table
from veldra.llm.linear import SparseRows, cumulative_link

SAMPLE = 4000
GRADES = 4
FOLDS = 3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Words, and beginnings of five to eight letters, with the number of times each occurs."""
    out: Counter = Counter()
    if text:
        for w, n in Counter(_WORD.findall(text.lower())).items():
            out[w + "$"] += n
            for k in range(5, min(9, len(w))):
                out[w[:k]] += n
    return out


def numbered(texts: list[str | None]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The names of all features, and each text's as places among them with their numbers of times: a few bytes a feature."""
    at: dict[str, int] = {}
    out = []
    for t in texts:
        f = features(t)
        out.append((np.fromiter((at.setdefault(x, len(at)) for x in f), np.int32, len(f)), np.fromiter(f.values(), np.int32, len(f))))
    return list(at), out


def counted(found: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> dict[int, float]:
    place = at[found[0]]
    on = place >= 0
    return dict(zip(place[on].tolist(), np.log1p(found[1][on]).tolist()))


def telling(names: list[str], found: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, use: np.ndarray, min_docs: int, odds: float) -> tuple[list[str], np.ndarray]:
    """Features that favour toxic texts among the rows in use, the most telling first, and each feature's place among
    them (-1: none)."""
    pos, neg = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for (f, _), bad, mine in zip(found, y, use):
        if mine:
            (pos if bad else neg)[f] += 1  # a text has a feature once
    n1, n0 = y[use].sum(), (1 - y[use]).sum()
    some = np.flatnonzero(pos >= min_docs)  # only what toxic texts have can be telling
    value = np.log((pos[some] + 0.5) / (n1 + 1)) - np.log((neg[some] + 0.5) / (n0 + 1))
    best = sorted((-v, names[i], i) for v, i in zip(value.tolist(), some.tolist()) if v >= np.log(odds))
    at = np.full(len(names), -1, np.int32)
    at[[i for _, _, i in best]] = np.arange(len(best))
    return [name for _, name, _ in best], at


class OrdinalModel:
    def __init__(self, weights: dict[str, float], cuts: list[float], reject: float):
        self.weights, self.cuts, self.reject = weights, np.array(cuts, float), reject

    def raw(self, found: Counter) -> float:
        return sum(self.weights[f] * float(np.log1p(n)) for f, n in found.items() if f in self.weights)

    def severity(self, text: str | None) -> tuple[float, float, int]:
        """Expected severity, P(grade >= 1), most likely grade. Without telling words the severity is that of no
        evidence at all."""
        p = 1 / (1 + np.exp(-(self.raw(features(text)) - self.cuts)))
        each = -np.diff(np.r_[1.0, p, 0.0])
        return float(p.sum()), float(p[0]), int(each.argmax())

    @classmethod
    def fit(cls, texts: list[str], toxic: list[int], *, min_docs: int = 8, odds: float = 5.0, lasso: float = 2e-4, rounds: int = 800, keep_clean: float = 0.002) -> OrdinalModel:
        y = np.array(toxic, float)
        n1, n0 = y.sum(), (1 - y).sum()
        if not n1 or not n0:
            return cls({}, [20.0, 21.0, 22.0], 0.5)
        names, found = numbered(texts)
        balance = np.where(y > 0, n0 / n1, 1.0) ** 0.5
        fold = np.arange(len(y)) % FOLDS
        # how severe a toxic text is: its score by a model of the other folds, features and all, in thirds of all toxic texts
        parts = [telling(names, found, y, fold != k, min_docs, odds) for k in range(FOLDS)]
        strength, chance = np.zeros(len(y)), np.zeros(len(y))
        rows = [(SparseRows([counted(f, at) for f in found], len(best)), np.where(fold == k, 0.0, balance)) for k, (best, at) in enumerate(parts)]
        for k, (x, weight) in enumerate(rows):
            strength[fold == k] = x.dot(cumulative_link(x, y[:, None], weight, lasso=lasso, rounds=rounds // 4)[0])[fold == k]
        bad = np.flatnonzero(y)
        rank = np.argsort(np.argsort(strength[bad], kind="stable"), kind="stable")
        grade = np.zeros(len(y), int)
        grade[bad] = 1 + (GRADES - 1) * rank // len(bad)
        target = (grade[:, None] >= np.arange(1, GRADES)[None]).astype(float)
        for k, (x, weight) in enumerate(rows):
            w, cuts = cumulative_link(x, target, weight, lasso=lasso, rounds=rounds // 2)
            chance[fold == k] = (1 / (1 + np.exp(-(x.dot(w) - cuts[0]))))[fold == k]
        best, at = telling(names, found, y, np.ones(len(y), bool), min_docs, odds)
        x = SparseRows([counted(f, at) for f in found], len(best))
        w, cuts = cumulative_link(x, target, balance, lasso=lasso, rounds=rounds)
        out = cls({f: float(w[i]) for i, f in enumerate(best) if w[i]}, cuts.tolist(), 0.5)
        # the limit: as few clean texts above it as can be without giving up toxic ones, by what the models of the other
        # folds say of each text
        most = (-np.inf, 0.5)
        for limit in np.quantile(chance[y == 0], np.linspace(0.9, 1 - keep_clean, 40)):
            limit = max(float(limit), 1e-6)
            hit, false = (chance[y > 0] > limit).mean(), (chance[y == 0] > limit).mean()
            if hit - 5 * false > most[0] + 1e-9:
                most = (hit - 5 * false, limit)
        out.reject = most[1]
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most `sample` labelled documents that have a text (those of the smallest hashes of their ids)."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null")
    known = known.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    some = hash_sample(known.select("doc_id"), F.col("doc_id"), sample, labels.count())
    ids = known.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = some.orderBy("doc_id").collect()  # at most `sample` rows
    model = OrdinalModel.fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])
    del rows
    give_back()
    return model


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.severity(t.as_py()) for t in batch.column("text")]
            keep = [n for n in batch.schema.names if n != "text"]
            cols = [[round(g[0], 6) for g in got], [int(g[2]) for g in got], [bool(g[1] > m.reject) for g in got]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_())], [*keep, "severity", "grade", "toxic"])

    return run


def grade(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected, 0 to 3), grade (0 to 3) and toxic (whether it is rejected), for whole texts.

    Null and empty texts have no evidence and are not toxic. Labels without id or value are left out; of several for
    an id the highest counts. Without labels of both kinds nothing is toxic. Repeated rows each get a row; an empty
    table gives none.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return docs.mapInArrow(_score(sent), "doc_id long, severity double, grade int, toxic boolean")


def _filtered(sent, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            yield batch.filter(pa.array([m.severity(t.as_py())[1] <= m.reject for t in batch.column(text)], pa.bool_()))

    return run


def clean(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), labels, sample))
    return kept_rows(docs, _filtered(sent, place_of(docs, text_col)))


def op8_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
