"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary classifier over hashed byte n-grams of the
whole text. Decoding takes the language whose codeword has the least logistic loss over the bits' margins; the gap to
the next gives the score and flags ambiguous texts. The classifiers are fitted on the driver from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import hash_sample, pick, table
from veldra.llm.linear import gram_counts, logistic, scaled_rows

ORDERS, BITS = (1, 2, 3), 12
SAMPLE = 2000
HELD_OUT = 2


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A code of +1 and -1 for n languages: all splits of up to four languages, else as many random splits as to
    tell every two languages apart in many bits."""
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 4:
        bits = [[1 if i >> k & 1 else -1 for k in range(n)] for i in range(1, 2 ** (n - 1))]
        return np.array(bits).T
    rng, width = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        c = rng.choice([-1, 1], size=(n, width))
        if (np.abs(c.sum(0)) == n).any():
            continue
        d = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        if d > apart:
            best, apart = c, d
    return best


class CodeModel:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.code, self.weights, self.bias = langs, code, weights, bias

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> CodeModel:
        names = sorted(set(langs))
        code = codewords(len(names))
        if len(names) < 2:
            return cls(names, code, np.zeros((len(ORDERS) << BITS, code.shape[1]), np.float32), np.full(code.shape[1], 3.0))
        x = scaled_rows(gram_counts(texts, ORDERS, BITS))
        at = np.array([names.index(v) for v in langs])
        weight, bias = zip(*[logistic(x, (code[at, k] > 0).astype(np.float32)) for k in range(code.shape[1])])
        return cls(names, code, np.stack(weight, 1).astype(np.float32), np.array(bias))

    def decode(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """The nearest language (`und` without letters), the score, and whether it is ambiguous."""
        counts = gram_counts(texts, ORDERS, BITS)
        margin = scaled_rows(counts) @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2) if self.langs else np.zeros((len(texts), 0))
        lang, score, unsure = [], [], []
        for i, t in enumerate(texts):
            if not t or not self.langs or not any(c.isalpha() for c in t):
                lang.append("und"), score.append(0.0), unsure.append(True)
                continue
            p = np.exp(loss[i].min() - loss[i])
            p /= p.sum()
            lang.append(self.langs[int(loss[i].argmin())]), score.append(float(p.max())), unsure.append(bool(p.max() < 0.7))
        return lang, score, unsure


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i in range(0, batch.num_rows, 256):
                got = sent.value.decode(texts.slice(i, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 256), *map(pa.array, got)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def identify(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and ambiguous, from whole texts.

    Learns from at most `sample` documents with text, language and id that are not held out (those of the smallest
    hashes of their ids; of a repeated id the least text). Null texts and texts without letters are `und` with score 0; a null id is not held out.
    Repeated rows each get a row; without anything to learn from, all is `und`; an empty table gives none.
    """
    docs = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = hash_sample(learn.select("doc_id"), F.col("doc_id"), sample, docs.count())
    one = learn.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"))
    rows = one.orderBy("doc_id").select("x.*").collect()  # at most `sample` rows
    model = CodeModel.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
