"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled text is a sample of all documents,
whatever their label. A small network on counts and hashed trigrams of the text minimises the non-negative
unbiased risk with the logistic loss, for the class prior estimated beforehand; its logistic
output is then the probability of quality.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fraction_of, giving_back, id_bucket

HELD = (4, 2)
POSITIVES, UNLABELLED = 6000, 12_000  # rows that the network is fitted on, about
HIDDEN = 24
STEPS = 2000  # updates at least
PRIOR_STEPS = 300  # updates of the classifier that the prior is estimated with: few, so that it doesn't learn its rows by heart
CLASSES, MEASURES, GRAMS = 9, 11, 512  # shares of kinds of characters; measures of words and lines; hashed byte trigrams
FEATURES = CLASSES + MEASURES + GRAMS
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind of each code point up to U+FFFF by Unicode category, so that scripts are alike: small letters, capitals, other
    letters and marks, digits, `.,;:` and such, `!?`, symbols, brackets and quotes, white space. Those beyond are other letters."""
    if not _KINDS:
        by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Me": 2, "Nd": 3, "Nl": 3, "No": 3, "Po": 4, "Pd": 4, "Ps": 7, "Pe": 7, "Pi": 7, "Pf": 7, "Zs": 8, "Zl": 8, "Zp": 8}
        table = np.array([by_category.get(unicodedata.category(chr(i)), 6) for i in range(0x10000)], np.uint8)
        for i, marks in ((5, "!?\u00a1\u00bf\uff01\uff1f"), (6, "#$%&*@^~+=_|<>\\"), (7, "/"), (8, "\t\n\r\x0b\x0c")):
            table[[ord(c) for c in marks]] = i
        _KINDS.append(table)
    return _KINDS[0]


def features_of(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, measures of words, lines, repeats and compression, and a bag of hashed byte
    trigrams of the lower-cased text, of length 1; zeros if empty."""
    text = text or ""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    shares = np.bincount(np.where(points < 0x10000, kinds()[np.minimum(points, 0xFFFF)], 2), minlength=CLASSES) / len(points)
    out[:CLASSES] = np.sqrt(shares)
    b = text.encode("utf-8", "surrogatepass")
    n, words, lines = len(points), text.split(), text.split("\n")
    count, distinct = max(1, len(words)), len(set(words))
    again = sum(x == y for x, y in zip(words, words[1:]))
    out[CLASSES : CLASSES + MEASURES] = (
        np.log1p(n) / 10,
        np.log1p(count) / 10,
        min(n / count / 10, 10.0),
        distinct / count,
        np.log1p(distinct) / np.log1p(count),
        np.sqrt(again / count),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
        len(zlib.compress(b, 1)) / len(b),
        sum(not w[-1].isalnum() for w in words) / count,
        sum(len(w) > 1 and w.isupper() for w in words) / count,
    )
    low = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    code = ((low[:-2] << 16) | (low[1:-1] << 8) | low[2:]) * np.uint32(2654435761)
    bag = np.sqrt(np.bincount((code >> np.uint32(23)).astype(np.int64), minlength=GRAMS))
    out[CLASSES + MEASURES :] = bag / np.linalg.norm(bag)
    return out


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, seed: int = 11) -> None:
        g = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.w = [g.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), g.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.prior = 0.5

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[0] + self.w[1])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def backward(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        h = self.hidden(x)
        dh = np.outer(d, self.w[2]) * (1 - h * h)
        return [np.clip((x - self.mean) / self.scale, -8, 8).T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]


    def contrast(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradient of positives x against unlabelled y, weighed alike."""
        as_positive = self.backward(x, (_sigmoid(self.logits(x)) - 1) / len(x))
        return [a + b for a, b in zip(as_positive, self.backward(y, _sigmoid(self.logits(y)) / len(y)))]

    def risk(self, x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
        """The non-negative risk of positives x and unlabelled y, and the direction to descend: its gradient, or, where the
        estimated risk of negatives is below 0, that which makes it rise again."""
        zp, zu = self.logits(x), self.logits(y)
        # losses: positive log(1 + e^-z), negative log(1 + e^z)
        negative = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
        value = prior * float(np.logaddexp(0, -zp).mean()) + max(0.0, negative)
        as_negative = [a - b for a, b in zip(self.backward(y, _sigmoid(zu) / len(y)), self.backward(x, prior * _sigmoid(zp) / len(x)))]
        if negative < 0:
            return value, [-a for a in as_negative]
        return value, [a + b for a, b in zip(self.backward(x, prior * (_sigmoid(zp) - 1) / len(x)), as_negative)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(m: Network, pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int, seed: int) -> Network:
    """With a prior: the non-negative risk. Without: positives against unlabelled, weighed alike."""
    g, lr, step = np.random.default_rng(seed), 0.01, 0
    m1, m2 = [np.zeros_like(w) for w in m.w], [np.zeros_like(w) for w in m.w]
    batches = max(1, len(unl) // 256)
    epochs = max(1 if prior is None else epochs, -(-(PRIOR_STEPS if prior is None else STEPS) // batches))
    for _ in range(epochs):
        p_order, u_order = np.array_split(g.permutation(len(pos)), batches), np.array_split(g.permutation(len(unl)), batches)
        for p, u in zip(p_order, u_order):
            if not len(p) or not len(u):
                continue
            step += 1
            grad = m.contrast(pos[p], unl[u]) if prior is None else m.risk(pos[p], unl[u], prior)[1]
            for i, d in enumerate(grad):
                d = d + (1e-3 if prior is None else 1e-4) * m.w[i]
                m1[i], m2[i] = 0.9 * m1[i] + 0.1 * d, 0.999 * m2[i] + 0.001 * d * d
                m.w[i] -= lr * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return m


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two sets' shares above a
    cut, for cuts that most positives pass, where its sampling error is small."""
    cuts = np.quantile(pos, np.linspace(0.002, 0.3, 60))
    p = (pos[None, :] >= cuts[:, None]).mean(axis=1)
    u = (unl[None, :] >= cuts[:, None]).mean(axis=1)
    return float(np.clip((u / np.maximum(p, 1e-9)).min(), 0.05, 0.99))


def fit(pos: np.ndarray, unl: np.ndarray, epochs: int = 30, seed: int = 11) -> Network:
    m = Network(seed)
    if not len(pos) or not len(unl):
        m.w = [np.zeros_like(w) for w in m.w]
        return m
    lexical = np.arange(FEATURES) >= CLASSES + MEASURES
    m.mean, m.scale = unl.mean(axis=0), np.where(lexical, 5 * (unl.std(axis=0) + 2e-2), unl.std(axis=0) + 1e-3)  # many trigrams count as one measure
    plain = Network(seed)
    plain.mean, plain.scale = m.mean, m.scale
    half = lambda x, k: x[k::2] if len(x) > 1 else x
    plain = _train(plain, half(pos, 0), half(unl, 0), None, epochs, seed)
    m.prior = estimate_prior(plain.logits(half(pos, 1)), plain.logits(half(unl, 1)))
    return _train(m, pos, unl, m.prior, epochs, seed)


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network:
    """Fits on about so many positives and unlabelled documents, drawn by hashes of their ids among
    those that aren't held out; of documents of equal id the one of least text counts. Features are made on the executors,
    what comes to the driver is a kilobyte a row."""
    free = id_bucket("doc_id", HELD[0]) != HELD[1]
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").where(free).select("doc_id").dropDuplicates()
    good = good.where(fraction_of("doc_id", "positive") < min(1.0, positives / max(1, good.count())))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").where(free)
    some = docs.where(fraction_of("doc_id", "unlabelled") < min(1.0, unlabelled / max(1, docs.count()))).withColumn("p", F.lit(0))
    rows = docs.join(F.broadcast(good), "doc_id").withColumn("p", F.lit(1)).unionByName(some)  # good: about `positives` ids
    rows = rows.groupBy("doc_id", "p").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [features_of(t).astype("<f2").tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "p": pdf["p"], "x": x})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sorted((r.p, r.doc_id, r.x) for r in rows.mapInPandas(run, f"doc_id {kind}, p int, x binary").toLocalIterator())
    part = lambda k: np.frombuffer(b"".join(x for p, _, x in found if p == k), "<f2").astype(np.float32).reshape(-1, FEATURES)
    return fit(part(1), part(0))


def with_scores(documents: DataFrame, model: Network, name: str = "quality") -> DataFrame:
    """documents and a column `name`, the probability of quality of the whole text; null: as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features_of(t) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(shared.value.scores(x))

    return documents.withColumn(name, F.pandas_udf(giving_back(run), "double")(F.col("text")))


def quality(documents: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= least) of every document.

    Null and empty texts get the score of an empty text, repeated rows repeated scores, rows with a null doc_id scores
    too; an empty table gives no rows. Without positives or unlabelled documents to learn from all score 0.5. Other
    columns aren't read.
    """
    scored = with_scores(documents.select("doc_id", "text"), train(documents, labels), "score")
    held = id_bucket("doc_id", HELD[0]) == HELD[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
