"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed ones of itself and of its first 4, 5 and 6 letters.
Filters of several widths run over the words, the maximum over the text is taken of each, and a
linear layer gives the logit. Thresholds are calibrated for each language, which is guessed from
the text's words alone; the score is the logistic function of logit minus threshold.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import forget, fraction_of, free_names, give_back, giving_back, id_bucket, known_labels, labelled, labelled_sample

HASH, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
PREFIXES = (4, 5, 6)
PER_CLASS = 3000  # labelled documents of each label that the classifier is fitted on to begin with, about
RATE, SIZE = 0.01, 16  # of the pass over all
FIXED, GRID, FAR = 1 << 30, 256, 30  # sums are of fixed-point numbers, so that they don't depend on their order; logits for thresholds are counted in steps of 1 / GRID
ROW = 16  # parameters or counts a row of what tasks send
STEPS = 300  # updates at least
HELD = (5, 0)
PAD = max(WIDTHS) - 1
STRIP = " .,;:!?\"'()[]{}|*&%$#-"


_KNOWN: dict[str, np.ndarray] = {}  # a worker's own: features of words seen before
REMEMBERED = 60_000


def _hashed(word: str) -> np.ndarray:
    found = _KNOWN.get(word)
    if found is None:
        bare = word.strip(STRIP)
        keys = [bare] + [bare[:n] + "*" if len(bare) >= n else bare for n in PREFIXES]
        found = np.array([xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) % HASH for k in keys], np.int32)
        if len(_KNOWN) >= REMEMBERED:
            _KNOWN.clear()
        if len(word) < 100:
            _KNOWN[word] = found
    return found


def words_of_text(text: str | None) -> list[str]:
    return (text or "").lower().split()


def tokenised(texts, split=words_of_text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features (words, 4) of the batch's distinct words, the last being padding; tokens, each text
    ending in padding; starts of the texts."""
    ids: dict[str, int] = {}
    parts, starts, at = [], [], 0
    for text in texts:
        own = [ids.setdefault(w, len(ids)) for w in split(text)] + [-1] * PAD
        parts.append(np.array(own, dtype=np.int64))
        starts.append(at)
        at += len(own)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    tokens[tokens < 0] = len(ids)
    features = np.array([*map(_hashed, ids), np.full(1 + len(PREFIXES), HASH, np.int32)])
    return features, tokens, np.array(starts, dtype=np.int64)


def from_words(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As tokenised(), of texts given as the features of their words."""
    sizes = np.array([len(x) + PAD for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    padding = np.full((PAD, 1 + len(PREFIXES)), HASH, np.int64)
    every = np.concatenate([part for x in texts for part in (x, padding)])
    code = np.zeros(len(every), np.int64)
    for column in every.T:  # numbers of distinct rows, by one feature more each
        distinct, place = np.unique(code * (HASH + 1) + column, return_inverse=True)
        code = place
    _, first, tokens = np.unique(code, return_index=True, return_inverse=True)
    features = every[first]
    pad, last = tokens[starts[0] + sizes[0] - 1], len(features) - 1
    features[[pad, last]] = features[[last, pad]]
    tokens = np.where(tokens == pad, last, np.where(tokens == last, pad, tokens))
    return features, tokens, starts


class Model:
    """Embeddings (HASH + 1 for padding), filters by width, linear layer, language guesser, thresholds."""

    def __init__(self, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        self.emb = g.normal(0, 0.1, (HASH + 1, DIM)).astype(np.float32)
        self.emb[HASH] = 0
        self.conv = [g.normal(0, 0.5 / np.sqrt(k), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out, self.intercept = g.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0
        self.langs: list[str] = []
        self.word_lang = np.zeros((HASH + 1, 0), np.float32)
        self.thresholds = np.zeros(1)

    def pooled(self, batch, where: bool = False):
        """(texts, widths * FILTERS) maxima, and the token at which each is if asked for."""
        features, tokens, starts = batch
        words = self.emb[features].sum(axis=1)
        out, at = [], []
        for k, conv, bias in zip(WIDTHS, self.conv, self.bias):
            z = (words @ conv[0])[tokens] + bias
            for j in range(1, k):
                z[:-j] += (words @ conv[j])[tokens[j:]]
            z[tokens == len(features) - 1] = bias  # no window starts in one text's padding and ends in the next
            out.append(np.maximum.reduceat(z, starts, axis=0))
            if where:
                ends = np.append(starts[1:], len(tokens))
                at.append(np.array([z[a:b].argmax(axis=0) + a for a, b in zip(starts, ends)]))
        return np.hstack(out), (np.hstack(at) if where else None)

    def logits(self, batch) -> np.ndarray:
        return np.maximum(self.pooled(batch)[0], 0) @ self.out + self.intercept

    def guess_by(self, counts: np.ndarray) -> None:
        """counts: (HASH + 1, languages), of words in texts of each language."""
        self.word_lang = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * HASH)).astype(np.float32)
        self.word_lang[HASH] = 0

    def vector(self) -> np.ndarray:
        """What is fitted by gradients, one number after another."""
        return np.concatenate([x.ravel() for x in (self.emb, *self.conv, self.bias, self.out, np.array([self.intercept]))]).astype(np.float64)

    def move(self, by: np.ndarray) -> None:
        """Add to what vector() gives."""
        at = 0
        for x in (self.emb, *self.conv, self.bias, self.out):
            x += by[at : at + x.size].reshape(x.shape)
            at += x.size
        self.intercept += float(by[at])

    def language(self, batch) -> np.ndarray:
        features, tokens, starts = batch
        return np.add.reduceat(self.word_lang[features[:, 0]][tokens], starts, axis=0).argmax(axis=1)

    def scores(self, texts) -> np.ndarray:
        batch = tokenised(texts)
        if not len(batch[2]):
            return np.zeros(0)
        shift = self.thresholds[self.language(batch)] if self.langs else self.thresholds[0]
        return 1 / (1 + np.exp(-np.clip(self.logits(batch) - shift, -30, 30)))


def gradients(m: Model, batch, labels: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighed logistic loss of a batch: by parameter, embeddings as (rows, gradients)."""
    features, tokens, _ = batch
    pool, at = m.pooled(batch, where=True)
    hidden = np.maximum(pool, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.intercept, -30, 30)))
    d = ((p - labels) * weight / len(labels)).astype(np.float32)
    dh = np.outer(d, m.out) * (pool > 0)
    out = {"out": hidden.T @ d, "intercept": d.sum(), "bias": dh.sum(axis=0).reshape(len(WIDTHS), FILTERS)}
    padding, index, grads = len(features) - 1, [], []
    for w, (k, conv) in enumerate(zip(WIDTHS, m.conv)):
        cols = slice(w * FILTERS, (w + 1) * FILTERS)
        out[f"conv{w}"] = np.zeros_like(conv)
        live = dh[:, cols] != 0
        for j in range(k):
            word = tokens[np.minimum(at[:, cols] + j, len(tokens) - 1)]
            word = np.where(tokens[at[:, cols]] == padding, padding, word)
            e = m.emb[features[word]].sum(axis=2)
            out[f"conv{w}"][j] = np.einsum("nfd,nf->df", e, dh[:, cols])
            de = dh[:, cols][:, :, None] * conv[j].T[None]
            index.append(features[word[live]])
            grads.append(de[live])
    index, grads = np.concatenate(index), np.concatenate(grads)
    flat, source = index.ravel(), np.repeat(np.arange(len(index)), index.shape[1])
    order = np.argsort(flat, kind="stable")
    rows, starts = np.unique(flat[order], return_index=True)
    sums = np.add.reduceat(grads[source[order]], starts, axis=0) if len(rows) else np.zeros((0, DIM), np.float32)
    out["emb"] = rows[rows < HASH], sums[rows < HASH]
    return out


class Adam:
    """Steps of a model down the gradients of batches."""

    def __init__(self, model: Model, lr: float):
        self.model, self.lr, self.steps, self.state = model, lr, 0, {}

    def _move(self, name: str, value, grad, rows=None) -> None:
        m1, m2 = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        i = rows if rows is not None else slice(None)
        m1[i] = 0.9 * m1[i] + 0.1 * grad
        m2[i] = 0.999 * m2[i] + 0.001 * grad * grad
        value[i] -= self.lr * (m1[i] / (1 - 0.9**self.steps)) / (np.sqrt(m2[i] / (1 - 0.999**self.steps)) + 1e-7)

    def step(self, batch, labels: np.ndarray, weight: np.ndarray) -> None:
        m, self.steps = self.model, self.steps + 1
        grads = gradients(m, batch, labels, weight)
        self._move("out", m.out, grads["out"])
        m.intercept -= self.lr * float(grads["intercept"])
        for w, conv in enumerate(m.conv):
            self._move(f"conv{w}", conv, grads[f"conv{w}"])
        self._move("bias", m.bias, grads["bias"])
        if len(grads["emb"][0]):
            self._move("emb", m.emb, grads["emb"][1], grads["emb"][0])


def fit(texts: list, labels: np.ndarray, langs: list, epochs: int = 6, seed: int = 7, lr: float = 0.01, size: int = 48) -> Model:
    """Adam on the logistic loss, labels weighed alike; one in five rows is kept for the thresholds. texts:
    as features of their words (see word_features). Batches are made up once and taken in another order each epoch."""
    m, g = Model(seed), np.random.default_rng(seed)
    if not len(texts):
        m.out[:], m.intercept = 0, -1.0
        return m
    m.langs = sorted({x for x in langs if x})
    if m.langs:
        counts = np.zeros((HASH + 1, len(m.langs)), np.float64)
        for i, lang in enumerate(m.langs):
            of = [t[:, 0] for t, x in zip(texts, langs) if x == lang]
            counts[:, i] = np.bincount(np.concatenate(of), minlength=HASH + 1)
        m.guess_by(counts)
    labels = np.asarray(labels, np.float32)
    share = np.array([max(1, (labels == v).sum()) for v in (0, 1)])
    weight = (len(labels) / 2 / share)[labels.astype(int)].astype(np.float32)
    order = g.permutation(len(texts))
    test, train = (order[: len(texts) // 5], order[len(texts) // 5 :]) if len(texts) >= 50 else (order, order)
    batches = [(rows, from_words([texts[i] for i in rows])) for rows in np.array_split(train, -(-len(train) // size))]
    adam = Adam(m, lr)
    for _ in range(max(epochs, -(-STEPS // len(batches)))):
        for b in g.permutation(len(batches)):
            rows, batch = batches[b]
            adam.step(batch, labels[rows], weight[rows])
    parts = [from_words([texts[i] for i in test[b : b + 64]]) for b in range(0, len(test), 64)]
    logits = np.concatenate([m.logits(x) for x in parts])
    lang = np.concatenate([m.language(x) for x in parts]) if m.langs else np.zeros(len(test), int)
    overall = _threshold(logits, labels[test])
    m.thresholds = np.array([_threshold(logits[lang == i], labels[test][lang == i], overall) for i in range(max(1, len(m.langs)))])
    return m


def _threshold(logits: np.ndarray, labels: np.ndarray, otherwise: float = 0.0, n: np.ndarray | None = None) -> float:
    """The middle of the cuts with fewest errors; `otherwise` with under ten rows of either label. n: how many rows each stands for; these
    aren't cut between equal logits."""
    counts = np.ones(len(logits), np.int64) if n is None else n
    if min(counts[labels == 1].sum(), counts[labels == 0].sum()) < 10:
        return otherwise
    order = np.argsort(logits)
    z, y, k = logits[order], labels[order], counts[order]
    errors = np.concatenate([[0], np.cumsum(k * (y == 1))]) + np.concatenate([[0], np.cumsum((k * (y == 0))[::-1])])[::-1]
    if n is not None:
        errors[1:-1][z[1:] == z[:-1]] = k.sum() + 1
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    best = cuts[errors == errors.min()]
    return float((best[0] + best[-1]) / 2)


def word_features(text: str | None) -> np.ndarray:
    """(words, 4) features of a text's words."""
    found = [_hashed(w) for w in words_of_text(text)]
    return np.array(found, np.int32).reshape(-1, 1 + len(PREFIXES))


def _learnt(rows: DataFrame, start: Model, weight: np.ndarray, size: int = SIZE) -> Model:
    """start after one pass over all rows: label, text, lang, apart. Each task goes from start down the gradients of its own rows, but for those kept
    apart, and the model moves by what these moves are on average over rows; words of all rows are counted by language. What tasks send is
    summed on executors, ROW numbers at a time; the driver gets one model and one table of counts."""
    spark = rows.sparkSession
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect() if r.lang)
    shared, place = spark.sparkContext.broadcast((start, weight)), {x: i for i, x in enumerate(langs)}
    cells = -(-len(start.vector()) // ROW)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, before, seen = copy.deepcopy(shared.value[0]), shared.value[0].vector(), 0
        adam, counts = Adam(m, RATE), np.zeros((len(langs), HASH), np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                for apart, some in part.groupby("apart"):
                    batch = features, tokens, starts = tokenised(some["text"])
                    own = features[:, 0][tokens]
                    at_lang = np.repeat([place.get(x, -1) for x in some["lang"]], np.diff(np.append(starts, len(tokens))))
                    use = (own < HASH) & (at_lang >= 0)
                    np.add.at(counts, (at_lang[use], own[use]), 1)
                    if not apart:
                        labels = some["label"].to_numpy()
                        adam.step(batch, labels.astype(np.float32), shared.value[1][labels].astype(np.float32))
                        seen += len(some)
        moved = np.zeros(cells * ROW)
        moved[: len(before)] = np.rint((m.vector() - before) * seen * FIXED)
        table = np.concatenate([moved.astype(np.int64), counts.ravel(), [seen], np.zeros(ROW - 1, np.int64)]).reshape(-1, ROW)
        i = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame(table[i], columns=columns).assign(i=i)

    columns = [f"d{j}" for j in range(ROW)]
    sent = rows.mapInPandas(giving_back(run), ", ".join(f"{c} long" for c in [*columns, "i"]))
    sums = sent.groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    table = np.zeros((cells + len(langs) * HASH // ROW + 1, ROW), np.int64)
    table[sums["i"].to_numpy()] = np.stack([sums[c].to_numpy() for c in columns], axis=1)
    out = copy.deepcopy(start)
    out.move(table[:cells].ravel() / FIXED / max(1, table[-1, 0]))
    out.langs = langs
    counts = table[cells:-1].reshape(len(langs), HASH).T
    out.guess_by(np.vstack([counts, np.zeros((1, len(langs)))]))
    return out


def _calibrated(rows: DataFrame, model: Model) -> None:
    """Sets the model's thresholds by all rows that were kept apart, counted by language, logit and label."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 128):
                some = pdf.iloc[at : at + 128]
                batch = tokenised(some["text"])
                z = np.rint(np.clip(shared.value.logits(batch), -FAR, FAR) * GRID).astype(np.int64)
                yield pd.DataFrame({"lang": shared.value.language(batch) if shared.value.langs else 0, "z": z, "label": some["label"].to_numpy()})

    found = rows.where("apart").select("text", "label").mapInPandas(giving_back(run), "lang int, z long, label int").groupBy("lang", "z", "label").agg(F.count("*").alias("n")).toArrow()
    lang, z, label, n = (found[c].to_numpy() for c in ("lang", "z", "label", "n"))
    overall = _threshold(z / GRID, label, n=n)
    model.thresholds = np.array([_threshold(z[lang == i] / GRID, label[lang == i], overall, n[lang == i]) for i in range(max(1, len(model.langs)))])


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fits on all labelled documents that aren't held out, on all their words, however many: on about per_class of each label to begin with, many times, and
    if there are more then on all in one pass on the executors; what labels weigh, languages and thresholds come from all too. The first ones' words
    are hashed on the executors and come to the driver as eight bytes each."""
    rows = labelled_sample(documents, labels, "toxic", HELD, per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "label", "lang"]].assign(words=[word_features(t).astype("<u2").tobytes() for t in pdf["text"]])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(run, f"doc_id {kind}, label int, lang string, words binary").toLocalIterator()
    rows = sorted(found, key=lambda r: (r.doc_id, r.label))
    words = [np.frombuffer(r.words, "<u2").reshape(-1, 1 + len(PREFIXES)) for r in rows]
    model = fit(words, np.array([r.label for r in rows]), [r.lang for r in rows])
    del words, rows
    if known_labels(labels, "toxic", HELD).groupBy("label").count().where(F.col("count") > per_class).count():
        every = labelled(documents, labels, "toxic", HELD)
        n = {r.label: r["count"] for r in every.groupBy("label").count().collect()}
        weight = np.array([sum(n.values()) / 2 / max(1, n.get(v, 0)) for v in (0, 1)])
        rows = every.withColumn("apart", fraction_of("doc_id", "apart") < 0.2).drop("doc_id")
        model = _learnt(rows, model, weight)
        _calibrated(rows, model)
        forget(every)
    give_back()
    return model


def with_scores(documents: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """documents and a column `name`, the score of the whole text; null text: as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [shared.value.scores(texts.iloc[i : i + 128]) for i in range(0, len(texts), 128)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return documents.withColumn(name, F.pandas_udf(giving_back(run), "double")(F.col("text")))


def toxicity(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every document.

    Fitted on all labelled documents that aren't held out, about per_class of each label to begin with. Null and empty
    texts get the score of an empty text, repeated rows repeated scores, rows with a null doc_id scores too; an
    empty table gives no rows. Without labels all score under 0.5. Other columns aren't read.
    """
    docs = documents.select("doc_id", "text")
    scored = with_scores(docs, train(documents, labels, per_class), "score")
    held = id_bucket("doc_id", HELD[0]) == HELD[1]
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_harmless(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under 0.5, with their columns, whatever these are called.

    Null and empty texts are judged as an empty text, repeated rows alike; an empty table stays empty, and
    without labels all stay.
    """
    (name,) = free_names(documents, "toxicity")
    scored = with_scores(documents, train(documents, labels), name)
    return scored.where(F.col(name) < 0.5).drop(name)
