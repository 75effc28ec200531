"""Language identification of multilingual texts by expectation-maximisation.

Each language has a distribution over byte trigrams of lower-cased letters and spaces. A text is a
mixture of languages: the proportions that make its trigrams likeliest are found by
expectation-maximisation, for all of a batch's texts at once. Of the sets of its best one, two, three ...
languages the one of highest penalised likelihood is taken; its largest is the prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fraction_of, free_names, giving_back, id_bucket

GRAMS = 1 << 15
HELD = (4, 2)
PER_LANGUAGE = 4000  # documents of a language that its distribution is learned from, about
ROUNDS, REFINE = 12, 4
PENALTY = 8.0  # times half the log of the number of trigrams, for each language after the first
LEAST_SHARE, LEAST_GAIN = 0.25, 0.5  # keep_identified(): of the predicted language, and by trigram
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def grams_of(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the text's letters; none if it has no letter."""
    kept = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, kept)):
        return np.zeros(0, np.int64)
    b = np.frombuffer(f"  {kept} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int64)


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # (languages, GRAMS)

    def mixtures(self, texts) -> tuple[list[str], np.ndarray, list[list[str]], np.ndarray]:
        """For each text: predicted language, its share, all of the chosen set by share, and how much likelier a trigram is under
        the mixture than if all were equally likely (log)."""
        lists = [np.unique(grams_of(t), return_counts=True) for t in texts]
        names, share, sets, gains = [UNKNOWN] * len(lists), np.zeros(len(lists)), [[] for _ in lists], np.zeros(len(lists))
        live = [i for i, (g, _) in enumerate(lists) if len(g)]
        if not live or not self.names:
            return names, share, sets, gains
        sizes = np.array([len(lists[i][0]) for i in live])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = np.concatenate([lists[i][1] for i in live]).astype(np.float64)
        total = np.add.reduceat(n, starts)
        p = np.exp(self.log_p[:, np.concatenate([lists[i][0] for i in live])])
        count = len(self.names)

        def rounds(pi: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
            """Proportions after some rounds from pi (languages, texts), and the log-likelihood there."""
            for _ in range(times):
                part = p * np.repeat(pi, sizes, axis=1)
                part *= n / np.maximum(part.sum(axis=0), 1e-300)
                pi = np.add.reduceat(part, starts, axis=1) / total
            mixed = np.einsum("lg,lg->g", p, np.repeat(pi, sizes, axis=1))
            return pi, np.add.reduceat(n * np.log(np.maximum(mixed, 1e-300)), starts)

        pi, _ = rounds(np.full((count, len(live)), 1.0 / count), ROUNDS)
        rank = np.argsort(np.argsort(-pi, axis=0, kind="stable"), axis=0)
        best, chosen, going = np.full(len(live), -np.inf), pi, np.ones(len(live), bool)
        gain = np.zeros(len(live))
        for k in range(1, count + 1):
            some = np.where(rank < k, np.maximum(pi, 1e-6), 0.0)
            some, fit = rounds(some / some.sum(axis=0), REFINE if k > 1 else 0)
            value = fit - PENALTY * (k - 1) * np.log(np.maximum(total, 2)) / 2
            going &= value > best  # each text by itself: its sets end with the first that isn't better
            if not going.any():
                break
            best = np.where(going, value, best)
            chosen = np.where(going, some, chosen)
            gain = np.where(going, fit / total + np.log(GRAMS), gain)
        for j, i in enumerate(live):
            order = np.argsort(-chosen[:, j], kind="stable")
            sets[i] = [self.names[x] for x in order if chosen[x, j] > 0]
            names[i], share[i], gains[i] = self.names[order[0]], chosen[order[0], j], gain[j]
        return names, np.clip(share, 0.0, 1.0), sets, gains


def learn(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Languages:
    """Trigram distributions from about per_language documents of each language, drawn by a hash of
    the id among those with a lang that aren't held out. Counted on the executors; what comes to
    the driver is GRAMS numbers for each language."""
    known = documents.select("doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL").where(id_bucket("doc_id", HELD[0]) != HELD[1])
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Languages([], np.zeros((0, GRAMS)))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n)))), F.col("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                if lang not in sums:
                    sums[lang] = np.zeros(GRAMS)
                sums[lang] += np.bincount(grams_of(text), minlength=GRAMS)
        for lang, n in sums.items():
            g = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "gram": g, "n": n[g].astype(np.int64)})

    rows = known.where(fraction_of("doc_id", "langid") < share).select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    names = sorted(sizes)
    counts = np.zeros((len(names), GRAMS))
    for r in rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[names.index(r.lang), r.gram] = r.n
    return Languages(names, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * GRAMS)))


def with_languages(documents: DataFrame, model: Languages, name: str = "mixture") -> DataFrame:
    """documents and a column `name`: struct of lang, share, langs (the chosen set by share) and gain."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [shared.value.mixtures(texts.iloc[i : i + 64]) for i in range(0, len(texts), 64)]
            yield pd.DataFrame({"lang": [x for p in parts for x in p[0]], "share": [float(x) for p in parts for x in p[1]], "langs": [x for p in parts for x in p[2]], "gain": [float(x) for p in parts for x in p[3]]})

    return documents.withColumn(name, F.pandas_udf(giving_back(run), "struct<lang: string, share: double, langs: array<string>, gain: double>")(F.col("text")))


def identify(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the predicted language's share) and langs (the chosen
    set) of every document.

    A text that is null or has no letter is `und` with score 0, as is every text if no document
    has a language to learn from. Repeated rows give repeated rows.
    """
    docs = documents.select("doc_id", "text")
    rows = with_languages(docs, learn(documents, per_language))
    held = id_bucket("doc_id", HELD[0]) == HELD[1]
    return rows.select("doc_id", held.alias("held_out"), F.col("mixture.lang").alias("lang_pred"), F.col("mixture.share").alias("score"), F.col("mixture.langs").alias("langs"))


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents that have a language, with their columns, whatever these are called: one that makes up a quarter
    of the text at least, whose trigrams its mixture makes half a nat likelier each than equal chances would.

    So texts that are null, empty or without a letter go, and letters in the order of no learned language; of repeated
    rows all stay or go. With no language to learn from all go; an empty table stays empty.
    """
    (name,) = free_names(documents, "mixture")
    mixture = F.col(name)
    rows = with_languages(documents, learn(documents), name)
    return rows.where((mixture["lang"] != UNKNOWN) & (mixture["share"] >= LEAST_SHARE) & (mixture["gain"] >= LEAST_GAIN)).drop(name)
