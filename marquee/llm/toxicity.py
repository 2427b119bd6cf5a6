"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

Only documents carry labels. A sentence's probability is logistic in its words and their beginnings; a document's is
the noisy-or of its sentences, 1 - prod(1 - p). Both are fitted together on document labels, after which the sentence
probabilities locate what offends. Features are words and beginnings that are clearly more frequent in toxic documents.

The fit uses a bounded sample: of each class the `SAMPLE` labelled documents with the smallest hash of their id, each
class weighted by its count over all labelled rows of the training folds. Whole texts are fitted and scored. Weights
belong to text features alone; labels, language, source and id are no inputs of a score.

Defined results: a null, empty or wordless text has no sentences and scores 0. Repeated rows score alike. Labels that
are null or whose document is missing are left out; of several labels of one document the largest counts, and of
several texts of one labelled document the smallest. Without both classes among the training labels, every score is
the label of the class that is there (0 if there is none). Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import durable, through_python

#: Documents of each class in the fitted sample.
SAMPLE = 2500
#: Files that hold the sample, however many partitions a shuffle has. On a local disk an executor starts a process (chmod) for
#: each file, which for an instant counts with all of the executor's memory.
PARTS = 12
#: Of every FOLDS documents, by a hash of the id, one is held out.
FOLDS = 5
#: Lengths of the beginnings of words that are features beside the words themselves.
BEGINNINGS = (3, 4, 5, 6)
#: A feature must be in this many sampled documents.
LEAST_DOCUMENTS = 5
#: Standard deviations by which a feature must be more frequent in toxic documents than chance would have it.
LEAST_DEVIATION = 4.5
STEPS, RATE, SHRINK = 300, 0.1, 1e-3
REMEMBERED = 300_000
PIECE = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(word: str) -> list[int]:
    """Checksums of a lower-cased word and of its beginnings, which have a mark behind them."""
    return [crc32(f.encode()) for f in (word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n])]


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float
    constant: float | None = None

    def of_word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))


class Scorer:
    """A worker's model with the weights of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def sentences(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(logit, place among the pieces) of every sentence with words."""
        pieces = PIECE.findall((text or "").lower())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if not known:
            known.update(dict.fromkeys(STOPS, np.nan))
        for word in set(pieces).difference(known):
            known[word] = self.model.of_word(word)
        weight = np.fromiter(map(known.__getitem__, pieces), np.float64, len(pieces))
        stop = np.isnan(weight)
        sentence = np.cumsum(stop)[~stop]
        if not len(sentence):
            return np.zeros(0), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
        return self.model.bias + np.add.reduceat(weight[~stop], first), np.flatnonzero(~stop)[first]

    def score(self, text: str | None) -> float:
        logits, _ = self.sentences(text)
        if self.model.constant is not None:
            return self.model.constant if len(logits) else 0.0
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def fit_arrays(sentence_of: np.ndarray, feature: np.ndarray, doc_of: np.ndarray, label: np.ndarray, weight: np.ndarray,
               width: int) -> tuple[np.ndarray, float]:
    """Weights and bias with the least weighted noisy-or loss, found by gradient steps with momentum.

    sentence_of, feature: entries sorted by sentence; doc_of: document of every sentence; label, weight: of documents.
    """
    w, b = np.zeros(width), -5.0
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    share, n_sentences = weight / weight.sum(), len(doc_of)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence_of, weights=w[feature], minlength=n_sentences)
        total = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(label))
        pull = np.where(label == 1, -1.0 / np.expm1(np.clip(total, 1e-3, 50)), 1.0) * share
        slope = pull[doc_of] / (1 + np.exp(-np.clip(z, -40, 40)))
        gradient = np.append(np.bincount(feature, weights=slope[sentence_of], minlength=width) + SHRINK * w, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE) -> Model:
    """Fit on the sample; only its features and labels come to the driver."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model({}, -5.0, float(next(iter(counts), 0)))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter(F.col("label") == 1).orderBy(*order).limit(sample).unionByName(
        known.filter(F.col("label") == 0).orderBy(*order).limit(sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = durable(texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text")).coalesce(PARTS))
    n0, n1 = (rows.filter(F.col("label") == c).count() for c in (0, 1))

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                found = {f for word in set(PIECE.findall((text or "").lower())) - STOPS for f in features(word)}
                yield pd.DataFrame({"feature": list(found), "label": label})

    in_toxic, in_clean = (F.coalesce(F.col(c), F.lit(0)) for c in ("toxic", "clean"))
    share = (in_toxic + in_clean) / (n0 + n1)
    deviation = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / max(n0, 1) + 1 / max(n1, 1)))
    useful = (rows.mapInPandas(distinct, "feature bigint, label int").groupBy("feature")
              .agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
              .filter((in_toxic >= LEAST_DOCUMENTS) & (in_toxic / max(n1, 1) - in_clean / max(n0, 1) >= LEAST_DEVIATION * deviation))
              .select("feature").orderBy("feature"))
    chosen_features = [r["feature"] for r in useful.collect()]
    place = {f: i for i, f in enumerate(chosen_features)}

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Numbers of the useful features in each sentence, packed."""
        for batch in batches:
            out = []
            for i, label, text in zip(batch["id"], batch["label"], batch["text"]):
                sentence, found, words = 0, set(), 0
                for word in PIECE.findall((text or "").lower()):
                    if word in STOPS:
                        sentence, words = sentence + (words > 0), 0
                    else:
                        words += 1
                        found.update((sentence, place[f]) for f in features(word) if f in place)
                pairs = np.array(sorted(found), np.int32).reshape(-1, 2)
                out.append((i, label, sentence + (words > 0), pairs.tobytes()))
            yield pd.DataFrame(out, columns=["id", "label", "sentences", "pairs"])

    kind = rows.schema["id"].dataType.simpleString()
    held = rows.mapInPandas(entries, f"id {kind}, label int, sentences int, pairs binary").orderBy("id").collect()
    label = np.array([row["label"] for row in held])
    sentences = np.array([row["sentences"] for row in held], np.int64)
    first = np.cumsum(sentences) - sentences
    pairs = [np.frombuffer(row["pairs"], np.int32).reshape(-1, 2) for row in held]
    per_class = {0: counts[0] / max(1, n0), 1: counts[1] / max(1, n1)}
    w, b = fit_arrays(np.concatenate([p[:, 0] + f for p, f in zip(pairs, first)]), np.concatenate([p[:, 1] for p in pairs]),
                      np.repeat(np.arange(len(held)), sentences), label, np.array([per_class[int(c)] for c in label]), len(place))
    return Model({f: float(x) for f, x in zip(chosen_features, w) if abs(x) > 1e-3}, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": [scorer.score(text) for text in batch["text"]]})

    scored = through_python(rows, run, "score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, sentence, score: the sentences that are toxic on their own; start is counted in characters."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"]):
                for found in re.finditer(r"[^.!?\n]+[.!?]*", text or ""):
                    logits, _ = scorer.sentences(found.group())
                    if len(logits) and (p := float(np.exp(-np.logaddexp(0, -logits[0])))) >= least:
                        out.append((i, found.start(), found.group(), p))
            yield pd.DataFrame(out, columns=["id", "start", "sentence", "score"])

    return through_python(rows, run, "start int, sentence string, score double", name=id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score below one half."""
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.Series([scorer.score(text) for text in batch], dtype=float)

    return docs.filter(scores(F.col(text_col)) < 0.5)
