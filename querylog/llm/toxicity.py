"""A convolutional text classifier for toxicity, trained here with numpy.

A word is the sum of three hashed embeddings: of itself and of its first four and six
bytes. Filters of one to three words run over the text, each is max-pooled over the
whole text, and a linear layer with a sigmoid gives the score. The first embedding
dimension starts from how much more often toxic texts hold the hashed feature, the
rest from noise; all is then trained by Adam on the logistic loss.

Scores are calibrated by language, which is guessed from the text's own stop words:
each language's best threshold on the training rows is moved to ``THRESHOLD``.
Training takes a bounded sample of labelled rows: ``most_toxic`` and ``most_clean``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.textkit import mixed, plain_words, word_hashes

THRESHOLD = 0.7
#: Frequent short words by which the language of a text is guessed.
STOP_WORDS = {
    "de": "der die das und ist in den von zu mit des auf für im dem nicht ein eine als auch es an werden aus".split(),
    "en": "the of and to in is that it was for on are as with his they be at this from have or by".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec il".split(),
}
_LANGUAGES = sorted(STOP_WORDS)


@dataclass(frozen=True)
class Network:
    """Sizes of the network and of its training."""

    buckets: int = 1 << 16
    width: int = 6
    filters: int = 6
    spans: tuple[int, ...] = (1, 2, 3)
    epochs: int = 5
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-4
    most_toxic: int = 2_500
    most_clean: int = 4_000
    seed: int = 3


def _features(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of words: of the whole, of four and of six leading bytes. Row 0 is padding."""
    parts = [word_hashes(words), word_hashes([w[:4] for w in words]), word_hashes([w[:6] for w in words])]
    salted = [mixed(h + np.uint64(i + 1)) % np.uint64(buckets - 1) for i, h in enumerate(parts)]
    return np.stack(salted, axis=1).astype(np.int32) + 1


class _Texts:
    """Some texts as codes into their distinct words, with gaps between texts."""

    def __init__(self, texts: list[bytes | None], how: Network):
        gap, self.starts, self.ends, self.languages, words = max(how.spans), [], [], [], []
        pad = [b""] * gap
        stop = {w.encode(): {k for k, ws in enumerate(STOP_WORDS[x] for x in _LANGUAGES) if w in ws} for ws in STOP_WORDS.values() for w in ws}
        for text in texts:
            own = plain_words(text)
            counts = np.zeros(len(_LANGUAGES) + 1)
            counts[-1] = 0.5
            for word in filter(stop.__contains__, own):
                for k in stop[word]:
                    counts[k] += 1
            self.languages.append(int(counts.argmax()))
            self.starts.append(len(words))
            words += own
            self.ends.append(len(words) + 1)  # the last window lies in the gap, clear of the next text
            words += pad
        words += pad
        distinct = dict.fromkeys([b"", *words])
        index = {w: i for i, w in enumerate(distinct)}
        self.codes = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        self.features = _features(list(distinct), how.buckets)
        self.features[0] = 0
        self.starts, self.ends = np.array(self.starts, np.int64), np.array(self.ends, np.int64)


class Classifier:
    """Weights of the network; small enough to be sent to every task."""

    def __init__(self, how: Network):
        rng = np.random.default_rng(how.seed)
        self.how = how
        self.embed = rng.normal(0, 0.05, (how.buckets, how.width)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.1, (s, how.width, how.filters)).astype(np.float32) for s in how.spans]
        for f in self.filters:
            f[:, 0, 0] = 1.0 / len(f)
        self.out = np.full(how.filters * len(how.spans), 0.1, np.float32)
        self.bias = np.float32(-1.0)
        self.shift = np.zeros(len(_LANGUAGES) + 1)

    def pooled(self, texts: _Texts, places: bool = False):
        """Max-pooled filter answers of each text, and where they were reached."""
        words = self.embed[texts.features].sum(axis=1)
        total, values, where = len(texts.codes), [], []
        for span, kernel in zip(self.how.spans, self.filters, strict=True):
            n = total - span + 1
            answers = sum((words @ kernel[j])[texts.codes[j : j + n]] for j in range(span))
            values.append(np.maximum.reduceat(answers, np.stack([texts.starts, texts.ends], axis=1).ravel())[::2])
            if places:
                where.append(np.stack([answers[a:b].argmax(axis=0) + a for a, b in zip(texts.starts, texts.ends, strict=True)]))
        return np.maximum(np.concatenate(values, axis=1), 0), where

    def raw(self, texts: _Texts) -> np.ndarray:
        return self.pooled(texts)[0].astype(np.float64) @ self.out + float(self.bias)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores from 0 to 1 of whole texts; the more, the likelier toxic."""
        if not texts:
            return np.empty(0)
        made = _Texts(texts, self.how)
        return 1 / (1 + np.exp(-np.clip(self.raw(made) + self.shift[made.languages], -30, 30)))

    def start_from_counts(self, texts: list[_Texts], toxic: np.ndarray) -> None:
        """Set the first embedding dimension to shrunken log odds of text frequencies."""
        counts = np.zeros((2, self.how.buckets))
        for text, label in zip(texts, toxic, strict=True):
            counts[int(label), np.unique(text.features)] += 1
        n = np.array([(toxic == 0).sum(), toxic.sum()])[:, None] + 1.0
        odds = np.log((counts[1] + 0.5) / n[1]) - np.log((counts[0] + 0.5) / n[0])
        odds *= counts[1] / (counts[1] + 10)
        odds[counts.sum(axis=0) < 3] = 0
        self.embed[:, 0] = np.clip(odds, -2, 6) / 3
        self.embed[counts.sum(axis=0) < 2] = 0
        self.embed[0] = 0

    def train(self, texts: list[bytes | None], toxic: np.ndarray) -> None:
        how, rng = self.how, np.random.default_rng(self.how.seed)
        self.start_from_counts([_Texts([t], how) for t in texts], toxic)
        weights = [self.embed, *self.filters, self.out]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step, bias_step = 0, 0.0
        balance = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum())) * len(toxic)
        for _ in range(how.epochs):
            order = rng.permutation(len(texts))
            for low in range(0, len(order), how.batch):
                chosen = order[low : low + how.batch]
                made = _Texts([texts[i] for i in chosen], how)
                if rng.random() < 0.5:  # learn beginnings of words too
                    made.features[:, 0] = 0
                pooled, where = self.pooled(made, places=True)
                error = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30))) - toxic[chosen]
                error = (error * balance[chosen] / len(chosen)).astype(np.float32)
                grads = [np.zeros_like(w) for w in weights]
                grads[-1] = pooled.T @ error + how.decay * self.out
                back = error[:, None] * self.out[None, :] * (pooled > 0)
                for k, span in enumerate(how.spans):
                    own = back[:, k * how.filters : (k + 1) * how.filters]
                    for j in range(span):
                        feature = made.features[made.codes[np.minimum(where[k] + j, len(made.codes) - 1)]]
                        grads[1 + k][j] = np.einsum("tfd,tf->df", self.embed[feature].sum(axis=2), own)
                        pull = own[:, :, None] * self.filters[k][j].T[None, :, :]
                        for p in range(3):
                            np.add.at(grads[0], feature[:, :, p].ravel(), pull.reshape(-1, how.width))
                step += 1
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= how.rate * 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6) * (g != 0)
                bias_step = 0.9 * bias_step + 0.1 * float(error.sum())
                self.bias -= np.float32(how.rate * bias_step * 5)
                self.embed[0] = 0
        self.calibrate(texts, toxic)

    def calibrate(self, texts: list[bytes | None], toxic: np.ndarray) -> None:
        """Move the best threshold of every language to THRESHOLD."""
        raw, language = [], []
        for low in range(0, len(texts), 256):
            made = _Texts(texts[low : low + 256], self.how)
            raw.append(self.raw(made)), language.extend(made.languages)
        raw, language = np.concatenate(raw), np.array(language)
        wanted = np.log(THRESHOLD / (1 - THRESHOLD))
        general = _best_cut(raw, toxic)
        for k in range(len(self.shift)):
            own = language == k
            enough = own.any() and min(toxic[own].sum(), (1 - toxic[own]).sum()) >= 20
            self.shift[k] = wanted - (_best_cut(raw[own], toxic[own]) if enough else general)


def _best_cut(raw: np.ndarray, toxic: np.ndarray) -> float:
    """Midway in the widest gap among the cuts with the fewest errors."""
    if not 0 < toxic.sum() < len(toxic):
        return 0.0
    order = np.argsort(raw)
    raw, toxic = raw[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    edges = np.concatenate([[raw[0] - 2], raw, [raw[-1] + 2]])
    gaps = np.where(errors == errors.min(), np.diff(edges), -1)
    best = int(gaps.argmax())
    return float((edges[best] + edges[best + 1]) / 2)


def held_out(doc_id):
    """Rows that no training may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, how: Network | None = None) -> Classifier | None:
    """A classifier fitted on a bounded sample of the labelled rows not held out.

    None if the rows do not hold both classes. A row labelled both ways is left out; of
    several texts with one doc_id the first in order counts.
    """
    how = how or Network()
    ways = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")
    )
    ways = ways.filter(F.col("toxic") == F.col("most")).filter(~held_out(F.col("doc_id"))).drop("most")
    some = None
    for label, most in ((1, how.most_toxic), (0, how.most_clean)):
        part = ways.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    toxic = rows.column("toxic").to_numpy().astype(np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return None
    model = Classifier(how)
    model.train(rows.column("text").cast(pa.binary()).to_pylist(), toxic)
    return model


def score_of(model):
    """A column function: the toxicity score of a text. ``model`` is a broadcast, pickled classifier."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = pickle.loads(model.value)
        for batch in texts:
            values, out = batch.cast(pa.binary()).to_pylist(), []
            low = size = 0
            for i, text in enumerate(values):  # a million bytes or so at a time
                size += len(text or b"")
                if size > 1_000_000 or i + 1 == len(values):
                    out.append(classifier.scores(values[low : i + 1]))
                    low, size = i + 1, 0
            yield pa.array(np.concatenate(out) if out else np.empty(0))

    return score


def scored(docs: DataFrame, labels: DataFrame, how: Network | None = None, prefix: str = "") -> DataFrame:
    """All documents with ``held_out``, ``score`` and ``predicted``.

    Needs doc_id and text in ``docs``, doc_id and toxic in ``labels``. The columns of
    ``docs`` stay; those of the three new names, with their ``prefix``, are replaced.
    Null and empty texts get the score of a text without words. Without labels of both
    classes every score is 0.
    """
    model = trained(docs, labels, how)
    if model is None:
        score = F.lit(0.0)
    else:
        score = score_of(docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model)))("text")
    out = docs.withColumn(f"{prefix}held_out", held_out(F.col("doc_id"))).withColumn(f"{prefix}score", score)
    return out.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= THRESHOLD).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, how: Network | None = None) -> DataFrame:
    """The documents that are not predicted to be toxic, with their own columns."""
    return scored(docs, labels, how, prefix="__").filter("__predicted = 0").select(*docs.columns)
