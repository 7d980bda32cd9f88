"""Toxicity by compression distance (operator 8).

Two zstandard dictionaries are trained on labelled texts: one on ordinary text, one on toxic text. Toxic documents are
mostly ordinary prose, so the toxic dictionary holds the ordinary one's content and, nearest to the text to compress,
the stretches that toxic texts have in common and ordinary ones lack. A window of ``WINDOW`` words is compressed with
both; its gain is the number of bytes the toxic dictionary saves. Stretches are picked by ``GRAM``-byte pieces whose
document frequencies differ by a log-likelihood that chance does not reach over all pieces tried.

A document's features are its largest gain, its gains per window, their sum, and the largest gain of two neighbouring
words within windows that gain. A logistic curve fitted on labelled documents that the dictionaries have not seen
turns them into a score; its threshold, the best F1 there, is moved to 0.5.

The fit takes a bounded sample: ``TOXIC`` and ``ORDINARY`` labelled texts of up to ``TEXT_BYTES`` at most, those with
the smallest hash of doc_id. Everything else covers whole texts of all rows.

Defined results: null and empty texts get the score of a text without any gain; labels that are null, or whose doc_id
has no text, are ignored; without labels of both kinds all scores are the share of toxic labels, at most 0.49;
repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, PAIR = 12, 2
GRAM, GAIN = 5, 3
TOXIC, ORDINARY, TEXT_BYTES = 2500, 7500, 1 << 16
ORDINARY_BYTES, TOXIC_BYTES = 24_576, 4_096
LEVEL = 3
FOLDS = 5
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -35, 35)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def windows(text: str) -> list[list[bytes]]:
    words = WORD.findall((text or "").encode())
    return [words[i:i + WINDOW] for i in range(0, len(words), WINDOW)]


class Scorer:
    """The features of a text: largest gain, gains per window, log of their sum, largest gain of neighbouring words."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.other = _compressor(ordinary).compress, _compressor(toxic).compress

    def gain(self, words: list[bytes]) -> int:
        text = b" " + b" ".join(words) + b" "
        return len(self.plain(text)) - len(self.other(text))

    def features(self, text: str) -> tuple[float, float, float, float]:
        parts, largest, total, pair = windows(text), 0, 0, 0
        for words in parts:
            gain = self.gain(words)
            if gain >= GAIN:
                largest, total = max(largest, gain), total + gain
                pair = max(pair, *(self.gain(words[i:i + PAIR]) for i in range(len(words))))
        return largest, total / max(1, len(parts)), np.log1p(total), pair


def _grams(text: str) -> tuple[bytes, np.ndarray]:
    """A text with single blanks, and its GRAM-byte pieces as numbers."""
    data = b" " + b" ".join(WORD.findall(text.encode())) + b" "
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    count = max(0, len(values) - GRAM + 1)
    pieces = np.zeros(count, np.uint64)
    for k in range(GRAM):
        pieces = (pieces << np.uint64(8)) | values[k:k + count]
    return data, pieces


def toxic_stretches(toxic: list[str], ordinary: list[str]) -> Counter:
    """Stretches of the toxic texts made of pieces that are far more frequent there, and how often they occur."""
    def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(_grams(t)[1]) for t in texts]), return_counts=True)

    (pieces, n), (other, m) = frequencies(toxic), frequencies(ordinary)
    at = np.minimum(np.searchsorted(other, pieces), max(0, len(other) - 1))
    m = np.where(other[at] == pieces, m[at], 0) if len(other) else np.zeros(len(pieces))
    share = len(toxic) / (len(toxic) + len(ordinary))
    likelihood = n * np.log(n / ((n + m) * share)) + np.where(m > 0, m * np.log(np.maximum(m, 1) / ((n + m) * (1 - share))), 0)
    margin = 2 + 10 * min(1.0, len(toxic) / 1000)  # what is telling clears any margin once there are texts enough
    telling = pieces[(likelihood > np.log(max(1, len(pieces))) + margin) & (n / len(toxic) > 8 * m / len(ordinary))]
    found: Counter = Counter()
    for text in toxic:
        data, own = _grams(text)
        hit = np.concatenate(([0], np.isin(own, telling).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(hit))
        found.update(data[a:b + GRAM - 1] for a, b in zip(edges[::2], edges[1::2]))
    return found


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The content of the ordinary and of the toxic dictionary."""
    samples = [b" " + b" ".join(w) + b" " for t in ordinary for w in windows(t)]
    base = b"".join(samples)[-ORDINARY_BYTES:]
    if len(samples) >= 1000:  # zstandard wants many more samples than it keeps
        base = zstandard.train_dictionary(ORDINARY_BYTES, samples, k=64, d=6, split_point=1.0).as_bytes()[-ORDINARY_BYTES + 2048:]
    # frequent stretches first; one whose pieces are for the greater part there already would only take room
    extra, there = b"", set()
    for stretch, n in toxic_stretches(toxic, ordinary).most_common():
        own = {stretch[i:i + GRAM] for i in range(len(stretch) - GRAM + 1)}
        if n >= max(3, len(toxic) / 300) and 2 * len(own - there) > len(own) and len(extra) + len(stretch) <= TOXIC_BYTES:
            extra, there = stretch + extra, there | own
    return base, base + extra


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton steps on the weighted, slightly ridged likelihood."""
    x = np.hstack((x, np.ones((len(x), 1))))
    beta, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model from the labelled rows outside the held-out fold; without both kinds, the share of toxic labels."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = {}
    for kind, most in ((1, TOXIC), (0, ORDINARY)):
        ids = known.filter(F.col("toxic") == kind).orderBy(*order).limit(most).select("doc_id")
        texts = docs.filter(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(ids), "doc_id").orderBy(*order, "text").limit(most)
        drawn[kind] = [r["text"] for r in texts.select("text").collect()]
    if min(len(drawn[0]), len(drawn[1])) < 3:
        return min(0.49, counts.get(1, 0) / max(1, sum(counts.values())))
    # two of three texts make the dictionaries, the third the curve
    seen, unseen = ({k: [t for i, t in enumerate(v) if (i % 3 == 2) == last] for k, v in drawn.items()} for last in (False, True))
    ordinary, toxic = dictionaries(seen[1], seen[0])
    scorer = Scorer(ordinary, toxic)
    x = np.array([scorer.features(t) for k in (0, 1) for t in unseen[k]], dtype=float)
    y = np.repeat([0.0, 1.0], [len(unseen[0]), len(unseen[1])])
    weight = np.where(y == 1, counts[1] / len(unseen[1]), counts[0] / len(unseen[0]))
    weight *= len(y) / weight.sum()
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model = Model(ordinary, toxic, center, scale, _logistic((x - center) / scale, y, weight))
    score = model.scores(x)
    cuts = np.unique(score)
    hits = np.array([(weight * y)[score >= c].sum() for c in cuts])
    picked = np.array([weight[score >= c].sum() for c in cuts])
    best = int(np.argmax(2 * hits / (picked + (weight * y).sum())))
    middle = (cuts[best] + (cuts[best - 1] if best else 0.0)) / 2
    model.weights[-1] -= np.log(middle / (1 - middle))
    return model


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    if not isinstance(model, Model):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.ordinary, model.toxic)
        for batch in batches:
            found = np.array([scorer.features(t) for t in batch["text"]], dtype=float).reshape(-1, 4)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.scores(found)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
