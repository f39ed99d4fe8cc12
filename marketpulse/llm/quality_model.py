"""Quality classifier: random-indexing word vectors and a two-layer network.

Each token has a sparse random index vector, drawn from its hash. A token's word vector is
the sum of the index vectors of its neighbours in the training sample, at unit length, plus
its own index vector. A document is the mean of its tokens' vectors and of its distinct
tokens' vectors, with its length and the share of distinct tokens. A network with one hidden
layer scores it; a temperature fitted on rows the network has not seen calibrates the score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import labelled
from marketpulse.llm.common import crc_mod, id_like, map_rows, texts

_TOKEN = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_")


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that the model is fitted on."""

    max_rows: int = 8000
    buckets: int = 1 << 14
    width: int = 64
    ones: int = 4
    reach: int = 2
    hidden: int = 32
    epochs: int = 60
    rate: float = 3e-3
    decay: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    settings: Settings
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float


class Tokens:
    """Bucket numbers of a text's tokens; words in capitals share one token."""

    def __init__(self, settings: Settings, remember: int = 250_000):
        self.buckets, self.remember = settings.buckets, remember
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for token in _TOKEN.findall(text):
            bucket = known.get(token)
            if bucket is None:
                if len(known) >= self.remember:
                    known.clear()
                shape = "<capitals>" if len(token) > 1 and token.isupper() else token.lower()
                bucket = known[token] = zlib.crc32(shape.encode("utf-8")) % self.buckets
            out.append(bucket)
        return np.array(out, dtype=np.int64)


def index_vectors(s: Settings) -> np.ndarray:
    """A sparse row of +1 and -1 for each bucket."""
    rng = np.random.default_rng(s.seed)
    out = np.zeros((s.buckets, s.width), np.float32)
    rows = np.repeat(np.arange(s.buckets), s.ones)
    places = np.argsort(rng.random((s.buckets, s.width)), axis=1)[:, : s.ones].ravel()
    out[rows, places] = rng.choice(np.array([-1, 1], np.float32), len(rows))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def word_vectors(sample: DataFrame, s: Settings) -> np.ndarray:
    index = index_vectors(s)
    tokens = Tokens(s)

    def add(total, row):
        codes = tokens(row[0])
        for gap in range(1, s.reach + 1):
            if len(codes) > gap:
                np.add.at(total, codes[gap:], index[codes[:-gap]])
                np.add.at(total, codes[:-gap], index[codes[gap:]])

    context = labelled.matrix_sum(sample.select("text"), add, index.shape)
    return (_unit(context) + _unit(index)).astype(np.float32)


def pooled(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean over tokens, mean over distinct tokens, log length, share of distinct tokens."""
    if not len(codes):
        return np.zeros(2 * vectors.shape[1] + 2, np.float32)
    counts = np.bincount(codes, minlength=0)
    seen = np.flatnonzero(counts)
    own = vectors[seen]
    weight = counts[seen].astype(np.float32)
    return np.concatenate(
        [
            weight @ own / len(codes),
            own.mean(axis=0),
            [np.log1p(len(codes)) / 10, len(seen) / len(codes)],
        ]
    ).astype(np.float32)


def forward(layers, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2


def train(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Adam on the weighted log loss; both classes weigh the same in sum."""
    rng = np.random.default_rng(s.seed)
    layers = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden),
        rng.normal(0, np.sqrt(1 / s.hidden), s.hidden), np.zeros(()),
    ]
    first, second = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            pick = order[at : at + 128]
            hidden, z = forward(layers, x[pick])
            dz = (labelled.sigmoid(z) - y[pick]) * weight[pick] / len(pick)
            dh = np.outer(dz, layers[2]) * (hidden > 0)
            grads = [x[pick].T @ dh, dh.sum(0), hidden.T @ dz, dz.sum()]
            step += 1
            for k, g in enumerate(grads):
                g = g + s.decay * layers[k] * (k in (0, 2))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                layers[k] = layers[k] - s.rate * m / (np.sqrt(v) + 1e-8)
    return tuple(layers)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that training has not seen."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))

    def loss(t):
        p = np.clip(labelled.sigmoid(z / t), 1e-6, 1 - 1e-6)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    return float(min(grid, key=loss))


def fit(sample: DataFrame, s: Settings | None = None) -> Model | None:
    """A model from rows (doc_id, text, label); none if they lack one of the two labels."""
    s = s or Settings()
    vectors = word_vectors(sample, s)
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def make():
        tokens = Tokens(s)
        return lambda key, text, y: (key, y, pooled(tokens(text), shared.value).tobytes())

    keyed = sample.select(F.xxhash64("doc_id", "label", "text").alias("key"), "text", "label")
    rows = map_rows(keyed, make, "key long, label int, x binary").collect()
    rows = sorted(((r.key, r.label, bytes(r.x)) for r in rows))
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r[2], np.float32) for r in rows]).astype(float)
    unseen = np.arange(len(y)) % 5 == 4
    center, scale = x[~unseen].mean(0), x[~unseen].std(0) + 1e-3
    x = np.clip((x - center) / scale, -8, 8)
    layers = train(x[~unseen], y[~unseen], s)
    t = temperature(forward(layers, x[unseen])[1], y[unseen])
    return Model(s, vectors, center, scale, layers, t)


def score_texts(df: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, score, predicted) per row; empty texts are scored as a zero vector.

    Without a model, as no labels were to be learned from, every score is one half.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        if m is None:
            return lambda doc_id, text: (doc_id, 0.5, 1)
        tokens = Tokens(m.settings)

        def row(doc_id, text):
            x = (pooled(tokens(text), m.vectors) - m.center) / m.scale
            z = float(forward(m.layers, np.clip(x, -8, 8))[1])
            p = float(labelled.sigmoid(z / m.temperature))
            return doc_id, p, int(p >= 0.5)

        return row

    source = texts(df, id_col, text_col)
    return map_rows(source, make, f"doc_id {id_like(source)}, score double, predicted int")


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 3,
    held_out: int = 1,
    settings: Settings | None = None,
) -> DataFrame:
    """Fit on labelled rows outside the held-out fold and score every row of ``docs``.

    Every row gives one row, repeated ids too. A row without an id is in no fold.
    """
    s = settings or Settings()
    rows = labelled.sample(docs, labels, label, modulus, held_out, s.max_rows)
    scored = score_texts(docs, fit(rows, s))
    fold = F.coalesce(crc_mod("doc_id", modulus) == held_out, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", "predicted")
