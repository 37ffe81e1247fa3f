"""Toxic spans and document scores by a linear-chain conditional random field.

Labels come per document. A bounded sample of labelled documents gives labelled tokens:
a token is toxic if its document is and its word or a prefix of it occurs in toxic
documents so much more often that chance cannot explain it. On segments of these
documents a two-state chain is fitted, with weights for hashed features of the word
and for the transitions. Every document is then scored whole: forward-backward gives
each token's marginal, the marginals give the document's score and its toxic spans.

Fitting takes the bounded sample only (``Bounds``); scoring is a map over all rows
without a shuffle, and the model that goes to the tasks has a fixed size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, id_series, map_documents
from .common import documents, query, text_of

TOKEN = re.compile(r"[^\W\d_]+")
DIMS = 1 << 18
FEATURES = 5
SEGMENT = 32
BLOCK = 64
CACHED_WORDS = 500_000


@dataclass(frozen=True)
class Bounds:
    """What is fitted on: rows by class, in a fixed order by hash; longer texts are left
    out of the sample (not of the scores); segments of labelled tokens."""

    toxic_rows: int = 1500
    clean_rows: int = 4500
    text_bytes: int = 20_000
    segments: int = 8_000
    steps: int = 30


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, prefixes, ending and a bias."""
    parts = "w" + word, "4" + word[:4], "5" + word[:5], "e" + word[-3:]
    return [0, *[1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (DIMS - 1) for p in parts]]


@dataclass
class Model:
    weights: np.ndarray  # of the features, for the toxic state against the other
    transitions: np.ndarray  # log potentials, from row to column
    start: np.ndarray
    document: np.ndarray  # logistic weights: bias, highest marginal's logit, log of their sum

    def scorer(self) -> Scorer:
        return Scorer(self)


def chain(emission: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Marginals of the toxic state for the tokens of several documents, one after another.

    A document's first matrix has equal rows, so the chain forgets what came before and
    all documents are one chain. Products run along blocks side by side, then the
    blocks are chained.
    """
    n = len(emission)
    blocks = -(-n // BLOCK)
    lift = np.zeros(blocks * BLOCK)
    lift[:n] = np.exp(np.clip(emission, -30, 30))
    move = np.exp(model.transitions)
    first = np.exp(model.start)
    m = np.empty((2, 2, blocks * BLOCK))
    m[:, 0] = move[:, 0, None]
    m[:, 1] = move[:, 1, None] * lift
    m[:, 0, starts] = first[0]
    m[:, 1, starts] = first[1] * lift[starts]
    m[:, :, n:] = np.eye(2)[:, :, None]
    m = np.ascontiguousarray(m.reshape(2, 2, blocks, BLOCK).transpose(3, 0, 1, 2))

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.einsum("ijb,jkb->ikb", a, b)
        return out / out.sum(axis=(0, 1))

    ahead, behind = np.empty_like(m), np.empty_like(m)
    ahead[0] = m[0] / m[0].sum(axis=(0, 1))
    for k in range(1, BLOCK):
        ahead[k] = product(ahead[k - 1], m[k])
    behind[BLOCK - 1] = np.eye(2)[:, :, None]
    for k in range(BLOCK - 2, -1, -1):
        behind[k] = product(m[k + 1], behind[k + 1])
    left, right = np.empty((2, blocks)), np.empty((2, blocks))
    x = np.array([0.5, 0.5])
    for b in range(blocks):
        left[:, b] = x
        x = x @ ahead[BLOCK - 1, :, :, b]
        x = x / x.sum()
    y = np.array([0.5, 0.5])
    whole = [product(m[0, :, :, b : b + 1], behind[0, :, :, b : b + 1])[:, :, 0] for b in range(blocks)]
    for b in range(blocks - 1, -1, -1):
        right[:, b] = y
        y = whole[b] @ y
        y = y / y.sum()
    alpha = np.einsum("ib,kijb->kjb", left, ahead)
    beta = np.einsum("kijb,jb->kib", behind, right)
    both = alpha * beta
    return (both[:, 1] / both.sum(axis=1)).T.reshape(-1)[:n]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def emission(self, word: str) -> float:
        weights = self.model.weights
        return float(sum(weights[f] for f in features(word.lower())))

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text's tokens."""
        split = [TOKEN.findall(t) for t in texts]
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in {w for words in split for w in words if w not in known}:
            known[word] = self.emission(word)
        lengths = np.array([len(words) for words in split])
        n = int(lengths.sum())
        if not n:
            return [np.empty(0) for _ in split]
        emission = np.fromiter((known[w] for words in split for w in words), float, n)
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[lengths > 0]
        return np.split(chain(emission, starts, self.model), ends[:-1])

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-aggregates(marginals) @ self.model.document))


def aggregates(marginals: list[np.ndarray]) -> np.ndarray:
    """Of each document: 1, the highest marginal as a logit, the logarithm of their sum."""
    out = np.zeros((len(marginals), 3))
    for i, m in enumerate(marginals):
        top = min(max(m.max(initial=0.0), 1e-6), 1 - 1e-6)
        out[i] = 1, math.log(top / (1 - top)), math.log(m.sum() + 1e-3)
    return out


def spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Character offsets of runs of toxic tokens, with the highest marginal of each."""
    out: list[dict] = []
    if not len(marginals) or marginals.max() < least:
        return out
    before = False
    for token, m in zip(TOKEN.finditer(text), marginals):
        toxic = bool(m >= least)
        if toxic and before:
            out[-1] |= {"end": token.end(), "marginal": max(out[-1]["marginal"], float(m))}
        elif toxic:
            out.append({"start": token.start(), "end": token.end(), "marginal": float(m)})
        before = toxic
    return out


# --- Fitting ---------------------------------------------------------------


def clues(split: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Words (w...) and prefixes (4..., 5...) that toxic documents have beyond chance.

    With n documents of which k are toxic, n * KL(k / n, share of toxic ones) bounds the
    logarithm of the odds against chance; it must exceed that of the number of features.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(split, toxic):
        counts[int(label)].update({kind + part for w in set(words) for kind, part in _parts(w)})
    share = toxic.mean()
    least = math.log(max(2, len(counts[0].keys() | counts[1].keys())))
    out = set()
    for feature, k in counts[1].items():
        n = k + counts[0][feature]
        p = k / n
        if p < 0.8:
            continue
        odds = n * (p * math.log(p / share) + (1 - p) * math.log((1 - p) / (1 - share) if p < 1 else 1.0))
        if odds > least:
            out.add(feature)
    return out


def _parts(word: str) -> list[tuple[str, str]]:
    return [("w", word), *[(str(k), word[:k]) for k in (4, 5) if len(word) > k]]


def label_tokens(words: list[str], toxic: bool, found: set[str]) -> np.ndarray:
    return np.array([toxic and any(kind + part in found for kind, part in _parts(w)) for w in words], float)


def fit(texts: list[str], labels: list[int], bounds: Bounds = Bounds()) -> Model:
    """The model of a sample; without both classes, one that gives every document the
    share of toxic ones (0 without rows)."""
    toxic = np.array(labels, float)
    share = float(toxic.mean()) if len(toxic) else 0.0
    model = Model(np.zeros(DIMS, np.float32), np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    if share in (0.0, 1.0):
        model.document[0] = 30.0 if share else -30.0
        return model
    split = [[w.lower() for w in TOKEN.findall(t)] for t in texts]
    found = clues(split, toxic)
    known: dict[str, list[int]] = {}
    segments = []
    for words, label in zip(split, toxic):
        marks = label_tokens(words, bool(label), found)
        if label and not marks.any():
            continue  # what makes it toxic is unknown
        for at in range(0, len(words), SEGMENT):
            segments.append((words[at : at + SEGMENT], marks[at : at + SEGMENT]))
    # All segments with a toxic token come first, the rest in a fixed order.
    segments.sort(key=lambda s: (not s[1].any(), zlib.crc32(" ".join(s[0]).encode("utf-8", "surrogatepass"))))
    segments = segments[: bounds.segments]
    if segments:
        size = max(len(words) for words, _ in segments)
        ids = np.zeros((len(segments), size, FEATURES), np.int32)
        marks = np.zeros((len(segments), size))
        lengths = np.array([len(words) for words, _ in segments])
        for i, (words, m) in enumerate(segments):
            for j, w in enumerate(words):
                if w not in known:
                    known[w] = features(w)
                ids[i, j] = known[w]
            marks[i, : len(m)] = m
        _climb(model, ids, marks, lengths, bounds.steps)
    scorer = Scorer(model)
    _calibrate(model, aggregates([m for t in texts for m in scorer.marginals([t])]), toxic)
    return model


def _climb(model: Model, ids: np.ndarray, marks: np.ndarray, lengths: np.ndarray, steps: int) -> None:
    """Gradient steps with a rate per weight on the conditional log-likelihood."""
    n, size, _ = ids.shape
    real = np.arange(size) < lengths[:, None]
    weights = np.zeros(DIMS)
    speeds = [np.full(DIMS, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    gold = marks.astype(int)
    pairs = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    began = np.bincount(gold[:, 0], minlength=2).astype(float)
    for _ in range(steps):
        emission = weights[ids].sum(axis=2)
        e = np.stack([np.zeros_like(emission), emission], axis=2)
        alpha, beta = np.empty((n, size, 2)), np.zeros((n, size, 2))
        alpha[:, 0] = model.start + e[:, 0]
        for t in range(1, size):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + model.transitions, axis=1) + e[:, t]
        for t in range(size - 2, -1, -1):
            step = np.logaddexp.reduce(model.transitions + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        last = alpha[np.arange(n), lengths - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        state = np.exp(alpha + beta - total[:, None, None])
        two = alpha[:, :-1, :, None] + model.transitions + (e[:, 1:] + beta[:, 1:])[:, :, None, :]
        expected = (np.exp(np.minimum(two - total[:, None, None, None], 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        off = np.where(real, state[:, :, 1] - marks, 0.0)
        slopes = [
            np.bincount(ids.ravel(), np.repeat(off.ravel(), FEATURES), DIMS) + 0.05 * weights,
            expected - seen + 0.05 * model.transitions,
            state[:, 0].sum(axis=0) - began + 0.05 * model.start,
        ]
        for value, slope, speed in zip((weights, model.transitions, model.start), slopes, speeds):
            speed += slope**2
            value -= 0.5 * slope / np.sqrt(speed)
    model.weights = weights.astype(np.float32)


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic regression of the documents' labels on their aggregates, by Newton's method."""
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.1 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w -= np.linalg.solve(curve, slope)
    model.document = w


# --- On Spark --------------------------------------------------------------


def held_out(doc_id):
    """Every fifth document by the checksum of its id; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, bounds: Bounds) -> tuple[list[str], list[int]]:
    """Texts and labels to fit on, none of a held-out document.

    Null labels and labels of unknown documents are ignored; of contradicting labels of
    a document the toxic one counts. Which rows a class gives is fixed by their hashes.
    """
    wanted = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = wanted.where(~held_out(F.col("doc_id")))
    short = docs.where(F.octet_length(text_of("text")) <= bounds.text_bytes).select("doc_id", text_of("text").alias("text"))
    rows = []
    for label, most in ((1, bounds.toxic_rows), (0, bounds.clean_rows)):
        picked = wanted.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows += short.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").take(most)
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, spans (start, end, marginal).

    Offsets count characters. A null or empty text, or one without letters, has no
    spans and the score of no evidence. Repeated rows stay repeated; an empty table
    gives an empty result.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for doc_ids, texts in chunks(frames):
            marginals = scorer.marginals(texts)
            yield pd.DataFrame(
                {
                    "doc_id": id_series(doc_ids),
                    "score": scorer.scores(marginals),
                    "spans": [spans(t, m) for t, m in zip(texts, marginals)],
                }
            )

    schema = "doc_id long, score double, spans array<struct<start: int, end: int, marginal: double>>"
    return map_documents(docs, work, schema, id_col, text_col)


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(*sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Bounds()))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
