"""Toxic spans and document scores by a linear-chain conditional random field.

The field has two labels a token. A token's features are its word and the word's beginnings and end,
hashed into ``BUCKETS`` weights; a 2x2 matrix holds the transitions. Token labels for training come
from labelled documents: in a toxic training document the tokens are marked that carry a feature which
toxic training documents have far more often than clean ones. Training takes a bounded sample
(``per_class`` documents of at most ``most_chars`` characters a class, near copies once; clean ones
twice as many); scoring takes every whole text.

Forward and backward passes run over columns of segments: long texts are cut into ``SEGMENT`` tokens,
a first pass multiplies each segment's 2x2 matrices, boundaries are chained, and a second pass fills
the marginals in, so the marginals are exact for a text of any length. A document's score is a logistic
function of its largest marginal and of the expected number of toxic tokens, fitted on the sample.

Defined results: null and empty texts score as a document without tokens; without labelled documents
of both classes the score is the share of toxic ones (0 without any); rows whose label is not 0 or 1
teach nothing; repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD, crc_mod, given_back, slices

BUCKETS = 1 << 18
SEGMENT = 256
KEEP = 200_000
WORDS_A_STEP = 200_000
PER_CLASS = 1500
MOST_CHARS = 8000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.FloatType())]))
ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[int]:
    """Hashed features of a word: itself without punctuation, its beginnings and its end."""
    core = ENDS.sub("", word.lower()) or word
    names = ["w" + core, "e" + core[-3:]] + [f"{n}{core[:n]}" for n in (3, 4, 5, 6, 8) if len(core) > n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def marginals(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """P(label 1) of each token of the texts that ``score`` holds one after another; ``lengths`` of 0 are allowed.

    ``trans[i, j]`` is the factor from label i to j, ``start`` the factor of label 1 at a text's first token.
    """
    out = np.zeros(len(score))
    parts = -(-lengths // SEGMENT)
    if not parts.sum():
        return out
    doc = np.repeat(np.arange(len(lengths)), parts)
    firsts = np.cumsum(parts) - parts
    part = np.arange(len(doc)) - firsts[doc]
    begin = (np.cumsum(lengths) - lengths)[doc] + part * SEGMENT
    size = np.minimum(lengths[doc] - part * SEGMENT, SEGMENT)
    width = int(size.max())
    inside = np.arange(width)[:, None] < size
    at = np.where(inside, begin + np.arange(width)[:, None], 0)
    w = np.where(inside, np.exp(np.clip(score[at], -30, 30)), 1.0)
    n = len(doc)
    head = np.ones(n)  # odds of label 1 before a segment's first transition
    tail = np.ones(n)
    t00, t01, t10, t11 = trans[0, 0], trans[0, 1], trans[1, 0], trans[1, 1]
    if parts.max() > 1:
        long = np.flatnonzero(parts[doc] > 1)
        m = np.tile(np.eye(2)[:, :, None], (1, 1, len(long)))
        for t in range(width):  # the product of the segment's factors, whole segments only
            x = w[t, long]
            a0 = m[:, 0] * t00 + m[:, 1] * t10
            a1 = (m[:, 0] * t01 + m[:, 1] * t11) * x
            live = inside[t, long]
            total = a0.sum(0) + a1.sum(0)
            m[:, 0] = np.where(live, a0 / total, m[:, 0])
            m[:, 1] = np.where(live, a1 / total, m[:, 1])
        place = np.full(n, -1)
        place[long] = np.arange(len(long))
        for k in range(1, int(parts.max())):
            i = np.flatnonzero(part == k)
            j = place[i - 1]
            if k == 1:  # the first token has no transition: undo it with the start factor
                v0, v1 = first_vector(start, t00, t01, t10, t11, n=len(i))
            else:
                v0, v1 = np.ones(len(i)), head[i - 1]
            a0, a1 = v0 * m[0, 0, j] + v1 * m[1, 0, j], v0 * m[0, 1, j] + v1 * m[1, 1, j]
            head[i] = np.clip(a1 / np.maximum(a0, 1e-300), 1e-300, 1e300)
        for k in range(int(parts.max()) - 2, -1, -1):
            i = np.flatnonzero((part == k) & (parts[doc] > k + 1))
            j = place[i + 1]
            b0, b1 = m[0, 0, j] + m[0, 1, j] * tail[i + 1], m[1, 0, j] + m[1, 1, j] * tail[i + 1]
            tail[i] = np.clip(b1 / np.maximum(b0, 1e-300), 1e-300, 1e300)
    a = np.empty((width, n))
    p = head / (1 + head)
    for t in range(width):
        if t == 0:
            first = part == 0
            one = np.where(first, start, t01 * (1 - p) + t11 * p) * w[0]
            two = np.where(first, 1.0, t00 * (1 - p) + t10 * p)
        else:
            one, two = (t01 * (1 - p) + t11 * p) * w[t], t00 * (1 - p) + t10 * p
        p = one / (one + two)
        a[t] = p
    b = tail.copy()
    for t in range(width - 1, -1, -1):
        live = inside[t]
        q = a[t] * b
        a[t] = np.where(live, q / (q + 1 - a[t]), 0)
        x = w[t] * b
        b = np.where(live, (t10 + t11 * x) / (t00 + t01 * x), b)
    out[at[inside]] = a[inside]
    return out


def first_vector(start, t00, t01, t10, t11, n):
    """A vector v with v @ trans proportional to (1, start): what stands before a text's first token."""
    det = t00 * t11 - t01 * t10
    return np.full(n, (t11 - start * t10) / det), np.full(n, (start * t00 - t01) / det)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    start: float
    fit: tuple[float, float, float]
    share: float | None = None  # set where nothing could be learned

    def word_score(self, word: bytes) -> float:
        return float(self.weights[features(word.decode("utf-8", "replace"))].sum())

    def score_batch(self, words: list[list[bytes]], cache: dict):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        for w in set(flat).difference(cache):
            cache[w] = self.word_score(w)
        p = marginals(np.fromiter(map(cache.__getitem__, flat), np.float64, len(flat)), lengths, self.trans, self.start)
        return lengths, p, doc_scores(p, lengths, self.fit)


def doc_stats(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    top, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        begins = (ends - lengths)[full]
        top[full] = np.maximum.reduceat(p, begins)
        total[full] = np.add.reduceat(p, begins)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log(total + 1e-3), np.ones(len(lengths))])


def doc_scores(p, lengths, fit) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.array(fit) @ doc_stats(p, lengths), -30, 30)))


def train(rows: Iterable[tuple[str, int]], *, rounds: int = 60, least: int = 6, odds: float = 20.0, l2: float = 1e-4) -> Model:
    """Learns from (text, label) rows; near copies (equal least shingle hash) count once."""
    seen, ids, y, labels = set(), [], [], []
    vocabulary: dict[bytes, int] = {}
    for text, label in rows:
        labels.append(label)
        ws = tokens(text)
        sign = min((zlib.crc32(b" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))), default=0)
        if sign not in seen:
            seen.add(sign)
            ids.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int32, len(ws)))
            y.append(label)
    y = np.array(y, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), np.ones((2, 2)), 1.0, (0.0, 0.0, 0.0), float(np.mean(labels)) if labels else 0.0)
    packed, many = array("q"), np.zeros(len(vocabulary), np.int64)
    for k, w in enumerate(vocabulary):
        own = features(w.decode("utf-8", "replace"))
        packed.extend(own)
        many[k] = len(own)
    flat, of, size = np.frombuffer(packed, np.int64), np.repeat(np.arange(len(vocabulary)), many), len(vocabulary)
    count = np.zeros((2, BUCKETS))
    start_of = np.cumsum(many) - many
    for d, label in zip(ids, y):
        u = np.unique(d)
        k = np.repeat(start_of[u], many[u]) + np.arange(many[u].sum()) - np.repeat(np.cumsum(many[u]) - many[u], many[u])
        count[int(label), np.unique(flat[k])] += 1
    ratio = ((count[1] + 0.5) / (y.sum() + 1)) / ((count[0] + 0.5) / (len(y) - y.sum() + 1))
    marked = np.zeros(size, bool)
    np.logical_or.at(marked, of, ((count[1] >= least) & (ratio >= odds))[flat])
    lengths = np.array([len(d) for d in ids], np.int64)
    word = np.concatenate(ids)
    gold = marked[word] & (np.repeat(y, lengths) == 1)
    weights, theta = np.zeros(BUCKETS), np.array([0.0, -3.0, 0.0, 1.0, -3.0])  # log factors 00, 01, 10, 11 and the start
    adam = [np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)]
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    is_first = np.zeros(len(word), bool)
    is_first[firsts] = True
    pair_gold = gold[:-1] * 2 + gold[1:]
    not_cross = ~is_first[1:]
    for r in range(rounds):
        emit = np.bincount(of, weights[flat], size)
        trans, start = np.exp(theta[:4].reshape(2, 2)), float(np.exp(theta[4]))
        p = marginals(emit[word], lengths, trans, start)
        by_word = np.bincount(word, p - gold, size)
        grad = np.bincount(flat, by_word[of], BUCKETS)
        # Expected transitions by the pairwise marginals that agree with neighbouring unary marginals.
        q0, q1 = p[:-1][not_cross], p[1:][not_cross]
        link = trans[1, 1] * trans[0, 0] / (trans[0, 1] * trans[1, 0])
        s = 1 + (q0 + q1) * (link - 1)
        both = np.where(abs(link - 1) < 1e-9, q0 * q1, (s - np.sqrt(np.maximum(0, s * s - 4 * link * (link - 1) * q0 * q1))) / (2 * (link - 1) + 1e-300))
        expected = np.array([(1 - q0 - q1 + both).sum(), (q1 - both).sum(), (q0 - both).sum(), both.sum()])
        grad_t = expected - np.bincount(pair_gold[not_cross], minlength=4)
        g = np.concatenate([grad, grad_t, [(p[firsts] - gold[firsts]).sum()]]) / max(1, len(word) // 128) + l2 * np.concatenate([weights, theta])
        adam[0] = 0.9 * adam[0] + 0.1 * g
        adam[1] = 0.99 * adam[1] + 0.01 * g * g
        step = 0.3 * (1 - r / rounds) * (adam[0] / (1 - 0.9 ** (r + 1))) / (np.sqrt(adam[1] / (1 - 0.99 ** (r + 1))) + 1e-8)
        step[np.concatenate([grad, np.ones(5)]) == 0] = 0
        weights -= step[:-5]
        theta -= 0.3 * step[-5:]
    trans, start = np.exp(theta[:4].reshape(2, 2)), float(np.exp(theta[4]))
    emit = np.bincount(of, weights[flat], size)
    x = doc_stats(marginals(emit[word], lengths, trans, start), lengths)
    fit = np.array([0.3, 0.1, 0.0])
    for _ in range(40):  # Newton steps of a logistic regression with a small penalty
        p = 1 / (1 + np.exp(-np.clip(fit @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + np.eye(3)
        fit = fit - np.linalg.solve(h, x @ (p - y) + fit)
    return Model(weights.astype(np.float32), trans, start, tuple(map(float, fit)))


def labelled(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, folds: int = 5, label: str = "toxic") -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labelled training rows: ids by the order of a hash, then their texts."""
    fold = labels.where((crc_mod(F.col("doc_id"), folds) != 0) & F.col("doc_id").isNotNull())
    few = None
    for value, n in ((1, per_class), (0, 2 * per_class)):
        ids = fold.where(F.col(label) == value).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("label", F.lit(value))
        few = ids if few is None else few.unionByName(ids)
    own = docs.select("doc_id", "text").where(F.length("text") <= most_chars)
    return own.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(sample: DataFrame) -> Model:
    """Trains in one task, as the sample is bounded; only the weights come to the driver."""

    def run(batches):
        rows = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)))), key=lambda r: (r[0], r[1]))
        m = train((t, y) for _, y, t in rows)
        head = np.array([*m.trans.ravel(), m.start, *m.fit, np.nan if m.share is None else m.share])
        yield pa.RecordBatch.from_arrays([pa.array([head.tobytes()], pa.binary()), pa.array([m.weights.astype(np.float32).tobytes()], pa.binary())], ["head", "weights"])

    got = sample.select("doc_id", "label", "text").repartition(1).mapInArrow(lambda batches: given_back(run(batches)), "head binary, weights binary").first()
    if got is None:  # no labelled rows
        return train([])
    head, weights = got
    x = np.frombuffer(head, np.float64)
    return Model(np.frombuffer(weights, np.float32), x[:4].reshape(2, 2), float(x[4]), tuple(map(float, x[5:8])), None if np.isnan(x[8]) else float(x[8]))


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` and ``toxic_spans`` (character offsets of words whose marginal is 0.5 or more)."""
    rest = [c for c in docs.columns if c not in ("toxicity", "toxic_spans")]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_spans", SPANS)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float32())]))
    pattern = re.compile(WORD)

    def spans(t: str, p: np.ndarray) -> list[dict]:
        hit = set(np.flatnonzero(p >= 0.5).tolist())
        return [{"start": m.start(), "end": m.end(), "p": float(p[i])} for i, m in enumerate(pattern.finditer(t)) if i in hit] if hit else []

    def run(batches):
        cache: dict = {}
        for b in slices(batches):
            texts = [x or "" for x in b.column(rest.index(text)).to_pylist()]
            i = 0
            while i < len(texts):
                words, n, j = [], 0, i
                while j < len(texts) and (j == i or n < WORDS_A_STEP):
                    words.append(tokens(texts[j]))
                    n += len(words[-1])
                    j += 1
                if model.share is not None:
                    got, found = np.full(j - i, model.share), [[] for _ in words]
                else:
                    if len(cache) > KEEP:
                        cache.clear()
                    lengths, p, got = model.score_batch(words, cache)
                    ends = np.cumsum(lengths)
                    found = [spans(t, p[e - m : e]) for t, m, e in zip(texts[i:j], lengths, ends)]
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(got, pa.float64()), pa.array(found, kind)], [*rest, "toxicity", "toxic_spans"])
                i = j

    return docs.select(*rest).mapInArrow(lambda batches: given_back(run(batches)), schema)
