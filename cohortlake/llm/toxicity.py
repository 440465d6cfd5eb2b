"""Toxic spans and scores from a linear-chain conditional random field.

Documents carry one label, tokens none. Token labels are made from the training
texts: a word is marked toxic in a toxic document if its odds there against
clean documents are high enough, all else is clean. The field has two states
(clean, toxic) and features of the word, its neighbours and its shape; it is
fitted by gradient steps on the exact likelihood, all sequences at once.

Forward-backward marginals are computed for a batch of documents as one chain
with a restart at each document. The chain is cut into equal blocks that
advance together: 2 x 2 transfer matrices first, block ends next, then the
marginals; the cost is linear in tokens.

A document's score is the logistic of its marginals' noisy-or, fitted on the
same rows; spans are runs of tokens with a marginal of one half or more.

Defined results: a null or empty text has no tokens and gets the score of no
evidence; null labels are not learnt from; no training rows of both labels give
the share of toxic rows (0.5 without any) as every score; repeated rows are
scored each; texts of any length are scored whole; an empty table gives an empty
result; other columns are ignored, whatever their names. Spans count characters
of the text as it is given, though words are compared in lower case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .shared import ddl

MAX_ROWS, MAX_CHARS = 2500, 12_000_000  # of the training sample, together
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_EPS = 1e-300


def tokenize(text: str) -> list[str]:
    """The tokens in lower case. Each match is lowered, not the text, so places are those of the text."""
    return [t.lower() for t in _TOKEN.findall(text)]


@dataclass(frozen=True)
class Model:
    """Weights of both states for each word (row 0: any other), its neighbours, and the transitions."""

    vocabulary: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray
    first: np.ndarray
    slope: float
    bias: float

    def emissions(self, word: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log potentials (token, state)."""
        e = self.own[word].copy()
        prev, nxt = np.roll(word, 1), np.roll(word, -1)
        e += np.where(begins[:, None], 0.0, self.before[prev])
        e += np.where(np.roll(begins, -1)[:, None], 0.0, self.after[nxt])
        e[begins] += self.first
        return e


def _normed(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(m.sum(axis=(-2, -1), keepdims=True), _EPS)


def marginals(emissions: np.ndarray, move: np.ndarray, begins: np.ndarray, moves: bool = False):
    """P(toxic) of each token of chains that begin where ``begins`` says; with ``moves`` also the expected transitions."""
    n = len(emissions)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if moves else np.zeros(0)
    blocks = min(4096, max(16, n // 192))
    size = -(-n // blocks)
    total = size * blocks
    weight = np.ones((total, 2))
    weight[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    starts = np.ones(total, bool)
    starts[:n] = begins
    a = np.exp(move - move.max())
    # the transfer into a token: transitions, or a restart that forgets the past
    step = np.where(starts[:, None, None], 1.0, a[None]) * weight[:, None, :]
    step = step.reshape(blocks, size, 2, 2)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for i in range(size):
        b = step[:, i]
        whole = _normed(whole[:, :, :1] * b[:, :1] + whole[:, :, 1:] * b[:, 1:])
    forward = np.empty((blocks, 2))
    alpha = np.ones(2) / 2
    for b in range(blocks):
        forward[b] = alpha
        alpha = alpha @ whole[b]
        alpha = alpha / max(alpha.sum(), _EPS)
    backward = np.empty((blocks, 2))
    beta = np.ones(2) / 2
    for b in range(blocks - 1, -1, -1):
        backward[b] = beta
        beta = whole[b] @ beta
        beta = beta / max(beta.sum(), _EPS)
    entry = forward.copy()
    ahead = np.empty((size, blocks, 2))
    for i in range(size):
        forward = forward[:, :1] * step[:, i, 0] + forward[:, 1:] * step[:, i, 1]
        forward /= np.maximum(forward.sum(axis=1, keepdims=True), _EPS)
        ahead[i] = forward
    out, expected = np.empty((blocks, size)), np.zeros((2, 2))
    inside = (~starts & (np.arange(total) < n)).reshape(blocks, size)
    for i in range(size - 1, -1, -1):
        if moves:
            joint = (ahead[i - 1] if i else entry)[:, :, None] * step[:, i] * backward[:, None, :]
            joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), _EPS)
            expected += joint[inside[:, i]].sum(axis=0)
        both = ahead[i] * backward
        out[:, i] = both[:, 1] / np.maximum(both.sum(axis=1), _EPS)
        backward = step[:, i, :, 0] * backward[:, :1] + step[:, i, :, 1] * backward[:, 1:]
        backward /= np.maximum(backward.sum(axis=1, keepdims=True), _EPS)
    return (out.ravel()[:n], expected) if moves else out.ravel()[:n]


def doc_evidence(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """-log of the chance that no token is toxic, capped, by document."""
    miss = -np.log1p(-np.minimum(p, 1 - 1e-9))
    return np.minimum(np.bincount(doc, weights=np.where(p > 0.05, miss, 0.0), minlength=n), 30.0)


def _features(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, document and begin flag of every token."""
    get, rows, size = vocabulary.get, [], []
    for t in texts:
        tokens = tokenize(t)
        size.append(len(tokens))
        rows.append(np.fromiter(map(get, tokens, _ZEROS), np.int64, len(tokens)))
    doc = np.repeat(np.arange(len(texts)), size)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), doc, np.diff(doc, prepend=-1) > 0


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def fit(texts: list[str], toxic: np.ndarray, odds: float = 20.0, least: int = 5, most_words: int = 50_000, steps: int = 15, rate: float = 0.5) -> Model:
    """Fit on labelled texts; deterministic."""
    toxic = np.asarray(toxic, bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for t, y in zip(texts, toxic, strict=True):
        seen[int(y)].update(set(tokenize(t)))
    share = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.5
    prior = float(np.log(share / (1 - share)))
    zero = np.zeros((1, 2))
    if not n1 or not n0:
        return Model({}, zero, zero, zero, np.zeros((2, 2)), np.zeros(2), 0.0, prior)
    common = (seen[0] + seen[1]).most_common(most_words)
    vocabulary = {w: i + 1 for i, (w, c) in enumerate(sorted(common, key=lambda x: (-x[1], x[0]))) if c >= least}
    ratio = np.zeros(len(vocabulary) + 1)
    for w, i in vocabulary.items():
        ratio[i] = ((seen[1][w] + 0.5) / (n1 + 1)) / ((seen[0][w] + 0.5) / (n0 + 1))
    word, doc, begins = _features(texts, vocabulary)
    marked = toxic[doc] & (ratio[word] >= odds)
    gold = marked.astype(np.int64)
    v = len(vocabulary) + 1
    own, before, after, move, first = np.zeros((v, 2)), np.zeros((v, 2)), np.zeros((v, 2)), np.zeros((2, 2)), np.zeros(2)
    squares = [np.full_like(x, 1e-2) for x in (own, before, after, move, first)]
    prev, nxt, ends = np.roll(word, 1), np.roll(word, -1), np.roll(begins, -1)
    target = np.stack([1 - gold, gold], axis=1).astype(float)
    goal_move = np.zeros((2, 2))
    np.add.at(goal_move, (gold[:-1][~begins[1:]], gold[1:][~begins[1:]]), 1)
    for _ in range(steps if len(word) else 0):
        model = Model(vocabulary, own, before, after, move, first, 1.0, 0.0)
        e = model.emissions(word, begins)
        p, expected = marginals(e, move, begins, moves=True)
        gap = target - np.stack([1 - p, p], axis=1)
        by = lambda of, keep: np.stack([np.bincount(of[keep], weights=gap[keep, s], minlength=v) for s in (0, 1)], axis=1)
        every = np.ones(len(word), bool)
        grads = [by(word, every) - 1e-2 * own, by(prev, ~begins) - 1e-1 * before, by(nxt, ~ends) - 1e-1 * after, goal_move - expected - 1e-2 * move, gap[begins].sum(axis=0) - 1e-2 * first]
        for x, g, s in zip((own, before, after, move, first), grads, squares, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    model = Model(vocabulary, own, before, after, move, first, 1.0, 0.0)
    p = marginals(model.emissions(word, begins), move, begins)
    x, y = doc_evidence(p, doc, len(texts)), toxic.astype(float)
    slope, bias = 1.0, prior
    for _ in range(200):  # Newton steps of a logistic line with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
        w = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((y - q) * x).sum() - 1e-2 * slope, (y - q).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move_by = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, bias = slope + move_by[0], bias + move_by[1]
        if np.abs(move_by).max() < 1e-8:
            break
    return Model(vocabulary, own, before, after, move, first, float(slope), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[list[str], np.ndarray]:
    """A bounded sample of the labelled texts, whole, in order of a hash of the id.

    Of the documents that ``labels`` covers the first ``max_rows``, and of these
    all that fit into ``max_chars`` characters together, so a text stays out by
    its length only if it alone would take up what the others leave. Of several
    labels of an id the larger counts.
    """
    marked = labels.filter(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("size")).join(marked, "doc_id")
    taken, room = [], max_chars
    for r in rows.orderBy(*order).limit(max_rows).collect():
        if (r["size"] or 0) <= room:
            taken.append((r.doc_id, r.h, r.toxic))
            room -= r["size"] or 0
    if not taken:
        return [], np.zeros(0, bool)
    chosen = docs.sparkSession.createDataFrame(taken, rows.select("doc_id", "h", "toxic").schema).distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["doc_id", "h"])
    pdf = texts.orderBy(*order).limit(max_rows).select("text", "toxic").toPandas()
    return pdf["text"].fillna("").tolist(), pdf["toxic"].to_numpy() > 0


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_columns: Iterable[str] = ()) -> DataFrame:
    """Per row: doc_id, score, spans (start, stop in characters, probability)[, extra]."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep_columns = list(keep_columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        exchange.drop_tables()
        m = shared.value
        for table in exchange.pieces(batches):
            texts = [t or "" for t in table.column("text").to_pylist()]
            word, doc, begins = _features(texts, m.vocabulary)
            p = marginals(m.emissions(word, begins), m.move, begins)
            z = m.slope * doc_evidence(p, doc, len(texts)) + m.bias
            score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            spans: list[list[dict]] = [[] for _ in texts]
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            for d in np.unique(doc[p >= 0.5]).tolist():
                own, open_ = p[first[d] : first[d + 1]], False
                for t, q in zip(_TOKEN.finditer(texts[d]), own.tolist(), strict=True):
                    if q >= 0.5 and open_:
                        spans[d][-1] |= {"stop": t.end(), "probability": max(spans[d][-1]["probability"], q)}
                    elif q >= 0.5:
                        spans[d].append({"start": t.start(), "stop": t.end(), "probability": q})
                    open_ = q >= 0.5
            out = {"doc_id": table.column("doc_id"), "score": pa.array(score), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("probability", pa.float64())])))}
            if keep_columns:
                out["extra"] = table.column("extra")
            yield pa.table(out).combine_chunks().to_batches()[0]

    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in keep_columns]).alias("extra")] if keep_columns else []))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, spans array<struct<start:int,stop:int,probability:double>>" + (f", extra {ddl(docs.select(*[F.col(f'`{c}`') for c in keep_columns]).schema)}" if keep_columns else "")
    return chosen.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_on_tables(docs: DataFrame, labels: DataFrame) -> Model:
    model = fit(*training_rows(docs, labels, ~held_out()))
    exchange.give_back()  # the driver lives on after the fit
    return model


def op1_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    """Scores and toxic spans of all ``documents``; a fifth of the ids is never learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_toxicity(docs, fit_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")
