"""Toxicity by a linear-chain conditional random field over words.

Tags are clean and toxic. A word's features are itself and its beginnings of 4, 5 and
6 bytes, lower-cased; pairs of neighbouring tags have weights of their own. Lines are
chains, cut after ``CHAIN`` words. Token labels come from the labelled documents: in a
toxic one, a word with a feature that is far more frequent in toxic documents than in
clean ones is toxic; every other word is clean.

Forward-backward marginals of the tags aggregate to a document's features (expected
toxic words, highest marginal), which a logistic regression turns into the score; it is
fitted to marginals of texts that their field was not fitted on (four folds).
Spans are runs of words whose marginal is at least a half, as code-point offsets.

The model is fitted on at most ``max_toxic`` + ``max_clean`` labelled rows of
``max_bytes`` bytes together, chosen by a hash of the id, whole texts each, in one task; only the
model reaches the driver. A text that no longer fits in is passed over. Of the sample's
chains all with a toxic word train the field and about ``chains`` others. A feature is
telling if a ``share`` of the toxic documents has it, three at least, and ``ratio`` times
the share of clean ones. Scoring reads every whole
text.

Nulls: a null or empty text has no words and gets the score of that; rows without a
label are only scored; a null id is never learned from. Repeated rows are scored alike.
Columns of other names are not looked at. An empty table gives no rows. Without labels of
both kinds all scores are the same, near 0.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import LETTERS, U, pieces, released, utf8, words

CHAIN = 128
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    vocab: np.ndarray  # sorted hashes of features
    weight: np.ndarray  # by feature: toxic against clean
    bias: float
    pair: np.ndarray  # 2 x 2, by tag and next tag
    doc: np.ndarray  # intercept, expected words, highest marginal

    def emission(self, feats: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(feats[0]), self.bias, np.float32)
        if len(self.vocab):
            maybe = np.zeros(1 << 16, bool)  # most words have no feature: their low bits tell
            maybe[(self.vocab & U(0xFFFF)).astype(np.int64)] = True
            for f in feats:
                i = np.flatnonzero(maybe[(f & U(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.vocab, f[i]), len(self.vocab) - 1)
                hit = self.vocab[at] == f[i]
                out[i[hit]] += self.weight[at[hit]].astype(np.float32)
        return out

    def score(self, expected: np.ndarray, highest: np.ndarray) -> np.ndarray:
        z = self.doc[0] + self.doc[1] * np.log1p(expected) + self.doc[2] * highest
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def read_words(column: pa.Array):
    """Words of a text column: starts, ends, features, row of each, chain of each."""
    buf, offs = utf8(column)
    starts, ends, h, *pre = words(buf, offs, LETTERS, prefixes=PREFIXES)
    row = np.searchsorted(offs, starts, "right") - 1
    line = np.searchsorted(np.flatnonzero(buf == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    chain = np.cumsum(new | (place % CHAIN == 0)) - 1
    return buf, offs, starts, ends, [h, *pre], row, chain


def marginals(psi: np.ndarray, chain: np.ndarray, pair: np.ndarray, pairs: bool = False):
    """P(toxic) of each word by forward-backward; with ``pairs`` also the expected tag pairs and log Z.

    Chains are laid out side by side, longest first, so each step is one array
    operation over all chains that still have words.
    """
    n = len(psi)
    if not n:
        return (np.zeros(0, np.float32), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0, np.float32)
    at = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    size = np.diff(np.append(at, n))
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    T = np.exp(pair.astype(np.float64))
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # chains longer than t
    e = np.exp(np.clip(psi, -30, 30).astype(np.float64))
    a0, a1, b0, b1 = (np.empty(n) for _ in range(4))
    logz = 0.0
    for t, k in enumerate(live):
        i = at[:k] + t
        if t == 0:
            x0, x1 = np.ones(k), e[i]
        else:
            p0, p1 = a0[i - 1], a1[i - 1]
            x0, x1 = p0 * T[0, 0] + p1 * T[1, 0], (p0 * T[0, 1] + p1 * T[1, 1]) * e[i]
        s = x0 + x1
        a0[i], a1[i] = x0 / s, x1 / s
        if pairs:
            logz += np.log(s).sum()
    for t in range(len(live) - 1, -1, -1):
        k, longer = live[t], live[t + 1] if t + 1 < len(live) else 0
        i = at[:k] + t
        b0[i], b1[i] = 1.0, 1.0
        if longer:
            j = at[:longer] + t
            n0, n1 = b0[j + 1], b1[j + 1] * e[j + 1]
            y0, y1 = T[0, 0] * n0 + T[0, 1] * n1, T[1, 0] * n0 + T[1, 1] * n1
            s = y0 + y1
            b0[j], b1[j] = y0 / s, y1 / s
    m = a1 * b1 / (a0 * b0 + a1 * b1)
    if not pairs:
        return m.astype(np.float32)
    both, step = np.zeros((2, 2)), 1 << 17  # a part of the neighbouring words at a time
    for lo in range(0, n - 1, step):
        j = lo + np.flatnonzero(chain[lo + 1 : lo + step + 1] == chain[lo : min(lo + step, n - 1)])
        x0, x1 = b0[j + 1], b1[j + 1] * e[j + 1]
        q = np.stack([a0[j] * T[0, 0] * x0, a0[j] * T[0, 1] * x1, a1[j] * T[1, 0] * x0, a1[j] * T[1, 1] * x1])
        both += (q / q.sum(0)).sum(1).reshape(2, 2)
    return m, both, logz


def fit(texts: list[str], toxic: list[int], rounds: int = 40, ratio: float = 20.0, share: float = 1 / 140, l2: float = 1e-3, chains: int = 10_000, seed: int = 1, folds: int = 4) -> Model:
    """Fits the field and the document regression to labelled texts.

    The regression learns from marginals of texts that the field has not seen: each fold's
    come from a field of the other folds, as marginals of its own texts would flatter it.
    """
    y = np.array(toxic, bool)
    nothing = Model(np.zeros(0, U), np.zeros(0), -5.0, np.zeros((2, 2)), np.array([-30.0, 0, 0]))
    if not len(y) or y.all() or not y.any():
        return nothing
    feats, row, chain = read_words(pa.array(texts, pa.large_string()))[4:]
    if not len(row):
        return nothing
    del texts
    # both kinds of texts are dealt to the folds in turn
    fold = np.where(y, np.cumsum(y), np.cumsum(~y)) % folds
    settings = {"rounds": rounds, "ratio": ratio, "share": share, "l2": l2, "chains": chains, "seed": seed}
    expected, highest = np.zeros(len(y)), np.zeros(len(y))
    told = np.zeros(len(y), bool)
    for k in range(folds):
        out = fold == k
        if not out.any() or not y[~out].any() or y[~out].all():
            continue
        w = out[row]
        model = fit_field([f[~w] for f in feats], row[~w], chain[~w], y, ~out, **settings)
        e, h = per_row(marginals(model.emission([f[w] for f in feats]), chain[w], model.pair), row[w], len(y))
        expected[out], highest[out], told[out] = e[out], h[out], True
    model = fit_field(feats, row, chain, y, np.ones(len(y), bool), **settings)
    if not told.all():  # too few texts for folds
        expected, highest = per_row(marginals(model.emission(feats), chain, model.pair), row, len(y))
    x = np.stack([np.ones(len(y)), np.log1p(expected), highest], 1)
    beta = np.array([-2.0, 1.0, 1.0])
    for _ in range(50):  # Newton's method with a small ridge
        z = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (z * (1 - z))[:, None]).T @ x + 0.1 * np.eye(3)
        beta = beta - np.linalg.solve(h, x.T @ (z - y) + 0.1 * beta * [0, 1, 1])
    model.doc = beta
    return model


def fit_field(feats: list[np.ndarray], row: np.ndarray, chain: np.ndarray, y: np.ndarray, rows: np.ndarray, rounds: int, ratio: float, share: float, l2: float, chains: int, seed: int) -> Model:
    """The field of the words of the texts marked by ``rows``; its document regression is not set."""
    if not len(row):
        return Model(np.zeros(0, U), np.zeros(0), -5.0, np.zeros((2, 2)), np.zeros(3))
    n_toxic, n_clean = int(y[rows].sum()), int((~y[rows]).sum())
    least = max(3, round(share * n_toxic))
    vocab, marks = [], []
    for f in feats:
        u, which = np.unique(f, return_inverse=True)
        pairs = np.unique(which.astype(np.int64) * len(y) + row)
        del which
        doc, feat = pairs % len(y), pairs // len(y)
        t, c = np.bincount(feat[y[doc]], minlength=len(u)), np.bincount(feat[~y[doc]], minlength=len(u))
        telling = (t >= least) & ((t + 0.5) / (n_toxic + 1) >= ratio * (c + 0.5) / (n_clean + 1))
        common = telling | (t + c >= max(least, (n_toxic + n_clean) // 20))
        vocab.append(u[common])
        marks.append(u[telling])
    vocab, marks = np.unique(np.concatenate(vocab)), np.unique(np.concatenate(marks))
    label, index = np.zeros(len(row), bool), []
    for f in feats:  # a feature's place in the vocabulary is all that is needed from here; unknown ones have the last
        label |= np.isin(f, marks)
        at = np.minimum(np.searchsorted(vocab, f), max(len(vocab) - 1, 0)).astype(np.int32)
        index.append(np.where(vocab[at] == f, at, np.int32(len(vocab))) if len(vocab) else np.zeros(len(f), np.int32))
    label &= y[row]
    # all chains with toxic words, and others by chance
    count = int(chain[-1]) + 1
    whole = len(np.unique(chain))
    hot = np.zeros(count, bool)
    hot[chain[label]] = True
    rng = np.random.default_rng(seed)
    use = hot | (rng.random(count) < chains / whole)
    w = use[chain]
    known = [a[w] for a in index]
    lab, ch = label[w], np.unique(chain[w], return_inverse=True)[1]
    nxt = np.flatnonzero(ch[1:] == ch[:-1])
    seen_pairs = np.bincount(lab[nxt] * 2 + lab[nxt + 1], minlength=4).reshape(2, 2).astype(float)
    weight, bias, pair = np.zeros(len(vocab)), -3.0, np.zeros((2, 2))
    theta = np.zeros(len(vocab) + 5)
    theta[-5] = bias
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    n = len(lab)
    for step in range(1, rounds + 1):
        weight, bias, pair = theta[: len(vocab)], theta[-5], theta[-4:].reshape(2, 2)
        psi, padded = np.full(n, bias), np.append(weight, 0.0)
        for a in known:
            psi += padded[a]
        m, q, _ = marginals(psi, ch, pair, pairs=True)
        r = m - lab
        g = np.zeros_like(theta)
        for a in known:
            g[: len(vocab)] += np.bincount(a, r, minlength=len(vocab) + 1)[:-1]
        g[-5], g[-4:] = r.sum(), (q - seen_pairs).ravel()
        scale = max(1.0, lab.sum())
        g = g / scale + l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    keep = np.abs(theta[: len(vocab)]) > 0.02
    return Model(vocab[keep], theta[: len(vocab)][keep], float(theta[-5]), theta[-4:].reshape(2, 2).copy(), np.zeros(3))


def per_row(p: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected toxic words, beyond the faint marginals of clean ones, and the highest marginal of each row."""
    highest = np.zeros(n)
    if len(row):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        highest[row[at]] = np.maximum.reduceat(p, at)
    return np.bincount(row, np.where(p >= 0.05, p, 0), minlength=n).astype(float), highest


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 700, max_clean: int = 1_500, max_bytes: int = 64 << 20) -> Model:
    """Fits a model on a bounded sample of the labelled rows that are not held out.

    The sample is by a hash of the id, ``max_toxic`` and ``max_clean`` rows at most, as
    far as they fit in ``max_bytes`` bytes of text. One task fits it, whatever the tables' size.
    """
    lab = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    h = F.xxhash64("id", F.lit(7))
    some = lab.filter("y = 1").orderBy(h, "id").limit(max_toxic).unionByName(lab.filter("y = 0").orderBy(h, "id").limit(max_clean))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").filter(~held_out("id"))

    def run(batches):
        texts, y, size = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len((text or "").encode("utf-8", "replace"))
                if size + n <= max_bytes:
                    texts.append(text or "")
                    y.append(label)
                    size += n
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, y))], pa.binary())], names=["model"])

    sample = rows.orderBy(h, "id").limit(2 * (max_toxic + max_clean)).select("text", "y")
    model = sample.coalesce(1).mapInArrow(released(run), "model binary").first()
    return pickle.loads(model[0]) if model else fit([], [])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_toxic, spans) of every row; spans in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the features of the sample
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in pieces(batch, 1):
                buf, offs, starts, ends, feats, row, chain = read_words(part.column(1))
                p = marginals(m.emission(feats), chain, m.pair)
                expected, highest = per_row(p, row, len(part))
                spans: list[list] = [[] for _ in range(len(part))]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    last = None
                    for k in hit.tolist():
                        r = int(row[k])
                        base = chars[offs[r]]
                        a, b = int(chars[starts[k]] - base), int(chars[ends[k]] - base)
                        if last is not None and last == k - 1 and row[k - 1] == r and chain[k - 1] == chain[k]:
                            spans[r][-1]["stop"] = b
                        else:
                            spans[r].append({"start": a, "stop": b})
                        last = k
                n = np.bincount(row[hit], minlength=len(part)) if len(hit) else np.zeros(len(part), int)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(expected, highest), pa.float64()), pa.array(n, pa.int64()), pa.array(spans, span)], names=["doc_id", "score", "n_toxic", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, score double, n_toxic long, spans array<struct<start:int,stop:int>>")


def below(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose own score is below ``limit``, whatever their ids."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in pieces(batch, at):
                _, _, _, _, feats, row, chain = read_words(part.column(at))
                expected, highest = per_row(marginals(m.emission(feats), chain, m.pair), row, len(part))
                yield part.filter(pa.array(m.score(expected, highest) < limit))

    return docs.mapInArrow(released(run), docs.schema)
