"""Quality scores by positive-unlabelled learning.

A small network is trained to the least non-negative unbiased risk: with class prior
p, trusted positives P and unlabelled web text U, and l the logistic loss,

    risk = p * mean_P l(+) + max(0, mean_U l(-) - p * mean_P l(-)),

where a step that finds the second part negative only takes that part back.  The
class prior is estimated from positives and unlabelled texts alone: above a threshold that
no negative reaches, there are as many more positives than unlabelled texts as the prior
is less than one.  Inputs are the text's byte-class pairs and word
repetition figures; ids, languages, sources and labels are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import batch, text_buffer, word_hashes
from .language_id import held_out
from .runtime import bounded_broadcast

#: Most rows that training draws: trusted positives, and unlabelled texts (about; drawn by a hash of the id).
POSITIVES, UNLABELLED = 12_000, 24_000
THRESHOLD = 0.7
HIDDEN, EPOCHS, BATCH = 24, 30, 512
#: Steps of the networks that the prior is estimated with: few, so that small samples aren't learned by heart.
PRIOR_STEPS = 100

#: Groups of ASCII characters that count as one class each; bytes above 127 are one more, the rest another.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t\x0b\x0c", ".", ",", ";:", "!?", "'\"`", "()[]{}", "|", "-_", "/\\", "@", "#$%&*^~", "=+<>"]
_N = len(CLASSES) + 2


def _class_table() -> np.ndarray:
    t = np.full(256, _N - 1, np.int64)
    t[128:] = _N - 2
    for i, group in enumerate(CLASSES):
        t[[ord(c) for c in group]] = i
    return t


WIDTH = _N * _N + 8


def features(col: pa.Array) -> np.ndarray:
    """A row of WIDTH figures for each text; zeros for an empty or null text."""
    data, off = text_buffer(col)
    table = _class_table()
    flat, first = word_hashes(col, lower=True)
    out = np.zeros((len(off) - 1, WIDTH), np.float32)
    for i, (s, e) in enumerate(zip(off[:-1], off[1:], strict=True)):
        n = e - s
        if not n:
            continue
        pairs = np.zeros(_N * _N, np.int64)
        for at in range(s, e, 1 << 20):
            c = table[data[at : min(at + (1 << 20) + 1, e)]]
            pairs += np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
        out[i, : _N * _N] = np.sqrt(pairs / max(n - 1, 1))
        w = flat[first[i] : first[i + 1]]
        if len(w):
            _, k = np.unique(w, return_counts=True)
            out[i, _N * _N :] = (
                len(k) / len(w),
                k.max() / len(w),
                np.mean(w[1:] == w[:-1]) if len(w) > 1 else 0,
                np.log1p(len(w)) / 10,
                n / len(w) / 20,
                len(k) / np.sqrt(len(w)) / 10,
                np.sum(k[k > 1]) / len(w),
                1,
            )
    return out


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(0))
        yield batch(["positive", "unlabelled", "x"], [b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())])


class Network:
    """One hidden layer over standardised inputs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.zeros(1, np.float32)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(z @ self.w[0] + self.w[1])
        return hidden @ self.w[2] + self.w[3], hidden

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.inputs(x))[0].astype(np.float64)))

    def gradient(self, z: np.ndarray, hidden: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        back = np.outer(by, self.w[2]) * (1 - hidden**2)
        return [z.T @ back, back.sum(0), hidden.T @ by, by.sum(keepdims=True)]


def risk_gradient(net: Network, p: np.ndarray, u: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """Gradient of the non-negative risk of inputs p and u; of minus its second part where that is negative."""
    (gp, hp), (gu, hu) = net.logits(p), net.logits(u)
    sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    if prior is None:
        by_p, by_u = (sp - 1) / len(p), su / len(u)
    elif np.mean(np.logaddexp(0, gu)) >= prior * np.mean(np.logaddexp(0, gp)):
        by_p, by_u = (prior * (sp - 1) - prior * sp) / len(p), su / len(u)
    else:
        by_p, by_u = prior * sp / len(p), -su / len(u)
    return [x + y for x, y in zip(net.gradient(p, hp, by_p), net.gradient(u, hu, by_u), strict=True)]


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int = 5) -> Network:
    """Minimise the non-negative risk by Adam over shuffled batches; the same result each time.

    Without a prior, the loss is the logistic one of positives against unlabelled texts,
    for about PRIOR_STEPS steps.
    """
    mean = unl.mean(0)
    net = Network(mean, np.maximum(unl.std(0), 0.02), seed)
    pos, unl = net.inputs(pos).astype(np.float32), net.inputs(unl).astype(np.float32)
    rng = np.random.default_rng(seed)
    m, v, t = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w], 0
    steps = max(len(unl) // BATCH, 1)
    epochs = max(EPOCHS, 600 // steps) if prior is not None else max(PRIOR_STEPS // steps, 1)
    for _ in range(epochs):
        a, b = rng.permutation(len(pos)), rng.permutation(len(unl))
        for i in range(steps):
            p, u = pos[a[i * len(a) // steps : (i + 1) * len(a) // steps + 1]], unl[b[i * len(b) // steps : (i + 1) * len(b) // steps + 1]]
            grads = [g + 1e-4 * w for g, w in zip(risk_gradient(net, p, u, prior), net.w, strict=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> float:
    """Share of positives among unlabelled texts, by best bins over two halves.

    A network that tells positives from unlabelled texts, trained on one half, ranks the
    other.  For any threshold, the share of unlabelled texts above it over the share of
    positives above it bounds the prior from above, and is tight where no negative is
    above; the threshold is the one whose ratio is least when both shares' sampling
    errors count against it.
    """
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    found = []
    for half in (0, 1):
        (own_p, other_p), (own_u, other_u) = ((x[half::2], x[1 - half :: 2]) for x in (pos, unl))
        net = train(own_p, own_u, None, seed)
        sp, su = (np.sort(net.logits(net.inputs(x))[0]) for x in (other_p, other_u))
        above = lambda x: 1 - np.searchsorted(x, sp, "left") / len(x)  # noqa: E731, B023
        q_p, q_u = above(sp), above(su)
        slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
        best = int(np.argmin((q_u + slack) / q_p))
        found.append(q_u[best] / q_p[best])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def _score(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = net.scores(features(part.column(2))) if net else np.full(part.num_rows, 0.5)
                yield batch(["doc_id", "held_out", "score", "predicted"], [part.column(0), part.column(1), s, (s >= THRESHOLD).astype(np.int32)])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, positives: int | None = POSITIVES, unlabelled: int | None = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text); labels has doc_id and quality.

    Positives are texts that labels marks 1, unlabelled ones any text, both from rows
    that aren't held out and drawn by a hash of doc_id down to about ``positives`` and
    ``unlabelled`` rows (None: all of them, WIDTH figures each, which the driver must hold);
    labels of 0 take no part.  The class prior is estimated (``class_prior``) from
    those two samples.  predicted is 1 where score >= 0.7.  A null text scores as an
    empty one; with no positive or no unlabelled row every score is 0.5.  Labels with a
    null or another quality aren't used; a doc_id labelled twice counts as positive if
    any label is 1.  Repeated rows are scored each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    ones = marks.where("quality = 1").count()
    total = rows.where("not held_out").count()

    def drawn(most: int | None, of: int, seed: int):
        return F.lit(True) if most is None else F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(of, 1)))

    chosen = marks.where("quality = 1").where(drawn(positives, ones, 1)).select("doc_id", F.lit(True).alias("positive")).distinct()
    both = rows.where("not held_out").join(bounded_broadcast(chosen, min(ones, ones if positives is None else positives), 40), "doc_id", "left")
    sample = both.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce(drawn(unlabelled, total, 2), F.lit(False)).alias("unlabelled")).where("positive or unlabelled")
    got = sample.mapInArrow(_draw, "positive boolean, unlabelled boolean, x binary").toArrow()
    raw = got.column("x").to_pylist()
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, WIDTH)
    is_pos, is_unl = np.array(got.column("positive").to_pylist(), bool), np.array(got.column("unlabelled").to_pylist(), bool)
    net = None
    if is_pos.any() and is_unl.any():
        order = sorted(range(len(raw)), key=raw.__getitem__)  # rows come in any order; training shouldn't depend on it
        x, is_pos, is_unl = x[order], is_pos[order], is_unl[order]
        net = train(x[is_pos], x[is_unl], class_prior(x[is_pos], x[is_unl]))
    return rows.mapInArrow(_score(net), "doc_id long, held_out boolean, score double, predicted int")
