"""Document quality from a linear-chain CRF over lines.

Every non-blank line gets a label good or bad. The potentials of a line use its
own shape and the shapes of the lines before and after it; two adjacent labels
have a transition weight. Forward-backward gives each line's probability of being
good; the document's raw quality is their mean weighted by line length, and a
logistic step fitted on the same training rows turns that into the score.

Training uses a bounded sample of labelled documents (``SAMPLE_DOCS``, each of at
most ``SAMPLE_LINES`` lines), whose lines all carry their document's label; every
document is scored over all its lines. Shapes count characters by class and
words by ending, so nothing in them depends on a language's words.

Nulls and edges: a null, empty or blank text has no lines and gets the score of
a document about which nothing is known (the share of label 1 in the sample); without any
labelled row that share is 0.5 for every document. Rows of the label table with
null or repeated ids or a null label are left out or count once each.
"""

from __future__ import annotations

from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunning.llm.common import add_columns, as_bytes, bounded_sample, narrow

SAMPLE_DOCS, SAMPLE_LINES = 6000, 1000
#: A document is predicted good from this score on.
THRESHOLD = 0.3
SEED = 3
#: Lines of a stretch that are worked through one after another.
STRETCH = 512
STEPS = 250
RIDGE = 1e-3

# Byte classes.
SPACE, LOWER, UPPER, DIGIT, STOP, MARK, BAR, HIGH, OTHER = range(9)
CLASSES = 9


def _byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for chars, kind in ((b" \t\n\x0b\x0c\r", SPACE), (bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (b"0123456789", DIGIT), (b".,;:?'\"-()", STOP), (b"#$%&*@^~_=+<>\\/{}[]!", MARK), (b"|", BAR), (bytes(range(128, 256)), HIGH)):
        table[list(chars)] = kind
    return table


BYTE_CLASS = _byte_classes()
_ODD = (np.random.default_rng(SEED).integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
SHAPES = 8 + 4 + 5  # shares of the classes but space, word endings, repetition and size
FEATURES = 1 + 3 * SHAPES + 2


def line_shapes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shapes (lines x SHAPES), byte lengths and document numbers of all non-blank lines."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    newline = buf == 10
    line = np.cumsum(newline) - newline
    total = int(line[-1]) + 1
    per_doc = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    kind = BYTE_CLASS[buf]
    counts = np.bincount(line * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
    size = counts.sum(axis=1) - 1  # without the line's end
    ink = np.maximum(counts[:, 1:].sum(axis=1), 1)
    blank = kind == SPACE
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True])
    out = np.zeros((total, SHAPES))
    out[:, :8] = counts[:, 1:] / ink[:, None]
    if len(starts):
        at = line[starts]
        words = np.maximum(np.bincount(at, minlength=total), 1)
        last = kind[ends]
        for k, kinds in enumerate(((MARK,), (BAR,), (STOP,))):
            out[:, 8 + k] = np.bincount(at[np.isin(last, kinds)], minlength=total) / words
        out[:, 11] = np.bincount(at[kind[starts] == UPPER], minlength=total) / words
        # a word's hash: bytes times odd weights by place in the word
        width = ends - starts + 1
        place = np.arange(len(buf)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(buf)]))
        hashed = np.add.reduceat(np.where(blank, 0, buf).astype(np.uint64) * _ODD[place & 63], starts)
        same = np.r_[False, (hashed[1:] == hashed[:-1]) & (at[1:] == at[:-1])]
        out[:, 12] = np.bincount(at[same], minlength=total) / words
        order = np.lexsort((hashed, at))
        new = np.r_[True, (hashed[order][1:] != hashed[order][:-1]) | (at[order][1:] != at[order][:-1])]
        out[:, 13] = np.bincount(at[order][new], minlength=total) / words
        out[:, 14] = np.bincount(at, weights=width, minlength=total) / words / 10
        out[:, 15] = np.log1p(words) / 5
        # a line that an earlier line of the document repeats
        whole = np.zeros(total, np.uint64)
        np.add.at(whole, at, hashed * _ODD[(np.arange(len(at)) - np.r_[0, np.cumsum(np.bincount(at, minlength=total))][at]) & 63])
        order = np.lexsort((np.arange(total), whole, doc))
        again = np.r_[False, (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
        out[order[again], 16] = 1
    real = counts[:, 1:].sum(axis=1) > 0
    return out[real], size[real], doc[real]


def with_neighbours(shapes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own, previous and next line's shapes, with flags for the first and last line."""
    n = len(shapes)
    x = np.zeros((n, FEATURES))
    x[:, 0] = 1
    x[:, 1 : 1 + SHAPES] = shapes
    if n:
        before = np.r_[False, doc[1:] == doc[:-1]]
        after = np.r_[doc[1:] == doc[:-1], False]
        x[before, 1 + SHAPES : 1 + 2 * SHAPES] = shapes[np.flatnonzero(before) - 1]
        x[after, 1 + 2 * SHAPES : 1 + 3 * SHAPES] = shapes[np.flatnonzero(after) + 1]
        x[:, -2], x[:, -1] = ~before, ~after
    return x


class Chains:
    """The lines of many documents as chains, worked on side by side.

    Long documents are cut into stretches of ``STRETCH`` lines. What a stretch does to the two states
    before it is one 2 x 2 matrix; these pass on what comes in from left and right, stretch by stretch, and then
    all stretches are worked on at once. So the steps taken grow with the number of stretches, not of lines.
    """

    def __init__(self, doc: np.ndarray):
        _, first, sizes = np.unique(doc, return_index=True, return_counts=True)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        self.start = (first[owner] + nth * STRETCH)[order]
        length = length[order]
        self.last = self.start + length - 1
        self.steps = [self.start[: np.searchsorted(-length, -t)] + t for t in range(int(length[0]) if len(length) else 0)]
        self.opens = nth[order] == 0
        place = np.argsort(order)
        #: Stretches that are the first, second, ... after a document's opening one, and the stretch before each.
        by_round = np.argsort(nth, kind="stable")
        cuts = np.searchsorted(nth[by_round], np.arange(1, int(nth.max()) + 2)) if len(nth) else []
        self.rounds = [(place[now - 1], place[now]) for now in (by_round[a:b] for a, b in pairwise(cuts))]
        self.follows = np.setdiff1d(np.arange(len(doc)), first, assume_unique=True)

    def _forward(self, unary: np.ndarray, trans: np.ndarray, enter: np.ndarray) -> np.ndarray:
        """Messages from the left, given those of the lines before the stretches."""
        forward = np.zeros_like(unary)
        for t, rows in enumerate(self.steps):
            prev = forward[rows - 1] if t else enter
            came = np.stack([np.logaddexp(prev[:, 0] + trans[0, b], prev[:, 1] + trans[1, b]) for b in (0, 1)], axis=1)
            forward[rows] = unary[rows] + (came if t else np.where(self.opens[:, None], 0.0, came))
        return forward

    def marginals(self, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line, expected transition counts (2 x 2) and the log of the partition functions' product.

        ``score``: a line's potential for good; that for bad is 0.
        """
        n = len(score)
        unary = np.stack([np.zeros(n), score], axis=1)
        enter, leave = np.zeros((len(self.start), 2)), np.zeros((len(self.start), 2))
        if self.rounds:
            alone = [self._forward(unary, trans, np.broadcast_to(e, enter.shape))[self.last] for e in (np.array([0.0, -np.inf]), np.array([-np.inf, 0.0]))]
            through, done = np.stack(alone, axis=1), alone[0].copy()  # what an opening stretch ends with needs nothing before it
            for prev, now in self.rounds:
                enter[now] = done[prev]
                done[now] = np.logaddexp(done[prev, :1] + through[now, 0], done[prev, 1:] + through[now, 1])
            for prev, now in reversed(self.rounds):
                leave[prev] = np.logaddexp(through[now, :, 0] + leave[now, :1], through[now, :, 1] + leave[now, 1:])
        forward, backward = self._forward(unary, trans, enter), np.zeros((n, 2))
        backward[self.last] = leave
        for rows in reversed(self.steps[1:]):
            back = unary[rows] + backward[rows]
            for a in (0, 1):
                backward[rows - 1, a] = np.logaddexp(back[:, 0] + trans[a, 0], back[:, 1] + trans[a, 1])
        both = forward + backward
        z = np.logaddexp(both[:, 0], both[:, 1])
        rows, ahead = self.follows, unary + backward
        pairs = np.array([[np.exp(forward[rows - 1, a] + trans[a, b] + ahead[rows, b] - z[rows]).sum() for b in (0, 1)] for a in (0, 1)])
        return np.exp(both[:, 1] - z), pairs, float(z[self.start[self.opens]].sum())


def doc_quality(marginal: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Mean of the lines' marginals weighted by length; NaN for a document without lines."""
    weight = np.bincount(doc, weights=size, minlength=docs)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, weights=size * marginal, minlength=docs) / weight


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(shapes: np.ndarray, size: np.ndarray, doc: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> dict:
    """Model fitted on the lines of labelled documents (``doc`` counts from 0, in order)."""
    share = float(labels.mean()) if len(labels) else 0.5
    model = {"share": share, "weights": np.zeros(FEATURES), "trans": np.zeros((2, 2)), "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "step": (0.0, float(_logit(np.array(share))))}
    if not len(shapes) or labels.min() == labels.max():
        return model
    x = with_neighbours(shapes, doc)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    x = (x - mean) / scale
    chains, y = Chains(doc), labels[doc].astype(np.float64)
    follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follows - 1].astype(int), y[follows].astype(int)), 1)
    theta, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for i in range(1, steps + 1):
        p, pairs, _ = chains.marginals(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        grad = np.r_[x.T @ (p - y), (pairs - seen).ravel()] / len(labels) + RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    model |= {"weights": theta[:FEATURES], "trans": theta[FEATURES:].reshape(2, 2), "mean": mean, "scale": scale}
    raw = doc_quality(chains.marginals(x @ model["weights"], model["trans"])[0], size, doc, len(labels))
    known = ~np.isnan(raw)
    z, target = _logit(raw[known]), labels[known]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression in two unknowns
        q = 1 / (1 + np.exp(-(a * z + b)))
        w = q * (1 - q) + 1e-6
        g = np.array([(z * (q - target)).sum() + a - 1, (q - target).sum() + b])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    model["step"] = (float(a), float(b))
    return model


def scores(texts: list[bytes | None], model: dict) -> np.ndarray:
    """Quality of each text, 0 to 1."""
    shapes, size, doc = line_shapes(texts)
    x = (with_neighbours(shapes, doc) - model["mean"]) / model["scale"]
    marginal = Chains(doc).marginals(x @ model["weights"], model["trans"])[0]
    raw = doc_quality(marginal, size, doc, len(texts))
    a, b = model["step"]
    with np.errstate(invalid="ignore"):
        out = 1 / (1 + np.exp(-(a * _logit(raw) + b)))
    return np.where(np.isnan(raw), model["share"], out)


def _pack() -> object:
    def run(texts: pa.Array) -> list[pa.Array]:
        docs = as_bytes(texts)
        shapes, size, doc = line_shapes(docs)
        rows = [np.c_[size[doc == d], shapes[doc == d]].astype(np.float32).tobytes() for d in range(len(docs))]
        return [pa.array(rows, pa.binary())]

    return run


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, sample_docs: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Model from a bounded, seeded sample of the labelled documents for which ``learn`` (over ``doc_id``) holds.

    The executors turn the sample's texts into line shapes; only these come to the driver.
    """
    known = narrow(labels, doc_id=doc_id, label=label).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if learn is not None:
        known = known.where(learn)
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", sample_docs, SEED)
    rows = narrow(documents, doc_id=doc_id, text=text).join(F.broadcast(chosen), "doc_id")  # at most sample_docs rows
    rows = rows.where(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= SAMPLE_LINES)
    packed = add_columns(rows, "text", [T.StructField("lines", T.BinaryType())], _pack).select("doc_id", "label", "lines")
    got = sorted((r.doc_id, bytes(r.lines), r.label) for r in packed.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample_docs).collect())
    parts = [np.frombuffer(b, np.float32).reshape(-1, SHAPES + 1) for _, b, _ in got]
    lines = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, SHAPES + 1))
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(lines[:, 1:], lines[:, 0], doc, np.array([r[2] for r in got], dtype=np.int64))


def _scorer(model: dict):
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(scores(as_bytes(texts), model), pa.float64())]

    return run


def with_score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` and its texts' quality under ``model`` (a few kB, shipped with the tasks)."""
    return add_columns(df, text, [T.StructField(out, T.DoubleType())], partial(_scorer, model))
