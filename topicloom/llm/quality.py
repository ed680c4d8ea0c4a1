"""Document quality by a linear-chain conditional random field over lines.

Every line is described by its own letters, cases, symbols, words and repetitions (of
words inside it, and of the line in its document), and by those of the line before and
after. No feature is the same for all lines of a document. A two-state chain (bad,
good) with these features and learnt transitions gives each line the probability of
good by forward-backward; a document's score is the mean over its lines, weighted by
their length.

Only documents have labels, so the labels of their lines are latent: the fit makes the
documents' scores likely under their labels (cross-entropy of the length-weighted
marginals), and lines of one document may differ. It starts from lines labelled like
their document, without transitions. It sees at most SAMPLE labelled documents, those
whose ids hash lowest, whatever the table's size, and runs on the driver (a matrix of
these documents' lines) by L-BFGS. Scoring is a map over all rows and whole texts.

Defined results: null and blank texts are one empty line, weighted as one; lines
without characters weigh nothing elsewhere; without labelled rows, or with one
class only, all scores are the share of good labels (0.5 without any). A doc_id
with several labels counts as good if most are, ties as bad. Repeated rows give
repeated rows and are one example; an empty table gives no rows. Other columns, and
labels, lang, source and doc_id, are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm._spark import cut, small_batches, text_key, tidy
from topicloom.llm._words import as_bytes, hash_words, split_points

#: Labelled documents to fit on, at most.
SAMPLE = 2000
BLOCK = 2 << 20
L2 = 1.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[[*b".,;:'\"-()?"]] = 5
_CLASS[[c for c in range(33, 127) if not _CLASS[c]]] = 6
_CLASS[128:] = 7
_CLASS[128:192] = 8  # later bytes of a character
OWN = 19
N_FEATURES = 3 * OWN
#: Scores are kept this far from 0 and 1 in the fit.
EDGE = 1e-4


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths (characters) of all lines, and the number of lines of each text."""
    lines_of, parts = np.array([t.count(b"\n") + 1 for t in texts]), []
    lengths = []
    for a, b in split_points(np.array([len(t) for t in texts]), BLOCK):
        own, size = _own(texts[a:b])
        parts.append(own)
        lengths.append(size)
    own = np.concatenate(parts) if parts else np.zeros((0, OWN))
    lengths = np.concatenate(lengths) if lengths else np.zeros(0)
    n = len(own)
    x = np.zeros((n, N_FEATURES))
    x[:, :OWN] = own
    ends = np.cumsum(lines_of)
    starts = ends - lines_of
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[starts], after[ends - 1] = False, False
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[~before, OWN : 2 * OWN] = own[~before]
    x[~after, 2 * OWN : 3 * OWN] = own[~after]
    return x, lengths, lines_of


def _repeats(texts: list[bytes]) -> np.ndarray:
    """Of each line: the share of its words that it has already had, the share of words like the one before, and whether its document has it again."""
    split = [t.split(b"\n") for t in texts]
    lines = [x for d in split for x in d]
    h, counts = hash_words(lines)
    line = np.repeat(np.arange(len(lines)), counts)
    order = np.lexsort((h, line))
    again = (h[order][1:] == h[order][:-1]) & (line[order][1:] == line[order][:-1])
    next_to = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    many = np.maximum(counts, 1)
    out = np.zeros((len(lines), 3))
    out[:, 0] = np.bincount(line[order][1:][again], minlength=len(lines)) / many
    out[:, 1] = np.bincount(line[1:][next_to], minlength=len(lines)) / many
    at = 0
    for d in split:
        if len(d) > 1 and len(set(d)) < len(d):
            seen = Counter(d)
            out[at : at + len(d), 2] = [bool(x) and seen[x] > 1 for x in d]
        at += len(d)
    return out


def _own(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    kind = _CLASS[buf]
    n = len(starts)
    count = np.zeros((9, n))
    for k in range(1, 9):
        sums = np.concatenate(([0], np.cumsum(kind == k)))
        count[k] = sums[ends] - sums[starts]
    chars = count[1:8].sum(0)
    size = np.maximum(chars, 1)
    gap = kind == 4
    gap[ends] = True
    word_start = ~gap & np.concatenate(([True], gap[:-1]))
    word_end = ~gap & np.concatenate((gap[1:], [True]))
    per_line = lambda mask: (s := np.concatenate(([0], np.cumsum(mask))))[ends] - s[starts]
    words = per_line(word_start)
    many = np.maximum(words, 1)
    letters = np.maximum(count[1] + count[2] + count[7], 1)
    symbol_end = per_line(word_end & (kind == 6))
    same = np.zeros(len(buf), bool)
    same[1:] = (buf[1:] == buf[:-1]) & ~gap[1:]
    own = np.stack(
        [
            np.ones(n), np.log1p(chars), (chars == 0) * 1.0, count[1] / size, count[2] / size, count[3] / size, count[4] / size, count[5] / size, count[6] / size, count[7] / size,
            (chars - count[4]) / many / 10, symbol_end / many, per_line(word_start & (kind == 2)) / many, count[2] / letters, per_line(same) / size, per_line(word_start & word_end & (kind == 6)) / many, *_repeats(texts).T,
        ],
        axis=1,
    )
    return own, chars


def _order(lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Documents from the longest, their first lines, and how many have a line at each step."""
    by = np.argsort(-lines_of, kind="stable")
    starts = (np.cumsum(lines_of) - lines_of)[by]
    longest = int(lines_of.max()) if len(lines_of) else 0
    active = len(lines_of) - np.searchsorted(np.sort(lines_of), np.arange(longest), "right")
    return by, starts, active.tolist()


def forward_backward(unary: np.ndarray, trans: np.ndarray, lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line (n, 2), summed marginals of transitions (2, 2), and the log partition of all chains."""
    _, starts, active = _order(lines_of)
    n = len(unary)
    top = unary.max(1, keepdims=True) if n else unary
    e, t = np.exp(unary - top), np.exp(trans - trans.max())
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    log_z = float(top.sum()) + float(trans.max()) * (n - len(lines_of))
    for step, m in enumerate(active):
        at = starts[:m] + step
        a = e[at] if not step else (alpha[at - 1] @ t) * e[at]
        z = a.sum(1, keepdims=True)
        alpha[at] = a / z
        log_z += float(np.log(z).sum())
    pairs = np.zeros((2, 2))
    for step in range(len(active) - 1, 0, -1):
        at = starts[: active[step]] + step
        msg = beta[at] * e[at]
        b = msg @ t.T
        joint = alpha[at - 1][:, :, None] * t[None] * msg[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), pairs, log_z


def _lbfgs(f, x: np.ndarray, steps: int = 50, memory: int = 8) -> np.ndarray:
    value, grad = f(x)
    s_list, y_list = [], []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if s_list:
            q *= s_list[-1] @ y_list[-1] / (y_list[-1] @ y_list[-1])
        else:
            q /= max(1.0, np.linalg.norm(q))
        for s, y, a in zip(s_list, y_list, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        step, slope = 1.0, grad @ q
        while True:
            new = x - step * q
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, new_grad - grad
        done = abs(value - new_value) <= 1e-7 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
        if s @ y > 1e-10:
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
    return x


class Model:
    """weights: features by state difference (good minus bad); trans: 2 by 2; constant: a score without features."""

    def __init__(self, mean, scale, weights, trans, constant: float | None = None):
        self.mean, self.scale, self.weights, self.trans, self.constant = mean, scale, weights, trans, constant

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good and length of all lines, and the number of lines of each text."""
        x, lengths, lines_of = line_features(texts)
        u = ((x - self.mean) / self.scale) @ self.weights
        return forward_backward(np.stack([np.zeros(len(u)), u], 1), self.trans, lines_of)[0][:, 1], lengths, lines_of

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if texts else 0.0)
        p, lengths, lines_of = self.line_marginals(texts)
        return np.add.reduceat(p * line_weights(lengths, lines_of), np.cumsum(lines_of) - lines_of)


def line_weights(lengths: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Each line's share of its document's length; of a document without characters all lines count alike."""
    starts = np.cumsum(lines_of) - lines_of
    total = np.repeat(np.add.reduceat(lengths, starts), lines_of)
    return np.where(total > 0, lengths / np.maximum(total, 1), 1 / np.repeat(lines_of, lines_of))


def document_loss(w: np.ndarray, trans: np.ndarray, x: np.ndarray, share: np.ndarray, lines_of: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Cross-entropy of the documents' scores, and its gradients by weights and transitions.

    A score is linear in the marginals, which are derivatives of the log partition; their derivatives along the score's
    gradient are the change of marginals and transitions when the lines' potentials are moved along it.
    """
    u = x @ w
    starts = np.cumsum(lines_of) - lines_of
    run = lambda v: forward_backward(np.stack([np.zeros(len(v)), v], 1), trans, lines_of)
    p = run(u)[0][:, 1]
    s = EDGE + (1 - 2 * EDGE) * np.add.reduceat(p * share, starts)
    value = -float(np.log(np.where(labels == 1, s, 1 - s)).sum())
    along = np.repeat((1 - 2 * EDGE) * np.where(labels == 1, -1 / s, 1 / (1 - s)), lines_of) * share
    step = 1e-4 / max(float(np.abs(along).max()), 1e-12)
    (up, up_pairs, _), (down, down_pairs, _) = run(u + step * along), run(u - step * along)
    return value, x.T @ ((up - down)[:, 1] / (2 * step)), (up_pairs - down_pairs) / (2 * step)


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    if len(set(labels.tolist())) < 2:
        return Model(0, 1, 0, 0, constant=float(labels.mean()) if len(labels) else 0.5)
    x, lengths, lines_of = line_features(texts)
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[scale < 1e-6] = 0.0, 1.0
    scale[0] = 1.0
    x = (x - mean) / scale
    y = np.repeat(labels, lines_of).astype(int)
    share, k, n = line_weights(lengths, lines_of), x.shape[1], len(lines_of)

    def alone(w):  # each line by itself, labelled like its document
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return -float((share * np.log(np.where(y == 1, p, 1 - p))).sum()) + L2 * float(w @ w) / 2, x.T @ (share * (p - y)) + L2 * w

    def loss(v):
        value, by_w, by_trans = document_loss(v[:k], v[k:].reshape(2, 2), x, share, lines_of, labels)
        return value + L2 * float(v @ v) / 2, np.concatenate([by_w, by_trans.ravel()]) + L2 * v

    v = _lbfgs(loss, np.concatenate([_lbfgs(alone, np.zeros(k), steps=20), np.zeros(4)]))
    return Model(mean, scale, v[:k], v[k:].reshape(2, 2))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the labelled documents that are not held out, at most sample of them."""
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("label"))
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_labelled"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).select(*text_key(), "text", "label")
    # the matrix is made of whole texts; sample bounds the documents, and equal texts of one id are one example
    got = sorted({(r["_id"], r["_th"]): (r["text"], r["label"]) for r in rows.collect()}.items())
    return fit([(t or "").encode() for _, (t, _) in got], np.array([y for _, (_, y) in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(model.scores(as_bytes(batch.column("text"))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs whose score is at least 0.5; all columns stay."""
    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(as_bytes(batch.column(batch.schema.get_field_index("text")))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
