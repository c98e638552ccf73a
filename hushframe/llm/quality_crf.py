"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its characters and words, and those of the lines before and after it. The field labels
each line good or bad: its marginals come from forward and backward products of 2 x 2 matrices, taken as segmented
scans over blocks of lines, each of which takes over the last one's result; so a document of any number of lines takes a
few numbers a line. A document's quality is the mean of its lines' marginals weighted by their lengths, mapped to
a probability by a logistic curve.

It is fitted in numpy by gradient, batch by batch, on a bounded sample of labelled documents (MAX_DOCS of at most MAX_BYTES, and
MAX_LINES together). Lines start with their document's label; then lines of bad documents that the field finds good are
relabelled, and it is fitted again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.batches import chunked, map_batches, map_chunks
from hushframe.llm.shingles import word_hashes

#: The sample that it is fitted on: so many labelled documents of at most so many bytes, and so many lines of them together.
MAX_DOCS, MAX_BYTES, MAX_LINES = 3000, 1 << 15, 200_000
#: Lines that are scanned at a time, bytes of text whose features are made at a time, and lines of a batch when it is fitted.
BLOCK_LINES, BLOCK_BYTES, BATCH_LINES = 1 << 16, 1 << 18, 6000

_CLASS = np.zeros(256, dtype=np.int64)  # lower-case letters
_KINDS = ("lower", "upper", "digit", "space", "stop", "symbol", "bar", "bang", "lead", "rest")
_CLASS[33:127] = 5
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[:33] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[ord("|")], _CLASS[ord("!")] = 6, 7
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 8, 9
N_FEATURES = 15


def line_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lines' lengths in characters, and the number of lines of each text (at least one)."""
    parts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends)
    doc_ends = np.cumsum([len(p) + 1 for p in parts])
    n_lines = np.diff(np.concatenate(([0], np.searchsorted(ends, doc_ends))))
    line = np.repeat(np.arange(n), ends - starts + 1)
    kinds = np.bincount(line * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
    kinds[:, 3] -= 1  # the line's end
    hashes, firsts = word_hashes(data)
    of = line[firsts]
    words = np.bincount(of, minlength=n).astype(float)
    again = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=n)
    length = kinds[:, :9].sum(axis=1)
    size, some = np.maximum(length, 1), np.maximum(words, 1)
    x = np.column_stack((
        np.ones(n), np.log1p(length) / 5, kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1), *(kinds[:, k] / size for k in (2, 3, 4, 5, 6, 7, 8)),
        length / some / 10, again / some, distinct / some, words < 4, length == 0,
    ))
    return x, length, n_lines


def _pieces(text: bytes | None):
    """A text in pieces of about BLOCK_BYTES, cut between lines."""
    text, at = text or b"", 0
    while len(text) - at > BLOCK_BYTES and (cut := text.find(b"\n", at + BLOCK_BYTES)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def blocks_of_features(texts: list[bytes | None]):
    """line_features of texts, a block of pieces at a time: (features, lengths, text of each piece, lines of each piece)."""
    held, of, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if held and size + len(piece) > BLOCK_BYTES:
                x, length, n_lines = line_features(held)
                yield x, length, of, n_lines
                held, of, size = [], [], 0
            held.append(piece)
            of.append(i)
            size += len(piece)
    if held:
        x, length, n_lines = line_features(held)
        yield x, length, of, n_lines


def places(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's place from its text's start, and from its end."""
    last, every = np.cumsum(n_lines), np.arange(int(n_lines.sum()))
    return every - np.repeat(last - n_lines, n_lines), np.repeat(last, n_lines) - 1 - every


def with_neighbours(x: np.ndarray, place: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Features with those of the line before and the one after."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[place == 0] = 0
    after[left == 0] = 0
    return np.concatenate((x, before, after), axis=1)


def _scan(steps: np.ndarray, place: np.ndarray, forward: bool) -> np.ndarray:
    """Products of the matrices from a text's start to each line (forward), or from each line to its end, up to a factor."""
    out, step = steps.copy(), 1
    while (at := np.flatnonzero(place >= step)).size:
        joined = out[at - step] @ out[at] if forward else out[at] @ out[at + step]
        out[at] = joined / joined.max(axis=(1, 2), keepdims=True)
        step *= 2
    return out


@dataclass
class Field:
    """A fitted field: weights of the good label, transition scores, and the curve from mean marginal to probability."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 8.0
    middle: float = 0.5

    def _steps(self, logit: np.ndarray, place: np.ndarray) -> np.ndarray:
        emit = np.exp(np.column_stack((np.minimum(-logit, 0), np.minimum(logit, 0))))
        steps = np.exp(self.moves)[None] * emit[:, None, :]
        steps[place == 0] = emit[place == 0][:, None, :]
        return steps

    def sides(self, logit: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line the weights of its two labels by the lines up to it, and by those behind it, up to a factor."""
        n = len(logit)
        ahead, tail = np.empty((n, 2)), np.empty((n, 2))
        cuts = list(range(0, n, BLOCK_LINES))
        for a in cuts:
            own = slice(a, min(n, a + BLOCK_LINES))
            here = np.minimum(place[own], np.arange(own.stop - a))
            done = _scan(self._steps(logit[own], place[own]), here, True)
            ahead[own] = done[:, 0, :]
            if len(over := np.flatnonzero(place[own] > here)):  # their text began in an earlier block
                ahead[a + over] = np.einsum("j,njk->nk", ahead[a - 1], done[over])
                ahead[a + over] /= ahead[a + over].max(axis=1, keepdims=True)
        for a in reversed(cuts):
            own = slice(a, min(n, a + BLOCK_LINES))
            here = np.minimum(left[own], own.stop - 1 - np.arange(a, own.stop))
            done = _scan(self._steps(logit[own], place[own]), here, False)
            tail[own] = done.sum(axis=2)
            if len(over := np.flatnonzero(left[own] > here)):
                tail[a + over] = done[over] @ tail[own.stop]
                tail[a + over] /= tail[a + over].max(axis=1, keepdims=True)
        behind = np.ones_like(tail)
        behind[:-1] = np.where(left[:-1, None] > 0, tail[1:], 1.0)
        return ahead, behind

    def marginals(self, logit: np.ndarray, place: np.ndarray, left: np.ndarray, pairs: bool = False):
        """Probability that each line is good; with pairs, also that of each pair of labels of a line and the one before."""
        ahead, behind = self.sides(logit, place, left)
        both = ahead * behind
        good = both[:, 1] / both.sum(axis=1)
        if not pairs:
            return good
        at = np.flatnonzero(place > 0)
        joint = ahead[at - 1][:, :, None] * self._steps(logit, place)[at] * behind[at][:, None, :]
        return good, at, joint / joint.sum(axis=(1, 2), keepdims=True)

    def lines(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability that each line is good, lines' lengths, and each text's number of lines."""
        parts = self.weights.reshape(3, N_FEATURES).T
        scores, lengths, n_lines = [], [], np.zeros(len(texts), dtype=np.int64)
        for x, length, of, n in blocks_of_features(texts):
            scores.append(x @ parts)
            lengths.append(length)
            np.add.at(n_lines, of, n)
        own, before, after = np.concatenate(scores).T
        place, left = places(n_lines)
        logit = own.copy()
        logit[1:] += np.where(place[1:] > 0, before[:-1], 0.0)
        logit[:-1] += np.where(left[:-1] > 0, after[1:], 0.0)
        return self.marginals(np.clip(logit, -30, 30), place, left), np.concatenate(lengths), n_lines

    def quality(self, texts: list[bytes | None]) -> np.ndarray:
        """Score of each text from 0 to 1."""
        if not texts:
            return np.empty(0)
        return 1 / (1 + np.exp(-self.slope * (_mean(*self.lines(texts)) - self.middle)))


def _mean(good: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    starts = np.cumsum(n_lines) - n_lines
    weight = np.maximum(length, 1e-3)
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def fit(texts: list[bytes | None], labels: list[int], rounds: int = 250, decay: float = 1e-3) -> Field:
    """A field for labelled texts (1 good, 0 bad). Without both labels every score is the share of good ones, or 0.5."""
    field = Field(np.zeros(3 * N_FEATURES), np.zeros((2, 2)))
    wanted = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        share = float(wanted.mean()) if labels else 0.5
        field.slope, field.middle = 1.0, 0.5 - (4.0 if share > 0.5 else -4.0 if share < 0.5 else 0.0)
        return field
    rng = np.random.default_rng(11)
    batches, held, size = [], [], 0
    counts = [(t or b"").count(b"\n") + 1 for t in texts]
    n_bad = sum(c for c, y in zip(counts, labels) if not y)
    n_good = sum(counts) - n_bad
    for i in rng.permutation(len(texts)).tolist():
        held.append(i)
        size += counts[i]
        if size >= BATCH_LINES:
            batches.append(held)
            held, size = [], 0
    if held:
        batches.append(held)
    made = []
    for batch in batches:
        n_lines = np.array([counts[i] for i in batch])
        x = np.concatenate([block[0] for block in blocks_of_features([texts[i] for i in batch])])
        place, left = places(n_lines)
        truth = np.repeat(wanted[batch], n_lines)
        weight = np.where(truth == 0, 0.5 / max(1, n_bad), 0.5 / max(1, n_good)) * (n_bad + n_good)
        made.append((with_neighbours(x, place, left).astype(np.float32), place, left, truth, weight))
    for turn in range(2):
        moments = [np.zeros(4 + 3 * N_FEATURES) for _ in range(2)]
        goals = []
        for full, place, left, truth, _ in made:
            found = field.marginals(np.clip(full @ field.weights, -30, 30), place, left) if turn else truth
            goals.append(np.where((truth == 0) & (found > 0.6), 1.0, truth) if turn else truth)
        for t in range(1, rounds + 1):
            (full, place, left, _, weight), truth = made[t % len(made)], goals[t % len(made)]
            good, at, joint = field.marginals(np.clip(full @ field.weights, -30, 30), place, left, pairs=True)
            kind = truth.astype(int)
            seen = np.zeros_like(joint)
            seen[np.arange(len(at)), kind[at - 1], kind[at]] = 1
            slope_w = full.T @ ((good - truth) * weight) / len(truth) + decay * field.weights
            slope_m = ((joint - seen) * weight[at, None, None]).sum(axis=0) / len(truth) + decay * field.moves
            slope = np.concatenate((slope_w, slope_m.ravel()))
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.99 * moments[1] + 0.01 * slope**2
            rate = 0.1 * min(1.0, 2 * (1 - t / (rounds + 1)))
            move = rate * moments[0] / (1 - 0.9**t) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
            field.weights = field.weights - move[:-4]
            field.moves = field.moves - move[-4:].reshape(2, 2)
    # the logistic curve from mean marginal to label, by Newton's method
    mean = _mean(*field.lines(texts))
    design, beta = np.column_stack((mean, np.ones(len(mean)))), np.array([8.0, -4.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, design.T @ (p - wanted) + 1e-2 * (beta - np.array([8.0, -4.0])))
    field.slope, field.middle = float(max(beta[0], 1e-3)), float(-beta[1] / max(beta[0], 1e-3))
    return field


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are never learnt: crc32 of its doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES) -> Field:
    """Fit on labelled documents that are not held out: at most max_docs, chosen by hash, of at most max_bytes each, and of these
    as many, in the order of their hashes, as have max_lines lines together. Ties of the hash go by doc_id, label and text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") <= max_bytes)
    rows = texts.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_docs).collect()
    upto = np.searchsorted(np.cumsum([bytes(r.text).count(b"\n") + 1 for r in rows]), max_lines, side="right")
    return fit([bytes(r.text) for r in rows[:upto]], [r.quality for r in rows[:upto]])


def score_quality(docs: DataFrame, field: Field) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted. Null and empty texts are scored as one empty line. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        fitted = sent.value
        return lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fitted.quality(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = map_chunks(rows, "text", make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs whose text the field finds good, with all their columns and their text as it was."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        fitted = sent.value
        for batch in chunked(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(fitted.quality(texts) >= 0.5))

    return map_batches(docs, run, docs.schema)
