"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes; two networks, one from each end, read each window, and every byte gets a
probability for each language from both states. A document's probabilities are the mean over its letters' bytes, all of them.
The network is trained in numpy by backpropagation through time, on a bounded sample of documents whose
language is known (MAX_DOCS of at most MAX_BYTES).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.batches import map_chunks

#: Bytes in a window, size of each direction's state, windows that are run together.
WINDOW, STATE, BATCH = 48, 8, 2048
#: The sample that it is trained on.
MAX_DOCS, MAX_BYTES, MAX_WINDOWS = 1500, 1 << 14, 12_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[0x80:] = True


def windows_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in rows of WINDOW (padded with blanks), and each text's number of rows (at least one)."""
    counts = np.array([max(1, -(-len(t or b"") // WINDOW)) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join((t or b"").ljust(int(c) * WINDOW) for t, c in zip(texts, counts)), dtype=np.uint8)
    return data.reshape(-1, WINDOW), counts


def _gate(x: np.ndarray, from_state: np.ndarray) -> np.ndarray:
    """A gate between 0 and 1, by softsign (a few plain operations where a logistic curve needs an exponential)."""
    x += from_state
    size = np.abs(x)
    size += 1
    x /= size
    x *= 0.5
    x += 0.5
    return x


def _steep(gate: np.ndarray) -> np.ndarray:
    """Derivative of _gate, from its value."""
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


@dataclass
class Network:
    """For each direction inputs (keep, reset and new; a row for each byte) and recurrent states; out and bias lead to languages."""

    langs: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.out, self.bias]

    def _step(self, side: int, codes: np.ndarray, h: np.ndarray):
        x, u = self.inputs[side], self.states[side]
        keep, reset = (_gate(x[k].take(codes, axis=0), h @ u[k]) for k in (0, 1))
        inner = h @ u[2]
        new = reset * inner
        new += x[2].take(codes, axis=0)
        size = np.abs(new)
        size += 1
        new /= size
        return new + keep * (h - new), keep, reset, new, inner

    def positions(self, rows: np.ndarray):
        """For each place in the windows, from the last: its number and probabilities of languages (a row for each window)."""
        h = np.zeros((len(rows), STATE), dtype=np.float32)
        ahead = np.empty((WINDOW, len(rows), len(self.langs)), dtype=np.float32)
        columns = np.ascontiguousarray(rows.T)
        for t in range(WINDOW):
            h = self._step(0, columns[t], h)[0]
            ahead[t] = h @ self.out[0]
        h = np.zeros_like(h)
        ones = np.ones((len(self.langs), len(self.langs)), dtype=np.float32)
        for t in reversed(range(WINDOW)):
            h = self._step(1, columns[t], h)[0]
            logits = h @ self.out[1]
            logits += ahead[t]
            logits += self.bias
            np.clip(logits, -40, 40, out=logits)
            np.exp(logits, out=logits)
            logits /= logits @ ones
            yield t, logits

    def probabilities(self, texts: list[bytes | None]) -> np.ndarray:
        """A row for each text: mean probability of each language over bytes of letters (all bytes if there is none)."""
        rows, counts = windows_of(texts)
        mask = _LETTER[rows]
        starts = np.cumsum(counts) - counts
        letters = np.add.reduceat(mask.sum(axis=1), starts)
        mask[np.repeat(letters == 0, counts)] = True
        total = np.zeros((len(rows), len(self.langs)))
        for at in range(0, len(rows), BATCH):
            part, own = total[at : at + BATCH], np.ascontiguousarray(mask[at : at + BATCH].T)
            for t, p in self.positions(rows[at : at + BATCH]):
                p *= own[t][:, None]
                part += p
        pooled = np.add.reduceat(total, starts, axis=0)
        return pooled / pooled.sum(axis=1, keepdims=True)

    def labels(self, text: bytes) -> list[str]:
        """The language of every byte of a text."""
        rows, _ = windows_of([text])
        out = np.empty(rows.shape, dtype=np.int64)
        for t, p in self.positions(rows):
            out[:, t] = p.argmax(axis=1)
        return [self.langs[k] for k in out.ravel()[: len(text)]]

    def slopes(self, rows: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the letters' bytes of windows with known languages, and its derivatives."""
        columns, mask = np.ascontiguousarray(rows.T), _LETTER[rows].T.astype(np.float32)
        n, size = len(rows), max(1.0, float(mask.sum()))
        kept: list[list[tuple]] = [[], []]
        hidden = np.zeros((2, WINDOW, n, STATE), dtype=np.float32)
        for side, order in enumerate((range(WINDOW), reversed(range(WINDOW)))):
            h = np.zeros((n, STATE), dtype=np.float32)
            for t in order:
                before = h
                h, *gates = self._step(side, columns[t], before)
                kept[side].append((t, before, *gates))
                hidden[side, t] = h
        logits = hidden[0] @ self.out[0] + hidden[1] @ self.out[1] + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        right = p[:, np.arange(n), truth]
        loss = float(-(np.log(right + 1e-9) * mask).sum() / size)
        p[:, np.arange(n), truth] -= 1
        p *= mask[:, :, None] / size
        flat = p.reshape(-1, len(self.langs))
        d_out = [hidden[s].reshape(-1, STATE).T @ flat for s in (0, 1)]
        d_inputs, d_states = [], []
        for side in (0, 1):
            d_h, d_u = np.zeros((n, STATE), dtype=np.float32), np.zeros_like(self.states[side])
            d_x, codes = np.empty((3, WINDOW, n, STATE), dtype=np.float32), np.empty((WINDOW, n), dtype=np.uint8)
            from_out = p @ self.out[side].T
            for k, (t, before, keep, reset, new, inner) in enumerate(reversed(kept[side])):
                d_h += from_out[t]
                d_new = d_h * (1 - keep) * (1 - np.abs(new)) ** 2
                d_keep, d_reset = d_h * (before - new) * _steep(keep), d_new * inner * _steep(reset)
                d_x[:, k] = d_keep, d_reset, d_new
                codes[k] = columns[t]
                d_h = d_h * keep
                for g, d in enumerate((d_keep, d_reset, d_new * reset)):
                    d_u[g] += before.T @ d
                    d_h += d @ self.states[side][g].T
            order = np.argsort(codes.ravel(), kind="stable")
            sorted_codes = codes.ravel()[order]
            firsts = np.flatnonzero(np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])))
            d_in = np.zeros_like(self.inputs[side])
            for g in range(3):
                d_in[g, sorted_codes[firsts]] = np.add.reduceat(d_x[g].reshape(-1, STATE)[order], firsts, axis=0)
            d_inputs.append(d_in)
            d_states.append(d_u)
        return loss, [*d_inputs, *d_states, *d_out, flat.sum(axis=0)]


def train(texts: list[bytes], langs: list[str], steps: int = 260, size: int = 256, seed: int = 5) -> Network:
    """A network for texts of known languages; every language gets as many windows in each step. Texts without letters teach nothing."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(names, [make(3, 256, STATE, scale=0.5) for _ in "ab"], [make(3, STATE, STATE, scale=0.3) for _ in "ab"], [make(STATE, len(names), scale=0.3) for _ in "ab"], np.zeros(len(names), dtype=np.float32))
    if len(names) < 2:
        return net
    rows, counts = windows_of(texts)
    truth = np.repeat(np.array([names.index(x) for x in langs]), counts)
    some = _LETTER[rows].any(axis=1)
    pools = [np.flatnonzero(some & (truth == k)) for k in range(len(names))]
    pools = [rng.permutation(x)[: MAX_WINDOWS // len(names)] for x in pools if len(x)]
    if not pools:  # no text has a letter
        return net
    moments = [[np.zeros_like(w) for w in net.weights()] for _ in range(2)]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(x, size // len(pools)) for x in pools])
        _, slopes = net.slopes(rows[at], truth[at])
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), slopes, *moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document's language is never learnt: crc32 of its doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train_on(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Network:
    """Train on documents that are not held out and have a language: at most max_docs, chosen by hash, of at most max_bytes each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "lang")
    fit = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= max_bytes))
    chosen = fit.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_docs)
    found = fit.join(F.broadcast(chosen), ["doc_id", "lang"]).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(max_docs).collect()
    return train([bytes(r.text) for r in found], [r.lang for r in found])


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """For each row of docs: doc_id, held_out, lang_pred, score.

    A null text and one without a letter are ``und`` with score 0, as is every text if no language was learnt.
    Texts are read whole. Other columns, language included, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        trained = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = trained.probabilities(batch.column("text").to_pylist()) if trained.langs else np.zeros((batch.num_rows, 1))
            names = trained.langs or ["und"]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("letters"), pa.array([names[k] for k in p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))], names=["doc_id", "letters", "lang", "p"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("binary").alias("text"))
    scored = map_chunks(rows, "text", make, "doc_id long, letters boolean, lang string, p double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("p")).otherwise(0.0).alias("score"))
