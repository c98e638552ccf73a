"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``compile_model`` turns a model into three machines:

* the normaliser rewrites the longest match of its rules at each place, and turns a space into the mark;
* the pieces are a trie over characters; a path from its root to a final state puts out a piece at the piece's cost;
* the byte fallback has an arc for every character that the pieces don't cover; it puts out the character's bytes.

A text is normalised, cut into words, and each word composed with the other two machines. The states of the composition are
(place in the word, state of the trie); its arcs are found for all places of many words at a time, then relaxed
in the tropical semiring (costs add along a path, the least wins) from left to right, and the path of least cost is read
back. ``Encoder.shortest_paths`` is that one routine for both kinds of model:

* In a unigram model a piece costs minus its score, and nothing depends on the piece before.
* In a BPE model pieces cost nothing and the cost stands on neighbours: 0 if the merges, applied to the two pieces'
  characters, give just these two, infinite if not. The merges split a text in a way if and only if all its neighbours
  are such pairs, so exactly one path to every place is finite, and a place needs to know only its own last piece.

Pieces never reach over the start of a word or a line break (checked when the model is compiled), so texts are composed
word by word; a word falls apart further at places that no arc reaches over. A task keeps the paths of words it has met,
up to a bound, and drops them when it ends.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hushframe.llm.batches import map_batches, map_chunks
from hushframe.llm.shingles import mixed

MARK = "▁"
#: Words that a task keeps before it starts anew; longer words are not kept. About 30 MB at most.
MEMORY, LONG = 100_000, 64
#: Places for costs of pairs that a task keeps (as a power of two; 9 bytes each), and characters that are composed at a time;
#: a character's arcs take up to some hundred bytes.
PAIRS, SEGMENT = 20, 1 << 17
#: Where the public model lies; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What an arc of the byte fallback costs: more than any path of pieces.
FALLBACK = 1e6


@dataclass
class Model:
    """A compiled model; name is its file's digest.

    The pieces' trie: symbols are the characters that have arcs; arcs holds state * len(symbols) + symbol in order, targets
    the states they lead to, and final the piece that ends in a state, or -1. State 0 is the root.
    """

    name: str
    kind: str
    pieces: list[str]
    cost: list[float]
    byte_ids: list[int]
    surface: list[bytes]
    symbols: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    arcs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    targets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    final: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    prefix: bool = True
    #: Rules of the normaliser by their first character, the longest first; whether runs of spaces become one and ends are cut.
    rules: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    trims: bool = False
    rank: dict[str, float] = field(default_factory=dict)
    #: Of a BPE piece: the two pieces that its last merge joins, and when: (the latest merge within it, its own merge).
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)
    when: dict[str, tuple[float, float]] = field(default_factory=dict)

    def build(self, numbers: list[int]) -> None:
        """Compile the trie of these pieces."""
        letters = sorted({c for i in numbers for c in self.pieces[i]})
        number_of = {c: k for k, c in enumerate(letters)}
        arcs: dict[int, int] = {}
        final = [-1]
        for i in numbers:
            state = 0
            for c in self.pieces[i]:
                key = state * len(letters) + number_of[c]
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(-1)
                state = arcs[key]
            final[state] = i
        self.symbols, self.final = np.array([ord(c) for c in letters], dtype=np.int64), np.array(final, dtype=np.int64)
        self.arcs = np.array(sorted(arcs), dtype=np.int64)
        self.targets = np.array([arcs[k] for k in self.arcs.tolist()], dtype=np.int64)

    def normalise(self, text: str) -> str:
        """The text as the normaliser machine puts it out, before spaces become marks."""
        if self.rules and any(c in self.rules for c in set(text)):
            out, at = [], 0
            while at < len(text):
                one, other = next(((a, b) for a, b in self.rules.get(text[at], ()) if text.startswith(a, at)), (text[at], text[at]))
                out.append(other)
                at += len(one)
            text = "".join(out)
        return re.sub(" +", " ", text).strip(" ") if self.trims else text


def character_map(blob: bytes) -> dict[str, list[tuple[str, str]]]:
    """The rules of a model file's compiled character map: a double array over bytes, then the replacements, each ended by a zero."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts, letters = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :], np.arange(1, 256)
    base = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    rules: dict[str, list[tuple[str, str]]] = {}
    stack = [(int(base(units[0])), b"")]
    while stack:
        at, key = stack.pop()
        places = at ^ letters
        there = letters[places < len(units)]
        for byte in there[units[at ^ there] & ((1 << 31) | 0xFF) == there].tolist():
            place = at ^ byte
            own, after = int(units[place]), place ^ int(base(units[place]))
            if own >> 8 & 1:
                start = int(units[after]) & ((1 << 31) - 1)
                one = (key + bytes([byte])).decode()
                rules.setdefault(one[0], []).append((one, texts[start : texts.index(0, start)].decode()))
            stack.append((after, key + bytes([byte])))
    return {first: sorted(some, key=lambda r: -len(r[0])) for first, some in rules.items()}


def compile_model(path: str) -> Model:
    """Read a model file. ValueError if the model has what the machines don't express: no byte fallback, user-defined
    symbols, spaces kept as spaces or put behind words, pieces over a word's start or a line break, word or character kind."""
    with open(path, "rb") as f:
        return compile_bytes(f.read())


def compile_bytes(data: bytes) -> Model:
    """compile_model for the bytes of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    trainer, rules = proto.trainer_spec, proto.normalizer_spec
    if not rules.escape_whitespaces or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback or trainer.model_type not in (1, 2):
        raise ValueError("this model's kind is not supported")
    kinds = type(proto.pieces[0])
    normal = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
    if any(p.type == kinds.USER_DEFINED for p in proto.pieces) or any(MARK in p.lstrip(MARK) or "\n" in p for p in normal):
        raise ValueError("this model has pieces that reach over a word's start")
    byte_ids = [0] * 256
    surface = []
    for i, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            surface.append(bytes([int(p.piece[3:5], 16)]))
        else:
            surface.append(p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"")
    bpe = trainer.model_type == 2
    model = Model(
        hashlib.sha256(data).hexdigest(), "bpe" if bpe else "unigram", [p.piece for p in proto.pieces], [0.0 if bpe else -p.score for p in proto.pieces], byte_ids, surface,
        prefix=rules.add_dummy_prefix, rules=character_map(rules.precompiled_charsmap), trims=rules.remove_extra_whitespaces, rank=normal if bpe else {},
    )
    for p in sorted(normal, key=len) if bpe else ():
        steps: list[tuple[str, str]] = []
        if merges(p, normal, steps) == [p]:
            if steps:
                model.halves[p] = steps[-1]
                model.when[p] = (max(-normal[p], *(model.when[x][0] for x in steps[-1])), -normal[p])
            else:
                model.when[p] = (-math.inf, -math.inf)
    numbers = [i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
    for i in numbers if bpe else ():
        if model.pieces[i] not in model.when:  # merges can't make it
            model.cost[i] = math.inf
    model.build(numbers)
    return model


def merges(text: str, rank: dict[str, float], steps: list[tuple[str, str]] | None = None) -> list[str]:
    """The pieces after all merges: the pair of the highest score first, of equal ones the leftmost. steps: gets the pairs merged.

    Compiles the pairs' machine and is what its results are tested against; texts are not encoded by it.
    """
    symbols: list[str] = list(text)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    queue: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(symbols) and (score := rank.get(symbols[i] + symbols[j])) is not None:
            heapq.heappush(queue, (-score, i, symbols[i], symbols[j]))

    for i in range(len(symbols)):
        offer(i)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right or not left:
            continue
        if steps is not None:
            steps.append((left, right))
        symbols[i], symbols[j] = left + right, ""
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s]


_NEVER = (math.inf, math.inf)


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted_values, and whether they are there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


class Encoder:
    """A model's machines, and the paths of the words that a task has met."""

    def __init__(self, model: Model):
        self.model = model
        self.cost = np.array([*model.cost, FALLBACK])  # of piece -1, the fallback, too
        self.byte_ids = np.array(model.byte_ids, dtype=np.int32)
        self.words: dict[str, bytes] = {"": b""}
        self.edges: tuple[dict[int, list[str]], dict[int, list[str]]] = ({}, {})
        self.pair_keys = np.full(1 << PAIRS, -1, dtype=np.int64)
        self.barred = np.zeros(1 << PAIRS, dtype=bool)

    def _edge(self, piece: int, side: int) -> list[str]:
        """The pieces at one end (0 left, 1 right) of a piece while it is merged, the last first."""
        out = self.edges[side].get(piece)
        if out is None:
            out = self.edges[side][piece] = [self.model.pieces[piece]]
            while (two := self.model.halves.get(out[-1])) is not None:
                out.append(two[side])
        return out

    def _barred(self, left: int, right: int) -> bool:
        """Whether a piece can't stand behind another: a merge joins their ends while both are made."""
        when, rank = self.model.when, self.model.rank
        ends, starts = self._edge(left, 1), self._edge(right, 0)
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            joined = rank.get(ends[i] + starts[j])
            mine = when[ends[i - 1]] if i else _NEVER
            other = when[starts[j - 1]] if j else _NEVER
            # of merges at one time the leftmost goes first: within left, over the border, within right
            if joined is not None:
                over = (max(when[ends[i]][0], when[starts[j]][0], -joined), -joined)
                if over < mine and over <= other:
                    return True
            if not i and not j:
                return False
            if mine <= other:
                i -= 1
            else:
                j -= 1

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Costs of pairs; those met lately are kept, each at the place that its hash says."""
        keys = (left << 32) | right
        at = (mixed(keys.view(np.uint64)) >> np.uint64(64 - PAIRS)).astype(np.int64)
        barred, new = self.barred[at], self.pair_keys[at] != keys
        if new.any():
            fresh, place = np.unique(keys[new], return_inverse=True)
            barred[new] = np.array([self._barred(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()])[place]
            self.pair_keys[at[new]], self.barred[at[new]] = keys[new], barred[new]
        return np.where(barred, np.inf, 0.0)

    def _arcs(self, codes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all arcs over words that lie end to end; limit is the end of each place's word."""
        model = self.model
        symbol, known = _find(model.symbols, codes)
        symbol[~known] = -1
        starts, ends, pieces = [], [], []
        at, state, size = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        alone = np.ones(len(codes), dtype=bool)
        while len(at):
            inside = at + size < limit[at]
            at, state = at[inside], state[inside]
            step = symbol[at + size]
            arc, there = _find(model.arcs, state * len(model.symbols) + step)
            there &= step >= 0
            at, state, size = at[there], model.targets[arc[there]], size + 1
            piece = model.final[state]
            whole = piece >= 0
            starts.append(at[whole])
            ends.append(at[whole] + size)
            pieces.append(piece[whole])
            if size == 1:
                alone[at[whole]] = False
        rest = np.flatnonzero(alone)  # no piece is this character: it falls back to its bytes
        return np.concatenate([*starts, rest]), np.concatenate([*ends, rest + 1]), np.concatenate([*pieces, np.full(len(rest), -1)])

    def shortest_paths(self, words: list[str]) -> list[np.ndarray]:
        """The ids along the path of least cost over each word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        n, lengths = len(codes), np.array([len(w) for w in words], dtype=np.int64)
        word_ends = np.cumsum(lengths)
        start, end, piece = self._arcs(codes, np.repeat(word_ends, lengths))
        # parts: between places that no arc reaches over
        over = np.cumsum(np.bincount(start + 1, minlength=n + 2) - np.bincount(end, minlength=n + 2))[:n]
        heads = np.flatnonzero(over == 0)
        head = np.repeat(heads, np.diff(np.concatenate((heads, [n]))))
        usable = np.isfinite(self.cost[piece])
        start, end, piece = start[usable], end[usable], piece[usable]
        depth = start - head[start]
        order = np.argsort(depth.astype(np.uint16) if n < 1 << 16 or depth.max() < 1 << 16 else depth, kind="stable")
        start, end, piece, depth = start[order], end[order], piece[order], depth[order]
        bounds = np.searchsorted(depth, np.arange(depth[-1] + 2 if len(depth) else 1)).tolist()
        # least cost of the paths to the place behind each character, and the arc that it comes by
        best, come, last = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            s, e, p = start[a:b], end[a:b] - 1, piece[a:b]
            weight = self.cost[p] + (best[s - 1] if k else 0.0)
            better = weight < best[e]
            s, e, p, weight = s[better], e[better], p[better], weight[better]
            if k and self.model.kind == "bpe":
                both = np.flatnonzero((last[s - 1] >= 0) & (p >= 0))
                weight[both] += self._pairs(last[s[both] - 1], p[both])
                better = np.isfinite(weight)
                s, e, p, weight = s[better], e[better], p[better], weight[better]
            best[e], come[e], last[e] = weight, s, p
        taken = np.zeros(n, dtype=bool)
        at = np.concatenate((heads[1:], [n]))[: len(heads)] - 1
        while len(at):
            taken[at] = True
            at = come[at][come[at] > head[at]] - 1
        places = np.flatnonzero(taken)
        ids, bounds = last[places].astype(np.int32), np.searchsorted(places, np.concatenate(([0], word_ends)))
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            as_bytes = [chr(c).encode() for c in codes[places[bare]].tolist()]
            repeats = np.ones(len(ids), dtype=np.int64)
            repeats[bare] = [len(x) for x in as_bytes]
            moved = np.concatenate(([0], np.cumsum(repeats)))
            ids, bounds = np.repeat(ids, repeats), moved[bounds]
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(as_bytes), dtype=np.uint8)]
        return [ids[a:b] for a, b in zip(bounds.tolist(), bounds.tolist()[1:])]

    def _units(self, text: str, first: bool) -> list[str]:
        """The words of a normalised text, marks instead of spaces."""
        padded = " " + text if first and self.model.prefix else text
        if "  " in padded or MARK in padded or padded[:1] != " ":
            return _UNIT.findall(padded.replace(" ", MARK))
        return padded.replace(" ", " " + MARK).replace("\n", " \n ").split(" ")

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of texts; a null text has none."""
        parts: list[tuple[int, list[str]]] = []
        missing: dict[str, None] = {}
        out: list[list[bytes]] = [[] for _ in texts]
        held = 0

        def settle() -> None:
            nonlocal held
            if len(self.words) > MEMORY:
                self.words = {"": b""}
                missing.update(dict.fromkeys([u for _, units in parts for u in units if u]))
            known = self.words
            for word, ids in zip(missing, self.shortest_paths(list(missing)) if missing else ()):
                known[word] = ids.tobytes()
            for i, units in parts:
                out[i].append(b"".join(map(known.__getitem__, units)))
            for word in missing:
                if len(word) > LONG:
                    del known[word]
            parts.clear()
            missing.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece, first in _segments(self.model.normalise(text)) if text else ():
                units = self._units(piece, first)
                missing.update(dict.fromkeys([u for u in units if u not in self.words]))
                parts.append((i, units))
                held += len(piece)
                if held >= SEGMENT:
                    settle()
        settle()
        return [np.frombuffer(b"".join(x), dtype="<i4") for x in out]


def _segments(text: str):
    """A text in parts of about SEGMENT characters, cut in front of words, and whether each is the first."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = text.rfind(" ", at + 1, at + SEGMENT)
        if cut < 0:
            cut = text.find(" ", at + SEGMENT)
        while cut > at and text[cut - 1] in (" ", MARK):
            cut -= 1
        if cut <= at:
            break
        yield text[at:cut], at == 0
        at = cut
    if at < len(text):
        yield text[at:], at == 0


_UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Decoder:
    """Pieces' texts, end to end."""

    def __init__(self, model: Model):
        self.prefix = model.prefix
        self.sizes = np.array([len(s) for s in model.surface], dtype=np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.data = np.frombuffer(b"".join(model.surface), dtype=np.uint8)

    def decode_all(self, lists: list[np.ndarray]) -> list[str]:
        """The texts of lists of piece ids: their surfaces, without the mark that the normaliser put in front."""
        ids = np.concatenate(lists) if lists else np.empty(0, np.int32)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        from_ = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        data = self.data[from_ + np.arange(len(from_))].tobytes()
        at = np.concatenate(([0], ends))[np.cumsum([0, *map(len, lists)])].tolist()
        texts = (data[a:b] for a, b in zip(at, at[1:]))
        return [(x[1:] if self.prefix and x[:1] == b" " else x).decode("utf-8", "replace") for x in texts]


def _lists(ids: list[np.ndarray], null: pa.Array) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)), mask=null)


def _sent(spark: SparkSession, model: str | Model) -> Broadcast:
    return spark.sparkContext.broadcast(compile_model(model) if isinstance(model, str) else model)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(encoder: Encoder, batch: pa.RecordBatch) -> tuple[list[str | None], list[np.ndarray], pa.RecordBatch]:
    """A batch's texts, their ids, and columns doc_id, ids and n_fallback."""
    texts = batch.column("text").to_pylist()
    ids = encoder.encode_all(texts)
    is_byte = np.zeros(len(encoder.model.surface), dtype=bool)
    is_byte[encoder.model.byte_ids] = True
    fallback = [int(is_byte[x].sum()) for x in ids]
    return texts, ids, pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids, batch.column("text").is_null()), pa.array(fallback, pa.int64())], names=["doc_id", "ids", "n_fallback"])


def encode(docs: DataFrame, model: str | Model = MODEL) -> DataFrame:
    """(doc_id, text, ids, n_fallback) for each row of docs: the piece ids of the whole text, and how many stand for bytes.

    A null text has null ids, an empty one has none. Rows are independent: repeated rows repeat, and doc_id may be null.
    Other columns are ignored. The broadcast model is as large as its vocabulary, whatever the input.
    """
    sent = _sent(docs.sparkSession, model)

    def make():
        encoder = Encoder(sent.value)
        return lambda batch: _encoded(encoder, batch)[2].add_column(1, "text", batch.column("text"))

    return map_chunks(_rows(docs), "text", make, "doc_id long, text string, ids array<int>, n_fallback long", SEGMENT)


def decode(encoded: DataFrame, model: str | Model = MODEL) -> DataFrame:
    """encoded (with a column ids) with a column decoded: the text of each row's ids; null ids give null."""
    sent = _sent(encoded.sparkSession, model)

    def run(batches):
        decoder = Decoder(sent.value)
        for batch in batches:
            for start in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(start, 256)
                column = part.column("ids")
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                texts = decoder.decode_all([values[a:b] for a, b in zip(offsets, offsets[1:])])
                yield part.append_column("decoded", pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False)))

    return map_batches(encoded, run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def encode_and_decode(docs: DataFrame, model: str | Model = MODEL) -> DataFrame:
    """(doc_id, ids, n_fallback, decoded, round_trip) for each row of docs in one pass; see encode and decode.

    round_trip: the decoded text is the text. False only where the text has the mark itself, or the normaliser changes it.
    """
    sent = _sent(docs.sparkSession, model)

    def make():
        encoder, decoder = Encoder(sent.value), Decoder(sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, ids, out = _encoded(encoder, batch)
            decoded = [None if t is None else d for t, d in zip(texts, decoder.decode_all(ids))]
            return out.append_column("decoded", pa.array(decoded, pa.string())).append_column("round_trip", pa.array([t == d for t, d in zip(texts, decoded)]))

        return work

    return map_chunks(_rows(docs), "text", make, "doc_id long, ids array<int>, n_fallback long, decoded string, round_trip boolean", SEGMENT)


def round_trips(docs: DataFrame, model: str | Model = MODEL) -> DataFrame:
    """For each row of docs: doc_id, n_pieces, n_fallback, ids_sha256 (ids in decimal, blanks between), decoded_sha256 and
    round_trip (see encode_and_decode). Null text: null digests."""
    return encode_and_decode(docs, model).select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "n_fallback",
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip",
    )
