"""Near-duplicate join on word shingles by adaptive multi-match prefixes.

Every pair with a Jaccard similarity of 0.75 or more is found, up to pairs whose ends are known to be connected already.

1. One scan reduces each text to its shingle set's digest and size; equal sets are one node from here on. The same scan
   counts shingles inside windows of the scan; those that hold more than one in 2**19 of all shingles (so fewer than
   2**19 of them) are broadcast with their counts as estimates.
2. A set's tokens are ordered by estimated count, then hash. If two sets are similar, their prefixes of
   ``n - ceil(0.75 n) + l`` tokens share at least l tokens. The second scan picks each document's l: a longer prefix
   costs more postings, but demands more shared tokens, so fewer candidates need verification; with the estimated
   counts the cost of each l is known, and the cheapest is taken.
3. Prefix tokens go to owner tasks, packed by ranges of hashes; owners keep tokens that two nodes share. Tokens on the
   broadcast list are shared anyway and are not sent to owners.
4. Every token's centre is the node with the smallest part of tokens that nobody shares: in a group of near copies that is
   the one least edited, to which all others that can have links at all are similar. Nodes are verified against their
   tokens' centres, and components built.
5. Only then pairs of different components are joined, and only at tokens behind which both still have the tokens that
   they must share (rare tokens come first); so a group of thousands of near copies never becomes all its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.batches import chunked, map_batches, map_chunks
from hushframe.llm.components import connected
from hushframe.llm.shared import broadcast_if_small, join_per_key, stored
from hushframe.llm.shingles import shingle_sets

#: Similarity is at least 75 / 100.
PERCENT = 75
#: Shingles with more than one in so many of all shingles are broadcast; at most so many can be.
FREQUENT = 1 << 19
#: Postings that are counted together (for the estimates) or packed together.
WINDOW = 1 << 20
#: Postings that an owner handles at a time, about.
OWNED = 1 << 20
#: What verifying a candidate costs, in postings, and how many others share a token that is not frequent, by estimate.
VERIFY, RARE = 64.0, 0.1

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("token", pa.int64()), ("count", pa.int64()), ("node", pa.int64())])


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") >> 1


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of sorted values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(values)])))


def _summaries(batches):
    """A row for each document, and rows (token, count, node) for shingles that three texts of a window share."""
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    nodes: list[int] = []

    def counted():
        tokens = np.concatenate(held) if held else np.empty(0, np.uint64)
        whose = np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in held])
        order = np.argsort(tokens, kind="stable")
        tokens, whose = tokens[order], whose[order]
        starts, lengths = _runs(tokens)
        least = np.minimum.reduceat(whose, starts) if len(starts) else whose
        keep = lengths >= 3
        k = int(keep.sum())
        held.clear()
        nodes.clear()
        none = pa.nulls(k, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(k, pa.binary()), pa.array(tokens[starts][keep].view(np.int64)), pa.array(lengths[keep]), pa.array(least[keep])], schema=_SETS)

    size = 0
    for batch in chunked(batches, "text"):
        sets = shingle_sets(batch.column("text").to_pylist())
        digests = [_digest(x) for x in sets]
        k = len(sets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([_node(x) for x in digests], pa.int64())], schema=_SETS)
        for x, digest in zip(sets, digests):
            if len(x) and digest not in seen:
                seen.add(digest)
                held.append(x)
                nodes.append(_node(digest))
                size += len(x)
        if size >= WINDOW:
            yield counted()
            size = 0
    yield counted()


def needed(n: int) -> int:
    """Tokens that a set of n shares with any similar set."""
    return -(-PERCENT * n // 100)


def choose_length(n: int, frequent: np.ndarray) -> int:
    """The l of least estimated cost for a set of n tokens; frequent: counts of its frequent tokens, ascending (its last tokens)."""
    base, most = n - needed(n), needed(n)
    steps = np.arange(1, min(most, 1 + n // 4) + 1)
    others = np.concatenate((np.zeros(1), np.cumsum(frequent)))
    in_prefix = base + steps
    beyond = np.clip(in_prefix - (n - len(frequent)), 0, len(frequent))
    met = RARE * (in_prefix - beyond) + others[beyond]
    return int(steps[np.argmin(in_prefix + met * (1 + VERIFY / steps))])


def _prefixes(frequent: tuple[np.ndarray, np.ndarray], buckets: int, pack: bool):
    """pack: postings packed by bucket (bucket, payload); else a row for each document, and one for each of its frequent tokens.

    The postings are made in a scan of their own, as they go straight to the owners and are stored nowhere.
    """
    known, counts = frequent
    shift = np.uint64(64 - buckets.bit_length() + 1)
    schema = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("l", pa.int64()), ("token", pa.int64())])

    def rows(bucket=(), payload=(), node=(), label=(), n=(), least=(), token=()):
        k = max(map(len, (bucket, node, label)))
        cols = [(bucket, pa.int32()), (payload, pa.binary()), (node, pa.int64()), (label, pa.int64()), (n, pa.int64()), (least, pa.int64()), (token, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) if len(c) else pa.nulls(k, t) for c, t in cols], schema=schema)

    def run(batches):
        seen: set[bytes] = set()
        tokens, labels, size = [], [], 0

        def packed():
            t, w = np.concatenate(tokens), np.concatenate(labels)
            order = np.argsort(t, kind="stable")
            t, w = t[order], w[order]
            bounds = np.searchsorted(t >> shift, np.arange(buckets + 1, dtype=np.uint64)) if buckets > 1 else np.array([0, len(t)])
            some = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            tokens.clear()
            labels.clear()
            return rows(bucket=some, payload=[t[bounds[b] : bounds[b + 1]].tobytes() + w[bounds[b] : bounds[b + 1]].tobytes() for b in some])

        for batch in chunked(batches, "text"):
            about, shared = [], []
            for x in shingle_sets(batch.column("text").to_pylist()):
                n = len(x)
                if not n or (digest := _digest(x)) in seen:
                    continue
                seen.add(digest)
                at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
                hot = known[at] == x if len(known) else np.zeros(n, dtype=bool)
                where = at[hot]
                where = where[np.argsort(counts[where], kind="stable")]
                least = choose_length(n, counts[where].astype(float) - 1)
                length = n - needed(n) + least
                rare = x[~hot][:length]
                node = _node(digest)
                label = node
                if pack:
                    tokens.append(rare)
                    labels.append(np.full(len(rare), label, dtype=np.int64))
                    size += len(rare)
                    continue
                about.append((node, label, n, least))
                shared += [(label, int(known[i].view(np.int64))) for i in where[: length - len(rare)]]
            if about:
                node, label, n, least = zip(*about)
                yield rows(node=node, label=label, n=n, least=least)
            if shared:
                label, token = zip(*shared)
                yield rows(label=label, token=token)
            if size >= WINDOW:
                yield packed()
                size = 0
        if tokens:
            yield packed()

    return run


def _owned(batches):
    """Packed postings, sorted by bucket, to rows (token, label) of tokens that several nodes have."""
    schema = pa.schema([("token", pa.int64()), ("label", pa.int64())])
    bucket, tokens, labels = None, [], []

    def live():
        t, w = np.concatenate(tokens), np.concatenate(labels)
        order = np.lexsort((w, t))
        t, w = t[order], w[order]
        keep = np.concatenate(([True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])))
        t, w = t[keep], w[keep]
        starts, lengths = _runs(t)
        many = np.repeat(lengths > 1, lengths)
        tokens.clear()
        labels.clear()
        return pa.RecordBatch.from_arrays([pa.array(t[many].view(np.int64)), pa.array(w[many])], schema=schema)

    for batch in batches:
        for b, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
            if b != bucket and tokens:
                yield live()
            bucket, data = b, np.frombuffer(payload.as_buffer(), dtype=np.uint64)
            tokens.append(data[: len(data) // 2])
            labels.append(data[len(data) // 2 :].view(np.int64))
    if tokens:
        yield live()


def _similar(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (a, b) whose sets are similar."""
    keep = []
    for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return batch.select(["a", "b"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (label, tokens) are similar."""
    a, b = (sets.select(F.col("label").alias(x), F.col("tokens").alias(f"set_{x}")) for x in "ab")
    return map_chunks(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), "set_a", lambda: _similar, "a long, b long", 8 << 20).distinct()


def _sized() -> Column:
    """Whether sizes n_a and n_b allow similarity."""
    return 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")


def _must() -> Column:
    """Tokens that prefixes of similar sets share at least, by n and l of both.

    Similar sets share at least 3/7 of their sizes' sum. Of these at most n - prefix lie behind the prefix that ends
    first; all others are in both prefixes. So sets of like sizes must share far more than the smaller l.
    """
    overlap = F.ceil(PERCENT * (F.col("n_a") + F.col("n_b")) / (100 + PERCENT))
    behind = F.greatest(*[F.ceil(PERCENT * F.col(f"n_{x}") / 100) - F.col(f"l_{x}") for x in "ab"])
    return F.greatest(F.least("l_a", "l_b").cast("long"), overlap - behind)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Two texts link if their sets of five-word shingles (words: runs without white space, A-Z lower-cased; a shorter text
    is one shingle) have a Jaccard similarity of 0.75 or more. component_id is the smallest doc_id that links reach.
    A null, empty or blank text has no shingle, links with nothing and is its own component, as is every
    row without doc_id. Repeated rows get repeated results. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scanned = stored(map_batches(rows, _summaries, "doc_id long, n long, digest binary, token long, count long, node long"), "join-sets")
    own = scanned.filter("n IS NOT NULL").select("doc_id", "n", "digest", "node")
    groups = stored(own.filter("n > 0").groupBy("digest", "node", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "join-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0

    estimates = stored(scanned.filter("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")), "join-estimates")
    share = FREQUENT  # tasks count repeated texts each for itself, so the list is counted before it is collected
    while (often := estimates.filter(F.col("count") * share > total)).count() > FREQUENT:
        share //= 2
    listed = often.select("token", "count").toArrow()
    known = listed["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    sent = spark.sparkContext.broadcast((known[order], listed["count"].to_numpy().astype(np.int64)[order]))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, 0.3 * total / OWNED))))

    def described(batches):
        return _prefixes(sent.value, buckets, False)(batches)

    def postings(batches):
        return _prefixes(sent.value, buckets, True)(batches)

    schema = "bucket int, payload binary, node long, label long, n long, l long, token long"
    made = stored(map_batches(rows, described, schema).drop("bucket", "payload"), "join-prefixes")
    about = stored(made.filter("node IS NOT NULL").groupBy("node", "n").agg(F.min("label").alias("label"), F.min("l").alias("l")), "join-nodes")
    packed = map_batches(rows, postings, schema).select("bucket", "payload").repartition(max(buckets, 2), "bucket").sortWithinPartitions("bucket")
    rare = map_batches(packed, _owned, "token long, label long")
    frequent = made.filter("token IS NOT NULL").select("token", "label").distinct()
    live = stored(rare.unionByName(frequent), "join-postings")

    # first: every node against the centre of each of its tokens; rank: the unshared part of a node's prefix, then its hash
    prefix = F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + F.col("l")
    counts = live.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    unshared = F.greatest(F.lit(0), F.floor(1023 * (1 - F.col("c") / prefix))).cast("long")
    meta = stored(about.join(counts, "label").select("label", "n", "l", (F.call_function("shiftleft", unshared, F.lit(52)) + F.col("label").bitwiseAND(F.lit((1 << 52) - 1))).alias("rank")), "join-ranks")
    ranked = live.join(broadcast_if_small(meta.select("label", "rank")), "label")
    centres = stored(ranked.groupBy("token").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("f")).filter("f > 1"), "join-centres")
    n_live = live.count()
    named = meta.select(F.col("rank").alias("first"), F.col("label").alias("a"))
    tokens_of = join_per_key(live, centres, ["token"], "f", n_live).groupBy("first", F.col("label").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    spokes = tokens_of.join(broadcast_if_small(named), "first").filter("a <> b").select("a", "b", "k")
    sides = [meta.select(F.col("label").alias(x), F.col("n").alias(f"n_{x}"), F.col("l").alias(f"l_{x}")) for x in "ab"]
    # a centre need not stand for all the tokens that it shares with a node, so a quarter will do
    first = stored(spokes.join(broadcast_if_small(sides[0]), "a").join(broadcast_if_small(sides[1]), "b").filter(_sized() & (4 * F.col("k") >= _must())).select("a", "b"), "join-candidates")
    links = stored(_verified(first, _sets_of(rows, first, about, groups)), "join-links")
    parts = connected(links)

    # then: pairs of different components
    placed = live.join(broadcast_if_small(parts), live["label"] == parts["node"], "left").select("token", "label", F.coalesce("component", "label").alias("component"))
    # of a token's components the largest (major) is only met from outside: its own pairs are never looked at
    sizes = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    majors = stored(sizes.groupBy("token").agg(F.max_by("component", "size").alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("f")).filter("parts > 1").drop("parts"), "join-majors")
    met = stored(join_per_key(placed, majors, ["token"], "f", n_live), "join-open")
    # a node's open tokens, those of fewest nodes first; behind a pair's first common token, in both, are all that they share
    kinds = met.groupBy("label").agg(F.first("component").alias("component"), F.array_sort(F.collect_list(F.struct("f", "token", "major"))).alias("open"))
    able = stored(kinds.join(meta.select("label", *[F.col(w).cast("int").alias(w) for w in ("n", "l")]), "label"), "join-able")
    placed_tokens = able.select("label", "component", "n", "l", F.size("open").alias("c"), F.posexplode("open").alias("pos", "o"))
    open_ = placed_tokens.select("label", "component", "n", "l", (F.col("c") - F.col("pos")).alias("tail"), "o.token", "o.major")
    # a token's nodes of one size and l are a kind; kinds that can't share enough behind the token are never paired
    open_ = stored(open_, "join-open-tokens")
    some = open_.groupBy("token", "n", "l").agg(F.max("tail").alias("tail"))
    kinds_a, kinds_b = (some.select("token", *[F.col(c).alias(f"{c}_{w}") for c in ("n", "l", "tail")]) for w in "ab")
    able_kinds = stored(kinds_a.join(kinds_b, "token").filter(_sized() & (F.least("tail_a", "tail_b") >= _must())).select("token", "n_a", "l_a", "n_b", "l_b", _must().alias("must")), "join-kinds")
    x = open_.filter("component <> major").select("token", F.col("label").alias("a"), F.col("component").alias("p_a"), "major", *[F.col(w).alias(f"{w}_a") for w in ("n", "l", "tail")])
    y = open_.select("token", F.col("label").alias("b"), F.col("component").alias("p_b"), *[F.col(w).alias(f"{w}_b") for w in ("n", "l", "tail")])
    asks = x.join(able_kinds, ["token", "n_a", "l_a"]).filter("tail_a >= must")
    possible = (F.col("p_a") != F.col("p_b")) & ((F.col("p_b") == F.col("major")) | (F.col("a") < F.col("b"))) & (F.col("tail_b") >= F.col("must"))
    meets = asks.join(y, ["token", "n_b", "l_b"]).filter(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "must").distinct()
    own_a, own_b = (able.select(F.col("label").alias(w), F.col("open.token").alias(f"open_{w}")) for w in "ab")
    second = stored(meets.join(own_a, "a").join(own_b, "b").filter(F.size(F.array_intersect("open_a", "open_b")) >= F.col("must")).select("a", "b"), "join-candidates")
    if not second.isEmpty():
        more = stored(_verified(second, _sets_of(rows, second, about, groups)), "join-links")
        if not more.isEmpty():
            parts = connected(links.unionByName(more))

    nodes = about.select("node", "n", "label")
    named = groups.join(nodes, ["node", "n"]).join(parts.select(F.col("node").alias("label"), "component"), "label", "left").withColumn("component", F.coalesce("component", "label"))
    named = stored(named, "join-named")
    firsts = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_sets")), "join-firsts")
    table = stored(join_per_key(named, firsts, ["component"], "n_sets", groups.count()).select("digest", "size", "component_id"), "join-classes")
    n_rows = own.count()
    with_words = join_per_key(own.filter("n > 0"), table, ["digest"], "size", n_rows)
    out = with_words.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _sets_of(rows: DataFrame, pairs: DataFrame, about: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, tokens) of the nodes in pairs, from one text of each."""
    wanted = pairs.select(F.col("a").alias("label")).unionByName(pairs.select(F.col("b").alias("label"))).distinct()
    ids = wanted.join(about, "label").join(groups, ["node", "n"]).select(F.col("least").alias("doc_id"), "label")

    def build():
        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = shingle_sets(batch.column("text").to_pylist())
            digests = [_digest(x) for x in own]
            right = [_node(d) == node for d, node in zip(digests, batch.column("node").to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in own], pa.binary())], names=["label", "tokens"]).filter(pa.array(right))

        return sets

    wanted_ids = stored(ids.join(about.select("label", "node"), "label"), "join-wanted-ids")
    chosen = rows.join(broadcast_if_small(wanted_ids), "doc_id").select("label", "node", "text")
    return stored(map_chunks(chosen, "text", build, "label long, tokens binary"), "join-wanted")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one whose doc_id names the component. All columns stay.

    Rows of one doc_id are one document here; rows without doc_id stay.
    """
    gone = near_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(broadcast_if_small(stored(gone, "join-gone")), docs["doc_id"] == F.col("__gone"), "left_anti")
