"""Decontamination, exact copies, near copies and lines against brute force on small tables."""

import itertools
import random
import re
import time
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import decontaminate as dc
from hushframe.llm import line_dedup, shared
from hushframe.llm.components import connected
from hushframe.llm.exact_dedup import drop_exact_copies, exact_groups, grow_directory, slot
from hushframe.llm.jaccard_join import drop_near_copies, near_groups
from hushframe.llm.line_dedup import deduplicated, drop_repeated_lines, repeated_lines
from hushframe.llm.shingles import word_hashes

DOCS = "doc_id long, text string, kept boolean, key string, group_size int"


def frame(spark, texts, start=0):
    """Texts under their numbers, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, True, "k", 7) for i, t in enumerate(texts, start)], DOCS)


def words(rng, n, of=40):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.mark.parametrize("operator", [exact_groups, near_groups, repeated_lines, drop_exact_copies, drop_near_copies, drop_repeated_lines])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0


# decontamination


def brute_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    doc, hit, found = find(text), set(), set()
    for item, t in items:
        w = find(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(doc) - m + 1):
                if doc[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(doc), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 200])
def test_contamination_matches_brute_force(spark, block):
    rng = random.Random(3)
    items = [(i, words(rng, rng.choice([0, 1, 3, 13, 14, 40]), 400)) for i in range(12)] + [(12, None), (13, "ÉTÉ où")]
    texts = [None, "", "...", "Été OÙ", "éTé où", "ÉTÉ OÙ! été où"] + [f"{words(rng, rng.randrange(60), 400)} {rng.choice(items)[1] or ''}. {words(rng, rng.randrange(200), 400)}".upper() for _ in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:6] for r in dc.contamination(frame(spark, texts), benchmark, block).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontaminate_removes_documents_or_spans(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = frame(spark, [f"Head {item}, tail.", "clean text", None, f"{' '.join('c' + str(i) for i in range(900))} {item}"])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.decontaminate(docs, benchmark).collect()) == [1, 2, 3]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, benchmark, "spans").collect()}
    assert cut[0] == "Head , tail." and cut[1] == "clean text" and cut[2] is None and "b3" not in cut[3]
    assert dc.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4


# exact copies


@pytest.mark.parametrize("capacity", [1 << 16, 2])
def test_exact_groups_match_brute_force(spark, capacity):
    rng = random.Random(5)
    base = ["a b", "ab", "a\tb ", " a\x0bb\n\n", "", None, " \r\n", "é", "x" * 5000, "x" * 5000 + " "] + [words(rng, 5, 3) for _ in range(60)] + ["hot text"] * 40
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_groups(frame(spark, base), capacity).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in base]
    for i, n in enumerate(norm):
        group = [j for j, m in enumerate(norm) if m == n]
        keep = min(group, key=lambda j: (-len(base[j] or ""), j))
        assert got[i] == (keep, len(group), i == keep, sha256(n.encode()).hexdigest())
    assert drop_exact_copies(frame(spark, base), capacity).count() == len(set(norm))


@pytest.mark.parametrize("capacity", [1 << 12, 3])
@pytest.mark.parametrize("kinds", [1, 5])
def test_texts_whose_keys_collide_stay_apart(spark, capacity, kinds):
    rng = random.Random(7)
    texts = [words(rng, rng.choice([0, 1, 2, 3]), 6) for _ in range(300)] + ["hot text"] * 100 + [None, "alone"]
    few = lambda norm: F.shiftleft(F.pmod(F.octet_length(norm), F.lit(kinds)).cast("long"), 61)
    plain = {tuple(r) for r in exact_groups(frame(spark, texts).repartition(5)).collect()}
    assert {tuple(r) for r in exact_groups(frame(spark, texts).repartition(5), capacity, few).collect()} == plain
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    assert {(r[0], r[2]) for r in plain} == {(i, norm.count(n)) for i, n in enumerate(norm)}


def test_owners_have_whole_buckets(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    directory, depth = grow_directory(keys, 64)
    slots = directory.orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(1 << depth)) and depth > 6
    for r in slots:
        assert r["bucket"] == r["slot"] >> (depth - r["local_depth"]) << (depth - r["local_depth"])
    sizes = keys.withColumn("slot", slot(F.col("key"), depth)).join(directory, "slot").groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 64 and sum(r["count"] for r in sizes) == 5000


def test_exact_groups_at_the_ends_of_ids(spark):
    edge = (1 << 63) - 1
    docs = spark.createDataFrame([(edge, "a"), (edge, "b"), (None, "b"), (-edge - 1, "c"), (edge, "c "), (None, "d"), (None, "e"), (None, "e")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_groups(docs).collect())
    assert got == sorted([(str(edge), str(edge), 1, True), (str(edge), str(edge), 2, True), ("None", str(edge), 2, False), (str(-edge - 1), str(edge), 2, False), (str(edge), str(edge), 2, True), ("None", "None", 1, True), ("None", "None", 2, True), ("None", "None", 2, True)])
    assert drop_exact_copies(docs).count() == 6


def test_exact_groups_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (5, "aa")], "doc_id long, text string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(docs).collect())
    assert got == [(-1, 3, 4, False), (-1, 3, 4, False), (3, 3, 4, True), (3, 3, 4, True), (5, 5, 1, True)]


# near copies


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


def near_copy(rng, text, edits):
    w = text.split()
    for _ in range(edits if w else 0):
        i = rng.randrange(max(1, len(w)))
        w[i : i + 1] = rng.choice([[], ["new" + str(rng.randrange(9))], [*w[i : i + 1], "more"]])
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "A b c d e", "é b c d e", "É b c d e"]
    shared = words(rng, 50, 500)
    for _ in range(12):
        base = words(rng, rng.choice([8, 30, 120]), 500)
        texts += [base] + [near_copy(rng, base, rng.choice([0, 1, 2, 5])) for _ in range(rng.choice([0, 1, 3, 8]))]
    texts += [f"{words(rng, rng.choice([5, 12, 60]), 500)} {shared}" for _ in range(15)]
    big = words(rng, 200, 900)
    texts += [near_copy(rng, big, rng.choice([1, 3, 6])) for _ in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(frame(spark, texts)).collect()}
    want = brute_components(texts)
    assert got == want
    assert sorted(r["doc_id"] for r in drop_near_copies(frame(spark, texts)).collect()) == [i for i, (_, c) in want.items() if i == c]


def test_words_hash_alike_in_any_place(spark):
    import numpy as np

    data = np.frombuffer(b"  alpha beta\talpha\nbeta  alphabeta ", dtype=np.uint8)
    hashes, firsts = word_hashes(data)
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3 and firsts.tolist() == [2, 8, 13, 19, 25]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 200: 200, 201: 200}


# lines


def near(a, b, near_words=8):
    if len(a) < near_words or len(b) < near_words or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    one, two = (a[i + 1 :], b[i + 1 :]) if len(a) == len(b) else (a[i + 1 :], b[i:]) if len(a) > len(b) else (a[i:], b[i + 1 :])
    return one == two


def brute_lines(texts, min_words=5, near_words=8):
    gone, seen = set(), []
    for i, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            w = [x for x in re.split(r"[\x20\x09\x0B-\x0D]+", line) if x]
            if len(w) >= min_words:
                if w in seen or any(near(w, s, near_words) for s in seen):
                    gone.add((i, pos))
                if w not in seen:
                    seen.append(w)
    return gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_lines_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([1, 4, 5, 7, 8, 9, 12, 17, 33, 64]), 30) for _ in range(25)]
    pool += [near_copy(rng, p, 1) for p in pool for _ in range(2) if p] + [near_copy(rng, p, 2) for p in pool[:25]]
    pool += ["the same line of eight words is hot", "  the same\tline of eight words is hot\r", ""]
    texts = [None, ""] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))) for _ in range(50)] + ["the same line of eight words is hot"] * 20
    got = {(r["doc_id"], r["pos"]) for r in repeated_lines(frame(spark, texts)).collect()}
    assert got == brute_lines(texts)
    left = {r["doc_id"]: (r["text"], r["__whole"]) for r in deduplicated(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        kept = None if t is None else [x for p, x in enumerate(t.split("\n")) if (i, p) not in got]
        assert left[i] == (None if t is None else "\n".join(kept), bool(t and any(g[0] == i for g in got)) and not any(len(x.split()) >= 5 for x in kept))
    assert drop_repeated_lines(frame(spark, texts)).count() == sum(not w for _, w in left.values())


@pytest.mark.parametrize("bounds", [(0, 0), (1, 3)])
def test_every_line_is_compared_if_asked(spark, bounds):
    rng = random.Random(12)
    texts = [None, "", "a\n\nb"] + ["\n".join(words(rng, rng.choice([0, 1, 2, 3, 4]), 9) for _ in range(rng.randrange(1, 4))) for _ in range(25)]
    assert {(r["doc_id"], r["pos"]) for r in repeated_lines(frame(spark, texts), *bounds).collect()} == brute_lines(texts, *bounds)


def test_long_lines_take_little_time_and_match_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    long = words(rng, 60_000, 10**6)
    texts = [long, near_copy(rng, long, 1), near_copy(rng, long, 2), words(rng, 30_000, 10**6)]
    began = time.perf_counter()
    assert {(r["doc_id"], r["pos"]) for r in repeated_lines(frame(spark, texts)).collect()} == brute_lines(texts)
    assert time.perf_counter() - began < 90
    monkeypatch.setattr(line_dedup, "LONG_WORDS", 4)
    pool = [words(rng, rng.choice([8, 9, 11, 16, 17, 33, 64]), 30) for _ in range(25)]
    pool += [near_copy(rng, p, 1) for p in pool for _ in range(3)] + [near_copy(rng, p, 2) for p in pool]
    texts = ["\n".join(rng.choice(pool) for _ in range(4)) for _ in range(60)]
    assert {(r["doc_id"], r["pos"]) for r in repeated_lines(frame(spark, texts)).collect()} == brute_lines(texts)


def shuffled_records(spark):
    """Records that the stages still known to the session wrote for shuffles, by stage."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(k) for k in range(stages.size()))}


@pytest.mark.parametrize("small, times", [(500_000, 1), (0, 2)])
def test_keys_of_lines_are_shuffled_once_or_twice_and_match_brute_force(spark, monkeypatch, small, times):
    """Once where few keys are had by more than two lines, else twice, also if Spark by itself would broadcast nothing."""
    rng = random.Random(21)
    pool = [words(rng, rng.choice([60, 90, 130]), 10**6) for _ in range(40)]
    pool += [near_copy(rng, p, 1) for p in pool] + [near_copy(rng, p, 1) for p in pool[:12]] + [near_copy(rng, pool[0], 1) for _ in range(9)]
    pool += [pool[3], pool[45], pool[80], *(words(rng, 20, 10**6) for _ in range(10))]
    rng.shuffle(pool)
    texts = ["\n".join(pool[k : k + 3]) for k in range(0, len(pool), 3)]
    tables = {}
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: tables.setdefault(name, shared.stored(df, name)))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", small)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        got = {(r["doc_id"], r["pos"]) for r in repeated_lines(frame(spark, texts)).collect()}
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        wrote = sum(n for k, n in shuffled_records(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == brute_lines(texts)
    keys = tables["line-variants"].count()
    assert keys > 5000 and wrote < (times + 0.75) * keys


def test_short_lines_keep_their_document(spark):
    shared = "Licensed under CC BY-NC 4.0."
    texts = [shared, "roses are red\nviolets are blue\n" + shared, shared + "\n\n \t", "\u8fd9\u662f\u4e00\u7bc7\u6587\u7ae0\n" + shared, "def f():\n\treturn 1\n" + shared, " \n", None]
    gone = brute_lines(texts)
    want = {}
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        if kept is None or kept.strip() or not any(g[0] == i for g in gone):
            want[i] = kept
    assert set(want) == {0, 1, 3, 4, 5, 6}
    docs = frame(spark, texts).withColumn("n_chars", F.lit(9))
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {i: (t, None if t is None else len(t)) for i, t in want.items()}


def test_rows_with_null_and_repeated_ids_are_documents_of_their_own(spark):
    a, b, c, d = (f"line {x} of five words" for x in "abcd")
    edge = (1 << 63) - 1
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{b}"), (None, f"{c}\n{d}"), (None, "short\nunique words of one row"), (1, f"{a}\n{'x' * 5} own words of it"), (1, "no line of this one\nis in another row here"), (edge, b), (-edge - 1, d), (None, "copy of a whole row"), (None, "copy of a whole row")]
    docs = spark.createDataFrame([(i, t, True, "k", 7) for i, t in rows], DOCS).repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in deduplicated(docs).collect())
    null = [r[2] for r in got if r[0]]
    assert [r[1:] for r in got if not r[0]] == [(-edge - 1, d), (1, f"{a}\nxxxxx own words of it"), (1, "no line of this one\nis in another row here"), (edge, b)]
    assert len(null) == 6 and "short\nunique words of one row" in null
    assert sorted(x for t in null for x in t.split("\n") if x) == sorted([c, "copy of a whole row", "short", "unique words of one row"])
    assert repeated_lines(docs).filter("doc_id IS NULL").count() == 6 and repeated_lines(docs).count() == 6
