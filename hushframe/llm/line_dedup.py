"""Line deduplication within an edit bound, by a deletion-neighbourhood join.

A line is its words (runs without white space). Two lines are the same if their words are, and near if one word
inserted, deleted or replaced turns one into the other (only lines of NEAR_WORDS words or more can be near).

1. One scan writes each line's 128-bit hash and hashes of three quarters of its words: the first, the last, and two
   from both ends. Equal lines become one class, whose place is its earliest occurrence. Near lines agree in one of
   the four, so only lines that meet another go on, and the one that they meet in says in which quarter the edit is.
2. Those lines emit their neighbourhood there: for every word the key of the line without it, and for every gap the key
   of the line itself split there; a key is the hash of the words before, those behind, and the place. Near lines meet.
3. Of each key the earliest line is taken (an aggregation, so a key that millions of lines share stays one row for
   each task), and the later line is compared with it word by word.
4. The earliest of equal or near lines stays; the others' places are cut from their documents.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.shared import broadcast_if_small, join_per_key, join_salted, stored

#: Lines with fewer words are left alone, if no other number is given; with 0 every line is compared, blank ones too.
MIN_WORDS = 5
#: Lines with fewer words are the same only if equal, if no other number is given; with 0 any line may be near another.
NEAR_WORDS = 8
#: Lines are keyed by running hashes of their words if they are longer (in rounded words); shorter ones by parts of their text.
LONG_WORDS = 256

_PLACE = "decimal(38,0)"


_GAP = r"[\x20\x09\x0B-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __at, the place of a row's first line: each row has its own, in order of doc_id (null last).

    If rows share a doc_id or have none, the table is written to the shared folder with a number for each row, counted on
    from partition to partition, which tells them apart.
    """
    doc_id, lines = F.col("doc_id").cast("long"), F.lit(1 << 31).cast("decimal(10,0)")
    shared = docs.select(doc_id.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL")
    if shared.limit(1).count() == 0:
        return docs.withColumn("__at", (doc_id.cast("decimal(20,0)") * lines).cast(_PLACE))
    copy = stored(docs.withColumn("__number", F.monotonically_increasing_id()), "line-rows")
    part, within = F.call_function("shiftright", F.col("__number"), F.lit(33)), F.col("__number").bitwiseAND(F.lit((1 << 33) - 1))
    starts, rows = [], 0
    for k, n in sorted(map(tuple, copy.groupBy(part).agg(F.count(F.lit(1))).collect())):  # one for each task that wrote rows
        starts.append((k, rows))
        rows += n
    if rows > 1 << 32:
        raise ValueError("more rows than places can tell apart")
    numbered = copy.withColumn("__part", part).join(F.broadcast(docs.sparkSession.createDataFrame(starts, "__part long, __start long")), "__part")
    rank = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(10,0)") + F.col("__start") + within
    return numbered.select(*[copy[c] for c in docs.columns], (rank.cast("decimal(31,0)") * lines).cast(_PLACE).alias("__at"))


def _one_blank(text: Column) -> Column:
    """text with one blank for each run of white space within a line; most texts have no other."""
    return F.when(text.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(text, _GAP, " ")).otherwise(text)


def _n_words(line: Column) -> Column:
    """Words of a trimmed line with single blanks."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _lines(docs: DataFrame) -> DataFrame:
    """(at, pos, line) of every line of keyed docs, with single blanks."""
    return docs.select(F.col("__at").alias("at"), F.posexplode(F.split(_one_blank(F.col("text")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))


def _first(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def _last(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), -n)


def _rounded(m: Column) -> Column:
    """m rounded down to about two binary digits, so lines of like lengths are cut alike."""
    unit = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(m, F.lit(1)))).cast("int") - 1))
    return F.floor(m / unit).cast("int") * unit


def _cuts(m: Column) -> list[tuple[Column, Column]]:
    """For each of the four ways: how many words from the start and from the end of lines whose longer has m + 1 words.

    Near lines have a common start and a common end of at least m words together. Whatever the length of the start, one
    of the ways is within both: the cases are start >= 3/4 m; >= 1/2; >= 1/4; less.
    """
    one, two, three = F.floor(m / 4).cast("int"), F.floor(m / 2).cast("int"), F.floor(3 * m / 4).cast("int")
    return [(three, F.lit(0)), (two, one), (one, two), (F.lit(0), three)]


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, pos, near) of each line of docs (doc_id, text) that goes because an earlier line is equal or near.

    near tells whether it is only near. Earlier is by doc_id, then position; a null doc_id comes last. A near line goes
    also if the earlier one goes itself. Null texts have no lines; lines under min_words words never go, those under
    near_words only if equal. Each row is a
    document of its own, also if its doc_id is null or repeated. An empty table gives no rows.
    """
    keyed = _keyed(docs)
    rows = keyed.select(F.col("__at").alias("at"), F.col("doc_id").cast("long").alias("doc_id"))
    return _repeated(keyed, min_words, near_words).join(rows, "at").select("doc_id", "pos", "near")


def _running(line: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Hashes behind each of the words lo .. hi of a line, from its start and from its end: array of (i, ahead, behind).

    ahead stands for the words before place i, behind for those from i on, counted from the end. Both are exclusive-ors of the
    words' hashes; blocks of about the root of their number keep the work at its power of 1.5, however long the line.
    """
    words = F.slice(F.split(line, " "), lo + 1, hi - lo)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(hi - lo)).cast("int"))
    xor = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))
    from_start = F.transform(words, lambda w, j: F.xxhash64(w, j + lo))
    from_end = F.transform(words, lambda w, j: F.xxhash64(w, n - j - lo))
    held = F.array(F.struct(from_start.alias("s"), from_end.alias("e"), size.alias("k"), F.xxhash64(_first(line, lo)).alias("head"), F.xxhash64(_last(line, n - hi)).alias("tail")))
    starts = lambda x: F.sequence(F.lit(0), F.floor(F.size(x["s"]) / x["k"]).cast("int"))
    block = lambda x, side, b: xor(F.slice(x[side], b * x["k"] + 1, x["k"]))
    blocks = F.transform(held, lambda x: F.struct(x.alias("x"), F.transform(starts(x), lambda b: block(x, "s", b)).alias("s"), F.transform(starts(x), lambda b: block(x, "e", b)).alias("e")))
    sums = F.transform(blocks, lambda y: F.struct(
        y["x"].alias("x"),
        F.transform(y["s"], lambda v, b: xor(F.slice(y["s"], 1, b))).alias("s"),
        F.transform(y["e"], lambda v, b: xor(F.slice(y["e"], b + 1, F.size(y["e"])))).alias("e"),
    ))

    def at(z: Column, i: Column) -> Column:
        x, b = z["x"], F.floor((i - lo) / z["x"]["k"]).cast("int")
        rest = F.slice(x["s"], b * x["k"] + 1, i - lo - b * x["k"])
        gone = F.slice(x["e"], b * x["k"] + 1, i - lo - b * x["k"])
        return F.struct(i.alias("i"), F.xxhash64(x["head"], F.get(z["s"], b).bitwiseXOR(xor(rest))).alias("ahead"), F.xxhash64(x["tail"], F.get(z["e"], b).bitwiseXOR(xor(gone))).alias("behind"))

    return F.get(F.transform(sums, lambda z: F.transform(F.sequence(lo, hi), lambda i: at(z, i))), F.lit(0))


def _long_keys(line: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Keys (i, key) of a long line without each word of lo .. hi, and of the line split there."""
    upto = F.least(hi + 1, n)  # one more word, as the place behind a word left out is needed
    key = lambda a, b: F.struct(a["i"].alias("i"), F.xxhash64(a["i"], a["ahead"], b["behind"]).alias("key"))
    both = F.array(_running(line, n, lo, upto))
    gaps = lambda r: F.transform(F.filter(r, lambda a: a["i"] <= hi), lambda a: key(a, a))
    deleted = lambda r: F.transform(F.filter(r, lambda a: (a["i"] <= hi) & (a["i"] < n)), lambda a, j: key(a, F.get(r, j + 1)))
    return F.get(F.transform(both, lambda r: F.concat(deleted(r), gaps(r))), F.lit(0))


def _of_keys(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """The rows whose key table (one row of a key) has: by a broadcast if table is small, else as join_per_key."""
    known = broadcast_if_small(table)
    return rows.join(known, key) if known is not table else join_per_key(rows, table, [key], size, total)


def _repeated(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(at, pos, near) of the lines of keyed docs that go, see repeated_lines."""
    n, line, place = F.col("n"), F.col("line"), (F.col("at") + F.col("pos")).cast(_PLACE)
    counted = _lines(docs).withColumn("n", _n_words(line)).filter(n >= min_words)
    less = F.greatest(n - 1, F.lit(0))
    sized = counted.withColumns({"longer": F.when(n >= near_words, _rounded(less)), "shorter": F.when((n >= near_words) & (_rounded(n) != _rounded(less)), _rounded(n))})
    ways = []
    for m in (F.col("longer"), F.col("shorter")):  # as the longer line of a pair, and as the shorter one where that differs
        for way, (start, end) in enumerate(_cuts(m)):
            ways.append(F.when(m.isNotNull(), F.xxhash64(F.lit(way), m, _first(line, start), _last(line, end))).alias(f"part{len(ways)}"))
    log = stored(sized.select("at", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *ways), "lines")
    total = log.count()

    # a part that only one line has leads nowhere
    parts = log.select("h1", F.posexplode(F.array(*[f"part{i}" for i in range(8)])).alias("way", "part")).filter("part IS NOT NULL")
    meet = stored(parts.groupBy("part").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.count(F.lit(1)).alias("n_part")).filter("low <> high").select("part", "n_part"), "line-parts")
    some = _of_keys(parts, meet, "part", "n_part", 4 * max(1, total)).groupBy("h1", "way").agg(F.count(F.lit(1)).alias("_")).drop("_")
    classes = stored(log.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies")), "line-classes")

    at_pos = F.pmod("place", F.lit(1 << 31).cast("decimal(10,0)"))
    wanted_ways = some.groupBy("h1").agg(F.collect_set("way").alias("ways"))
    firsts = stored(classes.join(wanted_ways, "h1").select("h1", "h2", "ways", (F.col("place") - at_pos).cast(_PLACE).alias("at"), at_pos.cast("int").alias("pos")), "line-candidates")
    wanted = stored(_lines(docs).join(broadcast_if_small(firsts), ["at", "pos"]).select("h1", "h2", place.alias("place"), "ways", "line", _n_words(line).alias("n")), "line-words")

    m = F.when(F.col("way") < 4, _rounded(less)).otherwise(_rounded(n))
    ranges = F.array(*[F.struct(start.alias("lo"), (n - end).alias("hi")) for start, end in _cuts(m)])
    spans = wanted.withColumn("way", F.explode("ways")).select("place", "line", "n", F.get(ranges, F.pmod("way", F.lit(4))).alias("r"), m.alias("m")).filter("r.lo <= r.hi")

    def key_of(i: Column, skip: int) -> Column:
        return F.xxhash64(i, _first(line, i), _last(line, n - i - skip))

    deleted = F.transform(F.sequence(F.col("r.lo"), F.least(F.col("r.hi"), n - 1)), lambda i: F.struct(i.alias("i"), key_of(i, 1).alias("key")))
    gaps = F.transform(F.sequence(F.col("r.lo"), F.col("r.hi")), lambda i: F.struct(i.alias("i"), key_of(i, 0).alias("key")))
    short = F.when(F.col("r.lo") <= n - 1, F.concat(deleted, gaps)).otherwise(gaps)
    every = F.when(F.col("m") > LONG_WORDS, _long_keys(line, n, F.col("r.lo"), F.col("r.hi"))).otherwise(short)
    keys = stored(spans.select("place", F.explode(every).alias("v")).select("place", "v.i", "v.key"), "line-variants")
    heads = stored(keys.groupBy("key").agg(F.min("place").alias("head"), F.max("place").alias("last"), F.min("i").alias("i"), F.count(F.lit(1)).alias("n_key")).filter("head <> last"), "line-keys")
    # of two rows the later is known; only where more have a key they are asked for again, once
    two = heads.filter("n_key = 2").select(F.col("last").alias("place"), "i", "head")
    more = _of_keys(keys, heads.filter("n_key > 2").select("key", "head", "n_key"), "key", "n_key", keys.count()).filter("head < place")
    pairs = stored(two.unionByName(more.select("place", "i", "head")).distinct(), "line-pairs")

    mine, other = wanted.select("place", "h1", "h2", F.col("line").alias("a"), F.col("n").alias("n_a")), wanted.select(F.col("place").alias("head"), F.col("line").alias("b"), F.col("n").alias("n_b"))
    i, n_a, n_b = F.col("i"), F.col("n_a"), F.col("n_b")
    skip_a, skip_b = F.when(n_a >= n_b, 1).otherwise(0), F.when(n_b >= n_a, 1).otherwise(0)
    same = (_first(F.col("a"), i) == _first(F.col("b"), i)) & (_last(F.col("a"), n_a - i - skip_a) == _last(F.col("b"), n_b - i - skip_b))
    near = join_salted(pairs, other, "head", "place").join(mine, "place").filter((F.abs(n_a - n_b) <= 1) & same).select("h1", "h2", "place")

    again = classes.filter("copies > 1").withColumn("near", F.lit(False)).unionByName(near.withColumns({"copies": F.lit(1).cast("long"), "near": F.lit(True)}))
    gone = stored(again.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.max("copies").alias("copies"), F.bool_or("near").alias("near")), "lines-gone")
    found = join_per_key(log.select("at", "pos", "h1", "h2"), gone, ["h1", "h2"], "copies", total)
    return found.filter(F.col("near") | (place != F.col("place"))).select("at", "pos", "near")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with repeated lines cut from text, and columns __n_lines, __n_dropped, __n_near, __whole and __blank.

    __whole: every line of min_words words or more went, and there was one; shorter lines, which were never compared, may
    be left. __blank: a line went, and nothing but white space is left.
    """
    keyed = _keyed(docs)
    by_doc = _repeated(keyed, min_words, near_words).groupBy("at").agg(F.collect_set("pos").alias("__gone"), F.count_if("near").alias("__near")).withColumnRenamed("at", "__doc")
    gone = broadcast_if_small(stored(by_doc, "lines-by-document"))
    joined = keyed.join(gone, F.col("__at") == F.col("__doc"), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__gone", i))
    substantial = F.exists(kept, lambda x: _n_words(F.trim(_one_blank(x))) >= min_words)
    hit = F.col("__gone").isNotNull()
    return joined.select(
        *[keyed[c] for c in docs.columns if c != "text"],
        F.when(hit, F.array_join(kept, "\n")).otherwise(keyed["text"]).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_dropped"),
        F.coalesce("__near", F.lit(0)).cast("long").alias("__n_near"),
        F.coalesce(hit & ~substantial, F.lit(False)).alias("__whole"),
        F.coalesce(hit & ~F.exists(kept, lambda x: F.trim(_one_blank(x)) != ""), F.lit(False)).alias("__blank"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_dropped (n_near of them only near), whole (see deduplicated), text_sha256 of what is left."""
    done = deduplicated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__n_near").alias("n_near"), F.col("__whole").alias("whole"), F.sha2("text", 256).alias("text_sha256"))


def _without(docs: DataFrame, flag: str) -> DataFrame:
    out = deduplicated(docs).filter(~F.col(flag)).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def cut_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated lines, and without documents of which nothing but white space is left. Columns stay; n_chars, if there, follows text."""
    return _without(docs, "__blank")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """As cut_repeated_lines, but documents that are left with only lines under MIN_WORDS words go too, unique or not."""
    return _without(docs, "__whole")
