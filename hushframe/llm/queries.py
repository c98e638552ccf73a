"""The registered queries of the training-data operators, each over its whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm.decontaminate import contamination
from hushframe.llm.exact_dedup import exact_groups
from hushframe.llm.html_text import extract
from hushframe.llm.jaccard_join import near_groups
from hushframe.llm.language_gru import identify, train_on
from hushframe.llm.licence_scan import COPYRIGHT, KNOWN, SPELLINGS, scan_licences
from hushframe.llm.line_dedup import line_report
from hushframe.llm.quality_crf import fit_on, score_quality
from hushframe.llm.sentence_pieces import round_trips
from hushframe.llm.warc import read_records, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_quality(documents, fit_on(documents, _table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return identify(documents, train_on(documents))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(_table(spark, sf_dir, "pages")), payloads=False)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_licence_scan": op6_licence_scan,
    "op7_warc": op7_warc,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_text": op10_html_text,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_quoted(COPYRIGHT)}, '', 'g')"
    for one, other in SPELLINGS:
        out = f"replace({out}, {_quoted(one)}, {_quoted(other)})"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


ORACLES = {
    "op1_decontaminate": f"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
             s AS (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
             g AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS gram FROM s, unnest(range(1, len(w) - m + 2)) AS t(i)),
             d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             v AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS gram
                   FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM s))),
             h AS (SELECT doc_id, i, v.m, item FROM v JOIN g USING (m, gram)),
             p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
             t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
             g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
                   FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE
             d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
             z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             e AS (SELECT x, y FROM p JOIN z AS a ON a.doc_id = x JOIN z AS b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
             r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, c.component_id
        FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) AS c ON c.doc_id = d.doc_id
    """,
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(lines[pos + 1], '[\x20\x09\x0B-\x0D]+'), lambda x: x <> '') AS w
                   FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
             k AS (SELECT doc_id, pos, w, row_number() OVER (ORDER BY doc_id, pos) AS place FROM l WHERE len(w) >= 5),
             c AS (SELECT w, min(place) AS place FROM k GROUP BY w),
             v AS (SELECT DISTINCT w, place, i, w[1 : i] AS a, w[i + 1 + d :] AS b
                   FROM (SELECT w, place, d, unnest(range(len(w) + 1 - d)) AS i FROM c, (VALUES (0), (1)) AS t(d) WHERE len(w) >= 8)),
             n AS (SELECT DISTINCT w FROM (SELECT w, place, min(place) OVER (PARTITION BY i, a, b) AS head FROM v) WHERE head < place),
             g AS (SELECT k.doc_id, k.pos, n.w IS NOT NULL AS near, k.place <> c.place OR n.w IS NOT NULL AS gone FROM k JOIN c ON k.w = c.w LEFT JOIN n ON k.w = n.w),
             d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
                          (SELECT coalesce(list(pos), []) FROM g WHERE g.doc_id = documents.doc_id AND gone) AS gone,
                          (SELECT count(*) FROM g WHERE g.doc_id = documents.doc_id AND gone AND near) AS n_near,
                          (SELECT count(*) FROM g WHERE g.doc_id = documents.doc_id AND NOT gone) AS n_kept FROM documents)
        SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_dropped, n_near, len(gone) > 0 AND n_kept = 0 AS whole,
               CASE WHEN text IS NOT NULL THEN sha256(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10))) END AS text_sha256 FROM d
    """,
    "op6_licence_scan": rf"""
        WITH k AS (SELECT DISTINCT licence, trim(regexp_replace({_canonical("known")}, '[ \n]+', ' ', 'g')) AS form
                   FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS t(licence, known)),
             d AS (SELECT doc_id, {_canonical("text")} AS form FROM documents),
             u AS (SELECT doc_id, true AS whole, trim(regexp_replace(form, '[ \n]+', ' ', 'g')) AS form FROM d
                   UNION ALL SELECT doc_id, false, trim(unnest(string_split(form, chr(10)))) FROM d),
             h AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) FILTER (NOT whole) AS n_lines, bool_or(whole) AS whole FROM u JOIN k USING (form) GROUP BY doc_id)
        SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_lines, 0) AS n_lines, coalesce(whole, false) AS whole FROM d LEFT JOIN h USING (doc_id)
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
             f AS (SELECT h, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY h)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (h)
    """,
}
