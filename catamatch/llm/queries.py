"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catamatch.llm import (conversation_repair, exact_dedup, fingerprints, language, lexical_search, line_dedup, mixing, near_dedup, packing, pii,
                           sentence_pieces, substring_dedup, url_filter)
from catamatch.llm.common import table

_WS = r"[\x20\x09-\x0D]"


def op1_exact_dedup(spark, sf_dir):
    """The table arrives as two batches; the first one is the history of the second."""
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), first)


def op2_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_pack(spark, sf_dir):
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op6_url_filter(spark, sf_dir):
    """A page is bad where the label of its id says so (low quality or toxic)."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    return url_filter.url_filter(table(spark, sf_dir, "pages"), labels)


def op7_line_dedup(spark, sf_dir):
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    found = near_dedup.near_dedup(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_substring_dedup(spark, sf_dir):
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentence_pieces.decoded(sentence_pieces.encoded(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"), "agreed")


def op12_conversation_repair(spark, sf_dir):
    rows = conversation_repair.repair(table(spark, sf_dir, "conversations"))
    return rows.select(*rows.columns[:-1], F.sha2("text", 256).alias("repaired_sha256"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTRY = {f.__name__: f for f in (
    op1_exact_dedup, op2_personal_data, op3_mix, op4_pack, op5_near_dedup, op6_url_filter, op7_line_dedup,
    op8_substring_dedup, op9_language, op10_fingerprints, op11_sentence_pieces, op12_conversation_repair,
    op13_lexical_search)}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op1_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS h,
                          length(coalesce(text, '')) AS len FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY len DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY h) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
    "op6_url_filter": f"""
        WITH u AS (SELECT page_id,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host,
            coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        o AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels GROUP BY doc_id),
        h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
                     array_to_string(string_split(host, '.')[-1:], '.') AS suffix,
                     array_to_string(string_split(host, '.')[-2:], '.') AS domain
              FROM u LEFT JOIN o ON page_id = doc_id GROUP BY host),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
        units AS (SELECT 'h' AS level, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
        sums AS (SELECT level, count(*) AS k, sum(n) AS n, sum(n * n) AS n2, sum(bad) / sum(n) AS p,
                        sum(bad * bad / n) AS b2 FROM units WHERE n > 0 GROUP BY level),
        m AS (SELECT level, CASE WHEN k < 2 OR p * (1 - p) = 0 THEN 10 ELSE 1 / least(greatest(
                  (b2 - n * p * p - (k - 1) * p * (1 - p)) / ((n - n2 / n - (k - 1)) * p * (1 - p)), 0.001), 0.333) - 1 END AS m
              FROM sums),
        ps AS (SELECT suffix, (bad + (SELECT m FROM m WHERE level = 's') * (SELECT p FROM sums WHERE level = 's'))
                              / (n + (SELECT m FROM m WHERE level = 's')) AS p FROM s),
        pd AS (SELECT d.suffix, domain, (bad + (SELECT m FROM m WHERE level = 'd') * p) / (n + (SELECT m FROM m WHERE level = 'd')) AS p
               FROM d JOIN ps USING (suffix)),
        ab AS (SELECT host, bad + (SELECT m FROM m WHERE level = 'h') * p AS a,
                      n - bad + (SELECT m FROM m WHERE level = 'h') * (1 - p) AS b FROM h JOIN pd USING (suffix, domain)),
        r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS poor FROM ab),
        f AS (SELECT u.*, poor, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
              FROM u JOIN r USING (host))
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
               WHEN poor THEN 'block' ELSE 'allow' END AS verdict FROM f""",
    "op7_line_dedup": rf"""
        WITH r AS (SELECT row_number() OVER () AS no, doc_id, text FROM documents),
        l AS (SELECT no, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM r),
        k AS (SELECT *, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), '{_UP}', '{_LOW}') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT no) >= 3),
        d AS (SELECT k.*, c.key IS NOT NULL AND last IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY no, doc_id""",
    "op8_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50),
        g AS (SELECT doc_id, pos, hash(array_to_string(words[pos:pos + 49], ' ')) AS a, md5_number(array_to_string(words[pos:pos + 49], ' ')) AS b FROM p),
        f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY a, b) < doc_id AS gone FROM g),
        r AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM f WHERE gone),
        x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
        k AS (SELECT x.*, r.pos IS NOT NULL AS gone FROM x LEFT JOIN r USING (doc_id, pos)),
        t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                     string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
        SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)""",
    "op13_lexical_search": rf"""
        WITH i AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
        q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_TERM}')) AS term FROM i),
        d AS (SELECT doc_id, row_number() OVER () AS no,
                     regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_TERM}') AS terms FROM documents),
        s AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms)) AS size FROM d),
        t AS (SELECT no, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        f AS (SELECT no, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
        c AS (SELECT item_id, text, no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // size)))) AS BIGINT) AS score
              FROM q JOIN f USING (term) JOIN w USING (term), s GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
