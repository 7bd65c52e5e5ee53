"""One query per operator over the driver's tables, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, exact_dedup, lattice, lengths, lines, matrix, packing, phrases, simhash, token_files, topk, toxicity, warc
from waymark.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op4_lattice_score(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"))


def op5_bit_sliced_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_token_counts(spark, sf_dir):
    return lengths.limits(lengths.histogram(table(spark, sf_dir, "documents")))


def op11_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return matrix.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_exact_dedup, op3_warc, op4_lattice_score, op5_bit_sliced_topk, op6_bpe, op7_simhash, op8_packing, op9_line_dedup, op10_token_counts,
    op11_token_files, op12_filter_audit, op13_collocations,
)}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM m
    """,
    "op5_bit_sliced_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(d.c AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
        f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
        j AS (SELECT l.doc_id, l.i, l.line, coalesce(f.first < l.doc_id, false) AS gone FROM l LEFT JOIN f ON l.k = f.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id
    """,
    "op12_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
                     || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
                     || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < w.doc_id THEN 'E' ELSE '' END AS failed
              FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x d ON d.c NOT IN (a.c, b.c)
              JOIN x e ON e.c NOT IN (a.c, b.c, d.c) JOIN x g ON g.c NOT IN (a.c, b.c, d.c, e.c)),
        s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS letter, left(filter_order, i - 1) AS earlier FROM o, range(1, 6) r(i)),
        m AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, failed),
        j AS (SELECT part, filter_order, step, letter, n, good, toxic, contains(failed, letter) AS fails, failed = letter AS alone,
                     length(earlier) > 0 AND translate(failed, earlier, '') <> failed AS gone
              FROM m, s),
        r AS (SELECT part, filter_order, step, any_value(letter) AS letter, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE NOT gone AND fails) AS removed,
                     sum(n) FILTER (WHERE gone AND fails) AS redundant, sum(n) FILTER (WHERE alone) AS unique_fails,
                     sum(good) FILTER (WHERE NOT gone AND fails) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND fails) AS toxic_lost
              FROM j GROUP BY part, filter_order, step)
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
        FROM r
    """,
    "op13_collocations": """
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        q AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
        m AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY lang),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS p FROM q, (SELECT unnest([1, 2, 3, 4]) AS k)),
        f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY lang, k, p HAVING count(*) >= 30),
        s AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1),
        c AS (SELECT lang, k, p, a, j, array_to_string(w[1:j], ' ') AS u, array_to_string(w[j + 1:k], ' ') AS v FROM (SELECT *, unnest(range(1, k)) AS j FROM s)),
        e AS (SELECT c.lang, c.k, c.p, c.a, c.j, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
              FROM c JOIN f x ON x.lang = c.lang AND x.p = c.u JOIN f y ON y.lang = c.lang AND y.p = c.v),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS nth FROM e),
        t AS (SELECT lang, a AS af, unnest(list_transform(range(1, k - z + 2), lambda i: array_to_string(list_slice(w, i, i + z - 1), ' '))) AS p FROM s JOIN (SELECT unnest([2, 3]) AS z) ON z < k),
        o AS (SELECT lang, p, max(af) AS af FROM t GROUP BY lang, p),
        r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank, b.p AS phrase, a, l, r, score
              FROM b LEFT JOIN o ON o.lang = b.lang AND o.p = b.p
              WHERE nth = 1 AND (o.af IS NULL OR CAST(100 AS HUGEINT) * o.af < CAST(80 AS HUGEINT) * a))
        SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN m ON m.lang = r.lang WHERE rank <= 2000
    """,
}
