"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_naming, bound_packing, bpe_fst, bucket_resampling, bwt_dedup, cover_dedup, cover_tree, exponion_codes, leak_automaton, partition_join, site_quality, token_files, url_automaton
from .common import table

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RULES = [
    url_automaton.Rule("net", "/", "block"),
    url_automaton.Rule("example.net", "/en/", "allow"),
    url_automaton.Rule("example.com", "/de/", "block"),
    url_automaton.Rule("org", "/fr/", "allow"),
]
BLOCKED_HOSTS = ["*spam-farm*", "*cheap-pills*", "*casino*"]


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.encode_decode(table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(table(spark, sf_dir, "documents"))


def op3_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.remove(table(spark, sf_dir, "documents"), length=50)


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove(table(spark, sf_dir, "documents"), length=100)


def op6_bound_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, capacity=4096)


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


def op9_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_join.classes(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge(table(spark, sf_dir, "pages"), RULES, BLOCKED_HOSTS)


def op11_leak_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_automaton.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("items")


def op12_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


def op13_bucket_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10000, seed=7, least_words=20, percent=25)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_codec, op2_exact_dedup, op3_cover_dedup, op4_site_quality, op5_bwt_dedup, op6_bound_packing, op7_cover_tree, op8_token_files,
        op9_partition_join, op10_url_automaton, op11_leak_automaton, op12_exponion_codes, op13_bucket_resampling,
    )
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cased words of a table's column text.
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"


def _code_rounds(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """SQL of the rounds of op12: a1, b1, a2, ... with all distances."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS (SELECT vec_id, label, p.part, x, min(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + entry) AS m
            FROM p JOIN b{r} b ON p.part = b.part GROUP BY ALL)""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT part, entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT part, m % {entries} AS entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}) GROUP BY ALL),
            b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n, e) AS e FROM b{r} LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS n FROM s{r} GROUP BY ALL) USING (part, entry))""")
    return ",\n        ".join(out)


ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op3_cover_dedup": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
        r AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 50 THEN string_agg(word, ' ') OVER f END AS run FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        m AS (SELECT run, min(doc_id) AS least FROM r WHERE run IS NOT NULL GROUP BY run),
        g AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN least < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM r LEFT JOIN m USING (run)),
        s AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)""",
    "op7_cover_tree": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        g AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, reach.c FROM reach JOIN p ON p.a = reach.id WHERE reach.c < p.b),
        l AS (SELECT id, min(c) AS component FROM reach GROUP BY id), n AS (SELECT a, count(*) AS links FROM p GROUP BY a)
        SELECT vec_id, coalesce(links, 0) AS n_links, component AS component_id, vec_id = component AS kept FROM v JOIN l ON l.id = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op9_partition_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p:p+3], ' ')) END) AS sh FROM w),
        t AS (SELECT doc_id, len(sh) AS n, hash(list_sort(sh)) AS f, sh FROM s),
        rep AS (SELECT min(doc_id) AS id, n, f, any_value(sh) AS sh FROM t WHERE n > 0 GROUP BY n, f),
        x AS (SELECT id, n, unnest(sh) AS k FROM rep),
        p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.k = b.k AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        reach(id, c) AS (SELECT id, id FROM rep UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id WHERE reach.c < e.b),
        lab AS (SELECT id, min(c) AS component FROM reach GROUP BY id)
        SELECT t.doc_id, t.n AS n_shingles, coalesce(component, t.doc_id) AS component_id FROM t LEFT JOIN rep ON t.n = rep.n AND t.f = rep.f LEFT JOIN lab ON lab.id = rep.id""",
    "op10_url_automaton": """
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
        t AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
        r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, verdict)),
        m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict FROM h, r
              WHERE ends_with('.' || host, '.' || rh) AND starts_with(path, rp) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' OR host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' OR host LIKE '%casino%' THEN 'block' ELSE 'allow' END) AS verdict
        FROM h LEFT JOIN m USING (page_id)""",
    "op11_leak_automaton": f"""
        WITH iw AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
        w AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws] ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i+9]) END) AS win FROM iw),
        k AS (SELECT item_id, len(win) AS m, array_to_string(win, ' ') AS run FROM w),
        d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        r AS (SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') AS run FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM k) WHERE len(ws) >= m)),
        h AS (SELECT doc_id, m, i, item_id FROM r JOIN k USING (m, run)),
        c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, m, i FROM h)) GROUP BY doc_id),
        n AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op12_exponion_codes": f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        p AS MATERIALIZED (SELECT vec_id, label, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] AS x FROM v, range(4) t(part)),
        b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p QUALIFY entry < 256),
        {_code_rounds()},
        t AS (SELECT string_agg(array_to_string(e, ','), ',' ORDER BY part, entry) AS books FROM b4),
        f AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(books) AS codebooks_sha256 FROM f, t""",
    "op13_bucket_resampling": f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS tab),
        d AS (SELECT doc_id, {WORDS} AS ws FROM documents), i AS (SELECT {WORDS} AS ws FROM benchmark),
        fd AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS f FROM d),
        fi AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]))) AS f FROM i),
        u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM fd UNION SELECT DISTINCT f FROM fi)),
        b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(0, len(h), 2), lambda k: CAST('0x' || h[k + 1 : k + 2] AS BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM u, crc),
        s AS (SELECT bucket, count(*) AS s FROM fd JOIN b USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM fi JOIN b USING (f) GROUP BY bucket),
        a AS (SELECT (SELECT count(*) FROM fd) AS s_all, (SELECT count(*) FROM fi) AS t_all),
        g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), a),
        w AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM fd JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
        z AS (SELECT doc_id, len(ws) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
        y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (doc_id)""",
}
