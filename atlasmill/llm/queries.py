"""Queries of the corpus operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasmill.llm.decontam import leaks
from atlasmill.llm.dialogue import repair_digests
from atlasmill.llm.jaccard import jaccard_groups
from atlasmill.llm.langid import identify
from atlasmill.llm.media import media_digests
from atlasmill.llm.mixing import mix_digests
from atlasmill.llm.packing import pack
from atlasmill.llm.quality import quality_posteriors
from atlasmill.llm.ranking import ranked
from atlasmill.llm.substring import substring_dedup
from atlasmill.llm.suffix import repeated_bytes_removed
from atlasmill.llm.tables import read
from atlasmill.llm.urlfilter import ADDRESS, CANONICAL, HREF, REFRESH, RULES, TRACKING, UNREAD, filter_urls
from atlasmill.llm.warc import archive_digests


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes_removed(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(read(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_posteriors(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digests(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(read(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _normal(url: str) -> str:
    query = f"regexp_replace(regexp_replace(regexp_extract({url}, '(?s)^[^?#]*\\?([^#]*)', 1), '(?i)(?:^|&){TRACKING}=[^&]*', '', 'g'), '^&+', '')"
    form = f"regexp_replace({_host(url)}, ':(?:80|443)$', '') || regexp_replace({_path(url)}, '/+$', '') || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
    return f"CASE WHEN regexp_replace({_host(url)}, ':(?:80|443)$', '') <> '' THEN {form} END"


def _no_dots(path: str) -> str:
    parts = f"string_split({path} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END, '/')[2:]"
    step = "CASE WHEN part[1] = '..' THEN seen[:len(seen) - 1] WHEN part[1] = '.' THEN seen ELSE seen || part END"
    kept = f"list_reduce(list_transform({parts}, lambda part: [part]), lambda seen, part: {step}, CAST([] AS VARCHAR[]))"
    return f"CASE WHEN contains({path}, '/.') THEN '/' || array_to_string({kept}, '/') ELSE {path} END"


def _resolved(url: str, to: str) -> str:
    origin = f"nullif(regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1), '')"
    path, rest = f"regexp_extract({to}, '(?s)^[^?#]*')", f"regexp_extract({to}, '(?s)^[^?#]*(.*)', 1)"
    folder = f"('/' || regexp_extract({_path(url)}, '(?s)^/(.*/)', 1))"
    return f"""CASE WHEN regexp_matches({to}, '(?i)^[a-z][a-z0-9+.-]*://') THEN {to} WHEN regexp_matches({to}, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN {to} LIKE '//%' THEN 'http:' || {to}
        WHEN {to} LIKE '#%' THEN regexp_extract({url}, '(?s)^[^#]*') || {to} WHEN {to} LIKE '?%' THEN {origin} || {_path(url)} || {to}
        WHEN {to} LIKE '/%' THEN {origin} || {_no_dots(path)} || {rest} WHEN {to} IS NOT NULL THEN {origin} || {_no_dots(f"({folder} || {path})")} || {rest} END"""


def _found(tag: str, pattern: str) -> str:
    return f"nullif(replace(regexp_extract({tag}, {_quoted(pattern)}, 1), '&amp;', '&'), '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _best(columns: str, source: str) -> str:
    """Rows with their longest fitting rule and its verdict, null where none fits; columns begin with a key."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    fits = "(j.host = r.rh OR ends_with(j.host, '.' || r.rh)) AND starts_with(j.path, r.rp)"
    best = "arg_max({'rule': r.rh || r.rp, 'verdict': r.v}, length(r.rh || r.rp) * 2 + (r.v = 'allow')::INT)"
    return f"SELECT {columns}, (SELECT {best} FROM (VALUES {rules}) r(rh, rp, v) WHERE {fits}) AS best FROM (SELECT *, {_host('url')} AS host, {_path('url')} AS path, {_normal('url')} AS node FROM {source}) j"


URL_SQL = f"""
    WITH RECURSIVE tags AS (SELECT url, regexp_extract_all(regexp_replace(html, {_quoted(UNREAD)}, ' ', 'g'), '(?is)<(?:link|meta|base)\\b[^>]*>') AS tags FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
    based AS (SELECT url, tags, {_found(f"list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base\\b') AND regexp_matches(t, {_quoted(HREF)}))[1]", HREF)} AS base FROM tags),
    opened AS (SELECT url, coalesce({_resolved('url', 'base')}, url) AS origin, unnest(tags) AS tag FROM based),
    pointed AS (SELECT url, origin, CASE WHEN regexp_matches(tag, {_quoted(CANONICAL)}) THEN {_found('tag', HREF)} WHEN regexp_matches(tag, {_quoted(REFRESH)}) THEN {_found('tag', ADDRESS)} END AS target FROM opened),
    link AS (SELECT url AS src, dst FROM (SELECT url, {_resolved('origin', 'target')} AS dst FROM pointed WHERE target IS NOT NULL) WHERE dst IS NOT NULL),
    address AS (SELECT DISTINCT src AS url FROM link UNION SELECT dst FROM link),
    page AS ({_best('page_id, host, path, node', 'pages')}), named AS ({_best('node', 'address')}),
    edge AS (SELECT DISTINCT a, b FROM (SELECT {_normal('src')} AS a, {_normal('dst')} AS b FROM link) WHERE a IS NOT NULL AND b IS NOT NULL),
    both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
    node AS (SELECT node FROM page WHERE node IS NOT NULL UNION SELECT node FROM named WHERE node IS NOT NULL),
    walk(node, seen) AS (SELECT node, node FROM node UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON e.a = w.seen),
    label AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
    said AS (SELECT component, min(best.verdict) AS verdict FROM (SELECT node, best FROM page UNION ALL SELECT node, best FROM named) JOIN label USING (node) WHERE best IS NOT NULL GROUP BY component)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, s.verdict, 'allow') AS verdict, l.component FROM page p LEFT JOIN label l ON l.node = p.node LEFT JOIN said s ON s.component = l.component"""

QUERIES = {f.__name__: f for f in (op1_media_columns, op2_url_filters, op3_suffix_array_dedup, op4_warc, op5_best_fit_packing, op6_quality_classifier, op7_benchmark_decontamination, op8_substring_dedup, op9_language_id, op10_ngram_jaccard_join, op11_source_mixing, op12_conversation_repair, op13_ranked_search)}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": URL_SQL,
    "op3_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        g AS (SELECT doc_id, i, k, md5(b[i:i + k - 1]) AS h FROM (SELECT doc_id, b, k, unnest(range(1, octet_length(b) - k + 2)) AS i FROM d, (VALUES (400), (256)) AS size(k) WHERE octet_length(b) >= k)),
        m AS (SELECT doc_id, i, k FROM (SELECT doc_id, i, k, count(*) OVER w AS c, min(doc_id) OVER w <> max(doc_id) OVER w AS other FROM g WINDOW w AS (PARTITION BY k, h)) WHERE CASE WHEN k = 400 THEN c > 1 ELSE other END),
        r AS (SELECT doc_id, i, k, sum(new) OVER (PARTITION BY doc_id, k ORDER BY i) AS run FROM (SELECT doc_id, i, k, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) + k THEN 0 ELSE 1 END AS new FROM m)),
        s AS (SELECT doc_id, k, min(i) AS a, max(i) + k AS z FROM r GROUP BY doc_id, k, run),
        c AS (SELECT doc_id, sum(z - a) FILTER (k = 400)::BIGINT AS n_removed, count(*) FILTER (k = 400) AS n_spans, sum(z - a) FILTER (k = 256)::BIGINT AS n_shared, list(a ORDER BY a) FILTER (k = 400) AS a, list(z ORDER BY a) FILTER (k = 400) AS z FROM s GROUP BY doc_id)
        SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_shared, 0)::BIGINT AS n_shared,
               sha256(CASE WHEN a IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda j: hex(b[(CASE WHEN j = 1 THEN 1 ELSE z[j - 1] END):(CASE WHEN j > len(a) THEN octet_length(b) ELSE a[j] - 1 END)])), '')) END) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)""",
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 85 * (x.n + y.n - hits)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        walk(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.node, e.b FROM walk JOIN e ON e.a = walk.seen)
        SELECT w.node AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id FROM walk w LEFT JOIN n ON n.doc_id = w.node GROUP BY w.node""",
    "op8_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
            FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents)),
        g AS (
            SELECT *, string_agg(word, ' ') OVER s AS gram, count(*) OVER s AS n
            FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        m AS (SELECT *, n = 13 AND min(CASE WHEN n = 13 THEN doc_id END) OVER (PARTITION BY gram) < doc_id AS hit FROM g),
        r AS (
            SELECT *, bool_or(coalesce(hit, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
        k AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
                   sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept
            FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept, sha256('')) AS kept_sha256
        FROM documents d LEFT JOIN k USING (doc_id)""",
    "op11_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || left(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::HUGEINT AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w FROM d GROUP BY source),
        o AS (
            SELECT *, row_number() OVER o AS k, (SELECT sum(s) FROM s)::HUGEINT - coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS budget,
                   (SELECT sum(w) FROM s)::HUGEINT - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS rest
            FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * s / w, source)),
        f AS (SELECT arg_min(budget, k) AS budget, arg_min(rest, k) AS rest FROM o WHERE budget * w <= 3 * s * rest),
        t AS (SELECT source, s::BIGINT AS source_size, least(3.0::DOUBLE * s, CASE WHEN f.rest IS NULL THEN 3.0::DOUBLE * s ELSE (f.budget * w)::DOUBLE / f.rest::DOUBLE END) AS target FROM s LEFT JOIN f ON true),
        b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
        c AS (
            SELECT d.*, source_size, target, whole, target - whole * source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS upto, sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS n
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n)) THEN 1 ELSE 0 END) AS taken FROM c""",
    "op13_ranked_search": r"""
        WITH word AS (SELECT doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)),
        asked AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        size AS (SELECT r, count(*) AS n FROM word GROUP BY r),
        total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM size),
        entry AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
        weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM entry, total GROUP BY term),
        impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))) AS v FROM entry JOIN weight USING (term) JOIN size USING (r), total),
        score AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(v)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY item_id, text, r HAVING sum(v) > 0)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM score QUALIFY rank <= 20""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        k AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < keep THEN keep END AS refers_to
        FROM p LEFT JOIN k USING (d)""",
}
