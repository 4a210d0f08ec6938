"""The operators' queries over the standard tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontam, html_text, language, lexical, licenses, packing, quality, secret_scan, simhash, snapshot, substring, suffix, weighted_sampling
from brindle.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"), within=True)


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op13_snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return snapshot.difference(docs, snapshot.stated_later(docs))


def _template_rows() -> str:
    """The templates as rows (k, label, text) of the license scan's SQL."""
    return ", ".join("({}, '{}', '{}')".format(k, label, t.replace("'", "''")) for k, (label, t) in enumerate(licenses.TEMPLATES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_license_scan": op12_license_scan,
    "op13_snapshot_difference": op13_snapshot_difference,
}

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
gone AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
cut AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM gone) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ks, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
""",
    "op4_decontamination": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
spread AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM spread),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, p.n, i, item_id FROM places p JOIN win ON win.n = p.n AND win.g = array_to_string(p.w[i:i + p.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_lexical_search": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY ALL),
tf AS (SELECT doc_id, size, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS size, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * (SELECT n FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf GROUP BY t),
scores AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l))))::BIGINT AS score
           FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
""",
    "op12_license_scan": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
given(k, label, text) AS (VALUES {templates}),
t AS (SELECT k, label, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM given),
tokens AS (SELECT DISTINCT k, label, 2 * len(w) AS reach, len(list_distinct(w)) AS size, unnest(w) AS x FROM t),
placed AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
base AS (SELECT doc_id, i, label FROM (SELECT doc_id, i - 1 AS i, CASE lag(x) OVER o || ' ' || x WHEN 'mit license' THEN 'mit' WHEN 'apache license' THEN 'apache' END AS label FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE label IS NOT NULL
         UNION ALL SELECT doc_id, i - 2, 'gpl' FROM (SELECT *, lag(x, 2) OVER o || ' ' || lag(x) OVER o || ' ' || x AS three FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE three = 'general public license'),
held AS (SELECT doc_id, k, label, size, count(DISTINCT x) OVER (PARTITION BY doc_id, k ORDER BY i RANGE BETWEEN CURRENT ROW AND reach - 1 FOLLOWING) AS n FROM placed JOIN tokens USING (x)),
found AS (SELECT doc_id, label, max(n / size) AS share FROM held WHERE 5 * n >= 4 * size GROUP BY doc_id, label),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
bases AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM base GROUP BY doc_id),
shares AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN shares USING (doc_id)
""".replace("{templates}", _template_rows()),
    "op13_snapshot_difference": """
WITH c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
       lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 16 AS m FROM documents),
later AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
       CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM c WHERE coalesce(m, -1) <> 0
       UNION ALL SELECT -1 - doc_id, text, lang, source FROM c WHERE m = 5),
both_sides AS (SELECT e.doc_id AS ek, l.k AS lk, e.doc_id IS NOT NULL AND e.one IS NOT NULL AS in_e, l.one IS NOT NULL AS in_l, e.text AS et, e.lang AS el, e.source AS es, l.text AS lt, l.lang AS ll, l.source AS ls
       FROM (SELECT *, 1 AS one FROM documents) AS e FULL JOIN (SELECT *, 1 AS one FROM later) AS l ON e.doc_id = l.k),
gone AS (SELECT *, row_number() OVER (PARTITION BY et ORDER BY ek) AS i FROM both_sides WHERE in_l IS NOT TRUE),
fresh AS (SELECT *, row_number() OVER (PARTITION BY lt ORDER BY lk) AS i FROM both_sides WHERE in_e IS NOT TRUE),
content AS (SELECT g.ek, f.lk, g.i IS NOT NULL AS in_e, f.i IS NOT NULL AS in_l, g.et, g.el, g.es, f.lt, f.ll, f.ls FROM gone AS g FULL JOIN fresh AS f ON g.et IS NOT DISTINCT FROM f.lt AND g.i = f.i),
every AS (SELECT *, true AS keyed FROM both_sides WHERE in_e AND in_l UNION ALL SELECT *, false FROM content),
told AS (SELECT *, concat_ws(',', CASE WHEN et IS DISTINCT FROM lt THEN 'text' END, CASE WHEN el IS DISTINCT FROM ll THEN 'lang' END, CASE WHEN es IS DISTINCT FROM ls THEN 'source' END) AS differs FROM every)
SELECT CASE WHEN in_l THEN lk ELSE ek END AS key, ek AS old_key,
       CASE WHEN NOT in_l THEN 'delete' WHEN NOT in_e THEN 'insert' WHEN NOT keyed THEN 'rekey' WHEN differs = '' THEN 'same' ELSE 'update' END AS op,
       CASE WHEN in_e AND in_l THEN differs ELSE '' END AS changed,
       CASE WHEN in_l THEN sha256(coalesce(lt, '~') || chr(10) || coalesce(ll, '~') || chr(10) || coalesce(ls, '~')) END AS row_sha256
FROM told
""",
}
