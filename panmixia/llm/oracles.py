"""DuckDB's version of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def _host_quality() -> str:
    names = list(_RULES)
    share = {k: f"least(greatest(m_{k}, 1e-6), 1 - 1e-6)" for k in names}
    between = {k: f"(v_{k} - {share[k]} * (1 - {share[k]}) * inverse)" for k in names}
    strength = {k: f"CASE WHEN {between[k]} > 0 THEN least(greatest({share[k]} * (1 - {share[k]}) / {between[k]} - 1, 1.0), 1e4) ELSE 1e4 END" for k in names}
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
tri AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT row, i FROM tri QUALIFY count(*) OVER (PARTITION BY row, s) > 1),
cov AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
c AS (SELECT d.row, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN cov ON cov.row = d.row),
r AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM c), f AS (SELECT *, {", ".join(f"({v}) AS {k}" for k, v in _RULES.items())} FROM r),
h AS (SELECT source, count(*) AS docs, {", ".join(f"count(*) FILTER ({k}) AS {k}" for k in names)} FROM f GROUP BY 1),
m AS (SELECT {", ".join(f"avg({k} / docs) AS m_{k}, coalesce(var_samp({k} / docs), 0) AS v_{k}" for k in names)}, avg(1 / docs) AS inverse FROM h),
s AS (SELECT {", ".join(f"{share[k]} AS p_{k}, {strength[k]} AS s_{k}" for k in names)} FROM m),
j AS (SELECT source, docs, greatest({", ".join(f"({k} + p_{k} * s_{k}) / (docs + s_{k})" for k in names)}) > 0.5 AS host_rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT (host_rejected AND ({" OR ".join(names)})) AS kept, f.source AS host, docs AS host_docs, host_rejected
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source"""


_JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 10 * c >= 8 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS r FROM d UNION SELECT l.y AS x, reach.r FROM reach JOIN l ON l.x = reach.x),
k AS (SELECT x, min(r) AS class_id FROM reach GROUP BY 1), t AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, k.class_id, coalesce(t.n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles FROM d JOIN k ON k.x = d.doc_id LEFT JOIN t ON t.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


def _source_mix() -> str:
    """A document's words of the stream are taken in every whole round of its source, and as far as the last round goes."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1]::DOUBLE[])[(source_no - 1) % 3 + 1] AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight FROM w
  WINDOW b AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT coalesce(arg_min(left_size / left_weight, (cap / weight, source_no)), 0) AS level FROM o WHERE left_size / left_weight <= cap / weight),
t AS (SELECT source, source_no, source_size, least(cap, weight * level) AS target, least(3 * source_size, round(least(cap, weight * level))::BIGINT) AS quota FROM w, stop),
p AS (SELECT doc_id, size, source_size, target, source_no, quota, coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15), row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(least(first + size, quota % source_size) - first, 0) END::BIGINT AS taken, source_no FROM p"""


ORACLE = {"op4_host_quality": _host_quality(), "op6_jaccard_join": _JACCARD, "op9_warc": _WARC, "op10_source_mix": _source_mix()}
