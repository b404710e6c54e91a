"""DuckDB SQL for the rows of the queries that SQL can express, over the same tables."""

OP7 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

# Windows are cut from pieces of the text, as a string function walks to its place from the string's beginning.
OP3 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
piece AS (SELECT doc_id, k * 1000 AS base, substr(h, k * 2000 + 1, 2798) AS p
  FROM (SELECT doc_id, h, unnest(generate_series(0, (len(h) // 2 - 400) // 1000)) AS k FROM d WHERE len(h) >= 800)),
w AS (SELECT doc_id, base + i AS place, hash(substr(p, 2 * i + 1, 800)) AS g
  FROM (SELECT doc_id, base, p, unnest(generate_series(0, len(p) // 2 - 400)) AS i FROM piece WHERE len(p) >= 800)),
hit AS (SELECT doc_id, place FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
marked AS (SELECT doc_id, place, CASE WHEN place - lag(place) OVER x <= 400 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW x AS (PARTITION BY doc_id ORDER BY place)),
island AS (SELECT doc_id, place, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS nth FROM marked),
span AS (SELECT doc_id, min(place) AS a, max(place) + 400 AS b FROM island GROUP BY doc_id, nth),
cut AS (SELECT doc_id, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span) JOIN d USING (doc_id)),
total AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY a) AS kept, max(b) AS rest FROM cut GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][nth] AS DOUBLE) AS weight, CAST([-0.5, 0, 0.5][nth] AS DOUBLE) AS lean, CAST(2 AS DOUBLE) * source_size AS most FROM s),
l AS (SELECT *, most / weight AS ratio, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
t AS (SELECT source AS s, source_size, lean, coalesce(least(most, max(CASE WHEN level <= ratio THEN level END) OVER () * weight), most) AS target FROM l),
e AS (SELECT d.*, source_size, lean, target, CAST(round(target) AS BIGINT) AS owed, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON source IS NOT DISTINCT FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN owed // source_size ELSE 0 END AS passes FROM e),
r AS (SELECT *, greatest(0, least(size, owed - passes * source_size - before)) AS last FROM p),
f AS (SELECT *, CASE WHEN passes > 0 AND size > 0 THEN (before + size / 2) / target WHEN last > 0 THEN (passes * source_size + before + last / 2) / target END AS place FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, CAST(passes * size + last AS BIGINT) AS taken,
  CAST(CASE WHEN size > 0 THEN passes ELSE 0 END + CASE WHEN last > 0 THEN 1 ELSE 0 END AS BIGINT) AS draws,
  round(CASE WHEN lean = 0 THEN place ELSE (lean - 1 + sqrt((1 - lean) * (1 - lean) + 4 * lean * place)) / (2 * lean) END, 6) AS first_position
FROM f
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
x AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_sort(list_distinct(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i : i + 4], ' '))))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END AS shingles FROM w),
g AS MATERIALIZED (SELECT min(doc_id) AS node, shingles, len(shingles) AS n FROM x WHERE len(shingles) > 0 GROUP BY shingles),
u AS MATERIALIZED (SELECT node, n, unnest(shingles) AS shingle FROM g),
link AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
either_way AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node, node AS other FROM g UNION SELECT reach.node, b FROM reach JOIN either_way ON a = other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(len(x.shingles) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM x LEFT JOIN (SELECT shingles, component_id FROM g JOIN least USING (node)) USING (shingles)
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP11 = f"""
WITH q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(t) * docs) // words AS m FROM d, s),
f AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) WHERE rank <= 50
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 : n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {"op3_suffix_dedup": OP3, "op7_exact_dedup": OP7, "op8_mix": OP8, "op10_ngram_join": OP10, "op11_wand": OP11, "op12_fim": OP12}
