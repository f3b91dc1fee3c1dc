"""The queries of this subpackage over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from .common import table
from .chat import link_quotations
from .decontaminate import contaminated
from .fingerprints import edited_fingerprints
from .licenses import license_scan
from .mixing import mix
from .simhash import simhash_components
from .suffix_dedup import suffix_dedup
from .token_counts import count_tokens
from .toxicity import toxicity
from .url_filter import rules_frame, url_filter


def op1_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat_quotes(spark, sf_dir):
    return link_quotations(table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


#: the conversations with quotations put in: attributed, nested, with other spaces and signs, excerpts, and of one message again and again
_Q = "concat('> ', replace(%s, chr(10), concat(chr(10), '> ')))"
QUOTED_REPLIES = f"""SELECT conv_id, turn, role, CASE WHEN turn = 0 OR p1 IS NULL THEN text
  WHEN (conv_id + turn) % 6 = 0 THEN concat('Ann wrote:', chr(10), {_Q % 'p1'}, chr(10), text)
  WHEN (conv_id + turn) % 6 = 1 AND p2 IS NOT NULL THEN concat(replace({_Q % 'p2'}, '> ', '>> '), chr(10), {_Q % 'p1'}, chr(10), chr(10), text)
  WHEN (conv_id + turn) % 6 = 2 THEN concat({_Q % "replace(p1, ' ', ' , ')"}, ' !!', chr(10), text)
  WHEN (conv_id + turn) % 6 = 3 THEN concat('> ', regexp_replace(substring(regexp_replace(replace(p1, chr(10), ' '), '^[^ ]+ [^ ]+ ', ''), 1, 90), ' [^ ]*$', ''), chr(10), text)
  WHEN (conv_id + turn) % 6 = 4 THEN concat(text, chr(10), replace({_Q % 'p0'}, '. ', concat('.', chr(10), '> ')), chr(10), '> ', chr(10), {_Q % 'p1'})
  ELSE text END AS text
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p1, lag(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS p2,
        first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p0 FROM conversations) c"""


def chat_quoted_replies(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return link_quotations(spark.sql(QUOTED_REPLIES))


QUERIES = {
    "chat_quoted_replies": chat_quoted_replies,
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_chat_quotes": op8_chat_quotes,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
}

CHAT_SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS t,
         regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
own AS (
  SELECT *, array_to_string(list_filter(ls, lambda x, i: NOT regexp_matches(x, '^\s*>')
      AND NOT (regexp_matches(x, '(wrote|writes|said|schrieb|escribió|écrit)\s*:\s*$') AND coalesce(regexp_matches(ls[i + 1], '^\s*>'), false))), chr(10)) AS own FROM m),
units AS (
  SELECT DISTINCT conv_id, turn, unnest(list_distinct(list_concat(list_concat(regexp_split_to_array(own, '\n\s*\n'), string_split(own, chr(10))), [own]))) AS u FROM own),
norm_units AS (
  SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(u, chr(10), ' ')), '^(?:\s*>)+', ''), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM units),
keys AS (SELECT conv_id, n, min(turn) AS origin FROM norm_units WHERE n <> '' GROUP BY conv_id, n),
lines AS (SELECT rid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM m),
leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^((?:\s*>)+)', 1), '[^>]', '', 'g')) AS lv,
         trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '^(?:\s*>)+', ''), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM lines),
marked AS (SELECT *, CASE WHEN lag(lv) OVER (PARTITION BY rid ORDER BY pos) IS DISTINCT FROM lv THEN 1 ELSE 0 END AS fresh FROM leveled),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS no FROM marked),
passages AS (
  SELECT rid, conv_id, turn, no, lv, list_filter(list(n ORDER BY pos), lambda x: x <> '') AS ns,
         regexp_replace(array_to_string(list(n ORDER BY pos), chr(10)), '^\n+|\n+$', '', 'g') AS txt FROM runs WHERE lv > 0 GROUP BY rid, conv_id, turn, no, lv),
paragraphs AS (SELECT rid, conv_id, turn, no, lv, unnest(regexp_split_to_array(txt, '\n\n+')) AS p FROM passages),
keyed AS (
  SELECT rid, conv_id, turn, no, lv, array_to_string(ns, ' ') AS n, len(ns) + 1 AS w FROM passages
  UNION ALL SELECT rid, conv_id, turn, no, lv, replace(p, chr(10), ' '), len(string_split(p, chr(10))) FROM paragraphs
  UNION ALL SELECT rid, conv_id, turn, no, lv, unnest(ns), 1 FROM passages),
votes AS (
  SELECT k.rid, k.no, k.lv, CASE WHEN origin < k.turn THEN origin END AS origin, sum(w) AS w
  FROM keyed k LEFT JOIN keys USING (conv_id, n) GROUP BY 1, 2, 3, 4),
found AS (
  SELECT rid, no, lv, arg_max(origin, (w, -origin)) FILTER (WHERE origin IS NOT NULL) AS origin FROM votes GROUP BY rid, no, lv),
wanted AS (
  SELECT p.rid, p.conv_id, p.turn, p.no, string_split(array_to_string(ns, ' '), ' ') AS ws FROM passages p JOIN found f ON f.rid = p.rid AND f.no = p.no WHERE f.origin IS NULL),
shingles AS (SELECT DISTINCT rid, conv_id, turn, no, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM wanted WHERE len(ws) >= 5)),
own_words AS (
  SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(own, chr(10), ' ')), '^(?:\s*>)+', ''), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS ws
  FROM own WHERE conv_id IN (SELECT conv_id FROM wanted)),
first_has AS (
  SELECT conv_id, s, min(turn) AS origin FROM (SELECT conv_id, turn, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM own_words WHERE len(ws) >= 5)) GROUP BY conv_id, s),
sizes AS (SELECT rid, no, count(*) AS n FROM shingles GROUP BY rid, no),
shares AS (SELECT g.rid, g.no, h.origin, count(*) AS w FROM shingles g JOIN first_has h ON h.conv_id = g.conv_id AND h.s = g.s AND h.origin < g.turn GROUP BY g.rid, g.no, h.origin),
excerpts AS (SELECT rid, no, arg_max(origin, (w, -origin)) AS origin FROM shares JOIN sizes USING (rid, no) WHERE w >= 0.8 * n GROUP BY rid, no),
best AS (SELECT f.rid, f.no, f.lv, coalesce(f.origin, e.origin) AS origin FROM found f LEFT JOIN excerpts e ON e.rid = f.rid AND e.no = f.no),
links AS (
  SELECT rid, count(*) AS n_quotes, count(origin) AS n_linked, arg_min(origin, (lv, no)) FILTER (WHERE origin IS NOT NULL) AS parent FROM best GROUP BY rid),
edges AS (
  SELECT conv_id, turn, min(parent) AS parent FROM m JOIN links USING (rid) WHERE parent IS NOT NULL GROUP BY conv_id, turn),
walk AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM edges
  UNION ALL SELECT w.conv_id, w.turn, e.parent, w.depth + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.turn = w.root),
roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM walk GROUP BY conv_id, turn)
SELECT o.conv_id, o.turn, o.role, o.own AS text, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, parent AS parent_turn,
       coalesce(r.root, o.turn) AS root_turn, coalesce(r.depth, 0) AS depth, '<|' || o.role || '|>' || chr(10) || o.own AS formatted
FROM own o LEFT JOIN links USING (rid) LEFT JOIN roots r ON r.conv_id = o.conv_id AND r.turn = o.turn
"""

ORACLES = {
    "op8_chat_quotes": CHAT_SQL,
    "chat_quoted_replies": CHAT_SQL.replace("FROM conversations", f"FROM ({QUOTED_REPLIES})"),
    "op10_url_filter": r"""
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'),
         ('block','net','/es/'), ('block','net','/fr/')),
u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS rid FROM u),
m AS (
  SELECT rid, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, verdict DESC) AS k
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.rid = h.rid AND m.k = 1
""",
}
