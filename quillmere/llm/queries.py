"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .conversations import op12_conversations
from .decontaminate import op10_decontaminate
from .embedding_dups import op7_embeddings
from .langid import op2_language
from .licenses import licence_sql, op6_licenses
from .ngram_join import op1_ngram_join
from .periodic_runs import op11_periodic_runs
from .pii import op13_personal_data
from .quality import op3_quality
from .secrets import RULES, op5_secrets
from .suffix_dedup import op8_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_secrets": op5_secrets,
    "op6_licenses": op6_licenses,
    "op7_embeddings": op7_embeddings,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversations": op12_conversations,
    "op13_personal_data": op13_personal_data,
}

#: Every pair by plain set arithmetic, so it also shows what banding finds of it. DuckDB holds all shared n-grams for this: for small tables.
_NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, shared = nx.n AND shared = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE CAST(shared AS DOUBLE) / (nx.n + ny.n - shared) >= 0.8),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY x),
k AS (SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS twins FROM l GROUP BY x)
SELECT c.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(twins, 0) + 1 AS copies, c.doc_id = class_id AS kept FROM c LEFT JOIN k ON k.doc_id = c.doc_id
"""

_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.vec_id = c.vec_id
"""


def _secret_sql() -> str:
    """Every rule by its regex over every text: no index, so it also checks that the index loses nothing."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    per_rule = []
    for rank, rule in enumerate(RULES):
        pattern = quote(rule.pattern)
        per_rule.append(f"""
          SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
                 unnest(list_transform(range(1, len(hits) + 1), lambda i: {{'a': coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0), 'n': length(hits[i]), 'j': length(judged[i])}})) AS m
          FROM (SELECT rid, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS hits, regexp_extract_all(text, {pattern}, {rule.group}) AS judged FROM d)""")
    least = " ".join(f"WHEN {rank} THEN {rule.least}" for rank, rule in enumerate(RULES))
    shown = "kind || ':' || a || ':' || (a + n)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    s AS (SELECT rid, rank, kind, base, CAST(m.a AS BIGINT) AS a, m.n AS n FROM ({" UNION ALL ".join(per_rule)}) WHERE m.j >= CASE rank {least} END),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg({shown}, ',' ORDER BY a, rank) FILTER (base) AS base, string_agg({shown}, ',' ORDER BY a, rank) AS spans FROM s GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)"""


#: The same repair row by row: a recursion over the turns with the four cheapest ways as columns. CRC-32 bit by bit, since DuckDB has none.
_CONVERSATION_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)), 4294967295), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE h WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS ended FROM o),
j AS (SELECT *, blank OR again AS bad, CASE WHEN blank OR again OR ended THEN 0 ELSE 1 END AS late FROM f),
-- of each state: cost, audit and the repaired lines; a way that is not there costs 1e9
w(conv_id, i, s, y, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': 0, 'p': '', 't': ''}, {'c': 1000000000, 'p': '', 't': ''}, {'c': 2, 'p': 'I', 't': chr(10) || 'user:'}, {'c': 4, 'p': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} FROM conversations
  UNION ALL
  SELECT conv_id, i, s, y, v, list_min([b, {'c': v.c + 2, 'p': v.p || 'I', 't': v.t || chr(10) || 'assistant:'}]) FROM (
    SELECT conv_id, i, s, y, b, list_min([v, {'c': s.c + 2, 'p': s.p || 'I', 't': s.t || chr(10) || 'user:'}, {'c': y.c + 2, 'p': y.p || 'I', 't': y.t || chr(10) || 'user:'}, {'c': b.c + 2, 'p': b.p || 'I', 't': b.t || chr(10) || 'user:'}]) AS v FROM (
      SELECT w.conv_id, j.i AS i, {'c': s.c + 3, 'p': s.p || 'D', 't': s.t} AS s,
        list_min([{'c': y.c + 3, 'p': y.p || 'D', 't': y.t}, {'c': CASE WHEN bad OR r <> 's' THEN 1000000000 ELSE s.c + late END, 'p': s.p || 'K', 't': s.t || chr(10) || role || ':' || text}]) AS y,
        list_min([{'c': u.c + 3, 'p': u.p || 'D', 't': u.t}] || list_transform([s, y, a], lambda x: {'c': CASE WHEN bad THEN 1000000000 ELSE x.c + late + CASE WHEN r = 'u' THEN 0 ELSE 2 END END, 'p': x.p || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END, 't': x.t || chr(10) || CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text})) AS v,
        list_min([{'c': a.c + 3, 'p': a.p || 'D', 't': a.t}, {'c': CASE WHEN bad THEN 1000000000 ELSE u.c + late + CASE WHEN r = 'a' THEN 0 ELSE 2 END END, 'p': u.p || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END, 't': u.t || chr(10) || CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text}]) AS b
      FROM w JOIN j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1))),
e AS (SELECT conv_id, list_min([s, a]) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late = 1) AS truncated,
      count(*) FILTER (was IS NOT NULL AND was || r NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best.c AS BIGINT) AS cost, best.p AS audit, sha256(best.t[2:]) AS repaired_sha256
FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE_SQL = {
    "op12_conversations": _CONVERSATION_SQL,
    "op1_ngram_join": _NGRAM_SQL,
    "op7_embeddings": _VECTOR_SQL,
    "op5_secrets": _secret_sql(),
    "op6_licenses": licence_sql(),
}
