"""DuckDB SQL of the registered queries that SQL can express."""

from tracesieve.llm.licenses import LOWER, MORE, TEMPLATES, UPPER

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|' || regexp_replace(role, '([<\[|\\])', '\1\\', 'g') || '|>' || regexp_replace(text, '([<\[|\\])', '\1\\', 'g') || '<|end|>'))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


MERKLE = """
WITH RECURSIVE told AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND list_reduce(
      flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT) & 1 = 1
    THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM documents
),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS other
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM told)
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g
  FROM hashed
),
up AS (
  SELECT g, i, n, leaf AS h, 0 AS lvl FROM leaves
  UNION ALL
  SELECT g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)), lvl + 1 FROM up WHERE n > 1 GROUP BY g, i // 3, n, lvl
),
subroots AS (SELECT g, h, lvl AS height FROM up WHERE n = 1),
over_up AS (
  SELECT g AS i, (SELECT count(*) FROM subroots) AS n, h, 0 AS lvl FROM subroots
  UNION ALL
  SELECT i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)), lvl + 1 FROM over_up WHERE n > 1 GROUP BY i // 3, n, lvl
),
nodes AS (SELECT 0 AS t, g, lvl, i, n, h FROM up UNION ALL SELECT 1, 0, lvl, i, n, h FROM over_up),
beside AS (
  SELECT a.t, a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a LEFT JOIN nodes b ON a.t = b.t AND a.g = b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 AND a.i <> b.i
  WHERE a.n > 1 GROUP BY a.t, a.g, a.lvl, a.i
),
inside AS (
  SELECT doc_id, leaf, g, i AS own, i, 0 AS lvl, other AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, f.g, f.own, f.i // 3, f.lvl + 1, sha256(b.before || f.h || b.after), f.proof || b.before || b.after
  FROM inside f JOIN beside b ON b.t = 0 AND b.g = f.g AND b.lvl = f.lvl AND b.i = f.i
),
outside AS (
  SELECT f.doc_id, f.leaf, f.g, f.own, s.h AS subroot, f.g AS i, 0 AS lvl, f.h, f.proof FROM inside f JOIN subroots s ON s.g = f.g AND s.height = f.lvl
  UNION ALL
  SELECT f.doc_id, f.leaf, f.g, f.own, f.subroot, f.i // 3, f.lvl + 1, sha256(b.before || f.h || b.after), f.proof || b.before || b.after
  FROM outside f JOIN beside b ON b.t = 1 AND b.lvl = f.lvl AND b.i = f.i
)
SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM outside f JOIN over_up r ON r.n = 1 AND r.lvl = f.lvl
"""


def licenses_sql() -> str:
    """Every template tried at every word of a text that has its first phrase: no index, no counts."""
    every = TEMPLATES + MORE
    spans = ", ".join(f"CASE WHEN contains(t, '|{'|'.join(t.keys[0][1])}|') THEN list_filter(range(-{len(t.words)}, len(w)), lambda s: " + " AND ".join(f"(s + {k} >= 0 AND list_slice(w, s + {k + 1}, s + {k + len(own)}) = {list(own)})" for k, own in t.keys) + f") ELSE [] END AS p{n}" for n, t in enumerate(every))
    base = range(len(TEMPLATES))
    starts = "list_concat(" + ", ".join(f"p{n}" for n in base[:2]) + ")"
    for n in base[2:]:
        starts = f"list_concat({starts}, p{n})"

    def labels(which: range) -> str:
        own = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{every[n].label}' END" for n in which)
        return f"array_to_string(list_sort(list_distinct([{own}])), ',')"

    shares = ", ".join(f"coalesce(list_max(list_transform(p{n}, lambda s: len(list_filter(range({len(t.words)}), lambda i: s + i >= 0 AND w[s + i + 1] = {list(t.words)}[i + 1])) / {len(t.words)}.0)), 0)" for n, t in enumerate(every))
    return f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
),
n AS (SELECT *, '|' || array_to_string(w, '|') || '|' AS t FROM d),
p AS (SELECT doc_id, w, {spans} FROM n)
SELECT doc_id, len(w)::BIGINT AS n_words, len({starts})::BIGINT AS n_base, list_min({starts})::BIGINT AS first_word,
  list_max({starts})::BIGINT AS last_word, {labels(base)} AS base_labels, {labels(range(len(every)))} AS labels,
  greatest({shares})::DOUBLE AS score
FROM p
"""


ORACLE_SQL = {
    "op1_chat_format": CHAT,
    "op6_license_scan": licenses_sql(),
    "op5_exact_top_k": TOP_K,
    "op12_merkle_manifest": MERKLE,
}
