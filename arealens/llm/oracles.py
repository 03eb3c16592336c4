"""DuckDB SQL for the queries that SQL can express.

Token ids, compression sizes and parsed fingerprints have no SQL form; those
queries are tested against plain versions in ``tests/llm``.
"""

from __future__ import annotations

from . import secret_scan
from .queries import MIX

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Lines as code points: edit distance in SQL counts bytes, so the letters beyond
# ASCII are first mapped to one-byte control characters, one for each.
OP1 = r"""
WITH strange AS (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS s FROM (
    SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM documents)),
signs AS (
  SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) AS s FROM (
    SELECT unnest(list_concat(range(1, 9), list_concat(range(14, 32), [127]))) AS i)),
numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n
  FROM documents WHERE text IS NOT NULL),
firsts AS (
  SELECT line, min(struct_pack(d := doc_id, n := n)) AS p FROM numbered WHERE length(line) >= 16 GROUP BY line),
plain AS (
  SELECT p, length(line) AS k, translate(line, (SELECT s FROM strange), (SELECT left(signs.s, length(strange.s)) FROM signs, strange)) AS line
  FROM firsts),
links AS (
  SELECT a.p AS a, b.p AS b FROM plain a JOIN plain b ON a.p < b.p AND b.k BETWEEN a.k - 2 AND a.k + 2
  WHERE (contains(b.line, left(a.line, a.k // 3)) OR contains(b.line, substr(a.line, a.k // 3 + 1, 2 * a.k // 3 - a.k // 3))
         OR contains(b.line, substr(a.line, 2 * a.k // 3 + 1))) AND levenshtein(a.line, b.line) <= 2),
judged AS (
  SELECT p, sum(link) AS links, max(gone) AS gone FROM (
    SELECT a AS p, 1 AS link, 0 AS gone FROM links UNION ALL SELECT b, 1, 1 FROM links) GROUP BY p),
marked AS (
  SELECT x.doc_id, x.n, x.line, coalesce(j.links, 0) AS links,
         length(x.line) < 16 OR (f.p.d = x.doc_id AND f.p.n = x.n AND coalesce(j.gone, 0) = 0) AS stays,
         f.p.d = x.doc_id AND f.p.n = x.n AS is_first
  FROM numbered x LEFT JOIN firsts f ON f.line = x.line LEFT JOIN judged j ON j.p = f.p)
SELECT d.doc_id, coalesce(count(m.n), 0)::BIGINT AS n_lines, count(*) FILTER (WHERE m.n IS NOT NULL AND NOT m.stays)::BIGINT AS n_removed,
       coalesce(sum(m.links) FILTER (WHERE m.is_first), 0)::BIGINT AS n_links,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.n) FILTER (WHERE m.stays), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _op3() -> str:
    """Every rule's spans from the texts between its matches."""
    parts = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern
        if pattern.startswith("(?i)"):  # either case of ASCII letters only
            body, group2 = pattern[4:].rsplit("(", 1)
            folded = "".join(f"[{c}{c.upper()}]" if c.isascii() and c.islower() and body[max(0, i - 1)] != "\\"
                             and not body[max(0, i - 2):i].endswith("\\x") else c for i, c in enumerate(body))
            pattern = folded + "(" + group2
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, gap, hit, value, {rule.at_least} AS least FROM (
    SELECT doc_id, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit,
           regexp_extract_all(t, '{p}', {rule.group}) AS value FROM texts) WHERE len(hit) > 0""")
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE_KINDS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in secret_scan.BASE_KINDS)
    span = "kind || ':' || s || ':' || e"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
hits AS (
  SELECT doc_id, rank, kind, least, unnest(hit) AS hit, unnest(value) AS value, unnest(gap[1:len(hit)]) AS gap,
         unnest(range(len(hit))) AS k FROM matched),
spans AS (
  SELECT *, e - length(hit) AS s FROM (
    SELECT doc_id, rank, kind, least, hit, value,
           sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY k)::BIGINT AS e FROM hits)
  WHERE length(value) >= least),
found AS (
  SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY s, rank) FILTER (WHERE kind IN ({base})) AS base,
         string_agg({span}, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secret_scan.BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id)
"""


OP4 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY h) AS first FROM windows)
  WHERE struct_pack(d := doc_id, i := i) > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
marked AS (SELECT words.*, gone.k IS NOT NULL AS out FROM words LEFT JOIN gone USING (doc_id, k)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT out) AS kept
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH messages AS (
  SELECT DISTINCT conv_id, turn, turn // 256 AS part, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         role IS NULL AS nameless FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM messages WHERE NOT nameless AND role <> 'system'),
drawn AS (
  SELECT m.conv_id, s.speaker, part, turn, role, text, nameless, role = speaker AND NOT nameless AS own,
         CASE WHEN role = speaker AND NOT nameless THEN '<|im_start|>assistant' || chr(10)
              WHEN role = 'system' AND NOT nameless THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head
  FROM messages m JOIN speakers s ON s.conv_id IS NOT DISTINCT FROM m.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(text) + 11) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY turn, role, text, nameless ROWS UNBOUNDED PRECEDING)::BIGINT AS next FROM drawn)
SELECT conv_id, speaker, part, count(*) AS n_messages, count(*) FILTER (WHERE own) AS n_targets,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text, nameless) AS dialogue,
       coalesce(string_agg((next - 11 - length(text)) || ':' || (next - 1), ',' ORDER BY turn, role, text, nameless)
                FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""

OP6 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 75 * (x.n + y.n - met.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / sqrt(list_dot_product(q.x, q.x) * list_dot_product(c.x, c.x)) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _weight(kind: str, name: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in sorted(MIX["weights"].get(kind, {}).items()))
    return f"CASE {name} {cases} ELSE 1 END::BIGINT" if cases else "1::BIGINT"


def _divided(level: str, nodes: str, parent: str, child: str) -> str:
    """Water-filling among the children of each parent, as three CTEs."""
    order = f"PARTITION BY {parent} ORDER BY cap / w, {child}"
    return f"""
{level}_a AS (
  SELECT *, given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM ({nodes})),
{level}_b AS (
  SELECT *, max(left_over) FILTER (WHERE cap * w_rest > left_over * w) OVER (PARTITION BY {parent}) AS pool,
         max(w_rest) FILTER (WHERE cap * w_rest > left_over * w) OVER (PARTITION BY {parent}) AS pool_w FROM {level}_a),
{level} AS (
  SELECT *, CASE WHEN cap * w_rest <= left_over * w THEN cap ELSE (pool * w) // pool_w END AS budget FROM {level}_b)"""


def _op10() -> str:
    domains = _divided("domains", f"""SELECT domain, sum(cap) AS cap, {_weight('domain', 'domain')} AS w,
      floor((SELECT sum(tokens) FROM leaves) * {MIX['share']}::DOUBLE)::BIGINT AS given, 0 AS root FROM leaves GROUP BY domain""", "root", "domain")
    langs = _divided("langs", f"""SELECT l.domain, l.lang, l.cap, {_weight('lang', 'l.lang')} AS w, d.budget AS given
      FROM (SELECT domain, lang, sum(cap) AS cap FROM leaves GROUP BY ALL) l JOIN domains d USING (domain)""", "domain", "lang")
    sources = _divided("sources", f"""SELECT l.domain, l.lang, l.source, l.tokens, l.cap, {_weight('source', 'l.source')} AS w, p.budget AS given
      FROM leaves l JOIN langs p USING (domain, lang)""", "domain, lang", "source")
    return rf"""
WITH docs AS (
  SELECT doc_id, lang AS raw_lang, source AS raw_source, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]+$')
              THEN 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
         len({_WORDS})::BIGINT AS n FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {MIX['max_epochs']})::BIGINT AS cap FROM docs WHERE n > 0 GROUP BY ALL),
{domains},{langs},{sources},
plan AS (SELECT domain, lang, source, (budget // tokens)::BIGINT AS epochs, budget % tokens AS rest FROM sources),
keyed AS (SELECT d.*, p.epochs, p.rest, md5(concat_ws(':', '{MIX['seed']}', p.epochs, d.doc_id)) AS key
          FROM docs d LEFT JOIN plan p USING (domain, lang, source)),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN n > 0 THEN n ELSE 0 END) OVER (
    PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS start FROM keyed)
SELECT doc_id, domain, raw_lang AS lang, raw_source AS source, n AS n_tokens,
       CASE WHEN n > 0 THEN coalesce(epochs + (start < rest)::BIGINT, 0) ELSE 0 END::BIGINT AS copies FROM placed
"""

# Scores are sums of products of whole numbers, exact in double precision.
OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT p.*, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 5
"""


SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op3_secret_scan": _op3(),
    "op4_substring_dedup": OP4,
    "op5_chat_format": OP5,
    "op6_jaccard_join": OP6,
    "op9_nearest": OP9,
    "op10_mix": _op10(),
    "op12_hard_negatives": OP12,
}
