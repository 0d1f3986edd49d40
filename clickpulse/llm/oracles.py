"""DuckDB SQL for the queries of this subpackage that SQL can express, over the same tables."""

from __future__ import annotations

from .queries import CONTROL_TURNS, URL_RULES

_ESCAPED = "replace({x}, '\\', '\\\\')"
for _control in ("<|turn|>", "<|says|>", "</s>", "<s>", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}\\{_control[1:]}')"


def _escaped(column: str) -> str:
    return _ESCAPED.format(x=column)


#: A turn is <|turn|> role <|says|> text </s> and a line feed: 21 characters around role and text.
OP2 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TURNS}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TURNS}'
), ordered AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(21 + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars,
  bool_and((before, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'),
    ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant'))) AND bool_or(is_last AND role = 'assistant') AS valid
FROM ordered GROUP BY conv_id
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP3 = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)
SELECT page_id, host, path,
  (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule_host || rule_path)) FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM parts
"""


def _spans(kind: str, rank: int, pattern: str, where: str, flags: str = "") -> str:
    """Rows ``n, kind, rank, start, end`` of the matches of ``pattern`` in ``d.text`` that pass ``where`` on ``found``."""
    return f"""
  SELECT n, '{kind}' AS kind, {rank} AS rank, start, start + length(found) AS stop FROM (
    SELECT n, found, pieces[i] AS before, pieces[i + 1] AS after, list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda m: length(m))), 0) AS start
    FROM (
      SELECT n, unnest(matches) AS found, unnest(range(1, len(matches) + 1)) AS i, pieces, matches FROM (
        SELECT n, regexp_extract_all(text, '{flags}{pattern}') AS matches, string_split_regex(text, '{flags}{pattern}') AS pieces FROM d
      )
    )
  ) WHERE {where}"""


_ASSIGN = """(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT)
       WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 2 * CAST({_DIGITS}[i] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[i] AS INT) END)) % 10 = 0"""
_MOVED = "(substr(replace(found, ' ', ''), 5) || substr(replace(found, ' ', ''), 1, 4))"
_MOD97 = f"""list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length({_MOVED}) + 1), lambda i:
  CASE WHEN {_MOVED}[i] BETWEEN '0' AND '9' THEN CAST({_MOVED}[i] AS BIGINT) ELSE CAST(ascii({_MOVED}[i]) - 55 AS BIGINT) END)),
  lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans('assign', 0, _ASSIGN, f"length(regexp_extract(found, '(?i){_ASSIGN}', 2)) >= 6", '(?i)')}
  UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 'length(found) >= 20')}
  UNION ALL {_spans('hex', 2, '[0-9a-f]{24,}', 'true')}
  UNION ALL {_spans('private_key', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 'true')}
  UNION ALL {_spans('host_token', 4, '(?:gh[pousr]_|glpat-|xox[abp]-)[A-Za-z0-9_-]{20,}', 'true')}
)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s USING (n) GROUP BY n, doc_id
"""

_WORDS = "(?i)(^|[^a-z])(ssn|social security|national id|identity)($|[^a-z])"
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_spans('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_spans('ip', 1, '[0-9]+([.][0-9]+){3}', "list_max(list_transform(string_split(found, '.'), lambda x: TRY_CAST(x AS HUGEINT))) <= 255 AND NOT list_contains(list_transform(string_split(found, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL), true)")}
  UNION ALL {_spans('card', 2, '[0-9]([ -]?[0-9])+', f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
  UNION ALL {_spans('phone', 3, '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 8 AND 15")}
  UNION ALL {_spans('iban', 4, chr(92) + 'b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?' + chr(92) + 'b', _MOD97)}
  UNION ALL {_spans('national_id', 5, chr(92) + 'b[0-9]{3}-[0-9]{2}-[0-9]{4}' + chr(92) + 'b', f"right(before, 1) <> '-' AND left(after, 1) <> '-' AND regexp_matches(right(before, 40) || ' ' || left(after, 40), '{_WORDS}')")}
)
SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
  count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (WHERE rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY rank, start), '') AS spans
FROM d LEFT JOIN s USING (n) GROUP BY n, doc_id
"""

#: Exact links by brute force: the index is built to find all of them at these sizes.
OP10 = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), usable AS (
  SELECT * FROM good WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.n <> b.n AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT g.n, least(g.vec_id, min(o.vec_id)) AS component_id FROM good g LEFT JOIN reach r ON r.a = g.n LEFT JOIN good o ON o.n = r.b GROUP BY g.n, g.vec_id
)
SELECT g.vec_id, (SELECT count(*) FROM links WHERE links.a = g.n) AS n_links, component_id, g.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM good g JOIN least USING (n)
"""

#: All five-word shingles with their number in the text, and all pairs that share one.
OP4 = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t-\r]+') AS w FROM documents),
shingles AS (
  SELECT n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d
), bags AS (SELECT n, s, count(*) AS c FROM shingles GROUP BY n, s),
sizes AS (SELECT n, sum(c) AS size FROM bags GROUP BY n),
shared AS (SELECT a.n AS a, b.n AS b, sum(least(a.c, b.c)) AS common FROM bags a JOIN bags b ON a.s = b.s AND a.n <> b.n GROUP BY a.n, b.n),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE common >= 0.8 * (x.size + y.size - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (
  SELECT d.n, d.doc_id, least(d.doc_id, min(o.doc_id)) AS class_id FROM d LEFT JOIN reach r ON r.a = d.n LEFT JOIN d o ON o.n = r.b GROUP BY d.n, d.doc_id
)
SELECT doc_id, class_id, doc_id IS NOT DISTINCT FROM class_id AS kept FROM classes
"""

ORACLES: dict[str, str] = {"op2_chat": OP2, "op3_urls": OP3, "op4_minhash": OP4, "op5_secrets": OP5, "op6_pii": OP6, "op10_embeddings": OP10}
