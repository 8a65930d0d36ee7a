"""DuckDB SQL of the queries that SQL can express whole: mixing, url templates, prefix trie, divergence."""

from __future__ import annotations

from scanloom.llm import divergence, mixing, url_templates
from scanloom.llm.common import WORD


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mixing_sql() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    cap, n = mixing.CEILING, len(mixing.WEIGHTS)
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {q(WORD)})), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
weighed AS (
  SELECT *, [{weights}][(rank - 1) % {n} + 1] AS weight, source_size::DOUBLE * {float(cap)}::DOUBLE AS filled FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(filled) OVER below, 0)) / (all_weight - coalesce(sum(weight) OVER below, 0)) AS level
  FROM (SELECT *, filled / weight AS full_at, sum(source_size) OVER ()::BIGINT AS total,
          sum(weight) OVER () AS all_weight FROM weighed)
  WINDOW below AS (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, rank, source_size, total, greatest(ceil(total / {mixing.BLOCKS}.0)::BIGINT, 1) AS block,
    least(filled, (SELECT max(level) FROM levels WHERE level <= full_at) * weight) AS target FROM levels),
each AS (
  SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN want % source_size ELSE want END AS rest
  FROM (SELECT g.*, round(target)::BIGINT AS want, greatest(ceil(source_size::DOUBLE / block)::BIGINT, 1) AS on_line FROM goals g)),
chosen AS (
  SELECT rank, idx, cut, coalesce(sum(cut) OVER (
    PARTITION BY rank ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before
  FROM (SELECT *, greatest(least(words, rest - coalesce(sum(words) OVER (
          PARTITION BY rank ORDER BY md5(concat_ws(':', '{mixing.SEED + 1}', rank::VARCHAR, idx::VARCHAR)), idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS cut
        FROM (SELECT *, greatest(least(block, source_size - idx * block), 0) AS words
              FROM (SELECT rank, block, rest, source_size, unnest(range(0, on_line + 1)) AS idx FROM each)))),
lined AS (
  SELECT s.doc_id, s.size, e.*, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY md5(concat_ws(
      ':', '{mixing.SEED}', doc_id::VARCHAR, size::VARCHAR)), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN each e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (passes * size
  + b.words_before + least(b.cut, (start + size) % block)
  - a.words_before - least(a.cut, start % block))::BIGINT AS taken
FROM lined l JOIN chosen a ON a.rank = l.rank AND a.idx = start // block
JOIN chosen b ON b.rank = l.rank AND b.idx = (start + size) // block"""


def url_templates_sql() -> str:
    U = url_templates
    order = sorted(U.RULES, key=lambda r: (-len(r.name), r.host, r.path))

    def by_rule(value) -> str:
        cases = " ".join(
            f"WHEN (host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}) "
            f"THEN {q(value(r))}" for r in order)
        return f"CASE {cases} END"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    variable = " OR ".join(f"regexp_matches(s, {q(p)})" for p in (
        r"^[0-9]+(\.[A-Za-z0-9]+)?$", "^[0-9a-fA-F-]{16,}$", "[0-9]{4}"))
    return f"""
WITH RECURSIVE located AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
shaped AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
    lambda s: CASE WHEN {variable} THEN '*' ELSE s END) AS shape FROM located),
marked AS (
  SELECT page_id, max(1 - quality)::DOUBLE AS bad
  FROM (SELECT page_id, try_cast(regexp_extract(path, {q(r'/([0-9]+)(?:[.][A-Za-z]+)?/?$')}, 1) AS BIGINT) AS doc_id FROM located)
  JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY page_id),
counted AS (
  SELECT host, shape, count(*)::BIGINT AS n, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM shaped LEFT JOIN marked USING (page_id) GROUP BY host, shape),
tree AS (
  SELECT host, shape, n, labelled, bad, '' AS template, 0 AS level, false AS done FROM counted
  UNION ALL
  SELECT host, shape, n, labelled, bad, CASE WHEN seg IS NULL THEN template WHEN pn < {U.LEAST_PAGES} THEN template || '**/'
      WHEN seg <> '*' AND bn >= {U.LEAST_PAGES}
        AND abs((b + 0.5::DOUBLE) / (l + 1.0::DOUBLE) - ((pb - b) + 0.5::DOUBLE) / ((pl - l) + 1.0::DOUBLE))
          > {U.SIGNIFICANT}::DOUBLE * sqrt((pb + 0.5::DOUBLE) / (pl + 1.0::DOUBLE) * (1.0::DOUBLE - (pb + 0.5::DOUBLE) / (pl + 1.0::DOUBLE))
            * (1.0::DOUBLE / (l + 1.0::DOUBLE) + 1.0::DOUBLE / ((pl - l) + 1.0::DOUBLE)))
      THEN template || seg || '/' ELSE template || '*/' END, level, seg IS NULL OR pn < {U.LEAST_PAGES}
  FROM (
    SELECT *, sum(n) OVER branch AS bn, sum(labelled) OVER branch AS l, sum(bad) OVER branch AS b,
      sum(n) OVER parent AS pn, sum(labelled) OVER parent AS pl, sum(bad) OVER parent AS pb
    FROM (SELECT host, shape, n, labelled, bad, template, level + 1 AS level, shape[level + 1] AS seg FROM tree WHERE NOT done)
    WINDOW branch AS (PARTITION BY host, template, seg), parent AS (PARTITION BY host, template, seg IS NULL))),
final AS (SELECT * FROM tree WHERE done),
shares AS (
  SELECT host, template, (sum(bad) + {U.PRIOR_PAGES}::DOUBLE * coalesce((SELECT sum(bad) / nullif(sum(labelled), 0) FROM counted), 0))
    / (sum(labelled)::DOUBLE + {U.PRIOR_PAGES}::DOUBLE) AS bad_share FROM final GROUP BY host, template)
SELECT page_id, s.host, path, {by_rule(lambda r: r.name).replace('host', 's.host').replace("'s.host", "'host")} AS rule,
  coalesce({by_rule(lambda r: r.verdict).replace('host', 's.host').replace("'s.host", "'host")},
    CASE WHEN bad_share >= {U.REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict,
  s.host || '/' || t.template AS template, bad_share
FROM shaped s JOIN final t ON s.host = t.host AND s.shape = t.shape
JOIN shares x ON x.host = t.host AND x.template = t.template"""


def prefix_trie_sql() -> str:
    """A prefix's key is the SHA-256 of its turns, end to end, 64 characters a turn; crc32 goes bit by bit."""
    turn = "sha256(length(role)::VARCHAR || ':' || role || text)"
    steps = ", ".join(["256"] * 8)
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda x: [ascii(x)::BIGINT, {steps}]))), lambda a, x: CASE WHEN x < 256 THEN xor(a, x)
      WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, {turn} AS digest, coalesce(len(regexp_extract_all(text, {q(WORD)})), 0) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {turn}) AS pos FROM given),
ids AS (SELECT conv_id, {crc} % 4 AS h FROM turns GROUP BY conv_id),
built AS (
  SELECT i.conv_id, false AS own, pos, digest, words
  FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 20 AND pos <= h
  UNION ALL SELECT i.conv_id, true, pos, digest, words FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND pos > h),
members AS (
  SELECT conv_id, row_number() OVER line AS depth, string_agg(digest, '') OVER line AS key, words FROM built
  WINDOW line AS (PARTITION BY conv_id ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
marked AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS last FROM members),
nodes AS (
  SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM marked GROUP BY key),
children AS (
  SELECT key[1:64 * (depth - 1)] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)),
below AS (
  SELECT key[1:64 * up] AS key, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
    sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM whole) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
  sha256(w.ends) AS ends_sha256
FROM whole w JOIN below b USING (key) LEFT JOIN nodes p ON w.depth > 0 AND p.key = w.key[1:64 * (w.depth - 1)]"""


def divergence_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

    def share(count: str, total: str) -> str:
        return f"(1 + {divergence.SCALE}::HUGEINT * ({count} + 2) // ({total} + 2 * v))"

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), {q(term)}) AS terms FROM documents),
found AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
all_groups AS (
  SELECT g.lang, g.source, coalesce(total, 0)::HUGEINT AS total, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN sizes s ON s.lang = g.lang),
shares AS (
  SELECT g.lang, g.source, k.term, n, {share('coalesce(n, 0)', 'total')} AS p
  FROM all_groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
wholes AS (
  SELECT lang, term, {share('n', 'total')} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL)
  JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM all_groups GROUP BY lang) USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM all_groups a JOIN all_groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM shares JOIN wholes USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


SQL = {"op7_mixing": mixing_sql(), "op8_url_templates": url_templates_sql(), "op11_prefix_trie": prefix_trie_sql(),
       "op13_divergence": divergence_sql()}
