"""SQL for DuckDB that gives the rows of the operators which SQL can express."""

from __future__ import annotations


def crc32(number: str) -> str:
    """Unsigned CRC-32 of a whole number in decimal: bytes folded one by one, eight shifts each."""
    steps = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {digits}), lambda c, b: {steps}), 4294967295)"


def _field(column: str) -> str:
    value = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: A tree per source, then one over the subroots (grp '!'), and a walk from each leaf to the root.
MANIFEST = f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT coalesce('=' || source, '-') AS grp, doc_id, {_leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id')} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END
           AS found
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS idx,
         count(*) OVER (PARTITION BY grp) AS n
  FROM hashed),
low AS (
  SELECT grp, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 15) // 16
  FROM low WHERE n > 1 GROUP BY grp, level, idx // 16),
subroots AS MATERIALIZED (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT '!' AS grp, 0 AS level, idx, digest, n FROM subroots
  UNION ALL
  SELECT grp, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 15) // 16
  FROM high WHERE n > 1 GROUP BY grp, level, idx // 16),
nodes AS MATERIALIZED (
  SELECT *, idx // 16 AS parent FROM low WHERE n > 1 UNION ALL
  SELECT *, idx // 16 AS parent FROM high WHERE n > 1),
sides AS MATERIALIZED (
  SELECT a.grp, a.level, a.idx, any_value(a.n) AS n,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM nodes a JOIN nodes b ON a.grp = b.grp AND a.level = b.level AND a.parent = b.parent
  GROUP BY a.grp, a.level, a.idx),
inside AS (
  SELECT grp AS source_key, idx AS leaf_idx, 0 AS level, idx, '' AS proof, found AS folded FROM leaves
  UNION ALL
  SELECT w.source_key, w.leaf_idx, w.level + 1, w.idx // 16, w.proof || s.before || s.after,
         sha256(s.before || w.folded || s.after)
  FROM inside w JOIN sides s ON s.grp = w.source_key AND s.level = w.level AND s.idx = w.idx),
within AS MATERIALIZED (
  SELECT source_key, leaf_idx, max_by(proof, level) AS proof, max_by(folded, level) AS folded
  FROM inside GROUP BY source_key, leaf_idx),
outside AS (
  SELECT grp AS source_key, 0 AS level, idx FROM subroots
  UNION ALL
  SELECT w.source_key, w.level + 1, w.idx // 16
  FROM outside w JOIN sides s ON s.grp = '!' AND s.level = w.level AND s.idx = w.idx),
steps AS MATERIALIZED (
  SELECT w.source_key, list({{'before': s.before, 'after': s.after}} ORDER BY w.level) AS path
  FROM outside w JOIN sides s ON s.grp = '!' AND s.level = w.level AND s.idx = w.idx GROUP BY w.source_key),
complete AS (
  SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM high WHERE n = 1) AS root,
         sha256(w.proof || coalesce(array_to_string(list_transform(p.path, lambda x: x.before || x.after), ''), ''))
           AS proof_sha256,
         list_reduce(list_concat([{{'before': w.folded, 'after': ''}}],
                                 coalesce(p.path, [])),
                     lambda x, y: {{'before': sha256(y.before || x.before || y.after), 'after': ''}}).before
           AS folded_root
  FROM leaves l JOIN within w ON w.source_key = l.grp AND w.leaf_idx = l.idx
  JOIN subroots r ON r.grp = l.grp LEFT JOIN steps p ON p.source_key = l.grp)
SELECT *, folded_root = root AS verified FROM complete
"""

TRIE = f"""
WITH ranked AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
         strlen(coalesce(text, '')) AS n_bytes,
         sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32('conv_id')} % 9 AS h, count(*) AS n
  FROM ranked GROUP BY conv_id),
built AS (
  SELECT c.conv_id, 0 AS part, r.place, r.turn, r.n_bytes
  FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, r.place, r.turn, r.n_bytes FROM convs c JOIN ranked r ON r.conv_id = c.conv_id AND r.place >= c.h),
paths AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, n_bytes, sha256(string_agg(turn, '') OVER w) AS node,
         row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, 0, 'root', NOT EXISTS (FROM built b WHERE b.conv_id = c.conv_id) FROM convs c),
nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY node, depth),
linked AS MATERIALIZED (
  SELECT n.*, u.conv_id AS parent_conv_id, u.node AS parent
  FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN nodes u ON u.node = p.node AND u.depth = p.depth),
children AS MATERIALIZED (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
totals AS (
  SELECT p.node, p.depth, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves,
         sum((n.n_convs - 1) * n.n_bytes) AS saved
  FROM nodes n LEFT JOIN children c ON c.node = n.node AND c.depth = n.depth
  JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth
  GROUP BY p.node, p.depth)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, coalesce(c.n, 0) AS n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l JOIN totals t ON t.node = l.node AND t.depth = l.depth
LEFT JOIN children c ON c.node = l.node AND c.depth = l.depth
"""

#: {rules}: the conditions of a policy, over the measurements.
RULES = r"""
WITH split AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT row_id, i, list_slice(words, i, i + 4) AS run FROM split, unnest(range(1, len(words) - 3)) AS t(i)),
again AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, run) AS c FROM windows) WHERE c > 1),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM again, unnest(range(5)) AS t(k) GROUP BY row_id),
measured AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (row_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {failed} AS failed FROM measured)
SELECT *, NOT base_failed AND NOT ({rejected}) AS kept, '{version}' AS policy FROM judged
"""


def quality(rules, policy) -> str:
    """The ledger, judged by a policy; rules and thresholds come from the same tables as the operator's."""
    places = {rule.name: place for place, rule in enumerate(rules)}
    failed = " | ".join(f"CASE WHEN {rule.fails} THEN {1 << place} ELSE 0 END" for place, rule in enumerate(rules))
    bits = [sum(1 << places[name] for name in names) for names in (policy.strict, policy.weak)]
    rejected = f"(failed & {bits[0]}) <> 0 OR bit_count(failed & {bits[1]}) >= {policy.most}"
    return (RULES.replace("{failed}", f"CAST({failed} AS BIGINT)").replace("{rejected}", rejected)
            .replace("{version}", policy.version))
