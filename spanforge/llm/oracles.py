"""DuckDB SQL with the rows of the queries over conversations, embeddings and addresses."""

#: A layer of the Viterbi pass is four strings, each a cost of nine digits before its audit: the least string is the best.
_ADD = "printf('%09d', substr({s}, 1, 9)::INT + {cost}) || substr({s}, 10) || '{edit}'"


def _closed(step: int) -> str:
    """One round of insertions over the states st, sy, us, asst of the layer ``l{step}``."""
    add = lambda s: _ADD.format(s=s, cost=5, edit="I")
    return f"l{step + 1} AS (SELECT * REPLACE (least(us, {add('st')}, {add('sy')}, {add('asst')}) AS us, least(asst, {add('us')}) AS asst) FROM l{step})"


def _walk() -> str:
    gone = lambda s: _ADD.format(s=s, cost=2, edit="D")
    stays = lambda s, cost, edit, when: f"CASE WHEN NOT go AND {when} THEN {_ADD.format(s=s, cost=f'{cost} + 5 * cut', edit=edit)} END"
    kept_u = ", ".join(stays(s, 0, "K", "initial = 'u'") for s in ("st", "sy", "asst"))
    made_u = ", ".join(stays(s, 1, "R", "true") for s in ("st", "sy", "asst"))
    return f"""SELECT conv, n, {gone('st')} AS st,
      least({gone('sy')}, {stays('st', 0, 'K', "initial = 's'")}) AS sy,
      least({gone('us')}, {kept_u}, {made_u}) AS us,
      least({gone('asst')}, {stays('us', 0, 'K', "initial = 'a'")}, {stays('us', 1, 'R', 'true')}) AS asst"""


OP11 = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations),
fated AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM keyed, crc),
damaged AS (
  SELECT coalesce(conv_id::VARCHAR, 'none') AS conv, conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM fated, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) copies(i)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(md5(role) || text)) AS n,
    rtrim(text, E' \t\n\x0b\x0c\r') AS rest
  FROM damaged),
placed AS (SELECT *, n > min(n) OVER (PARTITION BY conv, role, text) AS seen FROM numbered),
rows AS (
  SELECT conv, n, turn, role, text, substr(role, 1, 1) AS initial, rest = '' AS blank, seen AND rest <> '' AS duplicate, rest = '' OR seen AS go,
    (NOT (rest = '' OR seen) AND right(rest, 1) NOT IN ('.', '!', '?'))::INT AS cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY n) AS before
  FROM placed),
counts AS (
  SELECT conv, count_if(blank) AS blank, count_if(duplicate) AS duplicate, sum(cut) AS truncated, max(n) AS last,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM rows GROUP BY conv),
layer(conv, n, st, sy, us, asst) AS (
  SELECT conv, 0::BIGINT, '000000000', NULL::VARCHAR, '000000005I', '000000010II' FROM counts
  UNION ALL
  SELECT conv, n, st, sy, us, asst FROM (
    WITH l0 AS ({_walk()} FROM (SELECT layer.conv, rows.n, st, sy, us, asst, initial, go, cut FROM layer JOIN rows ON rows.conv = layer.conv AND rows.n = layer.n + 1)),
    {_closed(0)}, {_closed(1)}
    SELECT conv, n, st, sy, us, asst FROM l2)),
best AS (
  SELECT conv, substr(least(st, asst), 1, 9)::BIGINT AS cost, substr(least(st, asst), 10) AS audit
  FROM layer JOIN counts USING (conv) WHERE n = last),
edits AS (
  SELECT conv, i, audit[i] AS edit, len(replace(audit, 'D', '')) % 2 AS odd,
    len(replace(substr(audit, 1, i), 'I', '')) AS n, len(replace(substr(audit, 1, i), 'D', '')) - 1 AS place
  FROM best, unnest(range(1, len(audit) + 1)) t(i)),
told AS (
  SELECT edits.conv, i, CASE WHEN edit = 'K' THEN role WHEN (place + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END AS row
  FROM edits LEFT JOIN rows USING (conv, n) WHERE edit <> 'D'),
hashed AS (SELECT conv, sha256(string_agg(row, E'\n' ORDER BY i)) AS repaired_sha256 FROM told GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS conv FROM conversations) c
LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN hashed USING (conv)
"""


def _round(r: int) -> str:
    """Assignment ``a{r}`` to the centroids ``c{r}`` and, but for the last, the centroids after it."""
    assigned = f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT place, vec_id, v, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM ints, c{r})
  GROUP BY place, vec_id, v)"""
    # integer division rounds to zero: one less where a negative sum leaves a rest
    moved = f"""m{r} AS MATERIALIZED (
  SELECT k, list(q ORDER BY i) AS c
  FROM (SELECT k, i, (s // n - (s % n < 0)::INT)::BIGINT AS q FROM (SELECT k, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY k, i)) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))"""
    return assigned if r == 5 else f"{assigned},\n{moved}"


OP12 = f"""
WITH kept AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
ints AS MATERIALIZED (SELECT * FROM kept),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM ints ORDER BY h, v LIMIT 40)),
{", ".join(_round(r) for r in range(6))}
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.c, ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (k)
"""

OP13 = r"""
WITH rules(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
rest AS (SELECT row_number() OVER () AS place, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT place, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT place, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY place),
judged AS (SELECT * FROM parts LEFT JOIN fits USING (place)),
votes AS (SELECT host, count_if(verdict = 'block') > count_if(verdict = 'allow') AS listed FROM judged GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(listed, false) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(listed, false) AS listed
FROM judged JOIN votes USING (host)
"""

ORACLES: dict[str, str] = {"op11_conversation_repair": OP11, "op12_clusters": OP12, "op13_url_filter": OP13}
