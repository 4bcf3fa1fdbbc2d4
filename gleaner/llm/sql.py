"""SQL that DuckDB runs, for the queries that it can express."""

from __future__ import annotations

from gleaner.llm import licenses, secrets

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

LEVELS = 4
_LEVELS = "\n".join(
    f"""level{k + 1} AS (SELECT place, q, 2 * node + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws('|', 'mix', {k}, place, q)), place, q) <= (count(*) OVER (PARTITION BY node) + 1) // 2 THEN 0 ELSE 1 END AS node FROM level{k}),"""
    for k in range(LEVELS)
)
MIXING = f"""
WITH sized AS (SELECT doc_id, source, {WORDS} AS size, md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM documents),
placed AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM placed),
rated AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, place) - cap))
  / (sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, place) + weight) AS rate FROM weighed),
planned AS (SELECT source, source_size, place, least(CAST(cap AS DOUBLE), max(rate) OVER () * weight) AS target,
  CAST(greatest(1, ceil(greatest(2048, ceil(sum(n) OVER () / 50000)) * source_size / greatest(sum(source_size) OVER (), 1)), ceil(n / 50000)) AS BIGINT) AS blocks FROM rated),
dealt AS (SELECT s.doc_id, s.size, s.key, p.*, CAST(('0x' || substr(key, 1, 8)) AS BIGINT) % blocks AS block FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source),
sums AS (SELECT place, block, sum(size) AS words, first(source_size) AS ss, first(target) AS t FROM dealt GROUP BY place, block),
permuted AS (SELECT place, block, words, CASE WHEN ss > 0 THEN floor(t / ss) ELSE 0 END AS whole, count(*) OVER (PARTITION BY place) AS n, row_number() OVER o AS k,
  CAST(floor(t) AS BIGINT) - CASE WHEN ss > 0 THEN floor(t / ss) ELSE 0 END * ss - (sum(words) OVER o - words) AS rest FROM sums WINDOW o AS (PARTITION BY place ORDER BY md5(concat_ws('|', 'mix', place, block)), block)),
uses AS (SELECT *, CASE WHEN pass < whole THEN words WHEN pass = whole THEN least(rest, words) ELSE 0 END AS room FROM permuted, (VALUES (0), (1), (2)) v(pass)),
quota AS (SELECT place, block, words, pass, room, row_number() OVER (PARTITION BY place ORDER BY pass * n + k) AS q FROM uses WHERE room > 0),
level0 AS (SELECT place, q, 0 AS node FROM quota),
{_LEVELS}
runs AS (SELECT place, node AS shard, row_number() OVER (PARTITION BY place ORDER BY node, q) AS q FROM level{LEVELS}),
drawn AS (SELECT place, block, list({{'pass': pass, 'shard': shard, 'room': room, 'words': words}} ORDER BY pass, shard) AS draws FROM quota JOIN runs USING (place, q) GROUP BY place, block),
ahead AS (SELECT *, sum(size) OVER (PARTITION BY place, block ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead FROM dealt),
taking AS (SELECT doc_id, size, source_size, target, list_filter(list_transform(coalesce(draws, []), lambda d: {{'pass': d.pass, 'shard': d.shard, 'taken': CASE WHEN d.room = d.words THEN size ELSE greatest(0, least(size, d.room - ahead)) END}}), lambda d: d.taken > 0) AS takes
  FROM ahead LEFT JOIN drawn USING (place, block))
SELECT doc_id, size, source_size, target, CAST(coalesce(list_sum(list_transform(takes, lambda d: d.taken)), 0) AS BIGINT) AS taken, array_to_string(list_transform(takes, lambda d: CAST(d.shard AS VARCHAR)), ',') AS shards,
  CASE WHEN len(takes) > 0 THEN md5(concat_ws('|', 'mix', doc_id, takes[1].pass, takes[1].shard)) END AS shuffle_key FROM taking
"""

LINES = r"""
WITH RECURSIVE every AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT * FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
classes AS (SELECT line, length(line) AS n, min({'d': doc_id, 'n': line_no}) AS pos FROM worded GROUP BY line),
keyed AS (SELECT line, n, pos, unnest(['<' || m || '|' || left(line, m // 2), '>' || m || '|' || right(line, m - m // 2)]) AS key FROM (SELECT *, unnest([n, n - 1]) AS m FROM classes) WHERE m >= 20),
pairs AS (SELECT DISTINCT a.line AS x, b.line AS y, a.pos AS later, b.pos AS earlier FROM keyed a JOIN keyed b ON a.key = b.key AND a.line <> b.line AND b.pos < a.pos),
near AS (SELECT later, earlier FROM (SELECT *, CASE WHEN length(x) >= length(y) THEN x ELSE y END AS p, CASE WHEN length(x) >= length(y) THEN y ELSE x END AS q FROM pairs)
  WHERE length(p) - length(q) <= 1 AND len(list_filter(range(length(p)), lambda i: left(p, i) = left(q, i) AND substr(p, i + 2) = substr(q, i + 2 - (length(p) - length(q))))) > 0),
numbered AS (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM (SELECT later AS pos FROM near UNION SELECT earlier FROM near)),
before AS (SELECT a.k, list(b.k) AS ks FROM near JOIN numbered a ON a.pos = later JOIN numbered b ON b.pos = earlier GROUP BY a.k),
walk(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT w.k + 1, CASE WHEN coalesce(list_has_any(b.ks, w.kept), false) THEN w.kept ELSE list_append(w.kept, w.k + 1) END FROM walk w LEFT JOIN before b ON b.k = w.k + 1 WHERE w.k < (SELECT max(k) FROM numbered)),
kept AS (SELECT unnest(arg_max(kept, k)) AS k FROM walk),
gone AS (SELECT later, min(earlier) AS earlier FROM near WHERE earlier IN (SELECT pos FROM numbered SEMI JOIN kept USING (k)) AND later NOT IN (SELECT pos FROM numbered SEMI JOIN kept USING (k)) GROUP BY later)
SELECT doc_id, CAST(line_no AS INT) AS line_no, k.d AS kept_doc_id, CAST(k.n AS INT) AS kept_line_no, edits FROM (
  SELECT doc_id, line_no, coalesce(earlier, pos) AS k, CASE WHEN earlier IS NULL THEN 0 ELSE 1 END AS edits FROM worded JOIN classes USING (line) LEFT JOIN gone ON later = pos)
WHERE NOT (doc_id IS NOT DISTINCT FROM k.d AND line_no = k.n)
"""


def _stands(words: list[str], at: str) -> str:
    return " AND ".join(f"w[{at} + {k}] = '{x}'" for k, x in enumerate(words))


def licences(most: int = 64, agree: int = 2) -> str:
    """A template's label holds where its key phrase stands and `agree` of its `most` rarest words stand at their places; the score is the largest share of its words that do."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = [(f"list_filter(range(1, len(w) + 1), lambda i: {_stands(phrase.split(), 'i')})", label) for phrase, label, _ in licenses.BASE]
    known = [(t, k, w, t_.key_at <= k < t_.key_at + len(t_.key.split())) for t, t_ in enumerate(licenses.TEMPLATES) for k, w in enumerate(t_.words) if w not in licenses.COMMON]
    found = []
    for t, t_ in enumerate(licenses.TEMPLATES):
        at = lambda k, t_=t_: f"i - {t_.key_at} + {k}"
        share = " + ".join(f"CASE WHEN {at(k)} > 0 AND w[{at(k)}] = '{x}' THEN 1 ELSE 0 END" for k, x in enumerate(t_.words))
        agreed = f"len(list_filter(ps, lambda p: i - {t_.key_at} + p.k > 0 AND w[CAST(i - {t_.key_at} + p.k AS BIGINT)] = p.w)) >= least(len(ps), {agree})"
        found.append(f"SELECT r, '{t_.label}' AS label, max(({share}) / {len(t_.words)}.0) AS share FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts WHERE list_contains(w, '{t_.key.split()[0]}')), (SELECT ps FROM postings WHERE t = {t}) WHERE {_stands(t_.key.split(), 'i')} AND {agreed} GROUP BY r")
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
held AS (SELECT x, count(DISTINCT r) AS n FROM (SELECT r, unnest(w) AS x FROM texts) GROUP BY x),
known AS (SELECT t, k, v.w, keyed, coalesce(n, 0) AS n FROM (VALUES {', '.join(f"({t}, {k}, '{w}', {keyed})" for t, k, w, keyed in known)}) v(t, k, w, keyed) LEFT JOIN held ON x = v.w),
firsts AS (SELECT *, keyed AND row_number() OVER (PARTITION BY t, keyed ORDER BY n, k, w) = 1 AS first FROM known),
postings AS (SELECT t, list({{'k': k, 'w': w}}) AS ps FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY first DESC, n, k, w) AS place FROM firsts) WHERE place <= {most} GROUP BY t),
based AS (SELECT r, {', '.join(f'{p} AS s{k}' for k, (p, _) in enumerate(base))} FROM texts),
more AS ({' UNION ALL '.join(found)}),
labelled AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM more GROUP BY r),
joined AS (SELECT doc_id, len(w) AS n_words, list_concat({', '.join(f's{k}' for k in range(len(base)))}) AS s, list_filter([{', '.join(f"CASE WHEN len(s{k}) > 0 THEN '{x}' END" for k, (_, x) in enumerate(base))}], lambda x: x IS NOT NULL) AS b, more, share
  FROM texts JOIN based USING (r) LEFT JOIN labelled USING (r))
SELECT doc_id, n_words, len(s) AS n_base, list_min(s) - 1 AS first_word, list_max(s) - 1 AS last_word, array_to_string(list_sort(b), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b, coalesce(more, [])))), ',') AS labels, CASE WHEN len(s) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score FROM joined
"""


MIDDLES = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS d FROM texts),
formed AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM pieces
"""

CONVERSATIONS = r"""
WITH RECURSIVE crcs AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM keyed, crcs),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
inserts(state, q, audit, said) AS (VALUES (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
walk(conv_id, k, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])} FROM conversations
  UNION ALL
  SELECT conv_id, k, e.to, min({'cost': cost + e.cost, 'audit': audit || e.edit, 'said': list_concat(said, e.said)}) FROM (
    SELECT f.conv_id, f.k, w.best.cost + 2 * length(i.audit) AS cost, w.best.audit || i.audit AS audit, list_concat(w.best.said, i.said) AS said, unnest([
      {'edit': 'D', 'cost': 3, 'to': i.q, 'said': CAST([] AS VARCHAR[]), 'may': true},
      {'edit': 'R', 'cost': 2 + CAST(fault = 'truncated' AS INT), 'to': CASE i.q WHEN 2 THEN 3 ELSE 2 END, 'said': [CASE i.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text], 'may': fault NOT IN ('blank', 'duplicate')},
      {'edit': 'K', 'cost': CAST(fault = 'truncated' AS INT), 'to': CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'said': [role || ':' || text], 'may': fault NOT IN ('blank', 'duplicate') AND (i.q || left(role, 1)) IN ('0s', '0u', '1u', '2a', '3u')}]) AS e
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1 JOIN inserts i ON i.state = w.state)
  WHERE e.may GROUP BY conv_id, k, e.to),
ended AS (SELECT w.conv_id, min({'cost': best.cost + 2 * length(i.audit), 'audit': best.audit || i.audit, 'said': list_concat(best.said, i.said)}) AS best FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts i ON i.state = w.state WHERE w.k = coalesce(n, 0) AND i.q IN (0, 3) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def secret_spans(wide: int = 3) -> str:
    """A pattern's matches are set apart by a character that no text has; what stands before each gives its place."""
    bar = "chr(57344)"

    def found(kind: int, pattern: str, test: str, value: str = "m") -> str:
        quoted = pattern.replace("'", "''")
        pieces = f"SELECT r, string_split(regexp_replace(t, '{quoted}', {bar} || '\\0' || {bar}, 'g'), {bar}) AS p FROM texts"
        return f"""SELECT r, {kind} AS kind, a, a + length(m) AS b, {value.replace("PATTERN", f"'{quoted}'")} AS v FROM (SELECT r, p[k] AS m, list_sum(list_transform(p[1:k - 1], lambda x: length(x))) AS a FROM (SELECT r, p, unnest(range(2, len(p) + 1, 2)) AS k FROM ({pieces}))) WHERE {test}"""

    value = "regexp_extract(m, PATTERN, 2)"
    assign = secrets.ASSIGN
    tests = " AND ".join(f"regexp_matches(m, '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]"))
    live = f"len(list_distinct(string_split(v, ''))) >= {secrets.LEAST_DIFFERENT} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(lower(v), '{'|'.join(secrets.PLACEHOLDERS)}')"
    written = "coalesce(string_agg(kind_name || ':' || a || ':' || b, ',' ORDER BY a, kind){}, '')"
    kinds = f"[{', '.join(repr(k) for k in secrets.KINDS)}]"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS ({found(0, assign, f"length(v) >= {secrets.LEAST_VALUE}", value)} UNION ALL {found(1, secrets.ACCESS, "true")} UNION ALL {found(2, secrets.HEX, "true")}),
tokens AS ({found(3, secrets.TOKEN, tests)}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.a < t.b AND t.a < b.b)),
owned AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners FROM every JOIN texts USING (r) GROUP BY v),
spans AS (SELECT r, kind, a, b, owners FROM every JOIN owned USING (v) WHERE kind <> 3
  UNION ALL SELECT r, 4, CASE kind WHEN 0 THEN b - length(v) ELSE a END, b, owners FROM every JOIN owned USING (v) WHERE owners = 1 AND {live})
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 4) AS n_live, count(*) FILTER (kind < 3 AND owners >= {wide}) AS n_example,
  sha256({written.format(" FILTER (kind < 3)")}) AS base_sha256, {written.format("")} AS spans
FROM texts LEFT JOIN (SELECT *, {kinds}[kind + 1] AS kind_name FROM spans) USING (r) GROUP BY r, doc_id
"""
