"""Check SQL of the collocations, chat format and manifest queries."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COLLOCATIONS = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 6)) AS u(k), unnest(range(1, len(ws) - k + 2)) AS v(i)),
f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT * FROM f WHERE k > 1),
s AS (
  SELECT c.lang, array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' ') AS phrase, max(a) AS a
  FROM c, unnest(range(2, c.k)) AS u(j), unnest(range(1, c.k - j + 2)) AS v(i) GROUP BY ALL),
d AS (
  SELECT c.* FROM c LEFT JOIN s ON c.lang = s.lang AND c.phrase = s.phrase WHERE s.a IS NULL OR 100 * s.a < 100 * c.a),
x AS (
  SELECT d.lang, d.phrase, d.a, cut, array_to_string(string_split(d.phrase, ' ')[1:cut], ' ') AS lp, array_to_string(string_split(d.phrase, ' ')[cut + 1:], ' ') AS rp
  FROM d, unnest(range(1, d.k)) AS u(cut)),
y AS (
  SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, n.n, CAST(1000 * CAST(x.a AS HUGEINT) * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score, cut
  FROM x JOIN f l ON x.lang = l.lang AND x.lp = l.phrase JOIN f r ON x.lang = r.lang AND x.rp = r.phrase JOIN n ON x.lang = n.lang),
z AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM y)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM z WHERE best = 1 QUALIFY rank <= 2000"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars,
  count(*) FILTER (NOT ((role = 'system' AND last IS NULL) OR (role = 'user' AND (last IS NULL OR last IN ('system', 'assistant'))) OR (role = 'assistant' AND coalesce(last = 'user', FALSE)))) AS n_broken,
  arg_max(role, turn) IN ('user', 'assistant') AS complete
FROM s GROUP BY conv_id"""


def _levels(name: str, part: str, depth: int) -> str:
    """Nodes ``<name>0`` to ``<name><depth>`` of every tree and, beside each node of a level
    below the last, what stands left and right of it in its run."""
    out = []
    for j in range(depth):
        run = f"OVER (PARTITION BY {part}pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}s{j} AS (
  SELECT {part}pos, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lt,
    coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM {name}{j} WHERE n > 1),
{name}{j + 1} AS (
  SELECT {part}pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {name}{j} WHERE n > 1 GROUP BY {part}pos // 16, n)""")
    return ",\n".join(out)


def _folds(name: str, start: str, on: str, pos: str, depth: int) -> str:
    out = []
    for j in range(depth):
        before = start if j == 0 else f"{name}f{j - 1}"
        out.append(f"""{name}f{j} AS (
  SELECT b.* EXCLUDE (acc, proof), CASE WHEN s.pos IS NULL THEN acc ELSE sha256(lt || acc || rt) END AS acc, proof || coalesce(lt || rt, '') AS proof
  FROM {before} b LEFT JOIN {name}s{j} s ON {on}s.pos = b.{pos} // {16**j})""")
    return ",\n".join(out)


def manifest(depth: int = 6, top: int = 4) -> str:
    """For sources of up to 16^depth rows and up to 16^top sources."""
    part = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)")
    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    ends = lambda name, cols, depth: " UNION ALL ".join(f"SELECT {cols} FROM {name}{j} WHERE n = 1" for j in range(depth + 1))
    return f"""
WITH d AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN coalesce({crc} % 5 = 0, FALSE) THEN {leaf(lowered)} ELSE {leaf('text')} END AS now FROM documents),
e AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
m0 AS (
  SELECT source, pos, n, leaf AS digest FROM e),
{_levels('m', 'source, ', depth)},
r AS ({ends('m', 'source, digest', depth)}),
t0 AS (
  SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM r),
{_levels('t', '', top)},
q AS ({ends('t', 'digest', top)}),
b AS (
  SELECT e.*, t0.pos AS tpos, t0.digest AS subroot, now AS acc, '' AS proof FROM e JOIN t0 ON e.source IS NOT DISTINCT FROM t0.source),
{_folds('m', 'b', 's.source IS NOT DISTINCT FROM b.source AND ', 'pos', depth)},
{_folds('t', f'mf{depth - 1}', '', 'tpos', top)}
SELECT doc_id, leaf, subroot, (SELECT digest FROM q) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT digest FROM q) AS verified FROM tf{top - 1}"""
