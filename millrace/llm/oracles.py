"""SQL for the queries that SQL can express."""

from __future__ import annotations

from millrace.llm.chat import AGAIN, BUDGET, CHARS_PER_TOKEN, END, HISTORY, START, TURN_TOKENS
from millrace.llm.common import UPPER
from millrace.llm.decontaminate import RATIO, WINDOW
from millrace.llm.licenses import COVERED, GAP, templates
from millrace.llm.repeats import LENGTH

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
places AS (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM places),
lens AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, lens),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM starts),
hits AS (SELECT DISTINCT doc_id, grams.n, i, item FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {RATIO} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


_TEMPLATES = ", ".join(f"({i}, '{label}', '{kind}', {k}, '{' '.join(words)}')" for i, label, kind, k, words in templates())

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
known AS (SELECT *, string_split(t, ' ') AS tw FROM (VALUES {_TEMPLATES}) v(template, label, kind, k, t)),
places AS (SELECT *, unnest(range(1, len(tw) - k + 2)) AS i FROM known),
tg AS (SELECT template, k, i - 1 AS place, array_to_string(tw[i : i + k - 1], ' ') AS g FROM places),
starts AS (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM known)),
dg AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i : i + k - 1], ' ') AS g FROM starts),
votes AS (SELECT doc_id, template, pos - place AS diagonal, place FROM dg JOIN tg ON dg.k = tg.k AND dg.g = tg.g),
exact AS (SELECT doc_id, template, diagonal, count(DISTINCT place) AS n FROM votes GROUP BY 1, 2, 3),
base AS (SELECT doc_id, label, diagonal FROM exact JOIN known USING (template) WHERE kind = 'phrase' AND n = len(tw) - k + 1),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new
  FROM exact JOIN known USING (template) WHERE kind = 'notice'),
merged AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM steps),
hit AS (SELECT m.doc_id, m.template, m.part, m.diagonal, v.place FROM merged m JOIN votes v ON m.doc_id = v.doc_id AND m.template = v.template AND m.diagonal = v.diagonal),
span AS (SELECT doc_id, template, part, min(diagonal + place) AS first, max(diagonal + place) AS last FROM hit GROUP BY 1, 2, 3),
cover AS (SELECT doc_id, template, part, count(DISTINCT x) AS n FROM (SELECT doc_id, template, part, unnest(range(place, place + k)) AS x FROM hit JOIN known USING (template)) GROUP BY 1, 2, 3),
more AS (SELECT doc_id, label, CAST(n AS DOUBLE) / len(tw) AS share FROM span JOIN cover USING (doc_id, template, part) JOIN known USING (template)
  WHERE CAST(n AS DOUBLE) / len(tw) >= {COVERED} AND last + k - first <= 2 * len(tw)),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0 AS share FROM base UNION ALL SELECT * FROM more) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN l ON d.doc_id = l.doc_id"""

OP8 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
block AS (SELECT doc_id, n, 1000 * j AS begun, substr(h, 2000 * j + 1, {2000 + 2 * LENGTH}) AS part FROM (SELECT *, unnest(range(0, n // 1000 + 1)) AS j FROM d)),
w AS (SELECT doc_id, begun + p AS p, substr(part, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, 1000)) AS p FROM block) WHERE begun + p + {LENGTH} <= n),
low AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN low USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, p, sum(CASE WHEN before + {LENGTH} >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hit),
span AS (SELECT doc_id, run, min(p) AS a, max(p) + {LENGTH} AS b FROM runs GROUP BY 1, 2),
kept AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, -1, 0 FROM d)),
text AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(kept.b, n) - a)), '' ORDER BY a) AS k FROM kept JOIN d USING (doc_id) GROUP BY 1),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN text ON d.doc_id = text.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id"""


def _escaped(column: str) -> str:
    return f"replace(replace({column}, '&', '&amp;'), '<', '&lt;')"


assert len(START) == len(AGAIN)  # a turn is as long when it is repeated

OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CAST(ceil(length(text) / {CHARS_PER_TOKEN}.0) AS BIGINT) + {TURN_TOKENS} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM c),
u AS (SELECT *, i = 1 AND role = 'system' AS is_system, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS upto,
  max(CASE WHEN i = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS st FROM t),
v AS (SELECT *, upto - tokens AS begun, greatest({BUDGET - HISTORY} - st, {BUDGET // 4}) AS room FROM u),
x AS (SELECT *, (greatest(begun - st, 0) // room) || '/' || ((greatest(upto - st, 1) - 1) // room) AS block FROM v),
y AS (SELECT *, i = 1 OR (NOT coalesce(lag(is_system) OVER (PARTITION BY conv_id ORDER BY i), false) AND block <> lag(block) OVER (PARTITION BY conv_id ORDER BY i)) AS head,
  count(*) OVER (PARTITION BY conv_id ORDER BY begun RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING) AS behind,
  {len(START) + 1 + len(END)} + length(replace({_escaped("role")}, chr(10), '&nl;')) + length({_escaped("text")}) AS size FROM x),
heads AS (SELECT conv_id, i, behind, st > 0 AND i > 1 AS sys, coalesce(lead(i) OVER (PARTITION BY conv_id ORDER BY i) - 1, 9000000000) AS last FROM y WHERE head),
shown AS (SELECT h.conv_id, CAST(sum(y.size) AS BIGINT) AS formatted_chars FROM heads h JOIN y ON y.conv_id = h.conv_id
  AND (y.i BETWEEN greatest(h.i - h.behind, CASE WHEN h.sys THEN 2 ELSE 1 END) AND h.last OR (h.sys AND y.i = 1)) GROUP BY h.conv_id),
said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss FROM t GROUP BY conv_id)
SELECT said.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said JOIN shown ON said.conv_id = shown.conv_id"""
