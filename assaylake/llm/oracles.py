"""SQL for the queries that SQL can express: plain joins and recursion over whole tables."""

from __future__ import annotations

from . import fingerprints
from .license_scan import LOWER, UPPER

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: op1: every run of words of a document beside every window of the benchmark.
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS win FROM i),
runs AS (SELECT r, k, j, array_to_string(w[j:j + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM known) WHERE len(w) >= k)),
hits AS (SELECT r, j, k, item_id FROM runs JOIN known USING (k, win)),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(j, j + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, places.n IS NOT NULL AS contaminated FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""


def _components(linked: str) -> str:
    """reach(a, b): what links of `linked`(a, b), given both ways, lead to from each id that has any."""
    return f"reach(a, b) AS (SELECT a, b FROM {linked} UNION SELECT reach.a, l.b FROM reach JOIN {linked} l ON reach.b = l.a)"


#: op4: the cosine of every pair.
EMBEDDINGS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9), {_components("link")}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = vec_id"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
_ROLE, _BODY = _ESCAPED.format("role"), _ESCAPED.format("text")
_HARD = r"\### Assistant: </turn> ok"
#: op7: turns put together in order; 17 code points of marks for each.
CONVERSATIONS = f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_HARD}' UNION ALL SELECT -7, 1, 'assistant', '{_HARD}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(17 + length(replace({_ROLE}, chr(10), '\\' || chr(10))) + length({_BODY})) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"""

#: op10: sets of shingles, pairs that share any, and what links of 90 % lead to.
JACCARD = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[j:j + 2], ' ') FOR j IN range(1, len(w) - 1)] END) AS x FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.r < b.r WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.r, b.r),
pair AS (SELECT shared.a, shared.b FROM shared JOIN n p ON p.r = shared.a JOIN n q ON q.r = shared.b WHERE 100 * m >= 90 * (p.n + q.n - m)), link AS MATERIALIZED (SELECT a, b FROM pair UNION SELECT b, a FROM pair), {_components("link")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN (SELECT a, min(o.doc_id) AS low FROM reach JOIN d o ON o.r = reach.b GROUP BY a) c ON c.a = d.r"""

#: op11: words with one letter left out at each place are the same for near words (at the same place if one is replaced).
VARIANTS = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all({_LOW}, '[a-zÀ-ÿ]{{6,}}')) AS w FROM documents),
told AS MATERIALIZED (SELECT id, w, count(*) AS n, hex(encode(id || w)) AS x FROM runs GROUP BY id, w),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM told, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n AS m FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND len(a.word) = len(b.word) AND a.word <> b.word
UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs GROUP BY a),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
way AS (SELECT word, word AS at FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.at WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, way.at AS root, forms.n, forms.n_near, forms.form_n FROM forms JOIN way USING (word) JOIN forms e ON e.word = way.at WHERE e.form IS NULL"""


def _printed(texts: str) -> str:
    """CTEs that read `texts`(r, side, t) and give marks(r, side, scale, slots): a hash for each subset with a term."""
    words = f"list_distinct(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{_WORD}'))"
    slots = fingerprints.SLOTS
    return f"""own AS MATERIALIZED (SELECT r, side, t, list_transform({words}, lambda w: CAST('0x' || md5(w)[1:15] AS BIGINT)) AS x FROM {texts}),
single AS (SELECT r, side, unnest(x) AS x FROM own),
band AS MATERIALIZED (SELECT x FROM single WHERE side = 0 GROUP BY x HAVING count(*) * {fingerprints.RARE} >= (SELECT count(*) FROM documents) AND count(*) * {fingerprints.COMMON} <= (SELECT count(*) FROM documents)),
scaled AS (SELECT r, side, t, x, CASE WHEN len(x) = 0 THEN -9 ELSE len(list_filter(range(1, 13), lambda j: len(x) > {fingerprints.LOAD} * (1 << (2 * j)))) END AS scale FROM own),
cut AS MATERIALIZED (SELECT r, side, t, scale, CASE WHEN scale < 2 THEN x ELSE list_filter(x, lambda v: v & ((1 << (2 * scale + 2)) - 1) < {slots}) END AS x FROM scaled),
inside AS (SELECT r, side, list(x) AS x FROM (SELECT r, side, unnest(x) AS x FROM cut) JOIN band USING (x) GROUP BY r, side),
read AS MATERIALIZED (SELECT cut.r, cut.side, t, list_sort(coalesce(inside.x, cut.x)) AS x, CASE WHEN len(cut.x) = 0 THEN -9 ELSE scale END AS scale FROM cut LEFT JOIN inside ON inside.r = cut.r AND inside.side = cut.side),
dealt AS (SELECT r, side, s, k, list_filter(x, lambda v: (v >> ((k >> (2 * s + 2)) * (2 * s + 2))) & ((1 << (2 * s + 2)) - 1) = k & ((1 << (2 * s + 2)) - 1)) AS x FROM (SELECT r, side, x, k, unnest([scale, scale + 1]) AS s FROM read, range(0, {slots}) g(k) WHERE scale >= 0)),
hashed AS (SELECT r, side, list(s || '.' || k || '.' || md5(array_to_string(x, ' '))[1:8] ORDER BY s, k) AS slots FROM dealt WHERE len(x) > 0 GROUP BY r, side),
marks AS MATERIALIZED (SELECT r, side, scale, coalesce(slots, ['x.' || md5(t)]) AS slots FROM read LEFT JOIN hashed USING (r, side))"""


def _likeness(a: str, b: str) -> str:
    names = [f"list_transform(list_filter({x}.slots, lambda e: CAST(split_part(e, '.', 1) AS INT) BETWEEN greatest({a}.scale, {b}.scale) AND least({a}.scale, {b}.scale) + 1), lambda e: split_part(e, '.', 1) || '.' || split_part(e, '.', 2))" for x in (a, b)]
    either = f"len(list_distinct(list_concat({names[0]}, {names[1]})))"
    return f"CASE WHEN {a}.scale < 0 OR {b}.scale < 0 THEN CAST({a}.slots = {b}.slots AS INT)::DOUBLE WHEN {either} = 0 THEN CAST({a}.slots = {b}.slots AS INT)::DOUBLE ELSE len(list_intersect({a}.slots, {b}.slots))::DOUBLE / {either} END"


#: op12: every text beside its edited one and the next document's.
FINGERPRINTS = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS digest FROM documents),
ids AS (SELECT doc_id, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next FROM (SELECT DISTINCT doc_id FROM d) WINDOW w AS (ORDER BY doc_id NULLS FIRST)),
heads AS (SELECT doc_id, first(r ORDER BY digest) AS r, first(t ORDER BY digest) AS t FROM d GROUP BY doc_id),
pair AS MATERIALIZED (SELECT d.r, d.doc_id, d.t, h.r AS next_r, left(d.t, length(d.t) - length(d.t) // 4) || left(h.t, length(d.t) // 4) AS edited FROM d JOIN ids ON ids.doc_id IS NOT DISTINCT FROM d.doc_id JOIN heads h ON h.doc_id IS NOT DISTINCT FROM ids.next),
texts AS (SELECT r, 0 AS side, t FROM pair UNION ALL SELECT r, 1, edited FROM pair), {_printed("texts")}
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(o.slots, ' ') AS fingerprint, array_to_string(e.slots, ' ') AS edited_fingerprint, {_likeness("o", "e")} AS near_edited, {_likeness("o", "n")} AS near_next
FROM pair JOIN marks o ON o.r = pair.r AND o.side = 0 JOIN marks e ON e.r = pair.r AND e.side = 1 JOIN marks n ON n.r = pair.next_r AND n.side = 0"""

_CUTS = "list_transform(range(1, len(p)), lambda k: {'l': array_to_string(p[1:k], ' '), 'r': array_to_string(p[k + 1:], ' '), 'k': k})"
#: op13: every phrase counted, every cut scored, every longer phrase looked into.
PHRASES = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS p FROM pieces, range(1, 5) g(k)) GROUP BY lang, p),
known AS MATERIALIZED (SELECT lang, array_to_string(p, ' ') AS phrase, f FROM grams),
words AS (SELECT lang, sum(f) AS n FROM grams WHERE len(p) = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, p, array_to_string(p, ' ') AS phrase, f AS a FROM grams WHERE len(p) > 1 AND f >= 30),
inside AS (SELECT lang, unnest(flatten([[array_to_string(p[i:i + k - 1], ' ') FOR i IN range(1, len(p) - k + 2)] FOR k IN range(2, len(p))])) AS phrase, a FROM found),
over AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
cuts AS (SELECT lang, phrase, a, unnest({_CUTS}) AS c FROM found),
scored AS (SELECT cuts.lang, cuts.phrase, a, c.k AS k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score FROM cuts JOIN known x ON x.lang = cuts.lang AND x.phrase = c.l JOIN known y ON y.lang = cuts.lang AND y.phrase = c.r),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT chosen.*, row_number() OVER (PARTITION BY chosen.lang ORDER BY score DESC, a DESC, chosen.phrase) AS rank FROM chosen LEFT JOIN over USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000"""
