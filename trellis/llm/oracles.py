"""DuckDB SQL for the training-data queries that SQL can express, over the same tables.

op2, op3, op6, op8 to op10 and the pipeline rest on trained models, sketches, packing or tokenizers; tests hold them
against brute force, round trips or held-out labels instead. The base columns of op9 are tested against plain patterns.
"""

from __future__ import annotations

from .quality import COMMON_WORDS, LEAST_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, MOST_REPEATED

_BASE32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * k}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INT, 1)" for k in range(8) for j in range(4)
)

_OP1 = f"""
WITH p AS (SELECT row_number() OVER () AS number, page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
named AS (SELECT h, page_id AS first, number AS first_number, row_number() OVER (PARTITION BY h ORDER BY page_id, url NULLS FIRST, number) AS k FROM p WHERE page_id IS NOT NULL),
q AS (SELECT p.*, n.first, coalesce(n.first_number <> p.number, false) AS revisit FROM p LEFT JOIN named n ON n.h = p.h AND n.k = 1)
SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to FROM q
"""

_BLANK = "[\\x20\\x09-\\x0D]"


def _gone(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _jsd(p: list[str], q: list[str]) -> str:
    xlog = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END)"
    return "sqrt(greatest(0, " + " + ".join(f"({xlog(a)} + {xlog(b)}) / 2 - {xlog(f'(({a} + {b}) / 2)')}" for a, b in zip(p, q)) + "))"


def _op4() -> str:
    counted = lambda i: "CASE lang " + " ".join(f"WHEN '{k}' THEN len(list_filter(ws, lambda x: x = '{v[i]}'))" for k, v in COMMON_WORDS.items()) + " END"
    languages = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    classes = [_gone("\\p{Lu}"), _gone("[0-9]"), "length(t) - word_chars", _gone("[#*$%&|<>]"), _gone("[.,;:!?]"), "octet_length(encode(t)) - length(t)"]
    c, w = [f"c{i}" for i in range(7)], [f"w{i}" for i in range(13)]
    share = lambda xs, total: [f"({x}::DOUBLE / {total})" for x in xs]
    ref = lambda xs, total: [f"(r.{x}::DOUBLE / r.{total})" for x in xs]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({languages}) THEN lang ELSE 'other' END AS lang FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
each AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM e),
trip AS (SELECT rid, i, w AS a, lead(w) OVER x AS b, lead(w, 2) OVER x AS c FROM each WINDOW x AS (PARTITION BY rid ORDER BY i)),
many AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM trip WHERE c IS NOT NULL),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM many, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY 1),
f AS (SELECT e.rid, doc_id, lang, length(t) AS n_text, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, ({classes[3]})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
octet_length(encode(t)) AS c_all, {", ".join(f"({x})::BIGINT AS c{i}" for i, x in enumerate(classes))}, {", ".join(f"({counted(i)})::BIGINT AS w{i}" for i in range(12))} FROM e LEFT JOIN cover ON cover.rid = e.rid),
g AS (SELECT *, c_all - ({" + ".join(c[:6])}) AS c6, n_words - ({" + ".join(w[:12])}) AS w12, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f),
r AS (SELECT lang, {", ".join(f"sum({x}) AS {x}" for x in c + w)}, sum(c_all) AS c_total, sum(n_words) AS w_total FROM g WHERE NOT base_failed GROUP BY 1),
k AS (SELECT g.*, coalesce(CASE WHEN g.c_all > 0 AND r.c_total > 0 THEN {_jsd(share([f"g.{x}" for x in c], "g.c_all"), ref(c, "c_total"))} END, 0) AS cd, coalesce(CASE WHEN g.lang <> 'other' AND g.n_words > 0 AND r.w_total > 0 THEN {_jsd(share([f"g.{x}" for x in w], "g.n_words"), ref(w, "w_total"))} END, 0) AS wd FROM g LEFT JOIN r ON r.lang = g.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (n_text >= {MIN_CHARS} AND cd > {MAX_CHAR_DISTANCE}) AND NOT (n_words >= {MIN_WORDS} AND wd > {MAX_WORD_DISTANCE}) AS kept FROM k
"""


_OP7 = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS ss FROM d),
n AS (SELECT rid, doc_id, len(ss)::BIGINT AS n FROM t),
s AS (SELECT rid, unnest(ss) AS x FROM t WHERE doc_id IS NOT NULL),
pair AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM pair JOIN n x ON x.rid = pair.a JOIN n y ON y.rid = pair.b WHERE 100 * c >= 80 * (x.n + y.n - c) AND x.doc_id <> y.doc_id),
twoway AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS other FROM twoway UNION SELECT reach.node, twoway.b FROM reach JOIN twoway ON twoway.a = reach.other),
low AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS component_id, coalesce(doc_id = coalesce(component, doc_id), true) AS kept FROM n LEFT JOIN low ON node = doc_id
"""

_OP5 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
w AS (SELECT rid, doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
pair AS (SELECT a.rid AS a, b.rid AS b, a.pos, a.i, a.n, a.pos - b.pos AS gap FROM w a JOIN w b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.rid = a.rid AND b.pos < a.pos)),
isle AS (SELECT *, pos - row_number() OVER (PARTITION BY a, b, gap ORDER BY pos) AS run FROM pair),
long AS (SELECT *, sum(n) OVER (PARTITION BY a, b, gap, run) AS total FROM isle),
gone AS (SELECT DISTINCT a AS rid, i FROM long WHERE total >= 50),
kept AS (SELECT l.rid, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = l.rid AND gone.i = l.i) GROUP BY 1),
lost AS (SELECT rid, count(*) AS c FROM gone GROUP BY 1)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_removed_lines FROM d LEFT JOIN kept ON kept.rid = d.rid LEFT JOIN lost ON lost.rid = d.rid
"""

_OP13 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS x FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM w JOIN f USING (x), range(13) s(k) WHERE f.first < w.doc_id),
each AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS t FROM each WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = each.rid AND gone.i = each.i) GROUP BY 1),
lost AS (SELECT rid, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN lost USING (rid)
"""


def _op12(dims: int = 64) -> str:
    """Four rounds as four pairs of expressions; a part's index is kept in the low bits of its least distance."""
    p = dims // 4
    x = lambda t, form="{}": ", ".join(form.format(f"{t}x{i}") + f" AS x{i}" for i in range(p))
    gap = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(p))
    finite = "len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND {finite})",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, {', '.join(f'v[{p} * p + {i + 1}] AS x{i}' for i in range(p))} FROM v, range(4) s(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, {x('')} FROM part WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))",
    ]
    for k in range(5):
        steps.append(f"near{k} AS MATERIALIZED (SELECT a.vec_id, a.p, min(({gap}) * 256 + b.i) AS m FROM part a JOIN book{k} b ON a.p = b.p GROUP BY 1, 2)")
        if k < 4:
            steps.append(f"sum{k} AS (SELECT p, m % 256 AS i, count(*) AS n, {', '.join(f'sum(x{i}) AS x{i}' for i in range(p))} FROM part JOIN near{k} USING (vec_id, p) GROUP BY 1, 2)")
            moved = ", ".join(f"coalesce(floor(s.x{i}::DOUBLE / s.n)::BIGINT, b.x{i}) AS x{i}" for i in range(p))
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.i, {moved} FROM book{k} b LEFT JOIN sum{k} s ON s.p = b.p AND s.i = b.i)")
    steps.append("code AS (SELECT vec_id, string_agg(format('{:02x}', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near4 GROUP BY 1)")
    flat = "concat_ws(',', " + ", ".join(f"x{i}" for i in range(p)) + ")"
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg({flat}, ',' ORDER BY p, i)) FROM book4) AS codebooks_sha256 FROM code JOIN v USING (vec_id)"""


# The checksum takes a byte, then eight shifts marked -1, at a time; clicks of a client are walked by their number.
_OP11 = """
WITH RECURSIVE c AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
e AS (SELECT click_id, client_id, epoch_us(ts) AS t, epoch_us(arrived_at) // 3600000000 AS h,
  xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(click_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc FROM c),
g AS (SELECT min(h) AS lo, max(h) AS hi FROM e),
b AS (SELECT click_id, client_id, t, least(9, coalesce((h - lo) * 10 // (hi - lo + 1), 9) + coalesce(crc % 7 = 0, false)::INT)::INT AS batch FROM e, g),
w AS (SELECT k, (SELECT max(t) FROM b WHERE batch < k) - 21600000000 AS w FROM range(10) s(k)),
p AS (SELECT b.*, coalesce(t < w, false) AS late FROM b JOIN w ON k = batch),
s AS MATERIALIZED (SELECT *, coalesce((SELECT min(k) FROM w WHERE k > p.batch AND w > p.t), 9)::INT AS settled, row_number() OVER (PARTITION BY client_id ORDER BY t, click_id NULLS FIRST) AS n FROM p WHERE NOT late),
r AS (SELECT client_id, n, click_id, settled, t, 3300000000 AS credit, NULL::BIGINT AS since, NULL::BIGINT AS until FROM s WHERE n = 1 UNION ALL
  SELECT client_id, n, click_id, settled, t, CASE WHEN have >= 300000000 THEN have - 300000000 ELSE have END, CASE WHEN have < 300000000 THEN coalesce(since, t) END, CASE WHEN have < 300000000 THEN t + 300000000 - have END
  FROM (SELECT s.*, r.since, least(3600000000, r.credit + s.t - r.t) AS have FROM r JOIN s ON s.client_id = r.client_id AND s.n = r.n + 1))
SELECT click_id, CASE WHEN since IS NULL THEN 'admitted' ELSE 'throttled' END AS outcome, settled AS batch, credit AS credit_after, since AS penalty_start_us, until AS penalty_end_us FROM r
UNION ALL SELECT click_id, 'late', batch, NULL, NULL, NULL FROM p WHERE late
"""

ORACLES: dict[str, str] = {"op1_warc": _OP1, "op4_quality": _op4(), "op5_line_dedup": _OP5, "op7_near_dedup": _OP7, "op11_throttle": _OP11, "op12_vector_codes": _op12(), "op13_substring": _OP13}
