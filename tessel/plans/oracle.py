"""DuckDB SQL of the registered queries. The whole of flashvid, a dry run and the standard library's sampling have none; tests hold them against plain code."""

from __future__ import annotations

from .. import catalog
from ..functions import text

TIMELINE = "timeline AS (SELECT user_id AS sample, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS score FROM events)"
POOLS = "pools AS (SELECT user_id AS sample, count(*) AS total FROM events GROUP BY 1)"
VECTORS = """v0 AS (SELECT label::BIGINT AS sample, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS e FROM embeddings),
vectors AS (SELECT a.sample, a.idx, a.e, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS score FROM v0 a JOIN v0 b ON a.sample = b.sample AND b.idx = 0)"""
VISION = "vision(family, patch, merge, factor, tps, tmerge, min_pixels, max_pixels, clamp) AS (VALUES " + ", ".join(f"('{n}', {v.patch}, {v.merge}, {v.factor}, {v.tps}, {v.tmerge}, {v.min_pixels}, {v.max_pixels}, '{v.clamp}')" for n, v in catalog.FAMILIES.items()) + ")"
SIZES = VISION + """, sizes AS (SELECT p.*, v.* EXCLUDE (family) FROM (SELECT p_partkey::BIGINT AS id, 40 + p_partkey::BIGINT * 37 % 1500 AS h, 60 + p_partkey::BIGINT * 53 % 2400 AS w, 1 + p_partkey::BIGINT % 150 AS n,
  (1 + p_partkey::BIGINT % 4) / 4.0::DOUBLE AS r, ['qwen3_vl', 'qwen3_5', 'qwen2_5_vl'][p_partkey % 3 + 1] AS family FROM part) p JOIN vision v USING (family))"""
RESULTS = """results AS (SELECT o_orderkey::BIGINT AS key, o_orderpriority AS method, year(o_orderdate)::BIGINT AS setup,
  CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS correct, CASE o_orderstatus WHEN 'P' THEN 'error' ELSE 'ok' END AS status FROM orders)"""
LEDGER = """ledger AS (SELECT l_orderkey::BIGINT AS key, sum(l_quantity::DOUBLE) AS decode_seconds, sum(l_extendedprice::DOUBLE) AS vit_flops, sum(l_partkey)::BIGINT AS prefill_tokens, sum(l_suppkey)::BIGINT AS vit_patch_tokens FROM lineitem GROUP BY 1)"""


def side(x: str, r: str, f: str = "factor") -> str:
    return f"greatest({f}, (round_even({x} * ({r})::DOUBLE / {f}, 0) * {f})::BIGINT)"


def smart(h: str, w: str) -> str:
    """Columns hb, wb of smart_resize over a relation with h, w, factor, min_pixels, max_pixels."""
    hb, wb = f"round_even({h}::DOUBLE / factor, 0) * factor", f"round_even({w}::DOUBLE / factor, 0) * factor"
    out = []
    for x, b in ((h, hb), (w, wb)):
        out.append(f"(CASE WHEN ({hb}) * ({wb}) > max_pixels THEN greatest(factor, floor({x} / sqrt({h}::DOUBLE * {w} / max_pixels) / factor) * factor) WHEN ({hb}) * ({wb}) < min_pixels THEN ceil({x} * sqrt(min_pixels / ({h}::DOUBLE * {w})) / factor) * factor ELSE {b} END)::BIGINT")
    return f"{out[0]} AS hb, {out[1]} AS wb"


def indices(total: str, budget: str) -> str:
    """First to last, as text."""
    n = f"coalesce(least({budget}, {total}), {total})"
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {n} = 1 THEN '0' ELSE array_to_string(list_transform(range(0, {n}), lambda i: (({total} - 1) * i) // ({n} - 1)), ',') END"


FIT = """cand AS (SELECT id, gh, gw, abs(ln((gw::DOUBLE / gh) / (w::DOUBLE / h))) AS err, most FROM (
    SELECT *, unnest(range(greatest(1, floor(th * sqrt(most::DOUBLE / (th * tw)))::BIGINT - 2), greatest(1, least(th, floor(th * sqrt(most::DOUBLE / (th * tw)))::BIGINT + 3)) + 1)) AS gh FROM tops) a,
    LATERAL (SELECT unnest(range(greatest(1, floor(tw * sqrt(most::DOUBLE / (th * tw)))::BIGINT - 2), greatest(1, least(tw, floor(tw * sqrt(most::DOUBLE / (th * tw)))::BIGINT + 3)) + 1)) AS gw) b WHERE gh * gw <= most),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY (err <= 0.08) DESC, CASE WHEN err <= 0.08 THEN (gh * gw)::DOUBLE ELSE -err END DESC, err, gh, gw) = 1),
fitted AS (SELECT t.*, CASE WHEN th * tw <= t.most THEN th ELSE coalesce(gh, 1) END * factor AS fit_h, CASE WHEN th * tw <= t.most THEN tw ELSE coalesce(gw, 1) END * factor AS fit_w FROM tops t LEFT JOIN best b USING (id))"""
TOPS = f"tops AS (SELECT *, {side('h', '1.0')} // factor AS th, {side('w', '1.0')} // factor AS tw, {{}} AS most FROM {{}})"
CELLS = lambda r: f"({side('h', r)} // factor) * ({side('w', r)} // factor)"

STRIP = r"regexp_replace({}, '^[\s\x{{0B}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{85}}\p{{Z}}]+$', '', 'g')"
L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
ANSWERS = """answers AS (SELECT conv_id, turn, CASE k % 7 WHEN 0 THEN 'The answer is ' || letter WHEN 1 THEN ' (' || lower(letter) || ') ' || text WHEN 2 THEN text || ' [[ b ]] or {{' || letter || '}}' WHEN 3 THEN letter
    WHEN 4 THEN text || chr(10) || 'Option: ' || letter || '!' WHEN 5 THEN text ELSE '??' END AS prediction,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' ' || lower(letter) || '. ' END AS gold
  FROM (SELECT *, conv_id * 8 + turn AS k, substr('ABCD', ((conv_id * 8 + turn) % 4 + 1)::INT, 1) AS letter FROM conversations))"""
CHOICE = rf"""chosen AS (SELECT *, CASE WHEN len(wraps) > 0 THEN upper(regexp_extract(wraps[-1], '[A-Za-z]')) ELSE coalesce(
    nullif(regexp_extract(t, '^\(?\s*([A-Z])\s*[).:\-\s]', 1), ''), nullif(regexp_extract(t, '^([A-Z])$', 1), ''),
    nullif(regexp_extract(t, '{L}(?:ANSWER|OPTION|CHOICE)[^\p{{L}}\p{{N}}_][^A-Z]{{0,7}}([A-Z]){R}', 1), ''), nullif(regexp_extract(t, '{L}([A-Z]){R}', 1), '')) END AS choice
  FROM (SELECT *, regexp_extract_all(prediction, '\[\[\s*[A-Za-z]\s*\]\]|\{{\{{\s*[A-Za-z]\s*\}}\}}') AS wraps, upper({STRIP.format("prediction")}) AS t FROM answers))"""

_PROMPT = text.PROMPT.replace("'", "''").split("{question}")
_PROMPT = [_PROMPT[0], *_PROMPT[1].split("{options}")]

PLAN_ZIP = """w1 AS (SELECT *, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY att DESC, idx) AS rk FROM (SELECT sample, idx, e, round(score, 4) AS att FROM vectors)),
w2 AS (SELECT *, greatest(1, round_even(n * {ratio}::DOUBLE, 0)::BIGINT) AS total FROM w1), w3 AS (SELECT *, greatest(1, round_even(total * {alpha}::DOUBLE, 0)::BIGINT) AS d0 FROM w2), w4 AS (SELECT *, greatest(1, total - d0) AS c0 FROM w3),
w5 AS (SELECT *, CASE WHEN d0 + c0 > n THEN least(d0, n - 1) ELSE d0 END AS dom FROM w4), w6 AS (SELECT *, CASE WHEN d0 + c0 > n THEN greatest(1, least(c0, n - dom)) ELSE c0 END AS c1 FROM w5),
rest AS (SELECT *, n - dom AS nd, least(c1, n - dom) AS ctx, row_number() OVER (PARTITION BY sample ORDER BY idx) - 1 AS place FROM w6 WHERE rk > dom),
marked AS (SELECT *, place % greatest(1, nd // ctx) = 0 AND place // greatest(1, nd // ctx) < ctx AS target FROM rest),
near AS (SELECT a.sample, a.idx, b.idx AS target, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) AS sim
  FROM marked a JOIN marked b ON a.sample = b.sample AND NOT a.target AND b.target),
plan AS (SELECT sample, idx AS tok, 'dominant' AS role, idx AS target FROM w6 WHERE rk <= dom UNION ALL SELECT sample, idx, 'target', idx FROM marked WHERE target
  UNION ALL SELECT sample, idx, 'merged', target FROM near QUALIFY row_number() OVER (PARTITION BY sample, idx ORDER BY sim DESC, target) = 1)"""

_STOP = ", ".join(f"'{w}'" for w in text.NON_VISUAL)
_CANNED = ["'" + c.replace("'", "''") + "'" for c in text.CANNED]
_SETUPS = ", ".join(f"('{n}', {'NULL' if b.frame_count is None else b.frame_count}, {'NULL' if b.hi_i_count is None else b.hi_i_count})" for n, b in catalog.SETUPS.items())
_METHODS = ", ".join(f"('{n}', '{s}', '{p}', '{catalog.SIGNALS[s]}')" for n, (s, p) in catalog.METHODS.items())
_MODELS = "[" + ", ".join(f"'{m}'" for m in (*catalog.MODELS, "Qwen2_5-VL", "other")) + "]"
RELEASED = """released AS (SELECT (page_id // 3)::VARCHAR AS video_id, page_id::VARCHAR AS question_id, url, page_id, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR END AS domain FROM pages)"""
SUBS = "subs AS (SELECT c_custkey::VARCHAR AS video_id, '/s/' || c_custkey || '.srt' AS subtitle_path FROM customer WHERE c_mktsegment <> 'BUILDING')"
SHARDS = """shards AS (SELECT key, correct, setup AS prefill_tokens, 0 AS shard, status FROM results WHERE key % 3 = 0 UNION ALL SELECT key, correct, setup, 1, NULL FROM results WHERE key % 3 <> 2 UNION ALL SELECT key, correct, setup, 2, status FROM results WHERE key % 3 = 2)"""
ACCURACY = "labelled AS (SELECT d.lang, d.source, l.quality = 1 AS correct FROM labels l JOIN documents d USING (doc_id))"

AKS = f"""WITH RECURSIVE {TIMELINE}, base AS (SELECT sample, idx, n, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0::DOUBLE END AS s FROM (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n FROM timeline WINDOW p AS (PARTITION BY sample))),
seg AS (SELECT sample, 1::BIGINT AS node, 0::BIGINT AS a, max(n)::BIGINT AS z, 0 AS d FROM base GROUP BY sample
  UNION ALL SELECT sample, node * 2 + k, CASE WHEN k = 0 THEN a ELSE a + z // 2 END, CASE WHEN k = 0 THEN z // 2 ELSE z - z // 2 END, d + 1 FROM seg, (VALUES (0::BIGINT), (1::BIGINT)) s(k) WHERE d < 3),
cells AS (SELECT g.sample, g.node, g.d, b.idx, b.s, b.n, row_number() OVER (PARTITION BY g.sample, g.node ORDER BY b.s DESC, b.idx) AS r FROM seg g JOIN base b ON b.sample = g.sample AND b.idx >= g.a AND b.idx < g.a + g.z),
stat AS (SELECT sample, node, d, (avg(s) FILTER (r <= 8) - avg(s) > 0.45 AND stddev_pop(s) > 0.1) OR d >= 3 AS final FROM cells GROUP BY sample, node, d),
leaf AS (SELECT c.*, min(c.d) OVER (PARTITION BY c.sample, c.idx) AS first FROM cells c JOIN stat t USING (sample, node, d) WHERE final)
SELECT sample, idx FROM leaf WHERE d = first AND n >= 8 AND r <= floor(8 / pow(2, d)) UNION ALL SELECT sample, idx FROM base WHERE n < 8"""

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"
#: Frames of five tokens; u: unit vectors.
GRID = VECTORS + f""", g0 AS (SELECT sample, idx // 5 AS frame, idx % 5 AS pos, idx AS tok, list_transform(e, lambda v: abs(v)) AS x, abs(score) AS attention FROM vectors QUALIFY count(*) OVER (PARTITION BY sample, idx // 5) = 5),
grid AS (SELECT *, list_transform(x, lambda v: v / s) AS u FROM (SELECT *, sqrt({DOT.format("x", "x")}) AS s FROM g0))"""

KERNELS: dict[str, str] = {
    "semdiv_frames": f"""WITH RECURSIVE {VECTORS}, q AS (SELECT sample, idx, e, CASE WHEN hi > lo THEN pow((score - lo) / (hi - lo), 5) ELSE 1.0::DOUBLE END AS q FROM (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM vectors WINDOW p AS (PARTITION BY sample))),
r AS (SELECT sample, idx, list_transform(e, lambda v: v * q) AS r, 0 AS step, NULL::BIGINT AS j, 1.0::DOUBLE AS gain FROM q
  UNION ALL SELECT sample, idx, CASE WHEN idx = j THEN list_transform(r, lambda v: 0.0::DOUBLE) ELSE list_transform(range(1, len(r) + 1), lambda i: r[i] - onto * b[i]) END, step + 1, j, gain
  FROM (SELECT *, {DOT.format("r", "b")} / gain AS onto FROM (SELECT sample, idx, r, step, first_value(idx) OVER w AS j, first_value(r) OVER w AS b, first_value(own) OVER w AS gain FROM (SELECT *, {DOT.format("r", "r")} AS own FROM r WHERE step < 8) WINDOW w AS (PARTITION BY sample ORDER BY own DESC, idx)) WHERE gain > 1e-12))
SELECT DISTINCT sample, j AS idx FROM r WHERE j IS NOT NULL""",
    "mmtok_select": f"""WITH RECURSIVE {VECTORS}, u AS (SELECT sample, idx, list_transform(e, lambda v: v / s) AS u FROM (SELECT *, greatest(sqrt({DOT.format("e", "e")}), 1e-8) AS s FROM vectors)),
c AS (SELECT a.sample, a.idx AS line, b.idx AS tok, {DOT.format("a.u", "b.u")} AS s FROM u a JOIN u b USING (sample)),
h AS (SELECT sample, line, tok, s / 0.01 AS s, 1.0::DOUBLE / 3 AS share FROM c WHERE line < 3 UNION ALL SELECT sample, line + 3, tok, s / 0.2, 0.5::DOUBLE / count(*) OVER (PARTITION BY sample, line) FROM c),
p AS (SELECT sample, line, tok, share * x / sum(x) OVER w AS p FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY sample, line)) AS x FROM h) WINDOW w AS (PARTITION BY sample, line)),
n AS (SELECT sample, greatest(1, round_even(count(*) * 0.25, 0))::BIGINT AS k FROM u GROUP BY 1),
r AS (SELECT sample, line, tok, p, 0.0::DOUBLE AS best, k, 0 AS step, NULL::BIGINT AS j FROM p JOIN n USING (sample)
  UNION ALL SELECT sample, line, tok, p, greatest(best, max(CASE WHEN tok = j THEN p END) OVER (PARTITION BY sample, line)), k, step + 1, j FROM
    (SELECT *, first_value(tok) OVER (PARTITION BY sample ORDER BY gain DESC, tok) AS j FROM (SELECT sample, line, tok, p, best, k, step, sum(greatest(p - best, 0)) OVER (PARTITION BY sample, tok) AS gain FROM r WHERE step < k)))
SELECT DISTINCT sample, j AS tok FROM r WHERE j IS NOT NULL""",
    "farthest_point": f"""WITH {GRID}, m AS (SELECT sample, list(v ORDER BY i) AS m FROM (SELECT sample, i, avg(x[i]) AS v FROM (SELECT sample, x, unnest(range(1, len(x) + 1)) AS i FROM grid) GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT sample, frame, pos, u, attention * 1e6 * {DOT.format("x", "m")} AS w FROM grid JOIN m USING (sample)),
d AS (SELECT a.sample, a.frame, a.pos AS i, b.pos AS j, (1 - {DOT.format("a.u", "b.u")}) * b.w AS d FROM w a JOIN w b USING (sample, frame)),
f AS (SELECT sample, frame, j FROM (SELECT sample, frame, j, list_sort(list(d))[2] AS second FROM d GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY sample, frame ORDER BY second DESC, j) = 1),
s AS (SELECT d.sample, d.frame, d.j FROM d JOIN f ON d.sample = f.sample AND d.frame = f.frame AND d.i = f.j QUALIFY row_number() OVER (PARTITION BY d.sample, d.frame ORDER BY d.d DESC, d.j) = 1)
SELECT sample, frame, j AS pos FROM f UNION ALL SELECT sample, frame, j FROM s""",
    "temporal_merge": f"""WITH RECURSIVE {GRID}, s AS (SELECT a.sample, a.frame, a.pos, b.pos AS onto, {DOT.format("a.u", "b.u")} AS s FROM grid a JOIN grid b ON a.sample = b.sample AND b.frame = a.frame - 1),
b AS (SELECT g.sample, g.frame, g.pos, g.x, m.onto, coalesce(m.s, -1) AS s FROM grid g LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sample, frame, pos ORDER BY s DESC, onto) = 1) m USING (sample, frame, pos)),
n AS (SELECT sample, count(*) // 5 AS frames, count(*) FILTER (s <= 0.6) AS stay, list_reverse_sort(list(s)) AS all_s FROM b GROUP BY 1),
g AS (SELECT b.*, CASE WHEN stay >= 2 * frames THEN s > 0.6 ELSE s > greatest(all_s[3 * frames], -1 + 1e-6) END AS gone FROM b JOIN n USING (sample)),
r AS (SELECT sample, list_sum(x) AS total, frame, pos, onto, gone, 0 AS depth FROM g UNION ALL SELECT r.sample, r.total, g.frame, g.pos, g.onto, g.gone, depth + 1 FROM r JOIN g ON r.gone AND g.sample = r.sample AND g.frame = r.frame - 1 AND g.pos = r.onto)
SELECT sample, frame, pos, round(sum(total) / (1 + count(*) FILTER (depth = 1)), 4) AS total FROM r WHERE NOT gone GROUP BY 1, 2, 3""",
    "dpc_knn": f"""WITH {GRID}, d AS (SELECT a.sample, a.tok AS i, b.tok AS j, sqrt(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))) / sqrt(len(a.x)) AS d FROM grid a JOIN grid b USING (sample)),
y AS (SELECT sample, i, exp(-avg(d * d)) AS density FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sample, i ORDER BY d, j) <= 6) GROUP BY 1, 2),
a AS (SELECT d.sample, d.i, min(CASE WHEN q.density > p.density THEN d ELSE most END) * any_value(p.density) AS score FROM (SELECT *, max(d) OVER (PARTITION BY sample) AS most FROM d) d JOIN y p ON p.sample = d.sample AND p.i = d.i JOIN y q ON q.sample = d.sample AND q.i = d.j GROUP BY 1, 2),
c AS (SELECT sample, i AS centre, row_number() OVER (PARTITION BY sample ORDER BY score DESC, i) AS r FROM a QUALIFY r <= 6)
SELECT d.sample, d.i AS tok, c.centre FROM d JOIN c ON c.sample = d.sample AND c.centre = d.j QUALIFY row_number() OVER (PARTITION BY d.sample, d.i ORDER BY d.i = c.centre DESC, d.d, c.r) = 1""",
}

ORACLE: dict[str, str] = {
    "accuracy_cost_summary": f"""WITH {RESULTS}, {LEDGER} SELECT method, count(*) AS n, count(*) FILTER (status = 'error') AS errors, round(avg(correct::INT), 4) AS accuracy,
  round(avg(coalesce(decode_seconds, 0)), 4) AS mean_decode_seconds, round(avg(coalesce(vit_flops, 0)), 4) AS mean_vit_flops, round(avg(coalesce(prefill_tokens, 0)), 4) AS mean_prefill_tokens, round(avg(coalesce(vit_patch_tokens, 0)), 4) AS mean_vit_patch_tokens
  FROM results LEFT JOIN ledger USING (key) GROUP BY method""",
    "cost_ledger_fold": f"WITH {LEDGER} SELECT key, round(decode_seconds, 4) AS decode_seconds, prefill_tokens, vit_patch_tokens FROM ledger",
    "category_accuracy": f"WITH {ACCURACY} SELECT lang, count(*) AS n, count(correct) AS scored, round(avg(correct::INT), 6) AS accuracy FROM labelled GROUP BY lang",
    "rollup_accuracy": f"WITH {ACCURACY} SELECT lang, source, count(*) AS n, count(correct) AS scored, round(avg(correct::INT), 6) AS accuracy, grouping(lang, source)::BIGINT AS level FROM labelled GROUP BY ROLLUP (lang, source)",
    "mcq_extract_score": f"WITH {ANSWERS}, {CHOICE} SELECT conv_id, turn, choice, CASE WHEN gold IS NULL THEN NULL ELSE choice IS NOT DISTINCT FROM nullif(left(upper({STRIP.format('gold')}), 1), '') END AS correct FROM chosen",
    "prompt_render": f"""SELECT conv_id, turn, '{_PROMPT[0]}' || role || ' {{options}} ' || text || '{_PROMPT[1]}' || 'A. ' || text || chr(10) || 'B. ' || role || chr(10) || 'C. ' || conv_id || '{_PROMPT[2]}' AS prompt FROM conversations""",
    "shard_round_robin": "SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 4 = 1",
    "filter_limit_shard": "SELECT event_id, user_id FROM (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY event_id LIMIT 500) QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 3 = 2",
    "key_lookup": "WITH x AS (SELECT CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn ELSE 'v' || conv_id || '-' || turn END AS key FROM conversations) SELECT x.key, g.quality::BIGINT AS gold FROM x LEFT JOIN labels g ON x.key = g.doc_id || '-0'",
    "uniform_decode": f"WITH {POOLS} SELECT sample, {indices('total', 'b')} AS indices FROM (SELECT *, CASE WHEN sample % 5 = 0 THEN NULL ELSE sample % 5 * 7 - 7 END AS b FROM pools)",
    "uniform_center": f"WITH {POOLS} SELECT sample, array_to_string(list_transform(range(0, least(16, total)), lambda i: least(total - 1, ((2 * i + 1) * total) // (2 * least(16, total)))), ',') AS indices, least(16, total) AS n FROM pools",
    "lohi_uniform": f"WITH {POOLS} SELECT sample, total AS n_lo, CASE WHEN least(8, total) = 1 THEN (total // 2)::VARCHAR ELSE {indices('total', '8')} END AS hi, TRUE AS subset FROM pools",
    "timestamps_metadata": f"""WITH {POOLS}, f AS (SELECT sample, total, unnest(range(0, least(15, total))) AS k FROM pools), i AS (SELECT sample, total, k, CASE WHEN least(15, total) = 1 THEN 0 ELSE ((total - 1) * k) // (least(15, total) - 1) END AS idx FROM f),
m AS (SELECT sample, total, k, max(round_even(idx / 25.0::DOUBLE * 8, 0)::BIGINT - k) OVER (PARTITION BY sample ORDER BY k) + k AS number FROM i),
a AS (SELECT sample, any_value(total) AS total, list(number ORDER BY k) AS ns FROM m GROUP BY sample)
SELECT sample AS video_id, array_to_string(CASE WHEN len(ns) % 2 = 1 THEN list_append(ns, ns[-1]) ELSE ns END, ',') AS numbers, round(len(ns) / (total / 25.0::DOUBLE), 6) AS fps, 192::BIGINT AS height, 320::BIGINT AS width, round(len(ns) / (total / 25.0::DOUBLE), 6) AS metadata_fps FROM a""",
    "row_errors": f"""WITH {POOLS}, {TIMELINE}, s AS (SELECT * FROM timeline WHERE sample % 5 <> 0 OR idx <> 1), b AS (SELECT sample, count(*) AS n, arg_max(idx, (score, -idx)) AS best FROM s GROUP BY 1),
e AS (SELECT sample, total, best, CASE WHEN sample % 7 = 0 THEN 'ValueError: a video''s frame rate must be positive' WHEN coalesce(n, 0) <> total THEN 'ValueError: ' || coalesce(n, 0) || ' scores for ' || total || ' frames' END AS error FROM pools LEFT JOIN b USING (sample))
SELECT sample, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN least(15, total) ELSE 0 END AS frames, CASE WHEN error IS NULL THEN best END AS best FROM e""",
    "resize_target": f"WITH {SIZES} SELECT id, {side('h', 'r')} AS height, {side('w', 'r')} AS width FROM sizes",
    "fit_target": f"WITH {SIZES}, {TOPS.format('1 + id * 7 % 400', 'sizes')}, {FIT} SELECT id, fit_h, fit_w FROM fitted",
    "smart_resize": f"WITH {SIZES} SELECT id, hb AS height, wb AS width FROM (SELECT *, {smart('h', 'w')} FROM sizes)",
    "video_tokens_2d3d": f"""WITH {SIZES}, g AS (SELECT *, {smart('h', 'w')}, (n + tps - 1) // tps AS t, round_even(h::DOUBLE / factor, 0) * factor AS h3, round_even(w::DOUBLE / factor, 0) * factor AS w3 FROM sizes),
deep AS (SELECT *, CASE WHEN t * tps * h3 * w3 > max_pixels * t THEN greatest(factor, floor(h / sqrt(t * tps * h::DOUBLE * w / (max_pixels * t)) / factor) * factor) WHEN t * tps * h3 * w3 < min_pixels * t THEN ceil(h * sqrt(min_pixels * t / (t * tps * h::DOUBLE * w)) / factor) * factor ELSE h3 END::BIGINT AS dh,
  CASE WHEN t * tps * h3 * w3 > max_pixels * t THEN greatest(factor, floor(w / sqrt(t * tps * h::DOUBLE * w / (max_pixels * t)) / factor) * factor) WHEN t * tps * h3 * w3 < min_pixels * t THEN ceil(w * sqrt(min_pixels * t / (t * tps * h::DOUBLE * w)) / factor) * factor ELSE w3 END::BIGINT AS dw FROM g)
SELECT id, family, (CASE WHEN clamp = '3d' THEN t * (dh // factor) * (dw // factor) ELSE t * (hb // factor) * (wb // factor) END)::BIGINT AS tokens, t::BIGINT AS groups FROM deep""",
    "budget_solvers": f"WITH {SIZES} SELECT id, 200000 // ((hb // factor) * (wb // factor)) * tps * tmerge AS frames, (20000 // ((n + tps - 1) // tps)) * factor * factor AS pixels FROM (SELECT *, {smart('h', 'w')} FROM sizes)",
    "dual_stream_tokens": f"""WITH {SIZES}, lo AS (SELECT *, ((n + tps - 1) // tps) * {CELLS('0.25')} AS lo, ((16 + tps - 1) // tps) * {CELLS('1.0')} AS reference FROM sizes), {TOPS.format('greatest(1, floor((reference - lo) / 8.0::DOUBLE)::BIGINT)', 'lo')}, {FIT}
SELECT id, lo, 8 * (fit_h // factor) * (fit_w // factor) AS hi, lo + 8 * (fit_h // factor) * (fit_w // factor) AS tokens, round(sqrt(fit_h * fit_w / (h * w)::DOUBLE), 4) AS hi_scale FROM fitted""",
    "encode_accounting": f"""WITH {SIZES}, x AS (SELECT *, {side('h', 'r')} AS rh, {side('w', 'r')} AS rw, (n + tps - 1) // tps AS t FROM sizes) SELECT id, t * tps AS frames, t * (rh // factor) * (rw // factor) AS tokens, t * (rh // patch) * (rw // patch) AS patches, least(rh * rw, min_pixels) AS shortest, greatest(rh * rw, max_pixels) * t AS longest FROM x""",
    "softmax_guard": f"WITH {SIZES} SELECT id, 16 * (h * 11) * (h * 11) * 4 <= 8589934592 AS fits FROM sizes",
    "topk_frames": f"WITH {VECTORS} SELECT sample, idx FROM vectors QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, idx) <= 8",
    "topk_events": f"WITH {TIMELINE} SELECT sample, idx FROM timeline QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, idx) <= 5",
    "aks_frames": AKS,
    "semdiv_quality": f"WITH {TIMELINE} SELECT sample, idx, round(CASE WHEN hi > lo THEN pow((score - lo) / (hi - lo), 5) ELSE 1.0::DOUBLE END, 6) AS quality FROM (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM timeline WINDOW p AS (PARTITION BY sample))",
    "keep_counts": f"WITH {SIZES}, x AS (SELECT *, CASE WHEN id % 4 = 0 THEN id % 60 END AS b, ((1 + id % 20) / 20.0::DOUBLE) AS q FROM sizes) SELECT id, least(greatest(coalesce(b, ceil(n * q)::BIGINT), 1), n) AS up, least(greatest(coalesce(b, round_even(n * q, 0)::BIGINT), 1), n) AS even FROM x",
    "random_keep_native": f"WITH {TIMELINE} SELECT sample, idx AS tok FROM (SELECT *, count(*) OVER (PARTITION BY sample) AS n, row_number() OVER (PARTITION BY sample ORDER BY sha256(sample || '-' || idx), idx) AS r FROM timeline) WHERE r <= greatest(1, ceil(n * 0.25::DOUBLE))",
    "query_seed": "SELECT conv_id, turn, ('0x' || substr(sha256('0:' || text), 1, 16))::UBIGINT::VARCHAR AS seed FROM conversations",
    "keywords": f"""WITH t AS (SELECT doc_id, replace(replace('Question: ' || text || {_CANNED[0]}, {_CANNED[0]}, ''), {_CANNED[1]}, '') AS t FROM documents),
k AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains([{_STOP}], lower(w))) AS ws FROM t) SELECT doc_id, CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') ELSE t END AS keywords FROM k""",
    "coverage_matrix": f"""WITH {VECTORS}, s AS (SELECT a.sample, a.idx AS word_idx, b.idx AS tok, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))) / 0.2::DOUBLE AS s FROM vectors a JOIN vectors b USING (sample) WHERE a.idx < 3),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample, word_idx)) AS e FROM s), m AS (SELECT sample, count(DISTINCT word_idx) AS m FROM s GROUP BY sample),
p AS (SELECT sample, word_idx, tok, e / sum(e) OVER (PARTITION BY sample, word_idx) / m AS p FROM e JOIN m USING (sample))
SELECT sample, word_idx, arg_max(tok, (round(p, 9), -tok)) AS best, round(sum(p), 6) AS total FROM p GROUP BY 1, 2""",
    "visionzip_plan": f"WITH {VECTORS}, {PLAN_ZIP.format(ratio='0.5', alpha='0.7')} SELECT sample, tok, role, target FROM plan",
    "visionzip_merge": f"""WITH {VECTORS}, {PLAN_ZIP.format(ratio='0.25', alpha='0.928571')}, sums AS (SELECT p.sample, p.target, p.role, list_sum(v.e) AS x FROM plan p JOIN vectors v ON v.sample = p.sample AND v.idx = p.tok)
SELECT sample, target AS tok, round(sum(x) FILTER (role <> 'merged') + coalesce(avg(x) FILTER (role = 'merged'), 0), 4) AS total FROM sums GROUP BY 1, 2""",
    "segment_lengths": f"""WITH {VECTORS}, u AS (SELECT sample, idx, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))))) AS u FROM v0), l AS (SELECT sample, idx, u, lag(u) OVER (PARTITION BY sample ORDER BY idx) AS p FROM u),
s AS (SELECT sample, idx, list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * p[i])) AS s FROM l), c AS (SELECT *, coalesce(s < -0.2, FALSE) AS cut FROM s),
m AS (SELECT *, 11 - sum(cut::INT) OVER (PARTITION BY sample) AS more, row_number() OVER (PARTITION BY sample ORDER BY CASE WHEN s IS NULL THEN 2.0 WHEN cut THEN 1.0 ELSE s END, idx) AS low FROM c),
g AS (SELECT sample, idx, sum((cut OR (low <= more AND s IS NOT NULL))::INT) OVER (PARTITION BY sample ORDER BY idx)::BIGINT AS segment FROM m) SELECT sample, segment, count(*) AS length FROM g GROUP BY 1, 2""",
    "sequence_subselect": f"""WITH {TIMELINE}, k AS (SELECT *, CASE WHEN idx = 0 OR idx = n - 1 THEN 'marker' WHEN idx % 4 = 0 THEN 'text' ELSE 'visual' END AS kind FROM (SELECT *, count(*) OVER (PARTITION BY sample) AS n FROM timeline)),
r AS (SELECT *, row_number() OVER (PARTITION BY sample, kind ORDER BY score DESC, idx) AS r FROM k) SELECT sample, idx AS pos, kind, round(CASE WHEN kind = 'visual' THEN score * 2 ELSE score END, 6) AS value FROM r WHERE kind = 'text' OR (kind = 'visual' AND r <= 6)""",
    "thinking_split": f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'hm</think> ' || text || '</think> x ' ELSE text END AS t, conv_id % 2 = 0 AND turn % 3 = 0 AS thinks FROM conversations),
a AS (SELECT *, CASE WHEN thinks THEN {STRIP.format("substr(t, instr(t, '</think>') + 8)")} ELSE t END AS answer FROM t), w AS (SELECT *, len(list_filter(regexp_split_to_array(answer, '[\\s\\p{{Z}}]+'), lambda x: x <> '')) AS w FROM a)
SELECT conv_id, turn, answer, CASE WHEN thinks THEN w ELSE 9 END::BIGINT AS decode_tokens, CASE WHEN thinks THEN greatest(0, 9 - w) ELSE 0 END::BIGINT AS thinking_tokens FROM w""",
    "prefill_accounting": f"WITH {SIZES}, x AS (SELECT id, n * 64 AS pre, least(greatest(round_even(n * 64 * r, 0)::BIGINT, 1), n * 64) AS post FROM sizes) SELECT id, CASE WHEN post >= pre THEN pre ELSE post END AS llm_visual_tokens, CASE WHEN post >= pre THEN pre + 40 ELSE greatest(1, pre + 40 - (pre - post) - 2) END AS prefill_tokens FROM x",
    "lohi_content": f"SELECT conv_id, turn, 'video=|text={text.CUE[0]}3{text.CUE[1]}' || array_to_string(list_transform([conv_id / 4.0::DOUBLE, conv_id / 4.0::DOUBLE + turn, turn + 12.375::DOUBLE], lambda x: '|text=<' || printf('%.1f', x) || ' seconds>|image='), '') || '|text=' || text AS content FROM conversations",
    "model_family": f"SELECT id, CASE WHEN m LIKE '%2.5%' OR m LIKE '%2\\_5%' ESCAPE '\\' THEN 'qwen2_5_vl' WHEN m LIKE '%3.5%' OR m LIKE '%3\\_5%' ESCAPE '\\' THEN 'qwen3_5' ELSE 'qwen3_vl' END AS family FROM (SELECT p_partkey::BIGINT AS id, lower({_MODELS}[p_partkey % 7 + 1]) AS m FROM part)",
    "catalog_methods": f"WITH m(method, selector, pruner, signal) AS (VALUES {_METHODS}), s(setup, frame_count, hi) AS (VALUES {_SETUPS}) SELECT method, setup, selector, pruner, signal, frame_count::BIGINT AS frame_count, NOT starts_with(selector, 'lohi') OR hi IS NOT NULL AS valid FROM m, s",
    "prepare_qa": f"WITH {RELEASED}, {SUBS} SELECT r.video_id, question_id, url || '|' || 'b.' || page_id || '|no prefix|D. x' AS options, 'B' AS answer, domain, subtitle_path FROM released r LEFT JOIN subs USING (video_id)",
    "prepare_counts": f"WITH {RELEASED}, {SUBS} SELECT count(*) AS questions, count(DISTINCT r.video_id) AS videos, count(subtitle_path) AS with_subtitles FROM released r LEFT JOIN subs USING (video_id)",
    "video_paths": """WITH f AS (SELECT (page_id % 40)::VARCHAR AS stem, ['mp4', 'mkv', 'webm'][page_id % 7 % 3 + 1] AS e, page_id FROM pages), p AS (SELECT stem, CASE e WHEN 'mp4' THEN 1 WHEN 'mkv' THEN 2 ELSE 3 END AS r, min('/v/' || page_id || '/' || stem || '.' || e) AS path FROM f GROUP BY 1, 2),
b AS (SELECT stem, arg_min(path, r) AS path FROM p GROUP BY stem) SELECT v.video_id, b.path AS video_path FROM (SELECT DISTINCT (page_id % 60)::VARCHAR AS video_id FROM pages) v LEFT JOIN b ON b.stem = v.video_id""",
    "merge_shards": f"WITH {RESULTS} SELECT count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(setup), 4) AS mean_prefill_tokens, 0.0::DOUBLE AS mean_wall_seconds FROM results",
    "merge_rows": f"WITH {RESULTS}, {SHARDS} SELECT key::VARCHAR AS key, shard::BIGINT AS shard, status FROM shards QUALIFY row_number() OVER (PARTITION BY key ORDER BY shard) = 1",
    "merge_conflicts": f"WITH {RESULTS}, {SHARDS}, o AS (SELECT key, CASE WHEN shard = 1 AND key % 9 = 0 THEN -1 ELSE prefill_tokens END AS p FROM shards) SELECT key::VARCHAR AS key, count(*) AS n_rows, count(DISTINCT p) AS n_different FROM o GROUP BY key HAVING count(DISTINCT p) > 1",
    "merge_meta_check": f"""WITH {RESULTS}, r AS (SELECT setup, max(method) AS method FROM results GROUP BY setup), v AS (SELECT count(DISTINCT method) AS m, count(DISTINCT setup) AS s FROM r),
k(meta_key) AS (VALUES ('model'), ('method'), ('task'), ('setup'), ('thinking'), ('budget'), ('presentation')) SELECT meta_key, CASE meta_key WHEN 'method' THEN m WHEN 'setup' THEN s ELSE 1 END AS n_values, CASE meta_key WHEN 'method' THEN m WHEN 'setup' THEN s ELSE 1 END <= 1 AS agrees FROM k, v""",
}

ORACLE |= KERNELS
