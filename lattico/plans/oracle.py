"""The registered queries in DuckDB's SQL. Decimal literals are cast, sums rounded, and look-behinds rewritten as replacements."""

from __future__ import annotations


def u(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def share(x: str) -> str:
    return f"({u(x)} % 10001)::DOUBLE / 10000"


NORM = r"trim(regexp_replace(lower({0}), '[\s\p{{Z}}]+', ' ', 'g'))"


def norm(x: str) -> str:
    return NORM.format(x)


def frags(x: str) -> str:
    cut = rf"regexp_replace({x}, '([.;])[\s]', E'\\1\n', 'g')"
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array({cut}, '[\\n。！？!?]'), lambda s: {norm('s')}), lambda s: length(s) >= 60))"


#: Metrics of rows m(keys..., ok, k, conf, brier, kl, h): what compute() makes of row_terms().
def metrics(keys: str, rows: str) -> str:
    g = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""
, b AS (SELECT {g} least(floor(conf * 15), 14) AS bin, count(*) AS n, sum(ok) AS ok, sum(1.0::DOUBLE / k) AS c, sum(conf) AS conf, sum(brier) AS br, sum(kl) AS kl, sum(h) AS h FROM {rows} GROUP BY {g} bin)
SELECT {g} sum(n)::BIGINT AS n, round(sum(ok) / sum(n), 6) AS accuracy,
  round(greatest(0, (sum(ok) / sum(n) - sum(c) / sum(n)) / (1 - sum(c) / sum(n))), 6) AS chance_acc, round(sum(br) / sum(n), 6) AS brier, round(sum(kl) / sum(n), 6) AS kl,
  round(sum(abs(conf - ok)) / sum(n), 6) AS ece, round(sum(h) / sum(n), 6) AS mean_confidence
FROM b {by}"""


def terms(p: str = "p", t: str = "t", k: str = "len(t)") -> str:
    """k, ok, conf, brier, kl and h of probabilities p and target t."""
    return f"""{k} AS k, (list_position({p}, list_max({p})) = list_position({t}, list_max({t})))::INT::DOUBLE AS ok, list_max({p}) AS conf,
  list_sum(list_transform(list_zip({p}, {t}), lambda z: (z[1] - z[2]) ** 2)) / len({t}) AS brier,
  list_sum(list_transform(list_zip({p}, {t}), lambda z: CASE WHEN z[2] > 0 THEN z[2] * (ln(z[2] + 1e-12::DOUBLE) - ln(z[1] + 1e-12::DOUBLE)) ELSE 0::DOUBLE END)) AS kl,
  greatest(0::DOUBLE, 1 + list_sum(list_transform({p}, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0::DOUBLE END)) / ln(len({p}))) AS h"""


QUALITY = f"""q AS (SELECT doc_id, quality, {share("'q/' || doc_id")} AS p0 FROM labels),
r AS (SELECT doc_id, [p0, 1 - p0] AS p, CASE WHEN quality = 1 THEN [1::DOUBLE, 0::DOUBLE] ELSE [0::DOUBLE, 1::DOUBLE] END AS t FROM q)"""
L4 = "['de', 'en', 'es', 'fr']"


def languages(run: str, name: str) -> str:
    w = f"list_transform({L4}, lambda x: {share(f"'{run}/' || doc_id || '/' || x")} + 0.0001::DOUBLE)"
    return f"""{name}0 AS (SELECT doc_id, lang, source, text, {w} AS w FROM documents),
{name} AS (SELECT doc_id, lang, source, text, list_transform(w, lambda x: x / list_sum(w)) AS p, list_transform({L4}, lambda x: (x = lang)::INT::DOUBLE) AS t FROM {name}0)"""


def guard(shown: str, key: str, least: int, name: str = "") -> str:
    """A guard of ratio 1.8, limit 480 and window 50 as a recursion along each key's events: the state is the last accepted values."""
    extra = f", r.k AS {name}" if name else ""
    first = shown.split(" AS ")[-1]
    return f"""WITH RECURSIVE e AS (SELECT {shown}, event_id, value, {key} AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM e),
f(k, n, recent, event_id, skip) AS (SELECT k, 0::BIGINT, []::DOUBLE[], NULL::BIGINT, NULL::BOOLEAN FROM r WHERE n = 1
  UNION ALL SELECT r.k, r.n, CASE WHEN s THEN recent ELSE list_append(recent, value)[-50:] END, r.event_id, s
  FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1, LATERAL (SELECT value > 480 OR (len(recent) >= {least} AND value > 1.8::DOUBLE * list_median(recent)) AS s))
SELECT {first}, r.event_id, value{extra}, skip FROM r JOIN f ON f.k = r.k AND f.event_id = r.event_id"""


PRIORITY = "['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']"
ORDERS5 = f"""o AS (SELECT o_orderkey::VARCHAR AS id, c_mktsegment AS instructions, list_transform({PRIORITY}, lambda x: (x = o_orderpriority)::INT::DOUBLE) AS t FROM orders JOIN customer ON o_custkey = c_custkey)"""
_DOC = "text || chr(0) || lang"

SQL: dict[str, str] = {
    "metrics_quality_noul": f"WITH {QUALITY}, m AS (SELECT {terms()} FROM r) {metrics('', 'm')}",
    "metrics_breakdown": f"""WITH {languages('l', 'v')}, m0 AS (SELECT lang, source, {terms()} FROM v),
m AS (SELECT 'overall' AS section, '' AS grp, * FROM m0 UNION ALL SELECT 'lang', lang, * FROM m0 UNION ALL SELECT 'source', source, * FROM m0) {metrics('section, grp', 'm')}""",
    "decision_counts": """SELECT CASE grouping(source, lang) WHEN 3 THEN 'overall' WHEN 1 THEN 'source' ELSE 'lang' END AS section, coalesce(source, lang, '') AS grp, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""",
    "prior_predictor": f"""WITH {ORDERS5}, s AS (SELECT *, {u("'split/' || id")} % 2 AS half FROM o),
f AS (SELECT instructions, generate_subscripts(t, 1) AS i, unnest(t) AS x FROM s WHERE half = 0), g AS (SELECT instructions, i, sum(x) AS mass FROM f GROUP BY ALL),
a AS (SELECT instructions, list(mass + 1 ORDER BY i) AS w FROM g GROUP BY instructions),
v AS (SELECT s.instructions, list_transform(w, lambda x: x / list_sum(w)) AS p, t FROM s JOIN a USING (instructions) WHERE half = 1),
m AS (SELECT instructions, {terms()} FROM v) {metrics('instructions', 'm')}""",
    "flip_rate": f"""WITH {languages('a', 'a')}, {languages('b', 'b')}
SELECT round(avg((list_position(a.p, list_max(a.p)) <> list_position(b.p, list_max(b.p)))::INT), 6) AS flip_rate FROM a JOIN b USING (doc_id)""",
    "agreement_report": f"""WITH q AS (SELECT doc_id, quality, {share("'q/' || doc_id")} AS a, {share("'r/' || doc_id")} AS b FROM labels),
j AS (SELECT *, ((a >= 1 - a) = (b >= 1 - b))::INT::DOUBLE AS same, abs(a - (1 - a)) >= 0.02::DOUBLE AS clear, abs(a - b) AS d, abs((1 - a) - (1 - b)) AS e, quality = 1 AS g FROM q)
SELECT count(*) AS n, round(avg(same), 6) AS agree, round(avg(same) FILTER (clear), 6) AS agree_clear, count(*) FILTER (NOT clear AND same = 0) AS tie_flips, round(max(greatest(d, e)), 6) AS max_diff,
  round(sum(d + e) / (2 * count(*)), 6) AS mean_diff, round(avg(((a >= 1 - a) = g)::INT), 6) AS accuracy_first, round(avg(((b >= 1 - b) = g)::INT), 6) AS accuracy_second,
  avg(same) FILTER (clear) >= 0.99 AND max(greatest(d, e)) <= 0.05 AS pass FROM j""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, share::DOUBLE AS share, value FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) s(share) WHERE r = least(n - 1, floor(share * n))""",
    "quantile_edges": """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, share::DOUBLE AS share, n_chars FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) s(share) WHERE r = least(n - 1, floor(share * n))""",
    "invalid_decisions": """SELECT CASE doc_id % 7 WHEN 0 THEN 'type' WHEN 1 THEN 'noul options' WHEN 2 THEN 'choice size' WHEN 3 THEN 'duplicate options' WHEN 4 THEN 'target size'
  WHEN 5 THEN 'target not a distribution' ELSE 'valid' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
    "decontam_flags": f"""WITH ix AS (SELECT DISTINCT 'full' AS kind, {norm('text')} AS x FROM benchmark WHERE length({norm('text')}) >= 20 UNION SELECT 'frag', unnest({frags('text')}) FROM benchmark),
t AS (SELECT doc_id, 'full' AS kind, {norm('text')} AS x FROM documents UNION ALL SELECT doc_id, 'frag', unnest({frags('text')}) FROM documents),
j AS (SELECT doc_id, t.kind, ix.x IS NOT NULL AS hit FROM t LEFT JOIN ix ON t.kind = ix.kind AND t.x = ix.x)
SELECT doc_id, count(*) FILTER (kind = 'frag') AS n_frags, count(*) FILTER (kind = 'frag' AND hit) AS hits, bool_or(kind = 'full' AND hit) AS full_hit, bool_or(kind = 'frag' AND hit) AS strict_hit,
  bool_or(hit) AS contaminated FROM j GROUP BY doc_id""",
    "overlap_report": f"""WITH e AS (SELECT lang AS eval, doc_id AS id, text FROM documents WHERE lang <> 'en' UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
t AS (SELECT source, text FROM documents WHERE lang = 'en'), ef AS (SELECT DISTINCT eval, id, unnest({frags('text')}) AS x FROM e), tf AS (SELECT DISTINCT source, unnest({frags('text')}) AS x FROM t),
tn AS (SELECT DISTINCT {norm('text')} AS x FROM t WHERE length({norm('text')}) >= 20),
f AS (SELECT eval, count(DISTINCT id) AS full_rows FROM e WHERE {norm('text')} IN (SELECT x FROM tn) GROUP BY eval), g AS (SELECT eval, count(DISTINCT id) AS frag_rows FROM ef WHERE x IN (SELECT x FROM tf) GROUP BY eval),
h AS (SELECT eval, source, count(*) AS hits FROM ef JOIN tf USING (x) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY eval ORDER BY hits DESC, source) AS place FROM h)
SELECT a.eval, coalesce(full_rows, 0) AS full_rows, coalesce(frag_rows, 0) AS frag_rows, source, hits, place::INT AS place
FROM (SELECT DISTINCT eval FROM e) a LEFT JOIN f USING (eval) LEFT JOIN g USING (eval) LEFT JOIN (SELECT * FROM p WHERE place <= 4) p USING (eval)""",
    "seen_fragments": f"""WITH k AS (SELECT DISTINCT unnest({frags('text')}) AS x FROM documents WHERE doc_id % 5 <> 0), f AS (SELECT doc_id, unnest({frags('text')}) AS x FROM documents WHERE doc_id % 5 = 0),
s AS (SELECT DISTINCT doc_id FROM f WHERE x IN (SELECT x FROM k)) SELECT source, count(*) AS n, count(s.doc_id) AS seen FROM documents d LEFT JOIN s USING (doc_id) WHERE d.doc_id % 5 = 0 GROUP BY source""",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id, sha1({_DOC}) AS key FROM documents GROUP BY 2",
    "content_dedup": f"WITH k AS (SELECT count(*) AS c FROM documents GROUP BY sha1({_DOC} || chr(0) || source)) SELECT count(*) FILTER (c > 1) AS groups, sum(c - 1)::BIGINT AS surplus FROM k",
    "near_dup_prefix": f"SELECT md5(substr({norm('text')}, 1, 300)) AS prefix_key, count(*) AS n FROM documents WHERE length({norm('text')}) >= 80 GROUP BY 1 HAVING count(*) > 1",
    "label_conflicts": f"SELECT sha1({_DOC} || chr(0) || source) AS key, count(DISTINCT quality) AS answers, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1",
    "prefix_conflicts": f"SELECT md5(substr({norm('text')}, 1, 40)) AS key, count(DISTINCT quality) AS answers, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1",
    "largest_groups": """WITH b AS (SELECT md5(text) AS key, source, count(*) AS c FROM documents GROUP BY ALL), g AS (SELECT key, sum(c)::BIGINT AS n FROM b GROUP BY key),
s AS (SELECT key, source FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, source) = 1) SELECT key, n, source FROM g JOIN s USING (key) ORDER BY n DESC, key LIMIT 8""",
    "leak_filter": f"""WITH h AS (SELECT DISTINCT sha1(text) AS s FROM documents WHERE doc_id % 4 = 0 AND text <> ''), t AS (SELECT doc_id, sha1({_DOC}) AS k, sha1(text) IN (SELECT s FROM h) AS leaked FROM documents WHERE doc_id % 4 <> 0),
o AS (SELECT CASE WHEN leaked THEN 'leaked' WHEN row_number() OVER (PARTITION BY leaked, k ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END AS outcome FROM t) SELECT outcome, count(*) AS n FROM o GROUP BY 1""",
    "leak_free": "SELECT source, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 4 = 0 AND text <> '') GROUP BY source",
    "pool_without_seen": f"SELECT lang, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 AND sha1({_DOC} || chr(0) || source) NOT IN (SELECT sha1({_DOC} || chr(0) || source) FROM documents WHERE doc_id % 4 = 0) GROUP BY lang",
    "group_holdout_sha1": """SELECT conv_id, turn, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 10), lambda i: ('0x' || substr(sha1(conv_id::VARCHAR), (1 + 4 * i)::INT, 4))::BIGINT)), lambda a, c: (a * 65536 + c) % 10000) < 1500 AS held FROM conversations""",
    "holdout_rows": "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('12345/' || doc_id), doc_id) <= floor(count(*) OVER () * 0.15::DOUBLE)",
    "holdout_groups": "WITH g AS (SELECT DISTINCT conv_id FROM conversations), p AS (SELECT conv_id FROM g QUALIFY row_number() OVER (ORDER BY md5('g/' || conv_id), conv_id) <= floor(count(*) OVER () * 0.2::DOUBLE)) SELECT conv_id, turn FROM conversations JOIN p USING (conv_id)",
    "capped_per_source": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('cap/' || doc_id), doc_id) <= 20",
    "quota_sample": """SELECT doc_id, source FROM documents QUALIFY source = 'src0' OR row_number() OVER (PARTITION BY source ORDER BY md5('quota/' || doc_id), doc_id) <= CASE source WHEN 'src1' THEN 15 WHEN 'src2' THEN 2 ELSE 5 END""",
    "head_tail_split": """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('split/' || doc_id), doc_id) AS p FROM documents)
SELECT doc_id, source, CASE WHEN p <= 3 THEN 'val' WHEN p <= 6 THEN 'test' ELSE 'train' END AS part FROM r""",
    "replay_mix": """WITH c AS (SELECT doc_id, source FROM documents WHERE source = 'src3'), o AS (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, source, 'chosen' AS origin FROM c UNION ALL (SELECT doc_id, source, 'replay' FROM o QUALIFY row_number() OVER (ORDER BY md5('replay/' || doc_id), doc_id) <= 2 * (SELECT count(*) FROM c))""",
    "upweight": "SELECT toxic, copy, count(*) AS n FROM (SELECT toxic, false AS copy FROM labels UNION ALL SELECT toxic, true FROM labels, range(2) WHERE toxic = 1) GROUP BY ALL",
    "balanced_families": """WITH l AS (SELECT lang, count(DISTINCT source) AS k FROM documents GROUP BY lang), r AS (SELECT d.lang, source, row_number() OVER (PARTITION BY d.lang, source ORDER BY doc_id) AS n, k FROM documents d JOIN l ON d.lang = l.lang)
SELECT lang, source, count(*) AS n FROM r WHERE n <= 100 // k + 1 GROUP BY ALL""",
    "audit_by_source": r"""WITH d AS (SELECT source, lang, length(text) AS l, len(regexp_extract_all(text, '[一-鿿]')) AS cjk FROM documents),
a AS (SELECT source, lang, count(*) AS c FROM d GROUP BY ALL), t AS (SELECT source, first(lang ORDER BY c DESC, lang) AS lang, max(c) AS c, count(*) AS k FROM a GROUP BY source),
m AS (SELECT source, l AS median_length FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY l) = count(*) OVER (PARTITION BY source) // 2 + 1),
s AS (SELECT source, count(*) AS n, sum(cjk) / greatest(1, sum(l)) AS cjk, max(l) AS max_length, avg((l = 0)::INT) AS empty_share FROM d GROUP BY source)
SELECT source, n, 0::BIGINT AS bad, NULL::DOUBLE AS yes_rate, 0::DOUBLE AS soft_share, round(cjk, 6) AS cjk, max_length::INT AS max_length, round(empty_share, 6) AS empty_share, t.lang AS top_answer, k AS n_answers, t.lang AS lang, median_length::INT AS median_length,
  round(t.c / n, 6) AS top_share, concat_ws(';', CASE WHEN t.c / n > 0.6 AND k > 1 THEN 'one answer dominates' END, CASE WHEN t.lang = 'en' AND cjk > 0.2 THEN 'language' END, CASE WHEN empty_share > 0.5 THEN 'empty states' END) AS flags
FROM s JOIN t USING (source) JOIN m USING (source)""",
    "conversation_state": """WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
e AS (SELECT c.conv_id, c.turn, role || ':' || CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 28) || '…' || right(text, 11) END AS x FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn < l.turn
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) <= 4),
g AS (SELECT conv_id, string_agg(x, '|' ORDER BY turn) AS x FROM e GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 70) || ' …[' || (length(text) - 100) || ' chars omitted]… ' || right(text, 30) END AS request, coalesce(g.x, '') AS earlier
FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn LEFT JOIN g ON g.conv_id = c.conv_id""",
    "soft_votes": "SELECT o_custkey, " + ", ".join(f"round(count(*) FILTER (o_orderpriority[1] = '{i}') / count(*), 6) AS p{i}" for i in range(1, 6)) + " FROM orders GROUP BY o_custkey",
    "interp_target": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(greatest(0::DOUBLE, 1 - abs({i} - least(greatest(l_quantity / 10, 0), 5))), 6) AS t{i}" for i in range(6)) + " FROM lineitem",
    "ordinal_smoothing": f"""WITH {ORDERS5}, g AS (SELECT list_position(t, 1::DOUBLE) AS g FROM o)
SELECT {", ".join(f"CASE WHEN g = {i + 1} THEN 0.8::DOUBLE WHEN abs(g - {i + 1}) = 1 THEN CASE WHEN g IN (1, 5) THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END ELSE 0::DOUBLE END AS t{i}" for i in range(5))}, count(*) AS n FROM g GROUP BY g""",
    "distribution_losses": f"""WITH {ORDERS5}, w AS (SELECT *, list_transform(range(0, 5), lambda i: {share("'s/' || id || '/' || i")} + 0.0001::DOUBLE) AS w FROM o), v AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p, list_transform(t, lambda x: 0.9::DOUBLE * x + 0.02::DOUBLE) AS ts FROM w),
m AS (SELECT instructions, p, t, ts, {terms()} FROM v)
SELECT instructions, round(avg(list_sum(list_transform(range(1, 6), lambda i: (list_sum(p[1:i]) - list_sum(t[1:i])) ** 2)) / 4), 6) AS rps, round(avg(kl), 6) AS kl,
  round(avg(list_sum(list_transform(list_zip(p, ts), lambda z: 0.5::DOUBLE * (z[1] - z[2]) * (ln(z[1]) - ln(z[2]))))), 6) AS sym_kl, round(avg(brier), 6) AS brier, round(avg(h), 6) AS confidence FROM m GROUP BY instructions""",
    "softmax_temperature": """WITH l AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE * 5 / CASE WHEN label % 2 = 0 THEN 0.5::DOUBLE ELSE 2 END) AS x FROM embeddings)
SELECT vec_id, round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS top, (list_position(x, list_max(x)) - 1)::INT AS choice FROM l""",
    "nll_grid": """WITH l AS (SELECT label, label % 2 AS type, t::DOUBLE AS t, list_transform(embedding[1:10], lambda x: x::DOUBLE * 5 / t) AS x FROM embeddings, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1::DOUBLE), (2::DOUBLE), (4::DOUBLE)) g(t))
SELECT type, t, round(avg(ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[label + 1]), 6) AS nll FROM l GROUP BY ALL""",
    "knockout_wide": f"""WITH o AS (SELECT id, pos, pos // 20 AS g, 8 * {share("'a/' || id || '/' || pos")} AS x, 8 * {share("'b/' || id || '/' || pos")} AS y
  FROM (SELECT c_custkey::VARCHAR AS id, unnest(range(0, 40)) AS pos FROM customer)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, g ORDER BY x DESC, pos) <= 2 AS f, x - ln(sum(exp(x)) OVER (PARTITION BY id, g)) AS lp FROM o)
SELECT id, pos, g, round(ln(sum(CASE WHEN f THEN exp(y) ELSE 0 END) OVER (PARTITION BY id, g) / sum(CASE WHEN f THEN exp(y) ELSE 0 END) OVER (PARTITION BY id)) + lp, 6) AS log_p FROM r""",
    "merged_forms": "SELECT user_id AS id, event_type AS label, round(max(value / 100) + ln(sum(exp(value / 100 - m))), 6) AS logit FROM (SELECT *, max(value / 100) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY ALL",
    "invoice_match": """WITH l AS (SELECT l_orderkey AS i, l_quantity <= CASE WHEN l_returnflag = 'R' THEN l_quantity - 1 ELSE l_quantity END AS q, l_extendedprice / l_quantity <= p_retailprice * 1.05::DOUBLE + 1e-9::DOUBLE AS p FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT i, bool_and(q) AS q, bool_and(p) AS p FROM l GROUP BY i)
SELECT CASE WHEN i IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0) THEN 'reject_duplicate' WHEN NOT q THEN 'hold_quantity' WHEN NOT p THEN 'hold_price' ELSE 'approve' END AS action, count(*) AS n FROM b GROUP BY 1""",
    "approval_routing": """WITH o AS (SELECT o_totalprice AS x, o_custkey % 4 AS l, CASE WHEN c_mktsegment = 'BUILDING' THEN [50000, 150000, 300000] ELSE [20000, 100000, 400000] END AS th,
  c_mktsegment = 'FURNITURE' AND n_regionkey = 1 AND o_totalprice > 30000 AS h FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT ['manager', 'director', 'vp', 'cfo'][1 + least(3, greatest(CASE WHEN x <= th[1] THEN 0 WHEN x <= th[2] THEN 1 WHEN x <= th[3] THEN 2 ELSE 3 END, CASE WHEN h THEN 2 ELSE 0 END, l))] AS approver, count(*) AS n FROM o GROUP BY 1""",
    "contract_asof": """WITH t AS (SELECT o_orderkey AS id, o_orderkey AS k, o_orderdate::DATE AS s FROM orders),
x AS (SELECT id, k, s, (s + to_months((6 + k % 7)::INT))::DATE AS e0, (3 + k % 4)::INT AS rn, CASE WHEN k % 3 = 0 THEN s + (60 + k % 90)::INT END AS am, CASE WHEN k % 4 <> 0 THEN s + (30 + k % 400)::INT END AS nt, s + (100 + k % 500)::INT AS q FROM t),
y AS (SELECT *, CASE WHEN nt <= q THEN nt END AS g, list_transform(range(0, 12), lambda i: (e0 + to_months((rn * i)::INT))::DATE) AS ends FROM x),
z AS (SELECT *, list_filter(ends, lambda e: e > g) AS later, CASE WHEN am IS NOT NULL AND g >= am THEN 90 ELSE 30 END AS need FROM y),
w AS (SELECT *, CASE WHEN g IS NOT NULL THEN CASE WHEN later[1] - g >= need THEN later[1] ELSE later[2] END END AS ef FROM z)
SELECT id, ef::VARCHAR AS effective, CASE WHEN q >= ef THEN 'terminated' WHEN q < e0 THEN 'initial_term' ELSE 'renewal_term' END AS status, q >= e0 AND (ef IS NULL OR ef > e0) AS renewed FROM w""",
    "sla_business_hours": """WITH e AS (SELECT event_id, user_id % 2 AS pr, date_trunc('second', ts) AS a, date_trunc('second', ts) + to_hours((event_id % 97)::INT) AS b FROM events),
d AS (SELECT event_id, pr, a, b, unnest(generate_series(a::DATE, b::DATE, INTERVAL 1 DAY))::DATE AS d FROM e),
h AS (SELECT event_id, pr, sum(CASE WHEN isodow(d) < 6 AND d NOT IN (DATE '2024-01-03', DATE '2024-01-10') THEN greatest(0, epoch(least(b, d + INTERVAL 18 HOUR)) - epoch(greatest(a, d + INTERVAL 9 HOUR))) ELSE 0 END) / 3600 AS hours FROM d GROUP BY ALL)
SELECT event_id, round(hours, 6) AS hours, CASE WHEN hours <= l THEN 'met' WHEN hours - l <= 4 THEN 'breached_minor' ELSE 'breached_major' END AS status FROM (SELECT *, CASE WHEN pr = 1 THEN 8 ELSE 16 END AS l FROM h)""",
    "refund_rules": """WITH r AS (SELECT *, l_orderkey * 7 + l_linenumber AS k FROM lineitem)
SELECT CASE WHEN l_returnflag = 'R' AND k % 11 <= 7 THEN 'full_refund' WHEN l_discount >= 0.09::DOUBLE THEN 'no_refund' WHEN k % 60 > 30 + CASE WHEN k % 5 = 0 THEN 15 ELSE 0 END THEN 'no_refund'
  WHEN l_partkey % 3 = 0 AND l_linestatus = 'F' THEN 'partial_refund' ELSE 'full_refund' END AS outcome, count(*) AS n FROM r GROUP BY 1""",
    "leave_rules": """WITH c AS (SELECT c_custkey AS k, ['annual', 'sick', 'parental'][c_custkey % 3 + 1] AS kind, c_acctbal FROM customer)
SELECT kind, CASE kind WHEN 'annual' THEN CASE WHEN k % 800 < 90 THEN 'reject' WHEN floor(c_acctbal / 500) < k % 10 + 1 THEN 'reject' WHEN k % 30 < 14 THEN 'needs_manager' ELSE 'approve' END
  WHEN 'sick' THEN CASE WHEN k % 10 + 1 <= 3 OR k % 2 = 0 THEN 'approve' ELSE 'reject' END ELSE CASE WHEN k % 800 >= 365 THEN 'approve' ELSE 'reject' END END AS outcome, count(*) AS n FROM c GROUP BY ALL""",
    "triage_levels": """WITH c AS (SELECT c_custkey AS k FROM customer), v AS (SELECT k % 90 + 10 AS age, 85 + k % 16 AS spo2, 80 + k % 80 AS sbp, 36 + (k % 45) / 10 AS temp, k % 11 AS pain, k % 7 = 0 AS chest, k % 13 = 0 AS confused FROM c)
SELECT CASE WHEN spo2 < 90 OR sbp < 90 OR confused OR (chest AND age >= 40) THEN 1 WHEN (temp >= 39 AND age >= 75) OR pain >= 8 THEN 2 WHEN temp >= 38 OR pain >= 4 THEN 3 ELSE 4 END AS level, count(*) AS n FROM v GROUP BY 1""",
    "security_bursts": """WITH e AS (SELECT user_id % 50 AS "user", ts + to_microseconds(event_id) AS t, CASE WHEN event_type IN ('error', 'click') THEN 'fail' WHEN event_type = 'signup' THEN 'admin' ELSE 'success' END AS e, (event_id % 3)::VARCHAR AS c FROM events),
f AS (SELECT *, coalesce(sum((e = 'fail')::INT) OVER (PARTITION BY "user", c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
  e = 'success' AND EXISTS (SELECT 1 FROM e p WHERE p."user" = e."user" AND p.e = 'success' AND p.t BETWEEN e.t - INTERVAL 1 HOUR AND e.t AND p.c <> e.c) AS far FROM e),
h AS (SELECT *, e = 'success' AND ((c <> '0' AND n >= 5) OR far) AS hit FROM f), g AS (SELECT *, min(CASE WHEN hit THEN t END) OVER (PARTITION BY "user") AS first FROM h),
b AS (SELECT "user", bool_or(hit) AS compromised, coalesce(bool_or(e = 'admin' AND t >= first), false) AS raised, max(CASE WHEN c <> '0' AND e = 'fail' THEN n + 1 END) AS most FROM g GROUP BY "user")
SELECT "user", compromised, CASE WHEN compromised AND raised THEN 3 WHEN compromised THEN 2 WHEN coalesce(most, 0) >= 5 THEN 1 ELSE 0 END AS severity FROM b""",
    "last10_escalation": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations), m AS (SELECT * FROM f WHERE role = 'user' AND r > 1 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10),
g AS (SELECT conv_id, bool_or(length(text) % 17 = 0) AS legal, count(*) FILTER (length(text) % 3 = 0 AND length(text) % 17 <> 0) AS angry_n FROM m GROUP BY conv_id)
SELECT conv_id, legal, angry_n, CASE WHEN legal AND angry_n >= 1 THEN 3 WHEN legal OR angry_n >= 2 THEN 2 WHEN angry_n = 1 THEN 1 ELSE 0 END AS anger FROM g""",
    "fixed_count_steps": """WITH b AS (SELECT doc_id, n_chars, md5('plan/' || doc_id) AS h, (row_number() OVER (ORDER BY md5('plan/' || doc_id), doc_id) - 1) // 512 AS block FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_chars, h) - 1 AS pos FROM b) SELECT doc_id, block, pos // 32 AS step, pos % 32 AS slot FROM p""",
    "micro_batches": """WITH RECURSIVE b AS (SELECT doc_id, n_chars, md5('plan/' || doc_id) AS h, (row_number() OVER (ORDER BY md5('plan/' || doc_id), doc_id) - 1) // 512 AS block FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_chars, h) - 1 AS pos FROM b), s AS (SELECT doc_id, n_chars, block, pos, pos // 32 AS step, pos % 32 AS slot FROM p),
f(doc_id, n_chars, block, pos, step, slot, batch, n, longest) AS (SELECT doc_id, n_chars, block, pos, step, slot, 0::BIGINT, 1, n_chars FROM s WHERE slot = 0
  UNION ALL SELECT s.doc_id, s.n_chars, s.block, s.pos, s.step, s.slot, f.batch + c::INT, CASE WHEN c THEN 1 ELSE n + 1 END, CASE WHEN c THEN s.n_chars ELSE greatest(longest, s.n_chars) END
  FROM f JOIN s ON s.block = f.block AND s.step = f.step AND s.slot = f.slot + 1, LATERAL (SELECT (n + 1) * greatest(longest, s.n_chars) > 40000 OR n + 1 > 8 AS c))
SELECT doc_id, n_chars, block, pos, step, slot, batch FROM f""",
    "spike_guard": guard("event_type", "event_type", 20),
    "bucketed_guard": guard("user_id % 2000 AS length", "CASE WHEN user_id % 2000 >= 1500 THEN 2 WHEN user_id % 2000 >= 500 THEN 1 ELSE 0 END", 10, "bucket"),
    "request_answers_json": """SELECT event_id || q AS id, a AS answer FROM events, (VALUES ('/yes', '{"noul":0.5}'), ('/kind', '{"choice":"a","probabilities":{"a":0.5,"b":0.5},"confidence":0.0}'),
('/level', '{"score":1.0,"legend":["low","mid","high"],"probabilities":[0.3333,0.3333,0.3333],"confidence":0.0}')) v(q, a)""",
    "step_lengths": """WITH b AS (SELECT doc_id, n_chars, md5('plan/' || doc_id) AS h, (row_number() OVER (ORDER BY md5('plan/' || doc_id), doc_id) - 1) // 512 AS block FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n_chars, h) - 1 AS pos FROM b) SELECT block, pos // 32 AS step, count(*) AS n, round(avg(n_chars), 6) AS mean_length, max(n_chars) AS max_length, max(n_chars) * count(*) AS padded FROM p GROUP BY ALL""",
    "spike_windows": """WITH e AS (SELECT event_type AS run, event_id AS step, value, sum((value > 400)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS sk, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
l AS (SELECT run, step AS last, lag(step) OVER w AS first, sk > lag(sk) OVER w AS spike FROM e WHERE n % 10 = 0 WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT l.run, first, last, spike, count(*) AS n, round(max(value), 6) AS top FROM l JOIN e ON e.run = l.run AND e.step > first AND e.step <= last WHERE first IS NOT NULL GROUP BY ALL""",
    "spike_enrichment": """WITH e AS (SELECT event_type AS run, event_id AS step, user_id % 10 AS source, sum((value > 400)::INT) OVER (PARTITION BY event_type ORDER BY event_id) AS sk, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
l AS (SELECT run, step AS last, lag(step) OVER w AS first, sk > lag(sk) OVER w AS spike FROM e WHERE n % 3 = 0 WINDOW w AS (PARTITION BY run ORDER BY step)),
j AS (SELECT source, spike FROM l JOIN e ON e.run = l.run AND e.step > first AND e.step <= last WHERE first IS NOT NULL), c AS (SELECT source, count(*) FILTER (spike) AS a, count(*) FILTER (NOT spike) AS b FROM j GROUP BY source),
s AS (SELECT source, coalesce(a / nullif(sum(a) OVER (), 0), 0) AS spike_share, coalesce(b / nullif(sum(b) OVER (), 0), 0) AS normal_share FROM c) SELECT source, round(spike_share, 6) AS spike_share, round(normal_share, 6) AS normal_share, round(CASE WHEN normal_share = 0 THEN 'inf'::DOUBLE ELSE spike_share / normal_share END, 6) AS ratio FROM s WHERE spike_share >= 0.01""",
    "running_best": """SELECT event_type, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b""",
    "result_merge": """WITH e AS (SELECT user_id AS run_id, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE event_type END AS status, event_id AS seq FROM events)
SELECT run_id, status, seq FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY (status <> 'ok')::INT, CASE WHEN status = 'ok' THEN seq ELSE -seq END) = 1""",
    "request_to_answer": f"""WITH k AS (SELECT event_id, unnest(['yes', 'kind', 'level']) AS q FROM events),
n AS (SELECT event_id || '/' || q AS id, event_id, CASE q WHEN 'yes' THEN 'noul' WHEN 'kind' THEN 'choice' ELSE 'score' END AS type, CASE q WHEN 'yes' THEN ['true', 'false'] WHEN 'kind' THEN ['click', 'buy', 'view'] ELSE ['0', '1', '2'] END AS names, q FROM k),
w AS (SELECT *, list_transform(range(0, len(names)), lambda i: {share("'ans/' || id || '/' || i")} + 0.0001::DOUBLE) AS w FROM n), v AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p FROM w)
SELECT id, type, array_to_string(names, ',') AS names, CASE q WHEN 'yes' THEN '0.5,0.5' WHEN 'level' THEN '0.3333,0.3333,0.3333' ELSE CASE WHEN event_id % 2 = 0 THEN '0.0,0.25,0.75' ELSE '0.0,0.5,0.5' END END AS target,
  names[list_position(p, list_max(p))] AS best, round(greatest(0, 1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(len(p))), 4) AS confidence FROM v""",
    "prompt_texts": f"""WITH {ORDERS5}, m AS (SELECT id, 'You are a decision model. Read the state and answer the question by picking exactly one option.' || chr(10) || chr(10) || '### State' || chr(10) || id || chr(10) || chr(10) || '### Question' || chr(10) || instructions || chr(10)
  || 'Pick the level that best fits; levels are ordered from lowest to highest.' || chr(10) || chr(10) || '### Options' || chr(10) || array_to_string(list_transform(range(0, 5), lambda i: chr((65 + i)::INT) || '. ' || i || ': ' || {PRIORITY}[i + 1]), chr(10)) || chr(10) || chr(10)
  || 'Reply with the letter of the best option only.' AS x FROM o) SELECT id, md5(x) AS prompt_md5, length(x)::INT AS length FROM m""",
    "json_leaves": "SELECT event_id AS id, unnest(['x' || event_id, event_type]) AS leaf FROM events",
    "clipped_texts": r"""SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 140) || ' …[' || (length(text) - 200) || ' chars omitted]… ' || right(text, 60) END) AS marked,
  md5(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 140) || '…' || right(text, 59) END) AS plain, CASE WHEN length(text) > 0 AND len(regexp_extract_all(text, '[一-鿿]')) / length(text) > 0.1 THEN 'zh' ELSE 'en' END AS by_share,
  CASE WHEN regexp_matches(text, '[㐀-鿿぀-ヿ가-힯]') THEN 'zh' ELSE 'en' END AS by_any FROM documents""",
    "ticket_fanout": """SELECT 'tickets/' || o_orderkey || '/queue' AS id, 'choice' AS type, (o_orderstatus = 'O')::INT AS gold, 2 AS k FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION ALL SELECT 'tickets/' || o_orderkey || '/type', 'choice', o_orderpriority[1]::INT - 1, 5 FROM orders UNION ALL SELECT 'tickets/' || o_orderkey || '/priority', 'score', o_orderpriority[1]::INT - 1, 5 FROM orders""",
    "intent_candidates": f"""SELECT 'intents/' || p_partkey AS id, least((SELECT count(DISTINCT p_brand) FROM part), 4 + {u("'convert/n/' || p_partkey")} % 17)::INT AS k, p_brand AS gold, true AS "distinct" FROM part""",
    "nli_forms": f"""SELECT 'nli/' || conv_id || '-' || turn AS id, CASE WHEN c THEN 'noul' ELSE 'choice' END AS type, CASE WHEN c THEN (l <> 0)::INT ELSE l END::INT AS gold
FROM (SELECT conv_id, turn, length(text) % 4 AS l, {u("'convert/form/' || conv_id || '-' || turn")} / 4294967296 < 0.5 AS c FROM conversations) WHERE l < 3""",
    "full_label_sets": """WITH l AS (SELECT o_orderstatus AS s, o_orderpriority AS n, max(o_orderkey)::VARCHAR AS d FROM orders GROUP BY ALL), a AS (SELECT s, list(n ORDER BY n) AS ns, list(d ORDER BY n) AS ds FROM l GROUP BY s)
SELECT o_orderkey AS seq, array_to_string(ns, '|') AS names, array_to_string(ds, '|') AS descs, (list_position(ns, o_orderpriority) - 1)::INT AS gold FROM orders JOIN a ON o_orderstatus = s""",
}
