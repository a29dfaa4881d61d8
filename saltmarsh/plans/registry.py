"""All queries by name, with DuckDB SQL that gives the same rows, written from the rules and not from the plans."""

from __future__ import annotations

from saltmarsh.plans import queries as q

FLAGSHIP = "candidates"

_BARS = """
ordered AS (SELECT l_suppkey AS permno, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_shipdate, l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS q
            FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-07-01'),
weeks AS (SELECT permno, date, first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low,
                 last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, p) AS close, sum(q) AS volume FROM ordered GROUP BY permno, date),
lagged AS (SELECT *, lag(close) OVER (PARTITION BY permno ORDER BY date) AS prev FROM weeks),
bars AS (SELECT permno, date, open, high, low, close, volume, CASE WHEN prev > 0 THEN close / prev - 1 END AS ret, prev,
                CASE WHEN s_acctbal > 0 THEN s_acctbal END AS shrout FROM lagged LEFT JOIN supplier ON permno = s_suppkey),
market AS (SELECT date, avg(ret) AS mkt FROM bars GROUP BY date HAVING avg(ret) IS NOT NULL)"""

_VOL = """
ret_ranked AS (SELECT permno, ret, row_number() OVER (PARTITION BY permno ORDER BY date DESC) AS rn FROM bars WHERE ret IS NOT NULL),
vol AS (SELECT permno, stddev_samp(ret) FILTER (rn <= 10) / stddev_samp(ret) FILTER (rn <= 60) AS value FROM ret_ranked GROUP BY permno
        HAVING count(*) >= 15 AND stddev_samp(ret) FILTER (rn <= 60) > 0)"""

_ABN = """
dv_ranked AS (SELECT permno, close * volume AS dv, row_number() OVER (PARTITION BY permno ORDER BY date DESC) AS rn FROM bars WHERE close * volume IS NOT NULL),
abn AS (SELECT permno, (max(dv) FILTER (rn = 1) - avg(dv) FILTER (rn > 1)) / stddev_samp(dv) FILTER (rn > 1) AS value FROM dv_ranked GROUP BY permno
        HAVING count(*) >= 20 AND stddev_samp(dv) FILTER (rn > 1) > 0)"""

_DIS = """
mdates AS (SELECT date, mkt, row_number() OVER (ORDER BY date DESC) AS rn, count(*) OVER () AS n_dates FROM market),
dis AS (SELECT permno, abs(max(ret) FILTER (rn = 1) - sum(mkt * ret) / sum(mkt * mkt) * max(mkt) FILTER (rn = 1)) AS value
        FROM bars JOIN mdates USING (date) WHERE rn <= 60 AND n_dates >= 20 AND ret IS NOT NULL GROUP BY permno
        HAVING count(*) >= 20 AND sum(mkt * mkt) > 0 AND max(ret) FILTER (rn = 1) IS NOT NULL)"""

_GAP = """
gaps AS (SELECT permno, abs(open - prev) / prev AS value FROM bars WHERE open IS NOT NULL AND prev > 0
         QUALIFY row_number() OVER (PARTITION BY permno ORDER BY date DESC) = 1)"""


def _z(table: str) -> str:
    return f"(SELECT permno, (value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0) AS z FROM {table})"


_COMPOSITE = f"""
ids AS (SELECT DISTINCT permno FROM bars),
composite AS (SELECT permno, coalesce(v.z, 0) AS vol_spike, coalesce(a.z, 0) AS abn_volume, coalesce(d.z, 0) AS dislocation, coalesce(g.z, 0) AS gap,
                     coalesce(v.z, 0) + coalesce(a.z, 0) + coalesce(d.z, 0) + 0.5::DOUBLE * coalesce(g.z, 0) AS composite
              FROM ids LEFT JOIN {_z("vol")} v USING (permno) LEFT JOIN {_z("abn")} a USING (permno) LEFT JOIN {_z("dis")} d USING (permno) LEFT JOIN {_z("gaps")} g USING (permno))"""

_CAPS = """
caps AS (SELECT permno, close * shrout * 1000 AS mktcap FROM bars WHERE close IS NOT NULL AND shrout IS NOT NULL QUALIFY row_number() OVER (PARTITION BY permno ORDER BY date DESC) = 1)"""

_PAIRS = """
per AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
alone AS (SELECT l_suppkey, count(*) AS n FROM per GROUP BY 1),
pairs AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) * (SELECT count(DISTINCT l_orderkey) FROM per) / (max(p.n) * max(r.n)) AS score
          FROM per x JOIN per y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey <> y.l_suppkey JOIN alone p ON p.l_suppkey = x.l_suppkey JOIN alone r ON r.l_suppkey = y.l_suppkey GROUP BY 1, 2)"""

_GRAPH = f"""{_PAIRS},
graph AS (SELECT a AS src, b AS dst, round(score, 6) AS weight, CASE (a + b) % 5 WHEN 0 THEN 'SUPPLIES' WHEN 1 THEN 'COMOVES_WITH' ELSE 'COMPETES_WITH' END AS kind,
                 DATE '2001-06-01' + CAST((a * b) % 40 AS INTEGER) AS as_of, CASE WHEN (a + b) % 10 = 0 THEN 'supplier ' || a END AS source_span
          FROM pairs WHERE a < b AND score >= 1.4),
known AS (SELECT * FROM graph WHERE CASE WHEN kind = 'SUPPLIES' THEN as_of < DATE '2001-07-01' ELSE as_of <= DATE '2001-07-01' END),
adj AS (SELECT src AS a, dst AS b, kind, source_span, weight FROM known UNION SELECT dst, src, kind, source_span, weight FROM known),
h0 AS (SELECT unnest([1, 2, 3]) AS node),
h1 AS (SELECT DISTINCT b AS node FROM adj JOIN h0 ON a = node WHERE b NOT IN (SELECT node FROM h0)),
h2 AS (SELECT DISTINCT b AS node FROM adj JOIN h1 ON a = node WHERE b NOT IN (SELECT node FROM h0) AND b NOT IN (SELECT node FROM h1)),
near AS (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2)"""

_LINKS = """
days AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
links AS (SELECT o_custkey, k % 1000 AS permno, k % 9 AS score, k % 7 = 0 AS bad, d AS start, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) - 1 AS stop FROM days)"""

_NAMES = """
names AS (SELECT split_part(p_type, ' ', 1) AS ticker, p_partkey AS permno, p_size * 100 AS siccd, DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS namedt FROM part),
valid AS (SELECT *, namedt + 2000 AS nameenddt FROM names WHERE namedt <= DATE '1999-06-30' AND namedt + 2000 >= DATE '1999-06-30')"""

_SEGMENTS = """
shipped AS (SELECT l_suppkey, o_custkey, CAST(l_extendedprice AS DECIMAL(18, 2)) AS price, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'),
seg AS (SELECT l_suppkey AS s, o_custkey AS cid, CAST(sum(price) AS DOUBLE) AS salecs, max(day) AS datadate FROM shipped GROUP BY 1, 2),
sales AS (SELECT l_suppkey AS s, CAST(sum(price) AS DOUBLE) AS sale FROM shipped WHERE l_suppkey % 11 <> 0 GROUP BY 1),
twins AS (SELECT c_custkey AS cid, min(s_suppkey) AS twin FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1),
keyed AS (SELECT s_suppkey AS permno FROM supplier WHERE NOT (s_suppkey % 10 = 0)),
judged AS (SELECT seg.s, cid, src.permno AS src, dst.permno AS dst, CASE WHEN sale > 0 THEN salecs / sale END AS weight, year(datadate) AS fiscal_year, datadate,
                  CASE WHEN seg.s % 3 <> 0 THEN DATE '2000-12-01' + CAST(seg.s % 250 AS INTEGER) ELSE datadate + 90 END AS as_of, seg.s % 3 = 0 AS lag_estimated
           FROM seg LEFT JOIN sales ON sales.s = seg.s LEFT JOIN twins USING (cid) LEFT JOIN keyed src ON src.permno = seg.s LEFT JOIN keyed dst ON dst.permno = twin),
rows AS (SELECT *, CASE WHEN weight < 0.001 THEN 'share' WHEN as_of >= DATE '2001-04-01' THEN 'postdated' WHEN src IS NULL THEN 'supplier' WHEN dst IS NULL THEN 'customer' ELSE 'loaded' END AS reason FROM judged)"""

_COMPANIES = _SEGMENTS.replace("ON dst.permno = twin)", "ON dst.permno = twin WHERE cid % 13 <> 0)")

_EVENTS = """
log AS (SELECT user_id AS session_id, CAST(day(ts) AS BIGINT) AS turn, CAST(json_extract_string(props, '$.k') AS INTEGER) AS id,
               CASE event_type WHEN 'view' THEN 'candidates' WHEN 'click' THEN 'flags' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'dismiss' WHEN 'signup' THEN 'a_final' END AS event FROM events),
items AS (SELECT DISTINCT session_id, event, id FROM log WHERE id IS NOT NULL)"""

_SCORES = f"""{_EVENTS},
first_turn AS (SELECT session_id, id, min(turn) AS turn FROM log WHERE event = 'candidates' AND id IS NOT NULL GROUP BY 1, 2),
per_session AS (SELECT session_id, count(*) FILTER (event = 'flags') AS n_flags, count(*) FILTER (event = 'a_final') AS n_labels, count(*) FILTER (event = 'accept') AS acc, count(*) FILTER (event = 'dismiss') AS dis FROM items GROUP BY 1),
hits AS (SELECT session_id, count(*) AS hits FROM items f WHERE event = 'flags' AND EXISTS (SELECT 1 FROM items l WHERE l.event = 'a_final' AND l.session_id = f.session_id AND l.id = f.id) GROUP BY 1),
covered AS (SELECT i.session_id, CASE WHEN count(*) = count(t.turn) THEN max(t.turn) END AS ttc, count(t.turn) AS seen FROM items i LEFT JOIN first_turn t ON t.session_id = i.session_id AND t.id = i.id WHERE event = 'a_final' GROUP BY 1),
pr AS (SELECT session_id, n_flags, n_labels, CASE WHEN n_labels > 0 AND n_flags > 0 THEN coalesce(hits, 0) / n_flags END AS p, CASE WHEN n_labels > 0 THEN coalesce(hits, 0) / n_labels END AS r, ttc, acc, dis, coalesce(seen, 0) AS seen
       FROM per_session LEFT JOIN hits USING (session_id) LEFT JOIN covered USING (session_id)),
scores AS (SELECT session_id, n_flags, n_labels, round(p, 6) AS precision, round(r, 6) AS recall,
                  round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p = 0 AND r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f_beta,
                  ttc AS time_to_coverage, CASE WHEN acc + dis > 0 THEN round(acc / (acc + dis), 6) END AS accept_precision, acc AS n_accepts, dis AS n_dismisses, seen AS n_covered_in_candidates FROM pr)"""

_PAGES = """
tagged AS (SELECT l_orderkey, list_distinct(list(split_part(p_type, ' ', 1))) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
chain AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS back FROM orders),
degrees AS (SELECT back AS k, count(*) AS n FROM chain WHERE back IS NOT NULL GROUP BY 1),
pages_ AS (SELECT 'order-' || o_orderkey AS slug, day, tags, coalesce(n, 0) AS in_degree FROM chain JOIN tagged ON l_orderkey = o_orderkey LEFT JOIN degrees ON k = o_orderkey)"""

_PLACED = """
rec AS (SELECT c.*, least(greatest(coalesce(s_nationkey * 400, 0) // 1000, 0), 9) AS division, coalesce(mktcap, 0) AS cap FROM composite c LEFT JOIN supplier ON s_suppkey = permno LEFT JOIN caps USING (permno)
        WHERE permno IN (SELECT permno FROM vol UNION SELECT permno FROM abn UNION SELECT permno FROM dis UNION SELECT permno FROM gaps)),
cuts AS (SELECT list_distinct(quantile_cont(cap, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM rec),
buckets AS (SELECT rec.*, division || '_' || greatest(0, len(list_filter(e, lambda x: x < cap)) - 1) AS bucket FROM rec, cuts),
placed AS (SELECT *, (rank() OVER (PARTITION BY bucket ORDER BY composite) + (count(*) OVER (PARTITION BY bucket, composite) - 1) / 2) / count(*) OVER (PARTITION BY bucket) AS salience FROM buckets)"""

_REASONS = """
best AS (SELECT a, b, min(struct_pack(kind := kind, span := coalesce(source_span, ''))) AS e FROM adj GROUP BY 1, 2),
p1 AS (SELECT b AS node, min([a, b]) AS path FROM adj JOIN h0 ON a = node WHERE b IN (SELECT node FROM h1) GROUP BY b),
p2 AS (SELECT b AS node, min(list_append(path, b)) AS path FROM adj JOIN p1 ON a = node WHERE b IN (SELECT node FROM h2) GROUP BY b),
steps AS (SELECT node, path, 1 AS hops, [e] AS es FROM p1 JOIN best ON a = path[1] AND b = path[2]
          UNION ALL SELECT node, path, 2, [x.e, y.e] FROM p2 JOIN best x ON x.a = path[1] AND x.b = path[2] JOIN best y ON y.a = path[2] AND y.b = path[3]),
s AS (SELECT node, path, hops, es, list_filter(es, lambda z: z.kind = 'SUPPLIES' AND z.span <> '') AS spans, list_transform(es, lambda z: z.kind) AS kinds FROM steps),
told AS (SELECT node, path, CASE WHEN len(spans) > 0 THEN 'named customer-supplier relationship: ' || spans[1].span WHEN list_contains(kinds, 'SUPPLIES') THEN 'customer-supplier relationship in supply chain'
       WHEN list_contains(kinds, 'COMPETES_WITH') AND hops = 1 THEN 'direct product-market peer of permno:' || path[1] WHEN list_contains(kinds, 'COMPETES_WITH') THEN 'product-market peer within 2 hops of permno:' || path[1]
       ELSE 'co-moving with permno:' || path[1] || ' (return-based structural link)' END AS reason FROM s
         UNION ALL SELECT node, [node], 'structurally connected' FROM h0)"""

_VERSIONS = """
versions AS (SELECT 'size-' || p_size AS slug, p_name AS title, p_brand || ' ' || p_type AS body, DATE '2000-01-01' + p_size AS created_on, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS version FROM part WHERE p_partkey % 3 <> 0),
newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY slug ORDER BY version DESC) = 1)"""

QUERIES = {
    name: getattr(q, name)
    for name in (
        "bar_derivation market_series rv_spike abnormal_volume abnormal_volume_window dislocation gap zscore_signals top_vol_spikes composite_attention cap_quintile bucket_salience candidates ranked_candidates "
        "asof_link_resolve batch_resolve asof_over_time option_link_resolve ticker_map sector_map vintage_for iv_rank_minmax next_expiry_asof competes_edges_dedupe peer_load_counters supplies_edges edge_skip_reasons "
        "comoves_residual_corr expand_2hop shortest_path_hops complement_topk reason_hierarchy flag_session seed_weights in_degree page_listing slugify session_scores session_aggregate lift sliced_precision feedback_rates "
        "drift nested_session_read edge_upsert pit_pages candidate_scores secid_resolve ibes_resolve bulk_resolve vertical_edges last_values_a_day winsorised_zscores date_ceilings "
        "flag_report option_enrichment vendor_bars vendor_market proxy_market bar_window page_put page_read page_search links_created event_fold accepted_scores mention_seeds filing_dates children_replaced sessions_left tearsheets uncached_ids"
    ).split()
}

ORACLES = {
    "bar_derivation": f"WITH {_BARS} SELECT permno, date, open, high, low, close, volume, round(ret, 6) AS ret, shrout FROM bars",
    "market_series": f"WITH {_BARS} SELECT date, round(mkt, 6) AS mkt FROM market",
    "rv_spike": f"WITH {_BARS}, {_VOL} SELECT permno, round(value, 6) AS value FROM vol",
    "abnormal_volume": f"WITH {_BARS}, {_ABN} SELECT permno, round(value, 6) AS value FROM abn",
    "abnormal_volume_window": f"""WITH {_BARS}, {_ABN}
SELECT permno, round((max(dv) FILTER (rn = 1) - avg(dv) FILTER (rn BETWEEN 2 AND 61)) / stddev_samp(dv) FILTER (rn BETWEEN 2 AND 61), 6) AS value FROM dv_ranked
GROUP BY permno HAVING count(*) >= 20 AND stddev_samp(dv) FILTER (rn BETWEEN 2 AND 61) > 0""",
    "dislocation": f"WITH {_BARS}, {_DIS} SELECT permno, round(value, 6) AS value FROM dis",
    "gap": f"WITH {_BARS}, {_GAP} SELECT permno, round(value, 6) AS value FROM gaps",
    "zscore_signals": f"WITH {_BARS}, {_ABN} SELECT permno, round(z, 6) AS z FROM {_z('abn')}",
    "top_vol_spikes": f"WITH {_BARS}, {_VOL} SELECT permno, round(z, 6) AS z FROM {_z('vol')} ORDER BY round(z, 6) DESC, permno LIMIT 20",
    "composite_attention": f"WITH {_BARS}, {_VOL}, {_ABN}, {_DIS}, {_GAP}, {_COMPOSITE} SELECT permno, round(vol_spike, 6) AS vol_spike, round(abn_volume, 6) AS abn_volume, round(dislocation, 6) AS dislocation, round(gap, 6) AS gap, round(composite, 6) AS composite FROM composite",
    "cap_quintile": f"""WITH {_BARS}, {_CAPS}, cuts AS (SELECT list_distinct(quantile_cont(mktcap, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM caps)
SELECT permno, mktcap, CAST(greatest(0, len(list_filter(e, lambda x: x < mktcap)) - 1) AS INTEGER) AS cap_q FROM caps, cuts""",
    "bucket_salience": f"""WITH {_BARS}, {_ABN}, {_CAPS},
rec AS (SELECT permno, round(value, 6) AS composite, least(greatest(s_nationkey * 400 // 1000, 0), 9) AS division, coalesce(mktcap, 0) AS cap FROM abn LEFT JOIN supplier ON s_suppkey = permno LEFT JOIN caps USING (permno)),
cuts AS (SELECT list_distinct(quantile_cont(cap, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM rec),
buckets AS (SELECT permno, composite, division || '_' || greatest(0, len(list_filter(e, lambda x: x < cap)) - 1) AS bucket FROM rec, cuts)
SELECT x.permno, x.bucket, x.composite, round((count(*) FILTER (y.composite < x.composite) + (count(*) FILTER (y.composite = x.composite) + 1) / 2) / count(*), 6) AS salience
FROM buckets x JOIN buckets y ON x.bucket = y.bucket GROUP BY 1, 2, 3""",
    "ranked_candidates": f"""WITH {_BARS}, {_VOL}, {_ABN}, {_DIS}, {_GAP}, {_COMPOSITE}
SELECT 'permno:' || permno AS canonical_id, 'attention' AS measure, true AS coverage, false AS has_options, round(composite, 6) AS attention FROM composite
WHERE permno IN (SELECT permno FROM vol UNION SELECT permno FROM abn UNION SELECT permno FROM dis UNION SELECT permno FROM gaps)""",
    "asof_link_resolve": f"""WITH {_LINKS} SELECT CASE WHEN length(o_custkey::VARCHAR) < 6 THEN lpad(o_custkey::VARCHAR, 6, '0') ELSE o_custkey::VARCHAR END AS key, permno FROM links
WHERE NOT bad AND start <= DATE '1999-06-30' AND coalesce(stop, DATE '9999-12-31') >= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY start DESC, permno) = 1""",
    "batch_resolve": f"""WITH {_LINKS}, {_NAMES},
good AS (SELECT o_custkey, permno FROM links WHERE NOT bad AND start <= DATE '1999-06-30' AND (stop IS NULL OR stop >= DATE '1999-06-30')),
named AS (SELECT ticker, permno FROM valid QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY namedt DESC, permno) = 1)
SELECT c_custkey::VARCHAR AS identifier, 'gvkey' AS id_type, 'permno:' || permno AS canonical_id FROM customer LEFT JOIN good ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT t.ticker, 'ticker', 'permno:' || named.permno FROM names t LEFT JOIN named ON named.ticker = t.ticker""",
    "asof_over_time": f"""WITH {_LINKS}, asks AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) + 100 AS day FROM orders)
SELECT a.o_custkey::VARCHAR AS gvkey, day, permno AS lpermno FROM asks a LEFT JOIN links l ON l.o_custkey = a.o_custkey AND start <= day AND coalesce(stop, DATE '9999-12-31') >= day""",
    "option_link_resolve": f"""WITH {_LINKS} SELECT permno, o_custkey AS secid FROM links WHERE score <= 6 AND start <= DATE '1999-06-30' AND (stop IS NULL OR stop >= DATE '1999-06-30')
QUALIFY row_number() OVER (PARTITION BY permno ORDER BY score, o_custkey) = 1""",
    "ticker_map": f"WITH {_NAMES} SELECT permno, ticker FROM valid",
    "sector_map": f"WITH {_NAMES} SELECT permno, siccd FROM valid",
    "vintage_for": """SELECT year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 2 ELSE 1 END AS vintage, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day
FROM orders GROUP BY 1""",
    "iv_rank_minmax": """WITH daily AS (SELECT user_id AS secid, CAST(ts AS DATE) AS date, max(value) AS iv FROM events GROUP BY 1, 2),
span AS (SELECT secid, min(iv) AS low, max(iv) AS high, count(*) AS n FROM daily WHERE date < DATE '2024-01-29' AND iv > 0 GROUP BY 1)
SELECT t.secid, t.iv, CASE WHEN n >= 10 THEN round(CASE WHEN high <= low THEN 0.5 ELSE least(greatest((t.iv - low) / (high - low), 0), 1) END, 6) END AS iv_rank
FROM daily t LEFT JOIN span USING (secid) WHERE date = DATE '2024-01-29'""",
    "next_expiry_asof": """WITH asks AS (SELECT s_suppkey AS secid, DATE '1998-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS catalyst FROM supplier)
SELECT secid, catalyst, min(CAST(l_shipdate AS DATE)) AS exdate FROM asks JOIN lineitem ON l_suppkey = secid AND CAST(l_shipdate AS DATE) > catalyst GROUP BY 1, 2""",
    "competes_edges_dedupe": f"""WITH {_PAIRS} SELECT least(a, b) AS src, greatest(a, b) AS dst, 'COMPETES_WITH' AS kind, round(max(score), 6) AS weight, 2000 AS vintage FROM pairs
WHERE score >= 1.2 AND a % 10 <> 0 AND b % 10 <> 0 GROUP BY 1, 2""",
    "peer_load_counters": f"""WITH {_PAIRS}, j AS (SELECT a, b, score < 1.2 AS low, a % 10 = 0 OR b % 10 = 0 AS lost FROM pairs), good AS (SELECT a, b FROM j WHERE NOT low AND NOT lost)
SELECT (SELECT count(*) FROM j) AS rows, (SELECT count(*) FROM j WHERE low) AS skipped_score, (SELECT count(*) FROM j WHERE NOT low AND lost) AS unresolved,
       (SELECT count(*) FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM good)) AS written, (SELECT count(DISTINCT n) FROM (SELECT a AS n FROM good UNION ALL SELECT b FROM good)) AS nodes""",
    "supplies_edges": f"""WITH {_SEGMENTS} SELECT src, dst, CAST(fiscal_year AS INTEGER) AS fiscal_year, round(weight, 6) AS weight, as_of, lag_estimated FROM rows WHERE reason = 'loaded'
QUALIFY row_number() OVER (PARTITION BY src, dst, fiscal_year ORDER BY datadate DESC, cid DESC) = 1""",
    "edge_skip_reasons": f"WITH {_SEGMENTS} SELECT reason, count(*) AS n FROM rows GROUP BY 1",
    "comoves_residual_corr": f"""WITH {_BARS},
calm AS (SELECT permno, date, ret FROM bars WHERE ret IS NOT NULL), m AS (SELECT date, avg(ret) AS mkt FROM calm GROUP BY date),
w AS (SELECT date, mkt FROM m QUALIFY row_number() OVER (ORDER BY date DESC) <= 252),
r AS (SELECT permno, date, ret, mkt, sum(mkt * ret) OVER (PARTITION BY permno) / sum(mkt * mkt) OVER (PARTITION BY permno) AS beta, count(*) OVER (PARTITION BY permno) AS n FROM calm JOIN w USING (date) WHERE ret > -1),
e AS (SELECT permno, date, ret - beta * mkt AS res FROM r WHERE n >= 60)
SELECT x.permno AS src, y.permno AS dst, round(corr(x.res, y.res), 4) AS weight FROM e x JOIN e y ON x.date = y.date AND x.permno < y.permno GROUP BY 1, 2 HAVING corr(x.res, y.res) >= 0.1""",
    "expand_2hop": f"WITH {_GRAPH} SELECT node, hops FROM near",
    "shortest_path_hops": f"""WITH {_GRAPH},
p1 AS (SELECT b AS node, min([a, b]) AS path FROM adj JOIN h0 ON a = node WHERE b IN (SELECT node FROM h1) GROUP BY b),
p2 AS (SELECT b AS node, min(list_append(path, b)) AS path FROM adj JOIN p1 ON a = node WHERE b IN (SELECT node FROM h2) GROUP BY b),
p3 AS (SELECT b AS node, min(list_append(path, b)) AS path FROM adj JOIN p2 ON a = node WHERE b NOT IN (SELECT node FROM near) GROUP BY b),
found AS (SELECT node, 0 AS hops, [node] AS path FROM h0 UNION ALL SELECT node, 1, path FROM p1 UNION ALL SELECT node, 2, path FROM p2 UNION ALL SELECT node, 3, path FROM p3)
SELECT node, hops, array_to_string(path, '>') AS path FROM found""",
    "complement_topk": f"""WITH {_BARS}, {_ABN}, {_GRAPH} SELECT 'permno:' || permno AS canonical_id, round(value, 6) AS salience FROM abn WHERE permno IN (SELECT node FROM near) AND permno % 4 <> 0
ORDER BY round(value, 6) DESC, 'permno:' || permno LIMIT 15""",
    "reason_hierarchy": f"""WITH {_GRAPH},
{_REASONS} SELECT node, reason FROM told""",
    "seed_weights": f"""WITH {_PAGES}, {_NAMES},
named AS (SELECT ticker, permno FROM valid QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY namedt DESC, permno) = 1),
t AS (SELECT slug, day, in_degree, unnest(tags) AS tag FROM pages_ WHERE day < DATE '1999-06-30'),
w AS (SELECT 'permno:' || permno AS canonical_id, exp(-(DATE '1999-06-30' - day) * ln(2) / 180) * ln(in_degree + 2) AS weight, slug FROM t JOIN named ON tag = ticker WHERE regexp_full_match(tag, '[A-Z]{{1,5}}'))
SELECT canonical_id, round(weight, 6) AS weight, slug FROM w QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY weight DESC, slug) = 1""",
    "in_degree": f"WITH {_PAGES} SELECT slug, in_degree FROM pages_",
    "page_listing": f"WITH {_PAGES} SELECT slug, day AS created_at, in_degree FROM pages_ WHERE day >= DATE '1997-01-01' AND day < DATE '1998-01-01' ORDER BY day DESC, slug LIMIT 25 OFFSET 10",
    "slugify": r"""SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || ' ' || p_brand || ' ' || p_type)), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug
FROM part""",
    "session_scores": f"WITH {_SCORES} SELECT * FROM scores",
    "session_aggregate": f"""WITH {_SCORES} SELECT count(*) AS n_sessions, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f_beta), 6) AS mean_f_beta,
round(avg(accept_precision), 6) AS mean_accept_precision, median(time_to_coverage) AS median_time_to_coverage FROM scores""",
    "lift": f"""WITH {_EVENTS}, f AS (SELECT session_id, id, count(*) AS s FROM log WHERE event = 'flags' AND id IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT session_id, id, (row_number() OVER (PARTITION BY session_id ORDER BY s DESC, id) - 1) / count(*) OVER (PARTITION BY session_id) AS place FROM f)
SELECT r.session_id, round(avg(place), 6) AS lift FROM ranked r JOIN items i ON i.session_id = r.session_id AND i.id = r.id AND i.event = 'accept' GROUP BY 1""",
    "sliced_precision": f"""WITH {_EVENTS}, j AS (SELECT CAST(f.id % 4 AS BIGINT) AS quartile, f.session_id % 3 AS sector, a.id IS NOT NULL AS ok FROM items f LEFT JOIN items a ON a.event = 'accept' AND a.session_id = f.session_id AND a.id = f.id WHERE f.event = 'flags')
SELECT quartile, sector, count(*) AS n, round(count(*) FILTER (ok) / count(*), 6) AS precision FROM j GROUP BY GROUPING SETS ((), (quartile), (sector))""",
    "feedback_rates": f"""WITH {_EVENTS}, t AS (SELECT session_id, CASE WHEN event = 'accept' THEN CASE WHEN id % 2 = 0 THEN 'act' ELSE 'watch' END ELSE CASE WHEN id % 2 = 0 THEN 'known' ELSE 'noise' END END AS tier FROM log WHERE event IN ('accept', 'dismiss') AND id IS NOT NULL)
SELECT session_id, count(*) AS n, round(count(*) FILTER (tier = 'act') / count(*), 6) AS act_rate, round(count(*) FILTER (tier = 'watch') / count(*), 6) AS watch_rate,
round(count(*) FILTER (tier = 'known') / count(*), 6) AS known_rate, round(count(*) FILTER (tier = 'noise') / count(*), 6) AS noise_rate FROM t GROUP BY 1""",
    "drift": f"""WITH {_EVENTS}, f AS (SELECT DISTINCT session_id AS ns, turn, id FROM log WHERE event = 'flags' AND id IS NOT NULL), s AS (SELECT ns, turn, count(*) AS n FROM f GROUP BY 1, 2),
past AS (SELECT DISTINCT s.ns, s.turn, f.id FROM s JOIN f ON f.ns = s.ns AND f.turn BETWEEN s.turn - 3 AND s.turn - 1), m AS (SELECT ns, turn, count(*) AS m FROM past GROUP BY 1, 2),
sh AS (SELECT ns, turn, count(*) AS shared FROM past JOIN f USING (ns, turn, id) GROUP BY 1, 2)
SELECT ns AS namespace, turn AS session_no, n, CASE WHEN m IS NOT NULL THEN round(1 - coalesce(shared, 0) / n, 6) END AS novelty, round(coalesce(shared, 0) / (n + m - coalesce(shared, 0)), 6) AS overlap
FROM s LEFT JOIN m USING (ns, turn) LEFT JOIN sh USING (ns, turn)""",
    "nested_session_read": f"""WITH {_EVENTS}, f AS (SELECT session_id, id, count(*) AS s FROM log WHERE event = 'flags' AND id IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, 'permno:' || id) AS rank FROM f),
sess AS (SELECT session_id, max(turn) AS k FROM log GROUP BY 1),
sheets AS (SELECT p_partkey % 15 AS session_id, p_partkey % 100 AS id, min(p_name) AS company, max(p_name) AS summary FROM part GROUP BY 1, 2),
news AS (SELECT p_partkey % 30 AS session_id, p_size AS id, p_name, p_brand, row_number() OVER (PARTITION BY p_partkey % 30, p_size ORDER BY p_name, p_partkey::VARCHAR) AS r FROM part),
n AS (SELECT session_id, id, count(*) AS n, max(p_name) FILTER (r = 1) AS t, max(p_brand) FILTER (r = 1) AS b FROM news GROUP BY 1, 2)
SELECT sess.session_id, k, CAST(2 AS INTEGER) AS d_e, 'ONE' AS looked_up, CAST(rank AS INTEGER) AS rank, 'permno:' || id AS canonical_id, CASE WHEN id IS NOT NULL THEN 'peer of permno:' || sess.session_id END AS reason,
       CASE WHEN id % 3 > 0 THEN 'permno:' || sess.session_id || '>permno:' || id END AS path, id % 3 > 0 AS on_entity_frontier, company, summary,
       CAST(CASE WHEN id IS NOT NULL THEN coalesce(n, 0) END AS INTEGER) AS n_headlines, t AS first_title, b AS first_source
FROM sess LEFT JOIN ranked USING (session_id) LEFT JOIN sheets USING (session_id, id) LEFT JOIN n USING (session_id, id)""",
    "edge_upsert": f"WITH {_GRAPH} SELECT src, dst, round(CASE WHEN src % 3 = 0 THEN weight + 1 ELSE weight END, 6) AS weight FROM graph WHERE src % 2 = 0 OR src % 3 = 0",
    "candidate_scores": f"""WITH {_BARS}, {_VOL}, {_ABN}, {_DIS}, {_GAP}, {_COMPOSITE}, {_CAPS},
{_PLACED}
SELECT 'permno:' || permno AS canonical_id, DATE '2001-07-01' AS as_of, round(salience, 6) AS salience, round(composite, 6) AS attention, round(vol_spike, 6) AS vol_spike,
       round(abn_volume, 6) AS abn_volume, round(dislocation, 6) AS dislocation, round(gap, 6) AS gap FROM placed""",
    "secid_resolve": f"""WITH {_LINKS} SELECT o_custkey::VARCHAR AS key, permno FROM links
WHERE start <= DATE '1999-06-30' AND (stop IS NULL OR stop >= DATE '1999-06-30') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY start DESC, permno) = 1""",
    "ibes_resolve": f"""WITH {_LINKS} SELECT 'T' || o_custkey AS key, permno FROM links
WHERE start <= DATE '1999-06-30' AND (stop IS NULL OR stop >= DATE '1999-06-30') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN score > 0 THEN score ELSE 100 END DESC, permno) = 1""",
    "bulk_resolve": f"""WITH {_LINKS},
good AS (SELECT o_custkey, permno FROM links WHERE NOT bad AND start <= DATE '1999-06-30' AND (stop IS NULL OR stop >= DATE '1999-06-30') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY start DESC, permno) = 1)
SELECT CASE WHEN length(c_custkey::VARCHAR) < 6 THEN lpad(c_custkey::VARCHAR, 6, '0') ELSE c_custkey::VARCHAR END AS key, permno FROM customer LEFT JOIN good ON c_custkey = o_custkey""",
    "vertical_edges": f"""WITH {_PAIRS} SELECT least(a, b) AS src, greatest(a, b) AS dst, 'VERTICAL' AS kind, 'vtnic' AS provenance, round(max(score), 6) AS weight FROM pairs
WHERE score >= 1.3 AND a % 10 <> 0 AND b % 10 <> 0 GROUP BY 1, 2""",
    "last_values_a_day": """SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, last(l_extendedprice ORDER BY l_orderkey, l_linenumber) AS close,
last(l_quantity ORDER BY l_orderkey, l_linenumber) FILTER (l_quantity >= 10) AS volume FROM lineitem GROUP BY 1, 2""",
    "winsorised_zscores": f"""WITH {_BARS}, {_ABN} SELECT permno, round(least(greatest(z, -1), 1), 6) AS z FROM {_z("abn")}""",
    "date_ceilings": """SELECT 'orders' AS table_name, max(CAST(o_orderdate AS DATE)) AS last_day, count(o_orderdate) AS n_rows FROM orders
UNION ALL SELECT 'lineitem', max(CAST(l_shipdate AS DATE)), count(l_shipdate) FROM lineitem UNION ALL SELECT 'events', max(CAST(ts AS DATE)), count(ts) FROM events""",
    "pit_pages": f"WITH {_PAGES} SELECT slug, CAST(len(list_filter(tags, lambda t: regexp_full_match(t, '[A-Z]{{1,5}}'))) AS INTEGER) AS n_tickers FROM pages_ WHERE day < DATE '1996-01-01'",
    "flag_report": f"""WITH {_BARS}, {_VOL}, {_ABN}, {_DIS}, {_GAP}, {_COMPOSITE}, {_CAPS}, {_PLACED}, {_GRAPH}, {_REASONS},
top AS (SELECT permno, salience FROM placed WHERE permno IN (SELECT node FROM near) AND permno % 4 <> 0 ORDER BY salience DESC, 'permno:' || permno LIMIT 10)
SELECT 'permno:' || permno AS canonical_id, round(salience, 6) AS salience, true AS on_entity_frontier, array_to_string(list_transform(path, lambda x: 'permno:' || x), '>') AS path, reason FROM top JOIN told ON node = permno""",
    "option_enrichment": f"""WITH {_BARS},
q AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) + 1095 AS exdate, l_orderkey % 2 AS side, l_quantity / 50 AS d, (l_extendedprice / 1000 + (l_extendedprice / 1000 + 0.5::DOUBLE)) / 2 AS mid FROM lineitem
      WHERE l_linenumber % 2 = 0 AND l_quantity BETWEEN 18 AND 32 AND l_orderkey % 3 > 0),
x AS (SELECT s, min(exdate) AS exdate FROM q WHERE exdate > DATE '2001-07-01' + CAST(s % 60 AS INTEGER) GROUP BY 1),
legs AS (SELECT s, first(mid ORDER BY d, mid) FILTER (side = 0) AS c, first(mid ORDER BY d, mid) FILTER (side = 1) AS p FROM q JOIN x USING (s, exdate) GROUP BY 1),
v AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) / 100000 + 0.1::DOUBLE AS iv FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
h AS (SELECT s, iv FROM v WHERE date < DATE '2001-07-01' QUALIFY row_number() OVER (PARTITION BY s ORDER BY date DESC) <= 252),
span AS (SELECT s, min(iv) AS low, max(iv) AS high FROM h GROUP BY 1 HAVING count(*) >= 10),
closes AS (SELECT permno AS s, last(close ORDER BY date) AS close FROM bars WHERE close IS NOT NULL GROUP BY 1)
SELECT s_suppkey AS permno, round(v.iv, 6) AS iv, round(CASE WHEN v.iv IS NULL OR low IS NULL THEN NULL WHEN high <= low THEN 0.5 ELSE least(greatest((v.iv - low) / (high - low), 0), 1) END, 6) AS iv_rank,
       round(CASE WHEN close > 0 THEN (c + p) / close END, 6) AS implied_move
FROM supplier LEFT JOIN v ON v.s = s_suppkey AND v.date = DATE '2001-07-01' LEFT JOIN span ON span.s = s_suppkey LEFT JOIN legs ON legs.s = s_suppkey LEFT JOIN closes ON closes.s = s_suppkey
WHERE s_suppkey % 8 <= 6 AND (v.iv IS NOT NULL OR (close > 0 AND c + p IS NOT NULL))""",
    "vendor_bars": """SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS close, l_quantity AS volume, CASE WHEN l_linenumber > 2 THEN l_discount END AS ret FROM lineitem
WHERE l_suppkey % 2 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND year(l_shipdate) = 1996""",
    "vendor_market": "SELECT CAST(o_orderdate AS DATE) AS date, count(*) / 100 AS mkt FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1 HAVING count(*) % 3 <> 0",
    "proxy_market": f"WITH {_BARS} SELECT date, round(ret, 6) AS mkt FROM bars WHERE permno = 7 AND ret IS NOT NULL",
    "bar_window": f"WITH {_BARS} SELECT permno, count(*) AS n_bars, min(date) AS first_day, max(date) AS last_day FROM bars WHERE date >= DATE '2001-07-01' - 97 AND date < DATE '2001-07-01' GROUP BY 1",
    "page_put": f"""WITH {_VERSIONS}, asked AS (SELECT 'size-' || (p_size + 20) AS slug, p_name AS title, p_brand || ' ' || p_type AS body FROM part WHERE p_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY slug ORDER BY title DESC, body DESC) = 1)
SELECT a.slug, coalesce(version, 0) + 1 AS version, 'strategy' AS kind, a.title, a.body, coalesce(created_on, DATE '2001-07-01') AS created_on, DATE '2001-07-01' AS updated_on FROM asked a LEFT JOIN newest n ON n.slug = a.slug""",
    "page_read": f"""WITH {_VERSIONS} SELECT slug, version, title, body, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT 'size-' || (p_partkey % 50) AS t FROM part WHERE p_size = 7)), '') AS links
FROM newest WHERE slug = 'size-7'""",
    "page_search": f"""WITH {_VERSIONS}, w AS (SELECT slug, unnest(list_filter(regexp_split_to_array(lower(title || ' ' || body), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM newest),
sizes AS (SELECT slug, count(*) AS size FROM w GROUP BY 1), st AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
tf AS (SELECT slug, word, count(*) AS tf FROM w WHERE word IN ('red', 'ring', 'economy') GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1)
SELECT slug, any_value(title) AS title, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score
FROM tf JOIN df USING (word) JOIN sizes USING (slug) JOIN newest USING (slug), st GROUP BY slug""",
    "links_created": f"""WITH {_VERSIONS}, asked AS (SELECT p_partkey % 2 = 0 AS there, 'size-' || p_size AS from_slug, 'size-' || (p_partkey % 70) AS to_slug FROM part)
SELECT from_slug, to_slug FROM asked WHERE from_slug IN (SELECT slug FROM newest) AND to_slug IN (SELECT slug FROM newest) GROUP BY 1, 2 HAVING NOT bool_or(there)""",
    "event_fold": """WITH log AS (SELECT event_id, user_id AS session_id, CAST(day(ts) AS BIGINT) AS turn, event_type AS e, CAST(json_extract_string(props, '$.k') AS INTEGER) AS id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
c AS (SELECT session_id, turn, max_by(id, event_id) AS id FROM log WHERE e = 'view' GROUP BY 1, 2), f AS (SELECT session_id, max_by(id, event_id) AS id FROM log WHERE e = 'signup' GROUP BY 1)
SELECT 'candidates' AS kind, session_id, turn, unnest([id, id + 1]) AS id FROM c UNION ALL SELECT 'final', session_id, NULL, unnest([id, id + 2]) FROM f
UNION ALL SELECT DISTINCT 'flags', session_id, CAST(NULL AS BIGINT), id FROM (SELECT session_id, unnest([id, id + 3]) AS id FROM log WHERE e = 'click')
UNION ALL SELECT DISTINCT CASE e WHEN 'purchase' THEN 'accept' ELSE 'dismiss' END, session_id, CAST(NULL AS BIGINT), id FROM log WHERE e IN ('purchase', 'error')""",
    "accepted_scores": f"""WITH {_SCORES.replace("event = 'a_final'", "event = 'accept'")} SELECT * FROM scores""",
    "mention_seeds": """WITH m AS (SELECT o_orderpriority AS namespace, 'permno:' || (o_custkey % 100) AS canonical_id, CAST(o_orderdate AS DATE) AS seen, o_orderkey,
                  pow(2, -(DATE '1999-06-30' - CAST(o_orderdate AS DATE)) / 30) * (1 + o_orderkey % 3) * (0.5::DOUBLE + o_orderkey % 2) AS one FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1999-06-30'),
s AS (SELECT namespace, canonical_id, sum(one) AS raw, min(seen) AS first_seen, max(seen) AS last_seen, count(DISTINCT o_orderkey) AS n_pages FROM m GROUP BY 1, 2)
SELECT namespace, canonical_id, round(raw / max(raw) OVER (PARTITION BY namespace), 6) AS weight, first_seen, last_seen, n_pages FROM s""",
    "filing_dates": """SELECT c_custkey::VARCHAR AS gvkey, min(CAST(o_orderdate AS DATE)) AS fdate, count(*) AS n_filings FROM customer JOIN orders ON c_custkey % 500 = o_custkey % 700 WHERE c_custkey % 10 > 0 GROUP BY 1""",
    "children_replaced": """WITH n AS (SELECT p_partkey % 60 AS session_id, 'permno:' || (p_size + 1) AS canonical_id, p_brand AS title, p_partkey FROM part WHERE p_partkey % 5 = 0),
o AS (SELECT p_partkey % 30 AS session_id, 'permno:' || p_size AS canonical_id, p_name AS title, p_partkey FROM part WHERE p_partkey % 5 <> 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.session_id = o.session_id AND n.canonical_id = o.canonical_id)""",
    "sessions_left": "SELECT user_id AS session_id, max(CAST(ts AS DATE)) AS last_day, count(*) AS n_flags FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 GROUP BY 1",
    "tearsheets": f"""WITH {_BARS}, b AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY permno ORDER BY date DESC) = 1)
SELECT 'permno:' || s_suppkey AS canonical_id, s_name AS company, close AS prev_close, round(close - open, 6) AS change, round(CASE WHEN open <> 0 THEN (close - open) * 100 / open END, 6) AS change_pct FROM supplier LEFT JOIN b ON permno = s_suppkey""",
    "uncached_ids": "SELECT DISTINCT 'permno:' || o_custkey AS canonical_id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
}
