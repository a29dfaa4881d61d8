"""DuckDB SQL for the queries of ``scale``, written from the rules and not from the plans."""

from __future__ import annotations

from saltmarsh.plans.registry import _ABN, _BARS, _COMPANIES, _DIS, _EVENTS, _GAP, _GRAPH, _LINKS, _VOL, ORACLES, _z

_ASKS = "asks AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) + 50 AS day FROM orders)"
_NAMED = """
spans AS (SELECT split_part(p_type, ' ', 1) AS ticker, p_partkey, p_size * 100 AS siccd, DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) AS namedt, DATE '1995-01-01' + CAST(p_partkey % 2000 AS INTEGER) + 2000 AS nameenddt FROM part),
tick AS (SELECT DISTINCT ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'][o_orderkey % 6 + 1] AS k, CAST(o_orderdate AS DATE) AS day FROM orders),
ask_parts AS (SELECT DISTINCT o_orderkey % 400 AS k, CAST(o_orderdate AS DATE) AS day FROM orders)"""


def _first(kind: str, asks: str, rows: str, on: str, order: str, value: str, key: str = "a.k::VARCHAR") -> str:
    return f"""SELECT '{kind}' AS id_type, {key} AS identifier, a.day, CAST({value} AS VARCHAR) AS value FROM {asks} a LEFT JOIN {rows} l ON {on}
QUALIFY row_number() OVER (PARTITION BY a.k, a.day ORDER BY {order}) = 1"""


_OPEN = "l.o_custkey = a.k AND l.start <= a.day AND (l.stop >= a.day OR l.stop IS NULL)"
_IN_NAME = "l.namedt <= a.day AND l.nameenddt >= a.day"

_SESSIONS = f"""{_EVENTS},
f AS (SELECT session_id, id, count(*) AS s FROM log WHERE event = 'flags' AND id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT session_id, count(*) AS n_flags FROM f GROUP BY 1),
strong AS (SELECT * FROM f WHERE session_id % 3 = 0 AND s > 1)"""

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

SQL = {
    "page_index_search": rf"""WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS words FROM documents),
stats AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
tf AS (SELECT doc_id, len(words) AS size, term, count(*) AS tf FROM (SELECT doc_id, words, unnest(words) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS.format("text")})) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, sum(CAST(round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))) * 1000000) AS BIGINT)) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS INTEGER) AS rank, doc_id::VARCHAR AS slug, round(score / 1000000, 6) AS score FROM s QUALIFY rank <= 10""",
    "ids_over_days": f"""WITH {_LINKS}, {_ASKS}, {_NAMED},
{", ".join(f"r{k} AS ({one})" for k, one in enumerate((
    _first("gvkey", "asks", "links", _OPEN + " AND NOT l.bad", "l.start DESC NULLS LAST, l.permno", "l.permno", "CASE WHEN length(a.k::VARCHAR) < 6 THEN lpad(a.k::VARCHAR, 6, '0') ELSE a.k::VARCHAR END"),
    _first("secid", "asks", "links", _OPEN, "l.start DESC NULLS LAST, l.permno", "l.permno"),
    _first("ibes_ticker", "asks", "links", _OPEN, "l.start IS NULL, nullif(l.score, 0) DESC NULLS FIRST, l.permno", "l.permno", "'T' || a.k"),
    _first("ticker", "tick", "spans", f"l.ticker = a.k AND {_IN_NAME}", "l.namedt DESC NULLS LAST, l.p_partkey", "l.p_partkey", "a.k"),
    _first("permno_ticker", "ask_parts", "spans", f"l.p_partkey = a.k AND {_IN_NAME}", "l.namedt DESC NULLS LAST", "l.ticker"),
    _first("permno_siccd", "ask_parts", "spans", f"l.p_partkey = a.k AND {_IN_NAME}", "l.namedt DESC NULLS LAST", "l.siccd"),
)))},
r6 AS (SELECT 'permno_secid' AS id_type, a.k::VARCHAR AS identifier, a.day, CAST(l.o_custkey AS VARCHAR) AS value FROM asks a LEFT JOIN links l ON l.permno = a.k AND l.score BETWEEN 1 AND 6 AND l.start <= a.day AND (l.stop >= a.day OR l.stop IS NULL)
       QUALIFY row_number() OVER (PARTITION BY a.k, a.day ORDER BY l.score NULLS LAST, l.o_custkey) = 1)
SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5 UNION ALL SELECT * FROM r6""",
    "price_quantiles": """WITH v AS (SELECT 'l_extendedprice' AS column_name, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer),
q AS (SELECT column_name, unnest([0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]) AS share, unnest(quantile_cont(CAST(v AS DOUBLE), [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0])) AS value FROM v GROUP BY 1)
SELECT column_name, CAST(share AS DOUBLE) AS share, round(value, 4) AS value FROM q""",
    "price_ranks": """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, floor(o_totalprice / 100) AS v FROM orders)
SELECT o_orderkey, rank() OVER (PARTITION BY p ORDER BY v) + (count(*) OVER (PARTITION BY p, v) - 1) / 2 AS avg_rank, count(*) OVER (PARTITION BY p) AS n_group FROM o""",
    "stored_signals": f"""WITH {_BARS}, {_VOL}, {_ABN}, {_DIS}, {_GAP},
ids AS (SELECT permno FROM vol UNION SELECT permno FROM abn UNION SELECT permno FROM dis UNION SELECT permno FROM gaps)
SELECT permno, round(v.z, 6) AS vol_spike, round(a.z, 6) AS abn_volume, round(d.z, 6) AS dislocation, round(g.z, 6) AS gap
FROM ids LEFT JOIN {_z("vol")} v USING (permno) LEFT JOIN {_z("abn")} a USING (permno) LEFT JOIN {_z("dis")} d USING (permno) LEFT JOIN {_z("gaps")} g USING (permno)""",
    "yearly_bars": """SELECT l_suppkey AS secid, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS price, CASE WHEN year(CAST(l_shipdate AS DATE)) > 1996 THEN max(l_tax) END AS tax
FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' GROUP BY 1, 2""",
    "edges_stored": f"""WITH {_GRAPH} SELECT CAST(1 AS BIGINT) AS version, src, dst, round(weight, 6) AS weight FROM graph WHERE src % 2 = 0
UNION ALL SELECT CAST(2 AS BIGINT), src, dst, round(CASE WHEN src % 3 = 0 THEN weight + 1 ELSE weight END, 6) FROM graph WHERE src % 2 = 0 OR src % 3 = 0""",
    "sessions_stored": f"""WITH {_SESSIONS}
SELECT CAST(1 AS BIGINT) AS version, session_id, n_flags, n_flags AS flags, n_flags AS tearsheets, 2 * n_flags AS headlines FROM n
UNION ALL SELECT CAST(2 AS BIGINT), session_id, n_flags, n_flags, n_flags, 2 * n_flags FROM n WHERE session_id % 3 <> 0
UNION ALL SELECT CAST(2 AS BIGINT), session_id, -1, k, k, 0 FROM (SELECT n.session_id, count(s.id) AS k FROM n LEFT JOIN strong s USING (session_id) WHERE session_id % 3 = 0 GROUP BY 1)""",
    "children_stored": f"""WITH {_SESSIONS}, kept AS (SELECT session_id, id FROM f WHERE session_id % 3 <> 0 UNION ALL SELECT session_id, id FROM strong)
SELECT session_id, 'permno:' || id AS canonical_id, CAST(1 AS INTEGER) AS rank, 'fresh' AS title FROM kept WHERE id % 2 = 0 AND session_id % 5 <> 0
UNION ALL SELECT session_id, 'permno:' || id, CAST(r AS INTEGER), 'news ' || r || ' permno:' || id FROM kept, (SELECT unnest([1, 2]) AS r) WHERE id % 2 <> 0 AND session_id % 3 <> 0 AND session_id % 5 <> 0""",
    "streamed_fold": ORACLES["event_fold"],
    "graph_nodes": f"""WITH {_GRAPH}, e AS (SELECT src AS node FROM graph UNION ALL SELECT dst FROM graph) SELECT 'permno:' || node AS canonical_id, count(*) AS n_ends, true AS is_unique FROM e GROUP BY 1""",
    "paths_between": "WITH RECURSIVE "
    + _GRAPH.replace("score >= 1.4", "score >= 2.5").split("h0 AS")[0]
    + """ends AS (SELECT DISTINCT a, b FROM adj),
walks AS (SELECT unnest([1, 2, 3]) AS node, 0 AS hops UNION SELECT b, hops + 1 FROM walks JOIN ends ON a = node WHERE hops < 6),
dist AS (SELECT node, min(hops) AS hops FROM walks GROUP BY 1),
routes AS (SELECT node, [node] AS path FROM dist WHERE hops = 0
           UNION ALL SELECT d.node, list_append(r.path, d.node) FROM routes r JOIN ends ON a = r.node JOIN dist d ON d.node = b AND d.hops = len(r.path))
SELECT node, CAST(min(len(path)) - 1 AS INTEGER) AS hops, array_to_string(min(path), '>') AS path FROM routes WHERE node % 5 = 0 GROUP BY node""",
    "rest_bars_read": f"""WITH {_BARS} SELECT permno, date, CASE WHEN permno % 2 = 0 THEN open END AS open, close, round(ret, 6) AS ret FROM bars WHERE permno % 7 <> 0 AND permno % 5 <> 0""",
    "tickers_skipped": """WITH r AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey % 7 <> 0)
SELECT 'T' || s_suppkey AS ticker, CASE WHEN s_suppkey % 5 = 0 THEN 'unmapped' WHEN k IS NULL THEN 'no response' ELSE 'empty' END AS reason FROM supplier LEFT JOIN r ON k = s_suppkey WHERE s_suppkey % 5 = 0 OR k IS NULL OR s_suppkey % 11 = 0""",
    "pair_file_read": """SELECT CAST(3 AS INTEGER) AS n_fields, count(*) AS n_lines, round(sum(CAST('0.' || p_size AS DOUBLE)), 4) AS total FROM part WHERE p_partkey % 10 > 1
UNION ALL SELECT CAST(2 AS INTEGER), count(*), NULL FROM part WHERE p_partkey % 10 = 0""",
    "event_log_read": f"""WITH {_EVENTS.replace("AS event FROM events", "AS event, event_id FROM events")} SELECT session_id::VARCHAR AS session_id, count(*) AS n_events, max_by(id::VARCHAR, event_id) AS last_id FROM log WHERE id IS NOT NULL GROUP BY 1""",
    "tickers_read_through": """SELECT 'permno:' || c_custkey AS canonical_id, CASE WHEN c_custkey % 3 > 0 THEN 'T' || c_custkey END AS ticker, c_custkey % 3 > 0 AND c_custkey % 2 = 0 AS was_cached FROM customer""",
    "supplier_spans": f"""WITH {_COMPANIES}, e AS (SELECT * FROM rows WHERE reason = 'loaded' QUALIFY row_number() OVER (PARTITION BY src, dst, fiscal_year ORDER BY datadate DESC, cid DESC) = 1)
SELECT src, dst, CAST(fiscal_year AS INTEGER) AS fiscal_year, 'CUSTOMER ' || cid || CASE WHEN weight IS NULL THEN ' (FY' || fiscal_year || ' major customer)' ELSE ' (' END AS span FROM e""",
    "flag_cards": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'TICK' WHEN 1 THEN 'LOOK' ELSE 'permno:' || o_custkey END AS label, strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 61), '%H:%M') AS clock,
CASE WHEN floor(o_totalprice) * 5000 >= 1e9 THEN 'B' WHEN floor(o_totalprice) * 5000 >= 1e6 THEN 'M' ELSE '' END AS unit FROM orders WHERE o_totalprice / 400000 >= 0.25 AND o_orderkey % 2 = 0""",
    "observed_peer_load": ORACLES["peer_load_counters"],
    "observed_comovement_load": ORACLES["comoves_residual_corr"].rsplit("SELECT x.permno", 1)[0].rstrip()
    + """,
pairs_ AS (SELECT x.permno AS src, y.permno AS dst FROM e x JOIN e y ON x.date = y.date AND x.permno < y.permno GROUP BY 1, 2 HAVING corr(x.res, y.res) >= 0.1),
used AS (SELECT permno, max(n) AS n FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM pairs_) AS edges_written, (SELECT count(*) FROM pairs_) AS pairs_above_threshold, (SELECT count(*) FROM used WHERE n >= 60) AS stocks_used,
       (SELECT count(*) FROM used WHERE n < 60) AS stocks_dropped_min_obs, (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM pairs_ UNION ALL SELECT dst FROM pairs_)) AS nodes_merged""",
    "candidates": ORACLES["candidate_scores"].rsplit("SELECT 'permno:'", 1)[0]
    + """SELECT 'permno:' || permno AS canonical_id, 'attention' AS measure, round(salience, 6) AS salience, true AS coverage, DATE '2001-07-01' AS as_of, round(composite, 6) AS attention, false AS has_options,
CAST(NULL AS DOUBLE) AS implied_move, CAST(NULL AS DOUBLE) AS iv_rank,
printf('vol_spike=%.4f abn_volume=%.4f dislocation=%.4f gap=%.4f', round(vol_spike, 4) + 0.0, round(abn_volume, 4) + 0.0, round(dislocation, 4) + 0.0, round(gap, 4) + 0.0) AS components FROM placed""",
    "flag_session": ORACLES["flag_report"].rsplit("SELECT 'permno:'", 1)[0]
    + """SELECT 'permno:' || permno AS canonical_id, round(salience, 6) AS salience, true AS on_entity_frontier, false AS on_thesis_frontier, array_to_string(list_transform(path, lambda x: 'permno:' || x), '>') AS entity_path, reason
FROM top JOIN told ON node = permno""",
}
