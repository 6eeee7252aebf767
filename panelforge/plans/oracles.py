"""The registered queries in DuckDB SQL, as chains of named subqueries over the tables."""

from __future__ import annotations

import re

from .setup import LEVELS, S, Z

EPS = "1e-12"


def r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


def roll(f: str, x: str, k: int, least: int | None = None, by: str = "ticker") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {least or k} THEN {f}({x}) {w} END"


def lag(x: str, k: int = 1, by: str = "ticker") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {by} ORDER BY date)"


def lead(x: str, k: int = 1, by: str = "ticker") -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY {by} ORDER BY date)"


def pad(x: str, by: str = "ticker") -> str:
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rank(x: str, by: str = "date") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST)"
        f" + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE END"
    )


def crank(x: str, by: str = "date") -> str:
    n = f"count({x}) OVER (PARTITION BY {by})"
    return f"(({rank(x, by)}) - ({n} + 1) / 2.0::DOUBLE) / {n}"


def price(extra: str = "") -> str:
    return f"CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) {extra} AS DOUBLE) / sum(l_quantity) {extra}"


WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"
DAY = "CAST(l_shipdate AS DATE)"


def _bars(d: str) -> str:
    return (
        f"SELECT 'T' || lpad(CAST(l_partkey % {S.names} AS VARCHAR), 2, '0') AS ticker, 'E' || CAST(l_partkey % {S.names} % 6 AS VARCHAR) AS sector,"
        f" {d} AS date, {price()} AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2, 3"
    )


def _grid(bars: str, cal: str) -> str:
    return (
        f"SELECT c.date, n.ticker, n.sector, b.close, b.volume FROM {cal} c CROSS JOIN (SELECT DISTINCT ticker, sector FROM {bars}) n"
        f" LEFT JOIN {bars} b ON b.date = c.date AND b.ticker = n.ticker"
    )


def _cal(bars: str) -> str:
    return f"SELECT date FROM {bars} GROUP BY date HAVING count(close) / (SELECT count(DISTINCT ticker) FROM {bars})::DOUBLE >= 0.6"


_W = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {S.window - 1} PRECEDING AND CURRENT ROW)"


def _pair(a: str, b: str) -> str:
    return f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) {_W} >= {S.least} THEN covar_samp({a}, {b}) {_W} END"


Q = [f"q{round(x * 100)}" for x in LEVELS]
_PIT = (
    f"CASE WHEN y < q10 THEN 0.0::DOUBLE WHEN y > q90 THEN 1.0::DOUBLE WHEN y = q90 THEN {LEVELS[-1]}::DOUBLE "
    + " ".join(
        f"WHEN y >= {Q[i]} AND y < {Q[i + 1]} THEN {LEVELS[i]}::DOUBLE + (y - {Q[i]}) * ({LEVELS[i + 1]}::DOUBLE - {LEVELS[i]}::DOUBLE) / ({Q[i + 1]} - {Q[i]})"
        for i in reversed(range(len(Q) - 1))
    )
    + " END"
)
_MU = (
    " + ".join(f"({b} + {a}) / 2 * ({hi}::DOUBLE - {lo}::DOUBLE)" for a, b, lo, hi in zip(Q, Q[1:], LEVELS, LEVELS[1:]))
    + f" + q10 * {LEVELS[0]}::DOUBLE + q90 * (1 - {LEVELS[-1]}::DOUBLE)"
)
_H = S.event_horizons
_FLAG = "count(*) FILTER (WHERE {}) OVER (PARTITION BY date)"


def _gatecount(x: str) -> str:
    n = f"count({x}) OVER (PARTITION BY date)"
    return (
        f"{x} IS NOT NULL AND rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) <= "
        f"greatest(floor({n} * {S.share}::DOUBLE), least({S.gate_least}, {n}))"
    )


def _matched(x: str, ref: str) -> str:
    n = f"count({x}) OVER (PARTITION BY date)"
    return (
        f"{x} IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY {x} NULLS LAST, ticker) <= "
        f"least(greatest({_FLAG.format(ref)}, least({S.gate_least}, {n})), {n})"
    )


CTE: dict[str, str] = {
    "bars": _bars(WEEK),
    "bars_d": _bars(DAY),
    "cal": _cal("bars"),
    "cal_d": _cal("bars_d"),
    "grid": _grid("bars", "cal"),
    "grid_d": _grid("bars_d", "cal_d"),
    "ret_d0": f"SELECT *, {pad('close')} AS p FROM grid_d",
    "ret_d": f"SELECT date, ticker, sector, close, p / {lag('p')} - 1 AS ret FROM ret_d0",
    "mkt0": f"SELECT c.date, m.market_close FROM cal c LEFT JOIN (SELECT {WEEK} AS date, {price()} AS market_close FROM lineitem GROUP BY 1) m USING (date)",
    "mkt1": f"SELECT date, {pad('market_close', '1')} AS p FROM mkt0",
    "mkt": f"SELECT date, p / {lag('p', 1, '1')} - 1 AS mkt_ret FROM mkt1",
    "sec0": (
        f"SELECT c.date, s.sector, x.c AS close FROM cal c CROSS JOIN (SELECT DISTINCT 'E' || CAST(l_partkey % {S.names} % 6 AS VARCHAR) AS sector FROM lineitem) s"
        f" LEFT JOIN (SELECT 'E' || CAST(l_partkey % {S.names} % 6 AS VARCHAR) AS sector, {WEEK} AS date, {price()} AS c FROM lineitem GROUP BY 1, 2) x"
        " ON x.date = c.date AND x.sector = s.sector"
    ),
    "sec1": f"SELECT date, sector, {pad('close', 'sector')} AS p FROM sec0",
    "sec": f"SELECT date, sector, p / {lag('p', 1, 'sector')} - 1 AS sec_ret FROM sec1",
    "pan0": f"SELECT *, {pad('close')} AS p FROM grid",
    "pan1": f"SELECT date, ticker, sector, close, volume, p / {lag('p')} - 1 AS ret FROM pan0",
    "pan": (
        "SELECT a.*, m.mkt_ret, coalesce(s.sec_ret, 0.0) AS sec_ret FROM pan1 a LEFT JOIN mkt m USING (date)"
        " LEFT JOIN sec s ON s.date = a.date AND s.sector = a.sector"
    ),
    "mom": (
        f"SELECT *, {roll('avg', 'ret', S.window, S.least)} AS my, {roll('avg', 'mkt_ret', S.window, S.least)} AS m1, {roll('avg', 'sec_ret', S.window, S.least)} AS m2,"
        f" {roll('var_samp', 'mkt_ret', S.window, S.least)} AS c11, {roll('var_samp', 'sec_ret', S.window, S.least)} AS c22,"
        f" {_pair('mkt_ret', 'sec_ret')} AS c12, {_pair('mkt_ret', 'ret')} AS c1y, {_pair('sec_ret', 'ret')} AS c2y FROM pan"
    ),
    "sol": (
        "SELECT *, CASE WHEN abs(c11 * c22 - c12 * c12) < 1e-16 THEN c1y / c11 ELSE (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) END AS b1,"
        " CASE WHEN abs(c11 * c22 - c12 * c12) < 1e-16 THEN 0.0 ELSE (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) END AS b2 FROM mom"
    ),
    "bet": (
        f"SELECT date, ticker, sector, close, volume, ret, mkt_ret, sec_ret, {lag('my - b1 * m1 - b2 * m2')} AS alpha,"
        f" {lag('b1')} AS beta_mkt, {lag('b2')} AS beta_sector FROM sol"
    ),
    "res": "SELECT *, ret - (beta_mkt * mkt_ret + beta_sector * sec_ret) AS resid FROM bet",
    "win0": f"SELECT *, {roll('stddev_samp', 'resid', S.window, S.least)} AS s FROM res",
    "win1": f"SELECT *, {lag('s')} * {S.sigmas} AS b FROM win0",
    "win": "SELECT date, ticker, CASE WHEN resid IS NULL THEN NULL WHEN b IS NULL THEN resid ELSE greatest(least(resid, b), -b) END AS resid FROM win1",
    "st0": "SELECT *, ln(1 + volume) AS lv, abs(ret) / nullif(close * volume, 0.0) AS impact FROM res",
    "st1": (
        "SELECT *, " + ", ".join(f"{roll('sum', 'resid', n)} AS s{n}" for n in (5, 21, 63, 126))
        + f", {roll('stddev_samp', 'ret', 20)} AS rv_20d, {roll('stddev_samp', 'ret', 60)} AS rv60, {roll('stddev_samp', 'resid', 20)} AS idio_vol_20d,"
        f" {roll('avg', 'lv', 20)} AS lv20, {roll('avg', 'lv', 60)} AS lv60, {roll('stddev_samp', 'lv', 60)} AS lvs60,"
        f" ({roll('avg', 'impact', 20)}) * 1e9 AS amihud, {roll('avg', 'close', 50)} AS ma50, {roll('avg', 'close', 200)} AS ma200,"
        f" close / {lag('close')} - 1 - ret AS overnight_gap FROM st0"
    ),
    "st": (
        "SELECT *, -resid AS reversal_1d, -s5 AS reversal_5d, " + ", ".join(f"{lag(f's{n}', 5)} AS resid_mom_{n}d" for n in (21, 63, 126))
        + f", rv_20d / (rv60 + {EPS}) AS rv_ratio, idio_vol_20d / (rv_20d + {EPS}) AS idio_share, (lv - lv20) / (lvs60 + {EPS}) AS volume_z,"
        f" lv20 - lv60 AS volume_trend, (close / (ma50 + {EPS}) - 1) / (rv_20d * sqrt(50.0::DOUBLE) + {EPS}) AS dist_ma50,"
        f" (close / (ma200 + {EPS}) - 1) / (rv_20d * sqrt(200.0::DOUBLE) + {EPS}) AS dist_ma200 FROM st1"
    ),
    "bd0": f"SELECT date, ticker, close > ({roll('avg', 'close', 50)}) AS above, {roll('stddev_samp', 'ret', 20)} AS sd FROM pan",
    "bd": "SELECT date, avg(CASE WHEN coalesce(above, false) THEN 1.0::DOUBLE ELSE 0.0 END) AS breadth, avg(sd) AS xs_dispersion_20d FROM bd0 GROUP BY date",
    "aux1": (
        f"SELECT {WEEK} AS date, avg(l_discount) * 100 AS tnx, avg(l_tax) * 100 AS irx, "
        + ", ".join(
            f"CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = '{f}') AS DOUBLE) / sum(l_quantity) FILTER (WHERE l_returnflag = '{f}') AS {n}"
            for f, n in (("A", "hyg"), ("N", "tlt"))
        )
        + " FROM lineitem GROUP BY 1"
    ),
    "aux2": "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, stddev_samp(o_totalprice) / 1e4 AS vix FROM orders GROUP BY 1",
    "aux3": "SELECT date, avg(close) AS rsp FROM bars GROUP BY date",
    "dat": (
        "SELECT m.date, m.mkt_ret, b.breadth, b.xs_dispersion_20d, vix, tnx, irx, hyg, tlt, rsp FROM mkt m JOIN bd b USING (date)"
        " LEFT JOIN aux1 USING (date) LEFT JOIN aux2 USING (date) LEFT JOIN aux3 USING (date)"
    ),
    "dap": "SELECT *, " + ", ".join(f"{pad(s, '1')} AS p_{s}" for s in ("vix", "tnx", "irx", "rsp", "hyg", "tlt")) + " FROM dat",
    "mf": (
        f"SELECT date, mkt_ret AS mkt_ret_1d, {roll('sum', 'mkt_ret', 5, by='1')} AS mkt_ret_5d, {roll('sum', 'mkt_ret', 21, by='1')} AS mkt_ret_21d,"
        f" {roll('stddev_samp', 'mkt_ret', 20, by='1')} AS mkt_rv_20d, vix, p_vix / {lag('p_vix', 1, '1')} - 1 AS vix_chg_1d, p_vix / {lag('p_vix', 5, '1')} - 1 AS vix_chg_5d,"
        f" (vix - ({roll('avg', 'vix', 60, by='1')})) / (({roll('stddev_samp', 'vix', 60, by='1')}) + {EPS}) AS vix_z_60d,"
        f" vix / 100.0 - ({roll('stddev_samp', 'mkt_ret', 20, by='1')}) * sqrt(252.0::DOUBLE) AS vrp,"
        f" tnx AS rate_10y, tnx - {lag('tnx', 5, '1')} AS rate_10y_chg_5d, tnx - irx AS term_spread,"
        f" p_rsp / {lag('p_rsp', 5, '1')} - 1 - ({roll('sum', 'mkt_ret', 5, by='1')}) AS breadth_ew_cw_5d, breadth AS breadth_pct_above_ma50,"
        f" breadth - {lag('breadth', 5, '1')} AS breadth_chg_5d, p_hyg / {lag('p_hyg', 5, '1')} - 1 AS credit_ret_5d, p_tlt / {lag('p_tlt', 5, '1')} - 1 AS duration_ret_5d,"
        f" (p_hyg / {lag('p_hyg', 5, '1')} - 1) - (p_tlt / {lag('p_tlt', 5, '1')} - 1) AS credit_excess_5d, xs_dispersion_20d FROM dap"
    ),
    "eve": "SELECT CAST(DATE '1995-01-25' + CAST(i * 42 AS INTEGER) AS DATE) AS event FROM range(0, 70) t(i) WHERE DATE '1995-01-25' + CAST(i * 42 AS INTEGER) <= DATE '2002-12-31'",
    "nxt": "SELECT c.date, (SELECT min(event) FROM eve e WHERE e.event >= c.date) AS next_event FROM cal c",
    "cf0": (
        "SELECT date, isodow(date) - 1 AS dow, row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) - 1 AS place,"
        " count(*) OVER (PARTITION BY year(date), month(date)) AS size, CAST(next_event - date AS DOUBLE) AS gap FROM nxt"
    ),
    "cf": (
        "SELECT date, sin(2.0 * pi() * dow / 5) AS dow_sin, cos(2.0 * pi() * dow / 5) AS dow_cos, CAST(place < 3 AS DOUBLE) AS tom_start,"
        " CAST(size - 1 - place < 3 AS DOUBLE) AS tom_end, CASE WHEN gap IS NOT NULL THEN least(gap, 30.0) END AS days_to_fomc,"
        " CAST(coalesce(gap <= 1, false) AS DOUBLE) AS fomc_window FROM cf0"
    ),
    "tgt": f"SELECT *, {lead('resid', S.lag + 1)} AS target FROM st",
    "prd0": (
        f"SELECT *, round({roll('stddev_samp', 'coalesce(resid, 0.0)', 20)}, 8) AS vol, round(idio_vol_20d, 8) AS s, round(reversal_1d, 8) AS rev FROM tgt"
    ),
    "prd1": f"SELECT *, {rank('rev')} AS rk FROM prd0 WHERE idio_vol_20d IS NOT NULL AND reversal_1d IS NOT NULL",
    "prd": (
        "SELECT date, ticker, round(target, 8) AS y, vol, "
        + ", ".join(f"round(rk * 0.01::DOUBLE * s + ({z})::DOUBLE * s, 13) AS {q}" for q, z in zip(Q, Z)) + " FROM prd1"
    ),
    "scr": "SELECT * FROM prd WHERE y IS NOT NULL",
    "unp": "SELECT date, ticker, y, level, q FROM (" + " UNION ALL ".join(f"SELECT date, ticker, y, {x}::DOUBLE AS level, {q} AS q FROM scr" for x, q in zip(LEVELS, Q)) + ")",
    "pit": f"SELECT *, {_PIT} AS pit FROM scr",
    "ic0": f"SELECT date, {rank('q50')} AS rp, {rank('y')} AS ra FROM scr",
    "ic": "SELECT date, round(corr(rp, ra), 12) AS ic, count(*) AS n FROM ic0 GROUP BY date HAVING count(*) >= 5 AND min(rp) < max(rp) AND min(ra) < max(ra)",
    "sig": f"SELECT *, {_MU} AS mu, q90 - q10 AS width0 FROM prd",
    "gat0": (
        "SELECT *, round(q90 - q10, 8) AS width, ((date - DATE '1995-01-02') * 7919 + CAST(substr(ticker, 2, 2) AS INTEGER) * 104729) % 10007 / 10007.0::DOUBLE AS noise FROM sig"
    ),
    "gat1": f"SELECT *, {_gatecount('width')} AS gate_width FROM gat0",
    "gat": f"SELECT *, {_matched('vol', 'gate_width')} AS gate_vol, {_matched('noise', 'gate_width')} AS gate_random, true AS gate_none FROM gat1",
    "trn0": (
        "SELECT CAST(l_orderkey AS VARCHAR) AS accession, l_orderkey, min(l_partkey) FILTER (WHERE rn = 1) % 12 AS nm, min(CAST(l_shipdate AS DATE)) FILTER (WHERE rn = 1) AS filing_date"
        " FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_shipdate AS DATE), l_partkey) AS rn FROM lineitem) GROUP BY l_orderkey"
    ),
    "trn": (
        "SELECT t.filing_date, CAST(l.l_shipdate AS DATE) - CAST(l.l_orderkey % 60 AS INTEGER) AS trade_date,"
        " t.filing_date - (CAST(l.l_shipdate AS DATE) - CAST(l.l_orderkey % 60 AS INTEGER)) AS filing_lag_days,"
        " 'T' || lpad(CAST(t.nm AS VARCHAR), 2, '0') AS ticker, 'Issuer ' || t.nm AS issuer, t.nm AS issuer_cik,"
        " CASE l_returnflag WHEN 'N' THEN 'P' ELSE 'S' END AS trans_code, l_quantity AS shares, (l_extendedprice / l_quantity / 100) AS price,"
        " l_quantity * (l_extendedprice / l_quantity / 100) AS value_usd, c.c_name AS owner_name,"
        " CASE WHEN c_mktsegment IS NULL THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'Director, Officer' ELSE 'Director' END AS relationship,"
        " CASE c_mktsegment WHEN 'BUILDING' THEN 'Chief Executive Officer' WHEN 'FURNITURE' THEN 'Vice CEO' END AS title,"
        " CASE WHEN c_custkey IS NOT NULL THEN 1 END AS n_owners, coalesce(c_mktsegment = 'MACHINERY', false) AS is_officer, c_mktsegment IS NOT NULL AS is_director,"
        " coalesce(c_mktsegment IN ('BUILDING', 'FURNITURE'), false) AS is_ceo_cfo, o_orderpriority = '5-LOW' AS is_planned, t.accession"
        " FROM lineitem l JOIN trn0 t ON t.l_orderkey = l.l_orderkey JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey"
        " WHERE l_returnflag IN ('N', 'R') AND l.l_orderkey % 10 <> 0"
    ),
    "evt": (
        "SELECT filing_date, ticker, count(DISTINCT owner_name) AS n_insiders, sum(value_usd) AS total_value, bool_or(is_officer) AS any_officer, bool_or(is_ceo_cfo) AS any_ceo_cfo,"
        " count(DISTINCT owner_name) >= 2 AS is_cluster FROM trn WHERE trans_code = 'P' AND NOT is_planned AND price >= 1.0 GROUP BY 1, 2"
    ),
    "ent": "SELECT e.*, c.date AS entry_date FROM evt e ASOF JOIN (SELECT date FROM cal) c ON e.filing_date < c.date",
    "abn0": "SELECT date, ticker, close, volume, " + ", ".join(f"{lead('close', h)} / close - 1 AS fwd_{h}d" for h in _H) + " FROM grid",
    "abn": (
        "SELECT a.*, " + ", ".join(f"a.fwd_{h}d - m.m{h} AS ar_{h}d" for h in _H) + " FROM abn0 a JOIN (SELECT date, "
        + ", ".join(f"median(fwd_{h}d) AS m{h}" for h in _H) + " FROM abn0 GROUP BY date) m USING (date)"
    ),
    "mfw": "SELECT date, " + ", ".join(f"{lead('market_close', h, '1')} / market_close - 1 AS mk{h}" for h in _H) + " FROM mkt0",
    "liq": (
        "SELECT date, ticker, CASE WHEN count(v) OVER w >= 20 THEN quantile_cont(v, 0.5) OVER w END AS liquidity FROM (SELECT date, ticker, close * volume AS v FROM grid)"
        " WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
    ),
    "sdy0": (
        "SELECT e.*, " + ", ".join(f"a.ar_{h}d" for h in _H) + ", " + ", ".join(f"a.fwd_{h}d - m.mk{h} AS spy_{h}d" for h in _H)
        + ", CASE WHEN l.liquidity > 0 THEN l.liquidity END AS liquidity FROM ent e LEFT JOIN abn a ON a.date = e.entry_date AND a.ticker = e.ticker"
        " LEFT JOIN mfw m ON m.date = e.entry_date LEFT JOIN liq l ON l.date = e.entry_date AND l.ticker = e.ticker"
        f" WHERE coalesce({', '.join(f'a.ar_{h}d' for h in _H)}) IS NOT NULL"
    ),
    "sdy": "SELECT *, total_value / liquidity AS rel_size FROM sdy0",
}

def sql(select: str, **more: str) -> str:
    """``select`` with the subqueries it needs, each once and in order."""
    known = {**CTE, **more}
    order: list[str] = []
    open_: set[str] = set()

    def need(text: str) -> None:
        for m in re.finditer(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z_0-9]+)\b", text):
            name = m[1]
            if name in known and name not in order and name not in open_:
                open_.add(name)
                need(known[name])
                order.append(name)

    need(select)
    head = ", ".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH {head} {select}" if head else select
