"""SQL that says the same as each registered query, for an independent engine.

Positions are rolled by a recursive query, one step after another, so that they do not share
the interval derivation of the engine.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_fills": ((), """
        SELECT 'STK' AS secType, 'P' || l_partkey AS secId, CAST(l_orderkey AS VARCHAR) AS order_itag,
               CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F')
                    THEN 'BUY' ELSE 'SELL' END AS side,
               4.0::DOUBLE * (1 + l_quantity % 3) AS tradeQty,
               floor(l_extendedprice / l_quantity * 64) / 64 AS avgPrice,
               floor(l_tax * 128) / 128 AS commission, l_shipdate AS fill_timestamp
        FROM lineitem"""),
    "fills": (("raw_fills",), """
        SELECT f.*, CASE o_orderpriority WHEN '1-URGENT' THEN 16.0::DOUBLE
               WHEN '2-HIGH' THEN 8.0 ELSE 32.0 END AS totalQty
        FROM raw_fills f JOIN orders ON order_itag = CAST(o_orderkey AS VARCHAR)"""),
    "alloc": ((), """
        SELECT o_orderdate AS timestamp, CAST(o_orderkey AS VARCHAR) AS order_itag, port,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
                    THEN CASE port WHEN '1' THEN 2.0::DOUBLE ELSE 1.0 END
                    ELSE CASE port WHEN '1' THEN 0.75 ELSE 0.25 END END AS Alloc,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'amount'
                    ELSE 'percent' END AS typeAlloc
        FROM orders, (VALUES ('1'), ('2')) v(port) WHERE o_orderpriority <> '5-LOW'
        UNION ALL
        SELECT o_orderdate - INTERVAL 1 DAY, CAST(o_orderkey AS VARCHAR), port, 0.5, 'percent'
        FROM orders, (VALUES ('1'), ('2')) v(port)
        WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'P'"""),
    "alloc_now": (("alloc",), """
        SELECT order_itag, port, Alloc, typeAlloc FROM (
            SELECT *, row_number() OVER (PARTITION BY order_itag, port ORDER BY timestamp DESC) AS rn
            FROM alloc) WHERE rn = 1"""),
    "price_writes": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS date, 'P' || l_partkey AS ticker,
               floor(l_extendedprice / l_quantity * 64) / 64 AS price,
               l_shipdate AS timestamp_write FROM lineitem"""),
    "prices": (("price_writes",), """
        SELECT date, ticker, max(price) AS price, max(timestamp_write) AS timestamp_write
        FROM price_writes GROUP BY ALL"""),
    "evs": ((), """
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS event_ts FROM lineitem
        UNION
        SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) + INTERVAL 1 MONTH
        FROM lineitem"""),
    "cash0": ((), """
        SELECT TIMESTAMP '1994-12-01' AS timestamp, port, ccy,
               CASE port WHEN '1' THEN (SELECT CAST(sum(floor(c_acctbal)) AS DOUBLE) FROM customer)
                    ELSE (SELECT CAST(sum(floor(s_acctbal)) AS DOUBLE) FROM supplier) END AS amount
        FROM (VALUES ('1', 'USD'), ('1', 'EUR'), ('2', 'USD')) v(port, ccy)"""),
    "steps": (("evs", "cash0"), """
        SELECT row_number() OVER (ORDER BY ts) - 1 AS step, ts, lag(ts) OVER (ORDER BY ts) AS prev_ts
        FROM (SELECT event_ts AS ts FROM evs UNION SELECT timestamp FROM cash0)"""),
    "trades": (("fills", "alloc_now", "steps"), """
        SELECT ticker, port, step,
               sum(CASE WHEN typeAlloc = 'amount' THEN q * Alloc / totalQty ELSE q * Alloc END) AS dq,
               sum(CASE WHEN typeAlloc = 'amount' THEN c * Alloc / totalQty ELSE c * Alloc END) AS cost
        FROM (SELECT secId AS ticker, order_itag, totalQty, step,
                     CASE side WHEN 'BUY' THEN tradeQty ELSE -tradeQty END AS q,
                     CASE side WHEN 'BUY' THEN avgPrice * tradeQty ELSE -avgPrice * tradeQty END
                         + commission AS c
              FROM fills JOIN steps ON fill_timestamp > prev_ts AND fill_timestamp <= ts) f
        JOIN alloc_now USING (order_itag) GROUP BY ALL"""),
    "dense": (("trades", "steps", "prices"), """
        SELECT k.ticker, k.port, s.step AS i, s.ts, coalesce(t.dq, 0.0) AS dq,
               coalesce(t.cost, 0.0) AS cost, p.price AS vector,
               t.cost / nullif(t.dq, 0) AS paid, t.step IS NOT NULL AS traded
        FROM (SELECT ticker, port, min(step) AS i0 FROM trades GROUP BY ALL) k
        JOIN steps s ON s.step >= k.i0
        LEFT JOIN trades t ON t.ticker = k.ticker AND t.port = k.port AND t.step = s.step
        LEFT JOIN prices p ON p.ticker = k.ticker AND p.date = s.ts"""),
    "rolled": (("dense",), """
        SELECT ticker, port, min(i) - 1 AS i, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS amount_prev,
               0.0::DOUBLE AS amount, 0.0::DOUBLE AS basis, 0.0::DOUBLE AS cost,
               NULL::DOUBLE AS price, '' AS price_source, 0.0::DOUBLE AS mtm_prev,
               0.0::DOUBLE AS mtm, false AS traded
        FROM dense GROUP BY ticker, port
        UNION ALL
        SELECT ticker, port, i, ts, amount_prev, amount, basis, cost, price, price_source, mtm_prev,
               CASE WHEN amount = 0 THEN 0.0 ELSE price * amount END, traded
        FROM (SELECT r.ticker, r.port, d.i, d.ts, r.amount AS amount_prev, r.amount + d.dq AS amount,
                     CASE WHEN r.amount = 0 THEN 0.0 ELSE r.basis END + d.cost AS basis, d.cost,
                     coalesce(d.vector, d.paid, CASE WHEN r.amount <> 0 THEN r.price END) AS price,
                     CASE WHEN d.vector IS NOT NULL THEN 'vector' WHEN d.paid IS NOT NULL THEN 'trade'
                          ELSE 'last_mtm' END AS price_source,
                     r.mtm AS mtm_prev, d.traded
              FROM rolled r JOIN dense d
              ON d.ticker = r.ticker AND d.port = r.port AND d.i = r.i + 1)"""),
    "equity": (("rolled",), """
        SELECT ts AS timestamp, port, ticker, amount, coalesce(basis / nullif(amount, 0), 0.0) AS avgPrice,
               cost AS trade_cost_basis, price, price_source, mtm, mtm - cost - mtm_prev AS pnl,
               CASE WHEN amount_prev = 0 THEN mtm / nullif(cost, 0) - 1.0
                    ELSE (mtm - cost - mtm_prev) / nullif(mtm_prev, 0) END AS ret
        FROM rolled WHERE ts IS NOT NULL AND (amount_prev <> 0 OR traded)"""),
    "cut": (("steps",), "SELECT max(step) // 2 AS half FROM steps"),
    "ticks": ((), """
        SELECT ts AS date, CAST(user_id AS VARCHAR) AS ticker, value AS price, event_type AS kind,
               event_id AS tick_id FROM events"""),
    "record": (("raw_fills",), """
        SELECT strftime(o_orderdate, '%y%m%d') AS sessionId, CAST(order_itag AS BIGINT) AS api_internal_tag,
               'IB' AS api_client, 3::BIGINT AS api_clientId, secId, 'STK' AS secType,
               'LMT' AS orderType, CASE WHEN o_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN q + 1 ELSE q END AS totalQty,
               order_itag || '-' || substr(secId, 2) AS order_itag, o_orderdate AS placed_timestamp,
               CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'filled' END AS status,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS status_timestamp
        FROM (SELECT order_itag, secId, sum(tradeQty) AS q FROM raw_fills GROUP BY ALL) l
        JOIN orders ON o_orderkey = CAST(order_itag AS BIGINT)"""),
    "flat": (("raw_fills",), """
        SELECT CAST(fill_timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'America/Lima' AS TIMESTAMP) AS fill_timestamp,
               secId, CAST(order_itag AS BIGINT) AS api_internal_tag, 3::BIGINT AS api_clientId,
               tradeQty, avgPrice, commission FROM raw_fills"""),
    "matched": (("record", "flat"), """
        SELECT r.sessionId, r.api_internal_tag, r.api_client, r.api_clientId, r.secId, r.secType,
               r.orderType, r.side, r.totalQty, r.order_itag, r.placed_timestamp, f.fill_timestamp,
               f.avgPrice, f.commission, f.tradeQty
        FROM (SELECT *, sum(tradeQty) OVER (PARTITION BY api_internal_tag, api_clientId, secId) AS total
              FROM flat) f
        JOIN record r ON r.api_internal_tag = f.api_internal_tag AND r.api_clientId = f.api_clientId
             AND r.secId = f.secId AND r.totalQty = f.total
        WHERE r.status = 'open' AND r.api_client = 'IB'"""),
    "means": (("ticks",), """
        SELECT ticker, round(avg(price), 4) AS day_mean, min(date) AS first_ts FROM ticks
        WHERE CAST(date AS DATE) = DATE '2024-01-15' GROUP BY ticker"""),
    "directed": (("ticks", "means"), """
        SELECT tick_id, ticker, date, price, first_ts,
               CASE WHEN price > day_mean THEN 'BUY' ELSE 'SELL' END AS action
        FROM ticks JOIN means USING (ticker) WHERE price <> day_mean"""),
    "chain": (("directed",), """
        SELECT ticker, min(first_ts) AS last, 0 AS hop FROM directed GROUP BY ticker
        UNION ALL
        SELECT c.ticker, min(e.date), any_value(c.hop) + 1 FROM chain c JOIN directed e
        ON e.ticker = c.ticker AND e.date > c.last + INTERVAL 6 HOUR GROUP BY c.ticker"""),
    "chain_all": (("ticks",), """
        SELECT ticker, min(date) AS last FROM ticks GROUP BY ticker
        UNION ALL
        SELECT c.ticker, min(e.date) FROM chain_all c JOIN ticks e
        ON e.ticker = c.ticker AND e.date > c.last + INTERVAL 6 HOUR GROUP BY c.ticker"""),
    "used": ((), """
        SELECT strftime(l_shipdate, '%y%m%d') AS day, max(l_linenumber * 100)::BIGINT AS last_number
        FROM lineitem GROUP BY ALL"""),
    "numbered": (("used",), """
        SELECT o.*, strftime(o_orderdate, '%y%m%d') || lpad(CAST(
                   row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey)
                   + coalesce(last_number, 0) AS VARCHAR), 8, '0') AS order_itag,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'OPT' ELSE 'STK' END AS secType,
               CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS action
        FROM orders o LEFT JOIN used ON day = strftime(o_orderdate, '%y%m%d')"""),
    "msgs": (("ticks",), """
        SELECT *, kind IN ('error') AS broken, kind IN ('click') AS plain,
               CASE kind WHEN 'view' THEN 'bonds' ELSE 'us_equity' END AS table_name FROM ticks"""),
    "conf": (("matched",), """
        SELECT order_itag, sessionId, string_agg(DISTINCT strftime(fill_timestamp, '%Y%m%d%H%M%S'), ','
                   ORDER BY strftime(fill_timestamp, '%Y%m%d%H%M%S')) AS fill_timestamps
        FROM matched GROUP BY ALL"""),
    "signed": (("raw_fills",), """
        SELECT secType, secId, order_itag,
               sum(CASE side WHEN 'BUY' THEN avgPrice * tradeQty ELSE -avgPrice * tradeQty END + commission)
                   AS trade_cost_basis,
               sum(CASE side WHEN 'BUY' THEN tradeQty ELSE -tradeQty END) AS amount_variation
        FROM raw_fills GROUP BY ALL"""),
    "per_port": (("signed", "alloc_now"), """
        SELECT secType, secId, order_itag, port, typeAlloc,
               CASE WHEN typeAlloc = 'amount' THEN abs(Alloc / nullif(amount_variation, 0)) * trade_cost_basis
                    ELSE Alloc * trade_cost_basis END AS trade_cost_basis,
               CASE WHEN typeAlloc = 'amount' THEN sign(amount_variation) * Alloc
                    ELSE amount_variation * Alloc END AS amount_variation
        FROM signed LEFT JOIN alloc_now USING (order_itag)"""),
    "amounts": (("rolled",), """
        SELECT ts AS timestamp, port, ticker, amount, coalesce(basis / nullif(amount, 0), 0.0) AS avgPrice,
               cost AS trade_cost_basis FROM rolled
        WHERE ts IS NOT NULL AND (amount_prev <> 0 OR traded)"""),
}


def _needed(names: tuple[str, ...], found: list[str], known: dict) -> list[str]:
    for name in names:
        if name not in found:
            _needed(known[name][0], found, known)
            found.append(name)
    return found


def _sql(select: str, *views: str, **other: tuple[tuple[str, ...], str]) -> str:
    """`select` over the views it names; `other` puts views in the place of those of the name."""
    known = VIEWS | other
    texts = {n: known[n][1] for n in _needed(views, [], known)}
    again = {n for n, text in texts.items() if f" {n} " in " ".join(text.split())}
    parts = ",\n".join(f"{n} AS {'' if n in again else 'MATERIALIZED '}({text})" for n, text in texts.items())
    return f"WITH RECURSIVE {parts}\n{select}" if parts else select


def _cents(x: str) -> str:
    return f"floor({x} * 100 + 0.37) / 100"


def oracle_sql() -> dict[str, str]:
    c = _cents
    stored = "SELECT o_orderdate FROM orders"
    late = "(SELECT min(l_shipdate) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-15')"
    start = f"(SELECT max(o_orderdate) FROM orders WHERE o_orderdate < {late})"
    restart = "TIMESTAMP '1998-06-15'"

    def steps_with(more: str, *views: str) -> tuple[tuple[str, ...], str]:
        return ("evs", "cash0", *views), f"""
            SELECT row_number() OVER (ORDER BY ts) - 1 AS step, ts, lag(ts) OVER (ORDER BY ts) AS prev_ts
            FROM (SELECT event_ts AS ts FROM evs UNION SELECT timestamp FROM cash0 UNION {more})"""

    early = steps_with("SELECT TIMESTAMP '1994-10-17 09:30:00'")
    with_fills = steps_with(
        "SELECT max(fill_timestamp) FROM raw_fills GROUP BY date_trunc('quarter', fill_timestamp)", "raw_fills")
    return {
        "scan_prices_day": _sql(
            "SELECT date, ticker, price FROM ticks WHERE CAST(date AS DATE) = DATE '2024-01-15'", "ticks"),
        "price_last_date": _sql("SELECT max(date) AS last_date FROM prices", "prices"),
        "price_union_dedupe": _sql("""
            SELECT date, ticker, close FROM (
                SELECT CAST(date_trunc('hour', date) AS TIMESTAMP) AS date, ticker, price AS close,
                       row_number() OVER (PARTITION BY date_trunc('hour', date), ticker
                                          ORDER BY date DESC, price DESC) AS rn FROM ticks)
            WHERE rn = 1""", "ticks"),
        "price_upsert_latest": _sql("""
            SELECT date, ticker, price, timestamp_write FROM (
                SELECT *, row_number() OVER (PARTITION BY date, ticker
                                             ORDER BY timestamp_write DESC, price DESC) AS rn
                FROM price_writes) WHERE rn = 1""", "price_writes"),
        "price_conform": _sql(
            "SELECT date, ticker, price, TIMESTAMP '2024-02-01' AS timestamp_write FROM ticks", "ticks"),
        "csv_ingest_ny": _sql("""
            SELECT CAST(date_trunc('second', date) AT TIME ZONE 'UTC'
                        AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS date, kind AS ticker,
                   max(CASE kind WHEN 'view' THEN price - 1.0 ELSE price END) AS close
            FROM ticks GROUP BY ALL""", "ticks"),
        "price_manifest": """
            SELECT * FROM (VALUES ('view', 'csv', '', NULL), ('sale', 'csv', '', 'ticker'),
                                  ('click', 'parquet', 'close', 'fields'), ('click', NULL, '', 'format'))
            v(ticker, kind, missing, fault)""",
        "csv_mapped_file": _sql(
            "SELECT CAST(date_trunc('second', date) AS TIMESTAMP) AS date, ticker, price FROM ticks",
            "ticks"),
        "price_files_stacked": _sql("""
            SELECT CAST(date_trunc('millisecond', date) AT TIME ZONE 'UTC'
                        AT TIME ZONE 'America/New_York' AS TIMESTAMP) AS date,
                   kind AS ticker, max(price) AS close FROM ticks GROUP BY ALL""", "ticks"),
        "broker_fills_flat": _sql("SELECT * FROM flat", "flat"),
        "broker_open_trades": """
            SELECT 3::BIGINT AS clientId, o_orderkey AS orderId,
                   CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS action,
                   3.0::DOUBLE AS totalQuantity, 'LMT' AS orderType, o_totalprice AS lmtPrice,
                   'C' || o_custkey AS symbol, o_orderstatus AS status, 0.0::DOUBLE AS filled,
                   3.0::DOUBLE AS remaining,
                   CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(
                       o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'America/Lima', '%y%m%d-%H:%M:%S')
                   END AS lastLog FROM orders""",
        "snapshot_join_recode": """
            SELECT 1.0::DOUBLE + c_custkey % 8 AS Cantidad, CAST(c_nationkey AS BIGINT) AS Portafolio,
                   'NATION_' || c_nationkey AS Name,
                   CASE WHEN n_name IS NOT NULL THEN 'ISIN' || n_nationkey END AS ISIN,
                   CAST(n_nationkey AS VARCHAR) AS CodigoSBS, CAST(n_regionkey AS VARCHAR) AS TipoRenta,
                   CASE WHEN n_name IS NOT NULL THEN 1.0::DOUBLE END AS ValorUnitario,
                   c_acctbal AS ValorCausadoOriginal, c_acctbal AS ValorCausadoLocal,
                   c_acctbal AS VPNOriginal, c_acctbal AS VPNLocal,
                   CASE WHEN n_name IS NULL THEN NULL WHEN n_regionkey = 1 THEN 'USD'
                        WHEN n_regionkey = 2 THEN 'PEN' ELSE 'EUR' END AS Moneda,
                   CASE WHEN n_name IS NOT NULL THEN '20301231' END AS FechaVencimiento
            FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) n
            ON n_name = 'NATION_' || c_nationkey WHERE c_mktsegment <> 'MACHINERY'""",
        "nav_by_fund": """
            SELECT o_totalprice AS Patrimonio, substr(o_orderpriority, 1, 1) AS Fondo,
                   CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS Fecha FROM orders
            WHERE strftime(o_orderdate, '%Y%m') = '199806' AND o_orderstatus <> 'P'
              AND substr(o_orderpriority, 1, 1) IN ('1', '2', '3')""",
        "unit_cost": """
            SELECT CAST(p_partkey AS VARCHAR) AS port, CAST(p_size AS DOUBLE) AS amount,
                   p_retailprice / p_size AS cost_basis, 'USD' AS ccy,
                   CASE p_name WHEN 'red ring' THEN 'RING' ELSE p_name END AS ticker
            FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%bolt%'""",
        "seed_cash": _sql("""
            SELECT TIMESTAMP '2025-02-20' AS timestamp, port, ccy, amount, amount AS cost_basis
            FROM cash0 ORDER BY port, ccy LIMIT 2""", "cash0"),
        "append_rows": """
            SELECT status, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (
                SELECT 'receivedByAutoPort' AS status, o_orderdate AS ts FROM orders
                UNION ALL SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'deniedByRiskManager'
                                 ELSE 'dispatchedToAutoExec' END, o_orderdate FROM orders
                UNION ALL SELECT 'fill_confirmed', l_shipdate FROM lineitem) GROUP BY status""",
        "schema_check": _sql("""
            SELECT 'fills' AS table_name, field, n AS n_filled, (SELECT count(*) FROM fills) AS n_rows
            FROM (UNPIVOT (SELECT count(secId) AS secId, count(secType) AS secType, count(side) AS side,
                  count(order_itag) AS order_itag, count(fill_timestamp) AS fill_timestamp,
                  count(avgPrice) AS avgPrice, count(commission) AS commission,
                  count(tradeQty) AS tradeQty FROM fills) ON COLUMNS(*) INTO NAME field VALUE n)""",
            "fills"),
        "fills_signed": _sql("SELECT * FROM signed", "signed"),
        "processed_fills": _sql("""
            SELECT secType, secId, port, trade_cost_basis, amount_variation,
                   trade_cost_basis / nullif(amount_variation, 0) AS trade_avgPrice
            FROM per_port""", "per_port"),
        "processed_fills_interval": _sql("""
            SELECT secId, order_itag, port, trade_cost_basis, amount_variation FROM per_port""",
            "per_port").replace(
            "FROM lineitem)", "FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-01-01'"
            f" AND l_shipdate <= {restart})", 1),
        "alloc_percent_amount": _sql("""
            SELECT typeAlloc, port, count(*) AS n, round(sum(trade_cost_basis), 4) AS trade_cost_basis,
                   round(sum(amount_variation), 4) AS amount_variation
            FROM per_port GROUP BY typeAlloc, port""", "per_port"),
        "alloc_latest": _sql("SELECT * FROM alloc_now", "alloc_now"),
        "trade_avg_price": _sql("""
            SELECT secId, order_itag, port, trade_cost_basis / nullif(amount_variation, 0) AS trade_avgPrice
            FROM per_port""", "per_port"),
        "unallocated_fills": _sql("""
            SELECT order_itag, secId, side, tradeQty, avgPrice, fill_timestamp FROM raw_fills
            WHERE order_itag NOT IN (SELECT order_itag FROM alloc)""", "raw_fills", "alloc"),
        "fills_grid_assign": _sql("""
            SELECT order_itag, secId, fill_timestamp, tradeQty, step FROM raw_fills
            JOIN steps ON fill_timestamp > prev_ts AND fill_timestamp <= ts""", "raw_fills", "steps"),
        "fills_uneven_grid": _sql("""
            SELECT order_itag, secId, fill_timestamp, tradeQty, step FROM raw_fills
            JOIN (SELECT row_number() OVER (ORDER BY ts) - 1 AS step, ts, lag(ts) OVER (ORDER BY ts) AS prev_ts
                  FROM (SELECT event_ts AS ts FROM evs
                        UNION SELECT fill_timestamp FROM raw_fills WHERE month(fill_timestamp) = 1))
            ON fill_timestamp > prev_ts AND fill_timestamp <= ts""", "raw_fills", "evs"),
        "net_step_trades": _sql("SELECT * FROM trades", "trades"),
        "positions_rollforward": _sql("SELECT * FROM amounts", "amounts"),
        "positions_priced": _sql("SELECT * FROM equity", "equity"),
        "positions_in_blocks": _sql("SELECT * FROM equity", "equity"),
        "positions_open_carry": _sql(f"""
            SELECT timestamp, port, ticker, amount, {c('avgPrice')} AS avgPrice, {c('price')} AS price,
                   price_source, {c('mtm')} AS mtm FROM equity""", "equity"),
        "positions_mirrored": _sql("""
            SELECT timestamp - INTERVAL 1 DAY AS timestamp, port, ticker, -amount AS amount,
                   avgPrice * 0.7::DOUBLE AS avgPrice, avgPrice * 0.7::DOUBLE AS price
            FROM amounts""", "amounts"),
        "positions_full_join": _sql(f"""
            SELECT ticker, port, coalesce(h.amount, 0.0) AS amount_prev,
                   coalesce(h.amount, 0.0) + coalesce(t.dq, 0.0) AS amount,
                   {c('coalesce((coalesce(h.basis, 0.0) + coalesce(t.cost, 0.0))'
                      ' / nullif(coalesce(h.amount, 0.0) + coalesce(t.dq, 0.0), 0), 0.0)')} AS avgPrice,
                   coalesce(t.cost, 0.0) AS trade_cost_basis
            FROM (SELECT ticker, port, amount, basis FROM rolled JOIN cut ON i = half
                  WHERE ts IS NOT NULL AND amount <> 0) h
            FULL JOIN (SELECT ticker, port, dq, cost FROM trades JOIN cut ON step = half + 1) t
            USING (ticker, port)""", "rolled", "cut"),
        "cash_rollforward": _sql("""
            SELECT ts AS timestamp, port, ccy,
                   amount - CASE ccy WHEN 'USD' THEN spent ELSE 0 END AS amount,
                   amount - CASE ccy WHEN 'USD' THEN spent ELSE 0 END AS cost_basis
            FROM (SELECT s.ts, s.step, c.port, c.ccy, c.amount, sum(coalesce(n.cost, 0.0)) OVER (
                      PARTITION BY c.port, c.ccy ORDER BY s.step) AS spent
                  FROM steps s CROSS JOIN cash0 c
                  LEFT JOIN (SELECT port, step, sum(cost) AS cost FROM trades GROUP BY ALL) n
                  ON n.port = c.port AND n.step = s.step) WHERE step > 0""", "trades", "cash0"),
        "net_cost_by_port": _sql("""
            SELECT port, ts AS timestamp, sum(cost) AS trade_cost_basis
            FROM trades JOIN steps USING (step) GROUP BY port, ts""", "trades"),
        "ports_without_cash": _sql(
            "SELECT DISTINCT port FROM trades WHERE port NOT IN ('1')", "trades"),
        "pnl_pivot": _sql("SELECT ticker, " + ", ".join(
            f"{c(f'sum({v}) FILTER (port = {p!r})')} AS {v}_{p}"
            for p in ("1", "2") for v in ("pnl", "ret")) + " FROM equity GROUP BY ticker", "equity"),
        "ret_slice_sum": _sql("""
            SELECT ticker, round(sum(ret), 4) AS ret, count(*) AS n FROM equity
            WHERE timestamp BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-01'
            GROUP BY ticker""", "equity"),
        "price_source_count": _sql("""
            SELECT price_source, count(*) AS n, count(*) FILTER (amount = 0) AS n_flat
            FROM equity GROUP BY price_source""", "equity"),
        "price_fill_group_mean": _sql(f"""
            SELECT a.timestamp, port, a.ticker,
                   {c('coalesce(p.price, avg(a.avgPrice) OVER (PARTITION BY a.ticker))')} AS price
            FROM amounts a LEFT JOIN prices p ON p.ticker = a.ticker AND p.date = a.timestamp""",
            "amounts"),
        "positions_market_join": _sql("""
            SELECT a.timestamp, port, a.ticker, a.amount * p.price AS mtm
            FROM amounts a LEFT JOIN prices p ON p.ticker = a.ticker AND p.date = a.timestamp""",
            "amounts"),
        "offgrid_timestamps": _sql(
            "SELECT DISTINCT date AS ts FROM ticks WHERE second(date) % 5 <> 0", "ticks"),
        "timestamp_set_diff": """
            SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS n_both,
                   count(*) FILTER (r IS NULL) AS n_left, count(*) FILTER (l IS NULL) AS n_right
            FROM (SELECT DISTINCT o_orderdate AS l FROM orders)
            FULL JOIN (SELECT DISTINCT l_shipdate AS r FROM lineitem) ON l = r""",
        "distinct_times": """
            SELECT o_orderdate AS ts FROM orders UNION SELECT l_shipdate FROM lineitem""",
        "event_range": """
            SELECT count(*) AS n_events, min(ts) AS first_event, max(ts) AS last_event FROM events""",
        "ticks_head": _sql(
            "SELECT date, ticker, price FROM ticks ORDER BY date, tick_id LIMIT 10", "ticks"),
        "ticks_tail": _sql(
            "SELECT date, ticker, price FROM ticks ORDER BY date DESC, tick_id DESC LIMIT 10", "ticks"),
        "ticks_slice": _sql(
            "SELECT date, ticker, price FROM ticks ORDER BY date, tick_id LIMIT 10 OFFSET 5", "ticks"),
        "start_ts": f"SELECT {start} AS start_ts",
        "timestamps_to_update": f"""
            SELECT o_orderdate AS ts FROM ({stored}) WHERE o_orderdate >= {start}
            UNION SELECT l_shipdate FROM lineitem WHERE l_shipdate >= {restart}""",
        "grid_steps": """
            SELECT row_number() OVER (ORDER BY ts) - 1 AS step, ts, lag(ts) OVER (ORDER BY ts) AS prev_ts
            FROM (SELECT DISTINCT ts FROM events)""",
        "calibration_mean": _sql("""
            SELECT ticker, CAST(date AS DATE) AS day, round(avg(price), 4) AS day_mean,
                   min(date) AS first_ts FROM ticks GROUP BY ALL""", "ticks"),
        "signals_directed": _sql("SELECT tick_id, ticker, date, price, action FROM directed", "directed"),
        "signals_throttled": _sql("""
            SELECT tick_id, d.ticker, date, price, action FROM directed d
            JOIN chain c ON c.ticker = d.ticker AND c.last = d.date WHERE hop > 0""", "chain"),
        "signals_throttled_all": _sql("""
            SELECT tick_id, t.ticker, date FROM ticks t
            JOIN chain_all c ON c.ticker = t.ticker AND c.last = t.date""", "chain_all"),
        "signal_messages": _sql("""
            SELECT '{"symbol":"' || ticker || '","signal_timestamp":"' || strftime(date, '%Y%m%d%H%M%S')
                   || '","action":"' || action
                   || '","typeAlloc":"amount","portAlloc":{"1":2.0,"2":1.0}}' AS body
            FROM directed""", "directed"),
        "signal_price_lookup": _sql("""
            SELECT date, ticker, price FROM (
                SELECT t.*, row_number() OVER (PARTITION BY date, ticker ORDER BY tick_id DESC) AS rn
                FROM ticks t WHERE (date, ticker) IN (
                    SELECT (date, ticker) FROM ticks WHERE kind = 'purchase')) WHERE rn = 1""", "ticks"),
        "last_order_numbers": _sql("SELECT day, last_number FROM used", "used"),
        "last_order_number_day": _sql(
            "SELECT coalesce(max(last_number), 0) AS last_number FROM used WHERE day = '980615'", "used"),
        "order_numbers": _sql("SELECT o_orderkey AS arrival, order_itag FROM numbered", "numbered"),
        "blotter_rows": _sql("""
            SELECT o_orderdate AS timestamp, order_itag, 'C' || o_custkey AS secId, secType,
                   action AS side, 3.0::DOUBLE AS tradeQty, 'LMT' AS orderType,
                   CAST(floor(o_totalprice) / 64 AS VARCHAR) AS orderParams,
                   'dumb_strat' AS placerId FROM numbered""", "numbered"),
        "alloc_explode": _sql("""
            SELECT o_orderdate AS timestamp, order_itag, port,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
                        THEN CASE port WHEN '1' THEN 2.0::DOUBLE ELSE 1.0 END
                        ELSE CASE port WHEN '1' THEN 0.75 ELSE 0.25 END END AS Alloc,
                   CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'amount'
                        ELSE 'percent' END AS typeAlloc
            FROM numbered, (VALUES ('1'), ('2')) v(port)""", "numbered"),
        "status_log": _sql("""
            SELECT order_itag, 'receivedByAutoPort' AS status, '' AS note, o_orderdate AS timestamp
            FROM numbered
            UNION ALL SELECT order_itag, CASE secType WHEN 'STK' THEN 'dispatchedToAutoExec'
                             ELSE 'deniedByRiskManager' END, '', o_orderdate FROM numbered""", "numbered"),
        "status_log_client_closed": """
            SELECT 'receivedByAutoPort' AS status, '' AS note, count(*) AS n FROM orders
            UNION ALL SELECT 'orderNotSent', 'AutoExec client is closed', count(*) FROM orders
            WHERE o_orderpriority <> '5-LOW'
            UNION ALL SELECT 'deniedByRiskManager', '', count(*) FROM orders
            WHERE o_orderpriority = '5-LOW'""",
        "risk_split": _sql("""
            SELECT secType = 'STK' AS confirmed, secType, count(*) AS n FROM numbered GROUP BY ALL""",
            "numbered"),
        "order_bodies": _sql("""
            SELECT 'C' || o_custkey AS symbol, 'LMT' AS orderType, action,
                   3.0::DOUBLE AS totalQuantity, floor(o_totalprice) / 64 AS lmtPrice, secType,
                   strftime(o_orderdate, '%Y%m%d%H%M%S') AS origination_time_stamp,
                   strftime(o_orderdate, '%y%m%d%H%M%S') AS confirmation_time_stamp, order_itag
            FROM numbered WHERE secType = 'STK'""", "numbered"),
        "placed_orders": _sql("""
            SELECT '250220' AS sessionId, o_orderkey AS api_internal_tag, 'IB' AS api_client,
                   3::BIGINT AS api_clientId, 'C' || o_custkey AS secId, secType,
                   'LMT' AS orderType, action AS side, 3.0::DOUBLE AS totalQty, order_itag,
                   o_orderdate AS placed_timestamp, 'open' AS status, 'dumb_strat' AS reply_to
            FROM numbered WHERE secType = 'STK'""", "numbered"),
        "open_orders": _sql("""
            SELECT sessionId, order_itag, secId, totalQty, placed_timestamp FROM record
            WHERE status = 'open' AND sessionId = (
                SELECT strftime(max(o_orderdate), '%y%m%d') FROM orders WHERE o_orderstatus = 'O')""", "record"),
        "filled_totals": _sql("""
            SELECT api_internal_tag, api_clientId, secId, sum(tradeQty) AS totalQty FROM flat
            GROUP BY ALL""", "flat"),
        "fill_match": _sql("SELECT * FROM matched", "matched"),
        "fill_match_session": _sql("""
            SELECT * FROM matched WHERE sessionId = (
                SELECT strftime(min(o_orderdate), '%y%m%d') FROM orders WHERE o_orderstatus = 'O')""", "matched"),
        "confirmation_log": _sql("""
            SELECT DISTINCT order_itag, 'fill_confirmed' AS status, '' AS note, TIMESTAMP '2025-02-20' AS timestamp
            FROM matched""", "matched"),
        "fill_record_rows": _sql(
            "SELECT * FROM matched UNION ALL SELECT * FROM matched WHERE side = 'BUY'", "matched"),
        "status_log_rows": _sql("""
            SELECT order_itag, 'receivedByAutoPort' AS status, '' AS note, o_orderdate AS timestamp
            FROM numbered
            UNION ALL SELECT order_itag, CASE secType WHEN 'STK' THEN 'orderNotSent'
                             ELSE 'deniedByRiskManager' END,
                      CASE secType WHEN 'STK' THEN 'AutoExec client is closed' ELSE '' END, o_orderdate
            FROM numbered""", "numbered"),
        "blotter_of_order": _sql("""
            SELECT o_orderdate AS timestamp, order_itag, 'C' || o_custkey AS secId, secType,
                   action AS side, 3.0::DOUBLE AS tradeQty, 'LMT' AS orderType,
                   CAST(floor(o_totalprice) / 64 AS VARCHAR) AS orderParams,
                   'dumb_strat' AS placerId FROM numbered
            WHERE order_itag = (SELECT min(order_itag) FROM numbered)""", "numbered"),
        "order_status_update": _sql("""
            SELECT order_itag,
                   CASE WHEN order_itag IN (SELECT order_itag FROM matched) THEN 'filled'
                        ELSE status END AS status,
                   CASE WHEN order_itag IN (SELECT order_itag FROM matched)
                        THEN TIMESTAMP '2025-02-20' ELSE status_timestamp END AS status_timestamp
            FROM record""", "record", "matched"),
        "filled_count_check": _sql("""
            SELECT n_orders, n_tags, n_orders = n_tags AS consistent FROM
                (SELECT count(*) AS n_orders FROM record
                 WHERE order_itag IN (SELECT order_itag FROM matched)),
                (SELECT count(DISTINCT order_itag) AS n_tags FROM matched)""", "record", "matched"),
        "fill_record_append": _sql("""
            SELECT secId, count(*) AS n, sum(tradeQty) AS tradeQty FROM (
                SELECT * FROM matched UNION ALL SELECT * FROM matched WHERE side = 'BUY')
            GROUP BY secId""", "matched"),
        "fill_confirmations": _sql("SELECT * FROM conf", "conf"),
        "stream_fill_match": _sql("SELECT * FROM matched", "matched"),
        "stream_fill_confirmations": _sql("SELECT * FROM conf", "conf"),
        "fill_events_encoded": _sql("""
            SELECT '{"order_itag":"' || order_itag || '","sessionId":"' || sessionId
                   || '","fill_timestamps":["' || replace(fill_timestamps, ',', '","') || '"]}' AS body
            FROM conf""", "conf"),
        "event_decode": _sql("""
            SELECT tick_id, CASE WHEN plain THEN 'content type' WHEN broken THEN 'not json' END AS rejected,
                   CASE WHEN NOT plain AND NOT broken THEN strftime(date, '%Y%m%d%H%M%S') END AS stamp,
                   CASE WHEN NOT plain AND NOT broken THEN table_name END AS table_name,
                   CASE WHEN NOT plain AND NOT broken THEN ticker END AS tickers,
                   CASE WHEN NOT plain AND NOT broken
                        THEN CAST(date_trunc('second', date) AS TIMESTAMP) END AS event_ts
            FROM msgs""", "msgs"),
        "event_admission": _sql("""
            SELECT tick_id, kind <> 'view' AS routed, table_name = 'us_equity' AS admitted,
                   table_name = 'us_equity' AND ticker = '7' AS triggers
            FROM msgs WHERE NOT plain AND NOT broken""", "msgs"),
        "event_times": _sql("""
            SELECT CAST(date_trunc('second', date) AS TIMESTAMP) AS event_ts FROM msgs
            WHERE NOT plain AND NOT broken AND table_name = 'us_equity'
            UNION SELECT fill_timestamp FROM matched""", "msgs", "matched"),
        "data_event_encode": _sql("""
            SELECT '{"timestamp":"' || t || '","table_name":"us_equity","tickers":["'
                   || string_agg(ticker, '","' ORDER BY ticker) || '"],"event":"new_data"}' AS body
            FROM (SELECT DISTINCT strftime(date, '%Y%m%d%H%M%S') AS t, ticker FROM ticks)
            GROUP BY t""", "ticks"),
        "event_coverage": _sql("""
            SELECT strftime(date, '%Y%m%d') AS timestamp, count(DISTINCT ticker) AS n_listed,
                   (SELECT count(DISTINCT ticker) FROM prices) AS n_held,
                   count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM prices) AS complete
            FROM prices GROUP BY date""", "prices"),
        "missing_tickers": _sql("""
            SELECT DISTINCT ticker FROM prices WHERE ticker NOT IN (
                SELECT ticker FROM prices WHERE date >= TIMESTAMP '2001-10-01')""", "prices"),
        "events_newer": """
            SELECT l_orderkey AS id, l_shipdate AS event_ts FROM lineitem
            WHERE l_shipdate > (SELECT max(o_orderdate) - INTERVAL 90 DAY FROM orders
                                WHERE o_orderstatus = 'F')""",
        "events_accepted": _sql("""
            SELECT CAST(date_trunc('day', date) AS TIMESTAMP) AS event_ts,
                   count(DISTINCT ticker)::INTEGER AS n_tickers FROM ticks
            WHERE date_trunc('day', date) > (SELECT max(date) FROM ticks WHERE date < TIMESTAMP '2024-01-10')
            GROUP BY 1 HAVING bool_or(ticker = (
                SELECT arg_max(ticker, date) FROM ticks WHERE date < TIMESTAMP '2024-01-10'))""", "ticks"),
        "stream_replay_positions": _sql(f"""
            SELECT timestamp, port, ticker, amount, {c('avgPrice')} AS avgPrice, {c('price')} AS price,
                   price_source, {c('mtm')} AS mtm FROM equity""", "equity"),
        "stream_late_recompute": _sql(f"""
            SELECT timestamp, port, ticker, amount, {c('avgPrice')} AS avgPrice, {c('price')} AS price,
                   price_source, {c('mtm')} AS mtm FROM equity""", "equity"),
        "stream_before_opening": _sql("SELECT * FROM equity", "equity", steps=early),
        "stream_before_opening_cash": _sql("""
            SELECT ts AS timestamp, port, ccy,
                   amount - CASE ccy WHEN 'USD' THEN spent ELSE 0 END AS amount,
                   amount - CASE ccy WHEN 'USD' THEN spent ELSE 0 END AS cost_basis
            FROM (SELECT s.ts, c.port, c.ccy, c.amount, sum(coalesce(n.cost, 0.0)) OVER (
                      PARTITION BY c.port, c.ccy ORDER BY s.step) AS spent
                  FROM steps s CROSS JOIN cash0 c
                  LEFT JOIN (SELECT port, step, sum(cost) AS cost FROM trades GROUP BY ALL) n
                  ON n.port = c.port AND n.step = s.step)""", "trades", "cash0", steps=early),
        "stream_events_positions": _sql(f"""
            SELECT timestamp, port, ticker, amount, {c('avgPrice')} AS avgPrice, {c('price')} AS price,
                   price_source, {c('mtm')} AS mtm FROM equity""", "equity", steps=with_fills),
        "stream_signal_messages": _sql("""
            SELECT d.ticker, price, action, strftime(date, '%Y%m%d%H%M%S') AS signal_timestamp FROM directed d
            JOIN chain c ON c.ticker = d.ticker AND c.last = d.date WHERE hop > 0""", "chain"),
        "stream_signals_throttled": _sql("""
            SELECT tick_id, t.ticker FROM ticks t
            JOIN chain_all c ON c.ticker = t.ticker AND c.last = t.date""", "chain_all"),
    }
