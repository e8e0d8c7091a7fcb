"""Small books: literal tables, random fills, and a step-by-step loop to check against."""

import datetime as dt
import random

from rollbook import schemas

T0 = dt.datetime(2025, 1, 1)


def at(n: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=n)


FILL_COLUMNS = (
    "secType string, secId string, order_itag string, side string, tradeQty double, "
    "avgPrice double, commission double, fill_timestamp timestamp_ntz, totalQty double")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fill(hour, ticker, order, side, qty, price, total=None, fee=0.0):
    return ("STK", ticker, order, side, float(qty), float(price), fee, at(hour),
            float(total or qty))


def alloc(order, port, share, kind="percent", hour=0.0):
    return (at(hour), order, port, float(share), kind)


def tables(spark, fills, allocs, prices):
    return (
        frame(spark, fills, FILL_COLUMNS), frame(spark, allocs, schemas.BLOTTER_ALLOC),
        frame(spark, prices, schemas.PRICES))


def cash_rows(ports, hour=0.0):
    return [(at(hour), p, "USD", 1000.0, 1000.0) for p in ports]


def random_book(seed, steps=12, tickers=3, fills=60):
    rnd = random.Random(seed)
    names = [f"T{i}" for i in range(tickers)]
    f, a, p = [], [], []
    for n in range(fills):
        order = f"o{n}"
        kind = rnd.choice(["percent", "amount"])
        # Whole quantities in binary shares, so that positions close exactly.
        qty = rnd.choice([4, 8])
        f.append(fill(rnd.choice([rnd.uniform(0.1, steps - 1), rnd.randint(1, steps - 1)]),
                      rnd.choice(names), order, rnd.choice(["BUY", "SELL"]), qty,
                      rnd.randint(50, 60), fee=rnd.choice([0.0, 0.25])))
        shares = {"percent": [("1", 0.75), ("2", 0.25)], "amount": [("1", 2), ("2", 1)]}[kind]
        a += [alloc(order, port, x, kind) for port, x in shares]
    for s in range(1, steps):
        for t in names:
            if rnd.random() < 0.4:
                p.append((at(s), t, float(rnd.randint(50, 60)), at(s)))
    return f, a, p


def loop(grid, fills, allocs, prices, opening=()):
    """Rolls positions one step after another; returns rows keyed by (time, port, ticker)."""
    market = {(d, t): x for d, t, x, _ in prices}
    latest = {}
    for ts, order, port, share, kind in sorted(allocs, key=lambda r: r[0]):
        latest[order, port] = (share, kind)
    held = {k: dict(v) for k, v in opening}
    out = {}
    for prev, now in zip(grid, grid[1:]):
        trades = {}
        for _, ticker, order, side, qty, price, fee, ts, total in fills:
            if not prev < ts <= now:
                continue
            sign = 1 if side == "BUY" else -1
            for (o, port), (share, kind) in latest.items():
                if o == order:
                    w = share / total if kind == "amount" else share
                    t = trades.setdefault((ticker, port), [0.0, 0.0])
                    t[0] += sign * qty * w
                    t[1] += (sign * price * qty + fee) * w
        after = {}
        for key in set(trades) | {k for k, h in held.items() if h["amount"] != 0}:
            h = held.get(key)
            if h is None or h["amount"] == 0:
                h = {"amount": 0.0, "avg": 0.0, "mtm": 0.0, "price": None}
            dq, cost = trades.get(key, (0.0, 0.0))
            amount = h["amount"] + dq
            amount = 0.0 if abs(amount) < 1e-9 else amount
            avg = (h["amount"] * h["avg"] + cost) / amount if amount else 0.0
            if (now, key[0]) in market:
                price, source = market[now, key[0]], "vector"
            elif key in trades and abs(dq) > 1e-9:
                price, source = cost / dq, "trade"
            else:
                price, source = h["price"], "last_mtm"
            mtm = price * amount if amount else 0.0
            pnl = mtm - cost - h["mtm"]
            if h["amount"] == 0:
                ret = mtm / cost - 1 if cost else None
            else:
                ret = pnl / h["mtm"] if h["mtm"] else None
            after[key] = {"amount": amount, "avg": avg, "mtm": mtm, "price": price}
            out[now, key[1], key[0]] = (amount, avg, cost, price, source, mtm, pnl, ret)
        held = after
    return out


def collected(equity):
    return {
        (r.timestamp, r.port, r.ticker): (
            r.amount, r.avgPrice, r.trade_cost_basis, r.price, r.price_source, r.mtm, r.pnl, r.ret)
        for r in equity.collect()}


def assert_same(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        for x, y in zip(got[key], row):
            if isinstance(y, float):
                assert x is not None and abs(x - y) <= 1e-6 * max(1.0, abs(y)), (key, got[key], row)
            else:
                assert x == y, (key, got[key], row)


def fields(schema):
    return [(f.name, f.dataType) for f in schema]
