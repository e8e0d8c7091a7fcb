"""Table schemas, conforming and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _S, _TS = T.DoubleType(), T.LongType(), T.StringType(), T.TimestampNTZType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PRICES = _schema(date=_TS, ticker=_S, price=_D, timestamp_write=_TS)

ORDERS = _schema(
    sessionId=_S, api_internal_tag=_L, api_client=_S, api_clientId=_L, secId=_S, secType=_S,
    orderType=_S, side=_S, totalQty=_D, order_itag=_S, placed_timestamp=_TS, status=_S,
    status_timestamp=_TS, reply_to=_S,
)

FILLS = _schema(
    sessionId=_S, api_internal_tag=_L, api_client=_S, api_clientId=_L, secId=_S, secType=_S,
    orderType=_S, side=_S, totalQty=_D, order_itag=_S, placed_timestamp=_TS,
    fill_timestamp=_TS, avgPrice=_D, commission=_D, tradeQty=_D,
)

BLOTTER = _schema(
    timestamp=_TS, order_itag=_S, secId=_S, secType=_S, side=_S, tradeQty=_D, orderType=_S,
    orderParams=_S, placerId=_S,
)

BLOTTER_ALLOC = _schema(timestamp=_TS, order_itag=_S, port=_S, Alloc=_D, typeAlloc=_S)

BLOTTER_LOG = _schema(order_itag=_S, status=_S, note=_S, timestamp=_TS)

EQUITY = _schema(
    timestamp=_TS, port=_S, ticker=_S, amount=_D, avgPrice=_D, trade_cost_basis=_D, price=_D,
    price_source=_S, mtm=_D, pnl=_D, ret=_D,
)

CASH = _schema(timestamp=_TS, port=_S, ccy=_S, amount=_D, cost_basis=_D)

SNAPSHOT = _schema(
    Cantidad=_D, Portafolio=_L, Name=_S, ISIN=_S, CodigoSBS=_S, TipoRenta=_S, ValorUnitario=_D,
    ValorCausadoOriginal=_D, ValorCausadoLocal=_D, VPNOriginal=_D, VPNLocal=_D, Moneda=_S,
    FechaVencimiento=_S,
)

DATA_EVENT = _schema(timestamp=_S, table_name=_S, tickers=T.ArrayType(_S), event=_S)

FILL_EVENT = _schema(order_itag=_S, sessionId=_S, fill_timestamps=T.ArrayType(_S))

SIGNAL = _schema(
    symbol=_S, orderType=_S, lmtPrice=_D, signal_timestamp=_S, secType=_S, totalQuantity=_D,
    portAlloc=T.MapType(_S, _D), typeAlloc=_S, action=_S,
)

BROKER_FILL = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("contract", _schema(symbol=_S)),
    T.StructField("execution", _schema(
        acctNumber=_S, exchange=_S, side=_S, shares=_D, price=_D, permId=_L, clientId=_L,
        orderId=_L, cumQty=_D, avgPrice=_D)),
    T.StructField("commissionReport", _schema(commission=_D)),
])

# Security kinds a portfolio may hold and the fields each must bring.
SUPPORTED = {
    "equity": _schema(amount=_D, cost_basis=_D, ticker=_S, port=_S, timestamp=_TS),
    "cash": _schema(ccy=_S, amount=_D, cost_basis=_D, port=_S, timestamp=_TS),
}


class SchemaError(ValueError):
    """A table does not bring the fields it must."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to the stored columns, dropping any others."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def schema_faults(df: DataFrame, required: T.StructType) -> list[str]:
    """Names of required fields that are missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in required if have.get(f.name) != f.dataType]


def validate_holdings(tables: dict[str, DataFrame]) -> None:
    """Reject unsupported security kinds and tables with missing or mistyped fields."""
    unknown = sorted(set(tables) - set(SUPPORTED))
    if unknown:
        raise SchemaError(f"security kind not supported: {unknown}")
    faults = {k: schema_faults(df, SUPPORTED[k]) for k, df in tables.items()}
    faults = {k: v for k, v in faults.items() if v}
    if faults:
        raise SchemaError(f"missing or non-conforming fields: {faults}")


def field_completeness(df: DataFrame, required: T.StructType, table: str) -> DataFrame:
    """One row per required field with its count of non-null values, after a schema check."""
    faults = schema_faults(df, required)
    if faults:
        raise SchemaError(f"missing or non-conforming fields in {table}: {faults}")
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(f.name).alias(f.name) for f in required])
    pairs = F.array(*[
        F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("n_filled")) for f in required])
    return (
        counts.select("n_rows", F.explode(pairs).alias("p"))
        .select(F.lit(table).alias("table_name"), "p.field", "p.n_filled", "n_rows"))
