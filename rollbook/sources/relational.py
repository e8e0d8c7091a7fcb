"""Valuation snapshot and net asset values from relational tables registered as views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.schemas import SNAPSHOT, conform

# Currency codes of the source system and their ISO names.
CURRENCIES = {"DOL": "USD", "NSOL": "PEN"}

_SNAPSHOT_SQL = """
SELECT h.Cantidad, h.CodigoPortafolioSBS AS Portafolio, h.CodigoMnemonico AS Name,
       s.CodigoISIN AS ISIN, s.CodigoSBS, s.TipoRenta, s.ValorUnitario,
       h.ValorCausadoOriginal, h.ValorCausadoLocal, h.VPNOriginal, h.VPNLocal,
       s.CodigoMoneda AS Moneda, s.FechaVencimiento
FROM {holdings} h LEFT JOIN {securities} s ON h.CodigoMnemonico = s.CodigoNemonico
WHERE h.Escenario = :scenario AND h.FechaValoracion = :day
"""


def snapshot(
    spark: SparkSession, holdings: DataFrame, securities: DataFrame, day: int,
    scenario: str = "REAL",
) -> DataFrame:
    """Holdings of one valuation day with their security data, currencies recoded."""
    joined = spark.sql(
        _SNAPSHOT_SQL, args={"scenario": scenario, "day": day},
        holdings=holdings, securities=securities)
    return recode(conform(joined, SNAPSHOT), "Moneda", CURRENCIES)


def recode(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Replace listed codes, keep others."""
    return df.replace(names, subset=[column])


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
               partitions: int, **options: str) -> DataFrame:
    """A relational table read in `partitions` ranges of `key`."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
        .option("numPartitions", partitions).load())


def nav(indicators: DataFrame, day: int, ports: Sequence[str], indicator: str = "VALFON"
        ) -> DataFrame:
    """Net asset value of some funds on one day."""
    return indicators.where(
        (F.col("Fecha") == F.lit(day)) & F.col("CodigoPortafolioSBS").isin(*ports)
        & (F.col("CodigoIndicador") == indicator)
    ).select(
        F.col("Valor").alias("Patrimonio"), F.col("CodigoPortafolioSBS").alias("Fondo"), "Fecha")


def fund_lots(snap: DataFrame, names: Sequence[str], ccy: str = "USD",
              rename: dict[str, str] | None = None) -> DataFrame:
    """Opening lots from a snapshot: holdings whose name contains one of `names`, with unit cost."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.col("Name").contains(name)
    lots = snap.where(hit).select(
        F.col("Portafolio").cast("string").alias("port"), F.col("Cantidad").alias("amount"),
        F.try_divide("VPNOriginal", "Cantidad").alias("cost_basis"), F.lit(ccy).alias("ccy"),
        F.col("Name").alias("ticker"))
    return recode(lots, "ticker", rename) if rename else lots
