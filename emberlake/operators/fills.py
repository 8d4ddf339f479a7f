"""Fills from raw log amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def derive(logs: DataFrame, collateral: str = "0") -> DataFrame:
    """logs: id, maker, taker, maker_asset, taker_asset, maker_amount, taker_amount. The smaller amount is the money: fewer
    from the maker is a sale (-1). Amounts are millionths; prices outside [1e-6, 1] are null; the contract is the asset that
    is not collateral, and rows with both or neither are flagged."""
    ma, ta = F.col("maker_amount"), F.col("taker_amount")
    sell = ma < ta
    usdc, size = F.least(ma, ta) / 1e6, F.greatest(ma, ta) / 1e6
    price = usdc / F.nullif(size, F.lit(0.0))
    mult = F.when(sell, -1).otherwise(1)
    m0, t0 = F.col("maker_asset") == collateral, F.col("taker_asset") == collateral
    return logs.select(
        "id", "maker", "taker", usdc.alias("usdc"), size.alias("size"), mult.alias("side_mult"), F.when(price.between(1e-6, 1.0), price).alias("price"),
        (size * mult).alias("tokens"), F.when(m0, F.col("taker_asset")).otherwise(F.col("maker_asset")).alias("contract_id"), (m0 == t0).alias("anomaly"),
    )


def ingest_filter(logs: DataFrame, exchanges: list[str]) -> DataFrame:
    """Without trades of a wallet with itself and of the exchanges' own addresses; null addresses stay."""
    own = lambda c: F.coalesce(F.col(c).isin(*exchanges), F.lit(False))
    return logs.where(~F.coalesce(F.col("maker") == F.col("taker"), F.lit(False)) & ~own("maker") & ~own("taker"))


def legs(fills: DataFrame) -> DataFrame:
    """Two rows per fill: the taker's, and the maker's with the side turned."""
    leg = lambda who, sign: F.struct(F.col(who).alias("wallet"), (F.col("side_mult") * sign).alias("side_mult"), F.lit(who).alias("role"))
    return fills.withColumn("leg", F.explode(F.array(leg("taker", 1), leg("maker", -1)))).select("id", "contract_id", "usdc", "price", "leg.*")
