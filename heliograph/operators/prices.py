"""What counts as a usable price, and one reading per source and minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The tickers whose rows carry one scalar price.
PRICE_TICKERS = ("ETH", "ETHHITFIRST", "ETHLBFGS", "BTCLBFGS", "CADUSD", "NZDUSD", "CHFUSD", "XAGUSD")


def usable(price: Column) -> Column:
    """True for a price that is present, finite and above zero (never null)."""
    return F.coalesce((price > 0) & ~F.isnan(price) & (price < F.lit(float("inf"))), F.lit(False))


def impossible(price: Column) -> Column:
    """True for a negative or infinite price; 0.0, NaN and null are missing instead."""
    return F.coalesce(~F.isnan(price) & ((price < 0) | (price == F.lit(float("inf")))), F.lit(False))


def price_rows(challenge: DataFrame, tickers: tuple[str, ...] = PRICE_TICKERS) -> DataFrame:
    """The rows of price tickers with a known minute; columns ticker, sidx, ts, price."""
    return challenge.where(F.col("ticker").isin(*tickers) & F.col("sidx").isNotNull()).select("ticker", "sidx", "ts", "price")


def last_delivery() -> Column:
    """Aggregate: the usable price delivered last (largest ts; the larger price on equal ts; null ts first)."""
    chosen = F.max(F.when(usable(F.col("price")), F.struct("ts", "price")))
    return chosen["price"]


def usable_rows(challenge: DataFrame, tickers: tuple[str, ...] = PRICE_TICKERS) -> DataFrame:
    """Price rows with a usable price; the plain comparison reaches the Parquet scan."""
    return price_rows(challenge, tickers).where(F.col("price") > 0).where(usable(F.col("price")))


def readings(challenge: DataFrame, tickers: tuple[str, ...] = PRICE_TICKERS) -> DataFrame:
    """One usable reading per (ticker, sidx); map-side combine absorbs repeated deliveries."""
    rows = usable_rows(challenge, tickers)
    return rows.groupBy("ticker", "sidx").agg(last_delivery().alias("price"))
