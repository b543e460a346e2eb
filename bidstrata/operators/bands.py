"""Band reshaping and bid curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstrata.schema import ENERGY, PRICE_BANDS, QUANTITY_BANDS, REGIONAL_PRICES, SERVICES


def _long(df: DataFrame, ids: Sequence[str], names: Mapping[str, str], var_name: str, value_name: str) -> DataFrame:
    """One row per column of ``names`` (column → its label), nulls included.

    An explode rather than ``unpivot``: two uses of the same long table then compare equal and share one shuffle.
    """
    cells = F.array(*[F.struct(F.lit(label).alias("k"), F.col(c).alias("v")) for c, label in names.items()])
    return df.select(*ids, F.explode(cells).alias("_c")).select(
        *ids, F.col("_c.k").alias(var_name), F.col("_c.v").alias(value_name)
    )


def bands_long(
    df: DataFrame, ids: Sequence[str], bands: Sequence[str] = PRICE_BANDS,
    var_name: str = "PRICEBAND", value_name: str = "PRICE",
) -> DataFrame:
    """One row per band, null bands included."""
    return _long(df, ids, {b: b for b in bands}, var_name, value_name)


def changes_long(
    df: DataFrame, ids: Sequence[str], bands: Sequence[str] = PRICE_BANDS,
    var_name: str = "PRICEBAND", value_name: str = "PRICE_CHANGE",
) -> DataFrame:
    """One row per band change, labelled with the band's own name."""
    return _long(df, ids, {f"{b}_CHANGE": b for b in bands}, var_name, value_name)


def band_number(col: str = "PRICEBAND") -> Column:
    return F.regexp_extract(col, r"(\d+)$", 1).try_cast("int")


def first_bands(df: DataFrame, n: int, col: str = "PRICEBAND") -> DataFrame:
    """Bands 1 to ``n`` of a long table."""
    return df.where(band_number(col) <= n)


def regional_prices_long(
    df: DataFrame, ids: Sequence[str] = ("SETTLEMENTDATE", "REGIONID"), prices: Sequence[str] = REGIONAL_PRICES
) -> DataFrame:
    """Region × interval × service × price from the wide price table; plain RRP is the energy price."""
    return _long(df, ids, {p: p.removesuffix("RRP") or ENERGY for p in prices}, "BIDTYPE", "PRICE")


def dispatch_load_long(
    df: DataFrame, ids: Sequence[str] = ("SETTLEMENTDATE", "DUID"), services: Sequence[str] = SERVICES,
    energy: str = "TOTALCLEARED",
) -> DataFrame:
    """Unit × interval × service × MW from the wide dispatch table, cleared energy as ENERGY. Services the table lacks
    and cells without a value have no row."""
    names = {energy: ENERGY, **{s: s for s in services if s in df.columns}}
    return _long(df, ids, names, "BIDTYPE", "MW").where("MW IS NOT NULL")


def total_mw(bands: Sequence[str] = QUANTITY_BANDS) -> Column:
    total = F.lit(0.0)
    for b in bands:
        total = total + F.coalesce(F.col(b), F.lit(0.0))
    return total


def weighted_price(prices: Sequence[str] = PRICE_BANDS, mws: Sequence[str] = QUANTITY_BANDS) -> Column:
    """MW-weighted offer price of a row, null where nothing is offered. A band lacking price or MW is left out."""
    value, mw = F.lit(0.0), F.lit(0.0)
    for p, q in zip(prices, mws, strict=True):
        whole = F.col(p).isNotNull() & F.col(q).isNotNull()
        value = value + F.when(whole, F.col(p) * F.col(q)).otherwise(0.0)
        mw = mw + F.when(whole, F.col(q)).otherwise(0.0)
    return F.when(mw > 0, F.try_divide(value, mw))


def weighted_offer_price(
    panel: DataFrame, prices: Sequence[str] = PRICE_BANDS, mws: Sequence[str] = QUANTITY_BANDS
) -> DataFrame:
    """Add ``offer_mw`` and ``offer_price``."""
    return panel.withColumns({"offer_mw": total_mw(mws), "offer_price": weighted_price(prices, mws)})


def bid_curve(
    panel: DataFrame, ids: Sequence[str], n_bands: int = 10,
    price_prefix: str = "PRICEBAND", mw_prefix: str = "BANDAVAIL",
) -> DataFrame:
    """Steps of each offer's curve: cumulative MW from 0, the last price repeated at the end.

    Rows: ``ids``, ``step`` (0..n_bands), ``cum_mw``, ``price``. A missing band leaves the rest of its curve null.
    """
    prices = [F.col(f"{price_prefix}{i}") for i in range(1, n_bands + 1)]
    mw, steps = F.lit(0.0), []
    for i in range(n_bands + 1):
        price = prices[min(i, n_bands - 1)]
        steps.append(F.struct(mw.alias("cum_mw"), price.alias("price")))
        if i < n_bands:
            mw = mw + F.col(f"{mw_prefix}{i + 1}")
    return panel.select(*ids, F.posexplode(F.array(*steps)).alias("step", "_s")).select(
        *ids, "step", F.col("_s.cum_mw").alias("cum_mw"), F.col("_s.price").alias("price")
    )
