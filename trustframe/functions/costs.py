"""Token and price estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustframe.functions import fixed


def text_tokens(length: Column, lang: Column) -> Column:
    """Tokens of a text of that many characters: three per token in Portuguese, else four."""
    per_token = F.when(F.startswith(F.lower(lang), F.lit("pt")), F.lit(3.0)).otherwise(F.lit(4.0))
    return F.when(F.coalesce(length, F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.floor(length / per_token)))


def image_tokens(width: Column, height: Column, detail: Column) -> Column:
    """Tokens of an image: 85, plus 170 for each 512-pixel tile after scaling when detailed."""
    largest = F.greatest(width, height)
    fit = F.when(largest > 2048, 2048.0 / largest).otherwise(F.lit(1.0))
    w, h = F.floor(width * fit), F.floor(height * fit)
    short = F.least(w, h)
    w2 = F.when(w < h, F.lit(768).cast("bigint")).otherwise(F.floor(w * (768.0 / short)))
    h2 = F.when(w < h, F.floor(h * (768.0 / short))).otherwise(F.lit(768).cast("bigint"))
    tiles = F.ceil(w2 / 512) * F.ceil(h2 / 512)
    plain = (F.lower(detail) == "low") | (width <= 0) | (height <= 0)
    return F.when(plain, F.lit(85).cast("bigint")).otherwise(tiles * 170 + 85)


def price(model: Column, side: str) -> Column:
    """Price per million tokens; a provider prefix is ignored, unknown models get the fallback."""
    index = {"input": 1, "output": 2}[side]
    table = F.create_map(*[F.lit(x) for row in fixed.MODEL_PRICES for x in (row[0], row[index])])
    name = F.lower(F.element_at(F.split(model, "/"), -1))
    return F.coalesce(F.element_at(table, name), F.lit(fixed.FALLBACK_PRICE[index - 1]))


def inference_cost(input_tokens: Column, output_tokens: Column, model: Column) -> Column:
    return (input_tokens / 1_000_000.0) * price(model, "input") + (
        output_tokens / 1_000_000.0) * price(model, "output")


def convert(costs: DataFrame, rates: DataFrame, usd: str, currency: str) -> DataFrame:
    """Add ``converted``: dollars in the row's currency. ``rates`` is (currency, per_usd)."""
    return (costs.join(rates.select(F.col("currency").alias(currency), "per_usd"), currency, "left")
            .withColumn("converted", F.col(usd) * F.coalesce("per_usd", F.lit(1.0))).drop("per_usd"))
