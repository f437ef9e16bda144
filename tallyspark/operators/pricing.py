"""The price dimension and what events cost by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values, in nano-dollars a token (milli-dollars a million): key, input, output, cache read, cache write, and
#: whether only the whole name matches.
PRICES = (
    ("claude-opus-4-5-thinking-high", 5000, 25000, 500, 6250, False),
    ("claude-opus-4-6", 5000, 25000, 500, 6250, False),
    ("claude-opus-4-5", 5000, 25000, 500, 6250, False),
    ("claude-opus-4", 15000, 75000, 1500, 18750, True),
    ("claude-sonnet-4-5-thinking-medium", 3000, 15000, 300, 3750, False),
    ("claude-sonnet-4-6", 3000, 15000, 300, 3750, False),
    ("claude-sonnet-4-5", 3000, 15000, 300, 3750, False),
    ("claude-sonnet-4", 3000, 15000, 300, 3750, False),
    ("claude-haiku-4-5", 1000, 5000, 100, 1250, False),
    ("claude-haiku-4", 1000, 5000, 100, 1250, False),
    ("gpt-5.6-sol", 5000, 30000, 500, 6250, False),
    ("gpt-5.6-terra", 2500, 15000, 250, 3125, False),
    ("gpt-5.6-luna", 1000, 6000, 100, 1250, False),
    ("gpt-5.5-pro", 30000, 180000, 0, 0, False),
    ("gpt-5.5", 5000, 30000, 500, 0, False),
    ("gpt-5.4", 2500, 15000, 250, 0, False),
    ("gpt-5.4-mini", 750, 4500, 75, 0, False),
    ("gpt-5.3-codex", 1750, 14000, 175, 0, False),
    ("gpt-5.2", 1750, 14000, 175, 0, False),
    ("gpt-5.2-codex", 1750, 14000, 175, 0, False),
    ("gpt-5.1-codex-mini", 250, 2000, 25, 0, False),
    ("gpt-5.1-codex-max", 1250, 10000, 125, 0, False),
    ("gpt-5.1-codex", 1250, 10000, 125, 0, False),
    ("gpt-5-codex", 1250, 10000, 125, 0, False),
    ("codex-mini-latest", 1500, 6000, 375, 0, False),
    ("gpt-5.2-pro", 21000, 168000, 0, 0, False),
    ("gpt-5", 1250, 10000, 125, 0, True),
    ("claude-4.5-sonnet-thinking", 3000, 15000, 300, 3750, False),
    ("claude-4.5-sonnet", 3000, 15000, 300, 3750, False),
    ("gemini-3-pro-high", 2000, 12000, 200, 0, False),
    ("gemini-3-flash", 500, 3000, 50, 0, False),
    ("gemini-3", 1250, 10000, 125, 0, True),
    ("grok-code-fast-1", 200, 1500, 20, 0, False),
    ("grok-code", 200, 1500, 20, 0, True),
    ("grok", 3000, 15000, 300, 0, True),
    ("zai-org/GLM-5.2", 1400, 4400, 1400, 1400, True),
    ("zai-org/GLM-5.2-Batch", 700, 2200, 700, 700, True),
)
RATES = ("input_rate", "output_rate", "cache_read_rate", "cache_write_rate")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "price_key string, input_rate long, output_rate long, cache_read_rate long, cache_write_rate long, exact_only boolean")


def resolve_prices(models: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """(model, price_key, match, the four rates) for each distinct model: its own key, else the longest that it begins with.

    The prices are a fixed table of a few dozen rows; the models are reduced to
    distinct names first, so the comparison by prefix is names times prices.
    """
    prices = F.broadcast(prices if prices is not None else price_table(models.sparkSession))
    names = models.select("model").where("model IS NOT NULL").distinct()
    fits = (F.col("model") == F.col("price_key")) | (~F.col("exact_only") & F.col("model").startswith(F.col("price_key")))
    best = Window.partitionBy("model").orderBy(F.desc(F.length("price_key")))
    ranked = names.join(prices, fits, "left").withColumn("_n", F.row_number().over(best)).where("_n = 1")
    match = F.when(F.col("price_key").isNull(), "missing").when(F.col("price_key") == F.col("model"), "exact").otherwise("prefix")
    return ranked.select("model", "price_key", match.alias("match"), *RATES)


def with_cost(events: DataFrame, reasoning: bool = True, prices: DataFrame | None = None) -> DataFrame:
    """events with price_known and cost_nano, exact in nano-dollars; unpriced models cost nothing.

    Reasoning tokens are priced as output, except for the sources that report
    none apart from it.
    """
    resolved = resolve_prices(events, prices).select("model", "price_key", *RATES)
    priced = events.join(resolved, "model", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = zero("output_tokens") + (zero("reasoning_tokens") if reasoning else F.lit(0))
    cost = zero("input_tokens") * zero("input_rate") + out * zero("output_rate") + zero("cache_read_tokens") * zero("cache_read_rate") + zero("cache_write_tokens") * zero("cache_write_rate")
    return priced.withColumns({"price_known": F.col("price_key").isNotNull(), "cost_nano": cost}).drop("price_key", *RATES)


def best_recorded_cost(actual: str, estimated: str, priced: str) -> F.Column:
    """The actual cost, else the estimated one, else the priced one, each if above zero."""
    above = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(above(actual), above(estimated), above(priced), F.lit(0.0))
