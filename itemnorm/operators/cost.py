"""Token usage, cost and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import duration_text, fixed_text

# Prices of one search, tokens per call, seconds per row and calls in parallel.
SEARCH_PRICE = {"google": 5.0 / 1000, "perplexity": 0.003}
PLAIN_TOKENS = (800, 100)
SEARCH_TOKENS = (1500, 150)
SIMPLE_TOKENS = (500, 150)
KEYWORD_SECONDS, CALL_SECONDS, SEARCH_SECONDS, WORKERS = 0.1, 8, 15, 10
MILLION = 1_000_000


def token_cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Cost at prices per million tokens; an unpriced model costs nothing."""
    cost = (input_tokens / MILLION) * price_in + (output_tokens / MILLION) * price_out
    return F.coalesce(cost, F.lit(0.0))


def search_cost(google: Column, perplexity: Column) -> Column:
    return (google / 1000) * 5.0 + perplexity * SEARCH_PRICE["perplexity"]


def usage_cost(usage: DataFrame, prices: DataFrame, seconds: str | None = None) -> DataFrame:
    """Requests, tokens, searches and cost per model. ``prices`` is a short list of models."""
    searches = {p: F.count_if(F.col("provider") == p).alias(f"{p}_searches") for p in SEARCH_PRICE}
    time = F.coalesce(F.sum(seconds), F.lit(0.0)) if seconds else F.lit(0.0)
    totals = usage.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        *searches.values(),
        time.alias("total_time"),
    )
    priced = totals.join(prices, "model", "left")
    ai = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input"), F.col("output"))
    web = search_cost(F.col("google_searches"), F.col("perplexity_searches"))
    return priced.select(
        "model",
        "requests",
        "input_tokens",
        "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "google_searches",
        "perplexity_searches",
        ai.alias("ai_cost"),
        web.alias("search_cost"),
        (ai + web).alias("total_cost"),
        "total_time",
        (F.col("total_time") / F.col("requests")).alias("avg_time_per_row"),
    )


def cost_estimate(
    batches: DataFrame, prices: DataFrame, keyword_rate: float, search_rate: float, provider: str = "perplexity"
) -> DataFrame:
    """Detailed estimate for batches ``(batch, model, num_rows)`` before a run."""
    n = F.col("num_rows")
    sized = batches.join(prices, "model", "left").withColumns(
        {
            "keyword_matches": F.floor(n * keyword_rate),
            "ai_calls": F.floor(n * (1 - keyword_rate)),
            "web_searches": F.floor(n * search_rate),
        }
    )
    plain = F.col("ai_calls") - F.col("web_searches")
    tokens = sized.withColumns(
        {
            "input_tokens": plain * PLAIN_TOKENS[0] + F.col("web_searches") * SEARCH_TOKENS[0],
            "output_tokens": plain * PLAIN_TOKENS[1] + F.col("web_searches") * SEARCH_TOKENS[1],
        }
    )
    ai = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input"), F.col("output"))
    none = F.lit(0)
    web = search_cost(*((F.col("web_searches"), none) if provider == "google" else (none, F.col("web_searches"))))
    seconds = n * KEYWORD_SECONDS + plain * CALL_SECONDS / WORKERS + F.col("web_searches") * SEARCH_SECONDS / WORKERS
    return tokens.select(
        "batch",
        "model",
        n.alias("total_rows"),
        "keyword_matches",
        "ai_calls",
        "web_searches",
        "input_tokens",
        "output_tokens",
        ai.alias("ai_cost"),
        web.alias("web_cost"),
        (ai + web).alias("total_cost"),
        seconds.alias("estimated_seconds"),
        (seconds / 60).alias("estimated_minutes"),
    )


def simple_estimate(batches: DataFrame, prices: DataFrame) -> DataFrame:
    """Short estimate: tokens and seconds per row by model; unknown for an unpriced one."""
    n = F.col("num_rows")
    priced = batches.join(prices, "model", "left")
    known = F.col("input").isNotNull()
    cost = token_cost(n * SIMPLE_TOKENS[0], n * SIMPLE_TOKENS[1], F.col("input"), F.col("output"))
    per_row = F.when(F.col("model").startswith("gpt-5"), F.lit(3.5)).otherwise(F.lit(4.0))
    seconds = F.when(known, n * per_row).otherwise(F.lit(0.0))
    return priced.select(
        "batch",
        "model",
        n.alias("total_rows"),
        F.when(known, F.concat(F.lit("$"), fixed_text(cost, 2))).otherwise(F.lit("Unknown")).alias("cost_text"),
        seconds.alias("seconds"),
        F.when(known, duration_text(seconds)).otherwise(F.lit("Unknown")).alias("time_text"),
    )
