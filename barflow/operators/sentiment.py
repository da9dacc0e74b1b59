"""Lexicon sentiment of news texts, per item and per symbol.

Scoring is a projection of built-in functions over the whole text: no join and
no exchange, so the same code runs on a stream.  Word lists are set lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions import lexicon
from barflow.functions.nulls import clip

LABEL_AT = 0.20
NEWEST = 10

NEWS_ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "title", "headline", "summary", "description", "providerPublishTime", "pubDate", "published",
        "publisher", "link", "url",
    )]
    + [
        T.StructField(
            "content",
            T.StructType(
                [T.StructField(n, T.StringType()) for n in (
                    "title", "summary", "description", "pubDate", "displayTime", "provider",
                )]
                + [T.StructField("canonicalUrl", T.StructType([T.StructField("url", T.StringType())]))]
            ),
        )
    ]
)


def clean_text(text: Column) -> Column:
    """Lower-case words and digits without tags, links and punctuation."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?U)https?://\S+|www\.\S+", " ")
    t = F.regexp_replace(t, r"[^a-zA-Z0-9\s'-]", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def tokenize(cleaned: Column) -> Column:
    return F.regexp_extract_all(F.lower(cleaned), F.lit(r"([a-zA-Z]+(?:'[a-zA-Z]+)?)"), F.lit(1))


def token_weight(token: Column) -> Column:
    return (
        F.when(token.isin(lexicon.STRONG_POSITIVE), 2.0)
        .when(token.isin(lexicon.STRONG_NEGATIVE), -2.0)
        .when(token.isin(lexicon.POSITIVE), 1.0)
        .when(token.isin(lexicon.NEGATIVE), -1.0)
        .otherwise(0.0)
    )


def lexicon_score(tokens: Column) -> Column:
    """Sum of word weights over twice the root of the text length, in [-1, 1]."""
    total = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + token_weight(t))
    score = total / F.sqrt(F.size(tokens)) / 2.0
    return F.when(F.size(tokens) > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).otherwise(0.0)


def sentiment_label(score: Column) -> Column:
    return F.when(score >= LABEL_AT, "POSITIVE").when(score <= -LABEL_AT, "NEGATIVE").otherwise("NEUTRAL")


def score_headlines(news: DataFrame) -> DataFrame:
    """Add score and label of headline and summary; works on batches and streams."""
    both = F.trim(F.concat_ws(" ", clean_text(F.col("headline")), clean_text(F.col("summary"))))
    d = news.select("*", tokenize(both).alias("_tokens"))
    d = d.select(*news.columns, lexicon_score(F.col("_tokens")).alias("sentiment_score"))
    return d.select("*", sentiment_label(F.col("sentiment_score")).alias("sentiment"))


def _first(*names: str) -> Column:
    """First field that is neither missing nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def normalize_news(raw: DataFrame, item: str = "item") -> DataFrame:
    """Flat news rows from JSON items with flat or nested ``content`` fields."""
    kept = [c for c in raw.columns if c != item]
    d = raw.select(*kept, F.from_json(item, NEWS_ITEM).alias("_i"))
    none = F.lit("")
    return d.select(
        *kept,
        F.coalesce(_first("_i.title", "_i.headline", "_i.content.title"), none).alias("headline"),
        F.coalesce(
            _first("_i.summary", "_i.description", "_i.content.summary", "_i.content.description"), none
        ).alias("summary"),
        _first(
            "_i.providerPublishTime", "_i.pubDate", "_i.published", "_i.content.pubDate", "_i.content.displayTime"
        ).alias("published"),
        F.coalesce(_first("_i.publisher", "_i.content.provider"), none).alias("publisher"),
        F.coalesce(_first("_i.link", "_i.url", "_i.content.canonicalUrl.url"), none).alias("link"),
    )


def published_time(published: Column) -> Column:
    """Time of a publication text: epoch seconds or a date and time."""
    seconds = published.try_cast("bigint")
    return F.coalesce(F.timestamp_seconds(seconds).cast("timestamp_ntz"), published.try_cast("timestamp_ntz"))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """Mean score, label counts and ratios per symbol."""
    c = F.col
    # Counting scores instead of filtering them keeps the scan from scoring twice.
    known = c("sentiment_score").isNotNull()
    d = scored.groupBy("symbol").agg(
        F.avg("sentiment_score").alias("score"),
        F.count("sentiment_score").alias("articles"),
        *[F.count_if(known & (c("sentiment") == s.upper())).alias(s) for s in ("positive", "neutral", "negative")],
    ).filter("articles > 0")
    return d.select(
        "symbol",
        "score",
        sentiment_label(c("score")).alias("label"),
        "articles",
        "positive",
        "neutral",
        "negative",
        (c("positive") / c("articles")).alias("positive_ratio"),
        (c("negative") / c("articles")).alias("negative_ratio"),
        F.abs("score").alias("sentiment_strength"),
    )


def fill_no_news(joined: DataFrame) -> DataFrame:
    """Values of a summary for symbols without news, after an outer join."""
    zero = {"score": 0.0, "positive_ratio": 0.0, "negative_ratio": 0.0, "sentiment_strength": 0.0,
            "articles": 0, "positive": 0, "neutral": 0, "negative": 0, "label": "NO DATA"}
    return joined.na.fill({k: v for k, v in zero.items() if k in joined.columns})


def recent_sentiment(scored: DataFrame, newest: int = NEWEST) -> DataFrame:
    """Mean of the newest items per symbol, the newest weighing most.

    The rank filter becomes a group limit before the exchange: each map task
    passes on at most ``newest`` rows per symbol, however hot the symbol is.
    """
    c = F.col
    w = Window.partitionBy("symbol").orderBy("_missing", c("published").desc_nulls_last(), c("news_id"))
    d = scored.select(
        "symbol", "news_id", "published", "sentiment_score", c("sentiment_score").isNull().alias("_missing")
    )
    d = d.select("*", F.row_number().over(w).alias("_rank")).filter((c("_rank") <= newest) & ~c("_missing"))
    d = d.groupBy("symbol").agg(
        F.max("_rank").alias("_n"),
        F.sum("sentiment_score").alias("_sum"),
        F.sum(c("sentiment_score") * c("_rank")).alias("_ranked"),
    )
    weights = c("_n") * (c("_n") + 1) / 2.0
    mean = ((c("_n") + 1) * c("_sum") - c("_ranked")) / weights
    return d.select("symbol", clip(mean, -1.0, 1.0).alias("recent_score"))


def symbol_sentiment(raw: DataFrame) -> DataFrame:
    """Summary and recent score per symbol from raw news items."""
    news = normalize_news(raw).withColumn("published", published_time(F.col("published")))
    scored = score_headlines(news)
    return sentiment_summary(scored).join(recent_sentiment(scored), "symbol", "left")
