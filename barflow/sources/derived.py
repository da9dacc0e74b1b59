"""Bar, sector, news and prediction tables derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.nulls import change
from barflow.operators.ensemble import MODELS
from barflow.operators.labels import label_direction, time_folds
from barflow.operators.layout import Rows
from barflow.sources.scratch import cut_lineage

RETURN_BARS = (1, 3, 5, 10, 20)
STEEPNESS = 50.0
HORIZON = 5

# Words put in front of the headlines, fixed values.
FIRST_WORDS = ["Profit", "Surge", "Loss", "Fraud", "Update", "Record", "Crash"]
SECOND_WORDS = ["growth", "decline", "rally", "report", "risk"]
# Nations without a sector of their own.
NO_SECTOR = ("CANADA", "JAPAN")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the symbol and day they belong to."""
    line = table(spark, sf_dir, "lineitem").select(*AT, "l_shipdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # The nations are 25 rows at any scale; suppliers grow and are left to the optimizer.
    home = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return line.join(home, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("symbol"), F.to_date("l_shipdate").alias("ts"), *AT
    )


def _ratio() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def _price(ratio: Column) -> Column:
    return F.round(40 + F.ln(ratio), 4)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced line items: symbol, day, price, quantity and an order within the day."""
    return _sold(spark, sf_dir).select(
        "symbol", "ts", _price(_ratio()).alias("px"), F.col("l_quantity").alias("qty"), F.struct(*AT).alias("at")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per nation from the prices of its suppliers' line items, written once for all readers.

    The first and last price of a day need the whole order of the trades, which a hash aggregate cannot hold. So the days
    get the limits of the leading key first, and only trades at a limit are ordered. Prices rise with the ratio, so its
    limits give theirs. Days and the written bars are at most nations times calendar, whatever the number of trades.
    """
    key = F.coalesce("l_orderkey", F.lit(-(2**63)))  # NULL comes first, as in a struct
    sold = _sold(spark, sf_dir)
    priced = F.when(_ratio() > 0, _ratio())
    days = cut_lineage(
        sold.groupBy("symbol", "ts").agg(
            F.max(priced).alias("_most"), F.min(priced).alias("_least"), F.sum("l_quantity").alias("volume"),
            F.min(key).alias("_first"), F.max(key).alias("_last"),
        ),
        "days",
    )
    limits = F.broadcast(days.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), "_first", "_last"))
    same = F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("ts").eqNullSafe(F.col("_ts"))
    edge = sold.join(limits, same).where((key == F.col("_first")) | (key == F.col("_last")))
    ends = edge.groupBy("symbol", "ts").agg(
        F.min_by(_price(_ratio()), F.struct(*AT)).alias("open"), F.max_by(_price(_ratio()), F.struct(*AT)).alias("close")
    )
    ends = ends.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), "open", "close")
    high, low = _price(F.col("_most")).alias("high"), _price(F.col("_least")).alias("low")
    return cut_lineage(days.join(ends, same).select("symbol", "ts", "open", high, low, "close", "volume"), "bars")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a time of day: the minutes of every event type."""
    at = F.struct("ts", "event_id")
    price = F.round(F.col("value") + 10, 4)
    return (
        table(spark, sf_dir, "events").filter(F.col("value").isNotNull())
        .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("minute"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.sum((1 + F.col("user_id") % 50).cast("double")).alias("volume"),
        )
        .withColumnRenamed("minute", "ts")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(~F.col("n_name").isin(*NO_SECTOR))
        .select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    )


def market_index(panel: DataFrame) -> DataFrame:
    """One index bar per day: mean prices and total volume over the symbols.

    Prices are summed as decimals (bars have four places), so the means do not depend on the order of the rows.
    """
    def mean(c: str) -> Column:
        return (F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count(c)).alias(c)

    return (
        panel.groupBy("ts")
        .agg(*[mean(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))
        .select(F.lit("INDEX").alias("symbol"), "ts", "open", "high", "low", "close", "volume")
    )


def _word(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines per nation: two lexicon words before the start of a document."""
    docs = table(spark, sf_dir, "documents")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
    words = F.concat_ws(" ", _word(FIRST_WORDS, F.col("doc_id")), _word(SECOND_WORDS, F.col("doc_id")))
    published = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.col("doc_id").cast("int")
    )
    return docs.join(
        F.broadcast(nation), (F.col("doc_id") % 25).cast("int") == F.col("n_nationkey")
    ).select(
        "symbol",
        F.col("doc_id").alias("news_id"),
        F.when(F.col("doc_id") % 17 != 0, published).alias("published"),
        F.concat_ws(" ", words, F.substring("text", 1, 80)).alias("headline"),
        F.substring("text", 81, 2**31 - 1).alias("summary"),  # all the rest
        F.col("source").alias("publisher"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("link"),
    )


def raw_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The news as JSON items in flat and nested layouts, some keys empty."""
    n = news(spark, sf_dir)
    when = F.date_format("published", "yyyy-MM-dd HH:mm:ss")
    flat = F.to_json(
        F.struct(
            F.when(F.col("news_id") % 4 != 0, F.col("headline")).otherwise("").alias("title"),
            F.col("headline").alias("headline"),
            F.when(F.col("news_id") % 5 != 0, F.col("summary")).otherwise("").alias("summary"),
            F.lit("no summary").alias("description"),
            when.alias("pubDate"),
            "publisher",
            "link",
        )
    )
    nested = F.to_json(
        F.struct(
            F.struct(
                F.col("headline").alias("title"),
                F.when(F.col("news_id") % 5 != 0, F.col("summary")).alias("summary"),
                F.lit("nested description").alias("description"),
                when.alias("displayTime"),
                F.col("publisher").alias("provider"),
                F.struct(F.col("link").alias("url")).alias("canonicalUrl"),
            ).alias("content")
        )
    )
    return n.select("symbol", "news_id", F.when(F.col("news_id") % 3 == 0, nested).otherwise(flat).alias("item"))


def component_predictions(panel: DataFrame) -> DataFrame:
    """Surrogate model outputs: logistic of the 1-, 3-, 5-, 10- and 20-bar return."""
    r = Rows(panel, order=["ts"])
    probs = [
        F.struct(
            F.lit(m).alias("model"),
            (1.0 / (1.0 + F.exp(-STEEPNESS * change(F.col("close"), r.lag("close", n))))).alias("p_up"),
        )
        for m, n in zip(MODELS, RETURN_BARS)
    ]
    d = panel.select("symbol", "ts", F.array(*probs).alias("m"))
    return d.select("symbol", "ts", F.inline("m")).filter(F.col("p_up").isNotNull())


def predictions(panel: DataFrame) -> DataFrame:
    """Mean surrogate probability and share of the larger side of the models."""
    r = Rows(panel, order=["ts"])
    probs = F.array(
        *[1.0 / (1.0 + F.exp(-STEEPNESS * change(F.col("close"), r.lag("close", n)))) for n in RETURN_BARS]
    )
    d = panel.select("symbol", "ts", F.filter(probs, lambda p: p.isNotNull()).alias("p"))
    n, up = F.size("p"), F.size(F.filter("p", lambda p: p >= 0.5))
    total = F.aggregate("p", F.lit(0.0), lambda a, p: a + p)
    return d.filter(n > 0).select(
        "symbol", "ts", (total / n).alias("p_up"), (F.greatest(up, n - up) / n).alias("agreement")
    )


def oof(panel: DataFrame) -> DataFrame:
    """Surrogate out-of-fold table: validation rows of each fold with their label."""
    labelled = label_direction(panel, HORIZON).filter(F.col("target").isNotNull()).select("symbol", "ts", "target")
    folds = time_folds(labelled).filter("role = 'validation'")
    return folds.join(component_predictions(panel), ["symbol", "ts"]).select(
        "symbol", "ts", "fold", "model", "p_up", F.col("target").alias("actual")
    )


def validation_pairs(panel: DataFrame) -> DataFrame:
    """Mean out-of-fold probability per bar with its outcome."""
    return oof(panel).groupBy("symbol", "ts", "fold").agg(
        F.avg("p_up").alias("probability"), F.max("actual").cast("double").alias("actual")
    ).select("symbol", "ts", "probability", "actual")


def observations(features: DataFrame, probability: DataFrame) -> DataFrame:
    """Inputs of the signal engine: probability, agreement and six context scores."""
    scores = features.select(
        "symbol",
        "ts",
        (F.col("regime_score") / 5.0).alias("regime_score"),
        F.col("daily_trend_direction").cast("double").alias("trend_score"),
        (F.col("higher_timeframe_score") / 2.0).alias("mtf_score"),
        F.lit(0.0).alias("sentiment_score"),
        F.when(F.col("relative_volume") > 1.2, 1.0).when(F.col("relative_volume") < 0.8, -1.0).otherwise(0.0)
        .alias("volume_score"),
        F.when(F.col("regime_volatility_rank") > 0.8, -1.0).otherwise(0.0).alias("volatility_score"),
    )
    return probability.withColumnRenamed("p_up", "probability").join(scores, ["symbol", "ts"])

