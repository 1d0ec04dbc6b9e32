"""Market message streams: decode, publish, ingest.

A message is a JSON object ``{kind, symbol, timestamp, close, volume}`` with kind
trade | quote | bar; one record may hold a list of messages. Decoding is written
on plain DataFrames, so the same code runs in batch and in a stream; a record
that is not JSON, or a message without kind, symbol or time, goes to the
quarantine output instead of stopping the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

MESSAGE = StructType([StructField("kind", StringType()), StructField("symbol", StringType()),
                      StructField("timestamp", StringType()), StructField("close", DoubleType()),
                      StructField("volume", DoubleType())])
KINDS = ["trade", "quote", "bar"]


def read_market_stream(spark: SparkSession, fmt: str, path: str | None = None,
                       options: dict | None = None) -> DataFrame:
    """Raw records as ``value string``. ``fmt="kafka"`` takes the usual Kafka options
    (``kafka.bootstrap.servers``, ``subscribe`` = market_data); file formats read
    one file per micro-batch, oldest first."""
    opts = dict(options or {})
    if fmt == "kafka":
        opts.setdefault("maxOffsetsPerTrigger", "1000000")      # bounds the rows of a micro-batch, and of a key in it
        return (spark.readStream.format("kafka").options(**opts).load()
                .select(F.col("value").cast("string").alias("value")))
    opts.setdefault("maxFilesPerTrigger", "1")
    return spark.readStream.format("text").options(**opts).load(path)


def decode_messages(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good messages, quarantined records). Good: ``kind, symbol, timestamp
    (timestamp_ntz), close, volume``."""
    v = F.trim(F.col(value))
    msgs = F.when(v.startswith("["), F.from_json(v, ArrayType(MESSAGE)))\
        .otherwise(F.array(F.from_json(v, MESSAGE)))
    p = raw.select(F.col(value).alias("_raw"), msgs.alias("_m"))
    e = p.select("_raw", F.explode_outer("_m").alias("m"))
    ts = F.col("m.timestamp").try_cast("timestamp_ntz")
    ok = (F.col("m").isNotNull() & F.col("m.kind").isin(KINDS) & F.col("m.symbol").isNotNull()
          & ts.isNotNull())
    good = e.filter(ok).select("m.kind", "m.symbol", ts.alias("timestamp"), "m.close", "m.volume")
    bad = e.filter(~F.coalesce(ok, F.lit(False))).select(F.col("_raw").alias("value"))
    return good, bad


def encode_messages(df: DataFrame, kind: str | None = None) -> DataFrame:
    """S3: ``key`` = symbol, ``value`` = the message as JSON text."""
    k = F.lit(kind) if kind else F.col("kind")
    return df.select(F.col("symbol").alias("key"),
                     F.to_json(F.struct(k.alias("kind"), "symbol",
                                        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                                        .alias("timestamp"), "close", "volume")).alias("value"))


def write_market_stream(df: DataFrame, fmt: str, checkpoint: str, path: str | None = None,
                        options: dict | None = None, trigger_once: bool = True):
    """S3: publish encoded messages (Kafka topic, or files for tests)."""
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**(options or {}))
    if path:
        w = w.option("path", path)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def ingest_bars(raw: DataFrame, watchlist: DataFrame | None, path: str, checkpoint: str,
                quarantine: str | None = None):
    """Decode, keep bars of monitored symbols, add them to the bar table; broken records go to ``quarantine``.

    One source and one decode feed both sinks: a micro-batch is decoded once and written twice, each under its batch
    id (a replayed batch replaces itself). The watchlist is a static table joined to each micro-batch.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        good, bad = decode_messages(df)
        bars = good.filter(F.col("kind") == "bar").select("symbol", "timestamp", "close", "volume")
        if watchlist is not None:
            bars = bars.join(watchlist.select("symbol"), "symbol", "left_semi")
        bars.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if quarantine:
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        df.unpersist()
    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
