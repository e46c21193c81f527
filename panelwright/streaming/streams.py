"""Quote streams: bars, incremental loads, drift monitor and streaming screen."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from panelwright.config import Band, DriftRule
from panelwright.session import fresh_path
from panelwright.sources.ingest import upsert_table

WATERMARK = "10 minutes"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """JSON quotes of a Kafka topic as a stream; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_quotes(raw)


def parse_quotes(raw: DataFrame) -> DataFrame:
    """(ts, symbol, price, size) from messages whose ``value`` is a JSON object; broken messages are dropped."""
    q = F.from_json(F.col("value").cast("string"), "ts timestamp, symbol string, price double, size double")
    return raw.select(q.alias("q")).select("q.*").where(
        F.col("ts").isNotNull() & F.col("symbol").isNotNull() & F.col("price").isNotNull()
    )


def quotes(stream: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """(ts, symbol, price, size) of the subscribed symbols; the event time becomes a timestamp."""
    q = stream.select(F.col("ts").cast("timestamp").alias("ts"), "symbol", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"))
    return q if symbols is None else q.where(F.col("symbol").isin(*symbols))


def handle(stream: DataFrame, handler: Callable[[DataFrame, int], None], label: str = "quotes"):
    """Run ``handler(batch, id)`` on every micro-batch of what is there now."""
    return (
        stream.writeStream.foreachBatch(handler)
        .option("checkpointLocation", fresh_path(stream.sparkSession, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over what is there now into a Parquet table and read it back.

    Output and checkpoint live in the shared folder, so lost executors or a restart
    resume from the last finished batch.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_PROVIDER, None)
    # Custom state needs the RocksDB store; a query takes the setting when it starts.
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", f"{path}-state")
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _ohlc(groups) -> DataFrame:
    return groups.agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"),
    )


def bars(q: DataFrame, width: str, slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Open, high, low, close and volume per symbol and tumbling or sliding window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _ohlc(q.withWatermark("ts", watermark).groupBy("symbol", w.alias("w")))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "n")


def sessions(q: DataFrame, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """One bar per symbol and session, a session ending after ``gap`` without a quote."""
    out = _ohlc(q.withWatermark("ts", watermark).groupBy("symbol", F.session_window("ts", gap).alias("w")))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "n")


def incremental_load(rows: DataFrame, key: Sequence[str], path: str, partition: str, watermark: str = "6 days"):
    """Deduplicate re-delivered rows inside the overlap and upsert every micro-batch by key.

    A batch that is replayed after a failure writes the same rows again, so the
    table does not change.
    """
    once = rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(key))

    def store(batch: DataFrame, _: int) -> None:
        upsert_table(batch, path, key, partition)

    return handle(once, store, "load")


def _as_batches(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(frames)
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()


class _Drift(StatefulProcessor):
    """State of a portfolio: first price, last price and weight of each held asset."""

    def __init__(self, rule: DriftRule):
        self.rule = rule

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "asset string", "base double, last double, w double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = _as_batches(rows).sort_values(["end", "asset"])
        known = {k[0]: v for k, v in self.held.iterator()}
        names = pd.Index([*known, *given["asset"].unique()]).unique()
        base, last, w = np.full((3, len(names)), np.nan)
        base[: len(known)], last[: len(known)], w[: len(known)] = np.array(list(known.values()), float).reshape(-1, 3).T
        held, moved = np.arange(len(names)) < len(known), np.zeros(len(names), bool)
        out = []
        for end, part in given.groupby("end", sort=True):
            at = names.get_indexer(part["asset"])
            new = ~held[at]
            base[at[new]], w[at[new]] = part["open"].to_numpy(float)[new], part["w"].to_numpy(float)[new]
            last[at] = part["close"].to_numpy(float)
            held[at] = moved[at] = True
            worst = self._worst(base[held], last[held], w[held])
            infinite = math.isnan(worst) and not np.isnan(base[held] + last[held]).any()
            out.append((key[0], end, worst, worst > self.rule.threshold or infinite))
        for i in np.flatnonzero(moved):
            self.held.updateValue((names[i],), (float(base[i]), float(last[i]), float(w[i])))
        yield pd.DataFrame(out, columns=["portfolio", "end", "max_drift", "fires"])

    def _worst(self, base: np.ndarray, last: np.ndarray, w: np.ndarray) -> float:
        """Largest drift of the known assets, their weights scaled as a portfolio of their own; NaN if one has no finite growth."""
        with np.errstate(divide="ignore", invalid="ignore"):
            grown = w * last / base
            gaps = np.abs(grown / grown.sum() * w.sum() - w)
            if self.rule.relative:
                gaps = np.where(w != 0, gaps / np.abs(w), 0.0 * gaps)
        return float(gaps.max())

    def close(self) -> None:
        pass


def drift_monitor(q: DataFrame, holdings: DataFrame, rule: DriftRule, every: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """(portfolio, end, max_drift, fires) after each closed window that moved a held price.

    Quotes are first reduced to one close per symbol and window, so the state of a
    portfolio sees at most one row per held asset and window. ``holdings`` is
    (portfolio, asset, w). Once a held asset has grown from a price of zero, its
    portfolio has no finite drift: max_drift is null and the monitor fires.
    """
    closes = bars(q, every, watermark=watermark).select(F.col("symbol").alias("asset"), "end", "open", "close")
    rows = closes.join(holdings.select("portfolio", "asset", "w"), "asset")
    return rows.groupBy("portfolio").transformWithStateInPandas(
        _Drift(rule), "portfolio long, end timestamp, max_drift double, fires boolean", "Append", "None"
    )


class _Member(StatefulProcessor):
    """State of a symbol: whether it is in the universe."""

    def __init__(self, band: Band):
        self.band = band

    def init(self, handle) -> None:
        self.member = handle.getValueState("member", "member boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        member = bool(self.member.get()[0]) if self.member.exists() else False
        day = _as_batches(rows).sort_values("end")
        flags = []
        for v in day["dollar_volume"]:
            member = bool(v >= self.band.entry or (member and v >= self.band.exit))
            flags.append(member)
        self.member.update((member,))
        yield day.assign(member=flags)[["symbol", "end", "dollar_volume", "n", "member"]]

    def close(self) -> None:
        pass


def streaming_screen(q: DataFrame, dollars: Band, every: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """(symbol, end, dollar_volume, n, member): the entry and exit rule on each closed window,
    with the membership kept in state."""
    w = F.window("ts", every).alias("w")
    daily = q.withWatermark("ts", watermark).groupBy("symbol", w).agg(
        F.sum(F.col("price") * F.col("size")).alias("dollar_volume"), F.count_if(F.col("size") > 0).alias("n")
    )
    rows = daily.select("symbol", F.col("w.end").alias("end"), "dollar_volume", "n")
    return rows.groupBy("symbol").transformWithStateInPandas(
        _Member(dollars), "symbol string, end timestamp, dollar_volume double, n long, member boolean", "Append", "None"
    )
