"""An append-only log of schema-change events: batch and streaming ingest, views, and the purge.

Events come as XML documents with the session's user, host and program.  Elements are read with
regular expressions, since Spark's XPath functions fail on a malformed document and an audit log
must take it.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.storage import discard, file_system, materialise

FIELDS = ("EventType", "DatabaseName", "SchemaName", "ObjectName")
LOG = ("LogTimestamp", "EventXML", "EventType", "TSQLCommand", "DatabaseName", "SchemaName", "ObjectName", "UserName", "HostName", "ProgramName")
VIEW = tuple(name for name in LOG if name != "EventXML")
SUMMARY_KEYS = ("EventDate", "EventType", "DatabaseName", "UserName", "HostName")
EXCLUDED_DATABASES = ("z_DDLEventAudit",)
DAYS_KEPT = 10
# What the purge removes.
PURGED_USERS = "SERVICE\\SQLAgent"
PURGED_EVENTS = ("ALTER_INDEX", "UPDATE_STATISTICS")
# XML's named characters, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def element(xml: Column, path: str) -> Column:
    """Text of the first element of a path below the event; NULL if it is missing or empty."""
    opening = "".join(rf"<{name}(?:\s[^>]*)?>\s*(?:.*?)" if k < path.count("/") else rf"<{name}(?:\s[^>]*)?>" for k, name in enumerate(path.split("/")))
    text = F.regexp_extract(xml, rf"(?s)<EVENT_INSTANCE(?:\s[^>]*)?>.*?{opening}([^<]*)</", 1)
    for spelled, plain in ENTITIES:
        text = F.replace(text, F.lit(spelled), F.lit(plain))
    return F.nullif(text, F.lit(""))


def events_from_xml(feed: DataFrame) -> DataFrame:
    """Log rows from a feed with EventXML and, where it has them, LogTimestamp, UserName, HostName, ProgramName.

    A null document gives no row; what a document lacks is NULL.
    """
    has = lambda name, otherwise: F.col(name) if name in feed.columns else otherwise
    nothing = F.lit(None).cast("string")
    found = {name: element(F.col("EventXML"), name) for name in FIELDS} | {"TSQLCommand": element(F.col("EventXML"), "TSQLCommand/CommandText")}
    found |= {"LogTimestamp": has("LogTimestamp", F.current_timestamp()), "EventXML": F.col("EventXML")}
    found |= {"UserName": has("UserName", F.current_user()), "HostName": has("HostName", nothing), "ProgramName": has("ProgramName", nothing)}
    return feed.filter("EventXML is not null").select(*(found[name].alias(name) for name in LOG))


def in_scope(events: DataFrame, excluded: tuple[str, ...] = EXCLUDED_DATABASES) -> DataFrame:
    """Events of all databases but the excluded ones; those of no database stay."""
    return events.filter(F.col("DatabaseName").isNull() | ~F.col("DatabaseName").isin(*excluded))


def append_events(feed: DataFrame, path: str, excluded: tuple[str, ...] = EXCLUDED_DATABASES) -> None:
    """Adds a batch to the log at path, a folder for each day."""
    rows = in_scope(events_from_xml(feed), excluded).withColumn("EventDate", F.to_date("LogTimestamp"))
    rows.write.mode("append").partitionBy("EventDate").parquet(path)


def stream_events(feed: DataFrame, path: str, checkpoint: str, excluded: tuple[str, ...] = EXCLUDED_DATABASES, **trigger: object) -> StreamingQuery:
    """The same from a stream; the file sink writes each event exactly once."""
    rows = in_scope(events_from_xml(feed), excluded).withColumn("EventDate", F.to_date("LogTimestamp"))
    writer = rows.writeStream.format("parquet").partitionBy("EventDate").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def event_view(log: DataFrame) -> DataFrame:
    """The log without the documents."""
    return log.select(*VIEW)


def purged_summary_view(summary: DataFrame) -> DataFrame:
    return summary.select("PurgedTimestamp", *SUMMARY_KEYS, "PurgedRecordCount")


def to_purge(log: DataFrame, last: date | None = None, first: date | None = None, user: str = PURGED_USERS, event_types: tuple[str, ...] = PURGED_EVENTS) -> Column:
    """Whether an event is purged: from first (or the beginning) to last, by user and type, in any case."""
    last = last or date.today() - timedelta(days=DAYS_KEPT)
    day = F.to_date("LogTimestamp")
    asked = (day <= F.lit(last)) & F.lower("UserName").contains(user.lower()) & F.lower("EventType").isin(*(e.lower() for e in event_types))
    return F.coalesce(asked & (day >= F.lit(first)) if first else asked, F.lit(False))


def purge(log: DataFrame, last: date | None = None, first: date | None = None, user: str = PURGED_USERS, event_types: tuple[str, ...] = PURGED_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(events that stay, counts of those that go by day, type, database, user and host)."""
    gone = to_purge(log, last, first, user, event_types)
    keys = log.filter(gone).withColumn("EventDate", F.to_date("LogTimestamp"))
    summary = keys.groupBy(*SUMMARY_KEYS).agg(F.count(F.lit(1)).cast("int").alias("PurgedRecordCount"))
    return log.filter(~gone), summary.select(F.current_timestamp().alias("PurgedTimestamp"), *SUMMARY_KEYS, "PurgedRecordCount")


def purge_log(log: DataFrame, kept_path: str, summary_path: str, **which: object) -> bool:
    """Writes what stays to a new folder, and adds the counts to the summary; False, and nothing written, if nothing goes.

    The log's own folder is never overwritten while it is read: readers move to the new folder once
    it is complete.
    """
    kept, summary = purge(log, **which)
    if summary.isEmpty():
        return False
    summary.write.mode("append").parquet(summary_path)
    kept.write.mode("errorifexists").parquet(kept_path)
    return True


def purge_days(spark: SparkSession, path: str, summary_path: str, **which: object) -> list[date]:
    """Purges a log written in a folder a day where it is; returns the days that lost events.

    Only the folders of those days are written anew, by Spark's dynamic overwrite of partitions, from a table that
    holds what stays of them; a day of which nothing stays loses its folder.  All other days' files are left as they
    are, so a purge costs what its days hold, not what the log holds.  Counts are appended to the summary first: after
    a failure in between the purge is run again, and counts what is still there.
    """
    log = spark.read.parquet(path)
    if "EventDate" not in log.columns:
        raise ValueError("the log is not in folders by EventDate")
    _, summary = purge(log.drop("EventDate"), **which)
    summary = materialise(summary)
    days = [r[0] for r in summary.select("EventDate").distinct().orderBy("EventDate").collect()]  # days of the log at most
    if not days:
        return []
    touched = log.filter(F.col("EventDate").isin(days))
    kept = materialise(touched.filter(~to_purge(touched, **which)))
    left = {r[0] for r in kept.select("EventDate").distinct().collect()}
    summary.write.mode("append").parquet(summary_path)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("EventDate").parquet(path)
    for day in days:
        if day not in left:
            where, files = file_system(spark, f"{path}/EventDate={day}")
            files.delete(where, True)
    discard(kept)
    discard(summary)
    return days
