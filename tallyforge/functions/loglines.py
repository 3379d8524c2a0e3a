"""Access-log lines in the combined format, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'
#: Client by the first pattern that the user agent holds; its first group is the version.
CLIENTS = (
    ("Edge", r"Edg(?:e|A|iOS)?/(\d+(?:\.\d+)?)"),
    ("Opera", r"(?:OPR|Opera)/(\d+(?:\.\d+)?)"),
    ("Firefox", r"(?:Firefox|FxiOS)/(\d+(?:\.\d+)?)"),
    ("Chrome", r"(?:Chrome|CriOS)/(\d+(?:\.\d+)?)"),
    ("Safari", r"Version/(\d+(?:\.\d+)?).*Safari"),
    ("curl", r"curl/(\d+(?:\.\d+)?)"),
)


def client(user_agent: Column) -> Column:
    """(name, version); both null if no pattern matches."""
    found = F.lit(None).cast("struct<name:string,version:string>")
    for name, pattern in reversed(CLIENTS):
        found = F.when(user_agent.rlike(pattern), F.struct(F.lit(name).alias("name"), F.regexp_extract(user_agent, pattern, 1).alias("version"))).otherwise(found)
    return found


def local_time(text: Column) -> Column:
    """The clock time as written, whatever the offset after it."""
    return F.try_to_timestamp(F.substring_index(text, " ", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz")


def parse(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """``lines`` with ip_address, local_datetime, method, url, http_status, user_agent, client_name, client_version and
    reject_reason (``LIN`` not in the format, ``TIM`` no valid time, ``STA`` not answered with success; null: good)."""
    part = [F.nullif(F.regexp_extract(value_col, LINE, i), F.lit("")) for i in range(9)]
    agent = F.nullif(part[8], F.lit("-"))
    out = lines.select(
        "*", part[1].alias("ip_address"), local_time(part[2]).alias("local_datetime"), part[3].alias("method"), part[4].alias("url"),
        part[5].try_cast("int").alias("http_status"), agent.alias("user_agent"), client(agent).alias("__client"),
    )
    reason = F.when(F.col("url").isNull(), "LIN").when(F.col("local_datetime").isNull(), "TIM").when(~F.col("http_status").between(200, 399), "STA")
    return out.select("*", F.col("__client.name").alias("client_name"), F.col("__client.version").alias("client_version"), reason.alias("reject_reason")).drop("__client")
