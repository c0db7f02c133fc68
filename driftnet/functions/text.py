"""Small text, time and display functions of the API edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def tracker_protocol(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    return F.when(found.isin("udp", "http", "https"), found)


def tracker_host(url: Column) -> Column:
    """Host and port; a UDP tracker without a port has 80."""
    host = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)
    bare = (tracker_protocol(url) == "udp") & ~host.rlike(r":\d+\z")
    return F.when(tracker_protocol(url).isNotNull() & (host != ""), F.when(bare, F.concat(host, F.lit(":80"))).otherwise(host))


def scrape_url(url: Column) -> Column:
    """The announce address with its last /announce turned to /scrape; null where there is none to turn."""
    turned = F.regexp_replace(url, r"^(.*)/announce", "$1/scrape")
    return F.when(tracker_protocol(url).isin("http", "https") & url.contains("/announce"), turned)


def moment(epoch: Column) -> Column:
    """A timestamp without zone, so that formats do not depend on the session."""
    return F.timestamp_add("SECOND", epoch, F.to_timestamp_ntz(F.lit(EPOCH)))


def rfc1123(epoch: Column) -> Column:
    return F.concat(F.date_format(moment(epoch), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def rfc3339(epoch: Column) -> Column:
    return F.date_format(moment(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def show_bytes(size: Column) -> Column:
    def unit(power: int, name: str) -> Column:
        tenths = F.round(size * 10 / 1024**power).cast("long")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1, "KB")).when(size < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def show_age(seconds: Column) -> Column:
    of = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, of(1, "s")).when(seconds < 3600, of(60, "m")).when(seconds < 86_400, of(3600, "h")).otherwise(of(86_400, "d"))


def page_count(total: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / limit)).cast("long")


def truncate(text: Column, n: int) -> Column:
    """Longer than n bytes: the first n characters and three dots."""
    return F.when(F.octet_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def adaptive_limit(outcomes: Column, start: int) -> Column:
    """The batch limit after an array of outcomes in order."""
    first = F.struct(F.lit(start).alias("n"), F.lit(0).alias("good"))

    def step(a: Column, ok: Column) -> Column:
        full = a["good"] + 1 >= 100
        n = F.when(~ok, F.greatest(F.lit(1), F.floor(a["n"] / 2).cast("int"))).when(full, F.least(F.lit(start), (a["n"] + F.floor(a["n"] / 4)).cast("int"))).otherwise(a["n"])
        return F.struct(n.alias("n"), F.when(~ok | full, 0).otherwise(a["good"] + 1).alias("good"))

    return F.aggregate(outcomes, first, step, lambda a: a["n"])
