"""Column functions on dates; session time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(c: Column) -> Column:
    """ISO 8601 with Z, an offset or neither (UTC); null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), c.try_cast("timestamp"))


def parse_epoch(c: Column, millis: bool = False) -> Column:
    n = c.try_cast("double")
    n = F.when(F.abs(n) < 1e14, n)
    return F.timestamp_millis(n.cast("long")) if millis else F.timestamp_millis((n * 1000).cast("long"))


def parse_relative(c: Column, as_of: Column) -> Column:
    """``today``, ``yesterday``, ``posted N+ days ago``; null for anything else."""
    text = F.lower(F.trim(c))
    days = F.nullif(F.regexp_extract(text, r"(\d+)\+?\s*days?\s+ago", 1), F.lit("")).try_cast("int")
    days = F.when(text.contains("today"), 0).when(text.contains("yesterday"), 1).otherwise(days)
    return as_of - F.make_interval(days=days)


def humanize_age(ts: Column, as_of: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, ``2d ago``; times to come count as now, null is empty."""
    seconds = F.greatest(F.unix_timestamp(as_of) - F.unix_timestamp(ts), F.lit(0))
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(ts.isNull(), "").when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def resolve_location(text: Column, path: Column) -> Column:
    """The given location, or where that is blank or only counts locations, the slug after ``/job/`` in the path, read back."""
    slug = F.nullif(F.regexp_extract(path, r"/job/([^/]+)/", 1), F.lit(""))
    read = F.replace(F.replace(F.replace(slug, F.lit("---"), F.lit("\x01")), F.lit("-"), F.lit(" ")), F.lit("\x01"), F.lit(" - "))
    vague = F.coalesce(F.trim(text), F.lit("")).rlike(r"^$|^\d+ [Ll]ocations?$")
    return F.when(vague, F.coalesce(read, text)).otherwise(text)


TENANT_URL = r"^https?://([^./]+)\.([^./]+)\.example\.(?:com|net|org)(?:/(?:[a-z]{2}-[A-Z]{2}/)?([^/?#]+))?"


def extract_tenant(url: Column, pattern: str = TENANT_URL) -> Column:
    """(tenant, server, site) of a board URL; null where it is none."""
    part = lambda i: F.regexp_extract(url, pattern, i)
    return F.when(url.rlike(pattern), F.struct(part(1).alias("tenant"), part(2).alias("server"), F.nullif(part(3), F.lit("")).alias("site")))


#: Fixed value: a public posting URL of the hosted boards: tenant, server, an optional locale, site and path.
DETAIL_URL = r"^https?://([^.]+)\.(wd\d+)\.myworkdayjobs\.com(?:/(?i:[a-z]{2}-[a-z]{2}))?/([^/]+)/(.+)$"


def detail_url(url: Column) -> Column:
    """The address of a posting's JSON from its public one; null for other addresses."""
    return F.when(url.rlike(DETAIL_URL), F.regexp_replace(url, DETAIL_URL, "https://$1.$2.myworkdayjobs.com/wday/cxs/$1/$3/$4"))
