"""Sites: links found in directory pages, classes by rule, and lookups of known sites."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelab.functions.columns import class_version, first_class, is_monitored_class, lookback, moment, site_host

# The address pattern of a hidden site and what goes before it.
ADDRESS_PATTERN = r"[0-9a-z]{16}\.onion"
ADDRESS_PREFIX = "http://"


def _links(html: Column, pattern: str, group: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), group))


def page_links(pages: DataFrame, pattern: str = ADDRESS_PATTERN, group: int = 0, prefix: str = ADDRESS_PREFIX) -> DataFrame:
    """Distinct links over all pages, plus the address of each page itself."""
    found = pages.select(F.explode(_links(F.col("html"), pattern, group)).alias("link"))
    found = found.select(F.concat(F.lit(prefix), "link").alias("url"))
    return found.union(pages.select("url")).distinct()


def empty_pages(pages: DataFrame, pattern: str = ADDRESS_PATTERN, group: int = 0) -> DataFrame:
    """Pages without any link, which is an error condition for a directory."""
    return pages.where(F.size(_links(F.col("html"), pattern, group)) == 0).select("url")


def classified(pages: DataFrame, rules: list[tuple[str, str]], text: str = "html") -> DataFrame:
    """(url, class_name); class_name is NULL where no rule holds. Rules read ``text``."""
    return pages.select("url", F.col(text).alias("text")).select("url", first_class(F.col("text"), rules).alias("class_name"))


def from_class_map(classes: DataFrame) -> DataFrame:
    """(class_name, urls array) or a map column ``classes`` to one row per url."""
    if "classes" in classes.columns:
        classes = classes.select(F.explode("classes").alias("class_name", "urls"))
    return classes.select("class_name", F.explode("urls").alias("url"))


def site_rows(classes: DataFrame, t_sort: datetime | None = None) -> DataFrame:
    """Site rows to append, from (class_name, url)."""
    return classes.where(F.col("class_name").isNotNull()).select(
        site_host(F.col("url")).alias("hs_url"),
        is_monitored_class(F.col("class_name")).alias("is_sd"),
        class_version(F.col("class_name")).alias("sd_version"),
        F.lit(True).alias("is_current"),
        F.col("class_name").alias("sorted_class"),
        moment(t_sort).alias("t_sort"),
    )


def _since(sites: DataFrame, now: datetime, span: str | timedelta) -> DataFrame:
    since = now - (lookback(span) if isinstance(span, str) else span)
    return sites.where(F.col("t_sort") >= moment(since))


def recent_sites(sites: DataFrame, now: datetime, span: str | timedelta) -> DataFrame:
    """Sites sorted within the lookback: (is_sd, hs_url, hsid); the latest id of an address wins."""
    recent = _since(sites, now, span)
    return recent.groupBy("is_sd", "hs_url").agg(F.max_by("hsid", F.struct("t_sort", "hsid")).alias("hsid"))


def site_classes(sites: DataFrame, now: datetime, span: str | timedelta) -> DataFrame:
    """Recent sites of both classes under the name of their class.

    The class of the latest row names the monitored class; the other is ``nonmonitored``.
    """
    recent = _since(sites, now, span)
    latest = recent.where("is_sd").agg(F.max_by("sorted_class", F.struct("t_sort", "hsid")).alias("name")).first()
    return recent_sites(sites, now, span).select(
        F.when(F.col("is_sd"), F.lit(latest["name"])).otherwise(F.lit("nonmonitored")).alias("class_name"),
        "hs_url",
        "hsid",
    )


def url_ids(recent: DataFrame) -> DataFrame:
    """One id per address over both classes; the monitored one wins a clash."""
    return recent.groupBy("hs_url").agg(F.max_by("hsid", F.struct("is_sd", "hsid")).alias("hsid"))
