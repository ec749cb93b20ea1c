"""Schemas of the stored tables."""

from __future__ import annotations

# Column names and types of the raw tables and of the metric tables.
CRAWLS = """crawlid int, page_load_timeout int, wait_on_page int, wait_after_closing_circuits int,
entry_node string, os string, kernel string, kernel_version string, python_version string, tor_version string,
tb_version string, crawler_version string, city string, country string, ip string, asn int"""
SITES = """hsid int, hs_url string, is_sd boolean, sd_version string, is_current boolean,
sorted_class string, t_sort timestamp_ntz"""
EXAMPLES = "exampleid int, hsid int, crawlid int, t_scrape timestamp_ntz"
TRACES = """cellid bigint, exampleid int, ingoing boolean, circuit bigint, stream bigint, command string,
length int, t_trace decimal(16,6)"""

RAW = {"crawls": CRAWLS, "hs_history": SITES, "frontpage_examples": EXAMPLES, "frontpage_traces": TRACES}
