"""Raw pages: redirect chains, allowed URLs, and the fields of a page's head by built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairn.functions.text import collapse_whitespace, url_host
from cairn.sources.shared import written

# fixed values
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MAX_HOPS = 5
RETRY_DELAYS_MS = (1000, 2000, 4000)
# fixed values: codes of failed requests
TIMEOUTS = ("timeout", "TimeoutError", "ETIMEDOUT", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT")
NETWORK = ("network", "ECONNREFUSED", "ECONNRESET", "ENOTFOUND", "EAI_AGAIN", "EPIPE", "UND_ERR_SOCKET")


def default_port(url: Column) -> Column:
    """The URL without the port that https has anyway."""
    return F.regexp_replace(url, r"^(https://[^/?#:]*):443(?=[/?#]|$)", "$1")


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, the default port, and a host of the list."""
    return F.coalesce(url.startswith("https://") & url_host(default_port(url)).isin(*hosts), F.lit(False))


@F.pandas_udf(StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    def one(b, x):
        try:
            return urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def resolve(base: Column, link: Column) -> Column:
    """A link, made absolute by the URL that it stands at; absolute ones need no Python."""
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.isNotNull() & base.isNotNull(), _joined(base, link))


def answer_table(answers: DataFrame) -> DataFrame:
    """url without a default port, status, and where an answer redirects to, made absolute."""
    return answers.select(default_port(F.col("url")).alias("_u"), F.col("status").alias("_s"), default_port(resolve(F.col("url"), F.col("location"))).alias("_l"))


def follow(requests: DataFrame, answers: DataFrame, hosts: list[str], guard: Callable[[Column], Column] | None = None, barred: DataFrame | None = None) -> DataFrame:
    """url, final_url, status, hops, problem: redirect chains over a table of answers (url, status, location). A round looks up
    only the chains that are still alive, so those without a redirect are looked up once, and ends when none is; a loop ends
    with the most hops that are allowed. Each hop is checked before it is looked up: against the hosts, by ``guard`` (whether
    a URL may be asked for) and against ``barred`` (a table of URLs that may not). Locations may be relative."""
    live = requests.select("url", default_port(F.col("url")).alias("at"), F.lit(None).cast("int").alias("before"), F.lit(0).alias("hops"))
    table, ended = written(answer_table(answers)), []
    while True:
        rows = live.join(table, F.col("at") == F.col("_u"), "left")
        if barred is not None:
            rows = rows.join(barred.select(F.col("url").alias("at"), F.lit(True).alias("_barred")).distinct(), "at", "left")
        wrong = ~allowed_url(F.col("at"), hosts)
        vetoed = (~F.coalesce(guard(F.col("at")), F.lit(False)) if guard else F.lit(False)) | (F.col("_barred").isNotNull() if barred is not None else F.lit(False))
        moved = F.coalesce(F.col("_s").isin(*REDIRECT_STATUSES) & F.col("_l").isNotNull(), F.lit(False))
        problem = F.when(wrong, "forbidden").when(vetoed, "vetoed").when(F.col("_s").isNull(), "network").when(moved & (F.col("hops") >= MAX_HOPS), "too-many-redirects")
        state = written(rows.select("url", "at", F.when(wrong | vetoed, F.col("before")).otherwise(F.col("_s")).alias("status"), "hops", problem.alias("problem"), F.when(problem.isNull() & moved, F.col("_l")).alias("next")))
        ended.append(state.where("next IS NULL").select("url", F.col("at").alias("final_url"), "status", "hops", "problem"))
        live = state.where("next IS NOT NULL").select("url", F.col("next").alias("at"), F.col("status").alias("before"), (F.col("hops") + 1).alias("hops"))
        if live.isEmpty():
            return reduce(DataFrame.unionByName, ended)


def failure_class(error: Column) -> Column:
    """timeout, network or other, by the error's code."""
    return F.when(error.isin(*TIMEOUTS), "timeout").when(error.isin(*NETWORK), "network").when(error.isNotNull(), "other")


def retryable(status: Column, error: Column) -> Column:
    return F.coalesce(failure_class(error).isin("timeout", "network"), F.lit(False)) | F.coalesce((status == 429) | status.between(500, 599), F.lit(False))


def title(html: Column) -> Column:
    return collapse_whitespace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_kind(html: Column, fingerprints: dict[str, str]) -> Column:
    """The one kind whose fingerprint (a regular expression) the page has; 'none' or 'several' are errors."""
    kinds = F.array_compact(F.array(*(F.when(html.rlike(regex), kind) for kind, regex in fingerprints.items())))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(F.size(kinds) == 0, "none").otherwise("several")


def nav_entries(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, href, text of each list link."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?s)<li><a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("pos", "_a"))
    return found.select(key, "pos", F.regexp_extract("_a", r'href="([^"]*)"', 1).alias("href"), collapse_whitespace(F.regexp_extract("_a", r">([^<>]*)</a>", 1)).alias("text"))


def card_pivot(rows: DataFrame, prefix: str, field: str, text: str, fields: list[str], pos: str) -> DataFrame:
    """A row per prefix with the last text of each field; prefixes without all of them are incomplete."""
    out = rows.where(F.col(field).isin(*fields)).groupBy(prefix).agg(*(F.max_by(F.when(F.col(field) == f, F.col(text)), F.when(F.col(field) == f, F.col(pos))).alias(f) for f in fields))
    complete = F.lit(True)
    for f in fields:
        complete = complete & F.col(f).isNotNull()
    return out.withColumn("complete", complete)
