"""One run from configured sources to a written catalog: robots gates, redirects, page kinds, claims, assembly, checks.

Every stage passes on what holds and leaves the rest as rows of failures, so one run names all that is wrong at once. Counts are
observed while tables are written, without a pass of their own. Answers (of robots.txt files and of pages) are tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairn.functions.text import url_host
from cairn.operators import assemble, claims, robots
from cairn.operators.integrity import document_issues
from cairn.sources import json_documents, page_parsers
from cairn.sources.pages import answer_table, default_port, follow
from cairn.sources.shared import written

STAGES = ("robots", "fetch", "parse", "normalize", "validate")


@dataclass(frozen=True)
class Run:
    """catalog: its collections. failures: ord (of the source, null for what concerns several), stage, subject, message. counts:
    configured, fetched, parsed and the rows of each collection."""

    catalog: dict[str, DataFrame]
    failures: DataFrame
    counts: dict[str, int]


def _observed(rows: DataFrame, counts: dict[str, int], **what: Column) -> DataFrame:
    """rows, written; meanwhile ``what`` is aggregated into counts."""
    seen = Observation()
    out = written(rows.observe(seen, *(c.alias(name) for name, c in what.items())))
    counts.update(seen.get)
    return out


def _failures(rows: DataFrame, stage: Column | str, subject: str, message: Column | str) -> DataFrame:
    stage = F.lit(stage) if isinstance(stage, str) else stage
    return rows.select(F.col("ord").cast("long").alias("ord"), stage.alias("stage"), F.col(subject).cast("string").alias("subject"), (F.col(message) if isinstance(message, str) else message).alias("message"))


def fetched(sources: DataFrame, robots_answers: DataFrame, answers: DataFrame, agent: str, hosts: list[str], interval_ms: int) -> DataFrame:
    """sources (ord, id, url, page_kind) with final_url, stage and message: where its redirects lead, and what stopped it. Each URL
    that is asked for, behind a redirect too, must be of the hosts and allowed by its host's robots.txt."""
    decided = written(robots.host_decisions(robots_answers.select("host", "status", "body"), agent, interval_ms))
    parsed = written(robots.parse(robots_answers.join(decided.where("decision = 'rules'").select("host"), "host", "left_semi")))
    urls = sources.select(default_port(F.col("url")).alias("url")).union(answer_table(answers).where("_l IS NOT NULL").select("_l"))
    barred = written(robots.barred(urls, decided, parsed, agent))
    ends = follow(sources.select("url").distinct(), answers, hosts, barred=barred)
    rows = sources.join(ends, "url").join(barred.select(F.col("url").alias("final_url"), "reason"), "final_url", "left")
    reason = F.when(F.col("problem") == "forbidden", "URL is not allowed").when(F.col("problem") == "vetoed", F.col("reason")).when(F.col("problem") == "network", "unexpected failure").when(F.col("problem").isNotNull(), F.col("problem"))
    reason = F.coalesce(reason, F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
    stage = F.when(F.col("problem") == "vetoed", "robots").when(reason.isNotNull(), "fetch")
    return rows.select("ord", "id", "url", "page_kind", "final_url", stage.alias("stage"), reason.alias("message"))


def run(sources: DataFrame, robots_answers: DataFrame, answers: DataFrame, agent: str, hosts: list[str], interval_ms: int, docs_host: str, partitions: int | None = None) -> Run:
    """sources: ord, id, url, page_kind. robots_answers: host, status (null: the request failed), body. answers: url, status,
    location, html, retrieved_at. The catalog is of what passed every stage; it is whole only if there are no failures."""
    counts: dict[str, int] = {}
    got = _observed(fetched(sources, robots_answers, answers, agent, hosts, interval_ms), counts, configured=F.count("*"), fetched=F.count_if(F.col("stage").isNull()))
    pages = got.where("stage IS NULL").select("ord", "id", "page_kind", "final_url").join(answers.select(default_port(F.col("url")).alias("final_url"), "html", "retrieved_at"), "final_url")
    parsed = page_parsers.parse(pages, key="id", url="final_url", configured="page_kind", partitions=partitions)
    parsed = _observed(parsed.join(pages.select("id", "ord", "page_kind", "final_url", "retrieved_at"), "id"), counts, parsed=F.count_if(F.col("issue").isNull()))
    stated = claims.normalized(parsed.withColumnRenamed("id", "source"), docs_host)
    catalog, problems = assemble.assembled(stated)
    catalog = {c: _observed(rows, counts, **{c: F.count("*")}) for c, rows in catalog.items()}
    problems = problems.select(F.lit(None).cast("long").alias("ord"), "stage", "subject", "message")
    failures = [_failures(got.where("stage IS NOT NULL"), F.col("stage"), "final_url", "message"), _failures(parsed.where("issue IS NOT NULL"), "parse", "final_url", "issue"), problems]
    found = written(reduce(DataFrame.unionByName, failures))
    if found.isEmpty():  # only a catalog of all sources can be held against itself
        issues = document_issues(assemble.in_order(catalog))
        found = written(_failures(issues, "validate", "path", "message"))
    return Run(catalog, found, counts)


def in_stages(failures: DataFrame) -> DataFrame:
    """failures in order: by stage, then as the sources are configured, then by subject and message."""
    return failures.orderBy(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.asc_nulls_last("ord"), "subject", "message")


def lines(done: Run, sources: DataFrame) -> list[str]:
    """What a run says of itself, a line a stage."""
    n, c = done.counts["configured"], done.counts
    hosts = sources.groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.min("ord").alias("ord")).orderBy("ord").collect()  # as many as are allowed
    return [
        f"config: {n} sources ({', '.join(f'{h.host} {h.n}' for h in hosts)})", f"fetch: {c['fetched']}/{n} pages fetched (robots-gated)", f"parse: {c['parsed']} pages parsed and normalized",
        f"assemble: {c['productFamilies']} families, {c['products']} products, {c['solutions']} solutions, {c['useCases']} use cases, {c['relationships']} relationships",
    ]


def write(done: Run, target: str, generated_at: str) -> None:
    """Puts the run's catalog at the target at once; with failures raises all of them, and what was there stays."""
    problems = in_stages(done.failures).collect()
    if problems:
        raise assemble.RunError(problems)
    json_documents.write_catalog(assemble.in_order(done.catalog), target, generated_at)
