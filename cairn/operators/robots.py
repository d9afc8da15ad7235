"""robots.txt as DataFrames: groups of rules, the groups that apply, longest-match decisions, and what they mean for hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import url_host

#: Letters of a rule that a path is searched for.
GRAM = 3
DELAY = r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse(files: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """host, pos, field, value, group: the lines with a meaning. A user-agent line that follows a rule opens a group. Blank
    user-agents, delays that are no number and unknown fields change nothing."""
    lines = files.select(F.col(host).alias("host"), F.posexplode(F.split(body, r"\r\n|\n|\r")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "#.*$", "")).where(F.contains("line", F.lit(":")))
    lines = lines.select("host", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    field = F.col("field")
    lines = lines.where(field.isin("allow", "disallow") | ((field == "user-agent") & (F.col("value") != "")) | ((field == "crawl-delay") & F.col("value").rlike(DELAY)))
    order = Window.partitionBy("host").orderBy("pos")
    begins = F.when(field == "user-agent", F.col("pos"))
    lines = lines.withColumn("_seen", F.min(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_seen IS NOT NULL")
    opens = (field == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    return lines.withColumn("group", F.sum(opens.cast("int")).over(order)).drop("_seen")


def selected(parsed: DataFrame, agent: str) -> DataFrame:
    """The groups that apply to an agent: those with its longest token (of equally long ones the first), else those of '*'."""
    tokens = parsed.where("field = 'user-agent'").select("host", "pos", "group", F.lower("value").alias("token"))
    own = F.when((F.col("token") != "*") & F.lit(agent.lower()).contains(F.col("token")), F.struct(F.length("token").alias("n"), (-F.col("pos")).alias("p"), F.col("token").alias("t")))
    best = tokens.groupBy("host").agg(F.max(own).alias("_own")).select("host", F.coalesce("_own.t", F.lit("*")).alias("token"))
    return tokens.join(best, ["host", "token"]).select("host", "group").distinct()


def rules(parsed: DataFrame, agent: str) -> DataFrame:
    """host, pattern, allow, regex of the rules that apply; empty patterns match nothing."""
    found = parsed.where("field IN ('allow', 'disallow') AND value <> ''").join(selected(parsed, agent), ["host", "group"])
    literal = F.regexp_replace(F.regexp_replace("value", r"([\\.^$|?+()\[\]{}])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.regexp_replace(literal, r"\\\$$", r"\\z"))
    return found.select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"), regex.alias("regex"))


def decisions(paths: DataFrame, parsed: DataFrame, agent: str) -> DataFrame:
    """paths (host, path) with ``allowed``: the longest matching pattern decides, allow wins ties, no match allows.

    A rule is found by what it has before its first wildcard: a path is cut to each length that such a beginning has on its host,
    and cuts and beginnings meet by equality. Where the beginning is shorter than ``GRAM`` letters and the rule has a longer run without
    wildcards, it is found by the last letters of its longest run instead: these must stand somewhere in the path. Only rules with a
    wildcard or an end mark are then matched as patterns. So a path meets the rules whose beginning or letters it has, not all those of its
    host; rules with less than ``GRAM`` letters in a row are few of a kind, and meet all paths that begin like them."""
    asked = paths.select("host", "path").distinct().withColumn("_p", F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), "path")))
    longest = F.array_max(F.transform(F.split("pattern", r"[*$]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    found = rules(parsed, agent).distinct().withColumn("_begins", F.regexp_extract("pattern", r"\A([^*$]*)", 1)).withColumn("_run", longest)
    found = found.withColumn("_gram", F.when((F.length("_begins") < GRAM) & (F.col("_run.n") >= GRAM), F.right("_run.run", F.lit(GRAM)))).drop("_run")
    led = F.col("_gram").isNull()
    found = found.select("host", "pattern", "allow", "regex", led.alias("_led"), F.coalesce("_gram", "_begins").alias("_key"))
    hosts = found.groupBy("host").agg(F.collect_set(F.when(F.col("_led"), F.length("_key"))).alias("_lengths"), F.bool_or(~F.col("_led")).alias("_held"))  # as many lengths as a path has letters, at most
    key = lambda is_led, start, n: F.struct(F.lit(is_led).alias("_led"), F.substring("_p", start, n).alias("_key"))
    cuts = F.transform(F.filter("_lengths", lambda n: n <= F.length("_p")), lambda n: key(True, F.lit(1), n))
    grams = F.transform(F.sequence(F.lit(1), F.length("_p") - GRAM + 1), lambda i: key(False, i, F.lit(GRAM)))
    keys = F.when(F.col("_held") & (F.length("_p") >= GRAM), F.concat(cuts, F.array_distinct(grams))).otherwise(cuts)
    met = asked.join(hosts, "host").select("host", "path", "_p", F.inline(keys)).join(found, ["host", "_led", "_key"])
    hits = met.where((F.col("_led") & (F.col("_key") == F.col("pattern"))) | F.rlike("_p", F.col("regex")))
    best = hits.groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("_allow"))
    return paths.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def barred(urls: DataFrame, decided: DataFrame, parsed: DataFrame, agent: str) -> DataFrame:
    """url and reason of those that may not be asked for: of hosts without a decision, of hosts that failed, and of paths that rules
    disallow. urls: url. decided: ``host_decisions``; parsed: ``parse`` of the hosts that have rules."""
    rows = urls.select("url", url_host(F.col("url")).alias("host"), F.regexp_extract("url", r"\A[^:]*://[^/?#]*([^#]*)", 1).alias("path")).distinct().join(decided, "host", "left")
    rows = decisions(rows, parsed, agent)
    reason = F.when(F.col("decision").isNull(), "no robots decision for the host").when(F.col("decision") == "failed", F.col("problem")).when((F.col("decision") == "rules") & ~F.col("allowed"), "path disallowed")
    return rows.select("url", reason.alias("reason")).where("reason IS NOT NULL")


def crawl_delay(parsed: DataFrame, agent: str) -> DataFrame:
    """host and its delay in seconds: of the groups that apply, the first that declares one; of its delays, the last."""
    found = parsed.where("field = 'crawl-delay'").join(selected(parsed, agent), ["host", "group"])
    return found.groupBy("host").agg(F.min_by(F.col("value").cast("double"), F.struct(F.col("group"), -F.col("pos"))).alias("delay"))


def classify(status: str = "status") -> Column:
    """What an answer to a robots.txt request means: parse it, allow all, or disallow all."""
    code = F.col(status)
    return F.when(code.between(200, 299), "parse").when(code.between(400, 499), "allow-all").otherwise("disallow-all")


def host_decisions(answers: DataFrame, agent: str, interval_ms: int) -> DataFrame:
    """host, decision, problem of answers (host, status, body; a null status is a failed request): rules, allow-all or
    failed. A host whose delay is longer than the interval between requests is refused."""
    state = F.when(F.col("status").isNull(), "failed").otherwise(F.when(classify() == "disallow-all", "failed").otherwise(F.when(classify() == "parse", "rules").otherwise("allow-all")))
    hosts = answers.withColumn("decision", state)
    delays = crawl_delay(parse(hosts.where("decision = 'rules'")), agent)
    slow = F.coalesce(F.col("delay") * 1000 > interval_ms, F.lit(False))
    problem = F.when(F.col("status").isNull(), "robots.txt fetch failed").when(F.col("decision") == "failed", "whole host is disallowed").when(slow, "crawl-delay exceeds the interval")
    out = hosts.join(delays, "host", "left").withColumn("problem", problem)
    return out.select("host", F.when(slow, "failed").otherwise(F.col("decision")).alias("decision"), "problem")


def gated(sources: DataFrame, decided: DataFrame, answers: DataFrame, pages: DataFrame, agent: str) -> DataFrame:
    """id, url, status, stage, problem of each source (id, url, host, path): stopped by its host's robots answer or rules
    (stage robots), by a page answer that isn't 2xx (stage fetch), or neither. pages: url, status."""
    ruled = decided.where("decision = 'rules'").select("host")
    allowed = decisions(sources.select("host", "path").distinct(), parse(answers.join(ruled, "host", "left_semi")), agent)
    rows = sources.join(decided, "host", "left").join(allowed, ["host", "path"], "left").join(pages.select("url", "status"), "url", "left")
    robots = F.when(F.col("decision").isNull(), "no robots decision for the host").when(F.col("decision") == "failed", F.col("problem")).when((F.col("decision") == "rules") & ~F.col("allowed"), "path disallowed")
    fetch = F.when(F.col("status").isNull(), "unexpected failure").when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    stage = F.when(robots.isNotNull(), "robots").when(fetch.isNotNull(), "fetch")
    return rows.select("id", "url", F.when(robots.isNull(), F.col("status")).alias("status"), stage.alias("stage"), F.coalesce(robots, fetch).alias("problem"))
