"""robots.txt: groups of rules, which group an agent obeys, and which rule holds for a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.sources import tables as T

# Lines that are read.
FIELDS = ("user-agent", "allow", "disallow", "crawl-delay", "sitemap")


def robots_lines(texts: DataFrame) -> DataFrame:
    """(host, nth, field, value) of the lines that mean something, from host and robots text.

    Comments go, fields are told apart without regard to case, and values are trimmed.
    """
    lines = texts.select("host", F.posexplode(F.split("text", "\\n")).alias("nth", "line"))
    plain = F.trim(F.regexp_replace("line", "#.*$|[\\r\\t]", " "))
    cut = F.instr(plain, ":")
    fields = lines.where(cut > 1).select("host", "nth", F.lower(F.trim(F.substring_index(plain, ":", 1))).alias("field"), F.trim(F.substr(plain, cut + 1)).alias("value"))
    return fields.where(F.col("field").isin(*FIELDS))


def robots_agents(texts: DataFrame) -> DataFrame:
    """One row an agent of a host: host, agent, rules (array of rule_type and pattern, in order), crawl_delay.

    Agents named one after the other, with no rule between, share a group; a rule or delay ends the list of agents, so the
    next agent opens a new group. Of several groups of one agent the last holds. Rules before any agent and empty patterns
    of Disallow are dropped, so a group may be without rules. A file's lines stay together, so a file has to fit a task.
    """
    order = Window.partitionBy("host").orderBy("nth")
    lines = robots_lines(texts).where("field != 'sitemap'")
    agent = F.col("field") == "user-agent"
    opens = agent & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    numbered = lines.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order)).where("group > 0")
    rule = (F.col("field") == "allow") | ((F.col("field") == "disallow") & (F.col("value") != ""))
    delay = F.when((F.col("field") == "crawl-delay") & F.col("value").rlike("^[+-]?[0-9]+$"), F.expr("try_cast(value as int)"))
    told = numbered.groupBy("host", "group").agg(
        F.array_sort(F.collect_list(F.when(rule, F.struct("nth", F.col("field").alias("rule_type"), F.col("value").alias("pattern"))))).alias("rules"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("nth"))).alias("crawl_delay"),
    )
    last = numbered.where(agent).groupBy("host", F.lower("value").alias("agent")).agg(F.max("group").alias("group"))
    rules = F.transform("rules", lambda r: F.struct(r["rule_type"].alias("rule_type"), r["pattern"].alias("pattern")))
    return last.join(told, ["host", "group"]).select("host", "agent", rules.alias("rules"), F.coalesce("crawl_delay", F.lit(0)).alias("crawl_delay"))


def chosen_group(agents: DataFrame, askers: DataFrame) -> DataFrame:
    """For each host and user_agent of ``askers`` the group it obeys: host, user_agent, agent, rules, crawl_delay.

    The agent of exactly that name, else the longest one contained in the name, else ``*``. Those for whom there is none
    have no row.
    """
    asked = askers.select("host", "user_agent").distinct()
    name = F.lower("user_agent")
    met = asked.join(agents, "host").where((F.col("agent") == "*") | name.contains(F.col("agent")))
    rank = F.struct((F.col("agent") == name).alias("exact"), (F.col("agent") != "*").alias("named"), F.length("agent").alias("length"), F.col("agent").alias("agent"))
    return met.groupBy("host", "user_agent").agg(F.max_by(F.struct("agent", "rules", "crawl_delay"), rank).alias("g")).select("host", "user_agent", "g.*")


def _literal(pattern: Column) -> Column:
    """The pattern without the anchor at its end."""
    return F.when(pattern.endswith("$"), F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)


def matches(path: Column, pattern: Column) -> Column:
    """Whether a path meets a pattern: its parts between stars stand in this order, the first at the begin; each is taken
    at its first place. With $ nothing may be left after the last part, unless a star ends the pattern.
    """
    anchored, body = pattern.endswith("$"), _literal(pattern)
    parts = F.split(body, "\\*", -1)
    after = lambda text, part: F.when(F.call_function("instr", text, part) > 0, F.substr(text, F.call_function("instr", text, part) + F.length(part)))
    head = F.when(path.startswith(parts[0]), F.substr(path, F.length(parts[0]) + 1))
    rest = F.aggregate(F.slice(parts, 2, F.size(parts)), head, lambda text, part: F.when(part == "", text).otherwise(after(text, part)))
    return rest.isNotNull() & (~anchored | (F.when(body.contains("*"), body.endswith("*")).otherwise(False)) | (rest == ""))


def robots_decisions(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """paths (host, user_agent, path and others) with allowed: the longest pattern that the path meets decides, allow on a tie.

    ``groups`` is what chosen_group() gives. Every rule is known by what stands before its first star, and a path
    is looked up by its own beginnings, of those lengths only that the group's rules have; so it meets
    the few rules that begin as it does, and only those with a star are compared further. No pattern is compiled.
    """
    rules = groups.select("host", "user_agent", F.explode("rules").alias("r")).select("host", "user_agent", F.col("r.rule_type").alias("rule_type"), F.col("r.pattern").alias("pattern"))
    rules = rules.withColumn("start", F.split(_literal(F.col("pattern")), "\\*", -1)[0]).distinct()
    lengths = rules.groupBy("host", "user_agent").agg(F.collect_set(F.length("start")).alias("lengths"))
    wanted = paths.select("host", "user_agent", "path").distinct()
    begins = wanted.join(lengths, ["host", "user_agent"]).withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).withColumn("start", F.left("path", F.col("n"))).drop("lengths", "n")
    met = begins.join(rules, ["host", "user_agent", "start"]).where(matches(F.col("path"), F.col("pattern")))
    allow = F.col("rule_type") == "allow"
    best = met.groupBy("host", "user_agent", "path").agg(F.max_by(allow, F.struct(F.octet_length(_literal(F.col("pattern"))).alias("n"), allow.alias("a"))).alias("allowed"))
    return paths.join(best, ["host", "user_agent", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


# The file that every host of the test crawl is given, and those who ask.
_FILE = """# robots
Disallow: /never-read
User-agent: *
Disallow: /es/
Disallow: /*.html$
Crawl-delay: 2

User-Agent: Googlebot # two agents, one group
User-agent: FriendlyBot
Disallow: /
Allow: /en/
Allow: /*?page=
crawl-delay: 7
USER-AGENT: googlebot-news
Disallow:
User-agent: half
Disallow: /de
Allow: /de$
Sitemap: https://e.com/s.xml
"""
_ASKERS = ("Mozilla/5.0 (compatible; Googlebot/2.1)", "Googlebot-News", "half", "SomeBot")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = F.regexp_replace(F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", ""), "#.*$", "")
    asker = F.element_at(F.array(*map(F.lit, _ASKERS)), (F.col("url_id") % len(_ASKERS) + 1).cast("int"))
    paths = T.urls(spark, sf_dir).select("url_id", "host", asker.alias("user_agent"), path.alias("path"))
    agents = robots_agents(paths.select("host").distinct().withColumn("text", F.lit(_FILE)))
    return paths, chosen_group(agents, paths)


def robots_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL with what its host's robots file says to one of four crawlers."""
    paths, groups = _asked(spark, sf_dir)
    return robots_decisions(paths, groups).select("url_id", "user_agent", "allowed")


def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each host and crawler: the agent whose group it obeys, how many rules that has, and the delay it asks for."""
    return _asked(spark, sf_dir)[1].select("host", "user_agent", "agent", F.size("rules").alias("n_rules"), "crawl_delay")


QUERIES = {"robots_by_agent": robots_by_agent, "robots_groups": robots_groups}
