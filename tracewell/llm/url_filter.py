"""URL filters by a tree of path templates for each host, in built-in functions only.

1. A url is cut into host and path; listed rules decide it if one fits (the longest).
2. In a path, numbers and long hexadecimal names become ``#``: the path's shape.  From here on the work is
   on one row per (host, shape) with its counts, made map-side first.
3. In the tree of a host's shapes, a node with very many children and few pages in each is variable: its
   children become ``*``.
4. Branches under one node whose pages spread alike over what follows, and over the rules' labels, are merged
   into ``~``: each branch is compared with all branches of the node together (chi-square, linear in branches).
5. A template is rejected if its share of blocked pages among labelled ones reaches ``REJECT``, both as it is and
   smoothed.  Labels are the decisions of the rules; the prior is the share over all labelled pages.  A template
   without labels is never rejected, however many pages are blocked elsewhere.

Defined results: a null url or one without ``://`` has empty host and path; no rule fits an empty host; a page
that no rule decides gets its template's verdict; without any label the prior is one half and nothing is
rejected; rows that repeat an id are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE_NAMES = r"[0-9a-f]{16,}|[0-9]+"
#: A node is variable from this many children on, if they have fewer pages each than that on average.
MANY_CHILDREN, FEW_PAGES = 20, 5
#: Branches with fewer pages are too small to be told apart.
LEAST_PAGES = 5
#: Standard deviations of chi-square above its mean up to which branches are alike.
ALIKE = 3.0
#: Weight of the prior in pages, and the share from which a template is rejected.
PRIOR_PAGES, REJECT = 5.0, 0.8
#: Rules stand in the plan; longer lists belong in a table.
MOST_RULES = 1000
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    name = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_for(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(path: Column) -> Column:
    return F.regexp_replace(path, VARIABLE_NAMES, "#")


def parsed(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``page_id, host, path, shape, decided`` of every row."""
    return (
        pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        .select("*", shape(F.col("path")).alias("shape"), rule_for(rules, F.col("host"), F.col("path")).alias("decided"))
    )


def shapes(rows: DataFrame) -> DataFrame:
    """``host, shape, pages, bad, good``: the labelled counts of every shape of a host."""
    label = F.col("decided.verdict")
    return rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(label == "block", 1)).alias("bad"),
        F.count(F.when(label == "allow", 1)).alias("good"))


def templates(counts: DataFrame) -> DataFrame:
    """``host, shape, template`` for every row of ``counts``."""
    names = F.split("shape", "/")
    at = counts.select("host", "shape", "pages", "bad", "good", names.alias("names"),
                       F.explode(F.sequence(F.lit(1), F.size(names))).alias("i")).select(
        "host", "shape", "pages", "bad", "good", "i", F.element_at("names", F.col("i")).alias("name"),
        F.concat_ws("/", F.slice("names", F.lit(1), F.col("i") - 1), F.array(F.lit(""))).alias("above"),
        F.concat_ws("/", F.array(F.lit("")), F.slice("names", F.col("i") + 1, F.size("names"))).alias("below"))
    outcomes = F.explode(F.array(
        F.struct(F.lit("bad").alias("label"), F.col("bad").alias("n")),
        F.struct(F.lit("good").alias("label"), F.col("good").alias("n")),
        F.struct(F.lit("none").alias("label"), (F.col("pages") - F.col("bad") - F.col("good")).alias("n"))))
    # i stands with `above` in every key: the same text above can not be at two depths, but it keeps keys short to compare
    seen = at.select("host", "i", "above", "name", "below", outcomes.alias("o")).filter(F.col("o.n") > 0).groupBy(
        "host", "i", "above", "name", "below", "o.label").agg(F.sum("o.n").alias("n"))
    branches = seen.groupBy("host", "i", "above", "name").agg(F.sum("n").alias("branch"))
    nodes = branches.groupBy("host", "i", "above").agg(F.count(F.lit(1)).alias("children"), F.sum("branch").alias("node"))
    profile = seen.groupBy("host", "i", "above", "below", "label").agg(F.sum("n").alias("pooled"))
    kinds = profile.groupBy("host", "i", "above").agg((F.count(F.lit(1)) - 1).alias("freedom"))
    node = ["host", "i", "above"]
    spread = seen.join(profile, [*node, "below", "label"]).groupBy(*node, "name").agg(
        F.sum((F.col("n") * F.col("n")).cast("double") / F.col("pooled")).alias("squares"))
    away = F.col("squares") * F.col("node") / F.col("branch") - F.col("branch")
    alike = (F.col("branch") < LEAST_PAGES) | (away <= F.col("freedom") + ALIKE * F.sqrt(2.0 * F.col("freedom")))
    token = (
        F.when((F.col("children") >= MANY_CHILDREN) & (F.col("node") < FEW_PAGES * F.col("children")), F.lit("*"))
        .when((F.col("children") > 1) & alike, F.lit("~")).otherwise(F.col("name")))
    decided = branches.join(nodes, node).join(kinds, node).join(spread, [*node, "name"]).select(
        *node, "name", token.alias("token"))
    return at.select("host", "shape", "i", "above", "name").join(decided, [*node, "name"]).groupBy("host", "shape").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), "/").alias("template"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, template, purity``."""
    rows = parsed(pages, rules)
    counts = written(shapes(rows), "shapes")
    total = counts.agg(F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labelled")).first()
    prior = total["bad"] / total["labelled"] if total["labelled"] else 0.5
    named = written(counts.join(templates(counts), ["host", "shape"]), "templates")
    judged = named.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).select(
        "host", "template",
        ((F.col("bad") + F.lit(PRIOR_PAGES * prior)) / (F.col("bad") + F.col("good") + F.lit(PRIOR_PAGES))).alias("purity"),
        ((F.col("bad") > 0) & (F.col("bad") >= F.lit(REJECT) * (F.col("bad") + F.col("good")))).alias("own"))
    by_shape = named.select("host", "shape", "template").join(judged, ["host", "template"])
    method = F.when(F.col("own") & (F.col("purity") >= REJECT), "block").otherwise("allow")
    return rows.join(by_shape, ["host", "shape"]).select(
        "page_id", "host", "path", F.col("decided.rule").alias("rule"),
        F.coalesce(F.col("decided.verdict"), method).alias("verdict"), "template", "purity")
