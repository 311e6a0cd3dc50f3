"""URL filters: rules first, then a tree of path templates that rejects by smoothed labelled purity.

Pages that a rule judges are the labelled ones. Per host, path segments with a digit and those of a node that has many
rare values become ``*``. Sibling branches whose labels don't differ from their siblings' as a whole are merged into
``~``. A template's purity is its share of blocked labels, smoothed towards that of the same template over all hosts,
which is smoothed towards the share of all labels. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfathom.llm.storage import drop, materialize, small

#: (verdict, host, path); a rule fits its host and all subdomains where the path starts with its path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Levels of the tree by default; the segments below are one ``**``, so templates that differ only there are judged as one.
DEPTH = 4
#: A node's rare values are generalised if it has at least this many and they are this share of its pages.
VARIETY = 8
RARE = 0.02
WEIGHT = 4.0
DEVIATES = 1.96
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, UPPER.lower())).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda c, x: c.when(x[0], x[1]), zip(fits[1:], values[1:], strict=True), F.when(fits[0], values[0])) if fits else F.lit(None).cast("string")
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", threshold: float = 0.5, depth: int = DEPTH) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    A null url or one without ``://`` has empty host and path and is judged as their template. Without any label the
    share of blocked is taken as a half less a hair, which allows. ``depth`` is the number of levels; each costs two jobs
    over the templates. Repeated rows give repeated results; other columns
    are ignored; an empty table gives no rows."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    plain = F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.lit("*")).otherwise(s))
    deep = F.when(F.size(parts) > depth, F.concat(F.slice(plain, 1, depth), F.array(F.lit("**")))).otherwise(plain)
    rows = rows.withColumn("raw", F.concat(F.lit("/"), F.array_join(deep, "/")))

    # the tree: one row per host and raw template, with its pages and labels
    tree = rows.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = tree.withColumns({f"s{i}": F.coalesce(F.get(F.filter(F.split("raw", "/"), lambda s: s != ""), F.lit(i)), F.lit("")) for i in range(depth + 1)})
    last = tree
    for i in range(depth):
        above, node = ["host", *(f"s{j}" for j in range(i))], ["host", *(f"s{j}" for j in range(i + 1))]
        values = tree.groupBy(*node).agg(F.sum("n").alias("own"))
        kinds = values.groupBy(*above).agg(F.sum("own").alias("all"), F.count("*").alias("kinds"))
        rare = values.join(kinds, above).where((F.col("kinds") >= VARIETY) & (F.col("own") <= RARE * F.col("all")) & (F.col(f"s{i}") != "")).select(*node, F.lit(True).alias("rare"))
        tree = tree.join(rare, node, "left").withColumn(f"s{i}", F.when(F.col("rare"), F.lit("*")).otherwise(F.col(f"s{i}"))).drop("rare")
        tree = materialize(tree, "templates")  # each level reads the one before more than once
        drop(last)
        last = tree
    for i in reversed(range(depth)):
        above, node = ["host", *(f"s{j}" for j in range(i))], ["host", *(f"s{j}" for j in range(i + 1))]
        own = tree.groupBy(*node).agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"))
        siblings = Window.partitionBy(*above)
        own = own.withColumns({"all_m": F.sum("m").over(siblings), "all_b": F.sum("b").over(siblings)})
        p, rest = F.col("all_b") / F.col("all_m"), F.col("all_m") - F.col("m")
        gap = F.abs(F.col("b") / F.col("m") - (F.col("all_b") - F.col("b")) / rest)
        alike = (F.col("m") > 0) & (rest > 0) & (gap <= DEVIATES * F.sqrt(p * (1 - p) * (1 / F.col("m") + 1 / rest)))
        merged = own.where((F.col(f"s{i}") != "") & alike).select(*node, F.lit(True).alias("alike"))
        tree = tree.join(merged, node, "left").withColumn(f"s{i}", F.when(F.col("alike"), F.lit("~")).otherwise(F.col(f"s{i}"))).drop("alike")
        tree = materialize(tree, "templates")
        drop(last)
        last = tree
    segments = F.filter(F.array(*[f"s{i}" for i in range(depth + 1)]), lambda s: s != "")
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join(segments, "/")))

    share = F.coalesce(F.sum("blocked"), F.lit(0)) + 0.999
    everything = tree.agg(share / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).scalar()
    over_hosts = tree.groupBy("template").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b")).withColumn("all_p", everything)
    over_hosts = over_hosts.select("template", ((F.col("b") + WEIGHT * F.col("all_p")) / (F.col("m") + WEIGHT)).alias("wide_p"))
    own = tree.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b")).join(over_hosts, "template")
    own = own.select("host", "template", ((F.col("b") + WEIGHT * F.col("wide_p")) / (F.col("m") + WEIGHT)).alias("purity"))
    # one row a template, written, so that Spark can split the pages of a hot one
    mapped = small(materialize(tree.select("host", "raw", "template").join(own, ["host", "template"]), "judged"))
    method = F.when(F.col("purity") >= threshold, F.lit("block")).otherwise("allow")
    return rows.join(mapped, ["host", "raw"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
