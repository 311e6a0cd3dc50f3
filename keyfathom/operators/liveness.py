"""Universe against usage: every key is alive (by whitelist, literal or guard), suspect or dead.

All joins are equi-joins, so Catalyst broadcasts a side only where its measured size allows and shuffles on the value
otherwise. Guards need no nested loop: a form's beginnings and ends of the lengths that occur among fragments are joined
to them; a fragment that may lie anywhere is joined by the rarest of its grams to the forms that have it, and compared
there. So a form has as many rows as characters, whatever the number and lengths of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["msgctxt", "msgid", "msgid_plural"]
#: Characters of the grams by which inner fragments are found; shorter fragments are joined to all pieces of their length.
GRAM = 4


def universe(keys: DataFrame) -> DataFrame:
    """Distinct keys without the header's empty msgid; nulls are equal."""
    return keys.select(*KEY).where(F.col("msgid") != "").distinct()


def key_forms(keys: DataFrame) -> DataFrame:
    """One row per key and form: its msgid, and its plural if it has one. The context plays no part in matching."""
    return keys.select(*KEY, F.explode(F.array_compact(F.array("msgid", "msgid_plural"))).alias("form"))


def values(facts: DataFrame, fact_type: str) -> DataFrame:
    return facts.where(F.col("fact_type") == fact_type).select("value").distinct()


def fragments(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact_type") == "guard").select("kind", F.col("value").alias("frag")).distinct()


def blind_by_family(facts: DataFrame) -> DataFrame:
    """(family, n) of the call sites that say nothing; families without one are absent."""
    return facts.where((F.col("fact_type") == "blind") & (F.col("n") > 0)).groupBy("family").agg(F.sum("n").alias("n"))


def _pieces(text: Column, n: Column, size: Column) -> Column:
    """The distinct pieces of ``size`` characters of a text of n >= size."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size)))


def inner_matches(forms: DataFrame, frags: DataFrame) -> DataFrame:
    """Distinct (form, frag) where the fragment, of GRAM characters at least, lies anywhere in the form."""
    grams = lambda df, c: df.where(F.char_length(c) >= GRAM).select(c, F.explode(_pieces(F.col(c), F.char_length(c), F.lit(GRAM))).alias("gram"))
    of_forms = grams(forms.select("form").distinct(), "form")
    seen = of_forms.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no form has rules its fragment out
    counted = grams(frags.select("frag").distinct(), "frag").join(seen, "gram", "left").fillna(0, "n")
    rarest = counted.groupBy("frag").agg(F.min(F.struct("n", "gram")).alias("least")).where("least.n > 0").select("frag", "least.gram")
    return of_forms.join(rarest, "gram").where(F.contains("form", "frag")).select("form", "frag")


def guard_matches(forms: DataFrame, guards: DataFrame) -> DataFrame:
    """Distinct (form, kind, frag) where the fragment is the form's beginning, end or part. Case counts.

    ``guards`` has kind and frag. Lengths of fragments, one number each at most, reach every task as one row."""
    size = F.char_length("frag")
    guards = guards.select("kind", "frag").distinct()
    long = (F.col("kind") == "contains") & (size >= GRAM)
    of = lambda kind: F.collect_set(F.when((F.col("kind") == kind) & ~long, size)).alias(kind)
    lengths = guards.agg(F.struct(of("prefix"), of("suffix"), of("contains")).alias("l")).scalar()
    form, n = F.col("form"), F.char_length("form")
    piece = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("frag"))
    fits = lambda kind: F.filter(F.col("l")[kind], lambda x: x <= n)
    starts = F.transform(fits("prefix"), lambda x: piece("prefix", F.substring(form, F.lit(1), x)))
    ends = F.transform(fits("suffix"), lambda x: piece("suffix", F.substring(form, n - x + 1, x)))
    parts = F.flatten(F.transform(fits("contains"), lambda x: F.transform(_pieces(form, n, x), lambda p: piece("contains", p))))
    cut = forms.select("form").distinct().withColumn("l", lengths)
    cut = cut.select("form", F.explode(F.array_distinct(F.concat(starts, ends, parts))).alias("p")).select("form", "p.kind", "p.frag")
    short = cut.join(guards.where(~long), ["kind", "frag"], "left_semi").select("form", "kind", "frag")
    return short.union(inner_matches(forms, guards.where(long)).select("form", F.lit("contains").alias("kind"), "frag"))


def status(hit: dict[str, Column]) -> tuple[Column, Column]:
    """(status, alive_via) from flags, by strict precedence."""
    via = F.when(hit["whitelist"], "whitelist").when(hit["literal"], "literal").when(hit["guard"], "guard")
    return F.when(via.isNotNull(), "alive").when(hit["suspect"], "suspect").otherwise("dead"), via


def classify(keys: DataFrame, facts: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Verdicts (msgctxt, msgid, msgid_plural, status, alive_via), one per distinct key; either form may hit.

    ``facts`` is what ``extract_facts`` gives, ``whitelist`` has value."""
    said = facts.where(F.col("fact_type").isin("literal", "source_literal"))
    signals = said.select("value", F.when(F.col("fact_type") == "literal", "literal").otherwise("suspect").alias("signal"))
    signals = signals.union(whitelist.select("value", F.lit("whitelist").alias("signal")))
    signals = signals.groupBy(F.col("value").alias("form")).agg(*[F.bool_or(F.col("signal") == s).alias(s) for s in ("whitelist", "literal", "suspect")])
    forms = key_forms(universe(keys))
    guarded = guard_matches(forms, fragments(facts)).select("form", F.lit(True).alias("guard")).distinct()
    names = ("whitelist", "literal", "guard", "suspect")
    hits = forms.join(signals, "form", "left").join(guarded, "form", "left").groupBy(*KEY).agg(*[F.coalesce(F.bool_or(s), F.lit(False)).alias(s) for s in names])
    verdict, via = status({s: F.col(s) for s in names})
    return hits.select(*KEY, verdict.alias("status"), via.alias("alive_via"))


def summary(verdicts: DataFrame, blind: DataFrame) -> DataFrame:
    """One row: total, alive, suspect, dead, blind."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    n = blind.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long"))).scalar()
    return verdicts.agg(F.count("*").alias("total"), count("alive"), count("suspect"), count("dead")).withColumn("blind", n)


def bucket(verdicts: DataFrame, name: str) -> DataFrame:
    """The keys of one status, by context (none first), msgid and plural."""
    return verdicts.where(F.col("status") == name).orderBy(F.asc_nulls_first("msgctxt"), "msgid", F.asc_nulls_first("msgid_plural"))
