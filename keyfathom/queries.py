"""Queries over the driver's tables that stand in for catalogs and sources, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfathom.config import FAIL_ON, CallSpec, Output
from keyfathom.functions.strings import PLACEHOLDER, decode_token, guards_of, php_single, skeleton_fragments, unescape_js, unescape_php_double, unescape_twig
from keyfathom.operators import audit, liveness
from keyfathom.operators.extract import extract_facts, first_match, language_of, twig_facts, twig_filter_blind, twig_filter_keys, twig_literals
from keyfathom.operators.gate import Budget, exceeded_column, exit_code_column, resolve
from keyfathom.operators.liveness import KEY
from keyfathom.plans import report
from keyfathom.plans.engine import white_lines
from keyfathom.sources import catalogs
from keyfathom.sources.files import glob_regex, listed

Query = Callable[[SparkSession, str], DataFrame]
MIN_LEN = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(ctxt: Column, msgid: Column, plural: Column) -> list[Column]:
    return [c.cast("string").alias(n) for c, n in zip((ctxt, msgid, plural), KEY, strict=True)]


# The universe: part names, part types with brands as plurals, nations and benchmark texts.


def keys(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    part = _table(spark, d, "part")
    rows = part.select(*_key(none, F.col("p_name"), none)).union(part.select(*_key(F.lit("type"), F.col("p_type"), F.col("p_brand"))))
    rows = rows.union(_table(spark, d, "nation").select(*_key(none, F.col("n_name"), none)))
    return rows.union(_table(spark, d, "benchmark").select(*_key(F.lit("bench"), F.col("text"), none)))


U = """u AS (
  SELECT DISTINCT * FROM (
    SELECT CAST(NULL AS VARCHAR) AS msgctxt, p_name AS msgid, CAST(NULL AS VARCHAR) AS msgid_plural FROM part
    UNION ALL SELECT 'type', p_type, p_brand FROM part
    UNION ALL SELECT NULL, n_name, NULL FROM nation
    UNION ALL SELECT 'bench', text, NULL FROM benchmark) WHERE msgid <> ''),
forms AS (SELECT *, msgid AS form FROM u UNION ALL SELECT *, msgid_plural FROM u WHERE msgid_plural IS NOT NULL)"""


# Usage facts, made from columns: what calls, templates and plain strings would say.


def usage(spark: SparkSession, d: str) -> DataFrame:
    fact = lambda df, kind, value, fact_type: df.select(F.lit("t").alias("path"), F.lit("php").alias("family"), F.lit(fact_type).alias("fact_type"), F.lit(kind).cast("string").alias("kind"), value.alias("value"), F.lit(1).cast("long").alias("n"))
    part, nation, line = (_table(spark, d, t) for t in ("part", "nation", "lineitem"))
    used = part.where("p_size <= 2").join(line.where("l_quantity > 49").select("l_partkey").distinct(), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    rows = fact(used, None, F.col("p_name"), "literal")
    rows = rows.union(fact(nation.where("n_regionkey = 1"), "prefix", F.substring("n_name", 1, 3), "guard"))
    rows = rows.union(fact(part.where("p_size = 7"), "suffix", F.expr("right(p_name, 4)"), "guard"))
    rows = rows.union(fact(part.where("p_size = 9"), "contains", F.substring("p_brand", 4, 4), "guard"))
    rows = rows.union(fact(part.where("p_size BETWEEN 10 AND 12"), None, F.col("p_name"), "source_literal"))
    orders = _table(spark, d, "orders")
    blind = orders.groupBy(F.when(F.col("o_orderstatus") == "O", "js").otherwise("twig").alias("family")).agg(F.count("*").alias("n"))
    return rows.union(blind.select(F.lit("t"), "family", F.lit("blind"), F.lit(None).cast("string"), F.lit(None).cast("string"), "n"))


def whitelist(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("value"))


W = """lit AS (SELECT DISTINCT p_name AS value FROM part WHERE p_size <= 2 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)),
guards AS (SELECT DISTINCT * FROM (
  SELECT 'prefix' AS kind, substr(n_name, 1, 3) AS frag FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT 'suffix', right(p_name, 4) FROM part WHERE p_size = 7
  UNION ALL SELECT 'contains', substr(p_brand, 4, 4) FROM part WHERE p_size = 9)),
src AS (SELECT DISTINCT p_name AS value FROM part WHERE p_size BETWEEN 10 AND 12),
white AS (SELECT n_name AS value FROM nation WHERE n_regionkey = 2),
blind AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'js' ELSE 'twig' END AS family, COUNT(*) AS n FROM orders GROUP BY 1)"""
FITS = "((g.kind = 'prefix' AND starts_with(f.form, g.frag)) OR (g.kind = 'suffix' AND ends_with(f.form, g.frag)) OR (g.kind = 'contains' AND contains(f.form, g.frag)))"
V = f"""hits AS (SELECT msgctxt, msgid, msgid_plural,
    bool_or(f.form IN (SELECT value FROM white)) AS w, bool_or(f.form IN (SELECT value FROM lit)) AS l,
    bool_or(EXISTS (SELECT 1 FROM guards g WHERE {FITS})) AS g, bool_or(f.form IN (SELECT value FROM src)) AS s
  FROM forms f GROUP BY ALL),
v AS (SELECT msgctxt, msgid, msgid_plural, CASE WHEN w OR l OR g THEN 'alive' WHEN s THEN 'suspect' ELSE 'dead' END AS status,
    CASE WHEN w THEN 'whitelist' WHEN l THEN 'literal' WHEN g THEN 'guard' END AS alive_via FROM hits)"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return liveness.classify(keys(spark, d), usage(spark, d), whitelist(spark, d))


def _semi(signal: Callable[[SparkSession, str], DataFrame]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        forms = liveness.key_forms(liveness.universe(keys(spark, d)))
        return forms.join(signal(spark, d).select(F.col("value").alias("form")), "form", "left_semi").select(*KEY).distinct()

    return query


def _guard(kind: str | None) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        forms = liveness.key_forms(liveness.universe(keys(spark, d)))
        guards = liveness.fragments(usage(spark, d))
        hits = liveness.guard_matches(forms, guards.where(F.col("kind") == kind) if kind else guards)
        return forms.join(hits.select("form").distinct(), "form", "left_semi").select(*KEY).distinct()

    return query


def _guard_sql(kind: str | None) -> str:
    only = f"g.kind = '{kind}' AND " if kind else ""
    return f"WITH {U}, {W} SELECT DISTINCT msgctxt, msgid, msgid_plural FROM forms f WHERE EXISTS (SELECT 1 FROM guards g WHERE {only}{FITS})"


def dead_anti(spark: SparkSession, d: str) -> DataFrame:
    """Dead keys as anti joins, cheap ones first."""
    facts = usage(spark, d)
    universe = liveness.universe(keys(spark, d))
    forms = liveness.key_forms(universe)
    signals = whitelist(spark, d).union(liveness.values(facts, "literal")).union(liveness.values(facts, "source_literal"))
    hit = forms.join(signals.select(F.col("value").alias("form")), "form", "left_semi").select(*KEY)
    guarded = forms.join(liveness.guard_matches(forms, liveness.fragments(facts)), "form", "left_semi").select(*KEY)
    found = hit.union(guarded).toDF(*[f"hit_{c}" for c in KEY])
    same = [F.col(c).eqNullSafe(F.col(f"hit_{c}")) for c in KEY]
    return universe.join(found, same, "left_anti")


# Virtual source files: one snippet a row, so that the facts follow from the columns.

SPECS = (
    CallSpec("js", "function", "i18n"), CallSpec("js", "method", "t", ("i18n", "this.i18n")), CallSpec("js", "index", "locale"),
    CallSpec("php", "function", "i18n"), CallSpec("php", "method", "get", ("i18n", "get_i18n()")), CallSpec("twig", "filter", "trans"),
)
_JS = """CASE p_partkey % 8 WHEN 0 THEN concat('const a = i18n(\\'', p_name, '\\'); // i18n(\\'never\\')')
  WHEN 1 THEN concat('x = i18n(`', p_type, '_$', '{v}`) + `$', '{i18n.t("', p_brand, '")}`;')
  WHEN 2 THEN 'i18n(v, "fallback"); /* i18n("gone") */'
  WHEN 3 THEN concat('const o = { k: "', p_name, '" }; other.t("no key")')
  WHEN 4 THEN concat('locale["', p_name, '"]; r = /["\\']/.test(s); this.i18n.t("', p_type, '" + n)')
  WHEN 5 THEN concat('return <p title="', p_brand, '">Don\\'t {i18n("', p_name, '")}</p>;')
  WHEN 6 THEN 'locale[key]; i18n(a ? "yes" : "no")'
  ELSE concat('i18n("', p_brand, '" + "/" + "', p_type, '")') END"""
_PHP = """CASE p_partkey % 7 WHEN 0 THEN concat('<p>it\\'s</p><?php echo i18n(\\'', p_name, '\\'); ?> i18n("html")')
  WHEN 1 THEN concat('<?php i18n(\\'', p_type, '_\\' . $x); # i18n("comment")')
  WHEN 2 THEN concat('<?php i18n("', p_brand, '_$x"); i18n($y);')
  WHEN 3 THEN concat('<?php $i18n->get(\\'', p_name, '\\'); $other->get(\\'', p_type, '\\');')
  WHEN 4 THEN concat('<?= App::get_i18n()->get("', p_name, '") ?>')
  WHEN 5 THEN concat('<?php $a = ["k" => \\'', p_name, '\\', \\'b\\' => "n $v"]; /* i18n("c") */')
  ELSE concat('<?php $z = <<<EOT\\ni18n("', p_name, '")\\nEOT;\\ni18n(\\'it\\\\\\'s ', p_name, '\\');') END"""


def _snippets(lang: str, body: str, specs: tuple[CallSpec, ...] = SPECS) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        part = _table(spark, d, "part").repartition(F.col("p_partkey"))
        files = part.select(F.col("p_partkey").cast("string").alias("path"), F.lit(lang).alias("lang"), F.expr(body).alias("content"))
        return extract_facts(files, specs, MIN_LEN)

    return query


def _facts_sql(family: str, rows: list[tuple[int, int, str, str, str]]) -> str:
    """rows: remainder, modulus, fact type, kind, value as SQL; blind rows have no value."""
    one = lambda r, m, t, k, v: f"SELECT CAST(p_partkey AS VARCHAR) AS path, '{family}' AS family, '{t}' AS fact_type, CAST({k} AS VARCHAR) AS kind, CAST({v} AS VARCHAR) AS value, CAST(1 AS BIGINT) AS n FROM part WHERE p_partkey % {m} = {r}"
    return " UNION ALL ".join(one(*row) for row in rows)


L, G, B, S = "literal", "guard", "blind", "source_literal"
_JS_SQL = _facts_sql("js", [
    (0, 8, L, "NULL", "p_name"), (0, 8, S, "NULL", "p_name"),
    (1, 8, G, "'prefix'", "p_type || '_'"), (1, 8, L, "NULL", "p_brand"), (1, 8, S, "NULL", "p_brand"),
    (2, 8, B, "NULL", "NULL"), (2, 8, S, "NULL", "'fallback'"),
    (3, 8, S, "NULL", "p_name"), (3, 8, S, "NULL", "'no key'"),
    (4, 8, L, "NULL", "p_name"), (4, 8, S, "NULL", "p_name"), (4, 8, G, "'prefix'", "p_type"), (4, 8, S, "NULL", "p_type"),
    (5, 8, L, "NULL", "p_name"), (5, 8, S, "NULL", "p_name"), (5, 8, S, "NULL", "p_brand"),
    (6, 8, S, "NULL", "'yes'"), (6, 8, S, "NULL", "'no'"),
    (7, 8, L, "NULL", "p_brand || '/' || p_type"), (7, 8, S, "NULL", "p_brand"), (7, 8, S, "NULL", "'/'"), (7, 8, S, "NULL", "p_type"),
]) + " UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'js', 'blind', NULL, NULL, CAST(2 AS BIGINT) FROM part WHERE p_partkey % 8 = 6"
_PHP_SQL = _facts_sql("php", [
    (0, 7, L, "NULL", "p_name"), (0, 7, S, "NULL", "p_name"),
    (1, 7, G, "'prefix'", "p_type || '_'"), (1, 7, S, "NULL", "p_type || '_'"),
    (2, 7, G, "'prefix'", "p_brand || '_'"), (2, 7, B, "NULL", "NULL"),
    (3, 7, L, "NULL", "p_name"), (3, 7, S, "NULL", "p_name"), (3, 7, S, "NULL", "p_type"),
    (4, 7, L, "NULL", "p_name"), (4, 7, S, "NULL", "p_name"),
    (5, 7, S, "NULL", "'k'"), (5, 7, S, "NULL", "'b'"), (5, 7, S, "NULL", "p_name"),
    (6, 7, L, "NULL", "'it''s ' || p_name"), (6, 7, S, "NULL", "'it''s ' || p_name"),
])

_TWIG = "concat('<a title=\"', p_brand, '\">{{ \\'', p_name, '\\'|trans }} {{ v | trans }} {{ \"a#{b}\"|trans }}</a>')"


def _twig(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("twig").alias("lang"), F.expr(_TWIG).alias("content"))


def spec_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts as call sites against a spec for each type and brand, of which several fit one site: those of brands that
    end in 5 take any receiver."""
    part = _table(spark, d, "part")
    sites = part.select(F.col("p_partkey").alias("site"), F.lit("method").alias("kind"), F.col("p_type").alias("name"), F.col("p_brand").alias("receiver"))
    specs = part.groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("ord"))
    receiver = F.when(~F.col("p_brand").endswith("5"), F.array("p_brand"))
    return first_match(sites, specs.select("ord", F.lit("method").alias("kind"), F.col("p_type").alias("name"), receiver.alias("receiver")))


def segments_to_guards(spark: SparkSession, d: str) -> DataFrame:
    """Part type, hole, brand, hole, name: a prefix, an inner part and a suffix."""
    s = lambda c: F.struct(F.lit(False).alias("is_hole"), c.alias("text"))
    hole = F.struct(F.lit(True).alias("is_hole"), F.lit(None).cast("string").alias("text"))
    words = F.array(s(F.col("p_type")), hole, s(F.substring("p_brand", 7, 2)), s(F.col("p_brand")), hole, s(F.col("p_name")))
    return _table(spark, d, "part").select("p_partkey", F.explode(guards_of(words, MIN_LEN)).alias("g")).select("p_partkey", "g.kind", "g.frag")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Page urls as file paths, with extensions dealt by page id."""
    names = F.array(*map(F.lit, ("PHP", "twig", "mjs", "jsx", "cts", "TSX", "txt")))
    path = F.concat(F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1), F.lit("/f."), F.element_at(names, (F.col("page_id") % 7 + 1).cast("int")))
    return _pages(spark, d).select(path.alias("path"))


PATHS = "paths AS (SELECT regexp_extract(url, '^[^:]*://([^?#]*)', 1) || '/f.' || ['PHP','twig','mjs','jsx','cts','TSX','txt'][CAST(page_id % 7 + 1 AS INT)] AS path FROM pages)"


def ext_to_lang(spark: SparkSession, d: str) -> DataFrame:
    lang = language_of(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return _paths(spark, d).withColumn("lang", lang).where(F.col("lang").isNotNull())


def _dead_content(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keys of which some lie whole and some in parts in pages and documents: words of texts, and a placeholder form."""
    word = lambda i: F.element_at(F.split("text", r"\s+"), i)
    rows = _table(spark, d, "benchmark").select(word(1).alias("a"), word(2).alias("b"), word(3).alias("c"), F.col("item_id"))
    none = F.lit(None)
    made = rows.select(*_key(none, F.concat_ws(" ", "a", "b"), none)).union(rows.select(*_key(F.lit("p"), F.concat(F.col("b"), F.lit(" %s "), F.col("c")), none)))
    made = made.union(rows.select(*_key(none, F.concat(F.lit("zq-"), F.col("item_id"), F.lit(" {n}")), none)))
    return liveness.universe(made), _table(spark, d, "documents").select(F.col("text").alias("content"))


D = r"""words AS (SELECT regexp_split_to_array(text, '\s+') AS w, item_id FROM benchmark),
dead AS (SELECT DISTINCT * FROM (SELECT CAST(NULL AS VARCHAR) AS msgctxt, w[1] || ' ' || w[2] AS msgid, CAST(NULL AS VARCHAR) AS msgid_plural FROM words
  UNION ALL SELECT 'p', w[2] || ' %s ' || w[3], NULL FROM words UNION ALL SELECT NULL, 'zq-' || item_id || ' {n}', NULL FROM words)),
parts AS (SELECT *, CASE WHEN msgctxt = 'p' THEN list_distinct([x for x in string_split(msgid, '%s') if length(x) >= 3])
  WHEN msgid LIKE 'zq-%' THEN [x for x in [replace(msgid, '{n}', '')] if length(x) >= 3] ELSE [] END AS frags FROM dead),
tiers AS (SELECT msgctxt, msgid, msgid_plural, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(text, msgid)) THEN 'substring'
  WHEN len(frags) > 0 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(frags) AS x) q WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, x))) THEN 'skeleton' ELSE 'none' END AS trace FROM parts)"""


def audit_tiers(spark: SparkSession, d: str) -> DataFrame:
    dead, content = _dead_content(spark, d)
    return audit.audit(dead, content, MIN_LEN)


def liveness_summary(spark: SparkSession, d: str) -> DataFrame:
    return liveness.summary(verdicts(spark, d), liveness.blind_by_family(usage(spark, d)))


SUMMARY = "SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'alive') AS alive, COUNT(*) FILTER (status = 'suspect') AS suspect, COUNT(*) FILTER (status = 'dead') AS dead, (SELECT CAST(SUM(n) AS BIGINT) FROM blind) AS blind FROM v"


def budget_gate(spark: SparkSession, d: str) -> DataFrame:
    s = liveness_summary(spark, d)
    dead, total = F.col("dead"), F.col("total")
    return s.select("total", "dead", exceeded_column(Budget(100), dead, total).alias("over_count"), exceeded_column(Budget(None, 0.5), dead, total).alias("over_ratio"))


def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    modes = F.explode(F.array(*map(F.lit, FAIL_ON))).alias("fail_on")
    code = exit_code_column(Budget(1_000_000), F.col("dead"), F.col("total"), F.col("blind"), F.col("fail_on"))
    return liveness_summary(spark, d).select(modes, "dead", "total", "blind").select("fail_on", code.cast("int").alias("code"))


#: Command line and configuration, of which the command line wins as a whole.
BUDGETS = {"default": (None, None, Output()), "configured": (None, None, Output(max_dead=40)), "count": (5, None, Output(max_dead_ratio=0.9)), "ratio": (None, 0.25, Output(max_dead=7))}


def _with_budgets(column: Callable[[Budget], Column], name: str) -> Query:
    """A row for each of BUDGETS, resolved."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(k).alias("budget"), column(resolve(*v)).alias(name)) for k, v in BUDGETS.items()])
        return liveness_summary(spark, d).select(F.explode(rows).alias("r")).select("r.*")

    return query


def _budget_line(budget: Budget) -> Column:
    @F.pandas_udf("string")
    def line(dead, total):  # noqa: ANN001, ANN202
        return dead.__class__([report.budget_line(int(a), int(b), budget) for a, b in zip(dead, total, strict=True)], dtype=object)

    return line("dead", "total")


def blind_lines(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def line(families, n):  # noqa: ANN001, ANN202
        return families.__class__([report.blind_line({k: int(v) for k, v in zip(a, b, strict=True)}) for a, b in zip(families, n, strict=True)], dtype=object)

    found = liveness.blind_by_family(usage(spark, d)).agg(F.collect_list("family").alias("f"), F.collect_list("n").alias("n"))
    return found.select(line("f", "n").alias("line"))


def display_keys(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def shown(context, msgid, plural):  # noqa: ANN001, ANN202
        return msgid.__class__([report.display_key(dict(zip(KEY, row, strict=True))) for row in zip(context, msgid, plural, strict=True)], dtype=object)

    return liveness.universe(keys(spark, d)).select(shown(*KEY).alias("shown"))


_HEADER = """msgid ""\\nmsgstr ""\\n"Content-Type: text/plain; charset=UTF-8\\\\n"\\n\\n"""
_CATALOG = f"""concat(CASE WHEN p_size > 1 THEN '{_HEADER}' ELSE '' END,
  'msgctxt "', p_brand, '"\\nmsgid "', p_name, ' \\\\"q\\\\""\\n"\\\\tand on"\\nmsgstr ""\\n\\n', '#, fuzzy\\nmsgid "', p_type, '"\\nmsgstr "x"\\n\\n',
  '#~ msgid "old"\\n#~ msgstr ""\\n\\n', 'msgid "', p_type, '"\\nmsgid_plural "', p_type, 's"\\nmsgstr[0] ""\\nmsgstr[1] ""\\n')"""


def parsed_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """A catalog for each part; those of size 1 lack their header."""
    files = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_CATALOG).cast("binary").alias("content"))
    return catalogs.parsed(files).withColumn("error", F.col("error").isNotNull())


def white_lines_of(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "nation").select(F.expr("CASE n_regionkey WHEN 0 THEN concat('  # ', n_name) WHEN 1 THEN concat('\\t', n_name, ' \\r') WHEN 2 THEN '  ' ELSE concat(n_name, ' #') END").alias("value"))
    return white_lines(lines)


GLOBS = ("**/f.{mjs,jsx}", "**/[a-m]*/f.TSX")


def globbed(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(F.concat_ws("|", *[F.when(F.col("path").rlike("^" + glob_regex(g)), F.lit("1")) for g in GLOBS]) != "").select("path")


def decoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each language, static and dynamic ones."""

    @F.pandas_udf("string")
    def decode(lang, token):  # noqa: ANN001, ANN202
        return token.__class__([decode_token(a, b) for a, b in zip(lang, token, strict=True)], dtype=object)

    one = lambda lang, before, after: F.struct(F.lit(lang).alias("lang"), F.concat(F.lit(before), F.col("p_name"), F.lit(after)).alias("token"))
    tokens = [one("php", "'", r"\n\''"), one("php", '"', r'\n$x"'), one("php", '"', r'\n\$x"'), one("js", "`", r"\n${x}`"), one("js", "'", r"\n\''"), one("twig", '"', '#{x}"'), one("twig", "'", r"\n\''"), one("js", "", "")]
    rows = _table(spark, d, "part").select("p_partkey", F.posexplode(F.array(*tokens)).alias("i", "t"))
    return rows.select("p_partkey", "i", decode("t.lang", "t.token").alias("value"))


def has_msgid(spark: SparkSession, d: str) -> DataFrame:
    universe = liveness.universe(keys(spark, d))
    return spark.createDataFrame([(m, catalogs.contains_msgid(universe, m)) for m in ("FRANCE", "Brand#11", "no such key")], "msgid string, held boolean")


#: A static call whose key is its second argument, beside a spec for its first.
STATIC = (CallSpec("php", "method", "get", ("Lang",), 1), CallSpec("php", "method", "get", ("Other",)), CallSpec("js", "function", "t", None, 1))
_STATIC = "concat('<?php Lang::get(\\'x\\', \\'', p_name, '\\'); Lang::get(\\'one\\'); Other::get(\\'', p_brand, '\\', $y); Lang::get($z, \\'', p_type, '_\\' . $x);')"
_SECOND = "concat('t(v, \"', p_name, '\"); t(\"one\"); t(a, `', p_type, '_$', '{x}`); t(1, u)')"


def _unescaped(function: Callable[[str], str]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        @F.pandas_udf("string")
        def decode(x):  # noqa: ANN001, ANN202
            return x.map(function)

        raw = F.concat(F.col("p_name"), F.lit("\\n"), F.col("p_brand"), F.lit("\\q\\\\"), F.col("p_type"))
        return _table(spark, d, "part").select("p_partkey", decode(raw).alias("value"))

    return query


def _q(frame: Callable[[DataFrame], DataFrame], name: str) -> Query:
    return lambda spark, d: frame(_table(spark, d, name))


QUERIES: dict[str, Query] = {
    "universe_distinct": lambda s, d: liveness.universe(keys(s, d)),
    "key_forms": lambda s, d: liveness.key_forms(liveness.universe(keys(s, d))),
    "semi_whitelist": _semi(whitelist),
    "semi_literal": _semi(lambda s, d: liveness.values(usage(s, d), "literal")),
    "semi_source_literal": _semi(lambda s, d: liveness.values(usage(s, d), "source_literal")),
    "guard_prefix": _guard("prefix"),
    "guard_suffix": _guard("suffix"),
    "guard_contains": _guard("contains"),
    "guard_any": _guard(None),
    "guard_min_len": _q(lambda p: p.select(F.explode(guards_of(F.array(F.struct(F.lit(False).alias("is_hole"), F.substring("p_name", 1, F.col("p_size") % 6).alias("text"))), MIN_LEN)).alias("g")).select("g.frag").distinct(), "part"),
    "dead_anti": dead_anti,
    "classify_verdicts": verdicts,
    "classify_status_counts": lambda s, d: verdicts(s, d).groupBy("status", "alive_via").agg(F.count("*").alias("n")),
    "blind_by_family": lambda s, d: liveness.blind_by_family(usage(s, d)),
    "liveness_summary": liveness_summary,
    "segments_to_guards": segments_to_guards,
    "spec_first_match": spec_first_match,
    "quoted_literals": lambda s, d: _pages(s, d).select("page_id", F.explode(twig_literals(F.col("html"))).alias("value")),
    "filter_literals": lambda s, d: _twig(s, d).select("path", F.explode(twig_filter_keys(F.col("content"), "trans")).alias("value")),
    "filter_blind": lambda s, d: _twig(s, d).select("path", twig_filter_blind(F.col("content"), "trans").alias("n")),
    "extract_twig_facts": lambda s, d: twig_facts(_twig(s, d), SPECS),
    "extract_js_facts": _snippets("jsx", _JS),
    "extract_php_facts": _snippets("php", _PHP),
    "unescape_php_single": _q(lambda p: p.select("p_partkey", php_single(F.concat(F.col("p_name"), F.lit("\\'\\\\\\n"), F.col("p_brand"))).alias("value")), "part"),
    "unescape_php_double": _unescaped(unescape_php_double),
    "unescape_js": _unescaped(unescape_js),
    "skeleton_fragments": _q(lambda e: e.select("event_id", F.explode(skeleton_fragments(F.concat(F.col("event_type"), F.lit(" of %(who)s: "), F.col("props"), F.lit(" %d!")), MIN_LEN)).alias("frag")), "events"),
    "audit_substring": lambda s, d: audit_tiers(s, d).where("trace = 'substring'").select(*KEY),
    "audit_skeleton": lambda s, d: audit_tiers(s, d).where("trace = 'skeleton'").select(*KEY),
    "audit_tiers": audit_tiers,
    "budget_gate": budget_gate,
    "exit_code": exit_codes,
    "dead_sorted": lambda s, d: liveness.bucket(verdicts(s, d), "dead").select(*KEY),
    "suspect_sorted": lambda s, d: liveness.bucket(verdicts(s, d), "suspect").select(*KEY),
    "traced_sorted": lambda s, d: audit_tiers(s, d).where("trace <> 'none'").orderBy(F.asc_nulls_first("msgctxt"), "msgid"),
    "display_key": display_keys,
    "dedup_paths": lambda s, d: listed(_paths(s, d).union(_paths(s, d)), ()),
    "ext_to_lang": ext_to_lang,
    "ignore_dirs": lambda s, d: listed(_paths(s, d), ("de", "es")),
    "glob_match": globbed,
    "parse_catalogs": parsed_catalogs,
    "contains_msgid": has_msgid,
    "whitelist_lines": white_lines_of,
    "resolve_budget": _with_budgets(lambda b: exceeded_column(b, F.col("dead"), F.col("total")), "over"),
    "budget_line": _with_budgets(_budget_line, "line"),
    "blind_line": blind_lines,
    "decode_token": decoded_tokens,
    "unescape_twig": _unescaped(unescape_twig),
    "extract_php_static_second": _snippets("php", _STATIC, STATIC),
    "extract_js_second": _snippets("ts", _SECOND, STATIC),
}

_VERDICTS = f"WITH {U}, {W}, {V} "
_SEMI = "SELECT DISTINCT msgctxt, msgid, msgid_plural FROM forms f WHERE f.form IN (SELECT value FROM {})"
_CLEAN = PLACEHOLDER.replace("'", "''")

ORACLE_SQL: dict[str, str] = {
    "universe_distinct": f"WITH {U} SELECT * FROM u",
    "key_forms": f"WITH {U} SELECT * FROM forms",
    "semi_whitelist": f"WITH {U}, {W} " + _SEMI.format("white"),
    "semi_literal": f"WITH {U}, {W} " + _SEMI.format("lit"),
    "semi_source_literal": f"WITH {U}, {W} " + _SEMI.format("src"),
    **{f"guard_{k or 'any'}": _guard_sql(k) for k in ("prefix", "suffix", "contains", None)},
    "guard_min_len": "SELECT DISTINCT substr(p_name, 1, p_size % 6) AS frag FROM part WHERE length(substr(p_name, 1, p_size % 6)) >= 3",
    "dead_anti": _VERDICTS + "SELECT msgctxt, msgid, msgid_plural FROM v WHERE status = 'dead'",
    "classify_verdicts": _VERDICTS + "SELECT * FROM v",
    "classify_status_counts": _VERDICTS + "SELECT status, alive_via, COUNT(*) AS n FROM v GROUP BY ALL",
    "blind_by_family": f"WITH {W} SELECT family, n FROM blind",
    "liveness_summary": _VERDICTS + SUMMARY,
    "segments_to_guards": "SELECT p_partkey, kind, frag FROM (SELECT p_partkey, 'prefix' AS kind, p_type AS frag FROM part UNION ALL SELECT p_partkey, 'contains', substr(p_brand, 7, 2) FROM part UNION ALL SELECT p_partkey, 'contains', p_brand FROM part UNION ALL SELECT p_partkey, 'suffix', p_name FROM part) WHERE length(frag) >= 3",
    "spec_first_match": "SELECT a.p_partkey AS site, MIN(b.ord) AS ord FROM part a JOIN (SELECT p_type, p_brand, MIN(p_partkey) AS ord FROM part GROUP BY ALL) b ON a.p_type = b.p_type AND (ends_with(b.p_brand, '5') OR a.p_brand = b.p_brand) GROUP BY 1",
    "quoted_literals": r"""SELECT page_id, substr(s, 2, length(s) - 2) AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '''([^''\n]*)''|"([^"\n]*)"')) AS s FROM pages) WHERE length(s) > 2 AND NOT contains(s, '#{')""",
    "filter_literals": "SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS value FROM part",
    "filter_blind": "SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(2 AS BIGINT) AS n FROM part",
    "extract_twig_facts": _facts_sql("twig", [(0, 1, L, "NULL", "p_name"), (0, 1, S, "NULL", "p_name"), (0, 1, S, "NULL", "p_brand")]) + " UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'twig', 'blind', NULL, NULL, CAST(2 AS BIGINT) FROM part",
    "extract_js_facts": _JS_SQL,
    "extract_php_facts": _PHP_SQL,
    "unescape_php_single": r"""SELECT p_partkey, p_name || '''' || '\' || '\n' || p_brand AS value FROM part""",
    "unescape_php_double": r"""SELECT p_partkey, p_name || chr(10) || p_brand || '\q' || '\' || p_type AS value FROM part""",
    "unescape_js": r"""SELECT p_partkey, p_name || chr(10) || p_brand || 'q' || '\' || p_type AS value FROM part""",
    "skeleton_fragments": f"""SELECT event_id, frag FROM (SELECT event_id, unnest(string_split_regex(event_type || ' of %(who)s: ' || props || ' %d!', '{_CLEAN}')) AS frag FROM events) WHERE length(frag) >= 3""",
    "audit_substring": f"WITH {D} SELECT msgctxt, msgid, msgid_plural FROM tiers WHERE trace = 'substring'",
    "audit_skeleton": f"WITH {D} SELECT msgctxt, msgid, msgid_plural FROM tiers WHERE trace = 'skeleton'",
    "audit_tiers": f"WITH {D} SELECT * FROM tiers",
    "budget_gate": f"{_VERDICTS}, s AS ({SUMMARY}) SELECT total, dead, dead > 100 AS over_count, total > 0 AND dead / total > 0.5 AS over_ratio FROM s",
    "exit_code": f"{_VERDICTS}, s AS ({SUMMARY}) SELECT fail_on, CAST(CASE WHEN fail_on = 'never' THEN 0 WHEN dead > 1000000 THEN 1 WHEN fail_on = 'dead-or-blind' AND blind > 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM s, (VALUES ('dead'), ('dead-or-blind'), ('never')) t(fail_on)",
    "dead_sorted": _VERDICTS + "SELECT msgctxt, msgid, msgid_plural FROM v WHERE status = 'dead'",
    "suspect_sorted": _VERDICTS + "SELECT msgctxt, msgid, msgid_plural FROM v WHERE status = 'suspect'",
    "traced_sorted": f"WITH {D} SELECT * FROM tiers WHERE trace <> 'none'",
    "display_key": f"WITH {U} SELECT CASE WHEN msgctxt IS NULL THEN '' ELSE '[' || msgctxt || '] ' END || msgid || CASE WHEN msgid_plural IS NULL THEN '' ELSE '  / ' || msgid_plural END AS shown FROM u",
    "dedup_paths": f"WITH {PATHS} SELECT DISTINCT path FROM paths",
    "ext_to_lang": f"WITH {PATHS} SELECT path, CASE lower(regexp_extract(path, '[.]([^./]*)$', 1)) WHEN 'php' THEN 'php' WHEN 'twig' THEN 'twig' WHEN 'mjs' THEN 'js' WHEN 'jsx' THEN 'jsx' WHEN 'cts' THEN 'ts' WHEN 'tsx' THEN 'tsx' END AS lang FROM paths WHERE NOT path LIKE '%.txt'",
    "glob_match": f"WITH {PATHS} SELECT path FROM paths WHERE regexp_matches(path, '(^|/)f[.](mjs|jsx)$') OR regexp_matches(path, '(^|/)[a-m].*/f[.]TSX$')",
    "parse_catalogs": r"""SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size > 1 THEN p_brand END AS msgctxt, CASE WHEN p_size > 1 THEN p_name || ' "q"' || chr(9) || 'and on' END AS msgid, CAST(NULL AS VARCHAR) AS msgid_plural, p_size <= 1 AS error FROM part
      UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, p_type, p_type || 's', false FROM part WHERE p_size > 1""",
    "contains_msgid": f"WITH {U} SELECT m AS msgid, m IN (SELECT form FROM forms) AS held FROM (VALUES ('FRANCE'), ('Brand#11'), ('no such key')) t(m)",
    "whitelist_lines": "SELECT CASE WHEN n_regionkey = 1 THEN n_name ELSE n_name || ' #' END AS value FROM nation WHERE n_regionkey NOT IN (0, 2)",
    "resolve_budget": f"{_VERDICTS}, s AS ({SUMMARY}) SELECT unnest(['default', 'configured', 'count', 'ratio']) AS budget, unnest([dead > 0, dead > 40, dead > 5, total > 0 AND dead / total > 0.25]) AS over FROM s",
    "budget_line": f"""{_VERDICTS}, s AS ({SUMMARY}), c AS (SELECT dead, total, unnest([40, 5]) AS most, unnest(['configured', 'count']) AS budget FROM s)
      SELECT budget, 'Budget: ' || dead || ' / ' || most || ' dead allowed — ' || CASE WHEN dead > most THEN 'OVER by ' || (dead - most) ELSE 'within budget (' || (most - dead) || ' headroom)' END || '.' AS line FROM c
      UNION ALL SELECT 'default', NULL UNION ALL SELECT 'ratio', 'Budget: ' || printf('%.1f', dead / total * 100) || '% / 25.0% dead ratio — ' || CASE WHEN dead / total > 0.25 THEN 'OVER' ELSE 'within budget' END || '.' FROM s""",
    "blind_line": f"WITH {W} SELECT 'Blind spots: ' || coalesce(string_agg(family || '=' || n, ', ' ORDER BY family), 'none') AS line FROM blind",
    "decode_token": r"""SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([p_name || '\n' || chr(39), NULL, p_name || chr(10) || '$x', NULL, p_name || chr(10) || chr(39), NULL, p_name || '\n' || chr(39), '']) AS value FROM part""",
    "unescape_twig": r"""SELECT p_partkey, p_name || '\n' || p_brand || '\q' || '\' || p_type AS value FROM part""",
    "extract_php_static_second": _facts_sql("php", [
        (0, 1, L, "NULL", "p_name"), (0, 1, L, "NULL", "p_brand"), (0, 1, G, "'prefix'", "p_type || '_'"),
        (0, 1, S, "NULL", "'x'"), (0, 1, S, "NULL", "p_name"), (0, 1, S, "NULL", "'one'"), (0, 1, S, "NULL", "p_brand"), (0, 1, S, "NULL", "p_type || '_'"),
    ]),
    "extract_js_second": _facts_sql("js", [(0, 1, L, "NULL", "p_name"), (0, 1, G, "'prefix'", "p_type || '_'"), (0, 1, B, "NULL", "NULL"), (0, 1, S, "NULL", "p_name"), (0, 1, S, "NULL", "'one'")]),
    "ignore_dirs": f"WITH {PATHS} SELECT DISTINCT path FROM paths WHERE NOT regexp_matches(path, '(^|/)(de|es)/')",
}
