import pytest

from keyfathom.config import CallSpec
from keyfathom.operators import audit, liveness
from keyfathom.operators.extract import SCHEMA, extract_facts

KEYS = "msgctxt string, msgid string, msgid_plural string"


def facts_of(spark, *rows):
    return spark.createDataFrame([("p", "js", *r) for r in rows], SCHEMA)


def statuses(spark, keys, facts, white=()):
    rows = liveness.classify(spark.createDataFrame(keys, KEYS), facts, spark.createDataFrame([(w,) for w in white], "value string")).collect()
    return {(r.msgctxt, r.msgid, r.msgid_plural): (r.status, r.alive_via) for r in rows}


def test_precedence_and_forms(spark):
    facts = facts_of(spark, ("literal", None, "lit", 1), ("literal", None, "white", 1), ("literal", None, "apples", 1), ("guard", "prefix", "cf_", 1), ("guard", "suffix", "_end", 1), ("guard", "contains", "mid", 1), ("source_literal", None, "bare", 1), ("source_literal", None, "lit", 1), ("blind", None, None, 3))
    keys = [(None, k, None) for k in ("lit", "white", "cf_x", "x_end", "a mid b", "CF_x", "bare", "gone", "lit", "")] + [("c", "lit", None), (None, "apple", "apples"), (None, "cf_", None)]
    got = statuses(spark, keys, facts, ["white"])
    assert got == {
        (None, "lit", None): ("alive", "literal"), ("c", "lit", None): ("alive", "literal"), (None, "white", None): ("alive", "whitelist"),
        (None, "cf_x", None): ("alive", "guard"), (None, "x_end", None): ("alive", "guard"), (None, "a mid b", None): ("alive", "guard"), (None, "cf_", None): ("alive", "guard"),
        (None, "CF_x", None): ("dead", None), (None, "bare", None): ("suspect", None), (None, "gone", None): ("dead", None), (None, "apple", "apples"): ("alive", "literal"),
    }


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert statuses(spark, [(None, "a", None)], none) == {(None, "a", None): ("dead", None)}
    assert liveness.classify(spark.createDataFrame([], KEYS), none, spark.createDataFrame([], "value string")).count() == 0
    row = liveness.summary(liveness.classify(spark.createDataFrame([], KEYS), none, spark.createDataFrame([], "value string")), liveness.blind_by_family(none)).first()
    assert tuple(row) == (0, 0, 0, 0, 0)


def test_empty_guard_matches_all(spark):
    assert statuses(spark, [(None, "a", None)], facts_of(spark, ("guard", "prefix", "", 1))) == {(None, "a", None): ("alive", "guard")}


def test_sorted_bucket(spark):
    keys = [("b", "x", None), (None, "z", None), (None, "a", None), ("a", "x", None)]
    v = liveness.classify(spark.createDataFrame(keys, KEYS), spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "value string"))
    assert [(r.msgctxt, r.msgid) for r in liveness.bucket(v, "dead").collect()] == [(None, "a"), (None, "z"), ("a", "x"), ("b", "x")]


@pytest.mark.parametrize("n", [1, 4])
def test_facts_do_not_depend_on_partitions(spark, n):
    specs = [CallSpec("js", "function", "t"), CallSpec("php", "function", "t"), CallSpec("twig", "filter", "trans")]
    files = [(f"{i}.js", "js", f"t('k{i}'); t(x)") for i in range(6)] + [("a.twig", "twig", "{{ 'k'|trans }} {{ v|trans }} \"s\""), ("b.php", "php", "<?php t('p');"), ("n.js", "js", None)]
    facts = extract_facts(spark.createDataFrame(files, "path string, lang string, content string").repartition(n), specs, 3)
    assert {r.value for r in facts.where("fact_type = 'literal'").collect()} == {*(f"k{i}" for i in range(6)), "k", "p"}
    assert {r.family: r.n for r in liveness.blind_by_family(facts).collect()} == {"js": 6, "twig": 1}
    assert "s" in {r.value for r in facts.where("fact_type = 'source_literal'").collect()}


def test_audit_tiers(spark):
    dead = spark.createDataFrame([(None, "whole", None), (None, "Hi %s there", None), (None, "never", None), (None, "100% sure", None), (None, "{x}", None), (None, "", None)], KEYS)
    content = spark.createDataFrame([("a whole Hi",), ("and there",), (None,), ("100 only",)], "content string")
    got = {r.msgid: r.trace for r in audit.audit(dead, content, 3).collect()}
    assert got == {"whole": "substring", "Hi %s there": "none", "never": "none", "100% sure": "none", "{x}": "none"}
    got = {r.msgid: r.trace for r in audit.audit(dead, content, 2).collect()}
    assert got["Hi %s there"] == "none"  # the fragment is "Hi " with its blank
    content = content.union(spark.createDataFrame([("Hi you; sure",)], "content string"))
    wanted = audit.patterns(dead, 3)
    assert {r.msgid: r.trace for r in audit.tiers(wanted, audit.found_patterns(content, wanted)).collect()}["Hi %s there"] == "skeleton"
    for limit in (1, 10, 1000):
        a = {r.pattern for r in audit.found_patterns(content, wanted, limit).collect()}
        assert a == {r.pattern for r in audit.contained_patterns(content, wanted).collect()}
