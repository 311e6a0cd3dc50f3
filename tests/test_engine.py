import json

from keyfathom.cli import main
from keyfathom.config import CallSpec
from keyfathom.operators.gate import Budget
from keyfathom.plans.report import Report, render_json, render_text
from keyfathom.streaming.facts import file_facts

HEAD = 'msgid ""\nmsgstr ""\n"Content-Type: text/plain; charset=UTF-8\\n"\n\n'


def project(tmp_path, keys, sources, config):
    (tmp_path / "po").mkdir()
    (tmp_path / "po/fr.po").write_text(HEAD + "".join(f'msgid "{k}"\nmsgstr ""\n\n' for k in keys))
    for name, body in sources.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "k.toml").write_text(config)
    return ["scan", str(tmp_path), "-c", str(tmp_path / "k.toml")]


JS = '[[calls]]\nlang = "js"\nkind = "function"\nname = "t"\n'


def test_every_bucket(spark, tmp_path, capsys):
    shop = {"cart.js": "render(t('cart.empty')); show(t(`state_${order.state}`)); t(label); const icon = 'basket'; // see 'returns'", "vendor/old.js": "t('gift card')", "keep.txt": "# mailed by the shop\n\n  receipt \n"}
    args = project(tmp_path, ["cart.empty", "state_paid", "basket", "returns", "gift card", "receipt"], shop, JS + '[whitelist]\nfile = "keep.txt"\n')
    assert main([*args, "--audit", "-f", "json"], spark) == 1
    out = capsys.readouterr().out
    assert out.endswith("}")
    got = json.loads(out)
    assert got["summary"] == {"total": 6, "alive": 3, "suspect": 1, "dead": 2, "blind": 1}
    assert got["alive"] == [{"msgid": "cart.empty", "alive_via": "literal"}, {"msgid": "receipt", "alive_via": "whitelist"}, {"msgid": "state_paid", "alive_via": "guard"}]
    assert got["audit"] == {"dead_total": 2, "no_trace": 1, "substring": 1, "skeleton": 0, "traced": [{"msgid": "returns", "trace": "substring"}]}
    assert got["blind"] == {"js": 1} and "budget" not in got
    assert main([*args, "--max-dead", "2"], spark) == 0
    assert "Budget: 2 / 2 dead allowed — within budget (0 headroom)." in capsys.readouterr().out
    assert main([*args, "--max-dead", "1"], spark) == 1


def test_errors_exit_2(spark, tmp_path, capsys):
    assert main(["scan", str(tmp_path), "-c", str(tmp_path / "none.toml")], spark) == 2
    args = project(tmp_path, ["a"], {}, JS + '[whitelist]\nfile = "none"\n')
    assert main(args, spark) == 2
    assert main([*args, "--max-dead", "1", "--max-dead-ratio", "0.1"], spark) == 2
    assert "error:" in capsys.readouterr().err


def test_other_convention_is_configuration(spark, tmp_path):
    config = '[[calls]]\nlang = "php"\nkind = "function"\nname = "say"\nkey_arg_index = 1\n[output]\nformat = "json"\n'
    assert main(project(tmp_path, ["late fee"], {"fees.php": "<p><?= say($locale, 'late fee') ?></p>"}, config), spark) == 0


def test_reports():
    row = lambda c, m, p=None, **k: {"msgctxt": c, "msgid": m, "msgid_plural": p, **k}
    report = Report([row("c", "x", "xs")], [], [], {"twig": 1, "js": 2}, [row("c", "x", "xs", trace="none")])
    text = render_text(report, Budget(None, 0.25))
    assert "  [c] x  / xs\n" in text and "js=2, twig=1" in text and "100.0% / 25.0% dead ratio — OVER." in text and "Suspect (" not in text
    got = json.loads(render_json(report, Budget(5)))
    assert got["budget"] == {"kind": "count", "limit": 5.0, "dead": 1, "over": False} and got["dead"] == [{"msgctxt": "c", "msgid": "x", "msgid_plural": "xs"}]
    assert list(got) == ["scope_caveat", "summary", "dead", "suspect", "alive", "blind", "budget", "audit"]
    assert "Blind spots: none" in render_text(Report([], [], [], {}), Budget(0))


def test_stream_of_files(spark, tmp_path):
    spark.createDataFrame([("a.js", "js", "t('k'); t(v)")], "path string, lang string, content string").write.parquet(str(tmp_path / "in/1"))
    facts = file_facts(spark, str(tmp_path / "in/*"), [CallSpec("js", "function", "t")], 3)
    q = facts.writeStream.format("memory").queryName("facts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.fact_type, r.value) for r in spark.table("facts").collect()} == {("literal", "k"), ("source_literal", "k"), ("blind", None)}
