import pytest

from keyfathom.config import ConfigError, Output, load, parse
from keyfathom.operators.gate import Budget, exit_code, resolve


def test_defaults_and_unknown_keys():
    c = parse({"mode": "x"})
    assert c.guard_min_len == 3 and c.output.fail_on == "dead" and c.scan.source_roots == (".",)
    assert c.scan.ignore_dirs == ("vendor", "node_modules", "cache", "var")


def test_moved_key_and_bad_values_are_errors(tmp_path):
    for raw in ({"output": {"min_guard_len": 3}}, {"output": {"fail_on": "x"}}, {"calls": [{"lang": "js", "kind": "function"}]}, {"guard": {"min_len": -1}}):
        with pytest.raises(ConfigError):
            parse(raw)
    bad = tmp_path / "bad.toml"
    bad.write_text("[[[")
    for path in (bad, tmp_path / "none.toml"):
        with pytest.raises(ConfigError, match=path.name):
            load(path)


def test_budget_resolution():
    conflict = Output(max_dead=1, max_dead_ratio=0.5)
    assert resolve(7, None, conflict) == Budget(7)
    assert resolve(None, None, Output()) == Budget(0)
    for args in ((None, None, conflict), (1, 0.1, Output()), (None, 1.5, Output()), (None, float("nan"), Output())):
        with pytest.raises(ConfigError):
            resolve(*args)


@pytest.mark.parametrize(
    ("dead", "total", "blind", "fail_on", "budget", "code"),
    [
        (1, 2, 0, "dead", Budget(0), 1), (1, 2, 0, "dead", Budget(1), 0), (1, 2, 3, "dead", Budget(1), 0),
        (1, 2, 3, "dead-or-blind", Budget(1), 1), (9, 9, 9, "never", Budget(0), 0),
        (1, 2, 0, "dead", Budget(None, 0.5), 0), (2, 3, 0, "dead", Budget(None, 0.5), 1), (0, 0, 0, "dead", Budget(None, 0.0), 0),
    ],
)
def test_exit_codes(dead, total, blind, fail_on, budget, code):
    assert exit_code(dead, total, blind, fail_on, budget) == code


def test_what_counts_as_set():
    assert not Budget(0).is_set and Budget(2).is_set and Budget(None, 0.0).is_set
