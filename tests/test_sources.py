import subprocess

import pytest

from keyfathom.sources.catalogs import CatalogError, load, parse
from keyfathom.sources.files import glob_regex, ignore_rules, read_tree, texts, walk

HEAD = 'msgid ""\nmsgstr ""\n"Content-Type: text/plain; charset=UTF-8\\n"\n\n'


def put(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_parse_catalog():
    text = HEAD + '#, fuzzy\nmsgid "f"\nmsgstr "x"\n\n#~ msgid "old"\n#~ msgstr ""\n\nmsgctxt "c"\nmsgid "a\\nb"\n" more\\t"\nmsgid_plural "p"\nmsgstr[0] ""\nmsgstr[1] ""\n\nmsgid "plain"\nmsgstr ""\n'
    assert parse(text) == [("c", "a\nb more\t", "p"), (None, "plain", None)]


@pytest.mark.parametrize("text", ['msgid "a"\nmsgstr ""\n', HEAD + "nonsense\n", HEAD + 'msgid "a"\n', HEAD + 'msgid "a"\nmsgstr ""\nmsgstr ""\n', ""])
def test_bad_catalogs(text):
    with pytest.raises(CatalogError):
        parse(text)


def test_globs():
    import re

    hit = lambda g, p, s=False: bool(re.match(glob_regex(g, s), p))
    assert hit("**/*.po", "a.po") and hit("**/*.po", "x/y/a.po") and not hit("**/*.po", "a.pot")
    assert hit("*.po", "x/a.po") and not hit("*.po", "x/a.po", True)
    assert hit("{fr,de}/*.p?", "de/a.po") and hit("[a-c].po", "b.po") and not hit("[!a-c].po", "b.po")
    with pytest.raises(ValueError, match="glob"):
        glob_regex("[a")


def test_walk_prunes_and_ignores(tmp_path):
    put(tmp_path, {"a.js": "", "vendor/v.js": "", "x/vendor/w.js": "", "_u/d.js": "", ".hid/c.js": "", "x/Vendor/k.js": "", "gen/o.js": "", "x/b.log": "", "keep.log": "", ".ignore": "", ".gitignore": "*.log\n!keep.log\n/gen/\n"})
    names = lambda: [r for _, r, _ in walk([tmp_path], ["vendor"])]
    assert names() == ["_u/d.js", "a.js", "gen/o.js", "keep.log", "x/Vendor/k.js", "x/b.log"]
    (tmp_path / ".git").mkdir()
    assert names() == ["_u/d.js", "a.js", "keep.log", "x/Vendor/k.js"]
    assert [r for _, r, _ in walk([tmp_path / "x", tmp_path], ["vendor"])].count("x/Vendor/k.js") == 0
    with pytest.raises(FileNotFoundError):
        walk([tmp_path / "none"], [])


def test_ignore_agrees_with_git(tmp_path):
    put(tmp_path, {"a/b/c.txt": "", "a/c.txt": "", "doc/x.txt": "", "doc/y/x.txt": "", "z1.tmp": "", "k/z2.tmp": "", ".gitignore": "a/**/c.txt\ndoc/*.txt\n*.tmp\n!k/z2.tmp\n\\#x\n"})
    subprocess.run(["git", "init", "-q", tmp_path], check=True)
    listed = subprocess.run(["git", "-C", tmp_path, "ls-files", "-o", "--exclude-standard"], check=True, capture_output=True, text=True).stdout.split()
    assert [r for _, r, _ in walk([tmp_path], [])] == sorted(x for x in listed if not x.startswith("."))
    assert ignore_rules("# c\n\n[bad\n") == []


def test_read_tree(spark, tmp_path):
    put(tmp_path, {"A.JS": "x", "_u/b.js": "y", "bad.js": b"\xff\xfe", "c.txt": "z"})
    rows = {r.rel: r.content for r in texts(read_tree(spark, [tmp_path], extensions=["js"])).collect()}
    assert rows == {"A.JS": "x", "_u/b.js": "y", "bad.js": ""}


def test_load_universe(spark, tmp_path):
    body = lambda *keys: HEAD + "".join(f'msgid "{k}"\nmsgstr ""\n\n' for k in keys)
    put(tmp_path, {"fr.po": body("greet"), "x/de.po": body("greet", "part"), "es.pot": HEAD + 'msgid "one sheep"\nmsgid_plural "%d sheep"\nmsgstr[0] ""\n'})
    read = lambda: read_tree(spark, [tmp_path], patterns=["**/*.po", "**/*.pot"]).selectExpr("abs AS path", "content")
    assert sorted(tuple(r) for r in load(read()).fillna("-").collect()) == [("-", "greet", "-"), ("-", "one sheep", "%d sheep"), ("-", "part", "-")]
    put(tmp_path, {"broken.po": 'msgid "a"\nmsgstr ""\n'})
    with pytest.raises(CatalogError, match="broken.po"):
        load(read())
    with pytest.raises(CatalogError, match="no catalog"):
        load(read().where("false"))
