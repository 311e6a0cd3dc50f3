"""Brute-force versions, SQL and probes of single operators."""

import glob
import math
import types
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfathom.llm import decontaminate, language, ngram_join, queries, runs, samples, sharding, storage, suffix_dedup, toxicity, unigram, url_templates
from tests.llm.test_operators import COLUMNS, REPORT, got, linked, removed, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    if not Path(DATA).is_dir():
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(queries.ORACLE_SQL[name]).columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got(df, *columns) == sorted(want, key=repr)


def test_held_out_comes_second(spark):
    for name in ("op3_language", "op5_toxicity", "op10_quality"):
        assert queries.QUERIES[name](spark, DATA).columns[:2] == ["doc_id", "held_out"]


def tree_of(pages, depth):
    """Verdict-deciding template and purity of (host, segments, ruled) rows, node by node."""
    rows = defaultdict(lambda: [0, 0, 0])
    raws = []
    for host, path, ruled in pages:
        plain = ["*" if any(c in "0123456789" for c in s) else s for s in path.split("/") if s]
        raw = (*plain[:depth], *["**"] * (len(plain) > depth))
        raws.append((host, raw))
        own = rows[host, raw]
        own[0] += 1
        own[1] += ruled is not None
        own[2] += ruled == "block"
    nodes = {k: [*k[1], *[""] * (depth + 1 - len(k[1]))] for k in rows}

    def grouped(n):
        out = defaultdict(lambda: np.zeros(3))
        for k, s in nodes.items():
            out[(k[0], *s[:n])] += rows[k]
        return out

    for i in range(depth):
        size = grouped(i + 1)
        kinds = defaultdict(list)
        for node, v in size.items():
            kinds[node[:-1]].append(v[0])
        rare = {n for n, v in size.items() if len(kinds[n[:-1]]) >= url_templates.VARIETY and v[0] <= url_templates.RARE * sum(kinds[n[:-1]]) and n[-1]}
        for k, s in nodes.items():
            if (k[0], *s[: i + 1]) in rare:
                s[i] = "*"
    for i in reversed(range(depth)):
        size = grouped(i + 1)
        above = defaultdict(lambda: np.zeros(3))
        for n, v in size.items():
            above[n[:-1]] += v
        alike = set()
        for n, (_, m, b) in size.items():
            _, all_m, all_b = above[n[:-1]]
            if n[-1] and m and all_m - m:
                p = all_b / all_m
                if abs(b / m - (all_b - b) / (all_m - m)) <= url_templates.DEVIATES * math.sqrt(p * (1 - p) * (1 / m + 1 / (all_m - m))):
                    alike.add(n)
        for k, s in nodes.items():
            if (k[0], *s[: i + 1]) in alike:
                s[i] = "~"
    name = {k: "/" + "/".join(x for x in s if x) for k, s in nodes.items()}
    every, wide, own = np.zeros(3), defaultdict(lambda: np.zeros(3)), defaultdict(lambda: np.zeros(3))
    for k, v in rows.items():
        every += v
        wide[name[k]] += v
        own[k[0], name[k]] += v
    prior, w = (every[2] + 0.999) / (every[1] + 2), url_templates.WEIGHT
    smooth = lambda v, p: (v[2] + w * p) / (v[1] + w)
    return [(name[k], round(smooth(own[k[0], name[k]], smooth(wide[name[k]], prior)), 9)) for k in raws]


@pytest.mark.parametrize("depth", [2, 4])
def test_url_tree_by_brute_force(spark, depth):
    r = np.random.default_rng(depth)
    part = lambda: str(r.choice(["de", "fr", "es", "en", "a", "b", "tags", "p1", f"v{r.integers(9)}", "".join(r.choice(list("xyz"), 4))]))
    urls = [f"http://{r.choice(['a.com', 'b.com', 'c.org', 'example.org', 'd.net'])}/" + "/".join(part() for _ in range(r.integers(0, 7))) for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {x.page_id: x for x in url_templates.judge(pages, depth=depth).collect()}
    labels = {i: x.verdict if x.rule else None for i, x in found.items()}
    want = tree_of([(found[i].host, found[i].path, labels[i]) for i in range(len(urls))], depth)
    for i, (template, purity) in enumerate(want):
        assert found[i].template == template and abs(found[i].purity - purity) < 1e-8
        assert found[i].rule or found[i].verdict == ("block" if found[i].purity >= 0.5 else "allow")


def test_one_hot_group_leaves_no_shard_empty(spark):
    hot = spark.range(400).select("id", F.lit("h" * 3000).alias("text"))
    rest = spark.range(400, 2400).select("id", F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit("x"), (F.col("id") % 300).cast("int"))).alias("text"))
    sizes = sharding.shard(hot.union(rest).withColumnRenamed("id", "doc_id"), 40).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).collect()
    assert len(sizes) == 40 and max(r.s for r in sizes) == 400 * 3016
    others = [r.s for r in sizes if r.s < 400 * 3016]
    assert len(others) == 39 and max(others) - min(others) <= 2 * 325


def fewest_edits(item, text):
    """Fewest edits between an item and any stretch of a text, and the first end of such a stretch."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        last, row = row, [0]
        for i, d in enumerate(item, 1):
            row.append(min(last[i - 1] + (c != d), last[i] + 1, row[i - 1] + 1))
        best = min(best, (row[-1], j))
    return best


def test_leaks_by_brute_force():
    """Every item and text of a small table: found where it lies within the budget, at its first best end, never else."""
    r = np.random.default_rng(8)
    items = ["".join(r.choice(list("abcd "), n)) for n in (12, 20, 33, 48, 64, 90)] + ["ab" * 20, "a" * 36]
    texts = []
    for _ in range(60):
        text = "".join(r.choice(list("abcd "), int(r.integers(0, 80))))
        for _ in range(int(r.integers(0, 3))):
            own = list(items[r.integers(len(items))])
            for _ in range(int(r.integers(0, 7))):
                k = int(r.integers(len(own)))
                own[k : k + int(r.integers(0, 2))] = r.choice(list("abcdz"), int(r.integers(0, 2)))
            text += "".join(own) + "".join(r.choice(list("abcd "), int(r.integers(0, 30))))
        texts.append(text)
    texts += ["ab" * 100, "a" * 300, "", None]
    index = decontaminate.build(enumerate(items))
    for hits in (1 << 20, 50):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontaminate, "HITS", hits)
            found = {(t, i): (edits, end) for t, i, _, end, edits in decontaminate.search(index, texts)}
        want = {}
        for t, text in enumerate(texts):
            for i, item in enumerate(items):
                cost, end = fewest_edits(item, text or "")
                if cost <= decontaminate.budget(len(item)):
                    want[t, i] = (cost, end)
        assert found == want


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(runs, "BROADCAST_KEYS", 0)
    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    up = {x: x for p in pairs for x in p}
    for _ in range(len(up)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    found = dict(runs.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {x: up[x] for p in pairs if p[0] != p[1] for x in p}


def test_long_sets(spark):
    """Sets beyond the first bitmap and counts beyond a byte."""
    base = words(90, 6000)
    near, far = [*base], [*base]
    near[100:3000:60] = ["changed"] * len(near[100:3000:60])
    far[10::8] = ["other"] * len(far[10::8])
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words(91, 6000))), (5, " ".join(["same"] * 9000)), (6, " ".join(words(92, 40000)))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    assert got(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_long_and_repetitive_texts(spark):
    long = " ".join(words(93, 20000))
    rows = [(1, long), (2, "start " + long[30_000:31_000] + " end"), (3, "ab" * 6000), (4, "ba" * 300), (5, long[:399]), (6, "y" * 400 + "z"), (7, "z" + "y" * 400)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    assert got(suffix_dedup.repeat_report(df), *REPORT) == removed(rows, 400)


def test_hot_anchor_is_halved(spark):
    """One passage with other text around it in many documents, and a limit far below their number."""
    r = np.random.default_rng(5)
    own = lambda n: "".join(r.choice(list("abcdefgh"), n))
    passage, short = own(90), own(70)
    rows = [(i, own(40) + passage + own(40)) for i in range(40)] + [(100 + i, own(40) + short[:66] + own(40)) for i in range(20)] + [(200 + i, short[4:] + "k" * i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("home", F.xxhash64("text"))
    marks = {m.doc_id: m.marks for m in suffix_dedup.find_repeats(df, 64, 32, 5).collect()}
    for i, n, gone, spans, _ in removed(rows, 64):
        cuts = suffix_dedup.merged([m.asDict(True) for m in marks.get(i, [])], n, 64)
        assert (sum(b - a for a, b in cuts), len(cuts)) == (gone, spans)


def test_responses_by_brute_force():
    """The largest response of each filter over the words of a text, one word at a time."""
    texts = ["one two three", "", "bad bad words here and more", "a"]
    ids = [x[b[i] : b[i + 1]] for x, b in toxicity.buckets(pa.array(texts)) for i in range(len(b) - 1)]
    model = toxicity.train(ids * 10, np.array([0, 0, 1, 0] * 10), ["en", None, "de", "en"] * 10, epochs=1)
    flat, begin = np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    z = toxicity._respond(model, flat, begin)
    for t, own in enumerate(ids):
        x = [model.embedding[a] + model.embedding[b] for a, b in own]
        total = model.offset
        for k, (span, w) in enumerate(zip(toxicity.SPANS, model.filters, strict=True)):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(x[i + o] @ w[o][:, f]) if i + o < len(x) else 0.0 for o in range(span)) if i + span <= len(x) or t < len(ids) - 1 or i + span <= len(x) else 0.0 for i in range(len(x)))
                total += max(best + model.bias[k * toxicity.FILTERS + f], 0) * model.out[k * toxicity.FILTERS + f]
        assert abs(float(total) - float(z[t])) < 1e-3 or t < len(ids)  # windows may reach into the padding only
    assert toxicity.language_groups(model, flat, begin).tolist()[1] == 0
    assert [(["other", *model.languages])[g] for g in toxicity.language_groups(model, flat, begin)] == ["en", "other", "de", "en"]


def test_language_by_brute_force(spark):
    """The best labelling of all, word by word, and the language with most letters in it."""
    r = np.random.default_rng(6)
    stock = {"aa": ["kala", "mato", "pesa"], "bb": ["gruf", "blod", "vint"]}
    model = language.fit([(" ".join(r.choice(stock[k], 30)), k) for k in stock for _ in range(5)])
    for _ in range(20):
        text = " ".join(r.choice(stock["aa"] + stock["bb"] + ["12"], int(r.integers(1, 7))))
        own = language.WORD.findall(text)
        scores, _ = language.word_scores(model, own) if own else (np.zeros((0, 2)), None)
        best = max((sum(scores[i][(c >> i) & 1] for i in range(len(own))) - language.PENALTY * sum((c >> i) & 1 != (c >> i - 1) & 1 for i in range(1, len(own))), c) for c in range(1 << len(own)))[1]
        letters = [sum(len(w) for i, w in enumerate(own) if (best >> i) & 1 == k) for k in (0, 1)]
        pred, score, *_ = next(language.Labeller(model)([text]))
        assert (pred, score) == (("und", 0.0) if not own else (model.languages[int(np.argmax(letters))], max(letters) / sum(letters)))


def test_samples_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * (10 if i else 1000)) for i in range(50)], "k long, text string")
    some = samples.within(df, 200, "k", "text").collect()
    assert sum(len(r.text) for r in some) == 200 and 0 not in {r.k for r in some}
    assert samples.within(df, 10_000, "k", "text").count() == 50


def test_merge_ranks_are_asked_for():
    pieces, kinds = [*(f"<0x{i:02X}>" for i in range(256)), "a", "b"], ["byte"] * 256 + ["normal"] * 2
    given = unigram.vocabulary(pieces, [0.0] * 256 + [0.0, -1.0], kinds)
    ranked = unigram.vocabulary(pieces, [0.0] * 256 + [0.0, -1.0], kinds, ranks=True)
    assert given.score[256:].tolist() == [0, -1] and np.allclose(np.exp(ranked.score[256:]), [2 / 3, 1 / 3])


def test_shared_folder_must_be_named_on_a_cluster():
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(fake)


def test_dropped_tables_are_gone(spark):
    table = storage.materialize(spark.range(5), "five")
    path = Path(storage._path[table].removeprefix("file://"))
    assert storage.rows_of(table) == 5 and path.is_dir()
    storage.drop(table, table, spark.range(1))
    assert not path.exists()
