import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from keyfathom.llm import unigram
from keyfathom.llm.queries import PIECES
from tests.llm.test_operators import COLUMNS, linked, odd_rows, removed, words


def test_stages_by_brute_force(spark, tmp_path):
    item = " ".join(words(50, 40))
    rows = [r[:2] for r in odd_rows() if r[0] not in (13, None)] + [(20, " ".join(words(51, 60)) + " " + item), (21, "12 34 ...")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), COLUMNS)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    want = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    assert kept[0] == want
    groups = linked(list(want.items()))
    want = {i: want[i] for i, _, least in groups if i == least}
    assert kept[1] == want and docs.count() == len(kept[3])
    sizes = {i: n - gone for i, n, gone, _, _ in removed(list(want.items()), 400)}
    assert {i: len(t.encode()) for i, t in kept[2].items()} == sizes
    assert kept[3] == {i: t for i, t in kept[2].items() if i != 20}
    vocab = unigram.load(PIECES)
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.text for r in unigram.decode_documents(found, vocab).collect()} == kept[3]
    assert found.where(~F.col("round_trip")).count() == 0


def test_cut_repeats_of_few_bytes(spark):
    """Passages of 51 words repeat, whatever their bytes; those of 50 words and under 400 bytes stay."""
    r = np.random.default_rng(60)
    pick = lambda n: ["".join(r.choice(list("abcdefgh"), r.integers(3, 6))) for _ in range(n)]
    over, under, one = pick(51), pick(50), list("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")[:51]
    assert len(" ".join(over)) < 309 and len(" ".join(one)) == 101
    own = [pick(70) for _ in range(8)]
    part = [over, over, under, under, one, one, over, over]
    texts = [" ".join(o[:30] + p + o[30:]) for o, p in zip(own, part, strict=True)]
    texts[7] = "\n".join(own[7][:30] + over + own[7][30:])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(9, None, "en", "s", 0)]
    found = {i: t for i, t, *_ in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    want = {i: o if p is not under else o[:30] + p + o[30:] for i, (o, p) in enumerate(zip(own, part, strict=True))}
    assert {i: t.split() for i, t in found.items() if t is not None} == want and found[9] is None


def test_mixed_and_unlabelled_documents_stay(spark):
    """Half of the letters may lie in several languages; without any label there is no language to judge by."""
    text = {"da": " ".join(words(80, 60)), "el": "αβγδε ζηθικ λμνξο " * 20, "ru": "абвгд ежзик лмноп " * 20}
    rows = [(k * 10 + i, text[lang], lang, "s", 1) for k, lang in enumerate(text) for i in range(10)]
    mixed = " ".join(t[:300] for t in text.values())
    rows += [(100, mixed, None, "s", 1), (101, "123 ...", None, "s", 1), (102, "語言 " * 30, None, "s", 1), (103, None, None, "s", 0)]
    stay = lambda df: {r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    df = spark.createDataFrame(rows, COLUMNS)
    assert stay(df) == {r[0] for r in rows} - {101, 102, 103}
    assert stay(df.withColumn("lang", F.lit(None).cast("string"))) == {r[0] for r in rows} - {101, 103}


def test_one_of_each_group_stays(spark):
    """Near copies without ids, or with different texts under one id, leave one document a group."""
    base = [words(k, 100) for k in (70, 71, 72)]
    near = lambda k, j: " ".join([*base[k][:j], "changed", *base[k][j + 1 :]])
    rows = [(None, near(0, 3)), (None, near(0, 4)), (5, near(1, 3)), (5, near(1, 4)), (6, near(1, 5)), (None, near(2, 3)), (7, near(2, 4)), (5, "alone"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    kept = sorted((r.doc_id or 0, (r.text or "")[:5]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == sorted([(0, ""), (0, ""), (0, near(0, 3)[:5]), (5, "alone"), (5, near(1, 3)[:5]), (7, near(2, 4)[:5])])
