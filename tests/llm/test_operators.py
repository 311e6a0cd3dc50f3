import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfathom.llm import decontaminate, language, media, ngram_join, quality, queries, sharding, suffix_dedup, toxicity, unigram, url_templates
from keyfathom.llm.runs import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS = ["ka", "lo", "mi", "tu", "re", "sa", "po", "ne", "vi", "du"]


def words(seed, n):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(VOWELS, r.integers(1, 5))) for _ in range(n)]


def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties, exact and near copies, shared passages."""
    base = words(1, 120)
    near = [*base]
    near[60] = "changed"
    passage = " ".join(words(2, 130))
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, None), (5, ""), (6, "   \n"), (7, "one two"), (8, "one two"), (9, "One\tTWO")]
    rows += [(10, passage + " " + " ".join(words(3, 40))), (11, " ".join(words(4, 50)) + " " + passage), (12, "x" * 3000), (13, " ".join(words(5, 20000)))]
    rows += [(14, "ab " * 400), (15, "æøå ☃ 😀 ▁ 語 " * 40), (1, " ".join(base)), (None, " ".join(words(6, 90))), (16, "one two three four")]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns named like those that operators make."""
    names = ["name", "home", "anchor", "piece", "marks", "row", "shard", "key", "size", "token", "score", "tile", "label", "spans", "n"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def got(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(s), min(least[root(k)], default=None)) for k, (i, s) in enumerate(sets)), key=repr)


def test_near_duplicates(docs, clashing, empty):
    want = linked([r[:2] for r in odd_rows()])
    columns = ("doc_id", "n_shingles", "component_id")
    assert got(ngram_join.near_duplicates(docs), *columns) == want
    assert got(ngram_join.near_duplicates(clashing), *columns) == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = words(100 + g, int(r.integers(6, 90)))
        for _ in range(12):
            own = list(base)
            for _ in range(int(r.integers(0, 5))):
                own[int(r.integers(len(own)))] = f"w{r.integers(50)}"
            rows.append((len(rows), " ".join(own)))
    monkeypatch.setattr(ngram_join, "MEETING", 5)
    monkeypatch.setattr(ngram_join, "BUCKET", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_near_copies_make_few_candidates(spark, monkeypatch):
    """A group of near copies that its meetings leave in parts: candidates grow with its rows, not their pairs."""
    base = words(130, 140)
    rows = [(k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(140)]
    made, real = spark.sparkContext.accumulator(0), ngram_join._candidates

    def counted(pick):
        def run(batches, inner=real(pick)):
            for batch in inner(batches):
                made.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id") == linked(rows)
    assert 100 < made.value < 10 * len(rows)


def test_pairs_are_left_to_the_first_known_meeting():
    """Three unlike labels at two tokens, whose rows know both, one, or neither of them."""
    sets = [np.arange(1, 20, dtype=np.uint64) * np.uint64(1 << 40)] * 3
    rows = [(t, 0, k, k, 19, ngram_join.point(s), True, known) for t in (-7, 5) for k, (s, known) in enumerate(zip(sets, ([-7, 5], [-7], [5]), strict=True))]
    names = ["token", "block", "name", "label", "n", "point", "asks", "known"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows if r[0] == t]) for t in (-7, 5)]
    found = [[tuple(r.values()) for b in ngram_join._candidates(ngram_join.apart)([batch]) for r in b.to_pylist()] for batch in batches]
    assert found == [[(0, 1), (0, 2), (1, 2)], [(0, 2), (1, 2)]]


@given(st.lists(st.lists(st.integers(0, 400), min_size=1, max_size=60, unique=True), min_size=2, max_size=40))
@settings(max_examples=25, deadline=None)
def test_count_tree_misses_nothing(lists):
    from keyfathom.llm.textbytes import mix

    sets = [np.sort(mix(np.array(x, np.uint64))) for x in lists]
    points, bits = ngram_join.points_of(type("C", (), {"to_pylist": lambda self: [ngram_join.point(s) for s in sets]})())
    sizes = np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(ngram_join.close(bits, sizes, i, tree.order[tree.near(points[i], len(s))]).tolist())
        assert {j for j, t in enumerate(sets) if ngram_join.similar(s, t)} <= found


def test_components(spark):
    pairs = [(1, 2), (2, 3), (7, 6), (6, 5), (5, 4), (9, 9)] + [(100, k) for k in range(101, 130)]
    found = dict(components(spark.createDataFrame(pairs, "a long, b long")).distinct().collect())
    assert all(found[k] == 1 for k in (2, 3)) and all(found[k] == 4 for k in (5, 6, 7)) and all(found[k] == 100 for k in range(101, 130))


def removed(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(int)
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, b in texts:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


REPORT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats(docs, clashing, empty):
    rows = [r[:2] for r in odd_rows() if r[0] != 13]
    want = removed(rows, 400)
    assert got(suffix_dedup.repeat_report(docs.where("doc_id IS NULL OR doc_id <> 13")), *REPORT) == want
    cut = suffix_dedup.remove_repeats(clashing.where("doc_id IS NULL OR doc_id <> 13"))
    assert cut.columns == clashing.columns and cut.count() == len(rows)
    assert {r.doc_id: r.text for r in cut.collect()}[4] is None
    assert suffix_dedup.repeat_report(empty).count() == 0


@pytest.mark.parametrize("crowd", [2, 60_000])
def test_repeats_by_brute_force(spark, crowd):
    r = np.random.default_rng(8)
    passages = ["".join(r.choice(list("abcd "), 90)) for _ in range(4)]
    rows = []
    for i in range(30):
        parts = ["".join(r.choice(list("abcd "), int(r.integers(0, 60)))) for _ in range(3)]
        rows.append((i, parts[0] + passages[i % 4][int(r.integers(0, 40)) :] + parts[1] + passages[(i * 3) % 4] + parts[2]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("home", F.xxhash64("text"))
    marks = {m.doc_id: m.marks for m in suffix_dedup.find_repeats(df, 64, 32, crowd).collect()}
    for i, n, gone, spans, _ in removed(rows, 64):
        cuts = suffix_dedup.merged([m.asDict(True) for m in marks.get(i, [])], n, 64)
        assert (sum(b - a for a, b in cuts), len(cuts)) == (gone, spans)


def test_column_wise_construction():
    r = np.random.default_rng(3)
    bodies = [bytes(r.choice(list(b"ab"), 20).tolist()) for _ in range(60)]
    groups = np.sort(r.integers(0, 4, 60))
    flags = suffix_dedup.repeated_starts(groups, np.full(60, 8), bodies, 12, 4)
    for i in range(60):
        for c in range(9):
            assert flags[i, c] == any(j != i and groups[j] == groups[i] and bodies[j][c : c + 12] == bodies[i][c : c + 12] for j in range(60))


def test_leaks(spark, docs, clashing, empty):
    item = " ".join(words(9, 40))
    edited = item[:30] + "Q" + item[31:80] + item[82:]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, " ".join(words(10, 30)))], "item_id long, text string")
    some = spark.createDataFrame([(1, "before " + item.upper() + " after"), (2, "x" * 50 + edited), (3, item[: len(item) // 2]), (4, None), (5, ""), (1, "before " + item.upper() + " after")], "doc_id long, text string")
    found = got(decontaminate.leaks(some, bench), "doc_id", "item_id", "start", "end", "edits")
    assert found == [(1, 1, 7, 7 + len(item), 0)] * 2 + [(2, 1, 50, 50 + len(edited), 3)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(some, bench).collect()) == [3, 4, 5]
    assert decontaminate.leaks(docs, bench).count() == 0 and decontaminate.without_leaks(clashing, bench).count() == clashing.count()
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert len(list(decontaminate.blocks(bench, limit=100))) > 1


def test_short_items_are_found(spark):
    """Exact copies of items of fewer than Q characters, anywhere in a text; blank items are none."""
    bench = spark.createDataFrame([(1, "Zq 7é"), (2, "zq 7É"), (3, "zz"), (4, " "), (5, ""), (6, "long enough to have grams")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a ZQ 7É b zq 7é"), (2, "zzz"), (3, "zq 8é and more text"), (4, None), (5, "so LONG enough to have grams")], "doc_id long, text string")
    found = got(decontaminate.leaks(some, bench), "doc_id", "item_id", "start", "end", "edits")
    assert found == [(1, 1, 2, 7, 0), (1, 2, 2, 7, 0), (2, 3, 0, 2, 0), (5, 6, 3, 28, 0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(some, bench).collect()) == [3, 4]


@given(st.text("abc", min_size=30, max_size=60), st.data())
@settings(max_examples=40, deadline=None)
def test_edits_within_budget_are_found(item, data):
    """Any item with no more edits than its budget is found wherever it lies."""
    own = list(item)
    for _ in range(decontaminate.budget(len(item))):
        k = data.draw(st.integers(0, len(own) - 1))
        own[k : k + data.draw(st.integers(0, 1))] = data.draw(st.text("abcz", max_size=1))
    index = decontaminate.build([(1, item)])
    found = list(decontaminate.search(index, ["zz" * data.draw(st.integers(0, 9)) + "".join(own) + "zzz"]))
    assert found and found[0][4] <= decontaminate.budget(len(item))


def test_query_returns_token_ids(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op4_sentencepiece(docs.sparkSession, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(len(r.tokens) == r.n_tokens for r in rows)
    assert all(hashlib.sha256(np.array(r.tokens, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in rows)


def test_urls(spark):
    rows = [(1, "http://A.example.ORG/es/1?x"), (2, "https://example.org/en/12"), (3, "https://example.org/en/2"), (4, "x://b.com/fr/"), (5, "no scheme"), (6, None), (7, ""), (8, "http://notorg/"), (9, "http://x.com#f"), (10, "http://x.com/de/a/b/c/d/e/f"), (6, None)]
    rows += [(100 + i, f"http://h{i % 3}.net/de/{i}") for i in range(30)] + [(200 + i, f"http://h.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("x"), "template": F.lit("y")})
    found = {r.page_id: r for r in url_templates.judge(pages).collect()}
    assert len(found) == len(rows) - 1 and url_templates.judge(pages).count() == len(rows)
    assert (found[1].host, found[1].path, found[1].rule, found[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (found[2].rule, found[3].rule, found[4].rule) == ("example.org/en/1", "org/", "com/fr/")
    assert all((found[i].host, found[i].path, found[i].rule) == ("", "", None) for i in (5, 6, 7))
    assert found[8].rule is None and (found[9].host, found[9].path, found[9].rule) == ("x.com", "", None) and found[10].verdict == "block"
    assert all(found[100 + i].verdict == "block" for i in range(30))  # like com/de/
    assert url_templates.judge(pages.where("false")).count() == 0


def test_language(spark, docs, clashing, empty):
    rows = [("the cat and the dog of this house with that", "en"), ("der hund und die katze ist nicht das haus", "de"), ("собака и кошка в доме это не то", "ru")] * 4
    model = language.fit(rows)
    texts = ["the dog and the house", "das ist nicht der hund", "кошка и собака", "123 ½ --", "", None, "語", "the dog and the house with that cat кошка и собака в доме"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(df, model, spans=True).collect()}
    assert [found[i].lang_pred for i in range(6)] == ["en", "de", "ru", "und", "und", "und"] and found[6].lang_pred in model.languages
    assert [(s.lang, texts[7][s.start : s.end]) for s in found[7].spans] == [("en", "the dog and the house with that cat"), ("ru", "кошка и собака в доме")]
    assert language.identify(docs, model).count() == docs.count() and language.identify(empty, model).count() == 0
    assert language.keep_identified(clashing, model).columns == clashing.columns
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=7))
@settings(max_examples=40, deadline=None)
def test_viterbi(scores):
    from itertools import product

    x = np.array(scores, np.float32)
    value = lambda p: sum(x[t, k] for t, k in enumerate(p)) - 3 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    path = language.viterbi(x, np.array([0, len(x)]), 3.0).tolist()
    assert value(path) == max(value(p) for p in product(range(3), repeat=len(x)))


@pytest.fixture(scope="module")
def vocab():
    pieces = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), "▁", "a", "b", "ab", "▁a", "ba", "▁ab", "▁▁", "é", "bab"]
    scores = [0.0] * 257 + [-2.0, -3.0, -3.1, -4.0, -3.5, -4.2, -5.5, -2.5, -4.0, -7.0]
    return unigram.vocabulary(pieces, scores, ["other", *["byte"] * 256, *["normal"] * 10])


@given(text=st.text("ab é☃▁\n", max_size=9))
@settings(max_examples=60, deadline=None)
def test_segmentation_is_best(vocab, text):
    tokenizer = unigram.Tokenizer(vocab)
    ids = tokenizer.encode(text)
    assert tokenizer.decode(ids) == text
    surface = {s: i for i, s in enumerate(vocab.surface) if i > 256}

    def best(raw):
        top = {0: 0.0}
        for i in range(len(raw)):
            if i not in top:
                continue
            for s, p in surface.items():
                if raw[i : i + len(s.decode())] == s.decode():
                    top[i + len(s.decode())] = max(top.get(i + len(s.decode()), -1e9), top[i] + vocab.score[p])
            if raw[i].encode() not in surface:
                n = 1 if raw[i] == "▁" else len(raw[i].encode())
                top[i + 1] = max(top.get(i + 1, -1e9), top[i] + n * vocab.fallback)
        return top[len(raw)]

    value = sum(vocab.score[i] for i in ids if i > 256) + vocab.fallback * (sum(i <= 256 for i in ids) - 2 * text.count("▁"))
    assert not text or abs(value - best(" " + text)) < 1e-6


def test_sentencepiece_documents(docs, clashing, empty, vocab):
    found = unigram.encode_documents(clashing, vocab)
    rows = found.collect()
    assert len(rows) == docs.count() and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[4] == 0
    texts = {r.doc_id: r.text for r in unigram.decode_documents(found, vocab).collect()}
    assert texts[15] == odd_rows()[14][1] and texts[5] == ""
    assert unigram.encode_documents(empty, vocab).count() == 0


def test_shards(docs, clashing, empty):
    rows = sharding.shard(clashing, 4).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    texts = {i: t or "" for i, t, *_ in odd_rows()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows if r.doc_id)
    assert len({r.shard for r in rows if r.doc_id in (1, 3)}) == 1
    assert sharding.shard(empty, 4).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_minimax_is_least(spark, seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 60, 40).tolist()
    keys = sorted(hashlib.md5(str((seed, i)).encode()).hexdigest() for i in range(40))
    groups = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key string, bytes long")
    capacity, cuts = sharding.minimax_cuts(groups, 5, digits=1, step=1)

    def runs(c):
        n, now = 1, 0
        for s in sizes:
            if now + s > c:
                n, now = n + 1, 0
            now += s
        return n if c >= max(sizes) else 99

    assert capacity == min(c for c in range(1, sum(sizes) + 1) if runs(c) <= 5)
    shards = [sum(c <= k for c in cuts) for k in keys]
    assert max(sum(s for s, x in zip(sizes, shards, strict=True) if x == j) for j in range(5)) == capacity


def test_media_of_texts(docs, empty):
    rows = media.text_media(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = ({i: t for i, t, *_ in odd_rows()}[r.doc_id] or "").encode() if r.doc_id else None
        if raw is not None:
            full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert media.text_media(empty).count() == 0


def test_decoders():
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n0 1 0").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P4\n9 1\n\xff\x80").tolist() == [[1] * 9]
    assert media.decode(b"P2\n2 1\n300\n1 299\n").tolist() == [[1, 299]]
    assert media.decode(b"P5\n2 1\n65535\n\x01\x00\x00\x02").tolist() == [[256, 2]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    head = lambda bits, w, h, size: b"BM" + size.to_bytes(4, "little") + b"\0" * 4 + (54 + (1 << bits) * 4 * (bits <= 8)).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + b"\1\0" + bits.to_bytes(2, "little") + b"\0" * 24
    assert media.decode(head(24, 1, 2, 0) + b"\1\2\3\0" + b"\4\5\6\0").tolist() == [[[6, 5, 4]], [[3, 2, 1]]]
    assert media.decode(head(1, 2, -1, 0) + b"\0\0\0\0\xff\xff\xff\0" + b"\x40\0\0\0").tolist() == [[[0, 0, 0], [255, 255, 255]]]
    for bad in (b"", b"P9", b"P5\n2 2\n255\n\0", b"BM", b"P5\nx"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 5), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_area_resize(rows, columns, height, width):
    x = np.random.default_rng(rows * 10 + columns).integers(0, 256, (rows, columns))
    fine = np.kron(x, np.ones((height, width)))
    want = fine.reshape(height, rows, width, columns).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x, height, width), want)


def test_media_tiles(spark):
    df = spark.createDataFrame([(1, b"P5\n2 2\n255\n\0\1\2\3"), (2, None), (3, b"junk"), (4, b"P5\n0 0\n255\n")], "id long, media binary").withColumn("tile", F.lit("x"))
    rows = {r.id: r for r in media.media_tiles(df, "media", 2, 2).collect()}
    assert np.load(__import__("io").BytesIO(bytes(rows[1].tile))).tolist() == [[0, 1], [2, 3]] and len(rows[1].dhash) == 16
    assert all(rows[i].tile is None and rows[i].media_error for i in (2, 3, 4))


def labelled_docs(spark, bad):
    r = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(400):
        y, own = int(r.random() < 0.3), words(1000 + i, 40)
        rows.append((i, " ".join(bad(own, i) if y else own), "en", "s", 0))
        labels.append((i, y))
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, y int"), dict(labels)


@pytest.mark.parametrize(("operator", "column", "fold", "bad"), [(toxicity, "toxic", (5, 0), lambda w, i: [*w[:9], f"nastyword{i % 7}", *w[9:]]), (quality, "quality", (3, 1), lambda w, i: ["!!".join(w[:9])] * 5)])
def test_classifiers(spark, docs, clashing, empty, operator, column, fold, bad):
    train, labels, y = labelled_docs(spark, bad)
    labels = labels.withColumnRenamed("y", column)
    model = operator.fit(train, labels)
    rows = operator.score(train, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)
    assert np.mean([r.predicted == y[r.doc_id] for r in rows if r.held_out]) > 0.9
    assert operator.score(clashing, model).count() == docs.count() and operator.score(empty, model).count() == 0
    plain = operator.fit(empty, labels.where("false"))
    assert {r.score for r in operator.score(docs, plain).collect()} == {0.5}


def test_forest_walk_equals_recursion():
    r = np.random.default_rng(1)
    x = r.random((300, 4))
    f = quality.boost(x, (x[:, 0] + x[:, 1] > 1).astype(int), trees=5)

    def walk(node, row):
        while f.left[node] != node:
            node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
        return f.value[node]

    assert np.allclose(f.raw(x[:20]), [f.base + sum(walk(t, row) for t in f.roots) for row in x[:20]])
