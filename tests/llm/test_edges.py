"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from triskele.llm import op1_html, op2_exact_dedup, op3_mix, op4_shard, op5_tokens, op6_langid, op7_warc, op8_decontaminate, op9_toxicity, op10_simhash
from triskele.llm.common import shared_root, split_by, written
from triskele.llm.registry import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, lang_pred string, toxicity int, shard string, mix_id int, h string, fp string, n int"
LONG = "lorem ipsum dolor " * 20000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 5, "x", "y", 1, "z", 1, "h", "f", 1),
    (2, None, None, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None, None, None, None, None, None, None),
    (4, "The quick brown fox jumps over the lazy dog", "en", None, 5, None, None, None, None, None, None, None, None),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b", 5, None, None, None, None, None, None, None, None),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b", 5, None, None, None, None, None, None, None, None),
    (None, "no id here at all", "en", "b", 5, None, None, None, None, None, None, None, None),
    (7, LONG, "la", "c", 5, None, None, None, None, None, None, None, None),
    (8, "123 !!! 456", None, "c", 5, None, None, None, None, None, None, None, None),
]
BENCH = [(1, "the quick brown fox jumps"), (2, None), (None, ""), (3, "ipsum " * 20), (1, "the quick brown fox jumps")]


@pytest.fixture(scope="module")
def docs(spark):
    shared_root(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id bigint, text string")


def test_exact_dedup(docs, empty):
    got = op2_exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    fox = by[hashlib.sha256(ROWS[0][1].encode()).hexdigest()]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in fox} == {(1, 4, 2, False), (4, 4, 2, True)}
    none = by[hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.kept) for r in none} == {(2, False), (3, True)}
    assert all(sum(r.kept for r in rows) == 1 for rows in by.values())
    assert op2_exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_repeated_rows(spark, monkeypatch):
    shared_root(spark)
    monkeypatch.setattr(op2_exact_dedup, "CHUNK", 3)
    rows = [(7, "same")] * 10 + [(3, "same")] * 2 + [(None, "none")] * 4 + [(1, "one")]
    got = op2_exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got) == sorted(
        map(repr, [(7, 7, 12, True)] + [(7, 7, 12, False)] * 9 + [(3, 7, 12, False)] * 2 + [(None, None, 4, True)] + [(None, None, 4, False)] * 3 + [(1, 1, 1, True)])
    )


def test_grace_spills_and_agrees(tmp_path):
    rows = [(op2_exact_dedup.xxhash.xxh64_intdigest(b"%d" % (i % 700)), b"%d" % (i % 700) * 40, i, 1, 1) for i in range(5000)]
    plain = {c: tuple(e) for c, *e in op2_exact_dedup.grace(iter(rows), 1 << 30, str(tmp_path))}
    small = {c: tuple(e) for c, *e in op2_exact_dedup.grace(iter(rows), 5000, str(tmp_path))}
    assert plain == small and len(plain) == 700
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_equal_hashes_are_told_apart(tmp_path):
    t = op2_exact_dedup.ContentTable()
    for content in (b"a", b"b", b"a"):
        t.add(42, content, 1, 1, 1)
    assert sorted(zip(t.contents, t.counts)) == [(b"a", 2), (b"b", 1)]


def test_mix(docs, empty):
    p = op3_mix.plan(docs)
    got = p.collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 3 * r.size for r in got)
    sums = p.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 0.5 for r in sums)
    assert sum(r.t for r in sums) == pytest.approx(sum(r.size for r in got), abs=len(sums))
    m = op3_mix.mixture(docs)
    assert m.columns == docs.columns
    assert op3_mix.plan(empty).count() == 0 and op3_mix.mixture(empty).count() == 0


def test_mixture_is_the_whole_documents_before_the_target(spark):
    """Against a plain running sum over each source, with rows alike at the cut, null ids and a source of one repeated row."""
    shared_root(spark)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)), rng.choice("abc")) for i in range(300)] + [(None, f"null {i}", "a") for i in range(40)] + [(7, "same words here", "d")] * 500
    rows += [(9, "again and again", "c")] * 700
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    t = {r.src: r for r in op3_mix.targets(op3_mix.sized(docs)).collect()}
    want = {}
    for src in "abcd":
        own = sorted((hashlib.md5(f"{'' if d is None else d}:{hashlib.md5(x.encode()).hexdigest()}".encode()).hexdigest(), d, x) for d, x, s in rows if s == src)
        for e in range(3):
            at = e * sum(len(x.split()) for _, _, x in own)
            for _, d, x in own:
                n = len(x.split())
                if (at + n / 2 <= t["=" + src].target) if n else e == 0:
                    want[d, x, src] = want.get((d, x, src), 0) + 1
                at += n
    got = {}
    for r in op3_mix.mixture(docs).collect():
        got[r.doc_id, r.text, r.source] = got.get((r.doc_id, r.text, r.source), 0) + 1
    assert got == want


def test_plan_deals_large_sets_out_in_chunks(spark, monkeypatch):
    shared_root(spark)
    docs = spark.createDataFrame([(7, "same words here", "d")] * 500 + [(8, "other", "e")] * 3, "doc_id bigint, text string, source string")
    whole = sorted(map(repr, op3_mix.plan(docs).select("doc_id", "size", "taken").collect()))
    monkeypatch.setattr(op3_mix, "CHUNK", 7)
    assert sorted(map(repr, op3_mix.plan(docs).select("doc_id", "size", "taken").collect())) == whole and len(whole) == 503


def test_mix_positions_follow_the_schedule(spark):
    rows = spark.createDataFrame([(i, "w " * 10, "s") for i in range(400)], "doc_id bigint, text string, source string")
    # all weight in the second half of training
    late = spark.createDataFrame([("s", [(0.0, 0.0), (0.5, 0.0), (0.5000001, 2.0), (1.0, 2.0)])], "source string, knots array<struct<t:double,w:double>>")
    pos = [c.position for r in op3_mix.plan(rows, schedules=late).collect() for c in r.copies]
    assert min(pos) > 0.49 and max(pos) <= 1.0 and len(pos) == 400
    rising = spark.createDataFrame([("s", [(0.0, 0.0), (1.0, 2.0)])], "source string, knots array<struct<t:double,w:double>>")
    pos = sorted(c.position for r in op3_mix.plan(rows, schedules=rising).collect() for c in r.copies)
    assert pos[100] == pytest.approx(0.5, abs=0.01)  # a quarter of the demand lies before the middle


@pytest.mark.parametrize("limit", [40, 100, 1 << 30])
def test_shards(docs, empty, limit):
    out, names = op4_shard.sharded(docs, limit)
    got = out.collect()
    assert len(got) == len(ROWS)
    size = {}
    for r in got:
        size.setdefault(r[names["shard"]], []).append(len((r.text or "").encode()))
    assert all(sum(v) <= limit or len(v) == 1 for v in size.values())
    bits = [s.split("+")[0] for s in size]
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    assert op4_shard.sharded(empty, limit)[0].count() == 0


def test_shards_of_one_repeated_row(spark):
    shared_root(spark)
    rows = spark.createDataFrame([(1, "x" * 10)] * 50, "doc_id bigint, text string")
    out, names = op4_shard.sharded(rows, 100)
    got = {}
    for r in out.collect():
        got[r[names["shard"]]] = got.get(r[names["shard"]], 0) + 10
    assert sum(got.values()) == 500 and max(got.values()) <= 100


def test_shards_of_rows_that_do_not_divide_the_limit(spark, monkeypatch):
    """Rows of one doc_id, of none and of several sizes: every shard of several rows fits, and no row is lost."""
    shared_root(spark)
    monkeypatch.setattr(op4_shard, "CHUNK", 3)
    rows = [(1, "x" * 60, 4)] * 5 + [(None, "y" * n, n) for n in range(90)] + [(2, "z" * 130, 0)] * 3 + [(3, "", 0)] * 20
    out, names = op4_shard.sharded(spark.createDataFrame(rows, "doc_id bigint, text string, cell int"), 100)
    got, shards = out.collect(), {}
    assert sorted(map(repr, [(r.doc_id, r.text, r.cell) for r in got])) == sorted(map(repr, rows))
    for r in got:
        shards.setdefault(r[names["shard"]], []).append(r)
    for rows in shards.values():
        total = sum(len(r.text) for r in rows)
        assert (total <= 100 or len(rows) == 1) and {(r[names["shard_bytes"]], r[names["shard_docs"]]) for r in rows} == {(total, len(rows))}


def test_tokens(docs, empty):
    got = op5_tokens.token_output(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.n_tokens for r in got}[3] == 1
    ordered = sorted(got, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert op5_tokens.token_output(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_language(docs, empty):
    model = op6_langid.train(docs)
    out, pred, score = op6_langid.predict(docs, model)
    got = {r.doc_id: (r[pred], r[score]) for r in out.collect()}
    assert got[2] == got[3] == got[8] == ("und", 0.0)
    assert got[1][0] == "en" and got[5][0] == "de" and got[7][0] == "la"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert op6_langid.train(empty).langs == []
    out, pred, _ = op6_langid.predict(docs, op6_langid.train(empty))
    assert {r[pred] for r in out.collect()} == {"und"}
    assert op6_langid.keep_known(empty).count() == 0


def test_warc(spark):
    shared_root(spark)
    big = "<p>" + "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 50
    rows = [(1, "http://a/ü\n", big), (2, None, big), (None, "x", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (1, "http://again", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for block in (1 << 20, 512):
        got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in op7_warc.round_trip(pages, block).collect())
        n = len(big)
        assert got == sorted([(1, n, "response", None), (1, n, "response", None), (2, n, "revisit", 1), (-1, n, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None)])
    assert op7_warc.round_trip(pages.limit(0)).count() == 0


def test_warc_with_long_urls(spark):
    shared_root(spark)
    rows = [(i, "http://a/" + "ü€"[i % 2] * n, f"<p>page {i} WARC/1.1\r\n</p>") for i, n in enumerate([1, 12000, 2, 30000, 0, 3])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    for block in (1 << 24, 100000):
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in op7_warc.round_trip(pages, block).collect())
        assert got == [(i, len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows]


def test_headers_share_a_blank_line():
    data = b"WARC/1.1\r\n" * 3 + b"Content-Length: 7\r\nWARC/1.0\r\nX: y\r\n\r\n" + b"WARC/1.1\r\nContent-Length: 9\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n"
    starts = [m.start() for m in op7_warc.MAGIC.finditer(data)]
    assert list(op7_warc.parse_headers(data, starts)) == [(67, 7), (57, 7), (47, 7), None, (31, 9), None]


def test_broken_warc(spark, tmp_path):
    a = op7_warc.record(1, "u", b"one", "d", None, False)
    b = op7_warc.record(2, "u", b"two", "d", None, False)
    (tmp_path / "x.warc").write_bytes(a + b"junk" + b)
    (tmp_path / "y.warc").write_bytes(a + b[:-10])
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in ("x.warc", "y.warc")], "file string, size bigint")
    assert [r.page_id for r in op7_warc.read_warc(files).collect()] == [1, 1]


def test_decontamination(docs, empty, bench, spark):
    got = {r.doc_id: r for r in op8_decontaminate.report(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (9, 5, 1, True)
    assert got[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert (got[2].n_words, got[2].n_hit, got[2].contaminated) == (0, 0, False) and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[7].n_words == 60000 and got[7].n_hit == 0
    assert op8_decontaminate.report(empty, bench).count() == 0
    assert not any(r.contaminated for r in op8_decontaminate.report(docs, bench.limit(0)).collect())
    kept = op8_decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2


def test_decontamination_in_blocks_is_the_same(docs, bench, monkeypatch):
    want = sorted(map(repr, op8_decontaminate.report(docs, bench).collect()))
    for group in (0, 1 << 20):
        monkeypatch.setattr(op8_decontaminate, "GROUP_BYTES", group)
        assert sorted(map(repr, op8_decontaminate.report(docs, bench, block_bytes=1).collect())) == want


@pytest.mark.parametrize("n", [1, 2, 5, 13, 14])
def test_short_items(spark, n):
    words = [f"w{i}" for i in range(30)]
    m = op8_decontaminate.Matcher([("i", " ".join(words[4 : 4 + n]))])
    (count, spans, items), = m.scan(["X, " + "; ".join(words) + " w4"])
    want = set(range(5, 5 + n)) | ({31} if n == 1 else set())
    assert count == 32 and items == {"i"} and {k for a, b in spans for k in range(a, b)} == want


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = op9_toxicity.train(docs, op9_toxicity.learnable(labels))
    out, name = op9_toxicity.score(docs, model)
    assert {r[name] for r in out.collect()} == {0.0}
    rng = random.Random(4)  # texts of their own: near copies would be learned from once only
    rows = [(i, " ".join(f"word{rng.randrange(60)}" for _ in range(40)) + (" vilestword" if i % 4 == 0 else "")) for i in range(600)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    model = op9_toxicity.train(texts, op9_toxicity.learnable(labels))
    assert model.score("word1 word2 VILESTWORD word3") > 0.7 > 0.3 > model.score("word1 word2 word3")
    assert 0 <= model.score(None) < 0.5 and 0 <= model.score(LONG) <= 1
    assert op9_toxicity.score(empty, model)[0].count() == 0


def test_simhash(docs, empty):
    got = op10_simhash.simhash_components(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == 2
    assert by[4].component_id == 1 and by[5].component_id == 5
    assert op10_simhash.simhash_components(empty).count() == 0
    kept = op10_simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 7, 8]


def test_html(spark, empty):
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<nav><a href=#>a</a></nav><article><h1>Title of it</h1><p>Some words are here, and more of them follow &amp; end.</p><p>Another paragraph of the text, which is long enough.</p></article><footer>&copy; x", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out, name = op1_html.extracted(pages)
    got = {r.page_id: r[name] for r in out.collect()}
    assert name != "text" and got[1] == got[2] == ""
    assert "Some words are here, and more of them follow & end." in got[3] and "©" not in got[3]
    assert op1_html.extracted(pages.limit(0))[0].count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace as N

    context = N(getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_root(N(sparkContext=context, conf=N(get=lambda k, d: d)))


@pytest.mark.parametrize("words", [16, 1 << 20])
def test_split_by_loses_no_key(spark, words):
    shared_root(spark)
    keys = written(spark.range(0, 3000, 3).withColumnRenamed("id", "bitmap_word"), "keys")
    rows = spark.range(3000).selectExpr("id", "id % 7 as bitmap_bits").union(spark.sql("select cast(null as bigint), 1L"))
    no, other = split_by(rows, "id", keys, words)
    no, other = [r.id for r in no.collect()], {r.id for r in other.collect()}
    assert len(no) + len(other) == 3001 and other >= set(range(0, 3000, 3)) and not other & set(no)
    assert words == 16 or len(other) < 1300


def test_near_dedup_of_repeated_ids(spark):
    rows = [(1, "the quick brown fox jumps", "a"), (1, "the quick brown fox jumps", "b"), (2, "the quick brown fox jumps", "c"), (3, "zzz other", "d"), (3, "the quick brown fox jumps", "e"), (4, "an own text here", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r.doc_id, r.text) for r in op10_simhash.near_dedup(docs).collect())
    assert got == [(1, rows[0][1]), (3, rows[0][1]), (4, "an own text here")]


def test_near_dedup_of_rows_without_an_id(spark):
    one, two, three = ("the quick brown fox jumps over the lazy dog", "some other text of a few words", "a third text that has no id at all")
    rows = [(1, one, "a"), (None, one, "b"), (None, two, "c"), (None, two, "d"), (None, two, "e"), (None, three, "f"), (None, None, "g"), (None, "", "h"), (7, "an id and no copy of it here", "i")]
    for more in ([], [(3, two, "j")]):
        docs = spark.createDataFrame(rows + more, "doc_id bigint, text string, fp string")
        kept = op10_simhash.near_dedup(docs)
        got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
        assert kept.columns == docs.columns
        assert got == sorted([(1, one), (3, two) if more else (None, two), (None, three), (None, ""), (7, rows[-1][1])], key=repr)


ARTICLE = "<article><h1>Title of it</h1><p>Some words are here, and more of them follow &amp; end.</p>{}<p>Another paragraph of the text, which is long enough.</p></article>"


@pytest.mark.parametrize("tag", ['<img src="data:image/png;base64,{}">', "<p data-x='{}>'>One more paragraph of the text, with a long attribute.</p>", '<script data-x="{}">if (a) b("c");</script>'])
def test_html_attributes_of_any_length(tag):
    short, long = (op1_html.Page(ARTICLE.format(tag.format("iVBORw0K" * n))) for n in (1, 25000))
    assert short.text == long.text and short.parent == long.parent and short.kind == long.kind
    assert not any("iVBOR" in (t or "") or "if (a)" in (t or "") for t in long.text)
    a, b = op1_html.extract([ARTICLE.format(tag.format("iVBORw0K" * n)) for n in (1, 25000)], op1_html.model())
    assert a == b and "Another paragraph" in b


@pytest.mark.parametrize("n", [3, 600])
def test_html_deep_nesting(n):
    page = op1_html.Page("<article><section>" + "<div>" * n + "deep" + "</div>" * n + "<p>after</p></section>beside</article>end")
    at = {t: i for i, t in enumerate(page.text) if t}

    def above(i):
        out = []
        while (i := page.parent[i]) >= 0:
            out.append(op1_html.KINDS[page.kind[i]])
        return out

    assert above(at["deep"]) == ["div"] * n + ["section", "article", "page"]
    assert above(at["after"]) == ["p", "section", "article", "page"]
    assert above(at["beside"]) == ["article", "page"] and above(at["end"]) == ["page"]


@pytest.mark.parametrize("source, want", [
    ("<p title=it's>Hello</p><p>x</p>", ["Hello", "x"]),
    ("<html><head><title>T</title><meta x><p>Body text</p>", ["Body text"]),
    ("<head><title>T</title><script>a<b</script><body>Hi<p>there", ["Hi", "there"]),
    ("<p>a<svg><path d=1><p>b</p>", ["a", "b"]),
    ("<p>a<svg><text>x</text></svg>b", ["ab"]),
    ("<video src=x><p>kept</p>", ["kept"]),
    ("x < y and <b>z</b> <3", ["x < y and z <3"]),
    ("<p>text <a href=\"foo", ["text"]),
    ("<a href=\"x>text</a> more <b>z</b>", ["text more z"]),
    ("<select><option>a<option>b</select>c", ["c"]),
    ("<object><object>x</object>y</object>z", ["z"]),
    ("a<!-- <p>no</p> -->b<!-- open <p>no", ["ab"]),
    ("<script>'<p>no</p><svg>'</script><p>b<svg></svg>c", ["bc"]),
])
def test_html_broken_markup(source, want):
    assert [t for t in op1_html.Page(source).text if t] == want


@pytest.mark.parametrize("source", [
    "<a " * 350000, "<script " * 130000, "<script>" * 130000, '<a x=">"' * 130000, "<a x='" * 170000, '<p x="' + "z" * 1000000 + '">hi', "<" * 1000000,
    "<!--" * 250000, "<svg>" * 200000, "</p>" * 250000, "<a<" * 300000, "<div>" * 10000 + "t" + "</div>" * 10000,
])
def test_html_hostile_pages_take_linear_time(source):
    import time

    began = time.process_time()
    page = op1_html.Page(source)
    if len(page.kind) < 20000:
        op1_html.extract([source], op1_html.model())
    assert time.process_time() - began < 3


def test_html_decoding_is_consistent():
    parent = [-1, 0, 0, 1, 1, 2]
    keep = op1_html.decode(parent, op1_html.np.array([1.0, 0.5, -3.0, 2.0, -1.0, 1.0]))
    assert keep.tolist() == [True, True, False, True, False, False]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, empty, bench, tmp_path, name, stage):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, empty):
        out = stage(spark, table, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.count() <= 3 * len(ROWS)
    if name == "language_id":
        assert 1 in {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()}
