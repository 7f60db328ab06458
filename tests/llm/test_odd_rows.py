"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapql.llm import bloom, decontaminate, exact, html, lines, mixing, neardup, quality, tokens, toxicity, urls, warc
from mapql.runtime import new_shared_path

SCHEMA = "doc_id long, text string, source string, score double, _taken int, host string, n_hit long"
LONG = "word " * 30_000
ROWS = [(1, "a b c d e f", "x", 0.0, 1, "h", 2), (2, "a b c d e f", "x", 0.0, 1, "h", 2), (2, "a b c d e f", "x", 0.0, 1, "h", 2), (3, None, None, None, None, None, None), (4, "", "y", 0.0, 1, "h", 2), (None, "lost and found", "y", 0.0, 1, "h", 2), (5, LONG, "y", 0.0, 1, "h", 2), (6, "\n \n", None, 0.0, 1, "h", 2)]
BENCH = [(7, "c d e"), (8, None), (9, ""), (None, "found")]


@pytest.fixture(params=[True, False], ids=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param else [], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(docs):
    out = exact.exact_duplicates(docs).collect()
    assert len(out) == docs.count()
    if out:
        rows = {r["doc_id"]: r for r in out}
        assert (rows[2]["keep_id"], rows[2]["group_size"], rows[2]["kept"]) == (1, 3, False)
        assert (rows[4]["keep_id"], rows[4]["group_size"]) == (3, 2) and rows[None]["group_size"] == 1 and rows[None]["kept"]


def test_near(docs):
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    if out:
        rows = {r["doc_id"]: r for r in out}
        assert rows[2]["component_id"] == 1 and not rows[2]["kept"] and rows[3]["kept"] and rows[6]["n_shingles"] == 0


def test_lines(docs):
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_lines", "_removed"]
    rows = out.collect()
    assert len(rows) == docs.count()
    if rows:
        two = [r for r in rows if r["doc_id"] == 2]
        assert all(r["_removed"] == 1 and r["text"] == "" for r in two)
        assert by_id(out)[3]["text"] is None and by_id(out)[6]["text"] == "\n \n"


def test_contamination(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for block in (10, 1):
        out = decontaminate.contamination(docs, bench, width=3, block=block).collect()
        assert len(out) == docs.count()
        if out:
            rows = {r["doc_id"]: r for r in out}
            assert rows[1]["n_hit"] == 3 and rows[1]["items"] == ["7"] and rows[None]["items"] == [""] and rows[5]["n_words"] == 30_000


def test_mixing(docs):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in out)
    assert out == [] or sum(r["taken"] for r in out if r["source_size"] == 30_003) == pytest.approx(max(r["target"] for r in out if r["source_size"] == 30_003), abs=1)


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers(spark, docs, op):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (5, 1, 1), (None, 0, 0), (4, None, None)], "doc_id long, toxic int, quality int")
    out = op.score(docs, op.fit(docs, labels))
    assert out.columns.count("score") == 1
    assert len(out.collect()) == docs.count() and all(0 <= r["score"] <= 1 for r in out.collect())
    none = op.score(docs, op.fit(docs, labels.limit(0))).collect()
    assert all(r["score"] == 0.5 for r in none)


PAGES = [(1, "http://A.example.org/en/12?x", "<p>x</p>" * 30, "h"), (2, "http://A.example.org/en/12?x", "<p>x</p>" * 30, "h"), (2, "http://A.example.org/en/12?x", "<p>x</p>" * 30, "h"), (3, None, None, None), (4, "", "", "h"), (5, "no scheme", "<article>y" + " z" * 50_000, "h"), (None, "ftp://x.com/de/?", "<p>x</p>" * 30, "h")]


@pytest.mark.parametrize("rows", [PAGES, []])
def test_pages(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    judged = urls.judge(pages)
    joined = urls.judge(pages, trie_bytes=0)
    key = lambda df: sorted(map(repr, df.select("page_id", "url", "host", "path", "rule", "verdict").collect()))
    assert key(judged) == key(joined) and judged.count() == len(rows)
    assert html.extract(pages).count() == len(rows)
    folder = new_shared_path(spark, "warc")
    manifest = warc.deduplicate(spark, warc.write_archives(warc.captures(pages), folder), folder + "-2")
    planned = warc.resolve(warc.read_archives(spark, manifest)).collect()
    assert len(planned) == len(rows)
    if rows:
        found = {r["page_id"]: r for r in judged.collect()}
        assert (found[1]["rule"], found[1]["verdict"]) == ("example.org/en/1", "block") and found[3]["rule"] is None and found[None]["rule"] == "com/de/"
        kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in planned)
        assert kinds == sorted([("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", 1)])


def test_workers_give_memory_back():
    """Pages of freed arrays that stand between held ones go back to the system after each batch."""

    def rss():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    held, seen = [], []

    def run(batches):
        for _ in batches:
            arrays = [np.ones(4000) for _ in range(6000)]
            held.append(arrays[::100])
            del arrays
            seen.append(rss())
            yield held[-1]

    assert len(list(tokens.tidy(run)(iter(range(2))))) == 2
    assert rss() < seen[-1] - (100 << 20)


def test_filter_asked_outside_of_spark(spark):
    texts = [f"<urn:uuid:{i}>" for i in range(300)] + ["", "é" * 40, "x" * 200]
    words = bloom.build(spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("k")), "k")
    assert all(bloom.holds(words, t) for t in texts) and sum(bloom.holds(words, t + "?") for t in texts) < 3


def test_archives_are_read_in_part(spark):
    """Headers without payloads, and only the records that are asked for."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 300 if i % 2 else f"{i} " * 200) for i in range(40)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.captures(pages), new_shared_path(spark, "warc"))
    heads = warc.read_archives(spark, manifest, payloads=False)
    assert "payload" not in heads.columns and {r["payload_bytes"] for r in heads.collect()} == {300, 400, 600}
    digest = heads.where("page_id = 3").first()["payload_digest"]
    some = warc.read_archives(spark, manifest, lambda: lambda kind, own, d: kind == "response" and d == digest)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in some.collect()) == [(i, b"x" * 300) for i in range(1, 40, 2)]


@pytest.mark.parametrize("vocabulary", [50, 3000])
def test_many_sets_at_once(vocabulary):
    """Orders by rarity and comparisons of many pairs are those of one set after the other."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, vocabulary, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(words[rng.integers(0, vocabulary, rng.integers(0, 40))]) for _ in range(500)]
    values, at, counts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), rng.integers(0, 3, 1 << lines.BUCKET_BITS)
    often = counts[(values >> np.uint64(64 - lines.BUCKET_BITS)).astype(np.int64)]
    want = np.concatenate([values[a:b][np.lexsort((values[a:b], often[a:b]))] for a, b in zip(at, at[1:], strict=False)])
    assert (lines.in_rarity(values, at, counts) == want).all()
    some = [s for s in sets if len(s)]
    x, y = some[:200], [np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], b[:2]))) for a, b in zip(some[:200], some[200:], strict=False)]
    got = lines.reach(np.concatenate(x), np.array([len(s) for s in x]), np.concatenate(y), np.array([len(s) for s in y]), 80)
    assert got.tolist() == [100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for a, b in zip(x, y, strict=True)] and 0 < got.sum() < 200
