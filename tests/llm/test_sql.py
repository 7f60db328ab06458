"""The operators against their SQL, and the pipeline against plain versions of its stages, on whole tables."""

import os
import re

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from mapql.llm import neardup, queries, toxicity
from mapql.llm.decontaminate import OP1_SQL
from mapql.llm.mixing import OP9_SQL

SMALL = "/root/testdata/sf0.001"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_FOLD))


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.fixture
def con():
    out = duckdb.connect()
    for f in os.listdir(SMALL):
        out.sql(f"create view {f[:-8]} as select * from read_parquet('{SMALL}/{f}')")
    return out


def in_order(names, columns, rows):
    at = [columns.index(c) for c in names]
    return sorted(([float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_matches_sql(spark, con, name):
    rows, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    assert sorted(rows.columns) == sorted(want.columns)
    assert in_order(want.columns, rows.columns, rows.collect()) == in_order(want.columns, want.columns, want.fetchall())


def without_lines(docs):
    """Later lines that match an earlier one go, and documents that lose all they had."""
    seen, out = {}, []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        kept, had, lost = [], 0, 0
        for line in (r["text"] or "").split("\n"):
            s = frozenset(words(line))
            goes = bool(s) and (s in seen or any(5 * len(o) >= 4 * len(s) and 4 * len(o) <= 5 * len(s) and similar(s, o) for o in seen))
            had, lost = had + bool(s), lost + goes
            if s:
                seen[s] = True
            if not goes:
                kept.append(line)
        if lost < had or not had:
            out.append(r | ({"text": "\n".join(kept), "n_chars": len("\n".join(kept))} if lost else {}))
    return out


def without_copies(docs):
    docs = sorted(docs, key=lambda r: r["doc_id"])
    w = [words(r["text"]) for r in docs]
    sets = [{tuple(x[i : i + neardup.SHINGLE]) for i in range(max(len(x) - neardup.SHINGLE, 0) + 1)} if x else set() for x in w]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [r for i, r in enumerate(docs) if root[i] == i]


def test_pipeline(spark, con, monkeypatch):
    """Each stage on what the one before kept; of the first, whose model has no plain version, the threshold."""
    kept = []

    def noted(stage):
        def run(spark, docs, sf_dir):
            kept.append([r.asDict() for r in docs.collect()])
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, noted(stage)) for name, stage in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    by_id = lambda rows: sorted(rows, key=lambda r: r["doc_id"])
    want = [by_id(r.asDict() for r in docs.collect())]
    want.append([r for r in want[0] if scores[r["doc_id"]] < toxicity.THRESHOLD])
    want.append(without_lines(want[1]))
    want.append(without_copies(want[2]))
    tables = lambda rows: con.register("documents_", pa.Table.from_pylist(rows)).sql("create or replace view documents as select * from documents_")
    tables(want[3])
    hit = {r[0] for r in con.sql(f"select doc_id from ({OP1_SQL}) where contaminated").fetchall()}
    want.append([r for r in want[3] if r["doc_id"] not in hit])
    for a, b in zip(kept, want, strict=True):
        assert by_id(a) == b
    tables(want[4])
    mixed = con.sql(OP9_SQL)
    names = sorted(mixed.columns)
    assert in_order(names, mixed.columns, mixed.fetchall()) == in_order(names, last.columns, last.collect())
