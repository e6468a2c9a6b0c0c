"""The pipeline's stages, each held to a plain restatement on its own input, and run() to their chain."""

import brute as B
import duckdb
import pytest

import corpus_pipeline
from assetloom.common import load, materialize
from assetloom.llm.queries import OP5_SQL


@pytest.fixture(scope="module")
def chain(spark, sf_dir):
    """Input and output of every stage."""
    docs, out = load(spark, sf_dir, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, sf_dir), "test-stage")
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(chain, sf_dir):
    for before, after in chain[:-1]:
        assert after.columns == before.columns
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    kept = {r[0] for r in db.execute(f"SELECT doc_id FROM ({OP5_SQL}) WHERE kept").fetchall()}
    before, after = chain[0]
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in kept) and len(kept) < before.count()

    before, after = chain[1]
    own = rows(before)
    assert sorted(rows(after)) == sorted(r for r in B.drop_lines(own, B.line_dedup(own)) if B.words(r[1]))
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = chain[2]
    comp = B.components({i: B.shingles(t, corpus_pipeline.SHINGLE) for i, t in rows(before)}, corpus_pipeline.PERCENT)
    assert sorted(rows(after)) == sorted(r for r in rows(before) if comp[r[0]] == r[0])

    before, after = chain[3]
    items = [r.text for r in load(before.sparkSession, sf_dir, "benchmark").collect()]
    assert sorted(rows(after)) == sorted(r for r in rows(before) if not any(B.holds(r[1], b) for b in items))

    before, after = chain[4]
    sizes: dict = {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(B.words(r.text))
    want, taken = B.mix_targets(sizes), {}
    known = dict(rows(before))
    for r in after.collect():
        assert known[r.doc_id] == r.text and 1 <= r.copies <= 2 and r.taken == r.copies * r.size and r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken.get(s, 0) - want[s]) <= max(len(B.words(t)) for t in known.values()) for s in sizes)


def test_run(spark, chain, sf_dir):
    key = lambda r: (r.doc_id, r.text, r.copies, r.taken)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, chain[-1][1].collect()))


def test_runs_side_by_side(spark, chain, sf_dir):
    """Results of stages that are read late, and runs in between, lose nothing."""
    docs = load(spark, sf_dir, "documents")
    quality, lines = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]
    first, second = quality(spark, docs, sf_dir), quality(spark, docs, sf_dir)
    other = corpus_pipeline.run(spark, sf_dir)
    kept = materialize(first, "test-first")
    shorter = lines(spark, kept, sf_dir)
    assert sorted(rows(second)) == sorted(rows(kept)) == sorted(rows(chain[0][1]))
    assert sorted(rows(shorter)) == sorted(rows(chain[1][1])) and other.count() == chain[-1][1].count()
