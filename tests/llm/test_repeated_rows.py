"""Rows that share an id, or have none."""

import random

import corpus_pipeline
from assetloom.llm import chunk_dedup, jaccard_join


def phrases(seed, n, size):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(size)) for _ in range(n)]


def test_spans_of_repeated_rows(spark):
    passage, *u = phrases(8, 1, 60) + phrases(9, 6, 80)
    put = lambda t: t[:100] + " " + passage + " " + t[100:]
    single = [(1, put(u[0])), (2, put(u[1])), (3, u[2])]
    # A repeated row, and two texts under one id with the passage at different places.
    rows = [*single, single[1], single[1], (4, put(u[3])), (4, u[4] + " " + u[5][:200] + " " + passage), (4, u[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda df: sorted((r.doc_id, r.start, r.n_bytes, r.n_words, r.keeper) for r in chunk_dedup.repeated_spans(df).collect())
    alone = of(spark.createDataFrame(single, "doc_id long, text string"))
    assert {r[0] for r in alone} == {1, 2} and [r for r in of(docs) if r[0] in (1, 2)] == alone
    assert len([r for r in of(docs) if r[0] == 4]) == 2 and all(r[3] >= 24 for r in of(docs))
    out = [(r.doc_id, r.text) for r in chunk_dedup.drop_spans(docs, chunk_dedup.repeated_spans(docs)).collect()]
    assert len(out) == len(rows) and len({t for i, t in out if i == 2}) == 1
    cut = [t for i, t in out if i in (2, 4) and t != u[5]]
    assert all(passage[130:290] not in t for t in cut) and (4, u[5]) in out
    # Outside the passage little goes: the rest of a chunk at each end.
    assert all(len(t) >= min(len(x) for i, x in rows if i in (2, 4) and x[:60] == t[:60]) - len(passage) - 256 for t in cut)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each_group_stays(spark):
    a, b, c, d = phrases(4, 4, 60)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (1, a), (1, a), (2, near), (None, a), (None, near), (None, b), (None, b), (3, c), (3, d), (3, c + " more"), (4, d), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = jaccard_join.drop_near_duplicates(docs, shingle=5, percent=80)
    assert got.columns == docs.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    assert len(out) == 5 and {(1, a), (None, b), (3, d), (None, None)} <= set(out) and len({(3, c), (3, c + " more")} & set(out)) == 1


def test_pipeline_stages_on_repeated_rows(spark):
    a, b, c = ("\n".join(phrases(k, 8, 12)) for k in (1, 2, 3))
    rows = [(1, a), (1, a), (1, a), (1, a), (None, b), (None, b), (None, b), (2, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], SCHEMA)
    out = corpus_pipeline.lines(spark, docs, "")
    assert not [r for r in out.where("doc_id is null").collect() if r.text == c] and out.where("doc_id = 2").first().text == c
    out = corpus_pipeline.near_duplicates(spark, out, "")
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", a), ("None", b), ("2", c)])
    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert len(mixed) == len({(r.doc_id, r.text) for r in mixed}) and all(1 <= r.copies <= 2 and r.taken == r.copies * r.size for r in mixed)


def test_columns_without_an_order(spark):
    """Maps beside a repeated id and text: one row stays, the same at every run."""
    a, b = phrases(5, 2, 40)
    docs = spark.createDataFrame([(1, a, {"k": 2}), (1, a, {"k": 1}), (2, b, None), (2, b, {}), (3, a, {"k": 3})], "doc_id long, text string, notes map<string,int>")
    docs = docs.selectExpr("*", "'en' AS lang", "'web' AS source", "1L AS n_chars", "parse_json('{}') AS v")
    out = jaccard_join.drop_near_duplicates(docs, shingle=5, percent=80)
    assert out.columns == docs.columns and {r.doc_id: r.notes for r in out.select("doc_id", "notes").collect()}[1] == {"k": 1} and out.count() == 2
    assert {r.doc_id for r in corpus_pipeline.mix(spark, docs, "").select("doc_id").collect()} <= {1, 2, 3}


def test_text_ids_in_the_line_stage(spark):
    line = " ".join(phrases(6, 1, 9))
    docs = spark.createDataFrame([("b", f"{line}\nfirst own line", "en", "web", 1), ("a", f"{line}\nanother of its own", "en", "web", 1), (None, line + "\nneither of them", "en", "web", 1)], SCHEMA.replace("doc_id long", "doc_id string"))
    assert {(r.doc_id, r.text) for r in corpus_pipeline.lines(spark, docs, "").collect()} == {("a", f"{line}\nanother of its own"), ("b", "first own line"), (None, "neither of them")}
