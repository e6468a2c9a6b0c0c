"""Each operator against a plain restatement, on documents with nulls, blanks, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute as B
from assetloom.common import load
from assetloom.llm import chunk_dedup, decontaminate, fixity, jaccard_join, langid, line_dedup, mixing, quality_rules, rule_ensemble, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Rows with every defined case."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(2, 7))) for _ in range(80)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = ["\n".join(line(rnd.randint(4, 14)) for _ in range(rnd.randint(1, 8))) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] += "x"
        texts += [" ".join(words), t, t[1:], t + "\n" + base[3]]
    texts += [None, "", " \n\t ", "x", "Ab ab AB", "!!! ... 123", line(4000), "z " * 300, "𝒳 日本語 テキスト " * 20]
    rows = [(k, t, ["en", "de", None][k % 3], ["s1", "s2", "ü", None][k % 4], None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[5], (None, base[1], "en", "s1", 3), (None, None, None, None, None), (7, "another text under a used id", "de", "s2", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns that clash with names used inside the operators.
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in ("id", "line", "key", "w", "t", "n", "label", "th", "size", "start", "copies", "h", "row", "gone", "__gone", "__id", "__th", "__key", "__may", "holes", "hits", "kept", "kept_0", "limit", "salt"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_line_dedup(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    hashes = {r.th: r.text for r in odd.select("text", F.xxhash64("text").alias("th")).collect()}
    order = {t: th for th, t in hashes.items()}
    want = B.line_dedup(rows, order)
    got = {(r.id, hashes[r.th], r.no): (r.keep_id, r.keep_no, r.distance) for r in line_dedup.repeated_lines(odd).collect()}
    assert got == want and any(v[2] for v in got.values())
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(B.drop_lines(rows, want), key=key)
    assert line_dedup.dedup_lines(none).count() == 0
    named = odd.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    assert {(int(r.id), r.no, int(r.keep_id)) for r in line_dedup.repeated_lines(named).collect()} == {(i, n, v[0]) for (i, _, n), v in want.items()}


def test_lines_of_any_length(spark):
    """Edits on lines of one character to tens of thousands, around every length at which the scales change."""
    rnd = random.Random(3)
    lines = []
    for n in [*range(1, 52), 63, 64, 65, 80, 512, 513, 527, 528, 529, 544, 545, 1024, 30_000]:
        x = "".join(rnd.choice("abcdefg ") for _ in range(n - 1)) + "z"
        k = rnd.randrange(n)
        lines += [x, x[:k] + "Z" + x[k + 1 :], x[:k] + "Y" + x[k:], x[:k] + "XX" + x[k + 1 :], x + x[-1]]
    rnd.shuffle(lines)
    rows = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(len(lines) // 3 + 1)]
    got = {(r.id, r.no): (r.keep_id, r.keep_no, r.distance) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, n): v for (i, _, n), v in B.line_dedup(rows).items()}


def test_decontamination(spark, odd, none):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([5, 9, 14, 30, 60])))) for k in range(20)] + [(90, None), (91, ""), (None, "a b c d e f g h i j k")]
    texts = []
    for _, t in items[:20]:
        own = t.split(" ")
        for share in (0.0, 0.1, 0.25, 0.5):
            texts.append(" ".join([rnd.choice(words), *[w if rnd.random() >= share else "zz" for w in own], rnd.choice(words)]))
        texts.append(", ".join(w.upper() for w in own[: len(own) // 2]) + ".")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i) for k, t in enumerate(texts) for i, b in items if i is not None and b and B.holds(t, b)}
    for block in (2_000_000, 60):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, bench, block_tokens=block).collect()}
        assert got == want
        kept = decontaminate.drop_contaminated(docs.withColumns({"hits": F.lit(1), "row": F.lit(2), "__hits": F.lit(3)}), bench, block_tokens=block)
        assert kept.columns == ["doc_id", "text", "hits", "row", "__hits"]
        assert {r.doc_id for r in kept.collect()} == {k for k in range(len(texts) + 2)} - {k for k, _ in want}
    assert decontaminate.drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.drop_contaminated(odd, bench.where("false")).columns == odd.columns
    assert decontaminate.contaminated_pairs(none, bench).count() == 0


def test_decontamination_of_unicode(spark):
    item = "die straße über den fluss führt उपलब्ध zu einem kleinen haus"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    w = item.split()
    texts = [" ".join(f"“{x}”" for x in w), "\u00a0".join(w).upper(), "—".join(w), " ".join(w[:4]), "a_" + "_".join(w), " ".join(reversed(w))]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == {"0", "1", "2", "4"} == {str(k) for k, t in enumerate(texts) if B.holds(t, item)}


def test_hot_template(spark):
    """Items that share their start, and a text that repeats it."""
    head = " ".join(f"t{k}" for k in range(12))
    items = [(k, head + " " + " ".join(f"x{k}y{j}" for j in range(20))) for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join([head] * 200)), (2, items[7][1]), (3, head + " " + head)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, 7)}


def test_chunks_survive_shifts():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)).encode()

    def cut(t):
        ends = chunk_dedup.boundaries(t, 12, 32, 128)
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    one, two = cut(text), cut(text[:700] + b"inserted" + text[700:])
    assert len(one - two) <= 4
    ends = chunk_dedup.boundaries(text, 12, 32, 128)
    assert ends[-1] == len(text) and all(b - a <= 128 for a, b in zip([0, *ends], ends)) and all(b - a >= 12 for a, b in zip([0, *ends], ends[:-1]))
    old, chunk_dedup.PIECE = chunk_dedup.PIECE, 1000
    try:
        assert chunk_dedup.boundaries(text, 12, 32, 128) == ends
    finally:
        chunk_dedup.PIECE = old
    assert chunk_dedup.boundaries(b"", 12, 32, 128) == [] and chunk_dedup.boundaries(b"a", 12, 32, 128) == [1]


def test_substring_dedup(spark, odd, none):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage, unique = " ".join(word() for _ in range(60)), [" ".join(word() for _ in range(80)) for _ in range(12)]
    rows = [(k, u if k % 2 else u[:100] + " " + passage + " " + u[100:]) for k, u in enumerate(unique)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = chunk_dedup.repeated_spans(docs)
    assert {r.doc_id for r in spans.collect()} == {0, 2, 4, 6, 8, 10} and {r.keeper for r in spans.collect()} == {0}
    left = {r.doc_id: r.text for r in chunk_dedup.drop_spans(docs, spans).collect()}
    assert left[0] == rows[0][1] and left[1] == rows[1][1]
    assert all(len(left[k]) < len(rows[k][1]) - 250 and left[k].startswith(unique[k][:90]) for k in (2, 4, 6))
    out = chunk_dedup.drop_spans(odd, chunk_dedup.repeated_spans(odd, min_words=3))
    assert out.columns == odd.columns and out.count() == odd.count()
    assert chunk_dedup.repeated_spans(none).count() == 0


def test_language_profiles(spark, odd, none, sf_dir):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    out = langid.identify_languages(odd).toPandas()
    assert len(out) == odd.count() and (out[out["doc_id"].isin([73, 74, 75, 78])]["lang_pred"] == "und").all()
    unlabelled = langid.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert (unlabelled["lang_pred"] == "und").all() and (unlabelled["score"] == 0).all()
    assert langid.identify_languages(none).count() == 0


def test_language_pieces():
    text = "Ein Text über vieles, 12 und mehr. " * 50
    whole = dict(zip(*map(list, langid.gram_counts(text))))
    old, langid.PIECE = langid.PIECE, 17
    try:
        assert dict(zip(*map(list, langid.gram_counts(text)))) == whole
    finally:
        langid.PIECE = old


def test_quality_rules(spark, odd, none, monkeypatch):
    plain = sorted(map(str, quality_rules.judge(odd, weight=4).collect()))
    got = quality_rules.judge(odd, weight=4).toPandas()
    want = [B.quality_base(r.text) for r in odd.collect()]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(want)
    assert not got[got["base_failed"]]["kept"].any()
    kept = quality_rules.filter_quality(odd, weight=4)
    assert kept.columns == odd.columns and kept.count() == got["kept"].sum()
    assert quality_rules.judge(none).count() == 0
    # The other ways of the joins and of the windows give the same.
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(quality_rules, "window_hash", lambda a, b, c: F.pmod(F.xxhash64(a, b, c), F.lit(5)))
    assert sorted(map(str, quality_rules.judge(odd, weight=4).collect())) == plain


def test_rows_of_one_text_have_their_own_verdict(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long + "!" * 40, "en", "loud"), (1, long + "!" * 40, "en", "calm"), *[(k, long + "!" * 40, "en", "loud") for k in range(2, 9)], *[(k, long + ".", "en", "calm") for k in range(10, 20)]]
    kept = quality_rules.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), weight=2, blank_weight=2)
    assert {(r.doc_id, r.source) for r in kept.collect() if r.doc_id == 1} == {(1, "loud")}


def plain_fences(rows, weight, blank_weight, reach=3.0, accuracy=0.01):
    """{(lang, source, measure): fence} from (lang, source, measure, share) rows, with the same whole numbers."""
    bins, width = quality_rules.BINS, math.log((1 + accuracy) / (1 - accuracy))

    def place(x):
        if x >= 1:
            return bins
        odds = x / (1 - x)
        return min(math.ceil(math.log(odds / quality_rules.TINY) / width), bins) if odds > quality_rules.TINY else 0

    def merged(own, parent, share):
        total, whole = sum(own.values()), sum(parent.values())
        assert sum(own.get(b, 0) * whole + share * w for b, w in parent.items()) == (total + share) * whole
        return {b: own.get(b, 0) * whole + share * w for b, w in parent.items()}

    out = {}
    for measure in {r[2] for r in rows}:
        counts = lambda keep: Counter(b for r in rows if r[2] == measure and keep(r) and (b := place(r[3])))
        whole = merged(counts(lambda r: True), dict.fromkeys(range(1, bins + 1), 1), blank_weight)
        for lang, source in {r[:2] for r in rows}:
            group = merged(counts(lambda r: r[:2] == (lang, source)), merged(counts(lambda r: r[0] == lang), whole, weight), weight)
            total, upto, b25, b75 = sum(group.values()), 0, None, None
            for b in sorted(group):
                upto += group[b]
                b25 = b if b25 is None and 4 * upto >= total else b25
                b75 = b if b75 is None and 4 * upto >= 3 * total else b75
            out[lang, source, measure] = quality_rules.TINY * math.exp(width * (b75 + reach * (b75 - b25)))
    return out


@pytest.mark.parametrize(("weight", "blank_weight"), [(200, 20), (1, 1), (5, 0)])
def test_quality_fences(spark, weight, blank_weight):
    """Merged whole-number sketches of groups of 1 to 400 rows, with zeros, ones and a measure that some groups don't show."""
    rnd = random.Random(3)
    rows = []
    for lang, source, n in [("en", "a", 400), ("en", "b", 7), ("de", "a", 60), ("de", "c", 1)]:
        rows += [(lang, source, "m", rnd.choice([0.0, 1.0, 1e-5, rnd.random() ** 3, rnd.random() / 50])) for _ in range(n)]
        rows += [(lang, source, "k", 0.0 if source == "c" else rnd.random() / 9) for _ in range(n)]
    table = spark.createDataFrame([(a, b, x if m == "m" else None, x if m == "k" else None) for a, b, m, x in rows], "lang string, source string, m double, k double")
    sketches = quality_rules.sketch(table.where("m is not null"), ["m"], 0.01).unionByName(quality_rules.sketch(table.where("k is not null"), ["k"], 0.01))
    got = {(r.lang, r.source, r.measure): r.fence for r in quality_rules.fences(sketches, 0.01, 3.0, weight, blank_weight).collect()}
    assert got == pytest.approx(plain_fences(rows, weight, blank_weight), rel=1e-9)


def test_every_measure_rejects_by_its_group(spark):
    """A value that is usual in one group and far out in another goes in the other only, for every measure."""
    words = [f"w{k}" for k in range(60)]
    base = " ".join(words)
    texts = {
        "mark_ratio": lambda k: base + ";" * k,
        "symbol_ratio": lambda k: base + " " + "#" * k,
        "dup_line_ratio": lambda k: base + "".join(f"\nq{j // 2}" for j in range(2 * k)) + "".join(f"\nz{j}" for j in range(60)),
        "repeat_ratio": lambda k: base + " w0 w1 w2" + "".join(f" w{j}" for j in range(3, 3 + k // 2)),
        "upper_ratio": lambda k: base + "Q" * k,
        "bang_ratio": lambda k: base + "!" * k,
    }
    for measure, text in texts.items():
        rows = [(j, text(2 + j % 2), "en", "calm") for j in range(60)] + [(100 + j, text(24 + j % 2), "en", "loud") for j in range(60)] + [(1000, text(25), "en", "calm")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        kept = {r.doc_id: r.kept for r in quality_rules.judge(df, measures=[measure], weight=2, blank_weight=1).collect()}
        assert not kept[1000] and sum(kept.values()) >= 118, measure


def test_fences_move_with_the_group(spark):
    """The same share of marks goes in a source that has few of them and stays in one that has many."""
    words = " ".join(f"w{k}" for k in range(120))
    text = lambda marks: words + " " + "." * marks
    rows = [(k, text(2 + k % 2), "en", "plain") for k in range(20)] + [(100 + k, text(30 + 10 * (k % 3)), "en", "dotted") for k in range(20)]
    rows += [(50, text(40), "en", "plain"), (51, text(40), "en", "dotted")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_group=10).collect()}
    assert [k for k, kept in got.items() if not kept] == [50]


def test_rule_ensemble(spark, odd, none):
    docs, labels = (load(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = rule_ensemble.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["quality"] == held["predicted"]).mean() > 0.95 and got["score"].between(0, 1).all()
    empty = labels.where("false")
    assert {r.score for r in rule_ensemble.score_quality(odd, empty).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in rule_ensemble.score_quality(odd, one).collect())
    assert rule_ensemble.score_quality(none, labels).count() == 0
    strange = spark.createDataFrame([(k, [0, 1, 2, -1, None][k % 5]) for k in range(60)], "doc_id long, quality int")
    assert rule_ensemble.score_quality(odd, strange).count() == odd.count()
    assert rule_ensemble.score_quality(odd, one).count() == odd.count()


def test_rules_of_a_tree():
    text = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 <= 3.0)\n      Predict: 0.0\n     Else (feature 0 > 3.0)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    a, b = (2, "<=", 0.5), (2, ">", 0.5)
    assert rule_ensemble.rules_of(text) == [(a,), tuple(sorted([a, (0, "<=", 3.0)])), tuple(sorted([a, (0, ">", 3.0)])), (b,)]


def test_fixity(spark, tmp_path):
    rows = [(k, f"http://h/{k}", "p" * (k % 37)) for k in range(0, 400, 2)] + [(None, "u", "x"), (500, None, None), (502, "d", "1"), (502, "d", "2")]
    one = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    assert fixity.audit(one, one, 64, 4).count() == 0
    change = {10: "altered", 11: "extra", 64: "missing", 398: "altered", 502: "altered"}
    two = [(i, u, "!" if change.get(i) == "altered" and h != "1" else h) for i, u, h in rows if change.get(i) != "missing"] + [(11, "u", "y")]
    got = fixity.audit(one, spark.createDataFrame(two, "page_id long, url string, html string"), 64, 4).collect()
    assert {r.page_id: r.status for r in got} == change
    length = lambda i, u, h: len(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(h or '')}\r\n\r\n{h or ''}\r\n\r\n")
    offset = {i: sum(length(*r) for r in rows if r[0] is not None and r[0] // 64 == i // 64 and r[0] < i) for i in (10, 64, 398)}
    assert {r.page_id: r.offset for r in got if r.page_id in offset} == offset
    assert fixity.audit(one, one.where("false"), 64, 4).where("status = 'missing'").count() == len(rows) - 1
    files = one.where("page_id < 20").orderBy("page_id").select(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()
    (tmp_path / "x.warc").write_bytes(b"".join(bytes(r.r) for r in files))
    back = fixity.read_warc(spark.read.format("binaryFile").load(f"file://{tmp_path}/x.warc")).orderBy("offset").collect()
    assert [(r.uri, bytes(r.payload).decode()) for r in back] == [(u, h) for i, u, h in rows if i is not None and i < 20]
    # Members of a gzip file; then records that end a file.
    import gzip

    zipped = [gzip.compress(bytes(r.r)) for r in files]
    (tmp_path / "y.warc.gz").write_bytes(b"".join(zipped) + zipped[0][:30])
    read = lambda name: fixity.read_warc(spark.read.format("binaryFile").load(f"file://{tmp_path}/{name}")).orderBy("offset").collect()
    assert [(r.uri, r.payload, r.length) for r in read("y.warc.gz")] == [(b.uri, b.payload, len(z)) for b, z in zip(back, zipped)]
    (tmp_path / "z.warc").write_bytes(b"WARC/1.0\r\ncontent-LENGTH:  2\r\nwarc-target-uri: u\r\n\r\nab\r\n\r\nWARC/1.0\r\nContent-Length: many\r\n\r\nab\r\n\r\n")
    assert [(r.uri, bytes(r.payload)) for r in read("z.warc")] == [("u", b"ab")]


def test_fixity_of_odd_ids(spark):
    big = (1 << 62) + 3
    rows = [(-5, "a\r\nWARC-Type: x", "p"), (-1, "b", "p"), (big, "c", "p"), (big + 1, "d", "p")]
    one = spark.createDataFrame(rows, "page_id long, url string, html string")
    two = one.withColumn("html", F.when(F.col("page_id").isin(-5, big + 1), "q").otherwise(F.col("html")))
    got = {r.page_id: (r.file, r.status) for r in fixity.audit(one, two, 64, 4).collect()}
    assert got == {-5: (-1, "altered"), big + 1: ((big + 1) // 64, "altered")}
    record = bytes(one.where("page_id = -5").select(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first().r)
    assert b"a%0D%0AWARC-Type" in record
    with pytest.raises(TypeError):
        fixity.audit(one.withColumn("page_id", F.lit("x")), two)


def test_url_filters(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "")]
    rows = [
        (1, "http://a.example.COM/en/71?x", "allow", "example.com/en/7"), (2, "https://example.com/en/8#y", "block", "com/en/"), (3, "http://xcom/en/8", "allow", None), (4, None, "allow", None), (5, "no scheme", "allow", None),
        (6, "http://www.list.org/p/", "block", None), (7, "http://list.org/p.html?q", "block", None), (8, "http://list.org/p2", "allow", None), (9, "x://net", "block", "net"), (9, "x://net", "block", "net"), (10, "http://É.org/", "allow", None),
    ]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumns({"host": F.lit("clash"), "key": F.lit("clash"), "word": F.lit("clash")})
    listed = spark.createDataFrame([("list.org/p",), ("list.org/p",), (None,)], "canonical_url string")
    for blocks in (1, None):
        got = urls.filter_urls(pages, rules, listed, blocks=blocks).collect()
        assert sorted((r.page_id, r.verdict, r.rule or "") for r in got) == sorted((r[0], r[2], r[3] or "") for r in rows)
    assert {r.verdict for r in urls.filter_urls(pages, [], listed.where("false")).collect()} == {"allow"}
    assert urls.filter_urls(pages.where("false"), rules, listed).count() == 0


@pytest.mark.parametrize("size, percent, block, screen", [(3, 90, 256, 4096), (3, 60, 2, 4096), (2, 50, 3, 2), (5, 80, 2, 1)])
def test_jaccard_join(spark, odd, none, size, percent, block, screen):
    got = jaccard_join.jaccard_join(odd, shingle=size, percent=percent, block_docs=block, screen_docs=screen).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = B.components_of_rows(rows, size, percent)
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted((i, len(B.shingles(t, size)), want[i]) for i, t in rows if i is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_of_one_id(spark):
    """An id with several texts is one document, also if it is the least of both classes or has an empty text."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (3, b), (7, a), (7, b), (2, c), (2, "one two"), (9, c), (8, "one two"), (10, None), (10, b), (None, a), ((1 << 60) + 1, a + " x")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (3, 1), (7, 1), (2, 2), (9, 2), (8, 2), (10, 1), (None, None), ((1 << 60) + 1, 1)}
    with pytest.raises(TypeError):
        jaccard_join.jaccard_join(spark.createDataFrame([("x", a)], "doc_id string, text string"))


def test_jaccard_of_large_groups(spark):
    """Groups beyond each block, of which most members match nothing in their own block."""
    shared = [f"s{k}" for k in range(40)]
    rows = [(k, " ".join([*shared, *[f"u{k // 2}v{j}" for j in range(60)], *([f"e{k}"] if k % 2 else [])])) for k in range(400)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), percent=60, block_docs=20, screen_docs=30, sample_docs=1).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k // 2 * 2) for k in range(400)}


def test_jaccard_of_nothing(none):
    assert jaccard_join.jaccard_join(none).count() == 0 and jaccard_join.drop_near_duplicates(none).count() == 0


def test_mixing(spark, odd, none):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    for df in (odd, docs):
        got = mixing.mix_sources(df).toPandas()
        sizes: dict = {}
        for r in df.collect():
            sizes[r.source] = sizes.get(r.source, 0) + len(B.words(r.text))
        want = B.mix_targets(sizes)
        assert len(got) == df.count() and (got["taken"] <= 2 * got["size"]).all()
        for source, own in got.groupby("source", dropna=False):
            source = source if isinstance(source, str) else None
            assert own["source_size"].iloc[0] == sizes[source] and own["target"].iloc[0] == pytest.approx(want[source])
            assert abs(own["taken"].sum() - want[source]) <= max(0.01 * want[source], own["size"].max())
        # Rates against a bisection; copies against the rounding from large to small, dealt over the documents of a size.
        rows = [(r.source, len(B.words(r.text))) for r in df.collect()]
        _, rates, copies = B.mix(rows)
        own = {}
        for source, size, rate, n in zip(got["source"].where(got["source"].notna(), None), got["size"], got["rate"], got["copies"]):
            assert rate == pytest.approx(rates[source, size], rel=1e-3, abs=1e-9)
            own.setdefault((source, size), []).append(n)
        assert all(max(x) - min(x) <= 1 for x in own.values())
        # The solver stops within a millionth of the target, which may move single copies between sizes.
        differ = [k for k in own if sum(own[k]) != copies[k]]
        assert len(differ) <= len(own) // 50 and all(abs(sum(own[k]) - copies[k]) <= 1 for k in differ)
    again = mixing.mix_sources(docs).toPandas()
    assert sorted(map(tuple, again[["doc_id", "taken"]].values)) == sorted(map(tuple, got[["doc_id", "taken"]].values))
    assert mixing.mix_sources(none).count() == 0
