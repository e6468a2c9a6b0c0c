"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from assetloom.common import load
from assetloom.llm import alignment, chunk_dedup, decontaminate, fixity, jaccard_join, langid, line_dedup, manifest, mixing, quality_rules, rule_ensemble, secret_scan, urls

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that goes, with the earlier line it goes for."""
    gone = line_dedup.repeated_lines(load(spark, sf_dir, "documents"))
    return gone.select(F.col("id").alias("doc_id"), F.col("no").alias("line_no"), F.col("keep_id").alias("keep_doc_id"), F.col("keep_no").alias("keep_line_no"), "distance")


OP1_SQL = r"""
WITH l AS (SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)) WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
d AS (SELECT line, length(line) AS n, min({'id': doc_id, 'no': no}) AS pos FROM l GROUP BY line),
pairs AS (SELECT a.line, a.n, b.line AS other, b.m, b.pos AS other_pos FROM d a JOIN (SELECT line, pos, n AS m, unnest([n - 1, n, n + 1]) AS n FROM d) b ON a.n = b.n AND b.pos < a.pos AND a.line <> b.line
    AND (left(a.line, (a.n - 1) // 2) = left(b.line, (a.n - 1) // 2) OR right(a.line, (a.n - 1) // 2) = right(b.line, (a.n - 1) // 2))),
-- levenshtein counts bytes here, of which a character has four at most; the edit itself is looked for by characters.
near AS (SELECT line, min(other_pos) AS near FROM pairs WHERE levenshtein(line, other) <= 4 AND len(list_filter(range(0, greatest(n, m)),
    lambda i: left(line, i) = left(other, i) AND substr(line, i + 1 + (n >= m)::INTEGER) = substr(other, i + 1 + (m >= n)::INTEGER))) > 0 GROUP BY line)
SELECT l.doc_id, l.no::INTEGER AS line_no, coalesce(near, pos).id AS keep_doc_id, coalesce(near, pos).no::INTEGER AS keep_line_no, (near IS NOT NULL)::INTEGER AS distance
FROM l JOIN d USING (line) LEFT JOIN near USING (line) WHERE near IS NOT NULL OR {'id': l.doc_id, 'no': l.no} <> pos
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    return decontaminate.contaminated_pairs(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), short_items=True)


OP2_SQL = r"""
WITH dt AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents)),
bt AS (SELECT item_id, len(w) AS n, unnest(range(len(w))) AS k, unnest(w) AS t FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL)),
along AS (SELECT doc_id, item_id, n, p - k AS start, count(*) AS matched, list(k) AS ks FROM dt JOIN bt USING (t) GROUP BY ALL),
held AS (SELECT * FROM along WHERE matched >= CASE WHEN n < 8 THEN n ELSE 0.7e0 * n END
    OR n > 20 AND matched >= 16 AND len(list_filter(ks, lambda k: len(list_filter(ks, lambda x: x BETWEEN k AND k + 19)) >= 16)) > 0)
SELECT doc_id, item_id, start::INTEGER AS start, matched::INTEGER AS matched, n::INTEGER AS tokens, matched / n AS similarity FROM held QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per span of a document that other documents hold too."""
    return chunk_dedup.repeated_spans(load(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(load(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, lang, source, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\x20\x09-\x0D]+', '', 'g')) AS n_marks, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters,
        length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper FROM w LEFT JOIN cover USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN word_chars > 0 THEN n_marks / word_chars ELSE 0e0 END AS mark_ratio,
        CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0e0 END AS symbol_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0e0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0e0 END AS repeat_ratio,
        CASE WHEN letters > 0 THEN upper / letters ELSE 0e0 END AS upper_ratio,
        CASE WHEN n_words > 0 THEN n_bangs / (n_bangs + n_words) ELSE 0e0 END AS bang_ratio FROM c),
long AS (SELECT doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, measure, value, CASE WHEN value < 1 THEN value / (1 - value) ELSE 'inf'::DOUBLE END AS odds FROM (
    SELECT doc_id, lang, source, 'mark' AS measure, mark_ratio AS value FROM m WHERE NOT base_failed
    UNION ALL SELECT doc_id, lang, source, 'symbol', symbol_ratio FROM m WHERE NOT base_failed
    UNION ALL SELECT doc_id, lang, source, 'dup_line', dup_line_ratio FROM m WHERE NOT base_failed
    UNION ALL SELECT doc_id, lang, source, 'repeat', repeat_ratio FROM m WHERE NOT base_failed
    UNION ALL SELECT doc_id, lang, source, 'upper', upper_ratio FROM m WHERE NOT base_failed
    UNION ALL SELECT doc_id, lang, source, 'bang', bang_ratio FROM m WHERE NOT base_failed)),
bins AS (SELECT lang, source, measure, CASE WHEN odds > 1e-4 THEN CASE WHEN value < 1 THEN least(ceil(ln(odds / 1e-4) / ln(1.01e0 / 0.99e0)), 1151) ELSE 1151 END ELSE 0 END::INTEGER AS bin, count(*) AS n FROM long GROUP BY ALL),
whole AS (SELECT e.measure, e.bin, coalesce(n, 0)::HUGEINT * 1151 + 20 AS w, (total + 20)::HUGEINT * 1151 AS whole FROM (SELECT measure, unnest(range(1, 1152)) AS bin, total FROM (SELECT measure, coalesce(sum(n) FILTER (WHERE bin > 0), 0) AS total FROM bins GROUP BY measure)) e
    LEFT JOIN (SELECT measure, bin, sum(n) AS n FROM bins WHERE bin > 0 GROUP BY ALL) o ON o.measure = e.measure AND o.bin = e.bin),
of_lang AS (SELECT t.lang, p.measure, p.bin, coalesce(o.n, 0)::HUGEINT * p.whole + 200 * p.w AS w, (t.total + 200)::HUGEINT * p.whole AS whole FROM (SELECT lang, measure, coalesce(sum(n) FILTER (WHERE bin > 0), 0) AS total FROM bins GROUP BY ALL) t
    JOIN whole p ON p.measure = t.measure LEFT JOIN (SELECT lang, measure, bin, sum(n) AS n FROM bins WHERE bin > 0 GROUP BY ALL) o ON o.lang = t.lang AND o.measure = p.measure AND o.bin = p.bin),
of_group AS (SELECT t.lang, t.source, p.measure, p.bin, coalesce(o.n, 0)::HUGEINT * p.whole + 200 * p.w AS w, (t.total + 200)::HUGEINT * p.whole AS whole FROM (SELECT lang, source, measure, coalesce(sum(n) FILTER (WHERE bin > 0), 0) AS total FROM bins GROUP BY ALL) t
    JOIN of_lang p ON p.lang = t.lang AND p.measure = t.measure LEFT JOIN bins o ON o.bin > 0 AND o.lang = t.lang AND o.source = t.source AND o.measure = p.measure AND o.bin = p.bin),
run AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS upto FROM of_group),
quart AS (SELECT lang, source, measure, min(bin) FILTER (WHERE 4 * upto >= whole) AS b25, min(bin) FILTER (WHERE 4 * upto >= 3 * whole) AS b75 FROM run GROUP BY ALL),
fence AS (SELECT lang, source, measure, 1e-4 * pow(1.01e0 / 0.99e0, b75 + 3e0 * (b75 - b25)) AS fence FROM quart),
above AS (SELECT doc_id, bool_or(odds > fence) AS bad FROM long JOIN fence USING (lang, source, measure) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, FALSE) AS kept FROM m LEFT JOIN above USING (doc_id)
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replica: the same pages after damage that a hash of the id decides: about 1 of 256 altered, 1 of 256 lost."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    replica = pages.where(fate != "01").withColumn("html", F.when(fate == "00", F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    return fixity.audit(pages, replica)


OP7_SQL = r"""
WITH r AS (SELECT page_id, page_id // 1024 AS file, left(md5(page_id::VARCHAR), 2) AS fate,
    strlen('WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:page:>..WARC-Date: 2000-01-01T00:00:00Z..WARC-Target-URI: ..Content-Type: text/html..Content-Length: ......') + strlen(page_id::VARCHAR) + strlen(url) + strlen(strlen(html)::VARCHAR) + strlen(html) + 2 AS length FROM pages),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r)
SELECT page_id, file, off::BIGINT AS "offset", length::BIGINT AS length, CASE fate WHEN '00' THEN 'altered' ELSE 'missing' END AS status FROM o WHERE fate IN ('00', '01')
"""


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages on hosts with an advertising or tracking label."""
    pages = load(spark, sf_dir, "pages")
    url = F.col("url")
    listed = pages.where(urls.host_of(url).rlike(r"(^|\.)(ads?|track(er|ing)?)[-.]")).select(urls.canonical_url(url).alias("canonical_url"))
    return urls.filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html?|/+)$', '') END AS key FROM p),
listed AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND regexp_matches(host, '(^|\.)(ads?|track(er|ing)?)[-.]')),
r(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (SELECT page_id, host, path, key, (SELECT max_by({'rule': h || q, 'verdict': r.verdict}, length(h || q)) FROM r WHERE (k.host = h OR ends_with(k.host, '.' || h)) AND starts_with(k.path, q)) AS m FROM k)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM hit
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(load(spark, sf_dir, "documents"))
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(of_kind("assign", "access", "hex")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def _op11_sql(reach: int = 200) -> str:
    """Places from the lengths of the pieces between matches. Letters in either case are spelled out, as folding would add
    letters beyond ASCII."""
    either = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    assigned = lambda words, value: "(" + either(words) + ")" + r"""["']?\x20*[:=]\x20*["']?""" + f"({value}+)"
    secret = assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]")
    login = assigned(["access_key_id", "client_id", "account", "username", "user", "login"], "[A-Za-z0-9@_.+-]")
    host = assigned(["hostname", "host", "endpoint", "server"], "[A-Za-z0-9_.:/-]")
    kinds = {
        "assign": secret, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}", "login": login, "host": host,
        "url": r"""://[^\x00-\x20"'<>]+""", "bare": "[A-Za-z0-9+/=_-]{32,}", "blank": r"\n[\x09\x0D\x20]*\n",
    }
    tables = ["d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    for k, p in kinds.items():
        tables.append(f"{k}_m AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT doc_id, regexp_extract_all(t, {quote(p)}) AS m, string_split_regex(t, {quote(p)}) AS g FROM d))")
        size = lambda what: f"coalesce(list_sum(list_transform({what}, lambda x: length(x))), 0)::BIGINT"
        tables.append(f"{k} AS (SELECT doc_id, m[i] AS w, {size('g[1:i]')} + {size('m[1:i - 1]')} AS s, {size('g[1:i]')} + {size('m[1:i]')} AS e FROM {k}_m)")
    value = lambda t: f"length(regexp_extract(w, {quote(kinds[t])}, 2))"
    return f"""WITH {", ".join(tables)},
strong AS (SELECT doc_id, 0 AS kind, s, e FROM assign WHERE {value('assign')} >= 12 UNION ALL SELECT doc_id, 1, s, e FROM access UNION ALL SELECT doc_id, 2, s, e FROM hex),
maybe AS (SELECT doc_id, 'S' AS role, 3 AS kind, s, e FROM assign WHERE {value('assign')} BETWEEN 6 AND 11
    UNION ALL SELECT doc_id, 'S', 3, s, e FROM bare WHERE regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[0-9]')
    UNION ALL SELECT doc_id, 'I', 4, s, e FROM login WHERE {value('login')} >= 3),
weak AS (SELECT * FROM maybe WHERE NOT EXISTS (SELECT 1 FROM strong WHERE strong.doc_id = maybe.doc_id AND strong.s < maybe.e AND maybe.s < strong.e)),
parts AS (SELECT *, (SELECT count(*) FROM blank WHERE blank.doc_id = p.doc_id AND blank.s < p.s) AS scope FROM (SELECT doc_id, role, false AS strong, kind, s, e FROM weak
    UNION ALL SELECT doc_id, CASE kind WHEN 0 THEN 'S' ELSE 'I' END, true, kind, s, e FROM strong WHERE kind < 2
    UNION ALL SELECT doc_id, 'E', true, -1, s, e FROM url UNION ALL SELECT doc_id, 'E', true, -1, s, e FROM host) p),
near AS (SELECT a.doc_id, a.role, a.kind, a.s, a.e, bool_or(b.role = 'I' AND b.strong) AS access, bool_or(b.role = 'I' AND NOT b.strong) AS login, bool_or(b.role = 'S') AS secret, bool_or(b.role = 'E') AS endpoint
    FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND a.scope = b.scope AND a.role <> b.role AND b.s - a.e <= {reach} AND a.s - b.e <= {reach} WHERE NOT a.strong GROUP BY ALL),
found AS (SELECT doc_id, kind, s, e FROM strong UNION ALL SELECT doc_id, kind, s, e FROM near WHERE CASE role WHEN 'S' THEN access OR login AND endpoint ELSE secret AND endpoint END),
named AS (SELECT *, (['assign', 'access', 'hex', 'secret', 'login'])[kind + 1] || ':' || s::VARCHAR || ':' || e::VARCHAR AS x FROM found)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    sha256(coalesce(string_agg(x, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, kind, e), '') AS spans
FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_documents(load(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    short = found.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs", "times")
    out = alignment.score_links(short, alignment.vocabulary_size(alignment.B_FILE))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof, and what it says of the row after tampering: texts in lower case where 5 divides the id's CRC."""
    docs, text = load(spark, sf_dir, "documents"), F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    suspect = F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)
    found = manifest.leaf_digest([suspect if c == "text" else F.col(c) for c in manifest.COLUMNS])
    proofs = manifest.build_manifest(docs, carry={"doc_id": F.col("doc_id"), "found": found}).proofs()
    out = proofs.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), manifest.fold_proof(F.col("found"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql(levels: int = 6, upper: int = 3) -> str:
    """The tree level by level, for up to 16 ** levels rows of a source and 16 ** upper sources."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    hash_of = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in manifest.COLUMNS) + ")"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: STEP)"
    step = "xor(h, c)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda x: xor(x >> 1, (x & 1) * 3988292384))[1]"
    crc = f"xor({crc.replace('STEP', step)}, 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tables = [
        f"d AS (SELECT *, coalesce('s' || source, '') AS k, {hash_of('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hash_of(lowered)} ELSE {hash_of('text')} END AS found FROM documents)",
        "a0 AS (SELECT doc_id, found, leaf, k, leaf AS h, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d)",
    ]

    def climb(t: str, steps: int) -> None:
        run, size = "PARTITION BY k, i // 16 ORDER BY i ROWS BETWEEN", "CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({}), '') ELSE '' END"
        for x in range(steps):
            if x:
                tables.append(f"{t}{x} AS (SELECT k, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {t}{x - 1} GROUP BY k, i // 16, n)")
            tables.append(f"{t}s{x} AS (SELECT k, i, n, h, {size.format(run + ' UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {size.format(run + ' 1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {t}{x})")

    climb("a", levels + 1)
    tables.append(f"u0 AS (SELECT '' AS k, k AS source_key, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM a{levels})")
    climb("u", upper + 1)
    steps = [f"as{x}" for x in range(levels)] + [f"us{x}" for x in range(upper)]
    fold = "a0.found"
    for s in steps:
        fold = f"CASE WHEN {s}.n > 1 THEN sha256({s}.l || {fold} || {s}.r) ELSE {fold} END"
    joins = " ".join(f"JOIN as{x} ON as{x}.k = a0.k AND as{x}.i = a0.i // {16**x}" for x in range(levels))
    joins += " JOIN u0 ON u0.source_key = a0.k " + " ".join(f"JOIN us{x} ON us{x}.i = u0.i // {16**x}" for x in range(upper))
    proof = " || ".join(f"{s}.l || {s}.r" for s in steps)
    tables.append(f"p AS (SELECT doc_id, leaf, u0.h AS subroot, (SELECT h FROM u{upper}) AS root, sha256({proof}) AS proof_sha256, {fold} AS folded_root FROM a0 {joins})")
    return "WITH " + ",\n".join(tables) + "\nSELECT *, folded_root = root AS verified FROM p"


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_decontamination": op2_decontamination, "op3_substring_dedup": op3_substring_dedup, "op4_language_id": op4_language_id, "op5_quality_rules": op5_quality_rules, "op6_quality_classifier": op6_quality_classifier, "op7_warc_fixity": op7_warc_fixity, "op8_url_filters": op8_url_filters, "op9_jaccard_join": op9_jaccard_join, "op10_mixing": op10_mixing, "op11_secret_scan": op11_secret_scan, "op12_token_alignment": op12_token_alignment, "op13_merkle_manifest": op13_merkle_manifest}
ORACLE = {"op1_line_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op5_quality_rules": OP5_SQL, "op7_warc_fixity": OP7_SQL, "op8_url_filters": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_secret_scan": _op11_sql(), "op13_merkle_manifest": _op13_sql()}
