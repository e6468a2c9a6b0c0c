"""Secret scans with multipart credential linking (operator 11).

One pass over each whole text finds strong secrets, which count by themselves, and the parts of credentials that count only
together: identifiers (access ids; weak: assigned account names), secrets (assigned values; weak: short ones, and bare
mixed tokens) and endpoints (urls, assigned hosts). A scope is a block of text between blank lines. Parts are joined as
intervals inside their scope: two belong together if at most ``reach`` code points lie between them. A weak secret is
reported where an access id belongs to it, or both an account name and an endpoint; a weak account name where an endpoint
and a secret belong to it. Everything else weak is dropped.

Only parts of scopes that hold something weak leave the row of their text. The join orders them by place inside (row,
scope): a part belongs to one of a role exactly if the nearest of that role before or after it is within reach, so each
part is read once, however many there are. A text's parts are in one task at most; no text is moved.

Places are code points, ends exclusive. Defined cases: null texts are empty; repeated rows are each reported; ids may be null
and of any type; an empty table gives an empty result; other columns are not read, whatever their names."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import materialize
from assetloom.llm.bloom import split_possible
from assetloom.llm.rows import packed, unpacked

# Patterns of the secrets that count by themselves, and the lengths from which they do.
ASSIGNED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Parts of credentials: account names and hosts that are assigned, urls, and bare tokens of three kinds of characters.
LOGIN = r"""(access_key_id|client_id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.+-]+)"""
HOST = r"""(hostname|host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.:/-]+)"""
URL = r"""://[^\x00-\x20"'<>]+"""
BARE = r"[A-Za-z0-9+/=_-]{32,}"
LEAST_WEAK, LEAST_LOGIN = 6, 3
#: Kinds in their order; the last two are those that linking adds.
KINDS = ["assign", "access", "hex", "secret", "login"]
SCAN = "struct<spans:array<struct<kind:int,start:int,end:int>>,parts:array<struct<role:string,strong:boolean,kind:int,start:int,end:int,scope:int>>>"


def _patterns() -> dict[str, re.Pattern]:
    folded = {"assign": ASSIGNED, "login": LOGIN, "host": HOST}
    plain = {"access": ACCESS, "hex": HEX, "url": URL, "bare": BARE, "blank": r"\n[\x09\x0D\x20]*\n"}
    return {k: re.compile(p, re.ASCII | re.IGNORECASE) for k, p in folded.items()} | {k: re.compile(p) for k, p in plain.items()}


def scan_text(text: str, find: dict[str, re.Pattern]) -> dict:
    """The strong spans of a text, by kind and place, and the parts of credentials, if any of them is weak."""
    assigned = list(find["assign"].finditer(text))
    strong = [(0, *m.span()) for m in assigned if len(m[2]) >= LEAST_ASSIGNED]
    strong += [(1, *m.span()) for m in find["access"].finditer(text) if len(m[0]) >= LEAST_ACCESS]
    strong += [(2, *m.span()) for m in find["hex"].finditer(text) if len(m[0]) >= LEAST_HEX]
    spans = sorted((start, kind, end) for kind, start, end in strong)
    starts, ends = [s[0] for s in spans], [0, *accumulate((s[2] for s in spans), max)]
    weak = [("S", *m.span(), 3) for m in assigned if LEAST_WEAK <= len(m[2]) < LEAST_ASSIGNED]
    weak += [("S", *m.span(), 3) for m in find["bare"].finditer(text) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    weak += [("I", *m.span(), 4) for m in find["login"].finditer(text) if len(m[2]) >= LEAST_LOGIN]
    # Not what a strong span covers: one that begins before the end and ends behind the start.
    weak = [w for w in weak if ends[bisect_left(starts, w[2])] <= w[1]]
    parts: list[dict] = []
    if weak:
        breaks = [m.start() for m in find["blank"].finditer(text)]
        part = lambda role, strong, kind, start, end: {"role": role, "strong": strong, "kind": kind, "start": start, "end": end, "scope": bisect_left(breaks, start)}
        parts = [part(role, False, kind, start, end) for role, start, end, kind in weak]
        parts += [part("SI"[kind], True, kind, start, end) for start, kind, end in spans if kind < 2]
        parts += [part("E", True, -1, *m.span()) for name in ("url", "host") for m in find[name].finditer(text)]
    return {"spans": [{"kind": kind, "start": start, "end": end} for start, kind, end in spans], "parts": parts}


def scanned(text: Column) -> Column:
    """SCAN of each text."""

    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = _patterns()
        for texts in batches:
            yield pd.DataFrame([scan_text(t or "", find) for t in texts.tolist()], columns=["spans", "parts"])

    return scan(text)


def linked_parts(parts: DataFrame, reach: int = 200) -> DataFrame:
    """(row, kind, start, end) of the weak parts that complete a credential; parts: (row, role, strong, kind, start, end,
    scope). Parts of equal place are told apart by their kind."""
    scope, order = W.partitionBy("row", "scope"), ["start", "end", "kind"]
    # What comes after is what comes before in the other order: a frame up to the end would be read anew for every part.
    before, after = (scope.orderBy(*by).rowsBetween(W.unboundedPreceding, -1) for by in (order, [F.desc(c) for c in order]))

    def near(which: Column) -> Column:
        """Whether one of the parts of ``which`` is within reach."""
        left, right = F.max(F.when(which, F.col("end"))).over(before), F.min(F.when(which, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - left <= reach, F.lit(False)) | F.coalesce(right - F.col("end") <= reach, F.lit(False))

    role = lambda r: F.col("role") == r
    marked = parts.withColumns({"access": near(role("I") & F.col("strong")), "login": near(role("I") & ~F.col("strong")), "secret": near(role("S")), "endpoint": near(role("E"))})
    whole = (role("S") & (F.col("access") | (F.col("login") & F.col("endpoint")))) | (role("I") & F.col("secret") & F.col("endpoint"))
    return marked.where(~F.col("strong") & whole).select("row", "kind", "start", "end")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(id, spans) of every row. spans: (kind, start, end) of all secrets, by start, then in the order of KINDS."""
    found = docs.select(F.col(id_col).alias("id"), scanned(F.col(text_col)).alias("s")).select("id", "s.spans", "s.parts")
    rows = materialize(found.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    parts = rows.where(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    linked = linked_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    some = rows.where(F.size("parts") > 0).join(linked, "row", "left").select("id", F.concat("spans", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))).alias("spans"))
    spans = rows.where(F.size("parts") == 0).select("id", "spans").unionByName(some)
    # By start, kind and end.
    sorted_ = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return spans.select(F.col("id").alias(id_col), F.transform(sorted_, lambda s: F.struct(kind_name(s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def kind_name(kind: Column) -> Column:
    return reduce(lambda out, k: F.when(kind == k, F.lit(KINDS[k])).otherwise(out), range(len(KINDS)), F.lit(None).cast("string"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the spans of each id replaced in its text; ids are unique, overlapping spans go together. Only rows
    that may have a span are moved."""
    hit = materialize(spans.where(F.size("spans") > 0).select(F.col(id_col).alias("key"), F.col("spans").alias("marked")), "secret-spans")
    asked, stay = split_possible(packed(docs, key=F.col(id_col)), "key", hit.select("key"))
    joined = asked.join(hit, "key", "left").withColumn("t", F.col("row").getField(text_col))

    def step(state: Column, s: Column) -> Column:
        kept = F.concat(F.substring(F.col("t"), state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.concat(state["out"], F.when(s["start"] >= state["at"], kept).otherwise(F.lit(""))).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate("marked", start, step, lambda state: F.concat(state["out"], F.substring(F.col("t"), state["at"] + 1, F.length("t"))))
    done = joined.select(F.when(F.col("marked").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, masked)).alias("row"))
    return unpacked(stay).unionByName(unpacked(done))
