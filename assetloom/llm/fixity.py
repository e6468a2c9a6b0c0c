"""WARC records and their Merkle fixity audit (operator 7).

Pages become WARC resource records (WARC 1.0, with the mandatory fields), laid out in files by ranges of ``file_span`` ids, in id order; a record's offset is
the length of those before it. A file's tree has a leaf for every ``fanout`` consecutive ids and a node for every
``fanout`` children; a node's digest covers its children's digests in order, its offset range their records. To compare
two replicas, the roots are joined first, then only the children of nodes that differ, down to single records: of the
rest nothing is read but the digests above. Nodes stand for id ranges, so a lost record changes one branch and leaves
its neighbours alone, although it moves every later offset.

Each level is written and the next one made from it: a level has a ``fanout``-th of the rows of the one below.

Defined cases: null urls and payloads are empty; line breaks in a url are written as %0D and %0A, so they can't end a
header; ids are whole numbers of any sign; rows with a null id have no place in a file and are left out; rows with one
id are one record group, in digest order, and differ if any of them does; an empty replica makes every record of the
other missing or extra; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from assetloom.common import materialize
from assetloom.llm.rows import integer_id

CRLF = "\r\n"
#: The date of records whose pages have none of their own.
WARC_DATE = "2000-01-01T00:00:00Z"


def warc_record(id_: Column, url: Column, payload: Column, date: str = WARC_DATE) -> Column:
    """The bytes of one resource record."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"), id_.cast("string"), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))


def record_index(pages: DataFrame, id_col: str, url_col: str, payload_col: str, file_span: int) -> DataFrame:
    """(file, id, copy, offset, length, digest) of every record. A file is one window of at most ``file_span`` ids."""
    id_ = integer_id(pages, id_col)
    r = pages.where(id_.isNotNull()).select(id_.alias("id"), warc_record(id_, F.col(url_col), F.col(payload_col)).alias("record"))
    # Whole division of a multiple: exact for ids of any size and sign.
    file = F.expr(f"(id - pmod(id, {file_span})) div {file_span}")
    r = r.select(file.alias("file"), "id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = W.partitionBy("file").orderBy("id", "digest")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return r.select("file", "id", F.row_number().over(W.partitionBy("file", "id").orderBy("digest")).alias("copy"), offset.alias("offset"), "length", "digest")


def merkle_levels(index: DataFrame, file_span: int, fanout: int) -> list[DataFrame]:
    """Levels from the leaves to the roots, each written: (file, node, first, end, digest). A node digests at most
    ``fanout`` children, a leaf the records of ``fanout`` ids."""
    place = F.floor(F.pmod(F.col("id"), F.lit(file_span)) / fanout)

    def over(df: DataFrame, node: Column, order: list[str]) -> DataFrame:
        children = F.sort_array(F.collect_list(F.struct(*order, "digest")))
        digests = F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256)
        return materialize(df.groupBy("file", node.alias("node")).agg(F.min("first").alias("first"), F.max("end").alias("end"), digests.alias("digest")), "merkle")

    level = over(index.withColumn("first", F.col("offset")).withColumn("end", F.col("offset") + F.col("length")), place, ["id", "copy"])
    levels, width = [level], fanout
    while width < file_span:
        level = over(levels[-1].withColumnRenamed("node", "child"), F.floor(F.col("child") / fanout), ["child"])
        levels.append(level)
        width *= fanout
    return levels


def audit(one: DataFrame, two: DataFrame, file_span: int = 1024, fanout: int = 8, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, file, offset, length, status) of every record in which replica ``two`` differs from ``one``. status:
    altered, missing or extra; the offset is that of the replica which has the record, ``one`` if both have."""
    a, b = (materialize(record_index(x, id_col, url_col, payload_col, file_span), "records") for x in (one, two))
    tree_a, tree_b = (merkle_levels(x, file_span, fanout) for x in (a, b))
    open_nodes = None
    for level_a, level_b in zip(reversed(tree_a), reversed(tree_b)):
        x, y = (t.select("file", "node", "digest") for t in (level_a, level_b))
        if open_nodes is not None:
            x, y = (t.withColumn("parent", F.floor(F.col("node") / fanout)).join(open_nodes, ["file", "parent"], "left_semi").drop("parent") for t in (x, y))
        differ = x.join(y.withColumnRenamed("digest", "other"), ["file", "node"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
        open_nodes = materialize(differ.select("file", F.col("node").alias("parent")), "merkle-open")
    leaf = F.floor(F.pmod(F.col("id"), F.lit(file_span)) / fanout)
    x, y = (t.withColumn("parent", leaf).join(open_nodes, ["file", "parent"], "left_semi").drop("parent") for t in (a, b))
    y = y.select("file", "id", "copy", F.col("offset").alias("offset_b"), F.col("length").alias("length_b"), F.col("digest").alias("digest_b"))
    both = x.join(y, ["file", "id", "copy"], "full").where(~F.col("digest").eqNullSafe(F.col("digest_b")))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return both.select(F.col("id").alias(id_col), "file", F.coalesce("offset", "offset_b").alias("offset"), F.coalesce("length", "length_b").alias("length"), status.alias("status"))


def _records(raw: bytes) -> Iterator[tuple[int, int, str | None, bytes]]:
    """(offset, length, uri, payload) of the records of a file, up to one that is cut short or has no length."""
    at = 0
    while (head := raw.find(b"\r\n\r\n", at)) >= 0:
        lines = raw[at:head].decode("utf-8", "replace").split(CRLF)[1:]
        fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}
        size = fields.get("content-length", "")
        if not size.isdecimal() or (end := head + 4 + int(size)) + 4 > len(raw):
            return
        yield at, end + 4 - at, fields.get("warc-target-uri"), raw[head + 4 : end]
        at = end + 4


def _members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file, up to one that is damaged."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        member, parts, end = zlib.decompressobj(31), [], at
        try:
            while end < len(raw) and not member.eof:
                piece = view[end : end + (1 << 16)]
                parts.append(member.decompress(piece))
                end += len(piece)
        except zlib.error:
            return
        if not member.eof:
            return
        end -= len(member.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def read_warc(files: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """(path, offset, length, uri, payload) of the records in a ``binaryFile`` table of WARC files, plain or with one gzip
    member for each record. Offsets and lengths are those in the file. A record that is cut short, damaged or without a
    length ends its file; field names may be in any case. A file is read by one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows, size = ["path", "offset", "length", "uri", "payload"], [], 0
        for pdf in batches:
            for path, raw in zip(pdf["path"], map(bytes, pdf["content"])):
                if raw[:2] == b"\x1f\x8b":
                    found = ((at, n, uri, payload) for at, n, content in _members(raw) for _, _, uri, payload in _records(content))
                else:
                    found = _records(raw)
                for at, n, uri, payload in found:
                    rows.append((path, at, n, uri, payload))
                    size += len(payload)
                    if size > batch_bytes:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(parse, "path string, offset long, length long, uri string, payload binary")
