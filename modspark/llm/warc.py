"""Fixity audit of WARC replicas with Merkle trees over ordered records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspark.llm.common import stored

FAN = 16
PAGES_PER_ARCHIVE = 512
ROWS_PER_FILE = 4096
NODE = ["a", "f", "o"]
CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC record; nulls are written as empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF * 2),
        body,
        F.lit(CRLF * 2),
    )


def manifest(pages: DataFrame, copy: Column | None = None) -> DataFrame:
    """Where each page's record lies: ``a`` (archive of 512 page ids), ``f`` (file of it), ``o`` (place), and
    its digest and length; with ``copy``, another html column, also those of the copy's record.

    Within a file records are ordered by page_id, url and digest. An archive whose page_ids repeat
    (or are null: archive -1) until it has more than ``ROWS_PER_FILE`` records is cut into files by row.
    """
    page, url = F.col("page_id").cast("long"), F.col("url").cast("string")
    texts = {"": record(page, url, F.col("html"))} | ({"_copy": record(page, url, copy)} if copy is not None else {})
    own = [(F.unhex(F.sha2(t, 256)).alias(f"hash{k}"), F.octet_length(t).cast("long").alias(f"length{k}")) for k, t in texts.items()]
    rows = pages.select(page.alias("page_id"), url.alias("url"), *(c for pair in own for c in pair), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("a", F.coalesce(F.floor(F.col("page_id") / PAGES_PER_ARCHIVE), F.lit(-1)))
    rows = stored(rows, "records")
    files = rows.groupBy("a").agg((F.floor(F.count(F.lit(1)) / (ROWS_PER_FILE + 1)) + 1).alias("files"))
    rows = rows.join(files, "a").withColumn("f", F.pmod(F.xxhash64("row"), F.col("files")))
    place = F.expr("row_number() over (partition by a, f order by page_id, url, hash, row) - 1").cast("long")
    return rows.withColumn("o", place).drop("row", "files")


@dataclass
class Level:
    nodes: DataFrame
    up: list[Column]  # the parent's number
    in_file: bool  # offsets count from the parent's


def levels(replicas: DataFrame) -> list[Level]:
    """The trees of both replicas, from records to the root, each level in the shared folder.

    Nodes over records hash 16 ordered ranges of a file, then files of an archive, then ranges of
    archives. A node knows the bytes that it covers. A level is a sixteenth of the one below.
    """
    a, f, o = (F.col(c) for c in NODE)
    zero = F.lit(0).cast("long")
    nodes = stored(replicas, "leaves")
    places, high, low = nodes.agg(F.max("o"), F.max("a"), F.min("a")).first()
    steps, n = [], (places or 0) + 1
    while n > 1:
        steps.append(([a, f, F.floor(o / FAN)], True))
        n = -(-n // FAN)
    steps.append(([a, zero, zero], False))
    low, high = low or 0, high or 0
    while low != high:
        steps.append(([F.floor((a + 1) / FAN), zero, zero], False))  # archive -1 goes with those from 0 on
        low, high = (low + 1) // FAN, (high + 1) // FAN
    out = []
    for up, in_file in steps:
        out.append(Level(nodes, up, in_file))
        child = nodes.select("replica", F.struct(*(c.alias(k) for c, k in zip(up, NODE, strict=True))).alias("up"), F.struct(*NODE, "length", F.hex("hash").alias("hash")).alias("part"))
        node = child.groupBy("replica", "up").agg(F.sum("part.length").alias("length"), F.array_sort(F.collect_list("part")).alias("parts"))
        joined = F.concat_ws("|", F.transform("parts", lambda x: F.concat_ws(",", *(x[c].cast("string") for c in (*NODE, "length", "hash")))))
        nodes = stored(node.select("replica", "up.*", F.unhex(F.sha2(joined, 256)).alias("hash"), "length"), "nodes")
    return [*out, Level(nodes, [], False)]


def _both(level: DataFrame, *more: str) -> DataFrame:
    """One row per node, with what either replica has of it."""

    def of(replica: int, column: str) -> Column:
        return F.max(F.when(F.col("replica") == replica, F.col(column)))

    own = [of(0, "hash").alias("hash_a"), of(1, "hash").alias("hash_b"), of(0, "length").alias("length_a"), of(1, "length").alias("length_b")]
    return level.groupBy(*NODE).agg(*own, *(F.coalesce(of(0, c), of(1, c)).alias(c) for c in more))


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """The records in which two replicas differ.

    Both are manifests: ``a, f, o, page_id, url, hash, length`` with one row per place. Returns
    ``page_id, archive, file, ordinal, offset, length_a, length_b, digest_a, digest_b, status``:
    ``missing`` (not in b), ``extra`` (not in a), ``length`` or ``bytes``. ``offset`` is the
    record's place in replica a's file. Null page_ids and urls are allowed. Equal replicas, or two
    empty ones, give no rows.

    Roots are compared first; then only children of nodes that differ are looked at, level by
    level, with offsets summed over the siblings before. Other columns are ignored.
    """
    keep = [*NODE, "page_id", "url", "hash", "length"]
    both = replica_a.select(F.lit(0).alias("replica"), *keep).union(replica_b.select(F.lit(1).alias("replica"), *keep))
    *below, root = levels(both)
    differs = ~F.col("hash_a").eqNullSafe(F.col("hash_b"))
    found = _both(root.nodes).where(differs).select(*NODE, F.lit(0).cast("long").alias("offset"))
    up = [f"up_{c}" for c in NODE]
    before = F.expr("sum(coalesce(length_a, 0)) over (partition by up_a, up_f, up_o order by o rows between unbounded preceding and 1 preceding)")
    for level in reversed(below):
        above = found.select(*(F.col(c).alias(k) for c, k in zip(NODE, up, strict=True)), F.col("offset").alias("up_offset"))
        near = level.nodes.select("*", *(c.alias(k) for c, k in zip(level.up, up, strict=True))).join(above, up)
        last = level is below[0]
        nodes = _both(near, *up, "up_offset", *(["page_id", "url"] if last else []))
        offset = F.col("up_offset") + F.coalesce(before, F.lit(0)) if level.in_file else F.lit(0).cast("long")
        found = nodes.withColumn("offset", offset).where(differs)
        if not last:
            found = stored(found.select(*NODE, "offset"), "differing")
    status = (
        F.when(F.col("hash_b").isNull(), "missing")
        .when(F.col("hash_a").isNull(), "extra")
        .when(F.col("length_a") != F.col("length_b"), "length")
        .otherwise("bytes")
    )
    return found.select(
        "page_id",
        F.col("a").alias("archive"),
        F.col("f").alias("file"),
        F.col("o").alias("ordinal"),
        "offset",
        "length_a",
        "length_b",
        F.lower(F.hex("hash_a")).alias("digest_a"),
        F.lower(F.hex("hash_b")).alias("digest_b"),
        status.alias("status"),
    )


def audit_pages(pages: DataFrame) -> DataFrame:
    """The archive of ``pages`` against a replica with faults that its page ids name: changed, cut and
    lost records. See ``audit``; pages without id have no faults."""
    k = F.coalesce(F.col("page_id"), F.lit(0))
    changed = F.when(k % 97 == 5, F.translate("html", "e", "c"))
    copy = changed.when(k % 101 == 7, F.expr("substring(html, 1, length(html) div 2)")).otherwise(F.col("html"))
    both = stored(manifest(pages.select("page_id", "url", "html"), copy), "manifest")
    place = [*NODE, "page_id", "url"]
    replica = both.where(k % 103 != 9).select(*place, F.col("hash_copy").alias("hash"), F.col("length_copy").alias("length"))
    return audit(both.select(*place, "hash", "length"), replica)


def write_warc(pages: DataFrame, path: str) -> None:
    """Writes WARC files to ``path``, one folder for each archive; records follow each other by page_id."""
    end = CRLF * 2
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    archive = F.coalesce(F.floor(F.col("page_id") / PAGES_PER_ARCHIVE), F.lit(-1)).alias("archive")
    rows = pages.select(archive, "page_id", "url", text.alias("record")).repartition("archive").sortWithinPartitions("archive", "page_id", "url")
    body = F.expr(f"substring(record, 1, length(record) - {len(end)})").alias("value")
    rows.select("archive", body).write.partitionBy("archive").option("lineSep", end).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: ``path, ordinal, offset, length, uri, digest, body``. A cut last record is kept
    with what there is. One file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                raw, at, out = content.as_py(), 0, []
                while at < len(raw):
                    split = raw.find(b"\r\n\r\n", at)
                    if split < 0:
                        break
                    head = dict(x.split(b": ", 1) for x in raw[at:split].split(b"\r\n")[1:] if b": " in x)
                    n = int(head.get(b"Content-Length", b"0"))
                    end = min(split + 8 + n, len(raw))
                    out.append((name.as_py(), len(out), at, end - at, head.get(b"WARC-Target-URI", b"").decode(), hashlib.sha256(raw[at:end]).hexdigest(), raw[split + 4 : split + 4 + n]))
                    at = end
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = ["path", "ordinal", "offset", "length", "uri", "digest", "body"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, ordinal long, offset long, length long, uri string, digest string, body binary")
