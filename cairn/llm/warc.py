"""WARC records, files of them, and a Merkle fixity audit of replicas.

A page becomes a resource record. A manifest lists the records of a shard in order, with their byte
ranges and digests. A leaf hashes a record's digest, its length and its place: the distance from the end
of the record before it, which is nothing in the manifest. Digests and lengths of ``FANOUT`` successive
ranges hash to a node, nodes to higher nodes, up to one root a shard. An audit builds the same tree over
a replica, compares the roots, and goes down only into branches whose digests differ, until it knows the
ranges at fault. Because places are relative to the record before, a record that is gone, or shorter than
it was, doesn't mark all records after it; one that lies elsewhere does mark itself and its follower.

A replica with columns ``file`` and ``offset`` (``read_warc``) has its places audited, else only its
content. Its files count as one row of bytes in the order of their names, so it doesn't matter where
they are cut. Rows that share id and address are one leaf: its digest covers their number and their
digests in any order, so even a very common key is aggregated before the shuffle. Shards follow a digest
of id and address, so they are even whatever the keys are.

``read_warc`` reads files that others wrote: any record type and id, bytes of any encoding, gzip members.
Spark's text source cuts files at the mark between records, so large plain files are read in splits.
The mark inside a payload is no record: lengths tell, in one ordered pass over a row of numbers a mark.
A record whose length leads to no mark and no end of file ends at the next mark (``whole`` is false), so
damage to a length doesn't take the rest of the file with it. Text that is no record is passed over.

Edge cases: null ids, addresses and pages are allowed; a null page is an empty payload. Exact repeats
count. A record that only one side has is ``missing`` or ``extra``. Empty tables and files give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage, scratch_path

FANOUT = 16
SHARD_RECORDS = 2048
END = "\r\n\r\n"
VERSION = "WARC/1."
MARK = END + VERSION
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The record as text, without the two line ends that close it."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(END),
        html,
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, record) of each row of (page_id, url, html)."""
    return pages.select("page_id", "url", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def write_warc(made: DataFrame, path: str, *order: Column) -> None:
    """Write the records as WARC files; a record's end mark is the writer's line separator.

    The files follow ``order``, which is the manifest's if none is given: each is a range of it, and rows
    alike in it spread over several files.
    """
    if not order:
        order = shard_of(leaf_key(), made.select("page_id", "url").distinct().count()), F.col("page_id"), F.col("url")
    names = [f"o{i}" for i in range(len(order))] + ["salt"]
    by = [c.alias(n) for c, n in zip(order, names)]
    (
        made.select("record", *by, F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
        .repartitionByRange(*names)
        .sortWithinPartitions(*names)
        .select("record")
        .write.option("lineSep", END)
        .text(path)
    )


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, start, value): what lies between marks, with its first byte counted within its split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, upto = None, 0
        for batch in batches:
            starts = []
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for place, value in zip(places, batch.column(2), strict=True):
                if place != split:
                    split, upto = place, 0
                starts.append(upto)
                upto += value.as_buffer().size + len(MARK)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, pa.int64()), batch.column(2)],
                names=["file", "block", "start", "value"],
            )

    lines = spark.read.option("lineSep", MARK).text(path)
    split = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    return split.mapInArrow(run, "file string, block bigint, start bigint, value binary")


def starts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where splits begin, and which chunks aren't a record of their own, from lengths alone.

    The first table is (file, block, base); the second (file, block, start, at, piece) has the chunks of
    records with the mark inside, and chunks of no record (null ``at``): usually none, so that payloads
    stay where they were read.

    ``found`` has (file, block, start, size, prefix, head, stated): bytes of the chunk, of the version mark
    at its front (the first one of a file), of its head, and the stated length (null: no record).
    """
    found = cut_lineage(found)
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MARK)).alias("bytes")))
    bases = cut_lineage(blocks.select("file", "block", F.coalesce(F.sum("bytes").over(within), F.lit(0)).alias("base")))
    ends = blocks.groupBy("file").agg((F.sum("bytes") - len(MARK)).alias("last"))
    placed = (
        found.join(bases, ["file", "block"])
        .withColumn("at", place())
        .withColumn("stop", F.col("base") + F.col("start") + F.col("size"))
        .withColumn("end", F.col("at") + len(VERSION) + F.col("head") + len(END) + F.col("stated"))
    )
    placed = cut_lineage(placed.select("file", "block", "start", "at", "stop", "end"))
    longer = placed.filter("end > stop").select("file", "at", "end")
    marks = placed.select("file", (F.col("at") - len(END)).alias("end"))
    closed = longer.join(marks, ["file", "end"], "left_semi").union(
        longer.join(ends, "file").filter(f"end IN (last, last - {len(END)})").select("file", "end", "at")
    )
    reach = closed.select("file", "at", F.col("end").alias("reach"))
    sized = placed.join(reach.distinct(), ["file", "at"], "left").select(
        "file", "block", "start", "at", F.coalesce("reach", "stop").alias("stop"), F.col("end").isNotNull().alias("valid")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, top, piece, upto = None, None, 0, 0
        for batch in batches:
            records, pieces = [], []
            for r in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if r[0] != file or r[1] >= upto:
                    file, piece, upto = r[0], 0, r[2]
                    top = r[1] if r[3] else None
                else:
                    piece += 1
                records.append(top)
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(records, pa.int64()), pa.array(pieces, pa.int64())],
                names=["file", "block", "start", "at", "piece"],
            )

    ordered = sized.repartition("file").sortWithinPartitions("file", "at")
    told = cut_lineage(ordered.mapInArrow(run, "file string, block bigint, start bigint, at bigint, piece bigint"))
    several = told.filter("piece > 0").select("file", "at").distinct()
    odd = told.filter("at IS NULL").union(told.join(several, ["file", "at"], "left_semi").select(told.columns))
    return bases, cut_lineage(odd)


def place() -> Column:
    """Where the record of a chunk begins in its file."""
    value = F.col("base") + F.col("start")
    return F.when(value == 0, 0).otherwise(value - len(VERSION)).cast("long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files at ``path``, cut by their stated lengths.

    (page_id, url, record_id, type, file, offset, whole, record): the page's id where the record's is one of
    ``records``, the place in the (unpacked) file, and the bytes of head and payload as a string.
    """
    text = F.col("value").cast("string")
    first = (F.col("block") == 0) & (F.col("start") == 0) & text.startswith(VERSION)
    body = F.when(first, F.expr(f"substring(value, {len(VERSION) + 1})")).otherwise(F.col("value"))
    cut = chunks(spark, path).select("file", "block", "start", F.octet_length("value").cast("long").alias("size"), body.alias("value"))
    head = F.substring_index(F.col("value").cast("string"), END, 1)
    # the version's last digit opens a record's chunk
    opens = head.rlike(r"\A[0-9]\r\n")
    length = F.expr("try_cast(n AS bigint)")
    found = (
        cut.select("file", "block", "start", "size", head.alias("h"), opens.alias("opens"))
        .withColumn("n", F.regexp_extract("h", r"(?i)\r\ncontent-length:[ \t]*([0-9]+)", 1))
        .select("file", "block", "start", "size", F.octet_length("h").cast("long").alias("head"), F.when(F.col("opens"), length).alias("stated"))
    )
    bases, odd = starts(found)
    parts = cut.select("file", "block", "start", "value")
    placed = parts.join(bases, ["file", "block"])
    single = placed.select("file", place().alias("at"), "value")
    if not odd.isEmpty():
        # records with the mark inside their payload are put together again
        piece = F.when(F.col("piece") == 0, F.col("value")).otherwise(F.concat(F.lit(MARK).cast("binary"), F.col("value")))
        joined = F.aggregate("p", F.lit("").cast("binary"), lambda s, x: F.concat(s, x["v"]))
        single = (
            placed.join(odd, ["file", "block", "start"], "left_anti")
            .select("file", place().alias("at"), "value")
            .union(
                parts.join(odd.filter("at IS NOT NULL"), ["file", "block", "start"])
                .groupBy("file", "at")
                .agg(F.array_sort(F.collect_list(F.struct("piece", piece.alias("v")))).alias("p"))
                .select("file", "at", joined.alias("value"))
            )
        )

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("h", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))

    size = F.octet_length("h") + len(END) + F.col("n")
    return (
        single.withColumn("h", head)
        .withColumn("n", F.regexp_extract("h", r"(?i)\r\ncontent-length:[ \t]*([0-9]+)", 1).cast("bigint"))
        .withColumn("record_id", field("warc-record-id"))
        .select(
            F.expr(r"try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') AS bigint)").alias("page_id"),
            field("warc-target-uri").alias("url"),
            "record_id",
            field("warc-type").alias("type"),
            "file",
            F.col("at").alias("offset"),
            (F.octet_length("value") >= size).alias("whole"),
            F.concat(
                F.lit(VERSION).cast("binary"),
                F.col("value").substr(F.lit(1), F.least(size, F.octet_length("value").cast("long")).cast("int")),
            ).cast("string").alias("record"),
        )
    )


def leaf_key() -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-"))), 256)


def shard_of(key: Column, leaves: int) -> Column:
    """The shard of a leaf's key when there are so many leaves."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % max(1, -(-leaves // SHARD_RECORDS))


def leaves(made: DataFrame) -> DataFrame:
    """(key, page_id, url, records, length, digest, at, end): one row for each id and address.

    ``at`` and ``end`` are where the records lie in the row of all files; null if ``made`` has no places.
    """
    digest = F.sha2(F.col("record"), 256)
    bytes_ = (F.octet_length("record") + len(END)).cast("long")
    known = {"file", "offset"} <= set(made.columns)
    each = made.select("page_id", "url", digest.alias("digest"), bytes_.alias("bytes"), *(["file", "offset"] if known else []))
    if known:
        each = cut_lineage(each)
        sizes = each.groupBy("file").agg(F.max(F.col("offset") + F.col("bytes")).alias("size"))
        # one row a file, as in the file listing that Spark's driver holds
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        bases = cut_lineage(sizes.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
        each = each.join(bases, "file").withColumn("at", F.col("base") + F.col("offset"))
    else:
        each = each.withColumn("at", F.lit(None).cast("long"))
    part = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)")
    several = F.sha2(F.concat_ws("|", "records", "low", "high", "total"), 256)
    return (
        each.groupBy("page_id", "url")
        .agg(
            F.count("*").alias("records"),
            F.sum("bytes").alias("length"),
            F.min("digest").alias("low"),
            F.max("digest").alias("high"),
            F.sum(part).alias("total"),
            F.min("at").alias("at"),
            F.max(F.col("at") + F.col("bytes")).alias("end"),
        )
        .select(
            leaf_key().alias("key"),
            "page_id",
            "url",
            "records",
            "length",
            F.when(F.col("records") == 1, F.col("low")).otherwise(several).alias("digest"),
            "at",
            "end",
        )
    )


def manifest(made: DataFrame) -> DataFrame:
    """The leaves in order: shard, ordinal, offset and length in bytes, digest."""
    found = cut_lineage(leaves(made).drop("at", "end"))
    order = Window.partitionBy("shard").orderBy("page_id", "url", "key")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return cut_lineage(
        found.select("*", shard_of(F.col("key"), found.count()).alias("shard"))
        .withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("offset", F.sum("length").over(upto) - F.col("length"))
    )


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of a (shard, at, bytes, digest) level: at most ``FANOUT`` ordered ranges a node."""
    children = F.array_sort(F.collect_list(F.struct("at", "bytes", "digest")))
    ranges = F.transform("c", lambda x: F.concat_ws(":", x["bytes"].cast("string"), x["digest"]))
    return (
        nodes.groupBy("shard", F.floor(F.col("at") / FANOUT).alias("at"))
        .agg(children.alias("c"), F.sum("bytes").alias("bytes"))
        .select("shard", "at", "bytes", F.sha2(F.concat_ws("|", ranges), 256).alias("digest"))
    )


def tree(positions: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves (shard, at, bytes, digest) to the shard roots; those above the leaves are written."""
    levels = [positions]
    for _ in range(height):
        levels.append(cut_lineage(parents(levels[-1])))
    return levels


def audit(listed: DataFrame, replica: DataFrame) -> DataFrame:
    """The manifest with ``status``: intact, damaged, moved or missing; and replica records not in it: extra.

    A record is moved if its content is right, but it doesn't begin where the record before it in the
    manifest, of those that the replica has, ends in the replica.
    """
    last = listed.agg(F.max("ordinal")).first()[0]
    height = 1
    while last is not None and FANOUT**height <= last:
        height += 1
    names = {"digest": "found", "page_id": "id2", "url": "url2", "records": "records2", "length": "length2"}
    copies = leaves(replica).withColumnsRenamed(names)
    # records that only the replica has take a window each
    before = (
        Window.partitionBy("shard", F.when(F.col("shard").isNull(), F.col("key")))
        .orderBy("ordinal")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = F.last("end", ignorenulls=True).over(before)
    step = F.coalesce(F.col("at") - F.col("ahead"), F.lit(0))
    span = F.coalesce(F.col("end") - F.col("at"), F.col("length2"))
    both = cut_lineage(
        listed.join(copies, "key", "full")
        .withColumn("ahead", ahead)
        .withColumn("ours", F.sha2(F.concat_ws("|", "digest", "length", "length", F.lit(0)), 256))
        .withColumn(
            "theirs",
            F.when(F.col("found").isNull(), F.lit("")).otherwise(F.sha2(F.concat_ws("|", "found", "length2", span, step), 256)),
        )
        .drop("ahead", "at", "end")
    )
    inside = both.filter("shard IS NOT NULL")
    at = F.col("ordinal").alias("at")
    ours = tree(inside.select("shard", at, F.col("length").alias("bytes"), F.col("ours").alias("digest")), height)
    theirs = tree(
        inside.select("shard", at, F.coalesce("length2", F.lit(0)).alias("bytes"), F.col("theirs").alias("digest")), height
    )

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select("shard", "at", F.col("digest").alias("other"))
        return a.join(other, ["shard", "at"]).filter("digest <> other").select("shard", "at")

    bad = differing(ours[height], theirs[height])
    for step in range(height - 1, 0, -1):
        below = [
            level.withColumn("up", F.floor(F.col("at") / FANOUT))
            .join(bad.select("shard", F.col("at").alias("up")), ["shard", "up"], "left_semi")
            .select("shard", "at", "digest")
            for level in (ours[step], theirs[step])
        ]
        bad = differing(*below)
    branch = bad.select("shard", F.col("at").alias("up"), F.lit(True).alias("inside"))
    status = (
        F.when(F.col("shard").isNull(), "extra")
        .when(F.col("bad") & F.col("found").isNull(), "missing")
        .when(F.col("bad") & (F.col("found") != F.col("digest")), "damaged")
        .when(F.col("bad"), "moved")
        .otherwise("intact")
    )
    # the leaves of one row are compared below differing branches only
    below = both.withColumn("up", F.floor(F.col("ordinal") / FANOUT)).join(branch, ["shard", "up"], "left")
    return below.withColumn("bad", F.col("inside") & (F.col("ours") != F.col("theirs"))).select(
        F.coalesce("page_id", "id2").alias("page_id"),
        F.coalesce("url", "url2").alias("url"),
        "shard",
        "ordinal",
        "offset",
        F.coalesce("length", "length2").alias("length"),
        F.coalesce("records", "records2").alias("records"),
        "digest",
        status.alias("status"),
    )


def mark(page_id: Column) -> Column:
    """Two hexadecimal characters that pick the pages of the audited replica's faults."""
    return F.coalesce(F.substring(F.md5(page_id.cast("string").cast("binary")), 1, 2), F.lit(""))


def aged(pages: DataFrame) -> DataFrame:
    """A replica to audit: about one page in 256 has lost its first character, another one is gone."""
    picked = mark(F.col("page_id"))
    html = F.when(picked == "00", F.expr("substring(html, 2)")).otherwise(F.col("html"))
    return pages.filter(picked != "01").select("page_id", "url", html.alias("html"))


def op5_merkle_fixity(spark, sf_dir: str) -> DataFrame:
    """The pages' manifest against WARC files of an aged replica, where one page in 256 lies behind its shard."""
    pages = table(spark, sf_dir, "pages")
    listed = manifest(records(pages))
    path = scratch_path(spark, "warc")
    shard = shard_of(leaf_key(), listed.count())
    write_warc(records(aged(pages)), path, shard, mark(F.col("page_id")) == "02", F.col("page_id"), F.col("url"))
    return audit(listed, read_warc(spark, path))


OP5_SQL = r"""
WITH r AS (
  SELECT page_id, url, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
         || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
         || html AS record
  FROM pages),
l AS (
  SELECT page_id, url, mark, sha256(record) AS digest, CAST(strlen(record) + 4 AS BIGINT) AS length,
         CAST('0x' || substr(sha256(CAST(page_id AS VARCHAR) || '|' || url), 1, 8) AS BIGINT)
         % (SELECT greatest(1, CAST(ceil(count(*) / 2048.0) AS BIGINT)) FROM pages) AS shard
  FROM r),
p AS (
  SELECT *, row_number() OVER w - 1 AS ordinal,
         CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM l WINDOW w AS (PARTITION BY shard ORDER BY page_id, url)),
kept AS (
  SELECT shard, ordinal, lag(ordinal) OVER (PARTITION BY shard ORDER BY ordinal) AS before,
         lag(ordinal) OVER (PARTITION BY shard ORDER BY mark = '02', ordinal) AS ahead
  FROM p WHERE mark <> '01')
SELECT page_id, url, shard, ordinal, "offset", length, CAST(1 AS BIGINT) AS records, digest,
       CASE WHEN mark = '00' THEN 'damaged' WHEN mark = '01' THEN 'missing'
            WHEN before IS NOT NULL AND before IS DISTINCT FROM ahead THEN 'moved' ELSE 'intact' END AS status
FROM p LEFT JOIN kept USING (shard, ordinal)
"""
