"""A content-addressed web archive.

``write`` keeps two tables in the shared folder:

* ``payloads`` (digest, payload): the bytes of every different payload, once, by
  their SHA-256.  That equal digests mean equal bytes is verified on the way by a
  second hash and the length of all copies; a clash ends the job.
* ``records`` (page_id, header, digest): the exact header of each WARC record.

The first page (least id) of a payload of ``least`` bytes or more is a response,
later ones are revisits that refer to it; smaller payloads are responses always.
``read`` goes through both tables, hashes the stored bytes again and joins them
by digest; ``records`` puts the original records together byte by byte, and
``rebuilt`` parses those bytes: a record's block must have the length and the digest
that its header names, a revisit takes them from the rebuilt record it refers to.

Skew: first pages come from a map-side combined minimum; the joins of headers
with first pages or payloads are between two shuffled tables, so a digest with a
third of all pages is split; payload bytes are shuffled once, after each task has
dropped its own copies.

Defined results: a null payload is an empty one; pages equal in id and payload
are all responses if that id is the least; a null id is later than any other; a
null url is empty; line ends in a url are percent-encoded; extra columns are not
stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import written

LEAST = 100
END = "\r\n"


def header(kind: Column, page: Column, url: Column, digest: Column, size: Column, first: Column, date: str) -> Column:
    """The header block of a record, without the empty line after it."""
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(END))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{END}"), field("WARC-Type", kind), field("WARC-Record-ID", name(page)), field("WARC-Target-URI", uri),
        field("WARC-Date", F.lit(date)), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            field("WARC-Refers-To", name(first)))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")))


def write(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html",
          least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes the archive of ``pages`` and returns its folder."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"llm-archive-{uuid.uuid4().hex}")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"),
                F.xxhash64("payload").alias("check")).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    same = index.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"), F.max("size").alias("size2"),
        F.min("check").alias("check"), F.max("check").alias("check2"))
    clash = same.where((F.col("size") != F.col("size2")) | (F.col("check") != F.col("check2"))).select("digest").first()
    if clash:
        raise ValueError(f"payloads with digest {clash[0]} differ")
    firsts = same.where((F.col("copies") > 1) & (F.col("size") >= least)).select(F.col("digest").alias("d2"), "first")
    both = index.join(firsts, F.col("digest") == F.col("d2"), "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    kind = F.when(again, "revisit").otherwise("response")
    both.select("page_id", header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), F.col("first"), date).alias(
        "header"), "digest").write.parquet(f"{path}/records")
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    return path


def _field(name: str, pattern: str) -> Column:
    """A header field's value (null without one)."""
    found = F.regexp_extract("header", rf"(?s)\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, payload_bytes, payload_digest, record_type, refers_to) of all
    records; the stored bytes are hashed again and must agree with the header."""
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.col("digest").alias("d2"), F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"))
    both = spark.read.parquet(f"{path}/records").join(stored, F.col("digest") == F.col("d2"), "left")
    named = _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})")
    checked = F.when(named == F.col("payload_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.coalesce(named, F.lit("")))).cast("string"))
    return both.select("page_id", "header", "payload_bytes", checked.alias("payload_digest"),
                       _field("WARC-Type", "([a-z]+)").alias("record_type"),
                       _field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers_to"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): every original record, header and block, byte by byte."""
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("d2"), "payload")
    both = spark.read.parquet(f"{path}/records").join(stored, F.col("digest") == F.col("d2"), "left")
    block = F.when(_field("WARC-Type", "([a-z]+)") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return both.select("page_id", F.concat(F.concat("header", F.lit(END)).cast("binary"), block, F.lit(END * 2).cast("binary")).alias("record"))


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records, read
    from the rebuilt bytes alone.  A block of another length or digest than its header
    says, or a reference to no such response, ends the job."""
    made = records(spark, path)
    head = F.concat(F.substring_index(F.col("record").cast("string"), END * 2, 1), F.lit(END))
    made = made.withColumn("header", head).withColumn("start", F.octet_length("header") + len(END))
    size = F.octet_length("record") - F.col("start") - 2 * len(END)
    block = made.select("page_id", "header", F.substring("record", F.col("start") + 1, size).alias("block"))
    facts = block.select(
        "page_id", _field("WARC-Type", "([a-z]+)").alias("record_type"), _field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("named"),
        F.regexp_extract("header", r"\r\nContent-Length: ([0-9]+)\r\n", 1).cast("long").alias("length"),
        F.octet_length("block").cast("long").alias("payload_bytes"), F.sha2("block", 256).alias("payload_digest"))
    sound = (F.col("length") == F.col("payload_bytes")) & ((F.col("record_type") == "revisit") | (F.col("named") == F.col("payload_digest")))
    wrong = lambda what: F.raise_error(F.concat(F.lit(what), F.coalesce(F.col("named"), F.lit("")))).cast("string")
    facts = written(facts.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(
        wrong("rebuilt block differs from its header, payload "))), "warc-facts")
    first = facts.where("record_type = 'response'").groupBy(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), F.col("named").alias("digest")).agg(
        F.min("payload_bytes").alias("bytes2"), F.min("payload_digest").alias("digest2"))
    again = facts.where("record_type = 'revisit'").join(
        first, (F.col("refers_to") == F.col("page")) & (F.col("named") == F.col("digest")), "left")
    again = again.select("page_id", F.col("bytes2").alias("payload_bytes"), F.coalesce("digest2", wrong(
        "a revisit refers to no response with payload ")).alias("payload_digest"), "record_type", "refers_to")
    return facts.where("record_type = 'response'").select(again.columns).unionByName(again)
