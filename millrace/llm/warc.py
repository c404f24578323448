"""Content-addressed WARC archive (operator 8).

`write_archive` keeps two tables below one path: `payloads` has the bytes of
each distinct payload once, under its SHA-256; `headers` has the exact header
block of every record and the digest it points at.  `read_archive` joins them
into whole records, recomputes each stored payload's digest and parses the
header blocks; nothing is taken from the source.

Payloads travel once.  Digests are computed where the pages are read, the
owner of a digest is found on (digest, id) rows alone, and only owners' bytes
are written.

Records of equal payloads of at least `least_bytes` bytes: the one with the
smallest id is a response, the others are revisits that refer to it.  Smaller
payloads are always responses (and are stored once all the same).

Defined results: a null payload is empty; a null url is written as an empty
target; a null id is written as an empty record id, is never referred to, and
its record is a response; rows with the same id are records of their own, and
all rows of an owning id are responses.  Line breaks in a url are percent-encoded, so that a header
stays one line.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BREAK = "\r\n"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    url = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 100,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write the archive of pages below `path` (a folder that all executors share)."""
    spark = pages.sparkSession
    records = _records(pages, id_col, url_col, payload_col)
    with Scratch(spark) as scratch:
        facts = scratch.write(records.drop("payload"), "facts")
        # one owner for each digest; only digests that occur twice need a lookup
        owners = facts.groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("n"))
        owners = scratch.write(owners.where("n > 1").drop("n"), "owners")
        linked = facts.join(owners, "digest", "left")
        revisit = F.coalesce((F.col("size") >= least_bytes) & (F.col("id") != F.col("owner")), F.lit(False))
        name = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">")), F.lit(""))
        header = F.concat(
            F.lit(f"WARC/1.1{BREAK}"),
            _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            _field("WARC-Record-ID", name),
            _field("WARC-Date", F.lit(date)),
            _field("WARC-Target-URI", F.col("url")),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(
                revisit,
                F.concat(
                    _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    _field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">"))),
                ),
            ).otherwise(F.lit("")),
            _field("Content-Type", F.lit("text/html")),
            _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        )
        linked.select("digest", header.alias("header")).write.parquet(f"{path}/headers")
        # the bytes of digests that one row has, and of the others those of one row of the owner
        rows = records.select("id", "digest", "payload").join(owners.withColumn("twice", F.lit(True)), "digest", "left")
        single = rows.where("twice is null").select("digest", "payload")
        several = rows.where("twice and id <=> owner").dropDuplicates(["digest"]).select("digest", "payload")
        single.unionByName(several).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records as they were: header, payload (a revisit has that of the record it
    refers to), digest, verified (the stored bytes have their digest)."""
    payloads = spark.read.parquet(f"{path}/payloads")
    payloads = payloads.select("digest", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("verified"))
    return spark.read.parquet(f"{path}/headers").join(payloads, "digest", "left")


def record_bytes(records: DataFrame) -> DataFrame:
    """The WARC record of each row: header block, empty line, block, two line breaks."""
    block = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit(BREAK).cast("binary")
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), end, block, end, end))


def header_field(name: str) -> Column:
    """A field of the header block; null if it has none."""
    found = F.regexp_extract("header", f"\\r\\n{name}: ([^\\r\\n]*)", 1)
    return F.when(F.contains("header", F.lit(f"{BREAK}{name}: ")), found)
