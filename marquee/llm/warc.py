"""WARC archives with a two-level capture index.

Pages become WARC 1.1 records. Pages with equal payloads of at least `LEAST` bytes are stored once, as a response; the
others are revisits that refer to it. The archives are plain .warc files written by Spark's text writer: a record is a
row, and the row separator is the blank lines that end a record. So they can be in any store that Spark writes to.

The index lists all captures, sorted by their URL keys with the host reversed. Sorted lines are packed into compressed
blocks; a sparse directory holds the first key of every block. A lookup searches the directory by bisection, opens the
block, and reads the record's byte range. The directory never has more than `MOST_BLOCKS` entries, as blocks grow with
the number of captures, so it is small enough to be sent to every task.

Defined results: a null payload is empty. Of equal payloads the smallest page id is the response; rows without an id
come last and never are referred to. Repeated rows are records each, and where they have the smallest id, responses each. A null URL is the empty
key. Line breaks and other control characters of a URL are percent-encoded in the header. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import durable
from marquee.scale import shared_folder

#: Bytes from which equal payloads are stored once.
LEAST = 100
#: Bytes of an archive, captures of a block, and blocks of the directory.
ARCHIVE, BLOCK, MOST_BLOCKS = 16_000_000, 2000, 100_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
CAPTURE = ("key string, page_id bigint, archive string, offset bigint, length bigint, type string, digest string, bytes bigint, "
           "refers_to bigint, refers_key string")
NAMES = [column.split(" ")[0] for column in CAPTURE.split(", ")]


def url_key(url: Column) -> Column:
    """Reversed host, then port, path and query, in lower case: org,example)/path?query. Scheme, user, www. and fragment go."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$|[\x00-\x20\x7f]", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*", 0), r"^[^@]*@", ""), r"^www\d*\.", "")
    name, port = F.regexp_extract(host, r"^([^:]*)", 1), F.regexp_extract(host, r":(\d+)$", 1)
    path = F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""),
                    F.lit(")"), F.when(path == "", "/").otherwise(path))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for every row of `pages` to .warc files in a new folder."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload"), "key": url_key(F.col("url"))})
    narrow = durable(rows.drop("payload", "url"))
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "key")).alias("first")
    shared = durable(narrow.filter(F.col("size") >= LEAST).groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1")
                     .select("digest", F.col("first.page_id").alias("of"), F.col("first.key").alias("of_key")))
    uri = F.regexp_replace(F.regexp_replace("url", "[\r\n]", ""), r"[\x00-\x20\x7f]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    again = F.col("of").isNotNull() & ~F.col("of").eqNullSafe(F.col("page_id"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.uuid(), F.lit(">"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Page-ID", page), line("X-URL-Key", F.col("key")),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("X-Refers-To-Page", F.col("of").cast("string")), line("X-Refers-To-Key", F.col("of_key")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, 0).otherwise(F.col("size")).cast("string")), F.lit("\r\n"))
    records = rows.join(shared, "digest", "left").select(F.concat(
        header.cast("binary"), F.when(again, F.lit("").cast("binary")).otherwise(F.col("payload"))).cast("string").alias("value"))
    mean = narrow.agg(F.avg("size")).first()[0] or 0
    (records.write.option("lineSep", END).option("compression", "none")
     .option("maxRecordsPerFile", max(1, int(ARCHIVE / (mean + 500)))).text(folder))


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def _parsed(content: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """(header fields, start and end of the payload) of the record at an offset."""
    if content[at: at + 10] != b"WARC/1.1\r\n":
        raise ValueError(f"no record at byte {at}")
    at, fields = at + 10, {}
    while content[at: at + 2] != b"\r\n":
        found = HEADER.match(content, at)
        fields[found[1].decode()] = found[2].decode()
        at = found.end()
    return fields, at + 2, at + 2 + int(fields["Content-Length"])


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def build_index(spark: SparkSession, folder: str, index: str) -> None:
    """Reads the archives through and writes the sorted blocks, one row each, below `index`."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                at, out = 0, []
                while at < len(content):
                    fields, start, end = _parsed(content, at)
                    found = hashlib.sha256(content[start:end]).hexdigest()
                    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha256:{found}":
                        raise ValueError(f"the record at byte {at} of {path} is damaged")
                    out.append((fields["X-URL-Key"], _number(fields["X-Page-ID"]), path, at, end - at, fields["WARC-Type"],
                                fields["WARC-Payload-Digest"][7:], end - start, _number(fields.get("X-Refers-To-Page")),
                                fields.get("X-Refers-To-Key")))
                    at = end + len(END)
                yield _captures(out)

    captures = durable(_files(spark, folder).mapInPandas(scan, CAPTURE))
    lines = max(BLOCK, -(-captures.count() // MOST_BLOCKS))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= lines:
                rows = pd.concat(held)
                whole = len(rows) // lines * lines
                yield blocks(rows.iloc[:whole])
                held = [rows.iloc[whole:]]
        if held and sum(map(len, held)):
            yield blocks(pd.concat(held))

    def blocks(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [rows.iloc[a: a + lines] for a in range(0, len(rows), lines)]
        return pd.DataFrame({"first": [p["key"].iat[0] for p in parts], "last": [p["key"].iat[-1] for p in parts], "n": [len(p) for p in parts],
                             "packed": [zlib.compress(p.to_json(orient="values").encode(), 6) for p in parts]})

    ranged = captures.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    ranged.mapInPandas(pack, "first string, last string, n bigint, packed binary").withColumn(
        "block", F.monotonically_increasing_id()).write.parquet(index)


def _captures(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=NAMES, dtype=object)
    return frame.astype({c: "Int64" for c in ("page_id", "offset", "length", "bytes", "refers_to")})


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def _opened(packed: bytes) -> list[list]:
    return json.loads(zlib.decompress(packed))


def all_captures(spark: SparkSession, index: str) -> DataFrame:
    """Every line of the index."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for packed in batch["packed"]:
                yield _captures(_opened(packed))

    return spark.read.parquet(index).select("packed").mapInPandas(run, CAPTURE)


def look_up(keys: DataFrame, index: str) -> DataFrame:
    """The captures of every distinct key: bisection in the directory, then in the blocks it names."""
    spark = keys.sparkSession
    directory = sorted((r["first"], r["last"], r["block"]) for r in spark.read.parquet(index).select("first", "last", "block").collect())
    shared = spark.sparkContext.broadcast((*([d[i] for d in directory] for i in (0, 1)), np.array([d[2] for d in directory], np.int64)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts, blocks = shared.value
        for batch in batches:
            out = []
            for key in batch["wanted"]:
                for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    out.append((int(blocks[i]), key))
            yield pd.DataFrame(out, columns=["block", "wanted"])

    wanted = keys.select(F.col(keys.columns[0]).alias("wanted")).filter("wanted is not null").distinct()
    asked = wanted.mapInPandas(find, "block bigint, wanted string")

    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stored):
            return _captures([])
        lines, out = _opened(stored["packed"].iat[0]), []
        listed = [line[0] for line in lines]
        for key in asked["wanted"]:
            out.extend(lines[bisect_left(listed, key): bisect_right(listed, key)])
        return _captures(out)

    return asked.groupBy("block").cogroup(spark.read.parquet(index).select("block", "packed").groupBy("block")).applyInPandas(search, CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The captures with the payload of each, read from its byte range; each archive that is named is opened once.

    An archive holds a bounded number of records, and so does its list of ranges.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, ranges in zip(batch["content"], batch["ranges"]):
                frame = pd.DataFrame([tuple(r[c] for c in NAMES) for r in ranges], columns=NAMES, dtype=object)
                spans = [_parsed(content[a: a + n], 0)[1:] for a, n in zip(frame["offset"], frame["length"])]
                frame["payload"] = [content[a + start: a + end] for a, (start, end) in zip(frame["offset"], spans)]
                yield frame.astype({c: "Int64" for c in ("page_id", "offset", "length", "bytes", "refers_to")})

    ranges = captures.groupBy("archive").agg(F.collect_list(F.struct(*captures.columns)).alias("ranges"))
    files = _files(captures.sparkSession, folder).withColumnRenamed("path", "archive")
    return files.join(ranges, "archive").select("content", "ranges").mapInPandas(run, f"{CAPTURE}, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row, from the archives read back.

    What a revisit stands for is looked up in the index by the key that it refers to, and read there.
    """
    spark = pages.sparkSession
    folder, index = shared_folder(spark), shared_folder(spark)
    write_archives(pages, folder, id_col, url_col, payload_col)
    build_index(spark, folder, index)
    captures = all_captures(spark, index)
    revisits = captures.filter("type = 'revisit'")
    wanted = durable(revisits.select("refers_to", "refers_key").distinct())
    targets = look_up(wanted.select("refers_key"), index).filter("type = 'response'").join(
        wanted.select(F.col("refers_to").alias("page_id"), F.col("refers_key").alias("key")), ["page_id", "key"], "left_semi")
    originals = durable(read_records(durable(targets), folder).groupBy(F.col("page_id").alias("refers_to"), F.sha2("payload", 256).alias("digest")).agg(
        F.max(F.octet_length("payload")).cast("bigint").alias("bytes")))
    columns = [F.col("page_id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
               F.col("type").alias("record_type"), "refers_to"]
    return captures.filter("type = 'response'").select(*columns).unionByName(
        revisits.drop("bytes").join(originals, ["refers_to", "digest"]).select(*columns))
