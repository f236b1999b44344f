"""WARC: records, files, and a Merkle audit that finds where two replicas differ.

A leaf is the SHA-256 of a record's bytes, at (file, offset). Leaves are grouped by fixed offset ranges of a file and each
range's hash covers its leaves in offset order; ranges are grouped sixteen by sixteen up to one root a file. Two replicas are
compared root by root, and only the branches that differ are followed down, level by level, to the records. A range holds at
most RANGE bytes of record starts, a node at most sixteen ranges, so no group grows with the data, whatever one host or file holds.

A record is known by its place alone, so null and repeated ids are audited like any other. Records of one range of ids make a file;
a range of more than FULL records (null ids, or an id that is repeated) is spread over as many files as keep each below that.
Null pages are records with an empty body. Repeated rows are records of their own, at their own offsets. An empty replica
reports every record of the other as missing or extra.

Files are read by Content-Length, plain or compressed record by record, with bodies of any bytes: what looks like a record inside a body is body.
Bytes that aren't a record come out as one without headers, up to the next version line.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read

RANGE = 1 << 16  # bytes of a file under one lowest node
FAN = 16
LEVELS = 4  # 64 KB * 16^4: files of up to 4 GB below the root
PAGES_PER_FILE = 500
FULL = 2000  # records beyond which a range of ids gets more files
CHUNK = 1 << 20  # bytes of a file that are handed on at a time
BREAK = "\r\n"


def record(uri: Column, body: Column, kind: str = "resource", date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC/1.0 record as text; its bytes are the text's UTF-8."""
    body, uri = F.coalesce(body, F.lit("")), F.coalesce(uri, F.lit(""))
    head = f"WARC/1.0{BREAK}WARC-Type: {kind}{BREAK}WARC-Date: {date}{BREAK}WARC-Record-ID: <urn:sha256:"
    return F.concat(
        F.lit(head), F.sha2(F.concat(uri, F.lit("\n"), body), 256), F.lit(f">{BREAK}WARC-Target-URI: "), uri,
        F.lit(f"{BREAK}Content-Type: text/html{BREAK}Content-Length: "), F.octet_length(body).cast("string"), F.lit(BREAK + BREAK), body, F.lit(BREAK + BREAK),
    )


def lay_out(records: DataFrame, file: Column, order: list[str], record_col: str = "record") -> DataFrame:
    """The input's columns with file, offset and length: where each record stands. Files must be of bounded size."""
    out = records.withColumns({"file": file, "length": F.octet_length(record_col).cast("long")})
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("offset", F.sum("length").over(before) - F.col("length"))


def page_records(pages: DataFrame, replica_html: Column | None = None, per_file: int = PAGES_PER_FILE, full: int = FULL) -> DataFrame:
    """page_id, file, offset, length, sha256 (and other, that of the record with replica_html) of each page's record, written once.

    Only digests are moved, not the records. Counts of the ranges of ids are added up before they meet the rows.
    """
    scratch = Scratch(pages.sparkSession, "records")
    text = record(F.col("url"), F.col("html"))
    other = [] if replica_html is None else [F.sha2(record(F.col("url"), replica_html), 256).alias("other")]
    span = F.when(F.col("page_id").isNull(), "part-null").otherwise(F.format_string("part-%08d", F.floor(F.col("page_id") / per_file).cast("long")))
    rows = pages.select("page_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("length"), span.alias("span"), F.monotonically_increasing_id().alias("n"), *other)
    rows = scratch.table(rows, "rows")
    large = rows.groupBy("span").agg(F.count("*").alias("c")).where(F.col("c") > full).select("span", F.ceil(F.col("c") / full).alias("files"))
    part = F.pmod(F.xxhash64("n"), F.col("files"))
    file = F.when(F.coalesce(part, F.lit(0)) == 0, F.concat("span", F.lit(".warc"))).otherwise(F.concat("span", F.format_string("-%04d.warc", part)))
    before = Window.partitionBy("file").orderBy("page_id", "sha256", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(large, "span", "left").withColumn("file", file).withColumn("offset", F.sum("length").over(before) - F.col("length"))
    out = scratch.table(rows.select("page_id", "file", "offset", "length", "sha256", *["other"] * len(other)), "records")
    scratch.drop("rows")
    return out


def write_files(records: DataFrame, path: str, record_col: str = "record") -> None:
    """Uncompressed WARC files of text records, one for each partition, in the partition's order."""
    # A record ends in a line feed, which the writer puts behind each row.
    records.select(F.substring(F.col(record_col), F.lit(1), F.length(record_col) - 1).alias("value")).write.option("lineSep", "\n").text(path)


class Reader:
    """Records of one file, from its bytes in any chunks: (offset, length, headers or None, body)."""

    def __init__(self):
        self.held, self.at, self.unzip, self.zipped = b"", 0, None, None

    def feed(self, data: bytes, last: bool = False):
        if self.zipped is None and data:
            self.zipped = data[:2] == b"\x1f\x8b"
        if self.zipped:
            data = b"".join(self._plain(data))
        self.held += data
        p = 0
        while (found := self._record(p, last)) is not None:
            n, headers, body = found
            yield self.at + p, n, headers, body
            p += n
        self.held, self.at = self.held[p:], self.at + p

    def _plain(self, data: bytes):
        while data:  # one member after the other
            if self.unzip is None:
                self.unzip = zlib.decompressobj(31)
            yield self.unzip.decompress(data)
            data = self.unzip.unused_data if self.unzip.eof else b""
            if self.unzip.eof:
                self.unzip = None

    def _record(self, p: int, last: bool) -> tuple[int, dict | None, bytes] | None:
        """(length, headers, body) of what starts at p; None: nothing, or more bytes are needed."""
        if p == len(self.held):
            return None
        head = self.held.find(b"\r\n\r\n", p)
        if self.held.startswith(b"WARC/", p) and head >= 0:
            headers = fields(self.held[p:head].decode("utf-8", "replace"))
            length = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
            if length.isdigit():
                end = head + 4 + int(length)
                if end + 4 <= len(self.held) and self.held.startswith(b"\r\n\r\n", end):
                    return end + 4 - p, headers, self.held[head + 4 : end]
                if end + 4 > len(self.held) and not last:
                    return None
                if end == len(self.held):  # the last one, without its closing lines
                    return end - p, headers, self.held[head + 4 : end]
        elif not last and (head < 0 and self.held.startswith(b"WARC/", p) or len(self.held) - p < 5):
            return None
        # Not a record, or one of another length than it says: all up to the next version line.
        m = re.compile(rb"\r\nWARC/1\.[01]\r\n").search(self.held, p + 1)
        if m:
            return m.start() + 2 - p, None, self.held[p : m.start() + 2]
        return (len(self.held) - p, None, self.held[p:]) if last else None


def fields(head: str) -> dict[str, str]:
    """The header lines of a record; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            out[name] = value.strip()
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, headers (null: not a record), uri, body (binary), read by Content-Length, a file in a task.

    A file's bytes go to Python in chunks and its records leave one by one; files are at most 2 GB, as Spark's binary source has it.
    """
    whole = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content", "length")
    chunks = whole.select("path", "content", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(CHUNK).cast("long"))).alias("k", "start"), "length")
    rows = chunks.select("path", F.substring(F.col("content"), (F.col("start") + 1).cast("int"), F.lit(CHUNK)).alias("bytes"), (F.col("start") + CHUNK >= F.col("length")).alias("last"))
    kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])

    def run(batches):
        reader, out, size = Reader(), [], 0
        for b in batches:
            for path, data, last in zip(b.column("path").to_pylist(), b.column("bytes"), b.column("last").to_pylist(), strict=True):
                for at, n, headers, body in reader.feed(data.as_py(), last):
                    out.append((path, at, n, list(headers.items()) if headers is not None else None, body))
                    size += n
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                        out, size = [], 0
                if last:
                    reader = Reader()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    out = rows.mapInArrow(run, "file string, offset long, length long, headers map<string,string>, body binary")
    return out.select("file", "offset", "length", "headers", F.col("headers")["WARC-Target-URI"].alias("uri"), "body")


def parse(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The input's columns with uri, headers (map) and body, for records of text. Columns of these names are replaced."""
    head = F.substring_index(record_col, BREAK + BREAK, 1)
    lines = F.filter(F.split(head, BREAK), lambda x, i: (i > 0) & (F.instr(x, ":") > 0))
    entries = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    # Of a repeated header the last line counts.
    headers = F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["k"] == e["k"])))
    body = F.substring(F.col(record_col), F.length(head) + 5, F.length(record_col) - F.length(head) - 8)
    return records.withColumns({"headers": headers, "body": body}).withColumn("uri", F.col("headers")["WARC-Target-URI"])


# --- audit -------------------------------------------------------------------------------------------------------


def _node(child_key: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(F.col(child_key).alias("k"), F.col("hash").alias("h"))))
    return F.sha2(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["k"].cast("string"), x["h"])), "\n"), 256)


def tree(leaves: DataFrame, levels: int = LEVELS, span: int = RANGE, fan: int = FAN) -> list[DataFrame]:
    """[(file, r0, hash), (file, r1, hash), ..., (file, root hash)] from leaves (file, offset, length, sha256)."""
    level = leaves.select("file", "offset", F.floor(F.col("offset") / span).cast("long").alias("r0"), F.concat_ws("/", F.col("length").cast("string"), "sha256").alias("hash"))
    level = level.groupBy("file", "r0").agg(_node("offset").alias("hash"))
    out = [level]
    for k in range(1, levels):
        level = level.withColumn(f"r{k}", F.floor(F.col(f"r{k - 1}") / fan).cast("long")).groupBy("file", f"r{k}").agg(_node(f"r{k - 1}").alias("hash"))
        out.append(level)
    return [*out, level.groupBy("file").agg(_node(f"r{levels - 1}").alias("hash"))]


def audit(a: DataFrame, b: DataFrame, span: int = RANGE, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(file, offset, length, status) of every record that differs: corrupt, missing (from b) or extra (in b).

    a, b: (file, offset, length, sha256), with file and offset as a key. Tree levels are written once for each replica.
    """
    scratch = Scratch(a.sparkSession, "merkle")
    leaves = [scratch.table(x.select("file", "offset", "length", "sha256"), f"leaves-{i}") for i, x in enumerate((a, b))]
    trees = []
    for i, x in enumerate(leaves):
        nodes = []
        for k, level in enumerate(tree(x, levels, span, fan)):
            if k < levels:
                level = scratch.table(level, f"level-{i}-{k}")
                # The next level is made from the written one.
            nodes.append(level)
        trees.append(nodes)

    def differing(x: DataFrame, y: DataFrame, key: list[str]) -> DataFrame:
        y = y.withColumnRenamed("hash", "other")
        return x.join(y, key, "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select(*key)

    bad = scratch.table(differing(trees[0][levels], trees[1][levels], ["file"]), "bad-root")
    key = ["file"]
    for k in range(levels - 1, -1, -1):
        up = (lambda x, k=k: x.withColumn(f"r{k + 1}", F.floor(F.col(f"r{k}") / fan).cast("long"))) if k < levels - 1 else (lambda x: x)
        x, y = (up(t[k]).join(bad, key, "left_semi").select("file", f"r{k}", "hash") for t in trees)
        key = ["file", f"r{k}"]
        bad = scratch.table(differing(x, y, key), f"bad-{k}")
    x, y = (t.withColumn("r0", F.floor(F.col("offset") / span).cast("long")).join(bad, key, "left_semi") for t in leaves)
    y = y.select("file", "offset", F.col("length").alias("length_b"), F.col("sha256").alias("sha256_b"))
    found = x.select("file", "offset", "length", "sha256").join(y, ["file", "offset"], "full")
    status = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("sha256") != F.col("sha256_b")) | (F.col("length") != F.col("length_b")), "corrupt")
    found = found.withColumn("status", status).where(F.col("status").isNotNull()).select("file", "offset", F.coalesce("length", "length_b").alias("length"), "status", "sha256", "sha256_b")
    found = scratch.table(found, "found")
    scratch.drop(*(f"leaves-{i}" for i in (0, 1)), *(f"level-{i}-{k}" for i in (0, 1) for k in range(levels)), *(f"bad-{k}" for k in range(levels)), "bad-root")
    return found


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages against a replica in which every 97th body has its first character changed and every 101st record is gone.

    Both digests of a record are taken from the same row, so that the replica needs no join by id.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    changed = F.when((F.col("page_id") % 97 == 13) & (F.length("html") > 0), F.concat(F.lit("#"), F.substring(F.col("html"), 2, 1 << 30))).otherwise(F.col("html"))
    good = page_records(pages, changed)
    replica = good.where(F.coalesce(F.col("page_id") % 101 != 7, F.lit(True))).select("file", "offset", "length", F.col("other").alias("sha256"))
    found = audit(good, replica)
    return found.join(good.select("file", "offset", "page_id"), ["file", "offset"]).select("page_id", "file", "offset", "length", "status", F.col("sha256"))
