"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing. A record is a header block and a body; the blank line after it is the writer's line
separator, so records go to any file system Spark writes to. Equal payloads are found on digests; the
row of smallest page_id is the response, all others are revisit records, made from narrow columns.

Reading. The archive is read by splits, cut at every occurrence of the record magic. A magic may also
stand inside a payload, so each occurrence is only a candidate; its declared length gives the offset
of its successor. Candidates that a chain from the file's start does not reach are payload. Chains
inside a split are contracted in one pass over its candidates; between splits, pointer jumping
doubles the reach of every pointer per round. Only narrow columns are shuffled; the fragments of a record
that holds a magic are read again, found by the SHA-256 of their bytes (the splits of a second read may
differ), and put together by their offsets.

Cases: null html is an empty payload; a null page_id sorts last and makes refers_to null; of rows
equal in all columns one can be the response, each other one is a revisit; control characters and
spaces in a url are percent-encoded, a null url has no target header; empty tables write no record;
other columns are not read.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, table
from ledgerloom.plans.ordered import Scan, scan
from ledgerloom.plans.session import ensure_checkpoint_dir

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 0


def base32_sha1(binary: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four base-32 digits."""
    hexa = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: str, digest: str, tie: str, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(":"), F.col(digest), F.lit(":"), F.hex(F.col(tie)), F.lit(":"), copy.cast("string"), F.lit(">"))


def _record(kind: str, copy: Column, payload: Column | None, refers: Column | None) -> Column:
    """One record as text, without the blank line after it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(BLANK))
    body = F.concat(http, payload) if payload is not None else http
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20]", "%20")
    lines = [
        F.lit(f"{MAGIC}WARC-Type: {kind}\r\nWARC-Record-ID: "), _record_id("page_id", "digest", "tie", copy),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"), F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), clean, F.lit("\r\n"))),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        *([F.lit("\r\nWARC-Refers-To: "), refers, F.lit(f"\r\nWARC-Profile: {PROFILE}")] if refers is not None else []),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK), body,
    ]
    return F.concat(*lines).alias("value")


def write_warc(pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES) -> None:
    """Write one record per row of `pages` (page_id, url, html) into a new folder."""
    html = F.coalesce("html", F.lit(""))
    full = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"),
        base32_sha1(html.cast("binary")).alias("digest"), F.xxhash64("page_id", "url").alias("tie"),
    )
    narrow = cut_lineage(full.drop("html"))
    rank = F.struct(F.col("page_id").isNull().alias("z"), "page_id", "tie")
    key = narrow.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "page_id", "tie").agg(F.count("*").alias("copies"))
    shared = cut_lineage(
        key.groupBy("digest")
        .agg(F.sum("copies").alias("n"), F.min_by(F.struct("page_id", "tie", "copies"), rank).alias("first"))
        .filter("n > 1")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.tie").alias("first_tie"), F.col("first.copies").alias("first_copies"))
    )
    # whole records: payloads of their own, and the first of each shared payload
    is_first = F.col("tie") == F.col("first_tie")
    known = full.join(shared, "digest", "left")
    whole = known.filter(F.col("first_copies").isNull() | (is_first & (F.col("first_copies") == 1)))
    parts = [whole.select(_record("response", F.lit(0), F.col("html"), None))]
    if shared.head(1):
        repeated = shared.filter("first_copies > 1")
        if repeated.head(1):
            one = full.join(repeated, "digest").filter(is_first).groupBy("digest", "tie").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("payload_bytes").alias("payload_bytes"), F.first("html").alias("html"))
            parts.append(one.select(_record("response", F.lit(0), F.col("html"), None)))
        rows = narrow.join(shared, "digest").groupBy("digest", "page_id", "url", "tie", "payload_bytes", "first_id", "first_tie").agg(F.count("*").alias("copies"))
        start = F.when(is_first, 1).otherwise(0)
        again = rows.withColumn("last", F.col("copies").cast("int") - 1).filter(F.col("last") >= start).withColumn("copy", F.explode(F.sequence(start, F.col("last"))))
        parts.append(again.select(_record("revisit", F.col("copy"), None, _record_id("first_id", "digest", "first_tie", F.lit(0)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.option("lineSep", BLANK).text(path)


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a record from the bytes after its magic; payload columns suppose that they are all there."""
    head = F.substring_index(value, BLANK, 1)
    after = F.octet_length(head) + 4
    length = F.regexp_extract(head, r"(?:^|\r\n)Content-Length: *(\d+)", 1)
    size = F.when(length != "", length.cast("bigint")).otherwise(0)
    raw = value.cast("binary")
    body = raw.substr((after + 1).cast("int"), F.octet_length(raw))
    http = F.substring_index(body.cast("string"), BLANK, 1)
    skip = F.octet_length(http) + 4
    payload = body.substr((skip + 1).cast("int"), F.greatest(F.lit(0), size - skip).cast("int"))
    field = lambda name: F.regexp_extract(head, rf"(?:^|\r\n){name}: *([^\r\n]*)", 1)
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+):", 1)
    number = lambda c: F.when(c != "", c.cast("bigint"))
    kind = field("WARC-Type")
    return {
        "declared": F.when((length != "") & F.contains(value, F.lit(BLANK)), len(MAGIC) + after + size + 4),
        "record_type": kind,
        "page_id": number(page("WARC-Record-ID")),
        "refers_to": number(page("WARC-Refers-To")),
        "header_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        "payload_bytes": number(F.regexp_extract(http, r"(?:^|\r\n)Content-Length: *(\d+)", 1)),
        "payload_digest": F.when(kind == "response", base32_sha1(payload)),
    }


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): what follows each magic, in file order by (block, seq); the first of a file precedes any."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def with_offsets(narrow: DataFrame) -> DataFrame:
    """Add `off`, the offset of the magic before each fragment; negative before the first magic of a file."""
    size = F.col("bytes") + len(MAGIC)
    done = scan(narrow, ["file"], ["seq"], [F.col("block")], {"before": Scan("prev_sum", size)})
    return done.withColumn("off", F.col("before") - len(MAGIC)).drop("before")


def _contract(block: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves this split."""
    block = block.sort_values("off")
    leave: dict[int, int] = {}
    for off, succ in zip(block["off"].to_numpy()[::-1].tolist(), block["succ"].to_numpy()[::-1].tolist(), strict=True):
        leave[off] = leave.get(succ, succ)
    return block.assign(leave=[leave[o] for o in block["off"].tolist()])


def _walk(block: pd.DataFrame) -> pd.DataFrame:
    """The candidates that chains from the entered ones pass."""
    block = block.sort_values("off")
    live: set[int] = set()
    for off, succ, entered in zip(block["off"].tolist(), block["succ"].tolist(), block["entered"].tolist(), strict=True):
        if entered or off in live:
            live.add(off)
            live.add(succ)
    return block[block["off"].isin(live)][["file", "block", "off", "succ"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, block, off, succ) of the candidates that the chain from the first offset of their file reaches."""
    kept = "file string, block bigint, off bigint, succ bigint"
    local = cut_lineage(candidates.groupBy("file", "block").applyInPandas(_contract, kept + ", leave bigint"))
    start = local.groupBy("file").agg(F.min("off").alias("off")).filter("off = 0")
    target = local.select("file", F.col("leave").alias("off")).distinct()
    entry = local.join(target.unionByName(start).distinct(), ["file", "off"], "left_semi").select("file", "off", "leave")
    jump = cut_lineage(entry)
    reach = cut_lineage(start)
    while True:
        ahead = jump.select("file", "off", F.col("leave").alias("to"))
        found = reach.join(ahead, ["file", "off"]).select("file", F.col("to").alias("off"))
        more = cut_lineage(found.join(entry.select("file", "off"), ["file", "off"], "left_semi").join(reach, ["file", "off"], "left_anti").distinct())
        onward = jump.select("file", F.col("off").alias("to"), F.col("leave").alias("next"))
        longer = cut_lineage(ahead.join(onward, ["file", "to"]).select("file", "off", F.col("next").alias("leave")))
        if not more.head(1) and not longer.head(1):
            break
        reach, jump = cut_lineage(reach.unionByName(more)), longer
    flagged = local.join(reach.withColumn("entered", F.lit(True)), ["file", "off"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return flagged.select("file", "block", "off", "succ", "entered").groupBy("file", "block").applyInPandas(_walk, kept)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, page_id, payload_bytes, payload_digest, header_digest, record_type, refers_to) of every true record."""
    text = fragments(spark, path)
    content = F.unhex(F.sha2(F.col("value").cast("binary"), 256))
    rows = text.withColumns({"bytes": F.octet_length("value").cast("bigint"), "content": content, **_parsed(F.col("value"))}).drop("value")
    index = cut_lineage(with_offsets(cut_lineage(rows)))
    candidates = index.filter("off >= 0 and declared is not null").select("file", "block", "off", (F.col("off") + F.col("declared")).alias("succ"))
    true = cut_lineage(reachable(candidates))
    marked = index.join(true.select("file", "off", "succ"), ["file", "off"], "left")
    fields = ["file", "off", "page_id", "payload_bytes", "payload_digest", "header_digest", "record_type", "refers_to"]
    full = len(MAGIC) + F.col("bytes")
    out = marked.filter(F.col("succ") == F.col("off") + full).select(*fields)
    broken = cut_lineage(marked.filter(F.col("succ") != F.col("off") + full).select("file", "off", "succ"))
    if broken.head(1):
        owner = scan(marked, ["file"], ["off"], [F.col("block")], {"owner": Scan("last", F.when(F.col("succ").isNotNull(), F.col("off")))})
        pieces = cut_lineage(owner.select("file", "content", "off", "owner").join(broken.select("file", F.col("off").alias("owner")), ["file", "owner"], "left_semi"))
        again = text.join(broken.select("file").distinct(), "file", "left_semi").select(content.alias("content"), "value")
        values = again.join(pieces.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.first("value").alias("value"))
        joined = pieces.join(values, "content").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
        value = F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC)
        whole = joined.select("file", F.col("owner").alias("off"), value.alias("value")).withColumns(_parsed(F.col("value")))
        out = out.unionByName(whole.select(*fields))
    return out.withColumn("payload_digest", F.coalesce("payload_digest", "header_digest")).withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("refers_to")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "sha1(coalesce(html, ''))"
_BASE32 = "array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::BIGINT, 1) for j in range(4)], '') for i in range(8)], '')"
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {_HEX} AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f
"""
