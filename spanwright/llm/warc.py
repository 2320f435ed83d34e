"""Web archives: WARC records written by Spark's text sink, and read back by a verified chain of record boundaries.

Archives are plain WARC files of any size, which Spark reads in splits. "WARC/1." may stand in a payload or an address as
well, even as a whole record, so each place where it stands is a candidate only: it says where its successor would have to
begin. From the start of a file, which is a record's, the chain of successors reaches records and nothing else."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import new_path, stage, table

#: What each record begins with, up to the minor version, and what ends a header and a record.
MAGIC, END = "WARC/1.", "\r\n\r\n"
#: A record of version 1.1 says when it was made; `pages` doesn't.
DATE = "2020-01-01T00:00:00Z"
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(binary: Column) -> Column:
    """SHA-1 in upper-case base32: each 5 hexadecimal digits are 4 of base 32."""
    part = lambda k: F.lpad(F.conv(F.substring(F.sha1(binary), 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), *_BASE32)


def _header_safe(value: Column) -> Column:
    """Control characters and spaces percent-encoded, so that no value can end its line."""
    coded = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(value.rlike(r"[\x00-\x20\x7F]"), F.array_join(coded, "")).otherwise(value)


def _fields(**fields: Column) -> Column:
    """Header lines; those of null values are left out."""
    lines = [F.concat(F.lit(name.replace("_", "-") + ": "), value, F.lit("\r\n")) for name, value in fields.items()]
    return F.concat(*(F.coalesce(x, F.lit("")) for x in lines))


def records(pages: DataFrame, least: int = 0, date: str = DATE) -> DataFrame:
    """(page_id, url, html, ...) -> (value): a WARC record for each row, without the blank lines that end it.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the others
    revisit it; smaller payloads are all responses. A null html is an empty payload; a row whose id is null can't be
    referred to, so it is a response only if its payload has no row with an id; rows that repeat the smallest id are
    responses all. Payloads meet by SHA-256, the least id of each is found before the shuffle; of a payload that a third
    of all rows have, the rows are split by adaptive execution, as the other side has one row."""
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    own = own.withColumn("key", F.sha2("html", 256))
    first = stage(own.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("key", "first"), "first")
    size = F.octet_length("html")
    rows = own.join(first, "key", "left").withColumn("revisits", (size >= least) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    digest = base32_sha1(F.encode("html", "UTF-8"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    rows = rows.withColumn("digest", digest).withColumn("block", F.when(F.col("revisits"), http).otherwise(F.concat(http, F.col("html"))))
    name = lambda page: F.concat(F.lit("<urn:spanwright:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    revisit = lambda value: F.when(F.col("revisits"), value)
    header = _fields(
        WARC_Type=F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response")),
        WARC_Record_ID=name(F.col("page_id")),
        WARC_Date=F.lit(date),
        WARC_Target_URI=_header_safe(F.col("url")),
        WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")),
        WARC_Profile=revisit(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        WARC_Refers_To=revisit(name(F.col("first"))),
        Content_Type=F.lit("application/http; msgtype=response"),
        Content_Length=F.octet_length("block").cast("string"),
    )
    return rows.select(F.concat(F.lit(MAGIC + "1\r\n"), header, F.lit("\r\n"), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """The records of pages as WARC files in the folder `path`, one for each partition; the sink's separator ends a record."""
    records(pages, least, date).write.option("lineSep", END).text(path)


def _field(front: Column, name: str) -> Column:
    """A header field's value, null if there is none."""
    found = F.regexp_extract(front, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _parsed(value: Column) -> dict[str, Column]:
    """Of what follows a magic: front (up to the header's end), closed (it has an end), `long` (bytes of the block), whole
    (the record ends where value does), and the payload's bytes and digest if whole."""
    front, bytes_ = F.substring_index(value, END, 1), value.cast("binary")
    size = F.octet_length(front)
    long = F.regexp_extract(front, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1).try_cast("long")
    whole = (F.octet_length(value) == size + 8 + long) & (size < F.octet_length(value))
    block = F.substring(bytes_, size + 5, long.cast("int"))
    lead = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + 5
    http = F.lower(F.coalesce(_field(front, "Content-Type"), F.lit(""))).startswith("application/http")
    payload = F.when(http, F.substring(block, lead, long.cast("int"))).otherwise(block)
    return {
        "front": front,
        "closed": size < F.octet_length(value),
        "long": long,
        "whole": F.coalesce(whole, F.lit(False)),
        "payload_bytes": F.when(whole, F.octet_length(payload).cast("long")),
        "payload_digest": F.when(whole, base32_sha1(payload)),
    }


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): what stands between two magics, in splits that Spark reads in parallel."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), "value")


def _places(spark: SparkSession, path: str) -> DataFrame:
    """Each piece between magics with the offset of the magic before it: pieces of a split are counted in the order of
    reading, splits by the bytes of those before. The text of a piece goes no further than its header."""
    raw = _raw(spark, path)
    pieces = stage(raw.select("file", "split", "size", F.monotonically_increasing_id().alias("id"), F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("content"), *(c.alias(n) for n, c in _parsed(F.col("value")).items())), "pieces")
    step = F.col("bytes") + len(MAGIC)
    splits = pieces.groupBy("file", "split").agg(F.sum(step).alias("all"), F.max("size").alias("size"))
    wrong = splits.groupBy("file").agg((F.sum("all") - F.max("size")).alias("over")).filter(F.col("over") != len(MAGIC))
    if not wrong.isEmpty():
        raise ValueError(f"pieces of {wrong.first()['file']} don't add up to its size")
    before = F.coalesce(F.sum("all").over(_window(["file"], "split")), F.lit(0))
    base = splits.select("file", "split", before.alias("base"))
    own = pieces.withColumn("own", F.coalesce(F.sum(step).over(_window(["file", "split"], "id")), F.lit(0)))
    placed = own.join(base, ["file", "split"]).withColumn("offset", F.col("base") + F.col("own") - len(MAGIC))
    return stage(placed.drop("base", "own", "id", "size"), "places")


def _window(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _follow() -> Column:
    """The offset at which a candidate's successor begins; null if it isn't a header."""
    front = F.col("front")
    header = front.rlike(r"^[0-9]\r\n") & ~front.rlike(r"\r\n(?![ \t])[^:\r\n]*\r\n") & F.col("closed")
    return F.when(header, F.col("offset") + len(MAGIC) + F.octet_length(front) + 8 + F.col("long"))


def _completed(places: DataFrame) -> DataFrame:
    """Candidates (file, split, offset, front, closed, long, ...) with whole headers: a header that holds the magic, as in
    an address, is put together from the pieces that it was cut into, one more each round."""
    nexts = places.select("file", F.col("offset").alias("at"), F.col("front").alias("more"), F.col("closed").alias("ends"), F.col("bytes").alias("many"))
    done = places.filter("closed")
    torn = places.filter(~F.col("closed") & _maybe_header())
    while not torn.isEmpty():
        put = torn.withColumn("at", F.col("offset") + len(MAGIC) + F.col("bytes")).join(nexts, ["file", "at"])
        put = put.withColumn("front", F.concat("front", F.lit(MAGIC), "more")).withColumn("closed", F.col("ends")).withColumn("bytes", F.col("bytes") + len(MAGIC) + F.col("many"))
        put = put.withColumn("long", _parsed(F.col("front"))["long"]).select(*places.columns)
        put = stage(put.filter(F.col("closed") | _maybe_header()), "headers")
        done, torn = done.unionByName(put.filter("closed")), put.filter("NOT closed")
    return done.withColumn("follow", _follow()).filter("follow IS NOT NULL")


def _maybe_header() -> Column:
    """What has no end yet may be a header: its lines so far are fields."""
    return F.col("front").rlike(r"^[0-9]\r\n") & ~F.col("front").rlike(r"\r\n(?![ \t])[^:\r\n]*\r\n")


def _inner(offset: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """For candidates by offset the index of each one's successor, or its own if that isn't among them."""
    at = np.minimum(np.searchsorted(offset, follow), len(offset) - 1)
    return np.where(offset[at] == follow, at, np.arange(len(offset)))


def _leave(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves what the split knows: pointers are doubled until they stay."""
    rows = rows.sort_values("offset", ignore_index=True)
    to = _inner(rows["offset"].to_numpy(), rows["follow"].to_numpy())
    while (to[to] != to).any():
        to = to[to]
    return rows.assign(leaves=rows["follow"].to_numpy()[to])[["file", "split", "offset", "leaves"]]


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split on the chain from where it enters."""
    rows = rows.sort_values("offset", ignore_index=True)
    offset = rows["offset"].to_numpy()
    to, on, k = _inner(offset, rows["follow"].to_numpy()), np.zeros(len(rows), bool), int(np.searchsorted(offset, rows["enters"].iloc[0]))
    while not on[k]:
        on[k] = True
        k = to[k]
    return rows[on][["file", "offset", "follow"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, split, offset, follow) -> (file, offset, follow): the candidates on the chain from offset 0 of each file.

    Each split follows its own candidates to where they leave it; between splits, pointers jump: each round doubles how
    many splits a pointer skips, so a file of n splits takes log n rounds over few rows. Then each split that the chain
    enters marks its own. A split's candidates are bounded by its bytes."""
    kind = "file string, split long, offset long"
    leaves = stage(candidates.select("file", "split", "offset", "follow").groupBy("file", "split").applyInPandas(_leave, f"{kind}, leaves long"), "leaves")
    gates = leaves.select("file", F.col("leaves").alias("offset")).unionByName(leaves.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    gates = stage(leaves.join(gates, ["file", "offset"]), "gates")
    reached, jump = stage(gates.filter("offset = 0").select("file", "offset"), "reached"), gates.select("file", "offset", "leaves")
    while True:
        hop = jump.join(reached, ["file", "offset"], "left_semi").select("file", F.col("leaves").alias("offset"))
        more = stage(hop.join(gates.select("file", "offset"), ["file", "offset"], "left_semi").join(reached, ["file", "offset"], "left_anti").distinct(), "more")
        if more.isEmpty():
            break
        reached = stage(reached.unionByName(more), "reached")
        jump = stage(jump.join(jump.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("on")), ["file", "leaves"], "left").select("file", "offset", F.coalesce("on", "leaves").alias("leaves")), "jump")
    enters = gates.join(reached, ["file", "offset"], "left_semi").groupBy("file", "split").agg(F.min("offset").alias("enters"))
    marked = candidates.select("file", "split", "offset", "follow").join(enters, ["file", "split"]).groupBy("file", "split").applyInPandas(_walk, "file string, offset long, follow long")
    return stage(marked, "records")


def _mended(spark: SparkSession, path: str, places: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, offset, payload_bytes, payload_digest) of records whose payloads hold the magic, put together from their
    pieces. These are told by ranges of bytes, and their texts are read again by their SHA-256."""
    wide = 1 << 20
    spans = cut.select("file", F.col("offset").alias("start"), "follow", F.explode(F.sequence(F.floor(F.col("offset") / wide), F.floor((F.col("follow") - 1) / wide))).alias("bin"))
    pieces = places.select("file", F.col("offset").alias("at"), "content", F.floor(F.col("offset") / wide).alias("bin"))
    pieces = stage(pieces.join(spans, ["file", "bin"]).filter("at >= start AND at < follow").select("file", "start", "at", "content"), "spans")
    texts = _raw(spark, path).select(F.sha2("value", 256).alias("content"), "value").join(pieces.select("content").distinct(), "content", "left_semi").dropDuplicates(["content"])
    texts = stage(texts, "texts")
    parts = pieces.join(texts, "content").groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    whole = parts.select("file", F.col("start").alias("offset"), F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    found = _parsed(F.col("value"))
    return whole.select("file", "offset", found["payload_bytes"].alias("payload_bytes"), found["payload_digest"].alias("payload_digest"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the uncompressed WARC files in `path`: file, offset, record_type, record_id, target_uri, date,
    refers_to, said_digest (of the header), payload_bytes and payload_digest (of the payload read; of a revisit, which has
    none, of the record that it refers to, null if that is not in the archives). Records from a broken boundary on are not reached."""
    places = _places(spark, path)
    candidates = stage(_completed(places), "candidates")
    chain = reachable(candidates)
    rows = candidates.drop("follow").join(chain, ["file", "offset"])
    front = F.col("front")
    rows = stage(
        rows.select(
            "file",
            "offset",
            "follow",
            "whole",
            _field(front, "WARC-Type").alias("record_type"),
            _field(front, "WARC-Record-ID").alias("record_id"),
            _field(front, "WARC-Target-URI").alias("target_uri"),
            _field(front, "WARC-Date").alias("date"),
            _field(front, "WARC-Refers-To").alias("refers_to"),
            F.regexp_replace(_field(front, "WARC-Payload-Digest"), "^(?i)sha1:", "").alias("said_digest"),
            "payload_bytes",
            "payload_digest",
        ),
        "found",
    )
    cut = rows.filter("NOT whole")
    if not cut.isEmpty():
        mended = stage(_mended(spark, path, places, cut), "mended")
        own = cut.drop("payload_bytes", "payload_digest").join(mended, ["file", "offset"], "left")
        rows = stage(rows.filter("whole").unionByName(own), "found")
    rows = rows.drop("follow", "whole")
    known = rows.filter("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest"))
    known = stage(known, "known")  # a row for each record, so that the revisits of one record can be split
    revisits = rows.filter("record_type = 'revisit'").join(known, "refers_to", "left").withColumn("payload_bytes", F.col("_bytes")).withColumn("payload_digest", F.col("_digest"))
    return rows.filter("record_type <> 'revisit' OR record_type IS NULL").unionByName(revisits.select(*rows.columns))


def op13(spark, sf_dir: str) -> DataFrame:
    """`pages` written as WARC files and read back; nulls, ties and repeated rows as in records(); other columns are not
    read; an empty table gives no rows."""
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:spanwright:(-?[0-9]*):", 1).try_cast("long")
    found = read_archives(spark, path)
    return found.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


OP13_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, list_transform(range(8), lambda k: ('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5))::BIGINT) AS five FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, array_to_string(list_transform(flatten(list_transform(five, lambda v: [v >> 15, v >> 10, v >> 5, v])), lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v & 31) + 1]), '') AS payload_digest,
CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""
