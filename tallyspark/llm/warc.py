"""WARC archives (ISO 28500), written and read back with boundary-chain verification.

Writing: one record a row, by Spark's text writer, whose line separator is the blank line that
ends a record. Of records with equal payloads of ``MIN_SHARED`` bytes or more, that with the
smallest page id is a response and the others revisit it.

Reading: Spark splits the archives at the magic line, in as many tasks as the reader likes.
The magic may also stand inside a payload, so each piece is only a candidate:

1. a task numbers the bytes of its block and, for each candidate with a well-formed header,
   emits the offset of the record and of its successor (header, content length, end mark);
2. inside a block the chain of each candidate is followed to the first offset beyond it, so a
   block's candidates become edges from block to block;
3. pointer jumping from the files' starts doubles the known path each round, over one row for
   each edge between blocks; candidates that it doesn't reach are rejected;
4. a reachable record is joined with the pieces that lie in it, and they make up its bytes.

Null payloads count as empty; control characters and blanks in a url are written as %XX and read
back; null urls as an empty field. Rows with one page id are records of their own. A row whose id
is null revisits a record of its payload that has an id; where all ids are null, all are responses.
Empty tables give no archive and no rows. Other columns aren't written, whatever their names.
"""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import bounded, shared_dir, shipped, table, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_SHARED = 100
#: Digits of a record's length.
MOST_DIGITS = 16
ID = "urn:x-page:"
ADDED = ("__payload", "payload_bytes", "payload_digest", "__first", "record_type", "refers_to")


def classify(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> DataFrame:
    """Each row with its payload, digest, ``record_type`` and ``refers_to``, which replace columns of their names. Only digests and ids are shuffled, with partial
    minima; the payloads meet the digests that occur again by broadcast, or by a join beyond its bound."""
    pages = pages.drop(*(c for c in ADDED if c not in (page_id, payload)))
    rows = pages.select("*", F.coalesce(F.col(payload), F.lit("")).alias("__payload"))
    rows = rows.select("*", F.octet_length("__payload").cast("long").alias("payload_bytes"), F.sha2("__payload", 256).alias("payload_digest"))
    shared = rows.where(F.col("payload_bytes") >= MIN_SHARED).groupBy("payload_digest").agg(F.min(page_id).alias("__first"), F.count(F.lit(1)).alias("__n"))
    again = bounded(written(shared.where("__n > 1").select("payload_digest", "__first"), "warc-shared"))
    rows = rows.join(again, "payload_digest", "left")
    # Ids that are null stand after all others.
    revisit = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col(page_id))
    return rows.select(
        "*",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("__first")).alias("refers_to"),
    )


def _record(page_id: Column, url: Column) -> Column:
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("__payload"))).otherwise(http)
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))),
        field("WARC-Target-URI", F.coalesce(F.regexp_replace(F.url_encode(url), "%2F|%3A", "$0"), F.lit(""))),
        field("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", field("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    rows = classify(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")))
    rows.select(_record(F.col("page_id"), F.col("url")).alias("value")).write.option("lineSep", END).text(path)


def _fields(raw: bytes) -> tuple[dict, int] | None:
    """The header of a record, after its magic, and where its block begins and ends; None if it isn't one."""
    if (end := raw.find(END.encode())) < 0:
        return None
    fields: dict = {}
    for line in raw[:end].split(b"\r\n"):
        name, _, content = line.partition(b": ")
        fields.setdefault(name.lower().decode("latin-1"), content.decode("utf-8", "replace"))
    size = fields.get("content-length", "")
    # A payload may look like a header with any length; one that no file has is none.
    if not (size.isascii() and size.isdigit() and len(size.lstrip("0")) <= MOST_DIGITS and "warc-type" in fields and "warc-record-id" in fields):
        return None
    return fields, end + len(END)


def _candidates(batches):
    """Without payloads: each piece's offset inside its block and, if a record may begin there, that record's length."""
    key, at = None, 0
    for batch in batches:
        ats, lengths = [], []
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for value, here in zip(batch.column(0), zip(files, blocks)):
            raw = value.as_py()
            if key != here:
                key, at = here, 0
            head = _fields(raw)
            ats.append(at)
            lengths.append(head and len(MAGIC) + head[1] + int(head[0]["content-length"]) + len(END))
            at += len(raw) + len(MAGIC)
        sizes = pa.array([len(v.as_py()) + len(MAGIC) for v in batch.column(0)], pa.int64())
        yield pa.record_batch({"file": batch.column(1), "block": batch.column(2), "at": pa.array(ats, pa.int64()), "size": sizes, "length": pa.array(lengths, pa.int64())})


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block: where its chain leaves the block's candidates."""
    successor, exits = dict(zip(pdf["offset"], pdf["successor"])), {}
    for at in sorted(successor, reverse=True):
        exits[at] = exits.get(successor[at], successor[at])
    return pdf.assign(exit=[exits[x] for x in pdf["offset"]])[["file", "block", "offset", "exit"]]


def _last(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last record of the chain that enters a block."""
    successor, at = dict(zip(pdf["offset"], pdf["successor"])), int(pdf["entry"].iloc[0])
    while successor[at] in successor:
        at = successor[at]
    return pdf.iloc[:1][["file", "block", "entry"]].assign(last=at)


def _reached(edges: DataFrame) -> DataFrame:
    """``file, offset`` of all entries that a chain from the file's start comes to. Each round adds what the known ones
    jump to and composes the jumps with themselves, so the rounds are the logarithm of the blocks of a file."""
    jumps = edges.select("file", F.col("offset").alias("a"), F.col("exit").alias("b"))
    seen = edges.where("offset = 0").select("file", "offset").distinct()
    known, n = -1, seen.count()
    while n != known:
        known = n
        more = seen.join(jumps, (seen["file"] == jumps["file"]) & (seen["offset"] == jumps["a"])).select(seen["file"], F.col("b").alias("offset"))
        seen = written(seen.unionByName(more).distinct(), "warc-seen")
        n = seen.count()
        then = jumps.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = written(jumps.join(then, ["file", "b"], "left").select("file", "a", F.coalesce("c", "b").alias("b")), "warc-jumps")
    return seen


def _records(batches):
    """The records of the chain that enters a block, whole where they end in it; else their parts, with the offset of the
    record to which they belong. State runs along the pieces of a block, in the reader's order."""
    key = at = expected = owner = None
    for batch in batches:
        out: list[dict] = []
        values, rest = batch.column(0), batch.select(["file", "block", "base", "entry", "owner"]).to_pylist()
        for value, row in zip(values, rest):
            raw = value.as_py()
            if key != (row["file"], row["block"]):
                key, at, expected, owner = (row["file"], row["block"]), row["base"] - len(MAGIC), row["entry"], row["owner"]
            if at == expected and (head := _fields(raw)):
                fields, start = head
                length = int(fields["content-length"])
                owner, expected = at, at + len(MAGIC) + start + length + len(END)
                whole = len(raw) >= start + length
                out.append(
                    {
                        "file": row["file"], "offset": at, "at": at, "whole": whole, "length": length, "type": fields["warc-type"], "id": fields["warc-record-id"],
                        "refers": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"),
                        "content": raw[start : start + length] if whole else raw[start:],
                    }
                )
            elif owner is not None:
                out.append({"file": row["file"], "offset": owner, "at": at, "whole": False, "content": MAGIC.encode() + raw})
            at += len(raw) + len(MAGIC)
        yield pa.RecordBatch.from_pylist(out, RECORD)


RECORD = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("length", pa.int64())]
    + [(c, pa.string()) for c in ("type", "id", "refers", "uri", "digest")] + [("content", pa.binary())]
)
RECORD_SQL = "file string, offset long, at long, whole boolean, length long, type string, id string, refers string, uri string, digest string, content binary"


def read_archives(spark, path: str) -> DataFrame:
    """``file, offset, type, id, refers, uri, digest, content`` of each record that the chain from its file's start reaches.
    Payloads stay in the task that reads them; only those with the magic inside, and across blocks, are shuffled."""
    shipped(spark)
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece")
    )
    light = written(pieces.mapInArrow(_candidates, "file string, block long, at long, size long, length long"), "warc-candidates")
    order = Window.partitionBy("file").orderBy("block")  # a row for each block
    bases = light.groupBy("file", "block").agg(F.sum("size").alias("n")).select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("base"))
    bases = written(bases, "warc-blocks")
    offset = F.col("base") + F.col("at") - len(MAGIC)
    found = light.where("length is not null").join(bases, ["file", "block"]).select("file", "block", offset.alias("offset"), (offset + F.col("length")).alias("successor"))
    exits = written(found.groupBy("file", "block").applyInPandas(_follow, "file string, block long, offset long, exit long"), "warc-exits")
    entries = exits.select("file", F.col("exit").alias("offset")).unionByName(exits.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    reached = _reached(exits.join(entries, ["file", "offset"]).select("file", "offset", "exit"))
    entered = exits.join(reached, ["file", "offset"], "left_semi").select("file", "block", F.col("offset").alias("entry"))
    lasts = found.join(entered, ["file", "block"]).groupBy("file", "block").applyInPandas(_last, "file string, block long, entry long, last long")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = bases.join(lasts, ["file", "block"], "left").select("file", "block", "base", "entry", F.last("last", ignorenulls=True).over(before).alias("owner"))
    blocks = bounded(written(blocks, "warc-entries"))
    # In the reader's order, which joins needn't keep; a block's pieces are in one partition after either join.
    in_order = pieces.join(blocks, ["file", "block"]).sortWithinPartitions("file", "block", "piece")
    rows = in_order.select("value", "file", "block", "base", "entry", "owner").mapInArrow(_records, RECORD_SQL)
    parts = rows.where("not whole").groupBy("file", "offset").agg(
        *(F.max(c).alias(c) for c in ("length", "type", "id", "refers", "uri", "digest")), F.array_sort(F.collect_list(F.struct("at", "content"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["content"]))
    columns = ["file", "offset", "type", "id", "refers", "uri", "digest", "content"]
    return rows.where("whole").select(columns).unionByName(parts.withColumn("content", F.substring(joined, 1, F.least("length", F.lit((1 << 31) - 1)).cast("int"))).select(columns))


def op8_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, f"<{ID}(-?[0-9]+)>", 1).try_cast("long")
    start = F.instr(F.decode("content", "ISO-8859-1"), END) + len(END)
    payload = F.substring("content", start, F.length("content"))
    records = read_archives(spark, path).select(
        number(F.col("id")).alias("page_id"), F.length(payload).cast("long").alias("n"), F.sha2(payload, 256).alias("found"),
        F.replace("digest", F.lit("sha256:")).alias("stated"), F.col("type").alias("record_type"), number(F.col("refers")).alias("refers_to"),
    )
    records = written(records, "warc-records")  # digests and lengths
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("found").alias("stated")).agg(F.max("n").alias("full"))
    revisits = records.where("record_type = 'revisit'").join(full, ["refers_to", "stated"], "left")
    return (
        records.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("found").alias("payload_digest"), "record_type", "refers_to")
        .unionByName(revisits.select("page_id", F.col("full").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "record_type", "refers_to"))
    )


OP8_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_SHARED} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_SHARED} AND first <> page_id THEN first END AS refers_to FROM f"""
