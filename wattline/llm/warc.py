"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing. One record per row; Spark's text writer puts the blank lines of the format between
records, so every task writes an archive of its own to any store that Spark can write to. Of records with
equal payloads of at least ``revisit_bytes`` bytes the one with the smallest id is a response,
the others are revisits: they refer to it and carry digest and length instead of the payload.
Several rows with that smallest id are all responses. Rows whose digest falls into no slot of a
table of fixed size that copies fall into have no copy and are written where they are read; only
the others are shuffled to meet the smallest id of their payload.

Reading. Archives are split like any text file, at the magic that begins a record. Tasks emit a
candidate for every magic, with the offset at which its header says the next record begins.
A magic may also stand inside a payload. Candidates link to their successors, and
pointer jumping (each round doubles the length of the links) finds what can be reached from
the start of the file; only that is a record. Its payload is put together from all stretches
between its start and its end; payloads without magic are one stretch and are digested where they are read.
Jumping starts from entry points: links inside one split are followed by the task that reads it,
so rounds count splits, not records.

Null payloads count as empty; null urls and ids are empty header values, a null id comes back as null. Repeated rows make a record
each. A file whose chain breaks off, or doesn't end at the end of the file, raises an error.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import text_of, type_of

MAGIC = "WARC/1.0\r\n"
SKIP = len(MAGIC)
END = "\r\n\r\n"
SLOTS = 1 << 18
DATE = "2000-01-01T00:00:00Z"  # fixed, so that a task that runs again writes the same bytes


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", *, revisit_bytes: int = 100) -> None:
    """Writes one record per row of ``pages`` as archives below ``path``."""
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(text_of(url_col), r"[\r\n]", "").alias("url"), text_of(body_col).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    first = (
        rows.where(F.col("size") >= revisit_bytes).groupBy(F.col("digest").alias("d2")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("d2", "first")
    )
    first = stable(first)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    taken = first.select(slot("d2").alias("taken")).distinct()  # at most SLOTS rows, so its broadcast is bounded
    flagged = rows.join(F.broadcast(taken), slot("digest") == F.col("taken"), "left")
    lone = flagged.where("taken is null").drop("taken").withColumns({"d2": F.lit(None).cast("string"), "first": F.lit(None).cast(type_of(first, "first"))})
    r = lone.unionByName(flagged.where("taken is not null").drop("taken").join(first, F.col("digest") == F.col("d2"), "left"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text_id, F.lit(">"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.col("url")),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        )).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit("\r\n"),
    )
    r.select(F.concat(header, F.when(again, "").otherwise(F.col("body"))).alias("value")).write.option("lineSep", END).text(path)


def parse(stretch: bytes) -> tuple[dict[str, str], int, int] | None:
    """Header fields, header length and content length of what follows a magic; None if it is no record."""
    end = stretch.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for x in stretch[:end].split(b"\r\n"):
        k, colon, v = x.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    return (fields, end + 4, int(n)) if n.isdigit() and len(n) < 18 and fields.get("warc-type") else None


def stretches(spark: SparkSession, path: str) -> DataFrame:
    """Rows in order within each split: file, split (where it begins), value (text between two magics)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_bytes"), "value",
    )


CANDIDATE = (
    "file string, split long, rel long, file_bytes long, at long, stop long, next long, kind string, id string, refers string, "
    "digest string, size long, found string, found_size long, last boolean"
)


def candidates(rows: DataFrame) -> DataFrame:
    """One row per stretch, without its text. Offsets count from the start of the split's first stretch.

    at: where the magic stands; stop: where the stretch ends; next: where the record ends, null if the stretch is
    no header; found: digest of the payload if the stretch holds all of it.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    arrow = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in CANDIDATE.split(", "))])
    names = arrow.names

    def run(batches):
        where, at = None, 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for file, split, size, value in zip(*(b.column(k) for k in ("file", "split", "file_bytes", "value")), strict=True):
                file, split = file.as_py(), split.as_py()
                if (file, split) != where:
                    where, at = (file, split), 0
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                stop = at + len(raw)
                got = parse(raw)
                row = dict.fromkeys(names) | {"file": file, "split": split, "rel": at - SKIP, "file_bytes": size.as_py(), "at": at - SKIP, "stop": stop, "last": False}
                if got is not None:
                    f, head, n = got
                    row |= {"next": at + head + n + len(END), "kind": f.get("warc-type"), "id": strip(f.get("warc-record-id", "")), "refers": strip(f.get("warc-refers-to", "")),
                            "digest": f.get("warc-payload-digest", "").removeprefix("sha256:"), "size": int(x) if (x := f.get("x-payload-length", "")).isdigit() else None}
                    if head + n + len(END) == len(raw):
                        row |= {"found": hashlib.sha256(raw[head:head + n]).hexdigest(), "found_size": n}
                for k in names:
                    out[k].append(row[k])
                at = stop + SKIP
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return rows.mapInArrow(run, CANDIDATE)


def strip(urn: str) -> str | None:
    """The id in a record's name; names that this module didn't write keep their scheme."""
    return urn.removeprefix("<").removesuffix(">").removeprefix("urn:page:") or None


def placed(found: DataFrame) -> DataFrame:
    """Candidates with offsets from the start of their file: splits of a file are added up in order."""
    ends = found.groupBy("file", "split").agg(F.max("stop").alias("bytes"))
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(F.col("file").alias("f2"), F.col("split").alias("s2"), F.coalesce(F.sum(F.col("bytes") + SKIP).over(w), F.lit(0)).alias("base"))
    moved = found.join(base, (F.col("file") == F.col("f2")) & (F.col("split") == F.col("s2"))).drop("f2", "s2")
    return moved.select(*[(F.col(c) + F.col("base")).alias(c) if c in ("at", "stop", "next") else F.col(c) for c in found.columns])


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the records: candidates that a chain from the start of the file reaches.

    Links out of a split: each task follows the links inside its split to the first offset beyond
    it. Pointer jumping over these entry points doubles the links until all that the start reaches
    is marked; a last pass marks what lies between in every split that is entered.
    """
    links = found.where("next is not null").select("file", "split", "at", "next")

    def leave(pdf):
        to = dict(zip(pdf["at"], pdf["next"], strict=True))
        out: dict[int, int] = {}
        for a in sorted(to, reverse=True):
            out[a] = out.get(to[a], to[a])
        return pdf.assign(leaves=[out[a] for a in pdf["at"]])

    exits = stable(links.groupBy("file", "split").applyInPandas(leave, "file string, split long, at long, next long, leaves long"))
    entry = exits.select(F.col("file").alias("f2"), F.col("leaves").alias("l2")).distinct()
    hop = stable(exits.join(entry, (F.col("file") == F.col("f2")) & (F.col("at") == F.col("l2")), "left_semi").select("file", F.col("at").alias("src"), F.col("leaves").alias("dst"))
                 .union(exits.where("at = 0").select("file", "at", "leaves")).distinct())
    marked = stable(exits.where("at = 0").select("file", F.col("at").alias("entry")))
    n = -1
    while (now := marked.count()) != n:
        n = now
        more = marked.join(hop, (marked["file"] == hop["file"]) & (marked["entry"] == hop["src"])).select(marked["file"], F.col("dst").alias("entry"))
        marked = stable(marked.union(more).distinct())
        a, b = hop.alias("a"), hop.alias("b")
        hop = stable(a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.dst") == F.col("b.src")), "left").select("a.file", "a.src", F.coalesce("b.dst", "a.dst").alias("dst")))

    starts = exits.join(marked, (exits["file"] == marked["file"]) & (exits["at"] == marked["entry"]), "left").select(exits["file"], "split", "at", "next", F.col("entry").isNotNull().alias("entered"))

    def follow(pdf):
        to = dict(zip(pdf["at"], pdf["next"], strict=True))
        on = set()
        for a in pdf["at"][pdf["entered"]]:
            while a in to and a not in on:
                on.add(a)
                a = to[a]
        return pdf.loc[pdf["at"].isin(on), ["file", "at"]]

    return starts.groupBy("file", "split").applyInPandas(follow, "file string, at long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, at, kind, id, refers, payload_bytes, payload_digest.

    Both payload columns come from the payload itself; for a revisit from its header.
    """
    found = stable(placed(candidates(stretches(spark, path))))
    real = stable(reachable(found))
    marked = stable(found.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left"))
    whole = found.groupBy("file").agg(F.max("stop").alias("end")).join(marked.where("real").groupBy("file").agg(F.max("next").alias("reach")), "file", "left")
    broken = whole.where("not (end <=> reach) and end > 0").count()  # per file
    if broken:
        raise ValueError(f"{broken} archives do not end where their chain of records ends")
    records = marked.where("real")
    single = records.where("found is not null").select("file", "at", "kind", "id", "refers", "digest", "size", "found", "found_size")
    spread = spans(spark, path, marked, records.where("found is null"))
    r = single.unionByName(spread)
    again = F.col("kind") == "revisit"
    return r.select(
        "file", "at", "kind", "id", "refers",
        F.when(again, F.col("size")).otherwise(F.col("found_size")).alias("payload_bytes"),
        F.when(again, F.col("digest")).otherwise(F.col("found")).alias("payload_digest"),
    )


def spans(spark: SparkSession, path: str, marked: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose payload holds magic: their stretches are read again and put together.

    The stretches that belong to such a record are found by order of offset; the archives are
    read again only if there are any, and only those stretches are shuffled.
    """
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.where("at >= 0").select("file", "split", "rel", "at", F.last(F.when(F.col("real"), F.col("at")), True).over(w).alias("owner"))
    wanted = stable(owned.join(records.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi"))
    fields = records.select("file", F.col("at").alias("owner"), "kind", "id", "refers", "digest", "size")
    if wanted.isEmpty():
        return records.select("file", "at", "kind", "id", "refers", "digest", "size", "found", "found_size")

    def locate(batches):
        where, at = None, 0
        for b in batches:
            rel = []
            for file, split, value in zip(b.column("file"), b.column("split"), b.column("value"), strict=True):
                if (file.as_py(), split.as_py()) != where:
                    where, at = (file.as_py(), split.as_py()), 0
                rel.append(at - SKIP)
                at += (value.as_buffer().size if value.is_valid else 0) + SKIP
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(rel, pa.int64()), b.column("value")], names=["file", "split", "rel", "value"])

    again = stretches(spark, path).mapInArrow(locate, "file string, split long, rel long, value string").join(wanted, ["file", "split", "rel"])

    def assemble(pdf):
        import pandas as pd

        raw = MAGIC.join(pdf.sort_values("at")["value"]).encode()
        _, head, n = parse(raw)
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "owner": pdf["owner"].iloc[:1], "n": [len(pdf)], "found": [hashlib.sha256(raw[head:head + n]).hexdigest()], "found_size": [n]})

    made = stable(again.groupBy("file", "owner").applyInPandas(assemble, "file string, owner long, n long, found string, found_size long"))
    if (made.agg(F.sum("n")).first()[0] or 0) != wanted.count():
        raise ValueError("the archives were split in another way when read again")
    return fields.join(made, ["file", "owner"]).select("file", F.col("owner").alias("at"), "kind", "id", "refers", "digest", "size", "found", "found_size")
