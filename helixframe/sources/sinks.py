"""Writers of alignments, reads and transforms."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = ("name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_TAGS = ("nm", "as", "xs", "xm", "xo", "xg")
_BASES4, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Bytes of text in one BGZF block.
BLOCK = 0xFF00
#: The empty block that ends a BGZF file.
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def sam_lines(alignments: DataFrame) -> DataFrame:
    """``value``: SAM lines of rows with the eleven fields; tags where they are not null."""
    have = [t for t in _TAGS if t in alignments.columns]
    tags = [F.when(F.col(f"`{t}`").isNotNull(), F.concat(F.lit(f"{t.upper()}:i:"), F.col(f"`{t}`").cast("string"))) for t in have]
    if "md" in alignments.columns:
        tags.append(F.concat(F.lit("MD:Z:"), F.coalesce("md", F.lit("*"))))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c in ("flag", "pos", "mapq", "pnext", "tlen") else "*")) for c in _FIELDS]
    return alignments.select(F.concat_ws("\t", *fields, *tags).alias("value"))


def sam_header(references: list[tuple[str, int]], program: str = "helixframe") -> str:
    return "\n".join(["@HD\tVN:1.3", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in references), f"@PG\tID:{program}\tPN:{program}"])


def write_sam(alignments: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """SAM text as a folder of parts; the header is a part of its own that sorts first."""
    spark = alignments.sparkSession
    head = spark.createDataFrame([(sam_header(references),)], "value string")
    head.coalesce(1).unionAll(sam_lines(alignments)).write.text(path)


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """FASTQ text as a folder of parts; a read without qualities gets the best ones."""
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.coalesce("qual", F.expr("repeat('I', length(seq))")))).write.text(path, compression)


def write_fasta(references: DataFrame, path: str) -> None:
    references.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(path)


def write_strings(reads: DataFrame, path: str, forward: bool = True, reverse: bool = True) -> None:
    """The reads' symbols, a line each, and those of their reverse complements."""
    from ..functions import sequence as S

    parts = F.array(*([F.col("seq")] if forward else []), *([S.reverse_complement(F.col("seq"))] if reverse else []))
    reads.select(F.explode(parts)).write.text(path)


def write_bwt(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """A set's transform (``sa_rank, symbol, string_id``): the symbols in order, one per zero-ended line and
    without ``$``, and the rows of ``$`` beside them as ``<path>.pri`` (``#PRI`` and a row and a string to a line)."""
    kept = rows.where("symbol <> '$'").orderBy("sa_rank").select("symbol").write
    (kept.option("compression", compression) if compression else kept).option("lineSep", "\u0000").text(path)
    write_primary(rows, path + ".pri")


def write_primary(rows: DataFrame, path: str) -> None:
    head = rows.sparkSession.createDataFrame([(-1, "#PRI")], "sa_rank long, value string")
    lines = rows.where("symbol = '$'").select("sa_rank", F.concat_ws(" ", F.col("sa_rank").cast("string"), F.col("string_id").cast("string")).alias("value"))
    head.unionByName(lines).orderBy("sa_rank").select("value").write.text(path)


def read_primary(spark: SparkSession, path: str) -> DataFrame:
    """``sa_rank, string_id`` of a primary map."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> '#PRI'").select(parts[0].cast("long").alias("sa_rank"), parts[1].cast("long").alias("string_id"))


def packed_bwt(rows: DataFrame, bits: int = 2) -> DataFrame:
    """``word, value``: the transform's symbols without ``$``, 32 bits to a word, the first symbol in its
    highest bits; ``bits`` is 2 or 4, and a symbol other than A, C, G, T needs 4."""
    from ..functions import sequence as S
    from ..operators.primitives import scan

    per = 32 // bits
    kept = scan(rows.where("symbol <> '$'").select("sa_rank", "symbol"), ["sa_rank"], F.lit(1), "at", exclusive=True)
    shift = (F.lit(per - 1) - F.pmod(F.col("at"), F.lit(per))) * bits
    one = F.call_function("shiftleft", S.symbol(F.col("symbol")).cast("long"), shift.cast("int"))
    return kept.select(F.floor(F.col("at") / per).alias("word"), one.alias("v")).groupBy("word").agg(F.sum("v").alias("value"))


def unpacked_bwt(words: DataFrame, symbols: int, bits: int = 2) -> DataFrame:
    """``at, symbol``: the first ``symbols`` symbols of packed words, by their place without ``$``."""
    from ..functions import sequence as S

    per = 32 // bits
    each = words.select("word", "value", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
    code = F.call_function("shiftright", F.col("value"), ((per - 1 - F.col("k")) * bits).cast("int")).bitwiseAND((1 << bits) - 1)
    return each.select((F.col("word") * per + F.col("k")).alias("at"), S.base(code).alias("symbol")).where(F.col("at") < symbols)


def write_packed_bwt(rows: DataFrame, path: str, bits: int = 2) -> None:
    """Packed words as Parquet in their order, and the primary map beside them."""
    packed_bwt(rows, bits).sortWithinPartitions("word").write.parquet(path)
    write_primary(rows, path + ".pri")


def debug_rows(alignments: DataFrame) -> DataFrame:
    """The compact form of alignments; a read's number is the CRC of its name."""
    return alignments.select(F.crc32(F.col("name").cast("binary")).alias("read_id"), *(c for c in alignments.columns if c not in ("seq", "qual")))


# ---------------------------------------------------------------- BAM


def encode_bam(row: dict, refs: dict[str, int]) -> bytes:
    name = row["name"].encode() + b"\0"
    cigar = [(int(n) << 4) | _OPS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [_BASES4.index(c) if c in _BASES4 else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    tags = b"".join(t.upper().encode() + b"i" + struct.pack("<i", row[t]) for t in _TAGS if row.get(t) is not None)
    if row.get("md"):
        tags += b"MDZ" + row["md"].encode() + b"\0"
    rid = refs.get(row["rname"], -1)
    nxt = rid if row["rnext"] == "=" else refs.get(row["rnext"], -1)
    pos = (row["pos"] or 0) - 1
    size = sum(n >> 4 for n in cigar if _OPS[n & 15] in "MDN=X") or 1
    begin, end, bin_ = max(pos, 0), max(pos, 0) + size - 1, 0
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            bin_ = first + (begin >> shift)
            break
    fixed = struct.pack("<iiBBHHHiiii", rid, pos, len(name), row["mapq"] or 0, bin_, len(cigar), row["flag"] or 0, len(seq), nxt, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body = fixed + name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def bgzf(data: bytes) -> bytes:
    """BGZF blocks of data, without the last empty one."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        deflated = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(deflated) + 25) + deflated + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def bam_header(references: list[tuple[str, int]]) -> bytes:
    text = (sam_header(references) + "\n").encode()
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for n, size in references:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return out


def write_bam(alignments: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """BAM as a folder of files, each whole by itself (header, records, last block), one for each partition.

    Tasks encode, compress and write; nothing passes through the driver.  A block's last byte is zero (the
    highest of its length), so blocks are written as lines that end in a zero byte.
    """
    refs = {n: k for k, (n, _) in enumerate(references)}
    head = bgzf(bam_header(references))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["block"])

        yield lines(head)
        for b in batches:
            rows = b.to_pylist()
            for at in range(0, len(rows), 2000):
                yield lines(bgzf(b"".join(encode_bam(r, refs) for r in rows[at : at + 2000])))
        yield lines(LAST)

    blocks = alignments.mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


def write(alignments: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """By the path's ending: nothing for /dev/null, .sam, .bam, .dbg (Parquet); anything else is SAM."""
    if path == "/dev/null":
        alignments.write.format("noop").mode("overwrite").save()
    elif path.endswith(".bam"):
        write_bam(alignments, path, references)
    elif path.endswith(".dbg"):
        debug_rows(alignments).write.parquet(path)
    else:
        write_sam(alignments, path, references)
