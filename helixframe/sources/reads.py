"""Readers of reads, references and alignments."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.align import Scheme

READ = "name string, seq string, qual string"
#: Rows in a batch that a file parser hands over.
BATCH = 20_000


class MalformedFile(ValueError):
    pass


# ---------------------------------------------------------------- FASTQ


def parse_fastq(data: bytes) -> Iterator[tuple[str, str, str]]:
    """Records of a FASTQ file: ``@name`` (the whole line), bases on one or more lines up to ``+``, qualities on one line."""
    lines = data.decode("latin-1").split("\n")
    at = 0
    while at < len(lines):
        line = lines[at].rstrip("\r")
        at += 1
        if not line.strip():
            continue
        if line[0] != "@":
            raise MalformedFile(f"line {at}: expected '@'")
        name, bases = line[1:], []
        while True:
            if at >= len(lines):
                raise MalformedFile(f"line {at}: record without '+'")
            line = lines[at].strip()
            at += 1
            if line.startswith("+"):
                break
            bases.append("".join(line.split()))
        if at >= len(lines):
            raise MalformedFile(f"line {at}: record without qualities")
        yield name, "".join(bases), lines[at].rstrip("\r")
        at += 1


def _pieces(pieces: list[str], whole: bool) -> tuple[list[str], list[tuple[str, str, str]], str | None]:
    """Records of a file's part that was split where a line begins with ``@``: pieces before the first whole
    record, the records, and what is left of a record at the end.

    A piece whose qualities are shorter than its bases ends before a quality line that begins with ``@`` and
    goes on in the next piece.  ``whole`` says that the part begins the file.
    """
    head: list[str] = []
    out: list[tuple[str, str, str]] = []
    held = None
    for piece in pieces:
        text = piece if held is None else held + "\n@" + piece
        lines = [x.rstrip("\r") for x in text.split("\n")]
        plus = next((k for k in range(1, len(lines)) if lines[k].startswith("+")), None)
        bases = "".join("".join(lines[1:plus]).split()) if plus else ""
        qual = lines[plus + 1] if plus and plus + 1 < len(lines) else None
        if plus and qual is not None and len(qual) >= len(bases):
            out.append((lines[0], bases, qual))
            held = None
        elif plus:
            held = text
        elif not out and held is None and not whole:
            head.append(piece)
        elif text.strip():
            raise MalformedFile(f"record without '+': {text[:40]!r}")
    return head, out, held


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq, qual`` of FASTQ files, plain or gzip; a name is its whole line.

    Plain files are read in splits of the session's ``spark.sql.files.maxPartitionBytes``: pieces begin where
    a line begins with ``@``, which a quality line may do too, so the ends of neighbouring splits are put
    together by file and offset (a second pass that hands over at most two pieces of each split).  A gzip
    file is one task's work.
    """
    rows = spark.read.option("lineSep", "\n@").text(path).select(F.col("value").cast("binary").alias("value"), "_metadata.file_path", "_metadata.file_block_start", "_metadata.file_block_length")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[str], bool]]:
        """The pieces of each split, in lists, with a mark on the last list; a list is as long as a batch."""
        at, held = None, []
        for b in batches:
            for value, *key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is not None and key != at:
                    yield (*at, held, True)
                    held = []
                at = key
                held.append(value.decode("latin-1"))
                if len(held) >= BATCH:
                    yield (*at, held, False)
                    held = []
        if at is not None:
            yield (*at, held, True)

    def read(batches: Iterator[pa.RecordBatch], edges: bool):
        before, left, began = None, None, False
        for file, start, size, pieces, last in parts(batches):
            if before != (file, start):
                before, left, began = (file, start), None, False
                if start == 0 and pieces:
                    first = pieces[0].lstrip("\n\r")
                    if first.strip() and first[0] != "@":
                        raise MalformedFile(f"{file}: expected '@'")
                    pieces = [first[1:], *pieces[1:]] if first.strip() else pieces[1:]
            if left is not None:
                pieces = [left + "\n@" + pieces[0], *pieces[1:]] if pieces else [left]
            head, out, left = _pieces(pieces, start == 0 or began)
            began = began or bool(out) or left is not None
            if not edges:
                yield out
            else:
                if head:
                    yield [(file, start, "head", "\n@".join(head))]
                if last and left is not None:
                    yield [(file, start + size, "tail", left)]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in read(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["name", "seq", "qual"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in read(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out]), pa.array([r[3] for r in out])], names=["file", "at", "side", "value"])

    # at most two rows for each split; a head goes with the tail before it in the file, splits between may begin no piece
    edge = rows.mapInArrow(ends, "file string, at long, side string, value string").withColumn("k", F.when(F.col("side") == "tail", 0).otherwise(1))
    edge = edge.withColumn("g", F.sum(1 - F.col("k")).over(W.partitionBy("file").orderBy("at", "k")))
    both = edge.groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("at", "k", "value"))).alias("v")).select(F.array_join(F.transform("v", lambda x: x["value"]), "\n@").alias("value"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for v in b.column(0).to_pylist() for r in parse_fastq(("@" + v).encode("latin-1", "replace"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], names=["name", "seq", "qual"])

    return rows.mapInArrow(records, READ).unionByName(both.mapInArrow(mend, READ))


# ---------------------------------------------------------------- lines


def text_reads(spark: SparkSession, path: str) -> DataFrame:
    """One read per line, characters that cannot be printed dropped; no qualities."""
    seq = F.regexp_replace("value", r"[^\x21-\x7E]", "")
    return spark.read.text(path).select(F.lit(None).cast("string").alias("name"), seq.alias("seq"), F.lit(None).cast("string").alias("qual")).where("seq <> ''")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, seq`` of FASTA records.  Records are split at ``>`` on a line's start, so files are read in
    pieces; symbols stay as they are."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(record, r"^(\S*)", 1)
    seq = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"\s", "")
    return rows.where("trim(value) <> ''").select(name.alias("name"), seq.alias("seq"))


def ambiguities(references: DataFrame) -> DataFrame:
    """``name, offset, len, base``: the runs of symbols other than A, C, G, T.  N stays N; no base is drawn."""
    rows = references.select("name", "seq", F.posexplode(F.split("seq", "")).alias("offset", "base")).where("base <> '' AND base NOT RLIKE '[ACGTacgt]'")
    island = F.col("offset") - F.row_number().over(W.partitionBy("name", "base").orderBy("offset"))
    return rows.withColumn("i", island).groupBy("name", "base", "i").agg(F.min("offset").alias("offset"), F.count("*").alias("len")).select("name", "offset", "len", "base")


# ---------------------------------------------------------------- SAM and BAM

_SAM = ("name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_TAGS = ("NM", "AS", "XS", "XM", "XO", "XG")


def sam_alignments(spark: SparkSession, path: str) -> DataFrame:
    """The records of SAM files, header lines left out: the eleven fields and the tags NM, AS, XS, XM, XO,
    XG (numbers) and MD."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    numbers = ("flag", "pos", "mapq", "pnext", "tlen")
    fields = [F.get(parts, F.lit(k)).cast("int").alias(c) if c in numbers else F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(_SAM)]
    tag = lambda t, kind: F.nullif(F.regexp_extract("value", rf"\t{t}:{kind}:([^\t]*)", 1), F.lit(""))
    return lines.select(*fields, *(tag(t, "i").cast("int").alias(t.lower()) for t in _TAGS), tag("MD", "Z").alias("md"))


def reads_of(alignments: DataFrame) -> DataFrame:
    """The reads as they were sequenced: secondary alignments skipped, reverse ones turned back."""
    back = F.col("flag").bitwiseAND(16) != 0
    seq = F.when(back, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back & (F.col("qual") != "*"), F.reverse("qual")).otherwise(F.col("qual"))
    return alignments.where(F.col("flag").bitwiseAND(256) == 0).select("name", seq.alias("seq"), F.when(qual == "*", None).otherwise(qual).alias("qual"))


_BASES4 = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"


def parse_bam(data: bytes) -> Iterator[tuple]:
    """Records of a decompressed BAM file, in the fields of a SAM record and its tags."""
    if data[:4] != b"BAM\x01":
        raise MalformedFile("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    (n,) = struct.unpack_from("<i", data, at)
    at, refs = at + 4, []
    for _ in range(n):
        (size,) = struct.unpack_from("<i", data, at)
        refs.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    ref = lambda k: refs[k] if k >= 0 else "*"
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        rid, pos, name_len, mapq, _, ops, flag, length, next_rid, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        end, p = at + 4 + size, at + 36
        name = data[p : p + name_len - 1].decode()
        p += name_len
        cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{ops}I", data, p)) or "*"
        p += 4 * ops
        packed = data[p : p + (length + 1) // 2]
        seq = "".join(_BASES4[x >> 4] + _BASES4[x & 15] for x in packed)[:length] or "*"
        p += len(packed)
        raw = data[p : p + length]
        qual = "*" if not length or raw[0] == 255 else "".join(chr(q + 33) for q in raw)
        p += length
        tags: dict = {}
        sizes = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
        forms = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
        while p < end:
            key, kind = data[p : p + 2].decode(), chr(data[p + 2])
            p += 3
            if kind in "ZH":
                stop = data.index(0, p)
                tags[key], p = data[p:stop].decode(), stop + 1
            elif kind == "A":
                tags[key], p = chr(data[p]), p + 1
            elif kind == "B":
                p += 5 + sizes[chr(data[p])] * struct.unpack_from("<i", data, p + 1)[0]
            else:
                tags[key] = struct.unpack_from("<" + forms[kind], data, p)[0]
                p += sizes[kind]
        nxt = "*" if next_rid < 0 else "=" if next_rid == rid else ref(next_rid)
        yield (name, flag, ref(rid), pos + 1, mapq, cigar, nxt, next_pos + 1, tlen, seq, qual, *(tags.get(t) for t in _TAGS), tags.get("MD"))
        at = end


_BAM_SCHEMA = (
    "name string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, "
    "nm int, `as` int, xs int, xm int, xo int, xg int, md string"
).replace("`", "")


def bam_alignments(spark: SparkSession, path: str) -> DataFrame:
    """The records of BAM files, columns as of ``sam_alignments``.  Files are read in parallel, each by one
    task that holds it whole, so a set is best kept as files of moderate size, as ``write_bam`` writes it."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    fields = [tuple(x.split()) for x in _BAM_SCHEMA.split(", ")]
    kind = StructType([StructField(n, IntegerType() if t == "int" else StringType()) for n, t in fields])
    quoted = ", ".join(f"`{n}` {t}" for n, t in fields)
    names = [n for n, _ in fields]

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows: list[dict] = []
                for row in parse_bam(gzip.decompress(data)):
                    rows.append(dict(zip(names, row, strict=True)))
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, quoted)


# ---------------------------------------------------------------- by name


def usual_quality(qual: Column, encoding: str) -> Column:
    """A quality string of an encoding (phred33, phred64, solexa, phred) in the usual one, Phred+33."""
    if encoding == "phred33":
        return qual
    value = {"phred": lambda c: c, "phred64": lambda c: max(c - 64, 0), "solexa": S.solexa_step}[encoding]
    codes = range(33, 127) if encoding != "phred" else range(1, 94)
    return F.translate(qual, "".join(map(chr, codes)), "".join(chr(min(value(c), 93) + 33) for c in codes))


def reads(spark: SparkSession, path: str, strands: tuple[str, ...] = ("forward",), max_len: int | None = None, max_reads: int | None = None, encoding: str = "phred33") -> DataFrame:
    """``name, seq, qual, strand`` of a file by its name's ending: fastq, fq, fasta, fa, txt, sam, bam, and
    .gz of the text forms.  One row per strand asked for; the quality turns with its read, and becomes
    Phred+33 from the file's ``encoding``."""
    plain = path.lower().removesuffix(".gz")
    end = plain.rsplit(".", 1)[-1]
    if end in ("fastq", "fq"):
        df = fastq(spark, path)
    elif end == "txt":
        df = text_reads(spark, path)
    elif end in ("fasta", "fa"):
        df = fasta(spark, path).withColumn("qual", F.lit(None).cast("string"))
    elif end == "sam":
        df = reads_of(sam_alignments(spark, path))
    elif end == "bam":
        df = reads_of(bam_alignments(spark, path))
    else:
        raise ValueError(f"unknown kind of read file: {path}")
    df = df.withColumn("qual", usual_quality(F.col("qual"), encoding))
    if max_reads is not None:
        df = df.limit(max_reads)
    if max_len is not None:
        df = df.select("name", F.left("seq", F.lit(max_len)).alias("seq"), F.left("qual", F.lit(max_len)).alias("qual"))
    turned = [s.startswith("reverse") for s in strands]
    quals = F.array(*(F.reverse("qual") if t else F.col("qual") for t in turned))
    both = F.arrays_zip(S.strands(F.col("seq"), strands).alias("s"), quals.alias("q"))
    return df.select("name", F.explode(both).alias("x")).select("name", F.col("x.s.seq").alias("seq"), F.col("x.q").alias("qual"), F.col("x.s.strand").alias("strand"))


def scoring(text: str) -> dict[str, str]:
    """The key and value pairs of a scoring file."""
    return dict(line.split()[:2] for line in text.splitlines() if len(line.split()) >= 2)


def scheme(text: str) -> Scheme:
    """The scores that a scoring file gives: ``match``, the least and the most costly mismatch (``mm-penalty-min``,
    ``mm-penalty-max``) and gaps (``gap-open``, ``gap-ext``); penalties are positive numbers, others stay as by default."""
    got = {k: int(float(v)) for k, v in scoring(text).items() if k in ("match", "mm-penalty-min", "mm-penalty-max", "gap-open", "gap-ext")}
    plain = Scheme()
    most = got.get("mm-penalty-max")
    least = got.get("mm-penalty-min", most)
    return Scheme(
        got.get("match", plain.match), plain.mismatch if least is None else -least,
        -got["gap-open"] if "gap-open" in got else plain.gap_open, -got["gap-ext"] if "gap-ext" in got else plain.gap_ext,
        None if most is None or most == least else -most,
    )


def scheme_file(spark: SparkSession, path: str) -> Scheme:
    """The same of a file; only that small file reaches the driver."""
    return scheme("\n".join(r.value for r in spark.read.text(path).limit(1000).collect()))


def debug_alignments(spark: SparkSession, path: str) -> DataFrame:
    """The compact form that ``sinks.write`` gives a ``.dbg`` path, with the columns that a comparison of two
    sets takes: ``read_len`` and the numbers of substitution, insertion and deletion symbols of the CIGAR."""
    df = spark.read.parquet(path)
    total = lambda ops: F.aggregate(F.regexp_extract_all("cigar", F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return df.withColumns({"subs": total("M=X"), "ins": total("I"), "dels": total("D"), "read_len": total("M=XIS")})


def batches(reads: DataFrame, order: list[str], max_reads: int, max_bases: int, seq_col: str = "seq") -> DataFrame:
    """Adds ``batch``: reads in the order of ``order`` in runs of at most ``max_reads`` reads that hold fewer than
    ``max_bases`` bases before their last read.  The order is scanned in ranges, not in one task."""
    from ..operators.primitives import scan

    sized = scan(reads.withColumn("__n", F.length(seq_col).cast("long")), order, F.lit(1), "__at", exclusive=True)
    sized = scan(sized, order, F.col("__n"), "__bases", exclusive=True)
    key = F.struct(F.floor(F.col("__at") / max_reads).alias("r"), F.floor(F.col("__bases") / max_bases).alias("b"))
    marks = sized.select(key.alias("__k")).distinct().select("__k", F.col("__k.r").alias("__r"), F.col("__k.b").alias("__b"))
    numbered = scan(marks.withColumn("__o", F.struct("__r", "__b")), ["__r", "__b"], F.lit(1), "batch", exclusive=True).select("__k", "batch")
    return sized.withColumn("__k", key).join(numbered, "__k").drop("__k", "__n", "__at", "__bases")
