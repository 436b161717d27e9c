"""Readers of sequence, variant, alignment, annotation and graph files, as DataFrames of records.

Every path goes through Spark's own readers, so any store that Spark reaches will do; ``.gz`` and ``.bgz`` are unpacked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _unpacked(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a blocked gzip file, one row a file (such files have no splits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                parts = []
                while data:
                    one = zlib.decompressobj(31)
                    parts.append(one.decompress(data))
                    data = one.unused_data
                out.append(b"".join(parts).decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(value): the file cut at each line that begins with ``mark``."""
    if path.endswith(".bgz"):
        whole = _unpacked(spark, path).select(F.explode(F.split("value", "\n" + mark)).alias("value"))
    else:
        whole = spark.read.text(path, lineSep="\n" + mark)
    return whole.select(F.regexp_replace("value", f"^{mark}", "").alias("value")).where(F.trim("value") != "")


def lines(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".bgz"):
        return _unpacked(spark, path).select(F.explode(F.split("value", "\r?\n")).alias("value"))
    return spark.read.text(path)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence)"""
    r = records(spark, path, ">")
    head = F.regexp_extract("value", r"\A[^\r\n]*", 0)
    name = F.element_at(F.split(F.trim(head), r"\s+"), 1)
    return r.select(name.alias("name"), F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"(?U)\s", "").alias("sequence"))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def fasta_index(spark: SparkSession, path: str) -> DataFrame | None:
    """(name, length, offset, bases, width) of the index beside a FASTA file, if there is one."""
    if not exists(spark, path + ".fai"):
        return None
    return spark.read.csv(path + ".fai", sep="\t", schema="name string, length long, offset long, bases long, width long")


def fasta_slices(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (name, start, end, ...) with the slices [start, end) of an external file's sequences.

    With an index of a plain file whose lines have one width, the file is read as lines numbered by their place in it, and
    only the lines that slices need leave the scan: no sequence is put together. Else the records are joined by name.
    """
    from strandwork.functions.scalars import slice_of

    index = fasta_index(spark, path)
    if index is None or path.endswith((".gz", ".bgz")):
        return wanted.join(fasta(spark, path), "name").withColumn("sequence", slice_of("sequence", "start", "end"))
    order = W.orderBy("offset")  # one row for each sequence of the index
    index = index.withColumn("lines", F.ceil(F.col("length") / F.col("bases"))).withColumn("first", F.row_number().over(order) + F.coalesce(F.sum("lines").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    asked = wanted.withColumn("_row", F.struct(*[F.col(c) for c in wanted.columns])).join(index, "name")
    low, high = F.greatest("start", F.lit(0)), F.least("end", "length")
    asked = asked.withColumn("low", low).withColumn("high", high).where("low < high")
    span = F.sequence(F.floor(F.col("low") / F.col("bases")), F.floor((F.col("high") - 1) / F.col("bases")))
    pieces = asked.select("_row", "first", "bases", "low", "high", F.explode(span).alias("k")).withColumn("line", (F.col("first") + F.col("k")).cast("long"))
    cut = pieces.join(numbered_lines(spark, path), "line")
    a = F.greatest(F.col("low") - F.col("k") * F.col("bases"), F.lit(0))
    b = F.least(F.col("high") - F.col("k") * F.col("bases"), F.col("bases"))
    parts = cut.select("_row", "k", slice_of("value", a, b).alias("part"))
    joined = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("p"))
    return joined.select("_row.*", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("sequence"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): a file's lines, counted from 0 in its order."""
    text = lines(spark, path).select("value", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    counts = text.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each split of the file
    before = counts.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return text.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")


class Gfa:
    """Tables of a GFA file, version 1 or 2: segments, links, steps of paths and walks (line grows with the place in the file)."""

    def __init__(self, spark: SparkSession, path: str):
        split = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("line")).where("size(c) > 1")
        self.lines, c = split, F.col("c")
        tag = lambda t: split.where(c[0] == t)
        self.segments = tag("S").select(c[1].alias("segment"), F.when(self.version2(c), F.get(c, F.lit(3))).otherwise(c[2]).alias("sequence"))
        self.links = tag("L").select(c[1].alias("source"), c[2].alias("source_strand"), c[3].alias("target"), c[4].alias("target_strand"))
        names = tag("P").select("line", c[1].alias("name"), F.posexplode(F.split(c[2], ",")).alias("step", "x"))
        paths = names.select("line", "name", F.lit(None).cast("string").alias("walk_sample"), "step", F.regexp_replace("x", "[+-]$", "").alias("segment"), F.right("x", F.lit(1)).alias("strand"))
        walks = tag("W").select(
            "line", c[1].alias("walk_sample"), c[3].alias("contig"), F.posexplode(F.regexp_extract_all(c[6], F.lit(r"([><][^><]+)"), F.lit(1))).alias("step", "x")
        )
        walks = walks.select("line", F.col("contig").alias("name"), "walk_sample", "step", F.substring("x", 2, 1 << 30).alias("segment"), F.when(F.left("x", F.lit(1)) == "<", "-").otherwise("+").alias("strand"))
        self.steps = paths.unionByName(walks)

    @staticmethod
    def version2(c):
        return F.get(c, F.lit(2)).rlike(r"^\d+$") & F.get(c, F.lit(3)).rlike(r"^[A-Za-z*]+$")

    def version(self) -> float:
        """The version of the header; 1.0 without one."""
        head = self.lines.where(F.col("c")[0] == "H").select(F.regexp_extract(F.array_join("c", " "), r"VN:Z:([\d.]+)", 1).alias("v")).first()
        return float(head.v) if head and head.v else 1.0

    def gaps(self) -> DataFrame:
        """(first, last): runs of numbers between the smallest and the largest numeric segment id that no segment has."""
        n = self.segments.select(F.col("segment").cast("long").alias("n")).where("n is not null").distinct()
        # neighbours meet in blocks of numbers; each block's last number is carried to the next one that has any
        block = n.withColumn("block", F.floor(F.col("n") / 65536))
        inside = block.withColumn("before", F.lag("n").over(W.partitionBy("block").orderBy("n")))
        ends = block.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        across = ends.withColumn("before", F.lag("high").over(W.orderBy("block"))).select("before", F.col("low").alias("n"))  # a row for each block
        return inside.select("before", "n").unionByName(across).where("n - before > 1").select((F.col("before") + 1).alias("first"), (F.col("n") - 1).alias("last"))

    def ids_are_numbers(self) -> bool:
        return self.segments.where(~F.col("segment").rlike(r"^\d+$")).isEmpty()

    def ids_are_compact(self) -> bool:
        """Whether the segment ids are the numbers from the smallest to the largest."""
        return self.ids_are_numbers() and self.gaps().isEmpty()

    def haplotypes(self) -> DataFrame:
        """(genome, haplotype, contigs): paths named genome#haplotype#contig."""
        part = F.split("name", "#")
        return self.steps.select("name").distinct().where(F.size(part) == 3).groupBy(part[0].alias("genome"), part[1].alias("haplotype")).agg(F.sort_array(F.collect_list(part[2])).alias("contigs"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """(record, chrom, pos, ref, alts, info, sample, gt), one row for each record and sample."""
    text = lines(spark, path).where("value not like '##%' and trim(value) <> ''")
    head = text.where("value like '#CHROM%'").first()
    samples = head.value.split("\t")[9:] if head else []  # the header is one line
    c = F.split("value", "\t")
    rows = text.where("value not like '#%'").select(
        F.xxhash64("value").alias("record"), c[0].alias("chrom"), c[1].cast("long").alias("pos"), c[3].alias("ref"), F.split(c[4], ",").alias("alts"),
        F.when(c[7] != ".", F.str_to_map(c[7], F.lit(";"), F.lit("="))).alias("info"), F.split(F.get(c, F.lit(8)), ":").alias("format"), F.slice(c, 10, max(1, len(samples))).alias("calls"),
    )
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    each = rows.select("*", F.posexplode(names).alias("place", "sample")) if samples else rows.withColumn("place", F.lit(0)).withColumn("sample", F.lit(None).cast("string"))
    call = F.split(F.get("calls", F.col("place")), ":")
    gt = F.get(call, (F.array_position("format", "GT") - 1).cast("int"))
    return each.select("record", "chrom", "pos", "ref", "alts", "info", "sample", gt.alias("gt"))


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """(line, query, side, path, path_start, path_end, matches, strand): alignments of flanks named <id>_left and <id>_right."""
    c = F.split("value", "\t")
    rows = lines(spark, path).select("value", F.monotonically_increasing_id().alias("line")).where(F.size(c) >= 12)
    q = c[0]
    return rows.select(
        "line", F.regexp_replace(q, "_(left|right)$", "").alias("query"), F.regexp_extract(q, "_(left|right)$", 1).alias("side"), c[4].alias("strand"),
        c[5].alias("path"), c[7].cast("long").alias("path_start"), c[8].cast("long").alias("path_end"), c[9].cast("long").alias("matches"),
    ).where("side <> ''")


def gaf_steps(rows: DataFrame) -> DataFrame:
    """rows with step, segment, orientation of each segment of an alignment's path."""
    x = F.posexplode(F.regexp_extract_all("path", F.lit(r"([><]?[^><]+)"), F.lit(1))).alias("step", "x")
    return rows.select("*", x).withColumn("orientation", F.when(F.col("x").startswith("<"), "-").otherwise("+")).withColumn("segment", F.regexp_replace("x", "^[><]", "")).drop("x")


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """(id, left, sequence, right) of a CSV with a header; a missing id is made of the row's number, from 0."""
    rows = spark.read.csv(path, header=True, schema="id string, left string, sequence string, right string", enforceSchema=False)
    held = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each split of the file
    before = counts.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("_at")).cast("string")
    return held.join(F.broadcast(before), "_part").select(F.coalesce("id", F.concat(F.lit("_gen_"), number)).alias("id"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("left", "sequence", "right")])


def library(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, part) of a CSV without a header; empty cells hold no part."""
    cells = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("row", "value"))
    return rows.select("row", F.posexplode(cells).alias("column", "part")).where("part <> ''").select("row", F.col("column").cast("long").alias("column"), "part")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, end, rest): rest holds the other fields, joined by tabs."""
    c = F.split("value", "\t")
    return lines(spark, path).where("trim(value) <> '' and value not like '#%'").select(
        c[0].alias("name"), c[1].cast("long").alias("start"), c[2].cast("long").alias("end"), F.array_join(F.slice(c, 4, 1 << 20), "\t").alias("rest")
    )


def gff(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, source, type, start, end, score, strand, phase, attributes), bounds one-based and inclusive."""
    c = F.split("value", "\t")
    names = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
    return lines(spark, path).where((F.size(c) >= 9) & ~F.col("value").startswith("#")).select(
        *[(c[k].cast("long") if n in ("start", "end") else c[k]).alias(n) for k, n in enumerate(names)]
    )


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, sequence, edits): records with their editing history.

    edits: array of (start, end, old, new, type), zero-based on the edited sequence, by start; a feature is an edit if its note speaks
    of an editing history, and Original_Bases holds what stood there before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_genbank_record(t) for t in batch.column("value").to_pylist()], schema=_GENBANK)

    text = records(spark, path, "LOCUS")
    return text.mapInArrow(run, "name string, kind string, sequence string, edits array<struct<start:long,end:long,old:string,new:string,type:string>>")


_EDIT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("old", pa.string()), ("new", pa.string()), ("type", pa.string())])
_GENBANK = pa.schema([("name", pa.string()), ("kind", pa.string()), ("sequence", pa.string()), ("edits", pa.list_(_EDIT))])


def _genbank_record(text: str) -> dict:
    import re

    head, _, rest = text.partition("\n")
    words = head.split()
    kind = next((w for w in words if re.fullmatch(r"(?:ds-|ss-)?(?:DNA|RNA|mRNA|AA|PROTEIN)", w, re.I)), None)
    features, _, origin = rest.partition("\nORIGIN")
    sequence = "".join(re.findall(r"[A-Za-z]+", origin.split("\n//")[0].partition("\n")[2]))
    edits = []
    block = features.partition("FEATURES")[2]
    for m in re.finditer(r"\n {5}(\S+) +([^\n]+(?:\n {21}(?!/)[^\n]+)*)((?:\n {21}[^\n]*)*)", block):
        quals = dict(re.findall(r"/([\w]+)=\"?([^\"]*?)\"?(?=\s*\n {21}/|\s*\Z)", re.sub(r"\n {21}(?!/)", " ", m.group(3)), re.S))
        note = quals.get("note", "")
        if "Editing History" not in note:
            continue
        bounds = [int(x) for x in re.findall(r"\d+", m.group(2))]
        start, end = bounds[0] - 1, bounds[-1]
        what = re.search(r"Editing History (\w+)", note).group(1)
        old = re.sub(r"\s", "", quals.get("Original_Bases", ""))
        if "^" in m.group(2):  # between two letters: what stood there is gone
            start, end = bounds[0], bounds[0]
        edits.append({"start": start, "end": end, "old": old, "new": sequence[start:end], "type": what.lower()})
    return {"name": words[0] if words else "", "kind": kind, "sequence": sequence, "edits": sorted(edits, key=lambda e: (e["start"], e["end"]))}


def wild_type(rows: DataFrame) -> DataFrame:
    """rows with the sequence before all edits, and changes: the edits in its coordinates, by start."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,new:string>>").alias("changes"))

    def step(acc, e):
        done = F.concat(acc["done"], F.substring(F.col("sequence"), (acc["at"] + 1).cast("int"), F.greatest(e["start"] - acc["at"], F.lit(0)).cast("int")))
        begin = F.length(done).cast("long")
        change = F.struct(begin.alias("start"), (begin + F.length(e["old"])).cast("long").alias("end"), e["new"].alias("new"))
        return F.struct(F.concat(done, e["old"]).alias("done"), e["end"].alias("at"), F.concat(acc["changes"], F.array(change)).alias("changes"))

    folded = F.aggregate("edits", start, step)
    whole = F.concat(F.col("f.done"), F.substring("sequence", (F.col("f.at") + 1).cast("int"), F.length("sequence")))
    return rows.withColumn("f", folded).withColumn("wild_type", whole).withColumn("changes", F.col("f.changes")).drop("f")
