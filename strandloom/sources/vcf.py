"""VCF text: scans of calls, dosages and phased haplotypes, and a writer whose parts, in order, make one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered

HEADER = [
    "##fileformat=VCFv4.2",
    "##source=strandloom",
    '##INFO=<ID=IMPQ,Number=1,Type=Float,Description="Quality of the marker, 1 is best">',
    '##INFO=<ID=IMP,Number=0,Type=Flag,Description="Imputed marker">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
]


class Vcf:
    """A scanned file: samples and variants, and its calls in long form. A gzip file is one split; `partitions` deals its lines out after the scan."""

    def __init__(self, spark: SparkSession, path: str, partitions: int | None = None):
        lines = spark.read.text(path)
        head = lines.filter(F.col("value").startswith("#CHROM")).first()
        if head is None:
            raise ValueError(f"{path} has no #CHROM line")
        self.sample_ids = head[0].split("\t")[9:]
        rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
        if partitions:
            rows = rows.repartition(partitions)
        f = F.split("value", "\t")
        fields = rows.select(F.xxhash64("value").alias("_line"), f[0].alias("chrom"), f[1].cast("long").alias("pos"), F.split(f[2], ";").alias("ids"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), F.split(f[8], ":").alias("format"), f[7].alias("info"), F.slice(f, 10, len(self.sample_ids)).alias("calls"))
        # Every line has a number of its own, so rows at one position (split multiallelics) stay apart, and calls need no join to their variants.
        self.lines = numbered(fields, "variant_idx", "pos", "ref", F.array_join("alts", ","), "_line", first="chrom")
        self.variants = self.lines.select("chrom", "pos", "ids", "ref", "alts", "info", "variant_idx")

    def samples(self) -> DataFrame:
        spark = self.lines.sparkSession
        return spark.createDataFrame(list(enumerate(self.sample_ids, 1)), "sample_idx int, sample_id string")

    def _calls(self, field: str) -> DataFrame:
        at = F.array_position("format", field)
        calls = self.lines.select("variant_idx", at.alias("at"), F.posexplode("calls").alias("n", "call"))
        value = F.when(F.col("at") > 0, F.try_element_at(F.split("call", ":"), F.col("at").cast("int")))
        return calls.select("variant_idx", (F.col("n") + 1).alias("sample_idx"), value.alias("v"))

    def genotypes(self) -> DataFrame:
        """Alternative alleles 0, 1, 2; null where a call is missing."""
        a = F.split("v", "[/|]")
        known = F.col("v").rlike("^[01][/|][01]$")
        return self._calls("GT").select("variant_idx", "sample_idx", F.when(known, a[0].cast("int") + a[1].cast("int")).alias("gt"))

    def dosages(self) -> DataFrame:
        return self._calls("DS").select("variant_idx", "sample_idx", F.expr("try_cast(v as float)").alias("ds"))

    def haplotypes(self) -> DataFrame:
        """Alleles of haplotypes 2 s - 1 and 2 s; calls must be phased and complete."""
        a = F.split("v", "\\|")
        checked = F.when(F.col("v").rlike(r"^[01]\|[01]$"), a).otherwise(F.raise_error(F.concat(F.lit("not a phased call: "), F.coalesce("v", F.lit("none")))))
        rows = self._calls("GT").select("variant_idx", "sample_idx", F.posexplode(checked).alias("side", "allele"))
        return rows.select("variant_idx", (2 * F.col("sample_idx") - 1 + F.col("side")).alias("hap_idx"), F.col("allele").cast("int").alias("allele"))


def _call(phased: bool):
    if phased:
        return F.when(F.col("a1").isin(0, 1) & F.col("a2").isin(0, 1), F.concat("a1", F.lit("|"), "a2")).otherwise(F.raise_error(F.lit("an allele is neither 0 nor 1")))
    return F.when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "1/0").when(F.col("g") == 2, "1/1").otherwise(F.raise_error(F.lit("a genotype is none of 0, 1, 2")))


def vcf_lines(calls: DataFrame, variants: DataFrame, scores: DataFrame, phased: bool) -> DataFrame:
    """(variant_idx, line): calls with a1 and a2 (phased) or g; scores (variant_idx, score, typed)."""
    rows = calls.select("variant_idx", "sample_idx", _call(phased).alias("call")).groupBy("variant_idx")
    joined = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "call"))), lambda s: s.call), "\t").alias("calls"))
    info = F.concat(F.lit("IMPQ="), F.coalesce(F.format_string("%.3f", "score"), F.lit("nan")), F.when(F.col("typed"), "").otherwise(";IMP"))
    out = joined.join(variants, "variant_idx").join(scores, "variant_idx")
    return out.select("variant_idx", F.concat_ws("\t", "chrom", "pos", F.coalesce(F.get("ids", F.lit(0)), F.lit(".")), "ref", F.coalesce(F.get("alts", F.lit(0)), F.lit(".")), F.lit("."), F.lit("PASS"), info, F.lit("GT"), "calls").alias("line"))


def joined_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file of the parts in a folder, in order, copied stream by stream; parts compressed with gzip make one gzip file. The folder goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    for name in names:
        if name.startswith("part-"):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    out.close()
    fs.delete(where, True)


def write_vcf(lines: DataFrame, sample_ids: list[str], path: str, one_file: bool = True) -> None:
    """lines (variant_idx, line) as a .vcf or .vcf.gz file; with one_file=False as a folder of parts, which together are that file."""
    spark = lines.sparkSession
    folder = f"{path}.parts" if one_file else path
    head = [*HEADER, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *sample_ids])]
    header = spark.createDataFrame([(i - len(head), text) for i, text in enumerate(head)], "variant_idx int, line string")
    header.unionByName(lines).repartitionByRange("variant_idx").sortWithinPartitions("variant_idx").select("line").write.mode("overwrite").text(folder, compression="gzip" if path.endswith(".gz") else "none")
    if one_file:
        joined_parts(spark, folder, path)
