"""The engine's entry points: compress a panel, phase and impute targets, decode compact results, estimate ancestry."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ancestry, impute, panel, phasing, search, validate
from ..operators.order import numbered
from ..sources import bgen, plink, store, vcf
from .settle import settled, unsettle


@dataclass
class Target:
    variants: DataFrame
    samples: DataFrame
    genotypes: DataFrame


def import_target(spark: SparkSession, path: str, dosage: bool = False) -> Target:
    """A target by its file's extension: .vcf and .vcf.gz, .bgen, or the common prefix of .bed, .bim and .fam."""
    if path.endswith((".vcf", ".vcf.gz")):
        found = vcf.Vcf(spark, path)
        calls = found.dosages().withColumnRenamed("ds", "gt") if dosage else found.genotypes()
        return Target(found.variants, found.samples(), calls)
    if path.endswith(".bgen"):
        variants, samples, rows = _bgen(spark, path)
        return Target(variants, samples, rows.select("variant_idx", "sample_idx", F.col("ds").alias("gt")))
    if dosage:
        raise ValueError("PLINK files hold no dosages")
    return Target(*plink.read_plink(spark, path))


def _bgen(spark: SparkSession, path: str):
    spark.dataSource.register(bgen.BgenSource)
    rows = spark.read.format("bgen").load(path)
    keys = numbered(rows.filter("sample_idx = 1").select("line", "chrom", "pos", "ids", "ref", "alts"), "variant_idx", "pos", "ref", "line", first="chrom")
    samples = spark.createDataFrame(list(enumerate(bgen.sample_names(path), 1)), "sample_idx int, sample_id string")
    return keys.drop("line"), samples, rows.join(keys.select("line", "variant_idx"), "line")


def import_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, samples, haplotypes) of a phased, complete .vcf, .vcf.gz or .bgen file."""
    if path.endswith((".vcf", ".vcf.gz")):
        found = vcf.Vcf(spark, path)
        return found.variants, found.samples(), found.haplotypes()
    if path.endswith(".bgen"):
        variants, samples, rows = _bgen(spark, path)
        sides = F.posexplode(F.when(F.col("phased") & F.col("a1").isNotNull(), F.array("a1", "a2")).otherwise(F.raise_error(F.lit("a variant isn't phased or complete"))))
        long = rows.select("variant_idx", "sample_idx", sides.alias("side", "allele"))
        return variants, samples, long.select("variant_idx", (2 * F.col("sample_idx") - 1 + F.col("side")).alias("hap_idx"), "allele")
    raise ValueError(f"{path}: a reference must be .vcf, .vcf.gz or .bgen")


def compress(haplotypes: DataFrame, variants: DataFrame, samples: DataFrame, typed_positions: DataFrame, d: int = 1000, minwidth: int = 0, overlap: float = 0.0) -> dict[str, DataFrame]:
    """The tables of a compressed panel (see sources.store). With overlap, pairs are searched on windows with flanks; all else goes by the windows themselves.

    `typed` and the typed haplotypes' strings (`_strands`) are settled for the lazy tables that read them; give them back by unsettle() when those are written.
    """
    if not 0 <= overlap <= 1:
        raise ValueError("overlap must lie between 0 and 1")
    spark = haplotypes.sparkSession
    typed = settled(panel.typed_index(typed_positions, variants), "typed")
    n_typed, n_variants = typed.count(), variants.agg(F.max("variant_idx")).first()[0]
    whole, on_typed = panel.strands(haplotypes), settled(panel.strands(haplotypes.join(typed.select("variant_idx", "x_idx"), "variant_idx"), "x_idx"), "strands")
    ranges = panel.bisected(on_typed, n_typed, d, minwidth)
    table = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(ranges, 1)], "window int, x_start int, x_end int")
    windows = panel.windows_from_ranges(table, typed, n_variants)
    out = {
        "variants": variants, "samples": samples, "typed": typed, "windows": windows, "frequency": panel.allele_frequency(haplotypes),
        "unique_all": panel.unique_haplotypes(whole, windows), "unique_typed": panel.unique_haplotypes(on_typed, windows, "x_start", "x_end"), "_strands": on_typed,
    }
    if overlap:
        out["padded"] = panel.padded(windows, overlap, n_typed)
        out["unique_padded"] = panel.unique_haplotypes(on_typed, out["padded"], "x_start_pad", "x_end_pad")
    return out


def compress_haplotypes(spark: SparkSession, reference: str, target: str, out: str, d: int = 1000, minwidth: int = 0, overlap: float = 0.0) -> None:
    """Compress a reference file to a panel directory for targets with the markers of `target`."""
    variants, samples, haplotypes = import_reference(spark, reference)
    typed = import_target(spark, target).variants
    validate.checked(typed, variants)
    tables = compress(haplotypes, variants, samples, typed, d, minwidth, overlap)
    store.save_panel(tables, out)
    for name in ("typed", "_strands"):
        unsettle(tables[name])


def panel_statistics(spark: SparkSession, panel_dir: str) -> dict[str, DataFrame]:
    """Statistics of a panel by its directory: summary, width of each window, unique haplotypes of each window."""
    tables = store.load_panel(spark, panel_dir)
    return {"summary": panel.summary(tables["windows"], tables["unique_typed"]), "widths": panel.window_widths(tables["windows"]), "haplotypes": panel.haplotypes_per_window(tables["unique_typed"])}


@dataclass
class Phased:
    """Results of a run. Labels, segments and what the lazy tables read (windows' alleles, errors) are kept until release()."""

    labels: DataFrame
    segments: DataFrame
    dosage: DataFrame | None = None
    variant_scores: DataFrame | None = None
    sample_scores: DataFrame | None = None
    timings: dict = field(default_factory=dict)  # windows, mean_haplotypes, n_typed, n_variants, and seconds of each stage
    kept: list = field(default_factory=list)

    def release(self) -> None:
        for table in self.kept:
            unsettle(table)

    def report(self) -> str:
        """The run in lines: windows, unique haplotypes, seconds by stage."""
        t = self.timings
        seconds = [f"    {name.removesuffix('_s').replace('_', ' '):<16}= {t[name]:.6g} seconds" for name in t if name.endswith("_s")]
        return "\n".join([f"Total windows = {t['windows']}, averaging ~ {round(t['mean_haplotypes'])} unique haplotypes per window.", "", "Timings:", *seconds])


def phase_tables(
    genotypes: DataFrame, tables: dict[str, DataFrame], rescreen: bool = False, max_haplotypes: int = 800, stepwise: int | None = None,
    thinning_factor: int | None = None, scale_allelefreq: bool = False, dynamic_programming: bool = False, impute_: bool = True, phase: bool = True,
) -> Phased:
    """Phase typed genotypes (panel variant_idx, sample_idx, gt) against a compressed panel and impute from it.

    Labels are complete haplotype indices throughout; alleles come from the panel's unique haplotypes, joined by window and haplotype.
    """
    if dynamic_programming:
        raise ValueError("phasing by dynamic programming is not supported; see operators.phasing.connect_pairs")
    typed, windows, unique = tables["typed"], tables["windows"], tables["unique_typed"]
    n_typed, n_variants = typed.count(), tables["variants"].agg(F.max("variant_idx")).first()[0]
    n_windows, mean = tables["unique_typed"].groupBy("window").agg(F.max("unique_idx").alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    timings = {"windows": n_windows, "mean_haplotypes": mean, "n_typed": n_typed, "n_variants": n_variants}
    began = time.time()
    filled = search.mean_filled(genotypes)
    vectors = settled(search.window_vectors(filled, windows, typed), "vectors")
    if "padded" in tables:
        wide = tables["padded"].select("window", F.col("x_start_pad").cast("int").alias("x_start"), F.col("x_end_pad").cast("int").alias("x_end"))
        searched, looked_at, looked_up = wide, search.window_vectors(filled, wide, typed), tables["unique_padded"]
    else:
        searched, looked_at, looked_up = windows, vectors, unique
    weights = search.window_weights(searched, typed, search.allele_weights(tables["frequency"])) if scale_allelefreq else None
    strategy = "stepwise" if stepwise else "thinning" if thinning_factor else "rescreen" if rescreen else "global"
    best = settled(search.pair_search(looked_at, looked_up, strategy, weights, r=stepwise or 1, keep=thinning_factor or 20, max_haplotypes=max_haplotypes, rescreen=rescreen), "best")
    timings["pair_search_s"] = time.time() - began
    labels = settled(phasing.phase_fold(phasing.with_members(best, panel.window_haps(looked_up))), "labels")
    points = phasing.breakpoints(phasing.adjacent(labels, vectors, unique))
    in_typed = phasing.mosaics(labels, points, windows)
    segments = settled(impute.bounded(impute.lifted(in_typed, typed), n_variants), "segments")
    timings["phasing_s"] = time.time() - began - timings["pair_search_s"]
    unsettle(best)
    began = time.time()
    strands = settled(impute.strands_by_window(segments, windows, tables["unique_all"]), "alleles")
    errors = settled(impute.squared_errors(strands, vectors, windows, typed), "errors")
    unsettle(vectors)
    timings["alleles_s"] = time.time() - began
    dosage = impute.dosages_of(strands)
    if not impute_:
        dosage = dosage.join(typed.select("variant_idx"), "variant_idx", "left_semi")
    scores = settled(impute.scores_by_variant(errors, typed), "scores")
    out = Phased(labels, segments, timings=timings, kept=[labels, segments, strands, errors, scores])
    out.dosage = dosage if phase else impute.keep_observed(dosage, genotypes)
    out.variant_scores = impute.variant_scores(scores, tables["variants"] if impute_ else typed)
    out.sample_scores = impute.scores_by_sample(errors)
    return out


def phase(spark: SparkSession, target: str, panel_dir: str, out: str, impute_: bool = True, phase: bool = True, dosage: bool = False, one_file: bool = True, **options) -> Phased:
    """Phase and impute a target file against a compressed panel; out ends in .vcf, .vcf.gz or .loom (a folder with the compact result).

    The compact form holds phased segments alone, so it needs phase=True. Sample scores go to a file beside it whose name ends in .sample.error.
    """
    compact = out.endswith(store.COMPACT)
    if not compact and not out.endswith((".vcf", ".vcf.gz")):
        raise ValueError(f"{out}: the name of the output must end in .vcf, .vcf.gz or {store.COMPACT}")
    if compact and not phase:
        raise ValueError("the compact form is phased")
    began = time.time()
    tables = store.load_panel(spark, panel_dir)
    found = import_target(spark, target, dosage)
    validate.checked(found.variants, tables["variants"])
    lift = found.variants.select(F.col("variant_idx").alias("target_idx"), "pos").join(tables["variants"].select("pos", "variant_idx"), "pos").drop("pos")
    genotypes = found.genotypes.withColumnRenamed("variant_idx", "target_idx").join(lift, "target_idx").drop("target_idx")
    imported = time.time() - began
    result = phase_tables(genotypes, tables, impute_=impute_, phase=phase, **options)
    now = time.time()
    if compact:
        store.save_phase(result.segments, found.samples, out)
    else:
        lines = vcf.vcf_lines(result.dosage, tables["variants"], result.variant_scores, phase)
        vcf.write_vcf(lines, [r["sample_id"] for r in found.samples.orderBy("sample_idx").collect()], out, one_file)
        names = result.sample_scores.join(found.samples, "sample_idx").orderBy("sample_idx").select(F.col("sample_id").alias("sampleID"), F.col("score").alias("error"))
        store.write_report(names, out.removesuffix(".gz").removesuffix(".vcf") + ".sample.error")
    result.timings |= {"import_s": imported, "imputation_and_writing_s": time.time() - now, "total_s": time.time() - began}
    return result


def convert_compressed(spark: SparkSession, phase_dir: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """(alleles per strand and their sum, sample ids) of a compact result, decoded with the full panel's file or a compressed panel's directory."""
    segments, samples = store.load_phase(spark, phase_dir)
    if reference.endswith((".vcf", ".vcf.gz", ".bgen")):
        return impute.dosages(impute.expanded(segments, import_reference(spark, reference)[2])), samples
    tables = store.load_panel(spark, reference)
    return impute.dosages_of(impute.strands_by_window(segments, tables["windows"], tables["unique_all"])), samples


def _reference_populations(tables: dict[str, DataFrame], sample_to_population: DataFrame, populations: list[str]) -> DataFrame:
    rows = tables["samples"].join(sample_to_population, "sample_id", "left").select(F.col("sample_idx").alias("ref_sample"), "population")
    lost = [r["population"] for r in rows.select("population").distinct().collect() if r["population"] not in populations]
    if lost:
        raise ValueError(f"populations not listed: {sorted(map(str, lost))}")
    return rows


def global_admixture(result: Phased, tables: dict[str, DataFrame], sample_to_population: DataFrame, populations: list[str]) -> DataFrame:
    """A row per sample, a column per population."""
    ref = _reference_populations(tables, sample_to_population, populations)
    return ancestry.global_matrix(ancestry.composition(result.segments, ref, result.timings["n_variants"]), populations)


def local_admixture(result: Phased, tables: dict[str, DataFrame], sample_to_population: DataFrame, populations: list[str], colors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fractions in columns, filled up with 0; painted segments with colours)."""
    if len(colors) != len(populations):
        raise ValueError("one colour per population")
    ref = _reference_populations(tables, sample_to_population, populations)
    paint = ancestry.painted(result.segments, ref, result.timings["n_variants"])
    dim = paint.sparkSession.createDataFrame(list(zip(populations, colors)), "population string, color string")
    longest = paint.agg(F.max("seg_no")).first()[0] or 0
    return ancestry.local_matrix(paint, longest), paint.join(dim, "population")


def admixture_global(spark: SparkSession, target: str, panel_dir: str, sample_to_population: DataFrame, populations: list[str], q_out: str = "ancestry.Q", out: str = "ancestry" + store.COMPACT) -> DataFrame:
    """Phase a target file against a compressed panel (result in `out`) and write each sample's shares of the populations to q_out, without a column of sample ids."""
    result = phase(spark, target, panel_dir, out)
    q = global_admixture(result, store.load_panel(spark, panel_dir), sample_to_population, populations)
    store.write_report(q.orderBy("sample_idx").drop("sample_idx"), q_out)
    return q


def admixture_local(spark: SparkSession, target: str, panel_dir: str, sample_to_population: DataFrame, populations: list[str], colors: list[str], out: str = "ancestry" + store.COMPACT) -> tuple[DataFrame, DataFrame]:
    """Phase a target file against a compressed panel (result in `out`) and paint its strands."""
    if len(colors) != len(populations):
        raise ValueError("one colour per population")
    return local_admixture(phase(spark, target, panel_dir, out), store.load_panel(spark, panel_dir), sample_to_population, populations, colors)
