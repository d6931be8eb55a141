"""Queries over the driver's tables, one or more per operator, with the SQL that an independent engine runs for the same rows.

A query's columns are listed once as "name:kind ..." (i integer, f double rounded to six digits, s string, b boolean), and
both sides cast by that list.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phasing as pure
from ..operators import ancestry, impute, panel, phasing, search, stats, validate
from . import derive as D
from .settle import settled
from .oracle import BISECTION, BY_BISECTION, POINTS, UNTYPED, path_sql, sql, unique_windows

QUERIES: dict[str, tuple] = {}


def query(name: str, columns: str, body: str | None = None, **instead: str):
    """instead: expressions of the SQL library that this query's SQL has its own of."""
    def keep(f):
        QUERIES[name] = (f, columns, body, instead)
        return f

    return keep


def shaped(df: DataFrame, columns: str) -> DataFrame:
    kinds = {"i": lambda c: c.cast("long"), "f": lambda c: F.round(c.cast("double"), 6), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
    return df.select(*(kinds[k](F.col(f"`{n}`")).alias(n) for n, k in (c.split(":") for c in columns.split())))


class Fixture:
    """What most queries start from. Members are lazy plans, but for labels, segments and scores, which several plans read: those are settled, which keeps plans small."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._segments = spark, sf_dir, None
        self.hap, self.windows, self.typed, self.variants = D.haplotypes(spark, sf_dir), D.windows(spark), D.typed(spark), D.variants(spark)

    def geno(self):
        return D.genotypes(self.spark, self.dir)

    def unique(self, typed: bool = True):
        return panel.unique_haplotypes(self.typed_strands(), self.windows, "x_start", "x_end") if typed else panel.unique_haplotypes(panel.strands(self.hap), self.windows)

    def typed_strands(self):
        return panel.strands(self.hap.join(self.typed.select("variant_idx", "x_idx"), "variant_idx"), "x_idx")

    def bisected(self, **options):
        """The ranges of bisection with their numbers of different haplotypes."""
        strands = self.typed_strands().persist()
        ranges = self.spark.createDataFrame(panel.bisected(strands, 48, **options), "x_start int, x_end int").selectExpr("*", "x_start as lo", "x_end as hi")
        strands.unpersist()
        return panel.distinct_counts(self.typed_strands(), ranges, ["x_start", "x_end"]).withColumnRenamed("n", "n_unique")

    def vectors(self):
        return search.window_vectors(search.mean_filled(self.geno()), self.windows, self.typed)

    def best(self, **options):
        return search.pair_search(self.vectors(), self.unique(), **options)

    def members(self):
        return panel.window_haps(self.unique())

    def mosaic(self, form="label"):
        """Phased segments in typed coordinates."""
        labels = settled(self.labels(), "labels")
        return phasing.mosaics(labels, phasing.breakpoints(phasing.adjacent(labels, self.vectors(), self.unique())), self.windows, form)

    def segments(self):
        """Phased segments in panel coordinates: pair search, survivor fold, break points, mosaic, lift."""
        if self._segments is None:
            self._segments = settled(impute.bounded(impute.lifted(self.mosaic(), self.typed), D.N_VARIANTS), "segments")
        return self._segments

    def dosage(self):
        return impute.dosages_of(self.strands())

    def strands(self):
        return impute.strands_by_window(self.segments(), self.windows, self.unique(False))

    def errors(self):
        return impute.squared_errors(self.strands(), self.vectors(), self.windows, self.typed)

    def scores(self):
        return settled(impute.scores_by_variant(self.errors(), self.typed), "scores")

    def alleles(self):
        return impute.alleles_of(self.strands())

    def labels(self):
        return phasing.phase_fold(phasing.with_members(self.best(), self.members()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Fixture(spark, sf_dir)
    return shaped(impute.variant_scores(x.scores(), x.variants), "variant_idx:i score:f typed:b")


def queries() -> dict:
    def bound(f, columns):
        return lambda spark, sf_dir: shaped(f(Fixture(spark, sf_dir)), columns)

    return {name: bound(f, columns) for name, (f, columns, *_) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql(body, columns, **instead) for name, (_, columns, body, instead) in QUERIES.items() if body}


# Data model and validation

@query("panel_haplotypes", "variant_idx:i hap_idx:i allele:i", "SELECT * FROM hap")
def _(x):
    return x.hap


@query("target_genotypes", "sample_idx:i variant_idx:i gt:i", "SELECT * FROM geno")
def _(x):
    return x.geno()


@query("alt_allele_freq", "variant_idx:i alt_freq:f", "SELECT * FROM freq")
def _(x):
    return panel.allele_frequency(x.hap)


@query("marker_alignment", "pos:i x_idx:i variant_idx:i", "SELECT t.pos, row_number() OVER (ORDER BY v.variant_idx) AS x_idx, v.variant_idx FROM typed t JOIN variants v ON v.pos = t.pos")
def _(x):
    return panel.typed_index(x.typed, x.variants)


@query("missing_typed_check", "pos:i", "SELECT pos + CASE WHEN variant_idx % 9 = 0 THEN 5 ELSE 0 END AS pos FROM typed WHERE pos + CASE WHEN variant_idx % 9 = 0 THEN 5 ELSE 0 END NOT IN (SELECT pos FROM variants)")
def _(x):
    moved = x.typed.withColumn("pos", F.col("pos") + F.when(F.col("variant_idx") % 9 == 0, 5).otherwise(0))
    return validate.unknown_markers(moved, x.variants)


@query("ref_allele_mismatch", "pos:i ref:s panel_ref:s", "SELECT t.pos, CASE WHEN t.variant_idx % 5 = 0 THEN 'N' ELSE t.ref END AS ref, v.ref AS panel_ref FROM typed t JOIN variants v ON v.pos = t.pos WHERE CASE WHEN t.variant_idx % 5 = 0 THEN 'N' ELSE t.ref END <> v.ref")
def _(x):
    return validate.reference_mismatches(x.typed.withColumn("ref", F.when(F.col("variant_idx") % 5 == 0, "N").otherwise(F.col("ref"))), x.variants)


@query("chromosome_check", "chrom:s n_variants:i", "SELECT chrom, count(*) AS n_variants FROM typed GROUP BY 1")
def _(x):
    return validate.chromosomes(x.typed)


@query("duplicate_markers", "pos:i variant_idx:i first_idx:i", "SELECT * FROM (SELECT pos // 30 AS pos, variant_idx, min(variant_idx) OVER (PARTITION BY pos // 30) AS first_idx FROM variants) WHERE variant_idx > first_idx")
def _(x):
    return validate.duplicate_markers(x.variants.withColumn("pos", F.floor(F.col("pos") / 30)))


@query("genotype_domain_check", "sample_idx:i variant_idx:i gt:i", "SELECT sample_idx, variant_idx, gt + CASE WHEN variant_idx = 1 THEN 2 ELSE 0 END AS gt FROM geno WHERE gt + CASE WHEN variant_idx = 1 THEN 2 ELSE 0 END NOT IN (0, 1, 2)")
def _(x):
    return validate.out_of_domain(x.geno().withColumn("gt", F.col("gt") + F.when(F.col("variant_idx") == 1, 2).otherwise(0)))


# Panel compression

@query("window_bisection", "x_start:i x_end:i n_unique:i", BISECTION)
def _(x):
    return x.bisected(d=100)


@query("window_boundaries", "window:i x_start:i x_end:i h_start:i h_end:i", "SELECT win AS \"window\", x_start, x_end, CASE WHEN win = 1 THEN 1 ELSE variant_idx END AS h_start, coalesce(lead(variant_idx) OVER (ORDER BY win) - 1, 64) AS h_end FROM win JOIN typed ON x_idx = x_start")
def _(x):
    return panel.windows_from_ranges(x.windows.select("window", "x_start", "x_end"), x.typed, 64)


for scope in ("all", "typed"):
    query(f"unique_haplotypes_{scope}", "window:i hap_idx:i bits:s rep:i unique_idx:i", f"SELECT win AS \"window\", hap_idx, bits, rep, unique_idx FROM uni_{scope}")(lambda x, typed=scope == "typed": x.unique(typed))


@query("hapmap_members", "window:i rep:i members:s n_members:i", "SELECT win AS \"window\", rep, array_to_string(members, ',') AS members, n_members FROM mem WHERE n_members > 1")
def _(x):
    return x.members().filter("n_members > 1").withColumn("members", F.array_join("members", ","))


@query("index_translate", "window:i hap_idx:i all_idx:i all_rep:i typed_idx:i typed_rep:i typed_to_all:i",
       "SELECT a.win AS \"window\", a.hap_idx, a.unique_idx AS all_idx, a.rep AS all_rep, t.unique_idx AS typed_idx, t.rep AS typed_rep, b.unique_idx AS typed_to_all FROM uni_all a JOIN uni_typed t ON t.win = a.win AND t.hap_idx = a.hap_idx JOIN uni_all b ON b.win = a.win AND b.hap_idx = t.rep")
def _(x):
    return panel.translations(x.unique(False), x.unique(True))


@query("window_bisection_minwidth", "x_start:i x_end:i n_unique:i", unique_windows(d=60, minwidth=6))
def _(x):
    """A range whose half is six wide or less isn't halved, however many haplotypes it has."""
    return x.bisected(d=60, minwidth=6)


PADDED = "(SELECT win, x_start, x_end, CASE WHEN win = 1 THEN x_start ELSE greatest(1, x_start - 2) END AS lo, CASE WHEN win = 8 THEN x_end ELSE least(48, x_end + 2) END AS hi FROM win)"
#: The windows' variants with flanks, in the place of the windows' own.
FLANKED = {
    "keys_typed": f"SELECT win, hap_idx, string_agg(allele, '' ORDER BY variant_idx) AS bits FROM hap JOIN typed USING (variant_idx) JOIN {PADDED} ON x_idx BETWEEN lo AND hi GROUP BY 1, 2",
    "wx": f"SELECT sample_idx, win, variant_idx, x, gt FROM fill JOIN typed USING (variant_idx) JOIN {PADDED} ON x_idx BETWEEN lo AND hi",
    "arep": f"SELECT r.win, r.u, r.rep, v.variant_idx, CAST(substr(r.bits, CAST(v.n AS INT), 1) AS INT) AS a FROM reps r JOIN (SELECT variant_idx, win, row_number() OVER (PARTITION BY win ORDER BY variant_idx) AS n FROM typed JOIN {PADDED} ON x_idx BETWEEN lo AND hi) v ON v.win = r.win",
}


@query("pair_search_overlap", "sample_idx:i window:i hap1:i hap2:i score:f", "SELECT *, win AS \"window\" FROM best", **FLANKED)
def _(x):
    """Search on windows with flanks of two typed variants on each side."""
    wide = panel.padded(x.windows, 0.3, 48)
    spans = wide.select("window", F.col("x_start_pad").cast("int").alias("x_start"), F.col("x_end_pad").cast("int").alias("x_end"))
    unique = panel.unique_haplotypes(x.typed_strands(), wide, "x_start_pad", "x_end_pad")
    return search.pair_search(search.window_vectors(search.mean_filled(x.geno()), spans, x.typed), unique)


@query("panel_summary", "n_windows:i n_haplotypes:i max_width:i max_unique:i mean_unique:f", "SELECT count(*) AS n_windows, max(nh) AS n_haplotypes, max(x_end - x_start + 1) AS max_width, max(nu) AS max_unique, avg(nu) AS mean_unique FROM (SELECT win, max(unique_idx) AS nu, count(*) AS nh FROM uni_typed GROUP BY 1) JOIN win USING (win)")
def _(x):
    return panel.summary(x.windows, x.unique())


@query("unique_per_window", "window:i n_unique:i width:i", "SELECT win AS \"window\", n_unique, x_end - x_start + 1 AS width FROM (SELECT win, max(unique_idx) AS n_unique FROM uni_typed GROUP BY 1) JOIN win USING (win)")
def _(x):
    return panel.haplotypes_per_window(x.unique()).join(panel.window_widths(x.windows), "window")


@query("overlap_ranges", "window:i x_start:i x_end:i x_start_pad:i x_end_pad:i",
       "SELECT win AS \"window\", x_start, x_end, CASE WHEN win = 1 THEN x_start ELSE greatest(1, x_start - 2) END AS x_start_pad, CASE WHEN win = 8 THEN x_end ELSE least(48, x_end + 2) END AS x_end_pad FROM win")
def _(x):
    return panel.padded(x.windows, 0.3, 48)


@query("overlap_inner", "window:i x_idx:i inner_row:b", "SELECT win AS \"window\", t.x_idx, t.x_idx BETWEEN x_start AND x_end AS inner_row FROM win JOIN typed t ON t.x_idx BETWEEN CASE WHEN win = 1 THEN x_start ELSE greatest(1, x_start - 2) END AND CASE WHEN win = 8 THEN x_end ELSE least(48, x_end + 2) END")
def _(x):
    return panel.inner_rows(panel.padded(x.windows, 0.3, 48))


# Pair search

@query("mean_fill", "sample_idx:i variant_idx:i x:f", "SELECT * FROM fill")
def _(x):
    return search.mean_filled(x.geno())


@query("allele_weights", "variant_idx:i weight:f", "SELECT * FROM weight")
def _(x):
    return search.allele_weights(panel.allele_frequency(x.hap))


PAIR = "sample_idx:i window:i hap1:i hap2:i score:f"


@query("pair_search_global", PAIR, "SELECT *, win AS \"window\" FROM best")
def _(x):
    return x.best()


WEIGHTED = """SELECT c.sample_idx, c.win AS "window", a.rep AS hap1, b.rep AS hap2, c.score FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY score, k, j) AS rn FROM (
 SELECT x.sample_idx, x.win, p.u AS j, q.u AS k, round(sum(w.weight * w.weight * (x.x - p.a - q.a) * (x.x - p.a - q.a)), 6) AS score FROM wx x JOIN weight w USING (variant_idx) JOIN arep p ON p.win = x.win AND p.variant_idx = x.variant_idx JOIN arep q ON q.win = x.win AND q.variant_idx = x.variant_idx AND p.u <= q.u GROUP BY 1, 2, 3, 4)) c
 JOIN reps a ON a.win = c.win AND a.u = c.j JOIN reps b ON b.win = c.win AND b.u = c.k WHERE rn = 1"""


@query("pair_search_weighted", PAIR, WEIGHTED)
def _(x):
    return x.best(weights=search.window_weights(x.windows, x.typed, search.allele_weights(panel.allele_frequency(x.hap))))


RESCREEN = """SELECT e.sample_idx, e.win AS "window", a.rep AS hap1, b.rep AS hap2, e.err AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY err, ord) AS rn2 FROM (
 SELECT k.sample_idx, k.win, k.j, k.k, k.ord, sum(CASE WHEN x.gt IS NULL THEN 0 ELSE (x.gt - p.a - q.a) * (x.gt - p.a - q.a) END) AS err FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY ord) AS nth FROM (
   SELECT o.*, min(CASE WHEN o.score = o.least THEN ord END) OVER (PARTITION BY sample_idx, win) AS first_ord FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY k, j) AS ord, min(score) OVER (PARTITION BY sample_idx, win) AS least FROM cost WHERE j <= k) o) WHERE ord >= first_ord AND score <= least + 3) WHERE nth <= 100) k
 JOIN wx x ON x.sample_idx = k.sample_idx AND x.win = k.win JOIN arep p ON p.win = k.win AND p.u = k.j AND p.variant_idx = x.variant_idx JOIN arep q ON q.win = k.win AND q.u = k.k AND q.variant_idx = x.variant_idx GROUP BY 1, 2, 3, 4, 5)) e
 JOIN reps a ON a.win = e.win AND a.u = e.j JOIN reps b ON b.win = e.win AND b.u = e.k WHERE rn2 = 1"""


@query("pair_search_rescreen", PAIR, RESCREEN)
def _(x):
    return x.best(strategy="rescreen")


def stepwise_sql(r: int) -> str:
    return f"""SELECT c.sample_idx, c.win AS "window", a.rep AS hap1, b.rep AS hap2, c.score FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sample_idx, c.win ORDER BY c.score, t.nth DESC, c.k) AS rn
 FROM cost c JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY round(n, 6) DESC, u) AS nth FROM xn) WHERE nth <= {r}) t ON t.sample_idx = c.sample_idx AND t.win = c.win AND t.u = c.j) c
 JOIN reps a ON a.win = c.win AND a.u = c.j JOIN reps b ON b.win = c.win AND b.u = c.k WHERE rn = 1"""


for r in (1, 3):
    query(f"pair_search_stepwise_{r}", PAIR, stepwise_sql(r))(lambda x, r=r: x.best(strategy="stepwise", r=r, max_haplotypes=0))

def weighted_cost() -> dict[str, str]:
    """The library's expressions of the search's objective with the variants' weights in every term."""
    return {
        "xn": "SELECT x.sample_idx, x.win, r.u, sum(2 * w.weight * w.weight * x.x * r.a) AS n FROM wx x JOIN weight w USING (variant_idx) JOIN arep r ON r.win = x.win AND r.variant_idx = x.variant_idx GROUP BY 1, 2, 3",
        "xx": "SELECT sample_idx, win, sum(w.weight * w.weight * x * x) AS xx FROM wx JOIN weight w USING (variant_idx) GROUP BY 1, 2",
        "gram": "SELECT p.win, p.u AS j, q.u AS k, sum(w.weight * w.weight * (p.a + q.a) * (p.a + q.a)) AS m FROM arep p JOIN weight w USING (variant_idx) JOIN arep q ON q.win = p.win AND q.variant_idx = p.variant_idx GROUP BY 1, 2, 3",
    }


def _weights(x):
    return search.window_weights(x.windows, x.typed, search.allele_weights(panel.allele_frequency(x.hap)))


query("pair_search_rescreen_weighted", PAIR, RESCREEN)(lambda x: x.best(strategy="rescreen", weights=_weights(x)))  # rescreening takes no weights
query("pair_search_stepwise_weighted", PAIR, stepwise_sql(3), **weighted_cost())(lambda x: x.best(strategy="stepwise", r=3, max_haplotypes=0, weights=_weights(x)))


def mixed_sql(small: str, large: str, most: int) -> str:
    """Small windows' rows of one search, large windows' of another; columns sample_idx, window, hap1, hap2, score."""
    sizes = "(SELECT win, max(u) AS n FROM reps GROUP BY 1)"
    pick = 'SELECT q.sample_idx, q."window", q.hap1, q.hap2, q.score FROM ({}) q JOIN {} z ON z.win = q."window" WHERE z.n {} {}'
    return pick.format(small, sizes, "<=", most) + " UNION ALL " + pick.format(large, sizes, ">", most)


GLOBAL = 'SELECT *, win AS "window" FROM best'
MOST = 50  # unique haplotypes; the windows have 45 to 64 of them
query("pair_search_stepwise_mixed", PAIR, mixed_sql(GLOBAL, stepwise_sql(3), MOST))(lambda x: x.best(strategy="stepwise", r=3, max_haplotypes=MOST))
query("pair_search_stepwise_rescreen_mixed", PAIR, mixed_sql(RESCREEN, stepwise_sql(3), MOST))(lambda x: x.best(strategy="stepwise", r=3, max_haplotypes=MOST, rescreen=True))


THINNED = """SELECT c.sample_idx, c.win AS "window", a.rep AS hap1, b.rep AS hap2, c.score FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sample_idx, c.win ORDER BY c.score, q.nth, p.nth) AS rn FROM cost c
 JOIN near p ON p.sample_idx = c.sample_idx AND p.win = c.win AND p.u = c.j JOIN near q ON q.sample_idx = c.sample_idx AND q.win = c.win AND q.u = c.k AND p.nth <= q.nth) c
 JOIN reps a ON a.win = c.win AND a.u = c.j JOIN reps b ON b.win = c.win AND b.u = c.k WHERE rn = 1"""
NEAR = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY d, u) AS nth FROM (SELECT x.sample_idx, x.win, r.u, round(sum((x.x - r.a) * (x.x - r.a)), 6) AS d FROM wx x JOIN arep r USING (win, variant_idx) GROUP BY 1, 2, 3)) WHERE nth <= 12)"


@query("pair_search_thinning", PAIR, THINNED.replace("JOIN near p", f"JOIN {NEAR} p").replace("JOIN near q", f"JOIN {NEAR} q"))
def _(x):
    return x.best(strategy="thinning", keep=12, max_haplotypes=0)


WEIGHTED_NEAR = NEAR.replace("sum((x.x - r.a) * (x.x - r.a))", "sum(w.weight * w.weight * (x.x - r.a) * (x.x - r.a))").replace("JOIN arep r USING (win, variant_idx)", "JOIN weight w USING (variant_idx) JOIN arep r ON r.win = x.win AND r.variant_idx = x.variant_idx")


@query("pair_search_thinning_weighted", PAIR, THINNED.replace("JOIN near p", f"JOIN {WEIGHTED_NEAR} p").replace("JOIN near q", f"JOIN {WEIGHTED_NEAR} q"))
def _(x):
    return x.best(strategy="thinning", keep=12, max_haplotypes=0, weights=_weights(x))


@query("top_haplotypes", "sample_idx:i window:i unique_idx:i n:f nth:i", "SELECT sample_idx, win AS \"window\", u AS unique_idx, n, nth FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY round(n, 6) DESC, u) AS nth FROM xn) WHERE nth <= 5")
def _(x):
    return search.top_haplotypes(x.vectors(), x.unique(), 5)


OBSERVED = "SELECT b.sample_idx, b.win, b.hap1, b.hap2, b.turn, sum(CASE WHEN x.gt IS NULL THEN 0 ELSE (x.gt - p.allele - q.allele) * (x.gt - p.allele - q.allele) END) AS err FROM ({tries}) b JOIN wx x ON x.sample_idx = b.sample_idx AND x.win = b.win JOIN hap p ON p.hap_idx = b.hap1 AND p.variant_idx = x.variant_idx JOIN hap q ON q.hap_idx = b.hap2 AND q.variant_idx = x.variant_idx GROUP BY 1, 2, 3, 4, 5"


@query("observed_error", "sample_idx:i window:i hap1:i hap2:i error:f", "SELECT sample_idx, win AS \"window\", hap1, hap2, err AS error FROM (" + OBSERVED.format(tries="SELECT *, 0 AS turn FROM best") + ")")
def _(x):
    return search.observed_errors(x.best(), x.vectors(), x.unique())


TRIES = "SELECT b.sample_idx, b.win, o.hap1, o.hap2, t.turn FROM best b, (VALUES (0, 0), (1, -1), (2, 1)) t(turn, shift), best o WHERE o.sample_idx = b.sample_idx AND o.win = b.win + t.shift"


@query("flanking_screen", "sample_idx:i window:i hap1:i hap2:i error:f", "SELECT sample_idx, win AS \"window\", hap1, hap2, err AS error FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, win ORDER BY err, turn) AS rn FROM (" + OBSERVED.format(tries=TRIES) + ")) WHERE rn = 1")
def _(x):
    return search.flanking_screen(x.best(), x.vectors(), x.unique())


@query("redundant_pairs", "sample_idx:i window:i pair_no:i h1:i h2:i", "SELECT * FROM (SELECT b.sample_idx, b.win AS \"window\", row_number() OVER (PARTITION BY b.sample_idx, b.win ORDER BY h1, h2) AS pair_no, h1, h2 FROM best b, uni_typed p, uni_typed q, LATERAL (SELECT p.hap_idx AS h1, q.hap_idx AS h2) WHERE p.win = b.win AND p.rep = b.hap1 AND q.win = b.win AND q.rep = b.hap2) WHERE pair_no <= 1000")
def _(x):
    return search.redundant_pairs(x.best(), x.members())


# Phasing

@query("phase_fold", "sample_idx:i window:i hap1:i hap2:i", "SELECT *, win AS \"window\" FROM phased_labels")
def _(x):
    return x.labels()


@query("breakpoints_of_best", "sample_idx:i window:i b1:i b2:i", POINTS.format(labels="best", before="best"))
def _(x):
    return phasing.breakpoints(phasing.adjacent(x.best(), x.vectors(), x.unique()))


@query("breakpoints_of_labels", "sample_idx:i window:i b1:i b2:i", POINTS.format(labels="phased_labels", before="phased_labels"))
def _(x):
    return phasing.breakpoints(phasing.adjacent(x.labels(), x.vectors(), x.unique()))


SEGMENT = "sample_idx:i strand:i seg_no:i start:i window:i hap_label:i"
query("mosaic_segments", SEGMENT, 'SELECT *, win AS "window" FROM mosaic_l')(lambda x: x.mosaic("label"))
query("mosaic_by_window", SEGMENT, 'SELECT *, win AS "window" FROM mosaic_w')(lambda x: x.mosaic("window"))


TURNED = """(SELECT n.sample_idx, n.win, CASE WHEN turn THEN n.hap2 ELSE n.hap1 END AS hap1, CASE WHEN turn THEN n.hap1 ELSE n.hap2 END AS hap2 FROM best n JOIN best p ON p.sample_idx = n.sample_idx AND p.win = n.win - 1,
 LATERAL (SELECT NOT (p.hap1 = n.hap1) AND (p.hap1 = n.hap2 OR p.hap2 = n.hap1) AS turn))"""


@query("continue_unphased", "sample_idx:i window:i hap1:i hap2:i b1:i b2:i", "SELECT b.sample_idx, b.win AS \"window\", t.hap1, t.hap2, CASE WHEN b1 >= 0 AND b2 >= 0 THEN -2 ELSE b1 END AS b1, CASE WHEN b1 >= 0 AND b2 >= 0 THEN -2 ELSE b2 END AS b2 FROM (" + POINTS.format(labels=TURNED, before="best").replace('win AS "window"', "win") + f") b JOIN {TURNED} t ON t.sample_idx = b.sample_idx AND t.win = b.win")
def _(x):
    """Best pairs without phase: the next window's pair is turned where that lets a strand go on; where both change, no break points are searched."""
    return phasing.continued(phasing.adjacent(x.best(), x.vectors(), x.unique()))


@query("dp_connect", "sample_idx:i window:i hap1:i hap2:i best_err:f", path_sql(8))
def _(x):
    return phasing.connect_pairs(search.redundant_pairs(x.best(), x.members()).withColumnsRenamed({"h1": "hap1", "h2": "hap2"}))


@query("survivor_overlap", "sample_idx:i window:i n1:i n2:i crossed:i", "SELECT b.sample_idx, b.win AS \"window\", len(list_intersect(p.members, pp.members)) AS n1, len(list_intersect(q.members, qq.members)) AS n2, len(list_intersect(p.members, qq.members)) + len(list_intersect(q.members, pp.members)) AS crossed FROM best b JOIN best a ON a.sample_idx = b.sample_idx AND a.win = b.win - 1 JOIN mem p ON p.win = a.win AND p.rep = a.hap1 JOIN mem q ON q.win = a.win AND q.rep = a.hap2 JOIN mem pp ON pp.win = b.win AND pp.rep = b.hap1 JOIN mem qq ON qq.win = b.win AND qq.rep = b.hap2")
def _(x):
    return phasing.survivor_overlap(phasing.with_members(x.best(), x.members()))


# Imputation, scores, decompression

@query("segment_ranges", "user_id:i seg_no:i start:i end:i label:s", "SELECT * FROM eseg")
def _(x):
    """A segment runs to the next one's start, the last one to the user's last event."""
    runs = D.event_segments(x.spark, x.dir)
    total = runs.groupBy("user_id").agg(F.max("end").alias("total"))
    starts = runs.drop("end").join(total, "user_id").select(F.col("user_id").alias("sample_idx"), F.lit(1).alias("strand"), "seg_no", "start", "label", "total")
    return impute.bounded(starts, F.col("total")).withColumnRenamed("sample_idx", "user_id")


@query("segment_expand", "sample_idx:i strand:i variant_idx:i allele:i", "SELECT * FROM alleles")
def _(x):
    return impute.expanded(x.segments(), x.hap)


@query("segment_expand_by_window", "sample_idx:i strand:i variant_idx:i allele:i", "SELECT * FROM alleles")
def _(x):
    """From the compressed panel."""
    return x.alleles()


@query("segment_asof", "user_id:i n:i label:s", "SELECT user_id, n, event_type AS label FROM runs1 WHERE n % 3 = 0")
def _(x):
    runs = D.event_segments(x.spark, x.dir).select(F.col("user_id").alias("sample_idx"), F.lit(1).alias("strand"), F.col("start"), F.col("label").alias("hap_label"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    asks = x.spark.read.parquet(f"{x.dir}/events.parquet").select("user_id", F.row_number().over(order).alias("variant_idx")).filter("variant_idx % 3 = 0")
    found = impute.segment_at(asks.select(F.col("user_id").alias("sample_idx"), F.lit(1).alias("strand"), "variant_idx"), runs)
    return found.select(F.col("sample_idx").alias("user_id"), F.col("variant_idx").alias("n"), F.col("hap_label").alias("label"))


@query("marker_lift", "sample_idx:i strand:i seg_no:i start:i hap_label:i", "SELECT s.sample_idx, s.strand, s.seg_no, CASE WHEN s.seg_no = 1 THEN 1 ELSE t.variant_idx END AS start, s.hap_label FROM mosaic_l s JOIN typed t ON t.x_idx = s.start")
def _(x):
    return impute.lifted(x.mosaic(), x.typed)


@query("impute_phased", "sample_idx:i variant_idx:i a1:i a2:i g:i", "SELECT sample_idx, variant_idx, max(CASE WHEN strand = 1 THEN allele END) AS a1, max(CASE WHEN strand = 2 THEN allele END) AS a2, sum(allele) AS g FROM alleles GROUP BY 1, 2")
def _(x):
    return x.dosage()


@query("impute_keep_observed", "sample_idx:i variant_idx:i g:i observed:b", "SELECT sample_idx, variant_idx, coalesce(gt, i.g) AS g, gt IS NOT NULL AS observed FROM imp i LEFT JOIN geno USING (sample_idx, variant_idx)")
def _(x):
    return impute.keep_observed(x.dosage(), x.geno())


@query("impute_typed_only", "sample_idx:i variant_idx:i g:i", "SELECT i.* FROM imp i WHERE variant_idx IN (SELECT variant_idx FROM typed)")
def _(x):
    return x.dosage().join(x.typed.select("variant_idx"), "variant_idx", "left_semi")


@query("fill_missing", "sample_idx:i n_filled:i n_different:i allele_sum:i", "SELECT sample_idx, count(*) FILTER (gt IS NULL) AS n_filled, count(*) FILTER (gt <> g) AS n_different, sum(coalesce(gt, g)) AS allele_sum FROM geno JOIN imp USING (sample_idx, variant_idx) GROUP BY 1")
def _(x):
    return impute.fill_missing(x.geno(), x.dosage())


@query("snp_score", "variant_idx:i score:f", "SELECT * FROM tscore")
def _(x):
    return x.scores()


@query("sample_score", "sample_idx:i score:f", "SELECT sample_idx, 1 - 0.25 * avg((gt - g) * (gt - g)) AS score FROM geno JOIN imp USING (sample_idx, variant_idx) GROUP BY 1")
def _(x):
    return impute.scores_by_sample(x.errors())


@query("untyped_score", "variant_idx:i score:f typed:b", UNTYPED)
def _(x):
    return impute.variant_scores(x.scores(), x.variants)


@query("decompress_error", "n:i error_rate:f", "SELECT count(*) AS n, avg(CASE WHEN d.g <> i.g THEN 1 ELSE 0 END) AS error_rate FROM dos d JOIN imp i USING (sample_idx, variant_idx)")
def _(x):
    return stats.error_rate(D.true_dosage(x.spark, x.dir), x.dosage())


@query("phase_and_impute", "variant_idx:i score:f typed:b", UNTYPED, win=BY_BISECTION)
def _(x):
    from .api import compress, phase_tables

    samples = x.hap.select(F.ceil(F.col("hap_idx") / 2).cast("int").alias("sample_idx")).distinct().withColumn("sample_id", F.concat(F.lit("r"), "sample_idx"))
    tables = compress(x.hap, x.variants, samples, x.typed, d=100)
    read = ("windows", "unique_all", "unique_typed")  # several times; a panel would be read from its files
    return phase_tables(settled(x.geno(), "genotypes"), tables | {name: settled(tables[name], name) for name in read}).variant_scores


# Ancestry

LABELLED = "seg s JOIN pop p ON p.ref_sample = (s.hap_label + 1) // 2"


@query("composition_global", "sample_idx:i population:s frac:f", "SELECT a.sample_idx, b.population, coalesce(frac, 0) AS frac FROM (SELECT DISTINCT sample_idx FROM seg) a CROSS JOIN (SELECT DISTINCT population FROM pop) b LEFT JOIN (SELECT sample_idx, population, sum(s.\"end\" - s.start + 1) / 128.0 AS frac FROM " + LABELLED + " GROUP BY 1, 2) c ON c.sample_idx = a.sample_idx AND c.population = b.population")
def _(x):
    return ancestry.composition(x.segments(), D.populations(x.spark, x.dir), 64)


@query("composition_mass_check", "sample_idx:i mass:f", "SELECT sample_idx, sum(\"end\" - start + 1) / 128.0 AS mass FROM seg WHERE NOT (sample_idx % 3 = 0 AND strand = 1 AND seg_no = 1) GROUP BY 1 HAVING sum(\"end\" - start + 1) <> 128")
def _(x):
    """Every third sample lacks a segment here, and is found."""
    some = x.segments().filter("not (sample_idx % 3 = 0 and strand = 1 and seg_no = 1)")
    return ancestry.mass_errors(ancestry.composition(some, D.populations(x.spark, x.dir), 64))


@query("paint_local", "sample_idx:i strand:i seg_no:i frac:f population:s", "SELECT s.sample_idx, s.strand, s.seg_no, (s.\"end\" - s.start + 1) / 64.0 AS frac, p.population FROM " + LABELLED)
def _(x):
    return ancestry.painted(x.segments(), D.populations(x.spark, x.dir), 64)


POPULATIONS = [f"P{i}" for i in range(10)]


@query("admixture_global", "sample_idx:i " + " ".join(f"{p}:f" for p in POPULATIONS), "SELECT s.sample_idx, " + ", ".join(f"sum(CASE WHEN p.population = '{p}' THEN s.\"end\" - s.start + 1 ELSE 0 END) / 128.0 AS {p}" for p in POPULATIONS) + " FROM " + LABELLED + " GROUP BY 1")
def _(x):
    return ancestry.global_matrix(ancestry.composition(x.segments(), D.populations(x.spark, x.dir), 64), POPULATIONS)


@query("admixture_local", "sample_idx:i strand:i " + " ".join(f"{i}:f" for i in range(1, 11)), "SELECT s.sample_idx, s.strand, " + ", ".join(f"sum(CASE WHEN s.seg_no = {i} THEN s.\"end\" - s.start + 1 ELSE 0 END) / 64.0 AS \"{i}\"" for i in range(1, 11)) + " FROM seg s GROUP BY 1, 2")
def _(x):
    return ancestry.local_matrix(ancestry.painted(x.segments(), D.populations(x.spark, x.dir), 64), 10)


@query("segment_counts", "sample_idx:i n1:i n2:i longest:i", "SELECT sample_idx, count(*) FILTER (strand = 1) AS n1, count(*) FILTER (strand = 2) AS n2, greatest(count(*) FILTER (strand = 1), count(*) FILTER (strand = 2)) AS longest FROM seg GROUP BY 1")
def _(x):
    return ancestry.segment_counts(x.segments())


SUPER = "(VALUES " + ", ".join(f"('{p}', '{s}')" for s, ps in ancestry.SUPER_POPULATIONS.items() for p in ps) + ") t(population, super_population)"


@query("population_superpopulation", "population:s super_population:s", "SELECT * FROM " + SUPER)
def _(x):
    return ancestry.population_to_super(x.spark)


@query("superpopulation_rollup", "super_population:s population:s n:i", "SELECT super_population, population, count(*) AS n FROM pop p JOIN (VALUES ('P0','A'),('P1','A'),('P2','A'),('P3','B'),('P4','B'),('P5','B'),('P6','C'),('P7','C'),('P8','C'),('P9','C')) m(code, super_population) ON m.code = p.population GROUP BY ROLLUP (super_population, population)")
def _(x):
    groups = F.when(F.col("population") < "P3", "A").when(F.col("population") < "P6", "B").otherwise("C")
    return D.populations(x.spark, x.dir).withColumn("super_population", groups).rollup("super_population", "population").agg(F.count(F.lit(1)).alias("n"))


# Companion statistics

@query("gtstats", "variant_idx:i n:i n_missing:i alt_freq:f maf:f hwe:f", """SELECT variant_idx, n, n_missing, p AS alt_freq, least(p, 1 - p) AS maf,
 CASE WHEN (1-p)*(1-p)*n > 0 THEN pow(n0 - (1-p)*(1-p)*n, 2) / ((1-p)*(1-p)*n) ELSE 0 END + CASE WHEN 2*p*(1-p)*n > 0 THEN pow(n1 - 2*p*(1-p)*n, 2) / (2*p*(1-p)*n) ELSE 0 END + CASE WHEN p*p*n > 0 THEN pow(n2 - p*p*n, 2) / (p*p*n) ELSE 0 END AS hwe
 FROM (SELECT variant_idx, count(gt) AS n, count(*) FILTER (gt IS NULL) AS n_missing, sum(gt) / (2.0 * count(gt)) AS p, count(*) FILTER (gt = 0) AS n0, count(*) FILTER (gt = 1) AS n1, count(*) FILTER (gt = 2) AS n2 FROM geno GROUP BY 1)""")
def _(x):
    return stats.genotype_stats(x.geno())


@query("sample_stats", "sample_idx:i n:i n_missing:i allele_sum:i", "SELECT sample_idx, count(gt) AS n, count(*) FILTER (gt IS NULL) AS n_missing, sum(gt) AS allele_sum FROM geno GROUP BY 1")
def _(x):
    return stats.sample_stats(x.geno())


@query("maf_mac_filter", "variant_idx:i maf:f mac:i", "SELECT * FROM (SELECT variant_idx, least(p, 1 - p) AS maf, CAST(least(round(p * 2 * n), round((1 - p) * 2 * n)) AS BIGINT) AS mac FROM (SELECT variant_idx, count(gt) AS n, sum(gt) / (2.0 * count(gt)) AS p FROM geno GROUP BY 1)) WHERE maf > 0.05 AND mac >= 5")
def _(x):
    return stats.minor_allele_filter(x.geno(), 0.05, 5)


@query("record_filter", "sample_idx:i variant_idx:i gt:i", "SELECT * FROM geno WHERE variant_idx <= 20 AND sample_idx % 2 = 1")
def _(x):
    return stats.filtered(x.geno(), x.variants.filter("variant_idx <= 20"), x.geno().select("sample_idx").distinct().filter("sample_idx % 2 = 1"))


@query("mask_genotypes", "sample_idx:i variant_idx:i gt:i", "SELECT sample_idx, variant_idx, CASE WHEN (sample_idx + variant_idx) % 5 = 0 THEN NULL ELSE gt END AS gt FROM geno")
def _(x):
    return stats.masked(x.geno(), (F.col("sample_idx") + F.col("variant_idx")) % 5 == 0)


@query("chip_sites", "variant_idx:i pos:i", "SELECT variant_idx, pos FROM variants WHERE pos % 30 = 0")
def _(x):
    return stats.restricted(x.variants, x.variants.filter("pos % 30 = 0"))


@query("conform_markers", "pos:i ref:s alt:s a_idx:i b_idx:i", "SELECT pos, ref, alt, variant_idx AS a_idx, variant_idx AS b_idx FROM variants WHERE variant_idx % 3 = 0 AND variant_idx % 2 = 0")
def _(x):
    return stats.conformed(x.variants.filter("variant_idx % 3 = 0"), x.variants.filter("variant_idx % 2 = 0"))


@query("r2_by_mac", "bin:i n:i r2:f", "SELECT bin, count(*) AS n, pow(corr(d.g, i.g), 2) AS r2 FROM dos d JOIN imp i USING (sample_idx, variant_idx) JOIN (SELECT variant_idx, CAST(least(sum(allele), count(*) - sum(allele)) AS BIGINT) AS mac FROM hap GROUP BY 1) m USING (variant_idx), (VALUES (210), (220), (230), (240), (1000000)) b(bin) WHERE mac <= bin GROUP BY 1")
def _(x):
    counts = x.hap.groupBy("variant_idx").agg(F.least(F.sum("allele"), F.count(F.lit(1)) - F.sum("allele")).alias("mac"))
    return stats.cumulative_r2(D.true_dosage(x.spark, x.dir), x.dosage(), counts, [210, 220, 230, 240, 1000000])


@query("minimac_rsq", "variant_idx:i rsq:f", "SELECT variant_idx, CASE WHEN avg(allele) > 0 AND avg(allele) < 1 THEN var_pop(allele) / (avg(allele) * (1 - avg(allele))) END AS rsq FROM alleles GROUP BY 1")
def _(x):
    return stats.minimac_r2(x.alleles())


@query("aim_rank", "variant_idx:i chi2:f", "SELECT variant_idx, chi2 FROM (SELECT variant_idx, sum(n * pow(ones / n - p, 2) / (p * (1 - p))) AS chi2 FROM (SELECT h.variant_idx, p.population, count(*) AS n, sum(allele) * 1.0 AS ones FROM hap h JOIN pop p ON p.ref_sample = (h.hap_idx + 1) // 2 GROUP BY 1, 2) JOIN (SELECT variant_idx, avg(allele) AS p FROM hap GROUP BY 1) USING (variant_idx) GROUP BY 1) ORDER BY round(chi2, 6) DESC, variant_idx LIMIT 20")
def _(x):
    owners = D.populations(x.spark, x.dir).select(F.explode(F.array(2 * F.col("ref_sample") - 1, 2 * F.col("ref_sample"))).alias("hap_idx"), "population")
    return stats.informative_markers(x.hap, owners, 20)


@query("panel_split", "ref_sample:i population:s", "SELECT * FROM pop WHERE population NOT IN ('P1', 'P2')")
def _(x):
    return stats.without_populations(D.populations(x.spark, x.dir), ["P1", "P2"])


@query("quality_filter", "variant_idx:i score:f", "SELECT * FROM tscore WHERE score >= 0.9")
def _(x):
    return stats.quality_filtered(x.scores(), 0.9)


WRONG = "(SELECT variant_idx, count(*) AS n, sum(CASE WHEN d.g <> i.g THEN 1 ELSE 0 END) AS wrong FROM dos d JOIN imp i USING (sample_idx, variant_idx) GROUP BY 1)"


def _wrong(x):
    rows = D.true_dosage(x.spark, x.dir).withColumnRenamed("g", "t").join(x.dosage(), ["sample_idx", "variant_idx"])
    return rows.groupBy("variant_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") != F.col("g")).alias("wrong"))


@query("edge_errors", "n_wrong:i n_near_edge:i", "SELECT sum(wrong) AS n_wrong, sum(CASE WHEN variant_idx - h_start < 2 OR h_end - variant_idx < 2 THEN wrong ELSE 0 END) AS n_near_edge FROM " + WRONG + " e JOIN win ON variant_idx BETWEEN h_start AND h_end")
def _(x):
    return stats.edge_error_share(_wrong(x), x.windows, 2)


@query("width_bin_errors", "width_bin:i n_wrong:i n:i", "SELECT CASE WHEN variant_idx <= 24 THEN 20 ELSE 50 END AS width_bin, sum(wrong) AS n_wrong, sum(n) AS n FROM " + WRONG + " e GROUP BY 1")
def _(x):
    """Windows of 6, 12 and 30 typed variants."""
    rows = [(1, 1, 6, 1, 8), (2, 7, 18, 9, 24), (3, 19, 48, 25, 64)]
    return stats.width_bin_errors(_wrong(x), x.spark.createDataFrame(rows, "window int, x_start int, x_end int, h_start int, h_end int"))


@query("score_histogram", "sample_idx:i bin:i n:i", "SELECT sample_idx, CAST(floor(round(score / 0.5, 6)) AS BIGINT) AS bin, count(*) AS n FROM best GROUP BY 1, 2")
def _(x):
    return stats.score_histogram(x.best(), 0.5)


@query("unphase", "sample_idx:i variant_idx:i gt:i", "SELECT sample_idx, variant_idx, sum(allele) AS gt FROM truth GROUP BY 1, 2")
def _(x):
    return stats.unphased(D.truth(x.spark, x.dir))


@query("prune_samples", "sample_idx:i mean_score:f", "SELECT sample_idx, avg(score) AS mean_score FROM best GROUP BY 1 HAVING round(avg(score), 6) <= 0.2")
def _(x):
    return stats.pruned_samples(x.best(), 0.2)


@query("record_counts", "n_records:i n_samples:i", "SELECT count(DISTINCT variant_idx) AS n_records, count(DISTINCT sample_idx) AS n_samples FROM geno")
def _(x):
    return stats.record_counts(x.geno())


@query("plink_recode", "sample_idx:i variant_idx:i code:i", "SELECT sample_idx, variant_idx, CASE WHEN gt IS NULL THEN 1 WHEN gt = 0 THEN 0 WHEN gt = 1 THEN 2 ELSE 3 END AS code FROM geno")
def _(x):
    """The two-bit codes that the .bed writer's packed rows hold."""
    import numpy as np

    from ..sources.plink import pack

    rows = x.geno().groupBy("variant_idx").agg(F.array_sort(F.collect_list(F.struct("sample_idx", F.coalesce("gt", F.lit(-1)).alias("gt")))).alias("v"))

    def run(batches):
        for pdf in batches:
            for variant, calls in zip(pdf["variant_idx"], pdf["v"]):
                raw = np.frombuffer(pack(np.array([[c["gt"] for c in calls]])), np.uint8)
                codes = ((raw[:, None] >> np.array([0, 2, 4, 6])) & 3).reshape(-1)[: len(calls)]
                yield pd.DataFrame({"sample_idx": [c["sample_idx"] for c in calls], "variant_idx": variant, "code": codes})

    return rows.mapInPandas(run, "sample_idx long, variant_idx long, code long")


@query("vcf_lines", "variant_idx:i line:s", """SELECT v.variant_idx, chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'IMPQ=' || printf('%.3f', s.score) || CASE WHEN s.typed THEN '' ELSE ';IMP' END || chr(9) || 'GT' || chr(9) || c.calls AS line
 FROM variants v JOIN (""" + UNTYPED + """) s ON s.variant_idx = v.variant_idx JOIN (SELECT variant_idx, string_agg(a1 || '|' || a2, chr(9) ORDER BY sample_idx) AS calls FROM (SELECT sample_idx, variant_idx, max(CASE WHEN strand = 1 THEN allele END) AS a1, max(CASE WHEN strand = 2 THEN allele END) AS a2 FROM alleles GROUP BY 1, 2) GROUP BY 1) c ON c.variant_idx = v.variant_idx""")
def _(x):
    from ..sources.vcf import vcf_lines

    dosage = x.dosage()
    return vcf_lines(dosage, x.variants, impute.variant_scores(x.scores(), x.variants), phased=True)


FLIPS = """(WITH RECURSIVE two AS (SELECT a.user_id, (a.n + 1) // 2 AS i, a.event_type AS x, b.event_type AS y FROM runs0 a JOIN runs0 b ON b.user_id = a.user_id AND b.n = a.n + 1 WHERE a.n % 2 = 1),
 r(user_id, i, x, y, kept, turned) AS (SELECT user_id, i, x, y, 0, 0 FROM two WHERE i = 1 UNION ALL
  SELECT user_id, i, x, y, least(kept + straight, turned + crossed), least(kept + crossed, turned + straight) FROM (SELECT t.user_id, t.i, t.x, t.y, r.kept, r.turned, CAST(r.x <> t.x AS INT) + CAST(r.y <> t.y AS INT) AS straight, CAST(r.x <> t.y AS INT) + CAST(r.y <> t.x AS INT) AS crossed FROM r JOIN two t ON t.user_id = r.user_id AND t.i = r.i + 1))
 SELECT user_id, arg_max(least(kept, turned), i) AS flips FROM r GROUP BY 1)"""


@query("fewest_flips", "user_id:i flips:i", f"SELECT u.user_id, coalesce(f.flips, 0) AS flips FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN {FLIPS} f ON f.user_id = u.user_id")
def _(x):
    """Least changes of two alternating label sequences of a user's events, swaps allowed."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = x.spark.read.parquet(f"{x.dir}/events.parquet").select("user_id", "event_type", F.row_number().over(order).alias("n"))
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "event_type"))).alias("v")).select("user_id", F.transform("v", lambda s: s.event_type).alias("v"))

    def run(batches):
        for pdf in batches:
            pdf["flips"] = [pure.fewest_flips(v[0::2][: len(v) // 2].tolist(), v[1::2][: len(v) // 2].tolist()) for v in pdf["v"]]
            yield pdf[["user_id", "flips"]]

    return lists.mapInPandas(run, "user_id long, flips long")
