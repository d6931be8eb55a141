"""Relational schemas; all indices are 1-based. Haplotypes 2 s - 1 and 2 s belong to reference sample s."""

VARIANTS = "variant_idx int, chrom string, pos long, ids array<string>, ref string, alts array<string>"
SAMPLES = "sample_idx int, sample_id string"
GENOTYPES = "variant_idx int, sample_idx int, gt int, ds float"
HAPLOTYPES = "variant_idx int, hap_idx int, allele int"
WINDOWS = "window int, x_start int, x_end int, h_start int, h_end int"
PAIRS = "sample_idx int, window int, hap1 int, hap2 int, score double"
SEGMENTS = "sample_idx int, strand int, seg_no int, start int, window int, hap_label int"
