"""A PySpark engine for phasing, imputation and ancestry on haplotype panels."""
