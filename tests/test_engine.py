import gzip

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandloom.operators import ancestry, impute, panel, stats, validate
from strandloom.plans import api, catalog
from strandloom.sources import bgen, plink, store, vcf

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for table in ("embeddings", "events"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    df = catalog.queries()[name](spark, DATA)
    found = oracle.sql(catalog.oracle_sql()[name])
    assert found.columns == df.columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(map(tuple, found.fetchall()), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 64


def test_unique_haplotypes_worked_example(spark):
    # A worked example of nine haplotypes.
    columns = "abbcbdada"
    rows = [(s + 1, h + 1, int(bit)) for h, c in enumerate(columns) for s, bit in enumerate({"a": "00", "b": "01", "c": "10", "d": "11"}[c])]
    hap = spark.createDataFrame(rows, "variant_idx int, hap_idx int, allele int")
    windows = spark.createDataFrame([(1, 1, 2, 1, 2)], "window int, x_start int, x_end int, h_start int, h_end int")
    found = panel.unique_haplotypes(panel.strands(hap), windows).orderBy("hap_idx").collect()
    assert [r["unique_idx"] for r in found] == [1, 2, 2, 3, 2, 4, 1, 4, 1]
    assert sorted({r["rep"] for r in found}) == [1, 2, 4, 6]
    assert {r["rep"]: r["members"] for r in panel.window_haps(panel.unique_haplotypes(panel.strands(hap), windows)).filter("n_members > 1").collect()} == {1: [1, 7, 9], 2: [2, 3, 5], 6: [6, 8]}


def test_bisection_widths(spark):
    rng = np.random.default_rng(0)
    rows = [(x, h, int(a)) for h in range(1, 40) for x, a in enumerate(rng.integers(0, 2, 40), 1)]
    hap = spark.createDataFrame(rows, "x_idx int, hap_idx int, allele int")
    strands = panel.strands(hap, "x_idx")
    ranges = panel.bisected(strands, 40, d=8)
    assert ranges[0][0] == 1 and ranges[-1][1] == 40 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))
    with pytest.raises(ValueError):
        panel.bisected(strands, 40, d=1)


def _files(tmp_path, n_variants=24, n_ref=20, n_target=4):
    rng = np.random.default_rng(5)
    hap = rng.integers(0, 2, (6, n_variants))[rng.integers(0, 6, 2 * n_ref)]
    target = np.stack([hap[2 * t] + hap[2 * t + 7] for t in range(n_target)])
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    fixed = lambda i: f"1\t{100 + i}\trs{i}\tA\tC\t.\tPASS\t.\t"
    ref = head + "\t".join(f"r{s}" for s in range(n_ref)) + "\n" + "".join(fixed(i) + "GT\t" + "\t".join(f"{hap[2 * s, i]}|{hap[2 * s + 1, i]}" for s in range(n_ref)) + "\n" for i in range(n_variants))
    calls = ["0/0", "1/0", "1/1"]
    tgt = head + "\t".join(f"t{s}" for s in range(n_target)) + "\n"
    for i in range(n_variants):
        if i % 3 != 2:
            tgt += fixed(i) + "GT:DS\t" + "\t".join("./.:." if (i + s) % 9 == 0 else f"{calls[target[s, i]]}:{target[s, i]}.0" for s in range(n_target)) + "\n"
    with gzip.open(tmp_path / "ref.vcf.gz", "wt") as f:
        f.write(ref)
    (tmp_path / "target.vcf").write_text(tgt)
    return target


@pytest.mark.parametrize("options", [{}, {"rescreen": True}, {"dosage": True}, {"scale_allelefreq": True}, {"phase": False}])
def test_files_end_to_end(spark, tmp_path, options):
    truth = _files(tmp_path)
    ref, tgt, out = str(tmp_path / "ref.vcf.gz"), str(tmp_path / "target.vcf"), str(tmp_path / "out.vcf")
    api.compress_haplotypes(spark, ref, tgt, str(tmp_path / "panel"), d=6)
    result = api.phase(spark, tgt, str(tmp_path / "panel"), out, **options)
    wrong = [r for r in result.dosage.collect() if r["g"] != truth[r["sample_idx"] - 1, r["variant_idx"] - 1]]
    assert len(wrong) <= 2
    back = vcf.Vcf(spark, out)
    assert back.sample_ids == ["t0", "t1", "t2", "t3"] and back.variants.count() == 24
    assert back.variants.filter(F.col("info").contains("IMP;") | F.col("info").endswith("IMP")).count() == 8
    assert back.genotypes().count() == 96
    assert len(spark.read.csv(str(tmp_path / "out.sample.error"), header=True).collect()) == 4


def test_compact_round_trip_and_ancestry(spark, tmp_path):
    _files(tmp_path)
    ref, tgt, where = str(tmp_path / "ref.vcf.gz"), str(tmp_path / "target.vcf"), str(tmp_path / "panel")
    api.compress_haplotypes(spark, ref, tgt, where, d=6)
    result = api.phase(spark, tgt, where, str(tmp_path / "compact.loom"))
    key = ["sample_idx", "variant_idx", "a1", "a2"]
    for decoder in (ref, where):  # by the full panel and by the compressed one
        dosage, _ = api.convert_compressed(spark, str(tmp_path / "compact.loom"), decoder)
        assert sorted(map(tuple, dosage.select(*key).collect())) == sorted(map(tuple, result.dosage.select(*key).collect()))
    tables = store.load_panel(spark, where)
    pops = spark.createDataFrame([(f"r{s}", "EUR" if s % 2 else "AFR") for s in range(20)], "sample_id string, population string")
    q_out, out = str(tmp_path / "t.Q"), str(tmp_path / "t.loom")
    q = api.admixture_global(spark, tgt, where, pops, ["AFR", "EUR"], q_out, out)
    assert all(r["AFR"] + r["EUR"] == pytest.approx(1) for r in q.collect())
    assert sorted(map(tuple, q.drop("sample_idx").collect())) == sorted(map(tuple, api.global_admixture(result, tables, pops, ["AFR", "EUR"]).drop("sample_idx").collect()))
    written = spark.read.csv(q_out, header=True)
    assert written.columns == ["AFR", "EUR"] and written.count() == 4 and store.load_phase(spark, out)[0].count() == result.segments.count()
    wide, paint = api.admixture_local(spark, tgt, where, pops, ["AFR", "EUR"], ["red", "blue"], out)
    assert wide.count() == 8 and all(r["s"] == pytest.approx(1) for r in paint.groupBy("sample_idx", "strand").agg(F.sum("frac").alias("s")).collect())
    with pytest.raises(ValueError):
        api.admixture_global(spark, tgt, where, pops, ["AFR"], q_out, out)
    with pytest.raises(ValueError):
        api.admixture_local(spark, tgt, where, pops, ["AFR", "EUR"], ["red"], out)
    with pytest.raises(ValueError, match="phased"):
        api.phase(spark, tgt, where, str(tmp_path / "x.loom"), phase=False)
    with pytest.raises(ValueError, match="must end in"):
        api.phase(spark, tgt, where, str(tmp_path / "x"))
    text = result.report()
    assert text.startswith(f"Total windows = {tables['windows'].count()}, averaging") and "pair search" in text and "phasing" in text
    statistics = api.panel_statistics(spark, where)
    assert statistics["summary"].first()["n_windows"] == statistics["widths"].count() == statistics["haplotypes"].count()
    result.release()
    with pytest.raises(ValueError):
        store.load_panel(spark, ref)


def test_validation(spark):
    variants = spark.createDataFrame([(1, "1", 10, "A"), (2, "1", 20, "C")], "variant_idx int, chrom string, pos long, ref string")
    for rows, text in (([("1", 10, "A"), ("2", 20, "C")], "chromosome"), ([("1", 15, "A")], "15"), ([("1", 20, "G")], "REF")):
        with pytest.raises(ValueError, match=text):
            validate.checked(spark.createDataFrame(rows, "chrom string, pos long, ref string"), variants)


def test_plink(spark, tmp_path):
    rng = np.random.default_rng(2)
    alleles = rng.integers(-1, 3, (9, 7))
    prefix = str(tmp_path / "t")
    (tmp_path / "t.bed").write_bytes(plink.MAGIC + plink.pack(alleles))
    (tmp_path / "t.bim").write_text("".join(f"1\tm{i}\t0\t{i + 1}\tC\tA\n" for i in range(9)))
    (tmp_path / "t.fam").write_text("".join(f"1 s{i} 0 0 0 0\n" for i in range(7)))
    variants, samples, genotypes = plink.read_plink(spark, prefix, variants_per_task=4)
    got = np.full((9, 7), -9)
    for r in genotypes.collect():
        got[r["variant_idx"] - 1, r["sample_idx"] - 1] = -1 if r["gt"] is None else r["gt"]
    assert (got == alleles).all() and variants.count() == 9 and [r["sample_id"] for r in samples.orderBy("sample_idx").collect()] == [f"s{i}" for i in range(7)]
    with pytest.raises(ValueError):
        api.import_target(spark, prefix, dosage=True)


def test_bgen(spark, tmp_path):
    phased = np.array([[1, 0], [0, 0], [1, 1]], float)
    unphased = np.array([[1, 0], [0, 1], [np.nan, np.nan]])
    path = str(tmp_path / "x.bgen")
    bgen.write_bgen(path, [("1", 5, "a", "A", "C", True, phased), ("1", 9, "b", "G", "T", False, unphased)])
    target = api.import_target(spark, path)
    got = {(r["variant_idx"], r["sample_idx"]): r["gt"] for r in target.genotypes.collect()}
    assert got == {(1, 1): 1.0, (1, 2): 2.0, (1, 3): 0.0, (2, 1): 0.0, (2, 2): 1.0, (2, 3): None}
    bgen.write_bgen(path, [("1", 5, "a", "A", "C", True, phased)])
    _, _, hap = api.import_reference(spark, path)
    assert [r["allele"] for r in hap.orderBy("hap_idx").collect()] == [0, 1, 1, 1, 0, 0]


def test_populations(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Person,Ethnic\ns1,GBR\ns2,YRI\n")
    found = ancestry.sample_to_super(store.read_populations(spark, str(tmp_path / "p.csv")))
    assert {tuple(r) for r in found.collect()} == {("s1", "EUR"), ("s2", "AFR")}


def test_scores_of_unseen_variants(spark):
    typed = spark.createDataFrame([(2, 0.5), (4, 1.0), (5, None)], "variant_idx int, score double")
    every = spark.createDataFrame([(i,) for i in range(1, 7)], "variant_idx int")
    assert [r["score"] for r in impute.variant_scores(typed, every).orderBy("variant_idx").collect()] == [0.5, 0.5, 0.75, 1.0, None, 1.0]


def test_sampled_markers(spark):
    every = spark.createDataFrame([(i,) for i in range(100)], "variant_idx int")
    one, two = (sorted(r[0] for r in stats.sampled_markers(every, 10, s).collect()) for s in (1, 1))
    assert one == two and len(one) == 10


def test_search_stream(spark, tmp_path):
    from strandloom.plans.catalog import Fixture
    from strandloom.streaming.targets import search_stream

    x = Fixture(spark, DATA)
    x.geno().coalesce(1).write.parquet(str(tmp_path / "in"))
    unique = x.unique().cache()
    running = search_stream(spark.readStream.schema("variant_idx int, sample_idx int, gt int").parquet(str(tmp_path / "in")), x.windows, x.typed, unique, panel.allele_frequency(x.hap), str(tmp_path / "out"), str(tmp_path / "check"))
    running.processAllAvailable()
    running.stop()
    together = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    assert len(together) == 80
    # Two batches give every sample the result that one gives.
    for n in (0, 1):
        x.geno().filter(f"sample_idx % 2 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    running = search_stream(spark.readStream.schema("variant_idx int, sample_idx int, gt int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in2")), x.windows, x.typed, unique, panel.allele_frequency(x.hap), str(tmp_path / "out2"), str(tmp_path / "check2"))
    running.processAllAvailable()
    running.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out2")).drop("batch").collect())) == together


def test_connected_path_over_all_pairs(spark, tmp_path):
    import itertools

    from strandloom.functions.phasing import pair_error

    # 44 haplotypes, all different on the typed variants of a window but in windows 2 and 5, where six or seven are equal.
    rng = np.random.default_rng(11)
    codes = [rng.permutation(44) % (7 if w in (1, 4) else 44) for w in range(8)]
    bits = np.zeros((44, 64), int)
    for w, code in enumerate(codes):
        for n, i in enumerate(i for i in range(8) if i % 4 != 3):
            bits[:, 8 * w + i] = code >> n & 1
    rows = [(v, (b * 2.0 - 1).tolist(), "0") for v, b in enumerate(bits)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = catalog.Fixture(spark, str(tmp_path))
    members = {(r["window"], r["rep"]): r["members"] for r in x.members().collect()}
    pairs = {}
    for r in x.best().collect():
        pairs.setdefault(r["sample_idx"], {})[r["window"]] = list(itertools.product(members[r["window"], r["hap1"]], members[r["window"], r["hap2"]]))
    assert max(len(p) for of in pairs.values() for p in of.values()) > 20
    found = {}
    for r in catalog.queries()["dp_connect"](spark, str(tmp_path)).collect():
        found.setdefault(r["sample_idx"], {})[r["window"]] = (r["hap1"], r["hap2"], r["best_err"])
    cost = lambda path: sum(map(pair_error, path, path[1:]))
    assert found.keys() == pairs.keys() and len(found) == 10
    for sample, of in pairs.items():
        best = min(itertools.product(*(of[w] for w in sorted(of))), key=cost)
        assert [found[sample][w] for w in sorted(of)] == [(*p, cost(best)) for p in best]


def test_bgen_sample_names(spark, tmp_path):
    rng = np.random.default_rng(5)
    hap = rng.integers(0, 2, (6, 24))[rng.integers(0, 6, 20)]
    ref, tgt, where, out = (str(tmp_path / name) for name in ("ref.bgen", "t.bgen", "panel", "out.vcf"))
    fixed = lambda i: ("1", 100 + i, f"rs{i}", "A", "C")
    bgen.write_bgen(ref, [(*fixed(i), True, 1.0 - hap[:, i].reshape(10, 2)) for i in range(24)], names=[f"r{s}" for s in range(10)])
    g = hap[[0, 2, 4]] + hap[[7, 9, 11]]
    target = [(*fixed(i), False, np.stack([g[:, i] == 0, g[:, i] == 1], 1).astype(float)) for i in range(24) if i % 3 != 2]
    names = lambda: [r["sample_id"] for r in api.import_target(spark, tgt).samples.orderBy("sample_idx").collect()]
    bgen.write_bgen(tgt, target)
    assert names() == ["sample_1", "sample_2", "sample_3"]
    bgen.write_bgen(tgt, target, names=["Ann", "Bö", "C"])
    assert names() == ["Ann", "Bö", "C"]
    api.compress_haplotypes(spark, ref, tgt, where, d=6)
    result = api.phase(spark, tgt, where, out)
    assert vcf.Vcf(spark, out).sample_ids == ["Ann", "Bö", "C"]
    assert [r["sampleID"] for r in spark.read.csv(str(tmp_path / "out.sample.error"), header=True).collect()] == ["Ann", "Bö", "C"]
    pops = spark.createDataFrame([(f"r{s}", "EUR" if s % 2 else "AFR") for s in range(10)], "sample_id string, population string")
    assert all(r["AFR"] + r["EUR"] == pytest.approx(1) for r in api.global_admixture(result, store.load_panel(spark, where), pops, ["AFR", "EUR"]).collect())
    (tmp_path / "t.sample").write_text("ID_1 ID_2 missing\n0 0 0\nf1 x 0\nf1 y 0\nf2 z 0\n")
    assert names() == ["x", "y", "z"]
    (tmp_path / "t.sample").write_text("ID sex\n0 D\nx 1\n")
    with pytest.raises(ValueError, match="samples"):
        names()


def test_rescreen_beside_screening(spark, monkeypatch):
    x = catalog.Fixture(spark, DATA)
    vectors, unique = x.vectors().cache(), x.unique().cache()
    weights = x.spark.range(1, 9).select(F.col("id").cast("int").alias("window"), F.array_repeat(F.lit(3.0), 6).alias("weights"))

    def found(**options) -> dict:
        from strandloom.operators.search import pair_search

        rows = pair_search(vectors, unique, **options)
        return {(r["sample_idx"], r["window"]): (r["hap1"], r["hap2"], r["score"]) for r in rows.collect()}

    rescreened = found(strategy="rescreen")
    assert rescreened != found()
    for options in ({"strategy": "stepwise"}, {"strategy": "thinning"}, {"strategy": "thinning", "weights": weights}):
        assert found(**options, rescreen=True) == rescreened
    assert found(strategy="stepwise", rescreen=True, max_haplotypes=1) == found(strategy="stepwise", max_haplotypes=1)
    # phase_tables hands both options on.
    asked = {}

    class Reached(Exception):
        pass

    def search(*args, **options):
        asked.update(options, strategy=args[2])
        raise Reached

    monkeypatch.setattr(api.search, "pair_search", search)
    with pytest.raises(Reached):
        api.phase_tables(x.geno(), {"typed": x.typed, "windows": x.windows, "unique_typed": unique, "variants": x.variants}, stepwise=2, rescreen=True)
    assert asked["strategy"] == "stepwise" and asked["rescreen"] is True


def test_split_multiallelic_lines_stay_apart(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n"
    lines = [("5", "C", "0|1", "1|1"), ("5", "G", "0|0", "1|0"), ("9", "T", "0|0", "0|1"), ("5", "C", "1|0", "1|1"), ("70000", "T", "1|1", "0|0")]
    (tmp_path / "x.vcf").write_text(head + "".join(f"1\t{pos}\tr\tA\t{alt}\t.\t.\t.\tGT\t{a}\t{b}\n" for pos, alt, a, b in lines))
    found = vcf.Vcf(spark, str(tmp_path / "x.vcf"))
    variants = {r["variant_idx"]: (r["pos"], r["alts"][0]) for r in found.variants.collect()}
    assert [variants[i] for i in range(1, 6)] == [(5, "C"), (5, "C"), (5, "G"), (9, "T"), (70000, "T")]
    got = {}
    for r in found.genotypes().collect():
        got.setdefault(r["variant_idx"], {})[r["sample_idx"]] = r["gt"]
    assert sum(map(len, got.values())) == 10 and got[3] == {1: 0, 2: 1} and got[5] == {1: 2, 2: 0}
    assert found.haplotypes().count() == 20


def test_output_as_one_gzip_file_and_as_parts(spark, tmp_path):
    _files(tmp_path)
    ref, tgt, where = str(tmp_path / "ref.vcf.gz"), str(tmp_path / "target.vcf"), str(tmp_path / "panel")
    api.compress_haplotypes(spark, ref, tgt, where, d=6)
    out = tmp_path / "out.vcf.gz"
    api.phase(spark, tgt, where, str(out)).release()
    assert out.is_file() and not (tmp_path / "out.vcf.gz.parts").exists()
    with gzip.open(out, "rt") as f:
        text = f.read().splitlines()
    assert text[0] == "##fileformat=VCFv4.2" and [line.split("\t")[1] for line in text if line[0] != "#"] == [str(100 + i) for i in range(24)]
    api.phase(spark, tgt, where, str(tmp_path / "parts.vcf"), one_file=False).release()
    assert (tmp_path / "parts.vcf").is_dir() and vcf.Vcf(spark, str(tmp_path / "parts.vcf")).variants.count() == 24
    assert len(spark.read.csv(str(tmp_path / "out.sample.error"), header=True).collect()) == 4


def test_overlapping_windows(spark, tmp_path):
    truth = _files(tmp_path)
    ref, tgt, where, out = str(tmp_path / "ref.vcf.gz"), str(tmp_path / "target.vcf"), str(tmp_path / "panel"), str(tmp_path / "out.vcf")
    for overlap in (-0.1, 1.1):
        with pytest.raises(ValueError):
            api.compress_haplotypes(spark, ref, tgt, where, d=4, overlap=overlap)
    api.compress_haplotypes(spark, ref, tgt, where, d=4, overlap=0.5)
    tables = store.load_panel(spark, where)
    widths = {r["window"]: r["w"] for r in tables["padded"].selectExpr("window", "cast(x_end_pad - x_start_pad + 1 as int) as w").collect()}
    assert {r["window"]: r["w"] for r in tables["unique_padded"].selectExpr("window", "length(bits) as w").distinct().collect()} == widths
    assert sum(widths.values()) > tables["typed"].count()
    result = api.phase(spark, tgt, where, out, scale_allelefreq=True)
    assert sum(r["g"] != truth[r["sample_idx"] - 1, r["variant_idx"] - 1] for r in result.dosage.collect()) <= 4


def test_vcf_to_plink(spark, tmp_path):
    _files(tmp_path)
    plink.vcf_to_plink(spark, str(tmp_path / "target.vcf"), str(tmp_path / "p"))
    found = vcf.Vcf(spark, str(tmp_path / "target.vcf"))
    variants, samples, genotypes = plink.read_plink(spark, str(tmp_path / "p"))
    rows = lambda df: sorted((r["variant_idx"], r["sample_idx"], -1 if r["gt"] is None else r["gt"]) for r in df.collect())
    assert rows(genotypes) == rows(found.genotypes())
    assert [r["sample_id"] for r in samples.orderBy("sample_idx").collect()] == found.sample_ids
    key = lambda df: [(r["pos"], r["ids"], r["ref"], r["alts"]) for r in df.orderBy("variant_idx").collect()]
    assert key(variants) == key(found.variants)


def test_bgen_by_index(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.bgen")
    p = np.array([[1, 0], [0, 0], [1, 1]], float)
    bgen.write_bgen(path, [("1", 5, "a", "A", "C", True, p), ("1", 5, "b", "A", "G", True, p[::-1]), ("1", 9, "c", "G", "T", True, p)])
    read = lambda: sorted(map(str, api.import_target(spark, path).genotypes.collect()))
    plain = read()
    assert len(plain) == 9
    with bgen._open(path) as f:
        info, places = bgen.header(f), []
        f.seek(info["first"])
        for _ in range(3):
            places.append(f.tell())
            bgen.variant(f, True, skip=True)
    with sqlite3.connect(path + ".bgi") as db:
        db.execute("CREATE TABLE Variant (file_start_position INT)")
        db.executemany("INSERT INTO Variant VALUES (?)", [(at,) for at in places])
    assert bgen.indexed_places(path) == places and read() == plain
    with sqlite3.connect(path + ".bgi") as db:
        db.execute("DELETE FROM Variant WHERE file_start_position = ?", (places[0],))
    with pytest.raises(Exception, match="lists 2 variants"):
        read()


def test_order_across_blocks(spark):
    from strandloom.operators import order

    rng = np.random.default_rng(3)
    at = sorted(rng.choice(400_000, 300, replace=False).tolist())
    df = spark.createDataFrame([("b" if i % 3 else "a", p, None if i % 4 else float(i)) for i, p in enumerate(at)], "chrom string, pos int, v double").repartition(5)
    found = order.numbered(df, "n", "pos", first="chrom").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, 301)) and [(r["chrom"], r["pos"]) for r in found] == sorted((r["chrom"], r["pos"]) for r in found)
    near = {r["pos"]: (r["before"], r["after"]) for r in order.neighbours(df, "v", "pos").collect()}
    for i, p in enumerate(at):
        assert near[p] == (float(i - i % 4), float(i + -i % 4) if i + -i % 4 < 300 else None)


def test_guards(spark):
    from strandloom.operators.search import pair_search

    unique = spark.createDataFrame([(1, 1, "01", 1, 1), (1, 2, "10", 2, 2)], "window int, hap_idx int, bits string, rep int, unique_idx int")
    for x, text in (([0.0, 1.0, 2.0], "variants"), ([0.0, float("nan")], "not finite")):
        vectors = spark.createDataFrame([(1, 1, x, [True] * len(x))], "window int, sample_idx int, x array<double>, seen array<boolean>")
        with pytest.raises(Exception, match=text):
            pair_search(vectors, unique).collect()
    with pytest.raises(ValueError, match="strategy"):
        pair_search(vectors, unique, "auto")


def test_bisection_of_5000_markers(spark):
    # 16 windows of 313 and 312 typed markers.
    rows = spark.range(1, 5001).select(F.col("id").cast("int").alias("x_idx"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("hap_idx"))
    ranges = panel.bisected(panel.strands(rows.withColumn("allele", (F.xxhash64("x_idx", "hap_idx") % 2 == 0).cast("int")), "x_idx"), 5000, d=2, minwidth=157)
    assert [hi - lo + 1 for lo, hi in ranges] == [313, 312] * 8


def test_wide_panel_end_to_end(spark):
    from strandloom.plans import derive

    made = derive.wide_panel(spark, DATA, copies=6, targets=6)
    tables = api.compress(made["haplotypes"], made["variants"], made["samples"], made["typed"], d=300, minwidth=40)
    result = api.phase_tables(made["genotypes"], tables)
    found = stats.error_rate(made["truth"], result.dosage).first()
    assert found["n"] == 6 * 384 and found["error_rate"] < 0.05
    scores = result.variant_scores.collect()
    assert len(scores) == 384 and all(r["score"] > 0.5 for r in scores)
    assert result.timings["windows"] == 4 and result.timings["pair_search_s"] > 0
    result.release()


def test_strings_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    h = rng.integers(0, 2, (5, 40))
    hap = spark.createDataFrame([(v + 1, i + 1, int(h[i, v])) for i in range(5) for v in range(40)], "variant_idx int, hap_idx int, allele int").repartition(3)
    monkeypatch.setattr(panel, "BLOCK", 7)
    ranges = spark.createDataFrame([("a", 1, 40), ("b", 8, 8), ("c", 6, 22), ("d", 15, 21)], "name string, lo int, hi int")
    found = {(r["name"], r["hap_idx"]): r["bits"] for r in panel.cut(panel.strands(hap), ranges, ["name"]).collect()}
    assert found == {(n, i + 1): "".join(map(str, h[i, lo - 1 : hi])) for n, lo, hi in (("a", 1, 40), ("b", 8, 8), ("c", 6, 22), ("d", 15, 21)) for i in range(5)}
