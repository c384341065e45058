import pytest
from pyspark.sql import functions as F

from contigua import sinks, sources


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta(spark, tmp_path):
    df = sources.read_fasta(spark, write(tmp_path, "a.fasta", ">s1 x\nacgtNN\nAC\n>s2\n\n>s3\nGG"))
    assert sorted(map(tuple, df.collect())) == [("s1", "ACGTNNAC"), ("s3", "GG")]
    assert "ACGTNN\nAC" in sinks.fasta_lines(df, 6).where("value like '%s1%'").first()[0]


def test_agp(spark, tmp_path):
    text = "#x\nS9\t1\t2\t1\tN\t2\tscaffold\tyes\tmap\nS9\t3\t12\t2\tW\tC1\t1\t10\t-\n"
    df = sources.read_agp(spark, write(tmp_path, "a.agp", text))
    rows = {r.part: r for r in df.collect()}
    assert (rows[1].gap_len, rows[1].comp) == (2, None) and (rows[2].obj_start, rows[2].comp_start, rows[2].comp_end) == (2, 0, 10)
    assert sorted(r[0] for r in sinks.agp_lines(df).collect()) == sorted(text.splitlines()[1:])


def test_gff_block_coords(spark, tmp_path):
    g = sources.read_gff3(spark, write(tmp_path, "a.gff3", "c1\tx\texon\t11\t90\t.\t+\t.\tID=e1;Parent=m1,m2coverage=9\n"))
    assert sorted((r.start, r.parent) for r in g.collect()) == [(10, "m1"), (10, "m2")]
    b = sources.read_block(spark, write(tmp_path, "a.block", ">O1 note\ns1 0 10 -\n\n#c\ns2 5 9 +\n>O2\ns3 0 1 +\n"))
    assert [(r.obj, r.ord, r.seq_id, r.end) for r in b.orderBy("obj", "ord").collect()] == [("O1", 1, "s1", 10), ("O1", 2, "s2", 9), ("O2", 1, "s3", 1)]
    c = sources.read_coords(spark, write(tmp_path, "a.coords", "1\t10\t20\t11\t10\t10\t99.9\t100\t100\t1\t1\tt\tq\n")).first()
    assert (c.strand, c.q_start, c.q_end, c.matches) == ("-", 10, 20, 9)


def test_depth(spark):
    df = sources.depth_runs(spark.createDataFrame([("c", 0, 10), ("c", 5, 15)], "chrom string, start long, end long"))
    assert sorted((r.start, r.end, r.depth) for r in df.collect()) == [(0, 5, 1), (5, 10, 2), (10, 15, 1)]


def test_line_numbers_over_blocks(spark, tmp_path):
    text = "".join(f"c{i % 7}\t{i}\t{i + 5}\tn{i}\n" for i in range(3000))
    path = write(tmp_path, "a.bed", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sources.read_bed_lines(spark, path).collect()
        assert sorted((r.line, r.start) for r in rows) == [(i + 1, i) for i in range(3000)]
        assert {r.chrom: r.start for r in sources.read_bed_last(spark, path).collect()} == {f"c{i % 7}": i for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_last_and_first_of_repeated_keys(spark, tmp_path):
    f = sources.read_fasta(spark, write(tmp_path, "a.fa", ">s x\nTTTT\n>t\nGG\n>s y\nACGT\n"))
    assert sorted(map(tuple, f.collect())) == [("s", "ACGT"), ("t", "GG")]
    assert [r[0] for r in sources.read_fasta_ids(spark, f"{tmp_path}/a.fa").collect()] == ["s", "s", "t"]
    b = sources.read_bed(spark, write(tmp_path, "b.bed", "c\t1\t5\tx\nc\t1\t5\ty\n"))
    assert [(r.chrom, r.start, r.name) for r in b.collect()] == [("c", 1, "x")]
    a = sources.read_agp(spark, write(tmp_path, "c.agp", "S\t1\t9\t1\tW\tA\t1\t9\t+\nS\t1\t7\t1\tW\tB\t1\t7\t-\n"))
    assert [(r.comp, r.obj_end) for r in a.collect()] == [("B", 7)]
    m = sources.read_marker_map(spark, write(tmp_path, "m.tsv", "#x\nc1\t5\tm\nc2\t9\tm\n"))
    assert [tuple(r) for r in m.collect()] == [("c2", 9, "m")]
    k = sources.read_categories(spark, write(tmp_path, "k.bed", "c\t0\t5\tA\nc\t0\t6\tB\n"))
    assert [tuple(r) for r in k.collect()] == [(0, 6, "B")]


def test_hits(spark, tmp_path):
    p = sources.read_paf(spark, write(tmp_path, "a.paf", "#c\nq\t9\t0\t5\t-\tt\t90\t10\t15\t4\t5\t60\ttag\n")).first()
    assert (p.id, p.qid, p.t_start, p.matches, p.strand) == (2, "q", 10, 4, "-")
    x = sources.read_psl(spark, write(tmp_path, "a.psl", "psLayout\n" + "\t".join(["9", "1", "0", "0", "0", "0", "1", "7", "+", "q", "20", "0", "10", "t", "99", "5", "22"]) + "\n")).collect()
    assert [(r.qid, r.matches, r.hit_len) for r in x] == [("q", 9, 17)]
    h = sources.read_marker_hits(spark, write(tmp_path, "h.tsv", "s\t9\t4\tm\n")).first()
    assert (h.start, h.end) == (4, 9)
    g = "c\tx\tmRNA\t1\t9\t.\t+\t.\tID=a;Name=m1coverage=95.5;identity=90\nc\tx\tmRNA\t1\t9\t.\t+\t.\tID=b;Name=m2;coverage=90;identity=99\n"
    assert [r.name for r in sources.read_cds_hits(spark, write(tmp_path, "g.gff3", g), 90, 80).collect()] == ["m1"]
    assert sources.read_table(spark, f"{tmp_path}/h.tsv", ["a", "b"]).first().b == "9"
    assert spark.createDataFrame([("s1|+",)], "x string").select(sources.oriented(F.col("x")).alias("o")).first().o.asDict() == {"seq_id": "s1", "strand": "+"}


def test_constraints(spark, tmp_path):
    lens = spark.createDataFrame([("a", 10), ("b", 50), ("c", 70)], "seq_id string, len long")
    assert sorted(map(tuple, sources.read_exclusions(spark, write(tmp_path, "e.tsv", "a\tb\n#\n")).collect())) == [("a", "b"), ("b", "a")]
    with pytest.raises(Exception, match="not a pair"):
        sources.read_exclusions(spark, write(tmp_path, "f.tsv", "a\n")).collect()
    assert sorted(map(tuple, sources.read_alternatives(spark, write(tmp_path, "l.tsv", "a,b\tc\n")).collect())) == [("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")]
    r = sources.read_required(spark, write(tmp_path, "r.tsv", "c1\tb|+,a|-,c|-\n"), lens, 20).orderBy("ord")
    assert [tuple(x) for x in r.collect()] == [("c1", 1, "b", "+"), ("c1", 2, "c", "-")] and sources.required_twice(r, r).count() == 2
    p = sources.read_pairs(spark, write(tmp_path, "p.tsv", "c1\ta\tb\nc2\ta\tz\n"), lens, ["chr", "hap1", "hap2"])
    assert sorted((x.chr, x.known) for x in p.collect()) == [("c1", True), ("c2", False)]
    b = sources.read_breakpoints(spark, write(tmp_path, "b.tsv", "a\tBEGIN-5,7-end,\nz\t1-2\n"), lens)
    assert sorted(map(tuple, b.where("known").collect())) == [("a", 0, 5, True), ("a", 7, 10, True)] and b.where("not known").count() == 1
    with pytest.raises(Exception, match="not a pair"):
        sources.read_breakpoints(spark, write(tmp_path, "n.tsv", "a\t1-x\n"), lens).collect()
    assert sources.read_groups(spark, write(tmp_path, "g.tsv", "a\tg1\na\tg2\na\tg1\n")).count() == 2
    assert sources.read_rejected(spark, write(tmp_path, "j.tsv", "a\tH1\t+\n")).first().strand == "+"
    assert sorted(x[0] for x in sources.three_orientations(lens.where("seq_id = 'a'").select("seq_id"), "seq_id").collect()) == ["a|+", "a|-", "a|."]
    rows = spark.createDataFrame([("o", 5, "b", "-", "W"), ("o", 0, "a", "+", "W"), ("o", 3, None, None, "N")], "obj string, obj_start long, comp string, strand string, ctype string")
    names = spark.createDataFrame([("o", "c1", 1), ("o", "c2", 1)], "obj string, chr string, hap int")
    assert sorted(map(tuple, sources.known_structure(rows, names).collect())) == [("c1", 1, 0, "a", "+"), ("c1", 1, 1, "b", "-")]


def test_annotation_and_signals(spark, tmp_path):
    gff = "c\tx\tmRNA\t1\t9\t.\t+\t.\tID=m1;Parent=g1\nc\tx\tmRNA\t1\t9\t.\t+\t.\tID=m1;Parent=g1\nc\tx\texon\t1\t9\t.\t+\t.\tParent=m9\nc\tx\tgene\t1\t9\t.\t+\t.\tID=g1\nc\tx\tmRNA\t1\t9\t.\t+\t.\tID=m2\n"
    g = sources.read_gff3(spark, write(tmp_path, "a.gff3", gff))
    assert sorted(map(tuple, sources.gff_faults(g).collect())) == [("incomplete", "m2"), ("orphan", "m9"), ("repeated", "m1")]
    d = sources.read_descriptions(spark, write(tmp_path, "d.tsv", "m1\tKinase\ng1\tkinase\n"), sources.genes_of(g).distinct())
    assert [tuple(r) for r in d.collect()] == [("g1", "KINASE")]
    lens = spark.createDataFrame([("c1", 6), ("c2", 2)], "seq_id string, len long")
    cov = sources.read_coverage(spark, write(tmp_path, "c.bed", "c1\t2\t7\nc1\t3\t7\nc1\t5\t1\n"), lens)
    assert sorted(map(tuple, cov.collect())) == [("c1", 0, 1, 0), ("c1", 1, 3, 7), ("c1", 3, 4, 0), ("c1", 4, 5, 1), ("c1", 5, 6, 0), ("c2", 0, 2, 0)]
    vector = write(tmp_path, "v.tsv", "1\tG\t2.5\n")
    got = sorted((r.at, r.value, r.word) for r in sources.read_signal(spark, vector, "mixed_int").collect())
    assert got == [(0, 1.0, None), (1, None, "G"), (2, None, "2.5")]
    assert sorted(r.value for r in sources.read_signal(spark, write(tmp_path, "i.tsv", "1\t2.5\t-2.5"), "int").collect()) == [-3, 1, 3]
    with pytest.raises(Exception, match="not a number"):
        sources.read_signal(spark, vector, "float").collect()
    runs = spark.createDataFrame([("c", 0, 2, "7"), ("c", 4, 4, "x")], "chrom string, start long, end long, value string")
    assert sorted(map(tuple, sources.bases_of_runs(runs).collect())) == [("c", 0, "7"), ("c", 1, "7")]
    assert dict(map(tuple, sources.read_steps(spark, write(tmp_path, "s.json", '{"a": "DONE",\n "b": "TODO"}')).collect())) == {"a": "DONE", "b": "TODO"}
    assert sources.read_report(spark, write(tmp_path, "t.tsv", "id\tn\nx\t5\n"), "id string, n long").first().n == 5
    assert sorted(r.start for r in sources.range_list(sinks.gff_to_bed(g).withColumnRenamed("c", "c"), "c").collect()) == [0] * 5


def test_sinks(spark, tmp_path):
    bed = spark.createDataFrame([("c2", 5, 9, "x"), ("c1", 7, 8, None), ("c1", 2, 3, "y")], "chrom string, start long, end long, name string")
    sinks.write_lines(sinks.bed_lines(bed, ["name"]), f"{tmp_path}/bed", ["chrom", "start", "end"], compress=True)
    lines = [r[0] for f in sorted((tmp_path / "bed").glob("part*")) for r in spark.read.text(str(f)).collect()]
    assert lines == ["c1\t2\t3\ty", "c1\t7\t8\t.", "c2\t5\t9\tx"]
    sinks.write_lines(sinks.bed_lines(bed), f"{tmp_path}/by", ["start"], by="chrom")
    assert sorted(x.name for x in (tmp_path / "by").glob("chrom=*")) == ["chrom=c1", "chrom=c2"]
    f = [("c", "s", "gene", 10, 90, None, "+", None, "ID=g", "g", None), ("c", "s", "CDS", 12, 20, None, "+", "0", "Parent=m", "g", "m"), ("c", "s", "exon", 10, 30, None, "+", None, "Parent=m", "g", "m"), ("c", "s", "mRNA", 10, 90, None, "+", None, "ID=m;Parent=g", "g", "m")]
    feats = spark.createDataFrame(f, "seqname string, source string, feature string, start long, end long, score string, strand string, phase string, attr string, gene string, mrna string")
    out = [r.value.split("\t")[2] if "\t" in r.value else r.value for r in sinks.gff3_lines(feats, spark.createDataFrame([("c", 100)], "seq_id string, len long")).orderBy(*sinks.GFF_ORDER).collect()]
    assert out == ["##sequence-region c 1 100", "gene", "mRNA", "exon", "CDS"]
    agp = spark.createDataFrame([("o", "W", 0, 5, "a", 0, 5, "+"), ("o", "W", 9, 12, "b", 1, 4, "-"), ("o", "N", 5, 9, None, None, None, None)], "obj string, ctype string, obj_start long, obj_end long, comp string, comp_start long, comp_end long, strand string")
    block = sinks.block_lines(agp, spark.createDataFrame([("z", 7)], "seq_id string, len long"))
    text = "\n".join(r.value for r in block.orderBy("obj", "ord").collect())
    assert text == ">o\na\t0\t5\t+\nb\t1\t4\t-\n>z\nz\t0\t7\t+"
    back = sources.read_block(spark, write(tmp_path, "x.block", text + "\n"))
    assert sorted((r.obj, r.ord, r.seq_id) for r in back.collect()) == [("o", 1, "a"), ("o", 2, "b"), ("z", 1, "z")]
    assert [r.value for r in sinks.count_lines(spark.createDataFrame([("a", 3)], "locus string, n long"), "locus", "n").orderBy("place", "value").collect()] == ["locus\tn", "a\t3"]
    assert sinks.list_lines(bed, "chrom", "end", ["start"]).where("chrom = 'c1'").first().value == "c1\t3,8"
    runs = spark.createDataFrame([("c", 0, 4, "G"), ("c", 4, 6, "12")], "chrom string, start long, end long, code string")
    assert [r.value for r in sinks.signal_lines(runs).orderBy("start").collect()] == ["c\t0\t4\t0", "c\t4\t6\t12"]
    hit = spark.createDataFrame([("q", 9, 0, 5, "+", "t", 90, 10, 15, 4, 5, 255)], "qid string, q_len int, q_start int, q_end int, strand string, tid string, t_len int, t_start int, t_end int, matches int, hit_len int, mapq int")
    assert sinks.paf_lines(hit).first().value.endswith("4\t5\t255") and sinks.table_lines(hit, ["tid", "qid"]).first().value == "t\tq"
    assert spark.range(1).select(sinks.number_text(F.lit(2.345), 2).alias("x")).first().x == "2.35"
