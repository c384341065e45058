"""The query catalogue: every operator on the adapter views, and the same rows in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contigua import functions as fn
from contigua.operators import chain, intervals, matching, placing, ranks, signals, stats, structure
from contigua.plans import views as v
from contigua.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query with its oracle; the oracle's text follows the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with {'recursive ' if recursive else ''}{v.SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return put


def agp(s, d):
    return structure.build(v.comp(s, d))


# Structures


@query("select obj, ctype, part, obj_start, obj_end, comp, comp_start, comp_end, strand from v_agp")
def agp_build(s, d):
    return agp(s, d).select("obj", "ctype", "part", "obj_start", "obj_end", "comp", "comp_start", "comp_end", "strand")


@query("select obj, part, obj_start, obj_end from v_agp where ctype = 'N'")
def agp_split_gaps(s, d):
    return agp(s, d).where("ctype = 'N'").select("obj", "part", "obj_start", "obj_end")


@query("select obj, cast((part + 1) // 2 as bigint) as ord, comp, comp_start, comp_end, strand from v_agp where ctype = 'W'")
def agp_to_block(s, d):
    return agp(s, d).where("ctype = 'W'").selectExpr("obj", "(part + 1) div 2 as ord", "comp", "comp_start", "comp_end", "strand")


@query("select 'new_' || dense_rank() over (order by obj) as name, obj, part from v_agp")
def agp_rename(s, d):
    rows = agp(s, d).select("obj", "part")
    names = ranks.before(rows.select("obj").distinct(), ["obj"]).select("obj", F.concat(F.lit("new_"), F.col("before") + 1).alias("name"))
    return rows.join(names, "obj").select("name", "obj", "part")


@query("select obj, part, comp from v_agp where ctype = 'W' and obj <> comp")
def agp_clean_self(s, d):
    return agp(s, d).where("ctype = 'W' and obj <> comp").select("obj", "part", "comp")


@query("select comp as seq, comp_start as start, comp_end as stop, count(*) as n from v_agp where ctype = 'W' group by all")
def agp_ranges(s, d):
    return agp(s, d).where("ctype = 'W'").groupBy(F.col("comp").alias("seq"), F.col("comp_start").alias("start"), F.col("comp_end").alias("stop")).agg(F.count("*").alias("n"))


@query(""", i as (select comp as obj, comp_start as obj_start, comp_end as obj_end, obj as comp, obj_start as comp_start, obj_end as comp_end, strand from v_agp where ctype = 'W'),
l as (select p_partkey as obj, max(m) as len from part, (select max(len) as m from v_comp) group by 1), u as (select obj, max(obj_end) as reach from i group by obj),
a as (select * from i union all select l.obj, coalesce(reach, 0), len, l.obj, coalesce(reach, 0), len, '+' from l left join u using (obj) where coalesce(reach, 0) < len)
select obj, row_number() over (partition by obj order by obj_start, comp, comp_start, obj_end) as part, obj_start, obj_end, comp, comp_start, comp_end, strand from a""")
def agp_invert(s, d):
    """Every component as long as the longest placement of any; placements begin at 0, so only ends are free."""
    longest = v.comp(s, d).agg(F.max("len").alias("len"))  # one row
    lengths = table(s, d, "part").select(F.col("p_partkey").alias("comp")).crossJoin(F.broadcast(longest))
    return structure.invert_filled(agp(s, d), lengths)


@query(""", child as (select p_partkey as comp, h * 25000 as c_start, h * 25000 + 25000 as c_end, p_partkey * 2 + h as sub, 0 as s_start, 25000 as s_end, case when h = 0 then '+' else '-' end as s_strand from part, (values (0), (1)) t(h)),
j as (select *, greatest(comp_start, c_start) as lo, least(comp_end, c_end) as hi from v_agp join child using (comp) where ctype = 'W' and greatest(comp_start, c_start) < least(comp_end, c_end)),
k as (select obj, case when strand = '+' then obj_start + lo - comp_start else obj_start + comp_end - hi end as a, hi - lo as n, sub, case when s_strand = '+' then s_start + lo - c_start else s_end - (hi - c_start) end as b, case when strand = s_strand then '+' else '-' end as strand from j)
select obj, a as obj_start, a + n as obj_end, sub as comp, b as comp_start, b + n as comp_end, strand from k""")
def agp_compose(s, d):
    child = table(s, d, "part").select(F.col("p_partkey").alias("comp"), F.explode(F.array(F.lit(0), F.lit(1))).alias("h")).selectExpr("comp", "h * 25000 as c_start", "h * 25000 + 25000 as c_end", "comp * 2 + h as sub", "0 as s_start", "25000 as s_end", "case when h = 0 then '+' else '-' end as s_strand")
    return structure.compose(agp(s, d), child)


@query(", w as (select *, max(comp_end) over (partition by comp order by comp_start, comp_end, obj, obj_start rows between unbounded preceding and 1 preceding) as b, lead(comp_start) over (partition by comp order by comp_start, comp_end, obj, obj_start) as a from v_agp where ctype = 'W') select obj, part, comp, comp_start, comp_end from w where b > comp_start or a < comp_end")
def agp_overlap_components(s, d):
    return structure.reused(agp(s, d)).select("obj", "part", "comp", "comp_start", "comp_end")


LIFT = v.FEATURE_SQL + """, lift as (select id, obj, case when strand = '+' then obj_start + start - comp_start else obj_start + comp_end - "end" end as a, "end" - start as n, case when (strand = '+') = (f_strand = '+') then '+' else '-' end as strand
from v_feature join v_agp using (comp) where ctype = 'W' and start >= comp_start and "end" <= comp_end) """


@query(LIFT + "select id, obj, a as start, a + n as stop, strand from lift")
def liftover_features(s, d):
    return structure.liftover(v.feature(s, d), agp(s, d)).withColumnRenamed("end", "stop")


@query(v.FEATURE_SQL + ' select id from v_feature f where not exists (select 1 from v_agp a where a.comp = f.comp and f."end" <= a.comp_end)')
def liftover_dropped(s, d):
    return structure.dropped(v.feature(s, d), agp(s, d)).select("id")


@query(LIFT + "select id, obj, a as start, id || '.' || row_number() over (partition by id order by obj, a, strand) as name from lift")
def liftover_multi_suffix(s, d):
    features = v.feature(s, d)
    # Stored, so that what the structure shuffles is gone before features and stretches move.
    placed = cut(agp(s, d).where("ctype = 'W'").drop("part", "obj_end"), "placed", tidy=True)
    return structure.liftover_numbered(features, placed).select("id", "obj", "start", F.concat("id", F.lit("."), "n").alias("name"))


@query(LIFT + "select obj, count(*) as n_features, cast(min(a) as bigint) as first_start, cast(max(a + n) as bigint) as last_stop from lift group by obj")
def structure_and_liftover(s, d):
    return structure.liftover(v.feature(s, d), agp(s, d)).groupBy("obj").agg(F.count("*").alias("n_features"), F.min("start").alias("first_start"), F.max("end").alias("last_stop"))


# Statistics

N_SQL = """, c as (select len, sum(len) over (order by len desc, obj, ord rows unbounded preceding) as cum, row_number() over (order by len desc, obj, ord) as r, sum(len) over () as total from v_comp)
select n, coalesce((select max(len) from c where 100 * cum >= n * {whole}), 0) as length, coalesce((select min(r) from c where 100 * cum >= n * {whole}), 0) as rank from (select unnest(range(0, 101, 10)) as n)"""


@query(N_SQL.format(whole="total"))
def n50_table(s, d):
    return stats.n_values(v.comp(s, d), "len")


@query(N_SQL.format(whole="2000000000"))
def ng_table(s, d):
    return stats.n_values(v.comp(s, d), "len", 2_000_000_000)


def _length_sql(x: str) -> str:
    out = [f"count({x}) as n, cast(coalesce(sum({x}), 0) as bigint) as total, round(coalesce(avg({x}), 0), 2) as mean, coalesce(min({x}), 0) as least, coalesce(max({x}), 0) as most, coalesce(quantile_cont({x}, 0.5), 0) as median"]
    for c in stats.CLASSES:
        n, total = f"count(*) filter ({x} > {c})", f"coalesce(sum({x}) filter ({x} > {c}), 0)"
        out.append(f"{n} as n_over_{c}, cast({total} as bigint) as sum_over_{c}, round(coalesce(100.0 * {n} / nullif(count({x}), 0), 0), 2) as n_share_{c}, round(coalesce(100.0 * {total} / nullif(sum({x}), 0), 0), 2) as sum_share_{c}")
    return ", ".join(out)


@query(f"select {_length_sql('length(seq)')} from v_seq")
def len_stats(s, d):
    return v.seq(s, d).agg(*stats.length_stats(F.length("seq")))


LEAST_GAP = 10


@query(f"select {_length_sql('obj_end - obj_start')}, (select cast(floor(100.0 * sum(obj_end - obj_start) filter (ctype = 'N') / sum(obj_end - obj_start) + 0.5) as bigint) from v_agp) as genome_share from v_agp where ctype = 'N' and obj_end - obj_start >= {LEAST_GAP}")
def gap_stats(s, d):
    """Gaps of a least length, and what percentage of the whole they are."""
    a = agp(s, d).withColumn("n", F.expr("obj_end - obj_start")).withColumn("g", F.expr(f"if(ctype = 'N' and n >= {LEAST_GAP}, n, null)"))
    share = F.coalesce(F.floor(F.try_divide(100.0 * F.sum("g"), F.sum("n")) + 0.5), F.lit(0))
    return a.agg(*stats.length_stats(F.col("g")), share.alias("genome_share"))


@query("select case when length(seq) > 5000 then 'long' when length(seq) > 500 then 'middle' else 'short' end as class, count(*) as n, cast(sum(length(seq)) as bigint) as total from v_seq group by 1")
def size_classes(s, d):
    n = F.length("seq")
    return v.seq(s, d).groupBy(F.when(n > 5000, "long").when(n > 500, "middle").otherwise("short").alias("class")).agg(F.count("*").alias("n"), F.sum(n).alias("total"))


@query("select *, round(100.0 * (n_g + n_c) / nullif(n_a + n_c + n_g + n_t + n_u + n_n + n_other, 0), 2) as gc, round(100.0 * (n_g + n_c) / nullif(n_a + n_c + n_g + n_t + n_u, 0), 2) as gc_known from (select " + ", ".join(f"cast(sum(length(seq) - length(replace(seq, '{x}', ''))) as bigint) as n_{x.lower()}" for x in "ACGTUN") + ", cast(sum(length(translate(seq, 'ACGTUN', ''))) as bigint) as n_other from v_seq)")
def base_content(s, d):
    return v.seq(s, d).agg(*stats.base_counts(F.col("seq")))


@query("""select kind, mono, count(*) as n, cast(sum("end" - start) as bigint) as total, max("end" - start) as longest, round(stddev_pop("end" - start), 4) as spread, quantile_cont("end" - start, 0.25) as q1 from (select *, chr % 2 = 0 as mono from v_gene) group by grouping sets ((kind), (kind, mono))""")
def feature_stats_grouping_sets(s, d):
    v.gene(s, d).withColumns({"mono": F.expr("chr % 2 = 0"), "n": F.expr("end - start")}).createOrReplaceTempView("contigua_gene")
    return s.sql("select kind, mono, count(*) as n, sum(n) as total, max(n) as longest, round(stddev_pop(n), 4) as spread, percentile(n, 0.25) as q1 from contigua_gene group by grouping sets ((kind), (kind, mono))")


@query("select length(seq) // 200 as bin, count(*) as n from v_seq group by 1")
def length_histogram(s, d):
    return v.seq(s, d).groupBy(F.expr("length(seq) div 200").alias("bin")).agg(F.count("*").alias("n"))


@query("select bin, cast(sum(n) over (order by bin) as bigint) as n_up_to from (select length(seq) // 200 as bin, count(*) as n from v_seq group by 1)")
def cumulative_histogram(s, d):
    return length_histogram(s, d).select("bin", F.sum("n").over(Window.orderBy("bin")).alias("n_up_to"))


# Sequences

RUNS = """, ms as (select seq_id, regexp_extract_all(seq, 'N+') as m, regexp_split_to_array(seq, 'N+') as g from v_seq), pos as (select seq_id, i, length(m[i]) as n, sum(length(g[i]) + length(m[i])) over (partition by seq_id order by i) as e from (select *, unnest(range(1, len(m) + 1)) as i from ms)),
gap as (select seq_id, cast(e - n as bigint) as start, cast(e as bigint) as stop from pos) """


@query(RUNS + "select seq_id, start, stop from gap where stop - start >= 2")
def gap_runs(s, d):
    return v.seq(s, d).select("seq_id", F.inline(fn.runs_of(F.col("seq"), "N+"))).where("end - start >= 2").selectExpr("seq_id", "cast(start as bigint) start", "cast(end as bigint) stop")


@query("select seq_id, i as contig, length(p) as len, sha256(p) as digest from (select seq_id, unnest(range(1, len(g) + 1)) as i, unnest(g) as p from (select seq_id, list_filter(regexp_split_to_array(seq, 'NN+'), lambda x: x <> '') as g from v_seq))")
def contigs_split(s, d):
    parts = F.filter(F.split("seq", "NN+", -1), lambda x: x != "")
    return v.seq(s, d).select("seq_id", F.posexplode(parts).alias("i", "p")).select("seq_id", (F.col("i") + 1).alias("contig"), F.length("p").alias("len"), F.sha2("p", 256).alias("digest"))


@query(""", p as (select seq_id, seq, regexp_split_to_array(seq, 'N+') as g, regexp_extract_all(seq, 'N+') as m from v_seq),
k as (select seq_id, list_transform(range(1, len(g) + 1), lambda i: (case when i > 1 and i < len(g) and length(g[i]) between 1 and 9 then repeat('N', length(g[i])) else g[i] end) || coalesce(m[i], '')) as x from p)
select seq_id, sha256(array_to_string(x, '')) as digest from k""")
def islet_mask(s, d):
    return v.seq(s, d).select("seq_id", F.sha2(fn.without_islets(F.col("seq")), 256).alias("digest"))


@query("select seq_id || '#' || a || '#' || least(a + 1000, length(seq)) as name, sha256(substr(seq, a + 1, 1000)) as digest from (select seq_id, seq, unnest(range(0, length(seq), 1000)) as a from v_seq)")
def chunks(s, d):
    x = v.seq(s, d).where("length(seq) > 0").select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(1000))).alias("a"))
    return x.select(F.concat_ws("#", "seq_id", "a", F.least(F.col("a") + 1000, F.length("seq"))).alias("name"), F.sha2(F.substr("seq", F.col("a") + 1, F.lit(1000)), 256).alias("digest"))


@query(f"select seq_id, sha256(reverse(translate(seq, '{fn.BASES}', '{fn.COMPLEMENTS}'))) as digest from v_seq")
def revcomp(s, d):
    return v.seq(s, d).select("seq_id", F.sha2(fn.reverse_complement(F.col("seq")), 256).alias("digest"))


@query(f""", c as (select seq_id, list_transform(range(0, length(b) - 2, 3), lambda i: substr(b, i + 1, 3)) as c from (select seq_id, translate(seq, 'DEFHIJKLM', 'ACGTACGTA') as b from v_seq))
select seq_id, sha256(array_to_string(list_transform(c, lambda x: case when regexp_full_match(x, '[ACGT]{{3}}') then substr('{fn.AMINO}', (instr('TCAG', substr(x, 1, 1)) - 1) * 16 + (instr('TCAG', substr(x, 2, 1)) - 1) * 4 + instr('TCAG', substr(x, 3, 1)), 1) else 'X' end), '')) as digest from c""")
def codon_translate(s, d):
    return v.seq(s, d).select("seq_id", F.sha2(fn.translated(F.translate("seq", "DEFHIJKLM", "ACGTACGTA")), 256).alias("digest"))


# Intervals


@query(""", f as (select chr, start, gene, kind, case when lag(kind) over w = kind then 0 else 1 end as new from v_gene window w as (partition by chr order by start, gene)), r as (select *, sum(new) over (partition by chr order by start, gene) as run from f)
select chr, cast(run as bigint) as run, kind, count(*) as n from r group by all""")
def rle_runs(s, d):
    return intervals.runs(v.gene(s, d), "chr", ["start", "gene"], "kind")


MERGED = """, i as (select chr, start, "end", case when max("end") over (partition by chr order by start, "end" rows between unbounded preceding and 1 preceding) > start then 0 else 1 end as new from g),
m as (select chr, cast(min(start) as bigint) as start, cast(max("end") as bigint) as stop, count(*) as n from (select *, sum(new) over (partition by chr order by start, "end" rows unbounded preceding) as island from i) group by chr, island) """
WIDE = ', g as (select chr, start, start + 40000 as "end" from v_gene)'


def _wide(s, d):
    return v.gene(s, d).selectExpr("chr", "start", "start + 40000 as end")


@query(WIDE + MERGED + "select chr, start, stop, n from m")
def merge_intervals(s, d):
    return intervals.merge(_wide(s, d), "chr").withColumnRenamed("end", "stop")


@query(WIDE + MERGED + ", e as (select chr, start, stop from m union all select chr, 100000000, 100000000 from (select distinct chr from g)), f as (select chr, coalesce(lag(stop) over (partition by chr order by start, stop), 0) as free_start, start as free_end from e) select chr, free_start, free_end from f where free_start < free_end")
def complement_regions(s, d):
    g = _wide(s, d)
    return intervals.complement(intervals.merge(g, "chr"), "chr", g.select("chr").distinct().withColumn("len", F.lit(100_000_000)))


@query(WIDE + ", o as (select *, row_number() over (partition by chr order by start, \"end\") as n from g), r(chr, n, start, stop, kept) as (select chr, n, start, \"end\", true from o where n = 1 union all select o.chr, o.n, o.start, case when o.start > r.stop then o.\"end\" else r.stop end, o.start > r.stop from r join o on o.chr = r.chr and o.n = r.n + 1) select chr, start, stop from r where kept", recursive=True)
def greedy_nonoverlap(s, d):
    return intervals.greedy(_wide(s, d), "chr").withColumnRenamed("end", "stop")


@query(""", p as (select obj, max(obj_end) * 37 % 10007 * 7 % max(obj_end) as pos from v_agp group by obj), n as (select obj, obj_start as g, obj_end as e from v_agp where ctype = 'N')
select obj, pos, (select max(g) from n where n.obj = p.obj and g <= pos) as up, (select min(e) from n where n.obj = p.obj and e >= pos) as down from p""")
def nearest_gap(s, d):
    a = agp(s, d)
    points = a.groupBy("obj").agg(F.expr("max(obj_end) * 37 % 10007 * 7 % max(obj_end)").alias("pos"))
    return intervals.nearest(points, a.where("ctype = 'N'").selectExpr("obj", "obj_start as start", "obj_end as end"), "obj")


@query(", a as materialized (select obj, ctype, part, obj_start, obj_end, strand from v_agp), m as materialized (select distinct obj, obj_end as at from a where ctype = 'W' and strand = '-') select a.obj, a.part from a left join m on m.obj = a.obj and m.at = a.obj_start where ctype = 'N' and m.obj is null")
def masked_gaps_anti(s, d):
    a = agp(s, d)
    mask = a.where("ctype = 'W' and strand = '-'").selectExpr("obj as m_obj", "obj_end as m_end")
    return a.where("ctype = 'N'").join(mask, F.expr("obj = m_obj and obj_start = m_end"), "left_anti").select("obj", "part")


@query(", x as (select *, lag(\"end\") over (partition by chr order by start, \"end\", gene) as e from v_gene) select chr, gene, e as start, start as stop from x where e < start")
def intergenic(s, d):
    w = Window.partitionBy("chr").orderBy("start", "end", "gene")
    return v.gene(s, d).withColumn("e", F.lag("end").over(w)).where("e < start").selectExpr("chr", "gene", "e as start", "start as stop")


@query('select obj, ord, row_number() over (partition by obj order by ord) as exon, cast((3 - coalesce(sum(len // 7) over (partition by obj order by ord rows between unbounded preceding and 1 preceding), 0) % 3) % 3 as bigint) as phase from v_comp')
def cds_phase(s, d):
    w = Window.partitionBy("obj").orderBy("ord")
    before = F.coalesce(F.sum(F.expr("len div 7")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return v.comp(s, d).select("obj", "ord", F.row_number().over(w).alias("exon"), ((3 - before % 3) % 3).alias("phase"))


# Markers


@query("select k.seq, k.start, k.marker, m.chr, m.pos from v_marker k join v_map m using (marker)")
def marker_join(s, d):
    return v.marker(s, d).join(v.marker_map(s, d), "marker").select("seq", "start", "marker", "chr", "pos")


@query("select distinct marker from v_marker where marker not in (select marker from v_map)")
def unknown_markers(s, d):
    return v.marker(s, d).select("marker").distinct().join(v.marker_map(s, d), "marker", "left_anti")


@query("select marker, count(*) as n from v_marker group by 1 having count(*) > 30")
def multi_copy_markers(s, d):
    return v.marker(s, d).groupBy("marker").agg(F.count("*").alias("n")).where("n > 30")


@query("select distinct seq from (select seq, marker from v_marker group by all having count(*) > 1)")
def chimeric_sequences(s, d):
    return v.marker(s, d).groupBy("seq", "marker").agg(F.count("*").alias("n")).where("n > 1").select("seq").distinct()


JOINED = ", j as (select k.seq, k.start, k.\"end\", m.chr, m.pos from v_marker k join v_map m using (marker)) "


@query(JOINED + "select seq, chr, min(pos) as least, max(pos) as most, count(*) as n from j group by all")
def marker_range(s, d):
    return marker_join(s, d).groupBy("seq", "chr").agg(F.min("pos").alias("least"), F.max("pos").alias("most"), F.count("*").alias("n"))


@query(JOINED + ", c as (select seq, chr, count(*) as n from j group by all), r as (select *, row_number() over (partition by seq order by n desc, chr) as place from c) select seq, max(chr) filter (place = 1) as best_chr, max(n) filter (place = 1) as best, coalesce(max(n) filter (place = 2), 0) as second from r group by seq")
def chr_support_rank(s, d):
    w = Window.partitionBy("seq").orderBy(F.desc("n"), "chr")
    ranked = marker_join(s, d).groupBy("seq", "chr").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w))
    return ranked.groupBy("seq").agg(F.max(F.expr("if(place = 1, chr, null)")).alias("best_chr"), F.max(F.expr("if(place = 1, n, null)")).alias("best"), F.coalesce(F.max(F.expr("if(place = 2, n, null)")), F.lit(0)).alias("second"))


@query(JOINED + """, p as (select seq, pos, lead(pos) over (partition by seq order by start, pos) as nxt from j), t as (select seq, count(*) as n, count(*) filter (pos < nxt) as up, count(*) filter (pos > nxt) as down from p group by seq)
select seq, case when n = 1 then 'single' when up = 0 then '-' when down = 0 then '+' when up > down then '+' when down > up then '-' else 'undetectable' end as direction from t""")
def marker_orientation(s, d):
    j = marker_join(s, d).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "pos"))), lambda x: x["pos"]).alias("places"))
    return j.select("seq", fn.direction(F.col("places")).alias("direction"))


@query(JOINED + ", r as (select seq, pos, \"end\", cast(1 as bigint) as n from j union all select j.seq, j.pos, j.\"end\", max(r.n) + 1 from r join j on j.seq = r.seq and j.pos > r.pos and j.start >= r.\"end\" group by j.seq, j.pos, j.\"end\", j.start) select seq, max(n) as n_markers from r group by seq", recursive=True)
def marker_lis(s, d):
    j = v.marker(s, d).join(v.marker_map(s, d), "marker").select("seq", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return chain.most_markers(j, ["seq"])


@query()
def marker_lis_members(s, d):
    """The markers of each longest run; their number is ``marker_lis``'s."""
    j = v.marker(s, d).join(v.marker_map(s, d), "marker").select("seq", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return chain.marker_members(j, ["seq"]).select("seq", "n_markers", F.posexplode("members").alias("place", "m")).select("seq", "n_markers", "place", "m.*")


# Hits

CHAIN = """, h as (select *, row_number() over (order by tid, qid, ts, qs, te, qe, matches) as id from v_hit where te > ts and qe > qs),
r as (select id, tid, qid, te, qe, {w} as score from h union all select b.id, b.tid, b.qid, b.te, b.qe, max(r.score) + any_value(b.{w2}) from r join h b on b.tid = r.tid and b.qid = r.qid and b.ts - r.te between 0 and 20000 and b.qs - r.qe between 0 and 20000 group by b.id, b.tid, b.qid, b.te, b.qe),
best as (select tid, qid, cast(max(score) as bigint) as score from r group by all) """


@query(CHAIN.format(w="matches", w2="matches") + "select tid, qid, score from best", recursive=True)
def hit_chain_matches(s, d):
    return chain.best_chains(v.hit(s, d), ["tid", "qid"], 20_000)


@query()
def hit_chain_members(s, d):
    """The hits of each heaviest chain and its region; its score is ``hit_chain_matches``'s."""
    c = chain.chain_members(v.hit(s, d), ["tid", "qid"], 20_000)
    return c.select("tid", "qid", "score", "t_start", "t_end", "q_start", "q_end", F.posexplode("members").alias("place", "m")).select("tid", "qid", "score", "t_start", "t_end", "q_start", "q_end", "place", "m.ts", "m.te", "m.qs", "m.qe", F.col("m.w").alias("matches"))


@query(CHAIN.format(w="te - ts", w2="te - b.ts") + "select tid, qid, score from best", recursive=True)
def hit_chain_span(s, d):
    return chain.best_chains(v.hit(s, d).withColumn("span", F.expr("te - ts")), ["tid", "qid"], 20_000, "span")


@query(CHAIN.format(w="matches", w2="matches") + ", k as (select *, row_number() over (partition by qid order by score desc, tid) as n from best) select qid, tid, score from k where n = 1", recursive=True)
def best_target_per_query(s, d):
    return chain.best_per_query(hit_chain_matches(s, d), "qid", "tid").select("qid", "tid", "score")


@query("select tid, qid, case when sum(matches) filter (strand = '+') > coalesce(sum(matches) filter (strand = '-'), 0) then '+' when coalesce(sum(matches) filter (strand = '+'), 0) < sum(matches) filter (strand = '-') then '-' else '.' end as strand from v_hit group by tid, qid")
def best_orientation(s, d):
    g = v.hit(s, d).groupBy("tid", "qid").agg(F.sum(F.expr("if(strand = '+', matches, 0)")).alias("p"), F.sum(F.expr("if(strand = '-', matches, 0)")).alias("m"))
    return g.selectExpr("tid", "qid", "case when p > m then '+' when p < m then '-' else '.' end as strand")


@query("select 'f' as way, tid as a, qid as b, ts, te from v_hit union all select 'r', qid, tid, qs, qe from v_hit")
def paf_pairs(s, d):
    h = v.hit(s, d)
    return h.selectExpr("'f' as way", "tid as a", "qid as b", "ts", "te").unionByName(h.selectExpr("'r' as way", "qid as a", "tid as b", "qs as ts", "qe as te"))


@query(", l as (select tid, max(te) as len from v_hit group by 1) select tid, len, cast(coalesce(sum(len) over (order by len desc, tid rows between unbounded preceding and 1 preceding), 0) as bigint) as at from l")
def genome_offsets(s, d):
    return ranks.before(v.hit(s, d).groupBy("tid").agg(F.max("te").alias("len")), [F.desc("len"), F.col("tid")], "len", "at")


# Copy number and signals

PAIRED = """, f as (select chr, gene, kind, cast(json_extract_string(props, '$.k') as bigint) as k from v_gene), n as (select chr, kind, k, count(*) as n from f group by all), e as (select kind, count(*) as n_kind from f group by 1),
c as (select f.chr, f.gene, f.kind, coalesce(a.n, 0) as h1, coalesce(b.n, 0) as h2, n_kind from f left join n a on a.chr = f.chr - f.chr % 2 and a.kind is not distinct from f.kind and a.k is not distinct from f.k
  left join n b on b.chr = f.chr - f.chr % 2 + 1 and b.kind is not distinct from f.kind and b.k is not distinct from f.k left join e on e.kind is not distinct from f.kind) """


def _paired_copies(s, d):
    """Each gene with its copies (same kind and attribute) on both chromosomes of its pair, u and u xor 1: h1 on the even one, h2 on the odd one."""
    f = v.gene(s, d).select("chr", "gene", "kind", F.get_json_object("props", "$.k").cast("long").alias("k"))
    n = f.groupBy("chr", "kind", "k").agg(F.count("*").alias("n"))
    kinds = f.groupBy(F.col("kind").alias("e_kind")).agg(F.count("*").alias("n_kind"))
    out = f
    for h, chr_of in (("h1", "chr - chr % 2"), ("h2", "chr - chr % 2 + 1")):
        c = n.select(F.col("chr").alias("c_chr"), F.col("kind").alias("c_kind"), F.col("k").alias("c_k"), F.col("n").alias(h))
        out = out.join(c, F.expr(f"c_chr = {chr_of} and c_kind <=> kind and c_k <=> k"), "left").drop("c_chr", "c_kind", "c_k")
    # At most one row for each kind.
    return out.join(F.broadcast(kinds), F.expr("e_kind <=> kind"), "left").select("chr", "gene", "kind", F.coalesce("h1", F.lit(0)).alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2"), "n_kind")


@query(PAIRED + "select chr, gene, kind, h1, h2, case when h1 > 0 then round(h2 / h1, 6) end as ratio, n_kind from c")
def copy_number_join(s, d):
    return _paired_copies(s, d).select("chr", "gene", "kind", "h1", "h2", F.expr("case when h1 > 0 then round(h2 / h1, 6) end").alias("ratio"), "n_kind")


@query(PAIRED + ", u as (select chr, gene, unnest(['more_h1', 'more_h2', 'only_h1', 'only_h2']) as flag, unnest([h1 > h2, h2 > h1, h1 > 0 and h2 = 0, h2 > 0 and h1 = 0]) as here from c) select chr, gene, flag from u where here")
def imbalance_unpivot(s, d):
    flags = _paired_copies(s, d).selectExpr("chr", "gene", "h1 > h2 as more_h1", "h2 > h1 as more_h2", "h1 > 0 and h2 = 0 as only_h1", "h2 > 0 and h1 = 0 as only_h2")
    return flags.unpivot(["chr", "gene"], ["more_h1", "more_h2", "only_h1", "only_h2"], "flag", "here").where("here").select("chr", "gene", "flag")


HOT = """, f as (select chr, start, "end", gene, case when ("end" - start) % 5 = 0 then 1 else 0 end as off from v_gene),
w as (select chr, start, sum(off) over x as n, lead("end", 9) over (partition by chr order by start, "end", gene) as stop from f window x as (partition by chr order by start, "end", gene rows between current row and 9 following)) """


@query(HOT + "select chr, start, stop, cast(n as bigint) as n from w where stop is not null and n > 3")
def hotspot_windows(s, d):
    o = Window.partitionBy("chr").orderBy("start", "end", "gene")
    x = v.gene(s, d).withColumn("off", F.expr("if((end - start) % 5 = 0, 1, 0)"))
    return x.select("chr", "start", F.lead("end", 9).over(o).alias("stop"), F.sum("off").over(o.rowsBetween(0, 9)).alias("n")).where("stop is not null and n > 3")


@query("select kind, count(distinct gene) as n from v_gene group by 1")
def description_counts(s, d):
    return v.gene(s, d).groupBy("kind").agg(F.countDistinct("gene").alias("n"))


@query("select gene, cast(json_extract_string(props, '$.k') as bigint) as k from v_gene")
def json_attr(s, d):
    return v.gene(s, d).select("gene", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select gene, kind as feature, 'c' || chr as seqname, chr % 3 as phase from v_gene")
def gff_attr_parse(s, d):
    line = F.concat(F.lit("ID="), F.col("gene"), F.lit(";feature="), F.col("kind"), F.lit(";seq=c"), F.col("chr"), F.lit(";phase="), F.expr("chr % 3"))
    a = v.gene(s, d).select(fn.attributes(line).alias("a"))
    return a.select(F.col("a")["ID"].cast("long").alias("gene"), F.col("a")["feature"].alias("feature"), F.col("a")["seq"].alias("seqname"), F.col("a")["phase"].cast("long").alias("phase"))


COVER = ", b as (select chr, start // 86400 as bin, count(*) as depth from v_gene group by all) "


def _cover(s, d):
    return v.gene(s, d).groupBy("chr", F.expr("start div 86400").alias("bin")).agg(F.count("*").alias("depth"))


@query(COVER + "select chr, bin, cast(floor(avg(depth) over (partition by chr order by bin rows between 2 preceding and 2 following) + 0.5) as bigint) as mean from b")
def moving_average(s, d):
    w = Window.partitionBy("chr").orderBy("bin").rowsBetween(-2, 2)
    return _cover(s, d).select("chr", "bin", F.floor(F.avg("depth").over(w) + 0.5).alias("mean"))


@query(COVER + ", m as (select chr, start // 86400 as bin from v_gene group by all having count(distinct kind) = 1) select quantile_cont(depth, 0.5) as median from b anti join m using (chr, bin)")
def clean_median(s, d):
    """Masked are the bins whose features are all of one kind."""
    mask = v.gene(s, d).groupBy("chr", F.expr("start div 86400").alias("bin")).agg(F.countDistinct("kind").alias("kinds")).where("kinds = 1").select("chr", "bin")
    return _cover(s, d).join(mask, ["chr", "bin"], "left_anti").groupBy("depth").agg(F.count("*").alias("n")).agg(F.percentile("depth", 0.5, F.col("n")).alias("median"))


CAT = COVER + ", k as (select chr, bin, depth, case when depth <= 0.3 then '0' when depth <= 1.8 then '1' when depth < 7.2 then '2' else 'H' end as category from b) "


@query(CAT + "select chr, bin, category from k")
def coverage_category(s, d):
    return _cover(s, d).select("chr", "bin", fn.coverage_category(F.col("depth"), F.lit(3.0)).alias("category"))


CLASS = CAT + """, w as (select chr, case when category = 'H' and bin % 3 = 0 then 'R' when category = '0' then 'G' else category end as code from k),
c as (select chr, count(*) as n, count(*) filter (code = 'G') as g, count(*) filter (code in ('H', 'R')) as r, count(*) filter (code in ('0', '1')) as l, count(*) filter (code = '2') as t from w group by chr) """


@query(CLASS + "select chr, case when 4 * g > 3 * n then 'GAP' when 4 * r > 3 * n then 'REP' when 4 * l > 3 * n then 'HAP' when 4 * t > 3 * n then 'DIP' when 4 * (t + r) > 3 * n then 'OK' else 'NO' end as class from c")
def region_class(s, d):
    """Depth classes with a mask over them: every third bin's high depth counts as a repeat, no depth as a gap."""
    k = coverage_category(s, d).withColumn("code", F.expr("case when category = 'H' and bin % 3 = 0 then 'R' when category = '0' then 'G' else category end"))
    return stats.region_classes(k.withColumn("n", F.lit(1)), ["chr"], "code", "n").select("chr", "class")


@query("""select l, m, r, case when m in ('DIP', 'OK') then case when sl is not null or sr is not null then 'hybrid_' || concat_ws(':', sl, 'alt', sr) end
when sl = 'left' then 'flanking_left' || case when sr is not null then ':gap:' || sr else '' end when sl = 'rep' and sr is not null then 'flanking_rep:gap:' || sr when sl is null and sr = 'right' then 'flanking_right' end as strategy
from (select l, m, r, case when l in ('DIP', 'OK', 'HAP') then 'left' when l = 'REP' then 'rep' end as sl, case when r in ('DIP', 'OK', 'HAP') then 'right' when r = 'REP' then 'rep' end as sr from (select unnest(['GAP', 'REP', 'HAP', 'DIP', 'OK', 'NO']) as l), (select unnest(['GAP', 'REP', 'HAP', 'DIP', 'OK', 'NO']) as m), (select unnest(['GAP', 'REP', 'HAP', 'DIP', 'OK', 'NO']) as r))""")
def patch_strategy(s, d):
    codes = F.array(*[F.lit(x) for x in ("GAP", "REP", "HAP", "DIP", "OK", "NO")])
    x = s.range(1).select(F.explode(codes).alias("l")).select("l", F.explode(codes).alias("m")).select("l", "m", F.explode(codes).alias("r"))
    return x.select("l", "m", "r", fn.patch_strategy(F.col("l"), F.col("m"), F.col("r")).alias("strategy"))


# Groups and sets


@query("select a.s_nationkey as grp, a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey")
def group_pairs(s, d):
    x = table(s, d, "supplier").selectExpr("s_nationkey as grp", "s_suppkey as a")
    return x.join(x.withColumnRenamed("a", "b"), "grp").where("a <> b")


@query(JOINED + ", k as (select seq, chr, count(*) as n from j group by all), e as (select seq, seq % 19 as placed from (select distinct seq from j)) select seq, placed, case when not bool_or(chr = placed) then 'unsupported' when max(n) filter (chr = placed) <= max(n) filter (chr <> placed) then 'not_highest' else 'ok' end as verdict from k join e using (seq) group by seq, placed")
def conflicts_qc(s, d):
    k = marker_join(s, d).groupBy("seq", "chr").agg(F.count("*").alias("n")).withColumn("placed", F.expr("seq % 19"))
    g = k.groupBy("seq", "placed").agg(F.max(F.expr("if(chr = placed, n, null)")).alias("own"), F.max(F.expr("if(chr <> placed, n, null)")).alias("other"))
    return g.selectExpr("seq", "placed", "case when own is null then 'unsupported' when own <= other then 'not_highest' else 'ok' end as verdict")


@query("select id, max_by(val, src) as val from (select p_partkey as id, p_size as val, 1 as src from part union all select s_suppkey, 1000 + s_nationkey, 2 from supplier) group by id")
def union_last_wins(s, d):
    both = table(s, d, "part").selectExpr("p_partkey as id", "p_size as val", "1 as src").unionByName(table(s, d, "supplier").selectExpr("s_suppkey as id", "1000 + s_nationkey as val", "2 as src"))
    return both.groupBy("id").agg(F.max_by("val", "src").alias("val"))


@query("select l_partkey as id from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_linenumber = 7")
def intersect_required(s, d):
    x = table(s, d, "lineitem")
    return x.where("l_returnflag = 'R'").selectExpr("l_partkey as id").intersect(x.where("l_linenumber = 7").selectExpr("l_partkey as id"))


@query("select o_orderkey as id from orders except select l_orderkey from lineitem")
def except_unused(s, d):
    return table(s, d, "orders").selectExpr("o_orderkey as id").join(table(s, d, "lineitem").selectExpr("l_orderkey as id"), "id", "left_anti").distinct()


@query("select distinct l_suppkey as a, l_partkey % 25 as b from lineitem")
def distinct_breaks(s, d):
    return table(s, d, "lineitem").selectExpr("l_suppkey as a", "l_partkey % 25 as b").distinct()


# Constraints between hits, structures and regions


@query(", h as (select distinct tid, qid, ts, te, qs, qe from v_hit), o as (select *, row_number() over (partition by tid, qid order by ts, te, qs, qe) as n from h), r(tid, qid, n, ts, te, qs, qe, stop, kept) as (select tid, qid, n, ts, te, qs, qe, qe, true from o where n = 1 union all select o.tid, o.qid, o.n, o.ts, o.te, o.qs, o.qe, case when o.qs > r.stop then o.qe else r.stop end, o.qs > r.stop from r join o on o.tid = r.tid and o.qid = r.qid and o.n = r.n + 1) select tid, qid, ts, te, qs, qe, kept from r", recursive=True)
def noncrossing_filter(s, d):
    h = v.hit(s, d).select("tid", "qid", "ts", "te", "qs", "qe").distinct().withColumn("pair", F.struct("tid", "qid"))
    out = intervals.noncrossing(h.withColumns({"m_s": F.col("qs"), "m_e": F.col("qe")}), "pair", ["ts", "te", "qs", "qe"], "m_s", "m_e")
    return out.select("pair.tid", "pair.qid", "ts", "te", "qs", "qe", "kept")


@query(""", k as (select obj, part, greatest(ts, obj_start) as lo, least(te, obj_end) as hi, matches, te - ts as n from v_agp join v_hit on tid = obj where ctype = 'W' and ts < obj_end and te > obj_start)
select obj, part, count(*) as n_hits, cast(min(lo) as bigint) as start, cast(max(hi) as bigint) as stop, cast(sum(matches * (hi - lo) // n) as bigint) as matches from k group by all""")
def component_clip_agg(s, d):
    j = intervals.overlapping(agp(s, d).where("ctype = 'W'"), v.hit(s, d).drop("strand").withColumnRenamed("tid", "obj"), "obj", ("obj_start", "obj_end"), ("ts", "te"))
    k = j.select("obj", "part", F.greatest("ts", "obj_start").alias("lo"), F.least("te", "obj_end").alias("hi"), "matches", F.expr("te - ts as n"))
    return k.groupBy("obj", "part").agg(F.count("*").alias("n_hits"), F.min("lo").alias("start"), F.max("hi").alias("stop"), F.sum(F.expr("matches * (hi - lo) div n")).alias("matches"))


@query(""", l as (select tid, max(te) as len from v_hit group by tid), e as (select tid, qid, ts, te, qs, qe, matches from v_hit join l using (tid) where te >= len - 5000 and qs <= 50000 and matches > 100)
select tid, qid, max(matches) as matches, count(*) as n from e group by all""")
def extremity_overlap(s, d):
    h = v.hit(s, d)
    ends = h.groupBy(F.col("tid").alias("e_tid")).agg(F.max("te").alias("len"))
    return h.where("qs <= 50000 and matches > 100").join(ends, F.expr("tid = e_tid and te >= len - 5000")).groupBy("tid", "qid").agg(F.max("matches").alias("matches"), F.count("*").alias("n"))


@query(""", p as (select tid as a, qid as b, cast(sum(matches) as bigint) as score from v_hit group by all), o as materialized (select *, row_number() over (order by score desc, a, b) as n from p where score > 1000),
r(n, a, b, score, took, ua, ub) as (select cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast(null as bigint), false, cast([] as bigint[]), cast([] as bigint[])
 union all select o.n, o.a, o.b, o.score, not (list_contains(r.ua, o.a) or list_contains(r.ub, o.b)), case when list_contains(r.ua, o.a) or list_contains(r.ub, o.b) then r.ua else list_append(r.ua, o.a) end, case when list_contains(r.ua, o.a) or list_contains(r.ub, o.b) then r.ub else list_append(r.ub, o.b) end from r join o on o.n = r.n + 1)
select a, b, score from r where took""", recursive=True)
def greedy_matching(s, d):
    scores = v.hit(s, d).groupBy(F.col("tid").alias("a"), F.col("qid").alias("b")).agg(F.sum("matches").alias("score"))
    return matching.greedy_matching(scores, 1000)


@query(""", r as (select chr, gene as id, start as a, start + 3600 as b from v_gene
union select r.chr, r.id, least(r.a, min(g.start)), greatest(r.b, max(g."end")) from r join v_gene g on g.chr = r.chr and g.start < r.b and g."end" > r.a group by r.chr, r.id, r.a, r.b)
select chr, id, cast(min(a) as bigint) as a, cast(max(b) as bigint) as b from r group by chr, id""", recursive=True)
def gene_region_fixpoint(s, d):
    """A region at every gene."""
    g = v.gene(s, d)
    return intervals.grow_regions(g.selectExpr("chr", "gene as id", "start as a", "start + 3600 as b"), g.select("chr", "start", "end"), "chr")


@query(""", g as (select *, chr % 2 = 0 as plus from v_gene), m as (select chr, min(start) + 50000 as lo, max("end") - 50000 as hi from g group by chr),
u as (select chr, gene, plus, 'left' as side, start as a, least("end", lo) as b from g join m using (chr) union all select chr, gene, plus, 'right', greatest(start, hi), "end" from g join m using (chr))
select chr, gene, case when plus = (side = 'left') then 'five_prime' else 'three_prime' end as kind, a as start, b as stop from u where a < b""")
def utr_spans(s, d):
    """Exons less the coding span; the side and the strand name the end."""
    g = v.gene(s, d).select("chr", "gene", "start", "end")
    span = g.groupBy(F.col("chr").alias("m_chr")).agg((F.min("start") + 50000).alias("lo"), (F.max("end") - 50000).alias("hi"))
    u = intervals.subtract_span(g.join(span, F.col("chr") == F.col("m_chr")), "lo", "hi")
    return u.select("chr", "gene", F.when(F.expr("(chr % 2 = 0) = (side = 'left')"), "five_prime").otherwise("three_prime").alias("kind"), F.col("u_start").alias("start"), F.col("u_end").alias("stop"))


@query(", t as (select chr, cast(json_extract_string(props, '$.k') as bigint) as k, gene, kind from v_gene), c as (select chr, k from t group by chr, k having count(*) filter (kind = 'purchase') > 0) select t.gene, t.chr, t.k from t left join c on c.chr = t.chr and c.k is not distinct from t.k where c.chr is null")
def transcripts_without_cds(s, d):
    """A transcript is a chromosome's features of one attribute; its coding ones are those of one kind."""
    t = v.gene(s, d).select("gene", "chr", F.get_json_object("props", "$.k").cast("long").alias("k"), "kind")
    coding = t.where("kind = 'purchase'").select(F.col("chr").alias("c_chr"), F.col("k").alias("c_k")).distinct()
    return t.join(coding, F.expr("chr = c_chr and k <=> c_k"), "left_anti").select("gene", "chr", "k")


@query(', l as (select chr, max(start) as len from v_gene group by chr) select gene, chr, start, least("end", len) as stop from v_gene join l using (chr) where start < len')
def exon_clip(s, d):
    """Exons end with their sequence; those beyond it go."""
    g = v.gene(s, d)
    ends = g.groupBy(F.col("chr").alias("l_chr")).agg(F.max("start").alias("len"))
    return g.join(ends, F.expr("chr = l_chr and start < len")).select("gene", "chr", "start", F.least("end", "len").alias("stop"))


@query(""", p as (select obj, max(obj_end) * 37 % max(obj_end) + 7 * obj % max(obj_end) as pos from v_agp group by obj)
select p.obj, p.pos, comp, case when strand = '+' then comp_start + pos - obj_start else comp_end - 1 - (pos - obj_start) end as at from p join v_agp a on a.obj = p.obj and ctype = 'W' and pos >= obj_start and pos < obj_end""")
def liftover_point(s, d):
    a = agp(s, d)
    p = a.groupBy(F.col("obj").alias("p_obj")).agg(F.expr("max(obj_end) * 37 % max(obj_end) + 7 * any_value(obj) % max(obj_end) as pos"))
    j = intervals.within(p.withColumnRenamed("p_obj", "obj").withColumn("next", F.expr("pos + 1")), a.where("ctype = 'W'"), "obj", ("pos", "next"), ("obj_start", "obj_end"))
    return j.select("obj", "pos", "comp", F.expr("case when strand = '+' then comp_start + pos - obj_start else comp_end - 1 - (pos - obj_start) end as at"))


@query(""", p as (select obj, 7919 * obj % max(obj_end) as pos from v_agp group by obj), n as (select obj, obj_start as g, obj_end as e from v_agp where ctype = 'N')
select obj, pos, greatest(0, pos - 20000, coalesce((select max(e) from n where n.obj = p.obj and e <= pos), 0)) as start, pos as stop from p""")
def flanking_clip(s, d):
    """[pos - 20000, pos) as far as the last gap before it leaves it."""
    a = agp(s, d)
    p = a.groupBy("obj").agg(F.expr("7919 * any_value(obj) % max(obj_end) as pos"))
    g = a.where("ctype = 'N'").select(F.col("obj"), F.col("obj_end").alias("start"), F.col("obj_end").alias("end"))
    return intervals.nearest(p, g, "obj").select("obj", "pos", F.greatest(F.lit(0), F.col("pos") - 20000, F.coalesce("up", F.lit(0))).alias("start"), F.col("pos").alias("stop"))


@query(""", b as (select chr, start // 3600 as bin, count(*) as depth from v_gene group by all), x as (select *, row_number() over w as i, count(*) over (partition by chr) as n, depth as c, lag(depth, 1) over w as l1, lag(depth, 2) over w as l2, lag(depth, 3) over w as l3, lag(depth, 4) over w as l4, lead(depth, 1) over w as r1, lead(depth, 2) over w as r2, lead(depth, 3) over w as r3, lead(depth, 4) over w as r4 from b window w as (partition by chr order by bin))
select chr, bin, cast(round(case when n < 5 then c when i = 1 then (69 * c + 4 * r1 - 6 * r2 + 4 * r3 - r4) / 70 when i = 2 then (2 * l1 + 27 * c + 12 * r1 - 8 * r2 + 2 * r3) / 35 when i = n then (69 * c + 4 * l1 - 6 * l2 + 4 * l3 - l4) / 70 when i = n - 1 then (2 * r1 + 27 * c + 12 * l1 - 8 * l2 + 2 * l3) / 35 else (-3 * l2 + 12 * l1 + 17 * c + 12 * r1 - 3 * r2) / 35 end * 70) as bigint) as seventieths from x""")
def savitzky_golay(s, d):
    b = v.gene(s, d).groupBy("chr", F.expr("start div 3600 as bin")).agg(F.count("*").alias("depth"))
    return signals.savitzky_golay(b, "chr", "bin", "depth").select("chr", "bin", F.expr("cast(round(smooth * 70) as bigint) as seventieths"))


@query(", x as (select k.seq % 2 as hap, m.chr, marker, count(distinct k.seq) as n from v_marker k join v_map m using (marker) group by all) select a.chr, a.marker, a.n as h1, b.n as h2 from x a join x b on a.chr = b.chr and a.marker = b.marker where a.hap = 0 and b.hap = 1")
def shared_markers(s, d):
    """Markers that both haplotypes (even and odd sequences) carry."""
    x = marker_join(s, d).groupBy("chr", "marker").agg(F.countDistinct(F.expr("if(seq % 2 = 0, seq, null)")).alias("h1"), F.countDistinct(F.expr("if(seq % 2 = 1, seq, null)")).alias("h2"))
    return x.where("h1 > 0 and h2 > 0")


# Placing


@query(", b as (select chr, start // 3600 as bin, count(*) as depth from v_gene group by all), o as materialized (select *, row_number() over (partition by chr order by bin) as n from b), r(chr, n, bin, first, run) as (select chr, n, bin, depth, cast(1 as bigint) from o where n = 1 union all select o.chr, o.n, o.bin, case when abs(o.depth - r.first) <= 1 then r.first else o.depth end, case when abs(o.depth - r.first) <= 1 then r.run else r.run + 1 end from r join o on o.chr = r.chr and o.n = r.n + 1) select chr, run, first, count(*) as n, min(bin) as start, max(bin) as stop from r group by chr, run, first", recursive=True)
def rle_tolerant(s, d):
    b = v.gene(s, d).groupBy("chr", F.expr("start div 3600 as bin")).agg(F.count("*").alias("depth"))
    return intervals.tolerant_runs(b, "chr", "bin", "depth", 1)


@query(""", h as (select tid, qid, ts, te, bool_or(matches % 97 = 5) as forced from v_hit group by all), f as (select tid, qid, ts, te, forced, count(*) filter (forced) over w - forced::int as seen, count(*) filter (forced) over (partition by tid, qid) as total, row_number() over w as id from h window w as (partition by tid, qid order by ts, te rows unbounded preceding)),
r as (select tid, qid, id, te, seen + forced::int as k, total, te - ts as score from f where seen = 0 union all select f.tid, f.qid, f.id, f.te, any_value(f.seen + f.forced::int), any_value(f.total), max(r.score) + any_value(f.te - f.ts) from r join f on f.tid = r.tid and f.qid = r.qid and f.seen = r.k and f.ts - r.te between 0 and 100000 group by f.tid, f.qid, f.id, f.te)
select tid, qid, cast(max(score) filter (k = total) as bigint) as score from r group by tid, qid""", recursive=True)
def tiling_score_1d(s, d):
    h = v.hit(s, d).groupBy("tid", "qid", "ts", "te").agg(F.bool_or(F.expr("matches % 97 = 5")).alias("forced"))
    return chain.best_tiling(h, ["tid", "qid"], 100_000)


@query(JOINED + """, p as (select seq, chr, '+' as strand, pos, start, "end" from j union all select seq, chr, '-', -pos, start, "end" from j),
r as (select seq, chr, strand, pos, "end", cast(1 as bigint) as n from p union all select p.seq, p.chr, p.strand, p.pos, p."end", max(r.n) + 1 from r join p on p.seq = r.seq and p.chr = r.chr and p.strand = r.strand and p.pos > r.pos and p.start >= r."end" group by p.seq, p.chr, p.strand, p.pos, p."end", p.start),
c as (select seq, chr, strand, max(n) as n from r group by all), k as (select seq, list(n order by n desc, chr desc, strand desc) as n, list(chr order by n desc, chr desc, strand desc) as c, list(strand order by n desc, chr desc, strand desc) as s from c group by seq),
x as (select seq, c[1] as c1, s[1] as s1, case when n[1] > n[2] then 'assigned' when c[1] = c[2] and (len(n) < 3 or n[1] > n[3]) then 'undirected' else 'unreliable' end as verdict from k)
select seq, verdict, case when verdict <> 'unreliable' then c1 end as chr, case verdict when 'assigned' then s1 when 'undirected' then '.' end as strand from x""", recursive=True)
def marker_assignment(s, d):
    j = v.marker(s, d).join(v.marker_map(s, d), "marker").select("seq", "chr", F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return placing.assigned(j)


def _placed(s, d):
    """Each sequence on the chromosome with most of its markers, as a span of map positions."""
    best = chr_support_rank(s, d).select(F.col("seq").alias("b_seq"), F.col("best_chr"))
    x = marker_range(s, d).join(best, F.expr("seq = b_seq and chr = best_chr"))
    return x.selectExpr("chr", "seq", "cast(least as bigint) as start", "cast(most as bigint) as stop", "n as weight", "seq % 1000 as length", "seq % 101 = 0 as forced")


@query(JOINED + """, g as (select seq, chr, min(pos) as a, max(pos) as b, count(*) as w from j group by all), t as (select * from (select *, row_number() over (partition by seq order by w desc, chr) as place from g) where place = 1),
o as (select *, row_number() over (partition by chr order by b, a, seq) as n from t), p as materialized (select o.*, (select count(*) from o x where x.chr = o.chr and x.b < o.a) as before from o),
r(chr, n, best) as (select distinct chr, cast(0 as bigint), [cast(0 as bigint)] from p union all select r.chr, p.n, list_append(r.best, greatest(r.best[p.n], r.best[p.before + 1] + p.w)) from r join p on p.chr = r.chr and p.n = r.n + 1)
select chr, max(best[n + 1]) as score from r group by chr""", recursive=True)
def marker_network_score(s, d):
    x = _placed(s, d).withColumn("forced", F.lit(False))
    none = x.select(F.col("seq").alias("a"), F.col("seq").alias("b")).where("false")
    path = placing.place(x, none).select(F.col("seq").alias("p_seq"), F.col("chr").alias("p_chr"))
    return x.join(path, F.expr("seq = p_seq and chr = p_chr")).groupBy("chr").agg(F.sum("weight").alias("score"))


@query()
def two_haplotype_solve(s, d):
    """Excluded: sequences whose ids follow one another; mates: those 500 apart. Some are forced."""
    x = _placed(s, d)
    return placing.two_haplotypes(x, x.select(F.col("seq").alias("a"), (F.col("seq") + 1).alias("b")), x.select(F.col("seq").alias("a"), (F.col("seq") + 500).alias("b")))


@query(""", g as (select obj, part, obj_start as s, obj_end as e from v_agp where ctype = 'N'), h as (select distinct tid, ts, ts + 40 * (te - ts) as te, qs, qs + 39 * (qe - qs) as qe, strand, matches % 2 = 0 as matched from v_hit),
m as (select obj, part, matched, count(*) as n, min(struct_pack(ts, te, qs, qe, strand)) as h, any_value(s) as s, any_value(e) as e from g join h on tid = obj and ts <= s and te >= e group by all),
c as (select obj, part, s, e, h, case when matched then 'matched' else 'unmatched' end as kind from (select *, row_number() over (partition by obj, part order by matched desc) as place from m) where place = 1 and n = 1),
x as (select *, least(case when h.strand = '+' then h.qs + s - h.ts else h.qs + h.te - e end, 200000) as a, greatest(case when h.strand = '+' then h.qe - (h.te - e) else h.qe - (s - h.ts) end, 0) as b from c),
y as (select *, h.qs <> h.qe and a > b as crossed, (h.qs + h.qe) // 2 as middle from x)
select obj, part, kind, cast(case when h.qs = h.qe then h.qs when not crossed then a when not (a > h.qe or b < h.qs) then middle end as bigint) as start, cast(case when h.qs = h.qe then h.qs when not crossed then b when not (a > h.qe or b < h.qs) then middle end as bigint) as stop from y""")
def gap_mate_project(s, d):
    """Where gaps lie in the mate: by the only matched range that holds the gap, else the only unmatched one."""
    g = agp(s, d).where("ctype = 'N'").select("obj", "part", F.col("obj_start").alias("s"), F.col("obj_end").alias("e"))
    h = v.hit(s, d).selectExpr("tid", "ts", "ts + 40 * (te - ts) as te", "qs", "qs + 39 * (qe - qs) as qe", "strand", "matches % 2 = 0 as matched").distinct()
    m = intervals.within(g, h.withColumnRenamed("tid", "obj"), "obj", ("s", "e"), ("ts", "te")).groupBy("obj", "part", "s", "e", "matched").agg(F.count("*").alias("n"), F.min(F.struct("ts", "te", "qs", "qe", "strand")).alias("h"))
    c = m.groupBy("obj", "part", "s", "e").agg(F.max_by(F.struct("n", "h", "matched"), F.col("matched")).alias("x")).where("x.n = 1").select("obj", "part", "s", "e", "x.matched", "x.h.*")
    at = placing.projected(F.col("s"), F.col("e"), F.col("ts"), F.col("te"), F.col("qs"), F.col("qe"), F.col("strand"), F.lit(200_000))
    return c.withColumn("at", at).select("obj", "part", F.when(F.col("matched"), "matched").otherwise("unmatched").alias("kind"), "at.start", "at.stop")


@query(""", c as (select seq_id, i as phase, substr(b, i + 1) as b from (select seq_id, translate(seq, 'DEFHIJKLM ', 'ACGTACGTAT') as b from v_seq), unnest(range(3)) as t(i)),
p as (select seq_id, phase, list_transform(range(0, length(b) - 2, 3), lambda i: substr(b, i + 1, 3)) as c from c where starts_with(b, 'ATG')), ok as (select seq_id, min(phase) as phase from p where len(list_filter(c[:-2], lambda x: x in ('TAA', 'TAG', 'TGA'))) = 0 group by seq_id)
select v_seq.seq_id, cast(phase as bigint) as phase, phase is null as pseudo from v_seq left join ok using (seq_id)""")
def cds_frame(s, d):
    """The first phase whose reading of the whole sequence starts with ATG and stops nowhere but at its end; without one, a pseudogene."""
    b = v.seq(s, d).select("seq_id", F.expr("translate(seq, 'DEFHIJKLM ', 'ACGTACGTAT') as b"))
    return b.select("seq_id", fn.open_phase(F.col("b")).cast("long").alias("phase")).withColumn("pseudo", F.col("phase").isNull())
