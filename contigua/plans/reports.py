"""More of the catalogue: sequences, decisions, curation, reports and lines of files, on the same views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contigua import functions as fn
from contigua import sinks, sources
from contigua.operators import chain, curation, fill, intervals, placing, qc, ranks, sequences, structure
from contigua.plans import catalogue as c
from contigua.plans import views as v
from contigua.plans.catalogue import agp, query
from contigua.session import table

# Sequences of structures

CHUNK = 1000
DOC_SQL = """, d as (select seq_id, seq, seq_id // 10 as obj, row_number() over (partition by seq_id // 10 order by seq_id) as ord, length(seq) as len, case when seq_id % 3 = 0 then '-' else '+' end as strand from v_seq),
w as (select obj, string_agg(case when ord > 1 then repeat('N', 100) else '' end || case when strand = '-' then reverse(translate(seq, '{b}', '{c}')) else seq end, '' order by ord) as whole from d group by obj) """.format(b=fn.BASES, c=fn.COMPLEMENTS)


@query(DOC_SQL + f"select obj, i as chunk, length(substr(whole, i * {CHUNK} + 1, {CHUNK})) as len, sha256(substr(whole, i * {CHUNK} + 1, {CHUNK})) as digest from (select obj, whole, unnest(range(0, (length(whole) + {CHUNK - 1}) // {CHUNK})) as i from w)")
def agp_fasta(s, d):
    """Documents as components of objects, ten each, with gaps between them; sequences come in chunks."""
    x = v.seq(s, d)
    w = Window.partitionBy(F.expr("seq_id div 10")).orderBy("seq_id")
    parts = x.select(F.expr("seq_id div 10").alias("obj"), F.row_number().over(w).cast("long").alias("ord"), F.col("seq_id").alias("comp"), F.length("seq").cast("long").alias("len"), F.expr("if(seq_id % 3 = 0, '-', '+')").alias("strand"))
    out = sequences.assembled(structure.build(parts, 100), sequences.chunked(x, CHUNK), CHUNK)
    return out.select("obj", "chunk", F.length("bases").alias("len"), F.sha2("bases", 256).alias("digest"))


@query(""", k as (select *, lag(comp) over w as c1, lag(comp_end) over w as e1 from (select * from v_agp where ctype = 'W') window w as (partition by obj order by part)), g as (select obj || ':' || (part - 1) as obj, obj as own, obj_start - 1000 as s, obj_start as e, c1, e1, comp as c2, comp_end as e2, c1 % 3 = 0 as there, case when c1 % 3 = 0 then 1000 else 10 end as n from k where c1 is not null)
select obj, 1 as part, 'UP' as region, 'W' as ctype, 0 as obj_start, e1 as obj_end, c1 as comp, 0 as comp_start, e1 as comp_end, '+' as strand from g union all select obj, 2, 'GAP', 'N', e1, e1 + 10000, null, null, null, null from g
union all select obj, 3, 'SEQ', case when there then 'W' else 'S' end, e1 + 10000, e1 + 10000 + n, own, s, e, '+' from g union all select obj, 4, 'GAP', 'N', e1 + 10000 + n, e1 + 20000 + n, null, null, null, null from g union all select obj, 5, 'DOWN', 'W', e1 + 20000 + n, e1 + 20000 + n + e2, c2, 0, e2, '+' from g""")
def gap_targets(s, d):
    """What lies around each gap as a small structure; the stretch of the object itself, where there, stands between."""
    w = Window.partitionBy("obj").orderBy("part")
    a = agp(s, d).where("ctype = 'W'").select("obj", "part", "obj_start", "comp", "comp_end", F.lag("comp").over(w).alias("c1"), F.lag("comp_end").over(w).alias("e1")).where("c1 is not null")
    region = lambda place, comp, start, end, there: F.expr(f"named_struct('place', {place}, 'comp', {comp}, 'start', cast({start} as bigint), 'end', {end}, 'there', {there})")
    three = F.array(region(1, "c1", 0, "e1", "true"), region(2, "obj", "obj_start - 1000", "obj_start", "c1 % 3 = 0"), region(3, "comp", 0, "comp_end", "true"))
    return structure.targets(a.select(F.expr("concat(obj, ':', part - 1)").alias("obj"), F.explode(three).alias("r")).select("obj", "r.*"))


TURNS = """, n as (select obj, obj_start as s, obj_end as e from v_agp where ctype = 'N'), minus as (select obj, obj_start from v_agp where ctype = 'W' and strand = '-'), l as (select obj, max(obj_end) as len from v_agp group by obj),
b as (select n.* from n join minus m on m.obj = n.obj and m.obj_start = n.e) """


def _turns(s, d):
    """Lengths of the objects, and the gaps before components that are turned."""
    a = agp(s, d)
    minus = a.where("ctype = 'W' and strand = '-'").select(F.col("obj").alias("m_obj"), F.col("obj_start").alias("m_start"))
    gaps = a.where("ctype = 'N'").join(minus, F.expr("obj = m_obj and obj_end = m_start")).select(F.col("obj").alias("seq_id"), F.col("obj_start").alias("start"), F.col("obj_end").alias("end"))
    return a.groupBy(F.col("obj").alias("seq_id")).agg(F.max("obj_end").alias("len")), gaps


@query(TURNS + """, p as (select obj, 0 as a, coalesce((select min(s) from b where b.obj = l.obj), len) as z from l union all select b.obj, b.e, coalesce(lead(s) over (partition by b.obj order by s), len) from b join l using (obj)),
k as (select *, row_number() over (partition by obj order by a) as i, count(*) over (partition by obj) as n from p)
select 'b_' || obj || case when n > 1 then '_' || i else '' end as obj, obj as comp, cast(a as bigint) as comp_start, cast(z as bigint) as comp_end from k""")
def agp_broken(s, d):
    """Objects broken at every gap before a turned component."""
    lens, gaps = _turns(s, d)
    return structure.broken(lens, gaps, "b_").select("obj", "comp", "comp_start", "comp_end")


@query(TURNS + """, w as (select v_agp.*, case when strand = '+' and part > 1 then 1 else 0 end as new from v_agp where ctype = 'W'), r as (select *, sum(new) over (partition by obj order by part rows unbounded preceding) as run from w),
g as (select obj, run, min(obj_start) as a, max(obj_end) as z from r group by obj, run), o as (select *, lead(a) over (partition by obj order by run) as nxt, row_number() over (partition by obj order by run) as i from g)
select obj, cast(a as bigint) as start, cast(z as bigint) as stop, cast(case when i = 1 then 0 else a - 1000 end as bigint) as up_start, cast(case when i = 1 then 0 else a end as bigint) as up_end, cast(coalesce(nxt - 1000, z) as bigint) as down_start, cast(coalesce(nxt, z) as bigint) as down_end from o""")
def runs_between_gaps(s, d):
    """Gaps before turned components are no place to break."""
    a = agp(s, d)
    shut = a.where("ctype = 'W' and strand = '-'").selectExpr("obj", "obj_start - 10 as x_start", "obj_start + 10 as x_end")
    return structure.between_gaps(a, 1, shut).withColumnRenamed("end", "stop")


@query(c.WIDE + c.MERGED + """, e as (select chr, start, stop, start + 7 as ms, stop + 9 as me, 0 as last from m union all select chr, 100000000, 100000000, null, null, 1 from (select distinct chr from g)),
f as (select chr, coalesce(lag(stop) over w, 0) as free_start, start as free_end, lag(me) over w as left_mate, ms as right_mate, lag(stop) over w is null as open_left, last = 1 as open_right from e window w as (partition by chr order by start, last))
select chr, cast(free_start as bigint) as free_start, cast(free_end as bigint) as free_end, left_mate, right_mate, open_left, open_right from f where free_start < free_end""")
def complement_context(s, d):
    g = c._wide(s, d)
    m = intervals.merge(g, "chr").selectExpr("chr", "start", "end", "start + 7 as mate_start", "end + 9 as mate_end")
    return intervals.complement_with_context(m, "chr", g.select("chr").distinct().withColumn("len", F.lit(100_000_000).cast("long")))


@query(", l as (select obj, max(obj_end) as len, max(part) as parts from v_agp group by obj) select obj as seq, cast(0 as bigint) as start, cast(obj % 977 as bigint) as stop, parts > 1 as known from l union all select obj, obj % 977 + 5, case when parts > 1 then len end, parts > 1 from l")
def breakpoints(s, d):
    """Lists of pairs as they are given; objects of one component are not known."""
    one = agp(s, d).groupBy("obj").agg(F.max("obj_end").alias("len"), F.max("part").alias("parts"))
    rows = one.select(F.col("obj").alias("seq"), F.expr("concat('BEGIN-', obj % 977, ', ', obj % 977 + 5, '-end,')").alias("breaks"))
    return sources.breakpoints(rows, one.where("parts > 1").select(F.col("obj").alias("seq_id"), "len"))


# Hits


@query("select tid, qid, ts, te, qs, qe, matches from v_hit where te > ts and 100 * matches > 90 * (te - ts) and 100.0 * (qe - qs) / 500 > 20")
def hit_threshold(s, d):
    """Identity above 90 and coverage of a query of 500 bases above 20 percent."""
    return v.hit(s, d).where("te > ts and 100 * matches > 90 * (te - ts) and 100.0 * (qe - qs) / 500 > 20").drop("strand")


@query("select tid, qid, ts, te, qs, qe, matches from v_hit where not (ts = qs and te = qe)")
def self_hits_removed(s, d):
    return v.hit(s, d).where("not (ts = qs and te = qe)").drop("strand")


OFFSETS = """, t as (select tid, max(te) as len from v_hit group by 1), q as (select qid, max(qe) as len from v_hit group by 1), ot as (select tid, coalesce(sum(len) over (order by len desc, tid rows between unbounded preceding and 1 preceding), 0) as o from t),
oq as (select qid, coalesce(sum(len) over (order by len desc, qid rows between unbounded preceding and 1 preceding), 0) as o from q) """


@query(OFFSETS + "select tid, qid, cast(ts + ot.o as bigint) as x1, cast(te + ot.o as bigint) as x2, cast(qs + oq.o as bigint) as y1, cast(qe + oq.o as bigint) as y2 from v_hit join ot using (tid) join oq using (qid) where matches > 200 and 100 * matches > 95 * (te - ts)")
def dotplot_points(s, d):
    """Hits of some size and identity in coordinates of whole genomes."""
    h = v.hit(s, d)

    def offsets(key, end):
        lengths = h.groupBy(F.col(key).alias(f"o_{key}")).agg(F.max(end).alias("len"))
        return ranks.before(lengths, [F.desc("len"), F.col(f"o_{key}")], "len", f"at_{key}").drop("len")

    x = h.where("matches > 200 and 100 * matches > 95 * (te - ts)").join(offsets("tid", "te"), F.col("tid") == F.col("o_tid")).join(offsets("qid", "qe"), F.col("qid") == F.col("o_qid"))
    return x.selectExpr("tid", "qid", "ts + at_tid as x1", "te + at_tid as x2", "qs + at_qid as y1", "qe + at_qid as y2")


@query("select tid, 'q' || qid as qid, ts, te, case when strand = '+' then o + qs else o + qe end as q1, case when strand = '+' then o + qe else o + qs end as q2, matches / (te - ts) as identity, matches from (select *, (matches % 7) * 1000 as o from v_hit where te > ts)")
def chunk_coords(s, d):
    """Hits of chunks (id#start#stop) in coordinates of their sequence, ends swapped on the other strand."""
    x = v.hit(s, d).where("te > ts").withColumn("chunk", F.expr("concat('q', qid, '#', matches % 7 * 1000, '#', matches % 7 * 1000 + 99999)"))
    p = F.split("chunk", "#")
    o = p[1].cast("long")
    plus = F.col("strand") == "+"
    return x.select("tid", p[0].alias("qid"), "ts", "te", F.when(plus, o + F.col("qs")).otherwise(o + F.col("qe")).alias("q1"), F.when(plus, o + F.col("qe")).otherwise(o + F.col("qs")).alias("q2"), (F.col("matches") / (F.col("te") - F.col("ts"))).alias("identity"), "matches")


@query(c.CAT + """, g as (select chr, bin * 8000 as a, bin * 8000 + 8000 as b, case when category = 'H' and bin % 3 = 0 then 'R' else category end as code from k), h as (select distinct tid, ts, te from v_hit),
o as (select tid, ts, te, code, least(te, b) - greatest(ts, a) as n from h join g on chr = tid and ts < b and te > a), x as (select tid, ts, te, sum(n) as n, coalesce(sum(n) filter (code in ('H', 'R')), 0) as r, coalesce(sum(n) filter (code in ('0', '1')), 0) as l, coalesce(sum(n) filter (code = '2'), 0) as t from o group by all)
select v.tid, v.qid, v.ts, v.te, v.matches, coalesce(case when 4 * r > 3 * n then 'REP' when 4 * l > 3 * n then 'HAP' when 4 * t > 3 * n then 'DIP' when 4 * (t + r) > 3 * n then 'OK' end, 'NO') as class, coalesce(4 * r <= 3 * n and (4 * l > 3 * n or 4 * (t + r) > 3 * n), false) as passes from v_hit v left join x on x.tid = v.tid and x.ts = v.ts and x.te = v.te""")
def hit_class(s, d):
    """Hits by the coverage class of the target under them."""
    k = c.coverage_category(s, d).selectExpr("chr", "bin * 8000 as s_start", "bin * 8000 + 8000 as s_end", "if(category = 'H' and bin % 3 = 0, 'R', category) as code")
    h = v.hit(s, d).selectExpr("tid as chr", "qid", "ts", "te", "matches")
    return fill.classified(h, k, []).select(F.col("chr").alias("tid"), "qid", "ts", "te", "matches", "class", "passes")


@query(', g as (select chr, kind, start, start + 40000 as "end" from v_gene), o as (select *, row_number() over (partition by chr, kind order by start, "end") as n from g), r(chr, kind, n, stop, kept) as (select chr, kind, n, "end", 1 from o where n = 1 union all select o.chr, o.kind, o.n, case when o.start > r.stop then o."end" else r.stop end, case when o.start > r.stop then 1 else 0 end from r join o on o.chr = r.chr and o.kind = r.kind and o.n = r.n + 1) select chr, kind, cast(sum(kept) as bigint) as n from r group by chr, kind', recursive=True)
def hits_per_locus(s, d):
    """Hits of a locus that are left when overlapping ones collapse."""
    g = v.gene(s, d).select(F.struct("chr", "kind").alias("locus"), "start", (F.col("start") + 40_000).alias("end"))
    return intervals.greedy(g, "locus").groupBy("locus.chr", "locus.kind").agg(F.count("*").alias("n"))


@query()
def unique_tiles(s, d):
    """One way through each pair's hits, the longest on the target, as rows of a hit table (+, quality 255)."""
    h = v.hit(s, d).withColumn("span", F.expr("te - ts"))
    lens = h.groupBy(F.col("tid").alias("l_tid")).agg(F.max("te").alias("t_len"))
    tiles = chain.chain_members(h, ["tid", "qid"], 100_000_000, "span").select("tid", "qid", "score", F.posexplode("members").alias("place", "m"))
    return tiles.join(lens, F.col("tid") == F.col("l_tid")).select("qid", "tid", "t_len", "score", "place", F.lit("+").alias("strand"), "m.ts", "m.te", "m.qs", "m.qe", F.lit(255).alias("mapq"))


@query()
def best_chain_per_query(s, d):
    """The heaviest chain of each query over all targets and both strands, its region and pseudo mapping quality; ties go to the smaller target, + first."""
    h = v.hit(s, d)
    lens = h.groupBy(F.col("qid").alias("l_qid")).agg(F.max("qe").alias("q_len"))
    chains = chain.chain_members(h, ["tid", "qid", "strand"], 20_000)
    place = F.struct((-F.col("score")).alias("loss"), "tid", "strand")
    best = chains.groupBy("qid").agg(F.min_by(F.struct("tid", "strand", "score", "t_start", "t_end", "q_start", "q_end", "n"), place).alias("x")).select("qid", "x.*")
    return best.join(lens, F.col("qid") == F.col("l_qid")).drop("l_qid").withColumn("mapq", fn.mapq(F.col("score"), F.col("q_len")))


@query()
def tiling_path(s, d):
    """The hits of each tiling; its score is ``tiling_score_1d``'s."""
    h = v.hit(s, d).groupBy("tid", "qid", "ts", "te").agg(F.bool_or(F.expr("matches % 97 = 5")).alias("forced"))
    t = chain.tiling_members(h, ["tid", "qid"], 100_000)
    return t.select("tid", "qid", "score", F.posexplode("members").alias("place", "m")).select("tid", "qid", "score", "place", "m.ts", "m.te", (F.col("m.f") == 1).alias("forced"))


@query()
def tiling_widened(s, d):
    """As ``tiling_score_1d`` from a small limit on, widened until the forced hits fit."""
    h = v.hit(s, d).groupBy("tid", "qid", "ts", "te").agg(F.bool_or(F.expr("matches % 97 = 5")).alias("forced"))
    return chain.widened(h, ["tid", "qid"], 5_000, 20_000, 65_000)


@query()
def marker_network_path(s, d):
    """The sequences of each chromosome's heaviest set in order, with their map ranges; weights add up to ``marker_network_score``."""
    x = c._placed(s, d).withColumn("forced", F.lit(False))
    none = x.select(F.col("seq").alias("a"), F.col("seq").alias("b")).where("false")
    path = placing.place(x, none).select(F.col("seq").alias("p_seq"), F.col("chr").alias("p_chr"), "ord")
    return x.join(path, F.expr("seq = p_seq and chr = p_chr")).select("chr", "ord", "seq", "start", "stop", "weight")


@query()
def merged_orders(s, d):
    """The path of each chromosome with forced sequences put in; forced are those whose ids 101 divides."""
    path = marker_network_path(s, d).select("chr", "ord", F.col("seq").alias("id"))
    w = Window.partitionBy("chr").orderBy("seq")
    forced = c._placed(s, d).where("seq % 101 = 0").select("chr", F.row_number().over(w).cast("long").alias("ord"), F.col("seq").alias("id"))
    return chain.merge_orders(path, forced)


@query(", e as (select obj, ord, comp as a, lead(comp) over (partition by obj order by ord) as b from v_comp) select obj, a, b from e where b is not null")
def path_edges(s, d):
    return chain.edges(v.comp(s, d), ["obj"], ["ord"], "comp")


@query(", e as materialized (select distinct a, b from (select comp as a, lead(comp) over (partition by obj order by ord) as b from v_comp) where b is not null), r as (select 1::bigint as node union select e.b from r join e on e.a = r.node) select node from r", recursive=True)
def reachable_components(s, d):
    """What the first component leads to along all objects."""
    edges = chain.edges(v.comp(s, d), ["obj"], ["ord"], "comp").select("a", "b").distinct()
    return chain.reachable(edges, s.range(1, 2).select(F.col("id").alias("node")))


# Markers and placement


@query(", n as (select *, count(*) over (partition by seq, marker) as n from v_marker) select seq, start, \"end\" as stop, marker, n > 1 as duplicated from n")
def marker_duplicates(s, d):
    w = Window.partitionBy("seq", "marker")
    return v.marker(s, d).select("seq", "start", F.col("end").alias("stop"), "marker", (F.count("*").over(w) > 1).alias("duplicated"))


@query(", t as (select distinct marker from (select seq, marker from v_marker group by all having count(*) > 1)) select seq, start, marker from v_marker anti join t using (marker)")
def markers_without_chimeric(s, d):
    """Hits of markers that no sequence has twice."""
    m = v.marker(s, d)
    twice = m.groupBy("seq", "marker").agg(F.count("*").alias("n")).where("n > 1").select("marker").distinct()
    return m.join(twice, "marker", "left_anti").select("seq", "start", "marker")


@query(", f as (select obj, min(strand) filter (ord = 1) as f from v_comp group by obj) select obj as seq, case when obj % 4 <> 0 then '-' when f in ('+', '-') and obj % 8 = 0 then f else '+' end as strand from f")
def orientation_filled(s, d):
    """Every fourth object has no direction; half of these are looked up at their first component."""
    first = v.comp(s, d).where("ord = 1")
    ids = first.select(F.col("obj").alias("seq"), F.expr("if(obj % 4 = 0, '.', '-')").alias("strand"))
    return qc.filled_orientation(ids, first.where("obj % 8 = 0").select(F.col("obj").alias("seq"), F.col("strand").alias("f_strand")))


@query("select obj, ord, comp from v_comp where comp in (select marker from v_map)")
def mapped_only(s, d):
    """Components of the ordered lists that the map has."""
    return v.comp(s, d).join(v.marker_map(s, d).select(F.col("marker").alias("comp")), "comp", "left_semi").select("obj", "ord", "comp")


DIRECTION = c.JOINED + """, z as (select seq, pos, lead(pos) over (partition by seq order by start, pos) as nxt from j), y as (select seq, count(*) as n, count(*) filter (pos < nxt) as up, count(*) filter (pos > nxt) as down from z group by seq),
dir as (select seq, case when n = 1 then '.' when up = 0 then '-' when down = 0 then '+' when up > down then '+' when down > up then '-' else '.' end as strand from y) """


@query(DIRECTION + """, x as (select dir.seq, dir.strand, case when seq % 5 = 0 then case when seq % 3 = 0 then '-' else '+' end end as f, seq % 2 + 1 as h, method from dir, (values (1), (2), (3), (4)) t(method))
select method, seq, 'markers' as list, null::int as hap, case when f is null then replace(strand, '.', '+') when strand in (f, '.') then f else strand end as strand from x where f is null or strand in (f, '.') or method <> 4
union all select method, seq, 'forced', h, case when strand in (f, '.') or method = 4 then f else strand end from x where f is not null and (strand in (f, '.') or method in (2, 4))
union all select method, seq, 'blacklist', h, o from x, (values ('+'), ('-'), ('.')) u(o) where f is not null and strand not in (f, '.') and method in (3, 4)""")
def marker_policies(s, d):
    """All four policies; forced are the sequences whose ids 5 divides."""
    m = c.marker_orientation(s, d).select("seq", F.expr("if(direction in ('+', '-'), direction, '.')").alias("strand"))
    forced = m.where("seq % 5 = 0").select("seq", F.expr("seq % 2 + 1").alias("hap"), F.expr("if(seq % 3 = 0, '-', '+')").alias("f_strand"))
    each = m.withColumn("method", F.explode(F.array(*[F.lit(x) for x in qc.POLICIES])))
    return qc.marker_policy(each, forced, F.col("method")).select("method", "seq", "list", "hap", "strand")


@query(c.JOINED + ", p as (select distinct seq, chr from j) select seq, chr from p where chr <> seq % 19 and (seq % 4 <> 0 or chr in ((seq + 1) % 19, (seq + 2) % 19, (seq + 5) % 19))")
def placement_allowed(s, d):
    """A sequence is barred from one chromosome; every fourth one has known placements."""
    pairs = c.marker_join(s, d).select("seq", "chr").distinct()
    seqs = pairs.select("seq").distinct()
    known = seqs.where("seq % 4 = 0").select("seq", F.explode(F.expr("array((seq + 1) % 19, (seq + 2) % 19, (seq + 5) % 19)")).alias("chr"))
    return qc.allowed(pairs, seqs.selectExpr("seq", "seq % 19 as chr"), known)


@query(DIRECTION + """, k as (select seq, chr, count(*) as n, min(pos) as lo from j group by all), q as (select distinct seq from v_marker), p as (select seq, seq % 19 as chr, row_number() over (partition by seq % 19 order by seq) as ord, case when seq % 3 = 0 then '-' else '+' end as strand from q),
o as (select p.seq, p.chr, p.ord, p.strand, max(n) filter (k.chr = p.chr) as own, max(n) filter (k.chr <> p.chr) as other, max(lo) filter (k.chr = p.chr) as lo from p left join k using (seq) group by all),
f as (select o.*, dir.strand as dir, case when own is null and other is null then 'Unsupported' when own is null then 'Wrong_chr' when own <= coalesce(other, 0) then 'Not_highest_support' end as first from o left join dir using (seq)),
r as (select *, max(case when first is null then lo end) over (partition by chr order by ord rows between unbounded preceding and 1 preceding) as reach from f),
e as (select seq, chr, ord, coalesce(first, case when lo < reach then 'Wrong_order' end, case when dir in ('+', '-') and dir <> strand then 'Orientation' end) as conflict from r)
select seq, chr, ord, conflict, case when conflict is null or conflict = 'Orientation' then 'kept' when conflict in ('Wrong_chr', 'Wrong_order') then 'released' else 'error' end as verdict from e""")
def placement_conflicts(s, d):
    """Every marked sequence placed by its id, in the order of ids; wrong chromosomes and orders are released, strands ignored."""
    k = c.marker_join(s, d).groupBy("seq", "chr").agg(F.count("*").alias("n"), F.min("pos").alias("lo"))
    w = Window.partitionBy("chr").orderBy("seq")
    p = v.marker(s, d).select("seq").distinct().selectExpr("seq", "seq % 19 as chr", "if(seq % 3 = 0, '-', '+') as strand").withColumn("ord", F.row_number().over(w))
    n = k.withColumn("own_chr", F.expr("seq % 19")).groupBy(F.col("seq").alias("k_seq")).agg(F.max(F.expr("if(chr = own_chr, n, null)")).alias("own"), F.max(F.expr("if(chr <> own_chr, n, null)")).alias("other"), F.max(F.expr("if(chr = own_chr, lo, null)")).alias("least"))
    dirs = c.marker_orientation(s, d).withColumnRenamed("seq", "d_seq")
    placed = p.join(n, F.col("seq") == F.col("k_seq"), "left").join(dirs, F.col("seq") == F.col("d_seq"), "left")
    return qc.after_policy(qc.conflicts(placed), ["Wrong_chr", "Wrong_order"], ["Orientation"]).select("seq", "chr", "ord", "conflict", "verdict")


@query(c.JOINED + """, u as (select seq, pos from j where chr = seq % 19 union all select seq // 10, pos from j where "end" <= 5000), p as (select distinct seq from v_marker)
select u.seq, u.seq % 19 as chr, case when u.seq % 3 = 0 then '-' else '+' end as strand, count(*) as n, min(pos) as least, max(pos) as most from u join p using (seq) group by u.seq""")
def marker_usage(s, d):
    """Markers on the chromosome where a sequence is placed, and those lifted from the ten parts of an older one."""
    m = v.marker(s, d)
    placed = m.select("seq").distinct().selectExpr("seq", "seq % 19 as chr", "if(seq % 3 = 0, '-', '+') as strand")
    legacy = m.select("seq").distinct().select(F.expr("seq div 10").alias("obj"), F.lit("W").alias("ctype"), F.lit(1).alias("part"), F.expr("seq % 10 * 6000").alias("obj_start"), F.expr("seq % 10 * 6000 + 5000").alias("obj_end"), F.col("seq").alias("comp"), F.lit(0).cast("long").alias("comp_start"), F.lit(5000).cast("long").alias("comp_end"), F.lit("-").alias("strand"))
    marks = m.select(F.col("marker").alias("id"), F.col("seq").alias("comp"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit("+").alias("f_strand"))
    lifted = structure.liftover(marks, legacy).join(v.marker_map(s, d), F.col("id") == F.col("marker")).select(F.col("obj").alias("seq"), "chr", "pos")
    return qc.marker_usage(c.marker_join(s, d).select("seq", "chr", "pos"), placed, lifted)


@query(", l as (select obj, list(comp) as cs from v_comp group by obj) select a.obj, list_has_any(a.cs, b.cs) as overlap from l a join l b on b.obj = a.obj + 1")
def list_overlap(s, d):
    """Whether neighbouring objects have a component in common."""
    x = v.comp(s, d).groupBy("obj").agg(F.collect_set("comp").alias("cs"))
    y = x.select((F.col("obj") - 1).alias("b_obj"), F.col("cs").alias("b_cs"))
    return x.join(y, F.col("obj") == F.col("b_obj")).select("obj", F.arrays_overlap("cs", "b_cs").alias("overlap"))


@query(c.JOINED + ", x as (select chr, marker, count(distinct seq) filter (seq % 2 = 0) as h1, count(distinct seq) filter (seq % 2 = 1) as h2, bool_or(chr = seq % 19) as used from (select k.seq, m.chr, marker from v_marker k join v_map m using (marker)) group by all) select chr, marker, h1, h2, used from x where h1 > 0 and h2 > 0")
def marker_correspondence(s, d):
    """Markers of both haplotypes, and whether one of their sequences is placed on their chromosome."""
    x = c.marker_join(s, d).groupBy("chr", "marker").agg(F.countDistinct(F.expr("if(seq % 2 = 0, seq, null)")).alias("h1"), F.countDistinct(F.expr("if(seq % 2 = 1, seq, null)")).alias("h2"), F.bool_or(F.expr("chr = seq % 19")).alias("used"))
    return x.where("h1 > 0 and h2 > 0")


@query(""", q as (select s_suppkey as seq, case when s_suppkey % 5 > 0 then s_suppkey % 5 end as chr from supplier), a as (select s_suppkey as seq, n_regionkey as mol, n_regionkey % 5 as chr from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 3 > 0),
b as (select distinct l_suppkey as seq, l_partkey % 7 as mol, l_partkey % 7 % 2 as chr from lineitem where l_linenumber = 7 and l_quantity > 40), x as (select seq, count(distinct mol) as n, count(distinct chr) as k, min(chr) as o from a group by seq), y as (select seq, count(distinct mol) as n, count(distinct chr) as k, min(chr) as o from b group by seq)
select q.seq, q.chr, case when x.k > 1 then true when q.chr is not null then x.o <> q.chr end as chr_assoc, x.n > 1 as mult_assoc, case when y.k > 1 then true when q.chr is not null then y.o <> q.chr end as chr_alt, y.n > 1 as mult_alt,
coalesce(q.chr, case when coalesce(x.k, 1) = 1 and coalesce(y.k, 1) = 1 and coalesce(x.o = y.o, true) then coalesce(x.o, y.o) end) as resolved from q left join x using (seq) left join y using (seq)""")
def association_flags(s, d):
    """Unplaced suppliers, with the regions of their nations and the parts they send late."""
    sup = table(s, d, "supplier")
    seqs = sup.selectExpr("s_suppkey as seq", "if(s_suppkey % 5 > 0, s_suppkey % 5, null) as chr")
    a = sup.where("s_suppkey % 3 > 0").join(table(s, d, "nation"), F.expr("n_nationkey = s_nationkey")).selectExpr("s_suppkey as seq", "n_regionkey as mol", "n_regionkey % 5 as chr")
    b = table(s, d, "lineitem").where("l_linenumber = 7 and l_quantity > 40").selectExpr("l_suppkey as seq", "l_partkey % 7 as mol", "l_partkey % 7 % 2 as chr").distinct()
    return qc.association_flags(seqs, a, b)


# Decisions about gaps


@query("""select l, m, r, case m when 'DIP' then concat_ws(':', sl, 'altF', sr) when 'OK' then concat_ws(':', sl, 'alt', sr) when 'REP' then concat_ws(':', sl, 'altR', sr) else
case coalesce(sl, '-') || coalesce(sr, '-') when 'leftright' then 'left:gap:right' when 'leftrep' then 'left:gap:rep' when 'left-' then 'left' when 'repright' then 'rep:gap:right' when '-right' then 'right' end end as strategy
from (select l, m, r, case when l in ('DIP', 'OK') then 'left' when l = 'REP' then 'rep' end as sl, case when r in ('DIP', 'OK') then 'right' when r = 'REP' then 'rep' end as sr from (select unnest(['GAP', 'REP', 'HAP', 'DIP', 'OK', 'NO']) as l), (select unnest(['GAP', 'REP', 'HAP', 'DIP', 'OK', 'NO']) as m), (select unnest(['GAP', 'REP', 'HAP', 'DIP', 'OK', 'NO']) as r))""")
def mate_strategy(s, d):
    """What the mate's regions say about a gap, for every combination."""
    codes = F.array(*[F.lit(x) for x in ("GAP", "REP", "HAP", "DIP", "OK", "NO")])
    x = s.range(1).select(F.explode(codes).alias("l")).select("l", F.explode(codes).alias("m")).select("l", "m", F.explode(codes).alias("r"))
    return x.select("l", "m", "r", fn.alt_strategy(F.col("l"), F.col("m"), F.col("r")).alias("strategy"))


FILL = """, f as (select tid, qid, qid as i1, (qid + tid) % 3 as i2, case qid % 3 when 0 then 'hybrid_left:alt' when 1 then 'flanking_left' end as st, tid % 2 = 0 as m1, tid % 3 > 0 as m2, coalesce(sum(matches) filter (strand = '+'), 0) as p1, sum(matches) as a1, coalesce(sum(matches) filter (strand = '-'), 0) as p2, sum(qe - qs) as a2, sum(te - ts) as len from v_hit group by tid, qid),
u as (select *, case when i1 = i2 then 'T1' when coalesce(st like 'hybrid%', false) and m1 then case when p2 - p1 > 0.5 * p1 and a2 - a1 > 0.5 * a1 then 'T2' else 'T1' end when m2 then case when p2 - p1 > -0.5 * p2 and a2 - a1 > -0.5 * a2 then 'T2' else 'T1' end when m1 then 'T1' end as use from f) """


@query(FILL + "select tid, qid, case when use = 'T1' and 100.0 * p1 / len >= 40 then 'T1' when use = 'T2' and 100.0 * p2 / len >= 40 then 'T2' end as filler from u")
def filler_choice(s, d):
    """Two fillers for each pair, by the hits of both strands."""
    g = v.hit(s, d).groupBy("tid", "qid").agg(F.sum(F.expr("if(strand = '+', matches, 0)")).alias("p1"), F.sum("matches").alias("a1"), F.sum(F.expr("if(strand = '-', matches, 0)")).alias("p2"), F.sum(F.expr("qe - qs")).alias("a2"), F.sum(F.expr("te - ts")).alias("len"))
    g = g.withColumn("st", F.expr("case qid % 3 when 0 then 'hybrid_left:alt' when 1 then 'flanking_left' end"))
    t1 = {"id": F.col("qid"), "strategy": F.coalesce("st", F.lit("")), "mapped": F.expr("tid % 2 = 0"), "passed": F.col("p1"), "all": F.col("a1"), "length": F.col("len")}
    t2 = {"id": F.expr("(qid + tid) % 3"), "mapped": F.expr("tid % 3 > 0"), "passed": F.col("p2"), "all": F.col("a2"), "length": F.col("len")}
    return g.select("tid", "qid", fill.chosen_filler(t1, t2, 40).alias("filler"))


@query(""", g as (select chr, gene, start, start + 40000 as e from v_gene), p as (select chr as id, case when chr % 4 > 0 then 50000 + chr * 100 end as rs, 450000 as ls from (select distinct chr from g)),
k as (select id, rs - greatest(0, min(start) - 3) as shift from p join g on chr = id and start < rs and rs < e group by id, rs), x as (select p.*, coalesce(shift, 0) as shift from p left join k using (id)),
h as (select id, list(distinct gene order by gene) as harmed from x join g on chr = id and shift > 0 and start < ls - shift and ls - shift < e group by id)
select id, case when rs is null then 'disjointed' else 'overlapping' end as status, cast(shift as bigint) as shift, cast(case when id % 2 = 0 then 0 else shift end as bigint) as l_start, cast(case when id % 2 = 0 then 500000 - shift else 500000 end as bigint) as l_end,
cast(case when id % 3 = 0 then coalesce(rs - shift, 0) else 0 end as bigint) as r_start, cast(case when id % 3 = 0 then 600000 else 600000 - coalesce(rs - shift, 0) end as bigint) as r_end, array_to_string(coalesce(harmed, []), ',') as harmed from x left join h using (id)""")
def refined_regions(s, d):
    """Two regions for each chromosome, overlapping in three of four."""
    g = v.gene(s, d).select(F.col("chr").alias("id"), "gene", "start", (F.col("start") + 40_000).alias("end"))
    n = lambda x: F.lit(x).cast("long")
    p = g.select("id").distinct().select("id", n(0).alias("l_start"), n(500_000).alias("l_end"), F.expr("if(id % 2 = 0, '+', '-')").alias("l_strand"), n(0).alias("r_start"), n(600_000).alias("r_end"), F.expr("if(id % 3 = 0, '+', '-')").alias("r_strand"), n(450_000).alias("left_stop"), F.expr("if(id % 4 > 0, 50000 + id * 100, null)").alias("right_stop"))
    return fill.refined(p, g, g).withColumn("harmed", F.array_join("harmed", ","))


# Gene models

MODELS = """, x0 as (select chr, 'm' || chr || '.' || json_extract_string(props, '$.k') as mrna, 'g' || chr as gene, start // 1000 as s, start // 1000 + 1 + ("end" - start) % 9 as e from v_gene),
x1 as (select *, case when max(e) over (partition by mrna order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as new from x0), x2 as (select *, sum(new) over (partition by mrna order by s, e rows unbounded preceding) as i from x1),
exon as (select mrna, any_value(chr) as chr, any_value(gene) as gene, min(s) as s, max(e) as e from x2 group by mrna, i) """


def _parts(s, d):
    """Coding parts of transcripts: a chromosome's features of one attribute, in thousands of seconds."""
    x = v.gene(s, d).withColumn("k", F.get_json_object("props", "$.k"))
    return x.selectExpr("chr", "concat('m', chr, '.', k) as mrna", "concat('g', chr) as gene", "start div 1000 as start", "start div 1000 + 1 + (end - start) % 9 as end")


def _exons(s, d):
    p = _parts(s, d)
    return curation.exons_from(p).join(p.select("mrna", "gene", "chr").distinct(), "mrna")


@query(MODELS + ", n as (select *, row_number() over (partition by mrna order by s) as k from exon) select mrna, k as exon, s as start, e as stop, 'ID=' || mrna || '.exon_' || k || ';Parent=' || mrna as attr from n")
def exon_models(s, d):
    """Exons from coding parts, numbered and named."""
    return curation.exon_names(_exons(s, d)).select("mrna", "exon", "start", F.col("end").alias("stop"), "attr")


@query(MODELS + ", n as (select mrna, lag(e) over (partition by mrna order by s) as a, s from exon) select mrna, a as start, s as stop from n where a < s")
def introns(s, d):
    return curation.introns(_exons(s, d)).withColumnRenamed("end", "stop")


@query(MODELS + ", m as (select gene, mrna, min(s) as start, max(e) as stop from exon group by all) select *, min(start) over (partition by gene) as gene_start, max(stop) over (partition by gene) as gene_stop from m")
def model_spans(s, d):
    x = _exons(s, d)
    return curation.spans(x.select("mrna", "start", "end"), x.select("mrna", "gene").distinct()).withColumnsRenamed({"end": "stop", "gene_end": "gene_stop"})


TRANSCRIPTS = MODELS + ", t as (select mrna, string_agg(case when chr % 2 = 0 then substr(seq, s + 1, e - s) else reverse(translate(substr(seq, s + 1, e - s), '{b}', '{c}')) end, '' order by case when chr % 2 = 0 then s else -s end) as q from exon join v_seq on seq_id = chr group by mrna) ".format(b=fn.BASES, c=fn.COMPLEMENTS)


def _transcripts(s, d):
    parts = _exons(s, d).select("mrna", F.col("chr").alias("seqname"), "start", "end", F.expr("if(chr % 2 = 0, '+', '-')").alias("strand"))
    return sequences.whole(sequences.assembled(sequences.spliced(parts), sequences.chunked(v.seq(s, d))))


@query(TRANSCRIPTS + "select mrna, length(q) as len, sha256(q) as digest from t where q <> ''")
def transcript_sequences(s, d):
    """Exons of each transcript joined in the order of reading; sequences end where their text ends."""
    return _transcripts(s, d).where("seq <> ''").select(F.col("obj").alias("mrna"), F.length("seq").alias("len"), F.sha2("seq", 256).alias("digest"))


FRAMES = TRANSCRIPTS + """, b as (select mrna, translate(q, 'DEFHIJKLM ', 'ACGTACGTAT') as q from t where q <> ''), ph as (select mrna, i as phase, list_transform(range(0, length(substr(q, i + 1)) - 2, 3), lambda z: substr(q, i + 1 + z, 3)) as c, starts_with(substr(q, i + 1), 'ATG') as atg from b, unnest(range(3)) as t(i)),
fr as (select mrna, min(phase) as phase from ph where atg and len(list_filter(c[:-2], lambda x: x in ('TAA', 'TAG', 'TGA'))) = 0 group by mrna) """


def _frames(s, d):
    t = _transcripts(s, d).where("seq <> ''")
    return t.select(F.col("obj").alias("mrna"), fn.open_phase(F.translate("seq", "DEFHIJKLM ", "ACGTACGTAT")).cast("long").alias("phase"))


@query(FRAMES + "select b.mrna, cast(phase as bigint) as phase, phase is null as pseudo from b left join fr using (mrna)")
def transcript_frames(s, d):
    """The open frame of joined exons; a transcript without one is a pseudogene's."""
    return _frames(s, d).withColumn("pseudo", F.col("phase").isNull())


NOTE = """';pseudogene="unknown";pseudo=true'"""


@query(FRAMES + f""", gone as (select b.mrna from b left join fr using (mrna) where phase is null), m as (select gene, mrna, min(s) as s, max(e) as e from exon group by all), g as (select gene, min(s) as s, max(e) as e from exon group by all)
select 'gene' as feature, gene || '.pseudo' as id, null as parent, s as start, e as stop, 'ID=' || gene || '.pseudo' || {NOTE} as attr from g where gene in (select gene from m join gone using (mrna))
union all select 'transcript', mrna, gene || '.pseudo', s, e, 'ID=' || mrna || ';Parent=' || gene || '.pseudo' || {NOTE} from m join gone using (mrna) union all select 'exon', null, mrna, s, e, 'Parent=' || mrna || {NOTE} from exon join gone using (mrna)""")
def pseudogene_models(s, d):
    """Models of the transcripts without an open frame."""
    return curation.pseudogenes(_features(s, d), _frames(s, d).where("phase is null")).withColumnRenamed("end", "stop")


def _features(s, d):
    """Genes, transcripts and exons, with the attributes of their lines."""
    x = _exons(s, d)
    null = F.lit(None).cast("string")
    span = [F.min("start").alias("start"), F.max("end").alias("end"), F.first("chr").alias("chr")]
    g = x.groupBy("gene").agg(*span).select(F.lit("gene").alias("feature"), "gene", null.alias("mrna"), "start", "end", "chr", F.concat(F.lit("ID="), "gene").alias("attr"))
    m = x.groupBy("gene", "mrna").agg(*span).select(F.lit("mRNA").alias("feature"), "gene", "mrna", "start", "end", "chr", F.concat(F.lit("ID="), "mrna", F.lit(";Parent="), "gene").alias("attr"))
    e = curation.exon_names(x).select(F.lit("exon").alias("feature"), "gene", "mrna", "start", "end", "chr", "attr")
    return g.unionByName(m).unionByName(e)


FEATURES = MODELS + """, f as (select 'gene' as feature, gene, null as mrna, min(s) as s, max(e) as e, any_value(chr) as chr, 'ID=' || gene as attr from exon group by gene union all select 'mRNA', gene, mrna, min(s), max(e), any_value(chr), 'ID=' || mrna || ';Parent=' || gene from exon group by gene, mrna
  union all select 'exon', gene, mrna, s, e, chr, 'ID=' || mrna || '.exon_' || row_number() over (partition by mrna order by s) || ';Parent=' || mrna from exon) """


@query(FEATURES + "select 'c' || chr as seqname, s as start, e as stop, coalesce(mrna, gene) as id from f where feature = 'mRNA' and contains('c' || chr, '1')")
def feature_table(s, d):
    """Transcripts on sequences whose names have a 1."""
    f = _features(s, d).select("feature", F.concat(F.lit("c"), "chr").alias("seqname"), "start", "end", F.coalesce("mrna", "gene").alias("id"))
    return curation.feature_table(f, "mRNA", "1").withColumnRenamed("end", "stop")


@query(FEATURES + "select mrna, gene from f where feature = 'mRNA'")
def gene_of_mrna(s, d):
    f = _features(s, d).select("feature", F.coalesce("mrna", "gene").alias("id"), F.when(F.col("feature") == "mRNA", F.col("gene")).otherwise(F.col("mrna")).alias("parent"))
    return sources.genes_of(f)


@query(MODELS + ", dd as (select mrna as feature, 'kind ' || (s % 5) as description from exon union all select gene, 'KIND ' || (s % 5) from exon) select distinct gene, upper(description) as description from (select coalesce(m.gene, dd.feature) as gene, description from dd left join (select distinct mrna, gene from exon) m on m.mrna = dd.feature)")
def gene_descriptions(s, d):
    """Descriptions given for genes or their transcripts, in capitals, each once a gene."""
    x = _exons(s, d)
    rows = x.select(F.col("mrna").alias("feature"), F.expr("concat('kind ', start % 5)").alias("description")).unionByName(x.select(F.col("gene").alias("feature"), F.expr("concat('KIND ', start % 5)").alias("description")))
    return sources.descriptions(rows, x.select("mrna", "gene").distinct())


@query(""", e as (select seq_id, unnest(range(0, length(seq), 50)) as a, seq from v_seq), x as (select seq_id, a, replace(substr(seq, a + 1, 50), ' ', 'N') as b from e), t as (select seq_id, a, length(b) - length(ltrim(b, 'N')) as l, length(b) - length(rtrim(b, 'N')) as r, length(b) as n from x)
select seq_id, a + l as start, a + n - r as stop from t where l < n""")
def trimmed_exons(s, d):
    """Stretches of 50 letters, spaces read as N, cut back to what is known at both ends."""
    x = v.seq(s, d).where("seq <> ''").select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(50))).alias("start"))
    e = x.select("seq_id", "start", F.least(F.col("start") + 50, F.length("seq")).alias("end"), F.replace(F.substr("seq", F.col("start") + 1, F.lit(50)), F.lit(" "), F.lit("N")).alias("bases"))
    return curation.trimmed(e).select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


# Statistics and reports


@query("""select kind, count(*) as n, cast(sum("end" - start) as bigint) as total, round(count(*) / count(distinct chr), 4) as per_locus, round(count(*) / count(distinct chr || '.' || json_extract_string(props, '$.k')), 4) as per_mrna, max("end" - start) as longest, round(avg("end" - start), 4) as mean, round(stddev_pop("end" - start), 4) as spread,
quantile_cont("end" - start, 0.25) as q1, quantile_cont("end" - start, 0.5) as q2, quantile_cont("end" - start, 0.75) as q3 from v_gene group by kind""")
def feature_stats(s, d):
    """All measures of each kind of feature; loci are chromosomes, transcripts their attributes."""
    n = F.expr("end - start")
    per = lambda x: F.round(F.count("*") / F.countDistinct(x), 4)
    q = lambda p: F.percentile(n, p)
    return v.gene(s, d).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(n).alias("total"), per(F.col("chr")).alias("per_locus"), per(F.concat_ws(".", "chr", F.get_json_object("props", "$.k"))).alias("per_mrna"), F.max(n).alias("longest"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_pop(n), 4).alias("spread"),
        q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"),
    )


@query(", r as (select min(length(seq)) as a, max(length(seq)) as b from v_seq) select bin, count(*) as n, cast(sum(count(*)) over (order by bin) as bigint) as n_up_to from (select least(49, coalesce((length(seq) - a) * 50 // nullif(b - a, 0), 0)) as bin from v_seq, r) group by bin")
def histogram_50(s, d):
    """Fifty bins of equal width between the least and the greatest length."""
    n = v.seq(s, d).groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))
    ends = n.agg(F.min("len").alias("a"), F.max("len").alias("b"))  # one row
    bins = n.crossJoin(F.broadcast(ends)).groupBy(F.expr("least(49, coalesce((len - a) * 50 div nullif(b - a, 0), 0))").cast("long").alias("bin")).agg(F.sum("n").alias("n"))
    return bins.select("bin", "n", F.sum("n").over(Window.orderBy("bin")).alias("n_up_to"))


LANGS = ["de", "en", "es", "fr", "none"]


@query(", m as (select lang, unnest(['number', 'total', 'longest']) as metric, unnest([count(*), sum(length(coalesce(text, ''))), max(length(coalesce(text, '')))]) as value from documents group by lang) select metric, " + ", ".join(f"coalesce(max(case when lang = '{x}' then cast(value as varchar) end), '-') as {x}" for x in LANGS) + " from m group by metric")
def stats_pivot(s, d):
    """Metrics of the documents by language; a language that is not there has dashes."""
    n = F.length(F.coalesce("text", F.lit("")))
    one = table(s, d, "documents").groupBy(F.col("lang").alias("file")).agg(F.count("*").cast("string").alias("number"), F.sum(n).cast("string").alias("total"), F.max(n).cast("string").alias("longest"))
    return qc.metric_table(one.unpivot("file", ["number", "total", "longest"], "metric", "value"), LANGS)


@query(c.PAIRED + ", ".join(["select chr, gene"] + [f"{a} = 1 and {b} = 0 as {a}_1_0, {a} > 1 and {b} = 0 as {a}_gt1_0, {a} > 1 and {b} > 0 and {a} > {b} / cast(0.33 as double) as {a}_gt1_gt0_grt, {a} > 1 and {b} > 0 and {a} < {b} * cast(0.33 as double) as {a}_gt1_gt0_lrt" for a, b in (("h1", "h2"), ("h2", "h1"))]) + " from c")
def duplication_flags(s, d):
    return c._paired_copies(s, d).select("chr", "gene", *qc.duplication_flags(F.col("h1"), F.col("h2"), 0.33))


@query("select grp, unnest(range(5)) as point, unnest([ts, te, qe, qs, ts]) as x, unnest([10, 10, 0, 0, 10]) as y from (select tid || '.' || qid || '.' || row_number() over (partition by tid, qid order by ts, te, qs, qe, matches) as grp, ts, te, qs, qe from v_hit)")
def polygon_points(s, d):
    w = Window.partitionBy("tid", "qid").orderBy("ts", "te", "qs", "qe", "matches")
    x = v.hit(s, d).withColumn("grp", F.concat_ws(".", "tid", "qid", F.row_number().over(w)))
    return qc.polygons(x, 10, 0).withColumn("point", F.col("point").cast("long"))


@query(', e as (select chr, start as place, 1 as x from v_gene union all select chr, start + 40000, -1 from v_gene), p as (select chr, place, sum(x) as x from e group by all), q as (select chr, place as start, lead(place) over w as stop, sum(x) over w as depth from p window w as (partition by chr order by place)) select chr, start, stop, cast(depth as bigint) as depth from q where depth > 0 and stop is not null')
def depth_sweep(s, d):
    """Coverage by intervals, from a sweep over their ends."""
    x = sources.depth_runs(v.gene(s, d).select(F.col("chr").alias("chrom"), "start", (F.col("start") + 40_000).alias("end")))
    return x.select(F.col("chrom").alias("chr"), "start", F.col("end").alias("stop"), "depth")


@query(c.COVER + "select chr, unnest(range(bin, bin + depth)) as at, case when depth > 3 then 'H' else '1' end as value from b")
def signal_bases(s, d):
    """Runs as one value for each base."""
    r = c._cover(s, d).select(F.col("chr").alias("chrom"), F.col("bin").alias("start"), (F.col("bin") + F.col("depth")).alias("end"), F.expr("if(depth > 3, 'H', '1')").alias("value"))
    return sources.bases_of_runs(r).withColumnRenamed("chrom", "chr")


# Lines of files


@query("select concat_ws(chr(9), 'c' || chr, start, \"end\", gene, kind) as value from v_gene")
def bed_lines(s, d):
    x = v.gene(s, d).withColumn("chrom", F.concat(F.lit("c"), "chr"))
    return sinks.bed_lines(x, ["gene", "kind"]).select("value")


@query("select concat_ws(chr(9), obj, obj_start + 1, obj_end, part, ctype, case when ctype = 'N' then concat_ws(chr(9), obj_end - obj_start, 'scaffold', 'yes', 'map') else concat_ws(chr(9), comp, comp_start + 1, comp_end, strand) end) as value from v_agp")
def agp_lines(s, d):
    x = agp(s, d).withColumns({"gap_len": F.expr("obj_end - obj_start"), "gap_type": F.lit("scaffold"), "linkage": F.lit("yes"), "evidence": F.lit("map")})
    return sinks.agp_lines(x)


@query("select cast(obj as varchar) as obj, cast((part + 1) // 2 as bigint) as ord, concat_ws(chr(9), comp, comp_start, comp_end, strand) as value from v_agp where ctype = 'W' union all select distinct cast(obj as varchar), 0, '>' || obj from v_agp")
def block_lines(s, d):
    return sinks.block_lines(agp(s, d)).select("obj", F.col("ord").cast("long").alias("ord"), "value")


@query(FEATURES + """, l as (select 'c' || chr as s, max(e) as n from exon group by chr) select concat_ws(chr(9), 'c' || chr, 'model', feature, s + 1, e, '.', case when chr % 2 = 0 then '+' else '-' end, '.', attr) as value from f union all select '##sequence-region ' || s || ' 1 ' || n from l""")
def gff3_lines(s, d):
    f = _features(s, d)
    null = F.lit(None).cast("string")
    x = f.select(F.concat(F.lit("c"), "chr").alias("seqname"), F.lit("model").alias("source"), "feature", "start", "end", null.alias("score"), F.expr("if(chr % 2 = 0, '+', '-')").alias("strand"), null.alias("phase"), "attr", "gene", "mrna")
    lens = x.groupBy(F.col("seqname").alias("seq_id")).agg(F.max("end").alias("len"))
    return sinks.gff3_lines(x, lens).select("value")


@query("select concat_ws(chr(9), qid, 100000, qs, qe, strand, tid, 300000, ts, te, matches, te - ts, 60) as value from v_hit")
def paf_lines(s, d):
    n = lambda x: F.lit(x)
    x = v.hit(s, d).select("qid", n(100_000).alias("q_len"), F.col("qs").alias("q_start"), F.col("qe").alias("q_end"), "strand", "tid", n(300_000).alias("t_len"), F.col("ts").alias("t_start"), F.col("te").alias("t_end"), "matches", F.expr("te - ts").alias("hit_len"), n(60).alias("mapq"))
    return sinks.paf_lines(x).select("value")


@query("select obj, obj || chr(9) || string_agg(comp, ',' order by ord) as value from v_comp group by obj")
def list_lines(s, d):
    return sinks.list_lines(v.comp(s, d), "obj", "comp", ["ord"])


@query(c.JOINED + "select concat_ws(chr(9), seq, chr, min(pos), max(pos), count(*)) as value from j group by seq, chr")
def table_lines(s, d):
    return sinks.table_lines(c.marker_range(s, d), ["seq", "chr", "least", "most", "n"])


@query("select 0 as place, 'kind' || chr(9) || 'n' as value union all select 1, kind || chr(9) || count(distinct gene) from v_gene group by kind")
def count_lines(s, d):
    return sinks.count_lines(c.description_counts(s, d), "kind", "n")


@query(c.CAT + "select chr, bin, concat_ws(chr(9), chr, bin, bin + 1, case when category in ('0', '1', '2') then category else '0' end) as value from k")
def signal_lines(s, d):
    x = c.coverage_category(s, d).select("chr", F.col("bin").alias("start"), (F.col("bin") + 1).alias("end"), F.col("category").alias("code"))
    return sinks.signal_lines(x, "chr").withColumnRenamed("start", "bin")
