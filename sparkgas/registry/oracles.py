"""The same queries as SQL over the test tables."""

from __future__ import annotations

EDGES = """
edges as (
  select a.o_custkey as src, b.o_custkey as dst,
         floor(a.o_totalprice / 10000) + 1 as w, a.o_orderkey as eid
  from orders a join orders b on b.o_orderkey = a.o_orderkey + 1),
verts as (select c_custkey as id, c_acctbal as bal, c_mktsegment as seg from customer),
und as (select src as a, dst as b, w from edges union all select dst, src, w from edges),
od as (select src as id, count(*) as d from edges group by 1),
ind as (select dst as id, count(*) as d from edges group by 1)
"""


def on_edges(body: str, ctes: str = "", recursive: bool = False) -> str:
    head = "with recursive " if recursive else "with "
    return head + EDGES.strip() + (", " + ctes if ctes else "") + " " + body


ORACLES: dict[str, str] = {}


def add(name: str, body: str, ctes: str = "", recursive: bool = False) -> None:
    ORACLES[name] = on_edges(body, ctes, recursive)


# ---------------------------------------------------------------- sources and sinks
add("read_edge_list", "select src, dst, w from edges")
TOTAL_DEGREE = "select a as id, count(*) as degree from und group by 1"
add("read_edge_list_vertices", TOTAL_DEGREE)
add("read_edge_list_strict", "select row_number() over (order by eid) - 1 as eid, src, dst, w from edges")
DENSE = "dense as (select unnest(range(0, (select max(a) from und) + 1)) as id)"
add(
    "read_edge_list_strict_vertices",
    """select dense.id, coalesce(ind.d, 0) as in_degree, coalesce(od.d, 0) as out_degree, dense.id * 2 as data
       from dense left join ind on ind.id = dense.id left join od on od.id = dense.id""",
    DENSE,
)
add("from_edges_only", "select distinct a as id, 1.0::double as value from und")
add("property_graph", "select id, bal from verts")
LINES = """
lines as (
  select 0 as section, 0::bigint as first, 0::bigint as second, 'Vertices' as line
  union all select 2, 0, 0, ''
  union all select 3, 0, 0, 'Edges'
  union all select 1, id, 0, id || ' : ' || seg from verts
  union all select 4, eid, 0, src || '->' || dst || ' : ' || w::bigint from edges)
"""
add("graph_lines", "select section, first, second, line from lines", LINES)
add("write_graph_lines", "select line from lines", LINES)
add(
    "graph_counts",
    "select 'edges' as kind, count(*) as n from edges union all select 'vertices', count(*) from verts",
)
add("preview", "select id, seg from verts order by id limit 10")

# ------------------------------------------------------------------- derived tables
add("vertices_from_edges", TOTAL_DEGREE)
add("densify_vertices", "select dense.id, seg from dense left join verts on verts.id = dense.id", DENSE)
add(
    "init_vertices",
    "select id, id as label, case when id = 1 then 0.0::double else -1.0::double end as start from verts",
)
add("init_edges", "select src, dst, eid, w, 1 as one from edges")
add(
    "number_edges",
    "select row_number() over (order by eid) - 1 as eid, eid as orderkey, src, dst from edges",
)
add(
    "degrees",
    """select verts.id, coalesce(ind.d, 0) as in_degree, coalesce(od.d, 0) as out_degree
       from verts left join ind on ind.id = verts.id left join od on od.id = verts.id""",
)
add("out_degrees", "select id, d as out_degree from od")
add("attach_vertex_data", "select verts.id, seg, d as out_degree from verts join od on od.id = verts.id")
COPIES = """
copies as (
  select id, count(*) as copies from (
    select src as id, src % 4 as pid from edges union select dst, src % 4 from edges) group by 1)
"""
add("vertex_replication", "select id, copies from copies", COPIES)
add(
    "vertex_replication_by_edge",
    """select id, count(distinct pid) as copies from (
       select src as id, (src % 2147483647 * 31 + dst % 2147483647) % 4 as pid from edges
       union all select dst, (src % 2147483647 * 31 + dst % 2147483647) % 4 from edges) group by 1""",
)
add("replication_factor", "select round(avg(copies), 6) as factor from copies", COPIES)

# ------------------------------------------------------------------------------ joins
TRIPLETS = "from edges e join verts s on s.id = e.src join verts d on d.id = e.dst"
add(
    "triplets",
    f"""select e.eid as e_eid, s.id as s_id, s.bal as s_bal, s.seg as s_seg,
        d.id as d_id, d.bal as d_bal, d.seg as d_seg, e.w as e_w {TRIPLETS}""",
)
add(
    "source_pairs",
    "select e.eid as e_eid, e.dst as id, s.id as s_id, s.bal as s_bal from edges e join verts s on s.id = e.src",
)
HEAVY = "heavy as (select dst as id, sum(w) as acc from edges where w > 40 group by 1)"
add(
    "merge_accumulators",
    """select v.id, round(case when seg = 'BUILDING' then coalesce(acc, -1.0) + round(bal) else bal end, 6) as bal,
       seg = 'BUILDING' as active from verts v left join heavy h on h.id = v.id""",
    HEAVY,
)
add("merge_signals", "select id, id in (select id from heavy) as active from verts", HEAVY)
add("sync_values", "select v.id, acc as bal, seg from verts v join heavy h on h.id = v.id", HEAVY)
add("other_end", "select eid, greatest(src, dst) as own, least(src, dst) as other from edges")

# --------------------------------------------------------------- filters and transforms
add(
    "by_direction",
    """select 'in' as direction, dst as center, src as other from edges
       union all select 'out', src, dst from edges
       union all select 'both', a, b from und""",
)
add(
    "active_only",
    "select dst as center, src as other from edges join verts on verts.id = dst where seg = 'BUILDING'",
)
add(
    "active_triplets",
    f"""select e.eid as e_eid, s.id as s_id, d.id as d_id,
        s.seg = 'BUILDING' as s_active, d.seg = 'BUILDING' as d_active {TRIPLETS}
        where s.seg = 'BUILDING' or d.seg = 'BUILDING'""",
)
add("drop_empty_contributions", "select a as id, w as msg from und where w > 40")
add("transform_edges", f"select e.eid, src, dst, e.w + e.src as w, s.seg = d.seg as same {TRIPLETS}")
add("transform_vertices", "select id, abs(round(bal)) as bal, seg, upper(seg) as tag from verts")
REWRITE = f"""
t as (select e.*, s.seg = 'BUILDING' as sa, d.seg = 'BUILDING' as da {TRIPLETS}),
c1 as (select *, case when da then w * 2 + dst % 10 else w end as x from t),
c2 as (select *, case when sa then x * 2 + src % 10 else x end as y from c1),
i1 as (select *, case when da then w * 2 + dst % 10 when sa then w * 2 + src % 10 else w end as y from t)
"""
add("update_edge_data", "select eid, src, dst, y + da::int + sa::int as w from c2", REWRITE)
add("update_edge_data_independent", "select eid, src, dst, y + (da or sa)::int as w from i1", REWRITE)

# ------------------------------------------------------------------------ aggregations
add(
    "aggregate_messages",
    "select a as id, round(sum(round(bal) * w), 6) as acc from und join verts on verts.id = b group by 1",
)
add("reducer_min", "select a as id, min(b) as acc from und group by 1")
add("reducer_any", f"select e.dst as id, bool_or(s.seg = d.seg) as acc {TRIPLETS} group by 1")
add("reducer_union_size", "select a as id, count(distinct b) as members from und group by 1")
add(
    "min_nonneg",
    "select e.dst as id, min(case when round(s.bal) >= 0 then round(s.bal) end) as acc "
    "from edges e join verts s on s.id = e.src group by 1",
)
add("reduce_edges", f"select sum(case when s.seg = d.seg then e.w else 0 end) as total {TRIPLETS}")
add("reduce_vertices", "select sum(round(bal)) as total from verts")
add("reduce_vertices_fold", "select max(bal) as largest from verts")
add("reducer_fold", "select dst as id, sum(w) as acc from edges group by 1")
add(
    "reducer_vector_fold",
    """select id, max(w) as acc from (select src as id, w from edges union all select dst, w from edges) group by 1""",
)
TOPS = "t0 as (select id, id as top from verts)"
for i in range(3):
    TOPS += f""",
t{i + 1} as (select c.id, greatest(c.top, m.x) as top from t{i} c
        left join (select e.dst as id, max(s.top) as x from edges e join t{i} s on s.id = e.src group by 1) m on m.id = c.id)"""
add("run_gas_vector_fold", "select id, top from t3", TOPS)
add("group_then_reduce", f"select e.dst as id, round(sum(round(d.bal) + round(s.bal) / 2), 6) as acc {TRIPLETS} group by 1")
add("partial_then_final", "select dst as id, sum(w) as total, count(*) as n from edges group by 1")
add("active_count", "select count(*) as n_active from verts where seg = 'BUILDING'")
add(
    "mex",
    """select id, [x for x in range(0, len(l) + 1) if not list_contains(l, x)][1] as mex
       from (select src as id, list(distinct dst % 10) as l from edges group by 1)""",
)
add(
    "neighbor_sets",
    """select a as id, (b // 65536) as block,
       array_to_string(list_sort(list(distinct b)), ',') as nbrs from und group by 1, 2""",
)
add(
    "apply_by_block",
    """select a as id, count(*) filter (hit) as n, coalesce(sum(b) filter (hit), 0)::bigint as s
       from (select a, b, b > a and b % 5 = a % 5 as hit from (select distinct a, b from und)) group by a""",
)
add(
    "run_gas_set_blocks",
    "select v.id, coalesce(r.value, 0) as value from verts v left join r2 r using (id)",
    """
r1 as (select a as id, count(distinct b) + sum(distinct b)::bigint % 1000 as value from und group by a),
r2 as (select u.a as id, count(distinct r.value) + sum(distinct r.value)::bigint % 1000 as value
  from und u join r1 r on r.id = u.b group by u.a)
""",
)
add("distinct_pairs", "select distinct src, dst from edges")

# --------------------------------------------------------------------------- iteration
add(
    "run_gas",
    "select id, hops from st where it = (select max(it) from st)",
    """
st as (
  select 0 as it, id, case when id = (select min(src) from edges) then 0::bigint end as hops, true as ch from verts
  union all
  (with m as (select e.dst as id, min(s.hops) + 1 as x from edges e join st s on s.id = e.src group by 1)
   select c.it + 1, c.id, least(c.hops, m.x), least(c.hops, m.x) is distinct from c.hops
   from st c left join m on m.id = c.id where (select bool_or(ch) from st)))
""",
    recursive=True,
)
VISITS = """
st as (
  select 0 as it, id, id as lab, true as active from verts
  union all
  (with m as (select u.a as id, min(s.lab) as x from und u join st s on s.id = u.b group by 1),
   app as (select c.it + 1 as it, c.id, case when c.active then least(c.lab, m.x) else c.lab end as lab,
                  c.active as was from st c left join m on m.id = c.id),
   sig as (select distinct u.b as id from und u join app p on p.id = u.a join app q on q.id = u.b
           where p.was and q.lab > p.lab)
   select it, id, lab, id in (select id from sig) from app where (select bool_or(active) from st)))
"""
VISIT_JOIN = "from edges e join st s on s.id = e.src join st d on d.id = e.dst and d.it = s.it group by 1, 2, 3"
CHAINED = f"select e.eid, e.src, e.dst, sum(s.active::int + d.active::int)::bigint as visits {VISIT_JOIN}"
add("run_gas_chained", CHAINED, VISITS, recursive=True)
add(
    "run_gas_independent",
    f"select e.eid, e.src, e.dst, sum((s.active or d.active)::int)::bigint as visits {VISIT_JOIN}",
    VISITS,
    recursive=True,
)
add("connected_components_visits", CHAINED, VISITS, recursive=True)
add(
    "partial_then_final_distinct",
    """select d.seg as seg, count(distinct e.src) as senders
       from edges e join verts s on s.id = e.src join verts d on d.id = e.dst group by 1""",
)
add(
    "reducer_members",
    """select v.id, string_agg(distinct o.seg, ',' order by o.seg) as around
       from verts v left join und u on u.a = v.id left join verts o on o.id = u.b group by 1""",
)
add(
    "degrees_of_some",
    """select v.id, (select count(*) from inner_ i where i.dst = v.id) as in_degree,
              (select count(*) from inner_ i where i.src = v.id) as out_degree from chosen v""",
    """chosen as (select id from verts where seg in ('BUILDING', 'MACHINERY')),
       inner_ as (select src, dst from edges where src in (select id from chosen) and dst in (select id from chosen))""",
)
add(
    "run_gas_one_sided",
    "select id, top from st where it = (select max(it) from st)",
    """
st as (
  select 0 as it, id, id as top, true as active from verts
  union all
  (with m as (select e.dst as id, max(s.top) as x from edges e join st s on s.id = e.src group by 1),
   p as (select c.it + 1 as it, c.id, case when c.active then greatest(c.top, m.x) else c.top end as top, c.active as was
         from st c left join m on m.id = c.id),
   g as (select distinct e.src as id from edges e join p c on c.id = e.dst join p o on o.id = e.src
         where c.was and c.top < o.top)
   select it, id, top, id in (select id from g) from p where (select bool_or(active) from st)))
""",
    recursive=True,
)
add(
    "run_gas_pandas",
    "select id, round(value, 6) as value from st where it = (select max(it) from st)",
    """
st as (
  select 0 as it, id, 1.0::double as value, 0.0::double as prev, true as active from verts
  union all
  (with m as (select e.dst as id, max(floor(s.value * 0.5 + e.w)) as x from edges e join st s on s.id = e.src group by 1),
   p as (select c.it + 1 as it, c.id, case when c.active then greatest(c.value, coalesce(m.x, 0)) else c.value end as value,
                case when c.active then c.value else c.prev end as prev, c.active as was
         from st c left join m on m.id = c.id),
   g as (select distinct e.dst as id from edges e join p c on c.id = e.src where c.was and c.value > c.prev)
   select it, id, value, prev, id in (select id from g) from p where (select bool_or(active) from st)))
""",
    recursive=True,
)
add(
    "run_gas_pandas_slots",
    "select e.eid, round(e.w, 6) as w, round(v.value, 6) as value from w2 e join v2 v on v.id = e.dst",
    """
v0 as (select id, 1.0::double as value from verts),
m0 as (select e.dst as id, max(floor(s.value * 0.5 + e.w)) as x from edges e join v0 s on s.id = e.src group by 1),
v1 as (select v.id, greatest(v.value, coalesce(m.x, 0)) as value from v0 v left join m0 m on m.id = v.id),
w1 as (select e.eid, e.src, e.dst, e.w + 1 + v.value % 2 as w from edges e join v0 v on v.id = e.dst),
a1 as (select distinct e.dst as id from edges e join v1 s on s.id = e.src join v1 d on d.id = e.dst where s.value > d.value),
m1 as (select e.dst as id, max(floor(s.value * 0.5 + e.w)) as x from w1 e join v1 s on s.id = e.src group by 1),
v2 as (select v.id, case when v.id in (select id from a1) then greatest(v.value, coalesce(m.x, 0)) else v.value end as value
       from v1 v left join m1 m on m.id = v.id),
w2 as (select e.eid, e.dst, case when e.dst in (select id from a1) then e.w + 1 + v.value % 2 else e.w end as w
       from w1 e join v1 v on v.id = e.dst)
""",
)
FIXED = "r0 as (select id, 1.0::double as x from verts)"
for i in range(5):
    FIXED += f""",
r{i + 1} as (select v.id, 0.15 + 0.85 * coalesce(sum(r.x / od.d), 0) as x from verts v
        left join edges e on e.dst = v.id left join r{i} r on r.id = e.src left join od on od.id = e.src group by 1)"""
add("iterate_fixed", "select id, round(x, 6) as rank from r5", FIXED)
HALF = "half as (select max(id) // 2 + 1 as n from verts)"
BLOCKED = HALF + ", l0 as (select id, id as label from verts)"
RANKED = HALF + ", b0 as (select id, 0.0::double as x, 0.0::double as share from verts)"
for i in range(4):
    BLOCKED += f""",
l{i + 1} as (select c.id, case when c.id // (select n from half) = {i % 2} then least(c.label, m.x) else c.label end as label
        from l{i} c left join (select e.dst as id, min(s.label) as x from edges e join l{i} s on s.id = e.src group by 1) m
        on m.id = c.id)"""
for i in range(6):
    RANKED += f""",
b{i + 1} as (select c.id,
               case when c.id // (select n from half) = {i % 2} then 0.15 + coalesce(m.x, 0) else c.x end as x,
               case when c.id // (select n from half) = {i % 2} then coalesce((0.15 + coalesce(m.x, 0)) / od.d, 0)
                    else c.share end as share
        from b{i} c left join (select e.dst as id, sum(0.85 * s.share) as x from edges e join b{i} s on s.id = e.src group by 1) m
        on m.id = c.id left join od on od.id = c.id)"""
add("iterate_blocked", "select id, label from l4", BLOCKED)
add("pagerank_blocked", "select id, round(x, 6) as rank from b6", RANKED)
add(
    "signal_frontier",
    "select distinct dst as id from edges join verts on verts.id = src where seg = 'BUILDING' and src < dst",
)
add(
    "superstep",
    """select id, round(x, 6) as rank,
       id in (select dst from edges join r1 on r1.id = src where abs(x - 1.0) > 0.5) as active from r1""",
    """
r1 as (select v.id, 0.15 + coalesce(sum(0.85 / od.d), 0) as x from verts v
       left join edges e on e.dst = v.id left join od on od.id = e.src group by 1)
""",
)

# --------------------------------------------------------------------------- algorithms


def _pagerank(prev: float, tol: float, rounds: int | None) -> str:
    cap = f"and (select max(it) from st) < {rounds}" if rounds else ""
    return f"""
st as (
  select 0 as it, id, 1.0::double as val, {prev}::double as prev, true as active from verts
  union all
  (with acc as (select e.dst as id, sum(0.85 * s.val / od.d) as a
                from edges e join st s on s.id = e.src join od on od.id = e.src group by 1),
   app as (select c.it + 1 as it, c.id,
                  case when c.active then coalesce(a, 0) + 0.15 else c.val end as val,
                  case when c.active then c.val else c.prev end as prev, c.active as was
           from st c left join acc on acc.id = c.id),
   sig as (select distinct e.dst as id from edges e join app on app.id = e.src where was and abs(val - prev) > {tol})
   select it, id, val, prev, id in (select id from sig) from app
   where (select bool_or(active) from st) {cap}))
"""


LAST = "from st where it = (select max(it) from st)"
add("pagerank", f"select id, round(val, 6) as rank {LAST}", _pagerank(5.0, 0.001, None), recursive=True)
add("pagerank_capped", f"select id, round(val, 6) as rank {LAST}", _pagerank(1.0, 0.01, 10), recursive=True)
add(
    "top_vertices",
    f"select id, round(val, 6) as value {LAST} order by value desc, id limit 12",
    _pagerank(5.0, 0.001, None),
    recursive=True,
)
add("rank_total", f"select round(sum(val), 6) as total {LAST}", _pagerank(5.0, 0.001, None), recursive=True)
LINEAR = "x0 as (select id, 1.0::double as x from verts)"
for i in range(5):
    LINEAR += f""",
x{i + 1} as (select v.id, 0.15 + 0.85 * sum(u.x + v.x / 2) as x
        from edges e join x{i} u on u.id = e.src join x{i} v on v.id = e.dst group by v.id)"""
add("linear_propagation", "select id, round(x, 6) as value from x5", LINEAR)
add(
    "connected_components",
    f"select id, lab as label {LAST}",
    """
st as (
  select 0 as it, id, id as lab, true as ch from verts
  union all
  (with m as (select u.a as id, min(s.lab) as x from und u join st s on s.id = u.b group by 1)
   select c.it + 1, c.id, least(c.lab, m.x), least(c.lab, m.x) <> c.lab
   from st c left join m on m.id = c.id where (select bool_or(ch) from st)))
""",
    recursive=True,
)
ORACLES["connected_components_turns"] = (
    "select conv_id * 1000000 + turn as id, min(conv_id * 1000000 + turn) over (partition by conv_id) as label from conversations"
)
add(
    "neighborhood_min_id",
    "select v.id, least(v.id, min(b)) as label from verts v left join und on und.a = v.id group by 1",
)
add(
    "greedy_color",
    f"select id, c as color {LAST}",
    """
hi as (select distinct least(src, dst) as lo, greatest(src, dst) as hi from edges where src <> dst),
st as (
  select 0 as it, id, id as c, true as ch from verts
  union all
  (with l as (select hi.lo as id, list(distinct s.c) as l from hi join st s on s.id = hi.hi group by 1),
   m as (select id, [x for x in range(0, len(l) + 1) if not list_contains(l, x)][1] as x from l)
   select p.it + 1, p.id, coalesce(m.x, 0), coalesce(m.x, 0) <> p.c
   from st p left join m on m.id = p.id where (select bool_or(ch) from st)))
""",
    recursive=True,
)
add(
    "shortest_paths",
    f"select id, coalesce(d, -1.0) as dist {LAST}",
    """
st as (
  select 0 as it, id, case when id = (select min(src) from edges) then 0.0::double end as d, true as ch from verts
  union all
  (with m as (select u.a as id, min(s.d + u.w) as x from und u join st s on s.id = u.b group by 1)
   select c.it + 1, c.id, least(c.d, m.x), least(c.d, m.x) is distinct from c.d
   from st c left join m on m.id = c.id where (select bool_or(ch) from st)))
""",
    recursive=True,
)
PAIRS = "p as (select distinct least(src, dst) as a, greatest(src, dst) as b from edges where src <> dst)"
TRI = PAIRS + ", tri as (select x.a, x.b, y.b as c from p x join p y on y.a = x.b join p z on z.a = x.a and z.b = y.b)"
add(
    "triangle_count",
    """select verts.id, count(n.id) as triangles from verts left join
       (select a as id from tri union all select b from tri union all select c from tri) n on n.id = verts.id group by 1""",
    TRI,
)
add(
    "edge_common_neighbors",
    """select e.eid, e.src, e.dst, count(y.a) as common from edges e
       left join n x on x.a = e.src left join n y on y.a = e.dst and y.b = x.b group by 1, 2, 3""",
    "n as (select distinct a, b from und)",
)
add(
    "edge_sum_to_vertices",
    "select v.id, (coalesce(sum(w), 0)::bigint // 2) as total from verts v left join und on und.a = v.id group by 1",
)
