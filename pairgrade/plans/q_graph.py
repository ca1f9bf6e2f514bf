"""Registered queries: knowledge graph, embeddings, external mapping."""

from pyspark.sql import functions as F

from pairgrade.functions.hashing import hex_to_long, keyed_md5
from pairgrade.operators import graph as G, ingest as I, mapping as Mp, metrics as M, pairs as P, scoring as C
from pairgrade.plans import views as V
from pairgrade.plans.q_metrics import r6
from pairgrade.plans.registry import query
from pairgrade.session import materialize, work_dir

V.VIEWS["v_attr_agg"] = """
select entity_id, kind, name, list_distinct(list(action) filter (where action is not null)) as acts from v_attrs group by 1, 2, 3"""
V.VIEWS["v_nodes"] = """
with n as (select 0 as k, 'entity' as kind, entity_id as name from v_entities
  union select case kind when 'enzyme' then 1 when 'transporter' then 2 else 3 end as k, kind, name from v_attrs)
select row_number() over (order by k, name) - 1 as id, kind, name from n"""
V.VIEWS["v_edges"] = """
with x as (select entity_id, kind, name, unnest(case when acts is null or len(acts) = 0 then ['unknown'] else acts end) as action from v_attr_agg)
select s.id as src, d.id as dst, cast(case x.kind
  when 'enzyme' then case action when 'substrate' then 0 when 'inhibitor' then 1 when 'inducer' then 2 else 9 end
  when 'transporter' then case action when 'substrate' then 3 when 'inhibitor' then 4 when 'inducer' then 5 else 10 end
  else case action when 'agonist' then 6 when 'antagonist' then 7 when 'inhibitor' then 8 else 11 end end as bigint) as rel
from x join v_nodes s on s.kind = 'entity' and s.name = x.entity_id join v_nodes d on d.kind = x.kind and d.name = x.name"""
V.VIEWS["v_train_graph"] = """
with f as (select src, dst, rel from v_edges union all
  select x.id as src, z.id as dst, 12 + p.y as rel from v_sealed p join v_nodes x on x.kind = 'entity' and x.name = p.a join v_nodes z on z.kind = 'entity' and z.name = p.b where p.sealed_test = 0)
select src, dst, rel from f union all select dst as src, src as dst, rel + 17 as rel from f"""
# Pairs of embedding rows; ids beyond the table stay unknown on purpose in v_vec_query.
V.VIEWS["v_vec_pairs"] = """
with p as (select distinct l_orderkey % (select count(*) from embeddings) as x, (l_partkey * 7 + l_suppkey) % (select count(*) from embeddings) as y from lineitem)
select distinct least(x, y) as a, greatest(x, y) as b, (x * 3 + y) % 5 as rel from p where x <> y"""

DIM = 64
REL = [[((c + 1) * (d + 1) % 7 - 3) / 8 for d in range(DIM)] for c in range(5)]
MAT = [[[((c + i * 3 + j) % 5 - 2) / 16 for j in range(DIM)] for i in range(DIM)] for c in range(5)]


def _nodes(src):
    return materialize(G.kg_nodes(src.entities, src.attrs))


def _vec_pairs(src):
    text = V.VIEWS["v_vec_pairs"].replace("from lineitem", "from {lineitem}").replace("from embeddings", "from {embeddings}")
    return src.spark.sql(text, lineitem=src.table("lineitem"), embeddings=src.table("embeddings"))


def _with_vectors(src):
    emb = src.table("embeddings")
    return C.pair_vectors(_vec_pairs(src).select("a", "b").distinct(), emb, "vec_id", "embedding")


@query("kg_nodes", "select id, kind, name from v_nodes")
def _(src):
    return G.kg_nodes(src.entities, src.attrs)


@query("kg_edges", "select src, dst, rel from v_edges")
def _(src):
    return G.kg_edges(I.attribute_action_agg(src.attrs), _nodes(src))


@query("id_index_join", """
with e as (select name, id from v_nodes where kind = 'entity' and substr(name, 8, 1) <> '3')
select p.y, count(*) filter (where x.id is not null and z.id is not null) as n_valid, count(*) filter (where x.id is null or z.id is null) as n_invalid,
  cast(sum(x.id + z.id) as bigint) as id_sum from v_pairs p left join e x on p.a = x.name left join e z on p.b = z.name group by 1""")
def _(src):
    n = _nodes(src).where("kind <> 'entity' or substr(name, 8, 1) <> '3'")
    j = G.id_index_join(src.pairs, n)
    return j.groupBy("y").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"),
                              F.sum(F.col("ia") + F.col("ib")).alias("id_sum"))


def _train_graph(src):
    nodes = _nodes(src)
    sealed = materialize(src.sealed)
    train = G.id_index_join(sealed.select("a", "b", "y"), nodes).where("valid")
    edges = G.kg_edges(I.attribute_action_agg(src.attrs), nodes)
    return G.kg_train_graph(edges, train, sealed.where("sealed_test = 1"))


@query("kg_train_graph", "select src, dst, rel from v_train_graph")
def _(src):
    return _train_graph(src)


@query("relation_counts", "select rel, count(*) as n from v_train_graph group by 1")
def _(src):
    return G.relation_counts(_train_graph(src))


@query("node_counts", "select kind, count(*) as n from v_nodes group by 1")
def _(src):
    return _nodes(src).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("edge_weight_topk", """
select upper(substr(n.kind, 1, 1)) || substr(n.kind, 2) || ': ' || n.name as label,
  round(avg(cast('0x' || substr(md5(concat_ws('|', 'w', cast(e.src as string), cast(e.dst as string))), 1, 4) as bigint) / 65536.0), 6) as mean_weight, count(*) as n_edges
from v_edges e join v_nodes n on e.dst = n.id group by n.kind, n.name
order by avg(cast('0x' || substr(md5(concat_ws('|', 'w', cast(e.src as string), cast(e.dst as string))), 1, 4) as bigint) / 65536.0) desc, label limit 20""")
def _(src):
    nodes = _nodes(src)
    e = G.kg_edges(I.attribute_action_agg(src.attrs), nodes)
    w = e.withColumn("weight", hex_to_long(F.substring(keyed_md5("w", F.col("src"), F.col("dst")), 1, 4)) / 65536.0)
    return r6(G.edge_weight_topk(w, nodes), "mean_weight")


_CONTRIB = "with c as (select vec_id, unnest(range(64)) as feature, unnest(embedding)::double as value from embeddings)"


def _contributions(src):
    return src.table("embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "value")).select(
        "vec_id", F.col("feature").cast("bigint").alias("feature"), F.col("value").cast("double").alias("value"))


@query("importance_topk", _CONTRIB + " select feature, round(avg(abs(value)), 6) as mean_abs from c group by 1 order by avg(abs(value)) desc, feature limit 20")
def _(src):
    return r6(G.importance_topk(_contributions(src)), "mean_abs")


@query("importance_waterfall", _CONTRIB + """,
r as (select *, row_number() over (partition by vec_id order by abs(value) desc, feature) as rn from c),
g as (select vec_id, least(rn, 19) as step, case when rn <= 18 then cast(feature as string) else 'other' end as label, sum(value) as value from r group by 1, 2, 3)
select vec_id, step, label, round(value, 6) as value, round(sum(value) over (partition by vec_id order by step), 6) as total from g""")
def _(src):
    return r6(G.waterfall(_contributions(src), "vec_id"), "value", "total")


_DICT_SQL = """
select i as feature, case when i < 2048 then 'fp_prod_' || i when i < 4096 then 'fp_diff_' || (i - 2048)
  when i < 4120 then 'bio_' || lpad(cast(i - 4096 as string), 2, '0') when i < 5144 then 'gnn_ha_' || (i - 4120) when i < 6168 then 'gnn_hb_' || (i - 5144)
  when i < 7192 then 'gnn_diff_' || (i - 6168) else 'gnn_prod_' || (i - 7192) end as name from range(8216) t(i)"""


@query("feature_dictionary", f"""
with d as ({_DICT_SQL}), c as (select vec_id, unnest(range(64)) * 128 as feature, unnest(embedding)::double as value from embeddings)
select d.name, round(avg(abs(value)), 6) as mean_abs from c join d using (feature) group by 1""")
def _(src):
    c = _contributions(src).withColumn("feature", F.col("feature") * 128)
    j = c.join(F.broadcast(G.feature_dictionary(src.spark, 8216)), "feature")
    return r6(j.groupBy("name").agg(F.avg(F.abs("value")).alias("mean_abs")), "mean_abs")


@query("relational_neighbors", """
with e as (select b as dst, a as src, rel % 3 as rel from v_vec_pairs),
x as (select e.dst, e.rel, unnest(range(64)) as i, unnest(v.embedding)::double as v from e join embeddings v on e.src = v.vec_id),
m as (select dst, rel, i, avg(v) as m, count(*) as n from x group by 1, 2, 3)
select dst, rel, max(n) as degree, round(max(m) filter (where i = 0), 5) as first, round(max(m) filter (where i = 63), 5) as last, round(sum(m), 5) as total from m group by 1, 2""")
def _(src):
    e = _vec_pairs(src).select(F.col("b").alias("dst"), F.col("a").alias("src"), (F.col("rel") % 3).alias("rel"))
    m = G.relational_mean(e, src.table("embeddings"), "vec_id", "embedding")
    return m.select("dst", "rel", "degree", F.round(F.get("mean", 0), 5).alias("first"),
                    F.round(F.get("mean", 63), 5).alias("last"), F.round(C.vec_sum(F.col("mean")), 5).alias("total"))


@query("embedding_norm", """
with x as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings),
c as (select vec_id, i, v - avg(v) over (partition by i) as v from x), n as (select vec_id, i, v, sqrt(sum(v * v) over (partition by vec_id)) as s from c),
g as (select sqrt(sum(v * v) / count(distinct vec_id)) as g, count(distinct vec_id) as rows from c)
select 'PN-SI' as mode, vec_id, round(max(v / greatest(s, 1e-6)) filter (where i = 0), 6) as first, round(max(v / greatest(s, 1e-6)) filter (where i = 63), 6) as last from n group by 2
union all select 'PN' as mode, vec_id, round(max(v / g) filter (where i = 0), 6), round(max(v / g) filter (where i = 63), 6) from n cross join g group by 2
union all select 'PN-SCS' as mode, vec_id, round(max(v / (g * sqrt(rows))) filter (where i = 0), 6), round(max(v / (g * sqrt(rows))) filter (where i = 63), 6) from n cross join g group by 2""")
def _(src):
    out = None
    for mode in ("PN-SI", "PN", "PN-SCS"):
        n = G.embedding_norm(src.table("embeddings"), "vec_id", "embedding", DIM, mode).select(
            F.lit(mode).alias("mode"), "vec_id", F.round(F.get("normed", 0), 6).alias("first"), F.round(F.get("normed", 63), 6).alias("last"))
        out = n if out is None else out.unionByName(n)
    return out


_VP = "with p as (select p.a, p.b, x.embedding::double[] as h, z.embedding::double[] as t from (select distinct a, b from v_vec_pairs) p join embeddings x on p.a = x.vec_id join embeddings z on p.b = z.vec_id)"
_IX = "range(1, 65)"


@query("pair_ops_embed", _VP + f"""
select a, b, cast(256 as bigint) as width, h[1] as ha0, round(h[1] - t[1], 6) as diff0, round(h[64] * t[64], 6) as prod63,
  round(list_sum(list_transform({_IX}, lambda i: h[i] - t[i])), 5) as diff_sum, round(list_sum(list_transform({_IX}, lambda i: h[i] * t[i])), 5) as prod_sum from p""")
def _(src):
    v = _with_vectors(src).select("a", "b", C.pair_ops(F.col("h_a"), F.col("h_b")).alias("o"))
    return v.select("a", "b", F.size("o").cast("bigint").alias("width"), F.get("o", 0).alias("ha0"),
                    F.round(F.get("o", 128), 6).alias("diff0"), F.round(F.get("o", 255), 6).alias("prod63"),
                    F.round(C.vec_sum(F.slice("o", 129, 64)), 5).alias("diff_sum"),
                    F.round(C.vec_sum(F.slice("o", 193, 64)), 5).alias("prod_sum"))


def _list(values):
    return "[" + ", ".join(f"{v}::double" for v in values) + "]"


@query("distmult_score", _VP + " select a, b, " + ", ".join(
    f"round(list_sum(list_transform({_IX}, lambda i: h[i] * t[i] * ({_list(REL[c])})[i])), 5) as s{c}" for c in range(5)) + " from p")
def _(src):
    v = _with_vectors(src).select("a", "b", C.diagonal_scores(F.col("h_a"), F.col("h_b"), REL).alias("s"))
    return v.select("a", "b", *[F.round(F.get("s", c), 5).alias(f"s{c}") for c in range(5)])


@query("complex_score", _VP + " select a, b, " + ", ".join(
    f"round(list_sum(list_transform(range(1, 33), lambda i: ({_list(REL[c])})[i] * (h[i] * t[i] + h[i + 32] * t[i + 32]) + ({_list(REL[c])})[i + 32] * (h[i] * t[i + 32] - h[i + 32] * t[i]))), 5) as s{c}"
    for c in range(5)) + " from p")
def _(src):
    v = _with_vectors(src).select("a", "b", C.complex_scores(F.col("h_a"), F.col("h_b"), REL, DIM // 2).alias("s"))
    return v.select("a", "b", *[F.round(F.get("s", c), 5).alias(f"s{c}") for c in range(5)])


@query("bilinear_score", """
with x as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings), r as (select unnest(range(5)) as c),
m as (select x.vec_id, r.c, (r.c + x.i * 3) % 5 as k, sum(v) as v from x cross join r group by 1, 2, 3),
w as (select vec_id, c, j, sum(v * (((k + j) % 5) - 2) / 16.0) as v from m, unnest(range(64)) as t(j) group by 1, 2, 3),
l as (select vec_id, c, list(v order by j) as wv from w group by 1, 2),
p as (select p.a, p.b, l.c, l.wv, z.embedding::double[] as t from (select distinct a, b from v_vec_pairs) p join l on p.a = l.vec_id join embeddings z on p.b = z.vec_id),
s as (select a, b, c, list_sum(list_transform(range(1, 65), lambda i: wv[i] * t[i])) as s from p)
select a, b, """ + ", ".join(f"round(max(s) filter (where c = {c}), 5) as s{c}" for c in range(5)) + " from s group by 1, 2")
def _(src):
    v = C.bilinear_scores(_with_vectors(src), MAT, "s")
    return v.select("a", "b", *[F.round(F.get("s", c), 5).alias(f"s{c}") for c in range(5)])


# ----------------------------------------------------------- external mapping

_LETTERS = """
select p_partkey, p_name, p_brand, case when p_size % 9 = 0 then null else 'X' || cast(p_partkey % 50 + 1 as string) end as xa, 'X' || cast((p_partkey * 7) % 50 + 1 as string) as xb,
  case p_size % 4 when 0 then 'Major' when 1 then 'Moderate' when 2 then 'Minor' else 'Unknown' end as level0,
  case when p_partkey % 10 < 9 then (case (p_partkey % 50 + (p_partkey * 7) % 50) % 4 when 0 then 'Major' when 1 then 'Moderate' when 2 then 'Minor' else 'Unknown' end)
    else (case p_size % 4 when 0 then 'Major' when 1 then 'Moderate' when 2 then 'Minor' else 'Unknown' end) end as level,
  substr('ABCDGHJLMNPRSV', cast(p_partkey % 14 + 1 as int), 1) as letter from part"""
V.VIEWS["v_ext_list"] = _LETTERS.replace("% 50", "% 400")


def _ext_list(src):
    return src.spark.sql(V.VIEWS["v_ext_list"].replace("from part", "from {part}"), part=src.table("part"))


@query("external_csv_scan", "select xa, xb, level, letter, p_name as na from v_ext_list")
def _(src):
    import uuid
    root = f"{work_dir(src.spark)}/pairgrade/{uuid.uuid4().hex}"
    x = _ext_list(src).select("xa", "p_name", "xb", "p_brand", "level", F.col("letter").alias("file"))
    # One folder per letter, named like the published files.
    x.withColumn("file", F.concat(F.lit("code_"), "file", F.lit(".csv"))).write.partitionBy("file").option(
        "header", True).csv(root)
    schema = "xa string, na string, xb string, nb string, level string"
    return Mp.scan_external(src.spark, f"{root}/*", schema).select("xa", "xb", "level", "letter", "na")


V.VIEWS["v_ext_oriented"] = """
with k as (select *, cast(substr(xa, 2) as bigint) > cast(substr(xb, 2) as bigint) as sw from v_ext_list where xa is not null and xb is not null and xa <> xb)
select case when sw then xb else xa end as a, case when sw then xa else xb end as b, case when sw then p_brand else p_name end as name_a,
  case when sw then p_name else p_brand end as name_b, level, letter from k"""
V.VIEWS["v_ext_clean"] = """
select a, b, min(level) as level, min({'o': letter, 'na': name_a, 'nb': name_b}) as f, count(*) as n_rows from v_ext_oriented group by 1, 2 having min(level) = max(level)"""


def _split(src):
    return Mp.level_conflict_split(_ext_list(src), "xa", "xb", "level", "letter", ("p_name", "p_brand"))


@query("level_conflict_split", """
select a, b, level, f.na as name_a, f.nb as name_b, n_rows from v_ext_clean
union all select a, b, 'CONFLICT' as level, null as name_a, null as name_b, count(*) as n_rows from v_ext_oriented group by 1, 2 having min(level) <> max(level)""")
def _(src):
    clean, conflicts = _split(src)
    none = F.lit(None).cast("string")
    return clean.unionByName(conflicts.withColumns({"level": F.lit("CONFLICT"), "name_a": none, "name_b": none}))


_SALTS = ", ".join(f"'{w}'" for w in Mp.SALT_WORDS)
_SALT_RX = "|".join(Mp.SALT_WORDS)
V.VIEWS["v_salted"] = """
select p_partkey as k, case p_partkey % 6 when 0 then p_name when 1 then p_name || ' hydrochloride' when 2 then p_name || ' sodium hydrate' when 3 then 'sodium ' || p_name
  when 4 then 'ab sodium' else 'sodium chloride' end as drug from part"""


@query("salt_suffix_strip", f"""
with w as (select k, drug, string_split(drug, ' ') as w from v_salted),
d as (select k, drug, w, d from w, unnest(range(0, 8)) as t(d) where d < len(w)),
c as (select *, array_to_string(w[1:len(w) - d], ' ') as stem, list_bool_and(list_transform(w[len(w) - d + 1:len(w)], lambda x: list_contains([{_SALTS}], x))) as all_salt from d),
o as (select k, drug, d, stem, d = 0 or (all_salt and length(stem) >= 4 and not list_contains([{_SALTS}], stem)) as ok from c),
f as (select k, drug, d, stem, bool_and(ok) over (partition by k order by d) as ok from o)
select k, drug, max_by(stem, d) filter (where ok) as stem from f group by 1, 2""")
def _(src):
    s = src.spark.sql(V.VIEWS["v_salted"].replace("from part", "from {part}"), part=src.table("part"))
    return s.withColumn("stem", Mp.strip_salt(F.col("drug")))


V.VIEWS["v_drug_names"] = """
select entity_id as ext_id, case cast(substr(entity_id, 3) as bigint) % 8 when 0 then upper(primary_name) when 1 then alias when 2 then replace(lower(alias), '-', ' ')
  when 3 then primary_name || ' hydrochloride' when 4 then lower(alias) || ' sodium' when 5 then 'page ' || entity_id when 6 then 'i18n ' || entity_id else 'nothing ' || entity_id end as drug from v_names"""
V.VIEWS["v_i18n"] = "select entity_id, 'i18n ' || entity_id as name from v_names"
V.VIEWS["v_pages"] = "select 'page ' || entity_id as drug, entity_id from v_names where substr(entity_id, 8, 1) < '7'"


def _norm_sql(c):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[()\\[\\]{{}},.;:]', ' ', 'g'), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'))")


def _keyed_sql(key, source):
    return f"(select {key} as k, min(entity_id) as id, count(distinct entity_id) > 1 as several from {source} group by 1)"


V.VIEWS["v_mapped"] = f"""
with q as (select ext_id, drug, lower(drug) as fold, {_norm_sql('drug')} as norm from v_drug_names),
z as (select *, regexp_replace(norm, '( ({_SALT_RX}))+$', '') as st from q),
j as (select z.ext_id, z.drug, pg.entity_id as page, list_filter([
    {{'id': u1.id, 'several': u1.several, 'method': 'exact_primary', 'confidence': 1.0::double}}, {{'id': u2.id, 'several': u2.several, 'method': 'exact_i18n', 'confidence': 1.0::double}},
    {{'id': u3.id, 'several': u3.several, 'method': 'exact_alias', 'confidence': 0.95::double}}, {{'id': u4.id, 'several': u4.several, 'method': 'exact_alias_normalized', 'confidence': 0.9::double}},
    {{'id': s5.id, 'several': s5.several, 'method': 'salt_stripped_primary', 'confidence': 0.8::double}}, {{'id': s6.id, 'several': s6.several, 'method': 'salt_stripped_alias', 'confidence': 0.75::double}}],
    lambda x: x.id is not null)[1] as f
  from z left join {_keyed_sql('lower(primary_name)', 'v_names')} u1 on z.fold = u1.k left join {_keyed_sql('lower(name)', 'v_i18n')} u2 on z.fold = u2.k
  left join {_keyed_sql('lower(alias)', 'v_names')} u3 on z.fold = u3.k left join {_keyed_sql(_norm_sql('alias'), 'v_names')} u4 on z.norm = u4.k
  left join {_keyed_sql(_norm_sql('primary_name'), 'v_names')} s5 on z.st <> z.norm and z.st = s5.k left join {_keyed_sql(_norm_sql('alias'), 'v_names')} s6 on z.st <> z.norm and z.st = s6.k
  left join v_pages pg on z.drug = pg.drug)
select ext_id, drug, case when f.several = false then f.id else page end as entity_id,
  case when f.several = false then f.method when page is not null then 'detail_page' when f.several then 'ambiguous' end as method,
  case when f.several = false then f.confidence when page is not null then 0.99::double end as confidence from j"""


def _mapped(src):
    n = src.names
    sql = lambda v: src.spark.sql(V.VIEWS[v].replace("from v_names", "from {n}"), n=n)
    return Mp.name_to_id(sql("v_drug_names"), n, sql("v_i18n"), sql("v_pages"))


@query("name_to_id_cascade", "select ext_id, drug, entity_id, method, confidence from v_mapped")
def _(src):
    return _mapped(src)


@query("coverage_stats", """
select coalesce(method, 'unmatched') as method, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as share from v_mapped group by 1""")
def _(src):
    return Mp.coverage(_mapped(src))


V.VIEWS["v_visited"] = "select distinct drug from v_drug_names where drug like 'page %' or (drug like 'nothing %' and substr(drug, 16, 1) in ('0', '2', '4', '6', '8'))"
V.VIEWS["v_status"] = """
select m.*, case when m.entity_id is null and v.drug is not null then 'detail_page_no_link' else coalesce(m.method, 'unmatched') end as status from v_mapped m left join v_visited v on m.drug = v.drug"""


def _status(src):
    n = src.names
    visited = V.VIEWS["v_visited"].replace("from v_drug_names", f"from ({V.VIEWS['v_drug_names'].replace('from v_names', 'from {n}')})")
    return Mp.page_status(_mapped(src), src.spark.sql(visited, n=n))


@query("mapping_status", "select ext_id, drug, entity_id, method, confidence, status from v_status")
def _(src):
    return _status(src)


@query("mapping_unmatched", "select drug, status, count(*) as n from v_status where entity_id is null group by 1, 2")
def _(src):
    return Mp.unmatched_names(_status(src))


@query("mapping_report", """
select count(*) as n_names, count(entity_id) as n_mapped, count(*) filter (where entity_id is null) as n_unmapped, round(100 * count(entity_id) / cast(count(*) as double), 4) as coverage_percent,
  count(*) filter (where method not in ('detail_page', 'ambiguous')) as n_by_name, count(*) filter (where method = 'detail_page') as n_by_page,
  count(*) filter (where status = 'detail_page_no_link') as n_page_without_link, count(*) filter (where status = 'ambiguous') as n_ambiguous, count(*) filter (where status = 'unmatched') as n_not_visited from v_status""")
def _(src):
    return Mp.mapping_report(_status(src))


@query("level_distribution", """
select level, count(*) as n_pairs, cast(sum(n_rows) as bigint) as n_rows, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from v_ext_clean group by 1""")
def _(src):
    return Mp.level_distribution(_split(src)[0])


V.VIEWS["v_known"] = """
select a, b, case when substr(md5(concat_ws('|', 'neg', a, b)), 1, 1) < '4' then 0 else y end as y from v_pairs"""
V.VIEWS["v_ext_pairs"] = """
select id1 as x, id2 as z, case e when 0 then 'Major' when 1 then 'Minor' else 'Moderate' end as level from (
  select id1, id2, (instr('0123456789abcdef', substr(ingest_pos, 5, 1)) - 1) % 3 as e from v_pair_events where substr(ingest_pos, 1, 1) < '6')
union all select distinct id1 as x, concat('E', lpad(cast(length(description) + 11 as string), 7, '0')) as z, 'Unknown' as level from v_pair_events where substr(ingest_pos, 1, 1) = '7'"""
V.VIEWS["v_tristate"] = """
with m as (select ext_id, entity_id from v_mapped where entity_id in (select entity_id from v_universe)),
g as (select least(s.entity_id, t.entity_id) as a, greatest(s.entity_id, t.entity_id) as b, min(level) as level from v_ext_pairs e join m s on e.x = s.ext_id join m t on e.z = t.ext_id
  where s.entity_id <> t.entity_id group by 1, 2 having min(level) = max(level))
select g.a, g.b, g.level, case when k.y >= 1 then k.y end as positive_label, coalesce(k.y = 0, false) as is_negative, k.y is null as is_absent
from g left join v_known k on g.a = k.a and g.b = k.b"""


def _tristate(src):
    pairs = src.pairs_table
    known = pairs.withColumn("y", F.when(F.substring(keyed_md5("neg", F.col("a"), F.col("b")), 1, 1) < "4", 0)
                             .otherwise(F.col("y")))
    ext = src.spark.sql(V.VIEWS["v_ext_pairs"].replace("from v_pair_events", "from {p}"), p=materialize(src.pair_events))
    return Mp.map_pairs_tristate(ext, _mapped(src).where("entity_id is not null"), P.entity_universe(pairs), known)


@query("map_pairs_tristate", "select a, b, level, cast(positive_label as bigint) as positive_label, is_negative, is_absent from v_tristate")
def _(src):
    return _tristate(src)


@query("crosstab_group_level", """
with g as (select unnest(['positive', 'negative', 'absent']) as state), s as (select case when is_negative then 'negative' when is_absent then 'absent' else 'positive' end as state, level from v_tristate)
select g.state, """ + ", ".join(f"count(*) filter (where s.level = '{l}') as n_{l}" for l in ("Major", "Moderate", "Minor", "Unknown")) + " from g left join s using (state) group by 1")
def _(src):
    t = _tristate(src).withColumn(
        "state", F.expr("case when is_negative then 'negative' when is_absent then 'absent' else 'positive' end"))
    return P.crosstab(t, "state", ["positive", "negative", "absent"], "level", ["Major", "Moderate", "Minor", "Unknown"], "n_")


def _ext(src):
    return src.ext.withColumn("expected", F.col("y_pred") * 0.75 + F.col("hx") / 16.0).withColumn(
        "p_high", (F.col("y_pred") * 3 + F.col("hx")) / 32.0)


_EXT = "with x as (select *, y_pred * 0.75::double + hx / 16.0::double as expected, (y_pred * 3 + hx) / 32.0::double as p_high from v_ext)"


@query("ext_level_report", _EXT + """
select ext_level, count(*) as n, round(avg(cast(y_pred >= 1 as int)), 6) as detected, round(avg(cast(y_pred >= 3 as int)), 6) as share_high, round(avg(expected), 6) as mean_expected,
  """ + ", ".join(f"count(*) filter (where y_pred = {c}) as pred_{c}" for c in range(5)) + """, round(median(expected), 6) as median_expected from x group by 1""")
def _(src):
    return r6(M.ext_level_report(_ext(src), "ext_level", "y_pred", "expected"), "detected", "share_high", "mean_expected", "median_expected")


@query("spearman_ordinal", _EXT + """,
o as (select case ext_level when 'Minor' then 1 when 'Moderate' then 2 when 'Major' then 3 end as o, expected from x),
r as (select rank() over (order by o) + (count(*) over (partition by o) - 1) / 2.0 as ro, rank() over (order by expected) + (count(*) over (partition by expected) - 1) / 2.0 as re from o where o is not null)
select count(*) as n, round(case when count(*) >= 3 then corr(ro, re) end, 6) as rho from r""")
def _(src):
    from pairgrade.functions.ordering import width_bucket
    o = _ext(src).withColumn("o", F.expr("case ext_level when 'Minor' then 1 when 'Moderate' then 2 when 'Major' then 3 end"))
    return r6(M.spearman(o, "o", "expected", width_bucket("o", 1), width_bucket("expected", 1 / 64)), "rho")


@query("binary_auroc_groups", _EXT + """,
m as (select p_high as s, ext_level = 'Major' as pos from x where ext_level in ('Major', 'Minor')),
r as (select pos, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from m),
a as (select count(*) filter (where pos) as n_pos, count(*) filter (where not pos) as n_neg, sum(rk) filter (where pos) as rs from r)
select n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) as auroc from a""")
def _(src):
    m = _ext(src).where("ext_level in ('Major', 'Minor')")
    return r6(M.group_auroc(m, "p_high", F.col("ext_level") == "Major"), "auroc")


@query("ext_crosstab", "with g as (select cast(unnest([0, 1, 2, 3, 4]) as bigint) as y_pred) select g.y_pred, " + ", ".join(
    f"count(*) filter (where x.ext_level = '{l}') as n_{l}" for l in ("Major", "Moderate", "Minor", "Unknown")) + " from g left join v_ext x on g.y_pred = x.y_pred group by 1")
def _(src):
    return P.crosstab(src.ext, "y_pred", [0, 1, 2, 3, 4], "ext_level", ["Major", "Moderate", "Minor", "Unknown"], "n_")
