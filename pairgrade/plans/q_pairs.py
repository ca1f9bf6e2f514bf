"""Registered queries: labelling, unordered pairs, pair joins."""

from pyspark.sql import functions as F

from pairgrade.functions.hashing import keyed_md5
from pairgrade.operators import pairs as P
from pairgrade.plans.registry import query


@query("tier_cascade", "select id1, id2, tier from v_labelled")
def _(src):
    return src.labelled.select("id1", "id2", "tier")


@query("canonical_pair", """
select tier, count(*) as n, cast(sum(case when id1 > id2 then 1 else 0 end) as bigint) as n_swapped
from v_labelled group by tier""")
def _(src):
    return P.swap_counts(src.labelled, "id1", "id2", ["tier"])


@query("pair_hash", """
select id1, id2, substr(sha256(least(id1, id2) || '|' || greatest(id1, id2)), 1, 32) as pair_hash
from v_pair_events""")
def _(src):
    return P.pair_hash(src.pair_events.select("id1", "id2"), "id1", "id2")


@query("column_synonyms", "select a, b, y from v_pairs")
def _(src):
    odd = src.pairs.select(F.col("a").alias("Drug1_ID"), F.col("b").alias("DRUG2_id"), "y")
    return P.resolve_pair_columns(odd)


@query("keep_first_pair", "select a, b, y from v_pairs")
def _(src):
    return src.pairs


@query("class_distribution", """
with s as (
  select 'raw' as stage, tier as y, count(*) as n from v_labelled group by tier
  union all select 'dedup' as stage, y, count(*) as n from v_pairs group by y)
select stage, y, n, n / cast(sum(n) over (partition by stage) as double) as share from s""")
def _(src):
    return P.stage_distribution(src.labelled_pairs, "pair_a", "pair_b", "ingest_pos", "tier", ordered=True)


_AUDIT = """
with s as (select id1, id2, tier from v_labelled
  union all select a as id1, b as id2, cast(0 as bigint) as tier from v_pairs where substr(md5(concat_ws('|', 'neg', a, b)), 1, 1) < '4'),
g as (select least(id1, id2) as a, greatest(id1, id2) as b, count(*) as n, min(tier) as lo, max(tier) as hi,
  list_sort(list(distinct tier)) as ls from s group by 1, 2)
select array_to_string(ls, ',') as label_set, count(*) as groups, cast(sum(n - 1) as bigint) as extra_rows,
  count_if(lo > 0) as all_positive, count_if(hi = 0) as all_negative, count_if(lo = 0 and hi > 0) as mixed
from g where n > 1 group by 1"""


@query("dup_group_audit", _AUDIT)
def _(src):
    marked = src.pairs.where(F.substring(keyed_md5("neg", F.col("a"), F.col("b")), 1, 1) < "4")
    both = src.labelled.select("id1", "id2", "tier").unionByName(
        marked.select(F.col("a").alias("id1"), F.col("b").alias("id2"),
                      F.lit(0).cast("bigint").alias("tier")))
    return P.dup_group_audit(both, "id1", "id2", "tier")


@query("label_lookup_strict", """
with old as (select a, b, cast(case when substr(md5(concat_ws('|', 'old', a, b)), 1, 1) = '0' then 0 else 1 end as bigint) as old_y, y from v_pairs)
select a, b, old_y, case when old_y = 0 then 0 else y end as new_label from old""")
def _(src):
    old = src.pairs.select("a", "b", F.when(
        F.substring(keyed_md5("old", F.col("a"), F.col("b")), 1, 1) == "0", 0).otherwise(1)
        .cast("bigint").alias("old_y"))
    labels = src.pairs.withColumnRenamed("y", "tier")
    return P.label_lookup_strict(old, labels, "a", "b", "old_y")


@query("crosstab", "\n".join([
    "with old as (select cast(case when substr(md5(concat_ws('|', 'old', a, b)), 1, 1) < '4' then 2 else y end as bigint) as old_y, y from v_pairs),",
    "g as (select cast(unnest([0, 1, 2, 3, 4]) as bigint) as old_y)",
    "select g.old_y, " + ", ".join(
        f"count(*) filter (where o.y = {k}) as new_{k}" for k in range(5)),
    "from g left join old o on g.old_y = o.old_y group by g.old_y"]))
def _(src):
    old = src.pairs.withColumn("old_y", F.when(
        F.substring(keyed_md5("old", F.col("a"), F.col("b")), 1, 1) < "4", 2).otherwise(F.col("y"))
        .cast("bigint"))
    return P.crosstab(old, "old_y", [0, 1, 2, 3, 4], "y", [0, 1, 2, 3, 4], "new_")


@query("pair_anti_join", """
select distinct e.a, e.b from (
  select least(entity_id, other) as a, greatest(entity_id, other) as b from (
    select entity_id, concat('E', lpad(cast(bit as string), 7, '0')) as other from v_bits) where entity_id <> other) e
where not exists (select 1 from v_pairs p where p.a = e.a and p.b = e.b)""")
def _(src):
    cand = (src.bits.select("entity_id", F.concat(F.lit("E"), F.lpad(F.col("bit").cast("string"), 7, "0"))
                            .alias("other")).where("entity_id <> other")
            .select(F.least("entity_id", "other").alias("a"), F.greatest("entity_id", "other").alias("b"))
            .distinct())
    return P.pair_anti_join(cand, src.pairs.select("a", "b"))


_MANIFEST = "substr(md5(concat_ws('|', 'man', a, b)), 1, 1) < 'a'"


@query("manifest_semi_join", f"""
with f as (select case when m.a is null then 0 else 1 end as hit from v_pair_events e
  left join (select a, b from v_pairs where {_MANIFEST}) m on least(e.id1, e.id2) = m.a and greatest(e.id1, e.id2) = m.b)
select cast(sum(hit) as bigint) as matched, cast(sum(1 - hit) as bigint) as unmatched,
  cast(sum(hit) as bigint) / count(*) as match_rate from f""")
def _(src):
    manifest = P.pair_hash(src.pairs.where(_MANIFEST), "a", "b")
    return P.match_report(P.manifest_flag(src.pair_events.select("id1", "id2"), manifest, "id1", "id2"))


@query("pair_caption", """
select p.a, p.b, p.y, coalesce(x.name, p.a) as name_a, coalesce(z.name, p.b) as name_b from v_pairs p
left join (select * from v_entities where substr(entity_id, 8, 1) <> '3') x on p.a = x.entity_id
left join (select * from v_entities where substr(entity_id, 8, 1) <> '3') z on p.b = z.entity_id""")
def _(src):
    known = src.entities.where("substr(entity_id, 8, 1) <> '3'")
    return P.pair_caption(src.pairs, known, "entity_id", "name")


@query("entity_max_risk", """
select entity_id, max(y) as max_tier from (
  select a as entity_id, y from v_pairs union all select b as entity_id, y from v_pairs) group by 1""")
def _(src):
    return P.entity_max_tier(src.pairs)


@query("entity_universe", "select a as entity_id from v_pairs union select b as entity_id from v_pairs")
def _(src):
    return P.entity_universe(src.pairs)


@query("check_pair_order", """
select count_if(id1 < id2) as n_less, count_if(id1 > id2) as n_greater, count_if(id1 = id2) as n_equal
from v_pair_events""")
def _(src):
    return P.order_counts(src.pair_events, "id1", "id2")


def flagship(src):
    """Text -> tier -> canonical pair -> first-wins dedupe -> distribution."""
    return P.class_distribution(src.pairs, "y")
