"""Nested entity documents to entity, interaction, attribute and name tables.

A document row is ``entity_id, kind, name, synonyms, brands, codes, inline_value,
enzymes, transporters, targets, interactions`` (see ``sources.xml_entities``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairgrade.functions.text import normalize_alias, strip

ATTRIBUTE_KINDS = {"enzyme": "enzymes", "transporter": "transporters", "target": "targets"}
FEATURE_KIND = "small molecule"
NO_ACTION = "unknown"


def entity_type_filter(docs: DataFrame, kind: str = FEATURE_KIND) -> DataFrame:
    return docs.where(F.col("kind") == kind)


def interaction_explode(docs: DataFrame) -> DataFrame:
    """One row per nested interaction that names a target."""
    x = docs.select(F.col("entity_id").alias("id1"), F.posexplode("interactions").alias("pos", "i"))
    return (x.where(F.col("i.target").isNotNull() & (F.col("i.target") != ""))
            .select("id1", F.col("i.target").alias("id2"),
                    F.coalesce("i.description", F.lit("")).alias("description"),
                    F.col("pos").cast("bigint").alias("pos")))


def attribute_explode(docs: DataFrame) -> DataFrame:
    """Long form: entity, attribute kind, raw name, raw action (NULL if none)."""
    def tag(kind):
        return lambda a: F.struct(F.lit(kind).alias("kind"), a["name"].alias("name"), a["actions"].alias("actions"))

    tagged = F.concat(*[F.transform(F.coalesce(F.col(col), F.array()), tag(kind))
                        for kind, col in ATTRIBUTE_KINDS.items()])
    one = docs.select("entity_id", F.explode(tagged).alias("a"))
    return one.select("entity_id", "a.kind", "a.name", F.explode_outer("a.actions").alias("action"))


def attribute_action_agg(long: DataFrame) -> DataFrame:
    """Union of lower-cased actions per (entity, kind, name).

    Blank names are dropped; a name without action keeps an empty list.
    """
    name, action = strip(F.col("name")), F.lower(strip(F.col("action")))
    return (long.select("entity_id", "kind", name.alias("name"), F.when(action != "", action).alias("action"))
            .where(F.col("name") != "")
            .groupBy("entity_id", "kind", "name")
            .agg(F.sort_array(F.collect_set("action")).alias("actions")))


def attribute_encode(agg: DataFrame) -> DataFrame:
    """'name:act1,act2|name2' per (entity, kind), names in order.

    One string per entity is what the flat file format wants; its length is
    bounded by the attribute vocabulary because the rows are already distinct.
    """
    entry = F.when(F.size("actions") == 0, F.col("name")).otherwise(
        F.concat_ws(":", "name", F.array_join("actions", ",")))
    return (agg.withColumn("__e", F.struct("name", entry.alias("entry")))
            .groupBy("entity_id", "kind")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("__e")), lambda e: e["entry"]), "|")
                 .alias("encoded")))


def decode_attributes(encoded: Column) -> Column:
    """array<struct<name, actions>>; blank and 'nan' entries dropped, split at
    the first ':', no action -> ['unknown'].

    No limit is used for the split: the name is what stands before the first
    colon and the actions are everything after it.
    """
    entries = F.transform(F.split(F.coalesce(encoded, F.lit("")), r"[|;]"), strip)
    entries = F.filter(entries, lambda e: (e != "") & (F.lower(e) != "nan"))

    def parse(e):
        has = F.instr(e, ":") > 0
        name = strip(F.when(has, F.substring_index(e, ":", 1)).otherwise(e))
        tail = F.when(has, F.regexp_replace(e, r"(?s)^[^:]*:", "")).otherwise(F.lit(""))
        acts = F.filter(F.transform(F.split(tail, ","), lambda a: F.lower(strip(a))), lambda a: a != "")
        return F.struct(name.alias("name"),
                        F.when(F.size(acts) == 0, F.array(F.lit(NO_ACTION))).otherwise(acts).alias("actions"))

    return F.filter(F.transform(entries, parse), lambda s: s["name"] != "")


def attribute_decode(flat: DataFrame, encoded: str = "encoded") -> DataFrame:
    """Long form again: one row per (entity, kind, name, action)."""
    a = flat.select("entity_id", "kind", F.explode(decode_attributes(F.col(encoded))).alias("a"))
    return a.select("entity_id", "kind", "a.name", F.explode("a.actions").alias("action")).distinct()


def code_list_join(docs: DataFrame, codes: str = "codes") -> DataFrame:
    """Nested codes in document order, joined by '|'."""
    return docs.withColumn("code_list", F.array_join(F.coalesce(F.col(codes), F.array()), "|"))


def _aliases() -> Column:
    raw = F.concat(F.array(F.coalesce("name", F.lit(""))), F.coalesce("synonyms", F.array()),
                   F.coalesce("brands", F.array()))
    kept = F.filter(F.transform(raw, lambda a: strip(F.coalesce(a, F.lit("")))), lambda a: a != "")
    return F.array_distinct(kept)


def alias_explode(docs: DataFrame, normalized: bool = True) -> DataFrame:
    """Every distinct alias of an entity in document order."""
    x = docs.select("entity_id", F.col("name").alias("primary_name"), F.posexplode(_aliases()).alias("pos", "alias"))
    x = x.withColumn("pos", F.col("pos").cast("bigint"))
    return x.withColumn("alias_normalized", normalize_alias(F.col("alias"))) if normalized else x


def i18n_names(docs: DataFrame) -> DataFrame:
    """First alias written with CJK ideographs, '' when there is none."""
    cjk = F.filter(_aliases(), lambda a: a.rlike(r"[㐀-鿿]"))
    return docs.select("entity_id", F.col("name").alias("name_en"),
                       F.coalesce(F.get(cjk, 0), F.lit("")).alias("name_cn"))


def coalesce_lookup(docs: DataFrame, lookup: DataFrame, key: str, value: str, inline: str,
                    out: str) -> DataFrame:
    """Value from the lookup table, else the document's own, else ''."""
    l = lookup.select(F.col(key), F.col(value).alias("__v"))
    return (docs.join(l, key, "left")
            .withColumn(out, F.coalesce(F.nullif(F.col("__v"), F.lit("")), F.col(inline), F.lit("")))
            .drop("__v"))
