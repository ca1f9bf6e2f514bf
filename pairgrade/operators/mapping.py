"""External reference pairs: cleaning, name-to-id cascade, cross tabulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairgrade.functions.text import fold_name, normalize_alias, tidy_alias
from pairgrade.functions.vectors import let

# Salt, hydrate and counter-ion words that may end a name.
SALT_WORDS = [
    "acetate", "besylate", "bromide", "calcium", "chloride", "citrate", "dihydrate", "fumarate", "gluconate",
    "hydrate", "hydrobromide", "hydrochloride", "lactate", "maleate", "mesylate", "monohydrate", "nitrate",
    "phosphate", "potassium", "sodium", "succinate", "sulfate", "tartrate", "tosylate",
]
MIN_STEM = 4
AMBIGUOUS = "ambiguous"
CONFIDENCE = {"exact_primary": 1.0, "exact_i18n": 1.0, "exact_alias": 0.95, "exact_alias_normalized": 0.9,
              "salt_stripped_primary": 0.8, "salt_stripped_alias": 0.75, "detail_page": 0.99}


def strip_salt(name: Column, words: Sequence[str] = SALT_WORDS) -> Column:
    """Drop trailing salt words one by one while a stem of >= 4 letters that is
    not itself a salt word remains; words inside the name stay.

    Written as a fold over the words from the right: the number of words to
    drop grows as long as every longer suffix may still go.
    """
    salts = F.array(*[F.lit(w) for w in words])

    def strip_words(w):
        n = F.size(w)
        stem = lambda d: F.array_join(F.slice(w, 1, n - d), " ")

        def step(dropped, d):
            # Word number d from the right goes only if all words after it went.
            ok = ((dropped == d - 1) & (d < n) & F.array_contains(salts, F.get(w, n - d))
                  & (F.length(stem(d)) >= MIN_STEM) & ~F.array_contains(salts, stem(d)))
            return F.when(ok, d).otherwise(dropped)

        return let(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step), stem)

    return let(F.split(name, " "), strip_words)


def _keyed(names: DataFrame, key: Column, entity: str = "entity_id") -> DataFrame:
    """One row for each name: an entity it belongs to and whether it belongs to several."""
    g = names.select(key.alias("__k"), F.col(entity)).where("__k <> ''").groupBy("__k").agg(
        F.min(entity).alias("__id"), F.max(entity).alias("hi"))
    return g.select("__k", "__id", (F.col("__id") != F.col("hi")).alias("__several"))


def name_to_id(queries: DataFrame, aliases: DataFrame, i18n: DataFrame | None = None,
               pages: DataFrame | None = None, name: str = "drug") -> DataFrame:
    """Resolve names by the ordered stages; the first stage that knows a name decides.

    ``aliases``: entity_id, primary_name, alias; ``i18n``: entity_id, name;
    ``pages``: <name>, entity_id - links found on the external pages, used
    last.  Each stage is one hash join on a unique key.  A name that means two
    entities in the stage that knows it is ambiguous: no later stage of names
    is asked, only the pages, and without a page its method is ``ambiguous``
    and its id NULL.  Distinct names are normalised once and joined back.
    """
    names = queries.select(F.col(name).alias("__name")).distinct()
    q = names.withColumn("__fold", fold_name(F.col("__name")))
    q = q.withColumn("__norm", tidy_alias(F.col("__fold")))
    q = q.withColumn("__stem", strip_salt(F.col("__norm")))
    q = q.withColumn("__stem", F.when(F.col("__stem") != F.col("__norm"), F.col("__stem")))
    primary = aliases.select("entity_id", "primary_name").distinct()
    fold = lambda c: fold_name(F.col(c))
    norm = lambda c: normalize_alias(F.col(c))
    stages = [("exact_primary", "__fold", _keyed(primary, fold("primary_name")))]
    if i18n is not None:
        stages.append(("exact_i18n", "__fold", _keyed(i18n, fold("name"))))
    stages += [("exact_alias", "__fold", _keyed(aliases, fold("alias"))),
               ("exact_alias_normalized", "__norm", _keyed(aliases, norm("alias"))),
               ("salt_stripped_primary", "__stem", _keyed(primary, norm("primary_name"))),
               ("salt_stripped_alias", "__stem", _keyed(aliases, norm("alias")))]
    entry = lambda e, m, c, s: F.struct(e.alias("entity_id"), F.lit(m).alias("method"), c.alias("confidence"), s.alias("several"))
    for method, key, table in stages:
        t = table.withColumnsRenamed({"__k": key, "__id": f"__{method}", "__several": f"__{method}_several"})
        q = q.join(t, key, "left")
    first = F.coalesce(*[F.when(F.col(f"__{m}").isNotNull(), entry(F.col(f"__{m}"), m, F.lit(CONFIDENCE[m]), F.col(f"__{m}_several")))
                         for m, _, _ in stages])
    q = q.withColumn("__first", first)
    page = F.lit(None).cast("string")
    if pages is not None:
        links = _keyed(pages, F.col(name)).where("not __several").select(F.col("__k").alias("__name"), F.col("__id").alias("__page"))
        q, page = q.join(links, "__name", "left"), F.col("__page")
    several = F.col("__first.several")
    hit = (F.when(~several, F.col("__first"))
           .when(page.isNotNull(), entry(page, "detail_page", F.lit(CONFIDENCE["detail_page"]), F.lit(False)))
           .when(several, entry(F.lit(None).cast("string"), AMBIGUOUS, F.lit(None).cast("double"), F.lit(True))))
    found = q.select("__name", hit.alias("__hit"))
    return (queries.join(found, F.col(name).eqNullSafe(F.col("__name")), "left")
            .select(*queries.columns, "__hit.entity_id", "__hit.method", "__hit.confidence"))


def coverage(mapped: DataFrame) -> DataFrame:
    """Names per mapping method, with the ambiguous and the unmatched ones, and their share of all names."""
    from pyspark.sql import Window
    n = mapped.groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # a row per method
    return n.withColumn("share", F.col("n") / F.sum("n").over(w))


NO_LINK, UNMATCHED = "detail_page_no_link", "unmatched"


def page_status(mapped: DataFrame, visited: DataFrame, name: str = "drug") -> DataFrame:
    """``mapped`` with ``status``: its method, ``detail_page_no_link`` where no entity was found although the name's
    page was visited, else ``ambiguous`` or ``unmatched``.  ``visited``: names whose pages were read."""
    seen = visited.select(F.col(name).alias("__seen")).distinct()
    j = mapped.join(seen, F.col(name) == F.col("__seen"), "left")
    none = F.col("entity_id").isNull()
    return j.withColumn("status", F.when(none & F.col("__seen").isNotNull(), NO_LINK).otherwise(F.coalesce("method", F.lit(UNMATCHED)))).drop("__seen")


def unmatched_names(status: DataFrame, name: str = "drug") -> DataFrame:
    """Names without an entity, why, and how many external entries carry them."""
    return status.where(F.col("entity_id").isNull()).groupBy(name, "status").agg(F.count(F.lit(1)).alias("n"))


def mapping_report(status: DataFrame) -> DataFrame:
    """One row: names, found and not found, the share found in percent, found by name and by page, what the names left
    open or ambiguous, pages without a link."""
    by_name = ~F.coalesce(F.col("method").isin("detail_page", AMBIGUOUS), F.lit(True))
    count = lambda c, n: F.count_if(c).alias(n)
    t = status.agg(F.count(F.lit(1)).alias("n_names"), count(F.col("entity_id").isNotNull(), "n_mapped"), count(F.col("entity_id").isNull(), "n_unmapped"),
                   count(by_name, "n_by_name"), count(F.col("method") == "detail_page", "n_by_page"), count(F.col("status") == NO_LINK, "n_page_without_link"),
                   count(F.col("status") == AMBIGUOUS, "n_ambiguous"), count(F.col("status") == UNMATCHED, "n_not_visited"))
    return t.withColumn("coverage_percent", F.round(100 * F.try_divide("n_mapped", "n_names"), 4))


def level_distribution(pairs: DataFrame, level: str = "level") -> DataFrame:
    """Pairs and listed rows of each level, and the share of the pairs; levels that no pair has are not listed."""
    from pyspark.sql import Window
    n = pairs.groupBy(level).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n_rows").alias("n_rows"))
    return n.withColumn("share", F.round(F.col("n_pairs") / F.sum("n_pairs").over(Window.partitionBy(F.lit(0))), 6))  # a row per level


def level_conflict_split(rows: DataFrame, id_a: str, id_b: str, level: str, order: str,
                         names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(clean pairs, conflicting pairs) of an external list.

    Rows with a missing or equal id go; pairs are ordered by the number in the
    id; a pair listed with two levels is a conflict as a whole; the spelling
    of the names is that of the first source (smallest ``order``).
    """
    num = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("bigint")
    r = rows.where(F.col(id_a).isNotNull() & F.col(id_b).isNotNull() & (F.col(id_a) != "") & (F.col(id_b) != "")
                   & (F.col(id_a) != F.col(id_b)))
    swap = num(F.col(id_a)) > num(F.col(id_b))
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    r = r.select(pick(id_a, id_b).alias("a"), pick(id_b, id_a).alias("b"), pick(names[0], names[1]).alias("name_a"),
                 pick(names[1], names[0]).alias("name_b"), F.col(level).alias("level"), F.col(order).alias("__o"))
    g = r.groupBy("a", "b").agg(F.min("level").alias("level"), F.max("level").alias("__hi"),
                                F.min(F.struct("__o", "name_a", "name_b")).alias("f"), F.count(F.lit(1)).alias("n_rows"))
    clean = g.where(F.col("level") == F.col("__hi")).select("a", "b", "level", "f.name_a", "f.name_b", "n_rows")
    conflicts = g.where(F.col("level") != F.col("__hi")).select("a", "b", "n_rows")
    return clean, conflicts


def map_pairs_tristate(ext: DataFrame, mapping: DataFrame, universe: DataFrame, known: DataFrame) -> DataFrame:
    """External pairs in entity ids with their state in our pair table.

    Both ends must map into the universe and differ.  Pairs that several
    external rows give different levels are dropped as conflicts.
    ``mapping``: ext_id, entity_id; ``known``: a, b, y with y = 0 negatives.
    """
    m = mapping.join(universe, "entity_id", "left_semi").select("ext_id", "entity_id")
    x = (ext.join(m.withColumnsRenamed({"ext_id": "x", "entity_id": "ea"}), "x")
         .join(m.withColumnsRenamed({"ext_id": "z", "entity_id": "eb"}), "z").where("ea <> eb"))
    g = x.groupBy(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b")).agg(
        F.min("level").alias("level"), F.max("level").alias("__hi"))
    g = g.where(F.col("level") == F.col("__hi")).drop("__hi")
    j = g.join(known.select("a", "b", F.col("y").alias("__y")), ["a", "b"], "left")
    return j.select("a", "b", "level", F.when(F.col("__y") >= 1, F.col("__y")).alias("positive_label"),
                    F.coalesce(F.col("__y") == 0, F.lit(False)).alias("is_negative"),
                    F.col("__y").isNull().alias("is_absent"))


LETTER = r"code_([A-Z])\.csv"


def scan_external(spark, glob: str, schema) -> DataFrame:
    """External CSV files of all letters; the letter is provenance."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(glob)
    return df.withColumn("letter", F.regexp_extract(F.col("_metadata.file_path"), LETTER, 1))
