"""References to records that do not exist (problem 5).

A reference is a row ``(child_table, child_key, ref_field, parent_table,
parent_key, seen_at)``.  It fails to hold when its parent is missing, deleted,
or was first indexed after the reference was seen.  Failing references are
*direct* orphans.  A reference whose parent record exists but is an orphan
itself is an *inherited* orphan: the cascade walks down the foreign-key graph
by semi-joins until no new record is orphaned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.session import cut_lineage
from loomframe.tables import page_history, strip_blanks

REFERENCE_COLUMNS = ["child_table", "child_key", "ref_field", "parent_table", "parent_key", "seen_at"]


def target_name(target: Column) -> Column:
    """The page name a written link target stands for: scheme, anchor, blanks and a final ``.md`` aside."""
    bare = F.regexp_replace(strip_blanks(target), r"^(?:vault|workshop):\s*", "")
    return F.regexp_replace(strip_blanks(F.regexp_replace(bare, r"(?s)#.*$", "")), r"\.md$", "")


def page_names(history: DataFrame) -> DataFrame:
    """``name -> page_id``: a whole slug wins over a last segment, then the smaller page_id."""
    slug = F.regexp_replace("slug", r"\.md$", "")
    forms = F.array(
        F.struct(F.lit(0).alias("rank"), slug.alias("name")),
        F.struct(F.lit(1).alias("rank"), F.regexp_extract(slug, r"([^/]*)$", 1).alias("name")),
    )
    return (
        history.select("page_id", F.explode(forms).alias("f"))
        .filter(F.col("f.name") != "")
        .groupBy(F.col("f.name").alias("name"))
        .agg(F.min(F.struct(F.col("f.rank"), F.col("page_id"))).alias("best"))
        .select("name", F.col("best.page_id").alias("parent_key"))
    )


def entity_names(entities: DataFrame) -> DataFrame:
    """``name -> entity_id`` over aliases and last path segments, blanks and case aside; the smaller id wins."""
    segment = F.regexp_replace(F.regexp_extract("canonical_slug", r"([^/]*)$", 1), r"\.md$", "")
    names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(segment))
    return (
        entities.select("entity_id", F.explode(names).alias("name"))
        .select("entity_id", F.lower(strip_blanks(F.col("name"))).alias("name"))
        .filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.min("entity_id").alias("parent_key"))
    )


def link_references(links: DataFrame, history: DataFrame, entities: DataFrame) -> DataFrame:
    """All references of links and entities.  Null page ids and null targets are no references."""
    links = links.select("link_id", "from_page", "to_target", "to_page_id", "link_type", "seen_at")

    def refs(df: DataFrame, child: str, key: str, field: str, parent: str, parent_key: str, seen: Column) -> DataFrame:
        return df.select(
            F.lit(child).alias("child_table"),
            F.col(key).alias("child_key"),
            F.lit(field).alias("ref_field"),
            F.lit(parent).alias("parent_table"),
            F.col(parent_key).cast("long").alias("parent_key"),
            seen.alias("seen_at"),
        )

    seen = F.col("seen_at")
    concept = F.coalesce(F.col("link_type") == "concept", F.lit(False))
    named = links.filter(F.col("to_target").isNotNull())
    to_entity = named.filter(concept).withColumn("name", F.lower(strip_blanks(F.col("to_target"))))
    to_page = named.filter(~concept).withColumn("name", target_name(F.col("to_target")))
    parts = [
        refs(links.filter(F.col("from_page").isNotNull()), "links", "link_id", "from_page", "pages", "from_page", seen),
        refs(links.filter(F.col("to_page_id").isNotNull()), "links", "link_id", "to_page_id", "pages", "to_page_id", seen),
        refs(to_page.join(page_names(history), "name", "left"), "links", "link_id", "to_target", "pages", "parent_key", seen),
        refs(to_entity.join(entity_names(entities), "name", "left"), "links", "link_id", "to_target", "entities", "parent_key", seen),
        refs(entities.filter(F.col("entity_id").isNotNull()), "entities", "entity_id", "entity_id", "pages", "entity_id", F.lit(None).cast("timestamp")),
    ]
    return reduce(DataFrame.unionByName, parts)


def parent_records(history: DataFrame, entities: DataFrame) -> DataFrame:
    """``parent_table, parent_key, deleted, first_at`` of every record that can be referred to."""
    pages = history.select(F.lit("pages").alias("parent_table"), F.col("page_id").alias("parent_key"), "deleted", "first_at")
    known = (
        entities.filter(F.col("entity_id").isNotNull())
        .select("entity_id")
        .distinct()
        .select(
            F.lit("entities").alias("parent_table"),
            F.col("entity_id").alias("parent_key"),
            F.lit(False).alias("deleted"),
            F.lit(None).cast("timestamp").alias("first_at"),
        )
    )
    return pages.unionByName(known)


def reference_states(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References with their ``state``: missing, deleted, late, or null where the reference holds."""
    state = (
        F.when(F.col("deleted").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("first_at") > F.col("seen_at"), "late")
    )
    joined = references.join(parents, ["parent_table", "parent_key"], "left")
    return joined.withColumn("state", state).select(*REFERENCE_COLUMNS, "state")


def orphan_cascade(references: DataFrame, parents: DataFrame, parent_tables: list[str] | None = None) -> DataFrame:
    """Every reference that fails, directly or because its parent record is an orphan.

    Columns: ``child_table, child_key, ref_field, seen_at, state, depth``; depth 0
    is direct, depth d > 0 was inherited in round d (``state`` is then
    ``inherited``).  A record is orphaned when any of its references is missing
    or deleted; a late reference holds by now, so nothing inherits from it.

    Only records that others refer to can pass the state on, so the loop carries
    ids of ``parent_tables`` (by default every table that is both child and parent)
    and runs semi-joins until a round orphans no new record; a cycle ends because
    known orphans are removed.  Each round is cut by a checkpoint.

    Nulls in keys are no references; repeated rows count once; an empty input
    gives an empty result; extra columns are ignored.
    """
    states = reference_states(references, parents)
    direct = states.filter(F.col("state").isNotNull())
    if parent_tables is None:
        both = references.select("child_table").distinct().intersect(references.select(F.col("parent_table").alias("child_table")).distinct())
        parent_tables = [r.child_table for r in both.collect()]
    gone = direct.filter(F.col("state") != "late").filter(F.col("child_table").isin(parent_tables))
    record = [F.col("child_table").alias("parent_table"), F.col("child_key").alias("parent_key")]
    frontier = cut_lineage(gone.select(*record).distinct())
    known, rounds = frontier, []
    shape = ["child_table", "child_key", "ref_field", "seen_at"]
    while not frontier.isEmpty():
        hit = references.join(frontier, ["parent_table", "parent_key"], "left_semi")
        rounds.append(hit.select(*shape, F.lit("inherited").alias("state"), F.lit(len(rounds) + 1).alias("depth")))
        below = hit.filter(F.col("child_table").isin(parent_tables)).select(*record).distinct()
        frontier = cut_lineage(below.join(known, ["parent_table", "parent_key"], "left_anti"))
        known = known.unionByName(frontier)
    found = direct.select(*shape, "state", F.lit(0).alias("depth"))
    return reduce(DataFrame.unionByName, rounds, found).distinct()


def link_orphans(links: DataFrame, pages: DataFrame, entities: DataFrame) -> DataFrame:
    """The cascade over links, pages and entities."""
    history = page_history(pages)
    return orphan_cascade(link_references(links, history, entities), parent_records(history, entities), ["entities"])


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, state and month of ``seen_at`` (null months are kept as null)."""
    return orphans.groupBy(
        "child_table", "ref_field", "state", F.date_format("seen_at", "yyyy-MM").alias("month")
    ).agg(
        F.count(F.lit(1)).alias("n_references"),
        F.sum(F.when(F.col("depth") == 0, 1).otherwise(0)).alias("n_direct"),
        F.sum(F.when(F.col("depth") > 0, 1).otherwise(0)).alias("n_inherited"),
    )
