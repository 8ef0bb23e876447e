"""Duplicates hidden by formatting differences (problem 3).

Two texts are copies when they carry the same runs of letters and digits in
the same order, the order of fields aside.  The canonical key is built from
column expressions alone; hot keys are found exactly from partial counts and
aggregated in two salted levels, all other keys in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.session import cut_lineage

FIELD_NAMES = ("why", "how to apply", "rule", "scope", "source", "seen in")


def canonical_text(body: Column, field_names: tuple[str, ...] = FIELD_NAMES) -> Column:
    """The letters and digits of ``body`` in canonical form: lower case, one blank between runs, fields in sorted order.

    A field is a member of a JSON object, or a line that names a field, then a
    colon; the text after it up to the next field belongs to it.
    """
    gap = r"[^\p{L}\p{N}\n\r:：]"
    names = "|".join(rf"{gap}+".join(n.split()) for n in field_names)
    head = rf"(?im)^{gap}*({names}){gap}*[:：]"
    folded = lambda t: F.replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    runs = lambda t: F.trim(F.regexp_replace(folded(t), r"[^\p{L}\p{N}]+", " "))
    marked = F.split(F.regexp_replace(F.regexp_replace(body, "\u0001", " "), head, "\u0001$1 "), "\u0001")
    plain = F.concat(F.slice(marked, 1, 1), F.array_sort(F.transform(F.slice(marked, F.lit(2), F.size(marked)), runs)))
    members = F.from_json(F.when(body.rlike(r"^\s*\{"), body), "map<string,string>")
    fields = F.array_sort(
        F.transform(F.map_entries(members), lambda e: runs(F.concat(e["key"], F.lit(" "), F.coalesce(e["value"], F.lit("")))))
    )
    parts = F.when(F.size(F.map_keys(members)) > 0, fields).otherwise(plain)
    return runs(F.array_join(parts, " "))


def collapse_copies(
    df: DataFrame,
    id_col: str = "memory_id",
    body_col: str = "body",
    hot_rows: int | None = None,
    salts: int = 64,
    most_hot: int = 10_000,
) -> DataFrame:
    """Every record's ``record_key, representative, member, n_copies``; the representative is the smallest id.

    One row per distinct id.  Null bodies and null ids take no part.  Bodies
    without any letter or digit are all the same (empty) record.  Repeated rows
    count once.  An empty table gives an empty result; other columns are ignored.

    Keys of more than ``hot_rows`` rows are hot; by default these are the keys that
    hold more than one in ``most_hot`` of all rows (and 16 rows at least), so there are
    ``most_hot`` of them at the most and their list can be broadcast.  Their rows are
    salted by id into ``salts`` groups, aggregated in each, and the partial results
    aggregated again.  The others need one shuffle, in which no group is large.
    """
    keyed = (
        df.filter(F.col(body_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("member"), F.sha2(canonical_text(F.col(body_col)), 256).alias("record_key"))
        .distinct()
    )
    keyed = cut_lineage(keyed)
    n = keyed.count()
    least = max(16, n // most_hot) if hot_rows is None else max(hot_rows, n // most_hot)
    hot = cut_lineage(keyed.groupBy("record_key").count().filter(F.col("count") > least).select("record_key"))
    n_hot = hot.count()
    small = F.broadcast(hot)
    group = Window.partitionBy("record_key")
    rest = (keyed.join(small, "record_key", "left_anti") if n_hot else keyed).select(
        "record_key", F.min("member").over(group).alias("representative"), "member", F.count(F.lit(1)).over(group).alias("n_copies")
    )
    if not n_hot:
        return rest
    mine = keyed.join(small, "record_key", "left_semi")
    salted = mine.groupBy("record_key", F.pmod(F.xxhash64("member"), F.lit(salts)).alias("salt")).agg(
        F.min("member").alias("least"), F.count(F.lit(1)).alias("n")
    )
    tops = salted.groupBy("record_key").agg(F.min("least").alias("representative"), F.sum("n").alias("n_copies"))
    return rest.unionByName(mine.join(F.broadcast(tops), "record_key").select("record_key", "representative", "member", "n_copies"))
