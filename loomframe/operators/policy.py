"""Filters by facet, by lens and by what a record refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.scalar import norm


def facets(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """``key, kind, value`` rows from scalar or array columns, normed and without repeats; null and blank values are none."""
    types = dict(df.dtypes)
    rows = [F.col(c) if types[c].startswith("array") else F.array(F.col(c).cast("string")) for c in kinds.values()]
    none = F.array().cast("array<struct<kind:string,value:string>>")
    tagged = [F.coalesce(F.transform(values, _tagger(kind)), none) for kind, values in zip(kinds, rows, strict=True)]
    long = df.select(key, F.explode(F.concat(*tagged)).alias("f")).select(key, F.col("f.kind").alias("kind"), norm(F.col("f.value")).alias("value"))
    return long.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def _tagger(kind: str):
    def tag(value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    return tag


def with_facets(df: DataFrame, key: str, table: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Rows that have every wanted (kind, value): one filter and one count, whatever the number of facets."""
    pairs = sorted({(k, v.strip().lower()) for k, v in wanted})
    if not pairs:
        return df
    match = F.lit(False)
    for kind, value in pairs:
        match = match | ((F.col("kind") == kind) & (F.col("value") == value))
    keys = table.filter(match).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(pairs)).select(key)
    return df.join(keys, key, "left_semi")


def lens_matches(df: DataFrame, rules: list[tuple[str, str, str]], kind: str = "kind", domain: str = "domain") -> DataFrame:
    """``df`` with ``lens``, one row per lens that admits the row; ``*`` in a rule (lens, kind, domain) admits any value, null included."""
    lenses = sorted({r[0] for r in rules})

    def admits(lens: str) -> Column:
        ok = F.lit(False)
        for name, k, d in rules:
            if name == lens:
                ok = ok | ((F.lit(True) if k == "*" else F.col(kind).eqNullSafe(F.lit(k))) & (F.lit(True) if d == "*" else F.col(domain).eqNullSafe(F.lit(d))))
        return F.when(ok, F.lit(lens))

    return df.withColumn("lens", F.explode(F.array_compact(F.array(*[admits(n) for n in lenses]))))


def exposed(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, target``: public pages that link to private ones."""
    level = pages.select("page_id", norm(F.col("sensitivity")).alias("level"))
    public = level.filter(F.col("level") == "public").select(F.col("page_id").alias("from_page"))
    private = level.filter(F.col("level") == "private").select(F.col("page_id").alias("to_page_id"))
    return links.join(public, "from_page").join(private, "to_page_id").select(F.col("from_page").alias("page_id"), F.col("to_page_id").alias("target")).distinct()


def missing_vectors(texts: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """``signature, n_texts, n_cached, n_missing``: distinct texts against the vectors kept for each signature, by SHA-1."""
    hashes = texts.filter(F.col(text).isNotNull()).select(F.sha1(text).alias("content_hash")).distinct()
    kept = cache.filter(F.col("vector").isNotNull()).select("content_hash", "signature").distinct()
    found = hashes.join(kept, "content_hash").groupBy("signature").agg(F.count(F.lit(1)).alias("n_cached"))
    total = hashes.agg(F.count(F.lit(1)).alias("n_texts"))
    return found.crossJoin(F.broadcast(total)).select("signature", "n_texts", "n_cached", (F.col("n_texts") - F.col("n_cached")).alias("n_missing"))
