"""Lexical, vector and graph retrieval, and their fusion."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.functions.scalar import query_tokens, tokens
from loomframe.operators.ranking import RRF_K, best_per_group, fuse
from loomframe.session import cut_lineage

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows fetched per page wanted, in each mode.
DEPTH = 8


def bm25(chunks: DataFrame, query: str, id_col: str = "chunk_id", text_col: str = "text", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``id_col, *keep, score`` (negative, smaller is better) of all chunks that hold a query word.

    Corpus statistics cover all chunks.  The words of a chunk are counted in place by
    column expressions: no posting is exploded and only the matching chunks leave the
    scan.  Repeated rows count once: they are dropped after counting, so no text is
    shuffled, and the counts are written once for both uses.  A word written twice in the query counts twice; a word in more than half
    of all chunks keeps a tiny weight.
    """
    words = query_tokens(query)
    base = chunks.select(id_col, *keep, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))

    def times(word: str) -> Column:
        return F.size(F.filter("_t", lambda t: t == F.lit(word)))

    counted = [times(w).alias(f"_f{i}") for i, w in enumerate(words)]
    base = base.select(id_col, *keep, F.size("_t").alias("_dl"), *counted).distinct()
    if not words:
        return base.filter(F.lit(False)).select(id_col, *keep, F.lit(0.0).alias("score"))
    base = cut_lineage(base)
    seen = [F.sum(F.when(F.col(f"_f{i}") > 0, 1).otherwise(0)).alias(f"_n{i}") for i in range(len(words))]
    stats = base.agg(F.count(F.lit(1)).alias("_N"), F.avg("_dl").alias("_avg"), *seen)
    hits = base.filter(F.greatest(*[F.col(f"_f{i}") for i in range(len(words))], F.lit(0)) > 0).crossJoin(F.broadcast(stats))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_dl") / F.col("_avg"))
    total: Column = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("_N") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        total = total + F.when(F.col(f"_f{i}") > 0, idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + norm)).otherwise(0.0)
    return hits.select(id_col, *keep, (-total).alias("score"))


def ranked_pages(hits: DataFrame, k: int, score: str = "score", page: str = "page_id", chunk: str = "chunk_id") -> DataFrame:
    """The best ``k`` pages of scored chunks (smaller is better): ``page, chunk, score, rank``, each page by its best chunk.

    The first ``k * 8`` chunks are taken, then collapsed to pages, then cut to ``k``.
    """
    near = hits.orderBy(score, chunk).limit(k * DEPTH)
    one = best_per_group(near, page, F.col(score), F.col(chunk))
    rank = F.row_number().over(Window.orderBy(score, chunk)) - 1
    return one.select(page, chunk, score, rank.alias("rank")).filter(F.col("rank") < k)


def contains_text(chunks: DataFrame, needle: str, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Chunks that hold ``needle`` whatever its case, with a window of 120 characters that starts 30 before it."""
    low = needle.lower()
    at = F.instr(F.lower(text_col), low)
    return chunks.filter(F.lower(text_col).contains(low)).select(id_col, F.substr(F.col(text_col), F.greatest(at - 30, F.lit(1)), F.lit(120)).alias("snippet"))


def nearest(base: DataFrame, queries: DataFrame, k: int, base_rows: int = 16_384, query_rows: int = 1_024, id_col: str = "vec_id", vector_col: str = "embedding", by: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, vec_id, distance, rank``: exact L2 neighbours of a stated query set among all rows, in blocks.

    Both sides are cut into blocks of bounded size; every pair of blocks is one matrix
    product in one task, of which only the ``k`` best per query leave it.  A query that
    is among the rows does not find itself.  Null vectors, and vectors whose length
    differs from that of the query, take no part; ties go to the smaller id.  Only rows
    that agree in the columns ``by`` are compared; an id stands for one vector.
    """
    rows = base.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("n"), *by)
    asked = queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("n"), *by)
    nb, nq = max(1, math.ceil(rows.count() / base_rows)), max(1, math.ceil(asked.count() / query_rows))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = rows.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])

    def block(q: pa.Table, b: pa.Table) -> pa.Table:
        if not len(q) or not len(b):
            return schema.empty_table()
        qi, bi = q.column("id").to_numpy(), b.column("id").to_numpy()
        width = q.column("n")[0].as_py()
        x = q.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qi), width)
        y = b.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(bi), width)
        order = np.argsort(bi, kind="stable")
        bi, y = bi[order], y[order]
        x2, y2 = (x**2).sum(1), (y**2).sum(1)
        who, far, asked_by = [], [], []
        for low in range(0, len(qi), 128):
            near = x2[low : low + 128, None] + y2[None, :] - 2 * x[low : low + 128] @ y.T
            slack = 1e-15 * (width + 8) * (x2[low : low + 128, None] + y2[None, :])  # bounds the rounding of the form above
            near[(qi[low : low + 128, None] == bi[None, :]) | np.isnan(near)] = np.inf
            worst = near + slack
            kth = np.partition(worst, min(k, len(bi)) - 1, axis=1)[:, min(k, len(bi)) - 1]
            for r, may in enumerate((near - slack <= kth[:, None]) & np.isfinite(near)):  # every row that may be among the k best, ties included
                some = np.flatnonzero(may)
                exact = np.sqrt(((x[low + r] - y[some]) ** 2).sum(1))
                best = np.argsort(exact, kind="stable")[:k]
                who.append(bi[some[best]])
                far.append(exact[best])
                asked_by.append(np.full(len(best), qi[low + r]))
        return pa.table({"query_id": np.concatenate(asked_by), "vec_id": np.concatenate(who), "distance": np.concatenate(far)}, schema=schema)

    found = left.groupBy("n", *by, "qb", "bb").cogroup(right.groupBy("n", *by, "qb", "bb")).applyInArrow(block, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def finite_vectors(cache: DataFrame) -> DataFrame:
    """``vec_id, content_hash, signature, vector`` of the whole and finite vectors, each row once."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return cache.filter(F.col("signature").isNotNull() & (F.size("vector") == F.col("dim")) & finite).select("vec_id", "content_hash", "signature", "vector").distinct()


def semantic_pages(rows: DataFrame, asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id, page_id, distance, rank``: the ``k`` pages nearest to each query vector within its signature, each by its nearest chunk.

    ``rows`` and ``asked`` are ``finite_vectors``; a vector belongs to the chunks whose
    text has its hash.  ``k * 8`` vectors are fetched, then collapsed to pages.
    """
    near = nearest(rows, asked, k * DEPTH, vector_col="vector", by=("signature",))
    held = chunks.select("page_id", F.sha1("text").alias("content_hash")).distinct()
    pages = near.join(rows.select("vec_id", "content_hash"), "vec_id").join(held, "content_hash").groupBy("query_id", "page_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "page_id")
    return pages.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k).select("query_id", "page_id", "distance", "rank")


def hybrid(lexical: DataFrame, semantic: DataFrame | None, neighbours: DataFrame | None, k: int) -> DataFrame:
    """``page_id, score, rank``: fused ranks, then a nudge by graph distance from the best fused pages.

    ``neighbours`` has ``page_id, hops`` (0 for a seed); a page that is no candidate yet
    enters by the nudge alone.  Without a semantic list the lexical one stands alone.
    """
    fused = fuse([lexical] + ([semantic] if semantic is not None else []), ["page_id"])
    if neighbours is not None:
        gap = 1.0 / RRF_K - 1.0 / (RRF_K + 1)
        near = neighbours.select("page_id", (F.lit(4 * gap) / (1 + F.col("hops"))).alias("nudge"))
        fused = fused.join(near, "page_id", "full_outer").select(
            "page_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("nudge", F.lit(0.0))).alias("score"), F.coalesce("first_mode", F.lit(9)).alias("first_mode"), F.coalesce("first_rank", F.lit(0)).alias("first_rank")
        )
    top = fused.withColumn("score", F.round("score", 12)).orderBy(F.col("score").desc(), "first_mode", "first_rank", "page_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "first_mode", "first_rank", "page_id")) - 1
    return top.select("page_id", "score", rank.alias("rank"))


def _packed(**arrays: np.ndarray) -> bytes:
    held = pa.table({"name": list(arrays), "kind": [x.dtype.str for x in arrays.values()], "data": [x.tobytes() for x in arrays.values()]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(held)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    rows = pa.ipc.open_stream(data).read_all().to_pylist()
    return {r["name"]: np.frombuffer(r["data"], dtype=r["kind"]) for r in rows}


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the stated lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _block_index(rows: pa.Table, id_col: str) -> dict:
    """The postings of one block of chunks: repeated rows dropped, rows of the same id and length merged."""
    ids = pc.unique(rows.column(id_col))
    ids = ids.take(pc.sort_indices(ids))
    at = pc.index_in(rows.column(id_col), value_set=ids).to_numpy().astype(np.int64)
    same = np.lexsort((rows.column("_h").to_numpy(), at))
    marks = rows.column("_h").to_numpy()[same]
    first = np.ones(len(same), bool)
    first[1:] = (at[same][1:] != at[same][:-1]) | (marks[1:] != marks[:-1])
    kept = np.zeros(len(same), bool)
    kept[same[first]] = True
    size = rows.column("_dl").to_numpy().astype(np.int64)
    pairs, pair = np.unique(at << 32 | size, return_inverse=True)
    words = rows.column("_t")
    counts = pc.list_value_length(words).to_numpy().astype(np.int64)
    term = pc.list_flatten(words).to_numpy().astype(np.int64)
    whose = np.repeat(np.arange(len(at)), counts)
    term, whose = term[kept[whose]], whose[kept[whose]]
    key, f = np.unique(term * len(pairs) + pair[whose], return_counts=True)
    terms, n = np.unique(key // len(pairs), return_counts=True)
    held = _packed(terms=terms.astype(np.int32), n=n.astype(np.int32), pair=(key % len(pairs)).astype(np.int32), f=f.astype(np.int32), doc=(pairs >> 32).astype(np.int32), dl=(pairs & 0xFFFFFFFF).astype(np.int32))
    return {"_ids": ids, "_rows": int(kept.sum()), "_words": int(size[kept].sum()), "_index": held, "_terms": terms, "_n": n}


def _block_scores(x: dict[str, np.ndarray], docs: int, k: int, avg: float, idf: np.ndarray, groups: list[np.ndarray], group_of: np.ndarray, rare_q: np.ndarray, rare_t: np.ndarray) -> tuple[np.ndarray, ...]:
    """``group, query, doc, score``: the ``k`` best of each group of frequent terms in a block, and of each query among the rows that hold a rare term of it."""
    f, term = x["f"].astype(np.float64), np.repeat(x["terms"], x["n"])
    w = idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * x["dl"][x["pair"]] / avg))
    doc = x["doc"][x["pair"]].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    if not new.all():  # an id with rows of several lengths
        w, doc, term = np.add.reduceat(w, np.flatnonzero(new)), doc[new], term[new]
    low, high = np.searchsorted(term, np.arange(len(idf))), np.searchsorted(term, np.arange(len(idf)), side="right")
    many = high[rare_t] - low[rare_t]
    place = np.repeat(low[rare_t], many) + _runs(many)
    key, inverse = np.unique(np.repeat(rare_q, many) * docs + doc[place], return_inverse=True)
    query, held = key // docs, key % docs
    score = np.bincount(inverse, weights=w[place], minlength=len(key))
    by_group = np.argsort(group_of[query], kind="stable")
    query, held, score = query[by_group], held[by_group], score[by_group]
    ends = np.searchsorted(group_of[query], np.arange(len(groups) + 1))
    total, out = np.zeros(docs), []
    for g, parts in enumerate(groups):
        parts = [t for t in parts if high[t] > low[t]]
        if not parts:
            continue
        for t in parts:
            total[doc[low[t] : high[t]]] += w[low[t] : high[t]]
        own = np.concatenate([doc[low[t] : high[t]] for t in parts])
        of, room = total[own], k * len(parts)  # a row is met once per term at most
        may = np.unique(own[of >= np.partition(of, len(of) - room)[len(of) - room] - 1e-8] if len(of) > room else own)
        sums = np.round(total[may], 9)
        best = np.lexsort((may, -sums))[:k]
        out.append((np.full(len(best), g), may[best], sums[best]))
        if ends[g] < ends[g + 1]:
            score[ends[g] : ends[g + 1]] += total[held[ends[g] : ends[g + 1]]]
        total[own] = 0.0
    score = np.round(score, 9)
    order = np.lexsort((held, -score, query))
    query, held, score = query[order], held[order], score[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    query, held, score = query[top], held[top], score[top]
    g, d, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return np.concatenate([g, np.full(len(query), -1)]), np.concatenate([np.full(len(g), -1), query]), np.concatenate([d, held]), np.concatenate([s, score])


def batch_lexical(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", text_col: str = "text", block_rows: int = 131_072, rare: int = 256) -> DataFrame:
    """``query_id, id_col, score, rank``: BM25 of many queries (``query_id, terms``) at once, exact, in blocks of chunks.

    Chunks are reduced to the numbers of the query terms they hold before they move, and
    each block is indexed once; a repeated row counts once.  The sum over the terms of a
    query that more than ``rare`` chunks hold is found once for all queries that agree in
    them: a chunk without any other term of the query is among its ``k`` best only if it
    is among the ``k`` best of that sum, and the chunks that hold another term are few and
    scored one by one.  Only the ``k`` best leave a block.  The queries and their
    vocabulary are held by the driver and told to all tasks.
    """
    spark, id_type = chunks.sparkSession, chunks.schema[id_col].dataType.simpleString()
    asked = queries.select("query_id", F.array_sort(F.array_distinct(F.array_compact("terms"))).alias("t")).filter(F.size("t") > 0).toArrow()
    n_rows = chunks.count()
    query_type = queries.schema["query_id"].dataType.simpleString()
    if not len(asked) or not n_rows:
        return spark.createDataFrame([], f"query_id {query_type}, {id_col} {id_type}, score double, rank int")
    encoded = pc.list_flatten(asked.column("t")).combine_chunks().dictionary_encode()
    sized = pc.list_value_length(asked.column("t")).to_numpy()
    words, query_terms, query_of = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(asked)), sized)
    told = spark.sparkContext.broadcast(words)
    blocks = max(math.ceil(n_rows / block_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n_rows / 16_384)))
    row = F.xxhash64(*chunks.columns, *[F.col(c).isNull() for c in chunks.columns])
    cut = tokens(F.coalesce(F.col(text_col), F.lit("")))
    base = chunks.select(F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("_b"), id_col, row.alias("_h"), cut.alias("_t"))

    def number(batches):
        for x in batches:
            each = x.column("_t")
            count = pc.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.index_in(each.flatten(), value_set=told.value)
            held = found.is_valid().to_numpy(zero_copy_only=False)
            n = np.bincount(np.repeat(np.arange(len(count)), count)[held], minlength=len(count))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), found.drop_null().cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([x.column("_b"), x.column(id_col), x.column("_h"), pa.array(count, pa.int32()), lists], ["_b", id_col, "_h", "_dl", "_t"])

    def index(rows: pa.Table) -> pa.Table:
        made = _block_index(rows, id_col)
        return pa.table({"_ids": pa.array([made["_ids"]], pa.list_(rows.schema.field(id_col).type)), "_rows": [made["_rows"]], "_words": [made["_words"]], "_index": pa.array([made["_index"]], pa.binary()), "_terms": pa.array([made["_terms"]], pa.list_(pa.int32())), "_n": pa.array([made["_n"]], pa.list_(pa.int64()))})

    held = base.mapInArrow(number, f"_b int, {id_col} {id_type}, _h long, _dl int, _t array<int>").groupBy("_b")
    held = cut_lineage(held.applyInArrow(index, f"_ids array<{id_type}>, _rows long, _words long, _index binary, _terms array<int>, _n array<long>"))
    total, length = held.agg(F.sum("_rows"), F.sum("_words")).first()
    seen = held.select(F.explode(F.arrays_zip("_terms", "_n")).alias("z")).groupBy(F.col("z._terms").alias("term")).agg(F.sum("z._n").alias("n")).toArrow()
    n = np.zeros(len(words))
    n[seen.column("term").to_numpy()] = seen.column("n").to_numpy()
    idf = np.log((total - n + 0.5) / (n + 0.5))
    idf[idf <= 0] = IDF_FLOOR
    frequent, other = n[query_terms] > rare, (n[query_terms] > 0) & (n[query_terms] <= rare)
    parts, places = query_terms[frequent], np.searchsorted(query_of[frequent], np.arange(len(asked) + 1))
    numbers: dict[bytes, int] = {}
    group_of = np.array([numbers.setdefault(np.sort(parts[a:b]).tobytes(), len(numbers)) if a < b else -1 for a, b in zip(places[:-1], places[1:])])
    plan = spark.sparkContext.broadcast((idf, list(numbers), group_of, query_of[other], query_terms[other], asked.column("query_id").combine_chunks()))
    average = length / total

    def score(batches):
        idf, keys, group_of, rare_q, rare_t, _ = plan.value
        groups = [np.frombuffer(x, np.int64) for x in keys]
        for x in batches:
            for ids, data in zip(x.column("_ids"), x.column("_index")):
                g, q, d, s = _block_scores(_unpacked(data.as_py()), len(ids), k, average, idf, groups, group_of, rare_q, rare_t)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(q, pa.int32()), ids.values.take(pa.array(d)), pa.array(s, pa.float64())], ["_g", "_q", id_col, "score"])

    def spread(batches):
        group_of = plan.value[2]
        order = np.argsort(group_of, kind="stable")
        for x in batches:
            g = x.column("_g").to_numpy()
            low, high = (np.searchsorted(group_of[order], g, side=side) for side in ("left", "right"))
            at = np.repeat(np.arange(len(g)), high - low)
            yield pa.RecordBatch.from_arrays([pa.array(order[np.repeat(low, high - low) + _runs(high - low)], pa.int32()), x.column(id_col).take(pa.array(at)), x.column("score").take(pa.array(at))], ["_q", id_col, "score"])

    def name(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([plan.value[5].take(x.column("_q")), x.column(id_col), x.column("score"), x.column("rank")], ["query_id", id_col, "score", "rank"])

    def ranked(rows: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
        return rows.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)

    scored = cut_lineage(held.select("_ids", "_index").mapInArrow(score, f"_g int, _q int, {id_col} {id_type}, score double"))
    shared = ranked(scored.filter("_g >= 0"), "_g").select("_g", id_col, "score").mapInArrow(spread, f"_q int, {id_col} {id_type}, score double")
    best = ranked(shared.unionByName(scored.filter("_g < 0").select("_q", id_col, "score")).groupBy("_q", id_col).agg(F.max("score").alias("score")), "_q")
    return best.select("_q", id_col, "score", "rank").mapInArrow(name, f"query_id {query_type}, {id_col} {id_type}, score double, rank int")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``query_id, precision, recall, reciprocal_rank``: precision divides by ``k``; a query without hits scores 0.

    ``ranked`` has ``query_id, item, rank``, ``gold`` has ``query_id, item``.
    """
    hit = ranked.filter(F.col("rank") < k).join(gold.distinct(), ["query_id", "item"], "left_semi")
    per = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("h"), F.min("rank").alias("first"))
    wanted = gold.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("g"))
    return wanted.join(per, "query_id", "left").select(
        "query_id", (F.coalesce("h", F.lit(0)) / F.lit(k)).alias("precision"), (F.coalesce("h", F.lit(0)) / F.col("g")).alias("recall"), F.coalesce(1.0 / (1 + F.col("first")), F.lit(0.0)).alias("reciprocal_rank")
    )

