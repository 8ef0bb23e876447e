"""Most similar vectors for every vector (problem 4).

NN-descent: a rough first graph comes from small random-projection leaves; in
every round each vector introduces its neighbours, and those it is a neighbour
of, to each other, and whoever is nearer than a present neighbour takes its
place, until a round changes next to nothing.  New vectors are answered by
greedy search along the graph.

The rounds are Spark joins that move little: the vectors lie in a table
bucketed by block (vectors near each other), the graph beside it, and only edges
between blocks, the vectors at their ends and the finds for other blocks travel.
A block is where things lie, not what is compared: inside of it only leaf mates
of the start and introduced pairs meet.  To Spark a row is what a block keeps or
sends, packed: the numbers of many vectors as the bytes of one array a column.

Vectors are compared by the cosine in double precision; ties go to the smaller
id.  The blocks' centres are fitted on a bounded sample (``sample_rows`` over all
signatures together); every usable vector is then indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.session import cut_lineage, scratch_database, write_bucketed

_ENTRY = "struct<d:double,v:bigint,vb:int,fresh:int>"
_ENTRY_ARROW = pa.struct([("d", pa.float64()), ("v", pa.int64()), ("vb", pa.int32()), ("fresh", pa.int32())])
_PLACED = "blk int, vec_id bigint, home int, visits array<int>, vector binary"
#: Types of the numbers in packed columns; many: the entries of each vector ``u``.
_TYPES = {"vec_id": np.int64, "home": np.int32, "visits": np.int32, "vector": np.float32, "u": np.int64, "ub": np.int32, "worst": np.float64}
_TYPES |= {"many": np.int32, "d": np.float64, "v": np.int64, "vb": np.int32, "fresh": np.int8}
_LISTED, _SENT = ("u", "many", "d", "v", "vb", "fresh"), ("u", "ub", "worst", "vector", "many", "d", "v", "vb", "fresh")
_RESIDENTS = "blk int, vec_id binary, home binary, visits binary, vector binary"
_LISTS = "blk int, at int, " + ", ".join(f"{c} binary" for c in _LISTED)
_LISTS_ARROW = pa.schema([("blk", pa.int32()), ("at", pa.int32()), *((c, pa.binary()) for c in _LISTED)])
_MESSAGE = "blk int, kind int, " + ", ".join(f"{c} binary" for c in _SENT)
_MESSAGE_ARROW = pa.schema([("blk", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in _SENT)])
#: A block's lists; with them the farthest neighbour of each vector, the edges to other blocks, who is at an end of a fresh edge, the numbers of fresh and of all entries.
_OUT_ARROW = pa.struct([("u", pa.int64()), ("d", pa.float64()), ("v", pa.int64()), ("vb", pa.int32()), ("fresh", pa.int32())])
_GRAPH = f"blk int, {', '.join(f'{c} binary' for c in (*_LISTED, 'worst'))}, out array<struct<u:bigint,d:double,v:bigint,vb:int,fresh:int>>, hosts array<bigint>, new bigint, entries bigint"
_GRAPH_ARROW = pa.schema(
    [("blk", pa.int32()), *((c, pa.binary()) for c in (*_LISTED, "worst")), ("out", pa.list_(_OUT_ARROW)), ("hosts", pa.list_(pa.int64())), ("new", pa.int64()), ("entries", pa.int64())]
)
#: Blocks that a vector can lie in: home, second cell, across the nearest cut, second share.
_VISITS = 4
#: Bytes of a packed row at the most, and of the vectors that a task packs at a time.
_PACK, _PACKED_AT_ONCE = 1 << 18, 1 << 24
#: Pairs that are marked in one array at the most, and that are compared in double precision at a time.
_MARKED, _AT_ONCE = 1 << 25, 512
#: Kinds of message to a block: a row of its graph, an edge from elsewhere to one of its vectors, a vector from elsewhere.
_ROW, _POINTED, _SHIPPED = 0, 1, 2


@dataclass(frozen=True)
class Cells:
    """The cells of one signature: unit centres; the bits that split each; per part of a cell the number of blocks and the first one."""

    dim: int
    centres: np.ndarray
    bits: np.ndarray
    part_of: np.ndarray
    shares: np.ndarray
    first: np.ndarray


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(lists), dim)


def _usable(batch: pa.RecordBatch, dim: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given rows (all of length ``dim``): the numbers of those with finite elements, not all zero, and their matrix."""
    x = _matrix(batch.column("vector").take(pa.array(rows)), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def _hash(ids: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _well_formed(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("vec_id"), "signature", "dim", "vector").filter(
        F.col("vec_id").isNotNull() & F.col("signature").isNotNull() & (F.col("dim") > 0) & (F.size("vector") == F.col("dim"))
    )


def _directions(dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(32, dim))[:bits].astype(np.float32) / np.float32(np.sqrt(dim))


def _parts(unit: np.ndarray, cell: Cells, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, part and whether it is the home, of every membership.

    Home is the nearest cell's part; visited are the second nearest cell within
    ``margin`` of that cosine and, in a split cell, the part across the nearest cut.
    """
    rows = np.arange(len(unit))
    near = unit @ cell.centres.T
    one = near.argmax(axis=1)
    best = near[rows, one]
    near[rows, one] = -np.inf
    two = near.argmax(axis=1)
    close = rows[near[rows, two] >= best - margin]
    row, of = np.concatenate([rows, close]), np.concatenate([one, two[close]])
    home = np.arange(len(row)) < len(rows)
    code = np.zeros(len(row), np.int64)
    most = int(cell.bits.max())
    if most:
        split = np.flatnonzero(cell.bits[of])
        away = unit[row[split]] - cell.centres[of[split]]
        side = away @ _directions(cell.dim, most).T
        counts = np.arange(most) < cell.bits[of[split]][:, None]
        code[split] = ((side > 0) & counts) @ (1 << np.arange(most))
        gap = np.where(counts, np.abs(side), np.inf)
        nearest = gap.argmin(axis=1)
        across = home[split] & (gap[np.arange(len(split)), nearest] <= 0.5 * np.linalg.norm(away, axis=1) / np.sqrt(cell.dim))
        other = split[across]
        row, of, home = np.concatenate([row, row[other]]), np.concatenate([of, of[other]]), np.concatenate([home, np.zeros(len(other), bool)])
        code = np.concatenate([code, code[other] ^ (1 << nearest[across])])
    return row, cell.part_of[of] + code, home


def _each_signature(batch: pa.RecordBatch, cells: dict[tuple[str, int], Cells]) -> Iterator[tuple[tuple[str, int], Cells, np.ndarray, np.ndarray]]:
    """Per signature and dim that occurs: the key, its cells, the row numbers of the usable vectors, and these."""
    names = pc.dictionary_encode(batch.column("signature"))
    codes, dims = names.indices.to_numpy(zero_copy_only=False), batch.column("dim").to_numpy(zero_copy_only=False)
    for number, signature in enumerate(names.dictionary.to_pylist()):
        for dim in np.unique(dims[codes == number]):
            cell = cells.get((signature, int(dim)))
            if cell is not None:
                rows, x = _usable(batch, int(dim), np.flatnonzero((codes == number) & (dims == dim)))
                if len(rows):
                    yield (signature, int(dim)), cell, rows, x


def _held(formed: DataFrame, cells: dict[tuple[str, int], Cells], margin: float) -> dict[tuple[str, int], np.ndarray]:
    """The memberships of every part, counted over all vectors."""
    model = formed.sparkSession.sparkContext.broadcast(cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for key, cell, _, x in _each_signature(batch, model.value):
                n = np.bincount(_parts(_unit(x).astype(np.float32), cell, margin)[1], minlength=len(cell.shares))
                total[key] = total.get(key, 0) + n
        for (signature, dim), n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([signature] * len(at), pa.string()), pa.array(np.full(len(at), dim), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], ["signature", "dim", "part", "n"])

    held = {key: np.zeros(len(cell.shares)) for key, cell in cells.items()}
    counted = formed.mapInArrow(count, "signature string, dim int, part int, n bigint").groupBy("signature", "dim", "part").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():
        held[(r.signature, r.dim)][r.part] = r.n
    return held


def _laid_out(formed: DataFrame, cells: dict[tuple[str, int], Cells], block_rows: int, margin: float) -> dict[tuple[str, int], Cells]:
    """Cells of more than ``block_rows`` split by random projections; parts that are still larger (near copies) by hashes of the id."""
    held = _held(formed, cells, margin)
    for key, cell in cells.items():
        bits = np.ceil(np.log2(np.maximum(1.0, held[key] / block_rows))).astype(np.int64)
        width = 1 << bits
        cells[key] = replace(cell, bits=bits, part_of=np.cumsum(width) - width, shares=np.ones(int(width.sum()), np.int64))
    if any(cell.bits.any() for cell in cells.values()):
        held = _held(formed, cells, margin)
        for key, cell in cells.items():
            cells[key] = replace(cell, shares=np.where(held[key] > block_rows, np.ceil(2 * held[key] / block_rows), 1).astype(np.int64))
    used = 0
    for key, cell in cells.items():
        cells[key] = replace(cell, first=used + np.cumsum(cell.shares) - cell.shares)
        used += int(cell.shares.sum())
    return cells


def fit_cells(
    vectors: DataFrame, id_col: str = "vec_id", cell_rows: int = 400, sample_rows: int = 65_536, block_rows: int = 8192, margin: float = 0.05
) -> dict[tuple[str, int], Cells]:
    """Centres per (signature, dim) by spherical k-means on a sample chosen by a hash of the id, and how cells are split.

    The sample holds about ``sample_rows`` vectors over all signatures together, 64 a
    centre.  How a cell is split follows from a count over all vectors.
    """
    formed = _well_formed(vectors, id_col)
    counts = {(r.signature, r.dim): r["count"] for r in formed.groupBy("signature", "dim").count().toLocalIterator()}
    if not counts:
        return {}
    whole = sum(counts.values())
    wanted = {key: max(1, n // cell_rows) for key, n in counts.items()}
    rates = [(s, d, int(1_000_000 * min(1.0, 64 * wanted[(s, d)] / n, sample_rows / whole)) + 1) for (s, d), n in counts.items()]
    draw, most = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)), max(rate for _, _, rate in rates)
    sample = (
        formed.filter(draw < most)
        .join(F.broadcast(formed.sparkSession.createDataFrame(rates, "signature string, dim int, rate int")), ["signature", "dim"])
        .filter(draw < F.col("rate"))
        .select("signature", "dim", "vec_id", "vector")
        .toArrow()
        .combine_chunks()
    )
    cells = {}
    batch = sample.to_batches()[0] if len(sample) else None
    names, dims = np.array(sample.column("signature").to_pylist(), dtype=object), sample.column("dim").to_numpy()
    for (signature, dim), n in sorted(counts.items()):
        x = np.zeros((0, dim), np.float32)
        if batch is not None:
            rows, x = _usable(batch, dim, np.flatnonzero((names == signature) & (dims == dim)))
            x = x[np.argsort(batch.column("vec_id").to_numpy(zero_copy_only=False)[rows], kind="stable")]
        x = _unit(x if len(x) else np.eye(1, dim)).astype(np.float32)
        centres = x[np.random.default_rng(17).choice(len(x), min(max(1, n // cell_rows), -(-len(x) // 16)), replace=False)].copy()
        for _ in range(6):
            owner = (x @ centres.T).argmax(axis=1)
            order = np.argsort(owner, kind="stable")
            heads, starts = np.unique(owner[order], return_index=True)
            sums = np.add.reduceat(x[order], starts, axis=0)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres[heads] = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres[heads])
        _, distinct = np.unique(centres.round(6), axis=0, return_index=True)
        centres = centres[np.sort(distinct)].astype(np.float32)
        none = np.zeros(len(centres), np.int64)
        cells[(signature, dim)] = Cells(dim, centres, none, np.arange(len(centres)), none + 1, none)
    return _laid_out(formed, cells, block_rows, margin)


def _placed(vectors: DataFrame, cells: dict[tuple[str, int], Cells], id_col: str = "vec_id", margin: float = 0.05, loose: bool = False) -> DataFrame:
    """Every usable vector in its home block and in those it visits, packed by block (``loose``: a row each); ``visits`` has ``_VISITS`` places a vector, -1 where empty."""
    model = vectors.sparkSession.sparkContext.broadcast(cells)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        key, cut = _pack(block, dict(zip(("vec_id", "home", "visits", "vector"), columns, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *cut.values()], ["blk", *cut])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0
        for batch in batches:
            all_ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for _, cell, rows, x in _each_signature(batch, model.value):
                ids = all_ids[rows]
                row, part, home = _parts(_unit(x).astype(np.float32), cell, margin)
                share = cell.shares[part].astype(np.uint64)
                block = cell.first[part] + (_hash(ids[row], 1) % share).astype(np.int64)
                again = np.flatnonzero(home & (share > 1))
                other = cell.first[part[again]] + (_hash(ids[row[again]], 2) % share[again]).astype(np.int64)
                lives = np.zeros(len(rows), np.int64)
                lives[row[home]] = block[home]
                row, block = _pairs(np.concatenate([row, row[again]]), np.concatenate([block, other]), 1 << 31)
                visits = np.full((len(rows), _VISITS), -1, np.int32)
                visits[row, _starts(row)] = block
                held.setdefault(cell.dim, []).append((block, ids[row], lives[row], visits[row], x[row]))
                size += 4 * cell.dim * len(row)
            if size > _PACKED_AT_ONCE:
                yield from map(packed, held.values())
                held, size = {}, 0
        yield from map(packed, held.values())

    formed = _well_formed(vectors, id_col)
    return formed.mapInArrow(lambda batches: map(_unpacked, place(batches)), _PLACED) if loose else formed.mapInArrow(place, _RESIDENTS)


def _unpacked(packed: pa.Table | pa.RecordBatch) -> pa.Table | pa.RecordBatch:
    """A row for every vector of packed rows, which are of one dim."""
    ids, visits = _numbers(packed, "vec_id"), _numbers(packed, "visits").reshape(-1, _VISITS)
    some, of = visits >= 0, np.repeat(np.arange(packed.num_rows), pc.binary_length(packed.column("vec_id")).to_numpy(zero_copy_only=False) // 8)
    ends = np.append(0, np.cumsum(some.sum(axis=1))).astype(np.int32)
    columns = [packed.column("blk").take(pa.array(of)), pa.array(ids), pa.array(_numbers(packed, "home")), pa.ListArray.from_arrays(pa.array(ends), pa.array(visits[some]))]
    return type(packed).from_arrays([*columns, _cut(_vectors(packed), np.arange(len(ids) + 1))], ["blk", "vec_id", "home", "visits", "vector"])


def assign_blocks(vectors: DataFrame, cells: dict[tuple[str, int], Cells], id_col: str = "vec_id", margin: float = 0.05) -> DataFrame:
    """``blk, vec_id, home, visits, vector`` (vector as float bytes): every usable vector in its home block and in those it visits."""
    return _placed(vectors, cells, id_col, margin, loose=True)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal-length float bytes as a matrix."""
    values = _flat(column)
    return np.frombuffer(b"".join(values.to_pylist()), np.float32).reshape(len(values), -1)


def _vectors(residents: pa.Table) -> np.ndarray:
    return _numbers(residents, "vector").reshape(len(_numbers(residents, "vec_id")), -1)


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rows of an array between bounds, as bytes."""
    values = np.ascontiguousarray(values)
    width = values.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(values)])


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """The numbers of all rows of a packed column."""
    values = _flat(table.column(name))
    at, kind = values.buffers()[1:], np.dtype(_TYPES[name])
    if not len(values) or at[1] is None:
        return np.zeros(0, kind)
    ends = np.frombuffer(at[0], np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(at[1], kind, int(ends[-1] - ends[0]) // kind.itemsize, int(ends[0]))


def _pack(key: np.ndarray, columns: dict[str, np.ndarray], entries: _Entries | None = None) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Rows of one key as packed rows of ``_PACK`` bytes at the most: the keys, and the packed columns.  ``entries``: of the rows, in their order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    width = sum(_TYPES[n]().itemsize * int(np.prod(c.shape[1:])) for n, c in columns.items())
    if entries is not None:
        many = np.bincount(entries.owner, minlength=len(key))
        width += 4 + 21 * int(many.max(initial=0))
    starts = np.flatnonzero(_starts(key) % max(1, _PACK // max(1, width)) == 0)
    bounds = np.append(starts, len(key))
    cut = {n: _cut(c[order].astype(_TYPES[n], copy=False), bounds) for n, c in columns.items()}
    if entries is not None:
        first, many = (np.cumsum(many) - many)[order], many[order]
        ends = np.append(0, np.cumsum(many))
        pick = np.repeat(first - ends[:-1], many) + np.arange(ends[-1])
        cut["many"] = _cut(many.astype(np.int32), bounds)
        cut |= {n: _cut(getattr(entries, n)[pick].astype(_TYPES[n], copy=False), ends[bounds]) for n in ("d", "v", "vb", "fresh")}
    return key[starts], cut


def _starts(owner: np.ndarray) -> np.ndarray:
    """For each element of a sorted array its place within its run."""
    at = np.arange(len(owner))
    first = at.copy()
    first[1:][owner[1:] == owner[:-1]] = 0
    return at - np.maximum.accumulate(first)


def _pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of whole numbers, the second ones below ``n``, in order."""
    return np.divmod(np.unique(a * n + b), n)


def _absent(keys: np.ndarray, known: np.ndarray, size: int) -> np.ndarray:
    """The different ``keys``, whole numbers below ``size``, that are not among the ``known``, in order."""
    if size > _MARKED:
        return np.setdiff1d(keys, known)
    marks = np.zeros(size, bool)
    marks[keys] = True
    marks[known] = False
    return np.flatnonzero(marks)


def _by_owner(owner: np.ndarray) -> np.ndarray:
    """The stable order by owner; numbers of 16 bits are sorted by their digits."""
    return np.argsort(owner.astype(np.uint16) if owner.max(initial=0) < 1 << 16 else owner, kind="stable")


def _distance(unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negative cosines of pairs of rows, in double precision."""
    d = np.zeros(len(a))
    for s in range(0, len(a), _AT_ONCE):  # few enough to stay in the cache
        d[s : s + _AT_ONCE] = np.einsum("ij,ij->i", unit[a[s : s + _AT_ONCE]], unit[b[s : s + _AT_ONCE]])
    return -np.round(d, 13)


@dataclass
class _Entries:
    """Neighbour entries of several vectors, as equally long arrays: whose, how far, who, at home where, new or not."""

    owner: np.ndarray
    d: np.ndarray
    v: np.ndarray
    vb: np.ndarray
    fresh: np.ndarray

    def take(self, rows: np.ndarray) -> _Entries:
        return _Entries(self.owner[rows], self.d[rows], self.v[rows], self.vb[rows], self.fresh[rows])

    def plus(self, other: _Entries) -> _Entries:
        return _Entries(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("owner", "d", "v", "vb", "fresh")))

    def best(self, k: int) -> _Entries:
        """The ``k`` nearest of each owner, nearest first, ties by id; one entry a neighbour, the known before the new."""
        order = np.argsort(self.d)
        order = order[_by_owner(self.owner[order])]
        owner, d = self.owner[order], self.d[order]
        tied = np.zeros(len(order), bool)
        tied[1:] = (owner[1:] == owner[:-1]) & (d[1:] == d[:-1])
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        rows = order[at]
        order[at] = rows[np.lexsort((self.fresh[rows], self.v[rows], self.d[rows], self.owner[rows]))]
        one = self.take(order)
        again = np.zeros(len(order), bool)
        again[1:] = (one.owner[1:] == one.owner[:-1]) & (one.v[1:] == one.v[:-1])
        one = one.take(np.flatnonzero(~again))
        return one.take(np.flatnonzero(_starts(one.owner) < k))

    def improved(self, other: _Entries, k: int, owners: int) -> _Entries:
        """The ``k`` nearest among these, which are the nearest so far, and others: only the lists of the others' owners are made anew."""
        touched = np.zeros(owners, bool)
        touched[other.owner] = True
        again = touched[self.owner]
        both = self.take(np.flatnonzero(~again)).plus(self.take(np.flatnonzero(again)).plus(other).best(k))
        return both.take(_by_owner(both.owner))

    @classmethod
    def of(cls, owner: np.ndarray, packed: pa.Table) -> _Entries:
        """From packed lists, ``owner`` naming each list's vector."""
        d, v, vb, fresh = (_numbers(packed, n) for n in ("d", "v", "vb", "fresh"))
        return cls(np.repeat(owner, _numbers(packed, "many")), d, v, vb.astype(np.int64), fresh.astype(np.int64))

    def cells(self, owners: int) -> pa.Array:
        """As list cells of the owners ``0 .. owners-1``; entries must be in the order of their owners."""
        inner = pa.StructArray.from_arrays(
            [pa.array(self.d), pa.array(self.v, pa.int64()), pa.array(self.vb.astype(np.int32)), pa.array(self.fresh.astype(np.int32))], fields=list(_ENTRY_ARROW)
        )
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(self.owner, np.arange(owners + 1)).astype(np.int32)), inner)


def _listed(at: int, homes: np.ndarray, ids: np.ndarray, entries: _Entries, rows: np.ndarray) -> pa.Table:
    """The lists of the vectors ``rows`` for the homes of these; no other vector has entries."""
    place = np.zeros(len(ids), np.int64)
    place[rows] = np.arange(len(rows))
    order = np.argsort(place[entries.owner], kind="stable")
    entries = entries.take(order)
    key, cut = _pack(homes[rows], {"u": ids[rows]}, replace(entries, owner=place[entries.owner]))
    return pa.table({"blk": pa.array(key.astype(np.int32)), "at": pa.array(np.full(len(key), at, np.int32)), **cut}, schema=_LISTS_ARROW)


def _leaves(unit: np.ndarray, leaf: int, r: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows halved at the median of random projections, equal ones at random, down to ``leaf`` rows each."""
    todo = [r.permutation(len(unit))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield np.sort(rows)
        else:
            order = rows[np.argsort(unit[rows] @ r.normal(size=unit.shape[1]).astype(np.float32), kind="stable")]
            todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]


def _first_lists(k: int, leaf: int, trees: int):
    """The start of a block: each vector's nearest mates in ``trees`` leaves of random projections."""

    def start(table: pa.Table) -> pa.Table:
        ids, keep = np.unique(_numbers(table, "vec_id"), return_index=True)
        at, homes = table.column("blk")[0].as_py(), _numbers(table, "home")[keep].astype(np.int64)
        unit = _unit(_vectors(table)[keep])
        light, r = unit.astype(np.float32), np.random.default_rng(at)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _ in range(trees):
            for rows in _leaves(light, leaf, r):
                if len(rows) > 1:
                    sims = light[rows] @ light[rows].T
                    np.fill_diagonal(sims, -np.inf)
                    top = np.argsort(-sims.round(6), axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
                    a.append(np.repeat(rows, top.shape[1]))
                    b.append(rows[top.ravel()])
        a, b = np.divmod(_absent(np.concatenate(a) * len(ids) + np.concatenate(b), np.zeros(0, np.int64), len(ids) ** 2), len(ids))
        found = _Entries(a, _distance(unit, a, b), ids[b], homes[b], np.ones(len(a), np.int64)).best(k)
        return _listed(at, homes, ids, found, np.arange(len(ids)))

    return start


def _merged(k: int):
    """A block's own lists and what other blocks found for its vectors, as one list each."""

    def merge(own: pa.Table, offers: pa.Table) -> pa.Table:
        if not len(own):
            return _GRAPH_ARROW.empty_table()
        blk, ids = own.column("blk")[0].as_py(), _numbers(own, "u")
        both = _Entries.of(np.arange(len(ids)), own)
        if len(offers):
            order = np.argsort(ids)
            to = order[np.searchsorted(ids, _numbers(offers, "u"), sorter=order)]
            both = both.improved(_Entries.of(to, offers), k, len(ids))
        many = np.bincount(both.owner, minlength=len(ids))
        worst, full = np.ones(len(ids)), np.flatnonzero(many >= k)
        worst[full] = both.d[np.cumsum(many)[full] - 1]
        key, cut = _pack(np.full(len(ids), blk), {"u": ids, "worst": worst}, both)
        out, fresh = both.take(np.flatnonzero(both.vb != blk)), np.flatnonzero(both.fresh)
        edges = [pa.array(ids[out.owner]), pa.array(out.d), pa.array(out.v), pa.array(out.vb.astype(np.int32)), pa.array(out.fresh.astype(np.int32))]
        hosts = np.unique(np.concatenate([ids[both.owner[fresh]], both.v[fresh]]))
        ends = lambda n: pa.array([0] + [n] * len(key), pa.int32())  # noqa: E731  (all of the block in its first row)
        cut["out"] = pa.ListArray.from_arrays(ends(len(out.d)), pa.StructArray.from_arrays(edges, fields=list(_OUT_ARROW)))
        cut["hosts"] = pa.ListArray.from_arrays(ends(len(hosts)), pa.array(hosts))
        for name, n in (("new", len(fresh)), ("entries", len(both.d))):
            cut[name] = pa.array([n] + [0] * (len(key) - 1), pa.int64())
        return pa.table({"blk": pa.array(key.astype(np.int32)), **cut}).select(_GRAPH_ARROW.names)

    return merge


def _picked(asked: pa.Table, residents: pa.Table) -> pa.Table:
    """The vectors of a block that other blocks ask for, one row per block and vector, unless the vector visits that block anyhow; and the edges that came with the wishes.

    ``asked`` has the wishes and, with ``to`` null, the farthest present neighbour of each vector at home.
    """
    if not len(asked) or not len(residents):
        return _MESSAGE_ARROW.empty_table()
    at, given = residents.column("blk")[0].as_py(), asked.column("to").is_valid()
    wanted, lists = asked.filter(given), asked.filter(pc.invert(given))
    ids, keep = np.unique(_numbers(residents, "vec_id"), return_index=True)
    worst = np.ones(len(ids))
    worst[np.searchsorted(ids, _numbers(lists, "u"))] = _numbers(lists, "worst")
    x, to = wanted.column("x").to_numpy(), wanted.column("to").to_numpy().astype(np.int64)
    row, to = _pairs(np.searchsorted(ids, x), to, 1 << 31)
    away = np.flatnonzero((_numbers(residents, "visits").reshape(-1, _VISITS)[keep[row]] != to[:, None]).all(axis=1))
    row, to = row[away], to[away]
    key, sent = _pack(to, {"u": ids[row], "ub": np.full(len(row), at), "worst": worst[row], "vector": _vectors(residents)[keep[row]]})
    edges = wanted.filter(wanted.column("v").is_valid())
    d, x, fresh, v, to = (edges.column(c).to_numpy() for c in ("d", "x", "fresh", "v", "to"))
    n = len(edges)
    there, told = _pack(to, {"u": v}, _Entries(np.arange(n), d, x, np.full(n, at), fresh))
    return pa.concat_tables([_message(_SHIPPED, key, sent), _message(_POINTED, there, told)])


def _message(kind: int, blk: np.ndarray, packed: dict[str, pa.Array]) -> pa.Table:
    n = len(blk)
    return pa.table(
        {"blk": pa.array(blk.astype(np.int32)), "kind": pa.array(np.full(n, kind, np.int32))} | {c: packed[c] if c in packed else pa.nulls(n, pa.binary()) for c in _SENT},
        schema=_MESSAGE_ARROW,
    )


def _introduced(k: int, rest: int):
    """One round in a block: every vector at home introduces its neighbours and those that point at it, ``rest`` of these at a time, to each other."""

    def groups(fwd: _Entries, place: np.ndarray, back: np.ndarray, member: np.ndarray, fresh: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of members (a vector, its neighbours, a slice of those that point at it; -1: none), and whether each came with a fresh edge."""
        key, first, which = np.unique(np.concatenate([fwd.owner * n + place, back * n + member]), return_index=True, return_inverse=True)
        old = first < len(place)
        o, m = key // n, key % n
        new = np.zeros(len(key), bool)
        new[which[np.concatenate([fwd.fresh, fresh]) > 0]] = True
        heads = np.unique(o)
        slices = np.maximum(1, -(-np.bincount(o[~old], minlength=n) // rest))[heads]
        base = np.cumsum(slices) - slices
        table = np.full((int(slices.sum()), 1 + k + rest), -1, np.int64)
        marks = np.zeros(table.shape, bool)
        table[:, 0] = np.repeat(heads, slices)
        slot = np.searchsorted(heads, o)
        fo, at = slot[old], 1 + _starts(o[old])
        head, head_new = np.full((len(heads), k), -1, np.int64), np.zeros((len(heads), k), bool)
        head[fo, at - 1], head_new[fo, at - 1] = m[old], new[old]
        table[:, 1 : k + 1], marks[:, 1 : k + 1] = np.repeat(head, slices, axis=0), np.repeat(head_new, slices, axis=0)
        seat = _starts(o[~old])
        row = base[slot[~old]] + seat // rest
        table[row, 1 + k + seat % rest], marks[row, 1 + k + seat % rest] = m[~old], new[~old]
        some = marks.any(axis=1)
        return table[some], marks[some]

    def join(residents: pa.Table, messages: pa.Table) -> pa.Table:
        if not len(residents) or not len(messages):
            return _LISTS_ARROW.empty_table()
        at = residents.column("blk")[0].as_py()
        kind = messages.column("kind").to_numpy()
        of = {n: messages.take(pa.array(np.flatnonzero(kind == n))) for n in (_ROW, _POINTED, _SHIPPED)}
        x, own = _vectors(residents), _numbers(of[_ROW], "u")
        ids, keep = np.unique(np.concatenate([_numbers(residents, "vec_id"), _numbers(of[_SHIPPED], "u")]), return_index=True)
        homes = np.concatenate([_numbers(residents, "home"), _numbers(of[_SHIPPED], "ub")]).astype(np.int64)[keep]
        unit, n = _unit(np.concatenate([x, _numbers(of[_SHIPPED], "vector").reshape(-1, x.shape[1])])[keep]), len(ids)
        light, where = unit.astype(np.float32), lambda v: np.searchsorted(ids, v)
        known, pointed = _Entries.of(where(own), of[_ROW]), _Entries.of(where(_numbers(of[_POINTED], "u")), of[_POINTED])
        limit = np.full(n, -np.inf)  # the cosine that a newcomer must reach
        limit[where(_numbers(of[_SHIPPED], "u"))] = -_numbers(of[_SHIPPED], "worst")
        full = np.flatnonzero(np.bincount(known.owner, minlength=n) >= k)
        far = np.full(n, -np.inf)
        np.maximum.at(far, known.owner, known.d)
        limit[full] = -far[full]

        def here(e: _Entries) -> tuple[_Entries, np.ndarray]:
            place = where(e.v)
            some = np.flatnonzero(ids[np.minimum(place, n - 1)] == e.v)
            return e.take(some), place[some]

        (fwd, place), (pointed, pointing) = here(known), here(pointed)
        local = homes[place] == at
        back = np.concatenate([place[local], pointed.owner])
        member = np.concatenate([fwd.owner[local], pointing])
        fresh = np.concatenate([fwd.fresh[local], pointed.fresh])
        table, marks = groups(fwd, place, back, member, fresh, n)
        keys, width = [np.zeros(0, np.int64)], table.shape[1]
        light = np.vstack([light, np.full((1, light.shape[1]), np.nan, np.float32)])  # an empty seat, -1, is the last row and reaches nothing
        reach = np.append(limit - 1e-6, np.inf).astype(np.float32)
        for s in range(0, len(table), 64):  # few enough to stay in the cache
            t, f = table[s : s + 64], marks[s : s + 64]
            x = light[t]
            met = (x @ x.transpose(0, 2, 1)) >= reach[t][:, :, None]
            met &= f[:, :, None] | f[:, None, :]
            met[:, np.arange(width), np.arange(width)] = False  # the members of a row differ
            at_pair = np.flatnonzero(met)
            first = at_pair // width
            pair = t.ravel()[first] * n + t.ravel()[first // width * width + at_pair % width]
            keys.append(pair)
            if s % 1024 == 960:  # where many pairs repeat, their numbers stay few
                keys[-16:] = [np.unique(np.concatenate(keys[-16:]))]
        a, b = np.divmod(_absent(np.concatenate(keys), fwd.owner * n + place, n * n), n)
        new = _Entries(a, _distance(unit, a, b), ids[b], homes[b], np.ones(len(a), np.int64))
        known.fresh[:] = 0
        lists = known.improved(new, k, n)
        own = np.sort(where(own))
        guests = np.setdiff1d(np.unique(lists.owner), own)
        return _listed(at, homes, ids, lists, np.concatenate([own, guests]))

    return join


def _lists(packed: pa.Table) -> pa.Table:
    """``u, nb``: a row for every list of packed rows."""
    ids = _numbers(packed, "u")
    return pa.table({"u": pa.array(ids), "nb": _Entries.of(np.arange(len(ids)), packed).cells(len(ids))})


def _round(graph: DataFrame, residents: DataFrame, k: int, rest: int, buckets: int, first: bool) -> DataFrame:
    """``blk, at`` and packed lists: those after one round of introductions, still apart by the block ``at`` that found them.

    A vector with a fresh edge from or to it has somebody to introduce.  Only what
    these need from other blocks travels: the vectors at the far ends of their edges.
    The union with rows bucketed alike keeps their buckets, so the graph stays where it is.
    """
    across = graph.select("blk", F.explode("out").alias("e"))
    nobody = [F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("fresh")]
    wanted = across.select(F.col("e.vb").alias("xb"), F.col("blk").alias("to"), F.col("e.v").alias("x"), F.col("e.u").alias("host"), *nobody).unionByName(
        across.select(F.col("blk").alias("xb"), F.col("e.vb").alias("to"), F.col("e.u").alias("x"), F.col("e.v").alias("host"), "e.v", "e.d", "e.fresh")
    )
    if not first:  # at first every edge is fresh
        wanted = wanted.join(graph.select(F.explode("hosts").alias("host")).distinct(), "host", "left_semi")
    asked = wanted.drop("host").repartition(buckets, "xb").unionByName(graph.select(F.col("blk").alias("xb"), "u", "worst"), allowMissingColumns=True)
    messages = asked.groupBy("xb").cogroup(residents.groupBy("blk")).applyInArrow(_picked, _MESSAGE)
    rows = graph.select("blk", F.lit(_ROW).alias("kind"), *_LISTED)
    messages = messages.repartition(buckets, "blk").unionByName(rows, allowMissingColumns=True)
    return residents.groupBy("blk").cogroup(messages.groupBy("blk")).applyInArrow(_introduced(k, rest), _LISTS)


def _copies_apart(formed: DataFrame, k: int, copies: int) -> tuple[DataFrame, DataFrame | None]:
    """Vectors that take part, and the lists ``u, nb`` of the others: of a vector with very many exact copies only the
    ``k + 1`` smallest ids take part, since these are the nearest of all the others.

    Very many are more than ``copies`` and more than a 65,536th of all vectors, so the
    groups that are told to every task are 65,536 at the most.
    """
    least = max(copies, formed.count() // 65_536)
    keyed = formed.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    group = ["signature", "dim", "h1", "h2"]
    hot = cut_lineage(keyed.groupBy(*group).count().filter(F.col("count") > least).drop("count"))
    if hot.isEmpty():
        return formed, None
    sound = F.forall("vector", lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False))) & F.exists("vector", lambda e: e != 0)
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("vec_id"))
    firsts = keyed.join(F.broadcast(hot), group).filter(sound).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    firsts = cut_lineage(firsts.groupBy(*group).agg(F.array_sort(F.collect_set("vec_id")).alias("firsts")))
    marked = keyed.join(F.broadcast(firsts), group, "left")
    apart = F.coalesce(~F.array_contains("firsts", F.col("vec_id")), F.lit(False))
    entry = F.transform("firsts", lambda v: F.struct(F.lit(-1.0).alias("d"), v.alias("v"), F.lit(None).cast("int").alias("vb"), F.lit(0).alias("fresh")))
    others = marked.filter(apart).select(F.col("vec_id").alias("u"), F.slice(entry, 1, k).alias("nb"))
    return marked.filter(~apart).select("vec_id", "signature", "dim", "vector"), others


def neighbour_graph(
    vectors: DataFrame, id_col: str = "vec_id", k: int = 10, rounds: int = 8, delta: float = 0.002, leaf: int = 32, trees: int = 3, rest: int = 12,
    copies: int = 1024, cells: dict | None = None, database: str | None = None, **fit: int,
) -> tuple[DataFrame, DataFrame]:
    """``(graph, residents)``: ``graph`` has ``u, nb`` with the ``k`` nearest of each vector, nearest first.

    Takes part: a vector that is not null, has ``dim`` finite elements and is not
    all zero, of a row with id, signature and dim.  Vectors are compared within
    one signature and dim.  Repeated rows count once.  ``rounds`` bounds the
    rounds; they end earlier once fewer than ``delta`` of all entries are new.
    A vector that many point at introduces all of them, in slices of ``rest``.
    An empty table gives an empty graph, a lone vector an empty list.

    ``trees`` must be two at least: the leaves of one alone have no links between them.

    Scratch tables lie in ``database``; without one they are dropped at the end, and
    ``residents`` (``blk, vec_id, home, visits, vector``) is placed anew when read.
    """
    spark = vectors.sparkSession
    formed, others = _copies_apart(_well_formed(vectors, id_col), k, copies)
    cells = fit_cells(formed, **fit) if cells is None else cells
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch_database(spark, database) as scratch:
        residents, packed_name = write_bucketed(_placed(formed, cells).repartition(buckets, "blk"), scratch, "blk", buckets)

        def kept(lists: DataFrame) -> tuple[DataFrame, str]:
            """Lists of several blocks as the graph, bucketed like the vectors."""
            raw, raw_name = write_bucketed(lists, scratch, "at", buckets)
            own, offers = raw.filter(F.col("at") == F.col("blk")), raw.filter(F.col("at") != F.col("blk"))
            merged = own.groupBy("at").cogroup(offers.groupBy("blk")).applyInArrow(_merged(k), _GRAPH)
            graph, name = write_bucketed(merged, scratch, "blk", buckets)
            spark.sql(f"DROP TABLE {raw_name}")
            return graph, name

        graph, name = kept(residents.groupBy("blk").applyInArrow(_first_lists(k, leaf, trees), _LISTS))
        for number in range(rounds):
            better, later = kept(_round(graph, residents, k, rest, buckets, number == 0))
            spark.sql(f"DROP TABLE {name}")
            graph, name = better, later
            n = graph.agg(F.sum("new").alias("new"), F.sum("entries").alias("all")).first()
            if (n["new"] or 0) <= delta * (n["all"] or 0):
                break
        found = cut_lineage(graph.select("blk", *_LISTED).groupBy("blk").applyInArrow(_lists, f"u bigint, nb array<{_ENTRY}>"))
        if database is None:
            residents = assign_blocks(formed, cells)
        else:
            residents, _ = write_bucketed(residents.groupBy("blk").applyInArrow(_unpacked, _PLACED), scratch, "blk", buckets)
            spark.sql(f"DROP TABLE {packed_name}")
    return found if others is None else found.unionByName(others), residents


def nearest_pairs(graph: DataFrame, k: int = 5) -> DataFrame:
    """``vec_a < vec_b`` where one is among the ``k`` nearest of the other."""
    pair = graph.select("u", F.explode(F.slice("nb", 1, k)).alias("e"))
    return pair.select(F.least("u", "e.v").alias("vec_a"), F.greatest("u", "e.v").alias("vec_b")).distinct()


def graph_search(
    graph: DataFrame, residents: DataFrame, queries: DataFrame, cells: dict, k: int = 5, beam: int = 16, hops: int = 8, entries: int = 160, reverse: int = 16
) -> DataFrame:
    """The ``k`` nearest indexed vectors of every query by greedy search along the graph: ``query_id, rank, vec_id, cosine``.

    ``queries`` has ``vec_id, signature, dim, vector``; a query that is indexed
    itself does not find itself.  The search enters at the ``entries`` spread-out
    vectors of the query's blocks, then follows the edges of its ``beam`` best
    vectors, in both directions (the ``reverse`` nearest that point at a vector),
    until none is new, ``hops`` times at most.
    """
    spread = residents.groupBy("blk").applyInArrow(_spread(entries), "blk int, v bigint, vv binary")
    asked = assign_blocks(queries, cells).select("blk", F.col("vec_id").alias("q"), F.col("vector").alias("qv"))
    asked = cut_lineage(asked.distinct())
    query = asked.dropDuplicates(["q"]).select("q", "qv")
    home = residents.filter(F.col("blk") == F.col("home")).select(F.col("vec_id").alias("v"), F.col("vector").alias("vv")).dropDuplicates(["v"])
    best = Window.partitionBy("q").orderBy("d", "v")
    edge = graph.select("u", F.explode("nb").alias("e")).select("u", F.col("e.d").alias("d"), F.col("e.v").alias("v"))
    pointing = Window.partitionBy("v").orderBy("d", "u")
    back = edge.withColumn("rank", F.row_number().over(pointing)).filter(F.col("rank") <= reverse)
    links = edge.select("u", "v").unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = cut_lineage(links.groupBy("u").agg(F.collect_set("v").alias("next")))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.col("q") != F.col("v")).select("q", "v", "qv", "vv").mapInArrow(_score_rows, "q bigint, v bigint, d double")

    def kept(rows: DataFrame) -> DataFrame:
        one = rows.groupBy("q", "v").agg(F.min("d").alias("d"), F.max("seen").alias("seen"))
        return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= beam).drop("rank")

    state = cut_lineage(kept(scored(asked.join(spread, "blk")).withColumn("seen", F.lit(0))))
    for _ in range(hops):
        open_ = state.filter(F.col("seen") == 0)
        if open_.isEmpty():
            break
        steps = open_.join(links.withColumnRenamed("u", "v"), "v").select("q", F.explode("next").alias("v")).distinct()
        steps = steps.join(state.select("q", "v"), ["q", "v"], "left_anti")
        reached = scored(steps.join(home, "v").join(query, "q")).withColumn("seen", F.lit(0))
        state = cut_lineage(kept(state.withColumn("seen", F.lit(1)).unionByName(reached)))
    ranked = state.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), F.round(-F.col("d"), 9).alias("cosine"))


def _spread(count: int):
    def choose(table: pa.Table) -> pa.Table:
        ids, keep = np.unique(table.column("vec_id").to_numpy(), return_index=True)
        x = _floats(table.column("vector").take(pa.array(keep)))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        picked, close = [0], x @ x[0]
        while len(picked) < min(count, len(ids)):
            i = int(close.argmin())
            if close[i] > 0.999999:
                break
            picked.append(i)
            close = np.maximum(close, x @ x[i])
        rows = keep[np.array(picked)]
        return pa.table({"blk": table.column("blk").take(pa.array(rows)), "v": pa.array(ids[picked]), "vv": table.column("vector").take(pa.array(rows))})

    return choose


def _score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        far = np.zeros(batch.num_rows)
        a, b = batch.column("qv").to_pylist(), batch.column("vv").to_pylist()
        lengths = np.array([len(v) for v in a])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            x = np.frombuffer(b"".join(a[i] for i in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
            y = np.frombuffer(b"".join(b[i] for i in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
            far[rows] = -np.round(np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)), 13)
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(far)], ["q", "v", "d"])


def usable_queries(vectors: DataFrame, every: int = 50, id_col: str = "vec_id") -> DataFrame:
    return vectors.filter(F.col(id_col) % every == 0)
