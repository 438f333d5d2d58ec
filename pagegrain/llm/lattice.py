"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected to random orthonormal directions, eight for each of some blocks, and every
block is decoded to the nearest point of the E8 lattice. It lies in the cell of these points and probes cells in which one of them
is replaced by a point around it. Vectors that meet in a cell are compared by exact cosine. Whether two vectors meet depends on these
two alone: blocks, tables and cells are the same for any number of vectors, and other rows never add or take a link. Cells are found
from small rows without vectors; vectors are sent only to cells in which two or more meet, and a cell with very many rows is split to
pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import M1, M2, M3, drop_folder, mix64, ragged, tidy
from pagegrain.llm.components import components, smallest_reachable
from pagegrain.runtime import shared_folder, ship_package

LEAST, SEED = 0.93, 20240817
#: Blocks, tables, probes of a block, and the size of a cell (as a multiple of the share of a vector's length that eight of its
#: dimensions have on average). Each misses less than 2 % of pairs at the threshold itself. The first is the default for any number
#: of vectors; the other has smaller cells and 2.2 times their rows, and only a caller who passes it as ``options`` gets it.
#: Beside each the number of distinct vectors up to which its cells are small.
SETTINGS = ((1 << 24, (2, 8, 6, 0.64)), (1 << 62, (3, 12, 6, 0.8)))
CELL = 2048
#: Cells of at most so many rows are compared as lists of pairs, larger ones as matrices.
SMALL = 48
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: all with two entries of +-1, and all of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1, -1), repeat=2):
                v = [0.0] * 8
                v[i], v[j] = a, b
                out.append(v)
    out += [list(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


NEIGHBOURS = minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer entries of even sum."""
    p = np.rint(x)
    odd = np.flatnonzero(p.sum(axis=1) % 2 != 0)
    r = x[odd] - p[odd]
    at = np.abs(r).argmax(axis=1)
    p[odd, at] += np.where(r[np.arange(len(odd)), at] >= 0, 1, -1)
    return p


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by one half in each entry."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class E8Tables:
    """Cells of unit vectors of one dimension: for each table the own cell and the probed ones, as 64-bit keys."""

    def __init__(self, dim: int, blocks: int, tables: int, probes: int, scale: float, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, blocks])
        wide = max(dim, 8 * blocks)
        self.blocks, self.probes, self.scale = blocks, probes, scale * (8 / wide) ** 0.5
        self.frames = [np.linalg.qr(rng.standard_normal((wide, 8 * blocks)))[0][:dim] for _ in range(tables)]
        self.moves = rng.uniform(0, 2, (tables, 8 * blocks))

    def cells(self, unit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.empty((len(unit), len(self.frames)), np.uint64)
        near = np.empty((len(unit), len(self.frames), self.blocks * self.probes), np.uint64)
        salt = mix64(label.astype(np.int64).view(np.uint64) * M1 + np.uint64(unit.shape[1]))
        for t, frame in enumerate(self.frames):
            x = unit @ frame / self.scale + self.moves[t]
            start = salt + np.uint64((t + 1) * int(M2) % (1 << 64))
            points, parts = [], []
            for k in range(self.blocks):
                block = x[:, 8 * k : 8 * k + 8]
                points.append((block, nearest_e8(block)))
                parts.append(self._part(points[-1][1], k))
            total = start + sum(parts)  # a sum, so that one block can be replaced
            own[:, t] = mix64(total)
            for k, (block, p) in enumerate(points):
                best = np.argsort(-((block - p) @ NEIGHBOURS.T), axis=1, kind="stable")[:, : self.probes]
                for j in range(self.probes):
                    near[:, t, k * self.probes + j] = mix64(total - parts[k] + self._part(p + NEIGHBOURS[best[:, j]], k))
        return own, near

    def _part(self, p: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(p), (k + 1) * int(M3) % (1 << 64), np.uint64)
        for c in np.rint(2 * p).astype(np.int64).view(np.uint64).T:
            h = mix64(h * M1 + c)
        return h


_TABLES: dict[tuple, E8Tables] = {}


def _tables(dim: int, options: tuple) -> E8Tables:
    if (dim, options) not in _TABLES:
        _TABLES[dim, options] = E8Tables(dim, *options)
    return _TABLES[dim, options]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with the first sound row of the task that has its label and vector (``head``); of these also key, count and unit vector."""
    heads: dict[bytes, list] = {}

    def out() -> pa.RecordBatch:
        found = list(heads.items())
        heads.clear()
        n = len(found)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.nulls(n, pa.bool_()), pa.array([h[0] for _, h in found], pa.int64()), pa.array([k for k, _ in found], pa.binary()), pa.array([h[1] for _, h in found], pa.int64()), pa.array([h[2] for _, h in found], pa.int64()), pa.array([h[3] for _, h in found], pa.binary())], names=ROW_NAMES)

    for batch in batches:
        ids, labels, vectors = batch["vec_id"], batch["label"], batch["embedding"]
        n = batch.num_rows
        flat = np.asarray(vectors.flatten().fill_null(float("nan")), np.float64)
        sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
        starts = np.cumsum(sizes) - sizes
        head, sound = np.zeros(n, np.int64), np.zeros(n, bool)
        fit = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & (sizes > 0)
        id_list, label_list = np.asarray(ids.fill_null(0)), np.asarray(labels.fill_null(0))
        for dim in np.unique(sizes[fit]).tolist():
            at = np.flatnonzero(fit & (sizes == dim))
            v = flat[starts[at][:, None] + np.arange(dim)]
            ok = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            at, v = at[ok], v[ok] + 0.0  # no negative zeros
            unit = v / np.abs(v).max(axis=1, initial=0)[:, None]
            unit = unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
            sound[at] = True
            for i, raw, u in zip(at.tolist(), v, unit, strict=True):
                key = xxhash.xxh3_128_digest(raw.tobytes(), seed=int(label_list[i]) & 0xFFFFFFFF)
                known = heads.get(key)
                if known is None:
                    heads[key] = known = [int(id_list[i]), 0, int(label_list[i]), u.tobytes()]
                known[1] += 1
                head[i] = known[0]
        yield pa.RecordBatch.from_arrays([ids, pa.array(sound), pa.array(head, mask=~sound), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=ROW_NAMES)
        if len(heads) > 50_000:
            yield out()
    yield out()


ROW_NAMES = ["vec_id", "sound", "head", "key", "n", "label", "vector"]


def _cells(batches: Iterator[pa.RecordBatch], options: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
            vectors, labels, reps = part["vector"].to_pylist(), part["label"].to_numpy(), part["rep"].to_numpy()
            dims = np.array([len(v) // 8 for v in vectors])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own, near = _tables(dim, options).cells(np.frombuffer(b"".join(vectors[i] for i in at)).reshape(-1, dim), labels[at])
                keys = np.concatenate([own[:, :, None], near], axis=2).reshape(len(at), -1)
                mine = np.zeros((own.shape[1], 1 + near.shape[2]), bool)
                mine[:, 0] = True
                yield pa.RecordBatch.from_pydict({"cell": keys.ravel().view(np.int64), "rep": np.repeat(reps[at], keys.shape[1]), "own": np.tile(mine.ravel(), len(at))})


class Links:
    """Links of classes that a task found, and a forest of them. A pair that meets in several cells counts in the one with the smallest key."""

    def __init__(self, rep: np.ndarray, n: np.ndarray, label: np.ndarray, raw: list[bytes], options: tuple):
        self.rep, self.n, self.label, self.raw, self.options = rep, n, label, raw, options
        self.reps: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.a, self.b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(self, x: np.ndarray, y: np.ndarray, cell: np.ndarray, dim: int) -> None:
        """Linked rows of the task, and the cell where each pair met."""
        for k in range(0, len(x), 20_000):
            xs, ys, here = x[k : k + 20_000], y[k : k + 20_000], cell[k : k + 20_000]
            rows, back = np.unique(np.concatenate([xs, ys]), return_inverse=True)
            own, near = _tables(dim, self.options).cells(np.frombuffer(b"".join([self.raw[i] for i in rows.tolist()])).reshape(len(rows), -1), self.label[rows])
            i, j = back[: len(xs)], back[len(xs) :]
            at_x = np.where((own[i] == own[j]) | (near[j] == own[i][:, :, None]).any(axis=2), own[i], END)
            at_y = np.where((near[i] == own[j][:, :, None]).any(axis=2), own[j], END)
            counted = np.minimum(at_x, at_y).min(axis=1) == here
            xs, ys = xs[counted], ys[counted]
            self.reps += [self.rep[xs], self.rep[ys]]
            self.counts += [self.n[ys], self.n[xs]]
            if len(xs):
                a, b = smallest_reachable(self.rep[xs], self.rep[ys])
                self.a.append(a[a != b])
                self.b.append(b[a != b])

    def table(self) -> pa.Table:
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        if len(a):
            a, b = smallest_reachable(a, b)
            a, b = a[a != b], b[a != b]
        reps, back = np.unique(np.concatenate(self.reps), return_inverse=True) if self.reps else (a[:0], a[:0])
        links = np.bincount(back, np.concatenate(self.counts), len(reps)).astype(np.int64) if len(reps) else reps
        none, void = pa.nulls(len(a), pa.int64()), pa.nulls(len(reps), pa.int64())
        join = lambda x, y: pa.concat_arrays([x, y])
        return pa.table({"rep": join(pa.array(reps, pa.int64()), none), "links": join(pa.array(links, pa.int64()), none), "a": join(void, pa.array(a, pa.int64())), "b": join(void, pa.array(b, pa.int64()))})


def _compare(t: pa.Table, least: float, options: tuple) -> pa.Table:
    """Links in the cells of a task."""
    cell, rep, own = t["cell"].to_numpy().view(np.uint64), t["rep"].to_numpy(), t["own"].to_numpy()
    side, raw = t["side"].to_numpy(), t["vector"].to_pylist()
    dims = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
    found = Links(rep, t["n"].to_numpy(), t["label"].to_numpy(), raw, options)

    def link(x: np.ndarray, y: np.ndarray, dim: int) -> None:
        fit = (rep[x] != rep[y]) & (~own[y] | (rep[x] < rep[y])) & ((side[x] != side[y]) | (side[x] < 0))
        found.add(x[fit], y[fit], cell[x[fit]], dim)

    for dim in np.unique(dims).tolist():
        here = np.flatnonzero(dims == dim)
        # each vector once, whatever the number of its cells here
        reps, first, which = np.unique(rep[here], return_index=True, return_inverse=True)
        unit = np.frombuffer(b"".join([raw[i] for i in here[first].tolist()])).reshape(len(reps), -1)
        order = np.lexsort((~own[here], cell[here]))
        here, which = here[order], which[order]
        borders = np.flatnonzero(np.concatenate([[True], cell[here][1:] != cell[here][:-1], [True]]))
        starts, sizes = borders[:-1], np.diff(borders)
        hosts = np.add.reduceat(own[here].astype(np.int64), starts)
        few = (sizes <= SMALL) & (sizes > 1) & (hosts > 0)
        # small cells: each host with each row of its cell, some hundred thousand pairs at a time
        pairs = np.cumsum(hosts[few] * sizes[few])
        for part in np.split(np.flatnonzero(few), np.searchsorted(pairs, np.arange(PAIRS, int(pairs[-1]) if len(pairs) else 0, PAIRS))):
            host = ragged(starts[part], hosts[part])
            of = np.repeat(sizes[part], hosts[part])
            x, y = np.repeat(host, of), ragged(np.repeat(starts[part], hosts[part]), of)
            close = np.flatnonzero(np.einsum("ij,ij->i", unit[which[x]], unit[which[y]]) >= least)
            link(here[x[close]], here[y[close]], dim)
        for c in np.flatnonzero((sizes > SMALL) & (hosts > 0)).tolist():
            a, b = int(starts[c]), int(starts[c] + sizes[c])
            all_ = unit[which[a:b]].T
            for h in range(a, a + int(hosts[c]), 512):
                some = np.arange(h, min(h + 512, a + int(hosts[c])))
                x, y = np.nonzero(unit[which[some]] @ all_ >= least)
                link(here[some[x]], here[a + y], dim)
    return found.table()


PAIRS = 200_000


def near_vectors(rows: DataFrame, least: float = LEAST, options: tuple[int, int, int, float] = SETTINGS[0][1], cell_rows: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Only vectors of equal label and length are compared. A label that is null, or a vector that is null, empty, zero or
    holds null or non-finite components, links with nothing, nor does a row without an id (whose component is null). Equal
    vectors are one class: each row links with every other row of its class, and with all rows of each linked class, so copies
    are counted but never expanded into pairs; a task first reduces its own copies to one row, so copies of a common vector
    never meet. Rows of one vec_id are one vertex. A pair at the threshold itself (within rounding) may go either way. Vectors of any
    length are taken whole. Every row is indexed. ``options`` (blocks, tables, probes, scale) set the recall; the default
    doesn't depend on the input (tests measure each setting against brute force). Columns besides vec_id, embedding and
    label are ignored whatever their names; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    ship_package(spark)
    folder = shared_folder(spark, "lattice")
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    ddl = "vec_id long, sound boolean, head long, key binary, n long, label long, vector binary"
    v.mapInArrow(_rows, ddl).write.parquet(f"{folder}/rows")
    read = spark.read.schema(ddl).parquet(f"{folder}/rows")
    given = read.filter("key is null").select("vec_id", F.coalesce("sound", F.lit(False)).alias("sound"), "head")
    heads = read.filter("key is not null").select("head", "key", "n", "label", "vector")  # a row for each task and vector
    same = heads.groupBy("key", "label").agg(F.min("head").alias("rep"), F.sum("n").alias("n"), F.first("vector").alias("vector"))
    same.write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    count = classes.count()
    numbered = classes.select("rep", "label", "vector", "n")
    numbered.mapInArrow(lambda batches: _cells(batches, options), "cell long, rep long, own boolean").write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    met = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("own").cast("int")).alias("hosts")).filter("rows > 1 and hosts > 0")
    nb = F.ceil(F.col("rows") / cell_rows).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    placed = cells.join(met, "cell").withColumn("nb", nb).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    bins = max(8, count // 500)
    dealt = placed.select(
        "cell", "rep", "own",
        F.when(F.col("nb") == 1, F.concat(F.lit("bin-"), F.pmod(F.xxhash64("cell"), F.lit(bins)))).otherwise(F.concat_ws("|", "cell", F.least("mine", "other"), F.greatest("mine", "other"))).alias("task"),
        F.when((F.col("nb") == 1) | (F.col("mine") == F.col("other")), -1).otherwise(F.col("mine")).alias("side"),
    )
    dealt.join(numbered, "rep").groupBy("task").applyInArrow(tidy(lambda t: _compare(t, least, options)), "rep long, links long, a long, b long").write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    links = found.filter("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.select("key", "label", "rep", "n").join(links, "rep", "left").select("key", "label", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    per_head = heads.select("head", "key", "label").join(per_class, ["key", "label"]).groupBy("head", "rep").agg(F.max("links").alias("links"))
    per_head.write.parquet(f"{folder}/heads")
    per_head = spark.read.parquet(f"{folder}/heads")
    own = given.filter("sound").select("vec_id", "head").distinct()
    joined = components(found.filter("a is not null").select("a", "b").union(own.select("vec_id", "head")).union(per_head.select("head", "rep")))
    per_id = own.join(per_head, "head").select("vec_id", "rep", "links").distinct().groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = given.select("vec_id", "sound").join(per_id, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    out.select("vec_id", F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")).write.parquet(f"{folder}-result")
    drop_folder(folder)
    return spark.read.schema("vec_id long, n_links long, component_id long, kept boolean").parquet(f"{folder}-result")
