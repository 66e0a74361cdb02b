"""Most similar vectors for every vector: NN-descent in Spark joins, and greedy search on the graph it builds.

Vectors are kept as 8-bit codes while the graph is built; cosines of codes are off by less than MARGIN, so whoever
needs exact values recomputes the few that matter. Equal codes of a model are one node. The graph starts from a forest:
every tree divides the nodes into cells by pivots of its own, and nodes of one cell block are compared with each
other. Then each round joins every node with the codes of its neighbours, in both directions of a link, and compares
those neighbours among themselves, for a neighbour of a neighbour is likely to be one itself; only links that
are new since the last round are followed again. What a round no longer needs is deleted as soon as it has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, durable, release, written

#: Rows of the bounded sample that pivots are taken from.
SAMPLE = 16_384
#: Nodes aimed at per cell, which is what one task holds of a tree at a time, and most pivots of one division.
CELL, FAN = 8192, 256
#: Trees whose lists are merged at a time.
WAVE = 8
#: Bound on the error of a cosine between two codes (64 dimensions; measured: 0.0013 at most).
MARGIN = 0.005
#: Nodes per task of the merge and local join steps.
TASK_ROWS = 20_000
#: Rounds end when fewer than this share of all list places changed.
STILL = 0.002
#: Similarity of a link that was put down without comparing.
UNSEEN = -2.0
#: Stands for a null model inside the graph; no name can be it.
NO_MODEL = "\x01"

CODES = "id bigint, model string, code binary"
LISTS = "id bigint, model string, near array<bigint>, sims array<float>"
GRAPH = LISTS + ", fresh array<boolean>"

#: Of nearest_exact: queries sent out at once (256 bytes each at 64 dimensions), rows per task at least when there are many,
#: and more than a float32 product of unit vectors is off.
QUERY_ROWS, SCAN_ROWS, SLIP = 100_000, 250_000, 2e-5


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 rows) of the lists that have `dims` finite components and are not all zero."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dims)
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float32())
    x = np.asarray(flat.fill_null(np.nan)).reshape(-1, dims).astype(np.float32)
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def vector_codes(vectors: DataFrame, id_col: str, vec_col: str, model_col: str | None, dims: int) -> DataFrame:
    """(id, model, code): the usable vectors as 8-bit codes, one per (model, id).

    Null ids, null or wrong-length vectors, and vectors with null, NaN or infinite components or of zero length are left out. A
    null model is a model of its own, NO_MODEL. If rows of one id disagree, the one of the smallest code counts.
    """
    model = F.coalesce(F.col(model_col).cast("string"), F.lit(NO_MODEL)) if model_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), model.alias("model"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(2), dims)
            if not len(at):
                continue
            code = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
            keep = pa.array(at)
            codes = pa.Array.from_buffers(pa.binary(dims), len(at), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), codes], ["id", "model", "code"])

    return rows.mapInArrow(encode, CODES).groupBy("id", "model").agg(F.min("code").alias("code"))


def code_classes(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, copies): one node (id, model, code) per distinct code, the smallest id standing for it, and (id, model, node) of the other ids."""
    held = codes.groupBy("model", "code").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = written(held.select("id", "model", "code", "n"))
    shared = nodes.filter("n > 1").select(F.col("id").alias("node"), "model", "code")
    copies = codes.join(broadcast_if_small(shared, 160), ["model", "code"]).filter("id <> node").select("id", "model", "node")
    return nodes.drop("n"), copies


def _units(code: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes as unit vectors, and the lengths they had."""
    x = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(-1, dims).astype(np.float32)
    norm = np.linalg.norm(x, axis=1)
    return x / norm[:, None], norm


def _settled(sims: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same similarity for the same two codes, however it was multiplied out: products of codes are whole numbers. a and b are their lengths."""
    return np.rint(sims * (a * b)) / (a * b)


def _top(ids: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of flat (id, near, sim[, fresh]) rows: the distinct ids, where their lists start, and the k best distinct neighbours of each.

    Repeated links have one similarity (see _settled); the one that is not fresh stays.
    """
    keys = (near, -sims, ids) if fresh is None else (fresh, near, -sims, ids)
    fresh = np.zeros(len(ids), bool) if fresh is None else fresh
    order = np.lexsort(keys)
    ids, near, sims, fresh = ids[order], near[order], sims[order], fresh[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (near[1:] != near[:-1])
    ids, near, sims, fresh = ids[first], near[first], sims[first], fresh[first]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(ids)]))))
    keep = place < k
    ids, near, sims, fresh = ids[keep], near[keep], sims[keep], fresh[keep]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    return ids[starts] if len(ids) else ids, starts, near, sims, fresh


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate((starts, [len(values)])).astype(np.int32)), pa.array(values, kind))


def _batch(model: str, ids: np.ndarray, starts: np.ndarray, near: np.ndarray, sims: np.ndarray, fresh: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array([model] * len(ids), pa.string()), _lists(starts, near, pa.int64()), _lists(starts, sims, pa.float32())]
    if fresh is not None:
        columns.append(_lists(starts, fresh, pa.bool_()))
    return pa.RecordBatch.from_arrays(columns, ["id", "model", "near", "sims", "fresh"][: len(columns)])


def _merge(old: DataFrame | None, news: DataFrame, k: int, parts: int) -> DataFrame:
    """The graph of the k best of all lists of each node; links that `old` does not hold are fresh."""
    rows = news.withColumn("new", F.lit(True))
    if old is not None:
        rows = old.select("id", "model", "near", "sims", F.lit(False).alias("new")).unionByName(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        # concatenated by column: chunks of lists do not share offsets
        ids_, models, near_, sims_, new_ = (pa.concat_arrays([b.column(c) for b in held]) for c in ("id", "model", "near", "sims", "new"))
        coded = models.dictionary_encode()
        n, kind = np.asarray(near_.value_lengths()), np.asarray(coded.indices)
        near, sims = np.asarray(near_.flatten()), np.asarray(sims_.flatten())
        every, owner, fresh = np.asarray(ids_), np.repeat(np.asarray(ids_), n), np.repeat(np.asarray(new_), n)
        of = np.repeat(kind, n)
        if (sims <= UNSEEN).any():  # a link that has been compared meanwhile replaces itself
            order = np.lexsort((-sims, near, owner, of))
            once = np.ones(len(order), bool)
            once[1:] = (np.diff(near[order]) != 0) | (np.diff(owner[order]) != 0) | (np.diff(of[order]) != 0)
            near, sims, owner, fresh, of = (a[order[once]] for a in (near, sims, owner, fresh, of))
        for c, name in enumerate(coded.dictionary.to_pylist()):
            mine = of == c
            top = _top(owner[mine], near[mine], sims[mine], k, fresh[mine])
            yield _batch(name, *top)
            alone = np.setdiff1d(every[kind == c], top[0])  # no neighbour so far
            if len(alone):
                yield _batch(name, alone, np.zeros(len(alone), np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool))

    return rows.repartition(parts, "id").mapInArrow(merge, GRAPH)


class _Tree:
    """Cells of one tree: every division sends a vector to its most similar pivot, until cells hold about CELL vectors."""

    def __init__(self, x: np.ndarray, share: float, rng: np.random.Generator) -> None:
        self.pivots: list[np.ndarray | None] = []
        self.children: list[np.ndarray] = []
        self._grow(x, share, rng, 0)

    def _grow(self, x: np.ndarray, share: float, rng: np.random.Generator, depth: int) -> int:
        at = len(self.pivots)
        self.pivots.append(None)
        self.children.append(np.zeros(0, np.int64))
        fan = int(min(FAN, len(x) // 2, np.ceil(len(x) * share / CELL)))
        if fan < 2 or depth > 12:
            return at
        pivots = x[rng.choice(len(x), fan, replace=False)]
        leaf = (x @ pivots.T).argmax(axis=1)
        self.pivots[at] = pivots
        self.children[at] = np.array([self._grow(x[leaf == c], share, rng, depth + 1) for c in range(fan)])
        return at

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            out[rows] = node
            if self.pivots[node] is not None and len(rows):
                leaf = (x[rows] @ self.pivots[node].T).argmax(axis=1)
                todo += [(int(self.children[node][c]), rows[leaf == c]) for c in np.unique(leaf)]
        return out


def _blocks(x: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers of blocks of a cell: at most 2*size rows, near the same pivot; whatever pivots do not divide is halved along a direction."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= 2 * size:
            yield rows
            continue
        pivots = x[rng.choice(rows, min(FAN, -(-len(rows) // size)), replace=False)]
        leaf = (x[rows] @ pivots.T).argmax(axis=1)
        parts = [rows[leaf == c] for c in np.unique(leaf)]
        if max(map(len, parts)) > 0.7 * len(rows):
            order = np.argsort(x[rows] @ (x[rows[0]] - x[rows[-1]]), kind="stable")
            parts = np.array_split(rows[order], 2)
        todo += parts


def _best(x: np.ndarray, norm: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: the k most similar others of every row, and how similar."""
    size = len(rows)
    near, sims = np.empty((size, k), np.int64), np.empty((size, k), np.float32)
    step = max(1, (1 << 21) // size)
    for lo in range(0, size, step):
        s = x[rows[lo : lo + step]] @ x[rows].T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        best = np.argpartition(s, size - k, axis=1)[:, size - k :]
        near[lo : lo + step], sims[lo : lo + step] = rows[best], np.take_along_axis(s, best, axis=1)
    return near, _settled(sims, norm[rows][:, None], norm[near])


def _tree_lists(nodes: DataFrame, sample: list, n: int, first: int, trees: int, k: int, dims: int, block: int) -> DataFrame:
    """The k most similar of each node among its block, for trees first, first + 1, ..."""
    by: dict[str, list[np.ndarray]] = {}
    for r in sample:
        by.setdefault(r.model, []).append(np.frombuffer(bytes(r.code), np.int8).astype(np.float32))
    forest = {}
    for model, held in by.items():
        x = np.stack(held)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest[model] = [_Tree(x, n / len(sample), np.random.default_rng(t)) for t in range(first, first + trees)]
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column(1).to_pylist(), object)
            for model in set(models.tolist()):
                mine = batch.take(pa.array(np.flatnonzero(models == model)))
                x, _ = _units(mine.column(2), dims)
                for t in range(trees):
                    # a model that the sample missed is small; it is one cell
                    cell = shared.value[model][t].cells(x) if model in shared.value else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(cell * (first + trees) + first + t)], ["id", "model", "code", "cell"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # the same blocks whatever order rows arrive in
        x, norm = _units(table.column("code"), dims)
        ids = np.asarray(table.column("id"))
        model = table.column("model")[0].as_py()
        out = []
        for rows in _blocks(x, block, np.random.default_rng(table.column("cell")[0].as_py())):  # each tree divides in its own way
            kk = min(k, len(rows) - 1)
            near, sims = _best(x, norm, rows, kk) if kk else (np.zeros((1, 0), np.int64), np.zeros((1, 0), np.float32))
            out.append(_batch(model, ids[rows], np.arange(len(rows)) * kk, ids[near.ravel()], sims.ravel()))
        return pa.Table.from_batches(out)

    cells = nodes.mapInArrow(assign, CODES + ", cell bigint")
    return cells.groupBy("model", "cell").applyInArrow(compare, LISTS)


def _scattered(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """Lists of about k arbitrary nodes each: four times the nodes fall by a hash into small groups."""
    size = k // 4 + 1
    found = []
    for salt in range(4):
        rows = nodes.select("id", "model", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, n // size))).alias("g"))
        flat = rows.groupBy("model", "g").agg(F.collect_list("id").alias("all")).select("model", "all", F.explode("all").alias("id"))
        near = F.filter("all", lambda x: x != F.col("id"))
        found.append(flat.select("id", "model", near.alias("near"), F.transform(near, lambda x: F.lit(UNSEEN).cast("float")).alias("sims")))
    return reduce(DataFrame.unionByName, found)


def _round(nodes: DataFrame, graph: DataFrame, k: int, sample: int, dims: int, parts: int) -> DataFrame:
    """New lists: the neighbours of one node, in both directions of a link, are compared with each other, where one of the two links is fresh."""
    head = graph.select(F.col("id").alias("v"), "model", F.arrays_zip(F.slice("near", 1, sample).alias("u"), F.slice("fresh", 1, sample).alias("new")).alias("to"))
    picked = graph.select("id", "model", F.explode(F.arrays_zip(F.slice("near", 1, sample).alias("u"), F.slice("sims", 1, sample).alias("s"), F.slice("fresh", 1, sample).alias("new"))).alias("e"))
    back = picked.select(F.col("e.u").alias("v"), "model", F.col("id").alias("u"), F.col("e.s").alias("s"), F.col("e.new").alias("new"))
    place = F.row_number().over(W.partitionBy("v", "model").orderBy(F.desc("s"), "u"))
    from_ = back.withColumn("p", place).filter(F.col("p") <= sample).groupBy("v", "model").agg(F.collect_list(F.struct("u", "new")).alias("from"))
    both = head.join(from_, ["v", "model"], "left").select("v", "model", F.concat("to", F.coalesce("from", F.array().cast("array<struct<u:bigint,new:boolean>>"))).alias("all"))
    # a link known in both directions stays once, unless only one of them is fresh
    edges = both.filter(F.array_contains("all.new", True)).select("v", "model", F.explode(F.array_distinct("all")).alias("e")).select("v", "model", "e.u", "e.new")
    # what travels with a neighbour: its code and the similarity it must beat
    weakest = F.when(F.size("near") >= k, F.element_at("sims", -1)).otherwise(F.lit(UNSEEN).cast("float"))
    state = graph.select(F.col("id").alias("u"), "model", weakest.alias("floor"))
    node = nodes.withColumnRenamed("id", "u").join(state, ["u", "model"])
    sent = edges.join(node, ["u", "model"]).select("v", "u", "model", "code", "floor", "new").repartition(parts, "v")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = {c: pa.concat_arrays([b.column(c) for b in held]) for c in held[0].schema.names}
        coded = table["model"].dictionary_encode()
        of, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        v, u, floor, new = (np.asarray(table[c]) for c in ("v", "u", "floor", "new"))
        x, norm = _units(table["code"], dims)
        order = np.lexsort((u, v, of))
        bounds = np.flatnonzero(np.concatenate(([True], (v[order][1:] != v[order][:-1]) | (of[order][1:] != of[order][:-1]))))
        sizes = np.diff(np.concatenate((bounds, [len(order)])))
        found: list[list[np.ndarray]] = [[], [], [], []]
        for g in np.unique(sizes):  # groups of one size are compared in one product
            starts = bounds[sizes == g]
            step = max(1, (1 << 21) // (g * max(g, dims)))
            for lo in range(0, len(starts) if g > 1 else 0, step):
                rows = order[starts[lo : lo + step, None] + np.arange(g)[None, :]]
                s = np.matmul(x[rows], x[rows].transpose(0, 2, 1))
                better = (s > floor[rows][:, :, None] - 1e-6) & (new[rows][:, :, None] | new[rows][:, None, :])
                better &= u[rows][:, :, None] != u[rows][:, None, :]
                at, i, j = np.nonzero(better)
                first, second = rows[at, i], rows[at, j]
                for into, values in zip(found, (of[first], u[first], u[second], _settled(s[at, i, j], norm[first], norm[second])), strict=True):
                    into.append(values)
        if not found[0]:
            return
        m, a, b, s = map(np.concatenate, found)
        for c in np.unique(m):
            mine = m == c
            ids, starts, near, sims, _ = _top(a[mine], b[mine], s[mine], k)
            yield _batch(names[c], ids, starts, near, sims)

    return sent.mapInArrow(local, LISTS)


def neighbour_graph(nodes: DataFrame, k: int, dims: int, trees: int = 8, block: int = 800, sample: int = 8, rounds: int = 2, trace: list | None = None) -> DataFrame:
    """(id, model, near, sims, fresh): for every node (id, model, code) the k most similar of its model, best first, by NN-descent.

    Start: `trees` independent divisions into blocks of about `block` nodes, by pivots from a bounded sample (SAMPLE rows) and, inside
    a cell, from the cell itself; with trees=0, arbitrary nodes. Rounds: up to `sample` neighbours of every node and up to as many
    nodes that have it as neighbour are compared among themselves where a link is fresh; they stop early when hardly any list
    changes. Nodes alone in their model get empty lists. Equal similarities are ordered by id. sims are those of
    the codes. `trace` receives the graph after the start and after each round, which are then kept.
    """
    n = nodes.count()
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    graph = None

    def step(news: DataFrame) -> DataFrame:
        merged = written(_merge(graph, news, k, parts))
        if graph is not None and trace is None:
            release(graph)
        return merged

    if trees:
        # chosen by hash, so each task sends its share only; the limit makes the bound strict
        part = F.pmod(F.xxhash64("id", "model"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
        chosen = sorted(nodes.filter(part).limit(2 * SAMPLE).collect(), key=lambda r: (r.id * 0x9E3779B97F4A7C15 % (1 << 64), r.model))
        for first in range(0, trees, WAVE):
            graph = step(_tree_lists(nodes, chosen, n, first, min(WAVE, trees - first), k, dims, block))
        if trees > WAVE:  # links of every wave are fresh to the first round
            folder, graph = graph._written, graph.withColumn("fresh", F.transform("near", lambda x: F.lit(True)))
            graph._written = folder
    else:
        graph = step(_scattered(nodes, n, k))
    if trace is not None:
        trace.append(graph)
    for number in range(1, rounds + 1):
        graph = step(_round(nodes, graph, k, sample, dims, parts))
        if trace is not None:
            trace.append(graph)
        if number < rounds and graph.agg(F.coalesce(F.sum(F.size(F.filter("fresh", lambda x: x))), F.lit(0)).alias("c")).first().c < STILL * n * k:
            break
    if not trees:  # links never compared do not come out
        kept = F.filter(F.arrays_zip("near", "sims", "fresh"), lambda x: x["sims"] > UNSEEN)
        graph = graph.withColumn("kept", kept).select("id", "model", *[F.col(f"kept.{c}").alias(c) for c in ("near", "sims", "fresh")])
    return graph


def _exact(pairs: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, model_col: str | None, dims: int, keep_model: bool = False) -> DataFrame:
    """(id_a, id_b, similarity[, model]) of pairs(a, b, model): cosines of the original vectors in double precision."""
    model = F.coalesce(F.col(model_col).cast("string"), F.lit(NO_MODEL)) if model_col else F.lit("")
    raw = vectors.select(F.col(id_col).cast("bigint").alias("id"), model.alias("model"), F.col(vec_col).alias("v"))
    raw = raw.filter((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "model").distinct()
    used = raw.join(ends, ["id", "model"], "left_semi").groupBy("id", "model").agg(F.min("v").alias("v"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    joined = pairs
    for end in ("a", "b"):
        joined = joined.join(used.select(F.col("id").alias(end), "model", F.col("v").alias(f"{end}_v")), [end, "model"])
    cosine = dot(F.col("a_v"), F.col("b_v")) / F.sqrt(dot(F.col("a_v"), F.col("a_v")) * dot(F.col("b_v"), F.col("b_v")))
    return joined.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), cosine.alias("similarity"), *(["model"] if keep_model else []))


def similar_pairs(
    vectors: DataFrame, threshold: float = 0.9, partners: int = 9, id_col: str = "chunk_id", vec_col: str = "embedding", model_col: str | None = "model", dims: int = 64,
    trees: int = 8, block: int = 800, sample: int = 6, rounds: int = 2, copies_apart: bool = False,
) -> DataFrame:
    """(id_a, id_b, similarity), a < b: pairs of different ids of one model with cosine of at least `threshold`.

    Candidates come from the neighbour graph; each is then checked on the original vectors. Ids of equal codes are one node of the graph. By
    default their pairs are written out, which suits tables where groups of copies are small; with `copies_apart` pairs are between
    the smallest ids of such groups, and every other id comes out once, with the smallest of its group. `partners` is how many a vector is
    expected to have: lists are one longer, and where a list is full of partners all the same, the graph is built anew with lists twice
    as long, until none is. Unusable vectors (see vector_codes) are in no pair. Repeated rows give each pair once per model. An empty
    table gives an empty result.
    """
    codes = written(vector_codes(vectors, id_col, vec_col, model_col, dims))
    nodes, copies = code_classes(codes)
    k = partners + 1
    while True:
        graph = neighbour_graph(nodes, k, dims, trees, block, sample, rounds)
        if graph.filter((F.size("near") == k) & (F.element_at("sims", -1) >= threshold - MARGIN)).isEmpty():
            break
        release(graph)
        k *= 2
    near = graph.select("id", "model", F.explode(F.arrays_zip("near", "sims")).alias("e")).filter(F.col("e.sims") >= threshold - MARGIN)
    pairs = near.select(F.least("id", "e.near").alias("a"), F.greatest("id", "e.near").alias("b"), "model").distinct()
    copies = written(copies)
    if copies_apart:
        pairs = pairs.unionByName(copies.select(F.col("node").alias("a"), F.col("id").alias("b"), "model"))
    else:
        held = copies.unionByName(copies.select(F.col("node").alias("id"), "model", "node").distinct())
        for end in ("a", "b"):
            group = held.select(F.col("node").alias(end), "model", F.col("id").alias("of"))
            pairs = pairs.join(group, [end, "model"], "left").withColumn(end, F.coalesce("of", end)).drop("of")
        inside = held.select(F.col("id").alias("a"), "model", "node").join(held.select(F.col("id").alias("b"), "model", "node"), ["model", "node"]).filter("a < b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "model").unionByName(inside.select("a", "b", "model"))
    return _exact(written(pairs), vectors, id_col, vec_col, model_col, dims).filter(F.col("similarity") >= threshold)


def _scored(rows: DataFrame, nodes: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """(qid, model, node, sim) of (qid, model, node): the codes of both sides are brought together and multiplied in batches."""
    sides = rows.join(nodes.select(F.col("id").alias("node"), "model", "code"), ["node", "model"])
    sides = sides.join(broadcast_if_small(queries.select("qid", "model", F.col("code").alias("asked")), 160), ["qid", "model"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = np.einsum("ij,ij->i", _units(b.column(3), dims)[0], _units(b.column(4), dims)[0])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sims, pa.float32())], ["qid", "model", "node", "sim"])

    return sides.select("qid", "model", "node", "code", "asked").mapInArrow(multiply, "qid bigint, model string, node bigint, sim float")


def graph_search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, dims: int, beam: int = 64, width: int = 8, steps: int = 64) -> DataFrame:
    """(qid, model, node, sim, place): the k most similar nodes for queries(qid, model, code), by greedy search on the graph.

    Every query keeps its `beam` best nodes. Each step opens the `width` best unopened ones of all queries at once: their neighbours, and
    the nodes that have them as neighbour, are compared with the query. It ends when no query has an unopened node left; `steps`
    bounds it, and RuntimeError says if it was too small. A query that is a node itself enters at that node; others enter at the
    nodes of a bounded sample that are most similar to them. A query that is in the collection finds itself too.
    """
    n = max(1, nodes.count())
    spark = nodes.sparkSession
    asked = written(queries.select("qid", "model", "code"))
    own = asked.join(nodes.select(F.col("id").alias("node"), "model", "code"), ["model", "code"]).select("qid", "model", "node")
    held = written(own.select("qid", "model", "node", F.lit(1.0).cast("float").alias("sim"), F.lit(False).alias("opened")))
    outside = asked.join(own.select("qid", "model"), ["qid", "model"], "left_anti")
    if not outside.isEmpty():
        part = F.pmod(F.xxhash64("id", "model"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / 4 / n) * (1 << 30))
        by: dict[str, list] = {}
        for r in nodes.filter(part).limit(SAMPLE).collect():
            by.setdefault(r.model, []).append(r)
        shared = spark.sparkContext.broadcast({m: (np.array([r.id for r in rows]), _units(pa.array([bytes(r.code) for r in rows]), dims)[0]) for m, rows in by.items()})

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                models = np.array(b.column(1).to_pylist(), object)
                for model in set(models.tolist()) & shared.value.keys():
                    mine = b.take(pa.array(np.flatnonzero(models == model)))
                    ids, at = shared.value[model]
                    m = min(max(1, beam // 2), len(ids))
                    s = _units(mine.column(2), dims)[0] @ at.T
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    qid = np.repeat(np.asarray(mine.column(0)), m)
                    columns = [pa.array(qid), pa.array([model] * len(qid), pa.string()), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(s, best, axis=1).ravel(), pa.float32())]
                    yield pa.RecordBatch.from_arrays(columns, ["qid", "model", "node", "sim"])

        entered = outside.mapInArrow(enter, "qid bigint, model string, node bigint, sim float").withColumn("opened", F.lit(False))
        held = written(held.unionByName(entered))
    forth = graph.select(F.col("id").alias("node"), "model", F.explode("near").alias("to"))
    place = F.row_number().over(W.partitionBy("qid", "model").orderBy(F.desc("sim"), "node"))
    for _ in range(steps):
        opening = written(held.filter("not opened").withColumn("p", place).filter(F.col("p") <= width).select("qid", "model", "node"))
        if opening.isEmpty():
            break
        far = broadcast_if_small(opening, 64)
        out = forth.join(far, ["node", "model"]).select("qid", "model", F.col("to").alias("node"))
        back = forth.join(far.withColumnRenamed("node", "to"), ["to", "model"]).select("qid", "model", "node")
        found = out.unionByName(back).distinct().join(held.select("qid", "model", "node"), ["qid", "model", "node"], "left_anti")
        new = _scored(found, nodes, asked, dims).withColumn("opened", F.lit(False))
        kept = held.join(opening.withColumn("now", F.lit(True)), ["qid", "model", "node"], "left")
        kept = kept.select("qid", "model", "node", "sim", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        last, held = held, written(kept.unionByName(new).withColumn("p", place).filter(F.col("p") <= beam).drop("p"))
        release(last)
        release(opening)
    else:
        if not held.filter("not opened").isEmpty():
            raise RuntimeError("the search did not end within `steps`")
    return held.withColumn("place", place).filter(F.col("place") <= k).select("qid", "model", "node", "sim", "place")


def nearest_by_graph(
    vectors: DataFrame, wanted: str, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", model_col: str | None = "model", dims: int = 64,
    lists: int = 16, trees: int = 8, block: int = 800, sample: int = 8, rounds: int = 2, beam: int = 64, width: int = 16,
) -> DataFrame:
    """(id, model, near, sim, place): about the k most similar of its model for every usable vector that meets `wanted`, a condition on id.

    Greedy search on the NN-descent graph of the whole collection; the best of what it finds are compared again on the original vectors.
    Vectors of equal codes are found together. Ties are ordered by id. Recall depends on the settings and is not promised; see nearest_exact.
    """
    codes = written(vector_codes(vectors, id_col, vec_col, model_col, dims))
    nodes, copies = code_classes(codes)
    graph = neighbour_graph(nodes, lists, dims, trees, block, sample, rounds)
    queries = codes.filter(wanted).withColumnRenamed("id", "qid")
    hits = graph_search(graph, nodes, queries, k + max(2, k // 2), dims, beam, width)
    copies = written(copies)
    beside = hits.join(copies.withColumnRenamed("id", "other"), ["node", "model"]).select("qid", "model", F.col("other").alias("node"))
    pairs = hits.select("qid", "model", "node").unionByName(beside).filter("qid <> node").select(F.col("qid").alias("a"), F.col("node").alias("b"), "model")
    found = _exact(written(pairs), vectors, id_col, vec_col, model_col, dims, keep_model=True)
    place = F.row_number().over(W.partitionBy("id_a", "model").orderBy(F.desc(F.round("similarity", 12)), "id_b"))
    named = F.when(F.col("model") != NO_MODEL, F.col("model"))
    out = found.withColumn("place", place).filter(F.col("place") <= k)
    return out.select(F.col("id_a").alias("id"), named.alias("model"), F.col("id_b").alias("near"), F.col("similarity").alias("sim"), "place")


def nearest_exact(vectors: DataFrame, wanted: str, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", model_col: str | None = "model", dims: int = 64) -> DataFrame:
    """(id, model, near, sim, place): the k most similar of its model for every usable vector that meets `wanted`, a condition on id.

    Every wanted vector is compared with every vector of its model, so nothing is missed and the work is their product. The wanted
    ones are broadcast, QUERY_ROWS at a time; each task keeps k per wanted vector. A float32 product picks whatever could be
    among them, which float64 then decides; similarities equal in 12 places are ordered by id. Unit vectors are kept in float32, so places may
    differ where similarities do by less than about 1e-8. Unusable vectors (see vector_codes) are left out; if rows of one id disagree, the one of the smallest unit vector in bytes counts.
    """
    model = F.col(model_col).cast("string") if model_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), model.alias("model"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(2), dims)
            if len(at):
                keep = pa.array(at)
                units = pa.Array.from_buffers(pa.binary(4 * dims), len(at), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), units], ["id", "model", "unit"])

    units = durable(rows.mapInArrow(unit, "id bigint, model string, unit binary").groupBy("id", "model").agg(F.min("unit").alias("unit")))
    n, asked = units.count(), units.filter(wanted).count()
    sc = units.sparkSession.sparkContext
    slices = units.coalesce(max(2 * sc.defaultParallelism, -(-n // SCAN_ROWS)))
    passes = max(1, -(-asked // QUERY_ROWS))
    place = F.row_number().over(W.partitionBy("id", "model").orderBy(F.desc("sim"), "near"))
    found = []
    for number in range(passes):
        by: dict[str | None, tuple[list[int], list[bytes]]] = {}
        for r in units.filter(wanted).filter(F.pmod(F.xxhash64("id", "model"), F.lit(passes)) == number).collect():
            ids, held = by.setdefault(r.model, ([], []))
            ids.append(r.id)
            held.append(bytes(r.unit))
        queries = {m: (np.array(ids, np.int64), np.frombuffer(b"".join(held), np.float32).reshape(-1, dims)) for m, (ids, held) in by.items()}
        shared = sc.broadcast(queries)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            # per model: the best so far as (query row, id, similarity), and what a similarity must reach
            best = {m: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for m in shared.value}
            floor = {m: np.full(len(ids), -2.0) for m, (ids, _) in shared.value.items()}
            for batch in batches:
                models = np.array(batch.column(1).to_pylist(), object)
                for m in set(models.tolist()) & shared.value.keys():
                    at = np.flatnonzero([x == m for x in models])
                    ids = np.asarray(batch.column(0))[at]
                    x = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.float32).reshape(-1, dims)
                    qids, q = shared.value[m]
                    new = [best[m]]
                    step = max(1, (1 << 21) // len(ids))
                    for lo in range(0, len(qids), step):
                        s = q[lo : lo + step] @ x.T
                        least = floor[m][lo : lo + step]
                        if len(ids) > k + 1 and (least == -2).any():  # one place more, for a vector finds itself
                            least = np.maximum(least, np.partition(s, -k - 1, axis=1)[:, -k - 1])
                        i, j = np.nonzero(s >= (least - SLIP)[:, None])
                        i += lo
                        i, j = (a[qids[i] != ids[j]] for a in (i, j))
                        exact = np.concatenate([np.einsum("ij,ij->i", q[i[c : c + 65536]].astype(float), x[j[c : c + 65536]].astype(float)) for c in range(0, len(i), 65536)] or [np.zeros(0)])
                        top, starts, near, sims, _ = _top(i, ids[j], np.round(exact, 12), k)  # many equal vectors must not pile up
                        new.append((np.repeat(top, np.diff(np.concatenate((starts, [len(near)])))), near, sims))
                    top, starts, near, sims, _ = _top(*(np.concatenate(a) for a in zip(*new, strict=True)), k)
                    sizes = np.diff(np.concatenate((starts, [len(near)])))
                    best[m] = (np.repeat(top, sizes), near, sims)
                    full = sizes == k
                    floor[m][top[full]] = sims[starts[full] + k - 1]
            for m, (i, near, sims) in best.items():
                for c in range(0, len(i), 65536):
                    part = slice(c, c + 65536)
                    columns = [pa.array(shared.value[m][0][i[part]]), pa.array([m] * len(i[part]), pa.string()), pa.array(near[part]), pa.array(sims[part])]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "model", "near", "sim"])

        hits = slices.mapInArrow(scan, "id bigint, model string, near bigint, sim double")
        found.append(durable(hits.withColumn("place", place).filter(F.col("place") <= k)))
        shared.unpersist()
    return reduce(DataFrame.unionByName, found)
