"""A stored vector index: a two-level tree of centres over lists of quantised rows.

Centres are rows drawn by a hash of their id, one in ``leaf``; one in the square root of
their number is a root. A row belongs to its nearest root and, below it, to the nearest
centre; it is kept as the product-quantised difference from that centre, next to its own
vector. Only the roots (about ``sqrt(rows / leaf)`` of them) and the code books are held
by the driver and the tasks; a task holds the centres of one root, or one part of one
list, at a time. So the number of cells follows the number of rows, and rows can be
added: the new rows' draws become centres of their own, older rows stay where they are.

A search goes down the tree: a query meets the centres of its nearest roots, keeps the
cells nearest to it, meets their lists, keeps the best ``shortlist`` rows by quantised
distance, and those are ranked by true distances. Nothing meets in one place but one
root's centres or one part of a list with the queries that probe it, which stream by.

For inner products vectors get one more coordinate that makes all of them equally long,
so that the largest product is the nearest row; a query has 0 there. An added row longer
than all before it counts as that long in the tree; true scores are not affected.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import work_path, written
from ..sources import tables

LEAF = 500  # fixed value: rows of a list
SAMPLE = 20_000  # rows that the code books are fitted on, at most
WORDS = 256  # entries of a code book
ROUNDS = 12  # of fitting a code book
PART = 4096  # rows of a list that one task holds
ROWS = 1024  # rows that stream by at once
TILE = 16_384  # rows of lists, or queries, that meet in one task
CHUNK = 128  # queries whose distances to a tile are held at once


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _vectors(rows: np.ndarray) -> pa.Array:
    return pa.array(list(np.ascontiguousarray(rows, dtype=np.float64)), pa.list_(pa.float64()))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


@dataclass
class CodeBooks:
    """A book of ``WORDS`` words for each run of coordinates."""

    books: list[np.ndarray]
    edges: list[int] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: np.ndarray, parts: int, seed: int = 0) -> CodeBooks:
        edges = np.linspace(0, rows.shape[1], min(parts, rows.shape[1]) + 1).astype(int).tolist()
        draw = np.random.default_rng(seed)
        books = []
        for a, b in zip(edges, edges[1:]):
            part = rows[:, a:b]
            words = part[draw.permutation(len(part))[:WORDS]].copy()
            for _ in range(ROUNDS):
                own = distances(part, words).argmin(1)
                n = np.bincount(own, minlength=len(words))
                sums = np.zeros_like(words)
                np.add.at(sums, own, part)
                words[n > 0] = sums[n > 0] / n[n > 0, None]
            books.append(words)
        return cls(books, edges)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([distances(rows[:, a:b], w).argmin(1) for a, b, w in zip(self.edges, self.edges[1:], self.books)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, i]] for i, w in enumerate(self.books)], 1)


def _meet(held: DataFrame, streamed: DataFrame, keys: list[str], score: Callable, schema: str) -> DataFrame:
    """Rows of ``held`` and ``streamed`` (columns ``keys``, ``id``, ``vec`` and, if any, ``extra`` binary) with
    equal keys meet: ``score(held ids, held matrix, held extras, streamed ids, streamed matrix, streamed extras)``
    gives columns of ``schema``. Held rows of a key are in memory, streamed ones pass in batches."""
    columns = [*keys, "_side", "id", "vec", "extra"]

    def sided(df: DataFrame, side: int) -> DataFrame:
        df = df if "extra" in df.columns else df.withColumn("extra", F.lit(None).cast("binary"))
        return df.withColumn("_side", F.lit(side)).select(*columns)

    both = sided(held, 0).unionByName(sided(streamed, 1))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, extras, ready = None, [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(k)) for k in (*keys, "_side")], 1)
            edges = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                own, side = tuple(key[a, :-1].tolist()), key[a, -1]
                if own != at:
                    at, ids, vecs, extras, ready = own, [], [], [], None
                for low in range(a, b, ROWS):
                    part = batch.slice(low, min(ROWS, b - low))
                    if side == 0:
                        ids.append(np.asarray(part.column("id")))
                        vecs.append(_matrix(part.column("vec")))
                        extras += part.column("extra").to_pylist()
                        continue
                    if not ids:  # nothing to meet
                        continue
                    if ready is None:
                        ready = np.concatenate(ids), np.concatenate(vecs), extras
                    out = score(*ready, np.asarray(part.column("id")), _matrix(part.column("vec")), part.column("extra").to_pylist())
                    if len(out[0]):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    return both.repartition(*keys).sortWithinPartitions(*keys, "_side").select(*columns).mapInArrow(run, schema)


class VectorIndex:
    """An index stored under ``path``; see :func:`build` and :func:`load`."""

    def __init__(self, spark: SparkSession, path: str, facts: dict):
        self.spark, self.path, self.facts = spark, path, facts
        self.roots = np.array(facts["roots"])
        self.books = CodeBooks([np.array(b) for b in facts["books"]], facts["edges"])

    # Tables: ``cells`` (root, id, vec) and ``lists`` (root, cell, part, id, vec, codes).

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _lifted(self, df: DataFrame, query: bool = False) -> DataFrame:
        """``id, vec`` with the coordinate that makes lengths equal."""
        if self.facts["metric"] != "dot":
            return df.select("id", "vec")
        square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
        more = F.lit(0.0) if query else F.sqrt(F.greatest(F.lit(self.facts["longest"]) - square, F.lit(0.0)))
        return df.select("id", F.concat("vec", F.array(more)).alias("vec"))

    def _rooted(self, df: DataFrame) -> DataFrame:
        roots = self.roots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = distances(_matrix(batch.column("vec")), roots).argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *batch.columns], ["root", "id", "vec"])

        return df.mapInArrow(run, "root bigint, id bigint, vec array<double>")

    def _salted(self, held: DataFrame, streamed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Large keys of ``streamed`` in several tasks, each with a copy of what is held: at most one
        copy per PART * 16 rows that meet it."""
        sizes = streamed.groupBy(key).agg(F.ceil(F.count("*") / (PART * 16)).cast("int").alias("_n"))
        held = held.join(sizes, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        large = F.broadcast(sizes.where("_n > 1"))  # at most a row per PART * 16 rows
        streamed = streamed.join(large, key, "left").withColumn(
            "salt", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
        return held, streamed

    def _assigned(self, rooted: DataFrame, cells: DataFrame) -> DataFrame:
        """``root, cell, id, vec, diff``: each row with the nearest centre below its root."""
        def score(ids, centres, _, own_ids, own, __):
            nearest = distances(own, centres).argmin(1)
            return [np.zeros(len(own), np.int64), ids[nearest], own_ids, _vectors(own), _vectors(own - centres[nearest])]

        held, streamed = self._salted(cells.select("root", "id", "vec"), rooted, "root")
        found = _meet(
            held, streamed, ["root", "salt"], score,
            "root bigint, cell bigint, id bigint, vec array<double>, diff array<double>")
        return found.drop("root")

    def _listed(self, assigned: DataFrame) -> DataFrame:
        books, whole = self.books, self.facts["metric"] != "dot"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vec, codes = _matrix(batch.column("vec")), books.encode(_matrix(batch.column("diff")))
                    yield pa.RecordBatch.from_arrays([
                        batch.column("cell"), batch.column("id"), _vectors(vec if whole else vec[:, :-1]),
                        pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "vec", "codes"])

        return assigned.select("cell", "id", "vec", "diff").mapInArrow(
            run, "cell bigint, id bigint, vec array<double>, codes binary")

    def add(self, vectors: DataFrame, key: str = "id", vector: str = "embedding") -> VectorIndex:
        """Rows whose ids are not stored yet; their draws become centres."""
        new = _points(vectors, key, vector)
        if tables.exists(self.spark, f"{self.path}/lists"):
            new = new.join(self._table("lists").select("id"), "id", "left_anti")
        self._store(written(new, "added"))
        return self

    def _store(self, points: DataFrame) -> None:
        rooted = written(self._rooted(self._lifted(points)), "rooted")
        drawn = rooted.where(_drawn(self.facts["leaf"]))
        old = tables.exists(self.spark, f"{self.path}/cells")
        if not old:
            # A root with rows has a centre: its own row. Roots are drawn among the centres, or are the only one.
            own = self.spark.createDataFrame([(int(i),) for i in self.facts["root_ids"]], "id bigint")
            drawn = drawn.unionByName(rooted.join(F.broadcast(own), "id", "left_semi")).dropDuplicates(["id"])
        drawn.write.mode("append").parquet(f"{self.path}/cells")
        assigned = written(self._assigned(rooted, self._table("cells")), "assigned")
        if not self.facts["books"]:
            sample = assigned.select("id", "diff").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # at most SAMPLE rows
            self.books = CodeBooks.fit(np.array([r["diff"] for r in sample]), self.facts["parts"])
            self.facts |= {"books": [b.tolist() for b in self.books.books], "edges": self.books.edges}
            self.spark.createDataFrame([(json.dumps(self.facts),)], "facts string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/facts")
        self._listed(assigned).write.mode("append").parquet(f"{self.path}/lists")

    def _wanted(self, probes: int | None, share: float | None) -> tuple[np.ndarray, int]:
        """The cells of each root, and how many cells a query looks at."""
        counts = {r["root"]: r["n"] for r in self._table("cells").groupBy("root").agg(F.count("*").alias("n")).collect()}  # a row per root
        held = np.array([counts.get(i, 0) for i in range(len(self.roots))])
        return held, probes if share is None else max(1, int(np.ceil(share * held.sum())))

    def _probed(self, queries: DataFrame, probes: int | None, share: float | None) -> DataFrame:
        """``id, cell, vec`` of the cells that each query (lifted) looks at."""
        held, wanted = self._wanted(probes, share)
        roots = self.roots

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec = _matrix(batch.column("vec"))
                order = np.argsort(distances(vec, roots), axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                # Twice the cells wanted, in three roots at least: near ones can lie across a border.
                take = ((before < 2 * wanted) | (np.arange(len(roots)) < 3)) & (held[order] > 0)
                row, col = np.nonzero(take)
                for low in range(0, len(row), ROWS):
                    r, c = row[low:low + ROWS], col[low:low + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(order[r, c]), batch.column("id").take(pa.array(r)), _vectors(vec[r])], ["root", "id", "vec"])

        def score(ids, centres, _, own_ids, own, __):
            away = distances(own, centres)
            n = min(wanted, len(ids))
            near = np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(len(ids)), (len(own), 1))
            row = np.repeat(np.arange(len(own)), n)
            return [own_ids[row], ids[near.ravel()], away[row, near.ravel()]]

        pairs = queries.mapInArrow(down, "root bigint, id bigint, vec array<double>")
        held_, streamed = self._salted(self._table("cells").select("root", "id", "vec"), written(pairs, "root-probes"), "root")
        found = _meet(held_, streamed, ["root", "salt"], score,
                      "id bigint, cell bigint, away double")
        nearest = Window.partitionBy("id").orderBy("away", "cell")
        return found.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= wanted).select("id", "cell")

    def _tiled(self, kept: DataFrame, lifted: DataFrame, probes: int | None, share: float | None) -> tuple[DataFrame, DataFrame]:
        """Lists and queries by ``tile, salt``: many lists share a tile, and a query comes to a tile once, with the
        names of its cells there. One that looks at all cells needs none of them named. A tile has a copy for each
        salt of the queries."""
        held, wanted = self._wanted(probes, share)
        least = int(np.ceil((2 * self.spark.sparkContext.defaultParallelism) ** 0.5))  # so that all cores take part
        tiles, salts = (max(least, -(-df.count() // TILE)) for df in (kept, lifted))
        kept = kept.withColumn("tile", F.pmod(F.xxhash64("cell", "part"), F.lit(tiles)).cast("int"))

        def named(some: DataFrame) -> DataFrame:
            """A row for each tile; ids that repeat look at a cell as often as they are paired with it."""
            at = kept.select("cell", "tile").distinct()  # more than one for a list in parts
            asks = self._probed(some, probes, share).groupBy("id", "cell").agg(F.count("*").cast("int").alias("_n"))
            asks = asks.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).join(at, "cell")
            return asks.groupBy("id", "tile", "_copy").agg(
                F.array_join(F.collect_list(F.col("cell").cast("string")), " ").cast("binary").alias("extra")
            ).join(some, "id").select("tile", "id", "vec", "extra")

        if wanted >= held.sum():
            often = written(lifted.groupBy("id").count().where("count > 1").select("id"), "repeated")
            streamed = lifted.join(often, "id", "left_anti").select(
                F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "id", "vec", F.lit(None).cast("binary").alias("extra"))
            if not often.isEmpty():
                streamed = streamed.unionByName(named(lifted.join(often, "id", "left_semi")))
        else:
            streamed = named(lifted)
        kept = kept.withColumn("extra", F.col("cell").cast("string").cast("binary")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return kept.select("tile", "salt", "id", "vec", "extra"), streamed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = 32, share: float | None = None,
               shortlist: int | None = 100, key: str = "id", vector: str = "embedding", itself: bool = False) -> DataFrame:
        """``id, rank, neighbour, score`` for rows of ``queries``: the ``probes`` nearest cells (or that
        ``share`` of all) are looked at. The ``shortlist`` nearest rows by quantised distances are
        ranked by true ones; None ranks all rows of the cells by true ones. A row is no neighbour
        of its own id unless ``itself``."""
        asked = written(_points(queries, key, vector), "asked")
        lifted = self._lifted(asked, query=True)
        dot, top, books = self.facts["metric"] == "dot", self.facts["longest"], self.books
        lists = self._table("lists")
        parts = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("_rows") / PART))).cast("int")
        sizes = lists.groupBy("cell").agg(F.count("*").alias("_rows"))
        kept = lists.join(sizes, "cell").withColumn("part", parts)

        def ranked(ids, near, own_ids, score, rank, n):
            if not itself:
                rank = np.where(own_ids[:, None] == ids[None, :], np.inf, rank)
            limit = np.partition(rank, n - 1, axis=1)[:, n - 1:n] if n < len(ids) else np.full((len(own_ids), 1), np.finfo(float).max)
            row, col = np.nonzero((rank <= limit) & np.isfinite(rank))
            return [own_ids[row], ids[col], score[row, col], rank[row, col]]

        def exact(ids, rows, cells, own_ids, own, wanted):
            """Rows of the cells that a query names (null: of all), a few queries at a time."""
            names, place = np.unique(cells, return_inverse=True)
            out = []
            for low in range(0, len(own), CHUNK):
                at = slice(low, low + CHUNK)
                plain = own[at, :-1] if dot else own[at]
                unit = 1e-9 * np.maximum(np.sqrt((plain * plain).sum(1) * top) if dot else (plain * plain).sum(1) + top, 1e-300)
                score = plain @ rows.T if dot else distances(plain, rows)
                rank = np.round((-score if dot else score) / unit[:, None])
                if any(w is not None for w in wanted[at]):
                    asks = np.stack([np.isin(names, w.split()) if w is not None else np.ones(len(names), bool) for w in wanted[at]])
                    rank = np.where(asks[:, place], rank, np.inf)
                out.append(ranked(ids, rows, own_ids[at], score if dot else np.sqrt(score), rank, min(k, len(ids))))
            return [np.concatenate(c) for c in zip(*out)]

        def rough(ids, centre, codes, own_ids, own, __):
            rows = centre + books.decode(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1))
            away = distances(own, rows)
            return ranked(ids, rows, own_ids, away, away, shortlist)

        schema = "id bigint, neighbour bigint, score double, key double"
        if shortlist is None:
            found = _meet(*self._tiled(kept, lifted, probes, share), ["tile", "salt"], exact, schema)
        else:
            probe_rows = written(self._probed(lifted, probes, share).join(lifted, "id"), "cell-probes")
            streamed = probe_rows.join(sizes, "cell").withColumn(
                "part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_rows") / PART) - 1).cast("int"))))
            centres = self._table("cells").select(F.col("id").alias("cell"), F.col("vec").alias("centre"))
            coded = kept.select("cell", "part", "id", F.col("codes").alias("extra")).join(centres, "cell")
            near = _meet(coded.withColumnRenamed("centre", "vec"), streamed, ["cell", "part"], rough, schema)
            first = Window.partitionBy("id").orderBy("key", "neighbour")
            near = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= shortlist).select("id", "neighbour")
            true = near.join(lists.select(F.col("id").alias("neighbour"), F.col("vec").alias("other")), "neighbour").join(asked, "id")
            product = F.aggregate(F.zip_with("vec", "other", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
            apart = F.aggregate(F.zip_with("vec", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
            found = true.select("id", "neighbour", product.alias("score"), (-product).alias("key")) if dot else true.select(
                "id", "neighbour", F.sqrt(apart).alias("score"), apart.alias("key"))
        order = Window.partitionBy("id").orderBy("key", "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "score")


def _points(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec`` of rows with both."""
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(
        "id is not null and vec is not null")


def _drawn(one_in: int, seed: int = 1):
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, int(one_in)))) == 0


def build(vectors: DataFrame, path: str | None = None, leaf: int = LEAF, metric: str = "dot", parts: int = 16,
          key: str = "id", vector: str = "embedding") -> VectorIndex:
    """An index of all rows (distinct ids) of ``vectors`` under ``path``; ``parts`` bytes of code per row.
    An empty table has no index: ValueError."""
    spark = vectors.sparkSession
    path = path or work_path(spark, "vector-index")
    points = written(_points(vectors, key, vector), "points")
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    facts = points.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    if not facts["n"]:
        raise ValueError("no vectors to index")
    index = VectorIndex(spark, path, {
        "metric": metric, "longest": float(facts["longest"]), "leaf": int(leaf), "parts": parts, "roots": [], "books": [], "edges": []})
    one_in = max(1, round((facts["n"] / leaf) ** 0.5))
    lifted = index._lifted(points)
    roots = lifted.where(_drawn(leaf) & _drawn(one_in, 2)).collect()  # about sqrt(rows / leaf) rows
    roots = roots or lifted.orderBy(F.xxhash64("id"), "id").limit(1).collect()
    index.roots = np.array([r["vec"] for r in roots])
    index.facts |= {"roots": index.roots.tolist(), "root_ids": [r["id"] for r in roots]}
    index._store(points)
    return index


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index stored under ``path``."""
    return VectorIndex(spark, path, json.loads(spark.read.parquet(f"{path}/facts").first()["facts"]))
