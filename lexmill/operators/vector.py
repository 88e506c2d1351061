"""Vector search of a stated query set against all rows: exact in blocks, or through cells of an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, PART = 256, 4096  # queries of a block, corpus rows of a part, about
#: Vectors the cells of an index are fitted on, and the most cells: both bound what the driver holds.
SAMPLE, CELLS = 8192, 1024


def cosine_hits(corpus: DataFrame, queries: DataFrame, k: int | None = None, within: float | None = None, by: str = "uid") -> DataFrame:
    """(query_id, uid, grp, distance): for each query and part of the corpus its nearest ``k`` values
    of ``by``, or everything within a distance.

    ``corpus``: uid, grp, vec; ``queries``: query_id, grp, vec. Every query block meets every corpus
    part in a task of its own: the work is one dense product of bounded size, nothing is broadcast,
    and no part keeps more than k rows a query. Null and zero vectors and those of another length
    than the query's are no hits. With ``by='grp'`` the nearest row stands for its group; ``within``
    leaves out rows of the query's own group."""
    corpus, queries = _known(corpus, queries)
    # The blocks and parts are hash groups of bounded mean size; two counts and no rows reach the driver.
    blocks, parts = max(1, -(-queries.count() // BLOCK)), max(1, -(-corpus.count() // PART))
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = corpus.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return _met(c, q, ["block", "part"], k, within, by)


def _known(corpus: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    corpus = corpus.where("uid IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").select("uid", "grp", "vec")
    return corpus, queries.where("query_id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0").select("query_id", F.col("grp").alias("q_grp"), F.col("vec").alias("q_vec"))


def _met(corpus: DataFrame, queries: DataFrame, keys: list[str], k: int | None, within: float | None, by: str) -> DataFrame:
    """The hits of the queries and rows that share their ``keys``, group by group."""
    ids, asked = dict(corpus.dtypes), dict(queries.dtypes)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        right = right.sort_values("uid", kind="stable")
        for size, qs in left.groupby(left["q_vec"].map(len)):
            cs = right[right["vec"].map(len) == size]
            if cs.empty:
                continue
            a, b = np.stack(qs["q_vec"].to_numpy()).astype(float), np.stack(cs["vec"].to_numpy()).astype(float)
            norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                distances = 1 - (a @ b.T) / norms
            grp = pd.factorize(cs["grp"], use_na_sentinel=False)
            for i, (query, own) in enumerate(zip(qs["query_id"], qs["q_grp"])):
                found.append((query, cs, *_nearest(distances[i], grp[0], (grp[1] == own)[grp[0]] if within is not None else None, k, within, by)))
        columns = ["query_id", "uid", "grp", "distance"]
        out = [pd.DataFrame({"query_id": [q] * len(at), "uid": cs["uid"].to_numpy()[at], "grp": cs["grp"].to_numpy()[at], "distance": d}) for q, cs, at, d in found if len(at)]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    schema = f"query_id {asked['query_id']}, uid {ids['uid']}, grp {ids['grp']}, distance double"
    return queries.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInPandas(run, schema)


def _nearest(d: np.ndarray, grp: np.ndarray, own: np.ndarray | None, k: int | None, within: float | None, by: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the nearest rows, ties in the order of the rows; of a group only its first."""
    near = np.round(d, 9)
    near[np.isnan(near)] = np.inf
    if within is not None:
        near[(near > within) | own] = np.inf
    if by == "grp":
        order = np.lexsort((near, grp))
        first = order[np.r_[True, grp[order][1:] != grp[order][:-1]]] if len(order) else order
        at = first[np.isfinite(near[first])]
    else:
        at = np.flatnonzero(np.isfinite(near))
    if k is not None and len(at) > k:
        at = at[near[at] <= np.partition(near[at], k - 1)[k - 1]]
    at = at[np.lexsort((at, near[at]))]
    at = at if k is None else at[:k]
    return at, d[at]


def fit_cells(corpus: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids of ``cells`` cells, by spherical k-means over at most ``sample`` vectors: those of
    least hash. Only this bounded sample reaches the driver."""
    rows = corpus.where("vec IS NOT NULL AND size(vec) > 0 AND uid IS NOT NULL").select(F.xxhash64(F.lit(5), "uid").alias("h"), "vec").orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    width = max(len(r["vec"]) for r in rows)
    x = np.array([r["vec"] for r in rows if len(r["vec"]) == width], float).reshape(-1, width)
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    if not len(x):
        return np.zeros((0, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x), CELLS)).astype(int)]
    for _ in range(rounds):
        nearest = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centre)
    return centre


def indexed_hits(corpus: DataFrame, queries: DataFrame, k: int, cells: int, probes: int, by: str = "uid") -> DataFrame:
    """Like ``cosine_hits`` with ``k``, but a query only meets the rows of its ``probes`` nearest cells.

    The cells are fitted on a bounded sample; every row is indexed, in the cell of its nearest centroid, and
    every distance is exact, so only rows of cells not probed are missed: recall is to be measured against
    ``cosine_hits``. Cells of more than PART rows are cut into parts, so none is one task. Vectors of another
    length than the centroids', and zero ones, are in no cell."""
    corpus, queries = _known(corpus, queries)
    spread = corpus.sparkSession.sparkContext.broadcast(fit_cells(corpus, cells))

    def nearest(column: str, n: int):
        @F.pandas_udf("array<int>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            centre = spread.value
            for batch in batches:
                out: list[list[int]] = [[]] * len(batch)
                fit = [i for i, v in enumerate(batch) if len(v) == centre.shape[1] and np.any(v)] if len(centre) else []
                if fit:
                    score = np.stack([np.asarray(batch.iloc[i], float) for i in fit]) @ centre.T
                    for i, row in zip(fit, np.argsort(-score, axis=1, kind="stable")[:, :n]):
                        out[i] = row.tolist()
                yield pd.Series(out)

        return F.explode(find(column))

    c = corpus.withColumn("cell", nearest("vec", 1))
    sizes = c.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / PART)).cast("int").alias("parts"))  # at most CELLS rows
    c = c.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
    q = queries.withColumn("cell", nearest("q_vec", probes)).join(F.broadcast(sizes), "cell")
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return _met(c, q, ["cell", "part"], k, None, by)


def dense_top(corpus: DataFrame, queries: DataFrame, k: int, roll_up: bool, index: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, uid, score, rank): nearest rows, or with ``roll_up`` nearest groups by their nearest
    row; score is 1 - distance, ties by identifier. ``index``: (cells, probes), else the search is exact."""
    from lexmill.operators.lexical import top_k

    by = "grp" if roll_up else "uid"
    hits = indexed_hits(corpus, queries, k, *index, by=by) if index else cosine_hits(corpus, queries, k, by=by)
    uid = F.col("grp") if roll_up else F.col("uid")
    best = hits.groupBy("query_id", uid.alias("uid")).agg(F.min(F.round("distance", 9)).alias("d"))
    return top_k(best.select("query_id", "uid", (1 - F.col("d")).alias("score")), k)


def near_groups(corpus: DataFrame, queries: DataFrame, within: float, cap: int) -> DataFrame:
    """(query_id, near): other groups with a row within the distance, counted up to ``cap``.

    The count saturates because it reports a bounded list; the search itself leaves nothing out."""
    hits = cosine_hits(corpus, queries, within=within, by="grp").select("query_id", "grp").distinct()
    counts = hits.groupBy("query_id").agg(F.least(F.count("*"), F.lit(cap)).alias("near"))
    return queries.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", F.coalesce("near", F.lit(0)).alias("near"))
