"""Embedding near-duplicates in overlapping cluster shards, every pair of a shard compared.

Vectors are compared within one label only. Centres are fitted on a bounded sample (CENTRES rows of a label, ALL_CENTRES in all, at
most; a label of SHARD rows or fewer needs none); one within twice the link angle of another is dropped, so a group of near copies has one.
A vector's home is the shard of its nearest centre. It is also put in each shard whose home vectors could link with it: those whose
bisecting plane with its home lies within the link angle. So each link of a home vector lies in its shard. Where the sample says that
this would copy vectors more often than blocks do, the label is one shard.

Equal vectors are one node that counts its copies. A shard of more than CELL nodes is cut into blocks, and each pair of blocks of
which one has home vectors is a cell, so no task's memory grows with a hot cluster. In a cell each home vector is compared with all others
by the cosine in double precision. Finds never leave a task as pairs: of each vector its number of links, and of each cell's links a
spanning forest. Where the vectors of a label have no clusters that the bound can part, the work is that of all pairs of the label.

prune() and search() are the robust-pruned flat graph for callers that search vectors approximately; links are not taken from it, since a
pruned graph of bounded degree does not connect two dense groups and so loses links.

audit() measures recall against brute force over a stated query set.

Defined cases: vectors of different lengths are never compared; vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do null labels; repeated vec_ids are one row (the smallest vector by order); null vec_ids are left out; an empty table gives
no rows. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.llm.common import components, release, staged, table

LINK = 0.98
SINE = float(np.sqrt(1 - LINK * LINK))  # of the link angle
APART = 2 * LINK * LINK - 1  # the cosine of twice the link angle
CENTRES = 2048  # of a label at most
ALL_CENTRES = 1 << 15  # which bounds what is broadcast
SHARD = 600  # vectors to a centre
PROBES = 64  # further sampled vectors of a label, which say how often its vectors would be copied
DEGREE = 24
ALPHA = 1.2
BEAM = 16
NEAR = 64  # candidates that robust pruning looks at
CELL = 4000
SLAB = 512  # vectors of a cell that are compared with all of it at a time
SEED = 3


def centre_rows(nodes: DataFrame) -> DataFrame:
    """label, n, place, probe, unit: of each label of more than SHARD rows, those with the smallest seeded hashes, one for every SHARD rows.

    A label has CENTRES at most, all labels together ALL_CENTRES; a label that gets none is one shard, cut into cells by its size. As many
    rows again at most, PROBES of a label, are its probes.
    """
    counts = nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    most = min(CENTRES, ALL_CENTRES // max(1, counts.count()))
    # the bounded sample of each label comes from partial aggregates: one row of the smallest hash for each of 2 * CENTRES hash classes
    order = F.xxhash64("node", F.lit(SEED))
    least = nodes.join(counts, "label", "left_semi").withColumn("place", F.pmod(order, F.lit(2 * CENTRES))).groupBy("label", "place").agg(F.min(F.struct(order.alias("o"), F.col("unit"))).alias("r"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("r.o")))
    wanted = F.least(F.lit(most), F.ceil(F.col("n") / SHARD))
    rows = ranked.join(counts, "label").where(F.col("rank") <= wanted + min(PROBES, most))
    return rows.select("label", "n", F.col("rank").alias("place"), (F.col("rank") > wanted).alias("probe"), F.col("r.unit").alias("unit"))


def apart(c: np.ndarray) -> np.ndarray:
    """The centres without those within twice the link angle of one before them: no plane between two of these parts any links."""
    kept: list[int] = []
    for k in range(len(c)):
        if not kept or (c[kept] @ c[k]).max() < APART:
            kept.append(k)
    return c[kept]


def reach(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector its home, the nearest centre, and a mask of the centres whose home vectors may link with it.

    A partner at the link angle whose home is k lies beyond the plane between k and this vector's home, so this one lies before it by the
    sine of that angle at most.
    """
    sims = x @ c.T
    home = sims.argmax(axis=1)
    far = np.sqrt(np.maximum(2 - 2 * (c[np.unique(home)] @ c.T), 0))[np.unique(home, return_inverse=True)[1]]
    return home, sims[np.arange(len(x)), home][:, None] - sims <= SINE * far + 1e-9


def fitted(rows: list[tuple[int, bool, list[float]]]) -> np.ndarray | None:
    """A label's centres of its (n, probe, unit), or None where blocks copy its vectors less often than its shards would."""
    centres = np.array([u for _, probe, u in rows if not probe])
    probes = np.array([u for _, probe, u in rows if probe])
    centres = apart(centres) if len(centres) else centres
    if len(centres) < 2 or (len(probes) and reach(probes, centres)[1].sum(axis=1).mean() >= np.ceil(rows[0][0] / (CELL // 2))):
        return None
    return centres


def assign(nodes: DataFrame, centres: dict) -> DataFrame:
    """nodes with shards: the places of their shards, the home first. centres: of each label, a matrix."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # ALL_CENTRES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, units = np.array(batch["label"].to_pylist(), object), batch["unit"]
            out: list = [None] * batch.num_rows
            for label in sorted(set(labels)):
                at = np.flatnonzero(labels == label)
                c = shared.value.get(label)
                if c is None:
                    for i in at:
                        out[i] = [0]
                    continue
                home, near = reach(np.stack([units[int(i)].values.to_numpy() for i in at]), c)
                for i, h, row in zip(at, home.tolist(), near, strict=True):
                    out[i] = [h, *(k for k in np.flatnonzero(row).tolist() if k != h)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "shards"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema, T.StructField("shards", T.ArrayType(T.IntegerType()))]))


def prune(x: np.ndarray) -> list[np.ndarray]:
    """The robust-pruned adjacency of unit vectors: for each, at most DEGREE places."""
    n = len(x)
    out: list[np.ndarray] = []
    near = min(NEAR, n - 1)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        for k in range(len(sims)):
            if near < 1:
                out.append(np.empty(0, np.int64))
                continue
            c = np.argpartition(-sims[k], near - 1)[:near]
            c = c[np.argsort(-sims[k][c], kind="stable")]
            far = 1 - sims[k][c]  # half the squared distance
            between = 1 - x[c] @ x[c].T
            alive, kept = np.ones(len(c), bool), []
            for j in range(len(c)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == DEGREE:
                        break
                    alive &= ALPHA * ALPHA * between[j] > far
            out.append(c[kept])
    return out


def search(x: np.ndarray, edges: list[np.ndarray], q: int, start: int, link: float = LINK) -> np.ndarray:
    """Places whose cosine with vector q is link or more: greedy from start with a beam, then along the edges of all that is in range."""
    v = x[q]
    seen = np.zeros(len(x), bool)
    seen[[start, q]] = True
    best_at, best = np.array([start, q]), np.array([x[start] @ v, 1.0])
    done = np.zeros(len(x), bool)
    found = [q] if start == q else [q, *([start] if best[0] >= link else [])]
    todo = found[:]
    while True:
        # greedy: the best of the beam that has not been expanded
        open_ = np.flatnonzero(~done[best_at])
        if len(open_):
            step = best_at[open_[:4]]
        elif todo:
            step = np.array([t for t in todo if not done[t]], np.int64)
            todo = []
            if not len(step):
                continue
        else:
            return np.unique(np.array(found))
        done[step] = True
        new = np.unique(np.concatenate([edges[s] for s in step]))
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        s = x[new] @ v
        hit = new[s >= link].tolist()
        found += hit
        todo += hit
        best_at, best = np.concatenate([best_at, new]), np.concatenate([best, s])
        top = np.argsort(-best, kind="stable")[:BEAM]
        best_at, best = best_at[top], best[top]


def _matrix(units: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(u, np.float64) for u in units])


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each home vector of the cell its links in it, and of every vector its place in a spanning forest of those links."""
    pdf = pdf.sort_values("node", kind="stable")
    x, ids = _matrix(pdf["unit"]), pdf["node"].to_numpy()
    copies, block = pdf["copies"].to_numpy(), pdf["block"].to_numpy()
    two = int(pdf["cell_i"].iloc[0]) != int(pdf["cell_j"].iloc[0])
    root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    home = np.flatnonzero(pdf["home"].to_numpy())
    for a in range(0, len(home), SLAB):
        q = home[a : a + SLAB]
        hit = x[q] @ x.T >= LINK
        hit[np.arange(len(q)), q] = False
        if two:  # pairs within one block are another cell's
            hit &= block[q][:, None] != block
        for k in np.flatnonzero(hit.any(axis=1)).tolist():
            got = np.flatnonzero(hit[k])
            links[q[k]] = copies[got].sum()
            if (root[got] != root[q[k]]).any():
                joined = np.unique(np.append(root[got], root[q[k]]))
                root[np.isin(root, joined)] = joined[0]
    return pd.DataFrame({"node": ids, "links": links, "root": ids[root]})[(links > 0) | (root != np.arange(len(ids)))]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vec_id: n_links, component_id, kept."""
    size = F.size("e")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e"), F.col("label").cast("long").alias("label")).where("vec_id is not null")
    v = v.groupBy("vec_id").agg(F.min(F.struct("e", "label")).alias("r")).select("vec_id", "r.*")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, c: a + c * c))
    fine = F.col("e").isNotNull() & F.col("label").isNotNull() & (size > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # scaled by the largest component first, so that the squares neither vanish nor overflow
    v = v.withColumn("top", F.when(fine, F.array_max(F.transform("e", F.abs)))).withColumn("ok", F.col("top") > 0)
    scaled = v.withColumn("e", F.when(F.col("ok"), F.transform("e", lambda c: c / F.col("top")))).withColumn("norm", F.when(F.col("ok"), norm))
    unit = scaled.select("vec_id", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.transform("e", lambda c: c / F.col("norm"))).alias("unit"))
    unit = unit.withColumn("label", F.when(F.col("unit").isNotNull(), F.concat_ws(":", "label", F.size("unit"))))  # lengths differ: never compared
    rows = staged(unit, "emb-unit")
    nodes = staged(
        rows.where("unit is not null").groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "emb-nodes"
    )
    sample: dict[int, list] = {}
    for r in staged(centre_rows(nodes), "emb-centres").orderBy("label", "place").toLocalIterator():
        sample.setdefault(r["label"], []).append((r["n"], r["probe"], r["unit"]))
    centres = {k: c for k, rows_ in sample.items() if (c := fitted(rows_)) is not None}
    placed = staged(assign(nodes, centres), "emb-placed")
    members = placed.select("label", "node", "copies", "unit", F.posexplode("shards").alias("nth", "shard")).withColumn("home", F.col("nth") == 0).drop("nth")
    counts = placed.select("label", F.posexplode("shards").alias("nth", "shard")).groupBy("label", "shard").agg(F.count("*").alias("n"), F.count_if(F.col("nth") == 0).alias("homes"))
    # blocks of home vectors first, then those of the others, which meet only the former
    parts = lambda n: F.ceil(n / (CELL // 2)).cast("int")
    cut = members.join(counts.where("homes > 0"), ["label", "shard"]).withColumn("whole", F.col("n") <= CELL)
    cut = cut.withColumn("own", F.when(F.col("whole"), 1).otherwise(parts(F.col("homes")))).withColumn("others", F.when(F.col("whole"), 0).otherwise(parts(F.col("n") - F.col("homes"))))
    hashed = F.xxhash64("node", F.lit(SEED + 1))
    cut = cut.withColumn("block", F.when(F.col("whole") | F.col("home"), F.pmod(hashed, F.col("own"))).otherwise(F.col("own") + F.pmod(hashed, F.col("others"))).cast("int"))
    meets = F.when(F.col("home"), F.col("own") + F.col("others")).otherwise(F.col("own")) - 1
    cells = cut.select("label", "shard", "node", "copies", "unit", "home", "block", F.explode(F.sequence(F.lit(0), meets)).alias("other")).select(
        "label", "shard", F.least("block", "other").alias("cell_i"), F.greatest("block", "other").alias("cell_j"), "node", "copies", "unit", "home", "block"
    )
    key = ["label", "shard", "cell_i", "cell_j"]
    found = staged(cells.groupBy(*key).applyInPandas(_compare, "node long, links long, root long"), "emb-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")), "emb")
    release(placed)
    ends = nodes.join(links, "node", "left").join(joined, "node", "left").select(
        "label", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    return rows.join(ends, ["label", "unit"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def audit(vectors: DataFrame, result: DataFrame, every: int = 100, block: int = 4096) -> tuple[int, int]:
    """Links found and links there are, of the vectors whose id is divisible by every, against all vectors by brute force."""
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "embedding", "label").toPandas()
    queries = queries[[e is not None for e in queries["embedding"]]]
    shared = vectors.sparkSession.sparkContext.broadcast((_matrix(queries["embedding"]), queries["label"].to_numpy(), queries["vec_id"].to_numpy()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, label, ids = shared.value
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        for pdf in parts:
            pdf = pdf[[e is not None for e in pdf["embedding"]]]
            if len(pdf):
                x = _matrix(pdf["embedding"])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                hit = (q @ x.T >= LINK) & (label[:, None] == pdf["label"].to_numpy()) & (ids[:, None] != pdf["vec_id"].to_numpy())
                yield pd.DataFrame({"vec_id": ids, "n": hit.sum(axis=1)})

    true = vectors.select("vec_id", "embedding", "label").mapInPandas(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    row = true.join(result, "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
