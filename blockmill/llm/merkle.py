"""A Merkle manifest of a dataset: a tree of digests for each source, one over the sources' roots, and a proof for every row.

A row's leaf is the digest of its fields, each as `-` if null, else its UTF-8 byte count, a colon and its value. Leaves of a source ascend by
doc_id; of every FANOUT consecutive nodes, fewer in the last run, the digest of their digests becomes the parent, until one node is left. The
sources' roots, null first and then by their UTF-8 bytes, are reduced to one root in the same way.

Superblocks: nodes are bucketed by index div FANOUT ** LEVELS, and applyInPandas collapses LEVELS levels of one bucket at once, so a tree of n
leaves takes log(n) / (4 * LEVELS) rounds, each over the roots of the buckets before. Proofs go down the same rounds: a bucket meets the one
proof that its root has (cogroup), and every node's proof is its siblings inside the bucket followed by those above. Proofs are long, so
they are made in the last step and never shuffled, but for one a bucket.

Places are found without a task that sees all rows: slim rows (ids and digests) are range-partitioned by source and doc_id, numbered
within their partition, and the counts of partitions are summed, so a source of any share of the rows is cut into ranges.

Defined cases: a null doc_id comes first in its source and is a null field in its leaf; rows that share a doc_id are ordered by leaf, and
equal rows each have a leaf and a proof of their own; null sources are one source; an empty text is `0:`; an empty table gives no rows; columns
other than the five fields are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockmill.llm.common import release, small, staged, table

FANOUT = 16
LEVELS = 3  # that a bucket collapses: 4,096 nodes
HEX = 64  # digits of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "before array<string>, after array<string>"


def leaf(fields: dict[str, Column]) -> Column:
    """The leaf digest of the five fields, in their order."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def collapse(digests: list[str], levels: int) -> list[str]:
    """The rows of digests of a run of siblings: the run itself as one string, then that of each of so many levels above it."""
    rows = ["".join(digests)]
    for _ in range(levels):
        below = rows[-1]
        step = HEX * FANOUT
        rows.append("".join(hashlib.sha256(below[k : k + step].encode()).hexdigest() for k in range(0, len(below), step)))
    return rows


def siblings(rows: list[str], k: int) -> tuple[list[str], list[str]]:
    """Of the k-th node of a run, by level: its siblings before it and after it, each as one string."""
    before, after = [], []
    for row in rows[:-1]:
        first = k - k % FANOUT
        before.append(row[HEX * first : HEX * k])
        after.append(row[HEX * (k + 1) : HEX * (first + FANOUT)])
        k //= FANOUT
    return before, after


def height(n: Column) -> Column:
    """Levels above n leaves: the least number of times that n can be divided by FANOUT, rounding up, until 1 is left."""
    powers = F.array(*(F.lit(FANOUT**k) for k in range(15)))
    return F.size(F.filter(powers, lambda p: p < n)).cast("int")


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with tree long (the place of the group's value among all values, from 0), idx long (the row's place in its group by order), and n
    long (rows of the group). Staged; equal rows may change places."""
    ranged = rows.repartitionByRange(F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order))
    ranged = ranged.sortWithinPartitions(F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order))
    numbered = staged(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    # a row for each source of each range
    runs = staged(numbered.groupBy("part", group).agg(F.count("*").alias("rows"), F.min("at").alias("first")), "merkle-runs")
    sizes = runs.groupBy(group).agg(F.sum("rows").alias("n"))
    trees = staged(sizes.select(F.col(group).alias("_g"), "n", (F.row_number().over(Window.orderBy(F.col(group).asc_nulls_first())) - 1).cast("long").alias("tree")), "merkle-trees")
    before = F.sum("rows").over(Window.partitionBy(group).orderBy("part")) - F.col("rows")
    own = runs.withColumn("before", before).join(small(trees), F.col(group).eqNullSafe(F.col("_g"))).select(F.col("part").alias("_part"), "_g", "n", "tree", (F.col("before") - F.col("first")).alias("shift"))
    offsets = staged(own, "merkle-offsets")
    out = numbered.join(small(offsets), (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g")))
    done = staged(out.select(*rows.columns, "tree", (F.col("at") + F.col("shift")).alias("idx"), "n"), "merkle-placed")
    release(numbered, runs, trees, offsets)
    return done


def _bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"idx div {FANOUT**LEVELS}"))


def _above(nodes: DataFrame) -> DataFrame:
    """One round: the roots of the buckets as nodes (tree, idx, digest, left), left being how many levels are still above them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        levels = min(LEVELS, int(pdf["left"].iloc[0]))
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "idx": pdf["bucket"].iloc[:1], "digest": [collapse(pdf["digest"].tolist(), levels)[-1]], "left": [int(pdf["left"].iloc[0]) - levels]})

    return _bucketed(nodes).select("tree", "idx", "digest", "left", "bucket").groupBy("tree", "bucket").applyInPandas(run, "tree long, idx long, digest string, left int")


def reduce(nodes: DataFrame) -> list[DataFrame]:
    """nodes: tree, idx, digest, left. The nodes of every round, the last with one node a tree (idx 0, the root); all but the first staged."""
    rounds = [nodes]
    rounds.append(staged(_above(nodes), "merkle-round1"))
    while not rounds[-1].where("left > 0").isEmpty():
        rounds.append(staged(_above(rounds[-1]), f"merkle-round{len(rounds)}"))
    return rounds


def _below(nodes: DataFrame, proofs: DataFrame, keep: list[str]) -> DataFrame:
    """nodes with the columns to keep, and their whole proofs, given those of the roots of their buckets (tree, idx, before, after)."""
    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in keep)

    def run(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        rows = collapse(pdf["digest"].tolist(), min(LEVELS, int(pdf["left"].iloc[0])))
        up, down = list(above["before"].iloc[0]), list(above["after"].iloc[0])
        both = [siblings(rows, k) for k in range(len(pdf))]
        out = pdf[keep].copy()
        out["before"], out["after"] = [b + up for b, _ in both], [a + down for _, a in both]
        return out

    mine = _bucketed(nodes).select(*dict.fromkeys(["tree", "idx", "digest", "left", "bucket", *keep])).groupBy("tree", "bucket")
    theirs = proofs.select("tree", F.col("idx").alias("bucket"), "before", "after").groupBy("tree", "bucket")
    return mine.cogroup(theirs).applyInPandas(run, f"{kinds}, {PROOF}")


def prove(rounds: list[DataFrame], roots: DataFrame, keep: list[str]) -> DataFrame:
    """The proofs of the first round's nodes, given those of the roots (tree, before, after)."""
    known = roots.select("tree", F.lit(0).cast("long").alias("idx"), "before", "after")
    for nodes in reversed(rounds[1:-1]):
        known = staged(_below(nodes, known, ["tree", "idx"]), "merkle-proofs")
    return _below(rounds[0], known, keep)


def fold(digest: Column, before: Column, after: Column) -> Column:
    """The root that a digest and its proof give."""
    steps = F.arrays_zip(before.alias("b"), after.alias("a"))
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["b"], d, s["a"]), 256))


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: source, doc_id, leaf, subroot (of its source), root, and its proof: of each level, from the lowest on, the digests of
    its siblings before it and after it. carry: further columns made of the row, which must depend on its fields alone."""
    carry = carry or {}
    fields = {c: F.col(c) for c in FIELDS}
    slim = staged(docs.select("source", "doc_id", leaf(fields).alias("digest"), *(v.alias(k) for k, v in carry.items())), "merkle-leaves")
    leaves = placed(slim, "source", "doc_id", "digest").withColumn("left", height(F.col("n")))
    rounds = reduce(leaves)
    subroots = staged(rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"), "merkle-subroots")
    n = subroots.count()
    top = reduce(subroots.withColumn("left", height(F.lit(n))))
    none = F.array().cast("array<string>")
    proofs = staged(prove(top, top[-1].select("tree", none.alias("before"), none.alias("after")), ["idx"]).withColumnRenamed("idx", "tree"), "merkle-sources")
    rows = prove(rounds, proofs, ["tree", *slim.columns])
    root = top[-1].select("digest").first()  # one row, or none of an empty table
    roots = small(staged(subroots.select(F.col("idx").alias("_tree"), F.col("digest").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root")), "merkle-roots"))
    release(slim)
    return rows.join(roots, F.col("tree") == F.col("_tree")).select("source", "doc_id", F.col("digest").alias("leaf"), "subroot", "root", *carry, "before", "after")


def verify(claimed: DataFrame, proofs: DataFrame) -> DataFrame:
    """Rows (the five fields) against the manifest's proofs by source and doc_id (which must be unique there): source, doc_id, and whether the row
    folds to the root; false for rows that the manifest lacks."""
    own = claimed.select("source", "doc_id", leaf({c: F.col(c) for c in FIELDS}).alias("own"))
    known = proofs.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "root", "before", "after")
    joined = own.join(known, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return joined.select("source", "doc_id", F.coalesce(fold(F.col("own"), F.col("before"), F.col("after")) == F.col("root"), F.lit(False)).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row by crc32 is tampered with: its text's capitals become small ones before its leaf is folded."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    other = leaf(fields | {"text": F.translate("text", UPPER, LOWER)})
    rows = manifest(docs, {"presented": F.when(hit, other).otherwise(leaf(fields))})
    proof = F.array_join(F.transform(F.arrays_zip("before", "after"), lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold(F.col("presented"), F.col("before"), F.col("after")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {})"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
SQL = f"""
with recursive docs as (
  select source, doc_id, {_LEAF.format(_FIELD.format("text"))} as leaf,
    case when coalesce({_CRC} % 5 = 0, false) then {_LEAF.format(_FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')"))} else {_LEAF.format(_FIELD.format("text"))} end as presented
  from documents),
leaves as materialized (
  select *, dense_rank() over (order by source collate "C" nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from docs),
nodes as (
  select tree, 0 as lev, idx, leaf as digest, count(*) over (partition by tree) as n from leaves
  union all
  select tree, lev + 1, idx // {FANOUT}, sha256(string_agg(digest, '' order by idx)), (any_value(n) + {FANOUT - 1}) // {FANOUT} from nodes where n > 1 group by tree, lev, idx // {FANOUT}),
kept as materialized (select * from nodes),
tops as (
  select 0 as lev, tree as idx, digest, count(*) over () as n from kept where n = 1
  union all
  select lev + 1, idx // {FANOUT}, sha256(string_agg(digest, '' order by idx)), (any_value(n) + {FANOUT - 1}) // {FANOUT} from tops where n > 1 group by lev, idx // {FANOUT}),
top_kept as materialized (select * from tops),
every as (
  select tree, lev, idx, digest, n from kept where n > 1
  union all
  select k.tree, h.h + t.lev, t.idx, t.digest, t.n from (select distinct tree from kept) k join (select tree, max(lev) as h from kept group by tree) h using (tree)
    join top_kept t on t.n > 1),
heights as (select tree, max(lev) as h from kept group by tree),
ways as materialized (
  select l.tree, l.idx as leaf_idx, e.lev, string_agg(e.digest, '' order by e.idx) filter (where e.idx < a.at) as before, string_agg(e.digest, '' order by e.idx) filter (where e.idx > a.at) as after
  from leaves l join heights h on h.tree = l.tree
    cross join lateral (select unnest(range(0, 40)) as lev) s
    cross join lateral (select case when s.lev < h.h then l.idx >> least(60, 4 * s.lev)::int else l.tree >> greatest(0, least(60, 4 * (s.lev - h.h)))::int end as at) a
    join every e on e.tree = l.tree and e.lev = s.lev and e.idx // {FANOUT} = a.at // {FANOUT}
  group by l.tree, l.idx, e.lev, a.at),
folded as (
  select tree, idx, 0 as lev, presented as digest from leaves
  union all
  select f.tree, f.idx, f.lev + 1, sha256(coalesce(w.before, '') || f.digest || coalesce(w.after, '')) from folded f join ways w on w.tree = f.tree and w.leaf_idx = f.idx and w.lev = f.lev),
proofs as (select tree, leaf_idx, string_agg(coalesce(before, '') || coalesce(after, ''), '' order by lev) as proof from ways group by tree, leaf_idx),
ended as (select tree, idx, arg_max(digest, lev) as folded_root from folded group by tree, idx)
select l.doc_id, l.leaf, s.digest as subroot, r.digest as root, sha256(coalesce(p.proof, '')) as proof_sha256, e.folded_root, e.folded_root = r.digest as verified
from leaves l join ended e using (tree, idx) join (select tree, digest from kept where n = 1) s using (tree) cross join (select digest from top_kept where n = 1) r
  left join proofs p on p.tree = l.tree and p.leaf_idx = l.idx
"""
