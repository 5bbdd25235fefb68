"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: the budget (SHARE of all words) is dealt by weight; a source's target stops at EPOCHS times its size, and the excess is dealt
anew by weight among the others until none is above (a water level, found in one pass over the sources).

SEATS seats are blocks of equal token counts, a SEATS-th of the budget each. They go to the highest quotients target / (2 k + 1), k counting
the seats that a source has. The mix has SHARDS shards of equally many seats, so each shard holds an integer quota of every source. Seats are
not listed: with divisor d a source has round(target / d) of them, and the rounding of n sources is made up for by n seats more or less, so
only the few seats between the two divisors that these give are ranked, about three a source for each shard.

A source's documents stand in a seeded order, end to end, cut into blocks, and its blocks in another seeded order: its first seat takes the
first of those, and so on, round after round. The seats say which blocks go into which shard. So that the block's size loses no words, a
source's last seat is cut or lengthened until it gives the target to the word; one of less than half a block gets its words in that way too.
A document gives the words that lie in the taken blocks.

The running word count within a source is made of two levels, hash buckets and rows within a bucket, so a source with a third of all
rows is spread over BUCKETS groups. The order is that of a hash of the id. Where more than SPREAD rows of a source share an id, or have none, the
hash is of the content and of a number among equal rows as well, so that they do not meet in one bucket; equal rows are counted before they
are shuffled. There are fewer than SEATS blocks and one more for each source, whatever the rows. Sources are sorted in
one task, a row each.

Defined cases: a null text has no words; null sources are a source of their own, sorted last; null ids are ordered as an empty id;
repeated rows each take their own place in the order (where they are spread, map columns are not supported); an empty table gives no rows, and sources without words a target of 0. mix() replaces
columns of the input called like its outputs; expand() keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockmill.llm.common import field, quoted, small, staged, table

WEIGHTS = (5, 2, 1)
EPOCHS = 2
SEATS = 4096
SHARDS = 16  # divides SEATS
SEED = 5
SPREAD = 64  # rows of one id in a source, beyond which they are spread
PART_WORDS = 1 << 21
BUCKETS = 3  # hex digits of a hash: 4096 buckets
OUTPUTS = ("size", "source_size", "target", "taken", "shard")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size. Adds idx (its place by code point, null last), target double, the block size in words, the sum of all
    targets (dealt) and n_sources."""
    ranked = sizes.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("idx") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    every = Window.partitionBy()
    # twice the words, so that halves of the budget stay whole numbers; a source is full from the level 2 * EPOCHS * size / weight on
    filling = Window.orderBy((F.col("source_size") * 10 / F.col("weight")).asc(), F.col("idx")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("n_sources", F.count("*").over(every))
        .withColumn("num", 3 * F.col("all_words") - F.coalesce(F.sum(F.col("source_size") * 2 * EPOCHS).over(filling), F.lit(0)))
        .withColumn("den", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
        .withColumn("open", F.col("num") * F.col("weight") <= F.col("source_size") * 2 * EPOCHS * F.col("den"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("source_size") * 10 / F.col("weight"), "idx", "num", "den"))).over(every))
    )
    share = (F.col("weight") * F.col("first.num")).cast("double") / (2.0 * F.col("first.den"))
    target = F.least((F.col("source_size") * EPOCHS).cast("double"), share)
    return level.withColumn("share", target).select(
        "source",
        "source_size",
        "idx",
        F.col("share").alias("target"),
        F.greatest(F.lit(1), F.expr(f"(all_words * 3 div 2) div {SEATS}")).alias("block"),
        F.sum("share").over(every).alias("dealt"),
        "n_sources",
    )


def quotas(aims: DataFrame, total: int = SEATS, shards: int = SHARDS) -> DataFrame:
    """Sainte-Lague by divisors: idx, shard (0 to shards - 1) and seats, how many seats the source has in all shards up to that one."""
    each = aims.where("target > 0").select("idx", "target", "dealt", "n_sources", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    each = each.withColumn("house", F.expr(f"{total}L * (shard + 1) div {shards}"))
    seats_at = lambda n: F.floor(F.col("target") * n / F.col("dealt") + 0.5)
    # a margin of one seat on either side, as quotients are rounded
    sure = F.greatest(F.lit(0), seats_at(F.greatest(F.lit(0), F.col("house") - F.col("n_sources"))) - 1)
    each = each.withColumn("sure", sure).withColumn("most", seats_at(F.col("house") + F.col("n_sources")) + 1)
    close = each.select("idx", "shard", "house", "sure", "target", F.explode(F.sequence("sure", "most")).alias("k"))
    left = close.withColumn("left", F.col("house") - F.sum(F.when(F.col("k") == F.col("sure"), F.col("sure")).otherwise(0)).over(Window.partitionBy("shard")))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "idx", "k"))
    won = left.withColumn("won", (rank <= F.col("left")).cast("long"))
    return won.groupBy("idx", "shard").agg((F.first("sure") + F.sum("won")).alias("seats"))


def plan(docs_sizes: DataFrame) -> DataFrame:
    """docs_sizes: source, size. One row per source: its size, target and block size, whole passes, of each block its place in the seeded order
    (place) and how many of its words are taken once more (cut), and of each shard the number of seats up to it (upto)."""
    sizes = docs_sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = staged(targets(sizes), "mix-targets")
    n_blocks = F.expr("(source_size + block - 1) div block")
    words = F.floor(F.col("target") + 0.5).cast("long")
    full = aims.where("source_size > 0").withColumn("n_blocks", n_blocks).withColumn("words", words)
    blocks = full.select("idx", "source_size", "block", "words", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("b"))
    blocks = blocks.withColumn("long", F.least("block", F.col("source_size") - F.col("b") * F.col("block")))
    drawn = Window.partitionBy("idx").orderBy(F.md5(F.concat_ws(":", F.lit(f"block{SEED}"), "idx", "b").cast("binary")), "b")
    before = F.sum("long").over(drawn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("long")
    cut = F.greatest(F.lit(0), F.least("long", F.expr("words % source_size") - F.col("before")))
    placed = blocks.withColumn("place", F.row_number().over(drawn) - 1).withColumn("before", before).withColumn("cut", cut)
    chosen = placed.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("b", F.col("place").cast("long").alias("place"), "cut"))).alias("blocks"))
    upto = quotas(aims).groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("shard", "seats"))).alias("upto"))
    return (
        aims.join(chosen, "idx", "left")
        .join(upto, "idx", "left")
        .select("source", "source_size", "target", "block", F.coalesce(F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")), F.lit(0)).alias("passes"), F.col("blocks.place").alias("place"), F.col("blocks.cut").alias("cut"), F.col("upto.seats").alias("upto"))
    )


def ordered(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row (the columns of docs, or those to carry), source, size, order, the hash by which a source's rows stand, and bucket, its first digits."""
    text = F.col(quoted(text_col))
    sized = docs.select(F.struct(*(F.col(quoted(c)) for c in carry or docs.columns)).alias("row"), F.col("source"), word_count(text).alias("size"), F.col("doc_id").cast("string").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("content"))
    order = lambda *parts: F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce("id", F.lit("")), *parts).cast("binary"))
    keyed = sized.withColumn("order", order())
    hot = staged(sized.groupBy("source", "id").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD).select(F.col("source").alias("s"), F.col("id").alias("i")), "mix-hot")
    if not hot.isEmpty():
        few = small(hot)
        same = F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i"))
        # equal rows are counted and listed again, each with a number
        copies = sized.join(few, same, "left_semi").groupBy("row", "source", "size", "id", "content").agg(F.count("*").alias("n"))
        apart = copies.select("row", "source", "size", "id", "content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
        columns = ["row", "source", "size", "id", "content", "order"]
        keyed = keyed.join(few, same, "left_anti").select(columns).unionByName(apart.withColumn("order", order("content", F.col("nth").cast("string"))).select(columns))
    return keyed.withColumn("bucket", F.substring("order", 1, BUCKETS)).drop("id", "content")


def laid(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: row (its columns, or those to carry), size, source_size, target, taken, passes, and rounds: for each time that the mix comes to
    the text, the shard of its first taken word there, and its pieces (words from and to, in blocks of the source)."""
    return _laid(docs, _planned(docs, text_col), text_col, carry)


def _planned(docs: DataFrame, text_col: str) -> DataFrame:
    return staged(plan(docs.select("source", word_count(F.col(quoted(text_col))).alias("size"))), "mix-plan")


def _laid(docs: DataFrame, sources: DataFrame, text_col: str, carry: list[str] | None = None) -> DataFrame:
    keyed = ordered(docs, text_col, carry)
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    offsets = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), up_to.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    at = keyed.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    at = at.select("row", "source", "size", (F.col("before") + F.col("inside")).alias("start"))
    own = sources.withColumnRenamed("source", "s")
    joined = at.join(own, F.col("source").eqNullSafe(F.col("s"))).withColumn("end", F.col("start") + F.col("size"))
    spans = F.expr("case when size > 0 then sequence(start div block, (end - 1) div block) else array() end")
    # a pass takes all blocks; after the passes, of each block the words up to its cut
    pieces = F.expr(
        "filter(transform(spans, b -> struct(greatest(b * block, start) - start as from, least(b * block + cut[cast(b as int)], end) - start as to, place[cast(b as int)] as place)), p -> p.to > p.from)"
    )
    shard_of = f"least({SHARDS - 1}, size(filter(upto, u -> u <= seat)))"
    seat = lambda k, of: f"(transform(array({k} * size(place) + {of}), seat -> {shard_of}))[0]"
    whole = "array(struct(0L as from, size as to))"
    head = "place[cast(start div block as int)]"
    rounds = F.expr(
        f"concat(case when size > 0 and passes > 0 then transform(sequence(0L, passes - 1), k -> struct({seat('k', head)} as shard, {whole} as pieces)) else array() end,"
        f" case when size(pieces) > 0 then array(struct({seat('passes', 'pieces[0].place')} as shard, transform(pieces, p -> struct(p.from as from, p.to as to)) as pieces)) else array() end)"
    )
    return (
        joined.withColumn("spans", spans)
        .withColumn("pieces", pieces)
        .withColumn("taken", F.expr("passes * size + aggregate(pieces, 0L, (a, p) -> a + p.to - p.from)"))
        .withColumn("rounds", rounds)
        .select("row", "source", "start", "size", "source_size", "target", "taken", "passes", "rounds")
    )


def mix(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size, source_size and taken (long), target (double), and the shard (int) in which the text first comes, -1 if never."""
    return _mixed(docs, text_col, [c for c in docs.columns if c.lower() not in OUTPUTS])


def _mixed(docs: DataFrame, text_col: str, rest: list[str]) -> DataFrame:
    return laid(docs, text_col, rest).select(
        *(field("row", c).alias(c) for c in rest), "size", "source_size", "target", "taken", F.coalesce(F.array_min(F.transform("rounds", lambda r: r["shard"])), F.lit(-1)).cast("int").alias("shard")
    )


def expand(docs: DataFrame, text_col: str = "text", shard_col: str | None = None) -> DataFrame:
    """The mix of docs itself: a row for each time that the mix comes to a text, with the words that it takes there; shard_col adds the shard.

    The mix is laid out by its seats: shard after shard, each in partitions of its own of about PART_WORDS words, so that whoever reads it in its
    order, or writes and reads it again, has each source's quota in every shard.

    Words keep the white space before them, and a text that is taken whole stays as it is. n_chars, where there is such a column, is that of the
    new text. Texts that are not taken go.
    """
    sources = _planned(docs, text_col)
    per = max(1, math.ceil((sources.agg(F.sum("target")).first()[0] or 0) / (SHARDS * PART_WORDS)))
    each = _laid(docs, sources, text_col).select("row", "size", F.explode("rounds").alias("r"), F.pmod(F.xxhash64("source", "start"), F.lit(per)).alias("nth"))
    each = each.repartitionById(SHARDS * per, (F.col("r.shard") * per + F.col("nth")).cast("int"))
    text = field("row", text_col)
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("r.pieces", lambda p: F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), "")
    whole = F.expr("aggregate(r.pieces, 0L, (a, p) -> a + p.to - p.from) = size")
    new = F.when(whole, text).otherwise(part)
    cols = [new.alias(c) if c == text_col else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else field("row", c).alias(c) for c in docs.columns]
    return each.select(*cols, *([F.col("r.shard").cast("int").alias(shard_col)] if shard_col else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return _mixed(docs, "text", ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), *OUTPUTS)


SQL = rf"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0)::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '') || case when count(*) over (partition by source, doc_id) > {SPREAD}
           then ':' || md5(coalesce(text, '')) || ':' || row_number() over (partition by source, doc_id, text) else '' end) as ord
  from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (
  select *, row_number() over (order by source collate "C" nulls last) as idx from sizes),
weighted as (
  select *, (case (idx - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end)::bigint as weight,
         sum(source_size) over ()::bigint as all_words, count(*) over () as n_sources from ranked),
filled as (
  select *,
    3 * all_words - coalesce(sum(source_size * 4) over w, 0)::bigint as num,
    sum(weight) over ()::bigint - coalesce(sum(weight) over w, 0)::bigint as den
  from weighted
  window w as (order by source_size * 10 / weight, idx rows between unbounded preceding and 1 preceding)),
first as (
  select num, den from filled where num * weight <= source_size * 4 * den order by source_size * 10 / weight, idx limit 1),
aims as (
  select f.source, f.source_size, f.idx,
    least((f.source_size * 2)::double, (f.weight * o.num)::double / (2.0::double * o.den)) as target,
    greatest(1, ((f.all_words * 3) // 2) // {SEATS}) as block
  from filled f left join first o on true),
counted as (select *, floor(target + 0.5)::bigint as words, (source_size + block - 1) // block as n_blocks, sum(target) over () as dealt, count(*) over () as n_all from aims),
offered as (
  select idx, target, unnest(range(0, floor(target * ({SEATS} + n_all) / dealt)::bigint + 2)) as k from counted where target > 0),
ranked_seats as (select idx, k, row_number() over (order by target / (2 * k + 1) desc, idx, k) as rnk from offered),
won as (select idx, k as seat, ((rnk - 1) * {SHARDS} // {SEATS})::int as shard from ranked_seats where rnk <= {SEATS}),
blocks as (
  select idx, block, source_size, words, n_blocks, unnest(range(0, n_blocks)) as b from counted where n_blocks > 0),
measured as (
  select *, least(block, source_size - b * block) as long, md5('block{SEED}:' || idx || ':' || b) as drawn from blocks),
placed as (
  select *, row_number() over w - 1 as place,
    greatest(0, least(long, words % source_size - (sum(long) over w - long)))::bigint as cut
  from measured window w as (partition by idx order by drawn, b)),
lined as (
  select d.*, c.idx, c.source_size, c.target, c.block, c.words, c.n_blocks, case when c.source_size > 0 then c.words // c.source_size else 0 end as passes,
    (sum(d.size) over (partition by c.idx order by d.ord, d.size rows between unbounded preceding and current row))::bigint as last
  from docs d join counted c on d.source is not distinct from c.source),
numbered as (select *, row_number() over () as rn, last - size as start from lined),
met as (
  select n.rn, n.passes, p.place, p.idx, p.b,
    greatest(0, least(p.b * n.block + p.cut, n.last) - greatest(p.b * n.block, n.start)) as words
  from numbered n join placed p on p.idx = n.idx and n.size > 0 and p.b between n.start // n.block and (n.last - 1) // n.block),
seated as (
  select rn, idx, sum(words) as extra,
    case when max(passes) > 0 then arg_min(place, b) else arg_min(place, b) filter (words > 0) end as seat
  from met group by rn, idx),
shards as (
  select s.rn, s.extra, case when s.seat is null then null else coalesce(w.shard, {SHARDS - 1}) end as shard
  from seated s left join won w on w.idx = s.idx and w.seat = s.seat)
select doc_id, size, source_size, target, (passes * size + coalesce(extra, 0))::bigint as taken, coalesce(shard, -1)::int as shard
from numbered left join shards using (rn)
"""
