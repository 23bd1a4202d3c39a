"""Mixing sources to target weights by weighted fair queueing.

Each source has a weight and shares the budget by weight, up to `max_epochs` times its own size; what a full source
leaves goes to the others by weight. The documents of a source are shuffled by a hash and queue in that order, once for
each epoch. A document's virtual finish time is its source's cumulative size, itself included, over the source's target.
All sources so reach their targets at time 1. The queue is cut where the documents taken so far fill the budget:
the cut is the latest finish time up to which all documents together are within the budget, and documents that finish
at the same time are taken together or not at all.

Both running sums (along a source, and along all finish times) are taken in two levels, inside hash or time buckets
and then over the buckets, so that no task holds a whole source. Equal rows queue one after the other; they are summed as one
run first, so that they may be any share of all rows.

Edge cases: a null text has size 0 and is never taken; the null source is one source, last in order; rows with equal
doc_id, or none, queue by a hash of their text too, and repeated rows are rows of their own; sources without words have
target 0; a very long text is only counted and hashed; an empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.common import cut, maybe_broadcast, repeated, word_count

#: Time buckets of one unit of virtual time; finish times of 2 and more share the last bucket.
TIME_BUCKETS = 4096
#: Equal rows that are written from one row at once; more of them are dealt to several tasks.
RUN = 1 << 16


def _shuffle_key(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per source: its size, weight and target. `sizes` has the columns source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    place = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    named = totals.select("source", "source_size", weight.alias("weight"), F.row_number().over(by_name).alias("place"))
    fill = Window.orderBy(F.col("full_at"), F.col("place"))
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rated = named.withColumn("full_at", max_epochs * F.col("source_size") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(every) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = rated.select("*", (left / open_weight).alias("level"), F.row_number().over(fill).alias("nth"))
    first_open = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("nth", "level"))).over(every)["level"]
    full = max_epochs * F.col("source_size").cast("double")
    return levels.select(
        "source",
        "source_size",
        F.when(F.col("full_at") > first_open, F.col("weight") * first_open).otherwise(full).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; `keep` names further columns to carry."""
    keep = keep or []
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _shuffle_key(F.col("doc_id").cast("long"), F.col("text")).alias("_key"), *keep)
    sized = cut(sized)
    targets = cut(source_targets(sized, weights, share, max_epochs))
    n_sources = targets.count()
    budget = targets.agg(F.lit(share) * F.sum("source_size")).first()[0]
    budget = float(budget or 0.0)

    bucket = F.substring("_key", 1, 3)
    runs = sized.groupBy("source", "_key", "doc_id", "size", *keep).agg(F.count(F.lit(1)).alias("_many")).withColumn("_bucket", bucket)
    own = F.col("size") * F.col("_many")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    sums = runs.groupBy(F.col("source").alias("_src"), F.col("_bucket").alias("_b")).agg(F.sum(own).alias("_sum"))
    over = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_src", "_b", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    queued = (
        runs.withColumn("_run", F.sum(own).over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_before", F.col("_start") + F.col("_run") - own)
    )
    named = maybe_broadcast(targets.withColumnRenamed("source", "_name"), n_sources)
    timed = queued.join(named, F.col("source").eqNullSafe(F.col("_name"))).select("doc_id", "source", "size", "source_size", "target", "_before", "_many", *keep)
    timed = cut(repeated(timed, "_many", "_i", RUN).select("doc_id", "source", "size", "source_size", "target", (F.col("_before") + (F.col("_i") + 1) * F.col("size")).alias("_cum"), *keep))

    def finish(epoch: int) -> Column:
        return (F.lit(epoch) * F.col("source_size") + F.col("_cum")) / F.col("target")

    entries = timed.where("size > 0 and target > 0").select("size", F.explode(F.array(*[finish(e) for e in range(max_epochs)])).alias("at"))
    entries = entries.withColumn("_b", F.least(F.floor(F.col("at") * TIME_BUCKETS), F.lit(2 * TIME_BUCKETS)).cast("int"))
    per_time = entries.groupBy("_b").agg(F.sum("size").alias("_sum"))
    running = per_time.select("_b", "_sum", F.sum("_sum").over(Window.orderBy("_b")).alias("_upto"))
    last = running.where(F.col("_upto") > budget).agg(F.min(F.struct("_b", "_upto", "_sum"))).first()[0]
    if last is None:  # everything fits
        limit = float("inf")
    else:
        within = entries.where(F.col("_b") == last["_b"]).groupBy("at").agg(F.sum("size").alias("_sum"))
        reach = within.select("at", F.sum("_sum").over(Window.orderBy("at")).alias("_upto"))
        room = budget - (last["_upto"] - last["_sum"])
        limit = reach.where(F.col("_upto") <= room).agg(F.max("at")).first()[0]
        if limit is None:  # the cut falls before the bucket's first document
            limit = entries.where(F.col("_b") < last["_b"]).agg(F.max("at")).first()[0]
        limit = -1.0 if limit is None else limit
    copies = sum((F.when(finish(e) <= F.lit(limit), 1).otherwise(0) for e in range(1, max_epochs)), F.when(finish(0) <= F.lit(limit), 1).otherwise(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), copies * F.col("size")).otherwise(F.lit(0))
    return timed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Only keys and sizes go through the queue; the rows meet them once."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(whole).alias("_mark"))  # no name of `docs` is used beside these
    mixed = mix(rows.select("_row.doc_id", "_row.source", "_row.text", "_mark"), weights, share, max_epochs, ["_mark"])
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("long")
    runs = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("_mark").alias("_m")).agg(F.sum(copies).alias("_copies"), F.count(F.lit(1)).alias("_many"))
    runs = cut(runs.where("_copies > 0"))
    n = runs.count()
    meet = rows["_key"].eqNullSafe(F.col("_id")) & (rows["_mark"] == F.col("_m"))
    out = rows.join(maybe_broadcast(runs.where("_many = 1"), n), meet).select("_row", "_copies")
    equal = runs.where("_many > 1")
    if equal.limit(1).count():  # equal rows: one of them, as often as all of them are taken
        same = rows.join(maybe_broadcast(equal, n), meet).groupBy("_id", "_m", "_copies").agg(F.first("_row").alias("_row"))
        out = out.unionByName(same.select("_row", "_copies"))
    return repeated(out.select(F.col("_row").alias("row"), "_copies"), "_copies", "_i", RUN).select("row.*")


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as k
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
named as (
  select source, source_size, row_number() over (order by source nulls last) as place,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from totals),
rated as (select *, 2 * source_size / weight as full_at from named),
levels as (
  select *, (1.5::double * sum(source_size) over () - 2 * coalesce(sum(source_size) over (order by full_at, place rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over () - coalesce(sum(weight) over (order by full_at, place rows between unbounded preceding and 1 preceding), 0)) as level,
         row_number() over (order by full_at, place) as nth
  from rated),
first_open as (select arg_min(level, nth) as level from levels where full_at > level),
targets as (
  select l.source, l.source_size, case when l.full_at > f.level then l.weight * f.level else 2 * l.source_size::double end as target
  from levels l cross join first_open f),
timed as (
  select s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows between unbounded preceding and current row)::bigint as cum
  from sized s join targets t on s.source is not distinct from t.source),
entries as (
  select size, cum / target as done from timed where size > 0 and target > 0
  union all
  select size, (source_size + cum) / target as done from timed where size > 0 and target > 0),
reach as (select done, sum(size) over (order by done) as upto from entries),
fence as (select max(done) as done from reach where upto <= (select 1.5::double * sum(source_size) from totals))
select doc_id, size, source_size, target,
       (case when size > 0 and target > 0 then ((case when cum / target <= f.done then 1 else 0 end) + (case when (source_size + cum) / target <= f.done then 1 else 0 end)) * size else 0 end)::bigint as taken
from timed cross join fence f
"""
