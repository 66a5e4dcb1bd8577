"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh `weights`, repeating, and share `share` times
all words; a target stops at `cap` times its source's size and the excess goes to the others by
weight (water-filling over one row per source). A source's target is met by complete epochs first;
the rest is a fractional selection: documents in the order of exponential keys -ln(u)/quality, taken
until the running total of words is nearest to the rest.

The running total is never sorted within one task: keys fall into buckets, bucket totals give the
bucket in which the budget ends, that bucket is dealt into finer ones, and only the last bucket
(one in about a million of a source's rows) is ordered document by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loamcast.llm.common import numbered, restored, settled, stage, unused, word_count

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Buckets per unit of key, coarse and fine.
COARSE, FINE = 256.0, 1048576.0


def quality_weight(text: Column, size: Column) -> Column:
    """In (0, 1]: near 1 where the mean word length is near six code points."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(F.length(text).cast("double") / size.cast("double") - 6.0) / 6.0)).otherwise(F.lit(1.0))


def sampling_key(ident: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u)/weight with u in (0, 1) from the row's id, so that reruns agree; least keys go first."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(ident.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    return -F.log((draw + 1.0) / F.lit(281474976710657.0)) / weight


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to the same with `target`; one row per source, also for a null source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.crossJoin(F.broadcast(sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_words"))))
    full = Window.orderBy((F.col("source_size") * cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = ranked.withColumn("level", (F.col("all_words") * share - below * cap) / rest)
    filled = filled.withColumn("open", F.col("level") <= F.col("source_size") * cap / F.col("w"))
    filled = filled.withColumn("at", F.row_number().over(full))
    place = F.when(F.col("open"), F.col("at"))
    last = filled.agg(F.min_by("level", place).alias("lv"), F.min(place).alias("first_open"))
    out = filled.crossJoin(F.broadcast(last))
    return out.select("source", "source_size", F.when(F.col("at") >= F.col("first_open"), F.col("w") * F.col("lv")).otherwise(F.col("source_size") * cap).alias("target"))


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, size: Column | None, quality: Column | None, seed: str) -> DataFrame:
    size = word_count(F.col(text_col)) if size is None else size
    out = docs.withColumns({"__row": F.monotonically_increasing_id(), "__size": size.cast("long"), "__source": F.col(source_col)})
    quality = quality_weight(F.col(text_col), F.col("__size")) if quality is None else quality
    out = out.withColumn("__key", sampling_key(F.col(id_col), F.coalesce(quality, F.lit(1.0)), seed))
    return out.withColumns({"__coarse": F.floor(F.col("__key") * COARSE), "__fine": F.floor(F.col("__key") * FINE)})


def _ends_in(rows: DataFrame, bucket: str, by: Window) -> DataFrame:
    """Of each source, the last bucket that begins before the budget ends, and the words before it."""
    sums = rows.groupBy("__s", bucket).agg(F.sum("__size").alias("b"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    at = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("b").over(by.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = at.where("start < rest").groupBy("__s").agg(F.max(F.struct(bucket, "start")).alias("m"))
    return found.select("__s", F.col(f"m.{bucket}").alias(f"last_{bucket}"), F.col("m.start").alias("before"))


def plan_mix(keyed: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """One row per source: target, complete epochs, and the place where the selection ends."""
    tag = F.struct(F.col("__source").isNull().alias("n"), F.coalesce("__source", F.lit("")).alias("v"))
    slim = stage(keyed.select(tag.alias("__s"), "__source", "__row", "__size", "__key", "__coarse", "__fine"), "mix-keys")
    sizes = slim.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    targets = source_targets(stage(sizes, "source-sizes"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("__s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("v")))
    plan = stage(plan, "mix-targets")
    by = Window.partitionBy("__s")
    rows = slim.drop("__source").join(plan.select("__s", "rest"), "__s")
    coarse = stage(_ends_in(rows.withColumn("before", F.lit(0).cast("long")), "__coarse", by), "mix-coarse")
    inner = rows.join(coarse, "__s").where("__coarse = last___coarse")
    fine = stage(_ends_in(inner, "__fine", by), "mix-fine")
    edge = inner.drop("before").join(fine, "__s").where("__fine = last___fine")
    order = by.orderBy("__key", "__row")
    end = F.col("before") + F.sum("__size").over(order)
    # A document is taken if that brings the total nearer: its middle lies before the budget's end.
    taken = edge.withColumn("end", end).where("2 * end - __size < 2 * rest").groupBy("__s").agg(F.max(F.struct("__key", "__row")).alias("last_taken"))
    ends = coarse.select("__s", "last___coarse").join(fine.select("__s", "last___fine"), "__s", "left").join(taken, "__s", "left")
    return stage(plan.join(ends, "__s", "left").select("__s", "source_size", "target", "epochs", "last___coarse", "last___fine", "last_taken"), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, quality: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs with __size, source_size, target and copies (times the mix takes the row).

    Where docs has a column of one of these names, the new one's gets underscores in front; so the last
    four columns are always these. size and quality are expressions over docs. Null or empty texts have
    size 0 and no more than their source's epochs as copies; long texts count whole, and a document longer
    than its source's rest is taken if that brings the total nearer. A null source is a source of its own.
    Rows that repeat an id share its draw; equal keys are told apart by the rows' order. An empty table
    gives an empty result.
    """
    docs = settled(docs, "documents")
    rows = numbered(docs)
    at = lambda name: rows.columns[docs.columns.index(name)]
    own = [c.alias(n) for c, n in ((size, "given_size"), (quality, "given_quality")) if c is not None]
    if own:
        rows = docs.select("*", *own).toDF(*rows.columns, *(n for c, n in ((size, "given_size"), (quality, "given_quality")) if c is not None))
    given = lambda c, n: None if c is None else F.col(n)
    keyed = _keyed(rows, at(id_col), at(source_col), at(text_col), given(size, "given_size"), given(quality, "given_quality"), seed)
    plan = plan_mix(keyed, weights, share, cap)
    tag = F.struct(F.col("__source").isNull().alias("n"), F.coalesce("__source", F.lit("")).alias("v"))
    joined = keyed.withColumn("__s", tag).join(plan, "__s")
    tests = [
        F.col("__coarse") < F.col("last___coarse"),
        (F.col("__coarse") == F.col("last___coarse")) & (F.col("__fine") < F.col("last___fine")),
        (F.col("__fine") == F.col("last___fine")) & (F.struct("__key", "__row") <= F.col("last_taken")),
    ]
    chosen = F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests)), F.lit(False))
    out = restored(joined.withColumn("copies", F.col("epochs") + chosen.cast("int")), docs.columns, "__size", "source_size", "target", "copies")
    return out.toDF(*docs.columns, *unused(docs, "__size", "source_size", "target", "copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row of docs as often as the mix takes it, with the columns of docs."""
    out = mix(docs, **options)
    rows = numbered(out)
    return restored(rows.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col(rows.columns[-1])))), docs.columns)


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as size, length(text) as chars from documents),
k as (
  select *, -ln((('0x' || md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null'))[1:12])::bigint::double + 1.0) / 281474976710657.0)
    / (case when size > 0 then 1.0::double / (1.0::double + abs(chars::double / size::double - 6.0::double) / 6.0::double) else 1.0::double end) as key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
r as (select *, [5, 2, 1][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as w, (select sum(source_size) from s)::double as total from s),
f as (
  select *, (total * 1.5::double - coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0)::double * 2.0::double)
    / (sum(w) over (o rows between current row and unbounded following))::double as level, row_number() over o as pos
  from r window o as (order by source_size::double * 2.0::double / w asc, source asc nulls last)),
g as (select min_by(level, pos) as lv, min(pos) as first_open from f where level <= source_size::double * 2.0::double / w),
t as (select source, source_size, case when pos >= first_open then w::double * lv else source_size::double * 2.0::double end as target from f, g),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
c as (
  select k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(size) over (partition by k.source order by key, doc_id rows unbounded preceding) as ends
  from k join e on k.source is not distinct from e.source)
select doc_id, size::bigint as size, source_size, target,
  (size * (epochs + case when 2 * ends - size < 2 * rest then 1 else 0 end))::bigint as taken from c
"""
