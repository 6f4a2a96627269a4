"""Mixing sources to target weights (operator 11), DataFrame functions only.

1.  Targets.  All words are shared among the sources by weight; a source stops
    at ``max_repeats`` times its own words and the excess is shared again by
    weight until none is above.  Each round is one aggregate over the table of
    sources; numerators and denominators are whole numbers.
2.  Expected copies.  Within a source a document is expected
    min(``max_repeats``, k * fourth root of its size) times, with k such that
    the expected words are the target: long documents are a little likelier.
    Documents meet in size classes (32 a doubling), so a source is solved over
    a short array however many documents it has.
3.  Certain whole copies.  The whole part of the expectation is taken outright;
    the fraction is the inclusion probability of one more copy.
4.  Pareto order sampling.  In each band of sizes (four classes, which differ in
    their probabilities) a fixed number of documents is picked: those with the
    smallest random odds divided by inclusion odds.  The numbers are whole; the
    words that one band gains or lacks by rounding, or by the sizes of its
    picks, pass on to the next smaller band, so that a source ends near its
    target (the last band's error, and one document for a source of few).

A band may hold most of all rows.  Its picks are found by counting the ranks in
buckets (partial aggregation); only the rows of the bucket in which the number
is reached are sorted.  Random numbers are hashes of seed and ``doc_id``:
reruns agree, whatever the partitions.

Edge cases: null or empty text has size 0 and is never taken; a null source is a
source of its own, last in order; rows that share an id share their random
number, and ties go by id (null first) and size, so equal rows are
interchangeable; a source of nothing but empty texts has target 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickpair.llm.common import heavy_join, stored
from clickpair.llm.quality_rules import words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 2026
#: Expected copies are whole multiples of 1 / UNIT.
UNIT = 1 << 16
BAND_CLASSES = 4
#: Sources that one window task numbers, and rows of a rank bucket, about.
TASK_ROWS = 100_000


def size_class(size):
    """Sizes below 32 are classes of their own, then 32 classes a doubling."""
    shift = F.length(F.bin(size)) - 6
    high = F.call_function("shiftright", size, F.greatest(shift, F.lit(0)))
    return F.when(size < 32, size).otherwise(shift * 32 + high).cast("int")


def class_weight(klass):
    """1,000 times the fourth root of a class's least size, rounded down."""
    shift = F.greatest(F.floor(klass / 32).cast("int") - 1, F.lit(0))
    least = F.call_function("shiftleft", (klass - 32 * shift).cast("long"), shift)
    return F.floor(1000 * F.sqrt(F.sqrt(least))).cast("long")


def uniform(id_col, seed: int):
    """(0, 1) from the first 52 bits of md5('<seed>:<id>')."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")).cast("binary").cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``: 0, 1, ... by code point, null ('') last.  Ranges of the
    order are numbered apart and their counts, one row a range, joined back."""
    spark_rows = sources.count()
    order = [F.col("host") == "", F.col("host")]
    ranged = stored(sources.repartitionByRange(max(1, spark_rows // TASK_ROWS), *order).withColumn(
        "part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a range
    firsts = ranged.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(firsts), "part").withColumn(
        "place", F.col("first") + F.col("within")).drop("part", "within", "first")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` (words) to ``host, source_size``."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(numbered(sources).withColumn("weight", weight).drop("place"), "weighted")
    exact = lambda c: (F.lit(str(c)) if isinstance(c, int) else c).cast("decimal(38,0)")
    cap = (F.col("source_size") * max_repeats).cast("decimal(20,0)")
    words, shares = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)),
                              F.coalesce(F.sum("weight"), F.lit(1))).first()
    left, among = words, shares
    while True:
        above = cap * exact(among) < F.col("weight").cast("decimal(4,0)") * exact(left)
        held, out = table.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
                              F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0))).first()
        if (words - int(held), shares - out) == (left, among):
            break
        left, among = words - int(held), shares - out
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(among))
    return table.select("host", "source_size", F.when(above, (F.col("source_size") * max_repeats).cast("double"))
                        .otherwise(share).alias("target"))


def copies_by_class(classes: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """Per (host, class): ``whole`` certain copies and ``part`` / UNIT, the
    probability of one more.  Classes are capped from the largest weight down
    until the rest stays below the cap."""
    c = classes.where("class > 0").withColumn("w", class_weight(F.col("class")))
    per = c.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("class", "n", "s", "w")), asc=False).alias("cs"),
        F.sum(F.col("w") * F.col("s")).alias("ws"))
    state = F.expr(f"""aggregate(cs, named_struct('a', 0L, 'b', ws, 'done', false), (x, c) ->
        if(x.done or coalesce(try_divide(target - cast({max_repeats} * x.a as double), cast(x.b as double)) * c.w, 1e9)
             <= {max_repeats},
           named_struct('a', x.a, 'b', x.b, 'done', true),
           named_struct('a', x.a + c.s, 'b', x.b - c.w * c.s, 'done', false)))""")
    k = F.try_divide(F.col("target") - (F.col("x.a") * max_repeats).cast("double"), F.col("x.b").cast("double"))
    solved = per.join(targets, "host").withColumn("x", state).withColumn("k", k)
    expected = F.least(F.floor(F.coalesce(F.col("k") * F.col("c.w"), F.lit(float(max_repeats))) * UNIT + 0.5),
                       F.lit(max_repeats * UNIT))
    return solved.select("host", "source_size", "target", "k", F.explode("cs").alias("c")).select(
        "host", "c.class", "c.n", "c.s", F.expr(f"c.class div {BAND_CLASSES}").cast("int").alias("band"),
        F.greatest(expected, F.lit(0)).alias("e")).select(
        "host", "class", "n", "s", "band", F.expr(f"e div {UNIT}").alias("whole"), (F.col("e") % UNIT).alias("part"))


def picks_by_band(copies: DataFrame) -> DataFrame:
    """Per (host, band): ``need``, the fixed number of documents to pick, from
    the largest band down with the words left over carried on."""
    bands = copies.where("part > 0").groupBy("host", "band").agg(
        F.sum("n").alias("able"), F.sum(F.col("part") * F.col("n")).alias("l"),
        F.sum(F.col("part") * F.col("s")).alias("v"))
    per = bands.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("band", "able", "l", "v")), asc=False).alias("bs"))
    chain = F.expr(f"""aggregate(bs, named_struct('carry', 0.0D, 'out', cast(array() as array<struct<band:int,need:bigint>>)),
        (x, b) -> element_at(transform(array(cast(b.v as double) / {float(UNIT)}D + x.carry), want ->
          element_at(transform(array(least(b.able, greatest(0L, cast(floor(
              want / (cast(b.v as double) / cast(b.l as double)) + 0.5D) as bigint)))), need ->
            named_struct('carry', want - need * (cast(b.v as double) / cast(b.l as double)),
                         'out', concat(x.out, array(named_struct('band', b.band, 'need', need))))), 1)), 1))""")
    return per.select("host", F.explode(chain["out"]).alias("b")).select("host", "b.band", "b.need").join(
        bands.select("host", "band", "able"), ["host", "band"])


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies``."""
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("host"),
        F.size(words_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).cast("long").alias("size")).withColumn(
        "class", size_class(F.col("size"))), "sizes")
    classes = stored(rows.groupBy("host", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "classes")
    targets = stored(source_targets(classes.groupBy("host").agg(F.sum("s").alias("source_size")), weights, max_repeats),
                     "targets")
    copies = stored(copies_by_class(classes, targets, max_repeats), "copies")
    bands = stored(picks_by_band(copies), "bands")

    # every class with what its documents need; empty texts have none
    plan = classes.select("host", "class", "n").join(targets, "host").join(
        copies.select("host", "class", "band", "whole", "part"), ["host", "class"], "left").select(
        F.concat_ws("|", "class", "host").alias("key"), "n", "source_size", "target", "band",
        F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("part", F.lit(0)).alias("part"))
    spread = heavy_join(rows.withColumn("key", F.concat_ws("|", "class", "host")), plan, "key", "n")
    u, p = F.col("u"), F.col("part")
    ranks = spread.withColumn("u", uniform(F.col("doc_id"), seed)).withColumn(
        "rank", F.when(p > 0, (u * (UNIT - p)) / ((1 - u) * p)))
    buckets = max(1024, rows.count() // task_rows)
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("long")
    ranked = stored(ranks.select("doc_id", "size", "source_size", "target", "whole", "rank", place.alias("bucket"),
                                 F.when(p > 0, F.concat_ws("|", "band", "host")).alias("stratum")), "ranks")

    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.where("stratum is not null").groupBy("stratum", "bucket").count()
    needs = bands.select(F.concat_ws("|", "band", "host").alias("stratum"), "need", "able")
    cuts = stored(counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).join(
        needs, "stratum").where("before < need and need <= before + count").select(
        "stratum", "able", F.col("bucket").alias("cut"), (F.col("need") - F.col("before")).alias("of_cut")), "cuts")

    out = ["doc_id", "size", "source_size", "target"]
    found = heavy_join(ranked.where("stratum is not null"), cuts, "stratum", "able", how="left")
    whole = F.col("whole")
    edge = found.where("bucket = cut").withColumn("k", F.row_number().over(
        Window.partitionBy("stratum").orderBy("rank", F.asc_nulls_first("doc_id"), "size")))
    settled = found.where("cut is null or bucket <> cut").select(
        *out, (whole + F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).cast("long")).alias("copies"))
    taken = settled.unionByName(edge.select(*out, (whole + (F.col("k") <= F.col("of_cut")).cast("long")).alias("copies"))
                                ).unionByName(ranked.where("stratum is null").select(*out, whole.alias("copies")))
    return taken.select(*out, (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"))


SQL = rf"""
with recursive
r as (select doc_id, coalesce('=' || source, '') as host,
        len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size
      from documents),
k as (select *, case when size < 32 then size
        else (length(bin(size)) - 6) * 32 + (size >> (length(bin(size)) - 6)) end as class from r),
o as (select host, sum(size)::bigint as source_size from k group by host),
w as (select *, ([{', '.join(map(str, WEIGHTS))}])[(row_number() over (order by host = '', host) - 1) % {len(WEIGHTS)} + 1]
        as weight from o),
q as (select *, sum(source_size) over () as words, sum(weight) over () as shares,
        row_number() over (order by 30 * source_size // weight, host) as i,
        coalesce(sum({MAX_REPEATS} * source_size) over f, 0) as held, coalesce(sum(weight) over f, 0) as out_
      from w window f as (order by 30 * source_size // weight, host rows between unbounded preceding and 1 preceding)),
v as (select words - held as num, shares - out_ as den from q
      where {MAX_REPEATS} * source_size * (shares - out_) >= (words - held) * weight order by i limit 1),
t as (select host, source_size, case when {MAX_REPEATS} * source_size * den < num * weight
        then ({MAX_REPEATS} * source_size)::double else (weight * num)::double / den::double end as target from w, v),
c as (select host, class, count(*) as n, sum(size)::bigint as s from k where class > 0 group by host, class),
c2 as (select *, floor(1000 * sqrt(sqrt((class - 32 * greatest(class // 32 - 1, 0)) << greatest(class // 32 - 1, 0))))::bigint
        as cw from c),
c3 as (select c2.*, target, row_number() over d as i,
        (target - ({MAX_REPEATS} * coalesce(sum(s) over (d rows between unbounded preceding and 1 preceding), 0))::double)
        / sum(cw * s) over (d rows between current row and unbounded following)::double as kk
       from c2 join t using (host) window d as (partition by host order by class desc)),
kappa as (select host, min_by(kk, i) as kk from c3 where kk * cw <= {MAX_REPEATS} group by host),
e as (select c3.host, class, n, s, class // {BAND_CLASSES} as band,
        greatest(0, least({MAX_REPEATS * UNIT}, floor(coalesce(kappa.kk * cw, {MAX_REPEATS}.0::double) * {UNIT} + 0.5)::bigint))
        as e from c3 left join kappa using (host)),
e2 as (select *, e // {UNIT} as whole, e % {UNIT} as part from e),
b as (select host, band, sum(n)::bigint as able, sum(part * n)::double as l, sum(part * s)::double as v,
        row_number() over (partition by host order by band desc) as i
      from e2 where part > 0 group by host, band),
chain as (
  select host, 0::bigint as i, null::bigint as band, 0::bigint as need, 0::double as carry from (select distinct host from b)
  union all
  select host, i, band, need, want - need * (v / l) from (
    select b.host, b.i, b.band::bigint as band, v, l, v / {UNIT}.0::double + carry as want,
      least(able, greatest(0, floor((v / {UNIT}.0::double + carry) / (v / l) + 0.5)::bigint)) as need
    from b join chain on b.host = chain.host and b.i = chain.i + 1)),
u as (select k.*, source_size, target, coalesce(whole, 0) as whole, coalesce(part, 0) as part, band,
        (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint + 0.5) / {float(1 << 52)}::double as u
      from k join t using (host) left join e2 using (host, class)),
x as (select *, row_number() over (partition by host, band, part > 0
        order by (u * ({UNIT} - part)) / ((1 - u) * part), doc_id nulls first, size) as rn from u)
select x.doc_id, x.size, x.source_size, x.target,
  ((whole + (part > 0 and rn <= coalesce(need, 0))::bigint) * size)::bigint as taken,
  (whole + (part > 0 and rn <= coalesce(need, 0))::bigint)::int as copies
from x left join chain on x.host = chain.host and x.band = chain.band
"""
