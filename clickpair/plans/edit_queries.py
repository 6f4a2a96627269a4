"""Registered queries: pair scoring job B, edit and alignment features (§2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.operators import edit as E
from clickpair.plans.catalog import register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.plans.pair_queries import cleaned_pairs
from clickpair.sources.fixtures import dialogue_pairs

_CLEANED = """
cp as (select pair_id, regexp_replace(query, '[^0-9 ]', '', 'g') a,
              regexp_replace(title, '[^0-9 ]', '', 'g') b from basket_pairs)"""

# LCS by rows: new[j] = max(old[j], max over k <= j with b[k] = a[i] of old[k-1] + 1)
_LCS = _CLEANED + """,
dp(pair_id, i, rw) as (
  select pair_id, 0, list_transform(range(0, length(b) + 1), lambda x: 0) from cp
  union all
  select dp.pair_id, dp.i + 1,
    list_transform(range(0, length(cp.b) + 1), lambda j:
      greatest(dp.rw[j + 1], coalesce(list_max(list_transform(
        list_filter(range(1, j + 1), lambda k: substr(cp.b, k, 1) = substr(cp.a, dp.i + 1, 1)),
        lambda k: dp.rw[k] + 1)), 0)))
  from dp join cp on cp.pair_id = dp.pair_id where dp.i < length(cp.a)),
lcs as (select cp.pair_id, cp.a, cp.b, cast(dp.rw[length(cp.b) + 1] as int) l
        from dp join cp on cp.pair_id = dp.pair_id where dp.i = length(cp.a))"""

_JARO = """
cast(case when a = b then 1.0 else jaro_similarity(a, b) end as float)"""
_JW = """
cast(case when a = b then 1.0 else jaro_winkler_similarity(a, b) end as float)"""


def _q(body, extra=_CLEANED, recursive=False):
    return with_fixtures("basket_pairs", body, extra=extra, recursive=recursive)


def _cleaned(spark, sf_dir):
    return cleaned_pairs(spark, sf_dir).select("pair_id", F.col("query").alias("a"),
                                               F.col("title").alias("b"))


@register("levenshtein", _q("select pair_id, cast(levenshtein(a, b) as int) levenshtein from cp"))
def q_levenshtein(spark, sf_dir):
    """#75 unit-cost edit distance (built-in expression)."""
    return _cleaned(spark, sf_dir).select("pair_id", F.levenshtein("a", "b").alias("levenshtein"))


@register("jaro", _q(f"select pair_id, {_JARO} jaro from cp"))
def q_jaro(spark, sf_dir):
    """#78 Jaro similarity."""
    return _cleaned(spark, sf_dir).select("pair_id", E.jaro_udf("a", "b").cast("float").alias("jaro"))


@register("jaro_winkler", _q(f"select pair_id, {_JW} jaro_winkler from cp"))
def q_jaro_winkler(spark, sf_dir):
    """#79 Jaro-Winkler similarity (prefix ≤ 4, weight 0.1, boost above 0.7)."""
    return _cleaned(spark, sf_dir).select(
        "pair_id", E.jaro_winkler_udf("a", "b").cast("float").alias("jaro_winkler"))


@register("jaro_combo", _q(f"""
select pair_id,
  cast((j::double + w::double) / 2 as float) jaroWinkler_jaro_mean,
  cast(j::double * w::double as float) jaroWinkler_jaro_product,
  cast(abs(j::double - w::double) as float) jaroWinkler_jaro_subtraction
from (select pair_id, {_JARO} j, {_JW} w from cp)"""))
def q_jaro_combo(spark, sf_dir):
    """#81 mean, product and absolute difference of Jaro and Jaro-Winkler."""
    d = _cleaned(spark, sf_dir).select("pair_id", E.jaro_udf("a", "b").alias("j"),
                                       E.jaro_winkler_udf("a", "b").alias("w"))
    return d.select("pair_id", *E.combo(F.col("j"), F.col("w"), "jaroWinkler_jaro"))


@register("lcseque_lens", _q("select pair_id, l lcseque_lens from lcs", extra=_LCS, recursive=True))
def q_lcseque_lens(spark, sf_dir):
    """#73 longest common subsequence length."""
    return _cleaned(spark, sf_dir).select("pair_id", E.lcs_seq_udf("a", "b").alias("lcseque_lens"))


@register("lcsubstr_lens", _q("""
select pair_id, cast(coalesce(list_max(flatten(list_transform(range(1, length(a) + 1), lambda i:
         list_transform(range(1, length(a) - i + 2), lambda n:
           case when contains(b, substr(a, i, n)) then n else 0 end)))), 0) as int) lcsubstr_lens
from cp"""))
def q_lcsubstr_lens(spark, sf_dir):
    """#74 longest common substring length."""
    return _cleaned(spark, sf_dir).select("pair_id", E.lcs_substr_udf("a", "b").alias("lcsubstr_lens"))


@register("ratio", _q("""
select pair_id, cast(case when length(a) + length(b) = 0 then 1.0
                     else 2.0 * l / (length(a) + length(b)) end as float) ratio from lcs""",
                      extra=_LCS, recursive=True))
def q_ratio(spark, sf_dir):
    """#76 indel similarity ratio = 2·LCS/(|a|+|b|)."""
    d = _cleaned(spark, sf_dir).withColumn("l", E.lcs_seq_udf("a", "b"))
    return d.select("pair_id", E.ratio_from_lcs(F.col("l"), F.length("a"), F.length("b"))
                    .cast("float").alias("ratio"))


@register("ratio_padded", _q("""
select pair_id, cast(case when length(a) = 0 then length(b) when length(b) = 0 then length(a)
                     else (2.0 + 2.0 * l) / (length(a) + length(b) + 2) end as float) ratio_padded
from lcs""", extra=_LCS, recursive=True))
def q_ratio_padded(spark, sf_dir):
    """#77 the hand-written padded ratio variant."""
    d = _cleaned(spark, sf_dir).withColumn("l", E.lcs_seq_udf("a", "b"))
    return d.select("pair_id", E.ratio_padded_from_lcs(F.col("l"), F.length("a"), F.length("b"))
                    .cast("float").alias("ratio_padded"))


def _seq_ratio_sql(src: str) -> str:
    """CTEs computing ``sr(pair_id, list_dis)`` over ``src(pair_id, a, b)``:
    character LCS of every distinct token pair (recursive rows), a per-pair
    substitution-cost matrix, then the token-level edit distance row by row
    with new[j] = min over k <= j of (c[k] + j - k)."""
    return f"""
tp as (select pair_id, string_split(a, ' ') q, string_split(b, ' ') t from {src}),
tpair as (select distinct tp.q[qi.i] x, tp.t[tk.k] y from tp,
            unnest(generate_series(1, len(tp.q))) qi(i), unnest(generate_series(1, len(tp.t))) tk(k)),
tl(x, y, i, rw) as (
  select x, y, 0, list_transform(range(0, length(y) + 1), lambda z: 0) from tpair
  union all
  select tl.x, tl.y, tl.i + 1,
    list_transform(range(0, length(tl.y) + 1), lambda j:
      greatest(tl.rw[j + 1], coalesce(list_max(list_transform(
        list_filter(range(1, j + 1), lambda k: substr(tl.y, k, 1) = substr(tl.x, tl.i + 1, 1)),
        lambda k: tl.rw[k] + 1)), 0)))
  from tl where tl.i < length(tl.x)),
tcost as (select x, y, case when x = y then 0.0
            else 2.0 * (1.0 - 2.0 * rw[length(y) + 1] / (length(x) + length(y))) end c
          from tl where i = length(x)),
cell as (select tp.pair_id, qi.i, tk.k, tcost.c from tp,
           unnest(generate_series(1, len(tp.q))) qi(i), unnest(generate_series(1, len(tp.t))) tk(k),
           tcost where tcost.x = tp.q[qi.i] and tcost.y = tp.t[tk.k]),
crow as (select pair_id, i, list(c order by k) cr from cell group by pair_id, i),
cmat as (select tp.pair_id, len(tp.q) n1, len(tp.t) n2,
                list(crow.cr order by crow.i) m from tp join crow using (pair_id)
         group by tp.pair_id, len(tp.q), len(tp.t)),
sd(pair_id, i, rw) as (
  select pair_id, 0, list_transform(range(0, n2 + 1), lambda j: j::double) from cmat
  union all
  select sd.pair_id, sd.i + 1,
    list_transform(range(0, cmat.n2 + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k:
      (case when k = 0 then (sd.i + 1)::double
            else least(sd.rw[k + 1] + 1, sd.rw[k] + cmat.m[sd.i + 1][k]) end) + j - k)))
  from sd join cmat using (pair_id) where sd.i < cmat.n1),
sr as (select cmat.pair_id, (cmat.n1 + cmat.n2 - sd.rw[cmat.n2 + 1]) / (cmat.n1 + cmat.n2) list_dis
       from sd join cmat using (pair_id) where sd.i = cmat.n1)"""


@register("list_dis", _q("select pair_id, cast(list_dis as float) list_dis from sr",
                         extra=_CLEANED + "," + _seq_ratio_sql("cp"), recursive=True))
def q_list_dis(spark, sf_dir):
    """#80 token-sequence similarity ratio (token substitution costs 2·(1 − indel ratio))."""
    return _cleaned(spark, sf_dir).select("pair_id", E.seq_ratio_udf("a", "b").cast("float").alias("list_dis"))


def _edit_all_sql(fixture: str, cleaned: bool) -> str:
    """Every §2.9 column over ``fixture``, cleaned to digits or raw."""
    if cleaned:
        src = _CLEANED
    else:
        src = f"\ncp as (select pair_id, query a, title b from {fixture})"
    lcs = _LCS.replace(_CLEANED, src)
    body = f"""
select cp.pair_id, lcs.l lcseque_lens,
  cast(coalesce(list_max(flatten(list_transform(range(1, length(cp.a) + 1), lambda i:
         list_transform(range(1, length(cp.a) - i + 2), lambda n:
           case when contains(cp.b, substr(cp.a, i, n)) then n else 0 end)))), 0) as int) lcsubstr_lens,
  cast(case when length(cp.a) + length(cp.b) = 0 then 1.0
       else 2.0 * lcs.l / (length(cp.a) + length(cp.b)) end as float) ratio,
  cast(case when length(cp.a) = 0 then length(cp.b) when length(cp.b) = 0 then length(cp.a)
       else (2.0 + 2.0 * lcs.l) / (length(cp.a) + length(cp.b) + 2) end as float) ratio_padded,
  {_JARO.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")} jaro,
  {_JW.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")} jaro_winkler,
  cast(levenshtein(cp.a, cp.b) as int) levenshtein,
  cast(sr.list_dis as float) list_dis,
  cast(({_JARO.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")}::double
        + {_JW.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")}::double) / 2 as float) jaroWinkler_jaro_mean,
  cast({_JARO.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")}::double
       * {_JW.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")}::double as float) jaroWinkler_jaro_product,
  cast(abs({_JARO.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")}::double
       - {_JW.strip().replace("a = b", "cp.a = cp.b").replace("(a, b)", "(cp.a, cp.b)")}::double) as float) jaroWinkler_jaro_subtraction
from cp join lcs using (pair_id) left join sr using (pair_id)"""
    return with_fixtures(fixture, body, extra=lcs + "," + _seq_ratio_sql("cp"), recursive=True)


@register("edit_features", _edit_all_sql("basket_pairs", True))
def q_edit_features(spark, sf_dir):
    """§2.9 all at once on the digit-cleaned basket pairs (one Arrow pass)."""
    return E.edit_features(cleaned_pairs(spark, sf_dir))


@register("edit_features_prose")
def q_edit_features_prose(spark, sf_dir):
    """§2.9 on the prose pairs (whole texts), uncleaned.  No oracle:
    DuckDB's levenshtein and Jaro functions count bytes, these count
    characters; tests check the kernels on Unicode text by brute force."""
    return E.edit_features(dialogue_pairs(spark, sf_dir))
