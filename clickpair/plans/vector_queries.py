"""Registered queries: vector-space features (§2.10) and vector distances (§2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.functions.vectors import DISTANCES, minmax_shift, with_distances
from clickpair.operators import vectorspace as vs
from clickpair.plans.catalog import register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.plans.pair_queries import cleaned_pairs
from clickpair.sources.fixtures import dialogue_pairs, vector_pairs

# ----------------------------------------------------------------- SQL parts
_CLEANED = """
cp as (select pair_id, regexp_replace(query, '[^0-9 ]', '', 'g') query,
              regexp_replace(title, '[^0-9 ]', '', 'g') title from basket_pairs)"""


def _moments_sql(src: str, tok: str) -> str:
    """Per pair Σx Σy Σx² Σy² Σxy n of the count vectors of two token lists."""
    return f"""
tk as (select pair_id, {tok.format(c='query')} q, {tok.format(c='title')} t from {src}),
mo as (select pair_id,
         len(q) sx, len(t) sy,
         list_sum(list_transform(q, lambda x: len(list_filter(q, lambda y: y = x)))) sxx,
         list_sum(list_transform(t, lambda x: len(list_filter(t, lambda y: y = x)))) syy,
         list_sum(list_transform(q, lambda x: len(list_filter(t, lambda y: y = x)))) sxy,
         len(list_distinct(list_concat(q, t))) n
       from tk),
cs as (select *,
         case when sqrt(coalesce(sxx, 0)) * sqrt(coalesce(syy, 0)) <> 0
              then sxy / (sqrt(sxx) * sqrt(syy)) else 0.0 end cos_raw,
         n * sxx - sx * sx dx, n * syy - sy * sy dy
       from mo),
pe as (select *, case when dx > 0 and dy > 0 then
         greatest(-1.0, least(1.0, (n * sxy - sx * sy) / sqrt(dx) / sqrt(dy))) end pearson_raw
       from cs)"""


_LOWER_TOK = "list_filter(string_split(lower({c}), ' '), lambda x: x <> '')"
_WORD_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"

COS_SQL = with_fixtures("basket_pairs", """
select pair_id, cast(round_even(cos_raw, 2) as float) cosine_similarity,
       cos_raw cosine_similarity_raw from pe""", extra=_CLEANED + "," + _moments_sql("cp", _LOWER_TOK))

PEARSON_SQL = with_fixtures("basket_pairs", "select pair_id, pearson_raw pearson from pe",
                            extra=_CLEANED + "," + _moments_sql("cp", _LOWER_TOK))

IMPUTE_SQL = with_fixtures("basket_pairs", """
select pair_id, cast(coalesce(pearson_raw, avg(pearson_raw) over ()) as float) pearson from pe""",
                           extra=_CLEANED + "," + _moments_sql("cp", _LOWER_TOK))

COMBO_SQL = with_fixtures("basket_pairs", """
select pair_id,
  cast((p::double + c::double) / 2 as float) cosine_similarity_pearson_mean,
  cast(p::double * c::double as float) cosine_similarity_pearson_product,
  cast(abs(p::double - c::double) as float) cosine_similarity_pearson_subtraction
from (select pair_id, cast(coalesce(pearson_raw, avg(pearson_raw) over ()) as float) p,
             cast(round_even(cos_raw, 2) as float) c from pe)""",
                          extra=_CLEANED + "," + _moments_sql("cp", _LOWER_TOK))

TFIDF_COS_SQL = with_fixtures("dialogue_pairs", """
select pair_id, cast(round_even(cos_raw, 2) as float) cosine_similarity_tfidf,
       cos_raw cosine_similarity_tfidf_raw from pe""",
                              extra=_moments_sql("dialogue_pairs", _WORD_TOK))


def _text_stats_sql(kind: str) -> str:
    def cols(expr, name):
        toks = f"string_split({expr}, ' ')"
        L = f"len({toks})::double"
        cs = f"list_transform(list_distinct({toks}), lambda x: len(list_filter({toks}, lambda y: y = x))::double)"
        f = {"tf": f"c / {L}", "idf": f"log10({L} / c)", "tfidf": f"(c / {L}) * log10({L} / c)"}[kind]
        arr = f"list_transform({cs}, lambda c: {f})"
        return (f"list_max({arr}) {name}_{kind}_max, list_sum({arr}) / len({arr}) {name}_{kind}_mean")
    body = ", ".join([cols("query", "query"), cols("title", "title"),
                      cols("query || ' ' || title", "query_title")])
    return with_fixtures("basket_pairs", f"select pair_id, {body} from cp", extra=_CLEANED)


def _char_tfidf_sql(text_expr: str, name: str) -> str:
    return with_fixtures("dialogue_pairs", f"""
select d.pair_id, coalesce(sw / sqrt(ss) / V, 0.0) {name}_tfidfvec_mean,
       coalesce(mx / sqrt(ss), 0.0) {name}_tfidfvec_max
from d left join pd using (pair_id) cross join v""", extra=f"""
d as (select pair_id, regexp_replace(lower({text_expr}), '[\\s\\x0b\\x{{85}}\\p{{Z}}]{{2,}}', ' ', 'g') s from dialogue_pairs),
gr as (select pair_id, unnest(list_distinct(list_concat(
          list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)),
          list_transform(range(1, length(s)), lambda i: substr(s, i, 2))))) g from d),
nd as (select count(*) N from d),
dfq as (select g, count(*) df from gr group by g),
idf as (select g, ln((1 + N) / (1 + df)) + 1 idf from dfq cross join nd),
v as (select count(*) V from dfq),
pd as (select pair_id, sum(idf * idf) ss, sum(idf) sw, max(idf) mx from gr join idf using (g) group by pair_id)""")


# ----------------------------------------------------------------- queries
@register("cosine_similarity", COS_SQL)
def q_cosine_similarity(spark, sf_dir):
    """#82 cosine of lower-cased token counts, rounded to 2 places."""
    return vs.vector_space_features(cleaned_pairs(spark, sf_dir)).select(
        "pair_id", "cosine_similarity", "cosine_similarity_raw")


@register("pearson", PEARSON_SQL)
def q_pearson(spark, sf_dir):
    """#84 Pearson r of the count vectors; NULL where undefined."""
    return vs.vector_space_features(cleaned_pairs(spark, sf_dir)).select("pair_id", "pearson")


@register("impute_mean", IMPUTE_SQL)
def q_impute_mean(spark, sf_dir):
    """#13 Pearson with undefined values replaced by the column mean."""
    p = vs.vector_space_features(cleaned_pairs(spark, sf_dir)).select("pair_id", "pearson")
    return vs.impute_mean(p, "pearson").select("pair_id", F.col("pearson").cast("float").alias("pearson"))


@register("cos_pearson_combo", COMBO_SQL)
def q_cos_pearson_combo(spark, sf_dir):
    """#85 mean, product and absolute difference of Pearson and cosine."""
    f = vs.vector_space_features(cleaned_pairs(spark, sf_dir))
    f = vs.impute_mean(f, "pearson")
    p = F.col("pearson").cast("float").cast("double")
    c = F.col("cosine_similarity").cast("double")
    return f.select("pair_id",
                    ((p + c) / 2).cast("float").alias("cosine_similarity_pearson_mean"),
                    (p * c).cast("float").alias("cosine_similarity_pearson_product"),
                    F.abs(p - c).cast("float").alias("cosine_similarity_pearson_subtraction"))


@register("cosine_similarity_tfidf", TFIDF_COS_SQL)
def q_cosine_tfidf(spark, sf_dir):
    """#83 single-document TF-IDF cosine on prose pairs."""
    return vs.tfidf_cosine(dialogue_pairs(spark, sf_dir))


def _stats_query(kind):
    def q(spark, sf_dir):
        s = vs.text_stats(cleaned_pairs(spark, sf_dir))
        return s.select("pair_id", *[c for c in s.columns if c.endswith((f"_{kind}_max", f"_{kind}_mean"))
                                     and c.rsplit("_", 2)[-2] == kind])
    return q


for _k in ("tf", "idf", "tfidf"):
    register(f"{_k}_stats", _text_stats_sql(_k))(_stats_query(_k))


@register("char_tfidf_title", _char_tfidf_sql("title", "title"))
def q_char_tfidf_title(spark, sf_dir):
    """#89 corpus character TF-IDF of titles: mean and max weight per row."""
    return vs.char_tfidf_stats(dialogue_pairs(spark, sf_dir), "title", "title")


@register("char_tfidf_pair", _char_tfidf_sql("query || ' ' || title", "query_title"))
def q_char_tfidf_pair(spark, sf_dir):
    """#89 the same over ``query + ' ' + title``."""
    d = dialogue_pairs(spark, sf_dir)
    return vs.char_tfidf_stats(d, F.concat_ws(" ", "query", "title"), "query_title")


# ----------------------------------------------------------------- distances
def _dist_sql(fixture: str = "vector_pairs", prelude: str | None = None) -> str:
    """Distance family over ``sc(pair_id, label, x, y)``; ``prelude`` defines ``sc``."""
    def S(e):
        return f"list_sum(list_transform(range(1, len(x) + 1), lambda i: {e}))"
    a, b = "x[i]", "y[i]"
    man = S(f"abs({a} - {b})")
    plus = S(f"{a} + {b}")
    exprs = {
        "cosine_w2v": f"case when sqrt({S(f'{a} * {a}')}) <> 0 and sqrt({S(f'{b} * {b}')}) <> 0 "
                      f"then {S(f'{a} * {b}')} / (sqrt({S(f'{a} * {a}')}) * sqrt({S(f'{b} * {b}')})) else 0.0 end",
        "manhattan": man,
        "euclidean": f"sqrt({S(f'({a} - {b}) * ({a} - {b})')})",
        "chebyshev": f"list_max(list_transform(range(1, len(x) + 1), lambda i: abs({a} - {b})))",
        "sorensen": f"{S(f'{a} - {b}')} / nullif({plus}, 0)",
        "gower": f"{man} / len(x)",
        "soergel": f"{man} / nullif({S(a)} - len(x) * list_min(y), 0)",
        "intersection": f"{man} / 2",
        "wave_hedges": S(f"abs({a} - {b}) / greatest({a}, {b})"),
        "czekanowski": f"{man} / nullif({plus}, 0)",
        "motyka": f"{S(f'greatest({a}, {b})')} / nullif({plus}, 0)",
        "kulczynski": f"{S(f'least({a}, {b})')} / nullif({plus}, 0)",
        "ruzicka": f"{S(f'least({a}, {b})')} / nullif({S(f'greatest({a}, {b})')}, 0)",
        "kullback_leibler": S(f"{a} * ln({a} / {b})"),
        "jeffreys": S(f"({a} - {b}) * ln({a} / {b})"),
        "k_divergence": S(f"{a} * ln(2 * {a} / ({a} + {b}))"),
        "topsoe": S(f"{a} * ln(2 * {a} / ({a} + {b})) + {b} * ln(2 * {b} / ({a} + {b}))"),
        "jensen_shannon": f"({S(f'{a} * ln(2 * {a} / ({a} + {b}))')} + {S(f'{b} * ln(2 * {b} / ({a} + {b}))')}) / 2",
        "jensen_difference": S(f"({a} * ln({a}) + {b} * ln({b})) - (({a} + {b}) / 2) * ln(({a} + {b}) / 2)"),
    }
    assert list(exprs) == list(DISTANCES)
    body = ",\n  ".join(f"{e} {n}" for n, e in exprs.items())
    return with_fixtures(fixture, f"select pair_id, label,\n  {body}\nfrom sc",
                         extra=prelude or """
sc as (select pair_id, label,
  case when list_max(x_raw) > list_min(x_raw) then list_transform(x_raw, lambda v:
    (v::double - list_min(x_raw)::double) / (list_max(x_raw)::double - list_min(x_raw)::double) + 1) end x,
  case when list_max(y_raw) > list_min(y_raw) then list_transform(y_raw, lambda v:
    (v::double - list_min(y_raw)::double) / (list_max(y_raw)::double - list_min(y_raw)::double) + 1) end y
  from vector_pairs)""")


@register("vector_distances", _dist_sql())
def q_vector_distances(spark, sf_dir):
    """#96-#114 on min-max shifted embedding pairs (F5);
    a constant vector gives NULL distances (cosine 0)."""
    v = vector_pairs(spark, sf_dir).select("pair_id", "label", minmax_shift("x_raw").alias("x"),
                                           minmax_shift("y_raw").alias("y"))
    return with_distances(v, "x", "y", keep=["pair_id", "label"])
