"""Vector-space features of a pair: count cosine, Pearson, per-text tf/idf
statistics, and the corpus character TF-IDF.

Per-pair features are computed inside the row: a text is short, all of its
tokens live in one row, and counting there avoids exploding and shuffling
every token of every pair.  The corpus TF-IDF needs document frequencies, so
it is relational: explode distinct n-grams, aggregate, join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickpair.functions.text import tokenize, word_tokens


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count_in(arr: Column, x: Column) -> Column:
    return F.size(F.filter(arr, lambda y: y == x))


def _sum_long(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + f(x))


def lower_tokens(text) -> Column:
    """Lower-cased ``split(' ')`` tokens without the empty token."""
    return F.filter(tokenize(F.lower(_c(text))), lambda x: x != "")


def count_moments(q: Column, t: Column) -> dict[str, Column]:
    """Σx, Σy, Σx², Σy², Σxy and the union size of two token count vectors."""
    return {
        "sx": F.size(q).cast("long"),
        "sy": F.size(t).cast("long"),
        "sxx": _sum_long(q, lambda x: _count_in(q, x)),
        "syy": _sum_long(t, lambda x: _count_in(t, x)),
        "sxy": _sum_long(q, lambda x: _count_in(t, x)),
        "n": F.size(F.array_union(q, t)).cast("long"),
    }


# Texts with more tokens than this (query + title) use the sort-based counts.
SORTED_COUNTS_ABOVE = 64


def add_count_moments(df: DataFrame, q: str, t: str, prefix: str = "_m_") -> DataFrame:
    """Append the count moments of two projected token-array columns.

    Short pairs use the quadratic in-row form of ``count_moments``.  Long
    pairs sort the side-tagged tokens once, find where runs of equal tokens
    start, and count each side inside each run from a slice of the sorted
    array: O(n log n) instead of O(n²).  Every array read inside a lambda is
    a projected column.
    """
    qc, tc = F.col(q), F.col(t)
    long_ = (F.size(qc) + F.size(tc)) > SORTED_COUNTS_ABOVE
    tagged = F.array_sort(F.concat(
        F.transform(qc, lambda x: F.struct(x.alias("tok"), F.lit(0).alias("side"))),
        F.transform(tc, lambda x: F.struct(x.alias("tok"), F.lit(1).alias("side")))))
    d = df.select("*", F.when(long_, tagged).alias("_srt"))
    srt = F.col("_srt")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(srt), F.lit(1))),
                      lambda i: (i == 1) | (F.element_at(srt, i)["tok"]
                                            != F.element_at(srt, F.greatest(i - 1, F.lit(1)))["tok"]))
    d = d.select("*", F.when(F.size(srt) > 0, starts).alias("_st"))
    st, n = F.col("_st"), F.size(srt)
    ends = F.concat(F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0))), F.array(n + 1))
    runs = F.zip_with(st, ends, lambda a, b: F.struct(
        F.size(F.filter(F.slice(srt, a, b - a), lambda e: e["side"] == 0)).cast("long").alias("cq"),
        (b - a).cast("long").alias("len")))
    d = d.select("*", F.when(srt.isNotNull(), runs).alias("_runs"))
    r = F.col("_runs")

    def rsum(f):
        return F.aggregate(r, F.lit(0).cast("long"), lambda acc, x: acc + f(x["cq"], x["len"] - x["cq"]))

    sorted_m = {"sx": F.size(qc).cast("long"), "sy": F.size(tc).cast("long"),
                "sxx": rsum(lambda a, b: a * a), "syy": rsum(lambda a, b: b * b),
                "sxy": rsum(lambda a, b: a * b),
                "n": F.coalesce(F.size(r), F.lit(0)).cast("long")}
    quad_m = count_moments(qc, tc)
    cols = [F.when(long_, F.coalesce(sorted_m[k], F.lit(0).cast("long"))).otherwise(quad_m[k])
            .alias(prefix + k) for k in quad_m]
    return d.select("*", *cols).drop("_srt", "_st", "_runs")


def cosine_from_moments(sxy: Column, sxx: Column, syy: Column) -> Column:
    den = F.sqrt(sxx.cast("double")) * F.sqrt(syy.cast("double"))
    return F.when(den != 0, sxy / den).otherwise(F.lit(0.0))


def pearson_from_moments(m: dict[str, Column]) -> Column:
    """Pearson r over the union vocabulary; NULL where a variance is zero."""
    n, sx, sy, sxx, syy, sxy = (m[k] for k in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    num = n * sxy - sx * sy
    dx = n * sxx - sx * sx
    dy = n * syy - sy * sy
    r = num.cast("double") / F.sqrt(dx.cast("double")) / F.sqrt(dy.cast("double"))
    return F.when((dx > 0) & (dy > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def vector_space_features(df: DataFrame, q: str = "query", t: str = "title",
                          keep=("pair_id",)) -> DataFrame:
    """cosine_similarity (rounded to 2 places, half-even), its raw value, and
    Pearson (NULL where undefined; see ``impute_mean``)."""
    staged = df.select(*keep, lower_tokens(q).alias("_q"), lower_tokens(t).alias("_t"))
    staged = add_count_moments(staged, "_q", "_t", prefix="_")
    mm = {k: F.col("_" + k) for k in ("sx", "sy", "sxx", "syy", "sxy", "n")}
    cos = cosine_from_moments(mm["sxy"], mm["sxx"], mm["syy"])
    return staged.select(
        *keep,
        F.bround(cos, 2).cast("float").alias("cosine_similarity"),
        cos.alias("cosine_similarity_raw"),
        pearson_from_moments(mm).alias("pearson"))


def tfidf_cosine(df: DataFrame, q: str = "query", t: str = "title", keep=("pair_id",)) -> DataFrame:
    """Cosine of word-token (≥2 word characters) counts, rounded to 2 places.

    A TF-IDF fitted on the single document ``q + ' ' + t`` has every idf equal,
    so its cosine is the cosine of raw counts of those tokens.
    """
    staged = df.select(*keep, word_tokens(q).alias("_q"), word_tokens(t).alias("_t"))
    staged = add_count_moments(staged, "_q", "_t", prefix="_m_")
    cos = cosine_from_moments(F.col("_m_sxy"), F.col("_m_sxx"), F.col("_m_syy"))
    staged = staged.select(*keep, cos.alias("cosine_similarity_tfidf_raw"))
    return staged.select(*keep, F.bround("cosine_similarity_tfidf_raw", 2).cast("float")
                         .alias("cosine_similarity_tfidf"), "cosine_similarity_tfidf_raw")


def impute_mean(df: DataFrame, cols) -> DataFrame:
    """Replace NULLs of ``cols`` by the column mean (one struct-valued scalar subquery)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    st = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    d = df.withColumn("_means", st)                               # the subquery appears once
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_means.{c}")) for c in cols}).drop("_means")


def add_run_counts(df: DataFrame, arr: str, out: str) -> DataFrame:
    """Append ``out``: array of struct(token, n), one per distinct element of
    the array column ``arr`` (sorted order), in O(n log n): sort once, find
    where runs of equal elements start, take run lengths."""
    d = df.select("*", F.array_sort(arr).alias("_rs"))
    srt = F.col("_rs")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(srt), F.lit(1))),
                      lambda i: (i == 1) | (F.element_at(srt, i)
                                            != F.element_at(srt, F.greatest(i - 1, F.lit(1)))))
    d = d.select("*", F.when(F.size(srt) > 0, starts)
                 .otherwise(F.array().cast("array<int>")).alias("_rst"))
    st = F.col("_rst")
    ends = F.concat(F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0))), F.array(F.size(srt) + 1))
    runs = F.zip_with(st, ends, lambda a, b: F.struct(F.element_at(srt, a).alias("token"),
                                                      (b - a).alias("n")))
    return d.select("*", runs.alias(out)).drop("_rs", "_rst")


def text_stats_columns(toks: Column, name: str, runs: Column) -> list[Column]:
    """tf, idf and tf·idf of every distinct token of one text: max and mean.

    tf = c/L, idf = log10(L/c) with c the token count and L the token total
    (``split(' ')``, empty token included, case kept).  ``runs`` holds the
    (token, c) pairs from ``add_run_counts``.
    """
    L = F.size(toks).cast("double")
    cs = F.transform(runs, lambda r: r["n"].cast("double"))

    def stats(f):
        # one pass over the counts; L and the number of distinct tokens travel
        # in the accumulator (nothing array-valued is read inside the lambdas)
        init = F.struct(F.lit(float("-inf")).alias("mx"), F.lit(0.0).alias("s"),
                        F.lit(0).alias("k"), L.alias("L"))
        return F.aggregate(
            cs, init,
            lambda a, c: F.struct(F.greatest(a["mx"], f(c, a["L"])).alias("mx"),
                                  (a["s"] + f(c, a["L"])).alias("s"), (a["k"] + 1).alias("k"),
                                  a["L"].alias("L")),
            lambda a: F.struct(a["mx"].alias("mx"), (a["s"] / a["k"]).alias("mean")))

    tf = stats(lambda c, n: c / n)
    idf = stats(lambda c, n: F.log10(n / c))
    tfidf = stats(lambda c, n: (c / n) * F.log10(n / c))
    return [tf["mx"].alias(f"{name}_tf_max"), tf["mean"].alias(f"{name}_tf_mean"),
            idf["mx"].alias(f"{name}_idf_max"), idf["mean"].alias(f"{name}_idf_mean"),
            tfidf["mx"].alias(f"{name}_tfidf_max"), tfidf["mean"].alias(f"{name}_tfidf_mean")]


def text_stats(df: DataFrame, q: str = "query", t: str = "title", keep=("pair_id",)) -> DataFrame:
    """#86-#88 for the query, the title, and ``query + ' ' + title``."""
    toks = df.select(*keep, tokenize(F.col(q)).alias("_tq"), tokenize(F.col(t)).alias("_tt"))
    toks = toks.withColumn("_tqt", F.concat("_tq", "_tt"))     # split(q + ' ' + t)
    for c in ("_tq", "_tt", "_tqt"):
        toks = add_run_counts(toks, c, c + "_runs")
    return toks.select(*keep, *text_stats_columns(F.col("_tq"), "query", F.col("_tq_runs")),
                       *text_stats_columns(F.col("_tt"), "title", F.col("_tt_runs")),
                       *text_stats_columns(F.col("_tqt"), "query_title", F.col("_tqt_runs")))


# ------------------------------------------------------------------ corpus
def normalise_chars(text: Column) -> Column:
    """Lower-cased text with runs of two or more whitespace characters
    collapsed to one space (the character analyzer's preprocessing)."""
    return F.regexp_replace(F.lower(text), "(?U)\\s\\s+", " ")


def char_ngrams(s: Column, n_max: int = 2) -> Column:
    """Distinct character 1..n_max-grams of an already normalised text.

    Characters (code points) are extracted once; an n-gram is ``n`` shifted
    slices zipped together, so the cost is linear in the text length
    (``substring(s, i, n)`` per position would rescan the UTF-8 string).
    """
    chars = F.regexp_extract_all(s, F.lit("(?s)."), 0)

    def grams(n: int) -> Column:
        if n == 1:
            return chars
        k = F.greatest(F.size(chars) - n + 1, F.lit(0))
        g = F.slice(chars, 1, k)
        for off in range(1, n):
            g = F.zip_with(g, F.slice(chars, 1 + off, k), lambda a, b: F.concat(a, b))
        return g

    return F.array_distinct(F.concat(*[grams(n) for n in range(1, n_max + 1)]))


def char_tfidf_stats(df: DataFrame, text, name: str, key: str = "pair_id") -> DataFrame:
    """Corpus TF-IDF over character 1-2-grams, binary tf, smoothed idf
    ``ln((1+N)/(1+df)) + 1``, L2-normalised rows; per row the mean over the
    whole vocabulary (zeros included) and the max weight.

    The vocabulary, N and |V| come from the same column (fit = transform).
    """
    docs = df.select(key, normalise_chars(_c(text)).alias("_txt"))
    grams = docs.select(key, F.explode(char_ngrams(F.col("_txt"))).alias("g"))
    n_docs = docs.agg(F.count(F.lit(1))).scalar()                      # scalar subqueries
    dfreq = grams.groupBy("g").agg(F.count(F.lit(1)).alias("_df"))
    idf = dfreq.select("g", (F.log((1 + n_docs) / (1 + F.col("_df"))) + 1).alias("_idf"))
    vocab = dfreq.agg(F.count(F.lit(1))).scalar()
    per_doc = (grams.join(idf, "g")
               .groupBy(key)
               .agg(F.sum(F.col("_idf") * F.col("_idf")).alias("_ss"),
                    F.sum("_idf").alias("_s"), F.max("_idf").alias("_mx")))
    out = (docs.select(key).join(per_doc, key, "left")
           .select(key,
                   F.coalesce(F.col("_s") / F.sqrt("_ss") / vocab, F.lit(0.0))
                   .alias(f"{name}_tfidfvec_mean"),
                   F.coalesce(F.col("_mx") / F.sqrt("_ss"), F.lit(0.0)).alias(f"{name}_tfidfvec_max")))
    return out
