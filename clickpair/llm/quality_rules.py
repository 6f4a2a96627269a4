"""Quality rules with host verdicts (operator 5), DataFrame functions only.

Every document gets its base figures and fails the base rules or not; all of
this stays in the row, without a shuffle of texts.  Hosts (``source``) are
then judged together: failures and documents are counted per host (partial
aggregation, so a host with a third of all rows costs nothing extra), the
failure rates of all hosts fit a beta prior by moments, and each host's rate
is shrunk towards it.  The verdict returns by ``heavy_join``.

Edge cases: null text has no words and fails the base rules; a null source is
a host of its own; one host, or hosts with equal rates, have no spread, and
then every host's rate is the mean; an empty table gives an empty result;
repeated rows count as often as they stand there; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import heavy_join, let, stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host whose shrunk failure rate is above this loses its documents.
HOST_LIMIT = 0.5


def words_of(text):
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _covered(positions):
    """Words covered by three-word windows at these sorted positions."""
    gaps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))),
                      lambda a, b: F.when(b.isNull(), 3).otherwise(F.least(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def repeat_words(words):
    """Words in three-word windows that are found twice or more."""
    n = F.size(words)
    tail = lambda k: F.slice(words, k, F.greatest(n - 2, F.lit(0)))
    pairs = F.zip_with(tail(1), tail(2), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, tail(3), lambda h, c: F.xxhash64(h, c))

    def positions(order):
        follows = F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order) - 1, F.lit(0))),
                             lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        return let(follows, lambda f: F.sort_array(F.transform(F.filter(
            F.zip_with(order, F.zip_with(f, F.concat(F.array(F.lit(False)), f), lambda x, y: x | y),
                       lambda o, e: F.struct(o["p"].alias("p"), (e & o["p"].isNotNull()).alias("e"))),
            lambda o: o["e"]), lambda o: o["p"])))

    def count(w):
        order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        some = let(let(order, positions), _covered)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(some)

    return let(windows, count)


def base_figures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    spread = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                         text.alias("text"), words_of(text).alias("words"),
                         F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    return spread.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, repeat_words(F.col("words"))).otherwise(F.lit(0)).cast("long")
        .alias("n_repeat_words"))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, failures, the shrunk rate, and whether it is good."""
    hosts = stored(rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    mean, spread = hosts.agg(F.avg(rate)).scalar(), hosts.agg(F.var_samp(rate)).scalar()
    # strength of the prior, alpha + beta; none if the rates spread more than a beta's can
    strength = F.greatest(mean * (1 - mean) / spread - 1, F.lit(0.0))
    shrunk = F.when(F.coalesce(spread, F.lit(0.0)) == 0, mean).otherwise(
        (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_good", F.col("host_rate") <= limit)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: the base figures, ``base_failed``, the host's
    shrunk failure rate and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stored(base_figures(docs, id_col, text_col, host_col).withColumn("base_failed", failed), "figures")
    hosts = stored(host_verdicts(rows, limit), "verdicts")
    return heavy_join(rows, hosts.select("host", "host_docs", "host_rate", "host_good"), "host",
                      "host_docs").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_good")).alias("kept"), "host_rate")


SQL = rf"""
with t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text,
        list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
      from t),
g as (select doc_id, p, words[p] as a, words[p+1] as b, words[p+2] as c
      from (select doc_id, words, unnest(range(1, len(words) - 1)) as p from w)),
r as (select doc_id, p, count(*) over (partition by doc_id, a, b, c) as n from g),
c as (select doc_id, sum(least(3, coalesce(nx - p, 3))) as n_repeat_words
      from (select doc_id, p, lead(p) over (partition by doc_id order by p) as nx from r where n >= 2)
      group by doc_id),
f as (select w.doc_id, coalesce(w.source, '') || (w.source is null)::varchar as host,
        len(words)::bigint as n_words,
        length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words
      from w left join c using (doc_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from f),
h as (select host, count(*) as n, count_if(base_failed) as k from b group by host),
m as (select avg(k / n) as mean, var_samp(k / n) as spread from h),
s as (select h.host, case when coalesce(spread, 0) = 0 then mean
        else (k + mean * greatest(mean * (1 - mean) / spread - 1, 0))
             / (n + greatest(mean * (1 - mean) / spread - 1, 0)) end as host_rate
      from h, m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed) and host_rate <= {HOST_LIMIT} as kept, host_rate
from b join s using (host)
"""
