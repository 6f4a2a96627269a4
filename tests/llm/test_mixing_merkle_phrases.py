"""Mixing, Merkle manifest and phrases against plain Python, with the limits
lowered so that every path runs on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickpair.llm import merkle, mixing, phrases
from clickpair.session import ship_package
from tests.llm.test_llm import SCHEMA, SF, edge_rows


@pytest.fixture(scope="module")
def edge(spark):
    ship_package(spark)
    langs = ["en", None, "und", "é", "de"]
    rows = [(*r, langs[i % 5], None if i % 4 == 0 else i) for i, r in enumerate(edge_rows())]
    names = SCHEMA + ", lang string, n_chars long"
    return spark.createDataFrame(rows, names).withColumn("host", F.lit("clash")).withColumn(
        "size", F.lit(-1)).withColumn("g", F.lit(0)).withColumn("shard", F.lit("s")).withColumn("digest", F.lit("d"))


def given(spark):
    ship_package(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- mixing ---------------------------------------------------------------------

def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair_targets(sizes):
    """Words per source by weight, at most three times its own, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in held)
        among = sum(w for s, w in weight.items() if s not in held)
        out = {s: Fraction(3 * sizes[s]) if s in held else Fraction(left * weight[s], among) for s in order}
        more = {s for s in order if s not in held and out[s] > 3 * sizes[s]}
        if not more:
            return out
        held |= more


def check_mix(rows, got):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    targets = fair_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, n_words(t)) for d, t, _ in rows)
    assert all(0 <= r.taken == r.copies * r.size <= 3 * r.size for r in got)
    want = Counter((d, sizes[s], round(float(targets[s]), 6)) for d, _, s in rows)
    assert Counter((r.doc_id, r.source_size, round(r.target, 6)) for r in got) == want
    return targets


def test_mix_meets_targets(spark, edge):
    for docs in (edge, given(spark)):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        got = mixing.mix(docs).collect()
        check_mix(rows, got)
        again = mixing.mix(docs.repartition(7), task_rows=3).collect()        # more ranges and buckets, same rows
        assert sorted(map(str, got)) == sorted(map(str, again))
    taken, target, biggest = Counter(), {}, Counter()
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        s = by_id[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        biggest[s] = max(biggest[s], r.size)
    assert sum(abs(taken[s] - target[s]) for s in target) < 0.03 * sum(target.values())
    assert all(abs(taken[s] - target[s]) <= 0.06 * target[s] for s in target)


def test_mix_edges(spark, edge):
    assert mixing.mix(edge.limit(0)).count() == 0
    blank = edge.withColumn("text", F.lit(None).cast("string"))
    assert {(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}
    one = edge.where("doc_id = 5").withColumn("text", F.lit("just some words"))
    assert [(r.taken, r.target) for r in mixing.mix(one).collect()] == [(3, 3.0)]


def test_mix_inclusion_follows_the_odds(spark):
    """Over many seeds a document is taken about as often as expected, longer
    ones a little likelier, and the number of picks of a band is fixed."""
    rows = [(i, " ".join(["w"] * (36 + i % 4)), "a") for i in range(40)] + [(i, "w " * 400, "b") for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    times, counts = Counter(), set()
    for seed in range(24):
        got = mixing.mix(docs, weights=(1, 14), seed=seed).where("doc_id < 40").collect()
        for r in got:
            times[r.size] += r.copies
        counts.add(sum(r.copies for r in got))
    share = 9500 / 15 / 1500
    assert len(counts) == 1 and abs(counts.pop() - share * 40) <= 1
    assert all(abs(times[s] / 240 - share) < 0.12 for s in (36, 37, 38, 39))


def test_size_classes(spark):
    sizes = [0, 1, 31, 32, 63, 64, 65, 66, 127, 128, 1000, 20000, 10**9]
    d = spark.createDataFrame([(s,) for s in sizes], "size long").withColumn("c", mixing.size_class(F.col("size")))
    got = {r.size: r.c for r in d.collect()}
    assert [got[s] for s in (0, 31, 32, 63, 64, 65, 66, 127, 128)] == [0, 31, 32, 63, 64, 64, 65, 95, 96]
    w = {r.size: r.w for r in d.where("size > 0").select("size", mixing.class_weight(F.col("c")).alias("w")).collect()}
    assert all(abs(w[s] - 1000 * s ** 0.25) < 0.01 * w[s] + 1 for s in w)


# -- Merkle ---------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H(*x[i:i + 8]) for i in range(0, len(x), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for x in levels[:-1]:
        run = at - at % 8
        out.append((x[run:at], x[at + 1:run + 8]))
        at //= 8
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(r):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    low = lambda t: None if t is None else "".join(c.lower() if c.isascii() else c for c in t)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in by[g]])
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = Counter()
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            path = plain_path(trees[g], i) + plain_path(top, k)
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                seen = (*r[:4], low(r[4]))
            node = leaf(seen)
            for a, b in path:
                node = H(*a, node, *b)
            root = top[-1][0]
            out[r[0], leaf(r), trees[g][-1][0], root, H(*[x for a, b in path for x in (*a, *b)]), node, node == root] += 1
    return out


def test_manifest_matches_plain_trees(spark, edge):
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    for docs, ways in ((edge, ((1, 4), (4, 100_000))), (given(spark), ((1, 30),))):
        want = plain_manifest([tuple(r) for r in docs.select(*cols).collect()])
        for levels, task_rows in ways:
            got = merkle.manifest(docs, changed=merkle.every_third(), levels=levels, task_rows=task_rows)
            assert Counter(tuple(r) for r in got.collect()) == want
    assert not all(k[6] for k in want) and any(k[6] for k in want)


def test_manifest_small_tables(spark, edge):
    assert merkle.manifest(edge.limit(0)).count() == 0
    one = merkle.manifest(edge.where("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H() and one.verified
    many = spark.range(300).selectExpr("id % 2 as doc_id", "'s' as source", "cast(null as string) as lang",
                                       "1L as n_chars", "'same text' as text")
    want = plain_manifest([tuple(r) for r in many.collect()])
    got = merkle.manifest(many, levels=1, task_rows=20, changed=merkle.every_third()).collect()
    assert Counter(tuple(r) for r in got) == want and len(got) == 300


# -- phrases --------------------------------------------------------------------

def plain_phrases(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in cand.items():
            if len(p) == 3:
                inside[p[:2]], inside[p[1:]] = max(inside[p[:2]], a), max(inside[p[1:]], a)
        rows = []
        for p, a in cand.items():
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if len(p) == 3 or not (inside[p] and 100 * inside[p] >= 50 * a):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def test_phrases_match_plain_counts(spark, edge):
    docs = given(spark)
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    want = plain_phrases(rows, 10, 2000)
    assert want and sorted(map(tuple, phrases.phrases(docs).collect())) == want
    # many shards, two united at a time, cut into as many ranges
    small = phrases.phrases(docs.repartition(5), shard_bytes=20_000, fan=2, top=20).collect()
    assert sorted(map(tuple, small)) == plain_phrases(rows, 10, 20)
    rows = [tuple(r) for r in edge.select("lang", "text").collect()]
    got = phrases.phrases(edge, min_count=2, shard_bytes=2000, fan=3, top=None).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 2, None)


def test_phrases_without_words(spark, edge):
    assert phrases.phrases(edge.limit(0)).count() == 0
    assert phrases.phrases(edge.withColumn("text", F.lit(" .\n, "))).count() == 0


def random_counts(rng, n):
    rows = []
    for _ in range(n):
        path = [rng.choice(["en", "fr"])] + [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 3))]
        rows.append((tuple(path), rng.randint(1, 3)))
    cols = [pa.array([p[d].encode() if d < len(p) else None for p, _ in rows], pa.binary()) for d in range(phrases.LEVELS)]
    want = Counter()
    for p, w in rows:
        want[tuple(x.encode() for x in p)] += w
    return phrases.from_rows(cols, np.array([w for _, w in rows])), want


def listed(c):
    return {tuple(phrases._sequence(c, d, i)): int(w) for d, (_, _, ws) in enumerate(c.levels) for i, w in enumerate(ws) if w}


def test_automata():
    rng = random.Random(7)
    for n in (1, 5, 300, 3000):
        parts = [random_counts(rng, n) for _ in range(3)]
        for c, want in parts:
            assert listed(c) == want
            again = phrases.load(phrases.dump(c))
            assert listed(again) == want and again.words.to_pylist() == c.words.to_pylist()
        both, want = phrases.union([c for c, _ in parts]), sum((w for _, w in parts), Counter())
        assert listed(both) == want
        pieces = [p for _, p in both.segments(7)]
        assert sum((Counter(listed(p)) for p in pieces), Counter()) == want
        found = phrases.compose(both, parts[0][0])
        assert {tuple(s): (f, k) for s, f, k in found} == {s: (want[s], k) for s, k in parts[0][1].items()}
    # states with equal continuations are one state
    cols = [pa.array(x, pa.binary()) for x in ([b"en"] * 400, [b"%03d" % (i // 2) for i in range(400)],
                                              [b"x", b"y"] * 200, [b"z"] * 400)]
    shared = phrases.from_rows(cols, np.ones(400, np.int64))
    other = phrases.from_rows([*cols[:3], pa.array([b"%d" % (i * i) for i in range(400)], pa.binary())], np.ones(400, np.int64))
    assert len(phrases.dump(shared)) < len(phrases.dump(other)) / 2


def test_long_texts_are_cut_after_breaks():
    buf = np.frombuffer(b"aa bb. cc dd, ee ff gg hh ii jj kk. x" * 3 + b"tail", np.uint8)
    off = np.array([0, len(buf) - 4, len(buf)])
    cut = list(phrases._slices(buf, off, 16))
    assert b"".join(b.tobytes() for b, _ in cut) == buf.tobytes()
    whole = phrases.count_text(b"en", buf, off)
    parts = [c for b, o in cut if (c := phrases.count_text(b"en", b, o)) is not None]
    assert listed(phrases.union(parts)) == listed(whole)


@pytest.mark.parametrize("name", ["op11_mixing", "op12_merkle", "op13_phrases"])
def test_queries_match_their_sql(spark, name):
    from clickpair.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(tuple, got.select(rel.columns).collect())) == sorted(rel.fetchall())
