"""N-gram Jaccard join with signature trees (operator 4).

A document's set is its distinct five-word shingles (64-bit hashes).  Two
documents link when 100 * intersection >= 80 * union.  The result gives every
document its set's size and its component under these links, without listing
all pairs of a group:

1.  Equal sets are one class; from here on one representative stands for it.
2.  Near copies of one original link to a hub: classes that agree in minima of
    16 parts of the shingle space meet the smallest class of each bucket (one
    pair per class and bucket), and the pairs are verified on whole sets.  This
    step only contracts large groups early; it decides no missing link.
3.  Every remaining link is found exactly.  Shingles are ordered by document
    frequency (counted over all documents; frequent ones last), and by prefix
    filtering two classes that link share one of their first
    n - ceil(0.8 n) + 1 shingles.  The classes of one shingle stand in a
    *signature tree*: its nodes hold OR-combined token bitmaps, size ranges and
    the component where it is one.  A dual traversal descends only into node
    pairs whose maximum possible overlap reaches the required one and which
    are not already in one component.
4.  Surviving pairs are verified on whole sets; components are final then.

Shingles and prefixes shuffle as packed blocks (numpy arrays in binary
columns, keyed by a hash range), not row by row.  A shingle with more than
``BLOCK_ROWS`` classes is dealt to several tasks as pairs of blocks.

Edge cases: null text, and text without words, is an empty set, linked with
nothing; with fewer than five words the whole sequence is the one shingle;
repeated rows fall in one class; a null id is in the component of its set, if
that set also occurs with an id, and links nothing else; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import (_FOLD, components, hand_back, hash_prefix, heavy_join, mix64, row_chunks,
                                  sized, span_hash, stored, text_buffer, word_spans)

GRAM, PERCENT = 5, 80
PARTS = 16                 # minima per sketch
SIG_WORDS = 16             # 64-bit words per signature
LEAF, FANOUT = 24, 6
BLOCK_ROWS = 20_000
#: Frequent shingles that are told apart by their counts, at most.
HOT_SHINGLES = 1 << 18
_U = np.uint64


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, n + 1 offsets): each text's distinct shingles, sorted."""
    start, end, first = word_spans(buf, off)
    words = span_hash(hash_prefix(_FOLD[buf]), start, end)
    n = np.diff(first)
    count = np.where(n >= GRAM, n - GRAM + 1, 0)
    k = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    h = np.zeros(len(k), _U)
    for i in range(GRAM):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + words[k + i])
    doc = np.repeat(np.arange(len(n)), count)
    few = np.flatnonzero((n > 0) & (n < GRAM))
    if len(few):
        whole = np.zeros(len(few), _U) + n[few].astype(_U)
        for i in range(GRAM - 1):
            has = n[few] > i
            whole[has] = mix64(whole[has] * _U(0xC2B2AE3D27D4EB4F) + words[first[few[has]] + i])
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, few))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def set_batches(batches, seen: set | None = None):
    """(batch, row, shingles, class hash) per non-empty text; with ``seen``,
    each class once per task."""
    for batch in batches:
        buf, off = text_buffer(batch.column(1))
        for lo, hi in row_chunks(off, 1 << 19):
            h, at = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = h[a:b]
                node = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
                if seen is not None:
                    if a == b or node in seen:
                        continue
                    seen.add(node)
                yield batch, lo + i, own, node
        del batch, buf, off
        hand_back()


def needed(na, nb):
    """Smallest intersection with 100 * i >= PERCENT * (na + nb - i)."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def describe(rows: DataFrame) -> DataFrame:
    """(doc_id, node, n, signature, minima) per row."""
    def run(batches):
        out: list[tuple] = []
        names = ["doc_id", "node", "n", "signature", "minima"]

        def flush():
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return batch

        for batch, i, own, node in set_batches(batches):
            bits = np.zeros(SIG_WORDS, _U)
            np.bitwise_or.at(bits, (own >> _U(4)).astype(np.int64) % SIG_WORDS, _U(1) << (own >> _U(58)))
            part = (own & _U(PARTS - 1)).astype(np.int64)
            at = np.unique(part, return_index=True)[1]
            minima = mix64(own[at] + part[at].astype(_U)).astype(np.int64).tolist()
            out.append((batch.column(0)[i].as_py(), node, len(own), bits.tobytes(), minima))
            if len(out) >= 4000:
                yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, "doc_id long, node long, n long, signature binary, minima array<long>")


# -- Document frequencies -------------------------------------------------------

def frequent_shingles(rows: DataFrame, blocks: int) -> np.ndarray:
    """Hashes of the most frequent shingles, sorted by (frequency class, hash)
    ascending; at most ``HOT_SHINGLES``.  Counts cover the classes of every task
    and all shingles.  Only the order of shingles depends on them."""
    def emit(batches):
        held, size = [], 0
        seen: set = set()
        for _, _, own, _ in set_batches(batches, seen):
            held.append(own)
            size += len(own)
            if size > 1_000_000:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)
        del held
        hand_back()

    def pack(held):
        token, count = np.unique(np.concatenate(held), return_counts=True)
        block = ((token >> _U(32)) * _U(blocks)) >> _U(32)
        at = np.searchsorted(block, np.arange(blocks + 1).astype(_U))
        for b, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if lo < hi:
                many = count[lo:hi] > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([token[lo:hi][~many].tobytes()], pa.binary()),
                     pa.array([token[lo:hi][many].tobytes()], pa.binary()),
                     pa.array([count[lo:hi][many].astype(np.uint32).tobytes()], pa.binary())],
                    ["block", "once", "tokens", "counts"])

    def count_block(key, table):
        once = np.frombuffer(b"".join(table["once"].to_pylist()), _U)
        many = np.frombuffer(b"".join(table["tokens"].to_pylist()), _U)
        times = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
        token, at = np.unique(np.concatenate((once, many)), return_inverse=True)
        total = np.bincount(at, np.concatenate((np.ones(len(once)), times)))
        level = np.floor(np.log2(total)).astype(np.int64)
        keep = level >= 4                              # 16 classes or more
        return pa.table({"token": token[keep].astype(np.int64), "level": level[keep]})

    hot = stored(rows.mapInArrow(emit, "block int, once binary, tokens binary, counts binary").groupBy(
        "block").applyInArrow(count_block, "token long, level long"), "frequent")
    levels = sorted(((r["level"], r["count"]) for r in hot.groupBy("level").count().collect()), reverse=True)
    least, total = None, 0
    for level, count in levels:
        if total + count > HOT_SHINGLES:
            break
        least, total = level, total + count
    if least is None:
        return np.zeros(0, _U)
    chosen = hot.where(F.col("level") >= least).collect()      # bounded by HOT_SHINGLES
    token = np.array([r["token"] for r in chosen], np.int64).astype(_U)
    level = np.array([r["level"] for r in chosen], np.int64)
    return token[np.lexsort((token, level))]


# -- Prefixes -------------------------------------------------------------------

def shared_prefixes(rows: DataFrame, hot: np.ndarray, blocks: int) -> DataFrame:
    """(token, node, place): prefix shingles that two or more classes have."""
    by_hash = np.argsort(hot)
    shared = rows.sparkSession.sparkContext.broadcast((hot[by_hash], by_hash.astype(np.int64)))

    def emit(batches):
        sorted_hot, rank = shared.value
        tokens, nodes, places, size = [], [], [], 0
        seen: set = set()
        for _, _, own, node in set_batches(batches, seen):
            k = prefix_length(len(own))
            if len(sorted_hot):
                at = np.minimum(np.searchsorted(sorted_hot, own), len(sorted_hot) - 1)
                late = sorted_hot[at] == own
                cold = own[~late]
                if len(cold) < k:
                    cold = np.concatenate((cold, own[late][np.argsort(rank[at[late]])]))
                own = cold
            tokens.append(own[:k])
            nodes.append(np.full(k, node, np.int64))
            places.append(np.minimum(np.arange(k), 65535).astype(np.uint16))
            size += k
            if size > 1_000_000:
                yield from pack(tokens, nodes, places)
                tokens, nodes, places, size = [], [], [], 0
        if size:
            yield from pack(tokens, nodes, places)
        del tokens, nodes, places
        hand_back()

    def pack(tokens, nodes, places):
        token, node, place = map(np.concatenate, (tokens, nodes, places))
        block = ((token >> _U(32)) * _U(blocks)) >> _U(32)
        order = np.argsort(block, kind="stable")
        at = np.searchsorted(block[order], np.arange(blocks + 1).astype(_U))
        for b, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if lo < hi:
                some = order[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), *[pa.array([x[some].tobytes()], pa.binary())
                                                  for x in (token, node, place)]],
                    ["block", "tokens", "nodes", "places"])

    def meet(key, table):
        token = np.frombuffer(b"".join(table["tokens"].to_pylist()), _U)
        node = np.frombuffer(b"".join(table["nodes"].to_pylist()), np.int64)
        place = np.frombuffer(b"".join(table["places"].to_pylist()), np.uint16)
        order = np.lexsort((node, token))
        token, node, place = token[order], node[order], place[order]
        new = np.ones(len(token), bool)                # a class may come from several tasks
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, place = token[new], node[new], place[new]
        same = token[1:] == token[:-1]
        many = np.append(same, False) | np.append(False, same) if len(token) else same
        return pa.table({"token": token[many].astype(np.int64), "node": node[many],
                         "place": place[many].astype(np.int64)})

    return rows.mapInArrow(emit, "block int, tokens binary, nodes binary, places binary").groupBy(
        "block").applyInArrow(meet, "token long, node long, place long")


# -- Signature trees --------------------------------------------------------------

class SignatureTree:
    """Levels of nodes over rows sorted by size: ranges of rows, their smallest
    and largest size, their component (-1 where they differ; ids are >= 0 in
    ``group``), OR of the bitmaps, and the most shingles that share a bit."""

    def __init__(self, n: np.ndarray, group: np.ndarray, sig: np.ndarray):
        self.slack = n - np.bitwise_count(sig).sum(1).astype(np.int64)
        lo = np.arange(0, len(n), LEAF)
        hi = np.minimum(lo + LEAF, len(n))
        reduce = lambda f, x, at: f.reduceat(x, at, axis=0)
        low, high = reduce(np.minimum, group, lo), reduce(np.maximum, group, lo)
        level = {"lo": lo, "hi": hi, "nmin": n[lo], "nmax": n[hi - 1], "group": np.where(low == high, low, -1),
                 "sig": reduce(np.bitwise_or, sig, lo), "slack": reduce(np.maximum, self.slack, lo)}
        self.levels = [level]
        while len(level["lo"]) > 1:
            at = np.arange(0, len(level["lo"]), FANOUT)
            low = reduce(np.minimum, level["group"], at)
            high = reduce(np.maximum, level["group"], at)
            last = np.minimum(at + FANOUT, len(level["lo"])) - 1
            level = {"lo": level["lo"][at], "hi": level["hi"][last], "nmin": level["nmin"][at],
                     "nmax": level["nmax"][last], "group": np.where(low == high, low, -1),
                     "sig": reduce(np.bitwise_or, level["sig"], at), "slack": reduce(np.maximum, level["slack"], at)}
            self.levels.append(level)


def may_link(x: dict, i: np.ndarray, y: dict, j: np.ndarray) -> np.ndarray:
    """Node pairs (rows have nmin = nmax) whose maximum possible overlap
    reaches the required one, and that are not one component already."""
    one = (x["group"][i] >= 0) & (x["group"][i] == y["group"][j])
    bits = np.bitwise_count(x["sig"][i] & y["sig"][j]).sum(1).astype(np.int64)
    most = np.minimum(bits + np.minimum(x["slack"][i], y["slack"][j]),
                      np.minimum(x["nmax"][i], y["nmax"][j]))
    return ~one & (most >= needed(x["nmin"][i], y["nmin"][j]))


def tree_pairs(n, place, group, sig, side=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that may link, by dual traversal.  With ``side`` (0/1) only
    pairs across the two sides count."""
    order = np.argsort(n, kind="stable")
    n, place, group, sig = n[order], place[order], group[order], sig[order]
    side = None if side is None else side[order]
    _, group = np.unique(group, return_inverse=True)
    tree = SignatureTree(n, group, sig)
    i = j = np.zeros(1, np.int64)
    for depth in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[depth]
        ok = may_link(level, i, level, j)
        i, j = i[ok], j[ok]
        if depth:
            below = len(tree.levels[depth - 1]["lo"])
            f = np.arange(FANOUT)
            a = (i[:, None, None] * FANOUT + f[None, :, None] + 0 * f[None, None, :]).ravel()
            b = (j[:, None, None] * FANOUT + 0 * f[None, :, None] + f[None, None, :]).ravel()
            ok = (a < below) & (b < below) & (a <= b)
            i, j = a[ok], b[ok]
    rows = {"group": group, "sig": sig, "slack": tree.slack, "nmin": n, "nmax": n}
    found_a, found_b = [], []
    f = np.arange(LEAF)
    for lo in range(0, len(i), 500):                     # leaves against leaves
        p, q = i[lo:lo + 500], j[lo:lo + 500]
        a = (p[:, None, None] * LEAF + f[None, :, None] + 0 * f[None, None, :]).ravel()
        b = (q[:, None, None] * LEAF + 0 * f[None, :, None] + f[None, None, :]).ravel()
        ok = (b < len(n)) & (a < b)
        a, b = a[ok], b[ok]
        if side is not None:
            ok = side[a] != side[b]
            a, b = a[ok], b[ok]
        rest = 1 + np.minimum(n[a] - place[a] - 1, n[b] - place[b] - 1)   # if first in common here
        first = (rest >= needed(n[a], n[b])) | (place[a] >= 65535) | (place[b] >= 65535)
        a, b = a[first], b[first]
        ok = may_link(rows, a, rows, b)
        found_a.append(a[ok])
        found_b.append(b[ok])
    cat = lambda x: order[np.concatenate(x)] if x else np.zeros(0, np.int64)
    return cat(found_a), cat(found_b)


def bucket_pairs(postings: DataFrame) -> DataFrame:
    """(a, b) class pairs of every bucket that the trees cannot rule out.
    ``postings``: bucket, side, node, rep, label, n, place, signature."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("bucket")
            last = key[-1].as_py()
            if key[0].as_py() == last and held and held[-1].column("bucket")[-1].as_py() == last:
                held.append(batch)
                continue
            cut = int(np.searchsorted(key.to_numpy(zero_copy_only=False) == last, True))
            yield from solve([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        yield from solve(held)

    def solve(parts):
        if not sum(p.num_rows for p in parts):
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        col = {c: t[c].to_numpy() for c in ("bucket", "side", "rep", "label", "n", "place")}
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), _U).reshape(-1, SIG_WORDS)
        edge = np.flatnonzero(np.append(True, col["bucket"][1:] != col["bucket"][:-1]))
        found: list[np.ndarray] = []
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(sig)]):
            s = slice(lo, hi)
            two = col["side"][s] if (col["side"][s] != 0).any() else None
            a, b = tree_pairs(col["n"][s], col["place"][s], col["label"][s], sig[s], two)
            if len(a):
                x, y = col["rep"][s][a], col["rep"][s][b]
                found.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return postings.mapInArrow(run, "a long, b long").distinct()


# -- Verification -----------------------------------------------------------------

def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids whose whole sets link.  ``pairs`` is
    stored; only texts in some pair are read out and shuffled.  Where an id
    stands on several texts, each of its sets counts: a pair may come more than
    once, and links if any of the texts do."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("uses"))
    ends = stored(ends, "pair-ends")

    def sets(batches):
        for batch, i, own, node in set_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), pa.array([node], pa.int64()), batch.column(2).slice(i, 1),
                 pa.array([own.tobytes()], pa.binary())], ["doc_id", "node", "uses", "tokens"])

    kept = rows.join(sized(ends), "doc_id").select("doc_id", "text", "uses").mapInArrow(
        sets, "doc_id long, node long, uses long, tokens binary").dropDuplicates(["doc_id", "node"])
    kept = stored(kept, "pair-sets")
    left = kept.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"), "uses")
    right = kept.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = heavy_join(pairs, left, "a", "uses").select("a", "b", "ta").join(right, "b")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def hub_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): classes and the smallest class that agrees with them in many minima."""
    minima = reps.select(F.col("rep").alias("b"), F.explode("minima").alias("m"), F.size("minima").alias("size"))
    hubs = stored(minima.groupBy("m").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("df")).where("df > 1"),
                  "hubs")
    return heavy_join(minima, hubs, "m", "df").where("a < b").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("agree"), F.max("size").alias("size")).where("5 * agree >= 2 * size").select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = stored(describe(rows), "sets")
    named = known.where("n > 0 and doc_id is not null")
    reps = stored(named.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("signature").alias("signature"),
        F.max("minima").alias("minima"), F.count(F.lit(1)).alias("copies")), "classes")
    stars = stored(hub_pairs(reps), "hub-pairs")
    links = stored(verified(stars, rows), "hub-links")
    early = components(links)
    shingles = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(8, int(shingles // 1_000_000))
    named_rows = rows.where("doc_id is not null")
    hot = frequent_shingles(named_rows, blocks)
    postings = stored(shared_prefixes(named_rows, hot, blocks), "postings")
    grouped = reps.join(sized(early).select(F.col("id").alias("rep"), "label"), "rep", "left").select(
        "node", "rep", "n", "signature", F.coalesce("label", "rep").alias("label"))
    grouped = stored(grouped, "grouped")
    narrow = postings.join(sized(grouped.select("node", "label")), "node")
    mixed = stored(narrow.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("lo"),
                                               F.max("label").alias("hi")).where("lo < hi").select("token", "df"),
                   "mixed")
    in_mixed = heavy_join(postings, mixed, "token", "df").join(grouped, "node")
    # a large bucket is dealt out as pairs of blocks (i, j), i <= j
    parts = F.ceil(F.col("df") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = in_mixed.withColumn("parts", parts).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "bucket", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))).withColumn(
        "side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
    ordered = dealt.select("bucket", "side", "rep", "label", "n", "place", "signature").repartition(
        "bucket").sortWithinPartitions("bucket")
    more = stored(bucket_pairs(ordered), "tree-pairs")
    late = stored(verified(more, rows), "tree-links")
    final = components(links.unionByName(late))
    label = reps.join(sized(final).select(F.col("id").alias("rep"), "label"), "rep", "left").select(
        "node", F.coalesce("label", "rep").alias("component_id"), "copies")
    label = stored(label, "labels")
    full = heavy_join(known.where("n > 0"), label, "node", "copies", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(known.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
