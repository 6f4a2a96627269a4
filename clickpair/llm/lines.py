"""Line dedup by pairwise alignment (operator 3).

1.  Lines are hashed; a line with words that stands in two or more documents is
    shared, and its holder with the smallest id is its first holder.
2.  A document is paired with the first holders of its shared lines and of its
    shared runs: at most one pair per line and document, never the pairs within
    a group.  A line or run in at most ``rare`` documents pairs each of them with
    every earlier one, so at most ``rare`` - 1 pairs per line and document.  A run is the shortest sequence of two or more lines from some line
    on that has ``min_chars`` characters.  A common block starts with such a run
    or with one line of that length, so a passage of short frequent lines finds
    its first holder too, however many documents hold it.
3.  Each pair is aligned by patience diff (unique common lines, longest
    increasing run, recursion between its anchors; equal ends match).
4.  Runs of aligned lines with ``min_chars`` characters or more are deleted
    from the later document.

Line hashes (8 bytes) shuffle, not texts; the first holder's lines reach its
pairs by ``heavy_join``, since one original may have very many copies.

Edge cases: null text is the empty text; null ids hold no lines and keep their
text; of rows with one id all are cut alike, against lower ids only; a text whose
lines all go becomes empty; white-space lines never match but stay; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import BROADCAST_BYTES, _powers, heavy_join, let, mix64, stored

RARE, MIN_CHARS = 8, 40


def unique_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Lines that stand once in ``a`` and once in ``b``, in the longest run
    that ascends in both (patience sorting)."""
    def once(x):
        at: dict = {}
        for i, v in enumerate(x):
            at[v] = -1 if v in at else i
        return at
    in_a, in_b = once(a), once(b)
    pairs = [(i, in_b[v]) for v, i in in_a.items() if i >= 0 and in_b.get(v, -1) >= 0]
    tops: list[int] = []
    top_at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):            # dict order: ascending in a
        p = bisect_left(tops, j)
        back.append(top_at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[p], top_at[p] = j, k
    run, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        run.append(pairs[k])
        k = back[k]
    return run[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two line sequences, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = [(a0 + i, b0 + j) for i, j in unique_matches(a[a0:a1], b[b0:b1])]
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(out)


def aligned_blocks(a: list, b: list, chars: list, min_chars: int) -> list[int]:
    """Positions of ``b`` in common blocks with enough characters."""
    out, block = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(chars[y] for _, y in block) >= min_chars:
                out += [y for _, y in block]
            block = []
        block.append((i, j))
    return out


def run_keys(lines: np.ndarray, chars: np.ndarray, off: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): per document, its runs of two or more lines."""
    size = np.concatenate(([0], np.cumsum(chars, dtype=np.int64)))
    power, inverse = _powers(len(lines))
    total = np.zeros(len(lines) + 1, np.uint64)
    np.cumsum(mix64(lines.astype(np.uint64)) * power[:len(lines)], out=total[1:])
    start = np.arange(len(lines))
    end = np.searchsorted(size, size[:-1] + min_chars)
    ok = (end > start + 1) & (end <= np.repeat(off[1:], np.diff(off)))
    start, end = start[ok], end[ok]
    return mix64((total[end] - total[start]) * inverse[start]).astype(np.int64), np.searchsorted(start, off)


def line_dedup(docs: DataFrame, rare: int = RARE, min_chars: int = MIN_CHARS,
               id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, text`` without the deleted lines,
    ``n_lines``, ``n_deleted``, and on request ``rest``, a struct of the other
    columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *([others.alias("rest")] if carry else []))
    solid = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = stored(source.where("doc_id is not null").select("doc_id", solid.alias("s")).select(
        "doc_id", F.transform("s", lambda x: F.xxhash64(x)).alias("lines"),
        F.transform("s", lambda x: F.length(x)).alias("chars")).groupBy("doc_id").agg(
        F.min_by("lines", F.size("lines")).alias("lines"), F.min_by("chars", F.size("lines")).alias("chars")),
        "lines")
    kind = hashed.schema["doc_id"].dataType.simpleString()

    def runs(batches):
        for batch in batches:
            found, at = run_keys(batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(),
                                 np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy())), min_chars)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))],
                ["doc_id", "lines", "runs"])

    keyed = hashed.mapInArrow(runs, f"doc_id {kind}, lines array<long>, runs array<long>")
    held = stored(keyed.select("doc_id", F.explode(F.array_distinct(F.concat("lines", "runs"))).alias("line")),
                  "held-lines")
    shared = stored(held.groupBy("line").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("df")).where(
        "df > 1"), "shared-lines")
    often = heavy_join(held, shared.where(F.col("df") > rare), "line", "df").where("first < doc_id").select(
        "doc_id", "first")
    few = held.join(shared.where(F.col("df") <= rare).select("line"), "line").groupBy("line").agg(
        F.sort_array(F.collect_list("doc_id")).alias("ids"))
    few = few.select("ids", F.posexplode("ids").alias("k", "doc_id")).where("k > 0").select(
        "doc_id", F.explode(F.slice("ids", F.lit(1), F.col("k"))).alias("first"))
    pairs = stored(often.unionByName(few).distinct(), "line-pairs")
    originals = stored(hashed.select(F.col("doc_id").alias("first"), F.col("lines").alias("a")).join(
        pairs.groupBy("first").agg(F.count(F.lit(1)).alias("copies")), "first"), "originals")
    both = heavy_join(pairs, originals, "first", "copies").join(hashed, "doc_id").select(
        "doc_id", "a", F.col("lines").alias("b"), "chars")

    def align(batches):
        for batch in batches:
            key, a, b, chars = (batch.column(i) for i in range(4))
            found = [aligned_blocks(x.as_py(), y.as_py(), z.as_py(), min_chars) for x, y, z in zip(a, b, chars)]
            n = np.array([len(f) for f in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(np.repeat(np.arange(len(n)), n))),
                 pa.array([p for f in found for p in f], pa.int32())], ["doc_id", "at"])

    cut = stored(both.mapInArrow(align, f"doc_id {kind}, at int").groupBy("doc_id").agg(
        F.collect_set("at").alias("cut")), "cut-lines")
    size = cut.agg(F.coalesce(F.sum(F.size("cut") * 4 + 48), F.lit(0)).alias("b")).first()["b"]
    cut = F.broadcast(cut) if size <= BROADCAST_BYTES else cut
    # positions count lines with words; keep every other line of the text
    split = F.split("text", "\n")
    is_solid = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    extra = ["rest"] if carry else []
    marked = source.join(cut, "doc_id", "left").withColumn("n_lines", F.size(F.filter(split, is_solid)).cast("long"))
    spots = F.transform(F.filter(F.transform(split, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                                 lambda s: is_solid(s["x"])), lambda s: s["i"])

    def without(all_lines):
        gone = let(spots, lambda at: F.transform("cut", lambda c: F.get(at, c)))
        left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone))
        return F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")

    return marked.select(
        "doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(let(split, without)).alias("text"),
        "n_lines", F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_deleted"), *extra)
