"""Suffix-array dedup (operator 6): repeated strings of ``WINDOW`` bytes.

Texts are UTF-8 bytes, matches never cross documents.  ``keep="none"`` removes
each byte covered by a 200-byte string that also starts anywhere else, in any
document; ``keep="first"`` leaves the earliest copy (by id, then position).

1.  *Anchors.*  Of the 100-byte grams in a 200-byte window, the one with the
    smallest hash (leftmost of equals) is the window's anchor.  Equal windows
    have equal anchors at equal places, so only windows whose anchor gram
    repeats can repeat.  Neighbouring windows with one anchor are a run; its
    context is the bytes it covers.  There are about two runs per 101 bytes.
2.  Tasks pre-aggregate runs by context; packed blocks of anchors shuffle once,
    and anchors that occur once end there.  A bitmap of the repeated anchors
    (``FILTER_BYTES`` at most, else no filter) lets the second reading of the
    texts emit only runs that matter.  Contexts with a thousandth of all runs
    or more are known by then: that reading settles their copies itself.
3.  Runs with equal contexts are repeated as a whole.  Where one anchor has
    different contexts, these are put in order of first occurrence and their
    windows' *suffix order* is built by prefix doubling.  Previous and next
    smaller positions in that order give the longest previous factor of every
    window (cut off at 200 bytes): 200 means an earlier copy.  The mirrored
    array gives later copies.  An anchor with very many contexts (a passage in a
    large part of all documents) is settled by counting window hashes instead,
    which needs no group in one task.
4.  Spans return to their documents and are cut out.

Edge cases: null text is the empty text; rows with a null id are neither cut nor
compared; rows with one id are cut alike; texts under 200 bytes stay whole;
overlapping copies count, in the same document too; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpair.llm.common import (bound_batches, hand_back, hash_prefix, heavy_join, mix64, ragged_index, span_hash,
                                  stored, text_buffer)

WINDOW, GRAM = 200, 100
WIDE = WINDOW - GRAM + 1               # grams in a window
CHUNK, SEGMENT = 1 << 18, 1 << 18      # bytes of a numpy step; of a piece of a very long text
FILTER_BYTES = 32 << 20
BLOCK_RUNS, BLOCK_BYTES = 200_000, 1 << 18
#: Contexts with this part of all runs or more are settled where the runs are found.
HOT_SHARE = 1000
NAMES = ["context", "doc_id", "s0", "s1", "bytes", "spans"]
#: Contexts of one anchor that are suffix-sorted together, at most.
TOGETHER = 20_000
_U = np.uint64


def segments(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the texts between these offsets; long ones as
    overlapping pieces so that every window is in exactly one."""
    size = np.diff(off)
    per = np.where(size >= WINDOW, -(-(size - WINDOW + 1) // SEGMENT), 0)
    row = np.repeat(np.arange(len(size)), per)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
    start = off[:-1][row] + at
    return row, start, np.minimum(start + SEGMENT + WINDOW - 1, off[1:][row])


def runs_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, context hash) of the runs
    in consecutive texts of ``WINDOW`` bytes or more; places count from the text's start."""
    prefix = hash_prefix(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = span_hash(prefix, at, at + GRAM)
    bits = _U(24)                                     # chunk positions fit: see CHUNK, SEGMENT
    low, wide = (gram >> bits << bits) | at.astype(_U), 1
    del at
    while 2 * wide <= WIDE:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    low = np.minimum(low[:len(low) - (WIDE - wide)], low[WIDE - wide:])
    windows = np.diff(off) - WINDOW + 1
    s = ragged_index(off[:-1], windows)
    anchor = (low[s] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    text = np.repeat(np.arange(len(windows)), windows)
    head = np.ones(len(s), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(s)) - 1
    lo, hi, text = s[first], s[last], text[first]
    return text, lo - off[text], hi - off[text], gram[anchor[first]], span_hash(prefix, lo, hi + WINDOW)


def run_chunks(batches):
    """(ids, rows, first window, last window, anchor, context, bytes, context's place) per chunk;
    a batch's texts are let go before the next is read."""
    hand_back()
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        del batch
        row, start, end = segments(offsets)
        size = np.cumsum(end - start)
        lo = 0
        while lo < len(row):
            base = size[lo] - (end[lo] - start[lo])
            hi = max(lo + 1, int(np.searchsorted(size, base + CHUNK, "right")))
            part = np.concatenate([buf[a:b] for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist())])
            off = np.concatenate(([0], size[lo:hi] - base))
            text, s0, s1, anchor, context = runs_of(part, off)
            origin = start[lo:hi] - offsets[:-1][row[lo:hi]]
            yield ids, row[lo:hi][text], s0 + origin[text], s1 + origin[text], anchor, context, part, s0 + off[text]
            lo = hi
        buf = part = text = s0 = s1 = anchor = context = None
        hand_back()


def repeated_runs(rows: DataFrame, blocks: int) -> DataFrame:
    """(anchor, context, n, doc_id, s0, contexts): every context of the anchors
    that occur twice or more, with its count and first place."""
    def emit(batches):
        held, size = [], 0
        for ids, row, s0, _, anchor, context, _, _ in run_chunks(batches):
            held.append((anchor, context, ids[row], s0))
            size += len(row)
            if size > BLOCK_RUNS:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)
        del held
        hand_back()

    def pack(held):
        anchor, context, doc, s0 = (np.concatenate(x) for x in zip(*held))
        anchor, context, doc, s0, n = _first_of(anchor, context, doc, s0, np.ones(len(doc), np.int64))
        # anchors are minima of hashes and so crowd at the low end: blocks are dealt by another hash
        block = ((mix64(anchor) >> _U(32)) * _U(blocks)) >> _U(32)
        order = np.argsort(block, kind="stable")
        anchor, context, doc, s0, n, block = (x[order] for x in (anchor, context, doc, s0, n, block))
        at = np.searchsorted(block, np.arange(blocks + 1).astype(_U))
        s0, n = s0.astype(np.uint32), n.astype(np.uint32)
        for b, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if lo < hi:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), *[pa.array([x[lo:hi].tobytes()], pa.binary())
                                                  for x in (anchor, context, doc, s0, n)]],
                    ["block", "anchors", "contexts", "docs", "places", "counts"])

    def settle(key, t):
        hand_back()
        cat = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        anchor, context, doc, s0, n = _first_of(
            cat("anchors", _U), cat("contexts", _U), cat("docs", np.int64),
            cat("places", np.uint32).astype(np.int64), cat("counts", np.uint32).astype(np.int64))
        _, at, kinds = np.unique(anchor, return_inverse=True, return_counts=True)
        total = np.bincount(at, n) if len(n) else np.zeros(0)
        keep = total[at] >= 2
        return pa.table({"anchor": anchor[keep].astype(np.int64), "context": context[keep].astype(np.int64),
                         "n": n[keep], "doc_id": doc[keep], "s0": s0[keep], "contexts": kinds[at][keep]})

    return rows.mapInArrow(
        emit, "block int, anchors binary, contexts binary, docs binary, places binary, counts binary").groupBy(
        "block").applyInArrow(settle, "anchor long, context long, n long, doc_id long, s0 long, contexts long")


def _first_of(anchor, context, doc, s0, n):
    """One row per (anchor, context): first (doc, s0) and summed counts."""
    order = np.lexsort((s0, doc, context, anchor))
    anchor, context, doc, s0, n = (x[order] for x in (anchor, context, doc, s0, n))
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else n
    return anchor[first], context[first], doc[first], s0[first], total


def anchor_filter(verdicts: DataFrame, count: int) -> bytes:
    """Bitmap over hashes of the repeated anchors, 8 bits each or more: a
    superset of them.  Empty if it were larger than ``FILTER_BYTES``."""
    bits = 1 << max(16, int(count * 8).bit_length())
    if bits // 8 > FILTER_BYTES:
        return b""
    parts = 16

    def fill(key, t):
        a = np.unique(t["anchor"].to_numpy().astype(_U) % _U(bits)).astype(np.int64) - int(key[0].as_py()) * (bits // parts)
        part = np.zeros(bits // parts, bool)
        part[a] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    spot = F.expr(f"cast(shiftright(anchor & {bits - 1}L, {(bits // parts).bit_length() - 1}) as int)")
    found = {r["part"]: r["bits"] for r in verdicts.select("anchor", spot.alias("part")).groupBy("part").applyInArrow(
        fill, "part int, bits binary").collect()}
    return b"".join(bytes(found.get(p, bytes(bits // parts // 8))) for p in range(parts))


def passes(bitmap: bytes, anchor: np.ndarray) -> np.ndarray:
    """Whether the anchors are in the filter; an empty filter lets all pass."""
    bits = np.frombuffer(bitmap, np.uint8)
    if not len(bits):
        return np.ones(len(anchor), bool)
    spot = (anchor % _U(8 * len(bits))).astype(np.int64)
    return ((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(bool)


def hot_verdicts(verdicts: DataFrame) -> np.ndarray:
    """(context, n, doc_id, s0) rows, in order of context, of the contexts with
    at least 1/``HOT_SHARE`` of all runs: ``HOT_SHARE`` rows at most."""
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    hot = verdicts.where(F.col("n") * HOT_SHARE >= total.scalar()).select("context", "n", "doc_id", "s0").collect()
    return np.array(sorted(map(tuple, hot)), np.int64).reshape(-1, 4)


def merged_spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(rows, list of maximal spans per row) of spans in order of row and place."""
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])))[:len(row)]
    last = np.append(new[1:], len(row))[:len(new)] - 1
    of, first = np.unique(row[new], return_index=True)
    return of, pa.ListArray.from_arrays(
        pa.array(np.append(first, len(new)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(lo[new]), pa.array(hi[last])], ["lo", "hi"]))


def candidate_runs(rows: DataFrame, repeated: bytes, mixed: bytes, hot: np.ndarray, keep_first: bool) -> DataFrame:
    """Runs whose anchor passes the filter of repeated anchors, as (context,
    doc_id, s0, s1, bytes); ``bytes``, once per task and context, where the
    anchor passes that of anchors with different contexts.

    Runs of the ``hot`` contexts that go as a whole are settled here: touching
    ones become one span, and a document's ``spans`` one row without context."""
    shared = rows.sparkSession.sparkContext.broadcast((repeated, mixed, hot))

    def settled(context, doc, s0):
        """Which runs are copies of a hot context that go."""
        table = shared.value[2]
        if not len(table):
            return np.zeros(len(context), bool)
        at = np.minimum(np.searchsorted(table[:, 0], context), len(table) - 1)
        _, n, d, p = table[at].T
        goes = (d != doc) | (p != s0) if keep_first else n > 1
        return (table[at, 0] == context) & goes

    def run(batches):
        seen: set = set()
        for doc, row, s0, s1, anchor, context, part, place in run_chunks(batches):
            keep = np.flatnonzero(passes(shared.value[0], anchor))
            differs = passes(shared.value[1], anchor[keep])
            done = settled(context[keep].astype(np.int64), doc[row[keep]], s0[keep])
            raw = part.tobytes()
            data = []
            for i, (k, wanted) in enumerate(zip(keep.tolist(), differs.tolist())):
                c = int(context[k])
                if not wanted or c in seen:
                    data.append(None)
                else:
                    seen.add(c)
                    data.append(raw[place[k]:place[k] + int(s1[k] - s0[k]) + WINDOW])
                    done[i] = False                      # its bytes travel with the run
            gone, left = keep[done], keep[~done]
            of, spans = merged_spans(row[gone], s0[gone], s1[gone] + WINDOW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(context[left].astype(np.int64)), pa.array(doc[row[left]]), pa.array(s0[left]),
                 pa.array(s1[left]), pa.array([d for d, x in zip(data, done.tolist()) if not x], pa.binary()),
                 pa.nulls(len(left), spans.type)], NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(of), pa.int64()), pa.array(doc[of]), pa.nulls(len(of), pa.int64()),
                 pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.binary()), spans], NAMES)

    return rows.mapInArrow(run, "context long, doc_id long, s0 long, s1 long, bytes binary, "
                                "spans array<struct<lo:long,hi:long>>")


# -- Suffix order -----------------------------------------------------------------

def prefix_ranks(buf: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(length, rank of each position's first ``length`` bytes), by doubling up
    to ``WINDOW``; equal ranks are equal bytes, ranks are in byte order."""
    n = len(buf)
    pad = np.concatenate((buf, np.zeros(8, np.uint8))).astype(_U)
    first = np.zeros(n, _U)
    for k in range(8):
        first = first << _U(8) | pad[k:k + n]
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    out, size = [(8, rank)], 8
    while size < WINDOW:
        step = min(size, WINDOW - size)
        after = np.concatenate((rank[step:], np.zeros(step, np.int64)))
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        size += step
        out.append((size, rank))
    return out


def previous_smaller(position: np.ndarray) -> np.ndarray:
    """For each entry the nearest earlier one with a smaller value, or -1."""
    at = np.arange(len(position)) - 1
    todo = np.flatnonzero(at >= 0)
    todo = todo[position[at[todo]] > position[todo]]
    while len(todo):
        at[todo] = at[at[todo]]                   # jumps over entries known to be larger
        todo = todo[at[todo] >= 0]
        todo = todo[position[at[todo]] > position[todo]]
    return at


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix at positions a and b, cut off at WINDOW, in
    steps of the ranks' lengths."""
    out = np.zeros(len(a), np.int64)
    for size, rank in levels:
        out[rank[a] == rank[b]] = size
    return out


def longest_factors(levels: list[tuple[int, np.ndarray]], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest next factor) of the windows, cut off at
    ``WINDOW``, from previous and next smaller positions in suffix order."""
    order = windows[np.argsort(levels[-1][1][windows], kind="stable")]
    both = []
    for sign in (1, -1):
        best = np.zeros(len(order), np.int64)
        for flip in (slice(None), slice(None, None, -1)):
            seq = sign * order[flip]
            near = previous_smaller(seq)
            has = near >= 0
            got = np.zeros(len(seq), np.int64)
            got[has] = common_prefix(levels, order[flip][has], order[flip][near[has]])
            best = np.maximum(best, got[flip])
        out = np.zeros(len(order), np.int64)
        out[np.searchsorted(windows, order)] = best
        both.append(out)
    return both[0], both[1]


def suffix_flags(contexts: DataFrame, blocks: int) -> DataFrame:
    """(context, earlier, other): offsets of the windows with an earlier copy,
    and with any copy, among the contexts of their anchor."""
    def run(key, t):
        hand_back()
        t = t.sort_by([("doc_id", "ascending"), ("s0", "ascending")])
        data = t["bytes"].to_pylist()
        size = np.array([len(d) for d in data], np.int64)
        if not len(size):
            return t.select(["context"]).append_column("earlier", pa.array([], pa.list_(pa.int32()))).append_column(
                "other", pa.array([], pa.list_(pa.int32())))
        buf = np.frombuffer(b"".join(data), np.uint8)
        off = np.concatenate(([0], np.cumsum(size)))
        windows = ragged_index(off[:-1], size - WINDOW + 1)
        owner = np.repeat(np.arange(len(size)), size - WINDOW + 1)
        before, after = longest_factors(prefix_ranks(buf), windows)
        lists = []
        for hit in (before >= WINDOW, np.maximum(before, after) >= WINDOW):
            ends = np.searchsorted(owner[hit], np.arange(len(size) + 1))
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(
                (windows - off[owner])[hit].astype(np.int32))))
        return pa.table({"context": t["context"], "earlier": lists[0], "other": lists[1]})

    return contexts.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).groupBy("block").applyInArrow(
        run, "context long, earlier array<int>, other array<int>")


def hashed_flags(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: windows are counted by hash."""
    def run(batches):
        for batch in batches:
            for c, doc, s0, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                buf = np.frombuffer(data, np.uint8)
                at = np.arange(len(buf) - WINDOW + 1)
                h = span_hash(hash_prefix(buf), at, at + WINDOW).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.full(len(at), c)), pa.array(at.astype(np.int32)),
                     pa.array(np.full(len(at), doc)), pa.array(s0 + at)], ["window", "context", "at", "doc_id", "s"])

    each = contexts.select("context", "doc_id", "s0", "bytes").mapInArrow(
        run, "window long, context long, at int, doc_id long, s long")
    each = stored(each, "hot-windows")
    some = stored(each.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "s")).alias(
        "first")).where("n > 1"), "hot-repeats")
    hit = heavy_join(each, some, "window", "n").withColumn(
        "later", (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.s") != F.col("s")))
    return hit.groupBy("context").agg(F.collect_list(F.when(F.col("later"), F.col("at"))).alias("earlier"),
                                      F.collect_list("at").alias("other"))


# -- Removal ----------------------------------------------------------------------

def repeated_spans(rows: DataFrame, keep: str) -> DataFrame:
    """(doc_id, spans): byte spans to remove, as (start, end) pairs in one list."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    verdicts = stored(repeated_runs(rows, max(8, int(size // (BLOCK_RUNS * 40)))), "run-verdicts")
    mixed = verdicts.where("contexts > 1")
    filters = [anchor_filter(v, v.select("anchor").distinct().count()) for v in (verdicts, mixed)]
    every = stored(candidate_runs(rows, *filters, hot_verdicts(verdicts), keep == "first"), "candidate-runs")
    runs = every.where("context is not null").drop("spans")
    data = runs.where("bytes is not null").select("context", "bytes").dropDuplicates(["context"])
    contexts = stored(mixed.join(data, "context"), "contexts")
    total = contexts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("b")).first()["b"]
    flags = suffix_flags(contexts.where(F.col("contexts") <= TOGETHER), max(8, int(total // BLOCK_BYTES)))
    if contexts.where(F.col("contexts") > TOGETHER).head(1):
        flags = flags.unionByName(hashed_flags(contexts.where(F.col("contexts") > TOGETHER)))
    first = verdicts.select("context", "n", F.col("doc_id").alias("d"), F.col("s0").alias("p"),
                            (F.col("contexts") > 1).alias("mixed"))
    found = runs.drop("bytes").join(first, "context").withColumn(
        "is_first", (F.col("d") == F.col("doc_id")) & (F.col("p") == F.col("s0")))
    whole = (F.col("n") > 1) if keep == "none" else ~F.col("is_first")
    span = lambda a, b: F.array(F.struct(a.alias("lo"), b.alias("hi")))
    plain = found.where(whole).select("doc_id", span(F.col("s0"), F.col("s1") + WINDOW).alias("spans"))
    fine = found.where(~whole & F.col("mixed") & F.col("is_first")).join(
        flags.select("context", F.col("other" if keep == "none" else "earlier").alias("offsets")), "context").select(
        "doc_id", F.transform("offsets", lambda o: F.struct((F.col("s0") + o).alias("lo"),
                                                            (F.col("s0") + o + WINDOW).alias("hi"))).alias("spans"))
    hot = every.where("context is null").select("doc_id", "spans")
    return hot.unionByName(plain).unionByName(fine).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def suffix_dedup(docs: DataFrame, keep: str = "first", id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = True, carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``
    and, on request, ``text`` (the remaining bytes, where a cut inside a
    character drops that character's rest) and ``rest``, a struct of the other
    columns."""
    bound_batches(docs.sparkSession)
    others = F.struct(*[F.col(c) for c in docs.columns if c != text_col])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([others.alias("rest")] if carry else []))
    spans = stored(repeated_spans(rows.select("doc_id", "text").where("doc_id is not null"), keep), "spans")
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 24 + 48), F.lit(0)).alias("b")).first()["b"]
    joined = rows.join(F.broadcast(spans) if size <= FILTER_BYTES else spans, "doc_id", "left").select(
        "doc_id", "text", F.transform("spans", lambda s: s["lo"]).alias("lo"),
        F.transform("spans", lambda s: s["hi"]).alias("hi"), *(["rest"] if carry else []))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][:len(names)]

    def cut(batches):
        hand_back()
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            raw = buf.tobytes()
            out = []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                left, removed, n = without_spans(raw[a:b], batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                out.append((b - a, removed, n, hashlib.sha256(left).hexdigest(),
                            *([left.decode("utf-8", "ignore")] if with_text else [])))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)],
                 *([batch.column(4)] if carry else [])], ["doc_id", *names, *(["rest"] if carry else [])])
            batch = buf = raw = left = out = cols = None
            hand_back()

    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                                      + (", text string" if with_text else ""))
    if carry:
        schema = schema.add("rest", joined.schema["rest"].dataType)
    return joined.mapInArrow(cut, schema)


def without_spans(text: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    if not starts:
        return text, 0, 0
    lo, hi = np.array(starts), np.array(ends)
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
    last = np.append(new[1:], len(lo)) - 1
    kept, at = [], 0
    for x, y in zip(lo[new].tolist(), top[last].tolist()):
        kept.append(text[at:x])
        at = y
    left = b"".join([*kept, text[at:]])
    return left, len(text) - len(left), len(new)
