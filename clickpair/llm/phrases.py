"""Phrase collocation mining over weighted acyclic automata (operator 13).

A count transducer maps a word sequence (language, word, word, word) to the
number of its occurrences: the weight of the arc that the sequence ends with.
It is kept as sorted words and four levels of arcs; states with equal
continuations are one state (``dump``).

1.  Each task cuts its texts into pieces and words, and builds a transducer of
    each shard (some megabytes of text) from its sorted n-grams, in segments
    of consecutive n-grams.
2.  Union by prefix range.  The first n-grams of all segments give the bounds
    of prefix ranges.  Segments are cut at a few bounds; then, round by round,
    the transducers of ``FAN`` shards of a range are united, weights summed,
    and cut at the range's finer bounds.  So no task holds more than about half
    a shard's n-grams, whatever the input: shards grow fewer as ranges grow
    narrower.  A frequent first word is cut at its second and third words.
3.  Phrases of 2 to 3 words with enough occurrences are candidates.  The parts
    that their cuts ask for form a request automaton, which goes the same way
    and is composed with the counts of its range; requests are united
    on the way, so a part that most candidates ask for is looked up once.
4.  Scores are exact decimals; candidates that a frequent longer candidate
    contains are dropped; each language's first are found by places in the
    sorted order (ranges and offsets), not by one window.

Edge cases: null text is empty; a null language is ``und``; an empty table or
texts without words give an empty result; repeated rows count as often as they
stand there; other columns are not read.  A piece without any break is one step
of a task, however long.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import LOWER, UPPER, discard, hand_back, heavy_join, mix64, placed, ragged_index, stored, text_buffer

MAX_WORDS, MIN_COUNT, TOP, CONTAINED_PERCENT = 3, 10, 2000, 50
UNKNOWN = "und"
#: Text bytes of a shard, arcs a level of a segment, and transducers united at once.
SHARD_BYTES, SEGMENT, FAN = 4 << 20, 1 << 15, 16
#: Rows whose texts are copied out of a batch at once.
SLICE_ROWS = 256
#: Prefix ranges of the first round for each of the ``FAN`` united shards.
NARROW = 2
#: Bytes of each word that a bound of a range keeps.
BOUND_BYTES = 32
LEVELS = MAX_WORDS + 1

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Counts:
    """A count transducer, unfolded: ``words`` sorted, and per level the arcs
    (``par``: arc of the level above, ``label``: word, ``weight``), ascending."""

    def __init__(self, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    def __len__(self) -> int:
        return sum(len(w) for _, _, w in self.levels)

    def path(self, level: int, at: int) -> list[bytes]:
        """The sequence of an arc, each word cut to ``BOUND_BYTES``."""
        out = []
        for par, label, _ in self.levels[level::-1]:
            out.append(self.words[int(label[at])].as_py()[:BOUND_BYTES])
            at = int(par[at])
        return out[::-1]

    def spots(self, key: list[bytes]) -> list[int]:
        """Per level, the number of arcs whose sequence sorts before ``key``."""
        out, lo, hi = [], 0, len(self.levels[0][1])
        for level, (_, label, _) in enumerate(self.levels):
            found = False
            if level < len(key):
                code, there = _word_code(self.words, key[level])
                at = lo + int(np.searchsorted(label[lo:hi], code))
                found = there and at < hi and label[at] == code
            else:
                at = lo
            out.append(at + (found and len(key) > level + 1))
            if level + 1 < LEVELS:
                par = self.levels[level + 1][0]
                lo, hi = (int(np.searchsorted(par, at + x)) for x in (0, 1))
                if not found:
                    hi = lo
        return out

    def part(self, lo: list[int], hi: list[int]) -> Counts:
        """The arcs [lo, hi) of each level, with those above them at weight 0."""
        start = list(lo)
        for d in range(LEVELS - 2, -1, -1):
            par = self.levels[d + 1][0]
            if start[d + 1] < hi[d + 1]:
                start[d] = min(start[d], int(par[start[d + 1]]))
        levels, used = [], np.zeros(len(self.words), bool)
        for d, (par, label, weight) in enumerate(self.levels):
            a, b = start[d], max(hi[d], start[d])
            own = weight[a:b].copy()
            own[:lo[d] - a] = 0
            levels.append((par[a:b] - (start[d - 1] if d else 0), label[a:b], own))
            used[label[a:b]] = True
        code = np.cumsum(used) - 1
        return Counts(self.words.filter(pa.array(used)), [(par, code[label], weight) for par, label, weight in levels])

    def cut(self, keys: list[list[bytes]]) -> Iterator[tuple[int, Counts]]:
        """(number of bounds at or before, arcs) of the ranges between ``keys``."""
        spots = [[0] * LEVELS, *(self.spots(k) for k in keys), [len(w) for _, _, w in self.levels]]
        for i, (lo, hi) in enumerate(zip(spots, spots[1:])):
            if any(a < b for a, b in zip(lo, hi)):
                yield i, self.part(lo, hi)

    def segments(self, size: int = SEGMENT, salt: int = 0) -> Iterator[tuple[list[bytes] | None, Counts]]:
        """(first sequence, arcs) with about ``size`` arcs a level or less; the
        first segment has no first sequence.  Cuts start at a place that depends
        on ``salt``: equal places in every shard would be the same few bounds."""
        keys = {tuple(self.path(d, i)) for d, (_, _, w) in enumerate(self.levels)
                for i in range(1 + (salt * 40503 + d * 9973) % size, len(w), size)}
        keys = [list(k) for k in sorted(keys)]
        for i, piece in self.cut(keys):
            yield (keys[i - 1] if i else None), piece


def _word_code(words: pa.Array, word: bytes) -> tuple[int, bool]:
    lo, hi = 0, len(words)
    while lo < hi:
        mid = (lo + hi) // 2
        if words[mid].as_py() < word:
            lo = mid + 1
        else:
            hi = mid
    return lo, lo < len(words) and words[lo].as_py() == word


def _sorted_words(parts: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all arrays, sorted, and each array's codes."""
    coded = pa.concat_arrays(parts).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    return coded.dictionary.take(order), np.split(codes, np.cumsum([len(p) for p in parts])[:-1])


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, their summed weights, and each row's index."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    total = np.add.reduceat(weight[order], first) if len(first) else weight[:0]
    return k[first], total, back


def union(parts: list[Counts]) -> Counts:
    """One transducer with the summed weights of all."""
    if len(parts) == 1:
        return parts[0]
    words, codes = _sorted_words([p.words for p in parts])
    at = [np.zeros(1, np.int64) for _ in parts]
    levels, n = [], max(1, len(words))
    for d in range(LEVELS):
        sizes = [len(p.levels[d][2]) for p in parts]
        key = np.concatenate([a[p.levels[d][0]] * n + c[p.levels[d][1]] for a, c, p in zip(at, codes, parts)])
        k, weight, back = _summed(key, np.concatenate([p.levels[d][2] for p in parts]))
        levels.append((k // n, k % n, weight))
        at = np.split(back, np.cumsum(sizes)[:-1])
    return Counts(words, levels)


def from_rows(columns: list[pa.Array], weight: np.ndarray) -> Counts:
    """Transducer of sequences given as ``LEVELS`` columns, null past the end."""
    words, codes = _sorted_words([c.cast(pa.large_binary()).fill_null(b"") for c in columns])
    codes = [np.where(c.is_null().to_numpy(zero_copy_only=False), -1, k) for c, k in zip(columns, codes)]
    node, levels, n = np.zeros(len(weight), np.int64), [], max(1, len(words))
    for d, code in enumerate(codes):
        ends = codes[d + 1] < 0 if d + 1 < LEVELS else np.ones(len(code), bool)
        on = np.flatnonzero(code >= 0)
        k, total, back = _summed(node[on] * n + code[on], np.where(ends[on], weight[on], 0))
        node[on] = back
        levels.append((k // n, k % n, total))
    return Counts(words, levels)


def count_text(lang: bytes, buf: np.ndarray, off: np.ndarray) -> Counts | None:
    """N-gram counts of consecutive texts of one language."""
    breaks = _BREAK[buf]
    solid = ~(breaks | _BLANK[buf])
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1]))
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    if not len(start):
        return None
    after = np.concatenate((solid[1:], [False]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    piece = np.cumsum(breaks | edge[:-1], dtype=np.int32)[start]
    ends = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(
        np.ascontiguousarray(_FOLD[buf[solid]]))])
    words, (ids, own) = _sorted_words([words, pa.array([lang], pa.large_binary())])
    n = len(words)
    levels = [(np.zeros(1, np.int64), own, np.array([len(ids)]))]
    one, node = np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64)
    ok = np.ones(len(ids), bool)                  # a sequence of d words starts here
    for d in range(MAX_WORDS):
        if d:
            ok = ok[:-1] & (piece[d:] == piece[:-d])
        on = np.flatnonzero(ok)
        k, total, back = _summed(node[on] * n + ids[on + d], one[on])
        node[on] = back
        levels.append((k // n, k % n, total))
    return Counts(words, levels)


# -- The minimal automaton, as bytes -------------------------------------------

def _register(ptr, label, weight, to) -> tuple[np.ndarray, np.ndarray]:
    """(state of every arc list, the lists kept): equal lists are one state.
    Lists meet by hash and are then compared, so a clash keeps both."""
    n = len(ptr) - 1
    u = lambda x: x.astype(np.uint64)
    h = mix64(mix64(u(label)) + mix64(u(weight) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3)
              + mix64(u(to) ^ np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(5))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    lens = np.diff(ptr)
    _, first, back = np.unique(mix64(total[ptr[1:]] - total[ptr[:-1]]) + u(lens), return_index=True, return_inverse=True)
    rep = first[back]
    same = lens[rep] == lens
    there = np.flatnonzero(same & (lens > 0))
    mine, theirs = ragged_index(ptr[there], lens[there]), ragged_index(ptr[rep[there]], lens[there])
    eq = (label[mine] == label[theirs]) & (weight[mine] == weight[theirs]) & (to[mine] == to[theirs])
    if len(there):
        same[there] = np.logical_and.reduceat(eq, np.cumsum(lens[there]) - lens[there])
    rep = np.where(same, rep, np.arange(n))
    kept = np.unique(rep)
    return np.searchsorted(kept, rep), kept


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(k).max))


def dump(c: Counts) -> bytes:
    """Minimal automaton: states are registered from the last level up."""
    to = np.zeros(len(c.levels[-1][2]), np.int64)
    arrays = []
    for d in range(LEVELS - 1, 0, -1):
        par, label, weight = c.levels[d]
        ptr = np.searchsorted(par, np.arange(len(c.levels[d - 1][2]) + 1))
        state, kept = _register(ptr, label, weight, to)
        lens = np.diff(ptr)[kept]
        arcs = ragged_index(ptr[kept], lens)
        arrays = [lens, label[arcs], weight[arcs], to[arcs], *arrays]
        to = state
    arrays = [c.levels[0][1], c.levels[0][2], to, *arrays]
    if len(c.words):
        ends = np.frombuffer(c.words.buffers()[1], np.int64)[c.words.offset:c.words.offset + len(c.words) + 1]
        text = memoryview(c.words.buffers()[2])[int(ends[0]):int(ends[-1])].tobytes()
    else:
        ends, text = np.zeros(1, np.int64), b""
    packed = [_narrow(x) for x in [np.diff(ends), *arrays]]
    head = struct.pack("<I", len(packed)) + b"".join(struct.pack("<cQ", x.dtype.char.encode(), len(x)) for x in packed)
    raw = head + b"".join(x.tobytes() for x in packed) + text
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def load(blob: bytes) -> Counts:
    """Unfolds what ``dump`` wrote."""
    raw = pa.decompress(blob[8:], struct.unpack("<Q", blob[:8])[0], "zstd", asbytes=True)
    count, at = struct.unpack_from("<I", raw)[0], 4
    heads = [struct.unpack_from("<cQ", raw, at + 9 * i) for i in range(count)]
    at += 9 * count
    arrays = []
    for kind, n in heads:
        kind = np.dtype(kind.decode())
        arrays.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += n * kind.itemsize
    ends = np.concatenate(([0], np.cumsum(arrays[0])))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(arrays[0]), [None, pa.py_buffer(ends), pa.py_buffer(raw[at:])])
    label, weight, state = arrays[1:4]
    levels = [(np.zeros(len(label), np.int64), label, weight)]
    for d in range(1, LEVELS):
        lens, label, weight, to = arrays[4 * d:4 * d + 4]
        ptr = np.concatenate(([0], np.cumsum(lens)))
        arcs = ragged_index(ptr[state], lens[state])
        levels.append((np.repeat(np.arange(len(state)), lens[state]), label[arcs], weight[arcs]))
        state = to[arcs]
    return Counts(words, levels)


def compose(counts: Counts, asked: Counts) -> list[tuple[list[bytes], int, int]]:
    """(sequence, count, times asked) of every sequence that both accept."""
    if not len(counts.words) or not len(asked.words):
        return []
    _, (mine, theirs) = _sorted_words([counts.words, asked.words])
    n = int(max(mine.max(), theirs.max())) + 1
    at, out = np.zeros(1, np.int64), []
    for d in range(LEVELS):
        (par, label, weight), (p, q, times) = counts.levels[d], asked.levels[d]
        key, want = par * n + mine[label], np.where(at[p] >= 0, at[p] * n + theirs[q], -1)
        spot = np.searchsorted(key, want)
        spot[spot == len(key)] = 0
        hit = (key[spot] == want) & (want >= 0) if len(key) else np.zeros(len(want), bool)
        at = np.where(hit, spot, -1)
        for i in np.flatnonzero(hit & (times > 0)):
            w = int(weight[at[i]])
            if w:
                out.append((_sequence(asked, d, int(i)), w, int(times[i])))
        if not len(at):
            at = np.full(1, -1)
    return out


def _sequence(c: Counts, level: int, at: int) -> list[bytes]:
    out = []
    for par, label, _ in c.levels[level::-1]:
        out.append(c.words[int(label[at])].as_py())
        at = int(par[at])
    return out[::-1]


# -- Spark jobs ----------------------------------------------------------------

SEGMENTS = "shard long, first array<binary>, automaton binary"


def _segment_batch(shard: int, c: Counts) -> Iterator[pa.RecordBatch]:
    for first, piece in c.segments(salt=shard):
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([first], pa.list_(pa.binary())), pa.array([dump(piece)], pa.binary())],
            ["shard", "first", "automaton"])
    hand_back()


def _slices(buf: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of about ``limit`` bytes; a longer text is cut after a break."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        a, b = int(off[lo]), int(off[hi])
        while b - a > limit and hi == lo + 1:
            at = np.flatnonzero(_BREAK[buf[a:a + limit]])
            if not len(at):
                at = np.flatnonzero(_BREAK[buf[a:b]])[:1]
            if not len(at):
                break
            cut = a + int(at[-1]) + 1
            yield buf[a:cut], np.array([0, cut - a])
            a = cut
        yield buf[a:b], off[lo:hi + 1] - a if a == off[lo] else np.array([0, b - a])
        lo = hi


def shard_segments(docs: DataFrame, text_col: str, lang_col: str, shard_bytes: int) -> DataFrame:
    """Segments of the transducers of all shards."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    tasks = rows.rdd.getNumPartitions()

    def shard_of(texts):
        """The transducer of the texts held for each language."""
        held = []
        for lang, parts in texts.items():
            buf = np.concatenate([b for b, _ in parts])
            off = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in parts]))))
            held.append(count_text(lang.encode(), buf, off))
        texts.clear()
        held = [c for c in held if c is not None]
        return union(held) if held else None

    def run(batches):
        hand_back()
        texts, size, shard = {}, 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, len(batch), SLICE_ROWS):
                rows = batch.slice(lo, SLICE_ROWS)
                for lang in pc.unique(rows.column(0)).to_pylist():
                    buf, off = text_buffer(rows.column(1).filter(pc.equal(rows.column(0), lang)))
                    for b, o in _slices(buf, off, shard_bytes):
                        texts.setdefault(lang, []).append((b.copy(), np.diff(o)))
                        size += len(b)
                        if size >= shard_bytes:
                            whole = shard_of(texts)
                            if whole is not None:
                                yield from _segment_batch(shard, whole)
                            size, shard = 0, shard + tasks
        whole = shard_of(texts) if texts else None
        if whole is not None:
            yield from _segment_batch(shard, whole)

    return rows.mapInArrow(run, SEGMENTS)


class Ranges:
    """Bounds of ``NARROW * fan ** rounds`` prefix ranges, a table (``j``, ``key``): range
    j starts at its key, range 0 before all keys."""

    def __init__(self, segments: DataFrame, rounds: int, fan: int):
        self.rounds, self.fan = rounds, fan
        rows = segments.where("first is not null").select(F.lit("").alias("g"), "first").withColumn("tie", F.monotonically_increasing_id())
        spots = placed(stored(rows, "bounds"), ["first", "tie"])
        j = F.expr(f"cast(floor(place * {NARROW * fan ** rounds}D / total) as bigint)")
        self.bounds = stored(spots.withColumn("j", j).groupBy("j").agg(F.min("first").alias("key")), "bounds")

    def level(self, t: int) -> DataFrame:
        """Ranges of round ``t``: ``child``, and the key it starts with."""
        width = self.fan ** (self.rounds - 1 - t)
        return self.bounds.groupBy(F.expr(f"j div {width}").alias("child")).agg(F.min("key").alias("key"))


def _cut_to(c: Counts, bounds: list, default: int) -> Iterator[tuple[int, Counts]]:
    """(child range, arcs); ``bounds`` are (child, key) in order of the keys."""
    for i, piece in c.cut([key for _, key in bounds]):
        yield (bounds[i - 1][0] if i else default), piece


AUTOMATA = "shard long, range long, automaton binary"


def _merged(fan: int, last: bool):
    """Unites the transducers of one range and ``fan`` shards, and cuts the
    union at the range's finer bounds unless it is the last."""
    def merge(key, table):
        hand_back()
        c = union([load(b) for b in table["automaton"].to_pylist()])
        shard, own = key[0].as_py(), key[1].as_py()
        if last:
            done = [(own, c)]
        else:
            found = table["bounds"][0].as_py() or []
            done = list(_cut_to(c, sorted(((b["child"], b["key"]) for b in found), key=lambda x: x[1]), own * fan))
        out = pa.table({"shard": pa.array([shard] * len(done), pa.int64()),
                        "range": pa.array([r for r, _ in done], pa.int64()),
                        "automaton": pa.array([dump(x) for _, x in done], pa.binary())})
        del c, done
        hand_back()
        return out
    return merge


def routed(segments: DataFrame, ranges: Ranges) -> DataFrame:
    """(range, automaton): the union of all shards, by final prefix range.
    ``segments``, and each round's table once the next is stored, are deleted."""
    fan, rounds, before = ranges.fan, ranges.rounds, segments
    coarse = sorted(((r["child"], [bytes(x) for x in r["key"]]) for r in ranges.level(0).collect()), key=lambda x: x[1])

    def split(batches):                              # ``NARROW * fan`` bounds, whatever the input
        hand_back()
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                done = list(_cut_to(load(blob), coarse, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(done), pa.int64()), pa.array([r for r, _ in done], pa.int64()),
                     pa.array([dump(c) for _, c in done], pa.binary())], ["shard", "range", "automaton"])
            hand_back()

    rows = segments.select("shard", "automaton").mapInArrow(split, AUTOMATA)
    for t in range(1, rounds + 1):
        rows = rows.withColumn("shard", F.expr(f"shard div {fan}"))
        last = t == rounds
        if not last:
            finer = ranges.level(t).groupBy(F.expr(f"child div {fan}").alias("range")).agg(
                F.collect_list(F.struct("child", "key")).alias("bounds"))
            rows = rows.join(finer, "range", "left")

        united = stored(rows.groupBy("shard", "range").applyInArrow(_merged(fan, last), AUTOMATA), "automata")
        discard(before)
        rows = before = united
    return rows.select("range", "automaton")


def frequent(automata: DataFrame, min_count: int) -> DataFrame:
    """(lang, w1, w2, w3, a) of the sequences with enough occurrences; a row
    without words has the number of all words of the language."""
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                c = load(blob)
                at = [np.arange(len(c.levels[0][2]))]
                for d, (par, label, weight) in enumerate(c.levels):
                    if d:
                        at = [*(a[par] for a in at), np.arange(len(par))]
                    on = np.flatnonzero(weight >= (min_count if d else 1))
                    cols = [c.words.take(pa.array(c.levels[e][1][a[on]])).cast(pa.binary()) for e, a in enumerate(at)]
                    cols += [pa.nulls(len(on), pa.binary())] * (LEVELS - len(cols))
                    yield pa.RecordBatch.from_arrays(
                        [*[x.cast(pa.string()) for x in cols], pa.array(weight[on])], ["lang", "w1", "w2", "w3", "a"])

    return automata.select("automaton").mapInArrow(run, "lang string, w1 string, w2 string, w3 string, a long")


def part_counts(parts: DataFrame, automata: DataFrame, ranges: Ranges) -> DataFrame:
    """(lang, part, f, asked) for the word sequences in ``parts`` (lang, w1,
    w2): requests, united by prefix range, composed with the counts."""
    tasks = parts.rdd.getNumPartitions()

    def ask(batches):
        held, shard = [], TaskContext.get().partitionId()
        for batch in batches:
            cols = [batch.column(i) for i in range(3)]
            held.append(from_rows([*cols, pa.nulls(len(batch), pa.string())], np.ones(len(batch), np.int64)))
            if sum(map(len, held)) >= 4 * SEGMENT * FAN:
                yield from _segment_batch(shard, union(held))
                held, shard = [], shard + tasks
        if sum(map(len, held)):
            yield from _segment_batch(shard, union(held))

    asked = routed(stored(parts.mapInArrow(ask, SEGMENTS), "requests"), ranges)

    def look(key, counts, wanted):
        blobs = [x["automaton"].to_pylist() for x in (counts, wanted)]
        found = compose(union([load(b) for b in blobs[0]]), union([load(b) for b in blobs[1]])) if all(blobs) else []
        text = lambda x: x.decode("utf-8", "surrogatepass")
        return pa.table({"lang": pa.array([text(s[0]) for s, _, _ in found], pa.string()),
                         "part": pa.array([text(b" ".join(s[1:])) for s, _, _ in found], pa.string()),
                         "f": pa.array([f for _, f, _ in found], pa.int64()),
                         "asked": pa.array([k for _, _, k in found], pa.int64())})

    return automata.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(
        look, "lang string, part string, f long, asked long")


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, top: int | None = TOP,
            contained_percent: int = CONTAINED_PERCENT, text_col: str = "text", lang_col: str = "lang",
            shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """Each language's first ``top`` phrases (None: all): ``lang, rank, phrase,
    a, l, r, n, score``."""
    segments = stored(shard_segments(docs, text_col, lang_col, shard_bytes), "segments")
    shards = (segments.agg(F.max("shard")).first()[0] or 0) + 1
    rounds = max(1, math.ceil(math.log(shards, fan) - 1e-9)) if shards > 1 else 1
    ranges = Ranges(segments, rounds, fan)
    automata = routed(segments, ranges)
    often = stored(frequent(automata, min_count), "frequent")
    totals = often.where("w1 is null").select("lang", F.col("a").alias("n"))
    cand = stored(often.where("w2 is not null").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")), "candidates")

    # every cut of every candidate: its first and second part
    cut = lambda k, l, r: F.struct(F.lit(k).alias("k"), F.array(*l).alias("l"), F.array(*r).alias("r"))
    two = F.array(cut(1, ["w1"], ["w2"]))
    three = F.array(cut(1, ["w1"], ["w2", "w3"]), cut(2, ["w1", "w2"], ["w3"]))
    cuts = cand.select("lang", "phrase", "a", F.explode(F.when(F.col("w3").isNull(), two).otherwise(three)).alias("c"))
    sides = cuts.select("lang", "phrase", "a", "c.k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("c.l").alias("p")), F.struct(F.lit(1).alias("side"), F.col("c.r").alias("p")))
        ).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.p")
    asked = sides.select("lang", F.get("p", F.lit(0)).alias("w1"), F.get("p", F.lit(1)).alias("w2"))
    key = lambda lang, part: F.concat_ws(" ", lang, part)
    found = stored(part_counts(asked, automata, ranges).withColumn("key", key("lang", "part")).select("key", "f", "asked"),
                   "parts")
    discard(automata)
    known = heavy_join(sides.withColumn("key", key("lang", F.concat_ws(" ", "p"))), found, "key", "asked")
    pairs = known.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.floor(F.expr("cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000BD div "
                           "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = pairs.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("b"))

    longer = cand.where("w3 is not null").select("lang", "a", F.explode(F.array(
        F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("a").alias("inside"))
    left = best.join(longer.withColumn("size", F.lit(2)), ["lang", "phrase"], "left").where(
        (F.size(F.split("phrase", " ")) > 2) | F.col("inside").isNull()
        | (100 * F.col("inside") < contained_percent * F.col("a")))
    scored = stored(left.select(F.col("lang").alias("g"), "phrase", "a", "b.l", "b.r", "b.score",
                                (-F.col("b.score")).alias("by_score"), (-F.col("a")).alias("by_a")), "scored")
    ranked = placed(scored, ["by_score", "by_a", "phrase"]).withColumn("rank", F.col("place") + 1)
    kept = ranked if top is None else ranked.where(F.col("rank") <= top)
    return kept.withColumnRenamed("g", "lang").join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
with p as (select coalesce(lang, '{UNKNOWN}') as lang, unnest(string_split_regex(
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
f as materialized (select lang, phrase, count(*) as a from (
        select lang, unnest(ws) as phrase from w
        union all
        select lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w
        union all
        select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from w)
      group by lang, phrase),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where a >= {MIN_COUNT} and contains(phrase, ' ')),
k as materialized (select *, array_to_string(ws[:k], ' ') as first, array_to_string(ws[k + 1:], ' ') as rest
      from (select *, unnest(range(1, len(ws))) as k from c)),
s as (select k.*, f1.a as l, f2.a as r,
        (1000000 * k.a::hugeint * k.a::hugeint // (f1.a::hugeint * f2.a::hugeint))::bigint as score
      from k join f f1 on f1.lang = k.lang and f1.phrase = first join f f2 on f2.lang = k.lang and f2.phrase = rest),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, part, max(a) as a from (
        select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from c where len(ws) = 3)
      group by lang, part),
d as (select b.* from b left join i on i.lang = b.lang and i.part = b.phrase
      where i.a is null or 100 * i.a < {CONTAINED_PERCENT} * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from d join n using (lang) qualify rank <= {TOP}
"""
