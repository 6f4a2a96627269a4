"""BPE encoding and decoding (operator 1).

The vocabulary file is a parameter; the driver reads it once and broadcasts
its tables (a few MB, bounded by the vocabulary).  Tasks encode Arrow batches:

* *Pre-tokens.*  Character-class runs of the byte-level pattern are found on
  the whole batch at once; special tokens are split off first.
* *Merges.*  Every distinct pre-token is encoded once per worker.  A segment
  tree holds, over the symbol positions, the key ``rank * n + position`` of
  the pair that starts there.  The root is the leftmost lowest-rank merge; a
  merge changes three leaves, each a logarithmic point update; it ends when
  the root is infinite.  Trees of many pre-tokens are stacked into arrays, so
  one numpy step performs one merge in each.
* *Decoding* gathers the bytes of the ids.

Edge cases: null text is the empty text (0 ids); repeated rows give repeated
results; an empty table gives an empty result; columns besides the id and the
text are not read, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.llm.common import (hand_back, hash_prefix, ragged_index,
                                  row_chunks, span_hash, text_buffer)

LETTER, NUMBER, SPACE, OTHER, BREAK, SPECIAL = 1, 2, 3, 4, 5, 6
BREAK_BYTE, SPECIAL_BYTE = 0xFF, 0xFE             # neither occurs in UTF-8
INF = np.int64(1) << np.int64(60)
#: Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBER = 1_000_000

#: Text bytes of a numpy step, whose arrays take many times that; a longer text is a step.
STEP_BYTES = 512 << 10


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: a
    printable Latin-1 byte stands for itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_classes(tokenizer=None) -> np.ndarray:
    """Class of each code point.  Code points that Python's Unicode tables do
    not know are asked of the tokenizer library, whose tables are newer."""
    out = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))
        if cat[0] == "L":
            out[cp] = LETTER
        elif cat[0] == "N":
            out[cp] = NUMBER
        elif cat[0] == "Z" or cp in (9, 10, 11, 12, 13, 0x85):
            out[cp] = SPACE
        elif cat == "Cn":
            unknown.append(cp)
    if tokenizer is not None:
        import regex
        known = regex.compile(r"[\p{L}\p{N}]")
        unknown = [cp for cp in unknown if known.match(chr(cp))]
        for lo in range(0, len(unknown), 20_000):
            part = unknown[lo:lo + 20_000]
            text = "".join(f"a{chr(cp)}1\n" for cp in part)
            starts = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
            for i, cp in enumerate(part):
                if 4 * i + 1 not in starts:
                    out[cp] = LETTER
                elif 4 * i + 2 not in starts:
                    out[cp] = NUMBER
    return out


class Vocabulary:
    """Tables of a byte-level BPE file; picklable, a few MB."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        data: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            data[i] = bytes(symbols[c] for c in token)
        self.special = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"]]
        for content, i in self.special:
            data[i] = content
        self.byte_id = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.token_len = np.array([len(d) for d in data], np.int64)
        self.token_off = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.classes = char_classes(Tokenizer.from_file(path))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of the pairs (a, b); -1 if they do not merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)


def piece_starts(buf: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

    in a buffer of texts divided by ``BREAK_BYTE``."""
    kind = np.zeros(len(buf), np.uint8)
    ascii_ = buf < 0x80
    kind[ascii_] = classes[:128][buf[ascii_]]
    kind[buf == BREAK_BYTE], kind[buf == SPECIAL_BYTE] = BREAK, SPECIAL
    lead = np.flatnonzero((buf >= 0xC0) & (buf < 0xF8))
    for width, low, high, keep in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        at = lead[(buf[lead] >= low) & (buf[lead] < high)]
        cp = (buf[at] & keep).astype(np.int64)
        for k in range(1, width):
            cp = (cp << 6) | (buf[at + k] & 0x3F)
        k_at = classes[np.minimum(cp, 0x10FFFF)]
        for k in range(width):
            kind[at + k] = k_at
    start = np.ones(len(buf), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= BREAK)
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], len(buf))
    # white space before a letter, number or other character: its last
    # character leaves the run, and a blank joins what follows
    spaces = np.flatnonzero((kind[runs] == SPACE) & (ends < len(buf)))
    spaces = spaces[kind[ends[spaces]] < BREAK]
    last = ends[spaces] - 1
    blank = buf[last] == 0x20
    start[ends[spaces][blank]] = False
    start[last[blank]] = True
    other = last[~blank]
    while len(tail := np.flatnonzero((buf[other] & 0xC0) == 0x80)):
        other[tail] -= 1
    start[other] = True
    # contractions: a lone apostrophe that starts a pre-token, then letters
    lone = runs[(kind[runs] == OTHER) & (ends - runs == 1) & (ends < len(buf))]
    lone = lone[(buf[lone] == 0x27) & start[lone] & (kind[np.minimum(lone + 1, len(buf) - 1)] == LETTER)]
    if len(lone):
        first, second = buf[lone + 1], buf[np.minimum(lone + 2, len(buf) - 1)]
        width = np.where(np.isin(first, list(b"stmd")), 2, 0)
        for a, b in (b"re", b"ve", b"ll"):
            width[(first == a) & (second == b)] = 3
        hit, width = lone[width > 0], width[width > 0]
        start[hit + 1] = False
        start[np.minimum(hit + width, len(buf) - 1)] = True
    return np.flatnonzero(start)


def merge_pieces(vocab: Vocabulary, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols ``ids`` of pieces with ``lens`` symbols each; returns
    the merged ids, one piece after another, and their counts."""
    starts = np.cumsum(lens) - lens
    alive = np.ones(len(ids), bool)
    out = ids.copy()
    width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
    for n in np.unique(width[lens > 1]).tolist():
        group = np.flatnonzero((width == n) & (lens > 1))
        step = max(1, (1 << 21) // n)
        for lo in range(0, len(group), step):
            rows = group[lo:lo + step]
            _merge_group(vocab, out, alive, starts[rows], lens[rows], n)
    counts = np.add.reduceat(alive, starts).astype(np.int64) if len(lens) else lens
    return out[alive], counts


def _merge_group(vocab: Vocabulary, out: np.ndarray, alive: np.ndarray,
                 starts: np.ndarray, lens: np.ndarray, n: int) -> None:
    """One segment tree of ``n`` leaves per piece; leaf p is the pair that
    starts at symbol p.  Works in place on ``out`` and ``alive``.  Row i's
    symbols stand at i * w, its tree at i * 2n of flat arrays."""
    m, w, pos = len(starts), n + 1, np.arange(n)
    inf = INF if n > 1 << 14 else np.int32(2**31 - 1)
    inside = pos[None, :] < lens[:, None]
    grid = np.full((m, w), -1, np.int64)
    source = (starts[:, None] + pos[None, :])[inside]
    grid[:, :n][inside] = out[source]
    nxt = np.minimum(np.arange(1, w + 1)[None, :], lens[:, None]).ravel()   # lens: none
    prv = np.tile(np.arange(-1, n), m)
    full = np.full((m, 2 * n), inf, inf.dtype)
    pair = pos[None, :] + 1 < lens[:, None]
    r = vocab.rank(grid[:, :n][pair], grid[:, 1:][pair])
    full[:, n:][pair] = np.where(r >= 0, r * n + np.broadcast_to(pos, (m, n))[pair], inf)
    k = n
    while k > 1:
        k //= 2
        full[:, k:2 * k] = np.minimum(full[:, 2 * k:4 * k:2], full[:, 2 * k + 1:4 * k:2])
    sym, tree = grid.ravel(), full.ravel()
    row = np.flatnonzero(full[:, 1] < inf)
    shift = n.bit_length() - 1
    while len(row):
        at, base, size, first = row * w, row * (2 * n), lens[row], starts[row]
        key = tree[base + 1].astype(np.int64)
        left, new = key & (n - 1), vocab.merged[key >> shift]
        right = nxt[at + left]
        after, before = nxt[at + right], prv[at + left]
        sym[at + left] = new
        alive[first + right] = False
        nxt[at + left] = after
        prv[at + after] = left                     # position lens is never read
        follow, lead = after < size, before >= 0
        head = np.where(lead, before, left)
        two = vocab.rank(np.concatenate((new, sym[at + head])),
                         np.concatenate((np.where(follow, sym[at + after], -1), new)))
        mine, theirs = two[:len(row)], two[len(row):]
        tree[base + n + left] = np.where(follow & (mine >= 0), mine * n + left, inf)
        tree[base + n + right] = inf
        # without a predecessor, head is left itself: its leaf stays
        leaf = base + n + head
        tree[leaf] = np.where(lead, np.where(theirs >= 0, theirs * n + head, inf), tree[leaf])
        for leaf in (left, right, head):
            node = n + leaf
            for _ in range(shift):
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
        row = row[tree[base + 1] < inf]
    kept = grid[:, :n][inside]
    out[source] = np.where(alive[source], kept, out[source])


class Encoder:
    """Encodes chunks of texts and remembers the pre-tokens it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.off, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, buf, hashes, starts, ends) -> None:
        lens = ends - starts
        data = buf[ragged_index(starts, lens)]
        ids, counts = merge_pieces(self.vocab, self.vocab.byte_id[data], lens)
        special = buf[starts] == SPECIAL_BYTE
        if special.any():                       # one special token: its id
            ids[(np.cumsum(counts) - counts)[special]] = self.vocab.special[0][1]
        self.known.update(zip(hashes.tolist(), range(len(self.off), len(self.off) + len(hashes))))
        self.off = np.concatenate((self.off, len(self.flat) + np.cumsum(counts) - counts))
        self.len = np.concatenate((self.len, counts))
        self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts (bytes, n + 1 offsets): ids and offsets."""
        raw = buf.tobytes()
        parts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        if self.vocab.special:
            content = self.vocab.special[0][0]
            if content in raw:
                parts = [p.replace(content, bytes([SPECIAL_BYTE])) for p in parts]
        joined = np.frombuffer(bytes([BREAK_BYTE]).join([*parts, b""]), np.uint8)
        if not len(joined):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        starts = piece_starts(joined, self.vocab.classes)
        ends = np.append(starts[1:], len(joined))
        breaks = joined[starts] == BREAK_BYTE
        doc_end = np.cumsum(~breaks)[breaks]                 # pieces before each break
        starts, ends = starts[~breaks], ends[~breaks]
        hashes = span_hash(hash_prefix(joined), starts, ends)
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self._forget()
        slots = np.array([self.known.get(h, -1) for h in uniq.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self.off), len(self.off) + len(new))
            self._learn(joined, uniq[new], starts[first[new]], ends[first[new]])
        slot = slots[inverse]
        counts = self.len[slot]
        ids = self.flat[ragged_index(self.off[slot], counts)]
        upto = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.concatenate(([0], upto[doc_end]))

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of consecutive id runs (n + 1 offsets)."""
        v = self.vocab
        lens = v.token_len[ids]
        data = v.token_bytes[ragged_index(v.token_off[ids], lens)].tobytes()
        at = np.concatenate(([0], np.cumsum(lens)))[off].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


_ENCODER: list[Encoder] = []


def encoder_of(broadcast) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, kept between tasks."""
    if not _ENCODER or _ENCODER[0].vocab is not broadcast.value:
        _ENCODER[:] = [Encoder(broadcast.value)]
    return _ENCODER[0]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def broadcast_vocabulary(spark: SparkSession, path: str | None = None):
    return spark.sparkContext.broadcast(Vocabulary(path or default_vocabulary()))


def encoded_batches(batches, encoder: Encoder) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, token ids, token offsets) of chunks of (id, text) batches."""
    hand_back()
    for batch in batches:
        key = batch.column(0)
        buf, off = text_buffer(batch.column(1))
        for lo, hi in row_chunks(off, STEP_BYTES):
            ids, at = encoder.encode(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            yield key.slice(lo, hi - lo), ids, at
        batch = key = buf = off = ids = at = None
        hand_back()


def bpe_roundtrip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False,
                  with_text: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns per document: the id, ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``; ``ids`` and ``decoded`` themselves on request."""
    shared = broadcast_vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ("doc_id " + rows.schema["doc_id"].dataType.simpleString()
              + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
              + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else ""))

    def run(batches):
        encoder = encoder_of(shared)
        for key, ids, at in encoded_batches(batches, encoder):
            texts = encoder.decode(ids, at)
            raw, ends = ids.astype("<u4").tobytes(), (at * 4).tolist()
            cols = [key, pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])],
                             pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)
