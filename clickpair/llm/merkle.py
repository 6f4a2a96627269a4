"""Merkle manifest of a dataset (operator 12).

Every row is a leaf; per language the leaves, in order of id, fold eight at a
time into a subroot, and the subroots fold likewise into the root.  Each row
gets the digest of its inclusion proof and the root that folding its leaf with
the proof gives, which is the root unless the row was changed since.

The tree is worked in superblocks of 8^4 consecutive nodes:

1.  Leaves are digested in the JVM and placed: ranges of (language, id) are
    sorted apart, and the counts of a range, one row per range and language,
    give the places of its leaves.  Rows with equal ids are told apart by a
    stored number, so no range must hold them together.
2.  Up: each superblock folds to one node (``applyInPandas``), and these nodes
    are the leaves of the next round, until a language has one.  A round
    divides the rows by 4,096.
3.  Down, the subtree exchange: leaves and the nodes that their superblock needs
    from outside are cogrouped by superblock in ``applyInPandas``, which
    repeats the local fold, joins the local siblings to the outer ones, and
    folds.  In the upper rounds its rows are the outer nodes of the round below.
    A superblock needs seven outer nodes a level, whatever its size.

No task holds more than a superblock of a language; the languages themselves
are the leaves of one more tree, placed in the same way.

Edge cases: null fields are written as ``-``, so null and empty text differ; a
null language comes first and null ids come first; rows of one id stand in the
order of their digests, equal rows in any order (their leaves are equal); a null id
is never among the rows taken as changed; one leaf is its own subroot, and one
subroot the root, with the digest of nothing as proof; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import LOWER, TASK_ROWS, UPPER, placed, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, LOCAL_LEVELS = 8, 4


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns):
    """SHA-256 of the fields, each as byte count, colon and value, or ``-``."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[field(c.cast("string")) for c in columns]), 256)


def climb(nodes: list[str], total: int, levels: int = LOCAL_LEVELS) -> list[list[str]]:
    """The levels over ``nodes``, a superblock of a tree with ``total`` nodes."""
    out = [nodes]
    while total > 1 and len(out) <= levels:
        nodes = [digest("".join(nodes[i:i + RUN])) for i in range(0, len(nodes), RUN)]
        total = -(-total // RUN)
        out.append(nodes)
    return out


def local_path(levels: list[list[str]], at: int) -> list[str]:
    """Left and right siblings, joined, of node ``at`` at each level."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % RUN
        out += ["".join(nodes[run:at]), "".join(nodes[at + 1:run + RUN])]
        at //= RUN
    return out


def fold(node: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2]):
        node = digest(left + node + right)
    return node


def folded_up(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """Node tables (g, place, total, digest, ...), each with the superblock
    ``block`` of its rows; the last has one node per ``g``."""
    width = RUN ** levels
    rounds = [nodes.withColumn("block", F.expr(f"place div {width}"))]

    def top(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        total = int(t["total"].iloc[0])
        node = climb(t["digest"].tolist(), total, levels)[-1]
        return pd.DataFrame({"g": [key[0]], "place": [key[1]], "total": [-(-total // width)], "digest": node})

    while most > 1:
        most = -(-most // width)
        tops = rounds[-1].select("g", "block", "place", "total", "digest").groupBy("g", "block").applyInPandas(
            top, "g string, place long, total long, digest string")
        rounds.append(stored(tops.withColumn("block", F.expr(f"place div {width}")), "nodes"))
    return rounds


def exchange(nodes: DataFrame, outer: DataFrame, levels: int, keep: list[str], schema: str, finish) -> DataFrame:
    """Cogroup a round's nodes with the outer nodes of their superblocks;
    ``finish`` makes result columns from the kept ones, paths and roots."""
    def work(key: tuple, t: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        local = climb(t["digest"].tolist(), int(t["total"].iloc[0]), levels)
        beyond = list(o["path"].iloc[0])
        paths = [[*local_path(local, i), *beyond] for i in range(len(t))]
        return finish(t, paths, o["subroot"].iloc[0], o["root"].iloc[0])

    return nodes.select("g", "block", "place", "total", "digest", *keep).groupBy("g", "block").cogroup(
        outer.groupBy("g", "block")).applyInPandas(work, schema)


OUTER = "g string, block long, path array<string>, subroot string, root string"


def push_down(rounds: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Outer nodes of the superblocks of ``rounds[0]`` from those of the last
    round's nodes, one round after another."""
    def below(t, paths, subroot, root):
        return pd.DataFrame({"g": t["g"], "block": t["place"], "path": paths, "subroot": subroot, "root": root})

    for nodes in rounds[:0:-1]:
        outer = stored(exchange(nodes, outer, levels, [], OUTER, below), "outer")
    return outer


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             text_col: str = "text", changed=None, levels: int = LOCAL_LEVELS,
             task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``.

    ``changed`` is a condition; rows that meet it are folded from a copy whose
    text has A-Z lower-cased (None: no row is)."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    seen = leaf_digest([lower if c == text_col else F.col(c) for c in fields])
    leaves = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        (F.when(F.coalesce(changed, F.lit(False)), seen) if changed is not None else F.lit(None).cast("string")).alias("seen"))
    leaves = stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    kind = leaves.schema["doc_id"].dataType.simpleString()
    rows = stored(placed(leaves, ["doc_id", "digest", "tie"], task_rows).drop("tie"), "places")

    most = rows.agg(F.max("total")).first()[0] or 0
    rounds = folded_up(rows, most, levels)
    subroots = stored(rounds[-1].select("g", "digest"), "subroots")
    groups = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), ["of"], task_rows)
    groups = stored(groups, "groups")
    upper = folded_up(groups, groups.count(), levels)

    none = F.array().cast("array<string>")
    top = upper[-1].select("g", "block", none.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = push_down(upper, top, levels)

    def of_group(t, paths, _, root):
        return pd.DataFrame({"g": t["of"], "block": 0, "path": paths, "subroot": t["digest"], "root": root})

    outer = push_down(rounds, stored(exchange(upper[0], top, levels, ["of"], OUTER, of_group), "outer"), levels)

    def proofs(t, paths, subroot, root):
        start = t["seen"].where(t["seen"].notna(), t["digest"])
        folded = [fold(s, p) for s, p in zip(start, paths)]
        return pd.DataFrame({"doc_id": t["doc_id"], "leaf": t["digest"], "subroot": subroot, "root": root,
                             "proof_sha256": [digest("".join(p)) for p in paths], "folded_root": folded,
                             "verified": [f == root for f in folded]})

    return exchange(rounds[0], outer, levels, ["doc_id", "seen"],
                    f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                    "folded_root string, verified boolean", proofs)


def every_third(id_col: str = "doc_id"):
    """Rows where 3 divides the CRC-32 of the decimal id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0


_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_SEEN = "sha256(" + " || ".join(_FIELD.format(c if c != "text" else f"translate(text, '{UPPER}', '{LOWER}')")
                                for c in FIELDS) + ")"
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint],
    list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda s, z: xor(s >> 1, (s & 1) * 3988292384))))"""


def _tree_sql(nodes: str, base: str, groups: str) -> str:
    return f"""
{nodes} as (
  select * from ({base})
  union all
  select {groups}, lvl + 1, pos // {RUN}, sha256(string_agg(digest, '' order by pos))
  from (select *, max(pos) over (partition by {groups}) as last from {nodes}) where last > 0
  group by {groups}, lvl, pos // {RUN}),
{nodes}_runs as (select {groups}, lvl, pos // {RUN} as run, list(digest order by pos) as ds
  from (select *, max(pos) over (partition by {groups}, lvl) as last from {nodes}) where last > 0
  group by {groups}, lvl, pos // {RUN})"""


def _path_sql(path: str, base: str, runs: str) -> str:
    return f"""
{path} as (
  select * from ({base})
  union all
  select p.id, p.g, p.lvl + 1, p.pos // {RUN},
    sha256(array_to_string(list_concat(ds[:p.pos % {RUN}], [p.folded], ds[p.pos % {RUN} + 2:]), '')),
    p.proof || array_to_string(list_concat(ds[:p.pos % {RUN}], ds[p.pos % {RUN} + 2:]), '')
  from {path} p join {runs} r on r.g = p.g and r.lvl = p.lvl and r.run = p.pos // {RUN}),
{path}_end as (select id, arg_max(g, lvl) as g, arg_max(folded, lvl) as folded, arg_max(proof, lvl) as proof
               from {path} group by id)"""


SQL = f"""
with recursive
leaves as (select row_number() over () as id, doc_id, coalesce('=' || lang, '') as g, {_LEAF} as leaf,
             case when {_CRC} % 3 = 0 then {_SEEN} else {_LEAF} end as seen from documents),
places as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos from leaves),
{_tree_sql("nodes", "select g, 0 as lvl, pos, leaf as digest from places", "g")},
subs as (select g, arg_max(digest, lvl) as digest from nodes group by g),
{_tree_sql("tops", "select '' as g, 0 as lvl, row_number() over (order by g) - 1 as pos, digest from subs", "g")},
{_path_sql("low", "select id, g, 0 as lvl, pos, seen as folded, '' as proof from places", "nodes_runs")},
{_path_sql("high", "select id, '' as g, 0 as lvl, s.pos, folded, proof from low_end join (select g, row_number() over (order by g) - 1 as pos from subs) s using (g)", "tops_runs")}
select doc_id, leaf, subs.digest as subroot, root, sha256(proof) as proof_sha256, folded as folded_root,
  folded = root as verified
from places join subs using (g) join (select id, folded, proof from high_end) using (id),
  (select arg_max(digest, lvl) as root from tops)
"""
