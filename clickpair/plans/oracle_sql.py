"""DuckDB SQL for the fixture pair tables and the oracle queries.

The fixture CTEs mirror ``clickpair.sources.fixtures``; ``with_fixtures``
prefixes a query body with the CTEs it names.
"""

from __future__ import annotations

FIXTURE_SQL = {
    "basket_pairs": """
basket_pairs as (
  with b as (
    select l_orderkey,
           string_agg(cast(l_suppkey % 10 as varchar), ' '
             order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) toks
    from lineitem group by l_orderkey),
  o as (
    select o.o_custkey, o.o_orderkey, o.o_orderstatus, b.toks,
           lead(b.toks) over w nxt, lead(o.o_orderkey) over w nk
    from orders o join b on b.l_orderkey = o.o_orderkey
    window w as (partition by o.o_custkey order by o.o_orderkey))
  select o_orderkey pair_id, o_custkey query_id, toks query, nk title_id, nxt title,
         cast(o_orderstatus = 'F' as int) as label
  from o where nxt is not null)""",
    "dialogue_pairs": """
dialogue_pairs as (
  select a.conv_id * 1000 + a.turn pair_id, u.conv_id query_id, u.text query,
         a.turn title_id, a.text title, cast(length(a.text) > 1000 as int) as label
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')""",
    "labelled_docs": """
labelled_docs as (
  select d.doc_id pair_id, d.source, d.lang, d.text, l.quality as label
  from documents d join labels l using (doc_id))""",
    "clicks": """
clicks as (
  select event_id pair_id, user_id key1, cast(hour(ts) as int) key2,
         cast(event_type = 'click' as int) as label
  from events)""",
    "vector_pairs": """
vector_pairs as (
  select a.vec_id pair_id, a.embedding x_raw, b.embedding y_raw, cast(a.label = b.label as int) as label
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)""",
}


def with_fixtures(names, body: str, extra: str = "", recursive: bool = False) -> str:
    """``with [recursive] <fixtures>[, extra] <body>``."""
    if isinstance(names, str):
        names = [names]
    parts = [FIXTURE_SQL[n].strip() for n in names]
    if extra.strip():
        parts.append(extra.strip())
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(parts) + "\n" + body.strip()
