"""Per-column keys for SURVEY §2.8 (#50-#72), §2.10 (#86-#88) and the
distance family (#96-#114).

Each key projects one column of the job that computes it, with the same
projection of that job's oracle SQL, so every inventory line has its own
check.  The jobs themselves compute all columns in one pass.
"""

from __future__ import annotations

from clickpair.functions.tokens import TOKEN_SET_FEATURES
from clickpair.functions.vectors import DISTANCES
from clickpair.plans.catalog import ORACLE, QUERIES, register


def _project(job: str, cols: list[str], keep=("pair_id",)):
    def q(spark, sf_dir):
        return QUERIES[job](spark, sf_dir).select(*keep, *cols)
    sql = f"select {', '.join([*keep, *cols])} from ({ORACLE[job]}) j"
    return q, sql


# the flagship's oracle joins the oracles of its component jobs
from clickpair.plans.pair_queries import _pair_feature_sql  # noqa: E402

ORACLE["pair_feature_table"] = _pair_feature_sql()

for _c in TOKEN_SET_FEATURES:
    _fn, _sql = _project("token_set_features", [_c])
    register(_c, _sql)(_fn)

for _d in DISTANCES:
    _fn, _sql = _project("vector_distances", [_d])
    register(_d, _sql)(_fn)

for _kind in ("tf", "idf", "tfidf"):
    for _agg in ("max", "mean"):
        _cols = [f"{t}_{_kind}_{_agg}" for t in ("query", "title", "query_title")]
        _fn, _sql = _project(f"{_kind}_stats", _cols)
        register(f"{_kind}_{_agg}", _sql)(_fn)
