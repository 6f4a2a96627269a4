"""Print the formatted physical plan of registered queries.

    python -m clickpair.plans.explain <sf_dir> <key> [<key> ...]
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> None:
    from clickpair.plans import catalog
    from clickpair.session import get_spark
    catalog.load_all()
    sf_dir, keys = argv[0], argv[1:]
    spark = get_spark(app="clickpair-explain", master="local[8]", shuffle_partitions=16)
    for k in keys:
        print(f"===== {k}")
        catalog.QUERIES[k](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
