"""Keep the first three comma fields of each line.

    spark-submit jobs/rows.py INPUT OUTPUT
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicspark.session import build_session  # noqa: E402
from topicspark.sources.sinks import write_rows  # noqa: E402
from topicspark.sources.text import read_lines  # noqa: E402


def main(argv: list[str], spark=None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("input")
    parser.add_argument("output")
    a = parser.parse_args(argv)
    spark = spark or build_session("rows")
    write_rows(read_lines(spark, a.input, 2), a.output)


if __name__ == "__main__":
    main(sys.argv[1:])
