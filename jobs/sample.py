"""Sample documents, and add chosen ones.

    spark-submit jobs/sample.py N INPUT OUTPUT [ID ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicspark.operators.sampling import sample_and_select  # noqa: E402
from topicspark.session import build_session  # noqa: E402
from topicspark.sources.sinks import write_text  # noqa: E402
from topicspark.sources.text import read_lines  # noqa: E402


def main(argv: list[str], spark=None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("n", type=int)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("ids", nargs="*")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--many-files", action="store_true", help="let every task write its own file")
    a = parser.parse_args(argv)
    spark = spark or build_session("sample")
    sample = sample_and_select(read_lines(spark, a.input), a.n, a.seed, a.ids)
    write_text(sample, a.output, single_file=not a.many_files)
    print(f"{a.n} documents and {len(a.ids)} chosen ones: {a.input} to {a.output}")


if __name__ == "__main__":
    main(sys.argv[1:])
