"""Run bench.py for a query subset at several core counts; print a table.

Usage: python tools/scaling.py [sf_dir] [cpus,...]
"""

from __future__ import annotations

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SUBSET = ["corpus_filter", "row_index", "prompt_teacher", "gen_md5", "batch_responses", "split_test",
          "vocab", "encode", "truncate", "kd_reduce", "kd_long", "sample_top_p", "manifest"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = [int(c) for c in (sys.argv[2] if len(sys.argv) > 2 else "1,2,4,8").split(",")]
    res = {}
    for c in cpus:
        env = dict(os.environ, BENCH_SF_DIR=sf_dir, BENCH_CPUS=str(c), BENCH_QUERIES=",".join(SUBSET))
        out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env,
                             capture_output=True, text=True, timeout=3600).stdout.strip().splitlines()
        res[c] = json.loads(out[-1])["queries"]
    print("| query | " + " | ".join(f"{c} cores" for c in cpus) + " |")
    print("| --- |" + " --- |" * len(cpus))
    for q in SUBSET:
        print(f"| {q} | " + " | ".join(f"{res[c].get(q, float('nan')):.2f}" for c in cpus) + " |")
    tot = {c: sum(res[c].values()) for c in cpus}
    print("| total | " + " | ".join(f"{tot[c]:.2f}" for c in cpus) + " |")


if __name__ == "__main__":
    main()
