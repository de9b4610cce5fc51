"""Run by test_llm_fault.py in its own process: task retries on, the first attempt
of tasks of each kind fails half-way; results must be those of a clean run."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join(sys.path[:1] + [os.environ.get("PYTHONPATH", "")])

from tessera.llm import bpe, simhash, warc  # noqa: E402
from tessera.llm.common import read_table  # noqa: E402
from tessera.session import build_session  # noqa: E402

SF, flags = "/root/testdata/sf0.001", sys.argv[1]


def failing(df, kind):
    """``df`` whose first attempt of each task fails after its first batch."""

    def run(batches):
        from pyspark import TaskContext

        c = TaskContext.get()
        flag = os.path.join(flags, f"{kind}-{c.partitionId()}")
        for i, batch in enumerate(batches):
            yield batch
            if not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("injected task failure")

    return df.mapInArrow(run, df.schema)


spark = build_session("local[4,4]", shuffle_partitions=4,
                      fallback_checkpoint_dir=tempfile.mkdtemp(prefix="fault-ckpt-", dir="/tmp"))
pages = read_table(spark, SF, "pages")
docs = read_table(spark, SF, "documents").repartition(3)
ok = []
for kind, table, run in (("warc", pages, warc.archive_round_trip), ("bpe", docs, bpe.round_trip),
                         ("simhash", docs, simhash.near_duplicates)):
    columns = [c for c in run(table).columns if c not in ("archive", "offset", "length")]
    want = sorted(map(tuple, run(table).select(*columns).collect()), key=str)
    got = sorted(map(tuple, run(failing(table, kind)).select(*columns).collect()), key=str)
    ok.append(got == want and len(got) > 0)
print(f"RESULT ok={all(ok)} injected={len(os.listdir(flags))}")
spark.stop()
