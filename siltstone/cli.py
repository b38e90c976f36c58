"""The verbs of a store at the command line: ``python -m siltstone.cli FOLDER VERB ...``.

    p KEY VALUE   put            g KEY         get
    d KEY         delete         r LOW HIGH    range, both ends included
    l FILE        load a workload's writes     s   statistics
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.operators.store import Store
from siltstone.sources import oplog

ARGUMENTS = {"p": 2, "g": 1, "d": 1, "r": 2, "l": 1, "s": 0}


def run(spark: SparkSession, folder: str, verb: str, *words: str) -> list[str]:
    """What a verb prints.  A write becomes the newest operation of the store."""
    if ARGUMENTS.get(verb) != len(words):
        raise ValueError(__doc__)
    store = Store(spark, folder)
    if verb in "pdl":
        first = store.taken() + 1
        if verb == "l":
            log = oplog.operations(oplog.parse_workload(oplog.read_workload(spark, words[0])))
        else:
            log = oplog.normalised(spark.createDataFrame([(0, verb, words[0], words[1] if verb == "p" else None, None)], oplog.LOG_SCHEMA))
        store.flush(oplog.require_keys(log).withColumn("seq", F.col("seq") + first))
        return ["ok"]
    if verb == "s":
        row = store.stats().first()
        return [f"logical_pairs {row.logical_pairs}", *(f"{k} {n}" for k, n in sorted((row.level_counts or {}).items()))]
    found = store.get(words[0]) if verb == "g" else store.range(*words)
    # A get has one row at most; a range prints as it is asked.
    return [f"{r.k} {r.v}" for r in found.orderBy("k").toLocalIterator()] or ["not found"]


if __name__ == "__main__":
    for line in run(SparkSession.builder.appName("siltstone").getOrCreate(), *sys.argv[1:]):
        print(line)
