"""A stored log-structured tree: tables as Parquet folders in levels, under a manifest.

A flush writes one table of a batch's newest versions to level 0.  A level that is
full merges into one table of the next, and so on.  Deletes leave where nothing
older lies below.  Every change writes the next version of the manifest, a small
table that names the tables; a version without its mark of success is never read,
so a change that fails leaves the state as it was.

Batches come in order of seq: a batch's operations up to the newest that the store
has taken are a repeat, as after a failure, and left out.  A store that is made with
``in_order=False`` takes batches in any order and therefore never drops a delete.

A table is sorted by key, with row-group statistics and a Bloom filter on the key,
so a point read opens few tables and decodes few pages of each.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import DEFAULT, Config
from siltstone.operators import state
from siltstone.operators.compaction import merge_runs
from siltstone.operators.layout import LEVELS
from siltstone.sources import folders

ENTRIES = "k string, op string, v string, seq bigint"
TABLES = "level int, number int, folder string, entries bigint, deletes bigint, low string, high string, newest bigint"


@dataclass(frozen=True)
class Table:
    level: int
    number: int
    folder: str
    entries: int
    deletes: int
    low: str
    high: str
    newest: int


def level_rates(entries: list[int], config: Config = DEFAULT) -> list[float]:
    """False-positive rates of levels of so many entries, as ``layout.filter_allocation`` has them."""
    total = sum(entries)
    terms = sum(n * math.log2(n) for n in entries if n) / total if total else 0
    bits = [max(0.0, config.bits_per_entry + terms - math.log2(max(1, n))) for n in entries]
    return [min(max(2.0**-b, config.least_fpr), config.most_fpr) for b in bits]


class Store:
    """The tree in one folder.  One writer at a time; readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT, in_order: bool = True):
        self.spark, self.path, self.config, self.in_order = spark, path.rstrip("/"), config, in_order

    # ------------------------------------------------------------ manifest

    def _version(self) -> int:
        """The newest version that was written to its end; 0 for an empty store."""
        done = [x for x in folders.names(self.spark, f"{self.path}/manifest") if "_SUCCESS" in folders.names(self.spark, f"{self.path}/manifest/{x}")]
        return max((int(x) for x in done), default=0)

    def _manifest(self) -> tuple[int, list[Table]]:
        """The newest seq that the store has taken, -1 at first, and all tables by level and number."""
        version = self._version()
        rows = self.spark.read.schema(TABLES).parquet(f"{self.path}/manifest/{version}").collect() if version else []
        found = sorted((Table(**r.asDict()) for r in rows), key=lambda t: (t.level, t.number))
        return max((t.newest for t in found), default=-1), [t for t in found if t.level >= 0]

    def tables(self) -> list[Table]:
        """All tables; there are at most the levels' widths of them."""
        return self._manifest()[1]

    def taken(self) -> int:
        """The newest seq that the store has taken, also of operations that later ones replaced."""
        return self._manifest()[0]

    def _commit(self, taken: int, tables: list[Table]) -> None:
        head = Table(-1, 0, "", 0, 0, "", "", taken)
        rows = self.spark.createDataFrame([tuple(asdict(t).values()) for t in [head, *tables]], TABLES)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{self._version() + 1}")

    # ------------------------------------------------------------ writes

    def _write(self, entries: DataFrame, level: int, number: int, rate: float, expected: int) -> Table:
        folder = f"{self.path}/tables/{uuid.uuid4().hex}"
        options = {"parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.fpp#k": str(rate), "parquet.bloom.filter.expected.ndv#k": str(max(1, expected))}
        parts = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // 1_000_000)))
        entries.select("k", "op", "v", "seq").repartitionByRange(parts, "k").sortWithinPartitions("k").write.options(**options).parquet(folder)
        held = self._read([folder]).agg(F.count("*"), F.count_if(F.col("op") == "d"), F.min("k"), F.max("k"), F.max("seq")).first()
        return Table(level, number, folder, *held)

    def flush(self, log: DataFrame) -> None:
        """One table of the newest versions in a batch of operations, and what compaction follows.  A batch without writes changes nothing."""
        taken, tables = self._manifest()
        newest = state.resolve(log.where(F.col("seq") > taken) if self.in_order else log, keep_tombstones=True)
        n = newest.count()
        if not n:
            return
        made = self._write(newest, 0, sum(t.level == 0 for t in tables), self.config.flush_fpr, n)
        self._commit(max(taken, made.newest), [*tables, made])
        self.compact()

    def compact(self) -> None:
        """Merge every full level into one table of the next, from the top on."""
        taken, tables = self._manifest()
        for level, width in enumerate(self.config.widths(LEVELS - 1)):
            full = [t for t in tables if t.level == level]
            if len(full) < width:
                return
            older = [t for t in tables if t.level > level]
            sizes = [sum(t.entries for t in tables if t.level == i) for i in range(level + 2)]
            sizes[level + 1], sizes[level] = sizes[level + 1] + sizes[level], 0
            merged = merge_runs([self._read([t.folder]) for t in full], purge=self.in_order and not older)
            made = self._write(merged, level + 1, sum(t.level == level + 1 for t in tables), level_rates(sizes, self.config)[level + 1], sum(t.entries for t in full))
            tables = [t for t in tables if t.level != level]
            if made.entries:
                tables.append(made)
            self._commit(taken, tables)

    def delete_segments(self) -> int:
        """Delete folders that no table of the newest version lies in, and older versions; how many went.  Safe to repeat."""
        version = self._version()
        used = {t.folder.rpartition("/")[2] for t in self.tables()}
        spare = [f"tables/{x}" for x in folders.names(self.spark, f"{self.path}/tables") if x not in used]
        spare += [f"manifest/{x}" for x in folders.names(self.spark, f"{self.path}/manifest") if int(x) < version]
        return sum(folders.delete(self.spark, f"{self.path}/{x}") for x in spare)

    # ------------------------------------------------------------ reads

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRIES)

    def _between(self, low: str, high: str) -> DataFrame:
        """Entries of the tables that may hold keys of a range; the range itself reaches the scan."""
        met = [t.folder for t in self.tables() if t.low.encode() <= high.encode() and t.high.encode() >= low.encode()]
        return self._read(met).where(F.col("k").between(low, high))

    def entries(self) -> DataFrame:
        """(level, table, k, op, v, seq) of everything stored."""
        parts = [self._read([t.folder]).select(F.lit(t.level).cast("bigint").alias("level"), F.lit(t.number).cast("bigint").alias("table"), "k", "op", "v", "seq") for t in self.tables()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"level bigint, table bigint, {ENTRIES}")

    def state(self) -> DataFrame:
        """(k, v, seq) of the live keys."""
        return state.resolve(self._read([t.folder for t in self.tables()]))

    def get(self, key: str) -> DataFrame:
        """(k, v) of one key, no row if it is absent."""
        return state.resolve(self._between(key, key)).select("k", "v")

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """(k, found, v) of every probe row of (k)."""
        return state.multi_get(self._read([t.folder for t in self.tables()]), probes)

    def range(self, low: str, high: str) -> DataFrame:
        """(k, v) of the live keys from ``low`` to ``high``; an inverted range is empty."""
        return state.resolve(self._between(low, high)).select("k", "v")

    def levels(self) -> DataFrame:
        """(level, tables, entries, deletes) of the levels that hold any table."""
        rows = self.spark.createDataFrame([tuple(asdict(t).values()) for t in self.tables()], TABLES)
        return rows.groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("tables"), F.sum("entries").alias("entries"), F.sum("deletes").alias("deletes"))

    def stats(self) -> DataFrame:
        """One row: logical_pairs, the live keys, and level_counts, a map of levels to entries.  ``dump`` has the lines."""
        live = self.state().agg(F.count("*").alias("logical_pairs"))
        counts = self.levels().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("LEVEL"), F.col("level").cast("string")), "entries")))).alias("level_counts"))
        # Two single rows.
        return live.join(counts, how="cross")

    def dump(self) -> DataFrame:
        """(level, line): ``key:value:level`` of every stored entry but the deletes."""
        return self.entries().where("op = 'p'").select("level", F.concat_ws(":", "k", "v", F.col("level").cast("string")).alias("line"))
