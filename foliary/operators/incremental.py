"""Problem 6: processing only new or changed records.

A store keeps the last state of every key seen in committed runs, cut into key ranges, and a Merkle tree over the ranges'
digests. A key's place is a number whose leading bits are the hash of its folder and whose further bits are the hash of the
key, so that keys that change together lie together; a range is a prefix of that number, as long as it takes to hold about
CAPACITY keys, however many a folder has. A run is digested range by range and compared with the saved tree from the root
down; ranges of equal digests are neither read nor written. Of the others the saved keys are read, new and changed ones are
the run's output, and ranges with any are written anew, while the tree goes on pointing at the files of the rest. Output,
ranges and tree lie in a folder of their own, which counts once the commit marker names it, the last thing written; a marker
is made once only, so of two writers one fails. A run that breaks off leaves no trace, and one that is tried again neither
skips nor repeats a record.

A range whose keys a run sees only in part has another digest and is read, though nothing in it may have changed. Rows with a
null path or scan time, or scanned after the end of their run, are left out; a null time of change equals only null. A run
without rows commits an empty output. Rows repeated within a run count once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from bisect import bisect_left
from collections import defaultdict
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliary.runtime import scratch, table

CAPACITY = 50_000
"""Keys a range should hold; where the store has more than CAPACITY * MOST_RANGES keys, ranges grow instead of their number."""
MOST_RANGES = 1 << 16
"""About how many leaves a tree may have: twice that, beside one a group, is what reaches the driver or is broadcast at most."""
FOLDER_BITS = 16
DEEPEST = 40


def place(key: Column) -> Column:
    """A key's place: FOLDER_BITS of the hash of its folder, then the hash of the key; 63 bits, never negative."""
    folder = F.xxhash64(F.regexp_extract(key, r"^(.*)/[^/]*$", 1))
    low = F.shiftrightunsigned(F.xxhash64(key), FOLDER_BITS + 1)
    return F.shiftleft(F.shiftrightunsigned(folder, 64 - FOLDER_BITS), 63 - FOLDER_BITS).bitwiseOR(low)


def bottom(node: int) -> int:
    """The first place of a node: 1 is the root, 2 n and 2 n + 1 are the halves of n."""
    depth = node.bit_length() - 1
    return (node - (1 << depth)) << (63 - depth)


def run_state(rows: DataFrame, key: str, version: list[str], order: list[Column], ident: str, by: list[str] | None = None) -> DataFrame:
    """The last row of each key (and of each value of ``by``) by ``order``, ties to the smallest ``ident``, as the state a run hands in."""
    by = by or []
    best = F.max_by(F.struct(*version, ident), F.struct(*order, -F.col(ident)))
    return rows.groupBy(*by, F.col(key).alias("key")).agg(best.alias("_s")).select(*by, "key", *[F.col(f"_s.{c}").alias(c) for c in (*version, ident)])


def ranges(counts: dict[int, int], capacity: int) -> list[int]:
    """Leaves that cover all places, from how many keys each group (the first FOLDER_BITS of a place) has: halved until a leaf
    holds no more than ``capacity``, groups that are too large as often as their size asks."""
    groups = sorted(counts)
    sums = [0, *accumulate(counts[g] for g in groups)]
    out: list[int] = []

    def visit(node: int, depth: int) -> None:
        low = (node - (1 << depth)) << (FOLDER_BITS - depth)
        n = sums[bisect_left(groups, low + (1 << (FOLDER_BITS - depth)))] - sums[bisect_left(groups, low)]
        if n <= capacity:
            out.append(node)
        elif depth == FOLDER_BITS:
            out.extend(halves(node, n, capacity))
        else:
            visit(2 * node, depth + 1)
            visit(2 * node + 1, depth + 1)

    visit(1, 0)
    return out


def halves(node: int, keys: int, capacity: int) -> list[int]:
    """The nodes below ``node`` that hold about ``capacity`` keys each."""
    more = min(DEEPEST - node.bit_length() + 1, (-(-keys // capacity) - 1).bit_length())
    return [(node << more) + k for k in range(1 << more)]


def digests_above(leaves: dict[int, list]) -> dict[int, str]:
    """Digest of every node, from those of the leaves."""
    by_depth: dict[int, dict[int, str]] = defaultdict(dict)
    for n, d in leaves.items():
        by_depth[n.bit_length()][n] = repr(list(d))
    for bits in range(max(by_depth, default=1), 1, -1):
        kids: dict[int, list] = defaultdict(list)
        for n in sorted(by_depth[bits]):
            kids[n >> 1].append((n, by_depth[bits][n]))
        for parent, own in kids.items():
            by_depth[bits - 1][parent] = hashlib.sha256(repr(own).encode()).hexdigest()
    return {n: d for level in by_depth.values() for n, d in level.items()}


def descend(before: dict[int, str], now: dict[int, str], leaves: set[int]) -> list[int]:
    """Those of ``leaves`` whose digests differ, found from the root down; equal subtrees are not entered."""
    found, front = [], [1]
    while front:
        front = [n for n in front if n in now and now[n] != before.get(n)]
        found += [n for n in front if n in leaves]
        front = [k for n in front for k in (2 * n, 2 * n + 1)]
    return found


class Store:
    """A folder of committed versions."""

    def __init__(self, spark: SparkSession, path: str, version: list[str], ident: str, capacity: int = CAPACITY):
        self.spark, self.path, self.version, self.ident, self.capacity = spark, path.rstrip("/"), version, ident, capacity
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.read_keys = 0
        """Saved keys that the last run read; they lie in the ranges it touched."""

    def commits(self) -> dict[int, dict]:
        """Version number -> run and folder, of the versions whose marker was written."""
        root = self._fs_path(f"{self.path}/commits")
        if not self._fs.exists(root):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return {int(n): json.loads(self._get(f"{self.path}/commits/{n}")) for n in sorted(names) if n.isdigit()}

    def process(self, run: str, rows: DataFrame) -> DataFrame:
        """New or changed records of ``rows`` (key, *version, ident; one a key; read several times, so best a stored table) since
        the last committed run that saw them.

        A run that is committed already is not processed again: its stored output comes back."""
        done = self.commits()
        for c in done.values():
            if c["run"] == run:
                return self._output(f"{self.path}/{c['home']}")
        last = max(done, default=0)
        name = f"v{last + 1:08d}-{uuid.uuid4().hex[:12]}"
        home = f"{self.path}/{name}"
        tree = json.loads(self._get(f"{self.path}/{done[last]['home']}/tree.json")) if last else {"cover": [], "leaves": []}
        leaves = {n: v for n, *v in tree["leaves"]}  # leaf -> digest, keys, folder of its file
        cover, leaves = self._run(home, name, rows, tree["cover"], leaves)
        self._put(f"{home}/tree.json", json.dumps({"cover": cover, "leaves": [[n, *v] for n, v in leaves.items()]}))
        self._put(f"{self.path}/commits/{last + 1:08d}", json.dumps({"run": run, "home": name}))
        return self._output(home)

    def _run(self, home: str, name: str, rows: DataFrame, cover: list[int], leaves: dict[int, list]) -> tuple[list[int], dict[int, list]]:
        at = rows.select(place(F.col("key")).alias("_at"), "key", *self.version, self.ident)
        if not cover:
            groups = at.groupBy(F.shiftrightunsigned("_at", 63 - FOLDER_BITS).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"))
            counts = {r["g"]: r["n"] for r in groups.collect()}  # 2**FOLDER_BITS rows at most
            cover = ranges(counts, self._size(sum(counts.values())))
        leafed = self._leafed(at, cover)
        touched = cover
        if leaves:
            mine = {r["leaf"]: self._digest_of(r) for r in leafed.groupBy("leaf").agg(*self._digest()).collect()}  # one row a range
            touched = descend(digests_above({n: v[0] for n, v in leaves.items()}), digests_above(mine), set(mine))
        old = [n for n in touched if n in leaves]
        self.read_keys = sum(leaves[n][1] for n in old)
        both = self._touched(leafed, touched, old, leaves)
        both.write.parquet(f"{home}/touched")
        both = self.spark.read.schema(both.schema).parquet(f"{home}/touched")
        both.filter("changed").select("key", *self.version, self.ident).write.parquet(f"{home}/output")
        after = {r["leaf"]: r for r in both.groupBy("leaf").agg(*self._digest(), F.max("changed").alias("c")).filter("c").collect()}
        leaves = {n: v for n, v in leaves.items() if n not in after}
        if after:
            size = self._size(sum(r["n"] for r in after.values()) + sum(v[1] for v in leaves.values()))
            into = {n: halves(n, r["n"], size) if r["n"] > 2 * size else [n] for n, r in after.items()}
            leaves |= {n: [self._digest_of(r), r["n"], name] for n, r in after.items() if into[n] == [n]}
            cover = [m for n in cover for m in into.get(n, [n])]
            state = both.join(F.broadcast(self._nodes(after)), "leaf").select("leaf", "_at", "key", *self.version, self.ident)
            halved = [m for n in after if into[n] != [n] for m in into[n]]
            state = self._leafed(state.drop("leaf"), cover) if halved else state
            state.repartition("leaf").write.partitionBy("leaf").parquet(f"{home}/state")
            if halved:
                new = self._state(home, state.schema).join(F.broadcast(self._nodes(halved)), "leaf")
                leaves |= {r["leaf"]: [self._digest_of(r), r["n"], name] for r in new.groupBy("leaf").agg(*self._digest()).collect()}
        self._fs.delete(self._fs_path(f"{home}/touched"), True)
        return cover, leaves

    def _size(self, keys: int) -> int:
        return max(self.capacity, keys // MOST_RANGES)

    def _digest(self) -> list[Column]:
        content = [F.col("key"), *[x for c in self.version for x in (F.col(c), F.col(c).isNull())]]
        return [F.bit_xor(F.xxhash64(*content)).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), *content)).alias("b"), F.count(F.lit(1)).alias("n")]

    @staticmethod
    def _digest_of(r) -> list:
        return [str(r["a"]), str(r["b"]), r["n"]]

    def _nodes(self, nodes) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in nodes], "leaf long")

    def _leafed(self, at: DataFrame, cover: list[int]) -> DataFrame:
        """The rows with the leaf they lie in. What is broadcast are the leaves of each group: no more in all than there are
        leaves and groups."""
        of: dict[int, list[tuple[int, int]]] = defaultdict(list)
        bits = min(FOLDER_BITS, max(cover).bit_length() - 1)
        for n in sorted(cover, key=bottom):
            g = bottom(n) >> (63 - bits)
            for k in range(g, g + (1 << max(0, bits - n.bit_length() + 1))):
                of[k].append((bottom(n), n))
        if len(cover) == 1:
            return at.withColumn("leaf", F.lit(cover[0]).cast("long"))
        table_of = self.spark.createDataFrame(list(of.items()), "_g int, _in array<struct<low: long, node: long>>")
        rows = at.withColumn("_g", F.shiftrightunsigned("_at", 63 - bits).cast("int")).join(F.broadcast(table_of), "_g")
        leaf = F.element_at(F.filter("_in", lambda x: x["low"] <= F.col("_at")), -1)["node"]
        return rows.withColumn("leaf", leaf).drop("_g", "_in")

    def _state(self, home: str, schema: StructType, of: list[int] | None = None) -> DataFrame:
        """Saved keys of a version, of the leaves ``of`` only, whose files alone are opened."""
        base = f"{home}/state"
        kinds = StructType([f for f in schema.fields if f.name != "leaf"] + [schema["leaf"]])
        return self.spark.read.schema(kinds).option("basePath", base).parquet(*([base] if of is None else [f"{base}/leaf={n}" for n in of]))

    def _touched(self, leafed: DataFrame, touched: list[int], old: list[int], leaves: dict[int, list]) -> DataFrame:
        """The keys of the touched ranges: the run's over the saved, and whether they are new or changed."""
        cols = ["leaf", "_at", "key", *self.version, self.ident]
        rows = leafed.join(F.broadcast(self._nodes(touched)), "leaf").select(*cols, F.lit(True).alias("seen"))
        homes = defaultdict(list)
        for n in old:
            homes[leaves[n][2]].append(n)
        for home, of in homes.items():
            rows = rows.unionByName(self._state(f"{self.path}/{home}", leafed.select(*cols).schema, of).select(*cols, F.lit(False).alias("seen")))
        values = F.struct(*self.version, self.ident)
        both = rows.groupBy("leaf", "_at", "key").agg(F.max_by(values, "seen").alias("_now"), F.max("seen").alias("seen"), F.max(F.when(~F.col("seen"), values)).alias("_old"))
        same = reduce(lambda x, y: x & y, [F.col(f"_now.{c}").eqNullSafe(F.col(f"_old.{c}")) for c in self.version])
        changed = F.col("seen") & (F.col("_old").isNull() | ~same)
        return both.select("leaf", "_at", "key", *[F.col(f"_now.{c}").alias(c) for c in (*self.version, self.ident)], changed.alias("changed"))

    def _output(self, home: str) -> DataFrame:
        return self.spark.read.parquet(f"{home}/output")

    def _get(self, path: str) -> str:
        stream = self._fs.open(self._fs_path(path))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return text

    def _put(self, path: str, text: str) -> None:
        """A file that must not be there yet."""
        out = self._fs.create(self._fs_path(path), False)
        out.write(bytearray(text.encode()))
        out.close()


def changed_scans(scans: DataFrame, runs: DataFrame, store_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``scan_id`` of the files that each succeeded run of ``runs`` finds new or changed, run by run through one store. The
    scans are read once: the states of all runs are made together and laid down by run."""
    spark = scans.sparkSession
    version = ["size_bytes", "modified_time_secs"]
    store = Store(spark, store_path, version, "scan_id", capacity)
    good = runs.filter("run_status = 'succeeded' and run_id is not null").select(F.col("run_id").alias("_run"), "finished_at")
    done = [r["_run"] for r in good.select("_run").distinct().orderBy("_run").collect()]  # one row a run, as runs follow each other
    if not done:
        return spark.createDataFrame([], StructType([scans.schema["scan_id"]]))
    rows = scans.select("run_id", "source_path", *version, "scanned_at", "scan_id").filter("source_path is not null and scanned_at is not null")
    rows = rows.join(F.broadcast(good), F.col("run_id") == F.col("_run")).filter("finished_at is null or scanned_at <= finished_at")
    states = run_state(rows, "source_path", version, [F.col("scanned_at")], "scan_id", ["run_id"])
    states.write.partitionBy("run_id").parquet(f"{store.path}/incoming")
    states = spark.read.schema(StructType([*[states.schema[c] for c in states.columns[1:]], states.schema["run_id"]])).parquet(f"{store.path}/incoming")
    outputs = [store.process(str(r), states.filter(F.col("run_id") == r).drop("run_id")) for r in done]
    return reduce(DataFrame.unionByName, outputs).select("scan_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return changed_scans(table(spark, sf, "scan_record"), table(spark, sf, "run_log"), scratch(spark, "incremental"))


P6_SQL = """
WITH ok AS (SELECT run_id, finished_at FROM run_log WHERE run_status = 'succeeded'),
rows_ok AS (SELECT s.* FROM scan_record s JOIN ok USING (run_id) WHERE s.scanned_at <= coalesce(ok.finished_at, s.scanned_at) AND s.source_path IS NOT NULL),
state AS (SELECT * FROM rows_ok QUALIFY row_number() OVER (PARTITION BY run_id, source_path ORDER BY scanned_at DESC, scan_id) = 1),
seen AS (SELECT scan_id, size_bytes, modified_time_secs, row_number() OVER w AS k, lag(size_bytes) OVER w AS old_size, lag(modified_time_secs) OVER w AS old_time
         FROM state WINDOW w AS (PARTITION BY source_path ORDER BY run_id))
SELECT DISTINCT scan_id FROM seen
WHERE k = 1 OR size_bytes IS DISTINCT FROM old_size OR modified_time_secs IS DISTINCT FROM old_time
"""
