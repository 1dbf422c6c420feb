"""Change impact: who is reached by calls, level by level, from one or many changed functions."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.names import form_refers, is_test_file, name_forms, simple_name
from codestrata.operators.lookup import callee_words
from codestrata.session import ship
from codestrata.sources.tables import dotted

MAX_DEPTH = 3
#: A key is depth, number of the file and line in one LONG, so the least key is the least (depth, file, line).
LINE_BITS, DEPTH_SHIFT = 33, 60
#: Pairs of a group and a caller that one task brings together: as rows, and as numbers of an array.
TASK_PAIRS, TASK_CELLS = 500_000, 4_000_000
#: Numbers of one array that a task holds at a time.
BLOCK = 2_000_000
BITS_SCHEMA = "file_no int, reached binary, shared binary, callers array<bigint>, direct array<bigint>"


def numbered(values: DataFrame, number: str, stage) -> DataFrame:
    """The distinct values of a one-column frame that are not null, with their rank from 1 as ``number``; no task sees more than a range of them."""
    column = values.columns[0]
    rows = stage.keep(values.where(F.col(column).isNotNull()).distinct().orderBy(column).select(
        column, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    start = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(earlier, F.lit(0)).alias("_start"))
    return stage.keep(rows.join(start, "_part").select(column, (F.col("_at") + F.col("_start") + 1).alias(number)))


def key_depth(key: Column) -> Column:
    return F.shiftright(key, DEPTH_SHIFT).cast("int")


def key_file(key: Column) -> Column:
    """Number of the file; 0 for a null path."""
    return F.shiftright(key, LINE_BITS).bitwiseAND((1 << (DEPTH_SHIFT - LINE_BITS)) - 1)


def key_line(key: Column) -> Column:
    line = key.bitwiseAND((1 << LINE_BITS) - 1)
    return F.when(line > 0, line - (1 << 31) - 1).cast("int")


def least_keys(batches, steps: np.ndarray, levels: int, files: list):
    """Per block of callers: their names, the group ids and the least key of each (group, caller), 8 or more levels deep where there is none.

    ``steps`` has (group_id, node, late) by group. In the keys the files are places in ``files[0]``, the sorted numbers met, so a table by file can be small.
    """
    depth, place = np.uint64(DEPTH_SHIFT), np.uint64(LINE_BITS)
    every = [b for b in batches if b.num_rows]
    if not every or not len(steps):
        return
    table = pa.Table.from_batches(every)
    names = table["caller"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code, node = code[order], table["node"].to_numpy()[order]
    key = table["key"].to_numpy()[order].astype(np.uint64)
    number = (key >> place) & np.uint64((1 << (DEPTH_SHIFT - LINE_BITS)) - 1)
    files.append(np.unique(number))
    local = np.searchsorted(files[0], number).astype(np.uint64)
    key = (key >> depth << depth) | (local << place) | (key & np.uint64((1 << LINE_BITS) - 1))
    nodes, at = np.unique(steps[:, 1], return_inverse=True)
    known = np.isin(node, nodes)
    code, key, node = code[known], key[known], np.searchsorted(nodes, node[known])
    groups, starts = np.unique(steps[:, 0], return_index=True)
    late = (steps[:, 2].astype(np.uint64) << depth)[:, None]
    width = max(1, BLOCK // len(steps))
    for first in range(0, len(names.dictionary), width):
        low, high = np.searchsorted(code, [first, first + width])
        met = np.full((len(nodes), min(width, len(names.dictionary) - first)), 8 << DEPTH_SHIFT, dtype=np.uint64)
        met[node[low:high], code[low:high] - first] = key[low:high]
        least = np.minimum.reduceat(met[at] + late, starts, axis=0)
        least[least >= np.uint64((levels + 1) << DEPTH_SHIFT)] = 8 << DEPTH_SHIFT
        yield names.dictionary.slice(first, met.shape[1]), groups, least


def caller_groups(batches, steps: np.ndarray, levels: int):
    """caller, depth and group_ids: the groups that reach the caller at that depth."""
    for names, groups, least in least_keys(batches, steps, levels, []):
        depths = (least >> np.uint64(DEPTH_SHIFT)).astype(np.int8)
        for k, name in enumerate(names):
            rows = [(d, groups[depths[:, k] == d]) for d in range(1, levels + 1)]
            rows = [(d, g) for d, g in rows if len(g)]
            yield pa.RecordBatch.from_arrays([
                pa.array([name.as_py()] * len(rows), pa.string()), pa.array([d for d, _ in rows], pa.int32()),
                pa.array([g for _, g in rows], pa.list_(pa.int32()))], names=["caller", "depth", "group_ids"])


def file_bits(batches, steps: np.ndarray, levels: int, size: int):
    """BITS_SCHEMA: for each file the groups with a caller in it and those with more than one, by bit; one row without a file has the sums by group."""
    files, counts, sums = [], None, np.zeros((2, size), np.int64)
    for _, groups, least in least_keys(batches, steps, levels, files):
        if counts is None:
            counts = np.zeros((len(files[0]), size), np.uint8)
        depths = least >> np.uint64(DEPTH_SHIFT)
        local = ((least >> np.uint64(LINE_BITS)) & np.uint64((1 << (DEPTH_SHIFT - LINE_BITS)) - 1)).astype(np.int64)
        hit = depths <= levels
        sums[0, groups] += hit.sum(axis=1)
        sums[1, groups] += (depths == 1).sum(axis=1)
        for k in range(least.shape[1]):
            to = local[hit[:, k], k], groups[hit[:, k]]
            counts[to] = np.minimum(counts[to] + 1, 2)
    if counts is None:
        return
    yield _bits(-1, None, None, sums)
    for number, row in zip(files[0], counts):
        if number > 0 and row.any():
            yield _bits(int(number), row > 0, row > 1, None)


def _bits(number: int, reached, shared, sums) -> pa.RecordBatch:
    packed = lambda bits: pa.array([None if bits is None else np.packbits(bits, bitorder="little").tobytes()], pa.binary())
    listed = lambda k: pa.array([None if sums is None else sums[k]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), packed(reached), packed(shared), listed(0), listed(1)],
                                      names=["file_no", "reached", "shared", "callers", "direct"])


def merged_bits(batches):
    """The rows of ``file_bits``, which lie and are sorted by file, as one row a file; the sums are added up."""
    now = None
    for batch in batches:
        for number, reached, shared, callers, direct in zip(*(batch.column(k) for k in range(5))):
            number = number.as_py()
            if number < 0:
                new = [number, None, None, np.stack([callers.values.to_numpy(), direct.values.to_numpy()])]
            else:
                new = [number, *(np.frombuffer(x.as_buffer(), np.uint8) for x in (reached, shared)), None]
            if now is None or now[0] != number:
                if now is not None:
                    yield _merged(now)
                now = new
            elif number < 0:
                now[3] = now[3] + new[3]
            else:
                now = [number, now[1] | new[1], now[2] | new[2] | (now[1] & new[1]), None]
    if now is not None:
        yield _merged(now)


def _merged(row: list) -> pa.RecordBatch:
    unpacked = lambda x: None if x is None else np.unpackbits(x, bitorder="little")
    return _bits(row[0], unpacked(row[1]), unpacked(row[2]), row[3])


def files_by_group(batches, size: int):
    """group_id and files: how many of the files seen here each group has a caller in."""
    total = np.zeros(size, np.int64)
    for batch in batches:
        for reached in batch.column(0):
            total += np.unpackbits(np.frombuffer(reached.as_buffer(), np.uint8), bitorder="little")[:size]
    groups = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(total[groups], pa.int64())], names=["group_id", "files"])


def groups_by_file(batches):
    """file_no, many and group_ids: the groups with more than one caller in the file, and those with one."""
    for batch in batches:
        for number, reached, shared in zip(*(batch.column(k) for k in range(3))):
            some, many = (np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), bitorder="little").astype(bool) for x in (reached, shared))
            yield pa.RecordBatch.from_arrays([
                pa.array([number.as_py()] * 2, pa.int32()), pa.array([True, False]),
                pa.array([np.flatnonzero(many), np.flatnonzero(some & ~many)], pa.list_(pa.int32()))], names=["file_no", "many", "group_ids"])


class Impact:
    """Every caller reached from each name in ``sources`` (column ``source``).

    The walk is over names: a caller's own qualified name is looked up anew,
    and its simple name reaches the callers of namesakes too. Nodes at depth
    max_depth are still expanded, so depths go to max_depth + 1. A caller
    counts at the level that reaches it first, with the least (file, line) of
    that level; the source itself is never listed.

    A name with a ``.`` shares nearly all callees that refer to it with all
    names of its last segment (``shared``), so that segment is a node of its
    own and what it reaches is found once for all of them; only the few other
    callees (``own``) are followed from each source. A source is then the least
    of its own rows and of the rows of the segments it comes to, each later by
    the depth it comes to it. Sources for which these are the same are one
    group. The last join lies by caller, so nothing of the result's size is shuffled.
    """

    def __init__(self, sites: DataFrame, sources: DataFrame, stage, max_depth: int = MAX_DEPTH):
        if not 0 <= max_depth <= 6:
            raise ValueError("a key has room for depths up to 7")
        self.stage, self.levels = stage, max_depth + 1
        self.sources = stage.keep(sources.select("source").where("source is not null").distinct())
        line = F.when(F.col("line").isNull(), 0).otherwise(F.col("line").cast("long") + (1 << 31) + 1)
        # the sites are read once and the least place is taken before anything else moves them; a null file is the least
        least = F.min(F.struct("file", line.alias("line"))).alias("at")
        calls = stage.keep(sites.where("caller is not null").groupBy("callee_name", "caller").agg(least).select("callee_name", "caller", "at.file", "at.line"))
        self.files = numbered(calls.select("file"), "file_no", stage)
        place = F.shiftleft(F.coalesce("file_no", F.lit(0)).cast("long"), LINE_BITS) + F.col("line")
        self.calls = stage.keep(calls.join(self.files, "file", "left").select("callee_name", "caller", place.alias("place")))

    @cached_property
    def names(self) -> DataFrame:
        """target, word (its last segment) and method (whether it has more segments) of each caller and source."""
        every = self.calls.select(F.col("caller").alias("target")).union(self.sources).distinct()
        return self.stage.keep(every.withColumn("word", simple_name(F.col("target"))).withColumn("method", F.col("word") != dotted(F.col("target"))))

    @cached_property
    def hops(self) -> tuple[DataFrame, DataFrame]:
        """(word, caller, place) of the callees that mean all names of a last segment, and (target, caller, place) of each name's other callees."""
        stage = self.stage
        low = F.lower("word")
        ends = F.startswith("callee_low", low) | F.endswith("callee_low", low)
        words = stage.keep(callee_words(self.calls).withColumn("shared", ~F.col("scoped") & ends))
        methods = self.names.where("method")
        shared = words.where("shared").select("word", "callee_name").join(methods.select("word").distinct(), "word", "left_semi")

        def meant(words: DataFrame, names: DataFrame) -> DataFrame:
            forms = names.select("target", "word", *name_forms(F.col("target")))
            return words.join(forms, "word").where(form_refers()).select("target", "callee_name")

        own = meant(words, self.names.where("not method")).union(meant(words.where("not shared"), methods))
        met = lambda callees, key: callees.join(self.calls, "callee_name").groupBy(key, "caller").agg(F.min("place").alias("place"))
        return stage.keep(met(shared, "word")), stage.keep(met(own, "target"))

    def _walk(self, start: str, frontier: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(start, caller, depth, place) reached from ``frontier`` (start, caller) and ``words`` (start, word), and the depths of the words come to.

        Without ``words`` the callees that mean all names of a segment are not followed.
        """
        shared, own = self.hops
        stage, methods = self.stage, self.names.where("method").select(F.col("target").alias("caller"), "word")
        found = frontier.select(start, "caller", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))
        come = words.withColumn("depth", F.lit(0)) if words is not None else None
        for depth in range(1, self.levels + 1):
            step = frontier.select(start, F.col("caller").alias("target")).join(own, "target").select(start, "caller", "place")
            if words is not None:
                step = step.union(words.join(shared, "word").select(start, "caller", "place"))
            step = step.groupBy(start, "caller").agg(F.min("place").alias("place")).join(found.select(start, "caller"), [start, "caller"], "left_anti")
            frontier = stage.keep(step.select(start, "caller", F.lit(depth).alias("depth"), "place"))
            if frontier.isEmpty():
                break
            found = found.unionByName(frontier)
            if words is not None:
                words = stage.keep(frontier.join(methods, "caller").select(start, "word").distinct().join(come, [start, "word"], "left_anti"))
                come = come.unionByName(words.withColumn("depth", F.lit(depth)))
        return found, come

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(node, caller, key) reached from each node, (group_id, node, late) of the nodes of each group, (group_id, source)."""
        stage = self.stage
        own, _ = self._walk("source", self.sources.select("source", F.col("source").alias("caller")))
        methods = self.names.where("method").select(F.col("target").alias("caller"), "word")
        reached = stage.keep(own.where("depth > 0"))
        alone = reached.select("source").distinct()
        steps = stage.keep(own.where(F.col("depth") < self.levels).join(methods, "caller").groupBy("source", "word").agg(F.min("depth").alias("late")))

        words = stage.keep(steps.select("word").distinct())
        nobody = words.select(F.col("word").alias("node"), F.col("word").alias("caller")).limit(0)
        shared, come = self._walk("node", nobody, words.select(F.col("word").alias("node"), "word"))
        # a segment that another one leads to as early adds nothing
        led = steps.withColumnRenamed("word", "node").join(come.where("depth > 0").withColumnRenamed("depth", "more"), "node").groupBy(
            "source", "word").agg(F.min(F.col("late") + F.col("more")).alias("by"))
        steps = steps.join(led, ["source", "word"], "left").where("by is null or by > late").drop("by")

        common, single = (lambda c: F.concat(F.lit("."), c)), (lambda c: F.concat(F.lit("@"), c))
        labels = words.select(common(F.col("word")).alias("label")).union(alone.select(single(F.col("source"))))
        ids = numbered(labels, "group_id", stage)
        node = ids.select("label", F.col("group_id").alias("node"))
        like = steps.join(alone, "source", "left_anti").select(common(F.col("word")).alias("label"), "source")
        members = stage.keep(like.union(alone.select(single(F.col("source")), "source")).join(ids, "label").select("group_id", "source"))
        apart = steps.join(alone, "source", "left_semi").select("source", common(F.col("word")).alias("label"), "late").join(node, "label").select(
            single(F.col("source")).alias("label"), "node", "late").join(ids, "label").select("group_id", "node", "late")
        itself = members.select("group_id", F.col("group_id").alias("node"), F.lit(0).alias("late")).distinct()
        key = F.shiftleft(F.col("depth").cast("long"), DEPTH_SHIFT) + F.col("place")
        rows = shared.where("depth > 0").select(common(F.col("node")).alias("label"), "caller", key.alias("key")).union(
            reached.select(single(F.col("source")), "caller", key)).join(node, "label").select("node", "caller", "key")
        return stage.keep(rows), stage.keep(apart.union(itself)), members

    @cached_property
    def pairs(self) -> int:
        rows, steps, _ = self.parts
        return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(steps, "node").agg(F.sum("n")).first()[0] or 0

    @cached_property
    def tasks(self) -> int:
        """Tasks that the callers are spread over."""
        return max(int(self.parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.pairs // TASK_PAIRS))

    def _later(self, met: DataFrame) -> DataFrame:
        """(group_id, caller, key) of rows that have met the nodes of their groups."""
        late = F.shiftleft(F.col("late").cast("long"), DEPTH_SHIFT)
        in_time = met.where(key_depth(F.col("key")) + F.col("late") <= self.levels)
        return in_time.groupBy("group_id", "caller").agg(F.min(F.col("key") + late).alias("key"))

    @cached_property
    def groups(self) -> DataFrame:
        """(group_id, caller, key), one row each; it lies by caller."""
        rows, steps, _ = self.parts
        # three numbers for each group and segment are handed to every task: far fewer than what they give there
        return self._later(rows.repartition(self.tasks, "caller").join(F.broadcast(steps), "node"))

    @cached_property
    def own_rows(self) -> DataFrame:
        """(group_id, source, own_key): each source with the key it has in its group, null if it doesn't come back to itself."""
        rows, steps, members = self.parts
        met = rows.join(members.withColumnRenamed("source", "caller"), "caller").join(steps, ["group_id", "node"])
        back = self._later(met).select("group_id", F.col("caller").alias("source"), F.col("key").alias("own_key"))
        return self.stage.keep(members.join(back, ["group_id", "source"], "left"))

    @cached_property
    def step_table(self) -> np.ndarray:
        """(group_id, node, late) by group, in the driver: three numbers for each group and segment, which every task is handed."""
        steps = self.parts[1].toPandas()
        return steps.sort_values("group_id", kind="stable")[["group_id", "node", "late"]].to_numpy(np.int64).reshape(-1, 3)

    def _by_caller(self, function, schema: str, *more) -> DataFrame:
        """What ``function`` makes of all rows of some callers; they are joined to groups as numbers of an array, not as rows."""
        rows, steps, levels = self.parts[0], self.step_table, self.levels
        ship(rows.sparkSession)
        pairs = self.pairs
        tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_CELLS))
        return rows.repartition(tasks, "caller").mapInArrow(lambda batches: function(batches, steps, levels, *more), schema)

    @cached_property
    def caller_groups(self) -> DataFrame:
        """(group_id, caller, depth), one row each; it lies by caller."""
        lists = self._by_caller(caller_groups, "caller string, depth int, group_ids array<int>")
        return lists.select("caller", "depth", F.explode("group_ids").alias("group_id"))

    @cached_property
    def bits(self) -> DataFrame:
        """``file_bits`` of all callers, one row a file and one with the sums. Groups are bits and numbers in a list, by their id."""
        size = int(self.step_table[:, 0].max(initial=0)) + 1
        some = self._by_caller(file_bits, BITS_SCHEMA, -(-size // 8) * 8)
        return self.stage.keep(some.repartition("file_no").sortWithinPartitions("file_no").mapInArrow(merged_bits, BITS_SCHEMA))

    @cached_property
    def sums(self) -> DataFrame:
        """(group_id, callers, direct, files) of the groups that reach anything."""
        size = -(-(int(self.step_table[:, 0].max(initial=0)) + 1) // 8) * 8
        both = self.bits.where("file_no < 0").select(F.posexplode(F.arrays_zip("callers", "direct")).alias("group_id", "x")).where("x.callers > 0")
        files = self.bits.where("file_no > 0").select("reached").mapInArrow(lambda batches: files_by_group(batches, size), "group_id int, files bigint")
        files = files.groupBy("group_id").agg(F.sum("files").alias("files"))
        return both.select("group_id", "x.callers", "x.direct").join(files, "group_id", "left").select("group_id", "callers", "direct", F.coalesce("files", F.lit(0)).alias("files"))

    def direct_callers(self) -> DataFrame:
        """source and caller of depth 1, distinct."""
        rows, steps, members = self.parts
        met = rows.where(key_depth(F.col("key")) == 1).join(F.broadcast(steps.where("late = 0")), "node").select("group_id", "caller").distinct()
        return met.repartition(self.tasks, "caller").join(F.broadcast(members), "group_id").where("caller <> source").select("source", "caller")

    def reached_files(self) -> DataFrame:
        """source and file, distinct, of the callers reached."""
        own = self.own_rows.select("group_id", "source", F.coalesce(key_file(F.col("own_key")), F.lit(0)).alias("own_file"))
        files = self.files.select(F.col("file_no").cast("int").alias("file_no"), "file")
        numbers = self.bits.where("file_no > 0").select("file_no", "reached", "shared").mapInArrow(groups_by_file, "file_no int, many boolean, group_ids array<int>")
        every = numbers.join(files, "file_no").select("file_no", "file", "many", F.explode("group_ids").alias("group_id"))
        return every.join(F.broadcast(own), "group_id").where("many or own_file <> file_no").select("source", "file")

    def counts(self) -> DataFrame:
        """source, direct_callers, all_affected and affected_files of the sources that anything is reached from."""
        key = F.col("own_key")
        own = self.own_rows.withColumn("file_no", key_file(key).cast("int"))
        byte = F.expr("cast(conv(hex(substring(shared, cast(group_id div 8 + 1 as int), 1)), 16, 10) as int)")
        # the source has its key in its group, so the group has a caller in that file: itself alone, or more
        alone = self.bits.where("file_no > 0").select("file_no", "shared").join(F.broadcast(own), "file_no").where(
            byte.bitwiseAND(F.expr("shiftleft(1, cast(group_id % 8 as int))")) == 0).select("source", F.lit(1).alias("alone"))
        less = lambda c: F.coalesce(c.cast("long"), F.lit(0))
        return own.join(self.sums, "group_id").join(alone, "source", "left").select(
            "source", (F.col("direct") - less(key_depth(key) == 1)).alias("direct_callers"), (F.col("callers") - less(key.isNotNull())).alias("all_affected"),
            (F.col("files") - less(F.col("alone"))).alias("affected_files")).where("all_affected > 0")

    @cached_property
    def rows(self) -> DataFrame:
        """(source, caller, key); it lies by caller."""
        return self.groups.join(F.broadcast(self.parts[2]), "group_id").where("caller <> source").select("source", "caller", "key")

    def depths(self) -> DataFrame:
        """source, caller and depth."""
        return self.caller_groups.join(F.broadcast(self.parts[2]), "group_id").where("caller <> source").select("source", "caller", "depth")

    def places(self) -> DataFrame:
        """source, caller, depth, file and line."""
        key = F.col("key")
        return self.rows.select("source", "caller", key_depth(key).alias("depth"), key_file(key).alias("file_no"), key_line(key).alias("line")).join(
            self.files, "file_no", "left").select("source", "caller", "depth", "file", "line")


def impact(sites: DataFrame, sources: DataFrame, stage, max_depth: int = MAX_DEPTH) -> DataFrame:
    """source, caller, depth, file and line of every caller reached from each name in ``sources`` (see ``Impact``)."""
    return Impact(sites, sources, stage, max_depth).places()


def affected_files(reached: DataFrame) -> DataFrame:
    """file and is_test, distinct, of the callers reached."""
    return reached.select("file", is_test_file(F.col("file")).alias("is_test")).distinct()
