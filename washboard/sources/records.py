"""CSV records from lines, with files split among tasks whatever is inside quotes.

Files are read as lines of bytes. Whether a line begins inside quotes depends on all lines before it, but only by one bit: a first pass finds
for each split of a file what it makes of either beginning, a running composition over a file's splits tells which one it has, and a second
pass puts lines together to records, each split by itself. A record that goes on into the next split travels as pieces, of which
a split has two at most. The bytes are decoded per file at the end, so files of both charsets are read alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from washboard.session import stage

# these functions travel to the executors as code, so they need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Splits that are broadcast at most; a row of 25 bytes each.
MOST_SPLITS = 2_000_000
RECORD, TAIL, HEAD = 0, 1, 2
BREAK = pa.scalar(b"\n", pa.large_binary())
#: Block number after the last split of a file.
AFTER_ALL = 1 << 62
LEAST_PARTITIONS = "spark.sql.files.minPartitionNum"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether quotes are open at the end of a line that begins inside quotes, or at the beginning of a record.

    A field is quoted if it begins with a quote; its end is a quote that no other one follows. What stands between that and the next comma
    belongs to the field, and quotes there or in unquoted fields mean nothing."""
    at = 0
    if not inside:
        inside = line[:1] == b'"'
        at = 1
        if not inside:
            at = line.find(b',"') + 2
            inside = at > 1
    while inside:
        quote = line.find(b'"', at)
        if quote < 0:
            return True
        if line[quote + 1 : quote + 2] == b'"':
            at = quote + 2
            continue
        comma = line.find(b",", quote + 1)
        if comma < 0:
            return False
        if line[comma + 1 : comma + 2] == b'"':
            at = comma + 2
            continue
        at = line.find(b',"', comma + 1) + 2
        inside = at > 1
    return False


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are of one split."""
    file, block = (np.asarray(batch.column(n)) for n in ("file", "block"))
    edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
        if b > a:
            yield batch.slice(a, b - a)


def split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: path, file, block, what it makes of either state (from_outside, from_inside), whether all is valid UTF-8.

    Lines (path, file, block, quoted: the line if it has quotes, valid)."""
    names, now = ["path", "file", "block", "from_outside", "from_inside", "valid"], None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, now))], schema=pa.schema(
            [("path", pa.string()), ("file", pa.int64()), ("block", pa.int64()), *[(n, pa.bool_()) for n in names[3:]]]))

    for batch in batches:
        for part in _segments(batch):
            key = [part.column("path")[0].as_py(), part.column("file")[0].as_py(), part.column("block")[0].as_py()]
            if now is None or now[:3] != key:
                if now:
                    yield row()
                now = [*key, False, True, True]
            for line in part.column("quoted").drop_null():
                text = line.as_py()
                same = now[3] == now[4]
                now[3] = ends_inside(text, now[3])
                now[4] = now[3] if same else ends_inside(text, now[4])
            now[5] = now[5] and pc.all(part.column("valid")).as_py()
    if now:
        yield row()


def _states(lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside quotes, and whether the last one ends there."""
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    before = np.empty(len(lines), dtype=bool)
    at = 0
    for i in quoted.tolist():
        before[at : i + 1] = inside
        inside, at = ends_inside(lines[i].as_py(), inside), i + 1
    before[at:] = inside
    return before, inside


class _Split:
    """The records of one split, put together from its lines batch by batch."""

    def __init__(self, first: pa.RecordBatch, quotes: bool) -> None:
        self.key = {n: first.column(n)[0].as_py() for n in ("path", "file", "block", "latin")}
        self.inside, self.quotes = first.column("inside")[0].as_py() and quotes, quotes
        self.open: list[pa.Array] = []
        self.kind = HEAD if self.inside else TAIL
        self.begins = self.key["block"] == 0
        self.count = 0

    def rows(self, texts: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(texts)
        first = np.zeros(n, dtype=bool)
        if self.begins and n and kind != HEAD:
            first[0], self.begins = True, False
        # the header takes no place
        seq = np.arange(self.count, self.count + n) - int(first.any())
        self.count += n - int(first.any())
        key = self.key
        columns = [pa.array([key[c]] * n, t) for c, t in (("path", pa.string()), ("file", pa.int64()), ("block", pa.int64()), ("latin", pa.bool_()))]
        columns += [pa.array(seq, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(first), texts.cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["path", "file", "block", "latin", "seq", "kind", "first", "text"])

    def joined(self) -> pa.Array:
        """The open record so far, as one text."""
        lines = pa.concat_arrays(self.open)
        self.open = []
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(lines)], pa.int64()), lines), BREAK)

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if not self.quotes:
            yield self.rows(lines, RECORD)
            return
        before, self.inside = _states(lines, self.inside)
        starts, n = np.flatnonzero(~before), len(lines)
        cut = int(starts[0]) if len(starts) else n
        if cut:
            self.open.append(lines.slice(0, cut))
        if self.open and (cut < n or not self.inside):
            yield self.rows(self.joined(), HEAD if self.kind == HEAD else RECORD)
            self.kind = TAIL
        if cut == n:
            return
        last = n
        if self.inside:
            last, starts = int(starts[-1]), starts[:-1]
            self.open.append(lines.slice(last))
        if len(starts) == last - cut:
            texts = lines.slice(cut, last - cut)
        else:
            ends = pa.array(np.append(starts, last), pa.int64())
            texts = pc.binary_join(pa.LargeListArray.from_arrays(ends, lines), BREAK)
        blank = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.equal(texts, pa.scalar(b"\r", texts.type)))
        yield self.rows(texts.filter(pc.invert(blank)), RECORD)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self.rows(self.joined(), self.kind)


def records_of_lines(quotes: bool):
    """Records and pieces of records from lines (path, file, block, inside, latin, line) in the order of their splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            for part in _segments(batch):
                if split is None or (split.key["file"], split.key["block"]) != (part.column("file")[0].as_py(), part.column("block")[0].as_py()):
                    if split:
                        yield from split.end()
                    split = _Split(part, quotes)
                yield from split.add(part.column("line").cast(pa.large_binary()))
        if split:
            yield from split.end()

    return run


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of bytes: path, file (a hash of it), block (start of the split), line. A line keeps the carriage return before its end.

    Where files are split depends on settings and on the number of cores there are when a job starts, so both are held fixed by a session
    of its own: all jobs over this table find the same splits, also while executors come and go."""
    to_df = RDD.toDF
    fixed = spark.newSession()
    RDD.toDF = to_df  # a new session takes it over
    given = fixed.conf.getAll
    for key, value in spark.conf.getAll.items():
        if given.get(key) != value:
            fixed.conf.set(key, value)
    if not fixed.conf.get(LEAST_PARTITIONS, None):
        cores = fixed.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        fixed.conf.set(LEAST_PARTITIONS, str(cores))
    lines = fixed.read.option("lineSep", "\n").text(paths)
    path = F.col("_metadata.file_path")
    return lines.select(path.alias("path"), F.xxhash64(path).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def file_splits(spark: SparkSession, paths, quotes: bool = True, lines: DataFrame | None = None) -> DataFrame:
    """Written table of splits: path, file, block, ``inside`` for one that begins inside quotes, ``latin`` if the file is not all valid
    UTF-8. It has one row per split that holds the start of a line. ``lines`` are those of ``paths``, where they are read again."""
    lines = read_lines(spark, paths) if lines is None else lines
    quoted = F.when(F.contains("line", F.lit('"')), F.col("line").cast("binary")) if quotes else F.lit(None).cast("binary")
    seen = lines.select("path", "file", "block", quoted.alias("quoted"), F.is_valid_utf8("line").alias("valid"))
    effects = seen.mapInArrow(split_effects, "path string, file bigint, block bigint, from_outside boolean, from_inside boolean, valid boolean")
    file = Window.partitionBy("file").orderBy("block")
    before, through = file.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(Window.unboundedPreceding, 0)
    # the state before a split is what the last one that leads to a single state leads to, changed by each one since that turns it round
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    effects = effects.withColumns({"turns": F.sum(turns).over(through), "turns_before": F.coalesce(F.sum(turns).over(before), F.lit(0))})
    settled = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").cast("int").alias("state"), "turns"))
    last = F.last(settled, ignorenulls=True).over(before)
    state = F.coalesce(last["state"], F.lit(0)) + F.col("turns_before") - F.coalesce(last["turns"], F.lit(0))
    latin = ~F.min("valid").over(Window.partitionBy("file"))
    return stage(effects.select("path", "file", "block", (state % 2 != 0).alias("inside"), latin.alias("latin")), "csv-splits", spark)


def read_records(lines: DataFrame, splits: DataFrame, quotes: bool = True) -> DataFrame:
    """Records without blank ones: path, block, seq (place in the split), first (of its file), text. ``splits`` are those of ``lines``.

    Rows of a split are in order. A record that more splits share comes after the last one of the split it begins in, under a block
    number of its own just below that of the next split."""
    if not quotes:
        lines = lines.filter(F.trim("line", F.lit(" \t\r")) != "")
    # the splits come first, so that the result belongs to the session of the caller
    known = splits.select("file", "block", "inside", "latin")
    if known.count() <= MOST_SPLITS:
        lines = F.broadcast(known).join(lines, ["file", "block"], "right")
    else:
        lines = known.join(lines.withColumn("place", F.monotonically_increasing_id()), ["file", "block"], "right")
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    other = F.raise_error(F.concat(F.lit("a split that the first pass has not seen: "), "path", F.lit(" at "), F.col("block").cast("string")))
    lines = lines.select("path", "file", "block", F.coalesce("inside", other.cast("boolean")).alias("inside"), "latin", F.col("line").cast("binary").alias("line"))
    schema = "path string, file bigint, block bigint, latin boolean, seq bigint, kind int, first boolean, text binary"
    rows = lines.mapInArrow(records_of_lines(quotes), schema)
    if quotes and splits.filter("inside").limit(1).count():
        # records and pieces are read apart, so lines are put together once
        rows = stage(rows, "csv-records")
        rows = rows.filter(F.col("kind") == RECORD).unionByName(_mended(rows.filter(F.col("kind") != RECORD), splits))
    text = F.when(F.col("latin"), F.decode("text", "ISO-8859-1")).otherwise(F.col("text").cast("string"))
    ended = F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return rows.select("path", "block", "seq", "first", ended.alias("text"))


def _mended(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Records put together from pieces, which belong to the last split before that has a beginning of one. There are two pieces per
    split at most."""
    in_order = Window.partitionBy("file").orderBy("block", F.desc("kind"))
    owner = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(in_order)
    owned = pieces.withColumn("owner", owner)
    whole = owned.groupBy("path", "file", "owner", "latin").agg(
        F.array_sort(F.collect_list(F.struct("block", F.col("kind") == HEAD, "text"))).alias("parts"), F.max("first").alias("first"))
    following = splits.select("file", F.col("block").alias("owner"), F.lead("block").over(Window.partitionBy("file").orderBy("block")).alias("next"))
    text = F.expr("cast(array_join(transform(parts, p -> cast(p.text as string)), '\n') as binary)")
    placed = whole.join(following, ["file", "owner"])
    block = F.coalesce(F.col("next") - 1, F.lit(AFTER_ALL))
    return placed.select("path", "file", block.alias("block"), "latin", F.lit(0).cast("bigint").alias("seq"), F.lit(RECORD).alias("kind"), "first", text.alias("text"))
