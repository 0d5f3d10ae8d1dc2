"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix target / size times, for its source's target and size in words.
Documents are put in order (source, then size, then id), expected copies are summed up from the first to each
document of its source, a random offset in [0, 1) is added, and a document is emitted once for each whole number
that the sum crosses there. So it comes floor or ceil of its expected copies, and, as neighbours in the order are
of like size, the words taken are near the target. Sums are exact: they are whole numbers scaled by the ratio.

Targets. Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all words, but
none gets more than ``most`` times its size: what is beyond goes to the others by weight, again and again. This is
the level at which sum(min(weight x level, most x size)) meets the total. It lies between two sources' most x size / weight; sums over the
sources narrow the place down 64-fold at a time until ``few`` such values are left, and those decide on the driver. Sources are numbered as documents are.

The order is made by a range shuffle of three narrow columns, so that one source's rows spread over as many tasks
as they need. A task numbers its own rows; a source's numbers continue from task to task by a table with one row
for each task and source it holds. Null texts have no words. Documents without words are emitted like any other.
Repeated rows are documents of their own, neighbours in the order. Where rows with equal id, source and text
are emitted, they share out their copies evenly, and are only told apart then.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomery.llm.storage import materialise, prepare_workers, quoted, shuffle_partitions, unused

SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than white-space characters; 0 for null."""
    pieces = F.size(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACES))
    text = F.coalesce(text.cast("string"), F.lit(""))
    edges = text.rlike(r"\A[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    # a text of white space alone splits into two empty pieces, and has two edges
    return F.when(text == "", 0).otherwise(pieces - edges).cast("long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the task's rows of its source, from 0."""
    from pyspark import TaskContext

    task, last, n = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        source = batch.column(0)
        if not len(batch):
            continue
        codes = source.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        place = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
        if source[0].as_py() == last:
            place[: begin[1] if len(begin) > 1 else len(codes)] += n
        last, n = source[len(batch) - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), task), pa.int32()), pa.array(place, pa.int64())], [*batch.schema.names, "task", "place"])


def _ranks(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of ``keys``, as the column ``name``: a range shuffle, and a table with a row for each task."""
    part, at = unused("part"), unused("at")
    spread = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    spread = materialise(spread.withColumn(part, F.shiftright(at, 33)), "ranked")
    counts = spread.groupBy(part).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(part, "of")
    before = F.coalesce(F.sum("n").over(W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("of", before.alias("before"))
    return spread.join(F.broadcast(counts), F.col(part) == F.col("of")).withColumn(name, F.col("before") + F.col(at).bitwiseAND((1 << 33) - 1)).drop(part, at, "of", "before")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float, few: int = 10_000) -> DataFrame:
    """(source, source_size, docs, target) for ``sizes`` (source, source_size, docs), a row for each source."""
    turn = (F.col("rank") % len(weights) + 1).cast("int")
    t = _ranks(sizes, [F.col("source").asc_nulls_last()], "rank")
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    t = materialise(t.withColumn("edge", F.col("bound") / F.col("weight")), "sources")
    level = _level(t, share, few)
    target = F.col("bound") if level is None else F.least("bound", F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", "docs", target.alias("target"))


def _level(sources: DataFrame, share: float, few: int) -> float | None:
    """The level if sources with an edge below it stay at their bounds and the others get weight x level; None if all stay at their bounds."""
    edges = sources.groupBy("edge").agg(F.sum("bound").alias("bound"), F.sum("weight").alias("weight"), F.min("bound").alias("one_bound"), F.min("weight").alias("one_weight"))
    edges = materialise(edges, "edges")
    all_ = sources.agg(F.sum("source_size").alias("size")).first()
    total, low, high = float(share) * float(all_.size or 0), -1.0, float("inf")
    while True:
        inside = edges.filter((F.col("edge") > low) & (F.col("edge") <= high))
        if inside.count() <= few:
            break
        cuts = sorted(set(inside.agg(F.percentile_approx("edge", [k / 64 for k in range(1, 64)], 10_000).alias("cuts")).first().cuts))
        sums = edges.agg(*(F.sum(F.when(F.col("edge") < x, F.col("bound")).otherwise(0.0)).alias(f"below{i}") for i, x in enumerate(cuts)), *(F.sum(F.when(F.col("edge") >= x, F.col("weight")).otherwise(0.0)).alias(f"above{i}") for i, x in enumerate(cuts))).first()
        fit = [(total - sums[f"below{i}"]) / sums[f"above{i}"] <= x for i, x in enumerate(cuts)]
        narrower = max([x for x, ok in zip(cuts, fit) if not ok], default=low), min([x for x, ok in zip(cuts, fit) if ok], default=high)
        if narrower == (low, high):
            break
        low, high = narrower
    outside = edges.agg(F.sum(F.when(F.col("edge") <= low, F.col("bound")).otherwise(0.0)).alias("below"), F.sum(F.when(F.col("edge") > low, F.col("weight")).otherwise(0.0)).alias("above")).first()
    below, above = outside.below or 0.0, outside.above or 0.0
    for r in inside.orderBy("edge").toLocalIterator():
        level = (total - below) / above
        if level * r.one_weight <= r.one_bound:
            return level
        below, above = below + r.bound, above - r.weight
    return None


def mix(documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, print, size, source_size, target, copies) of every row of ``documents`` (doc_id, text, source).

    print: a hash of the text; with doc_id and source it finds the row again.
    """
    spark = documents.sparkSession
    prepare_workers(spark)
    text = F.col("text").cast("string")
    sized = documents.select(F.col("source").cast("string"), word_count(text).alias("size"), F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"))
    sized = materialise(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    keys = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("print")]
    dealt = sized.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = materialise(dealt.mapInArrow(_number, "source string, size long, doc_id long, print long, task int, place long"), "placed")
    tasks = placed.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select(F.col("source").alias("source_of"), F.col("task").alias("task_of"), before.alias("before"))
    aims = targets(sizes, weights, share, most).withColumnRenamed("source", "source_is")
    # the ratio as a whole number of 2**-30, so that sums of it are exact
    ratio = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(1 << 30)))).otherwise(0).cast("decimal(20,0)")
    dice = F.conv(F.substring(F.md5(F.concat(F.coalesce("source_is", F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 7), 16, 10)
    offset = (dice.cast("long") * 4).cast("decimal(20,0)")
    table = tasks.join(aims, F.col("source_of").eqNullSafe(F.col("source_is"))).select("source_of", "task_of", "before", "source_size", "target", ratio.alias("ratio"), offset.alias("offset"))
    out = placed.join(table, F.col("source").eqNullSafe(F.col("source_of")) & (F.col("task") == F.col("task_of")))
    rank = (F.col("before") + F.col("place")).cast("decimal(18,0)")
    one = F.lit(1 << 30).cast("decimal(20,0)")
    crossed = lambda r: F.floor((r * F.col("ratio") + F.col("offset")) / one)
    return out.select("doc_id", "source", "print", "size", "source_size", "target", (crossed(rank + 1) - crossed(rank)).cast("long").alias("copies"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, with all columns, each as often as the mix takes it.

    Rows that no other row repeats need no numbers; the result is the same.
    """
    doc, source, mark, copies, times, part, turn, one = (unused(x) for x in ("doc", "source", "print", "copies", "rows", "part", "turn", "one"))
    taken = mix(documents, **options).groupBy(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("print").alias(mark))
    taken = materialise(taken.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(times)), "taken")
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (key == F.col(mark))
    out = documents.hint("merge").join(taken.filter(F.col(copies) > 0), same)
    if not taken.filter((F.col(times) > 1) & (F.col(copies) > 0)).isEmpty():
        # rows that repeat each other are numbered task by task, and on from task to task
        many = materialise(out.filter(F.col(times) > 1).withColumn(part, F.spark_partition_id()), "repeated")
        id_of, source_of, mark_of, part_of, n, before = (unused(x) for x in ("doc", "source", "print", "part", "n", "before"))
        counts = many.groupBy(F.col(doc).alias(id_of), F.col(source).alias(source_of), F.col(mark).alias(mark_of), F.col(part).alias(part_of)).agg(F.count(F.lit(1)).alias(n))
        earlier = W.partitionBy(id_of, source_of, mark_of).orderBy(part_of).rowsBetween(W.unboundedPreceding, -1)
        counts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
        equal = F.col(doc).eqNullSafe(F.col(id_of)) & F.col(source).eqNullSafe(F.col(source_of)) & (F.col(mark) == F.col(mark_of)) & (F.col(part) == F.col(part_of))
        place = F.row_number().over(W.partitionBy(doc, source, mark, part).orderBy(F.lit(1))) - 1
        many = many.join(counts, equal).withColumn(turn, F.col(before) + place)
        many = many.withColumn(copies, F.floor((F.col(copies) + F.col(times) - 1 - F.col(turn)) / F.col(times)))
        columns = [*(quoted(c) for c in documents.columns), copies]
        out = out.filter(F.col(times) == 1).select(columns).unionAll(many.select(columns))
    return out.select(*(quoted(c) for c in documents.columns), F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int"))).alias(one)).drop(one)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: what the mix takes of every document."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
