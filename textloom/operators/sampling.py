"""Allocation and sampling: largest remainder, strata, quotas, donors, shards and batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import written


def proportional_allocation(cells: DataFrame, total: int, ties: list[str]) -> DataFrame:
    """Adds alloc to cells (.., n): floor(total * n / sum) but at least 1, then +1 by descending remainder until the total.

    A cell raised to 1 has a negative remainder. If the floors of 1 exceed the total, cells give back one each in ascending order of
    remainder, again and again, never below 1. alloc is at most n. All over the (few) cells.
    """
    everything = Window.partitionBy(F.lit(0))
    quota = cells.withColumn("quota", F.lit(float(total)) * F.col("n") / F.sum("n").over(everything))
    base = quota.withColumn("alloc", F.greatest(F.floor("quota"), F.lit(1).cast("long"))).withColumn("rest", F.col("quota") - F.col("alloc"))
    up, down = everything.orderBy(F.desc("rest"), *ties), everything.orderBy(F.asc("rest"), *[F.desc(t) for t in ties])
    short = F.lit(total).cast("long") - F.sum("alloc").over(everything)
    cell_count = F.count("*").over(everything)
    state = base.withColumn("short", short).withColumn("up", F.row_number().over(up)).withColumn("cells", cell_count)
    # Excess is taken in rounds over the cells that still have more than one: a round r takes from those with alloc > r.
    grown = state.withColumn("alloc", F.when(F.col("short") > 0, F.col("alloc") + F.floor((F.col("short") - F.col("up") + F.col("cells")) / F.col("cells"))).otherwise(F.col("alloc")))
    spare = grown.withColumn("turn", F.explode_outer(F.when((F.col("short") < 0) & (F.col("alloc") > 1), F.sequence(F.lit(1).cast("long"), F.col("alloc") - 1))))
    spare = spare.withColumn("place", F.row_number().over(everything.orderBy(F.col("turn").asc_nulls_last(), F.asc("rest"), *[F.desc(t) for t in ties])))
    taken = F.count_if(F.col("turn").isNotNull() & (F.col("place") <= -F.col("short")))
    keys = [c for c in cells.columns if c != "n"]
    return spare.groupBy(*keys, "n", "alloc").agg(taken.alias("taken")).select(*keys, "n", F.least(F.col("alloc") - F.col("taken"), F.col("n")).cast("long").alias("alloc"))


def pilot_allocation(cells: DataFrame, total: int, key: str) -> DataFrame:
    """Largest remainder (ties by key), at least 1 each; while over the total the largest cell (then greatest key) loses one.

    Taking from the largest again and again is the same as removing the tops of the cells in order of height: unit u of a cell is
    removed before unit v of another if u > v.
    """
    everything = Window.partitionBy(F.lit(0))
    quota = cells.withColumn("quota", F.lit(float(total)) * F.col("n") / F.sum("n").over(everything)).withColumn("low", F.floor("quota"))
    left = F.lit(total).cast("long") - F.sum("low").over(everything)
    ranked = quota.withColumn("left", left).withColumn("r", F.row_number().over(everything.orderBy(F.desc(F.col("quota") - F.col("low")), key)))
    first = ranked.withColumn("alloc", F.greatest(F.col("low") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0), F.lit(1).cast("long")))
    over = first.withColumn("over", F.sum("alloc").over(everything) - total)
    units = over.withColumn("unit", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alloc")))).withColumn("place", F.row_number().over(everything.orderBy(F.desc("unit"), F.desc(key))))
    return units.groupBy(key, "n").agg(F.count_if(F.col("place") > F.greatest(F.col("over"), F.lit(0))).alias("alloc"))


def seeded_order(*columns: Column, seed: int = 42) -> Column:
    """A reproducible shuffle key that any SQL engine can compute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def stratified_sample(rows: DataFrame, allocation: DataFrame, strata: list[str], *key: str, seed: int = 42) -> DataFrame:
    """``alloc`` rows of each stratum, by seeded hash order of the key."""
    order = Window.partitionBy(*strata).orderBy(seeded_order(*[F.col(k) for k in key], seed=seed), *key)
    ranked = rows.withColumn("r", F.row_number().over(order))
    return ranked.join(F.broadcast(allocation.select(*strata, "alloc")), strata).filter("r <= alloc").drop("r", "alloc")  # few strata


def uniform_sample(rows: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(seeded_order(*[F.col(k) for k in key], seed=seed), *key).limit(n)


def quota_sample(rows: DataFrame, stratum: str, quotas: dict[str, int], *key: str, seed: int = 42) -> DataFrame:
    """Up to each stratum's quota; what some strata lack is filled from the left-over rows of the others in seeded order."""
    order = Window.partitionBy(stratum).orderBy(seeded_order(*[F.col(k) for k in key], seed=seed), *key)
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for q in quotas.items() for x in q]), F.col(stratum)), F.lit(0))
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("own", F.col("r") <= quota)
    first = ranked.filter("own").drop("r", "own")
    lacking = first.agg((F.lit(sum(quotas.values())) - F.count("*")).alias("lacking"))
    rest = ranked.filter("not own").drop("r", "own").withColumn("p", seeded_order(*[F.col(k) for k in key], seed=seed)).orderBy("p", *key).limit(sum(quotas.values()))
    fill = rest.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p", *key)))  # at most the quotas' sum
    return first.unionByName(fill.crossJoin(F.broadcast(lacking)).filter("place <= lacking").drop("place", "lacking", "p"))  # one row


def disjoint_strata(rows: DataFrame, masks: dict[str, Column], n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows of each named stratum in turn, without any key of an earlier stratum. One pass per stratum; few strata."""
    taken, out = None, None
    for k, (name, mask) in enumerate(masks.items()):
        left = rows.filter(mask) if taken is None else rows.filter(mask).join(taken, list(key), "left_anti")
        picked = uniform_sample(left, n, *key, seed=seed + k).withColumn("sample_stratum", F.lit(name))
        out = picked if out is None else out.unionByName(picked)
        taken = out.select(*key)
    return out


def donors(items: DataFrame, item: str, person: str, seed: int = 42) -> DataFrame:
    """(item, donor): the next item in seeded cyclic order that belongs to another person.

    Runs of one person in the order share the donor that follows the run; null if all belong to one person. The order is global,
    so this is for sampled item lists.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("p", item)
    rows = items.select(item, person).withColumn("p", seeded_order(F.col(item), seed=seed))
    marked = rows.withColumn("new", F.coalesce((F.lag(person).over(line) != F.col(person)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(line)).withColumn("k", F.row_number().over(line))
    heads = marked.filter("new = 1").select(F.col("run").alias("next_run"), F.col(item).alias("donor"), F.col(person).alias("donor_person"))
    runs = marked.agg(F.max("run").alias("runs"))
    first = heads.filter("next_run = 1").select(F.col("donor").alias("d1"), F.col("donor_person").alias("p1"))
    second = heads.filter("next_run = 2").select(F.col("donor").alias("d2"))
    out = marked.crossJoin(F.broadcast(runs)).join(heads, F.col("next_run") == F.col("run") + 1, "left").crossJoin(F.broadcast(first)).join(F.broadcast(second), F.lit(True), "left")  # one-row tables
    wrapped = F.when(F.col(person) != F.col("p1"), F.col("d1")).otherwise(F.col("d2"))
    return out.select(item, person, F.coalesce("donor", F.when(F.col("runs") > 1, wrapped)).alias("donor"))


def fixed_chunks(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds chunk = position div size in a total order, by per-partition counts (no single-task window over all rows).

    The numbered rows are written to the shared folder before they are counted: planned twice, adaptive execution may join other
    partitions for the counts (whose rows are narrower) than for the rows, and numbers would repeat or leave gaps.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    numbered = written(numbered, "numbered")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return numbered.join(F.broadcast(starts), "part").withColumn("chunk", F.floor((F.col("start") + F.col("local")) / size)).drop("part", "local", "start")


def balanced_shards(weights: DataFrame, shards: int) -> DataFrame:
    """(id, shard): by descending weight (then id) into the least loaded shard. Sequential by nature: one task, for id lists."""
    import heapq

    import pandas as pd

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["weight", "id"], ascending=[False, True], kind="stable")
        load = [(0, s) for s in range(shards)]
        placed = []
        for w in rows["weight"]:
            total, s = heapq.heappop(load)
            placed.append(s)
            heapq.heappush(load, (total + w, s))
        return rows.assign(shard=placed)[["id", "shard"]]

    kind = weights.schema["id"].dataType.simpleString()
    return weights.select("id", "weight", F.lit(0).alias("g")).groupBy("g").applyInPandas(assign, f"id {kind}, shard long")


def token_batches(lengths: list[int], max_tokens: int, max_rows: int) -> Iterator[list[int]]:
    """Positions in batches for padded model input: longest first, (size + 1) * longest <= max_tokens, at most max_rows."""
    batch: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if batch and ((len(batch) + 1) * lengths[batch[0]] > max_tokens or len(batch) >= max_rows):
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def dealt_batches(rows: DataFrame, max_tokens: int, max_rows: int) -> DataFrame:
    """(shard, id, batch): ``token_batches`` of each shard's rows (shard, id, n_tokens), ids breaking ties. A shard is what one worker
    reads, so its list of lengths fits a task."""
    import pandas as pd

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        batch = [0] * len(rows)
        for number, places in enumerate(token_batches(rows["n_tokens"].tolist(), max_tokens, max_rows)):
            for k in places:
                batch[k] = number
        return rows.assign(batch=batch)[["shard", "id", "batch"]]

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("shard", "id")}
    return rows.select("shard", "id", "n_tokens").groupBy("shard").applyInPandas(deal, f"shard {kinds['shard']}, id {kinds['id']}, batch long")
