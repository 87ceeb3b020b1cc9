"""Placement by a hierarchical weighted hash tree (operator 5), in DataFrame functions only.

A tree is nested dicts: region, rack and shard names down to the shards' weights. At every node each child draws
-ln(u)/weight, u in (0, 1) from a hash of the row's key and the child's path, and the least draw wins; a child is
chosen with a probability in proportion to its weight, and its draws depend on its own path alone. So when the weight
of a subtree changes, the draws of all others stay: rows move into or out of that subtree and nowhere else.

Law of the query: `key`. The shards are 0 to 7, two regions of two racks of two shards; one more shard comes as a
region of its own, so that the only weights that change are its own and the root's sum, and rows move only into it.

Cases: a null key is hashed as null, so such rows stay together; a null text has size 1 and the CRC of no bytes;
repeated rows get the same shard and different slots; an empty table gives an empty result; of further columns only
those asked for pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsift.llm.common import table, written

Tree = dict[str, "Tree | float"]

EIGHT: Tree = {f"region{r}": {f"rack{k}": {str(4 * r + 2 * k + s): 1.0 for s in range(2)} for k in range(2)} for r in range(2)}
NINE: Tree = EIGHT | {"region2": {"rack0": {"8": 1.0}}}
#: Groups of rows that are numbered together, for each input partition and shard.
PARTS = 8


def weight(tree: Tree | float) -> float:
    return tree if isinstance(tree, float | int) else sum(map(weight, tree.values()))


def draw(keys: list[Column], path: str, weighs: float) -> Column:
    """Least for a child with a probability in proportion to its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(path)), 11)
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weighs))


def descend(keys: list[Column], tree: Tree, path: str = "") -> Column:
    """Names from the region down to the shard, as an array, for the rows' keys."""
    children = [(name, sub) for name, sub in tree.items() if weight(sub) > 0]
    if not children:
        raise ValueError(f"no weight below {path or 'the root'}")
    rest = [F.array(F.lit(name)) if isinstance(sub, float | int) else F.concat(F.array(F.lit(name)), descend(keys, sub, f"{path}/{name}")) for name, sub in children]
    if len(children) == 1:
        return rest[0]
    draws = [draw(keys, f"{path}/{name}", weight(sub)) for name, sub in children]
    won = F.array_min(F.array(*(F.struct(d.alias("draw"), F.lit(k).alias("k")) for k, d in enumerate(draws)))).getField("k")
    out = F.when(won == 0, rest[0])
    for k, r in enumerate(rest[1:], 1):
        out = out.when(won == k, r)
    return out


def assign(df: DataFrame, keys: list[str], tree: Tree, into: str = "path") -> DataFrame:
    """df with the path of names that each row falls to."""
    return df.withColumn(into, descend([F.col(k) for k in keys], tree))


def number(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """df with slot: rows of each shard counted gapless from 0. Counts of small groups give each its first slot, so no task sees a whole shard."""
    spread = df.withColumns({"__task": F.spark_partition_id(), "__part": F.pmod(F.xxhash64(*order), F.lit(PARTS))})
    fixed = written(spread, "slots")
    group = [shard, "__task", "__part"]
    before = Window.partitionBy(shard).orderBy("__task", "__part").rowsBetween(Window.unboundedPreceding, -1)
    first = fixed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = fixed.withColumn("__at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return within.join(first, group).withColumn("slot", (F.col("__first") + F.col("__at") - 1).cast("bigint")).drop("__task", "__part", "__first", "__at")


def shard_rows(df: DataFrame, tree: Tree, grown: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, region, rack."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = df.select(F.col(key), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"))
    placed = assign(assign(sized, [key], tree), [key], grown, "grown")
    flat = placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), F.col("path")[2].cast("int").alias("shard"), F.col("grown")[2].cast("int").alias("grown_shard"), F.col("path")[0].alias("region"), F.col("path")[1].alias("rack"))
    return number(flat, "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def op5_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), EIGHT, NINE)


QUERIES = {"op5_hash_tree": op5_hash_tree}
SQL: dict[str, str] = {}
