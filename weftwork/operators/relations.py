"""Joins, ordered picks and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.lineage import cut, shuffled


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], prefix: str = "asof_") -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its group that is not after it.

    Both sides are united and ordered once per group (one shuffle, no range join); at equal positions the
    right row comes first. Groups must be of moderate size, as of a user or a file.
    """
    none = [F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns]
    a = left.select(*by, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(_struct_type(right, take)).alias("_take"), *(F.col(c).alias(f"_l_{c}") for c in left.columns))
    b = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*take).alias("_take"), *none)
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_take", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*(F.col(f"_l_{c}").alias(c) for c in left.columns), *(F.col(f"_last.{c}").alias(f"{prefix}{c}") for c in take))


def _struct_type(df: DataFrame, columns: list[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def hot_share(total: int, most: int = 10_000) -> int:
    """Rows from which on a key of ``total`` rows is hot."""
    return max(1000, -(-total // most))


def join_split(rows: DataFrame, table: DataFrame, key: str, count_col: str, total: int | None = None, most: int = 10_000) -> DataFrame:
    """Inner join of rows with a table that has one row for each key and, in ``count_col``, the number of rows that have it.

    Keys of more than one row in ``most`` are fewer than ``most``, so they are broadcast and their rows
    stay where they are; all other keys are joined by a shuffle in which none has a large share. A null
    key joins nothing. ``total`` (the number of rows, or more) is counted if it isn't given.
    """
    if total is None:
        total = table.agg(F.sum(count_col)).first()[0] or 0
    hot = F.col(count_col) > hot_share(total, most)
    heavy = F.broadcast(table.where(hot))
    light = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(light.join(table.where(~hot), key))


#: Slices of a group of intervals, each met by the whole group in a task of its own, and partitions that the slices are dealt to, at least.
SLICES, SLICE_PARTS = 8, 48


def overlap_pairs(df: DataFrame, key: str, by: list[str], start: Column, end: Column, slices: int = SLICES) -> DataFrame:
    """(a, b): keys a < b of rows of one group whose closed intervals meet.

    Pairs are in proportion to the square of a group, and the rows are few bytes: joined as they are, they would be
    broadcast to the few tasks that read the file, or a few groups brought into few tasks. So each row is in one slice of its
    group as a, and in all as b, and slices are dealt to a number of partitions that is not made smaller by their size.
    """
    parts = max(SLICE_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_g{k}" for k in range(len(by))]
    p = df.select(F.col(key).alias("_k"), *(F.col(c).alias(g) for c, g in zip(by, names, strict=True)), start.alias("_0"), end.alias("_1"))
    a = p.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(slices)).cast("int")).withColumnsRenamed({"_k": "a", "_0": "a0", "_1": "a1"})
    b = p.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumnsRenamed({"_k": "b", "_0": "b0", "_1": "b1"})
    a, b = (x.repartition(parts, *names, "_s") for x in (a, b))
    return a.join(shuffled(b), [*names, "_s"]).where("a < b AND a0 <= b1 AND b0 <= a1").select("a", "b")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mark: str, truncated: bool = False) -> DataFrame:
    """(key, status) with status added, changed or removed; without an old snapshot nothing, and no removals of a truncated one."""
    o, n = old.select(key, F.col(mark).alias("_o"), F.lit(1).alias("_in_o")), new.select(key, F.col(mark).alias("_n"), F.lit(1).alias("_in_n"))
    status = F.when(F.col("_in_o").isNull(), "added").when(F.col("_in_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    out = o.join(n, key, "full_outer").select(key, status.alias("status")).where("status IS NOT NULL")
    return out.where("status <> 'removed'") if truncated else out


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def append_new(store: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to append: the first of each key that the store does not have."""
    return first_by(rows, keys, order).join(store.select(*keys).distinct(), keys, "left_anti")


def compare_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Sizes of the intersection, both differences and the symmetric difference of two columns as sets, and a verdict."""
    x = a.select(column).where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("a"))
    y = b.select(column).where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("b"))
    j = x.join(y, column, "full_outer")
    sizes = j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return sizes.select("both", "only_a", "only_b", (F.col("only_a") + F.col("only_b")).alias("symmetric"), F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "same").when(F.col("both") == 0, "disjoint").otherwise("overlap").alias("verdict"))


def _classes(items: DataFrame, id_col: str, item_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored members (id, rep) and sets (rep, xs, size): identical sets are one class, told by a digest and named by its smallest id."""
    rows = items.select(F.col(id_col).alias("id"), F.col(item_col).alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    sets = rows.groupBy("id").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    sets = cut(sets.select("id", "xs", F.sha2(F.to_json("xs"), 256).alias("sig")))
    found = cut(sets.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    total = found.agg(F.sum("size"), F.max("size")).first()
    members = sets.select("id", "sig")
    hot = (total[1] or 0) > hot_share(total[0] or 0)
    members = (join_split(members, found, "sig", "size", total[0]) if hot else members.join(found, "sig")).select("id", "rep")
    first = sets.join(found.select(F.col("rep").alias("id"), "size"), "id").select(F.col("id").alias("rep"), "xs", "size")
    return members, cut(first)


def jaccard_classes(items: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """(id, rep): identical sets are one class, named by its smallest id. Every id with an item is in one."""
    return _classes(items, id_col, item_col)[0]


def jaccard_links(items: DataFrame, id_col: str, item_col: str, least: float) -> DataFrame:
    """(id, rep, links): for every id its class and the number of other ids whose sets are ``least`` similar or more, its own class's too.

    Links between different sets are counted by class sizes, so copies are never expanded into pairs.
    """
    members, sets = _classes(items, id_col, item_col)
    pairs = cut(_pairs(sets, least))
    sizes = sets.select("rep", "size")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("near"))
    found = sizes.join(near, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(found, "rep").select("id", "rep", "links")


def jaccard_pairs(items: DataFrame, id_col: str, item_col: str, least: float) -> DataFrame:
    """(a, b, jaccard) of sets whose Jaccard similarity is ``least`` or more and below 1.

    Identical sets are one class, whose representative stands for it here; ``jaccard_classes`` tells the
    members, and ``jaccard_links`` counts every document's links.
    """
    return _pairs(_classes(items, id_col, item_col)[1], least)


def _pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, jaccard) of stored sets (rep, xs).

    Prefix filtering keeps the join exact and small: each set is ordered from its rarest item on, and two
    sets can only be similar enough if they share an item among the first ``n - ceil(least*n) + 1``; only the
    pair's first common item makes it, so a pair is made once. Classes of sizes, each ``1 / least`` times the one before, are in the
    join's key, so that an item of very many prefixes is dealt by the sizes of its sets: a set meets those of its own class and the next smaller one.
    """
    flat = sets.select("rep", F.explode("xs").alias("x"), F.size("xs").alias("n"))
    freq = flat.groupBy("x").agg(F.count("*").alias("f"))
    ranked = flat.join(freq, "x").groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "x"))).alias("xs"))
    kept = F.slice("xs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int"))
    prefix = cut(ranked.select("rep", "n", F.transform(kept, lambda s: s["x"]).alias("p")))
    placed = prefix.select("rep", "n", "p", F.explode("p").alias("x"))
    size = F.floor(F.log("n") / -F.log(F.lit(least)) + 1e-9).cast("int") if least < 1 else F.lit(0)
    b = placed.select(F.col("rep").alias("rb"), size.alias("size"), F.col("p").alias("pb"), "x", F.col("n").alias("nb"))
    a = placed.select(F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("p").alias("pa"), "x", F.explode(F.array_distinct(F.array(size, size - 1))).alias("size"))
    fits = ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("ra") < F.col("rb")))) & (F.col("nb") >= F.col("na") * least) & (F.array_intersect("pa", "pb")[0] == F.col("x"))
    pairs = a.join(b, ["x", "size"]).where(fits).select("ra", "rb")
    joined = pairs.join(sets.select(F.col("rep").alias("ra"), F.col("xs").alias("xa")), "ra").join(sets.select(F.col("rep").alias("rb"), F.col("xs").alias("xb")), "rb")
    j = F.size(F.array_intersect("xa", "xb")) / F.size(F.array_union("xa", "xb"))
    return joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), j.alias("jaccard")).where((F.col("jaccard") >= least) & (F.col("jaccard") < 1))
