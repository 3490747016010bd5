"""Keyed lookups as joins. No side is broadcast by hint; Spark decides from sizes, and AQE splits skewed keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(targets: DataFrame, mapping: DataFrame, sources: DataFrame, outer: bool = False) -> DataFrame:
    """target -> mapping -> source; with outer, targets without one keep a null struct `retrieved`."""
    how = "left" if outer else "inner"
    held = sources.select(F.col("id").alias("src"), F.struct(*sources.columns).alias("retrieved"))
    return targets.join(mapping.select(F.col("tgt").alias("id"), "src", "sim"), "id", how).join(held, "src", how)


def without_retrieval(targets: DataFrame, like: DataFrame) -> DataFrame:
    return targets.withColumn("retrieved", F.lit(None).cast(like.schema))


def point(ids: DataFrame, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """The value of the first table, else of the second."""
    a = first.select("id", F.col(value).alias("_a"))
    b = second.select("id", F.col(value).alias("_b"))
    return ids.join(a, "id", "left").join(b, "id", "left").select("id", F.coalesce("_a", "_b").alias(value))


def members_side_by_side(rows: DataFrame, members: list[str], value: str, same: str) -> DataFrame:
    """One row an id that all members have, a column a member; `same` must agree among them."""
    whole = rows.filter(F.col("member").isin(*members)).groupBy("id").agg(
        *(F.max(F.when(F.col("member") == m, F.col(value))).alias(m) for m in members),
        F.count_distinct("member").alias("_n"), F.min(same).alias(same), F.max(same).alias("_other"),
    )
    checked = F.assert_true(F.col(same).eqNullSafe(F.col("_other")), f"members disagree on {same}").isNull()
    return whole.filter((F.col("_n") == len(members)) & checked).drop("_n", "_other")


def enrich(rows: DataFrame, side: DataFrame, column: str, key: str = "id") -> DataFrame:
    extra = side.select(key, F.col(column).alias("_new"))
    old = F.col(column) if column in rows.columns else F.lit(None)
    return rows.join(extra, key, "left").withColumn(column, F.coalesce("_new", old)).drop("_new")


def siblings(rows: DataFrame, group: str, key: str = "id", part: int = 1024) -> DataFrame:
    """(tgt, src) pairs of a group without itself.

    The targets of a group are dealt into parts of some `part` rows, and the sources are copied once a part, so that a group of any
    size is spread; the copies are a part-th of the pairs. The number of partitions is given, as by their few bytes they would be merged into one.
    """
    spark = rows.sparkSession
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / part).alias("_n"))
    sized = rows.select(group, key).join(sizes, group)
    a = sized.select(group, F.col(key).alias("tgt"), F.pmod(F.xxhash64(key), F.col("_n")).alias("_part")).repartition(number, group, "_part")
    b = sized.select(group, F.col(key).alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_part")).repartition(number, group, "_part")
    return a.join(b, [group, "_part"]).filter("tgt <> src").drop("_part")


def stem_match(tests: DataFrame, sources: DataFrame, q: int = 3) -> DataFrame:
    """(test, source): the first source by name whose stem is part of the test's class name.

    A stem is looked up by the rarest of its grams of q letters (a shorter one by itself), and what shares that gram with a
    name is verified. A name makes a row a letter, for each width that stems need. An empty stem is part of no name.
    """
    stems = sources.filter("length(stem) > 0").select("stem", "source").groupBy("stem").agg(F.min("source").alias("source"))
    width = F.least(F.length("stem"), F.lit(q))
    grams = lambda text, width: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substr(text, i, width)))
    widths = [r.width for r in stems.select(width.alias("width")).distinct().collect()]  # q of them at most
    names = tests.filter("test is not null").select("test").distinct()
    cut = [names.filter(F.length("test") >= w).select("test", F.explode(grams(F.col("test"), F.lit(w))).alias("gram")) for w in widths]
    if not cut:
        return names.select("test", F.lit(None).cast("string").alias("source")).limit(0)
    spread = reduce(DataFrame.unionByName, cut)
    held = stems.select("stem", "source", F.explode(grams(F.col("stem"), width)).alias("gram"))
    often = spread.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = held.join(often, "gram").groupBy("stem").agg(F.min_by(F.struct("gram", "source"), F.struct("n", "gram")).alias("r"))
    index = rarest.select("stem", "r.gram", "r.source")
    return spread.join(index, "gram").filter(F.contains("test", F.col("stem"))).groupBy("test").agg(F.min("source").alias("source"))


def resolved_call(called: Column, declared: Column) -> Column:
    """The one name that is both called and declared; null if there are none or several."""
    both = F.array_intersect(called, declared)
    return F.when(F.size(both) == 1, F.element_at(both, 1))


def import_types(rows: DataFrame, types: DataFrame) -> DataFrame:
    """(id, type) of the known types that a source imports by name or by the wildcard of their package.

    An import that more than one in a thousand are (so there are fewer than a thousand such) is dealt by the id to as many parts as
    the shuffle has, and its types are copied to each of them. Imports are shuffled even where the types are broadcast, else the pairs
    of a file of one row group would be held by one task.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    imports = rows.select("id", F.explode("imports").alias("i")).filter("i is not null")
    package = F.concat(F.regexp_extract("type", r"^(.*)\.[^.]*$", 1), F.lit(".*"))
    known = types.select("type").distinct().select("type", F.explode(F.array_distinct(F.array(F.col("type"), package))).alias("i"))
    often = imports.groupBy("i").agg(F.count("*").alias("n"))
    hot = often.join(often.agg(F.sum("n").alias("_all"))).filter(F.col("n") * 1000 > F.col("_all")).select("i", F.lit(True).alias("hot"))
    marked = lambda side: side.join(F.broadcast(hot), "i", "left")
    a = marked(imports).select("id", "i", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(0).alias("_part")).repartition(parts, "i", "_part")
    b = marked(known).select("type", "i", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")).alias("_part"))
    return a.join(b, ["i", "_part"]).select("id", "type").distinct()


def _nodes(ranges: DataFrame) -> DataFrame:
    """A row for each aligned block of 2 ** level numbers that [lo, hi] is made of; two a level at most."""

    def at_level(k: Column) -> Column:
        first, end = -F.call_function("shiftright", -F.col("lo"), k), F.call_function("shiftright", F.col("hi") + 1, k)
        left = F.when((first < end) & (first.bitwiseAND(F.lit(1)) == 1), first)
        right = F.when((first < end) & (end.bitwiseAND(F.lit(1)) == 1), end - 1)
        return F.transform(F.filter(F.array(left, right), lambda x: x.isNotNull()), lambda x: F.struct(k.alias("level"), x.alias("node")))

    levels = F.sequence(F.lit(0), F.floor(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int") + 1)
    whole = ranges.filter("lo <= hi").withColumns({"lo": F.col("lo").cast("long"), "hi": F.col("hi").cast("long")})
    return whole.withColumn("_n", F.explode(F.flatten(F.transform(levels, at_level)))).select("*", "_n.level", "_n.node").drop("_n")


def _point_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points with the block around them at each level that some range uses; the levels are 64 at most."""
    used = sorted(r.level for r in nodes.select("level").distinct().collect())
    level = F.explode(F.array(*map(F.lit, used)).cast("array<int>"))
    return points.withColumn("level", level).withColumn("node", F.call_function("shiftright", F.col("at").cast("long"), F.col("level")))


def range_hits(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points inside [lo, hi] of the ranges of their key, both ends included.

    A range is cut into aligned blocks of powers of two, some 2 log2(length) of them whatever its place, and a point is in one block a
    level; so the join is on equality, there is no width to choose, and each pair is met once.
    """
    nodes = _nodes(ranges)
    return _point_nodes(points, nodes).join(nodes, ["key", "level", "node"]).drop("level", "node")


def ranges_hit(ranges: DataFrame, points: DataFrame, rid: str, hit: bool = True) -> DataFrame:
    """The ranges that hold a point of their key, or (hit=False) those that hold none; rid: a column that tells ranges apart.

    However many points a range holds, it comes out once. A range without a number at either end holds none.
    """
    nodes = _nodes(ranges.select("key", rid, "lo", "hi"))
    marks = _point_nodes(points.select("key", "at"), nodes).select("key", "level", "node").distinct()
    found = nodes.join(marks, ["key", "level", "node"], "left_semi").select(rid).distinct()
    return ranges.join(found, rid, "left_semi" if hit else "left_anti")


def signature_match(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(package, class, method, params, d): the descriptor of a signature.

    A method that is there once needs no look at its parameters, one with a single overload of that number of them none at
    their types; else all types must match, and the first descriptor by text is taken. wanted: package, class, method, params;
    found: package, class, method, types, d.
    """
    from granary.functions.text import parameter_matches

    name = ["package", "class", "method"]
    joined = wanted.join(found, name)
    same_arity = F.size("params") == F.size("types")
    fits = same_arity & F.forall(F.zip_with("params", "types", parameter_matches), lambda ok: F.coalesce(ok, F.lit(False)))
    per = joined.groupBy(*name, "params").agg(
        F.count("*").alias("n"), F.min("d").alias("only"), F.count_if(same_arity).alias("n_arity"), F.min(F.when(same_arity, F.col("d"))).alias("of_arity"), F.min(F.when(fits, F.col("d"))).alias("of_types"),
    )
    d = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_arity") == 1, F.col("of_arity")).otherwise(F.col("of_types"))
    return per.select(*name, "params", d.alias("d")).filter("d is not null")
