"""Readers of record sets; every reader is lazy and takes an explicit schema.

No reader infers a schema, reads a file on the driver or keeps a cache: missing tables are empty frames, and
broken lines go to a column instead of failing a job.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources import schemas, snapshots
from granary.storage import stored_table


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark uses for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; blank lines are skipped, broken ones are kept in _corrupt_record. A missing path is empty."""
    full = schemas.with_corrupt(schema)
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path) if exists(spark, path) else spark.createDataFrame([], full)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State that sinks.write_state() left, or JSON Lines of another program: empty if there is none; broken lines are left out."""
    version, folders = snapshots.current(spark, path)
    if not version and not exists(spark, path) or version and not folders:
        return spark.createDataFrame([], schema)
    found = [f"{path}/{x}" for x in folders] if version else path
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)


def read_settings(spark: SparkSession, path: str) -> dict:
    """A YAML file of settings, small by nature, as a dictionary; an empty or missing file gives none. Needs PyYAML."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("settings in YAML need the package PyYAML") from error
    if not exists(spark, path):
        return {}
    text = spark.read.text(path, wholetext=True).first()
    return (yaml.safe_load(text.value) if text else None) or {}


def read_archives(found: DataFrame) -> DataFrame:
    """(archive, name, content) of the files in tar archives of any compression; found: archive, content."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for entry in tar:
                        if entry.isfile():
                            yield pa.RecordBatch.from_pydict({"archive": [archive], "name": [entry.name], "content": [tar.extractfile(entry).read()]})

    return found.select("archive", "content").filter("content is not null").mapInArrow(unpack, "archive string, name string, content binary")


def running_totals(rows: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Adds the sum of `size` over the rows before each, in an order that tells rows apart.

    Rows are sorted by ranges: sums within a range, and before it those of whole ranges, of which there are as many as
    shuffle partitions. No task gets more than a range or a row a range.
    """
    ranged = stored_table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    upto = F.sum(size).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = ranged.groupBy("_range").agg(F.sum(size).alias("_sum")).select("_range", before.alias("_before"))
    return ranged.join(whole, "_range").withColumn(name, F.col("_before") + upto - F.col(size)).drop("_range", "_before")


def number_lines(lines: DataFrame, name: str = "line_no", start: int = 0) -> DataFrame:
    """Dense numbers in file order, without bringing rows together.

    lines comes from a file source with _metadata. They are stored once with their file, block and place in it, so that
    the numbers hold however files are cut; each block's rows are counted, and the blocks' running totals give the
    number of a block's first line.
    """
    tagged = stored_table(lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")))
    blocks = tagged.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = running_totals(blocks, ["_file", "_block"], "_n", "_base").select("_file", "_block", "_first", "_base")
    return tagged.join(offsets, ["_file", "_block"]).withColumn(name, F.col("_base") + F.col("_at") - F.col("_first") + start).select(*lines.columns, name)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file or folder."""
    return number_lines(spark.read.text(path)).select("line_no", "value")


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key wins: a map-side combined aggregate, not a window."""
    kept = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order))
    return rows.groupBy(key).agg(kept.alias("_row")).select(key, "_row.*")


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSON Lines with one row a key, the last line winning."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = number_lines(spark.read.text(path).filter(F.trim("value") != ""))
    parsed = lines.select("line_no", F.from_json("value", schema).alias("row")).filter("row is not null").select("line_no", "row.*")
    return last_per_key(parsed.filter(F.col(key).isNotNull()), key, "line_no").drop("line_no")


def nested(rows: DataFrame, column: str = "record", key: str = "id") -> DataFrame:
    """The key and the fields of a nested record."""
    return rows.select(key, f"{column}.*")


def read_files(spark: SparkSession, path: str, suffix: str, skipped: tuple[str, ...] = ("module-info.java", "package-info.java")) -> DataFrame:
    """(path, name, text) of the files below a folder with a suffix; names in `skipped` are left out if a suffix is given.

    Text is UTF-8, or ISO-8859-1 where that is not valid.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", f"*{suffix}") if suffix else reader).load(path)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if suffix:
        named = named.filter(~F.col("name").isin(*skipped))
    return named.select("path", "name", decoded(F.col("content")).alias("text"))


def decoded(content: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(line_no, left, right) of two numbered texts whose blank lines do not count; lengths must agree."""
    def dense(lines: DataFrame, name: str) -> DataFrame:
        # blocks of numbers, so that no task sees all lines: counts by block, then a rank within it
        solid = lines.filter(F.trim("value") != "").withColumn("block", F.floor(F.col("line_no") / 100_000))
        offsets = running_totals(solid.groupBy("block").count(), ["block"], "count", "before").select("block", "before")
        rank = F.row_number().over(Window.partitionBy("block").orderBy("line_no")) - 1
        return solid.withColumn("rank", rank).join(offsets, "block").select((F.col("before") + F.col("rank")).alias("line_no"), F.col("value").alias(name))

    both = dense(left, "left").join(dense(right, "right"), "line_no", "full")
    same = F.col("left").isNotNull() & F.col("right").isNotNull()
    return both.select("line_no", F.when(F.assert_true(same, "the texts differ in length").isNull(), F.col("left")).alias("left"), "right")


def read_paired(spark: SparkSession, assertions: str, methods: str) -> DataFrame:
    """The paired corpus: line i of one file belongs to line i of the other."""
    return zip_lines(read_lines(spark, assertions), read_lines(spark, methods)).select("line_no", F.col("left").alias("assertion"), F.col("right").alias("test_method"))


def split_methods(pairs: DataFrame, marker: str = '"<FocalMethod>"', hole: str = '"<AssertPlaceHolder>"') -> DataFrame:
    """The test with its assertion filled in and the focal method after the marker; rows without one go."""
    parts = F.split(F.col("test_method"), F.lit(_quoted(marker)), 2)
    filled = pairs.select("line_no", "assertion", F.replace(F.trim(parts[0]), F.lit(hole), F.col("assertion")).alias("test_case"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("focal_method"))
    return filled.filter("focal_method != ''")


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def read_record_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; id is the file's stem, project what stands before its first underscore."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return rows.select(stem.alias("id"), F.split_part(stem, F.lit("_"), F.lit(1)).alias("project"), "*")


def read_csv(spark: SparkSession, path: str, schema: str, null_value: str = "-") -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nullValue", null_value).csv(path)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(package, class, method, descriptor) rows of a coverage report in XML."""
    report = spark.read.format("xml").option("rowTag", "package").schema(schemas.COVERAGE).load(path)
    classes = report.select(F.col("_name").alias("package"), F.explode("class").alias("c"))
    return classes.select("package", F.col("c._name").alias("class"), F.explode("c.method").alias("m")).select("package", "class", F.col("m._name").alias("method"), F.col("m._desc").alias("descriptor"))


def retrieval_map(rows: DataFrame, top_k: int, key: str = "tgt", found: str = "found") -> DataFrame:
    """(tgt, rank, src, sim) of mappings id -> list of {id or key, sim}; both spellings of the id are taken."""
    cut = rows.select(F.col(key).alias("tgt"), F.posexplode(F.slice(found, 1, top_k)).alias("rank", "x"))
    return cut.select("tgt", (F.col("rank") + 1).alias("rank"), F.coalesce("x.id", "x.key").alias("src"), F.col("x.sim").alias("sim"))


def with_fallback(main: DataFrame, control: DataFrame, targets: DataFrame) -> DataFrame:
    """The main mapping, else the control's, else the target itself with similarity 1."""
    m = main.select("tgt", F.struct("src", "sim").alias("m"))
    c = control.select("tgt", F.struct("src", "sim").alias("c"))
    own = F.struct(F.col("tgt").alias("src"), F.lit(1.0).alias("sim"))
    return targets.select("tgt").join(m, "tgt", "left").join(c, "tgt", "left").select("tgt", F.coalesce("m", "c", own).alias("r")).select("tgt", "r.src", "r.sim")


def exploded_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """The non-empty items of comma lists."""
    return lines.select(F.explode(F.split(column, ",")).alias("item")).select(F.trim("item").alias("item")).filter("item != ''")


def exploded_map(rows: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row an entry of a map column, beside the other columns; rows with an empty or null map have none."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(column).alias(key, value))


REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def put(reader: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name.lower()] = reader
        return reader

    return put


def open_dataset(name: str, *args, **options) -> DataFrame | None:
    """A registered dataset by its name in any case; None if there is none."""
    reader = REGISTRY.get(name.lower())
    return reader(*args, **options) if reader else None


@register("triggering_tests")
def _triggering(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their running number as id."""
    lines = number_lines(spark.read.text(path).filter(F.trim("value") != ""))
    return lines.select(F.col("line_no").alias("id"), F.from_json("value", schemas.TRIGGERING).alias("row")).select("id", "row.*")


def read_paired_sources(spark: SparkSession, assertions: str, methods: str, marker: str = '"<FocalMethod>"', hole: str = '"<AssertPlaceHolder>"') -> DataFrame:
    """The paired corpus as sources of retrieval: numbers count all pairs, also those whose focal method has no name."""
    parts = F.split(F.col("test_method"), F.lit(_quoted(marker)), 2)
    rows = read_paired(spark, assertions, methods).select(
        F.col("line_no").alias("id"), "assertion", F.replace(parts[0], F.lit(hole), F.col("assertion")).alias("test_case"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("focal_method"),
    )
    name = F.regexp_extract("focal_method", r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1)
    return rows.withColumn("focal_method_name", name).filter("focal_method_name != ''")


def read_positional(spark: SparkSession, path: str, schema: str = "id string") -> DataFrame:
    """(tgt, src): the line number of each solid line and the id that it holds."""
    lines = number_lines(spark.read.text(path).filter(F.trim("value") != ""))
    return lines.select(F.col("line_no").alias("tgt"), F.from_json("value", schema)["id"].alias("src"))


def read_target_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(id, target, retrieved): of each line, by its running number, the row itself and the row with its retrieved test in its place."""
    rows = number_lines(spark.read.text(path).filter(F.trim("value") != "")).select(F.col("line_no").alias("id"), F.from_json("value", schema).alias("r"))
    other = F.col("r").withField("test_case", F.col("r.retrieved_test_case"))
    return rows.select("id", F.col("r").dropFields("retrieved_test_case").alias("target"), other.dropFields("retrieved_test_case").alias("retrieved"))


@register("paired")
def _paired(spark: SparkSession, assertions: str, methods: str) -> DataFrame:
    return split_methods(read_paired(spark, assertions, methods))


@register("record_files")
def _record_files(spark: SparkSession, path: str) -> DataFrame:
    return read_record_files(spark, path, schemas.RECORD_FILE)


@register("test_corpus")
def _test_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(bug_id, key, test) rows of maps from digest to test."""
    return exploded_map(read_jsonl(spark, path, schemas.TEST_CORPUS).select("bug_id", "uts"), "uts", "key", "test")


@register("embeddings")
def _embeddings(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.EMBEDDING)
