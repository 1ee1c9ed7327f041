"""What the training-data operators share: scratch tables, expressions, ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, ship

# The white space that separates words, U+0020 and U+0009 to U+000D, and what is none of it.
SPACE = r"[\x09-\x0D ]+"
NOT_SPACE = r"[^\x09-\x0D ]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables under spark.checkpoint.dir that cut a job's lineage.

    Every executor reads them from the shared folder, so a lost executor costs
    only its running tasks. On leaving the ``with`` block all tables but those
    made by :meth:`keep` are deleted; those go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/textloom-{uuid.uuid4().hex}"
        self._gone: list = []

    def _path(self, tag: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.deleteOnExit(path)
        return path, fs

    def _write(self, df: DataFrame, path) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path.toString())
        return self.spark.read.schema(df.schema).parquet(path.toString())

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and return it as read back; deleted at the end of the block."""
        path, fs = self._path(tag)
        self._gone.append((path, fs))
        return self._write(df, path)

    def keep(self, df: DataFrame, tag: str = "result") -> DataFrame:
        """As cut, but the table outlives the block."""
        path, _ = self._path(tag)
        return self._write(df, path)

    def drop(self, how_many: int = 0) -> None:
        """Delete all cut tables but the latest ``how_many``."""
        stay = len(self._gone) - how_many
        for path, fs in self._gone[:stay]:
            fs.delete(path, True)
        self._gone = self._gone[stay:]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where a lambda uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def flat(text: Column) -> Column:
    """text's words joined by one space; null: empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of text as an array; null or blank: empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


#: White space inside a line that isn't a single space: nothing else needs a replacement.
#: A class alone repeats without recursion, so a run may be as long as the text.
_UNEVEN = r"[\x09\x0B-\x0D ]{2,}+|[\x09\x0B-\x0D]"


def normalised_lines(text: Column, digits: bool = False) -> Column:
    """text's lines in lower case, words joined by one space, all digits as 0 if asked for; as many as text has."""
    plain = F.coalesce(text, F.lit(""))
    uneven = F.lit(False)
    for blanks in ("  ", "\t", "\x0b", "\f", "\r"):
        uneven = uneven | F.contains(plain, F.lit(blanks))  # a plain search, which spares most texts the pattern
    plain = F.when(uneven, F.regexp_replace(plain, _UNEVEN, " ")).otherwise(plain)
    plain = F.regexp_replace(plain, "[1-9]", "0") if digits else plain
    return F.transform(F.split(F.lower(plain), "\n"), lambda x: F.trim(x))


def salted_slots(scratch: Scratch, rows: DataFrame, group: str, order: list[str], salt: Column, slot: str) -> DataFrame:
    """rows with a gapless number from 0 within each group, in column slot.

    Rank and offset: rows are ranked within (group, salt), the counts of these
    cells are summed up per group, and a cell's sum is added to its ranks. A
    group of any size is so spread over as many tasks as there are salts; the
    sums run over one row a cell. salt must give long values.
    """
    cell = Window.partitionBy(group, "_salt").orderBy(*order)
    ranked = scratch.cut(rows.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(cell).cast("long") - 1), "ranked")
    before = Window.partitionBy("_group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = ranked.groupBy(F.col(group).alias("_group"), F.col("_salt").alias("_cell")).count()
    cells = cells.select("_group", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    joined = ranked.join(cells, ranked[group].eqNullSafe(cells["_group"]) & (ranked["_salt"] == cells["_cell"]))
    return joined.withColumn(slot, F.col("_rank") + F.col("_before")).drop("_salt", "_rank", "_group", "_cell", "_before")


#: Cells of one group in least_of_group().
CELLS = 256


def least_of_group(rows: DataFrame, group: list[str], value: Column, by: Column, name: str) -> DataFrame:
    """rows with the least value of their group, in column name; groups are compared null-safely, null values ignored.

    A group is dealt into CELLS cells by the hash of ``by``: the least of each
    cell is combined map-side, that of a group is taken over its cells, given
    back to them, and joined to the rows by cell. So the rows of a group of any
    size spread over as many tasks as there are cells, and no row is repeated.
    """
    dealt = rows.withColumn("_cell", F.pmod(F.xxhash64(by), F.lit(CELLS)).cast("int"))
    keys = [f"_g{k}" for k in range(len(group))]
    cells = dealt.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col("_cell").alias("_of")).agg(F.min(value).alias("_least"))
    least = cells.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_least").alias(name))
    given = cells.drop("_least").join(least, _all([cells[k].eqNullSafe(least[f"_{k}"]) for k in keys])).drop(*[f"_{k}" for k in keys])
    same = [dealt[g].eqNullSafe(given[k]) for g, k in zip(group, keys, strict=True)]
    return dealt.join(given, _all([*same, dealt["_cell"] == given["_of"]])).drop("_cell", "_of", *keys)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def running_sums(numbers: Column, block: int = 64) -> Column:
    """For each of an array of numbers the sum of those before it, as longs.

    Sums of blocks, and of blocks of blocks, so that each place adds up two
    slices shorter than a block instead of all that stands before it.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    over = lambda k, n: F.floor(k / n).cast("int")

    def blocks(x: Column) -> Column:
        return F.transform(upto(over(F.size(x) + (block - 1), block)), lambda b: total(F.slice(x, b * block + 1, F.lit(block))))

    def inside(x: Column, k: Column) -> Column:
        first = over(k, block) * block
        return total(F.slice(x, first + 1, k - first))

    def whole(x: Column) -> Column:
        return F.transform(upto(F.size(x)), lambda k: total(F.slice(x, F.lit(1), k)))

    def placed(x: Column, one: Column, two: Column) -> Column:
        return F.transform(upto(F.size(x)), lambda k: F.get(two, over(k, block * block)) + inside(one, over(k, block)) + inside(x, k))

    none = F.array().cast("array<bigint>")
    made = let(numbers, lambda x: let(blocks(x), lambda one: let(whole(blocks(one)), lambda two: placed(x, one, two))))
    return F.when(F.size(numbers) > 0, made).otherwise(none)
