"""Top-k per group over stored partial counts, reading no further than the cut is in doubt.

``StoredCounts`` and a window would read every stored row of every part.  ``RankedCounts`` stores
a part's counts by depth: depth 0 has the items with more than half of the largest count of
their group in that part, depth 1 those with more than a quarter, and so on, each depth in a
folder of its own.  A small table of heads keeps the largest count of each (part, group, depth).

``top_k`` is a threshold algorithm over these lists, in readings that go two depths further each time:

1. It reads the upper depths of all parts and knows, from the heads, how much an item can still
   have in a part where it was not met.  Once the k-th largest total so far is greater than
   all that an item never met can have, a group's candidates are the items met that can reach it.
2. A candidate not met in some parts is looked up there, in the depths below; other parts are not opened.
3. If the k-th exact total of the candidates is greater than what any other item can reach, the
   group is proven.  Groups that are not (ties can make fewer distinct totals than the bounds
   promised) are counted from all their rows.

So the result is that of ``top_k_per_group`` over all rows, whatever the counts; skewed counts end
early, even ones read everything.

No list is sorted and no group is gathered in a task: the depth is an expression of a row's count and
its group's largest one, and every step is an aggregate or an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.counts import as_list, by_measure
from tallyframe.operators.joins import keep_keys, null_safe_join
from tallyframe.operators.topk import TIES, top_k_per_group
from tallyframe.sources.partials import PartTable
from tallyframe.sources.stage import StageFolder

FIRST = 2  # the first reading goes this deep: items with more than an eighth of the largest count
STEP = 2  # further depths of each later reading
OWN = ("n", "depth", "most", "rest", "total", "upper", "unseen", "least", "reached", "other", "ready", "sure")


class RankedCounts:
    """Counts of (group, item) under ``path``, one part after another; ``df`` of a delivery is all of its part."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        part: str,
        group: str | Sequence[str],
        item: str | Sequence[str],
        part_type: str = "int",
    ) -> None:
        self.spark, self.path, self.part, self.part_type = spark, path.rstrip("/"), part, part_type
        self.groups, self.items = as_list(group), as_list(item)
        taken = sorted({part, *self.groups, *self.items} & set(OWN))
        if taken:
            raise ValueError(f"rename the columns {taken}: the stored tables use these names")
        self.heads = PartTable(spark, f"{self.path}/heads", part, part_type)
        self.schema: T.StructType | None = None

    def _lists(self, df: DataFrame, *by: str) -> DataFrame:
        cell = [*by, *self.groups]
        counts = df.groupBy(*cell, *self.items).agg(F.count(F.lit(1)).alias("n"))
        most = counts.groupBy(*cell).agg(F.max("n").alias("most"))
        depth = F.floor(F.log2(F.col("most") / F.col("n"))).cast("int").alias("depth")
        # Rows of one depth go to as few files as their bytes ask for.
        return null_safe_join(counts, most, cell).select(*by, *self.groups, *self.items, "n", depth).hint("rebalance", *by, "depth")

    def _heads(self, lists: DataFrame, *by: str) -> DataFrame:
        return lists.groupBy(*by, *self.groups, "depth").agg(F.max("n").alias("most"))

    def deliver(self, df: DataFrame, value: object) -> None:
        """Replace one part by the counts of ``df``.  A delivery that broke off must be repeated before ``top_k``."""
        lists = self._lists(df)
        self._keep(lists.schema)
        folder = f"{self.path}/lists/{self.part}={value}"
        lists.write.partitionBy("depth").mode("overwrite").parquet(folder)
        self.heads.deliver(self._heads(self.spark.read.schema(lists.schema).parquet(folder)), value)

    def deliver_all(self, df: DataFrame) -> None:
        """Replace the whole table by the counts of ``df``, which has the part column, in one job a table."""
        lists = self._lists(df, self.part)
        self._keep(lists.drop(self.part).schema)
        lists.write.partitionBy(self.part, "depth").mode("overwrite").parquet(f"{self.path}/lists")
        heads = self._heads(self.read(), self.part).hint("rebalance", self.part)
        self.heads._keep(heads.drop(self.part).schema)
        heads.write.partitionBy(self.part).mode("overwrite").parquet(self.heads.path)

    def _keep(self, schema: T.StructType) -> None:
        if self.schema is not None and self.schema.simpleString() != schema.simpleString():
            raise ValueError(f"the delivery has {schema.simpleString()}, the table {self.schema.simpleString()}")
        self.schema = schema

    def read(self) -> DataFrame:
        """The stored rows; a filter on the part or the depth leaves the other folders unopened."""
        reader = self.spark.read.option("basePath", f"{self.path}/lists")
        if self.schema is not None:
            part = T.StructField(self.part, T._parse_datatype_string(self.part_type))
            reader = reader.schema(T.StructType([*self.schema.fields, part]))
        return reader.parquet(f"{self.path}/lists")

    def _met(self, rows: DataFrame, depth: int, heads: DataFrame) -> DataFrame:
        """(groups, items, total, upper, unseen) of the items in ``rows``, which go down to a depth: what
        was counted, what it can be at most, and what an item that was not met can be."""
        rest = heads.groupBy(self.part, *self.groups).agg(
            F.coalesce(F.max(F.when(F.col("depth") > depth, F.col("most"))), F.lit(0)).alias("rest")
        )
        unseen = rest.groupBy(*self.groups).agg(F.sum("rest").alias("unseen"))
        met = null_safe_join(rows, rest, [self.part, *self.groups]).groupBy(*self.groups, *self.items).agg(
            F.sum("n").alias("total"), F.sum("rest").alias("rest")
        )
        upper = (F.col("total") + F.col("unseen") - F.col("rest")).alias("upper")
        return null_safe_join(met, unseen, self.groups).select(*self.groups, *self.items, "total", upper, "unseen")

    def _cuts(self, items: DataFrame, k: int, ties: str) -> tuple[DataFrame, DataFrame]:
        """The first k items of each group, and (groups, least, reached): the least total among them and how many ranks there are."""
        top = top_k_per_group(items, self.groups, self.items, "total", k, ties, order=False)
        ranks = F.count_distinct("total") if ties == "dense" else F.count("total")
        return top, top.groupBy(*self.groups).agg(F.min("total").alias("least"), ranks.alias("reached"))

    def _looked_up(self, lists: DataFrame, upper: DataFrame, depth: int, heads: DataFrame, candidates: DataFrame) -> DataFrame:
        """(groups, items, n) of the candidates below a depth, from the parts where they were not met above it."""
        cell = [self.part, *self.groups]
        deeper = heads.filter(F.col("depth") > depth).select(*cell).distinct()
        open_ = candidates.filter("total < upper").select(*self.groups, *self.items)
        wanted = null_safe_join(null_safe_join(open_, deeper, self.groups), upper, [*cell, *self.items], "left_anti")
        parts = [r[0] for r in wanted.select(self.part).distinct().collect()]
        here = F.col(self.part).isin([p for p in parts if p is not None])
        if None in parts:
            here = here | F.col(self.part).isNull()
        rows = lists.filter((F.col("depth") > depth) & here)
        return keep_keys(rows, wanted, [*cell, *self.items]).select(*self.groups, *self.items, "n")

    def top_k(self, k: int, stage: StageFolder, name: str = "n", ties: str = "dense") -> DataFrame:
        """As ``top_k_per_group`` over the totals of all parts: (groups, items, name).

        A NULL group, item or part is one like any other.  The items of each reading are staged; the
        driver sees the depths (at most 64), the parts to look into, and two counts a reading.
        """
        if ties not in TIES or k < 1:
            raise ValueError(f"k must be at least 1, and ties one of {TIES}")
        lists, keys = self.read(), [*self.groups, *self.items]
        heads = stage.write(self.heads.read(), "heads")
        deepest = heads.agg(F.max("depth")).first()[0]
        if deepest is None:
            return lists.select(*keys, F.col("n").alias(name)).limit(0)
        depth, still, proven, doubtful = min(FIRST, deepest), None, [], []
        while True:
            upper = lists.filter(F.col("depth") <= depth)
            if still is not None:
                upper = keep_keys(upper, still, self.groups)
            met = stage.write(self._met(upper, depth, heads), f"met-{depth}")
            cuts = null_safe_join(met.select(*self.groups, "unseen").distinct(), self._cuts(met, k, ties)[1], self.groups)
            enough = F.col("reached") >= k
            ready = (F.col("unseen") == 0) | (enough & (F.col("least") > F.col("unseen")))
            least = F.when(enough, F.col("least")).otherwise(0).alias("least")
            cuts = stage.write(cuts.select(*self.groups, least, ready.alias("ready")), f"cuts-{depth}")
            items = null_safe_join(met, cuts.filter("ready"), self.groups)
            reaches = F.col("upper") >= F.col("least")
            candidates = stage.write(items.filter(reaches).select(*keys, "total", "upper", "unseen"), f"candidates-{depth}")
            if candidates.filter("total < upper").limit(1).count():
                exact = candidates.select(*keys, F.col("total").alias("n")).unionAll(
                    self._looked_up(lists, upper, depth, heads, candidates)
                )
                exact = stage.write(exact.groupBy(*keys).agg(F.sum("n").alias("total")), f"exact-{depth}")
                top, reached = self._cuts(exact, k, ties)
                other = F.max(F.when(~reaches, F.col("upper")).otherwise(0)).alias("other")
                others = items.groupBy(*self.groups).agg(other, F.max("unseen").alias("unseen"))
                sure = ((F.col("unseen") == 0) & (F.col("other") == 0)) | (
                    enough & (F.col("least") > F.greatest("other", "unseen"))
                )
                state = null_safe_join(others, reached, self.groups).select(*self.groups, sure.alias("sure"))
                state = stage.write(state, f"groups-{depth}")
                proven.append(keep_keys(top, state.filter("sure"), self.groups))
                doubtful.append(state.filter("NOT sure").select(*self.groups))
            else:  # the candidates' totals are those that the cut was made by
                proven.append(self._cuts(candidates.select(*keys, "total"), k, ties)[0])
            still = cuts.filter("NOT ready")
            if depth >= deepest or not still.count():
                break
            depth = min(depth + STEP, deepest)
        doubt = reduce(DataFrame.unionAll, doubtful) if doubtful else None
        if doubt is not None and doubt.count():
            totals = keep_keys(lists, doubt, self.groups).groupBy(*keys).agg(F.sum("n").alias("total"))
            proven.append(self._cuts(totals, k, ties)[0])
        out = reduce(DataFrame.unionAll, proven).withColumnRenamed("total", name)
        return out.orderBy(*[F.col(g).asc_nulls_first() for g in self.groups], *by_measure(name, self.items))
