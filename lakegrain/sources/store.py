"""Tables on disk: one folder per partition with Parquet files and tags; append, commit, rollback, soft delete."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.parse import parse_condition, references

ACTIVE = "_active"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own in local mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="lakegrain-")
    return found.rstrip("/")


class Store:
    """A folder of partitions. The newest ``_state-N.json`` names the live files of each, so a commit is one small write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _versions(self) -> list[tuple[int, str]]:
        """Numbers and names of the complete states, oldest first."""
        if not self.fs.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path())]
        found = [(int(x[7:-5]), x) for x in names if x.startswith("_state-") and x.endswith(".json")]
        return sorted(found) or [(0, "_state.json")] * ("_state.json" in names)

    def state(self) -> dict:
        found = self._versions()
        if not found:
            return {}
        inp = self.fs.open(self._path(found[-1][1]))
        try:
            return json.loads(bytes(inp.readAllBytes()).decode())
        finally:
            inp.close()

    def _save(self, state: dict) -> None:
        """A state is written aside and renamed to the next number: a crash leaves the state before, never none."""
        found = self._versions()
        new, at = self._path(f"_new.{uuid.uuid4().hex}"), self._path(f"_state-{(found[-1][0] if found else 0) + 1:012d}.json")
        out = self.fs.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(new, at):
            raise RuntimeError(f"another writer changed {self.root}")
        for _, name in found[:-2]:
            self.fs.delete(self._path(name), False)

    def partitions(self) -> list[str]:
        return sorted(self.state())

    def write(self, df: DataFrame, partition: str, tags: dict | None = None, max_records: int = 0, index: str | None = None, sort: list[str] | None = None) -> None:
        """Replaces a partition. ``index`` is kept as metadata; its physical analogue is the order of rows (``sort``)."""
        st = self.state()
        st[partition] = {"files": [self._add(df, partition, max_records, sort)], "tags": tags or {}, "index": index, "staged": []}
        self._save(st)

    def _add(self, df: DataFrame, partition: str, max_records: int = 0, sort: list[str] | None = None) -> str:
        name = f"{partition}/{uuid.uuid4().hex}"
        df = df.sortWithinPartitions(*sort) if sort else df
        df.drop("_part", *[c for c in df.columns if c == "_rowid"]).write.option("maxRecordsPerFile", max_records).parquet(f"{self.root}/{name}")
        return name

    def append(self, df: DataFrame, partition: str) -> None:
        """Stages rows; readers see them after :meth:`commit`."""
        st = self.state()
        st.setdefault(partition, {"files": [], "tags": {}, "index": None, "staged": []})["staged"].append(self._add(df, partition))
        self._save(st)

    def append_once(self, df: DataFrame, partition: str, batch: int) -> None:
        """Appends and commits in one write of the state; a batch whose number is not above the last one's is known."""
        st = self.state()
        p = st.setdefault(partition, {"files": [], "tags": {}, "index": None, "staged": []})
        if batch > p["tags"].get("_batch", -1):
            p["files"].append(self._add(df, partition))
            p["tags"]["_batch"] = batch
            self._save(st)

    def commit(self, partition: str) -> None:
        st = self.state()
        st[partition]["files"] += st[partition].pop("staged")
        st[partition]["staged"] = []
        self._save(st)

    def rollback(self, partition: str) -> None:
        st = self.state()
        for f in st[partition]["staged"]:
            self.fs.delete(self._path(f), True)
        st[partition]["staged"] = []
        self._save(st)

    def drop(self, partition: str) -> None:
        st = self.state()
        st.pop(partition)
        self._save(st)
        self.fs.delete(self._path(partition), True)

    def read(self, pattern: str = "%", columns: set[str] | None = None, inactive: bool = False) -> DataFrame:
        """Live rows of the partitions that match; their names in ``_part``, their tags as columns.

        A partition that lacks one of ``columns`` is skipped.
        """
        import re

        from ..plans.lower import like_regex

        rx, frames = re.compile(like_regex(pattern), re.I), []
        for name, p in sorted(self.state().items()):
            if not rx.match(name) or not p["files"]:
                continue
            df = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in p["files"]])
            for k, v in p["tags"].items():
                if k.lower() not in {c.lower() for c in df.columns}:
                    df = df.withColumn(k, F.lit(v))
            have = {c.lower() for c in df.columns}
            if columns and not {c.lower() for c in columns} <= have:
                continue
            if ACTIVE in df.columns:
                df = df if inactive else df.filter(F.coalesce(F.col(ACTIVE), F.lit(True))).drop(ACTIVE)
            frames.append(df.withColumn("_part", F.lit(name)))
        if not frames:
            raise ValueError(f"no partition matches {pattern!r}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _rewrite(self, partition: str, change) -> None:
        st = self.state()
        p = st[partition]
        df = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in p["files"]])
        p["files"] = [self._add(change(df), partition)]
        self._save(st)

    def _flag(self, partition: str, condition: str, active: bool) -> None:
        def change(df):
            old = F.coalesce(F.col(ACTIVE), F.lit(True)) if ACTIVE in df.columns else F.lit(True)
            hit = _holds(df, condition)
            return df.withColumn(ACTIVE, F.when(hit, F.lit(active)).otherwise(old))

        self._rewrite(partition, change)

    def deactivate(self, partition: str, condition: str) -> None:
        self._flag(partition, condition, False)

    def reactivate(self, partition: str, condition: str) -> None:
        self._flag(partition, condition, True)

    def purge(self, partition: str) -> None:
        """Rewrites the partition without its inactive rows."""
        self._rewrite(partition, lambda df: df.filter(F.coalesce(F.col(ACTIVE), F.lit(True))).drop(ACTIVE) if ACTIVE in df.columns else df)

    def reorder(self, partition: str, keys: list[str]) -> None:
        """Rewrites rows in order, so that ranges of the keys are found by file statistics."""
        self._rewrite(partition, lambda df: df.repartitionByRange(*keys).sortWithinPartitions(*keys))

    def add_column(self, partition: str, expression: str, name: str) -> None:
        from ..plans.lower import Scope
        from ..plans.parse import parse_select

        self._rewrite(partition, lambda df: df.withColumn(name, Scope(df).value(parse_select(expression)[0].expr)))

    def tag(self, partition: str, **tags) -> None:
        st = self.state()
        st[partition]["tags"] |= tags
        self._save(st)


def _holds(df: DataFrame, condition: str) -> Column:
    """Whether the condition is true; false where it, or a column that it names, is null."""
    from ..plans.lower import Scope
    from ..plans.select import mask

    node, scope = parse_condition(condition), Scope(df)
    m = mask(scope, references(node))
    return F.coalesce(scope.condition(node) if m is None else m & scope.condition(node), F.lit(False))


def open_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet file below a folder, as one relation."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


def deactivated(df: DataFrame, condition: str) -> DataFrame:
    """The relation without the rows for which the condition holds; where it is neither true nor false, rows stay."""
    return df.filter(~_holds(df, condition))
