"""Named datasets and queries, resolved into one lazy Spark plan.

A dataset (or query) is a function whose positional parameters are the names of the
datasets it reads; keyword-only parameters are the caller's options. ``Workspace``
resolves the names recursively and keeps one DataFrame per dataset, so a plan that
reads the same upstream twice shares it (Spark then reuses the exchange).
"""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.config import EngineConfig
from haulcast.schemas import BRONZE, OPTIONAL_TABLES, completed
from haulcast.session import size_shuffles

# Physical tables of the test schema that the Bronze adapters read.
SOURCE_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Node:
    name: str
    build: Callable
    inputs: tuple[str, ...]
    options: frozenset[str]
    comment: str


@dataclass(frozen=True)
class Status:
    """What became of a dataset: ``ready``, ``written``, ``placeholder`` (an empty optional table) or ``skipped``."""

    name: str
    state: str
    missing: tuple[str, ...] = ()


DATASETS: dict[str, Node] = {}
QUERIES: dict[str, Node] = {}


def _node(build: Callable) -> Node:
    params = inspect.signature(build).parameters.values()
    return Node(
        name=build.__name__,
        build=build,
        inputs=tuple(p.name for p in params if p.kind is p.POSITIONAL_OR_KEYWORD),
        options=frozenset(p.name for p in params if p.kind is p.KEYWORD_ONLY),
        comment=inspect.getdoc(build) or "",
    )


def dataset(build: Callable) -> Callable:
    """Register a table-like dataset; its docstring becomes the table comment."""
    DATASETS[build.__name__] = _node(build)
    return build


def query(build: Callable) -> Callable:
    """Register a parameterised query."""
    QUERIES[build.__name__] = _node(build)
    return build


def _load_definitions() -> None:
    import haulcast.operators  # noqa: F401
    import haulcast.plans  # noqa: F401
    import haulcast.sources  # noqa: F401


def _reads(name: str, targets: set[str]) -> bool:
    """Whether a dataset reads any of the targets, directly or through others."""
    node = DATASETS.get(name)
    return node is not None and any(i in targets or _reads(i, targets) for i in node.inputs)


class Workspace:
    """Resolves datasets and queries for one source and one configuration."""

    def __init__(
        self,
        spark: SparkSession,
        source_dir: str | None = None,
        config: EngineConfig | None = None,
        tables: Mapping[str, DataFrame] | None = None,
        published: Collection[str] | Mapping[str, Sequence[str]] = (),
    ):
        """``published`` names datasets that are written to the shared folder when first read; a mapping also gives the
        columns by whose ranges each is laid out, so that filters on them skip files and row groups.

        Tables passed in or found get the optional columns they lack (``schemas.OPTIONAL_COLUMNS``).
        """
        _load_definitions()
        self.spark = spark
        self.source_dir = source_dir
        self.config = config or EngineConfig()
        self._fixed = {n: completed(n, f) for n, f in (tables or {}).items()}  # passed in or written out
        self._derived: dict[str, DataFrame] = {}
        self._published = dict(published) if isinstance(published, Mapping) else dict.fromkeys(published, ())
        self._pending: list[str] = []
        self._written_out: set[str] = set()  # fixed by materialize, not passed in
        self._parent: Workspace | None = None  # resolves published datasets that a branch leaves as they are
        self._changed: set[str] = set()

    @classmethod
    def from_schema(
        cls, spark: SparkSession, schema: str, config: EngineConfig | None = None, reuse: Collection[str] = ()
    ) -> Workspace:
        """Read the Bronze tables that exist in ``schema`` and derive the rest from them.

        A derived table is read as it stands, however old, only where ``reuse`` names it.
        """
        _load_definitions()
        present = {t.name for t in spark.catalog.listTables(schema) if not t.isTemporary} & DATASETS.keys()
        if missing := set(reuse) - present:
            raise KeyError(f"{schema} has no table(s) {sorted(missing)}")
        inputs = sorted(n for n in present if n.startswith("bronze_") or n in reuse)
        return cls(spark, None, config, {n: spark.table(f"{schema}.{n}") for n in inputs})

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._fixed:
            return self._fixed[name]
        if name not in self._derived:
            if self._parent is not None and name in self._published and not self._reached(name):
                return self._parent[name]
            frame = self._resolve(name)
            self._derived[name] = self._written(name, frame) if name in self._published else frame
        return self._derived[name]

    def _written(self, name: str, frame: DataFrame) -> DataFrame:
        """The dataset as read back from the shared folder; unwritten on a cluster that names none."""
        from haulcast.sources import sinks

        return sinks.write_new(frame, self._folder, name, self._published[name]) if self._folder else frame

    def _reached(self, name: str) -> bool:
        """Whether what sets this branch apart from its parent bears on a dataset."""
        return name in self._changed or _reads(name, self._changed)

    def release(self) -> None:
        """Delete what this workspace and its branches published; their frames can't be read afterwards."""
        from haulcast.sources import sinks

        if self._folder:
            sinks.delete_path(self.spark, self._folder)
        self._derived.clear()

    @cached_property
    def _folder(self) -> str | None:
        from haulcast.sources import sinks

        shared = sinks.shared_folder(self.spark)
        return shared and f"{shared}/{uuid.uuid4().hex}"

    def _absent(self, name: str) -> bool:
        """Whether a source table that this workspace would read is not there: it was given other tables instead."""
        return self.source_dir is None and name not in self._fixed and (name in SOURCE_TABLES or name in BRONZE)

    def missing(self, name: str) -> set[str]:
        """The absent source tables that a dataset or query reads, directly or through others; empty if it can be built.

        Optional tables are not missing: an absent one stands as an empty table of its columns.
        """
        if name in QUERIES:
            return self._missing_inputs(QUERIES[name])
        return set() if name in self._fixed else self._missing_dataset(name)

    def _missing_inputs(self, node: Node) -> set[str]:
        today = "silver_erp_orders" if self.config.as_of is None and self.source_dir is None else "config"
        inputs = {today if i == "as_of" else i for i in node.inputs} - {"config"}
        of = (set() if i in self._fixed else self._missing_dataset(i) for i in inputs)
        return set().union(*of)

    def _missing_dataset(self, name: str) -> set[str]:
        """As ``missing``, where a query of the same name does not count."""
        if name in OPTIONAL_TABLES:
            return set()
        if self._absent(name) or (name not in DATASETS and name not in SOURCE_TABLES):
            return {name}
        return self._missing_inputs(DATASETS[name]) if name in DATASETS else set()

    def report(self, *names: str) -> list[Status]:
        """For each dataset or query (by default all), whether it can be built and which source tables it lacks."""
        return [
            Status(n, "skipped" if lacking else "placeholder" if self._placeholder(n) else "ready", tuple(sorted(lacking)))
            for n in (names or (*DATASETS, *QUERIES))
            for lacking in (self.missing(n),)
        ]

    def _placeholder(self, name: str) -> bool:
        if self.source_dir is not None or name in self._fixed or name not in OPTIONAL_TABLES:
            return False
        return any(i in SOURCE_TABLES and i not in self._fixed or self._reads_source(i) for i in DATASETS[name].inputs)

    def _reads_source(self, name: str) -> bool:
        """Whether a dataset needs a source table that is absent."""
        if name in self._fixed or name not in DATASETS:
            return False
        return any(i in SOURCE_TABLES and i not in self._fixed or self._reads_source(i) for i in DATASETS[name].inputs)

    def metric(
        self,
        view: str,
        measures: Sequence[str],
        by: Sequence[str] = (),
        where: Column | str | None = None,
        order_by: Sequence[Column | str] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """Measures of a metric view, by its name, at the grain of ``by``; ``where`` may name dimensions only."""
        from haulcast.operators.metric_view import VIEWS

        if view not in VIEWS:
            raise KeyError(f"no metric view named {view!r}; there are {sorted(VIEWS)}")
        return VIEWS[view].query(self[VIEWS[view].source], measures, by, where, order_by, limit)

    def refresh(self, *names: str, schema: str | None = None, path: str | None = None) -> list[Status]:
        """Build the datasets anew, each after those it reads, and write them as ``materialize`` does.

        A dataset whose source tables are absent is skipped and reported; the others are written all the same.
        """
        statuses = {s.name: s for s in self.report(*names)}
        order: list[str] = []

        def visit(name: str) -> None:
            if name in DATASETS and name not in order:
                for i in DATASETS[name].inputs:
                    visit(i)
                order.append(name)

        for name in names:
            visit(name)
        for name in order:
            if name in statuses and statuses[name].state != "skipped":
                self.materialize(name, schema=schema, path=path)
                statuses[name] = replace(statuses[name], state="written")
        return [statuses[n] for n in names]

    def _resolve(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES and self.source_dir is not None:
            table = self.spark.read.parquet(f"{self.source_dir}/{name}.parquet")
            size_shuffles(self.spark, table)
            return table
        if self._placeholder(name):
            return self.spark.createDataFrame([], OPTIONAL_TABLES[name])
        if name not in DATASETS:
            raise KeyError(f"no dataset named {name!r}")
        if name in self._pending:
            raise ValueError(f"dataset cycle: {' -> '.join([*self._pending, name])}")
        self._pending.append(name)
        try:
            return self._build(DATASETS[name], {})
        finally:
            self._pending.pop()

    def _build(self, node: Node, options: Mapping) -> DataFrame:
        unknown = set(options) - node.options
        if unknown:
            raise TypeError(f"{node.name} has no option(s) {sorted(unknown)}")
        return node.build(*(self._input(i) for i in node.inputs), **options)

    def _input(self, name: str):
        if name == "as_of":
            return self.as_of
        if name == "config":
            return self.config
        return self[name]

    @property
    def as_of(self) -> Column:
        """Today, as a literal, so that trailing-window filters reach the Parquet reader."""
        return F.lit(self.config.as_of or self._newest)

    @cached_property
    def _newest(self) -> date:
        """The newest order date of the source: one column scanned, one value returned."""
        if self.source_dir is not None or "newest_order_date" in self._fixed:
            return self["newest_order_date"].first()[0]
        return self["silver_erp_orders"].agg(F.max("order_date")).first()[0]

    def run(self, name: str, **options) -> DataFrame:
        """The lazy result of a registered query (or of a dataset, by its name)."""
        if name in QUERIES:
            return self._build(QUERIES[name], options)
        if options:
            raise TypeError(f"dataset {name!r} takes no options")
        return self[name]

    def with_tables(self, **tables: DataFrame) -> Workspace:
        """A workspace where the given datasets replace the derived ones, downstream included."""
        return self._branch(self.config, {**self._fixed, **tables}, set(tables))

    def with_config(self, **changes) -> Workspace:
        """The same source under a changed configuration."""
        return self._branch(replace(self.config, **changes), self._fixed, {"config", "as_of"})

    def _branch(self, config: EngineConfig, tables: Mapping, changed: set[str]) -> Workspace:
        """A workspace that keeps every dataset the change does not reach."""
        other = Workspace(self.spark, self.source_dir, config, tables, self._published)
        today = "newest_order_date" if self.source_dir is not None or "newest_order_date" in tables else "silver_erp_orders"
        moved = today in changed or _reads(today, changed)
        other._parent, other._changed = self, changed | ({"as_of"} if moved else set())
        other._written_out = self._written_out - changed
        other._derived = {n: f for n, f in self._derived.items() if not other._reached(n)}
        other._folder = self._folder
        if "_newest" in self.__dict__ and not moved:
            other._newest = self._newest
        return other

    def materialize(self, *names: str, schema: str | None = None, path: str | None = None) -> Workspace:
        """Write datasets as tables of ``schema`` or Parquet under ``path`` and read them from there on.

        Later datasets and queries of this workspace then start from the written table,
        which also cuts their lineage: a lost executor costs a re-read, not a recompute.
        A dataset written before is built from its inputs again. Without schema or path, each write goes to a new
        place. Under a path it becomes the next version of the dataset (``sinks.read_version`` reads the newest); frames
        of the version before stay valid. In a schema, frames read from a replaced table are void.
        """
        from haulcast.sources import sinks

        for name in names:
            if name in self._written_out:
                del self._fixed[name]
            frame = self[name]
            if schema is not None:
                comment = DATASETS[name].comment if name in DATASETS else ""
                written = sinks.overwrite_table(frame, f"{schema}.{name}", comment)
            else:
                if path is None and self._folder is None:
                    raise ValueError("give a schema or path, or set spark.checkpoint.dir to a folder all executors reach")
                written = sinks.write_version(frame, f"{path}/{name}") if path else sinks.write_new(frame, self._folder, name)
            self._fixed[name] = written
            self._written_out.add(name)
            self._changed = self._changed | {name}
            self._derived = {n: f for n, f in self._derived.items() if not self._reached(n)}
        return self
