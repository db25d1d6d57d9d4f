"""Queries over the corpus tables and their SQL twins."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pollgauge.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
MODULES = ("warc", "toxicity", "pieces", "topk", "packing", "target_ratio", "language", "simhash", "chat", "weak_labels", "whitening", "variants", "word_pieces")
RUNS: dict[str, QueryFn] = {}
TWINS: dict[str, str] = {}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers, once for each application; Spark serves the file to all executors."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="pollgauge-code-")) / "pollgauge.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def corpus_query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship(configure(spark)), sf_dir)

        RUNS[name] = run
        if sql is not None:
            TWINS[name] = sql.strip()
        return fn

    return wrap


def load_corpus_queries() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for name in MODULES:
        import_module(f"pollgauge.llm.{name}")
    return dict(RUNS), dict(TWINS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
