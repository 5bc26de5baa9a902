"""The file queries over all files, those without a counterpart in the resolution joins included."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from gradewell.plans import dedup, ingest, resolve, sessions, splits  # noqa: F401  (register the queries repeated here)
from gradewell.plans.fixtures import VIEWS, Fixtures
from gradewell.plans.registry import CATALOG, Query

REPEATED = ["a09_pending_rows", "a11_dataset_inventory", "c04_exclude_current", "c08_content_overlaps", "c11_union_sources", "d01_content_duplicates",
            "d06_distinct_paths", "f15_candidate_rank", "s04_content_ids"]


class WholeFiles(Fixtures):
    @cached_property
    def files(self) -> DataFrame:
        return self.every_file


for name in REPEATED:
    query = CATALOG.queries[name]
    CATALOG.queries[f"{name}_all_files"] = Query(query.build, query.sql.replace(VIEWS["files"], VIEWS["every_file"]), WholeFiles)
