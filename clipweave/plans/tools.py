"""The question surface as one object: blocks, recipes, ready-made questions, corrections and guarded SQL."""

from __future__ import annotations

from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ..functions.clock import parse_seconds
from . import blocks, dml, fixed
from .catalog import Catalog
from .graph import FootageGraph

ROWS, MOST_ROWS, SQL_ROWS = 100, 200, 50
#: Logical plans that change something or are commands.
_CHANGING = ("Command", "Insert", "Delete", "Update", "Merge", "Create", "Drop", "Alter", "Replace", "Truncate", "Write", "Overwrite", "Append", "SetCatalog", "Load", "Cache", "Uncache", "Refresh", "Repair", "Analyze", "AddPartitions")


class Footage:
    """Questions about a footage graph. Results are lazy; ``rows`` collects a capped number of them."""

    def __init__(self, graph: FootageGraph, catalog: Catalog | None = None):
        self.graph, self.catalog = graph, catalog or Catalog()

    @staticmethod
    def rows(df: DataFrame, limit: int = ROWS) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.limit(max(1, min(limit, MOST_ROWS))).collect()]

    @staticmethod
    def json(df: DataFrame, limit: int = ROWS) -> list[str]:
        return df.limit(max(1, min(limit, MOST_ROWS))).toJSON().collect()

    def context(self) -> dict:
        """Labels, edges, blocks and recipes: what a caller needs to know first."""
        return {"labels": list(self.graph.nodes), "edges": list(self.graph.edges), "blocks": self.list_blocks(), "recipes": list(blocks.RECIPES)}

    def list_blocks(self) -> list[dict]:
        return blocks.catalog_of_blocks()

    def run_blocks(self, pipeline: Any) -> DataFrame:
        return blocks.assemble(self.graph, pipeline, self.catalog)

    def preview_blocks(self, pipeline: Any) -> dict:
        """The steps, their short form and the plan, without running it."""
        steps = blocks.parse_pipeline(pipeline)
        df = self.run_blocks(steps)
        return {"steps": steps, "pipeline": blocks.render(steps), "plan": df._jdf.queryExecution().toString()}

    def run_recipe(self, name: str, **params: Any) -> DataFrame:
        return self.run_blocks(blocks.recipe_steps(name, **params))

    def find_events(self, question: str, video_id: str = "") -> tuple[dict, DataFrame]:
        """What a question resolves to, and the events of those types."""
        resolved = self.catalog.resolve(question)
        if not resolved["event_types"]:
            raise blocks.PipelineError(f"no topic or definition matches {question!r}")
        return resolved, fixed.events_by_types(self.graph, resolved["event_types"], video_id)

    def _seconds(self, value: str, name: str) -> float:
        out = parse_seconds(value)
        if out is None:
            raise blocks.PipelineError(f"{name} is no clock: {value!r}")
        return out

    def events_in_timeframe(self, start: str, end: str, event_type: str = "", video_id: str = "") -> DataFrame:
        return fixed.events_in_timeframe(self.graph, self._seconds(start, "start"), self._seconds(end, "end"), event_type, video_id)

    def event_at_time(self, timestamp: str, event_type: str = "") -> DataFrame:
        return fixed.event_at_time(self.graph, self._seconds(timestamp, "timestamp"), event_type)

    def analyze_scene(self, video_id: str, timestamp: str) -> dict[str, DataFrame]:
        """The clips that cover a clock, the events around it and their participants."""
        at = self._seconds(timestamp, "timestamp")
        return {
            "clips": fixed.clip_at_timestamp(self.graph, timestamp, video_id),
            "events": fixed.events_in_timeframe(self.graph, at - 30, at + 30, "", video_id),
        }

    def media(self, video_id: str, clip: str) -> DataFrame:
        """Paths of a clip's media; showing them is up to the caller."""
        return fixed.clip_attachments(self.graph, video_id, clip)

    def __getattr__(self, name: str):
        question = getattr(fixed, name, None)
        if name.startswith("_") or not callable(question):
            raise AttributeError(name)
        return lambda *a, **k: question(self.graph, *a, **k)

    def correct(self, action: str, **args: Any) -> dml.Correction:
        """``update``, ``create``, ``link`` or ``merge``; a confirmed one becomes this object's graph."""
        make = {"update": dml.update, "create": dml.create, "link": dml.link, "merge": dml.merge}.get(action)
        if make is None:
            raise dml.CorrectionError(f"unknown action {action!r}")
        done = make(self.graph, **args)
        if done.graph is not None:
            self.graph = done.graph
        return done

    def sql(self, statement: str, args: dict | None = None, limit: int = SQL_ROWS) -> DataFrame:
        """One reading statement over the graph's tables (labels and ``edge_<name>``), at most ``limit`` rows.

        What the statement would do is read from its parsed plan, so words inside its texts don't matter.
        """
        spark = self.graph.spark
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement.rstrip().rstrip(";"))
        except PySparkException as e:
            raise blocks.PipelineError(f"not one statement: {str(e)[:200]}") from e
        names = [plan.getClass().getSimpleName()]
        stack = [plan]
        while stack:
            p = stack.pop()
            names.append(p.getClass().getSimpleName())
            children = p.children()
            stack += [children.apply(i) for i in range(children.size())]
        if bad := [n for n in names if any(c in n for c in _CHANGING)]:
            raise blocks.PipelineError(f"only reading statements: {bad[0]}")
        for label, df in self.graph.nodes.items():
            df.createOrReplaceTempView(label)
        for name, df in self.graph.edges.items():
            df.createOrReplaceTempView(f"edge_{name}")
        return spark.sql(statement.rstrip().rstrip(";"), args=args or {}).limit(max(1, min(limit, MOST_ROWS)))
