"""A pipeline of blocks over the footage graph: one source, filters, joins, one output.

The steps are read first and executed at the end, when the columns are known that they need: each bound
node (``e`` event, ``p`` person, ``v`` vehicle, ``o`` object, ``pl`` plate, ``c`` clip, ``vid`` video, ``t``
topic, ``nxt`` next event) is asked from the graph with those columns only and stands in the plan as plain
columns with its name as prefix, so filters reach its scan. A filter on a node that an optional join has
bound applies after that join. Every block states what must be bound; that is checked before anything runs.
"""

from __future__ import annotations

import json
import shlex
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import format_clock, parse_seconds
from .catalog import Catalog
from .graph import FootageGraph


class PipelineError(ValueError):
    """A pipeline that cannot be assembled."""


SOURCES = {
    "events": ("e", "event"), "people": ("p", "person"), "vehicles": ("v", "vehicle"), "objects": ("o", "object"),
    "plates": ("pl", "plate"), "clips": ("c", "clip"), "videos": ("vid", "video"),
}

#: Filters and joins in catalog order, with their parameters and the nodes of which one must be bound.
FILTERS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "topic": (("query",), ("e",)),
    "event_type": (("event_type",), ("e",)),
    "video": (("video_id",), ("e", "p", "v", "o", "c", "vid", "pl")),
    "timeframe": (("start", "end"), ("e",)),
    "at_time": (("timestamp",), ("e",)),
    "role": (("role",), ("p",)),
    "potential_suspect": ((), ("p",)),
    "is_cop": ((), ("p",)),
    "clothes": (("clothes",), ("p",)),
    "person_id": (("person_id",), ("p",)),
    "vehicle_color": (("color",), ("v",)),
    "plate": (("text",), ("pl", "v")),
    "object_label": (("label",), ("o",)),
    "transcript": (("phrase",), ("c",)),
}
JOINS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "with_clip": ((), ("e",)),
    "with_people": ((), ("e",)),
    "with_vehicles": ((), ("e",)),
    "with_objects": ((), ("e",)),
    "with_topic": ((), ("e",)),
    "with_events": ((), ("p", "o", "v")),
    "involving_person": (("person_id",), ("e",)),
    "involving_object": (("label",), ("e",)),
    "continues": ((), ("e",)),
}
OUTPUTS: dict[str, tuple[str, ...]] = {
    "return_events": ("e",), "return_people": ("p",), "return_vehicles": ("v",), "return_plates": ("pl",), "return_objects": ("o",),
    "return_clips": ("c",), "return_videos": ("vid",), "count": (), "count_by_type": ("e",), "count_by_video": ("e",),
}
DEFAULT_OUTPUT = {
    "events": "return_events", "people": "return_people", "vehicles": "return_vehicles", "objects": "return_objects",
    "plates": "return_plates", "clips": "return_clips", "videos": "return_videos",
}
#: The recipes and their blocks.
RECIPES: dict[str, list[dict]] = {
    "all_dui": [{"block": "events"}, {"block": "topic", "query": "dui"}, {"block": "with_clip"}, {"block": "with_people"}, {"block": "with_topic"}, {"block": "return_events"}],
    "all_miranda": [{"block": "events"}, {"block": "topic", "query": "miranda"}, {"block": "with_clip"}, {"block": "with_people"}, {"block": "with_topic"}, {"block": "return_events"}],
    "all_arrests": [{"block": "events"}, {"block": "topic", "query": "arrest"}, {"block": "with_clip"}, {"block": "with_people"}, {"block": "return_events"}],
    "all_stops": [{"block": "events"}, {"block": "topic", "query": "traffic stop"}, {"block": "with_clip"}, {"block": "with_people"}, {"block": "return_events"}],
    "events_in_timeframe": [{"block": "events"}, {"block": "timeframe"}, {"block": "with_clip"}, {"block": "with_people"}, {"block": "return_events"}],
    "count_events": [{"block": "events"}, {"block": "count_by_type"}],
    "suspects": [{"block": "people"}, {"block": "potential_suspect"}, {"block": "with_events"}, {"block": "return_people"}],
    "person_timeline": [{"block": "people"}, {"block": "person_id"}, {"block": "with_events"}, {"block": "return_people"}],
    "objects": [{"block": "objects"}, {"block": "with_events"}, {"block": "return_objects"}],
    "list_videos": [{"block": "videos"}, {"block": "return_videos"}],
}


def catalog_of_blocks() -> list[dict]:
    """Every block with its kind, parameters and needs, and the recipes."""
    rows = [{"block": k, "kind": "source", "params": [], "needs": []} for k in SOURCES]
    rows += [{"block": k, "kind": kind, "params": list(p), "needs": list(n)} for kind, d in (("filter", FILTERS), ("join", JOINS)) for k, (p, n) in d.items()]
    rows += [{"block": k, "kind": "output", "params": [], "needs": list(n)} for k, n in OUTPUTS.items()]
    return rows + [{"block": k, "kind": "recipe", "params": [], "needs": []} for k in RECIPES]


def _kind(block: str) -> str | None:
    return next((k for k, d in (("source", SOURCES), ("filter", FILTERS), ("join", JOINS), ("output", OUTPUTS)) if block in d), None)


def _params(block: str) -> tuple[str, ...]:
    return (FILTERS.get(block) or JOINS.get(block) or ((), ()))[0]


def parse_pipeline(spec: Any) -> list[dict]:
    """Steps of a list, a dict with ``recipe``, ``block`` or ``blocks``, JSON text, a recipe's name or ``a | b k=v``."""
    if isinstance(spec, dict):
        if "recipe" in spec:
            return recipe_steps(spec["recipe"], **{k: v for k, v in spec.items() if k != "recipe"})
        if "blocks" in spec:
            return parse_pipeline(spec["blocks"])
        spec = [spec]
    if isinstance(spec, list | tuple):
        steps = []
        for s in spec:
            step = dict(s) if isinstance(s, dict) else _step_of(str(s))
            if "block" not in step:
                raise PipelineError(f"a step without a block: {s!r}")
            steps.append(step)
        if not steps:
            raise PipelineError("an empty pipeline")
        return steps
    text = str(spec or "").strip()
    if text[:1] in "[{" and text:
        try:
            return parse_pipeline(json.loads(text))
        except json.JSONDecodeError as e:
            raise PipelineError(f"not JSON: {e}") from e
    steps = []
    for part in (p.strip() for p in text.split("|")):
        if part:
            steps += _recipe_of(part) or [_step_of(part)]
    if not steps:
        raise PipelineError("an empty pipeline")
    return steps


def _words(token: str) -> list[str]:
    try:
        return shlex.split(token)
    except ValueError as e:
        raise PipelineError(f"{token!r}: {e}") from e


def _recipe_of(token: str) -> list[dict] | None:
    """The steps of a recipe in the short form, ``name key=value ...``."""
    name, *rest = _words(token)
    if name not in RECIPES or name in {**SOURCES, **OUTPUTS} and not rest:
        return None
    pairs = [w.partition("=") for w in rest]
    if bad := [k for k, eq, _ in pairs if not eq]:
        raise PipelineError(f"recipe {name} takes key=value only: {bad[0]!r}")
    return recipe_steps(name, **{k: v for k, _, v in pairs})


def _step_of(token: str) -> dict:
    """One token of the short form: a block, then ``key=value`` or a bare word for its first parameter."""
    name, *rest = _words(token)
    step, names = {"block": name}, _params(name)
    for word in rest:
        key, eq, value = word.partition("=")
        if eq:
            step[key] = value
        elif names and names[0] not in step:
            step[names[0]] = word
        else:
            raise PipelineError(f"{name} takes no further parameter: {word!r}")
    return step


def render(steps: list[dict]) -> str:
    """The steps in the short form; ``parse_pipeline`` gives them back."""
    return " | ".join(" ".join([s["block"], *(f"{k}={shlex.quote(str(v))}" for k, v in s.items() if k != "block")]) for s in steps)


def recipe_steps(name: str, **params: Any) -> list[dict]:
    """A recipe with parameters given to its blocks, or to a block put in before its output."""
    if name not in RECIPES:
        raise PipelineError(f"unknown recipe {name!r}")
    steps = [dict(s) for s in RECIPES[name]]
    for key, value in params.items():
        if value in (None, ""):
            continue
        own = next((s for s in steps if key in _params(s["block"])), None)
        if own is not None:
            own[key] = value
            continue
        bound = SOURCES[steps[0]["block"]][0]
        block = next((b for d in (FILTERS, JOINS) for b, (p, needs) in d.items() if key in p and bound in needs), None)
        if block is None:
            raise PipelineError(f"recipe {name!r} has no place for {key!r}")
        put = next((s for s in steps if s["block"] == block), None)
        if put is None:
            put = {"block": block}
            steps.insert(len(steps) - 1, put)
        put[key] = value
    return steps


def contains(column: Column, text: str) -> Column:
    """Whether a text contains another, regardless of case."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def one_of(s: Assembly, person_id: str) -> Column:
    """Whether a person is meant by a local id or the end of its id."""
    if not person_id:
        raise PipelineError("an empty id")
    return (s.col("p", "local_id") == person_id) | F.endswith(s.col("p", "id"), F.lit(person_id))


class Assembly:
    """A question as it is put together: what is bound, which columns are needed, and the steps to execute."""

    def __init__(self, graph: FootageGraph):
        self.graph = graph
        self.bound: list[str] = []
        self.needs: dict[str, dict[str, None]] = {}
        self.steps: list[Callable[[DataFrame | None], DataFrame]] = []

    def need(self, block: str, *any_of: str) -> str:
        found = next((b for b in any_of if b in self.bound), None)
        if any_of and found is None:
            raise PipelineError(f"{block} needs {' or '.join(any_of)} in scope")
        return found or ""

    def col(self, node: str, column: str) -> Column:
        """A column of a bound node, which is thereby needed."""
        self.needs.setdefault(node, {})[column] = None
        return F.col(f"{node}_{column}")

    def _named(self, node: str, label: str) -> DataFrame:
        columns = list(self.needs.get(node) or {"id": None})
        own = [c for c in columns if c != "edge_role"]
        df = self.graph.node(label, *(own or ["id"]))
        return df.select(*[F.col(c).alias(f"{node}_{c}") for c in df.columns])

    def source(self, node: str, label: str) -> None:
        self.bound.append(node)
        self.steps.append(lambda _: self._named(node, label))

    def where(self, condition: Column) -> None:
        self.steps.append(lambda df: df.where(condition))

    def attach(self, node: str, label: str, edge: str, kinds: tuple[str | None, str | None], near: str, far: str, at: str, how: str = "left", role: bool = False) -> None:
        """Joins the nodes ``node`` at the ``far`` end of an edge, at the bound node ``at`` of its ``near`` end."""
        key, other = self.col(at, "id"), self.col(node, "id")
        self.bound.append(node)

        def step(df: DataFrame) -> DataFrame:
            with_role = role and "edge_role" in self.needs[node]
            pairs = self.graph.edge(edge, *kinds, role=with_role)
            pairs = pairs.select(F.col(near).alias("_k"), F.col(far).alias("_n"), *([F.col("role").alias(f"{node}_edge_role")] if with_role else [])).distinct()
            right = pairs.join(self._named(node, label), F.col("_n") == other).drop("_n")
            return df.join(right, key == F.col("_k"), how).drop("_k")

        self.steps.append(step)

    def join(self, make: Callable[[], DataFrame], key: Column, on: str, how: str = "left") -> None:
        """Joins a table of its own, made when the question is executed, by its column ``on``."""
        self.steps.append(lambda df: df.join(make(), key == F.col(on), how).drop(on))

    def then(self, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps.append(step)

    def run(self) -> DataFrame:
        df = None
        for step in self.steps:
            df = step(df)
        return df

    def with_clip(self) -> None:
        self.attach("c", "clip", "contains", ("clip", "event"), "dst_id", "src_id", "e")

    def with_people(self, how: str = "left") -> None:
        self.attach("p", "person", "involves", ("event", "person"), "src_id", "dst_id", "e", how, role=True)

    def with_topics(self) -> None:
        """Both hops are one optional pattern: the inner join of the two edges comes first."""
        key, g = self.col("e", "id"), self.graph
        self.bound.append("t")

        def hops() -> DataFrame:
            of_type = g.edge("instance_of", role=False).select(F.col("src_id").alias("_k"), F.col("dst_id").alias("_t"))
            topics = g.edge("in_topic", role=False).select(F.col("src_id").alias("_t"), F.col("dst_id").alias("t_id"))
            return of_type.join(topics, "_t").join(g.node("topic", "id").select(F.col("id").alias("t_id")), "t_id").select("_k", "t_id").distinct()

        self.join(hops, key, "_k")

    def clock(self, node: str, which: str) -> Column:
        """A clock of a node: its own text, else its milliseconds."""
        ms = self.col(node, f"{which}_ms")
        return F.coalesce(self.col(node, f"{which}_timestamp"), F.when(ms.isNotNull(), format_clock(ms)))

    def clocks(self, node: str) -> list[Column]:
        return [self.clock(node, w).alias(f"{w}_timestamp") for w in ("start", "end")]

    def named(self, node: str, **columns: str) -> list[Column]:
        return [self.col(node, c).alias(name) for name, c in columns.items()]

    def plain(self, node: str, *columns: str) -> list[Column]:
        return [self.col(node, c).alias(c) for c in columns]

    def people(self) -> Column:
        """People as events list them, with their role on the event."""
        parts = self.named("p", id="local_id", role="edge_role", clothes="clothes", potential_suspect="potential_suspect")
        return F.collect_set(F.struct(*parts)).alias("people")

    def event_list(self) -> Column:
        return F.collect_set(F.struct(*self.named("e", type="type"), self.clock("e", "start").alias("start_timestamp"), *self.plain("e", "video_id"))).alias("events")

    def event_columns(self) -> list[Column]:
        return [*self.named("e", event_id="id", video_id="video_id", source_name="source_name", event_type="type"), *self.clocks("e"), *self.plain("e", "seek_s", "summary")]

    def clip_columns(self) -> list[Column]:
        return [*self.named("c", clip="local_id"), *self.plain("c", "clip_uri", "splice_uri", "tagged_splice_uri")]


def _missing(step: dict, *names: str) -> list[str]:
    out = []
    for n in names:
        if step.get(n) in (None, ""):
            raise PipelineError(f"{step['block']} needs {n}")
        out.append(str(step[n]))
    return out


def seconds(value: str, name: str) -> float:
    """A clock in seconds, for filters on ``seek_s``."""
    out = parse_seconds(value)
    if out is None:
        raise PipelineError(f"{name} is no clock: {value!r}")
    return out


def _filter(s: Assembly, step: dict, catalog: Catalog) -> None:
    b = step["block"]
    node = s.need(b, *FILTERS[b][1])
    given = lambda *names: _missing(step, *names)
    if b == "topic":
        (q,) = given("query")
        types = catalog.resolve(q)["event_types"]
        if not types:
            raise PipelineError(f"no topic or definition matches {q!r}")
        s.where(s.col("e", "type").isin(types))
    elif b == "event_type":
        s.where(s.col("e", "type") == given("event_type")[0])
    elif b == "video":
        s.where(s.col(node, "id" if node == "vid" else "video_id") == given("video_id")[0])
    elif b == "timeframe":
        start, end = given("start", "end")
        s.where(s.col("e", "seek_s").between(seconds(start, "start"), seconds(end, "end")))
    elif b == "at_time":
        s.where(F.abs(s.col("e", "seek_s") - seconds(given("timestamp")[0], "timestamp")) <= 30)
    elif b == "role":
        s.where(s.col("p", "role") == given("role")[0])
    elif b in ("potential_suspect", "is_cop"):
        s.where(s.col("p", b))
    elif b == "clothes":
        s.where(contains(s.col("p", "clothes"), given("clothes")[0]))
    elif b == "person_id":
        s.where(one_of(s, given("person_id")[0]))
    elif b == "vehicle_color":
        s.where(contains(s.col("v", "color"), given("color")[0]))
    elif b == "plate":
        s.where(F.contains(s.col("pl", "text") if node == "pl" else s.col("v", "plate"), F.lit(given("text")[0].upper())))
    elif b == "object_label":
        s.where(contains(s.col("o", "label"), given("label")[0]))
    elif b == "transcript":
        s.where(contains(s.col("c", "transcript"), given("phrase")[0]))


def _join(s: Assembly, step: dict, joined: set[str]) -> None:
    b = step["block"]
    if b in joined:
        return
    node = s.need(b, *JOINS[b][1])
    joined.add(b)
    if b == "with_clip" and "c" not in s.bound:
        s.with_clip()
    elif b == "with_people" and "p" not in s.bound:
        s.with_people()
    elif b == "with_vehicles" and "v" not in s.bound:
        s.attach("v", "vehicle", "involves", ("event", "vehicle"), "src_id", "dst_id", "e")
    elif b == "with_objects" and "o" not in s.bound:
        s.attach("o", "object", "involves", ("event", "object"), "src_id", "dst_id", "e")
    elif b == "with_topic":
        s.with_topics()
    elif b == "with_events" and "e" not in s.bound:
        s.attach("e", "event", "involves", ("event", {"p": "person", "o": "object", "v": "vehicle"}[node]), "dst_id", "src_id", node)
    elif b == "involving_person":
        wanted = _missing(step, "person_id")[0]
        if "p" not in s.bound:
            s.with_people("inner")
        s.where(one_of(s, wanted))
    elif b == "involving_object":
        wanted = _missing(step, "label")[0]
        if "o" not in s.bound:
            s.attach("o", "object", "involves", ("event", "object"), "src_id", "dst_id", "e", "inner")
        s.where(contains(s.col("o", "label"), wanted))
    elif b == "continues":
        s.attach("nxt", "event", "continues", (None, None), "src_id", "dst_id", "e")


def _output(s: Assembly, b: str) -> None:
    s.need(b, *OUTPUTS[b])
    last = F.asc_nulls_last
    if b == "count":
        s.then(lambda df: df.agg(F.count("*").alias("n")))
    elif b == "count_by_type":
        keys = s.named("e", event_type="type")
        s.then(lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type"))
    elif b == "count_by_video":
        keys = s.named("e", video_id="video_id", source_name="source_name", event_type="type")
        s.then(lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy("video_id", F.desc("n"), "event_type", "source_name"))
    elif b == "return_events":
        keys = [*s.event_columns(), *(s.clip_columns() if "c" in s.bound else [])]
        sets = [s.people()] if "p" in s.bound else []
        if "v" in s.bound:
            sets.append(F.collect_set(F.struct(*s.plain("v", "id", "color", "plate"))).alias("vehicles"))
        if "o" in s.bound:
            sets.append(F.collect_set(F.struct(*s.named("o", id="local_id", label="label"))).alias("objects"))
        if "t" in s.bound:
            sets.append(F.array_sort(F.collect_set("t_id")).alias("topics"))
        if "nxt" in s.bound:
            sets.append(F.array_sort(F.collect_set(s.clock("nxt", "start"))).alias("continues_to"))
        s.then(lambda df: (df.groupBy(*keys).agg(*sets) if sets else df.select(*keys).distinct()).orderBy(last("video_id"), last("seek_s"), "event_id"))
    elif b == "return_people":
        keys = [
            *s.named("p", _id="id", person_id="local_id"), *s.plain("p", "video_id", "role", "is_cop", "potential_suspect", "clothes", "description"),
            *s.named("p", snapshot="suspect_snapshot", suspect_at="suspect_at", suspect_event="suspect_event"),
        ]
        sets = [s.event_list()] if "e" in s.bound else []
        s.then(lambda df: (df.groupBy(*keys).agg(*sets) if sets else df.select(*keys).distinct()).orderBy(last("video_id"), last("person_id")).drop("_id"))
    elif b == "return_vehicles":
        out = [*s.named("v", vehicle_id="id"), *s.plain("v", "video_id", "color", "plate", "analysis")]
        s.then(lambda df: df.select(*out).orderBy(last("video_id"), "vehicle_id"))
    elif b == "return_plates":
        if "v" not in s.bound:
            s.attach("v", "vehicle", "has_plate", ("vehicle", "plate"), "dst_id", "src_id", "pl")
        out = [*s.named("pl", plate="text"), *s.plain("pl", "confidence", "video_id"), *s.named("v", vehicle_color="color", vehicle_id="id")]
        s.then(lambda df: df.select(*out).orderBy(last("video_id"), "plate", "vehicle_id"))
    elif b == "return_objects":
        keys = [*s.named("o", _id="id", object_id="local_id"), *s.plain("o", "video_id", "label", "distinctive")]
        sets = [s.event_list()] if "e" in s.bound else []
        s.then(lambda df: (df.groupBy(*keys).agg(*sets) if sets else df.select(*keys)).orderBy(last("video_id"), "_id").drop("_id"))
    elif b == "return_clips":
        out = [*s.plain("c", "video_id"), *s.named("c", clip="local_id"), *s.clocks("c"), *s.plain("c", "summary", "clip_uri", "splice_uri", "tagged_splice_uri", "audio_uri"), *s.named("c", _i="index")]
        s.then(lambda df: df.select(*out).orderBy(last("video_id"), last("_i"), "clip").drop("_i"))
    else:
        out = [*s.named("vid", video_id="id"), *s.plain("vid", "source_name", "duration_s", "clip_count", "status")]
        people = count_of(s.graph, "has_person", "person", "people")
        s.then(lambda df: df.select(*out).join(people, "video_id", "left").fillna({"people": 0}).orderBy("video_id"))


def count_of(g: FootageGraph, edge: str, kind: str, name: str) -> DataFrame:
    """``video_id, name``: how many nodes of a kind each video has, counted before any join."""
    return g.edge(edge, "video", kind, role=False).groupBy(F.col("src_id").alias("video_id")).agg(F.countDistinct("dst_id").alias(name))


def assemble(graph: FootageGraph, spec: Any, catalog: Catalog | None = None) -> DataFrame:
    """The lazy result of a pipeline; ``.explain()`` on it previews the plan.

    Raises ``PipelineError`` for unknown blocks, no or a second source, a block whose nodes are not in
    scope, missing parameters and unknown recipes. The last output wins; without one the source's own
    output is taken. Repeated joins change nothing.
    """
    steps = parse_pipeline(spec)
    for step in steps:
        if _kind(step["block"]) is None:
            raise PipelineError(f"unknown block {step['block']!r}")
    s, source, output, joined = Assembly(graph), "", "", set()
    for step in steps:
        b = step["block"]
        kind = _kind(b)
        if kind == "source":
            if source:
                raise PipelineError(f"a second source: {b}")
            source = b
            s.source(*SOURCES[b])
        elif not source:
            raise PipelineError(f"{b} comes before any source")
        elif kind == "filter":
            _filter(s, step, catalog or Catalog())
        elif kind == "join":
            _join(s, step, joined)
        else:
            output = b
    _output(s, output or DEFAULT_OUTPUT[source])
    return s.run()
