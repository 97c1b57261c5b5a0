"""A front end that runs JSON expression graphs.

A graph is a dictionary of nodes; a node is a constant, an array, a dictionary, a reference
to another node, an argument reference, a function definition or a function invocation.
Equal subgraphs become one node (by the text of their arguments, from the leaves up, which
is a fixpoint in one pass), nodes are evaluated once in order, and every operator adds to a
lazy DataFrame, so Catalyst sees the whole graph.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

REGISTRY: dict[str, Callable] = {}


def register(name: str, f: Callable) -> None:
    REGISTRY[name] = f


class Graph:
    def __init__(self, text: str | dict):
        d = json.loads(text) if isinstance(text, str) else text
        self.nodes, self.root = d["values"], d["result"]
        self.level, self.window, self.batch = d.get("map", {}).get("level", 11), d.get("map", {}).get("spatialRange"), d.get("isBatch", False)

    def ordered(self) -> tuple[list[tuple[str, str, dict]], object]:
        """((name, function, arguments) in order of need, result); references are ("ref", name)."""
        out: list[tuple[str, str, dict]] = []
        known: dict[str, str] = {}
        done: dict[str, object] = {}
        active: set[str] = set()

        def named(key: str):
            if key in done:
                return done[key]
            if key in active:
                raise ValueError(f"node {key} depends on itself")
            if key not in self.nodes:
                raise KeyError(f"no node {key}")
            active.add(key)
            done[key] = value(self.nodes[key])
            active.discard(key)
            return done[key]

        def value(v: dict):
            if "constantValue" in v:
                return v["constantValue"]
            if "valueReference" in v:
                return named(v["valueReference"])
            if "arrayValue" in v:
                return [value(x) for x in v["arrayValue"]["values"]]
            if "dictionaryValue" in v:
                return {k: value(x) for k, x in v["dictionaryValue"]["values"].items()}
            if "argumentReference" in v:
                return ("arg", v["argumentReference"])
            if "functionDefinitionValue" in v:
                f = v["functionDefinitionValue"]
                return ("lambda", f["argumentNames"], self.nodes[f["body"]] if isinstance(f["body"], str) else f["body"])
            call = v["functionInvocationValue"]
            args = {k: value(x) for k, x in call.get("arguments", {}).items()}
            mark = json.dumps([call["functionName"], args], sort_keys=True, default=str)
            if mark not in known:
                known[mark] = f"n{len(out)}"
                out.append((known[mark], call["functionName"], args))
            return ("ref", known[mark])

        return out, named(self.root)


def run(text: str | dict, context: dict | None = None):
    """The graph's result: a DataFrame, a value, or a list of them. ``context`` gives arguments such as spark."""
    graph = Graph(text)
    calls, result = graph.ordered()
    held: dict[str, object] = {}
    outer = {"window": graph.window, "level": graph.level} | (context or {})

    def fill(v, bound: dict):
        if isinstance(v, tuple) and v and v[0] == "ref":
            return held[v[1]]
        if isinstance(v, tuple) and v and v[0] == "arg":
            return bound[v[1]]
        if isinstance(v, tuple) and v and v[0] == "lambda":
            _, names, body = v
            return lambda *a: _inline(graph, body, dict(zip(names, a)), outer)
        if isinstance(v, list):
            return [fill(x, bound) for x in v]
        if isinstance(v, dict):
            return {k: fill(x, bound) for k, x in v.items()}
        return v

    for name, function, args in calls:
        held[name] = call(function, fill(args, {}), outer)
    return fill(result, {})


def _inline(graph: Graph, body: dict, bound: dict, outer: dict):
    """A function body's value with its arguments bound."""
    if "argumentReference" in body:
        return bound[body["argumentReference"]]
    if "constantValue" in body:
        return body["constantValue"]
    if "valueReference" in body:
        return _inline(graph, graph.nodes[body["valueReference"]], bound, outer)
    if "arrayValue" in body:
        return [_inline(graph, x, bound, outer) for x in body["arrayValue"]["values"]]
    c = body["functionInvocationValue"]
    return call(c["functionName"], {k: _inline(graph, x, bound, outer) for k, x in c.get("arguments", {}).items()}, outer)


def call(function: str, args: dict, context: dict):
    if function not in REGISTRY:
        raise KeyError(f"no operator {function}")
    f, args = REGISTRY[function], {k.replace("-", "_"): v for k, v in args.items()}
    names = inspect.signature(f).parameters
    unknown = set(args) - set(names)
    if unknown and not any(p.kind is p.VAR_KEYWORD for p in names.values()):
        raise TypeError(f"{function} has no argument {sorted(unknown)[0]}")
    return f(**{k: context[k] for k in names if k in context and k not in args}, **args)


def _defaults() -> None:
    """Names that graphs know, then every public function of the operators under its own name."""
    from ..operators import collection, cube, features, focal, interpolation, raster, regression, spatial, statistics, terrain
    from ..sources import readers
    from . import names

    REGISTRY.update(names.NAMES)
    camel = lambda s: "".join(w if i == 0 else w.title() for i, w in enumerate(s.strip("_").split("_")))
    for n in ("min", "max", "mean", "product", "sample_sd", "sample_var", "total_sd", "total_var", "sum", "count", "count_distinct"):
        register(f"FeatureCollection.aggregate_{n}", lambda collection, property, n=n: features.aggregate(collection, property, n))
    for prefix, module in (("Coverage", raster), ("Coverage", focal), ("CoverageCollection", collection), ("Cube", cube), ("FeatureCollection", features), ("FeatureCollection", spatial), ("Kernel", focal), ("SpatialStats", statistics), ("SpatialInterpolation", interpolation), ("SpatialRegression", regression), ("Terrain", terrain), ("Service", readers)):
        for n, f in vars(module).items():
            if inspect.isfunction(f) and f.__module__ == module.__name__ and not n.startswith("_"):
                REGISTRY.setdefault(f"{prefix}.{camel(n)}", f)
    register("Service.print", lambda res, name="", valueType="": {"name": name, "value": res, "type": valueType})


_defaults()


def explain(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
