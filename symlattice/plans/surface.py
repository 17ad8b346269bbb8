"""What SQL and callers by name can use: table functions over source files, and a registry of questions with checked arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..functions.shipping import ship
from ..sources import symbols
from .engine import Engine


@udtf(returnType="ordinal int, line int, kind int, name string, receiver string, signature string, doc string, embeds array<string>")
class ExtractSymbols:
    """``extract_symbols(path, content)``: what a source file declares, in order; nothing for one that can't be parsed."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        for i, n in enumerate((symbols.parse(path or "", bytes(content or b"")) or ([],))[0]):
            yield i, n["line"], n["kind"], n["name"], n["receiver"], n["signature"], n["doc"], n["embeds"]


@udtf(returnType="at int, kind int, pkg string, name string, line int, owner int")
class ExtractReferences:
    """``extract_references(path, content)``: what a source file calls and mentions; ``owner`` is an ordinal, -1 outside of symbols."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        got = symbols.parse(path or "", bytes(content or b""))
        for i, r in enumerate(got[1] if got else []):
            yield i, r["kind"], r["pkg"], r["name"], r["line"], r["owner"]


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL, for use in lateral joins over tables of files."""
    ship(spark)
    spark.udtf.register("extract_symbols", ExtractSymbols)
    spark.udtf.register("extract_references", ExtractReferences)


@dataclass(frozen=True)
class Tool:
    """A question: its arguments as name -> (type, whether it is required), and what answers it."""

    name: str
    says: str
    arguments: dict[str, tuple[type, bool]]
    answer: Callable[..., DataFrame | dict[str, DataFrame]]


class Registry:
    """Tools by name. Arguments that are missing, unknown or of a wrong type are refused before anything runs."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def add(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"there is a tool {tool.name!r} already")
        self._tools[tool.name] = tool

    def names(self) -> list[str]:
        return sorted(self._tools)

    def describe(self, spark: SparkSession) -> DataFrame:
        """(name, says, argument, type, required) of every tool's arguments, by name."""
        rows = [(t.name, t.says, a, kind.__name__, needed) for _, t in sorted(self._tools.items()) for a, (kind, needed) in t.arguments.items()]
        return spark.createDataFrame(rows, "name string, says string, argument string, type string, required boolean")

    def call(self, name: str, **given) -> DataFrame | dict[str, DataFrame]:
        if name not in self._tools:
            raise LookupError(f"no tool {name!r}; there are {', '.join(self.names())}")
        known = self._tools[name].arguments
        if unknown := sorted(set(given) - set(known)):
            raise TypeError(f"{name} takes no {', '.join(unknown)}")
        if missing := sorted(a for a, (_, needed) in known.items() if needed and given.get(a) is None):
            raise TypeError(f"{name} needs {', '.join(missing)}")
        for a, v in given.items():
            kind = known[a][0]
            if v is not None and (not isinstance(v, kind) or isinstance(v, bool) and kind is not bool):
                raise TypeError(f"{name}: {a} has to be {kind.__name__}, not {type(v).__name__}")
        return self._tools[name].answer(**given)


_WALK = {"symbol": (str, True), "depth": (int, False), "max_results": (int, False)}


def tools(engine: Engine) -> Registry:
    """The questions that an engine answers, by the names under which callers know them."""
    out = Registry()
    out.add(Tool("symbol_search", "symbols by words", {"query": (str, True), "max_results": (int, False)}, lambda query, max_results=None: engine.search(query, max_results)))
    out.add(Tool("symbol_node", "a symbol with its source and edges", {"symbol": (str, True)}, lambda symbol: engine.node(symbol)))
    for name, says, ask in (("callers", "what calls a symbol", engine.callers), ("callees", "what a symbol calls", engine.callees), ("trace", "calls in both directions", engine.trace), ("impact", "what a change may reach", engine.impact)):
        out.add(Tool(f"symbol_{name}", says, _WALK, lambda symbol, depth=None, max_results=None, ask=ask: ask(symbol, depth, max_results)))
    return out
