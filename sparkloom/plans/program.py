"""A program layer: named values, ticks of calls, receipts, address queries, flowchart documents, effects.

A value is usually a lazy DataFrame; a program only names plans, and Spark runs them at a sink. Pure
calculations are registered under fn.*, those with effects under oc.* and get an Effects handle.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import time
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Address -> value, and calculations by address. Reading what isn't there is an error."""

    def __init__(self):
        self.values: dict[str, object] = {}
        self.calculations: dict[str, Callable] = {}

    def register(self, address: str, fn: Callable) -> None:
        if not address.startswith(("fn.", "oc.")):
            raise ValueError(f"{address!r} begins with neither fn. nor oc.")
        old = self.calculations.get(address)
        if old is not None and _body(old) != _body(fn):
            raise ValueError(f"{address} is registered with another body")
        self.calculations[address] = fn

    def read(self, address: str):
        if address not in self.values:
            raise KeyError(f"nothing is at {address}")
        return self.values[address]

    def write(self, address: str, value) -> str:
        kind = "replacement" if address in self.values else "new-address"
        self.values[address] = value
        if isinstance(value, DataFrame):
            value.createOrReplaceTempView(re.sub(r"\W", "_", address))
        return kind

    def addresses(self) -> list[str]:
        return sorted(self.values)


def _body(fn: Callable) -> object:
    try:
        return inspect.getsource(fn)
    except (OSError, TypeError):
        return getattr(fn, "__code__", fn)


@dataclass
class Query:
    """Addresses that match; nothing is read until asked."""

    test: Callable[[str], bool]
    says: str
    predicate: Callable[[object], bool] | None = None

    @staticmethod
    def part(address: str) -> Query:
        return Query(lambda a: a == address, address)

    @staticmethod
    def prefix(prefix: str) -> Query:
        return Query(lambda a: a.startswith(prefix), prefix + "*")

    @staticmethod
    def segments(**at: str) -> Query:
        """By parts of the address between dots: s0="px", s1=.."""
        want = {int(k[1:]): v for k, v in at.items()}
        return Query(lambda a: all(len(p := a.split(".")) > i and p[i] == v for i, v in want.items()), f"segments {want}")

    def where(self, predicate: Callable[[object], bool]) -> Query:
        return Query(self.test, self.says + " where", predicate)

    def matches(self, catalog: Catalog) -> list[tuple[str, object]]:
        return [(a, catalog.values[a]) for a in catalog.addresses() if self.test(a) and (self.predicate is None or self.predicate(catalog.values[a]))]

    def values(self, catalog: Catalog) -> list:
        return [v for _, v in self.matches(catalog)]

    def one(self, catalog: Catalog):
        found = self.matches(catalog)
        if len(found) != 1:
            raise LookupError(f"{self.says} matches {len(found)} addresses")
        return found[0][1]

    def optional(self, catalog: Catalog):
        found = self.matches(catalog)
        if len(found) > 1:
            raise LookupError(f"{self.says} matches {len(found)} addresses")
        return found[0][1] if found else None


@dataclass
class Call:
    id: str
    calculation: str
    into: list[str]
    inputs: dict[str, str]
    args: dict = field(default_factory=dict)


@dataclass
class Receipt:
    tick: str
    id: str
    calculation: str
    reads: list[str]
    writes: list[str]
    kinds: list[str]
    ms: float


class Program:
    """Ticks of calls in order. An address has one writer, and nothing reads what a later tick writes."""

    def __init__(self, name: str = "program"):
        self.name, self.ticks, self._ids, self._writers = name, {}, set(), {}

    def calc(self, tick: str, calculation: str, *, id: str, into: str | Sequence[str], args: dict | None = None, **inputs: str) -> Program:
        into = [into] if isinstance(into, str) else list(into)
        if id in self._ids:
            raise ValueError(f"call {id!r} is there already")
        for a in into:
            if a in self._writers:
                raise ValueError(f"{a} has two writers")
        self._ids.add(id)
        self._writers.update(dict.fromkeys(into, id))
        self.ticks.setdefault(tick, []).append(Call(id, calculation, into, inputs, args or {}))
        return self

    def classify(self, tick: str) -> str:
        """chain where a call reads what another of its tick writes, else parallel."""
        written: set[str] = set()
        for call in self.ticks[tick]:
            if written & set(call.inputs.values()):
                return "chain"
            written |= set(call.into)
        return "parallel"

    def check(self, catalog: Catalog) -> None:
        known, later = set(catalog.values), {a for calls in self.ticks.values() for c in calls for a in c.into}
        for tick, calls in self.ticks.items():
            for c in calls:
                for a in c.inputs.values():
                    if a not in known:
                        raise ValueError(f"{c.id} in {tick} reads {a}" + (", which is written later" if a in later else ", which nothing writes"))
                known |= set(c.into)

    def run(self, catalog: Catalog, parallel: bool = False, budget_ms: float | None = None, clock: Callable[[], float] = time.perf_counter, effects: Effects | None = None, override: dict[str, Callable] | None = None) -> Record:
        """Results are published after a whole tick, in the order of its calls. A budget ends the run between ticks."""
        self.check(catalog)
        began, receipts, done = clock(), [], []
        for tick, calls in self.ticks.items():
            if budget_ms is not None and (clock() - began) * 1000 > budget_ms:
                break
            fresh: dict[str, object] = {}

            def one(c: Call, fresh=fresh):
                fn = (override or {}).get(c.id) or catalog.calculations.get(c.calculation)
                if fn is None:
                    raise KeyError(f"{c.calculation} isn't registered")
                given = {k: fresh[a] if a in fresh else catalog.read(a) for k, a in c.inputs.items()} | c.args
                if c.calculation.startswith("oc."):
                    given["effects"] = effects or Effects(0)
                t = clock()
                return split(c, fn(**given)), (clock() - t) * 1000

            if parallel and self.classify(tick) == "parallel":
                with ThreadPoolExecutor(max(1, len(calls))) as pool:
                    results = list(pool.map(one, calls))
            else:
                results = []
                for c in calls:
                    results.append(one(c))
                    fresh.update(results[-1][0])
            for c, (values, ms) in zip(calls, results, strict=True):
                kinds = [catalog.write(a, v) for a, v in values.items()]
                receipts.append(Receipt(tick, c.id, c.calculation, sorted(c.inputs.values()), list(values), kinds, ms))
                catalog.write(f"px.receipt.{self.name}.{tick}.{c.id}", receipts[-1])
            done.append(tick)
        return Record(self.name, done, receipts)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "ticks": [{"name": t, "calls": [c.__dict__ for c in calls]} for t, calls in self.ticks.items()]}, indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Program:
        doc = json.loads(text)
        p = Program(doc["name"])
        for t in doc["ticks"]:
            for c in t["calls"]:
                p.calc(t["name"], c["calculation"], id=c["id"], into=c["into"], args=c["args"], **c["inputs"])
        return p

    def to_mermaid(self) -> str:
        lines = ["flowchart TD"]
        for calls in self.ticks.values():
            for c in calls:
                lines.append(f"  {c.id}[{c.calculation}]")
                lines += [f"  {self._writers[a]} --> {c.id}" for a in sorted(c.inputs.values()) if a in self._writers]
        return "\n".join(lines)


def split(call: Call, value) -> dict[str, object]:
    """One result to several addresses: a dict by address or in order, or a sequence."""
    if len(call.into) == 1:
        return {call.into[0]: value}
    parts = list(value.values()) if isinstance(value, dict) and not set(call.into) <= set(value) else [value[a] for a in call.into] if isinstance(value, dict) else list(value)
    if len(parts) != len(call.into):
        raise ValueError(f"{call.id} gives {len(parts)} values for {len(call.into)} addresses")
    return dict(zip(call.into, parts, strict=True))


@dataclass
class Record:
    name: str
    ticks: list[str]
    receipts: list[Receipt]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, k, r.tick, r.id, r.calculation, r.reads, r.writes, r.ms) for k, r in enumerate(self.receipts)]
        return spark.createDataFrame(rows, "program string, position long, tick string, id string, calculation string, reads array<string>, writes array<string>, ms double")


_EDGE = re.compile(r"^\s*(\w+)(?:\[([^\]]*)\])?\s*(?:-->\s*(\w+)(?:\[([^\]]*)\])?)?\s*;?\s*$")


def parse_mermaid(source: str) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Nodes (id -> text) and edges of a flowchart."""
    nodes: dict[str, str] = {}
    edges: list[tuple[str, str]] = []
    lines = [x for x in source.splitlines() if x.strip() and not x.strip().startswith("%%")]
    if not lines or not re.match(r"\s*(flowchart|graph)\b", lines[0]):
        raise ValueError("a flowchart begins with 'flowchart'")
    for line in lines[1:]:
        m = _EDGE.match(line)
        if not m:
            raise ValueError(f"can't read {line.strip()!r}")
        for name, text in ((m[1], m[2]), (m[3], m[4])):
            if name and (text or name not in nodes):
                nodes[name] = text or name
        if m[3]:
            edges.append((m[1], m[3]))
    return nodes, edges


def compile_mermaid(source: str, args: dict[str, dict] | None = None, name: str = "program") -> Program:
    """A flowchart of calculations as a program: a tick per level, results at px.<name>.<node>. A cycle is an error."""
    nodes, edges = parse_mermaid(source)
    level: dict[str, int] = {}
    while len(level) < len(nodes):
        ready = [n for n in nodes if n not in level and all(a in level for a, b in edges if b == n)]
        if not ready:
            raise ValueError("the flowchart has a cycle")
        level.update({n: max([level[a] + 1 for a, b in edges if b == n], default=0) for n in ready})
    out = Program(name)
    for n in sorted(nodes, key=lambda n: (level[n], list(nodes).index(n))):
        inputs = {a: f"px.{name}.{a}" for a, b in edges if b == n}
        out.calc(f"t{level[n]}", nodes[n], id=n, into=f"px.{name}.{n}", args=(args or {}).get(n), **inputs)
    return out


class Effects:
    """Seeded draws, reads and writes, each noted in a ledger with a digest of what it gave."""

    def __init__(self, seed: int, root: str | None = None):
        self.random, self.root, self.ledger = Random(seed), root, []

    def _note(self, kind: str, what: str, value):
        self.ledger.append((kind, what, hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest(), value))
        return value

    def draw(self) -> float:
        return self._note("draw", "", self.random.random())

    def draws(self, n: int) -> list[float]:
        return [self.draw() for _ in range(n)]

    def clock(self) -> float:
        return self._note("clock", "", time.time())

    def read_text(self, path: str) -> str:
        from ..sources.readers import safe_path

        with open(safe_path(self.root or ".", path)) as f:
            return self._note("read", path, f.read())

    def write_text(self, path: str, text: str) -> None:
        from ..sources.readers import safe_path

        with open(safe_path(self.root or ".", path), "w") as f:
            f.write(text)
        self._note("write", path, hashlib.sha256(text.encode()).hexdigest())


class Replay(Effects):
    """Plays a ledger back; another kind or place than noted is an error."""

    def __init__(self, ledger: Iterable[tuple]):
        super().__init__(0)
        self.left = list(ledger)

    def _next(self, kind: str, what: str):
        if not self.left or self.left[0][:2] != (kind, what):
            raise RuntimeError(f"the replay asks for {kind} {what}, the ledger has {self.left[0][:2] if self.left else 'nothing'}")
        return self._note(kind, what, self.left.pop(0)[3])

    def draw(self) -> float:
        return self._next("draw", "")

    def clock(self) -> float:
        return self._next("clock", "")

    def read_text(self, path: str) -> str:
        return self._next("read", path)

    def write_text(self, path: str, text: str) -> None:
        if self._next("write", path) != hashlib.sha256(text.encode()).hexdigest():
            raise RuntimeError(f"the replay writes another text to {path}")


class Mounts:
    """Worlds (catalogs) under root names, in the order in which they came. A root is never part of an address, and a label is only for readers."""

    def __init__(self, worlds: Iterable[tuple[str, Catalog, str | None]] = ()):
        self._of: dict[str, list] = {}
        for root, world, label in worlds:
            self.mount(root, world)
            self._of[root][1] = label

    def mount(self, root: str, world: Catalog) -> None:
        """Mounting the same world again changes nothing; another one under a taken root is an error."""
        if not root or not isinstance(root, str):
            raise ValueError("a root is a name")
        if self._of.setdefault(root, [world, None])[0] is not world:
            raise ValueError(f"{root} holds another world")

    def __contains__(self, root: str) -> bool:
        return root in self._of

    def _at(self, root: str) -> list:
        if root not in self._of:
            raise KeyError(f"nothing is mounted at {root}")
        return self._of[root]

    def world(self, root: str) -> Catalog:
        return self._at(root)[0]

    def name(self, root: str, label: str) -> None:
        self._at(root)[1] = label

    def label(self, root: str) -> str | None:
        return self._at(root)[1]

    def roots(self) -> list[str]:
        return list(self._of)

    def only(self, *roots: str) -> Mounts:
        """Some of the roots; the worlds are shared, not copied."""
        return Mounts((root, *self._at(root)) for root in roots)

    def addresses(self, spark: SparkSession) -> DataFrame:
        """(root, label, address) over all worlds."""
        rows = [(root, label, address) for root, (world, label) in self._of.items() for address in world.addresses()]
        return spark.createDataFrame(rows, "root string, label string, address string")


def describe(value, cap_bytes: int = 65_536, array_cap: int = 256) -> dict:
    """{kind, data, note} of a value for a record: a table or list by its first `array_cap` entries, text as it is, else JSON.

    What is over the cap or can't be written as JSON is omitted, and the note says so.
    """
    cut: list[int] = []

    def first(v):
        if isinstance(v, dict):
            return {k: first(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            if len(v) > array_cap:
                cut.append(len(v))
            return [first(x) for x in v[:array_cap]]
        return v

    if isinstance(value, DataFrame):
        rows = [json.loads(r[0]) for r in value.select(F.to_json(F.struct(*value.columns))).limit(array_cap + 1).collect()]
        kind, data = "array", rows[:array_cap]
        note = f"the first {array_cap} rows" if len(rows) > array_cap else None
    elif isinstance(value, str):
        kind, data, note = ("svg" if re.match(r"\s*(<\?xml[^>]*>\s*)?<svg\b", value) else "text"), value, None
    else:
        kind, data = "json", first(value.tolist() if hasattr(value, "tolist") else value)
        note = f"{len(cut)} arrays cut to {array_cap} entries, of {', '.join(map(str, sorted(cut, reverse=True)))}" if cut else None
    try:
        size = len(json.dumps(data).encode())
    except (TypeError, ValueError, RecursionError) as e:
        return {"kind": "omitted", "data": None, "note": f"{type(value).__name__} can't be written as JSON: {e}"}
    if size > cap_bytes:
        return {"kind": "omitted", "data": None, "note": f"{size} bytes are over the cap of {cap_bytes}"}
    return {"kind": kind, "data": data, "note": note}


class Memo:
    """Results by the digest of revision, calculation and arguments: in the session, then as Parquet, then computed."""

    def __init__(self, spark: SparkSession, folder: str, revision: str = ""):
        self.spark, self.folder, self.revision, self.session = spark, folder.rstrip("/"), revision, {}
        self.counters = {"requests": 0, "hits": 0, "disk": 0, "misses": 0}

    def get(self, calculation: str, args: dict, compute: Callable[[], DataFrame]) -> DataFrame:
        key = hashlib.sha256(json.dumps([self.revision, calculation, args], sort_keys=True).encode()).hexdigest()
        self.counters["requests"] += 1
        if key in self.session:
            self.counters["hits"] += 1
            return self.session[key]
        path = f"{self.folder}/{key}"
        try:
            found = self.spark.read.parquet(path)
            self.counters["disk"] += 1
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            compute().write.parquet(path)
            found = self.spark.read.parquet(path)
            self.counters["misses"] += 1
        self.session[key] = found
        return found


def digest(df: DataFrame) -> DataFrame:
    """An order-free digest of a table: rows and two sums of row hashes."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", part(1), part(9)).alias("digest"))
