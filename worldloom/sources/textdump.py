"""Textdumps of a world, versions 1-4 and 17: one grammar read in both directions.

Every part of the format is a codec that can read itself from lines and write itself back, so reader and writer
cannot disagree and a dump survives a round trip byte by byte.  Values are the tagged records used everywhere in
this package.  ``WorldDump`` is a Spark data source over folders of dumps: one task per file, one row per record.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The format's type numbers, its version line, and built-ins that save a line of state.
TYPE_NUMBERS = {0: "int", 1: "obj", 2: "string", 3: "error", 4: "list", 5: "clear", 6: "none", 7: "catch", 8: "finally", 9: "float", 10: "map", 12: "anon", 13: "waif", 14: "bool"}
NUMBER_OF = {t: n for n, t in TYPE_NUMBERS.items()}
VERSION_LINE = re.compile(r"\*\* (\S+) Database, Format Version (\d+) \*\*")
STATEFUL_BUILTINS = ("create", "recreate", "recycle", "move")
CALL_FUNCTION = "bf_call_function data: fname = "
MAX_WAIF_SLOT = 96


class DumpError(ValueError):
    """What is wrong and in which line; never the text itself."""

    def __init__(self, what: str, line: int) -> None:
        super().__init__(f"{what} (line {line})")
        self.what, self.line = what, line


@dataclass
class Source:
    """Lines of a dump and what reading has learned so far."""

    lines: Iterator[str]
    version: int = 0
    at: int = 0
    waifs: dict[int, dict] = field(default_factory=dict)
    heads: dict = field(default_factory=dict)  # what has been read so far

    def line(self) -> str:
        self.at += 1
        try:
            return next(self.lines)
        except StopIteration:
            self.fail("unexpected end")

    def int(self) -> int:
        try:
            return int(self.line())
        except ValueError:
            self.fail("invalid integer")

    def count(self) -> int:
        n = self.int()
        if n < 0:
            self.fail("negative count")
        return n

    def fail(self, what: str):
        raise DumpError(what, self.at)


@dataclass
class Sink:
    """Lines written so far; waifs are numbered in the order they are first written."""

    version: int
    waifs: dict[int, dict]
    out: list[str] = field(default_factory=list)
    numbers: dict[int, int] = field(default_factory=dict)

    def line(self, text: object) -> None:
        self.out.append(str(text))


@dataclass(frozen=True)
class Codec:
    """A part of the format: how to read it and how to write it."""

    read: Callable[[Source], object]
    write: Callable[[Sink, object], None]


LINE = Codec(Source.line, Sink.line)
INT = Codec(Source.int, Sink.line)


def record(**parts: Codec) -> Codec:
    """Parts one after another, as a dict."""

    def write(s: Sink, v: dict) -> None:
        for k, c in parts.items():
            c.write(s, v[k])

    return Codec(lambda s: {k: c.read(s) for k, c in parts.items()}, write)


def many(item: Codec, head: str = "{}") -> Codec:
    """A counted sequence; the count stands in the line ``head``."""
    before, after = (re.escape(x) for x in head.split("{}"))
    pattern = re.compile(rf"{before}(-?\d+){after}")

    def read(s: Source) -> list:
        m = pattern.fullmatch(s.line())
        if not m or int(m.group(1)) < 0:
            s.fail("invalid count line")
        return [item.read(s) for _ in range(int(m.group(1)))]

    def write(s: Sink, v: list) -> None:
        s.line(head.format(len(v)))
        for x in v:
            item.write(s, x)

    return Codec(read, write)


def since(version: int, part: Codec, otherwise: object = None) -> Codec:
    """A part only newer formats have."""
    return Codec(lambda s: part.read(s) if s.version >= version else otherwise, lambda s, v: part.write(s, v) if s.version >= version else None)


def until_dot() -> Codec:
    """Lines up to a single dot."""

    def read(s: Source) -> list[str]:
        out = []
        while (x := s.line()) != ".":
            out.append(x)
        return out

    def write(s: Sink, v: list[str]) -> None:
        s.out += [*v, "."]

    return Codec(read, write)


CODE = until_dot()


def _bits(x: float) -> str:
    return struct.pack(">d", x).hex()


def _read_raw(s: Source, kind: str) -> dict:
    if kind in ("int", "obj", "error", "anon", "catch", "finally"):
        return {"type": kind, "value": str(s.int())}
    if kind == "string":
        return {"type": kind, "value": s.line()}
    if kind == "bool":
        return {"type": kind, "value": s.int() != 0}
    if kind == "float":
        try:
            return {"type": kind, "bits": _bits(float(s.line()))}
        except ValueError:
            s.fail("invalid float")
    if kind == "list":
        return {"type": kind, "items": [VALUE.read(s) for _ in range(s.count())]}
    if kind == "map":
        return {"type": kind, "entries": _read_entries(s)}
    if kind == "waif":
        return _read_waif(s)
    return {"type": kind}


def _read_entries(s: Source) -> list[dict]:
    seen, out = set(), []
    for _ in range(s.count()):
        k = VALUE.read(s)
        token = map_key(k)
        if token is None:
            s.fail("unsupported map key")
        if token in seen:
            s.fail("duplicate map key")
        seen.add(token)
        out.append({"key": k, "value": VALUE.read(s)})
    return out


_FOLD = {c: c + 32 for c in range(65, 91)}


def map_key(k: dict) -> tuple | None:
    """What the server compares a map key by; None for kinds and values that cannot be keys."""
    kind = k["type"]
    if kind in ("int", "obj", "error"):
        n = int(k["value"])
        return (kind, n & 0xFFFFFFFF) if -(2**63) <= n < 2**63 else None
    if kind == "string":
        return None if "\0" in k["value"] else (kind, k["value"].translate(_FOLD))
    if kind == "float":
        x = struct.unpack(">d", bytes.fromhex(k["bits"]))[0]
        return None if x != x else (kind, x + 0.0)
    return (kind, k["value"]) if kind in ("bool", "anon", "waif") else None


def _read_waif(s: Source) -> dict:
    m = re.fullmatch(r"([cr]) (\d+)", s.line())
    if not m:
        s.fail("invalid waif header")
    number = int(m.group(2))
    if m.group(1) == "c":
        if number in s.waifs:
            s.fail("duplicate waif")
        w = s.waifs[number] = {"waif_class": s.int(), "owner": s.int(), "propdefs_length": s.count(), "slots": []}
        while (slot := s.int()) != -1:
            if not 0 <= slot < MAX_WAIF_SLOT:
                s.fail("invalid waif slot")
            w["slots"].append([slot, VALUE.read(s)])
    if s.line() != ".":
        s.fail("invalid waif end")
    return {"type": "waif", "value": str(number)}


def _write_raw(s: Sink, v: dict) -> None:
    kind = v["type"]
    if kind == "bool":
        s.line(int(v["value"]))
    elif kind == "float":
        s.line(f"{struct.unpack('>d', bytes.fromhex(v['bits']))[0]:.19g}")
    elif kind == "list":
        s.line(len(v["items"]))
        for x in v["items"]:
            VALUE.write(s, x)
    elif kind == "map":
        s.line(len(v["entries"]))
        for e in v["entries"]:
            VALUE.write(s, e["key"])
            VALUE.write(s, e["value"])
    elif kind == "waif":
        number = int(v["value"])
        if number in s.numbers:
            s.out += [f"r {s.numbers[number]}", "."]
            return
        w, s.numbers[number] = s.waifs[number], len(s.numbers)
        s.out += [f"c {s.numbers[number]}", str(w["waif_class"]), str(w["owner"]), str(w["propdefs_length"])]
        for slot, x in w["slots"]:
            s.line(slot)
            VALUE.write(s, x)
        s.out += ["-1", "."]
    elif kind not in ("clear", "none"):
        s.line(v["value"])


def _read_value(s: Source) -> dict:
    kind = TYPE_NUMBERS.get(s.int())
    if kind is None:
        s.fail("unknown type")
    return _read_raw(s, kind)


def _write_value(s: Sink, v: dict) -> None:
    s.line(NUMBER_OF[v["type"]])
    _write_raw(s, v)


VALUE = Codec(_read_value, _write_value)
ENV = many(record(name=LINE, value=VALUE), "{} variables")
VERB = record(name=LINE, owner=INT, perms=INT, preps=INT)


def _read_slots(s: Source) -> dict:
    names = [s.line() for _ in range(s.count())]
    n = s.count()
    if n < len(names):
        s.fail("fewer property values than definitions")
    return {"names": names, "values": [{"value": VALUE.read(s), "owner": s.int(), "perms": s.int()} for _ in range(n)]}


def _write_slots(s: Sink, v: dict) -> None:
    s.line(len(v["names"]))
    s.out += v["names"]
    s.line(len(v["values"]))
    for x in v["values"]:
        VALUE.write(s, x["value"])
        s.out += [str(x["owner"]), str(x["perms"])]


SLOTS = Codec(_read_slots, _write_slots)
_NG_BODY = record(name=LINE, flags=INT, owner=INT, location=VALUE, last_move=since(15, VALUE), contents=VALUE, parents=VALUE, children=VALUE, verbs=many(VERB), slots=SLOTS)
_OLD_BODY = record(name=LINE, blank=LINE, flags=INT, owner=INT, location=INT, first_content=INT, neighbour=INT, parent=INT, first_child=INT, sibling=INT, verbs=many(VERB), slots=SLOTS)


def _object(body: Codec) -> Codec:
    def read(s: Source) -> dict:
        m = re.fullmatch(r"#\s*(\d+)( recycled)?", s.line())
        if not m:
            s.fail("invalid object header")
        return {"id": int(m.group(1)), "recycled": True} if m.group(2) else {"id": int(m.group(1)), "recycled": False, **body.read(s)}

    def write(s: Sink, v: dict) -> None:
        s.line(f"# {v['id']} recycled" if v["recycled"] else f"#{v['id']}")
        if not v["recycled"]:
            body.write(s, v)

    return Codec(read, write)


def _unique(item: Codec, key: Callable[[dict], object], what: str) -> Codec:
    """Records of which no two may have the same key."""
    plain = many(item)

    def read(s: Source) -> list[dict]:
        out = plain.read(s)
        if len({key(x) for x in out}) != len(out):
            s.fail(f"duplicate {what}")
        return out

    return Codec(read, plain.write)


OBJECTS = _unique(_object(_NG_BODY), lambda x: x["id"], "object")


def _read_batches(s: Source) -> list[list[dict]]:
    out = []
    while n := s.count():
        out.append([_object(_NG_BODY).read(s) for _ in range(n)])
        if any(x["recycled"] for x in out[-1]):
            s.fail("recycled anonymous object")
    return out


def _write_batches(s: Sink, v: list[list[dict]]) -> None:
    for batch in v:
        s.line(len(batch))
        for x in batch:
            _object(_NG_BODY).write(s, x)
    s.line(0)


def _read_program(s: Source) -> dict:
    m = re.fullmatch(r"#(\d+):(\d+)", s.line())
    if not m:
        s.fail("invalid program header")
    return {"oid": int(m.group(1)), "verb_index": int(m.group(2)), "code": CODE.read(s)}


def _write_program(s: Sink, v: dict) -> None:
    s.line(f"#{v['oid']}:{v['verb_index']}")
    CODE.write(s, v["code"])


PROGRAM = Codec(_read_program, _write_program)
PROGRAMS = _unique(PROGRAM, lambda x: (x["oid"], x["verb_index"]), "program")


def _numbers(n: int, pattern: str | None = None) -> Codec:
    """A line of ``n`` numbers."""

    def read(s: Source) -> list[int]:
        parts = s.line().split(" ")
        if len(parts) < n or not all(re.fullmatch(r"-?\d+", p) for p in parts[:n]):
            s.fail("invalid header of numbers")
        return [int(p) for p in parts[:n]]

    return Codec(read, lambda s, v: s.line(" ".join(map(str, v))))


#: A saved call as the server calls it "parse info": this, player, programmer and the command's words.
CALL = record(temp=VALUE, this=since(11, VALUE), vloc=since(13, VALUE), threaded=since(16, INT, 0), numbers=_numbers(9), argstr=LINE, dobjstr=LINE, prepstr=LINE, iobjstr=LINE, verb=LINE, verbname=LINE)


def _read_builtin(s: Source, name: str) -> list[str]:
    if name == "call_function":
        x = s.line()
        if not x.startswith(CALL_FUNCTION):
            s.fail("invalid call_function state")
        return [x, *_read_builtin(s, x[len(CALL_FUNCTION) :])]
    return [s.line()] if name in STATEFUL_BUILTINS else []


_FRAME_HEAD = record(language=since(3, LINE), code=CODE, env=ENV, stack=many(VALUE, "{} rt_stack slots in use"), call=CALL, end=VALUE, pc=_numbers(3))


def _read_frame(s: Source) -> dict:
    f = _FRAME_HEAD.read(s)
    f["builtin"] = None
    if f["pc"][1]:
        name = s.line()
        f["builtin"] = [name, *_read_builtin(s, name)]
    return f


def _write_frame(s: Sink, v: dict) -> None:
    _FRAME_HEAD.write(s, v)
    s.out += v["builtin"] or []


FRAME = Codec(_read_frame, _write_frame)


def _read_vm(s: Source) -> dict:
    local = VALUE.read(s) if s.version >= 6 else None
    head = _numbers(4).read(s)
    return {"local": local, "head": head, "frames": [FRAME.read(s) for _ in range(head[0] + 1)]}


def _write_vm(s: Sink, v: dict) -> None:
    if s.version >= 6:
        VALUE.write(s, v["local"])
    s.line(" ".join(map(str, v["head"])))
    for f in v["frames"]:
        FRAME.write(s, f)


VM = Codec(_read_vm, _write_vm)
QUEUED = record(head=_numbers(4), call=CALL, env=ENV, code=CODE)


def _read_suspended(s: Source) -> dict:
    m = re.fullmatch(r"(-?\d+) (\d+)(?: (\d+))?", s.line())
    if not m:
        s.fail("invalid suspended task")
    value = None
    if m.group(3):
        kind = TYPE_NUMBERS.get(int(m.group(3)))
        if kind is None:
            s.fail("unknown type")
        value = _read_raw(s, kind)
    return {"start": int(m.group(1)), "id": int(m.group(2)), "value": value, "vm": VM.read(s)}


def _write_suspended(s: Sink, v: dict) -> None:
    s.line(f"{v['start']} {v['id']}" + (f" {NUMBER_OF[v['value']['type']]}" if v["value"] is not None else ""))
    if v["value"] is not None:
        _write_raw(s, v["value"])
    VM.write(s, v["vm"])


def _read_interrupted(s: Source) -> dict:
    number, _, status = s.line().partition(" ")
    if not number.isdigit() or not status:
        s.fail("invalid interrupted task")
    return {"id": int(number), "status": status, "vm": VM.read(s)}


def _write_interrupted(s: Sink, v: dict) -> None:
    s.line(f"{v['id']} {v['status']}")
    VM.write(s, v["vm"])


def _read_connections(s: Source, optional: bool = False) -> dict | None:
    try:
        head = s.line()
    except DumpError:
        if optional:
            return None
        raise
    m = re.fullmatch(r"(\d+) active connections(| with listeners)", head)
    if not m:
        if optional:
            return None
        s.fail("invalid connections line")
    return {"listeners": m.group(2), "lines": [s.line() for _ in range(int(m.group(1)))]}


def _write_connections(s: Sink, v: dict | None) -> None:
    if v is not None:
        s.line(f"{len(v['lines'])} active connections{v['listeners']}")
        s.out += v["lines"]


TASKS = {"queued": many(QUEUED, "{} queued tasks"), "suspended": many(Codec(_read_suspended, _write_suspended), "{} suspended tasks")}
NEW_DUMP = {
    "players": many(INT),
    "pending": many(VALUE, "{} values pending finalization"),
    "clocks": many(LINE, "{} clocks"),
    **TASKS,
    "interrupted": many(Codec(_read_interrupted, _write_interrupted), "{} interrupted tasks"),
    "connections": Codec(_read_connections, _write_connections),
    "objects": OBJECTS,
    "anonymous": Codec(_read_batches, _write_batches),
    "programs": PROGRAMS,
}


def _counted_ahead(item: Codec, where: str) -> Codec:
    """Records whose number stood at the head of the dump."""
    return Codec(lambda s: [item.read(s) for _ in range(s.heads[where])], lambda s, v: [item.write(s, x) for x in v] and None)


OLD_DUMP = {
    "n_objects": INT,
    "n_programs": INT,
    "dummy": LINE,
    "players": many(INT),
    "objects": _counted_ahead(_object(_OLD_BODY), "n_objects"),
    "programs": _counted_ahead(PROGRAM, "n_programs"),
    "clocks": NEW_DUMP["clocks"],
    **TASKS,
    "connections": Codec(lambda s: _read_connections(s, True), _write_connections),
}


def _layout(version: int) -> dict[str, Codec] | None:
    return OLD_DUMP if 1 <= version <= 4 else NEW_DUMP if version == 17 else None


def _lines(data: bytes) -> Iterator[str]:
    """Lines without their ends; a bare carriage return belongs to the text."""
    for raw in data.decode("latin-1").split("\n"):
        yield raw[:-1] if raw.endswith("\r") else raw


def parse(data: bytes) -> dict:
    """A dump as nested records; ``DumpError`` where it breaks the format."""
    text = data[:-1] if data.endswith(b"\n") else data
    s = Source(_lines(text))
    m = VERSION_LINE.fullmatch(s.line())
    if not m:
        s.fail("invalid version line")
    s.version = int(m.group(2))
    layout = _layout(s.version)
    if layout is None:
        s.fail("unsupported version")
    out: dict = {"version": s.version, "server": m.group(1), "line_end": "\r\n" if b"\r\n" in data[:1000] else "\n"}
    s.heads = out
    for name, codec in layout.items():
        out[name] = codec.read(s)
    out["waifs"] = s.waifs
    return out


def render(dump: dict) -> bytes:
    """The dump's bytes; a dump that ``parse`` accepted comes back as it was."""
    return b"".join(text for _, text in pieces(dump))


def pieces(dump: dict) -> list[tuple[str, bytes]]:
    """The dump cut into named pieces, one per object and program and one per other section, in order."""
    s = Sink(dump["version"], dump["waifs"])
    out: list[tuple[str, bytes]] = []

    def cut(name: str) -> None:
        if s.out:
            out.append((name, (dump["line_end"].join(s.out) + dump["line_end"]).encode("latin-1")))
            s.out = []

    s.line(f"** {dump['server']} Database, Format Version {dump['version']} **")
    old = _layout(dump["version"]) is OLD_DUMP
    body = _OLD_BODY if old else _NG_BODY
    for name, codec in _layout(dump["version"]).items():
        if name in ("objects", "programs"):
            if not old:
                s.line(len(dump[name]))
            cut(f"{name}.head")
            for x in dump[name]:
                (_object(body) if name == "objects" else PROGRAM).write(s, x)
                cut(f"objects/{x['id']}.moo" if name == "objects" else f"verbs/{x['oid']}_{x['verb_index']}.moo")
            continue
        codec.write(s, dump[name])
        cut(name)
    return out


def manifest(parts: list[tuple[str, bytes]]) -> str:
    """One line per piece: name, length and digest."""
    return "".join(f"{n}\t{len(b)}\t{hashlib.sha256(b).hexdigest()}\n" for n, b in parts)


def write_split(dump: dict, folder: str) -> list[str]:
    """Write changed pieces and the manifest, remove stale pieces; returns the names written."""
    parts, wrote = pieces(dump), []
    for name, data in parts:
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if not os.path.exists(path) or open(path, "rb").read() != data:
            with open(path + ".new", "wb") as f:
                f.write(data)
            os.replace(path + ".new", path)
            wrote.append(name)
    keep = {n for n, _ in parts} | {"MANIFEST"}
    for root, _, files in os.walk(folder):
        for f in files:
            full = os.path.join(root, f)
            if os.path.relpath(full, folder) not in keep:
                os.remove(full)
    with open(os.path.join(folder, "MANIFEST"), "w") as f:
        f.write(manifest(parts))
    return wrote


def join_split(folder: str) -> bytes:
    """The dump of a folder of pieces; lengths and digests must match the manifest."""
    out = []
    for n, row in enumerate(open(os.path.join(folder, "MANIFEST")).read().splitlines(), 1):
        name, size, digest = row.split("\t")
        if name.startswith("/") or ".." in name.split("/"):
            raise DumpError("piece outside the folder", n)
        data = open(os.path.join(folder, name), "rb").read()
        if len(data) != int(size) or hashlib.sha256(data).hexdigest() != digest:
            raise DumpError("piece differs from the manifest", n)
        out.append(data)
    return b"".join(out)


def ancestors(dump: dict) -> Callable[[int], list[int]]:
    """Depth-first ancestor order of an object, itself first, each once, missing ones skipped."""
    every = {x["id"]: x for x in [*dump["objects"], *[y for b in dump.get("anonymous", []) for y in b]] if not x["recycled"]}

    def parents(x: dict) -> list[int]:
        if "parent" in x:
            return [x["parent"]]
        p = x["parents"]
        return [int(i["value"]) for i in p["items"]] if p["type"] == "list" else [int(p["value"])]

    def order(oid: int) -> list[int]:
        seen: dict[int, None] = {}
        todo = [oid]
        while todo:
            here = todo.pop()
            if here in seen or here not in every:
                continue
            seen[here] = None
            todo += reversed(parents(every[here]))
        return list(seen)

    return order


def rows(dump: dict) -> Iterator[tuple[str, int, dict]]:
    """``section, ord, payload``: flat records of a dump, ready for tables."""
    yield "snapshot", 0, {"version": dump["version"], "line_ending": dump["line_end"], "n_players": len(dump["players"]), "n_programs": len(dump["programs"])}
    for i, p in enumerate(dump["players"]):
        yield "player", i, {"id": p}
    code = {(p["oid"], p["verb_index"]): p["code"] for p in dump["programs"]}
    batches = [y for b in dump.get("anonymous", []) for y in b]
    every = {x["id"]: x for x in [*dump["objects"], *batches] if not x["recycled"]}
    order = ancestors(dump)
    nums = lambda v: [int(x["value"]) for x in v["items"]] if v["type"] == "list" else [int(v["value"])]
    for i, x in enumerate([*dump["objects"], *batches]):
        if x["recycled"]:
            yield "recycled", i, {"id": x["id"]}
            continue
        new = "parents" in x
        yield "object", i, {
            "id": x["id"], "name": x["name"], "flags": x["flags"], "owner": x["owner"], "location": int(x["location"]["value"]) if new else x["location"], "parents": nums(x["parents"]) if new else [x["parent"]], "parents_listed": new and x["parents"]["type"] == "list",
            "children": nums(x["children"]) if new else None, "contents": nums(x["contents"]) if new else None, "last_move": json.dumps(x.get("last_move")), "propdefs_count": len(x["slots"]["names"]), "anon": i >= len(dump["objects"]),
        }
        for j, v in enumerate(x["verbs"]):
            yield "verb", j, {"oid": x["id"], "verb_index": j, **v, "code": code.get((x["id"], j))}
        names = [(a, n) for a in order(x["id"]) for n in every[a]["slots"]["names"]]
        for j, v in enumerate(x["slots"]["values"]):
            definer, name = names[j] if j < len(names) else (None, str(j + 1))
            yield "property", j, {"oid": x["id"], "slot": j, "name": name, "definer": definer, "owner": v["owner"], "perms": v["perms"], "value_json": json.dumps(v["value"], ensure_ascii=False)}
    for n, w in dump["waifs"].items():
        yield "waif", n, {"waif_index": n, "waif_class": w["waif_class"], "owner": w["owner"], "propdefs_length": w["propdefs_length"], "props": json.dumps(w["slots"], ensure_ascii=False)}
    for kind in ("queued", "suspended", "interrupted"):
        for i, t in enumerate(dump.get(kind, [])):
            frames = t["vm"]["frames"] if "vm" in t else [{"call": t["call"], "env": t["env"], "code": t["code"]}]
            yield "task", i, {"kind": kind, "id": t["head"][3] if kind == "queued" else t["id"], "start": t["head"][2] if kind == "queued" else t.get("start"), "status": t.get("status"), "n_frames": len(frames)}
            for j, f in enumerate(frames):
                yield "frame", i, {"kind": kind, "task": i, "frame": j, "this": f["call"]["numbers"][0], "player": f["call"]["numbers"][3], "programmer": f["call"]["numbers"][5], "verb": f["call"]["verb"], "n_lines": len(f["code"])}
                for v in f["env"]:
                    yield "variable", i, {"kind": kind, "task": i, "frame": j, "name": v["name"], "value_json": json.dumps(v["value"], ensure_ascii=False)}
    for i, c in enumerate((dump["connections"] or {"lines": []})["lines"]):
        yield "connection", i, {"line": c}


#: Columns of the tables a dump yields.
TABLES = {
    "snapshot": "version int, line_ending string, n_players int, n_programs int",
    "player": "id bigint",
    "recycled": "id bigint",
    "object": "id bigint, name string, flags int, owner bigint, location bigint, parents array<bigint>, parents_listed boolean, children array<bigint>, contents array<bigint>, last_move string, propdefs_count int, anon boolean",
    "verb": "oid bigint, verb_index int, name string, owner bigint, perms int, preps int, code array<string>",
    "property": "oid bigint, slot int, name string, definer bigint, owner bigint, perms int, value_json string",
    "waif": "waif_index bigint, waif_class bigint, owner bigint, propdefs_length int, props string",
    "task": "kind string, id bigint, start bigint, status string, n_frames int",
    "frame": "kind string, task int, frame int, this bigint, player bigint, programmer bigint, verb string, n_lines int",
    "variable": "kind string, task int, frame int, name string, value_json string",
    "connection": "line string",
}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        found = sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [_File(p) for p in found if os.path.isfile(p)]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            data = f.read()
        for section, ord_, payload in rows(parse(data)):
            yield os.path.basename(partition.path), section, ord_, json.dumps(payload, ensure_ascii=False)


class WorldDump(DataSource):
    """``spark.read.format("worlddump").load(folder)``: one task per dump file, one row per record."""

    @classmethod
    def name(cls) -> str:
        return "worlddump"

    def schema(self) -> str:
        return "dump string, section string, ord bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of all dumps in a folder, each with the column ``dump``."""
    spark.dataSource.register(WorldDump)
    raw = spark.read.format("worlddump").load(path)
    return {t: raw.filter(F.col("section") == t).select("dump", F.from_json("payload", schema).alias("r")).select("dump", "r.*") for t, schema in TABLES.items()}


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """``dump, size, changed, sha256`` of dump files, hashed by the executors."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("dump"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"), F.sha2("content", 256).alias("sha256"))


def round_trips(spark: SparkSession, path: str) -> DataFrame:
    """``dump, same, first_line``: whether each dump is written back byte by byte, and the first differing line if not."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for name, data in zip(b["dump"], b["content"]):
                again = render(parse(bytes(data)))
                pairs = enumerate(zip(bytes(data).split(b"\n"), again.split(b"\n")), 1)
                out.append((name, again == bytes(data), None if again == bytes(data) else next((i for i, (x, y) in pairs if x != y), 0)))
            yield pd.DataFrame(out, columns=["dump", "same", "first_line"])

    b = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("dump"), "content")
    return b.mapInPandas(run, "dump string, same boolean, first_line int")


def open_cached(spark: SparkSession, path: str, cache: str) -> dict[str, DataFrame]:
    """As ``load``, parsing once: tables are kept as parquet under a digest of the files' names, sizes and times.

    A later query reads only the tables and columns it needs, without touching the dumps.
    """
    seen = sorted((os.path.basename(p), os.path.getsize(p), os.path.getmtime(p)) for p in glob.glob(os.path.join(path, "*")))
    folder = os.path.join(cache, hashlib.sha256(json.dumps([seen, TABLES], sort_keys=True).encode()).hexdigest()[:24])
    if not os.path.exists(os.path.join(folder, "COMPLETE")):
        for t, df in load(spark, path).items():
            df.write.mode("overwrite").parquet(f"{folder}/{t}")
        open(os.path.join(folder, "COMPLETE"), "w").close()
    return {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}
