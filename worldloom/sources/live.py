"""A running server as a source: statements go over a line connection, literals come back."""

from __future__ import annotations

import json
import socket
from collections.abc import Iterator

from worldloom.functions import literals


class Session:
    """A logged-in connection; every answer stands between two marks, so chatter in between is told apart."""

    def __init__(self, host: str, port: int, timeout: float = 10.0, encoding: str = "latin-1") -> None:
        self.encoding = encoding
        self.wire = socket.create_connection((host, port), timeout)
        self.wire.settimeout(timeout)
        self.rest = b""
        self.asked = 0

    def send(self, line: str) -> None:
        self.wire.sendall((line + "\r\n").encode(self.encoding))

    def lines(self) -> Iterator[str]:
        """Lines as they arrive, until the server closes the connection."""
        while True:
            while b"\n" in self.rest:
                raw, self.rest = self.rest.split(b"\n", 1)
                yield raw.rstrip(b"\r").decode(self.encoding)
            more = self.wire.recv(65536)
            if not more:
                return
            self.rest += more

    def login(self, name: str, password: str) -> None:
        self.send(f"connect {name} {password}")

    def ask(self, statements: str) -> list[dict]:
        """Run statements whose ``notify``-ed lines are literals; the typed values in order."""
        self.asked += 1
        mark = f"=-= {self.asked} =-="
        self.send(f'; notify(player, "{mark}"); {statements} notify(player, "{mark}");')
        inside, out = False, []
        for line in self.lines():
            if line == mark:
                if inside:
                    return out
                inside = True
            elif inside:
                try:
                    out.append(literals.parse(line))
                except literals.LiteralError:
                    continue
        raise ConnectionError("the server closed the connection before it answered")

    def census(self, first: int, last: int, block: int) -> Iterator[str]:
        """JSON lines of a block walk: object rows, then a line for each finished block."""
        seq = 0
        for lo in range(first, last + 1, block):
            hi = min(last, lo + block - 1)
            for v in self.ask(f"for o in [#{lo}..#{hi}] if (valid(o)) notify(player, toliteral({{o, o.name, o.owner, parent(o), o.location, length(verbs(o)), length(properties(o)), length(children(o)), length(o.contents), o.f, is_player(o)}})); endif endfor"):
                if v["type"] == "list" and len(v["items"]) == 11:
                    seq += 1
                    x = [i.get("value") for i in v["items"]]
                    yes = lambda t: str(t) in ("1", "True")
                    yield json.dumps(dict(zip(("object", "name", "owner", "parent", "location", "n_verbs", "n_properties", "n_children", "n_contents"), [int(x[0]), x[1], *map(int, x[2:9])])) | {"fertile": yes(x[9]), "player": yes(x[10]), "seq": seq})
            yield json.dumps({"block_first": lo, "block_last": hi})

    def close(self) -> None:
        self.wire.close()
