"""The single-file text index, for exchange with tools that read it.

Header lines (magic, mtime, tree, a line for each section with offset and
length, a blank), then the sections' records in canonical order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The magic line, the sections and what their records begin with.
MAGIC = "refidx v2"
SECTIONS = {"forward": "fwd:", "mentions": "men:", "paths": ""}


@dataclass
class Image:
    forward: list[tuple[str, str]] = field(default_factory=list)  # name, location
    mentions: list[tuple[str, str]] = field(default_factory=list)  # token, location
    paths: list[str] = field(default_factory=list)
    mtime: int = 0
    tree: str = ""


def encode(image: Image) -> bytes:
    by_bytes = lambda row: tuple(x.encode() for x in row)
    pairs = lambda rows, mark: "".join(f"{mark}{a}\t{b}\n" for a, b in sorted(rows, key=by_bytes))
    bodies = {
        "forward": pairs(image.forward, SECTIONS["forward"]).encode(),
        "mentions": pairs(image.mentions, SECTIONS["mentions"]).encode(),
        "paths": "".join(f"{p}\n" for p in sorted(image.paths, key=str.encode)).encode(),
    }
    head, size = b"", -1
    while len(head) != size:  # offsets count the header, whose length depends on their digits
        size = at = len(head)
        rows = [MAGIC, f"mtime:{image.mtime}", f"tree:{image.tree}"]
        for name, body in bodies.items():
            rows.append(f"section:{name}:{at}:{len(body)}")
            at += len(body)
        head = ("\n".join(rows) + "\n\n").encode()
    return head + b"".join(bodies.values())


def decode(data: bytes) -> Image:
    """Raises ValueError for anything that isn't whole."""
    head, blank, _ = data.partition(b"\n\n")
    rows = head.decode().split("\n")
    if not blank or rows[0] != MAGIC:
        raise ValueError("corrupt index: unknown format")
    values = dict(r.partition(":")[::2] for r in rows[1:3])
    if not values.get("mtime", "").isdigit():
        raise ValueError("corrupt index: no mtime")
    sections: dict[str, list[str]] = {}
    for row in rows[3:]:
        kind, name, at, size = (row.split(":") + [""] * 4)[:4]
        if kind != "section" or not (at.isdigit() and size.isdigit()) or int(at) + int(size) > len(data):
            raise ValueError("corrupt index: bad section")
        sections[name] = data[int(at) : int(at) + int(size)].decode().splitlines()
    if missing := SECTIONS.keys() - sections.keys():
        raise ValueError(f"corrupt index: no section {sorted(missing)[0]}")
    pairs = lambda name: [tuple(r.removeprefix(SECTIONS[name]).split("\t", 1)) for r in sections[name]]
    return Image(pairs("forward"), pairs("mentions"), sections["paths"], int(values["mtime"]), values.get("tree", ""))
