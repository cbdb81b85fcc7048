"""An adaptive radix tree over byte keys, for keys made of ids of one fixed width.

Inner nodes come in four layouts that grow into one another: up to 4 and up to 16 children as sorted bytes beside
their nodes, up to 48 behind an index of 256 places, up to 256 in an array. A node holds the bytes that all keys below
it share (path compression). Keys may end inside others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class _Sorted:
    """Up to ``room`` children, their bytes in order."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int, found: list[tuple[int, Node]] = ()) -> None:  # type: ignore[assignment]
        self.room = room
        self.bytes = bytearray(b for b, _ in found)
        self.nodes = [n for _, n in found]

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node):
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.room:
            wider = _Sorted(16, list(self)) if self.room == 4 else _Indexed(list(self))
            return wider.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes, strict=True)

    def __len__(self) -> int:
        return len(self.nodes)


class _Indexed:
    """Up to 48 children; ``place`` says for each byte where its node stands, 255 where there is none."""

    __slots__ = ("nodes", "place")

    def __init__(self, found: list[tuple[int, Node]]) -> None:
        self.place = bytearray(b"\xff" * 256)
        self.nodes: list[Node] = []
        for byte, node in found:
            self.put(byte, node)

    def get(self, byte: int) -> Node | None:
        at = self.place[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node: Node):
        at = self.place[byte]
        if at != 255:
            self.nodes[at] = node
            return self
        if len(self.nodes) == 48:
            return _Full(list(self)).put(byte, node)
        self.place[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[at]) for byte, at in enumerate(self.place) if at != 255)

    def __len__(self) -> int:
        return len(self.nodes)


class _Full:
    """A node for each byte."""

    __slots__ = ("nodes",)

    def __init__(self, found: list[tuple[int, Node]]) -> None:
        self.nodes: list[Node | None] = [None] * 256
        for byte, node in found:
            self.nodes[byte] = node

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node):
        self.nodes[byte] = node
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)

    def __len__(self) -> int:
        return sum(node is not None for node in self.nodes)


class Node:
    """``path`` leads to this node from its parent, the byte of the branch included; ``value`` is of a key that ends here."""

    __slots__ = ("children", "path", "value")

    def __init__(self, path: bytes, value: object = None) -> None:
        self.path = path
        self.value = value
        self.children: _Sorted | _Indexed | _Full = _Sorted(4)


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def put(self, key: bytes, value: object) -> None:
        """Enters ``value``, which is not None, for ``key``; a later value of the same key replaces it."""
        node, at, above = self.root, 0, None
        while True:
            path = node.path
            if key.startswith(path, at):
                at += len(path)
                if at == len(key):
                    node.value = value
                    return
                below = node.children.get(key[at])
                if below is None:
                    node.children = node.children.put(key[at], Node(key[at:], value))
                    return
                node, above = below, node
                continue
            same = _shared(path, key, at)
            fork = Node(path[:same])
            node.path = path[same:]
            fork.children = fork.children.put(node.path[0], node)
            if at + same == len(key):
                fork.value = value
            else:
                fork.children = fork.children.put(key[at + same], Node(key[at + same :], value))
            above.children = above.children.put(fork.path[0], fork)
            return

    def layouts(self) -> dict[str, int]:
        """How many inner nodes stand in which layout."""
        counts: dict[str, int] = {}
        todo = [self.root]
        while todo:
            node = todo.pop()
            kind = node.children
            name = f"sorted{kind.room}" if isinstance(kind, _Sorted) else type(kind).__name__.strip("_").lower()
            if len(kind):
                counts[name] = counts.get(name, 0) + 1
            todo.extend(n for _, n in kind)
        return counts


def _shared(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` stand in ``key`` from ``at`` on; halves the stretch, as bytes compare fast."""
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if path[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low
