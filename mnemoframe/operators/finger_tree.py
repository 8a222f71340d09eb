"""A finger B-tree of partial aggregates over integer keys.

Entries sit in leaves; each node holds the sum over its subtree. An insert starts at the right finger (the newest leaf),
climbs only as far as the key lies behind it and adds its delta to the ancestors, so that an entry d places
behind the newest costs O(log d) to find and O(log n) to aggregate. ``evict`` cuts whole subtrees off the left spine.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

Pair = tuple[int, int]


class _Node:
    __slots__ = ("items", "keys", "leaf", "one", "parent", "two")

    def __init__(self, leaf: bool) -> None:
        self.leaf, self.keys, self.items, self.parent = leaf, [], [], None
        self.one = self.two = 0


class FingerTree:
    """Two counters per key, summed upwards. ``width`` is the most entries or children of a node."""

    def __init__(self, width: int = 32) -> None:
        self.width, self.root = max(4, width), _Node(True)
        self.finger = self.root
        self.floor: int | None = None  # keys up to this one are evicted

    def add(self, key: int, one: int, two: int) -> bool:
        """Adds to the key's counters; False, without effect, if the key is evicted."""
        if self.floor is not None and key <= self.floor:
            return False
        node = self.finger
        while node.parent is not None and (not node.keys or key < node.keys[0]):
            node = node.parent
        while not node.leaf:
            node = node.items[max(0, bisect_right(node.keys, key) - 1)]
        at = bisect_left(node.keys, key)
        if at < len(node.keys) and node.keys[at] == key:
            entry = node.items[at]
            entry[0] += one
            entry[1] += two
        else:
            node.keys.insert(at, key)
            node.items.insert(at, [one, two])
        leaf = node
        while node is not None:
            node.one += one
            node.two += two
            if node.keys[0] > key:
                node.keys[0] = key
            node = node.parent
        if len(leaf.keys) > self.width:
            self._split(leaf)
        return True

    def _split(self, node: _Node) -> None:
        while len(node.keys) > self.width:
            half = len(node.keys) // 2
            right = _Node(node.leaf)
            right.keys, right.items = node.keys[half:], node.items[half:]
            del node.keys[half:], node.items[half:]
            if right.leaf:
                right.one, right.two = sum(x[0] for x in right.items), sum(x[1] for x in right.items)
            else:
                for kid in right.items:
                    kid.parent = right
                right.one, right.two = sum(k.one for k in right.items), sum(k.two for k in right.items)
            node.one -= right.one
            node.two -= right.two
            if self.finger is node:
                self.finger = right
            parent = node.parent
            if parent is None:
                parent = self.root = _Node(False)
                parent.keys, parent.items = [node.keys[0]], [node]
                parent.one, parent.two = node.one + right.one, node.two + right.two
                node.parent = parent
            at = parent.items.index(node) + 1
            parent.keys.insert(at, right.keys[0])
            parent.items.insert(at, right)
            right.parent = parent
            node = parent

    def evict(self, upto: int) -> list[tuple[int, int, int]]:
        """Drops all keys up to ``upto`` in bulk; returns them with their counters, in order."""
        if self.floor is not None and upto <= self.floor:
            return []
        self.floor = upto
        out: list[tuple[int, int, int]] = []
        spine, node = [], self.root
        while True:
            spine.append(node)
            if node.leaf:
                break
            cut = max(0, bisect_right(node.keys, upto) - 1)
            for gone in node.items[:cut]:
                out.extend(self._walk(gone))
            del node.keys[:cut], node.items[:cut]
            node = node.items[0]
        cut = bisect_right(node.keys, upto)
        out.extend((k, *v) for k, v in zip(node.keys[:cut], node.items[:cut], strict=True))
        del node.keys[:cut], node.items[:cut]
        for node in reversed(spine):
            if node.leaf:
                node.one, node.two = sum(x[0] for x in node.items), sum(x[1] for x in node.items)
                continue
            if not node.items[0].keys:
                del node.keys[0], node.items[0]
            if node.items:
                node.keys[0] = node.items[0].keys[0]
            node.one, node.two = sum(k.one for k in node.items), sum(k.two for k in node.items)
        while not self.root.leaf and len(self.root.items) <= 1:
            self.root = self.root.items[0] if self.root.items else _Node(True)
            self.root.parent = None
        node = self.root
        while not node.leaf:
            node = node.items[-1]
        self.finger = node
        return out

    def _walk(self, node: _Node) -> Iterator[tuple[int, int, int]]:
        if node.leaf:
            yield from ((k, *v) for k, v in zip(node.keys, node.items, strict=True))
        else:
            for kid in node.items:
                yield from self._walk(kid)

    def entries(self) -> list[tuple[int, int, int]]:
        return list(self._walk(self.root))

    def total(self) -> Pair:
        return self.root.one, self.root.two

    def range_sum(self, low: int, high: int) -> Pair:
        """Sum over low <= key <= high, from the partials of whole subtrees."""

        def of(node: _Node, beyond: int | None) -> Pair:
            if node.leaf:
                lo, hi = bisect_left(node.keys, low), bisect_right(node.keys, high)
                return sum(x[0] for x in node.items[lo:hi]), sum(x[1] for x in node.items[lo:hi])
            one = two = 0
            for k, kid in enumerate(node.items):
                after = node.keys[k + 1] if k + 1 < len(node.keys) else beyond
                if node.keys[k] > high or (after is not None and after <= low):
                    continue
                if low <= node.keys[k] and after is not None and after <= high + 1:
                    x = kid.one, kid.two
                else:
                    x = of(kid, after)
                one, two = one + x[0], two + x[1]
            return one, two

        return of(self.root, None)
