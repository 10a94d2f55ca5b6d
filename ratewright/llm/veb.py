"""Van Emde Boas layout of complete trees: addresses by arithmetic, without pointers.

A tree of some levels is cut at half its levels: the top tree comes first, then the subtrees below it from left to right,
each laid out by the same rule. So a walk from a leaf to the root touches few regions, whatever size a cache's lines have.
A node is named by its depth below the root and its number within that depth.
"""

from __future__ import annotations

from collections.abc import Callable

ARITY = 3


def tree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def levels_of_size(size: int) -> int:
    levels = 1
    while tree_size(levels) < size:
        levels += 1
    return levels


def address(levels: int, depth: int, number: int) -> int:
    """The place of a node in the layout of a complete tree."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            below = levels - top
            subtree, number = divmod(number, ARITY ** (depth - top))
            at += tree_size(top) + subtree * tree_size(below)
            levels, depth = below, depth - top
    return at


def fill(levels: int, leaves: list[bytes], join: Callable[[list[bytes]], bytes]) -> list[bytes | None]:
    """The layout of the tree over `leaves`, None where a tree with so few leaves has no node.

    The subtrees under the cut are filled first, each into its own stretch; the parents of their roots are the leaves of
    the top tree.
    """
    places: list[bytes | None] = [None] * tree_size(levels)

    def build(at: int, levels: int, leaves: list[bytes]) -> None:
        if levels == 1:
            places[at] = leaves[0]
            return
        top = levels // 2
        below = levels - top
        width, size, first = ARITY ** (below - 1), tree_size(below), at + tree_size(top)
        roots = []
        for i, start in enumerate(range(0, len(leaves), width)):
            build(first + i * size, below, leaves[start : start + width])
            roots.append(places[first + i * size])
        build(at, top, [join(roots[i : i + ARITY]) for i in range(0, len(roots), ARITY)])

    build(0, levels, leaves)
    return places


def siblings(places: list[bytes | None], levels: int, leaf: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For a leaf and each of its ancestors below the root: the nodes of its run to the left and to the right."""
    found = []
    for depth in range(levels - 1, 0, -1):
        first = leaf - leaf % ARITY
        run = [places[address(levels, depth, first + i)] for i in range(ARITY)]
        own = leaf - first
        found.append(([n for n in run[:own] if n is not None], [n for n in run[own + 1 :] if n is not None]))
        leaf //= ARITY
    return found
