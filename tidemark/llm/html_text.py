"""Main text of web pages by minimum-cut labelling of their blocks.

A linear classifier over a block's place and shape gives its cost of either label; the costs are terminal capacities.
Blocks that follow each other, and blocks that follow each other within one parent, are tied by smoothness edges that
are the stronger the nearer they are in the DOM.  The minimum cut (maximum flow) separates content from boilerplate:
short lines amid an article stay with it, and a stray long block amid menus goes with them, unless the markup is plain.

Nodes whose own cost exceeds all their edges cannot be flipped by any cut and are settled first; augmenting paths
are then sought among the rest, which makes the flow exact at little cost on usual pages.

Scale: one scan, page by page, no shuffle; a page's graph has a few edges a block.

Defined cases: null, empty and textless pages give the empty text; broken markup is read as far as it goes (an element
that is not closed ends with its parent; a comment, script or tag that is not closed ends the page; a quote opens a value only
after an equals sign, and one that is never closed is part of the value); repeated rows are read each; an empty table gives no row;
a page of any length and nesting is read in time that grows with its length; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .html_blocks import Block, Element, blocks

#: Weights of the classifier, in units of capacity.
SURE, INSIDE, OUTSIDE, WORDS, LINKS, HEADING, SENTENCE = 400, 80, -80, 2, -100, 15, 12
ADJACENT, SIBLING = 8, 16


def cost(block: Block, has_container: bool) -> int:
    """Above zero: how much it speaks for content; below: for boilerplate."""
    if block.element.boiler:
        return -SURE
    score = (INSIDE if block.element.content else OUTSIDE) if has_container else -3
    score += min(block.text.count(" ") + 1, 40) * WORDS
    score += round(LINKS * block.linked / len(block.text))
    score += HEADING * (block.kind in ("h1", "h2", "h3", "h4", "h5", "h6"))
    return score + SENTENCE * (block.text[-1] in ".!?…。！？:;\"'”’»)")


def _meet(a: Element, b: Element) -> int:
    """Steps between two elements in the DOM."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity)."""
    edges, last = [], {}
    for i, block in enumerate(found):
        parent = id(block.element.parent or block.element)
        if i:
            edges.append((i - 1, i, max(1, SIBLING - 3 * _meet(found[i - 1].element, block.element))))
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, ADJACENT))
        last[parent] = i
    return edges


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's (content) side of a minimum cut."""
    n = len(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    side: list[bool | None] = [None] * n
    spare = list(costs)
    ready = deque(range(n))
    while ready:  # settle what no cut can flip; its edges become terminal capacities of the neighbours
        i = ready.popleft()
        if side[i] is None and abs(spare[i]) >= sum(near[i].values()):
            side[i] = spare[i] > 0
            for j, c in near[i].items():
                spare[j] += c if side[i] else -c
                del near[j][i]
                if side[j] is None:
                    ready.append(j)
            near[i] = {}
    room = {i: dict(near[i]) for i in range(n) if side[i] is None}
    for own in _connected(room):
        for i in _augment(own, spare, room):
            side[i] = True
    return [bool(x) for x in side]


def _connected(room: dict[int, dict[int, int]]) -> Iterator[list[int]]:
    """The parts of a graph that no edge connects."""
    seen: set[int] = set()
    for first in room:
        if first not in seen:
            seen.add(first)
            part = [first]
            for i in part:  # grows meanwhile
                part += (fresh := [j for j in room[i] if j not in seen])
                seen.update(fresh)
            yield part


def _augment(own: list[int], spare: list[int], room: dict[int, dict[int, int]]) -> Iterable[int]:
    """The source's side of a minimum cut of one part, by shortest augmenting paths."""
    sources = [i for i in own if spare[i] > 0]
    while True:
        reached: dict[int, int | None] = {i: None for i in sources if spare[i] > 0}
        queue, goal = deque(reached), None
        while queue and goal is None:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 0 and j not in reached:
                    reached[j] = i
                    if spare[j] < 0:
                        goal = j
                        break
                    queue.append(j)
        if goal is None:
            return reached
        path = [goal]
        while reached[path[-1]] is not None:
            path.append(reached[path[-1]])
        path.reverse()
        flow = min(spare[path[0]], -spare[goal], *(room[a][b] for a, b in zip(path, path[1:])))
        spare[path[0]] -= flow
        spare[goal] += flow
        for a, b in zip(path, path[1:]):
            room[a][b] -= flow
            room[b][a] += flow


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    has_container = any(b.element.content and not b.element.boiler for b in found)
    keep = minimum_cut([cost(b, has_container) for b in found], ties(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "html", 8 << 20):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
