"""Layout recovery of a page: lines that no block holds are grouped, typed and attached or appended; lines of a block
that stand in columns are put in column order. A page's lines are few, so a page is one group."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CAPTION, FURNITURE
from ..sources.synthetic import PAGE

_WS = re.compile(r"[ \t\n\x0b\f\r]+")
_marker = re.compile(r"^[-*+]|^[0-9]+[ \t]*[.):-]")


@dataclass
class Line:
    index: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float

    w = property(lambda s: max(0.0, s.x1 - s.x0))
    h = property(lambda s: max(0.0, s.y1 - s.y0))
    cx = property(lambda s: (s.x0 + s.x1) / 2)
    cy = property(lambda s: (s.y0 + s.y1) / 2)


@dataclass
class Block:
    id: str
    type: str
    x0: float
    y0: float
    x1: float
    y1: float
    lines: list[int] = field(default_factory=list)
    confidence: float = 1.0
    label: str = ""
    index: int = -1

    w, h, cx, cy = Line.w, Line.h, Line.cx, Line.cy


def seen(text: str) -> int:
    return len(_WS.sub("", text).encode())


def page_marker(text: str) -> bool:
    t = _WS.sub("", text)
    if not 1 <= len(t) <= 16 or not re.fullmatch(r"[0-9A-Za-z/|().:-]+", t):
        return False
    digits, letters = sum(c.isdigit() for c in t), [c for c in t if c.isalpha()]
    return digits > 0 and len(letters) <= 4 or digits == 0 and bool(letters) and all(c in "ivxlcdmIVXLCDM" for c in letters)


def strong_furniture(text: str) -> bool:
    return bool(re.search(FURNITURE, text.lower())) or page_marker(text)


def is_caption(text: str) -> bool:
    return bool(re.match(CAPTION, text.lower()))


def overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0))


def share(a, b) -> float:
    """The share of a's area in b."""
    area = a.w * a.h
    return overlap(a.x0, a.x1, b.x0, b.x1) * overlap(a.y0, a.y1, b.y0, b.y1) / area if area > 0 else 0.0


def inside(a, b) -> bool:
    return b.x0 <= a.cx <= b.x1 and b.y0 <= a.cy <= b.y1


def box_of(lines: list[Line]) -> tuple[float, float, float, float]:
    return min(x.x0 for x in lines), min(x.y0 for x in lines), max(x.x1 for x in lines), max(x.y1 for x in lines)


def marginalia(lines: list[Line], mh: float, width: float, height: float) -> set[int]:
    """Indices of line numbers in a margin: columns of four or more narrow numbers, mostly ascending, evenly spaced."""
    marks = sorted((x for x in lines if re.fullmatch("[0-9]{1,4}", _WS.sub(" ", x.text).strip()) and x.w <= max(0.05 * width, 5 * mh)), key=lambda x: (x.cx, x.index))
    groups: list[list[Line]] = []
    for x in marks:
        best = min(groups, key=lambda g: abs(x.cx - sum(y.cx for y in g) / len(g)), default=None)
        if best is not None and abs(x.cx - sum(y.cx for y in best) / len(best)) <= max(4.0, 1.25 * mh, 0.008 * width):
            best.append(x)
        else:
            groups.append([x])
    out: set[int] = set()
    for g in groups:
        if len(g) < 4:
            continue
        g.sort(key=lambda x: x.cy)
        if g[-1].cy - g[0].cy < max(0.25 * height, 12 * mh):
            continue
        values = [int(x.text.strip()) for x in g]
        steps = [b - a for a, b in zip(values, values[1:])]
        up = sum(s > 0 for s in steps) >= sum(s < 0 for s in steps)
        along = [s if up else -s for s in steps if (s > 0) == up and s != 0]
        if len(along) < math.ceil(0.8 * len(steps)):
            continue
        typical = median(along)
        if sum(0.45 * typical <= s <= 2.25 * typical for s in along) >= math.ceil(0.75 * len(steps)):
            out |= {x.index for x in g}
    return out


def fits(a: Line, b: Line) -> bool:
    """Whether line b may follow line a in a group."""
    h = max(a.h, b.h)
    low = min(a.h, b.h)
    if low > 0 and overlap(a.y0, a.y1, b.y0, b.y1) / low >= 0.5 and max(0.0, b.x0 - a.x1, a.x0 - b.x1) <= 0.75 * h:
        return True
    narrow = min(a.w, b.w)
    return -0.25 * h <= b.y0 - a.y1 <= 1.60 * h and (narrow > 0 and overlap(a.x0, a.x1, b.x0, b.x1) / narrow >= 0.25 or abs(a.x0 - b.x0) <= 2.5 * h)


def row_wise(lines: list[Line]) -> list[Line]:
    """By rows (vertical overlap of half the lower line), inside a row by x."""
    rows: list[list[Line]] = []
    for x in sorted(lines, key=lambda x: (x.y0, x.x0, x.index)):
        if rows and overlap(rows[-1][0].y0, rows[-1][0].y1, x.y0, x.y1) >= 0.5 * max(1e-9, min(rows[-1][0].h, x.h)):
            rows[-1].append(x)
        else:
            rows.append([x])
    return [x for r in rows for x in sorted(r, key=lambda x: (x.x0, x.index))]


def group_lines(lines: list[Line]) -> list[list[Line]]:
    groups: list[list[Line]] = []
    for x in sorted(lines, key=lambda x: (x.y0, x.x0, x.index)):
        best, cost = None, math.inf
        for g in groups:
            if fits(g[-1], x) and (c := max(0.0, x.y0 - g[-1].y1) + 0.10 * abs(x.x0 - g[-1].x0)) < cost:
                best, cost = g, c
        if best is None:
            groups.append([x])
        else:
            best.append(x)
    return [row_wise(g) for g in groups]


def _aligned(values: list[float], tol: float) -> int:
    """Number of clusters of two values or more; a value joins while it lies within the tolerance of the cluster's mean."""
    count, cluster = 0, []
    for value in [*sorted(values), math.inf]:
        if cluster and value - sum(cluster) / len(cluster) > tol:
            count += len(cluster) > 1
            cluster = []
        cluster.append(value)
    return count


def merge_grids(groups: list[list[Line]], mh: float, width: float, height: float) -> tuple[list[list[Line]], set[int]]:
    """Six or more small groups that stand in rows and columns become one; its place in the result is returned too."""
    grids: list[list[Line]] = []
    while len(groups) >= 6 and mh > 0:
        rt, ct = max(1.5 * mh, 0.012 * height), max(2.5 * mh, 0.025 * width)
        boxes = [Block("", "", *box_of(g)) for g in groups]
        small = [i for i, (g, b) in enumerate(zip(groups, boxes)) if not any(g is x for x in grids) and len(g) <= 3 and b.w <= 0.45 * width and b.h <= max(3.25 * mh, 0.06 * height)]

        def beside(a: Block, b: Block) -> bool:
            gx, gy = max(0.0, a.x0 - b.x1, b.x0 - a.x1), max(0.0, a.y0 - b.y1, b.y0 - a.y1)
            return abs(a.cy - b.cy) <= rt and gx <= 0.35 * width or abs(a.x0 - b.x0) <= ct and gy <= max(8 * mh, 0.18 * height)

        left, chosen = set(small), None
        for start in small:
            if start not in left:
                continue
            part, queue = {start}, [start]
            while queue:
                i = queue.pop()
                for j in small:
                    if j not in part and beside(boxes[i], boxes[j]):
                        part.add(j)
                        queue.append(j)
            left -= part
            if len(part) >= 6 and _aligned([boxes[i].cy for i in part], rt) >= 2 and _aligned([boxes[i].x0 for i in part], ct) >= 2:
                chosen = part
                break
        if not chosen:
            break
        hull = Block("", "", *box_of([x for i in chosen for x in groups[i]]))
        hull = Block("", "", hull.x0 - 2 * mh, hull.y0 - 2 * mh, hull.x1 + 2 * mh, hull.y1 + 2 * mh)
        chosen |= {i for i, (g, b) in enumerate(zip(groups, boxes)) if not any(g is x for x in grids) and len(g) <= 4 and b.h <= 6 * mh and inside(b, hull)}
        grid = row_wise([x for i in sorted(chosen) for x in groups[i]])
        at = min(chosen)
        groups = [grid if i == at else g for i, g in enumerate(groups) if i == at or i not in chosen]
        grids.append(grid)
    return groups, {i for i, g in enumerate(groups) if any(g is x for x in grids)}


def group_type(g: list[Line], mh: float, height: float, body: list[Line]) -> str:
    x0, y0, x1, y1 = box_of(g)
    centre, text = (y0 + y1) / 2 / height, "\n".join(x.text for x in g)
    top, bottom = centre <= 0.15, centre >= 0.88
    if not (top or bottom) or is_caption(text):
        return "text"
    if not strong_furniture(text):
        if len(g) >= 4 and seen(text) >= 100:
            return "text"
        b = Block("", "", x0, y0, x1, y1)
        for o in body:  # goes on from a line of the body
            wide, narrow = max(b.w, o.w), min(b.w, o.w)
            if narrow > 0 and wide / narrow <= 1.25 and overlap(b.x0, b.x1, o.x0, o.x1) / narrow >= 0.5 and max(0.0, b.y0 - o.y1, o.y0 - b.y1) <= mh:
                return "text"
        if top and centre > 0.05:
            heading = len(g) <= 2 and seen(text) >= 8 and median([x.h for x in g]) >= 1.75 * mh
            first = g[0].text
            kicker = 2 <= len(g) <= 3 and seen(first) <= 32 and len(re.findall("[A-Z]", first)) >= 3 and not re.search("[a-z]", first) and len(re.findall("[a-z]", g[1].text)) >= 3
            if heading or kicker:
                return "text"
    return "header" if top else "footer"


def attach_to(g: list[Line], mh: float, width: float, blocks: list[Block]) -> Block | None:
    """The body block that a small group continues."""
    x0, y0, x1, y1 = box_of(g)
    b, text = Block("", "", x0, y0, x1, y1), "\n".join(x.text for x in g)
    if len(g) > 2 or b.h > 2.25 * mh or page_marker(text) or is_caption(text) or seen(text) < 4 or b.w < max(5 * mh, 0.06 * width):
        return None
    dist = lambda o: math.hypot(max(0.0, b.x0 - o.x1, o.x0 - b.x1), max(0.0, b.y0 - o.y1, o.y0 - b.y1))
    if any(o.type in ("figure", "table") and dist(o) <= mh for o in blocks):
        return None
    best, cost = None, math.inf
    for o in blocks:
        if o.type not in ("title", "text", "list", "unknown") or o.type == "title" and _marker.match(text.lstrip(" \t\r\n")):
            continue
        narrow, gap = min(b.w, o.w), max(0.0, b.y0 - o.y1, o.y0 - b.y1)
        if narrow > 0 and overlap(b.x0, b.x1, o.x0, o.x1) / narrow >= 0.60 and gap <= 1.25 * mh and (c := gap + 0.05 * abs(b.x0 - o.x0)) < cost:
            best, cost = o, c
    return best


def recover(lines: list[Line], blocks: list[Block], page_number: int, width: float, height: float) -> tuple[list[Block], set[int]]:
    """Blocks after recovery, and the lines that were left out as marginal numbers. Running it again changes nothing."""
    by = {x.index: x for x in lines}
    visible = [x for x in lines if seen(x.text) and x.w > 0 and x.h > 0]
    mh = median([x.h for x in visible]) if visible else 0.0
    held = {i for b in blocks for i in b.lines}
    edges = [b for b in blocks if b.type in ("header", "footer")]
    free = [x for x in visible if x.index not in held and not any(share(x, b) >= 0.10 or inside(x, b) for b in edges)]
    margin = marginalia(free, mh, width, height)
    groups, grids = merge_grids(group_lines([x for x in free if x.index not in margin]), mh, width, height)
    body = [by[i] for b in blocks if b.type in ("text", "list", "title", "unknown") for i in b.lines if i in by]
    kinds = ["text" if i in grids else group_type(g, mh, height, body) for i, g in enumerate(groups)]
    fresh: list[Block] = []
    for kind in ("text", "header", "footer"):
        for i, g in enumerate(groups):
            if kinds[i] != kind:
                continue
            o = attach_to(g, mh, width, [b for b in blocks if b not in fresh]) if kind == "text" and i not in grids else None
            x0, y0, x1, y1 = box_of(g)
            if o is not None:
                o.x0, o.y0, o.x1, o.y1 = min(o.x0, x0), min(o.y0, y0), max(o.x1, x1), max(o.y1, y1)
                o.lines += [x.index for x in g]
            else:
                label = "text_grid_fallback" if i in grids else "text_fallback"
                fresh.append(Block(f"page_{page_number}_fallback_line_{min(x.index for x in g) + 1}", kind, x0, y0, x1, y1, [x.index for x in g], 0.35 if kind == "text" else 0.25, label))
    out = blocks + fresh
    for b in out:
        if b.label != "text_grid_fallback":
            b.lines = column_lines(b, [by[i] for i in b.lines if i in by])
    return out, margin


def column_lines(block: Block, lines: list[Line]) -> list[int]:
    """The block's lines column by column if they stand in two to four columns, else as they are."""
    same = [x.index for x in lines]
    if block.type not in ("unknown", "text", "list") or len(lines) < 4:
        return same
    mw, mh = median([x.w for x in lines]), median([x.h for x in lines])
    if any(x.w > 1.35 * mw for x in lines):
        return same
    cols: list[list[Line]] = []
    for x in sorted(lines, key=lambda x: (x.x0, x.y0, x.index)):
        best, most = None, 0.0
        for c in cols:
            l, r = min(y.x0 for y in c), max(y.x1 for y in c)
            narrow = min(x.w, r - l)
            o = overlap(x.x0, x.x1, l, r) / narrow if narrow > 0 else 0.0
            if o >= 0.5 and o > most:
                best, most = c, o
        if best is None:
            cols.append([x])
        else:
            best.append(x)
    if not 2 <= len(cols) <= 4 or any(len(c) < 2 for c in cols):
        return same
    cols.sort(key=lambda c: min(x.x0 for x in c))
    for a, b in zip(cols, cols[1:]):
        ay, by = (min(x.y0 for x in a), max(x.y1 for x in a)), (min(x.y0 for x in b), max(x.y1 for x in b))
        if min(x.x0 for x in b) - max(x.x1 for x in a) <= 0.75 * mh or overlap(*ay, *by) < 0.25 * min(ay[1] - ay[0], by[1] - by[0]):
            return same
    return [x.index for c in cols for x in sorted(c, key=lambda x: (x.y0, x.x0, x.index))]


RECOVERED = "doc_id long, page_index int, block_index int, block_id string, type string, label string, x0 double, y0 double, x1 double, y1 double, confidence double, lines array<int>"


def recover_layout(lines: DataFrame, blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Applies ``recover`` to every page. lines: keys, line_index, text, box; blocks: keys, block_index, type, box,
    confidence, lines (array of line_index)."""
    a = lines.groupBy(*PAGE).agg(F.collect_list(F.struct("line_index", "text", "x0", "y0", "x1", "y1")).alias("l"))
    b = blocks.groupBy(*PAGE).agg(F.collect_list(F.struct("block_index", "type", "x0", "y0", "x1", "y1", "confidence", "lines")).alias("b"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ls = [Line(int(x["line_index"]), x["text"] or "", x["x0"], x["y0"], x["x1"], x["y1"]) for x in sorted(r.l, key=lambda x: x["line_index"])]
                bs = [Block(f"page_{r.page_index + 1}_block_{x['block_index'] + 1}", x["type"], x["x0"], x["y0"], x["x1"], x["y1"], [int(i) for i in x["lines"]], x["confidence"], "", int(x["block_index"])) for x in sorted(r.b if r.b is not None else [], key=lambda x: x["block_index"])]
                out, _ = recover(ls, bs, r.page_index + 1, width, height)
                rows += [(r.doc_id, r.page_index, i, o.id, o.type, o.label, o.x0, o.y0, o.x1, o.y1, o.confidence, o.lines) for i, o in enumerate(out)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECOVERED.split(", ")])

    return a.join(b, PAGE, "left").mapInPandas(run, RECOVERED)
