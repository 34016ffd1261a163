"""The few left-to-right folds that arrays of small codes need.

Regular expressions and text assembly stay in the JVM; what crosses to Python is
one integer (or short label) per line or per sentence of a single document.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = T.ArrayType(T.IntegerType())


def _fields(**types) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


# Line events, one bit each.
PAGE, TICK, TILDE, BARE_OPEN, BARE_CLOSE = 1, 2, 4, 8, 16
BRACKET_OPEN, BRACKET_END, ODD_DOLLARS, BLANK, HEADING = 32, 64, 128, 256, 512
BRACKET_INLINE, DOLLAR_START, DOLLAR_PAIR, FENCE_PAIR = 1024, 2048, 4096, 8192
TABLE, THEOREM, PROOF = 16384, 32768, 65536

NO_PAGE = -1


def guarded_lines(events) -> list[bool]:
    """For each line, whether it starts inside an open code or formula fence."""
    fence, formula, guarded = 0, False, []
    for event in events:
        inside = bool(fence) or formula
        guarded.append(inside)
        if event & PAGE or (event & HEADING and not inside):
            continue
        ticks = event & (TICK | TILDE)
        if ticks:
            fence = ticks if not fence else (0 if fence == ticks else fence)
        elif not fence:
            if event & BARE_OPEN and not formula:
                formula = True
            elif event & BARE_CLOSE and formula:
                formula = False
            elif event & BRACKET_OPEN:
                formula = True
            elif event & BRACKET_END and formula:
                formula = False
            elif event & ODD_DOLLARS:
                formula = not formula
    return guarded


def _page_span(pages):
    known = [p for p in pages if p != NO_PAGE]
    return (min(known), max(known)) if known else (NO_PAGE, NO_PAGE)


def _intervals(parents: list[int]) -> tuple[list[int], list[int]]:
    """For each part its number on a walk down the tree, and the last number below it."""
    below, enters, leaves = [[] for _ in parents], [0] * len(parents), [0] * len(parents)
    for at in range(len(parents) - 1, -1, -1):
        if parents[at] >= 0:
            below[parents[at]].append(at)
    waiting, number = [at for at in range(len(parents) - 1, -1, -1) if parents[at] < 0], 0
    while waiting:
        at = waiting.pop()
        if at < 0:
            leaves[~at] = number - 1
            continue
        enters[at] = number
        number += 1
        waiting.append(~at)
        waiting.extend(below[at])
    return enters, leaves


def lay_out(events, pages, levels, numbers) -> dict:
    """Give every kept line to a section and every section its parent and pages.

    Part 0 is the text before the first heading.  Without headings, parts are the
    runs between page markers instead.
    """
    guarded = guarded_lines(events)
    heads = [i for i, e in enumerate(events) if e & HEADING and not guarded[i]]
    parts = [{"lines": [], "pages": [], "head": -1}]
    page, held = NO_PAGE, None
    for i, event in enumerate(events):
        marker = bool(event & PAGE)
        if marker:
            page = int(pages[i])
        if not heads:
            part = parts[-1]
            if marker and not guarded[i] and any(not events[j] & BLANK for j in part["lines"]):
                part = {"lines": [], "pages": [], "head": -1}
                parts.append(part)
            part["lines"].append(i)
            if marker:
                part["pages"].append(page)
            continue
        if marker and not guarded[i]:
            held = i
            continue
        if held is not None and event & BLANK:
            continue
        is_head = event & HEADING and not guarded[i]
        if is_head:
            parts.append({"lines": [], "pages": [page], "head": i})
        if held is not None:
            parts[-1]["lines"].append(held)
            parts[-1]["pages"].append(page)
            held = None
        if not is_head:
            parts[-1]["lines"].append(i)
            parts[-1]["pages"].append(page)
    if held is not None:
        parts[-1]["lines"].append(held)
        parts[-1]["pages"].append(page)
    if heads and not any(not events[j] & (BLANK | PAGE) for j in parts[0]["lines"]):
        parts.pop(0)
    if not heads and not any(not events[j] & BLANK for j in parts[-1]["lines"]):
        parts.pop()

    spans = []
    for part in parts:
        # A heading's own page counts only when its section has no text line.
        own = part["pages"][1:] if part["head"] >= 0 and part["lines"] else part["pages"]
        spans.append(list(_page_span(own)))
    trails, newest, open_heads = [], {}, []
    for at, part in enumerate(parts):
        up = -1
        if part["head"] >= 0:
            level, number = levels[part["head"]], numbers[part["head"]]
            while open_heads and levels[parts[open_heads[-1]]["head"]] >= level:
                open_heads.pop()
            up = open_heads[-1] if open_heads else -1
            if "." in number:
                up = newest.get(number.rpartition(".")[0], up)
            open_heads.append(at)
            if number:
                newest[number] = at
        trails.append((trails[up] if up >= 0 else []) + [at])
    enters, leaves = _intervals([t[-2] if len(t) > 1 else -1 for t in trails])
    for at in range(len(parts) - 1, -1, -1):
        if len(trails[at]) > 1:
            up = trails[at][-2]
            spans[up] = list(_page_span(spans[up] + spans[at]))
    return {
        "keep": [line for part in parts for line in part["lines"]],
        "starts": list(accumulate([0] + [len(part["lines"]) for part in parts]))[: len(parts)],
        "sizes": [len(part["lines"]) for part in parts],
        "heads": [part["head"] for part in parts],
        "trails": trails,
        "enters": enters,
        "leaves": leaves,
        "first_page": [s[0] for s in spans],
        "last_page": [s[1] for s in spans],
    }


@F.pandas_udf(
    _fields(keep=INTS, starts=INTS, sizes=INTS, heads=INTS, trails=T.ArrayType(INTS), enters=INTS, leaves=INTS, first_page=INTS, last_page=INTS)
)
def lay_out_lines(events: pd.Series, pages: pd.Series, levels: pd.Series, numbers: pd.Series) -> pd.DataFrame:
    rows = [lay_out(e.tolist(), p, lv, no) for e, p, lv, no in zip(events, pages, levels, numbers)]
    return pd.DataFrame(rows, columns=["keep", "starts", "sizes", "heads", "trails", "enters", "leaves", "first_page", "last_page"])


def find_blocks(events, pages, begins, ends) -> list[dict]:
    """Cut a section's lines into prose, table, code, formula and page blocks."""
    blocks: list[dict] = []
    page, open_block, closer = NO_PAGE, None, None

    def shut(atomic=None):
        nonlocal open_block, closer
        if open_block is not None:
            open_block["atomic"] = open_block["kind"] != "prose" if atomic is None else atomic
            blocks.append(open_block)
        open_block, closer = None, None

    def take(i, kind):
        nonlocal open_block
        if open_block is None:
            open_block = {"kind": kind, "first": i, "last": i, "pages": []}
        open_block["last"] = i
        open_block["pages"].append(page)

    for i, event in enumerate(events):
        if event & PAGE:
            page = int(pages[i])
            if closer is None:
                shut()
                blocks.append({"kind": "page", "first": i, "last": i, "pages": [page], "atomic": True})
                continue
        if closer is not None:
            take(i, open_block["kind"])
            if not event & PAGE:
                bit, name = closer
                if (event & bit if bit else name in ends[i].split()):
                    shut(True)
            continue
        fence = event & (TICK | TILDE)
        if fence:
            shut()
            take(i, "code")
            if event & FENCE_PAIR:
                shut(True)
            else:
                closer = (fence, "")
        elif begins[i] or event & (DOLLAR_START | BRACKET_OPEN | BARE_OPEN):
            shut()
            take(i, "math")
            if begins[i]:
                done, bit = begins[i] in ends[i].split(), 0
            elif event & BRACKET_OPEN:
                done, bit = event & BRACKET_INLINE, BRACKET_END
            elif event & BARE_OPEN:
                done, bit = False, BARE_CLOSE
            else:
                done, bit = event & DOLLAR_PAIR, ODD_DOLLARS
            if done:
                shut(True)
            else:
                closer = (bit, begins[i])
        elif event & BLANK:
            shut()
        else:
            kind = "table" if event & TABLE else "prose"
            if open_block is not None and open_block["kind"] != kind:
                shut()
            take(i, kind)
    shut(True if closer is not None else None)
    return blocks


def group_units(events, blocks) -> list[dict]:
    """Keep formulas, tables and code with the prose around them, proofs with theorems."""
    units: list[dict] = []
    carried: list[dict] = []

    def unit(members, kind, atomic):
        lo, hi = _page_span([p for b in members for p in b["pages"]])
        return {"kind": kind, "atomic": atomic, "first_page": lo, "last_page": hi, "pages": [lo, hi],
                "first": [f for b in members for f in _listed(b["first"])],
                "last": [x for b in members for x in _listed(b["last"])]}

    at = 0
    while at < len(blocks):
        block = blocks[at]
        following = blocks[at + 1] if at + 1 < len(blocks) else None
        at += 1
        if block["kind"] == "page":
            carried.append(block)
            continue
        members, carried = carried + [block], []
        if block["kind"] in ("math", "table", "code"):
            if units and units[-1]["kind"] == "prose":
                members.insert(0, units.pop())
            if following is not None and following["kind"] == "prose":
                members.append(following)
                at += 1
            units.append(unit(members, block["kind"], True))
        elif len(members) == 1 and events[block["first"]] & THEOREM:
            if following is not None and events[following["first"]] & PROOF:
                members.append(following)
                at += 1
            units.append(unit(members, "theorem", True))
        else:
            units.append(unit(members, block["kind"], block["atomic"]))
    if carried and units:
        last = units.pop()
        units.append(unit([last, *carried], last["kind"], True))
    elif carried:
        units.extend(unit([b], "page", True) for b in carried)
    return units


def _listed(value):
    return value if isinstance(value, list) else [value]


@F.pandas_udf(
    _fields(
        kind=T.ArrayType(T.StringType()),
        atomic=T.ArrayType(T.BooleanType()),
        first_page=INTS,
        last_page=INTS,
        first=T.ArrayType(INTS),
        last=T.ArrayType(INTS),
    )
)
def unit_spans(events: pd.Series, pages: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    names = ["kind", "atomic", "first_page", "last_page", "first", "last"]
    rows = []
    for e, p, b, x in zip(events, pages, begins, ends):
        codes = e.tolist()
        units = group_units(codes, find_blocks(codes, p, b, x))
        rows.append([[u[name] for u in units] for name in names])
    return pd.DataFrame(rows, columns=names)


def pack(counts, walls, close_at: int, limit: int, floor: int = 0) -> list[int]:
    """Group number of each item: a group never passes ``limit`` and closes at ``close_at``.

    A change in ``walls`` also starts a group.  A last group under ``floor`` joins
    the one before it when both fit.
    """
    groups, sums, total, shut = [], [], 0, True
    for at, count in enumerate(counts):
        if shut or total + count > limit or (at and walls[at] != walls[at - 1]):
            sums.append(0)
            total = 0
        total += count
        sums[-1] = total
        groups.append(len(sums) - 1)
        shut = total >= close_at
    if len(sums) > 1 and sums[-1] < floor and sums[-2] + sums[-1] <= limit:
        groups = [min(g, len(sums) - 2) for g in groups]
    return groups


def packer(close_at: int, limit: int, floor: int):
    @F.pandas_udf(INTS)
    def pack_counts(counts: pd.Series) -> pd.Series:
        return pd.Series([pack(c.tolist(), [0] * len(c), close_at, limit, floor) for c in counts])

    return pack_counts


def nested_packer(limit: int):
    @F.pandas_udf(T.ArrayType(INTS))
    def pack_each(counts: pd.Series, walls: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if c is None else [pack(x.tolist(), w.tolist(), limit + 1, limit) for x, w in zip(c, ws)]
                for c, ws in zip(counts, walls)
            ]
        )

    return pack_each


# The token and page-marker patterns of functions/text.py in Python form.
_COUNTED = re.compile(r"(<!--\s*page\s*:\s*\d+\s*-->)|\w+|[^\w\s]", re.I)


def bounded_pieces(text: str, limit: int) -> list[str]:
    """Cut an oversized text after every ``limit`` tokens, at a blank where one is near."""
    pieces = []
    while text:
        starts = (m.start() for m in _COUNTED.finditer(text) if not m.group(1))
        cut = next((s for n, s in enumerate(starts) if n == limit), None)
        if cut is None:
            pieces.append(text)
            break
        blank = max(text.rfind(c, 0, cut + 1) for c in "\n \t")
        if blank >= max(1, cut // 2):
            cut = blank + 1
        cut = max(cut, 1)
        pieces.append(text[:cut].rstrip() or text[:cut])
        text = text[cut:].lstrip()
    return pieces


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def bounded_texts(texts: pd.Series, limits: pd.Series) -> pd.Series:
    """Pieces for the texts that are too long; null where nothing must be cut."""
    return pd.Series(
        [
            None if ts is None else [None if t is None else bounded_pieces(t, int(n)) for t, n in zip(ts, ns)]
            for ts, ns in zip(texts, limits)
        ]
    )
