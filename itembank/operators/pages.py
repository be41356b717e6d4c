"""Pages as flat arrays: the rules of page layout over many pages at once.

The items of all pages of a block lie one after the other, in the order of their numbers within a page.
Every rule is a few operations on whole arrays, so the work of an item does not pass through Python;
sums run in the order of the items, so results do not depend on how pages are put into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --- fixed values: tolerances ---------------------------------------------------------------------
ROW_TOLERANCE, VOTE_TOLERANCE = 1.5, 2.0
MIN_ITEMS, MIN_SIDE = 30, 10
#: Items of whole pages that are taken at a time.
BLOCK_ITEMS = 1 << 17
#: Groups whose rows are searched together: their baselines stay in the cache.
ROW_GROUPS = 512

_WHITE = r"[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_WHITE_FIRST, _WHITE_LAST = "^" + _WHITE, _WHITE + r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z"


def floats(values: pa.Array) -> np.ndarray:
    """Numbers, with NaN for null."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def changes(values: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal."""
    out = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        a, b = values[1:], values[:-1]
        null = pc.xor(a.is_null(), b.is_null())
        out[1:] = pc.or_(null, pc.fill_null(pc.not_equal(a, b), False)).to_numpy(zero_copy_only=False)
    return out


def _positive(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and whether they are above zero, as Spark compares: NaN is, null is not."""
    v = floats(values)
    return v, values.is_valid().to_numpy(zero_copy_only=False) & ~(v <= 0)


def row_numbers(ys: np.ndarray, starts: np.ndarray, tolerance: float, moving: bool) -> np.ndarray:
    """The row of every item within its group, numbered from the top; ``starts`` has the bounds of the groups.

    A moving baseline is the mean of the row's items, and an item joins the nearest row within the
    tolerance; a fixed one is that of the row's first item, and an item joins the oldest row within
    the tolerance. An item on the baseline of the one before it joins the same row, so the items of
    a run are taken together; the groups go side by side, run by run.
    """
    out = np.zeros(len(ys), dtype="int32")
    if not len(ys):
        return out
    opens = np.ones(len(ys), dtype=bool)
    opens[1:] = ys[1:] != ys[:-1]
    opens[starts[:-1][starts[1:] > starts[:-1]]] = True
    heads = np.flatnonzero(opens)
    lengths = np.diff(np.append(heads, len(ys)))
    first = np.searchsorted(heads, starts)
    runs = np.diff(first)
    rows = np.zeros(len(heads), dtype="int32")
    by_size = np.argsort(-runs, kind="stable")
    for at in range(0, len(by_size), ROW_GROUPS):
        groups = by_size[at : at + ROW_GROUPS]
        _search(ys[heads], lengths, first[groups], runs[groups], rows, tolerance, moving)
    out[:] = np.repeat(rows, lengths)
    return out


def _search(ys, lengths, first, runs, rows, tolerance, moving) -> None:
    """Rows of the runs of some groups, those of most runs first, side by side."""
    n, wide = len(first), 16
    base, size = np.full((n, wide), np.inf), np.zeros((n, wide))
    made = np.zeros(n, dtype="int64")
    for k in range(int(runs[0])):
        live = int(np.searchsorted(-runs, -k, side="left"))
        used = int(made[:live].max())
        if used == wide:
            wide *= 2
            base, size = (np.concatenate([m, np.full((n, wide // 2), fill)], axis=1) for m, fill in ((base, np.inf), (size, 0.0)))
        at = first[:live] + k
        y, count, each = ys[at], lengths[at], np.arange(live)
        far = np.abs(base[:live, : used + 1] - y[:, None])
        # rows stand in the order they were made, so of equally good ones the oldest is found
        row = far.argmin(axis=1) if moving else (far <= tolerance).argmax(axis=1)
        joins = far[each, row] <= tolerance
        row[~joins] = made[:live][~joins]
        fresh = each[~joins]
        base[fresh, row[fresh]] = y[fresh]
        made[fresh] += 1
        if moving:
            size[fresh, row[fresh]] = count[fresh]
            g = each[joins]
            b, c, left, target = base[g, row[g]], size[g, row[g]], count[g].copy(), y[g]
            while True:
                step = left > 0
                if not step.any():
                    break
                still = step & (b == target)
                c[still] += left[still]
                left[still] = 0
                step &= ~still
                c[step] += 1
                b[step] += (target[step] - b[step]) / c[step]
                left[step] -= 1
            base[g, row[g]], size[g, row[g]] = b, c
        rows[at] = row
    # from the order of making to the order on the page, the highest baseline first
    used = int(made.max())
    low = np.where(np.isinf(base[:, :used]), -np.inf, base[:, :used])
    order = np.argsort(-low, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(1, used + 1), order.shape), axis=1)
    of = np.repeat(np.arange(n), runs)
    at = np.repeat(first - np.append(0, np.cumsum(runs)[:-1]), runs) + np.arange(len(of))
    rows[at] = place[of, rows[at]]


class Block:
    """Whole pages: ``starts`` has the bounds of each, and their items follow in order."""

    def __init__(self, starts: np.ndarray, numbers: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array) -> None:
        self.starts, self.n = starts, np.diff(starts)
        self.pages = len(self.n)
        self.page = np.repeat(np.arange(self.pages), self.n)
        self.x, self.y = floats(x), floats(y)
        self.w, self.wide = _positive(w)
        #: items of one number share it
        self.number = np.cumsum(changes(numbers))
        self.right = self.x + np.where(self.wide, self.w, 0.0)
        self.min_x, extent = np.zeros(self.pages), np.zeros(self.pages)
        some = np.flatnonzero(self.n)
        if len(some):
            self.min_x[some] = np.minimum.reduceat(self.x, starts[some])
            extent[some] = np.maximum.reduceat(self.right, starts[some]) - self.min_x[some]
        #: pages too small to have text columns have no width
        self.framed = (self.n >= MIN_ITEMS) & ~(extent <= 0)
        self.width = np.where(self.framed, extent, np.nan)

    def per_page(self, weights: np.ndarray) -> np.ndarray:
        """Sums by page, in the order of the items."""
        return np.bincount(self.page, weights=weights, minlength=self.pages)

    def only(self, which: np.ndarray) -> Block:
        """The items of some pages; the others are empty."""
        out, keep = object.__new__(Block), which[self.page]
        out.n = np.where(which, self.n, 0)
        out.starts, out.pages, out.page = np.append(0, np.cumsum(out.n)), self.pages, self.page[keep]
        for name in ("x", "y", "w", "wide", "number", "right"):
            setattr(out, name, getattr(self, name)[keep])
        out.min_x, out.framed, out.width = self.min_x, self.framed & which, np.where(which, self.width, np.nan)
        return out

    def two_means(self) -> np.ndarray:
        """A split by two means of the item centres, at most twelve rounds, with its guards, or NaN."""
        b, split = self.only(self.framed), np.full(self.pages, np.nan)
        if not len(b.x):
            return split
        centre = (b.x + b.right) / 2
        cs, has = centre[np.lexsort((centre, b.page))], b.n > 0
        total, lo, hi = b.per_page(cs), np.zeros(b.pages), np.zeros(b.pages)
        lo[has], hi[has] = cs[b.starts[:-1][has]], cs[b.starts[1:][has] - 1]
        ok = hi > lo
        done = ~ok
        for _ in range(12):
            if done.all():
                break
            low = cs <= ((lo + hi) / 2)[b.page]
            n, sums = b.per_page(low), b.per_page(np.where(low, cs, 0.0))
            stop = ~done & ((n == 0) | (n == b.n))
            ok &= ~stop
            move = ~done & ~stop
            with np.errstate(all="ignore"):
                left, right = sums / n, (total - sums) / (b.n - n)
            near = (np.abs(left - lo) < 0.5) & (np.abs(right - hi) < 0.5)
            lo, hi = np.where(move, left, lo), np.where(move, right, hi)
            done = done | stop | (move & near)
        mid = b.per_page((cs >= (lo + (hi - lo) * 0.25)[b.page]) & (cs <= (lo + (hi - lo) * 0.75)[b.page]))
        left = b.per_page(cs < ((lo + hi) / 2)[b.page])
        good = (
            ok & (hi - lo >= np.fmax(b.width * 0.25, 60.0)) & (mid <= b.n * 0.12) & (left >= b.n * 0.15)
            & (b.n - left >= b.n * 0.15)
        )
        split[good] = ((lo + hi) / 2)[good]
        return split

    def blank_band(self) -> np.ndarray:
        """A split at the widest empty band of the middle of the page, of a hundred bins, or NaN."""
        b, split = self.only(self.framed), np.full(self.pages, np.nan)
        if not len(b.x):
            return split
        base, width = b.min_x[b.page], b.width[b.page]
        first = np.maximum(0, np.floor((b.x - base) / width * 100)).astype("int64")
        last = np.minimum(99, np.ceil((b.right - base) / width * 100) - 1).astype("int64")
        real = last >= first
        edges = b.page[real] * 101
        delta = np.bincount(edges + first[real], minlength=b.pages * 101) - np.bincount(edges + last[real] + 1, minlength=b.pages * 101)
        free = delta.reshape(b.pages, 101).cumsum(axis=1) == 0
        since, best, longest = np.full(b.pages, -1), np.full(b.pages, -1), np.zeros(b.pages, dtype="int64")
        for i in range(30, 71):
            since = np.where(free[:, i], np.where(since < 0, i, since), -1)
            better = free[:, i] & (i - since + 1 > longest)
            best, longest = np.where(better, since, best), np.where(better, i - since + 1, longest)
        good = b.framed & (longest >= 3)
        split[good] = (b.min_x + ((best + longest / 2) / 100) * b.width)[good]
        return split

    def gap_vote(self) -> np.ndarray:
        """A split where the widest gaps of most rows agree, of twenty bins, or NaN. A row keeps the baseline of its first item."""
        b, split = self.only(self.framed), np.full(self.pages, np.nan)
        if not len(b.x):
            return split
        row = row_numbers(b.y, b.starts, VOTE_TOLERANCE, moving=False)
        o = np.lexsort((b.right, b.number, b.x, row, b.page))
        page, row_o, x, right = b.page[o], row[o], b.x[o], b.right[o]
        same = (page[1:] == page[:-1]) & (row_o[1:] == row_o[:-1])
        page, line, x, last = page[1:][same], row_o[1:][same], x[1:][same], right[:-1][same]
        wide = -(last - x) >= np.fmax(8.0, b.width[page] * 0.015)
        page, line, x, last = page[wide], line[wide], x[wide], last[wide]
        mid = (x + last) / 2
        o = np.lexsort((mid, x, last - x, line, page))
        page, line, mid = page[o], line[o], mid[o]
        top = np.ones(len(page), dtype=bool)
        top[1:] = (page[1:] != page[:-1]) | (line[1:] != line[:-1])
        page, mid = page[top], mid[top]
        gaps = np.bincount(page, minlength=b.pages)
        bins = np.clip(np.floor((mid - b.min_x[page]) / b.width[page] * 20), 0, 19).astype("int64")
        inner = (bins >= 5) & (bins <= 14)
        found = np.bincount(page[inner] * 20 + bins[inner], minlength=b.pages * 20).reshape(b.pages, 20)
        votes = found.copy()
        votes[:, 1:] += found[:, :-1]
        votes[:, :-1] += found[:, 1:]
        rows = np.zeros(b.pages, dtype="int64")
        np.maximum.at(rows, b.page, row)
        good = (gaps >= 5) & (votes.max(axis=1) >= np.fmax(5.0, rows * 0.5))
        split[good] = (b.min_x + ((votes.argmax(axis=1) + 0.5) / 20) * b.width)[good]
        return split

    def splits(self) -> np.ndarray:
        """The split of each two-column page, or NaN: two means, else the blank band, else the vote, with ten items on each side."""
        out = np.full(self.pages, np.nan)
        for rule in (Block.two_means, Block.blank_band, Block.gap_vote):
            todo = self.framed & np.isnan(out)
            if not todo.any():
                break
            b = self.only(todo)
            split = rule(b)
            left, right = b.per_page(b.x < split[b.page]), b.per_page(b.x >= split[b.page])
            good = todo & (left >= MIN_SIDE) & (right >= MIN_SIDE)
            out[good] = split[good]
        return out

    def rows(self, cols: np.ndarray) -> np.ndarray:
        """The row of every item, each text column of a page by itself."""
        if not cols.any():
            return row_numbers(self.y, self.starts, ROW_TOLERANCE, moving=True)
        o = np.lexsort((cols, self.page))
        group = self.page[o] * 2 + cols[o]
        starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        out = np.empty(len(o), dtype="int32")
        out[o] = row_numbers(self.y[o], starts, ROW_TOLERANCE, moving=True)
        return out


def _ends_white(texts: pa.Array, first: bool) -> np.ndarray:
    """Whether texts that are not empty begin, or end, with a blank; patterns are tried only where a byte leaves it open."""
    bounds = np.frombuffer(texts.buffers()[1], dtype="int32")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype="uint8")
    byte = data[bounds[:-1]] if first else data[bounds[1:] - 1]
    out = np.zeros(len(texts), dtype=bool)
    ask = np.flatnonzero((byte <= 32) | (byte >= 127))
    if len(ask):
        out[ask] = pc.match_substring_regex(texts.take(pa.array(ask)), _WHITE_FIRST if first else _WHITE_LAST).to_numpy(zero_copy_only=False)
    return out


def _reading(b: Block, texts: pa.Array, keys: tuple[np.ndarray, ...], line: np.ndarray) -> np.ndarray:
    """The order of the items by line and from left to right; most pages give it."""
    x = b.x
    if ((line[1:] > line[:-1]) | ((line[1:] == line[:-1]) & (x[1:] > x[:-1]))).all():
        return np.arange(len(x))
    keys = (*keys, line)
    o = np.lexsort(keys)
    tie = np.ones(max(len(o) - 1, 0), dtype=bool)
    for k in keys:
        tie &= k[o][1:] == k[o][:-1]
    return np.lexsort((pc.rank(texts, tiebreaker="dense").to_numpy(), *keys)) if tie.any() else o


def lines(b: Block, h: pa.Array, texts: pa.Array, cols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all pages in reading order: an item of each, its text, column, row, and number on the page.

    The items of a row are joined from left to right, with a space where the gap is wide and neither side has one.
    """
    height, high = _positive(h)
    least = np.where(high, np.maximum(0.5, height * 0.25), 0.5)
    end = np.where(b.wide, b.x + b.w, -np.inf)
    o = _reading(b, texts, (least, end, b.number, b.x), (b.page * 2 + cols) * (int(rows.max(initial=0)) + 1) + rows)
    page, col, row, x, end, least, wide = (v[o] for v in (b.page, cols, rows, b.x, end, least, b.wide))
    texts = texts.take(pa.array(o))
    new = np.ones(len(o), dtype=bool)
    new[1:] = (page[1:] != page[:-1]) | (col[1:] != col[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(new)
    space = np.zeros(len(o), dtype=bool)
    with np.errstate(invalid="ignore"):
        gap = x[1:] - end[:-1]
    space[1:] = ~new[1:] & wide[:-1] & ((gap > least[1:]) | np.isnan(gap))
    space[1:] &= ~_ends_white(texts, first=False)[:-1] & ~_ends_white(texts, first=True)[1:]
    lead = pc.if_else(pa.array(space), " ", "").cast(texts.type)
    pieces = pc.binary_join_element_wise(lead, texts, pa.scalar("", texts.type))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(o)), pa.int32()), pieces), pa.scalar("", texts.type))
    top = page[starts]
    number = np.arange(len(starts)) - np.searchsorted(top, top) + 1
    return o[starts], text, col[starts], row[starts], number


def _in_order(page: np.ndarray, item: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """The items of each page by number; those of one number by what they hold."""
    rank = pc.rank(item["item_no"], null_placement="at_start", tiebreaker="dense").to_numpy().astype("int64")
    if ((page[1:] > page[:-1]) | (rank[1:] > rank[:-1])).all():
        return item
    sizes = [np.where(item[c].is_valid().to_numpy(zero_copy_only=False), floats(item[c]), -np.inf) for c in ("h", "w", "y", "x")]
    o = pa.array(np.lexsort((pc.rank(item["str"], tiebreaker="dense").to_numpy(), *sizes, rank, page)))
    return {c: v.take(o) for c, v in item.items()}


def page_reader(schema: pa.Schema, split: bool):
    """A map over pages, each with its items in ``its``, to their lines; with ``split`` text columns are looked for."""

    def read(pages: pa.RecordBatch, its: pa.Array, starts: np.ndarray) -> pa.RecordBatch:
        own = dict(zip([f.name for f in its.type], its.flatten(), strict=True))
        item = _in_order(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), own)
        b = Block(starts, item["item_no"], item["x"], item["y"], item["w"])
        cols = (b.x >= b.splits()[b.page]).astype("int32") if split else np.zeros(len(b.x), dtype="int32")
        at, text, col, row, number = lines(b, item["h"], item["str"], cols, b.rows(cols))
        made = {"text": text, "col": pa.array(col, pa.int32()), "row": pa.array(row, pa.int32()), "line": pa.array(number, pa.int32())}
        page = pa.array(b.page[at])
        return pa.RecordBatch.from_arrays([(made[f.name] if f.name in made else pages[f.name].take(page)).cast(f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            its = batch["its"]
            bounds = its.offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_ITEMS, side="right")) - 1)
                inner = its.values.slice(bounds[at], bounds[to] - bounds[at])
                out = read(batch.slice(at, to - at), inner, (bounds[at : to + 1] - bounds[at]).astype("int64"))
                for i in range(0, out.num_rows, 10_000):
                    yield out.slice(i, 10_000)
                at = to

    return run
