"""Benchmark items inside documents, within an edit distance.

Windows of documents and of items start at words, and inside long runs without
spaces.  A window is walked by the CGK embedding: at each step the byte is put
out, and a coin that depends on the step and the byte decides whether to move
on.  Strings a few edits apart mostly fall into step again, so their walks
differ in few places: edit distance has become Hamming distance.  Keys are
bytes sampled at some places of a walk.  A window of a document that shares one
of several keys of several walks with a window of an item is a candidate.  An
item has a window at each of its words, so that one stretch of some twenty
bytes with few edits anywhere in a copy is enough, however many edits the rest
has.

A candidate in whose stretch the item's first pieces of 64 bytes need more edits
together than the whole item may have cannot be a copy and goes; thousands are
looked at together.  For the others the least edit distance of the whole item to
any substring of the stretch is computed exactly.

Items of fewer than ``CERTAIN`` bytes have too few windows for chance to work
with.  Their shared runs of a few bytes are counted by where the item would
begin, at every byte, with a count that no copy can miss; so they are found for
certain, wherever their edits are.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_batches, forget
from .words import CHUNK, WordHasher, constants, mix, text_buffers

#: Items of fewer bytes are found for certain, wherever their edits are.
CERTAIN = 64
#: Steps of a walk, walks, keys of a walk, places of a key: of random copies with
#: all the edits that an item may have, more than 99 of 100 share a key.
STEPS, WALKS, KEYS, PLACES = 56, 2, 6, 12
#: Bytes that a walk mostly covers; windows of an item end before its end.
REACH = 30
#: Bytes from which a run without spaces has windows inside, and how far they lie apart in documents; in items every byte starts one.
RUN, APART = 24, 4
#: Edits allowed for each byte of an item.
EDITS = 0.2
#: Bits of the table that sorts out keys and runs before they are looked up.
TABLE = 1 << 22
HIGH = np.uint64(64 - 22)
#: Windows that are walked together; pairs that are counted together.
WALKED, PAIRS = 1 << 13, 1 << 20
#: Bytes of documents whose candidates are looked at together; candidates fewer than that are compared one by one.
BATCH, FEW = 1 << 22, 128
#: Cells that are counted together.
CELLS = 1 << 22
#: Items of at most so many bytes are compared so many at once.
LONG, TOGETHER = 512, 4096
#: Pieces of an item that are compared before the whole, and their bytes.
PIECES, PIECE = 4, 64
#: Bytes that all items may have together.  Their index is sent to every task
#: and takes some forty bytes for each, so its size is checked; more items must
#: be given in several calls.
MOST_ITEM_BYTES = 4 << 20


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, white space as a space."""
    out = data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)
    out[(data >= 9) & (data <= 13)] = 32
    return out


def run_and_count(size: int, most: int) -> tuple[int, int]:
    """Bytes of a short item's runs, and how many of them its edits must leave whole; (0, 0) if they need leave none."""
    for run in (4, 3, 2, 1):
        if size + 1 - run - most * run >= 1:
            return run, size + 1 - run - most * run
    return 0, 0


def edit_distance_inside(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of the item to any substring of the text, and where that ends (bit-parallel)."""
    size = len(item)
    if not size:
        return 0, 0
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, where = size, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, where = score, j
    return best, where


def one_word_distances(peq: np.ndarray, of: np.ndarray, text: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The distances for items of at most 64 bytes, their letters' places in peq from ``of`` on."""
    order = np.argsort(-lengths, kind="stable")  # so that texts that have ended are the last
    active = np.searchsorted(-lengths[order], -np.arange(len(text)), "left").tolist()
    text, of, sizes = text.take(order, axis=1), of[order], sizes[order]
    top = (sizes - 1).astype(np.uint64)
    last = np.uint64(1) << top if (top < 63).any() else None
    n = len(of)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    place, eq, xh, ph, at_end, bit = np.empty(n, np.int64), *(np.empty(n, np.uint64) for _ in range(3)), np.empty(n, bool), np.empty(n, np.uint64)
    score, zero = sizes.astype(np.int8), np.zeros(1, np.int64)
    best = score.copy()
    lowest = best
    for letters, more in zip(text, active, strict=True):
        if more < n:
            n = more
            if not n:
                break
            of, plus, minus, place, eq, xh, ph, at_end, bit, score, lowest = (x[:n] for x in (of, plus, minus, place, eq, xh, ph, at_end, bit, score, lowest))
            last = last if last is None else last[:n]
        np.add(of, letters[:n], out=place)
        peq.take(place, out=eq, mode="clip")
        np.bitwise_and(eq, plus, out=xh)
        xh += plus
        xh ^= plus
        xh |= eq
        np.bitwise_or(xh, plus, out=ph)
        np.invert(ph, out=ph)
        ph |= minus
        xh &= plus  # the minus bits from here on
        eq |= minus
        for bits, change in ((ph, np.add), (xh, np.subtract)):
            if last is None:
                np.less(bits.view(np.int64), zero, out=at_end)
            else:
                np.bitwise_and(bits, last, out=bit)
                np.not_equal(bit, zero.view(np.uint64), out=at_end)
            change(score, at_end.view(np.int8), out=score)
        ph += ph
        xh += xh
        np.bitwise_and(ph, eq, out=minus)
        ph |= eq
        np.invert(ph, out=ph)
        np.bitwise_or(xh, ph, out=plus)
        np.minimum(lowest, score, out=lowest)
    out = np.empty(len(best), np.int64)
    out[order] = best
    return out


def edit_distances_inside(items: list[bytes], texts: list[bytes]) -> np.ndarray:
    """edit_distance_inside for many pairs at once, items of at most LONG bytes."""
    order = sorted(range(len(items)), key=lambda i: -len(items[i]))
    numbers: dict[bytes, int] = {}
    of = np.array([numbers.setdefault(items[i], len(numbers)) for i in order])
    sizes = np.array([len(items[i]) for i in order])
    blocks = -(-int(sizes[0]) // 64)
    peq = np.zeros((blocks, len(numbers) * 256), np.uint64)
    for item, n in numbers.items():
        letters = np.frombuffer(item, np.uint8).astype(np.int64)
        at = np.arange(len(item))
        np.bitwise_or.at(peq, (at // 64, n * 256 + letters), np.uint64(1) << (at % 64).astype(np.uint64))
    lengths = np.array([len(texts[i]) for i in order])
    rows = np.zeros((len(order), int(lengths.max())), np.uint8)
    for k, i in enumerate(order):
        rows[k, : lengths[k]] = np.frombuffer(texts[i], np.uint8)
    text, of = np.ascontiguousarray(rows.T), of * 256
    one, last = np.uint64(1), np.uint64(63)
    if blocks == 1:
        best = one_word_distances(peq[0], of, text, lengths, sizes)
        out = np.zeros(len(order), np.int64)
        out[order] = best
        return out
    top = ((sizes - 1) % 64).astype(np.uint64)
    # Items are in order of falling size, so those with a block b come first.
    having = [int((sizes > 64 * b).sum()) for b in range(blocks)] + [0]
    plus = [np.full(h, ~np.uint64(0)) for h in having[:-1]]
    minus = [np.zeros(h, np.uint64) for h in having[:-1]]
    score, best = sizes.copy(), sizes.copy()
    shortest = int(lengths.min())
    for step in range(len(text)):
        letters = of + text[step]
        carry_plus = carry_minus = np.zeros(len(order), np.uint64)
        for b in range(blocks):
            n, more = having[b], having[b + 1]
            p, m, hp, hm = plus[b], minus[b], carry_plus[:n], carry_minus[:n]
            eq = peq[b].take(letters[:n])
            xv = eq | m
            eq |= hm
            xh = (((eq & p) + p) ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            if more < n:
                score[more:n] += ((ph[more:] >> top[more:n]) & one).astype(np.int64) - ((mh[more:] >> top[more:n]) & one).astype(np.int64)
            carry_plus, carry_minus = ph >> last, mh >> last
            ph = (ph << one) | hp
            mh = (mh << one) | hm
            plus[b] = mh | ~(xv | ph)
            minus[b] = ph & xv
        np.minimum(best, score, out=best, where=True if step < shortest else step < lengths)
    out = np.zeros(len(order), np.int64)
    out[order] = best
    return out


def run_codes(data: np.ndarray, run: int) -> np.ndarray:
    """Each run of up to eight bytes as a number of its own."""
    out = np.zeros(max(0, len(data) - run + 1), np.uint64)
    for i in range(run):
        out *= np.uint64(256)
        out += data[i : i + len(out)]
    return out


class Steps:
    """The coins and sampled places of all walks.

    A byte and its coins in all steps of a walk are one number, so that a step
    looks up one number for each window.
    """

    #: Where the byte stands in its number, above the coins.
    BYTE = np.uint64(STEPS)

    def __init__(self):
        every = np.arange(256, dtype=np.uint64)
        self.walks = []
        for walk in range(WALKS):
            coins = mix(np.arange(STEPS * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1 + 1_000_003 * walk)) >> np.uint64(40)
            moves = (coins & np.uint64(1)).reshape(STEPS, 256)
            numbers = every << self.BYTE
            for step in range(STEPS):
                numbers |= moves[step] << np.uint64(step)
            used: list[list[tuple[int, np.uint64]]] = [[] for _ in range(STEPS)]
            begin = np.zeros(KEYS, np.uint64)
            for k in range(KEYS):
                n = walk * KEYS + k
                order = np.argsort(mix(np.arange(STEPS, dtype=np.uint64) + np.uint64(7919 * (n + 1))), kind="stable")
                weights = constants(PLACES, 101 + n)
                # A sampled byte counts as the next number, so that zero does too.
                begin[k] = weights.sum(dtype=np.uint64) + np.uint64(977 + n)
                for step, weight in zip(order[:PLACES].tolist(), weights, strict=True):
                    used[step].append((k, weight))
            last = max(step for step in range(STEPS) if used[step])
            self.walks.append((numbers, used[: last + 1], begin))

    def numbers(self, data: np.ndarray) -> list[np.ndarray]:
        """Each byte's number, for each walk."""
        return [numbers.take(data) for numbers, _, _ in self.walks]

    def keys(self, numbers: list[np.ndarray], starts: np.ndarray):
        """Yields the windows' hashes, key by key, the high bits being the best; the data must go on for STEPS bytes after each start."""
        one, here, part = np.ones(1, np.uint64), np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
        for (_, used, begin), own in zip(self.walks, numbers, strict=True):
            at = starts.copy()
            keys = [np.full(len(starts), x) for x in begin]
            for step, places in enumerate(used):
                own.take(at, out=here, mode="clip")
                np.right_shift(here, np.uint64(step), out=part)
                part &= one
                at += part.view(np.int64)
                if places:
                    here >>= self.BYTE
                    for k, weight in places:
                        np.multiply(here, weight, out=part)
                        keys[k] += part
            yield from keys


def window_starts(data: np.ndarray, cuts: np.ndarray, apart: int) -> np.ndarray:
    """Where windows start: at words, and in long runs without spaces at every so many bytes."""
    starts, ends = WordHasher().spans(data, cuts)
    long = np.flatnonzero(ends - starts >= RUN)
    if not len(long):
        return starts
    n = (ends[long] - starts[long] - 1) // apart
    inside = np.repeat(starts[long], n) + apart * (spread(np.zeros(len(n), np.int64), n) + 1)
    return np.sort(np.concatenate((starts, inside)))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each, n of them."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


class Walked:
    """The windows of all items that are not short, by their keys."""

    def __init__(self, members: list[tuple[int, bytes, int]]):
        self.number = np.array([n for n, _, _ in members], np.int64)
        self.size = np.array([len(x) for _, x, _ in members], np.int64)
        self.most = np.array([m for _, _, m in members], np.int64)
        self.width = np.maximum(self.most // 2, 32)
        self.steps, rows = Steps(), []
        pad = np.full(STEPS + 1, 32, np.uint8)
        self.first = np.cumsum(self.size) - self.size
        self.letters = np.concatenate([np.frombuffer(x, np.uint8) for _, x, _ in members])
        for k, (_, item, _) in enumerate(members):
            data = np.frombuffer(item, np.uint8)
            starts = window_starts(data, np.array([0, len(data)]), 1)
            starts = starts[starts <= len(item) - REACH]
            for keys in self.steps.keys(self.steps.numbers(np.concatenate((data, pad))), starts):
                rows.append((keys, np.full(len(starts), k, np.int32), starts.astype(np.int32)))
        keys, owner, offset = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(keys, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.keys, self.place, self.times = np.unique(keys[order], return_index=True, return_counts=True)

    def table(self) -> np.ndarray:
        out = np.zeros(TABLE, bool)
        out[(self.keys >> HIGH).view(np.int64)] = True
        return out

    def pairs(self, part: np.ndarray, cuts: np.ndarray, table: np.ndarray):
        """Yields (window's start, entry): arrays of windows of the part that share a key with an item's window."""
        starts = window_starts(part, cuts, APART)
        numbers = self.steps.numbers(np.concatenate((part, np.full(STEPS + 1, 32, np.uint8))))
        for low in range(0, len(starts), WALKED):
            some = starts[low : low + WALKED]
            for keys in self.steps.keys(numbers, some):
                maybe = np.flatnonzero(table.take((keys >> HIGH).view(np.int64), mode="clip"))
                place = np.searchsorted(self.keys, keys[maybe])
                place[place == len(self.keys)] = 0
                same = self.keys[place] == keys[maybe]
                where, place = some[maybe[same]], place[same]
                times = self.times[place]
                ends = np.cumsum(times)
                a = 0
                while a < len(where):
                    done = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                    n = times[a:b]
                    yield np.repeat(where[a:b], n), np.arange(n.sum()) + np.repeat(self.place[place[a:b]] - (ends[a:b] - n - done), n)
                    a = b

    def candidates(self, part: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows of places among the members, from and to: stretches of the part in which the item may begin."""
        longest = int(self.size.max())
        cells = (len(part) + longest) // 32 + 3
        found = [np.zeros(0, np.int64)]
        for where, entry in self.pairs(part, cuts, table):
            k = self.owner[entry].astype(np.int64)
            found.append(np.unique(k * cells + (where - self.offset[entry] + longest) // self.width[k]))
        found = np.unique(np.concatenate(found))
        # Cells side by side are one stretch.
        first = np.flatnonzero(np.diff(found, prepend=-9) > 1)
        many = np.diff(first, append=len(found))
        k, cell = found[first] // cells, found[first] % cells
        low = cell * self.width[k] - longest
        high = low + self.width[k] * many
        # Where the item with its edits may lie.
        left, right = np.maximum(0, low - self.most[k]), np.minimum(len(part), high + self.size[k] + self.most[k])
        fits = right - left >= self.size[k] - self.most[k]
        return np.stack((k, low - self.most[k], high))[:, fits]

    def fitting(self, text: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The candidates in which the first pieces of their item need no more edits together than the whole may have.

        Item k begins from ``low`` on, and before ``high`` but for its edits.
        Pieces fill one machine word, and two or three of them tell unrelated
        text; no item within its edits is lost.  Long stretches all stay.
        """
        k, low, high = found
        left, reach = self.most[k], PIECE + high - low + self.most[k]
        order = np.argsort(reach, kind="stable")
        order = order[: int(np.searchsorted(reach[order], 4 * LONG, "right"))]
        for start in range(0, PIECE * PIECES, PIECE):
            order = order[(left[order] >= 0) & (self.size[k[order]] >= start + PIECE)]
            a = 0
            while a < len(order):
                # Some at a time, each as far as the longest of them reaches.
                few = order[a : a + TOGETHER]
                few = few[: max(1, int(np.searchsorted(reach[few] * np.arange(1, len(few) + 1), CELLS, "right")))]
                a += len(few)
                items, of = np.unique(k[few], return_inverse=True)
                peq = np.zeros(len(items) * 256, np.uint64)
                for place in range(PIECE):
                    peq[np.arange(len(items)) * 256 + self.letters[self.first[items] + start + place]] |= np.uint64(1 << place)
                begin, end = np.maximum(0, low[few] + start), np.minimum(len(text), low[few] + start + reach[few])
                lengths = np.maximum(0, end - begin)
                letters = text.take(begin + np.arange(int(lengths.max()))[:, None], mode="clip")
                left[few] -= one_word_distances(peq, of * 256, letters, lengths, np.full(len(few), PIECE))
        return found[:, left >= 0]


class Group:
    """The runs of some short items, all of one length."""

    def __init__(self, run: int, members: list[tuple[int, bytes, int, int]]):
        self.run = run
        self.number = np.array([n for n, _, _, _ in members])
        self.size = np.array([len(x) for _, x, _, _ in members])
        self.most = np.array([m for _, _, m, _ in members])
        self.count = np.array([c for _, _, _, c in members])
        self.width = np.maximum(self.most + 1, 32)
        codes = [run_codes(np.frombuffer(x, np.uint8), run) for _, x, _, _ in members]
        owner = np.repeat(np.arange(len(members)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes])
        codes = np.concatenate(codes)
        order = np.argsort(codes, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.codes, self.first, self.times = np.unique(codes[order], return_index=True, return_counts=True)

    def table(self) -> np.ndarray:
        out = np.zeros(TABLE, bool)
        out[(mix(self.codes) & np.uint64(TABLE - 1)).astype(np.int64)] = True
        return out

    def candidates(self, part: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows of places in the group, from and to: stretches of the part in which the item may begin."""
        codes = run_codes(part, self.run)
        at = np.flatnonzero(table[(mix(codes) & np.uint64(TABLE - 1)).astype(np.int64)])
        at = at[at + self.run <= cuts[np.searchsorted(cuts, at, "right")]]
        place = np.searchsorted(self.codes, codes[at])
        place[place == len(self.codes)] = 0
        same = self.codes[place] == codes[at]
        at, place = at[same], place[same]
        longest = int(self.size.max())
        rows = (len(part) + longest) // self.width + 4
        base = np.concatenate(([0], np.cumsum(rows)))
        counts = np.zeros(base[-1], np.int64)
        times = self.times[place]
        ends = np.cumsum(times)
        low = 0
        while low < len(at):
            done = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            n = times[low:high]
            pair = np.arange(n.sum()) + np.repeat(self.first[place[low:high]] - (ends[low:high] - n - done), n)
            item = self.owner[pair]
            counts += np.bincount(base[item] + (np.repeat(at[low:high], n) - self.offset[pair] + longest) // self.width[item], minlength=len(counts))
            low = high
        # The beginnings that one copy's runs give lie in three cells side by side.
        counts[:-2] += counts[1:-1] + counts[2:]
        flagged = np.flatnonzero(counts >= np.repeat(self.count, rows))
        item = np.searchsorted(base, flagged, "right") - 1
        new = np.ones(len(flagged) + 1, bool)
        new[1:-1] = (np.diff(flagged) > 2) | (np.diff(item) > 0)
        bounds = np.flatnonzero(new)
        a, b = bounds[:-1], bounds[1:] - 1
        k = item[a]
        return np.stack((k, (flagged[a] - base[k]) * self.width[k] - longest, (flagged[b] - base[k] + 3) * self.width[k] - longest))

    def fitting(self, text: np.ndarray, found: np.ndarray) -> np.ndarray:
        """All candidates: short items are soon compared."""
        return found


class ItemIndex:
    """Windows and runs of all items, for every task."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        found: dict[bytes, list[int]] = {}
        for number, text in items:
            norm = b" ".join(lowered(np.frombuffer(text.encode(), np.uint8)).tobytes().split())
            if norm:
                found.setdefault(norm, []).append(number)
        self.items = sorted(found)
        self.ids = [sorted(found[x]) for x in self.items]
        by_run: dict[int, list[tuple[int, bytes, int, int]]] = {}
        walked: list[tuple[int, bytes, int]] = []
        for n, item in enumerate(self.items):
            most = int(edits * len(item))
            if len(item) >= CERTAIN:
                walked.append((n, item, most))
                continue
            run, count = run_and_count(len(item), most)
            by_run.setdefault(run, []).append((n, item, most, count))
        #: Items that allow so many edits that no run need stay whole; all documents are compared with them.
        self.anywhere = [(n, most) for n, _, most, _ in by_run.pop(0, [])]
        self.groups: list[Walked | Group] = [Walked(walked)] if walked else []
        for run, members in sorted(by_run.items()):
            cells = np.cumsum([CHUNK // max(most + 1, 32) for _, _, most, _ in members]) // CELLS
            self.groups += [Group(run, [m for m, c in zip(members, cells.tolist(), strict=True) if c == k]) for k in np.unique(cells).tolist()]

    def tables(self) -> list[np.ndarray]:
        return [group.table() for group in self.groups]


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents in lower case with single spaces between words."""
    data = lowered(data)
    space = data == 32
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = ~(space & np.concatenate(([True], space[:-1])) & ~first)
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def hits(index: ItemIndex):
    """(doc_id, item_ids, distances): every document with the items found in it."""

    def run(batches):
        import pyarrow as pa

        forget()
        tables = index.tables()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            found: list[dict[int, int]] = [{} for _ in range(len(batch))]

            waiting: list[tuple[int, int, int, bytes]] = []

            def settle() -> None:
                """Compare what waits; short texts first, so that few wait for a long one."""
                few = [x for x in waiting if len(index.items[x[1]]) <= LONG and len(x[3]) <= 4 * LONG] if len(waiting) >= FEW else []
                few.sort(key=lambda x: len(x[3]))
                distances = [(x, edit_distance_inside(index.items[x[1]], x[3])[0]) for x in waiting if not few or len(index.items[x[1]]) > LONG or len(x[3]) > 4 * LONG]
                for k in range(0, len(few), max(256, len(few) // 3 + 1)):
                    some = few[k : k + max(256, len(few) // 3 + 1)]
                    distances += zip(some, edit_distances_inside([index.items[x[1]] for x in some], [x[3] for x in some]).tolist(), strict=True)
                for (doc, n, most, _), distance in distances:
                    if distance <= min(most, found[doc].get(n, most)):
                        found[doc][n] = distance
                waiting.clear()

            def compare(doc: int, n: int, most: int, text: bytes) -> None:
                waiting.append((doc, n, most, text))
                if len(waiting) >= 4 * TOGETHER:
                    settle()

            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH, "right")) - 1)
                text, cuts = squeezed(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for n, most in index.anywhere:
                    for doc in range(last - first):
                        if cuts[doc] < cuts[doc + 1]:
                            compare(first + doc, n, most, text[cuts[doc] : cuts[doc + 1]].tobytes())
                ends = cuts.tolist()
                for group, table in zip(index.groups, tables, strict=True):
                    found_in, a = [], 0
                    while a < last - first:
                        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + CHUNK, "right")) - 1)
                        found_in.append(group.candidates(text[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a], table) + [[0], [cuts[a]], [cuts[a]]])
                        a = b
                    for k, low, high in group.fitting(text, np.concatenate(found_in, axis=1)).T.tolist():
                        n, size, most = int(group.number[k]), int(group.size[k]), int(group.most[k])
                        low, high = max(0, low), min(len(text), high + size + most)
                        doc = bisect_right(ends, low) - 1
                        while doc < last - first and ends[doc] < high:
                            part = text[max(low, ends[doc]) : min(high, ends[doc + 1])].tobytes()
                            if len(part) >= size - most:
                                compare(first + doc, n, most, part)
                            doc += 1
                first = last
            settle()
            ids = [sorted((i, d) for n, d in f.items() for i in index.ids[n]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[i for i, _ in x] for x in ids], pa.list_(pa.int64())), pa.array([[d for _, d in x] for x in ids], pa.list_(pa.int32())), *batch.columns[2:]],
                names=["doc_id", "item_ids", "distances", *batch.schema.names[2:]],
            )

    return run


def item_index(items: DataFrame, edits: float) -> ItemIndex:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    if size > MOST_ITEM_BYTES:
        raise ValueError(f"the items have {size} bytes, more than MOST_ITEM_BYTES; give them in several calls")
    return ItemIndex([(r.item_id, r.text) for r in items.collect()], edits)


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, edits: float = EDITS, hashed: bool = False) -> DataFrame:
    """(doc_id, item_ids, distances, contaminated) for each row of docs(doc_id, text); with ``hashed`` also ``text_hash``, the text's xxhash64.

    An item (item_id, text) is in a document if the item, A-Z in lower case and
    with single spaces, is within ``edits`` of its length in bytes of some
    substring of the document so written, at words or inside them.  Null or blank items match nothing; equal items are
    reported each.  A null or empty text has no items; a
    repeated row gives a row each; ids may be null.
    """
    arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.xxhash64("text").alias("text_hash")] * hashed)
    found = rows.mapInArrow(hits(item_index(items, edits)), "doc_id long, item_ids array<long>, distances array<int>" + ", text_hash long" * hashed)
    return found.withColumn("contaminated", F.size("item_ids") > 0)
