"""Byte-level BPE: texts to ids and back, as columns.

A text is cut where something that is no white space meets white space of ASCII,
and where letters and marks meet, as no piece of the tokenizer's pattern spans
such a place.  The cuts repeat, so each distinct one of many texts is looked up
once, and its ids mostly come from a bounded memory.  A new one is split into
pieces by the tokenizer's pattern and each piece is merged here: its symbols are a doubly
linked list, a priority queue holds every neighbouring pair that has a merge by
rank and place, and an entry whose pair is no longer there when it is popped is
passed over.  A long piece has a heap of its own.  Short pieces go together,
thousands at once: their lists lie in arrays, their queues in one sorted array,
and each round pops the first entry of every piece, so a step is a handful of
array operations for all of them.  Decoding strings the vocabulary's entries
together.

Nulls count as empty texts, an empty text has no ids, repeated rows are encoded
alike, an empty table gives none, and other columns stay as they are.  A very
long text is encoded in parts of about SEGMENT characters, a very long piece
takes n log n steps.  An id that the vocabulary lacks decodes to nothing, as
does null.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import arrow_batches, remembered
from .pieces import distinct, letters_meet_marks, strung, white_ends
from .token_files import byte_alphabet

#: Unicode white space, as the tokenizer's pattern has it, and that pattern.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character all versions of Unicode agree on what is a letter, a number or a space.
AGREED = "\u0530"
#: Characters that are encoded at once; bytes of a cut that is remembered; cuts remembered twice over; bytes of a piece that is merged with others; bytes decoded at once.
SEGMENT, SHORT, MEMORY, TOGETHER, SOME = 1 << 21, 48, 250_000, 64, 1 << 20
#: Bits of a place and of a rank in an entry of the queue of many pieces.
PLACE, RANK = 24, 20


def read_vocabulary(path: str) -> dict:
    """What encoding and decoding need of a tokenizer's JSON file; another kind than byte-level BPE is an error."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, cut = found["model"], found["pre_tokenizer"] or {}
    plain = not (found["normalizer"] or found["post_processor"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or (found["decoder"] or {}).get("type") != "ByteLevel" or not plain:
        raise ValueError("not a plain byte-level BPE file")
    added = found["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens may only be matched as they are")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": pairs, "added": {t["content"]: t["id"] for t in added}, "prefix_space": cut["add_prefix_space"]}


class Vocabulary:
    """Encodes and decodes in one Python worker."""

    def __init__(self, found: dict):
        import regex

        vocab = found["vocab"]
        self.size = max([*vocab.values(), *found["added"].values()]) + 1
        # A pair's rank by left * size + right, and what the merge of a rank makes.
        self.ranks = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(found["merges"])}
        self.made = [vocab[a + b] for a, b in found["merges"]]
        self.pair_keys = np.array(sorted(self.ranks) or [-1], np.int64)
        self.pair_ranks = np.array([self.ranks.get(k, -1) for k in self.pair_keys.tolist()], np.int64)
        self.made_ids = np.array(self.made or [0], np.int64)
        self.added, self.prefix_space = found["added"], found["prefix_space"]
        hidden = byte_alphabet()
        byte_of = {chr(hidden.get(b, b)): b for b in range(256)}
        self.byte_ids = np.array([vocab[c] for c in sorted(byte_of, key=byte_of.get)], np.int64)
        entries = {i: t for t, i in (vocab | self.added).items()}
        strings = [bytes(byte_of[c] for c in t) if (t := entries.get(i, "")) and all(c in byte_of for c in t) else t.encode() for i in range(self.size)]
        self.flat, self.sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([*map(len, strings)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.cuts = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.turn = re.compile(f"[^{SPACE}](?=[{SPACE}])")
        named = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.names = re.compile(f"({named})") if named else None
        self.agreed, self.pieces = regex.compile(PIECE), None
        self.memory: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols with all merges applied: the least rank first, of equals the leftmost."""
        size, rank_of, made, push, pop = self.size, self.ranks.get, self.made, heapq.heappush, heapq.heappop
        n = len(symbols)
        # An entry is a rank and a place in one number.
        heap = [rank << 32 | i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := rank_of(a * size + b)) is not None]
        if not heap:
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j < 0 or rank_of(left * size + symbols[j]) != entry >> 32:
                continue  # stale: one of the two has been merged since
            new = symbols[i] = made[entry >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (rank := rank_of(new * size + symbols[k])) is not None:
                    push(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] * size + new)) is not None:
                push(heap, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 without one."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many short pieces, each as its bytes' symbols with all merges applied."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n, starts = len(symbols), np.cumsum(sizes) - sizes
        # Place n is beyond every end, and before every start.
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts + sizes - 1], before[starts] = n, n
        piece = np.repeat(np.arange(len(pieces)), sizes)
        ranks = np.full(n + 1, -1, np.int64)  # of the pair that starts at a place
        first = np.flatnonzero(after[:n] < n)
        ranks[first] = self.pair_rank(symbols[first], symbols[after[first]])
        entries = lambda at: (piece[at] << (PLACE + RANK)) | (ranks[at] << PLACE) | at
        queue = np.sort(entries(np.flatnonzero(ranks >= 0)))
        while len(queue):
            owner = queue >> (PLACE + RANK)
            least = np.append(True, owner[1:] != owner[:-1])
            popped, queue = queue[least], queue[~least]
            i, rank = popped & ((1 << PLACE) - 1), (popped >> PLACE) & ((1 << RANK) - 1)
            live = ranks[i] == rank  # others are stale: one of the two has been merged since
            i, rank = i[live], rank[live]
            j = after[i]
            symbols[i], symbols[j], ranks[j] = self.made_ids[rank], -1, -1
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            ranks[i] = np.where(k < n, self.pair_rank(symbols[i], symbols[k]), -1)
            some = h < n
            h, i_after = h[some], i[some]
            ranks[h] = self.pair_rank(symbols[h], symbols[i_after])
            pushed = np.concatenate((i[ranks[i] >= 0], h[ranks[h] >= 0]))
            queue = np.sort(np.concatenate((queue, entries(pushed))), kind="stable")
        ids = symbols[:n].astype(np.int32)
        counts = np.add.reduceat(ids >= 0, starts) if n else sizes
        data, ends = ids[ids >= 0].tobytes(), (np.cumsum(counts) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def split(self, cut: str) -> list[str]:
        """The pieces of a cut: by the pattern where it is certain, else by the library's own."""
        if cut.isascii() or max(cut) < AGREED:
            core = cut.rstrip(".,;:!?")
            if core[core[:1] == " " :].isalpha():
                return [core, cut[len(core) :]] if len(core) < len(cut) else [cut]
            return self.agreed.findall(cut)
        if self.pieces is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.pieces = ByteLevel(add_prefix_space=False, use_regex=True)
        return [cut[a:b] for _, (a, b) in self.pieces.pre_tokenize_str(cut)]

    def learn(self, cuts: list[bytes]) -> list[bytes]:
        """The ids of cuts as 32-bit integers."""
        number: dict[bytes, int] = {}
        split: list[int | list[int]] = []
        for cut in cuts:
            if cut.isalpha() or (cut[0] == 32 and cut[1:].isalpha()):
                split.append(number.setdefault(cut, len(number)))
            else:
                split.append([number.setdefault(piece.encode(), len(number)) for part in self.cuts.findall(cut.decode()) for piece in self.split(part)])
        pieces = list(number)
        ids = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if len(p) <= TOGETHER]
        for k, found in zip(short, self.merged_together([pieces[k] for k in short]) if short else [], strict=True):
            ids[k] = found
        for k, p in enumerate(pieces):
            if len(p) > TOGETHER:
                ids[k] = array("i", self.merged(self.byte_ids[np.frombuffer(p, np.uint8)].tolist())).tobytes()
        return [ids[k] if isinstance(k, int) else b"".join([ids[n] for n in k]) for k in split]

    def segments(self, text: str) -> Iterator[str | bytes]:
        """A text in parts that are encoded by themselves; the id of an added token as bytes."""
        for k, part in enumerate(self.names.split(text) if self.names else [text]):
            if k % 2:
                yield array("i", [self.added[part]]).tobytes()
                continue
            if self.prefix_space and part and not part[0].isspace():
                part = " " + part
            start = 0
            while start < len(part):
                end = len(part)
                if end - start > SEGMENT and (turn := self.turn.search(part, start + SEGMENT)):
                    end = turn.end()
                yield part[start:end]
                start = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as 32-bit integers."""
        collected = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and looking through what is remembered takes long
        try:
            return self.encoded(texts)
        finally:
            if collected:
                gc.enable()

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in texts]
        waiting: list[tuple[int, str | bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.segments(text or ""):
                waiting.append((k, part))
                size += len(part)
                if size >= SEGMENT:
                    self.settle(waiting, out)
                    waiting, size = [], 0
        self.settle(waiting, out)
        return list(map(np.concatenate, out))

    def settle(self, waiting: list[tuple[int, str | bytes]], out: list[list[np.ndarray]]) -> None:
        raw = [part.encode() for _, part in waiting if isinstance(part, str)]
        ids = iter(self.ids_of(raw) if raw else [])
        for k, part in waiting:
            out[k].append(np.frombuffer(part, np.int32) if isinstance(part, bytes) else next(ids))

    def ids_of(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part, none empty."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = letters_meet_marks(data)
        space, white = white_ends(data)
        first[1:] |= space[1:] & ~white[:-1]
        first[np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(first)
        which, cuts = distinct(data, starts)
        memory, older = self.memory, self.older
        found = list(map(memory.get, cuts))
        fresh = []
        for k, x in enumerate(found):
            if x is None:
                found[k] = x = older.get(cuts[k])
                if x is None:
                    fresh.append(k)
                else:
                    memory[cuts[k]] = x
        for k, x in zip(fresh, self.learn([cuts[k] for k in fresh]), strict=True):
            found[k] = x
            if len(cuts[k]) <= SHORT:
                memory[cuts[k]] = x
        if len(memory) > MEMORY:
            self.older, self.memory = memory, {}
        ids, ends = strung(which, found)
        return np.split(ids, ends[np.searchsorted(starts, np.cumsum(sizes)[:-1]) - 1])

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's entries strung together; an id that it lacks is passed over."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, np.arange(SOME, int(ends[-1]) + SOME, SOME)) if len(ids) else []
        out = []
        for some in np.split(ids, cuts):
            sizes = self.sizes[some]
            at = np.cumsum(sizes) - sizes
            out.append(self.flat[np.repeat(self.starts[some] - at, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out).decode("utf-8", "replace")


class Bpe:
    """Columns of ids and of texts for one tokenizer file, which is read on the driver and broadcast: its size is the vocabulary's."""

    def __init__(self, spark: SparkSession, path: str):
        arrow_batches(spark)
        self.name, self.shared = uuid.uuid4().hex, spark.sparkContext.broadcast(read_vocabulary(path))

    def worker(self):
        """Gets the worker's vocabulary, made at first use."""
        name, shared = self.name, self.shared
        return lambda: remembered(("bpe", name), lambda: Vocabulary(shared.value))

    def encode(self, text: Column) -> Column:
        vocabulary = self.worker()

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            parts = vocabulary().encode(texts.to_pylist())
            ends = np.cumsum([0, *map(len, parts)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))

        return ids(text)

    def decode(self, ids: Column) -> Column:
        vocabulary = self.worker()

        @F.arrow_udf("string")
        def texts(rows: pa.Array) -> pa.Array:
            decode = vocabulary().decode
            values, ends = rows.values.fill_null(-1).to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
            return pa.array((decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), pa.string())

        return texts(ids)


def bpe_encoded(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    return docs.select("doc_id", Bpe(spark, path).encode(F.col("text").cast("string")).alias("ids"))


def bpe_decoded(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of every row's ids."""
    return rows.select("doc_id", "ids", Bpe(spark, path).decode(F.col("ids")).alias("text"))


def id_digest(ids: Column) -> Column:
    """Lowercase hex sha256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
