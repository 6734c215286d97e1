"""Token ids of documents in files of canonical Huffman codes.

A store is a folder of two tables.  ``codebook`` has one row: the code length
of every id and the longest code.  ``blocks`` has a row for each block: the
range and the place it belongs to, the documents with their counts of ids, the
bits, and the bit offsets of every 256th id.  A block holds whole documents
and needs only the codebook, so blocks are decoded independently.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import Scratch, arrow_batches, remembered
from .huffman import Coder, code_lengths
from .pieces import distinct, letters_meet_marks, strung
from .ranges import partitions, range_bounds, range_of, tie_order

#: Ids of a block, about: it ends with the document that reaches the count.
BLOCK = 1 << 18
BLOCKS = "range int, block int, before long, docs array<long>, counts array<int>, n_ids long, bits binary, checkpoints binary"


#: Pieces that the library encodes at once; letters that are cut into pieces at once.
SOME, LETTERS = 2000, 1 << 21
#: Letters below this one are Latin: each has one lower-case letter, whatever stands around it.
LATIN_END = "\u0100"


def byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class ChunkEncoder:
    """Ids of texts from the ids of their pieces between spaces, line feeds, and letters and marks.

    For a tokenizer that drops white space and never merges across it nor
    across letters and marks, the pieces' ids strung together are the text's
    ids.  Pieces repeat, so most ids come from memory; all others from the
    tokenizers library.  A piece of Latin letters is one word to the tokenizer,
    whatever follows it, so its lower-case bytes go straight to the library's
    merges; any other piece takes the library's whole way.  Up to ``bound``
    pieces are remembered; those of a batch beyond them are forgotten after it.
    """

    #: A piece that no text has, as it isn't UTF-8: a document's end.
    STOP = b"\xff"

    def __init__(self, path: str, last: int, bound: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.bound = bound
        self.memory = {self.STOP: array("I", [last]).tobytes()}

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces as 32-bit integers."""
        from unicodedata import is_normalized

        found: list[bytes] = [b""] * len(pieces)
        rest, tokenize, alphabet = [], self.model.tokenize, self.alphabet
        for i, p in enumerate(pieces):
            text = p.decode()
            if p.isalpha():
                word = text.lower()
            elif text.isalpha() and max(text) < LATIN_END and is_normalized("NFC", text):
                word = text.lower().encode().decode("latin-1").translate(alphabet)
            else:
                rest.append((i, text))
                continue
            found[i] = array("I", [t.id for t in tokenize(word)]).tobytes()
        for k in range(0, len(rest), SOME):  # the library's results take far more memory than the ids
            some = rest[k : k + SOME]
            for (i, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                found[i] = array("I", e.ids).tobytes()
        return found

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the last one."""
        parts = []
        for t in texts:
            data = (t or "").encode()
            # Not in lower case where a piece could become a special token, or a
            # capital could be one letter with the combining mark after it
            # (U+0300 to U+037F start with these bytes), which comes first.
            parts.append(data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower())
        data = np.frombuffer(b" \xff ".join(parts) + b" \xff", np.uint8)
        kept = (data != 32) & (data != 10)
        first = letters_meet_marks(data)
        ends = np.cumsum([len(p) + 3 for p in parts])
        for end, p in zip(ends.tolist(), parts, strict=True):
            if b"<|" in p:  # a special token is one piece
                first[end - 3 - len(p) : end - 3] = False
        first[1:] |= ~kept[:-1]
        first[:1] = True
        which, pieces = distinct(data[kept], np.flatnonzero(first[kept]))
        memory = self.memory
        found = list(map(memory.get, pieces))
        places = [k for k, x in enumerate(found) if x is None]
        fresh = [pieces[k] for k in places]
        for k, p, x in zip(places, fresh, self.learn(fresh), strict=True):
            found[k] = memory[p] = x
        ids, ends = strung(which, found)
        if len(memory) > self.bound:
            for _ in fresh:
                memory.popitem()
        return np.split(ids.view(np.uint32), ends[which == pieces.index(self.STOP)])[:-1]


def tokenise(path: str, last: int):
    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = remembered(f"encoder {last} {path}", lambda: ChunkEncoder(path, last))
        for batch in batches:
            ids, texts = [], batch.column(1).to_pylist()
            ends = np.cumsum([len(t or "") for t in texts])
            first = 0
            while first < len(texts):  # some letters at a time, as their pieces take many times the memory
                upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LETTERS, "right")))
                ids += encode(texts[first:upto])
                first = upto
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4").tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n_ids", "ids"],
            )

    return run


def unpacked(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def id_counts(batches):
    import pyarrow as pa

    total = np.zeros(0, np.int64)
    for batch in batches:
        packed: dict[bool, list[bytes]] = {False: [], True: []}
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed[len(data) == 2 * n].append(data)
        for short, some in packed.items():
            got = np.bincount(np.frombuffer(b"".join(some), "<u2" if short else "<u4"))
            if len(got) > len(total):
                total = np.concatenate((total, np.zeros(len(got) - len(total), np.int64)))
            total[: len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def encode_blocks(lengths: bytes):
    def run(batches):
        import pyarrow as pa

        coder = Coder(np.frombuffer(lengths, np.uint8))
        where, block, before, docs, parts, held = None, 0, 0, [], [], 0

        def flush():
            ids = np.concatenate(parts).astype(np.int64)
            bits, points = coder.encode(ids)
            return [where, block, before, list(docs), [len(p) for p in parts], len(ids), bits, points.astype("<i8").tobytes()]

        def batch_of(rows):
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary())
            names = ("range", "block", "before", "docs", "counts", "n_ids", "bits", "checkpoints")
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))

        for batch in batches:
            for r, doc, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if parts and (r != where or held >= BLOCK):
                    yield batch_of([flush()])
                    block, before, docs, parts = (block + 1, before + held, [], []) if r == where else (0, 0, [], [])
                    held = 0
                where = r
                docs.append(doc), parts.append(unpacked(n, data))
                held += n
        if parts:
            yield batch_of([flush()])

    return run


def decode_blocks(lengths: bytes):
    """(doc_id, start, ids) of each document of each block."""

    def run(batches):
        coder = Coder(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for start, docs, counts, n, bits, points in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                ids = coder.decode(bits, np.frombuffer(points, "<i8"), n)
                at = 0
                for doc, count in zip(docs, counts, strict=True):
                    yield doc, start + at, ids[at : at + count]
                    at += count

    return run


def rows_of(lengths: bytes, digest: bool):
    def run(batches):
        import pyarrow as pa

        decode = decode_blocks(lengths)
        for batch in batches:
            out = ([], [], [], [])
            for doc, start, ids in decode([batch]):
                raw = ids.astype("<u4")
                for x, y in zip(out, (doc, start, len(ids), zlib.crc32(raw.tobytes()) if digest else raw.astype(np.int32)), strict=True):
                    x.append(y)
            last = pa.array(out[3], pa.int64() if digest else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode docs(doc_id, text) and write a store at ``path``, documents by rising doc_id.

    Null texts are empty and give the end id alone; repeated rows are written
    each; null ids come first.  Ties of doc_id are in the order of a hash of
    their ids, so that an id which many rows share, or a null one, is dealt to
    many tasks.  No rows give a store without blocks.
    """
    arrow_batches(spark)
    scratch = Scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.save(rows.mapInArrow(tokenise(tokenizer, end_id), "doc_id long, n_ids long, ids binary"), "ids")
    counts = tokens.select("n_ids", "ids").mapInArrow(id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    total = np.zeros(max([end_id, *(r.id for r in counts)]) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    lengths = code_lengths(total).tobytes()
    spark.createDataFrame([(bytearray(lengths), max(lengths, default=0))], "lengths binary, longest int").coalesce(1).write.parquet(f"{path}/codebook")
    n = partitions(docs)
    bounds = range_bounds(tokens, "doc_id", 4 * n)
    tie = F.xxhash64("ids")
    dealt = tokens.select(range_of("doc_id", bounds, tie).alias("range"), "doc_id", "n_ids", "ids", tie_order(tie).alias("tie"))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "doc_id", "tie", "ids").drop("tie")
    dealt.mapInArrow(encode_blocks(lengths), BLOCKS).write.parquet(f"{path}/blocks")
    scratch.drop()


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a store; with digest, ids_crc32 in place of ids.

    ``start`` counts the ids of all documents before it in the store.
    """
    arrow_batches(spark)
    lengths = bytes(spark.read.parquet(f"{path}/codebook").first().lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row for each range: a bounded number, whatever the documents.
    ranges = blocks.groupBy("range").agg(F.sum("n_ids").alias("n"))
    starts = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("first"))
    rows = blocks.join(F.broadcast(starts), "range").select((F.col("first") + F.col("before")).alias("start"), "docs", "counts", "n_ids", "bits", "checkpoints")
    return rows.mapInArrow(rows_of(lengths, digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")
