"""Candidates of decontamination: few are compared as a whole, and no copy goes."""

import random

import numpy as np
import pyarrow as pa

from spanlight.llm import decontamination

PARTS = ["ber", "tät", "lich", "ung", "heit", "en", "er", "is", "ou", "the", "tion", "re"]


def words(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def edited(rng, text, n):
    data = list(text)
    for _ in range(n):
        k = rng.randrange(1, len(data) - 1)
        data[k : k + 1] = rng.choice(["", "q", data[k] + "q"])
    return "".join(data)


def found_in(items, texts, rows=512):
    index = decontamination.ItemIndex(list(enumerate(items)))
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return [x for b in decontamination.hits(index)(iter(table.to_batches(max_chunksize=rows))) for x in b.column(1).to_pylist()]


def test_text_that_shares_a_phrase_is_not_compared_as_a_whole(monkeypatch):
    rng, compared = random.Random(42), []
    one, many = decontamination.edit_distance_inside, decontamination.edit_distances_inside
    monkeypatch.setattr(decontamination, "edit_distance_inside", lambda a, b: compared.append(a) or one(a, b))
    monkeypatch.setattr(decontamination, "edit_distances_inside", lambda a, b: compared.extend(a) or many(a, b))
    items = [" ".join(words(rng, 40)) for _ in range(30)]
    # A phrase of an item, long enough for a key, amid other words.
    texts = [" ".join([*words(rng, 60), *items[k % 30].split()[10:17], *words(rng, 60)]) for k in range(300)]
    texts[7] += " " + items[3]
    assert found_in(items, texts) == [[3] if k == 7 else [] for k in range(300)]
    assert 1 <= len(compared) <= 15


def test_copies_are_found_at_all_edges(monkeypatch):
    """At the ends of documents and of parts, beside each other, and in one very long document."""
    rng = random.Random(43)
    monkeypatch.setattr(decontamination, "CHUNK", 900)
    items = [" ".join(words(rng, n)) for n in (11, 12, 14, 20, 25, 40, 60, 90)] + ["short one that is here", "x y"]
    items = [i for i in items if len(i.encode()) >= 16]
    texts = []
    for _ in range(80):
        a, b = rng.choice(items), rng.choice(items)
        texts += [" ".join(words(rng, rng.randrange(20))) + edited(rng, f" {a} ", len(a) // 14) + edited(rng, f" {b} ", len(b) // 14), "", a]
    texts += [" ".join(words(rng, 3000)) + " " + items[4] + " " + " ".join(words(rng, 50)), None]
    low = lambda t: b" ".join(decontamination.lowered(np.frombuffer((t or "").encode(), np.uint8)).tobytes().split())
    want = [[n for n, item in enumerate(items) if decontamination.edit_distance_inside(low(item), low(t))[0] <= int(0.2 * len(low(item)))] for t in texts]
    assert found_in(items, texts) == want
    monkeypatch.setattr(decontamination, "BATCH", 2000)
    assert found_in(items, texts, 50) == want
