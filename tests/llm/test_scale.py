"""Cases that break short cuts: texts whose polynomial hashes collide, short periods, large groups."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, neardup, suffixes
from tessera.llm.common import span_hashes, word_bounds

public_tokenizers = pytest.importorskip("public_tokenizers")
SP = public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(n, letters="ab"):
    s = letters[0]
    while len(s) < n:
        s += s.translate(str.maketrans(letters, letters[::-1]))
    return s[:n]


@pytest.mark.parametrize("n", [64, 256, 257, 1024, 4096])
def test_words_of_two_letters_keep_their_hashes_apart(n):
    a = thue_morse(n)
    raw = np.frombuffer(f"{a} {a.translate(str.maketrans('ab', 'ba'))} {a.upper()}".encode(), np.uint8)
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]))
    h = span_hashes(raw, starts, ends)
    assert h[0] != h[1] and h[0] == h[2]


def test_thue_morse_documents_are_not_linked_and_words_not_mixed(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id bigint, text string")
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 1}
    scored = {r["doc_id"]: r for r in lm.score_texts(docs, F.col("id") == 2, SP).collect()}
    assert [scored[k]["n_known"] for k in (1, 2, 3)] == [2, 1, 2]


@pytest.mark.parametrize("text", ["-" * 30_000, "ab-" * 9_000, "line of text\n" * 800, thue_morse(8192), "x" * 150 + "yz" * 700 + "x" * 150 + "yz" * 90])
def test_periodic_text(spark, text):
    n, seen = len(text), Counter()
    for s in range(n - 199):
        seen[hash(text[s : s + 200])] += 1
    gone = np.zeros(n, bool)
    for s in range(n - 199):
        if seen[hash(text[s : s + 200])] > 1:
            gone[s : s + 200] = True
    out = suffixes.remove_repeats(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), ["doc_id"], digest=True).collect()[0]
    want = np.frombuffer(text.encode(), np.uint8)[~gone].tobytes()
    assert (out["n_removed"], out["kept"]) == (int(gone.sum()), hashlib.sha256(want).hexdigest())


def test_runs_do_not_depend_on_their_neighbours(monkeypatch):
    rng = np.random.default_rng(4)
    text = np.concatenate((rng.integers(97, 123, 5000), np.full(4000, 45), np.tile([97, 98, 99], 900))).astype(np.uint8)
    alone = suffixes.anchors(text, np.array([0, len(text)]))
    assert alone[1].max() <= suffixes.RUN and alone[1].sum() == len(text) - 199
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    both = suffixes.anchors(np.concatenate((text[:333], text)), np.array([0, 333, 333 + len(text)]))
    mine = both[0] >= 333
    assert all((x[mine] == y).all() for x, y in zip((both[0] - 333, *both[1:]), alone))


def test_a_large_group_of_near_copies_costs_no_pairs(spark, monkeypatch):
    """Two families share bands, so one cluster of several blocks holds both; only the smaller part meets the others."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(400)]
    far = [w if k % 9 else f"v{k}" for k, w in enumerate(base)]
    rows = []
    for d in range(400):
        w = list(base if d % 20 else far)
        w[int(rng.integers(400))] = f"own{d}"
        rows.append((d, " ".join(w)))
    met = []
    plain = neardup._links
    monkeypatch.setattr(neardup, "_links", lambda percent: met.append(percent) or plain(percent))
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=3, percent=85, n_bands=64, rows=2).collect()}
    assert out == {d: 0 if d % 20 == 0 else 1 for d in range(400)} and met
