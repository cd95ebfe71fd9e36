import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import packing
from tokenizers import Tokenizer


def test_plan_packs_everything_once_and_tightly():
    rnd = random.Random(3)
    counts = Counter(min(2047, int(rnd.expovariate(1 / 500)) + 1) for _ in range(20_000))
    bins = packing.plan(dict(counts))
    used = Counter()
    for content, times in bins:
        assert 0 < sum(content) <= 2048
        for n in content:
            used[n] += times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in bins) <= -(-total // 2048) + 3


def first_fit_decreasing(lengths):
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, g in enumerate(gaps) if g >= n), None)
        if i is None:
            gaps.append(2048 - n)
        else:
            gaps[i] -= n
    return len(gaps)


def test_smallest_is_replaced_by_two_that_fit_tighter():
    # Greedy puts 60 + 35 into 100; 30 + 10 fill the gap without the 35.
    assert packing.plan({60: 1, 35: 1, 30: 1, 10: 1}, 100)[0] == ([60, 30, 10], 1)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_covers_any_histogram(counts):
    used = Counter()
    for content, times in packing.plan(counts, 64):
        assert sum(content) <= 64
        for n in content:
            used[n] += times
    assert used == Counter(counts)


def test_fast_ids_equal_the_tokenizers_file():
    encode = packing.Encoder(*packing.default_encoder())
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    samples = ["", "a", "  two  spaces\n\n\tx", "naïve café 北京 😀 don't 1234567", "x<|endoftext|>y", "\x00\x1f \u0085 ", "A" * 5000]
    samples += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 1500), rnd.randint(0x4E00, 0x4F00), 10, 32])) for _ in range(200)) for _ in range(200)]
    for s in samples:
        assert encode(s).tolist() == plain.encode(s, add_special_tokens=False).ids, repr(s)


def test_pieces_and_places(spark):
    rnd = random.Random(2)
    texts = [None, "", "hello world"] + [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([5, 50, 700, 6000]))) for _ in range(80)]
    texts += ["one copy"] * 60
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(None, "null id", 1), (7, texts[7], 2)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(4)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [(0, first), *((s, 2048) for s in range(first, len(ids), 2048))]
        want.update((d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cuts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= first_fit_decreasing([r.length for r in out])


def test_packing_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
