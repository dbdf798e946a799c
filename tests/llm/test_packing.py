import random
import zlib
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import packing

BITS = ["the", " ", "  ", "\n", "\n\n", "\t", "don't", "é", "12", ".", "!!", " a", "x.", "y,", "<|endoftext|>", "'ll", "ﬁ", "日本", " ", "…", "A", "½", "\r\n", "́"]


@pytest.fixture(scope="module")
def ids():
    return packing.Ids(packing.default_tokenizer())


@pytest.fixture(scope="module")
def plain(ids):
    """The ids by the tokenizer itself."""
    return lambda text: array("I", ids.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("seed", range(6))
def test_ids_equal_the_tokenizer(ids, plain, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(400)]
    assert [ids(t) for t in texts] == [plain(t) for t in texts]


def test_ids_of_every_code_point(ids, plain):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 512):
        text = "".join(f"a{c}b {c}{c}1{c}. {c}" for c in points[i : i + 512])
        assert ids(text) == plain(text)


def test_ids_of_long_runs(ids, plain):
    for text in (" " * 50_000, "a" * 20_000, " \n" * 20_000 + "x", "!" * 20_000, "7" * 20_000, "the " * 20_000):
        assert ids(text) == plain(text)


def test_place_takes_the_cheapest_sequence_with_room():
    r = random.Random(3)
    lengths = sorted((r.randint(1, 1023) for _ in range(900)), reverse=True)
    used, dear, count = {}, {}, -(-sum(lengths) // 1024)
    for i, start, n, k, offset in packing.place(lengths):
        if n < lengths[i]:
            break  # no sequence had room: cut, after all others
        fits = [(dear.get(x, 0.0), x) for x in range(count) if 1024 - used.get(x, 0) >= n]
        assert (start, offset) == (0, used.get(k, 0))
        assert min(fits)[1] == k
        used[k], dear[k] = used.get(k, 0) + n, dear.get(k, 0.0) + packing.cost(n)


@given(st.lists(st.integers(1, 63), max_size=60))
@settings(max_examples=200, deadline=None)
def test_place_fills_whole_sequences(lengths):
    lengths = [*lengths, *([64 - sum(lengths) % 64] if sum(lengths) % 64 else [])]
    places, used, got = list(packing.place(lengths, 64)), {}, {}
    for i, start, n, k, offset in places:
        used.setdefault(k, []).append((offset, n))
        got.setdefault(i, []).append((start, n))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64
    for i, parts in got.items():
        assert sum(n for _, n in parts) == lengths[i]


def test_costs_are_balanced():
    r = random.Random(0)
    lengths = [r.choice([16, 32, 48, 500, 512]) for _ in range(4000)]
    lengths += [1] * (-sum(lengths) % 1024)
    cost = {}
    for _, _, n, k, _ in packing.place(lengths):
        cost[k] = cost.get(k, 0) + packing.cost(n)
    mean = sum(cost.values()) / len(cost)
    assert max(cost.values()) < 1.5 * mean


@pytest.mark.parametrize("parts,block", [(1, 1 << 20), (5, 2000)])
def test_round_trip(spark, ids, parts, block):
    r = random.Random(1)
    docs = [(i, "".join(r.choice(BITS) for _ in range(r.choice([0, 3, 50, 1500, 4000])))) for i in range(120)] + [(500, None), (501, ""), (7, "a again"), (None, "no id")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, length int").repartition(parts)
    rows = packing.pack(df, block=block).collect()
    full: dict = {}
    for d, t in docs:
        full.setdefault(d, []).append(ids(t or "") + b"\0\0\0\0")
    total = sum(len(x) // 4 for v in full.values() for x in v)
    assert sum(p.length for p in rows) == total
    for p in rows:
        assert any(len(x) // 4 == p.doc_tokens and zlib.crc32(x[p.start * 4 : (p.start + p.length) * 4]) == p.ids_crc32 for x in full[p.doc_id])
    for d, v in full.items():
        if len(v) == 1:
            at = 0
            for p in sorted((p for p in rows if p.doc_id == d), key=lambda p: p.start):
                assert p.start == at
                at += p.length
            assert at == len(v[0]) // 4
    used: dict = {}
    for p in sorted(rows, key=lambda p: p.offset):
        assert used.setdefault(p.sequence_id, 0) == p.offset
        used[p.sequence_id] += p.length
    assert all(n <= 1024 for n in used.values())
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
    assert padding == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
