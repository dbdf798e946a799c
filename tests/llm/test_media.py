import struct
import zlib

import numpy as np
from millrace.llm import media


def scene(seed, size=120):
    r = np.random.default_rng(seed)
    x = np.zeros((size, size))
    for _ in range(40):
        a, b = sorted(r.integers(0, size, 2)), sorted(r.integers(0, size, 2))
        x[a[0] : a[1], b[0] : b[1]] = r.integers(20, 220)
    return x


def pgm(x):
    return b"P5\n# made here\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + np.clip(x, 0, 255).astype(np.uint8).tobytes()


def png(x, filters=(0, 1, 2, 3, 4)):
    x = np.clip(x, 0, 255).astype(np.uint8)
    rows, before = b"", np.zeros(x.shape[1], int)
    for y, row in enumerate(x.astype(int)):
        f, left = filters[y % len(filters)], np.concatenate([[0], row[:-1]])
        corner = np.concatenate([[0], before[:-1]])
        p = left + before - corner
        d = np.stack([abs(p - left), abs(p - before), abs(p - corner)]).argmin(axis=0)
        guess = {0: 0 * row, 1: left, 2: before, 3: (left + before) // 2, 4: np.choose(d, [left, before, corner])}[f]
        rows += bytes([f]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        before = row
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_formats():
    x = scene(1)
    assert (media.grey(pgm(x)) == x).all() and (media.grey(png(x)) == x).all()
    colour = b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 0, 255])
    assert np.allclose(media.grey(colour), [[76.245, 29.07]])
    for bad in (None, b"", b"P5 9 9 255\nabc", b"\x89PNG\r\n\x1a\nrubbish", b"GIF89a", pgm(x)[:500]):
        assert media.grey(bad) is None


def test_turned_patches_keep_their_descriptors():
    x = scene(2)
    a, b = media.features(x), media.features(np.rot90(x).copy())
    near = [bin(int("".join(f"{e:032b}" for e in w), 2) ^ int("".join(f"{e:032b}" for e in v), 2)).count("1") for w in a[1] for v in b[1]]
    assert 4 <= len(a[1]) <= sum(n < 40 for n in near)


def test_consensus_needs_one_similarity():
    r = np.random.default_rng(0)
    a = np.column_stack([r.uniform(0, 100, (12, 2)), r.uniform(-3, 3, 12), np.ones(12)])
    b = a.copy()
    turn = 0.5
    m = 0.7 * np.exp(-1j * turn)
    z = m * (a[:, 0] + 1j * a[:, 1]) + (4 + 9j)
    b[:, 0], b[:, 1], b[:, 2], b[:, 3] = z.real, z.imag, a[:, 2] - turn, 1 / 0.7  # a smaller picture shows a thing at a finer level
    assert media.consensus(a, b) == 12
    assert media.consensus(a, b[r.permutation(12)]) < 6


def test_copies_are_found_and_others_left_alone(spark):
    rows = []
    for i in range(12):
        x = scene(10 + i)
        rows += [(i, pgm(x)), (100 + i, pgm(x[10:, 7:-9] * 0.8 + 25))]
    rows += [(200, png(scene(10))), (201, rows[2][1]), (300, None), (301, b""), (302, b"junk"), (None, b"junk2"), (303, pgm(np.zeros((80, 80))))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "media_id long, data binary, image string")
    got = {r.media_id: r for r in media.copies(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[100 + i].group_id == i for i in range(12)) >= 11
    assert all(got[i].group_id == i for i in range(12))
    assert got[200].group_id == 0 and got[201].group_id == 1
    assert [got[k].group_id for k in (300, 301, 302, 303)] == [300, 301, 302, 303] and got[303].n_features == 0
    assert media.copies(df.limit(0)).count() == 0


def test_every_near_pair_of_a_common_substring_is_tied():
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 32, (400, 8), dtype=np.uint32)
    words[:, 2] = 77  # a texture that all images have
    words[1::2] = words[::2]
    words[1::2, 3] ^= np.uint32(1 << 31)  # partners far apart in the order of the table
    place = r.permutation(400)
    words = words[place]
    image = np.arange(400) // 2
    near = lambda i, j: any(words[i, t] == words[j, t] and int(words[i, (t + 1) % 8] ^ words[j, (t + 1) % 8]).bit_count() <= media.BITS for t in range(8))
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if image[i] != image[j] and near(i, j)}
    assert len(want) > 150
    for limit in (media.PAIRS, 500):
        media.PAIRS, before = limit, media.PAIRS
        every = np.arange(400)
        got = [(int(i), int(j)) for x, y in media.tied(image, words, every, every) for i, j in zip(x, y, strict=True)]
        media.PAIRS = before
        assert len(got) == len(set(got)) and set(got) == want


def test_blocks_of_images_find_what_one_block_finds(spark):
    rows = [(k, pgm(scene(10 + i) if k < 100 else scene(10 + i)[10:, 7:-9] * 0.8 + 25)) for i in range(8) for k in (i, 100 + i)]
    found = media.describe(spark.createDataFrame(rows, "image long, data binary"))
    pairs = [{tuple(sorted(r)) for r in media.verified(found, media.VOTES, media.INLIERS, block).collect()} for block in (1 << 17, 100)]
    assert pairs[0] == pairs[1] and len({(i, 100 + i) for i in range(8)} & pairs[0]) >= 7


def linked(pictures):
    """The pairs of pictures, by number, that are verified as copies."""
    found = [media.features(x) for x in pictures]
    n = [len(f[0]) for f in found]
    columns = np.concatenate([media.folded(f[0]) for f in found]), np.concatenate([f[1] for f in found]).astype(np.uint32)
    return {(int(a), int(b)) for a, b in media.alike(np.repeat(np.arange(len(n)), n), *columns, np.zeros(sum(n), int), media.VOTES, media.INLIERS)}


def blocks(seed, size=40):
    return np.kron(np.random.default_rng(seed).integers(20, 220, (size, size)), np.ones((9, 9)))


def test_small_crops_of_large_pictures_are_found():
    for i in range(6):
        x, side = blocks(50 + i), (120, 150, 180)[i % 3]  # 11, 17 and 25 percent
        crop = x[20 + 9 * i : 20 + 9 * i + side, 130 - 7 * i : 130 - 7 * i + side]
        assert linked([x, crop]) == {(0, 1)} and linked([blocks(60 + i, 20), crop]) == set()


def test_resized_and_turned_copies_are_found():
    for i, factor in enumerate((0.85, 0.7, 0.6)):
        x = blocks(70 + i, 30)
        assert linked([x, media.resize(x, factor)]) == {(0, 1)}
    x = blocks(80)  # 360 pixels, turned by 10 degrees
    i, j = np.mgrid[: len(x), : len(x)] - len(x) / 2
    c, s = np.cos(np.pi / 18), np.sin(np.pi / 18)
    at = [np.clip(v + len(x) / 2, 0, len(x) - 1).astype(int) for v in (c * i + s * j, c * j - s * i)]
    assert linked([x, x[at[0], at[1]]]) == {(0, 1)}


def test_consensus_mends_scale_and_turn():
    r = np.random.default_rng(1)
    a = np.column_stack([r.uniform(0, 1000, (30, 2)), r.uniform(-3, 3, 30), np.ones(30)])
    z = 0.92 * np.exp(-0.3j) * (a[:, 0] + 1j * a[:, 1])
    b = np.column_stack([z.real, z.imag, a[:, 2] - 0.3 + r.normal(0, 0.05, 30), np.ones(30)])  # the level says 1, the angles are not exact
    assert media.consensus(a, b) == 30


def test_headers_that_promise_more_than_there_is():
    import struct
    import zlib

    assert media.grey(b"P5 99999999999999999999 99999999999 255\nabc") is None
    assert media.grey(b"P5 3 3 255\n12345678") is None and media.grey(b"P5 3 3 255\n123456789").shape == (3, 3)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + b"\0\0\0\0"
    head = lambda w, h: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
    assert media.grey(head(2**31, 2**31) + chunk(b"IDAT", zlib.compress(b"\0"))) is None
    assert media.grey(head(2, 2) + chunk(b"IDAT", zlib.compress(b"\0" * 50_000_000))) is None
    assert media.grey(head(2, 1) + chunk(b"IDAT", zlib.compress(b"\0ab"))).tolist() == [[97.0, 98.0]]


def mosaics(n, copied=()):
    """Pictures of random mosaics, as the query's, and an edited copy of each of the copied."""
    r = np.random.default_rng(9)
    vectors = [list(r.normal(size=64)) for _ in range(n)]
    return [media.grey(media.render(v, False)) for v in vectors] + [media.grey(media.render(vectors[i], True)) for i in copied]


def columns(pictures):
    found = [media.features(x) for x in pictures]
    n = [len(f[0]) for f in found]
    return np.repeat(np.arange(len(n)), n), np.concatenate([media.folded(f[0]) for f in found]), np.concatenate([f[1] for f in found]).astype(np.uint32)


def test_few_pairs_of_unlike_pictures_go_to_consensus(monkeypatch):
    image, place, words = columns(mosaics(40, (3, 17)))
    calls, agree = [], media.agree
    monkeypatch.setattr(media, "agree", lambda *a, **k: calls.append(1) or agree(*a, **k))
    assert set(media.alike(image, place, words, 0 * image, media.VOTES, media.INLIERS)) == {(3, 40), (17, 41)}
    assert len(calls) < 0.15 * 42 * 41 / 2  # nearly all of them, without a bound


def test_the_bound_is_no_less_than_what_agrees():
    far = np.kron(np.random.default_rng(1).integers(20, 220, (12, 12)), np.ones((9, 9)))
    image, place, words = columns([*mosaics(12, (3, 5)), far, media.resize(far, 0.8), far[20:, 10:], np.rot90(far).copy()])
    at, every, high = media.unfolded(place), np.arange(len(image)), 0
    for i, j in media.tied(image, words, every, every):
        first = np.flatnonzero(np.r_[True, (np.diff(image[i]) != 0) | (np.diff(image[j]) != 0)])
        for shift in (0.0, 30000.0):  # far from the origin as well
            move = np.array([shift, shift / 2, 0, 0])
            bound = media.hopeful(at[i] + move, at[j] + move, (place[j] & 15) - (place[i] & 15), first, 4)
            for x, y in zip(first, np.r_[first[1:], len(i)], strict=True):
                n = media.agree(at[i[x:y]], at[j[x:y]], least=4)[0]
                assert n < 4 or bound[x:y].max() >= n
                assert media.agree(at[i[x:y]], at[j[x:y]], least=4, bound=bound[x:y])[0] == (n if n >= 4 else 0)
                high += n >= 8
    assert high >= 5


def test_joined_images_are_not_compared_again(monkeypatch):
    x = mosaics(1)[0]
    image, place, words = columns([x * f + 3 for f in np.linspace(0.6, 1, 12)])
    pairs = media.alike(image, place, words, 0 * image, media.VOTES, media.INLIERS)
    calls, agree = [], media.agree
    monkeypatch.setattr(media, "agree", lambda *a, **k: calls.append(1) or agree(*a, **k))
    tree = media.alike(image, place, words, 0 * image, media.VOTES, media.INLIERS, forest=True)
    assert len(pairs) == 66 and len(tree) == len(calls) == 11 and {v for p in tree for v in p} == set(range(12))


def test_turns_around_nought_stay_together():
    turn, group = np.array([0.0, 3.0, -1e-18, 0.1, -0.2, 3.1, 6.2, 0.0]), np.array([1, 1, 1, 1, 1, 1, 1, 0])
    ties, part = media.together(turn, group, np.arange(8))
    assert sorted(sorted(ties[part == p].tolist()) for p in np.unique(part)) == [[0, 2, 3, 4, 6], [1, 5], [7]]
