"""Copies of images, cropped or edited, by local descriptors.

Features: on a pyramid of scales, all Harris corners that are the largest around them and above a share of the
level's strongest, as many as the image has, so that a small crop keeps all of its own; each is turned by the direction to its
patch's centroid and described by 256 comparisons of smoothed pixel pairs. Brightness and contrast leave the comparisons alone, a crop leaves the patches inside it alone.

Join: a descriptor is cut into 8 substrings of 32 bits, each a Hamming table; two descriptors within 7 bits
share one for certain, farther ones often. Two features of different images that share a substring and differ
in at most BITS bits of the one after it are tied, all of them, however many share a value. Image pairs with
at least VOTES tied features go on to geometric consensus, where by a bound enough features could agree: each tie proposes a similarity (turn, scale, shift)
by its levels and angles, and with each tie that roughly fits it another by the two places, as levels are a
fixed step apart and angles not exact. The pair is a copy if at least INLIERS distinct features agree with the
best one within TOLERANCE pixels or REACH of the picture, whichever is more,
and SHARE of the features where the two overlap besides: pictures with more features agree more by chance.
Verified ties, joined, are the groups.

Plan: exact copies of the bytes are folded by digest first, with partial aggregation. Features are found in
one pass and written, one row an image. Images are dealt by hash to blocks of about BLOCK features, and each
pair of blocks is a task: a substring that a third of the features have is spread over all of them, and all
ties of two images meet in one task, so that verified image pairs only leave it. A task halves its blocks
until about PAIRS rows of the tables meet at once, and bounds all pairs of images of a part together: for each
tie, the distinct features that roughly fit it, which are no fewer than those that can agree. Images that a task has joined by
pairs before are not compared again, as groups need no more. Work grows with the pairs of features that share a
substring, which is the square of how many do; rows shuffled are images times blocks.

Media: binary PGM and PPM (P5, P6, 8 bits), and PNG of 8 bits without interlace, grey, RGB, with or without
alpha. Cases: null, empty or unreadable media and images without corners are groups of their own with 0
features; repeated rows and ids are exact copies; a group's id is the smallest in it, null if all are; ties
of corners go to the upper left; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batches, only, read, stash
from millrace.llm.jaccard import components

SCALES, PATCH, VOTES, INLIERS, TOLERANCE, SHARE, REACH, ROUGH, SEED = tuple(2 ** (-k / 4) for k in range(5)), 12, 4, 6, 3.0, 0.2, 0.01, 0.15, 5
TABLES, BITS, BLOCK, PAIRS, SECTORS, TIES, CHUNK = 8, 8, 1 << 17, 1 << 21, 16, 1 << 15, 1 << 16


#: Fixed value: the most that deflate makes of a byte.
DEFLATE = 1032


def png(data: bytes) -> np.ndarray | None:
    at, head, body = 8, None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(head[3]) if head else None
    if not channels or head[2] != 8 or head[6]:
        return None
    w, h, line = head[0], head[1], head[0] * channels
    size = h * (line + 1)
    if size > DEFLATE * len(body):  # more than such data can hold
        return None
    raw = np.frombuffer(zlib.decompressobj().decompress(body, size + 1), np.uint8).reshape(h, line + 1)
    out = np.zeros((h + 1, line + channels), np.int64)
    for y in range(h):
        row, up, kind = raw[y, 1:].astype(np.int64), out[y], raw[y, 0]
        mine = out[y + 1]
        if kind in (0, 2):
            mine[channels:] = (row + (up[channels:] if kind else 0)) & 255
        else:
            for x in range(line):
                a, b, c = mine[x], up[x + channels], up[x]
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                mine[x + channels] = (row[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
    return out[1:, channels:].reshape(h, w, channels)


def grey(data: bytes | None) -> np.ndarray | None:
    """The image as floats, or None if it can't be read."""
    try:
        if data and (m := re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)) and int(m[4]) < 256:
            w, h, c = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
            if w * h * c > len(data) - m.end():
                return None
            x = np.frombuffer(data, np.uint8, w * h * c, m.end()).reshape(h, w, c)
        elif data and data[:8] == b"\x89PNG\r\n\x1a\n":
            x = png(data)
        else:
            x = None
    except (ValueError, OverflowError, struct.error, zlib.error, TypeError):
        return None
    if x is None or not x.size:
        return None
    x = x.astype(float)
    return x[:, :, 0] if x.shape[2] < 3 else x[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def resize(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, int(n * scale)) for n in x.shape)
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, x.shape[0]), (w, x.shape[1]))]
    low = [np.floor(a).astype(int) for a in at]
    high = [np.minimum(i + 1, m - 1) for i, m in zip(low, x.shape, strict=True)]
    fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None]
    top = x[np.ix_(low[0], low[1])] * (1 - fx) + x[np.ix_(low[0], high[1])] * fx
    bottom = x[np.ix_(high[0], low[1])] * (1 - fx) + x[np.ix_(high[0], high[1])] * fx
    return top * (1 - fy) + bottom * fy


def smooth(x: np.ndarray) -> np.ndarray:
    """Binomial weights over 5 x 5."""
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        part = [p.take(range(k, k + n), axis) for k in range(5)]
        x = (part[0] + part[4] + 4 * (part[1] + part[3]) + 6 * part[2]) / 16
    return x


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Response, row and column of the corners whose patches lie inside."""
    dy, dx = np.gradient(x)
    a, b, c = smooth(dx * dx), smooth(dx * dy), smooth(dy * dy)
    r = a * c - b * b - 0.05 * (a + c) ** 2
    p = np.pad(r, 2, constant_values=-np.inf)
    h, w = r.shape
    rows = np.maximum.reduce([p[k : k + h] for k in range(5)])
    around = np.maximum.reduce([rows[:, k : k + w] for k in range(5)])
    keep = (r == around) & (r > 1e-3 * max(r.max(), 1e-9)) & (r > 1.0)
    edge = PATCH + 3
    keep[:edge], keep[-edge:], keep[:, :edge], keep[:, -edge:] = False, False, False, False
    y, x_ = np.nonzero(keep)
    return r[y, x_], y, x_


@functools.lru_cache(maxsize=1)
def tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """256 pixel pairs, and the offsets of the disc whose centroid gives the direction."""
    pairs = np.clip(np.random.default_rng(SEED).normal(0, PATCH / 2.2, (2, 256, 2)), -PATCH * 0.7, PATCH * 0.7)
    y, x = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
    disc = np.stack([y, x], axis=-1)[y * y + x * x <= PATCH * PATCH]
    return pairs[0], pairs[1], disc


def features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (x, y, angle, scale) in the image's own pixels, and of TABLES 32-bit substrings."""
    first, second, disc = tests()
    found, levels = [], []
    for level, scale in enumerate(SCALES):
        small = smooth(resize(x, scale) if scale != 1 else x)
        levels.append(small)
        if min(small.shape) > 2 * PATCH + 6:
            found += [(-r, level, i, j) for r, i, j in zip(*(v.tolist() for v in corners(small)), strict=True)]
    found.sort()
    places, bits = [np.empty((0, 4))], [np.empty((0, 256), bool)]
    for level, scale in enumerate(SCALES):
        small, own = levels[level], [(i, j) for _, at, i, j in found if at == level]
        if not own:
            continue
        i, j = np.array(own).T[:, :, None]
        patch = small[i + disc[:, 0], j + disc[:, 1]]
        weight = patch - patch.mean(axis=1, keepdims=True)
        angle = np.arctan2(weight @ disc[:, 0], weight @ disc[:, 1])
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        at = [(i + np.rint(cos * t[:, 0] + sin * t[:, 1]).astype(int), j + np.rint(cos * t[:, 1] - sin * t[:, 0]).astype(int)) for t in (first, second)]
        bits.append(small[at[0]] + 0.05 * patch.std(axis=1, keepdims=True) < small[at[1]])  # flat parts give 0, not noise
        h, w = x.shape[0] / small.shape[0], x.shape[1] / small.shape[1]
        places.append(np.column_stack([(j[:, 0] + 0.5) * w, (i[:, 0] + 0.5) * h, angle, np.full(len(angle), scale)]))
    return np.concatenate(places), np.packbits(np.concatenate(bits), axis=1).view(">u4").astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values are together, and where each begins in it."""
    order = np.argsort(values)
    values = values[order]
    return order, np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def agree(a: np.ndarray, b: np.ndarray, tolerance: float = TOLERANCE, least: int = 1, enough=lambda *found: False, bound=None) -> tuple[int, complex, complex]:
    """The most distinct features of a and of b that one similarity takes onto each other, and its factor and
    shift from b to a; rows are ties, and ``bound`` is the most that each can find. Fewer than ``least`` may be told
    as 0; the first that is ``enough`` is taken."""
    turn, scale = a[:, 2] - b[:, 2], b[:, 3] / a[:, 3]
    best, w, z = (0, 1 + 0j, 0j), a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    tolerance = max(tolerance, REACH * float(np.ptp(a[:, :2], axis=0).max()))
    m, levels = scale * np.exp(1j * turn), np.log(scale)
    tried = np.arange(len(a)) if bound is None else np.flatnonzero(bound >= least)
    for part in np.array_split(tried, -(-len(tried) // 256) or 1):
        dz, dw = z - z[part, None], w - w[part, None]
        put = m[part, None] * dz
        rough = np.abs(put - dw) <= np.maximum(tolerance, ROUGH * np.abs(put))
        rough &= (np.abs(levels - levels[part, None]) < 0.2) & (np.cos(turn - turn[part, None]) > 0.95)
        size = rough.sum(axis=1)
        most = size if bound is None else np.minimum(size, bound[part])
        for row in np.argsort(-size):
            if size[row] <= best[0] or size[row] < least:
                break
            if most[row] <= best[0] or most[row] < least:
                continue
            use = np.flatnonzero(rough[row])
            one, two = dz[row, use], dw[row, use]
            far = np.abs(one) > tolerance
            proposed = np.append(m[part[row]], two[far] / one[far])  # by the tie alone, and by it and each other one
            order, ends = zip(*(distinct(v[use]) for v in (w, z)), strict=True)
            for some in np.array_split(proposed, -(-len(proposed) * len(use) // (1 << 20))):
                near = np.abs(some[:, None] * one - two) <= tolerance
                count = near.sum(axis=1)
                several = np.flatnonzero((count > best[0]) & (count >= least))
                near, count = near[several], count[several]
                n = np.minimum(*(np.logical_or.reduceat(near[:, o], e, axis=1).sum(axis=1) for o, e in zip(order, ends, strict=True)))
                for i in np.argsort(-count):
                    if n[i] > best[0]:
                        best = int(n[i]), some[several[i]], w[part[row]] - some[several[i]] * z[part[row]]
                        if n[i] >= least and enough(*best):
                            return best
    return best


def consensus(a: np.ndarray, b: np.ndarray, tolerance: float = TOLERANCE) -> int:
    return agree(a, b, tolerance)[0]


def overlap(a: np.ndarray, b: np.ndarray, factor: complex, shift: complex, slack: float = TOLERANCE) -> int:
    """How many features of a and of b, the fewer, lie where the similarity lays the two pictures' features on
    each other, of the levels that both have at its scale."""
    size = abs(factor)
    both = lambda x: (x > SCALES[-1] * 0.92) & (x < SCALES[0] * 1.09)
    w, z = ((x[:, 0] + 1j * x[:, 1]) for x in (a, b))
    shown = both(b[:, 3] / size), both(a[:, 3] * size)
    inside = lambda x, y, use: int((use & (x.real >= y.real.min() - slack) & (x.real <= y.real.max() + slack) & (x.imag >= y.imag.min() - slack) & (x.imag <= y.imag.max() + slack)).sum())
    return min(inside(factor * z + shift, w, shown[0]), inside((w - shift) / factor, z, shown[1]))


def folded(places: np.ndarray) -> np.ndarray:
    """A place in one integer: x and y in eighths of a pixel, the angle in 2^16 parts of a turn, the level."""
    x, y = (np.clip(np.rint(places[:, k] * 8), 0, (1 << 20) - 1).astype(np.int64) for k in (0, 1))
    angle = np.rint((places[:, 2] % (2 * np.pi)) / (2 * np.pi) * 65536).astype(np.int64) % 65536
    level = np.array([SCALES.index(v) for v in places[:, 3]], dtype=np.int64)
    return x << 40 | y << 20 | angle << 4 | level


def unfolded(place: np.ndarray) -> np.ndarray:
    scale = np.array(SCALES)[place & 15]
    return np.stack([(place >> 40) / 8, (place >> 20 & ((1 << 20) - 1)) / 8, (place >> 4 & 65535) * (2 * np.pi / 65536), scale], axis=1)


def describe(media: DataFrame) -> DataFrame:
    """image, n, places, words: one row an image with features, of images with columns image (a number of theirs) and data."""

    def run(source):
        for batch in batches(source, 128):
            rows = []
            for image, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = grey(data)
                if x is not None and len((found := features(x))[0]):
                    rows.append((image, len(found[0]), folded(found[0]).tobytes(), found[1].astype(np.uint32).tobytes()))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["image", "n", "places", "words"])

    return media.mapInArrow(run, "image long, n long, places binary, words binary")


def halves(image: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    """The features f, in order of their images, in two parts of whole images; one part if they are of one image."""
    cuts = np.flatnonzero(np.diff(image[f])) + 1
    return np.split(f, [cuts[np.abs(cuts - len(f) // 2).argmin()]]) if len(cuts) else [f]


def tied(image: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The ties of features a with features b, as two arrays at a time, all ties of two images together and in
    order; if a is b, those of each two images once."""
    same, found = a is b, []
    if same and image[a[0]] == image[a[-1]]:
        return
    for t in range(TABLES):
        mine, order = (a[np.argsort(words[a, t])], b[np.argsort(words[b, t])])
        key, row = words[mine, t], words[order, t]
        low = np.searchsorted(row, key)
        found.append((mine, order, low, np.searchsorted(row, key, "right") - low))
    # a tie in one integer, in the order of its two images
    wide = [int(x[-1] - x[0] + 1).bit_length() for x in (a, b)]
    if sum(int(n.sum()) for *_, n in found) > PAIRS or int(image[a[-1]] - image[a[0]]).bit_length() + sum(wide) > 62:
        one, two = halves(image, a), halves(image, b)
        if same:
            yield from tied(image, words, one[0], one[0])
            yield from tied(image, words, *one)
            yield from tied(image, words, one[1], one[1])
            return
        if len(one) + len(two) > 2:
            split = len(two) == 1 or len(one) == 2 and len(a) > len(b)
            for part in one if split else two:
                yield from tied(image, words, *((part, b) if split else (a, part)))
            return
    out = []
    for t, (mine, order, low, n) in enumerate(found):
        i = np.repeat(mine, n)
        j = order[np.arange(len(i)) + np.repeat(low + n - np.cumsum(n), n)]
        one, two = image[i], image[j]
        other = words[:, (t + 1) % TABLES]
        good = (one < two if same else one != two) & (np.bitwise_count(other[i] ^ other[j]) <= BITS)
        i, j, one = i[good], j[good], one[good]
        out.append((one - image[a[0]] << wide[1] | j - b[0]) << wide[0] | i - a[0])
    ties = np.sort(np.concatenate(out))
    ties = ties[np.r_[True, ties[1:] != ties[:-1]]] if len(ties) else ties
    yield (ties & (1 << wide[0]) - 1) + a[0], (ties >> wide[0] & (1 << wide[1]) - 1) + b[0]


def crowded(turn: np.ndarray, level: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """The ties that have at least so many, with themselves, of a turn and a level that one consensus could take in."""
    steps = 2 * len(SCALES) + 1
    cell = (group * steps + level + len(SCALES)) * SECTORS + np.floor(turn / (2 * np.pi) % 1 * SECTORS).astype(np.int64) % SECTORS
    n = np.bincount(cell, minlength=(group[-1] + 1) * steps * SECTORS).astype(np.int32).reshape(-1, steps, SECTORS)
    n = n + np.roll(n, 1, axis=2) + np.roll(n, -1, axis=2)
    n[:, 1:-1] = n[:, :-2] + n[:, 1:-1] + n[:, 2:]
    return n.reshape(-1)[cell] >= least


def together(turn: np.ndarray, group: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ties by group, in parts whose turns are too far from other parts' for one consensus, and their parts."""
    turn = turn / (2 * np.pi) % 1 % 1  # a little under 0 is 1 after the first
    order = np.argsort(group << 32 | (turn * (1 << 32)).astype(np.int64))
    group, turn = group[order], turn[order]
    change, apart = group[1:] != group[:-1], 0.051  # more than the turn whose cosine is 0.95
    part = np.cumsum(np.append(0, change | (np.diff(turn) > apart)))
    first = np.flatnonzero(np.append(True, change))
    last = np.append(first[1:], len(turn)) - 1
    name = np.arange(part[-1] + 1)
    round_ = turn[first] + 1 - turn[last] <= apart
    name[part[last[round_]]] = part[first[round_]]
    part = name[part]
    again = np.argsort(part, kind="stable")
    return ties[order[again]], part[again]


def hopeful(a: np.ndarray, b: np.ndarray, level: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Of ties with places a and b, how many distinct features of a and of b roughly fit each, 0 for fewer than
    least: a bound of what agree finds by it, for many pairs of images at a time, whose ties begin at first."""
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(a)]))
    span = np.maximum.reduceat(a[:, :2], first) - np.minimum.reduceat(a[:, :2], first)
    slack = (np.maximum(TOLERANCE, REACH * span.max(axis=1)) * 1.001) ** 2
    turn, out = a[:, 2] - b[:, 2], np.zeros(len(a), np.int64)
    left = np.flatnonzero(crowded(turn, level, group, least))
    if not len(left):
        return out
    left, part = together(turn[left], group[left], left)
    many = np.bincount(part)[part] >= least
    left, part = left[many], part[many]
    if not len(left):
        return out
    a, b, turn, level, group = a[left], b[left], turn[left], level[left], group[left]
    spots = [np.rint(x[:, 0] * 8).astype(np.int64) << 20 | np.rint(x[:, 1] * 8).astype(np.int64) for x in (a, b)]
    start = np.flatnonzero(np.r_[True, np.diff(part) != 0])
    count = np.diff(np.r_[start, len(left)])
    # places from the first tie's, for single precision; what it rounds is far less than what is added to slack
    at = np.concatenate([a[:, :2], b[:, :2]], axis=1)
    x, y, u, v = (at - np.repeat(at[start], count, axis=0)).T
    scale, c, s = b[:, 3] / a[:, 3], np.cos(turn), np.sin(turn)
    cs, ss, far = scale * c, scale * s, u * u + v * v
    slack = slack[group[start]] + 4e-6 * np.maximum.reduceat(x * x + y * y + 4 * far, start)
    rough, one = (ROUGH * 1.001 * scale) ** 2, np.ones(len(left))
    # products of a row of one tie and a column of another: where its similarity puts it, how far, and cosine less levels
    rows = (cs, -ss, -one, x - cs * u + ss * v), (ss, cs, -one, y - ss * u - cs * v), (-2 * rough * u, -2 * rough * v, rough, rough * far), (c, s, 0.034 * level, -0.017 * one, -0.017 * level**2)
    columns = (u, v, x, one), (u, v, y, one), (u, v, far, one), (c, s, level, level**2, one)
    factors = np.empty((len(left), 34), np.float32)
    values = [v for part in (*rows, *columns) for v in part]
    for k in range(0, len(left), 4096):  # as much as a processor's cache holds
        for n, value in enumerate(values):
            factors[k : k + 4096, n] = value[k : k + 4096]
    ends = (0, 4, 8, 12, 17)
    size = -(-count // 8) * 8
    for k in np.unique(size):
        pairs = np.flatnonzero(size == k)
        if k > 512:  # such pairs are few and large: agree goes through them in parts
            for g in pairs:
                out[left[start[g] : start[g] + count[g]]] = count[g]
            continue
        for some in np.array_split(pairs, -(-len(pairs) * k * k // CHUNK)):
            tie = start[some, None] + np.minimum(np.arange(k), count[some, None] - 1)
            there = np.arange(k) < count[some, None]
            f = factors.take(tie, axis=0)
            dx, dy, reach, turned = (f[:, :, i:j] @ f[:, :, 17 + i : 17 + j].transpose(0, 2, 1) for i, j in itertools.pairwise(ends))
            dx *= dx
            dy *= dy
            dx += dy
            np.maximum(reach, slack[some, None, None].astype(np.float32), out=reach)
            fits = dx <= reach
            fits &= turned > np.float32(0.932)  # cosine over 0.95, level at most one step apart
            fits &= there[:, None]
            row = np.flatnonzero((fits.sum(axis=2, dtype=np.int16) >= least) & there)
            if not len(row):
                continue
            n, q = np.nonzero(fits.reshape(-1, k)[row])
            q = tie[row[n] // k, q]
            most = np.full(len(row), k)
            for spot in spots:
                key = np.sort(n << 40 | spot[q])
                key = key[np.r_[True, key[1:] != key[:-1]]]
                most = np.minimum(most, np.bincount(key >> 40, minlength=len(row)))
            out[left[tie.ravel()[row]]] = most * (most >= least)
    return out


def alike(image: np.ndarray, place: np.ndarray, words: np.ndarray, sides: np.ndarray, votes: int, inliers: int, forest: bool = False):
    """Pairs of images, by number, that consensus verifies; of two sides only those across; forest: of images
    that the pairs found so far join, no more."""
    at, found = unfolded(place), []
    start = np.searchsorted(image, np.arange(image[-1] + 2))
    parts = [np.flatnonzero(sides == s) for s in np.unique(sides)]
    root = np.arange(image[-1] + 1)  # the smallest number of those joined
    for i, j in tied(image, words, parts[0], parts[-1]):
        if not len(i):
            continue
        first = np.flatnonzero(np.r_[True, (np.diff(image[i]) != 0) | (np.diff(image[j]) != 0)])
        count = np.diff(np.r_[first, len(i)])
        many = count >= max(votes, inliers)
        if forest:
            many &= root[image[i[first]]] != root[image[j[first]]]
        if not many.any():
            continue
        use = np.repeat(many, count)
        i, j, count = i[use], j[use], count[many]
        first = np.cumsum(count) - count
        bound = np.empty(len(i), np.int64)
        for some in np.split(first, np.flatnonzero(np.diff(first // TIES)) + 1):  # what a cache holds, and little memory
            k = slice(some[0], some[-1] + count[np.searchsorted(first, some[-1])])
            bound[k] = hopeful(at[i[k]], at[j[k]], (place[j[k]] & 15) - (place[i[k]] & 15), some - some[0], inliers)
        for g in np.flatnonzero(np.maximum.reduceat(bound, first)):
            ties = slice(first[g], first[g] + count[g])
            x, y = i[ties], j[ties]
            if forest and root[image[x[0]]] == root[image[y[0]]]:
                continue
            one, two = (at[start[image[v[0]]] : start[image[v[0]] + 1]] for v in (x, y))
            copy = lambda n, factor, shift, one=one, two=two: n >= inliers + SHARE * overlap(one, two, factor, shift)
            if copy(*agree(at[x], at[y], least=inliers, enough=copy, bound=bound[ties])):
                found.append((image[x[0]], image[y[0]]))
                if forest:
                    both = root[image[x[0]]], root[image[y[0]]]
                    root[root == max(both)] = min(both)
    return found


def verified(rows: DataFrame, votes: int, inliers: int, block: int = BLOCK, forest: bool = False) -> DataFrame:
    """a, b: the pairs of images that are copies, or as many as join the same groups; rows as describe gives them."""
    total = rows.agg(F.sum("n")).first()[0] or 1
    blocks = max(-(-total // block), min(8, -(-total // 4096)))  # some tasks also for few images
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("image"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "image", "places", "words")

    def run(source):
        held, key = [], None

        def close():
            found = []
            if held and (key[0] == key[1] or held[0][0] != held[-1][0]):
                sides, names, places, words = zip(*held, strict=True)
                n = [len(p) // 8 for p in places]
                image = np.repeat(np.arange(len(n)), n)
                columns = np.frombuffer(b"".join(places), np.int64), np.frombuffer(b"".join(words), np.uint32).reshape(-1, TABLES)
                found = [(names[x], names[y]) for x, y in alike(image, *columns, np.repeat(sides, n), votes, inliers, forest)]
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches(source, 512):
            for i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != key:
                    yield close()
                    held, key = [], (i, j)
                held.append(row)
        yield close()

    order = ("i", "j", "own", "image")
    return dealt.repartition(blocks * (blocks + 1), "i", "j").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def copies(media: DataFrame, votes: int = VOTES, inliers: int = INLIERS) -> DataFrame:
    """media_id, group_id, n_features of media with columns media_id, data; one row each."""
    digest = F.unhex(F.sha2(F.coalesce("data", F.lit(b"")), 256))
    named = media.select("media_id", digest.alias("digest"), "data")
    classes = named.groupBy("digest").agg(F.min("media_id").alias("class_id"), F.first("data").alias("data")).withColumn("image", F.xxhash64("digest"))
    # images are few bytes for their work: a count of tasks of its own, which Spark does not lower by bytes
    tasks = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stash(describe(classes.select("image", "data").repartition(tasks, "image")))
    parts = components(verified(rows, votes, inliers, forest=True))
    parts = stash(parts.union(parts.select(F.col("root").alias("node"), "root").distinct()))
    names = classes.select("digest", "image", "class_id")
    least = parts.join(names, F.col("node") == F.col("image")).groupBy("root").agg(F.min("class_id").alias("least"))
    groups = parts.join(least, "root").select(F.col("node").alias("image"), "least")
    counts = rows.select("image", "n")
    out = named.select("media_id", "digest").join(names, "digest").join(groups, "image", "left").join(counts, "image", "left")
    none = F.col("digest") == F.unhex(F.sha2(F.lit(b""), 256))
    return out.select("media_id", F.when(none, F.col("media_id")).otherwise(F.coalesce("least", "class_id")).alias("group_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_features"))


def render(v: list | None, edited: bool) -> bytes | None:
    """The test corpus's picture of a vector: a mosaic of its components as P5; edited: cropped, brighter, flatter."""
    if not v or any(e is None or not np.isfinite(e) for e in v):
        return None
    x = np.array(v, dtype=float)
    side = int(np.ceil(np.sqrt(len(x))))
    x = np.pad(x, (0, side * side - len(x))).reshape(side, side)
    x = np.kron(np.argsort(np.argsort(x.ravel())).reshape(side, side) * (200.0 / x.size), np.ones((12, 12)))
    if edited:
        x = x[9:-5, 14:-3] * 0.8 + 40
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.clip(x, 0, 255).astype(np.uint8).tobytes()


def pictures(vectors: DataFrame) -> DataFrame:
    """media_id, data: every vector's picture; that of each id with remainder 7 by 20 is an edited copy of the one before it."""

    def run(source):
        for batch in batches(source, 512):
            ids, v, edited = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([render(x, e) for x, e in zip(v, edited, strict=True)], pa.binary())], ["media_id", "data"])

    edited = F.coalesce(F.col("vec_id") % 20 == 7, F.lit(False))
    before = vectors.filter("vec_id % 20 = 6").select((F.col("vec_id") + 1).alias("of"), F.col("v").alias("w"))
    rows = vectors.join(before, F.col("vec_id") == F.col("of"), "left")
    rows = rows.select("vec_id", F.when(edited, F.coalesce("w", "v")).otherwise(F.col("v")).alias("v"), edited.alias("edited"))
    return rows.mapInArrow(run, "media_id long, data binary")


def query(spark, sf_dir):
    return copies(pictures(only(read(spark, sf_dir, "embeddings"), vec_id="vec_id", v="embedding")))
