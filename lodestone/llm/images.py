"""Copies of images by local descriptors, also cropped, turned or edited ones.

The column holds 8-bit grey PNG images. Key points are corners (Harris) at full and half size, each the strongest within
`APART` pixels around, or within `CLOSE` in images of at most `SMALL` pixels, whose key points are thus all that a larger
image has in the same region and more. Each is described by 64 comparisons of smoothed pixels, turned to the direction of the patch's
centre of mass. Descriptors are joined by Hamming tables: of the `TABLES` parts of one, two that differ in fewer than
TABLES bits share a part. Two images are copies if

* they share `LEAST` distinct parts and a fifth (`PARTS`) of the parts of the one with fewer, and
* their key points with a part in common, at most `FAR` bits apart in all, agree on one turn, scale and shift (within
  windows of `NEAR` pixels, half over each other): at least LEAST of them, and `SHARE` of the key points of the one with
  fewer. A part that stands in several places of an image is matched in the order of the places, once from the top and
  once from the bottom, so the work grows with the number of key points and not with its square.

Equal images form a class. Sketches of their parts tie classes to leaders of groups in a few rounds, and what is
confirmed gives groups. What the groups have left apart is then compared in full: of the parts that occur in
several groups, in each image in the order rarest first, a pair shares `EXTRA` + 1 after which nearly a fifth of the
smaller image's parts follow in both, and only such pairs meet. Lists are split into blocks of `BLOCK`.

The tables at hand hold no media, so `render` draws each page: a square of 4 by 4 pixels for every word of the whole
page, by the word's hash, 16 to a row. Equal passages of pages are then equal regions of images, shifted by other text.
Edges are repeated outwards, so key points lie up to the border and pages of some dozen words have enough of them.

Null, empty and unreadable images have no key points: they are linked with nothing. Images with fewer than LEAST key
points are linked with equal ones only. Null ids are left out of the links. Rows that repeat an id are versions of one
image: their links join one group. Very tall images are worked on in bands of rows that overlap, very many key points in
runs. An empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import common, words
from lodestone.llm.neardup import components

APART, CLOSE, SMALL, TABLES, FAR, LEAST, PARTS, SHARE, NEAR = 9, 6, 4096, 2, 8, 5, 0.2, 0.3, 8
BLOCK, SKETCH, FEW, TOGETHER, EXTRA = 1024, 8, 16, 64, 2
MARGIN, SUPPORT, RUN_PIXELS = 11, 32, 1 << 18
BITS = 26
_rng = np.random.default_rng(10)
_PAIRS = np.clip(np.round(_rng.normal(0, 2.6, (64, 4))), -5, 5)
_FACTORS = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Offsets of the compared pixels for each of the twelve turns: (turn, y and x of the first, y and x of the second, test).
_TURNED = np.array([[np.round(f(t)) for px, py in ((_PAIRS[:, 0], _PAIRS[:, 1]), (_PAIRS[:, 2], _PAIRS[:, 3])) for f in (lambda a, px=px, py=py: np.sin(a) * px + np.cos(a) * py, lambda a, px=px, py=py: np.cos(a) * px - np.sin(a) * py)] for t in np.arange(12) * np.pi / 6]).astype(np.int64)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    h, w = pixels.shape

    def chunk(kind: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))

    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def pixels_of(content: bytes | None) -> np.ndarray | None:
    """The pixels of an 8-bit grey PNG without interlacing; None for anything else."""
    try:
        if content[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, data, shape = 8, b"", None
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            part = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
                if depth != 8 or colour or interlace:
                    return None
                shape = h, w
            elif kind == b"IDAT":
                data += part
            at += 12 + size
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], shape[1] + 1)
        out = rows[:, 1:].copy()
        for y in np.flatnonzero(rows[:, 0]):
            above = out[y - 1].astype(int) if y else np.zeros(shape[1], int)
            if rows[y, 0] == 2:
                out[y] = out[y] + above.astype(np.uint8)
                continue
            left = corner = 0
            for x in range(shape[1]):
                up = int(above[x])
                nearest = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                left = (int(rows[y, x + 1]) + {1: left, 3: (left + up) // 2, 4: nearest}[int(rows[y, 0])]) & 255
                corner, out[y, x] = up, left
        return out
    except (TypeError, ValueError, KeyError, struct.error, zlib.error):
        return None

def _sum3(x: np.ndarray) -> np.ndarray:
    """Sums over 3 by 3 pixels, of all but the outermost pixels."""
    rows = x[:-2] + x[1:-1]
    rows += x[2:]
    out = rows[:, :-2] + rows[:, 1:-1]
    out += rows[:, 2:]
    return out


def _highest(x: np.ndarray, r: int, known: int = 0) -> np.ndarray:
    """The maximum within r pixels around, both ways, of all pixels that have as many around them. x may be that within `known`."""
    for rows in (True, False):
        wide = 2 * known + 1
        while wide < 2 * r + 1:  # x[i] is the maximum over i .. i + wide - 1
            step = min(wide, 2 * r + 1 - wide)
            x = np.maximum(x[:-step], x[step:]) if rows else np.maximum(x[:, :-step], x[:, step:])
            wide += step
    return x


def key_points(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image its key points in the order of rows and columns: x, y, scale and turn (0 to 11) of each, and their descriptors as 64-bit numbers."""
    found: list[list] = [[] for _ in images]
    for width in {x.shape[1] for x in images}:
        band = max(2 * SUPPORT, RUN_PIXELS // (width + 2 * MARGIN) // 2 * 2)
        run: list[tuple[int, int, int, np.ndarray, bool]] = []  # image, first row that counts, its place in the band, the band's rows, whether it is small
        size = 0
        for k, x in enumerate(images):
            if x.shape[1] != width:
                continue
            for at in range(0, x.shape[0], band):
                low = max(0, at - SUPPORT)
                run.append((k, at, at - low, x[low : at + band + SUPPORT], x.size <= SMALL))
                size += (len(run[-1][3]) + 2 * MARGIN) * (width + 2 * MARGIN)
                if size >= RUN_PIXELS:
                    _add_points(run, band, found)
                    run, size = [], 0
        if run:
            _add_points(run, band, found)
    out = []
    for parts in found:
        places = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, 4), np.int64)
        codes = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.uint64)
        order = np.lexsort((places[:, 2], places[:, 0], places[:, 1]))
        out.append((places[order], codes[order]))
    return out


def _add_points(run: list[tuple[int, int, int, np.ndarray, bool]], band: int, found: list[list]) -> None:
    packed = np.concatenate([x for *_, x, _ in run])
    heights = np.array([len(x) for *_, x, _ in run])
    starts = np.cumsum(heights) - heights
    small = np.array([x for *_, x in run])
    done = [_points(packed.astype(np.float32), starts, heights, small, 1)]
    halves = heights // 2
    if packed.shape[1] >= 2 and halves.sum():
        nth = np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves)
        top = np.repeat(starts, halves) + 2 * nth
        wide = packed.shape[1] // 2 * 2
        pairs = packed[top, :wide].astype(np.float32) + packed[top + 1, :wide]
        done.append(_points((pairs[:, ::2] + pairs[:, 1::2]) / 4, np.cumsum(halves) - halves, halves, small, 2))
    owner, places, codes = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(run) + 1))
    for n, (k, first, inside, *_) in enumerate(run):
        own = order[bounds[n] : bounds[n + 1]]
        y = places[own, 1]
        own = own[(y >= inside) & (y < inside + band)]
        found[k].append((places[own] + [0, first - inside, 0, 0], codes[own]))


def _points(packed: np.ndarray, starts: np.ndarray, heights: np.ndarray, small: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images that lie one below another: the one that each key point is in, its place there, its descriptor."""
    width, tall = packed.shape[1], heights + 2 * MARGIN
    begin = np.cumsum(tall) - tall
    owner = np.repeat(np.arange(len(heights)), tall)
    row = np.arange(len(owner)) - begin[owner] - MARGIN
    last = heights[owner] - 1
    source = np.minimum(starts[owner] + np.clip(row, 0, np.maximum(last, 0)), max(0, len(packed) - 1))
    s = np.empty((len(source), width + 2 * MARGIN), np.float32)  # edges repeated
    s[:, MARGIN:-MARGIN] = packed[source]
    s[:, :MARGIN] = s[:, MARGIN : MARGIN + 1]
    s[:, -MARGIN:] = s[:, -MARGIN - 1 : -MARGIN]
    dx = s[1:-1, 2:] - s[1:-1, :-2]
    dy = s[2:, 1:-1] - s[:-2, 1:-1]
    both = _sum3(dx * dy)
    dx *= dx
    dy *= dy
    a, c = _sum3(dx), _sum3(dy)
    strength = a * c
    both *= both
    strength -= both
    a += c
    a *= a
    a *= np.float32(0.05)
    strength -= a
    strength[(row[2:-2] < 0) | (row[2:-2] > last[2:-2])] = 0
    strength[:, : MARGIN - 2] = 0
    strength[:, 2 - MARGIN :] = 0
    centre, more = strength[APART:-APART, APART:-APART], APART - CLOSE
    close = _highest(strength, CLOSE)
    corner = centre == _highest(close, APART, CLOSE)
    few = small[owner][2 + APART : -2 - APART]
    corner[few] = centre[few] == close[more:-more, more:-more][few]
    corner &= centre > 65_000.0
    y, x = np.nonzero(corner)
    y += 2 + APART
    x += 2 + APART
    if not len(y):
        return np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
    smooth, across = _sum3(s), s.shape[1] - 2
    smooth, near, at = smooth.ravel(), np.arange(-4, 5), (y - 1) * across + x - 1
    patch = smooth[at[:, None] + (near[:, None] * across + near).ravel()]
    angle = np.arctan2(patch @ np.repeat(near, 9).astype(np.float32), patch @ np.tile(near, 9).astype(np.float32))
    turn = np.round(angle / (np.pi / 6)).astype(np.int64) % 12
    offsets = _TURNED[:, 0] * across + _TURNED[:, 1], _TURNED[:, 2] * across + _TURNED[:, 3]
    bits = smooth[at[:, None] + offsets[0][turn]] < smooth[at[:, None] + offsets[1][turn]]
    codes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    places = np.stack([(x - MARGIN) * scale, row[y] * scale, np.full(len(x), scale), turn], axis=1)
    return owner[y], places, codes


def parts_of(codes: np.ndarray) -> np.ndarray:
    """The TABLES parts of each descriptor, in a row of its own, with the table in the upper bits."""
    width = 64 // TABLES
    shifts = np.arange(TABLES, dtype=np.uint64)
    return ((codes[:, None] >> shifts * np.uint64(width)) & np.uint64((1 << width) - 1) | shifts << np.uint64(width)).astype(np.int64)


def packed_places(places: np.ndarray) -> np.ndarray:
    """One number for each place: y, x (25 bits), turn (4 bits), scale (2 bits)."""
    return places[:, 1] << 31 | places[:, 0] << 6 | places[:, 3] << 2 | places[:, 2]


def unpacked_places(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> 6 & 0x1FFFFFF, packed >> 31, packed & 3, packed >> 2 & 15], axis=1)


def copies_of(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether a[k] and b[k], each the places and descriptors of an image, are copies."""
    n = len(a)
    out = np.zeros(n, bool)
    if not n:
        return out
    counts = [np.array([len(c) for _, c in side]) for side in (a, b)]
    places = [np.concatenate([p for p, _ in side]) for side in (a, b)]
    codes = [np.concatenate([c for _, c in side]) for side in (a, b)]
    keys, points = [], []
    for k in (0, 1):
        owner = np.repeat(np.arange(n), counts[k])
        key = (parts_of(codes[k]) | (owner << 34)[:, None]).ravel()
        order = np.argsort(key, kind="stable")  # of equal parts in the order of their places
        keys.append(key[order])
        points.append(order // TABLES)
    distinct = [np.flatnonzero(np.diff(x, prepend=-1)) for x in keys]
    n_parts = [np.bincount(keys[k][distinct[k]] >> 34, minlength=n) for k in (0, 1)]
    if not len(keys[0]) or not len(keys[1]):
        return out
    low, high = (np.searchsorted(keys[1], keys[0], side) for side in ("left", "right"))
    met = high > low
    shared = np.bincount(keys[0][distinct[0]][met[distinct[0]]] >> 34, minlength=n)
    fine = shared >= np.maximum(LEAST, np.ceil(PARTS * np.minimum(*n_parts)))
    from_top = np.arange(len(keys[0])) - np.searchsorted(keys[0], keys[0], "left")
    from_end = np.searchsorted(keys[0], keys[0], "right") - 1 - np.arange(len(keys[0]))
    met &= fine[keys[0] >> 34]
    i = np.concatenate([np.flatnonzero(met & (low + from_top < high)), np.flatnonzero(met & (high - 1 - from_end >= low))])
    split = int((met & (low + from_top < high)).sum())
    j = np.concatenate([(low + from_top)[i[:split]], (high - 1 - from_end)[i[split:]]])
    if not len(i):
        return out
    i, j = np.divmod(np.unique(points[0][i] * len(codes[1]) + points[1][j]), len(codes[1]))
    close = np.bitwise_count(codes[0][i] ^ codes[1][j]) <= FAR
    i, j = i[close], j[close]
    pair = np.searchsorted(np.cumsum(counts[0]), i, "right")
    p, q = places[0][i], places[1][j]
    turn, scale = (q[:, 3] - p[:, 3]) % 12, q[:, 2] / p[:, 2]
    shift = q[:, 0] + 1j * q[:, 1] - scale * np.exp(1j * np.pi / 6 * turn) * (p[:, 0] + 1j * p[:, 1])
    least = np.maximum(LEAST, SHARE * np.minimum(*counts))
    kind = words.mix((pair << 6 | turn << 2 | np.round(2 * scale).astype(np.int64)).view(np.uint64))
    for across in (0, 0.5):
        for down in (0, 0.5):
            cell = [np.floor(x / NEAR + half).astype(np.int64).view(np.uint64) for x, half in ((shift.real, across), (shift.imag, down))]
            _, window = np.unique(words.mix(words.mix(kind + cell[0]) + cell[1]), return_inverse=True)
            number = [np.bincount(np.unique(window * (int(x.max()) + 1) + x) // (int(x.max()) + 1), minlength=window.max() + 1) for x in (i, j)] if len(window) else [np.zeros(0, int)] * 2
            agree = np.minimum(*number)[window] if len(window) else number[0]
            out[pair[agree >= least[pair]]] = True
    return out


def render(pages: DataFrame, id_column: str = "page_id", text_column: str = "html") -> DataFrame:
    """id, image: a drawing of each text. Null and empty texts give no image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in common.slices(batch.column("text")):
                h, bounds = words.hash_words(data, offsets)
                marks = ((h[:, None] >> np.arange(16, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1, 4, 4) * 160 + ((h >> np.uint64(40)) % np.uint64(64)).astype(np.uint8)[:, None, None]
                images = []
                for i in range(end - first):
                    own = marks[bounds[i] : bounds[i + 1]]
                    rows = -(-len(own) // 16)
                    cells = np.zeros((rows * 16, 4, 4), np.uint8)
                    cells[: len(own)] = own
                    images.append(png(cells.reshape(rows, 16, 4, 4).transpose(0, 2, 1, 3).reshape(rows * 4, 64)) if rows else None)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(images, pa.binary())], names=["id", "image"])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, image binary")

def described(images: DataFrame) -> DataFrame:
    """id, node (64 bits of the digest of size and pixels; null if unreadable), places and codes of the key points, n_parts (distinct ones) and sketch (minima of these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, size = [], [], 0
            for i, content in zip(b.column("id").to_pylist(), b.column("image"), strict=True):
                ids.append(i)
                held.append(pixels_of(content.as_py()))
                size += 0 if held[-1] is None else held[-1].size
                if size >= RUN_PIXELS:
                    yield _rows(ids, held)
                    ids, held, size = [], [], 0
            yield _rows(ids, held)

    return images.select(F.col("id").cast("long").alias("id"), "image").mapInArrow(run, "id long, node long, places array<long>, codes array<long>, n_parts int, sketch array<long>")


def _rows(ids: list, pixels: list[np.ndarray | None]) -> pa.RecordBatch:
    good = [k for k, p in enumerate(pixels) if p is not None and p.size]
    points = key_points([pixels[k] for k in good])
    nodes: list = [None] * len(ids)
    counts, n_parts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    sketches: list = [None] * len(ids)
    for k, (_, codes) in zip(good, points, strict=True):
        nodes[k] = int.from_bytes(hashlib.sha256(repr(pixels[k].shape).encode() + pixels[k].tobytes()).digest()[:8], "little", signed=True)
        counts[k] = len(codes)
        if len(codes):
            parts = np.unique(parts_of(codes))
            n_parts[k] = len(parts)
            mixed = words.mix(parts.view(np.uint64) + np.uint64(1))
            sketches[k] = [int(x) for x in np.array([(mixed * f).min() for f in _FACTORS]).view(np.int64)]
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    places = np.concatenate([packed_places(p) for p, _ in points]) if points else np.zeros(0, np.int64)
    codes = np.concatenate([c for _, c in points]) if points else np.zeros(0, np.uint64)
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (places, codes.view(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), *lists, pa.array(n_parts, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "node", "places", "codes", "n_parts", "sketch"])


def _confirmed(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes that are copies. Key points are joined once, to a's and b's together; a's then stand before those of TOGETHER or so partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, one, two, who, size = None, None, [], [], [], 0
        for b in batches:
            data = [b.column(c) for c in ("a", "part", "role", "node")]
            ends = b.column("codes").offsets.to_numpy()
            places, codes = (b.column(c).values.to_numpy(zero_copy_only=False) for c in ("places", "codes"))
            for k, (a, part, role, node) in enumerate(zip(*(c.to_pylist() for c in data), strict=True)):
                own = unpacked_places(places[ends[k] : ends[k + 1]]), codes[ends[k] : ends[k + 1]].view(np.uint64)
                if role == 0:
                    last, head = (a, part), own
                elif (a, part) == last:
                    one.append(head)
                    two.append(own)
                    who.append((a, node))
                    size += len(head[1]) + len(own[1])
                if size >= 1 << 17:
                    yield told(who, one, two)
                    one, two, who, size = [], [], [], 0
        yield told(who, one, two)

    def told(who: list, one: list, two: list) -> pa.RecordBatch:
        keep = copies_of(one, two)
        return pa.RecordBatch.from_arrays([pa.array([w[k] for w, yes in zip(who, keep, strict=True) if yes], pa.int64()) for k in (0, 1)], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    partners = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"))
    need = partners.unionByName(heads)
    dealt = need.join(common.among(table.select("node", "places", "codes"), "node", need.select("node")), "node").select("a", "part", "role", "node", "places", "codes")
    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "role", "node").mapInArrow(run, "a long, b long").distinct()


def _grouped(table: DataFrame, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Some links (a, b), and the groups (node, component) that they make: most groups of copies, found with few comparisons.

    Images with one minimum in their sketches stand in a list. In each round every group but the list's largest proposes,
    over all of its lists, the two of its images that meet a leader of a larger group most often; leaders are those that a
    hash of the round puts first, so that the next round tries others. Later rounds leave lists of up to FEW images aside,
    for which there is little to save.
    """
    posted = table.select("node", F.posexplode("sketch").alias("nth", "value")).select("node", F.xxhash64("nth", "value").alias("key"))
    lists = common.saved(posted.join(posted.groupBy("key").agg(F.count("*").alias("uses")).where("uses > 1"), "key"), "image-sketches")
    links = groups = None
    for k in range(rounds):
        at = lists.withColumn("component", F.col("node")) if groups is None else lists.where(F.col("uses") > FEW).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        first = F.max(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node")).alias("first")
        each = at.groupBy("key", "component").agg(F.count("*").alias("n"), first)
        heads = each.groupBy("key").agg(F.max(F.struct("n", "first", "component")).alias("head"), F.count("*").alias("groups")).where("groups > 1")
        met = at.join(heads.select("key", F.col("head.component").alias("other"), F.col("head.first.node").alias("leader")), "key").where("component <> other")
        counts = met.groupBy("component", "node", "leader").agg(F.count("*").alias("n"))
        nth = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "node", "leader"))
        proposed = common.saved(counts.withColumn("nth", nth).where("nth <= 2").select(F.col("leader").alias("a"), F.col("node").alias("b")), "image-proposed")
        new = common.saved(_confirmed(proposed, table), "image-links")
        common.drop(proposed)
        links = new if links is None else links.unionByName(new)
        if not new.limit(1).count():
            break
        if groups is None:
            groups = components(new)
            continue
        # only what the new links join changes: their ends' groups are the nodes of a small graph
        named = new.join(groups.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left").join(groups.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
        named = common.saved(named.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b"), "image-named")
        merged = components(named).select(F.col("node").alias("component"), F.col("component").alias("into"))
        every = groups.unionByName(merged.select(F.col("component").alias("node"), "component").join(groups.select("node"), "node", "left_anti"))
        groups = common.saved(every.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "image-groups")
        common.drop(named)
    common.drop(lists)
    return links, groups if groups is not None else components(links)


def _exploded(codes: pa.Array, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all parts of a column of lists, and the owner of each. A key is the part with its bits spread, one to one."""
    flat = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    parts = parts_of(flat)
    half = np.uint64(64 // TABLES)
    low = np.uint64((1 << 64 // TABLES) - 1)
    x = parts.view(np.uint64)
    spread = (x & low) * np.uint64(0x9E3779B1) & low
    spread ^= spread >> np.uint64(15)
    spread = spread * np.uint64(0x85EBCA77) & low
    keys = (x >> half << half | spread).view(np.int64)
    sizes = np.diff(codes.offsets.to_numpy())
    return keys.ravel(), np.repeat(np.repeat(owners, sizes), TABLES)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def _heads(keys: np.ndarray, groups: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each key, ascending: how often it occurs, the group that has it most often, how often that is, whether others have it. n: how often each row counts."""
    order = np.lexsort((groups, keys))
    keys, groups, n = keys[order], groups[order], n[order]
    at = _runs(keys, groups)
    keys, groups, n = keys[at], groups[at], np.add.reduceat(n, at) if len(at) else n
    order = np.lexsort((-n, keys))
    keys, groups, n = keys[order], groups[order], n[order]
    at = _runs(keys)
    total = np.add.reduceat(n, at) if len(at) else n
    return keys[at], total, groups[at], n[at]


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _spread(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _mixed_parts(table: DataFrame, n_parts: int) -> DataFrame:
    """key, uses and head (the group that has it most often) of the parts that lie in several groups. table: component, codes.

    Each batch of images counts its own parts and sends these counts on by ranges of the keys, as arrays; a range has
    some hundred thousand keys, of which a very common one counts once a batch.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, n_parts) / (1 << 18)))))
    width = 64 // TABLES

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys, owners = _exploded(b.column("codes"), b.column("component").to_numpy())
            keys, total, head, own = _heads(keys, owners, np.ones(len(keys), np.int64))
            bounds = np.searchsorted(keys, np.arange((TABLES << bits) + 1) << (width - bits))
            for k in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[k], bounds[k + 1])
                steps = np.diff(keys[part], prepend=int(k) << (width - bits)).astype(np.uint32)
                names, who = np.unique(head[part], return_inverse=True)
                more = np.flatnonzero(total[part] > 1)
                extra = np.stack([more, total[part][more], own[part][more]]).astype(np.int64)
                # the bytes of small numbers one place after another, so that those that are mostly 0 take no room
                columns = [_squeezed(x) for x in (steps, names, who.astype(np.uint32), extra)]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), *[pa.array([x], pa.binary()) for x in columns]], names=["range", "steps", "names", "heads", "extra"])

    def merge(rows: pa.Table) -> pa.Table:
        keys, heads, n, own = [], [], [], []
        for k, steps, names, head, extra in zip(*(rows[c].to_pylist() for c in ("range", "steps", "names", "heads", "extra")), strict=True):
            keys.append((k << (width - bits)) + np.cumsum(_spread(steps, np.uint32).astype(np.int64)))
            heads.append(_spread(names, np.int64)[_spread(head, np.uint32)])
            counts = np.ones((2, len(keys[-1])), np.int64)
            at, *more = _spread(extra, np.int64).reshape(3, -1)
            counts[:, at] = more
            n.append(counts[0])
            own.append(counts[1])
        keys, heads, n, own = (np.concatenate(x) for x in (keys, heads, n, own))
        key, most, head, best = _heads(keys, heads, own)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, np.searchsorted(key, keys), n)
        mixed = best < total
        return pa.table({"key": key[mixed], "uses": total[mixed], "head": head[mixed]})

    return table.select("component", "codes").mapInArrow(tally, "range int, steps binary, names binary, heads binary, extra binary").groupBy("range").applyInArrow(merge, "key long, uses long, head long")


def _left_apart(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) in different groups that share a part by which a link between them must show."""
    spark = table.sparkSession
    rows = table.select("node", "n_parts", "codes")
    grouped, alone = (common.among(rows, "node", groups.select("node"), inside) for inside in (True, False))
    at = grouped.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).unionByName(alone.withColumn("component", F.col("node")))
    stats = common.saved(_mixed_parts(at, TABLES * (at.agg(F.sum(F.size("codes"))).first()[0] or 0)), "image-mixed-parts")
    drop_bits = 64 // TABLES + (TABLES - 1).bit_length() - BITS
    bit = F.shiftright("key", drop_bits) + 1
    rows = stats.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros((1 << BITS) // 8, np.uint8)  # of the upper bits of mixed parts: 8 MB whatever their number
    for r in rows:
        bitmap[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners = _exploded(b.column("codes"), np.arange(b.num_rows))
            place = keys >> drop_bits
            may = (shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            keys, owners = keys[may], owners[may]
            pairs = np.unique(np.stack([owners, keys]), axis=1) if len(keys) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), *[pa.array(b.column(c).to_numpy()[pairs[0]], t) for c, t in (("node", pa.int64()), ("component", pa.int64()), ("n_parts", pa.int32()))]], names=["key", "node", "component", "n_parts"])

    mixed = at.mapInArrow(explode, "key long, node long, component long, n_parts int").join(stats, "key").distinct()
    w = Window.partitionBy("node")
    rows = mixed.withColumns({"m": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("uses", "key"))})
    rows = rows.withColumns({"behind": F.col("m") - F.col("nth") + 1, "least": F.greatest(F.lit(LEAST), F.ceil(PARTS * F.col("n_parts")))})
    rows = rows.where(F.col("behind") >= LEAST - EXTRA).select("key", "node", "component", "n_parts", "behind", "least", "uses", (F.col("component") == F.col("head")).alias("of_head"))
    rows = common.saved(rows, "image-lists")
    common.drop(stats)
    blocks = F.ceil(F.col("uses") / BLOCK).cast("int")
    one = rows.where("NOT of_head").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    two = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    one = one.select("key", "block", *[F.col(c).alias(f"p_{c}") for c in ("node", "component", "n_parts", "behind", "least")])
    two = two.select("key", "block", "of_head", *[F.col(c).alias(f"q_{c}") for c in ("node", "component", "n_parts", "behind", "least")])
    # the one with fewer parts says how many must be shared; of these the first has as many from there on in both, and so on
    needed = F.when(F.col("p_n_parts") < F.col("q_n_parts"), F.col("p_least")).when(F.col("p_n_parts") > F.col("q_n_parts"), F.col("q_least")).otherwise(F.least("p_least", "q_least"))
    left = F.least("p_behind", "q_behind")
    both = one.join(two, ["key", "block"]).where(F.expr("p_component <> q_component AND (of_head OR p_node < q_node)") & (left >= needed - EXTRA))
    met = both.groupBy(F.least("p_node", "q_node").alias("a"), F.greatest("p_node", "q_node").alias("b")).agg(F.count("*").alias("n"), F.bool_or(left >= needed).alias("enough"))
    pairs = met.where((F.col("n") > EXTRA) & F.col("enough")).select("a", "b")
    out = common.saved(pairs, "image-rest")
    common.drop(rows)
    return out


def copies(images: DataFrame) -> DataFrame:
    """id, class_id (smallest id with the same pixels), component_id (smallest id linked, itself included) and n_key_points of every image."""
    table = common.saved(described(images), "key-points")
    full = table.where("node IS NOT NULL AND id IS NOT NULL")
    classes = common.saved(full.groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")), "image-classes")
    again = full.select("node", "id").join(classes.where("copies > 1"), "node").where("id <> class_id").select("node", "id")  # equal images go on once
    unique = full.join(again, ["node", "id"], "left_anti").where(F.size("codes") >= LEAST)
    links, groups = _grouped(unique)
    rest = _left_apart(unique, groups)
    more = common.saved(_confirmed(rest, unique), "image-more")
    names = classes.select("node", "class_id")
    named = links.unionByName(more).join(names.withColumnRenamed("node", "a").withColumnRenamed("class_id", "x"), "a").join(names.withColumnRenamed("node", "b").withColumnRenamed("class_id", "y"), "b")
    named = common.saved(named.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "image-pairs")
    common.drop(rest, more)
    groups = components(named)
    known = classes.join(groups, classes.class_id == groups.node, "left").select(classes.node, "class_id", F.coalesce("component", "class_id").alias("component_id"), "copies")
    known = common.saved(known, "image-groups")
    rows = table.select("id", "node", F.size("codes").cast("long").alias("n_key_points"))
    seen = common.join_spread(rows.where("node IS NOT NULL AND id IS NOT NULL"), known, "node", "copies").select("id", "class_id", "component_id", "n_key_points")
    return seen.unionByName(rows.where("node IS NULL OR id IS NULL").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id"), "n_key_points"))
