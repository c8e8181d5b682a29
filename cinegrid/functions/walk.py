"""Walks over chained chunks and boxes of a file's bytes.

A walk is a loop over one file's bytes. Files meet their walk in batches of Arrow, each in the task that has it, and give a small
value: what they state. All that follows from it is Spark's. Positions are from 0; a number beyond the bytes is null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import repeat
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from cinegrid.functions.raster import bound, exif_orientation

# Chunk names.
ACTL, FCTL, IDAT, IEND, EXIF = b"acTL", b"fcTL", b"IDAT", b"IEND", b"eXIf"
VP8X, ANMF, RIFF, WEBP = b"VP8X", b"ANMF", b"RIFF", b"WEBP"
# Boxes that hold boxes, and how many bytes stand before the first.
CONTAINERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "meta": 4, "iprp": 0, "ipco": 0, "stsd": 8}
# Where the boxes of a visual sample entry begin, and the path of a file's sample entries.
ENTRY_HEADER, ENTRIES = 78, "moov/trak/mdia/minf/stbl/stsd"
SAMPLE_TABLES = "moov/trak/mdia/minf/stbl/"
# The boxes that state a sequence's timeline.
TRACK_BOXES = {"mdhd": "moov/trak/mdia/mdhd", "hdlr": "moov/trak/mdia/hdlr", "stts": SAMPLE_TABLES + "stts", "ctts": SAMPLE_TABLES + "ctts", "elst": "moov/trak/edts/elst"}
TRACK = "moov/trak/"
#: By name of a box: what its body is called, how many bytes stand before the first box in it, and the ways on from there.
Ways = dict[bytes, tuple[str | None, int, "Ways"]]
CHAINED, BOXED = ["png", "gif", "webp"], ["avif", "heif"]

#: Ticks a second that a common timebase of delays may have.
TIMEBASE_LIMIT = 1 << 31
#: Samples that one track's table may state.
MOST_SAMPLES = 1 << 22

BOXES = pa.list_(pa.struct([("path", pa.string()), ("track", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
#: What a file states (ticks a second; what all its pictures last, and how many of them have no time), and of count pictures from pos
#: (1-based) on: each lasts duration; those before last before, and idle of them nothing.
RUNS = {"animated": pa.bool_(), "refusal": pa.string(), **{n: pa.int64() for n in ("ticks", "total", "total_idle", "pos", "count", "duration", "before", "idle")}}
STILL = (False, None, None, None, None, None)
#: Rows that one batch of Arrow gathers before it goes on.
MOST_ROWS = 1 << 16


def number(data: Column, at: Column, size: int, little: bool = False) -> Column:
    """An unsigned number of `size` bytes."""

    def read(digits: Column) -> Column:
        order = F.concat(*[F.substring(digits, i, 2) for i in range(2 * size - 1, 0, -2)]) if little else digits
        return F.when(F.length(digits) == 2 * size, F.conv(order, 16, 10).cast("decimal(20,0)").try_cast("bigint"))

    return bound(F.hex(part(data, at, size)), read)


def part(data: Column, at: Column, size: int | Column) -> Column:
    return F.substr(data, (at + 1).cast("int"), F.lit(size).cast("int") if isinstance(size, int) else size.cast("int"))


def named(kind: pa.DataType) -> str:
    """An Arrow type in Spark's words."""
    if pa.types.is_struct(kind):
        return f"struct<{','.join(f'{f.name}:{named(f.type)}' for f in kind)}>"
    if pa.types.is_list(kind):
        return f"array<{named(kind.value_type)}>"
    return {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}[kind]


def walked(kind: pa.DataType, walk: Callable, *columns: Column) -> Column:
    """walk of each row's values."""

    def run(*values: pa.Array) -> pa.Array:
        return pa.array([walk(*(v.as_py() for v in row)) for row in zip(*values, strict=True)], kind)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, named(kind))(*columns)


def num(d: bytes, at: int, size: int, order: str = "big") -> int | None:
    b = d[at : at + size]
    return int.from_bytes(b, order) if len(b) == size else None


def run_length(pieces: Iterator[tuple[int, int]]) -> tuple[int, int, list[tuple[int, ...]]]:
    """total, idle and pos, count, duration, before and idle of each (count, duration)."""
    pos, before, idle, runs = 1, 0, 0, []
    for count, duration in pieces:
        runs.append((pos, count, duration, before, idle))
        pos += count
        if duration > 0:
            before += count * duration
        else:
            idle += count
    return before, idle, runs


def png_delays(d: bytes) -> tuple[int | None, list[tuple[int, int]], str | None]:
    """A PNG's frame controls: pictures promised (null for a still), delays and refusal."""
    at, stated, data, found = 8, None, False, []
    while True:
        size, name = num(d, at, 4), d[at + 4 : at + 8]
        if size is None or at + 12 + size > len(d):
            break
        if name == ACTL and not data:
            stated = num(d, at + 8, 4)
        elif name == FCTL:
            if size < 26:
                break
            found.append(struct.unpack_from(">HH", d, at + 28))
        # the frames are counted until there are as many as promised
        if name == IEND or (stated is not None and len(found) >= stated):
            break
        data = data or name == IDAT
        at += 12 + size
    if stated == 0:
        return stated, found, "it promises no picture"
    few = stated is not None and len(found) < stated
    return stated, found, f"it ends after {len(found)} of {stated} pictures" if few else None


def png_exif(content: Column) -> Column:
    """The orientation that a PNG's eXIf chunk states, null without one."""

    def walk(d: bytes | None) -> bytes | None:
        at = 8
        while d is not None:
            size, name = num(d, at, 4), d[at + 4 : at + 8]
            if size is None or at + 12 + size > len(d) or name == IEND:
                break
            if name == EXIF:
                return d[at + 8 : at + 8 + size]
            at += 12 + size
        return None

    return exif_orientation(walked(pa.binary(), walk, content))


def colour_table(flags: int) -> int:
    return 6 << flags % 8 if flags >= 128 else 0


def gif_delays(d: bytes) -> tuple[list[int], str | None]:
    """A GIF's pictures: delays in hundredths of a second, and refusal."""
    length, wait, found = len(d), 0, []
    at = 13 + colour_table(d[10] if length > 10 else 0)
    while at < length and d[at] != 0x3B:
        if d[at] == 0x21:
            if d[at + 1 : at + 3] == b"\xf9\x04":
                wait = num(d, at + 4, 2, "little")
            at += 2
        elif d[at] == 0x2C and at + 11 <= length:
            found.append(wait)
            wait = 0
            at += 11 + colour_table(d[at + 9])
        else:
            return found, "it ends within a block" if d[at] == 0x2C else "it holds an unknown block"
        while at < length and d[at]:  # a chain of sub-blocks, each its length and its bytes
            at += 1 + d[at]
        if at >= length:
            return found, "it ends within a block"
        at += 1
    return found, None


def webp_delays(d: bytes) -> tuple[bool, list[int], str | None]:
    """A WebP's pictures: whether it says that it is animated, delays in milliseconds, and refusal."""
    last, stated, found = min((num(d, 4, 4, "little") or 0) + 8, len(d)), False, []
    if d[:4] != RIFF or d[8:12] != WEBP or last < 12:
        return False, found, "it is no WebP container"
    at = 12
    while at + 8 <= last:
        name, size = d[at : at + 4], num(d, at + 4, 4, "little")
        if at + 8 + size > last:
            break
        if size < {VP8X: 10, ANMF: 16}.get(name, 0):
            return stated, found, "it holds a chunk that is too short"
        if name == VP8X:
            stated = d[at + 8] // 2 % 2 == 1
        elif name == ANMF:
            found.append(num(d, at + 20, 3, "little"))
        at += 8 + size + size % 2
    return stated, found, "it says that it is animated but holds no picture" if stated and not found else None


def boxes_of(d: bytes) -> Iterator[tuple[str, int, int, int]]:
    at, tracks, movies, opened = 0, 0, 0, [(len(d), "", 0)]
    while opened:
        end, outer, track = opened[-1]
        if at + 8 > end:
            at = end
            opened.pop()
            continue
        size, kind = struct.unpack_from(">I4s", d, at)
        header = 8
        if size == 1:
            header, size = 16, num(d, at + 8, 8) or 0
        elif size == 0:
            size = end - at
        if not header <= size <= end - at:
            at = end
            continue
        kind = kind.decode("latin-1")
        path = f"{outer}/{kind}" if outer else kind
        inner = ENTRY_HEADER if outer == ENTRIES else CONTAINERS.get(kind)
        if path == "moov/trak":
            tracks += 1
            track = tracks
        yield path, track, at + header, at + size
        if inner is not None and not (path == "moov" and movies):
            opened.append((at + size, path, track))
            size = min(header + inner, size)
        movies += path == "moov"
        at += size


def boxes(content: Column) -> Column:
    """The boxes of an ISO base media file: path (names joined by /), track (the how manieth trak they are in, else 0), start and
    end of what they hold. A box that runs beyond its parent ends the parent; of several movies, the first counts."""
    return walked(BOXES, lambda d: None if d is None else list(boxes_of(d)), content)


def boxes_in(d: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of what they hold, of the boxes from at to end, but not of those inside them."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", d, at)
        header = 8
        if size < 2:
            header, size = (16, num(d, at + 8, 8) or 0) if size else (8, end - at)
        if not header <= size <= end - at:
            return
        yield kind, at + header, at + size
        at += size


def ways(paths: dict[str, str], outer: str = "") -> Ways:
    """The boxes on the way to those paths (by name)."""
    found = {}
    for path in {outer + p[len(outer) :][:4] for p in paths.values() if p.startswith(outer) and len(p) > len(outer)}:
        kind, name = path[-4:], next((n for n, p in paths.items() if p == path), None)
        inner = ENTRY_HEADER if outer == f"{ENTRIES}/" else CONTAINERS.get(kind)
        found[kind.encode("latin-1")] = name, inner or 0, {} if inner is None else ways(paths, path + "/")
    return found


def first_inside(d: bytes, at: int, end: int, way: Ways, found: dict[str, bytes]) -> dict[str, bytes]:
    """found and, by name, the first body of each box that a way leads to. Boxes aside of the ways are stepped over, not into."""
    for kind, start, stop in boxes_in(d, at, end):
        if kind in way:
            name, skipped, inner = way[kind]
            if name and name not in found:
                found[name] = d[start:stop]
            if inner:
                first_inside(d, start + skipped, stop, inner, found)
    return found


def tracks_of(d: bytes, way: Ways) -> Iterator[dict[str, bytes]]:
    """What each track of the first movie holds, as first_inside; tracks are read as they are asked for."""
    for kind, start, end in boxes_in(d, 0, len(d)):
        if kind == b"moov":
            yield from (first_inside(d, a, b, way, {}) for k, a, b in boxes_in(d, start, end) if k == b"trak")
            return


def first_bodies(content: Column, paths: dict[str, str]) -> Column:
    """For each track that has one (0: no track): track and, for each name of paths, what the first such box holds. Paths lead into
    a track (moov/trak/) or past the movie."""
    kind = pa.list_(pa.struct([("track", pa.int32()), *((n, pa.binary()) for n in paths)]))
    inside = ways({n: p[len(TRACK) :] for n, p in paths.items() if p.startswith(TRACK)})
    beside = ways({n: p for n, p in paths.items() if not p.startswith(TRACK)})

    def walk(d: bytes | None) -> list[tuple]:
        if d is None:
            return []
        found = [first_inside(d, 0, len(d), beside, {}), *(tracks_of(d, inside) if inside else [])]
        return [(t, *(b.get(n) for n in paths)) for t, b in enumerate(found) if b]

    return walked(kind, walk, content)


TRACK_WAYS = ways({n: p[len(TRACK) :] for n, p in TRACK_BOXES.items()})


def table_entries(body: bytes) -> list[tuple[int, int]]:
    """The runs of a stts or ctts box: count and the raw value; a run of 0 where one is cut off, which makes the table unsound."""
    stated = num(body, 4, 4) or 0
    return list(struct.iter_unpack(">II", body[8 : 8 + 8 * stated])) if stated == 0 or 8 + 8 * stated <= len(body) else [(0, 0)]


def sound(entries: list[tuple[int, int]]) -> bool:
    counts = [n for n, _ in entries]
    return 0 not in counts and sum(counts) <= MOST_SAMPLES


def edits(body: bytes) -> list[tuple[int | None, int]]:
    """The entries of an elst box: duration and media_time (negative for an empty edit); none where one is cut off."""
    wide, stated = body[:1] == b"\1", num(body, 4, 4) or 0
    size, entry = (20, ">QqI") if wide else (12, ">IiI")
    # the last entry's rate may be missing
    if 8 + stated * size > len(body) + 4:
        return []
    return [struct.unpack_from(entry[:3], body, 8 + i * size) for i in range(stated)]


def pictures_of_runs(stts: list[tuple[int, int]], ctts: Iterator[tuple[int, int]], end: int, last: int) -> Iterator[tuple[int, int]]:
    """(count, duration) of the pictures that a sequence shows before `last`: presentation instants are decode time plus offset, never
    negative; a picture lasts until the next one, or the end. Instants that go back are refused. Only runs are walked, never samples."""
    spans, decoded, left, offset = [], 0, 0, 0  # count, delta and first instant of samples with one delta and offset
    for count, delta in stts:
        while count:
            if not left:
                left, offset = next(ctts, (MOST_SAMPLES, 0))
            n = min(count, left)
            spans.append((n, delta, decoded + offset))
            decoded, count, left = decoded + n * delta, count - n, left - n
    spans.append((0, 0, end))
    n, delta, at = spans[0]
    for following in spans[1:]:
        shown = []  # count, duration and first instant
        final = at + (n - 1) * delta
        if n > 1 and at < 0:  # instants before 0 are 0
            idle = min(n - 1, -at // delta) if delta else n - 1
            shown.append((idle, 0, 0))
            if idle < n - 1:
                second = at + (idle + 1) * delta
                shown += [(1, second, 0), (n - 2 - idle, delta, second)]
        elif n > 1:
            shown.append((n - 1, delta, at))
        final, then = max(0, final), max(0, following[2])
        if following[0] and final > then:
            raise ValueError("composition goes back in time")
        shown.append((1, then - final, final))
        for count, duration, start in shown:
            if start >= last or count == 0:
                continue
            if duration <= 0 or start + count * duration <= last:
                yield count, duration
                continue
            whole, rest = divmod(last - start, duration)
            if whole:
                yield whole, duration
            if rest:
                yield 1, rest
        n, delta, at = following


def sequence_of(d: bytes) -> tuple | None:
    """animated, ticks, total, idle, refusal and runs, as RUNS, of the first picture track whose tables are sound; none without such a track, or with one sample."""
    for t in tracks_of(d, TRACK_WAYS):
        if t.get("hdlr", b"")[8:12] != b"pict":
            continue
        mdhd, ctts = t.get("mdhd", b""), t.get("ctts", b"")
        ticks, stts, moves = num(mdhd, 20 if mdhd[:1] == b"\1" else 12, 4), table_entries(t.get("stts", b"")), table_entries(ctts)
        if ticks and stts and sound(stts) and sound(moves):
            break
    else:
        return None
    if len(stts) == 1 and stts[0][0] < 2:
        return None
    # empty edits only delay; one edit from the media's start may cut its end
    played = [e for e in edits(t.get("elst", b"")) if e[1] >= 0]
    refusal = "starts within its media" if played and played[0][1] > 0 else "edits its media more than once" if len(played) > 1 else None
    if refusal:
        return True, ticks, None, None, refusal, None
    end = sum([n * delta for n, delta in stts])
    last = min(end, played[0][0]) if played and played[0][0] > 0 else end
    if ctts[:1] == b"\1":
        moves = [(n, v - (1 << 32) if v >= 1 << 31 else v) for n, v in moves]
    total, idle, runs = run_length(pictures_of_runs(stts, iter(moves), end, last))
    return (True, ticks, total, idle, None, runs) if runs else (True, ticks, None, None, "it shows no picture", None)


def timeline_of(route: str | None, d: bytes | None) -> tuple | None:
    """animated, ticks, total, idle, refusal and runs, as RUNS; none for a still."""
    if d is None:
        return (False, None, None, None, "it is no WebP container", None) if route == "webp" else None
    if route in BOXED:
        return sequence_of(d)
    if route == "png":
        stated, delays, refusal = png_delays(d)
        dens = [den or 100 for _, den in delays]
        base, animated = lcm(*dens), stated is not None
        ticks = base if base <= TIMEBASE_LIMIT else 1000
        durations = [n * ticks // den for (n, _), den in zip(delays, dens, strict=True)]
    elif route == "gif":
        delays, refusal = gif_delays(d)
        ticks, animated, durations = 1_000_000, len(delays) >= 2, [10_000 * (n or 0) for n in delays]
    elif route == "webp":
        animated, delays, refusal = webp_delays(d)
        ticks, durations = 1_000_000, [1_000 * n for n in delays]
    else:
        return None
    if refusal or not animated:
        return animated, ticks if animated else None, None, None, refusal, None
    total, idle, runs = run_length((1, n) for n in durations)
    return animated, ticks, total, idle, None, runs


def walked_rows(files: DataFrame, key: str, route: str, content: str, kinds: dict[str, pa.DataType], walk: Callable) -> DataFrame:
    """key and the columns kinds of the rows that walk(route, content) gives for each file; flat rows, as nested ones take Spark and
    Arrow longer."""
    schema = StructType([files.schema[key], *(StructField(n, from_arrow_type(k)) for n, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, last = [], [], batch.num_rows - 1
            for i, (r, d) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                found = walk(r.as_py(), d.as_py())
                rows += found
                at += repeat(i, len(found))
                if rows and (i == last or len(rows) >= MOST_ROWS):
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=[key, *kinds])
                    at, rows = [], []

    return files.select(key, F.col(route).alias("_route"), F.col(content).alias("_content")).mapInArrow(run, schema)


def runs_of(route: str | None, d: bytes | None) -> list[tuple]:
    animated, ticks, total, idle, refusal, runs = timeline_of(route, d) or STILL
    stated = animated, refusal, ticks, total, idle
    return [(*stated, *r) for r in runs] if animated and refusal is None else [(*stated, 1, 1, None, None, None)]


def timelines(files: DataFrame, key: str, route: str, content: str) -> DataFrame:
    """key and the RUNS of every file: those it states, or one without a duration where it is a still or refused. PNGs are on the lowest
    common denominator of their delays, or on milliseconds where that has more than TIMEBASE_LIMIT ticks a second."""
    return walked_rows(files, key, route, content, RUNS, runs_of)


def refusals(files: DataFrame, key: str, route: str, content: str) -> DataFrame:
    """key and refusal of the files that are refused; whole timelines are walked for it, but leave no rows."""

    def refused(r: str | None, d: bytes | None) -> list[tuple]:
        refusal = (timeline_of(r, d) or STILL)[4]
        return [] if refusal is None else [(refusal,)]

    return walked_rows(files, key, route, content, {"refusal": pa.string()}, refused)


def properties_of(d: bytes | None, item: int | None) -> list[int] | None:
    if d is None or item is None or len(d) < 4:
        return None
    wide, tall = d[3] % 2 == 1, d[0] > 0
    size, width, at = 2 if wide else 1, 4 if tall else 2, 8
    for _ in range(num(d, 4, 4) or 0):
        ident, count = num(d, at, width), num(d, at + width, 1)
        start = at + width + 1
        if ident is None or count is None or start + count * size > len(d):
            return None
        at = start + count * size
        if ident == item:
            return [num(d, start + i * size, size) % (0x8000 if wide else 0x80) for i in range(count)]
    return None


def item_properties(ipma: Column, item: Column) -> Column:
    """The numbers (from 1) of the properties that an ipma box lists for an item, from its first entry for it; null without one, or
    where an entry up to it is cut off."""
    return walked(pa.list_(pa.int64()), properties_of, ipma, item)


def aperture_boxes(content: Column) -> Column:
    """What the boxes hold that state an aperture: own (clap of the first picture track's first sample entry), clap and ispe (of the
    primary item)."""

    def walk(d: bytes | None) -> tuple | None:
        if d is None:
            return None
        found = list(boxes_of(d))
        first = lambda test: next((b for b in found if test(b)), None)
        body = lambda b: None if b is None else d[b[2] : b[3]]
        inside = lambda o: [] if o is None else [b for b in found if b[2] > o[2] and b[3] <= o[3] and len(b[0]) == len(o[0]) + 5]
        of_kind = lambda bs, kind: body(next((b for b in bs if b[0][-4:] == kind), None))
        handler = first(lambda b: b[0] == TRACK_BOXES["hdlr"] and d[b[2] + 8 : b[2] + 12] == b"pict")
        entry = handler and first(lambda b: b[1] == handler[1] and b[0].startswith(ENTRIES + "/") and len(b[0]) == len(ENTRIES) + 5)
        pitm = body(first(lambda b: b[0] == "meta/pitm"))
        item = None if pitm is None else num(pitm, 4, 2 if pitm[:1] == b"\0" else 4)
        numbers = properties_of(body(first(lambda b: b[0] == "meta/iprp/ipma")), item) or []
        kept = inside(first(lambda b: b[0] == "meta/iprp/ipco"))
        mine = [kept[i - 1] for i in numbers if 0 < i <= len(kept)]
        return of_kind(inside(entry), "clap"), of_kind(mine, "clap"), of_kind(mine, "ispe")

    return walked(pa.struct([(n, pa.binary()) for n in ("own", "clap", "ispe")]), walk, content)
