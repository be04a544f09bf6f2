"""Media columns: ISO base media containers (MP4, MOV and kin), walked box by box without decoding payloads.

probe() reads a binary column: nested boxes, the sample tables of every track and the runs of movie fragments, and from them codec, timescale, duration, edits, number of samples and the byte ranges
of key frames (sync samples; all samples if a track has no sync table). wrap() stores a byte payload losslessly as a PCM track of unsigned 8-bit samples in
such a container, and unwrap() reads the samples back by their chunk offsets.

Cases. A null or foreign blob has no tracks; a box that runs over its parent ends the walk of that parent; sample tables that point outside the file are cut to it, and no count in a file makes more memory or work than the file's own bytes
bear. Boxes may be nested at any depth. A null text is empty: its payload is 64 zero bytes. Equal payloads give equal containers (no clocks, no random numbers). Sizes and offsets of 64 bits are read and written. Very long texts are whole. Repeated rows are
handled each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.llm.cluster import fresh, read
from plumbago.llm.text import arrow_schema, map_arrow

UNIT = 64
RATE = 8000
#: Samples a chunk of a container that wrap() writes.
CHUNK = 4096
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, fmt: str, *values, rest: bytes = b"", version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24), struct.pack(">" + fmt, *values), rest)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """A container whose one track holds the payload as mono unsigned 8-bit PCM samples."""
    n = len(payload)
    chunks, last = -(-n // chunk), n % chunk or chunk
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    runs = [(1, chunk), (chunks, last)] if chunks > 1 and last != chunk else [(1, min(chunk, last) if chunks == 1 else chunk)]
    wide = n + 4096 + 8 * chunks >= 1 << 32

    def moov(first: int) -> bytes:
        at = first + chunk * np.arange(chunks, dtype=np.int64)
        table = _full(b"co64", "I", chunks, rest=at.astype(">u8").tobytes()) if wide else _full(b"stco", "I", chunks, rest=at.astype(">u4").tobytes())
        stbl = _box(b"stbl", _full(b"stsd", "I", 1, rest=entry), _full(b"stts", "III", 1, n, 1), _full(b"stsc", "I", len(runs), rest=b"".join(struct.pack(">III", c, k, 1) for c, k in runs)), _full(b"stsz", "II", 1, n), table)
        minf = _box(b"minf", _full(b"smhd", "hH", 0, 0), _box(b"dinf", _full(b"dref", "I", 1, rest=struct.pack(">I4sI", 12, b"url ", 1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", "QQIQHH", 0, 0, rate, n, 0x55C4, 0, version=1), _full(b"hdlr", "I4s12s", 0, b"soun", bytes(12), rest=b"\0"), minf)
        tkhd = _full(b"tkhd", "QQIIQQHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0x0100, 0, rest=_MATRIX + bytes(8), version=1)
        mvhd = _full(b"mvhd", "QQIQIH10s", 0, 0, rate, n, 0x10000, 0x0100, bytes(10), rest=_MATRIX + bytes(24) + struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if n + 8 >= 1 << 32 else 8
    size = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(size) + _box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[frozenset[bytes], bytes, int, int, int]]:
    """(kinds of the boxes around it, kind, first byte, first byte of the body, byte after it) of all boxes, parents first."""
    todo: list[tuple[frozenset[bytes], int, int]] = [(frozenset(), 0, len(data))]
    while todo:
        around, start, end = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                continue
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        todo.append((around, start + size, end))
        if kind in _NESTED:
            todo.append((around | {kind}, body, start + size))
        yield around, kind, start, body, start + size


def _table(data: bytes, at: int, end: int, width: int, columns: int = 1) -> np.ndarray:
    """A table of big-endian numbers behind its count, cut to the box."""
    if at + 4 > end:
        return np.zeros((0, columns), np.int64)
    (n,) = struct.unpack_from(">I", data, at)
    n = min(n, (end - at - 4) // (width * columns))
    return np.frombuffer(data, f">u{width}", n * columns, at + 4).astype(np.int64).reshape(-1, columns)


def _small_sizes(data: bytes, at: int, end: int) -> np.ndarray:
    """The sizes of a compact table: fields of 4, 8 or 16 bits."""
    field, n = struct.unpack_from(">BI", data, at + 7)
    if field == 16:
        return np.frombuffer(data, ">u2", min(n, (end - at - 12) // 2), at + 12).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, max(0, min(n if field == 8 else -(-n // 2), end - at - 12)), at + 12).astype(np.int64)
    return raw if field == 8 else np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n] if field == 4 else raw[:0]


def tracks(data: bytes | None) -> list[dict]:
    """What sample tables and fragments say of each track: codec, timescale, duration, edits (duration, media time), samples, and ranges (start, end) of all samples and of key frames, adjoining ones joined."""
    found: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    moof, run = 0, {}
    for around, kind, start, at, end in walk(data) if data else ():
        if kind == b"trak":
            found.append({"runs": []})
        elif kind == b"moof":
            moof, run = start, {"next": start}
        elif kind == b"traf":
            run = {"base": moof, "next": run.get("next", moof), "first": run.get("next", moof) == moof}
        try:
            if kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", data, at + 4)
                defaults[number] = tuple(rest)
            elif kind == b"tfhd" and b"traf" in around:
                _fragment(data, at, run, defaults)
            elif kind == b"trun" and b"traf" in around and "track" in run:
                mine = next((t for t in found if t.get("id") == run["track"]), None)
                if mine is None:
                    found.append(mine := {"id": run["track"], "runs": []})
                mine["runs"].append(_run(data, at, end, run))
            elif b"trak" in around and found:
                _described(data, kind, at, end, found[-1])
        except struct.error:
            continue
    return [_read(t, len(data)) for t in found]


def _described(data: bytes, kind: bytes, at: int, end: int, t: dict) -> None:
    """One box of a track."""
    if kind == b"tkhd":
        (t["id"],) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
    elif kind == b"mdhd":
        t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
    elif kind == b"elst":
        wide = data[at] == 1
        (n,) = struct.unpack_from(">I", data, at + 4)
        n = min(n, (end - at - 8) // (20 if wide else 12))
        t["edits"] = [struct.unpack_from(">Qq" if wide else ">Ii", data, at + 8 + k * (20 if wide else 12)) for k in range(n)]
    elif kind == b"stsd" and end >= at + 16:
        t["codec"] = data[at + 12 : at + 16].decode("latin-1")
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if size:
            t["size"], t["samples"] = size, min(n, len(data) // size)  # samples lie in the file
        else:
            t["sizes"] = _table(data, at + 8, end, 4)[:, 0]
            t["samples"] = len(t["sizes"])
    elif kind == b"stz2":
        t["sizes"] = _small_sizes(data, at, end)
        t["samples"] = len(t["sizes"])
    elif kind == b"stsc":
        t["stsc"] = _table(data, at + 4, end, 4, 3)
    elif kind in (b"stco", b"co64"):
        t["chunks"] = _table(data, at + 4, end, 4 if kind == b"stco" else 8)[:, 0]
    elif kind == b"stss":
        t["sync"] = _table(data, at + 4, end, 4)[:, 0]


def _fragment(data: bytes, at: int, run: dict, defaults: dict[int, tuple[int, int, int]]) -> None:
    """The header of a track's fragment: where its data begin and what its samples are unless said otherwise."""
    flags, run["track"] = struct.unpack_from(">II", data, at)
    at += 8
    given = {}
    for bit, width in ((1, 8), (2, 4), (8, 4), (16, 4), (32, 4)):
        if flags & bit:
            (given[bit],) = struct.unpack_from(">Q" if width == 8 else ">I", data, at)
            at += width
    long, size, kind = defaults.get(run["track"], (0, 0, 0))
    if 1 in given:
        run["base"] = given[1]
    elif not (flags & 0x20000 or run["first"]):
        run["base"] = run["next"]
    run["next"] = run["base"]
    run["each"] = given.get(8, long), given.get(16, size), given.get(32, kind)


def _run(data: bytes, at: int, end: int, run: dict) -> tuple[int, int, list | np.ndarray, np.ndarray | None]:
    """Number of samples, duration, their sizes or the size of all in a list, and which are key frames (None: all of them), of a run; its first byte stands before the sizes."""
    flags, n = struct.unpack_from(">II", data, at)
    at += 8
    start = run["next"]
    if flags & 1:
        start = run["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    long, size, kind = run.get("each", (0, 0, 0))
    first = kind
    if flags & 4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    fields = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
    if fields:
        n = min(n, (end - at) // (4 * len(fields)))
        table = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(-1, len(fields))
        column = {b: table[:, k] for k, b in enumerate(fields)}
    else:
        n, column = min(n, len(data) // size if size else n), {}
    duration = int(column[0x100].sum()) if 0x100 in column else n * long
    kinds = column.get(0x400)
    if kinds is None:
        kinds = np.full(min(n, 2), kind)  # the first, and all that follow
    kinds = kinds.copy()
    if flags & 4 and len(kinds):
        kinds[0] = first
    sizes = column.get(0x200)
    total = int(sizes.sum()) if sizes is not None else n * size
    run["next"] = start + total
    return n, duration, (start, sizes if sizes is not None else size), (kinds & 0x10000) == 0


def _ranges_of(run: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts and ends of a run's samples and of its key frames, neighbours of one size taken together, and the number of key frames."""
    n, _, (start, sizes), key = run
    if isinstance(sizes, int) and len(key) <= 2:
        split = min(n, 1)
        starts, ends = np.array([start, start + split * sizes]), np.array([start + split * sizes, start + n * sizes])
        keys = np.array([n > 0 and key[0], n > 1 and key[1]], bool)
        return starts, ends, starts[keys], ends[keys], int(n > 0 and key[0]) + (n - 1 if n > 1 and key[1] else 0)
    ends = start + np.cumsum(sizes if not isinstance(sizes, int) else np.full(n, sizes))
    starts = ends - sizes
    if len(key) < n:
        key = np.append(key[:1], np.full(n - 1, key[1]))
    return starts, ends, starts[key], ends[key], int(key.sum())


def _read(t: dict, size: int) -> dict:
    chunks, stsc = t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
    samples = int(t.get("samples", 0))
    entry = np.searchsorted(np.maximum.accumulate(stsc[:, 0]), np.arange(1, len(chunks) + 1), "right") - 1
    each = np.where(entry >= 0, np.minimum(stsc[np.maximum(entry, 0), 1], samples), 0) if len(stsc) else np.zeros(len(chunks), np.int64)
    done = np.concatenate(([0], np.cumsum(each)))
    n = int(min(samples, done[-1]))
    sync = None if "sync" not in t else np.unique(t["sync"][(t["sync"] >= 1) & (t["sync"] <= n)]) - 1
    if "sizes" not in t and sync is None:  # whole chunks at once
        upto = np.minimum(done[1:], n)
        starts, ends = chunks, chunks + (upto - np.minimum(done[:-1], n)) * t.get("size", 0)
        key_starts, key_ends, number = starts, ends, n
    else:
        sizes = t["sizes"][:n] if "sizes" in t else np.full(n, t.get("size", 0))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        of = np.searchsorted(done, np.arange(n), "right") - 1
        starts = chunks[of] + upto[:n] - upto[np.minimum(done[of], n)]
        ends = starts + sizes
        key_starts, key_ends, number = (starts, ends, n) if sync is None else (starts[sync], ends[sync], len(sync))
    parts = [(starts, ends, key_starts, key_ends, number), *map(_ranges_of, t["runs"])]
    a, b, c, d = (np.concatenate([p[k] for p in parts]) for k in range(4))
    duration = t.get("duration", 0) or sum(r[1] for r in t["runs"])
    return {"codec": t.get("codec"), "timescale": t.get("timescale", 0), "duration": min(duration, (1 << 63) - 1), "edits": t.get("edits", []), "samples": n + sum(r[0] for r in t["runs"]), "keyframes": sum(p[4] for p in parts), "ranges": _joined(a, b, size), "key_ranges": _joined(c, d, size)}


def _joined(starts: np.ndarray, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    ok = (starts >= 0) & (starts < ends) & (ends <= size)
    starts, ends = starts[ok], ends[ok]
    if not len(starts):
        return []
    new = np.concatenate(([True], starts[1:] != ends[:-1]))
    return list(zip(starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def unwrap(data: bytes) -> bytes:
    """The samples of the first track, read back from where its tables say."""
    return b"".join(data[a:b] for t in tracks(data)[:1] for a, b in t["ranges"])


_RANGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_TRACK = T.StructType([T.StructField("codec", T.StringType()), T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("edits", T.ArrayType(T.StructType([T.StructField("duration", T.LongType()), T.StructField("media_time", T.LongType())]))), T.StructField("samples", T.LongType()), T.StructField("keyframes", T.LongType()), T.StructField("key_ranges", _RANGE)])


def probe(df: DataFrame, column: str = "content") -> DataFrame:
    """df with ``tracks``: codec, timescale, duration, edits, samples, number of key frames and their byte ranges, for each track of the container in a binary column."""
    name = fresh(df, "tracks")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(_TRACK))])
    types = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[_row(t) for t in tracks(x.as_py())] for x in b.column(b.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(types.field(c).type) for c in range(b.num_columns)), pa.array(rows, types.field(name).type)], schema=types)

    return df.mapInArrow(work, schema)


def _row(t: dict) -> dict:
    long = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))
    return {k: v for k, v in t.items() if k != "ranges"} | {"key_ranges": [{"start": p, "end": q} for p, q in t["key_ranges"]], "edits": [{"duration": long(a), "media_time": long(b)} for a, b in t["edits"]]}


def _told(t: dict) -> str:
    return "|".join(f"{a}-{b}" for a, b in t["key_ranges"])


def feature(t: dict, payload: bytes) -> str:
    """Of a track: codec, rate, duration, key frames, and from its samples their mean level, crossings of the midline and distinct values."""
    x = np.frombuffer(payload, np.uint8)
    up = x >= 128
    return f"{t['codec'].strip()};rate={t['timescale']};duration={t['duration']};keyframes={t['keyframes']};ranges={_told(t)};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};crossings={int((up[1:] != up[:-1]).sum())};values={int((np.bincount(x, minlength=256) > 0).sum())}"


_COLUMNS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "codec": "string", "timescale": "long", "duration": "long", "keyframes": "long", "key_ranges": "string"}


def _stored(batch: pa.RecordBatch) -> Iterator[dict]:
    out: dict = {k: [] for k in _COLUMNS}
    for x in batch.column(1):
        raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
        media = wrap(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
        t = tracks(media)[0]
        back = b"".join(media[a:b] for a, b in t["ranges"])
        track = t | {"key_ranges": _told(t)}
        for k, v in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(t, back), *(track[c] for c in list(_COLUMNS)[7:])), strict=True):
            out[k].append(v)
    yield {"doc_id": batch.column(0), **out}


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T._parse_datatype_string("doc_id long, " + ", ".join(f"`{c}` {t}" for c, t in _COLUMNS.items()))
    return map_arrow(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _stored, schema)


def _hex(n: int | str, digits: int = 8) -> str:
    """SQL for a number, or SQL, as hexadecimal digits."""
    return f"printf('%0{digits}x', {n})"


def _sql() -> str:
    """DuckDB SQL of the query: the container of wrap() put together as hexadecimal digits (payloads below 4 GiB), the payload read back from it, the features from its bytes."""
    said = lambda b: f"'{b.hex()}'"
    box = lambda kind, size, *body: " || ".join([_hex(f"{size} + 8"), said(kind), *body])
    stsd = _full(b"stsd", "I", 1, rest=_box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16)))
    head = lambda kind, rest: " || ".join([_hex(4 + rest + 8), said(kind), "'00000000'"])
    stts = f"{head(b'stts', 12)} || '00000001' || {_hex('n')} || '00000001'"
    stsc = f"case when chunks > 1 and last <> {CHUNK} then {_hex(40)} || {said(b'stsc')} || '0000000000000002' || '00000001' || {_hex(CHUNK)} || '00000001' || {_hex('chunks')} || {_hex('last')} || '00000001' else {_hex(28)} || {said(b'stsc')} || '0000000000000001' || '00000001' || case when chunks = 1 then {_hex('last')} else {_hex(CHUNK)} end || '00000001' end"
    stsz = f"{head(b'stsz', 8)} || '00000001' || {_hex('n')}"
    table = f"array_to_string(list_transform(range(chunks), lambda k: {_hex(f'first_ + {CHUNK} * k')}), '')"
    stco = f"{box(b'stco', '8 + 4 * chunks')} || '00000000' || {_hex('chunks')} || {table}"
    stbl = f"({len(stsd)} + 24 + case when chunks > 1 and last <> {CHUNK} then 40 else 28 end + 20 + 16 + 4 * chunks)"
    smhd, dinf = _full(b"smhd", "hH", 0, 0), _box(b"dinf", _full(b"dref", "I", 1, rest=struct.pack(">I4sI", 12, b"url ", 1)))
    hdlr = _full(b"hdlr", "I4s12s", 0, b"soun", bytes(12), rest=b"\0")
    long = _hex("n", 16)
    mdhd = " || ".join([_hex(44), said(b"mdhd"), said(struct.pack(">IQQI", 1 << 24, 0, 0, RATE)), long, said(struct.pack(">HH", 0x55C4, 0))])
    tkhd = " || ".join([_hex(104), said(b"tkhd"), said(struct.pack(">IQQII", 1 << 24, 0, 0, 1, 0)), long, said(struct.pack(">QHHHH", 0, 0, 0, 0x0100, 0) + _MATRIX + bytes(8))])
    mvhd = " || ".join([_hex(120), said(b"mvhd"), said(struct.pack(">IQQI", 1 << 24, 0, 0, RATE)), long, said(struct.pack(">IH10s", 0x10000, 0x0100, bytes(10)) + _MATRIX + bytes(24) + struct.pack(">I", 2))])
    minf = f"({stbl} + 8 + {len(smhd) + len(dinf)})"
    mdia = f"({minf} + 8 + 44 + {len(hdlr)})"
    trak = f"({mdia} + 8 + 104)"
    moov = f"({trak} + 8 + 120)"
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ")
    media = " || ".join([said(ftyp), box(b"moov", moov), mvhd, box(b"trak", trak), tkhd, box(b"mdia", mdia), mdhd, said(hdlr), box(b"minf", minf), said(smhd), said(dinf), box(b"stbl", stbl), said(stsd), stts, stsc, stsz, stco, box(b"mdat", "n"), "payload"])
    crc = f"""xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(list_slice(bytes, n - {UNIT - 1}, n), lambda c: c::ubigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::ubigint)), lambda x, k: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint)"""
    return f"""
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) as raw from documents),
p as (select doc_id, length(raw) // 2 as n_bytes, rpad(raw, cast(greatest({UNIT}, (length(raw) // 2 + {UNIT - 1}) // {UNIT} * {UNIT}) * 2 as int), '0') as payload from d),
q as (select doc_id, n_bytes, payload, length(payload) // 2 as n from p),
c as (select *, (n + {CHUNK - 1}) // {CHUNK} as chunks, case when n % {CHUNK} = 0 then {CHUNK} else n % {CHUNK} end as last from q),
o as (select *, {len(ftyp)} + {moov} + 8 + 8 as first_, list_transform(regexp_extract_all(payload, '..'), lambda x: cast('0x' || x as int)) as bytes from c),
m as (select *, {media} as media from o),
s as (select *, unhex(media) as stored, unhex(substr(media, first_ * 2 + 1, n * 2)) as back from m)
select doc_id, n_bytes, octet_length(back) as payload_bytes, sha256(back) as payload_sha256, cast({crc} as bigint) as tail_crc32, octet_length(stored) as media_bytes, sha256(stored) as media_sha256,
  'raw;rate={RATE};duration=' || n || ';keyframes=' || n || ';ranges=' || first_ || '-' || (first_ + n) || ';mean=' || list_sum(bytes)::bigint * 1000 // n || ';crossings=' || len(list_filter(list_zip(bytes, list_slice(bytes, 2, n)), lambda z: z[2] is not null and (z[1] >= 128) <> (z[2] >= 128))) || ';values=' || len(list_distinct(bytes)) as feature,
  'raw ' as codec, cast({RATE} as bigint) as timescale, n as duration, n as keyframes, first_ || '-' || (first_ + n) as key_ranges
from s
"""


SQL = _sql()
