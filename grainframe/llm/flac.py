"""FLAC media columns: payloads of bytes as 8-bit mono samples, in frames of 192 samples with seek points.

Frames are independent, so all frames of a slice of rows are encoded and decoded side by side: a numpy step handles one
sample, or one byte of a checksum, of thousands of frames. The decoder finds frames by sync code, header checksum and frame
number, verifies the checksum of every frame and the stream's MD5, reads Rice residuals (partitions and escapes included)
and undoes fixed and general linear predictors. The encoder chooses among constant, verbatim and fixed predictors.

One map over the rows; nothing is shuffled. The memory of a task is bounded by a batch and by ``SLICE_BYTES``; a longer
payload is a slice by itself.

Defined results: a null payload is stored as an empty stream of no frames, and so is an empty one. A damaged stream raises
``ValueError`` with the place of the damage. Columns made here replace others of their names; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainframe.llm.common import columns_of, free_name, table, without

BLOCK = 192
SAMPLE_RATE = 8000
SEEK_EVERY = 64
SLICE_BYTES = 1_500_000
#: Zeros of a unary part that the encoder writes at most; the decoder reads up to 48 with a parameter of 7.
MAX_UNARY = 40
_HEADER = np.array([0xFF, 0xF8, 0x10, 0x02], dtype=np.uint8)  # fixed blocks of 192 samples, mono, 8 bits
CONSTANT, VERBATIM, FIXED, LPC = 0, 1, 8, 32


@lru_cache
def _table(bits: int, polynomial: int) -> np.ndarray:
    out = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ polynomial, out << 1) & ((1 << bits) - 1)
    return out


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of FLAC of many byte ranges side by side."""
    table_ = _table(bits, 0x07 if bits == 8 else 0x8005)
    mask = (1 << bits) - 1
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    crc = np.zeros(len(at), dtype=np.int64)
    live = len(at)
    for j in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= j:
            live = int(np.searchsorted(-n, -j, side="left"))
        part = crc[:live]
        crc[:live] = ((part << 8) & mask) ^ table_[(part >> (bits - 8)) ^ data[at[:live] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the UTF-8-like code of FLAC: bytes (rows of 6) and their lengths."""
    n = 1 + sum((values >= limit).astype(np.int64) for limit in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    out = np.zeros((len(values), 6), dtype=np.uint8)
    out[:, 0] = np.where(n == 1, values, (0xFF00 >> n) & 0xFF | values >> (6 * (n - 1)))
    for j in range(1, 6):
        out[:, j] = 0x80 | values >> (6 * np.maximum(0, n - 1 - j)) & 0x3F
    return out, n


def _frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded frames of rows of 192 samples, one after another, and their lengths in bytes."""
    count = len(samples)
    x = samples.astype(np.int32)
    residuals, d = [x], x
    for _ in range(4):
        d = np.diff(d, axis=1)
        residuals.append(d)
    order = np.argmin([np.abs(r[:, r.shape[1] - (BLOCK - 4) :]).sum(axis=1) for r in residuals], axis=0)
    column = np.arange(BLOCK)
    u = np.zeros_like(x)
    for o, r in enumerate(residuals):
        rows = order == o
        u[rows, o:] = (r[rows] << 1) ^ (r[rows] >> 31)
    warm = column[None, :] < order[:, None]
    costs = np.array([np.where(warm, 8, (u >> k) + 1 + k).sum(axis=1) for k in range(8)])
    costs[(u.max(axis=1)[None, :] >> np.arange(8)[:, None]) > MAX_UNARY] = 1 << 40
    k = np.argmin(costs, axis=0)
    kind = FIXED + order
    kind[costs[k, np.arange(count)] + 10 >= 8 * BLOCK] = VERBATIM
    kind[(x == x[:, :1]).all(axis=1)] = CONSTANT
    raw = warm | (kind == VERBATIM)[:, None] | (kind == CONSTANT)[:, None]
    q = np.where(raw, 0, u >> k[:, None])
    lengths = np.where(raw, 8, q + 1 + k[:, None])
    lengths[kind == CONSTANT, 1:] = 0
    rice = kind >= FIXED

    used = 8 + lengths.sum(axis=1) + 10 * rice
    body = -(-used // 8)
    first = np.cumsum(body * 8) - body * 8
    bits = np.zeros(int(body.sum()) * 8, dtype=np.uint8)
    at = first[:, None] + 8 + np.cumsum(lengths, axis=1) - lengths + 10 * (rice[:, None] & ~warm)
    for j in range(8):
        bits[first + j] = kind << 1 >> (7 - j) & 1  # the header of a subframe: a zero, its type, no wasted bits
        where = raw & (lengths > 0)
        bits[at[where] + j] = x[where] >> (7 - j) & 1
    head = first[rice] + 8 + 8 * order[rice]
    for j in range(4):
        bits[head + 6 + j] = k[rice] >> (3 - j) & 1
    mark = (at + q)[~raw]
    bits[mark] = 1
    low, width = u[~raw], np.broadcast_to(k[:, None], u.shape)[~raw]
    for j in range(int(k.max()) if count else 0):
        some = width > j
        bits[mark[some] + 1 + j] = low[some] >> (width[some] - 1 - j) & 1

    number, n = _numbers(numbers)
    total = 4 + n + 1 + body + 2
    start = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), dtype=np.uint8)
    for j in range(4):
        out[start + j] = _HEADER[j]
    for j in range(6):
        some = n > j
        out[(start + 4 + j)[some]] = number[some, j]
    out[start + 4 + n] = checksums(out, start, 4 + n, 8)
    out[_spread(start + 5 + n, body)] = np.packbits(bits)
    crc = checksums(out, start, total - 2, 16)
    out[start + total - 2], out[start + total - 1] = crc >> 8, crc & 255
    return out, total


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose length is a multiple of 192; a byte b is the sample b - 128."""
    if any(len(p) % BLOCK for p in payloads):
        raise ValueError(f"a payload is no multiple of {BLOCK} bytes")
    counts = np.array([len(p) // BLOCK for p in payloads], dtype=np.int64)
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    signed = (data ^ 0x80).view(np.int8)
    coded, sizes = _frames(signed.reshape(-1, BLOCK), _spread(np.zeros(len(counts), dtype=np.int64), counts))
    blob, ends = coded.tobytes(), np.concatenate([[0], np.cumsum(sizes)])
    lasts = np.cumsum(counts)
    out = []
    for payload, n, last in zip(payloads, counts.tolist(), lasts.tolist()):
        own, offsets = sizes[last - n : last], ends[last - n : last + 1]
        low, high = (int(own.min()), int(own.max())) if n else (0, 0)
        packed = (SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(payload)
        digest = hashlib.md5(bytes(payload).translate(_FLIP), usedforsecurity=False).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + low.to_bytes(3, "big") + high.to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
        points = b"".join((i * BLOCK).to_bytes(8, "big") + int(offsets[i] - offsets[0]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for i in range(0, n, SEEK_EVERY))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + blob[offsets[0] : offsets[-1]])
    return out


_FLIP = bytes(b ^ 0x80 for b in range(256))


def stream_info(stream: bytes) -> tuple[int, bytes, list[tuple[int, int]], int]:
    """Samples, MD5, seek points (sample, byte after the metadata) and the place of the first frame."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, samples, digest, points, last = 4, 0, b"", [], False
    while not last:
        if at + 4 > len(stream):
            raise ValueError(f"metadata breaks off at byte {at}")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        data = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(data[10:18], "big")
            samples, digest = packed & (1 << 36) - 1, data[18:34]
            if packed >> 36 & 31 != 7 or packed >> 41 & 7 or data[:4] != BLOCK.to_bytes(2, "big") * 2:
                raise ValueError("not a mono stream of 8 bits in blocks of 192")
        elif kind == 3:
            points = [(int.from_bytes(data[i : i + 8], "big"), int.from_bytes(data[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
        at += 4 + size
    return samples, digest, points, at


def _find_frames(data: np.ndarray, first: np.ndarray, stop: np.ndarray, number_from: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all frames of many streams in ``data``, and lengths of their headers."""
    sync = np.flatnonzero((data[:-5] == 0xFF) & (data[1:-4] == 0xF8) & (data[2:-3] == 0x10) & (data[3:-2] == 0x02)) if len(data) > 5 else np.zeros(0, dtype=np.int64)
    of = np.searchsorted(first, sync, side="right") - 1
    sync, of = sync[(of >= 0)], of[of >= 0]
    inside = sync < stop[of]
    sync, of = sync[inside], of[inside]
    lead = data[sync + 4].astype(np.int64)
    n = np.where(lead < 0x80, 1, np.select([lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 2, 3, 4, 5], 6))
    number = np.where(n == 1, lead, lead & (0x7F >> n))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    for j in range(1, 6):
        number = np.where(n > j, number << 6 | padded[sync + 4 + j] & 0x3F, number)
    good = (n > 0) & (checksums(padded, sync, 4 + np.maximum(1, n), 8) == padded[sync + 4 + n])
    sync, of, n, number = sync[good], of[good], n[good], number[good]
    wanted = _spread(number_from, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not (len(sync) == len(wanted) and (number == wanted).all() and (of == owner).all()):
        keep, i = [], 0
        for s in range(len(sync)):  # a code inside a frame that looks like a header has another number
            if i < len(wanted) and of[s] == owner[i] and number[s] == wanted[i]:
                keep.append(s)
                i += 1
        if i < len(wanted):
            raise ValueError(f"frame {wanted[i]} of stream {owner[i]} isn't there")
        sync, n = sync[keep], n[keep]
    return sync, 5 + n


class _Bits:
    """Reading from many places of one byte array at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(24 + -len(data) % 8, dtype=np.uint8)])
        n = (len(padded) - 8) // 8
        self.words = np.empty((n, 8), dtype=np.uint64)
        for j in range(8):
            self.words[:, j] = np.frombuffer(padded, dtype=">u8", count=n, offset=j)
        self.words = self.words.reshape(-1)

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place, at the top."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.window(at).view(np.int64) >> (64 - n)


def _subframes(bits: _Bits, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of frames whose subframes begin at these bits; their kinds and first Rice parameters."""
    count = len(at)
    x = np.zeros((count, BLOCK), dtype=np.int64)
    head = bits.read(at, 8)
    if (head & 0x81).any():
        raise ValueError("a subframe's header is damaged or has wasted bits")
    kind = head >> 1
    at = at + 8
    order = np.select([kind >= LPC, kind >= FIXED], [kind - LPC + 1, kind - FIXED], 0)
    if ((kind > VERBATIM) & (kind < FIXED) | (kind > FIXED + 4) & (kind < LPC)).any():
        raise ValueError("reserved kind of subframe")
    same = np.flatnonzero(kind == CONSTANT)
    x[same] = bits.signed(at[same], 8)[:, None]
    plain = np.flatnonzero(kind == VERBATIM)
    for c in range(BLOCK if len(plain) else 0):
        x[plain, c] = bits.signed(at[plain] + 8 * c, 8)

    coded = np.flatnonzero(kind >= FIXED)
    parameter = np.full(count, -1)
    if not len(coded):
        return x, kind, parameter
    order_, at = order[coded], at[coded]
    r = np.zeros((len(coded), BLOCK), dtype=np.int64)
    for c in range(int(order_.max())):
        some = order_ > c
        r[some, c] = bits.signed(at[some] + 8 * c, 8)
    at = at + 8 * order_
    linear = np.flatnonzero(kind[coded] >= LPC)
    coefficients, shift = np.zeros((len(coded), 32), dtype=np.int64), np.zeros(len(coded), dtype=np.int64)
    if len(linear):
        precision = bits.read(at[linear], 4) + 1
        shift[linear] = bits.signed(at[linear] + 4, 5)
        if (precision == 16).any() or (shift[linear] < 0).any():
            raise ValueError("reserved predictor")
        for c in range(int(order_[linear].max())):
            some = order_[linear] > c
            rows = linear[some]
            window = bits.window(at[rows] + 9 + c * precision[some]).view(np.int64)
            coefficients[rows, c] = window >> (64 - precision[some])
        at[linear] += 9 + precision * order_[linear]
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any() or (BLOCK % (1 << parts.max())) != 0:
        raise ValueError("reserved residual code")
    at = at + 6
    width, size = np.where(method == 0, 4, 5), BLOCK >> parts
    k, raw = np.zeros(len(coded), dtype=np.int64), np.full(len(coded), -1)
    begins = {int(o) for o in np.unique(order_)} | {c for s in np.unique(size) for c in range(0, BLOCK, int(s))}
    for c in range(BLOCK):
        live = slice(None) if c >= order_.max() else np.flatnonzero(order_ <= c)
        if c in begins:
            here = np.flatnonzero((order_ <= c) & ((c == order_) | (c % size == 0)))
            if len(here):
                window = bits.window(at[here])
                k[here] = (window >> (64 - width[here]).astype(np.uint64)).astype(np.int64)
                at[here] += width[here]
                escape = here[k[here] == (1 << width[here]) - 1]
                raw[here] = -1
                if len(escape):
                    raw[escape] = bits.read(at[escape], 5)
                    at[escape] += 5
        place, k_live = at[live], k[live]
        window = bits.window(place)
        q = 53 - np.frexp((window >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        if (q + k_live > 55).any() and ((q + k_live > 55) & (raw[live] < 0)).any():
            raise ValueError("a residual is longer than any of 8-bit samples needs to be")
        value = q << k_live | (((window << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - k_live).astype(np.uint64)).astype(np.int64)
        r[live, c] = value >> 1 ^ -(value & 1)
        used = q + 1 + k_live
        if (raw >= 0).any():
            rows = np.arange(len(coded))[live]
            escaped = raw[rows] >= 0
            n = raw[rows[escaped]]
            r[rows[escaped], c] = np.where(n > 0, (window[escaped].view(np.int64) >> np.minimum(63, 64 - n)), 0)
            used[escaped] = n
        at[live] = place + used
    first = k.copy()

    for o in range(5):
        rows = np.flatnonzero(kind[coded] == FIXED + o)
        if o and len(rows):
            warm, tail = r[rows, :o], r[rows, o:]
            for j in range(o):
                tail = np.diff(warm, n=o - 1 - j, axis=1)[:, -1:] + np.cumsum(tail, axis=1)
            r[rows, o:] = tail
    for o in np.unique(order_[linear]).tolist():
        rows = linear[order_[linear] == o]
        back = coefficients[rows, :o][:, ::-1]
        for c in range(o, BLOCK):
            r[rows, c] += (r[rows, c - o : c] * back).sum(axis=1) >> shift[rows]
    x[coded] = r
    parameter[coded] = first
    return x, kind, parameter


def _read(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, headers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = stops - starts
    crc = checksums(data, starts, sizes - 2, 16)
    wrong = np.flatnonzero(crc != data[stops - 2].astype(np.int64) << 8 | data[stops - 1])
    if len(wrong):
        raise ValueError(f"checksum of the frame at byte {starts[wrong[0]]} is wrong")
    return _subframes(_Bits(data), (starts + headers) * 8)


def decode(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray], list[str]]:
    """Payload, byte places of the frames, and a summary of the coding, of each stream."""
    infos = [stream_info(s) for s in streams]
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    begins = ends - [len(s) for s in streams]
    counts = np.array([-(-i[0] // BLOCK) for i in infos], dtype=np.int64)
    first = begins + [i[3] for i in infos]
    starts, headers = _find_frames(data, first, ends, np.zeros(len(counts), dtype=np.int64), counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    following = np.concatenate([starts[1:], [0]]) if len(starts) else starts
    lasts = np.cumsum(counts)[counts > 0] - 1
    following[lasts] = ends[counts > 0]
    x, kind, k = _read(data, starts, following, headers)
    flat = (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
    payloads, places, features = [], [], []
    last = 0
    for i, (n, info) in enumerate(zip(counts.tolist(), infos)):
        payload = flat[last * BLOCK : last * BLOCK + info[0]]
        if hashlib.md5(payload.translate(_FLIP), usedforsecurity=False).digest() != info[1]:
            raise ValueError(f"MD5 of stream {i} is wrong")
        own, rice = kind[last : last + n], k[last : last + n]
        orders = np.bincount(own[own >= FIXED] - FIXED, minlength=5) if n else np.zeros(5, dtype=int)
        features.append(f"frames={n} constant={int((own == CONSTANT).sum())} verbatim={int((own == VERBATIM).sum())} fixed={'/'.join(map(str, orders[:5].tolist()))} rice={int(rice[rice >= 0].sum())}")
        payloads.append(payload)
        places.append(starts[last : last + n] - begins[i])
        last += n
    return payloads, places, features


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Bytes of the payload from sample ``start`` on, from the frames after the nearest seek point only."""
    samples, _, points, first = stream_info(stream)
    stop = min(samples, start + count)
    if not 0 <= start < stop:
        return b""
    at = max((p for p in points if p[0] <= start), default=(0, 0))
    beyond = min((p for p in points if p[0] >= stop), default=(samples, len(stream) - first))
    data = np.frombuffer(stream, dtype=np.uint8)[first + at[1] : first + beyond[1]]
    n = -(-(beyond[0] - at[0]) // BLOCK)
    starts, headers = _find_frames(data, np.array([0]), np.array([len(data)]), np.array([at[0] // BLOCK]), np.array([n]))
    x, _, _ = _read(data, starts, np.concatenate([starts[1:], [len(data)]]), headers)
    return (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()[start - at[0] : stop - at[0]]


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def flac_store(docs: DataFrame, payload: str = "payload", media: str = "media", back: str | None = None, feature: str | None = None) -> DataFrame:
    """``docs`` with ``media``: the FLAC stream of each payload (binary, padded to a multiple of 192 bytes already).

    With names for them, also ``back``, the payload as the stored bytes decode, and ``feature``, a summary of the coding.
    """
    made = [media, *(n for n in (back, feature) if n)]
    base = without(docs, *made)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x or b"" for x in batch.column(len(names)).to_pylist()]
            for i, j in _slices([len(x) for x in data]):
                streams = encode(data[i:j])
                columns = [pa.array(streams, pa.binary())]
                if len(made) > 1:
                    payloads, _, features = decode(streams)
                    columns += [pa.array(payloads, pa.binary())] * bool(back) + [pa.array(features, pa.string())] * bool(feature)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[: len(names)], *columns], names=[*names, *made])

    types = [f"`{media}` binary"] + [f"`{back}` binary"] * bool(back) + [f"`{feature}` string"] * bool(feature)
    source = base.select("*", F.col(payload).cast("binary").alias(free_name(base, "payload_bytes"))) if payload in names else docs.select(*(F.col(f"`{n}`") for n in names), F.col(payload).cast("binary").alias(free_name(base, "payload_bytes")))
    return source.mapInArrow(run, ", ".join([*([columns_of(base)] if names else []), *types]))


def flac_blocks(frame: DataFrame, media: str = "media") -> DataFrame:
    """PCM blocks of stored streams: all columns but ``media``, and ``block, sample_offset, byte_offset, pcm`` of each frame."""
    base = without(frame, media, "block", "sample_offset", "byte_offset", "pcm")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(len(names)).to_pylist()
            for i, j in _slices([len(x or b"") for x in streams]):
                own = [x for x in streams[i:j] if x is not None]
                payloads, places, _ = decode(own) if own else ([], [], [])
                rows = np.repeat(np.array([r for r in range(i, j) if streams[r] is not None], dtype=np.int64), [len(p) for p in places])
                blocks = np.concatenate([np.arange(len(p)) for p in places]) if places else np.zeros(0, dtype=np.int64)
                pcm = [p[b : b + BLOCK] for p in payloads for b in range(0, len(p), BLOCK)]
                at = np.concatenate(places) if places else blocks
                kept = [c.take(pa.array(rows)) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(blocks, pa.int64()), pa.array(blocks * BLOCK, pa.int64()), pa.array(at, pa.int64()), pa.array(pcm, pa.binary())], names=[*names, "block", "sample_offset", "byte_offset", "pcm"])

    source = frame.select(*(F.col(f"`{n}`") for n in names), F.col(media).cast("binary").alias(free_name(base, "stream_bytes")))
    return source.mapInArrow(run, f"{columns_of(base) + ', ' if names else ''}block bigint, sample_offset bigint, byte_offset bigint, pcm binary")


def op5(spark, sf_dir: str) -> DataFrame:
    """``op5_flac_media``: every text as a FLAC stream, read back."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    n = F.octet_length(data)
    blocks = F.greatest(F.lit(1), F.ceil(n / BLOCK).cast("int"))
    padded = F.concat(data, F.repeat(F.lit(" "), blocks * BLOCK - n).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), padded.alias("payload"))
    stored = flac_store(docs, back="back", feature="feature").drop("payload")
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("back").cast("long").alias("payload_bytes"),
        F.sha2("back", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("back"), -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
