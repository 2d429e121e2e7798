"""FLAC streams of 8-bit mono samples: a vectorised encoder and decoder.

Frames are handled side by side: numpy works on the same sample of many frames at a time, so the
sequential parts of the format (Rice codes, linear prediction, checksums) cost a few array
operations for each position of a frame and not Python work for each sample. At most ``FRAMES``
frames are in memory at once, however long a text is.

The encoder picks, frame by frame, the cheapest of constant, verbatim, fixed predictors and a
quantised linear predictor, with a Rice parameter. Streams carry a seek table with a point for
each frame. The decoder reads any mono stream with fixed block size; streams without a full seek
table are cut at frame headers whose checksums fit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpalith.llm.common import like, slices

BLOCK = 1024
FRAMES = 768
UNIT = 64
ORDER = 4
PRECISION = 12
SHIFT = 9


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint32)


#: Polynomials of the format's checksums.
CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Checksums of many byte ranges at once; leading zero bytes don't change a checksum, so ranges are aligned at their ends."""
    longest = int((stops - starts).max(initial=0))
    crc = np.zeros(len(starts), np.uint32)
    at = stops - longest
    for _ in range(longest):
        byte = np.where(at >= starts, buf[np.maximum(at, 0)], 0)
        crc = ((crc << 8) & 0xFFFF) ^ CRC16[(crc >> 8) ^ byte]
        at = at + 1
    return crc


def _utf8(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1)), *tail])


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _residual(x: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    """x minus its prediction; coefs has a row for each frame, newest sample first."""
    predicted = np.zeros(x.shape, np.int32)
    for j in range(coefs.shape[1]):
        predicted[:, j + 1 :] += coefs[:, j : j + 1] * x[:, : -j - 1]
    return x - (predicted >> shift)


def _cost(r: np.ndarray, live: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, Rice parameters and bits of each frame; the warm-up samples don't count."""
    u = np.where(live, (r << 1) ^ (r >> 31), 0)
    u[:, :order] = 0
    n = np.maximum(live.sum(1) - order, 1)
    mean = u.sum(1, dtype=np.int64) / n
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int32)
    bits = (u >> k[:, None]).sum(1, dtype=np.int64) + n * (k + 1)
    return u, k, bits


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised linear predictor coefficients of each frame by least squares on its autocorrelation."""
    f = x.astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(ORDER + 1)], 1).astype(float)
    lags = np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))
    system = auto[:, lags] + np.eye(ORDER) * (auto[:, :1, None] * 1e-4 + 1)
    coefs = np.linalg.solve(system, auto[:, 1:, None])[:, :, 0]
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(coefs * (1 << SHIFT)), -top, top).astype(np.int32)


def encode_frames(blocks: list[tuple[int, bytes]]) -> list[bytes]:
    """The frames of (frame number, payload bytes); each payload is 1 to ``BLOCK`` long."""
    rows, width = len(blocks), max(ORDER + 1, *(len(b) for _, b in blocks))
    n = np.array([len(b) for _, b in blocks])
    raw = np.frombuffer(b"".join(b.ljust(width, b"\x80") for _, b in blocks), np.uint8).reshape(rows, width)
    x = raw.astype(np.int32) - 128
    live = np.arange(width) < n[:, None]

    kind = np.full(rows, 1)  # verbatim
    best = 8 * n.astype(np.int64)
    order, k, coefs = np.zeros(rows, np.int32), np.zeros(rows, np.int32), np.zeros((rows, ORDER), np.int32)
    code = np.zeros((rows, width), np.int32)
    tried = [(8 + o, o, np.tile(np.array(FIXED[o], np.int32), (rows, 1)).reshape(rows, o), 0) for o in (0, 1, 2)]
    tried.append((31 + ORDER, ORDER, _predictors(x), SHIFT))
    for name, o, c, shift in tried:
        u, rice, bits = _cost(_residual(x, c, shift), live, o)
        bits += 10 + 8 * o + (9 + PRECISION * o) * (name > 31)
        wins = (bits < best) & (n > o)
        kind[wins], best[wins], order[wins], k[wins] = name, bits[wins], o, rice[wins]
        code[wins] = u[wins]
        if name > 31:
            coefs[wins] = c[wins]
    constant = (np.where(live, x, x[:, :1]) == x[:, :1]).all(1)
    kind[constant], order[constant] = 0, 0

    # Columns: header, subframe header, coefficients, residual header, samples; a value's bits end where its length does.
    numbers = [_utf8(i) for i, _ in blocks]
    head = np.zeros((rows, 14), np.int32)
    there = np.zeros((rows, 14), bool)
    for r, number in enumerate(numbers):
        head[r, :4] = 0xFF, 0xF8, 0x70, 0x02
        head[r, 4 : 4 + len(number)] = list(number)
        there[r, : 4 + len(number)] = True
    head[:, 11], head[:, 12] = (n - 1) >> 8, (n - 1) & 255
    there[:, 11:] = True
    crc = np.zeros(rows, np.uint32)
    for c in range(13):
        crc = np.where(there[:, c], CRC8[crc ^ head[:, c].astype(np.uint32)], crc)
    head[:, 13] = crc

    coded = kind > 1
    linear = kind > 31
    warm = np.arange(width) < order[:, None]
    plain = live & (warm | (kind == 1)[:, None])
    plain[constant, 0] = True
    rice = live & ~warm & coded[:, None]
    value = np.where(plain, x & 255, np.where(rice, code & ((1 << k) - 1)[:, None] | (1 << k)[:, None], 0))
    length = np.where(plain, 8, np.where(rice, (k + 1)[:, None], 0))
    whole = np.where(rice, length + (code >> k[:, None]), length)

    def columns(values: list[np.ndarray], bits: list[int], on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.stack(values, 1)
        return np.where(on[:, None], v, 0), np.where(on[:, None], np.array(bits), 0)

    zero = np.zeros(rows, np.int32)
    setup = columns([zero + PRECISION - 1, zero + SHIFT, *(coefs[:, j] & ((1 << PRECISION) - 1) for j in range(ORDER))], [4, 5, *[PRECISION] * ORDER], linear)
    before = columns([zero, zero, k], [2, 4, 4], coded)
    first = np.where(warm, 8, 0)
    # Warm-up samples come before coefficients and residual header: cut the sample columns there.
    lead = ORDER
    values = np.concatenate([head, (kind << 1)[:, None], np.where(first[:, :lead] > 0, value[:, :lead], 0), setup[0], before[0], np.where(first[:, :lead] > 0, 0, value[:, :lead]), value[:, lead:]], 1)
    sizes = np.concatenate([there * 8, np.full((rows, 1), 8), first[:, :lead], setup[1], before[1], np.where(first[:, :lead] > 0, 0, length[:, :lead]), length[:, lead:]], 1)
    spans = sizes.copy()
    spans[:, -width:] = np.where(np.concatenate([first[:, :lead] > 0, np.zeros((rows, width - lead), bool)], 1), 0, whole)

    ends = np.cumsum(spans, 1)
    size = (ends[:, -1] + 7) // 8 + 2
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    ends = ends + start[:, None] * 8
    on = sizes > 0
    end, v = ends[on], values[on].astype(np.int64)
    word = (end - 1) >> 4
    v = v << (16 * (word + 1) - end)
    total = int(size.sum())
    words = np.bincount(word, v & 0xFFFF, (total + 3) // 2 + 1) + np.bincount(np.maximum(word - 1, 0), v >> 16, (total + 3) // 2 + 1)
    buf = words.astype(">u2").view(np.uint8)[:total].copy()
    sums = crc16(buf, start, start + size - 2)
    buf[start + size - 2], buf[start + size - 1] = sums >> 8, sums & 255
    flat = buf.tobytes()
    return [flat[a : a + s] for a, s in zip(start.tolist(), size.tolist(), strict=True)]


def _chunks(items: Iterable, size: int) -> Iterator[list]:
    held: list = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def encode(payloads: list[bytes], block: int = BLOCK, rate: int = 8000) -> list[bytes]:
    """A stream for each payload of bytes, taken as unsigned 8-bit samples. Payloads are not empty."""
    todo = ((d, i // block, p[i : i + block]) for d, p in enumerate(payloads) for i in range(0, len(p), block))
    frames: list[list[bytes]] = [[] for _ in payloads]
    for part in _chunks(todo, FRAMES):
        for (d, _, _), made in zip(part, encode_frames([(i, b) for _, i, b in part]), strict=True):
            frames[d].append(made)
    out = []
    for p, made in zip(payloads, frames, strict=True):
        sizes = [len(f) for f in made]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek, at = [], 0
        for i, s in enumerate(sizes):
            seek.append((i * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(p) - i * block).to_bytes(2, "big"))
            at += s
        table = b"".join(seek)
        if len(table) >= 1 << 24:  # beyond what a metadata block holds the stream goes without
            meta = b"\x80" + len(info).to_bytes(3, "big") + info
        else:
            meta = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        out.append(b"fLaC" + meta + b"".join(made))
    return out


@dataclass
class Frame:
    """Where a frame lies in its stream and what its header says."""

    start: int
    stop: int
    number: int
    samples: int
    body: int


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, samples, first byte after) of a mono frame header, or None if there is none."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    if data[at + 3] >> 4 or data[at + 3] & 1:
        return None
    p, first = at + 5, data[at + 4]
    number, more = first, 0
    if first & 0x80:
        more = 7 - (first ^ 0xFF).bit_length()
        number = first & (0x7F >> (more + 1))
        for _ in range(more):
            number, p = number << 6 | data[p] & 0x3F, p + 1
    if size == 6:
        samples, p = data[p] + 1, p + 1
    elif size == 7:
        samples, p = (data[p] << 8 | data[p + 1]) + 1, p + 2
    else:
        samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    p += (rate == 12) + 2 * (rate in (13, 14))
    crc = 0
    for byte in data[at:p]:
        crc = int(CRC8[crc ^ byte])
    return (number, samples, p + 1) if p < len(data) and crc == data[p] else None


def frames_of(data: bytes) -> tuple[list[Frame], int, bytes]:
    """(frames, bits of a sample, MD5 of the samples) of a stream."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, bits, md5, total = 4, False, [], 8, b"", 0
    while not last:
        last, kind, size = data[at] >> 7 == 1, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        part = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(part[10:18], "big")
            bits, total, md5 = (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), part[18:34]
            if packed >> 41 & 7:
                raise ValueError("not mono")
        elif kind == 3:
            points = [(int.from_bytes(part[i + 8 : i + 16], "big"), int.from_bytes(part[i + 16 : i + 18], "big")) for i in range(0, size, 18) if part[i : i + 8] != b"\xff" * 8]
        at += 4 + size
    if sum(n for _, n in points) == total and points:
        cuts = [at + offset for offset, _ in points]
    else:  # every sync code whose header fits and before which a frame's checksum fits
        cuts, p = [at], data.find(b"\xff", at + 6)
        whole = np.frombuffer(data, np.uint8)
        while p >= 0:
            if (h := _header(data, p)) and h[0] == len(cuts):
                stop = np.array([p - 2])
                if int(crc16(whole, np.array([cuts[-1]]), stop)[0]) == data[p - 2] << 8 | data[p - 1]:
                    cuts.append(p)
            p = data.find(b"\xff", p + 1)
    out = []
    for start, stop in zip(cuts, [*cuts[1:], len(data)], strict=True):
        if (h := _header(data, start)) is None:
            raise ValueError(f"no frame header at byte {start}")
        out.append(Frame(start, stop, h[0], h[1], h[2]))
    return out, bits, md5


class _Bits:
    """Reads at a bit position of each of many frames in one buffer."""

    def __init__(self, buf: np.ndarray) -> None:
        padded = np.concatenate((buf, np.zeros(16, np.uint8)))
        self.window = np.zeros(len(buf) + 8, np.uint64)
        for i in range(8):
            self.window |= padded[i : i + len(buf) + 8].astype(np.uint64) << np.uint64(56 - 8 * i)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        return self.window[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of ``width`` bits (56 at most; 0 gives 0)."""
        w = np.broadcast_to(np.asarray(width, np.uint64), pos.shape)
        return np.where(w > 0, self.peek(pos) >> (np.uint64(64) - np.maximum(w, np.uint64(1))), np.uint64(0)).astype(np.int64)


def _signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    return v - ((v >> (np.maximum(width, 1) - 1) & 1) << width)


def decode_frames(buf: np.ndarray, body: np.ndarray, samples: np.ndarray, bps: np.ndarray) -> np.ndarray:
    """Samples of many mono frames (a row each, zero beyond its end); ``body`` is the byte of the subframe."""
    rows = len(body)
    order_of = np.argsort(-samples, kind="stable")
    n, pos, bits = samples[order_of].astype(np.int64), body[order_of].astype(np.int64) * 8, _Bits(buf)
    width = bps[order_of].astype(np.int64)
    kind = bits.take(pos, 8) >> 1
    wasted = bits.take(pos, 8) & 1
    pos = pos + 8
    if wasted.any():  # one bit less for each zero before the next one, and one more
        ahead = bits.peek(pos) >> np.uint64(32)
        if not ahead[wasted > 0].all():
            raise ValueError("more wasted bits than a sample has")
        wasted *= 33 - np.frexp(np.maximum(ahead, np.uint64(1)).astype(np.float64))[1].astype(np.int64)
        pos, width = pos + wasted, width - wasted
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("a reserved subframe")
    top = int(order.max(initial=0))
    x = np.zeros((top + int(n.max(initial=0)), rows), np.int64)  # row top + i is sample i
    # Warm-up, constant and verbatim samples
    plain = np.where(kind == 1, n, np.where(kind == 0, 1, order))
    for i in range(int(plain.max(initial=0))):
        now = np.flatnonzero(plain > i)
        x[top + i, now] = _signed(bits.take(pos[now], width[now]), width[now])
        pos[now] += width[now]
    for f in np.flatnonzero(kind == 0):
        x[top : top + n[f], f] = x[top, f]
    coefs, shift = np.zeros((top, rows), np.int64), np.zeros(rows, np.int64)
    for o, fixed in FIXED.items():
        if o and (kind == 8 + o).any():
            coefs[:o, kind == 8 + o] = np.array(fixed)[:, None]
    linear = np.flatnonzero(kind >= 32)
    if len(linear):
        precision = bits.take(pos[linear], 4) + 1
        shift[linear] = bits.take(pos[linear] + 4, 5)
        pos[linear] += 9
        for j in range(int(order[linear].max())):
            on = order[linear] > j
            now, wide = linear[on], precision[on]
            coefs[j, now] = _signed(bits.take(pos[now], wide), wide)
            pos[now] += wide
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return _rows(x[top:] << wasted, order_of)
    # Residuals: partitions with a Rice parameter, or raw bits after the escape value
    method, depth = bits.take(pos[coded], 2), bits.take(pos[coded] + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    c_pos, c_n, c_order = pos[coded] + 6, n[coded], order[coded]
    param_bits = 4 + method
    per = c_n >> depth
    until = np.zeros(len(coded), np.int64)
    k, raw = np.zeros(len(coded), np.int64), np.full(len(coded), -1)
    c_coefs, c_shift = coefs[:, coded], shift[coded]
    samples_of = x[:, coded]
    active, one = len(coded), np.uint64(1)
    lowest = int(c_order.min())
    for i in range(lowest, int(c_n.max())):
        while active and c_n[active - 1] <= i:
            active -= 1
        a = slice(0, active)
        ready = c_order[a] <= i
        due = np.flatnonzero(ready & (until[a] <= i))
        if len(due):
            k[due] = bits.take(c_pos[due], param_bits[due])
            c_pos[due] += param_bits[due]
            until[due] = (i // per[due] + 1) * per[due]
            escaped = k[due] == (1 << param_bits[due]) - 1
            raw[due] = -1
            e = due[escaped]
            raw[e], k[e] = bits.take(c_pos[e], 5), 0
            c_pos[e] += 5
        p, kk = c_pos[a], k[a]
        word = bits.peek(p)
        high = (word >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(high)[1].astype(np.int64)
        far = np.flatnonzero((high == 0) & ready & (raw[a] < 0))
        if len(far):  # 32 zero bits or more
            word = word.copy()
            zeros = np.zeros(active, np.int64)
            while len(far):
                zeros[far] += 32
                word[far] = bits.peek(p[far] + zeros[far])
                far = far[word[far] >> np.uint64(32) == 0]
            q = 32 - np.frexp((word >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        else:
            zeros = 0
        low = (word << (q.astype(np.uint64) + one)) >> one >> (np.uint64(63) - kk.astype(np.uint64))
        u = (q + zeros) << kk | low.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        used = q + zeros + 1 + kk
        plain_now = np.flatnonzero(raw[a] >= 0)
        if len(plain_now):
            r[plain_now] = np.where(raw[plain_now] > 0, _signed(bits.take(p[plain_now], raw[plain_now]), raw[plain_now]), 0)
            used[plain_now] = raw[plain_now]
        predicted = np.zeros(active, np.int64)
        for j in range(top):
            predicted += c_coefs[j, a] * samples_of[top + i - 1 - j, a]
        got = r + (predicted >> c_shift[a])
        if ready.all():
            samples_of[top + i, a] = got
            c_pos[a] += used
        else:
            samples_of[top + i, a] = np.where(ready, got, samples_of[top + i, a])
            c_pos[a] += np.where(ready, used, 0)
    x[:, coded] = samples_of
    return _rows(x[top:] << wasted, order_of)


def _rows(x: np.ndarray, order_of: np.ndarray) -> np.ndarray:
    out = np.empty((len(order_of), x.shape[0]), np.int64)
    out[order_of] = x.T
    return out


def decode(streams: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray, bool]]:
    """(stream, block, first sample, samples, checksum fits) of every frame, streams and frames in order."""
    listed = ((s, f, bits) for s, data in enumerate(streams) for found, bits, _ in [frames_of(data)] for f in found)
    offset: dict[int, int] = {}
    for part in _chunks(listed, FRAMES):
        data = b"".join(streams[s][f.start : f.stop] for s, f, _ in part)
        size = np.array([f.stop - f.start for _, f, _ in part])
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        buf = np.frombuffer(data, np.uint8)
        sums = crc16(buf, start, start + size - 2)
        fits = sums == (buf[start + size - 2].astype(np.uint32) << 8 | buf[start + size - 1])
        body = start + np.array([f.body - f.start for _, f, _ in part])
        got = decode_frames(buf, body, np.array([f.samples for _, f, _ in part]), np.array([b for _, _, b in part]))
        for i, (s, f, _) in enumerate(part):
            first = offset.get(s, 0)
            offset[s] = first + f.samples
            yield s, f.number, first, got[i, : f.samples], bool(fits[i])


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 bytes as a FLAC stream. A null counts as empty; every row comes out, repeated ones and null ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch, "text", 2 << 20):
                media = encode([padded(data) for data in held])
                ids = batch.column(0).slice(first, len(held))
                yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, held), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    picked = like(docs, id_col, text_col).toDF("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, block_no, sample_offset, n_samples, pcm, crc_ok, md5, media_bytes, media_sha256) of each block of each stream, and its columns ``keep``.

    ``pcm`` is unsigned 8-bit samples (other depths: little-endian 32-bit); ``sample_offset`` is
    where a block starts, so a reader can seek without decoding what comes before. ``md5`` is the
    stream's own, of all its samples. A null stream has no blocks; a damaged frame has ``crc_ok``
    false, and bytes that are no mono stream raise. Blocks of a stream follow one another, and
    repeated rows give their blocks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in slices(batch, "media", 2 << 20):
                at = [i for i, data in enumerate(held) if data]
                rows = batch.slice(first, len(held))
                marks = [(frames_of(held[i])[2], len(held[i]), hashlib.sha256(held[i]).hexdigest()) for i in at]
                for part in _chunks(decode([held[i] for i in at]), FRAMES):
                    pcm = [(x + 128).astype(np.uint8).tobytes() if x.min() >= -128 and x.max() < 128 else x.astype("<i4").tobytes() for _, _, _, x, _ in part]
                    own = pa.array([at[p[0]] for p in part])
                    columns = [pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.int64()), pa.array([len(p[3]) for p in part], pa.int32()), pa.array(pcm, pa.binary()), pa.array([p[4] for p in part])]
                    of = [pa.array([marks[p[0]][j] for p in part], kind) for j, kind in enumerate((pa.binary(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(own), *columns, *of, *(rows.column(2 + j).take(own) for j in range(len(keep)))], names=names)

    names = ["doc_id", "block_no", "sample_offset", "n_samples", "pcm", "crc_ok", "md5", "media_bytes", "media_sha256", *keep]
    picked = like(media, id_col, media_col, *keep).toDF("doc_id", "media", *keep)
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    more = "".join(f", {c} {kinds[c]}" for c in keep)
    return picked.mapInArrow(run, f"doc_id {kinds['doc_id']}, block_no int, sample_offset long, n_samples int, pcm binary, crc_ok boolean, md5 binary, media_bytes long, media_sha256 string{more}")


class Reader:
    """What the 8-bit samples of one stream add up to, block by block."""

    def __init__(self, unit: int) -> None:
        self.unit, self.length, self.tail = unit, 0, b""
        self.sha, self.md5 = hashlib.sha256(), hashlib.md5()
        self.level = self.square = self.crossings = self.peak = 0
        self.below: bool | None = None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
        self.length += len(pcm)
        self.tail = (self.tail + pcm)[-self.unit :]
        self.sha.update(pcm)
        self.md5.update(x.astype(np.int8).tobytes())
        below = x < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.below is not None and bool(below[0]) != self.below)
        self.below = bool(below[-1])
        self.level, self.square, self.peak = self.level + int(x.sum()), self.square + int(np.dot(x, x)), max(self.peak, int(np.abs(x).max()))

    def features(self) -> str:
        """Level, spread, share of sign changes and peak."""
        n = self.length
        return f"mean={self.level / n:.6f};rms={(self.square / n) ** 0.5:.6f};zcr={self.crossings / n:.6f};peak={self.peak}"


def digests(blocks: DataFrame, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each stream of ``pcm_blocks``.

    ``blocks`` come as ``pcm_blocks`` gives them, with ``n_bytes``: one after another, a stream at a
    time, so one stream's sums are all that is held. Raises if a frame's checksum or a stream's MD5
    doesn't fit, or samples have more than 8 bits.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = (kind_of, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=names)

        now, reader, out, kind_of = None, None, [], pa.int64()

        def ended() -> tuple:
            if reader.md5.digest() != now["md5"]:
                raise ValueError("the samples' MD5 does not fit")
            return now["doc_id"], now["n_bytes"], reader.length, reader.sha.hexdigest(), zlib.crc32(reader.tail), now["media_bytes"], now["media_sha256"], reader.features()

        for batch in batches:
            kind_of, pcm = batch.column(0).type, batch.column(batch.schema.get_field_index("pcm"))
            for i, row in enumerate(batch.select(["doc_id", "block_no", "n_samples", "crc_ok", "md5", "media_bytes", "media_sha256", "n_bytes"]).to_pylist()):
                if row["block_no"] == 0:
                    if reader:
                        out.append(ended())
                    now, reader = row, Reader(unit)
                piece = pcm[i].as_py()
                if not row["crc_ok"] or len(piece) != row["n_samples"]:
                    raise ValueError("a frame's checksum does not fit" if not row["crc_ok"] else "samples have more than 8 bits")
                reader.add(piece)
            if out:
                yield made(out)
                out = []
        if reader:
            yield made([ended()])

    kind = blocks.schema["doc_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
