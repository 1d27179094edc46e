"""Telephony audio columns: G.711 expansion by tables, IMA ADPCM blocks, resampling.

`decode_media` expands a binary column of WAV files, mu-law, A-law, IMA ADPCM or PCM,
by what their headers say of format, channels and block size, and adds resampled 16-bit
PCM. `store_text` stores texts as such media: their bytes, unchanged, are the companded
8-bit samples or the bytes of ADPCM blocks of one frame, in the format that a checksum
deals the payload, so that equal texts give equal values; `store` writes them to the shared folder
and `digests` works on what is read back from there. Null text is empty and
becomes one frame of padding; null, cut or foreign media give null PCM, a short last
block or sample what it holds. Rows are worked off in slices of bounded bytes; long
ones alone. Rows may repeat. New columns replace those of their names, others stay.
"""
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from .common import batches_of, materialize

FRAME = 576
RATE = 8000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17


def mulaw_table():
    u = ~np.arange(256, dtype=np.int64) & 255
    mag = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -mag, mag).astype(np.int16)


def alaw_table():
    a = np.arange(256, dtype=np.int64) ^ 0x55
    seg, mant = (a >> 4) & 7, (a & 15) << 4
    mag = np.where(seg == 0, mant + 8, (mant + 264) << np.maximum(seg - 1, 0))
    return np.where(a & 128, mag, -mag).astype(np.int16)


# The IMA step sizes and index moves.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
_EXPAND = {MULAW: mulaw_table(), ALAW: alaw_table()}


def _ima_tables():
    """What each nibble adds at each step index, and the index after it, at 16 * index + nibble."""
    step, nib = IMA_STEPS[:, None], np.arange(16)[None, :]
    add = (step >> 3) + (nib & 1) * (step >> 2) + (nib >> 1 & 1) * (step >> 1) + (nib >> 2 & 1) * step
    index = np.clip(np.arange(89)[:, None] + IMA_MOVES[nib & 7], 0, 88)
    return np.where(nib & 8, -add, add).astype(np.int32).ravel(), (16 * index).astype(np.int32).ravel()


_ADD, _NEXT = _ima_tables()


_SLICE = 2 << 20


def ima_decode(data: bytes, block=256, channels=1):
    """IMA ADPCM to interleaved samples: all blocks and channels advance together, one nibble at a time."""
    whole = len(data) // block * block
    rest = len(data) - whole
    b = np.frombuffer(data[:whole], np.uint8).reshape(-1, block)
    head = b[:, :4 * channels].reshape(-1, channels, 4)
    words = (block - 4 * channels) // (4 * channels)  # of 8 nibbles for each channel in turn
    body = b[:, 4 * channels:4 * channels * (1 + words)].reshape(-1, words, channels, 4).swapaxes(1, 2).reshape(-1, channels, 4 * words)
    pred = np.ascontiguousarray(head[:, :, :2]).view("<i2")[:, :, 0].astype(np.int32)
    at = 16 * np.minimum(head[:, :, 2].astype(np.int32), 88)
    out = np.empty((1 + 8 * words, len(b), channels), np.int16)
    out[0] = pred
    body = np.ascontiguousarray(body.transpose(2, 0, 1))
    for k in range(8 * words):
        code = at + ((body[k // 2] >> (4 * (k & 1))) & 15)
        pred = np.clip(pred + _ADD[code], -32768, 32767)
        at = _NEXT[code]
        out[1 + k] = pred
    out = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(-1)
    if rest >= 4 * channels:  # a short last block
        out = np.concatenate([out, ima_decode(data[whole:], rest, channels)])
    return out


def resample(pcm, rate, to, channels=1):
    """Linear interpolation of interleaved 16-bit samples to another rate."""
    wide = pcm[:len(pcm) // channels * channels].reshape(-1, channels)
    n = len(wide) * to // rate
    if not n:
        return np.zeros(0, np.int16)
    at = np.arange(n) * (rate / to)
    return np.stack([np.round(np.interp(at, np.arange(len(wide)), wide[:, c])) for c in range(channels)], 1).astype(np.int16).reshape(-1)


def wav(payload: bytes, code=MULAW, rate=RATE, bits=8, block=None, channels=1) -> bytes:
    """A WAV file of stored bytes; `block` is the size of an ADPCM block."""
    if code == IMA:
        per = 1 + (block - 4 * channels) * 2 // channels
        fmt = struct.pack("<HHIIHHHH", code, channels, rate, rate * block // per, block, 4, 2, per)
        samples = len(payload) // block * per
    else:
        align = channels * bits // 8
        fmt = struct.pack("<HHIIHHH", code, channels, rate, rate * align, align, bits, 0)
        samples = len(payload) // align
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes):
    """(format code, channels, rate, block size, stored sample bytes); None if it is no WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, head, data = 12, None, b""
    while at + 8 <= len(media):
        name, size = media[at:at + 4], struct.unpack("<I", media[at + 4:at + 8])[0]
        part = media[at + 8:at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            code, channels, rate, _, block = struct.unpack("<HHIIH", part[:14])
            head = (code, channels, rate, block)
        elif name == b"data":
            data = part
        at += 8 + size + (size & 1)
    return None if head is None else (*head, data)


def decode_all(files):
    """(rate, channels, interleaved 16-bit PCM) of each file, None if it is no WAV file of a known format; ADPCM blocks of all files advance together."""
    out, blocks = [None] * len(files), {}
    for k, media in enumerate(files):
        got = read_wav(media) if media is not None else None
        if got is None or not got[1] or not got[2]:
            continue
        code, channels, rate, block, data = got
        if code == IMA and block > 4 * channels:
            blocks.setdefault((block, channels), []).append((k, rate, data))
        elif code in _EXPAND:
            out[k] = (rate, channels, _EXPAND[code][np.frombuffer(data, np.uint8)])
        elif code == PCM:
            out[k] = (rate, channels, np.frombuffer(data[:len(data) // 2 * 2], "<i2"))
    for (block, channels), held in blocks.items():
        whole = [len(d) // block for _, _, d in held]
        pcm = ima_decode(b"".join(d[:n * block] for (_, _, d), n in zip(held, whole)), block, channels)
        per, at = (1 + 8 * ((block - 4 * channels) // (4 * channels))) * channels, 0
        for (k, rate, data), n in zip(held, whole):
            rest = ima_decode(data[n * block:], block, channels) if len(data) > n * block else pcm[:0]
            out[k] = (rate, channels, np.concatenate([pcm[at:at + n * per], rest]))
            at += n * per
    return out


def decode(media: bytes):
    """(rate, channels, PCM) of one file."""
    return decode_all([media])[0]


def _mapped(docs, size_of, fields, work):
    """`docs` with columns `fields`, rows of which `work` makes from slices of about _SLICE bytes of column `size_of`."""
    names = [n for n, _ in fields]
    docs = docs.drop(*set(names) - {size_of})
    keep = [c for c in docs.columns if c not in names]
    schema = StructType([docs.schema[c] for c in keep])
    for n, kind in fields:
        schema = schema.add(n, kind)

    def run(batches):
        for rec in batches_of(batches, size_of, _SLICE):
            made = list(zip(*work(rec[size_of].to_pylist())))
            kinds = {StringType: pa.string(), BinaryType: pa.binary(), LongType: pa.int64(), IntegerType: pa.int32()}
            cols = [pa.array(m, kinds[type(k)]) for m, (_, k) in zip(made, fields)]
            yield pa.RecordBatch.from_arrays([*[rec[c] for c in keep], *cols], names=[*keep, *names])

    return docs.mapInArrow(run, schema)


def decode_media(docs: DataFrame, to_rate=16000, media_col="media") -> DataFrame:
    """All columns of `docs`, with `pcm` (16-bit, little-endian, interleaved, at `to_rate`), its `channels` and `source_rate`."""
    def work(files):
        return [(None, None, None) if got is None else (resample(got[2], got[0], to_rate, got[1]).astype("<i2").tobytes(), got[1], got[0]) for got in decode_all(files)]

    return _mapped(docs, media_col, [("pcm", BinaryType()), ("channels", IntegerType()), ("source_rate", IntegerType())], work)


def store(docs: DataFrame, keep_text=True) -> DataFrame:
    """All columns of `docs` (`text` only if `keep_text`), with `n_bytes` of the text and its `media`: a table in the shared folder, read back."""
    def work(texts):
        rows = []
        for text in texts:
            raw = (text or "").encode()
            payload = raw + b"\xff" * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)
            code = (MULAW, ALAW, IMA)[zlib.crc32(payload) % 3]
            rows.append((len(raw), wav(payload, code, block=FRAME if code == IMA else None)))
        return rows

    made = _mapped(docs, "text", [("n_bytes", LongType()), ("media", BinaryType())], work)
    return materialize(made if keep_text else made.drop("text"), "media", codec="zstd")


def digests(stored: DataFrame, to_rate=16000, with_pcm=False) -> DataFrame:
    """All columns of a table of `store`, with the digests of its media and of their resampled PCM, and `pcm` itself `with_pcm`."""
    def work(files):
        rows = []
        for media, (rate, _, pcm) in zip(files, decode_all(files)):
            code, back = (read_wav(media)[k] for k in (0, 4))
            out = resample(pcm, rate, to_rate).astype("<i2").tobytes()
            x = pcm.astype(np.float32)
            feature = f"format={code};n={len(out) // 2};sum={int(pcm.sum(dtype=np.int64))};peak={int(np.abs(x).max())};zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
            row = (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(out), hashlib.sha256(out).hexdigest())
            rows.append((*row, out) if with_pcm else row)
        return rows

    long, text = LongType(), StringType()
    fields = [("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text), ("pcm_bytes", long), ("pcm_sha256", text)]
    return _mapped(stored, "media", [*fields, ("pcm", BinaryType())] if with_pcm else fields, work)


def store_text(docs: DataFrame, to_rate=16000) -> DataFrame:
    """All columns of `docs`, with the stored `media`, its resampled `pcm` and the digests of both."""
    return digests(store(docs), to_rate, with_pcm=True)
