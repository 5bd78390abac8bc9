"""Audio files: tags and stream facts from their headers, samples of WAV files, hashes of files and of their sound."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct as _s
import subprocess
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LOSSLESS_FORMATS
from ..functions.kernels import decode_pcm

METADATA = "filepath string, codec string, bitrate int, samplerate int, channels int, bit_depth int, duration double, title string, artist string, album string, error string"
STREAM = "codec string, samplerate int, channels int, layout string, sample_fmt string, bit_depth int, lossless boolean"
PCM = "filepath string, rate int, channels int, depth int, frames bigint, pcm_hash string, prefix_hash string, error string"
# Names of tags in ID3, Vorbis comments and RIFF information.
TAGS = {"title": ("title", "TIT2", "TT2", "INAM"), "artist": ("artist", "TPE1", "TP1", "IART"), "album": ("album", "TALB", "TAL", "IPRD")}
# kbit/s of MPEG-1 and MPEG-2 layer III by index, and sample rates by version.
MPEG_RATES = {True: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), False: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MPEG_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _riff(f, size: int) -> dict:
    out, data = {"tags": {}}, 0
    f.seek(12)
    while len(head := f.read(8)) == 8:
        kind, n = head[:4], _s.unpack("<I", head[4:])[0]
        at = f.tell()
        if kind == b"fmt ":
            _, ch, hz, rate, _, bits = _s.unpack("<HHIIHH", f.read(16))
            out |= {"channels": ch, "samplerate": hz, "bit_depth": bits, "byte_rate": rate}
        elif kind == b"data":
            data = min(n, max(0, size - at))
        elif kind == b"LIST" and f.read(4) == b"INFO":
            end = at + n
            while f.tell() + 8 <= end:
                key, k = f.read(4), _s.unpack("<I", f.read(4))[0]
                out["tags"][key.decode("latin-1")] = f.read(k).split(b"\0")[0].decode("utf-8", "replace")
                f.seek(k % 2, 1)
        f.seek(at + n + n % 2)
    rate = out.pop("byte_rate", 0)
    return out | {"codec": "wav", "duration": data / rate if rate else 0.0, "bitrate": rate * 8 // 1000}


def _flac(f, size: int) -> dict:
    out = {"codec": "flac", "tags": {}}
    f.seek(4)
    last = False
    while not last and len(head := f.read(4)) == 4:
        last, kind, n = head[0] >> 7, head[0] & 0x7F, int.from_bytes(head[1:], "big")
        body = f.read(n)
        if kind == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18], "big")
            hz, frames = bits >> 44, bits & (1 << 36) - 1
            out |= {"samplerate": hz, "channels": (bits >> 41 & 7) + 1, "bit_depth": (bits >> 36 & 31) + 1, "duration": frames / hz if hz else 0.0}
        elif kind == 4:
            at = 4 + _s.unpack_from("<I", body)[0]
            count, at = _s.unpack_from("<I", body, at)[0], at + 4
            for _ in range(count):
                k = _s.unpack_from("<I", body, at)[0]
                key, _, value = body[at + 4 : at + 4 + k].decode("utf-8", "replace").partition("=")
                out["tags"].setdefault(key, value)
                at += 4 + k
    return out


def _id3_text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(code, "replace").split("\0")[0]


def _mp3(f, size: int) -> dict:
    out, tags, begin = {"codec": "mp3"}, {}, 0
    f.seek(0)
    head = f.read(10)
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    if head[:3] == b"ID3":
        begin, old = 10 + seven(head[6:10]), head[3] == 2
        body, at, width = f.read(begin - 10), 0, 6 if old else 10
        while at + width <= len(body) and body[at]:
            key = body[at : at + (3 if old else 4)].decode("latin-1")
            n = int.from_bytes(body[at + 3 : at + 6], "big") if old else seven(body[at + 4 : at + 8]) if head[3] == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
            if key[0] == "T":
                tags.setdefault(key, _id3_text(body[at + width : at + width + n]))
            at += width + n
    f.seek(begin)
    part = f.read(65536)
    for at in range(len(part) - 4):
        a, b, c = part[at], part[at + 1], part[at + 2]
        version, index, hz = b >> 3 & 3, c >> 4, c >> 2 & 3
        if a == 0xFF and b & 0xE6 == 0xE2 and version != 1 and 0 < index < 15 and hz < 3:
            rate, rest = MPEG_RATES[version == 3][index], max(0, size - begin - at)
            out |= {"bitrate": rate, "samplerate": MPEG_HZ[version][hz], "channels": 1 if part[at + 3] >> 6 == 3 else 2, "bit_depth": 16, "duration": rest * 8 / (rate * 1000)}
            break
    if size >= 128:
        f.seek(size - 128)
        tail = f.read(128)
        if tail[:3] == b"TAG":
            for name, lo in (("title", 3), ("artist", 33), ("album", 63)):
                tags.setdefault(name, tail[lo : lo + 30].split(b"\0")[0].decode("latin-1").strip())
    return out | {"tags": tags}


#: Readers by the bytes a file begins with.
READERS: list[tuple[Callable[[bytes], bool], Callable]] = [
    (lambda b: b[:4] == b"RIFF" and b[8:12] == b"WAVE", _riff),
    (lambda b: b[:4] == b"fLaC", _flac),
    (lambda b: b[:3] == b"ID3" or len(b) > 1 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0, _mp3),
]


def header(path: str) -> dict:
    """Stream facts and tags of one file; ``error`` says why there are none."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            begin = f.read(12)
            reader = next((r for fits, r in READERS if fits(begin)), None)
            got = reader(f, size) if reader else probe(path) or {"error": "no reader for this format"}
    except (OSError, _s.error, IndexError, ValueError) as e:
        got = {"error": f"{type(e).__name__}: {e}"}
    low = {k.lower(): v for k, v in got.pop("tags", {}).items()}
    return got | {t: next((v.strip() for n in names if (v := low.get(n.lower()))), "") for t, names in TAGS.items()}


def parse_probe(text: str) -> dict:
    """Facts of the first audio stream of the stream tool's JSON; {} if it has none. Bit depth comes from the sample format where it is not told."""
    try:
        doc = json.loads(text)
        stream = next((s for s in doc.get("streams", []) if s.get("codec_type") == "audio"), None)
    except (ValueError, AttributeError):
        return {}
    if not stream:
        return {}
    whole = doc.get("format", {})
    number = lambda *vs: next((int(float(v)) for v in vs if v not in (None, "", "0", 0, "N/A")), 0)
    fmt = stream.get("sample_fmt", "")
    depth = number(stream.get("bits_per_raw_sample"), stream.get("bits_per_sample")) or {"u8": 8, "s16": 16, "s32": 32, "flt": 32, "dbl": 64, "s64": 64}.get(fmt.removesuffix("p"), 0)
    channels = number(stream.get("channels"))
    codec = stream.get("codec_name", "")
    return {
        "codec": codec, "samplerate": number(stream.get("sample_rate")), "channels": channels, "layout": stream.get("channel_layout") or {1: "mono", 2: "stereo"}.get(channels, ""),
        "sample_fmt": fmt, "bit_depth": depth, "lossless": codec.upper() in LOSSLESS_FORMATS or codec.startswith("pcm_"), "bitrate": number(stream.get("bit_rate"), whole.get("bit_rate")) // 1000,
        "duration": float(stream.get("duration") or whole.get("duration") or 0.0), "tags": whole.get("tags", {}),
    }


def probe(path: str, timeout: float = 10.0) -> dict:
    """The same by the external stream tool; {} where it is not installed or fails."""
    tool = shutil.which("ffprobe")
    if not tool:
        return {}
    try:
        run = subprocess.run([tool, "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", "-select_streams", "a:0", path], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return {}
    return parse_probe(run.stdout) if run.returncode == 0 else {}


def _by_path(schema: str, one: Callable[[str], dict]):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [{"filepath": p} | one(p) for p in pdf["filepath"]]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return run


def metadata(files: DataFrame) -> DataFrame:
    """Stream facts and tags of each file (WAV, FLAC and MP3 from their headers, others by the stream tool); ``error`` names what could not be read."""
    return files.select("filepath").mapInPandas(_by_path(METADATA, header), METADATA)


def samples(path: str) -> tuple[np.ndarray, int, int]:
    """(frames x channels of a WAV file as whole numbers, sample rate, bits)."""
    with wave.open(path, "rb") as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        x = decode_pcm(raw, width)
        ch = w.getnchannels()
        return x[: len(x) // ch * ch].reshape(-1, ch), w.getframerate(), width * 8


def _sound(path: str, seconds: float = 30.0, rate: int = 11025) -> dict:
    try:
        x, hz, bits = samples(path)
    except (OSError, EOFError, wave.Error, KeyError) as e:
        return {"error": f"{type(e).__name__}: {e}"}
    if not len(x):
        return {"error": "no samples"}
    # mono, 16 bit, at a common rate: what lets copies of other depth and rate meet before they are compared in full
    head = x[: int(seconds * hz)].mean(axis=1) / 2.0 ** (bits - 1)
    at = np.arange(0, len(head), hz / rate)
    mono = np.clip(np.round(np.interp(at, np.arange(len(head)), head) * 32768), -32768, 32767).astype("<i2")
    return {"rate": hz, "channels": x.shape[1], "depth": bits, "frames": len(x), "pcm_hash": hashlib.sha256(f"{hz}/{x.shape[1]}/{bits}/".encode() + x.astype("<i4").tobytes()).hexdigest(), "prefix_hash": hashlib.md5(mono.tobytes()).hexdigest()}


def sound_hashes(files: DataFrame) -> DataFrame:
    """pcm_hash of all samples with their format and prefix_hash of the first 30 s (mono, 16 bit, 11,025 Hz) of each WAV file; ``error`` of the others.

    Two files sound bit for bit alike if and only if their pcm_hash is equal, so a full comparison is an equi-join and each file is decoded once.
    """
    return files.select("filepath").mapInPandas(_by_path(PCM, _sound), PCM)


def _sha256(path: str) -> dict:
    h = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            for block in iter(lambda: f.read(1 << 20), b""):
                h.update(block)
    except OSError as e:
        return {"sha256": None, "error": f"{type(e).__name__}: {e}"}
    return {"sha256": h.hexdigest()}


def file_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of each file, read block by block."""
    schema = "filepath string, sha256 string, error string"
    return files.select("filepath").mapInPandas(_by_path(schema, _sha256), schema)


def changed_files(expected: DataFrame) -> DataFrame:
    """Files whose content is no longer what a plan saw: filepath and sha256 of the plan against the file now. Rows that differ or cannot be read."""
    now = file_hashes(expected).select("filepath", F.col("sha256").alias("now"), "error")
    return expected.select("filepath", "sha256").join(now, "filepath").filter(~F.col("sha256").eqNullSafe(F.col("now")))
