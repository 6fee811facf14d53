"""Lengths of videos from headers, over bytes made here."""

import struct

import pytest

from twinfold.sources import containers
from twinfold.sources.video import Ffmpeg


def box(kind, body, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def mvhd(scale, ticks, version=0):
    return box(b"mvhd", struct.pack(">B3xIIII", 0, 0, 0, scale, ticks) + bytes(80) if version == 0 else struct.pack(">B3xQQIQ", 1, 0, 0, scale, ticks) + bytes(80))


def element(name, body, unknown=False):
    size = b"\x01" + b"\xff" * 7 if unknown else (len(body) | 1 << 56).to_bytes(8, "big")
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size + body


def mkv(length, scale=None, unknown=False):
    info = (element(containers.SCALE, scale.to_bytes(4, "big")) if scale else b"") + (element(containers.LENGTH, length) if length else b"")
    return element(containers.EBML, b"\x42\x82\x84webm") + element(containers.SEGMENT, element(0xEC, bytes(3_000)) + element(containers.INFO, info) + element(0x1F43B675, bytes(99)), unknown)


def avi(micros, frames):
    head = struct.pack("<IIIII", micros, 0, 0, 0, frames) + bytes(36)
    hdrl = b"hdrlavih" + struct.pack("<I", len(head)) + head
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(hdrl)) + b"AVI LIST" + struct.pack("<I", len(hdrl)) + hdrl


FTYP, MDAT = box(b"ftyp", b"isom" + bytes(8)), box(b"mdat", bytes(100_000))
CASES = {
    "first.mp4": (FTYP + box(b"moov", mvhd(1000, 61_500)) + MDAT, 61.5),
    "last.mov": (FTYP + MDAT + box(b"moov", box(b"free", b"") + mvhd(600, 600 * 7200, 1)), 7200.0),
    "wide.mp4": (FTYP + box(b"mdat", bytes(70_000), wide=True) + box(b"moov", mvhd(90_000, 45_000)), 0.5),
    "fragments.mp4": (FTYP + box(b"moov", mvhd(1000, 0) + box(b"mvex", box(b"mehd", struct.pack(">B3xI", 0, 2500)))) + MDAT, 2.5),
    "fragments64.mp4": (FTYP + box(b"moov", mvhd(1000, 0) + box(b"mvex", box(b"mehd", struct.pack(">B3xQ", 1, 9000)))), 9.0),
    "unknown.mp4": (FTYP + box(b"moov", mvhd(1000, 0xFFFFFFFF)), 0.0),
    "no_scale.mp4": (FTYP + box(b"moov", mvhd(0, 5)), 0.0),
    "no_header.mp4": (FTYP + box(b"moov", box(b"trak", b"")), 0.0),
    "cut.mp4": ((FTYP + box(b"moov", mvhd(1000, 61_500)))[:40], 0.0),
    "loop.mp4": (struct.pack(">I4s", 2, b"moov") + bytes(64), 0.0),
    "single.mkv": (mkv(struct.pack(">f", 4250.0)), 4.25),
    "scaled.webm": (mkv(struct.pack(">d", 90.0), 1_000_000_000), 90.0),
    "live.webm": (mkv(struct.pack(">d", 1500.0), unknown=True), 1.5),
    "no_length.mkv": (mkv(b""), 0.0),
    "not_a_number.mkv": (mkv(struct.pack(">d", float("nan"))), 0.0),
    "cut.mkv": (mkv(struct.pack(">d", 1500.0))[:20], 0.0),
    "zeros.mkv": (containers.EBML.to_bytes(4, "big") + bytes(50), 0.0),
    "short.avi": (avi(40_000, 250), 10.0),
    "cut.avi": (avi(40_000, 250)[:30], 0.0),
    "empty.mp4": (b"", 0.0),
    "text.mp4": (b"no video at all, only words", 0.0),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("videos")
    for name, (data, _) in CASES.items():
        (at / name).write_bytes(data)
    return at


@pytest.mark.parametrize("name", CASES)
def test_header_gives_the_length(folder, name):
    assert containers.duration(str(folder / name)) == pytest.approx(CASES[name][1])
    assert containers.duration(f"file:{folder / name}") == pytest.approx(CASES[name][1])


def test_a_missing_file_has_no_length(folder):
    assert containers.duration(str(folder / "none.mp4")) == 0.0


def test_a_large_file_is_not_read(folder, monkeypatch):
    path = folder / "large.mp4"
    with open(path, "wb") as f:  # 3 GB that take no space
        f.write(FTYP + struct.pack(">I4sQ", 1, b"mdat", 3 << 30))
        f.seek(len(FTYP) + (3 << 30))
        f.write(box(b"moov", mvhd(1000, 5_000)))
    read = []
    real = containers._at
    monkeypatch.setattr(containers, "_at", lambda f, p, n: read.append(n) or real(f, p, n))
    assert containers.duration(str(path)) == 5.0
    assert sum(read) < 500
    path.unlink()


def test_without_a_probe_the_header_counts(folder):
    tool = Ffmpeg()
    tool.ffprobe = None
    assert tool.duration(str(folder / "last.mov")) == 7200.0 and tool.duration(str(folder / "text.mp4")) == 0.0


def test_durations_of_a_table(spark, folder):
    rows = [(k, str(folder / n), "." + n.rpartition(".")[2]) for k, n in enumerate([*CASES, "none.mp4"])] + [(99, str(folder / "x.txt"), ".txt")]
    got = {r.full_path.rpartition("/")[2]: r.duration for r in containers.durations(spark.createDataFrame(rows, "file_id int, full_path string, extension string")).collect()}
    assert got == {n: (want or None) for n, (_, want) in CASES.items()} | {"none.mp4": None}
