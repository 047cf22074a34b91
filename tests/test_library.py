import hashlib
import json
import struct
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import Row

from cadenza import cli, session
from cadenza.errors import DecodeError, FileMissing, InferenceError, StemUnavailable, UnsupportedFormat
from cadenza.operators import detect, stems
from cadenza.plans.library import Settings, buffers_analysed, duplicate_ids, run
from cadenza.sources import audio, documents, listing
from cadenza.streaming.watch import watch

RATE = 44100


def sine(hz, seconds, rate=RATE):
    return (0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def clicks(bpm, seconds, rate=RATE):
    x = np.zeros(int(seconds * rate), np.float32)
    burst = int(0.005 * rate)
    for at in range(0, len(x) - burst, int(60 / bpm * rate)):
        x[at : at + burst] = 0.8 * np.exp(-5 * np.arange(burst) / burst)
    return x


def wav(path, x, rate=RATE):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(audio.wav_bytes(np.atleast_2d(x), rate))


def load(out):
    return json.loads((out / documents.JSON_NAME).read_text())


def test_library_run(spark, tmp_path):
    music, out = tmp_path / "in put", tmp_path / "out"
    wav(music / "Artist_Name_-_Track & Title.wav", sine(440, 4))
    wav(music / "sub" / "x[1]é#%.WAV", clicks(120, 10))
    wav(music / "sub" / ".hidden.wav", sine(261.63, 3.0))
    wav(music / "short.wav", sine(440, 2.9))
    (music / "empty.wav").write_bytes(b"")
    (music / "text.wav").write_text("this is no audio")
    (music / "fake.mp3").write_bytes(b"\xff\xfb" + b"x" * 100)
    (music / "notes.txt").write_text("x")
    s = Settings(str(music), str(out), stems=True, separator="copies")
    r = run(spark, s)
    assert (r.total, r.successful, r.failed, r.skipped, r.exit_code) == (7, 3, 0, 4, 0)
    doc = load(out)
    assert list(doc) == ["version", "metadata", "tracks"] and doc["version"] == "1.0" and doc["metadata"]["track_count"] == 3
    by = {t["path"].rsplit("/", 1)[1]: t for t in doc["tracks"]}
    assert by["Artist_Name_-_Track & Title.wav"]["metadata"] == {"title": "Artist_Name_-_Track & Title"}
    beat = by["x[1]é#%.WAV"]["bpm"]["value"]
    assert min(abs(beat - 120), abs(beat * 2 - 120), abs(beat / 2 - 120)) < 5
    for t in doc["tracks"]:
        assert 60 <= t["bpm"]["value"] <= 200 and t["key"]["camelot"][:-1] in map(str, range(1, 13)) and len(t["bpm"]["candidates"]) == 2
        for p in t["stems"].values():
            assert audio.decode(open(p, "rb").read()).rate == 44100
    tree = ET.parse(out / documents.XML_NAME).getroot()
    rows = tree.findall("COLLECTION/TRACK")
    assert tree.find("COLLECTION").get("Entries") == "3" and len(rows) == 3
    assert [list(x.attrib)[0] for x in rows] == ["TrackID"] * 3 and all(x.get("Location").startswith("file://localhost/") for x in rows)
    assert any(x.get("Location").endswith("/sub/x%5B1%5D%C3%A9%23%25.WAV") for x in rows)
    assert [x.get("Key") for x in tree.findall(".//NODE/NODE/TRACK")] == [x.get("TrackID") for x in rows]
    # a second run with one new file keeps the others, and stems are no input
    wav(music / "new.wav", sine(392, 5))
    r = run(spark, Settings(str(music), str(out)))
    assert (r.total, r.successful, r.skipped) == (8, 1, 7) and load(out)["metadata"]["track_count"] == 4
    (out / documents.JSON_NAME).write_text("{ damaged")
    assert run(spark, Settings(str(music), str(out), merge=False, detector="placeholder")).successful == 4
    r = run(spark, Settings(str(music), str(tmp_path / "dry"), dry_run=True))
    assert (r.total, r.skipped) == (8, 8) and not (tmp_path / "dry").exists()


def test_empty_missing_and_single(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert run(spark, Settings(str(tmp_path / "none"), str(tmp_path / "o"))).total == 0 and not (tmp_path / "o").exists()
    with pytest.raises(FileMissing):
        run(spark, Settings(str(tmp_path / "missing"), str(tmp_path / "o")))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(UnsupportedFormat):
        run(spark, Settings(str(tmp_path / "a.txt"), str(tmp_path / "o")))
    wav(tmp_path / "one.wav", sine(880, 3.0))
    assert run(spark, Settings(str(tmp_path / "one.wav"), str(tmp_path / "o"), json=False)).successful == 1
    assert not (tmp_path / "o" / documents.JSON_NAME).exists()


def test_stream_of_new_files(spark, tmp_path):
    wav(tmp_path / "in" / "a.wav", clicks(128, 8))
    (tmp_path / "in" / "bad.wav").write_text("x")
    for n in (2, 3):
        q = watch(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/rows", f"file://{tmp_path}/check", "placeholder", once=True)
        q.awaitTermination()
        got = spark.read.parquet(f"file://{tmp_path}/rows").collect()
        assert len(got) == n and sum(r.error_kind == "decode" for r in got) == 1
        wav(tmp_path / "in" / "b.wav", sine(300, 4))


@pytest.mark.parametrize("bpm", [90, 120, 128, 140, 174])
def test_tempo_of_clicks(bpm):
    t = detect.spectral_tempo(clicks(bpm, 15, 22050), 22050)
    assert 60 <= t.value <= 200 and min(abs(t.value - bpm), abs(t.value * 2 - bpm), abs(t.value / 2 - bpm)) < 3
    assert t == detect.spectral_tempo(clicks(bpm, 15, 22050), 22050)


def test_key_of_a_chord():
    chord = sum(sine(f, 5, 22050) for f in (440.0, 523.25, 659.25, 220.0))
    assert detect.spectral_key(chord, 22050).standard in ("Am", "C")
    k = {detect.Key(p, m).camelot for p in range(12) for m in (False, True)}
    assert len(k) == 24 and detect.Key(9, True).camelot == "8A" and detect.Key(0, False).camelot == "8B" and detect.Key(7, True).camelot == "6A"


@pytest.mark.parametrize("a,b", [(44100, 22050), (22050, 44100), (48000, 22050), (44100, 32000), (96000, 44100)])
def test_resampling(a, b):
    y = audio.resample(sine(440, 2, a), a, b)
    assert abs(len(y) - 2 * b) <= 1
    assert np.abs(y[500:-500] - sine(440, 2, b)[500 : len(y) - 500]).max() < 0.02
    assert len(audio.resample(np.zeros(0, np.float32), a, b)) == 0 and len(audio.resample(np.ones(5, np.float32), a, a)) == 5


def test_formats():
    x = np.stack([sine(440, 0.1), sine(220, 0.1)])
    for bits in (8, 16, 24, 32):
        n = 1 << (bits - 1)
        v = np.clip(np.rint(x.T.astype(float) * n), -n, n - 1).astype(np.int64).reshape(-1)
        raw = (v + 128).astype(np.uint8).tobytes() if bits == 8 else b"".join(int(k).to_bytes(bits // 8, "little", signed=True) for k in v)
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 2, RATE, RATE * bits // 4, bits // 4, bits, b"data", len(raw))
        got = audio.decode(head + raw)
        assert got.rate == RATE and np.abs(got.channels - x).max() < 2 / n + 1e-6
        big = b"".join(int(k).to_bytes(bits // 8, "big", signed=True) for k in v)
        rate = struct.pack(">H", 16383 + 15) + int(RATE * 2.0 ** (63 - 15)).to_bytes(8, "big")
        comm = struct.pack(">HIH", 2, x.shape[1], bits) + rate
        aiff = b"FORM\0\0\0\0AIFFCOMM" + struct.pack(">I", 18) + comm + b"SSND" + struct.pack(">III", len(big) + 8, 0, 0) + big
        got = audio.decode(aiff)
        assert got.rate == RATE and np.abs(got.channels - x).max() < 2 / n + 1e-6
    for bad in (b"", b"RIFF", b"fLaC" + b"x" * 50, b"junk" * 10, b"RIFF\0\0\0\0WAVEfmt "):
        with pytest.raises(DecodeError):
            audio.decode(bad)


def test_tags():
    frame = lambda k, t: k + struct.pack(">I", len(t) + 1) + b"\0\0\x03" + t
    body = frame(b"TIT2", "Tïtle".encode()) + frame(b"TPE1", b"Someone") + frame(b"TYER", b"1999-01-01")
    assert audio.read_tags(b"ID3\x03\0\0" + struct.pack(">I", len(body)) + body) == {"title": "Tïtle", "artist": "Someone", "album": None, "genre": None, "year": 1999}
    info = b"INFO" + b"INAM" + struct.pack("<I", 4) + b"abc\0"
    assert audio.read_tags(b"RIFF\0\0\0\0WAVELIST" + struct.pack("<I", len(info)) + info)["title"] == "abc"
    note = struct.pack("<I", 1) + b"v" + struct.pack("<I", 2) + b"".join(struct.pack("<I", len(s)) + s for s in (b"TITLE=t", b"genre=House"))
    assert audio.read_tags(b"fLaC" + bytes([0x84]) + len(note).to_bytes(3, "big") + note)["genre"] == "House"
    assert audio.read_tags(b"ID3\x03") == dict.fromkeys(audio.TAGS)


def test_stems():
    how = stems.Chunking(1000, 100, 8000)
    for n in (1, 999, 1000, 1001, 1850, 5000):
        mix = np.random.default_rng(n).normal(size=(2, n)).astype(np.float32)
        y = stems.separate(mix, stems.ScaledCopies(), how)
        assert y.shape == (4, 2, n) and np.abs(y.sum(axis=0) - mix).max() < 1e-5
    assert [len(stems.Chunking().plan(n)) for n in (343980, 343981, 643859, 643860)] == [1, 2, 2, 3]
    w = stems.crossfade(100, 20, False, False)
    assert w[0] < 0.1 and abs(w[10] - 0.5) < 0.01 and w[50] == 1 and w[99] < 0.1
    with pytest.raises(InferenceError):
        stems.overlap_add([], how, 5)
    x = np.random.default_rng(1).normal(size=20000)
    assert np.abs(stems.istft(stems.stft(x), 20000)[1024:15000] - x[1024:15000]).max() < 1e-9


def test_text_of_numbers():
    assert [documents.bpm_text(x) for x in (128.0, 0.0, float("nan"), 5000.0, 0.125 + 2)] == ["128.00", "120.00", "120.00", "999.99", "2.12"]
    assert [documents.seconds_text(x) for x in (2.5, -1.0, float("inf"), 0.5)] == ["3", "0", "0", "1"]
    assert documents.percent_text(0.025) == "2"


def test_command_line(tmp_path):
    s, _ = cli.parse(["-i", str(tmp_path), "-o", str(tmp_path / "o"), "--no-json", "--no-recursive", "--genre", "dnb", "--stems", "--stems-output", "/x"])
    assert (s.json, s.recursive, s.genre, s.stems, s.stems_dir, s.separator) == (False, False, "dnb", True, "/x", "onnx")
    for bad in (["-i", "/nowhere", "-o", "x"], ["-i", str(tmp_path), "-o", "/no/such/dir/o"], ["-i", ".", "-o", "x", "--genre", "polka"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)


def test_each_genre_of_the_command_line_has_a_tempo():
    assert set(detect.GENRE_BPM) == set(cli.GENRES)
    assert all(detect.LOW_BPM <= x <= detect.HIGH_BPM for x in detect.GENRE_BPM.values())


def test_a_relative_input_has_absolute_uris(spark, tmp_path, monkeypatch):
    wav(tmp_path / "music" / "sub" / "a b.wav", sine(440, 3.5))
    monkeypatch.chdir(tmp_path)
    for given, out in (("music", "one"), ("./music/", "two"), ("music/sub/a b.wav", "three")):
        r = run(spark, Settings(given, str(tmp_path / out), detector="placeholder"))
        assert r.successful == 1 and r.xml == str(tmp_path / out / documents.XML_NAME) and r.analysed == 1 and r.seconds > 0
        row = ET.parse(r.xml).getroot().find("COLLECTION/TRACK")
        assert row.get("Location") == f"file://localhost{tmp_path}/music/sub/a%20b.wav".replace("[", "%5B").replace("]", "%5D")
        assert load(tmp_path / out)["tracks"][0]["path"].startswith(given)


def test_a_store_as_input(spark, tmp_path):
    music, out = tmp_path / "music", tmp_path / "music" / "out"
    wav(music / "b.wav", sine(440, 3.5))
    wav(music / "sub" / "a #1.wav", sine(440, 4))
    (music / "notes.txt").write_text("x")
    s = Settings(f"file://{music}", str(out), detector="placeholder", stems=True, separator="copies")
    r = run(spark, s)
    assert (r.total, r.successful) == (2, 2)
    names = [t["path"].rsplit("/", 1)[1] for t in load(out)["tracks"]]
    assert sorted(names) == ["a #1.wav", "b.wav"] and all(t["stems"] for t in load(out)["tracks"])
    again = run(spark, s)  # stems in the output folder are no input
    assert (again.total, again.successful, again.skipped) == (2, 0, 2)
    flat = run(spark, Settings(f"file://{music}", str(tmp_path / "flat"), detector="placeholder", recursive=False))
    assert flat.total == 1


def test_folders_that_are_not_entered(spark, tmp_path):
    wav(tmp_path / "music" / "sub" / "a.wav", sine(440, 3.5))
    wav(tmp_path / "music" / "b.wav", sine(440, 3.5))
    assert [r.path[len(str(tmp_path)) :] for r in listing.local_listing(spark, str(tmp_path / "music"), recursive=False).collect()] == ["/music/b.wav"]
    assert listing.is_file(str(tmp_path / "music" / "b.wav")) and not listing.is_file(str(tmp_path / "music")) and not listing.is_file(str(tmp_path / "none"))


def test_the_dry_run_lists_names(spark, tmp_path, capsys):
    for name in ("b.wav", "a.mp3", "sub/c.FLAC"):
        (tmp_path / "music" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "music" / name).write_bytes(b"")
    run(spark, Settings(str(tmp_path / "music"), str(tmp_path / "out"), dry_run=True))
    lines = capsys.readouterr().out.splitlines()
    assert lines[:5] == [f"{tmp_path}/music/ (2 files)", "  a.mp3", "  b.wav", f"{tmp_path}/music/sub/ (1 files)", "  c.FLAC"]


def test_documents_hold_odd_numbers_and_characters(tmp_path):
    assert documents._plain(Row(a=float("nan"), b=None, c=[float("inf"), 1.5])) == {"a": None, "c": [None, 1.5]}
    assert documents._attributes([("Name", "a\x00b\x1f<\ufffe"), ("None", None)]) == ' Name="ab&lt;"'


def proto(*fields):
    """A protocol buffer message: (number, int | bytes | str) each."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (n > 127) << 7])
            if not (n := n >> 7):
                return out

    body = b""
    for k, v in fields:
        v = v.encode() if isinstance(v, str) else v
        body += varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v
    return body


def model_file(path, shares, chunk):
    """A model whose stems are shares of the mix: (1, 2, chunk) to (1, 4, 2, chunk)."""
    value = lambda name, dims: proto((1, name), (2, proto((1, proto((1, 1), (2, proto(*((1, proto((1, d))) for d in dims))))))))
    tensor = lambda name, kind, dims, raw: proto(*((1, d) for d in dims), (2, kind), (8, name), (9, raw))
    nodes = [proto((1, "mix"), (1, "axis"), (2, "wide"), (4, "Unsqueeze")), proto((1, "wide"), (1, "shares"), (2, "stems"), (4, "Mul"))]
    data = [tensor("axis", 7, [1], np.array([1], "<i8").tobytes()), tensor("shares", 1, [1, 4, 1, 1], np.array(shares, "<f4").tobytes())]
    graph = proto(*((1, n) for n in nodes), (2, "g"), *((5, d) for d in data), (11, value("mix", [1, 2, chunk])), (12, value("stems", [1, 4, 2, chunk])))
    path.write_bytes(proto((1, 8), (7, graph), (8, proto((1, ""), (2, 13)))))


def test_a_models_stems_keep_their_names(tmp_path):
    path = tmp_path / "model.onnx"
    model_file(path, (0.4, 0.3, 0.2, 0.1), 1000)
    mix = np.random.default_rng(1).normal(size=(2, 2500)).astype(np.float32)
    how = stems.Chunking(1000, 100, 8000)
    for order in (stems.STEMS, ("drums", "bass", "other", "vocals")):
        got = dict(zip(stems.STEMS, stems.separate(mix, stems.OnnxModel(str(path), 1000, order), how), strict=True))
        for name, share in zip(order, (0.4, 0.3, 0.2, 0.1), strict=True):
            assert np.abs(got[name] - share * mix).max() < 1e-5
    assert stems.STEMS == ("vocals", "drums", "bass", "other")
    with pytest.raises(ValueError):
        stems.OnnxModel(str(path), 1000, ("drums",))
    with pytest.raises(StemUnavailable):
        stems.OnnxModel(str(tmp_path / "none"))


def test_a_model_is_fetched_once_and_verified(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    monkeypatch.setenv("CADENZA_STEM_MODEL", "")
    source = tmp_path / "source.onnx"
    source.write_bytes(b"weights")
    good, url = hashlib.sha256(b"weights").hexdigest(), source.as_uri()
    assert not stems.is_cached()
    with pytest.raises(StemUnavailable):
        stems.ensure_model(url, "0" * 64)
    assert not stems.is_cached() and not list((tmp_path / "cache" / "cadenza").glob("*.tmp"))
    path = stems.ensure_model(url, good)
    assert path == stems.model_path() == stems.find_model() and open(path, "rb").read() == b"weights"
    source.unlink()
    assert stems.ensure_model(url, good.upper()) == path  # not fetched again
    open(path, "wb").write(b"damaged")
    with pytest.raises(StemUnavailable):
        stems.ensure_model(url, good)


def test_separators_and_providers():
    assert stems.providers(["CPUExecutionProvider", "CoreMLExecutionProvider"], "darwin") == ["CoreMLExecutionProvider", "CPUExecutionProvider"]
    assert stems.providers(["CPUExecutionProvider", "CoreMLExecutionProvider"], "linux") == ["CPUExecutionProvider"]
    stems.register("half", lambda: lambda mix: np.stack([mix / 2] * 4))
    try:
        assert stems.separator("half")(np.ones((2, 3))).shape == (4, 2, 3)
    finally:
        del stems.SEPARATORS["half"]
    assert stems.shape(44100) == (2, 2049, len(stems.stft(np.zeros(44100)))) and stems.shape(10) == (2, 2049, 1)


def test_detectors_can_be_added():
    detect.register("flat", lambda x, rate, genre=None: detect.Tempo(100.0), lambda x, rate: detect.Key(3, True))
    try:
        tempo, key = detect.DETECTORS["flat"]
        assert tempo(np.zeros(5), 10).value == 100.0 and key(np.zeros(5), 10).standard.endswith("m")
    finally:
        del detect.DETECTORS["flat"]


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_paths_ids_and_levels_of_results(spark, tmp_path):
    wav(tmp_path / "music" / "a.wav", sine(440, 3.5))
    run(spark, Settings(str(tmp_path / "music"), str(tmp_path / "out"), detector="placeholder"))
    assert [r.path for r in documents.read_paths(spark, str(tmp_path / "out" / documents.JSON_NAME)).collect()] == [str(tmp_path / "music" / "a.wav")]
    ids = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("c", 2)], "path string, track_id int")
    assert [tuple(r) for r in duplicate_ids(ids).collect()] == [(1, 2)]
    buffers = spark.createDataFrame([(1, [0.5, -2.0, 0.25]), (2, [])], "id int, x array<double>")
    assert sorted(map(tuple, buffers_analysed(buffers, "id", "x", 2).collect())) == [(1, 1.5, 16383), (2, 0.0, None)]
