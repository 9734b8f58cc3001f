import io
from pathlib import Path

import pytest

from spanforge.llm import media

PNG = [media.encode_png(bytes([32 + i]) * 192 * (1 + i)) for i in range(6)]
MEMBERS = [(f"m{i}", PNG[i]) for i in range(5)]


def write(spark, path, members=MEMBERS):
    media.write_archives(spark.createDataFrame(members, "member string, media binary").coalesce(1), path)
    return next(p for p in Path(path).glob("part-*"))


def offsets(members=MEMBERS):
    at, out = 0, []
    for _, body in members:
        out.append(at)
        at += -(-(media.BLOCK + len(body) + 1) // media.BLOCK) * media.BLOCK
    return [*out, at]


def damaged(file, at):
    data = bytearray(file.read_bytes())
    data[at] ^= 1
    file.write_bytes(data)
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()


def found(spark, path, **options):
    rows = media.read_archives(spark, path, pause="0", **options).collect()
    return sorted(((r.offset, r.member, r.media is not None, r.error) for r in rows), key=lambda r: (r[0], str(r[1])))


@pytest.mark.parametrize("step", [512, 1024, 1 << 20])
@pytest.mark.parametrize("which", [0, 2, 4])
def test_a_damaged_header_is_a_failed_member(spark, tmp_path, step, which):
    path = str(tmp_path / "a")
    two = MEMBERS + [("other", PNG[5])]
    file = write(spark, path, two)
    file.with_name("part-99999.txt").write_bytes(file.read_bytes())  # an archive whose first header is sound
    at = offsets(two)
    damaged(file, at[which] + 124)
    with pytest.raises(Exception, match=f"no member header at {at[which]}"):
        found(spark, path, rangeBytes=step, retries=1)
    got = found(spark, path, rangeBytes=step, onError="row", retries=1)
    assert len(got) == 12
    assert [(o, m, e) for o, m, ok, e in got if not ok] == [(at[which], None, f"OSError: no member header at {at[which]}")]
    assert sorted(m for _, m, ok, _ in got if ok) == sorted(m for k, (m, _) in enumerate(two * 2) if k != which)


@pytest.mark.parametrize("step", [512, 1 << 20])
def test_a_cut_archive_is_reported(spark, tmp_path, step):
    path = str(tmp_path / "a")
    file = write(spark, path)
    at = offsets()
    data = file.read_bytes()
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    for end, name in ((at[3] + media.BLOCK + 20, "m3"), (at[3] + 100, None)):  # in a body, in a header
        file.write_bytes(data[:end])
        with pytest.raises(Exception, match="cut short" if name else "no member header"):
            found(spark, path, rangeBytes=step, retries=0)
        got = found(spark, path, rangeBytes=step, onError="row", retries=0)
        assert [(o, m, ok) for o, m, ok, _ in got] == [(at[k], f"m{k}", True) for k in range(3)] + [(at[3], name, False)]


class Failing:
    """Opens files whose reads fail at some offsets; those of other tries do not."""

    def __init__(self, reader, bad, handles):
        self.open, self.bad, self.handles, self.n = reader._open, bad, handles, 0

    def __call__(self, path):
        with self.open(path) as f:
            data = f.read()
        self.n += 1
        return _File(data, self.bad if self.n in self.handles else ())


class _File(io.BytesIO):
    def __init__(self, data, bad):
        super().__init__(data)
        self.bad = bad

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        if self.tell() in self.bad:
            raise OSError("the disk is tired")
        return super().read(n)


@pytest.mark.parametrize("what", ["header", "body"])
@pytest.mark.parametrize("which", [0, 3])
def test_a_failed_first_read_is_tried_again_by_offset(spark, tmp_path, what, which):
    path = str(tmp_path / "a")
    write(spark, path)
    bad = {offsets()[which] + (media.BLOCK if what == "body" else 0)}

    def read(handles, **options):
        reader = media.ArchiveReader({"path": path, "retries": 2, "pause": 0, **options})
        parts = reader.partitions()
        reader._open = Failing(reader, bad, handles)
        return [r for p in parts for b in reader.read(p) for r in b.to_pylist()]

    assert [(r["member"], r["media"], r["error"]) for r in read({1, 2})] == [(m, b, None) for m, b in MEMBERS]
    with pytest.raises(OSError, match="the disk is tired"):
        read({1, 2, 3})
    rows = read({1, 2, 3}, onerror="row")
    assert [r["error"] for r in rows if r["error"]] == ["OSError: the disk is tired"] and len(rows) == 5


def test_a_bad_body_is_reported_by_name(spark, tmp_path):
    bad = bytearray(PNG[1])
    bad[45] ^= 1
    path = str(tmp_path / "a")
    write(spark, path, [("a", PNG[0]), ("b", bytes(bad)), ("c", PNG[2])])
    got = found(spark, path, onError="row", retries=1)
    assert [(m, ok) for _, m, ok, _ in got] == [("a", True), ("b", False), ("c", True)]
    with pytest.raises(Exception, match="at "):
        found(spark, path, retries=0)


def test_a_lost_member_is_noticed(spark, documents, monkeypatch):
    own = media.read_archives
    monkeypatch.setattr(media, "read_archives", lambda *a, **b: own(*a, **b).where("offset > 0"))
    with pytest.raises(OSError, match="members read of"):
        media.media_columns(documents)
