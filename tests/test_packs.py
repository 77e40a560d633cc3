"""Packs against their definition, themselves and, where it is installed, the git program."""

import hashlib
import random
import shutil
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.sources import packs

TEXTS = [b"", b"x", b"line\n" * 40, bytes(range(256)) * 300]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 200), st.binary(max_size=150)), max_size=6))
def test_deltas_come_back(base, parts):
    target = b"".join(base[a : a + n] + new for a, n, new in parts)
    assert packs.apply_delta(base, packs.delta_of(base, target)) == target


def test_long_deltas_are_short():
    rng = random.Random(1)
    base = rng.randbytes(300_000)
    target = base[:100_000] + b"new" + base[100_003:] + b"end" * 100
    delta = packs.delta_of(base, target)
    assert packs.apply_delta(base, delta) == target and len(delta) < 500


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 2_113_663, 2_113_664, 1 << 40])
def test_numbers(n):
    assert packs.number(packs.number_bytes(n), 0)[0] == n == packs.back(packs.back_bytes(n), 0)[0]


def test_whole_and_delta_objects():
    rows = [("blob", t) for t in TEXTS] + [("blob", TEXTS[2] + b"more"), ("tree", b"")]
    for name in ("sha1", "sha256"):
        got = list(packs.objects(packs.pack_of(rows, name), name))
        assert sorted((r[1], r[6]) for r in got) == sorted(rows)
        assert all(r[2] == hashlib.new(name, f"{r[1]} {len(r[6])}\0".encode() + r[6]).hexdigest() and r[3] == len(r[6]) for r in got)
    near = [("blob", bytes(TEXTS[3]) + b"%d" % k) for k in range(120)]
    got = {r[0]: r for r in packs.objects(packs.pack_of(near))}
    assert max(r[4] for r in got.values()) == packs.MAX_CHAIN and {r[5] for r in got.values()} - {None} <= {r[2] for r in got.values()}


def closed(body: bytes) -> bytes:
    return body + hashlib.sha1(body).digest()


def test_base_named_by_its_id_may_come_later():
    import zlib

    base, target = b"a" * 100, b"a" * 100 + b"b"
    delta = packs.delta_of(base, target)
    later = packs.head_bytes(packs.BY_ID, len(delta)) + bytes.fromhex(packs.object_id("blob", base)) + zlib.compress(delta)
    first = packs.head_bytes(3, len(base)) + zlib.compress(base)
    got = list(packs.objects(closed(b"PACK" + (2).to_bytes(4) + (2).to_bytes(4) + later + first)))
    assert [(r[4], r[6]) for r in got] == [(0, base), (1, target)]
    with pytest.raises(packs.BadPack, match="no base"):
        list(packs.objects(closed(b"PACK" + (2).to_bytes(4) + (1).to_bytes(4) + later)))


def test_broken_packs():
    good = packs.pack_of([("blob", b"text" * 100)])
    body = good[:-20]
    for bad in (b"", good[:-1], b"PICK" + good[4:], body + b"x" + good[-20:], closed(body + b"x"), closed(body[:-3]), closed(body[:8] + (2).to_bytes(4) + body[12:]), closed(body[:12] + bytes([body[12] & 0x8F | 5 << 4]) + body[13:])):
        with pytest.raises(packs.BadPack):
            list(packs.objects(bad))
    with pytest.raises(packs.BadPack, match="over the limit"):
        list(packs.objects(good, max_object=399))
    for delta in (b"\x01\x01", b"\x04\x01\x00", b"\x04\x02\x01a", b"\x04\x05\x91\x00\x05", b"\x04\x05\x91", b"\x04\x01\x05a"):
        with pytest.raises(packs.BadPack):
            packs.apply_delta(b"base", delta)


def test_packs_in_tables(spark):
    rows = [(packs.object_id("blob", t), "blob", t) for t in [*TEXTS, TEXTS[2] + b"more"]]
    df = spark.createDataFrame(rows + rows[:2] + [("n", "blob", None)], "oid string, kind string, content binary")
    made = packs.write_packs(df, pack_bytes=20_000)
    assert made.count() > 1 and sum(r.objects for r in made.collect()) == len(rows)
    back = packs.read_packs(made).collect()
    assert sorted((r.oid, r.kind, bytes(r.content)) for r in back) == sorted(rows)
    assert packs.read_packs(packs.write_packs(df.limit(0))).count() == 0


@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
def test_same_as_git(spark, tmp_path):
    git = lambda *args, **more: subprocess.run(["git", "-c", "user.name=u", "-c", "user.email=u@v", "-C", str(tmp_path), *args], check=True, capture_output=True, **more).stdout
    git("init", "-q")
    rng = random.Random(2)
    text = "".join(f"{rng.random()}\n" for _ in range(2000))
    for k in range(6):
        (tmp_path / f"f{k % 2}").write_text(text + f"more {k}\n")
        git("add", ".")
        git("commit", "-q", "-m", f"commit {k}")
    git("tag", "-a", "v1", "-m", "notes")
    git("repack", "-adq", "--depth=10")
    said = dict(line.split(" ", 1) for line in git("cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype) %(objectsize) %(deltabase)").decode().splitlines())
    got = packs.read_packs(packs.pack_files(spark, f"{tmp_path}/.git/objects/pack")).collect()
    assert {r.oid: f"{r.kind} {r.size} {r.base or '0' * 40}" for r in got} == said and any(r.base for r in got)
    ours = tmp_path / "ours.pack"
    ours.write_bytes(packs.pack_of([(r.kind, bytes(r.content)) for r in sorted(got, key=lambda r: (r.kind, r.size))]))
    git("index-pack", str(ours))
    assert b"delta" in git("verify-pack", "-sv", str(ours)) or b"chain length" in git("verify-pack", "-sv", str(ours))
