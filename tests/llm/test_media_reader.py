"""Stored media read by another reader: plain offsets into the format's tables, none of the operator's code."""

from __future__ import annotations

import random
import struct

import pytest

from evidentia.llm import media


def children(data, lo, hi):
    while lo < hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, lo + 8), 16
        size = size or hi - lo
        assert head <= size <= hi - lo
        yield kind.decode("latin1"), lo + head, lo + size
        lo += size
    assert lo == hi


def only(data, box, kind):
    (found,) = [c for c in children(data, *box) if c[0] == kind]
    return found[1:]


def numbers(data, at, n, kind="I"):
    return list(struct.unpack_from(f">{n}{kind}", data, at))


def read(data):
    """Timescale, duration, samples as byte ranges and numbers of the sync samples of the one track."""
    top = list(children(data, 0, len(data)))
    assert top[0][0] == "ftyp" and sorted(k for k, *_ in top)[:2] == ["ftyp", "mdat"]
    ((_, mlo, mhi),) = [c for c in top if c[0] == "mdat"]
    moov = only(data, (0, len(data)), "moov")
    mdia = only(data, only(data, moov, "trak"), "mdia")
    at, _ = only(data, mdia, "mdhd")
    timescale, duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
    stbl = only(data, only(data, mdia, "minf"), "stbl")
    kinds = {k: lo for k, lo, _ in children(data, *stbl)}
    fixed, count = numbers(data, kinds["stsz"] + 4, 2)
    sizes = [fixed] * count if fixed else numbers(data, kinds["stsz"] + 12, count)
    (runs,) = numbers(data, kinds["stsc"] + 4, 1)
    table = numbers(data, kinds["stsc"] + 8, 3 * runs)
    table = [table[k : k + 3] for k in range(0, len(table), 3)]
    name = "co64" if "co64" in kinds else "stco"
    (chunks,) = numbers(data, kinds[name] + 4, 1)
    offsets = numbers(data, kinds[name] + 8, chunks, "Q" if name == "co64" else "I")
    samples = []
    for nr, offset in enumerate(offsets, 1):
        per = next(per for first, per, _ in reversed(table) if first <= nr)
        for _ in range(per):
            if len(samples) < count:
                samples.append((offset, offset + sizes[len(samples)]))
                offset += sizes[len(samples) - 1]
    (syncs,) = numbers(data, kinds["stss"] + 4, 1)
    (parts,) = numbers(data, kinds["stts"] + 4, 1)
    times = numbers(data, kinds["stts"] + 8, 2 * parts)
    assert sum(times[::2]) == count and sum(a * b for a, b in zip(times[::2], times[1::2], strict=True)) == duration
    assert all(mlo <= lo <= hi <= mhi for lo, hi in samples)
    return timescale, duration, samples, numbers(data, kinds["stss"] + 8, syncs)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 64, 576 * 65 + 3, 576 * 1000])
def test_another_reader_finds_the_same(size):
    raw = random.Random(size).randbytes(size)
    data = media.store(media.padded(raw))
    timescale, duration, samples, syncs = read(data)
    payload = b"".join(data[lo:hi] for lo, hi in samples)
    assert payload[:size] == raw and set(payload[size:]) <= {255} and len(payload) % 576 == 0 and payload
    told = media.describe(data)
    assert (told["timescale"], told["duration"], told["n_samples"]) == (timescale, duration, len(samples))
    assert [(k["lo"], k["hi"]) for k in told["keyframes"]] == [samples[k - 1] for k in syncs]
