"""Archives, byte ranges and the round trip."""

import base64
import hashlib
import io
import random

import pytest

from tidewheel.llm import warc


@pytest.mark.parametrize("size", [777, 5000, 100_000, 1 << 23])
def test_ranges_own_each_record_once(size):
    rng = random.Random(3)
    parts = [warc.member(warc.record(i, f"http://x/{i}", rng.randbytes(rng.randrange(20_000)) if i % 3 else b"abc" * i, None if i % 4 else i + 1)) for i in range(60)]
    inner = warc.member(warc.record(999, "v", b"inner", None))
    parts[7] = warc.member(warc.record(7, "u", b"\x1f\x8b\x08" + inner * 3, None))  # a payload that looks like members
    data = b"".join(parts)
    got = [(r.offset, warc.page_of(r.fields["warc-record-id"])) for at in range(0, len(data), size) for r in warc.records_of_range(io.BytesIO(data), len(data), at, min(at + size, len(data)))]
    assert [g[1] for g in got] == list(range(60)) and len(set(got)) == 60


def test_ids():
    for page in (0, 5, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(page)) == page


def pages():
    rng = random.Random(4)
    out = [(k, f"http://x/{k}", "".join(rng.choices("ab<é😀", k=rng.randrange(2000)))) for k in range(40)]
    out += [(100 + k, None, out[k % 5][2]) for k in range(12)] + [(200, "u", None), (201, "u\r\nX: y", ""), (3, "http://x/3", out[3][2]), (None, "n", out[0][2]), (None, "n", "only")]
    return out


@pytest.mark.parametrize("least, small", [(0, True), (1, True), (500, True), (0, False), (500, False)])
def test_round_trip(spark, least, small, monkeypatch):
    if not small:  # digests meet without html
        monkeypatch.setattr(warc, "small_enough", lambda *_: False)
    rows = pages()
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, least).collect())
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        revisit = len(raw) >= least and top is not None and page != top and len([1 for _, _, h in rows if (h or "") == (html or "")]) > 1
        want.append((page if page is not None else -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)


def test_payloads_come_back(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>")], "page_id long, url string, html string")
    row = warc.round_trip(df).first()
    assert bytes(row.payload).decode() == "<p>é</p>" and row.url == "u"
    assert warc.round_trip(df.limit(0)).count() == 0
