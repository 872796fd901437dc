"""Archives as others write them: a gzip member a record, other kinds of records, none packed."""

from __future__ import annotations

import gzip

import pytest

from tidemark.llm import warc
from tidemark.scratch import Scratch


def info(kind, block=b"software: x\r\n"):
    return warc.record([(b"WARC-Type", kind), (b"WARC-Record-ID", b"<urn:uuid:0a1b:2c>")], block) + b"\r\n\r\n"


def archive():
    """Records of pages 1 to 3, the second in segments, among records of other kinds."""
    records = [info(b"warcinfo")]
    for page, payload in ((1, b"one"), (2, b"two" * 400), (3, b"")):
        records += [info(b"request", b"GET / HTTP/1.1\r\n\r\n"), *(r + b"\r\n\r\n" for r in warc.records_of(page, "http://x/", payload, None, "", 300)), info(b"metadata", b"")]
    return records


@pytest.mark.parametrize("packed", ["member a record", "one member", "plain"])
def test_foreign_archives(spark, tmp_path, packed):
    records = archive()
    raw = {"member a record": b"".join(map(gzip.compress, records)), "one member": gzip.compress(b"".join(records)), "plain": b"".join(records)}[packed]
    (tmp_path / "a.warc.gz").write_bytes(raw)
    found = warc.read_archives(spark, f"file://{tmp_path}", Scratch(spark, "test")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["intact"]) for r in found) == [(1, 3, "response", True), (2, 1200, "response", True), (3, 0, "response", True)]


def test_pieces_of_any_size():
    whole = b"".join(archive())
    want = list(warc.parse(whole))
    assert len(want) > 12
    for size in (1, 2, 3, 7, 100):
        assert list(warc.parse_pieces(whole[at : at + size] for at in range(0, len(whole), size))) == want
    packed = b"".join(map(gzip.compress, archive()))
    for piece in (1, 5, 64, 1 << 20):
        assert b"".join(warc.inflated(packed + bytes(8), piece)) == whole
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-7]))
    with pytest.raises(ValueError):
        b"".join(warc.inflated(packed[:-3]))
