import base64
import hashlib
import io
import random
import struct
import zipfile

import pytest
from conftest import rows_of

from strandline.llm import warc_zip
from strandline.llm.common import Shared


def brute_force(pages, least=0):
    top = {}
    for page_id, _, html in pages:
        if page_id is not None:
            top[html or ""] = max(top.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = top.get(html or "")
        again = first is not None and page_id != first and len(payload) >= least
        out.append((page_id, len(payload), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    bodies = [None, "", "x", "é" * 30, "\r\n\r\nWARC/1.1\r\n\r\n", "<html>" + "long " * 40000] + [str(rng.random()) for _ in range(20)]
    pages = [(i, rng.choice([None, f"http://a.b/{i}", "http://x/\r\nWARC-Type: bad é"]), rng.choice(bodies)) for i in range(120)]
    return pages + [pages[5], (None, "u", "only here"), (None, "u", "x"), (999, "u", "PK\x05\x06" + "\x00" * 18)]


@pytest.mark.parametrize("seed,least", [(1, 0), (2, 5)])
def test_round_trip(spark, monkeypatch, seed, least):
    pages = sample(seed)
    table = spark.createDataFrame([(*p, 3, "k") for p in pages], "page_id bigint, url string, html string, size int, kind string").repartition(3)
    assert rows_of(warc_zip.report(table, least)) == brute_force(pages, least)


def test_payloads_come_back(spark):
    pages = sample(3)
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    shared = Shared(spark)
    found = warc_zip.read(warc_zip.write(table, shared, "t"), shared, "t", payload=True).where("type = 'response'").collect()
    stored = {(r.page_id, bytes(r.payload)) for r in found}
    kinds = [(p, (h or "").encode()) for (p, _, h) in pages if (p, "response") in {(r[0], r[3]) for r in brute_force(pages)}]
    assert stored <= set(kinds) and {p for p, _ in stored} == {p for p, _ in kinds}


def test_empty_table(spark):
    assert rows_of(warc_zip.report(spark.createDataFrame([], "page_id bigint, url string, html string"))) == []


def test_many_members_and_archives(tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "MEMBER_BYTES", 400)
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 2000)
    packer = warc_zip.Packer(f"file://{tmp_path}", "p")
    for i in range(40):
        packer.add(warc_zip.record(i, "u", b"payload %d" % i, 9, "D", "response", None), {"id": i, "type": "response"})
    packer.close()
    assert len(packer.done) > 1 and sum(n for _, n in packer.done) == 40
    data = (tmp_path / packer.done[0][0]).read_bytes()
    found = warc_zip.directory(lambda at, n: data[at : at + n], len(data))
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert list(found) == names and len(names) > 2


def test_zip64_directory():
    """An archive whose end record and entries hold their values in the 64-bit fields."""
    name, body = b"archive/a.warc", b"some bytes"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    data = local + central + end64 + locator + end
    read = lambda at, n: data[at : at + n]
    assert warc_zip.directory(read, len(data)) == {"archive/a.warc": (0, len(body), 0)}
    at = warc_zip.data_offset(read, 0)
    assert data[at : at + len(body)] == body
    with pytest.raises(ValueError):
        warc_zip.directory(lambda at, n: b"no archive"[at : at + n], 10)


def test_ranges_stay_bounded():
    entries = [{"offset": 10 * i, "length": 10} for i in range(20) if i != 7]
    runs = list(warc_zip.ranges(entries, most=50))
    assert sum(runs, []) == entries and all(r[-1]["offset"] + r[-1]["length"] - r[0]["offset"] <= 50 for r in runs)
