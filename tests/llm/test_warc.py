import base64
import hashlib
import io
import random

import pytest
import zstandard

from trilect.llm import warc
from trilect.session import ensure_checkpoint_dir

SCHEMA = "page_id bigint, url string, html string, sha string, n int, target string, payload string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1, "t", "p", "x") for i, u, h in rows], SCHEMA)


def brute_force(rows, least=0):
    out, largest = [], {}
    for i, _, h in rows:
        largest[h or ""] = max([x for x in (i, largest.get(h or "")) if x is not None], default=None)
    for i, _, h in rows:
        data = (h or "").encode()
        target = largest[h or ""]
        again = len(data) >= least and i != target
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", target if again else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


ROWS = [
    (1, "http://a/b c\r\nX: y", "<p>é</p>"), (2, None, None), (3, "http://a", ""), (4, "http://ü/?q=1", "<p>é</p>"), (4, "u", "<p>é</p>"),
    (None, "http://n", "<p>é</p>"), (None, None, "only"), (9, "http://long", "x\r\n\r\ny" * 400_000), (7, "http://a", "same"), (8, "http://a", "same"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, least):
    assert result(warc.round_trip(frame(spark, ROWS), least)) == brute_force(ROWS, least)


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_many_archives_with_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    rng = random.Random(1)
    rows = [(k, f"http://h/{k}", "<html><body>" + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(300))) for k in range(400)]
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-test"
    manifest = warc.write_archives(frame(spark, rows), folder)
    paths = [r.path for r in manifest.collect()]
    assert len(paths) > 4 and sum(r.n_records for r in manifest.collect()) == 400
    assert result(warc.read_archives(manifest)) == brute_force(rows)
    where, path = warc.file_system(paths[0])
    with where.open_input_stream(path) as stream:
        data = stream.read()
    # A leading skippable frame, which a reader without the dictionary passes over.
    assert data[:4] == bytes.fromhex("5d2a4d18") and zstandard.frame_content_size(data) == 0
    first = next(iter(warc.read_records(io.BytesIO(data))))
    assert first[0]["WARC-Type"] == "warcinfo"


def test_fields_can_not_be_forged():
    text = warc.page_record(1, "http://a/\r\nWARC-Type: x", b"p", None, False).decode()
    assert text.count("\r\nWARC-Type:") == 1 and "%0D%0AWARC-Type:%20x" in text


def test_damage_is_noticed(spark):
    records = [warc.page_record(k, "u", b"text %d" % k, None, False) for k in range(3)]
    data = b"".join(warc.archive(records, []))
    assert len(list(warc.read_records(io.BytesIO(data)))) == 4
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(data[:-3])))
