import base64
import collections
import hashlib
import io
import random
import re

import pyarrow.fs
import pytest
from test_documents import brute_components, brute_repeats

from gridloom.llm import warc


def test_archives(spark):
    rows = [(1, "http://a/1", "<p>one</p>" * 30, 5), (2, None, None, 5), (3, "http://a/3", "", None), (4, "u\r\nx", "<p>one</p>" * 30, 5), (5, "u", "é" * 5000, 5), (9, "v", "<p>one</p>" * 30, 1), (-3, "w", "z", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive long").repartition(3)
    manifest = warc.write_archives(pages)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    groups = collections.defaultdict(list)
    for i, _, t, _ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for i, _, t, _ in rows:
        raw, keep = (t or "").encode(), max(groups[t or ""])
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == keep else ("revisit", keep))
    for uri in [r["path"] for r in manifest.collect()]:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        raw = fs.open_input_file(path).read()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
        assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in warc.read_records(io.BytesIO(raw)))


def test_archives_edges(spark):
    schema = "page_id long, url string, html string"
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], schema))).count() == 0
    odd = spark.createDataFrame([(None, "a", "x"), (None, "b", None), (2, "c", "x"), (2, "c", "x")], schema)
    got = warc.read_archives(warc.write_archives(odd)).collect()
    assert len(got) == 4 and sorted(r["record_type"] for r in got) == ["response", "response", "response", "revisit"]


def test_dictionary_helps():
    """Small records of one kind compress better with their dictionary."""
    records = [warc.make_record(i, f"http://site/{i}", f"<html><head><title>Page {i}</title></head><body>Number {i * i}</body></html>".encode(), "A" * 32, None, "2024-01-01T00:00:00Z") for i in range(3000)]
    file = io.BytesIO()
    writer = warc.WarcWriter(file, warc.build_dictionary(records[::3], 32 << 10).as_bytes())
    for r in records:
        writer.write(r)
    assert list(warc.read_records(io.BytesIO(file.getvalue()))) == records
    import zstandard

    assert len(file.getvalue()) < 0.6 * sum(len(zstandard.compress(r)) for r in records)


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids, counts = None, [docs.count()]
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, d).cache()
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = {r[0] for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        ids = now
        counts.append(out.count())
        docs = out
    assert counts[1] < counts[0] and counts[2] < counts[1]


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, row long, mark long, ranges string, score double"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small():
    """Copies, near copies, shared passages, short, empty and null texts."""
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 60)) for _ in range(n))
    body, passage = line(200), line(40)
    texts = [body, body.upper(), body + " tail", body.replace("a1", "zz"), body, None, "", " ", "one two three", "ONE two three", line(30) + " " + passage, passage + " " + line(20), passage, line(3000)]
    return [(7 * i + 2, t) for i, t in enumerate(texts + [line(rng.randint(1, 60)) for _ in range(40)])]


@pytest.fixture(scope="module")
def frame(spark, small):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "r", 0.5) for i, t in small], FIELDS).repartition(4).cache()


def test_stages_beside_brute_force(spark, small, frame):
    """Exact, near and substring stages on columns whose names clash with those used inside."""
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    d = "/root/testdata/sf0.001"
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {}
    for i, t in small:
        last[fold(t)] = max(i, last.get(fold(t), i))
    out = stages["exact dedup"](spark, frame, d)
    assert out.columns == frame.columns and {r["doc_id"] for r in out.collect()} == set(last.values())
    kept = {i for i, (_, c) in brute_components(small, 5, 80).items() if i == c}
    near = stages["n-gram jaccard join"](spark, frame, d)
    assert near.columns == frame.columns and {r["doc_id"] for r in near.collect()} == kept and len(kept) < len(small)
    want = {i: v for i, v in brute_repeats(small).items() if v[1] < v[0] or not v[0]}
    texts = dict(small)
    got = {r["doc_id"]: r for r in stages["substring dedup"](spark, frame, d).collect()}
    assert got.keys() == want.keys()
    for i, (n, gone, sha) in want.items():
        assert got[i]["text"] == texts[i] if not gone else hashlib.sha256(got[i]["text"].encode()).hexdigest() == sha and got[i]["n_chars"] == len(got[i]["text"])
        assert (got[i]["row"], got[i]["ranges"], got[i]["score"]) == (1, "r", 0.5)
    from gridloom.llm import quality

    model = quality.fit(frame, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r["doc_id"] for r in quality.add_score(frame, model, out="p").where("p >= 0.3").collect()}
    out = stages["quality classifier"](spark, frame, d)
    assert out.columns == frame.columns and {r["doc_id"] for r in out.collect()} == good
    packed = stages["best-fit packing"](spark, frame, d).toPandas()
    assert set(packed["doc_id"]) == set(texts) and packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_stages_on_odd_tables(spark, frame):
    """Null and repeated ids, repeated rows, and no rows at all: nothing fails, columns stay."""
    import corpus_pipeline as p

    odd = spark.createDataFrame([(None, "a b c", None, None, None, 1, 1, "", 0.1), (None, None, None, None, None, 1, 1, "", 0.1), (4, "a b c", None, "x", 5, 1, 1, "", 0.1), (4, "a b c", None, "x", 5, 1, 1, "", 0.1), (4, "other words here", None, "x", 5, 1, 1, "", 0.1), (9, "", None, None, 0, 1, 1, "", 0.1)], FIELDS)
    left = {"exact dedup": 4, "n-gram jaccard join": 5, "substring dedup": 6, "best-fit packing": 6}
    for name, stage in p.STAGES:
        got = stage(spark, odd, "/root/testdata/sf0.001")
        assert name == "quality classifier" or got.count() == left[name], name
        assert name == "best-fit packing" or got.columns == odd.columns
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0
