"""Every operator on documents against brute force, on a table with nulls, empty, long, tied and repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, exact_dedup, jaccard, licenses, media, packing, quality, substring, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, word string, score double, run int"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "dElta", "éclair", "日本", "x1", "über", "|", "the", "of", "license", "zeta,", "end."]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(n))
    passage, body = line(60), line(300)
    texts = [None, "", " ", "a", "A", "one two three", "one  two\tthree", "  odd space\u0085 ", "x" * 3000, "same " * 400, "=" * 200 + " " + "ab" * 90, "<|endoftext|> it's\n\n fine  "]
    texts += [body, body, body.upper(), body.replace("alpha", "omega", 2), line(40) + " " + passage + " " + line(30), passage + " tail", line(5) + "\n" + passage, line(5000)]
    texts += [body + " " + line(k) for k in (1, 3, 8)] + ["Licensed under CC BY-NC 4.0.", "It is cc-by, cc by! All rights reserved.", "This is licensed under the GNU General Public License, version 3."]
    texts += ["a a a a a a a a a a a a a a a a a b", "q a a a a a a a a a a a a a a a a a a b c", "a a a a a a a a a a a a a a"] + [line(rng.randint(1, 80)) for _ in range(60)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 7, "w", 0.5, 1) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated ids, and a row that occurs twice."""
    return spark.createDataFrame([(None, "a b c", "x"), (None, None, "x"), (4, "a b c", None), (4, "a b c", None), (4, "other words here", "y"), (9, "", None)], "doc_id long, text string, lang string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_media(docs, rows, nothing, odd):
    got = by_id(media.media_table(docs))
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        box = media.mux(pay)
        assert (r["media_bytes"], r["media_sha256"]) == (len(box), hashlib.sha256(box).hexdigest())
        assert all(box[k["offset"] : k["offset"] + k["length"]] == pay[n * 16 * 192 : n * 16 * 192 + 192] for n, k in enumerate(r["keyframes"]))
    assert media.media_table(nothing).count() == 0 and media.media_table(odd).count() == 6


def test_media_other_containers(spark):
    """64-bit sizes, unknown boxes, several tracks, and bytes that are no container."""
    import struct

    box = media.mux(b"ab" * 192)
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + box
    assert [p[-1] for p, *_ in media.walk(memoryview(wide))][:2] == ["free", "ftyp"]
    assert media.probe(b"not a container at all") == [] and media.probe(b"") == []
    assert media.describe(media.probe(box)).startswith("codec=raw;handler=soun;timescale=8000;duration=384;samples=2")
    df = media.media_features(spark.createDataFrame([(1, None), (2, b"junk")], "k int, media binary"))
    got = {r["k"]: r for r in df.collect()}
    assert got[1]["media_bytes"] is None and got[2]["payload_bytes"] == 0 and got[2]["codec"] is None


def test_media_damaged_containers(spark):
    """Cut, changed and contradicting bytes never fail, and nothing outside of the file is named."""
    import struct

    rng = random.Random(6)
    whole = media.mux(bytes(rng.randrange(256) for _ in range(192 * 40)))
    tried = [whole[:k] for k in range(0, 900, 7)]
    for _ in range(1500):
        b = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(700)
            b[at : at + rng.choice([1, 4])] = bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range(rng.choice([1, 4])))
        tried.append(bytes(b))
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", 8 + len(deep), b"moov") + deep
    huge = whole.replace(struct.pack(">I4sIII", 20, b"stsz", 0, 192, 40), struct.pack(">I4sIII", 20, b"stsz", 0, 1, (1 << 31) - 1))
    assert huge != whole
    for raw in (*tried, deep, huge):
        for t in media.probe(raw):
            assert len(t["offsets"]) == len(t["sizes"]) and all(0 <= t["offsets"]) and all(t["offsets"] + t["sizes"] <= len(raw)) and all(t["keys"] < len(t["offsets"]))
            media.samples(raw, t)
    df = media.media_features(spark.createDataFrame([(1, whole, "x", 2.0)], "k int, media binary, feature string, duration double"))
    assert df.select("feature", "duration").first()["feature"].startswith("codec=raw") and df.columns.count("feature") == 1


def test_media_fragments():
    """Samples of movie fragments are found where their run says."""
    import struct

    track = media._box(b"trak", media._full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))))
    head = media._box(b"ftyp", b"isom", bytes(4)) + media._box(b"moov", track, media._box(b"mvex", media._full(b"trex", struct.pack(">IIIII", 7, 1, 0, 0, 0))))
    run = lambda offset: media._full(b"trun", struct.pack(">Ii", 3, offset), struct.pack(">III", 4, 5, 6), flags=0x201)
    part = lambda offset: media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7)), run(offset)))
    size = len(part(0))
    raw = head + part(size + 8) + media._box(b"mdat", b"aaaabbbbbcccccc")
    (t,) = media.probe(raw)
    assert media.samples(raw, t) == b"aaaabbbbbcccccc" and t["sizes"].tolist() == [4, 5, 6] and t["keys"].tolist() == [0]


def test_token_output(docs, rows, nothing, odd, spark):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    shards = token_files.write_token_shards(docs, path)
    got, start = by_id(token_files.read_token_shards(shards)), 0
    assert len(got) == len(rows)
    want = {}
    for i, t in sorted(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = ids
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: r["ids"] for r in token_files.read_documents(shards, [1, 31, 58]).collect()} == {k: want[k] for k in (1, 31, 58)}
    assert token_files.read_token_shards(token_files.write_token_shards(nothing, path)).count() == 0
    assert token_files.read_token_shards(token_files.write_token_shards(odd, path)).count() == 6


def test_token_shards_are_checked():
    import io

    import zstandard

    file = io.BytesIO()
    writer = token_files.ShardWriter(file, 2, frame_ids=10)
    ids = np.arange(35)
    writer.add(np.arange(7), ids, np.arange(0, 36, 5))
    writer.close()
    raw = file.getvalue()
    assert len(token_files.ShardReader(io.BytesIO(raw), len(raw)).frames) == 4
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)[:70] == ids.astype("<u2").tobytes()
    assert token_files.ShardReader(io.BytesIO(raw), len(raw)).read([5])[5].tolist() == [25, 26, 27, 28, 29]
    broken = bytearray(raw)
    broken[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_files.ShardReader(io.BytesIO(bytes(broken)), len(raw)).frame(0)


def test_packing(docs, rows, nothing, odd):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = packing.pack_documents(docs, path, "word", 1, 256).collect()
    want = {}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 256)):
            want[i, k] = (a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(v[1] for v in want.values()) // 256) + 1
    assert packing.pack_documents(nothing, path).count() == 0 and packing.pack_documents(odd, path).count() == 6


def test_packing_rounds(spark):
    """Many small groups: what is underfull is packed again, and nothing is lost."""
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, rng.randint(1, 100)) for i in range(3000)], "row long, length long")
    got = packing.pack_pieces(pieces, 100, group_size=200).toPandas()
    assert sorted(got["row"]) == list(range(3000))
    fill = got.groupby("sequence_id")["length"].sum()
    least = max(fill.sum() / 100, (got["length"] > 50).sum())  # two of more than half don't share a sequence
    assert fill.max() <= 100 and len(fill) <= 1.03 * least


def test_local_search():
    sizes = [60, 60, 60, 40, 40, 35]
    bins = packing.local_search(sizes, [[0, 3], [1, 4], [2], [5]], 100)
    assert sorted(i for b in bins for i in b) == list(range(6))
    assert len(packing.local_search([50, 50, 30, 70], [[0, 2], [1], [3]], 100)) == 2
    assert packing.best_fit([], 10) == [] and packing.local_search([], [], 10) == []


def test_local_search_of_many_bins():
    """More bins than 128 get full on the way; the search goes on, and tries all underfull bins."""
    rng = random.Random(1)
    for least, most, capacity, n, saved in ((1000, 2000, 4096, 5000, 50), (20, 50, 100, 4000, 25)):
        sizes = [rng.randint(least, most) for _ in range(n)]
        before = packing.best_fit(sizes, capacity)
        bins = packing.local_search(sizes, before, capacity)
        assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) <= len(before) - saved


def test_bpe(docs, rows, nothing, odd):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.round_trip(docs, path, P.PATTERN))
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text"), path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == enc.encode_ordinary(r["text"] or "") for r in coded.collect())
    assert bpe.round_trip(nothing, path, P.PATTERN).count() == 0 and bpe.round_trip(odd, path, P.PATTERN).count() == 6
    pairs = bpe.byte_pairs(path, P.PATTERN)
    rng = random.Random(2)
    words = [b"=" * 300, b"abcabd" * 40, "äöü".encode() * 30, b"x" * 5000, bytes(rng.choice(b"aab") for _ in range(600)), bytes(rng.choice(b"aeinrst") for _ in range(600)), b""]
    assert pairs.contract(words) == [enc._encode_single_piece(w) if w else [] for w in words]  # words of any length take the same queries
    ids = np.array([t for w in words for t in enc._encode_single_piece(w or b"-")], np.uint32)
    assert b"".join(pairs.decode(ids, np.array([0, 5, 5, len(ids)]))) == b"".join(w or b"-" for w in words)
    with pytest.raises(Exception, match="ids without a token"):
        bpe.decode_ids(docs.limit(1).selectExpr("array(1, 9999999) as ids"), path, P.PATTERN).collect()


def brute_repeats(rows, window=13):
    words = {i: BLANKS.findall(t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in words.items():
        gone = {s + k for s in range(len(w) - window + 1) if least[tuple(w[s : s + window])] < i for k in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_substring(docs, rows, nothing, odd):
    got = by_id(substring.substring_dedup(docs))
    want = brute_repeats(rows)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(v[1] for v in want.values()) > 300
    assert substring.substring_dedup(nothing).count() == 0 and substring.substring_dedup(odd).count() == 6
    assert substring.remove_repeats(docs).columns == [*docs.columns, "n_words", "n_removed", "kept"]


def test_substring_random(spark):
    """Few words, so that runs, periods and overlapping repeats abound."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab" if i % 3 else "abcdef") for _ in range(rng.randint(0, 120)))) for i in range(80)]
    rows += [(200 + i, " ".join(["ab cd", "ab", "x x x"][i % 3] for _ in range(40 + i))) for i in range(9)]
    got = by_id(substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute_repeats(rows)


def brute_components(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = BLANKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    at = {i: i for i in sets}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(at[a], at[b])
            changed |= at[a] != m or at[b] != m
            at[a] = at[b] = m
    return {i: (len(sets[i]), at[i]) for i in sets}


def test_jaccard(docs, rows, nothing, odd):
    got = by_id(jaccard.jaccard_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows)
    assert jaccard.jaccard_components(nothing).count() == 0
    strange = jaccard.jaccard_components(odd).collect()
    assert len(strange) == 6 and {r["component_id"] for r in strange if r["doc_id"] == 4} == {4}


def test_jaccard_long_lists(spark, monkeypatch):
    """Groups of near copies far larger than a short list, compared in several tasks."""
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "TASK", 16)
    rng = random.Random(3)
    rows = []
    for g, size in enumerate((60, 100, 258)):  # the last lies where wide bitmaps double
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for k in range(40):
            w = list(base) + [f"t{k}-{i}" for i in range(rng.randint(0, 5))]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 10_000)}"
            rows.append((g * 100 + k, " ".join(w)))
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows)


def test_jaccard_common_ngrams_form_no_groups(spark, monkeypatch):
    """Phrases that occur now and then in unrelated documents, never twice near each other, come last in the order of n-grams, so they join no sets to groups."""
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "COUNTED", 64)
    sizes, write = {}, jaccard.materialise

    def written(df, name, *by):
        out = write(df, name, *by)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialise", written)
    rows = [(i, " ".join([*(f"w{i}-{k}" for k in range(60)), *(f"phrase{i % 12} {i % 12} of words".split()), *(f"v{i}-{k}" for k in range(60))])) for i in range(240)]
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (121, i) for i, _ in rows}
    assert sizes["groups"] == 0 and sizes["shared-prefixes"] == 0


def test_jaccard_links(spark, monkeypatch):
    """Every link is counted, inside components too: short and long lists, near copies, copies, texts without words."""
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "TASK", 16)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(90)]
    body = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(w if k != at else f"new{i}" for k, w in enumerate(body)) for i, at in enumerate(rng.choices(range(120), k=40))]
    texts += texts[:3] + ["", None, "one two"] + [" ".join(rng.choices(words, k=60)) for _ in range(10)]
    grams = [{tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set() for w in ((t or "").split() for t in texts)]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(grams)) for i, a in enumerate(grams)]
    got = by_id(jaccard.jaccard_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["n_links"] for i in range(len(texts))] == want and max(want) > 30
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(g) for g in grams]


def test_exact(docs, rows, nothing, odd):
    got = by_id(exact_dedup.exact_duplicates(docs))
    groups = collections.defaultdict(list)
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for i, t in rows:
        groups[fold(t)].append(i)
    for i, t in rows:
        g, r = groups[fold(t)], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), max(g) == i, hashlib.sha256(fold(t).encode()).hexdigest())
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    assert exact_dedup.exact_duplicates(odd).count() == 6
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns
    small = by_id(exact_dedup.exact_duplicates(docs, keep="smallest"))
    assert all(r["keep_id"] == min(groups[fold(t)]) for i, t in rows for r in [small[i]])


def test_exact_rows_of_one_id(spark):
    """Another text of an id whose row goes stays; null ids go where their group has an id; the least id of all may be kept."""
    df = spark.createDataFrame([(5, "aaa"), (5, "bbb"), (9, "bbb"), (None, "bbb"), (None, "ccc"), (-(1 << 63), "ddd"), (3, "DDD"), (None, None), (7, "")], "doc_id long, text string")
    left = sorted(map(str, exact_dedup.drop_exact_duplicates(df).collect()))
    assert left == sorted(map(str, df.where("text in ('aaa', 'ccc', 'DDD') or doc_id in (7, 9)").collect()))
    least = {r["text_sha256"]: r for r in exact_dedup.exact_duplicates(df.where("doc_id < 4"), keep="smallest").collect()}
    assert [r["keep_id"] for r in least.values()] == [-(1 << 63)]


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, text, 1, 2), (5, text, 1, 2), (5, "quite other text of five words", 1, 2), (None, text + " x", 1, 2), (None, "alone it stays as it is", 1, 2), (8, None, 1, 2), (9, "", 1, 2)], "doc_id long, text string, row int, mark int")
    left = jaccard.keep_one_of_each(df, 5, 80)
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, df.where("doc_id = 3 or text like 'quite%' or text like 'alone%' or doc_id >= 8").collect()))


def test_list_pairs_skip_nothing():
    """Blocks that are skipped hold no pair that sizes and positions allow."""
    rng = random.Random(8)
    rows = []
    for g in range(30):
        rows += sorted((g, rng.randint(0, 40), k, rng.randint(41, 90)) for k in range(rng.randint(1, 60)))
    gram, at, row, n = (np.array(x, np.int64) for x in zip(*rows))
    i, j = jaccard.list_pairs(gram, row, n, at, 85)
    want = set()
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            a, b = sorted((int(n[x]), int(n[y])))
            most = min(at[x], at[y]) + 1 + min(n[x] - at[x] - 1, n[y] - at[y] - 1)
            if gram[x] == gram[y] and row[x] != row[y] and 100 * a >= 85 * b and most >= -(-85 * (a + b) // 185):
                want.add((x, y))
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) == len(i) > 500


def test_licenses(docs, rows, nothing, odd):
    got = by_id(licenses.scan_licenses(docs))
    for i, t in rows:
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert "cc-by-nc" in [r for r in got.values() if r["base_labels"] == "cc-by"][0]["labels"]
    assert any("gpl-3.0" in r["labels"] for r in got.values())
    assert licenses.scan_licenses(nothing).count() == 0 and licenses.scan_licenses(odd).count() == 6


def test_licenses_side_by_side(spark):
    """Several notices in one text are all found, whichever has the rarer words."""
    by_name = {}
    for label, notice, _ in licenses.TEMPLATES:
        by_name.setdefault(label, notice)
    texts = [by_name["mit"] + " beside " + by_name["apache-2.0"], "Released under the MIT License | " + by_name["apache-2.0"] + " | " + by_name["gpl-3.0"], " beside ".join(by_name.values())]
    common = [by_name["apache-2.0"]] * 20 + [by_name["gpl-3.0"]] * 20 + ["nothing of that kind"] * 20
    got = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts + common)), "doc_id long, text string")))
    assert {"mit", "apache-2.0"} <= set(got[0]["labels"].split(",")) and got[0]["score"] == 1
    assert {"mit", "apache-2.0", "gpl-3.0"} <= set(got[1]["labels"].split(","))
    assert set(by_name) <= set(got[2]["labels"].split(","))
    assert got[3]["labels"] == "apache-2.0" and got[len(texts) + 40]["score"] == 0


def brute_labels(texts, rare=8, agree=0.6):
    """Labels and scores by trying every template at every place of every text."""
    words = [[w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())] for t in texts]
    df = collections.Counter(w for ws in words for w in set(ws))
    idf = lambda w: np.log((len(texts) + 1) / (df[w] + 1))
    made = []
    for label, notice, key in licenses.TEMPLATES:
        n, k = notice.split(), key.split()
        at = next(i for i in range(len(n)) if n[i : i + len(k)] == k)
        kept = [(i, w, at <= i < at + len(k)) for i, w in enumerate(n) if w not in licenses.COMMON or at <= i < at + len(k)]
        order = sorted((x for x in kept if df[x[1]]), key=lambda x: (-idf(x[1]), x[1], x[0]))
        anchors = {x[0] for x in order[:rare]} | {x[0] for x in [x for x in order if x[2]][:1]}
        made.append((label, kept, anchors))
    out = []
    for ws in words:
        found, best = set(), 0.0
        for label, kept, anchors in made:
            for start in range(-30, len(ws)):
                hit = [x for x in kept if 0 <= start + x[0] < len(ws) and ws[start + x[0]] == x[1]]
                share = len(hit) / len(kept)
                if share >= agree and all(x in hit for x in kept if x[2]) and any(x[0] in anchors for x in hit):
                    found, best = found | {label}, max(best, share)
        base = {label for p, label in licenses.BASE.items() if any(ws[k : k + len(p.split())] == p.split() for k in range(len(ws)))}
        out.append((",".join(sorted(found | base)), 1.0 if base else best))
    return out


def test_licenses_brute(spark):
    """Whole, cut, changed and joined notices beside trying everything."""
    rng = random.Random(12)
    texts = [None, "", "no licence here", "MIT MIT license license"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            n = rng.choice(licenses.TEMPLATES)[1].split()
            a, b = (0, len(n)) if rng.random() < 0.5 else sorted(rng.sample(range(len(n) + 1), 2))
            n = n[a:b]
            for _ in range(rng.randint(0, 3) if n and rng.random() < 0.5 else 0):
                n[rng.randrange(len(n))] = rng.choice(["license", "word", "the", "public"])
            parts += n + [rng.choice(["beside", "|", "the", "zeta"])] * rng.randint(0, 3)
        texts.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in parts))
    got = by_id(licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)))
    want = brute_labels(texts)
    assert {i: (got[i]["labels"], round(got[i]["score"], 9)) for i in got} == {i: (labels, round(score, 9)) for i, (labels, score) in enumerate(want)}
    assert len({x for x, _ in want}) > 40


def test_quality(spark, nothing, odd, docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels)
    r = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert len(r) > 50 and (r["predicted"] == r["quality"]).mean() > 0.95
    assert r["score"].between(0, 1).all()
    few = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, few).count() == docs.count()
    none = few.limit(0)
    assert quality.quality_scores(nothing, none).count() == 0 and quality.quality_scores(odd, none).count() == 6


def test_components(spark):
    from gridloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (300, 200), (300, 250)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[250] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_never_end_silently(spark):
    from gridloom.llm.components import connected_components

    edges = spark.range(9).selectExpr("id as u", "id + 1 as v")
    with pytest.raises(RuntimeError):
        connected_components(edges, most=1)
    assert connected_components(edges).where("component = 0").count() == 10
