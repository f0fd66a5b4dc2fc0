"""Byte-level BPE in DuckDB: recursive queries contract, ordered aggregation decodes.

Each Python worker splits its texts by the pattern and keeps the distinct words. Words it has not met go to an in-process DuckDB as rows (word, position, token), one
for each byte. A recursive query joins neighbours to the merge table and contracts each word's leftmost pair of least rank, until no word has one left; only words that changed
go on to the next step. Where no merge that uses the new token has a lesser rank, the next pairs to be contracted are the same pair's further places, so these are contracted in the same step:
a long run takes a few steps. A text's ids are its words' ids.

Decoding joins ids to the tokens' bytes and puts them together by an ordered aggregation, a row for each id of each text.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import blocks, ragged, text_buffer
from .segments import Vocabulary, bpe_segments

#: Bytes of the words in one recursive query, and ids in one that decodes; they bound its memory. A longer word or text is alone.
BATCH = 400_000
IDS = 1_000_000

CONTRACT = """
WITH RECURSIVE state(step, word, pos, token) AS (
    SELECT 0::INTEGER, word, pos, token FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT l.word, l.pos, m.rank, m.plain FROM state l JOIN state r ON r.word = l.word AND r.pos = l.pos + 1 JOIN merges m ON m.first = l.token AND m.second = r.token),
     least AS (SELECT word, min(rank) AS rank FROM pairs GROUP BY word),
     places AS (SELECT word, pos, rank, plain, row_number() OVER (PARTITION BY word ORDER BY pos) AS k FROM pairs JOIN least USING (word, rank)),
     apart AS (SELECT word, pos, rank, plain, k, row_number() OVER (PARTITION BY word, pos - k ORDER BY pos) AS nth FROM places),
     picked AS (SELECT word, pos, rank FROM apart WHERE k = 1 OR (plain AND nth % 2 = 1))
     SELECT s.step + 1, s.word, (row_number() OVER (PARTITION BY s.word ORDER BY s.pos) - 1)::INTEGER, coalesce(p.rank, s.token)
     FROM state s SEMI JOIN least ON least.word = s.word LEFT JOIN picked p ON p.word = s.word AND p.pos = s.pos ANTI JOIN picked q ON q.word = s.word AND q.pos = s.pos - 1)),
last AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT word, list(token ORDER BY pos) AS ids FROM state JOIN last USING (word, step) GROUP BY word ORDER BY word
"""

DECODE = "SELECT row, string_agg(v.hex, '' ORDER BY pos) AS decoded FROM coded JOIN vocabulary v USING (token) GROUP BY row ORDER BY row"


class BytePairs:
    """A rank file's vocabulary; the id of a token is its rank."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        first, second, rank = (np.array(x, np.int32) for x in zip(*pairs))
        least = np.full(max(self.tokens) + 1, np.iinfo(np.int32).max)  # of the merges that use a token
        np.minimum.at(least, first, rank)
        np.minimum.at(least, second, rank)
        merges = pa.table({"first": first, "second": second, "rank": rank, "plain": least[rank] > rank})  # noqa: F841  read by name
        vocabulary = pa.table({"token": pa.array(self.tokens.keys(), pa.int32()), "hex": [t.hex() for t in self.tokens.values()]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.vocabulary = Vocabulary()

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [None] * len(words)
        todo = []
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = [whole]
            elif w:
                todo.append(i)
            else:
                out[i] = []
        for part in _parts(np.array([len(words[i]) for i in todo], np.int64), BATCH):
            part = todo[part]
            lengths = np.array([len(words[i]) for i in part], np.int64)
            letters = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            start = pa.table({"word": np.repeat(np.arange(len(part), dtype=np.int32), lengths), "pos": ragged(np.zeros(len(part), np.int64), lengths).astype(np.int32), "token": self.byte[letters]})
            self.db.register("start", start)
            for i, ids in zip(part, self.db.sql(CONTRACT).to_arrow_table()["ids"].to_pylist(), strict=True):
                out[i] = ids
            self.db.unregister("start")
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids; ids that the vocabulary lacks fail."""
        out = [b""] * (len(offsets) - 1)
        for part in _parts(np.diff(offsets), IDS):
            lengths = np.diff(offsets[part.start : part.stop + 1])
            token = ids[offsets[part.start] : offsets[part.stop]].astype(np.int32)
            self.db.register("coded", pa.table({"row": np.repeat(np.arange(part.start, part.stop, dtype=np.int32), lengths), "pos": np.arange(len(token), dtype=np.int32), "token": token}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("coded")
            for row, text in zip(got["row"].to_pylist(), got["decoded"].to_pylist()):
                out[row] = bytes.fromhex(text)
        return out

    def _learn(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of segments."""
        parts = [[p.encode() for p in self.pattern.findall(x.decode())] for x in raw]
        distinct = list(dict.fromkeys(p for x in parts for p in x))
        known = dict(zip(distinct, self.contract(distinct)))
        return [np.array([t for p in x for t in known[p]], np.uint32) for x in parts]

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, their offsets by text)."""
        starts, ends, first = bpe_segments(data, offsets)
        entries = self.vocabulary.entries(data, starts, ends, self._learn)
        if not len(entries):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        return self.vocabulary.ids(entries), np.append(0, np.cumsum(self.vocabulary.length[entries]))[first]


def _parts(sizes: np.ndarray, most: int):
    """Slices of entries whose sizes add up to ``most`` at most, or of one entry."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield slice(at, to)
        at = to


@functools.cache
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One per Python worker and file."""
    return BytePairs(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>) of ``text``; a null or empty text has none. A column that has that name already is replaced, others pass through."""
    kept = [f for f in df.schema if f.name != ids]

    def encode(batches):
        pairs = byte_pairs(path, pattern)
        for batch in blocks(batches, text):
            flat, offsets = pairs(*text_buffer(batch.column(text)))
            column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), column], [*(f.name for f in kept), ids])

    return df.mapInArrow(encode, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{ids}` array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary) of any array of ids, by DuckDB's ordered aggregation; null or empty arrays give empty bytes, ids that the vocabulary lacks
    fail. A column named as ``out`` is replaced, others pass through."""
    kept = [f for f in df.schema if f.name != out]

    def decode(batches):
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            column = batch.column(ids).cast(pa.list_(pa.int32()))
            if len(lost := set(column.flatten().unique().to_pylist()) - pairs.tokens.keys()):
                raise ValueError(f"ids without a token: {sorted(lost, key=str)[:5]}")
            ends = np.append(0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)), dtype=np.int64))
            made = pa.array(pairs.decode(column.flatten().to_numpy(), ends), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], [*(f.name for f in kept), out])

    return df.mapInArrow(decode, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """op6's rows: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (of what the ids decode to). Encodes and decodes in one
    pass over the texts, so ids need not be stored. Null texts are empty; rows that repeat an id are rows of their own; an empty table gives an empty result."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        pairs = byte_pairs(path, pattern)
        for batch in blocks(batches, "text"):
            ids, at = pairs(*text_buffer(batch.column("text")))
            raw = memoryview(ids.astype("<u4").tobytes())
            coded = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            decoded = [hashlib.sha256(x).hexdigest() for x in pairs.decode(ids, at)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
