"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Texts are cut by the tokenizer's pattern; each distinct match ("word") of a
partition is encoded once. Its bytes become token-position rows, and a recursive
query joins neighbouring tokens to the merge table and contracts the leftmost pair
of least rank in every word, all words at once, until no word has a pair left. The
merge table holds every split of a vocabulary entry into two entries. An ordered
aggregation turns token rows into ids, and back into bytes for decoding. A text's
ids and bytes are those of its words in order.

Memory: words go to DuckDB in groups of bounded bytes, in one thread, without
spilling; known words are kept per worker process up to about MAX_KEPT bytes and
then forgotten.
A word longer than LONG bytes (a run of one class of characters) takes a heap of
the same pairs in place of rows, as the query visits a word once for each merge;
the result is the same. Null and empty texts have no ids; rows are independent,
so ties and repeated rows give equal results. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewarden.llm.common import small, table, to_arrow

GROUP_BYTES = 400_000
MAX_KEPT = 256 << 20
LONG = 512

# key: rank and place of a pair in one number, so that its least is the leftmost of least rank
ENCODE = """
WITH RECURSIVE s(word, pos, tok, done) AS (
  SELECT word, pos, tok, false FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN pos = best & 1048575 THEN (best >> 20)::INTEGER ELSE tok END, best IS NULL
  FROM (
    SELECT p.word, p.pos, p.tok, p.prev, min(m.rank << 20 | p.pos) OVER (PARTITION BY p.word) AS best
    FROM (
      SELECT word, pos, tok, lead(tok) OVER w AS nxt, lag(pos) OVER w AS prev
      FROM s WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)
    ) p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.nxt
  )
  WHERE best IS NULL OR prev IS NULL OR prev <> best & 1048575
)
SELECT s.word, list(s.tok ORDER BY s.pos) AS ids, string_agg(v.hex, '' ORDER BY s.pos) AS hex
FROM s JOIN vocabulary v ON v.id = s.tok WHERE s.done GROUP BY s.word
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes and decodes by the ranks of one file; made once per task."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.kept = 0
        ranks = self.ranks
        splits = [(ranks[w[:i]], ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w))
                  if w[:i] in ranks and w[i:] in ranks]
        a, b, r = np.array(splits, np.int64).reshape(-1, 3).T
        merges = pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32), "rank": r})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [w.hex() for w in ranks]})
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register(f"given_{name}", rows)
            self.db.execute(f"CREATE TABLE {name} AS FROM given_{name}")
            self.db.unregister(f"given_{name}")
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.by_id = {r: w for w, r in ranks.items()}

    def _keep(self, word: str, ids: bytes, decoded: bytes) -> None:
        self.known[word] = ids, decoded
        self.kept += 150 + 6 * len(decoded)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = pa.table({"word": np.repeat(np.arange(len(raw), dtype=np.int32), lengths), "pos": pos,
                          "tok": self.of_byte[flat]})
        self.db.register("start", start)
        found = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("start")
        ids = found.column("ids").combine_chunks()
        data = ids.flatten().to_numpy().astype("<u4").tobytes()
        ends = (np.cumsum(ids.value_lengths().to_numpy()) * 4).tolist()
        start = 0
        for i, end, code in zip(found.column("word").to_pylist(), ends, found.column("hex").to_pylist()):
            self._keep(words[i], data[start:end], bytes.fromhex(code))
            start = end

    def _learn_long(self, word: str) -> None:
        """The same contraction for one long word, with a heap of its pairs."""
        toks = [bytes([c]) for c in word.encode()]
        nxt, prev = list(range(1, len(toks))) + [-1], [-1, *range(len(toks) - 1)]
        rank = lambda i: self.ranks.get(toks[i] + toks[nxt[i]]) if nxt[i] >= 0 else None
        heap = [(r, i, toks[i], toks[nxt[i]]) for i in range(len(toks)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if toks[i] is not a or nxt[i] < 0 or toks[nxt[i]] is not b:
                continue
            j = nxt[i]
            toks[i], toks[j], nxt[i] = a + b, b"", nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, toks[k], toks[nxt[k]]))
        ids = [self.ranks[t] for t in toks if t]
        self._keep(word, np.array(ids, "<u4").tobytes(), b"".join(self.by_id[i] for i in ids))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded bytes) of each text."""
        if self.kept > MAX_KEPT:
            self.known, self.kept = {}, 0
        cut = [self.split(t) for t in texts]
        group, size = [], 0
        for word in set().union(*cut).difference(self.known):
            if len(word) * 4 > LONG and len(word.encode()) > LONG:
                self._learn_long(word)
                continue
            group.append(word)
            size += len(word)
            if size > GROUP_BYTES:
                self._learn(group)
                group, size = [], 0
        if group:
            self._learn(group)
        out = []
        for words in cut:
            got = [self.known[w] for w in words]
            out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process and rank file. Spark's workers run many
    tasks; a later one starts with the words that earlier ones have met."""
    kept = sys.modules.setdefault("tablewarden_encoders", types.ModuleType("tablewarden_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with ``keep_ids``
    also ids (little-endian unsigned 32-bit integers) and decoded (the text)."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    fields = docs.sparkSession.createDataFrame([], schema + ", ids binary, decoded string" * keep_ids).schema
    out = to_arrow(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in small(batch):
                if not part.num_rows:
                    continue
                encoder = encoder or encoder_of(path)
                coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), [len(i) // 4 for i, _ in coded],
                           [hashlib.sha256(i).hexdigest() for i, _ in coded],
                           [hashlib.sha256(d).hexdigest() for _, d in coded]]
                if keep_ids:
                    columns += [[i for i, _ in coded], [d.decode() for _, d in coded]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(columns, out)], schema=out)

    return docs.select(id_col, text_col).mapInArrow(run, fields)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
