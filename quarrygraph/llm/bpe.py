"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7), by recursive SQL inside each partition.

A partition's texts are cut into words by the vocabulary's pattern; each distinct word is encoded once. A word starts
as one row per byte (word, position, token). A recursive DuckDB query joins neighbouring rows to the merge table and
contracts each word's pairs of least rank, leftmost first, until no pair of any word is in the table; an ordered
aggregation gives the ids. All occurrences of a word's least pair are contracted in one step: a pair with the new token
is always learned after it and so has a greater rank, so this is what one-at-a-time contraction gives.
Words that need more than ROUNDS steps go on in a further query, so that a very long word does not pile up its history.
No shuffle is needed, and no text leaves its row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern that cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Contraction steps of one recursive query.
ROUNDS = 24
#: Bytes of distinct words given to one query.
CHUNK = 1 << 18
#: Words whose ids a worker keeps.
CACHED_WORDS = 400_000

STEP = f"""
WITH RECURSIVE s(w, pos, tok, it) AS (
  SELECT w, pos, tok, 0 FROM start
  UNION ALL
  SELECT w, pos, new_tok, it + 1 FROM (
    SELECT w, pos, it, CASE WHEN joins THEN made ELSE tok END AS new_tok, coalesce(lag(joins) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT w, pos, it, tok, made, hit AND (i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY w ORDER BY pos), 0)) % 2 = 1 AS joins FROM (
        SELECT w, pos, it, tok, made, i, coalesce(rank = best, false) AS hit FROM (
          SELECT c.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY w) AS best FROM (
            SELECT w, pos, it, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS i FROM s WHERE it < {ROUNDS}
          ) c LEFT JOIN merges m ON c.tok = m.a AND c.nxt = m.b
        ) WHERE best IS NOT NULL
      )
    )
  ) WHERE NOT gone
)
SELECT w, list(tok ORDER BY pos) AS ids, max(it) AS steps FROM (SELECT *, max(it) OVER (PARTITION BY w) AS final FROM s) WHERE it = final GROUP BY w
"""


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    kept = set(plain)
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


def supported(file: dict, path: str) -> dict:
    """The model of a vocabulary file, which must be a byte-level BPE that cuts texts as PATTERN does and changes nothing before; others are refused, as they would get wrong ids."""
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = file.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    simple = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not (plain and simple):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    return model


class Encoder:
    """One per worker process and vocabulary: the merge table in DuckDB and the words encoded so far."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = supported(file, path)
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table(
            {
                "a": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
                "b": pa.array([vocab[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int32()),
                "made": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
            }
        )
        self.bytes = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int32)
        self.split = regex.compile(PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.known: dict[str, np.ndarray] = {}

    def _solve(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        left = [(i, self.bytes[np.frombuffer(w, np.uint8)]) for i, w in enumerate(words)]
        while left:
            sizes = np.array([len(t) for _, t in left])
            start = pa.table(
                {
                    "w": np.repeat(np.array([i for i, _ in left], dtype=np.int32), sizes),
                    "pos": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]),
                    "tok": np.concatenate([t for _, t in left]),
                }
            )
            self.con.register("start", start)
            rows = self.con.sql(STEP).to_arrow_table()
            self.con.unregister("start")
            ids = rows["ids"].combine_chunks()
            flat, off = ids.values.to_numpy(), ids.offsets.to_numpy()
            left = []
            for k, (w, steps) in enumerate(zip(rows["w"].to_pylist(), rows["steps"].to_pylist(), strict=True)):
                t = flat[off[k] : off[k + 1]]
                if steps >= ROUNDS:
                    left.append((w, t))
                else:
                    out[w] = t
        return out

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.known.keys())
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = sorted(words)
        lo = 0
        while lo < len(new):
            hi, size, part = lo, 0, []
            while hi < len(new) and (size < CHUNK or not part):
                part.append(new[hi].encode("utf-8"))
                size += len(part[-1])
                hi += 1
            self.known.update(zip(new[lo:hi], self._solve(part), strict=True))
            lo = hi

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [self.split(t) if t else [] for t in texts]
        self.learn({w for ws in words for w in ws})
        none = np.empty(0, np.int32)
        return [np.concatenate([self.known[w] for w in ws]) if ws else none for ws in words]


#: Characters of text that are encoded at once.
SLICE = 4 << 20


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    enc = Encoder.of(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in _slices(texts):
            yield batch.column(0).slice(lo, hi - lo), enc.encode(texts[lo:hi])


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, without special tokens, whose strings are ordinary text.

    A null or empty text gives an empty list; repeated rows give repeated results; other columns are ignored.
    ``vocabulary`` is the path of the byte-level BPE file, which every executor must have; a file of another kind is refused.
    """
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, vocabulary):
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, tokens): the length of ``encode_documents``' ids, 0 for a null or empty text."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, vocabulary):
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens bigint")
