"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

No piece of the vocabulary holds a space mark after another character, nor a line feed, so a text's tokens are those of
its segments: spaces with the word after them, and a line feed with the word after it. This is checked when a vocabulary
is loaded; with one for which it does not hold, every text goes to the library whole. The lengths of frequent segments
come from a compact table that is broadcast; misses are encoded by the library and kept in a bounded cache per worker.

The frequent segments come from all texts: each task counts its own, keeping a bounded summary, and reports at most
TASK_TOP of them; only these summaries are added up.

Defined cases: a null or empty text has no bytes and no tokens. Texts that hold the vocabulary's space mark itself go to
the library whole; any other character, NUL too, is part of a word. Repeated rows give equal rows. A very long text is
counted whole, by its segments. Other columns pass through counted() untouched, whatever their names, but for one named as
the struct column that the caller chooses. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from factloom.llm.textvec import blocks, column_bytes, no_cycles, worker_state

#: Segments in the broadcast table, segments that a task reports, segments that a task counts at once, and a worker's cache.
TABLE, TASK_TOP, TASK_COUNTS, CACHE = 50_000, 2_000, 200_000, 400_000
MAX_TOKENS = 4096
SPACE_MARK = "▁"
_SEGMENT = re.compile(r"\n[^ \n]*| +[^ \n]*")


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str) -> list[str]:
    """Segments of a text that is not empty: a word after one space stands bare, one after a line feed keeps it, and all
    others keep their spaces (in their number, the one that the library puts first included)."""
    marked = text.replace("\n", " \n")
    if "  " not in marked and marked[0] != " " and marked[-1] != " ":
        return marked.split(" ")
    return [s[1:] if s[0] == " " and s[1:2] not in ("", " ") else s for s in _SEGMENT.findall(" " + text)]


class Lengths:
    """Lengths of segments by library, with a cache of two generations."""

    def __init__(self, model: bytes, table: dict[str, int] | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = table or {}
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.lone = len(self.encode(["\n"])[0]) - 1
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        #: Whether a text's tokens are those of its segments.
        self.by_segments = not any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def of(self, some: list[str]) -> list[int]:
        """The number of tokens of each segment."""
        # The library puts a space first: a word after a line feed has one token too many then, and spaces one space too many.
        found = self.encode([s[1:] if s[0] == " " else s for s in some])
        return [self.lone if s == " " else len(ids) - self.lone if s[0] == "\n" else len(ids) for s, ids in zip(some, found, strict=True)]

    def count_block(self, texts: list[str]) -> list[int]:
        split = [segments(t) if t and SPACE_MARK not in t and self.by_segments else [] for t in texts]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        table, young, old = self.table, self.young, self.old
        fresh = []
        for s in {s for ss in split for s in ss}:
            if s not in table and s not in young:
                if s in old:
                    young[s] = old[s]
                else:
                    fresh.append(s)
        if fresh:
            young.update(zip(fresh, self.of(fresh), strict=True))
        get, more = table.get, young
        out = []
        for t, ss in zip(texts, split, strict=True):
            out.append(len(self.encode([t])[0]) if t and not ss else sum([n if (n := get(s)) is not None else more[s] for s in ss]))
        return out


def texts_of(data: np.ndarray, at: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def frequent_segments(docs: DataFrame, most: int = TABLE) -> list[str]:
    """The segments that stand most often in all texts, by bounded summaries of each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            data, at = column_bytes(batch.column(0))
            for text, offsets, _ in blocks(data, at):
                for t in texts_of(text, offsets):
                    if t and SPACE_MARK not in t:
                        seen.update(segments(t))
                if len(seen) > TASK_COUNTS:
                    seen = Counter(dict(seen.most_common(TASK_COUNTS // 4)))
        top = [(s, n) for s, n in seen.most_common(TASK_TOP) if n > 1 and len(s) < 64]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["segment", "n"])

    summed = docs.select("text").mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    return [r["segment"] for r in summed.orderBy(F.desc("n"), "segment").limit(most).collect()]


def counted(docs: DataFrame, file: str | None = None, keep: list[str] | None = None, table: int = TABLE, name: str = "tokens") -> DataFrame:
    """The columns ``keep`` of docs (all but text, if none are named) with the struct column ``name``: n_bytes and n_tokens
    of the whole text. A column of docs that has this name is replaced."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", name)]
    with open(file or vocabulary_file(), "rb") as f:
        model = f.read()
    listed = frequent_segments(docs, table)
    lengths = np.array(Lengths(model).of(listed) if listed else [], np.uint16)
    key = ("token counts", uuid.uuid4().hex)
    shared = spark.sparkContext.broadcast((model, listed, lengths))  # at most ``table`` segments under 64 characters
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, listed, lengths = shared.value
        worker = worker_state(key, lambda: Lengths(model, dict(zip(listed, lengths.tolist(), strict=True))))
        with no_cycles():
            for batch in batches:
                data, at = column_bytes(batch.column(len(keep)))
                for text, offsets, row in blocks(data, at):
                    n = worker.count_block(texts_of(text, offsets))
                    both = pa.StructArray.from_arrays([pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64())], names=["n_bytes", "n_tokens"])
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(row, len(n)) for i in range(len(keep))], both], names=[*keep, name])

    made = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(name, made)]))


def op9(spark, sf_dir: str) -> DataFrame:
    rows = counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return rows.select("doc_id", "tokens.*").withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)
