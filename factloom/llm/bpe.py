"""BPE encoding and decoding by content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a space or line feed says so, so that equal passages give equal
chunks wherever they stand. A worker encodes each chunk that its cache does not hold and reuses it until CHUNK_BYTES of later ones
have pushed it out; then it is encoded again. Cuts are far apart (CUT_EVERY), so a shared passage is reused only if two of
them fall into it, which is rare below some hundred words; the words of a chunk come from a word cache in the same way, and
words new to both are merged in one vectorised batch per block. At every join the words on both sides are encoded again by
the library, over a span that grows until it agrees with the pieces, else the whole text is encoded by the library. The
result equals the library's. Encoder.seen counts the bytes of all chunks and of those reused.

Nothing is shuffled. Sharing one encoding of a chunk among all workers would need the texts to be shuffled by chunk and
the ids back by document, more than this operator's disk budget, so workers share none.

Defined cases: a null or empty text has no ids and decodes to the empty text. Strings of special tokens inside a text are
read as the library reads them by default. Repeated rows give equal rows. A very long text is encoded whole, by its chunks.
Other columns pass through encoded() untouched, whatever their names, but for one named as the struct column that the
caller chooses. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.textvec import blocks, column_bytes, mix64, no_cycles, worker_state

#: A cut at one in so many spaces; words, and bytes of chunks, that a worker keeps.
CUT_EVERY, WORD_CACHE, CHUNK_BYTES = 192, 120_000, 16 << 20
#: Characters whose normalisation and classes this module knows by itself; all other words go to the library.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merging of many words at once: each step joins, in every word, its leftmost pair of the lowest rank."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.uint64)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.slots = np.full(1 << 20, -1, np.int64)
        self.rank = np.full(1 << 20, self.NONE, np.int32)
        self.probes = 1
        for r, (k, at) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            n = 1
            while self.slots[at] >= 0:
                at, n = (at + 1) & 0xFFFFF, n + 1
            self.slots[at], self.rank[at], self.probes = k, r, max(self.probes, n)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = self._slot(key.view(np.uint64))
        out = np.full(key.shape, self.NONE, np.int32)
        for _ in range(self.probes):
            hit = self.slots[at] == key
            out[hit] = self.rank[at[hit]]
            at = (at + 1) & 0xFFFFF
        return out

    def encode(self, words: list[bytes], names: list[str]) -> list[tuple[bytes, str]]:
        """Token ids of each word (not empty) as little-endian bytes, and its tokens' names."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, which in by_size.items():
            raw = np.frombuffer(b"".join(words[i] for i in which), np.uint8).reshape(-1, size)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            row = np.array(which)
            rank = self.ranks(ids[:, :-1], ids[:, 1:]) if size > 1 else np.zeros((len(row), 0), np.int32)
            while True:
                open_ = rank.min(axis=1) < self.NONE if rank.shape[1] else np.zeros(len(row), bool)
                done = ids[~open_].astype("<u4")
                flat, step = done.tobytes(), 4 * done.shape[1]
                for k, (i, x) in enumerate(zip(row[~open_].tolist(), done.tolist(), strict=True)):
                    out[i] = (flat[k * step : (k + 1) * step], names[x[0]] if len(x) == 1 else " ".join([names[t] for t in x]))
                if not open_.any():
                    break
                ids, rank, row = ids[open_], rank[open_], row[open_]
                at = rank.argmin(axis=1)
                lines, width = np.arange(len(row)), ids.shape[1]
                ids[lines, at] = self.result[rank[lines, at]]
                keep = np.ones(ids.shape, bool)
                keep[lines, at + 1] = False
                ids = ids[keep].reshape(len(row), width - 1)
                keep = np.ones(rank.shape, bool)
                keep[lines, at] = False
                rank = rank[keep].reshape(len(row), width - 2)
                has = at > 0
                rank[lines[has], at[has] - 1] = self.ranks(ids[lines[has], at[has] - 1], ids[lines[has], at[has]])
                has = at < width - 2
                rank[lines[has], at[has]] = self.ranks(ids[lines[has], at[has]], ids[lines[has], at[has] + 1])
        return out


class Encoder:
    """A worker's tokenizer with its caches. Words and chunks map to (ids as little-endian bytes, decoded text)."""

    def __init__(self, source: str, words: int = WORD_CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(source)["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in json.loads(source)["added_tokens"]) or r"(?!)")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.names = [self.library.id_to_token(i) for i in range(size)]
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.chunks: OrderedDict[bytes, tuple[bytes, str]] = OrderedDict()
        self.held, self.most = 0, words
        self.seen = [0, 0]

    def _pair(self, ids) -> tuple[bytes, str]:
        return np.asarray(ids, "<u4").tobytes(), " ".join(map(self.names.__getitem__, ids))

    def by_library(self, texts: list[str]) -> list[tuple[bytes, str]]:
        return [self._pair(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Makes sure that all words are in the cache."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        fresh, strange = [], []
        for w in words:
            if w not in young:
                if (known := old.get(w)) is not None:
                    young[w] = known
                elif not _PLAIN.match(w) or self.special.search(w):
                    strange.append(w)
                else:
                    fresh.append(w)
        parts = [_PRETOKEN.findall(w.lower()) for w in fresh]
        new = list({p for ps in parts for p in ps})
        pairs = dict(zip(new, self.merges.encode([p.encode() for p in new], self.names), strict=True))
        for w, ps in zip(fresh, parts, strict=True):
            young[w] = pairs[ps[0]] if len(ps) == 1 else self.join([pairs[p] for p in ps])
        if strange:
            young.update(zip(strange, self.by_library(strange), strict=True))

    def join(self, parts: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[0]])

    def encode_block(self, data: np.ndarray, at: np.ndarray) -> list[tuple[bytes, str]]:
        """(ids, decoded) of each text of a block."""
        raw = data.tobytes()
        cuts = chunk_cuts(data, at)
        texts = [[raw[a:b] for a, b in zip(c, c[1:], strict=False)] for c in cuts]
        words: dict[bytes, list[str]] = {}
        for chunk in (c for t in texts for c in t):
            self.seen[0] += len(chunk)
            if chunk in words:
                self.seen[1] += len(chunk)
            elif chunk in self.chunks:
                self.seen[1] += len(chunk)
                self.chunks.move_to_end(chunk)
            else:
                words[chunk] = split_words(chunk.decode())
        self.learn({w for ws in words.values() for w in ws})
        found = {c: self.join([self.young[w] for w in ws]) for c, ws in words.items()}
        out = [self.join([found[c] if c in found else self.chunks[c] for c in t]) for t in texts]
        for i in self.disagreeing(texts):
            out[i] = self.by_library([raw[at[i] : at[i + 1]].decode()])[0]
        self.chunks.update(found)
        self.held += sum(len(c) + len(m[0]) + len(m[1]) for c, m in found.items())
        while self.held > CHUNK_BYTES:
            c, m = self.chunks.popitem(last=False)
            self.held -= len(c) + len(m[0]) + len(m[1])
        return out

    def disagreeing(self, texts: list[list[bytes]]) -> set[int]:
        """Texts with a join where the library, over words of both sides, does not give the pieces' ids."""
        open_ = [(i, j) for i, t in enumerate(texts) for j in range(1, len(t))]
        for span in (1, 4, 16):
            sides = [(split_words(texts[i][j - 1].decode())[-span:], split_words(texts[i][j].decode())[:span]) for i, j in open_]
            self.learn({w for s in sides for ws in s for w in ws})
            whole = self.by_library([" ".join([*a, *b]) for a, b in sides])
            open_ = [x for x, (a, b), w in zip(open_, sides, whole, strict=True) if w[0] != self.join([self.young[k] for k in (*a, *b)])[0]]
            if not open_:
                break
        return {i for i, _ in open_}


def split_words(text: str) -> list[str]:
    """Runs between spaces and line feeds, over which neither normalisation nor merging reaches."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


def chunk_cuts(data: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Offsets of the chunks of each text: its ends, and the spaces that follow eight bytes with a hash of 0 mod CUT_EVERY."""
    spaces = np.flatnonzero((data == 32) | (data == 10))
    spaces = spaces[spaces >= 8]
    window = np.zeros(len(spaces), np.uint64)
    for j in range(8):
        window |= data[spaces - 8 + j].astype(np.uint64) << np.uint64(8 * j)
    spaces = spaces[mix64(window) % np.uint64(CUT_EVERY) == 0]
    first, last = np.searchsorted(spaces, at[:-1], side="right"), np.searchsorted(spaces, at[1:], side="left")
    return [[int(a), *spaces[f:e].tolist(), int(b)] if b > a else [int(a)] for a, b, f, e in zip(at[:-1], at[1:], first, last, strict=True)]


def encoded(docs: DataFrame, file: str | None = None, keep: list[str] | None = None, name: str = "bpe", words: int = WORD_CACHE) -> DataFrame:
    """The columns ``keep`` of docs (all but text, if none are named) with the struct column ``name``: ids (unsigned 32-bit
    integers, little-endian) and decoded. A column of docs that has this name is replaced. ``words`` bounds
    a worker's word cache: fewer take less memory and more time, and change no result."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", name)]
    with open(file or vocabulary_file(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the corpus
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(source, words)
        with no_cycles():
            for batch in batches:
                data, at = column_bytes(batch.column(len(keep)))
                for text, offsets, row in blocks(data, at):
                    made = encoder.encode_block(text, offsets)
                    parts = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())]
                    both = pa.StructArray.from_arrays(parts, names=["ids", "decoded"])
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(row, len(made)) for i in range(len(keep))], both], names=[*keep, name])

    made = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(name, made)]))


def worker_encoder(source, words: int) -> Encoder:
    """The encoder of this worker process, made once."""
    text = source.value
    return worker_state(("bpe", hash(text), words), lambda: Encoder(text, words))


def digests(rows: DataFrame, name: str = "bpe") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded()'s rows."""
    ids, decoded = F.col(f"`{name}`.ids"), F.col(f"`{name}`.decoded").cast("binary")
    n = (F.octet_length(ids) / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op5(spark, sf_dir: str) -> DataFrame:
    return digests(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]))
