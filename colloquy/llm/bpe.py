"""BPE encoding and decoding by tree concatenation.

A long text is halved again and again; the leaves are encoded, and neighbours are
joined again from the bottom up. At a join a window of tokens, one on each side at first, is
encoded anew and grows twofold until its first and last token are those that both sides
hold already. That is exact inside a run of one class of characters, which the vocabulary's
pattern never splits: tokens t1 .. tn are the encoding of a run if and only if each two
neighbours are the encoding of their own text, and after agreement each two neighbours
stand together in the left half, in the window or in the right half. Elsewhere a text is only
halved before a space that follows a visible character, where the pattern always splits.

The parts of texts of more than PART characters are rows that Spark deals out, so halves are encoded
in parallel; each such text is then put together by the same joins. Below that a text's tree
is built and joined in the task that holds it, down to leaves of LEAF characters.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import pick, stored, worker_cache

#: Characters of a leaf, which is encoded as it is.
LEAF = 2048
#: Texts of more characters are cut into parts of up to this many, and each part is a row.
PART = 1 << 16
BATCH_CHARS = 1 << 19


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Codec:
    """A byte-level BPE vocabulary of the tokenizers library, and the pattern that splits texts."""

    def __init__(self, vocabulary_file: str, pattern: str):
        import tiktoken

        with open(vocabulary_file, encoding="utf-8") as file:
            stored_ = json.load(file)
        letters, vocabulary = byte_letters(), stored_["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items()}
        # ids must follow the order of merges, so that they serve as ranks
        for i, merge in enumerate(stored_["model"]["merges"]):
            if vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))] != 256 + i:
                raise ValueError("ids do not follow the order of merges")
        (added,) = stored_["added_tokens"]
        self.special, self.special_id = added["content"], added["id"]
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max([*ranks.values(), self.special_id]) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        pieces[self.special_id] = self.special.encode()
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def leaves(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(t), np.uint32) for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens; those of a text's own ids are its UTF-8."""
        size = self.size[ids]
        total = int(size.sum())
        index = np.arange(total) - np.repeat(np.cumsum(size) - size - self.start[ids], size)
        return self.bytes[index].tobytes()


def _class(c: str) -> str:
    """Letter, number, white space or other, where all versions of Unicode agree; else nothing."""
    if c in " \t\n\r\v\f":
        return "Z"
    if c.isspace() or c in "\x1c\x1d\x1e\x1f\x85":
        return ""
    kind = unicodedata.category(c)
    if kind == "Cn":
        return ""
    return kind[0] if kind[0] in "LN" else "P"


def _place(text: str, at: int, begin: int, end: int, most: int) -> tuple[int, str]:
    """A place near `at` to halve text[begin:end], and its class; -1 if there is none.

    A class means a place in a run, four characters of that class around it; no class
    means a place where the pattern splits whatever stands around.
    """
    for k in range(at, min(end - 2, at + most // 4)):
        a, b = _class(text[k - 1]), _class(text[k])
        if a and a == b and a == _class(text[k + 1]) and k >= begin + 2 and a == _class(text[k - 2]):
            return k, a
        if text[k] == " " and a in ("L", "N", "P") and (a != "P" or "!" <= text[k - 1] <= "~"):
            return k, ""
    return -1, ""


class _Piece:
    """A part of a text: a leaf, or two parts that meet at a place of a class."""

    def __init__(self, text: str, begin: int, end: int, leaves: list, most: int):
        at, self.kind = (begin + end) // 2, ""
        if end - begin > most:
            at, self.kind = _place(text, at, begin, end, most)
        else:
            at = -1
        self.text, self.begin, self.end, self.at = text, begin, end, at
        if at < 0:
            self.leaf = len(leaves)
            leaves.append(text[begin:end])
        else:
            self.left, self.right = _Piece(text, begin, at, leaves, most), _Piece(text, at, end, leaves, most)

    def ids(self, done: list[np.ndarray], codec: Codec) -> np.ndarray:
        if self.at < 0:
            return done[self.leaf]
        left, right = self.left.ids(done, codec), self.right.ids(done, codec)
        return np.concatenate((left, right)) if not self.kind else self.join(left, right, codec)

    def join(self, left: np.ndarray, right: np.ndarray, codec: Codec) -> np.ndarray:
        """Both sides' tokens, with a window around the place encoded anew until both sides agree."""
        before, after = self.run()
        if before < 0:  # the run's ends aren't certain
            return codec.leaves([self.text[self.begin : self.end]])[0]
        most_left = int(np.searchsorted(np.cumsum(codec.size[left[::-1][: before + 1]]), before, "right"))
        most_right = int(np.searchsorted(np.cumsum(codec.size[right[: after + 1]]), after, "right"))
        k = 1
        while True:
            a, b = min(k, most_left), min(k, most_right)
            raw = codec.decode(left[len(left) - a :]) + codec.decode(right[:b])
            window = np.array(codec.encoding._encode_single_piece(raw) if raw else [], np.uint32)
            # Nothing stands across the run's own ends, so agreement is only needed before them.
            agree_left = a == most_left or window[0] == left[len(left) - a]
            agree_right = b == most_right or window[-1] == right[b - 1]
            if agree_left and agree_right:
                return np.concatenate((left[: len(left) - a], window, right[b:]))
            k *= 2

    def run(self) -> tuple[int, int]:
        """Bytes on both sides of the place that the pattern keeps in one piece, or -1 if that isn't certain."""
        text, i, j = self.text, self.at, self.at
        while i > self.begin and _class(text[i - 1]) == self.kind:
            i -= 1
        while j < self.end and _class(text[j]) == self.kind:
            j += 1
        if (i > self.begin and not _class(text[i - 1])) or (j < self.end and not _class(text[j])):
            return -1, -1
        if self.kind == "Z":
            j -= j < self.end  # the last white space before a visible character stands apart
        elif i > self.begin and text[i - 1] == " ":
            i -= 1
        return len(text[i : self.at].encode()), len(text[self.at : j].encode())


class Tree:
    """A text, halved into leaves of up to `most` characters; the special token's string is one token, as the tokenizers library has it."""

    def __init__(self, text: str, codec: Codec, leaves: list[str], most: int):
        self.parts = [_Piece(part, 0, len(part), leaves, most) for part in text.split(codec.special)]

    def ids(self, done: list[np.ndarray], codec: Codec) -> np.ndarray:
        out = []
        for k, part in enumerate(self.parts):
            if k:
                out.append(np.array([codec.special_id], np.uint32))
            out.append(part.ids(done, codec))
        return np.concatenate(out)


def encode(texts: list[str], codec: Codec) -> list[np.ndarray]:
    """Token ids of each text."""
    leaves: list[str] = []
    trees = [Tree(text, codec, leaves, LEAF) for text in texts]
    done = codec.leaves(leaves)
    return [tree.ids(done, codec) for tree in trees]


def codec_for(vocabulary_file: str, pattern: str) -> Codec:
    cache = worker_cache()
    if (vocabulary_file, pattern) not in cache:
        cache[vocabulary_file, pattern] = Codec(vocabulary_file, pattern)
    return cache[vocabulary_file, pattern]


def _batched(batch: pa.RecordBatch):
    """(first row, texts) of stretches of rows that hold about BATCH_CHARS characters."""
    at = 0
    while at < batch.num_rows:
        texts, chars = [], 0
        while at + len(texts) < batch.num_rows and chars < BATCH_CHARS:
            texts.append(batch.column("text")[at + len(texts)].as_py() or "")
            chars += len(texts[-1])
        yield at, texts
        at += len(texts)


def encode_documents(docs: DataFrame, vocabulary_file: str, pattern: str, digests: bool = True, columns: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """doc_id, the given columns, n_tokens and ids_sha256, decoded_sha256; with digests=False the ids themselves.

    A null or empty text has no token. Equal texts give equal rows; an empty table gives no
    row; other columns are not read. A text of more than `part` characters is encoded in parts by
    many tasks, and one task holds it whole when its parts are joined.
    """
    own = [f"own column {i}" for i in range(len(columns))]
    rows = pick(docs, "doc_id", "text", *columns).toDF("doc_id", "text", *own)
    kept = [rows.schema[c] for c in ("doc_id", *own)]
    more = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32()))]
    ddl = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    given = [f.name for f in kept]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in kept), ("n_tokens", pa.int64()), *more])
    joined_schema = pa.schema([("key", pa.binary()), ("n_tokens", pa.int64()), *more])

    def results(ids: list[np.ndarray], codec: Codec) -> list[pa.Array]:
        out = [pa.array([len(x) for x in ids], pa.int64())]
        if not digests:
            return [*out, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
        hashed = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        return [*out, pa.array(hashed, pa.string()), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())]

    def scan(batches):
        codec = codec_for(vocabulary_file, pattern)
        for batch in batches:
            for at, texts in _batched(batch):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in given), *results(encode(texts, codec), codec)], schema=schema)

    def cut(batches):
        codec = codec_for(vocabulary_file, pattern)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                leaves: list[str] = []
                Tree(text.as_py(), codec, leaves, part)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(leaves), pa.binary()), pa.array(np.arange(len(leaves))), pa.array(leaves, pa.string())], names=["key", "part", "text"])

    def encode_parts(batches):
        codec = codec_for(vocabulary_file, pattern)
        for batch in batches:
            for at, texts in _batched(batch):
                ids = pa.array([x.astype("<u4").tobytes() for x in encode(texts, codec)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(texts)), batch.column("part").slice(at, len(texts)), ids], names=["key", "part", "ids"])

    def join_parts(text: pa.Table, parts: pa.Table) -> pa.Table:
        if not text.num_rows:
            return joined_schema.empty_table()
        codec = codec_for(vocabulary_file, pattern)
        tree = Tree(text.column("text")[0].as_py(), codec, [], part)
        done = [np.frombuffer(raw, "<u4") for _, raw in sorted(zip(parts.column("part").to_pylist(), parts.column("ids").to_pylist()))]
        return pa.Table.from_arrays([text.column("key"), *results([tree.ids(done, codec)], codec)], schema=joined_schema)

    is_long = F.coalesce(F.length("text") > part, F.lit(False))
    short = rows.where(~is_long).mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {ddl}")
    long = rows.where(is_long).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = stored(long.groupBy("key").agg(F.first("text").alias("text")))
    encoded = texts.mapInArrow(cut, "key binary, part long, text string").repartition("key", "part").mapInArrow(encode_parts, "key binary, part long, ids binary")
    joined = texts.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(join_parts, f"key binary, {ddl}")
    return short.unionByName(long.drop("text").join(joined, "key").drop("key")).toDF("doc_id", *columns, *[f.name for f in schema][len(given) :])
