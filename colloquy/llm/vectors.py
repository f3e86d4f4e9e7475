"""Vector code compression: product quantisation in whole numbers, the same on any partitioning.

Components become integers and vectors are cut into parts; each part has a codebook that rounds of
nearest entry and mean refine. Distances must be exact, as ties go to the lower index, yet the work
is a matrix product: integers are broken into limbs so small that BLAS sums of their products, in
float64, stay below 2 ** 53 and so are exact; the limbs' products are put together in int64, and the
first least distance wins.

A round reads the vectors once. A task adds up, in Python's or numpy's integers, each entry's parts
and sends one row for each entry that it used; Spark sums these, so what meets is bounded by
tasks times entries, and the driver gets the codebooks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import pick, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are cut to this, so that scaled ones are whole numbers of 64 bits.
MOST = 2.0**50
#: Vectors whose distances to all entries are held at once.
BLOCK = 1 << 11
#: Greatest sums that int64 may reach.
_SAFE = 1 << 62


def scaled(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64; the product is exact for a scale that is a power of two."""
    return np.floor(np.clip(flat.astype(np.float64), -MOST, MOST) * scale).astype(np.int64)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays a, b .. with x = a + b * 2 ** bits + ..; each holds whole numbers of at most `bits` bits."""
    sign, rest, out = np.sign(x), np.abs(x), []
    while True:
        out.append((sign * (rest & ((1 << bits) - 1))).astype(np.float64))
        rest = rest >> bits
        if not rest.any():
            return out


def exact_dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T in int64 by float64 matrix products; the true sums must fit into 62 bits."""
    # products of two limbs, summed over the components, stay below 2 ** 53
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, list | np.ndarray]:
    """The first nearest entry of each row, and the squared distance to it."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    if 4 * top * top * x.shape[1] < _SAFE:
        size = (codebook * codebook).sum(axis=1)
        far = size - 2 * exact_dots(x, codebook)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(x)), best] + (x * x).sum(axis=1)
    # Integers too large for 64-bit distances: the same in Python's integers.
    wide, entries = x.astype(object), codebook.astype(object)
    far = np.stack([((wide - entry) ** 2).sum(axis=1) for entry in entries], axis=1) if len(x) else np.zeros((0, len(codebook)), object)
    best = np.array([min(range(len(row)), key=row.__getitem__) for row in far.tolist()], np.int64)
    return best, [row[k] for row, k in zip(far.tolist(), best.tolist())]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("vector")
    lengths = np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths != dim).any():
        raise ValueError("vectors of other lengths")
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _blocks(batches, dim: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part, dim)


def integer_vectors(vectors: DataFrame, scale: int = SCALE, columns: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the given columns and vector (array<long>) of the rows whose embedding is usable; stored."""
    rows = pick(vectors, "vec_id", "embedding", *columns)
    element = F.lit(float("inf"))
    usable = F.col("embedding").isNotNull() & F.forall(F.col("embedding"), lambda x: F.coalesce((x > -element) & (x < element), F.lit(False)))
    kept = rows.where(usable)
    others = [f for f in kept.schema if f.name != "embedding"]
    names = [f.name for f in others]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in others), ("vector", pa.list_(pa.int64()))])

    def scan(batches):
        for batch in batches:
            column = batch.column("embedding")
            ends = np.asarray(column.offsets)
            ints = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32), pa.int32()), pa.array(scaled(np.asarray(column.flatten()), scale)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), ints], schema=schema)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "vector array<long>"])
    return stored(kept.mapInArrow(scan, ddl))


def _first(rows: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the smallest ids; a bounded number of rows."""
    return [r["vector"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()]


def _sums(books, parts: int, dim: int):
    """(part, entry, n, sums) for each entry that a task's vectors use; sums are decimal text, which no size overflows."""
    width = dim // parts

    def scan(batches):
        own = books.value
        counts = [np.zeros(len(b), np.int64) for b in own]
        sums = [np.zeros((len(b), width), object) for b in own]
        for _, x in _blocks(batches, dim):
            for p in range(parts):
                piece = x[:, p * width : (p + 1) * width]
                best = nearest(piece, own[p])[0]
                counts[p] += np.bincount(best, minlength=len(own[p]))
                order = np.argsort(best, kind="stable")
                used, at = np.unique(best[order], return_index=True)
                if len(used):
                    fits = int(np.abs(piece).max()) * len(piece) < _SAFE
                    sums[p][used] += np.add.reduceat(piece[order] if fits else piece[order].astype(object), at, axis=0).astype(object)
        for p in range(parts):
            at = np.flatnonzero(counts[p])
            n = len(at)
            texts = [[str(v) for v in row] for row in sums[p][at].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[p][at]), pa.array(texts, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return scan


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after the rounds; rows as integer_vectors gives them, all vectors of one length.

    Each begins as the parts of the vectors of the smallest ids; a null id comes last, equal ids by vector. An entry
    without a part stays as it is.
    """
    first = _first(rows, entries)
    if not first:
        return []
    dim = len(first[0])
    if dim % parts or not dim:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    width, start = dim // parts, np.array(first, np.int64)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)
        made = rows.select("vector").mapInArrow(_sums(sent, parts, dim), "part int, entry int, n long, sums array<string>")
        flat = made.select("part", "entry", "n", F.posexplode("sums").alias("at", "v"))
        found = flat.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        for r in found:
            books[r["part"]][r["entry"], r["at"]] = int(r["v"]) // r["n"]
        sent.destroy()
    return books


def _codes(books, parts: int, dim: int, names: list[str], schema: pa.Schema):
    width = dim // parts

    def scan(batches):
        own = books.value
        for part, x in _blocks(batches, dim):
            code, error = np.zeros((len(x), parts), np.int64), [0] * len(x)
            for p in range(parts):
                code[:, p], d = nearest(x[:, p * width : (p + 1) * width], own[p])
                error = [a + b for a, b in zip(error, d.tolist() if isinstance(d, np.ndarray) else d)]
            texts = ["".join(f"{k:02x}" for k in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([min(e, (1 << 63) - 1) for e in error], pa.int64())], schema=schema)

    return scan


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of vectors (vec_id, embedding, label).

    Rows whose embedding is null or holds a null or a component that isn't finite are dropped. code has two hex digits
    a part, error is the squared distance to the entries, label_error its sum over equal labels, nulls together. Fewer
    usable rows than entries make smaller codebooks; repeated rows get equal codes; an empty table gives no row; other
    columns are not read. Components beyond MOST count as MOST; sums of squares stop at the greatest
    64-bit number. All usable vectors must be of one length, which parts divides: anything else is an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    rows = integer_vectors(vectors, scale, ("label",))
    books = codebooks(rows, parts, entries, rounds)
    kinds = {f.name: f.dataType for f in rows.schema}
    ddl = f"vec_id {kinds['vec_id'].simpleString()}, label {kinds['label'].simpleString()}, code string, error long"
    schema = pa.schema([(c, to_arrow_type(kinds[c])) for c in ("vec_id", "label")] + [("code", pa.string()), ("error", pa.int64())])
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    dim = books[0].shape[1] * parts if books else 0
    sent = rows.sparkSession.sparkContext.broadcast(books)
    coded = stored(rows.mapInArrow(_codes(sent, parts, dim, ["vec_id", "label"], schema), ddl))
    sent.destroy()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "own label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("own label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
