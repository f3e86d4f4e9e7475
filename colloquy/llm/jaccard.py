"""N-gram Jaccard join by vertical partitioning.

Documents become sets of hashed word n-grams; equal sets are one member with its copies.
All n-grams have one global order, rare ones first: by the level that a sketch gives their
frequency, then by hash. Two sets of enough similarity share an n-gram of their prefixes
in that order, at places early enough; only such pairs are looked at. The order is cut into
fragments, the overlap of a pair is counted in each fragment apart, and the counts are
summed per pair.

No list of members that share an n-gram is expanded into all its pairs. First each list's
members are compared with its hub, the member whose prefix is most shared. Lists whose
members are then in one component are done; in the others, members outside the hub's
component are compared with those of other components. So no link between different
components is lost, and components are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import sketch
from .components import connected
from .shared import STEP_BYTES, lanes, mix, pick, plain, steps, stored, utf8
from .substring import _pieces, words_of

NGRAM = 5
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Fragments of the global order: each level of frequency in so many ranges of hashes.
RANGES = 4
FRAGMENTS = 3 * RANGES


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; bytes of other characters stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _grams(data, starts, ends, size: int):
    """Hashes of the n-grams of some rows, their rows, the rows' numbers of words and the words' hashes."""
    values, first, last = words_of(data, starts, ends)
    one, n = values(0), last - first
    windows = lanes()[0].windows(one, size)
    row = np.repeat(np.arange(len(starts)), n)
    full = (np.repeat(last, n) - np.arange(len(one)))[: len(windows)] >= size
    return windows[full], row[: len(windows)][full], first, n, one


def shingles(batches, size: int):
    """(row keys' slice, hashes, row of each): the distinct n-grams of each row, ordered by row and hash."""
    for batch in batches:
        data, starts, ends = utf8(batch.column("text"))
        for i, j in steps(starts, ends):
            low = starts[i]
            part = _lower(data[low : ends[j - 1]])
            pieces = _pieces(size)(part, STEP_BYTES) if j == i + 1 and len(part) > STEP_BYTES else []
            if len(pieces) > 1:  # one long text, in pieces that overlap by an n-gram less one word
                h = np.concatenate([_grams(part[a:b], np.array([0]), np.array([b - a]), size)[0] for _, a, b in pieces])
                h = np.unique(h)
                yield batch.slice(i, 1), h, np.zeros(len(h), np.int64)
                continue
            h, r, first, n, one = _grams(part, starts[i:j] - low, ends[i:j] - low, size)
            # fewer words than an n-gram has: all of them are one
            few, short = [np.flatnonzero(n == k) for k in range(1, size)], []
            for k, at in enumerate(few, 1):
                short.append(mix(lanes()[0].windows(one, k)[first[at]] ^ np.uint64(k)) if len(at) else h[:0])
            h, r = np.concatenate([h, *short]), np.concatenate([r, *few]).astype(np.int64)
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][: len(h)]
            yield batch.slice(i, j - i), h[new], r[new]


def _keys(size: int):
    def keys_of(batches):
        for _, h, _ in shingles(batches, size):
            yield h

    return keys_of


def _members(size: int, percent: int, sent, columns: list[str], schema: pa.Schema):
    """A row for each document: its set's name and size, and where a partner is possible its prefix and its n-grams by fragment."""

    def scan(batches):
        levels, sent_sets = sketch.Levels(sent), set()
        for part, h, r in shingles(batches, size):
            n_rows = part.num_rows
            level = levels.of(h)
            bounds = np.searchsorted(r, np.arange(n_rows + 1))
            names, prefixes, places, fragments = [], [], [], []
            alone = np.r_[0, np.cumsum(level == 0)]
            for k in range(n_rows):
                a, b = bounds[k], bounds[k + 1]
                own, n = h[a:b], int(b - a)
                name = _name(own) if n else None
                names.append(name)
                prefix = n - -(-percent * n // 100) + 1
                rare = int(alone[b] - alone[a])
                if not n or rare >= prefix or name in sent_sets:
                    prefixes.append(None), places.append(None), fragments.append(None)
                    continue
                sent_sets.add(name)
                order = np.lexsort((own, level[a:b]))
                prefixes.append(own[order[rare:prefix]].astype(np.int64).tolist())
                places.append(rare)
                shared = own[order[rare:]]
                cut = np.searchsorted((level[a:b][order[rare:]] - 1).astype(np.int64) * RANGES + (shared >> np.uint64(62)).astype(np.int64), np.arange(FRAGMENTS + 1))
                shared = shared.astype(np.int64)
                fragments.append([shared[x:y].tolist() for x, y in zip(cut[:-1], cut[1:])])
            size_of = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(size_of, pa.int64()), pa.array(names, pa.binary()), pa.array(places, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(fragments, pa.list_(pa.list_(pa.int64())))], schema=schema)

    return scan


def _name(hashes: np.ndarray) -> bytes:
    """128 bits that name a set of hashes in order."""
    return hashlib.md5(hashes.tobytes()).digest()


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of n and m: 100 * o >= percent * (n + m - o)."""
    return F.ceil((F.lit(percent) * (n + m)) / F.lit(100 + percent))


def _may_link(percent: int) -> Column:
    """Whether the n-gram at place i of one and j of the other leaves room for the overlap that a link needs."""
    return F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) >= _needed(F.col("n"), F.col("m"), percent)


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n, m) whose overlap, summed over fragments, is enough."""
    left = parts.select(F.col("name").alias("a"), F.col("fragment"), F.col("grams").alias("x"))
    right = parts.select(F.col("name").alias("b"), F.col("fragment"), F.col("grams").alias("y"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("o"))
    return counted.groupBy("a", "b", "n", "m").agg(F.sum("o").alias("o")).where(F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("n") + F.col("m") - F.col("o"))).select("a", "b")


def jaccard_groups(docs: DataFrame, size: int = NGRAM, percent: int = PERCENT, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), component and the given columns.

    component names the component by one of its sets, also where ids are null or repeated. A
    null text, or one without words, has no n-gram and links with nothing; its component is
    itself and its name null. Equal sets link, however many there are. Rows alike are in one
    component. A null doc_id is passed over when the smallest is taken. An empty table
    gives no row; other columns are not read. A very long text is hashed in pieces; a task
    holds one text's set at a time.
    """
    own = [f"own column {i}" for i in range(len(columns))]
    rows = pick(docs, "doc_id", "text", *columns).toDF("doc_id", "text", *own)
    kept = rows.drop("text").schema
    sent = sketch.build(rows.select("text"), _keys(size), sketch.total_bytes(rows) // 6 * 2, depth=1, most=28)
    made = [("n", pa.int64()), ("name", pa.binary()), ("at", pa.int32()), ("prefix", pa.list_(pa.int64())), ("fragments", pa.list_(pa.list_(pa.int64())))]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in kept), *made])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    members = stored(rows.mapInArrow(_members(size, percent, sent, kept.names, schema), f"{ddl}, n long, name binary, at int, prefix array<long>, fragments array<array<long>>"))
    sent.destroy()
    found = members.where("prefix is not null")
    lists = stored(found.select("name", "n", "at", F.posexplode("prefix").alias("k", "gram")).select("name", "n", (F.col("at") + F.col("k")).alias("at"), "gram").distinct())
    hubs = lists.groupBy("gram").agg(F.max(F.struct((F.col("n") - F.col("at")) / F.col("n"), F.col("n"), F.col("name"), F.col("at"))).alias("hub"), F.count("*").alias("members")).where("members > 1")
    hubs = stored(hubs.select("gram", F.col("hub.name").alias("b"), F.col("hub.n").alias("m"), F.col("hub.at").alias("bt")))
    shared = stored(lists.join(hubs, "gram"))
    parts = found.select("name", F.posexplode("fragments").alias("fragment", "grams")).where(F.size("grams") > 0)
    tested = shared.where((F.col("name") != F.col("b")) & _may_link(percent)).select(F.least("name", "b").alias("a"), F.greatest("name", "b").alias("b"), F.when(F.col("name") < F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n"), F.when(F.col("name") < F.col("b"), F.col("m")).otherwise(F.col("n")).alias("m")).distinct()
    wanted = tested.select(F.col("a").alias("name")).union(tested.select("b")).distinct()
    used = stored(parts.join(wanted, "name", "left_semi").dropDuplicates(["name", "fragment"]))
    links = stored(linked(tested, used, percent))
    roots = connected(links)
    # Members whose hub is in another component, against the other components of their list.
    rooted = shared.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    of_hub = roots.select(F.col("node").alias("b"), F.col("root").alias("hub_root"))
    rooted = stored(rooted.join(of_hub, "b", "left").withColumn("hub_root", F.coalesce("hub_root", "b")).select("gram", "name", "n", "at", "root", (F.col("root") != F.col("hub_root")).alias("outside")))
    split = rooted.where("outside").select("gram").distinct()
    here = rooted.join(split, "gram", "left_semi")
    other = here.select("gram", F.col("name").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("root").alias("other_root"), F.col("outside").alias("other_outside"))
    rest = here.where("outside").join(other, "gram").where((F.col("root") != F.col("other_root")) & (~F.col("other_outside") | (F.col("name") < F.col("b"))) & _may_link(percent))
    rest = stored(rest.select(F.least("name", "b").alias("a"), F.greatest("name", "b").alias("b"), F.when(F.col("name") < F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n"), F.when(F.col("name") < F.col("b"), F.col("m")).otherwise(F.col("n")).alias("m")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    if rest.limit(1).count():
        wanted = rest.select(F.col("a").alias("name")).union(rest.select("b")).distinct()
        used = stored(parts.join(wanted, "name", "left_semi").dropDuplicates(["name", "fragment"]))
        roots = connected(links.union(linked(rest, used, percent)))
    # Every set's smallest id, then every component's.
    least = members.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("least"))
    least = least.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = stored(least)
    # Stored, so that Spark can split a large component's sets over tasks when they join its row.
    of_root = stored(least.groupBy("root").agg(F.min("least").alias("component_id")))
    of_name = least.join(of_root, "root").select("name", "component_id", F.col("root").alias("component"))
    out = members.select(*kept.names, "n", "name").join(of_name, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "component", *(F.col(a).alias(b) for a, b in zip(own, columns)))


def one_of_each(docs: DataFrame, size: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least doc_id, then text, stays.

    All columns stay, whatever they are called. Rows without words, null texts too, stay, one for
    each doc_id and text; of rows alike in doc_id and text one stays; a null doc_id comes after all
    others. An empty table gives no row.
    """
    own = plain(docs, "doc_id", "text")
    keyed = own.withColumn("text key", F.md5(F.col("text").cast("binary")))
    groups = jaccard_groups(keyed, size, percent, ("text key",))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text key")
    first = groups.where("component is not null").groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.text key")
    wordless = groups.where("component is null").select("doc_id", "text key").distinct()
    stay = first.union(wordless).toDF("own id", "own key")
    found = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("own id")) & F.col("text key").eqNullSafe(F.col("own key")), "left_semi")
    nth = F.row_number().over(W.partitionBy("doc_id", "text key").orderBy("doc_id"))
    return found.withColumn("nth row", nth).where(F.col("nth row") == 1).select(*own.columns).toDF(*docs.columns)
