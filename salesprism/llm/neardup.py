"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word shingles (SHINGLE consecutive words, in lower case, runs of letters and digits; a shorter text
is one shingle). Equal texts form one node. Nodes whose MinHash values agree in a band are candidates. Within a bucket
MinHash values are compared in steps of STEP; after each, a pair is dropped once the posterior probability that its
similarity reaches the threshold, given the agreements so far and a uniform prior, is below TOLERANCE. A pair that
agrees in several bands belongs to the first of them, so it is looked at once. Only nodes with a surviving pair in a
bucket send their texts there, where those pairs are verified exactly on the shingle sets. Verified links count copies;
classes are the connected components of links.

BANDS bands of ROWS values miss a pair at the threshold with probability (1 - t**ROWS)**BANDS: 3e-6 at 0.8, less above.
Buckets above BLOCK are cut into blocks, pairs of which are compared in tasks of their own, so no task holds more than
two blocks; only counts and the edges of a spanning forest leave a task, never all pairs.

Defined results: null and empty texts, and texts without words, have no shingles: they link to nothing and are their
own class. Repeated rows are copies. A null id takes part like any other; the class id is the smallest id of the class
(null if it has none). Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesprism.llm.common import discard, map_slices, small, text_or_empty, written
from salesprism.llm.components import components

WORD = re.compile(r"[^\W_]+")
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-6
VALUES = BANDS * ROWS
#: Nodes of a bucket in one block; shingle columns in one matrix product; pairs whose bands are compared at once.
BLOCK, COLUMNS, PAIRS = 1024, 4096, 65_536
_RNG = np.random.default_rng(20240229)
_PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of shingle hashes; remembers the codes of a bounded number of words."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.codes = size, {}

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64)
        codes = self.codes
        if len(codes) > 500_000:
            codes.clear()
        try:
            w = np.array([codes[x] for x in words], np.uint64)
        except KeyError:
            for x in set(words):
                if x not in codes:
                    codes[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            w = np.array([codes[x] for x in words], np.uint64)
        k = min(self.size, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h + w[i : len(w) - k + 1 + i] * _PLACES[i]
        return np.unique(_mix(h))


def min_values(shingles: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[i : i + 4096, None] * _FACTORS).min(0), out)
    return out


def least_agreements(values: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest agreements among so many values at which the posterior of reaching the threshold is not below tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail above t is P(Binomial(n + 1, t) <= m).
    """
    below, n = 0.0, values + 1
    for m in range(values + 1):
        below += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if below >= tolerance:
            return m
    return values


LEAST = [(n, least_agreements(n)) for n in range(STEP, VALUES + 1, STEP)]


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of 16-bit MinHash values; equal keys in a band mean equal values, but for chance."""
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[r::ROWS].astype(np.uint64))
    return key


def surviving_pairs(a: np.ndarray, b: np.ndarray, same: bool, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (of a alone, i < j, if same) whose first common band this is and that the posterior doesn't rule out."""
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    both = a if same else np.concatenate([a, b])
    shared = (both[:, : band * ROWS] == both[:1, : band * ROWS]).all(0).reshape(band, ROWS).all(1) if len(both) else np.zeros(0, bool)
    if shared.any():  # all have an earlier band in common
        return left[0], right[0]
    for s in range(0, len(a), 256):
        part = a[s : s + 256]
        agree = np.zeros((len(part), len(b)), np.int16)
        for c in range(STEP):
            agree += part[:, c, None] == b[None, :, c]
        ok = agree >= LEAST[0][1]
        if same:
            ok &= np.arange(s, s + len(part))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(ok)
        seen = agree[i, j]
        for n, least in LEAST[1:]:
            seen = np.concatenate([np.empty(0, int), *[seen[k : k + PAIRS] + (part[i[k : k + PAIRS], n - STEP : n] == b[j[k : k + PAIRS], n - STEP : n]).sum(1) for k in range(0, len(i), PAIRS)]])
            keep = seen >= least
            i, j, seen = i[keep], j[keep], seen[keep]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            equal = (part[x, : (band + 1) * ROWS] == b[y, : (band + 1) * ROWS]).reshape(len(x), band + 1, ROWS).all(2)
            own = equal[:, band] & ~equal[:, :band].any(1)
            left.append(x[own] + s)
            right.append(y[own])
    return np.concatenate(left), np.concatenate(right)


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (i, j) of shingle sets reach the threshold; counted, not estimated."""
    sizes = np.array([len(s) for s in sets])
    if len(i) <= 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], int)
    else:
        used = np.unique(np.concatenate([i, j]))
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        values = np.concatenate([sets[x] for x in used])
        rows = np.repeat(np.arange(len(used)), sizes[used])
        _, column, times = np.unique(values, return_inverse=True, return_counts=True)
        common = times[column] > 1
        rows, column = rows[common], np.unique(column[common], return_inverse=True)[1]
        shared = np.zeros(len(i), int)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            low, high = np.searchsorted(column, [start, start + COLUMNS])
            m = np.zeros((len(used), COLUMNS), np.float32)
            m[rows[low:high], column[low:high] - start] = 1
            shared += np.rint((m @ m.T)[place[i], place[j]]).astype(int)
    return shared >= np.ceil(np.round(threshold * (sizes[i] + sizes[j] - shared), 9))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The smallest member of each row's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[dict[str, list]]:
    """Runs of rows with equal values in the first n_keys columns, over sorted batches."""
    held: dict[str, list] | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024).to_pydict()
            names = list(part)
            keys = list(zip(*[part[k] for k in names[:n_keys]], strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = {k: part[k][a:b] for k in names}
                if held and tuple(held[k][0] for k in names[:n_keys]) == keys[a]:
                    for k in names:
                        held[k] += own[k]
                else:
                    if held:
                        yield held
                    held = own
    if held:
        yield held


GROUP = ("band", "key", "low", "high")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of two blocks of a bucket together, the first block's before the second's."""
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "second", "tk")


def _by_blocks(df: DataFrame, size: Column, columns: list[str]) -> DataFrame:
    """Rows of buckets dealt to pairs of blocks (low, high) of their bucket; second says to which of the two a row belongs."""
    df = df.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int"))
    df = df.withColumn("own", F.pmod(F.xxhash64("tk", F.lit("block")), F.col("n_blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return _dealt(df.select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), *columns))


def _map_groups(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        out: dict[str, list] = {f.name: [] for f in arrow}
        for rows in _groups(batches, len(GROUP)):
            for k, v in fn(rows).items():
                out[k] += v
            if len(next(iter(out.values()))) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                out = {f.name: [] for f in arrow}
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def _split(rows: dict[str, list]) -> tuple[int, bool]:
    """(rows of the first block, whether both blocks are the same)."""
    return (len(rows["second"]) - sum(rows["second"]), rows["low"][0] == rows["high"][0])


def bucket_members(rows: dict[str, list]) -> dict[str, list]:
    """The rows of two blocks that have a pair to verify."""
    cut, same = _split(rows)
    values = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, VALUES)
    i, j = surviving_pairs(values, values, True, rows["band"][0]) if same else surviving_pairs(values[:cut], values[cut:], False, rows["band"][0])
    at = np.unique(np.concatenate([i, j if same else j + cut])).tolist()
    return {k: [rows[k][x] for x in at] for k in (*GROUP, "second", "tk")}


def bucket_links(rows: dict[str, list], shingler: Shingler, threshold: float) -> dict[str, list]:
    """Links of the rows of two blocks, verified, and the smallest row that each is connected with here."""
    cut, same = _split(rows)
    sets = [shingler(t) for t in rows["text"]]
    values = np.array([min_values(s).astype(np.uint16) for s in sets])
    i, j = surviving_pairs(values, values, True, rows["band"][0]) if same else surviving_pairs(values[:cut], values[cut:], False, rows["band"][0])
    j = j if same else j + cut
    good = exact_links(sets, i, j, threshold) if len(i) else np.empty(0, bool)
    i, j = i[good], j[good]
    copies = np.array(rows["copies"])
    links = np.bincount(i, copies[j], len(sets)).astype(int) + np.bincount(j, copies[i], len(sets)).astype(int)
    root = forest(len(sets), i, j)
    at = np.flatnonzero(links).tolist()
    return {"tk": [rows["tk"][x] for x in at], "links": links[at].tolist(), "root": [rows["tk"][root[x]] for x in at]}


def text_key(column: str) -> Column:
    return F.unhex(F.md5(text_or_empty(column)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(tk, copies, links, first_id, first_rows, class_id, class_key) for texts with copies or links; tk is text_key().

    links: documents linked with a document of this text, its own copies included. class_id: the smallest id of the
    class, class_key: the text that has it. first_id: the smallest id with this text, on first_rows rows.
    """
    if threshold != THRESHOLD:
        raise ValueError("bands and posteriors are laid out for the module's THRESHOLD")
    narrow = docs.select(F.col(id_column).alias("id"), text_key(text_column).alias("tk"), text_or_empty(text_column).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def sign(rows, own={}):  # noqa: B006
        shingler = own.setdefault("s", Shingler())
        out = {"id": rows["id"], "tk": rows["tk"], "sig": [], "bands": []}
        for text in rows["text"]:
            s = shingler(text)
            if not len(s):
                out["sig"].append(None)
                out["bands"].append(None)
                continue
            v = min_values(s).astype(np.uint16)
            out["sig"].append(v.tobytes())
            out["bands"].append(band_keys(v).view(np.int64).tolist())
        return out

    signed = map_slices(narrow, sign, f"id {id_type}, tk binary, sig binary, bands array<long>").where("sig is not null")
    by_row = signed.groupBy("tk", "id").agg(F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    nodes = by_row.groupBy("tk").agg(F.sum("n").alias("copies"), least.alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("tk", "copies", F.col("least.id").alias("first_id"), F.col("least.n").alias("first_rows"), "sig", "bands"), "dup-nodes")

    banded = nodes.select("tk", F.posexplode("bands").alias("band", "key"))
    # a table of its own, so that the rows of a bucket with a large share of them may be split over tasks
    counts = written(banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1"), "dup-buckets")
    shared = banded.join(small(counts), ["band", "key"]).join(nodes.select("tk", "sig"), "tk")
    place = "band int, key long, low int, high int, second boolean, tk binary"
    members = written(_map_groups(_by_blocks(shared, F.col("size"), ["tk", "sig"]), bucket_members, place), "dup-members")

    # few texts have a pair to verify: if their keys are small, texts needn't be shuffled to find them
    wanted = members.select("tk").distinct().join(nodes.select("tk", "copies", "first_id"), "tk").select(F.col("tk").alias("member"), "copies", "first_id")
    wanted = written(wanted, "dup-wanted")
    # one row of each text: the text's smallest id is part of the key, which spreads the rows of a text with many copies
    texts = narrow.join(small(wanted), (narrow["tk"] == F.col("member")) & narrow["id"].eqNullSafe(F.col("first_id"))).select("tk", "text", "copies")
    texts = written(texts.dropDuplicates(["tk"]), "dup-texts")

    def verify(rows, own={}):  # noqa: B006
        return bucket_links(rows, own.setdefault("s", Shingler()), threshold)

    linked = written(_map_groups(_dealt(members.join(texts, "tk").select(*GROUP, "second", "tk", "text", "copies")), verify, "tk binary, links long, root binary"), "dup-links")
    discard(counts, members, wanted, texts)
    links = linked.groupBy("tk").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("tk").alias("u"), F.col("root").alias("v")))
    known = nodes.drop("sig", "bands").join(links, "tk", "left").where("copies > 1 or links > 0")
    known = known.join(classes, known["tk"] == classes["node"], "left").withColumn("class", F.coalesce("root", "tk")).drop("node", "root")
    best = known.groupBy("class").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "tk")).alias("best"))
    known = known.join(best, "class")
    known = written(known.select("tk", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "first_id", "first_rows", F.col("best.first_id").alias("class_id"), F.col("best.tk").alias("class_key")), "dup-classes")
    discard(nodes, linked)
    return known


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: class_id and n_links, the number of other documents with a similarity of 0.8 or more."""
    found = small(near_duplicates(docs, id_column, text_column)).select("tk", "links", "class_id")
    rows = docs.select(F.col(id_column).alias("id"), text_key(text_column).alias("tk")).join(found, "tk", "left")
    alone = F.col("links").isNull()
    return rows.select(F.col("id").alias(id_column), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each class: the smallest id, one row of it if rows repeat."""
    found = near_duplicates(docs, id_column, text_column)
    repeats = not found.where("first_rows > 1").isEmpty()
    rest = small(found).select(F.col("tk").alias("__dup_tk"), F.col("first_id").alias("__dup_id"), (F.col("tk") == F.col("class_key")).alias("__dup_leads"))
    rows = docs.withColumn("__dup_key", text_key(text_column)).join(rest, F.col("__dup_key") == F.col("__dup_tk"), "left")
    rows = rows.where(F.col("__dup_tk").isNull() | F.col("__dup_leads") & F.col(id_column).eqNullSafe(F.col("__dup_id")))
    # what is left differs in text, unless rows with the same id and text repeat; texts without words have keys of their own
    if repeats:
        worded = F.regexp_like(text_or_empty(text_column), F.lit(r"[\p{L}\p{N}]"))
        rows = rows.where(~worded).union(rows.where(worded).dropDuplicates(["__dup_key"]))
    return rows.select(*docs.columns)
