"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

Texts are words (runs of letters and digits, in lower case). An item of m words is found where some stretch of a
document is at most k = floor(EDITS * m) word edits away. The CGK walk reads a word, repeats or passes it by a random
bit of (word, step), and so turns edit distance into Hamming distance: a window and an item a few edits apart agree in
most steps. Each repetition compares SAMPLES random steps; the number of repetitions comes from a simulation of pairs
that are k edits apart, for every k of a class of lengths, so that RECALL of them meet at least once. What meets is verified
by exact approximate matching (Myers' bit vectors) around the window, which also gives the distance and the place.
The simulations of a block run as tasks, one for each number of edits. Where MOST_REPETITIONS wouldn't do, or an item has
more than LONGEST_WALK words, windows are found without loss instead: of k + 1 pieces of an item one stays whole under k
edits, so every place where a piece stands is verified.

Windows start at every word. Only starts from which m + k words hold enough of the block's words and word pairs are
embedded: k edits leave m - k words and m - 1 - 2k pairs in place, so nothing within reach is lost. The first word must
be one of the block's: a match that begins with another word is no further away without it. Items enter in
blocks of at most BLOCK_CHARACTERS, found by counting; documents are read once for each block.

Defined results: null and empty texts match nothing; items without words are left out; an item row given twice gives
its pairs twice, and items that share an id, or have none, keep their pairs apart; repeated documents repeat their
pairs; other columns of the inputs are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm.common import SLICE_ROWS, map_slices, text_or_empty, where_text

WORD = re.compile(r"[^\W_]+")
#: Different characters between words up to which they are made blanks one by one, which is faster than the pattern.
FEW_MARKS = 48
EDITS, SAMPLES, RECALL, MOST_REPETITIONS = 0.2, 2, 0.98, 96
BLOCK_CHARACTERS = 8_000_000
#: Lengths in a class differ by this factor at most; windows embedded at once.
CLASS_FACTOR, WINDOWS = 1.15, 4096
#: Words above which an item is found by pieces without a simulation; it is near the length where MOST_REPETITIONS end.
LONGEST_WALK = 600
PAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The runs of letters and digits in lower case, as WORD finds them."""
    text = text.lower()
    marks = [c for c in set(text) if not c.isalnum() and not c.isspace()]
    if len(marks) > FEW_MARKS:
        return WORD.findall(text)
    for c in marks:
        text = text.replace(c, " ")
    return text.split()


def word_code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def edits_allowed(n_words: int, share: float = EDITS) -> int:
    return int(share * n_words + 1e-9)


class Walks:
    """The CGK walks and sampled steps of all repetitions for texts of at least `shortest` words."""

    def __init__(self, shortest: int, repetitions: int, samples: int = SAMPLES, seed: int = 7):
        rng = np.random.default_rng([seed, shortest])
        self.steps = 3 * shortest
        self.factors = rng.integers(0, 1 << 63, (repetitions, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # the later steps of a walk read nothing but what follows the end
        self.sampled = np.sort(np.array([rng.choice(max(1, 2 * shortest - 1), samples, replace=shortest == 1) for _ in range(repetitions)]), axis=1)

    def keys(self, windows: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
        """For each length, keys (repetition, window) of windows cut to that length; rows are padded on the right."""
        n, wide = windows.shape
        # the place of a walk is step * n + window: the same step of all windows lies together, and what follows the end is padded
        reach = int(self.sampled.max()) + 1
        symbols = np.full((max(wide, reach) + 1, n), PAD)
        symbols[:wide] = windows.T
        symbols, ends = symbols.ravel(), np.array(lengths)[:, None] * n
        # walks that end last come first, so that those which still go on are a slice
        order = np.argsort(-self.sampled[:, -1], kind="stable")
        last, factors = self.sampled[order, -1], self.factors[order]
        at = np.tile(np.arange(n), (len(order), 1))
        keys = np.zeros((len(order), len(lengths), n), np.uint64)
        for step in range(reach):
            going = int(np.searchsorted(-last, -step, "right"))
            read = symbols[at[:going]]
            for i, times in zip(*np.unique(np.nonzero(self.sampled[order[:going]] == step)[0], return_counts=True), strict=True):
                symbol = np.where(at[i] < ends, read[i], PAD)
                for _ in range(times):
                    keys[i] = (keys[i] ^ symbol) * np.uint64(0x9FB21C651E98DF25)
                    keys[i] ^= keys[i] >> np.uint64(29)
            read *= factors[:going, step, None]
            read >>= np.uint64(63)
            read *= np.uint64(n)
            at[:going] += read.view(np.int64)
        back = np.argsort(order)
        return {m: keys[back, i] for i, m in enumerate(lengths)}


def repetitions_for(n_words: int, edits: int, recall: float = RECALL, pairs: int = 300, shortest: int | None = None) -> int | None:
    """How many repetitions of the walk of a class let `recall` of simulated pairs, `edits` random edits apart, meet; None if too many."""
    if not edits:
        return 1
    rng = np.random.default_rng([11, n_words, edits])
    a = rng.integers(1, 1 << 62, (pairs, n_words), dtype=np.uint64)
    b = np.full((pairs, n_words), PAD)
    for row, out in zip(a, b, strict=True):
        own = row.tolist()
        for kind in rng.integers(0, 3, edits):
            i = int(rng.integers(0, max(1, len(own))))
            own[i : i + (kind != 1)] = [int(rng.integers(1, 1 << 62))] if kind != 2 else []
        own = own[:n_words]
        out[: len(own)] = own
    walks = Walks(shortest or n_words, MOST_REPETITIONS)
    met = np.logical_or.accumulate(walks.keys(a, [n_words])[n_words] == walks.keys(b, [n_words])[n_words], axis=0).mean(1)
    return int(np.argmax(met >= recall)) + 1 if met[-1] >= recall else None


def length_classes(lengths: set[int]) -> list[list[int]]:
    """The lengths in groups that share a walk."""
    left, out = sorted(lengths), []
    while left:
        out.append([m for m in left if m <= max(left[0], CLASS_FACTOR * left[0])])
        left = left[len(out[-1]) :]
    return out


def class_cases(own: list[int], edits: float = EDITS) -> list[tuple[int, int]]:
    """(length, edits) of the simulations of a class, longest first: of lengths with the same number of edits the shortest is the hardest."""
    hardest: dict[int, int] = {}
    for m in own:
        hardest.setdefault(edits_allowed(m, edits), m)
    return [(m, k) for k, m in sorted(hardest.items(), reverse=True)]


def class_repetitions(own: list[int], edits: float = EDITS, recall: float = RECALL) -> int | None:
    """The most that any number of edits in the class takes; None, for pieces, if one takes too many or the class is too long."""
    most = 1
    for m, k in class_cases(own, edits) if own[-1] <= LONGEST_WALK else [(own[-1], None)]:
        times = None if k is None else repetitions_for(m, k, recall, shortest=own[0])
        if times is None:
            return None
        most = max(most, times)
    return most


def simulated_repetitions(spark: SparkSession, classes: list[list[int]]) -> list[int | None]:
    """class_repetitions of all classes, each number of edits in a task of its own: LONGEST_WALK bounds them by some two hundred."""
    cases = [(c, own[0], m, k) for c, own in enumerate(classes) if own[-1] <= LONGEST_WALK for m, k in class_cases(own)]
    if not cases:
        return [None] * len(classes)

    def simulate(rows):
        times = [repetitions_for(m, k, shortest=least) for least, m, k in zip(rows["shortest"], rows["words"], rows["edits"], strict=True)]
        return {"class": rows["class"], "times": times}

    # from Arrow: rows of Python objects would take further Python workers beside those of the search
    names = ("class", "shortest", "words", "edits")
    asked = spark.createDataFrame(pa.table({n: pa.array(v, pa.int32()) for n, v in zip(names, zip(*cases, strict=True), strict=True)})).repartition(len(cases))
    times: dict[int, list[int | None]] = {}
    for r in map_slices(asked, simulate, "class int, times int").collect():
        times.setdefault(r["class"], []).append(r["times"])
    return [max(times[c]) if c in times and None not in times[c] else None for c in range(len(classes))]


def best_match(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end) of the stretch of text that is fewest word edits from pattern, the first such end."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        if score < best[0]:
            best = (score, j)
    return best


def piece_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of `size` words, by where it begins; equal runs have equal codes."""
    n = len(ids) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        out = (out ^ (ids[i : i + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


class Pieces:
    """Items of one class cut into one piece more than they may have edits."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]]):
        """items: (place, word ids, edits)."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for place, ids, edits in items:
            size = len(ids) // (edits + 1)
            codes = piece_codes(ids, size)
            found.setdefault(size, []).extend((int(codes[i * size]), place, i * size) for i in range(edits + 1))
        self.tables = {}
        for size, rows in found.items():
            rows.sort()
            self.tables[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def starts(self, ids: np.ndarray) -> dict[int, list[int]]:
        """item -> where it would start, for each place where one of its pieces stands."""
        out: dict[int, set[int]] = {}
        for size, (codes, place, offset) in self.tables.items():
            own = piece_codes(ids, size)
            left, right = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
            for at in np.flatnonzero(right > left).tolist():
                for i in range(left[at], right[at]):
                    out.setdefault(int(place[i]), set()).add(at - int(offset[i]))
        return {k: sorted(v) for k, v in out.items()}


class Matcher:
    """A block of benchmark items, ready to be searched for in documents."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, recall: float = RECALL, repetitions: list[int] | None = None):
        self.items = [(i, w, edits_allowed(len(w), edits)) for i, t in items if (w := words_of(t))]
        self.own_words = [frozenset(w) for _, w, _ in self.items]
        self.vocabulary: dict[str, int] = {}
        for _, w, _ in self.items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.size = len(self.vocabulary)
        self.codes = np.array([word_code(x) for x in self.vocabulary], np.uint64)
        ids = [[self.vocabulary[x] for x in w] for _, w, _ in self.items]
        self.pairs = np.unique(np.array([a * self.size + b for w in ids for a, b in zip(w, w[1:], strict=False)], np.int64))
        classes = length_classes({len(w) for _, w, _ in self.items})
        self.classes, self.pieces = [], []
        for own, times in zip(classes, repetitions or [class_repetitions(own, edits, recall) for own in classes], strict=True):
            if times is None:
                self.pieces.append(Pieces([(i, np.array(ids[i]), k) for i, (_, w, k) in enumerate(self.items) if len(w) in own]))
                continue
            allowed = {m: edits_allowed(m, edits) for m in own}
            walks = Walks(own[0], times)
            tables = {}
            for m in own:
                mine = [i for i, (_, w, _) in enumerate(self.items) if len(w) == m]
                keys = walks.keys(self.codes[np.array([ids[i] for i in mine])], [m])[m]
                order = np.argsort(keys, axis=1)
                tables[m] = (np.take_along_axis(keys, order, 1), np.array(mine)[order])
            need_words, need_pairs = min(m - allowed[m] for m in own), min(max(0, m - 1 - 2 * allowed[m]) for m in own)
            self.classes.append((own, own[-1] + max(allowed.values()), need_words, need_pairs, walks, tables))

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text, (item id, distance, words of the item, start word, end word) of the items in reach."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        waiting: list[list] = [[] for _ in self.classes]
        held = [0] * len(self.classes)
        for start in range(0, len(texts), SLICE_ROWS):
            docs = [words_of(t) for t in texts[start : start + SLICE_ROWS]]
            lengths = np.array([len(d) for d in docs])
            ends = np.cumsum(lengths + 1) - 1
            begins = ends - lengths
            flat: list[str] = []
            for d in docs:
                flat += d
                # no word: it ends the document
                flat.append("")
            ids = np.fromiter(map(self.vocabulary.get, flat, repeat(-1)), np.int64, len(flat))
            known = ids >= 0
            paired = known[:-1] & known[1:]
            codes = ids[:-1][paired] * self.size + ids[1:][paired]
            hit = np.zeros(len(paired), bool)
            if len(self.pairs):
                hit[np.flatnonzero(paired)] = self.pairs[np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)] == codes
            for pieces in self.pieces:
                for d, doc in enumerate(docs):
                    for item, starts in pieces.starts(ids[begins[d] : begins[d] + lengths[d]]).items():
                        self._verify(out[start + d], item, doc, starts)
            words, pairs = np.concatenate([[0], np.cumsum(known)]), np.concatenate([[0], np.cumsum(hit)])
            first, read = np.arange(len(ids)), known.copy()
            codes = np.full(len(ids), PAD)
            codes[known] = self.codes[ids[known]]
            read[ends] = True
            for c, (own, span, need_words, need_pairs, _, _) in enumerate(self.classes):
                good = known.copy()
                good &= words[np.minimum(first + span, len(words) - 1)] - words[:-1] >= need_words
                if need_pairs:
                    good &= pairs[np.minimum(first + span - 1, len(pairs) - 1)] - pairs[np.minimum(first, len(pairs) - 1)] >= need_pairs
                good = np.flatnonzero(good)
                if len(good):
                    self._read(codes, read, flat, good, own[-1])
                    within = np.searchsorted(ends, good)
                    # only the words of these documents are kept until their windows meet
                    kept = {start + d: docs[d] for d in np.unique(within).tolist()}
                    waiting[c].append((codes, good, ends[within], start + within, good - begins[within], kept))
                    held[c] += len(good)
                if held[c] >= WINDOWS:
                    self._meet(c, waiting[c], out)
                    waiting[c], held[c] = [], 0
        for c in range(len(self.classes)):
            self._meet(c, waiting[c], out)
        return [self._best(x) for x in out]

    @staticmethod
    def _read(codes: np.ndarray, read: np.ndarray, flat: list[str], first: np.ndarray, wide: int) -> None:
        """Sets the codes of the words that windows from `first` on hold and that weren't read yet."""
        edges = np.zeros(len(codes) + 1, np.int32)
        edges[first] = 1
        np.subtract.at(edges, np.minimum(first + wide, len(codes)), 1)
        new = np.flatnonzero((np.cumsum(edges[:-1], dtype=np.int32) > 0) & ~read)
        codes[new] = np.fromiter((word_code(flat[at]) for at in new.tolist()), np.uint64, len(new))
        read[new] = True

    def _meet(self, c: int, waiting: list, out: list[list]) -> None:
        own, _, _, _, walks, tables = self.classes[c]
        if not waiting:
            return
        shifts = np.cumsum([0, *(len(x[0]) for x in waiting[:-1])])
        codes = np.concatenate([x[0] for x in waiting])
        first = np.concatenate([x[1] + s for x, s in zip(waiting, shifts, strict=True)])
        ends = np.concatenate([x[2] + s for x, s in zip(waiting, shifts, strict=True)])
        doc_of, at_of = np.concatenate([x[3] for x in waiting]), np.concatenate([x[4] for x in waiting])
        words = {d: w for x in waiting for d, w in x[5].items()}
        for i in range(0, len(first), WINDOWS):
            part = slice(i, i + WINDOWS)
            # behind its document a window reads the padding that ends it
            windows = codes[np.minimum(first[part, None] + np.arange(own[-1]), ends[part, None])]
            docs, at = doc_of[part].tolist(), at_of[part].tolist()
            met: dict[tuple[int, int], list[int]] = {}
            for m, keys in walks.keys(windows, own).items():
                table, mine = tables[m]
                for r in range(len(keys)):
                    left = np.searchsorted(table[r], keys[r])
                    hits = np.flatnonzero(table[r][np.minimum(left, len(mine[r]) - 1)] == keys[r])
                    right = np.searchsorted(table[r], keys[r, hits], "right")
                    for w, a, b in zip(hits.tolist(), left[hits].tolist(), right.tolist(), strict=True):
                        for item in mine[r, a:b].tolist():
                            met.setdefault((docs[w], item), []).append(w)
            for (doc, item), rows in met.items():
                self._verify(out[doc], item, words[doc], sorted({at[w] for w in rows}))

    def _verify(self, out: list, item: int, words: list[str], starts: list[int]) -> None:
        """Adds the best match of the item around each group of starts; starts that touch are verified together."""
        key, pattern, allowed = self.items[item]
        m, begin = len(pattern), 0
        while begin < len(starts):
            end = begin
            while end + 1 < len(starts) and starts[end + 1] <= starts[end] + m:
                end += 1
            low = max(0, starts[begin] - allowed)
            region = words[low : max(0, starts[end] + m + 2 * allowed)]
            # within reach m - allowed words of the item stand in the text
            near = sum(map(self.own_words[item].__contains__, region)) >= m - allowed
            distance, stop = best_match(pattern, region) if near else (m, 0)
            if near and distance <= allowed:
                back = best_match(pattern[::-1], region[:stop][::-1])[1]
                out.append((key, distance, m, low + stop - back, low + stop))
            begin = end + 1

    @staticmethod
    def _best(found: list[tuple]) -> list[tuple]:
        """The nearest, then first place for each item."""
        best: dict = {}
        for x in found:
            if x[0] not in best or (x[1], x[3]) < (best[x[0]][1], best[x[0]][3]):
                best[x[0]] = x
        return list(best.values())


def item_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[list[tuple]]:
    """The items as (id, text, how often the row is there) in blocks of about BLOCK_CHARACTERS, by a hash of the row."""
    rows = benchmark.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).groupBy("id", "text").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // BLOCK_CHARACTERS)
    for b in range(n):
        own = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == b)
        yield sorted(((r["id"], r["text"], r["n"]) for r in own.collect()), key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1]))


def _sent(docs: DataFrame, block: list[tuple]):
    """The block and the repetitions of its classes."""
    classes = length_classes({len(w) for _, t, _ in block if (w := words_of(t))})
    return docs.sparkSession.sparkContext.broadcast((block, simulated_repetitions(docs.sparkSession, classes)))


def _matcher(sent, cache: dict) -> Matcher:
    """The matcher of a broadcast block, made once in each Python worker; it names items by their place in the block."""
    if "own" not in cache:
        block, repetitions = sent.value
        cache["own"] = Matcher([(i, t) for i, (_, t, _) in enumerate(block)], repetitions=repetitions)
    return cache["own"]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row and item row in reach: distance, item_words, start_word, end_word (exclusive)."""
    narrow = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, item {benchmark.schema[item_id].dataType.simpleString()}, distance int, item_words int, start_word int, end_word int"
    found = None
    for block in item_blocks(benchmark, item_id, item_text):
        sent, cache = _sent(docs, block), {}

        def pairs(rows, sent=sent, cache=cache):
            found = zip(rows["id"], _matcher(sent, cache).search(rows["text"]), strict=True)
            hits = [(i, sent.value[0][x[0]][0], *x[1:]) for i, own in found for x in own for _ in range(sent.value[0][x[0]][2])]
            columns = list(zip(*hits, strict=True)) or [[]] * 6
            return dict(zip(("id", "item", "distance", "item_words", "start_word", "end_word"), columns, strict=True))

        part = map_slices(narrow, pairs, schema, rows=16 * SLICE_ROWS)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"id": id_column, "item": item_id})


def _clean(sent):
    """A function of texts: whether no item of the broadcast block is in reach."""
    cache: dict[str, Matcher] = {}
    return lambda texts: [not x for x in _matcher(sent, cache).search(texts)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in whose text no item is in reach."""
    for block in item_blocks(benchmark, item_id, item_text):
        docs = where_text(docs, text_column, _clean(_sent(docs, block)), rows=16 * SLICE_ROWS)
    return docs
