"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence with distinct words W has z = START + sum over W of the weights of a word and its parts, and so the hazard
softplus(z). A document has a leak, the hazard of its worst sentence, and of every sentence what its hazard exceeds that
of a sentence NEUTRAL above START by; it is toxic with probability 1 - exp(-sum), the noisy-or of its sentences. So
sentences without evidence add nothing, however many there are, and a long document isn't toxic for its length. Weights
and leak are fitted on document labels alone (proximal gradient steps with an L1 penalty, so words without evidence
weigh nothing) and then say which sentences offend.

The fit uses at most TRAIN_DOCUMENTS labelled documents with at most TRAIN_CHARACTERS characters together, chosen by a
hash of the id among those of at most LONGEST characters; scoring covers every whole text. Labels: rows with a null id
or a toxic value other than 0 and 1 are left out; an id labelled twice is toxic if any label says so. Defined results: a
null text is empty; a text without words gets the leak; without labels of both kinds the score is 0 everywhere; repeated
rows repeat their result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import map_slices, text_or_empty, where_text

TRAIN_DOCUMENTS, TRAIN_CHARACTERS, LONGEST = 5_000, 16_000_000, 400_000
#: Words in fewer sample documents aren't features.
LEAST_DOCUMENTS = 4
STEPS, RATE, PENALTY, START, NEUTRAL = 250, 0.15, 3e-4, -6.0, 5.0
#: Characters of a word part, share of the loss that toxic documents get, words whose weight a task remembers.
GRAM, POSITIVE, KNOWN = 6, 0.3, 300_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
STOPS = frozenset(".!?\n")


@dataclass
class ToxicityModel:
    leak: float
    weights: dict[str, float]
    trained: bool = True
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        """The sum over the word's features; kept for KNOWN words at most."""
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            out = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return out


def sentences(text: str) -> list[list[str]]:
    """The distinct words of each sentence that has any."""
    out, own = [], []
    for t in TOKEN.findall(text):
        if t in STOPS:
            if own:
                out.append(own)
                own = []
        else:
            own.append(t.lower())
    if own:
        out.append(own)
    return [list(dict.fromkeys(s)) for s in out]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int, id_column: str, text_column: str) -> DataFrame:
    """(toxic, words): words of the chosen documents with an empty string after each sentence."""
    clean = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    clean = clean.select(F.col("doc_id").alias("label_id"), "toxic").where(usable)
    # at most `limit` rows of numbers: the first of them whose texts fit together
    first = clean.orderBy(F.xxhash64("label_id", F.lit("toxicity")), "label_id").limit(limit)
    sized = docs.select(F.col(id_column).alias("label_id"), F.length(text_or_empty(text_column)).cast("long").alias("size")).join(F.broadcast(first), "label_id").where(F.col("size") <= LONGEST)
    sizes = sized.groupBy("label_id", "toxic").agg(F.sum("size").alias("size"))
    order = Window.orderBy(F.xxhash64("label_id", F.lit("toxicity")), "label_id")
    chosen = sizes.withColumn("until", F.sum("size").over(order)).where(F.col("until") <= TRAIN_CHARACTERS).select("label_id", "toxic")
    texts = docs.select(F.col(id_column).alias("label_id"), text_or_empty(text_column).alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(chosen), "label_id").select("toxic", "text")

    def tokens(rows):
        return {"toxic": rows["toxic"], "words": [[w for s in sentences(t) for w in [*s, ""]] for t in rows["text"]]}

    return map_slices(texts, tokens, "toxic int, words array<string>")


def word_features(word: str) -> list[str]:
    """The word, marked, and its runs of GRAM characters; a run at the start counts apart from one within."""
    marked = f"^{word}"
    return [f"{marked}$", *dict.fromkeys(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))]


def _soft(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def fit(rows: pa.Table, steps: int = STEPS) -> ToxicityModel:
    toxic = rows["toxic"].to_numpy().astype(float)
    if not 0 < toxic.sum() < len(toxic):
        return ToxicityModel(START, {}, False)
    lists = rows["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sizes = np.asarray(pa.compute.list_value_length(lists))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = codes == (words.index("") if "" in words else -1)
    sentence = np.cumsum(ends) - ends
    doc_of_sentence = doc[ends]
    doc, codes, sentence = doc[~ends], codes[~ends], sentence[~ends]
    # a feature counts if enough documents have a word with it; a whole word that is too rare isn't even noted
    in_documents = np.bincount(np.unique(doc.astype(np.int64) * len(words) + codes) % len(words), minlength=len(words))
    names: dict[str, int] = {}
    flat, lengths = array("i"), array("i")
    for w, n in zip(words, in_documents.tolist(), strict=True):
        own = word_features(w)[n < LEAST_DOCUMENTS :] if w else []
        flat.extend(names.setdefault(f, len(names)) for f in own)
        lengths.append(len(own))
    feature_word, feature = np.repeat(np.arange(len(words)), np.array(lengths)), np.array(flat, int)
    del words, flat, lengths
    n_words = len(in_documents)
    seen = np.bincount(feature, in_documents[feature_word], len(names))
    index = np.full(len(names), -1)
    kept = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    index[kept] = np.arange(len(kept))
    feature_word, feature = feature_word[index[feature] >= 0], index[feature[index[feature] >= 0]]
    n, n_docs, n_sentences = len(kept), len(toxic), len(doc_of_sentence)
    share = toxic.mean()
    of_doc = np.where(toxic > 0, POSITIVE / share, (1 - POSITIVE) / (1 - share)) / n_docs

    w, leak, least = np.zeros(n), START, _soft(START + NEUTRAL)
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        of_word = np.bincount(feature_word, w[feature], n_words)
        z = START + np.bincount(sentence, of_word[codes], n_sentences)
        soft = np.logaddexp(0, z)
        worst = np.zeros(n_docs)
        np.maximum.at(worst, doc_of_sentence, soft)
        total = _soft(leak) + np.minimum(worst, least) + np.bincount(doc_of_sentence, np.maximum(soft - least, 0), n_docs)
        by_total = np.where(toxic > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) * of_doc
        # sentences without a hazard of their own are moved as if they had one, or none would ever start
        by_z = by_total[doc_of_sentence] / (1 + np.exp(-np.clip(z, -50, 50)))
        by_word = np.bincount(codes, by_z[sentence], n_words)
        gradient = np.append(np.bincount(feature, by_word[feature_word], n), by_total.sum() / (1 + math.exp(-leak)))
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        scale = RATE / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        move = scale * first / (1 - 0.9**step)
        w, leak = w - move[:n], min(leak - move[n], -1.0)
        w = np.sign(w) * np.maximum(np.abs(w) - PENALTY * scale[:n], 0)
    by_index = {int(index[i]): f for f, i in names.items() if index[i] >= 0}
    return ToxicityModel(float(leak), {by_index[i]: float(w[i]) for i in np.flatnonzero(w).tolist()})


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, limit: int = TRAIN_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text") -> ToxicityModel:
    """usable: a condition on label_id that says which labels may be learned from."""
    return fit(training_rows(docs, labels, F.lit(True) if usable is None else usable, limit, id_column, text_column).toArrow())


def score_text(text: str, model: ToxicityModel) -> tuple[float, int, int | None, int | None]:
    """(score, offending sentences, start and end of the worst one in code points)."""
    weight, plain, least = model.weight, _soft(START), _soft(START + NEUTRAL)
    total, offending, worst, at, most = _soft(model.leak), 0, -math.inf, (None, None), 0.0
    z, own, start, end, n = START, set(), 0, 0, 0

    def close():
        nonlocal total, offending, worst, at, most
        soft = plain if z == START else _soft(z)
        most, total = max(most, soft), total + max(0.0, soft - least)
        if z >= 0:
            offending += 1
            if z > worst:
                worst, at = z, (start, end)

    for m in TOKEN.finditer(text):
        t = m[0]
        if t not in STOPS:
            if not n:
                start = m.start()
            n, end = n + 1, m.end()
            low = t.lower()
            if (w := weight(low)) and low not in own:
                own.add(low)
                z += w
        elif n:
            close()
            z, n = START, 0
            own.clear()
    if n:
        close()
    return -math.expm1(-total - min(most, least)), offending, *at


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: score, predicted, number of offending sentences, place of the worst one."""
    narrow = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    # the weights that are left grow with the bounded sample only
    sent = docs.sparkSession.sparkContext.broadcast((model.leak, model.weights, model.trained))

    cache: dict = {}

    def score(rows):
        m = cache.setdefault("own", None) or ToxicityModel(*sent.value)
        cache["own"] = m
        found = [score_text(t, m) if m.trained else (0.0, 0, None, None) for t in rows["text"]]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return {"id": rows["id"], "score": columns[0], "predicted": [int(x >= 0.5) for x in columns[0]], "n_offending": columns[1], "worst_start": columns[2], "worst_end": columns[3]}

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, score double, predicted int, n_offending long, worst_start long, worst_end long"
    return map_slices(narrow, score, schema).withColumnRenamed("id", id_column)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """The rows of docs whose text scores below one half."""
    sent = docs.sparkSession.sparkContext.broadcast((model.leak, model.weights, model.trained))

    cache: dict = {}

    def clean(texts):
        m = cache.setdefault("own", None) or ToxicityModel(*sent.value)
        cache["own"] = m
        return [not m.trained or score_text(t, m)[0] < 0.5 for t in texts]

    return where_text(docs, text_column, clean)
