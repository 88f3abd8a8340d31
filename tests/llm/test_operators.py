"""The corpus operators against brute force, on planted cases and on awkward tables."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesprism.llm import components as CC
from salesprism.llm import decontamination as D
from salesprism.llm import languages as L
from salesprism.llm import licenses as LI
from salesprism.llm import mixing as M
from salesprism.llm import neardup as N
from salesprism.llm import ppm as P
from salesprism.llm import secrets as S
from salesprism.llm import toxicity as T
from salesprism.llm import warc as W
from salesprism.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, tk string, id string, words string"


def docs(spark, texts, **columns):
    rows = []
    for i, t in enumerate(texts):
        own = {k: v[i] for k, v in columns.items()}
        rows.append((own.get("doc_id", i), t, own.get("lang"), own.get("source"), None, 7, "x", "y", "z"))
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    long = "lorem " * 60_000
    texts = [None, "", " ", "one", "the same text twice over and over again", "the same text twice over and over again", long, "tail " * 4 + "é", "\x00 odd", "one"]
    return docs(spark, texts, doc_id=[None, 1, 2, 3, 4, 4, 6, 7, 8, 9], source=[None, "a", "b", "", "a", "a", None, "é", "z", "b"], lang=[None, "en", None, "en", "de", "de", "en", "fr", "fr", None])


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


RSA = der(0x30, der(2, b"\x00"), *[der(2, bytes([5]) * k) for k in (65, 3, 64, 33, 33, 32, 32, 33)])
PKCS8 = der(0x30, der(2, b"\x00"), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))


def b64(data):
    return base64.b64encode(data).decode()


def test_keys_and_tokens_are_confirmed_by_structure():
    assert S.is_der_key(RSA) and S.is_der_key(PKCS8)
    assert not S.is_der_key(RSA[:-1]) and not S.is_der_key(RSA + b"x") and not S.is_der_key(der(0x30, der(2, b"\x01")))
    s = lambda x: len(x).to_bytes(4, "big") + x
    ssh = S.OPENSSH_MAGIC + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(b"pub") + s(b"private")
    assert S.is_openssh_key(ssh) and not S.is_openssh_key(ssh[:-2])
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    bad = f"{part({'typ': 'JWT', 'kid': 'long enough'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    text = f"é {b64(RSA)} and {RSA.hex()} then {jwt} not {bad} -----BEGIN PRIVATE KEY-----\n{b64(PKCS8)[:64]}\n{b64(PKCS8)[64:]}\n-----END PRIVATE KEY----- {b64(ssh)}"
    kinds = Counter(k for _, k, _ in S.find_secrets(text)[1])
    assert kinds["der"] == 2 and kinds["jwt"] == 1 and kinds["pem"] == 1 and kinds["openssh"] == 1 and kinds["hex"] == 1
    clean = S.redact(text, S.find_secrets(text)[1])
    assert not S.find_secrets(clean)[1] and clean.startswith("é ") and bad in clean


def test_base_spans_are_leftmost_matches_with_limits():
    text = "Password: 'abcdefgh' token=short secret = ABCDEFGHI= AKIA0123456789AB AKIA12 " + "a" * 31 + " " + "0" * 40
    base, spans = S.find_secrets(text)
    assert [k for _, k, _ in base] == ["assign", "assign", "access", "hex"] and spans == base
    assert text[base[0][0] : base[0][2]] == "Password: 'abcdefgh" and base[3][2] - base[3][0] == 40
    assert S.find_secrets("paſſword: abcdefghij")[0] == [] and S.find_secrets("to\u212aen: abcdefghij")[0] == []


def test_secret_scan_on_awkward_rows(spark):
    rows = S.scan_secrets(awkward(spark)).collect()
    assert len(rows) == 10 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    out = S.redact_secrets(docs(spark, ["token = abcdefgh12", None])).orderBy("doc_id").collect()
    assert out[0]["text"] == "[ASSIGN REMOVED]" and out[0]["n_chars"] == 16 and out[1]["text"] is None and out[1]["n_chars"] is None
    assert S.scan_secrets(docs(spark, [])).count() == 0


def test_license_phrases_and_notices(spark):
    notice = LI.TEMPLATES[0][1]
    words = LI.template_words(notice)
    holed = " ".join(w for i, w in enumerate(words) if i % 12)
    texts = ["MIT license, mit License; Apache  LICENSE", notice.upper(), "x " * 333 + holed + " y" * 333, " ".join(words[: len(words) // 2]), "General\nPublic-License v3", None, "mit \u212aLICENSE \u0130 MIT LICENSE"]
    rows = {r["doc_id"]: r for r in LI.scan_licenses(docs(spark, texts)).collect()}
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"], rows[0]["score"]) == (3, 0, 4, "apache,mit", 1.0)
    assert rows[1]["labels"] == "mit" and rows[1]["base_labels"] == "" and rows[1]["score"] == 1.0
    assert rows[2]["labels"] == "mit" and 0.8 <= rows[2]["score"] < 1
    assert rows[3]["labels"] == "" and rows[3]["score"] == 0 and rows[4]["base_labels"] == "gpl"
    assert (rows[6]["n_base"], rows[6]["first_word"]) == (1, 3)
    assert rows[5]["n_words"] == 0 and rows[5]["first_word"] is None and rows[5]["labels"] == ""
    assert LI.scan_licenses(awkward(spark)).count() == 10 and LI.scan_licenses(docs(spark, [])).count() == 0
    long = " ".join(["of the and to"] * 40_000 + words + ["software the"] * 40_000 + [notice.upper()])
    r = LI.scan_licenses(docs(spark, [long])).first()
    assert r["labels"] == "mit" and r["score"] == 1.0 and r["n_words"] == 240_000 + 2 * len(words)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["A b, c!", "a B c", None, "", "--", texts[0], texts[0]]
    shingles = []
    for t in texts:
        w = N.WORD.findall((t or "").lower())
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if shingles[i] and shingles[j] and jaccard(shingles[i], shingles[j]) >= 0.8 - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    expected = {i: (root[i], links[i]) for i in range(len(texts))}
    table = docs(spark, texts)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.jaccard_join(table).collect()} == expected
    kept = {r["doc_id"] for r in N.keep_one(table).collect()}
    assert kept == {c for c, _ in expected.values()}


def test_blocks_of_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 200, 10)]
    rows = N.jaccard_join(docs(spark, texts)).collect()
    assert {r["class_id"] for r in rows} == {0} and {r["n_links"] for r in rows} == {19}


def test_near_duplicates_on_awkward_rows(spark):
    t = awkward(spark)
    rows = N.jaccard_join(t).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["class_id"], r["n_links"]))
    assert len(rows) == 10 and by[4] == [(4, 1), (4, 1)] and sorted(by[3] + by[9]) == [(3, 1), (3, 1)] and by[None] == [(None, 0)] and by[1] == [(1, 0)]
    kept = N.keep_one(t)
    assert kept.columns == t.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 6, 7, 8])
    assert N.jaccard_join(docs(spark, [])).count() == 0 and N.keep_one(docs(spark, [])).count() == 0


def test_posterior_bound():
    # P(Beta(m + 1, n - m + 1) > t) by a sum over a fine grid
    for n, m in ((16, 6), (32, 17)):
        grid = (np.arange(200_000) + 0.5) / 200_000
        density = grid**m * (1 - grid) ** (n - m)
        tail = density[grid > 0.8].sum() / density.sum()
        assert (tail >= N.TOLERANCE) == (m >= N.least_agreements(n))


def test_components_of_a_long_path(spark):
    path = list(range(60))
    random.Random(1).shuffle(path)
    edges = spark.createDataFrame([(path[i], path[i + 1]) for i in range(59)] + [(100, 101), (7, 7)], "u long, v long")
    found = {r["node"]: r["root"] for r in CC.components(edges).collect()}
    assert {found[i] for i in range(60)} == {0} and found[101] == found[100] == 100
    assert CC.components(edges.where("false")).count() == 0


def test_edit_matching_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        p = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        t = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
        distance, end = D.best_match(p, t)
        assert distance == min(row) and row[end] == distance


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(2)
    word = lambda k: f"{k}{rng.randrange(5000)}"
    items = [(i, " ".join(word("b") for _ in range(rng.randint(8, 50)))) for i in range(30)] + [(98, None), (99, "!!")]
    texts, expected = [], []
    for n in range(150):
        i, t = rng.choice(items[:30])
        w = t.split()
        for _ in range(rng.randint(0, D.edits_allowed(len(w)))):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [word("e")] * rng.randint(0, 1)
        filler = [word("f") for _ in range(60)]
        texts.append(" ".join(filler[:30] + w + filler[30:]))
        expected.append((n, i))
    texts += [" ".join(word("f") for _ in range(200)), None, "", items[0][1].upper()]
    found = D.find_contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert sum(x in pairs for x in expected) >= 0.97 * len(expected)
    assert all(d < 150 or d == 153 for d, _ in pairs) and pairs[153, items[0][0]]["distance"] == 0
    clean = D.drop_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {150, 151, 152} <= {r["doc_id"] for r in clean.collect()} and clean.where("doc_id = 153").count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(awkward(spark), none).count() == 0 and D.drop_contaminated(awkward(spark), none).count() == 10


def brute_ppm(training, text):
    tables = [defaultdict(Counter) for _ in range(4)]
    wrap = lambda t: b"\xfe\xfe\xfe" + t.encode() + b"\xff"
    for t in training:
        b = wrap(t)
        for i in range(3, len(b)):
            for k in range(4):
                tables[k][b[i - k : i]][b[i]] += 1
    total, b = 0.0, wrap(text)
    for i in range(3, len(b)):
        out = set()
        for k in (3, 2, 1, 0):
            own = tables[k].get(b[i - k : i])
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in out}
            whole = sum(left.values()) + len(left)
            if b[i] in left:
                total += math.log10(left[b[i]] / whole)
                break
            if left:
                total += math.log10(len(left) / whole)
            out |= set(own)
        else:
            total -= math.log10(256 - len(out))
    return total


@pytest.mark.parametrize("hot", [P.HOT_GRAMS, 20, 0])
def test_ppm_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT_GRAMS", hot)
    monkeypatch.setattr(P, "HOT_WORDS", 3)
    texts = ["abracadabra abra", "Das Haus — ein Häuschen", "abra ABRA cadabra", None, "", "zzz unseen ¿", "the the the a", "the the the a"]
    train = [i % 3 != 2 for i in range(len(texts))]
    table = docs(spark, texts, doc_id=[0, 1, 2, 3, 4, 5, 6, 6])
    rows = P.score_documents(table, F.col("doc_id") % 3 != 2).collect()
    learned = [t or "" for t, i in zip(texts, [0, 1, 2, 3, 4, 5, 6, 6], strict=True) if i % 3 != 2]
    counts = Counter(w for t in learned for w in P.tokens(t))
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    assert len(rows) == len(texts) and train
    for r in rows:
        t = texts[r["doc_id"]] or ""
        own = P.tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own) + 1, sum(w in counts for w in own) + 1, n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(learned) + 1) / (n + v + 1)), rel_tol=1e-9)
        assert math.isclose(r["score"], brute_ppm(learned, t), rel_tol=1e-9)


def test_ppm_without_training_and_awkward_rows(spark):
    r = P.score_documents(docs(spark, ["ab"]), F.lit(False)).collect()[0]
    assert r["base_score"] == 0 and math.isclose(r["score"], -3 * math.log10(256)) and r["train_tokens"] == 0 and r["n_known"] == 0
    assert P.score_documents(awkward(spark), F.lit(True)).count() == 10 and P.score_documents(docs(spark, []), F.lit(True)).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(1500)]
    sources = [rng.choice([None, "", "a", "b", "c", "é"]) if rng.random() < 0.6 else "a" for _ in texts]
    rows = M.mix_sources(docs(spark, texts, source=sources)).collect()
    again = M.mix_sources(docs(spark, texts, source=sources).repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        free = [s for s in order if s not in full]
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in rows:
        s = sources[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["source_size"] == sizes[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
    for s in order:
        assert abs(taken[s] - target[s]) <= max(60, 0.01 * target[s])


def test_mixing_on_awkward_rows(spark):
    rows = M.mix_sources(awkward(spark)).collect()
    assert len(rows) == 10 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert M.mix_sources(docs(spark, [])).count() == 0
    empty = M.mix_sources(docs(spark, ["", None], source=["a", "b"])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_toxicity_learns_words_and_finds_the_sentence(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        parts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(6)) for _ in range(rng.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            parts[rng.randrange(len(parts))] += f" {rng.choice(['vile', 'nastyish'])} thing"
        texts.append(". ".join(parts) + ".")
        labels.append((i, int(bad)))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7), (7, 0)], "doc_id long, toxic int")
    model = T.train_toxicity(docs(spark, texts), table, F.col("label_id") % 5 != 0)
    rows = {r["doc_id"]: r for r in T.score_toxicity(docs(spark, texts), model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert all(rows[i]["predicted"] == (i % 4 == 0) for i in held)
    worst = rows[20]
    assert any(w in texts[20][worst["worst_start"] : worst["worst_end"]] for w in ("vile", "nastyish"))
    assert {r["doc_id"] for r in T.drop_toxic(docs(spark, texts), model).collect()} == {i for i, r in rows.items() if not r["predicted"]}
    odd = T.score_toxicity(awkward(spark), model).collect()
    assert len(odd) == 10 and all(0 <= r["score"] <= 1 for r in odd)
    untrained = T.train_toxicity(docs(spark, texts), table.where("false"))
    assert not untrained.trained and T.score_toxicity(docs(spark, ["x"]), untrained).first()["score"] == 0


def test_languages_by_compression(spark):
    rng = random.Random(7)
    stems = {"aa": ["kala", "mano", "tipu", "sela"], "bb": ["schr", "ung", "heit", "zwe"]}
    make = lambda x: " ".join("".join(rng.choice(stems[x]) for _ in range(3)) for _ in range(40))
    langs = [rng.choice(["aa", "bb"]) for _ in range(200)]
    texts = [make(x) for x in langs]
    table = docs(spark, texts, lang=langs)
    learned = L.train_languages(table, F.col("doc_id") % 4 != 2)
    rows = L.identify_languages(table, learned).collect()
    assert all(r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["doc_id"] % 4 == 2)
    odd = {r["doc_id"]: r for r in L.identify_languages(docs(spark, [None, "", "123 !", "é"]), learned).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[3]["lang_pred"] in stems and odd[0]["score"] == 0
    assert L.identify_languages(awkward(spark), learned).count() == 10
    assert {r["lang_pred"] for r in L.identify_languages(table, L.train_languages(table, F.lit(False))).collect()} == {"und"}


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    from salesprism.llm import topk

    monkeypatch.setattr(topk, "BLOCK_COMPONENTS", block)
    monkeypatch.setattr(topk, "FIRST_ROWS", 10)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 7).round(2)]) for i in range(80)] + [(i, [0.5] * 7) for i in range(80, 120)]
    rows += [(120, None), (140, [1.0, None, 1.0]), (141, [float("nan")] * 7), (160, [float("inf")] * 7), (180, []), (200, [1.0, 2.0]), (201, [3.0, 1.0]), (5, [9.0] * 7), (5, [9.0] * 7)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")
    ints = [(i, [math.floor(np.float64(np.float32(x)) * 64) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, v in ints:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q and len(w) == len(v))
            expected |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:20], 1)}
    got = [tuple(r) for r in top_k(table, lambda i: i % 20 == 0).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert top_k(table.where("false"), lambda i: i % 20 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = '<html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t="</p>";</script><p>One<p>two &lt;3<br>three<a href="/x?a=1">l</a><!-- no --></body></html>'
    pages = spark.createDataFrame([(1, "http://a/b", page, 9), (2, None, None, 9), (1, "http://a/b", page, 9)], "page_id long, url string, html string, content long")
    responses = W.pages_as_responses(pages)
    rows = W.build_derivatives(responses, carry=("page_id",)).collect()
    assert len(rows) == 6 and Counter(r["record_type"] for r in rows) == {"metadata": 3, "conversion": 3}
    text = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "conversion")
    meta = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert text["content"] == "A & B\nOne\ntwo <3\nthreel" and text["refers_to"] == meta["refers_to"] == responses.where("page_id = 1").first()["record_id"]
    assert "title: A & B\r\nlanguage: de\r\noutlink: /x?a=1" in meta["content"] and f"WARC-Concurrent-To: {meta['record_id']}" in text["headers"]
    assert text["block_digest"] == W.digest(text["content"].encode())
    W.write_archives(W.build_derivatives(responses), str(tmp_path / "out"))
    back = W.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted((r["record_id"], bytes(r["block"]).decode()) for r in back) == sorted((r["record_id"], r["content"]) for r in rows)
    assert all(W.digest(bytes(r["block"])) == r["block_digest"] for r in back)
    assert W.plain_text("<script>" * 20_000 + "x") == "" and W.build_derivatives(W.pages_as_responses(pages.where("false"))).count() == 0
