import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import language_id, quality_model, quality_rules, sampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, failed long, n_words long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.0, 1, 2) for i, t, lang in rows], DOCS)


# ---- language


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    params = [rng.normal(size=s) * 0.4 for s in language_id._shapes(3, 3)]
    x, y, counts = rng.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1]), np.ones((6, 4))
    counts[4:, 1] = 0
    _, grads = language_id.loss_and_gradient(params, x, y, counts)
    for p, g in zip(params, grads):
        at = np.argwhere(np.abs(g) > 1e-6)
        for i in map(tuple, at[:: max(1, len(at) // 5)]):
            keep = p[i]
            p[i] = keep + 1e-5
            up = language_id.loss_and_gradient(params, x, y, counts)[0]
            p[i] = keep - 1e-5
            down = language_id.loss_and_gradient(params, x, y, counts)[0]
            p[i] = keep
            assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def two_languages(n, seed):
    rng = random.Random(seed)
    make = {"aa": ["banana", "casa", "mara", "lava"], "zz": ["schrift", "wurst", "pflicht", "zopf"]}
    return [(i, " ".join(rng.choice(make[lang]) for _ in range(rng.randint(3, 80))), lang) for i in range(n) for lang in [rng.choice(["aa", "zz"])]]


def test_language_accuracy_and_odd_texts(spark):
    rows = two_languages(200, 1)
    docs = docs_of(spark, rows + [(900, None, "aa"), (901, "", "zz"), (902, "12 .!", "aa"), (None, rows[0][1], None), (None, rows[0][1], None), (903, rows[1][1] * 500, "aa")])
    model = language_id.fit(docs, steps=60)
    got = language_id.identify(docs, model)
    assert got.count() == 206
    by_id = {r["doc_id"]: r for r in got.collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and sum(by_id[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by_id[None]["lang_pred"] == rows[0][2] and by_id[903]["lang_pred"] == rows[1][2]
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert set(language_id.label_bytes(model, "schrift wurst")) <= {"aa", "zz"} and len(language_id.label_bytes(model, "é" * 100)) == 200


def test_pooling_does_not_depend_on_neighbours():
    model = language_id.train([t.encode() for _, t, _ in two_languages(50, 2)], [lang for _, _, lang in two_languages(50, 2)], steps=5)
    texts = [t.encode() for _, t, _ in two_languages(30, 3)] + [b"", b"x" * 10_000]
    together = language_id.pooled(model, texts)
    alone = np.concatenate([language_id.pooled(model, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and (together[-2] == 0).all()


def slow_probabilities(m, data):
    """One byte and one number at a time, as the unit's equations say."""
    hid, way_states = m.hidden, []
    for way in (0, 1):
        h, states = [0.0] * hid, []
        for byte in data if way == 0 else data[::-1]:
            own, rec = m.table[way][:, byte].tolist(), m.recur[way].tolist()
            past = [sum(rec[r][k] * h[k] for k in range(hid)) for r in range(3 * hid)]
            gate = [1 / (1 + np.exp(-(own[r] + past[r]))) for r in range(2 * hid)]
            new = [np.tanh(own[2 * hid + k] + gate[k] * past[2 * hid + k]) for k in range(hid)]
            h = [(1 - gate[hid + k]) * new[k] + gate[hid + k] * h[k] for k in range(hid)]
            states.append(h)
        way_states.append(states if way == 0 else states[::-1])
    out = []
    for a, b in zip(*way_states):
        logits = [float(m.bias[k]) + sum(w * x for w, x in zip(m.out[k].tolist(), a + b)) for k in range(len(m.languages))]
        e = np.exp(np.array(logits) - max(logits))
        out.append(e / e.sum())
    return np.array(out)


def test_network_matches_slow_version():
    rows = two_languages(60, 5)
    model = language_id.train([t.encode() for _, t, _ in rows], [lang for _, _, lang in rows], steps=20, run=16)
    for text in ("schrift é banana", "x", "mara lava casa mara lava casa wurst " * 3):
        data = text.encode()
        runs = [data[i : i + 16].ljust(16) for i in range(0, len(data), 16)]
        slow = np.concatenate([slow_probabilities(model, r) for r in runs])[: len(data)]
        assert np.allclose(language_id.pooled(model, [data])[0], slow.mean(axis=0), atol=1e-4)
        assert language_id.label_bytes(model, text) == [model.languages[k] for k in slow.argmax(axis=1)]


def test_language_learns_from_whole_texts():
    # only the ends of the texts tell the languages apart
    texts = [b"q" * 6000 + (b"a" if k % 2 else b"z") * 6000 for k in range(40)]
    model = language_id.train(texts, ["aa" if k % 2 else "zz" for k in range(40)], steps=80)
    assert [model.languages[int(p.argmax())] for p in language_id.pooled(model, [b"a" * 500, b"z" * 500])] == ["aa", "zz"]


def test_runs_are_drawn_from_whole_texts(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdé ") for _ in range(50_000))
    raw, own = text.encode(), language_id.drawn_runs(text, 64, 50)
    assert len(own) <= 50 * 64 and own == language_id.drawn_runs(text, 64, 50) and language_id.drawn_runs("é" * 90, 64, 50) == ("é" * 90).encode()
    runs = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    at = [runs.index(own[i : i + 64]) for i in range(0, len(own), 64)]
    assert at == sorted(at) and at[-1] > 0.8 * len(runs) and at[0] < 0.2 * len(runs)
    found, langs = language_id.training_texts(docs_of(spark, [(i, text[i:], "aa") for i in range(1, 30)]), "doc_id", "text", "lang", 10, 64, 20)
    assert len(found) == len(langs) == 10 and max(map(len, found)) == 20 * 64


def test_language_without_labels(spark):
    docs = docs_of(spark, [(1, "abc", None), (2, None, "aa")])
    assert language_id.fit(docs) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), None).count() == 0


def test_smallest_is_exact(spark):
    rows = spark.range(500).withColumn("k", F.col("id").cast("string"))
    want = [r["id"] for r in rows.orderBy(F.md5("k"), "id").limit(20).collect()]
    for known in (1, 500, 10**9):
        assert [r["id"] for r in sampling.smallest(rows, F.md5("k"), 20, known, ["id"])] == want


# ---- quality model


def quality_rows(n, seed):
    rng = random.Random(seed)
    good, bad = ["report", "study", "method", "result", "shows"], ["click", "win", "free", "!!!", "|"]
    out = []
    for i in range(n):
        y = int(rng.random() < 0.6)
        out.append((i, " ".join(rng.choice(good if (rng.random() < 0.7) == bool(y) else bad) for _ in range(rng.randint(5, 60))), y))
    return out


def test_quality_held_out(spark):
    rows = quality_rows(300, 4)
    docs = docs_of(spark, [(i, t, "en") for i, t, _ in rows] + [(800, None, "en"), (801, "", "en"), (None, "win free", "en")])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, rows[5][2], 0), (None, 1, 0), (7, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality_model.score_quality(docs, quality_model.fit(docs, labels)).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) >= 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[800] == got[801]


def slow_ftrl(texts, labels, bits, alpha=0.3, beta=1.0, l1=0.02, l2=0.1, epochs=3, seed=1):
    """Plain dictionaries, one coordinate at a time."""
    z, n, hashes, order = {}, {}, quality_model._Hashes(), np.random.default_rng(seed)
    rows = []
    for t in texts:
        f = quality_model.features(t, bits, hashes).tolist()
        rows.append({i: f.count(i) / max(1, len(f)) ** 0.5 for i in set(f)} | {"bias": 1.0})

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return ((l1 if z[i] > 0 else -l1) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in rows[k].items())))
            for i, v in rows[k].items():
                g = (p - labels[k]) * v
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - old**0.5) / alpha * w[i]
    return {i: weight(i) for i in z}


def test_ftrl_matches_slow_version():
    rows = quality_rows(60, 3) + [(90, None, 1), (91, "", 0), (92, "w " * 300, 1)]
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    model, slow = quality_model.fit_ftrl(texts, labels, bits=12), slow_ftrl(texts, labels, 12)
    assert abs(model.bias - slow.pop("bias")) < 1e-9
    assert all(abs(model.weights[i] - slow.get(i, 0.0)) < 1e-5 for i in range(1 << 12)) and any(slow.values())


def test_quality_learns_from_long_texts(spark):
    # every labelled text is longer than 200,000 characters
    docs = docs_of(spark, [(i, ("good report " if i % 2 else "win free ") * 25_000, "en") for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    vectors, y = quality_model.labelled_sample(docs, labels, "doc_id", "text", "quality", 3000, 12)
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(12)) and all(c.sum() == 2 * 50_000 - 1 for _, c in vectors)
    model = quality_model.fit(docs, labels)
    short = docs_of(spark, [(1, "good report good", "en"), (2, "win free win", "en")])
    scores = {r["doc_id"]: r["score"] for r in quality_model.score_quality(short, model).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_quality_without_labels(spark):
    docs = docs_of(spark, [(1, "a b c", "en")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    assert quality_model.score_quality(docs, model).first()["score"] == 0.5
    assert quality_model.score_quality(docs.where("false"), model).count() == 0


def test_ftrl_is_sparse_dot_product():
    model = quality_model.fit_ftrl(["good good thing", "bad thing"], [1, 0], bits=12)
    hashes = quality_model._Hashes()
    index = quality_model.features("good thing", 12, hashes)
    want = sum(float(model.weights[i]) for i in index) / len(index) ** 0.5 + model.bias
    assert abs(model.score("good thing", hashes) - 1 / (1 + np.exp(-want))) < 1e-9


# ---- quality rules


def plain_measures(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines), max((len(w.encode()) for w in words), default=0))


def rule_texts():
    rng = random.Random(9)
    return [None, "", " \n\t", "a", "a b a b a b", "a\x0bb\x1cc\xa0d", "é|# $\nx\nx\n \n\nx", "w " * 500] + ["".join(rng.choice("ab |\n") for _ in range(rng.randint(1, 80))) for _ in range(200)]


def test_measures_match_plain(monkeypatch):
    for wide in (1 << 21, 1):
        monkeypatch.setattr(quality_rules, "WIDE", wide)
        for t in rule_texts():
            assert quality_rules.measure(t) == plain_measures(t), repr(t)


def test_ledger_policies_and_ablations(spark):
    texts = rule_texts() + ["word%d " % (i % 7) * 60 for i in range(5)] + [" ".join("w%d" % j for j in range(80)) + " |" * (i * 10) for i in range(5)]
    docs = docs_of(spark, [(i // 2 if i else None, t, "en") for i, t in enumerate(texts)])
    book = quality_rules.ledger(docs)
    rows = book.withColumn("ok", quality_rules.passes(F.col("failed"), "v2")).collect()
    assert len(rows) == len(texts) and [n for n, _ in quality_rules.rules()] == list(quality_rules.RULE_NAMES)
    for r in rows:
        assert r["ok"] == (r["failed"] == 0) and bool(r["failed"] & 1) == (r["n_words"] < 50) and bool(r["failed"] & 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])
    for r in quality_rules.ablations(book).collect():
        bit = 1 << quality_rules.RULE_NAMES.index(r["rule"])
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in rows) and r["n_only"] == sum(x["failed"] == bit for x in rows)
    assert quality_rules.ledger(docs.where("false")).count() == 0 and quality_rules.ablations(book.where("false")).first()["n_only"] == 0


def test_rule_queries_match_sql(spark, tmp_path):
    from tests.llm.test_url_pii_mix_simhash import same_as_sql

    texts = rule_texts() + ["word%d " % (i % 7) * 60 for i in range(5)] + [" ".join("w%d" % j for j in range(80)) + " |" * (i * 10) for i in range(5)]
    docs = docs_of(spark, [(i // 2 if i else None, t, "en") for i, t in enumerate(texts)])
    same_as_sql(spark, tmp_path / "a", {"documents": docs}, quality_rules.op7_quality_rules, quality_rules.OP7_SQL)
    same_as_sql(spark, tmp_path / "b", {"documents": docs}, quality_rules.ledger_ablations, quality_rules.ABLATIONS_SQL)
    stored = quality_rules.write_ledger(docs, path=str(tmp_path / "ledger"))
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, quality_rules.ledger(docs).collect()))


def test_all_queries_on_small_tables(spark, tmp_path):
    """Every registered query on tables with nulls, repeated rows and further columns, and on empty ones."""
    from seqloom.llm.queries import ORACLES, QUERIES

    rows = two_languages(60, 6) + [(None, None, None), (None, "x y z", "aa"), (3, "a b", None), (3, "a b", None), (7, "", "aa")]
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)] + [(None, 1, 0, "x"), (5, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    pages = spark.createDataFrame([(1, "https://www.example.com/en/1", "h", "v"), (None, None, "h", "v"), (1, "x", None, None)], "page_id long, url string, html string, verdict string")
    embeddings = spark.createDataFrame([(20, [0.5, 1.0], 1), (20, [0.5, 1.0], 1), (None, [0.25, 2.0], 1), (3, None, None), (40, [1.0, float("nan")], 1)], "vec_id long, embedding array<float>, label int")
    assert set(ORACLES) <= set(QUERIES) and {f"op{n}" for n in range(1, 13)} <= {k.split("_")[0] for k in QUERIES}
    for folder, keep in (("full", "true"), ("empty", "false")):
        for name, df in (("documents", docs_of(spark, rows)), ("labels", labels), ("pages", pages), ("embeddings", embeddings)):
            df.where(keep).write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
        for name, fn in QUERIES.items():
            n = fn(spark, f"{tmp_path}/{folder}").count()
            if name != "ledger_ablations":
                assert n == (0 if folder == "empty" else {"op1_url_filters": 3, "op11_top_k": 4}.get(name, len(rows))), name


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = two_languages(120, 6)
    at, text, lang = max(rows, key=lambda r: len(r[1]))
    long = text.split()
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(2000, None, "aa"), (2001, "123", None), (2002, " ".join(long[::-1]) + " mail a@b.co now", lang), (2003, " ".join(long) + " tail", lang)]
    docs = docs_of(spark, rows)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, str(tmp_path)).cache()
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name != "bpe":
            assert kept.columns == docs.columns and set(ids) <= {r["doc_id"] for r in before.collect()}
        if name == "language_id":
            assert set(ids) == {i for i, t, _ in rows} - {2000, 2001}
        if name == "simhash_near_dedup":
            assert not set(ids) & set(range(1000, 1020)) and len(set(ids)) == len(ids)
            assert 2002 in ids and 2003 not in ids  # a text of its own; a copy with a tail
        if name == "pii":
            assert [r["text"] for r in kept.collect() if r["doc_id"] == 2002][0].endswith("mail [EMAIL] now")
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, kept.collect()))


def test_pipeline_on_empty_table(spark):
    docs = docs_of(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
