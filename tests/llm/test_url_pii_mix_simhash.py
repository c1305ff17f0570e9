import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import mixing, pii, simhash, url_filter
from seqloom.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, url string, size long, fp long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 2, 3) for i, t, s in rows], DOCS)


# ---- URL filters

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block"), (None, "/", "block"), ("bad", None, "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if h and p is not None and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = ["http://WWW.Example.com/en/1", "https://example.com/en/", "https://x.example.com/en/?q=/fr/", "https://a.net/es/#t", "https://net/fr/x", "https://netx/fr/x", "ftp://com", "https://com/", None, "", "no scheme", "https://.com/x", "https://a.dup.org/y", "https://a..com/", "http://a://b.com/", "https://É.COM/\nx", "https://" + "a." * 3000 + "com/" + "x" * 5000]


@pytest.mark.parametrize("broadcast", [512, 0])
def test_urls_match_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", broadcast)
    pages = spark.createDataFrame([(i // 2 if i else None, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = [tuple(r)[1:5] for r in url_filter.judge_urls(pages, rules).collect()]
    assert sorted(map(repr, got)) == sorted(repr(judge(u)) for u in URLS * 2)


def test_urls_many_shapes_and_long_urls(spark):
    path = "/" + "ab" * 1500
    rules = [("d%d.org" % (k % 3), path[:k], "block" if k % 2 else "allow") for k in range(1, 1201)] + [("org", "", "block"), ("x.d1.org", path, "allow")]
    urls = ["https://d%d.org%s" % (k % 4, path[: 7 * k]) for k in range(1, 300)] + ["https://a.x.d1.org" + path + "c", "https://x.d1.org/b", "https://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["rule_matches"]) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for k, u in enumerate(urls):
        host, _, rest = u.removeprefix("https://").partition("/")
        rest = "/" + rest if _ else ""
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and rest.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert got[k] == (best[2], best[3], len(fits)), u[:60]


def test_urls_query_matches_sql(spark, tmp_path):
    pages = spark.createDataFrame([(i // 2 if i else None, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    same_as_sql(spark, tmp_path, {"pages": pages.repartition(3)}, url_filter.op1_url_filters, url_filter.OP1_SQL)


def test_urls_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "https://net/es/")], "page_id long, url string")
    assert url_filter.judge_urls(one, rules.where("false"), default_verdict="block").first()["verdict"] == "block"


# ---- PII

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def pii_texts():
    rng = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "001.002.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+49", "12", "-", " ", "é😀", "\n", "a@b.co_x@d.com", "1.2.3.45.6.7.8", "+12+345678901", "5500-0000-0000-0004", "tel "]
    return [None, "", "😀" * 50 + " q@r.st", "9" * 3000, "a" * 5000, ("a@b.co " * 300), "a@" + "b." * 4000] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]


def test_pii_base_spans_match_plain_patterns(spark):
    texts = pii_texts()
    docs = docs_of(spark, [(i if i else None, t, None) for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["pii_spans"] for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        base = [(s["start"], s["rank"], s["end"], s["kind"]) for s in found[i if i else None] if s["kind"] in pii.BASE_KINDS]
        assert base == plain_spans(t), t


def test_pii_added_kinds_scores_and_redaction(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "ssn 123-45-6789", "no 123-45-6789", "card 4111111111111111 and 4111111111111111", "mail a@b.co!"]
    rows = pii.find_pii(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).withColumn("red", pii.redact(F.col("text"), F.col("pii_spans"))).orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in r["pii_spans"]] for r in rows]
    assert kinds == [["iban"], [], ["ssn"], [], ["card", "card"], ["email"]]
    assert rows[0]["red"] == "IBAN [IBAN]." and rows[4]["red"] == "card [CARD] and [CARD]" and rows[5]["red"] == "mail [EMAIL]!" and rows[3]["red"] == texts[3]
    assert rows[4]["pii_spans"][0]["score"] > rows[4]["pii_spans"][1]["score"]


def test_pii_context_is_read_from_the_text(spark):
    texts = ["SSN 123-45-6789, 234-56-7890, 345-67-8901", "ssn: 000-45-6789 or 123-45-6789", "ssn 123-45-6789" + "é" * 32 + " 234-56-7890 " + "-" * 33 + " 345-67-8901", "ssn" + "😀" * 45 + "123-45-6789", "ssn" + "😀" * 46 + "123-45-6789"]
    rows = pii.find_pii(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    want = []
    for t in texts:
        ssn = [m for m in re.finditer(r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)", t, re.ASCII) if not m[0].startswith("000")]
        want.append([(m.start(), m.end()) for m in ssn if re.search("(?<![a-z])ssn", t[max(0, m.start() - 48) : m.start()].lower())])
    assert [len(w) for w in want] == [3, 1, 2, 1, 0]
    assert [[(s["start"], s["end"]) for s in r["pii_spans"] if s["kind"] == "ssn"] for r in rows] == want


def test_pii_iban_ends_at_the_word_that_fits(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    whole = {
        f"IBAN {de} BIC COBADEFF": [de],
        f"{de} 100 EUR": [de],
        f"{de} {gb} {no} A": [de, gb, no],
        f"{de.replace(' ', '')} {gb.replace(' ', '')} X": [de.replace(" ", ""), gb.replace(" ", "")],
        f"REF AB12 CDEF 1234 {de} OK": [de],
        f"é😀 {no} NOK, {gb}.": [no, gb],
        f"{de[:-1]}1 BIC COBADEFF": [],
        f"{de} 100 EUR_": [de],
        f"{de}x": [],
        f"x{de} A": [],
        "DE89 3704 0044": [],
    }
    rows = pii.find_pii(docs_of(spark, [(i, t, "s") for i, t in enumerate(whole)])).orderBy("doc_id").collect()
    assert [[r["text"][s["start"] : s["end"]] for s in r["pii_spans"] if s["kind"] == "iban"] for r in rows] == list(whole.values())


def test_pii_query_digest(spark, tmp_path):
    texts = pii_texts()
    docs_of(spark, [(i, t, None) for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op2_pii(spark, str(tmp_path)).collect():
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def same_as_sql(spark, folder, tables, query, sql):
    """Whether a registered query and its SQL give the same rows over small tables."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    got, want = query(spark, str(folder)), con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_pii_query_matches_sql(spark, tmp_path):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    more = ["SSN 123-45-6789, 234-56-7890, 345-67-8901", "ssn" + "é" * 45 + "123-45-6789", "ssn" + "é" * 46 + "123-45-6789", f"IBAN {de} BIC COBADEFF", f"REF AB12 CDEF 1234 {de} OK {gb}", f"{de}x {gb}_", "DE89370400440532013000 AND MORE"]
    texts = [t for t in pii_texts() if t is None or len(t) < 2000] + more
    same_as_sql(spark, tmp_path, {"documents": docs_of(spark, [(i if i else None, t, None) for i, t in enumerate(texts)])}, pii.op2_pii, pii.OP2_SQL)


def test_pii_many_spans_in_one_text(spark):
    unit = "ssn 123-45-6789 é a@b.co "
    rows = pii.find_pii(docs_of(spark, [(1, unit * 50_000, "s")])).select(F.transform("pii_spans", lambda s: s["start"]).alias("starts"), pii.redact(F.col("text"), F.col("pii_spans")).alias("red")).collect()
    assert rows[0]["red"] == "ssn [SSN] é [EMAIL] " * 50_000
    assert rows[0]["starts"] == [len(unit) * i + at for i in range(50_000) for at in (4, 18)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 33])
def test_running_results(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(50) for _ in range(n)]
    got = spark.createDataFrame([(values,)], "v array<long>").select(pii.running(F.col("v"), lambda x, y: x + y), pii.running(F.col("v"), lambda x, y: F.greatest(x, y))).first()
    assert got[0] == [sum(values[: i + 1]) for i in range(n)] and got[1] == [max(values[: i + 1]) for i in range(n)]


def test_redaction_joins_overlaps(spark):
    spans = [(2, 0, 5, "email", 1.0), (3, 1, 4, "ip", 1.0), (4, 2, 9, "card", 1.0), (9, 3, 10, "phone", 1.0), (600, 0, 1200, "email", 1.0)]
    text = "é" * 1300
    row = spark.createDataFrame([(text, spans)], f"t string, s array<{pii._SPAN}>").select(pii.redact(F.col("t"), F.col("s"))).first()
    assert row[0] == "éé[EMAIL][PHONE]" + "é" * 590 + "[EMAIL]" + "é" * 100


# ---- mixing


def mix_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_targets_and_takes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "b", "c", None, "é"])) for i in range(600)] + [(None, None, "z"), (7, "x y\tz\x0b\nq", "zz")] + [(5, "one two", "a")] * 200
    got = mixing.plan_mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = mix_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 15.5
    again = mixing.plan_mix(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r) for r in again)))


def test_mixing_is_unequal_within_a_source(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([1, 4, 16, 64, 256])), "a" if i % 3 else "b") for i in range(4000)]
    plan = mixing.plan_mix(docs_of(spark, rows), source_weight=F.when(F.col("source") == "a", 1.0).otherwise(2.0)).collect()
    total = sum(r["size"] for r in plan)
    for source, share in (("a", 1 / 3), ("b", 2 / 3)):
        own = [r for r in plan if r["source"] == source]
        want = min(total * share, 3 * own[0]["source_size"])
        assert abs(own[0]["target"] - want) < 1e-6 and abs(sum(r["copies"] * r["size"] for r in own) - want) <= 128.5
        by = {}
        for r in own:
            by.setdefault(r["size"], []).append(r)
        e = {n: x[0]["expected"] for n, x in by.items()}
        assert abs(sum(r["expected"] * r["size"] for r in own) - want) < 1e-6 * want
        for n, x in by.items():
            # doubled from size to size up to the cap, and taken as often as expected
            assert abs(e[n] - min(3.0, e[1] * n**0.5)) < 1e-6 or e[n] == 3.0
            assert {r["copies"] for r in x} <= {int(e[n]), int(e[n]) + 1}
            assert abs(sum(r["copies"] for r in x) / len(x) - e[n]) < 0.1
    none = mixing.plan_mix(docs_of(spark, rows), source_weight=F.when(F.col("source") == "a", 1.0), doc_weight=F.lit(1.0)).collect()
    assert {(r["target"], r["copies"]) for r in none if r["source"] == "b"} == {(0.0, 0)}
    assert len({r["expected"] for r in none if r["source"] == "a"}) == 1


def test_mixing_odd_weights(spark):
    rows = [(i, "w " * (i % 9), "s") for i in range(40)] + [(50, "x y", "t")]
    docs = docs_of(spark, rows).withColumn("q", F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 5 == 1, -3.0).when(F.col("doc_id") % 5 == 2, 1e300).otherwise(F.lit(None)))
    got = mixing.plan_mix(docs, doc_weight=F.col("q")).collect()
    assert len(got) == 41 and all(0 <= r["copies"] <= 3 for r in got)
    for s in "st":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 4.5


def test_mixing_query_matches_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "b", "b", "b", "b", "c", None, "é"])) for i in range(600)] + [(None, None, "z"), (None, "p q", "z"), (7, "x y\tz\x0b\nq", "zz"), (8, None, "empty")] + [(5, "one two", "a")] * 20
    same_as_sql(spark, tmp_path, {"documents": docs_of(spark, rows)}, mixing.op9_mixing, mixing.OP9_SQL)


def test_mixing_salted_join_agrees(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), f"s{i % 5}") for i in range(100)]
    got = sorted(map(tuple, mixing.plan_mix(docs_of(spark, rows)).collect()))
    plain = mixing.join_small
    monkeypatch.setattr(mixing, "join_small", lambda *a, **k: plain(*a, **k | {"max_rows": 0, "salts": 3}))
    assert sorted(map(tuple, mixing.plan_mix(docs_of(spark, rows)).collect())) == got


def test_mix_repeats_rows_as_planned(spark):
    rng = random.Random(5)
    rows = [(i % 90, " ".join(["w"] * rng.randint(0, 9)), rng.choice("abc")) for i in range(120)] + [(None, None, None)]
    docs = docs_of(spark, rows).withColumn("copies", F.lit("own")).withColumn("target", F.col("doc_id")).withColumn("source_size", F.lit(None).cast("int"))
    mixed, plan = mixing.mix(docs), mixing.plan_mix(docs)
    assert mixed.columns == docs.columns and {r["copies"] for r in mixed.collect()} <= {"own"}
    want = {}
    for r in plan.collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    got = {}
    for r in mixed.collect():
        key = (r["doc_id"], r["source"], len((r["text"] or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_mixing_empty(spark):
    assert mixing.plan_mix(docs_of(spark, [])).count() == 0
    assert [r["copies"] for r in mixing.plan_mix(docs_of(spark, [(1, None, None)])).collect()] == [0]


# ---- SimHash


def plain_fp(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(items):
        for j in range(i):
            if bin(f ^ items[j][1]).count("1") <= 2:
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(items):
        best[root(i)] = min((x for x in (best.get(root(i)), d) if x is not None), default=None)
    return [(d, f, best[root(i)]) for i, (d, f) in enumerate(items)]


@pytest.mark.parametrize("few", [100_000, 0])
def test_simhash_matches_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "MAX_BROADCAST_LINKED", few)
    rng = random.Random(2)
    base = [" ".join(rng.choice(["aa", "Bb", "cc", "É", "dd", "ee"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts = [None, "", " \n", "One", "one two", "x" * 10000] + base + base[:10] + [b + " tail" for b in base[:20]] + [b.upper() for b in base[:5]]
    rows = [(1000 - i if i % 9 else None, t, "s") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    want = plain_components([(i, plain_fp(t)) for i, t, _ in rows])
    assert sorted(repr((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"])) for r in got) == sorted(map(repr, want))


@pytest.mark.parametrize("salted", [False, True])
def test_links_and_components_of_chains_and_balls(spark, monkeypatch, salted):
    from seqloom.llm import components

    if salted:
        plain = components.join_small
        monkeypatch.setattr(components, "SMALL", 0)
        monkeypatch.setattr(components, "join_small", lambda *a, **k: plain(*a, **k | {"max_rows": 0, "salts": 3}))
    rng = random.Random(1)
    chain, value = [], rng.getrandbits(64)
    for _ in range(25):
        chain.append(value)
        value ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    ball = [centre ^ 1 << b for b in range(64)]
    fps = list(dict.fromkeys(chain + ball + [rng.getrandbits(64) for _ in range(50)]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(table), "a", "b").collect()}
    want = {d: c for d, _, c in plain_components(list(zip(signed, fps)))}
    assert {d: got.get(d, d) for d in signed} == want


def test_keep_one(spark):
    rows = [(5, "a b c d e", "s"), (3, "a b c d e", "t"), (3, "a b c d e", "s"), (9, "q r s t u v", "s"), (None, "z z y x w", "s"), (None, "z z y x w", "s"), (2, None, "s"), (4, "", "s")]
    kept = simhash.keep_one(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["source"]) for r in kept) == [(0, "s"), (2, "s"), (3, "s"), (9, "s")]
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("few", [20_000, 0])
def test_keep_one_decides_by_group_not_by_id(spark, monkeypatch, few):
    plain = simhash.join_small
    monkeypatch.setattr(simhash, "join_small", lambda *a, **k: plain(*a, **k | {"max_rows": few, "salts": 3}))
    texts = [" ".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=40)) for i in range(50)]
    rows = [(None, t, s) for t in texts for s in ("t", "s")]
    rows += [(7, "A a b c", "s"), (7, "B d e f", "s"), (9, "B d e f", "r"), (7, "C g h i", "s"), (5, "C g h i", "t"), (8, None, "u"), (8, None, "s")]
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in simhash.keep_one(docs_of(spark, rows)).collect())
    assert kept == sorted([(0, t, "s") for t in texts] + [(7, "A a b c", "s"), (7, "B d e f", "s"), (5, "C g h i", "t"), (8, "", "s")])


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_components_of_every_radius(spark, radius):
    rng = random.Random(4)
    fps = list(dict.fromkeys([2, 5, 6, 7, -1, -2, -(1 << 63)] + [b ^ 1 << rng.randrange(7) ^ 1 << rng.randrange(7) for b in (1 << 20, 3 << 40, -9 << 50) for _ in range(9)]))
    want = {f: f for f in fps}
    for _ in fps:
        want = {f: min(want[g] for g in fps if ((f ^ g) & (1 << 64) - 1).bit_count() <= radius) for f in fps}
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius), "a", "b").collect()}
    assert {f: got.get(f, f) for f in fps} == want
    assert radius != 1 or want[7] == want[2] == 2


# ---- near copies by similarity


def word_shingles(text, n=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copies(rng, sizes, copies, damage):
    texts = []
    for n in sizes:
        words = ["w%d" % rng.randrange(3000) for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(copies):
            other = list(words)
            for _ in range(rng.randint(*damage(n))):
                other[rng.randrange(n)] = "z%d" % rng.randrange(10**6)
            texts.append(" ".join(other))
    return texts


def components_of(texts, similarity):
    sets, root = [word_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot", [2000, 10**9])
def test_similar_documents_are_found(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    if hot > 2000:
        monkeypatch.setattr(simhash, "_hot", lambda total: 3)
    rng = random.Random(11)
    texts = near_copies(rng, [60, 90, 150, 300, 500, 900] * 6, 5, lambda n: (0, max(1, n // 45)))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, rows), similarity=0.8).collect()}
    sets, want = components_of(texts, 0.8)
    pairs = [(i, j, jaccard(sets[i], sets[j])) for i in range(len(texts)) for j in range(i)]
    close, far = [(i, j) for i, j, s in pairs if s >= 0.8], [(i, j) for i, j, s in pairs if s < 0.1]
    sure = [(i, j) for i, j, s in pairs if s >= 0.85]
    assert len(sure) > 100 and sum(got[i] == got[j] for i, j in sure) >= 0.98 * len(sure)
    assert len(close) > 200 and sum(got[i] == got[j] for i, j in close) >= 0.9 * len(close)
    assert not any(got[i] == got[j] for i, j in far)
    # nobody is drawn in without someone at the similarity
    for i in range(len(texts)):
        if sum(c == got[i] for c in got.values()) > 1:
            assert max(jaccard(sets[i], sets[j]) for j in range(len(texts)) if j != i and got[j] == got[i]) >= 0.8


def with_passages(rng, shares, n, size=300):
    """n pairs of near copies for each share of a text that is a passage which all texts of that share have."""
    rows, pairs = [], []
    for share in shares:
        passage = ["p%d" % rng.randrange(10**6) for _ in range(int(size * share))]
        for _ in range(n):
            words = passage + ["w%d" % rng.randrange(10**6) for _ in range(size - len(passage))]
            other = list(words)
            for _ in range(rng.choice([1, 1, 2, 3])):
                other[rng.randrange(size)] = "z%d" % rng.randrange(10**6)
            pairs.append((len(rows), len(rows) + 1, share))
            rows += [" ".join(words), " ".join(other)]
    return rows, pairs


def test_near_copies_among_texts_that_share_a_passage(spark):
    rng = random.Random(21)
    texts, pairs = with_passages(rng, [0.0, 0.5, 0.7], 700)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(8), similarity=0.8).collect()}
    for share in (0.0, 0.5, 0.7):
        own = [(a, b) for a, b, s in pairs if s == share and jaccard(word_shingles(texts[a]), word_shingles(texts[b])) >= 0.85]
        assert len(own) > 600 and sum(got[a] == got[b] for a, b in own) >= 0.98 * len(own), share
    for a, b, _ in pairs:  # and nothing else is joined
        assert {got[a], got[b]} <= {a, b}


def test_groups_in_crowded_buckets(spark):
    """Large groups of copies that share a passage with many other texts stay whole, by whatever copies they have."""
    rng = random.Random(22)
    texts, _ = with_passages(rng, [0.6], 150, 200)
    passage = texts[0].split()[:120]
    groups = []
    for _ in range(5):
        words = passage + ["g%d" % rng.randrange(10**6) for _ in range(80)]
        own = []
        for _ in range(60):
            other = list(words)
            for _ in range(2):
                other[rng.randrange(200)] = "z%d" % rng.randrange(10**6)
            own.append(len(texts))
            texts.append(" ".join(other))
        groups.append(own)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), similarity=0.8).collect()}
    for own in groups:
        assert sum(got[i] == got[own[0]] for i in own) >= 59 or len({got[i] for i in own}) <= 2
    assert len({got[own[0]] for own in groups}) == 5


def test_nothing_below_the_similarity_is_joined(spark):
    rng = random.Random(23)
    texts = near_copies(rng, [120, 200, 400] * 40, 1, lambda n: (n // 50, n // 30))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), similarity=0.8).collect()}
    told = [(got[i] == got[i + 1], jaccard(word_shingles(texts[i]), word_shingles(texts[i + 1]))) for i in range(0, len(texts), 2)]
    assert all(s >= 0.8 for same, s in told if same) and sum(0.76 < s < 0.84 for _, s in told) > 20
    assert sum(same for same, s in told if s >= 0.8) >= 0.9 * sum(s >= 0.8 for _, s in told)


def test_similarity_of_short_texts_is_exact(spark):
    rng = random.Random(12)
    texts = near_copies(rng, [1, 2, 4, 5, 6, 8, 12, 20, 25, 30] * 4, 3, lambda n: (0, 1)) + [None, "", " \n"]
    texts += [t + " tail" for t in texts[:80] if t]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), similarity=0.8).collect()}
    _, want = components_of(texts, 0.8)
    split = sum(got[i] != got[w] for i, w in enumerate(want))
    joined = [(i, j) for i in range(len(texts)) for j in range(i) if got[i] == got[j] and want[i] != want[j]]
    assert split <= 1 and not joined


def test_keep_one_by_similarity(spark):
    rng = random.Random(13)
    texts = near_copies(rng, [200] * 10, 3, lambda n: (1, 2))
    rows = [(None if i < 20 else 100 - i, t, "s") for i, t in enumerate(texts)] + [(3, None, "s"), (4, "", "t")]
    kept = simhash.keep_one(docs_of(spark, rows), similarity=0.8).collect()
    _, want = components_of(texts, 0.8)
    assert len(kept) == len(set(want)) + 1 and kept[0].__fields__ == docs_of(spark, rows).columns
    assert simhash.keep_one(docs_of(spark, []), similarity=0.8).count() == 0 and simhash.near_duplicates(docs_of(spark, []), similarity=0.8).count() == 0
