"""Tests of the findings of the first review: values of any length, repeated and null rows, ids of other types, appended archives, bulk plans."""

import datetime
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import packing, pii, quality, simhash, substring, topk, warc
from tests.llm.test_llm import SF, TEXTS, brute_components, brute_fingerprint, fewest

KEY = "a key"


# --- pseudonyms against a plain version ----------------------------------------------


def noise(kind, i, x):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)


def feistel(kind, left, right, a, b):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + noise(kind, i, right)) % a
        else:
            right = (right + noise(kind, i, left)) % b
    return left, right


def letters(kind, value, classes=None):
    classes = classes or "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else c for c in value)
    if len(value) < 2:
        return value
    mid = math.ceil(len(value) / 2)

    def half(mine, other, kinds, i):
        h = hashlib.sha512(f"{KEY}|{kind}|{i}|{other}".encode()).digest()
        base = {"d": (48, 10), "n": (50, 8), "l": (97, 26), "u": (65, 26)}
        return "".join(chr(base[k][0] + (ord(c) - base[k][0] + h[j]) % base[k][1]) if k in base else c for j, (c, k) in enumerate(zip(mine, kinds)))

    left, right = value[:mid], value[mid:]
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = half(left, right, classes[:mid], i)
        else:
            right = half(right, left, classes[mid:], i)
    return left + right


def blocks(kind, value):
    return "".join(letters(kind, value[i : i + 128]) for i in range(0, len(value), 128))


def capitals(old, new):
    return "".join(n.upper() if o.isupper() else n for o, n in zip(old, new))


def test_pseudonyms_equal_a_plain_feistel(spark):
    r = random.Random(3)
    rows, want = [], []

    def add(old, new):
        rows.append(f"see {old} here")
        want.append(f"see {new} here")

    for _ in range(25):
        a = [r.randint(0, 255) for _ in range(4)]
        x, y = feistel("ip", a[0] * 256 + a[1], a[2] * 256 + a[3], 65536, 65536)
        add(".".join(map(str, a)), f"{x // 256}.{x % 256}.{y // 256}.{y % 256}")
        day = datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(pii.DAYS))
        n = (day - datetime.date(1900, 1, 1)).days
        x, y = feistel("date", n // pii.DAYS_B, n % pii.DAYS_B, pii.DAYS_A, pii.DAYS_B)
        new = datetime.date(1900, 1, 1) + datetime.timedelta(x * pii.DAYS_B + y)
        add(day.isoformat(), new.isoformat())
        add(day.strftime("%d.%m.%Y"), new.strftime("%d.%m.%Y"))
        area, group, serial = r.choice([1, 665, 667, 899, 123]), r.randint(1, 99), r.randint(1, 9999)
        x, y = feistel("ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        b = x // 99 + 1
        add(f"{area:03}-{group:02}-{serial:04}", f"{b + (b >= 666):03}-{x % 99 + 1:02}-{y + 1:04}")
        name = "".join(r.choice("abcXYZ019._-") for _ in range(r.randint(1, 300))).strip(".") + "q"
        add(f"{name}@mail.example.org", f"{capitals(name, blocks('mail', name.lower()))}@mail.example.org")
        body = "".join(r.choice("0123456789") for _ in range(14))
        check = lambda d: next(c for c in "0123456789" if sum(int(v) if i % 2 == 0 else sum(map(int, str(2 * int(v)))) for i, v in enumerate((d + c)[::-1])) % 10 == 0)
        new = "4" + letters("card", body)
        add("4" + body + check("4" + body), new + check(new))
        secret = "".join(r.choice("abcXYZ019") for _ in range(r.randint(8, 1000)))
        add(f"token={secret}", f"token={blocks('secret', secret)}")
        local = "2" + "".join(r.choice("0123456789") for _ in range(2)) + "5" + "".join(r.choice("0123456789") for _ in range(6))
        new = letters("phone", local, "nddndddddd")
        add(f"({local[:3]}) {local[3:6]}-{local[6:]}", f"({new[:3]}) {new[3:6]}-{new[6:]}")
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in pii.apply(df, KEY).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_long_values_leave_nothing_in_clear(spark):
    name, secret = "very.long" * 9 + "x" * 60, "Ab3" * 400
    jwt = ".".join(("eyJhbGciOiJIUzI1NiJ9", "aZ9" * 70, "Qw8" * 40))
    host = "a.b.c.d.e.f.g.h.i.j.k.example.com"
    rows = [f"mail {name}@example.com end", f"api_key: {secret} end", f"token={jwt} end", f"m {name[:20]}@{host} end", f"BOB@x.org bob@x.org Bob@x.org \x01 {'a' * 300}@b"]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.apply(df, KEY).collect()}
    assert [out[i]["n_pseudonyms"] for i in range(5)] == [1, 1, 1, 1, 3]
    for old, new in ((name, out[0]["text"]), (secret, out[1]["text"]), (jwt.split(".")[1], out[2]["text"]), (jwt.split(".")[2], out[2]["text"]), (name[:20], out[3]["text"])):
        assert not any(old[i : i + 12] in new for i in range(0, len(old) - 12, 6))
    assert [len(out[i]["text"]) for i in range(5)] == [len(t) for t in rows]
    big, small, mixed = (x.split("@")[0] for x in out[4]["text"].split(" ")[:3])
    assert big == small.upper() and mixed.lower() == small and mixed[0].isupper()
    with pytest.raises(ValueError):
        pii.apply(df, "")


# --- groups ----------------------------------------------------------------------------


def test_components_of_a_long_chain(spark):
    n = 10_000
    order = random.Random(1).sample(range(1, n), n - 1)
    edges = spark.createDataFrame([(i, i + 1) for i in order], "a long, b long").repartition(8)
    out = simhash.components(edges)
    assert out.count() == n - 1 and out.select("component").distinct().collect() == [(1,)]


def test_forest_by_quarters_equals_whole(monkeypatch):
    r = np.random.default_rng(5)
    a = r.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:100] ^ (np.uint64(1) << r.integers(0, 64, 100, dtype=np.uint64)), r.integers(0, 2**63, 50, dtype=np.uint64)])
    ids = np.arange(450)

    def sets():
        left, right = simhash.forest(a, ids[:300], b, ids[300:], 4, False)
        pairs = {frozenset(e) for e in zip(left.tolist(), right.tolist())}
        return brute_components([(i, i) for i in range(450)], lambda x, y: frozenset((x, y)) in pairs)

    whole = sets()
    monkeypatch.setattr(simhash, "WHOLE", 0)
    assert sets() == whole and len({*whole.values()}) < 450


@pytest.mark.parametrize("kind", ["string", "long"])
def test_near_duplicates_with_null_and_other_ids(spark, kind):
    base = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    name = (lambda i: f"d{i:04}") if kind == "string" else int
    rows = [(name(i), t) for i, t in enumerate(base)] + [(name(100 + i), t + " x") for i, t in enumerate(base[:10])] + [(None, base[3]), (None, "only here"), (None, "only here"), (name(7), base[7])]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = Counter((r["doc_id"], int(r["f"], 16), r["component_id"]) for r in simhash.near_duplicates(df, tile=8).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect())
    fps = [(k, brute_fingerprint(t, 4)) for k, (_, t) in enumerate(rows)]
    low = brute_components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[low[k]] = min(doc, least.get(low[k], doc))
    assert got == Counter((doc, fps[k][1], least.get(low[k])) for k, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_one_row_of_each_group_stays(spark, kind):
    r = random.Random(8)
    words = ["w%d" % i for i in range(3000)]
    base = [r.choice(words) for _ in range(200)]
    near = list(base)
    near[17] = "changed"
    name = (lambda i: f"d{i:04}") if kind == "string" else int
    rows = [(name(5), " ".join(base), "a"), (name(5), " ".join(base), "b"), (name(3), " ".join(near), "c"), (None, " ".join(base), "d"), (name(9), "alone here", None), (None, "nobody else", None), (None, "nobody else", None), (name(4), None, "e"), (None, "", "f")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, __row string")
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    assert Counter((x["doc_id"], x["text"]) for x in out.collect()) == Counter([(name(3), " ".join(near)), (name(9), "alone here"), (None, "nobody else"), (name(4), None)])


# --- passages ----------------------------------------------------------------------------


def brute_cut(rows, least):
    """rows: (doc_id, hash, text), repeated rows too.  Spans by the definition: units and short lines that an earlier rank or place has."""
    ranked = sorted(range(len(rows)), key=lambda k: rows[k][:2])
    seen_units, seen_lines, out = {}, {}, {}
    for at in ranked:
        doc, _, text = rows[at]
        spans = substring.units(text)
        keys = [substring.normal(text[a:b]) for a, b in spans]
        lines = substring.short_lines(text, spans, least)
        names = [substring.normal(text[spans[a][0] : spans[b - 1][1]]) for a, b in lines]
        flags, lined, mine, mine_lines = [], [False] * len(spans), set(), set()
        for x in keys:
            flags.append(x in seen_units or x in mine)
            mine.add(x)
        for x, (a, b) in zip(names, lines):
            if x in seen_lines or x in mine_lines:
                lined[a:b] = [True] * (b - a)
            mine_lines.add(x)
        found, run = [], []
        for k in range(len(spans) + 1):
            if k < len(spans) and (flags[k] or lined[k]):
                run.append(k)
                continue
            if run and sum(len(text[slice(*spans[i])].split()) for i in run) >= least:
                found.append((spans[run[0]][0], spans[run[-1]][1]))
            elif run:
                part = []
                for i in [*run, None]:
                    if i is not None and lined[i]:
                        part.append(i)
                    elif part:
                        found.append((spans[part[0]][0], spans[part[-1]][1]))
                        part = []
            run = []
        seen_units |= dict.fromkeys(mine)
        seen_lines |= dict.fromkeys(mine_lines)
        out.setdefault((doc, text), []).append(found)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_substring_equals_brute_force_on_repeated_rows(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = docs.where("doc_id % 7 = 0").union(docs.where("doc_id % 7 = 0")).union(docs.where("doc_id % 5 = 0").selectExpr("doc_id", "concat(text, ' And more of it.') as text"))
    short = spark.createDataFrame([(1, "Subscribe to our newsletter"), (2, "Subscribe to our newsletter"), (2, "Subscribe to our newsletter"), (3, "one two. three\nSubscribe to  our NEWSLETTER\nfour")], "doc_id long, text string")
    df = docs.union(more).union(short).where("text is not null")
    df = df.withColumn("doc_id", F.format_string("d%07d", "doc_id")) if kind == "string" else df
    rows = [(r["doc_id"], r["h"], r["text"]) for r in df.withColumn("h", F.xxhash64("text")).collect()]
    got = {}
    for r in substring.apply(df).collect():
        # The text after the cut is not the key, so the original comes from its spans' row.
        got.setdefault(r["doc_id"], []).append([(s["start"], s["stop"]) for s in r["spans"]])
    want = {}
    for (doc, _), found in brute_cut(rows, substring.MIN_WORDS).items():
        want.setdefault(doc, []).extend(found)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


# --- the rest ----------------------------------------------------------------------------


def test_topk_of_huge_components(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4) * 10.0 ** r.integers(-3, 200)]) for i in range(60)] + [(100, [1.7e308, -1.7e308]), (101, [1.7e308, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(df, F.col("id") % 10 == 0, k=5, tile=16, queries=4).collect()}
    whole = {i: [max(min(int(y) if math.isfinite(y) else int(math.copysign(topk.LARGEST, y)), int(topk.LARGEST)), -int(topk.LARGEST)) if math.isfinite(y) else int(math.copysign(topk.LARGEST, y)) for y in np.floor(1024 * np.array(e))] for i, e in rows}
    want = set()
    for i in whole:
        if i % 10 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(whole[i], v)), -(2**63)), 2**63 - 1), j) for j, v in whole.items() if j != i)[:5]
            want |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s)}
    assert got == want


def test_topk_of_equal_lengths(spark):
    r = np.random.default_rng(2)
    v = r.normal(0, 1, (300, 6))
    v = np.round(64 * v / np.linalg.norm(v, axis=1)[:, None]) / 64
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(df, F.col("id") % 50 == 0, tile=20, queries=3).collect()}
    w = {i: np.floor(1024 * np.pad(np.array(e), (0, 6 - len(e)))).astype(int) for i, e in rows}
    want = {(i, n + 1, j, -s) for i in w if i % 50 == 0 for n, (s, j) in enumerate(sorted((-int(w[i] @ x), j) for j, x in w.items() if j != i)[:10])}
    assert got == want


def test_warc_append_overwrite_and_urls(spark, tmp_path):
    path, long = f"file://{tmp_path}/w", "payload of many words " * 9
    page = lambda *rows: warc.planned(spark.createDataFrame([*rows], "page_id long, url string, html string"))
    urls = ["http://a/%41%zz", "  outer ", "a\r\nb\tc", "ü\u2028é\x85", ""]
    warc.write(page(*[(i, u, f"p{i}") for i, u in enumerate(urls)]), path)
    warc.write(page((9, "u", "late")), path)
    assert {r["page_id"]: r["url"] for r in warc.read(spark, path).collect()} == {**dict(enumerate(urls)), 9: "u"}
    warc.write(page((5, "x", long), (5, "y", long), (6, "z", long), (5, "w", "short"), (5, "w", "short")), path, "overwrite")
    out = warc.read(spark, path).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in out) == [(5, "response", 0), (5, "response", 0), (5, "response", 0), (5, "revisit", 5), (6, "revisit", 5)]
    rows = page((5, "w", "short"), (5, "w", "short")).collect()
    assert len({warc.record_id(r["page_id"], r["payload_digest"], r["copy"]) for r in rows}) == 2
    reader = warc.WarcReader(path, False)
    assert not [*reader.pushFilters([warc.GreaterThan(("page_id",), 5), warc.IsNotNull(("refers_to",)), warc.StringStartsWith(("url",), "z"), warc.LessThanOrEqual(("payload_bytes",), 10**6)])]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [6]
    assert warc.read(spark, path).where("page_id > 5 and url like 'z%' and refers_to is not null").count() == 1


def test_dominating_pairs_go_in_bulk():
    count = {1400: 100_000, 640: 100_000, 5: 3}
    slots = packing.plan(dict(count))
    assert sum(map(len, slots.values())) < 20
    r = random.Random(6)
    for _ in range(300):
        c = r.choice([12, 20])
        items = Counter(r.choices(range(1, c + 1), k=r.randint(1, 9)))
        rest = dict(items)
        fixed = packing.reduce(rest, c)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(left, c) == fewest([*items.elements()], c)


def test_quality_score_equals_a_naive_version(spark):
    net = quality.Net(3)
    net.shift = 0.3
    texts = ["", "short", "é" * 400 + " and more text", "abc " * 900]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    want = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        n = max(2, -(-len(raw) // quality.HALF))
        flat = np.zeros(n * quality.HALF + quality.TAIL, np.uint8)
        flat[: len(raw)] = raw
        hidden = []
        for c in range(n - 1):
            chunk = flat[c * quality.HALF : (c + 2) * quality.HALF + quality.TAIL]
            best = np.zeros(quality.FILTERS)
            for at in range(0, 2 * quality.HALF, quality.STRIDE):
                x = p["emb"][chunk[at : at + quality.WIDTH]].reshape(-1)
                best = np.maximum(best, x @ p["k"] + p["kb"])
            hidden.append(np.tanh(best @ p["w1"] + p["b1"]))
        h = np.array(hidden)
        z = np.concatenate([h.max(0), h.mean(0)]) @ p["w2"] + p["b2"][0] + net.shift
        want.append(1 / (1 + np.exp(-z)))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, net).collect()}
    assert np.allclose([got[i] for i in range(4)], want, atol=1e-4)


def test_quality_learns_from_every_chunk(spark, monkeypatch):
    rows = [(i, f"text {i} " + "plain words " * 4000 * (i % 3)) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    seen, laid, fit = [], quality.laid, quality.Net.fit
    monkeypatch.setattr(quality, "laid", lambda raw: seen.append(len(raw)) or laid(raw))
    monkeypatch.setattr(quality.Net, "fit", lambda net, texts, y: fit(net, texts, y, steps=2))
    quality.train(docs, labels)
    assert Counter(seen[:12]) == Counter(len(t) for _, t in rows)


def test_operators_leave_the_session_alone(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for k in keys:
        spark.conf.unset(k)
    before = [spark.conf.get(k) for k in keys]
    simhash.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    substring.apply(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    assert [spark.conf.get(k) for k in keys] == before


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, None), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, score string, __id string, quality_score double, n_units int, digest string, `a b` array<int>"
    rows = [(i, t, None, "s", None, "r", "q", "i", None, 3, "d", [1, None]) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], None, None, None, None, None, None, None, None, None, None), (None, "mail bob@x.org now", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    full, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, full, str(tmp_path))
        assert out.columns == full.columns and [f.dataType for f in out.schema] == [f.dataType for f in full.schema], name
        got = out.collect()
        assert len(got) <= len(rows), name
        if "dedup" not in name:
            assert len(got) == len(rows) or name == "quality classifier", name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    near = p.drop_near_copies(spark, full, str(tmp_path)).collect()
    assert sum(r["doc_id"] == 5 for r in near) <= 1 and sum(r["text"] in (None, "", " ", "\n\t ") for r in near) == 1
    packed = p.pack(spark, full, str(tmp_path))
    assert packed.groupBy("doc_id").agg(F.sum("length")).count() == len({r[0] for r in rows}) and p.pack(spark, empty, str(tmp_path)).count() == 0
