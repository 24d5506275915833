
import random

from quadrille.llm import pii, queries, simhash, substring


def pseudonyms(spark, texts):
    rows = pii.apply(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    return [(r["text"], r["n_pseudonyms"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_secret_after_a_line_break(spark):
    out = pseudonyms(spark, ["token:\nSomething1 end", "password\n=\r\n\"hunter2hunter\"", "password: Something1", "token:\nSomething"])
    assert [n for _, n in out] == [1] * 4
    assert out[0][0].startswith("token:\n") and out[0][0].endswith(" end") and "Something1" not in out[0][0]
    assert out[1][0].startswith("password\n=\r\n\"") and "hunter2hunter" not in out[1][0]
    assert out[0][0][7:17] == out[2][0][10:]


def test_secret_names_in_capitals_and_long_values(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "aB3" * 90 + "." + "Zz9" * 20
    out = pseudonyms(spark, ['TOKEN = "9233A8EC77"', "Token: 9233A8EC77.", f"API_KEY={jwt}. End", f'password="{jwt}"', "secret: " + "q" * 128 + " x"])
    assert [n for _, n in out] == [1] * 5
    value = out[0][0][9:-1]
    assert out[0][0] == f'TOKEN = "{value}"' and out[1][0] == f"Token: {value}." and value != "9233A8EC77"
    new = out[2][0].removeprefix("API_KEY=").removesuffix(". End")
    assert len(new) == len(jwt) and out[3][0] == f'password="{new}"'
    assert all(new[i : i + 12] != jwt[i : i + 12] for i in range(0, len(jwt) - 12, 12)) and [i for i, c in enumerate(new) if c == "."] == [i for i, c in enumerate(jwt) if c == "."]
    assert len(out[4][0]) == len("secret: ") + 130


def test_cards_beside_short_numbers_and_spaced_ibans(spark):
    card, iban = "4111111111111111", "DE89370400440532013000"
    texts = [card, f"{card} 123", "4111 1111 1111 1111 12/27", f"1 {card}", f"12 34 4111 1111 1111 1111 10.20.30.40 and {card} 5500000000000004", "x 12 4111-1111-1111-1111 555-223-4567"]
    texts += [iban, "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00 EUR", f"ES91 2100 0418 4502 0005 1332 2024 {card}", "12 34 56 78 90 12 34 56 78 91 and DE88 3704 0044 0532 0130 00"]
    out = pseudonyms(spark, texts)
    new, four = out[0][0], lambda s, by=" ": by.join(s[i : i + 4] for i in range(0, len(s), 4))
    assert new != card and [n for _, n in out] == [1, 1, 1, 1, 4, 2, 1, 1, 1, 2, 0]
    assert [t for t, _ in out[1:4]] == [f"{new} 123", f"{four(new)} 12/27", f"1 {new}"]
    assert out[4][0].startswith(f"12 34 {four(new)} ") and f" and {new} " in out[4][0] and "10.20.30.40" not in out[4][0] and "5500000000000004" not in out[4][0]
    assert out[5][0].startswith(f"x 12 {four(new, '-')} ") and "555-223-4567" not in out[5][0]
    assert out[7][0] == four(out[6][0]) != texts[7] and out[8][0] == f"{out[7][0]} EUR"
    assert out[9][0].endswith(f" 2024 {new}") and "2100 0418" not in out[9][0] and out[10][0] == texts[10]


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_are_confirmed_by_shingle_sets(spark, monkeypatch):
    r = random.Random(5)
    words = ["w%d" % i for i in range(5000)]
    rows = []
    for size in (30, 43, 60, 150, 400):
        for edits in range(1, 9):
            base = [r.choice(words) for _ in range(size)]
            rows.append(" ".join(base))
            for i in r.sample(range(size), max(1, edits * size // 250)):
                base[i] = r.choice(words)
            rows.append(" ".join(base))
    rows += ["one " * 300 + "alpha beta gamma", "one " * 300 + "delta eps zeta"]
    low = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            if jaccard(a, rows[j]) >= 0.8 and low[i] != low[j]:
                x, y = sorted((low[i], low[j]))
                low = [x if v == y else v for v in low]
    assert sum(v != i for i, v in enumerate(low)) >= 10 and sum(0.6 <= jaccard(rows[i], rows[i + 1]) < 0.8 for i in range(0, 80, 2)) >= 5
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for block in (simhash.BLOCK, 1):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {x["doc_id"]: x["component_id"] for x in simhash.similar(df).collect()}
        assert got == dict(enumerate(low))


def test_repeated_short_lines_go(spark, tmp_path):
    import re

    texts = ["All rights reserved.\nfirst text of its own here. Yes. Yes.\n---", "second. Yes. No.\nALL  rights reserved.\n---", "Yes. No.\nthird\nYes. No.\n\nAll rights reserved. third", "---\nthird\n---\nfourth", "   \n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op4_substring(spark, str(tmp_path)).collect()}
    assert [rows[i]["text"] for i in range(5)] == [texts[0], "second. Yes. No.\n", "Yes. No.\nthird\n\nAll rights reserved. third", "fourth", "   \n\n"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen, again = set(), 0
    for r in substring.apply(docs, whole_lines=True).orderBy("doc_id").collect():
        for line in filter(None, (" ".join(x.casefold().split()) for x in re.split("\n", r["text"] or ""))):
            again += line in seen and len(line.split()) < substring.MIN_WORDS
            seen.add(line)
    assert again == 0
