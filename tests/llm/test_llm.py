"""Operators for training data: exact ones against brute force, the others on cases with known answers."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellwright.llm import encode, fingerprints, leaks, names, personal, stuffing

VOCABULARY = Path(encode.TOKENIZER_DIR) / "byte_bpe_50k.json"


# formatting duplicates


def test_format_duplicates(spark):
    rows = [
        (5, "Ann Lee", "Bay-Town", 1), (2, "bay town", "ANN  LEE.", 1), (9, "ann lee", None, 1), (7, "annlee", "", 1), (1, None, "x", 1), (3, "--", "x", 1),
        (8, "Lee Ann", "Bay Town", 1), (4, "x", "x", 1), (6, "X.", "x!", 1), (10, "Zoë", "x" * 100_000, 1), (11, "zoë", "X" * 100_000, 1), (12, "Ann Lee", "Bay-Town", 1),
    ]
    df = spark.createDataFrame(rows, "id bigint, name string, city string, first_id int")
    got = {(r.first_id, r.id, r.copies) for r in fingerprints.format_duplicates(df, "id", [["name", "city"]], "name").collect()}
    assert got == {(2, 5, 3), (2, 12, 3), (7, 9, 2), (4, 6, 2), (10, 11, 2)}
    apart = {(r.first_id, r.id) for r in fingerprints.format_duplicates(df, "id", [["name"], ["city"]], "name").collect()}
    assert (2, 5) not in apart and (5, 12) in apart
    assert fingerprints.format_duplicates(df.filter("false"), "id", [["name", "city"]], "name").count() == 0


def test_hot_group(spark):
    from cellwright.operators.joins import join_representatives
    from cellwright.session import staged

    rows = spark.range(1000).selectExpr("id", "case when id < 400 then 1 else id end k")
    reps = staged(rows.groupBy("k").count().filter("count > 1").withColumnRenamed("count", "n"))
    assert join_representatives(rows, reps, ["k"], "n", hot=100).count() == 400


# encoding


@pytest.fixture(scope="module")
def bpe():
    if not VOCABULARY.exists():
        pytest.skip("no vocabulary here")
    return encode.PrefixEncoder(str(VOCABULARY))


@pytest.fixture(scope="module")
def truth():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_encoding_equals_library(bpe, truth, text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encode(text) == truth(text)


def test_encoding_appends_and_edits(bpe, truth):
    random.seed(2)
    for _ in range(200):
        word = "".join(random.choices("abcdeéñ漢", k=random.randint(1, 30)))
        cut = random.randint(0, len(word))
        head, rest = word[:cut].encode(), word[cut:].encode()
        table = bpe.append(head, bpe.last_tokens(head), rest)
        assert bpe._trace(table) == list(bpe._encode_word(word))
        text = " ".join("".join(random.choices("abc,", k=4)) for _ in range(6))
        at, removed, added = random.randint(0, len(text)), random.randint(0, 3), random.choice(["", "x y", "b"])
        new = text[:at] + added + text[at + removed :]
        got = bpe.encode_edit(text, bpe.words(text), at, removed, added)
        assert [i for w in got for i in w] == truth(new)


def test_encode_documents(spark, bpe, truth):
    texts = ["Hello world", None, "", "  ", "<|endoftext|>", "a" * 50_000, "Hello world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r.ids for r in encode.encode_documents(df, path=str(VOCABULARY)).collect()}
    assert got == {i: truth(t) if t else [] for i, t in enumerate(texts)}
    assert encode.encode_documents(df.filter("false"), path=str(VOCABULARY)).count() == 0


def test_rank_file_gives_the_same(bpe):
    ranks = VOCABULARY.with_suffix(".tiktoken")
    other = encode.PrefixEncoder(str(ranks))
    text = "Pack my box with five dozen liquor jugs; ¿qué? 漢字 1234\n\n"
    assert other.encode(text) == bpe.encode(text)


# leaks


def brute(docs, items, least):
    import regex

    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = set()
    for d, text in docs:
        words = split(text)
        grams = {tuple(words[i : i + least]) for i in range(len(words) - least + 1)}
        for i, item in items:
            w = split(item)
            if any(tuple(w[k : k + least]) in grams for k in range(len(w) - least + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(3, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs = []
    for d in range(120):
        words = random.choices(vocabulary, k=random.randint(0, 40))
        if d % 3 == 0:
            source = items[random.randrange(25)][1].split()
            at = random.randrange(len(source))
            words[5:5] = source[at : at + random.randint(2, 14)]
        docs.append((d, ", ".join(w.upper() if random.random() < 0.3 else w for w in words)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, "x " * 20_000 + items[0][1])]
    D = spark.createDataFrame(docs, "doc_id bigint, text string")
    I = spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    for least in (4, 6):
        got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(D, I, least=least).collect()}
        assert got == brute(docs, items, least)
    assert leaks.leaked_items(D.filter("false"), I).count() == 0 and leaks.leaked_items(D, I.filter("false")).count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, item.replace("six", "SIX!")), (2, item.replace("six", "other")), (3, " ".join(item.split()[:6]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {r.doc_id for r in leaks.proximity_matches(docs, items, least=10, slack=2).collect()} == {1, 2}
    assert {r.doc_id for r in leaks.leaked_items(docs, items, least=10).collect()} == {1}


def test_proximity_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 20))]) for i in range(12)]
    docs = []
    for d in range(90):
        text = rng.choices(vocabulary, k=rng.randint(0, 20))
        source = items[rng.randrange(12)][1]
        at = rng.randrange(len(source))
        text[3:3] = [w if rng.random() < 0.8 else "other" for w in source[at : at + rng.randint(3, 12)]]
        docs.append((d, text))
    docs.append((500, ["pad"] * 3000 + items[0][1]))

    def near(doc, item, least, slack):
        for k in range(-len(item), len(doc)):
            same = [0 <= k + p < len(doc) and doc[k + p] == w for p, w in enumerate(item)]
            if any(sum(same[p : p + least + slack]) >= least for p in range(len(item))):
                return True
        return False

    D = spark.createDataFrame([(d, " ".join(t)) for d, t in docs] + [(900, None), (901, "")], "doc_id bigint, text string")
    I = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(90, None)], "item_id bigint, text string")  # noqa: E741
    for least, slack in ((4, 1), (6, 2), (5, 0)):
        want = {(d, i) for d, t in docs for i, w in items if near(t, w, least, slack)}
        got = {(r.doc_id, r.item_id) for r in leaks.proximity_matches(D, I, least=least, slack=slack).collect()}
        assert got == want and want
    # the same without a broadcast: anchors and vocabulary beyond the limit
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(leaks, "TERMS", 7)
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(D, I, least=5).collect()} == want
    runs = {(r.doc_id, r.item_id): r.longest_run for r in leaks.leaked_items(D, I, least=3).collect()}
    assert runs[500, 0] == len(items[0][1])
    assert leaks.proximity_matches(D.filter("false"), I).count() == 0


# stuffed pages


PROSE = "The reader keeps every page in the folder, and when the clerk asks for a copy it is made before noon. Nobody could say why the second sheet was missing from the box. "
SPAM = {
    "keywords": "cheap label maker best label maker buy label maker new label maker " * 5,
    "mix": " ".join(random.Random(4).choices(["buy", "box", "free", "archive", "top"], k=90)),
    "links": "\n".join(f"Price list {i} - https://shop{i}.example/a?id={i}" for i in range(20)),
    "markup": "\n".join(f'<a href="https://shop{i}.example/list">best archive box</a>' for i in range(20)),
    "tags": ", ".join(["Timber", "new Freight", "lookup key", "Catering", "sale stamp", "Foods"] * 6),
    "menu": "Home | " + " | ".join(f"Item {x}" for x in "abcdefghijklmnop"),
}
FINE = {
    "prose": PROSE * 4,
    "table": "| item | price |\n|---|---|\n" + "\n".join(f"| Acme thing {x} | {i}.50 | {i} |" for i, x in enumerate("abcdefghij")),
    "log": "\n".join(f"2025-01-{i:02d} 10:00 INFO cleaner: {i} rows, total ok" for i in range(1, 20)),
    "code": "\n".join(f"def read_{x}(row, limit={i}):\n    return row['{x}'] or limit\n" for i, x in enumerate("abcdef")),
    "references": PROSE + "See also:\n- a: https://x.example/1\n- b: https://x.example/2",
    "csv": "item,vendor,total\n" + "\n".join(f"{i},Acme Freight Co,{i}.75" for i in range(1, 20)),
    "mostly prose": PROSE * 4 + SPAM["tags"],
}


def test_stuffing(spark):
    rows = list({**SPAM, **FINE, "null": None, "empty": "", "short": "buy buy buy"}.items())
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as words")
    got = {r.doc_id: r.is_spam for r in stuffing.stuffed_documents(df).collect()}
    assert {k for k, v in got.items() if v} == set(SPAM)
    long = stuffing.spam_share("word salad " * 40_000)
    assert long[3] > 0.9
    assert stuffing.stuffed_documents(df.filter("false")).count() == 0


# names


def test_parse():
    assert names.parse("The Zinmunbozon Packaging Intl. L.L.C.") == ("org", "zinmunbozon", "packaging")
    assert names.parse("GmbH Zinmunbozon Packagiing") == ("org", "zinmunbozon", "packaging")
    assert names.parse("Depot 12 Zinmunbozon Co") == ("org", "zinmunbozon", "#12")
    assert names.parse("Dr Zolpanner, Becky") == ("person", "zolpanner", "becky")
    assert names.parse("Z. Zolpanner") == ("person", "zolpanner", "z.")
    assert names.parse("RebeccaZolpanner") == ("person", "zolpanner", "rebecca")
    for nothing in ("Salzomport", "Hirthan Bay", "--", "12 34"):
        assert names.parse(nothing) is None


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_errors(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert names.errors(a, b, 9) == d[-1][-1]
    assert names.errors(a, a, 2) == 0 and 0 <= names.jaro_winkler(a, b) <= 1


def test_parties(spark):
    same = {
        "a": ["Zinmunbozon Packaging Group Ltd", "ZINMUNBOZON PACK. LTD", "Ltd Zinmunbozon Packaging", "Zinmunbzoon Packaging Grp"],
        "b": ["Zinmunbozon Bearings Ltd", "The Zinmunbozon Bear. Limited"],
        "c": ["Zinmunbozon Depot 12 SA"], "d": ["Zinmunbozon Depot 21 SA"],
        "e": ["Rebecca Zolpanner", "Becky Zolpanner", "Zolpanner, R.", "Dr Rebeca Zolpanner", "RZ Zolpanner"],
        "f": ["Henry Zolpanner", "Hank Zolpanner"],
    }
    rows = [(n,) for all_ in same.values() for n in all_] + [(None,), ("",), ("n/a",), ("V-123456",), ("Salzomport",), ("Salzomport",)]
    df = spark.createDataFrame(rows, "name string")
    cities = spark.createDataFrame([("Salzomport",), (None,)], "city string")
    key = lambda n: "".join(c for c in n.lower() if c.isalnum())
    members = names.party_of([df, df], cities)
    party = {r.key: r.party for r in members.collect()}
    assert set(party) == {key(n) for all_ in same.values() for n in all_}
    found = [{party[key(n)] for n in all_} for all_ in same.values()]
    assert all(len(x) == 1 for x in found) and len(set.union(*found)) == len(same)
    pairs = {(r.key_a, r.key_b) for r in names.variant_pairs(members).collect()}
    assert pairs == {(x, y) for all_ in same.values() for x in map(key, all_) for y in map(key, all_) if x < y}
    assert names.party_of([df.filter("false")], cities).count() == 0


def test_people_exchanged_with_cities(spark):
    names_ = ["HananKrimlirkrerthu", "HANNA KRIMLIRKRERTHU", "Patonhaven", "SamuelVurnumminstam", "Sam Vurnumminstam"]
    df = spark.createDataFrame([(n,) for n in names_], "name string")
    # one exchanged copy each time, a city that only looks like a name, and copies that are typed with spaces
    cities = spark.createDataFrame([(" Hanan Krimlirkrerthu",)] + [("Patonhaven",)] * 9 + [("Samuel Vurnumminstam",)] * 3, "city string")
    members = names.party_of([df], cities)
    pairs = {(r.key_a, r.key_b) for r in names.variant_pairs(members).collect()}
    assert pairs == {("hanankrimlirkrerthu", "hannakrimlirkrerthu"), ("samuelvurnumminstam", "samvurnumminstam")}
    assert "patonhaven" not in {r.key for r in members.collect()}


def spoiled(rng, word, times):
    for _ in range(times):
        i, kind = rng.randrange(len(word)), rng.randrange(4)
        word = [word[:i] + word[i + 1 :], word[:i] + rng.choice("aeioubdgklmnprst") + word[i:], word[:i] + rng.choice("aeioubdgklmnprst") + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]][kind]
    return word


def test_links_lose_no_accepted_pair(spark):
    """Against all pairs: words with one and two errors anywhere, and one block that half of the words share."""
    rng = random.Random(6)
    words = {"".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 7))) for _ in range(80)}
    words |= {spoiled(rng, w, n) for w in sorted(words) for n in (1, 1, 2, 2)}
    words |= {f"stegon{x}{y}rbim" for x in "abcdefghijklmnopqrst" for y in "abcdefghijklmnopq"} | {"wolf", "wulf", "wolk", "lee", "ann"}
    words = sorted(w for w in words if w)
    mains = spark.createDataFrame([("person", w, 1) for w in words], "kind string, main string, n bigint")
    found = {(r.a, r.b) for r in names.links(mains.repartition(3)).collect()}
    accepted = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 2 and names.alike(a, b)}
    assert len(accepted) > 5_000 and found <= accepted

    def parts(pairs):
        root = {w: w for w in words}

        def find(w):
            while root[w] != w:
                root[w] = w = root[root[w]]
            return w

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {w: find(w) for w in words}

    assert parts(found) == parts(accepted)
    assert ("wolf", "wulf") in accepted and ("wolf", "wolk") not in accepted
    # firms and persons are never linked; small batches and many small tasks find the same
    both = mains.withColumn("kind", names.F.expr("if(main < 'm', 'org', 'person')"))
    assert all((a < "m") == (b < "m") for a, b in ((r.a, r.b) for r in names.links(both).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert parts({(r.a, r.b) for r in names.links(mains).collect()}) == parts(accepted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert names.links(mains.filter("false")).count() == 0


def test_pairs_of_arrays_are_errors_of_words():
    rng = random.Random(9)
    a, b = ([("".join(rng.choices("abc", k=rng.randint(1, 7)))) for _ in range(2000)] for _ in range(2))
    assert names.errors_of(names._letters(a), names._letters(b)).tolist() == [names.errors(x, y, 20) for x, y in zip(a, b, strict=True)]
    for w in ("aabbccddee", "abc", "añb漢", "straße-weg"):
        _, keys = names.block_keys([w])
        assert len(keys) == 1 + len(names.shortened(w, 2 if len(w) >= names.LONG_WORD else 1))


def test_facets_by_index_are_those_of_all_pairs():
    rng = random.Random(8)
    pool = ["robert", "bob", "rob", "roberta", "alexander", "alexandre", "alex", "sasha", "lex", "ted", "theodore", "edward", "r.", "a.", "", "x.", "maximilian", "maximiliane", "max", "ann"]
    for _ in range(200):
        found = [(f, rng.randint(1, 5)) for f in rng.sample(pool, rng.randint(1, 12))]
        homes: dict[str, list[str]] = {}
        for f, _ in sorted((x for x in found if x[0] and not x[0].endswith(".")), key=lambda x: (-x[1], x[0])):
            home = next((p for p, own in homes.items() if any(names.same_given(f, o) for o in own)), f)
            homes.setdefault(home, []).append(f)
        got = names.facets("person", found)
        assert {f: h for f, h in got.items() if f and not f.endswith(".")} == {f: h for h, own in homes.items() for f in own}


def test_pairs_of_big_parties(spark, monkeypatch):
    monkeypatch.setattr(names, "CHUNK", 3)
    members = spark.createDataFrame([(f"k{i:02d}", 1) for i in range(20)] + [("z", 2)], "key string, party bigint")
    assert names.variant_pairs(members).count() == 190


def test_components(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in names.components(edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == "x"


# personal information


CASES = [
    ("Dear Ms Becky Stirrolez, the statement of 2025-01-02 is enclosed.", [("name", "Becky Stirrolez")]),
    ("Call +1 413 555 0179 ext. 204 and quote INV-579690.", [("phone", "+1 413 555 0179")]),
    ("mail solstula-i(at)krolez(dot)example if the total differs", [("email", "solstula-i(at)krolez(dot)example")]),
    ("Payee Joe Fivolska, 904-69-1956, account on hold.", [("name", "Joe Fivolska"), ("id_number", "904-69-1956")]),
    ("Deliver to 18 bis chemin de Dremnengroa, Bolport.", [("address", "18 bis chemin de Dremnengroa")]),
    ("Order PO-4471-262 replaces PO-4470-882. Lot 88 12 343 arrived in Hirthan Bay on 26.07.2026.", []),
    ("Delivery notes from Drergrorstals Ceramics Corp carry no date.", []),
    ("Article 7700 900 series, box of 73, 221.74", []),
]


def test_personal(spark):
    random.seed(7)
    given = ["Anna", "Robert", "Henry", "Olga", "Priya", "Ben"]
    filler = []
    for i in range(300):
        n = f"{random.choice(given)} {''.join(random.choices(['kral', 'stim', 'gor', 'len'], k=2)).title()}ska"
        filler.append(random.choice([f"Attn: {n}", f"Please ask for {n} at the goods desk.", f"cc {n}, accounts payable", f"Call ({random.randint(200, 999)}) 555-01{i % 90 + 10} ext. 204", f"mail user{i}@host{i}.example if the total differs", f"Payee {n}, 9{i % 90 + 10}-22-{1000 + i}, account on hold.", f"Deliver to {i + 1} Kralska Street, Bolport.", "The table lists item, quantity and price.", f"Run 3.14.2 of the parser read {i} cells from sheet {i}."]))
    rows = [("ir_elements", i, t, "") for i, (t, _) in enumerate(CASES)] + [("ir_elements", 1000 + i, t, "") for i, t in enumerate(filler)]
    rows += [("ir_elements", 5000, None, ""), ("ir_elements", 5001, "", ""), ("ir_elements", 5002, "plain words and " * 20_000 + CASES[1][0], "")]
    df = spark.createDataFrame(rows, "origin string, record_id bigint, text string, field string")
    got = {r.record_id: r for r in personal.personal_spans(df).collect()}
    for i, (text, want) in enumerate(CASES):
        assert sorted((x.kind, x.found) for x in got[i].found) == sorted(want), text
    assert got[0].redacted == "Dear Ms [NAME], the statement of 2025-01-02 is enclosed."
    assert got[5].redacted == CASES[5][0]
    assert got[5000].redacted is None and got[5001].redacted == "" and got[5002].found[0].found == "+1 413 555 0179"
    assert personal.personal_spans(df.filter("false")).count() == 0


def test_reliabilities():
    patterns = [("k", "222", 60), ("k", "220", 20), ("k", "111", 50), ("k", "112", 10), ("k", "010", 15), ("k", "211", 3)]
    p = personal.reliabilities(patterns)
    assert p["k", "222"] > 0.9 > 0.5 > p["k", "111"] and p["k", "220"] > 0.5 > p["k", "010"]
    assert personal.reliabilities([]) == {}
    one_sided = personal.reliabilities([("e", "22", 100), ("e", "20", 30)])
    assert min(one_sided.values()) > 0.5


def test_choose():
    assert personal.choose([(0.9, 0, 5, "name"), (0.95, 2, 5, "name"), (0.8, 4, 9, "address")]) == [(0, 5, "name")]
    rng = random.Random(11)
    for _ in range(500):
        spans = [(rng.random(), s, s + rng.randint(1, 5), rng.choice("ab")) for s in rng.choices(range(15), k=rng.randint(0, 8))]
        whole = [x for x in spans if not any(y[3] == x[3] and y[1] <= x[1] and x[2] <= y[2] and y[1:3] != x[1:3] for y in spans)]
        kept = []
        for _, s, e, kind in sorted(whole, key=lambda x: (-round(x[0], 2), x[1] - x[2], x[1])):
            if all(e <= s2 or e2 <= s for s2, e2, _ in kept):
                kept.append((s, e, kind))
        assert personal.choose(spans) == sorted(kept)
    many = [(0.9, 3 * i, 3 * i + 2, "name") for i in range(50_000)]
    assert len(personal.choose(many)) == 50_000


def test_names_of_several_words():
    found = lambda text: {text[s:e] for k, s, e, _, _ in personal.candidates(text) if k == "name"}
    assert "Anna Maria Schmidt" in found("Anna Maria Schmidt signed.")
    assert "José Luis García Pérez" in found("Signed by José Luis García Pérez, Friday")
    assert not any(len(x.split()) > 2 for x in found("Anna Kralska Robert Stimska") | found("Anna Kralska Packaging Group") | found("Payee Joe Fivolska QQ 12 34 56 A"))
    assert max(len(x.split()) for x in found("Anna " * 3000)) == personal.MOST_NAME_WORDS
