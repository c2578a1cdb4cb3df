from __future__ import annotations

import hashlib
import math
import random
import re
import time

import pytest

from framewright.llm import disclosure

SCHEMA = "doc_id long, text string, base string, rid int"
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    text = text or ""
    return {k: [(m.start(), m.end()) for m in r.finditer(text) if holds(k, m.group())] for k, r in RULES.items()}


ODD = [
    None, "", "a@b.co", "a@b", "x@y.z_c@d.ef", "é a.b+c@d-e.f.g é", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111111111111112", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "1  2 3-4--5", "日本 +44 20 7946 0958, a@b.cd", "a@b.c@d.e", "x%y@z.w.", "9" * 50_000, "a." * 30_000, "1." * 30_000, "+1-" * 9000,
    "4" * 16 + "." + "4242 4242 4242 4242" + "x" * 10,
]


def made(rng):
    letters = ["a", "b.", "@", ".", "c", "-", "_", "1", "22", "255", "4242 4242 4242 4242", "+", " ", "é", "(", "\n"]
    return "".join(rng.choice(letters) for _ in range(60))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(6)
    rows = list(enumerate(ODD + [made(rng) for _ in range(400)])) + [(2, "again a@b.co"), (None, "no id +1 555 123 4567")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    want = []
    for d, t in rows:
        found = base(t)
        names = [f"{k}:{a}:{b}" for k in RULES for a, b in found[k]]
        want.append((d, *[len(found[k]) for k in RULES], hashlib.sha256(",".join(names).encode()).hexdigest()))
    out = disclosure.personal_data(docs).collect()
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(",".join(s for s in r.spans.split(",") if s and not s.startswith("term:")).encode()).hexdigest() == r.base_sha256 for r in out)


@pytest.fixture(scope="module")
def corpus(spark):
    """"Wolfsberg" stands near one address only; "harbour" near it and in many other texts."""
    rng = random.Random(8)
    filler = "stone river cloud light table paper window garden silver bridge".split()
    texts = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(20)]
        words[8:10] = ["Wolfsberg", "harbour"] if i < 6 else [rng.choice(filler), "harbour" if i < 40 else "x"]
        words.insert(12, "k.lee@mail.example.org" if i < 6 else "plain")
        texts.append(" ".join(words))
    texts += [texts[0]] * 5
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_terms_that_disclose_an_entity(corpus):
    texts, docs = corpus
    out = {r.doc_id: r for r in disclosure.personal_data(docs).collect()}
    for i, t in enumerate(texts):
        terms = [s.split(":")[1:] for s in out[i].spans.split(",") if s.startswith("term:")]
        words = [t[int(a) : int(b)] for a, b in terms]
        assert words == (["Wolfsberg"] if "Wolfsberg" in t else []), words
        assert out[i].n_term == len(words)


def left_over(texts):
    """What brute force finds: for each text its disclosing terms with the bits they leave."""
    word = re.compile(r"[^\W\d_]+")

    def terms(t):
        return [(m.start(), m.end(), m.group().lower()) for m in word.finditer(RULES["email"].sub(lambda m: "0" * len(m.group()), t))]

    distinct = sorted(set(texts))
    n = len(distinct)
    held = {t: {f"{k}:{t[a:b].lower()}" for k, spans in base(t).items() for a, b in spans} for t in distinct}
    words = {t: {w for _, _, w in terms(t)} for t in distinct}
    with_term: dict = {}
    for t in distinct:
        for w in words[t]:
            with_term.setdefault(w, set()).add(t)
    sets = {frozenset(t for t in distinct if e in held[t]) for e in set().union(*held.values())}
    units = [(u, False) for u in sets] + [
        (frozenset(t for t in distinct if any(e.startswith(k + ":") for e in held[t])), True) for k in RULES
    ]
    found: dict = {t: {} for t in distinct}
    for unit, kind in units:
        if not unit:
            continue
        pseudo, prior = (8.0 if kind else 1.75), len(unit) / n
        for w in set().union(*(words[t] for t in unit)):
            both = len(unit & with_term[w])
            left = -math.log2((both + pseudo * prior) / (len(with_term[w]) + pseudo))
            content = -math.log2(prior)
            if left <= 0.7 and content > 0 and 1 - left / content >= 0.5:
                for t in unit if kind else distinct:
                    if w in words[t]:
                        found[t][w] = min(left, found[t].get(w, 9.0))
    return {t: [(a, b, "remove" if found[t][w] <= 0.35 else "generalise") for a, b, w in terms(t) if w in found[t]] for t in distinct}


def made_texts(rng):
    """Values in several texts, linked values, terms of every frequency, a term that also stands where the value does not."""
    filler = [f"w{c}x{d}".replace("w", "stone").replace("x", "r") for c in "abcdefgh" for d in "ijklmnopqrst"]
    texts = []
    for i in range(120):
        words = [rng.choice(filler) for _ in range(25)]
        if i % 6 == 0:
            words.insert(3, f"call +1 555 000 {1000 + i % 5}")
        if i % 10 == 3:
            words.insert(7, "Signature (Harbour-Office): ann.lee@mail.example.org, 10.20.30.40")
        if i % 10 == 4 and i < 20:
            words.insert(2, "harbour office")
        if i % 17 == 0:
            words.insert(9, f"unique{'abcdefghij'[i // 17]} x{i}@y.com")
        texts.append(" ".join(words))
    return texts + texts[:30] + ["", "Only Words", "ann.lee@mail.example.org"]


def test_added_spans_against_brute_force(spark):
    texts = made_texts(random.Random(11))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = left_over(texts)
    out = disclosure.personal_data(docs).collect()
    assert sum(r.n_term for r in out) > 50
    for r in out:
        got = [tuple(s.split(":")[:3]) for s in r.actions.split(",") if s]
        assert got == [(str(a), str(b), c) for a, b, c in want[texts[r.doc_id]]], texts[r.doc_id]
        assert r.n_term == len(got)
    actions = {a for spans in want.values() for _, _, a in spans}
    assert actions == {"remove", "generalise"}


def test_copies_count_once(spark):
    rng = random.Random(3)
    one = "some rare Quillfeather words before a.b@c.de and words after it"
    others = [f"other text {i} {rng.random()}" for i in range(30)]
    out = []
    for copies in (1, 9):
        docs = spark.createDataFrame(list(enumerate([one] * copies + others)), "doc_id long, text string")
        out.append({(r.spans, r.actions) for r in disclosure.personal_data(docs).collect() if r.n_email})
    assert out[0] == out[1] and "remove" not in out[0].pop()[1]


def test_sanitised_texts(corpus, spark):
    texts, docs = corpus
    hashes = {r.doc_id: r.sanitised_sha256 for r in disclosure.personal_data(docs).collect()}
    for r in disclosure.sanitise(docs).collect():
        want = texts[r.doc_id].replace("k.lee@mail.example.org", "[EMAIL]").replace("Wolfsberg", "")
        assert r.text == want
        assert hashes[r.doc_id] == hashlib.sha256(want.encode()).hexdigest()
    few = spark.createDataFrame([(1, "é a@b.co, 4111 1111 1111 1111!", "x", 1), (2, None, "x", 1)], SCHEMA)
    assert {r.doc_id: r.text for r in disclosure.sanitise(few).collect()} == {1: "é [EMAIL], [CARD]!", 2: ""}  # one text is no evidence against é


def test_many_matches_in_one_text(spark):
    """50,000 numbers and as many addresses: positions and edits take time in proportion."""
    numbers = " ".join(["4111 1111 1111 1111.", *["77."] * 50_000])
    addresses = " ".join(f"a{k}@b.co" for k in range(50_000))
    docs = spark.createDataFrame([(1, numbers), (2, addresses), (3, "é")], "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in disclosure.personal_data(docs).collect()}
    assert time.monotonic() - began < 60
    assert out[1].n_card == 1 and out[2].n_email == 50_000
    want = " ".join(["[EMAIL]"] * 50_000)
    assert out[2].sanitised_sha256 == hashlib.sha256(want.encode()).hexdigest()


def planted(spark, per_term):
    """The test table with texts in which a value and a term of its own share so many texts, and one term alone beside a value."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows, k = [], 1_000_000
    for term, n in per_term.items():
        for i in range(n):
            rows.append((k, f"note {i} about {term} and person.{term.lower()}@mail.example.org in entry {i * 7}"))
            k += 1
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")), {k for k, _ in rows}


def test_evidence_grows_with_shared_texts(spark):
    """One or two shared texts prove nothing, five are enough to generalise, fifty to remove; in the given table no value has so many."""
    terms = {"Lonehapax": 1, "Twicetold": 2, "Fivefold": 5, "Fiftyfold": 50}
    docs, ids = planted(spark, terms)
    done = {"Lonehapax": set(), "Twicetold": set(), "Fivefold": set(), "Fiftyfold": set()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in disclosure.personal_data(docs).collect():
        for action in filter(None, r.actions.split(",")):
            a, b, what, _ = action.split(":")
            word = texts[r.doc_id][int(a) : int(b)]
            if word in done:
                done[word].add(what)
            else:
                assert r.doc_id in ids, (r.doc_id, word)  # a word of the given table: its values stand in two texts at most
    assert done == {"Lonehapax": set(), "Twicetold": set(), "Fivefold": {"generalise"}, "Fiftyfold": {"remove"}}


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_plan_of_the_input_changes_nothing(spark):
    """A file scan, a shuffle whose rows come in any order, and a join."""
    docs, _ = planted(spark, {"Fivefold": 5, "Fiftyfold": 50})
    want = told(disclosure.personal_data(docs))
    assert any("remove" in str(r) for r in want)
    assert told(disclosure.personal_data(docs.repartition(7))) == want
    keys = docs.select("doc_id").distinct()
    assert told(disclosure.personal_data(docs.join(keys.hint("merge"), "doc_id"))) == want
    assert told(disclosure.sanitise(docs.repartition(5))) == told(disclosure.sanitise(docs))


def test_a_log_of_many_values_and_words_makes_no_product(spark):
    """10,000 addresses and 30,000 words in one text: their product would be 300 million rows."""
    log = " ".join(f"a{k}@b.co word{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}x{k}y" for k in range(10_000))
    docs = spark.createDataFrame([(1, log), (2, "a text beside it"), (3, "mail a5@b.co again")], "doc_id long, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in disclosure.personal_data(docs).collect()}
    assert time.monotonic() - began < 60 and out[1].n_email == 10_000 and out[3].n_email == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert disclosure.personal_data(docs).collect() == []
    assert disclosure.sanitise(docs).collect() == []
