import hashlib
import random
import re

from pyspark.sql import functions as F

from pagelode.llm import pii

SCHEMA = "doc_id long, text string, row string, start int"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def check(spark, rows):
    got = pii.private_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = sorted((hashlib.sha256(",".join(plain(t)).encode()).hexdigest(), -1 if i is None else i) for i, t, *_ in rows)
    assert sorted((x["base_sha256"], -1 if x["doc_id"] is None else x["doc_id"]) for x in got) == want
    for x in got:
        base = [s for s in x["spans"].split(",") if s and not s.startswith("id:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == x["base_sha256"]
        assert [sum(s.startswith(k) for s in base) for k in pii.KINDS] == [x[f"n_{k}"] for k in pii.KINDS]
    return got


def test_base_on_random_text(spark):
    rng = random.Random(7)
    pieces = ["a.b@c.d", "@", "x@y", ".e", "1.2.3.4", "256.1.1.1", "001.2.3.004", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "-", " ", "é", "😀", "12", "007", "\n", "a+b%c@d-e.f.g", "5", ".", "+49 30 1234567"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 14))), "x", 1) for i in range(400)]
    rows += [(900, None, "x", 1), (901, "", None, None), (902, "1" * 30000, "x", 1), (903, "a" * 50000 + "@b.c", "x", 1), (904, "1 " * 20000, "x", 1), (905, "a." * 20000 + "@x" + ".y" * 20000, "x", 1), (None, "a@b.cc", "x", 1), (3, rows[3][1], "x", 1)]
    check(spark, rows)


def test_bootstrapping(spark):
    rows = [(i, f"ref {1000 + i} Token = \"{i:04d}abcdef\" end", "x", 1) for i in range(30)]
    rows += [(100 + i, f"vault key: {i:04d}abcdef and more", "x", 1) for i in range(8)]  # shares values with the seeds
    rows += [(200 + i, f"vault key: new{i:05d}zz and order no: {i}77777", "x", 1) for i in range(2)]
    rows += [(300, "mail me at a.b@c.de password=a@b.cd1 2024-01-01", "x", 1)]
    got = {x["doc_id"]: x for x in check(spark, rows)}
    assert got[3]["spans"] == "id:18:28" and got[3]["n_id"] == 1
    assert got[201]["spans"] == "id:11:21"
    assert got[300]["n_id"] == 0


def test_empty(spark):
    assert pii.private_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_base_kind_induces_patterns(spark):
    base = {"mailto": "a{}@b.cd", "host": "10.0.0.{}", "fon": "+49 (30) 12345{:02d}", "card": "4111 1111 1111 1111"}
    rows = [(i, f"{word}: {value.format(i)} end", "x", 1) for i, (word, value) in enumerate((w, v) for w, v in base.items() for _ in range(9))]
    rows += [(100 + i, f"some {word}: user{i}name end", "x", 1) for i, word in enumerate(base)]
    got = {x["doc_id"]: x for x in check(spark, rows)}
    assert [got[100 + i]["spans"] for i in range(3)] == [f"id:{len(f'some {w}: ')}:{len(f'some {w}: user0name')}" for w in ("mailto", "host", "fon")]
    assert got[103]["spans"] == ""  # one card alone is too little support


def test_rounds_go_on_until_nothing_more_passes(spark):
    # each pattern passes by the values that it shares with the one before
    rows = [(f"p{k}", f"s{i}") for k in range(6) for i in range(120)]
    rows += [(f"p{k}", f"v{n}x{i}") for k in range(6) for n in ([k, k + 1] if k else [1]) for i in range(40)]
    seeds = spark.createDataFrame([(f"s{i}",) for i in range(120)], "value string")
    got = pii.pattern_confidence(spark.createDataFrame(rows, "pattern string, value string"), seeds).collect()
    assert sorted(x["pattern"] for x in got) == [f"p{k}" for k in range(6)]


def test_values_are_whole_and_narrow_forms_count(spark):
    rows = [(i, f"password: {w}horse", "x", 1) for i, w in enumerate(["correct", "golden", "wooden", "little"])]
    word = "x_" * 20 + "token"
    rows += [(10 + i, f"{word}={'ab1' * 200}{i}", "x", 1) for i in range(4)] + [(20 + i, f"token = {'ab1' * 200}{i}", "x", 1) for i in range(4)]
    rows += [(30, "token=  \t\nabc1234", "x", 1), (31, "token= secret1: hidden_word, note: something", "x", 1), (32, "secret1 99887766", "x", 1)]
    rows += [(40, "token = " + "Ab1" * 30000, "x", 1), (41, "a" * 90000 + " \n" * 30000 + ":", "x", 1)]
    got = {x["doc_id"]: x["spans"] for x in check(spark, rows)}
    assert got[0] == "id:10:22" and got[10] == f"id:{len(word) + 1}:{len(word) + 602}" and got[20] == "id:8:609"
    assert got[30] == "id:10:17" and got[31] == "id:7:14" and got[32] == "" and got[40] == "id:8:90008"


def plain_confidence(pairs, seeds, least=3, sure=0.7):
    """The graph scores in plain code."""
    graph = set(pairs)
    keyed = lambda p: p[-1:] in (":", "=") and p[:-1] in pii.SEED_KEYS
    known = set(seeds) | {v for p, v in graph if keyed(p)}
    belief = {v: float(v in known) for _, v in graph}
    passing, before = {}, -1
    while len(passing) != before:
        before, passing = len(passing), {}
        for p in {p for p, _ in graph}:
            values = [v for q, v in graph if q == p]
            confidence = sum(belief[v] for v in values) / (len(values) + 0.5)
            if len(values) >= least and confidence >= sure:
                passing[p] = (confidence, len(values))
        if len(passing) != before:
            for v in belief:
                belief[v] = max([float(v in known), *(passing[p][0] for p, w in graph if w == v and p in passing)])
    return passing


def test_graph_scores_against_a_plain_model(spark):
    rng = random.Random(12)
    names = ["token=", "ref:", "no:", "badge", "case=", "the"]
    pairs = [(rng.choice(names), f"v{rng.randrange(60)}") for _ in range(260)]
    seeds = [f"v{i}" for i in range(0, 60, 2)]
    got = pii.pattern_confidence(spark.createDataFrame(pairs, "pattern string, value string"), spark.createDataFrame([(s,) for s in seeds], "value string"))
    want = plain_confidence(pairs, seeds)
    assert {x["pattern"]: (round(x["confidence"], 9), x["support"]) for x in got.collect()} == {p: (round(c, 9), n) for p, (c, n) in want.items()}
    assert len(want) >= 2


def test_planted_identifiers_behind_words_that_no_list_names(spark):
    """Precision and recall of the added spans: identifiers behind four unlisted words, digits behind four others."""
    rng = random.Random(5)
    value = lambda: "".join(rng.choices("abcdefgh", k=3)) + str(rng.randrange(10**6, 10**7))
    shared = [value() for _ in range(60)]
    rows, planted = [], set()
    for i in range(1500):
        kind = rng.choice(["token=", "badge: ", "dossier=", "client ", "Akte: "])
        v = rng.choice(shared) if rng.random() < 0.95 else value()
        text = f"words before {kind}{v} and after, "
        planted.add((i, text.index(v), text.index(v) + len(v)))
        text += rng.choice(["room ", "batch: ", "page ", "version="]) + f"x{rng.randrange(10**6)}y here"
        rows.append((i, text, "x", 1))
    got = set()
    for x in pii.private_spans(spark.createDataFrame(rows, SCHEMA)).collect():
        for s in filter(None, x["spans"].split(",")):
            kind, start, end = s.split(":")
            if kind == "id":
                got.add((x["doc_id"], int(start), int(end)))
    assert len(got & planted) / len(planted) > 0.95 and len(got & planted) / len(got) > 0.95


def test_ordinary_uses_count_against_a_word(spark):
    """Words that also stand before seeds pass neither alone nor with the word before, however many seeds follow."""
    rows = [(i, f"they wrote of 4111 1111 1111 11{i:02d} and to user{i}@site.org in the end", "x", 1) for i in range(40)]
    rows += [(100 + i, f"one of us, most of them, went to town and came to rest: part {i} of it, to wit of 708663{i:02d} here", "x", 1) for i in range(60)]
    got = check(spark, rows)
    assert sum(x["n_id"] for x in got) == 0
    assert sum(x["n_email"] for x in got) == 40


def test_two_words_pass_where_the_last_alone_is_ordinary(spark):
    """Values that never recur, found behind a pair of words that stands before seeds."""
    rows = [(i, f"ask. client contact user{i}@site.org or call", "x", 1) for i in range(40)]
    rows += [(100 + i, f"ask. Client  contact zx{i}k{i * 7919} or call", "x", 1) for i in range(8)]
    rows += [(200 + i, f"the contact lens, a contact sport and contact qq{i}w{i * 104729} twice", "x", 1) for i in range(60)]
    got = {x["doc_id"]: x for x in check(spark, rows)}
    assert all(got[100 + i]["spans"] == f"id:21:{21 + len(f'zx{i}k{i * 7919}')}" for i in range(8) if len(f"zx{i}k{i * 7919}") >= 6)
    assert all(got[200 + i]["n_id"] == 0 for i in range(60))


def test_occurrences_against_plain_counting(spark):
    rng = random.Random(3)
    pieces = ["the", "of", "Ref", "x_y", ":", " : ", "=", "= '", " ", "  ", "\n", "12", "é", ",", "a"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    want = {}
    for t in texts:
        t = t or ""
        word = r"(?<![A-Za-z0-9_])[A-Za-z_]{2,}(?![A-Za-z_])"
        for m in re.finditer(word, t):
            for tail in (r"\s*[:=]|\s+", r"\s+[A-Za-z_]{2,}(?![A-Za-z_])(?:\s*[:=]|\s+)"):
                rest = re.match(rf"(?:{tail})", t[m.end():])
                if rest:
                    key = re.sub(r"\s*([:=])", r"\1", m[0].lower() + rest[0].lower())
                    key = re.sub(r"\s+", " ", key).rstrip()
                    want[key] = want.get(key, 0) + 1
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = spark.createDataFrame([(k,) for k in want], "pattern string")
    for most in (10**6, 0):
        got = {x["pattern"]: x["occurrences"] for x in pii.occurrences(docs, asked, most=most).collect()}
        assert got == want


def test_words_of_a_run_are_found_at_once(spark):
    """One search for words and pairs alike, also in runs far longer than any stack."""
    text = "The  ref : x1 of\tUs ab=cd ef. " + "word " * 60_000 + "end:\n= gh"
    docs = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = [r["w"] for r in docs.select(pii._words(F.col("text")).alias("w")).collect()]
    assert got == [[["the", "ref:"], ["of", "us", "ab="], ["cd"], ["word"] * 60_000 + ["end:"]], [[""]], [[""]]]
    asked = spark.createDataFrame([("word",), ("word word",), ("word end:",), ("",), ("ref: x",)], "pattern string")
    assert {tuple(r) for r in pii.occurrences(docs, asked.where("pattern <> ''")).collect()} == {("word", 60_000), ("word word", 59_999), ("word end:", 1)}
