import random

from horograph.llm import subjects as s

DOCS, LABELS, NAMES = "doc_id bigint, text string, subject string", "doc_id bigint, subject string, labelled_by string", "subject string, note string"
TERMS = {"alpha": ["ester", "zeolite", "amine salt", "resin"], "beta": ["rotor", "boiler", "fuel stack", "burner"], "gamma": ["racket", "score board", "treadmill", "helmet"]}


def text(rng, areas, claims=True, passing="alpha"):
    out = ["Device and method", "Abstract", f"The {rng.choice(TERMS[areas[0]])} is rigid. Unlike a {rng.choice(TERMS[passing])}, the cover needs none.", "Description"]
    for a in areas:
        out.append(" ".join(f"The {rng.choice(TERMS[a])} rests on a plate {k}." for k in range(4)))
    if claims:
        out.append("Claims")
        n = 0
        for a in areas:
            n += 1
            first = n
            out.append(f"{n}. A plate for a {rng.choice(TERMS[a])}, comprising a {rng.choice(TERMS[a])}.")
            for _ in range(3):
                n += 1
                out.append(f"{n}. The plate of claim {first}, further comprising a {rng.choice(TERMS[a])}.")
    return "\n".join(out)


def corpus():
    rng = random.Random(1)
    docs, labels, truth = [], [], {}
    for k in range(600):
        areas = rng.sample(list(TERMS), rng.choice([1, 1, 2]))
        docs.append((k, text(rng, areas, rng.random() < 0.9, rng.choice(list(TERMS))), "clash"))
        truth[k] = set(areas)
        if k % 3 == 0:
            labels += [(k, rng.choice([a, a.upper(), f" {a} "]), "r") for a in areas for _ in range(2)]
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    docs += [(9001, None, ""), (9002, "", ""), (9003, "Lapsed for non-payment.", "")]
    d, l, n = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, (5, "unknown", ""), (None, "alpha", ""), (4, None, "")], LABELS), spark.createDataFrame([(a, "") for a in TERMS], NAMES)
    areas = s.classify(d, s.learn(d, l, n))
    got = {}
    for r in areas.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [k for k in truth if k % 3]
    hit = sum(len(got.get(k, set()) & truth[k]) for k in held)
    assert hit / sum(len(got.get(k, ())) for k in held) > 0.95 and hit / sum(len(truth[k]) for k in held) > 0.95
    assert not {9001, 9002, 9003} & set(got)
    parts = {r["subject"]: r["documents"] for r in s.composition(d, areas).collect()}
    assert parts[None] >= 2 and sum(parts.values()) == areas.count() + parts[None]


def test_claims_in_their_styles():
    for body in ("Claims\n1. A x.\n2. The x of claim 1.\n3. A y.\nAbstract\nzz", "zz\n\nClaim 1: A x.\nClaim 2: The x of claim 1.\nClaim 3: A y.", "What is claimed is:\r\n1) A x,\r\nlong.\r\n2) The x of claim 1.\r\n3) A y."):
        groups, claims = s.units(body)
        assert claims and [len(g) for g in groups] == [2, 1]
    groups, claims = s.units("Abstract\nThe a is b. Unlike a c, it is d.\nDescription\n[0001] It is e.")
    assert not claims and len(groups) == 1 and len(groups[0]) == 3
    assert s.units("   *** CLAIMS" + " " * 90 + "\n1. A x.")[1]


def test_without_labels_or_documents(spark):
    d, n = spark.createDataFrame([(1, text(random.Random(2), ["alpha"]), "")], DOCS), spark.createDataFrame([("alpha", "")], NAMES)
    assert s.classify(d, s.learn(d, spark.createDataFrame([], LABELS), n)).count() == 0
    e = spark.createDataFrame([], DOCS)
    assert s.classify(e, s.learn(e, spark.createDataFrame([(1, "alpha", "")], LABELS), n)).count() == 0


def test_notes_name_terms(spark):
    assert s.note_words(["resins and salts", "rotors and boilers", None]) == {"resins": 0, "salts": 0, "rotors": 1, "boilers": 1}
    docs = [(k, f"Claims\n1. A {'resin' if k % 2 else 'rotor'} with thing {k}.", "") for k in range(6)]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, "alpha" if k % 2 else "beta", "") for k in range(6)], LABELS)
    bare = s.learn(d, l, spark.createDataFrame([("alpha", None), ("beta", None)], NAMES))
    noted = s.learn(d, l, spark.createDataFrame([("alpha", "a resin"), ("beta", "a rotor")], NAMES))
    assert not bare.terms and set(noted.terms) == {"resin", "rotor"}


def test_held_out_counts(spark):
    docs, labels, truth = corpus()
    rows = s.held_out(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), spark.createDataFrame([(a, "") for a in TERMS], NAMES))
    assert [r[0] for r in rows] == [True, False] and 40 < sum(r[1] for r in rows) < 100
    assert rows[0][4] > 0.9 * max(rows[0][2], rows[0][3])
