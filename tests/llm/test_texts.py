"""Leakage and personal information: planted passages, spans and their replacement."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from tallyloom.llm import leakage, pii

WORDS = [a + b for a in ("bar", "cel", "dor", "fen", "gal", "hul", "jin", "kor", "lam", "mel") for b in ("ato", "ibe", "unk", "ope", "est", "ith", "ang", "oll")]


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def damaged(r, words):
    """About one word in ten replaced, misread or followed by another."""
    out = []
    for w in words:
        x = r.random()
        out += [r.choice(WORDS)] if x < 0.04 else [w.replace("l", "1").replace("o", "0")] if x < 0.07 else [w, "7"] if x < 0.1 else [w]
    return out


DRESS = [
    lambda t: t,
    str.upper,
    lambda t: t.replace(" ", "  ").replace("a", "а"),  # Cyrillic
    lambda t: "<b>" + t.replace(" k", "</b> <i>k</i>") + "</b>",
    lambda t: t.replace(" ", ",\n"),
    lambda t: " ".join(w[:3] + "-\n" + w[3:] if i % 7 == 3 else w for i, w in enumerate(t.split(" "))),
]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    items = [(i, " ".join(prose(r, 60))) for i in range(40)]
    docs, truth = [], set()
    for d in range(300):
        body = prose(r, 200)
        if d % 3 == 0:
            i = r.randrange(40)
            n = r.choice([24, 30, 60])
            a = r.randrange(61 - n)
            words = items[i][1].split()[a : a + n]
            body[100:100] = [DRESS[d % len(DRESS)](" ".join(words if d % 2 else damaged(r, words)))]
            truth.add((i, 1000 + d))
        elif d % 3 == 1:  # too short to count
            i = r.randrange(40)
            body[50:50] = items[i][1].split()[20:34]
        docs.append((1000 + d, " ".join(body), d))
    docs += [(5000, None, 0), (5001, "", 0), (5002, "x", 0), (5003, "word " * 200_000 + items[3][1], 0), (5004, items[4][1], 0), (5004, items[4][1], 0)]
    truth |= {(3, 5003), (4, 5004)}
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame([*items, (77, None), (78, ""), (79, "too short"), items[0]], "item_id bigint, text string"), truth


def test_leaks(corpus):
    docs, items, truth = corpus
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(docs, items).collect()}
    assert got <= truth
    assert len(got) >= 0.97 * len(truth)


def test_leaks_without_broadcasts(corpus, monkeypatch):
    docs, items, _ = corpus
    want = sorted(map(tuple, leakage.leaks(docs, items).collect()))
    monkeypatch.setattr(leakage, "small", lambda df, rows=0: df)
    assert sorted(map(tuple, leakage.leaks(docs, items).collect())) == want
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_long_items_and_short_words(spark):
    r = random.Random(8)
    long = [f"{r.choice(WORDS)}{i}x" for i in range(5000)]
    letters = "a b d f g h j k m n p q r s t u v w x y"
    items = spark.createDataFrame([(1, " ".join(long)), (2, letters)], "item_id bigint, text string")
    docs = spark.createDataFrame([(10, " ".join(long)), (11, " ".join(prose(r, 50) + long[10:60] + prose(r, 50))), (12, letters), (13, " ".join(prose(r, 3000) + long[:4096]))], "doc_id bigint, text string")
    got = {(x["item_id"], x["doc_id"]): x["covered"] for x in leakage.leaks(docs, items).collect()}
    assert got == {(1, 10): 5000, (1, 11): 50, (2, 12): 20, (1, 13): 4096}


def test_winnowing_guarantee():
    """Every run of K + WINDOW - 1 shared words holds a kept fingerprint of the text."""
    r = random.Random(3)
    for _ in range(200):
        h = np.array([r.randrange(50) for _ in range(r.randrange(1, 60))], np.uint64)
        kept = set(leakage.winnow(h, leakage.WINDOW).tolist())
        for a in range(len(h) - leakage.WINDOW + 1):
            assert kept & set(range(a, a + leakage.WINDOW))


def test_alignment_counts():
    item = np.arange(1, 41)
    doc = np.array([90, 91, *range(5, 15), 99, *range(16, 20), 98, *range(20, 36), 92])
    first, last, matched = leakage.align(item, doc)
    assert (item[first], item[last], matched) == (5, 35, 30)
    assert leakage.align(item, np.full(10, 99)) == (0, -1, 0)
    long = np.arange(1, 5001)
    assert leakage.align(long, long) == (0, 4999, 5000) and leakage.align(long, long[10:60]) == (10, 59, 50)
    with pytest.raises(ValueError, match="split items"):
        leakage.align(np.zeros(leakage.MOST_WORDS), long[:3])


TEXT = """(72) Inventor: Kesto Brellarde, 73 Kestrel Lane, Kandapur ZZ6 8QQ
The sample was prepared by MORVELD, Kesto (identity no. 000-82-8673) and sent to P.O. Box 12, Quillon. Reach them under +44 7700 900764 or
kesto.brellarde@example.org, once kesto.morveld (at) example (dot) org. The Brellarde valve opened at 64.1 bar; Brellarde & Partner GmbH paid. ISO 00391-8:2009 applies, table 12-34-5678."""


def people(r):
    given = [a + b for a in ("Kes", "Bri", "Yol", "Tis") for b in ("to", "lim", "wen", "nta")]
    family = [a + b for a in ("Brell", "Morv", "Kand", "Sorr") for b in ("arde", "eld", "holt", "ovic")]
    return r.choice(given), r.choice(family)


@pytest.fixture(scope="module")
def letters(spark):
    r = random.Random(4)
    rows, truth = [], set()
    phone = lambda: r.choice([f"+44 7700 900{r.randrange(100, 999)}", f"01.99.00.{r.randrange(10, 99)}.{r.randrange(10, 99)}", f"030/23125-{r.randrange(100, 999)}"])
    ident = lambda: r.choice([f"000-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", f"00 {r.randrange(100, 999)} {r.randrange(100, 999)} {r.randrange(100, 999)}", f"ZZ00{r.randrange(10000, 99999)}"])
    for d in range(1200):
        (g, f), (g2, f2) = people(r), people(r)
        name = r.choice([f"{g} {f}", f"{f.upper()}, {g}", f"{g[0]}. {f}", f"{g} von {f}"])
        p, i, mail = phone(), ident(), r.choice([f"{g2}.{f2}@example.org".lower(), f"ip-{f2.lower()} (at) example (dot) net"])
        street = r.choice([f"{r.randrange(1, 99)} Weaver Road, Tamsel ZZ4 8QQ", f"Quarrystraße {r.randrange(1, 99)}, 00965 Nordhaven", f"Plot {r.randrange(1, 99)}, Sector 11A\nHarrowmere 000959"])
        rows.append((d, f"The sample was prepared by {name} (identity no. {i}) and sent to {street}. Ask under {p} today. Write to {mail} then. The {f} valve has table 12-34-5678 inside.", "doc"))
        truth |= {(d, "NAME", name), (d, "ID_NUMBER", i), (d, "PHONE", p), (d, "EMAIL", mail), (d, "ADDRESS", street)}
    rows += [(9000, None, "doc"), (9001, "", "doc"), (9002, "plain " * 100_000, "doc")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, start string"), truth


def test_personal_information(letters):
    docs, truth = letters
    found = pii.find_pii(docs).cache()
    got = {(r["doc_id"], r["pii_type"], r["pii_text"]) for r in found.collect()}
    assert len(got & truth) / len(got) >= 0.98
    for kind in pii.TYPES:
        of = {x for x in truth if x[1] == kind}
        assert len(of & got) / len(of) >= 0.95, kind
    masked = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs, found).collect()}
    assert len(masked) == docs.count() and masked[9000] is None and masked[9002] == "plain " * 100_000
    whole = sum(t.startswith("The sample was prepared by [NAME] (identity no. [ID_NUMBER]) and sent to [ADDRESS]. Ask under [PHONE] today. Write to [EMAIL] then. The ") for t in masked.values() if t)
    assert whole >= 0.9 * 1200
    assert pii.replace_pii(docs, found.limit(0)).where("text like '%[NAME]%'").count() == 0
    found.unpersist()


def test_long_spans_are_not_cut():
    """Windows grow until a match does not touch them."""
    local, street = "a" * 200, "Q" + "u" * 120
    text = f"write to {local}@{'example.' * 40}org now, or to {street} {street} Strasse, i.e. 12 {street} {street} Road, Tamsel ZZ4 8QQ. " + " " * 500 + "Kesto Brellarde said"
    got = {(k[0], k[2]) for k in pii.candidates(text)}
    assert {("email", f"{local}@{'example.' * 40}org"), ("address", f"12 {street} {street} Road, Tamsel ZZ4 8QQ"), ("name", "Kesto Brellarde")} <= got
    name = next(k for k in pii.candidates(text) if k[2] == "Kesto Brellarde")
    assert name[4] == "qq ." or name[4].endswith(".")  # the words before it, across the blanks


def test_only_unmistakable_spans_are_seeds():
    seeds = {k[2]: k[9] for k in pii.candidates("the 3 Claim Way, a.b (at) c.org, d@e.org; 5 Weaver Road, Tamsel ZZ4 8QQ; 12-345-6789")}
    assert seeds["3 Claim Way"] is None and seeds["a.b (at) c.org"] is None and seeds["12-345-6789"] is None
    assert seeds["d@e.org"] == "EMAIL" and seeds["5 Weaver Road, Tamsel ZZ4 8QQ"] == "ADDRESS"


def test_french_titles_and_prepositions():
    text = "La gaine est dans une cuve pour les essais. M. F. Brelldberg, titulaire de la pièce, est venu. Les essais de MORVELD, Kesto le confirment."
    assert [k[2] for k in pii.candidates(text) if k[0] == "name"] == ["F. Brelldberg", "MORVELD, Kesto"]
    assert [k[2] for k in pii.candidates("Signed by M. F. Brelldberg in London.") if k[0] == "name"] == ["M. F. Brelldberg"]


def test_no_texts(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find_pii(e).count() == 0
    assert pii.replace_pii(e, pii.find_pii(e)).count() == 0


def test_candidate_shapes():
    got = {(k[0], k[2]) for k in pii.candidates(TEXT)}
    assert {("address", "73 Kestrel Lane, Kandapur ZZ6 8QQ"), ("address", "P.O. Box 12, Quillon"), ("name", "Kesto Brellarde"), ("name", "MORVELD, Kesto"), ("number", "000-82-8673"), ("number", "+44 7700 900764"), ("email", "kesto.brellarde@example.org"), ("email", "kesto.morveld (at) example (dot) org")} <= got
    assert pii.candidates("") == [] and pii.candidates("@" * 5000 + "(" * 5000 + "1-" * 5000) is not None


def test_registered_queries_run(spark, sf):
    names = [n for n in entry.queries() if n[0] == "p" and n[1] in "35789"]
    assert {"p3_found", "p5_found", "p7_containers", "p8_found", "p9_found"} <= set(names)
    columns = {"p3_found": ["payment_uid", "settlement_uid"], "p5_found": ["order_uid", "payment_uid"], "p8_found": ["item_id", "doc_id"], "p9_found": ["doc_id", "pii_type", "pii_text"]}
    for n in names:
        df = entry.queries()[n](spark, sf)
        assert df.columns == columns.get(n, df.columns)
        assert df.count() > 0
