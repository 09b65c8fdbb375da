import random
import unicodedata

from compare import duck

from opstrata.llm import leakage
from opstrata.llm.queries import QUERIES


def plain_words(t):
    out, run = [], ""
    for c in unicodedata.normalize("NFKC", t or "").lower() + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def test_p8_found_is_brute_force(spark, sf):
    con = duck(sf)
    grams = {}
    for i, t in con.execute("select item_id, text from eval_items").fetchall():
        w = plain_words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in con.execute("select doc_id, text from documents").fetchall():
        w = plain_words(t)
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    got = [tuple(r) for r in QUERIES["p8_found"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_tiles_cover_reordered_passages():
    rng = random.Random(4)
    item = [f"w{i}" for i in range(60)]
    doc = ["x"] * 5 + item[30:60] + ["y"] + item[0:29] + item[10:25] + ["z"]
    seeds = leakage.Seeds([(1, " ".join(item))], 12)
    (row,) = leakage._leaks_of(seeds, [9], [" ".join(doc)])
    assert row == (9, 1, 2, 30, 59, 60)
    for _ in range(60):
        vocabulary = [f"v{i}" for i in range(3)]
        a, b = ([rng.choice(vocabulary) for _ in range(rng.randrange(4, 40))] for _ in range(2))
        tiles_of = list(leakage._leaks_of(leakage.Seeds([(1, " ".join(b))], 3), [1], [" ".join(a)]))
        longest = max((n for n in range(3, 41) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
        assert (tiles_of[0][3] if tiles_of else 0) == longest


def test_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "short text"), (None, text), (5, text.upper())], "item_id long, text string").repartition(2)
    dressed = "**" + text.replace(" ", "_ —\n") .replace("word3", "ｗｏｒｄ３") + "**"
    docs = spark.createDataFrame([(1, dressed), (2, text[:60]), (3, None), (4, ""), (None, text), (5, "lead " + text), (5, text[:60])], "doc_id long, text string")
    want = {(1, 1), (1, 5), (5, 1), (5, 5)}
    for chars in (10, 10**6):
        rows = leakage.leaks(docs, items, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and all(r.longest == r.covered == 20 for r in rows) and len(rows) == 4
    assert leakage.leaks(docs.limit(0), items).count() == leakage.leaks(docs, items.limit(0)).count() == 0
