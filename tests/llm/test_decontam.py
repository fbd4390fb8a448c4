import random

from plumbline.llm import decontam

ITEMS = [
    (1, "Alice bought 12 apples for 3.50 dollars at the market near Boston. Later on the day Alice gave 5 apples to her brother and kept the rest."),
    (2, "the wide river turns north before it meets the old stone bridge and the quiet mill behind the green hill"),
    (3, "too short"), (4, None), (None, "no id at all in this one here"), (5, ""),
]


def pairs(spark, make_docs, rows, items=ITEMS):
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    return sorted((r["doc_id"], r["item_id"], r["n_changed"]) for r in decontam.contaminated(make_docs(rows), bench).collect())


def test_leaks_and_templates(spark, make_docs, prose):
    other = "Carla bought 40 apples for 9.25 euros at the market near Boston. Later on the day Carla gave 7 apples to her brother and kept the rest."
    torn = "Alice bought 12 apples for 3.50 dollars at the market near Boston."
    mixed = "Carla bought 40 apples for 9.25 euros at the market near Boston. Later on the day Denis gave 7 apples to her brother and kept the rest."
    rows = [
        (10, prose(1, 300) + ". " + ITEMS[0][1] + " " + prose(2, 300)), (11, "So it goes. " + other), (12, prose(3, 900)), (13, ITEMS[1][1].upper().replace(" ", "\n")),
        (14, "too short"), (15, "this is too short a text"), (16, None), (17, ""), (18, "the wide river turns south and the old mill"), (19, "w " * 200000 + ITEMS[1][1]),
        (20, torn), (21, mixed),
    ]
    got = pairs(spark, make_docs, rows)
    assert {(d, i) for d, i, _ in got} >= {(10, 1), (11, 1), (13, 2), (14, 3), (19, 2)}
    assert {d for d, _, _ in got}.isdisjoint({12, 15, 16, 17, 18})
    assert {n for d, i, n in got if (d, i) in ((10, 1), (13, 2))} == {0}
    assert dict(((d, i), n) for d, i, n in got)[11, 1] >= 4


def test_items_without_a_window_are_found_inside_documents(spark, make_docs, prose):
    items = [
        (1, "Compute 48 / 6 + 3 * 5"), (2, "Solve for x"), (3, "minutes remain until noon"), (4, "add 4 5 6 7 8 and 9 10 11 12 4"),
        (5, "小明有三個蘋果又買了五個一共有幾個"), (6, "7 8 9"), (7, "12 km or 3 km"), (8, "ask Ann 3 4 5 6"),
    ]
    inside = lambda i, t: prose(i, 200) + ". " + t + " " + prose(i + 50, 200)
    rows = [
        (1, inside(1, items[0][1])), (2, inside(2, "solve for X!")), (3, inside(3, "12 minutes remain until noon 30")), (4, inside(4, "add 14 15 16 17 18 and 19 20 21 22 14")),
        (5, "他說小明有三個蘋果又買了五個一共有幾個嗎"), (6, inside(6, "6 7 8 9 10")), (7, inside(7, "12 km or 3 km")), (8, inside(8, "ask Ann 3 4 5 6")),
        (11, inside(11, "Compute 48 / 6 + 3 * 6")), (12, inside(12, "solve for y")), (13, inside(13, "hours remain until noon")), (14, inside(14, "add 14 15 16 17 18 and 19 20 21 22 99")),
        (15, "他說小華沒有蘋果也沒有買"), (16, inside(16, "7 8 10")), (17, inside(17, "12 km or 4 km")), (18, inside(18, "ask Bob 3 4 5 6")),
    ]
    assert pairs(spark, make_docs, rows, items) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 9), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)]


def test_variants_of_one_item_in_one_document(spark, make_docs, prose):
    items = [(1, "What is 12 times 7 plus 30?"), (2, ITEMS[0][1])]
    sheet = " ".join(f"What is {i} times {i + 3} plus {50 - i}?" for i in range(1, 20))
    one, two = (ITEMS[0][1].replace("12", a).replace("3.50", b).replace("5 apples", f"{c} apples") for a, b, c in (("40", "9.25", "7"), ("31", "8.10", "2")))
    torn = "Alice bought 9 apples for 2 dollars at the market near Boston. "
    rows = [
        (1, "What is 3 times 5 plus 9? What is 8 times 2 plus 4?"), (2, sheet), (3, prose(1, 50) + ". " + one + " " + prose(2, 50) + ". " + two),
        (4, torn * 30 + prose(3, 40) + ". " + one + " " + prose(4, 40)), (5, "What is 3 plus 5 times 9? What is 8 minus 2 plus 4?"),
    ]
    assert {(d, i) for d, i, _ in pairs(spark, make_docs, rows, items)} == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_brute_force_containment(spark, make_docs, prose):
    """Without slots a pair counts exactly if half of the item's five-word windows are in the document."""
    items = [(i, prose(100 + i, 20 + i)) for i in range(12)]
    rows = []
    for i, text in items:
        words = text.split()
        for k in range(0, len(words), 3):
            rows.append((len(rows), prose(i * 50 + k, 30) + " " + " ".join(words[:k]) + " " + prose(i * 51 + k, 9)))
    want = []
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for d, t in rows:
        for i, text in items:
            places = [tuple(text.split()[j : j + 5]) for j in range(len(text.split()) - 4)]
            if 2 * sum(g in grams(t.split()) for g in places) >= len(places):
                want.append((d, i, 0))
    assert pairs(spark, make_docs, rows, items) == sorted(want)


def test_joins_and_filter(spark, make_docs, prose, monkeypatch):
    """Broadcast or shuffled, the join finds the same; the filter goes by text, whatever the ids."""
    rows = [(1, ITEMS[1][1]), (2, prose(4, 50)), (None, ITEMS[1][1]), (3, ITEMS[0][1]), (None, None), (2, ITEMS[1][1]), (4, "")]
    want = pairs(spark, make_docs, [r for r in rows if r[0]])
    assert [p[:2] for p in want] == [(1, 2), (2, 2), (3, 1)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(rows)
    for bound in (10**6, 0):
        monkeypatch.setattr(decontam, "BROADCAST_KEYS", bound)
        monkeypatch.setattr(decontam, "BROADCAST_DIGESTS", bound)
        assert pairs(spark, make_docs, [r for r in rows if r[0]]) == want
        kept = decontam.decontaminate(docs, bench)
        assert kept.schema == docs.schema and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[1], rows[4], rows[6]], key=str)


def test_slots_against_brute_force(spark, make_docs, prose):
    """The join loses no pair that every document held against every item has, slots of all kinds included."""
    rng = random.Random(7)
    names, units = ["Ann", "Bob", "Carl", "Dora"], ["km", "days", "euros", "kg"]
    frame = lambda k, n, m, a, u: f"After the {prose(k, 4)} near {a} they took {n} {u} of {prose(k + 1, 3)} and gave {m} {u} back to {a} for the {prose(k + 2, 5)}."
    draw = lambda: (rng.randint(1, 99), rng.randint(1, 99), rng.choice(names), rng.choice(units))
    items = [(i, frame(1000 + 10 * i, *draw())) for i in range(8)] + [(20, "Compute 4 + 5 * 6"), (21, "12 km or 3 km"), (22, "Solve for x"), (23, "yes"), (24, prose(5, 6)), (25, "7 8 9 1 2 3 4 5 6 7 8 9")]
    rows = [(i, prose(i, rng.randint(0, 40)) + ". " + frame(1000 + 10 * rng.randrange(8), *draw()) + " " + prose(i + 500, 20)) for i in range(60)]
    rows += [(100 + i, prose(i, 9) + ". " + t.replace("4", "44") + " " + prose(i + 50, 9)) for i, (_, t) in enumerate(items)] + [(200 + i, t) for i, (_, t) in enumerate(items)]
    rows += [(300 + i, " ".join(w for w in t.split() if rng.random() > 0.15)) for i, (_, t) in enumerate(items * 4)]
    want = sorted((d, i, f[4]) for d, t in rows for i, item in items for f in decontam.Index([(i, item)]).search([t])[0])
    assert pairs(spark, make_docs, rows, items) == want and len(want) > 60


def test_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b c d e f g")])
    assert decontam.contaminated(docs, none).count() == 0 and decontam.decontaminate(docs, none).count() == 1
    assert decontam.contaminated(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
