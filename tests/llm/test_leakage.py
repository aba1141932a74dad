"""Leaked passages: planted cases, near misses, and a dynamic-programming check."""

import random

import pytest

from factweave.llm.leakage import leaked_items, phrase_filter, postings, prepared_items, tokens_of

ASK = "Read the following passage about a fictional service and answer the question at the end in one short sentence."
SYLLABLES = ["kel", "vor", "mi", "tan", "ru", "sil", "bra", "osk"]


def passage(seed, n=40):
    rng = random.Random(seed)
    words: list[str] = []
    while len(words) < n:
        w = "".join(rng.choices(SYLLABLES, k=2)) if rng.random() < 0.4 else rng.choice("the rule says that goods travel before any weight is noted and no".split())
        if w not in words[-2:]:
            words.append(w)
    return words


ITEMS = {i: passage(i) for i in range(8)}
ZH = "倘若堇崧掌柜在九日内寻不到峤泓铜牌蕲旌渡口便改挂焱霏灯笼每个浚荀货场保管两枚峤泓印章而只有峤泓账房"


def case(spark, documents, items=None, **options):
    items = items or {**{i: f"{ASK}\n\n{' '.join(w)}.\n\nWhich step has to come first, and why?" for i, w in ITEMS.items()}, 99: ZH}
    d = spark.createDataFrame(list(enumerate(documents)), "doc_id long, text string")
    e = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return sorted(tuple(r) for r in leaked_items(d, e, **options).collect())


def test_planted(spark):
    w = ITEMS[3]
    documents = [
        "before " + " ".join(w) + " after",
        "x " + " ".join(w[5:17]) + " y",
        "x " + " ".join(w[5:16]) + " y",
        " ".join(w[4:24]).upper().replace(" ", "</b> <b>"),
        '{"t": "' + "\\n".join(w[4:24]) + '"}',
        " ".join(x[:2] + "\u00ad" + x[2:] for x in w[2:20]),
        " ".join([*w[4:12], "other", *w[13:24]]),
        " ".join([*w[4:12], *w[13:24]]),
        " ".join([*w[4:12], "added", *w[12:24]]),
        " ".join(x if k % 3 else "changed" for k, x in enumerate(w)),
        " ".join(random.Random(1).sample(w, len(w))),
        ASK,
        "Which step has to come first, and why? " + ASK,
        "甲乙" + ZH[3:35] + "丙丁",
        "甲乙" + ZH[3:25] + "丙丁",
        None,
        "",
    ]
    assert case(spark, documents) == [(0, 3), (1, 3), (3, 3), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3), (13, 99)]


def test_edges(spark):
    short = {1: "alpha beta gamma", 2: None, 3: "", 4: "alpha beta gamma"}
    assert case(spark, ["say alpha, beta gamma now", "alpha beta", None], short) == [(0, 1), (0, 4)]
    assert case(spark, ["x"], {1: None}) == []
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaked_items(d, e).count() == 0
    twice = ["x " + " ".join(ITEMS[0]) + " " + " ".join(ITEMS[1]) * 2]
    assert case(spark, twice) == [(0, 0), (0, 1)] == case(spark, twice, bits=64) == case(spark, twice, carried_words=0)  # a full bitmap only stores more
    assert case(spark, ["lorem " * 50_000 + " ".join(ITEMS[2]) + " ipsum" * 50_000]) == [(0, 2)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ends_match(a, b):
    """A stretch begins and ends with words that are kept."""
    return a[0] == b[0] and a[-1] == b[-1]


def brute(item, words):
    """Whether a stretch of 12 or more item words lies in the document with one change in eight."""
    for size in range(12, len(item) + 1):
        for o in range(len(item) - size + 1):
            for p in range(len(words)):
                for m in range(size - size // 8, size + size // 8 + 1):
                    if p + m <= len(words) and ends_match(item[o : o + size], words[p : p + m]) and edit_distance(item[o : o + size], words[p : p + m]) <= size // 8:
                        return True
    return False


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = {i: " ".join(passage(100 + 10 * seed + i, 24)) for i in range(3)}
    documents = []
    for _ in range(25):
        w = items[rng.randrange(3)].split()
        a = rng.randrange(0, 8)
        part = w[a : a + rng.randrange(10, 17)]
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(1, len(part) - 1)
            part[k : k + 1] = rng.choice([["new"], [], [part[k], "more"]])
        documents.append(" ".join([*rng.choices(["qq", "ww"], k=3), *part, *rng.choices(["qq", "ww"], k=3)]))
    want = {(n, i) for n, t in enumerate(documents) for i, x in items.items() if brute(x.split(), t.split())}
    got = set(case(spark, documents, items))
    assert got == want


def test_tokens_and_shared_wording(spark):
    assert tokens_of("Ｆｕｌｌ-width _em_ <b>bold</b> &amp; caf\\u00e9\\nnew o'clock re-\nported 好的") == ["full", "width", "em", "bold", "café", "new", "o", "clock", "reported", "好", "的"]
    assert tokens_of(f'one <a title="{"x " * 300}">two') == ["one", "two"]
    items = spark.createDataFrame([(1, f"{ASK} one two three"), (2, f"{ASK} four five six"), (2, f"{ASK} four five six"), (3, f"{ASK}: one, two, three!")], "item_id long, text string")
    named, texts = prepared_items(items, "item_id", "text")
    shared = texts.carried.column("shared").to_pylist()
    assert named.count() == 3 and len(shared) == 2 and all(sorted(x) == list(range(len(ASK.split()) - 5)) for x in shared)


def test_few_different_words_and_many_changes(spark):
    two = "tick tock " * 8
    assert case(spark, [f"{two} tick"], {1: two}) == [(0, 1)]
    w = [f"w{i}" for i in range(120)]
    changed = [x if i % 8 != 7 else "other" for i, x in enumerate(w)]  # 15 changes, each side of any phrase
    assert case(spark, [" ".join(changed)], {1: " ".join(w)}) == [(0, 1)]


def test_many_items_in_one_pass(spark):
    items = {i: " ".join(passage(1000 + i, 24)) for i in range(20_000)}
    documents = [f"noise before {items[i]} noise after" for i in range(0, 20_000, 997)] + ["noise only " * 20]
    assert case(spark, documents, items) == [(n, i) for n, i in enumerate(range(0, 20_000, 997))]


def test_index_holds_lists_of_all_documents(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    documents = spark.createDataFrame([(1, "x c d e f g y"), (2, "a b c d x e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")
    index = postings(documents, "doc_id", "text", phrase_filter(prepared_items(items, "item_id", "text")[1]))
    assert sorted((r.term, r.doc_id, r.positions) for r in index.collect() if len(r.grams) == 5) == [(t, 1, [i + 1]) for i, t in enumerate("cdefg")]
