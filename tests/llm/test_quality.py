"""Forms of texts in several languages and layouts; statistics of edge cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factweave.llm import quality
from factweave.llm.quality import Form, phrase_coverage, quality_statistics
from tests.helpers import rows

WORDS = frozenset("the a of to and in is that it for as with was on are be at by we not after before when if would der die das und nicht wir ist den noch an que de los la el no se en y les des le et pas à il sur du".split())
PROSE = [
    "The team decided to keep the index as it was, and that is why we would not change it before the next run.\nIt was late.",
    "after the rollout we found that it was not as fast as the old one and that is all we know of it",
    "THE TEAM DECIDED TO KEEP THE INDEX AS IT WAS, AND THAT IS WHY WE WOULD NOT CHANGE IT.",
    "Wir haben die Belege noch nicht geprüft, und das ist der Grund, an dem die Läufe hängen.",
    "No se puede mover nada de los registros en la noche, que es el momento de los turnos.",
    "大家一致认为应当先收集归档，然后再与重复的路由逐一核对。如果没有来源，系统仍然会移动缺失的归档。",
    "对于旧的请求来说情况并不相同 因为它们既不能合并消息 也不能交给信封 在下一次运行之前 我们必须先丢弃它",
    "Q: Is it not the case that the index was in the store?\n\nA: It was, and we would not be here if it was not.",
    "- It is not the job of the index to be fast in the night.\n- We would not keep it if it was not in the store.",
    "<p>The team decided to keep the index as it was, and that is why we would not change it.</p>",
]
FORMS = [
    ("list", "- quick parcel\n- slow index\n- the store\n- deep archive\n- late run"),
    ("list", "1) quick parcel.\n2) slow index.\n3) store.\n4) deep archive."),
    ("list", "quick parcel, slow index, old store, deep archive, late run, empty queue, open ticket, hidden field"),
    ("list", "* 旧的响应\n* 严格的班表\n* 嵌套的消息\n* 外部的仓库"),
    ("list", "quick parcel\nslow index store\narchive\ndeep queue\nopen ticket\nlate run"),
    ("list", "archive: recursive cursor\nupper bundle roster: probe\nnullable resolver: remote orchard"),
    ("table", "| name | size | date |\n|---|---|---|\n| parcel | 12 | 2025-01-01 |\n| index | 7 | 2025-02-01 |"),
    ("table", "name\tsize\nparcel\t12\nindex\t7\nstore\t9"),
    ("table", "parcel;12;yes\nindex;7;no\nstore;9;n/a"),
    ("table", "name         size      date\nparcel       12        2025-01-01\nopen index   7         2025-02-01"),
    ("table", "<table>\n<tr><td>parcel</td><td>12</td></tr>\n<tr><td>index</td><td>7</td></tr>\n</table>"),
    ("table", "8959 113 1673 3199\n9450 983 3148 8228\n2924 8229 4072 6523"),
    ("code", "func Get(ctx context.Context) error {\n\tif err != nil {\n\t\treturn err\n\t}\n\treturn nil\n}"),
    ("code", "def get(x):\n    # the index is in the store and not at the top\n    if x is None:\n        return 1\n    return x + 1"),
    ("code", "SELECT a, COUNT(*) FROM t WHERE b = 1 GROUP BY 1;\nexport X=1 && ./bin/run --fast=2"),
    ("code", "openapi: 3.1.0\npaths:\n  /v1/x:\n    get:\n      operationId: getX\n      responses:\n        '200':\n          $ref: '#/c/X'"),
    ("code", '[{"type": "object", "properties": {"a": {"type": "string"}}}]'),
    ("junk", "Home | Login | Search | Docs | Print | Menu | Home | Help"),
    ("junk", "Loading...\nLoading...\nLoading...\nLoading...\nLoading..."),
    ("junk", "pallet pallet pallet pallet pallet pallet pallet pallet pallet pallet"),
    ("junk", "xkfqw zrtpl mnbvc qwrtz plkjh gfdsm nbvcx trwqz hjklp zxcvb"),
    ("junk", "QuUFCtW1PZ1hoaoiKc/wxqILb9uYzdvH8n8DMP4Iqs9RGjJ3BJrCCHetm3Hdk2010bd3HUmiB4c8"),
    ("junk", "00000000  9c 3e dc 62 10 91 66 ae f2 e8\n00000010  00 49 15 a4 d7 bd 90 d3 42 58"),
    ("junk", "@▒{~<_)░[]+![%█▒+{+:}*{-=)^-?|<?<~(░]{)($—.}-*@+&@*"),
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert Form(WORDS).read(text)[-1] is None


@pytest.mark.parametrize("form,text", FORMS)
def test_forms(form, text):
    assert Form(WORDS).read(text)[-1] == form


def test_share_decides():
    listed = "\n".join(f"- open ticket {x}" for x in "abcdefghij")
    assert Form(WORDS).read(PROSE[0] + "\n\n" + listed * 2)[-1] == "list"
    assert Form(WORDS).read(PROSE[0] * 4 + "\n\n" + listed)[-1] is None


def test_statistics(spark):
    common = spark.createDataFrame([("en", w, 1) for w in WORDS], "lang string, word string, freq_rank int")
    long = (PROSE[0] + "\n") * 20_000
    texts = [None, "", " \n\t ", "the index.\nthe index.", long, "the the a the"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    got = {r.doc_id: r for r in quality_statistics(docs, common).collect()}
    assert all(got[i].word_count == 0 and got[i].form is None for i in range(3))
    assert (got[3].word_count, got[3].punctuated_line_share, got[3].common_word_share, got[3].duplicate_line_share) == (4, 1.0, 0.5, 0.5)
    assert got[3].mean_word_length == pytest.approx(4.5)
    assert got[4].duplicate_line_share > 0.99
    assert len(rows(quality_statistics(docs.unionAll(docs), common), "doc_id")) == 12
    assert quality_statistics(docs.limit(0), common.limit(0)).count() == 0


def test_chinese_words():
    words = frozenset(["的", "我们", "没有", "没", "index"])
    text = "我们没有旧的路由，index的"
    assert Form(words).split(text.split()) == ["我们", "没有", "旧", "的", "路", "由", "index", "的"]
    count, length, _, _, common, *_ = Form(words).read(text)
    assert (count, length, common) == (8, 14 / 8, 5 / 8)
    assert Form(words).read("的的的的 的的。")[:5:4] == (6, 1.0)
    assert Form(words).read("我们路由 我们路由 我们路由")[7] >= 0.75
    assert Form(words).read("「，」旧")[0] == 1
    assert Form(words).read("，。、")[:2] == (1, 3.0)


@pytest.mark.parametrize("text", ["pallet orchid rocket " * 9, "amber bridge cursor delta ember falcon " * 7, "托盘路由字段" * 12, "\n".join(["pallet one", "rocket two"] * 8), "the index is in the store " * 8])
def test_loops_are_junk(text):
    read = Form(WORDS).read(text)
    assert read[-1] == "junk" and 0.4 < read[7] <= 1


def test_twice_is_no_loop():
    assert Form(WORDS).read(PROSE[0] + "\n" + PROSE[0])[-1] is None
    assert Form(WORDS).read("ab ab ab ab cd")[7] == 8 / 10


def covered(words):
    """The same by looking at every phrase."""
    best = loop = 0
    for n in range(2, 17):
        for phrase in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}:
            places = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) == phrase]
            times = free = 0
            for i in places:
                if i >= free:
                    times, free = times + 1, i + n
            if times > 1:
                best = max(best, times * len("".join(phrase)))
            if times > 3:
                loop = max(loop, times * len("".join(phrase)))
    return best, loop


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc"]), max_size=24), max_size=5))
def test_phrases_of_many_texts(texts):
    assert phrase_coverage(texts) == [covered(t) for t in texts]


def test_texts_at_once(monkeypatch):
    texts = [None, "", PROSE[0], "ab ab ab ab cd", PROSE[0] * 3, "x"]
    want = [Form(WORDS).read(t) for t in texts]
    for words in (1, 20, 10_000):
        monkeypatch.setattr(quality, "WORDS_AT_ONCE", words)
        assert list(Form(WORDS).read_all(texts)) == want
    assert list(Form(WORDS).read_all([])) == []
