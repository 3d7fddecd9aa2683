import random
import re

from tracewell.llm import decontaminate
from tracewell.llm.decontaminate import budget, myers

from .helpers import SCHEMA, documents, odd_rows, sentence

ITEMS = "item_id long, text string"


def words(text):
    raw = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    return [w.lower() for w in raw]


def distance(item, text):
    """The smallest edit distance of the item to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(rows, items):
    out = set()
    for doc, text, *_ in rows:
        for number, item in items:
            pattern = words(item)
            if pattern and (d := distance(pattern, words(text))) <= budget(len(pattern)):
                out.add((doc, number, d))
    return out


def test_myers():
    rng = random.Random(2)
    for _ in range(400):
        item = [rng.randint(0, 3) for _ in range(rng.randint(1, 80))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        assert myers(item, text)[0] == distance(item, text)


def changed(rng, item, edits):
    out = item.split()
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "other"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "more")
    return " ".join(out)


def test_edited_items_in_texts(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, n)) for i, n in enumerate((1, 3, 4, 5, 9, 15, 30, 60, 64, 65, 130))]
    items += [(100, items[6][1]), (101, None), (102, ""), (103, "!!"), (None, "alphabeta gammadelta etazeta thetaiota kappamu")]
    rows = []
    for doc in range(90):
        item = rng.choice([i for _, i in items if i and len(i) > 3])
        text = sentence(rng, rng.randint(0, 40)) + ", " + changed(rng, item, rng.randint(0, 1 + len(item.split()) // 4)).upper() + "! " + sentence(rng, rng.randint(0, 30))
        rows.append((doc, text, "en", "a", 0))
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == plain(rows, items)
    texts, wanted = {r[0]: words(r[1]) for r in rows}, dict(items)
    for r in got:  # the span that is named is a copy of that distance
        part = texts[r.doc_id][r.first_word:r.last_word + 1]
        assert distance(words(wanted[r.item_id]), part) == r.distance


def test_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    rng = random.Random(4)
    rows = odd_rows()
    items = [(1, " ".join(rows[0][1].split()[10:60])), (2, sentence(rng, 30)), (3, "one"), (4, "één ééN"), (5, " ".join(rows[10][1].split()[-45:]))]
    docs = documents(spark)
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, ITEMS)).collect()
    short = [(d, t if t is None or len(t) < 100_000 else " ".join(t.split()[-60:]), *r) for d, t, *r in rows]
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == plain(short, items)
    kept = decontaminate.clean(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns
    dirty = [d for d, t, *_ in short if plain([(d, t)], items)]
    assert kept.count() == len(rows) - len(dirty)


def test_a_passage_repeated_very_often(spark):
    rng = random.Random(9)
    item = sentence(rng, 20)
    rows = [(1, " ".join([item] * 2000), "en", "a", 0), (2, " ".join((item.split()[:5] + ["x"]) * 500), "en", "a", 0)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], ITEMS)).collect()
    assert [(r.doc_id, r.distance) for r in got] == [(1, 0)]


def test_empty(spark):
    docs, none = documents(spark), spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == len(odd_rows())
    assert decontaminate.contaminated(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
