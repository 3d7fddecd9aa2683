import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import catalog, turn_repair


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, [])
        name = lambda v: " " if v is None else v
        act = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = name(role), name(text)
        if act == 0:
            continue
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        out[c] += [(t, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def least(rows):
    """Cost and audit by whole strings: the least pair from every turn and state, backwards."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    ends = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    for role, fault in reversed(rows):
        best = {}
        for state in ends:
            found = [(ends[state][0] + 4, "D" + ends[state][1])]
            late = 3 if fault == 3 else 0
            if fault not in (1, 2):
                initial = role[:1]
                if initial and (initial == follow[state] or (state == "" and initial == "s")):
                    found.append((ends[initial][0] + late, "K" + ends[initial][1]))
                to = follow[state]
                found.append((ends[to][0] + late + 3, "R" + ends[to][1]))
            best[state] = min(found)
        for _ in range(3):
            for state in best:
                cost, audit = best[follow[state]]
                best[state] = min(best[state], (cost + 3, "I" + audit))
        ends = best
    return ends[""]


def plain(rows):
    out = []
    for c, turns in damaged(rows).items():
        faults, seen = [], set()
        for t, role, text in turns:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = least([(r, f) for (_, r, _), f in zip(turns, faults)])
        lines, at, state = [], 0, ""
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            fits = "a" if state == "u" else "u"
            full = {"a": "assistant", "u": "user"}[fits]
            if letter == "I":
                lines.append(f"{full}:")
                state = fits
                continue
            role = turns[at][1] if letter == "K" else full
            lines.append(f"{role}:{turns[at][2]}")
            state, at = role[0], at + 1
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and at == len(turns)
        given = [t for t, _, _ in turns if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        pairs = zip(turns, turns[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        out.append((c, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def key(row):
    return (row[0] is not None, row[0] or 0)


def random_rows(rng):
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No!", "cut off", "Why?\n", f"{rng.random()}.", f"{rng.random()}"])
    role = lambda: rng.choice(["user", "assistant"] * 4 + ["system", None, "tool", "", "Uhu", "apple"])
    rows = [(c, t, role(), text()) for c in range(300) for t in rng.sample(range(14), rng.randint(1, 10))]
    rows += [(2, None, "user", "Hm."), (2, None, "assistant", "Hm."), (3, 5, "user", "Twice."), (3, 5, "user", "Twice."), (3, 7, "user", "Twice.")]
    rows += [(None, t, role(), text()) for t in (0, 1, 2, None)]
    rows += [(900, t, role(), text()) for t in rng.sample(range(9000), 2600)]  # one conversation in several blocks
    rows += [(901, t, ("user", "assistant")[t % 2], f"{t}." * 40_000) for t in range(12)]  # and one of long texts
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    rows = random_rows(random.Random(11))
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("missing", "act", "block", "digest", "again")})
    got = turn_repair.repair(turn_repair.damaged(frame))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)
    assert turn_repair.repair(turn_repair.damaged(frame.limit(0))).count() == 0


def test_query(spark):
    directory = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{directory}/conversations.parquet").select(*[f.split()[0] for f in SCHEMA.split(", ")]).collect()]
    assert sorted(map(tuple, catalog.op13_turn_repair(spark, directory).collect()), key=key) == sorted(plain(rows), key=key)


def test_ranks_order_audits():
    """Ranks of start nodes tell audits apart, and the least paths are those of whole strings."""
    rng = random.Random(4)
    runs = [[(rng.choice("suax"), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(0, 40))] for _ in range(400)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    flat = [x for r in runs for x in r]
    initial, fault = np.array(["suax".index(r) for r, _ in flat]), np.array([f for _, f in flat])
    paths = turn_repair.Paths(first, initial, fault == 1, fault == 3, np.tile(turn_repair._END, (len(runs), 1)), True)
    audits, _ = paths.audits(4 * paths.begin)
    assert [(c, a) for c, a in zip(paths.cost[paths.begin, 0].tolist(), audits)] == [least(r) for r in runs]
    ranks = paths.rank[4 * paths.begin]
    assert [audits[i] for i in np.argsort(ranks, kind="stable")] == sorted(audits)
