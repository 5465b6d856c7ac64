"""Conversation repair against all edit sequences of short conversations and a plain dynamic programme of long ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microfolio.llm import conversations as C

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
WELL = re.compile(r"(s?(ua)+)?\Z")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def faults_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not ends else "d" if (role, text) in seen else "-" if ends[-1] in ".!?" else "t")
        seen.add((role, text))
    return "".join(faults)


def programme(rows, faults):
    """Least (cost, letters, lines) by rows from the end; states by what was last said."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user:", "a": "assistant:"}
    n = len(rows)
    best = {(n + 1, q): (0, "", ()) if q in ("", "a") else None for q in follow}
    for i in range(n, -1, -1):
        here = {}
        for q in follow:
            options = []
            if i == n:
                options.append(best[n + 1, q])
            else:
                role, text = rows[i][2:]
                cost, letters, lines = best[i + 1, q]
                options.append((cost + 4, "D" + letters, lines))
                if faults[i] not in "bd":
                    extra = 3 * (faults[i] == "t")
                    cost, letters, lines = best[i + 1, follow[q]]
                    options.append((cost + 3 + extra, "R" + letters, (names[follow[q]] + text, *lines)))
                    if role[:1] == follow[q] or (q == "" and role[:1] == "s"):
                        cost, letters, lines = best[i + 1, role[:1]]
                        options.append((cost + extra, "K" + letters, (f"{role}:{text}", *lines)))
            here[q] = min([o for o in options if o], default=None)
        for _ in range(4):  # inserts stay at the row
            for q in follow:
                after = here[follow[q]]
                if after:
                    option = (after[0] + 3, "I" + after[1], (names[follow[q]], *after[2]))
                    here[q] = min(here[q], option) if here[q] else option
        best.update({(i, q): here[q] for q in follow})
    return best[0, ""]


def brute(rows):
    out = {}
    groups = defaultdict(list)
    for r in damage(rows):
        groups[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        found = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
        if not found:
            out[conv] = (0, 0, 0, 0, 0, 0, "", sha(""))
            continue
        turns = {r[1] for r in found if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = faults_of(found)
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        cost, letters, lines = programme(found, faults)
        out[conv] = (gaps, *[faults.count(f) for f in "bdt"], illegal, cost, letters, sha("\n".join(lines)))
    return out


def random_rows(n, seed, most=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = rng.choice(["Yes. ", "No", "Hm!\n", "", None, "a?b", "\t"]) if rng.random() < 0.7 else f"text {rng.random()}."
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), role, text))
    return rows


def outcome(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    found = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_search_against_all_edit_sequences():
    """Every sequence of letters up to the length that could be cheapest is tried on conversations of up to three rows."""
    for n in range(4):
        for initials in itertools.product("suao", repeat=n):
            for faults in itertools.product("-tb", repeat=n):
                best = None
                for letters in itertools.chain.from_iterable(itertools.product("DIKR", repeat=k) for k in range(n, n + 3)):
                    i, said, cost = 0, "", 0
                    for letter in letters:
                        if letter == "I":
                            said, cost = said + ("a" if said[-1:] == "u" else "u"), cost + 3
                            continue
                        if i == n or (letter != "D" and faults[i] == "b"):
                            break
                        cost += {"D": 4, "K": 0, "R": 3}[letter] + (3 if letter != "D" and faults[i] == "t" else 0)
                        said += {"D": "", "K": initials[i], "R": "a" if said[-1:] == "u" else "u"}[letter]
                        i += 1
                    else:
                        if i == n and WELL.match(said):
                            best = min(best or (999, ""), (cost, "".join(letters)))
                assert C.search("".join(initials), "".join(faults), C.START, C.CLOSED, True)[:2] == best


def test_long_conversations_against_programme():
    rng = random.Random(5)
    for n in (10, 60, 300):
        roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(n)]
        faults = "".join(rng.choice("---tbd") for _ in range(n))
        want = programme([(0, 0, r, "") for r in roles], faults)
        initials = "".join(r[0] if r[0] in "sua" else "o" for r in roles)
        assert C.search(initials, faults, C.START, C.CLOSED, True)[:2] == want[:2]


@pytest.mark.parametrize("block", [2, 256])
def test_repair(spark, docs_of, block):
    rows = random_rows(120, 3) + random_rows(1, 4, 40) + [(500, i // 3, ["user", "assistant"][i % 2], f"t{i // 5}") for i in range(200)]
    rows += [(None, i % 4, "user", "Null id.") for i in range(9)] + [(700, None, "system", "x")] + [(801, 3, "user", "Same.")] * 50
    rows += [(900, 1, "user", "long text " * 50000 + "."), (900, 2, "assistant", "ok."), (900, 0, "", "empty role.")]
    rows += [(c, 0, "user", "Alone.") for c in range(1000, 1060)]  # some of these lose all rows
    got = outcome(C.repair(spark.createDataFrame(rows, SCHEMA).repartition(6), block))
    want = brute(rows)
    assert got == want
    assert any(v[6] == "" and v[5] == 0 for v in want.values())


def test_supplied_table(spark, docs_of):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert outcome(C.repair(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_clashing_columns_and_empty_table(spark, docs_of):
    rows = random_rows(10, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "pos", "n", "copy", "block", "fault", "digest", "kind", "cost", "audit"):
        df = df.withColumn(name, F.lit("x"))
    assert outcome(C.repair(df)) == brute(rows)
    assert C.repair(df.where("false")).collect() == []
