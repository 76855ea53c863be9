"""Conversation structure repair against all ways of editing short conversations, and what odd turns give."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerframe.llm import queries, structure

INITIALS = {"s": "system", "u": "user", "a": "assistant", "x": "x-tool"}
GAPS = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_trying(rows):
    """cost, audit and text: the least of all edits, with up to two turns inserted at every place."""
    best = None
    ways = []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        own = [(3, "D", ())]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [(more, "K", ((role, text),)), (2 + more, "R", (("user", text),)), (2 + more, "R", (("assistant", text),))]
        ways.append(own)
    for chosen in itertools.product(*ways):
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            price = sum(c[0] for c in chosen) + 2 * sum(map(len, gaps))
            if best and price > best[0]:
                continue
            left, audit = [(r, "") for r in gaps[0]], "I" * len(gaps[0])
            for c, gap in zip(chosen, gaps[1:], strict=True):
                left += [*c[2], *((r, "") for r in gap)]
                audit += c[1] + "I" * len(gap)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in left)):
                found = (price, audit, "\n".join(f"{r}:{x}" for r, x in left))
                best = min(best, found) if best else found
    return best


def told(rows):
    repair, seen = structure.Repair(), set()
    for i, (role, text) in enumerate(rows):
        repair.add(i, role, text, (role, text) in seen)
        seen.add((role, text))
    return repair.end()


def check(rows):
    price, audit, text = by_trying(rows)
    own = told(rows)
    assert own[5:] == (price, audit, hashlib.sha256(text.encode()).hexdigest()), rows
    found = faults(rows)
    assert own[1:4] == tuple(found.count(f) for f in ("blank", "duplicate", "truncated"))
    assert own[4] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_every_short_conversation(n):
    for roles in itertools.product("suax", repeat=n):
        for texts in itertools.product(["Yes.", "cut", ""], repeat=n):
            check([(INITIALS[r], t) for r, t in zip(roles, texts, strict=True)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(list(INITIALS.values()) + [" ", ""]), st.sampled_from(["A.", "B!", "so", " \t", "No?\n"])), min_size=3, max_size=4))
def test_longer_conversations(rows):
    check(rows)


def quadratic(rows):
    """cost and audit by whole strings: the best for each last role after every turn."""
    best = {"": (0, "")}
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        now = {k: (c + 3, a + "D") for k, (c, a) in best.items()}
        if fault not in ("blank", "duplicate"):
            for last, (c, a) in best.items():
                for kind in "sua":
                    if (kind == "s" and (last or role[:1] != "s")) or (last, kind) == ("", "x"):
                        continue
                    n = int((last, kind) in {("", "a"), ("s", "a"), ("u", "u"), ("a", "a")})
                    own = role[:1] == kind
                    way = (c + 2 * n + 2 * (not own) + (fault == "truncated"), a + "I" * n + ("K" if own else "R"))
                    now[kind] = min(now.get(kind, way), way)
        best = now
    tail = {"": "", "s": "II", "u": "I", "a": ""}
    return min((c + 2 * len(tail[k]), a + tail[k]) for k, (c, a) in best.items())


@pytest.mark.parametrize("roles", ["suax", "x", "us", "ua", "aax"])
def test_long_conversations(roles):
    pick = random.Random(roles)
    rows = [(INITIALS[pick.choice(roles)], pick.choice([f"{i}.", f"{i}", "A.", ""])) for i in range(600)]
    own = told(rows)
    assert own[5:7] == quadratic(rows)
    assert len(structure._STEPS) < 3_000  # steps repeat


SCHEMA = "conv_id long, turn long, role string, text string, key string, conv int, block long, seen int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA)


def sample(seed=1):
    pick = random.Random(seed)
    rows = [(c, t if pick.random() < 0.95 else None, pick.choice(["user", "assistant", "assistant", "system", "tool", None]), pick.choice([f"Text {t}.", "same.", "open", "", None, "x" * 3_000 + "!"])) for c in range(40) for t in range(pick.randrange(0, 14))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"turn {t % 700}.") for t in range(2_000)]  # one long conversation
    rows += [(None, t, "user", "Hi.") for t in range(3)] + [(98, None, None, None)] + [(97, 1, "user", "Twice.")] * 3
    pick.shuffle(rows)
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r or " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        price, audit = quadratic([(r, x) for _, r, x in own])
        numbers = [t for t, _, _ in own if t is not None]
        left, it = [], iter(own)
        for edit in audit:
            row = next(it) if edit != "I" else None
            if edit == "D":
                continue
            due = "assistant" if (left and left[-1][0][:1] == "u") else "user"
            left.append((due, "") if edit == "I" else (row[1] if edit == "K" else due, row[2]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *(faults([(r, x) for _, r, x in own]).count(f) for f in ("blank", "duplicate", "truncated")), price, audit, digest, left)
    return out


@pytest.mark.parametrize("block", [7, 4_096])
def test_tables(spark, monkeypatch, block):
    monkeypatch.setattr(structure, "BLOCK_TURNS", block)
    rows = sample()
    data, want = table(spark, rows), expected(rows)
    report = structure.repaired(data)
    got = {r.conv_id: r for r in report.collect()}
    assert set(got) == set(want)
    for conv, r in got.items():
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.cost, r.audit, r.repaired_sha256) == want[conv][:7], conv
    left = {}
    for r in structure.applied(data, report).sort("conv_id", "place").collect():
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {c: w[7] for c, w in want.items() if w[7]}


def test_empty_table(spark):
    none = table(spark, [])
    assert structure.repaired(none).count() == 0
    assert structure.applied(none, structure.repaired(none)).count() == 0


def test_query_keeps_conversations_of_which_all_was_dropped(spark, tmp_path):
    import zlib

    gone = [k for k in range(500) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    rows = [(k, 0, "user", "Hi.") for k in gone] + [(None, None, None, None), (1, None, "user", "A.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {*gone, None, 1}
    assert all(got[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)
