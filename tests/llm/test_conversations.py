"""Conversation repair against enumeration of all edits and a plain suffix search."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from tuneweave.llm import conversations as C

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, pid int, cost long"


def tight(rows):
    """Least (cost, audit, repaired) by trying every edit from every state."""
    n, end = len(rows), {"": 0, "s": None, "u": None, "a": 0}
    follow = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}

    @lru_cache(None)
    def best(i, q, inserted=0):
        options = []
        if i == n and end[q] is not None:
            options.append((0, "", ()))
        for role in ("user", "assistant"):
            if role[0] in follow[q] and inserted < 3:
                c, a, r = best(i, role[0], inserted + 1)
                options.append((c + 2, "I" + a, ((role, ""),) + r))
        if i < n:
            (role, text, fault) = rows[i]
            c, a, r = best(i + 1, q)
            options.append((c + 3, "D" + a, r))
            if fault < 2:
                if role[:1] in follow[q]:
                    c, a, r = best(i + 1, role[:1])
                    options.append((c + fault, "K" + a, ((role, text),) + r))
                for new in ("user", "assistant"):
                    if new[0] in follow[q]:
                        c, a, r = best(i + 1, new[0])
                        options.append((c + 2 + fault, "R" + a, ((new, text),) + r))
        return min(options, default=(10 ** 9, "", ()))

    return best(0, "")


def enumerate_all(rows):
    """The same by plain enumeration of edit sequences."""
    gaps = [()] + [(x,) for x in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]
    found = []
    for ins in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("DKUA", repeat=len(rows)):
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                out += [(r, "") for r in ins[k]]
                audit += "I" * len(ins[k])
                cost += 2 * len(ins[k])
                if k < len(rows):
                    role, text, fault = rows[k]
                    e = edits[k]
                    if e == "D":
                        cost += 3
                    elif fault == 2:
                        break
                    else:
                        out.append((role if e == "K" else {"U": "user", "A": "assistant"}[e], text))
                        cost += fault + 2 * (e != "K")
                    audit += e if e in "DK" else "R"
            else:
                if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                    found.append((cost, audit, tuple(out)))
    return min(found)


def damaged(table):
    out = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def expected(table, damage=True):
    rows = damaged(table) if damage else table
    result = {}
    for conv in {r[0] for r in table}:
        mine = [r[1:] for r in rows if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role, text, {"": 0, "truncated": 1}.get(fault, 2)))
        cost, audit, kept = tight(tuple(kinds))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        result[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return result


def rows_of(rnd, conv, n, turns=None):
    out = []
    for k in range(n):
        role = rnd.choice(["user", "assistant"] if rnd.random() < 0.8 else ["system", "tool", "", "User", None, "usr"])
        text = rnd.choice(["a.", "b!", "c", "", " \n", "long text?", None, "é. \n", "d.."]) if rnd.random() < 0.6 else f"text {k}."
        out.append((conv, turns(k) if turns else k, role, text))
    return out


def frame(spark, table, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in table], SCHEMA).repartition(parts)


def report(spark, table):
    got = C.report(frame(spark, table)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_kernel_equals_enumeration():
    rnd = random.Random(1)
    cases = [[(rnd.choice(["user", "assistant", "system", "tool"]), f"t{k}", rnd.choice([0, 0, 0, 1, 2])) for k in range(n)]
             for n in (0, 1, 1, 2, 2, 2, 2, 3, 3) for _ in range(3)]
    for rows in cases:
        want = enumerate_all(rows)
        assert tight(tuple(rows)) == want
        initials, kinds, copies = [r[0][:1] for r in rows], [r[2] for r in rows], [1] * len(rows)
        costs = C.vectors(list(C.LAST), initials, kinds, copies)
        found, _ = C.walk(C.START, costs, initials, kinds, copies, True)
        assert (costs[0][C.START], "".join(x[0] for x in found)) == want[:2]


def test_report_equals_plain_search(spark):
    rnd = random.Random(5)
    table = [r for conv in range(60) for r in rows_of(rnd, conv, rnd.randint(1, 9))]
    table += rows_of(rnd, None, 6) + rows_of(rnd, 100, 5, lambda k: None if k == 0 else 3 * k)
    table += [(101, None, "user", "no turn.")] + [(102, 1, "user", "same.")] * 40 + rows_of(rnd, 102, 12)
    table += [(103, 2 ** 40, "user", "far."), (103, 0, "user", "x" * 100_000 + ".")]
    # a conversation whose only row the damage drops
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table += [(gone, 0, "user", "gone.")]
    got = report(spark, table)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == expected(table)


@pytest.mark.parametrize("size", [1, 3, 16])
def test_blocks_do_not_change_results(spark, size):
    rnd = random.Random(size)
    table = rows_of(rnd, 1, 150) + rows_of(rnd, 2, 3) + [(1, 40, "user", "again.")] * 30
    table = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in table]
    audits, repaired = C.repair(C.clean(frame(spark, table)), size)
    sha = {r.conv_id: r.repaired_sha256 for r in C.digests(repaired).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[r.conv_id])
           for r in audits.collect()}
    assert got == expected(table, damage=False)


def test_block_size_follows_the_longest_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BLOCK", 1)
    table = [(1, k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(900)]
    sizes = []
    cut = C.blocks
    monkeypatch.setattr(C, "blocks", lambda runs, size: sizes.append(size) or cut(runs, size))
    audits, _ = C.repair(C.clean(frame(spark, table)))
    assert audits.first().audit == "K" * 900
    assert sizes == [31]


def test_empty_table(spark):
    assert C.report(frame(spark, [])).collect() == []
