"""Conversation repair against a search over all edits, and tables against step-by-step costs."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import groupby, product

import numpy as np
import pytest

from shelfmark.llm import conversation_repair as C
from shelfmark.llm import turn_grammar as G

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, pos int, same string, letters string"


def cheapest(rows):
    """(cost, audit, repaired lines) by trying all edits at all places; rows: (role, text, must go, truncated)."""

    @lru_cache(maxsize=None)
    def rest(i, roles):
        """roles: what was given so far, shortened to what still matters."""
        ways = []
        if i == len(rows):
            if GOOD.fullmatch(roles):
                return 0, "", ()
        else:
            role, text, gone, cut = rows[i]
            cost, audit, lines = rest(i + 1, roles)
            ways.append((cost + 4, "D" + audit, lines))
            if not gone:
                options = [("K", 0, role)] + [("R", 3, r) for r in ("user", "assistant")]
                for letter, price, new in options:
                    after = follow(roles, new[:1] or "?")
                    if after is not None:
                        cost, audit, lines = rest(i + 1, after)
                        ways.append((cost + price + 3 * cut, letter + audit, (f"{new}:{text}", *lines)))
        for new in ("user", "assistant"):
            after = follow(roles, new[0])
            if after is not None and len(after) < 9:
                cost, audit, lines = rest(i, after)
                ways.append((cost + 3, "I" + audit, (f"{new}:", *lines)))
        return min(ways, default=(10**9, "", ()), key=lambda w: (w[0], w[1]))

    def follow(roles, initial):
        """Roles that can still become good ones; a pair that is done is forgotten after two more."""
        new = roles + initial
        if not any(GOOD.fullmatch(new + x) for x in ("", "a", "ua")):
            return None
        return new

    return rest(0, "")


def test_cheapest_of_short_sequences_by_tables():
    """All sequences of up to three symbols: the same audit as the search over all edits."""
    roles = {1: "system", 3: "user", 5: "assistant", 7: "tool"}
    for n in range(4):
        for codes in product(range(G.SYMBOLS), repeat=n):
            rows = tuple(("user", "t", True, False) if c == 0 else (roles[c if c % 2 else c - 1], "t", False, c % 2 == 0) for c in codes)
            letters, state = G.letters_of(np.array(codes, np.int64))
            assert "".join(letters) + G.TAIL[state] == cheapest(rows)[1], codes


def test_stretches_chain_to_the_whole():
    rng = np.random.default_rng(1)
    for _ in range(60):
        whole = rng.integers(0, G.SYMBOLS, rng.integers(0, 40))
        cuts = [0, *sorted(rng.integers(0, len(whole) + 1, 3)), len(whole)]
        parts = [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        right = [G.AT_END]
        for part in parts[:0:-1]:
            right.append(int(G.stretch(part)[0][right[-1]]))
        state, out = 0, []
        for part, vector in zip(parts, reversed(right), strict=True):
            assert int(G.stretch(part)[1][vector, state]) == G.letters_of(part, vector, state)[1]
            letters, state = G.letters_of(part, vector, state)
            out += letters
        assert (out, state) == G.letters_of(whole)


def expected(rows):
    """One result per conversation from rows (conv_id, turn, role, text)."""
    damaged = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    same = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), same(r)))
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows}
    for conv, group in groupby(damaged, key=lambda r: r[0]):
        group, seen, states, count = list(group), set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in group:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            states.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in group if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        cost, audit, lines = dp(states)
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def dp(rows):
    """(cost, audit, lines) by a plain table of the best (cost, audit) behind each place and state."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}
    made = {"": (), "a": (), "u": ("assistant:",), "s": ("user:", "assistant:")}
    for role, text, gone, cut in reversed(rows):
        ways = {q: [(best[q][0] + 4, "D" + best[q][1], made[q])] for q in best}
        for q in best:
            for letter, price, new in [] if gone else [("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")]:
                to = steps.get((q, new[:1]))
                if to is not None:
                    ways[q].append((best[to][0] + price + 3 * cut, letter + best[to][1], (f"{new}:{text}", *made[to])))
        for _ in range(3):
            for q in best:
                for new in ("user", "assistant"):
                    to = steps.get((q, new[0]))
                    if to is not None:
                        ways[q] += [(c + 3, "I" + a, (f"{new}:", *m)) for c, a, m in [min(ways[to], key=lambda w: w[:2])]]
                ways[q] = [min(ways[q], key=lambda w: w[:2])]
        best, made = {q: w[0][:2] for q, w in ways.items()}, {q: w[0][2] for q, w in ways.items()}
    return *best[""], made[""]


def compare(spark, rows, slices="4"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
        got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_conversations(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(rows)


def talk(rng, conv, n):
    texts = ["Yes.", "Yes.", "no", "Why?", " ", "", None, "Been there\n", "é!", "Ω", "long " * 50 + ".", ". \t"]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None, "User", "unit", "système"]
    return [(conv, rng.choice((t, t, t, t, t, t, None, t + 3)), rng.choice(roles), rng.choice(texts)) for t in range(n)]


@pytest.mark.parametrize(("seed", "slices"), [(0, "1"), (1, "5"), (2, "40")])
def test_equals_brute_force(spark, seed, slices):
    rng = random.Random(seed)
    rows = [r for conv in [None, *range(60)] for r in talk(rng, conv, rng.randint(1, 9))]
    rows += rng.choices(rows, k=40)
    rows += talk(rng, 1000, 400)  # over several slices
    rows += [(2000, 5, "user", "Again.")] * 300
    compare(spark, rows, slices)


def test_conversations_without_rows_or_turns(spark):
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    compare(spark, [*gone, (-1, None, "user", "Hi."), (-1, None, None, None), (None, None, "user", "x" * 100_000)])
    assert C.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_ordinary_talk_is_kept(spark):
    rows = [(c, t, r, f"{c} {t}.") for c in range(300) for t, r in enumerate(("system", "user", "assistant"))]
    calm = [c for c in range(300) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3))]
    got = {r["conv_id"]: r for r in C.repair_conversations(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)).collect()}
    assert len(calm) > 50 and all(got[c]["audit"] == "KKK" and got[c]["cost"] == 0 for c in calm)
