import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings, strategies as st

from mailtriage.llm import turn_repair as R

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute(turns):
    """Every sequence of edits: (cost, audit, repaired) of the cheapest, ASCII-least one."""
    best = (2 * len(turns), "D" * len(turns), [])
    inserts = [()] + [x for n in (1, 2, 3) for x in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        for added in inserts:
            c = cost + 5 * len(added)
            a, o = audit + "I" * len(added), out + [(r, "") for r in added]
            if i == len(turns):
                if GRAMMAR.fullmatch("".join(r[:1] or " " for r, _ in o)) and (c, a) < best[:2]:
                    best = (c, a, o)
                continue
            role, text, fault = turns[i]
            go(i + 1, c + 2, a + "D", o)
            if fault not in "bd":
                extra = 5 * (fault == "t")
                go(i + 1, c + extra, a + "K", o + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, c + 1 + extra, a + "R", o + [(new, text)])

    go(0, 0, "", [])
    return best


def code_of(turns):
    return "".join((r[:1] or " ") + f for r, _, f in turns)


def applied(turns, edits):
    return [(role or turns[i][0], "" if i < 0 else turns[i][1]) for letter, i, role in edits if letter != "D"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from("--tbd")), max_size=4))
def test_repair_is_the_least_of_all_edits(pairs):
    turns = [(r, f"text {i}", f) for i, (r, f) in enumerate(pairs)]
    cost, edits = R.repair(code_of(turns))
    assert (cost, "".join(e[0] for e in edits), applied(turns, edits)) == brute(turns)


def by_states(code):
    """Least (cost, audit) by the states of the grammar, from the end: for long codes."""
    n = len(code) // 2
    none = (1 << 50, "")
    # 0: nothing yet, 1: s seen, 2: u seen, 3: a seen.
    after = {s: (0, "") if s in (0, 3) else none for s in range(4)}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def with_inserts(table):
        table = dict(table)
        for _ in range(4):
            for (s, c), t in step.items():
                if c != "s":
                    table[s] = min(table[s], (table[t][0] + 5, "I" + table[t][1]))
        return table

    table = with_inserts(after)
    for i in reversed(range(n)):
        initial, fault = code[2 * i], code[2 * i + 1]
        new = {s: (table[s][0] + 2, "D" + table[s][1]) for s in range(4)}
        if fault not in "bd":
            extra = 5 * (fault == "t")
            for (s, c), t in step.items():
                if c == initial:
                    new[s] = min(new[s], (table[t][0] + extra, "K" + table[t][1]))
                if c != "s":
                    new[s] = min(new[s], (table[t][0] + extra + 1, "R" + table[t][1]))
        table = with_inserts(new)
    return table[0]


def test_long_codes_equal_the_state_form():
    rng = random.Random(3)
    for n in [*range(0, 40), 120, 400]:
        for _ in range(4):
            code = "".join(rng.choice("uauauas ") + rng.choice("------tbd") for _ in range(n))
            cost, edits = R.repair(code)
            assert (cost, "".join(e[0] for e in edits)) == by_states(code)


WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_rows(rows):
    """The query's result by plain Python."""
    grouped = {}
    for conv, turn, role, text in rows:
        kept = grouped.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in grouped.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in kept:
            chars = WORD.findall(text)
            turns.append((role, text, "b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else "-"))
            seen.add((role, text))
        numbers = [t for t, *_ in kept if t is not None]
        initials = [r[:1] or " " for r, *_ in turns]
        cost, audit = by_states(code_of(turns))
        fixed = applied(turns, R.repair(code_of(turns))[1])
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in fixed))
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(sum(t[2] == f for t in turns) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(df, rows):
    got = R.with_digest(R.repaired(R.damaged(df))).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == brute_rows(rows)
    assert len(got) == len(brute_rows(rows))


def test_given_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    check(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in [
        (None, "user", "no turn."), (None, None, "no role."), (0, "system", "Be kind."), (1, "user", None), (1, "user", "tie."), (3, "user", "cut"), (3, "user", "cut"),
        (4, "assistant", "Why?\x0b\n"), (5, "tool", "x!"), (6, "", "no initial."), (9, "assistant", " \t\r\n\x0c"), (10, "assistant", " "), (11, "user", "été."), (12, "\U0001f600", "smile.")]]
    rows += [(100 + i, 0, "user", "alone.") for i in range(60)] + [(200, 2 ** 40, "user", "late."), (200, -5, "assistant", "early.")]
    rows += [(300, i, "ua"[i % 2], f"turn {i}." if i % 7 else "cut") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    df = df.selectExpr("*", "'own' AS gone", "'own' AS copies", "'own' AS seen", "'own' AS at", "'own' AS turns", "'own' AS cost", "'own' AS audit", "'own' AS code")
    check(df, rows)
    assert R.with_digest(R.repaired(R.damaged(df.limit(0)))).count() == 0
